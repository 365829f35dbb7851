"""Token-level filters, losses and selections. Tokens are long rows: sequence, position and values."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GATHERED = 10_000  # records of which a task takes the leading ones at once


def gibberish_index(ids: Column, logprobs: Column, id_threshold: int, vocab: int, offset: float) -> Column:
    """Position of the first token that is rare by id and improbable by ln(vocab) + offset; null if none. Arrays in."""
    limit = F.lit(-math.log(vocab) - offset)
    hit = F.zip_with(ids, logprobs, lambda i, p: (i > id_threshold) & (p < limit))
    at = F.array_position(hit, F.lit(True))
    return F.when(at > 0, at - 1)


def repetition_index(logprobs: Column, window: int, probability: float) -> Column:
    """Position at which ``window`` tokens in a row have been above the probability; null if none. Array in."""
    limit = F.lit(math.log(probability))
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("hit"))
    step = lambda s, p: F.struct(F.when(p > limit, s["run"] + 1).otherwise(F.lit(0)).alias("run"), (s["at"] + 1).alias("at"), F.when(s["hit"].isNull() & (p > limit) & (s["run"] + 1 >= window), s["at"]).otherwise(s["hit"]).alias("hit"))
    return F.aggregate(logprobs, start, step)["hit"]


def first_gibberish(tokens: DataFrame, id_threshold: int, vocab: int, offset: float) -> DataFrame:
    """seq_id, index of the first gibberish token, over long rows."""
    hit = (F.col("token_id") > id_threshold) & (F.col("logprob") < F.lit(-math.log(vocab) - offset))
    return tokens.groupBy("seq_id").agg(F.min(F.when(hit, F.col("pos"))).alias("index"))


def first_repetition(tokens: DataFrame, window: int, probability: float, key: str = "seq_id", order: str = "pos") -> DataFrame:
    """key, index at which a streak of probable tokens reaches the window, by gaps and islands."""
    hot = F.col("logprob") > F.lit(math.log(probability))
    w = Window.partitionBy(key).orderBy(order)
    t = tokens.withColumn("_hot", hot).withColumn("_n", F.row_number().over(w) - 1).withColumn("_island", F.sum(F.when(hot, 0).otherwise(1)).over(w))
    streak = F.sum(F.col("_hot").cast("int")).over(Window.partitionBy(key, "_island").orderBy(order))
    return t.withColumn("_streak", streak).groupBy(key).agg(F.min(F.when(F.col("_streak") >= window, F.col("_n"))).alias("index"))


def apply_filters(rows: DataFrame, detections: list[tuple[str, Column, bool]], mask: str = "completion_mask", stop: str = "stop_condition") -> DataFrame:
    """Filters in order, the first detection wins. (name, detected, enforce): an enforced one clears the mask and names
    itself as the stop condition; the reward stays. Adds detected_by and a 0/1 column filter/<name> for each."""
    name, enforced = F.lit(None).cast("string"), F.lit(False)
    for n, hit, enforce in reversed(detections):
        hit = F.coalesce(hit, F.lit(False))
        name, enforced = F.when(hit, F.lit(n)).otherwise(name), F.when(hit, F.lit(enforce)).otherwise(enforced)
    out = rows.withColumn("detected_by", name).withColumn("_enforced", enforced)
    if mask in rows.columns:
        out = out.withColumn(mask, F.when(F.col("_enforced"), F.transform(mask, lambda x: F.lit(False))).otherwise(F.col(mask)))
    out = out.withColumn(stop, F.when(F.col("_enforced"), F.col("detected_by")).otherwise(F.col(stop)))
    for n, _, _ in detections:
        out = out.withColumn(f"filter/{n}", F.coalesce((F.col("detected_by") == n).cast("int"), F.lit(0)))
    return out.drop("_enforced")


def loss_columns(tokens: DataFrame, mask_high: float = 0.2, mask_low: float = 0.2, adv_tau: float = 1.0, teacher_tau: float = 0.0, kl_tau: float = 1e-3) -> DataFrame:
    """Per token: probability and log probability deltas, masks, ratio, mismatch KL and loss.

    Columns in: trainer, inference, advantage, mask and, where teacher_tau is not 0, teacher. An advantage of 0 takes the
    low side.
    """
    t = tokens.withColumn("prob_delta", F.exp("trainer") - F.exp("inference"))
    t = t.withColumn("high", F.col("prob_delta") > mask_high).withColumn("low", F.col("prob_delta") < -mask_low)
    t = t.withColumn("invalid", F.when(F.col("advantage") > 0, F.col("high")).otherwise(F.col("low"))).withColumn("keep", F.col("mask") & ~F.col("invalid"))
    t = t.withColumn("delta", F.col("trainer") - F.col("inference")).withColumn("ratio", F.exp("delta")).withColumn("mismatch_kl", F.col("ratio") - F.col("delta") - 1)
    adv = F.col("advantage") * adv_tau
    if teacher_tau:
        adv = adv + teacher_tau * (F.col("teacher") - F.col("trainer"))
    return t.withColumn("loss", F.when(F.col("keep"), -adv * F.col("ratio")).otherwise(F.lit(0.0)) + F.when(F.col("mask"), kl_tau * F.col("delta") * F.col("delta")).otherwise(F.lit(0.0)))


def masked_mean(value: Column, mask: Column) -> Column:
    return F.coalesce(F.sum(F.when(mask, value)), F.lit(0.0)) / F.greatest(F.count_if(mask), F.lit(1))


def policy_loss(tokens: DataFrame, **config) -> DataFrame:
    """Loss and metrics of each sequence; one pass, one shuffle on the sequence with partial sums before it."""
    t = loss_columns(tokens, **config)
    m, bad, keep = F.col("mask"), F.col("mask") & F.col("invalid"), F.col("keep")
    one = lambda c: masked_mean(c.cast("double"), m)
    return t.groupBy("seq_id").agg(
        F.sum("loss").alias("loss"), masked_mean(F.col("mismatch_kl"), m).alias("mismatch_kl"), masked_mean(F.col("mismatch_kl"), bad).alias("masked_mismatch_kl"),
        masked_mean(F.col("mismatch_kl"), keep).alias("unmasked_mismatch_kl"), one(F.col("invalid")).alias("is_masked"), one(F.col("high") & (F.col("advantage") > 0)).alias("is_masked_high"),
        one(F.col("low") & (F.col("advantage") < 0)).alias("is_masked_low"), masked_mean(F.col("delta"), m).alias("logprob_delta"), masked_mean(F.col("prob_delta"), m).alias("prob_delta"), F.count_if(m).alias("n_tokens"),
    )


def batch_loss(sequences: DataFrame) -> DataFrame:
    """Sum of losses over the unmasked tokens of the batch, at least 1."""
    return sequences.agg((F.sum("loss") / F.greatest(F.sum("n_tokens"), F.lit(1))).alias("loss"), F.greatest(F.sum("n_tokens"), F.lit(1)).alias("loss_scale"))


def masked_nll(tokens: DataFrame) -> DataFrame:
    """Sum of -log probability under the mask and the mask's size, of each sequence."""
    return tokens.groupBy("seq_id").agg(F.coalesce(F.sum(F.when(F.col("mask"), -F.col("trainer"))), F.lit(0.0)).alias("nll"), F.count_if(F.col("mask")).alias("n_tokens"))


def top_mismatch(tokens: DataFrame, n: int, scope: str = "mask", key: str | None = None) -> DataFrame:
    """The tokens of the largest mismatch KL in a scope, over all or for each key."""
    t = tokens.where(F.col(scope))
    order = [F.desc("mismatch_kl"), "seq_id", "pos"]
    if key is None:
        return t.orderBy(*order).limit(n)
    return t.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def _leading(records: DataFrame, n: int, key: str) -> DataFrame:
    """The records that are among the first ``n`` of their key in GATHERED records or more: all that can be among the key's
    n, and few, so that not all records are sorted. The session's Arrow batches may be smaller."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= GATHERED:
                yield pa.concat_batches(held)
                held, rows = [], 0
        if held:
            yield pa.concat_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches):
            # as Spark orders them: null last, NaN above all
            kl, keys = b.column(b.schema.get_field_index("mismatch_kl")), b.column(b.schema.get_field_index(key))
            value = kl.to_numpy(zero_copy_only=False).astype("float64")
            value = np.where(pc.is_null(kl).to_numpy(zero_copy_only=False), -np.inf, np.where(np.isnan(value), np.inf, value))
            code = keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            kept = np.zeros(len(value), bool)
            for c in np.unique(code):
                own = np.flatnonzero(code == c)
                edge = np.partition(value[own], -n)[-n] if len(own) > n else -np.inf
                kept[own[value[own] > edge]] = True
                even = own[value[own] == edge]
                if len(even) > n and np.isfinite(edge):
                    seq, pos = (b.column(b.schema.get_field_index(c)).take(pa.array(even)) for c in ("seq_id", "pos"))
                    if not seq.null_count and not pos.null_count:
                        even = even[np.lexsort((pos.to_numpy(zero_copy_only=False), seq.to_numpy(zero_copy_only=False)))[:n]]
                kept[even] = True
            yield b.filter(pa.array(kept))

    return records.mapInArrow(run, records.schema)


def merged_top(records: DataFrame, n: int, rank: str) -> DataFrame:
    """The n records of the largest mismatch KL over all ranks: each rank's own n first, then the best of those."""
    return top_mismatch(top_mismatch(_leading(records.where("mask"), n, rank), n, "mask", rank), n)


def log_softmax_at(logits: Column, label: Column) -> Column:
    """Log probability at a label (from 0) of an array of logits."""
    top = F.array_max(logits)
    return F.element_at(logits, label + 1) - top - F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def entropy(logits: Column) -> Column:
    """lse - sum of p * logit."""
    top = F.array_max(logits)
    s = F.aggregate(logits, F.struct(F.lit(0.0).alias("z"), F.lit(0.0).alias("zx")), lambda a, x: F.struct((a["z"] + F.exp(x - top)).alias("z"), (a["zx"] + F.exp(x - top) * x).alias("zx")))
    return top + F.log(s["z"]) - s["zx"] / s["z"]


def reverse_kl(p_logits: Column, q_logits: Column) -> Column:
    """KL of softmax(p) from softmax(q): sum of p * (log p - log q)."""
    tp, tq = F.array_max(p_logits), F.array_max(q_logits)
    lp = tp + F.log(F.aggregate(p_logits, F.lit(0.0), lambda s, x: s + F.exp(x - tp)))
    lq = tq + F.log(F.aggregate(q_logits, F.lit(0.0), lambda s, x: s + F.exp(x - tq)))
    return F.aggregate(F.zip_with(p_logits, q_logits, lambda a, b: F.exp(a - lp) * ((a - lp) - (b - lq))), F.lit(0.0), lambda s, x: s + x)


def top_k(logprobs: Column, k: int) -> Column:
    """The k largest log probabilities, largest first."""
    return F.slice(F.sort_array(logprobs, asc=False), 1, k)


def shift(column: str, by: int, pad, key: str = "seq_id", order: str = "pos") -> Column:
    """Values moved left (by > 0) or right along a sequence, the gap filled with ``pad``."""
    w = Window.partitionBy(key).orderBy(order)
    return F.lead(column, by, pad).over(w) if by > 0 else F.lag(column, -by, pad).over(w)
