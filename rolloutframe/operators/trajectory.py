"""From trajectories to training samples: array expressions on one row a rollout, without Python and without a shuffle.

Which earlier step a prompt continues is looked up by hashes of prefixes. A token's hash covers its place, so a prefix's
hash is the exclusive or of its tokens' hashes; a prompt is hashed once, cut where the steps of its rollout end, and the
hashes at those cuts serve the comparisons with all of them. Where hashes agree the tokens are compared too, so equal
hashes of different prefixes cost time and change nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import let


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays."""
    shorter = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, F.greatest(shorter, F.lit(0))), F.slice(b, 1, F.greatest(shorter, F.lit(0))), lambda x, y: x == y)
    return let(F.array_position(same, F.lit(False)), lambda at: F.when(at > 0, at - 1).otherwise(shorter).cast("int"))


def extends(prompt: Column, prefix: Column) -> Column:
    """Whether a prompt strictly extends a stored prefix."""
    return (F.size(prompt) > F.size(prefix)) & (F.slice(prompt, 1, F.size(prefix)) == prefix)


def admission_trim(ids: Column, events: Column) -> Column:
    """Replays deletions of [evict_start, evict_start + tokens_evicted), each in the coordinates the ones before left."""
    cut = lambda acc, e: F.concat(F.slice(acc, 1, e["evict_start"]), F.slice(acc, e["evict_start"] + e["tokens_evicted"] + 1, F.size(acc)))
    return F.aggregate(events, ids, cut)


def lengths(prompts: Column, completions: Column) -> tuple[Column, Column, Column]:
    """(prompt, sequence, completion length) of a rollout from its steps' prompt and completion arrays: the first step's
    prompt, the last step's whole, and their difference."""
    prompt = F.size(F.element_at(prompts, 1))
    whole = F.size(F.element_at(prompts, -1)) + F.size(F.element_at(completions, -1))
    return prompt, whole, whole - prompt


def incremental_mask(sizes: Column, roles: Column, trainable: tuple[str, ...] = ("assistant",)) -> Column:
    """The mask of a conversation: each message's tokens take their role's mask."""
    return F.flatten(F.zip_with(sizes, roles, lambda n, r: F.array_repeat(r.isin(*trainable), n)))


def with_targets(ids: Column, mask: Column, eos: int) -> tuple[Column, Column, Column]:
    """(input ids, target ids, loss mask): the end token is appended if absent, targets are one step ahead."""
    full = F.when(F.array_contains(ids, F.lit(eos)), ids).otherwise(F.concat(ids, F.array(F.lit(eos))))
    m = F.when(F.array_contains(ids, F.lit(eos)), mask).otherwise(F.concat(mask, F.array(F.lit(True))))
    n = F.size(full) - 1
    return F.slice(full, 1, n), F.slice(full, 2, n), F.slice(m, 2, n)


def pad_rows(rows: Column, expected: Column, zero: Column) -> Column:
    """Appends zero rows up to an expected length."""
    return F.concat(rows, F.array_repeat(zero, F.greatest(expected - F.size(rows), F.lit(0))))


SAMPLE = {
    "rollout_id": "bigint", "sample_idx": "int", "step_ids": "array<int>", "prompt_ids": "array<int>", "completion_ids": "array<int>",
    "completion_mask": "array<boolean>", "completion_logprobs": "array<double>", "completion_temperatures": "array<double>",
}


def token_hash(place: Column, token: Column) -> Column:
    """Hash of a token at its place in a sequence."""
    return F.xxhash64(place.cast("int"), token)


def _xor(hashes: Column) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def with_prefix_index(rows: DataFrame, steps: str = "steps", token: Callable[[Column, Column], Column] = token_hash) -> DataFrame:
    """``rows`` with _ends, _hash, _cuts and _marks of the steps (structs with prompt_ids and completion_ids, neither null).

    _ends[i] is where step i ends (its prompt and completion), _hash[i] the hash of all that, _cuts the different ends in
    order, and _marks[j][k] the hash of the first _cuts[k] tokens of prompt j, null where it is not longer than that.
    """
    after = lambda s: F.transform(s["completion_ids"], lambda x, i: token(i + F.size(s["prompt_ids"]), x))
    rows = rows.withColumn("_tokens", F.transform(steps, lambda s: F.transform(s["prompt_ids"], lambda x, i: token(i, x))))
    rows = rows.withColumn("_ends", F.transform(steps, lambda s: F.size(s["prompt_ids"]) + F.size(s["completion_ids"])))
    rows = rows.withColumn("_cuts", F.array_sort(F.array_distinct("_ends")))
    rows = rows.withColumn("_hash", F.transform(steps, lambda s, i: _xor(F.get("_tokens", i)).bitwiseXOR(_xor(after(s)))))

    def marks(t: Column) -> Column:
        begin = lambda k: F.coalesce(F.get("_cuts", k - 1), F.lit(0))
        pieces = F.transform(F.filter("_cuts", lambda c: c < F.size(t)), lambda c, k: _xor(F.slice(t, begin(k) + 1, c - begin(k))))
        # exclusive or of all pieces so far; the last one is carried at the end of the list
        return F.aggregate(pieces, F.array().cast("array<bigint>"), lambda a, x: F.concat(a, F.array(x.bitwiseXOR(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0).cast("long"))))))

    return rows.withColumn("_marks", F.transform("_tokens", marks)).drop("_tokens")


def continues(i: Column, j: Column, steps: str = "steps") -> Column:
    """Whether the prompt of step j strictly extends prompt and completion of step i; needs ``with_prefix_index``."""
    one, other, end = F.get(steps, i), F.get(steps, j), F.get("_ends", i)
    mark = F.get(F.get("_marks", j), F.array_position("_cuts", end).cast("int") - 1)
    same = F.slice(other["prompt_ids"], 1, end) == F.concat(one["prompt_ids"], one["completion_ids"])
    return F.when(F.coalesce(mark == F.get("_hash", i), F.lit(False)), same).otherwise(F.lit(False))


def prefix_pairs(sequences: DataFrame, key: str, order: str, ids: str, token: Callable[[Column, Column], Column] = token_hash) -> DataFrame:
    """(key, prefix, step): the pairs of sequences of a key, by their order, of which the later one strictly extends the
    earlier one. Sequences of a key come together in one row, as the steps of a rollout do; null ones have no pairs."""
    step = F.struct(F.col(order).alias("order"), F.col(ids).alias("prompt_ids"), F.array().cast(dict(sequences.dtypes)[ids]).alias("completion_ids"))
    rows = sequences.where(F.col(ids).isNotNull() & F.col(order).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(step), _by("order")).alias("steps"))
    rows = with_prefix_index(rows, token=token)
    order_of = lambda i: F.get("steps", i)["order"]
    earlier = lambda j: F.filter(F.sequence(F.lit(0), j), lambda i: (order_of(i) < order_of(j)) & continues(i, j))
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.size("steps") - 1), lambda j: F.transform(earlier(j), lambda i: F.struct(order_of(i).alias("prefix"), order_of(j).alias("step")))))
    return rows.select(key, F.explode(pairs).alias("_pair")).select(key, "_pair.prefix", "_pair.step")


def _by(field: str) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.when(a[field] < b[field], -1).when(a[field] > b[field], 1).otherwise(0)


def _sample_steps() -> Column:
    """The samples of a rollout, in the order in which they begin: each the numbers of its steps. A sample holds all that
    its last step's prompt and completion hold, so whether it is continued depends on that step alone."""

    def place(samples: Column, j: Column) -> Column:
        first = F.when(~F.get("_apart", j), F.array_min(F.transform(samples, lambda s, n: F.when(continues(F.element_at(s, -1), j), n))))
        put = lambda at: F.when(at.isNull(), F.concat(samples, F.array(F.array(j)))).otherwise(F.transform(samples, lambda s, n: F.when(n == at, F.concat(s, F.array(j))).otherwise(s)))
        return F.get(F.transform(F.array(first), put), F.lit(0))

    return F.aggregate(F.sequence(F.lit(0), F.size("steps") - 1), F.array().cast("array<array<int>>"), place)


def interleave(rollouts: DataFrame, token: Callable[[Column, Column], Column] = token_hash) -> DataFrame:
    """Samples of rollouts: rollout_id, error (boolean), temperature, steps (array of structs step_idx, prompt_ids,
    completion_ids, completion_mask, completion_logprobs and, where there is any, midgen).

    A step joins the first sample, in the order in which they began, whose tokens are a strict prefix of the step's
    prompt; what the prompt adds is untrained, with logprob 0. A step with an event inside its generation never joins.
    An errored rollout trains nothing. Rollouts without a step, or with a step without tokens, are dropped. One row holds
    a rollout, so nothing is shuffled.
    """
    good = rollouts.where((F.size("steps") > 0) & F.forall("steps", lambda s: s["prompt_ids"].isNotNull() & s["completion_ids"].isNotNull()))
    fields = rollouts.schema["steps"].dataType.elementType.fieldNames()
    apart = lambda s: F.coalesce(s["midgen"].cast("boolean"), F.lit(False)) if "midgen" in fields else F.lit(False)
    rows = good.select("rollout_id", F.coalesce(F.col("error").cast("boolean"), F.lit(False)).alias("_error"), F.col("temperature").alias("_temperature"), F.array_sort("steps", _by("step_idx")).alias("steps"))
    rows = with_prefix_index(rows, token=token).withColumn("_apart", F.transform("steps", apart))
    rows = rows.select("rollout_id", "_error", "_temperature", "steps", "_ends", F.posexplode(_sample_steps()).alias("sample_idx", "_of"))
    first, last = F.get("steps", F.get("_of", F.lit(0))), F.get("steps", F.element_at("_of", -1))
    prompt = F.size(first["prompt_ids"])
    step = lambda j: F.get("steps", j)
    # how many tokens of a step's prompt are new to its sample
    added = lambda j, n: F.when(n == 0, F.lit(0)).otherwise(F.size(step(j)["prompt_ids"]) - F.get("_ends", F.get("_of", n - 1)))
    joined = lambda blank, own: F.flatten(F.transform("_of", lambda j, n: F.concat(F.array_repeat(blank, added(j, n)), own(step(j)))))
    whole = F.concat(last["prompt_ids"], last["completion_ids"])
    out = {
        "rollout_id": F.col("rollout_id"),
        "sample_idx": F.col("sample_idx"),
        "step_ids": F.transform("_of", lambda j: step(j)["step_idx"]),
        "prompt_ids": first["prompt_ids"],
        "completion_ids": F.slice(whole, prompt + 1, F.size(whole) - prompt),
        "completion_mask": joined(F.lit(False), lambda s: F.transform(s["completion_mask"], lambda x: F.coalesce(x, F.lit(False)) & ~F.col("_error"))),
        "completion_logprobs": joined(F.lit(0.0), lambda s: s["completion_logprobs"].cast("array<double>")),
        "completion_temperatures": F.array_repeat(F.col("_temperature"), F.size(whole) - prompt),
    }
    return rows.select(*[c.cast(SAMPLE[n]).alias(n) for n, c in out.items()])
