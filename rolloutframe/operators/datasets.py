"""Datasets: provenance, interleaving, sampling, sharding, message handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import uniform
from .ordering import numbered, running_sum


def with_provenance(rows: DataFrame, subset: str | None, split: str, order: list[str], by: str | None = None) -> DataFrame:
    """Adds __subset, __split and __index, the row number from 0 in a total order; with ``by``, a column, its values are
    the subsets, each with numbers of its own."""
    if by is not None:
        return numbered(rows.withColumn("__subset", F.col(by)), order, "__index", ("__subset",)).withColumn("__split", F.lit(split))
    return numbered(rows, order, "__index").withColumn("__subset", F.lit(subset).cast("string")).withColumn("__split", F.lit(split))


def resolve_subsets(subsets: list[str] | None, splits: list[str] | None) -> list[tuple[str | None, str]]:
    """(subset, split) pairs: neither gives (None, train); subsets alone the train split; splits alone no subset; both pair up."""
    if not subsets and not splits:
        return [(None, "train")]
    if not splits:
        return [(s, "train") for s in subsets]
    if not subsets:
        return [(None, s) for s in splits]
    if len(subsets) != len(splits):
        raise ValueError("subsets and splits must have one length")
    return list(zip(subsets, splits, strict=True))


def subset_pairs(subsets: DataFrame) -> DataFrame:
    """``subsets`` (column __subset) with the split that resolve_subsets() gives to subsets alone."""
    return subsets.withColumn("__split", F.lit(resolve_subsets(["any"], None)[0][1]))


def number(rows: DataFrame, source: str, order: list[str]) -> DataFrame:
    """Adds _i, the row number of a source from 0; a source of any size is dealt to many tasks."""
    return numbered(rows, order, "_i", (source,))


def interleave_first(rows: DataFrame, source: str, order: list[str]) -> DataFrame:
    """Round-robin over sources until the shortest ends; position is the row's place in the result."""
    n = number(rows, source, order)
    sizes = rows.groupBy(source).agg(F.count("*").alias("n"))
    least = sizes.agg(F.min("n").alias("least"), F.count("*").alias("k"))
    rank = sizes.withColumn("_s", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(source)) - 1).select(source, "_s")
    out = n.join(F.broadcast(rank), source).join(F.broadcast(least)).where(F.col("_i") < F.col("least"))
    return out.withColumn("position", F.col("_i") * F.col("k") + F.col("_s")).drop("_i", "_s", "least", "k")


def interleave_all(rows: DataFrame, source: str, order: list[str]) -> DataFrame:
    """Round-robin until the longest source ends; shorter ones start again. Each row says at which turns it comes, so the
    result is one explode of the rows and no join on positions. A single source passes through in its order."""
    n = number(rows, source, order)
    sizes = rows.groupBy(source).agg(F.count("*").alias("n"))
    rank = sizes.withColumn("_s", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(source)) - 1)
    most = sizes.agg(F.max("n").alias("most"), F.count("*").alias("k"))
    out = n.join(F.broadcast(rank), source).join(F.broadcast(most))
    turns = F.sequence(F.col("_i").cast("long"), F.col("most") - 1, F.col("n"))
    return out.withColumn("_t", F.explode(turns)).withColumn("position", F.col("_t") * F.col("k") + F.col("_s")).drop("_i", "_s", "n", "most", "k", "_t")


def interleave_weighted(rows: DataFrame, source: str, order: list[str], probabilities: dict[str, float], draws: int | DataFrame, seed: int = 0) -> DataFrame:
    """A position for each of ``draws`` (a number, or rows with a column position), each of a source by hashed chance; a
    source gives its rows in order, wrapping around. Positions of a source without rows are left out."""
    names = sorted(probabilities)
    total, upto, run = sum(probabilities.values()), [], 0.0
    for k in names:
        run += probabilities[k] / total
        upto.append(run)
    u = uniform(F.col("position"), seed)
    pick = F.lit(names[-1])
    for k, hi in reversed(list(zip(names, upto, strict=True))[:-1]):
        pick = F.when(u < hi, F.lit(k)).otherwise(pick)
    at = rows.sparkSession.range(draws).withColumnRenamed("id", "position") if isinstance(draws, int) else draws.select("position")
    d = numbered(at.withColumn(source, pick), ["position"], "_c", (source,))
    sizes = rows.groupBy(source).agg(F.count("*").alias("_n"))
    d = d.join(F.broadcast(sizes), source).withColumn("_i", F.pmod(F.col("_c"), F.col("_n")))
    return number(rows, source, order).join(d, [source, "_i"]).drop("_i", "_c", "_n")


def rank_shard(index: Column, rank: int, world: int) -> Column:
    """Whether a row, counted from 0, belongs to a rank."""
    return F.pmod(index, F.lit(world)) == rank


def epoch(step: Column, n: int | Column) -> tuple[Column, Column]:
    """(epoch, index) of a step from 1 over n rows; null without rows."""
    rows = F.nullif(n if isinstance(n, Column) else F.lit(n), F.lit(0))
    return F.floor((step - 1) / rows).cast("long"), F.pmod(step - 1, rows)


def shuffled(rows: DataFrame, index: str, seed: int, name: str = "place") -> DataFrame:
    """The rows with their place, from 0, in a reproducible random order of a seed."""
    h = F.md5(F.concat(F.col(index).cast("string"), F.lit(f"-{seed}")))
    out = places(rows.withColumn("_h", h).withColumn("_bucket", F.substring("_h", 1, 3)), ["_bucket"], ["_h", index])
    return out.drop("_h", "_bucket").withColumnRenamed("place", name)


def sample_examples(draws: DataFrame, examples: DataFrame, order: list, seed: int = 0, draw: str = "draw") -> DataFrame:
    """For each draw one of the examples, all alike, with replacement: the one whose number a hash of the draw names."""
    n = numbered(examples, order, "_i")
    size = examples.agg(F.count("*").alias("_n"))
    at = F.floor(uniform(F.col(draw), seed) * F.col("_n")).cast("long")
    return draws.join(F.broadcast(size)).withColumn("_i", at).join(n, "_i").drop("_i", "_n")


def _random_ids(key: Column, length: Column | int, vocab: int, seed: int) -> Column:
    """``length`` token ids below vocab, decided by key, place and seed; none for a length of 0."""
    length = F.lit(length) if isinstance(length, int) else length
    ids = F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(length, F.lit(1)).cast("long")), lambda k: F.floor(uniform(F.concat_ws(":", key, k - 1), seed) * vocab).cast("int"))
    return F.slice(ids, 1, F.greatest(length, F.lit(0)).cast("int"))


def fake_batches(rows: DataFrame, order: list, ranks: int, size: int, seq_len: int, vocab: int = 120_000) -> DataFrame:
    """rank, batch, i, seed, input_ids: made-up micro-batches in place of ``rows``, dealt in order to ranks and, there, to
    batches of ``size``; a seed is rank * 1e6 + batch * 1e3 + i and decides the ids. All other columns go."""
    d = dealt(rows.select(*order), order, ranks)
    rank, batch, i = F.col("worker").cast("long"), F.floor(F.col("slot") / size).cast("long"), F.pmod("slot", F.lit(size))
    d = d.select(rank.alias("rank"), batch.alias("batch"), i.alias("i"), (rank * 1_000_000 + batch * 1_000 + i).alias("seed"))
    return d.withColumn("input_ids", _random_ids(F.col("seed"), seq_len, vocab, 0))


def places(rows: DataFrame, buckets: list[str], order: list[str]) -> DataFrame:
    """Adds place, each row's number from 0 in the order of buckets and then of order. Rows are numbered within their
    bucket; the one ordered window over everything sees a row for each bucket."""
    sizes = rows.groupBy(*buckets).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(b).alias(f"_{b}") for b in buckets], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    n = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*buckets).orderBy(*order)) - 1)
    out = n.join(starts, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in buckets])
    return out.withColumn("place", F.col("_start") + F.col("_i")).drop("_i", "_start", *[f"_{b}" for b in buckets])


def log_sample(rows: DataFrame, ratio: float | None, key: str, seed: int = 0) -> DataFrame:
    """All rows for no ratio or one of at least 1, none for one of at most 0, else max(1, int(n * ratio)) of them."""
    if ratio is None or ratio >= 1:
        return rows
    if ratio <= 0:
        return rows.where(F.lit(False))
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))), key).limit(max(1, int(rows.count() * ratio)))


def collapse_tools(messages: DataFrame, key: str, order: str) -> DataFrame:
    """Without those tool messages that another tool message follows directly."""
    after = F.lead("role").over(Window.partitionBy(key).orderBy(order))
    return messages.withColumn("_after", after).where(~((F.col("role") == "tool") & F.coalesce(F.col("_after") == "tool", F.lit(False)))).drop("_after")


def generation_prompt(key: str, order: str) -> Column:
    """Whether the assistant speaks next."""
    return F.coalesce(F.lead("role").over(Window.partitionBy(key).orderBy(order)) == "assistant", F.lit(False))


def trainable(role: Column, roles: tuple[str, ...] = ("assistant",), known: tuple[str, ...] = ("system", "user", "assistant", "tool")) -> Column:
    """Whether a role's tokens are trained; an unknown role is an error."""
    return F.when(role.isin(*known), role.isin(*roles)).otherwise(F.raise_error(F.concat(F.lit("unknown role "), role)).cast("boolean"))


def first_seen(rows: DataFrame, key: str, position: str) -> DataFrame:
    """key and its index in first-seen order, from 0."""
    g = rows.groupBy(key).agg(F.min(position).alias("_p"))
    return numbered(g, ["_p", key], "index").drop("_p")


def dual_prompts(rows: DataFrame, prompt: str, truth: str, template: str) -> DataFrame:
    """Each row twice: as it is, and privileged, with {prompt} and {ground_truth} filled into the template."""
    private = F.replace(F.replace(F.lit(template), F.lit("{prompt}"), F.col(prompt)), F.lit("{ground_truth}"), F.col(truth))
    both = F.array(F.struct(F.lit(False).alias("privileged"), F.col(prompt).alias("text")), F.struct(F.lit(True).alias("privileged"), private.alias("text")))
    return rows.withColumn("_x", F.explode(both)).select("*", "_x.privileged", "_x.text").drop("_x")


def example_source(rows: DataFrame, prompt: str, order: list, example_id: str | None = None) -> DataFrame:
    """Rows with a prompt, and example_id: the given column, else the row number in ``order``."""
    good = rows.where(F.col(prompt).isNotNull())
    return good.withColumn("example_id", F.col(example_id)) if example_id else numbered(good, order, "example_id")


def head(rows: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows in order; all of them for -1."""
    return rows if n < 0 else rows.orderBy(*order).limit(n)


def fake_samples(rows: DataFrame, sample: str, seq_len: int, vocab: int = 120_000, *, kind: str = "increasing", length: str = "fixed", seed: int = 0) -> DataFrame:
    """sample, ids, mask: a made-up sample for each row, all of it trained. kind: ids count up from 0, modulo vocab, or
    are random; length: seq_len, or random from 1 to seq_len. The column ``sample`` decides all draws."""
    if kind not in ("increasing", "random") or length not in ("fixed", "variable"):
        raise ValueError(f"no samples of {kind} ids and {length} length")
    n = F.lit(seq_len) if length == "fixed" else (1 + F.floor(uniform(F.concat(F.col(sample).cast("string"), F.lit(":n")), seed) * seq_len)).cast("int")
    counting = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda k: F.pmod(k, F.lit(vocab)))
    ids = counting if kind == "increasing" else _random_ids(F.col("sample"), F.col("_n"), vocab, seed)
    out = rows.select(F.col(sample).alias("sample"), n.alias("_n")).withColumn("ids", ids)
    return out.select("sample", "ids", F.transform("ids", lambda x: F.lit(True)).alias("mask"))


def task_prompt(task: Column, index: Column, question: Column) -> tuple[Column, Column]:
    """(id, prompt) of a reasoning task's row."""
    return F.concat_ws("_", task, index), F.concat(F.lit("Task "), task, F.lit(": "), question)


def shorter(length: Column, most: int) -> Column:
    """Whether a sample is kept: at most ``most`` tokens."""
    return length <= most


def cyclic(offset: int, j: Column, n: Column) -> Column:
    """The j-th index of a dataset that begins again after n rows, from an offset on; null without rows."""
    return F.pmod(j + offset, F.nullif(n, F.lit(0)))


def dealt(rows: DataFrame, order: list, workers: int) -> DataFrame:
    """worker and slot of every row, dealt in order: worker i % workers, slot i div workers."""
    n = numbered(rows, order, "_at")
    return n.withColumn("worker", F.pmod("_at", F.lit(workers))).withColumn("slot", F.floor(F.col("_at") / workers).cast("long")).drop("_at")


def ordered_concat(rows: DataFrame, kind: Column, order: list) -> DataFrame:
    """Rows with their place, from 0, one kind after another."""
    return numbered(rows.withColumn("_kind", kind), ["_kind", *order]).drop("_kind")


def expert_sort(rows: DataFrame, expert: str, order: list, block: Column) -> DataFrame:
    """Token-expert rows with their place in the order of experts, stable in ``order``; ``block`` cuts an expert's rows
    into runs of the order."""
    return places(rows.withColumn("_block", block), [expert, "_block"], order).drop("_block")


def top_experts(scores: Column, bias: Column, k: int) -> Column:
    """The k experts of the largest biased scores with their own scores, ties to the smaller number."""
    both = F.transform(F.arrays_zip(scores.alias("s"), bias.alias("b")), lambda x, i: F.struct((-(x["s"] + x["b"])).alias("o"), i.alias("expert"), x["s"].alias("score")))
    return F.transform(F.slice(F.array_sort(both), 1, k), lambda x: F.struct(x["expert"].alias("expert"), x["score"].alias("score")))


def packed_chunk(position: Column, window) -> Column:
    """The number of the sequence that a token of a packed row belongs to: one begins where the position is 0 after
    another value and 1 follows."""
    begins = (position == 0) & (F.coalesce(F.lag(position).over(window), F.lit(1)) != 0) & (F.coalesce(F.lead(position).over(window), F.lit(-1)) == 1)
    return begins


def split_packed(rows: DataFrame, key: str, order: str, begins: Column, value: str) -> DataFrame:
    """key, chunk, values of the chunks that begin where ``begins``, values in order."""
    w = Window.partitionBy(key).orderBy(order)
    chunks = rows.withColumn("chunk", F.sum(begins.cast("int")).over(w))
    return chunks.groupBy(key, "chunk").agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("_v")).select(key, "chunk", F.col(f"_v.{value}").alias("values"))


def prefix_offset(rows: DataFrame, keys: list[str], order: list[str], value: Column, inclusive: bool = False) -> Column:
    """The sum of ``value`` over a key's rows before this one (and it, if inclusive)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def prefix_sums(rows: DataFrame, keys: tuple[str, ...], order: list, value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over a key's rows before each; a key may hold any share of the rows."""
    return running_sum(rows, order, value, name, keys, inclusive=False)


def key_union(*tables: DataFrame) -> DataFrame:
    """The distinct keys of several one-column tables."""
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out.distinct()


def labelled_union(kind: str = "kind", **parts: DataFrame) -> DataFrame:
    """Several tables of the same columns as one, with the name of each as ``kind``."""
    out = None
    for name, part in parts.items():
        own = part.withColumn(kind, F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def distinct_images(uses: DataFrame, image: Column, first: str) -> DataFrame:
    """image, uses, first of every distinct image."""
    return uses.groupBy(image.alias("image")).agg(F.count("*").alias("uses"), F.min(first).alias("first"))


def to_columns(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The rows of each key as one row of lists."""
    x = rows.groupBy(key).agg(F.collect_list(F.struct(*columns)).alias("_x"))
    return x.select(key, *[F.col(f"_x.{c}").alias(c) for c in columns])


def to_rows(columns_: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The inverse of to_columns."""
    return columns_.select(key, F.explode(F.arrays_zip(*columns)).alias("_x")).select(key, *[F.col(f"_x.{c}").alias(c) for c in columns])
