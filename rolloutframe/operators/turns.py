"""Block-aligned conversations with synthetic turn eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the filler token.
FILLER = 151643


def pad_after_end(ids: Column, end: int, block: int, start: Column | int = 0, filler: int = FILLER) -> Column:
    """``ids`` with fillers behind each end token up to the next multiple of ``block``, counted from ``start`` tokens."""
    n = F.size(ids)
    at = F.when(n > 0, F.filter(F.transform(ids, lambda x, i: F.when(x == end, i + 1)), lambda p: p.isNotNull())).otherwise(F.array().cast("array<int>"))
    cuts = F.concat(F.array(F.lit(0)), at, F.when(F.coalesce(F.element_at(F.concat(F.array(F.lit(0)), at), -1), F.lit(0)) < n, F.array(n)).otherwise(F.array().cast("array<int>")))
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.size(cuts) - 1, F.lit(1))), lambda k: F.struct(F.get(cuts, k - 1).alias("a"), F.coalesce(F.get(cuts, k), F.lit(0)).alias("b")))
    start = F.lit(start).cast("int") if isinstance(start, int) else start.cast("int")
    none = F.struct(start.alias("total"), F.array().cast("array<int>").alias("pads"))

    def step(s: Column, p: Column) -> Column:
        total = s["total"] + p["b"] - p["a"]
        pad = F.when((p["b"] > 0) & (F.get(ids, p["b"] - 1) == end), F.pmod(-total, F.lit(block))).otherwise(F.lit(0))
        return F.struct((total + pad).cast("int").alias("total"), F.concat(s["pads"], F.array(pad.cast("int"))).alias("pads"))

    pads = F.aggregate(pieces, none, step)["pads"]
    return F.flatten(F.zip_with(pieces, pads, lambda p, k: F.concat(F.slice(ids, p["a"] + 1, p["b"] - p["a"]), F.array_repeat(F.lit(filler), k))))


def turn_eviction(conversations: DataFrame, max_turns: int, stride: int, block: int, end: int, protected: int = 0, key: str = "conv_id") -> DataFrame:
    """key, ids, mask, calls of conversations whose cache keeps at most ``max_turns`` turns.

    ``conversations``: key, turns (user_ids, of the first one everything in front of the first answer; completion_ids;
    trainable). A turn that comes when the cache is full first evicts the ``stride`` oldest ones behind the protected
    prefix, which ends at the block of the first end token unless its length is given; without an end token nothing is
    protected. A turn's own tokens are padded to a block. One without a turn is dropped.

    Which turns go is fixed by their numbers: with w = min(stride, max_turns), turn max_turns + k * w evicts the turns
    from k * w on, w of them. So all tokens are laid out once, and the cache that a call sees is two slices of them: the
    protected prefix, and what begins behind the last evicted turn. All are array expressions on one row.
    """
    w = min(stride, max_turns)
    fill = lambda ids, n: F.concat(ids, F.array_repeat(F.lit(FILLER), n))
    each = lambda f: F.transform(F.sequence(F.lit(0), F.size("turns") - 1), f)
    c = conversations.where(F.size("turns") > 0).select(key, "turns", F.transform("turns", lambda t: pad_after_end(t["user_ids"], end, block)).alias("_front"))
    guard = F.ceil(F.array_position(F.get("_front", F.lit(0)), end) / block) * block
    c = c.withColumn("_guard", (F.lit(protected) if protected else guard).cast("int"))
    # the eviction at a turn: its number, or null
    nth = lambda i: F.when((i >= max_turns) & (F.pmod(i - max_turns, F.lit(w)) == 0), F.floor((i - max_turns) / w).cast("int"))
    answer = lambda i: F.get("turns", i)["completion_ids"]
    # a length beside the blocks goes round with every max_turns // w evictions, if the guard is not of whole blocks
    odd = lambda i: F.when(F.pmod(nth(i), F.lit(max(max_turns // w, 1))) == 0, F.col("_guard")).otherwise(F.lit(0))
    c = c.withColumn("_pad", each(lambda i: F.pmod(-(F.size(F.get("_front", i)) + F.size(answer(i)) + odd(i)), F.lit(block))))
    c = c.withColumn("_whole", each(lambda i: fill(F.concat(F.get("_front", i), answer(i)), F.get("_pad", i))))
    # where each turn begins among all tokens
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    c = c.withColumn("_at", F.aggregate("_whole", none, lambda s, x: F.struct((s["at"] + F.size(x)).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")))["all"])
    c = c.withColumn("ids", F.flatten("_whole"))
    gone = lambda i: F.when(i >= max_turns, w * (F.floor((i - max_turns) / w).cast("int") + 1)).otherwise(F.lit(0))
    # the first token behind the protected prefix and the turns that are gone
    behind = lambda e: F.when(e == 0, F.col("_guard")).otherwise(F.get("_at", e))

    def call(i: Column) -> Column:
        before = gone(i - 1)
        event = nth(i).isNotNull()
        size = F.when(event, behind(gone(i)) - behind(before)).otherwise(F.lit(0))
        front = F.size(F.get("_front", i))
        begin = behind(before)
        seen = F.concat(F.slice("ids", F.lit(1), F.col("_guard")), F.slice("ids", begin + 1, F.greatest(F.get("_at", i) + front - begin, F.lit(0))))
        only = lambda x, other: F.when(event, x).otherwise(F.lit(other)).cast("int")
        fields = {
            "submitted_prompt_ids": F.when(i == 0, F.get("_front", i)).otherwise(seen), "completion_ids": answer(i), "trailing_pad": F.get("_pad", i).cast("int"), "tokens_evicted": size.cast("int"),
            "position_offset_after": (behind(gone(i)) - F.col("_guard")).cast("int"), "num_prompt_tokens": (F.when(i == 0, front).otherwise(F.size(seen)) - size).cast("int"), "evict_start": only(F.col("_guard"), 0),
            "new_user_fragment_len": only(F.greatest(F.lit(1), front), 0), "last_turn_evicted": only(F.lit(w - 1), -1), "num_turns_evicted_after": only(F.lit(w), 0),
        }
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    trained = each(lambda i: F.concat(F.array_repeat(F.lit(False), F.size(F.get("_front", i))), F.array_repeat(F.get("turns", i)["trainable"], F.size(answer(i))), F.array_repeat(F.lit(False), F.get("_pad", i))))
    return c.select(key, "ids", F.flatten(trained).alias("mask"), each(call).alias("calls"))
