"""Compaction events and the calls that carry them: wire forms, clamping, predicates, deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import let

# The fields of an event in the order of its array form, with types and defaults; the first three are required.
FIELDS = (
    ("num_output_tokens_at_compaction", "int", None),
    ("tokens_evicted", "int", None),
    ("position_offset_after", "int", None),
    ("num_prompt_tokens", "int", 0),
    ("evict_start", "int", 0),
    ("new_user_fragment_len", "int", 0),
    ("kept_indices", "array<int>", None),
    ("kept_token_ids", "array<int>", None),
    ("last_turn_evicted", "int", -1),
    ("num_turns_evicted_after", "int", 0),
    ("archived_span_ids", "array<string>", None),
    ("archived_span_bounds", "array<int>", None),
    ("event_kind", "int", 0),
    ("restored_span_ids", "array<string>", None),
    ("visibility_boundary_computed", "int", -1),
    ("restored_span_token_ids", "array<int>", None),
    ("restored_span_pos_start", "int", -1),
)
REQUIRED = 3
WIRE = "struct<" + ", ".join(f"{n}: {t}" for n, t, _ in FIELDS) + ">"


def as_int(text: Column) -> Column:
    """A JSON number or numeric text as an int, towards zero; null for anything else."""
    return text.try_cast("double").try_cast("int")


def _typed(text: Column, kind: str, default) -> Column:
    if kind == "int":
        return F.coalesce(as_int(text), F.lit(default)) if default is not None else as_int(text)
    items = F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
    return F.transform(items, as_int) if kind == "array<int>" else items


def coerce(raw: Column, strict: bool = True, fields: int = len(FIELDS)) -> Column:
    """array<WIRE> of a JSON array of events, null where none is left.

    An event is an object, or an array of at least REQUIRED values in the order of FIELDS; shorter arrays and other
    values are left out, missing fields take their defaults. An object without a required field is an error, or is left
    out where not ``strict``. Only the first ``fields`` fields are read.
    """

    def read(x: Column) -> Column:
        listed, named = x.startswith("["), x.startswith("{")
        return F.struct(listed.alias("listed"), named.alias("named"), F.from_json(F.when(listed, x), "array<string>").alias("at"), F.from_json(F.when(named, x), "map<string,string>").alias("of"))

    def texts(r: Column) -> Column:
        text = [F.when(r["listed"], F.get(r["at"], F.lit(i))).otherwise(F.try_element_at(r["of"], F.lit(n))).alias(n) for i, (n, _, _) in enumerate(FIELDS)]
        return F.struct(r["listed"].alias("listed"), r["named"].alias("named"), (F.size(r["at"]) >= REQUIRED).alias("long"), F.struct(*text).alias("text"))

    def one(t: Column) -> Column:
        cols = [_typed(t["text"][name] if i < fields else F.lit(None).cast("string"), kind, default).alias(name) for i, (name, kind, default) in enumerate(FIELDS)]
        whole = F.lit(True)
        for name, _, _ in FIELDS[:REQUIRED]:
            whole &= as_int(t["text"][name]).isNotNull()
        good = (t["listed"] & t["long"] & whole) | (t["named"] & whole)
        event = F.when(good, F.struct(*cols))
        return F.when(t["named"] & ~whole, F.raise_error(F.lit("an event lacks a required field")).cast(WIRE)).otherwise(event) if strict else event

    # a step for each: an item is parsed once, not once for each of its fields
    items = F.transform(F.transform(F.transform(F.from_json(raw, "array<string>"), read), texts), one)
    return let(F.filter(items, lambda e: e.isNotNull()), lambda out: F.when(F.size(out) > 0, out))


def clamp(events: Column, length: Column) -> Column:
    """The events at or before ``length`` completion tokens; null where none is left."""
    kept = F.filter(events, lambda e: e["num_output_tokens_at_compaction"] <= length)
    return F.when(F.size(kept) > 0, kept)


def inside_generation(events: Column) -> Column:
    """Whether an event falls inside the generation."""
    return F.coalesce(F.exists(events, lambda e: e["num_output_tokens_at_compaction"] > 0), F.lit(False))


def calls_inside_generation(calls: Column) -> Column:
    """Whether an event of any call falls inside its generation."""
    return F.coalesce(F.exists(calls, lambda c: inside_generation(c["compaction_events"])), F.lit(False))


def standard_stackable(images: Column, routed: Column, events: Column, prompt_len: Column, calls: Column, **mode: bool) -> Column:
    """Whether a micro-batch can be stacked as plain text. mode: compaction, cp, lora, multi_run of the trainer, each of
    which rules it out; so does any side information on the batch."""
    none = F.coalesce(F.size(events), F.lit(0)) <= 0
    return F.lit(not any(mode.values())) & images.isNull() & routed.isNull() & none & prompt_len.isNull() & calls.isNull()


def flex_stackable(images: Column, routed: Column, calls: Column, *, compaction: bool, flex: bool, cp: bool = False, lora: bool = False, multi_run: bool = False) -> Column:
    """Whether a micro-batch with calls can be replayed in a batch: it has calls, none with an event inside generation."""
    some = F.coalesce(F.size(calls), F.lit(0)) > 0
    return F.lit(compaction and flex and not (cp or lora or multi_run)) & images.isNull() & routed.isNull() & some & ~calls_inside_generation(calls)


def completion_delta(prompt: Column, full: Column) -> Column:
    """What ``full`` adds to ``prompt``; an error where the prompt is no prefix of it."""
    n = F.size(prompt)
    rest = F.slice(full, n + 1, F.greatest(F.size(full) - n, F.lit(0)))
    return F.when(F.slice(full, 1, n) == prompt, rest).otherwise(F.raise_error(F.lit("the prompt is no prefix of the whole")).cast("array<int>"))


def trim_last_call(calls: Column, tokens: Column) -> Column:
    """``calls`` with the last one's completion shorter by ``tokens`` and without trailing padding; unchanged for 0."""
    last = F.size(calls) - 1

    def cut(c: Column) -> Column:
        keep = F.greatest(F.size(c["completion_ids"]) - tokens, F.lit(0))
        for name in ("completion_ids", "completion_logprobs", "completion_temperatures"):
            c = c.withField(name, F.slice(c[name], 1, keep))
        return c.withField("trailing_pad_ids", F.slice(c["trailing_pad_ids"], 1, 0))

    return F.when(tokens > 0, F.transform(calls, lambda c, i: F.when(i == last, cut(c)).otherwise(c))).otherwise(calls)


def _numbers(payload: Column, name: str, number) -> Column:
    """A list of the payload; null where an item is no number."""
    items = F.coalesce(F.from_json(F.get_json_object(payload, f"$.{name}"), "array<string>"), F.array().cast("array<string>"))
    out = F.transform(items, number)
    return F.when(F.forall(out, lambda x: x.isNotNull()), out)


def summary_samples(steps: DataFrame) -> DataFrame:
    """A sample of its own for every step whose extras hold a summary payload.

    Columns in: rollout_id, step_idx, extras (JSON), error, temperature. Payloads without prompt or completion tokens,
    with other numbers of logprobs than tokens, or with items that are no numbers give no sample. The whole completion is
    trained unless the rollout failed; events that cannot be read are left out.
    """
    payload = F.get_json_object("extras", "$.summary_trainsample")
    s = steps.withColumn("_p", payload).where(F.col("_p").startswith("{"))
    s = s.withColumn("prompt_ids", _numbers(F.col("_p"), "prompt_token_ids", as_int)).withColumn("completion_ids", _numbers(F.col("_p"), "completion_token_ids", as_int)).withColumn("completion_logprobs", _numbers(F.col("_p"), "completion_logprobs", lambda x: x.try_cast("double")))
    s = s.where((F.size("prompt_ids") > 0) & (F.size("completion_ids") > 0) & (F.size("completion_logprobs") == F.size("completion_ids")))
    each = lambda c, v: F.transform(c, lambda x: v)
    return s.select(
        "rollout_id", "step_idx", "prompt_ids", each("prompt_ids", F.lit(False)).alias("prompt_mask"), "completion_ids", each("completion_ids", ~F.col("error")).alias("completion_mask"),
        "completion_logprobs", each("completion_ids", F.col("temperature")).alias("completion_temperatures"), coerce(F.get_json_object("_p", "$.compaction_events"), strict=False, fields=15).alias("compaction_events"),
    )


def call_records(samples: DataFrame, rollouts: DataFrame) -> DataFrame:
    """``samples`` of the interleave with calls: one record for each step that a sample merges, in order.

    Columns of ``rollouts``: rollout_id, temperature, steps (structs with step_idx, prompt_ids, completion_ids,
    completion_logprobs and, where there are any, compaction_events and trailing_pad_ids). A step that is missing is an error.
    """
    names = rollouts.schema["steps"].dataType.elementType.fieldNames()
    optional = lambda s, n, t: F.coalesce(s[n], F.array().cast(t)) if n in names else F.array().cast(t)

    def record(s: Column) -> Column:
        return F.struct(
            s["prompt_ids"].alias("submitted_prompt_ids"), s["completion_ids"].alias("completion_ids"), s["completion_logprobs"].alias("completion_logprobs"),
            F.transform(s["completion_ids"], lambda x: F.col("_temperature")).alias("completion_temperatures"),
            optional(s, "compaction_events", f"array<{WIRE}>").alias("compaction_events"), optional(s, "trailing_pad_ids", "array<int>").alias("trailing_pad_ids"),
        )

    r = rollouts.select("rollout_id", F.col("temperature").alias("_temperature"), F.col("steps").alias("_steps"))
    calls = F.flatten(F.transform("step_ids", lambda i: F.transform(F.filter("_steps", lambda s: s["step_idx"] == i), record)))
    out = samples.join(r, "rollout_id").withColumn("calls", calls)
    checked = F.when(F.size("calls") == F.size("step_ids"), F.col("calls")).otherwise(F.raise_error(F.lit("a merged step has no call")).cast(out.schema["calls"].dataType))
    return out.withColumn("calls", checked).drop("_temperature", "_steps")
