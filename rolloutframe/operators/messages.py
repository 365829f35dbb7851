"""Message containers, tool calls, images and tokens of messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import let
from .ordering import numbered
from .trajectory import common_prefix

# The text in place of a consumed image, and the starts of addresses that hold one.
STRIPPED = "[preprocessed image]"
IMAGE_STARTS = ("data:image", "file://")
# All that Unicode calls a space, which line breaks and tabs are not.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
MESSAGE = "struct<role: string, content: string, tool_calls: string>"


def _message(text: Column, role: str) -> Column:
    """A message of a JSON object, or of a JSON text with the default role."""
    v = F.parse_json(text)
    field = lambda n: F.coalesce(F.try_variant_get(v, f"$.{n}", "string"), F.get_json_object(text, f"$.{n}"))
    named = F.struct(field("role").alias("role"), field("content").alias("content"), F.get_json_object(text, "$.tool_calls").alias("tool_calls"))
    plain = F.struct(F.lit(role).alias("role"), F.try_variant_get(v, "$", "string").alias("content"), F.lit(None).cast("string").alias("tool_calls"))
    bad = F.raise_error(F.lit("a message is neither a text nor an object")).cast(MESSAGE)
    return F.when(text.startswith("{"), named).when(text.startswith('"'), plain).otherwise(bad)


def normalize(raw: Column, role: str) -> Column:
    """array<MESSAGE> of a JSON container: null gives none; a text or an object one; an array one for each item, texts
    with the default role. Anything else is an error."""
    raw = F.trim(raw)
    items = F.transform(F.parse_json(raw).try_cast("array<variant>"), lambda v: F.to_json(v))
    many = F.transform(items, lambda x: _message(x, role))
    return F.when(raw.isNull() | (raw == "null"), F.array().cast(f"array<{MESSAGE}>")).when(raw.startswith("["), many).otherwise(F.array(_message(raw, role)))


def parsed_arguments(tool_calls: Column) -> Column:
    """array<variant> of the arguments of a JSON array of tool calls; arguments given as a text are parsed."""
    calls = F.parse_json(tool_calls).try_cast("array<variant>")
    text = lambda c: F.try_variant_get(c, "$.function.arguments", "string")
    whole = lambda c: F.try_variant_get(c, "$.function.arguments", "variant")
    return F.transform(calls, lambda c: F.when(F.schema_of_variant(whole(c)) == "STRING", F.parse_json(text(c))).otherwise(whole(c)))


def function_format(name: Column, description: Column, parameters: Column, strict: Column) -> Column:
    """A tool as JSON in function-calling form; ``strict`` is left out where null, the others are null."""
    whole = {"ignoreNullFields": "false"}
    fields = [name.alias("name"), description.alias("description"), parameters.alias("parameters")]
    tool = lambda *more: F.to_json(F.struct(F.lit("function").alias("type"), F.struct(*fields, *more).alias("function")), whole)
    return F.when(strict.isNull(), tool()).otherwise(tool(strict.alias("strict")))


def render(messages: Column, generation: Column) -> Column:
    """Messages as one text, with the head of an answer where ``generation``."""
    body = F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit("<|im_end|>\n"))), "")
    return F.when(generation, F.concat(body, F.lit("<|im_start|>assistant\n"))).otherwise(body)


def fill_tokens(prompt: Column, completion: Column, encode: Callable[[Column], Column], number: Callable[[Column], Column] | None = None) -> Column:
    """struct(prompt_ids, prompt_mask, completion_ids, completion_mask, completion_logprobs) of a step from its messages.

    ``encode`` turns a text into tokens, ``number`` a token into its id, where tokens are not ids yet. The whole is split
    where the rendered prompt stops being its prefix; tokens are compared, not their ids, so different tokens may share an
    id. The completion's tokens are trained, with log probability 0. Contents lose the spaces at their ends.
    """
    strip = lambda ms: F.transform(ms, lambda m: F.struct(m["role"].alias("role"), F.btrim(m["content"], F.lit(SPACES)).alias("content")))
    as_ids = lambda a: F.transform(a, number) if number else a
    each = lambda a, v: F.array_repeat(F.lit(v), F.size(a))

    def split(t: Column) -> Column:
        left, right = F.slice(t["full"], 1, t["cut"]), F.slice(t["full"], t["cut"] + 1, F.greatest(F.size(t["full"]) - t["cut"], F.lit(0)))
        return let(F.struct(as_ids(left).alias("l"), as_ids(right).alias("r")), lambda s: F.struct(s["l"].alias("prompt_ids"), each(s["l"], False).alias("prompt_mask"), s["r"].alias("completion_ids"), each(s["r"], True).alias("completion_mask"), each(s["r"], 0.0).alias("completion_logprobs")))

    def filled(m: Column) -> Column:
        ids, full = encode(render(m["p"], F.size(m["c"]) > 0)), encode(render(F.concat(m["p"], m["c"]), F.lit(False)))
        out = let(F.struct(ids.alias("ids"), full.alias("full")), lambda t: let(F.struct(t["full"].alias("full"), common_prefix(t["ids"], t["full"]).alias("cut")), split))
        bad = F.exists(m["c"], lambda x: x["role"] != "assistant")
        return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("a completion message is not the assistant's"))).otherwise(out)

    return let(F.struct(strip(prompt).alias("p"), strip(completion).alias("c")), filled)


def strip_images(content: Column) -> Column:
    """Content items (structs with type and url) whose image is held by its address, with STRIPPED in its place."""
    held = lambda x: (x["type"] == "image_url") & (x["url"].startswith(IMAGE_STARTS[0]) | x["url"].startswith(IMAGE_STARTS[1]))
    return F.transform(content, lambda x: x.withField("url", F.when(held(x), F.lit(STRIPPED)).otherwise(x["url"])))


def image_indices(uses: DataFrame, order: list[str], image: str = "image") -> tuple[DataFrame, DataFrame]:
    """(images, uses): images with their index in first-seen order from 0, and ``uses`` with that index.

    ``uses``: one row for each image of each step; ``order`` is a total order of them.
    """
    first = uses.groupBy(image).agg(F.min(F.struct(*order)).alias("_first"))
    images = numbered(first, ["_first", image], "index").drop("_first")
    return images, uses.join(images, image)


def assemble(uses: DataFrame, images: DataFrame, step: list[str], position: str, value: str, image: str = "image") -> DataFrame:
    """step, indices, data: the values of a step's images one after another, in the order of their positions."""
    got = uses.join(images.select(image, value), image).groupBy(*step).agg(F.sort_array(F.collect_list(F.struct(position, "index", value))).alias("x"))
    return got.select(*step, F.col("x.index").alias("indices"), F.array_join(f"x.{value}", "").alias("data"))


def attach_to_last_step(samples: DataFrame, assembled: DataFrame, rollout: str = "rollout_id", step: str = "step_idx") -> DataFrame:
    """``samples`` (with step_ids) joined with the images of the last step that each merges; null where that has none."""
    last = F.array_max("step_ids")
    return samples.withColumn(step, last).join(assembled, [rollout, step], "left")
