"""Scalar functions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once for all of its uses: inside lambdas Spark repeats an expression for each."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def capitalize(c: Column) -> Column:
    """The first letter in upper case, the rest unchanged."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


def _two(c: Column) -> Column:
    """Two decimals of the exact binary value, as Python's formatting gives them."""
    return F.call_function("format_number", c.cast("double"), F.lit("0.00"))


def human_time(seconds: Column) -> Column:
    """1.50h, 2.25m or 3.00s."""
    return F.when(seconds >= 3600, F.concat(_two(seconds / 3600), F.lit("h"))).when(seconds >= 60, F.concat(_two(seconds / 60), F.lit("m"))).otherwise(F.concat(_two(seconds), F.lit("s")))


def human_number(n: Column, largest: str = "B") -> Column:
    """1.50B, 2.25M, 3.00K, or the number itself below a thousand. Beyond the unit ``largest`` numbers stay in it."""
    x = n.cast("double")
    units = {"K": 1e3, "M": 1e6, "B": 1e9}
    out = n.cast("string")
    for unit, size in units.items():
        if size <= units[largest]:
            out = F.when(x >= size, F.concat(_two(x / size), F.lit(unit))).otherwise(out)
    return out


def env_id(c: Column) -> Column:
    """An environment id without its @version."""
    return F.split_part(c, F.lit("@"), F.lit(1))


def example_hash(*columns: Column) -> Column:
    """sha256 of the canonical JSON array of the columns as strings."""
    return F.sha2(F.to_json(F.array(*[c.cast("string") for c in columns])), 256)


def align_up(x: Column, block: int) -> Column:
    return (F.ceil(x / block) * block).cast("long")


def inference_step(step: Column, async_level: int, latest: Column | None = None) -> Column:
    """step - async level, at least 0, and not below the latest version where that is given."""
    own = F.greatest(step - async_level, F.lit(0))
    return own if latest is None else F.greatest(own, latest)


def workers(inflight: Column) -> Column:
    """One for each 256 requests in flight, at least one."""
    return F.greatest(F.lit(1), F.ceil(inflight / 256)).cast("long")


def wsd_factor(step: Column, warmup: int, total: int, decay: int, least: float = 0.0) -> Column:
    """Learning rate factor: linear warm-up, stable, linear decay to ``least``."""
    up = step / float(max(1, warmup))
    down = F.lit(least) + (1 - least) * (total - step) / float(max(1, decay))
    return F.when(step < warmup, up).when(step < total - decay, F.lit(1.0)).otherwise(F.greatest(F.lit(least), down))


def cosine_factor(step: Column, warmup: int, total: int, least: float = 0.0) -> Column:
    part = F.least((step - warmup) / float(max(1, total - warmup)), F.lit(1.0))
    return F.when(step < warmup, step / float(max(1, warmup))).otherwise(F.lit(least) + (1 - least) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * part)))


def flops_per_token(params: Column, layers: Column, heads: Column, head_dim: Column, seq_len: Column) -> Column:
    """6 N + 12 l h q t."""
    return 6 * params + 12 * layers * heads * head_dim * seq_len


def peak_flops(device: Column) -> Column:
    """Dense bfloat16 peak by device name, a fixed table; 312e12 for others."""
    # Published dense BF16 peaks.
    peaks = {"B200": 2.25e15, "H200": 989e12, "H100 NVL": 835e12, "H100 PCIe": 756e12, "H100": 989e12, "A6000": 154.8e12, "A100": 312e12}
    out = F.lit(312e12)
    for name, peak in reversed(peaks.items()):
        out = F.when(device.contains(name), F.lit(peak)).otherwise(out)
    return out


def regression(value: Column, baseline: Column, threshold: float, lower_is_better: bool) -> Column:
    """Whether a value is worse than the baseline by more than the threshold."""
    return value > baseline * (1 + threshold) if lower_is_better else value < baseline * (1 - threshold)


def schedule_eval(previous: Column, current: Column, interval: int) -> Column:
    """The highest multiple of the interval in (previous, current], else null."""
    top = (F.floor(current / interval) * interval).cast("long")
    return F.when(top > previous, top)


@F.pandas_udf(LongType())
def blake2b_mod(parts: pd.Series, n: pd.Series) -> pd.Series:
    """The first 8 bytes of blake2b of a text, big-endian, modulo n."""
    return pd.Series([int.from_bytes(hashlib.blake2b(p.encode(), digest_size=8).digest(), "big") % int(m) for p, m in zip(parts, n, strict=True)])


def boxed_answer(answer: Column) -> Column:
    """The number after ####, else the whole answer, in \\boxed{}."""
    number = F.regexp_extract(answer, r"####\s*([-0-9.,]+)", 1)
    return F.concat(F.lit("\\boxed{"), F.when(number != "", number).otherwise(answer), F.lit("}"))


def uniform(key: Column, seed: int) -> Column:
    """A reproducible number in [0, 1) of a key: 52 bits of its MD5, which other engines can compute as well."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def image_key(data: Column) -> Column:
    """The first 16 hex digits of an image's sha256."""
    return F.substring(F.sha2(data, 256), 1, 16)


def image_file(data: Column) -> Column:
    """The file that an image is written to, once whatever the number of its uses."""
    return F.concat(image_key(data), F.lit(".png"))


def teacher_logprob(logprob: Column) -> Column:
    """A teacher's log probability; the first token has none, which counts as 0."""
    return F.coalesce(logprob, F.lit(0.0))


def gathered(values: Column, label: Column) -> Column:
    """The value at a label, counted from 0."""
    return F.element_at(values, label + 1)


def json_or_empty(value: Column) -> Column:
    """JSON of a value, an empty text for null."""
    return F.coalesce(F.to_json(value), F.lit(""))


def hardware_label(count: Column, name: Column) -> Column:
    return F.concat(count.cast("string"), F.lit("x"), name)


def sampling_args(**args: Column) -> Column:
    """The arguments that are given as JSON; null ones are left out."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in args.items()]))


def step_seed(seed: int, step: Column) -> Column:
    return seed + step * 1_000_000


def batch_seed(address: Column, batch: int, step: Column) -> Column:
    return address * batch + step


def payload_number(payload: Column, name: str) -> Column:
    """A whole number of a JSON payload; null where it is missing or malformed."""
    return F.get_json_object(payload, f"$.{name}").try_cast("bigint")
