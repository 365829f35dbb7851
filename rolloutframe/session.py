"""Session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "rolloutframe", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution, UTC and Kryo; ``conf`` adds or replaces settings (dots as double underscores)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings |= {k.replace("__", "."): str(v) for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()
