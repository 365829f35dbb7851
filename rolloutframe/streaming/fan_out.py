"""One stream to several sinks, each of which may fail by itself.

A sink's micro-batches come to it in order and are marked in a ledger, a folder of the shared store, once it has taken them;
one that is run again after a failure is not given to a sink that has it. What a sink fails to take is laid aside for it, the
later ones behind it, and offered again with the next micro-batch; the stream and the other sinks go on. A sink that dies
after its work and before the mark gets that micro-batch again under the same number, as any sink of a stream may.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.io import exists, write_text

Sink = Callable[[DataFrame, int], None]


class FanOut:
    """For foreachBatch. ``errors``: (sink, batch, message) of what failed."""

    def __init__(self, sinks: dict[str, Sink], ledger: str):
        self.sinks, self.ledger, self.errors = sinks, ledger, []

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        rows = rows.persist()
        try:
            for name in self.sinks:
                if exists(spark, self._mark(name, batch)):
                    continue
                if not self.retry(spark, name) or not self._give(spark, name, rows, batch):
                    rows.write.mode("overwrite").parquet(f"{self.ledger}/aside/{name}/batch={batch:012d}")
        finally:
            rows.unpersist()

    def _mark(self, name: str, batch: int) -> str:
        return f"{self.ledger}/taken/{name}/{batch:012d}"

    def _give(self, spark: SparkSession, name: str, rows: DataFrame, batch: int) -> bool:
        try:
            self.sinks[name](rows, batch)
        except Exception as e:  # whatever a sink does, the others go on
            self.errors.append((name, batch, str(e)))
            return False
        write_text(spark, self._mark(name, batch), "")
        return True

    def retry(self, spark: SparkSession, name: str) -> bool:
        """Offers a sink what was laid aside for it, in order; whether nothing is left."""
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{self.ledger}/aside/{name}")
        files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(where):
            return True
        for folder in sorted(f.getPath().toString() for f in files.listStatus(where)):
            batch = int(folder.rsplit("=", 1)[1])
            if not exists(spark, self._mark(name, batch)) and not self._give(spark, name, spark.read.parquet(folder), batch):
                return False
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder), True)
        return True

    def settle(self, spark: SparkSession) -> list[str]:
        """Offers all sinks what is left for them, at the end of a stream; those that still fail."""
        return [name for name in self.sinks if not self.retry(spark, name)]
