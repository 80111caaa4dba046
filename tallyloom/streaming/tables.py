"""Keyed tables that the batches of a stream are merged into, each batch once.

Only the partitions a batch touches are read and replaced. What a batch makes of them is first
written to a journal, with a mark once that is complete, and then takes its place in the table: a
batch that is run again before the mark finds the table as it was, and one that is run again after
it repeats the replacement from the journal. So a replay changes nothing, whatever the merge does,
and a failure in the middle of a replacement loses nothing. The journal holds the last two batches.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import durable

BUCKET = "bucket"


class KeyedTable:
    """A Parquet table partitioned by `parts`; `columns` is its schema as DDL, with `parts` last."""

    def __init__(self, spark: SparkSession, path: str, columns: str, parts: Sequence[str]):
        self.spark, self.path, self.columns, self.parts = spark, path.rstrip("/"), columns, list(parts)

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.columns).parquet(self.path)
        except AnalysisException:  # nothing has been written
            return self.spark.createDataFrame([], self.columns)

    def merge(self, new: DataFrame, number: int, origin: str, settle: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Let batch `number` of the stream `origin` replace the partitions of `new`.

        `settle(known, new)` gives their rows from those they hold and the batch's; it must leave
        a row in each of them.
        """
        slot = f"{self.path}-journal/{zlib.crc32(origin.encode()):08x}/{number % 2}"
        names = self.read().columns
        if self._marked(f"{slot}/mark") != number:
            rows = durable(new.select(*names), "batch")
            touched = rows.select(*[F.col(p).alias(f"_{p}") for p in self.parts]).distinct()
            same = [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in self.parts]
            known = self.read().join(touched, same, "left_semi")
            settle(known, rows).select(*names).write.mode("overwrite").parquet(f"{slot}/rows")
            self.spark.range(1).select(F.lit(number).cast("long").alias("number")).coalesce(1).write.mode("overwrite").parquet(f"{slot}/mark")
        settled = self.spark.read.schema(self.columns).parquet(f"{slot}/rows")
        # the hint gathers a partition's rows into few files and lets Spark split a large one
        settled.hint("rebalance", *[F.col(p) for p in self.parts]).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy(*self.parts).parquet(self.path)

    def _marked(self, path: str) -> int | None:
        try:
            row = self.spark.read.schema("number long").parquet(path).first()
        except AnalysisException:
            return None
        return row.number if row else None


def bucket_of(keys: Sequence[str | Column], buckets: int) -> Column:
    """The partition a key lies in when a table has no natural one."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias(BUCKET)
