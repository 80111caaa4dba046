"""Session defaults, table loading and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tallyloom", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are tuned for; `conf` overrides win."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder lineage cuts and job outputs go to: `spark.checkpoint.dir` of the session.

    Only a local master, where every task sees the driver's disk, may fall back to a
    fresh temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="tallyloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def durable(df: DataFrame, name: str = "cut") -> DataFrame:
    """Cut lineage through a Parquet table in the shared folder.

    Survives executor loss, is written in one pass and keeps column pruning for its readers.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def durable_by(df: DataFrame, key: str, name: str = "cut") -> DataFrame:
    """As `durable`, in buckets of `key`: a join on it moves the other side only.

    `df` should come from `by_key`, so that a task writes one bucket.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    named = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.format("parquet").bucketBy(_parts(spark), key).option("path", path).saveAsTable(named)
    return spark.table(named)


def by_key(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(_parts(df.sparkSession), key)


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Spread a source of fewer files than cores before heavy per-row work.

    A source with enough files is left alone, so large inputs are never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
