"""Ordered work that stays parallel when one key holds most of the rows.

A plain `partitionBy(key)` window sorts a whole key in one task. The helpers here split a key
into chunks that follow the order column, run the window inside each chunk, and carry one small
summary row per (key, chunk) across the chunk borders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import durable

CHUNK = "_chunk"


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """The first `limit` rows per key in `order`, with `truncated` telling if more exist.

    Spark cuts each map task's share to limit + 1 rows per key before the shuffle
    (window group limit), so a hot key never travels whole.
    """
    ranked = df.withColumn(
        "position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    ).where(F.col("position") <= limit + 1)
    per_key = Window.partitionBy(*keys)
    return ranked.withColumn("truncated", F.max("position").over(per_key) > limit).where(
        F.col("position") <= limit
    )


def newest_overall(df: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """Order first, limit second; `truncated` says whether older rows exist."""
    window = df.orderBy(*order).limit(limit + 1)
    ranked = window.withColumn(
        "position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long")
    )
    total = F.count("*").over(Window.partitionBy(F.lit(0)))
    return ranked.withColumn("truncated", total > limit).where(F.col("position") <= limit)


def carry_forward(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, columns: dict[str, str]
) -> DataFrame:
    """Add, per output name, the latest non-null value of a source column up to each row."""
    cut = df.withColumn(CHUNK, chunk)
    at = F.struct(*order)
    by = [*keys, CHUNK]
    ends = cut.groupBy(*by).agg(
        *[
            F.max_by(F.col(src), F.when(F.col(src).isNotNull(), at)).alias(f"_end_{out}")
            for out, src in columns.items()
        ]
    )
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *by, *[F.last(f"_end_{out}", True).over(earlier).alias(f"_in_{out}") for out in columns]
    )
    local = Window.partitionBy(*by).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    joined = cut.join(carried, by)
    for out, src in columns.items():
        joined = joined.withColumn(
            out, F.coalesce(F.last(src, True).over(local), F.col(f"_in_{out}"))
        )
    return joined.drop(CHUNK, *[f"_in_{out}" for out in columns])


def previous_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, columns: dict[str, str]
) -> DataFrame:
    """Add, per output name, the value a source column had in the row before (a chunked lag)."""
    cut = df.withColumn(CHUNK, chunk)
    by = [*keys, CHUNK]
    packed = F.struct(*[F.col(src).alias(out) for out, src in columns.items()])
    ends = cut.groupBy(*by).agg(F.max_by(packed, F.struct(*order)).alias("_end"))
    carried = ends.select(
        *by, F.lag("_end").over(Window.partitionBy(*keys).orderBy(CHUNK)).alias("_in")
    )
    local = Window.partitionBy(*by).orderBy(*order)
    joined = cut.join(carried, by).withColumn("_first", F.row_number().over(local) == 1)
    for out, src in columns.items():
        joined = joined.withColumn(
            out,
            F.when(F.col("_first"), F.col(f"_in.{out}")).otherwise(F.lag(src).over(local)),
        )
    return joined.drop(CHUNK, "_in", "_first")


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    measures: dict[str, Column],
    chunk: Column | str,
) -> DataFrame:
    """Inclusive running sums per key; `chunk` must not decrease along `order`."""
    cut = df.withColumn(CHUNK, F.col(chunk) if isinstance(chunk, str) else chunk)
    cut = cut.withColumns({f"_m_{name}": expr for name, expr in measures.items()})
    by = [*keys, CHUNK]
    sums = cut.groupBy(*by).agg(*[F.sum(f"_m_{m}").alias(f"_s_{m}") for m in measures])
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *by, *[F.sum(f"_s_{m}").over(earlier).alias(f"_o_{m}") for m in measures]
    )
    local = Window.partitionBy(*by).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    joined = cut.join(offsets, by)
    for m in measures:
        joined = joined.withColumn(
            m, F.sum(f"_m_{m}").over(local) + F.coalesce(F.col(f"_o_{m}"), F.lit(0))
        )
    return joined.drop(CHUNK, *[f"_m_{m}" for m in measures], *[f"_o_{m}" for m in measures])


def range_chunks(df: DataFrame, order: Sequence[Column | str], name: str = CHUNK) -> DataFrame:
    """Sort once across the cluster and label each row with its range, written down for reuse.

    The label depends on sampled range borders, so it is fixed by a durable table before
    anything is derived from it.
    """
    ranged = df.orderBy(*order).withColumn(name, F.spark_partition_id())
    return durable(ranged, "ranges")


def rank_overall(df: DataFrame, order: Sequence[Column | str], rank: str) -> DataFrame:
    """A 1-based global rank without a single-partition window."""
    ranged = range_chunks(df.withColumn("_all", F.lit(0)), order, "_range")
    return running_total(ranged, ["_all"], order, {rank: F.lit(1)}, "_range").drop("_range", "_all")


def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    payload: Sequence[str],
    chunk_days: int = 32,
) -> DataFrame:
    """For each left row, the payload of the latest right row with right_time <= left_time.

    Both sides are merged into one time line per key and carried forward, so no range join
    multiplies rows. At equal times the right row counts as already known.
    """
    value = F.struct(F.col(right_time), *payload)
    left_cols = left.columns
    timeline = left.select(
        *keys,
        F.col(left_time).alias("_t"),
        F.lit(1).alias("_side"),
        F.struct(*left_cols).alias("_left"),
    ).unionByName(
        right.select(
            *keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), value.alias("_value")
        ),
        allowMissingColumns=True,
    )
    chunk = F.floor(F.datediff(F.col("_t"), F.lit("1970-01-01")) / chunk_days)
    known = carry_forward(timeline, keys, ["_t", "_side"], chunk, {"_known": "_value"})
    return known.where(F.col("_side") == 1).select(
        "_left.*", F.col(f"_known.{right_time}"), *[F.col(f"_known.{c}") for c in payload]
    )
