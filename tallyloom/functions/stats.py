"""Interval, order-statistic and money arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z_95 = 1.96


def wilson(p: Column, n: Column, z: float = Z_95) -> tuple[Column, Column]:
    """Wilson score interval of a (possibly fractional) proportion; null where n <= 0."""
    n = n.cast("double")
    centre = p + z * z / (2 * n)
    spread = F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    defined = n > 0
    return (
        F.when(defined, centre / scale - z * spread / scale),
        F.when(defined, centre / scale + z * spread / scale),
    )


def ratio(num: Column, den: Column) -> Column:
    """num / den, null (not zero) when there is nothing to divide by."""
    return F.when(den != 0, num.cast("double") / den.cast("double"))


def count_where(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def money(col: Column | str) -> Column:
    """Fixed point of twelve decimals, so sums do not depend on the order rows arrive in and rows of
    a millionth of a cent still count."""
    return (F.col(col) if isinstance(col, str) else col).cast("decimal(30,12)")


def money_sum(col: Column | str) -> Column:
    return F.sum(money(col)).cast("double")


def order_statistics(
    df: DataFrame, keys: list[str], value: str, picks: dict[str, Column], width: int = 1024
) -> DataFrame:
    """Exact values at computed 0-based positions of the sorted `value`, per key.

    `picks` maps an output name to a position expression over the group's row count `n`.
    Rows are first folded to a (key, value) histogram, then to fixed-width bins; only the
    small bin table is cumulated per key, so a key holding most rows is still spread out.
    Nulls are not counted.
    """
    cells = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count("*").alias("_c"))
        .withColumn("_bin", F.floor(F.col("_v") / width))
    )
    per_key = Window.partitionBy(*keys)
    bins = (
        cells.groupBy(*keys, "_bin")
        .agg(F.sum("_c").alias("_bc"))
        .withColumn("n", F.sum("_bc").over(per_key))
        .withColumn(
            "_before",
            F.sum("_bc").over(
                per_key.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            )
            - F.col("_bc"),
        )
    )
    join_on = [*keys, "_bin"]
    upto = Window.partitionBy(*join_on).orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    placed = cells.join(bins, join_on).withColumn(
        "_last", F.col("_before") + F.sum("_c").over(upto) - 1
    )
    aggs = [
        F.min(F.when(F.col("_last") >= position, F.col("_v"))).alias(name)
        for name, position in picks.items()
    ]
    return placed.groupBy(*keys).agg(F.max("n").alias("n"), *aggs)


def upper_median_position() -> Column:
    return F.floor(F.col("n") / 2)


def quantile_position(q: float) -> Column:
    """Index of the reported quantile: min(n - 1, int(q * n))."""
    return F.least(F.col("n") - 1, F.floor(F.lit(q) * F.col("n")))


def running_safe_sum(col: str) -> Column:
    """A sum of measurements that does not depend on arrival order."""
    return F.sum(money(col)).cast("double")
