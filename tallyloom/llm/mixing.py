"""Mixing sources to target weights with DataFrame expressions only.

Sizes are summed per source. Targets share the whole by weight and stop at `max_epochs` times the
source's size; the excess is reshared by weight until no source is above. That fixed point has a
closed form: sources in order of cap / weight are capped as long as the level of the rest is above
their ratio. Rate = target / source size; a document is taken floor(rate) times, plus once more if
its seeded hash falls below the fraction. Per source the seed among `seeds` whose draw comes
nearest to the target is used, so small sources keep near it too; the choice only depends on the rows.

Null texts have size 0. A null source is a source of its own and comes last. Repeated rows draw
alike. A source of size 0 has target 0. The per-source table has one row per source name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import durable

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1.0, 2.0, 3.0)
MAX_EPOCHS = 3.0
SEEDS = 8


def uniform(seed: int, *keys: Column) -> Column:
    """A value in [0, 1) from the first 13 hex digits of md5(keys and seed)."""
    text = F.concat_ws(":", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """`source, source_size, target` from rows of `source, size`."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()))
    table = F.array(*[F.lit(float(w)) for w in weights])
    weighed = per.withColumn("weight", F.element_at(table, (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int")))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    order = Window.partitionBy(F.lit(0)).orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy(F.lit(0))) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    free = weighed.withColumn("level", level).withColumn("capped", F.col("level") * F.col("weight") > cap)
    common = F.min(F.when(~F.col("capped"), F.struct(cap / F.col("weight"), F.col("level"))) ).over(Window.partitionBy(F.lit(0)))["level"]
    return free.withColumn("common", common).select(
        "source", "source_size",
        F.when(F.col("capped"), cap).otherwise(F.least(F.coalesce(F.col("common"), F.lit(0.0)) * F.col("weight"), cap)).alias("target"),
    )


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seeds: int = SEEDS,
) -> DataFrame:
    """`doc_id, source, size, source_size, target, rate, copies, taken` of every input row."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = durable(docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")), "sizes")
    targets = source_targets(rows.select("source", "size"), weights, max_epochs)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_epochs)))).otherwise(F.lit(0.0))
    targets = durable(
        targets.withColumn("rate", rate).withColumn("fraction", F.col("rate") - F.floor("rate")), "targets"
    ).withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    joined = rows.join(targets, same)
    drawn = joined.groupBy("_source").agg(*[
        F.abs(F.sum(F.when(uniform(s, F.col("doc_id")) < F.col("fraction"), F.col("size")).otherwise(0))
              - F.first("fraction") * F.first("source_size")).alias(f"_off{s}") for s in range(seeds)
    ])
    best = F.array_min(F.array(*[F.struct(F.col(f"_off{s}").alias("off"), F.lit(s).alias("seed")) for s in range(seeds)]))["seed"]
    chosen = drawn.select(F.col("_source").alias("_chosen"), best.alias("seed"))
    plan = targets.join(chosen, F.col("_source").eqNullSafe(F.col("_chosen")), "left").drop("_chosen")
    extra = F.coalesce(*[F.when(F.col("seed") == s, uniform(s, F.col("doc_id")) < F.col("fraction")) for s in range(seeds)], F.lit(False))
    return rows.join(plan, same).withColumn("copies", F.floor("rate") + extra.cast("long")).select(
        "doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"),
    )


def emit(docs: DataFrame, **settings) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it; columns as they are."""
    plan = (
        mix(docs, **settings).where("copies > 0")
        .groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source")).agg(F.max("copies").cast("int").alias("_copies"))
    )
    joined = docs.join(plan, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)
