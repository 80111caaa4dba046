"""Rate cards: realized prices, precedence merge, health, and pricing as of a date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.ordering import as_of

# Fixed source names, best first. Any other source ranks last and is stored as the weakest.
SOURCES = ("ce_realized", "price_list", "fallback_static")
WEAKEST = "fallback_static"
RATE_COLUMNS = ("sku", "unit_price", "unit", "source", "as_of")
MAX_AGE_DAYS = 30


def source_rank(source: Column) -> Column:
    rank = F.lit(len(SOURCES))
    for i, name in enumerate(SOURCES):
        rank = F.when(source == name, i).otherwise(rank)
    return rank


def known_source(source: Column) -> Column:
    return F.when(source.isin(*SOURCES), source).otherwise(WEAKEST)


def realized_rates(
    usage: DataFrame, as_of_date: str, order: Sequence[str], scales: DataFrame | None = None
) -> DataFrame:
    """unit_price = cost / quantity x scale from billed usage; the first usable row per SKU wins.

    `usage`: sku?, usage_type, quantity, cost_usd, unit?; `order` names the input-order columns;
    `scales`: sku, scale.
    """
    cols = usage.columns
    own = F.col("sku") if "sku" in cols else F.lit(None).cast("string")
    sku = F.coalesce(F.when(own != "", own), F.col("usage_type"))
    unit = F.coalesce(F.col("unit"), F.lit("unit")) if "unit" in cols else F.lit("unit")
    usable = usage.select(
        sku.alias("sku"), unit.alias("unit"), "quantity", "cost_usd", *order
    ).where((F.col("sku") != "") & (F.col("quantity") > 0))
    first = usable.groupBy("sku").agg(
        F.min_by(F.struct("quantity", "cost_usd", "unit"), F.struct(*order)).alias("r")
    )
    if scales is not None:
        first = first.join(scales, "sku", "left")
    scale = F.coalesce(F.col("scale"), F.lit(1.0)) if scales is not None else F.lit(1.0)
    return first.select(
        "sku",
        (F.col("r.cost_usd") / F.col("r.quantity") * scale).alias("unit_price"),
        F.col("r.unit").alias("unit"),
        F.lit("ce_realized").alias("source"),
        F.lit(as_of_date).alias("as_of"),
    )


def unwrap_card(document: DataFrame, rates: str = "rates") -> DataFrame:
    """A rate card from a whole document whose `rates` field maps SKU to entry."""
    return document.select(F.explode(rates).alias("sku", "entry")).select("sku", "entry.*")


def merge_rates(*cards: DataFrame) -> DataFrame:
    """One rate per SKU: best source first, the earlier card on ties."""
    stacked = None
    for i, card in enumerate(cards):
        card = card.select(*RATE_COLUMNS, F.lit(i).alias("_card"))
        stacked = card if stacked is None else stacked.unionByName(card)
    best = stacked.groupBy("sku").agg(
        F.min_by(
            F.struct("unit_price", "unit", "source", "as_of"),
            F.struct(source_rank(F.col("source")), "_card"),
        ).alias("r")
    )
    return best.select(
        "sku",
        F.col("r.unit_price").alias("unit_price"),
        F.col("r.unit").alias("unit"),
        known_source(F.col("r.source")).alias("source"),
        F.col("r.as_of").alias("as_of"),
    )


def stale(card: DataFrame, now: str, max_age_days: int = MAX_AGE_DAYS) -> DataFrame:
    """Rates whose as_of is missing, unreadable or more than `max_age_days` whole days old."""
    at = F.expr("try_cast(as_of AS timestamp)")
    seconds = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(at)
    age = F.floor(seconds / 86400)
    return card.withColumn("age_days", age).where(age.isNull() | (age > max_age_days))


def missing(card: DataFrame, required: DataFrame) -> DataFrame:
    return required.select("sku").distinct().join(card, "sku", "left_anti")


def by_source(card: DataFrame) -> DataFrame:
    return card.groupBy("source").agg(F.count("*").alias("n_rates"))


def rate_health(
    card: DataFrame, required: DataFrame, now: str, max_age_days: int = MAX_AGE_DAYS
) -> DataFrame:
    """One row: sizes, missing and stale counts, oldest date and the healthy flag."""
    totals = card.agg(F.count("*").alias("n_rates"), F.min("as_of").alias("oldest_as_of"))
    absent = missing(card, required).agg(F.count("*").alias("n_missing"))
    old = stale(card, now, max_age_days).agg(F.count("*").alias("n_stale"))
    one = F.lit(1).alias("_one")
    joined = (
        totals.select("*", one)
        .join(absent.select("*", one), "_one")
        .join(old.select("*", one), "_one")
        .drop("_one")
    )
    return joined.withColumn("healthy", (F.col("n_missing") == 0) & (F.col("n_stale") == 0))


def required_skus(plans: DataFrame) -> DataFrame:
    """Every SKU each plan needs a price for (plan_id, sku)."""
    from tallyloom.operators.estimates import plan_lines

    priced_elsewhere = F.col("category") == "support"
    optional = F.col("category") == "agentcore_evaluations"
    return plan_lines(plans).where(~priced_elsewhere & ~optional).select("plan_id", "sku").distinct()


def price_as_of(events: DataFrame, history: DataFrame, at: str) -> DataFrame:
    """Join each event to the rate that was live for its SKU at time `at`.

    Adds unit_price, source and rate_card_as_of (null where no rate was known yet).
    """
    dated = history.select(
        "sku", "unit_price", "source", F.col("as_of").cast("timestamp").alias("rate_card_as_of")
    )
    events = events.withColumn(at, F.col(at).cast("timestamp"))
    return as_of(events, dated, ["sku"], at, "rate_card_as_of", ["unit_price", "source"])
