"""Pairwise judgments and quality gates: rollups, flips, missingness, imputation, verdicts."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import text as tx
from tallyloom.functions.stats import count_where, order_statistics, ratio, upper_median_position, wilson

PASSED, FAILED, BORDERLINE = "passed", "failed", "borderline"
NOT_MEASURED, NOT_EVALUATED = "not_measured", "not_evaluated"
UNREADABLE, UNRECONCILED = "unreadable", "unreconciled"
SCALAR_BAND, BAND_EPS = 0.05, 1e-9


def slots(judgments: DataFrame) -> DataFrame:
    """One outcome per (layer, item_id, position): win, tie, loss from the student's side, or null.

    A later scored attempt replaces an earlier one. `student_position` says where the student sat;
    without that column `position` itself does.
    """
    seat = F.col("student_position") if "student_position" in judgments.columns else F.col("position")
    scored = F.coalesce(F.col("verdict").isin("A", "B", "tie"), F.lit(False))
    outcome = F.when(F.col("verdict") == "tie", "tie").when(F.col("verdict") == seat, "win").when(scored, "loss")
    return judgments.withColumn("_o", outcome).groupBy("layer", "item_id", "position").agg(
        F.max_by("_o", F.when(scored, F.col("attempt"))).alias("outcome"), F.count("*").alias("attempts"),
        F.min_by(scored, "attempt").alias("_first_ok"),
        F.max_by("stop_reason", "attempt").alias("stop_reason"),
    ).withColumn("recovered", F.col("outcome").isNotNull() & ~F.col("_first_ok")).drop("_first_ok")


def item_outcomes(judgments: DataFrame, items: DataFrame) -> DataFrame:
    """One outcome per item of the layer; null where a position has no verdict.

    Two positions that disagree make a tie, published as a flip.
    """
    per = slots(judgments).groupBy("layer", "item_id").agg(
        F.min("outcome").alias("_lo"), F.max("outcome").alias("_hi"),
        F.count("*").alias("n_slots"), F.count("outcome").alias("n_scored"))
    complete = (F.col("n_scored") == F.col("n_slots")) & (F.col("n_slots") > 0)
    outcome = F.when(complete, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise("tie"))
    return items.join(per, ["layer", "item_id"], "left").withColumns({
        "outcome": outcome,
        "flipped": F.when(complete & (F.col("n_slots") > 1), F.col("_lo") != F.col("_hi")),
    }).drop("_lo", "_hi")


def judge_rollup(outcomes: DataFrame, keys: Sequence[str] = ("layer",)) -> DataFrame:
    """Wins, ties, losses, score and interval over scored items; the unscorable are counted apart.

    judge_n + judge_unscorable is the layer's own item count, or the row is not reportable.
    """
    n = lambda v: count_where(F.col("outcome") == v)
    sums = outcomes.groupBy(*keys).agg(
        F.count("*").alias("items_in_layer"), n("win").alias("judge_wins"), n("tie").alias("judge_ties"),
        n("loss").alias("judge_losses"), count_where(F.col("outcome").isNull()).alias("judge_unscorable"))
    total = F.col("judge_wins") + F.col("judge_ties") + F.col("judge_losses")
    sums = sums.withColumn("judge_n", total).withColumn(
        "judge_score", ratio(F.col("judge_wins") + 0.5 * F.col("judge_ties"), F.col("judge_n")))
    low, high = wilson(F.col("judge_score"), F.col("judge_n"))
    return sums.withColumns({"judge_score_ci_low": low, "judge_score_ci_high": high})


def unscorable_items(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("outcome").isNull()).select("layer", "item_id")


def reconcile_denominator(rollup: DataFrame, layer_sizes: DataFrame) -> DataFrame:
    """judge_n + judge_unscorable against the layer file's own row count (layer, n_items)."""
    ok = F.col("judge_n") + F.col("judge_unscorable") == F.col("n_items")
    return rollup.join(layer_sizes, "layer", "left").withColumn(
        "denominator", F.when(F.coalesce(ok, F.lit(False)), "reconciled").otherwise(UNRECONCILED))


def position_flip(outcomes: DataFrame) -> DataFrame:
    """Per layer: items judged in both positions, how many flip, and the share."""
    both = F.col("flipped").isNotNull()
    flips = count_where(F.col("flipped"))
    return outcomes.groupBy("layer").agg(
        count_where(both).alias("n_both"), flips.alias("n_flipped"), ratio(flips, count_where(both)).alias("flip_rate"))


def position_balance(judgments: DataFrame) -> DataFrame:
    seat = "student_position" if "student_position" in judgments.columns else "position"
    return judgments.groupBy("layer").agg(
        F.countDistinct(F.when(F.col(seat) == "A", F.col("item_id"))).alias("n_a"),
        F.countDistinct(F.when(F.col(seat) == "B", F.col("item_id"))).alias("n_b"),
    ).withColumn("balanced", F.col("n_a") == F.col("n_b"))


def judge_missingness(judgments: DataFrame, items: DataFrame) -> DataFrame:
    """Slots, attempts, unscorable and retry-recovered counts per layer, category and stop reason."""
    seen = slots(judgments).join(items.select("layer", "item_id", "category"), ["layer", "item_id"], "left")
    bad = count_where(F.col("outcome").isNull())
    return seen.groupBy("layer", "category", "stop_reason").agg(
        F.count("*").alias("n_slots"), F.sum("attempts").alias("attempts"), bad.alias("n_unscorable"),
        (bad / F.count("*")).alias("unscorable_share"), count_where(F.col("recovered")).alias("n_recovered"))


def category_breakdown(outcomes: DataFrame, training: DataFrame) -> DataFrame:
    """Score per category of a layer, and whether the training data holds that category at all."""
    covered = training.select("category").distinct().withColumn("_in", F.lit(True))
    return judge_rollup(outcomes, ["layer", "category"]).join(covered, "category", "left").withColumn(
        "in_training", F.col("_in").isNotNull()).drop("_in")


def length_ratio(judgments: DataFrame) -> DataFrame:
    """Student over reference answer length per layer, one row per judged item."""
    items = judgments.groupBy("layer", "item_id").agg(
        F.max("student_answer_chars").alias("_s"), F.max("reference_answer_chars").alias("_r"))
    sized = items.where(F.col("_r") > 0).withColumn("_ratio", F.col("_s") / F.col("_r"))
    mid = order_statistics(sized, ["layer"], "_ratio", {"median_ratio": upper_median_position()}, 0.125).drop("n")
    return sized.groupBy("layer").agg(
        F.count("*").alias("n_items"), (F.sum("_s") / F.sum("_r")).alias("pooled_ratio"),
        (count_where(F.col("_s") > F.col("_r")) / F.count("*")).alias("share_longer")).join(mid, "layer")


# ---- gates -------------------------------------------------------------------------------

def bounds_verdict(low: Column, high: Column, bar: Column) -> Column:
    return F.when(low >= bar, PASSED).when(high < bar, FAILED).otherwise(BORDERLINE)


def imputed_verdicts(wins: Column, ties: Column, n: Column, unscorable: Column, bar: Column) -> Column:
    """Verdicts with every unscorable item as a win, a loss and a tie, in that order."""
    total = n + unscorable
    out = []
    for w, t in ((unscorable, F.lit(0.0)), (F.lit(0.0), F.lit(0.0)), (F.lit(0.0), unscorable)):
        out.append(bounds_verdict(*wilson((wins + w + 0.5 * (ties + t)) / total, total), bar))
    return F.array(*out)


def gate_rows(runs: DataFrame) -> DataFrame:
    """One row per (run, gate) with its verdict.

    `runs`: run_id, gates map<string,string>, metrics map<string,string>, eval_reported. A metric
    with bounds is decided by them, then by its denominator, then by imputing its unscorable
    items; without bounds a fixed band around the bar is borderline.
    """
    rows = runs.select("run_id", "metrics", "eval_reported", F.explode("gates").alias("gate", "threshold"))
    family = F.regexp_replace("gate", r"_[^_]*$", "")
    metric = lambda key: F.try_element_at(F.col("metrics"), key)
    text = lambda suffix: metric(F.concat(F.col("gate"), F.lit(suffix)))
    part = lambda suffix: metric(F.concat(family, F.lit(suffix)))
    rows = rows.withColumns({
        "actual": metric(F.col("gate")), "_low": text("_ci_low"), "_high": text("_ci_high"),
        "_n": part("_n"), "_u": part("_unscorable"), "_w": part("_wins"), "_t": part("_ties"),
        "_l": part("_losses"), "_items": metric(F.lit("items_in_layer")),
    })
    num = lambda c: F.expr(f"try_cast({c} AS double)")
    whole = lambda c: F.expr(f"try_cast({c} AS bigint)")
    bar, value, low, high = num("threshold"), num("actual"), num("_low"), num("_high")
    n, u, w, t, lost, items = whole("_n"), whole("_u"), num("_w"), num("_t"), num("_l"), whole("_items")

    has_bounds = F.col("_low").isNotNull() & F.col("_high").isNotNull()
    counted = F.col("_items").isNotNull() & F.col("_n").isNotNull()
    bad_count = counted & (n.isNull() | items.isNull() | (F.col("_u").isNotNull() & u.isNull()))
    off = counted & (n + F.coalesce(u, F.lit(0)) != items)
    verdict = bounds_verdict(low, high, bar)
    imputable = w.isNotNull() & t.isNotNull() & lost.isNotNull() & (n > 0) & (F.abs(w + t + lost - n) <= 1e-9)
    imputed = F.array_distinct(imputed_verdicts(w, t, n.cast("double"), u.cast("double"), bar))
    with_missing = (
        F.when(~F.coalesce(imputable, F.lit(False)), BORDERLINE)
        .when(F.size(imputed) > 1, BORDERLINE).otherwise(F.get(imputed, F.lit(0))))
    by_bounds = (
        F.when(low.isNull() | high.isNull() | bad_count, UNREADABLE)
        .when(off, UNRECONCILED)
        .when(F.col("_u").isNull(), verdict)
        .when(u.isNull(), BORDERLINE)
        .when(u > 0, with_missing)
        .otherwise(verdict))
    by_band = (
        F.when(value.isNull(), UNREADABLE)
        .when(F.abs(value - bar) <= SCALAR_BAND + BAND_EPS, BORDERLINE)
        .when(value > bar, PASSED).otherwise(FAILED))
    status = (
        F.when(F.col("actual").isNull(), F.when(F.col("eval_reported"), NOT_MEASURED).otherwise(NOT_EVALUATED))
        .when(bar.isNull(), UNREADABLE)
        .when(has_bounds, by_bounds).otherwise(by_band))
    return rows.withColumn("status", status).withColumn(
        "passed",
        F.when(F.col("status") == PASSED, True)
        .when(F.col("status").isin(NOT_EVALUATED, BORDERLINE), F.lit(None).cast("boolean")).otherwise(False),
    ).select("run_id", "gate", "threshold", "actual", "status", "passed")


def ood_layer(runs: DataFrame) -> DataFrame:
    """The out-of-distribution score of each run: reported, never gated, missed out loud.

    `runs`: run_id, ood_score (null when absent), ood_requested, eval_reported.
    """
    return runs.withColumn(
        "ood_status",
        F.when(F.col("ood_score").isNotNull(), "reported")
        .when(F.col("eval_reported") & F.col("ood_requested"), "missing").otherwise("not requested"))


# ---- ROUGE -------------------------------------------------------------------------------

def rouge_n(pairs: DataFrame, key: str, prediction: str, reference: str, n: int = 1) -> DataFrame:
    """ROUGE-N precision, recall and F1 from clipped n-gram counts."""
    def grams(col: str, name: str) -> DataFrame:
        items = tx.words(F.col(col))
        cut = tx.bind(items, lambda w: F.transform(
            F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>")),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)])))
        return pairs.select(key, F.explode(cut).alias("g")).groupBy(key, "g").agg(F.count("*").alias(name))

    both = grams(prediction, "_p").join(grams(reference, "_r"), [key, "g"], "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = both.groupBy(key).agg(
        F.sum(F.least(zero("_p"), zero("_r"))).alias("_o"), F.sum(zero("_p")).alias("_p"), F.sum(zero("_r")).alias("_r"))
    o, p, r = zero("_o"), zero("_p"), zero("_r")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return pairs.select(key).join(sums, key, "left").select(
        key, share(o, p).alias("precision"), share(o, r).alias("recall"), share(2 * o, p + r).alias("f1"))


def common_length(left: Sequence, right: Sequence) -> int:
    """Length of the longest common subsequence, a bit per token of `left`.

    A row of the usual table differs from its neighbour by 0 or 1 in each place, so a row is a
    number whose zero bits are the steps, and the next row is an addition and two masks over
    machine words (Hyyro's form).
    """
    places: dict = {}
    for i, token in enumerate(left):
        places[token] = places.get(token, 0) | 1 << i
    whole = (1 << len(left)) - 1
    row = whole
    for token in right:
        hit = row & places.get(token, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & whole
    return len(left) - row.bit_count()


@F.pandas_udf(T.LongType())
def lcs_length(left: pd.Series, right: pd.Series) -> pd.Series:
    """Longest common subsequence of two token arrays."""
    pairs = zip(left, right)
    return pd.Series([0 if a is None or b is None else common_length(a.tolist(), b.tolist()) for a, b in pairs], dtype="int64")


def rouge_l(pairs: DataFrame, key: str, prediction: str, reference: str) -> DataFrame:
    hashed = lambda c: F.transform(tx.words(F.col(c)), lambda w: F.xxhash64(w))
    rows = pairs.select(key, hashed(prediction).alias("_p"), hashed(reference).alias("_r"))
    scored = rows.withColumn("_o", lcs_length("_p", "_r"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    o, p, r = F.col("_o"), F.size("_p"), F.size("_r")
    return scored.select(key, share(o, p).alias("precision"), share(o, r).alias("recall"), share(2 * o, p + r).alias("f1"))
