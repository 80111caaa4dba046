"""Model scoring: join, code checks, reports, pass@k, gates, lift, generation runs."""

from __future__ import annotations

import ast
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions import text as tx
from tallyloom.functions.stats import count_where, ratio

# Fixed chain, hardest question first.
METRICS = ("selected_at_k", "heldout_solve_rate", "solve_rate")
FALLBACK = "solve_rate"
DEGENERATE = 0.99
SETTINGS = ("input_window", "n_samples", "temperature", "max_new_tokens", "thinking")


def score_join(generations: DataFrame, val: DataFrame) -> DataFrame:
    """Generations beside their val row on (task_id, variant); the unmatched are named, not dropped."""
    keyed = lambda df: df.withColumn("variant", F.coalesce("variant", F.lit("")))
    right = keyed(val).withColumn("_hit", F.lit(True))
    return keyed(generations).join(right, ["task_id", "variant"], "left").withColumn(
        "status", F.when(F.col("_hit").isNull(), "no_matching_val_row")).drop("_hit")


@F.pandas_udf(T.StringType())
def syntax_error(code: pd.Series) -> pd.Series:
    """Why source text does not parse, or null. It is parsed, never run."""

    def check(source):
        if source is None:
            return None
        try:
            ast.parse(source)
        except (SyntaxError, ValueError, RecursionError, MemoryError) as exc:
            line = getattr(exc, "lineno", None)
            return f"{type(exc).__name__}: {getattr(exc, 'msg', exc)} (line {line})"
        return None

    return code.map(check)


def check_code(rows: DataFrame, text: str = "generation", function: str = "transform") -> DataFrame:
    """Add code, syntax_error and format_status: valid, no_transform_emitted or unparseable_code."""
    coded = rows.withColumn("code", tx.extract_code(F.col(text), function))
    return coded.withColumn("syntax_error", syntax_error("code")).withColumn(
        "format_status",
        F.when(F.col("code").isNull(), "no_transform_emitted")
        .when(F.col("syntax_error").isNotNull(), "unparseable_code").otherwise("valid"))


def score_rows(joined: DataFrame) -> DataFrame:
    """Final status and tri-state `solved` of joined, checked and executed rows.

    Needs status, format_status, bad_prompt, shown_pass, shown_pairs, heldout_pass (null where no
    held-out pair exists). `solved` stays null where a data defect, not the model, is to blame.
    """
    invalid = F.col("format_status") != "valid"
    solved = F.coalesce("shown_pass", F.lit(False))
    status = (
        F.when(F.col("status").isNotNull(), F.col("status"))
        .when(invalid, F.col("format_status"))
        .when(F.col("bad_prompt").isNotNull(), F.concat(F.lit("bad_prompt: "), "bad_prompt"))
        .when(F.coalesce("shown_pairs", F.lit(0)) == 0, "no_pairs_in_prompt")
        .when(solved & F.col("heldout_pass").eqNullSafe(False), "solved_shown_only")
        .when(solved, "solved").otherwise("failed_verification"))
    judged = joined.withColumn("status", status)
    measured = F.col("status").isin("solved", "solved_shown_only", "failed_verification")
    return judged.withColumns({
        "solved": F.when(measured, F.col("status") != "failed_verification").when(
            F.col("status").isin("no_transform_emitted", "unparseable_code"), F.lit(False)),
        "heldout_solved": F.when(measured, F.col("heldout_pass")),
    })


def score_report(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts and rates of a run: headline, held-out block and prompt-truncation block.

    Held-out and intact-prompt figures are null when nothing was measured; the headline rates
    read 0 over 0 as 0.
    """
    return score_rates(score_counts(scored, keys))


def score_counts(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The counts the report is made of; counts of parts of a run add up."""
    solved, known = F.col("solved"), F.col("solved").isNotNull()
    held = F.col("heldout_solved").isNotNull()
    cut = F.coalesce("prompt_truncated", F.lit(False)) & (F.col("status") != "no_matching_val_row")
    bad_format = F.col("status").isin("no_transform_emitted", "unparseable_code")
    valid = F.col("status") != "no_matching_val_row"
    return scored.groupBy(*keys).agg(
        F.count("*").alias("n_generations"),
        count_where(known).alias("n_scored"),
        count_where(valid & ~bad_format).alias("n_format_valid"),
        count_where(solved).alias("n_solved"),
        count_where(bad_format & F.coalesce("truncated", F.lit(False))).alias("n_truncated_format_failures"),
        count_where(F.col("status") == "unparseable_code").alias("n_unparseable"),
        count_where(cut).alias("n_prompt_truncated"),
        count_where(cut & solved).alias("_cut_solved"),
        count_where(held).alias("n_heldout_scored"),
        count_where(F.col("heldout_solved")).alias("n_heldout_solved"),
        count_where(held & solved).alias("_shown_in_subset"),
        count_where(solved & (F.col("heldout_solved") == False)).alias("n_solved_shown_only"),  # noqa: E712
    )


def score_rates(sums: DataFrame) -> DataFrame:
    """The score report of counts."""
    rate = lambda a, b: F.when(F.col(b) != 0, F.col(a) / F.col(b)).otherwise(0.0)
    intact = F.col("n_scored") - F.col("n_prompt_truncated")
    held_rate = ratio(F.col("n_heldout_solved"), F.col("n_heldout_scored"))
    subset = ratio(F.col("_shown_in_subset"), F.col("n_heldout_scored"))
    return sums.withColumns({
        "solve_rate": rate("n_solved", "n_scored"), "format_valid_rate": rate("n_format_valid", "n_scored"),
        "heldout_solve_rate": held_rate, "solve_rate_on_heldout_subset": subset, "overfit_gap": subset - held_rate,
        "n_scored_intact_prompts": F.when(F.col("n_prompt_truncated") > 0, intact),
        "solve_rate_intact_prompts": F.when(
            F.col("n_prompt_truncated") > 0,
            F.when(intact != 0, (F.col("n_solved") - F.col("_cut_solved")) / intact).otherwise(0.0)),
        "n_solved_shown_only": F.when(F.col("n_heldout_scored") > 0, F.col("n_solved_shown_only")),
        "n_heldout_solved": F.when(F.col("n_heldout_scored") > 0, F.col("n_heldout_solved")),
    }).drop("_cut_solved", "_shown_in_subset")


def pass_at_k(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per-task rates over k attempts; all null when every task had a single attempt.

    The submitted attempt is chosen blind to the held-out answer: the lowest-numbered one that
    solved the shown pairs, else the lowest-numbered.
    """
    solved = F.coalesce("solved", F.lit(False))
    tasks = scored.where(F.col("solved").isNotNull()).groupBy(*keys, "task_id", F.coalesce("variant", F.lit("")).alias("variant")).agg(
        F.count("*").alias("k"), F.bool_or("solved").alias("any_shown"), F.bool_or("heldout_solved").alias("any_held"),
        F.min_by(F.struct(F.col("heldout_solved").alias("h")), F.struct(~solved, F.coalesce("sample_idx", F.lit(0)))).alias("_sent"))
    has = F.col("any_held").isNotNull()
    sums = tasks.groupBy(*keys).agg(
        F.count("*").alias("n_tasks"), F.max("k").alias("samples_per_task"), F.min("k").alias("_least"),
        count_where(F.col("any_shown")).alias("_shown"), count_where(has).alias("n_tasks_with_heldout"),
        count_where(F.col("any_held")).alias("_oracle"), count_where(has & F.col("_sent.h")).alias("_selected"))
    many = F.col("samples_per_task") > 1
    n, h = F.col("n_tasks"), F.col("n_tasks_with_heldout")
    best, sent = ratio(F.col("_oracle"), h), ratio(F.col("_selected"), h)
    return sums.select(
        *keys, "n_tasks", F.when(many, F.col("samples_per_task")).alias("samples_per_task"),
        (many & (F.col("_least") < F.col("samples_per_task"))).alias("ragged"),
        F.when(many, F.col("_shown") / n).alias("shown_pass_at_k"),
        F.when(many & (h > 0), h).alias("n_tasks_with_heldout"),
        F.when(many, best).alias("pass_at_k"), F.when(many, sent).alias("selected_at_k"),
        F.when(many, best - sent).alias("selection_loss"))


def pick_metric(left: str, right: str | None = None) -> Column:
    """The hardest metric every present side has; per-task pass@k only at equal k.

    `left` and `right` are struct columns holding the reports; a null right side is absent.
    """
    k = lambda side: F.coalesce(F.col(f"{side}.samples_per_task"), F.lit(1))
    out = F.lit(FALLBACK)
    for metric in reversed(METRICS):
        have = F.col(f"{left}.{metric}").isNotNull()
        if right:
            absent = F.col(right).isNull()
            have = have & (absent | F.col(f"{right}.{metric}").isNotNull())
            if metric == "selected_at_k":
                have = have & (absent | (k(left) == k(right)))
        out = F.when(have, metric).otherwise(out)
    return out


def _value(side: str) -> Column:
    out = F.lit(None).cast("double")
    for metric in METRICS:
        out = F.when(F.col("metric") == metric, F.col(f"{side}.{metric}")).otherwise(out)
    return out


def gate_vs_baseline(pairs: DataFrame, gate_ratio: float = 0.8, student: str = "student", teacher: str = "teacher") -> DataFrame:
    """Student against `gate_ratio` of the teacher on the metric both support; no teacher, no verdict."""
    rows = pairs.withColumn("metric", pick_metric(student, teacher))
    rows = rows.withColumns({"student_rate": _value(student), "teacher_rate": _value(teacher)})
    absent = F.col(teacher).isNull()
    rows = rows.withColumn("threshold", F.when(~absent, gate_ratio * F.col("teacher_rate")))
    passed = F.when(~absent, F.col("student_rate") >= F.col("threshold"))
    return rows.withColumns({
        "passed": passed,
        "gate_status": F.when(absent, "NO_TEACHER_BASELINE").when(passed, "PASSED").otherwise("FAILED"),
        "baseline_caveat": F.when(F.col("teacher_rate") >= DEGENERATE, "degenerate").when(F.col("teacher_rate") == 0, "no signal"),
    })


def lift(pairs: DataFrame, student: str = "student", base: str = "base") -> DataFrame:
    """Gain over the same model before fine-tuning, with its verdict."""
    rows = pairs.where(F.col(base).isNotNull()).withColumn("metric", pick_metric(student, base))
    rows = rows.withColumns({"student_rate": _value(student), "base_rate": _value(base)})
    s, b = F.col("student_rate"), F.col("base_rate")
    return rows.withColumns({
        "absolute_gain": s - b, "relative_gain": F.when(b != 0, (s - b) / b),
        "verdict": F.when((s == 0) & (b == 0), "both zero").when(s > b, "improved").when(s == b, "no change").otherwise("REGRESSION"),
        "sampling_differs": F.coalesce(F.col(f"{student}.samples_per_task"), F.lit(1)) != F.coalesce(F.col(f"{base}.samples_per_task"), F.lit(1)),
    })


# ---- generations -------------------------------------------------------------------------

def trim_new_tokens(ids: Column, stops: Sequence[int], pad: int | None, limit: int) -> tuple[Column, Column]:
    """(length, truncated) of generated ids: up to the first stop id, else without trailing pads."""
    spots = F.array(*[F.array_position(ids, F.lit(s)) for s in stops])
    stop = F.array_min(F.filter(spots, lambda p: p > 0))
    if pad is None:
        kept = F.size(ids)
    else:
        kept = F.aggregate(
            F.transform(ids, lambda t, i: F.when(t == pad, 0).otherwise(i + 1)), F.lit(0), lambda acc, x: F.greatest(acc, x))
    length = F.coalesce(stop, kept.cast("long"))
    return length, stop.isNull() & (kept >= limit)


def generation_stats(attempts: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Tasks, solves, attempts, tokens, time and cost per dataset.

    `attempts`: dataset, task_id, attempt, solved, input_tokens, output_tokens, seconds, cost_usd.
    """
    tasks = attempt_counts(attempts, dataset)
    per = tasks.groupBy(dataset).agg(
        F.count("*").alias("tasks"), count_where(F.col("first_success").isNotNull()).alias("solved"),
        F.sum("attempts").alias("attempts"), F.sum("first_success").alias("_to_success"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("seconds").cast("double").alias("seconds"), F.sum("cost_usd").cast("double").alias("cost_usd"))
    return per.withColumns({
        "solve_rate": ratio(F.col("solved"), F.col("tasks")),
        "mean_attempts_to_success": ratio(F.col("_to_success"), F.col("solved")),
    }).drop("_to_success")


def attempt_counts(attempts: DataFrame, dataset: str = "dataset") -> DataFrame:
    money = lambda c: F.sum(F.col(c).cast("decimal(30,12)"))
    return attempts.groupBy(dataset, "task_id").agg(
        F.count("*").alias("attempts"), F.min(F.when(F.col("solved"), F.col("attempt"))).alias("first_success"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        money("seconds").alias("seconds"), money("cost_usd").alias("cost_usd"))


def attempt_histogram(attempts: DataFrame, dataset: str = "dataset") -> DataFrame:
    solved = F.col("first_success").isNotNull()
    return attempt_counts(attempts, dataset).groupBy(dataset, solved.alias("solved"), "attempts").agg(F.count("*").alias("n_tasks"))


def generation_run_summary(generations: DataFrame, run: str = "run_id", settings: Sequence[str] = ()) -> DataFrame:
    """Volume and coverage per run, beside the settings the run was made with."""
    return generations.groupBy(run).agg(
        F.count("*").alias("n_written"), count_where(F.col("truncated")).alias("n_truncated"),
        count_where(F.col("prompt_truncated")).alias("n_prompt_truncated"),
        F.countDistinct("task_id", F.coalesce("variant", F.lit(""))).alias("n_prompts"),
        *[F.max(c).alias(c) for c in settings])


def run_comparability(pairs: DataFrame, left: str, right: str, settings: Sequence[str]) -> DataFrame:
    """Names of the settings two runs differ in; comparable when there are none.

    `pairs` holds both runs as struct columns, the digests among their fields.
    """
    off = F.array(*[F.when(~F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")), F.lit(c)) for c in sorted(settings)])
    differing = F.filter(off, lambda x: x.isNotNull())
    return pairs.withColumn("differing", differing).withColumn("comparable", F.size("differing") == 0)
