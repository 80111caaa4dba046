"""Run telemetry: stage flow, timelines, waiting states, protocol SLIs, liveness, alarms, drift."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.stats import (
    count_where,
    order_statistics,
    quantile_position,
    ratio,
    running_safe_sum,
    wilson,
)
from tallyloom.operators.ordering import carry_forward, newest

# Fixed stage order and the state names that enter each stage.
STAGES = (
    "data-prep-generate", "data-prep-curate", "finetune-launch", "finetune-analyze",
    "eval-gate", "deploy", "smoke", "teardown", "complete",
)
STATE_TO_STAGE = {
    "DataPrepGenerate": "data-prep-generate", "DataPrepCurate": "data-prep-curate",
    "FinetuneLaunch": "finetune-launch", "FinetuneAnalyze": "finetune-analyze",
    "RemediateFinetune": "finetune-launch", "EvalGate": "eval-gate", "Deploy": "deploy",
    "SmokeTest": "smoke", "Teardown": "teardown", "Complete": "complete",
}
ITERATION_STATE = "IncrementIteration"
ESCALATION_ERRORS = ("EscalatedToHuman",)
UNREACHABLE = ("escalated", "failed", "completed", "stopped")
PAGE_EVENT, WAIT_EVENT, WAIT_ROW_CAP = "HumanPaged", "WaitingOnHuman", 12
PROTOCOL_COUNTERS = (
    "turns", "serviced_turns", "prose_turns", "filtered_turns_total", "recovered_typed_calls",
    "recovered_ending_in_prose", "infra_error_turns_total", "deadline_cuts",
)
PASS_STATE = "completed"
STALE_MINUTES, RESURRECTION_CAP = 20, 5
ERROR_PERIOD_S = 300
WARMUP_STEPS = 3


def starts_with_any(col: Column, prefixes: Sequence[str]) -> Column:
    out = F.lit(False)
    for prefix in prefixes:
        out = out | col.startswith(prefix)
    return out


def lookup(col: Column, mapping: dict[str, str]) -> Column:
    """Small fixed dictionary as an expression; null for anything else."""
    out = F.lit(None).cast("string")
    for key, value in mapping.items():
        out = F.when(col == key, value).otherwise(out)
    return out


# ---- stage flow --------------------------------------------------------------------------

def attribute_errors(history: DataFrame, chunk: Column) -> DataFrame:
    """Add, per history row, its own stage and the state most recently entered."""
    entered = F.when(F.col("kind") == "entered", F.col("state"))
    tagged = history.withColumn("_entered", entered)
    return carry_forward(
        tagged, ["execution"], ["event_id"], chunk, {"current_state": "_entered"}
    ).drop("_entered")


def stage_flow(
    history: DataFrame,
    executions: DataFrame,
    stages: Sequence[str] = STAGES,
    state_to_stage: dict[str, str] = STATE_TO_STAGE,
    escalations: Sequence[str] = ESCALATION_ERRORS,
    chunk: Column | None = None,
) -> DataFrame:
    """Status of every logical stage of every execution.

    `history`: execution, event_id, ts, kind (entered|exited|failed|timed_out), state, error,
    cause; `executions`: execution, status. Failures belong to the state last entered.
    """
    chunk = F.floor(F.col("event_id") / 100_000) if chunk is None else chunk
    rows = attribute_errors(history, chunk).where(
        F.col("kind").isin("entered", "exited", "failed", "timed_out")
    )
    failing = F.col("kind").isin("failed", "timed_out")
    own = F.when(failing, F.col("current_state")).otherwise(F.col("state"))
    rows = rows.withColumn("stage", lookup(own, state_to_stage)).where(F.col("stage").isNotNull())
    entered, left = F.col("kind") == "entered", F.col("kind") == "exited"
    per_stage = rows.groupBy("execution", "stage").agg(
        count_where(entered).alias("entered"),
        count_where(left).alias("exited"),
        F.max_by(F.when(entered, F.col("state")), F.when(entered, F.col("event_id"))).alias("state"),
        F.min_by("ts", F.when(entered, F.col("event_id"))).alias("entered_at"),
        F.max_by("ts", F.when(left, F.col("event_id"))).alias("exited_at"),
        F.max_by(F.struct("error", "cause"),
                 F.when(failing, F.col("event_id"))).alias("_err"),
        F.max(F.when(entered, F.col("event_id"))).alias("_last_in"),
    )
    ends = per_stage.groupBy("execution").agg(F.max_by("stage", "_last_in").alias("last_entered"))
    grid = executions.select(
        "execution", F.col("status").alias("execution_status"),
        F.posexplode(F.array(*[F.lit(s) for s in stages])).alias("stage_order", "stage"),
    )
    joined = grid.join(per_stage, ["execution", "stage"], "left").join(ends, "execution", "left")
    n_in, n_out = F.coalesce("entered", F.lit(0)), F.coalesce("exited", F.lit(0))
    terminal = F.col("execution_status") != "RUNNING"
    stop = F.when(F.col("_err.error").isin(*escalations), "escalated").otherwise("failed")
    stopped_here = (
        terminal
        & (F.col("execution_status") != "SUCCEEDED")
        & F.col("stage").eqNullSafe(F.col("last_entered"))
    )
    status = (
        F.when(stopped_here, stop)
        .when(n_in == 0, F.when(terminal, "skipped").otherwise("pending"))
        .when(n_out >= n_in, "succeeded")
        .when(~terminal, "running")
        .otherwise(stop)
    )
    return joined.select(
        "execution", "stage_order", "stage", status.alias("status"), n_in.alias("attempts"),
        "state", "entered_at", "exited_at", F.col("_err.error").alias("error"),
        F.col("_err.cause").alias("cause"),
    )


def iterations(history: DataFrame, state: str = ITERATION_STATE) -> DataFrame:
    return history.where((F.col("kind") == "entered") & (F.col("state") == state)).groupBy(
        "execution"
    ).agg(F.count("*").alias("iterations"))


# ---- timeline and human waits ------------------------------------------------------------

def timeline_newest(events: DataFrame, limit: int, kind: str = "event") -> DataFrame:
    """Newest `limit` events per run, numbered in time order, and whether older ones exist."""
    rows = events.where(F.col("kind") == kind)
    order = [F.col("ts").desc(), F.col("event_id").desc()]
    cut = newest(rows, ["run_id"], order, limit)
    shown = F.col("shown") - F.col("position") + 1
    sizes = cut.groupBy("run_id").agg(F.count("*").alias("shown"))
    return (
        cut.join(sizes, "run_id")
        .withColumn("position", shown)
        .withColumnRenamed("truncated", "older_exist")
        .drop("shown")
    )


def directives(events: DataFrame, limit: int) -> DataFrame:
    """Parked verdicts, split from the events before any limit so each has its own budget."""
    return timeline_newest(events, limit, "directive")


def waiting_on_human(events: DataFrame, parked: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs blocked on a person now.

    `events`: run_id, ts, stage, name, waiting_turn; `parked`: run_id, ts; `runs`: run_id, status.
    A directive at or after the latest page ends the wait; so does a run that has ended.
    """
    pages = (
        events.where(F.col("name") == PAGE_EVENT)
        .groupBy("run_id")
        .agg(F.max(F.struct("ts", "stage")).alias("page"))
        .select("run_id", F.col("page.ts").alias("since"), F.col("page.stage").alias("stage"))
    )
    last_word = parked.groupBy("run_id").agg(F.max("ts").alias("answered_at"))
    open_pages = (
        pages.join(last_word, "run_id", "left")
        .where(F.col("answered_at").isNull() | (F.col("answered_at") < F.col("since")))
        .join(runs.select("run_id", "status"), "run_id", "left")
        .where(~starts_with_any(F.coalesce("status", F.lit("")), UNREACHABLE))
    )
    waits = events.where(F.col("name") == WAIT_EVENT).select("run_id", "ts", "waiting_turn")
    turns = (
        waits.join(open_pages.select("run_id", "since"), "run_id")
        .where(F.col("ts") >= F.col("since"))
        .groupBy("run_id")
        .agg(F.max("waiting_turn").alias("turns"))
    )
    n = F.coalesce("turns", F.lit(0))
    return open_pages.join(turns, "run_id", "left").select(
        "run_id", "since", "stage", n.alias("turns"), (n >= WAIT_ROW_CAP).alias("turns_are_floor")
    )


def directive_delivery(runs: DataFrame, parked: DataFrame) -> DataFrame:
    """Whether each run can still hear a verdict, and which undelivered one it hears next.

    A run with no row is treated as reachable. The oldest undelivered directive is next.
    """
    known = parked.join(runs.select("run_id", "status"), "run_id", "left")
    deliverable = ~starts_with_any(F.coalesce("status", F.lit("")), UNREACHABLE)
    waiting = ~F.coalesce("delivered", F.lit(False))
    first = (
        parked.where(waiting)
        .groupBy("run_id")
        .agg(F.min(F.struct("ts", "directive_id")).alias("_first"))
        .select("run_id", F.col("_first.directive_id").alias("_next_id"))
    )
    return known.join(first, "run_id", "left").select(
        "run_id", "directive_id", deliverable.alias("deliverable"),
        (deliverable & waiting & (F.col("directive_id") == F.col("_next_id"))).alias("is_next"),
        (waiting & ~deliverable).alias("undeliverable"),
    )


# ---- protocol SLIs -----------------------------------------------------------------------

def monotonic_upsert(rows: DataFrame, arrival: str, keys: Sequence[str] = ("run_id", "stage", "task", "epoch")) -> DataFrame:
    """Latest absolute counters per key: most turns wins, the later arrival on ties."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct("turns", arrival)).alias("r")
    )
    return best.select(*keys, "r.*")


def protocol_rollup(rows: DataFrame, counters: Sequence[str] = PROTOCOL_COUNTERS) -> DataFrame:
    """Counter sums per stage and in total (stage null); unreadable counters read as zero."""
    tidy = rows.select(
        "stage",
        *[F.coalesce(F.expr(f"try_cast({c} AS bigint)"), F.lit(0)).alias(c) for c in counters],
    )
    sums = tidy.rollup("stage").agg(
        *[F.sum(c).alias(c) for c in counters], F.grouping("stage").alias("_total")
    )
    return sums.select(
        F.when(F.col("_total") == 1, F.lit("total")).otherwise(F.lit("stage")).alias("level"),
        "stage", *counters,
        ratio(F.col("serviced_turns"), F.col("turns")).alias("structured_call_rate"),
    )


def protocol_intervals(rollup: DataFrame) -> DataFrame:
    low, high = wilson(F.col("structured_call_rate"), F.col("turns"))
    return rollup.withColumns({"rate_low": low, "rate_high": high})


def runs_needed(target: float, alpha: float) -> int:
    if not 0 < target < 1 or not 0 < alpha < 1:
        raise ValueError("target and alpha must lie strictly between 0 and 1")
    return math.ceil(math.log(alpha) / math.log(target))


def slot_outcomes(slots: DataFrame, runs: DataFrame) -> DataFrame:
    """pass, fail or unknown per dispatched slot; an unknown is never guessed up."""
    status = F.coalesce("status", F.lit(""))
    outcome = (
        F.when(F.coalesce(F.col("run_id").cast("string"), F.lit("")) == "", "unknown")
        .when(status == PASS_STATE, "pass")
        .when(status.isin(*UNREACHABLE), "fail")
        .otherwise("unknown")
    )
    return slots.join(runs.select("run_id", "status"), "run_id", "left").withColumn(
        "outcome", outcome
    )


def reliability_probe(slots: DataFrame, runs: DataFrame, target: float, alpha: float) -> DataFrame:
    """Pass rate over decided slots with its interval and the verdict on the claimed target."""
    passes, fails = F.col("passes"), F.col("failures")
    decided = passes + fails
    needed = runs_needed(target, alpha)
    counts = slot_outcomes(slots, runs).agg(
        count_where(F.col("outcome") == "pass").alias("passes"),
        count_where(F.col("outcome") == "fail").alias("failures"),
        count_where(F.col("outcome") == "unknown").alias("unknown"),
    )
    rate = ratio(passes, decided)
    low, high = wilson(rate, decided)
    verdict = (
        F.when(fails > 0, "refuted")
        .when((F.col("unknown") > 0) | (passes < needed), "inconclusive")
        .otherwise("earned")
    )
    return counts.select(
        "passes", "failures", "unknown", decided.alias("decided"), rate.alias("run_rate"),
        low.alias("rate_low"), high.alias("rate_high"),
        F.lit(needed).cast("long").alias("needed"), verdict.alias("verdict"),
    )


# ---- liveness, alarms, fleet -------------------------------------------------------------

def liveness_action(age_minutes: Column, resurrections: Column, stale: float = STALE_MINUTES, cap: int = RESURRECTION_CAP) -> Column:
    """resurrect, escalate, or null; a null age is an unreadable beat and infinitely old."""
    quiet = age_minutes.isNull() | (age_minutes >= stale)
    return F.when(quiet & (resurrections >= cap), "escalate").when(quiet, "resurrect")


def liveness_sweep(runs: DataFrame, now: str, stale: float = STALE_MINUTES, cap: int = RESURRECTION_CAP) -> DataFrame:
    """Running runs whose driver went silent.

    Needs run_id, status, driver_beat_at (text), driver_beat_payload, task_token, resurrections.
    """
    beat = F.expr("try_cast(driver_beat_at AS timestamp)")
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(beat)) / 60
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    count = F.coalesce("resurrections", F.lit(0))
    return (
        runs.where(
            (F.col("status") == "running")
            & ~blank("driver_beat_at") & ~blank("driver_beat_payload") & blank("task_token")
        )
        .select("run_id", age.alias("age_minutes"), count.alias("resurrections"),
                liveness_action(age, count, stale, cap).alias("action"))
        .where(F.col("action").isNotNull())
    )


def fleet_metrics(metrics: DataFrame) -> DataFrame:
    """Per owner: sums (mean for Latency) and the error rate, zero when nothing ran."""
    total = lambda m: F.sum(F.when(F.col("metric") == m, F.col("value").cast("decimal(30,12)"))).cast("double")
    latency = F.when(F.col("metric") == "Latency", F.col("value").cast("decimal(30,12)"))
    out = metrics.groupBy("owner").agg(
        total("Invocations").alias("invocations"), total("Sessions").alias("sessions"),
        total("SystemErrors").alias("system_errors"), total("UserErrors").alias("user_errors"),
        total("Throttles").alias("throttles"),
        (F.sum(latency).cast("double") / F.count(latency)).alias("latency"),
    )
    errors = F.coalesce("system_errors", F.lit(0.0)) + F.coalesce("user_errors", F.lit(0.0))
    ran = F.coalesce("invocations", F.lit(0.0))
    return out.withColumn(
        "error_rate_pct", F.when(ran != 0, 100.0 * errors / ran).otherwise(0.0)
    )


def token_totals(usage: DataFrame) -> DataFrame:
    """Tokens by type (token_type, value); input and output are there even if nothing was used.

    A record without a type counts under `?`.
    """
    named = usage.select(F.coalesce("token_type", F.lit("?")).alias("token_type"), F.col("value").cast("decimal(30,12)").alias("value"))
    always = usage.sparkSession.createDataFrame([("input", None), ("output", None)], "token_type string, value decimal(30,12)")
    sums = named.unionByName(always).groupBy("token_type").agg(F.sum("value").alias("tokens"))
    return sums.select("token_type", F.coalesce(F.col("tokens").cast("double"), F.lit(0.0)).alias("tokens"))


def daily_series(metrics: DataFrame, metric: str) -> DataFrame:
    return (
        metrics.where(F.col("metric") == metric)
        .groupBy("owner", F.to_date("ts").alias("day"))
        .agg(F.sum(F.col("value").cast("decimal(30,12)")).cast("double").alias("value"))
    )


def bucket_start(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_timestamp(ts) / seconds) * seconds


def error_alarms(metrics: DataFrame, metric: str = "Errors", period_s: int = ERROR_PERIOD_S, threshold: float = 1.0) -> DataFrame:
    """Periods whose sum reaches the threshold; a missing period is fine."""
    return (
        metrics.where(F.col("metric") == metric)
        .groupBy("owner", bucket_start(F.col("ts"), period_s).alias("bucket"))
        .agg(F.sum("value").alias("value"))
        .where(F.col("value") >= threshold)
    )


def silence_alarms(metrics: DataFrame, watched: DataFrame, start: str, end: str, metric: str = "Invocations") -> DataFrame:
    """Windows without an invocation, one row per silent owner and bucket.

    `watched`: owner, period_s, periods. The time spine makes empty buckets exist; missing data
    breaches. An alarm needs `periods` silent buckets in a row, so each spine bucket looks at
    itself and the ones before it through its own copies of the activity, not through a window
    over the whole owner.
    """
    lo, hi = F.unix_timestamp(F.lit(start).cast("timestamp")), F.unix_timestamp(F.lit(end).cast("timestamp"))
    first = F.floor(lo / F.col("period_s")) * F.col("period_s")
    spine = watched.select(
        "owner", "period_s", "periods",
        F.explode(F.sequence(first, hi - 1, F.col("period_s"))).alias("bucket"),
    )
    active = (
        metrics.where((F.col("metric") == metric) & (F.col("value") > 0))
        .select("owner", "ts")
        .join(watched, "owner")
        .select("owner", "period_s", "periods",
                (F.floor(F.unix_timestamp("ts") / F.col("period_s")) * F.col("period_s")).alias("_b"))
        .distinct()
        .select("owner", F.explode(
            F.sequence(F.col("_b"), F.col("_b") + (F.col("periods") - 1) * F.col("period_s"), F.col("period_s"))
        ).alias("bucket"))
        .distinct()
    )
    complete = F.col("bucket") >= first + (F.col("periods") - 1) * F.col("period_s")
    return spine.withColumn("_ok", complete).where("_ok").join(
        active, ["owner", "bucket"], "left_anti"
    ).select("owner", "bucket")


def health(requests: DataFrame, rates: DataFrame, baseline: DataFrame, drift_ratio: float) -> DataFrame:
    """Endpoint health and drift against a baseline.

    `requests`: endpoint, latency_ms, status, output_tokens, output_chars; `rates`: endpoint,
    cost_usd; `baseline`: endpoint, output_chars. The drift flag is null without a baseline and
    only an exact true may raise an event.
    """
    sums = requests.groupBy("endpoint").agg(
        F.count("*").alias("invocations"),
        count_where(F.col("status").between(400, 499)).alias("n_4xx"),
        count_where(F.col("status") >= 500).alias("n_5xx"),
        F.sum("output_tokens").alias("output_tokens"),
        (F.sum("output_chars") / F.count("output_chars")).alias("mean_output_chars"),
    )
    tails = order_statistics(
        requests, ["endpoint"], "latency_ms",
        {"p50_ms": quantile_position(0.5), "p90_ms": quantile_position(0.9)}, 64,
    ).drop("n")
    shift = F.col("mean_output_chars") / F.col("baseline_chars") - 1
    return (
        sums.join(tails, "endpoint", "left")
        .join(rates, "endpoint", "left")
        .join(baseline.withColumnRenamed("output_chars", "baseline_chars"), "endpoint", "left")
        .select(
            "endpoint", "invocations", "p50_ms", "p90_ms",
            ratio(F.col("n_4xx"), F.col("invocations")).alias("rate_4xx"),
            ratio(F.col("n_5xx"), F.col("invocations")).alias("rate_5xx"),
            "output_tokens",
            ratio(F.col("cost_usd"), F.col("invocations")).alias("cost_per_invocation"),
            shift.alias("length_shift"),
            (F.abs(shift) > drift_ratio).alias("drift_detected"),
        )
    )


def drift_events(report: DataFrame) -> DataFrame:
    return report.where(F.col("drift_detected").eqNullSafe(True)).select("endpoint", "length_shift")


# ---- jobs and training logs --------------------------------------------------------------

def classify_stop(jobs: DataFrame) -> DataFrame:
    """A job stopped before a billed second ran out of capacity; it did not fail."""
    return jobs.withColumn(
        "outcome",
        F.when((F.col("status") == "Stopped") & (F.coalesce("billable_s", F.lit(0)) == 0), "capacity")
        .when(F.col("status").isin("Failed", "Stopped"), "failed")
        .when(F.col("status") == "Completed", "completed")
        .otherwise("running"),
    )


def latest_job_state(job_events: DataFrame) -> DataFrame:
    latest = job_events.groupBy("job_name").agg(
        F.max_by(F.struct("status", "failure_reason"), F.struct("ts", "event_id")).alias("j")
    )
    return latest.select(
        "job_name", F.col("j.status").alias("job_status"),
        F.col("j.failure_reason").alias("failure_reason"),
    )


def join_job_events(job_events: DataFrame, runs: DataFrame) -> DataFrame:
    """Latest state of every known job beside its run; unmatched jobs keep a null run."""
    return latest_job_state(job_events).join(
        runs.where(F.coalesce("job_name", F.lit("")) != "").select("run_id", "job_name"), "job_name", "left"
    ).withColumn("matched", F.col("run_id").isNotNull())


def step_timing(steps: DataFrame, warmup: int = WARMUP_STEPS, width: float = 1.0) -> DataFrame:
    """Step-time statistics per run, overall and after warm-up (overall when all is warm-up).

    `steps`: run_id, step (1-based), seconds.
    """
    steady = steps.where(F.col("step") > warmup)
    picks = {"p50": quantile_position(0.5), "p90": quantile_position(0.9)}
    whole = order_statistics(steps, ["run_id"], "seconds", picks, width)
    settled = order_statistics(steady, ["run_id"], "seconds", picks, width).select(
        "run_id", F.col("p50").alias("_p50"), F.col("p90").alias("_p90")
    )
    basics = steps.groupBy("run_id").agg(
        (running_safe_sum("seconds") / F.count("*")).alias("mean"),
        F.min_by("seconds", "step").alias("first_step"),
        F.max("step").alias("global_step"),
    )
    return (
        whole.join(settled, "run_id", "left").join(basics, "run_id")
        .select(
            "run_id", F.col("n").alias("n_steps"), "mean", "p50", "p90",
            F.coalesce("_p50", "p50").alias("p50_steady"),
            F.coalesce("_p90", "p90").alias("p90_steady"),
            "first_step", "global_step",
        )
    )


def completed_fraction(global_step: Column, max_steps: Column, intended: Column, capped: Column) -> Column:
    return F.when(capped, ratio(global_step, intended)).otherwise(ratio(global_step, max_steps))


def intended_steps(rows: Column, epochs: Column, batch: Column, accumulation: Column) -> Column:
    """Optimizer steps of a full run: one takes batch * accumulation rows."""
    per_step = F.greatest(F.lit(1), batch.cast("long") * accumulation.cast("long"))
    return F.greatest(F.lit(1), F.ceil(rows * epochs.cast("double") / per_step)).cast("long")


def training_progress(log: DataFrame, runs: DataFrame, width: float = 1.0) -> DataFrame:
    """The log's summary with step times and how much of each run was done.

    `runs`: run_id, n_rows, epochs, batch_size, accumulation, max_steps (the trainer's),
    max_steps_requested (above zero for a run cut to so many steps). A cut run is measured against
    the full one. `log` needs `seconds`.
    """
    known = training_log_summary(log).join(step_timing(log, width=width).drop("global_step"), "run_id", "left").join(runs, "run_id")
    intended = intended_steps(F.col("n_rows"), F.col("epochs"), F.col("batch_size"), F.col("accumulation"))
    capped = F.coalesce(F.col("max_steps_requested") > 0, F.lit(False))
    return known.withColumns({"intended_steps": intended, "step_capped": capped}).withColumn(
        "completed_fraction", completed_fraction(F.col("global_step"), F.col("max_steps"), F.col("intended_steps"), F.col("step_capped")))


def training_log_summary(log: DataFrame) -> DataFrame:
    """`log`: run_id, step, epoch, loss?, eval_loss?, rows_dropped?; absent values stay null."""
    has_loss, has_eval = F.col("loss").isNotNull(), F.col("eval_loss").isNotNull()
    return log.groupBy("run_id").agg(
        F.max_by("loss", F.when(has_loss, F.col("step"))).alias("final_train_loss"),
        (running_safe_sum("loss") / F.count("loss")).alias("mean_train_loss"),
        F.max_by("eval_loss", F.when(has_eval, F.col("step"))).alias("final_eval_loss"),
        F.max("rows_dropped").alias("rows_dropped"),
        F.max("step").alias("global_step"),
    )


def eval_loss_by_epoch(log: DataFrame) -> DataFrame:
    has_eval = F.col("eval_loss").isNotNull()
    return log.where(has_eval).groupBy("run_id", "epoch").agg(
        F.max_by("eval_loss", "step").alias("eval_loss")
    )
