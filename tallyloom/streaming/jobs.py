"""Structured Streaming forms of the scheduled sweeps, built on the batch operators.

Per-key state is kept small and rows are folded before the stateful step, so a run that sends a
third of all events does not send them one by one through a single task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyloom.operators import scoring, telemetry
from tallyloom.session import fresh_path
from tallyloom.streaming.tables import BUCKET, KeyedTable, bucket_of

SEGMENTS = "key string, first_s double, last_s double, ended boolean, at timestamp"
SILENCE = "key string, action string, silent_since_s double, deadline_s double, n int"
SILENCE_STATE = "last_s double, n int"
NO_CAP = 1 << 30


# ---- running a job -----------------------------------------------------------------------

def drain_to_table(stream: DataFrame, name: str, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run an append-mode stream over what is available and return what it wrote.

    With `path` and `checkpoint` a later call goes on where this one ended.
    """
    spark = stream.sparkSession
    path = path or fresh_path(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint or f"{path}-checkpoint").trigger(availableNow=True).start(path))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def drain_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> list:
    """Run a stream over what is available, batch by batch; its progress reports."""
    query = (
        stream.writeStream.foreachBatch(each).outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return list(query.recentProgress)


# ---- silence: liveness and missing invocations -------------------------------------------

def _segments(gap_s: float):
    """Fold the beats of one Arrow batch to stretches without a gap of `gap_s`."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if rows.empty:
                continue
            seconds = rows["ts"].astype("int64") / (10 ** {"ns": 9, "us": 6, "ms": 3}[rows["ts"].dt.unit])
            rows = rows.assign(s=seconds).sort_values(["key", "s"], ignore_index=True)
            cut = (rows["s"].diff() >= gap_s) | (rows["key"] != rows["key"].shift())
            parts = rows.groupby([rows["key"], cut.cumsum()], sort=False)
            out = parts.agg(first_s=("s", "min"), last_s=("s", "max"), ended=("ended", "any"), at=("ts", "max"))
            yield out.reset_index(level=0).reset_index(drop=True)[["key", "first_s", "last_s", "ended", "at"]]

    return fold


def silence_step(last: float | None, n: int, until: float, gap_s: float, cap: int):
    """Actions due between the last beat and `until`: (rows, last claim, count, gone).

    A claim moves the clock on by one gap, so each silence is claimed once; past the cap the key
    is escalated once and forgotten.
    """
    rows = []
    while last is not None and until - last >= gap_s:
        deadline = last + gap_s
        if n >= cap:
            rows.append(("escalate", last, deadline, n))
            return rows, None, 0, True
        n += 1
        rows.append(("resurrect", last, deadline, n))
        last = deadline
    return rows, last, n, False


def silence_monitor(beats: DataFrame, gap_s: float, delay: str, cap: int = NO_CAP) -> DataFrame:
    """Stream of actions for keys that fall silent.

    `beats`: key, ts (TIMESTAMP), ended. Uses an event-time timeout, so silence is noticed
    without a row arriving for the key. An ended key is forgotten.
    """
    folded = (
        beats.select(F.col("key").cast("string").alias("key"), "ts", F.col("ended").cast("boolean").alias("ended"))
        .mapInPandas(_segments(gap_s), SEGMENTS).withWatermark("at", delay))

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState):
        last, n = state.get if state.exists else (None, 0)
        rows, gone = [], False
        if state.hasTimedOut:
            more, last, n, gone = silence_step(last, n, state.getCurrentWatermarkMs() / 1000, gap_s, cap)
            rows += more
        else:
            stretches = pd.concat(list(frames)).sort_values("first_s")
            for part in stretches.itertuples():
                more, last, n, _ = silence_step(last, n, part.first_s, gap_s, cap)
                rows += more
                last = part.last_s if last is None else max(last, part.last_s)
            gone = bool(stretches["ended"].any())
        if gone or last is None:
            if state.exists:
                state.remove()
        else:
            state.update((float(last), int(n)))
            due = int((last + gap_s) * 1000) + 1
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(
            [(key[0], *r) for r in rows],
            columns=["key", "action", "silent_since_s", "deadline_s", "n"])

    return folded.groupBy("key").applyInPandasWithState(
        step, SILENCE, SILENCE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def liveness_monitor(beats: DataFrame, delay: str = "0 seconds") -> DataFrame:
    return silence_monitor(beats, telemetry.STALE_MINUTES * 60, delay, telemetry.RESURRECTION_CAP)


# ---- windows -----------------------------------------------------------------------------

def error_alarm_stream(metrics: DataFrame, delay: str, period: str = "5 minutes", threshold: float = 1.0) -> DataFrame:
    """Tumbling sums of the error metric that reach the threshold; a missing window is fine."""
    return (
        metrics.where(F.col("metric") == "Errors").withWatermark("ts", delay)
        .groupBy(F.window("ts", period).alias("w"), "owner").agg(F.sum("value").alias("value"))
        .where(F.col("value") >= threshold)
        .select("owner", F.col("w.start").alias("window_start"), "value"))


def daily_metric_stream(metrics: DataFrame, delay: str, metric: str = "Invocations") -> DataFrame:
    return (
        metrics.where(F.col("metric") == metric).withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day").alias("w"), "owner").agg(F.sum("value").alias("value"))
        .select("owner", F.to_date("w.start").alias("day"), "value"))


def turn_session_stream(turns: DataFrame, delay: str, gap: str, keys: Sequence[str] = ("run_id", "stage", "task")) -> DataFrame:
    return (
        turns.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("turns"))
        .select(*keys, F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "turns"))


def unanswered_pages(pages: DataFrame, answers: DataFrame, delay: str, within: str) -> DataFrame:
    """Pages no directive answers within the horizon: a stream-stream left outer join.

    A page is emitted once the watermark proves that no answer can still arrive.
    """
    p = pages.select("run_id", F.col("ts").alias("paged_at")).withWatermark("paged_at", delay)
    a = answers.select(F.col("run_id").alias("_run"), F.col("ts").alias("answered_at")).withWatermark("answered_at", delay)
    inside = (
        (F.col("run_id") == F.col("_run")) & (F.col("answered_at") >= F.col("paged_at"))
        & (F.col("answered_at") <= F.col("paged_at") + F.expr(f"INTERVAL {within}")))
    return p.join(a, inside, "leftOuter").where(F.col("_run").isNull()).select("run_id", "paged_at")


# ---- folds over tables -------------------------------------------------------------------

PROTOCOL_KEYS = ("run_id", "stage", "task", "epoch")
BUCKETS = 32


def _once(rows: DataFrame, identity: Sequence[str], delay: str) -> DataFrame:
    """Rows without repeats of their identity; what is remembered leaves `delay` after its time."""
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(identity))


def _ddl(rows: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), *more])


def protocol_counters(rows: DataFrame, arrival: str, path: str, delay: str, checkpoint: str | None = None, keys: Sequence[str] = PROTOCOL_KEYS, buckets: int = BUCKETS) -> list:
    """Running form of the monotonic upsert into a table: the changed keys' buckets are merged.

    `rows` hold `ts`, the keys, `turns` and `arrival`. Replays and late smaller counters change
    nothing. The stream remembers counters of `delay` only; a row older than the newest by more
    than that is dropped. With `checkpoint` a later call goes on where this one ended.
    """
    table = KeyedTable(rows.sparkSession, path, _ddl(rows, f"{BUCKET} int"), [BUCKET])
    checkpoint = checkpoint or fresh_path(rows.sparkSession, "counters-checkpoint")
    best = lambda df: telemetry.monotonic_upsert(df, arrival, keys).withColumn(BUCKET, bucket_of(keys, buckets))

    def each(batch: DataFrame, number: int) -> None:
        table.merge(best(batch), number, checkpoint, lambda known, new: best(known.unionByName(new).drop(BUCKET)))

    return drain_batches(_once(rows, [*keys, "turns", arrival], delay), each, checkpoint)


def score_counts(scored: DataFrame, keys: Sequence[str], identity: Sequence[str], path: str, delay: str, checkpoint: str | None = None, buckets: int = BUCKETS) -> list:
    """Add up a run's score counts as its rows arrive; `read_scores` gives the report so far.

    `scored` holds `ts`. Rows of one `identity` count once while it is remembered, for `delay`;
    an older row than that is dropped. A batch that is run again is not added twice.
    """
    spark, keys = scored.sparkSession, list(keys)
    empty = scoring.score_counts(spark.createDataFrame([], scored.schema), keys)
    table = KeyedTable(spark, path, _ddl(empty, f"{BUCKET} int"), [BUCKET])
    checkpoint = checkpoint or fresh_path(spark, "scores-checkpoint")
    sums = [c for c in empty.columns if c not in keys]

    def each(batch: DataFrame, number: int) -> None:
        new = scoring.score_counts(batch, keys).withColumn(BUCKET, bucket_of(keys or [F.lit(0)], buckets))
        table.merge(new, number, checkpoint, lambda known, more: known.unionByName(more).groupBy(*keys, BUCKET).agg(*[F.sum(c).alias(c) for c in sums]))

    return drain_batches(_once(scored, identity, delay), each, checkpoint)


def read_scores(scored: DataFrame, keys: Sequence[str], path: str) -> DataFrame:
    """The score report of the counts that `score_counts` has written; `scored` gives the columns."""
    spark = scored.sparkSession
    empty = scoring.score_counts(spark.createDataFrame([], scored.schema), keys)
    table = KeyedTable(spark, path, _ddl(empty, f"{BUCKET} int"), [BUCKET])
    return scoring.score_rates(table.read().drop(BUCKET))


LEDGER = "run_id bigint, category string, cost_usd double, settlement string, read_on date, job string, origin string, project string, period date"


def settle_ledger(bills: DataFrame, path: str, name: str = "ledger", checkpoint: str | None = None) -> list:
    """Keep, per (project, period), the rows of its newest read.

    `bills`: project, period, run_id, category, cost_usd, settlement, read_on. Rows of one read may
    come in several batches, and an older read that comes late replaces nothing. Batches run again
    change nothing. With `checkpoint` a later call goes on where this one ended. Without it a call
    reads its whole input again, so in what it touches it replaces what earlier calls of the same
    `name` wrote; sources of different names share the ledger.
    """
    columns = [c.split()[0] for c in LEDGER.split(", ")]
    given = [c for c in columns if c not in ("job", "origin")]
    table = KeyedTable(bills.sparkSession, path, LEDGER, ["project", "period"])
    checkpoint = checkpoint or fresh_path(bills.sparkSession, f"{name}-checkpoint")
    again = F.col("job").eqNullSafe(name) & ~F.col("origin").eqNullSafe(checkpoint)

    def newest(known: DataFrame, new: DataFrame) -> DataFrame:
        rows = known.where(~again).unionByName(new)
        latest = rows.groupBy(F.col("project").alias("_p"), F.col("period").alias("_d")).agg(F.max("read_on").alias("_read"))
        same = F.col("project").eqNullSafe(F.col("_p")) & F.col("period").eqNullSafe(F.col("_d")) & F.col("read_on").eqNullSafe(F.col("_read"))
        return rows.join(latest, same, "left_semi")

    def each(batch: DataFrame, number: int) -> None:
        tagged = batch.select(*given).withColumns({"job": F.lit(name), "origin": F.lit(checkpoint)})
        table.merge(tagged.select(*columns), number, checkpoint, newest)

    return drain_batches(bills, each, checkpoint)


# ---- a state machine per execution -------------------------------------------------------

FAILURES = "execution bigint, event_id bigint, current_state string, error string"


def attribute_step(known: tuple | None, rows: pd.DataFrame) -> tuple[pd.DataFrame, tuple | None]:
    """(failures with the state entered last before each, the state known afterwards)."""
    rows = rows.sort_values("event_id", kind="stable")
    entered, failed = rows[rows["kind"] == "entered"], rows[rows["kind"].isin(["failed", "timed_out"])]
    ids, states = entered["event_id"].to_numpy(), entered["state"].to_numpy()
    if known:
        at = int(np.searchsorted(ids, known[0]))
        ids, states = np.insert(ids, at, known[0]), np.insert(states, at, known[1])
    place = np.searchsorted(ids, failed["event_id"].to_numpy(), "right") - 1
    current = [states[p] if p >= 0 else None for p in place]
    out = failed[["event_id", "error"]].assign(current_state=current)[["event_id", "current_state", "error"]]
    return out, ((int(ids[-1]), states[-1]) if len(ids) else None)


def stage_attribution(history: DataFrame, delay: str, idle_s: float, ended: Sequence[str] = ("ended",)) -> DataFrame:
    """Stream of failures with the state their execution had entered last, across batches.

    `history`: execution, event_id, ts, kind, state, error; an execution's events arrive in order
    but for those of one batch. The state kept is one (event, state) per running execution: it
    leaves on an event of a kind in `ended`, or when `idle_s` of event time pass without one.
    A batch's events of one execution are one task's work, so bound batches at the source.
    """
    kinds = ["entered", "failed", "timed_out", *ended]
    rows = history.where(F.col("kind").isin(*kinds)).select("execution", "event_id", "ts", "kind", "state", "error").withWatermark("ts", delay)

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        batch = pd.concat(list(frames))
        out, known = attribute_step(state.get if state.exists else None, batch)
        if known is None or batch["kind"].isin(ended).any():
            if state.exists:
                state.remove()
        else:
            state.update(known)
            newest = int(batch["ts"].max().timestamp() * 1000 + idle_s * 1000)
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs() + 1))
        if len(out):
            yield out.assign(execution=key[0])[["execution", "event_id", "current_state", "error"]]

    return rows.groupBy("execution").applyInPandasWithState(
        step, FAILURES, "event_id long, state string", "append", GroupStateTimeout.EventTimeTimeout)
