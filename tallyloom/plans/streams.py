"""Streaming queries over the event files and the SQL that checks what they settle on."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import scoring
from tallyloom.plans.views import VIEWS, view_sql, with_views
from tallyloom.session import fresh_path
from tallyloom.streaming import jobs
from tallyloom.plans import evaluation, telemetry as _telemetry  # noqa: F401  (their views are used here)

DELAY = "1 hour"


def stream(spark, sf, name: str):
    """A view of one table as a file stream; naive timestamps are read as UTC instants."""
    base, columns = VIEWS[name]
    schema = spark.read.parquet(f"{sf}/{base}.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", f"{base}.parquet").parquet(sf)
    shown = raw.selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])
    return shown.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in columns else shown


VIEWS.update({
    "bills": ("lineitem", {
        "project": "'project-' || (l_suppkey % 4)", "period": "CAST(date_trunc('month', l_shipdate) AS DATE)", "run_id": "l_orderkey % 200", "category": "l_returnflag",
        "cost_usd": "l_extendedprice", "settlement": "CASE WHEN l_linestatus = 'F' THEN 'settled' ELSE 'provisional' END", "delay_days": "CAST(l_linenumber AS INTEGER)",
    }),
})
VIEWS.update({
    "protocol_events": ("events", {"ts": "ts", **VIEWS["protocol"][1]}),
    "executed_events": ("lineitem", {"ts": "l_shipdate", **VIEWS["executed"][1]}),
})
CUT = "(SELECT max(ts) - INTERVAL 1 HOUR FROM {})"


def liveness(spark, sf):
    beats = stream(spark, sf, "run_events").selectExpr("run_id AS key", "ts", "false AS ended")
    out = jobs.drain_to_table(jobs.silence_monitor(beats, 12 * 3600.0, "0 seconds", 3), "liveness")
    return out.groupBy("key", "action").agg(F.count("*").alias("n"))


def errors(spark, sf):
    out = jobs.drain_to_table(jobs.error_alarm_stream(stream(spark, sf, "metrics"), DELAY, "1 hour", 100), "errors")
    return out.select("owner", F.unix_timestamp("window_start").alias("bucket"), "value")


def silence(spark, sf):
    """Owners without an event for six hours, up to the watermark."""
    beats = stream(spark, sf, "metrics").where("metric = 'Invocations'").selectExpr("owner AS key", "ts", "false AS ended")
    out = jobs.drain_to_table(jobs.silence_monitor(beats, 6 * 3600.0, "0 seconds"), "silence")
    return out.groupBy("key").agg(F.count("*").alias("n_alarms"))


def ledger(spark, sf):
    path = fresh_path(spark, "ledger")
    bills = stream(spark, sf, "bills").selectExpr("*", "date_add(period, delay_days) AS read_on").drop("delay_days")
    jobs.settle_ledger(bills, path)
    back = spark.read.schema(jobs.LEDGER).parquet(path)
    return back.groupBy("project", F.col("period").cast("string").alias("period")).agg(
        F.count("*").alias("n_rows"), F.sum(F.col("cost_usd").cast("decimal(30,12)")).cast("double").alias("cost_usd"))


def counters(spark, sf):
    path, rows = fresh_path(spark, "counters"), stream(spark, sf, "protocol_events")
    jobs.protocol_counters(rows, "arrival", path, DELAY)
    return spark.read.schema(rows.schema).parquet(path).select("run_id", "stage", "task", "epoch", "turns", "arrival")


def attribution(spark, sf):
    found = jobs.stage_attribution(stream(spark, sf, "history"), DELAY, 30 * 86400.0)
    return jobs.drain_to_table(found, "stages")


def unanswered(spark, sf):
    events = stream(spark, sf, "run_events")
    pages, answers = events.where("name = 'HumanPaged'"), stream(spark, sf, "run_events").where("stage = 'purchase'")
    out = jobs.drain_to_table(jobs.unanswered_pages(pages, answers, DELAY, "6 HOURS"), "pages")
    return out.select("run_id", F.unix_micros("paged_at").alias("paged_us"))


def daily(spark, sf):
    out = jobs.drain_to_table(jobs.daily_metric_stream(stream(spark, sf, "metrics"), DELAY), "daily")
    return out.withColumn("day", F.col("day").cast("string"))


def sessions(spark, sf):
    out = jobs.drain_to_table(jobs.turn_session_stream(stream(spark, sf, "run_events"), DELAY, "8 hours", ("run_id", "stage")), "sessions")
    return out.select("run_id", "stage", F.unix_micros("started_at").alias("started_us"), "turns")


def scores(spark, sf):
    path, rows = fresh_path(spark, "scores"), scoring.score_rows(stream(spark, sf, "executed_events"))
    jobs.score_counts(rows, ["run"], ["task_id", "sample_idx"], path, DELAY)
    return jobs.read_scores(rows, ["run"], path)


def _gaps(name: str, where: str, key: str, gap_s: int) -> str:
    """Silent stretches per key, in whole gaps, the last one running to the newest event."""
    return f"""g AS (SELECT {key} AS k, epoch_us(ts) / 1e6 AS s, lead(epoch_us(ts) / 1e6) OVER (PARTITION BY {key} ORDER BY ts) AS nxt FROM {name} WHERE {where}),
f AS (SELECT k, greatest(0, CAST(floor((coalesce(nxt, (SELECT floor(max(epoch_us(ts)) / 1000) / 1000 FROM {name} WHERE {where})) - s) / {gap_s}) AS BIGINT)) AS n FROM g)"""


QUERIES = {
    "g1_liveness_monitor": liveness, "g2_error_alarms": errors, "g2_silence_alarms": silence, "g3_settle_ledger": ledger, "g4_protocol_counters": counters,
    "g5_stage_attribution": attribution, "g6_unanswered_pages": unanswered, "g7_daily_metrics": daily, "g8_turn_sessions": sessions, "g9_incremental_scores": scores,
}

SQL = {
    "g2_error_alarms": f"{with_views('metrics')}, w AS (SELECT owner, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS bucket, CAST(sum(value) AS BIGINT) AS value FROM metrics WHERE metric = 'Errors' GROUP BY 1, 2) SELECT * FROM w WHERE value >= 100 AND bucket + 3600 <= epoch((SELECT max(ts) FROM metrics WHERE metric = 'Errors')) - 3600",
    "g2_silence_alarms": f"{with_views('metrics')}, " + _gaps("metrics", "metric = 'Invocations'", "owner", 21600) + " SELECT CAST(k AS VARCHAR) AS key, CAST(sum(n) AS BIGINT) AS n_alarms FROM f GROUP BY 1 HAVING sum(n) > 0",
    "g3_settle_ledger": f"""{with_views('bills')}, t AS (SELECT *, max(delay_days) OVER (PARTITION BY project, period) AS latest FROM bills) SELECT project, strftime(period, '%Y-%m-%d') AS period, count(*) AS n_rows, CAST(sum(CAST(cost_usd AS DECIMAL(38,12))) AS DOUBLE) AS cost_usd FROM t WHERE delay_days = latest GROUP BY 1, 2""",
    "g4_protocol_counters": f"{with_views('protocol')} SELECT run_id, stage, task, epoch, turns, arrival FROM protocol QUALIFY row_number() OVER (PARTITION BY run_id, stage, task, epoch ORDER BY turns DESC, arrival DESC) = 1",
    "g5_stage_attribution": f"{with_views('history')}, c AS (SELECT *, last_value(CASE WHEN kind = 'entered' THEN state END IGNORE NULLS) OVER (PARTITION BY execution ORDER BY event_id) AS current_state FROM history) SELECT execution, event_id, current_state, error FROM c WHERE kind = 'failed'",
    "g6_unanswered_pages": f"""{with_views('run_events')}, m AS (SELECT least(max(ts) FILTER (name = 'HumanPaged'), max(ts) FILTER (stage = 'purchase')) - INTERVAL 1 HOUR AS wm FROM run_events)
SELECT run_id, epoch_us(ts) AS paged_us FROM run_events p, m WHERE name = 'HumanPaged' AND ts + INTERVAL 6 HOUR < wm
  AND NOT EXISTS (SELECT 1 FROM run_events a WHERE a.stage = 'purchase' AND a.run_id = p.run_id AND a.ts >= p.ts AND a.ts <= p.ts + INTERVAL 6 HOUR)""",
    "g8_turn_sessions": f"""{with_views('run_events')}, n AS (SELECT run_id, stage, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS fresh FROM run_events WINDOW w AS (PARTITION BY run_id, stage ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY run_id, stage ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM n)
SELECT run_id, stage, epoch_us(min(ts)) AS started_us, count(*) AS turns FROM s GROUP BY run_id, stage, sid HAVING max(ts) + INTERVAL 8 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM run_events)""",
    "g7_daily_metrics": f"{with_views('metrics')}, w AS (SELECT owner, date_trunc('day', ts) AS d, CAST(sum(value) AS BIGINT) AS value FROM metrics WHERE metric = 'Invocations' GROUP BY 1, 2) SELECT owner, strftime(d, '%Y-%m-%d') AS day, value FROM w WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM metrics WHERE metric = 'Invocations')",
    "g9_incremental_scores": evaluation._REPORT,
}
