"""Run, telemetry and audit queries over the given tables and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.names import session_id
from tallyloom.operators import audits, intake, runs, telemetry
from tallyloom.plans.views import view, with_views
from tallyloom.session import spread, table

US = "epoch_us({})"


def micros(col: str):
    return F.unix_micros(F.col(col).cast("timestamp"))


_STATES = """CASE event_id % 11 WHEN 0 THEN 'DataPrepGenerate' WHEN 1 THEN 'DataPrepCurate' WHEN 2 THEN 'FinetuneLaunch'
 WHEN 3 THEN 'FinetuneAnalyze' WHEN 4 THEN 'RemediateFinetune' WHEN 5 THEN 'EvalGate' WHEN 6 THEN 'Deploy' WHEN 7 THEN 'SmokeTest'
 WHEN 8 THEN 'IncrementIteration' WHEN 9 THEN 'EscalateFail' ELSE 'Complete' END"""
_STAGE_OF = {k: v for k, v in telemetry.STATE_TO_STAGE.items()}
_STAGE_CASE = "CASE {} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STAGE_OF.items()) + " END"
_RUN_STATUS = """CASE c_custkey % 7 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' WHEN 3 THEN 'escalated_by_eval'
 WHEN 4 THEN 'stopped' WHEN 5 THEN '' ELSE 'running' END"""

from tallyloom.plans.views import VIEWS  # noqa: E402

VIEWS.update({
    "history": ("events", {
        "execution": "user_id", "event_id": "event_id", "ts": "ts",
        "kind": "CASE event_type WHEN 'signup' THEN 'entered' WHEN 'view' THEN 'entered' WHEN 'error' THEN 'failed' ELSE 'exited' END",
        "state": _STATES,
        "error": "CASE WHEN event_id % 3 = 0 THEN 'EscalatedToHuman' ELSE 'States.Timeout' END",
        "cause": "props",
    }),
    "run_events": ("events", {
        "run_id": "user_id", "event_id": "event_id", "ts": "ts", "stage": "event_type",
        "kind": "CASE WHEN event_type = 'signup' THEN 'directive' ELSE 'event' END",
        "name": "CASE event_type WHEN 'view' THEN 'HumanPaged' WHEN 'click' THEN 'WaitingOnHuman' ELSE event_type END",
        "waiting_turn": "event_id % 17",
        "detail": "props",
    }),
    "runs": ("customer", {
        "run_id": "c_custkey", "status": _RUN_STATUS, "created_at": "'2024-01-' || (10 + c_custkey % 20)",
        "driver_beat_at": "CASE c_custkey % 5 WHEN 0 THEN 'garbled' WHEN 1 THEN '' WHEN 2 THEN '2024-01-31 11:30:00' WHEN 3 THEN '2024-01-31 11:50:00' ELSE '2024-01-31 11:40:00' END",
        "driver_beat_payload": "CASE WHEN c_custkey % 13 = 0 THEN '' ELSE 'payload' END",
        "task_token": "CASE WHEN c_custkey % 11 = 0 THEN 'token' ELSE '' END",
        "resurrections": "CAST(c_nationkey % 8 AS INTEGER)",
        "job_name": "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'job-' || c_custkey END",
    }),
    "protocol": ("events", {
        "run_id": "user_id % 50", "stage": "event_type", "task": "'t' || (event_id % 3)", "epoch": "event_id % 4",
        "arrival": "event_id", "turns": "user_id % 23",
        "serviced_turns": "CASE WHEN event_id % 29 = 0 THEN 'n/a' ELSE '' || (user_id % 23 - user_id % 2) END",
        "prose_turns": "user_id % 2", "filtered_turns_total": "event_id % 2", "recovered_typed_calls": "event_id % 5",
        "recovered_ending_in_prose": "0", "infra_error_turns_total": "event_id % 7", "deadline_cuts": "user_id % 3",
    }),
    "metrics": ("events", {
        "owner": "user_id % 40", "ts": "ts", "value": "CAST(floor(value) AS BIGINT)",
        "metric": "CASE event_type WHEN 'signup' THEN 'Invocations' WHEN 'view' THEN 'Latency' WHEN 'click' THEN 'Sessions' WHEN 'error' THEN 'Errors' ELSE 'UserErrors' END",
    }),
    "requests": ("lineitem", {
        "endpoint": "'ep-' || (l_suppkey % 8)", "latency_ms": "CAST(l_quantity * 7 AS BIGINT) + l_linenumber",
        "status": "CASE WHEN l_partkey % 31 = 0 THEN 503 WHEN l_partkey % 17 = 0 THEN 404 ELSE 200 END",
        "output_tokens": "CAST(l_quantity AS BIGINT)", "output_chars": "CAST(l_partkey % 900 AS BIGINT)",
        "cost_usd": "l_extendedprice",
    }),
    "stages": ("orders", {
        "run_id": "o_custkey", "stage": "'stage-' || o_orderkey",
        "status": "CASE o_orderkey % 9 WHEN 0 THEN 'completed' WHEN 1 THEN 'complete' WHEN 2 THEN 'launched' WHEN 3 THEN 'failed' WHEN 4 THEN 'error' WHEN 5 THEN 'escalated' WHEN 6 THEN 'odd' WHEN 7 THEN NULL ELSE 'running' END",
        "evidence": "CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderpriority END",
        "error": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'boom' END",
        "started_at": "o_orderdate", "ended_at": "CASE WHEN o_orderkey % 9 = 2 THEN NULL ELSE o_orderdate + INTERVAL '90' MINUTE END",
    }),
    "versions": ("orders", {
        "doc": "o_custkey % 30", "version": "o_orderkey", "models": "o_orderstatus", "plan": "o_orderpriority",
        "approval": "'' || (o_orderkey % 2)", "params": "CASE WHEN o_orderkey % 100 = 0 THEN NULL ELSE 'p' END",
        "run_id": "'r'", "created_at": "'c'", "trigger_source": "CASE WHEN o_orderkey % 500 = 0 THEN 'api' ELSE 'direct' END",
    }),
    "jobs": ("orders", {
        "job_name": "'job-' || o_custkey", "event_id": "o_orderkey", "ts": "o_orderdate",
        "status": "CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Stopped' ELSE 'Failed' END",
        "billable_s": "CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 30 END", "failure_reason": "o_orderpriority",
    }),
    "turns": ("conversations", {
        "conv_id": "conv_id", "turn": "turn", "role": "role",
        "text": "text || CASE turn % 5 WHEN 0 THEN ' eval_uri: s3://bucket/eval-' || conv_id || '.jsonl, samples=' || (conv_id * 7) || '; mode = \"vision\"'"
                " WHEN 1 THEN ' see s3://bucket/data/' || turn || '.csv and s3://bucket/eval-' || conv_id || '.jsonl.'"
                " WHEN 2 THEN ' knowledge base ABCDE' || (10000 + conv_id) || ' budget: 500.' WHEN 3 THEN ' id ZZZZZ' || (10000 + turn) ELSE '' END",
    }),
    "endings": ("conversations", {
        "conv_id": "conv_id", "turn": "turn", "role": "role",
        "tool_name": "CASE WHEN turn % 4 = 0 THEN 'checkpoint' WHEN turn % 4 = 1 AND conv_id % 2 = 0 THEN 'shell' END",
        "text": "text || CASE conv_id % 4 WHEN 0 THEN CASE WHEN turn % 2 = 0 THEN ' <invoke name=\"stage_complete\">' ELSE ' <invoke name=\"stage_complete\"><parameter name=\"a\">1</parameter></invoke>' END WHEN 1 THEN ' **checkpoint** then escalate_human({' WHEN 2 THEN CASE WHEN turn % 2 = 0 THEN ' see **stage_complete** or stage_complete({not json' ELSE ' stage_complete(**{\"a\": {\"b\": \"}\"}}) **shell**' END ELSE '' END",
    }),
    "steps": ("conversations", {
        "run_id": "conv_id", "step": "turn + 1", "seconds": "length(text) / 8.0",
        "epoch": "turn % 2", "loss": "CASE WHEN role = 'user' THEN NULL ELSE length(text) / 16.0 END",
        "eval_loss": "CASE WHEN role = 'user' AND turn > 0 THEN length(text) / 32.0 END",
        "rows_dropped": "CASE WHEN turn = 0 AND conv_id % 2 = 0 THEN conv_id END",
    }),
})


# ---- flow, timelines, waits --------------------------------------------------------------

def _executions(spark, sf):
    return view(spark, sf, "history").groupBy("execution").agg(F.lit(1).alias("_")).selectExpr(
        "execution", "CASE execution % 5 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'SUCCEEDED' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'TIMED_OUT' ELSE 'ABORTED' END AS status"
    )


def stage_flow(spark, sf):
    flow = telemetry.stage_flow(view(spark, sf, "history"), _executions(spark, sf), chunk=F.floor(F.col("event_id") / 2000))
    return flow.select("execution", F.col("stage_order").cast("long").alias("stage_order"), "stage", "status", "attempts",
                       "state", micros("entered_at").alias("entered_us"), micros("exited_at").alias("exited_us"), "error", "cause")


_FLOW = f"""{with_views('history')}, ex AS (SELECT DISTINCT execution, CASE execution % 5 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'SUCCEEDED' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'TIMED_OUT' ELSE 'ABORTED' END AS status FROM history),
c AS (SELECT *, last_value(CASE WHEN kind = 'entered' THEN state END IGNORE NULLS) OVER (PARTITION BY execution ORDER BY event_id) AS cur FROM history),
s AS (SELECT *, CASE WHEN kind = 'failed' THEN {_STAGE_CASE.format('cur')} ELSE {_STAGE_CASE.format('state')} END AS stage FROM c),
a AS (SELECT execution, stage, count(*) FILTER (kind = 'entered') AS n_in, count(*) FILTER (kind = 'exited') AS n_out,
  arg_max(state, event_id) FILTER (kind = 'entered') AS st, arg_min(ts, event_id) FILTER (kind = 'entered') AS i, arg_max(ts, event_id) FILTER (kind = 'exited') AS o,
  arg_max(error, event_id) FILTER (kind = 'failed') AS err, arg_max(cause, event_id) FILTER (kind = 'failed') AS cause, max(event_id) FILTER (kind = 'entered') AS li
  FROM s WHERE stage IS NOT NULL GROUP BY 1, 2),
l AS (SELECT execution, arg_max(stage, li) FILTER (li IS NOT NULL) AS last_entered FROM a GROUP BY 1),
st(stage_order, stage) AS (VALUES {', '.join(f"({i}, '{s}')" for i, s in enumerate(telemetry.STAGES))}),
j AS (SELECT ex.execution, stage_order, st.stage, ex.status AS es, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out, a.st AS state, i, o, err, cause, last_entered,
  CASE WHEN err = 'EscalatedToHuman' THEN 'escalated' ELSE 'failed' END AS stop
  FROM ex CROSS JOIN st LEFT JOIN a ON a.execution = ex.execution AND a.stage = st.stage LEFT JOIN l ON l.execution = ex.execution)
SELECT execution, stage_order, stage, CASE WHEN es NOT IN ('RUNNING', 'SUCCEEDED') AND stage = last_entered THEN stop
    WHEN n_in = 0 THEN CASE WHEN es <> 'RUNNING' THEN 'skipped' ELSE 'pending' END WHEN n_out >= n_in THEN 'succeeded'
    WHEN es = 'RUNNING' THEN 'running' ELSE stop END AS status, n_in AS attempts, state, epoch_us(i) AS entered_us, epoch_us(o) AS exited_us, err AS error, cause FROM j
"""


def iterations(spark, sf):
    return telemetry.iterations(view(spark, sf, "history"))


def timeline(spark, sf):
    return telemetry.timeline_newest(view(spark, sf, "run_events"), 20).select("run_id", "position", "event_id", "older_exist")


def _newest_sql(kind: str, n: int) -> str:
    return f"""{with_views('run_events')}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) AS rn,
  count(*) OVER (PARTITION BY run_id) AS n FROM run_events WHERE kind = '{kind}')
SELECT run_id, least(n, {n}) - rn + 1 AS position, event_id, n > {n} AS older_exist FROM r WHERE rn <= {n}"""


def parked(spark, sf):
    return telemetry.directives(view(spark, sf, "run_events"), 10).select("run_id", "position", "event_id", "older_exist")


def waiting(spark, sf):
    events = view(spark, sf, "run_events")
    answers = events.where("stage = 'purchase'").select("run_id", "ts")
    out = telemetry.waiting_on_human(events, answers, view(spark, sf, "runs"))
    return out.select("run_id", micros("since").alias("since_us"), "stage", "turns", "turns_are_floor")


_WAITING = f"""{with_views('run_events', 'runs')}, p AS (SELECT run_id, max(ts) AS since FROM run_events WHERE name = 'HumanPaged' GROUP BY 1),
w AS (SELECT p.*, (SELECT coalesce(max(waiting_turn), 0) FROM run_events e WHERE e.run_id = p.run_id AND e.name = 'WaitingOnHuman' AND e.ts >= p.since) AS turns
  FROM p LEFT JOIN runs r ON r.run_id = p.run_id
  WHERE NOT EXISTS (SELECT 1 FROM run_events e WHERE e.run_id = p.run_id AND e.stage = 'purchase' AND e.ts >= p.since)
    AND NOT regexp_matches(coalesce(r.status, ''), '^(escalated|failed|completed|stopped)'))
SELECT run_id, epoch_us(since) AS since_us, 'view' AS stage, turns, turns >= 12 AS turns_are_floor FROM w"""


def delivery(spark, sf):
    orders = view(spark, sf, "run_events").where("kind = 'directive'").selectExpr(
        "run_id", "event_id AS directive_id", "ts", "event_id % 3 = 0 AS delivered")
    return telemetry.directive_delivery(view(spark, sf, "runs"), orders)


_DELIVERY = f"""{with_views('run_events', 'runs')}, d AS (SELECT run_id, event_id AS directive_id, ts, event_id % 3 <> 0 AS waiting FROM run_events WHERE kind = 'directive'),
n AS (SELECT *, waiting AND row_number() OVER (PARTITION BY run_id, waiting ORDER BY ts, directive_id) = 1 AS first FROM d),
k AS (SELECT n.*, NOT regexp_matches(coalesce(status, ''), '^(escalated|failed|completed|stopped)') AS deliverable FROM n LEFT JOIN runs USING (run_id))
SELECT run_id, directive_id, deliverable, deliverable AND first AS is_next, waiting AND NOT deliverable AS undeliverable FROM k"""


# ---- protocol ----------------------------------------------------------------------------

_COUNTERS = telemetry.PROTOCOL_COUNTERS


def upserted(spark, sf):
    out = telemetry.monotonic_upsert(view(spark, sf, "protocol"), "arrival")
    return out.select("run_id", "stage", "task", "epoch", "turns", "arrival")


def protocol(spark, sf):
    rolled = telemetry.protocol_rollup(view(spark, sf, "protocol"))
    return telemetry.protocol_intervals(rolled)


def wilson_sql(p: str, n: str) -> str:
    n = f"CAST({n} AS DOUBLE)"
    z = "CAST(1.96 AS DOUBLE)"
    centre = f"({p} + {z} * {z} / (2 * {n}))"
    spread = f"sqrt(greatest({p} * (1 - {p}), 0.0) / {n} + {z} * {z} / (4 * {n} * {n}))"
    scale = f"(1 + {z} * {z} / {n})"
    low = f"CASE WHEN {n} > 0 THEN {centre} / {scale} - {z} * {spread} / {scale} END"
    high = f"CASE WHEN {n} > 0 THEN {centre} / {scale} + {z} * {spread} / {scale} END"
    return low, high


_PLOW, _PHIGH = wilson_sql("structured_call_rate", "turns")
_PROTOCOL = f"""{with_views('protocol')}, t AS (SELECT stage, {', '.join(f"CAST(coalesce(TRY_CAST({c} AS BIGINT), 0) AS BIGINT) AS {c}" for c in _COUNTERS)} FROM protocol),
s AS (SELECT CASE WHEN grouping(stage) = 1 THEN 'total' ELSE 'stage' END AS level, stage, {', '.join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _COUNTERS)} FROM t GROUP BY ROLLUP (stage)),
r AS (SELECT *, CASE WHEN turns <> 0 THEN CAST(serviced_turns AS DOUBLE) / turns END AS structured_call_rate FROM s)
SELECT *, {_PLOW} AS rate_low, {_PHIGH} AS rate_high FROM r"""


def _slots(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_orderkey AS slot", "CASE WHEN o_orderkey % 40 = 0 THEN NULL ELSE o_custkey END AS run_id")


def outcomes(spark, sf):
    return telemetry.slot_outcomes(_slots(spark, sf), view(spark, sf, "runs")).groupBy("outcome").agg(F.count("*").alias("n"))


def probe(spark, sf):
    return telemetry.reliability_probe(_slots(spark, sf), view(spark, sf, "runs"), 0.8, 0.05)


_OUTCOMES = f"""{with_views('runs')}, o AS (SELECT CASE WHEN o_orderkey % 40 = 0 THEN 'unknown' WHEN status = 'completed' THEN 'pass'
  WHEN status IN ('escalated', 'failed', 'stopped') THEN 'fail' ELSE 'unknown' END AS outcome FROM orders LEFT JOIN runs ON run_id = o_custkey)"""
_RLOW, _RHIGH = wilson_sql("run_rate", "decided")
_PROBE = f"""{_OUTCOMES}, c AS (SELECT count(*) FILTER (outcome = 'pass') AS passes, count(*) FILTER (outcome = 'fail') AS failures, count(*) FILTER (outcome = 'unknown') AS unknown FROM o),
r AS (SELECT *, passes + failures AS decided, CAST(passes AS DOUBLE) / (passes + failures) AS run_rate FROM c)
SELECT *, {_RLOW} AS rate_low, {_RHIGH} AS rate_high, CAST(ceil(ln(0.05) / ln(0.8)) AS BIGINT) AS needed,
  CASE WHEN failures > 0 THEN 'refuted' WHEN unknown > 0 OR passes < ceil(ln(0.05) / ln(0.8)) THEN 'inconclusive' ELSE 'earned' END AS verdict FROM r"""


# ---- liveness, alarms, fleet -------------------------------------------------------------

NOW = "2024-01-31 12:00:00"


def liveness(spark, sf):
    return telemetry.liveness_sweep(view(spark, sf, "runs"), NOW).select("run_id", "age_minutes", "resurrections", "action")


_LIVENESS = f"""{with_views('runs')} SELECT run_id, (epoch(TIMESTAMP '{NOW}') - epoch(TRY_CAST(driver_beat_at AS TIMESTAMP))) / 60 AS age_minutes, resurrections,
  CASE WHEN resurrections >= 5 THEN 'escalate' ELSE 'resurrect' END AS action FROM runs
  WHERE status = 'running' AND driver_beat_at <> '' AND driver_beat_payload <> '' AND task_token = ''
    AND (TRY_CAST(driver_beat_at AS TIMESTAMP) IS NULL OR (epoch(TIMESTAMP '{NOW}') - epoch(TRY_CAST(driver_beat_at AS TIMESTAMP))) / 60 >= 20)"""


def fleet(spark, sf):
    return telemetry.fleet_metrics(view(spark, sf, "metrics")).select("owner", "invocations", "sessions", "user_errors", "latency", "error_rate_pct")


def token_use(spark, sf):
    usage = table(spark, sf, "events").selectExpr("CASE event_type WHEN 'view' THEN 'input' WHEN 'error' THEN NULL WHEN 'click' THEN 'cached' ELSE event_type END AS token_type", "value")
    return telemetry.token_totals(usage)


_TOKEN_USE = """WITH u AS (SELECT CASE event_type WHEN 'view' THEN 'input' WHEN 'error' THEN '?' WHEN 'click' THEN 'cached' ELSE event_type END AS token_type, CAST(value AS DECIMAL(38,12)) AS v FROM events UNION ALL SELECT unnest(['input', 'output']), 0)
SELECT token_type, CAST(sum(v) AS DOUBLE) AS tokens FROM u GROUP BY 1"""


_FLEET = f"""{with_views('metrics')}, s AS (SELECT owner, CAST(sum(value) FILTER (metric = 'Invocations') AS DOUBLE) AS invocations, CAST(sum(value) FILTER (metric = 'Sessions') AS DOUBLE) AS sessions,
  CAST(sum(value) FILTER (metric = 'UserErrors') AS DOUBLE) AS user_errors, CAST(sum(value) FILTER (metric = 'Latency') AS DOUBLE) / count(*) FILTER (metric = 'Latency') AS latency FROM metrics GROUP BY 1)
SELECT *, CASE WHEN coalesce(invocations, 0) <> 0 THEN 100.0 * coalesce(user_errors, 0) / invocations ELSE 0 END AS error_rate_pct FROM s"""


def daily(spark, sf):
    return telemetry.daily_series(view(spark, sf, "metrics"), "Invocations").withColumn("day", F.col("day").cast("string"))


def errors_ringing(spark, sf):
    return telemetry.error_alarms(view(spark, sf, "metrics"), threshold=40)


def _watched(spark, sf):
    return view(spark, sf, "metrics").select("owner").distinct().selectExpr(
        "owner", "CASE WHEN owner % 2 = 0 THEN 3600 ELSE 7200 END AS period_s", "CAST(1 + owner % 3 AS int) AS periods")


def silence(spark, sf):
    return telemetry.silence_alarms(view(spark, sf, "metrics"), _watched(spark, sf), "2024-01-01 00:00:00", "2024-01-31 00:00:00")


_SILENCE = f"""{with_views('metrics')}, wd AS (SELECT DISTINCT owner, CASE WHEN owner % 2 = 0 THEN 3600 ELSE 7200 END AS period_s, 1 + owner % 3 AS periods FROM metrics),
sp AS (SELECT owner, period_s, periods, unnest(generate_series(CAST(epoch(TIMESTAMP '2024-01-01') AS BIGINT), CAST(epoch(TIMESTAMP '2024-01-31') AS BIGINT) - 1, period_s)) AS bucket FROM wd),
cnt AS (SELECT owner, CAST(floor(epoch(ts) / CASE WHEN owner % 2 = 0 THEN 3600 ELSE 7200 END) AS BIGINT) * CASE WHEN owner % 2 = 0 THEN 3600 ELSE 7200 END AS bucket, sum(value) AS v
  FROM metrics WHERE metric = 'Invocations' GROUP BY 1, 2),
f AS (SELECT sp.*, coalesce(v, 0) AS v FROM sp LEFT JOIN cnt USING (owner, bucket)),
r AS (SELECT *, sum(v) OVER (PARTITION BY owner ORDER BY bucket RANGE BETWEEN (periods - 1) * period_s PRECEDING AND CURRENT ROW) AS seen,
  row_number() OVER (PARTITION BY owner ORDER BY bucket) AS rn FROM f)
SELECT owner, bucket FROM r WHERE seen < 1 AND rn >= periods"""


def health(spark, sf):
    req = view(spark, sf, "requests")
    rates = req.groupBy("endpoint").agg(F.sum(F.col("cost_usd").cast("decimal(30,12)")).cast("double").alias("cost_usd"))
    base = req.where("endpoint <> 'ep-3'").groupBy("endpoint").agg(F.max("output_chars").cast("double").alias("output_chars"))
    return telemetry.health(req, rates, base, 0.5)


_HEALTH = f"""{with_views('requests')}, q AS (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY endpoint) AS n FROM requests),
a AS (SELECT endpoint, count(*) AS invocations, max(latency_ms) FILTER (i = least(n - 1, CAST(floor(0.5 * n) AS BIGINT))) AS p50_ms,
  max(latency_ms) FILTER (i = least(n - 1, CAST(floor(0.9 * n) AS BIGINT))) AS p90_ms, count(*) FILTER (status BETWEEN 400 AND 499) AS c4, count(*) FILTER (status >= 500) AS c5,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(CAST(cost_usd AS DECIMAL(38,12))) AS DOUBLE) AS cost, CAST(sum(output_chars) AS DOUBLE) / count(*) AS m, CAST(max(output_chars) AS DOUBLE) AS b FROM q GROUP BY 1)
SELECT endpoint, invocations, p50_ms, p90_ms, CAST(c4 AS DOUBLE) / invocations AS rate_4xx, CAST(c5 AS DOUBLE) / invocations AS rate_5xx, output_tokens,
  cost / invocations AS cost_per_invocation, CASE WHEN endpoint <> 'ep-3' THEN m / b - 1 END AS length_shift, CASE WHEN endpoint <> 'ep-3' THEN abs(m / b - 1) > 0.5 END AS drift_detected FROM a"""


def drift(spark, sf):
    return telemetry.drift_events(health(spark, sf))


# ---- jobs, steps -------------------------------------------------------------------------

def stops(spark, sf):
    return telemetry.classify_stop(view(spark, sf, "jobs")).select("event_id", "status", "outcome")


def joined_jobs(spark, sf):
    return telemetry.join_job_events(view(spark, sf, "jobs"), view(spark, sf, "runs"))


_JOINED = f"""{with_views('jobs', 'runs')}, l AS (SELECT *, row_number() OVER (PARTITION BY job_name ORDER BY ts DESC, event_id DESC) AS rn FROM jobs)
SELECT l.job_name, l.status AS job_status, failure_reason, run_id, run_id IS NOT NULL AS matched FROM l LEFT JOIN runs r ON r.job_name = l.job_name WHERE rn = 1"""


def steps(spark, sf):
    return telemetry.step_timing(view(spark, sf, "steps"), width=16.0)


def _pick(q: float, where: str = "") -> str:
    return f"""(SELECT list(seconds ORDER BY seconds)[least(count(*) - 1, CAST(floor({q} * count(*)) AS BIGINT)) + 1] FROM steps x WHERE x.run_id = s.run_id {where})"""


_STEPS = f"""{with_views('steps')}, s AS (SELECT run_id, count(*) AS n_steps, CAST(sum(CAST(seconds AS DECIMAL(38,12))) AS DOUBLE) / count(*) AS mean, arg_min(seconds, step) AS first_step, max(step) AS global_step FROM steps GROUP BY 1)
SELECT *, CAST({_pick(0.5)} AS DOUBLE) AS p50, CAST({_pick(0.9)} AS DOUBLE) AS p90, CAST(coalesce({_pick(0.5, 'AND step > 3')}, {_pick(0.5)}) AS DOUBLE) AS p50_steady,
  CAST(coalesce({_pick(0.9, 'AND step > 3')}, {_pick(0.9)}) AS DOUBLE) AS p90_steady FROM s"""


def train_log(spark, sf):
    return telemetry.training_log_summary(view(spark, sf, "steps"))


_LOG = f"""{with_views('steps')} SELECT run_id, CAST(arg_max(loss, step) FILTER (loss IS NOT NULL) AS DOUBLE) AS final_train_loss,
  CAST(sum(CAST(loss AS DECIMAL(38,12))) AS DOUBLE) / nullif(count(loss), 0) AS mean_train_loss, CAST(arg_max(eval_loss, step) FILTER (eval_loss IS NOT NULL) AS DOUBLE) AS final_eval_loss,
  max(rows_dropped) AS rows_dropped, max(step) AS global_step FROM steps GROUP BY 1"""


#: Runs of the training log: sizes by run number, every third cut to a few steps, one in eleven without a trainer's limit.
_RUNS = "conv_id AS run_id, 40 + conv_id * 7 AS n_rows, 1 + conv_id % 3 AS epochs, 1 + conv_id % 4 AS batch_size, conv_id % 5 AS accumulation, CASE WHEN conv_id % 11 = 0 THEN 0 ELSE 5 + conv_id % 9 END AS max_steps, CASE WHEN conv_id % 3 = 0 THEN 20 ELSE -1 END AS max_steps_requested"


def progress(spark, sf):
    runs = table(spark, sf, "conversations").selectExpr(*_RUNS.split(", ")).distinct()
    return telemetry.training_progress(view(spark, sf, "steps"), runs, width=16.0).select(
        "run_id", "global_step", "n_steps", "p50_steady", "intended_steps", "step_capped", "completed_fraction")


_STEP_SUMS = _STEPS.split("\nSELECT *")[0]
_PROGRESS = f"""{_STEP_SUMS}, runs AS (SELECT DISTINCT {_RUNS} FROM conversations),
i AS (SELECT s.*, runs.* EXCLUDE (run_id), greatest(1, CAST(ceil(n_rows * CAST(epochs AS DOUBLE) / greatest(1, batch_size * accumulation)) AS BIGINT)) AS intended_steps, max_steps_requested > 0 AS step_capped FROM s JOIN runs USING (run_id))
SELECT run_id, global_step, n_steps, CAST(coalesce({_pick(0.5, 'AND step > 3')}, {_pick(0.5)}) AS DOUBLE) AS p50_steady, intended_steps, step_capped,
  CASE WHEN step_capped THEN CAST(global_step AS DOUBLE) / intended_steps ELSE CAST(global_step AS DOUBLE) / nullif(max_steps, 0) END AS completed_fraction FROM i s"""


def escalated(spark, sf):
    pages = view(spark, sf, "run_events").where("name = 'HumanPaged'").selectExpr(
        "run_id", "ts", "event_id", "event_id % 3 AS iteration", "CASE WHEN event_id % 5 = 0 THEN '' ELSE stage END AS stage", "CASE WHEN event_id % 8 = 0 THEN NULL WHEN event_id % 4 = 0 THEN ' ' ELSE detail END AS reason")
    return runs.escalation_records(pages)


def eval_losses(spark, sf):
    return telemetry.eval_loss_by_epoch(view(spark, sf, "steps"))


# ---- manifests and reports ---------------------------------------------------------------

_CLAIM = """CASE event_id % 10
 WHEN 0 THEN '{"outputs":[],"artifacts":["s3://b/x"],"metrics":{"n":' || user_id || '},"evidence":"ok"}'
 WHEN 1 THEN '{"artifacts":"[\\"s3://b/' || user_id || '\\",\\"s3://b/2\\"]","results":"{\\"a\\":1}","summary":{"k":1}}'
 WHEN 2 THEN '{"output":"s3://b/' || event_id || '","stats":"plain","proof":null}'
 WHEN 3 THEN '{"s3_uris":["s3://b/1",null,7],"measurements":[1,2],"notes":5}'
 WHEN 4 THEN '{"artifact_uris":"\\"s3://b/q\\"","metrics":"5"}'
 WHEN 5 THEN '{"outputs":null,"artifacts":["x"],"metrics":null}'
 WHEN 6 THEN '{"outputs":{"a":1}}'
 WHEN 7 THEN '{"outputs":12,"metrics":3.5,"evidence":["a","b"]}'
 ELSE '{"evidence":"' || event_type || '"}' END"""


def claims(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id", _CLAIM.replace("\\", "\\\\") + " AS claim")
    out = runs.normalize_claims(rows, "claim")
    pairs = F.transform(F.sort_array(F.map_entries("metrics")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("event_id", F.size("outputs").cast("long").alias("n_outputs"), F.array_join("outputs", "|").alias("outputs"),
                      F.array_join(pairs, "|").alias("metrics"), "evidence")


_CLAIMS = """SELECT event_id, CASE k WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 1 WHEN 5 THEN 0 WHEN 6 THEN 1 WHEN 7 THEN 1 ELSE 0 END::BIGINT AS n_outputs,
  CASE k WHEN 1 THEN 's3://b/' || user_id || '|s3://b/2' WHEN 2 THEN 's3://b/' || event_id WHEN 3 THEN 's3://b/1|7' WHEN 4 THEN 's3://b/q' WHEN 6 THEN '{"a":1}' WHEN 7 THEN '12' ELSE '' END AS outputs,
  CASE k WHEN 0 THEN 'n=' || user_id WHEN 1 THEN 'a=1' WHEN 2 THEN 'value=plain' WHEN 3 THEN 'value=[1,2]' WHEN 4 THEN 'value=5' WHEN 7 THEN 'value=3.5' ELSE '' END AS metrics,
  CASE k WHEN 0 THEN 'ok' WHEN 1 THEN '{"k":1}' WHEN 3 THEN '5' WHEN 7 THEN '["a","b"]' WHEN 8 THEN event_type WHEN 9 THEN event_type ELSE '' END AS evidence
FROM (SELECT *, event_id % 10 AS k FROM events)"""


def report_counts(spark, sf):
    return runs.run_counts(view(spark, sf, "stages"))


_COUNTS = f"""{with_views('stages')}, c AS (SELECT run_id, CASE WHEN status IN ('completed', 'complete', 'passed', 'succeeded') THEN 'p' WHEN status IN ('launched', 'running', 'in_progress') THEN 'i'
  WHEN status IN ('failed', 'error', 'escalated') THEN 'f' ELSE 'u' END AS c FROM stages)
SELECT run_id, count(*) AS total, count(*) FILTER (c = 'p') AS passed, count(*) FILTER (c = 'f') AS failed, count(*) FILTER (c = 'i') AS in_flight, count(*) FILTER (c = 'u') AS unrecognized FROM c GROUP BY 1"""


def _instrument_claims(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_custkey AS run_id", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'eval' END AS stage", "'judge_instrument' AS kind",
        "'doc-' || (o_orderkey % 60) AS key",
        "CASE o_orderkey % 3 WHEN 0 THEN sha2('text-' || (o_orderkey % 60), 256) WHEN 1 THEN '' ELSE 'deadbeef' END AS claimed_sha256")


def _instruments(spark, sf):
    return table(spark, sf, "part").selectExpr("CASE WHEN p_partkey < 50 THEN 'doc-' ELSE 'other-' END || p_partkey AS key", "'text-' || p_partkey AS content")


def attested(spark, sf):
    return runs.attest(_instrument_claims(spark, sf), _instruments(spark, sf)).groupBy("state", "verified").agg(F.count("*").alias("n"))


_ATT = """a AS (SELECT o_custkey AS run_id, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE 'eval' END AS stage, 'doc-' || (o_orderkey % 60) AS key,
  CASE o_orderkey % 3 WHEN 0 THEN sha256('text-' || (o_orderkey % 60)) WHEN 1 THEN '' ELSE 'deadbeef' END AS claimed,
  CASE WHEN o_orderkey % 60 < 50 THEN sha256('text-' || (o_orderkey % 60)) END AS canon FROM orders),
t AS (SELECT *, CASE WHEN canon IS NULL THEN 'unreadable' WHEN claimed = '' THEN 'absent' WHEN claimed = canon THEN 'verified' ELSE 'mismatch' END AS state FROM a)"""


def _escalations(spark, sf):
    return view(spark, sf, "run_events").where("stage = 'error'").selectExpr("run_id", "CASE WHEN event_id % 2 = 0 THEN stage END AS stage", "CASE WHEN event_id % 3 = 0 THEN '' ELSE detail END AS reason")


def findings(spark, sf):
    out = runs.run_findings(view(spark, sf, "stages"), _escalations(spark, sf),
                            runs.attest(_instrument_claims(spark, sf), _instruments(spark, sf)))
    return out.groupBy("run_id", "severity", "title").agg(F.count("*").alias("n"), F.min("detail").alias("first_detail")).drop("first_detail")


_FINDINGS = f"""{with_views('stages', 'run_events')}, {_ATT}, f AS (
  SELECT run_id, 'high' AS severity, 'Stage ' || stage || ' failed' AS title FROM stages WHERE status IN ('failed', 'error')
  UNION ALL SELECT run_id, 'critical', 'Stage ' || stage || ' escalated to human' FROM stages WHERE status = 'escalated'
  UNION ALL SELECT run_id, 'critical', 'Stage ' || CASE WHEN event_id % 2 = 0 THEN stage ELSE 'unknown' END || ' escalated to human' FROM run_events WHERE stage = 'error'
  UNION ALL SELECT run_id, CASE state WHEN 'mismatch' THEN 'high' ELSE 'medium' END, CASE state WHEN 'unreadable' THEN 'Judge instrument could not be verified'
    WHEN 'absent' THEN 'Judge score does not name its instrument' ELSE 'Judge score was produced by a non-canonical instrument' END
    FROM (SELECT DISTINCT run_id, claimed, canon, state FROM t WHERE state <> 'verified'))
SELECT run_id, severity, title, count(*) AS n FROM f GROUP BY 1, 2, 3"""


def manifests(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "CASE o_orderkey % 4 WHEN 0 THEN 'acme-20240101T000000Z-abc123' WHEN 1 THEN 'run-20240101T000000Z-abcd1234' WHEN 2 THEN 'bad id' END AS run_id",
        "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE '2024' END AS created_at", "CASE WHEN o_orderkey % 7 = 0 THEN 'cron' ELSE 'api' END AS trigger_source",
        "CAST(o_orderkey % 5 - 1 AS int) AS iteration",
        "map('s1', named_struct('status', CASE WHEN o_orderkey % 8 = 0 THEN NULL WHEN o_orderkey % 8 = 1 THEN 'launched' ELSE 'completed' END)) AS stages",
        "CASE WHEN o_orderkey % 9 <> 0 THEN 'm' END AS models")
    out = runs.validate_manifests(rows, (r"^acme-[0-9]{8}T[0-9]{6}Z-[0-9a-f]{6}$", r"^run-[0-9]{8}T[0-9]{6}Z-[0-9a-f]{8}$"))
    return out.select("o_orderkey", F.array_join("violations", "|").alias("violations"))


_MANIFESTS = """SELECT o_orderkey, array_to_string(list_sort(list_filter([CASE WHEN o_orderkey % 4 = 3 THEN 'missing:run_id' END, CASE WHEN o_orderkey % 6 = 0 THEN 'missing:created_at' END,
  CASE WHEN o_orderkey % 9 = 0 THEN 'missing:models' END, CASE WHEN o_orderkey % 4 = 2 THEN 'run_id:pattern' END, CASE WHEN o_orderkey % 7 = 0 THEN 'trigger_source:enum' END,
  CASE WHEN o_orderkey % 5 = 0 THEN 'iteration:minimum' END, CASE WHEN o_orderkey % 8 = 0 THEN 'stage:status missing' END, CASE WHEN o_orderkey % 8 = 1 THEN 'stage:status enum' END],
  lambda x: x IS NOT NULL)), '|') AS violations FROM orders"""


def tampered(spark, sf):
    out = runs.immutable_field_tamper(view(spark, sf, "versions"), F.floor(F.col("version") / 1000))
    return out.select("doc", "version", F.array_join("tampered", "|").alias("tampered"))


def _changed(c: str) -> str:
    return f"CASE WHEN {c} <> lag({c}) OVER w THEN '{c}' END"


_TAMPER = f"""{with_views('versions')}, d AS (SELECT doc, version, array_to_string(list_filter([{', '.join(_changed(c) for c in sorted(runs.SIGNED_BLOCKS))}], lambda x: x IS NOT NULL), '|') AS tampered
  FROM versions WINDOW w AS (PARTITION BY doc ORDER BY version)) SELECT * FROM d WHERE tampered <> ''"""


def history_list(spark, sf):
    return runs.stage_history(view(spark, sf, "run_events")).select("run_id", "position", "event_id", "stage")


def last_by_stage(spark, sf):
    return runs.stage_map(view(spark, sf, "run_events")).select("run_id", "stage", "n_records", "event_id", "name")


def latest_alias(spark, sf):
    reports = table(spark, sf, "orders").selectExpr("o_orderkey AS run_id", "o_orderdate AS generated_at", "o_totalprice AS total")
    return runs.latest_report(reports).select("run_id", "total")


def story(spark, sf):
    stages = view(spark, sf, "stages")
    ledger = table(spark, sf, "orders").selectExpr("CASE WHEN o_custkey % 3 = 0 THEN -1 - o_custkey ELSE o_custkey END AS run_id", "o_totalprice AS cost_usd")
    found = stages.where("status IN ('failed', 'error')").select("run_id")
    return runs.run_story(stages, ledger, found).select("run_id", "stage", "status", "duration_s", "cost_usd", "open_findings")


_STORY = f"""{with_views('stages')}, l AS (SELECT o_custkey AS run_id, CAST(sum(CAST(o_totalprice AS DECIMAL(38,12))) AS DOUBLE) AS cost_usd FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1),
f AS (SELECT run_id, count(*) AS n FROM stages WHERE status IN ('failed', 'error') GROUP BY 1)
SELECT run_id, stage, status, CAST(epoch(ended_at) - epoch(started_at) AS BIGINT) AS duration_s, cost_usd, coalesce(n, 0) AS open_findings FROM stages LEFT JOIN l USING (run_id) LEFT JOIN f USING (run_id)"""


# ---- audits ------------------------------------------------------------------------------

def vocabulary(spark, sf):
    known = table(spark, sf, "events").where("event_type <> 'error'").selectExpr("event_type AS detail_type").distinct()
    return audits.unknown_types(table(spark, sf, "events").selectExpr("event_type AS detail_type"), known)


def misrouted(spark, sf):
    return audits.misrouted_types(table(spark, sf, "events").selectExpr(
        "event_type || (user_id % 5) AS detail_type", "CASE WHEN user_id % 5 = 2 AND event_id % 2 = 0 THEN 'routed' WHEN user_id % 5 = 4 THEN NULL ELSE 'recorded' END AS route"))


_SIGNED = ("task_id", "decision", "approved_by")


def _chain(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(
        "o_custkey % 20 AS chain", "o_orderkey", "'task-' || o_orderkey AS task_id", "o_orderpriority AS decision", "'user-' || o_custkey AS approved_by")
    from pyspark.sql import Window

    rows = rows.withColumn("h", F.sha2(audits.canonical_record(_SIGNED), 256))
    prev = F.coalesce(F.lag("h").over(Window.partitionBy("chain").orderBy("o_orderkey")), F.lit("genesis"))
    return rows.withColumns({
        "record_sha256": F.when(F.col("o_orderkey") % 997 == 5, "forged").otherwise(F.col("h")),
        "prev_event_sha256": F.when(F.col("o_orderkey") % 1013 == 7, "cut").otherwise(prev),
    }).drop("h")


def hash_chain(spark, sf):
    audited = audits.hash_chain_audit(_chain(spark, sf), ["o_orderkey"], F.floor(F.col("o_orderkey") / 1000), _SIGNED, ["chain"])
    return audited.select("chain", "o_orderkey", "hash_ok", "link_ok", "derived_sha256")


def chain_break(spark, sf):
    audited = audits.hash_chain_audit(_chain(spark, sf), ["o_orderkey"], F.floor(F.col("o_orderkey") / 1000), _SIGNED, ["chain"])
    return audits.first_break(audited, ["o_orderkey"], ["chain"]).select("chain", "o_orderkey", "hash_ok", "link_ok")


_CHAIN = """WITH a AS (SELECT o_custkey % 20 AS chain, o_orderkey, o_orderkey % 997 <> 5 AS hash_ok, o_orderkey % 1013 <> 7 AS link_ok,
  sha256('{"approved_by":"user-' || o_custkey || '","decision":"' || o_orderpriority || '","task_id":"task-' || o_orderkey || '"}') AS derived_sha256 FROM orders)"""


def drifted(spark, sf):
    want = table(spark, sf, "customer")
    got = want.selectExpr(
        "CASE WHEN c_custkey % 50 = 1 THEN c_custkey + 2000000000 WHEN c_custkey % 70 = 3 THEN c_custkey + 1000000000 ELSE c_custkey END AS c_custkey", "c_name",
        "CASE WHEN c_custkey % 9 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS c_nationkey",
        "CASE WHEN c_custkey % 18 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal", "c_mktsegment")
    out = audits.table_drift(want, got, ["c_custkey"])
    return out.select("c_custkey", "problem", F.array_join("fields", "|").alias("fields"))


_DRIFT = """WITH got AS (SELECT CASE WHEN c_custkey % 50 = 1 THEN c_custkey + 2000000000 WHEN c_custkey % 70 = 3 THEN c_custkey + 1000000000 ELSE c_custkey END AS k, c_custkey AS o FROM customer)
SELECT coalesce(c.c_custkey, k) AS c_custkey, CASE WHEN k IS NULL THEN 'absent live' WHEN c.c_custkey IS NULL THEN 'extra live' ELSE 'differs' END AS problem,
  CASE WHEN k IS NOT NULL AND c.c_custkey IS NOT NULL THEN CASE WHEN o % 18 = 0 THEN 'c_acctbal|c_nationkey' ELSE 'c_nationkey' END END AS fields
FROM customer c FULL JOIN got ON k = c.c_custkey WHERE k IS NULL OR c.c_custkey IS NULL OR o % 9 = 0"""

# The reference's fixed rules plus one configured for the secrets these documents carry.
_RULES = audits.SECRET_RULES + (("token assignment", r'token = "[0-9a-f]{40}"', True, 0),)


def _planted(spark, sf):
    return spread(table(spark, sf, "documents")).selectExpr(
        "doc_id", "text || CASE doc_id % 10 WHEN 0 THEN '\\nkey AK' || 'IA' || 'ABCDEFGH' || (10000000 + doc_id) WHEN 1 THEN '\\nid ' || (100000000000 + doc_id) || ' x'"
        " WHEN 2 THEN '\\nhttps://abc123.execute-api.eu-west-1.amazonaws.com' WHEN 3 THEN '\\nhttps://live' || doc_id || '.execute-api.eu-west-1.amazonaws.com/x'"
        " WHEN 4 THEN '\\nar' || 'n:aws:s3:eu-west-1:' || (100000000000 + doc_id) || ':b' ELSE '' END AS text")


def secrets(spark, sf):
    return audits.secret_scan(_planted(spark, sf), "doc_id", "text", _RULES)


_SECRETS = """WITH d AS (SELECT doc_id, text || CASE doc_id % 10 WHEN 0 THEN chr(10) || 'key AK' || 'IA' || 'ABCDEFGH' || (10000000 + doc_id) WHEN 1 THEN chr(10) || 'id ' || (100000000000 + doc_id) || ' x'
  WHEN 2 THEN chr(10) || 'https://abc123.execute-api.eu-west-1.amazonaws.com' WHEN 3 THEN chr(10) || 'https://live' || doc_id || '.execute-api.eu-west-1.amazonaws.com/x'
  WHEN 4 THEN chr(10) || 'ar' || 'n:aws:s3:eu-west-1:' || (100000000000 + doc_id) || ':b' ELSE '' END AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM d),
h AS (SELECT doc_id, line_no, 'AWS access key id' AS rule, unnest(regexp_extract_all(line, 'AK' || 'IA[0-9A-Z]{16}')) AS w FROM l
  UNION ALL SELECT doc_id, line_no, 'AWS temporary access key id', unnest(regexp_extract_all(line, 'ASIA[0-9A-Z]{16}')) FROM l
  UNION ALL SELECT doc_id, line_no, 'account-bearing ARN', unnest(regexp_extract_all(line, 'arn:aws[a-z-]*:[a-z0-9-]+:[a-z0-9-]*:[0-9]{12}')) FROM l
  UNION ALL SELECT doc_id, line_no, 'live API Gateway hostname', unnest(regexp_extract_all(line, '[a-z0-9<>_-]{4,}\\.execute-api\\.[a-z0-9-]+\\.amazonaws\\.com')) FROM l
  UNION ALL SELECT doc_id, line_no, 'token assignment', unnest(regexp_extract_all(line, 'token = "[0-9a-f]{40}"')) FROM l
  UNION ALL SELECT doc_id, line_no, 'bare 12-digit account id', unnest(regexp_extract_all(line, '(?:^|[^0-9.])([0-9]{12})(?:[^0-9.]|$)', 1)) FROM l)
SELECT doc_id AS path, line_no, rule, substr(w, 1, 80) AS snippet, length(w) > 80 AS snippet_cut FROM h
WHERE CASE WHEN rule = 'live API Gateway hostname' THEN lower(regexp_extract(w, '^([^.]+)', 1)) NOT IN ('abc123', '<api_id>', 'exampleapi1', 'apiid') ELSE NOT regexp_matches(w, '[0-9]{13,}') END"""


def uris(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey", """'{"a":["s3://b/' || (o_orderkey % 100) || '","x",{"k":"s3://b/' || (o_custkey % 50) || '"}],"n":' || o_custkey || ',"z":"s3://b/' || (o_orderkey % 100) || '"}' AS doc""")
    return audits.extract_uris(rows, "o_orderkey", "doc").withColumn("position", F.col("position").cast("long"))


_URIS = """SELECT o_orderkey, 0::BIGINT AS position, 's3://b/' || (o_orderkey % 100) AS uri FROM orders
UNION ALL SELECT o_orderkey, 1, 's3://b/' || (o_custkey % 50) FROM orders WHERE o_custkey % 50 <> o_orderkey % 100"""


def _claimed(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("l_orderkey AS run_id", "CASE WHEN l_linenumber = 7 THEN 'note' ELSE 's3://b/' || l_partkey END AS uri")


def _inventory(spark, sf):
    return table(spark, sf, "part").selectExpr("'s3://b/' || CASE WHEN p_partkey % 10 = 3 THEN 'gone-' ELSE '' END || p_partkey AS uri", "CAST(p_size AS bigint) AS bytes")


def verified_claims(spark, sf):
    return audits.verify_claims(_claimed(spark, sf), _inventory(spark, sf), ["run_id"])


_CLAIMED = """WITH c AS (SELECT l_orderkey AS run_id, l_partkey AS p FROM lineitem WHERE l_linenumber <> 7), i AS (SELECT p_partkey AS p, p_size FROM part WHERE p_partkey % 10 <> 3)"""


def absent_claims(spark, sf):
    return audits.missing_claims(_claimed(spark, sf), _inventory(spark, sf))


def digests(spark, sf):
    docs = table(spark, sf, "documents")
    named = docs.selectExpr("'doc-' || doc_id AS name", "CASE WHEN doc_id % 13 = 0 THEN 'bad' ELSE sha2(text, 256) END AS want")
    have = docs.selectExpr("CASE WHEN doc_id % 17 = 0 THEN 'gone-' ELSE 'doc-' END || doc_id AS name", "text AS content")
    return audits.file_digest_problems(named, have)


def leaks(spark, sf):
    inventory = table(spark, sf, "documents").selectExpr("'s3://b/' || source || '/' || doc_id AS uri")
    held = table(spark, sf, "labels").where("quality = 1").selectExpr("'s3://b/src' || (doc_id % 20) || '/' || doc_id AS uri")
    return audits.leakage_path_guard(inventory, held, ["s3://b/src1/", "s3://b/src2/"], enforce=False)


_LEAKS = """SELECT 's3://b/' || source || '/' || doc_id AS uri FROM documents WHERE source IN ('src1', 'src2')
  AND 's3://b/' || source || '/' || doc_id IN (SELECT 's3://b/src' || (doc_id % 20) || '/' || doc_id FROM labels WHERE quality = 1)"""


# ---- intake ------------------------------------------------------------------------------

def facts(spark, sf):
    return intake.mine_facts(view(spark, sf, "turns"))


def facts_capped(spark, sf):
    return intake.mine_facts(view(spark, sf, "turns"), cap=3)


def _facts_sql(cap: int) -> str:
    alias = ", ".join(f"('{a}', '{c}')" for c, names in intake.ALIASES.items() for a in names)
    uri_fields = ", ".join(f"'{u}'" for u in intake.URI_FIELDS)
    return rf"""{with_views('turns')}, al(a, c) AS (VALUES {alias}), u AS (SELECT * FROM turns WHERE role = 'user'),
n0 AS (SELECT conv_id, turn, generate_subscripts(regexp_extract_all(text, '\b([A-Za-z_][A-Za-z0-9_]{{2,30}})[:=\s]\s*(s3://[^\s"''`,)\]}}]+)', 1), 1) AS i,
  unnest(regexp_extract_all(text, '\b([A-Za-z_][A-Za-z0-9_]{{2,30}})[:=\s]\s*(s3://[^\s"''`,)\]}}]+)', 1)) AS k, unnest(regexp_extract_all(text, '\b([A-Za-z_][A-Za-z0-9_]{{2,30}})[:=\s]\s*(s3://[^\s"''`,)\]}}]+)', 2)) AS v FROM u),
n AS (SELECT conv_id, turn, 0 AS g, i, c AS name, rtrim(v, '.,;') AS value FROM n0 JOIN al ON a = lower(k) WHERE c IN ({uri_fields})),
k0 AS (SELECT conv_id, turn, generate_subscripts(regexp_extract_all(text, '\b([A-Za-z_][A-Za-z0-9_]{{2,30}})\s*[:=]\s*([^\s,;]+)', 1), 1) AS i,
  unnest(regexp_extract_all(text, '\b([A-Za-z_][A-Za-z0-9_]{{2,30}})\s*[:=]\s*([^\s,;]+)', 1)) AS k, unnest(regexp_extract_all(text, '\b([A-Za-z_][A-Za-z0-9_]{{2,30}})\s*[:=]\s*([^\s,;]+)', 2)) AS v FROM u),
kv AS (SELECT conv_id, turn, 1 AS g, i, c AS name, rtrim(trim(trim(v, '"'), ''''), '.,;') AS value FROM k0 JOIN al ON a = lower(k) WHERE c NOT IN ({uri_fields}) AND NOT starts_with(v, 's3://')),
b0 AS (SELECT conv_id, turn, generate_subscripts(regexp_extract_all(text, 's3://[A-Za-z0-9._\-]+/[^\s"''`,)\]}}]*'), 1) AS i, rtrim(unnest(regexp_extract_all(text, 's3://[A-Za-z0-9._\-]+/[^\s"''`,)\]}}]*')), '.,;') AS value FROM u),
b AS (SELECT conv_id, turn, 2 AS g, min(i) AS i, 's3_uri' AS name, value FROM b0 WHERE (conv_id, turn, value) NOT IN (SELECT (conv_id, turn, value) FROM n) GROUP BY conv_id, turn, value),
t0 AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '\b[A-Z0-9]{{10}}\b')) AS value, generate_subscripts(regexp_extract_all(text, '\b[A-Z0-9]{{10}}\b'), 1) AS i FROM u WHERE regexp_matches(lower(text), 'kb|knowledge base|knowledge_base|retrieval|ingest')),
al4 AS (SELECT * FROM n UNION ALL SELECT * FROM kv UNION ALL SELECT * FROM b),
al5 AS (SELECT * FROM al4 UNION ALL SELECT conv_id, turn, 3, min(i), 'retrieval_kb_id', value FROM t0 WHERE (conv_id, turn, value) NOT IN (SELECT (conv_id, turn, value) FROM al4) GROUP BY conv_id, turn, value),
d AS (SELECT conv_id, name, value, min((turn, g, i)) AS at_ FROM al5 GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY at_) AS position, count(*) OVER (PARTITION BY conv_id) AS n FROM d)
SELECT conv_id, position, name, value FROM r WHERE position <= {cap}
UNION ALL SELECT DISTINCT conv_id, {cap + 1}, 'intake', 'cap' FROM r WHERE n > {cap}"""


def _forms(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_orderkey AS form_id", """map(
      'source', CASE WHEN o_orderkey % 3 = 0 THEN 'http://x' ELSE 's3://b/' || o_custkey END,
      'samples', CASE o_orderkey % 4 WHEN 0 THEN 'many' WHEN 1 THEN '' ELSE '' || o_custkey END,
      ' Keep_Endpoint ', CASE o_orderkey % 5 WHEN 0 THEN 'maybe' WHEN 1 THEN 'YES' ELSE 'no' END,
      'colour', 'blue',
      'kb_id', CASE WHEN o_orderkey % 2 = 0 THEN 'KB' ELSE '' END,
      'retrieval_k', '5') AS fields""")


_SPEC = (
    ("source_uri", "uri", True), ("sample_count", "number", True), ("keep_endpoint", "bool", False),
    ("retrieval_kb_id", "text", False), ("retrieval_k", "number", False), ("budget_usd", "number", True),
)
_GROUP = ("retrieval_kb_id", "retrieval_k")


def form_errors(spark, sf):
    return intake.validate_forms(_forms(spark, sf), _SPEC, _GROUP)[1]


def form_values(spark, sf):
    return intake.validate_forms(_forms(spark, sf), _SPEC, _GROUP)[0]


_FORM_ERRORS = """SELECT o_orderkey AS form_id, 'colour' AS field, 'not a field of this task type' AS error FROM orders
UNION ALL SELECT o_orderkey, 'source_uri', 'must be an s3:// URI' FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, 'sample_count', 'must be a number' FROM orders WHERE o_orderkey % 4 = 0
UNION ALL SELECT o_orderkey, 'sample_count', 'required' FROM orders WHERE o_orderkey % 4 = 1
UNION ALL SELECT o_orderkey, 'keep_endpoint', 'must be true or false' FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT o_orderkey, 'budget_usd', 'required' FROM orders
UNION ALL SELECT o_orderkey, 'retrieval', 'all or none; missing retrieval_kb_id' FROM orders WHERE o_orderkey % 2 = 1"""
_FORM_VALUES = """SELECT o_orderkey AS form_id, 'source_uri' AS param, 's3://b/' || o_custkey AS value FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT o_orderkey, 'sample_count', '' || o_custkey FROM orders WHERE o_orderkey % 4 > 1
UNION ALL SELECT o_orderkey, 'keep_endpoint', CASE o_orderkey % 5 WHEN 1 THEN 'true' ELSE 'false' END FROM orders WHERE o_orderkey % 5 <> 0
UNION ALL SELECT o_orderkey, 'retrieval_kb_id', 'KB' FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, 'retrieval_k', '5' FROM orders"""


def _readiness(spark, sf):
    plans = table(spark, sf, "customer").selectExpr("c_custkey AS task_id", """'{"source_uri":"' || c_name || '","datasheet":{"license":"' || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'MIT' END || '","consent":[]},"decontamination":' || CASE WHEN c_custkey % 3 = 0 THEN '{}' ELSE '{"a":1}' END || '}' AS data""")
    found = table(spark, sf, "orders").selectExpr("o_custkey AS task_id", "o_orderkey AS position", "CASE WHEN o_orderkey % 2 = 0 THEN 'customer_eval_uri' ELSE 'source_uri' END AS name", "'s3://b/' || o_orderkey AS value", "CASE WHEN o_orderkey % 3 = 0 THEN 'verified' ELSE 'failed' END AS status")
    forms = table(spark, sf, "customer").selectExpr("CASE WHEN c_custkey % 4 = 0 THEN c_custkey ELSE -1 - c_custkey END AS task_id", "'datasheet.license' AS name", "'form' AS value")
    return intake.readiness(plans, found, forms)


def readiness(spark, sf):
    return _readiness(spark, sf)


def readiness_score(spark, sf):
    return intake.readiness_score(_readiness(spark, sf))


_READY = f"""WITH q(field) AS (VALUES {', '.join(f"('{q}')" for q in intake.READINESS)}),
g AS (SELECT c_custkey AS task_id, field, CASE field WHEN 'source_uri' THEN c_name WHEN 'datasheet.license' THEN CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'MIT' END
  WHEN 'datasheet.consent' THEN '[]' WHEN 'decontamination' THEN CASE WHEN c_custkey % 3 = 0 THEN '{{}}' ELSE '{{"a":1}}' END END AS answer FROM customer CROSS JOIN q),
f AS (SELECT o_custkey AS task_id, CASE WHEN o_orderkey % 2 = 0 THEN 'customer_eval_uri' ELSE 'source_uri' END AS field, min(o_orderkey) AS k FROM orders GROUP BY 1, 2),
j AS (SELECT task_id, field, answer, coalesce(answer, '') NOT IN ('', '[]', '{{}}') AS answered, coalesce(k % 3 = 0, false) AS verified, k FROM g LEFT JOIN f USING (task_id, field)),
v AS (SELECT *, NOT verified AND NOT answered AND field = 'datasheet.license' AND task_id % 4 = 0 AS via_form FROM j),
o AS (SELECT task_id, field, answered, verified, via_form, CASE WHEN answered THEN answer WHEN verified THEN 's3://b/' || k WHEN via_form THEN 'form' ELSE '' END AS value FROM v)"""


def sessions(spark, sf):
    live = view(spark, sf, "runs").select("run_id", "created_at").withColumn(
        "rolled_session_ids", F.when(F.col("run_id") % 2 == 0, F.array(F.concat(F.lit("rolled-"), F.col("run_id").cast("string")))).otherwise(F.array().cast("array<string>")))
    live = live.withColumn("run_id", F.concat(F.lit("run-"), F.col("run_id").cast("string")))
    seen = table(spark, sf, "events").selectExpr(
        "CASE WHEN user_id % 3 = 0 THEN 'none-' ELSE 'run-' END || user_id AS run_id", "CASE event_type WHEN 'view' THEN 'data-prep' WHEN 'click' THEN 'finetune' WHEN 'error' THEN 'eval' ELSE 'other' END AS stage",
        "CASE WHEN user_id % 2 = 0 THEN '' WHEN event_id % 2 = 0 THEN 'generate' ELSE 'launch' END AS task")
    return intake.session_ids(live, seen, 200, "2024-01-12")


_TASKS = ", ".join(f"({i}, '{s}', '{t}')" for i, (s, t) in enumerate(intake.STAGE_TASKS))
_SESSIONS = f"""{with_views('runs')}, st(i, stage, task) AS (VALUES {_TASKS}),
ev AS (SELECT DISTINCT user_id AS run_id, CASE event_type WHEN 'view' THEN 'data-prep' WHEN 'click' THEN 'finetune' WHEN 'error' THEN 'eval' ELSE 'other' END AS stage,
  CASE WHEN user_id % 2 = 0 THEN '' WHEN event_id % 2 = 0 THEN 'generate' ELSE 'launch' END AS task FROM events WHERE user_id % 3 <> 0),
r AS (SELECT run_id, created_at FROM runs WHERE created_at >= '2024-01-12'),
x AS (SELECT r.run_id, created_at, i, 'run-' || r.run_id || '-' || stage || '-' || task AS base FROM r CROSS JOIN st
  WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.run_id = r.run_id) OR EXISTS (SELECT 1 FROM ev WHERE ev.run_id = r.run_id AND ev.stage = st.stage AND ev.task IN ('', st.task))),
y AS (SELECT run_id, created_at, i, CASE WHEN length(base) >= 33 THEN substr(base, 1, 100) ELSE substr(base || '-' || sha256(base), 1, 64) END AS session_id FROM x
  UNION ALL SELECT run_id, created_at, 9, 'rolled-' || run_id FROM r WHERE run_id % 2 = 0)
SELECT row_number() OVER (ORDER BY created_at DESC, 'run-' || run_id DESC, i) AS position, 'run-' || run_id AS run_id, session_id FROM y QUALIFY position <= 200"""


def turn_classes(spark, sf):
    return intake.classify_turns(view(spark, sf, "endings")).select("conv_id", "turn", "turn_end", "call", "arguments")


_TURNS = f"""{with_views('endings')} SELECT conv_id, turn, CASE WHEN tool_name = 'checkpoint' THEN 'structured' WHEN conv_id % 4 = 1 OR conv_id % 2 = 0 AND turn % 2 = 1 THEN 'recovered' ELSE 'prose' END AS turn_end,
  CASE WHEN tool_name = 'checkpoint' OR conv_id % 4 = 1 THEN 'checkpoint' WHEN conv_id % 2 = 0 AND turn % 2 = 1 THEN 'stage_complete' END AS call,
  CASE WHEN tool_name = 'checkpoint' THEN NULL WHEN conv_id % 4 = 1 THEN '{{}}' WHEN conv_id % 4 = 0 AND turn % 2 = 1 THEN '{{"a":1}}' WHEN conv_id % 2 = 0 AND turn % 2 = 1 THEN '{{"a": {{"b": "}}"}}}}' END AS arguments FROM endings"""


def turn_counts(spark, sf):
    return intake.turn_end_counts(intake.classify_turns(view(spark, sf, "endings")), ["role"])


def _threads(spark, sf):
    chunks = table(spark, sf, "conversations").selectExpr("conv_id", "'k-' || lpad(turn, 6, '0') AS key", "0 AS pos", "role", "text")
    return intake.rebuild_transcripts(chunks, display=200, audit=400)


def transcripts(spark, sf):
    return _threads(spark, sf).drop("pos")


def thread_states(spark, sf):
    status = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("t")).selectExpr(
        "conv_id", "CASE WHEN conv_id % 2 = 0 THEN 'thinking' ELSE 'closed' END AS status", "timestamp'2024-01-31 11:59:00' - make_interval(0, 0, 0, 0, 0, CAST(conv_id % 40 AS int)) AS updated_at")
    return intake.thread_summary(_threads(spark, sf), status, NOW)


_LOGLINE = """CASE event_id % 7 WHEN 0 THEN '{"attributes":{"gen_ai.evaluation.name":"Builtin.' || event_type || '","gen_ai.evaluation.score.value":' || (user_id % 5) || '}}'
 WHEN 1 THEN '{"evaluatorId":"' || event_type || '","score":' || (user_id % 3) || '}' WHEN 2 THEN '{"evaluator":"' || event_type || '","value":{"score":2.5}}'
 WHEN 3 THEN '{"metricName":"gen_ai.evaluation.result","score":1}' WHEN 4 THEN '{"evaluatorName":"' || event_type || '","result":"high"}'
 WHEN 5 THEN '{"evaluatorName":"other","metricValue":{"value":' || (event_id % 9) || '}}' ELSE 'not json' END"""


def score_stats(spark, sf):
    logs = table(spark, sf, "events").selectExpr(_LOGLINE + " AS message")
    return intake.eval_score_stats(logs, "message")


_SCORES = """WITH s AS (SELECT CASE WHEN k = 5 THEN 'other' ELSE event_type END AS evaluator, CASE k WHEN 0 THEN user_id % 5 WHEN 1 THEN user_id % 3 WHEN 2 THEN 2.5 ELSE event_id % 9 END AS v
  FROM (SELECT *, event_id % 7 AS k FROM events) WHERE k IN (0, 1, 2, 5)) SELECT evaluator, count(*) AS n, CAST(sum(CAST(v AS DECIMAL(38,12))) AS DOUBLE) / count(*) AS avg_score FROM s GROUP BY 1"""


def batch_evals(spark, sf):
    res = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS id", "CASE WHEN o_custkey % 2 = 0 THEN 'acme_be_' ELSE 'other_' END || o_orderkey AS name", "o_orderdate AS created_at", "o_custkey % 10 AS total", "o_custkey % 7 AS completed", "o_custkey % 3 AS failed",
        "CASE WHEN o_orderkey % 3 = 0 THEN array() ELSE array(named_struct('evaluator', 'Builtin.' || o_orderpriority, 'avg', CAST(o_orderkey % 5 AS double), 'evaluated', o_orderkey % 9, 'failed', o_orderkey % 2)) END AS evaluators")
    return intake.batch_eval_rollup(res, "acme_be_", 40)


_BATCH = """WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS position FROM orders WHERE o_custkey % 2 = 0)
SELECT position, o_orderkey AS id, 'acme_be_' || o_orderkey AS name, o_custkey % 10 AS sessions_total, o_custkey % 7 AS sessions_completed, o_custkey % 3 AS sessions_failed,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS evaluator, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 5 AS DOUBLE) END AS avg_score,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 9 END AS evaluated, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 2 END AS failed FROM r WHERE position <= 40"""


def latest_orders(spark, sf):
    from tallyloom.operators.ordering import newest_overall

    return newest_overall(table(spark, sf, "orders"), [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 25).select("position", "o_orderkey", "truncated")


QUERIES = {
    "a10_scan_ordered_window": latest_orders,
    "a11_extract_uris": uris,
    "a12_verify_claims": verified_claims,
    "a12_missing_claims": absent_claims,
    "a13_verify_file_manifest": digests,
    "b25_leakage_path_guard": leaks,
    "d27_instrument_attestation": attested,
    "f1_normalize_claims": claims,
    "f2_run_report_counts": report_counts,
    "f2_run_report_findings": findings,
    "a8_latest_report": latest_alias,
    "f3_stage_flow": stage_flow,
    "f3_iterations": iterations,
    "f4_timeline_newest": timeline,
    "f5_directives": parked,
    "f6_waiting_on_human": waiting,
    "f7_protocol_rollup": protocol,
    "f8_monotonic_upsert": upserted,
    "f9_slot_outcomes": outcomes,
    "f9_reliability_probe": probe,
    "f10_liveness_sweep": liveness,
    "f11_fleet_metrics": fleet,
    "f11_token_totals": token_use,
    "f11_daily_series": daily,
    "f12_eval_score_stats": score_stats,
    "f13_session_ids": sessions,
    "f14_error_alarms": errors_ringing,
    "f14_silence_alarms": silence,
    "f15_health": health,
    "f15_drift_events": drift,
    "f16_unknown_event_types": vocabulary,
    "f16_misrouted_event_types": misrouted,
    "f17_classify_stop": stops,
    "f18_mine_facts": facts,
    "f18_mine_facts_capped": facts_capped,
    "f19_form_errors": form_errors,
    "f19_form_values": form_values,
    "f20_readiness": readiness,
    "f20_readiness_score": readiness_score,
    "f21_hash_chain": hash_chain,
    "f21_first_break": chain_break,
    "f22_table_drift": drifted,
    "f23_secret_scan": secrets,
    "f24_step_timing": steps,
    "f25_validate_manifests": manifests,
    "f26_immutable_field_tamper": tampered,
    "f27_turn_end_classification": turn_classes,
    "f27_turn_end_counts": turn_counts,
    "f28_directive_delivery": delivery,
    "f29_join_job_events": joined_jobs,
    "f30_stage_history": history_list,
    "f30_stage_map": last_by_stage,
    "f30_escalation_records": escalated,
    "f31_rebuild_transcripts": transcripts,
    "f31_thread_states": thread_states,
    "f32_training_log_summary": train_log,
    "f32_eval_loss_by_epoch": eval_losses,
    "f32_training_progress": progress,
    "f33_batch_eval_rollup": batch_evals,
    "f34_run_story": story,
}

SQL = {
    "a10_scan_ordered_window": "SELECT row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS position, o_orderkey, (SELECT count(*) > 25 FROM orders) AS truncated FROM orders QUALIFY position <= 25",
    "a11_extract_uris": _URIS,
    "a12_verify_claims": f"{_CLAIMED} SELECT run_id, count(i.p) AS verified, count(*) - count(i.p) AS missing, CAST(coalesce(sum(p_size), 0) AS BIGINT) AS bytes FROM c LEFT JOIN i USING (p) GROUP BY 1",
    "a12_missing_claims": f"{_CLAIMED} SELECT run_id, 's3://b/' || p AS uri FROM c WHERE p NOT IN (SELECT p FROM i)",
    "a13_verify_file_manifest": "SELECT 'doc-' || doc_id AS name, CASE WHEN doc_id % 17 = 0 THEN 'missing' ELSE 'sha256 mismatch' END AS problem FROM documents WHERE doc_id % 17 = 0 OR doc_id % 13 = 0",
    "b25_leakage_path_guard": _LEAKS,
    "d27_instrument_attestation": f"WITH {_ATT} SELECT state, state = 'verified' AS verified, count(*) AS n FROM t GROUP BY 1",
    "f1_normalize_claims": _CLAIMS,
    "f2_run_report_counts": _COUNTS,
    "f2_run_report_findings": _FINDINGS,
    "a8_latest_report": "SELECT o_orderkey AS run_id, o_totalprice AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1",
    "f3_stage_flow": _FLOW,
    "f3_iterations": f"{with_views('history')} SELECT execution, count(*) AS iterations FROM history WHERE kind = 'entered' AND state = 'IncrementIteration' GROUP BY 1",
    "f4_timeline_newest": _newest_sql("event", 20),
    "f5_directives": _newest_sql("directive", 10),
    "f6_waiting_on_human": _WAITING,
    "f7_protocol_rollup": _PROTOCOL,
    "f8_monotonic_upsert": f"{with_views('protocol')} SELECT run_id, stage, task, epoch, turns, arrival FROM protocol QUALIFY row_number() OVER (PARTITION BY run_id, stage, task, epoch ORDER BY turns DESC, arrival DESC) = 1",
    "f9_slot_outcomes": f"{_OUTCOMES} SELECT outcome, count(*) AS n FROM o GROUP BY 1",
    "f9_reliability_probe": _PROBE,
    "f10_liveness_sweep": _LIVENESS,
    "f11_fleet_metrics": _FLEET,
    "f11_token_totals": _TOKEN_USE,
    "f11_daily_series": f"{with_views('metrics')} SELECT owner, strftime(ts, '%Y-%m-%d') AS day, CAST(sum(value) AS DOUBLE) AS value FROM metrics WHERE metric = 'Invocations' GROUP BY 1, 2",
    "f12_eval_score_stats": _SCORES,
    "f13_session_ids": _SESSIONS,
    "f14_error_alarms": f"{with_views('metrics')} SELECT owner, CAST(floor(epoch(ts) / 300) AS BIGINT) * 300 AS bucket, CAST(sum(value) AS BIGINT) AS value FROM metrics WHERE metric = 'Errors' GROUP BY 1, 2 HAVING sum(value) >= 40",
    "f14_silence_alarms": _SILENCE,
    "f15_health": _HEALTH,
    "f15_drift_events": f"SELECT endpoint, length_shift FROM ({_HEALTH}) WHERE drift_detected",
    "f16_unknown_event_types": "SELECT event_type AS detail_type, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1",
    "f16_misrouted_event_types": "SELECT event_type || (user_id % 5) AS detail_type, count(DISTINCT CASE WHEN user_id % 5 = 2 AND event_id % 2 = 0 THEN 'routed' WHEN user_id % 5 = 4 THEN NULL ELSE 'recorded' END) AS n_routes FROM events GROUP BY 1 HAVING n_routes <> 1",
    "f17_classify_stop": f"{with_views('jobs')} SELECT event_id, status, CASE WHEN status = 'Completed' THEN 'completed' WHEN status = 'Stopped' AND billable_s = 0 THEN 'capacity' ELSE 'failed' END AS outcome FROM jobs",
    "f18_mine_facts": _facts_sql(1 << 40),
    "f18_mine_facts_capped": _facts_sql(3),
    "f19_form_errors": _FORM_ERRORS,
    "f19_form_values": _FORM_VALUES,
    "f20_readiness": f"{_READY} SELECT * FROM o",
    "f20_readiness_score": f"{_READY} SELECT task_id, count(*) FILTER (answered) AS answered, count(*) AS total FROM o GROUP BY 1",
    "f21_hash_chain": f"{_CHAIN} SELECT * FROM a",
    "f21_first_break": f"{_CHAIN} SELECT chain, o_orderkey, hash_ok, link_ok FROM a WHERE NOT hash_ok OR NOT link_ok QUALIFY row_number() OVER (PARTITION BY chain ORDER BY o_orderkey) = 1",
    "f22_table_drift": _DRIFT,
    "f23_secret_scan": _SECRETS,
    "f24_step_timing": _STEPS,
    "f25_validate_manifests": _MANIFESTS,
    "f26_immutable_field_tamper": _TAMPER,
    "f27_turn_end_classification": _TURNS,
    "f27_turn_end_counts": f"SELECT role, count(*) AS turns, count(*) FILTER (turn_end <> 'prose') AS serviced_turns, count(*) FILTER (turn_end = 'prose') AS prose_turns, count(*) FILTER (turn_end = 'recovered') AS recovered_typed_calls FROM ({_TURNS.replace('SELECT conv_id,', 'SELECT role, conv_id,', 1)}) GROUP BY 1",
    "f28_directive_delivery": _DELIVERY,
    "f29_join_job_events": _JOINED,
    "f30_stage_history": f"{with_views('run_events')} SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS position, event_id, stage FROM run_events",
    "f30_stage_map": f"{with_views('run_events')} SELECT run_id, stage, count(*) OVER (PARTITION BY run_id, stage) AS n_records, event_id, name FROM run_events QUALIFY row_number() OVER (PARTITION BY run_id, stage ORDER BY ts DESC, event_id DESC) = 1",
    "f30_escalation_records": f"{with_views('run_events')} SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS position, event_id % 3 AS iteration, CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE stage END AS stage, CASE event_id % 4 WHEN 0 THEN 'no reason recorded' ELSE detail END AS reason, 'critical' AS severity FROM run_events WHERE name = 'HumanPaged'",
    "f32_training_progress": _PROGRESS,
    "f31_rebuild_transcripts": "SELECT conv_id, 'k-' || lpad('' || turn, 6, '0') AS key, role, substr(text, 1, 200) AS display_text, substr(text, 1, 400) AS audit_text, length(text) > 200 AS display_cut, length(text) > 400 AS audit_cut FROM conversations",
    "f31_thread_states": "SELECT conv_id, count(*) AS n_messages, count(*) FILTER (length(text) > 200) AS n_cut, CASE WHEN conv_id % 2 = 0 THEN 'thinking' ELSE 'closed' END AS status, conv_id % 2 = 0 AND conv_id % 40 + 1 > 20 AS stale FROM conversations GROUP BY conv_id",
    "f32_training_log_summary": _LOG,
    "f32_eval_loss_by_epoch": f"{with_views('steps')} SELECT run_id, epoch, CAST(arg_max(eval_loss, step) AS DOUBLE) AS eval_loss FROM steps WHERE eval_loss IS NOT NULL GROUP BY 1, 2",
    "f33_batch_eval_rollup": _BATCH,
    "f34_run_story": _STORY,
}
