"""Cost queries over the given tables and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.names import run_id_from_resource
from tallyloom.functions.stats import money
from tallyloom.operators import actuals, estimates, rates
from tallyloom.plans.views import PATTERNS, PREFIXES, PROJECT, view, with_views
from tallyloom.session import table

TODAY = "2001-06-01"
MONEY = "CAST(sum(CAST({} AS DECIMAL(38,12))) AS DOUBLE)"


def _sum(col: str) -> str:
    return MONEY.format(col)


# ---- rates -------------------------------------------------------------------------------

def usage_rates(spark, sf):
    return rates.realized_rates(
        view(spark, sf, "billing"), "2002-01-01", ["l_shipdate", "l_orderkey", "l_linenumber", "quantity", "cost_usd"]
    )


_REALIZED = """
  SELECT sku, cost_usd / quantity AS unit_price, 'unit' AS unit,
         'ce_realized' AS source, '2002-01-01' AS as_of
  FROM (SELECT usage_type AS sku, cost_usd, quantity, row_number() OVER (PARTITION BY usage_type
          ORDER BY l_shipdate, l_orderkey, l_linenumber, quantity, cost_usd) AS rn
        FROM billing WHERE quantity > 0)
  WHERE rn = 1
"""


def list_card(spark, sf):
    """Part list prices as a price-list card; some rows carry an unknown source or no date."""
    return table(spark, sf, "part").selectExpr(
        "'part-' || p_partkey AS sku", "p_retailprice AS unit_price", "'unit' AS unit",
        "CASE p_partkey % 3 WHEN 0 THEN 'price_list' WHEN 1 THEN 'fallback_static' ELSE 'rumour' END AS source",
        "CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'not a date' WHEN 2 THEN '2001-12-20T00:00:00Z' ELSE '2001-10-01' END AS as_of",
    )


_LIST = """
  SELECT 'part-' || p_partkey AS sku, p_retailprice AS unit_price, 'unit' AS unit,
         CASE p_partkey % 3 WHEN 0 THEN 'price_list' WHEN 1 THEN 'fallback_static' ELSE 'rumour' END AS source,
         CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'not a date' WHEN 2 THEN '2001-12-20T00:00:00Z' ELSE '2001-10-01' END AS as_of
  FROM part
"""


def static_card(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "'part-' || p_partkey AS sku", "CAST(p_size AS DOUBLE) AS unit_price", "'unit' AS unit",
        "CASE WHEN p_size > 25 THEN 'price_list' ELSE 'fallback_static' END AS source",
        "'2001-12-01' AS as_of",
    )


_STATIC = """
  SELECT 'part-' || p_partkey AS sku, CAST(p_size AS DOUBLE) AS unit_price, 'unit' AS unit,
         CASE WHEN p_size > 25 THEN 'price_list' ELSE 'fallback_static' END AS source, '2001-12-01' AS as_of
  FROM part
"""


def merged_card(spark, sf):
    cheap = usage_rates(spark, sf).where(F.col("unit_price") < 1500)
    return rates.merge_rates(list_card(spark, sf), static_card(spark, sf), cheap)


_MERGED = f"""
  SELECT sku, unit_price, unit,
         CASE WHEN r > 2 THEN 'fallback_static' ELSE source END AS source, as_of
  FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY r, c) AS rn FROM (
          SELECT *, CASE source WHEN 'ce_realized' THEN 0 WHEN 'price_list' THEN 1
                                WHEN 'fallback_static' THEN 2 ELSE 3 END AS r
          FROM (SELECT *, 0 AS c FROM ({_LIST}) UNION ALL SELECT *, 1 FROM ({_STATIC})
                UNION ALL SELECT *, 2 FROM ({_REALIZED}) WHERE unit_price < 1500)))
  WHERE rn = 1
"""


def _required(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("'part-' || l_partkey * 2 AS sku")


def rate_health(spark, sf):
    return rates.rate_health(merged_card(spark, sf), _required(spark, sf), "2002-01-01T00:00:00Z")


_HEALTH = f"""{with_views('billing')}, card AS ({_MERGED}),
req AS (SELECT DISTINCT 'part-' || l_partkey * 2 AS sku FROM lineitem),
old AS (SELECT count(*) AS n FROM card WHERE TRY_CAST(as_of AS TIMESTAMPTZ) IS NULL
        OR floor((epoch(TIMESTAMPTZ '2002-01-01 00:00:00+00') - epoch(TRY_CAST(as_of || CASE WHEN length(as_of) = 10 THEN ' 00:00:00+00' ELSE '' END AS TIMESTAMPTZ))) / 86400) > 30)
SELECT t.n_rates, t.oldest_as_of, m.n AS n_missing, old.n AS n_stale, (m.n = 0 AND old.n = 0) AS healthy
FROM (SELECT count(*) AS n_rates, min(as_of) AS oldest_as_of FROM card) t,
     (SELECT count(*) AS n FROM req WHERE sku NOT IN (SELECT sku FROM card)) m, old
"""


def rate_history(spark, sf):
    """Dated rates: the average realized price per part and month, known from the next month on."""
    return (
        view(spark, sf, "billing")
        .groupBy(F.col("usage_type").alias("sku"), F.expr("last_day(period) + 1").alias("as_of"))
        .agg((F.sum(money("cost_usd")).cast("double") / F.sum(money("quantity")).cast("double")).alias("unit_price"))
        .withColumn("source", F.lit("ce_realized"))
    )


def asof_pricing(spark, sf):
    events = view(spark, sf, "billing").selectExpr(
        "usage_type AS sku", "l_orderkey", "l_linenumber", "CAST(l_shipdate AS timestamp) AS at", "quantity"
    )
    priced = rates.price_as_of(events, rate_history(spark, sf), "at")
    return priced.selectExpr(
        "sku", "l_orderkey", "l_linenumber", "quantity", "unit_price",
        "date_format(at, 'yyyy-MM-dd') AS at_day",
        "date_format(rate_card_as_of, 'yyyy-MM-dd') AS rate_card_as_of",
    )


_ASOF = f"""{with_views('billing')}, hist AS (
  SELECT usage_type AS sku, last_day(period) + 1 AS as_of,
         {_sum('cost_usd')} / {_sum('quantity')} AS unit_price FROM billing GROUP BY 1, 2)
SELECT b.usage_type AS sku, b.l_orderkey, b.l_linenumber, b.quantity, h.unit_price,
       strftime(b.period, '%Y-%m-%d') AS at_day, strftime(h.as_of, '%Y-%m-%d') AS rate_card_as_of
FROM billing b ASOF LEFT JOIN hist h ON b.usage_type = h.sku AND b.period >= h.as_of
"""


# ---- estimates ---------------------------------------------------------------------------

_SKUS = """CASE p_partkey % 12
  WHEN 0 THEN 'sagemaker:training:ml.g5.2xlarge' WHEN 1 THEN 'sagemaker:inference:ml.g5.xlarge'
  WHEN 2 THEN 'bedrock:teacher-0:input-tokens' WHEN 3 THEN 'bedrock:teacher-0:output-tokens'
  WHEN 4 THEN 'bedrock:teacher-1:input-tokens' WHEN 5 THEN 'bedrock:teacher-1:output-tokens'
  WHEN 6 THEN 'agentcore:runtime:vcpu-hours' WHEN 7 THEN 'agentcore:runtime:gb-hours'
  WHEN 8 THEN 'bedrock:agent-0:input-tokens' WHEN 9 THEN 'bedrock:agent-0:output-tokens'
  WHEN 10 THEN 'agentcore:memory:short-term-events'
  ELSE 'agentcore:evaluations:builtin-input-tokens' END"""
_CARD_COLS = (
    "sku, min(floor(p_retailprice)) / 1000.0 AS unit_price, 'unit' AS unit,"
    " CASE WHEN min(p_partkey) % 2 = 0 THEN 'ce_realized' ELSE 'price_list' END AS source,"
    " '2002-01-01' AS as_of"
)


def sku_card(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("tl_part")
    return spark.sql(f"SELECT {_CARD_COLS} FROM (SELECT *, {_SKUS} AS sku FROM tl_part) GROUP BY sku")


def priced_lines(spark, sf):
    return estimates.estimate_lines(view(spark, sf, "plans"), sku_card(spark, sf))


def estimate_lines(spark, sf):
    return priced_lines(spark, sf).drop("rate_as_of")


_LINES = f"""{with_views('plans')},
card AS (SELECT {_CARD_COLS} FROM (SELECT *, {_SKUS} AS sku FROM part) GROUP BY sku),
raw AS (
  SELECT plan_id, 'sagemaker_training' AS category, 'sagemaker:training:' || training_instance AS sku,
         (sample_count / (16550.0::DOUBLE / 24924) + 670.0) / 3600.0 AS quantity, 'hours' AS unit, true AS remediable, NULL::DOUBLE AS flat FROM plans
  UNION ALL SELECT plan_id, 'sagemaker_inference', 'sagemaker:inference:ml.g5.xlarge', endpoint_hours, 'hours', false, NULL FROM plans WHERE endpoint_hours <> 0
  UNION ALL SELECT plan_id, 'bedrock_teacher', 'bedrock:' || teacher_model || ':input-tokens', sample_count * 2014::DOUBLE / 1000.0, '1K tokens', false, NULL FROM plans
  UNION ALL SELECT plan_id, 'bedrock_teacher', 'bedrock:' || teacher_model || ':output-tokens', sample_count * (1050::DOUBLE * CASE WHEN keep_reasoning THEN 12.5::DOUBLE ELSE 1::DOUBLE END) / 1000.0, '1K tokens', false, NULL FROM plans
  UNION ALL SELECT plan_id, 'agentcore_runtime', 'agentcore:runtime:vcpu-hours', 0.9::DOUBLE, 'vCPU-hours', true, NULL FROM plans
  UNION ALL SELECT plan_id, 'agentcore_runtime', 'agentcore:runtime:gb-hours', 1.8::DOUBLE, 'GB-hours', true, NULL FROM plans
  UNION ALL SELECT plan_id, 'agentcore_model', 'bedrock:' || harness_model || ':input-tokens', 360::DOUBLE, '1K tokens', true, NULL FROM plans
  UNION ALL SELECT plan_id, 'agentcore_model', 'bedrock:' || harness_model || ':output-tokens', 54::DOUBLE, '1K tokens', true, NULL FROM plans
  UNION ALL SELECT plan_id, 'agentcore_memory', 'agentcore:memory:short-term-events', 180::DOUBLE, 'events', false, NULL FROM plans
  UNION ALL SELECT plan_id, 'agentcore_evaluations', 'agentcore:evaluations:builtin-input-tokens', evaluation_input_tokens / 1000000, '1M tokens', false, NULL FROM plans WHERE evaluation_input_tokens <> 0
  UNION ALL SELECT plan_id, 'retrieval_index', 'aoss:vector-collection:ocu-hours', kb_ocu_hours, 'OCU-hours', false, NULL FROM plans WHERE kb_ocu_hours <> 0
  UNION ALL SELECT plan_id, 'retrieval_index', 'bedrock:amazon.titan-embed-text-v2:0:input-tokens', kb_embed_ingest_tokens / 1000, '1K tokens', false, NULL FROM plans WHERE kb_embed_ingest_tokens <> 0
  UNION ALL SELECT plan_id, 'support', 'support:s3-ddb-lambda-sfn', 1::DOUBLE, 'run', false, 0.5::DOUBLE FROM plans),
priced AS (
  SELECT raw.* EXCLUDE (flat), coalesce(flat, card.unit_price, fb.price) AS unit_price,
         CASE WHEN flat IS NOT NULL OR (card.sku IS NULL AND fb.price IS NOT NULL) THEN 'fallback_static' ELSE card.source END AS rate_source
  FROM raw LEFT JOIN card USING (sku)
  LEFT JOIN (VALUES ('aoss:vector-collection:ocu-hours', 0.24::DOUBLE), ('bedrock:amazon.titan-embed-text-v2:0:input-tokens', 0.00002::DOUBLE)) fb(sku, price) USING (sku)),
lines AS (SELECT *, round(quantity * unit_price, 6) AS cost_usd FROM priced)
"""


def estimate_rollup(spark, sf):
    plans = view(spark, sf, "plans")
    return estimates.estimate_rollup(priced_lines(spark, sf), plans).withColumn(
        "unpriced", F.concat_ws(",", "unpriced")
    )


_ROLLUP = f"""{_LINES}, agg AS (
  SELECT plan_id, coalesce({_sum('cost_usd')}, 0) AS total_usd,
         coalesce(CAST(sum(CASE WHEN remediable THEN CAST(cost_usd AS DECIMAL(38,12)) END) AS DOUBLE), 0) AS remediable_usd,
         max(CASE rate_source WHEN 'ce_realized' THEN 0 WHEN 'price_list' THEN 1 ELSE 2 END) AS r,
         coalesce(string_agg(DISTINCT CASE WHEN cost_usd IS NULL THEN sku END, ',' ORDER BY CASE WHEN cost_usd IS NULL THEN sku END), '') AS unpriced,
         count(*) FILTER (cost_usd IS NULL) AS nu
  FROM lines GROUP BY 1)
SELECT plan_id, total_usd, total_usd + (max_iterations - 1) * remediable_usd AS worst_case_usd, max_iterations, remediable_usd,
       CASE WHEN nu > 0 OR r = 2 THEN 'guessed' WHEN r = 1 THEN 'modelled' ELSE 'measured' END AS confidence,
       unpriced, nu > 0 AS total_is_floor
FROM agg JOIN plans USING (plan_id)
"""


def required_skus(spark, sf):
    """SKUs the plans need that the card does not price."""
    need = rates.required_skus(view(spark, sf, "plans"))
    return rates.missing(sku_card(spark, sf), need)


def budget_decision(spark, sf):
    ests = view(spark, sf, "estimates").withColumn("cost", F.coalesce("worst_case_usd", "total_usd"))
    running = estimates.with_running_spend(
        ests, "project", ["created_at", "id"], F.date_trunc("month", "created_at"), "cost"
    )
    out = estimates.budget_decision(running, 500_000.0, 40_000_000.0, "blocking")
    return out.select("id", "gating_usd", "project_to_date_usd", "over_single", "over_cumulative",
                      "over_budget_usd", "approval_required", "budget_status")


_BUDGET = f"""{with_views('estimates')}, e AS (
  SELECT *, coalesce(worst_case_usd, total_usd) AS gating_usd FROM estimates),
r AS (SELECT *, CAST(sum(CAST(gating_usd AS DECIMAL(38,12))) OVER (PARTITION BY project ORDER BY created_at, id ROWS UNBOUNDED PRECEDING)
        - CAST(gating_usd AS DECIMAL(38,12)) AS DOUBLE) AS project_to_date_usd FROM e),
d AS (SELECT *, gating_usd > 500000 AS over_single, project_to_date_usd + gating_usd > 40000000 AS over_cumulative FROM r)
SELECT id, gating_usd, project_to_date_usd, over_single, over_cumulative,
       greatest(0.0, gating_usd - 500000) AS over_budget_usd, (over_single OR over_cumulative) AS approval_required,
       CASE WHEN over_single OR over_cumulative THEN 'pending_approval' ELSE 'approved' END AS budget_status
FROM d
"""


def approval_audit(spark, sf):
    records = view(spark, sf, "estimates").withColumn(
        "approver_groups", F.when(F.col("in_group"), F.array(F.lit("approvers"))).otherwise(F.array(F.lit("staff")))
    )
    return estimates.approval_audit(records, "approvers").select("id", "failure", "code", "may_launch")


_APPROVAL = f"""{with_views('estimates')}, f AS (
  SELECT id, status, CASE WHEN NOT in_group THEN 'group' WHEN requested_by = approver THEN 'self'
    WHEN status <> 'pending_approval' THEN 'status' WHEN decision = 'reject' AND reason = '' THEN 'reason' END AS failure FROM estimates)
SELECT id, failure, CASE failure WHEN 'group' THEN 403 WHEN 'self' THEN 403 WHEN 'status' THEN 409 WHEN 'reason' THEN 400 ELSE 200 END AS code,
       status = 'approved' AS may_launch FROM f
"""


def estimate_queue(spark, sf):
    out = estimates.estimate_queue(view(spark, sf, "estimates"), 50, "budget_mode string, gating_usd double")
    return out.select("position", "id", "status", "pending", "truncated", F.col("gate.gating_usd").alias("gating_usd"))


_QUEUE = f"""{with_views('estimates')}, r AS (
  SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) AS position, count(*) OVER () > 50 AS truncated FROM estimates)
SELECT position, id, status, status = 'pending_approval' AS pending, truncated,
       CAST(gate->>'gating_usd' AS DOUBLE) AS gating_usd FROM r WHERE position <= 50
"""


# ---- actuals -----------------------------------------------------------------------------

def attributed(spark, sf):
    return actuals.attribute_actuals(view(spark, sf, "billing"), PATTERNS, PREFIXES).withColumn(
        "period", F.col("period").cast("string")
    )


_TAGGED = f"""{with_views('billing')}, named AS (
  SELECT *, regexp_extract(resource_id, '([^/]*)$', 1) AS nm,
    contains(resource_id, 'training-job/acme-') OR contains(resource_id, 'endpoint/acme-') OR contains(resource_id, 'runtime/harness_acme_') AS ours
  FROM billing),
stripped AS (
  SELECT *, CASE WHEN nm LIKE 'acme-qlora-%' THEN substr(nm, 12) WHEN nm LIKE 'acme-student-%' THEN substr(nm, 14)
                 WHEN nm LIKE 'acme-%' THEN substr(nm, 6) END AS rest FROM named),
tagged AS (
  SELECT *, coalesce(nullif(regexp_replace(regexp_replace(rest, '^(.*)-[a-z][0-9]+$', '\\1'), '^(.*)-[0-9]+$', '\\1'), ''), 'unattributed') AS run_id,
    CASE WHEN contains(resource_id, 'training-job/') THEN 'sagemaker_training' WHEN contains(resource_id, 'endpoint') THEN 'sagemaker_inference'
         WHEN contains(resource_id, 'runtime/') THEN 'agentcore_runtime' ELSE 'support' END AS category
  FROM stripped)"""


def attributed_by_resource(spark, sf):
    return actuals.attributed_resources(view(spark, sf, "billing"), PATTERNS, PREFIXES).withColumn("period", F.col("period").cast("string"))


def excluded(spark, sf):
    return actuals.excluded_actuals(view(spark, sf, "billing"), PATTERNS, PREFIXES).withColumn(
        "period", F.col("period").cast("string")
    )


def resource_run_ids(spark, sf):
    return (
        view(spark, sf, "billing")
        .select("resource_id", run_id_from_resource(F.col("resource_id"), PREFIXES).alias("run_id"))
        .distinct()
    )


def settlement_by_run(spark, sf):
    return actuals.run_settlement(view(spark, sf, "ledger"))


def open_periods(spark, sf):
    return actuals.periods_to_reconcile(view(spark, sf, "ledger"), TODAY).withColumn(
        "period", F.col("period").cast("string")
    )


def _fresh(df):
    return df.where(F.col("settlement") == "provisional").withColumns(
        {"settlement": F.lit("settled"), "cost_usd": F.col("cost_usd") + 1.0}
    )


def upserted_ledger(spark, sf):
    old = view(spark, sf, "ledger")
    out = actuals.upsert_actuals(old, _fresh(old))
    return out.groupBy("project", F.col("period").cast("string").alias("period"), "settlement").agg(
        F.count("*").alias("n_rows"), F.sum(money("cost_usd")).cast("double").alias("cost_usd")
    )


def tag_check(spark, sf):
    ledger = view(spark, sf, "ledger")
    totals = ledger.groupBy("run_id").agg(
        F.sum(money("cost_usd")).cast("double").alias("resource_usd"),
        F.sum(F.when(F.col("service") != "A", money("cost_usd"))).cast("double").alias("tag_usd"),
        F.bool_or(F.col("settlement") == "settled").alias("tag_active"),
    )
    return actuals.tag_cross_check(totals).select("run_id", "authoritative_usd", "tag_usable", "tags_agree")


def _est_by_priority(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_custkey AS run_id", "o_orderpriority AS category", "o_totalprice AS cost_usd"
    )


def _act_by_priority(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_linestatus", "l_linenumber")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).selectExpr(
        "o_custkey + (l_linenumber % 2) * 5 AS run_id", "o_orderpriority AS category", "l_extendedprice AS cost_usd",
        "CASE WHEN l_linestatus = 'F' THEN 'settled' ELSE 'provisional' END AS settlement",
    )


_RECON = """WITH est AS (SELECT o_custkey AS run_id, o_orderpriority AS category, CAST(o_totalprice AS DECIMAL(38,12)) AS c FROM orders),
act AS (SELECT o_custkey + (l_linenumber % 2) * 5 AS run_id, o_orderpriority AS category, CAST(l_extendedprice AS DECIMAL(38,12)) AS c,
          l_linestatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
e AS (SELECT run_id, category, sum(c) AS s FROM est GROUP BY ALL), a AS (SELECT run_id, category, sum(c) AS s FROM act GROUP BY ALL),
cats AS (SELECT run_id, category, coalesce(e.s, 0) AS es, coalesce(a.s, 0) AS s, CAST(coalesce(a.s, 0) - coalesce(e.s, 0) AS DOUBLE) AS delta_usd,
                CAST(coalesce(e.s, 0) AS DOUBLE) AS estimate_usd, CAST(coalesce(a.s, 0) AS DOUBLE) AS actual_usd
         FROM e FULL JOIN a USING (run_id, category)),
tot AS (SELECT run_id, CAST(sum(es) AS DOUBLE) AS estimate_usd, CAST(sum(s) AS DOUBLE) AS actual_usd, CAST(sum(s) - sum(es) AS DOUBLE) AS delta_usd FROM cats GROUP BY 1),
drv AS (SELECT run_id, category AS driver, delta_usd AS driver_delta_usd, row_number() OVER (PARTITION BY run_id ORDER BY abs(delta_usd) DESC, category) AS rn FROM cats)
"""


def reconciled_categories(spark, sf):
    return actuals.reconcile_categories(_est_by_priority(spark, sf), _act_by_priority(spark, sf), ["run_id"])


def reconciled(spark, sf):
    out = actuals.reconcile(_est_by_priority(spark, sf), _act_by_priority(spark, sf), ["run_id"])
    return out.drop("verdict")


def _variance(spark, sf):
    lines = _est_by_priority(spark, sf)
    totals = lines.groupBy("run_id").agg(F.sum(money("cost_usd")).cast("double").alias("total_usd"))
    return actuals.variance_report(totals, lines, _act_by_priority(spark, sf))


def variance(spark, sf):
    return _variance(spark, sf).drop("verdict")


def flagged(spark, sf):
    return actuals.flag_variance(_variance(spark, sf), 60.0).select("run_id", "variance_pct", "driver", "problem")


_VARIANCE = f"""{_RECON}, st AS (SELECT run_id, CASE WHEN bool_and(l_linestatus = 'F') THEN 'settled' ELSE 'provisional' END AS settlement FROM act GROUP BY 1),
var AS (
SELECT run_id, estimate_usd, actual_usd, delta_usd, 100.0 * (actual_usd - estimate_usd) / estimate_usd AS variance_pct,
       actual_usd / estimate_usd AS accuracy_ratio, driver, driver_delta_usd, settlement
FROM tot JOIN drv USING (run_id) JOIN st USING (run_id) WHERE rn = 1 AND run_id IN (SELECT run_id FROM est))
"""


def unestimated(spark, sf):
    ests = view(spark, sf, "estimates").where(F.col("status") != "draft")
    return actuals.unestimated_runs(ests, view(spark, sf, "ledger"))


def overview(spark, sf):
    return actuals.cost_overview(view(spark, sf, "ledger"))


_OVERVIEW = f"""{with_views('ledger')}, rows_ AS (
  SELECT coalesce(nullif(category, ''), 'unknown') AS category, coalesce(nullif(service, ''), 'unknown') AS service, run_id,
         strftime(period, '%Y-%m-%d') AS period, settlement, CAST(cost_usd AS DECIMAL(38,12)) AS c FROM ledger WHERE row_kind = 'cost'),
run_ AS (SELECT run_id, CAST(sum(c) AS DOUBLE) AS cost_usd, count(*) AS n_rows, row_number() OVER (ORDER BY CAST(sum(c) AS DOUBLE) DESC, run_id) AS rn FROM rows_ WHERE run_id <> '' GROUP BY 1),
day_ AS (SELECT period, CAST(sum(c) AS DOUBLE) AS cost_usd, count(*) AS n_rows, row_number() OVER (ORDER BY period DESC) AS rn FROM rows_ GROUP BY 1),
runs AS (SELECT CASE WHEN rn <= 25 THEN run_id ELSE 'others' END, CAST(sum(CAST(cost_usd AS DECIMAL(38,12))) AS DOUBLE), CAST(sum(n_rows) AS BIGINT) FROM run_ GROUP BY 1),
days AS (SELECT CASE WHEN rn <= 30 THEN period ELSE 'others' END, CAST(sum(CAST(cost_usd AS DECIMAL(38,12))) AS DOUBLE), CAST(sum(n_rows) AS BIGINT) FROM day_ GROUP BY 1)
SELECT 'category' AS "grouping", category AS "key", CAST(sum(c) AS DOUBLE) AS cost_usd, count(*) AS n_rows FROM rows_ GROUP BY 2
UNION ALL SELECT 'service', service, CAST(sum(c) AS DOUBLE), count(*) FROM rows_ GROUP BY 2
UNION ALL SELECT 'settlement', settlement, CAST(sum(c) AS DOUBLE), count(*) FROM rows_ GROUP BY 2
UNION ALL SELECT 'run_id', * FROM runs UNION ALL SELECT 'period', * FROM days
"""


def _yearly(spark, sf):
    est = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS run_id", "o_orderpriority AS category", "o_totalprice AS cost_usd",
        "date_format(o_orderdate, 'yyyy-MM') AS period",
    )
    act = table(spark, sf, "lineitem").selectExpr("l_orderkey AS run_id", "l_extendedprice AS cost_usd")
    act = act.join(est.select("run_id", "category", "period"), "run_id")
    return actuals.reconcile(est, act, ["run_id", "period"])


def accuracy(spark, sf):
    return actuals.accuracy_trend(_yearly(spark, sf))


_ACCURACY = f"""WITH r AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, CAST(o_totalprice AS DECIMAL(38,12)) AS e, coalesce(s, 0) AS a
  FROM orders LEFT JOIN (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(38,12))) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
p AS (SELECT period, count(*) AS n_runs, CAST(sum(e) AS DOUBLE) AS estimate_usd, CAST(sum(a) AS DOUBLE) AS actual_usd FROM r GROUP BY 1)
SELECT *, actual_usd / estimate_usd AS accuracy_ratio,
       actual_usd / estimate_usd - lag(actual_usd / estimate_usd) OVER (ORDER BY period) AS accuracy_change FROM p
"""


def drivers(spark, sf):
    out = actuals.reconcile(_est_by_priority(spark, sf), _act_by_priority(spark, sf), ["run_id"])
    return actuals.drivers_of_misses(out)


def to_date(spark, sf):
    return actuals.spend_to_date(view(spark, sf, "ledger"))


def _sessions(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        "'session-' || c_custkey AS session_id", "'run-' || (c_custkey % 97) AS run_id"
    )


def run_tokens(spark, sf):
    spans = table(spark, sf, "orders").selectExpr(
        "'session-' || (o_custkey * 2) AS session_id", "o_orderpriority AS model",
        "CAST(o_orderkey % 1000 AS bigint) AS input_tokens", "CAST(o_custkey % 100 AS bigint) AS output_tokens",
    )
    return actuals.tokens_per_run(spans, _sessions(spark, sf))


_TOKENS = """WITH spans AS (SELECT 'session-' || (o_custkey * 2) AS session_id, o_orderpriority AS model, o_orderkey % 1000 AS i, o_custkey % 100 AS o FROM orders),
s AS (SELECT 'session-' || c_custkey AS session_id, 'run-' || (c_custkey % 97) AS run_id FROM customer)
SELECT coalesce(run_id, 'unattributed') AS run_id, model, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, count(*) AS n_spans
FROM spans LEFT JOIN s USING (session_id) GROUP BY 1, 2
"""


def idle_endpoints(spark, sf):
    ends = table(spark, sf, "customer").selectExpr(
        "c_custkey AS endpoint_name", "timestamp'2024-01-20 00:00:00' + make_interval(0, 0, 0, CAST(c_custkey % 20 AS int)) AS created",
        "c_mktsegment AS instance_type", "c_nationkey % 3 + 1 AS instance_count",
        "CASE c_nationkey % 3 WHEN 0 THEN 'acme' WHEN 1 THEN '' ELSE 'other' END AS project_tag",
    )
    calls = table(spark, sf, "events").selectExpr("user_id AS endpoint_name", "CAST(ts AS timestamp) AS ts", "1 AS value")
    price = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("instance_type")).agg(
        (F.floor(F.max("c_acctbal")) / 1000).alias("hourly_usd")
    ).where(F.col("instance_type") != "BUILDING")
    return actuals.idle_sweep(ends, calls, price, "acme", "2024-01-31 00:00:00", 24, 1.408)


_IDLE = """WITH used AS (SELECT user_id AS endpoint_name, count(*) AS n FROM events
    WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' AND ts < TIMESTAMP '2024-01-31 00:00:00' GROUP BY 1),
price AS (SELECT c_mktsegment AS it, floor(max(c_acctbal)) / 1000 AS h FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1)
SELECT c_custkey AS endpoint_name, CASE c_nationkey % 3 WHEN 0 THEN 'ours' WHEN 1 THEN 'untagged' ELSE 'other' END AS owner,
       coalesce(n, 0) AS invocations,
       coalesce(n, 0) = 0 AND TIMESTAMP '2024-01-20 00:00:00' + (c_custkey % 20) * INTERVAL 1 DAY <= TIMESTAMP '2024-01-30 00:00:00' AS idle,
       coalesce(h, 1.408) * 24 * (c_nationkey % 3 + 1) AS daily_usd, CASE WHEN h IS NULL THEN 'estimate' ELSE 'rate' END AS price_basis
FROM customer LEFT JOIN used ON endpoint_name = c_custkey LEFT JOIN price ON it = c_mktsegment
"""


def orphan_configs(spark, sf):
    configs = table(spark, sf, "orders").selectExpr("o_orderkey AS config", "o_custkey AS endpoint_name")
    live = table(spark, sf, "events").selectExpr("user_id AS endpoint_name")
    return actuals.orphans(configs, live)


QUERIES = {
    "e1_realized_rates": usage_rates,
    "e2_merge_rates": merged_card,
    "e3_rate_health": rate_health,
    "e3_missing_skus": required_skus,
    "a9_rate_as_of": asof_pricing,
    "e4_estimate_lines": estimate_lines,
    "e5_estimate_rollup": estimate_rollup,
    "e6_budget_decision": budget_decision,
    "e7_approval_audit": approval_audit,
    "e8_attribute_actuals": attributed,
    "e8_attributed_resources": attributed_by_resource,
    "e8_excluded_actuals": excluded,
    "e9_run_id_from_resource": resource_run_ids,
    "e10_settlement": settlement_by_run,
    "e11_periods_to_reconcile": open_periods,
    "e12_upsert_actuals": upserted_ledger,
    "e13_tag_cross_check": tag_check,
    "e14_reconcile_categories": reconciled_categories,
    "e14_reconcile": reconciled,
    "e15_variance_report": variance,
    "e15_unestimated_runs": unestimated,
    "e16_flag_variance": flagged,
    "e17_cost_overview": overview,
    "e18_accuracy_trend": accuracy,
    "e18_drivers_of_misses": drivers,
    "e19_tokens_per_run": run_tokens,
    "e20_idle_sweep": idle_endpoints,
    "e20_orphan_configs": orphan_configs,
    "e21_estimate_queue": estimate_queue,
    "e22_spend_to_date": to_date,
}

_TAG_TOTALS = f"""{with_views('ledger')}, t AS (SELECT run_id, {_sum('cost_usd')} AS res, coalesce(CAST(sum(CASE WHEN service <> 'A' THEN CAST(cost_usd AS DECIMAL(38,12)) END) AS DOUBLE), 0) AS tag,
  bool_or(settlement = 'settled') AS act FROM ledger GROUP BY 1)"""

SQL = {
    "e1_realized_rates": f"{with_views('billing')} {_REALIZED}",
    "e2_merge_rates": f"{with_views('billing')} {_MERGED}",
    "e3_rate_health": _HEALTH,
    "e3_missing_skus": f"""{_LINES} SELECT DISTINCT sku FROM raw WHERE category NOT IN ('support', 'agentcore_evaluations') AND sku NOT IN (SELECT sku FROM card)""",
    "a9_rate_as_of": _ASOF,
    "e4_estimate_lines": f"{_LINES} SELECT * FROM lines",
    "e5_estimate_rollup": _ROLLUP,
    "e6_budget_decision": _BUDGET,
    "e7_approval_audit": _APPROVAL,
    "e8_attribute_actuals": f"""{_TAGGED} SELECT project, strftime(period, '%Y-%m-%d') AS period, run_id, category, {_sum('cost_usd')} AS cost_usd, count(*) AS n_rows,
  bool_or(estimated) AS estimated, CASE WHEN bool_or(estimated) THEN 'provisional' ELSE 'settled' END AS settlement FROM tagged WHERE ours GROUP BY 1, 2, 3, 4""",
    "e8_attributed_resources": f"""{_TAGGED} SELECT project, strftime(period, '%Y-%m-%d') AS period, run_id, category, resource_id, {_sum('cost_usd')} AS cost_usd, count(*) AS n_rows FROM tagged WHERE ours GROUP BY 1, 2, 3, 4, 5""",
    "e8_excluded_actuals": f"""{_TAGGED} SELECT project, strftime(period, '%Y-%m-%d') AS period, resource_id, {_sum('cost_usd')} AS cost_usd, count(*) AS n_rows,
  'not in project allowlist' AS reason FROM tagged WHERE NOT ours GROUP BY 1, 2, 3""",
    "e9_run_id_from_resource": f"{_TAGGED} SELECT DISTINCT resource_id, nullif(run_id, 'unattributed') AS run_id FROM tagged",
    "e10_settlement": f"""{with_views('ledger')} SELECT run_id, count(*) AS n_rows, count(*) FILTER (settlement = 'settled') AS n_settled, {_sum('cost_usd')} AS cost_usd,
  CASE WHEN bool_and(settlement = 'settled') THEN 'settled' ELSE 'provisional' END AS settlement FROM ledger GROUP BY 1""",
    "e11_periods_to_reconcile": f"""{with_views('ledger')} SELECT DISTINCT period FROM (
  SELECT strftime(period, '%Y-%m-%d') AS period FROM ledger WHERE settlement = 'provisional' AND period >= DATE '{TODAY}' - 5
  UNION ALL SELECT strftime(DATE '{TODAY}' - 2, '%Y-%m-%d'))""",
    "e12_upsert_actuals": f"""{with_views('ledger')}, touched AS (SELECT DISTINCT project, period FROM ledger WHERE settlement = 'provisional'),
u AS (SELECT project, period, settlement, cost_usd FROM ledger ANTI JOIN touched USING (project, period)
  UNION ALL SELECT project, period, 'settled', cost_usd + 1.0 FROM ledger WHERE settlement = 'provisional')
SELECT project, strftime(period, '%Y-%m-%d') AS period, settlement, count(*) AS n_rows, {_sum('cost_usd')} AS cost_usd FROM u GROUP BY 1, 2, 3""",
    "e13_tag_cross_check": f"""{_TAG_TOTALS} SELECT run_id, res AS authoritative_usd, act AS tag_usable,
  CASE WHEN act THEN res = 0 OR abs(res - tag) / greatest(res, 1e-9) <= 0.05 END AS tags_agree FROM t""",
    "e14_reconcile_categories": f"""{_RECON} SELECT run_id, category, estimate_usd, actual_usd, delta_usd,
  CASE WHEN estimate_usd <> 0 THEN 100.0 * delta_usd / estimate_usd END AS variance_pct FROM cats""",
    "e14_reconcile": f"""{_RECON} SELECT run_id, estimate_usd, actual_usd, delta_usd, CASE WHEN estimate_usd <> 0 THEN 100.0 * (actual_usd - estimate_usd) / estimate_usd END AS variance_pct,
  CASE WHEN estimate_usd <> 0 THEN actual_usd / estimate_usd END AS accuracy_ratio, driver, driver_delta_usd, 'provisional' AS settlement
  FROM tot JOIN drv USING (run_id) WHERE rn = 1""",
    "e15_variance_report": f"{_VARIANCE} SELECT * FROM var",
    "e15_unestimated_runs": f"""{with_views('ledger', 'estimates')} SELECT run_id, {_sum('cost_usd')} AS cost_usd FROM ledger
  WHERE run_id <> '' AND run_id NOT IN (SELECT run_id FROM estimates WHERE status <> 'draft') GROUP BY 1""",
    "e16_flag_variance": f"{_VARIANCE} SELECT run_id, variance_pct, driver, CAST(NULL AS VARCHAR) AS problem FROM var WHERE abs(variance_pct) > 60",
    "e17_cost_overview": _OVERVIEW,
    "e18_accuracy_trend": _ACCURACY,
    "e18_drivers_of_misses": f"{_RECON} SELECT driver, count(*) AS n_runs, CAST(sum(CAST(abs(driver_delta_usd) AS DECIMAL(38,12))) AS DOUBLE) AS abs_delta_usd FROM drv WHERE rn = 1 GROUP BY 1",
    "e19_tokens_per_run": _TOKENS,
    "e20_idle_sweep": _IDLE,
    "e20_orphan_configs": "SELECT o_orderkey AS config, o_custkey AS endpoint_name FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)",
    "e21_estimate_queue": _QUEUE,
    "e22_spend_to_date": f"{with_views('ledger')} SELECT project, {_sum('cost_usd')} AS project_to_date_usd, count(*) AS n_rows FROM ledger WHERE row_kind = 'cost' GROUP BY 1",
}
