"""Run cost estimates: line items, rollup, budget comparison, approval audit, queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.stats import count_where, money, money_sum
from tallyloom.operators.ordering import newest_overall, running_total

# Fixed calibration values: measured throughput, overhead and token counts.
ROWS_PER_SEC = 16_550 / 24_924
SETUP_OVERHEAD_S = 670.0
TEACHER_INPUT_TOKENS = 2_014.0
TEACHER_OUTPUT_TOKENS = 1_050.0
REASONING_MULTIPLIER = 12.5
MINUTES_PER_STAGE, RUNTIME_VCPU, RUNTIME_GB, N_STAGES = 6.0, 1.0, 2.0, 9
HARNESS_INPUT_TOKENS, HARNESS_OUTPUT_TOKENS = 40_000.0, 6_000.0
MEMORY_EVENTS_PER_STAGE = 20
SUPPORT_USD = 0.50
TRAINING_INSTANCE, INFERENCE_INSTANCE = "ml.g5.2xlarge", "ml.g5.xlarge"

# Fixed SKU names.
SKU_VCPU = "agentcore:runtime:vcpu-hours"
SKU_GB = "agentcore:runtime:gb-hours"
SKU_MEMORY = "agentcore:memory:short-term-events"
SKU_EVALS = "agentcore:evaluations:builtin-input-tokens"
SKU_SUPPORT = "support:s3-ddb-lambda-sfn"
SKU_OCU = "aoss:vector-collection:ocu-hours"
SKU_EMBED = "bedrock:amazon.titan-embed-text-v2:0:input-tokens"

# Fixed static prices, used only for a SKU the card does not price.
FALLBACK_PRICES = {SKU_OCU: 0.24, SKU_EMBED: 0.00002}

# Categories a remediation iteration repeats.
REMEDIABLE = ("sagemaker_training", "agentcore_runtime", "agentcore_model")

# Confidence a rate source supports, best first.
CONFIDENCE = ("measured", "modelled", "guessed")
SOURCE_CONFIDENCE = {"ce_realized": 0, "price_list": 1, "fallback_static": 2}

LIMIT_USD = 20_000.0
BUDGET_MODES = ("advisory", "blocking")
APPROVAL_FAILURES = {"group": 403, "self": 403, "status": 409, "reason": 400}

# Plan columns and their types; an absent column reads as null and takes its default.
PLAN_FIELDS = {
    "sample_count": "double", "train_rows": "double", "rows_per_sec": "double",
    "setup_overhead_s": "double", "training_instance": "string", "inference_instance": "string",
    "endpoint_hours": "double", "teacher_model": "string", "harness_model": "string",
    "teacher_input_tokens_per_sample": "double", "teacher_output_tokens_per_sample": "double",
    "keep_reasoning": "boolean", "reasoning_multiplier": "double", "n_stages": "int",
    "minutes_per_stage": "double", "runtime_vcpu": "double", "runtime_gb": "double",
    "harness_input_tokens_per_stage": "double", "harness_output_tokens_per_stage": "double",
    "memory_events": "double", "evaluation_input_tokens": "double", "kb_ocu_hours": "double",
    "kb_embed_ingest_tokens": "double", "support_usd": "double", "max_iterations": "int",
}


def _plan(plans: DataFrame) -> DataFrame:
    have = set(plans.columns)
    return plans.select(
        "plan_id",
        *[
            (F.col(c) if c in have else F.lit(None)).cast(t).alias(c)
            for c, t in PLAN_FIELDS.items()
        ],
    )


def plan_lines(plans: DataFrame) -> DataFrame:
    """Explode plans into unpriced lines: plan_id, category, sku, quantity, unit, remediable."""
    p = _plan(plans)

    def val(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default))

    def nonzero(name: str, default: Column) -> Column:
        return F.when(F.coalesce(F.col(name), F.lit(0)) != 0, F.col(name)).otherwise(default)

    samples = val("sample_count", 0.0)
    rows = nonzero("train_rows", samples)
    train_hours = (
        rows / nonzero("rows_per_sec", F.lit(ROWS_PER_SEC)) + val("setup_overhead_s", SETUP_OVERHEAD_S)
    ) / 3600.0
    endpoint_hours = val("endpoint_hours", 1.0)
    per_sample_out = val("teacher_output_tokens_per_sample", TEACHER_OUTPUT_TOKENS) * F.when(
        val("keep_reasoning", True), val("reasoning_multiplier", REASONING_MULTIPLIER)
    ).otherwise(1.0)
    stages = val("n_stages", N_STAGES)
    hours = stages * val("minutes_per_stage", MINUTES_PER_STAGE) / 60.0
    eval_tokens = val("evaluation_input_tokens", 0.0)
    ocu, embed = val("kb_ocu_hours", 0.0), val("kb_embed_ingest_tokens", 0.0)
    support = val("support_usd", SUPPORT_USD)

    def tokens(model: str, direction: str) -> Column:
        return F.concat(F.lit("bedrock:"), F.col(model), F.lit(f":{direction}-tokens"))

    def line(category, sku, quantity, unit, present, price=None) -> Column:
        return F.struct(
            F.lit(category).alias("category"),
            (F.lit(sku) if isinstance(sku, str) else sku).alias("sku"),
            quantity.cast("double").alias("quantity"),
            F.lit(unit).alias("unit"),
            F.lit(category in REMEDIABLE).alias("remediable"),
            present.alias("present"),
            (F.lit(None) if price is None else price).cast("double").alias("flat_price"),
        )

    lines = F.array(
        line("sagemaker_training",
             F.concat(F.lit("sagemaker:training:"), val("training_instance", TRAINING_INSTANCE)),
             train_hours, "hours", rows != 0),
        line("sagemaker_inference",
             F.concat(F.lit("sagemaker:inference:"), val("inference_instance", INFERENCE_INSTANCE)),
             endpoint_hours, "hours", endpoint_hours != 0),
        line("bedrock_teacher", tokens("teacher_model", "input"),
             samples * val("teacher_input_tokens_per_sample", TEACHER_INPUT_TOKENS) / 1000.0,
             "1K tokens", samples != 0),
        line("bedrock_teacher", tokens("teacher_model", "output"),
             samples * per_sample_out / 1000.0, "1K tokens", samples != 0),
        line("agentcore_runtime", SKU_VCPU, hours * val("runtime_vcpu", RUNTIME_VCPU),
             "vCPU-hours", stages != 0),
        line("agentcore_runtime", SKU_GB, hours * val("runtime_gb", RUNTIME_GB),
             "GB-hours", stages != 0),
        line("agentcore_model", tokens("harness_model", "input"),
             stages * val("harness_input_tokens_per_stage", HARNESS_INPUT_TOKENS) / 1000.0,
             "1K tokens", stages != 0),
        line("agentcore_model", tokens("harness_model", "output"),
             stages * val("harness_output_tokens_per_stage", HARNESS_OUTPUT_TOKENS) / 1000.0,
             "1K tokens", stages != 0),
        line("agentcore_memory", SKU_MEMORY,
             F.coalesce(F.col("memory_events"), stages * MEMORY_EVENTS_PER_STAGE),
             "events", stages != 0),
        line("agentcore_evaluations", SKU_EVALS, eval_tokens / 1_000_000.0, "1M tokens",
             (stages != 0) & (eval_tokens != 0)),
        line("retrieval_index", SKU_OCU, ocu, "OCU-hours", ocu != 0),
        line("retrieval_index", SKU_EMBED, embed / 1000.0, "1K tokens", embed != 0),
        line("support", SKU_SUPPORT, F.lit(1.0), "run", support != 0, support),
    )
    return (
        p.select("plan_id", F.inline(F.filter(lines, lambda x: x["present"]))).drop("present")
    )


def estimate_lines(plans: DataFrame, rates: DataFrame) -> DataFrame:
    """Priced lines; a SKU without a rate keeps its line with a null cost."""
    lines = plan_lines(plans)
    card = rates.select(
        "sku",
        F.col("unit_price").alias("_price"),
        F.col("source").alias("_source"),
        F.col("as_of").alias("rate_as_of"),
    )
    fallback = F.lit(None).cast("double")
    for sku, price in FALLBACK_PRICES.items():
        fallback = F.when(F.col("sku") == sku, price).otherwise(fallback)
    flat = F.coalesce(F.col("flat_price"), F.when(F.col("_price").isNull(), fallback))
    return (
        lines.join(card, "sku", "left")
        .withColumn("unit_price", F.coalesce(flat, F.col("_price")))
        .withColumn(
            "rate_source",
            F.when(flat.isNotNull(), F.lit("fallback_static")).otherwise(F.col("_source")),
        )
        .withColumn("rate_as_of", F.when(flat.isNull(), F.col("rate_as_of")))
        .withColumn("cost_usd", F.round(F.col("quantity") * F.col("unit_price"), 6))
        .select("plan_id", "category", "sku", "quantity", "unit", "remediable", "unit_price",
                "cost_usd", "rate_source", "rate_as_of")
    )


def subtotals(lines: DataFrame) -> DataFrame:
    return (
        lines.where(F.col("cost_usd").isNotNull())
        .groupBy("plan_id", "category")
        .agg(money_sum("cost_usd").alias("cost_usd"))
    )


def estimate_rollup(lines: DataFrame, plans: DataFrame) -> DataFrame:
    """Total, worst case, weakest confidence and the unpriced SKUs of each plan."""
    rank = F.lit(2)
    for source, r in SOURCE_CONFIDENCE.items():
        rank = F.when(F.col("rate_source") == source, r).otherwise(rank)
    unpriced = F.col("cost_usd").isNull()
    totals = lines.groupBy("plan_id").agg(
        F.coalesce(money_sum("cost_usd"), F.lit(0.0)).alias("total_usd"),
        F.coalesce(F.sum(F.when(F.col("remediable"), money("cost_usd"))).cast("double"), F.lit(0.0))
        .alias("remediable_usd"),
        F.max(rank).alias("_rank"),
        F.sort_array(F.collect_set(F.when(unpriced, F.col("sku")))).alias("unpriced"),
        count_where(unpriced).alias("n_unpriced_lines"),
    )
    iterations = _plan(plans).select(
        "plan_id", F.greatest(F.lit(1), F.coalesce("max_iterations", F.lit(1))).alias("max_iterations")
    )
    levels = F.array(*[F.lit(c) for c in CONFIDENCE])
    return totals.join(iterations, "plan_id").select(
        "plan_id",
        "total_usd",
        (F.col("total_usd") + (F.col("max_iterations") - 1) * F.col("remediable_usd")).alias(
            "worst_case_usd"
        ),
        "max_iterations",
        "remediable_usd",
        F.when(F.col("n_unpriced_lines") > 0, "guessed")
        .otherwise(F.element_at(levels, F.col("_rank") + 1))
        .alias("confidence"),
        "unpriced",
        (F.col("n_unpriced_lines") > 0).alias("total_is_floor"),
    )


def budget_decision(
    estimates: DataFrame,
    single_limit: float = LIMIT_USD,
    cumulative_limit: float = LIMIT_USD,
    mode: str = "advisory",
) -> DataFrame:
    """Compare each estimate with both budget references on its worst case.

    Needs worst_case_usd (null falls back to total_usd) and project_to_date_usd. An unknown
    mode acts as advisory: overage is reported, the run is not held.
    """
    mode = mode if mode in BUDGET_MODES else "advisory"
    gating = F.coalesce(F.col("worst_case_usd"), F.col("total_usd"), F.lit(0.0))
    to_date = F.coalesce(F.col("project_to_date_usd"), F.lit(0.0))
    over_single = gating > single_limit
    over_total = to_date + gating > cumulative_limit
    over = over_single | over_total
    blocking = over & F.lit(mode == "blocking")
    return estimates.withColumns(
        {
            "gating_usd": gating,
            "over_single": over_single,
            "over_cumulative": over_total,
            "over_budget_usd": F.greatest(F.lit(0.0), gating - single_limit),
            "budget_mode": F.lit(mode),
            "approval_required": blocking,
            "budget_status": F.when(blocking, "pending_approval").otherwise("approved"),
        }
    )


def with_running_spend(
    estimates: DataFrame, key: str, order: list[str], chunk: Column, cost: str = "worst_case_usd"
) -> DataFrame:
    """project_to_date_usd = spend of the key's earlier estimates, in `order`."""
    running = running_total(estimates, [key], order, {"_run": money(cost)}, chunk)
    return running.withColumn(
        "project_to_date_usd", (F.col("_run") - money(cost)).cast("double")
    ).drop("_run")


def approval_audit(records: DataFrame, group: str) -> DataFrame:
    """Check approve/reject decisions; adds code, failure and may_launch.

    Needs requested_by, approver, approver_groups, status, decision, reason.
    """
    failure = (
        F.when(~F.coalesce(F.array_contains("approver_groups", group), F.lit(False)), "group")
        .when((F.col("requested_by") != "") & (F.col("requested_by") == F.col("approver")), "self")
        .when(~F.col("status").eqNullSafe("pending_approval"), "status")
        .when((F.col("decision") == "reject") & (F.coalesce("reason", F.lit("")) == ""), "reason")
    )
    code = F.lit(200)
    for name, value in APPROVAL_FAILURES.items():
        code = F.when(F.col("failure") == name, value).otherwise(code)
    return (
        records.withColumn("failure", failure)
        .withColumn("code", code)
        .withColumn("may_launch", F.col("status").eqNullSafe("approved"))
    )


def estimate_queue(estimates: DataFrame, limit: int, gate_schema: str) -> DataFrame:
    """Newest estimates with their gate JSON parsed; ordered before it is cut."""
    order = [F.col("created_at").desc(), F.col("id").desc()]
    return (
        newest_overall(estimates, order, limit)
        .withColumn("gate", F.from_json("gate", gate_schema))
        .withColumn("pending", F.col("status") == "pending_approval")
    )


def status_funnel(estimates: DataFrame) -> DataFrame:
    return estimates.groupBy("status").agg(F.count("*").alias("n"))
