"""Stand-ins for the domain tables, projected from the given tables.

Each view is a base table plus column expressions written in SQL that both Spark and the
checking engine read the same way, so a query and its oracle start from identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.session import table

PROJECT = "acme"
PATTERNS = ("training-job/acme-", "endpoint/acme-", "runtime/harness_acme_")
PREFIXES = ("acme-qlora-", "acme-student-", "acme-")

VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    # lineitem rows as bill lines
    "billing": ("lineitem", {
        "project": "'acme'",
        "period": "CAST(l_shipdate AS DATE)",
        "resource_id": (
            "CASE l_linenumber % 5"
            " WHEN 0 THEN 'training-job/acme-qlora-run-' || l_orderkey || '-0001-r3'"
            " WHEN 1 THEN 'endpoint/acme-student-run-' || l_orderkey"
            " WHEN 2 THEN 'runtime/harness_acme_' || l_suppkey"
            " WHEN 3 THEN 'endpoint/other-' || l_partkey"
            " ELSE 'training-job/acme-run-' || l_orderkey || '-7' END"
        ),
        "service": "l_returnflag",
        "usage_type": "'part-' || l_partkey",
        "quantity": "l_quantity",
        "cost_usd": "l_extendedprice",
        "estimated": "l_linestatus = 'O'",
        "l_orderkey": "l_orderkey",
        "l_linenumber": "l_linenumber",
        "l_shipdate": "l_shipdate",
    }),
    # lineitem rows as ledger rows
    "ledger": ("lineitem", {
        "project": "'project-' || (l_suppkey % 10)",
        "period": "CAST(l_shipdate AS DATE)",
        "run_id": "CASE WHEN l_linenumber = 7 THEN '' ELSE 'run-' || (l_orderkey % 2000) END",
        "category": "CASE l_linenumber % 4 WHEN 0 THEN 'sagemaker_training'"
                    " WHEN 1 THEN 'sagemaker_inference' WHEN 2 THEN 'support' ELSE '' END",
        "service": "l_returnflag",
        "settlement": "CASE WHEN l_linestatus = 'F' THEN 'settled' ELSE 'provisional' END",
        "row_kind": "CASE WHEN l_partkey % 50 = 0 THEN 'audit' ELSE 'cost' END",
        "cost_usd": "l_extendedprice",
    }),
    # orders as plans to price
    "plans": ("orders", {
        "plan_id": "o_orderkey",
        "sample_count": "CAST(100 + o_custkey % 900 AS DOUBLE)",
        "max_iterations": "CAST(1 + o_orderkey % 3 AS INTEGER)",
        "keep_reasoning": "o_orderstatus = 'F'",
        "training_instance": "CASE WHEN o_orderpriority = '1-URGENT' THEN 'ml.p4' ELSE 'ml.g5.2xlarge' END",
        "endpoint_hours": "CAST(o_orderkey % 4 AS DOUBLE)",
        "teacher_model": "'teacher-' || (o_custkey % 5)",
        "harness_model": "'agent-' || (o_custkey % 3)",
        "evaluation_input_tokens": "CAST((o_custkey % 2) * 1000000 AS DOUBLE)",
        "kb_ocu_hours": "CAST(o_custkey % 3 AS DOUBLE)",
        "kb_embed_ingest_tokens": "CAST((o_orderkey % 2) * 50000000 AS DOUBLE)",
    }),
    # orders as estimates
    "estimates": ("orders", {
        "id": "o_orderkey",
        "project": "'project-' || (o_custkey % 10)",
        "run_id": "'run-' || (o_orderkey % 3000)",
        "created_at": "o_orderdate",
        "requested_by": "'user-' || (o_custkey % 7)",
        "approver": "'user-' || (o_orderkey % 7)",
        "status": "CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'pending_approval' ELSE 'draft' END",
        "decision": "CASE WHEN o_orderkey % 4 = 0 THEN 'reject' ELSE 'approve' END",
        "reason": "CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE 'because' END",
        "in_group": "o_custkey % 11 <> 0",
        "total_usd": "o_totalprice",
        "worst_case_usd": "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice * 2 END",
        "gate": "'{\"budget_mode\":\"advisory\",\"gating_usd\":' || o_orderkey || '}'",
    }),
}


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    base, columns = VIEWS[name]
    return table(spark, folder, base).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def view_sql(name: str) -> str:
    base, columns = VIEWS[name]
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + f" FROM {base}"


def with_views(*names: str) -> str:
    """A WITH clause head defining the named views, ready for more CTEs or the main SELECT."""
    return "WITH " + ", ".join(f"{n} AS ({view_sql(n)})" for n in names)
