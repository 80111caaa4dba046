"""Run manifests and stage claims: normalisation, reports, validation, tamper checks, story."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.stats import count_where, money_sum
from tallyloom.operators.ordering import previous_row, range_chunks, running_total

# Fixed alias lists, in priority order.
OUTPUT_KEYS = ("outputs", "artifacts", "output", "artifact_uris", "s3_uris")
METRIC_KEYS = ("metrics", "results", "measurements", "stats")
EVIDENCE_KEYS = ("evidence", "summary", "proof", "notes")

# Fixed status vocabulary.
DONE = ("completed", "complete", "passed", "succeeded")
FAILED = ("failed", "error")
IN_FLIGHT = ("launched", "running", "in_progress")
ESCALATED = "escalated"

TRIGGERS = ("direct", "api", "webhook", "schedule", "conductor")
SCHEMA_STATUSES = ("pending", "running", "completed", "failed", "escalated", "skipped")
REQUIRED = ("run_id", "created_at", "trigger_source", "iteration", "stages", "models")
SIGNED_BLOCKS = ("models", "plan", "approval", "params", "run_id", "created_at", "trigger_source")
NO_DETAIL = "no detail recorded"
SEE_EVENTS = "see SNS notification / DDB stage events"


def _first_present(claim: Column, keys: Sequence[str], parsed: Column) -> Column:
    """The value under the first alias that is present at all, even if it is empty."""
    names = F.json_object_keys(claim)
    chosen = F.lit(None).cast("variant")
    for key in reversed(keys):
        chosen = F.when(
            F.array_contains(names, key), F.try_variant_get(parsed, f"$.{key}", "variant")
        ).otherwise(chosen)
    return chosen


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), r"^(\w+)", 1)


def normalize_claims(claims: DataFrame, column: str) -> DataFrame:
    """Add outputs array<string>, metrics map<string,string> and evidence string.

    `column` holds one JSON object per row, in which keys drift. Strings that carry JSON are
    unwrapped; anything else is wrapped rather than dropped.
    """
    claim = F.col(column)
    parsed = F.try_parse_json(claim)
    staged = claims.withColumns(
        {
            "_o": _first_present(claim, OUTPUT_KEYS, parsed),
            "_m": _first_present(claim, METRIC_KEYS, parsed),
            "_e": _first_present(claim, EVIDENCE_KEYS, parsed),
        }
    )
    text = lambda v: F.try_variant_get(v, "$", "string")
    staged = staged.withColumns(
        {
            "_ok": _kind(F.col("_o")), "_mk": _kind(F.col("_m")), "_ek": _kind(F.col("_e")),
            "_op": F.when(_kind(F.col("_o")) == "STRING", F.try_parse_json(text(F.col("_o")))),
            "_mp": F.when(_kind(F.col("_m")) == "STRING", F.try_parse_json(text(F.col("_m")))),
        }
    )
    items = lambda v: F.try_variant_get(v, "$", "array<string>")
    nothing = F.array().cast("array<string>")
    outputs = (
        F.when(F.col("_o").isNull() | (F.col("_ok") == "VOID"), nothing)
        .when(F.col("_ok") == "ARRAY", items(F.col("_o")))
        .when(
            F.col("_ok") == "STRING",
            F.when(_kind(F.col("_op")) == "ARRAY", items(F.col("_op")))
            .when(_kind(F.col("_op")) == "STRING", F.array(text(F.col("_op"))))
            .otherwise(F.array(text(F.col("_o")))),
        )
        .otherwise(F.array(text(F.col("_o"))))
    )
    as_map = lambda v: F.try_variant_get(v, "$", "map<string,string>")
    wrapped = lambda v: F.create_map(F.lit("value"), v)
    metrics = (
        F.when(F.col("_m").isNull() | (F.col("_mk") == "VOID"), F.expr("map()").cast("map<string,string>"))
        .when(F.col("_mk") == "OBJECT", as_map(F.col("_m")))
        .when(
            F.col("_mk") == "STRING",
            F.when(_kind(F.col("_mp")) == "OBJECT", as_map(F.col("_mp")))
            .when(F.col("_mp").isNotNull(), wrapped(text(F.col("_mp"))))
            .otherwise(wrapped(text(F.col("_m")))),
        )
        .otherwise(wrapped(text(F.col("_m"))))
    )
    evidence = F.when(F.col("_e").isNull() | (F.col("_ek") == "VOID"), "").otherwise(text(F.col("_e")))
    return staged.select(
        *claims.columns,
        F.filter(outputs, lambda x: x.isNotNull()).alias("outputs"),
        metrics.alias("metrics"),
        evidence.alias("evidence"),
    )


def stage_rows(manifests: DataFrame, *keep: str) -> DataFrame:
    """One row per (run, stage) of a manifest whose `stages` maps name to a struct."""
    return manifests.select("run_id", *keep, F.explode("stages").alias("stage", "entry")).select(
        "run_id", *keep, "stage", "entry.*"
    )


def stage_class(status: Column) -> Column:
    return (
        F.when(status.isin(*DONE), "passed")
        .when(status.isin(*IN_FLIGHT), "in_flight")
        .when(status.isin(*FAILED) | (status == ESCALATED), "failed")
        .otherwise("unrecognized")
    )


def run_counts(stages: DataFrame) -> DataFrame:
    """Stage counts per run; the four classes always add up to the total."""
    classed = stages.withColumn("_c", stage_class(F.coalesce("status", F.lit("unknown"))))
    return classed.groupBy("run_id").agg(
        F.count("*").alias("total"),
        *[count_where(F.col("_c") == c).alias(c) for c in ("passed", "failed", "in_flight", "unrecognized")],
    )


def run_findings(stages: DataFrame, escalations: DataFrame, attestations: DataFrame) -> DataFrame:
    """Findings from failed and escalated stages, escalation records and unverified instruments.

    `escalations`: run_id, stage, reason; `attestations`: run_id, stage, kind, key,
    claimed_sha256, canonical_sha256, verified, error. One finding per distinct claim.
    """
    given = lambda *cols: F.coalesce(*[F.when(F.col(c) != "", F.col(c)) for c in cols])
    broken = stages.where(F.col("status").isin(*FAILED)).select(
        "run_id", "stage", F.lit("high").alias("severity"),
        F.concat(F.lit("Stage "), "stage", F.lit(" failed")).alias("title"),
        F.coalesce(given("evidence", "error"), F.lit(NO_DETAIL)).alias("detail"),
    )
    asked_title = F.concat(F.lit("Stage "), F.col("stage"), F.lit(" escalated to human"))
    asked = stages.where(F.col("status") == ESCALATED).select(
        "run_id", "stage", F.lit("critical").alias("severity"), asked_title.alias("title"),
        F.coalesce(given("evidence"), F.lit(SEE_EVENTS)).alias("detail"),
    )
    recorded = escalations.withColumn("stage", F.coalesce("stage", F.lit("unknown"))).select(
        "run_id", "stage", F.lit("critical").alias("severity"), asked_title.alias("title"),
        F.coalesce(given("reason"), F.lit(SEE_EVENTS)).alias("detail"),
    )
    return broken.unionByName(asked).unionByName(recorded).unionByName(
        attestation_findings(attestations)
    )


def attest(claims: DataFrame, instruments: DataFrame) -> DataFrame:
    """Compare claimed digests with the canonical bytes: verified, mismatch, absent, unreadable.

    `claims`: run_id, stage, kind, key, claimed_sha256; `instruments`: key, content (binary or text).
    """
    canon = instruments.select("key", F.sha2(F.col("content").cast("binary"), 256).alias("canonical_sha256"))
    claimed = F.coalesce("claimed_sha256", F.lit(""))
    state = (
        F.when(F.col("canonical_sha256").isNull(), "unreadable")
        .when(claimed == "", "absent")
        .when(claimed == F.col("canonical_sha256"), "verified")
        .otherwise("mismatch")
    )
    return claims.join(canon, "key", "left").withColumns(
        {
            "claimed_sha256": claimed,
            "state": state,
            "verified": state == "verified",
            "error": F.when(F.col("canonical_sha256").isNull(), "unreadable"),
        }
    )


def attestation_findings(attestations: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    open_claims = attestations.where(~F.coalesce("verified", F.lit(False)))
    distinct = open_claims.groupBy("run_id", "kind", "claimed_sha256", "canonical_sha256").agg(
        F.min(F.struct("stage", "key", "error")).alias("a")
    ).select("run_id", "claimed_sha256", "canonical_sha256", "a.*")
    unreadable, unnamed = ~blank("error"), blank("claimed_sha256")
    return distinct.select(
        "run_id",
        F.coalesce("stage", F.lit("unknown")).alias("stage"),
        F.when(unreadable | unnamed, "medium").otherwise("high").alias("severity"),
        F.when(unreadable, "Judge instrument could not be verified")
        .when(unnamed, "Judge score does not name its instrument")
        .otherwise("Judge score was produced by a non-canonical instrument")
        .alias("title"),
        F.concat_ws(" ", F.col("key"), F.lit("claimed"), F.coalesce("claimed_sha256", F.lit("none")),
                    F.lit("canonical"), F.coalesce("canonical_sha256", F.lit("none"))).alias("detail"),
    )


def violations(checks: dict[str, Column]) -> Column:
    """Sorted names of the checks a row fails."""
    named = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    return F.sort_array(F.filter(named, lambda x: x.isNotNull()))


def validate_manifests(manifests: DataFrame, run_patterns: Sequence[str], statuses: Sequence[str] = SCHEMA_STATUSES) -> DataFrame:
    """Report every schema violation of a manifest; nothing is dropped.

    `run_patterns` are the accepted run-id forms (the schema's and the writers' disagree).
    """
    cols = manifests.columns
    checks: dict[str, Column] = {
        f"missing:{c}": (F.col(c).isNotNull() if c in cols else F.lit(False)) for c in REQUIRED
    }
    fits = F.lit(False)
    for pattern in run_patterns:
        fits = fits | F.rlike(F.col("run_id"), F.lit(pattern))
    checks["run_id:pattern"] = F.col("run_id").isNull() | fits
    checks["trigger_source:enum"] = F.col("trigger_source").isNull() | F.col("trigger_source").isin(*TRIGGERS)
    checks["iteration:minimum"] = F.col("iteration").isNull() | (F.col("iteration") >= 0)
    states = F.transform(F.map_values("stages"), lambda s: s["status"])
    checks["stage:status missing"] = F.col("stages").isNull() | ~F.exists(states, lambda s: s.isNull())
    checks["stage:status enum"] = F.col("stages").isNull() | F.forall(
        states, lambda s: s.isNull() | s.isin(*statuses)
    )
    return manifests.withColumn("violations", violations(checks))


def immutable_field_tamper(versions: DataFrame, chunk: Column, blocks: Sequence[str] = SIGNED_BLOCKS) -> DataFrame:
    """Signed blocks that differ from the version before, listed sorted.

    `versions`: doc (the run document's key), version, and the blocks as text.
    """
    before = previous_row(versions, ["doc"], ["version"], chunk, {f"_p_{b}": b for b in blocks})
    changed = violations(
        {
            b: F.col(f"_p_{b}").isNull() | F.col(b).isNull() | (F.col(f"_p_{b}") == F.col(b))
            for b in blocks
        }
    )
    return before.withColumn("tampered", changed).where(F.size("tampered") > 0).select(
        "doc", "version", "tampered"
    )


def stage_history(events: DataFrame) -> DataFrame:
    """Every recorded iteration of every stage with its position, oldest first (append-only)."""
    run = {"_run": F.coalesce(F.col("run_id").cast("string"), F.lit("")), "_no_run": F.col("run_id").isNull()}
    ranged = range_chunks(events.withColumns(run), [*run, "ts", "event_id"], "_range")
    counted = running_total(ranged, [*run], ["ts", "event_id"], {"position": F.lit(1)}, "_range")
    return counted.drop("_range", *run)


def escalation_records(events: DataFrame) -> DataFrame:
    """Each call for a person as a finding: run, position in the run, iteration, stage, reason.

    `events`: run_id, ts, event_id, stage, iteration, reason. Stage and reason are filled in where
    they were not said, so a record is never lost for lack of them.
    """
    said = lambda c, default: F.coalesce(F.when(F.trim(c) != "", F.col(c)), F.lit(default))
    return stage_history(events).select(
        "run_id", "position", "iteration", said("stage", "unknown").alias("stage"),
        said("reason", "no reason recorded").alias("reason"), F.lit("critical").alias("severity"))


def stage_map(events: DataFrame) -> DataFrame:
    """The last record per (run, stage): what the manifest's stage map holds."""
    rest = [c for c in events.columns if c not in ("run_id", "stage")]
    last = events.groupBy("run_id", "stage").agg(
        F.max_by(F.struct(*rest), F.struct("ts", "event_id")).alias("r"),
        F.count("*").alias("n_records"),
    )
    return last.select("run_id", "stage", "n_records", "r.*")


def latest_report(reports: DataFrame) -> DataFrame:
    """The alias row: the newest report overall."""
    rest = F.struct(*reports.columns)
    return reports.agg(F.max_by(rest, F.struct("generated_at", "run_id")).alias("r")).select("r.*")


def run_story(stages: DataFrame, ledger: DataFrame, findings: DataFrame) -> DataFrame:
    """Stage time line with durations beside the run's cost and open findings."""
    spent = ledger.groupBy("run_id").agg(money_sum("cost_usd").alias("cost_usd"))
    open_count = findings.groupBy("run_id").agg(F.count("*").alias("open_findings"))
    seconds = F.unix_timestamp("ended_at") - F.unix_timestamp("started_at")
    return (
        stages.withColumn("duration_s", seconds)
        .join(spent, "run_id", "left")
        .join(open_count, "run_id", "left")
        .withColumn("open_findings", F.coalesce("open_findings", F.lit(0)))
    )
