"""Audits: vocabularies, hash chains, table drift, secret scan, claims against inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.stats import count_where
from tallyloom.operators.ordering import previous_row

# Fixed event vocabulary and the routing class of each type.
ROUTED_EVENTS = ("EscalatedToHuman",)
RECORDED_EVENTS = (
    "PipelineStarted", "DatasetGenerated", "DatasetCurated", "TrainingStarted", "ModelTrained",
    "ModelEvaluated", "QualityGatePassed", "QualityGateFailed", "ModelRegistered", "ModelDeployed",
    "SmokeTestPassed", "EndpointDeleted", "DriftDetected", "ModelFailedOver", "OwnerPaged",
    "CapacityStopped", "DriverResurrected", "PipelineCompleted", "PipelineFailed",
)

# Fixed scan rules (name, pattern, text files only, capture group reported).
SECRET_RULES = (
    ("AWS access key id", r"AKIA[0-9A-Z]{16}", False, 0),
    ("AWS temporary access key id", r"ASIA[0-9A-Z]{16}", False, 0),
    ("AWS secret key assignment", r"aws_secret_access_key", False, 0),
    ("account-bearing ARN", r"arn:aws[a-z-]*:[a-z0-9-]+:[a-z0-9-]*:[0-9]{12}", False, 0),
    ("live API Gateway hostname", r"[a-z0-9<>_-]{4,}\.execute-api\.[a-z0-9-]+\.amazonaws\.com", False, 0),
    ("bare 12-digit account id", r"(?:^|[^0-9.])([0-9]{12})(?:[^0-9.]|$)", True, 1),
)
EXAMPLE_HOSTS = ("abc123", "<api_id>", "exampleapi1", "apiid")
PLACEHOLDERS = ("<ACCOUNT_ID>", "ACCOUNT_ID_PLACEHOLDER")
LONG_NUMBER = r"[0-9]{13,}"
SNIPPET = 80

GENESIS = "genesis"
SIGNED_KEYS = (
    "approved_at", "approved_by", "cognito_sub", "cost_estimate_usd", "decision", "gate",
    "plan_sha256", "plan_uri", "prev_event_sha256", "source_ip", "task_id",
)


def unknown_types(events: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Event types outside the closed vocabulary, with how often each occurs."""
    return (
        events.groupBy("detail_type").agg(F.count("*").alias("n"))
        .join(vocabulary.select("detail_type").distinct(), "detail_type", "left_anti")
    )


def misrouted_types(vocabulary: DataFrame) -> DataFrame:
    """Vocabulary types that do not belong to exactly one routing class (detail_type, route)."""
    return (
        vocabulary.groupBy("detail_type")
        .agg(F.countDistinct("route").alias("n_routes"))
        .where(F.col("n_routes") != 1)
    )


def canonical_record(keys: Sequence[str]) -> Column:
    """Compact JSON of the signed subset, keys sorted, absent ones left out."""
    return F.to_json(F.struct(*[F.col(k) for k in sorted(keys)]))


def hash_chain_audit(
    records: DataFrame,
    order: Sequence[str],
    chunk: Column,
    signed: Sequence[str] = SIGNED_KEYS,
    chain: Sequence[str] = (),
) -> DataFrame:
    """Re-derive each record's hash and check its link to the one before.

    Needs record_sha256 and prev_event_sha256; `chain` names the columns that separate chains.
    """
    derived = records.withColumn("derived_sha256", F.sha2(canonical_record(signed), 256))
    keys = list(chain) or ["_chain"]
    if not chain:
        derived = derived.withColumn("_chain", F.lit(0))
    linked = previous_row(derived, keys, order, chunk, {"_before": "derived_sha256"})
    want = F.coalesce("_before", F.lit(GENESIS))
    out = linked.withColumns(
        {
            "hash_ok": F.col("record_sha256").eqNullSafe(F.col("derived_sha256")),
            "link_ok": F.col("prev_event_sha256").eqNullSafe(want),
        }
    ).drop("_before")
    return out if chain else out.drop("_chain")


def first_break(audited: DataFrame, order: Sequence[str], chain: Sequence[str] = ()) -> DataFrame:
    """The earliest record whose hash or link fails, per chain; no row when all is well."""
    bad = audited.where(~F.col("hash_ok") | ~F.col("link_ok"))
    rest = F.struct(*audited.columns)
    grouped = bad.groupBy(*chain) if chain else bad.groupBy(F.lit(0).alias("_all"))
    return grouped.agg(F.min_by(rest, F.struct(*order)).alias("r")).select("r.*")


def table_drift(
    want: DataFrame, got: DataFrame, keys: Sequence[str], containment: bool = False
) -> DataFrame:
    """Rows absent live, extra live, or differing, with the names of the differing columns.

    With `containment`, extra live rows and columns the wanted row leaves null are accepted.
    """
    fields = [c for c in want.columns if c not in keys]
    w = want.select(*keys, F.lit(True).alias("_w"), *[F.col(c).alias(f"_w_{c}") for c in fields])
    g = got.select(*keys, F.lit(True).alias("_g"), *[F.col(c).alias(f"_g_{c}") for c in fields])
    joined = w.join(g, list(keys), "full_outer")

    def differs(c: str) -> Column:
        off = ~F.col(f"_w_{c}").eqNullSafe(F.col(f"_g_{c}"))
        return off & F.col(f"_w_{c}").isNotNull() if containment else off

    names = F.sort_array(
        F.filter(F.array(*[F.when(differs(c), F.lit(c)) for c in fields]), lambda x: x.isNotNull())
    )
    problem = (
        F.when(F.col("_g").isNull(), "absent live")
        .when(F.col("_w").isNull(), F.lit(None) if containment else "extra live")
        .when(F.size("fields") > 0, "differs")
    )
    return (
        joined.withColumn("fields", names)
        .withColumn("problem", problem)
        .where(F.col("problem").isNotNull())
        .select(*keys, "problem",
                F.when(F.col("problem") == "differs", F.col("fields")).alias("fields"))
    )


def drift_summary(drift: DataFrame, n_want: DataFrame, unreadable: bool = False) -> DataFrame:
    """One row: clean, drift or unknown (an unreadable side is unknown, never drift)."""
    counts = drift.agg(
        count_where(F.col("problem") == "absent live").alias("n_absent"),
        count_where(F.col("problem") == "extra live").alias("n_extra"),
        count_where(F.col("problem") == "differs").alias("n_differs"),
    )
    any_drift = (F.col("n_absent") + F.col("n_extra") + F.col("n_differs")) > 0
    status = F.lit("unknown") if unreadable else F.when(any_drift, "drift").otherwise("clean")
    return counts.withColumn("status", status)


def _labelled(rule: str):
    return lambda x: F.struct(
        F.lit(rule).alias("rule"), x["whole"].alias("whole"), x["shown"].alias("shown")
    )


def secret_scan(
    docs: DataFrame,
    path: str,
    content: str,
    rules: Sequence[tuple] = SECRET_RULES,
    allowed: Sequence[str] = (),
    known_digests: Sequence[str] = (),
) -> DataFrame:
    """Findings (path, line_no, rule, snippet) over whole texts, line by line.

    Known account ids are given as sha256 digests. That keeps them out of plain sight only: twelve
    digits can be searched, so treat the list as confidential. Documents that no rule touches are
    dropped before their lines are split. A text with a NUL anywhere counts as binary.
    """
    known = "account id on the known list"
    suspicious = "|".join(f"(?:{pattern})" for _, pattern, _, _ in rules) + "|[0-9]{12}"
    binary = F.contains(F.col(content), F.lit("\0"))
    lines = (
        docs.where(F.rlike(F.col(content), F.lit(suspicious)))
        .select(F.col(path).alias("path"), binary.alias("_bin"),
                F.posexplode(F.split(F.col(content), "\n")).alias("_pos", "_line"))
        .where(F.rlike("_line", F.lit(suspicious)))
    )
    hits = []
    for name, pattern, text_only, group in rules:
        whole = F.regexp_extract_all("_line", F.lit(pattern), F.lit(0))
        shown = F.regexp_extract_all("_line", F.lit(pattern), F.lit(group))
        found = F.arrays_zip(whole.alias("whole"), shown.alias("shown"))
        tagged = F.transform(found, _labelled(name))
        nothing = F.expr("array()").cast("array<struct<rule:string,whole:string,shown:string>>")
        hits.append(F.when(F.col("_bin"), nothing).otherwise(tagged) if text_only else tagged)
    digits = F.regexp_extract_all("_line", F.lit("[0-9]{12}"), F.lit(0))
    own = F.filter(digits, lambda d: F.sha2(d, 256).isin(*known_digests) if known_digests else F.lit(False))
    hits.append(F.transform(own, lambda d: F.struct(F.lit(known).alias("rule"), d.alias("whole"), d.alias("shown"))))
    found = lines.select(
        "path", F.when(~F.col("_bin"), F.col("_pos") + 1).alias("line_no"),
        F.explode(F.flatten(F.array(*hits))).alias("hit"),
    ).select("path", "line_no", "hit.*")

    excused = F.rlike("whole", F.lit(LONG_NUMBER))
    for word in (*allowed, *PLACEHOLDERS):
        excused = excused | F.contains("whole", F.lit(word))
    host = F.col("rule") == "live API Gateway hostname"
    example = F.lower(F.regexp_extract("whole", r"^([^.]+)\.", 1)).isin(*EXAMPLE_HOSTS)
    reported_better = (
        (F.col("rule") == "bare 12-digit account id") & F.sha2("shown", 256).isin(*known_digests)
        if known_digests else F.lit(False)
    )
    skip = (
        F.when(F.col("rule") == known, F.lit(False))
        .when(host, example)
        .otherwise(excused | reported_better)
    )
    return found.where(~skip).select("path", "line_no", "rule", F.substring("shown", 1, SNIPPET).alias("snippet"), (F.length("shown") > SNIPPET).alias("snippet_cut"))


# ---- claims against inventories ----------------------------------------------------------

def extract_uris(rows: DataFrame, key: str, document: str) -> DataFrame:
    """Object URIs anywhere in a JSON text: distinct, in order of first appearance."""
    found = F.array_distinct(F.regexp_extract_all(F.col(document), F.lit(r'"(s3://[^"]*)"(?!\s*:)'), F.lit(1)))
    return rows.select(key, F.posexplode(found).alias("position", "uri"))


def verify_claims(claims: DataFrame, inventory: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Claimed URIs that exist, are missing, and their bytes; claims that are no URI are skipped."""
    uris = claims.where(F.col("uri").startswith("s3://"))
    return (
        uris.join(inventory.select("uri", "bytes", F.lit(True).alias("_here")), "uri", "left")
        .groupBy(*keys)
        .agg(
            count_where(F.col("_here")).alias("verified"),
            count_where(F.col("_here").isNull()).alias("missing"),
            F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        )
    )


def missing_claims(claims: DataFrame, inventory: DataFrame) -> DataFrame:
    return claims.where(F.col("uri").startswith("s3://")).join(
        inventory.select("uri"), "uri", "left_anti"
    )


def verify_file_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Check every named digest; `manifest` has files_sha256 and/or files as map<string,string>.

    Returns one row per problem. Naming no digest at all raises: nothing to check is not a pass.
    """
    named = lambda c: F.when(F.size(c) > 0, F.col(c)) if c in manifest.columns else F.lit(None)
    digests = manifest.select(
        F.explode(F.coalesce(named("files_sha256"), named("files"))).alias("name", "want")
    )
    if digests.isEmpty():
        raise ValueError("the manifest names no file digest, so nothing was verified")
    return file_digest_problems(digests, files)


def file_digest_problems(digests: DataFrame, files: DataFrame) -> DataFrame:
    """`digests`: name, want; `files`: name, content."""
    have = files.select("name", F.sha2(F.col("content").cast("binary"), 256).alias("got"))
    problem = F.when(F.col("got").isNull(), "missing").when(F.col("got") != F.col("want"), "sha256 mismatch")
    return (
        digests.join(have, "name", "left").withColumn("problem", problem)
        .where(F.col("problem").isNotNull()).select("name", "problem")
    )


def leakage_path_guard(inventory: DataFrame, acceptance: DataFrame, prefixes: Sequence[str], enforce: bool = True) -> DataFrame:
    """Acceptance files that sit under an indexed prefix; with `enforce` any hit raises."""
    under = F.lit(False)
    for prefix in prefixes:
        under = under | F.col("uri").startswith(prefix)
    hits = inventory.where(under).join(acceptance.select("uri").distinct(), "uri", "left_semi")
    if enforce and not hits.isEmpty():
        raise ValueError("an acceptance file sits under a prefix that is indexed for retrieval")
    return hits
