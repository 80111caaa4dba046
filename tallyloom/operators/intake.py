"""Intake from conversations and forms, session ids, turn classes, transcripts, score logs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import text as tx
from tallyloom.functions.names import session_id
from tallyloom.functions.stats import count_where, money
from tallyloom.operators.ordering import newest, newest_overall

# Fixed alias table: canonical field and the names it goes by.
ALIASES = {
    "source_uri": ("source_uri", "source", "data_uri", "dataset_uri", "training_data_uri", "training_data"),
    "customer_eval_uri": ("customer_eval_uri", "eval_uri", "acceptance_uri", "eval_set_uri", "acceptance_set"),
    "ood_eval_uri": ("ood_eval_uri", "ood_uri", "ood_set"),
    "model_artifact_uri": ("model_artifact_uri", "model_uri", "artifact_uri"),
    "readiness_report_uri": ("readiness_report_uri", "audit_report_uri"),
    "retrieval_kb_id": ("retrieval_kb_id", "kb_id", "knowledge_base_id", "retrieval_kb", "knowledge_base"),
    "retrieval_k": ("retrieval_k",),
    "retrieval_distractors": ("retrieval_distractors", "distractors"),
    "kb_ocu_hours": ("kb_ocu_hours", "ocu_hours"),
    "pipeline_mode": ("pipeline_mode", "mode"),
    "hf_repo": ("hf_repo", "student_model", "student"),
    "student_model_id": ("student_model_id",),
    "teacher_model": ("teacher_model", "teacher", "teacher_model_id"),
    "budget_usd": ("budget_usd", "budget", "budget_reference"),
    "max_iterations": ("max_iterations", "iterations"),
    "training_instance": ("training_instance",),
    "keep_endpoint": ("keep_endpoint",),
    "sample_count": ("sample_count", "samples"),
    "labels_format": ("labels_format", "annotation_format", "label_format"),
    "classes": ("classes", "class_names", "categories"),
}
URI_FIELDS = ("source_uri", "customer_eval_uri", "ood_eval_uri", "model_artifact_uri", "readiness_report_uri")
CONTEXT_WORDS = ("kb", "knowledge base", "knowledge_base", "retrieval", "ingest")
MESSAGE_CHARS, TRANSCRIPT_CHARS, STALE_TURN_MINUTES = 8_000, 100_000, 20

# Fixed patterns of a claim in free text.
NAMED_URI = r"""\b([A-Za-z_][A-Za-z0-9_]{2,30})[:=\s]\s*(s3://[^\s"'`,)\]}]+)"""
KEY_VALUE = r"\b([A-Za-z_][A-Za-z0-9_]{2,30})\s*[:=]\s*([^\s,;]+)"
BARE_URI = r"""s3://[A-Za-z0-9._\-]+/[^\s"'`,)\]}]*"""
KB_TOKEN = r"\b[A-Z0-9]{10}\b"

# Fixed readiness questions (dotted paths into the plan's data block).
READINESS = (
    "source_uri", "verification_method", "datasheet.provenance", "datasheet.license",
    "datasheet.pii_disposition", "readiness_report_uri", "datasheet.consent",
    "customer_eval_uri", "decontamination",
)

# Fixed stage tasks, in dispatch order.
STAGE_TASKS = (
    ("data-prep", "generate"), ("data-prep", "curate"), ("finetune", "launch"),
    ("finetune", "analyze"), ("finetune", "remediate"), ("eval", "gate"),
    ("deploy", "deploy"), ("deploy", "smoke"), ("deploy", "teardown"),
)
SERVICED_TOOLS = (
    "stage_complete", "checkpoint", "escalate_human", "job_launched", "publish_cost_report",
    "update_rate_card", "flag_variance", "launch_run", "resolve_escalation", "page_human",
    "write_report",
)


def canonical(name: Column, aliases: dict[str, Sequence[str]] = ALIASES) -> Column:
    pairs = [F.lit(x) for canon, names in aliases.items() for a in names for x in (a, canon)]
    return F.try_element_at(F.create_map(*pairs), F.lower(name))


def _clean(value: Column) -> Column:
    return F.regexp_replace(value, r"[.,;]+$", "")


def mine_facts(
    turns: DataFrame, aliases: dict[str, Sequence[str]] = ALIASES, cap: int | None = None
) -> DataFrame:
    """Facts users state: named URIs, key/value pairs, bare URIs and knowledge-base ids.

    `turns`: conv_id, turn, role, text. Distinct per conversation in order of appearance, all of
    them; with a `cap`, one explicit cap row says the rest was not checked.
    """
    fact = lambda name, value: F.struct(name.alias("name"), value.alias("value"))

    def pairs(pattern: str) -> Column:
        return F.arrays_zip(
            F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("k"),
            F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("v"),
        )

    is_uri_field = lambda c: c.isin(*URI_FIELDS)
    named = F.transform(pairs(NAMED_URI), lambda p: fact(canonical(p["k"], aliases), _clean(p["v"])))
    named = F.filter(named, lambda f: is_uri_field(f["name"]))
    # A value loses its surrounding quotes first and trailing punctuation last.
    unquoted = lambda v: _clean(F.regexp_replace(F.regexp_replace(v, r'^"+|"+$', ""), r"^'+|'+$", ""))
    stated = F.transform(pairs(KEY_VALUE), lambda p: fact(canonical(p["k"], aliases), unquoted(p["v"])))
    stated = F.filter(
        stated,
        lambda f: f["name"].isNotNull() & ~f["value"].startswith("s3://") & ~is_uri_field(f["name"]),
    )
    rows = turns.where(F.col("role") == "user").withColumns({"_named": named, "_stated": stated})
    bare = F.array_distinct(
        F.transform(F.regexp_extract_all("text", F.lit(BARE_URI), F.lit(0)), _clean)
    )
    claimed = F.transform("_named", lambda f: f["value"])
    loose = F.transform(F.array_except(bare, claimed), lambda u: fact(F.lit("s3_uri"), u))
    rows = rows.withColumn("_known", F.concat("_named", "_stated", loose))
    about_kb = F.lit(False)
    for word in CONTEXT_WORDS:
        about_kb = about_kb | F.contains(F.lower("text"), F.lit(word))
    tokens = F.array_except(
        F.regexp_extract_all("text", F.lit(KB_TOKEN), F.lit(0)),
        F.transform("_known", lambda f: f["value"]),
    )
    kb = F.when(about_kb, F.transform(tokens, lambda t: fact(F.lit("retrieval_kb_id"), t))).otherwise(
        F.expr("array()").cast("array<struct<name:string,value:string>>")
    )
    said = rows.select("conv_id", "turn", F.posexplode(F.concat("_known", kb)).alias("_i", "f")).select(
        "conv_id", "turn", "_i", "f.*"
    )
    distinct = said.groupBy("conv_id", "name", "value").agg(F.min(F.struct("turn", "_i")).alias("_at"))
    if cap is None:
        position = F.row_number().over(Window.partitionBy("conv_id").orderBy("_at"))
        return distinct.select("conv_id", position.cast("long").alias("position"), "name", "value")
    kept = newest(distinct, ["conv_id"], [F.col("_at").asc()], cap)
    facts = kept.select("conv_id", F.col("position").cast("long").alias("position"), "name",
                        "value", "truncated")
    capped = facts.where(F.col("truncated") & (F.col("position") == cap)).select(
        "conv_id", F.lit(cap + 1).cast("long").alias("position"), F.lit("intake").alias("name"),
        F.lit("cap").alias("value"), "truncated",
    )
    return facts.unionByName(capped).drop("truncated")


def validate_forms(
    rows: DataFrame,
    spec: Sequence[tuple[str, str, bool]],
    group: Sequence[str] = (),
    aliases: dict[str, Sequence[str]] = ALIASES,
) -> tuple[DataFrame, DataFrame]:
    """Typed validation of submitted fields; returns (clean values, errors).

    `rows`: form_id, fields map<string,string>; `spec`: (param, type uri|number|bool|text,
    required) per form field. `group` lists fields that come all together or not at all.
    """
    kinds = F.create_map(*[F.lit(x) for param, kind, _ in spec for x in (param, kind)])
    raw = rows.select("form_id", F.explode("fields").alias("field", "raw"))
    checked = raw.select(
        "form_id", "field",
        F.coalesce(canonical(F.trim("field"), aliases), F.trim("field")).alias("param"),
        F.trim("raw").alias("value"),
    ).withColumn("type", F.try_element_at(kinds, F.col("param")))
    low = F.lower("value")
    error = (
        F.when(F.col("type").isNull(), "not a field of this task type")
        .when(F.col("value") == "", F.lit(None))
        .when((F.col("type") == "uri") & ~F.col("value").startswith("s3://"), "must be an s3:// URI")
        .when((F.col("type") == "number") & F.expr("try_cast(value AS double)").isNull(), "must be a number")
        .when((F.col("type") == "bool") & ~low.isin("true", "false", "yes", "no"), "must be true or false")
    )
    checked = checked.withColumn("error", error)
    normal = F.when(
        F.col("type") == "bool", F.when(low.isin("true", "yes"), "true").otherwise("false")
    ).otherwise(F.col("value"))
    given = F.col("type").isNotNull() & (F.col("value") != "")
    # Several names of one field in a form: the canonical name first, then by name.
    clean = checked.where(F.col("error").isNull() & given).groupBy("form_id", "param").agg(
        F.min_by(normal, F.struct(F.col("field") != F.col("param"), "field")).alias("value")
    )
    bad = checked.where(F.col("error").isNotNull()).select(
        "form_id",
        F.when(F.col("type").isNull(), F.col("field")).otherwise(F.col("param")).alias("field"),
        "error",
    )
    # What is absent shows per form: every spec field against the set the form answered.
    valid = given & F.col("error").isNull()
    answers = checked.groupBy("form_id").agg(
        F.collect_set(F.when(given, F.col("param"))).alias("_answered"),
        F.collect_set(F.when(valid, F.col("param"))).alias("_valid"),
    )
    forms = rows.select("form_id").join(answers, "form_id", "left")
    nothing = F.array().cast("array<string>")
    names = lambda params: F.array(*[F.lit(p) for p in params]).cast("array<string>")
    lacking = F.array_except(
        names([p for p, _, required in spec if required]), F.coalesce("_answered", nothing)
    )
    absent = forms.select("form_id", F.explode(lacking).alias("field")).withColumn(
        "error", F.lit("required")
    )
    errors = bad.unionByName(absent)
    if group:
        gap = F.array_except(names(group), F.coalesce("_valid", nothing))
        partial = forms.withColumn("_gap", gap).where(
            (F.size("_gap") > 0) & (F.size("_gap") < len(group))
        )
        errors = errors.unionByName(
            partial.select(
                "form_id", F.lit("retrieval").alias("field"),
                F.concat(F.lit("all or none; missing "), F.concat_ws(", ", "_gap")).alias("error"),
            )
        )
    return clean, errors


def readiness(plans: DataFrame, facts: DataFrame, forms: DataFrame, questions: Sequence[str] = READINESS) -> DataFrame:
    """Which readiness questions each task answers, with verified facts and form values overlaid.

    `plans`: task_id, data (JSON text); `facts`: task_id, name, value, status;
    `forms`: task_id, name, value.
    """
    grid = plans.select(
        "task_id",
        F.explode(
            F.array(*[
                F.struct(F.lit(q).alias("field"), F.get_json_object("data", f"$.{q}").alias("answer"))
                for q in questions
            ])
        ).alias("q"),
    ).select("task_id", "q.*")
    verified = facts.groupBy("task_id", F.col("name").alias("field")).agg(
        F.min(F.struct("position", "status", "value")).alias("fact")
    )
    given = forms.select("task_id", F.col("name").alias("field"), F.col("value").alias("form_value"))
    answered = ~F.coalesce("answer", F.lit("")).isin("", "[]", "{}")
    confirmed = F.coalesce(F.col("fact.status") == "verified", F.lit(False))
    by_form = ~confirmed & ~answered & (F.coalesce("form_value", F.lit("")) != "")
    value = (
        F.when(answered, F.col("answer"))
        .when(confirmed, F.col("fact.value"))
        .when(by_form, F.col("form_value"))
        .otherwise("")
    )
    return grid.join(verified, ["task_id", "field"], "left").join(given, ["task_id", "field"], "left").select(
        "task_id", "field", answered.alias("answered"), confirmed.alias("verified"),
        by_form.alias("via_form"), value.alias("value"),
    )


def readiness_score(fields: DataFrame) -> DataFrame:
    return fields.groupBy("task_id").agg(
        count_where(F.col("answered")).alias("answered"), F.count("*").alias("total")
    )


def session_ids(runs: DataFrame, events: DataFrame, cap: int, cutoff: str | None = None) -> DataFrame:
    """Ids of the sessions that ran, newest runs first, cut at `cap`.

    `runs`: run_id, created_at, rolled_session_ids; `events`: run_id, stage, task. A run without
    events is taken to have run every stage task; an event without a task stands for all of them.
    """
    eligible = runs if cutoff is None else runs.where(F.col("created_at") >= cutoff)
    combos = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(s).alias("stage"), F.lit(t).alias("task"))
        for i, (s, t) in enumerate(STAGE_TASKS)
    ])
    seen = events.select("run_id", "stage", F.coalesce("task", F.lit("")).alias("task")).distinct()
    any_seen = seen.select("run_id").distinct().withColumn("_ran", F.lit(True))
    grid = eligible.select("run_id", "created_at", F.explode(combos).alias("c")).select("run_id", "created_at", "c.*")
    exact = seen.where(F.col("task") != "").withColumn("_exact", F.lit(True))
    loose = seen.where(F.col("task") == "").select("run_id", "stage", F.lit(True).alias("_loose"))
    ran = (
        grid.join(any_seen, "run_id", "left")
        .join(exact, ["run_id", "stage", "task"], "left")
        .join(loose, ["run_id", "stage"], "left")
        .where(F.col("_ran").isNull() | F.col("_exact") | F.col("_loose"))
        .select("run_id", "created_at", "i", session_id(F.col("run_id"), F.col("stage"), F.col("task")).alias("session_id"))
    )
    rolled = eligible.select(
        "run_id", "created_at", F.posexplode("rolled_session_ids").alias("_p", "session_id")
    ).select("run_id", "created_at", (F.col("_p") + len(STAGE_TASKS)).alias("i"), "session_id")
    order = [F.col("created_at").desc(), F.col("run_id").desc(), F.col("i").asc()]
    return newest_overall(ran.unionByName(rolled), order, cap).select("position", "run_id", "session_id")


# ---- turn classes ------------------------------------------------------------------------

_NAME = "[A-Za-z_][A-Za-z0-9_]*"
# Fixed: the one call that may stand as a bare name, as it reads no argument.
NO_ARGUMENT_CALLS = ("checkpoint",)


# Fixed: the heads of typed calls as agents write them, a closed tag with its parameters, a name
# with an object in parentheses, a bold name that an object may follow.
_TAG = r'<invoke\s+name="({0})"\s*>(?=(.*?)</invoke>)'
_CALL = r"\b({0})\(\s*(?:\*\*)?\s*(?=(\{{.*))"
_BOLD = r"\*\*({0})\*\*(?=[\s:]*(?:```(?:json)?\s*)?(\{{.*)?)"
_PARAMETER = rf'(?s)<parameter\s+name="({_NAME})"\s*>\s*(.*?)\s*</parameter>'
# Everything of a text in pieces: a quoted string (to the end, if it does not close), a brace, the rest.
_PIECES = r'(?s)"(?:[^"\\]|\\.|\\\z)*+(?:"|\z)|[{}]|[^"{}]++'


def balanced_object(text: Column) -> Column:
    """The brace-balanced object a text begins with, nested however deep; null if it does not close."""
    pieces = F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("closed"))

    def step(at: Column, piece: Column) -> Column:
        depth = at["depth"] + F.when(piece == "{", 1).when(piece == "}", -1).otherwise(0)
        return F.when(at["closed"], at).otherwise(
            F.struct(depth.alias("depth"), (at["size"] + F.length(piece)).alias("size"), (depth == 0).alias("closed")))

    end = F.aggregate(pieces, start, step)
    return tx.bind(end, lambda e: F.when(e["closed"] & text.startswith("{"), F.substring(text, F.lit(1), e["size"])))


def _is_json(text: Column) -> Column:
    return F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False)) & (text != "")


def _quoted(text: Column) -> Column:
    """A string as a JSON value."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _tag_arguments(body: Column) -> Column:
    """The parameters of a tag as one JSON object: JSON values as they are, others as strings.

    A name given twice keeps its first place and its last value.
    """
    part = lambda i: F.regexp_extract_all(body, F.lit(_PARAMETER), F.lit(i))

    def joined(given: Column) -> Column:
        def entry(name: Column) -> Column:
            value = F.element_at(F.filter(given, lambda g: g["name"] == name), -1)["value"]
            return F.concat(_quoted(name), F.lit(":"), F.when(_is_json(value), value).otherwise(_quoted(value)))

        names = F.array_distinct(F.transform(given, lambda g: g["name"]))
        return F.concat(F.lit("{"), F.array_join(F.transform(names, entry), ","), F.lit("}"))

    return tx.bind(F.arrays_zip(part(1).alias("name"), part(2).alias("value")), joined)


def classify_turns(turns: DataFrame, serviced: Sequence[str] = SERVICED_TOOLS, trailer: Sequence[str] = ()) -> DataFrame:
    """How each turn ended: a structured call, a call typed into the text, or prose.

    `turns`: text, tool_name (null when none). A typed call is a closed tag, a name with one valid
    JSON object as its argument, or a bold name with such an object; only `NO_ARGUMENT_CALLS` may
    stand bare. The last one of a serviced name wins; `arguments` holds its object as JSON text.
    `trailer` keys, when given, add the last fenced JSON object carrying all of them.
    """
    names = "|".join(sorted(map(re.escape, serviced), key=len, reverse=True)) or r"[^\s\S]"
    heads = rf"(?s){_TAG}|{_CALL}|{_BOLD}".format(rf"(?:{names})(?![A-Za-z0-9_])")
    group = lambda i: F.regexp_extract_all("text", F.lit(heads), F.lit(i))
    heads_of = F.arrays_zip(*[group(i).alias(n) for i, n in enumerate(("tag", "body", "call", "object", "bold", "given"), 1)])

    def typed(h: Column) -> Column:
        is_tag, is_call = h["tag"] != "", h["call"] != ""
        name = F.when(is_tag, h["tag"]).when(is_call, h["call"]).otherwise(h["bold"])
        bare = ~is_tag & ~is_call & h["bold"].isin(*NO_ARGUMENT_CALLS)

        def call(text: Column) -> Column:
            valid = F.coalesce(_is_json(text), F.lit(False))
            arguments = F.when(is_tag, _tag_arguments(h["body"])).when(valid, text).otherwise("{}")
            return F.struct(name.alias("name"), (is_tag | valid | bare).alias("stands"), arguments.alias("arguments"))

        return tx.bind(F.when(~is_tag, balanced_object(F.when(is_call, h["object"]).otherwise(h["given"]))), call)

    found = F.filter(F.transform(heads_of, typed), lambda c: c["stands"])
    last = F.try_element_at(found, F.lit(-1))
    called = F.col("tool_name").isin(*serviced)
    out = turns.withColumn("_typed", last).withColumns(
        {
            "call": F.when(called, F.col("tool_name")).otherwise(F.col("_typed.name")),
            "turn_end": F.when(called, "structured").when(F.col("_typed").isNotNull(), "recovered").otherwise("prose"),
            "arguments": F.when(~F.coalesce(called, F.lit(False)), F.col("_typed.arguments")),
        }
    ).drop("_typed")
    if trailer:
        fenced = F.regexp_extract_all("text", F.lit(r"(?s)```(?:json)?\s*(\{.*?\})\s*```"), F.lit(1))
        complete = F.filter(
            fenced,
            lambda b: F.coalesce(
                F.size(F.array_intersect(F.json_object_keys(b), F.array(*[F.lit(k) for k in trailer]))) == len(trailer),
                F.lit(False),
            ),
        )
        out = out.withColumn("trailer", F.when(F.size(complete) > 0, F.element_at(complete, -1)))
    return out


def turn_end_counts(classified: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The counters a protocol rollup needs, from classified turns."""
    return classified.groupBy(*keys).agg(
        F.count("*").alias("turns"),
        count_where(F.col("turn_end") != "prose").alias("serviced_turns"),
        count_where(F.col("turn_end") == "prose").alias("prose_turns"),
        count_where(F.col("turn_end") == "recovered").alias("recovered_typed_calls"),
    )


# ---- transcripts and score logs ----------------------------------------------------------

def rebuild_transcripts(chunks: DataFrame, display: int = MESSAGE_CHARS, audit: int = TRANSCRIPT_CHARS) -> DataFrame:
    """Threads in append order with display and audit texts, one row per message.

    `chunks`: conv_id, key (object key, sorts by time), pos, role, text. Order is kept as the
    (key, pos) pair, so no thread has to fit in one task.
    """
    return chunks.select(
        "conv_id", "key", "pos", "role",
        F.substring("text", 1, display).alias("display_text"),
        F.substring("text", 1, audit).alias("audit_text"),
        (F.length("text") > display).alias("display_cut"),
        (F.length("text") > audit).alias("audit_cut"),
    )


def thread_summary(threads: DataFrame, status: DataFrame, now: str, stale_minutes: int = STALE_TURN_MINUTES) -> DataFrame:
    """Message counts per thread; a thread 'thinking' longer than the limit is stale."""
    sizes = threads.groupBy("conv_id").agg(
        F.count("*").alias("n_messages"), count_where(F.col("display_cut")).alias("n_cut")
    )
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("updated_at")) / 60
    return sizes.join(status, "conv_id", "left").select(
        "conv_id", "n_messages", "n_cut", "status",
        ((F.col("status") == "thinking") & (age > stale_minutes)).alias("stale"),
    )


def eval_score_stats(logs: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """Mean score per evaluator from JSON log lines whose field names drift.

    `prefix` keeps only evaluators of one tenant; it is applied before anything is counted.
    """
    j = lambda path: F.get_json_object(F.col(column), path)
    parsed = F.try_parse_json(column)
    number = lambda path: F.when(
        F.regexp_extract(F.schema_of_variant(F.try_variant_get(parsed, path, "variant")), r"^(\w+)", 1)
        .isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "TINYINT", "SMALLINT", "INT"),
        F.try_variant_get(parsed, path, "double"),
    )
    filled = lambda c: F.when(c != "", c)
    attribute = j("$.attributes['gen_ai.evaluation.name']")
    name = F.coalesce(
        filled(attribute), filled(j("$.evaluatorId")), filled(j("$.evaluator")),
        filled(j("$.evaluatorName")), filled(j("$.metricName")), F.lit(""),
    )
    name = F.when(name == "gen_ai.evaluation.result", F.coalesce(attribute, F.lit(""))).otherwise(name)
    paths = ['$.attributes["gen_ai.evaluation.score.value"]']
    for key in ("score", "value", "result", "metricValue"):
        paths += [f"$.{key}", f"$.{key}.value", f"$.{key}.score"]
    value = F.coalesce(*[number(p) for p in paths])
    rows = logs.select(F.replace(name, F.lit("Builtin."), F.lit("")).alias("evaluator"), value.alias("value"))
    if prefix:
        rows = rows.where(F.col("evaluator").startswith(prefix))
    return rows.where((F.col("evaluator") != "") & F.col("value").isNotNull()).groupBy("evaluator").agg(
        F.count("*").alias("n"), (F.sum(money("value")).cast("double") / F.count("*")).alias("avg_score")
    )


def batch_eval_rollup(results: DataFrame, prefix: str, limit: int) -> DataFrame:
    """Newest evaluations of one tenant with sessions and per-evaluator scores.

    `results`: id, name, created_at, total, completed, failed,
    evaluators array<struct<evaluator,avg,evaluated,failed>>. Filter, order, then cut.
    """
    ours = results.where(F.col("name").startswith(prefix))
    cut = newest_overall(ours, [F.col("created_at").desc(), F.col("id").desc()], limit)
    return cut.select(
        "position", "id", "name", F.col("total").alias("sessions_total"),
        F.col("completed").alias("sessions_completed"), F.col("failed").alias("sessions_failed"),
        F.explode_outer("evaluators").alias("e"),
    ).select(
        "position", "id", "name", "sessions_total", "sessions_completed", "sessions_failed",
        F.replace("e.evaluator", F.lit("Builtin."), F.lit("")).alias("evaluator"),
        F.col("e.avg").alias("avg_score"), F.col("e.evaluated").alias("evaluated"),
        F.col("e.failed").alias("failed"),
    )
