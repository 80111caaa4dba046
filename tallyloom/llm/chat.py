"""Chat formatting with linked tool calls, in DataFrame expressions only.

A message may hold calls (`{"tool_calls": [{"id", "name", "arguments"}]}`) or a result
(`{"tool_call_id", "content"}`). Calls and results meet in a hash join on (conversation, call id).
The order is topological: a result stands after its call, and a call that names other calls in
`arguments.after` stands after them; otherwise turns keep their order. Arguments are validated
against a schema table (`tool, argument, type, required`), and every line is canonical JSON: keys
in code-point order, no spaces.

One row per message, call and result, so a conversation of any length is never gathered in one row.
A null or empty text is an empty message. A text that is not such an object is a plain message.
A call without id is invalid. Of several calls with one id in a conversation the earliest counts, the
others are `duplicate`; of several results likewise. A result whose call is absent is an `orphan`
and keeps its turn; a call without result is `unanswered`. Calls that wait for each other in a ring,
and calls that wait for such, can never run: they keep their turn and are invalid (`waits in a ring`).
Null conversation ids form one conversation; a null turn comes before all others. Repeated rows are
kept and ordered among themselves. Other columns of the messages are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import durable, fresh_path

_MESSAGE = "tool_calls array<struct<id:string,name:string,arguments:map<string,string>>>, tool_call_id string, content string"


def canonical(fields: dict[str, Column]) -> Column:
    """A JSON object of string or raw JSON columns, keys in code-point order; null members are left out."""
    members = [F.when(value.isNotNull(), F.concat(F.lit(f'"{key}":'), value)) for key, value in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def quoted(text: Column) -> Column:
    """A JSON string."""
    inner = F.to_json(F.struct(text.alias("s")), {"ignoreNullFields": "false"})
    return F.when(text.isNotNull(), F.substring(inner, F.lit(6), F.length(inner) - 6))


def canonical_map(arguments: Column) -> Column:
    """A JSON object of a string map, keys in code-point order; null values as null."""
    items = F.array_sort(F.map_entries(arguments))
    members = F.transform(items, lambda e: F.concat(quoted(e["key"]), F.lit(":"), F.coalesce(quoted(e["value"]), F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))


_CHECKS = {
    "string": lambda v: F.lit(True),
    "integer": lambda v: v.rlike(r"^-?(0|[1-9][0-9]*)$"),
    "number": lambda v: v.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"),
    "boolean": lambda v: v.isin("true", "false"),
}


def argument_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """`_call, errors`: per call the sorted findings against its tool's schema; calls in order get none."""
    table = schemas.select(F.col("tool").alias("_tool"), F.struct("argument", "type", "required").alias("_rule"))
    tools = table.groupBy("_tool").agg(F.collect_set("_rule").alias("_rules"))
    joined = calls.join(tools, F.col("name") == F.col("_tool"), "left")
    args = F.coalesce(F.col("arguments"), F.create_map().cast("map<string,string>"))
    value = lambda r: F.element_at(args, r["argument"])
    right = lambda r: F.coalesce(*[F.when(r["type"] == k, check(value(r))) for k, check in _CHECKS.items()], F.lit(False))
    missing = F.transform(F.filter("_rules", lambda r: r["required"] & value(r).isNull()), lambda r: F.concat(F.lit("missing "), r["argument"]))
    wrong = F.transform(F.filter("_rules", lambda r: value(r).isNotNull() & ~right(r)), lambda r: F.concat(F.lit("not "), r["type"], F.lit(" "), r["argument"]))
    known = F.transform("_rules", lambda r: r["argument"])
    extra = F.transform(F.array_except(F.map_keys(args), known), lambda k: F.concat(F.lit("unknown "), k))
    found = F.when(F.col("_tool").isNull(), F.array(F.lit("unknown tool"))).otherwise(F.array_sort(F.concat(missing, wrong, extra)))
    return joined.withColumn("errors", found).drop("_tool", "_rules")


def parse(messages: DataFrame) -> DataFrame:
    """One row per message, call and result of `conv_id, turn, role, text`, written once.

    `kind` is the partition column of the table, so who asks for calls does not read messages.
    """
    given = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    parsed = given.withColumn("m", F.when(F.col("text").startswith("{"), F.from_json("text", _MESSAGE)))
    none = F.lit(None)

    def item(kind, place=F.lit(0), call_id=none, name=none, arguments=none, content=none):
        return F.struct(
            place.cast("int").alias("place"), call_id.cast("string").alias("call_id"), name.cast("string").alias("name"),
            arguments.cast("map<string,string>").alias("arguments"), content.cast("string").alias("content"), F.lit(kind).alias("kind"),
        )

    calls = F.transform("m.tool_calls", lambda c, i: item("call", i, c["id"], c["name"], c["arguments"]))
    items = F.when(F.size("m.tool_calls") > 0, calls).when(
        F.col("m.tool_call_id").isNotNull(), F.array(item("result", call_id=F.col("m.tool_call_id"), content=F.col("m.content")))
    ).otherwise(F.array(item("message", content=F.col("text"))))
    rows = parsed.select("conv_id", "turn", "role", F.explode(items).alias("i")).select("conv_id", "turn", "role", "i.*")
    rows = rows.withColumn("after", F.col("arguments")["after"]).select(*[c for c in rows.columns if c != "kind"], "after", "kind")
    path = fresh_path(messages.sparkSession, "chat")
    rows.write.option("compression", "zstd").partitionBy("kind").parquet(path)
    return messages.sparkSession.read.schema(rows.schema).parquet(path)


def call_facts(rows: DataFrame) -> DataFrame:
    """Per (conversation, call id) in one pass over calls and results: `key, call_id, first, answer`.

    `first` is (turn, place, after) of the earliest call, `answer` (turn) of the earliest result; null
    where there is none. `key` is the conversation as text, empty for null.
    """
    is_call = F.col("kind") == "call"
    return rows.where("kind <> 'message' AND call_id IS NOT NULL").groupBy(_key().alias("key"), "call_id").agg(
        F.min(F.when(is_call, F.struct("turn", "place", "after"))).alias("first"), F.min(F.when(~is_call, F.struct("turn"))).alias("answer"),
    )


def _key() -> Column:
    return F.coalesce(F.col("conv_id").cast("string"), F.lit(""))


def waits(facts: DataFrame) -> DataFrame:
    """`key, call_id, at, depth, ring` of the calls that wait or are waited for.

    (`at`, `depth`) is the latest turn among a call and all it waits for, and the longest way to a
    call of that turn. Per call the table holds the best such pair found and its open edges (call, ways
    there). Each round looks one edge ahead: a settled call ends the edge, a call with one edge is
    jumped over, so a chain is halved; only calls with several open edges are waited for. A way that is
    no shorter than a conversation has calls went round a ring, and so did all that is left when nothing
    moves. Chains and trees take rounds by the logarithm of their length.
    """
    calls = facts.where("first IS NOT NULL").select("key", "call_id", F.col("first.turn").alias("turn"), F.col("first.after").alias("after"))
    named = calls.where("after IS NOT NULL").select("key", "call_id", F.explode(F.array_distinct(F.split("after", r"\s*,\s*"))).alias("needs"))
    edges = durable(named.where("needs <> call_id").join(calls.select("key", F.col("call_id").alias("needs")), ["key", "needs"], "left_semi"), "edges")
    ends = edges.select("key", "call_id").unionByName(edges.select("key", F.col("needs").alias("call_id"))).distinct()
    value, edge = F.struct(F.col("turn").alias("at"), F.lit(0).cast("long").alias("depth")), F.struct("needs", F.lit(1).cast("long").alias("ways"))
    opened = edges.groupBy("key", "call_id").agg(F.collect_list(edge).alias("open"))
    none = F.array().cast("array<struct<needs:string,ways:bigint>>")
    state = durable(
        calls.join(ends, ["key", "call_id"], "left_semi").join(opened, ["key", "call_id"], "left")
        .select("key", "call_id", value.alias("best"), F.coalesce("open", none).alias("open"), F.lit(False).alias("ring"), F.lit(True).alias("moved")),
        "waits",
    )
    most = state.groupBy("key").count().agg(F.max("count")).first()[0]
    while state.where("moved AND size(open) > 0").limit(1).count():
        looked = state.select("key", F.col("call_id").alias("needs"), F.col("best").alias("_best"), F.col("open").alias("_open"), F.col("ring").alias("_ring"))
        ahead = state.select("key", "call_id", F.explode("open").alias("e")).select("key", "call_id", "e.*").join(looked, ["key", "needs"])
        few = F.size("_open") <= 1
        onward = F.when(F.size("_open") == 1, F.struct(F.col("_open")[0]["needs"].alias("needs"), (F.col("ways") + F.col("_open")[0]["ways"]).alias("ways"))).when(
            F.size("_open") > 1, F.struct("needs", "ways"))
        seen = F.when(few & ~F.col("_ring"), F.struct(F.col("_best.at").alias("at"), (F.col("_best.depth") + F.col("ways")).alias("depth")))
        found = ahead.select("key", "call_id", seen.alias("best"), onward.alias("edge"), "_ring", few.alias("moved")).select(
            "key", "call_id", "best", "edge", (F.col("_ring") | F.coalesce(F.col("edge.ways") >= most, F.lit(False))).alias("ring"), "moved")
        own = state.select("key", "call_id", "best", F.lit(None).cast("struct<needs:string,ways:bigint>").alias("edge"), "ring", F.lit(False).alias("moved"))
        met = own.unionByName(found).groupBy("key", "call_id").agg(
            F.max("best").alias("best"), F.sort_array(F.collect_set("edge")).alias("_to"), F.max("ring").alias("ring"), F.max("moved").alias("moved"))
        # of several ways to one call the longest stays
        longest = F.filter("_to", lambda e, i: ~F.coalesce(F.get("_to", i + 1)["needs"] == e["needs"], F.lit(False)))
        state = durable(met.select("key", "call_id", "best", F.when(F.col("ring"), none).otherwise(longest).alias("open"), "ring", "moved"), "waits")
    return state.select("key", "call_id", "best.at", "best.depth", (F.col("ring") | (F.size("open") > 0)).alias("ring"))


def link(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """`conv_id, place, role, kind, call_id, status, errors, line` in topological order.

    `place` holds the sort key as a struct (turn, depth, place, step, own turn); sorting by it
    within a conversation gives the order. Messages are not shuffled, calls and results once, to the
    facts of their call.
    """
    rows = parse(messages)
    facts = durable(call_facts(rows), "facts")
    own_turn, own_place, zero = F.col("first.turn"), F.col("first.place"), F.lit(0)
    late = waits(facts) if facts.where("first.after IS NOT NULL").limit(1).count() else None
    if late is None:
        placed = facts.select("*", own_turn.alias("at"), zero.alias("depth"), F.lit(False).alias("ring"))
    else:
        ring = F.coalesce("ring", F.lit(False))
        still = F.col("depth").isNull() | ring
        placed = facts.join(late, ["key", "call_id"], "left").select(
            *facts.columns, F.when(still, own_turn).otherwise(F.col("at")).alias("at"), F.when(still, zero).otherwise(F.col("depth")).alias("depth"), ring.alias("ring"))
    placed = placed.withColumn("_salt", F.lit(0))

    def with_facts(kind):
        # calls without id have no facts; salted, they do not meet in one task
        salt = F.when(F.col("call_id").isNull(), F.pmod(F.hash("turn", "place", "name"), F.lit(1009))).otherwise(0)
        return rows.where(F.col("kind") == kind).withColumn("key", _key()).withColumn("_salt", salt).join(placed, ["key", "call_id", "_salt"], "left")

    checked = argument_errors(with_facts("call"), schemas)
    errors = F.when(F.coalesce("ring", F.lit(False)), F.array_append("errors", F.lit("waits in a ring"))).otherwise(F.col("errors"))
    is_first = F.col("turn").eqNullSafe(own_turn) & (F.col("place") == own_place)
    status = (
        F.when(F.col("call_id").isNull() | F.col("name").isNull(), "invalid").when(~is_first, "duplicate")
        .when(F.size("errors") > 0, "invalid").when(F.col("answer").isNull(), "unanswered").otherwise("linked")
    )
    key = lambda turn, depth, place, step: F.struct(
        turn.alias("turn"), depth.cast("int").alias("depth"), place.cast("int").alias("place"), F.lit(step).alias("step"), F.col("turn").alias("own"))
    call_rows = checked.withColumn("errors", errors).select(
        "conv_id", key(F.when(F.col("first").isNull(), F.col("turn")).otherwise(F.col("at")), F.coalesce("depth", zero), F.col("place"), 1).alias("place"),
        "role", "kind", "call_id", status.alias("status"), "errors",
        canonical({"arguments": canonical_map(F.coalesce("arguments", F.create_map().cast("map<string,string>"))), "id": quoted(F.col("call_id")),
                   "name": quoted(F.col("name")), "role": quoted(F.col("role"))}).alias("line"),
    )
    later = F.coalesce(F.col("turn") > F.col("at"), F.col("turn").isNotNull() & F.col("at").isNull())
    behind = F.col("first").isNotNull() & ~later
    result_rows = with_facts("result").select(
        "conv_id",
        key(F.when(behind, F.col("at")).otherwise(F.col("turn")), F.when(behind, F.col("depth")).otherwise(zero), F.when(behind, own_place).otherwise(zero), 2).alias("place"),
        "role", "kind", "call_id",
        F.when(F.col("first").isNull(), "orphan").when(~F.col("turn").eqNullSafe(F.col("answer.turn")), "duplicate").otherwise("linked").alias("status"),
        F.array().cast("array<string>").alias("errors"),
        canonical({"content": quoted(F.col("content")), "id": quoted(F.col("call_id")), "role": quoted(F.col("role"))}).alias("line"),
    )
    plain_rows = rows.where("kind = 'message'").select(
        "conv_id", key(F.col("turn"), zero, zero, 0).alias("place"), "role", "kind", "call_id",
        F.lit("plain").alias("status"), F.array().cast("array<string>").alias("errors"),
        canonical({"content": quoted(F.col("content")), "role": quoted(F.col("role"))}).alias("line"),
    )
    return plain_rows.unionByName(call_rows).unionByName(result_rows)
