"""Augmentation, gate and split queries over the given tables and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import grids as g
from tallyloom.operators import augmentation as a
from tallyloom.session import spread, table

K, SEED = 20, 11

# Two 2x3 grids per part, drawn from its key, size and name length.
_CELL = "((p_partkey * {m} + {o}) % 10)"


def _grid_sql(o: int) -> str:
    c = lambda i: "' || " + _CELL.format(m=i + o, o=i * o) + " || '"
    return f"'(2x3):\\n{c(1)} {c(2)} {c(3)}\\n{c(4)} {c(5)} {c(6)}\\n'"


def triplets(spark, sf):
    return spread(table(spark, sf, "part")).selectExpr(
        "p_partkey", "lpad(hex(p_partkey), 8, '0') AS task_id",
        f"'Task ' || p_name || '\\nInput ' || {_grid_sql(1)} || 'Output ' || {_grid_sql(2)} || 'End.' AS prompt",
        "'import x\\ndef transform(grid):\\n    return grid  # transform ' || p_size || '\\n\\n' AS code")


def _flat(col):
    return F.array_join(F.transform(col, lambda r: F.array_join(r.cast("array<string>"), "")), "/")


def parsed(spark, sf):
    rows = triplets(spark, sf).withColumn("gs", g.parse_grids(F.col("prompt")))
    pairs = g.pair_up(F.transform("gs", lambda x: x["grid"]))
    return rows.withColumn("p", pairs).select(
        "p_partkey", F.size("p").cast("long").alias("n_pairs"), _flat(F.col("p")[0]["input"]).alias("input"), _flat(F.col("p")[0]["output"]).alias("output"))


def _cells(o: int) -> list[str]:
    return [_CELL.format(m=i + o, o=i * o) for i in range(1, 7)]


def _flat_sql(cells: list[str], width: int) -> str:
    rows = [cells[i:i + width] for i in range(0, len(cells), width)]
    return " || '/' || ".join(" || ".join(f"CAST({c} AS VARCHAR)" for c in r) for r in rows)


_PARSED = f"SELECT p_partkey, 1::BIGINT AS n_pairs, {_flat_sql(_cells(1), 3)} AS input, {_flat_sql(_cells(2), 3)} AS output FROM part"


def moved(spark, sf):
    """Every geometry of every part's first grid, colours shifted by the part's size."""
    rows = triplets(spark, sf).join(table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey")
    rows = rows.withColumn("grid", g.parse_grids(F.col("prompt"))[0]["grid"])
    rows = rows.select("p_partkey", "p_size", "grid", F.explode(F.array(*[F.lit(x) for x in g.GEOMETRIES])).alias("geom"))
    perm = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: ((i + F.col("p_size")) % 10).cast("int"))
    out = rows.withColumn("perm", perm)
    out = out.withColumn("new", g.transform_grid(F.col("grid"), F.col("geom"), F.col("perm")))
    inverse = F.transform("new", lambda r: F.transform(r, lambda c: F.get(g.invert_permutation(F.col("perm")), c)))
    back = F.lit(None).cast("string")
    for name, undo in g.INVERSE.items():
        back = F.when(F.col("geom") == name, undo).otherwise(back)
    restored = g.apply_geometry(inverse, back)
    return out.select("p_partkey", "geom", _flat(F.col("new")).alias("grid"), (restored == F.col("grid")).alias("restored"))


_ORDERS = {"rot90": ([3, 6, 2, 5, 1, 4], 2), "rot180": ([6, 5, 4, 3, 2, 1], 3), "rot270": ([4, 1, 5, 2, 6, 3], 2),
           "fliph": ([3, 2, 1, 6, 5, 4], 3), "flipv": ([4, 5, 6, 1, 2, 3], 3)}
_SHIFTED = [f"(({c} + p_size) % 10)" for c in _cells(1)]
_MOVED = " UNION ALL ".join(
    f"SELECT p_partkey, '{name}' AS geom, {_flat_sql([_SHIFTED[i - 1] for i in order], width)} AS grid, true AS restored FROM part"
    for name, (order, width) in _ORDERS.items())


def planned(spark, sf):
    """Per task: how many variants, distinct signatures, permutations that keep or move 0."""
    plan = a.plan_variants(triplets(spark, sf), "task_id", 24, SEED)
    zero = F.get("perm", F.lit(0))
    valid = F.sort_array("perm") == F.sequence(F.lit(0), F.lit(9))
    return plan.groupBy("task_id").agg(
        F.count("*").alias("n"), F.countDistinct("sig").alias("distinct_sigs"),
        F.sum(F.when(F.endswith("tag", F.lit("perm9")) & (zero == 0) & valid, 1).otherwise(0)).alias("keep_zero"),
        F.sum(F.when(F.endswith("tag", F.lit("perm10")) & (zero != 0) & valid, 1).otherwise(0)).alias("move_zero"))


_PLANNED = "SELECT lpad(upper(to_hex(p_partkey)), 8, '0') AS task_id, 24::BIGINT AS n, 24::BIGINT AS distinct_sigs, 12::BIGINT AS keep_zero, 7::BIGINT AS move_zero FROM part"


def wrapped(spark, sf):
    rows = triplets(spark, sf).join(table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey")
    perm = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: ((i + F.col("p_size")) % 10).cast("int"))
    geom = F.when(F.col("p_partkey") % 3 == 0, "rot90").when(F.col("p_partkey") % 3 == 1, "fliph")
    perm = F.when(F.col("p_partkey") % 2 == 0, perm)
    return rows.select("p_partkey", F.md5(g.wrap_code(F.col("code"), geom, perm)).alias("digest"))


_PERM = " || ', ' || ".join(f"((p_size + {i}) % 10)" for i in range(10))
_INV = " || ', ' || ".join(f"(({i} + 10 - p_size % 10) % 10)" for i in range(10))
_WRAPPED = f"""SELECT p_partkey, md5('import x' || chr(10) || 'def _transform_base(grid):' || chr(10) || '    return grid  # _transform_base ' || p_size || chr(10) || chr(10) || chr(10) || 'def transform(grid):' || chr(10) || '    import numpy as np' || chr(10)
  || CASE WHEN p_partkey % 2 = 0 THEN '    _perm = np.array([' || {_PERM} || '])' || chr(10) || '    _inv_perm = np.array([' || {_INV} || '])' || chr(10) ELSE '' END || '    g = np.array(grid)' || chr(10)
  || CASE WHEN p_partkey % 2 = 0 THEN '    g = _inv_perm[g]' || chr(10) ELSE '' END
  || CASE p_partkey % 3 WHEN 0 THEN '    g = np.rot90(g, 3)' || chr(10) WHEN 1 THEN '    g = np.flip(g, 1)' || chr(10) ELSE '' END
  || '    out = np.array(_transform_base(g.tolist()))' || chr(10)
  || CASE p_partkey % 3 WHEN 0 THEN '    out = np.rot90(out, 1)' || chr(10) WHEN 1 THEN '    out = np.flip(out, 1)' || chr(10) ELSE '' END
  || CASE WHEN p_partkey % 2 = 0 THEN '    out = _perm[out]' || chr(10) ELSE '' END || '    return out.tolist()') AS digest FROM part"""


def rerendered(spark, sf):
    """Each prompt rendered again with its two grids swapped."""
    rows = triplets(spark, sf).withColumn("gs", F.transform(g.parse_grids(F.col("prompt")), lambda x: x["grid"]))
    return rows.select("p_partkey", g.rerender(F.col("prompt"), F.reverse("gs")).alias("prompt"))


_RERENDERED = f"SELECT p_partkey, 'Task ' || p_name || chr(10) || 'Input ' || {_grid_sql(2)} || 'Output ' || {_grid_sql(1)} || 'End.' AS prompt FROM part".replace("\\n", "' || chr(10) || '")


def _results(spark, sf):
    """lineitem rows as executed pairs of the order's program."""
    return table(spark, sf, "lineitem").selectExpr(
        "lpad(hex(l_orderkey), 8, '0') AS task_id", "l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_linenumber", "l_extendedprice"
    ).withColumn("pair_idx", F.expr("row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1")).selectExpr(
        "l_orderkey", "pair_idx", "CASE WHEN l_partkey % 37 = 0 THEN 'timeout' WHEN l_partkey % 41 = 0 THEN 'error' ELSE 'success' END AS status",
        "CASE WHEN l_partkey % 41 = 0 AND l_partkey % 37 <> 0 THEN 'boom' END AS error", "array(array(CAST(l_partkey % 7 AS int), CAST(l_suppkey % 7 AS int))) AS expected",
        "array(array(CAST(l_partkey % 7 AS int), CASE WHEN l_partkey % 23 = 0 THEN 9 ELSE CAST(l_suppkey % 7 AS int) END)) AS actual")


def verdicts(spark, sf):
    return a.pair_verdict(_results(spark, sf), ["l_orderkey"])


_VERDICTS = """r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i, CASE WHEN l_partkey % 37 = 0 THEN 'timeout: ' WHEN l_partkey % 41 = 0 THEN 'error: boom' WHEN l_partkey % 23 = 0 THEN 'output mismatch' END AS bad FROM lineitem),
v AS (SELECT l_orderkey, count(bad) = 0 AS all_pass, coalesce(min(i) FILTER (bad IS NOT NULL), count(*)) AS n_pass, count(*) AS n_pairs, 'pair ' || min(i) FILTER (bad IS NOT NULL) || ': ' || arg_min(bad, i) FILTER (bad IS NOT NULL) AS fail_reason FROM r GROUP BY 1)"""


def _gate(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey AS task_id", "o_orderpriority AS code")
    held = table(spark, sf, "lineitem").selectExpr("l_orderkey AS task_id")
    return a.heldout_gate_source(rows, held, verdicts(spark, sf).withColumnRenamed("l_orderkey", "task_id"))


def gate(spark, sf):
    kept, rejected, unmatched = _gate(spark, sf)
    cols = lambda df, s: df.select("task_id", F.lit(s).alias("outcome"))
    return cols(kept, "kept").unionByName(cols(rejected, "rejected")).unionByName(cols(unmatched, "unmatched"))


_GATE = f"WITH {_VERDICTS} SELECT o_orderkey AS task_id, CASE WHEN all_pass THEN 'kept' WHEN all_pass IS NULL THEN 'unmatched' ELSE 'rejected' END AS outcome FROM orders LEFT JOIN v ON l_orderkey = o_orderkey"


def _augmented(spark, sf):
    tasks = table(spark, sf, "orders").selectExpr("o_orderkey AS task_id", "CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE 2 END AS n_heldout", "o_orderkey % 10 <> 1 AS base_heldout_pass")
    variants = table(spark, sf, "lineitem").selectExpr("l_orderkey AS task_id", "'geom:' || l_returnflag || '#' || l_linenumber || '-' || l_partkey AS variant", "l_partkey % 9 <> 0 AS train_pass", "l_suppkey % 50 <> 3 AS heldout_pass")
    return a.augment_gate(tasks, variants)


def augment_gate(spark, sf):
    return _augmented(spark, sf)[1].select("task_id", "variant", "status", "heldout_ok")


_AUG = """t AS (SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 6 = 0 THEN 'missing' WHEN o_orderkey % 10 = 1 THEN 'gated_out' ELSE 'ok' END AS task_status FROM orders),
g AS (SELECT task_id, 'geom:' || l_returnflag || '#' || l_linenumber || '-' || l_partkey AS variant, l_returnflag, CASE WHEN task_status <> 'ok' THEN task_status WHEN l_partkey % 9 = 0 THEN 'rejected' WHEN l_suppkey % 50 = 3 THEN 'heldout_mismatch' ELSE 'emitted' END AS status
  FROM lineitem JOIN t ON task_id = l_orderkey)"""


def stats(spark, sf):
    return a.augment_stats(*_augmented(spark, sf))


_STATS = f"""WITH {_AUG} SELECT 'variants' AS measure, status AS name, CAST(count(*) AS DOUBLE) AS value FROM g GROUP BY 2 UNION ALL SELECT 'tasks', task_status, count(*) FROM t GROUP BY 2
UNION ALL SELECT 'emitted', 'geom:' || l_returnflag, count(*) FROM g WHERE status = 'emitted' GROUP BY 2 UNION ALL SELECT 'rejected', 'geom:' || l_returnflag, count(*) FROM g WHERE status = 'rejected' GROUP BY 2
UNION ALL SELECT 'rate', 'rejection_rate', CAST(count(*) FILTER (status = 'rejected') AS DOUBLE) / greatest(1, count(*) FILTER (status IN ('emitted', 'rejected'))) FROM g"""


def _tagged(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey AS task_id", "o_orderpriority AS code", "o_orderkey % 7 <> 0 AS all_pass")
    prov = table(spark, sf, "orders").selectExpr("CASE WHEN o_orderkey % 5 = 0 THEN -1 - o_orderkey ELSE o_orderkey END AS task_id", "CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE o_custkey % 4 END AS rounds_used", "CASE WHEN o_orderkey % 3 = 0 THEN 'other' WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS code")
    return a.provenance_tag(rows, prov)


def tagged(spark, sf):
    return _tagged(spark, sf).select("task_id", "repair_rounds")


def doses(spark, sf):
    return a.dose_response(_tagged(spark, sf))


def tag_counts(spark, sf):
    return a.provenance_summary(_tagged(spark, sf))


_TAGGED = """t AS (SELECT o_orderkey AS task_id, o_orderkey % 7 <> 0 AS ok, CASE WHEN o_orderkey % 5 = 0 OR o_custkey % 9 = 0 THEN 'unknown' WHEN o_orderkey % 3 = 0 OR o_orderkey % 11 = 0 THEN 'superseded' ELSE '' || (o_custkey % 4) END AS repair_rounds FROM orders)"""


def histogram(spark, sf):
    return a.reject_histogram(_gate(spark, sf)[1])


def _holdout(spark, sf):
    return a.stratified_holdout(table(spark, sf, "documents"), "doc_id", "text", K, SEED)


def holdout(spark, sf):
    return _holdout(spark, sf).select("stratum", "task", F.col("size").cast("long").alias("size"))


_HOLDOUT = f"""r AS (SELECT doc_id AS task, length(text) AS size, row_number() OVER (ORDER BY length(text), doc_id) - 1 AS r, count(*) OVER () AS n FROM documents),
s AS (SELECT i AS stratum, task, size, row_number() OVER (PARTITION BY i ORDER BY md5('{SEED}:' || task), task) AS p FROM r JOIN (SELECT unnest(range({K})) AS i) ON r >= i * n // {K} AND r < (i + 1) * n // {K}),
h AS (SELECT stratum, task, size FROM s WHERE p = 1)"""


def _split(spark, sf):
    """Conversations held out by thread, rows are turns."""
    turns = table(spark, sf, "conversations").selectExpr("conv_id", "turn", "text")
    return a.split_by_task(turns, "conv_id", a.stratified_holdout(turns, "conv_id", "text", 10, SEED))


def guards(spark, sf):
    return a.split_guards(_split(spark, sf), "conv_id", F.col("turn") >= 0)


def stats_by_split(spark, sf):
    return a.split_stats(_split(spark, sf), "conv_id", "text")


_SPLIT = f"""c AS (SELECT conv_id AS task, min(length(text)) AS size FROM conversations GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY size, task) - 1 AS r, count(*) OVER () AS n FROM c),
h AS (SELECT task FROM (SELECT task, row_number() OVER (PARTITION BY i ORDER BY md5('{SEED}:' || task)) AS p FROM r JOIN (SELECT unnest(range(10)) AS i) ON r >= i * n // 10 AND r < (i + 1) * n // 10) WHERE p = 1),
x AS (SELECT *, CASE WHEN conv_id IN (SELECT task FROM h) THEN 'val' ELSE 'train' END AS split FROM conversations)"""


def median_tokens(spark, sf):
    return a.length_median(triplets(spark, sf))


def variants_text(spark, sf):
    """Every variant's prompt parses back to its own transformed pairs."""
    rows = a.build_variants(triplets(spark, sf).drop("p_partkey"), 24, SEED)
    again = g.pair_up(F.transform(g.parse_grids(F.col("prompt")), lambda x: x["grid"]))
    return rows.groupBy("task_id").agg(F.count("*").alias("n"), F.bool_and(again == F.col("pairs")).alias("consistent"))


QUERIES = {
    "c1_parse_grids": parsed, "c2_transform_grid": moved, "c3_plan_variants": planned, "c4_wrap_code_text": wrapped,
    "c5_rerender_prompt": rerendered, "c5_variant_texts": variants_text, "c6_pair_verdict": verdicts, "c7_heldout_gate": gate,
    "c8_augment_gate": augment_gate, "c9_provenance_tag": tagged, "c9_provenance_summary": tag_counts, "c10_dose_response": doses,
    "c11_reject_histogram": histogram, "c12_augment_stats": stats, "c12_length_median": median_tokens,
    "c13_stratified_group_split": holdout, "c14_split_guards": guards, "c15_split_stats": stats_by_split,
}

from tallyloom.plans.telemetry import wilson_sql  # noqa: E402

_LOW, _HIGH = wilson_sql("rate", "n")
SQL = {
    "c1_parse_grids": _PARSED, "c2_transform_grid": _MOVED, "c3_plan_variants": _PLANNED, "c4_wrap_code_text": _WRAPPED,
    "c5_rerender_prompt": _RERENDERED,
    "c5_variant_texts": "SELECT lpad(upper(to_hex(p_partkey)), 8, '0') AS task_id, 24::BIGINT AS n, true AS consistent FROM part",
    "c6_pair_verdict": f"WITH {_VERDICTS} SELECT * FROM v", "c7_heldout_gate": _GATE,
    "c8_augment_gate": f"WITH {_AUG} SELECT task_id, variant, status, status = 'emitted' AS heldout_ok FROM g",
    "c9_provenance_tag": f"WITH {_TAGGED} SELECT task_id, repair_rounds FROM t",
    "c9_provenance_summary": f"WITH {_TAGGED} SELECT count(*) FILTER (repair_rounds NOT IN ('unknown', 'superseded')) AS rounds_known, count(*) FILTER (repair_rounds = 'superseded') AS superseded, count(*) FILTER (repair_rounds = 'unknown') AS unknown FROM t",
    "c10_dose_response": f"WITH {_TAGGED}, d AS (SELECT repair_rounds, count(*) FILTER (ok) AS correct, count(*) AS n, CAST(count(*) FILTER (ok) AS DOUBLE) / count(*) AS rate FROM t GROUP BY 1) SELECT *, {_LOW} AS rate_low, {_HIGH} AS rate_high FROM d",
    "c11_reject_histogram": f"WITH {_VERDICTS} SELECT trim(split_part(fail_reason, ':', 2)) AS kind, count(*) AS n FROM v WHERE NOT all_pass AND l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1",
    "c12_augment_stats": _STATS,
    "c12_length_median": "SELECT list(s ORDER BY s)[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median_tokens_est FROM (SELECT CAST(floor((length('Task ' || p_name || 'Input Output End.') + 1 + 2 * 19 + length('import x' || 'def transform(grid):' || '    return grid  # transform ' || p_size) + 4) / 4) AS BIGINT) AS s FROM part)",
    "c13_stratified_group_split": f"WITH {_HOLDOUT} SELECT * FROM h",
    "c14_split_guards": f"WITH {_SPLIT} SELECT count(*) AS rows, count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'val') AS val_rows, count(*) FILTER (split = 'val') AS val_rows_with_heldout, 0::BIGINT AS tasks_on_both_sides, true AS ok FROM x",
    "c15_split_stats": f"""WITH {_SPLIT}, p AS (SELECT 'corpus' AS part, * FROM x UNION ALL SELECT split, * FROM x), q AS (SELECT part, conv_id, count(*) AS n, min(length(text)) AS size FROM p GROUP BY 1, 2)
SELECT part, CAST(sum(n) AS BIGINT) AS rows, count(*) AS tasks, list(size ORDER BY size)[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median_chars FROM q GROUP BY 1""",
}
