"""Reader and writer queries: the given tables written out and read back whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import curation
from tallyloom.session import fresh_path, table
from tallyloom.sources import readers, writers
from tallyloom.sources.listing import list_files


def _grid(a: str, b: str) -> str:
    return f"array(array(CAST({a} AS int), CAST({b} AS int)))"


def jsonl(spark, sf):
    path = fresh_path(spark, "jsonl")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    # Spark names its part files .json, so lines are written as text under the wanted suffix.
    lines = rows.select(F.to_json(F.struct("*")).alias("value"))
    _write_lines(lines, path, "jsonl")
    return readers.read_jsonl(spark, path, "conv_id bigint, turn bigint, role string, text string")


def _write_lines(lines, path: str, suffix: str) -> None:
    """Text part files carrying `suffix`, so suffix-driven readers find them."""
    lines.write.text(path)
    spark = lines.sparkSession
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(base):
        name = status.getPath().getName()
        if name.startswith("part-"):
            fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(base, f"{name.rsplit('.', 1)[0]}.{suffix}"))


def datasets(spark, sf):
    """Orders written in every accepted format and read back by suffix."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    schema = "o_orderkey bigint, o_custkey bigint, o_orderpriority string, o_totalprice double"
    out = None
    for kind, write in {
        "csv": lambda w, p: w.option("header", True).csv(p),
        "tsv": lambda w, p: w.option("header", True).option("sep", "\t").csv(p),
        "jsonl": lambda w, p: w.option("compression", "gzip").json(p),
        "parquet": lambda w, p: w.parquet(p),
    }.items():
        path = fresh_path(spark, kind)
        write(rows.write, path)
        got = readers.read_dataset(spark, path, schema, kind).select(F.lit(kind).alias("format"), *rows.columns)
        out = got if out is None else out.unionByName(got)
    text = fresh_path(spark, "txt")
    rows.select(F.col("o_orderkey").cast("string").alias("value")).write.text(text)
    lines = readers.read_dataset(spark, text, suffix="txt").select(
        F.lit("txt").alias("format"), F.col("value").cast("bigint").alias("o_orderkey"),
        F.lit(None).cast("bigint").alias("o_custkey"), F.lit(None).cast("string").alias("o_orderpriority"), F.lit(None).cast("double").alias("o_totalprice"))
    return out.unionByName(lines)


def _challenges(spark, sf):
    rows = table(spark, sf, "part")
    tests = rows.selectExpr("p_partkey AS task_id", f"CASE WHEN p_partkey % 3 = 0 THEN array({_grid('p_size', '1')}) ELSE array({_grid('p_size', '1')}, {_grid('2', 'p_size')}) END AS tests")
    outs = rows.selectExpr("CASE WHEN p_partkey % 10 = 9 THEN -1 - p_partkey ELSE p_partkey END AS task_id", f"CASE WHEN p_partkey % 3 = 0 THEN array({_grid('p_size * 2', '2')}) ELSE array({_grid('p_size * 2', '2')}, {_grid('4', 'p_size')}) END AS outputs")
    return tests, outs


def heldout(spark, sf):
    cell = lambda g, j: F.col(g)[0][j].cast("bigint")
    return readers.pair_heldout(*_challenges(spark, sf)).select(
        "task_id", F.col("pos").cast("bigint").alias("pos"), cell("input", 0).alias("i0"), cell("input", 1).alias("i1"), cell("output", 0).alias("o0"), cell("output", 1).alias("o1"))


def heldout_bad(spark, sf):
    tests, outs = _challenges(spark, sf)
    short = outs.withColumn("outputs", F.when(F.col("task_id") % 4 == 1, F.slice("outputs", 1, 1)).otherwise(F.col("outputs")))
    return readers.heldout_mismatches(tests, short)


def coco(spark, sf):
    """One COCO document per supplier, written as JSON and read back as tables."""
    path = fresh_path(spark, "coco")
    lines = table(spark, sf, "lineitem")
    docs = table(spark, sf, "supplier").selectExpr(
        "s_suppkey", "array(named_struct('id', s_suppkey, 'file_name', s_name, 'width', 640, 'height', 480)) AS images",
        "array(named_struct('id', CAST(s_nationkey AS bigint), 'name', 'n' || s_nationkey)) AS categories")
    boxes = lines.groupBy("l_suppkey", "l_orderkey").agg(F.collect_list(F.expr(
        "named_struct('id', l_partkey, 'image_id', l_suppkey, 'category_id', CAST(l_linenumber AS bigint), 'bbox', array(1D, 2D, l_quantity, 4D), 'area', CASE WHEN l_linenumber = 1 THEN 5D END, 'iscrowd', CASE WHEN l_linenumber = 2 THEN 1 END)")).alias("annotations"))
    # An image's annotations are spread over one shard document per order, like a sharded set.
    shards = boxes.join(docs, boxes.l_suppkey == docs.s_suppkey).select("images", "annotations", "categories")
    shards.write.json(path)
    _, notes, _ = readers.split_coco(spark.read.schema(readers.COCO).json(path))
    return notes.groupBy("image_id", "category_id").agg(
        F.count("*").alias("n"), F.sum(F.col("area").cast("decimal(30,12)")).cast("double").alias("area"), F.sum("iscrowd").alias("crowds"))


def chat(spark, sf):
    path = fresh_path(spark, "chat")
    rows = table(spark, sf, "documents").selectExpr("doc_id", "text AS prompt", "source AS code")
    writers.write_chat_splits(curation.split_by_hash(rows, "doc_id", 7), path)
    back = spark.read.schema("messages array<struct<role:string,content:string>>, split string").json(f"{path}/chat")
    return back.select("split", F.col("messages")[0]["role"].alias("role0"), F.md5(F.col("messages")[0]["content"]).alias("digest"), F.col("messages")[1]["content"].alias("answer"))


def _documents(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS position", "CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'a b/' || o_orderkey END AS id", "CASE WHEN o_orderkey % 5 = 0 THEN '  ' ELSE o_orderpriority END AS priority",
        "array(o_orderstatus, 'x') AS tags", "o_custkey AS customer")
    return writers.render_documents(rows, "position")


def documents(spark, sf):
    return _documents(spark, sf)


def document_problems(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey AS position", "CASE WHEN o_orderkey % 9 <> 0 THEN 'c' || o_custkey END AS id")
    return writers.document_problems(writers.render_documents(rows, "position"))


def _renamed(documents, every: int):
    """The same documents with every n-th one under another name."""
    other = F.col("position") % every == 0
    return documents.withColumn("doc_id", F.when(other, F.concat("doc_id", F.lit("-new"))).otherwise(F.col("doc_id")))


def stale(spark, sf):
    path = fresh_path(spark, "docs")
    writers.write_documents(_documents(spark, sf), path)
    return writers.stale_documents(spark.read.parquet(path), _renamed(_documents(spark, sf), 10))


def ingest(spark, sf):
    everything = _documents(spark, sf)
    return writers.reconcile_ingest(everything, _renamed(everything, 20))


def reports(spark, sf):
    """Run reports written twice, the second time for some runs only, read back per run."""
    path = fresh_path(spark, "reports")
    rows = table(spark, sf, "customer").selectExpr("CASE WHEN c_nationkey = 0 THEN '' ELSE 'n' || c_nationkey END AS run_id", "c_custkey AS generated_at", "c_acctbal AS total")
    problem = writers.write_run_reports(rows, path)
    problem = problem or writers.write_run_reports(rows.where("run_id IN ('n1', 'n2')").withColumn("total", F.lit(1.0)), path)
    back = spark.read.schema("generated_at bigint, total double, run_id string").parquet(f"{path}/runs")
    return back.groupBy("run_id").agg(F.count("*").alias("n"), F.sum(F.col("total").cast("decimal(30,12)")).cast("double").alias("total")).withColumn("alias_problem", F.lit(problem))


def line_counts(spark, sf):
    """Full, empty and absent files, a folder with and one without files, and a claim of no place."""
    path = fresh_path(spark, "lines")
    lines = table(spark, sf, "conversations").select(F.when(F.col("turn") % 4 == 3, "").otherwise(F.to_json(F.struct("conv_id", "turn"))).alias("value"))
    _write_lines(lines.repartition(4), f"{path}/full", "jsonl")
    _write_lines(lines.limit(0).coalesce(1), f"{path}/none", "jsonl")
    files = list_files(spark, path).where("uri LIKE '%.jsonl'").select("uri")
    gone = files.select(F.concat("uri", F.lit(".gone")).alias("uri"))
    others = spark.createDataFrame([(f"{path}/full/",), (f"{path}/nowhere/",), ("kb-1",)], "uri string")
    facts = readers.line_count_facts(spark, path, files.unionByName(gone).unionByName(others))
    return facts.groupBy("status").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"), F.sum((F.col("rows") == 0).cast("long")).alias("n_empty"))


_LINE_DOC = """'customer: ' || o_custkey || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE chr(10) || chr(10) || 'id: a b/' || o_orderkey END || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE chr(10) || chr(10) || 'priority: ' || o_orderpriority END || chr(10) || chr(10) || 'tags: ["' || o_orderstatus || '","x"]'"""
_DOC_ID = "CASE WHEN o_orderkey % 7 = 0 THEN 'row-' || CASE WHEN o_orderkey < 100000 THEN lpad('' || o_orderkey, 5, '0') ELSE '' || o_orderkey END ELSE 'a-b-' || o_orderkey END"
_ORDER_COLS = "o_orderkey, o_custkey, o_orderpriority, o_totalprice"

QUERIES = {
    "a1_read_jsonl": jsonl, "a2_read_dataset": datasets, "a3_load_heldout_pairs": heldout, "a3_heldout_mismatches": heldout_bad, "a4_read_coco": coco,
    "a5_write_chat_splits": chat, "a6_explode_corpus_to_docs": documents, "a6_document_problems": document_problems, "a6_stale_documents": stale,
    "a7_reconcile_ingest": ingest, "a8_write_run_report": reports, "a14_line_count_facts": line_counts,
}

SQL = {
    "a1_read_jsonl": "SELECT conv_id, turn, role, text FROM conversations",
    "a2_read_dataset": " UNION ALL ".join(f"SELECT '{k}' AS format, {_ORDER_COLS} FROM orders" for k in ("csv", "tsv", "jsonl", "parquet")) + " UNION ALL SELECT 'txt', o_orderkey, NULL, NULL, NULL FROM orders",
    "a3_load_heldout_pairs": "SELECT p_partkey AS task_id, 0::BIGINT AS pos, CAST(p_size AS BIGINT) AS i0, 1::BIGINT AS i1, CAST(p_size * 2 AS BIGINT) AS o0, 2::BIGINT AS o1 FROM part WHERE p_partkey % 10 <> 9 UNION ALL SELECT p_partkey, 1, 2, p_size, 4, p_size FROM part WHERE p_partkey % 10 <> 9 AND p_partkey % 3 <> 0",
    "a3_heldout_mismatches": "SELECT p_partkey AS task_id, 2 AS n_tests, 1 AS n_outputs FROM part WHERE p_partkey % 10 <> 9 AND p_partkey % 3 <> 0 AND p_partkey % 4 = 1",
    "a4_read_coco": "SELECT l_suppkey AS image_id, CAST(l_linenumber AS BIGINT) AS category_id, count(*) AS n, CAST(sum(CAST(CASE WHEN l_linenumber = 1 THEN 5 ELSE l_quantity * 4 END AS DECIMAL(38,12))) AS DOUBLE) AS area, CAST(sum(CASE WHEN l_linenumber = 2 THEN 1 ELSE 0 END) AS BIGINT) AS crowds FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier) GROUP BY 1, 2",
    "a5_write_chat_splits": "SELECT CASE WHEN CAST('0x' || substr(md5('7:' || doc_id), 1, 7) AS BIGINT) % 100 < 90 THEN 'train' ELSE 'val' END AS split, 'user' AS role0, md5(text) AS digest, source AS answer FROM documents",
    "a6_explode_corpus_to_docs": f"SELECT {_DOC_ID} AS doc_id, {_LINE_DOC} AS text, o_orderkey AS position FROM orders",
    "a6_document_problems": "SELECT 'duplicate id' AS problem, 'c' || o_custkey AS doc_id FROM orders WHERE o_orderkey % 9 <> 0 GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'empty row', 'row-' || lpad('' || o_orderkey, 5, '0') FROM orders WHERE o_orderkey % 9 = 0",
    "a6_stale_documents": f"SELECT {_DOC_ID} AS doc_id FROM orders WHERE o_orderkey % 10 = 0",
    "a7_reconcile_ingest": "SELECT count(*) AS expected, count(*) AS scanned, count(*) FILTER (o_orderkey % 20 = 0) AS missing, count(*) FILTER (o_orderkey % 20 = 0) AS unexpected, false AS ok FROM orders",
    "a8_write_run_report": "SELECT 'n' || c_nationkey AS run_id, count(*) AS n, CAST(sum(CAST(CASE WHEN c_nationkey IN (1, 2) THEN 1 ELSE c_acctbal END AS DECIMAL(38,12))) AS DOUBLE) AS total, CAST(NULL AS VARCHAR) AS alias_problem FROM customer WHERE c_nationkey <> 0 GROUP BY c_nationkey",
    "a14_line_count_facts": "SELECT 'verified' AS status, 6::BIGINT AS n, count(*) FILTER (turn % 4 <> 3) AS rows, 1::BIGINT AS n_empty FROM conversations UNION ALL SELECT 'failed', 6, NULL, NULL UNION ALL SELECT 'asserted', 1, NULL, NULL",
}
