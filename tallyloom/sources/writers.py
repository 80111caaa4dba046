"""Writers: chat splits, retrieval documents, run reports, and the checks around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.text import trim


def chat_rows(rows: DataFrame, prompt: str = "prompt", code: str = "code") -> Column:
    turn = lambda role, col: F.struct(F.lit(role).alias("role"), F.col(col).alias("content"))
    return F.array(turn("user", prompt), turn("assistant", code))


def write_chat_splits(split: DataFrame, path: str, prompt: str = "prompt", code: str = "code") -> None:
    """Both sides as chat messages (JSON) and as raw rows (Parquet), partitioned by split."""
    split.select("split", chat_rows(split, prompt, code).alias("messages")).write.mode("overwrite").partitionBy(
        "split").json(f"{path}/chat")
    split.write.mode("overwrite").partitionBy("split").parquet(f"{path}/raw")


def render_documents(rows: DataFrame, order: str, id_column: str = "id") -> DataFrame:
    """(doc_id, text, position): one document per row, keys sorted, empty values left out.

    Nested values become JSON. A row without an id is named by its position; characters unsafe
    in a name become dashes.
    """
    keys = sorted(c for c in rows.columns if c != order)
    simple = dict(rows.dtypes)
    value = lambda c: F.to_json(c) if simple[c].startswith(("array", "struct", "map")) else F.col(c).cast("string")
    parts = [F.when(trim(value(c)) != "", F.concat(F.lit(f"{c}: "), trim(value(c)))) for c in keys]
    given = trim(F.col(id_column).cast("string")) if id_column in rows.columns else F.lit(None).cast("string")
    name = F.when(F.coalesce(given, F.lit("")) != "", given).otherwise(
        F.format_string("row-%05d", F.col(order).cast("long")))
    return rows.select(
        F.regexp_replace(name, r"[^\p{L}\p{N}_.\-]", "-").alias("doc_id"),
        F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), "\n\n").alias("text"),
        F.col(order).alias("position"))


def document_problems(documents: DataFrame) -> DataFrame:
    """(problem, doc_id): rows that render to nothing, and names two rows share."""
    empty = documents.where("text = ''").select(F.lit("empty row").alias("problem"), "doc_id")
    twice = documents.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select(
        F.lit("duplicate id").alias("problem"), "doc_id")
    return empty.unionByName(twice)


def write_documents(documents: DataFrame, path: str) -> None:
    """Refuse an empty set or one with problems; otherwise replace what the path held."""
    if documents.isEmpty():
        raise ValueError("no document to write; the index would be empty")
    if not document_problems(documents).isEmpty():
        raise ValueError("some rows render to nothing or share a document id")
    documents.select("doc_id", "text").write.mode("overwrite").parquet(path)


def stale_documents(existing: DataFrame, documents: DataFrame) -> DataFrame:
    return existing.select("doc_id").join(documents.select("doc_id"), "doc_id", "left_anti")


def reconcile_ingest(expected: DataFrame, loaded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts on both sides, what is missing or unexpected, and whether the ingest stands."""
    e, l = expected.select(key).withColumn("_e", F.lit(1)), loaded.select(key).withColumn("_l", F.lit(1))
    both = e.join(l, key, "full_outer")
    counts = both.agg(
        F.count("_e").alias("expected"), F.count("_l").alias("scanned"),
        F.count(F.when(F.col("_l").isNull(), 1)).alias("missing"), F.count(F.when(F.col("_e").isNull(), 1)).alias("unexpected"))
    return counts.withColumn("ok", (F.col("missing") == 0) & (F.col("unexpected") == 0) & (F.col("expected") == F.col("scanned")))


def require_ingest(reconciled: DataFrame) -> None:
    row = reconciled.first()
    if not row.ok:
        raise ValueError(f"ingest refused: {row.asDict()}")


def write_run_reports(reports: DataFrame, path: str) -> str | None:
    """The durable copy per run, then the latest alias; returns why the alias failed, if it did.

    Reports without a run id go to the alias only.
    """
    from tallyloom.operators.runs import latest_report

    named = reports.where(F.coalesce("run_id", F.lit("")) != "")
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}/runs")
    try:
        latest_report(reports).write.mode("overwrite").parquet(f"{path}/latest")
    except Exception as failure:  # the durable copy stands without its alias
        return str(failure)
    return None
