"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by the SHA-256 of the normalised text. New rows are
first reduced to one row per digest (partial aggregation, so a digest of a third of all rows is no
task's burden), then joined by a sort-merge anti-join with the index, whose buckets are not shuffled.
Digests the index has not seen are appended as `first` entries; for the others an entry tells how
many copies came and which was the best, so the index is only ever appended to. What stands for a
digest is read by one aggregation over the buckets, again without a shuffle.

Texts are equal when identical after deleting every character of [\\x20\\x09-\\x0D]; null is empty.
Of equal texts the row with the most code points stays, then the smallest doc_id; a null doc_id
comes last. Rows repeated whole share one verdict. Empty tables give empty results. Extra columns
of the documents are not read, so their names cannot clash.
"""

from __future__ import annotations

import zlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import durable

#: A digest of more than one row in so many is joined by broadcast; there are fewer than this many.
HEAVY = 1000

ENTRY = "digest BINARY, first BOOLEAN, keep_id BIGINT, n_chars BIGINT, copies BIGINT, delivery STRING"


def digests(docs: DataFrame) -> DataFrame:
    """`doc_id, digest, n_chars` per row: the normalised text's SHA-256, the text's code points."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"), F.char_length(text).cast("long").alias("n_chars"))


def _digest() -> Column:
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), " \t\n\x0b\x0c\r", "")
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _best(order: str, total) -> list:
    """The preferred row and the number of rows; `~doc_id` turns its order without overflow."""
    return [F.max(F.struct(F.col("n_chars"), F.bitwise_not(order).alias("turned"))).alias("_best"), total.alias("copies")]


_WON = ("digest", "~_best.turned AS keep_id", "_best.n_chars AS n_chars", "copies")


class DigestIndex:
    """An index in a folder all executors reach; it outlives the session.

    `buckets` counts when the folder is new. A bucket should fit a task: about 60 bytes a digest.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder = spark, folder.rstrip("/")
        settings = f"{self.folder}/settings"
        try:
            buckets = spark.read.schema("buckets int").parquet(settings).first().buckets
        except (AnalysisException, AttributeError):  # a new folder, or one whose settings were not finished
            spark.range(1).select(F.lit(buckets).cast("int").alias("buckets")).coalesce(1).write.mode("overwrite").parquet(settings)
        self.buckets = buckets
        self.name = f"digest_index_{zlib.crc32(self.folder.encode()):08x}_{len(self.folder)}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({ENTRY}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.folder}/entries'"
        )

    def entries(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def deliver(self, rows: DataFrame, delivery: str) -> DataFrame:
        """Append a delivery of `digests` rows; return the digests that it was the first to bring.

        A delivery that the index holds already is not counted again, so a job that is run once
        more changes nothing.
        """
        mine = F.col("delivery") == delivery
        if self.entries().where(mine).isEmpty():
            batch = durable(rows.groupBy("digest").agg(*_best("doc_id", F.count("*"))).selectExpr(*_WON), "delivery")
            known = self.entries().where("first").select("digest").hint("merge")
            new = batch.join(known, "digest", "left_anti").withColumn("first", F.lit(True))
            seen = batch.join(known, "digest", "left_semi").withColumn("first", F.lit(False))
            entries = new.unionByName(seen).withColumn("delivery", F.lit(delivery)).select(*self.entries().columns)
            entries.repartition(self.buckets, "digest").write.insertInto(self.name)
        return self.entries().where(mine & F.col("first")).drop("first", "delivery")

    def standing(self) -> DataFrame:
        """`digest, keep_id, n_chars, copies` over all deliveries."""
        return self.entries().groupBy("digest").agg(*_best("keep_id", F.sum("copies"))).selectExpr(*_WON)


def new_documents(docs: DataFrame, index: DigestIndex, delivery: str) -> DataFrame:
    """The rows of `docs` whose text the index had not seen before, one of each; the index learns them.

    All columns stay. Of rows repeated whole, one is taken.
    """
    own = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col("doc_id").cast("long").alias("doc"), _digest().alias("digest"))
    first = index.deliver(digests(docs), delivery).select("digest", F.col("keep_id").alias("doc"))
    mine = packed.join(first, packed.doc.eqNullSafe(first.doc) & (packed.digest == first.digest), "left_semi")
    return mine.dropDuplicates(["digest"]).select(*[F.col("row").getField(c).alias(c) for c in own])


def verdicts(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """Per row of `digests` the document that stands for its text: `doc_id, keep_id, group_size, kept, text_sha256`.

    Digests above a thousandth of all rows, fewer than a thousand, are broadcast; the others meet in
    a sort-merge join in which no key holds more than that share.
    """
    total = rows.count()
    standing = durable(index.standing().select("digest", "keep_id", "copies"), "standing")
    heavy = F.broadcast(standing.where(F.col("copies") * HEAVY > total))
    hot = rows.join(heavy, "digest")
    cold = rows.join(heavy.select("digest"), "digest", "left_anti").join(
        standing.where(F.col("copies") * HEAVY <= total).hint("merge"), "digest"
    )
    return hot.unionByName(cold).select(
        "doc_id", "keep_id", F.col("copies").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
