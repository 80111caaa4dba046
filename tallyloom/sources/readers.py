"""Readers: strict JSON lines, format dispatch, paired challenge files, detection sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.session import durable
from tallyloom.sources.listing import list_files

CORRUPT = "_corrupt_record"
GRID = "array<array<int>>"

# Accepted data set suffixes; gz wraps any of the text formats.
FORMATS = {"jsonl": "json", "json": "json", "csv": "csv", "tsv": "csv", "txt": "text", "parquet": "parquet"}

COCO = (
    "images array<struct<id:bigint,file_name:string,width:int,height:int>>,"
    "annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>,area:double,iscrowd:int>>,"
    "categories array<struct<id:bigint,name:string>>"
)


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """Every *.jsonl (or .jsonl.gz) below `path`, one object per line, blank lines skipped.

    A path without such a file fails. With `strict` an unreadable line fails the job; otherwise
    it stays in `_corrupt_record`.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jsonl,jsonl.gz}")
    if strict:
        return reader.schema(fields).option("mode", "FAILFAST").json(path)
    with_corrupt = T.StructType([*fields.fields, T.StructField(CORRUPT, T.StringType())])
    return reader.schema(with_corrupt).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", CORRUPT).json(path)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} holds no rows")
    return df


def suffix_of(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower().removesuffix(".gz")
    return name.rsplit(".", 1)[-1] if "." in name else ""


def read_dataset(spark: SparkSession, path: str, schema: str | T.StructType | None = None, suffix: str | None = None) -> DataFrame:
    """Read by suffix: jsonl, json, csv, tsv, txt, parquet, each of the text ones also gzipped."""
    kind = (suffix or suffix_of(path)).lower()
    if kind == "zip":
        raise ValueError("zip archives cannot be split; unpack them first")
    if kind not in FORMATS:
        raise ValueError(f"unsupported data set format: {kind!r}")
    reader = spark.read if schema is None or kind in ("txt", "parquet") else spark.read.schema(schema)
    if kind in ("csv", "tsv"):
        reader = reader.option("header", True).option("sep", "\t" if kind == "tsv" else ",").option("multiLine", True).option("escape", '"')
    if kind == "json":
        reader = reader.option("multiLine", True)
    return reader.format(FORMATS[kind]).load(path)


def pair_heldout(challenges: DataFrame, solutions: DataFrame, enforce: bool = True) -> DataFrame:
    """(task_id, pos, input, output): test inputs and solutions zipped by position.

    `challenges`: task_id, tests array<grid>; `solutions`: task_id, outputs array<grid>. Tasks
    without a solution are skipped; unequal counts fail, since pairing them would verify
    against the wrong grid.
    """
    both = challenges.join(solutions, "task_id")
    if enforce and not both.where(F.size("tests") != F.size("outputs")).isEmpty():
        raise ValueError("test inputs and solutions differ in number for some task")
    paired = F.arrays_zip(F.col("tests").alias("input"), F.col("outputs").alias("output"))
    return both.select("task_id", F.posexplode(paired).alias("pos", "pair")).select("task_id", "pos", "pair.*")


def heldout_mismatches(challenges: DataFrame, solutions: DataFrame) -> DataFrame:
    return challenges.join(solutions, "task_id").where(F.size("tests") != F.size("outputs")).select(
        "task_id", F.size("tests").alias("n_tests"), F.size("outputs").alias("n_outputs"))


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories) of COCO documents; each file is one shard of the set."""
    return split_coco(spark.read.schema(COCO).option("multiLine", True).json(path))


def split_coco(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    part = lambda name: documents.select(F.explode(name).alias("x")).select("x.*")
    notes = part("annotations").withColumns({
        "area": F.coalesce("area", F.col("bbox")[2] * F.col("bbox")[3]),
        "iscrowd": F.coalesce("iscrowd", F.lit(0)),
    })
    return part("images"), notes, part("categories")


def plain_uri(uri: Column) -> Column:
    """One spelling of local paths: file:///..."""
    return F.regexp_replace(uri, r"^(?:file:)?/+(?=[^/])", "file:///")


def line_count_facts(spark: SparkSession, path: str, claims: DataFrame) -> DataFrame:
    """Facts on claims (uri) about files below `path`: status, bytes, rows of .jsonl files, detail.

    A file is `verified` if it is listed, an empty one too, and `failed` if not; a claim that ends
    with a slash is verified if a file lies below it. What lies in a folder that cannot be listed
    is `unverified`, with the reason; a claim that names no location is `asserted`. Files of any
    size are counted, line by line in parallel.
    """
    listed = durable(list_files(spark, path).withColumn("uri", plain_uri(F.col("uri"))), "listing")
    files = listed.where("error IS NULL").select(F.col("uri").alias("_uri"), "bytes")
    lines = spark.read.option("recursiveFileLookup", True).format("text").load(path).where(F.trim("value") != "")
    rows = lines.select(plain_uri(F.col("_metadata.file_path")).alias("_line")).groupBy("_line").agg(F.count("*").alias("_rows"))
    # every folder above a file, each once
    parts = F.split("_uri", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    folders = files.select(F.explode(above).alias("_folder")).distinct()
    hidden = listed.where("error IS NOT NULL").select(F.col("uri").alias("_hidden"), F.col("error").alias("_error"))

    asked = claims.select("uri").distinct().withColumn("_at", plain_uri(F.col("uri")))
    own = F.split("_at", "/")
    ways = F.transform(F.sequence(F.lit(1), F.size(own)), lambda i: F.concat(F.array_join(F.slice(own, F.lit(1), i), "/"), F.lit("/")))
    lost = asked.select("uri", F.explode(ways).alias("_way")).join(hidden, F.col("_way") == F.col("_hidden")).groupBy(F.col("uri").alias("_lost")).agg(F.min("_error").alias("_error"))
    found = (
        asked.join(files, F.col("_at") == F.col("_uri"), "left").join(rows, F.col("_at") == F.col("_line"), "left")
        .join(folders, F.col("_at") == F.col("_folder"), "left").join(lost, F.col("uri") == F.col("_lost"), "left"))
    there = F.col("_uri").isNotNull() | F.col("_folder").isNotNull()
    located = F.coalesce(F.rlike("_at", F.lit("^[A-Za-z][A-Za-z0-9+.-]*:/")), F.lit(False))
    status = F.when(~located, "asserted").when(there, "verified").when(F.col("_lost").isNotNull(), "unverified").otherwise("failed")
    counted = F.col("_at").endswith(".jsonl") & F.col("_uri").isNotNull()
    detail = F.when(~located, "not checkable").when(F.col("_folder").isNotNull(), "files below").when(~there, F.coalesce("_error", F.lit("not listed")))
    facts = found.select(
        F.col("uri").alias("_claim"), status.alias("status"), "bytes", F.when(counted, F.coalesce("_rows", F.lit(0))).alias("rows"), detail.alias("detail"))
    return claims.join(facts, F.col("uri").eqNullSafe(F.col("_claim"))).select("uri", "status", "bytes", "rows", "detail")
