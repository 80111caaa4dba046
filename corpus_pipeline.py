"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of `documents`. Empty tables pass through every stage. Null texts fail the quality rules.

Each stage bounds the bytes of a batch that goes to a Python worker, as a batch lies in the memory
of both processes.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import decontaminate, mixing, near_duplicates, quality, token_files
from tallyloom.session import durable, fresh_path, table


BATCH_BYTES = "4m"


def _bounded(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their boilerplate lines."""
    _bounded(spark)
    return quality.clean_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8."""
    _bounded(spark)
    return near_duplicates.drop_near_duplicates(docs, width=5, threshold=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    _bounded(spark)
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), max_coverage=0.0)
    return found.where("not rejected").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them."""
    _bounded(spark)
    return mixing.emit(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens, ids_crc32."""
    _bounded(spark)
    folder = fresh_path(spark, "tokens")
    token_files.write_token_files(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, folder)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mix_sources),
    ("token_output", token_output),
]

#: Tokens of a byte-pair vocabulary are not expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = durable(docs, name)
    return docs
