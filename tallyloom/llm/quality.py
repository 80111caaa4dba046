"""Quality rules: figures of each text, and lines that many documents of a host share.

A line is hashed in its normal form (white space runs as one blank, trimmed, ASCII lower case).
Per host the distinct documents with a line are counted; exact copies of one text count once, so
a copied document does not turn its own lines into boilerplate. A line above
`max(min_docs, share of the host's distinct texts)` is boilerplate. A document is depleted, and
rejected, if taking such lines out leaves it fewer than `min_words` words and at most half of
those it had.

Null texts have no words and fail the base rules; a null host is a host of its own. Repeated rows
are judged alike. Line counts are built from (host, line, text) rows, partly aggregated before
the shuffle, so a hot host is spread over all its lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import body, ddl_of, map_rows, schema_of
from tallyloom.session import durable

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
LINE_SHARE = 0.02
_SLICE_BYTES = 4_000_000
LINE_MIN_DOCS = 20

_SPACE = b" \t\n\x0b\x0c\r"
_TAIL = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"


def normal_line(line: bytes) -> bytes:
    return b" ".join(line.split()).lower()


def line_hash(line: bytes) -> int:
    """Signed 64-bit hash of a normal line."""
    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    grams = list(zip(words, words[1:], words[2:]))
    if len(set(grams)) == len(grams):
        return 0
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(g, len(seen)) for g in grams), np.int64, len(grams))
    often = np.flatnonzero(np.bincount(ids)[ids] > 1)
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[often + shift] = True
    return int(covered.sum())


def figures(text: bytes) -> dict:
    """Base figures and the (hash, words) of each distinct line."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip(_SPACE)]
    per_line: dict[int, int] = {}
    for line in lines:
        key = line_hash(normal_line(line))
        per_line[key] = per_line.get(key, 0) + len(line.split())
    return {
        "n_words": len(words),
        "word_chars": len(text.translate(None, _SPACE + _TAIL)),
        "n_symbols": len(text) - len(text.translate(None, _SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(words),
        "lines": [{"line": k, "words": n} for k, n in per_line.items()],
    }


def document_figures(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per input row: `doc_id, host, text_key`, the base figures and its lines."""

    def make():
        def step(rows):
            return [
                figures(r["_text"]) | {"doc_id": r["_id"], "host": r["_host"], "text_key": r["_key"]}
                for r in rows
            ]

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col(host).cast("string").alias("_host"), body().alias("_text"), text_key().alias("_key"))
    return map_rows(rows, make, (
        "doc_id long, host string, text_key binary, n_words long, word_chars long, n_symbols long,"
        " n_dup_lines long, n_repeat_words long, lines array<struct<line:long,words:long>>"
    ), _SLICE_BYTES)


def boilerplate(found: DataFrame, share: float = LINE_SHARE, min_docs: int = LINE_MIN_DOCS) -> DataFrame:
    """`host, line, n_docs` of the lines above their host's limit."""
    texts = found.groupBy("host", "text_key").agg(F.max(F.lit(1)).alias("one")).groupBy("host").agg(F.count("*").alias("n_texts"))
    lines = (
        found.select("host", "text_key", F.explode("lines.line").alias("line")).distinct()
        .groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > min_docs)
    )
    t = texts.withColumnRenamed("host", "_host")
    return lines.join(t, F.col("host").eqNullSafe(F.col("_host"))).where(
        F.col("n_docs") > F.col("n_texts") * share
    ).select("host", "line", "n_docs")


def judge(
    docs: DataFrame, host: str = "source", min_words: int = MIN_WORDS, share: float = LINE_SHARE,
    min_docs: int = LINE_MIN_DOCS,
) -> DataFrame:
    """Verdicts per input row: `doc_id, host, text_key`, the base figures, `base_failed`,
    `bad_lines` (hashes of its boilerplate lines), `removed_words` and `kept`.

    The figures are written once; lines and documents are then joined without texts.
    """
    found = durable(document_figures(docs, host), "figures")
    bad = boilerplate(found, share, min_docs).select(F.col("host").alias("_host"), F.col("line").alias("_line"))
    rows = found.select("host", "text_key", F.explode("lines").alias("l")).select("host", "text_key", "l.line", "l.words").distinct()
    removed = (
        rows.join(bad, F.col("host").eqNullSafe(F.col("_host")) & (F.col("line") == F.col("_line")), "left_semi")
        .groupBy(F.col("host").alias("_host"), F.col("text_key").alias("_key"))
        .agg(F.sum("words").alias("_removed"), F.collect_set("line").alias("bad_lines"))
    )
    n = F.col("n_words")
    failed = (n < min_words) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)
    left = n - F.col("removed_words")
    return (
        found.drop("lines")
        .join(removed, F.col("host").eqNullSafe(F.col("_host")) & (F.col("text_key") == F.col("_key")), "left")
        .withColumns({"removed_words": F.coalesce("_removed", F.lit(0)).cast("long"), "base_failed": failed})
        .drop("_host", "_key", "_removed")
        .withColumn("kept", ~F.col("base_failed") & ~((left < min_words) & (2 * left <= n)))
    )


def strip_lines(text: bytes, bad: set[int]) -> bytes:
    """The text without its boilerplate lines."""
    return b"\n".join(line for line in text.split(b"\n") if not line.strip(_SPACE) or line_hash(normal_line(line)) not in bad)


def clean_documents(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """The kept rows of `docs` with boilerplate lines taken out of `text`; other columns as they are.

    Every document meets its own few bad lines through one row per (host, text); texts without
    any pass unchanged.
    """
    decided = judge(docs, host, **limits).where("kept").groupBy(F.col("host").alias("_h"), F.col("text_key").alias("_k")).agg(
        F.first("bad_lines").alias("_bad")
    )
    names = docs.columns
    keyed = docs.withColumns({"_q_host": F.col(host).cast("string"), "_q_key": text_key()})
    joined = keyed.join(decided, F.col("_q_host").eqNullSafe(F.col("_h")) & (F.col("_q_key") == F.col("_k")))
    return _strip(joined.select(*names, "_bad"), names)


def text_key() -> Column:
    """The key of a text as the rows of `document_figures` carry it: an expression, as a second
    Python function in the stage that strips lines would double the workers of an executor."""
    return F.unhex(F.md5(body()))


def _strip(df: DataFrame, names: list[str]) -> DataFrame:
    schema = df.select(*names).schema
    fields = schema_of(ddl_of(schema))

    def run(batches):
        for batch in batches:
            texts = []
            for text, bad in zip(batch.column("text").to_pylist(), batch.column("_bad").to_pylist()):
                texts.append(strip_lines(text.encode(), set(bad)).decode() if bad else text)
            new = {"text": pa.array(texts, fields.field("text").type)}
            if "n_chars" in names:
                new["n_chars"] = pa.array([None if t is None else len(t) for t in texts], fields.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([new.get(f.name, batch.column(f.name)).cast(f.type) for f in fields], schema=fields)

    return df.mapInArrow(run, schema)
