"""The Merkle manifest and its proofs against a plain tree."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import merkle
from tallyloom.llm.queries import op12
from tallyloom.session import fresh_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    doc, _, lang, source, n = row
    return sha(said(doc), said(source), said(lang), said(n), said(text))


def tree(digests):
    """(root, per leaf its (left, right) siblings by level)."""
    ways, level, at = [[] for _ in digests], list(digests), list(range(len(digests)))
    while len(level) > 1:
        for i, p in enumerate(at):
            first = p // 8 * 8
            ways[i].append(("".join(level[first:p]), "".join(level[p + 1:first + 8])))
        level = [sha(*level[i:i + 8]) for i in range(0, len(level), 8)]
        at = [p // 8 for p in at]
    return level[0], ways


def plain(rows):
    keyed = sorted(rows, key=lambda r: (r[2] is not None, (r[2] or "").encode(), r[0] is not None, r[0] or 0, leaf(r, r[1])))
    langs, by = [], {}
    for row in keyed:
        if row[2] not in by:
            langs.append(row[2])
        by.setdefault(row[2], []).append(row)
    trees = [tree([leaf(r, r[1]) for r in by[lang]]) for lang in langs]
    root, above = tree([t[0] for t in trees])
    out = []
    for lang, (sub, ways), up in zip(langs, trees, above):
        for row, way in zip(by[lang], ways):
            way = way + up
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            low = row[1] and row[1].translate({c: c + 32 for c in range(65, 91)})
            node = leaf(row, low if hit else row[1])
            for left, right in way:
                node = sha(left, node, right)
            out.append((row[0], leaf(row, row[1]), sub, root, sha(*[s for step in way for s in step]), node, node == root))
    return sorted(out, key=repr)


def made(n, seed):
    rng = random.Random(seed)
    langs = ["en"] * 12 + ["de", "fr", None, "", "zz", "é", "=", "^"]
    rows = [(i, rng.choice(["Some Text", "lower", "ÄÖ Ünï", "", None, "x" * 3000]), rng.choice(langs), rng.choice(["s", None]), rng.choice([1, None])) for i in range(n)]
    return rows + [(3, "again", "en", None, None)] * 3 + [(None, "No Id", "en", "s", 1), (n, "Only One", "lone", "s", 1)]


@pytest.mark.parametrize("n, few", [(700, 4096), (700, 0), (5, 4096)])
def test_proofs_of_a_plain_tree(spark, n, few, monkeypatch):
    monkeypatch.setattr(merkle, "FEW", few)
    monkeypatch.setattr(merkle.links, "__defaults__", (few,))
    monkeypatch.setattr(merkle.proofs, "__defaults__", (few,))
    rows = made(n, n)
    folder = fresh_path(spark, "merkle")
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS pos", "'x' AS tree", "2 AS digest", "3 AS id")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    found = sorted((tuple(r[c] for c in columns) for r in op12(spark, folder).collect()), key=repr)
    assert found == plain(rows)


@pytest.mark.parametrize("rows", [[(7, "One", "en", "s", 1)], [(i, "T", "en", "s", 1) for i in range(9)], [(i, "T", f"l{i:02}", "s", 1) for i in range(70)]])
def test_single_leaf_single_tree_and_many_trees(spark, rows):
    folder = fresh_path(spark, "merkle")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted((tuple(r[c] for c in columns) for r in op12(spark, folder).collect()), key=repr) == plain(rows)


def test_no_rows(spark):
    manifest = merkle.build(spark.createDataFrame([], DOCS))
    assert manifest.root is None and merkle.proofs(manifest).count() == 0


def test_a_changed_row_changes_the_root(spark):
    docs = spark.createDataFrame(made(40, 1), DOCS)
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 17, "other").otherwise(F.col("text")))
    assert merkle.build(docs).root == merkle.build(docs.repartition(5)).root != merkle.build(changed).root
