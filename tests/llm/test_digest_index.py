"""The digest index: whole results, deliveries, reopening and replays."""

import hashlib
import random
import re

from tallyloom.llm import digest_index
from tallyloom.llm.digest_index import DigestIndex, digests, new_documents, verdicts
from tallyloom.llm.queries import op13
from tallyloom.session import fresh_path

DOCS = "doc_id long, text string, digest string, copies long"


def plain(rows):
    groups, out = {}, []
    for doc, text, *_ in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", text or ""), []).append((doc, text or ""))
    for norm, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        out += [(doc, best, len(members), doc == best, hashlib.sha256(norm.encode()).hexdigest()) for doc, _ in members]
    return sorted(out, key=repr)


def made():
    rng = random.Random(2)
    texts = ["a b", "ab", " a\tb\n", "", None, "  ", "ÄÖ 中 文", "ÄÖ 中  文", "x " * 5000, "x" * 5000, "a\x0b\x0cb\r", "a\x1cb"]
    rows = [(i, rng.choice([*texts, f"text {i // 2}"]), "d", 1) for i in range(400)]
    return rows + [(rows[3][0], rows[3][1], "d", 1), (None, "a b", None, None), (None, "only  here", None, None), (-5, "a  b   ", None, None), (-(1 << 63), "lowest", None, None)]


def test_verdicts_are_the_plain_ones(spark, monkeypatch):
    rows, folder = made(), fresh_path(spark, "digests")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    want = plain(rows)
    for heavy in (1000, 1):  # with and without a heavy digest
        monkeypatch.setattr(digest_index, "HEAVY", heavy)
        found = [tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in op13(spark, folder).collect()]
        assert sorted(found, key=repr) == want


def test_deliveries_reopening_and_replay(spark):
    folder = fresh_path(spark, "index")
    docs = spark.createDataFrame(made(), DOCS)
    early, late = docs.where("coalesce(doc_id, 0) % 3 = 0"), docs.where("coalesce(doc_id, 0) % 3 != 0")
    first = new_documents(early, DigestIndex(spark, folder, 3), "monday")
    size = first.count()
    assert first.columns == docs.columns and size == early.select("text").distinct().rdd.map(lambda r: re.sub("[\x20\x09-\x0d]", "", r.text or "")).distinct().count()
    spark.sql(f"DROP TABLE {DigestIndex(spark, folder, 3).name}")  # a later session knows only the folder
    again = DigestIndex(spark, folder, 99)
    assert again.buckets == 3
    fresh = new_documents(late, again, "tuesday").collect()
    known = {re.sub("[\x20\x09-\x0d]", "", r.text or "") for r in early.collect()}
    assert {re.sub("[\x20\x09-\x0d]", "", r.text or "") for r in fresh} == {re.sub("[\x20\x09-\x0d]", "", r.text or "") for r in late.collect()} - known
    before = sorted(map(repr, again.standing().collect()))
    assert len(new_documents(late, again, "tuesday").collect()) == len(fresh)  # the job is run again
    assert sorted(map(repr, again.standing().collect())) == before
    assert sorted((tuple(r) for r in verdicts(digests(docs), again).collect()), key=repr) == plain([tuple(r) for r in docs.collect()])
    assert new_documents(docs.limit(0), again, "nothing").count() == 0


def test_index_side_is_not_shuffled(spark):
    index = DigestIndex(spark, fresh_path(spark, "index"), 4)
    index.deliver(digests(spark.createDataFrame(made(), DOCS)), "one")
    batch = digests(spark.createDataFrame(made()[:50], DOCS)).groupBy("digest").count()
    plan = batch.join(index.entries().where("first").select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    assert "Exchange" not in index.standing()._jdf.queryExecution().executedPlan().toString()
