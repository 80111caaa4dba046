"""Near-duplicates against all pairs, and components of chains, rings and stars."""

import random

import numpy as np

from tallyloom.llm import near_duplicates as module
from tallyloom.llm.near_duplicates import components, drop_near_duplicates, near_duplicates


def sets_of(text, width):
    w = (text or "").encode().lower().split()
    n = min(width, len(w))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(docs, width, percent=80):
    sets = [(i, sets_of(t, width)) for i, t in docs if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def corpus():
    rnd = random.Random(4)
    base = [[f"w{rnd.randrange(400)}" for _ in range(rnd.choice((5, 30, 60)))] for _ in range(12)]
    docs = []
    for k in range(120):
        words = list(rnd.choice(base))
        for _ in range(rnd.randrange(0, 4)):
            words[rnd.randrange(len(words))] = f"w{rnd.randrange(400)}"
        docs.append((1000 - k, " ".join(words)))
    docs += [(2000, None), (2001, " \n"), (2002, "Solo"), (2003, "solo"), (2004, "a b"), (None, "a b"), (2005, "A  b"), (2005, "q r s")]
    return docs


def test_against_all_pairs(spark):
    docs = corpus()
    rows = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=2).collect()
    want = brute(docs, 2)
    assert len(rows) == len(docs)
    for r in rows:
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id == r.component_id)
    sizes = sorted((r.doc_id or -1, r.n_shingles) for r in rows)
    assert sizes == sorted((i or -1, len(sets_of(t, 2))) for i, t in docs)


def test_one_row_per_group(spark):
    docs = [(5, "a b c d e f", "s", "x"), (3, "A b c d e f", "s", "y"), (9, "z z z", "t", "z"), (9, "q", "t", "q"), (7, None, "t", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, rep string")
    left = drop_near_duplicates(d)
    assert left.columns == d.columns
    assert sorted((r.doc_id, r.text or "") for r in left.collect()) == [(3, "A b c d e f"), (7, ""), (9, "q")]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 12)] + [(20, 22), (22, 21), (21, 20), (40, 30), (41, 30), (41, 42)]
    found = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 1 for i in range(2, 13)}, 21: 20, 22: 20, 40: 30, 41: 30, 42: 30}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_no_set_pair_at_the_threshold_is_ruled_out_by_the_parity_bound():
    draw = np.random.default_rng(5)
    for size in (1, 4, 9, 90, 900, 9000):
        shared = draw.integers(0, 1 << 63, size, dtype=np.uint64)
        for extra in {0, size // 8, size // 4}:
            a = np.unique(shared)
            b = np.unique(np.concatenate([shared, draw.integers(0, 1 << 63, extra, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            x, y = module.parities([a, b])
            odd = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
            assert odd <= len(a) + len(b) - 2 * both
            if 100 * both >= 80 * (len(a) + len(b) - both):
                assert 180 * odd <= 20 * (len(a) + len(b))


def test_texts_without_a_candidate_do_not_travel(spark, monkeypatch):
    ids = spark.range(20_000)
    texts = ids.select(module.F.col("id").alias("_doc"), module.F.lit(b"a b").alias("text")).unionByName(
        spark.createDataFrame([(None, b"n"), (40, b"again")], "_doc long, text binary"))
    named = ids.where("id % 10 = 0").select(module.F.col("id").alias("_id"))
    left = module._likely(texts, named)
    assert left.columns == ["_doc", "text"]
    found = [r._doc for r in left.collect()]
    assert {i for i in found if i is not None} >= set(range(0, 20_000, 10)) and found.count(40) == 2
    assert len(found) < 2_100
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(_doc" not in plan
    assert module._likely(texts, named.limit(0)).count() == 0
    # a bitmap that lets all pass changes no result
    monkeypatch.setattr(module, "FILTER_BITS", 64)
    assert module._likely(texts, named).count() == 20_002
    docs = [(1, "a b c d e f"), (2, "a b c d e f g"), (3, "x y z"), (4, None)]
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    links = module._confirm(spark.createDataFrame(docs, "doc_id long, text string"), pairs, 2, 80)
    assert [tuple(r) for r in links.collect()] == [(1, 2)]
