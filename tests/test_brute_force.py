"""Distributed algorithms against plain loops on small random fixtures, hot keys included."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import curation, detection, ordering, retrieval, similarity


def grams(text):
    w = text.lower().split()
    return {tuple(w[i:i + 3]) for i in range(len(w) - 2)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def corpus(seed, n=90):
    """A third near copies of one text, common boilerplate everywhere, the rest random."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    boiler, template = "all rights reserved by the owner of this text", [rng.choice(words) for _ in range(40)]
    out = []
    for i in range(n):
        if i % 3 == 0:
            body = list(template)
            for _ in range(rng.randrange(4)):
                body[rng.randrange(len(body))] = rng.choice(words)
        else:
            body = [rng.choice(words[:12]) for _ in range(rng.randrange(2, 30))]
        out.append((i, " ".join(body) + (" " + boiler if i % 2 else "")))
    return out


@pytest.mark.parametrize("threshold,hot", [(0.5, 1), (0.8, 1), (0.8, 1000)])
def test_nearly_repeated(spark, threshold, hot):
    rows = corpus(3)
    sets = {i: grams(t) for i, t in rows}
    want = {i for i in sets if any(j < i and sets[i] and jaccard(sets[i], sets[j]) >= threshold for j in sets)}
    df = spark.createDataFrame(rows, "id int, text string")
    got = similarity.nearly_repeated(similarity.shingle_sets(df, "id", "text"), threshold, hot=hot)
    assert {r.id for r in got.collect()} == want


def test_contamination_and_best_similarity(spark):
    train, held = corpus(5), [(i, t) for i, t in corpus(5, 30)][:6] + [(100 + i, t) for i, t in corpus(9, 12)]
    sets, items = {i: grams(t) for i, t in train}, {i: grams(t) for i, t in held}
    df = spark.createDataFrame(train, "id int, text string")
    layers = {"x": spark.createDataFrame(held, "id int, text string"), "none": spark.createDataFrame([], "id int, text string")}
    clean, stats = curation.decontaminate(df, "id", "text", layers, "id", "text", 0.6)
    bad = {i for i in sets if any(jaccard(sets[i], b) >= 0.6 for b in items.values())}
    assert {r.id for r in clean.collect()} == set(sets) - bad
    by = {r.layer: r for r in stats.collect()}
    left = max((jaccard(sets[i], b) for i in set(sets) - bad for b in items.values()), default=0.0)
    assert by["x"].dropped == len(bad) and by["x"].max_jaccard_left == pytest.approx(left) and by["none"].dropped == 0


def test_lexical_topk(spark):
    docs, queries = corpus(11), [(i, t) for i, t in corpus(12, 9)] + [(50, corpus(11)[4][1])]
    sets = {i: grams(t) for i, t in docs}
    got = retrieval.lexical_topk(spark.createDataFrame(queries, "q int, text string"), "q", "text", spark.createDataFrame(docs, "id int, text string"), "id", "text", 4)
    have = {}
    for r in got.collect():
        have.setdefault(r.query_id, []).append((r["rank"], r.id))
    for q, t in queries:
        ranked = sorted((-jaccard(grams(t), s), i) for i, s in sets.items() if grams(t) & s)[:4]
        assert [i for _, i in sorted(have.get(q, []))] == [i for _, i in ranked]


@pytest.mark.parametrize("lists", [1, 3, 64])
def test_top_similar_with_short_and_long_lists(spark, lists):
    """Copies, shared sentences and ties, whatever counts as a long list."""
    docs = corpus(21, 120) + [(500 + i, t) for i, t in corpus(21, 40)] + [(700, "all rights reserved by the owner of this text")]
    queries = [(i, t) for i, t in corpus(22, 12)] + [(90, corpus(21)[0][1]), (91, "all rights reserved by the owner"), (92, "nothing like it"), (93, "")]
    sets = {i: grams(t) for i, t in docs}
    make = lambda rows: similarity.shingle_sets(spark.createDataFrame(rows, "id int, text string"), "id", "text")
    got = {}
    for r in similarity.top_similar(make(queries), make(docs), 6, lists).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.jaccard))
    for q, t in queries:
        want = sorted((-jaccard(grams(t), s), i) for i, s in sets.items() if grams(t) & s)[:6]
        assert [(i, j) for _, i, j in sorted(got.get(q, []))] == [(i, -j) for j, i in want]
    best = similarity.best_similarity(make(docs), make(queries).selectExpr("*", "id % 3 AS layer"), "layer", lists).collect()
    for r in best:
        assert r.max_jaccard == max((jaccard(grams(t), s) for q, t in queries if q % 3 == r.layer for s in sets.values()), default=0.0)


def test_a_shared_sentence_does_not_pair_all(spark):
    """100 queries and 1,200 documents that share a sentence: 120,000 pairs share tokens, few are scored."""
    rng = random.Random(5)
    sentence = "this document was provided by the committee for public use only"
    made = lambda first, n: [(first + i, " ".join(str(rng.randrange(3000)) for _ in range(rng.randrange(5, 60))) + " " + sentence) for i in range(n)]
    docs, queries = made(0, 1200), made(5000, 100)
    make = lambda rows: similarity.shingle_sets(spark.createDataFrame(rows, "id int, text string"), "id", "text")
    found = similarity.search(make(queries), make(docs), 5)
    assert found.pairs.count() + found.combined.count() < 12_000
    sets, got = {i: grams(t) for i, t in docs}, {}
    for r in found.rows.collect():
        got.setdefault(r.group, set()).add((r.id, r.jaccard))
    for q, t in queries[:30]:
        want = sorted((-jaccard(grams(t), s), i) for i, s in sets.items())[:5]
        assert got[q] == {(i, -j) for j, i in want}


def test_boilerplate_gives_no_candidates(spark):
    """Sets that share 1,000 frequent shingles and little else are not compared."""
    rng = random.Random(6)
    boiler = " ".join(f"b{i}" for i in range(1002))
    rows = []
    for i in range(60):
        own = " ".join(f"w{rng.randrange(10**6)}" for _ in range(500))
        rows.append((i, f"{own} {boiler}"))
    for i in range(20):  # true pairs: a word of the own text is another
        words = rows[i][1].split(" ")
        words[rng.randrange(400)] = "other"
        rows.append((100 + i, " ".join(words)))
    sets = similarity.shingle_sets(spark.createDataFrame(rows, "id int, text string"), "id", "text")
    order = similarity.ranked(sets, similarity.frequencies(sets))
    pairs = similarity.candidates(order, order, 0.8).where("id_l < id_r")
    assert 20 <= pairs.count() <= 40
    assert {r.id for r in similarity.nearly_repeated(sets, 0.8).collect()} == {100 + i for i in range(20)}


def test_vector_topk_in_blocks(spark):
    rng = np.random.RandomState(1)
    base, asks = rng.randn(70, 8), rng.randn(25, 8)
    df = lambda m, k: spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{k} int, embedding array<double>")
    got = retrieval.vector_topk(df(asks, "query_id"), df(base, "id"), 3, block=10).collect()
    have = {(r.query_id, r["rank"]): r.id for r in got}
    for q in range(25):
        assert [have[(q, k)] for k in (1, 2, 3)] == list(np.argsort(-(base @ asks[q]), kind="stable")[:3])


def greedy(dets, gts, thr):
    """One image and category, detections in score order."""
    def iou(a, b):
        w = max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
        h = max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
        return w * h / (a[2] * a[3] + b[2] * b[3] - w * h)

    taken, out = set(), set()
    for d in sorted(dets, key=lambda d: (-d[1], d[0])):
        best, best_iou = None, thr
        for t in gts:
            if t[0] not in taken and iou(d[2], t[1]) >= best_iou:
                best, best_iou = t[0], iou(d[2], t[1])
        if best is not None:
            taken.add(best)
            out.add((d[0], best))
    return out


def test_greedy_match_is_the_sequential_result(spark):
    rng = random.Random(2)
    box = lambda: [float(rng.randrange(30)), float(rng.randrange(30)), float(rng.randrange(8, 30)), float(rng.randrange(8, 30))]
    dets = [(i, rng.choice([0.9, 0.8, 0.7, 0.6, 0.5]), box()) for i in range(60)]
    gts = [(i, box()) for i in range(40)]
    d = spark.createDataFrame([(1, 1, i, i, s, b) for i, s, b in dets], "image_id int, category_id int, det_id int, ord int, score double, bbox array<double>")
    t = spark.createDataFrame([(1, 1, i, i, b) for i, b in gts], "image_id int, category_id int, gt_id int, ord int, bbox array<double>")
    got = detection.greedy_match(d, t, (0.3, 0.5)).collect()
    for thr in (0.3, 0.5):
        assert {(r.det_id, r.gt_id) for r in got if r.thr == thr} == greedy(dets, gts, thr)


def test_chunked_windows(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", i, rng.choice([None, i]), rng.randrange(10)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t int, v int, m int")
    chunk = F.floor(F.col("t") / 7)
    got = ordering.carry_forward(df, ["k"], ["t"], chunk, {"known": "v"})
    got = ordering.previous_row(got, ["k"], ["t"], chunk, {"before": "m"})
    got = ordering.running_total(got, ["k"], ["t"], {"total": F.col("m")}, chunk).collect()
    known, before, total = {}, {}, {}
    have = {r.t: r for r in got}
    for k, t, v, m in rows:
        known[k] = v if v is not None else known.get(k)
        total[k] = total.get(k, 0) + m
        assert (have[t].known, have[t].before, have[t].total) == (known[k], before.get(k), total[k])
        before[k] = m


def test_as_of_and_global_rank(spark):
    rng = random.Random(6)
    left = [("a", i, rng.randrange(1, 28)) for i in range(50)]
    right = [("a", float(d), d) for d in range(3, 28, 5)]
    l = spark.createDataFrame(left, "k string, i int, d int").withColumn("at", F.expr("make_date(2024, 1, d)").cast("timestamp"))
    r = spark.createDataFrame(right, "k string, p double, d int").withColumn("since", F.expr("make_date(2024, 1, d)").cast("timestamp")).drop("d")
    got = {x.i: x.p for x in ordering.as_of(l, r, ["k"], "at", "since", ["p"], chunk_days=2).collect()}
    assert got == {i: max((float(d) for _, _, d in right if d <= day), default=None) for _, i, day in left}
    ranked = ordering.rank_overall(l.select("i", "d"), ["d", "i"], "rank").collect()
    assert {r.i: r["rank"] for r in ranked} == {i: n for n, (_, i) in enumerate(sorted((d, i) for _, i, d in left), 1)}


def plain_iou(a, b):
    side = lambda i: max(0.0, min(a[i] + a[i + 2], b[i] + b[i + 2]) - max(a[i], b[i]))
    inter = side(0) * side(1)
    union = a[2] * a[3] + b[2] * b[3] - inter
    return inter / union if union > 0 else 0.0


@pytest.mark.parametrize("floor", [0.0, 0.05, 0.5, 1.0])
def test_box_iou_of_all_sizes(spark, floor):
    rng = random.Random(8)
    made = lambda: [rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice([0.0, 1e-4, 0.5, 1.0, 2.0, 8.0, 33.0, 700.0, 3e5]) * rng.choice([1, rng.random()]), rng.choice([0.3, 4.0, 16.0, 100.0, 3e5])]
    d = [(i, rng.randrange(3), 1, made()) for i in range(90)]
    t = [(i, rng.randrange(3), 1, made() if i % 2 else d[i][3]) for i in range(60)]
    schema = "image_id long, category_id long, bbox array<double>"
    got = detection.box_iou(spark.createDataFrame(d, f"det_id long, {schema}"), spark.createDataFrame(t, f"gt_id long, {schema}"), floor).collect()
    want = {(a[0], b[0]): plain_iou(a[3], b[3]) for a in d for b in t if a[1] == b[1] and plain_iou(a[3], b[3]) > 0 and plain_iou(a[3], b[3]) >= floor}
    assert len(got) == len(want) and {(r.det_id, r.gt_id): pytest.approx(r.iou) for r in got} == want


def test_a_large_box_covers_four_cells(spark):
    boxes = spark.createDataFrame([([12.0, 7.0, 3e5, 2e5],), ([0.0, 0.0, 64.0, 64.0],), ([5.0, 5.0, 0.0, 0.0],)], "b array<double>")
    assert all(r.n <= 4 for r in boxes.withColumn("level", detection._level("b")).select(F.size(detection._cells("b", "level")).alias("n")).collect())


def test_bootstrap_weights_add_up_and_repeat(spark):
    gts = spark.createDataFrame([(i, i % 23, 1) for i in range(60)], "gt_id long, image_id long, category_id long")
    rows = detection.bootstrap_weights(gts, 17, 5)
    sums = {r.b: r.w for r in rows.groupBy("b").agg(F.sum("weight").alias("w")).collect()}
    assert sums == {b: 23 for b in range(17)}
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, detection.bootstrap_weights(gts.repartition(7), 17, 5).collect()))
    assert detection.bootstrap_weights(gts.limit(0), 17, 5).count() == 0


def test_longest_common_subsequence():
    from tallyloom.operators.judging import common_length

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            diagonal = 0
            for j, y in enumerate(b, 1):
                diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randrange(rng.choice([2, 5, 50])) for _ in range(rng.randrange(0, 150))] for _ in range(2))
        assert common_length(a, b) == plain(a, b)
    long = [rng.randrange(500) for _ in range(20_000)]
    import time

    start = time.perf_counter()
    assert common_length(long, long[::2]) == 10_000
    other = [rng.randrange(500) for _ in range(20_000)]
    common_length(long, other)
    assert time.perf_counter() - start < 2


def test_variants_are_drawn_again(spark):
    from tallyloom.operators import augmentation

    tasks = spark.createDataFrame([(f"t{i}",) for i in range(40)], "task string")
    for top, perms in ((3, {"perm9": 5, "perm10": 18}), (2, {"perm9": 1, "perm10": 4})):
        plan = augmentation.plan_variants(tasks, "task", 24, 3, top).collect()
        for i in range(40):
            sigs = [r.sig for r in plan if r.task == f"t{i}"]
            assert len(sigs) == len(set(sigs))
            # two draws of a kind without geometry, two of perm9 with each: new ones while there are any
            kinds = [r.sig for r in plan if r.task == f"t{i}" and r.geom is None]
            assert len(kinds) == min(2, perms["perm9"]) + min(2, perms["perm10"])
    again = augmentation.plan_variants(tasks, "task", 24, 3, 2).collect()
    assert again == augmentation.plan_variants(tasks.repartition(5), "task", 24, 3, 2).orderBy("task", "slot").collect() or sorted(again) == sorted(augmentation.plan_variants(tasks.repartition(5), "task", 24, 3, 2).collect())


def test_nearest_rows_in_slices_with_ties(monkeypatch):
    rng = np.random.RandomState(3)
    base, asks = rng.randint(-2, 3, (900, 4)).astype("f8"), rng.randint(-2, 3, (41, 4)).astype("f8")
    monkeypatch.setattr(retrieval, "CELLS", 350)
    monkeypatch.setattr(retrieval, "FIRST", 8)
    for k, rows in ((1, 900), (5, 900), (5, 3), (9, 8)):
        got, scores = retrieval.nearest_rows(asks, base[:rows], k, block=7)
        want = np.argsort(-(asks @ base[:rows].T), axis=1, kind="stable")[:, :k]
        assert (got == want).all() and (scores == np.take_along_axis(asks @ base[:rows].T, want, axis=1)).all()


def test_vector_topk_moves_a_vector_no_oftener_for_smaller_blocks(spark):
    rows = [(i, [float(i % 7), 1.0]) for i in range(600)]
    side = lambda k: spark.createDataFrame(rows, f"{k} int, embedding array<float>")
    grid = int(np.ceil(np.sqrt(2 * spark.sparkContext.defaultParallelism)))
    plan = retrieval.vector_topk(side("query_id"), side("id"), 3, block=2)._jdf.queryExecution().toString()
    copies = [int(n) + 1 for n in re.findall(r"explode\(sequence\(cast\(0 as bigint\), cast\((\d+) as bigint\)", plan)]
    assert copies and max(copies) <= grid


def test_crowds_and_small_groups_overlap_alike(spark, monkeypatch):
    """A crowd beside small groups: cells for the one, direct pairs for the others, the same rows as either way alone."""
    rng = random.Random(8)
    box = lambda: [rng.uniform(0, 30), rng.uniform(0, 30), rng.choice([0.0, 1.0, 5.0, 20.0]) + rng.random(), rng.uniform(0.5, 25)]
    made = lambda n: [(i, 0 if i % 2 else i % 9, i % 2, box(), i % 5 / 5, i) for i in range(n)] + [(None, 0, 1, [0.0, 0.0, 9.0, 9.0], 0.9, 999)]
    dets = spark.createDataFrame(made(90), "det_id int, image_id int, category_id int, bbox array<double>, score double, ord int")
    gts = spark.createDataFrame(made(80), "gt_id int, image_id int, category_id int, bbox array<double>, score double, ord int").drop("score")
    results, matches = [], []
    for crowd in (0, 10, 1000):
        monkeypatch.setattr(detection, "CROWD", crowd)
        plan = detection.box_iou(dets, gts)
        assert ("sequence" in plan._jdf.queryExecution().toString()) == (crowd < 1000)  # no copies into cells without a crowd
        results.append(sorted(map(str, plan.collect())) + sorted(map(str, detection.box_iou(dets, gts, 0.3).collect())))
        matches.append(sorted(map(tuple, detection.greedy_match(dets, gts, (0.3, 0.5)).collect())))
    assert len(results[0]) > 100 and results[0] == results[1] == results[2]
    assert matches[0] and matches[0] == matches[1] == matches[2]


def test_candidates_do_not_move_the_sets(spark):
    """Sets lie in buckets of their key: checking pairs moves the pairs, not every set of the table."""
    df = spark.createDataFrame(corpus(31), "id int, text string")
    sets = curation.shingle_table(df, "id", "text")
    asked = sets.select(F.col("id").alias("id_l"), (F.col("id") - 3).alias("id_r")).sample(1.0)
    held = [spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")]
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = similarity.verify(asked, sets, sets, 0.8)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held[0])
        spark.conf.set("spark.sql.adaptive.enabled", held[1])
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange hashpartitioning") <= 1


@pytest.mark.parametrize("hot", [1, 4, 1000])
def test_nearly_repeated_whatever_the_sample_calls_common(spark, monkeypatch, hot):
    """Copies with edits, shared sentences, sets of few shingles; no, some or all tokens are common."""
    rng = random.Random(8)
    rows = corpus(17, 90) + [(200 + i, " ".join(rng.choice("ab") for _ in range(rng.randrange(3, 8)))) for i in range(30)]
    base = [f"v{i}" for i in range(80)]
    for i in range(40):
        words = list(base)
        words[rng.randrange(80)] = f"x{i}"
        rows.append((300 + i, " ".join(words)))
    sets = {i: grams(t) for i, t in rows}
    df = spark.createDataFrame(rows, "id int, text string")
    made = similarity.shingle_sets(df, "id", "text").localCheckpoint()
    for threshold, least in ((0.5, 1), (0.9, 3), (0.9, 10**9)):
        monkeypatch.setattr(similarity.common_tokens, "__defaults__", (similarity.SAMPLE, least, similarity.COMMON))
        want = {i for i in sets if any(j < i and sets[i] and jaccard(sets[i], sets[j]) >= threshold for j in sets)}
        assert {r.id for r in similarity.nearly_repeated(made, threshold, hot=hot).collect()} == want
