"""Decontamination against a plain search, over blocks, nulls, empty tables and clashing names."""

import hashlib
import random

from tallyloom.llm.decontaminate import decontaminate, words_of


def brute(text, items, window):
    words = words_of((text or "").encode())
    hit, met = set(), set()
    for item, body in items:
        w = words_of((body or "").encode())
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            for p in range(len(words) - k + 1):
                if words[p:p + k] == w[i:i + k]:
                    hit.update(range(p, p + k))
                    met.add("" if item is None else str(item))
    return len(words), len(hit), sorted(met)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("a b c d É x1 Yy".split())
    items = [(i, " ".join(word() for _ in range(rnd.choice((0, 1, 3, 6, 14))))) for i in range(12)]
    items += [(3, items[5][1]), (None, "zz top"), (40, None)]
    docs = [(i, " ".join(word() for _ in range(rnd.randrange(0, 40)))) for i in range(60)]
    docs += [(100, None), (101, ""), (None, items[5][1]), (1, docs[1][1]), (102, "well; ZZ, top " * 400)]
    return docs, items


def check(spark, docs, items, **settings):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.text, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate(d, b, window=4, **settings).collect()), key=str)
    want = []
    for i, text in docs:
        n, hit, met = brute(text, items, 4)
        want.append((i, text, n, hit, len(met), hashlib.sha256(",".join(met).encode()).hexdigest(), hit > 0))
    assert got == sorted(want, key=str)


def test_against_plain_search(spark):
    check(spark, *corpus(1))


def test_over_many_blocks(spark):
    check(spark, *corpus(2), block_words=24)


def test_empty_tables(spark):
    docs, items = corpus(3)
    check(spark, docs[:3], [])
    check(spark, [], items)


def test_cut_and_clashing_names(spark):
    d = spark.createDataFrame([(1, "one two. Three four five six", 7, "kept"), (2, "other words", 8, "kept")], "doc_id long, text string, n_hit int, spans2 string")
    b = spark.createDataFrame([(1, "two three four five")], "item_id long, text string")
    rows = {r.doc_id: r for r in decontaminate(d, b, window=4).collect()}
    assert rows[1].clean_text == "one  six" and rows[1].n_hit == 4 and rows[1].spans == [[1, 4]] and rows[1].spans2 == "kept"
    assert rows[1].longest_match == 4 and rows[1].rejected and not rows[2].rejected and rows[2].clean_text == "other words"
    assert not decontaminate(d, b, window=4, max_coverage=0.9).where("rejected").count()
