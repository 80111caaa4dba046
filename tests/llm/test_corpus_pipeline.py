"""The chained stages against plain Python, and the operators that have SQL against it."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from test_decontaminate import brute as decontaminated
from test_near_duplicates import brute as near_groups
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from oracle import compare, connect

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
FOLDER = "/root/testdata/sf0.001"


def fixture():
    rnd = random.Random(9)
    word = lambda: f"w{rnd.randrange(900)}"
    lines = lambda n: [" ".join(word() for _ in range(12)) for _ in range(n)]
    items = [(i, " ".join(word() for _ in range(14))) for i in range(4)]
    docs = []
    for k in range(90):
        body = lines(rnd.choice((3, 5, 7, 9)))
        if k % 3 == 0:
            body.insert(1, "All  rights RESERVED by the owner" if k % 2 else "all rights reserved by the owner")
        if k % 15 == 4:
            body.append(items[k % 4][1])
        docs.append((2 * k, "\n".join(body), "en", "abc"[k % 3], 0))
    docs += [(1000 + k, docs[4 * k][1].replace("w1 ", "w2 ") + " tail", "en", docs[4 * k][3], 0) for k in range(12)]
    return docs + [(2000, None, "en", "a", None), (2001, "", "en", None, 0), (2002, "say it " * 60, "en", "a", 0)], items


def quality(docs):
    hosts = {}
    for _, text, _, host, _ in docs:
        hosts.setdefault(host, set()).add(text or "")
    normal = lambda line: " ".join(line.split()).lower()
    shared = {h: Counter(x for t in texts for x in {normal(x) for x in t.split("\n") if x.strip()}) for h, texts in hosts.items()}
    out = []
    for i, text, lang, host, n_chars in docs:
        words = (text or "").split()
        grams = list(zip(words, words[1:], words[2:]))
        often, n = Counter(grams), len(words)
        repeated = {j + s for j, g in enumerate(grams) if often[g] > 1 for s in range(3)}
        bad = lambda x: shared[host][normal(x)] > max(20, 0.02 * len(hosts[host]))  # noqa: B023, E731
        left = n - sum(len(x.split()) for x in (text or "").split("\n") if bad(x))
        if n >= 50 and 100 * len(repeated) <= 50 * n and not (left < 50 and 2 * left <= n):
            out.append((i, "\n".join(x for x in text.split("\n") if not bad(x)), host))
    return out


def mixed(docs):
    size, sources = {}, sorted({h for *_, h in docs})
    for _, text, host in docs:
        size[host] = size.get(host, 0) + len(text.split())
    weight, total = {h: float(k % 3 + 1) for k, h in enumerate(sources)}, sum(size.values())
    target, free = {}, set(sources)
    while True:
        level = (total - sum(target.values())) / sum(weight[h] for h in free)
        over = [h for h in free if level * weight[h] > 3 * size[h]]
        if not over:
            break
        first = min(over, key=lambda h: 3 * size[h] / weight[h])
        target[first] = 3.0 * size[first]
        free.discard(first)
    target.update({h: level * weight[h] for h in free})
    draw = lambda i, s: int(hashlib.md5(f"{i}:{s}".encode()).hexdigest()[:13], 16) / 2**52
    out = []
    for host in sources:
        mine = [(i, t) for i, t, h in docs if h == host]
        rate = target[host] / size[host]
        part = rate - int(rate)
        seed = min(range(8), key=lambda s: (abs(sum(len(t.split()) for i, t in mine if draw(i, s) < part) - part * size[host]), s))
        out += [(i, t) for i, t in mine for _ in range(int(rate) + (draw(i, seed) < part))]
    return out


def test_run_against_plain_python(spark, tmp_path):
    docs, items = fixture()
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = quality(docs)
    groups = near_groups([(i, t) for i, t, _ in clean], 5)
    single = [r for r in clean if groups[r[0]] == r[0]]
    free = [r for r in single if not decontaminated(r[1], items, 10)[1]]
    assert len(docs) > len(clean) > len(single) > len(free) > 20 and any(c[1] != d[1] for c in clean for d in docs if c[0] == d[0])
    library, at, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for i, text in sorted(mixed(free)):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()
    assert [tuple(r) for r in got] == want


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.oracle_sql() if n.startswith("op")))
def test_operator_matches_sql(spark, name):
    compare(spark, connect(FOLDER), FOLDER, __spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name])
