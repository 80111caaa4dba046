"""Words scored by the batch agree with words scored one by one."""

import random

import numpy as np

from tallyloom.llm import classifier


def test_word_scores_agree_with_word_features():
    draw = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABZ019.,-\x00<>~éßжя漢😀"
    words = {"".join(draw.choice(letters) for _ in range(draw.randrange(1, 12))).encode() for _ in range(3000)}
    words |= {b"a", b"\xff\xfe", b"\xc3", b"x" * 500, "é".encode(), ("z" * 40 + "ж").encode()}
    words = sorted(words)
    table = np.random.default_rng(4).normal(size=classifier.BUCKETS).astype(np.float32)
    got = classifier.word_scores(words, table, classifier.Grams())
    for word, (value, hashed) in zip(words, got):
        found = np.array(classifier.word_features(word))
        assert value == complex(float(table[found].sum()), len(found)) and hashed == classifier.word_hash(word)
    assert classifier.word_scores([], table, classifier.Grams()) == []


def test_buckets_of_short_grams_are_those_of_the_library():
    words = [bytes([a, b, c, d]) for a in (0, 60, 127) for b in (1, 62, 97) for c in (33, 122) for d in (0, 98)]
    rows = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), 4)
    for n in (2, 3, 4):
        want = [[classifier.bucket(w[i:i + n]) for i in range(4 - n + 1)] for w in words]
        assert classifier.gram_buckets(rows, n).tolist() == want
