"""Texts of the same words in another order are told apart."""

import numpy as np

from tallyloom.llm.classifier import BUCKETS, score, text_features, train


def test_order_of_words_decides():
    good = [b"red fox sees big dog " * (k + 2) for k in range(30)]
    bad = [b"dog big sees fox red " * (k + 2) for k in range(30)]
    model = train(good + bad, [1] * 30 + [0] * 30, epochs=8)
    value = lambda t: float((model[text_features(t)[0]] * text_features(t)[1]).sum() + model[-1])
    assert min(map(value, good)) > max(map(value, bad))


def test_scores_use_the_features_learned(spark):
    texts = ["red fox sees big dog", "dog dog big", "one", "", None]
    model = np.random.default_rng(3).normal(size=BUCKETS + 1).astype(np.float32)
    rows = score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in rows:
        buckets, share = text_features((texts[r.doc_id] or "").encode())
        assert abs(r.score - 1 / (1 + np.exp(-float((model[buckets] * share).sum() + model[-1])))) < 1e-4
