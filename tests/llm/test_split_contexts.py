"""A context's probabilities when its pairs lie in several shards."""

from pyspark.sql import functions as F

from tallyloom.llm import language_model


def corpus(spark):
    # 'a' is followed once by each of 300 words; each text stands once to learn from and once to be scored
    docs = [(i, f"a w{i}") for i in range(300)] + [(1000 + i, f"a w{i}") for i in range(300)]
    return spark.createDataFrame(docs, "doc_id long, text string")


def scores(spark, **settings):
    rows = language_model.score_texts(corpus(spark), F.col("doc_id") < 1000, chunk_tokens=400, **settings).collect()
    return [r.score for r in rows if r.held_out]


def test_words_of_a_split_context_share_one_back_off(spark):
    whole = scores(spark)
    split = scores(spark, pairs_per_shard=64, words_per_shard=20)
    assert len(whole) == len(split) == 300
    # the words are alike, so are their scores; in one part or in five, by one discount
    assert max(whole) - min(whole) < 1e-5 and max(split) - min(split) < 1e-5
    assert abs(whole[0] - split[0]) < 0.05


def test_a_split_context_has_probabilities_that_sum_to_one():
    import numpy as np

    names, owner, base = np.array([7]), np.zeros(500, np.int64), np.full(500, 1 / 500)
    customers = np.arange(500) % 5 + 1
    parts, now = np.array_split(np.arange(500), 4), language_model.Sums(names, np.array([500.0]))
    states, mean = [None] * 4, 0.0
    for sweep in range(language_model.SWEEPS):
        models = [language_model.Restaurants(names, owner[p], customers[p], base[p], 0.5, s) for p, s in zip(parts, states)]
        for k, m in enumerate(models):
            m.run([sweep], (0, k), now)
        states = [m.state(k)[0] for k, m in enumerate(models)]
        now = language_model.Sums(names, sum(m.totals(m.tables) for m in models))
    mean = sum(m.totals(m.mean())[0] for m in models)
    kept = sum((m.customers - 0.5 * m.mean()).sum() for m in models)
    total = customers.sum() + language_model.STRENGTH
    assert abs((kept + language_model.STRENGTH + 0.5 * mean) / total - 1) < 1e-9
