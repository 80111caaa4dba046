"""What travels between tasks: packed arrays give back what went in, in fewer bytes."""

import numpy as np

from tallyloom.llm import language_model
from tallyloom.llm.common import pack, pack_few, unpack_few


def test_few_distinct_values_take_few_bytes():
    draw = np.random.default_rng(2)
    values = draw.random(700).astype(np.float32)
    codes = draw.zipf(1.5, 50_000) % 700
    blob = pack_few(values, codes)
    assert (unpack_few(blob, np.float32) == values[codes]).all()
    assert len(blob) < 0.6 * len(pack(values[codes]))
    many = np.arange(70_000, dtype=np.float32)
    for at in (np.arange(70_000), np.array([5]), np.zeros(0, np.int64), np.arange(256), np.arange(257)):
        assert (unpack_few(pack_few(many, at), np.float32) == many[at]).all()


def test_hashes_and_words_come_back_from_their_steps():
    draw = np.random.default_rng(3)
    hashes = np.unique(np.append(draw.integers(0, 1 << 64, 100_000, dtype=np.uint64), np.uint64((1 << 64) - 1)))
    blob = language_model._steps(hashes)
    assert (language_model._from_steps(blob) == hashes).all() and len(blob) < 7 * len(hashes)
    assert len(language_model._from_steps(language_model._steps(hashes[:0]))) == 0
    size = draw.integers(1, 6, 400)
    words = np.concatenate([np.sort(draw.choice(10_000, n, replace=False)) for n in size])
    first = np.zeros(len(words), bool)
    first[np.cumsum(size) - size] = True
    assert (language_model._words_of(np.where(first, words, np.diff(words, prepend=0)), size) == words).all()
