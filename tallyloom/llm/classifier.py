"""Quality classifier: hashed word and character n-gram vectors, averaged per document, softmax.

The vectors and the output layer are learned by numpy mini-batch gradient descent in one task over
a sample of at most `max_docs` labelled texts (the smallest hashes of their ids). As the output
is linear in the averaged vector, each hashed feature then has one number, the difference of the
two class scores; that fixed-size table (4 bytes a bucket) is what is broadcast. A text's score is
the softmax of its features' mean, whole text included.

Null and empty texts have no feature and get the bias alone. Labels that are null are not
learned from; a document labelled twice counts twice. Without any label all scores are 0.5.
"""

from __future__ import annotations

from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import WordCache, body, map_rows, mix

BUCKETS = 1 << 18
DIM = 8
EPOCHS = 6
MAX_DOCS = 4_000
THRESHOLD = 0.3
GRAM_ENTRIES = 1 << 18
_SIZES = (2, 3, 4)
_SLICE_BYTES = 2_000_000
_U64 = np.uint64
#: A word and itself again, written with a back reference: one bucket for all words, beside each pair's own.
_AGAIN = xxhash.xxh32_intdigest("\\1 \\1") % BUCKETS


def bucket(gram: str | bytes) -> int:
    return xxhash.xxh32_intdigest(gram) % BUCKETS


class Grams(dict):
    """Buckets of character n-grams, which far fewer than words are; bounded."""

    def __missing__(self, gram):
        if len(self) >= GRAM_ENTRIES:
            self.clear()
        self[gram] = value = bucket(gram)
        return value


def word_features(word: bytes, of=bucket) -> list[int]:
    """Buckets of a word and of the character n-grams of <word>; `of` gives those of the n-grams."""
    text = "<" + word.decode("utf-8", "replace") + ">"
    return [bucket(text), *map(of, [text[i:i + n] for n in _SIZES for i in range(len(text) - n + 1)])]


def gram_buckets(letters: np.ndarray, n: int) -> np.ndarray:
    """Buckets of the `n`-grams (four at most) of ASCII words of one length, a word per row: xxh32 on columns."""
    one, two, three, four, five = map(np.uint32, (2654435761, 2246822519, 3266489917, 668265263, 374761393))
    turned = lambda x, by: (x << np.uint32(by)) | (x >> np.uint32(32 - by))
    wide = letters.astype(np.uint32)
    parts = [wide[:, i:wide.shape[1] - n + 1 + i] for i in range(n)]
    h = np.full(parts[0].shape, int(five) + n, np.uint32)
    if n == 4:
        whole = parts[0] | parts[1] << np.uint32(8) | parts[2] << np.uint32(16) | parts[3] << np.uint32(24)
        h = turned(h + whole * three, 17) * four
    else:
        for part in parts:
            h = turned(h + part * five, 11) * one
    h = (h ^ (h >> np.uint32(15))) * two
    h = (h ^ (h >> np.uint32(13))) * three
    return (h ^ (h >> np.uint32(16))) % np.uint32(BUCKETS)


def word_scores(words: list[bytes], table: np.ndarray, grams: Grams) -> list[tuple[complex, int]]:
    """(sum of the scores, number) of each word's features, and its hash."""
    by_size: dict[int, list[int]] = {}
    out: list = [None] * len(words)
    for i, word in enumerate(words):
        if word.isascii():
            by_size.setdefault(len(word), []).append(i)
        else:
            found = np.array(word_features(word, grams.__getitem__))
            out[i] = complex(float(table[found].sum()), len(found)), word_hash(word)
    for size, at in by_size.items():
        same = [b"<" + words[i] + b">" for i in at]
        letters = np.frombuffer(b"".join(same), np.uint8).reshape(len(at), size + 2)
        whole = np.fromiter(map(bucket, same), np.uint32, len(at))[:, None]
        found = np.hstack([whole, *(gram_buckets(letters, n) for n in _SIZES if n <= size + 2)])
        for i, total in zip(at, table[found].sum(1).tolist()):
            out[i] = complex(total, found.shape[1]), word_hash(words[i])
    return out


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def pair_features(hashes: np.ndarray) -> np.ndarray:
    """Buckets of the word 2-grams, from the hashes of a text's words in order."""
    return (mix(hashes[:-1] * _U64(0x9E3779B97F4A7C15) + hashes[1:]) % _U64(BUCKETS)).astype(np.int64)


def text_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    counts: dict[bytes, int] = {}
    words = text.split()
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    lists = [word_features(w) for w in counts]
    again = sum(map(eq, words, words[1:]))
    if not lists:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    hashes = {w: word_hash(w) for w in counts}
    pairs = pair_features(np.fromiter(map(hashes.__getitem__, words), _U64, len(words)))
    flat = np.concatenate([*[np.array(x, np.int64) for x in lists], pairs, [_AGAIN]])
    weight = np.concatenate([np.repeat(np.fromiter(counts.values(), np.float64), [len(x) for x in lists]), np.ones(len(pairs)), [again]])
    buckets, inverse = np.unique(flat, return_inverse=True)
    share = np.bincount(inverse, weights=weight)
    return buckets, (share / share.sum()).astype(np.float32)


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, rate: float = 0.5, batch: int = 16) -> np.ndarray:
    """Scores per bucket, with the bias as the last entry."""
    draw = np.random.default_rng(7)
    vectors = draw.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    sparse = [text_features(t) for t in texts]
    target = np.array(labels, np.int64)
    steps, step = max(1, epochs * -(-len(texts) // batch)), 0
    for _ in range(epochs):
        order = draw.permutation(len(texts))
        for first in range(0, len(order), batch):
            part = order[first:first + batch]
            lr = rate * (1 - step / steps)
            step += 1
            sizes = np.array([len(sparse[i][0]) for i in part])
            buckets = np.concatenate([sparse[i][0] for i in part])
            share = np.concatenate([sparse[i][1] for i in part])
            owner = np.repeat(np.arange(len(part)), sizes)
            rows = vectors[buckets] * share[:, None]
            mean = np.stack([np.bincount(owner, rows[:, d], len(part)) for d in range(DIM)], 1).astype(np.float32)
            logits = mean @ out + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), target[part]] -= 1
            back = p @ out.T
            out -= lr * mean.T @ p
            bias -= lr * p.mean(0)
            np.add.at(vectors, buckets, -lr * 50 * back[owner] * share[:, None])
    scores = vectors @ (out[:, 1] - out[:, 0])
    return np.append(scores, bias[1] - bias[0]).astype(np.float32)


def learn(docs: DataFrame, labels: DataFrame, label: str, use: Column, max_docs: int = MAX_DOCS) -> np.ndarray:
    """Train on at most `max_docs` labelled rows that `use` admits; one task, bounded input."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(use)
    sample = known.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label"))
    sample = sample.orderBy(F.xxhash64("_id"), "_id", "_label").limit(max_docs)
    texts = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select(body().alias("text"), "_label", "_id")

    def run(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: (r["_id"], r["_label"], r["text"]))
        if rows:
            model = train([r["text"] for r in rows], [r["_label"] for r in rows])
            yield pa.RecordBatch.from_pydict({"model": [model.tobytes()]}, schema=pa.schema([("model", pa.binary())]))

    found = texts.repartition(1).mapInArrow(run, "model binary").collect()
    return np.frombuffer(found[0].model, np.float32) if found else np.zeros(BUCKETS + 1, np.float32)


def score(docs: DataFrame, model: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """`doc_id, score, predicted` of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        weights = held.value
        table, bias = weights[:-1], float(weights[-1])

        grams = Grams()
        words = WordCache(lambda ws: word_scores(ws, table, grams))

        def step(rows):
            out, lists = [], [row["text"].split() for row in rows]
            known = words.fill(lists)
            for row, found in zip(rows, lists):
                again = sum(map(eq, found, found[1:]))
                total = complex(again * float(table[_AGAIN]), again)
                if found:
                    values, hashes = zip(*map(known.__getitem__, found))
                    pairs = pair_features(np.fromiter(hashes, _U64, len(hashes)))
                    total += sum(values) + complex(float(table[pairs].sum()), len(pairs))
                logit = bias + (total.real / total.imag if total.imag else 0.0)
                value = float(1 / (1 + np.exp(-np.clip(logit, -60, 60))))
                out.append({"doc_id": row["doc_id"], "score": value, "predicted": int(value >= threshold)})
            return out

        return step

    rows = docs.select(F.col("doc_id").cast("long"), body().alias("text"))
    return map_rows(rows, make, "doc_id long, score double, predicted int", _SLICE_BYTES)
