"""Scores of texts under a hierarchical Pitman-Yor model, trained and applied as Spark shuffles.

Each previous word is a context restaurant whose customers are the words that follow it; a new
table sends one customer to the parent restaurant all contexts share (the words), whose own base is
uniform over V + 1. Discounts are estimated from counts of counts.

Data flow, each arrow one shuffle of compressed arrays whose number follows the data:

  documents -> chunks (bounded numbers of tokens; distinct words of a chunk are numbered)
  chunks -> word shards -> chunks    training counts and dense ids of each chunk's words
  chunks -> context shards           distinct (context, word) pairs with their training counts
  context shards                     counts of counts of all shards; Gibbs sweeps over every pair
  context shards -> word shards      tables, which are the parent's customers; its own sweeps
  both -> chunks                     what each chunk needs for its own pairs and words: scores

A sweep reseats the customers of each (context, word) pair given its restaurant's other tables; a
word's base in all contexts is its training frequency, and levels are swept once each, contexts
first. A seating is
drawn customer by customer from the Chinese restaurant process and accepted by the
Metropolis-Hastings rule, its weight being the product of the process's normalisers. Pairs of a
restaurant are reseated at once, with the restaurant's tables of the last sweep. Beyond
`STEPWISE` customers, the wait for the next new table is drawn in closed form, so a very frequent
pair costs in proportion to its tables. Predictive probabilities are averaged over the last sweeps.

Contexts with more than `PAIRS_PER_SHARD` customers are split by words over shards of their own, as
the parent is split over the word shards. Before every sweep, and for the scores, a split
restaurant's tables are summed over its parts, and the discount of a level comes from the counts of
counts of all its shards; so a number of shards changes which draws are made, not what they follow.
The sums are two numbers a part. No array sent anywhere is larger than what one chunk or one shard
holds.

Null texts are empty and hold the end token alone. Repeated rows each count and are each scored. With
no training document, every score is that of the base.
"""

from __future__ import annotations

import math
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import body, crc_mod, mix, pack, pack_few, schema_of, unpack, unpack_few
from tallyloom.session import durable

CHUNK_TOKENS = 1_000_000
PAIRS_PER_SHARD = 600_000
WORDS_PER_SHARD = 500_000
SWEEPS = 4
SAMPLES = 2
STRENGTH = 1.0
STEPWISE = 32

_END_WORD = b" end"  # holds a blank, so no word equals it
_U64 = np.uint64

CHUNKS = ("chunk long, n_tokens long, n_words long, train_docs long, doc_ids array<long>, lengths binary,"
          " train binary, tokens binary, hashes binary, counts binary")
MESSAGE = "dest long, kind int, src long, a binary, b binary, c binary, d binary"


# ---- chunks -------------------------------------------------------------------------------

def chunks(docs: DataFrame, train, chunk_tokens: int) -> DataFrame:
    """Rows that hold the token numbers of consecutive documents and the hashes of their words."""
    fields = schema_of(CHUNKS)

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        held = _Chunk()
        for batch in batches:
            for doc, text, used in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "train"))):
                held.add(doc, text, used)
                if held.n_tokens >= chunk_tokens:
                    yield held.batch(part << 32 | seq, fields)
                    held, seq = _Chunk(), seq + 1
        if held.ids:
            yield held.batch(part << 32 | seq, fields)

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    return given.mapInArrow(run, CHUNKS)


def _steps(hashes: np.ndarray) -> bytes:
    """Sorted hashes by their differences, whose first bytes are zeros."""
    return pack(np.diff(hashes, prepend=_U64(0)))


def _from_steps(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, _U64), dtype=_U64)


class _Chunk:
    def __init__(self):
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.numbers[_END_WORD] = 0
        self.ids, self.lengths, self.used, self.parts, self.n_tokens = [], [], [], [], 0

    def add(self, doc, text: bytes, used: bool):
        words = text.lower().split()
        part = np.fromiter(map(self.numbers.__getitem__, words), np.uint32, len(words))
        self.parts.append(np.append(part, np.uint32(0)))
        self.ids.append(doc)
        self.lengths.append(len(words) + 1)
        self.used.append(used)
        self.n_tokens += len(words) + 1

    def batch(self, name: int, fields: pa.Schema) -> pa.RecordBatch:
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.numbers), _U64, len(self.numbers))
        order = np.argsort(hashes)
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        tokens = place[np.concatenate(self.parts)]
        lengths, used = np.array(self.lengths, np.uint32), np.array(self.used, np.uint8)
        weight = np.repeat(used, lengths)
        counts = np.bincount(tokens, weights=weight, minlength=len(order)).astype(np.int64)
        return pa.RecordBatch.from_pylist([{
            "chunk": name, "n_tokens": len(tokens), "n_words": len(order), "train_docs": int(used.sum()),
            "doc_ids": self.ids, "lengths": pack(lengths), "train": pack(used), "tokens": pack(tokens),
            "hashes": _steps(hashes[order]), "counts": pack(counts),
        }], schema=fields)


def by_key(messages: DataFrame, step, schema: str, key: str = "dest") -> DataFrame:
    """`step(key, rows)` of each destination; `rows` are its messages, in a fixed order."""
    names = schema_of(schema).names

    def run(name, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["kind", "src"], kind="stable")
        return pd.DataFrame(step(int(name[0]), rows.to_dict("records")), columns=names)

    return messages.groupBy(key).applyInPandas(run, schema)


def send(source: DataFrame, step) -> DataFrame:
    """Messages that `step(row)` makes of each row."""
    fields = schema_of(MESSAGE)

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                out = list(step(batch.slice(at, 1).to_pylist()[0]))
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=fields)

    return source.mapInArrow(run, MESSAGE)


def message(dest: int, kind: int, src: int, *arrays: bytes) -> dict:
    return {"dest": dest, "kind": kind, "src": src} | dict(zip("abcd", [*arrays, *[None] * (4 - len(arrays))]))


# ---- words --------------------------------------------------------------------------------

def _word_requests(row: dict, shards: int):
    """Slices of a chunk's sorted hashes; shards are ranges of the hash."""
    hashes, counts = _from_steps(row["hashes"]), unpack(row["counts"], np.int64)
    cuts = np.searchsorted(hashes, np.array([(s << 64) // shards for s in range(1, shards)], dtype=object).astype(_U64)) if shards > 1 else []
    for shard, (h, c) in enumerate(zip(np.split(hashes, cuts), np.split(counts, cuts))):
        if len(h):
            yield message(shard, 0, row["chunk"], _steps(h), pack(c))


def _word_answers(shard: int, rows: list[dict], shards: int, most: int):
    """Per chunk the dense ids and training counts of its words; frequent words get small ids.

    The sums hold the tokens of words found more than `most` times on their own.
    """
    parts = [_from_steps(r["a"]) for r in rows]
    words, place = np.unique(np.concatenate(parts), return_inverse=True)
    counts = np.bincount(place, np.concatenate([unpack(r["b"], np.int64) for r in rows])).astype(np.int64)
    ids = np.empty(len(words), np.int64)
    ids[np.argsort(-counts, kind="stable")] = np.arange(len(words)) * shards + shard + 1
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    out = [message(r["src"], 1, shard, pack(ids[p]), pack(counts[p])) for r, p in zip(rows, np.split(place, cuts))]
    return [*out, message(-1, 1, shard, str(int(counts.sum())).encode(), str(int((counts > 0).sum())).encode(),
                            str(int(counts[counts > most].sum())).encode())]


# ---- pairs --------------------------------------------------------------------------------

class _Shards(NamedTuple):
    """Context shards: `whole` ones for contexts of at most `most` customers, then `split` ones."""

    whole: int
    split: int
    most: int

    @property
    def n(self) -> int:
        return self.whole + self.split

    def of(self, ids: np.ndarray, customers: np.ndarray, context: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The shard of each pair; a split context goes by words to as many as hold it."""
        scrambled = mix(ids)
        shard = (scrambled % _U64(self.whole)).astype(np.int64)[context]
        parted = customers[context] > self.most
        if parted.any():
            ways = -(-customers[context][parted] // self.most)
            sub = (mix(words[parted]) % ways.astype(_U64)).astype(np.int64)
            first = (scrambled % _U64(self.split)).astype(np.int64)[context][parted]
            shard[parted] = self.whole + (first + sub) % self.split
        return shard


class _Pairs:
    """A chunk's distinct (context, word) pairs by context shard, in the order both sides rely on."""

    def __init__(self, rows: list[dict], train_docs: int, shards: _Shards, inverse: bool):
        chunk = next(r for r in rows if r["kind"] == 0)
        answers = [r for r in rows if r["kind"] == 1]
        ids = np.concatenate([unpack(r["a"], np.int64) for r in answers])
        self.by_id = np.argsort(ids)
        self.ids = ids[self.by_id]
        self.counts = np.concatenate([unpack(r["b"], np.int64) for r in answers])[self.by_id]
        self.lengths, self.used = unpack(chunk["a"], np.uint32).astype(np.int64), unpack(chunk["b"], np.uint8)
        place = np.empty(len(ids), np.int64)
        place[self.by_id] = np.arange(len(ids))
        self.tokens = place[unpack(chunk["c"], np.uint32)]
        n = len(self.ids)
        starts = np.cumsum(self.lengths) - self.lengths
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[starts] = n  # the start of a text is the context past the last word
        self.context_ids = np.append(self.ids, 0)
        self.context_counts = np.append(self.counts, train_docs)
        keys = before * n + self.tokens
        weight = np.repeat(self.used, self.lengths)
        if inverse:
            unique, self.inverse = np.unique(keys, return_inverse=True)
            self.n = None
        else:
            unique, self.inverse = np.unique(keys), None
            found, times = np.unique(keys[weight > 0], return_counts=True)
            self.n = np.zeros(len(unique), np.int64)
            self.n[np.searchsorted(unique, found)] = times
        self.context, self.word = unique // n, unique % n
        shard = shards.of(self.context_ids, self.context_counts, self.context, self.ids[self.word])
        self.order = np.argsort(shard, kind="stable")
        self.cuts = np.searchsorted(shard[self.order], np.arange(shards.n + 1))


def _pair_requests(name: int, rows: list[dict], train_docs: int, shards: _Shards):
    p = _Pairs(rows, train_docs, shards, inverse=False)
    out = []
    for shard in range(shards.n):
        at = p.order[p.cuts[shard]:p.cuts[shard + 1]]
        if not len(at):
            continue
        first = np.concatenate(([True], np.diff(p.context[at]) != 0))
        contexts, words = p.context[at][first], p.ids[p.word[at]]
        size = np.diff(np.append(np.flatnonzero(first), len(at)))
        level = np.log2(np.maximum(p.counts[p.word[at]], 1)) * 6
        out.append(message(
            shard, 2, name, pack(np.stack([p.context_ids[contexts], size])), pack(np.where(first, words, np.diff(words, prepend=0))),
            pack(p.n[at]), pack(np.round(level).astype(np.uint8)),
        ))
    return out


# ---- seating ------------------------------------------------------------------------------

def discount(one: int, two: int) -> float:
    """n1 / (n1 + 2 n2), kept inside (0, 1)."""
    return min(0.95, max(0.05, one / (one + 2 * two))) if one + two else 0.5


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, for arguments of 8 and more."""
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x ** 3)


def seat(customers: np.ndarray, d: float, weight: np.ndarray, step: np.ndarray, draw: np.random.Generator):
    """Tables of fresh seatings and the logarithm of their weights.

    `weight`: what a new table weighs at first; each table adds `step` to that.
    """
    n = len(customers)
    tables, log_weight = np.ones(n), np.zeros(n)
    live, i = np.flatnonzero(customers > 1), 1
    while len(live) and i < STEPWISE:
        new = weight[live] + step[live] * tables[live]
        total = i - d * tables[live] + new
        log_weight[live] += np.log(total)
        tables[live] += draw.random(len(live)) * total < new
        i += 1
        live = live[customers[live] > i]
    at = np.full(len(live), float(i))
    while len(live):
        new = weight[live] + step[live] * tables[live]
        base = d * tables[live]
        # Gamma(x + new) / Gamma(x) is close to (x + (new - 1) / 2) ** new
        shift = (new - 1) / 2 - base
        wait = np.ceil((at + shift) * np.exp(np.minimum(-np.log(draw.random(len(live))) / np.maximum(new, 1e-12), 60)) - shift)
        end = np.minimum(np.maximum(wait, at + 1), customers[live])
        log_weight[live] += _log_gamma(end - base + new) - _log_gamma(at - base + new)
        more = wait < customers[live]
        tables[live] += more
        live, at = live[more], end[more]
    return tables, log_weight


class Restaurants:
    """Seatings of the pairs of some restaurants, or of their parts that one shard holds."""

    def __init__(self, names: np.ndarray, owner: np.ndarray, customers: np.ndarray, base: np.ndarray, d: float, state: dict | None = None):
        """`owner`: each pair's restaurant by its place in `names`; `base`: its parent's probability."""
        self.names, self.owner, self.customers, self.base, self.d = names, owner, customers, base, d
        self.busy = np.flatnonzero(customers > 1)
        self.tables, self.sampled = (customers > 0).astype(np.int64), np.zeros(len(customers), np.int64)
        self.log_weight: np.ndarray | None = None
        if state:
            self.tables, self.sampled = unpack(state["a"], np.int64).copy(), unpack(state["b"], np.int64).copy()
            self.log_weight = unpack(state["c"], np.float64)

    def totals(self, tables: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, tables, len(self.names))

    def sweep(self, totals: np.ndarray, draw: np.random.Generator) -> None:
        """Reseat every pair, given the tables that its restaurant has in all."""
        b = self.busy
        others = np.maximum(totals[self.owner[b]] - self.tables[b], 0)
        weight, step = (STRENGTH + self.d * others) * self.base[b], self.d * self.base[b]
        tables, log_weight = seat(self.customers[b], self.d, weight, step, draw)
        if self.log_weight is None:
            accept = np.ones(len(b), bool)
            self.log_weight = np.zeros(len(b))
        else:
            accept = np.log(draw.random(len(b))) < log_weight - self.log_weight
        self.tables[b] = np.where(accept, tables, self.tables[b])
        self.log_weight = np.where(accept, log_weight, self.log_weight)

    def run(self, sweeps, seed: tuple[int, int], whole: Sums | None = None) -> None:
        """Some of the sweeps; `whole` are the tables of all parts, else the shard holds them all."""
        for number in sweeps:
            totals = self.totals(self.tables) if whole is None else whole.of(self.names)
            self.sweep(totals, np.random.default_rng([*seed, number]))
            if number >= SWEEPS - SAMPLES:
                self.sampled += self.tables

    def mean(self) -> np.ndarray:
        """Tables of the pairs, averaged over the last sweeps."""
        return self.sampled / SAMPLES

    def state(self, shard: int) -> list[dict]:
        """What the next sweep goes on from, and this shard's share of its restaurants' tables."""
        return [message(shard, 8, shard, pack(self.tables), pack(self.sampled), pack(self.log_weight)), self.share(shard)]

    def share(self, shard: int, *more: bytes) -> dict:
        sums = [self.totals(x).astype(np.int64) for x in (self.tables, self.sampled)]
        return message(-1, 8, shard, pack(self.names), pack(sums[0]), pack(sums[1]), *more)


class Sums(NamedTuple):
    """Numbers of restaurants, in the order of their names."""

    names: np.ndarray
    values: np.ndarray

    def of(self, names: np.ndarray) -> np.ndarray:
        return self.values[np.searchsorted(self.names, names)]


def summed(parts: DataFrame) -> tuple[Sums, Sums]:
    """Tables of restaurants, now and sampled, over all shards; two numbers a part reach the driver."""
    rows = parts.where("dest = -1 and a is not null").select("a", "b", "c").collect()
    if not rows:
        return (Sums(np.zeros(0, np.int64), np.zeros(0)),) * 2
    names, place = np.unique(np.concatenate([unpack(r.a, np.int64) for r in rows]), return_inverse=True)
    return tuple(Sums(names, np.bincount(place, np.concatenate([unpack(r[c], np.int64) for r in rows]))) for c in "bc")


def counts_of_counts(merged: DataFrame) -> tuple[int, int]:
    """How many pairs have one customer and two, over all shards."""
    found = merged.where("dest = -1").select(F.split(F.col("d").cast("string"), " ").alias("n")).select(
        F.sum(F.col("n")[0].cast("long")).alias("one"), F.sum(F.col("n")[1].cast("long")).alias("two")).first()
    return found.one or 0, found.two or 0


def _ones_and_twos(customers: np.ndarray) -> bytes:
    return f"{int((customers == 1).sum())} {int((customers == 2).sum())}".encode()


def in_rounds(merged: DataFrame, held: DataFrame, make, level: int, alone: bool) -> tuple[DataFrame, Sums]:
    """The last state of each shard in `held`, and its restaurants' mean tables.

    Between sweeps the tables of each restaurant are summed over the shards. `make(rows, state)`
    gives the restaurants of a shard. A single shard needs no sums of others: one round of all sweeps.
    """
    state, (now, sampled) = None, summed(merged)
    for number in range(1 if alone else SWEEPS):
        def step(shard, rows, sweeps=range(SWEEPS) if alone else (number,), whole=None if alone else now):
            model = make(rows, next((r for r in rows if r["kind"] == 8), None))
            model.run(sweeps, (level, shard), whole)
            return model.state(shard)

        given = held if state is None else held.unionByName(state.where("dest >= 0"))
        state = durable(by_key(given, step, MESSAGE), "sweep")
        now, sampled = summed(state)
    return state.where("dest >= 0"), Sums(sampled.names, sampled.values / SAMPLES)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; runs that are in order already are merged, not sorted."""
    ordered = np.sort(values, kind="stable")
    return ordered[np.concatenate(([True], ordered[1:] != ordered[:-1]))] if len(ordered) else ordered


def _words_of(steps: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Word ids of contexts of `size` words; the first of a context came whole, the others as what they add."""
    total, first = np.cumsum(steps), np.cumsum(size) - size
    return total - np.repeat(total[first] - steps[first], size)


def _merge_pairs(shard: int, rows: list[dict], split: bool):
    """A shard's distinct pairs with their customers, each chunk's places among them, and sums."""
    heads = [unpack(r["a"], np.int64).reshape(2, -1) for r in rows]
    words = [_words_of(unpack(r["b"], np.int64), h[1]) for r, h in zip(rows, heads)]
    names = distinct(np.concatenate([h[0] for h in heads]))
    spread = np.int64(max(int(w.max()) for w in words)) + 1
    if spread * len(names) >= 1 << 62:
        raise ValueError("more word ids than a shard can key; lower PAIRS_PER_SHARD")
    # every message is in key order, so lookups run through memory in order
    sent_keys = [np.repeat(np.searchsorted(names, h[0]), h[1]) * spread + w for h, w in zip(heads, words)]
    keys = distinct(np.concatenate(sent_keys))
    places = [np.searchsorted(keys, k) for k in sent_keys]
    customers, level = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.uint8)
    for r, at in zip(rows, places):
        customers[at] += unpack(r["c"], np.int64)
        level[at] = unpack(r["d"], np.uint8)
    out = [message(shard, 6, shard, pack(np.append(names, spread)), pack(np.diff(keys, prepend=0)), pack(customers), pack(level))]
    for r, h, at in zip(rows, heads, places):
        out.append(message(shard, 7, r["src"], pack(np.diff(at, prepend=0)), pack(np.searchsorted(names, h[0]))))
    found = _ones_and_twos(customers)
    if not split:
        return [*out, message(-1, 6, shard, None, None, None, found)]
    return [*out, Restaurants(names, keys // spread, customers, None, 0.0).share(shard, found)]


def _context_restaurants(rows: list[dict], state: dict | None, d: float, n_train: int) -> Restaurants:
    merged = next(r for r in rows if r["kind"] == 6)
    names = unpack(merged["a"], np.int64)
    names, spread = names[:-1], names[-1]
    keys = np.cumsum(unpack(merged["b"], np.int64))
    base = np.exp2(unpack(merged["d"], np.uint8) / 6.0) / max(n_train, 1)
    model = Restaurants(names, keys // spread, unpack(merged["c"], np.int64), base, d, state)
    model.words = keys % spread
    return model


def _context_answers(shard: int, rows: list[dict], model: Restaurants, totals: np.ndarray, word_shards: int):
    """Answers to chunks, tables to the word shards."""
    kept, kept_at = np.unique((model.customers - model.d * model.mean()).astype(np.float32), return_inverse=True)
    passed, passed_at = np.unique((STRENGTH + model.d * totals).astype(np.float32), return_inverse=True)
    out = [
        message(r["src"], 3, shard,
                pack_few(kept, kept_at[np.cumsum(unpack(r["a"], np.int64))]), pack_few(passed, passed_at[unpack(r["b"], np.int64)]))
        for r in rows if r["kind"] == 7
    ]
    seen, where = np.unique(model.words, return_inverse=True)
    sent = np.bincount(where, model.tables).astype(np.int64)
    dest = (seen - 1) % word_shards
    for target in range(word_shards):
        mine = (dest == target) & (sent > 0)
        if mine.any():
            out.append(message(-2 - target, 4, shard, pack(seen[mine]), pack(sent[mine])))
    return out


def _seat_whole(shard: int, rows: list[dict], d: float, n_train: int, word_shards: int):
    """All sweeps over contexts that one shard holds."""
    model = _context_restaurants(rows, None, d, n_train)
    model.run(range(SWEEPS), (0, shard))
    return _context_answers(shard, rows, model, model.totals(model.mean()), word_shards)


def _answer_split(shard: int, rows: list[dict], d: float, n_train: int, word_shards: int, mean: Sums):
    """Answers of contexts whose sweeps went over several shards."""
    model = _context_restaurants(rows, next(r for r in rows if r["kind"] == 8), d, n_train)
    return _context_answers(shard, rows, model, mean.of(model.names), word_shards)


def _merge_tables(shard: int, rows: list[dict], shards: int):
    """A word shard's customers, which are the contexts' tables, and its sums."""
    asked = [(unpack(r["a"], np.int64) - 1) // shards for r in rows]
    customers = np.zeros(max(int(ids.max()) for ids in asked) + 1, np.int64)
    for ids, r in zip(asked, rows):
        np.add.at(customers, ids, unpack(r["b"], np.int64))
    share = Restaurants(np.zeros(1, np.int64), np.zeros(len(customers), np.int64), customers, None, 0.0).share(shard, _ones_and_twos(customers))
    return [message(shard, 6, shard, pack(customers)), share, message(-2, 6, shard, str(int(customers.sum())).encode())]


def _word_restaurant(rows: list[dict], state: dict | None, d: float, n_distinct: int) -> Restaurants:
    customers = unpack(next(r for r in rows if r["kind"] == 6)["a"], np.int64)
    return Restaurants(np.zeros(1, np.int64), np.zeros(len(customers), np.int64), customers, np.full(len(customers), 1 / (n_distinct + 1)), d, state)


def _word_kept(shard: int, rows: list[dict], d: float, n_distinct: int, shards: int):
    """Each chunk's words: customers less the discounts of their tables; words no context sent have none."""
    asked = [(r["src"], (unpack(r["a"], np.int64) - 1) // shards) for r in rows if r["kind"] == 1]
    kept = np.zeros(max((int(ids.max()) for _, ids in asked), default=0) + 1, np.float32)
    state = next((r for r in rows if r["kind"] == 8), None)
    if state:
        model = _word_restaurant(rows, state, d, n_distinct)
        kept = np.append((model.customers - d * model.mean()).astype(np.float32), kept)[:max(len(kept), len(model.customers))]
    kept, place = np.unique(kept, return_inverse=True)
    return [message(chunk, 5, shard, pack_few(kept, place[ids])) for chunk, ids in asked]


# ---- scores -------------------------------------------------------------------------------

SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(name: int, rows: list[dict], totals: dict, shards: _Shards) -> list[dict]:
    p = _Pairs(rows, totals["train_docs"], shards, inverse=True)
    answers = {r["src"]: r for r in rows if r["kind"] == 3}
    words = np.concatenate([unpack_few(r["a"], np.float32) for r in rows if r["kind"] == 5])[p.by_id].astype(float)
    n, v = totals["n_train"], totals["distinct"]
    parent = (words + (STRENGTH + totals["passed"]) / (v + 1)) / (STRENGTH + totals["customers"])
    chance = np.empty(len(p.context))
    for shard in range(shards.n):
        at = p.order[p.cuts[shard]:p.cuts[shard + 1]]
        if not len(at):
            continue
        kept, passed = (unpack_few(answers[shard][c], np.float32).astype(float) for c in "ab")
        first = np.concatenate(([True], np.diff(p.context[at]) != 0))
        size = np.diff(np.append(np.flatnonzero(first), len(at)))
        chance[at] = (kept + np.repeat(passed, size) * parent[p.word[at]]) / (STRENGTH + p.context_counts[p.context[at]])
    if (chance > 1 + 1e-5).any():
        raise ValueError("a probability above one")
    log = np.log10(np.minimum(chance, 1.0))[p.inverse]  # what single precision adds
    base = np.log10((p.counts + 1) / (n + v + 1))[p.tokens]
    starts = np.cumsum(p.lengths) - p.lengths
    sums = [np.add.reduceat(x, starts) for x in (log, base, (p.counts[p.tokens] > 0).astype(np.int64))]
    ids = next(r for r in rows if r["kind"] == 0)["d"]
    named, known = np.frombuffer(ids[:8 * len(starts)], np.int64), np.frombuffer(ids[8 * len(starts):], np.uint8)
    return [
        {"doc_id": int(i) if k else None, "held_out": not u, "n_tokens": int(m), "n_known": int(c), "train_tokens": n, "base_score": float(b), "score": float(s)}
        for i, k, u, m, s, b, c in zip(named, known, p.used, p.lengths, *sums)
    ]


def _chunk_message(row: dict):
    ids = np.array([0 if i is None else i for i in row["doc_ids"]], np.int64)
    known = np.array([i is not None for i in row["doc_ids"]], np.uint8)
    yield message(row["chunk"], 0, 0, row["lengths"], row["train"], row["tokens"], ids.tobytes() + known.tobytes())


def score_texts(
    docs: DataFrame, train=None, chunk_tokens: int = CHUNK_TOKENS, pairs_per_shard: int = PAIRS_PER_SHARD, words_per_shard: int = WORDS_PER_SHARD
) -> DataFrame:
    """`doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score` of every row.

    `train` tells which rows the model learns from; by default those whose crc32(doc_id) mod 7 is not 2.
    """
    used = crc_mod("doc_id", 7) != 2 if train is None else train
    made = durable(chunks(docs, used, chunk_tokens), "chunks")
    size = made.agg(F.sum("n_tokens").alias("tokens"), F.sum("n_words").alias("words"), F.sum("train_docs").alias("docs")).first()
    word_shards = max(1, math.ceil((size.words or 0) / (4 * words_per_shard)))
    train_docs = size.docs or 0

    words = durable(by_key(
        send(made.select("chunk", "hashes", "counts"), lambda row: _word_requests(row, word_shards)),
        lambda shard, rows: _word_answers(shard, rows, word_shards, pairs_per_shard), MESSAGE,
    ), "words")
    number = lambda name: F.sum(F.col(name).cast("string").cast("long"))
    sums = words.where("dest = -1").select(number("a").alias("n"), number("b").alias("v"), number("c").alias("frequent")).first()
    n_train, n_distinct = sums.n or 0, sums.v or 0
    parted = (sums.frequent or 0) + (train_docs if train_docs > pairs_per_shard else 0)
    in_split = (size.tokens or 0) * min(1.0, parted / max(n_train, 1))
    shards = _Shards(max(1, math.ceil(((size.tokens or 0) - in_split) / pairs_per_shard)), math.ceil(in_split / pairs_per_shard), pairs_per_shard)

    own = send(made.select("chunk", "lengths", "train", "tokens", "doc_ids"), _chunk_message)
    asked = words.where("dest >= 0")
    requests = by_key(own.unionByName(asked), lambda name, rows: _pair_requests(name, rows, train_docs, shards), MESSAGE)
    merged = durable(by_key(requests, lambda shard, rows: _merge_pairs(shard, rows, shard >= shards.whole), MESSAGE), "pairs")
    d = discount(*counts_of_counts(merged))
    whole, split = (merged.where((F.col("dest") >= first) & (F.col("dest") < last)) for first, last in ((0, shards.whole), (shards.whole, shards.n)))
    seated = durable(by_key(whole, lambda shard, rows: _seat_whole(shard, rows, d, n_train, word_shards), MESSAGE), "seated")
    if shards.split:
        state, mean = in_rounds(merged, split.where("kind = 6"), lambda rows, state: _context_restaurants(rows, state, d, n_train), 0, shards.split == 1)
        answers = by_key(split.unionByName(state), lambda shard, rows: _answer_split(shard, rows, d, n_train, word_shards, mean), MESSAGE)
        seated = seated.unionByName(durable(answers, "seated"))

    parents = seated.where("kind = 4").withColumn("dest", -2 - F.col("dest"))
    tables = durable(by_key(parents, lambda shard, rows: _merge_tables(shard, rows, word_shards), MESSAGE), "tables")
    customers = tables.where("dest = -2").select(number("a").alias("c")).first().c or 0
    above = discount(*counts_of_counts(tables))
    held = tables.where("dest >= 0")
    state, mean = in_rounds(tables, held, lambda rows, state: _word_restaurant(rows, state, above, n_distinct), 1, word_shards == 1)
    waiting = asked.select(F.col("src").alias("dest"), "kind", F.col("dest").alias("src"), "a", *[F.lit(None).cast("binary").alias(c) for c in "bcd"])
    parent = by_key(held.unionByName(state).unionByName(waiting), lambda shard, rows: _word_kept(shard, rows, above, n_distinct, word_shards), MESSAGE)
    totals = {"n_train": n_train, "distinct": n_distinct, "train_docs": train_docs, "customers": customers, "passed": above * float(mean.values.sum())}

    everything = own.unionByName(asked).unionByName(seated.where("kind = 3")).unionByName(parent)
    return by_key(everything, lambda name, rows: _scores(name, rows, totals, shards), SCORES)
