"""Near-duplicates by banded MinHash with odd sketches, confirmed on full sets.

1. Per document: the set of word shingles, MinHash samples, band keys, and an odd sketch (each
   sample flips one bit of a bitmap; the population count of two sketches' XOR estimates how
   many samples differ, precisely so for high similarities). A second bitmap is flipped by the
   whole set: two sets differ in at least as many shingles as the bitmaps differ in bits.
2. Equal sets are folded into the document with the smallest id.
3. Sets that share a band are candidates. In a bucket each member is first held against the
   bucket's smallest id, so a group of n copies costs n comparisons. Then only members that these
   links left outside their bucket's main component are held against the others.
4. A candidate pair goes on if sizes allow the threshold and the sketches do not rule it out
   (six standard deviations of slack for the samples, none needed for the bound of the whole
   sets), and is confirmed on the full sets of both texts.
5. Components of the confirmed links by alternating star steps on edge tables.

With 32 bands of 4 rows a pair at similarity 0.8 shares no band with probability 5e-8.
Null and empty texts have an empty set and no link. Rows that share a doc_id are one document. A
row with a null id has no link and a null component. No group is gathered in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import WordCache, body, map_rows, mix, schema_of
from tallyloom.session import durable

BANDS = 32
ROWS = 4
SKETCH_WORDS = 8
THRESHOLD = 0.8
FILTER_BITS = 1 << 24
_PAIR_BYTES = 8_000_000

_SEEDS = np.random.default_rng(20).integers(1, 1 << 32, (2, BANDS * ROWS), dtype=np.uint64).astype(np.uint32) | np.uint32(1)


class Shingler:
    """Distinct 64-bit shingle hashes of lower-cased texts."""

    def __init__(self, width: int):
        self.width = width
        self.words = WordCache(lambda ws: [xxhash.xxh3_64_intdigest(w) for w in ws], 100_000)

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        lists = [t.lower().split() for t in texts]
        table = self.words.fill(lists)
        return [self._set(np.fromiter((table[w] for w in ws), np.uint64, len(ws))) for ws in lists]

    def _set(self, words: np.ndarray) -> np.ndarray:
        if not len(words):
            return words
        n = min(self.width, len(words))
        size = len(words) - n + 1
        code = np.full(size, n, np.uint64)
        for shift in range(n):
            code = mix(code ^ words[shift:shift + size])
        return np.unique(code)


def samples(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash samples, a row per (non-empty) set."""
    flat = np.concatenate(sets)
    low, starts = flat.astype(np.uint32), np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), BANDS * ROWS), np.uint32)
    held = np.empty(len(low), np.uint32)
    for i in range(BANDS * ROWS):
        np.bitwise_xor(low, _SEEDS[0, i], out=held)
        np.multiply(held, _SEEDS[1, i], out=held)
        out[:, i] = np.minimum.reduceat(held, starts)
    return out


def bands(sampled: np.ndarray) -> np.ndarray:
    """Keys of the bands, the band's number being part of the key."""
    parts = sampled.reshape(len(sampled), BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sampled), BANDS)).copy()
    for i in range(ROWS):
        keys = mix(keys ^ (parts[:, :, i] + (np.uint64(i) << np.uint64(40))))
    return keys.view(np.int64)


def odd_sketches(sampled: np.ndarray) -> np.ndarray:
    """Parity bitmaps of SKETCH_WORDS 64-bit words."""
    place = np.arange(sampled.shape[1], dtype=np.uint64) << np.uint64(32)
    bit = (mix(sampled.astype(np.uint64) | place) % np.uint64(64 * SKETCH_WORDS)).astype(np.int64)
    flips = np.zeros((len(sampled), 64 * SKETCH_WORDS), np.uint8)
    np.add.at(flips, (np.arange(len(sampled))[:, None], bit), 1)
    return np.packbits(flips & 1, axis=1, bitorder="little").view(np.int64)


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """Parity bitmaps of SKETCH_WORDS 64-bit words, flipped by every member of a (non-empty) set."""
    width = np.uint64(64 * SKETCH_WORDS)
    owner = np.repeat(np.arange(len(sets), dtype=np.uint64) * width, [len(s) for s in sets])
    flips = np.bincount((owner + np.concatenate(sets) % width).astype(np.int64), minlength=len(sets) * int(width))
    return np.packbits((flips & 1).astype(np.uint8).reshape(len(sets), -1), axis=1, bitorder="little").view(np.int64)


def most_odd_bits(threshold: float) -> int:
    """Odd bits that a pair at the threshold stays below, six standard deviations above its mean."""
    k, n = BANDS * ROWS, 64 * SKETCH_WORDS
    differ = k * (1 - threshold) + 6 * math.sqrt(k * threshold * (1 - threshold))
    p = (1 - math.exp(-4 * min(differ, k) / n)) / 2
    return math.ceil(n * p + 6 * math.sqrt(n * p * (1 - p)))


SIGNATURE = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sketch array<long>"


def signatures(docs: DataFrame, width: int) -> DataFrame:
    fields = schema_of(SIGNATURE)

    def run(batches):
        sets_of = Shingler(width)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            at = 0
            while at < len(ids):
                end, held = at, 0
                while end < len(ids) and (held < 2_000_000 or end == at):
                    held += len(texts[end])
                    end += 1
                yield pa.RecordBatch.from_pylist(_signed(ids[at:end], sets_of(texts[at:end])), schema=fields)
                at = end

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text")).mapInArrow(run, SIGNATURE)


def _signed(ids: list, sets: list[np.ndarray]) -> list[dict]:
    full = [s for s in sets if len(s)]
    if full:
        sampled = samples(full)
        keys, odd = iter(bands(sampled).tolist()), iter(np.hstack([odd_sketches(sampled), parities(full)]).tolist())
    out = []
    for name, s in zip(ids, sets):
        row = {"doc_id": name, "n_shingles": len(s)}
        if len(s):
            other = mix(s + np.uint64(1))
            row |= {"h1": int(s.sum(dtype=np.uint64).view(np.int64)), "h2": int(np.bitwise_xor.reduce(other).view(np.int64)),
                    "bands": next(keys), "sketch": next(odd)}
        out.append(row)
    return out


def _sizes_allow(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _sketches_allow(a: Column, b: Column, na: Column, nb: Column, percent: int) -> Column:
    """Sets of `na` and `nb` shingles at the threshold differ in (100 - percent) / (100 + percent) of their sum at most."""

    def odd(first: int) -> Column:
        return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(first, first + SKETCH_WORDS)), F.lit(0))

    return (odd(0) <= most_odd_bits(percent / 100)) & ((100 + percent) * odd(SKETCH_WORDS) <= (100 - percent) * (na + nb))


def _likely(texts: DataFrame, named: DataFrame) -> DataFrame:
    """Rows of `texts` whose `_doc` may be an `_id` of `named`, by a bitmap of at most FILTER_BITS bits.

    None that is named is lost; the joins that follow drop the few others. The bitmap stays small
    enough for Spark's own broadcast at any size, so the other texts are dropped where they are read.
    """
    at = F.pmod(F.xxhash64("_id"), F.lit(FILTER_BITS))
    words = named.select(F.shiftright(at, 6).alias("_word"), (at % 64).cast("int").alias("_bit")).groupBy("_word").agg(
        F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits")
    )
    own = F.pmod(F.xxhash64("_doc"), F.lit(FILTER_BITS))
    met = texts.join(durable(words, "named"), F.shiftright(own, 6) == F.col("_word"))
    return met.where(F.getbit("_bits", (own % 64).cast("int")) == 1).select(*texts.columns)


def _confirm(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs `a, b` whose full sets reach the threshold; texts travel for their documents only."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("_id"))
    texts = _likely(docs.select(F.col("doc_id").cast("long").alias("_doc"), body().alias("text")), named)
    left, right = texts.select(F.col("_doc").alias("_a"), F.col("text").alias("ta")), texts.select(F.col("_doc").alias("_b"), F.col("text").alias("tb"))
    joined = pairs.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b")).select("a", "b", "ta", "tb")

    def make():
        sets_of, held = Shingler(width), {}

        def shingles(name, text):
            """The last few sets are kept: a leader meets many members."""
            key = (name, len(text))
            if key not in held or held[key][0] != text:
                if len(held) > 64:
                    held.clear()
                held[key] = (text, sets_of([text])[0])
            return held[key][1]

        def step(rows):
            out = []
            for r in rows:
                x, y = shingles(r["a"], r["ta"]), sets_of([r["tb"]])[0]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and 100 * both >= percent * (len(x) + len(y) - both):
                    out.append({"a": r["a"], "b": r["b"]})
            return out

        return step

    return map_rows(joined, make, "a long, b long", _PAIR_BYTES).distinct()


def components(edges: DataFrame) -> DataFrame:
    """`id, component`: the smallest id each node of `edges(a, b)` reaches, by alternating star steps."""
    current = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    current = durable(current, "stars")
    while not _is_star_forest(current):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("c")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lows = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        small = large.join(lows, F.col("u") == F.col("c")).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        current = durable(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct(), "stars")
    return current.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every `u` has one `v` and no `v` is a `u` itself: then each `v` is its component's smallest id."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("id"), F.lit(1).alias("child")), F.struct(F.col("v").alias("id"), F.lit(0).alias("child"))
    )).alias("e")).groupBy("e.id").agg(F.sum("e.child").alias("children"), F.min("e.child").alias("least"))
    return not ends.where("children > 1 or children = 1 and least = 0").limit(1).count()


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """`doc_id, n_shingles, component_id, kept` of every row; the smallest id of a component is kept."""
    percent = round(threshold * 100)
    signed = durable(signatures(docs, width), "signatures")
    key = ["n_shingles", "h1", "h2"]
    real = signed.where("n_shingles > 0 and doc_id is not null")
    reps = real.groupBy(*key).agg(F.min("doc_id").alias("rep")).select(*[F.col(k).alias(f"_{k}") for k in key], "rep")
    matched = real.join(reps, (F.col("n_shingles") == F.col("_n_shingles")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")))
    own = F.col("doc_id") == F.col("rep")
    members = durable(matched.select("doc_id", "n_shingles", "rep", F.when(own, F.col("bands")).alias("bands"), F.when(own, F.col("sketch")).alias("sketch")), "members")
    sets = members.where("bands is not null")

    rows = sets.select(F.col("rep"), F.explode("bands").alias("key"))
    shared = rows.groupBy(F.col("key").alias("_key")).agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1")
    buckets = durable(rows.join(shared, F.col("key") == F.col("_key")).select("key", "rep", "leader"), "buckets")
    figures = sets.select(F.col("rep").alias("_rep"), F.col("n_shingles").alias("_n"), F.col("sketch").alias("_sketch"))

    def candidates(pairs: DataFrame) -> DataFrame:
        a = figures.withColumnsRenamed({"_rep": "_ra", "_n": "_na", "_sketch": "_sa"})
        b = figures.withColumnsRenamed({"_rep": "_rb", "_n": "_nb", "_sketch": "_sb"})
        return pairs.join(a, F.col("a") == F.col("_ra")).join(b, F.col("b") == F.col("_rb")).where(
            _sizes_allow(F.col("_na"), F.col("_nb"), percent) & _sketches_allow(F.col("_sa"), F.col("_sb"), F.col("_na"), F.col("_nb"), percent)
        ).select("a", "b").distinct()

    stars = buckets.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = durable(candidates(stars), "pairs")
    # rows that share an id but not their text belong together
    low = members.groupBy(F.col("doc_id").alias("_doc")).agg(F.min("rep").alias("_low"), F.max("rep").alias("_high")).where("_low <> _high")
    repeated = members.join(low, F.col("doc_id") == F.col("_doc")).select(F.col("_low").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()
    links = durable(_confirm(docs, pairs, width, percent).unionByName(repeated), "links")
    found = durable(components(links), "components")

    rest = durable(_cross_pairs(buckets, found, figures, percent), "rest")
    if rest.limit(1).count():
        more = _confirm(docs, rest, width, percent)
        found = durable(components(links.unionByName(more)), "components")

    labels = members.select(F.col("doc_id").alias("_doc"), "rep").join(found, F.col("rep") == F.col("id"), "left").groupBy("_doc").agg(
        F.min(F.coalesce("component", "rep")).alias("_component")
    )
    out = signed.select("doc_id", "n_shingles").join(labels, F.col("doc_id") == F.col("_doc"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("_component", "doc_id").alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def _cross_pairs(buckets: DataFrame, found: DataFrame, figures: DataFrame, percent: int) -> DataFrame:
    """Pairs inside buckets that the stars left in different components and that may be alike.

    Of each bucket only rows outside its most frequent component meet the others; sizes and
    sketches are compared inside the join, so what it puts out are pairs that are likely alike.
    """
    placed = buckets.join(found, F.col("rep") == F.col("id"), "left").select("key", "rep", "leader", F.coalesce("component", "rep").alias("component"))
    counts = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = counts.groupBy(F.col("key").alias("_key")).agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts"), F.sum("n").alias("total"))
    mixed = durable(
        placed.join(main.where("parts > 1 and total > 2"), F.col("key") == F.col("_key")).where("rep <> leader")
        .join(figures, F.col("rep") == F.col("_rep")).select("key", "rep", "component", "main", F.col("_n").alias("n"), F.col("_sketch").alias("sketch")),
        "mixed",
    )
    x = mixed.where("component <> main").select(F.col("key").alias("kx"), F.col("rep").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"), F.col("sketch").alias("sx"))
    met = x.join(mixed, (F.col("kx") == F.col("key")) & (F.col("cx") != F.col("component"))
                 & _sizes_allow(F.col("nx"), F.col("n"), percent) & _sketches_allow(F.col("sx"), F.col("sketch"), F.col("nx"), F.col("n"), percent))
    return met.select(F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b")).distinct()


def drop_near_duplicates(docs: DataFrame, width: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """One row of `docs` per component; of rows that share the kept id the first by text stays."""
    verdict = near_duplicates(docs, width, threshold).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    joined = docs.join(verdict, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")
    again = durable(docs.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1 and _id is not null"), "again")
    if again.isEmpty():  # else the texts would travel once more for a branch without rows
        return joined
    single = joined.join(again, F.col("doc_id") == F.col("_id"), "left_anti")
    several = joined.join(again, F.col("doc_id") == F.col("_id"), "left_semi")
    fields = [c for c in docs.columns]
    first = several.groupBy(F.col("doc_id").alias("_id")).agg(F.min_by(F.struct(*fields), F.struct("text", "source")).alias("_row")).select("_row.*")
    return single.unionByName(first)
