"""Two tokenizers' tokens of the same bytes, aligned over a corpus.

The bytes of a text are cut where tokens of both tokenizers end; tokens between two cuts form a
group, and every pair of its A and B tokens is a link. A group of one token each covers the same
bytes, so a table made once from A id to the B id of the same bytes names its pair: these links are
counted in arrays as long as the vocabulary. Only pairs of other groups are counted by a shuffle.
Pairs that hold a thousandth of the documents are few and held by every task; the others are joined.

A blank ahead of a non-blank is a border of both tokenizers, so the words of a slice of texts are
encoded and aligned once each; texts with blanks in a row, at an end, or with U+2581 go whole.

Texts that are null, empty, or whose tokens do not spell them have no tokens. Repeated rows count as
documents of their own. Empty tables give empty results. Only `doc_id` and `text` are read.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm.common import held_by_worker, schema_of
from tallyloom.llm.token_counts import byte_symbols
from tallyloom.session import durable

#: Pairs every task holds in memory at most, and one in how many documents makes a pair common.
HEAD_PAIRS = 500_000
COMMON = 1000
#: Pair keys held by a counting task before they are summed.
_HELD = 2_000_000
_SMALL = 64
#: Units a worker remembers before it starts anew.
_UNITS = 250_000
#: Bytes of text aligned at a time, but for a longer text, and units encoded at a time.
_SLICE_BYTES = 1_500_000
_BLOCK = 8192


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start .. start + length of each entry, one after the other."""
    total = int(lengths.sum())
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else starts, lengths)
    return np.arange(total, dtype=np.int64) + shift


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of `values`, some of them empty."""
    ends = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    at = np.cumsum(lengths)
    return ends[at] - ends[at - lengths]


class Pair:
    """Both tokenizers of a process, and the units of texts aligned by them."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True  # their strings in a text are then ordinary text
        self.a_bytes, self.b_bytes = a_spelling(self.a), b_spelling(self.b)
        self.a_size = np.array(list(map(len, self.a_bytes)), np.int64)
        self.b_size = np.array(list(map(len, self.b_bytes)), np.int64)
        self.identity = identity_map(self.a_bytes, self.b_bytes)
        most = max(len(self.a_bytes), len(self.b_bytes))
        marks = (",", "|", ";")
        self.marked = [f"{i}{mark}".encode() for mark in marks for i in range(most)]
        self.most = most
        self.slots: dict[str, int] = {}
        self.units: Units | None = None

    def known(self, units: list[str]) -> Units:
        """The units met so far, those of the list among them at their `slots`.

        More than so many are dropped before a slice; that bounds memory, never results.
        """
        if len(self.slots) > _UNITS:
            self.slots, self.units = {}, None
        fresh = [u for u in dict.fromkeys(units) if u not in self.slots]
        if fresh or self.units is None:
            fresh.sort(key=lone, reverse=True)
            self.slots.update(zip(fresh, range(len(self.slots), len(self.slots) + len(fresh))))
            found = self.align(fresh)
            self.units = found if self.units is None else self.units.extended(found)
        return self.units

    def align(self, units: list[str]) -> Units:
        """The groups of each unit, a text that begins with the blank both tokenizers see ahead of it."""
        good, a_parts, b_parts = [], [], []
        for first in range(0, len(units), _BLOCK):  # the libraries' own objects live for a block
            block = units[first:first + _BLOCK]
            raw = [u.encode() for u in block]
            a, a_n = self._a_ids(block, raw)
            b, b_n = _flat(self.b.encode([u[1:] for u in block], num_threads=1))
            fine = _spells(self.a_bytes, self.a_size, a, a_n, raw) & _spells(self.b_bytes, self.b_size, b, b_n, raw)
            fine &= np.fromiter(map(len, raw), np.int64, len(raw)) > 1
            good.append(fine)
            a_parts.append((a[np.repeat(fine, a_n)], np.where(fine, a_n, 0)))
            b_parts.append((b[np.repeat(fine, b_n)], np.where(fine, b_n, 0)))
        return Units(self, _joined(good, bool), *[_joined(part, np.int64) for parts in (a_parts, b_parts) for part in (zip(*parts) if parts else ((), ()))])

    def _a_ids(self, block: list[str], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units and how many each has; units that end at borders are encoded in one text."""
        if all(map(lone, block)):
            ids = np.array(self.a.encode_batch_fast(["".join(block)], add_special_tokens=False)[0].ids, np.int64)
            ends, want = np.cumsum(self.a_size[ids]), np.cumsum(list(map(len, raw)))
            at = np.searchsorted(ends, want)
            if at[-1] == len(ends) - 1 and (ends[at] == want).all():
                return ids, np.diff(at, prepend=-1)
        return _flat([e.ids for e in self.a.encode_batch_fast(block, add_special_tokens=False)])


def lone(unit: str) -> bool:
    """Whether a unit's only blank is the one ahead of a non-blank."""
    return len(unit) > 1 and unit.rfind(" ") == 0


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int64, int(lengths.sum())), lengths


def _joined(parts, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *parts])


def _spells(table: list[bytes], sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray, raw: list[bytes]) -> np.ndarray:
    """Which units are spelled by their tokens; a block that is right as a whole needs no look at each."""
    same = sums(sizes[ids], lengths) == np.fromiter(map(len, raw), np.int64, len(raw))
    words = list(map(table.__getitem__, ids.tolist()))
    if same.all() and b"".join(words) == b"".join(raw):
        return same
    ends = np.cumsum(lengths).tolist()
    return np.array([b"".join(words[end - n:end]) == unit for end, n, unit in zip(ends, lengths.tolist(), raw)], bool)


def a_spelling(a: Tokenizer) -> list[bytes]:
    """The bytes of each A id, its entry decoded from the byte-level stand-ins."""
    back = {c: b for b, c in byte_symbols().items()}
    out = []
    for i in range(a.get_vocab_size(with_added_tokens=True)):
        entry = a.id_to_token(i) or ""
        known = all(c in back for c in entry)
        out.append(bytes(back[c] for c in entry) if known else entry.encode())
    return out


def b_spelling(b: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """The bytes of each B id: U+2581 is a blank, `<0xHH>` a byte."""
    out = []
    for i in range(b.piece_size()):
        piece = b.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
    return out


def identity_map(a_bytes: list[bytes], b_bytes: list[bytes]) -> np.ndarray:
    """Per A id the first B id of the same bytes, or -1."""
    first: dict[bytes, int] = {}
    for i, spelled in enumerate(b_bytes):
        if spelled:
            first.setdefault(spelled, i)
    return np.array([first.get(spelled, -1) for spelled in a_bytes], np.int64)


class Units:
    """Aligned units: per unit its counts, its text of groups, its one-to-one A ids, its other pairs."""

    def __init__(self, pair: Pair, good: np.ndarray, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray):
        self.good, self.n_a, self.n_b = good, n_a, n_b
        # all units in a row: tokens end at places of one line of bytes
        a_end, b_end = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
        cuts = np.intersect1d(a_end, b_end, assume_unique=True)
        a_last, b_last = np.searchsorted(a_end, cuts), np.searchsorted(b_end, cuts)
        p, q = np.diff(a_last, prepend=-1), np.diff(b_last, prepend=-1)
        a_owner = np.repeat(np.arange(len(good)), self.n_a)
        owner = a_owner[a_last]
        self.n_groups = np.bincount(owner, minlength=len(good))
        self.n_links = np.bincount(owner, weights=p * q, minlength=len(good)).astype(np.int64) if len(p) and int((p * q).max()) < 1 << 40 else _exact(owner, p * q, len(good))
        self._texts(pair, a, b, a_last, b_last, p, q)
        one = (p == 1) & (q == 1)
        one[one] = pair.identity[a[a_last[one]]] == b[b_last[one]]
        self.ident, self.ident_n = a[a_last[one]], np.bincount(owner[one], minlength=len(good))
        self._pairs(a, b, a_last, b_last, p, q, owner, ~one)

    def extended(self, more: Units) -> Units:
        for name, own in vars(self).items():
            new = getattr(more, name)
            setattr(self, name, own + new if isinstance(own, list) else np.concatenate((own, new)))
        return self

    def _texts(self, pair, a, b, a_last, b_last, p, q) -> None:
        """`a1,a2|b1;` of each group; a unit's groups are neighbours."""
        codes = np.empty(len(a) + len(b), np.int64)
        a_group = np.repeat(np.arange(len(p)), p)
        b_group = np.repeat(np.arange(len(q)), q)
        a_mark, b_mark = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_mark[a_last], b_mark[b_last] = 1, 2
        b_before = np.cumsum(q) - q
        codes[np.arange(len(a)) + b_before[a_group]] = a + a_mark * pair.most
        codes[np.arange(len(b)) + np.cumsum(p)[b_group]] = b + b_mark * pair.most
        words = list(map(pair.marked.__getitem__, codes.tolist()))
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        self.texts, at = [], 0
        for end in ends:
            self.texts.append(b"".join(words[at:end]))
            at = end

    def _pairs(self, a, b, a_last, b_last, p, q, owner, odd) -> None:
        """Distinct pairs of the other groups with their number of links, by unit."""
        at = np.flatnonzero(odd)
        small = at[p[at] * q[at] <= _SMALL]
        a_first, b_first = a_last - p + 1, b_last - q + 1
        n = p[small] * q[small]
        place = ragged(np.zeros(len(small), np.int64), n)
        width = np.repeat(q[small], n)
        left = a[np.repeat(a_first[small], n) + place // np.maximum(width, 1)]
        right = b[np.repeat(b_first[small], n) + place % np.maximum(width, 1)]
        owners, lefts, rights, times = [np.repeat(owner[small], n)], [left], [right], [np.ones(len(left), np.int64)]
        for g in at[p[at] * q[at] > _SMALL].tolist():  # a large group: its distinct ids meet, not its tokens
            x, xn = np.unique(a[a_first[g]:a_last[g] + 1], return_counts=True)
            y, yn = np.unique(b[b_first[g]:b_last[g] + 1], return_counts=True)
            owners.append(np.full(len(x) * len(y), owner[g]))
            lefts.append(np.repeat(x, len(y)))
            rights.append(np.tile(y, len(x)))
            times.append(np.outer(xn, yn).ravel())
        who, left, right, n = map(np.concatenate, (owners, lefts, rights, times))
        order = np.argsort(who, kind="stable")
        self.left, self.right, self.times = left[order], right[order], n[order]
        self.pair_n = np.bincount(who, minlength=len(self.good))


def _exact(owner: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    np.add.at(out, owner, values)
    return out


def units_of(text: str | None) -> list[str]:
    """The units of a text; a text whose blanks may not be borders is one unit."""
    text = text or ""
    if "  " in text or "▁" in text or "\0" in text or text[:1] == " " or text[-1:] == " ":
        return [" " + text]
    return (" " + text).replace(" ", "\0 ").split("\0")[1:]


def pair_of(a_path: str, b_path: str) -> Pair:
    return held_by_worker(("aligned pair", a_path, b_path), lambda: Pair(a_path, b_path))


ALIGNED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "ident array<int>, ident_n array<long>, left array<int>, right array<int>, times array<long>"
)


def _lists(values: np.ndarray, owner: np.ndarray, rows: int, kind) -> pa.Array:
    offsets = np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(values, kind))


def align_slice(pair: Pair, names: pa.Array, texts: list[str | None], fields: pa.Schema) -> pa.RecordBatch:
    """One row per text: its counts, and its links as distinct pairs with their numbers."""
    found, lengths = [], []
    for text in texts:
        mine = units_of(text)
        lengths.append(len(mine))
        found += mine
    units = pair.known(found)
    slots = list(map(pair.slots.__getitem__, found))
    slot, size = np.array(slots, np.int64), np.array(lengths, np.int64)
    doc = np.repeat(np.arange(len(texts)), size)
    good = sums(~units.good[slot], size) == 0
    keep = good[doc]
    ends = np.cumsum(size)
    hashes = []
    for i in range(len(texts)):
        if good[i]:
            text = b"".join(map(units.texts.__getitem__, slots[ends[i] - lengths[i]:ends[i]]))
            hashes.append(hashlib.sha256(text[:-1]).hexdigest())
        else:
            hashes.append("")
    slot, doc = slot[keep], doc[keep]
    size = np.where(good, size, 0)
    totals = {name: pa.array(sums(getattr(units, name)[slot], size), pa.int64()) for name in ("n_a", "n_b", "n_groups", "n_links")}
    # one-to-one groups, and with them the same pairs where they occur in other groups
    ident = units.ident[ragged((np.cumsum(units.ident_n) - units.ident_n)[slot], units.ident_n[slot])]
    ident_doc = np.repeat(doc, units.ident_n[slot])
    at = ragged((np.cumsum(units.pair_n) - units.pair_n)[slot], units.pair_n[slot])
    left, right, times, pair_doc = units.left[at], units.right[at], units.times[at], np.repeat(doc, units.pair_n[slot])
    same = pair.identity[left] == right
    many = len(pair.a_bytes)
    ident_key, ident_n = _summed(
        np.concatenate((ident_doc * many + ident, pair_doc[same] * many + left[same])),
        np.concatenate((np.ones(len(ident), np.int64), times[same])),
    )
    wide = len(pair.b_bytes)
    pair_key, pair_n = _summed(((pair_doc * many + left) * wide + right)[~same], times[~same])
    rows = len(texts)
    pair_left = pair_key // wide
    return pa.RecordBatch.from_arrays([
        names.cast(pa.int64()), *totals.values(), pa.array(hashes, pa.string()),
        _lists(ident_key % many, ident_key // many, rows, pa.int32()), _lists(ident_n, ident_key // many, rows, pa.int64()),
        _lists(pair_left % many, pair_left // many, rows, pa.int32()), _lists(pair_key % wide, pair_left // many, rows, pa.int32()),
        _lists(pair_n, pair_left // many, rows, pa.int64()),
    ], schema=fields)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of values of each."""
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, _exact(at, values, len(distinct))


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per row the counts and links of its text, and its place `row` in the written table."""
    fields = schema_of(ALIGNED)

    def run(batches):
        pair = pair_of(a_path, b_path)
        for batch in batches:
            size = pc.binary_length(batch.column("text")).to_numpy()
            part = (np.cumsum(size) - size) // _SLICE_BYTES
            edges = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
            for first, end in zip(edges, edges[1:]):
                rows = batch.slice(first, end - first)
                yield align_slice(pair, rows.column("doc_id"), rows.column("text").to_pylist(), fields)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return durable(rows.mapInArrow(run, ALIGNED).withColumn("row", F.monotonically_increasing_id()), "aligned")


def pair_counts(rows: DataFrame, identity: np.ndarray, wide: int) -> DataFrame:
    """`a, b, n`: how many documents hold a pair linked; B ids are below `wide`."""
    kind = "a int, b int, n long"
    fields = schema_of(kind)

    def run(batches):
        vector, held, size = np.zeros(len(identity), np.int64), [], 0

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys // wide, pa.int32()), pa.array(keys % wide, pa.int32()), pa.array(n, pa.int64())], schema=fields)

        for batch in batches:
            vector += np.bincount(batch.column("ident").flatten().to_numpy(), minlength=len(vector))
            left = batch.column("left").flatten().to_numpy().astype(np.int64)
            held.append(left * wide + batch.column("right").flatten().to_numpy())
            size += len(left)
            if size > _HELD:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()
        ids = np.flatnonzero(vector)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(identity[ids], pa.int32()), pa.array(vector[ids], pa.int64())], schema=fields)

    return rows.select("ident", "left", "right").mapInArrow(run, kind).groupBy("a", "b").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, a_path: str, b_path: str, head: int = HEAD_PAIRS, common: int = COMMON) -> DataFrame:
    """Per row `doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`.

    `n_best` counts links whose pair is in most documents among the pairs of its A id, ties
    included; `count_sum` sums over links how many documents hold the pair.
    """
    spark = docs.sparkSession
    rows = aligned(docs, a_path, b_path)
    pair = Pair(a_path, b_path)
    identity, wide = pair.identity, len(pair.b_bytes)
    counts = durable(pair_counts(rows, identity, wide), "pair-counts")
    # as many rows as the vocabulary has ids
    best = F.broadcast(counts.groupBy("a").agg(F.max("n").alias("most")))
    counts = durable(counts.join(best, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")
    same = spark.createDataFrame(pa.table({"a": pa.array(np.arange(len(identity)), pa.int32()), "b": pa.array(identity, pa.int32())}))
    one = counts.join(F.broadcast(same), ["a", "b"], "left_semi")
    rest = counts.join(F.broadcast(same), ["a", "b"], "left_anti")
    bound = max(1, rows.count() // common)
    while (kept := rest.where(F.col("n") >= bound)).count() > head:
        bound *= 2
    vector = _vector(one, len(identity))
    top = kept.select((F.col("a").cast("long") * wide + F.col("b")).alias("key"), "n", "best").orderBy("key").toArrow()
    shared = spark.sparkContext.broadcast((*vector, *[top.column(c).to_numpy() for c in ("key", "n", "best")]))
    kind = (
        "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, "
        "left array<int>, right array<int>, times array<long>"
    )
    fields = schema_of(kind)

    def run(batches):
        n_of, best_of, key, n_pair, best_pair = shared.value
        for batch in batches:
            column = {name: batch.column(name) for name in batch.schema.names}
            size = _lengths(column["ident"])
            ids, times = column["ident"].flatten().to_numpy(), column["ident_n"].flatten().to_numpy()
            n_best, count_sum = sums(times * best_of[ids], size), sums(times * n_of[ids], size)
            size = _lengths(column["left"])
            left, right, times = (column[c].flatten().to_numpy() for c in ("left", "right", "times"))
            keys = left.astype(np.int64) * wide + right
            at = np.minimum(np.searchsorted(key, keys), max(0, len(key) - 1))
            held = key[at] == keys if len(key) else np.zeros(len(keys), bool)
            at, doc = at[held], np.repeat(np.arange(len(size)), size)
            n_best += sums(_spread(held, times[held] * best_pair[at]), size)
            count_sum += sums(_spread(held, times[held] * n_pair[at]), size)
            out = [column[c] for c in ("doc_id", "row", "n_a", "n_b", "n_groups", "n_links")]
            out += [pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), column["groups_sha256"]]
            out += [_lists(values[~held], doc[~held], len(size), t) for values, t in ((left, pa.int32()), (right, pa.int32()), (times, pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, schema=fields)

    scored = durable(rows.mapInArrow(run, kind), "scored")
    rare = scored.where(F.size("left") > 0).select("row", F.explode(F.arrays_zip("left", "right", "times")).alias("p"))
    rare = rare.select("row", F.col("p.left").alias("a"), F.col("p.right").alias("b"), F.col("p.times").alias("times"))
    found = rare.join(rest.where(F.col("n") < bound), ["a", "b"]).groupBy(F.col("row").alias("_row")).agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum")
    )
    total = lambda own, more: (F.col(own) + F.coalesce(more, F.lit(0))).cast("long").alias(own)
    return scored.drop("left", "right", "times").join(found, F.col("row") == F.col("_row"), "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", total("n_best", "_best"), total("count_sum", "_sum"), "groups_sha256"
    )


def _lengths(lists: pa.Array) -> np.ndarray:
    return np.diff(lists.offsets.to_numpy()).astype(np.int64)


def _spread(held: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(held), np.int64)
    out[held] = values
    return out


def _vector(one: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents per one-to-one pair, and whether it is its A id's best; as long as the vocabulary."""
    n, best = np.zeros(size, np.int64), np.zeros(size, bool)
    table = one.select("a", "n", "best").toArrow()
    ids = table.column("a").to_numpy()
    n[ids], best[ids] = table.column("n").to_numpy(), table.column("best").to_numpy()
    return n, best
