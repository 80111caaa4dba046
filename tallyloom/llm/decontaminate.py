"""Benchmark decontamination with a generalised suffix automaton over item words.

Items are cut into blocks of bounded size. A block's automaton is built where it is used, from
the block's broadcast words, and every document is streamed through it: the automaton's state
gives the longest item run that ends at each word. Blocks are passed one after the other over
the same rows, so nothing is shuffled and a document's size only matters to its own task.

Null or empty texts have no words. An item without words has no window; a null item id is
written as the empty string. Repeated items and repeated rows are judged alike. Columns of the
input that share a name with an output column are replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import body, ddl_of, map_rows, schema_of
from tallyloom.session import durable

WINDOW = 10
#: Words of benchmark items in one automaton; beyond it the items are dealt over more passes.
BLOCK_WORDS = 100_000
PIECE_WORDS = 5_000

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(
    low if (low := b + 32 if 65 <= b <= 90 else b) in _KEEP or b >= 0x80 else 0x20 for b in range(256)
)
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Automaton:
    """All item words; `scan` streams a document and reports hit runs and the items met."""

    def __init__(self, items: list[tuple[str, list[bytes], bool]], window: int):
        """`items`: id, words, and whether the words are all of a short item."""
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for item, words, short in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            coded.append((item, ids, short))
            last = 0
            for token in ids:
                last = self._extend(last, token)
        self.shortest = min((len(ids) for _, ids, _ in coded), default=window)
        self.shortest = min(self.shortest, window)
        self._at_window: dict[int, int] = {}
        self.items: dict[int, set[str]] = {}
        self.whole: dict[int, set[tuple[int, str]]] = {}
        for item, ids, short in coded:
            if short:
                state = 0
                for token in ids:
                    state = self.next[state][token]
                self.whole.setdefault(state, set()).add((len(ids), item))
            else:
                for _, state, _ in self._steps(ids):
                    self.items.setdefault(state, set()).add(item)

    def _extend(self, last: int, token: int) -> int:
        """Append a token after `last`, reusing what an earlier item has built."""
        nxt, link, length = self.next, self.link, self.length
        if token in nxt[last]:
            old = nxt[last][token]
            return old if length[old] == length[last] + 1 else self._split(last, token, old)
        new = self._state(length[last] + 1, {})
        at = last
        while at >= 0 and token not in nxt[at]:
            nxt[at][token] = new
            at = link[at]
        if at < 0:
            link[new] = 0
        else:
            old = nxt[at][token]
            link[new] = old if length[old] == length[at] + 1 else self._split(at, token, old)
        return new

    def _state(self, length: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, at: int, token: int, old: int) -> int:
        copy = self._state(self.length[at] + 1, dict(self.next[old]))
        self.link[copy], self.link[old] = self.link[old], copy
        while at >= 0 and self.next[at].get(token) == old:
            self.next[at][token] = copy
            at = self.link[at]
        return copy

    def _window_state(self, state: int) -> int:
        """The state that holds the last `window` words of what `state` holds."""
        found = self._at_window.get(state)
        if found is None:
            found = state
            while self.length[self.link[found]] >= self.window:
                found = self.link[found]
            self._at_window[state] = found
        return found

    def _steps(self, ids):
        """(position, window state or the state itself, matched length) where a window ends."""
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        for at, token in enumerate(ids):
            while state and token not in nxt[state]:
                state = link[state]
                matched = length[state]
            if token in nxt[state]:
                state = nxt[state][token]
                matched += 1
            if matched >= self.window:
                yield at, self._window_state(state), matched

    def _short_ends(self, ids):
        """(position, words, item) of whole short items that end at a position."""
        nxt, link, length, whole = self.next, self.link, self.length, self.whole
        state = matched = 0
        for at, token in enumerate(ids):
            while state and token not in nxt[state]:
                state = link[state]
                matched = length[state]
            if token in nxt[state]:
                state = nxt[state][token]
                matched += 1
            up = state
            while up > 0:
                for size, item in whole.get(up, ()):
                    if size <= matched:
                        yield at, size, item
                up = link[up]

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str], int]:
        """Hit runs [first, last], items met and the longest match."""
        known = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (known >= 0).astype(np.int8), [0]))))
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= self.shortest
        ends_at: list[tuple[int, int]] = []
        met: set[str] = set()
        longest = 0
        for first, end in zip(starts[long].tolist(), ends[long].tolist()):
            run = known[first:end].tolist()
            for at, state, matched in self._steps(run):
                ends_at.append((first + at - self.window + 1, first + at))
                met |= self.items.get(state, set())
                longest = max(longest, matched)
            if self.whole:
                for at, size, item in self._short_ends(run):
                    ends_at.append((first + at - size + 1, first + at))
                    met.add(item)
                    longest = max(longest, size)
        return union(ends_at), met, longest


def union(runs) -> list[list[int]]:
    """Merge runs [first, last] that overlap or touch."""
    out: list[list[int]] = []
    for first, last in sorted(map(tuple, runs)):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def _pieces(benchmark: DataFrame, window: int, blocks: int) -> DataFrame:
    """Item pieces that overlap by window - 1 words, dealt over the blocks."""

    def make():
        def step(rows):
            out = []
            for row in rows:
                words = words_of(row["_text"])
                hop = max(1, PIECE_WORDS - window + 1)
                for first in range(0, max(1, len(words) - window + 1) if words else 0, hop):
                    part = words[first:first + hop + window - 1]
                    key = f"{row['_item']}/{first}".encode()
                    out.append({"block": zlib.crc32(key) % blocks, "item": row["_item"],
                                "words": b" ".join(part), "short": len(words) < window})
            return out

        return step

    rows = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("_item"), body().alias("_text")
    )
    return map_rows(rows, make, "block int, item string, words binary, short boolean")


_BUILT: dict[str, Automaton] = {}


def _automaton(key: str, pieces: list, window: int) -> Automaton:
    """One automaton is kept per worker, for the block at hand."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton([(item, words.split(b" "), short) for item, words, short in pieces], window)
    return _BUILT[key]


_STATE = "_spans array<array<int>>, _items array<string>, _longest int"
_FOUND = ("n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, longest_match int,"
          " spans array<array<int>>, contaminated boolean, rejected boolean")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_span: int = 1,
    max_coverage: float = 0.5, block_words: int = BLOCK_WORDS, texts: bool = True,
) -> DataFrame:
    """Documents with `n_words`, `n_hit`, `n_items`, `items`, `items_sha256`, `longest_match`,
    `spans` (word runs that items cover), `contaminated`, `rejected` and `clean_text`.

    Runs of at least `min_span` words are cut from `clean_text`; a document whose hit share is
    above `max_coverage` is marked `rejected`. Without `texts`, neither `text` nor `clean_text`
    is returned. The broadcast of a block is checked against its size.
    """
    spark = docs.sparkSession
    size = benchmark.select(F.sum(F.length(body()))).first()[0] or 0
    blocks = max(1, math.ceil(size / (block_words * 6)))
    pieces = _pieces(benchmark, window, blocks)
    if blocks > 1:
        pieces = durable(pieces, "items")
    state = docs
    for block in range(blocks):
        part = [(r.item, bytes(r.words), r.short) for r in pieces.where(F.col("block") == block).toLocalIterator()]
        held = sum(len(w) for _, w, _ in part)
        if held > 8 * (block_words * 6 + PIECE_WORDS * 64):
            raise ValueError(f"block {block} holds {held} bytes; lower block_words")
        matcher = (f"{uuid.uuid4().hex}-{block}", spark.sparkContext.broadcast(part), window)
        if block + 1 < blocks:
            state = _pass(state, matcher, [*docs.columns], _STATE, None)
        else:
            names = [c for c in docs.columns if texts or c != "text"]
            state = _pass(state, matcher, names, _FOUND + ", clean_text string" * texts, (min_span, max_coverage))
    return state


def _pass(state: DataFrame, matcher: tuple, names: list[str], added: str, limits: tuple | None) -> DataFrame:
    """Stream the documents through one block; `limits` on the last pass, which judges them."""
    new = T.StructType.fromDDL(added)
    kept = [f for f in state.schema.fields if f.name in names and f.name not in new.names]
    schema = T.StructType([*kept, *new.fields])
    fields = schema_of(ddl_of(schema))
    key, block, window = matcher
    continued = "_spans" in state.columns

    def run(batches):
        scan = _automaton(key, block.value, window).scan
        for batch in batches:
            texts = batch.column("text").to_pylist()
            before = zip(*(batch.column(c).to_pylist() for c in ("_spans", "_items", "_longest"))) if continued else repeat((None, None, 0))
            out: dict[str, list] = {n: [] for n in new.names}
            for text, (spans, items, longest) in zip(texts, before):
                raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
                words = words_of(raw)
                found, met, most = scan(words)
                if found:
                    spans, items, longest = union([*(spans or []), *found]), sorted({*(items or []), *met}), max(longest, most)
                row = _judged(words, spans or [], items or [], longest, *limits) if limits else (spans, items, longest)
                for name, value in zip(new.names, row):
                    out[name].append(value)
                if limits and "clean_text" in out:
                    out["clean_text"].append(_cut(raw, spans, limits[0]) if spans else text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[f.name], f.type) if f.name in out else batch.column(f.name).cast(f.type) for f in fields],
                schema=fields,
            )

    read = state.select(*[c for c in state.columns if c in names or c == "text" or c.startswith("_")])
    return read.mapInArrow(run, schema)


def _judged(words: list, spans: list, items: list, longest: int, min_span: int, max_coverage: float) -> tuple:
    n, hit = len(words), sum(b - a + 1 for a, b in spans)
    digest = hashlib.sha256(",".join(items).encode()).hexdigest()
    return n, hit, len(items), items, digest, longest, spans, hit > 0, hit > max_coverage * n


def _cut(raw: bytes, spans, min_span: int) -> str:
    """The text without the runs of at least `min_span` words."""
    lowered = raw.lower()
    at = [(m.start(), m.end()) for m in _WORD.finditer(lowered)]
    kept, last = [], 0
    for first, end in spans:
        if end - first + 1 >= min_span:
            kept.append(raw[last:at[first][0]])
            last = at[end][1]
    return b"".join([*kept, raw[last:]]).decode("utf-8", "replace")
