"""Token counts by rank-synchronous merging over ragged numpy arrays.

The pre-tokens of a batch lie in one flat symbol array with an owner per symbol. In each round
every pre-token finds the lowest merge rank among its adjacent pairs and applies that pair at all
its places at once, left to right; the symbols that survive are its tokens. Pre-tokens settled
before are remembered per worker, up to a bounded number.

Null texts are empty and have no token. Repeated rows are counted alike.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm.common import WordCache, map_rows

LIMIT = 2048
_SPACE = regex.compile(r"[\t-\r \x85\p{Z}]+")


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte: printable Latin-1 bytes as they are, others from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class RankMerger:
    """Merge tables of a vocabulary file, and the tokens of whole texts by them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = self.vocabulary
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self._special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self._split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        symbols = byte_symbols()
        self._byte = {c: b for b, c in symbols.items()}
        self._library = Tokenizer.from_file(path)
        self._inner = np.array([ids[symbols[b]] for b in range(256)], np.int64)
        self._last = np.array([ids[symbols[b] + self.suffix] for b in range(256)], np.int64)
        self._words = WordCache(self._settle)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of adjacent symbols, or a value above all ranks."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], len(self.keys))

    def merge(self, words: list[bytes]) -> np.ndarray:
        """The number of symbols left of each pre-token once no pair has a rank."""
        sizes = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        owner = np.repeat(np.arange(len(words)), sizes)
        symbols = self._inner[flat]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self._last[flat[ends]]
        counts = np.ones(len(words), np.int64)
        none = len(self.keys)
        while len(symbols):
            same = owner[1:] == owner[:-1]
            rank = np.full(len(symbols), none, np.int64)
            rank[:-1][same] = self._rank(symbols[:-1][same], symbols[1:][same])
            starts = np.flatnonzero(np.concatenate(([True], ~same)))
            best = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(symbols)))
            done = best == none
            counts[owner[starts[done]]] = lengths[done]
            live = np.repeat(~done, lengths)
            hit = live & (rank == np.repeat(best, lengths)) & (rank < none)
            # in a run of overlapping places every second one, from the left, is taken
            at = np.flatnonzero(hit)
            if len(at):
                fresh = np.concatenate(([True], np.diff(at) != 1))
                first = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
                symbols[at] = self.merged[rank[at]]
                live[at + 1] = False
            symbols, owner = symbols[live], owner[live]
        return counts

    def _pretokens(self, word: str) -> list[bytes]:
        """Characters whose class depends on the Unicode version are left to the library's own rules."""
        if _RARE.search(word):
            found = self._library.pre_tokenizer.pre_tokenize_str(word)
            return [bytes(map(self._byte.__getitem__, piece)) for piece, _ in found]
        return [p.encode() for p in self._split.findall(word)]

    def normal(self, text: str) -> str:
        """NFC, white space as blanks, lower case letter by letter."""
        if text.isascii():
            return text.lower()
        if _RARE.search(text):
            return self._library.normalizer.normalize_str(text)
        return unicodedata.normalize("NFC", text).lower()

    def counts(self, texts: list[str | None]) -> list[int]:
        """The tokens of each text; special strings count one each."""
        split, extra = [], []
        for text in texts:
            text = text or ""
            parts, specials = [text], 0
            if self._special and "<|" in text:
                specials = len(self._special.findall(text))
                parts = self._special.split(text)
            words: list[str] = []
            for part in parts:
                part = self.normal(part)
                words += part.split() if part.isascii() and not _ODD.search(part) else _SPACE.split(part)
            split.append(words)
            extra.append(specials)
        table = self._words.fill(split)
        return [sum(map(table.__getitem__, words)) + n for words, n in zip(split, extra)]

    def _settle(self, words: list[str]) -> list[int]:
        """The tokens of each word."""
        pieces = [self._pretokens(w) for w in words]
        flat = [p for ps in pieces for p in ps]
        owner = np.repeat(np.arange(len(words)), [len(p) for p in pieces]) if words else np.zeros(0, np.int64)
        found = np.zeros(len(words), np.int64)
        for first in range(0, len(flat), 50_000):
            part = flat[first:first + 50_000]
            np.add.at(found, owner[first:first + len(part)], self.merge(part))
        return found.tolist()


_RARE = regex.compile("[\u0250-\u1fff\u2070-\U0010ffff]")
#: str.split() also cuts at these separators, which the pattern does not take as white space.
_ODD = regex.compile("[\x1c-\x1f]")
_MERGERS: dict[str, RankMerger] = {}


def merger(path: str) -> RankMerger:
    if path not in _MERGERS:
        _MERGERS[path] = RankMerger(path)
    return _MERGERS[path]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """`doc_id, n_bytes, n_tokens, over_limit` of every row; null texts count as empty.

    `path` is a tokenizer file that every executor has at the same place. Other columns of the
    input are not read.
    """

    def make():
        model = merger(path)

        def step(rows):
            out = []
            for first in range(0, len(rows), 1000):
                part = rows[first:first + 1000]
                for row, n in zip(part, model.counts([r["text"] for r in part])):
                    out.append({"doc_id": row["doc_id"], "n_tokens": n, "n_bytes": len((row["text"] or "").encode()),
                                "over_limit": n > limit})
            return out

        return step

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    return map_rows(rows, make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
