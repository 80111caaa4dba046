"""Aligned tokens of two tokenizers against a plain version, document by document."""

import hashlib
import json
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def spelled():
    """The bytes of A's entries, from the vocabulary file alone."""
    with open(A, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return {i: bytes(stand[c] for c in entry) for entry, i in vocabulary.items() if all(c in stand for c in entry)}


def plain(texts):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    a_bytes = spelled()
    docs = []
    for text in texts:
        ids, pieces = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        said = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in pieces]
        want = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes[i] for i in ids) != want or b"".join(said) != want:
            docs.append(None)
            continue
        groups, i, j, x, y, left, right = [], 0, 0, 0, 0, [], []
        while i < len(ids) or j < len(pieces):
            if x <= y and i < len(ids):
                x += len(a_bytes[ids[i]])
                left.append(ids[i])
                i += 1
            else:
                y += len(said[j])
                right.append(pieces[j])
                j += 1
            if x == y:
                groups.append((left, right))
                left, right = [], []
        docs.append(groups)
    held = Counter()
    for groups in docs:
        held.update({(p, q) for left, right in groups or [] for p in left for q in right})
    best = Counter()
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    out = []
    for groups in docs:
        if groups is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(p, q) for left, right in groups for p in left for q in right]
        text = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in groups)
        out.append((
            sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
            sum(held[link] == best[link[0]] for link in links), sum(held[link] for link in links), hashlib.sha256(text.encode()).hexdigest(),
        ))
    return out


def texts():
    rng = random.Random(4)
    odd = ["a", "Z", "é", "ß", "中", "文", "🦤", "́", "\n", "\t", "\r\n", " ", "  ", " ", "　", ".", ",", "--", "==", "1", "42", "'s", "▁", "\x00", "\x1c", "<|endoftext|>", "</s>", "<0x0A>", "the ", " of", "Wörter ", "ſ"]
    made = ["".join(rng.choice(odd) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    words = [" ".join(rng.choice(["alpha", "beta,", "Unglück.", "x\ny", "naïve", "übermorgen", "supercalifragilistic", "l'été", "3.14"]) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    return [*made, *words, *words[:5], None, "", " ", "\n", "=" * 5001, "-" * 4099 + "a", "ab" * 3000, "中文" * 900]


@pytest.fixture(scope="module")
def made():
    found = texts()
    return found, plain(found)


@pytest.mark.parametrize("settings", [{}, {"head": 20, "common": 1}, {"head": 0}])
def test_alignment_is_the_plain_one(spark, made, settings):
    given, want = made
    rows = [(i, t, f"s{i}", 1, 2) for i, t in enumerate(given)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, left int, n_a int").repartition(3)
    found = {r[0]: tuple(r[1:]) for r in alignment.align(docs, A, B, **settings).collect()}
    assert len(found) == len(rows)
    wrong = {i: (given[i], found[i], want[i]) for i in range(len(rows)) if found[i] != want[i]}
    assert not wrong, list(wrong.values())[:2]


def test_repeated_null_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "one two"), (1, "one two"), (1, "one two"), (2, None)], "doc_id long, text string")
    found = alignment.align(docs, A, B).collect()
    assert sorted((r.doc_id or 0, r.n_a, r.n_best, r.count_sum) for r in found) == [(0, 2, 2, 6), (1, 2, 2, 6), (1, 2, 2, 6), (2, 0, 0, 0)]
    assert alignment.align(docs.limit(0), A, B).count() == 0


def test_large_groups_count_every_pair():
    """Runs whose tokens never end together are one group of many tokens."""
    pair = alignment.pair_of(A, B)
    units = pair.align([" " + "=" * 5001, " the"])
    assert units.n_links[0] >= units.n_a[0] and int(units.times.sum()) + int(units.ident_n.sum()) == int(units.n_links.sum())
