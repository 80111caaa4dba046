"""The parts that need no session: token counts, codes, unit encoder, page blocks, seating, features."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tallyloom.llm import html, language_model, quality, token_files
from tallyloom.llm.classifier import text_features, train
from tallyloom.llm.common import WordCache
from tallyloom.llm.token_counts import RankMerger

ODD = ["", "it's I'LL 12345 été ΑΣ İx 你好 😀", "x<|endoftext|>y <|startoftext|>", " a  b\n\n c\t.", "a\x1cb\x85c", "aaaaaaa" * 200,
       "a b.\nC, d", " ...", "q ,r", "tail ", "\nhead"]


def noise(seed, letters, n=300):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(letters) for _ in range(30)) for _ in range(n)]


def test_counts_as_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [*ODD, *noise(1, "ab'sé1 .\n,ñ日<|>"), None]
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert RankMerger(path).counts(texts) == want


def test_units_as_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [*ODD, *noise(2, "ab'sé1 .\n,ñ日<|")]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in token_files.UnitEncoder(path)(texts)] == want


def test_codes_round_trip_and_random_access():
    rnd = np.random.default_rng(3)
    ids = np.concatenate([rnd.integers(0, 50257, 5000), rnd.integers(0, 200, 3000), [0, 255, 256, 65535, 65536, 2**32 - 1]])
    codes = token_files.Codes(token_files.encode(ids))
    assert codes.slice(0, len(ids)).tolist() == ids.tolist()
    assert all(codes[i] == ids[i] for i in range(0, len(ids), 37)) and codes[len(ids) - 1] == 2**32 - 1
    assert codes.slice(4321, 7654).tolist() == ids[4321:7654].tolist() and len(codes.slice(9, 9)) == 0
    assert token_files.Codes(token_files.encode(ids[:0])).size == 0


def test_page_blocks():
    page = ('<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><a>m</a></nav><div class="ad">buy</div>'
            '<article><h1>A &amp; B</h1><p><b>one<br><p>two  \n words</p><div class="comments"><p>hi</p></div></article><footer>f</footer></body></html>')
    assert html.page_texts([[tuple(b) for b in html.blocks(page)]], 6, 3) == ["A & B\n\none\n\ntwo words"]
    assert html.blocks("") == [] and [b.text for b in html.blocks("plain <i>te</i>xt &am")] == ["plain text &am"]
    assert [b.text for b in html.blocks("<article><p>cut <script>never closed")] == ["cut"]


def test_furniture_of_a_host_without_articles():
    menu = "home news sport weather travel money"
    pages = [[(menu, 0), (f"{i} own text {i * 7} of the page", 0)] for i in range(4)]
    assert html.page_texts(pages, 6, 3) == [f"{i} own text {i * 7} of the page" for i in range(4)]
    assert html.page_texts([[(menu, 2)] for _ in range(4)], 6, 3) == [menu] * 4


def test_repeated_windows_against_a_plain_count():
    rnd = random.Random(5)
    pages = [[rnd.randrange(3) for _ in range(rnd.randrange(0, 25))] for _ in range(9)]
    where = {}
    for k, p in enumerate(pages):
        for i in range(len(p) - 3):
            where.setdefault(tuple(p[i:i + 4]), set()).add(k)
    for p, covered in zip(pages, html.repeated_windows(pages, 4, 3)):
        want = [any(len(where[tuple(p[i:i + 4])]) >= 3 for i in range(max(0, j - 3), min(j, len(p) - 4) + 1)) for j in range(len(p))]
        assert covered.tolist() == want


def test_seating_follows_the_process():
    draw = np.random.default_rng(6)
    tables, _ = language_model.seat(np.full(20_000, 200), 0.5, np.full(20_000, 1.0), np.full(20_000, 0.5), draw)
    t, mean = np.ones(20_000), np.random.default_rng(7)
    for i in range(1, 200):
        new = 1.0 + 0.5 * t
        t += mean.random(20_000) * (i - 0.5 * t + new) < new
    assert abs(tables.mean() / t.mean() - 1) < 0.02 and tables.max() <= 200
    assert language_model.seat(np.array([1]), 0.5, np.ones(1), np.ones(1), draw)[0].tolist() == [1.0]


def test_figures():
    text = "a b c a b c\n x#\n\na b c a b c\n".encode()
    found = quality.figures(text)
    assert (found["n_words"], found["n_symbols"], found["n_dup_lines"], found["word_chars"]) == (13, 1, 1, 14)
    assert found["n_repeat_words"] == 12 and quality.figures(b"")["lines"] == []
    assert quality.strip_lines(b"Keep me\nDROP  it\n", {quality.line_hash(b"drop it")}) == b"Keep me\n"


def test_classifier_learns():
    rnd = random.Random(8)
    good = [" ".join(rnd.choice(("river", "stone", "green", "walk")) for _ in range(30)).encode() for _ in range(40)]
    bad = [g.upper().replace(b" ", b"!! ") for g in good]
    model = train(good + bad, [1] * 40 + [0] * 40, epochs=4)
    value = lambda t: float((model[text_features(t)[0]] * text_features(t)[1]).sum() + model[-1])
    assert min(map(value, good)) > max(map(value, bad)) and np.isfinite(value(b""))


def test_texts_are_cut_in_their_bytes():
    path = public_tokenizers.path("byte_bpe_50k.json")
    draw = random.Random(3)
    signs = "ab Zé×÷ß.,\n \t\0_'1٣ \u0085 ¿漢x-! 　ª"
    texts = ["".join(draw.choices(signs, k=draw.randrange(12))) for _ in range(4000)]
    texts += [" ".join("".join(draw.choices("abéÃñx1", k=3)) + draw.choice(["", ",", ".", "!!"]) for _ in range(draw.randrange(15))) for _ in range(500)]
    given = pa.array(["cut off", *texts, "cut off"])[1:-1]
    offsets = np.frombuffer(given.buffers()[1], np.int32)[1:len(texts) + 2].astype(np.int64)
    data = np.frombuffer(given.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    _, ask = token_files.cut(data, offsets - offsets[0])
    assert all(a or token_files.certain(t) for t, a in zip(texts, ask)) and not ask.all()
    work = token_files.UnitEncoder(path)
    want = [e.ids for e in work.library.encode_batch(texts, add_special_tokens=False)]
    for kind in (pa.string(), pa.large_string()):
        ids, counts = work.encode(given.cast(kind))
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
    assert [len(x) for x in work.encode(pa.array(["", ""]))] == [0, 2]
    assert [len(x) for x in work.encode(pa.array([], pa.string()))] == [0, 0]


def test_cache_values_over_generations():
    asked = []
    cache = WordCache(lambda words: asked.extend(words) or [w.upper() for w in words], 4)
    for words in (["a", "b", "c"], ["c", "a"], ["d", "e"], ["a", "d"], ["f", "g", "h", "i", "j"], []):
        assert cache.values(words) == [w.upper() for w in words]
    assert asked == ["a", "b", "c", "d", "e", "f", "g", "h", "i", "j"] and len(cache.now) + len(cache.before) <= 9
