"""Nulls, empty tables, repeated rows and clashing names through the table operators."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tallyloom.llm import chat, common, language_model, mixing, token_files

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_token_files_round_trip(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i * 3 % 50, f"word {i}, next. line\nof text {'x' * (i % 9)}", None, "s", 1) for i in range(50)] + [(7, None, None, None, None), (None, "first", None, None, None)]
    folder = str(tmp_path / "tokens")
    token_files.write_token_files(spark.createDataFrame(rows, DOCS), folder, path, segment_tokens=64)
    got = [tuple(r) for r in token_files.read_token_files(spark, folder).orderBy("start").collect()]
    library, at, want = Tokenizer.from_file(path), 0, []
    for doc, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


def test_a_worker_keeps_its_encoder_until_files_are_read_back(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")

    def look(batches):
        for _ in batches:
            pass
        work = token_files.encoder(path)
        met = int(" unit" in work.units.now)
        work.units.values([" unit"])
        yield pa.RecordBatch.from_pylist([{"met": met}])

    tasks = spark.range(40).repartition(40).mapInArrow(look, "met long").collect()
    assert {r.met for r in tasks} == {0, 1} and sum(r.met for r in tasks) >= 8
    first = token_files.encoder(path)
    assert token_files.encoder(path) is first
    common.dropped_by_worker("unit encoder")
    assert token_files.encoder(path) is not first
    common.dropped_by_worker("unit encoder")


def test_mix(spark):
    rows = [(i, "w " * (i % 7), "x", ("b" if i % 3 else "a"), 0) for i in range(300)] + [(900, None, None, None, None), (901, "one", None, None, 1), (901, "one", None, None, 1)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS rate", "2 AS _copies_")
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows) and all(r.taken <= 3 * r.size for r in found)
    targets = {r.source: (r.source_size, r.target) for r in found}
    assert abs(sum(t for _, t in targets.values()) - sum(s for s, _ in targets.values())) < 1e-6
    assert all(t <= 3 * s for s, t in targets.values()) and targets[None] == (2, 6.0)
    for source, (size, target) in targets.items():
        assert abs(sum(r.taken for r in found if r.source == source) - target) <= 0.1 * target + 6
    assert mixing.emit(docs).count() == sum(r.copies for r in found) and mixing.emit(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0


def test_chat(spark):
    m = [(1, 0, "user", "hi"), (1, 1, "assistant", '{"tool_calls":[{"id":"c","name":"t","arguments":{"q":"1","after":"d"}},{"id":"d","name":"t","arguments":{"q":"x"}}]}'),
         (1, 0, "tool", '{"tool_call_id":"c","content":"r\\"1"}'), (1, 5, "tool", '{"tool_call_id":"zz","content":"?"}'), (None, None, None, None), (2, 0, "user", "{broken")]
    s = spark.createDataFrame([("t", "q", "integer", True)], "tool string, argument string, type string, required boolean")
    rows = chat.link(spark.createDataFrame(m, "conv_id long, turn long, role string, text string"), s).collect()
    one = sorted((r for r in rows if r.conv_id == 1), key=lambda r: tuple(r.place))
    assert [(r.kind, r.call_id, r.status) for r in one] == [
        ("message", None, "plain"), ("call", "d", "invalid"), ("call", "c", "invalid"), ("result", "c", "linked"), ("result", "zz", "orphan")]
    assert one[2].errors == ["unknown after"] and one[1].errors == ["not integer q"]
    assert one[3].line == '{"content":"r\\"1","id":"c","role":"tool"}'
    assert len(rows) == 7


def test_language_model_on_nulls_and_nothing(spark):
    docs = spark.createDataFrame([(i, "a b c a b" if i % 2 else "c d", "x") for i in range(40)] + [(50, None, "x"), (None, "", "x")], "doc_id long, text string, score string")
    rows = language_model.score_texts(docs, chunk_tokens=30).collect()
    assert len(rows) == 42 and all(r.score <= 0 and r.train_tokens == rows[0].train_tokens for r in rows)
    known = [r for r in rows if r.doc_id is not None and r.doc_id < 40]
    assert sum(r.score for r in known if r.held_out) > sum(r.base_score for r in known if r.held_out)
    assert sum(r.n_tokens for r in rows if not r.held_out) == rows[0].train_tokens
    assert language_model.score_texts(docs.limit(0)).count() == 0
