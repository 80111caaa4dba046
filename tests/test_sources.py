"""Listings with empty and absent files, and calls typed into a text."""

import json

import pytest

from tallyloom.operators import intake
from tallyloom.sources import readers
from tallyloom.sources.listing import list_files


def test_line_counts_of_full_empty_absent_and_hidden(spark, tmp_path):
    (tmp_path / "a" / "deep").mkdir(parents=True)
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "deep" / "three.jsonl").write_text('{"x":1}\n\n{"x":2}\r\n  \n{"x":3}')
    (tmp_path / "a" / "empty.jsonl").write_text("")
    (tmp_path / "plain.txt").write_text("one\ntwo\n")
    listed = {r.uri.rsplit("/", 1)[1]: r.bytes for r in list_files(spark, str(tmp_path)).collect()}
    assert listed == {"three.jsonl": 28, "empty.jsonl": 0, "plain.txt": 8}
    base = f"file://{tmp_path}"
    claims = [f"{base}/a/deep/three.jsonl", f"{tmp_path}/a/empty.jsonl", f"{base}/plain.txt", f"{base}/gone.jsonl", f"{base}/a/", f"{base}/b/", "kb-77", None, f"{base}/plain.txt"]
    facts = readers.line_count_facts(spark, str(tmp_path), spark.createDataFrame([(c,) for c in claims], "uri string")).collect()
    assert len(facts) == len(claims)
    got = {r.uri: (r.status, r.bytes, r.rows) for r in facts}
    assert got == {
        claims[0]: ("verified", 28, 3), claims[1]: ("verified", 0, 0), claims[2]: ("verified", 8, None), claims[3]: ("failed", None, None),
        claims[4]: ("verified", None, None), claims[5]: ("failed", None, None), "kb-77": ("asserted", None, None), None: ("asserted", None, None)}


def test_a_folder_that_cannot_be_listed_leaves_claims_unverified(spark, tmp_path, monkeypatch):
    (tmp_path / "open").mkdir()
    (tmp_path / "open" / "x.jsonl").write_text("{}\n")
    hidden = spark.createDataFrame([(f"file://{tmp_path}/shut/", None, "denied"), (f"file://{tmp_path}/open/x.jsonl", 3, None)], "uri string, bytes bigint, error string")
    monkeypatch.setattr(readers, "list_files", lambda *_: hidden)
    claims = spark.createDataFrame([(f"file://{tmp_path}/shut/deep/y.jsonl",), (f"file://{tmp_path}/open/x.jsonl",)], "uri string")
    got = {r.uri.rsplit("/", 1)[1]: (r.status, r.detail, r.rows) for r in readers.line_count_facts(spark, str(tmp_path), claims).collect()}
    assert got == {"y.jsonl": ("unverified", "denied", None), "x.jsonl": ("verified", None, 1)}
    assert [r.error is None for r in list_files(spark, str(tmp_path / "nowhere")).collect()] == [False]


DEEP = "{" + '"a": {' * 40 + '"b": "}"' + "}" * 41
TURNS = [
    ('x <invoke name="stage_complete">\n<parameter name="outputs"> ["a", {"k": 1}] </parameter><parameter name="note">it\'s "so"</parameter></invoke>', "recovered", "stage_complete", {"outputs": ["a", {"k": 1}], "note": 'it\'s "so"'}),
    ('<invoke name="job_launched"><parameter name="a">1</parameter><parameter name="b">t</parameter><parameter name="a">2</parameter></invoke>', "recovered", "job_launched", {"a": 2, "b": "t"}),
    ('<invoke name="stage_complete"></invoke>', "recovered", "stage_complete", {}),
    (f"stage_complete(**{DEEP})", "recovered", "stage_complete", json.loads(DEEP)),
    (f"say escalate_human( {{\"why\": \"a \\\" {{ brace\"}} ) and **stage_complete**: ```json\n{DEEP}\n```", "recovered", "stage_complete", json.loads(DEEP)),
    ('stage_complete({"a": 1}) then stage_complete({"a": ', "recovered", "stage_complete", {"a": 1}),
    ("**stage_complete** and nothing", "prose", None, None),
    ("**checkpoint** please", "recovered", "checkpoint", {}),
    ('shell({"a": 1}) my_stage_complete({"a": 1}) stage_completely({"a": 1})', "prose", None, None),
    ('stage_complete({"a": 1} "unclosed', "recovered", "stage_complete", {"a": 1}),
    ('stage_complete({"a": "never closed \\', "prose", None, None),
    ("stage_complete({'a': 1})", "prose", None, None),
    (None, "prose", None, None), ("", "prose", None, None),
]


@pytest.mark.parametrize("text, end, call, arguments", TURNS)
def test_typed_calls(spark, text, end, call, arguments):
    row = intake.classify_turns(spark.createDataFrame([(text, None)], "text string, tool_name string")).first()
    assert (row.turn_end, row.call) == (end, call)
    assert (json.loads(row.arguments) if row.arguments else None) == arguments
