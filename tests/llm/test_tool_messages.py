"""Every text of the conversations reaches the result of the chat query."""

from collections import Counter

from tallyloom.llm import chat, queries


def test_no_text_is_left_out(spark):
    ids = [None, 0, 1, 3, 4, 7, 11, 13, 23, 42]
    turns = [(0, "user"), (1, "assistant"), (2, "tool"), (3, None), (4, "assistant")]
    rows = [(c, t, role, f"text {c} {t}") for c in ids for t, role in turns]
    schemas = spark.createDataFrame(list(queries.TOOLS), "tool string, argument string, type string, required boolean")
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    linked = chat.link(queries.tool_messages(given), schemas).collect()
    for c, _, role, text in rows:
        kind = "result" if role == "assistant" else "message"
        assert [r.conv_id for r in linked if r.kind == kind and f'"content":"{text}"' in r.line] == [c], (c, role)
    assert Counter(r.kind for r in linked) == {"message": 30, "call": 20, "result": 20}
    for c in ids:
        found = Counter(r.status for r in linked if r.kind == "result" and r.conv_id == c)
        assert found == ({"orphan": 2} if c in (3, 13, 23) else {"linked": 2})
    assert all(r.status != "linked" for r in linked if r.kind == "call" and r.conv_id in (3, 13, 23))
    assert any(r.status == "unanswered" for r in linked if r.kind == "call")
