"""Order and status of linked calls against a plain version, on random conversations, chains and rings."""

import json
import random
from functools import cache

from tallyloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, place int, kind string, key string"
TOOLS = [("t", "after", "string", False), ("t", "n", "integer", True)]


def call(name, after=None, **arguments):
    return {"id": name, "name": "t", "arguments": {**arguments, **({} if after is None else {"after": after})}}


def linked(spark, messages):
    given = spark.createDataFrame([(*m, 9, "x", "y") for m in messages], SCHEMA)
    schemas = spark.createDataFrame(TOOLS, "tool string, argument string, type string, required boolean")
    return chat.link(given, schemas).collect()


def low(value):
    return (value is not None, value or 0)


def plain(messages):
    """(conv, kind, call id, status, place) of every message, call and result."""
    calls, results, out = [], [], []
    for conv, turn, _, text in messages:
        try:
            m = json.loads(text or "")
        except ValueError:
            m = {}
        if m.get("tool_calls"):
            calls += [(conv, turn, i, c) for i, c in enumerate(m["tool_calls"])]
        elif m.get("tool_call_id") is not None:
            results.append((conv, turn, m["tool_call_id"]))
        else:
            out.append((conv, "message", None, "plain", (turn, 0, 0, 0, turn)))
    first, answer = {}, {}
    for conv, turn, i, c in calls:
        if c["id"] is not None:
            after = c["arguments"].get("after")
            at = (low(turn), i, (after is not None, after or ""))
            first[conv, c["id"]] = min(first.get((conv, c["id"]), (at, turn)), (at, turn), key=lambda x: x[0])
    for conv, turn, name in results:
        answer[conv, name] = min(answer.get((conv, name), low(turn)), low(turn))
    needs = {k: [(k[0], n) for n in set(at[2][1].split(",")) if at[2][0] and n != k[1] and (k[0], n) in first] for k, (at, _) in first.items()}

    reach = {k: set(v) for k, v in needs.items()}
    while any(len(reach[k]) < len(reach[k] | {y for x in reach[k] for y in reach[x]}) for k in reach):
        reach = {k: v | {y for x in v for y in reach[x]} for k, v in reach.items()}
    stuck = {k for k, v in reach.items() if any(x in reach[x] for x in v | {k})}

    @cache
    def best(k):
        own = (low(first[k][1]), 0)
        return own if k in stuck else max([own, *[(at, depth + 1) for at, depth in map(best, needs[k])]])

    turn_of = lambda low_turn: low_turn[1] if low_turn[0] else None
    for conv, turn, i, c in calls:
        k, bad = (conv, c["id"]), not str(c["arguments"].get("n", "")).isdigit()
        if c["id"] is None:
            out.append((conv, "call", None, "invalid", (turn, 0, i, 1, turn)))
            continue
        at, depth = best(k)
        status = "duplicate" if first[k][0][:2] != (low(turn), i) else "invalid" if bad or k in stuck else "linked" if k in answer else "unanswered"
        out.append((conv, "call", c["id"], status, (turn_of(at), depth, i, 1, turn)))
    for conv, turn, name in results:
        k = (conv, name)
        place, status = (turn, 0, 0, 2, turn), "orphan"
        if k in first:
            (at, depth), status = best(k), "linked" if answer[k] == low(turn) else "duplicate"
            if low(turn) <= at:
                place = (turn_of(at), depth, first[k][0][1], 2, turn)
        out.append((conv, "result", name, status, place))
    return out


def as_rows(found):
    return sorted(((r.conv_id, r.kind, r.call_id, r.status, tuple(r.place)) for r in found), key=repr)


def test_random_conversations(spark):
    rnd = random.Random(11)
    messages = []
    for conv in [None, *range(60)]:
        names = [f"c{i}" for i in range(rnd.randrange(1, 14))]
        rings = conv is None or conv % 3 == 0  # elsewhere calls wait for later names only
        for turn in [None, *(t // 3 for t in range(rnd.randrange(1, 16)))]:
            kind = rnd.random()
            if kind < 0.6:
                some = []
                for _ in range(rnd.randrange(1, 4)):
                    at = rnd.randrange(len(names))
                    others = names if rings else names[at + 1:]
                    after = ",".join(rnd.sample(others, min(len(others), rnd.randrange(0, 4)))) or None
                    some.append(call(None if rnd.random() < 0.02 else names[at], after, n=rnd.choice(["1", "2", "x"])))
                messages.append((conv, turn, "assistant", json.dumps({"tool_calls": some})))
            elif kind < 0.9:
                messages.append((conv, turn, "tool", json.dumps({"tool_call_id": rnd.choice([*names, "zz"]), "content": "r"})))
            else:
                messages.append((conv, turn, "user", rnd.choice(["hi", "", None, "{", "{}"])))
    messages += rnd.sample(messages, 30)
    want = plain(messages)
    assert {s for _, _, _, s, _ in want} == {"plain", "invalid", "duplicate", "unanswered", "linked", "orphan"}
    assert max(p[1] for *_, p in want) > 2
    assert as_rows(linked(spark, messages)) == sorted(want, key=repr)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    cuts = []
    durable = chat.durable
    monkeypatch.setattr(chat, "durable", lambda df, name="cut": cuts.append(name) or durable(df, name))
    last = 10_000
    chain = [(1, i, "assistant", json.dumps({"tool_calls": [call(f"c{i}", f"c{i + 1}" if i < last else None, n="1")]})) for i in range(last + 1)]
    random.Random(3).shuffle(chain)
    found = linked(spark, chain)
    assert {(r.call_id, r.place.turn, r.place.depth) for r in found} == {(f"c{i}", last, last - i) for i in range(last + 1)}
    assert cuts.count("waits") <= 17


def test_rings_keep_their_turn(spark):
    ring = [call(f"c{i}", f"c{(i + 1) % 40}", n="1") for i in range(40)]
    joints = [call(x, after, n="1") for x, after in (("x", "y,z"), ("y", "x,z"), ("z", "x,y"))]
    others = [call("in", "c7", n="1"), call("self", "self", n="1"), call("free", None, n="1"), call("on", "free,gone", n="1")]
    messages = [(1, i, "assistant", json.dumps({"tool_calls": [c]})) for i, c in enumerate([*ring, *joints, *others])]
    found = {r.call_id: r for r in linked(spark, messages)}
    stuck = {c["id"] for c in [*ring, *joints, others[0]]}
    assert {k for k, r in found.items() if r.errors == ["waits in a ring"] and r.status == "invalid"} == stuck
    assert all((r.place.turn, r.place.depth) == (r.place.own, 0) for k, r in found.items() if k in stuck)
    assert found["self"].status == "unanswered" and found["on"].place.depth == 0 and found["on"].place.turn == 46


def test_no_rows(spark):
    assert linked(spark, [(1, 1, "user", "x")])[0].line == '{"content":"x","role":"user"}'
    nothing = spark.createDataFrame([], SCHEMA)
    schemas = spark.createDataFrame([], "tool string, argument string, type string, required boolean")
    assert chat.link(nothing, schemas).count() == 0
