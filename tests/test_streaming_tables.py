"""Streams that resume: replayed batches, restarts, many files, bounded state."""

import datetime
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import scoring
from tallyloom.session import fresh_path
from tallyloom.streaming import jobs
from tallyloom.streaming.tables import KeyedTable

BILLS = "project string, period date, run_id bigint, category string, cost_usd double, settlement string, read_on date"
DAY = datetime.date


def put(spark, folder, rows, schema):
    """One more file of the source."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(folder)


def source(spark, folder, schema, files=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)


def bill(run, cost, read, project="p", period=1):
    return (project, DAY(2026, period, 1), run, "compute", cost, "settled", DAY(2026, 2, read))


def ledger(spark, path):
    rows = spark.read.schema(jobs.LEDGER).parquet(path).collect()
    return sorted((r.project or "", r.period.month, r.run_id, r.cost_usd, r.read_on.day) for r in rows)


def test_ledger_over_files_replay_and_restart(spark):
    folder, path, mark = fresh_path(spark, "bills"), fresh_path(spark, "ledger"), fresh_path(spark, "mark")
    put(spark, folder, [bill(1, 1.0, 3), bill(2, 2.0, 3), bill(9, 9.0, 1, "q")], BILLS)
    put(spark, folder, [bill(3, 3.0, 3), bill(1, 0.5, 1), bill(7, 7.0, 1, None)], BILLS)  # the same read again, and an older one late
    jobs.settle_ledger(source(spark, folder, BILLS), path, checkpoint=mark)
    want = [("", 1, 7, 7.0, 1), ("p", 1, 1, 1.0, 3), ("p", 1, 2, 2.0, 3), ("p", 1, 3, 3.0, 3), ("q", 1, 9, 9.0, 1)]
    assert ledger(spark, path) == want
    jobs.settle_ledger(source(spark, folder, BILLS), path, checkpoint=mark)  # nothing new
    assert ledger(spark, path) == want
    put(spark, folder, [bill(1, 4.0, 9), bill(4, 1.5, 1, "q")], BILLS)
    jobs.settle_ledger(source(spark, folder, BILLS), path, checkpoint=mark)  # goes on
    want = [("", 1, 7, 7.0, 1), ("p", 1, 1, 4.0, 9), ("q", 1, 4, 1.5, 1), ("q", 1, 9, 9.0, 1)]
    assert ledger(spark, path) == want


def test_ledger_job_run_again_without_checkpoint(spark):
    folder, path = fresh_path(spark, "bills"), fresh_path(spark, "ledger")
    put(spark, folder, [bill(i, float(i), 3) for i in range(3)], BILLS)
    put(spark, folder, [bill(i, float(i), 3) for i in range(3, 5)], BILLS)
    for files in (1, 1, 2):  # batches need not be the same ones
        jobs.settle_ledger(source(spark, folder, BILLS, files), path)
        assert [r[2] for r in ledger(spark, path)] == [0, 1, 2, 3, 4]
    other = fresh_path(spark, "bills")
    put(spark, other, [bill(8, 8.0, 3)], BILLS)
    jobs.settle_ledger(source(spark, other, BILLS), path, name="other account")
    assert [r[2] for r in ledger(spark, path)] == [0, 1, 2, 3, 4, 8]


def test_a_batch_is_merged_once(spark):
    """Sums double on a naive replay; here neither a replay nor a failure before the mark changes them."""
    path = fresh_path(spark, "sums")
    table = KeyedTable(spark, path, "k string, n bigint, bucket int", ["bucket"])
    batch = lambda *rows: spark.createDataFrame(rows, "k string, n bigint, bucket int")
    add = lambda known, new: known.unionByName(new).groupBy("k", "bucket").agg(F.sum("n").alias("n"))
    read = lambda: {r.k: r.n for r in table.read().collect()}
    assert read() == {}
    table.merge(batch(("a", 1, 0), ("b", 2, 1)), 0, "job", add)
    table.merge(batch(("a", 10, 0)), 1, "job", add)
    table.merge(batch(("a", 10, 0)), 1, "job", add)
    assert read() == {"a": 11, "b": 2}

    def fails(known, new):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        table.merge(batch(("b", 5, 1)), 2, "job", fails)
    table.merge(batch(("b", 5, 1)), 2, "job", add)
    table.merge(batch(("b", 5, 1)), 2, "other", add)
    assert read() == {"a": 11, "b": 12}


EVENTS = "run_id bigint, stage string, task string, epoch bigint, turns bigint, arrival bigint, ts timestamp"


def at(hour):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=hour)


def test_counters_over_batches_with_state_that_falls(spark):
    folder, path, mark = fresh_path(spark, "events"), fresh_path(spark, "counters"), fresh_path(spark, "mark")
    put(spark, folder, [(i, "s", "t", 0, 5, i, at(1)) for i in range(50)], EVENTS)
    run = lambda: jobs.protocol_counters(source(spark, folder, EVENTS), "arrival", path, "2 hours", mark, buckets=4)
    first = run()
    put(spark, folder, [(1, "s", "t", 0, 4, 90, at(2)), (2, "s", "t", 0, 9, 91, at(2)), (3, "s", "t", 0, 5, 3, at(1))], EVENTS)
    put(spark, folder, [(100, "s", "t", 0, 1, 92, at(30))], EVENTS)
    put(spark, folder, [(101, "s", "t", 0, 1, 93, at(31))], EVENTS)
    later = run()
    rows = {r.run_id: r.turns for r in spark.read.schema(EVENTS).parquet(path).collect()}
    assert rows == {**{i: 5 for i in range(50)}, 2: 9, 100: 1, 101: 1}
    remembered = [p["stateOperators"][0]["numRowsTotal"] for p in [*first, *later] if p["stateOperators"]]
    assert max(remembered) >= 50 and remembered[-1] <= 3


SCORED = "run string, task_id bigint, status string, format_status string, bad_prompt string, shown_pass boolean, shown_pairs int, heldout_pass boolean, truncated boolean, prompt_truncated boolean, ts timestamp"


def test_scores_over_batches(spark):
    folder, path, mark = fresh_path(spark, "scored"), fresh_path(spark, "scores"), fresh_path(spark, "mark")
    made = [(f"r{i % 3}", i, None, "valid" if i % 4 else "unparseable_code", None, i % 2 == 0, 3, None if i % 3 == 1 else i % 5 == 0, False, i % 7 == 0, at(i // 20)) for i in range(60)]
    for part in (made[:20], made[20:40] + made[15:20], made[40:]):  # some rows are sent twice
        put(spark, folder, part, SCORED)
        rows = scoring.score_rows(source(spark, folder, SCORED))
        jobs.score_counts(rows, ["run"], ["run", "task_id"], path, "3 hours", mark, buckets=2)
    want = scoring.score_report(scoring.score_rows(spark.createDataFrame(made, SCORED)), ["run"])
    got = jobs.read_scores(rows, ["run"], path).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


HISTORY = "execution bigint, event_id bigint, ts timestamp, kind string, state string, error string"


def test_attribution_forgets_executions_that_end_or_fall_silent(spark):
    folder, out, mark = fresh_path(spark, "history"), fresh_path(spark, "failures"), fresh_path(spark, "mark")
    parts = [
        [(1, 2, at(1), "entered", "Train", None), (1, 1, at(1), "failed", None, "early"), (2, 1, at(1), "entered", "Plan", None), (3, 1, at(1), "entered", "Idle", None)],
        [(1, 5, at(2), "timed_out", None, "slow"), (1, 4, at(2), "entered", "Eval", None), (1, 3, at(2), "failed", None, "first"), (2, 2, at(2), "failed", None, "x"), (2, 3, at(2), "ended", None, None)],
        [(2, 4, at(3), "failed", None, "after the end"), (1, 6, at(40), "failed", None, "late")],
        [(9, 1, at(80), "entered", "New", None)], [(9, 2, at(120), "ended", None, None)],
    ]
    seen = []
    for part in parts:
        put(spark, folder, part, HISTORY)
        stream = jobs.stage_attribution(source(spark, folder, HISTORY), "0 seconds", 24 * 3600.0)
        query = stream.writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out)
        query.awaitTermination()
        seen.append([p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]][-1])
    got = {(r.execution, r.event_id): r.current_state for r in spark.read.schema(jobs.FAILURES).parquet(out).collect()}
    assert got == {(1, 1): None, (1, 3): "Train", (1, 5): "Eval", (2, 2): "Plan", (2, 4): None, (1, 6): "Eval"}
    assert seen[0] == 3 and seen[-1] == 0


def test_attribute_step_is_the_plain_one():
    rows = pd.DataFrame([(3, "failed", None, "a"), (1, "entered", "X", None), (9, "entered", "Z", None), (5, "timed_out", None, "b")], columns=["event_id", "kind", "state", "error"])
    out, known = jobs.attribute_step((4, "Y"), rows)
    assert json.loads(out.to_json(orient="values")) == [[3, "X", "a"], [5, "Y", "b"]] and known == (9, "Z")
    assert jobs.attribute_step(None, rows[rows["kind"] == "failed"])[1] is None
