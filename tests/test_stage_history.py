"""A run's history is numbered without sorting one run in one task."""

import datetime

from tallyloom.operators import runs


def events():
    start = datetime.datetime(2024, 1, 1)
    return [("hot" if k % 3 else [None, "", "cold"][k % 9 // 3], start + datetime.timedelta(seconds=(k * 7919) % 500), k, f"s{k % 4}") for k in range(3000)]


def test_positions_of_every_run_without_a_window_of_a_whole_run(spark):
    given = spark.createDataFrame(events(), "run_id string, ts timestamp, event_id long, stage string").repartition(4)
    found = runs.stage_history(given)
    assert found.columns == [*given.columns, "position"] and dict(found.dtypes)["position"] == "bigint"
    by_run = {}
    for r in sorted(events(), key=lambda r: (r[1], r[2])):
        by_run.setdefault(r[0], []).append(r[2])
    assert sorted((r.event_id, r.position) for r in found.collect()) == sorted((e, p) for ids in by_run.values() for p, e in enumerate(ids, 1))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "_chunk" in plan
