"""Hand-computed fixtures: known numbers, gates and their negative controls."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import grids as g
from tallyloom.functions import text as tx
from tallyloom.functions.names import run_id_from_resource, session_id
from tallyloom.functions.stats import order_statistics, quantile_position, upper_median_position, wilson
from tallyloom.operators import actuals, audits, augmentation, curation, detection, estimates, intake, judging, rates, retrieval, runs, scoring, telemetry
from tallyloom.streaming.jobs import silence_step

PREFIXES = ("acme-qlora-", "acme-student-", "acme-")


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]


@pytest.mark.parametrize("wins,ties,n,score,low,high", [
    (3, 36, 94, 0.2234, 0.151, 0.318), (1, 0, 39, 0.0256, 0.005, 0.132), (6, 36, 97, 0.2474, 0.172, 0.342),
    (3, 36, 97, 0.2165, 0.146, 0.308), (3, 39, 97, 0.2320, 0.159, 0.325), (97, 0, 97, 1.0, 0.9619, 1.0), (96, 0, 97, 96 / 97, 0.9439, 0.9982)])
def test_wilson_numbers(spark, wins, ties, n, score, low, high):
    p = (wins + 0.5 * ties) / n
    row = one(spark.range(1).select(*wilson(F.lit(p), F.lit(n))).toDF("lo", "hi"))
    assert p == pytest.approx(score, abs=5e-5) and row.lo == pytest.approx(low, abs=6e-4) and row.hi == pytest.approx(high, abs=6e-4)


def test_wilson_of_nothing_is_null(spark):
    assert one(spark.range(1).select(wilson(F.lit(0.5), F.lit(0))[0].alias("lo"))).lo is None


def gate(spark, metrics, threshold="0.45", reported=True):
    rows = spark.createDataFrame(
        [("r", {"judge_score": threshold}, metrics, reported)],
        "run_id string, gates map<string,string>, metrics map<string,string>, eval_reported boolean")
    return one(judging.gate_rows(rows))


def test_gate_rules(spark):
    base = {"judge_score": "0.48", "judge_score_ci_low": "0.40", "judge_score_ci_high": "0.56"}
    assert (gate(spark, base).status, gate(spark, base).passed) == ("borderline", None)
    assert gate(spark, {}).status == "not_measured" and gate(spark, {}).passed is False
    assert gate(spark, {}, reported=False).passed is None
    id_layer = {"judge_score": "0.2234", "judge_score_ci_low": "0.151", "judge_score_ci_high": "0.318", "judge_n": "94",
                "judge_unscorable": "3", "judge_wins": "3", "judge_ties": "36", "judge_losses": "55", "items_in_layer": "97"}
    assert gate(spark, id_layer).status == "failed"
    assert gate(spark, {**id_layer, "items_in_layer": "96"}).status == "unreconciled"
    assert gate(spark, {**id_layer, "judge_wins": "4"}).status == "borderline"
    assert gate(spark, {**id_layer, "judge_score": "0.2234"}, threshold="high").status == "unreadable"
    assert gate(spark, {"judge_score": "0.50"}).status == "borderline" and gate(spark, {"judge_score": "0.51"}).status == "passed"


def test_run_ids(spark):
    names = ["training-job/acme-qlora-run-phase2-main-0001-r3", "endpoint/acme-student-run-a", "endpoint/other", "acme-r3", "x/acme-"]
    rows = spark.createDataFrame([(n,) for n in names], "r string").select(run_id_from_resource(F.col("r"), PREFIXES).alias("i"))
    assert [r.i for r in rows.collect()] == ["run-phase2-main", "run-a", None, "r3", None]


def test_session_ids_are_padded_or_cut(spark):
    row = one(spark.range(1).select(session_id(F.lit("r"), F.lit("eval"), F.lit("gate")).alias("a"), session_id(F.lit("x" * 120), F.lit("s"), F.lit("t")).alias("b")))
    assert row.a == ("r-eval-gate-" + hashlib.sha256(b"r-eval-gate").hexdigest())[:64] and len(row.b) == 100


def test_attribution_keeps_the_remainder(spark):
    bill = spark.createDataFrame([
        ("acme", "d", "training-job/acme-qlora-run-phase2-main-0001-r3", 10.77, False), ("acme", "d", "endpoint/whisper", 36.36, False), ("acme", "d", "canvas", 296.0, True)],
        "project string, period string, resource_id string, cost_usd double, estimated boolean")
    ours = one(actuals.attribute_actuals(bill, ("training-job/acme-", "endpoint/acme-"), PREFIXES))
    assert (ours.run_id, ours.category, ours.cost_usd, ours.settlement) == ("run-phase2-main", "sagemaker_training", 10.77, "settled")
    out = actuals.excluded_actuals(bill, ("training-job/acme-", "endpoint/acme-"), PREFIXES)
    assert out.count() == 2 and one(out.agg(F.sum("cost_usd").alias("s"))).s == pytest.approx(332.36)


def test_training_estimate_matches_the_bill(spark):
    plan = spark.createDataFrame([(1, 16550.0, 0.0, 0, 0.0, 3)], "plan_id int, train_rows double, endpoint_hours double, n_stages int, support_usd double, max_iterations int")
    card = spark.createDataFrame([("sagemaker:training:ml.g5.2xlarge", 1.515, "hours", "ce_realized", "2026-07-31")], "sku string, unit_price double, unit string, source string, as_of string")
    lines = estimates.estimate_lines(plan, card)
    line = one(lines)
    assert line.quantity == pytest.approx(7.109444, abs=1e-6) and line.cost_usd == pytest.approx(10.770808)
    total = one(estimates.estimate_rollup(lines, plan))
    assert total.confidence == "measured" and total.worst_case_usd == pytest.approx(3 * 10.770808)
    unpriced = estimates.estimate_lines(plan, card.where("false"))
    assert one(unpriced).cost_usd is None and one(estimates.estimate_rollup(unpriced, plan)).confidence == "guessed"


def test_reconcile_names_the_driver(spark):
    est = spark.createDataFrame([("r", "a", 10.0), ("r", "b", 5.0)], "run_id string, category string, cost_usd double")
    act = spark.createDataFrame([("r", "a", 12.0), ("r", "c", 4.0)], "run_id string, category string, cost_usd double")
    row = one(actuals.reconcile(est, act, ["run_id"]))
    assert row.driver == "b" and row.delta_usd == 1.0 and row.accuracy_ratio == pytest.approx(16 / 15) and "PROVISIONAL" in row.verdict


def test_rate_precedence_and_staleness(spark):
    schema = "sku string, unit_price double, unit string, source string, as_of string"
    a = spark.createDataFrame([("x", 1.0, "u", "fallback_static", None), ("y", 1.0, "u", "odd", "2026-01-01")], schema)
    b = spark.createDataFrame([("x", 2.0, "u", "ce_realized", "2026-01-01T00:00:00Z"), ("y", 3.0, "u", "fallback_static", "2025-01-01")], schema)
    merged = {r.sku: r for r in rates.merge_rates(a, b).collect()}
    assert merged["x"].unit_price == 2.0 and merged["y"].unit_price == 3.0
    assert {r.sku for r in rates.stale(rates.merge_rates(a, b), "2026-01-31T12:00:00Z").collect()} == {"y"}


GT = [("i", 0, 0.0, 0.0, 10.0, 10.0), ("i", 1, 50.0, 50.0, 20.0, 20.0)]


def score_map(spark, dets, gts=GT):
    box = lambda rows, key: spark.createDataFrame(rows, f"image_id string, {key} int, x double, y double, w double, h double" + (", score double" if key == "det_id" else "")).select(
        "image_id", key, F.lit(1).alias("category_id"), F.array("x", "y", "w", "h").alias("bbox"), F.col(key).alias("ord"), *(["score"] if key == "det_id" else []))
    d, t = box(dets, "det_id"), box(gts, "gt_id")
    return one(detection.map_report(detection.evaluate(d, t), t))


def test_map_fixtures(spark):
    both = [("i", 0, 0.0, 0.0, 10.0, 10.0, 0.9), ("i", 1, 50.0, 50.0, 20.0, 20.0, 0.8)]
    row = score_map(spark, both)
    assert row.map50 == pytest.approx(1.0) and row.map50_95 == pytest.approx(1.0)
    assert score_map(spark, both[:1]).map50 == pytest.approx(51 / 101)
    miss_first = [("i", 0, 200.0, 200.0, 5.0, 5.0, 0.9), ("i", 1, 0.0, 0.0, 10.0, 10.0, 0.8)]
    assert score_map(spark, miss_first).map50 == pytest.approx(51 * 0.5 / 101)
    assert score_map(spark, [("i", 0, 0.0, 0.0, 10.0, 5.0, 0.9)], GT[:1]).map50 == pytest.approx(1.0)
    assert score_map(spark, [("i", 0, 0.0, 0.0, 10.0, 4.99, 0.9)], GT[:1]).map50 == 0.0


PROMPT = "Input (2x2):\n1 2\n3 4\nOutput (2x2):\n2 4\n6 8\nInput (1x3):\n0 1 2\nOutput (1x3):\n0 2 4\n"


def test_grids(spark):
    rows = spark.createDataFrame([(PROMPT,), ("Input (2x3):\n1 2\n3 4\nOutput (2x2):\n2 4\n6 8\n",), ("Input (1x1):\n1\n",)], "prompt string")
    seen = rows.select(g.pair_up(F.transform(g.parse_grids(F.col("prompt")), lambda x: x["grid"])).alias("p"), g.bad_prompt(g.parse_grids(F.col("prompt"))).alias("bad"), F.size(g.parse_headed(F.col("prompt"))).alias("n")).collect()
    assert len(seen[0].p) == 2 and seen[0].p[1].output == [[0, 2, 4]] and seen[0].bad is None and seen[0].n == 4
    assert seen[1].bad == "declared shape differs" and seen[2].bad == "odd number of grids" and seen[2].p is None
    turned = one(spark.range(1).select(g.apply_geometry(F.expr("array(array(1, 2), array(3, 4))"), F.lit("rot90")).alias("g"))).g
    assert turned == [[2, 4], [1, 3]]


def test_wrapped_program_undoes_its_transform(spark):
    perm = [3, 1, 4, 0, 5, 9, 2, 6, 8, 7]
    code = "def transform(grid):\n    return [[(c * 2) % 10 for c in r] for r in grid]"
    row = one(spark.range(1).select(
        g.wrap_code(F.lit(code), F.lit("rot90"), F.array(*[F.lit(p) for p in perm])).alias("code"),
        g.transform_grid(F.expr("array(array(1, 2, 3), array(4, 5, 6))"), F.lit("rot90"), F.array(*[F.lit(p) for p in perm])).alias("x"),
        g.transform_grid(F.expr("array(array(2, 4, 6), array(8, 0, 2))"), F.lit("rot90"), F.array(*[F.lit(p) for p in perm])).alias("y")))
    space = {}
    exec(row.code, space)  # text built above from this test's own program
    assert space["transform"](row.x) == row.y


def test_pair_verdict_and_zero_pairs(spark):
    grid = "array<array<int>>"
    rows = spark.createDataFrame([
        ("ok", 0, "success", None, [[8]], [[8]]), ("late", 0, "success", None, [[8]], [[8]]), ("late", 1, "success", None, [[8]], [[9]]), ("late", 2, "success", None, [[1]], [[1]]),
        ("dead", 0, "timeout", "5s", [[8]], None)], f"task_id string, pair_idx int, status string, error string, expected {grid}, actual {grid}")
    got = {r.task_id: r for r in augmentation.pair_verdict(rows, ["task_id"]).collect()}
    assert got["ok"].all_pass and (got["late"].n_pass, got["late"].fail_reason) == (1, "pair 1: output mismatch")
    assert got["dead"].fail_reason == "pair 0: timeout: 5s"
    tasks = spark.createDataFrame([("ok",), ("none",)], "task_id string")
    both = {r.task_id: r for r in augmentation.with_verdicts(tasks, augmentation.pair_verdict(rows, ["task_id"]), ["task_id"]).collect()}
    assert both["none"].all_pass is False and both["none"].fail_reason == "no pairs to verify against"


def test_provenance_needs_the_same_code(spark):
    rows = spark.createDataFrame([("aaa", "x"), ("bbb", "y"), ("ccc", "z")], "task_id string, code string")
    prov = spark.createDataFrame([("aaa", 2, "x"), ("bbb", 10, "old")], "task_id string, rounds_used int, code string")
    assert {r.task_id: r.repair_rounds for r in augmentation.provenance_tag(rows, prov).collect()} == {"aaa": "2", "bbb": "superseded", "ccc": "unknown"}


def test_stratified_holdout_takes_one_task_per_stratum(spark):
    tasks = [(f"t{i:03d}", 200 + int(1.9 ** (i % 20))) for i in range(400)]
    rows = spark.createDataFrame([(t, f"v{v}", "x" * n) for t, n in tasks for v in range(2)], "task_id string, variant string, prompt string")
    ordered = [t for t, _ in sorted(tasks, key=lambda x: (x[1], x[0]))]
    held = {r.task for r in augmentation.stratified_holdout(rows, "task_id", "prompt", 40, 1).collect()}
    assert len(held) == 40
    assert all(len(held & set(ordered[i * 400 // 40:(i + 1) * 400 // 40])) == 1 for i in range(40))
    with pytest.raises(ValueError):
        augmentation.stratified_holdout(rows, "task_id", "prompt", 81, 1)


def test_order_statistics(spark):
    rows = spark.createDataFrame([("a", v) for v in (5, 1, 9, 3, 7, 3000)] + [("b", 2)], "k string, v int")
    got = {r.k: r for r in order_statistics(rows, ["k"], "v", {"m": upper_median_position(), "p": quantile_position(0.9)}, 4).collect()}
    assert (got["a"].m, got["a"].p, got["b"].m) == (7, 3000, 2)


def test_code_extraction_and_parsing(spark):
    texts = ["<think>```python\nx```</think>```python\ndef transform(g):\n    return g\n```", "words\nimport x\ndef transform(g): return g", "```\ndef other(): pass\n```", "```py\ndef transform(g) oops", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, generation string")
    got = [r.format_status for r in scoring.check_code(rows).orderBy("i").collect()]
    assert got == ["valid", "valid", "no_transform_emitted", "unparseable_code", "no_transform_emitted"]


def test_hash_chain_finds_the_forged_record(spark):
    prev, rows = "genesis", []
    for i in range(6):
        record = {"task_id": f"t{i}", "decision": "approve", "prev_event_sha256": prev}
        digest = hashlib.sha256(json.dumps(record, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        rows.append((i, record["task_id"], "reject" if i == 3 else "approve", prev, digest))
        prev = digest
    df = spark.createDataFrame(rows, "i int, task_id string, decision string, prev_event_sha256 string, record_sha256 string")
    audited = audits.hash_chain_audit(df, ["i"], F.floor(F.col("i") / 2), ("task_id", "decision", "prev_event_sha256"))
    broken = one(audits.first_break(audited, ["i"]))
    assert broken.i == 3 and not broken.hash_ok
    clean = df.where("i < 3")
    assert audits.first_break(audits.hash_chain_audit(clean, ["i"], F.floor(F.col("i") / 2), ("task_id", "decision", "prev_event_sha256")), ["i"]).count() == 0


def test_secret_scan_rules_and_excuses(spark):
    key, account = "AKI" + "A" + "ABCDEFGH12345678", "1234" + "56789012"
    text = f"one\n{key}\nid {account} end\nlong 4{account}\narn:aws:s3:eu-west-1:{account}:b <ACCOUNT_ID>\nhttps://abc123.execute-api.eu-west-1.amazonaws.com"
    docs = spark.createDataFrame([("f", text), ("g", "\0" + text)], "path string, content string")
    found = {(r.path, r.line_no, r.rule) for r in audits.secret_scan(docs, "path", "content").collect()}
    assert ("f", 2, "AWS access key id") in found and ("f", 3, "bare 12-digit account id") in found and ("f", 5, "account-bearing ARN") in found
    assert not any(r[1] == 4 or "hostname" in r[2] for r in found) and ("g", None, "AWS access key id") in found
    assert not any(r[0] == "g" and r[2].startswith("bare") for r in found)
    own = audits.secret_scan(docs, "path", "content", known_digests=[hashlib.sha256(account.encode()).hexdigest()])
    assert {r.rule for r in own.where("path = 'f' AND line_no = 3").collect()} == {"account id on the known list"}


def test_claims_by_presence(spark):
    rows = spark.createDataFrame([('{"outputs":[],"artifacts":["x"],"results":"{\\"a\\":1}","summary":{"k":1}}',), ('{"artifacts":"plain","metrics":7}',)], "c string")
    a, b = runs.normalize_claims(rows, "c").collect()
    assert (a.outputs, a.metrics, a.evidence) == ([], {"a": "1"}, '{"k":1}') and (b.outputs, b.metrics) == (["plain"], {"value": "7"})


def test_manifest_without_digests_is_refused(spark):
    files = spark.createDataFrame([("w", "abc")], "name string, content string")
    good = spark.createDataFrame([({}, {"w": hashlib.sha256(b"abc").hexdigest()})], "files_sha256 map<string,string>, files map<string,string>")
    assert audits.verify_file_manifest(good, files).count() == 0
    with pytest.raises(ValueError):
        audits.verify_file_manifest(good.select(F.expr("map()").cast("map<string,string>").alias("files")), files)


def test_silence_is_claimed_once_per_gap_and_escalated_once():
    rows, last, n, gone = silence_step(0.0, 0, 100.0, 20.0, 3)
    assert [r[0] for r in rows] == ["resurrect"] * 3 + ["escalate"] and gone and last is None
    assert silence_step(0.0, 0, 19.0, 20.0, 3) == ([], 0.0, 0, False)


def test_probe_needs_enough_clean_runs(spark):
    assert telemetry.runs_needed(0.80, 0.05) == 14
    slots = spark.createDataFrame([(i, f"r{i}") for i in range(14)], "slot int, run_id string")
    done = spark.createDataFrame([(f"r{i}", "completed") for i in range(14)], "run_id string, status string")
    assert one(telemetry.reliability_probe(slots, done, 0.8, 0.05)).verdict == "earned"
    assert one(telemetry.reliability_probe(slots, done.where("run_id <> 'r3'"), 0.8, 0.05)).verdict == "inconclusive"
    failed = done.withColumn("status", F.when(F.col("run_id") == "r3", "failed").otherwise("completed"))
    assert one(telemetry.reliability_probe(slots, failed, 0.8, 0.05)).verdict == "refuted"


def test_facts_and_cap(spark):
    text = "source_uri: s3://b/data.jsonl, samples = 50. See s3://b/other/x and kb ABCDE12345"
    rows = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", "samples = 9")], "conv_id int, turn int, role string, text string")
    got = [(r.name, r.value) for r in intake.mine_facts(rows).orderBy("position").collect()]
    assert got == [("source_uri", "s3://b/data.jsonl"), ("sample_count", "50"), ("s3_uri", "s3://b/other/x"), ("retrieval_kb_id", "ABCDE12345")]
    assert [r.name for r in intake.mine_facts(rows, cap=2).orderBy("position").collect()][-1] == "intake"


def test_empty_retrieval_keeps_its_block(spark):
    rows = spark.createDataFrame([(1, "help", "done")], "k int, ticket string, answer string")
    none = spark.createDataFrame([], "k int, id int, is_oracle boolean, slot bigint")
    corpus = spark.createDataFrame([(1, "p")], "id int, text string")
    row = one(retrieval.assemble_rows(rows, none, corpus, "k", "ticket", "answer", "id", "text"))
    assert row.user.endswith("<retrieved_context>\n</retrieved_context>\n\nTicket: help") and row.n_passages == 0


def test_unreadable_layer_is_an_error(spark):
    with pytest.raises(ValueError):
        curation.acceptance_layers({}, "id", "text")


def test_pii_scrub(spark):
    row = one(curation.pii_scrub(spark.createDataFrame([("mail a.b@c.de or 1234-5678-1234-5678",)], "t string"), "t"))
    assert row.t == "mail [EMAIL] or [CARD]"


def test_strip_think_is_not_greedy(spark):
    row = one(spark.range(1).select(tx.strip_think(F.lit("<think>a\nb</think>x<think>c</think>y")).alias("t")))
    assert row.t == "xy"


def test_rouge_l(spark):
    rows = spark.createDataFrame([(1, "the cat sat on the mat", "the cat lay on a mat"), (2, "", "x")], "id int, p string, r string")
    got = {r.id: r for r in judging.rouge_l(rows, "id", "p", "r").collect()}
    assert got[1].recall == pytest.approx(4 / 6) and got[1].f1 == pytest.approx(4 / 6) and got[2].f1 == 0.0


def test_bootstrap_bounds(spark):
    gts = spark.range(12).selectExpr("id AS gt_id", "id AS image_id", "1L AS category_id", "array(0D, 0D, 10D, 10D) AS bbox", "id AS ord")
    exact = gts.selectExpr("gt_id AS det_id", "image_id", "category_id", "bbox", "ord", "0.5D AS score")
    assert tuple(one(detection.bootstrap_ci(exact, gts, 15, 1))) == (pytest.approx(1.0), pytest.approx(1.0))
    half = exact.where("image_id % 2 = 0")
    row = one(detection.bootstrap_ci(half, gts, 15, 1))
    assert 0.0 <= row.low < row.high < 1.0
    assert tuple(row) == tuple(one(detection.bootstrap_ci(half, gts, 15, 1)))


def test_micro_costs_add_up(spark):
    """A million rows of $4e-7 are 40 cents, in sums, in the reconciliation and in the overview."""
    rows = spark.range(1_000_000).selectExpr(
        "'p' AS project", "DATE'2026-01-01' AS period", "'run-' || id % 40 AS run_id", "'compute' AS category", "'s' AS service",
        "'settled' AS settlement", "'cost' AS row_kind", "4e-7D AS cost_usd")
    assert actuals.spend_to_date(rows).first().project_to_date_usd == pytest.approx(0.4, abs=1e-12)
    got = {(r.grouping, r.key): r.cost_usd for r in actuals.cost_overview(rows, top_runs=5).collect()}
    listed = [v for (g, k), v in got.items() if g == "run_id"]
    assert len(listed) == 6 and sum(listed) == pytest.approx(0.4) and got["run_id", "others"] == pytest.approx(0.35)
    assert ("period", "others") not in got
    estimate = spark.createDataFrame([("run-1", "compute", 0.01)], "run_id string, category string, cost_usd double")
    row = actuals.reconcile(estimate, rows, ["run_id"]).where("run_id = 'run-1'").first()
    assert row.actual_usd == pytest.approx(0.01) and abs(row.delta_usd) < 1e-12


def test_long_values_stay_whole(spark):
    long = "s3://bucket/" + "x" * 3000
    turns = spark.createDataFrame([(1, 0, "user", f"source_uri: {long}")], "conv_id int, turn int, role string, text string")
    assert [r.value for r in intake.mine_facts(turns).collect()] == [long]
    many = spark.createDataFrame([(1, i, "user", f"see s3://b/k{i}") for i in range(90)], "conv_id int, turn int, role string, text string")
    assert intake.mine_facts(many).count() == 90
    form = spark.createDataFrame([("f", {"source_uri": long})], "form_id string, fields map<string,string>")
    clean, _ = intake.validate_forms(form, [("source_uri", "uri", True)])
    assert clean.first().value == long
