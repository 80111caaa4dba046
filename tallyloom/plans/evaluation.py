"""Scoring, judging and gate queries over the given tables and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.stats import wilson
from tallyloom.operators import judging, scoring
from tallyloom.plans.telemetry import wilson_sql
from tallyloom.plans.views import VIEWS, view, with_views
from tallyloom.session import table

FENCE = "```"
VIEWS.update({
    "answers": ("conversations", {
        "conv_id": "conv_id", "turn": "turn",
        "generation": "CASE (conv_id + turn) % 7 WHEN 0 THEN '<think>' || text || ' ```python x</think>Sure ```python' || chr(10) || 'def transform(grid):' || chr(10) || '    return ' || turn || chr(10) || '``` bye'"
                      " WHEN 1 THEN text || chr(10) || 'import x' || chr(10) || 'def transform(g):' || chr(10) || '    return g' WHEN 2 THEN '```py' || chr(10) || '  def transform(g): return ' || conv_id"
                      " WHEN 3 THEN '```' || chr(10) || 'def other(g): pass' || chr(10) || '```' || chr(10) || 'def transform(g): pass' WHEN 4 THEN '```python' || chr(10) || 'def transform(g) return' || chr(10) || '```'"
                      " WHEN 5 THEN text ELSE NULL END",
    }),
    "executed": ("lineitem", {
        "run": "l_returnflag", "task_id": "l_orderkey", "variant": "CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE 'v' || (l_suppkey % 3) END",
        "sample_idx": "(l_partkey * 8 + l_linenumber) * 10000 + l_suppkey % 10000",
        "status": "CASE WHEN l_partkey % 19 = 0 THEN 'no_matching_val_row' END",
        "format_status": "CASE l_partkey % 13 WHEN 0 THEN 'no_transform_emitted' WHEN 1 THEN 'unparseable_code' ELSE 'valid' END",
        "bad_prompt": "CASE WHEN l_partkey % 29 = 0 THEN 'shape' END",
        "shown_pass": "l_suppkey % 3 <> 0", "shown_pairs": "CASE WHEN l_partkey % 23 = 0 THEN 0 ELSE 3 END",
        "heldout_pass": "CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_suppkey % 5 < 2 END",
        "truncated": "l_linenumber = 7", "prompt_truncated": "l_returnflag = 'A' AND l_linenumber = 1",
    }),
    "items": ("orders", {"layer": "CASE WHEN o_orderkey % 3 = 0 THEN 'ood' ELSE 'id' END", "item_id": "o_orderkey", "category": "o_orderpriority"}),
    "judgments": ("lineitem", {
        "layer": "CASE WHEN l_orderkey % 3 = 0 THEN 'ood' ELSE 'id' END", "item_id": "l_orderkey",
        "position": "CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'B' END", "attempt": "(l_partkey * 8 + l_linenumber) * 10000 + l_suppkey % 10000",
        "verdict": "CASE WHEN l_partkey % 6 = 0 THEN NULL WHEN l_suppkey % 3 = 0 THEN 'tie' WHEN l_suppkey % 3 = 1 THEN 'A' ELSE 'B' END",
        "stop_reason": "CASE WHEN l_partkey % 6 <> 0 THEN 'end_turn' WHEN l_partkey % 12 = 0 THEN 'content_filtered' ELSE 'max_tokens' END",
        "student_answer_chars": "l_partkey % 500 + 1", "reference_answer_chars": "l_suppkey % 400 + 1",
    }),
    "attempts": ("lineitem", {
        "dataset": "l_returnflag", "task_id": "l_orderkey", "attempt": "l_linenumber", "solved": "l_partkey % 4 = 0",
        "input_tokens": "l_partkey", "output_tokens": "l_suppkey", "seconds": "l_quantity", "cost_usd": "l_extendedprice",
    }),
    "generations": ("lineitem", {
        "run_id": "l_suppkey", "task_id": "l_orderkey", "variant": "CASE WHEN l_linenumber > 4 THEN 'v' END",
        "truncated": "l_quantity > 45", "prompt_truncated": "l_quantity < 3", "input_window": "l_suppkey % 5 * 1024",
    }),
})

_CODE = ["'def transform(grid):' || chr(10) || '    return ' || turn || chr(10)", "'import x' || chr(10) || 'def transform(g):' || chr(10) || '    return g'", "'  def transform(g): return ' || conv_id"]


def codes(spark, sf):
    rows = scoring.check_code(view(spark, sf, "answers"))
    return rows.select("conv_id", "turn", "code")


def checks(spark, sf):
    return scoring.check_code(view(spark, sf, "answers")).groupBy("format_status").agg(F.count("*").alias("n"))


def joined(spark, sf):
    gens = view(spark, sf, "executed").select("task_id", "variant", "sample_idx")
    val = table(spark, sf, "orders").selectExpr("o_orderkey AS task_id", "CASE WHEN o_orderkey % 2 = 0 THEN 'v1' END AS variant")
    return scoring.score_join(gens, val).groupBy(F.coalesce("status", F.lit("matched")).alias("status"), "variant").agg(F.count("*").alias("n"))


def _scored(spark, sf):
    return scoring.score_rows(view(spark, sf, "executed"))


_SCORED = f"""{with_views('executed')}, st AS (SELECT * EXCLUDE (status), CASE WHEN status IS NOT NULL THEN status WHEN format_status <> 'valid' THEN format_status WHEN bad_prompt IS NOT NULL THEN 'bad_prompt: shape' WHEN shown_pairs = 0 THEN 'no_pairs_in_prompt'
  WHEN shown_pass AND heldout_pass = false THEN 'solved_shown_only' WHEN shown_pass THEN 'solved' ELSE 'failed_verification' END AS status FROM executed),
sc AS (SELECT *, status IN ('solved', 'solved_shown_only', 'failed_verification') AS m, CASE WHEN status IN ('solved', 'solved_shown_only') THEN true WHEN status IN ('failed_verification', 'no_transform_emitted', 'unparseable_code') THEN false END AS solved,
  CASE WHEN status IN ('solved', 'solved_shown_only', 'failed_verification') THEN heldout_pass END AS held FROM st)"""


def report(spark, sf):
    return scoring.score_report(_scored(spark, sf), ["run"])


_REPORT = f"""{_SCORED}, a AS (SELECT run, count(*) AS n_generations, count(solved) AS n_scored, count(*) FILTER (status NOT IN ('no_matching_val_row', 'no_transform_emitted', 'unparseable_code')) AS n_format_valid, count(*) FILTER (solved) AS n_solved,
  count(*) FILTER (status IN ('no_transform_emitted', 'unparseable_code') AND truncated) AS n_truncated_format_failures, count(*) FILTER (status = 'unparseable_code') AS n_unparseable, count(*) FILTER (prompt_truncated AND status <> 'no_matching_val_row') AS n_prompt_truncated,
  count(*) FILTER (prompt_truncated AND solved) AS cs, count(held) AS n_heldout_scored, count(*) FILTER (held) AS hs, count(*) FILTER (held IS NOT NULL AND solved) AS ss, count(*) FILTER (solved AND NOT held) AS so FROM sc GROUP BY 1)
SELECT run, n_generations, n_scored, n_format_valid, n_solved, n_truncated_format_failures, n_unparseable, n_prompt_truncated, n_heldout_scored, CASE WHEN n_heldout_scored > 0 THEN hs END AS n_heldout_solved, CASE WHEN n_heldout_scored > 0 THEN so END AS n_solved_shown_only,
  CAST(n_solved AS DOUBLE) / n_scored AS solve_rate, CAST(n_format_valid AS DOUBLE) / n_scored AS format_valid_rate, CAST(hs AS DOUBLE) / nullif(n_heldout_scored, 0) AS heldout_solve_rate, CAST(ss AS DOUBLE) / nullif(n_heldout_scored, 0) AS solve_rate_on_heldout_subset,
  CAST(ss AS DOUBLE) / nullif(n_heldout_scored, 0) - CAST(hs AS DOUBLE) / nullif(n_heldout_scored, 0) AS overfit_gap, CASE WHEN n_prompt_truncated > 0 THEN n_scored - n_prompt_truncated END AS n_scored_intact_prompts,
  CASE WHEN n_prompt_truncated > 0 THEN CAST(n_solved - cs AS DOUBLE) / (n_scored - n_prompt_truncated) END AS solve_rate_intact_prompts FROM a"""


def heldout_block(spark, sf):
    return report(spark, sf).select("run", "n_heldout_scored", "heldout_solve_rate", "solve_rate_on_heldout_subset", "overfit_gap", "n_solved_shown_only")


def truncation_block(spark, sf):
    return report(spark, sf).select("run", "n_prompt_truncated", "n_scored_intact_prompts", "solve_rate_intact_prompts")


def k_rates(spark, sf):
    return scoring.pass_at_k(_scored(spark, sf), ["run"])


_PASSK = f"""{_SCORED}, t AS (SELECT run, task_id, coalesce(variant, '') AS v, count(*) AS k, bool_or(solved) AS s, bool_or(held) AS h, arg_min((held,), (NOT solved, sample_idx)) AS sent FROM sc WHERE solved IS NOT NULL GROUP BY 1, 2, 3),
a AS (SELECT run, count(*) AS n_tasks, max(k) AS samples_per_task, min(k) < max(k) AS ragged, CAST(count(*) FILTER (s) AS DOUBLE) / count(*) AS shown_pass_at_k, count(h) AS nh, count(*) FILTER (h) AS o, count(*) FILTER (h IS NOT NULL AND sent[1]) AS se FROM t GROUP BY 1)
SELECT run, n_tasks, samples_per_task, ragged, shown_pass_at_k, nullif(nh, 0) AS n_tasks_with_heldout, CAST(o AS DOUBLE) / nullif(nh, 0) AS pass_at_k, CAST(se AS DOUBLE) / nullif(nh, 0) AS selected_at_k, CAST(o AS DOUBLE) / nullif(nh, 0) - CAST(se AS DOUBLE) / nullif(nh, 0) AS selection_loss FROM a"""


def _sides(spark, sf, other):
    rows = table(spark, sf, "customer")
    side = lambda shift, gone: F.expr(
        f"CASE WHEN {gone} THEN NULL ELSE named_struct('selected_at_k', CASE WHEN (c_custkey + {shift}) % 3 = 0 THEN ((c_custkey + {shift}) % 50) / 50D END, 'heldout_solve_rate', CASE WHEN (c_custkey + {shift}) % 5 <> 0 THEN ((c_custkey * 3 + {shift}) % 40) / 40D END,"
        f" 'solve_rate', ((c_custkey * 7 + {shift}) % 30) / 30D, 'samples_per_task', CASE WHEN (c_custkey + {shift}) % 2 = 0 THEN 2L END) END")
    return rows.select("c_custkey", side(0, "false").alias("student"), side(3, "c_custkey % 11 = 0").alias(other))


def baseline_gate(spark, sf):
    out = scoring.gate_vs_baseline(_sides(spark, sf, "teacher"))
    return out.select("c_custkey", "metric", "student_rate", "teacher_rate", "threshold", "passed", "gate_status", "baseline_caveat")


def lifts(spark, sf):
    out = scoring.lift(_sides(spark, sf, "base"))
    return out.select("c_custkey", "metric", "student_rate", "base_rate", "absolute_gain", "relative_gain", "verdict", "sampling_differs")


_SIDE = lambda p, s: f"CASE WHEN (c_custkey + {s}) % 3 = 0 THEN CAST((c_custkey + {s}) % 50 AS DOUBLE) / 50 END AS {p}1, CASE WHEN (c_custkey + {s}) % 5 <> 0 THEN CAST((c_custkey * 3 + {s}) % 40 AS DOUBLE) / 40 END AS {p}2, CAST((c_custkey * 7 + {s}) % 30 AS DOUBLE) / 30 AS {p}3, CASE WHEN (c_custkey + {s}) % 2 = 0 THEN 2 ELSE 1 END AS {p}k"
_SIDES = f"""WITH x AS (SELECT c_custkey, c_custkey % 11 = 0 AS gone, {_SIDE('s', 0)}, {_SIDE('t', 3)} FROM customer),
m AS (SELECT *, CASE WHEN s1 IS NOT NULL AND (gone OR (t1 IS NOT NULL AND sk = tk)) THEN 1 WHEN s2 IS NOT NULL AND (gone OR t2 IS NOT NULL) THEN 2 ELSE 3 END AS i FROM x),
r AS (SELECT *, CASE i WHEN 1 THEN 'selected_at_k' WHEN 2 THEN 'heldout_solve_rate' ELSE 'solve_rate' END AS metric, CASE i WHEN 1 THEN s1 WHEN 2 THEN s2 ELSE s3 END AS s, CASE WHEN NOT gone THEN CASE i WHEN 1 THEN t1 WHEN 2 THEN t2 ELSE t3 END END AS t FROM m)"""


# ---- judging -----------------------------------------------------------------------------

def _outcomes(spark, sf):
    return judging.item_outcomes(view(spark, sf, "judgments"), view(spark, sf, "items"))


_OUT = f"""{with_views('judgments', 'items')}, sl AS (SELECT layer, item_id, position, arg_max(CASE WHEN verdict = 'tie' THEN 'tie' WHEN verdict = position THEN 'win' ELSE 'loss' END, attempt) FILTER (verdict IS NOT NULL) AS o, count(*) AS attempts,
  arg_max(stop_reason, attempt) AS stop_reason, arg_min(verdict IS NULL, attempt) AS first_bad FROM judgments GROUP BY 1, 2, 3),
it AS (SELECT layer, item_id, min(o) AS lo, max(o) AS hi, count(*) AS ns, count(o) AS nk FROM sl GROUP BY 1, 2),
oc AS (SELECT items.*, CASE WHEN ns = nk THEN CASE WHEN lo = hi THEN lo ELSE 'tie' END END AS outcome, CASE WHEN ns = nk AND ns > 1 THEN lo <> hi END AS flipped FROM items LEFT JOIN it USING (layer, item_id))"""


def _rollup_sql(keys: str) -> str:
    low, high = wilson_sql("judge_score", "judge_n")
    return f"""ro AS (SELECT {keys}, count(*) AS items_in_layer, count(*) FILTER (outcome = 'win') AS judge_wins, count(*) FILTER (outcome = 'tie') AS judge_ties, count(*) FILTER (outcome = 'loss') AS judge_losses, count(*) FILTER (outcome IS NULL) AS judge_unscorable, count(outcome) AS judge_n FROM oc GROUP BY ALL),
rs AS (SELECT *, CASE WHEN judge_n > 0 THEN (judge_wins + 0.5::DOUBLE * judge_ties) / judge_n END AS judge_score FROM ro), rr AS (SELECT *, {low} AS judge_score_ci_low, {high} AS judge_score_ci_high FROM rs)"""


def rollup(spark, sf):
    return judging.judge_rollup(_outcomes(spark, sf))


def flips(spark, sf):
    return judging.position_flip(_outcomes(spark, sf))


def balance(spark, sf):
    return judging.position_balance(view(spark, sf, "judgments"))


def denominators(spark, sf):
    sizes = view(spark, sf, "items").groupBy("layer").agg((F.count("*") + F.when(F.col("layer") == "ood", 1).otherwise(0)).alias("n_items"))
    return judging.reconcile_denominator(rollup(spark, sf), sizes).select("layer", "judge_n", "judge_unscorable", "n_items", "denominator")


def unscorable(spark, sf):
    return judging.unscorable_items(_outcomes(spark, sf))


def categories(spark, sf):
    training = view(spark, sf, "items").where("category <> '5-LOW'")
    return judging.category_breakdown(_outcomes(spark, sf), training)


def missingness(spark, sf):
    return judging.judge_missingness(view(spark, sf, "judgments"), view(spark, sf, "items"))


def ratios(spark, sf):
    return judging.length_ratio(view(spark, sf, "judgments"))


_RATIOS = f"""{with_views('judgments')}, i AS (SELECT layer, item_id, max(student_answer_chars) AS s, max(reference_answer_chars) AS r FROM judgments GROUP BY 1, 2)
SELECT layer, count(*) AS n_items, CAST(sum(s) AS DOUBLE) / CAST(sum(r) AS DOUBLE) AS pooled_ratio, CAST(count(*) FILTER (s > r) AS DOUBLE) / count(*) AS share_longer, list(CAST(s AS DOUBLE) / r ORDER BY CAST(s AS DOUBLE) / r)[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median_ratio FROM i GROUP BY 1"""


# ---- gates -------------------------------------------------------------------------------

def by_language(spark, sf):
    """Quality rate per document language with its interval and the verdict at a bar of 0.7."""
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    per = rows.groupBy("lang").agg(F.sum("quality").alias("good"), F.count("*").alias("n")).withColumn("rate", F.col("good") / F.col("n"))
    low, high = wilson(F.col("rate"), F.col("n"))
    per = per.withColumns({"rate_low": low, "rate_high": high})
    return per.withColumn("verdict", judging.bounds_verdict(F.col("rate_low"), F.col("rate_high"), F.lit(0.7)))


_LANG_LOW, _LANG_HIGH = wilson_sql("rate", "n")
_LANG = f"""WITH p AS (SELECT lang, CAST(sum(quality) AS BIGINT) AS good, count(*) AS n, CAST(sum(quality) AS DOUBLE) / count(*) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY 1), w AS (SELECT *, {_LANG_LOW} AS rate_low, {_LANG_HIGH} AS rate_high FROM p)
SELECT *, CASE WHEN rate_low >= 0.7 THEN 'passed' WHEN rate_high < 0.7 THEN 'failed' ELSE 'borderline' END AS verdict FROM w"""


def imputed(spark, sf):
    """The three imputed verdicts of each judged category at a bar of 0.5."""
    rows = judging.judge_rollup(_outcomes(spark, sf), ["layer", "category"])
    three = judging.imputed_verdicts(F.col("judge_wins"), F.col("judge_ties").cast("double"), F.col("judge_n").cast("double"), F.col("judge_unscorable").cast("double"), F.lit(0.5))
    return rows.select("layer", "category", F.array_join(three, "|").alias("verdicts"))


def _imputed_sql() -> str:
    parts = []
    for w, t in (("judge_unscorable", "0"), ("0", "0"), ("0", "judge_unscorable")):
        low, high = wilson_sql(f"((judge_wins + {w} + 0.5::DOUBLE * (judge_ties + {t})) / items_in_layer)", "items_in_layer")
        parts.append(f"CASE WHEN {low} >= 0.5 THEN 'passed' WHEN {high} < 0.5 THEN 'failed' ELSE 'borderline' END")
    return f"{_OUT}, {_rollup_sql('layer, category')} SELECT layer, category, {' || chr(124) || '.join(parts)} AS verdicts FROM rr"


# A gate's metrics as text, from the customer key: missing, plain, bounded, miscounted, imputable.
_N = "(40 + c_custkey % 60)"
_W = "(c_custkey * 7 % 20)"
_TIES = "(c_custkey * 3 % 15)"
_U = "(c_custkey % 6)"
_LOW = "((c_custkey * 13 % 100) / 100.0)"


def _gate_runs(spark, sf):
    pairs = f"""filter(array(
      CASE WHEN c_custkey % 8 <> 0 THEN named_struct('k', 'judge_score', 'v', CASE WHEN c_custkey % 31 = 0 THEN 'n/a' ELSE '' || (c_custkey * 13 % 100) / 100.0 END) END,
      CASE WHEN c_custkey % 3 <> 0 THEN named_struct('k', 'judge_score_ci_low', 'v', '' || {_LOW}) END,
      CASE WHEN c_custkey % 3 <> 0 THEN named_struct('k', 'judge_score_ci_high', 'v', '' || ({_LOW} + 0.2)) END,
      named_struct('k', 'judge_n', 'v', '' || {_N}),
      CASE WHEN c_custkey % 7 <> 0 THEN named_struct('k', 'judge_unscorable', 'v', '' || {_U}) END,
      named_struct('k', 'judge_wins', 'v', '' || {_W}), named_struct('k', 'judge_ties', 'v', '' || {_TIES}),
      named_struct('k', 'judge_losses', 'v', '' || ({_N} - {_W} - {_TIES} + CASE WHEN c_custkey % 17 = 0 THEN 1 ELSE 0 END)),
      CASE WHEN c_custkey % 5 <> 0 THEN named_struct('k', 'items_in_layer', 'v', '' || ({_N} + CASE WHEN c_custkey % 7 <> 0 THEN {_U} ELSE 0 END + CASE WHEN c_custkey % 13 = 0 THEN 1 ELSE 0 END)) END
    ), x -> x IS NOT NULL)"""
    return table(spark, sf, "customer").selectExpr(
        "c_custkey AS run_id", "map('judge_score', CASE WHEN c_custkey % 29 = 0 THEN 'high' ELSE '0.45' END) AS gates",
        f"map_from_entries({pairs}) AS metrics", "c_custkey % 2 = 0 AS eval_reported")


def gates(spark, sf):
    return judging.gate_rows(_gate_runs(spark, sf)).select("run_id", "gate", "status", "passed")


def _gate_sql() -> str:
    verdicts = []
    for w, t in (("u", "0"), ("0", "0"), ("0", "u")):
        low, high = wilson_sql(f"((w + {w} + 0.5::DOUBLE * (t + {t})) / CAST(n + u AS DOUBLE))", "(n + u)")
        verdicts.append(f"CASE WHEN {low} >= 0.45 THEN 'passed' WHEN {high} < 0.45 THEN 'failed' ELSE 'borderline' END")
    low = "CAST(((c_custkey * 13 % 100) / 100.0) AS DOUBLE)"
    return f"""WITH x AS (SELECT c_custkey AS k, {_N} AS n, {_W} AS w, {_TIES} AS t, {_U} AS u, CAST(c_custkey * 13 % 100 AS DOUBLE) / 100 AS lo, CAST(c_custkey * 13 % 100 + 20 AS DOUBLE) / 100 AS hi FROM customer),
i AS (SELECT *, list_distinct([{', '.join(verdicts)}]) AS im, CASE WHEN lo >= 0.45 THEN 'passed' WHEN hi < 0.45 THEN 'failed' ELSE 'borderline' END AS bv FROM x),
s AS (SELECT k AS run_id, 'judge_score' AS gate, CASE WHEN k % 8 = 0 THEN CASE WHEN k % 2 = 0 THEN 'not_measured' ELSE 'not_evaluated' END WHEN k % 29 = 0 THEN 'unreadable'
  WHEN k % 3 <> 0 THEN CASE WHEN k % 5 <> 0 AND k % 13 = 0 THEN 'unreconciled' WHEN k % 7 = 0 OR u = 0 THEN bv WHEN k % 17 = 0 OR len(im) > 1 THEN 'borderline' ELSE im[1] END
  WHEN k % 31 = 0 THEN 'unreadable' WHEN abs(lo - 0.45::DOUBLE) <= 0.05::DOUBLE + 1e-9::DOUBLE THEN 'borderline' WHEN lo > 0.45 THEN 'passed' ELSE 'failed' END AS status FROM i)
SELECT *, CASE status WHEN 'passed' THEN true WHEN 'not_evaluated' THEN NULL WHEN 'borderline' THEN NULL ELSE false END AS passed FROM s"""


def ood(spark, sf):
    runs = table(spark, sf, "customer").selectExpr("c_custkey AS run_id", "CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS ood_score", "c_custkey % 2 = 0 AS ood_requested", "c_custkey % 5 <> 0 AS eval_reported")
    return judging.ood_layer(runs).select("run_id", "ood_status")


# ---- ROUGE, generations ------------------------------------------------------------------

def _turn_pairs(spark, sf):
    t = table(spark, sf, "conversations").where("text IS NOT NULL")
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference"))
    return t.join(nxt, ["conv_id", "turn"]).select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("prediction"), "reference")


def rouge1(spark, sf):
    return judging.rouge_n(_turn_pairs(spark, sf), "id", "prediction", "reference", 1)


def rouge_lcs(spark, sf):
    return judging.rouge_l(_turn_pairs(spark, sf), "id", "prediction", "reference")


_ROUGE = """WITH p AS (SELECT a.conv_id || '-' || a.turn AS id, a.text AS p, b.text AS r FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
pw AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(lower(p), '[\\p{L}\\p{N}]+')) AS w FROM p) GROUP BY 1, 2), rw AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(lower(r), '[\\p{L}\\p{N}]+')) AS w FROM p) GROUP BY 1, 2),
s AS (SELECT p.id, coalesce((SELECT sum(n) FROM pw WHERE pw.id = p.id), 0) AS np, coalesce((SELECT sum(n) FROM rw WHERE rw.id = p.id), 0) AS nr, coalesce((SELECT sum(least(pw.n, rw.n)) FROM pw JOIN rw ON pw.id = rw.id AND pw.w = rw.w WHERE pw.id = p.id), 0) AS o FROM p)
SELECT id, CASE WHEN np > 0 THEN CAST(o AS DOUBLE) / CAST(np AS DOUBLE) ELSE 0 END AS precision, CASE WHEN nr > 0 THEN CAST(o AS DOUBLE) / CAST(nr AS DOUBLE) ELSE 0 END AS recall, CASE WHEN np + nr > 0 THEN CAST(2 * o AS DOUBLE) / CAST(np + nr AS DOUBLE) ELSE 0 END AS f1 FROM s"""


#: The usual table row by row; as rows never fall from left to right, a running maximum completes one.
_ROUGE_L = """WITH RECURSIVE q AS (SELECT a.conv_id || '-' || a.turn AS id, regexp_extract_all(lower(a.text), '[\\p{L}\\p{N}]+') AS p, regexp_extract_all(lower(b.text), '[\\p{L}\\p{N}]+') AS r
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
x AS (SELECT id, p, r, 0 AS i, list_transform(range(len(r) + 1), lambda k: 0::BIGINT) AS line FROM q
  UNION ALL SELECT id, p, r, i + 1, list_prepend(0::BIGINT, list_transform(range(1, len(r) + 1), lambda j: list_max(best[1:j])))
  FROM (SELECT id, p, r, i, list_transform(range(1, len(r) + 1), lambda k: greatest(line[k + 1], CASE WHEN p[i + 1] = r[k] THEN line[k] + 1 ELSE 0 END)) AS best FROM x WHERE i < len(p))),
s AS (SELECT id, len(p) AS np, len(r) AS nr, line[len(r) + 1] AS o FROM x WHERE i = len(p))
SELECT id, CASE WHEN np > 0 THEN CAST(o AS DOUBLE) / CAST(np AS DOUBLE) ELSE 0 END AS precision, CASE WHEN nr > 0 THEN CAST(o AS DOUBLE) / CAST(nr AS DOUBLE) ELSE 0 END AS recall, CASE WHEN np + nr > 0 THEN CAST(2 * o AS DOUBLE) / CAST(np + nr AS DOUBLE) ELSE 0 END AS f1 FROM s"""


def comparable(spark, sf):
    side = lambda n: F.expr(f"named_struct('digest', o_custkey % {n}, 'temperature', o_orderkey % 2, 'thinking', CASE WHEN o_orderkey % {n} = 0 THEN NULL ELSE o_orderstatus END)")
    rows = table(spark, sf, "orders").select("o_orderkey", side(3).alias("a"), side(4).alias("b"))
    out = scoring.run_comparability(rows, "a", "b", ("digest", "temperature", "thinking"))
    return out.select("o_orderkey", F.array_join("differing", "|").alias("differing"), "comparable")


_COMPARABLE = """WITH d AS (SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_custkey % 3 <> o_custkey % 4 THEN 'digest' END, CASE WHEN (o_orderkey % 3 = 0) <> (o_orderkey % 4 = 0) THEN 'thinking' END], lambda x: x IS NOT NULL), '|') AS differing FROM orders) SELECT *, differing = '' AS comparable FROM d"""


def trimmed(spark, sf):
    ids = F.expr("array(5, CAST(o_orderkey % 4 AS int), 6, CAST(o_custkey % 3 AS int), 0, 0)")
    length, cut = scoring.trim_new_tokens(ids, [2, 3], 0, 4)
    return table(spark, sf, "orders").select("o_orderkey", length.alias("length"), cut.alias("truncated"))


_TRIMMED = """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 4 IN (2, 3) THEN 2 WHEN o_custkey % 3 = 2 THEN 4 WHEN o_custkey % 3 = 0 THEN 3 ELSE 4 END AS BIGINT) AS length, o_orderkey % 4 NOT IN (2, 3) AND o_custkey % 3 = 1 AS truncated FROM orders"""


def gen_stats(spark, sf):
    return scoring.generation_stats(view(spark, sf, "attempts"))


def attempt_hist(spark, sf):
    return scoring.attempt_histogram(view(spark, sf, "attempts"))


_ATT = f"""{with_views('attempts')}, t AS (SELECT dataset, task_id, count(*) AS attempts, min(attempt) FILTER (solved) AS fs, sum(input_tokens) AS i, sum(output_tokens) AS o, sum(CAST(seconds AS DECIMAL(38,12))) AS s, sum(CAST(cost_usd AS DECIMAL(38,12))) AS c FROM attempts GROUP BY 1, 2)"""


def gen_runs(spark, sf):
    return scoring.generation_run_summary(view(spark, sf, "generations"), settings=["input_window"])


_GEN = f"""{with_views('generations')} SELECT run_id, count(*) AS n_written, count(*) FILTER (truncated) AS n_truncated, count(*) FILTER (prompt_truncated) AS n_prompt_truncated, count(DISTINCT (task_id, coalesce(variant, ''))) AS n_prompts, max(input_window) AS input_window FROM generations GROUP BY 1"""

QUERIES = {
    "d1_wilson_gate_by_language": by_language, "d2_score_join": joined, "d3_extract_code": codes, "d4_compile_check": checks,
    "d5_score_report": report, "d6_heldout_block": heldout_block, "d7_prompt_truncation_block": truncation_block, "d8_pass_at_k": k_rates,
    "d9_gate_vs_baseline": baseline_gate, "d9_lift": lifts, "d10_judge_rollup": rollup, "d10_unscorable_items": unscorable,
    "d11_position_flip": flips, "d11_position_balance": balance, "d12_reconcile_denominator": denominators, "d13_imputed_verdicts": imputed,
    "d14_gate_row": gates, "d15_ood_layer": ood, "d16_category_breakdown": categories, "d17_length_ratio": ratios, "d18_rouge_n": rouge1, "d18_rouge_l": rouge_lcs,
    "d19_judge_missingness": missingness, "d28_run_comparability": comparable, "d29_trim_new_tokens": trimmed, "d30_generation_stats": gen_stats,
    "d30_attempt_histogram": attempt_hist, "d31_generation_run_summary": gen_runs,
}

SQL = {
    "d1_wilson_gate_by_language": _LANG,
    "d2_score_join": f"""{with_views('executed')}, v AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'v1' ELSE '' END AS variant FROM orders) SELECT CASE WHEN o_orderkey IS NULL THEN 'no_matching_val_row' ELSE 'matched' END AS status, coalesce(e.variant, '') AS variant, count(*) AS n
  FROM executed e LEFT JOIN v ON o_orderkey = task_id AND v.variant = coalesce(e.variant, '') GROUP BY 1, 2""",
    "d3_extract_code": f"SELECT conv_id, turn, CASE (conv_id + turn) % 7 WHEN 0 THEN {_CODE[0]} WHEN 1 THEN {_CODE[1]} WHEN 2 THEN {_CODE[2]} WHEN 4 THEN 'def transform(g) return' || chr(10) END AS code FROM conversations",
    "d4_compile_check": "SELECT CASE (conv_id + turn) % 7 WHEN 0 THEN 'valid' WHEN 1 THEN 'valid' WHEN 2 THEN 'unparseable_code' WHEN 4 THEN 'unparseable_code' ELSE 'no_transform_emitted' END AS format_status, count(*) AS n FROM conversations GROUP BY 1",
    "d5_score_report": _REPORT,
    "d6_heldout_block": f"SELECT run, n_heldout_scored, heldout_solve_rate, solve_rate_on_heldout_subset, overfit_gap, n_solved_shown_only FROM ({_REPORT})",
    "d7_prompt_truncation_block": f"SELECT run, n_prompt_truncated, n_scored_intact_prompts, solve_rate_intact_prompts FROM ({_REPORT})",
    "d8_pass_at_k": _PASSK,
    "d9_gate_vs_baseline": f"""{_SIDES} SELECT c_custkey, metric, s AS student_rate, t AS teacher_rate, 0.8::DOUBLE * t AS threshold, s >= 0.8::DOUBLE * t AS passed, CASE WHEN gone THEN 'NO_TEACHER_BASELINE' WHEN s >= 0.8::DOUBLE * t THEN 'PASSED' ELSE 'FAILED' END AS gate_status,
  CASE WHEN t >= 0.99 THEN 'degenerate' WHEN t = 0 THEN 'no signal' END AS baseline_caveat FROM r""",
    "d9_lift": f"""{_SIDES} SELECT c_custkey, metric, s AS student_rate, t AS base_rate, s - t AS absolute_gain, CASE WHEN t <> 0 THEN (s - t) / t END AS relative_gain, CASE WHEN s = 0 AND t = 0 THEN 'both zero' WHEN s > t THEN 'improved' WHEN s = t THEN 'no change' ELSE 'REGRESSION' END AS verdict, sk <> tk AS sampling_differs FROM r WHERE NOT gone""",
    "d10_judge_rollup": f"{_OUT}, {_rollup_sql('layer')} SELECT * FROM rr",
    "d10_unscorable_items": f"{_OUT} SELECT layer, item_id FROM oc WHERE outcome IS NULL",
    "d11_position_flip": f"{_OUT} SELECT layer, count(flipped) AS n_both, count(*) FILTER (flipped) AS n_flipped, CAST(count(*) FILTER (flipped) AS DOUBLE) / count(flipped) AS flip_rate FROM oc GROUP BY 1",
    "d11_position_balance": f"{with_views('judgments')}, b AS (SELECT layer, count(DISTINCT item_id) FILTER (position = 'A') AS n_a, count(DISTINCT item_id) FILTER (position = 'B') AS n_b FROM judgments GROUP BY 1) SELECT *, n_a = n_b AS balanced FROM b",
    "d12_reconcile_denominator": f"{_OUT}, {_rollup_sql('layer')} SELECT layer, judge_n, judge_unscorable, items_in_layer + CASE WHEN layer = 'ood' THEN 1 ELSE 0 END AS n_items, CASE WHEN layer = 'ood' THEN 'unreconciled' ELSE 'reconciled' END AS denominator FROM rr",
    "d13_imputed_verdicts": _imputed_sql(),
    "d14_gate_row": _gate_sql(),
    "d15_ood_layer": "SELECT c_custkey AS run_id, CASE WHEN c_custkey % 3 = 0 THEN 'reported' WHEN c_custkey % 2 = 0 AND c_custkey % 5 <> 0 THEN 'missing' ELSE 'not requested' END AS ood_status FROM customer",
    "d16_category_breakdown": f"{_OUT}, {_rollup_sql('layer, category')} SELECT *, category <> '5-LOW' AS in_training FROM rr",
    "d17_length_ratio": _RATIOS,
    "d18_rouge_n": _ROUGE, "d18_rouge_l": _ROUGE_L,
    "d19_judge_missingness": f"{_OUT} SELECT sl.layer, category, stop_reason, count(*) AS n_slots, CAST(sum(attempts) AS BIGINT) AS attempts, count(*) - count(o) AS n_unscorable, CAST(count(*) - count(o) AS DOUBLE) / count(*) AS unscorable_share, count(*) FILTER (o IS NOT NULL AND first_bad) AS n_recovered FROM sl LEFT JOIN items USING (layer, item_id) GROUP BY 1, 2, 3",
    "d28_run_comparability": _COMPARABLE,
    "d29_trim_new_tokens": _TRIMMED,
    "d30_generation_stats": f"""{_ATT} SELECT dataset, count(*) AS tasks, count(fs) AS solved, CAST(sum(attempts) AS BIGINT) AS attempts, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, CAST(sum(s) AS DOUBLE) AS seconds, CAST(sum(c) AS DOUBLE) AS cost_usd,
  CAST(count(fs) AS DOUBLE) / count(*) AS solve_rate, CAST(sum(fs) AS DOUBLE) / count(fs) AS mean_attempts_to_success FROM t GROUP BY 1""",
    "d30_attempt_histogram": f"{_ATT} SELECT dataset, fs IS NOT NULL AS solved, attempts, count(*) AS n_tasks FROM t GROUP BY 1, 2, 3",
    "d31_generation_run_summary": _GEN,
}
