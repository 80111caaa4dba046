"""Augmentation: variant plans, pair verdicts, held-out gates, provenance, group splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import grids as g
from tallyloom.functions.stats import count_where, order_statistics, ratio, upper_median_position, wilson
from tallyloom.functions.text import bind
from tallyloom.operators.ordering import rank_overall

MIN_TRAIN_MULTIPLE = 5
UNKNOWN, SUPERSEDED = "unknown", "superseded"
SAMPLES = 20

# Fixed plan: five geometries, four colour permutations, fifteen compositions, in this order.
# Each slot is (geometry, colour label); perm9 keeps 0 in place, perm10 moves it.
SLOTS = (
    tuple((name, None) for name in g.GEOMETRIES)
    + ((None, "perm9"), (None, "perm9"), (None, "perm10"), (None, "perm10"))
    + tuple((name, label) for label in ("perm9", "perm10", "perm9") for name in g.GEOMETRIES)
)


TRIES = 64


def _permutation(task: Column, slot: Column, full: Column, seed: int, attempt: Column, top: int) -> Column:
    """Digits up to `top` ordered by a hash of (task, slot, digit) and, from the second draw on, its number.

    A full permutation must move 0, so when 0 would land on itself the list is rotated by one; one
    that fixes 0 and came out as the identity is rotated likewise behind it.
    """
    draw = lambda d: F.when(attempt == 0, F.xxhash64(F.lit(seed), task, slot, d)).otherwise(F.xxhash64(F.lit(seed), task, slot, d, attempt))
    digits = F.sequence(F.when(full, F.lit(0)).otherwise(1), F.lit(top))
    shuffled = F.transform(F.sort_array(F.transform(digits, lambda d: F.struct(draw(d).alias("h"), d.alias("d")))), lambda x: x["d"])
    rotated = lambda p: F.concat(F.slice(p, 2, top), F.slice(p, 1, 1))

    def behind(p: Column) -> Column:
        moved = F.when((full & (F.get(p, F.lit(0)) == 0)) | (~full & (p == F.sequence(F.lit(1), F.lit(top)))), rotated(p)).otherwise(p)
        return F.when(full, moved).otherwise(F.concat(F.array(F.lit(0)), moved))

    return bind(shuffled, behind)


def _slot_entry(task: Column, slot: Column, seed: int, attempt: Column, top: int) -> Column:
    """The variant of a slot by its `attempt`-th draw."""
    geom = F.get(F.array(*[F.lit(g_).cast("string") for g_, _ in SLOTS]), slot)
    label = F.get(F.array(*[F.lit(l_).cast("string") for _, l_ in SLOTS]), slot)
    perm = F.when(label.isNotNull(), _permutation(task, slot, F.coalesce(label == "perm10", F.lit(False)), seed, attempt, top))
    tag = (
        F.when(geom.isNotNull() & label.isNotNull(), F.concat(F.lit("comp:"), geom, F.lit("+"), label))
        .when(geom.isNotNull(), F.concat(F.lit("geom:"), geom)).otherwise(F.concat(F.lit("color:"), label)))
    colours = lambda p: F.when(p.isNull(), "id").otherwise(F.array_join(p.cast("array<string>"), ","))
    return bind(perm, lambda p: F.struct(
        slot.alias("slot"), geom.alias("geom"), p.alias("perm"), tag.alias("tag"),
        F.concat(F.coalesce(geom, F.lit("id")), F.lit("|"), colours(p)).alias("sig")))


def plan_variants(tasks: DataFrame, task: str, n: int, seed: int = 0, top: int = 9) -> DataFrame:
    """(task, slot, geom, perm, tag, sig): the first n distinct variants of each task.

    Deterministic per task. A draw that repeats an earlier signature of the task is drawn again,
    with the number of the try in its hash, until it is new; a slot without a new one in `TRIES`
    draws, as on a tiny alphabet, is left out. `top` is the largest colour.
    """
    key = F.col(task)
    entry = lambda slot, attempt: _slot_entry(key, slot, seed, attempt, top)
    slots = F.sequence(F.lit(0), F.lit(len(SLOTS) - 1))
    planned = tasks.select(task, F.transform(slots, lambda i: entry(i, F.lit(0))).alias("_p"))
    none = F.slice("_p", 1, 0)

    def again(so_far: Column, i: Column) -> Column:
        fresh = F.filter(F.transform(F.sequence(F.lit(0), F.lit(TRIES - 1)), lambda t: entry(i, t)), lambda e: ~F.exists(so_far, lambda x: x["sig"] == e["sig"]))
        return F.concat(so_far, F.slice(fresh, 1, 1))

    repeated = F.size(F.array_distinct(F.transform("_p", lambda x: x["sig"]))) < len(SLOTS)
    # only the few tasks with a repeat pay for the tries
    drawn = F.when(repeated, F.aggregate(slots, none, again)).otherwise(F.col("_p"))
    return planned.select(task, F.explode(F.slice(drawn, 1, n)).alias("v")).select(task, "v.*")


def build_variants(triplets: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Every planned variant of (task_id, prompt, code, heldout_pairs?) with its own texts and pairs."""
    parsed = triplets.withColumn("_g", g.parse_grids(F.col("prompt"))).withColumn("bad_prompt", g.bad_prompt(F.col("_g")))
    usable = parsed.where(F.col("bad_prompt").isNull()).withColumn("pairs", g.pair_up(F.transform("_g", lambda x: x["grid"])))
    rows = usable.join(plan_variants(usable.select("task_id"), "task_id", n, seed), "task_id")
    geom, perm = F.col("geom"), F.col("perm")
    moved = rows.withColumn("pairs", g.transform_pairs(F.col("pairs"), geom, perm))
    if "heldout_pairs" in triplets.columns:
        moved = moved.withColumn("heldout_pairs", g.transform_pairs(F.col("heldout_pairs"), geom, perm))
    flat = F.flatten(F.transform("pairs", lambda p: F.array(p["input"], p["output"])))
    return moved.withColumns({
        "prompt": g.rerender(F.col("prompt"), flat),
        "code": g.wrap_code(F.col("code"), geom, perm),
        "variant": F.concat("tag", F.lit("#"), "sig"),
        "n_train_pairs": F.size("pairs"),
    }).drop("_g", "bad_prompt")


# ---- verdicts and gates ------------------------------------------------------------------

def pair_verdict(results: DataFrame, keys: list[str]) -> DataFrame:
    """Fold executed pairs into all_pass, n_pass, n_pairs and fail_reason per key.

    `results`: keys, pair_idx, status, error, expected, actual. n_pass counts the leading passes;
    grids must be non-ragged, non-empty and cell-equal.
    """
    rectangular = (
        (F.size("actual") > 0)
        & F.forall("actual", lambda r: F.size(r) == F.size(F.get(F.col("actual"), F.lit(0))))
    )
    ok = F.coalesce((F.col("status") == "success") & (F.col("expected") == F.col("actual")) & rectangular, F.lit(False))
    reason = F.concat(
        F.lit("pair "), F.col("pair_idx").cast("string"), F.lit(": "),
        F.when(F.col("status") == "success", "output mismatch").otherwise(
            F.concat(F.col("status"), F.lit(": "), F.coalesce("error", F.lit("")))))
    marked = results.withColumns({"_ok": ok, "_why": reason})
    bad = F.when(~F.col("_ok"), F.col("pair_idx"))
    return marked.groupBy(*keys).agg(
        F.count("*").alias("n_pairs"), F.min(bad).alias("_first_bad"), F.min_by("_why", bad).alias("fail_reason")
    ).select(
        *keys, F.col("_first_bad").isNull().alias("all_pass"),
        F.coalesce("_first_bad", "n_pairs").cast("long").alias("n_pass"), "n_pairs", "fail_reason")


def with_verdicts(rows: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Attach verdicts; a row nothing was run for has zero pairs and has not passed."""
    return rows.join(verdicts, keys, "left").withColumns({
        "all_pass": F.coalesce("all_pass", F.lit(False)),
        "n_pass": F.coalesce("n_pass", F.lit(0)),
        "n_pairs": F.coalesce("n_pairs", F.lit(0)),
        "fail_reason": F.when(F.col("n_pairs").isNull(), "no pairs to verify against").otherwise(F.col("fail_reason")),
    })


def heldout_gate_source(rows: DataFrame, heldout: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, rejected, unmatched): rows passing all held-out pairs, those failing one, and
    rows whose task has no held-out pairs."""
    known = heldout.select("task_id").distinct()
    matched = with_verdicts(rows.join(known, "task_id", "left_semi"), verdicts, ["task_id"])
    return (
        matched.where("all_pass"), matched.where(~F.col("all_pass")),
        rows.join(known, "task_id", "left_anti"),
    )


def provenance_tag(rows: DataFrame, provenance: DataFrame) -> DataFrame:
    """repair_rounds where the recorded code is the row's code, else superseded, else unknown."""
    dated = provenance.where(F.col("rounds_used").isNotNull()).select(
        "task_id", "rounds_used", F.col("code").alias("_code"), F.lit(True).alias("_has"))
    tag = (
        F.when(F.col("_has").isNull(), UNKNOWN)
        .when(F.col("_code").isNull() | ~F.col("_code").eqNullSafe(F.col("code")), SUPERSEDED)
        .otherwise(F.col("rounds_used").cast("string")))
    return rows.join(dated, "task_id", "left").withColumn("repair_rounds", tag).drop("_code", "_has", "rounds_used")


def dose_response(tagged: DataFrame, correct: str = "all_pass") -> DataFrame:
    """Held-out correctness per repair-rounds tag with its Wilson interval."""
    per = tagged.groupBy("repair_rounds").agg(count_where(F.col(correct)).alias("correct"), F.count("*").alias("n"))
    rate = ratio(F.col("correct"), F.col("n"))
    low, high = wilson(rate, F.col("n"))
    return per.withColumns({"rate": rate, "rate_low": low, "rate_high": high})


def provenance_summary(tagged: DataFrame) -> DataFrame:
    tag = F.col("repair_rounds")
    return tagged.agg(
        count_where(~tag.isin(UNKNOWN, SUPERSEDED)).alias("rounds_known"),
        count_where(tag == SUPERSEDED).alias(SUPERSEDED), count_where(tag == UNKNOWN).alias(UNKNOWN))


def reject_histogram(rejects: DataFrame) -> DataFrame:
    """The second colon-separated token of the reason, else unknown."""
    kind = F.when(F.contains("fail_reason", F.lit(":")), F.trim(F.get(F.split("fail_reason", ":"), F.lit(1))))
    return rejects.groupBy(F.coalesce(kind, F.lit(UNKNOWN)).alias("kind")).agg(F.count("*").alias("n"))


def augment_gate(tasks: DataFrame, variants: DataFrame, require_heldout: bool = True) -> tuple[DataFrame, DataFrame]:
    """(tagged tasks, tagged variants).

    `tasks`: task_id, n_heldout, base_heldout_pass; `variants`: task_id, variant, train_pass,
    heldout_pass. A task that lacks held-out pairs or fails them loses every variant. A variant
    passing its train pairs and failing its held-out ones is a defect, not a rejection.
    """
    has = F.col("n_heldout") > 0
    task_status = (
        F.when(~has, "missing" if require_heldout else "ok")
        .when(~F.coalesce("base_heldout_pass", F.lit(False)), "gated_out")
        .otherwise("ok"))
    judged = tasks.withColumn("task_status", task_status)
    joined = variants.join(judged.select("task_id", "task_status", has.alias("_has")), "task_id")
    status = (
        F.when(F.col("task_status") != "ok", F.col("task_status"))
        .when(~F.coalesce("train_pass", F.lit(False)), "rejected")
        .when(F.col("_has") & ~F.coalesce("heldout_pass", F.lit(False)), "heldout_mismatch")
        .otherwise("emitted"))
    return judged, joined.withColumn("status", status).withColumn(
        "heldout_ok", (F.col("status") == "emitted") & F.col("_has")).drop("_has")


def refuse_mismatch(variants: DataFrame) -> None:
    if not variants.where("status = 'heldout_mismatch'").isEmpty():
        raise ValueError("variants passed their train pairs and failed their held-out pairs")
    if variants.where("status = 'emitted'").isEmpty():
        raise ValueError("no variant was emitted; an empty corpus is not a result")


def augment_stats(tasks: DataFrame, variants: DataFrame) -> DataFrame:
    """Counts in long form: (measure, name, value)."""
    transform = F.get(F.split("variant", "#"), F.lit(0))
    long = lambda df, measure, name: df.groupBy(F.lit(measure).alias("measure"), name.alias("name")).agg(
        F.count("*").cast("double").alias("value"))
    n = lambda s: count_where(F.col("status") == s)
    totals = variants.agg(n("emitted").alias("e"), n("rejected").alias("r"), n("heldout_mismatch").alias("m"))
    rate = totals.select(
        F.lit("rate").alias("measure"), F.lit("rejection_rate").alias("name"),
        (F.col("r") / F.greatest(F.lit(1), F.col("e") + F.col("r"))).alias("value"))
    return reduce(DataFrame.unionByName, [
        long(variants, "variants", F.col("status")),
        long(tasks, "tasks", F.col("task_status")),
        long(variants.where("status = 'emitted'"), "emitted", transform),
        long(variants.where("status = 'rejected'"), "rejected", transform),
        rate])


def length_median(emitted: DataFrame) -> DataFrame:
    """Upper median of the character-based token estimate of the emitted rows."""
    sized = emitted.select(F.lit(0).alias("_all"), F.floor((F.length("prompt") + F.length("code")) / 4).alias("_size"))
    return order_statistics(sized, ["_all"], "_size", {"median_tokens_est": upper_median_position()}).drop("_all", "n")


def samples(rows: DataFrame, order: list[str], n: int = SAMPLES) -> DataFrame:
    return rows.orderBy(*order).limit(n)


# ---- splits ------------------------------------------------------------------------------

def task_lengths(rows: DataFrame, task: str, text: str) -> DataFrame:
    return rows.groupBy(F.col(task).alias("task")).agg(F.min(F.length(text)).alias("size"))


def stratified_holdout(rows: DataFrame, task: str, text: str, k: int, seed: int) -> DataFrame:
    """One held-out task per equal-count stratum of prompt length.

    Tasks are ranked by (length, id) across the cluster; stratum i holds ranks
    [i n // k, (i + 1) n // k).
    """
    tasks = task_lengths(rows, task, text)
    ranked = rank_overall(tasks, ["size", "task"], "rank")
    n = ranked.agg(F.max("rank")).first()[0] or 0
    if k < 1 or n < MIN_TRAIN_MULTIPLE * k:
        raise ValueError(f"{n} tasks cannot spare {k} to validation; at most {n // MIN_TRAIN_MULTIPLE}")
    stratum = F.expr(f"(rank * {k} - 1) div {n}")
    pick = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("task").cast("string")))
    chosen = ranked.withColumn("stratum", stratum).groupBy("stratum").agg(
        F.min_by(F.struct("task", "size"), F.struct(pick, "task")).alias("c"))
    return chosen.select("stratum", F.col("c.task").alias("task"), F.col("c.size").alias("size"))


def split_by_task(rows: DataFrame, task: str, holdout: DataFrame) -> DataFrame:
    """Every row follows its task."""
    held = holdout.select(F.col("task").alias(task), F.lit("val").alias("_s"))
    return rows.join(held, task, "left").withColumn("split", F.coalesce("_s", F.lit("train"))).drop("_s")


def split_guards(split: DataFrame, task: str, has_heldout: Column) -> DataFrame:
    """One row of checks: no task on both sides, sizes add up, held-out coverage all or nothing."""
    sides = split.groupBy(task).agg(F.countDistinct("split").alias("_n"))
    leaks = sides.agg(count_where(F.col("_n") > 1).alias("tasks_on_both_sides")).withColumn("_one", F.lit(1))
    val = F.col("split") == "val"
    sizes = split.agg(
        F.count("*").alias("rows"), count_where(~val).alias("train_rows"), count_where(val).alias("val_rows"),
        count_where(val & has_heldout).alias("val_rows_with_heldout")).withColumn("_one", F.lit(1))
    partial = (F.col("val_rows_with_heldout") > 0) & (F.col("val_rows_with_heldout") < F.col("val_rows"))
    return sizes.join(leaks, "_one").drop("_one").withColumn(
        "ok", (F.col("tasks_on_both_sides") == 0) & (F.col("rows") == F.col("train_rows") + F.col("val_rows")) & ~partial)


def enforce_guards(guards: DataFrame) -> None:
    row = guards.first()
    if not row.ok:
        raise ValueError(f"split refused: {row.asDict()}")


def split_stats(split: DataFrame, task: str, text: str) -> DataFrame:
    """Rows, tasks and the upper-median task length of the corpus and each side."""
    both = split.select(task, text, F.explode(F.array(F.lit("corpus"), F.col("split"))).alias("part"))
    tasks = both.groupBy("part", task).agg(F.count("*").alias("_n"), F.min(F.length(text)).alias("_size"))
    sizes = tasks.groupBy("part").agg(F.sum("_n").alias("rows"), F.count("*").alias("tasks"))
    mid = order_statistics(tasks, ["part"], "_size", {"median_chars": upper_median_position()}).drop("n")
    return sizes.join(mid, "part")
