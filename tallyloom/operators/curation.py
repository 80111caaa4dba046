"""Corpus curation: validation, de-duplication, decontamination, filters, audit, funnel."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as tx
from tallyloom.functions.stats import count_where, order_statistics, quantile_position, ratio, upper_median_position
from tallyloom.operators.similarity import (
    best_similarity, fold_identical, nearly_repeated, shingle_sets, similar_pairs,
)
from tallyloom.session import by_key, durable, durable_by

CONTAMINATION_THRESHOLD = 0.6
NEAR_DUPLICATE_THRESHOLD = 0.9
MIN_QUALITY = 4
TRAIN_PERCENT = 90
PII_NOTE = "heuristic regex scan, not a compliance-grade classification"


def validate_source(df: DataFrame, required: Sequence[str], expected: int, corrupt: str = "_corrupt_record") -> DataFrame:
    """One row of facts on a source: counts, unreadable rows, missing fields, and `ok`.

    A source that is not ok is escalated by the caller; it is never replaced.
    """
    absent = [c for c in required if c not in df.columns]
    bad = F.col(corrupt).isNotNull() if corrupt in df.columns else F.lit(False)
    blank = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required if c in df.columns], F.lit(False))
    return df.agg(
        F.count("*").alias("n_rows"), count_where(bad).alias("n_unreadable"),
        count_where(blank).alias("n_incomplete"),
    ).withColumns(
        {
            "n_expected": F.lit(expected).cast("long"),
            "missing_fields": F.lit(",".join(absent)),
            "ok": (F.col("n_rows") == expected) & (F.col("n_unreadable") == 0)
            & (F.col("n_incomplete") == 0) & F.lit(not absent),
        }
    )


def provenance_counts(df: DataFrame, origin: str = "origin") -> DataFrame:
    return df.groupBy(F.coalesce(origin, F.lit("unstated")).alias("origin")).agg(F.count("*").alias("n"))


def think_report(df: DataFrame, text: str) -> DataFrame:
    """How many answers carry a closed reasoning block and how much stripping removes."""
    return df.agg(
        F.count("*").alias("n_rows"),
        count_where(tx.has_closed_think(F.col(text))).alias("n_closed_think"),
        (count_where(tx.has_closed_think(F.col(text))) / F.count("*")).alias("closed_think_rate"),
        F.sum(F.length(text) - F.length(tx.strip_think(F.col(text)))).alias("chars_removed"),
    )


def content_key(columns: Sequence[str]) -> Column:
    """A digest of the columns in which null and empty stay apart."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def exact_duplicates(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, survivor) of every row whose content an earlier key already has.

    The survivor is the smallest key per content; the minimum is combined before the shuffle,
    so a third of the rows being one text costs one row per task.
    """
    marked = df.select(key, content_key(columns).alias("_content"))
    firsts = marked.groupBy("_content").agg(F.min(key).alias("survivor"), F.count("*").alias("_n"))
    repeated = firsts.where("_n > 1").select("_content", "survivor")
    return marked.join(repeated, "_content").where(F.col(key) != F.col("survivor")).select(key, "survivor")


def exact_dedupe(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    return df.join(exact_duplicates(df, key, columns).select(key), key, "left_anti")


def shingle_table(df: DataFrame, key: str, text: str, n: int = 3, unit: str = "word") -> DataFrame:
    """The rows' shingle sets, written down by key for several operators to share (their `sets`).

    Texts travel to their key's bucket, being smaller than their sets.
    """
    rows = by_key(df.select(F.col(key).alias("id"), F.col(text).alias("text")), "id")
    return durable_by(shingle_sets(rows, "id", "text", n, unit), "id", "sets")


def near_duplicates(df: DataFrame, key: str, text: str, threshold: float = NEAR_DUPLICATE_THRESHOLD, n: int = 3, unit: str = "word", sets: DataFrame | None = None) -> DataFrame:
    """Keys of rows at least `threshold` alike (n-gram Jaccard) to a row with a smaller key."""
    sets = shingle_table(df, key, text, n, unit) if sets is None else sets
    return nearly_repeated(sets, threshold).withColumnRenamed("id", key)


def near_dedupe(df: DataFrame, key: str, text: str, threshold: float = NEAR_DUPLICATE_THRESHOLD, n: int = 3, unit: str = "word") -> DataFrame:
    return df.join(near_duplicates(df, key, text, threshold, n, unit), key, "left_anti")


def length_format_filter(df: DataFrame, text: str, low: int, high: int, pattern: str | None = None) -> DataFrame:
    size = F.length(text)
    keep = (size >= low) & (size <= high)
    return df.where(keep & F.rlike(text, F.lit(pattern)) if pattern else keep)


def pii_scrub(df: DataFrame, text: str, patterns: dict[str, str] = tx.PII_PATTERNS) -> DataFrame:
    return df.withColumn(text, tx.scrub_pii(F.col(text), patterns))


def pii_scan(df: DataFrame, text: str, patterns: dict[str, str] = tx.PII_PATTERNS) -> DataFrame:
    """Matches and affected rows per kind of personal data, with the scan's own caveat."""
    counts = tx.count_pii(F.col(text), patterns)
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("n")) for k, c in counts.items()])).alias("x")
    ).select("x.*")
    return long.groupBy("kind").agg(
        F.sum("n").alias("matches"), count_where(F.col("n") > 0).alias("rows_affected")
    ).withColumn("note", F.lit(PII_NOTE))


def quality_filter(df: DataFrame, scores: DataFrame, key: str, score: str = "score", minimum: int = MIN_QUALITY) -> DataFrame:
    """Keep rows scored at or above the minimum; an unscored row has not passed."""
    return df.join(scores.where(F.col(score) >= minimum).select(key), key, "left_semi")


def split_by_hash(df: DataFrame, key: str, seed: int, percent: int = TRAIN_PERCENT) -> DataFrame:
    """Stable train/val split: it depends on the key and seed, not on partitioning."""
    digest = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 7)
    bucket = F.conv(digest, 16, 10).cast("long") % 100
    return df.withColumn("split", F.when(bucket < percent, "train").otherwise("val"))


# ---- decontamination ---------------------------------------------------------------------

def acceptance_layers(layers: dict[str, DataFrame], key: str, text: str) -> DataFrame:
    """Stack acceptance layers as (layer, item, text). An unreadable layer raises here."""
    if not layers:
        raise ValueError("no acceptance layer given")
    stacked = [
        df.select(F.lit(name).alias("layer"), F.col(key).alias("item"), F.col(text).alias("text"))
        for name, df in layers.items()
    ]
    return reduce(DataFrame.unionByName, stacked)


def contaminated(train: DataFrame, key: str, text: str, acceptance: DataFrame, threshold: float = CONTAMINATION_THRESHOLD, n: int = 3, unit: str = "word", sets: DataFrame | None = None) -> DataFrame:
    """(layer, key) of every training row at least `threshold` alike to an item of the layer."""
    rows, members, items = _sides(train, key, text, acceptance, n, unit, sets)
    hits = similar_pairs(rows, items, threshold, "layer").select("layer", F.col("id_l").alias("rep")).distinct()
    return members.join(hits, "rep").select("layer", F.col("id").alias(key))


def _sides(train, key, text, acceptance, n, unit, sets=None):
    sets = shingle_table(train, key, text, n, unit) if sets is None else sets
    rows, members = fold_identical(sets)
    items = (
        acceptance.select("layer", F.col("item").alias("id"), tx.shingles(F.col("text"), n, unit).alias("toks"))
        .withColumn("n", F.size("toks")).where("n > 0")
    )
    items, _ = fold_identical(items, "layer")
    return rows, members, durable(items, "items")


def decontaminate(train: DataFrame, key: str, text: str, layers: dict[str, DataFrame], item_key: str, item_text: str, threshold: float = CONTAMINATION_THRESHOLD, n: int = 3, unit: str = "word") -> tuple[DataFrame, DataFrame]:
    """(clean rows, stats): rows too alike to any layer go; each layer reports its drop count.

    `stats` has one row per layer with dropped (zero written out) and the largest Jaccard left.
    """
    acceptance = acceptance_layers(layers, item_key, item_text)
    rows, members, items = _sides(train, key, text, acceptance, n, unit)
    hits = similar_pairs(rows, items, threshold, "layer").select("layer", F.col("id_l").alias("rep")).distinct()
    bad = durable(members.join(hits, "rep").select("layer", F.col("id").alias(key)), "bad")
    clean = train.join(bad.select(key).distinct(), key, "left_anti")
    kept = rows.join(hits.select(F.col("rep").alias("id")).distinct(), "id", "left_anti")
    left = best_similarity(kept, items, "layer")
    dropped = bad.groupBy("layer").agg(F.count("*").alias("dropped"))
    names = train.sparkSession.createDataFrame([(name,) for name in layers], "layer string")
    stats = names.join(dropped, "layer", "left").join(left, "layer", "left").select(
        "layer", F.coalesce("dropped", F.lit(0)).alias("dropped"),
        F.coalesce("max_jaccard", F.lit(0.0)).alias("max_jaccard_left"),
    )
    return clean, stats


def contamination_check(sample: DataFrame, key: str, text: str, layers: dict[str, DataFrame], item_key: str, item_text: str, threshold: float = CONTAMINATION_THRESHOLD, sets: DataFrame | None = None) -> DataFrame:
    """Overlap of a sample with each acceptance layer; reports only, drops nothing."""
    acceptance = acceptance_layers(layers, item_key, item_text)
    found = contaminated(sample, key, text, acceptance, threshold, sets=sets)
    per = found.groupBy("layer").agg(F.countDistinct(key).alias("n_overlapping"))
    names = sample.sparkSession.createDataFrame([(name,) for name in layers], "layer string")
    return names.join(per, "layer", "left").withColumn("n_overlapping", F.coalesce("n_overlapping", F.lit(0)))


def content_hash_decontaminate(train: DataFrame, evaluation: DataFrame, content: str) -> DataFrame:
    """Training rows whose bytes appear in no evaluation layer (sha256 equality)."""
    digest = lambda: F.sha2(F.col(content).cast("binary"), 256)
    held = evaluation.select(digest().alias("_sha")).distinct()
    return train.withColumn("_sha", digest()).join(held, "_sha", "left_anti").drop("_sha")


# ---- audits and reports ------------------------------------------------------------------

def validate_detection_set(images: DataFrame, annotations: DataFrame, files: DataFrame) -> DataFrame:
    """(problem, name) rows: absent files, annotations of unknown images, degenerate boxes per file.

    `images`: id, file_name; `annotations`: id, image_id, category_id, bbox; `files`: file_name.
    """
    absent = images.join(files.select("file_name"), "file_name", "left_anti").select(
        F.lit("image file missing").alias("problem"), F.col("file_name").alias("name"), F.lit(1).cast("long").alias("n"))
    known = images.select(F.col("id").alias("image_id"))
    orphan = annotations.join(known, "image_id", "left_anti").groupBy("image_id").agg(F.count("*").alias("n")).select(
        F.lit("annotation of unknown image").alias("problem"), F.col("image_id").cast("string").alias("name"), "n")
    flat = annotations.where((F.col("bbox")[2] <= 0) | (F.col("bbox")[3] <= 0))
    degenerate = flat.join(images.select(F.col("id").alias("image_id"), "file_name"), "image_id").groupBy("file_name").agg(
        F.count("*").alias("n")).select(F.lit("degenerate box").alias("problem"), F.col("file_name").alias("name"), "n")
    return absent.unionByName(orphan).unionByName(degenerate)


def class_distribution(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("category_id").agg(F.count("*").alias("n_boxes"))


def readiness_audit(df: DataFrame, key: str, text: str, label: str, layers: dict[str, DataFrame], item_key: str, item_text: str, max_near_dup: float = 0.1) -> DataFrame:
    """Volume, verifiability, near-duplicate rate, contamination, PII, and the verdict with its gaps."""
    pii = sum(tx.count_pii(F.col(text)).values(), F.lit(0))
    facts = df.agg(
        F.count("*").alias("n_rows"),
        count_where(F.trim(F.coalesce(text, F.lit(""))) == "").alias("n_empty"),
        count_where(F.col(label).isNotNull()).alias("n_verifiable"),
        count_where(pii > 0).alias("n_with_pii"),
    ).withColumn("_one", F.lit(1))
    sets = shingle_table(df, key, text)
    near = near_duplicates(df, key, text, sets=sets).agg(F.count("*").alias("n_near_duplicates")).withColumn("_one", F.lit(1))
    dirty = contamination_check(df, key, text, layers, item_key, item_text, sets=sets).agg(
        F.sum("n_overlapping").alias("n_contaminated")).withColumn("_one", F.lit(1))
    one = facts.join(near, "_one").join(dirty, "_one").drop("_one")
    gap = lambda cond, name: F.when(cond, F.lit(name))
    gaps = F.filter(
        F.array(
            gap(F.col("n_verifiable") == 0, "no ground truth"),
            gap(F.col("n_empty") > 0, "empty rows"),
            gap(F.col("n_near_duplicates") > max_near_dup * F.col("n_rows"), "near duplicates"),
            gap(F.col("n_contaminated") > 0, "contaminated"),
            gap(F.col("n_with_pii") > 0, "personal data"),
        ), lambda g: g.isNotNull())
    blocked = (F.col("n_verifiable") == 0) | (F.col("n_contaminated") > 0)
    return one.withColumn("gaps", F.array_join(gaps, "|")).withColumn(
        "verdict",
        F.when(blocked, "not-ready").when(F.col("gaps") != "", "ready-with-caveats").otherwise("ready"),
    )


def curation_funnel(df: DataFrame, key: str, drops: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Rows in, dropped and out per stage, in stage order.

    `drops` are (stage, keys dropped by it); a row counts for the first stage that drops it, so
    in = out + dropped holds at every stage and over the whole funnel.
    """
    tagged = df.select(F.col(key).alias("_k"))
    marks = None
    for i, (_, keys) in enumerate(drops):
        part = keys.select(F.col(key).alias("_k"), F.lit(i).alias("_stage"))
        marks = part if marks is None else marks.unionByName(part)
    first = marks.groupBy("_k").agg(F.min("_stage").alias("_stage"))
    counts = tagged.join(first, "_k", "left").groupBy("_stage").agg(F.count("*").alias("dropped"))
    # From here on there is one row per stage.
    names = df.sparkSession.createDataFrame(
        [(i, name) for i, (name, _) in enumerate(drops)] + [(len(drops), "kept")], "_stage int, stage string")
    return _cumulate(names, counts.withColumn("_stage", F.coalesce("_stage", F.lit(len(drops)))), len(drops))


def _cumulate(names: DataFrame, counts: DataFrame, last: int) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(0)).orderBy("_stage")
    rows = names.join(counts, "_stage", "left").withColumn("_n", F.coalesce("dropped", F.lit(0)))
    after = F.sum("_n").over(w.rowsBetween(0, Window.unboundedFollowing))
    return rows.select("_stage", "stage", after.alias("rows_in"), F.col("_n").alias("dropped")).where(
        F.col("_stage") < last
    ).select(F.col("_stage").cast("long").alias("stage_no"), "stage", "rows_in", "dropped",
             (F.col("rows_in") - F.col("dropped")).alias("rows_out"))


def drop_overlong(df: DataFrame, size: Column, limit: int) -> DataFrame:
    """Drop, never cut, rows longer than the limit."""
    return df.where(size <= limit)


def overlong_report(df: DataFrame, size: Column, limit: int, split: str = "split") -> DataFrame:
    over = count_where(size > limit)
    return df.groupBy(split).agg(
        F.count("*").alias("before"), over.alias("dropped"), (100.0 * over / F.count("*")).alias("dropped_pct")
    )


def overlong_census(df: DataFrame, size: Column, limit: int, task: str, split: str = "split") -> DataFrame:
    """Rows dropped, source tasks lost whole and tasks straddling the window, per split."""
    per_task = df.groupBy(split, task).agg(
        count_where(size > limit).alias("_over"), F.count("*").alias("_n"))
    return per_task.groupBy(split).agg(
        F.sum("_n").alias("rows"), F.sum("_over").alias("rows_dropped"), F.count("*").alias("tasks"),
        count_where(F.col("_over") == F.col("_n")).alias("tasks_lost"),
        count_where((F.col("_over") > 0) & (F.col("_over") < F.col("_n"))).alias("tasks_straddling"),
    )


def token_census(df: DataFrame, size: Column, split: str, chars_per_token: float) -> DataFrame:
    """p50/p90/p99/max length per split; the estimate's ratio travels with the numbers."""
    sized = df.withColumn("_size", size)
    picks = {"p50": upper_median_position(), "p90": quantile_position(0.9), "p99": quantile_position(0.99)}
    tails = order_statistics(sized, [split], "_size", picks)
    return tails.join(sized.groupBy(split).agg(F.max("_size").alias("max")), split).withColumn(
        "chars_per_token", F.lit(chars_per_token))


def probe_samples(df: DataFrame, key: str, size: Column, n: int, seed: int) -> DataFrame:
    """n seeded representative rows and the n longest, each tagged with its probe."""
    pick = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    sized = df.withColumn("size", size)
    fair = sized.orderBy(pick, key).limit(n).withColumn("probe", F.lit("representative"))
    edge = sized.orderBy(F.col("size").desc(), key).limit(n).withColumn("probe", F.lit("edge"))
    return fair.unionByName(edge)


def probe_report(samples: DataFrame, corpus: DataFrame, size: Column) -> DataFrame:
    mean = lambda c: (F.sum(c) / F.count("*"))
    whole = corpus.agg(F.lit("corpus").alias("probe"), F.count("*").alias("n"), mean(size).alias("mean_size"))
    return samples.groupBy("probe").agg(F.count("*").alias("n"), mean("size").alias("mean_size")).unionByName(whole)


def cap_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)
