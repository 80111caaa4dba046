"""Detection scoring: validation, overlap, greedy matching, average precision, bootstrap."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.stats import count_where, ratio
from tallyloom.operators.ordering import range_chunks, rank_overall, running_total
from tallyloom.session import durable

# Fixed thresholds and recall points.
THRESHOLDS = (0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95)
RECALL_STEPS = 100


def validate_predictions(records: DataFrame, column: str) -> DataFrame:
    """Type raw JSON prediction records and mark the well-formed ones.

    Four numeric box values (booleans are not numbers), positive size, whole category, score in
    [0, 1]. Adds bbox, category_id, score, valid.
    """
    raw = F.try_parse_json(column)
    kind = lambda path: F.regexp_extract(F.schema_of_variant(F.try_variant_get(raw, path, "variant")), r"^(\w+)", 1)
    whole = ("TINYINT", "SMALLINT", "INT", "BIGINT")
    number = lambda path: kind(path).isin(*whole, "DECIMAL", "DOUBLE", "FLOAT")
    box = F.try_variant_get(raw, "$.bbox", "array<double>")
    parsed = records.withColumns({
        "bbox": box,
        "category_id": F.when(kind("$.category_id").isin(*whole), F.try_variant_get(raw, "$.category_id", "bigint")),
        "score": F.when(number("$.score"), F.try_variant_get(raw, "$.score", "double")),
        "_nums": number("$.bbox[0]") & number("$.bbox[1]") & number("$.bbox[2]") & number("$.bbox[3]"),
    })
    good = (
        F.col("_nums") & (F.size("bbox") == 4) & (F.get("bbox", F.lit(2)) > 0) & (F.get("bbox", F.lit(3)) > 0)
        & F.col("category_id").isNotNull() & F.col("score").between(0.0, 1.0))
    return parsed.withColumn("valid", F.coalesce(good, F.lit(False))).drop("_nums")


def format_validity(validated: DataFrame) -> DataFrame:
    good = count_where(F.col("valid"))
    return validated.agg(
        F.count("*").alias("n_records"), count_where(~F.col("valid")).alias("invalid_predictions"),
        F.when(F.count("*") == 0, 1.0).otherwise(good / F.count("*")).alias("format_validity"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of absolute [x, y, w, h] boxes; an empty union gives 0."""
    at = lambda box, i: F.get(box, F.lit(i))
    span = lambda i: F.greatest(
        F.lit(0.0),
        F.least(at(a, i) + at(a, i + 2), at(b, i) + at(b, i + 2)) - F.greatest(at(a, i), at(b, i)))
    inter = span(0) * span(1)
    union = at(a, 2) * at(a, 3) + at(b, 2) * at(b, 3) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


CROWD = 64  # boxes a side from which an image and category is cut into cells
LOWEST, HIGHEST = -10, 40  # powers of two that a box's side is classed by


def _level(box: str) -> Column:
    """The power of two not below the longer side."""
    side = F.greatest(F.get(F.col(box), F.lit(2)), F.get(F.col(box), F.lit(3)))
    power = F.when(side > 0, F.ceil(F.log2(side))).otherwise(LOWEST)
    return F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), power)).cast("int")


def _cells(box: str, level: str) -> Column:
    """The cells of a level's grid that a box covers: four at most from its own level on."""
    at = lambda i: F.get(F.col(box), F.lit(i))
    size = F.pow(F.lit(2.0), F.col(level))
    run = lambda i: F.sequence(F.floor(at(i) / size), F.floor((at(i) + at(i + 2)) / size))
    return F.flatten(F.transform(run(0), lambda x: F.transform(run(1), lambda y: F.struct(x.alias("x"), y.alias("y")))))


def _placed(boxes: DataFrame, box: str, own: str, span: Column) -> DataFrame:
    """One row per cell of the box's own level and those up to `span` above it."""
    levels = boxes.withColumn("level", F.explode(F.sequence(F.col(own), F.greatest(F.col(own), span))))
    return levels.withColumn("cell", F.explode(_cells(box, "level"))).drop(box)


def _flat(boxes: DataFrame, box: str, side: str, *keep: Column | str) -> DataFrame:
    """Corners, area and size class of the boxes as plain columns, computed once per box."""
    at = lambda i: F.get(F.col(box), F.lit(i))
    return boxes.select("image_id", "category_id", *keep, at(0).alias(f"_x{side}"), at(1).alias(f"_y{side}"),
                        (at(0) + at(2)).alias(f"_r{side}"), (at(1) + at(3)).alias(f"_b{side}"), (at(2) * at(3)).alias(f"_a{side}"),
                        F.col(box).alias(f"_{side}"), _level(box).alias(f"_own_{side}"))


def _gridded(d: DataFrame, t: DataFrame, floor: float) -> DataFrame:
    """Pairs of boxes that meet in a cell, each in the one cell that holds the corner of its intersection."""
    if floor > 0:
        above = max(0, math.ceil(math.log2(1 / floor)))
        span = lambda own: F.col(own) + above
    else:
        top = d.select(F.max("_own_d").alias("m")).unionByName(t.select(F.max("_own_t").alias("m"))).agg(F.max("m")).first()[0]
        span = lambda own: F.lit(LOWEST if top is None else top)
    d, t = _placed(d, "_d", "_own_d", span("_own_d")), _placed(t, "_t", "_own_t", span("_own_t"))
    corner = lambda c: F.floor(F.greatest(f"_{c}d", f"_{c}t") / F.pow(F.lit(2.0), F.col("level")))
    pairs = d.join(t, ["image_id", "category_id", "level", "cell"]).where(
        (F.col("level") == F.greatest("_own_d", "_own_t")) & (F.col("cell.x") == corner("x")) & (F.col("cell.y") == corner("y")))
    return pairs.drop("level", "cell")


def _overlapping(d: DataFrame, t: DataFrame, floor: float) -> DataFrame:
    """Pairs of `_flat` boxes with their iou, at least `floor`, and what the sides keep."""
    on = ["image_id", "category_id"]
    counts = d.groupBy(*on).agg(F.count("*").alias("_n")).join(t.groupBy(*on).agg(F.count("*").alias("_m")), on)
    crowded = durable(counts.where(F.col("_n") * F.col("_m") > CROWD * CROWD).select(*on), "crowded")
    if crowded.isEmpty():
        pairs = d.drop("_d", "_own_d").join(t.drop("_t", "_own_t"), on)
    else:
        few = d.join(crowded, on, "left_anti").drop("_d", "_own_d").join(t.drop("_t", "_own_t"), on)
        many = _gridded(d.join(crowded, on, "left_semi"), t.join(crowded, on, "left_semi"), floor)
        pairs = few.unionByName(many.select(*few.columns))
    across = lambda low, high: F.greatest(F.lit(0.0), F.least(f"_{high}d", f"_{high}t") - F.greatest(f"_{low}d", f"_{low}t"))
    inter = across("x", "r") * across("y", "b")
    union = F.col("_ad") + F.col("_at") - inter
    near = pairs.where((F.least("_ad", "_at") >= floor * F.greatest("_ad", "_at"))
                       & (F.least("_rd", "_rt") > F.greatest("_xd", "_xt")) & (F.least("_bd", "_bt") > F.greatest("_yd", "_yt")))
    found = near.withColumn("iou", F.when(union > 0, inter / union).otherwise(0.0))
    kept = [c for c in pairs.columns if not c.startswith("_")]
    return found.where((F.col("iou") > 0) & (F.col("iou") >= floor)).select(*kept, "iou")


def box_iou(dets: DataFrame, gts: DataFrame, floor: float = 0.0) -> DataFrame:
    """(image_id, category_id, det_id, gt_id, iou) of overlapping boxes with IoU >= floor.

    Boxes of an image and category meet directly unless they are a crowd, more than `CROWD` times
    `CROWD` pairs. A crowd is classed by size, a power of two, and meets in the cells of the larger
    one's grid, of which each covers four at most; a pair is kept in the one cell that holds the
    corner of its intersection. Sides of boxes that reach the floor differ by a factor of 1 / floor
    at most, so a box enters only so many grids above its own; without a floor, those of all sizes
    present. `dets`: det_id, image_id, category_id, bbox; `gts`: gt_id and the same.
    """
    return _overlapping(_flat(dets, "bbox", "d", "det_id"), _flat(gts, "bbox", "t", "gt_id"), floor)


def greedy_match(dets: DataFrame, gts: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """(thr, det_id, gt_id) true positives of score-ordered greedy matching.

    Taking detections by (score desc, input order), each claims the unclaimed box with the
    highest IoU, the later box on ties. Rounds settle at once every detection that comes first
    for the box it wants, which yields the sequential result without ordering a group in one
    task. `dets` adds score and ord; `gts` adds ord.
    """
    prio = F.struct((-F.col("score")).alias("s"), F.col("ord").alias("o")).alias("prio")
    d = _flat(dets.where("det_id IS NOT NULL"), "bbox", "d", "det_id", prio)
    t = _flat(gts.where("gt_id IS NOT NULL"), "bbox", "t", "gt_id", F.col("ord").alias("gt_ord"))
    thr = F.explode(F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda at: F.col("iou") >= at))
    edges = _overlapping(d, t, min(thresholds)).withColumn("thr", thr)
    edges = durable(edges.select("thr", "det_id", "gt_id", "iou", "prio", "gt_ord"), "edges")
    done = None
    while not edges.isEmpty():
        wanted = edges.groupBy("thr", "det_id").agg(F.max_by("gt_id", F.struct("iou", "gt_ord")).alias("gt_id"))
        first = edges.groupBy("thr", "gt_id").agg(F.min_by("det_id", F.struct("prio", "det_id")).alias("_first"))
        settled = durable(
            wanted.join(first, ["thr", "gt_id"]).where(F.col("_first") == F.col("det_id")).select("thr", "det_id", "gt_id"), "match")
        done = settled if done is None else done.unionByName(settled)
        rest = edges.join(settled.select("thr", "det_id"), ["thr", "det_id"], "left_anti")
        edges = durable(rest.join(settled.select("thr", "gt_id"), ["thr", "gt_id"], "left_anti").select(*edges.columns), "edges")
    return done if done is not None else edges.select("thr", "det_id", "gt_id")


def flagged_detections(dets: DataFrame, matches: DataFrame, gts: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Detections of ground-truth categories with one true-positive column per threshold."""
    hits = matches.groupBy("det_id").agg(
        *[F.max(F.when(F.col("thr") == float(t), 1)).alias(f"tp{i}") for i, t in enumerate(thresholds)])
    known = gts.select("category_id").distinct()
    images = gts.select("image_id").distinct()
    rows = dets.join(known, "category_id", "left_semi").join(images, "image_id", "left_semi")
    return rows.join(hits, "det_id", "left").fillna(0, [f"tp{i}" for i in range(len(thresholds))])


def _score_order() -> list[Column]:
    return [F.col("score").desc(), F.col("image_id").cast("string").asc(), F.col("ord").asc()]


def ordered_detections(flagged: DataFrame) -> DataFrame:
    """Range-sorted by category and score, ties by image name and input order."""
    return range_chunks(flagged, [F.col("category_id"), *_score_order()], "_range")


def average_precision(ordered: DataFrame, n_gt: DataFrame, n_thr: int, keys: Sequence[str] = ("category_id",), weight: Column | None = None) -> DataFrame:
    """(keys, t, ap): 101-point interpolated precision per key and threshold index.

    `n_gt`: keys, n_gt. A key without ground truth has no row; one without detections scores 0.
    The envelope needs only the best precision per recall step, so it is an aggregate.
    """
    w = F.lit(1) if weight is None else weight
    measures = {"_rank": w, **{f"_cum{i}": F.col(f"tp{i}") * w for i in range(n_thr)}}
    order = [F.col("category_id"), *_score_order()]
    summed = running_total(ordered, list(keys), order, measures, "_range")
    per = F.explode(F.array(*[
        F.struct(F.lit(i).alias("t"), F.col(f"tp{i}").alias("tp"), F.col(f"_cum{i}").alias("cum")) for i in range(n_thr)]))
    long = summed.select(*keys, "_rank", per.alias("x")).select(*keys, "_rank", "x.*").where("tp = 1 AND cum > 0")
    recall = F.col("cum") / F.col("n_gt")
    guess = F.floor(recall * RECALL_STEPS + 1)
    step = F.when(guess * 0.01 <= recall, guess).when((guess - 1) * 0.01 <= recall, guess - 1).otherwise(guess - 2)
    best = (
        long.join(n_gt, list(keys)).withColumn("step", F.least(step, F.lit(RECALL_STEPS)))
        .groupBy(*keys, "t", "step").agg(F.max(F.col("cum") / F.col("_rank")).alias("p")))
    # A step's precision is the best at that recall or beyond: at most 101 rows per key from here.
    after = Window.partitionBy(*keys, "t").orderBy(F.col("step").desc())
    span = F.col("step") - F.coalesce(F.lag("step", -1).over(after), F.lit(-1))
    area = best.withColumn("_env", F.max("p").over(after.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_span", span)
    # Added up in step order, so the last digit does not depend on row order.
    parts = F.sort_array(F.collect_list(F.struct("step", (F.col("_env") * F.col("_span")).alias("a"))))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x["a"])
    found = area.groupBy(*keys, "t").agg((total / (RECALL_STEPS + 1)).alias("ap"))
    grid = n_gt.where("n_gt > 0").select(*keys, F.explode(F.sequence(F.lit(0), F.lit(n_thr - 1))).alias("t"))
    return grid.join(found, [*keys, "t"], "left").withColumn("ap", F.coalesce("ap", F.lit(0.0)))


def evaluate(dets: DataFrame, gts: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    matches = greedy_match(dets, gts, thresholds)
    ordered = ordered_detections(flagged_detections(dets, matches, gts, thresholds))
    n_gt = gts.groupBy("category_id").agg(F.count("*").alias("n_gt"))
    return average_precision(ordered, n_gt, len(thresholds))


def _mean(col: Column) -> Column:
    return F.sum(col.cast("decimal(28,15)")).cast("double") / F.count(col)


def map_report(ap: DataFrame, gts: DataFrame) -> DataFrame:
    """mAP50, mAP50-95, and the images and categories of the ground truth."""
    means = ap.agg(
        F.coalesce(_mean(F.when(F.col("t") == 0, F.col("ap"))), F.lit(0.0)).alias("map50"),
        F.coalesce(_mean(F.col("ap")), F.lit(0.0)).alias("map50_95")).withColumn("_one", F.lit(1))
    sizes = gts.agg(
        F.countDistinct("image_id").alias("images"), F.countDistinct("category_id").alias("categories")).withColumn("_one", F.lit(1))
    return means.join(sizes, "_one").drop("_one")


def ap50_per_category(ap: DataFrame) -> DataFrame:
    return ap.where("t = 0").select("category_id", F.col("ap").alias("ap50"))


def _numbered_images(gts: DataFrame) -> DataFrame:
    """(image_id, pos): the images of the ground truth, numbered by name."""
    images = gts.select(F.col("image_id").cast("string").alias("_name"), "image_id").distinct()
    return durable(rank_overall(images, ["_name"], "_r").select("image_id", (F.col("_r") - 1).alias("pos")), "images")


def bootstrap_weights(gts: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(b, image_id, weight): how often each resample with replacement draws an image.

    Draw j of resample b is a hash of (seed, b, j), one row of a range that Spark makes in parallel;
    images are numbered by name. Draws of an image are combined before they are shuffled.
    """
    numbered = _numbered_images(gts)
    n = numbered.count()
    b, j = F.floor(F.col("id") / max(n, 1)), F.pmod(F.col("id"), F.lit(max(n, 1)))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), b.cast("string"), j.cast("string")))
    draws = gts.sparkSession.range(replicates * n).select(
        b.alias("b"), F.pmod(F.conv(F.substring(digest, 1, 13), 16, 10).cast("long"), F.lit(max(n, 1))).alias("pos"))
    return draws.groupBy("b", "pos").agg(F.count("*").alias("weight")).join(numbered, "pos").drop("pos")


RUN = 16_384  # boxes of a category that travel as one row
WEIGHT_BYTES = 96_000_000  # of image weights a task holds


def drawn_weights(n: int, first: int, last: int, seed: int) -> np.ndarray:
    """(image, resample) table of what `bootstrap_weights` draws in resamples first .. last - 1."""
    made = np.zeros((n, last - first), np.uint8)
    for b in range(first, last):
        drawn = np.empty(n, np.int64)
        for at in range(0, n, 1 << 17):
            end = min(n, at + (1 << 17))
            digests = b"".join([md5(b"%d:%d:%d" % (seed, b, j), usedforsecurity=False).digest() for j in range(at, end)])
            drawn[at:end] = (np.frombuffer(digests, ">u8")[::2] >> np.uint64(12)) % np.uint64(n)
        weight = np.bincount(drawn, minlength=n)
        if weight.max(initial=0) > np.iinfo(made.dtype).max:
            made = made.astype(np.int64)
        made[:, b - first] = weight
    return made


def _packed(rows: DataFrame, kind: int, category: str) -> DataFrame:
    """Rows (category_id, pos, mark), sorted by category in each partition, as arrays of at most `RUN` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(batches):
            keys, part = batch.column("category_id"), batch.column("part")
            at, mark = batch.column("pos").to_numpy(), batch.column("mark").to_numpy()
            at = at.astype(np.int32 if at.max(initial=0) < 1 << 31 else np.int64)
            mark = mark.astype(np.uint8 if mark.max(initial=0) < 1 << 8 else np.int64)
            code = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
            borders = np.flatnonzero(np.diff(code)) + 1
            starts = np.unique(np.concatenate([borders, np.arange(0, len(code), RUN)])).astype(np.int64)
            ends = np.append(starts[1:], len(code))
            made = [keys.take(pa.array(starts)), part.take(pa.array(starts)), pa.array([k] * len(starts), pa.int64()), pa.array(starts, pa.int64()),
                    pa.array([kind] * len(starts), pa.int32()), pa.array(ends - starts, pa.int64()),
                    pa.array([at[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()), pa.array([mark[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())]
            yield pa.RecordBatch.from_arrays(made, ["category_id", "part", "batch", "first", "kind", "rows", "at", "mark"])

    given = rows.select("category_id", F.spark_partition_id().alias("part"), F.col("pos").cast("long"), F.col("mark").cast("long"))
    return given.mapInArrow(run, f"category_id {category}, part int, batch long, first long, kind int, rows long, at binary, mark binary")


class _Envelope:
    """Best precision per recall step of one category, for every resample of a block."""

    def __init__(self, weights: np.ndarray):
        self.weights, size = weights, weights.shape[1]
        self.n_gt, self.rank, self.hits = (np.zeros(size, np.int64) for _ in range(3))
        self.best = np.zeros((size, RECALL_STEPS + 1))

    def truth(self, at: np.ndarray, mark: np.ndarray) -> None:
        self.n_gt += mark.astype(np.int64) @ self.weights[at].astype(np.int64)

    def detections(self, at: np.ndarray, mark: np.ndarray) -> None:
        """The next detections in score order; an image that is not drawn only repeats a point."""
        w, right = self.weights[at].astype(np.int64), np.flatnonzero(mark)
        rank = self.rank + np.cumsum(w, axis=0)
        hits = self.hits + np.cumsum(w[right], axis=0)
        if len(right):
            cum = hits.T
            recall = cum / np.maximum(self.n_gt, 1)[:, None]
            guess = np.floor(recall * RECALL_STEPS + 1)
            step = np.where(guess * 0.01 <= recall, guess, np.where((guess - 1) * 0.01 <= recall, guess - 1, guess - 2))
            cell = np.minimum(step, RECALL_STEPS).astype(np.int64) + np.arange(len(cum))[:, None] * (RECALL_STEPS + 1)
            precision = cum / np.maximum(rank[right].T, 1)
            flat, starts = cell.ravel(), np.flatnonzero(np.diff(cell.ravel(), prepend=-1))
            best = self.best.ravel()
            best[flat[starts]] = np.maximum(best[flat[starts]], np.maximum.reduceat(precision.ravel(), starts))
            self.hits = hits[-1]
        self.rank = rank[-1]

    def areas(self) -> tuple[np.ndarray, np.ndarray]:
        """The resamples that drew ground truth of the category, and their average precision."""
        drawn = np.flatnonzero(self.n_gt)
        envelope = np.maximum.accumulate(self.best[drawn, ::-1], axis=1)[:, ::-1]
        return drawn, np.cumsum(envelope, axis=1)[:, -1] / (RECALL_STEPS + 1)


def bootstrap_ci(dets: DataFrame, gts: DataFrame, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """95% percentile interval of mAP50 over resampled images.

    Matching stays within an image, so it runs once; a resample only changes how often each
    image's rows count. Draws are those of `bootstrap_weights`: seeded and reproducible, though not
    those of another generator.

    Boxes are not copied per resample: sorted by category and score they are packed as image numbers,
    and each task takes a block of resamples, draws its weights and runs once through the packed
    rows. A block holds `WEIGHT_BYTES` of weights, one resample at least.
    """
    spark = dets.sparkSession
    matches = greedy_match(dets, gts, THRESHOLDS[:1])
    numbered = _numbered_images(gts)
    n = numbered.count()
    flagged = flagged_detections(dets, matches, gts, THRESHOLDS[:1]).join(numbered, "image_id")
    category = gts.schema["category_id"].dataType.simpleString()
    ordered = flagged.withColumn("category_id", F.col("category_id").cast(category)).orderBy("category_id", *_score_order())
    truth = gts.join(numbered, "image_id").groupBy("category_id", "pos").agg(F.count("*").alias("mark")).sortWithinPartitions("category_id", "pos")
    packed = _packed(ordered.withColumn("mark", F.col("tp0")), 1, category).unionByName(_packed(truth, 0, category))
    packed = durable(packed, "packed")

    tasks = 2 * spark.sparkContext.defaultParallelism
    size = max(1, min(WEIGHT_BYTES // max(n, 1), math.ceil(replicates / tasks)))
    blocks = max(1, math.ceil(replicates / size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, category_id, state, weights = None, None, None, None

        def done() -> pa.RecordBatch:
            drawn, ap = state.areas()
            return pa.RecordBatch.from_arrays([pa.array(drawn + block * size, pa.int64()), pa.array(ap, pa.float64())], ["b", "ap"])

        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(len(batch))):
                key = row["category_id"]
                if state is None or row["block"] != block or not (key == category_id or key != key and category_id != category_id):
                    if state is not None:
                        yield done()
                    if row["block"] != block:
                        block = row["block"]
                        weights = drawn_weights(n, block * size, min(replicates, (block + 1) * size), seed)
                    category_id, state = key, _Envelope(weights)
                at = np.frombuffer(row["at"], f"i{len(row['at']) // row['rows']}")
                mark = np.frombuffer(row["mark"], np.uint8 if len(row["mark"]) == row["rows"] else np.int64)
                (state.detections if row["kind"] else state.truth)(at, mark)
        if state is not None:
            yield done()

    copies = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartitionById(blocks, "block")
    ap = copies.sortWithinPartitions("block", "category_id", "kind", "part", "batch", "first").mapInArrow(run, "b long, ap double")
    per = ap.groupBy("b").agg(_mean(F.col("ap")).alias("map50"))
    every = spark.range(replicates).select(F.col("id").alias("b")).join(per, "b", "left").fillna(0.0, ["map50"])
    return every.agg(F.percentile("map50", F.lit(0.025)).alias("low"), F.percentile("map50", F.lit(0.975)).alias("high"))


def uplift_gate(student: DataFrame, baseline: DataFrame, key: str, metric: str, minimum: float = 0.0) -> DataFrame:
    """Student minus baseline, only where both come from the same scorer digest."""
    pair = student.select(key, F.col(metric).alias("student"), F.col("scorer_sha256").alias("_s")).join(
        baseline.select(key, F.col(metric).alias("baseline"), F.col("scorer_sha256").alias("_b")), key)
    same = F.col("_s").eqNullSafe(F.col("_b"))
    gain = F.when(same, F.col("student") - F.col("baseline"))
    return pair.select(key, "student", "baseline", gain.alias("uplift"),
                       F.when(~same, "different scorer").when(gain >= minimum, "passed").otherwise("failed").alias("status"))
