"""The bootstrap draws all its resamples, and packed boxes give what a copy per resample would."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import detection
from tallyloom.plans import detection as plans


def test_query_draws_a_thousand_resamples(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(plans, "boxes", lambda *_: ("dets", "gts"))
    monkeypatch.setattr(plans.d, "bootstrap_ci", lambda dets, gts, replicates=1000, seed=42: asked.update(n=replicates, seed=seed))
    plans.interval(spark, "")
    assert asked == {"n": 1000, "seed": 42}
    assert plans.SQL["d25_bootstrap_ci"].count("range(1000)") == 2


def rows(spark):
    kinds = "CASE WHEN id % 11 = 0 THEN NULL ELSE id % 3 END AS category_id"
    image = "CASE WHEN id % 17 = 0 THEN NULL ELSE 'i' || id % 13 END AS image_id"
    gts = spark.range(90).selectExpr("id AS gt_id", image, kinds, "array(id % 7 * 5D, id % 5 * 5D, 10D, 10D) AS bbox", "id AS ord")
    dets = spark.range(120).selectExpr("id AS det_id", image, kinds, "array(id % 7 * 5D + id % 4, id % 5 * 5D, 10D, 10D) AS bbox", "id AS ord",
                                       "CASE WHEN id % 19 = 0 THEN NULL ELSE id * 7 % 10 / 10D END AS score")
    return dets, gts.unionByName(spark.range(500, 503).selectExpr("id AS gt_id", "'i1' AS image_id", "9L AS category_id", "array(0D, 0D, 1D, 1D) AS bbox", "id AS ord"))


def plain(dets, gts, replicates, seed):
    """One copy of an image's rows for each resample that draws it."""
    one = detection.THRESHOLDS[:1]
    flagged = detection.flagged_detections(dets, detection.greedy_match(dets, gts, one), gts, one)
    weights = detection.bootstrap_weights(gts, replicates, seed)
    n_gt = gts.join(weights, "image_id").groupBy("b", "category_id").agg(F.sum("weight").alias("n_gt"))
    ap = detection.average_precision(detection.ordered_detections(flagged).join(weights, "image_id"), n_gt, 1, ["b", "category_id"], F.col("weight"))
    means = dict(ap.groupBy("b").agg(F.avg("ap")).collect())
    return tuple(np.percentile([means.get(b, 0.0) for b in range(replicates)], [2.5, 97.5]))


@pytest.mark.parametrize("limits", [(16_384, 96_000_000), (4, 30)])
def test_packed_boxes_equal_copied_ones(spark, monkeypatch, limits):
    monkeypatch.setattr(detection, "RUN", limits[0])
    monkeypatch.setattr(detection, "WEIGHT_BYTES", limits[1])
    dets, gts = rows(spark)
    assert tuple(detection.bootstrap_ci(dets, gts, 23, 5).first()) == pytest.approx(plain(dets, gts, 23, 5), abs=1e-12)


def test_no_boxes(spark):
    dets, gts = rows(spark)
    assert tuple(detection.bootstrap_ci(dets, gts.limit(0), 5, 1).first()) == (0.0, 0.0)
    assert tuple(detection.bootstrap_ci(dets.limit(0), gts, 5, 1).first()) == (0.0, 0.0)


def test_drawn_weights_are_the_table_of_draws(spark):
    gts = spark.range(60).selectExpr("id AS gt_id", "id % 23 AS image_id", "1L AS category_id")
    place = {r.image_id: r.pos for r in detection._numbered_images(gts).collect()}
    made = np.zeros((23, 17), int)
    for r in detection.bootstrap_weights(gts, 17, 5).collect():
        made[place[r.image_id], r.b] = r.weight
    assert (np.hstack([detection.drawn_weights(23, 0, 9, 5), detection.drawn_weights(23, 9, 17, 5)]) == made).all()
