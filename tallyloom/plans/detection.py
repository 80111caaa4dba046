"""Detection queries: boxes are derived from the order keys, so the work grows with the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import detection as d
from tallyloom.session import spread, table

_RAW = """CASE o_orderkey % 9 WHEN 0 THEN '{"bbox":[1,2,3],"category_id":1,"score":0.5}' WHEN 1 THEN '{"bbox":[1,2,0,4],"category_id":1,"score":0.5}' WHEN 2 THEN '{"bbox":[1,2,3,4],"category_id":1,"score":true}'
 WHEN 3 THEN '{"bbox":[1,2,3,4],"category_id":1.5,"score":0.5}' WHEN 4 THEN 'oops' WHEN 5 THEN '{"bbox":[1,true,3,4],"category_id":1,"score":0.5}' WHEN 6 THEN '{"bbox":[1,2,3,4],"category_id":1,"score":1.5}'
 ELSE '{"bbox":[1.5,2,3,4],"category_id":' || o_custkey % 5 || ',"score":0.' || (1 + o_orderkey % 9) || '}' END"""


def boxes(spark, sf):
    """(detections, ground truth): about ten crowded boxes per customer image, shifted and scored."""
    rows = spread(table(spark, sf, "orders")).selectExpr(
        "o_orderkey", "o_custkey AS image_id", "o_orderkey % 3 AS category_id",
        "CAST(o_orderkey * 37 % 60 AS double) AS x", "CAST(o_orderkey * 91 % 50 AS double) AS y",
        "CAST(20 + o_orderkey % 30 AS double) AS w", "CAST(20 + o_orderkey * 7 % 25 AS double) AS h")
    gts = rows.selectExpr("o_orderkey AS gt_id", "image_id", "category_id", "array(x, y, w, h) AS bbox", "o_orderkey AS ord")
    dets = rows.selectExpr(
        "o_orderkey AS det_id", "image_id", "category_id", "o_orderkey AS ord", "(o_orderkey * 7919 % 1000) / 1000D AS score",
        "array(x + o_orderkey % 7 + CASE WHEN o_orderkey % 10 = 0 THEN 300 ELSE 0 END, y + o_orderkey % 5, w - o_orderkey % 4, h) AS bbox")
    return dets, gts


_BOXES = """b AS (SELECT o_orderkey AS k, o_custkey AS image_id, o_orderkey % 3 AS category_id, CAST(o_orderkey * 37 % 60 AS DOUBLE) AS x, CAST(o_orderkey * 91 % 50 AS DOUBLE) AS y, CAST(20 + o_orderkey % 30 AS DOUBLE) AS w, CAST(20 + o_orderkey * 7 % 25 AS DOUBLE) AS h FROM orders),
de AS (SELECT k, image_id, category_id, x + k % 7 + CASE WHEN k % 10 = 0 THEN 300 ELSE 0 END AS x, y + k % 5 AS y, w - k % 4 AS w, h, CAST(k * 7919 % 1000 AS DOUBLE) / 1000 AS score FROM b),
p AS (SELECT de.image_id, de.category_id, de.k AS det_id, b.k AS gt_id, greatest(0.0, least(de.x + de.w, b.x + b.w) - greatest(de.x, b.x)) * greatest(0.0, least(de.y + de.h, b.y + b.h) - greatest(de.y, b.y)) AS i, de.w * de.h + b.w * b.h AS s FROM de JOIN b ON de.image_id = b.image_id AND de.category_id = b.category_id),
io AS (SELECT image_id, category_id, det_id, gt_id, i / (s - i) AS iou FROM p WHERE i > 0)"""


def validated(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", _RAW + " AS record")
    return d.validate_predictions(rows, "record").select("o_orderkey", "valid")


def validity(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(_RAW + " AS record")
    return d.format_validity(d.validate_predictions(rows, "record"))


def overlaps(spark, sf):
    return d.box_iou(*boxes(spark, sf))


def matched(spark, sf):
    return d.greedy_match(*boxes(spark, sf)).select("thr", "det_id", "gt_id")


#: Detections of an image and category in score order, each taking the best box not yet taken.
_GREEDY = f"""th(t, thr) AS (VALUES {', '.join(f'({i}, {t!r}::DOUBLE)' for i, t in enumerate(d.THRESHOLDS))}),
dn AS (SELECT k, image_id, category_id, row_number() OVER (PARTITION BY image_id, category_id ORDER BY score DESC, k) AS rn FROM de),
ca AS (SELECT det_id, list(struct_pack(g := gt_id, v := iou) ORDER BY iou DESC, gt_id DESC) AS c FROM io GROUP BY 1),
m AS (SELECT image_id, category_id, t, thr, 0 AS n, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS det_id, CAST(NULL AS BIGINT) AS gt_id FROM (SELECT DISTINCT image_id, category_id FROM de) CROSS JOIN th
  UNION ALL SELECT image_id, category_id, t, thr, n + 1, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, k, pick
  FROM (SELECT m.image_id, m.category_id, m.t, m.thr, m.n, m.used, dn.k, list_filter(ca.c, lambda x: x.v >= m.thr AND NOT list_contains(m.used, x.g))[1].g AS pick
    FROM m JOIN dn ON dn.image_id = m.image_id AND dn.category_id = m.category_id AND dn.rn = m.n + 1 LEFT JOIN ca ON ca.det_id = dn.k)),
hit AS (SELECT t, thr, det_id, gt_id FROM m WHERE gt_id IS NOT NULL)"""


def _area(rows: str, keys: str) -> str:
    """Average precision of `rows` (keys, tp, wt, score, image_id, k) against `ng` (keys, n_gt)."""
    return f"""r AS (SELECT {keys}, CAST(sum(wt * tp) OVER o AS DOUBLE) AS c, sum(wt) OVER o AS rn FROM {rows} WINDOW o AS (PARTITION BY {keys} ORDER BY score DESC, CAST(image_id AS VARCHAR), k ROWS UNBOUNDED PRECEDING)),
pr AS (SELECT {keys}, len(list_filter(range(101), lambda i: i * 0.01::DOUBLE <= c / n_gt)) - 1 AS step, max(c / rn) AS p FROM r JOIN ng USING ({keys}) GROUP BY ALL),
ap AS (SELECT {keys}, sum(e) / 101 AS ap FROM (SELECT {keys}, i, coalesce((SELECT max(p) FROM pr WHERE {' AND '.join(f'pr.{x} = ng.{x}' for x in keys.split(', '))} AND step >= i), 0) AS e FROM ng CROSS JOIN (SELECT unnest(range(101)) AS i)) GROUP BY {keys})"""


_MAP = f"""WITH RECURSIVE {_BOXES}, {_GREEDY}, fl AS (SELECT de.*, t, 1 AS wt, CASE WHEN EXISTS (SELECT 1 FROM hit WHERE hit.t = th.t AND hit.det_id = de.k) THEN 1 ELSE 0 END AS tp FROM de CROSS JOIN th),
ng AS (SELECT category_id, t, count(*) AS n_gt FROM b CROSS JOIN th GROUP BY ALL), {_area('fl', 'category_id, t')}"""
REPLICATES = 1000
_BOOTSTRAP = f"""WITH RECURSIVE {_BOXES}, {_GREEDY}, im AS (SELECT image_id, row_number() OVER (ORDER BY CAST(image_id AS VARCHAR)) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT image_id FROM b)),
dr AS (SELECT r AS rep, CAST('0x' || substr(md5('42:' || r || ':' || j), 1, 13) AS BIGINT) % n AS pos FROM (SELECT max(n) AS n FROM im), range({REPLICATES}) x(r), (SELECT pos AS j FROM im)),
we AS (SELECT rep, image_id, count(*) AS wt FROM dr JOIN im USING (pos) GROUP BY 1, 2),
fl AS (SELECT de.*, rep, wt, CASE WHEN EXISTS (SELECT 1 FROM hit WHERE hit.t = 0 AND hit.det_id = de.k) THEN 1 ELSE 0 END AS tp FROM de JOIN we USING (image_id)),
ng AS (SELECT rep, category_id, sum(wt) AS n_gt FROM b JOIN we USING (image_id) GROUP BY 1, 2), {_area('fl', 'rep, category_id')},
ma AS (SELECT r AS rep, coalesce((SELECT avg(ap) FROM ap WHERE ap.rep = r), 0) AS map50 FROM range({REPLICATES}) x(r))
SELECT quantile_cont(map50, 0.025) AS low, quantile_cont(map50, 0.975) AS high FROM ma"""


def own_box_ap(spark, sf):
    """Average precision when a detection is right iff it overlaps its own box enough."""
    dets, gts = boxes(spark, sf)
    own = d.box_iou(dets, gts).where("det_id = gt_id").select("det_id", "gt_id", F.explode(F.array(F.lit(0.5), F.lit(0.75))).alias("thr"), "iou").where("iou >= thr")
    flagged = d.flagged_detections(dets, own, gts, (0.5, 0.75))
    n_gt = gts.groupBy("category_id").agg(F.count("*").alias("n_gt"))
    return d.average_precision(d.ordered_detections(flagged), n_gt, 2).select("category_id", F.col("t").cast("long").alias("t"), "ap")


_AP = f"""WITH {_BOXES}, f AS (SELECT de.*, CASE t WHEN 0 THEN 0.5 ELSE 0.75 END AS thr, t, coalesce((SELECT iou FROM io WHERE io.det_id = de.k AND io.gt_id = de.k), 0) AS v FROM de CROSS JOIN (VALUES (0), (1)) q(t)),
r AS (SELECT category_id, t, v >= thr AS tp, sum(CASE WHEN v >= thr THEN 1 ELSE 0 END) OVER o AS c, row_number() OVER o AS rn FROM f WINDOW o AS (PARTITION BY category_id, t ORDER BY score DESC, CAST(image_id AS VARCHAR), k ROWS UNBOUNDED PRECEDING)),
n AS (SELECT category_id, count(*) AS n_gt FROM b GROUP BY 1), pr AS (SELECT category_id, t, CAST(c AS DOUBLE) / n_gt AS rec, CAST(c AS DOUBLE) / rn AS prec FROM r JOIN n USING (category_id)),
g AS (SELECT category_id, t, i, coalesce((SELECT max(prec) FROM pr WHERE pr.category_id = n.category_id AND pr.t = q.t AND rec >= i * 0.01::DOUBLE), 0) AS e FROM n CROSS JOIN (VALUES (0), (1)) q(t) CROSS JOIN (SELECT unnest(range(101)) AS i))
SELECT category_id, CAST(t AS BIGINT) AS t, sum(e) / 101 AS ap FROM g GROUP BY 1, 2"""


def report(spark, sf):
    dets, gts = boxes(spark, sf)
    return d.map_report(d.evaluate(dets, gts), gts)


def per_category(spark, sf):
    return d.ap50_per_category(d.evaluate(*boxes(spark, sf)))


def interval(spark, sf):
    return d.bootstrap_ci(*boxes(spark, sf), replicates=REPLICATES)


def uplift(spark, sf):
    side = lambda n: table(spark, sf, "customer").selectExpr("c_custkey AS run", f"(c_custkey * {n} % 100) / 100D AS map50", f"CASE WHEN c_custkey % {n} = 0 THEN 'a' ELSE 'b' END AS scorer_sha256")
    return d.uplift_gate(side(3), side(7), "run", "map50", 0.05)


QUERIES = {
    "d20_validate_predictions": validated, "d20_format_validity": validity, "d21_box_iou": overlaps, "d22_greedy_match": matched,
    "d23_average_precision": own_box_ap, "d24_map_report": report, "d24_ap50_per_category": per_category, "d25_bootstrap_ci": interval, "d26_uplift_gate": uplift,
}

SQL = {
    "d20_validate_predictions": "SELECT o_orderkey, o_orderkey % 9 > 6 AS valid FROM orders",
    "d20_format_validity": "SELECT count(*) AS n_records, count(*) FILTER (o_orderkey % 9 <= 6) AS invalid_predictions, CAST(count(*) FILTER (o_orderkey % 9 > 6) AS DOUBLE) / count(*) AS format_validity FROM orders",
    "d21_box_iou": f"WITH {_BOXES} SELECT * FROM io",
    "d22_greedy_match": f"WITH RECURSIVE {_BOXES}, {_GREEDY} SELECT thr, det_id, gt_id FROM hit",
    "d23_average_precision": _AP,
    "d24_map_report": f"{_MAP} SELECT avg(ap) FILTER (t = 0) AS map50, avg(ap) AS map50_95, (SELECT count(DISTINCT image_id) FROM b) AS images, (SELECT count(DISTINCT category_id) FROM b) AS categories FROM ap",
    "d24_ap50_per_category": f"{_MAP} SELECT category_id, ap AS ap50 FROM ap WHERE t = 0",
    "d25_bootstrap_ci": _BOOTSTRAP,
    "d26_uplift_gate": """WITH x AS (SELECT c_custkey AS run, CAST(c_custkey * 3 % 100 AS DOUBLE) / 100 AS student, CAST(c_custkey * 7 % 100 AS DOUBLE) / 100 AS baseline, (c_custkey % 3 = 0) = (c_custkey % 7 = 0) AS same FROM customer)
SELECT run, student, baseline, CASE WHEN same THEN student - baseline END AS uplift, CASE WHEN NOT same THEN 'different scorer' WHEN student - baseline >= 0.05 THEN 'passed' ELSE 'failed' END AS status FROM x""",
}
