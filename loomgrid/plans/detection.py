"""Queries over detections and truths: overlap, matching, metrics, suppression, assignment, geometry, points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions import boxes as B
from loomgrid.functions import numeric as N
from loomgrid.operators import assign as A
from loomgrid.operators import metrics as M
from loomgrid.operators import nms as S
from loomgrid.operators import spatial as P
from loomgrid.operators import voxel as V
from loomgrid.operators.numbering import written
from loomgrid.plans import fixtures as X
from loomgrid.plans.fixtures import ANN, CAT, DET, GT, IMG, PTS, area_sql, iou_sql  # noqa: F401

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def tp_sql(thr: str = "0.5", extra: int = 0, det: str = "det", gt: str = "gt", skip: str = "g.is_ignore", outside: str = "false", keys: str = "") -> str:
    """CTEs up to ``tp`` (class_id, image_id, det_idx, score, tp, fp) of the default protocol."""
    return f"""pr AS (SELECT d.*, g.gt_idx, {skip} AS skip, {iou_sql('d', 'g', extra)} AS iou FROM {det} d LEFT JOIN {gt} g ON d.image_id = g.image_id AND d.class_id = g.class_id),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY det_idx ORDER BY iou DESC NULLS LAST, gt_idx) AS r FROM pr) WHERE r = 1),
hm AS (SELECT *, coalesce(iou >= {thr}, false) AS hit, {outside} AS outside FROM bm),
fm AS (SELECT *, row_number() OVER (PARTITION BY image_id, class_id, gt_idx, hit ORDER BY score DESC, det_idx) AS n FROM hm),
tp AS (SELECT image_id, class_id, det_idx, score, CASE WHEN hit AND NOT coalesce(skip, false) AND n = 1 THEN 1 ELSE 0 END AS tp,
  CASE WHEN hit AND NOT coalesce(skip, false) AND n > 1 THEN 1 WHEN NOT hit AND NOT outside THEN 1 ELSE 0 END AS fp FROM fm)"""


def ap_sql(count: str = "NOT is_ignore", mode: str = "area", gt: str = "gt") -> str:
    """CTEs from ``tp`` up to ``ap`` (class_id, num_gts, ap)."""
    head = f"""gc AS (SELECT class_id, count(*) FILTER (WHERE {count}) AS num_gts FROM {gt} GROUP BY class_id),
cu AS (SELECT t.class_id, row_number() OVER w AS pos, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp, coalesce(num_gts, 0) AS num_gts FROM tp t LEFT JOIN gc USING (class_id) WINDOW w AS (PARTITION BY t.class_id ORDER BY score DESC, image_id, det_idx ROWS UNBOUNDED PRECEDING)),
rp AS (SELECT *, ctp / greatest(num_gts, {M.EPS32!r}) AS recall, ctp / greatest(ctp + cfp, {M.EPS32!r}) AS prec FROM cu),"""
    if mode == "area":
        tail = """en AS (SELECT *, max(prec) OVER (PARTITION BY class_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env, recall - lag(recall, 1, 0) OVER (PARTITION BY class_id ORDER BY pos) AS step FROM rp),
ap0 AS (SELECT class_id, sum(step * env) AS ap, max(recall) AS recall, count(*) AS num_dets FROM en GROUP BY class_id),"""
    else:
        tail = """ap0 AS (SELECT class_id, sum(best) / 11 AS ap, max(recall) AS recall, max(num_dets) AS num_dets FROM (SELECT class_id, i, coalesce(max(prec) FILTER (WHERE recall >= i / 10.0::DOUBLE), 0) AS best, max(recall) AS recall, count(*) AS num_dets FROM rp, range(0, 11) t(i) GROUP BY class_id, i) GROUP BY class_id),"""
    return head + tail + "ap AS (SELECT coalesce(gc.class_id, ap0.class_id) AS class_id, coalesce(num_gts, 0) AS num_gts, coalesce(num_dets, 0) AS num_dets, coalesce(recall, 0) AS recall, coalesce(ap, 0) AS ap FROM gc FULL JOIN ap0 USING (class_id))"


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


PER_CLASS = "SELECT class_id, num_gts, num_dets, round(recall, 6) AS recall, round(ap, 6) AS ap FROM ap"


@query(f"WITH {DET}, {GT}, {tp_sql()}, {ap_sql()} {PER_CLASS}")
def voc_map_iou50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.eval_map(X.det(spark, sf_dir), X.gt(spark, sf_dir)), "recall", "ap")


@query(f"WITH {DET}, {GT}, {tp_sql()}, {ap_sql()} SELECT round(coalesce(avg(ap) FILTER (WHERE num_gts > 0), 0), 6) AS map FROM ap")
def voc_map_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.mean_ap(M.eval_map(X.det(spark, sf_dir), X.gt(spark, sf_dir))), "map")


@query(f"WITH {DET}, {GT}, {tp_sql()}, {ap_sql(mode='11points')} {PER_CLASS}")
def voc07_map_11pt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.eval_map(X.det(spark, sf_dir), X.gt(spark, sf_dir), mode="11points"), "recall", "ap")


@query(f"WITH {DET}, {GT}, {tp_sql(extra=1)}, {ap_sql()} {PER_CLASS}")
def map_legacy_plus1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.eval_map(X.det(spark, sf_dir), X.gt(spark, sf_dir), extra=1), "recall", "ap")


LO, HI = 64.0**2, 96.0**2


@query(
    f"WITH {DET}, {GT}, gs AS (SELECT *, is_ignore OR {area_sql('gt')} < {LO} OR {area_sql('gt')} >= {HI} AS skip0 FROM gt), {tp_sql(gt='gs', skip='g.skip0', outside=f'(x2 - x1) * (y2 - y1) < {LO} OR (x2 - x1) * (y2 - y1) >= {HI}')}, {ap_sql(count='NOT skip0', gt='gs')} {PER_CLASS}"
)
def map_by_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.eval_map(X.det(spark, sf_dir), X.gt(spark, sf_dir), area=(LO, HI)), "recall", "ap")


@query(f"WITH {DET}, {GT}, {tp_sql()} SELECT class_id, sum(tp) AS tp, sum(fp) AS fp, count(*) AS n FROM tp GROUP BY class_id")
def tpfp_default_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.tpfp_default(X.det(spark, sf_dir), X.gt(spark, sf_dir)).groupBy("class_id").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.count("*").alias("n"))


COCO = f"""WITH {DET}, {GT}, pr AS (SELECT d.*, g.gt_idx, g.is_ignore AS skip, {iou_sql('d', 'g')} AS iou FROM det d LEFT JOIN gt g ON d.image_id = g.image_id AND d.class_id = g.class_id),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY det_idx ORDER BY iou DESC NULLS LAST, gt_idx) AS r FROM pr) WHERE r = 1),
th AS (SELECT round(0.5 + 0.05 * i, 2)::DOUBLE AS iou_thr FROM range(0, 10) t(i)),
hm AS (SELECT bm.*, iou_thr, coalesce(iou >= iou_thr, false) AS hit FROM bm, th),
fm AS (SELECT *, row_number() OVER (PARTITION BY image_id, class_id, iou_thr, gt_idx, hit ORDER BY score DESC, det_idx) AS n FROM hm),
tp AS (SELECT *, CASE WHEN hit AND NOT coalesce(skip, false) AND n = 1 THEN 1 ELSE 0 END AS tp, CASE WHEN hit AND NOT coalesce(skip, false) AND n > 1 THEN 1 WHEN NOT hit THEN 1 ELSE 0 END AS fp FROM fm),
gc AS (SELECT class_id, count(*) FILTER (WHERE NOT is_ignore) AS num_gts FROM gt GROUP BY class_id),
cu AS (SELECT iou_thr, t.class_id, row_number() OVER w AS pos, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp, num_gts FROM tp t JOIN gc USING (class_id) WINDOW w AS (PARTITION BY iou_thr, t.class_id ORDER BY score DESC, image_id, det_idx ROWS UNBOUNDED PRECEDING)),
rp AS (SELECT *, ctp / greatest(num_gts, {M.EPS32!r}) AS recall, ctp / greatest(ctp + cfp, {M.EPS32!r}) AS prec FROM cu),
pt AS (SELECT iou_thr, class_id, i, coalesce(max(prec) FILTER (WHERE recall * 100 + 1e-9 >= i), 0) AS best, max(recall) AS recall FROM rp, range(0, 101) t(i) GROUP BY iou_thr, class_id, i)
SELECT iou_thr, class_id, any_value(num_gts) AS num_gts, round(sum(best) / 101, 6) AS ap, round(max(recall), 6) AS recall FROM pt JOIN gc USING (class_id) GROUP BY iou_thr, class_id"""


@query(COCO)
def coco_map_50_95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.coco_ap(X.det(spark, sf_dir), X.gt(spark, sf_dir)), "ap", "recall")


SETTINGS = "(VALUES ('all', 0.0, 1e10, 100), ('small', 0.0, 1024.0, 100), ('medium', 1024.0, 9216.0, 100), ('large', 9216.0, 1e10, 100), ('first_1', 0.0, 1e10, 1), ('first_10', 0.0, 1e10, 10)) s(setting, lo, hi, k)"
SUMMARY = f"""WITH {DET}, {GT}, pr AS (SELECT d.*, g.gt_idx, g.is_ignore, {area_sql('g')} AS ga, {iou_sql('d', 'g')} AS iou FROM det d LEFT JOIN gt g ON d.image_id = g.image_id AND d.class_id = g.class_id),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY det_idx ORDER BY iou DESC NULLS LAST, gt_idx) AS r FROM pr) WHERE r = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY image_id, class_id ORDER BY score DESC, det_idx) AS place FROM bm),
th AS (SELECT round(0.5 + 0.05 * i, 2)::DOUBLE AS iou_thr FROM range(0, 10) t(i)),
hm AS (SELECT rk.*, setting, iou_thr, coalesce(iou >= iou_thr, false) AS hit, coalesce(is_ignore OR ga < lo OR ga >= hi, false) AS skip, {area_sql('rk')} < lo OR {area_sql('rk')} >= hi AS outside FROM rk, th, {SETTINGS} WHERE place <= k),
fm AS (SELECT *, row_number() OVER (PARTITION BY setting, image_id, class_id, iou_thr, gt_idx, hit ORDER BY score DESC, det_idx) AS n FROM hm),
tp AS (SELECT *, CASE WHEN hit AND NOT skip AND n = 1 THEN 1 ELSE 0 END AS tp, CASE WHEN hit AND NOT skip AND n > 1 THEN 1 WHEN NOT hit AND NOT outside THEN 1 ELSE 0 END AS fp FROM fm),
gc AS (SELECT setting, class_id, count(*) FILTER (WHERE NOT is_ignore AND {area_sql('gt')} >= lo AND {area_sql('gt')} < hi) AS num_gts FROM gt, {SETTINGS} GROUP BY ALL),
cu AS (SELECT setting, iou_thr, t.class_id, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp, num_gts FROM tp t JOIN gc USING (setting, class_id) WINDOW w AS (PARTITION BY setting, iou_thr, t.class_id ORDER BY score DESC, image_id, det_idx ROWS UNBOUNDED PRECEDING)),
rp AS (SELECT *, ctp / greatest(num_gts, {M.EPS32!r}) AS recall, ctp / greatest(ctp + cfp, {M.EPS32!r}) AS prec FROM cu),
pt AS (SELECT setting, iou_thr, class_id, i, coalesce(max(prec) FILTER (WHERE recall * 100 + 1e-9 >= i), 0) AS best, max(recall) AS recall FROM rp, range(0, 101) t(i) GROUP BY ALL),
ap AS (SELECT setting, iou_thr, class_id, sum(best) / 101 AS ap, max(recall) AS recall FROM pt GROUP BY ALL),
al AS (SELECT gc.setting, th.iou_thr, coalesce(ap, 0) AS ap, coalesce(recall, 0) AS recall FROM gc CROSS JOIN th LEFT JOIN ap USING (setting, class_id, iou_thr) WHERE num_gts > 0),
m AS (SELECT setting, avg(ap) AS ap, avg(recall) AS ar, avg(ap) FILTER (WHERE iou_thr = 0.5) AS ap50, avg(ap) FILTER (WHERE iou_thr = 0.75) AS ap75 FROM al GROUP BY setting),
nm AS (SELECT * FROM (VALUES ('all', 'AP'), ('all', 'AR_100'), ('all', 'AP50'), ('all', 'AP75'), ('first_1', 'AR_1'), ('first_10', 'AR_10'), ('small', 'AP_small'), ('small', 'AR_small'), ('medium', 'AP_medium'), ('medium', 'AR_medium'), ('large', 'AP_large'), ('large', 'AR_large')) t(setting, metric))
SELECT metric, round(coalesce(CASE WHEN metric = 'AP50' THEN ap50 WHEN metric = 'AP75' THEN ap75 WHEN metric LIKE 'AP%' THEN ap ELSE ar END, -1), 3) AS value FROM nm LEFT JOIN m USING (setting)"""


@query(SUMMARY)
def coco_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.coco_summary(X.det(spark, sf_dir), X.gt(spark, sf_dir))


@query(
    f"""WITH {DET}, {GT}, ts AS (SELECT * FROM gt WHERE NOT is_group_of), tg AS (SELECT * FROM gt WHERE is_group_of), {tp_sql(gt='ts')},
lost AS (SELECT d.* FROM det d JOIN tp USING (image_id, class_id, det_idx) WHERE fp = 1),
io AS (SELECT d.image_id, d.class_id, d.det_idx, d.score, g.gt_idx, {iou_sql('d', 'g', mode='iof')} AS iof FROM lost d JOIN tg g ON d.image_id = g.image_id AND d.class_id = g.class_id),
ib AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY det_idx ORDER BY iof DESC, gt_idx) AS r FROM io) WHERE r = 1 AND iof >= 0.5),
gr AS (SELECT tg.image_id, tg.class_id, tg.is_ignore, max(ib.score) AS score FROM tg LEFT JOIN ib ON tg.image_id = ib.image_id AND tg.class_id = ib.class_id AND tg.gt_idx = ib.gt_idx GROUP BY tg.image_id, tg.class_id, tg.gt_idx, tg.is_ignore),
al AS (SELECT image_id, class_id, score, tp, fp FROM tp WHERE det_idx NOT IN (SELECT det_idx FROM ib) UNION ALL SELECT image_id, class_id, coalesce(score, 0), CASE WHEN score IS NOT NULL AND NOT is_ignore THEN 1 ELSE 0 END, CASE WHEN score IS NULL THEN 1 ELSE 0 END FROM gr WHERE NOT is_ignore OR score IS NOT NULL)
SELECT class_id, count(*) AS n, sum(tp) AS tp, sum(fp) AS fp, round(sum(score), 6) AS total FROM al GROUP BY class_id"""
)
def openimages_groupof_tpfp(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = M.tpfp_group_of(X.det(spark, sf_dir), X.gt(spark, sf_dir))
    return t.groupBy("class_id").agg(F.count("*").alias("n"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.round(F.sum("score"), 6).alias("total"))


HIER = "ed AS (SELECT * FROM (VALUES (5, 0), (5, 1), (6, 2), (6, 3), (7, 5), (7, 6)) t(parent, child)), cl AS (SELECT child AS class_id, parent AS ancestor FROM ed UNION SELECT a.child, b.parent FROM ed a JOIN ed b ON a.parent = b.child UNION SELECT DISTINCT c, c FROM (SELECT parent AS c FROM ed UNION SELECT child FROM ed))"


@query(f"WITH {GT}, {HIER} SELECT CAST(ancestor AS INT) AS class_id, count(*) AS n, count(DISTINCT image_id) AS images FROM gt JOIN cl USING (class_id) GROUP BY ancestor")
def hierarchy_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = spark.createDataFrame([(5, 0), (5, 1), (6, 2), (6, 3), (7, 5), (7, 6)], "parent int, child int")
    return M.expand_gt(X.gt(spark, sf_dir), M.hierarchy_closure(edges)).groupBy("class_id").agg(F.count("*").alias("n"), F.count_distinct("image_id").alias("images"))


@query(f"WITH {DET}, {GT}, {HIER}, al AS (SELECT DISTINCT image_id, ancestor AS class_id FROM gt JOIN cl USING (class_id) WHERE gt_idx % 3 = 0) SELECT CAST(x.class_id AS INT) AS class_id, count(*) AS n FROM (SELECT image_id, ancestor AS class_id FROM det JOIN cl USING (class_id)) x JOIN al ON x.image_id = al.image_id AND x.class_id = al.class_id GROUP BY x.class_id")
def hierarchy_allowed_dets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = M.hierarchy_closure(spark.createDataFrame([(5, 0), (5, 1), (6, 2), (6, 3), (7, 5), (7, 6)], "parent int, child int"))
    allowed = M.expand_gt(X.gt(spark, sf_dir).where("gt_idx % 3 = 0"), c).select("image_id", "class_id").distinct()
    return M.expand_det(X.det(spark, sf_dir), c, allowed).groupBy("class_id").agg(F.count("*").alias("n"))


GREEDY = f"""WITH RECURSIVE {DET}, {GT}, g AS (SELECT image_id, class_id, gt_idx, is_ignore, x1 - 1 AS x1, y1 - 1 AS y1, x2 - 1 AS x2, y2 - 1 AS y2, least((x2 - x1) * (y2 - y1) / ((x2 - x1 + 10) * (y2 - y1 + 10)), 0.5) AS thr FROM gt),
pr AS (SELECT d.det_idx, g.gt_idx, {iou_sql('d', 'g')} AS iou FROM det d JOIN g ON d.image_id = g.image_id AND d.class_id = g.class_id WHERE {iou_sql('d', 'g')} >= g.thr),
rk AS (SELECT image_id, class_id, det_idx, row_number() OVER (PARTITION BY image_id, class_id ORDER BY score DESC, det_idx) AS rnk FROM det),
best AS (SELECT rk.*, list({{'g': gt_idx, 'v': iou}} ORDER BY iou DESC, gt_idx) FILTER (WHERE gt_idx IS NOT NULL) AS can FROM rk LEFT JOIN pr USING (det_idx) GROUP BY ALL),
k AS (SELECT image_id, class_id, rnk, det_idx, can[1].g AS got, CASE WHEN len(can) > 0 THEN [can[1].g] ELSE []::BIGINT[] END AS taken FROM best WHERE rnk = 1
 UNION ALL SELECT b.image_id, b.class_id, b.rnk, b.det_idx, list_filter(b.can, lambda c: NOT list_contains(k.taken, c.g))[1].g, CASE WHEN len(list_filter(b.can, lambda c: NOT list_contains(k.taken, c.g))) > 0 THEN list_append(k.taken, list_filter(b.can, lambda c: NOT list_contains(k.taken, c.g))[1].g) ELSE k.taken END FROM k JOIN best b ON b.image_id = k.image_id AND b.class_id = k.class_id AND b.rnk = k.rnk + 1)
SELECT k.class_id, sum(CASE WHEN got IS NOT NULL AND NOT is_ignore THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN got IS NULL THEN 1 ELSE 0 END) AS fp FROM k LEFT JOIN gt ON got = gt_idx GROUP BY k.class_id"""


@query(GREEDY)
def imagenet_tpfp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.tpfp_greedy(X.det(spark, sf_dir), X.gt(spark, sf_dir)).groupBy("class_id").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))


RECALL = f"""WITH RECURSIVE {DET}, {GT}, g AS (SELECT * FROM gt WHERE NOT is_ignore), rk AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_idx) AS r FROM det),
pr AS (SELECT lim.n, g.image_id, g.gt_idx, d.r, {iou_sql('g', 'd')} AS iou FROM g JOIN rk d ON d.image_id = g.image_id, (VALUES (10), (40)) lim(n) WHERE d.r <= lim.n AND {iou_sql('g', 'd')} >= 0.5),
can AS (SELECT n, image_id, list({{'g': gt_idx, 'd': r, 'v': iou}} ORDER BY iou DESC, gt_idx, r) AS left_ FROM pr GROUP BY ALL),
k AS (SELECT n, image_id, left_[1].v AS iou, list_filter(left_, lambda c: c.g <> left_[1].g AND c.d <> left_[1].d) AS left_ FROM can
 UNION ALL SELECT n, image_id, left_[1].v, list_filter(left_, lambda c: c.g <> left_[1].g AND c.d <> left_[1].d) FROM k WHERE len(left_) > 0)
SELECT CAST(t.n AS INT) AS n, iou_thr, round((SELECT count(*) FROM k WHERE k.n = t.n AND k.iou >= iou_thr) / (SELECT count(*) FROM g), 9) AS recall FROM (VALUES (10), (40)) t(n), (VALUES (0.5::DOUBLE), (0.7)) h(iou_thr)"""


@query(RECALL)
def recall_at_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.recalls(X.gt(spark, sf_dir).where("not is_ignore"), X.det(spark, sf_dir), [10, 40], [0.5, 0.7]), "recall", places=9)


@query(
    f"""WITH {DET}, {GT}, fd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY det_idx) AS r FROM det WHERE det_idx % 3 = 0) WHERE r = 1),
bi AS (SELECT g.gt_idx, max({iou_sql('d', 'g')}) AS iou FROM gt g LEFT JOIN fd d ON d.image_id = g.image_id GROUP BY g.gt_idx)
SELECT round(sum(CASE WHEN iou > 0.5 THEN 1 ELSE 0 END) / count(*), 6) AS accuracy, round(sum(coalesce(iou, 0)) / count(*), 6) AS miou, round(sum(CASE WHEN iou IS NULL THEN 1 ELSE 0 END) / count(*), 6) AS missing FROM bi"""
)
def rec_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.det(spark, sf_dir).where("det_idx % 3 = 0").groupBy("image_id").agg(F.min_by(F.struct(*B.Box._fields), "det_idx").alias("b"))
    g = X.gt(spark, sf_dir).join(d, "image_id", "left").withColumn("iou", B.overlap(B.field_box(F.col("b")), B.box()))
    return rounded(M.rec_accuracy(g), "accuracy", "miou", "missing")


def pair_sql(mode: str) -> str:
    return f"WITH {DET}, {GT} SELECT d.image_id, d.det_idx, g.gt_idx, round({iou_sql('d', 'g', mode=mode)}, 9) AS iou FROM det d JOIN gt g ON d.image_id = g.image_id AND d.class_id = g.class_id WHERE {iou_sql('d', 'g', mode=mode)} >= 0.5"


def _pairs(spark, sf_dir, mode):
    j = P.overlap_join(X.det(spark, sf_dir), X.gt(spark, sf_dir), ["image_id", "class_id"], mode, 0.5)
    return j.select("image_id", "det_idx", "gt_idx", F.round("iou", 9).alias("iou"))


@query(pair_sql("iou"))
def iou_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, "iou")


@query(pair_sql("iof"))
def iof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, "iof")


@query(f"WITH {DET}, {GT} SELECT d.image_id, d.det_idx, g.gt_idx, round({iou_sql('d', 'g')}, 9) AS iou FROM det d JOIN gt g ON d.image_id = g.image_id WHERE {iou_sql('d', 'g')} >= 0.6")
def iou_join_by_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = P.overlap_join(X.det(spark, sf_dir).drop("class_id"), X.gt(spark, sf_dir).drop("class_id"), ["image_id"], least=0.6, cell=128.0)
    return j.select("image_id", "det_idx", "gt_idx", F.round("iou", 9).alias("iou"))


GIOU = f"({iou_sql('d', 'g')} - (greatest((greatest(d.x2, g.x2) - least(d.x1, g.x1)) * (greatest(d.y2, g.y2) - least(d.y1, g.y1)), 1e-6) - ({area_sql('d')} + {area_sql('g')} - {X.inter_sql('d', 'g')})) / greatest((greatest(d.x2, g.x2) - least(d.x1, g.x1)) * (greatest(d.y2, g.y2) - least(d.y1, g.y1)), 1e-6))"


@query(f"WITH {DET}, {GT} SELECT d.det_idx, round({GIOU}, 9) AS giou, round(1 - {GIOU}, 9) AS loss FROM det d JOIN gt g ON d.det_idx = g.gt_idx")
def giou_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.gt(spark, sf_dir).select(F.col("gt_idx").alias("det_idx"), *(F.col(n).alias(f"b{n}") for n in B.Box._fields))
    j = X.det(spark, sf_dir).join(g, "det_idx")
    o = B.Box(*(F.col(f"b{n}") for n in B.Box._fields))
    return j.select("det_idx", F.round(B.giou(B.box(), o), 9).alias("giou"), F.round(B.giou_loss(B.box(), o, 1e-6), 9).alias("loss"))


@query(f"WITH {DET}, {GT}, pr AS (SELECT d.det_idx, g.gt_idx, {iou_sql('d', 'g')} AS iou FROM det d LEFT JOIN gt g ON d.image_id = g.image_id AND d.class_id = g.class_id) SELECT det_idx, gt_idx AS match, round(iou, 9) AS iou FROM (SELECT *, row_number() OVER (PARTITION BY det_idx ORDER BY iou DESC NULLS LAST, gt_idx) AS r FROM pr) WHERE r = 1")
def best_match_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.best_match(X.det(spark, sf_dir), X.gt(spark, sf_dir), ["image_id", "class_id"], ["det_idx"], "gt_idx")
    return m.select("det_idx", "match", F.round("iou", 9).alias("iou"))


def nms_sql(group: str, thr: str, where: str = "true") -> str:
    """Greedy suppression as a recursion over ranks, carrying the kept boxes as a list."""
    on = " AND ".join(f"r.{c} = k.{c}" for c in group.split(", "))
    inter = "greatest(least(b.x2, r.x2) - greatest(b.x1, r.x1), 0) * greatest(least(b.y2, r.y2) - greatest(b.y1, r.y1), 0)"
    hit = f"len(list_filter(k.kept, lambda b: {inter} / ((b.x2 - b.x1) * (b.y2 - b.y1) + (r.x2 - r.x1) * (r.y2 - r.y1) - {inter}) > {thr})) > 0"
    return f"""rk AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY score DESC, det_idx) AS rnk FROM det WHERE {where}),
k AS (SELECT {group}, rnk, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept, det_idx, true AS ok FROM rk WHERE rnk = 1
 UNION ALL SELECT {", ".join("r." + c for c in group.split(", "))}, r.rnk, CASE WHEN {hit} THEN k.kept ELSE list_append(k.kept, {{'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2}}) END, r.det_idx, NOT ({hit}) FROM k JOIN rk r ON {on} AND r.rnk = k.rnk + 1)"""


@query(f"WITH RECURSIVE {DET}, {nms_sql('image_id, class_id', '0.3')} SELECT image_id, class_id, det_idx FROM k WHERE ok")
def nms_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.batched_nms(X.det(spark, sf_dir), 0.3, ["image_id"]).select("image_id", "class_id", "det_idx")


@query(f"WITH RECURSIVE {DET}, {nms_sql('image_id', '0.5', 'score > 0.2')} SELECT image_id, det_idx FROM k WHERE ok")
def nms_class_agnostic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.batched_nms(X.det(spark, sf_dir), 0.5, ["image_id"], class_agnostic=True, min_score=0.2).select("image_id", "det_idx")


@query(f"WITH RECURSIVE {DET}, {nms_sql('image_id, class_id', '0.5', 'score > 0.05')}, kk AS (SELECT k.image_id, k.class_id, k.det_idx, d.score * 0.9 AS score FROM k JOIN det d USING (det_idx) WHERE ok) SELECT image_id, class_id, det_idx, CAST(r - 1 AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, class_id, det_idx) AS r FROM kk) WHERE r <= 10")
def multiclass_nms_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.det(spark, sf_dir).withColumn("factor", F.lit(0.9))
    return S.multiclass_nms(d, 0.5, 0.05, ["image_id"], factor="factor", max_num=10).select("image_id", "class_id", "det_idx", "rank")


RANK = "r AS (SELECT *, row_number() OVER (PARTITION BY image_id, class_id ORDER BY score DESC, det_idx) AS rnk FROM det)"


@query(f"WITH {DET}, {RANK} SELECT image_id, class_id, det_idx FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE a.image_id = b.image_id AND a.class_id = b.class_id AND b.rnk < a.rnk AND {iou_sql('a', 'b')} > 0.5)")
def fast_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fast_nms(X.det(spark, sf_dir), 0.5, ["image_id", "class_id"]).select("image_id", "class_id", "det_idx")


@query(f"WITH {DET}, {RANK}, pr AS (SELECT a.image_id, a.class_id, a.rnk, b.rnk AS brnk, {iou_sql('a', 'b')} AS iou FROM r a JOIN r b ON a.image_id = b.image_id AND a.class_id = b.class_id AND b.rnk < a.rnk), co AS (SELECT image_id, class_id, rnk, max(iou) AS comp FROM pr GROUP BY ALL), de AS (SELECT pr.image_id, pr.class_id, pr.rnk, min(exp(-2.0 * iou * iou) / exp(-2.0 * coalesce(comp, 0) * coalesce(comp, 0))) AS k FROM pr LEFT JOIN co ON pr.image_id = co.image_id AND pr.class_id = co.class_id AND pr.brnk = co.rnk GROUP BY ALL) SELECT r.det_idx, round(r.score * coalesce(k, 1), 9) AS score FROM r LEFT JOIN de USING (image_id, class_id, rnk)")
def matrix_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.matrix_nms(X.det(spark, sf_dir), ["image_id", "class_id"]).select("det_idx", F.round("score", 9).alias("score"))


def _soft_sql() -> str:
    inter = "(greatest(least(b.x2, x.x2) - greatest(b.x1, x.x1), 0) * greatest(least(b.y2, x.y2) - greatest(b.y1, x.y1), 0))"
    iou = f"({inter} / ((b.x2 - b.x1) * (b.y2 - b.y1) + (x.x2 - x.x1) * (x.y2 - x.y1) - {inter}))"
    best = "list_reduce({0}, lambda p, q: CASE WHEN q.s > p.s OR (q.s = p.s AND q.idx < p.idx) THEN q ELSE p END)"
    decayed = f"list_filter(list_transform(list_filter(rest, lambda x: x.idx <> b.idx), lambda x: {{{{'idx': x.idx, 'x1': x.x1, 'y1': x.y1, 'x2': x.x2, 'y2': x.y2, 's': x.s * CASE WHEN {iou} >= 0.3 THEN 1 - {iou} ELSE 1 END}}}}), lambda x: x.s >= 1e-3)".replace("{{", "{").replace("}}", "}")
    return f"""WITH RECURSIVE {DET}, l AS (SELECT image_id, class_id, list({{'idx': det_idx, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 's': score}} ORDER BY det_idx) AS rest FROM det GROUP BY ALL),
k AS (SELECT image_id, class_id, 0 AS rank, {best.format('rest')} AS b, rest FROM l
 UNION ALL SELECT image_id, class_id, rank + 1, {best.format('rest')}, rest FROM (SELECT image_id, class_id, rank, {decayed} AS rest FROM k) WHERE len(rest) > 0)
SELECT image_id, class_id, b.idx AS det_idx, CAST(rank AS INT) AS rank, round(b.s, 9) AS score FROM k"""


@query(_soft_sql())
def soft_nms_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.soft_nms(X.det(spark, sf_dir), 0.3, ["image_id", "class_id"]), "score", places=9)


REGIONS = f"""WITH RECURSIVE {DET}, {GT}, pd AS (SELECT image_id, 'p' || det_idx AS idx, pow(score, 0.4) * pow(score * 0.9 + 0.05, 0.6) AS score, x1, y1, x2, y2 FROM det),
pool AS (SELECT * FROM pd WHERE score > 0.15 UNION ALL SELECT image_id, 'r' || gt_idx, 1.0, x1, y1, x2, y2 FROM gt WHERE gt_idx % 11 = 0 UNION ALL SELECT image_id, 't' || gt_idx, 0.2, x1, y1, x2, y2 FROM gt WHERE gt_idx % 5 = 1),
{nms_sql('image_id', '0.6').replace('FROM det WHERE', 'FROM pool WHERE').replace('det_idx', 'idx')}, o AS (SELECT image_id, idx, row_number() OVER (PARTITION BY image_id ORDER BY rnk) AS n FROM k WHERE ok),
lo AS (SELECT image_id, arg_max(idx, (score, idx)) AS idx FROM pd WHERE image_id NOT IN (SELECT image_id FROM o) GROUP BY image_id)
SELECT image_id, idx FROM o WHERE n <= 100 UNION ALL SELECT image_id, idx FROM lo"""


@query(REGIONS)
def region_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, g = X.det(spark, sf_dir).withColumnRenamed("det_idx", "idx"), X.gt(spark, sf_dir).withColumnRenamed("gt_idx", "idx")
    d = d.withColumn("score", N.fused_score(F.col("score"), F.col("score") * 0.9 + 0.05))
    return S.select_regions(d, g.where("idx % 11 = 0"), g.where("idx % 5 = 1"), ["image_id"]).select("image_id", "idx")


ASSIGN = f"""pr AS (SELECT d.image_id, d.det_idx, g.gt_idx, {iou_sql('d', 'g')} AS iou FROM det d JOIN gt g ON d.image_id = g.image_id),
bo AS (SELECT d.image_id, d.det_idx, max(iou) AS m, arg_max(gt_idx, (iou, -gt_idx)) AS a FROM det d LEFT JOIN pr USING (image_id, det_idx) GROUP BY ALL),
tg AS (SELECT image_id, gt_idx, max(iou) AS gm FROM pr GROUP BY ALL),
lo AS (SELECT pr.image_id, det_idx, max(gt_idx) AS low FROM pr JOIN tg USING (image_id, gt_idx) WHERE iou = gm AND gm >= 0.3 GROUP BY ALL),
asg AS (SELECT bo.image_id, bo.det_idx, coalesce(m, 0) AS max_overlap, coalesce(low + 1, CASE WHEN a IS NOT NULL AND m >= 0.5 THEN a + 1 WHEN coalesce(m, 0) < 0.4 THEN 0 ELSE -1 END) AS gt_inds FROM bo LEFT JOIN lo USING (image_id, det_idx))"""


@query(f"WITH {DET}, {GT}, {ASSIGN} SELECT det_idx, gt_inds, round(max_overlap, 9) AS max_overlap FROM asg")
def max_iou_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.max_iou_assign(X.det(spark, sf_dir), X.gt(spark, sf_dir), min_pos=0.3).select("det_idx", "gt_inds", F.round("max_overlap", 9).alias("max_overlap"))


@query(f"WITH {DET}, {GT}, {ASSIGN}, q AS (SELECT a.*, gt_inds > 0 AS is_pos FROM asg a WHERE gt_inds >= 0), o AS (SELECT *, row_number() OVER (PARTITION BY image_id, is_pos ORDER BY det_idx * 7919 % 10007, det_idx) AS r FROM q), t AS (SELECT *, 20 - sum(CASE WHEN is_pos AND r <= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY image_id) AS room FROM o) SELECT det_idx, gt_inds, is_pos FROM t WHERE CASE WHEN is_pos THEN r <= 5 ELSE r <= room END")
def sample_pos_neg(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = A.max_iou_assign(X.det(spark, sf_dir), X.gt(spark, sf_dir), min_pos=0.3)
    return A.random_sample(a, 20, 0.25, order=F.expr("det_idx * 7919 % 10007")).select("det_idx", "gt_inds", "is_pos")


@query(
    f"""WITH {DET}, {GT}, pr AS (SELECT d.image_id, d.det_idx, g.gt_idx, {iou_sql('d', 'g')} AS iou, sqrt(((d.x1 + d.x2) / 2 - (g.x1 + g.x2) / 2) * ((d.x1 + d.x2) / 2 - (g.x1 + g.x2) / 2) + ((d.y1 + d.y2) / 2 - (g.y1 + g.y2) / 2) * ((d.y1 + d.y2) / 2 - (g.y1 + g.y2) / 2)) AS dist, least((d.x1 + d.x2) / 2 - g.x1, (d.y1 + d.y2) / 2 - g.y1, g.x2 - (d.x1 + d.x2) / 2, g.y2 - (d.y1 + d.y2) / 2) > 0.01 AS ins FROM det d JOIN gt g ON d.image_id = g.image_id),
ca AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, gt_idx ORDER BY dist, det_idx) AS r FROM pr) WHERE r <= 9),
th AS (SELECT image_id, gt_idx, avg(iou) + coalesce(stddev_samp(iou), 0) AS thr FROM ca GROUP BY ALL),
ok AS (SELECT ca.* FROM ca JOIN th USING (image_id, gt_idx) WHERE iou >= thr - 1e-12 AND ins)
SELECT d.det_idx, coalesce(a + 1, 0) AS gt_inds FROM det d LEFT JOIN (SELECT image_id, det_idx, arg_max(gt_idx, (iou, -gt_idx)) AS a FROM ok GROUP BY ALL) USING (image_id, det_idx)"""
)
def atss_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.atss_assign(X.det(spark, sf_dir), X.gt(spark, sf_dir)).select("det_idx", "gt_inds")


SIMOTA = f"""WITH {DET}, {GT}, pr AS (SELECT d.image_id, d.det_idx, g.gt_idx, d.score, (d.x1 + d.x2) / 2 AS px, (d.y1 + d.y2) / 2 AS py, g.x1, g.y1, g.x2, g.y2, {iou_sql('d', 'g')} AS iou FROM det d JOIN gt g ON d.image_id = g.image_id),
f AS (SELECT *, least(px - x1, py - y1, x2 - px, y2 - py) > 0 AS ing, least(px - ((x1 + x2) / 2 - 40), py - ((y1 + y2) / 2 - 40), (x1 + x2) / 2 + 40 - px, (y1 + y2) / 2 + 40 - py) > 0 AS core FROM pr),
c AS (SELECT *, -ln(greatest(sqrt(score), 1e-12)) - ln(iou + 1e-7) * 3 + CASE WHEN ing AND core THEN 0 ELSE 1e8 END AS cost FROM (SELECT *, bool_or(ing OR core) OVER (PARTITION BY det_idx) AS ok FROM f) WHERE ok),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id, gt_idx ORDER BY iou DESC, det_idx) AS ri, row_number() OVER (PARTITION BY image_id, gt_idx ORDER BY cost, det_idx) AS rc FROM c),
k AS (SELECT image_id, gt_idx, greatest(CAST(trunc(sum(iou)) AS INT), 1) AS k FROM r WHERE ri <= 10 GROUP BY ALL), t AS (SELECT r.*, rc <= k AS take FROM r JOIN k USING (image_id, gt_idx)),
p AS (SELECT det_idx, sum(CAST(take AS INT)) AS n, arg_max(gt_idx, (take, -cost, -gt_idx)) AS one, arg_min(gt_idx, (cost, gt_idx)) AS least_ FROM t GROUP BY det_idx)
SELECT det.det_idx, coalesce(CASE WHEN n > 1 THEN least_ WHEN n = 1 THEN one END + 1, 0) AS gt_inds FROM det LEFT JOIN p USING (det_idx)"""


@query(SIMOTA)
def simota_dynamic_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.det(spark, sf_dir).drop("class_id")
    cx, cy = B.centre(B.box())
    d = d.withColumn("px", cx).withColumn("py", cy).withColumn("stride", F.lit(16.0))
    return A.sim_ota_assign(d, X.gt(spark, sf_dir)).select("det_idx", "gt_inds")


def _match_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # classes are matched apart: the five of an image are images of their own to the solver
    d, g = (t.withColumn("image_id", F.expr("image_id * 5 + class_id")) for t in (X.det(spark, sf_dir), X.gt(spark, sf_dir)))
    return A.box_costs(d, g, 0.01, 2.0)


@query()
def hungarian_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.hungarian_assign(_match_costs(spark, sf_dir)).withColumn("image_id", F.expr("image_id div 5"))


#: Truths of an image and class are taken in turn; a state is the set of detections matched so far with its least cost (matching is of all detections,
#: of which there are never more than truths here).
STEPS = 13
HUNGARIAN = f"""WITH {DET}, {GT}, dn AS (SELECT image_id * 5 + class_id AS im, row_number() OVER (PARTITION BY image_id, class_id ORDER BY det_idx) - 1 AS i, * FROM det), gn AS (SELECT image_id * 5 + class_id AS im, row_number() OVER (PARTITION BY image_id, class_id ORDER BY gt_idx) - 1 AS j, * FROM gt),
nd AS (SELECT im, count(*) AS n FROM dn GROUP BY im), ng AS (SELECT im, count(*) AS m FROM gn GROUP BY im), c AS (SELECT d.im, i, j, 0.01 * (abs(d.x1 - g.x1) + abs(d.y1 - g.y1) + abs(d.x2 - g.x2) + abs(d.y2 - g.y2)) - 2 * ({GIOU}) AS cost FROM dn d JOIN gn g ON d.im = g.im),
s0 AS (SELECT im, 0 AS mask, 0.0::DOUBLE AS cost FROM nd JOIN ng USING (im)),
{", ".join(f"s{k + 1} AS (SELECT im, mask, min(cost) AS cost FROM (SELECT im, mask, cost FROM s{k} UNION ALL SELECT s.im, s.mask | (1 << i) AS mask, s.cost + c.cost FROM s{k} s JOIN c ON s.im = c.im AND c.j = {k} AND (s.mask >> i) % 2 = 0) GROUP BY im, mask)" for k in range(STEPS))}"""


@query(f"{HUNGARIAN} SELECT s.im // 5 AS image_id, CAST(s.im % 5 AS INT) AS class_id, nd.n, round(s.cost, 6) + 0.0 AS cost, round(s.cost, 6) + 0.0 AS bound, true AS feasible FROM s{STEPS} s JOIN nd USING (im) WHERE s.mask = (1 << nd.n) - 1")
def hungarian_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The optimal matching of each image and class: its cost, and the bound that the solver's prices prove. (The least cost over all sets of
    detections, truth by truth, is what SQL finds.)"""
    costs = _match_costs(spark, sf_dir)
    c = A.certificate(costs, written(A.hungarian_prices(costs), "prices"))  # written: three joins and sums read them
    return c.select(F.expr("image_id div 5").alias("image_id"), F.expr("int(image_id % 5)").alias("class_id"), "n", *((F.round(x, 6) + 0.0).alias(x) for x in ("cost", "bound")), "feasible")


@query("SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, k, b.x1 + x * 16 AS x1, b.y1 + y * 16 AS y1, b.x2 + x * 16 AS x2, b.y2 + y * 16 AS y2, x < 7 AND y < 5 AS valid FROM range(0, 6) a(y), range(0, 8) c(x), (VALUES (0, -16.0, -16.0, 16.0, 16.0), (1, -32.0, -32.0, 32.0, 32.0)) b(k, x1, y1, x2, y2)")
def anchor_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.anchor_grid(spark, 8, 6, 16, A.base_anchors(16, [2.0, 4.0], [1.0]), valid=(7, 5))


@query("WITH g AS (SELECT l.level, y, x, (x + 0.5) / l.vw AS cx, (y + 0.5) / l.vh AS cy, 0.05 * pow(2, l.level) AS w FROM (VALUES (0, 8, 10, 8.0, 9.0), (1, 4, 5, 4.0, 5.0)) l(level, h, w0, vh, vw), range(0, 8) a(y), range(0, 10) b(x) WHERE y < l.h AND x < l.w0) SELECT level, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(cx, 9)::DOUBLE AS cx, round(cy, 9)::DOUBLE AS cy, w, w AS h, cx > 0.01 AND cx < 0.99 AND cy > 0.01 AND cy < 0.99 AND w > 0.01 AND w < 0.99 AS ok FROM g")
def proposal_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.proposal_grid(spark, [(8, 10), (4, 5)], [(8, 9), (4, 5)]), "cx", "cy", places=9)


@query(f"WITH {DET} SELECT det_idx, 500 - x2 AS hx1, 500 - x1 AS hx2, 480 - y2 AS vy1, greatest(least(x2, 449), 0) AS cx2, greatest(least(y2, 480), 0) AS cy2, (x1 + x2) / 2 AS mx, x2 - x1 AS w, round(greatest(least((x1 + x2) / 2 / 500, 1), 0), 9) AS nx FROM det")
def box_convert_flip_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.box()
    h, v = B.flip(b, 500, 480), B.flip(b, 500, 480, "vertical")
    cx, cy, w, hh = B.to_cxcywh(b)
    n = B.normalised(cx, cy, w, hh, 500.0, 480.0)
    return X.det(spark, sf_dir).select("det_idx", h.x1.alias("hx1"), h.x2.alias("hx2"), v.y1.alias("vy1"), B.clip_pixels(b, 450, 480).x2.alias("cx2"), B.clip(b, 450, 480).y2.alias("cy2"), cx.alias("mx"), w.alias("w"), F.round(n[0], 9).alias("nx"))


@query(f"WITH {DET}, {GT} SELECT d.det_idx, round((((g.x1 + g.x2) / 2 - (d.x1 + d.x2) / 2) / (d.x2 - d.x1)) / 0.1, 9) AS dx, round(ln((g.x2 - g.x1) / (d.x2 - d.x1)) / 0.2, 9) AS dw, round(g.x1, 6) AS back_x1, round(g.y2, 6) AS back_y2 FROM det d JOIN gt g ON d.det_idx = g.gt_idx")
def delta_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.gt(spark, sf_dir).select(F.col("gt_idx").alias("det_idx"), *(F.col(n).alias(f"b{n}") for n in B.Box._fields))
    o, stds = B.Box(*(F.col(f"b{n}") for n in B.Box._fields)), (0.1, 0.1, 0.2, 0.2)
    e = B.delta_encode(B.box(), o, stds=stds)
    back = B.delta_decode(B.box(), e, stds=stds)
    return X.det(spark, sf_dir).join(g, "det_idx").select("det_idx", F.round(e[0], 9).alias("dx"), F.round(e[2], 9).alias("dw"), F.round(back.x1, 6).alias("back_x1"), F.round(back.y2, 6).alias("back_y2"))


@query("SELECT l_linenumber, count(*) AS n, min(q) AS lo, max(q) AS hi, sum(q) AS total, round(avg(abs((q + 0.5) * 100000.0 / 64 - greatest(least(l_extendedprice, 100000.0), 0.0))), 4) AS err FROM (SELECT *, CAST(least(floor(64 * greatest(least(l_extendedprice, 100000.0), 0.0) / 100000.0), 63) AS BIGINT) AS q FROM lineitem) GROUP BY l_linenumber")
def quantize_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_extendedprice")
    d = X.table(spark, sf_dir, "lineitem").select("l_linenumber", "l_extendedprice").withColumn("q", N.quantize(x, 0.0, 100000.0, 64))
    err = F.abs(N.dequantize(F.col("q"), 0.0, 100000.0, 64) - F.greatest(F.least(x, F.lit(100000.0)), F.lit(0.0)))
    return d.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.min("q").alias("lo"), F.max("q").alias("hi"), F.sum("q").alias("total"), F.round(F.avg(err), 4).alias("err"))


@query(f"WITH {GT} SELECT gt_idx, round(least((s - sqrt(s * s - 4 * p * 0.3::DOUBLE / 1.7::DOUBLE)) / 2, (2 * s - sqrt(4 * s * s - 16 * 0.3::DOUBLE * p)) / 8, (-1.4::DOUBLE * s + sqrt(1.96::DOUBLE * s * s + 4 * 2.8::DOUBLE * 0.3::DOUBLE * p)) / 5.6::DOUBLE), 6) AS radius FROM (SELECT gt_idx, (x2 - x1) + (y2 - y1) AS s, (x2 - x1) * (y2 - y1) AS p FROM gt)")
def gaussian_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.gt(spark, sf_dir).select("gt_idx", F.round(N.gaussian_radius(B.width(B.box()), B.height(B.box())), 6).alias("radius"))


# points ------------------------------------------------------------------------------------------------

D2 = "(0.0 + (x - c_x) * (x - c_x) + (y - c_y) * (y - c_y) + (z - c_z) * (z - c_z))"


@query(f"WITH {PTS}, d AS (SELECT c.batch, c_idx, pt_idx, {D2} AS d2 FROM ctr c JOIN pts p ON c.batch = p.batch) SELECT batch, c_idx, CAST(r - 1 AS INT) AS rank, pt_idx, round(d2, 9) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY batch, c_idx ORDER BY d2, pt_idx) AS r FROM d) WHERE r <= 5")
def knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.knn(X.points(spark, sf_dir), X.centres(spark, sf_dir), 5), "d2", places=9)


@query(f"WITH {PTS}, d AS (SELECT c.batch, c_idx, pt_idx, z, {D2} AS d2 FROM ctr c JOIN pts p ON c.batch = p.batch), n AS (SELECT *, 1 / (sqrt(d2) + 1e-8) AS w FROM (SELECT *, row_number() OVER (PARTITION BY batch, c_idx ORDER BY d2, pt_idx) AS r FROM d) WHERE r <= 3) SELECT batch, c_idx, round(sum(w * z) / sum(w), 6) AS z FROM n GROUP BY batch, c_idx")
def three_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.three_interpolate(X.points(spark, sf_dir), X.centres(spark, sf_dir), "z"), "z")


@query(f"WITH {PTS}, h AS (SELECT c.batch, c_idx, pt_idx, row_number() OVER (PARTITION BY c.batch, c_idx ORDER BY pt_idx) - 1 AS slot FROM ctr c JOIN pts p ON c.batch = p.batch WHERE {D2} = 0 OR ({D2} >= 0.0025 AND {D2} < 0.04)), s AS (SELECT batch, c_idx, CAST(s AS INT) AS slot FROM ctr, range(0, 8) t(s)) SELECT s.batch, s.c_idx, s.slot, coalesce(h.pt_idx, f.pt_idx, 0) AS pt_idx FROM s LEFT JOIN h ON s.batch = h.batch AND s.c_idx = h.c_idx AND s.slot = h.slot LEFT JOIN h f ON s.batch = f.batch AND s.c_idx = f.c_idx AND f.slot = 0")
def ball_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.ball_query(X.points(spark, sf_dir), X.centres(spark, sf_dir), 0.05, 0.2, 8)


VOX = "v AS (SELECT *, CAST(floor((x + 0.4) / 0.1::DOUBLE) AS INT) AS vx, CAST(floor((y + 0.4) / 0.1::DOUBLE) AS INT) AS vy, CAST(floor((z + 0.4) / 0.1::DOUBLE) AS INT) AS vz FROM pts), vi AS (SELECT * FROM v WHERE vx BETWEEN 0 AND 7 AND vy BETWEEN 0 AND 7 AND vz BETWEEN 0 AND 7)"
CELL = ((0.1, 0.1, 0.1), (-0.4, -0.4, -0.4), (0.4, 0.4, 0.4))


@query(f"WITH {PTS}, {VOX}, s AS (SELECT *, row_number() OVER w - 1 AS slot, min(pt_idx) OVER (PARTITION BY batch, vz, vy, vx) AS f FROM vi WINDOW w AS (PARTITION BY batch, vz, vy, vx ORDER BY pt_idx)), n AS (SELECT *, dense_rank() OVER (PARTITION BY batch ORDER BY f) - 1 AS voxel FROM s) SELECT batch, CAST(voxel AS INT) AS voxel, CAST(slot AS INT) AS slot, pt_idx, vz, vy, vx FROM n WHERE voxel < 20 AND slot < 3")
def voxelize_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.voxelize(X.points(spark, sf_dir), *CELL, max_points=3, max_voxels=20)


@query(f"WITH {PTS}, {VOX} SELECT batch, vz, vy, vx, round(avg(x), 6) AS x FROM vi GROUP BY ALL")
def voxel_scatter_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.scatter(V.voxel_coordinates(X.points(spark, sf_dir), *CELL), ["batch", "vz", "vy", "vx"], "x", "mean"), "x")


@query(f"WITH {PTS}, bx AS (SELECT batch, c_idx AS box_idx, c_x AS bx, c_y AS by_, c_z AS bz FROM ctr), h AS (SELECT p.batch, p.pt_idx, min(box_idx) AS box_idx FROM pts p JOIN bx b ON p.batch = b.batch WHERE abs(z - (bz + 0.15)) <= 0.15 AND x - bx > -0.15 AND x - bx < 0.15 AND y - by_ > -0.15 AND y - by_ < 0.15 GROUP BY ALL) SELECT p.batch, p.pt_idx, coalesce(box_idx, -1) AS box_idx FROM pts p LEFT JOIN h USING (batch, pt_idx)")
def points_in_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = X.centres(spark, sf_dir).select("batch", F.col("c_idx").alias("box_idx"), F.col("c_x").alias("bx"), F.col("c_y").alias("by"), F.col("c_z").alias("bz"), *(F.lit(0.3).alias(d) for d in ("dx", "dy", "dz")), F.lit(0.0).alias("rz"))
    return P.first_box_of_points(X.points(spark, sf_dir), b)


@query(f"WITH {PTS} SELECT batch, pt_idx, x > -0.101 AND x < 0.103 AND y > -0.107 AND y < 0.109 AS inside FROM pts")
def points_in_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    sq = F.array(*map(F.lit, (-0.101, -0.107, 0.103, -0.107, 0.103, 0.109, -0.101, 0.109)))
    return X.points(spark, sf_dir).select("batch", "pt_idx", P.in_polygon(F.col("x"), F.col("y"), sq).alias("inside"))


def fps_sql(n: int) -> str:
    """Furthest points of ``src`` (batch, pt_idx, x, y, z) as a recursion that carries the points taken: ``f`` (batch, step, pt_idx)."""
    d = "min((p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y) + (p.z - t.z) * (p.z - t.z))"
    return f"""f AS (SELECT batch, 0 AS step, min(pt_idx) AS pt_idx, [min(pt_idx)] AS taken FROM src GROUP BY batch
 UNION ALL SELECT batch, step + 1, nxt, list_append(taken, nxt) FROM (SELECT f.batch, f.step, f.taken, (SELECT arg_max(q.pt_idx, (q.d, -q.pt_idx)) FROM (SELECT p.pt_idx, {d} AS d FROM src p, src t WHERE p.batch = f.batch AND t.batch = f.batch AND list_contains(f.taken, t.pt_idx) GROUP BY p.pt_idx) q) AS nxt FROM f WHERE step < {n - 1} AND step + 1 < (SELECT count(*) FROM src c WHERE c.batch = f.batch)))"""


@query(f"WITH RECURSIVE {PTS}, src AS (SELECT * FROM pts WHERE batch IS NOT NULL), {fps_sql(8)} SELECT batch, CAST(step AS INT) AS step, pt_idx FROM f")
def furthest_point_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.furthest_points(X.points(spark, sf_dir), 8)


@query()
def rotated_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    cx, cy, w, h = B.to_cxcywh(B.box())
    d = X.det(spark, sf_dir).select("image_id", "class_id", "det_idx", F.array(cx, cy, w, h, F.lit(0.1)).alias("rbox"))
    g = X.gt(spark, sf_dir).select("image_id", "class_id", "gt_idx", F.array(cx, cy, w, h, F.lit(-0.2)).alias("rbox_b"))
    return rounded(P.rotated_overlap_join(d, g, ["image_id", "class_id"], least=0.1).select("det_idx", "gt_idx", "iou"), "iou", places=9)


# panoptic ----------------------------------------------------------------------------------------------

PIX = "px AS (SELECT l_orderkey % 50 AS image_id, l_partkey % 7 AS gt_id, CASE WHEN l_suppkey % 4 = 0 THEN (l_partkey + 1) % 7 ELSE l_partkey % 7 END AS pred_id FROM lineitem)"


PANOPTIC = f"""WITH {PIX}, c AS (SELECT image_id, gt_id, pred_id, count(*) AS n FROM px GROUP BY ALL), ga AS (SELECT image_id, gt_id, sum(n) AS a FROM c GROUP BY ALL), pa AS (SELECT image_id, pred_id, sum(n) AS a FROM c GROUP BY ALL),
gs AS (SELECT image_id, gt_id, CAST(gt_id % 3 AS INT) AS cat, gt_id = 5 AS crowd FROM ga WHERE gt_id > 0), ps AS (SELECT image_id, pred_id, CAST(pred_id % 3 AS INT) AS cat FROM pa WHERE pred_id > 0), vo AS (SELECT image_id, pred_id, n FROM c WHERE gt_id = 0),
j AS (SELECT c.image_id, c.gt_id, c.pred_id, c.n, gs.cat AS gc, gs.crowd, ps.cat AS pc, c.n / (pa.a + ga.a - c.n - coalesce(vo.n, 0)) AS iou FROM c JOIN gs USING (image_id, gt_id) JOIN ps USING (image_id, pred_id) JOIN ga USING (image_id, gt_id) JOIN pa USING (image_id, pred_id) LEFT JOIN vo USING (image_id, pred_id)),
tp AS (SELECT * FROM j WHERE NOT crowd AND gc = pc AND iou > 0.5), cr AS (SELECT image_id, pred_id, sum(n) AS n FROM j WHERE crowd AND gc = pc GROUP BY ALL),
fn AS (SELECT cat FROM gs WHERE NOT crowd AND NOT EXISTS (SELECT 1 FROM tp WHERE tp.image_id = gs.image_id AND tp.gt_id = gs.gt_id)),
fp AS (SELECT ps.cat FROM ps JOIN pa USING (image_id, pred_id) LEFT JOIN vo USING (image_id, pred_id) LEFT JOIN cr USING (image_id, pred_id) WHERE NOT EXISTS (SELECT 1 FROM tp WHERE tp.image_id = ps.image_id AND tp.pred_id = ps.pred_id) AND (coalesce(vo.n, 0) + coalesce(cr.n, 0)) / pa.a <= 0.5),
al AS (SELECT gc AS cat, iou, 1 AS tp, 0 AS fp, 0 AS fn FROM tp UNION ALL SELECT cat, 0, 0, 1, 0 FROM fp UNION ALL SELECT cat, 0, 0, 0, 1 FROM fn)"""


@query(f"{PANOPTIC} SELECT cat AS category_id, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, round(sum(iou) / (sum(tp) + 0.5 * sum(fp) + 0.5 * sum(fn)), 6) AS pq, round(sum(tp) / (sum(tp) + 0.5 * sum(fp) + 0.5 * sum(fn)), 6) AS rq FROM al GROUP BY cat")
def pq_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.panoptic_quality(_pq(spark, sf_dir)).select("category_id", "tp", "fp", "fn", "pq", "rq"), "pq", "rq")


def _pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = X.table(spark, sf_dir, "lineitem")
    px = li.select(F.expr("l_orderkey % 50").alias("image_id"), F.expr("l_partkey % 7").alias("gt_id"), F.expr("CASE WHEN l_suppkey % 4 = 0 THEN (l_partkey + 1) % 7 ELSE l_partkey % 7 END").alias("pred_id"))
    seg = lambda c, crowd: px.select("image_id", F.col(c).alias("id")).where("id > 0").distinct().select("image_id", "id", F.expr("int(id % 3)").alias("category_id"), *([F.expr("id = 5").alias("iscrowd")] if crowd else []))
    return M.panoptic_stats(px, seg("gt_id", True), seg("pred_id", False))


@query(
    f"""{PANOPTIC}, st AS (SELECT cat, sum(tp) AS tp, sum(iou) AS iou, sum(tp) + 0.5 * sum(fp) + 0.5 * sum(fn) AS n FROM al GROUP BY cat),
q AS (SELECT cat <> 1 AS thing, iou / n AS pq, CASE WHEN tp > 0 THEN iou / tp ELSE 0 END AS sq, tp / n AS rq FROM st WHERE cat IN (0, 1, 2) AND n > 0)
SELECT CASE WHEN grouping(thing) = 1 THEN 'All' WHEN thing THEN 'Things' ELSE 'Stuff' END AS part, round(avg(pq) * 100, 6) AS pq, round(avg(sq) * 100, 6) AS sq, round(avg(rq) * 100, 6) AS rq, count(*) AS n FROM q GROUP BY ROLLUP (thing)"""
)
def pq_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cats = spark.createDataFrame([(0, True), (1, False), (2, True)], "category_id int, isthing boolean")
    return rounded(M.panoptic_summary(M.panoptic_quality(_pq(spark, sf_dir)), cats), "pq", "sq", "rq")
