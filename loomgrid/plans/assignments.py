"""Queries over assigners, samplers and suppression that the detection queries do not show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions import boxes as B
from loomgrid.functions import numeric as N
from loomgrid.operators import assign as A
from loomgrid.operators import metrics as M
from loomgrid.operators import nms as S
from loomgrid.operators.spatial import best_match
from loomgrid.plans import fixtures as X
from loomgrid.plans.detection import RECALL, nms_sql, tp_sql
from loomgrid.plans.families import Queries
from loomgrid.plans.fixtures import DET, GT, IMG, iou_sql

query = Queries()
PR = f"pr AS (SELECT d.image_id, d.det_idx, d.score, d.x1, d.y1, d.x2, d.y2, g.gt_idx, g.x1 AS a1, g.y1 AS b1, g.x2 AS a2, g.y2 AS b2, {iou_sql('d', 'g')} AS iou FROM det d JOIN gt g ON d.image_id = g.image_id)"
CX, CY, GX, GY = "((x1 + x2) / 2)", "((y1 + y2) / 2)", "((a1 + a2) / 2)", "((b1 + b2) / 2)"
INSIDE = f"least({CX} - a1, {CY} - b1, a2 - {CX}, b2 - {CY})"


def assign_sql(min_pos: str = "0.0", pos: str = "0.5", neg: str = "0.4") -> str:
    """CTEs from ``pr`` (image_id, det_idx, gt_idx, iou) up to ``asg``: background, best truth, then each truth's best boxes."""
    return f"""bo AS (SELECT d.image_id, d.det_idx, max(iou) AS m, arg_max(gt_idx, (iou, -gt_idx)) AS a FROM det d LEFT JOIN pr USING (image_id, det_idx) GROUP BY ALL),
tg AS (SELECT image_id, gt_idx, max(iou) AS gm FROM pr GROUP BY ALL),
lo AS (SELECT pr.image_id, det_idx, max(gt_idx) AS low FROM pr JOIN tg USING (image_id, gt_idx) WHERE iou = gm AND gm >= {min_pos} GROUP BY ALL),
asg AS (SELECT bo.image_id, bo.det_idx, coalesce(m, 0) AS max_overlap, coalesce(low + 1, CASE WHEN a IS NOT NULL AND m >= {pos} THEN a + 1 WHEN coalesce(m, 0) < {neg} THEN 0 ELSE -1 END) AS gt_inds FROM bo LEFT JOIN lo USING (image_id, det_idx))"""


def _det(spark: SparkSession, sf_dir: str) -> DataFrame:
    cx, cy = B.centre(B.box())
    return X.det(spark, sf_dir).withColumn("px", cx).withColumn("py", cy)


@query(f"WITH {DET}, {GT}, {PR}, mt AS (SELECT *, score * pow(iou, 6) AS metric FROM pr), rk AS (SELECT *, row_number() OVER (PARTITION BY image_id, gt_idx ORDER BY metric DESC, det_idx) AS r FROM mt), ok AS (SELECT * FROM rk WHERE r <= 5 AND metric > 0 AND {INSIDE} > 0.01), b AS (SELECT det_idx, arg_max(gt_idx, (iou, -gt_idx)) + 1 AS g, max(iou) AS iou, arg_max(metric, (iou, -gt_idx)) AS metric FROM ok GROUP BY det_idx) SELECT det.det_idx, coalesce(g, 0) AS gt_inds, round(iou, 6) AS max_overlap, round(metric, 6) AS metric FROM det LEFT JOIN b USING (det_idx)")
def task_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AS7."""
    a = A.task_aligned_assign(_det(spark, sf_dir), X.gt(spark, sf_dir), topk=5)
    return a.select("det_idx", "gt_inds", F.round("max_overlap", 6).alias("max_overlap"), F.round("metric", 6).alias("metric"))


ANC = "anc AS (SELECT image_id, det_idx, x1 + 8 AS x1, y1 + 8 AS y1, x2 + 12 AS x2, y2 + 12 AS y2 FROM det)"
L1 = "abs((d.x1 + d.x2) / 2 - (g.x1 + g.x2) / 2) + abs((d.y1 + d.y2) / 2 - (g.y1 + g.y2) / 2) + abs((d.x2 - d.x1) - (g.x2 - g.x1)) + abs((d.y2 - d.y1) - (g.y2 - g.y1))"


@query(f"""WITH {DET}, {GT}, {ANC}, u AS (SELECT 0 AS half, d.image_id, d.det_idx, g.gt_idx, {L1} AS l, {iou_sql('d', 'g')} AS iou FROM det d JOIN gt g USING (image_id) UNION ALL SELECT 1, d.image_id, d.det_idx, g.gt_idx, {L1}, {iou_sql('d', 'g')} FROM anc d JOIN gt g USING (image_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY half, image_id, gt_idx ORDER BY l, det_idx) AS r FROM u),
t AS (SELECT a.*, CASE WHEN b.iou < 0.15 THEN -1 ELSE a.gt_idx + 1 END AS v FROM (SELECT * FROM r WHERE r <= 2) a JOIN (SELECT * FROM u WHERE half = 1) b USING (image_id, det_idx, gt_idx)),
l AS (SELECT det_idx, arg_max(v, (r, half, gt_idx)) AS v FROM t GROUP BY det_idx), m AS (SELECT det_idx, max(iou) AS m FROM u WHERE half = 0 GROUP BY det_idx)
SELECT det.det_idx, coalesce(v, CASE WHEN m > 0.7 THEN -1 ELSE 0 END) AS gt_inds FROM det LEFT JOIN l USING (det_idx) LEFT JOIN m USING (det_idx)""")
def uniform_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AS8."""
    d = X.det(spark, sf_dir)
    anchors = d.withColumns({"x1": F.col("x1") + 8, "y1": F.col("y1") + 8, "x2": F.col("x2") + 12, "y2": F.col("y2") + 12})
    return A.uniform_assign(d, anchors, X.gt(spark, sf_dir), k=2).select("det_idx", "gt_inds")


@query(f"WITH {DET}, {GT}, {ANC}, pr AS (SELECT image_id, det_idx, gt_idx, max(iou) AS iou FROM (SELECT d.image_id, d.det_idx, g.gt_idx, {iou_sql('d', 'g')} AS iou FROM det d JOIN gt g USING (image_id) UNION ALL SELECT d.image_id, d.det_idx, g.gt_idx, {iou_sql('d', 'g')} FROM anc d JOIN gt g USING (image_id)) GROUP BY ALL), {assign_sql()} SELECT det_idx, gt_inds, round(max_overlap, 9) AS max_overlap FROM asg")
def approx_max_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AS9: every square has itself and a shifted box as approximations."""
    d = X.det(spark, sf_dir)
    moved = d.withColumns({"x1": F.col("x1") + 8, "y1": F.col("y1") + 8, "x2": F.col("x2") + 12, "y2": F.col("y2") + 12})
    return A.approx_max_iou_assign(d, d.unionByName(moved), X.gt(spark, sf_dir)).select("det_idx", "gt_inds", F.round("max_overlap", 9).alias("max_overlap"))


@query(f"""WITH {DET}, {GT}, {PR}, c AS (SELECT * FROM pr WHERE det_idx % 2 = 0), e AS (SELECT det_idx, max(iou) AS am FROM pr GROUP BY det_idx), b AS (SELECT det_idx, max(iou) AS m, arg_max(gt_idx, (iou, -gt_idx)) AS a FROM c GROUP BY det_idx),
t AS (SELECT image_id, gt_idx, max(iou) AS gm FROM c GROUP BY ALL HAVING max(iou) > 0.1), l AS (SELECT det_idx, max(gt_idx) AS low FROM c JOIN t USING (image_id, gt_idx) WHERE iou = gm GROUP BY det_idx)
SELECT det.det_idx, coalesce(low + 1, CASE WHEN m > 0.5 THEN a + 1 WHEN coalesce(am, 0) <= 0.3 THEN 0 ELSE -1 END) AS gt_inds FROM det LEFT JOIN e USING (det_idx) LEFT JOIN b USING (det_idx) LEFT JOIN l USING (det_idx)""")
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AS10."""
    d = X.det(spark, sf_dir).withColumn("responsible", F.expr("det_idx % 2 = 0"))
    return A.grid_assign(d, X.gt(spark, sf_dir), 0.5, 0.3, 0.1).select("det_idx", "gt_inds")


GRID = "(VALUES (16.0, 0), (32.0, 16)) s(stride, base), range(0, 4) a(i), range(0, 4) b(j)"


@query(f"""WITH {GT}, pt AS (SELECT image_id, CAST(base + i * 4 + j AS BIGINT) AS det_idx, j * 100.0 + 50 + base AS px, i * 100.0 + 50 + base AS py, CAST(log2(stride) AS INT) AS level FROM (SELECT DISTINCT image_id FROM gt), {GRID}),
g AS (SELECT *, greatest(4, least(5, CAST(trunc((log2((x2 - x1) / 2) + log2((y2 - y1) / 2)) / 2) AS INT))) AS level FROM gt),
d AS (SELECT p.image_id, p.det_idx, g.gt_idx, sqrt(pow((px - (x1 + x2) / 2) / (x2 - x1), 2) + pow((py - (y1 + y2) / 2) / (y2 - y1), 2)) AS dist FROM pt p JOIN g ON p.image_id = g.image_id AND p.level = g.level),
n AS (SELECT *, row_number() OVER (PARTITION BY image_id, gt_idx ORDER BY dist, det_idx) AS r FROM d), b AS (SELECT image_id, det_idx, arg_min(gt_idx, (dist, gt_idx)) AS a FROM n WHERE r <= 3 GROUP BY ALL)
SELECT image_id, det_idx, coalesce(a + 1, 0) AS gt_inds FROM pt LEFT JOIN b USING (image_id, det_idx)""")
def point_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AS11."""
    g = X.gt(spark, sf_dir)
    cells = F.explode(F.array(*(F.struct(F.lit(base + i * 4 + j).cast("long").alias("det_idx"), F.lit(j * 100.0 + 50 + base).alias("px"), F.lit(i * 100.0 + 50 + base).alias("py"), F.lit(stride).alias("stride")) for stride, base in ((16.0, 0), (32.0, 16)) for i in range(4) for j in range(4))))
    points = g.select("image_id").distinct().select("image_id", cells.alias("c")).select("image_id", "c.*")
    return A.point_assign(points, g, scale=2.0).select("image_id", "det_idx", "gt_inds")


def core_sql(s: float) -> str:
    """The truth's box shrunk about its centre, overlap of the box over itself."""
    lo, hi = (lambda c, w: f"({c} - {w} * {s} / 2)"), (lambda c, w: f"({c} + {w} * {s} / 2)")
    gw, gh = "(a2 - a1)", "(b2 - b1)"
    inter = f"greatest(least(x2, {hi(GX, gw)}) - greatest(x1, {lo(GX, gw)}), 0) * greatest(least(y2, {hi(GY, gh)}) - greatest(y1, {lo(GY, gh)}), 0)"
    return f"({inter} / greatest((x2 - x1) * (y2 - y1), 1e-6))"


CENTRE = f"{PR}, c AS (SELECT *, {CX} > a1 AND {CX} < a2 AND {CY} > b1 AND {CY} < b2 AS ins, (a2 - a1) * (b2 - b1) AS size FROM pr), b AS (SELECT det_idx, arg_min(gt_idx, (size, gt_idx)) AS a FROM c WHERE ins AND {core_sql(0.2)} > 0.01 GROUP BY det_idx)"


@query(f"WITH {DET}, {GT}, {CENTRE} SELECT det_idx, coalesce(a + 1, 0) AS gt_inds FROM det LEFT JOIN b USING (det_idx)")
def centre_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AS12."""
    return A.centre_region_assign(X.det(spark, sf_dir), X.gt(spark, sf_dir))[0].select("det_idx", "gt_inds")


@query(f"WITH {DET}, {GT}, {CENTRE} SELECT c.det_idx, c.gt_idx FROM c LEFT JOIN b USING (det_idx) WHERE ins AND {core_sql(0.5)} > 0.01 AND (a IS NULL OR gt_idx <> a)")
def centre_region_shadows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AS12, second output."""
    return A.centre_region_assign(X.det(spark, sf_dir), X.gt(spark, sf_dir))[1].select("det_idx", "gt_idx")


def within_sql(s: float) -> str:
    return f"{CX} >= {GX} - (a2 - a1) * {s} / 2 AND {CX} < {GX} + (a2 - a1) * {s} / 2 AND {CY} >= {GY} - (b2 - b1) * {s} / 2 AND {CY} < {GY} + (b2 - b1) * {s} / 2"


@query(f"""WITH {DET}, {GT}, {PR}, l AS (SELECT *, det_idx % 3 AS level, greatest(least(floor(log2(sqrt((a2 - a1) * (b2 - b1))) - log2(40) + 0.5), 2), 0) AS gl FROM pr),
v AS (SELECT det_idx, gt_idx, CASE WHEN level = gl AND {within_sql(0.2)} THEN gt_idx + 1 WHEN {within_sql(0.5)} THEN -1 END AS v FROM l WHERE abs(level - gl) <= 1),
w AS (SELECT det_idx, arg_max(v, (v > 0, gt_idx)) AS v FROM v WHERE v IS NOT NULL GROUP BY det_idx) SELECT det_idx, coalesce(v, 0) AS gt_inds FROM det LEFT JOIN w USING (det_idx)""")
def region_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AS13."""
    return A.region_assign(_det(spark, sf_dir).withColumn("level", F.expr("int(det_idx % 3)")), X.gt(spark, sf_dir), least_scale=40.0, levels=3).select("det_idx", "gt_inds")


ASG = f"{DET}, {GT}, {PR}, {assign_sql('0.3')}"


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.max_iou_assign(X.det(spark, sf_dir), X.gt(spark, sf_dir), min_pos=0.3)


@query(f"WITH {ASG} SELECT image_id, det_idx, gt_inds, gt_inds > 0 AS is_pos FROM asg WHERE gt_inds >= 0 UNION ALL SELECT image_id, -1 - gt_idx, gt_idx + 1, true FROM gt")
def pseudo_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AS14, SO19, SO20: truths put before the boxes, then everything that is assigned."""
    return A.pseudo_sample(A.add_truths(_assigned(spark, sf_dir), X.gt(spark, sf_dir))).select("image_id", "det_idx", "gt_inds", "is_pos")


@query(f"WITH {ASG}, q AS (SELECT a.image_id, det_idx, gt_inds, gt_inds > 0 AS is_pos, score FROM asg a JOIN det USING (image_id, det_idx) WHERE gt_inds >= 0), o AS (SELECT *, row_number() OVER (PARTITION BY image_id, is_pos ORDER BY score DESC, det_idx) AS r FROM q), t AS (SELECT *, sum(CASE WHEN is_pos AND r <= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY image_id) AS n FROM o) SELECT det_idx, gt_inds, is_pos FROM t WHERE CASE WHEN is_pos THEN r <= 5 ELSE r <= least(20 - n, greatest(n, 1) * 2) END")
def hard_example_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO17, SO20: the largest losses (here: scores) of each sign, negatives capped by the positives taken."""
    return A.hard_examples(_assigned(spark, sf_dir), 20, 0.25, "score", neg_pos_ub=2).select("det_idx", "gt_inds", "is_pos")


ORDER = "det_idx * 7919 % 10007"


@query(f"""WITH {DET}, {GT}, {PR}, {assign_sql('0.0', neg='0.5')}, q AS (SELECT *, max(max_overlap) OVER (PARTITION BY image_id) / 3 AS step FROM asg WHERE gt_inds = 0),
b AS (SELECT *, CAST(least(coalesce(floor(max_overlap / nullif(step, 0)), 0), 2) AS INT) AS bin FROM q), r AS (SELECT *, row_number() OVER (PARTITION BY image_id, bin ORDER BY {ORDER}, det_idx) <= 4 AS f FROM b)
SELECT image_id, det_idx FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY f DESC, {ORDER}, det_idx) AS n FROM r) WHERE n <= 12""")
def iou_balanced_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO15."""
    a = A.max_iou_assign(X.det(spark, sf_dir), X.gt(spark, sf_dir), neg=0.5)
    return A.iou_balanced_negatives(a, 12, order=F.expr(ORDER)).select("image_id", "det_idx")


@query(f"""WITH {DET}, {GT}, {PR}, {assign_sql('0.0')}, q AS (SELECT a.*, (SELECT count(DISTINCT gt_inds) FROM asg b WHERE b.image_id = a.image_id AND b.gt_inds > 0) AS g FROM asg a WHERE gt_inds > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id, gt_inds ORDER BY {ORDER}, det_idx) <= round_even(10.0 / g, 0) + 1 AS f FROM q)
SELECT image_id, det_idx, gt_inds FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY f DESC, {ORDER}, det_idx) AS n FROM r) WHERE n <= 10""")
def instance_balanced_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO16."""
    a = A.max_iou_assign(X.det(spark, sf_dir), X.gt(spark, sf_dir))
    return A.instance_balanced_positives(a, 10, order=F.expr(ORDER)).select("image_id", "det_idx", "gt_inds")


def match_sql(group: str, src: str, thr: str) -> str:
    """Groups of suppression as a recursion over ranks: ``k`` has each box's ``owner``, the first kept box that it overlaps."""
    on = " AND ".join(f"r.{c} = k.{c}" for c in group.split(", "))
    keys = ", ".join("r." + c for c in group.split(", "))
    inter = "greatest(least(b.x2, r.x2) - greatest(b.x1, r.x1), 0) * greatest(least(b.y2, r.y2) - greatest(b.y1, r.y1), 0)"
    own = f"list_filter(k.kept, lambda b: {inter} / ((b.x2 - b.x1) * (b.y2 - b.y1) + (r.x2 - r.x1) * (r.y2 - r.y1) - {inter}) >= {thr})"
    new = "{'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2, 'idx': r.det_idx}"
    return f"""rk AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY score DESC, det_idx) AS rnk FROM {src}),
k AS (SELECT {keys}, rnk, [{new}] AS kept, det_idx, det_idx AS owner FROM rk r WHERE rnk = 1
 UNION ALL SELECT {keys}, r.rnk, CASE WHEN len({own}) > 0 THEN k.kept ELSE list_append(k.kept, {new}) END, r.det_idx, coalesce({own}[1].idx, r.det_idx) FROM k JOIN rk r ON {on} AND r.rnk = k.rnk + 1)"""


@query(f"WITH RECURSIVE {DET}, {match_sql('image_id, class_id', 'det', '0.6')}, n AS (SELECT image_id, class_id, owner AS head, det_idx, row_number() OVER (PARTITION BY image_id, class_id, owner ORDER BY rnk) - 1 AS place FROM k) SELECT image_id, class_id, head, det_idx, CAST(place AS INT) AS place FROM n")
def nms_match_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WI8: a row per member of a group, its head first."""
    m = S.nms_match(X.det(spark, sf_dir), 0.6, ["image_id", "class_id"])
    return m.select("image_id", "class_id", "head", F.posexplode("members").alias("place", "det_idx"))


@query(f"""WITH RECURSIVE {ASG}, bg AS (SELECT d.* FROM det d JOIN asg USING (image_id, det_idx) WHERE gt_inds = 0 AND score > 0.05), {match_sql('image_id', 'bg', '0.5')},
n AS (SELECT image_id, det_idx, row_number() OVER (PARTITION BY image_id, owner ORDER BY rnk) - 1 AS place FROM k), i AS (SELECT bg.image_id, det_idx, count(*) OVER (PARTITION BY bg.image_id) - place + score AS imp FROM bg JOIN n USING (image_id, det_idx))
SELECT image_id, det_idx, round(imp, 6) AS importance FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY imp DESC, det_idx) AS r FROM i) WHERE r <= 8""")
def score_hierarchy_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO18."""
    return A.score_hierarchy_negatives(_assigned(spark, sf_dir), 8).select("image_id", "det_idx", F.round("importance", 6).alias("importance"))


GI = f"({iou_sql('d', 'g')} - (greatest((greatest(d.x2, g.x2) - least(d.x1, g.x1)) * (greatest(d.y2, g.y2) - least(d.y1, g.y1)), 1e-6) - ((d.x2 - d.x1) * (d.y2 - d.y1) + (g.x2 - g.x1) * (g.y2 - g.y1) - greatest(least(d.x2, g.x2) - greatest(d.x1, g.x1), 0) * greatest(least(d.y2, g.y2) - greatest(d.y1, g.y1), 0))) / greatest((greatest(d.x2, g.x2) - least(d.x1, g.x1)) * (greatest(d.y2, g.y2) - least(d.y1, g.y1)), 1e-6))"
P = "(1 / (1 + exp(-(d.score * 4 - 2))))"


@query(f"WITH {DET}, {GT} SELECT d.det_idx, g.gt_idx, round(0.01 * (abs(d.x1 - g.x1) + abs(d.y1 - g.y1) + abs(d.x2 - g.x2) + abs(d.y2 - g.y2)) - 2.0 * {GI} + (-ln({P} + 1e-12) * 0.25 * pow(1 - {P}, 2) + ln(1 - {P} + 1e-12) * 0.75 * pow({P}, 2)), 6) + 0.0 AS cost, round(-d.score * 3, 6) + 0.0 AS cls, round(1 - (2 * (0.5 * d.score + 0.5) + 1e-3) / (d.score + 1 + 1.0 + 1e-3), 6) + 0.0 AS dice FROM det d JOIN gt g ON d.image_id = g.image_id AND d.class_id = g.class_id")
def match_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AS15, AS4 and AS5's costs."""
    d, g = X.det(spark, sf_dir), X.gt(spark, sf_dir)
    o = B.Box(*(F.col("b" + n) for n in B.Box._fields))
    p = d.join(g.select("image_id", "class_id", "gt_idx", *(F.col(n).alias("b" + n) for n in B.Box._fields)), ["image_id", "class_id"])
    cost = A.l1_cost(B.box(), o, 0.01) + A.iou_cost(B.box(), o, 2.0) + A.focal_cost(F.col("score") * 4 - 2)
    dice = A.dice_cost(F.array(F.col("score"), F.lit(1.0)), F.array(F.lit(0.5), F.lit(0.5)), 1.0)
    return p.select("det_idx", "gt_idx", (F.round(cost, 6) + 0.0).alias("cost"), (F.round(A.class_cost(F.col("score"), 3.0), 6) + 0.0).alias("cls"), (F.round(dice, 6) + 0.0).alias("dice"))


GRIDS = "range(0, {h}) a(y), range(0, {w}) c(x)"


@query("SELECT 'point' AS kind, CAST(y AS INT) AS y, CAST(x AS INT) AS x, 0 AS k, (x + 0.5) * 8 AS x1, (y + 0.5) * 8 AS y1, 0.0::DOUBLE AS x2, 0.0::DOUBLE AS y2, x < 5 AND y < 3 AS valid FROM range(0, 4) a(y), range(0, 6) c(x) UNION ALL SELECT 'yolo', CAST(y AS INT), CAST(x AS INT), k, 16 - w / 2 + x * 32, 16 - h / 2 + y * 32, 16 + w / 2 + x * 32, 16 + h / 2 + y * 32, true FROM range(0, 2) a(y), range(0, 3) c(x), (VALUES (0, 116.0, 90.0), (1, 156.0, 198.0)) s(k, w, h) UNION ALL SELECT 'ratio', CAST(y AS INT), CAST(x AS INT), k, -w / 2 + x * 16, -h / 2 + y * 16, w / 2 + x * 16, h / 2 + y * 16, true FROM range(0, 2) a(y), range(0, 2) c(x), (VALUES (0, 16 * 4 / sqrt(0.5), 16 * 4 * sqrt(0.5)), (1, 16 * 4 * sqrt(2) / sqrt(0.5), 16 * 4 * sqrt(2) * sqrt(0.5)), (2, 64.0, 64.0), (3, 64 * sqrt(2), 64 * sqrt(2))) s(k, w, h)".replace("(x + 0.5) * 8 AS x1", "round((x + 0.5) * 8, 6)::DOUBLE AS x1").replace("-w / 2 + x * 16, -h / 2 + y * 16, w / 2 + x * 16, h / 2 + y * 16", "round(-w / 2 + x * 16, 6), round(-h / 2 + y * 16, 6), round(w / 2 + x * 16, 6), round(h / 2 + y * 16, 6)"))
def more_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AS17, AS18."""
    p = A.point_grid(spark, 6, 4, 8, valid=(5, 3)).select(F.lit("point").alias("kind"), "y", "x", F.lit(0).alias("k"), F.col("px").alias("x1"), F.col("py").alias("y1"), F.lit(0.0).alias("x2"), F.lit(0.0).alias("y2"), "valid")
    yolo = A.anchor_grid(spark, 3, 2, 32, A.yolo_anchors([(116.0, 90.0), (156.0, 198.0)], 32)).select(F.lit("yolo").alias("kind"), "*")
    ratio = A.anchor_grid(spark, 2, 2, 16, A.base_anchors(16, A.octave_scales(4, 2), [0.5, 1.0])).select(F.lit("ratio").alias("kind"), "*")
    out = p.unionByName(yolo).unionByName(ratio)
    return out.withColumns({c: F.round(c, 6) for c in B.Box._fields})


@query(f"WITH {DET}, {GT}, gc AS (SELECT class_id, count(DISTINCT image_id) AS n FROM gt GROUP BY class_id), b AS (SELECT d.class_id, d.det_idx, max({iou_sql('d', 'g')}) AS iou FROM det d JOIN gt g ON d.image_id = g.image_id AND d.class_id = g.class_id GROUP BY ALL), p AS (SELECT class_id, avg(iou) AS ap FROM b GROUP BY class_id) SELECT coalesce(freq, 'all') AS freq, round(avg(ap), 6) AS ap FROM (SELECT ap, CASE WHEN class_id < 1 THEN 'r' WHEN class_id < 3 THEN 'c' ELSE 'f' END AS freq FROM p) GROUP BY ROLLUP (freq)")
def ap_by_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG14, AG15: grouping of class figures (here: mean best overlap) by frequency class."""
    m = best_match(X.det(spark, sf_dir), X.gt(spark, sf_dir), ["image_id", "class_id"], ["det_idx"], "gt_idx").where("match is not null")
    per = m.groupBy("class_id").agg(F.avg("iou").alias("ap"), F.count("*").alias("num_gts"))
    groups = spark.createDataFrame([(0, "r"), (1, "c"), (2, "c"), (3, "f"), (4, "f")], "class_id int, freq string")
    return M.ap_by_frequency(per, groups).withColumn("ap", F.round("ap", 6))


@query(f"WITH {GT}, n AS (SELECT class_id, count(DISTINCT image_id) AS n FROM gt WHERE gt_idx % (class_id * 7 + 1) = 0 GROUP BY class_id) SELECT class_id, CASE WHEN n <= 10 THEN 'r' WHEN n <= 100 THEN 'c' ELSE 'f' END AS freq FROM n")
def frequency_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG14."""
    return M.frequency_groups(X.gt(spark, sf_dir).where("gt_idx % (class_id * 7 + 1) = 0"))


@query(f"WITH {GT} SELECT class_id, count(*) FILTER (WHERE NOT is_ignore AND (x2 - x1) * (y2 - y1) >= 4096 AND (x2 - x1) * (y2 - y1) < 9216) AS num_gts FROM gt GROUP BY class_id")
def truth_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG6: truths of a class in an area range."""
    return M.gt_counts(X.gt(spark, sf_dir), (4096.0, 9216.0))


@query(f"WITH r AS ({RECALL}) SELECT n, round(avg(recall), 6) AS ar FROM r GROUP BY n")
def average_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG11, AG17: mean of recalls over thresholds."""
    r = M.recalls(X.gt(spark, sf_dir).where("not is_ignore"), X.det(spark, sf_dir), [10, 40], [0.5, 0.7])
    return M.average_recall(r).withColumn("ar", F.round("ar", 6))


@query(f"""WITH {DET}, {GT}, ts AS (SELECT * FROM gt WHERE NOT is_group_of), tg AS (SELECT * FROM gt WHERE is_group_of), {tp_sql(gt='ts')},
lost AS (SELECT d.* FROM det d JOIN tp USING (image_id, class_id, det_idx) WHERE fp = 1),
io AS (SELECT d.image_id, d.class_id, d.det_idx, d.score, g.gt_idx, {iou_sql('d', 'g', mode='iof')} AS iof FROM lost d JOIN tg g ON d.image_id = g.image_id AND d.class_id = g.class_id),
ib AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY det_idx ORDER BY iof DESC, gt_idx) AS r FROM io) WHERE r = 1 AND iof >= 0.5),
gr AS (SELECT tg.image_id, tg.class_id, tg.is_ignore, max(ib.score) AS score FROM tg LEFT JOIN ib ON tg.image_id = ib.image_id AND tg.class_id = ib.class_id AND tg.gt_idx = ib.gt_idx GROUP BY tg.image_id, tg.class_id, tg.gt_idx, tg.is_ignore),
al AS (SELECT image_id, class_id, score, tp, fp FROM tp WHERE det_idx NOT IN (SELECT det_idx FROM ib) UNION ALL SELECT image_id, class_id, coalesce(score, 0), CASE WHEN score IS NOT NULL AND NOT is_ignore THEN 1 ELSE 0 END, CASE WHEN score IS NULL THEN 1 ELSE 0 END FROM gr WHERE NOT is_ignore OR score IS NOT NULL)
SELECT g.class_id, num_gts, num_dets, round(tps / num_gts, 6) AS recall FROM (SELECT class_id, count(*) FILTER (WHERE NOT is_ignore) AS num_gts FROM gt GROUP BY class_id) g JOIN (SELECT class_id, count(*) AS num_dets, sum(tp) AS tps FROM al GROUP BY class_id) USING (class_id)""")
def openimages_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG18, UD3: the driver with the group-of protocol chosen by name."""
    e = M.eval_map(X.det(spark, sf_dir), X.gt(spark, sf_dir), strategy="group_of")
    return e.select("class_id", "num_gts", "num_dets", F.round("recall", 6).alias("recall"))


@query(f"WITH RECURSIVE {DET}, v AS (SELECT image_id, det_idx, score, x1, y1, x2, y2 FROM det UNION ALL SELECT image_id, det_idx + 1000000000, score * 0.9, x1 + 1, y1, x2 + 1, y2 FROM det), {nms_sql('image_id', '0.7').replace('FROM det WHERE', 'FROM v WHERE')}, r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY rnk) AS n FROM k WHERE ok) SELECT image_id, det_idx FROM r WHERE n <= 10")
def merged_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG37: proposals of two views united, suppressed, and the best kept."""
    d = X.det(spark, sf_dir)
    other = d.withColumns({"det_idx": F.col("det_idx") + 1000000000, "score": F.col("score") * 0.9, "x1": F.col("x1") + 1, "x2": F.col("x2") + 1})
    return S.nms(d.unionByName(other), 0.7, ["image_id"], max_num=10).select("image_id", "det_idx")


CELLS = f"{IMG}, l(level, stride) AS (VALUES (0, 32), (1, 64)), cl AS (SELECT image_id, level, stride, CAST(unnest(range(0, CAST(ceil(ceil(height / 32) * 32 / stride) AS BIGINT))) AS INT) AS y, width, height FROM images, l), cx AS (SELECT *, CAST(unnest(range(0, CAST(ceil(ceil(width / 32) * 32 / stride) AS BIGINT))) AS INT) AS x, CAST(ceil(width / stride) AS INT) AS wide, CAST(ceil(height / stride) AS INT) AS high FROM cl)"
STRIDES = [32, 64]


@query(f"WITH {CELLS} SELECT image_id, level, y, x, k, x * stride - stride * s / 2 AS x1, y * stride - stride * s / 2 AS y1, x * stride + stride * s / 2 AS x2, y * stride + stride * s / 2 AS y2, x < wide AND y < high AS valid FROM cx, (VALUES (0, 2.0::DOUBLE), (1, 4.0::DOUBLE)) b(k, s)")
def image_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AS16: two levels of square anchors of every image."""
    return A.anchors_of(X.images(spark, sf_dir), STRIDES, [2.0, 4.0], [1.0])


@query(f"WITH {CELLS} SELECT image_id, level, y, x, (x + 0.5) * stride AS px, (y + 0.5) * stride AS py, x < wide AND y < high AS valid FROM cx")
def image_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AS18: cell centres of every image."""
    p = A.points_of(X.images(spark, sf_dir), STRIDES)
    return p.select("image_id", "level", "y", "x", *(F.col(c).cast("double").alias(c) for c in ("px", "py")), "valid")


@query(f"WITH {CELLS}, p AS (SELECT image_id, level, y, x, (x + 0.5) / wide AS cx, (y + 0.5) / high AS cy, 0.05::DOUBLE * pow(2, level) AS w FROM cx) SELECT image_id, level, y, x, round(cx, 9)::DOUBLE AS cx, round(cy, 9)::DOUBLE AS cy, w, w AS h, cx > 0.01 AND cx < 0.99 AND cy > 0.01 AND cy < 0.99 AND w > 0.01 AND w < 0.99 AS ok FROM p")
def image_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AS19: proposal grids of every image over its valid part."""
    p = A.proposals_of(X.images(spark, sf_dir), STRIDES)
    return p.withColumns({c: F.round(c, 9) for c in ("cx", "cy")})


QUERIES = query.queries
ORACLE_SQL = query.sql
