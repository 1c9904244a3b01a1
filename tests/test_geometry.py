import math

import numpy as np
import pytest
from conftest import boxes
from pyspark.sql import functions as F

from loomgrid.functions import boxes as B
from loomgrid.functions import numeric as N
from loomgrid.operators import assign as A
from loomgrid.operators import metrics as M
from loomgrid.operators import spatial as P
from loomgrid.operators import voxel as V
from loomgrid.plans import detection as D
from loomgrid.plans import fixtures as X


def one(spark, *cols):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def lit_box(*v):
    return B.Box(*(F.lit(float(x)) for x in v))


@pytest.mark.parametrize("a,b,extra,want", [((1, 1, 3, 4), (0, 2, 2, 5), 1, 1 / 3), ((1, 1, 3, 4), (2, 1, 3, 3), 1, 0.5), ((0, 0, 3, 3), (4, 0, 5, 3), 1, 0.0), ((0, 0, 3, 3), (3, 0, 4, 3), 1, 0.2), ((0, 0, 10, 10), (0, 0, 10, 20), 0, 0.5), ((10, 10, 20, 20), (10, 10, 20, 20), 0, 1.0), ((32, 32, 38, 42), (0, 0, 10, 20), 0, 0.0)])
def test_iou_golden(spark, a, b, extra, want):
    assert one(spark, B.overlap(lit_box(*a), lit_box(*b), extra=extra))[0] == pytest.approx(want, abs=1e-6)


def test_conversions_round_trip(spark):
    b = lit_box(2, 3, 10, 9)
    back = B.from_cxcywh(*B.to_cxcywh(b))
    assert one(spark, *back) == [2, 3, 10, 9]
    assert one(spark, *B.from_xywh(*B.to_xywh(b))) == [2, 3, 10, 9]
    assert one(spark, *B.flip(B.flip(b, 20, 20, "diagonal"), 20, 20, "diagonal")) == [2, 3, 10, 9]
    assert one(spark, *B.map_back(B.map_to(b, 40, 40, 2.0, 2.0, "horizontal"), 40, 40, 2.0, 2.0, "horizontal")) == [2, 3, 10, 9]


def test_coders_round_trip(spark):
    p, g = lit_box(0, 0, 10, 20), lit_box(2, 1, 9, 26)
    for enc, dec in ((lambda: B.delta_encode(p, g), lambda d: B.delta_decode(p, d)), (lambda: B.tblr_encode(p, g), lambda d: B.tblr_decode(p, d)), (lambda: B.delta_encode(p, g, extra=1), lambda d: B.delta_decode(p, d, extra=1))):
        assert one(spark, *dec(enc())) == pytest.approx([2, 1, 9, 26])
    near = lit_box(3, 4, 8, 17)  # the grid coder holds offsets of less than half a cell only
    assert one(spark, *B.grid_decode(p, B.grid_encode(p, near, 8.0), 8.0)) == pytest.approx([3, 4, 8, 17])


def test_clip_limits_differ(spark):
    b = lit_box(-5, -5, 50, 50)
    assert one(spark, *B.clip_pixels(b, 20, 30)) == [0, 0, 19, 29]
    assert one(spark, *B.clip(b, 20, 30)) == [0, 0, 20, 30]


def test_affine_identity_and_rotation(spark):
    b = lit_box(2, 3, 10, 9)
    assert one(spark, *B.warped(b, B.affine_matrix())) == pytest.approx([2, 3, 10, 9])
    assert one(spark, *B.warped(b, B.affine_matrix(90))) == pytest.approx([-9, 2, -3, 10])


def test_losses(spark):
    a, b = lit_box(0, 0, 10, 10), lit_box(5, 5, 15, 15)
    iou, giou = 25 / 175, 25 / 175 - (225 - 175) / 225
    got = one(spark, B.iou_loss(a, b, "linear"), B.giou_loss(a, b), B.diou_loss(a, b), B.ciou_loss(a, b))
    assert got == pytest.approx([1 - iou, 1 - giou, 1 - iou + 50 / 450, 1 - iou + 50 / 450], abs=1e-5)
    x, t = 0.3, 1.0
    p = 1 / (1 + math.exp(-x))
    assert one(spark, N.bce_logits(F.lit(x), F.lit(t)), N.focal(F.lit(x), F.lit(t)))[0] == pytest.approx(-math.log(p))
    assert one(spark, N.focal(F.lit(x), F.lit(t)))[0] == pytest.approx(-math.log(p) * 0.25 * (1 - p) ** 2)


def test_max_iou_assign_golden(spark):
    d = boxes(spark, [(0, 0, 0, 0.0, 0.0, 10.0, 10.0), (0, 0, 1, 10.0, 10.0, 20.0, 20.0)])
    g = boxes(spark, [(0, 0, 0, 0.0, 0.0, 10.0, 9.0)], "gt_idx")
    out = {r.det_idx: r.gt_inds for r in A.max_iou_assign(d, g, 0.5, 0.5).collect()}
    assert out == {0: 1, 1: 0}
    assert {r.gt_inds for r in A.max_iou_assign(d, g.where("false"), 0.5, 0.5).collect()} == {0}


def test_assigners_agree_on_an_easy_case(spark):
    d = boxes(spark, [(0, 0, i, 20.0 * i, 0.0, 20.0 * i + 18, 18.0) for i in range(6)])
    g = boxes(spark, [(0, 0, 0, 20.0, 0.0, 38.0, 18.0), (0, 0, 1, 80.0, 0.0, 98.0, 18.0)], "gt_idx")
    want = {0: 0, 1: 1, 2: 0, 3: 0, 4: 2, 5: 0}
    pos = lambda df: {r.det_idx: r.gt_inds for r in df.collect()}
    cx, cy = B.centre(B.box())
    pri = d.withColumn("px", cx).withColumn("py", cy).withColumn("stride", F.lit(4.0)).withColumn("score", F.lit(0.5))
    assert pos(A.atss_assign(d, g, topk=1)) == want
    assert pos(A.task_aligned_assign(pri, g)) == want
    assert pos(A.sim_ota_assign(pri.drop("class_id"), g)) == want
    assert pos(A.point_assign(pri.select("image_id", "det_idx", "px", "py", "stride"), g, pos_num=1)) == want
    assert pos(A.centre_region_assign(d, g)[0]) == want
    assert pos(A.uniform_assign(d, d, g, k=1)) == want
    assert pos(A.grid_assign(d.withColumn("responsible", F.lit(True)), g, 0.5, 0.4)) == want
    assert pos(A.approx_max_iou_assign(d, d, g)) == want
    h = {(r.det_idx, r.gt_idx) for r in A.hungarian_assign(A.box_costs(d, g)).collect()}
    assert h == {(1, 0), (4, 1)}


def test_hungarian_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(1)
    for _ in range(30):
        n, m = rng.integers(1, 6, 2)
        c = rng.random((n, m))
        got = sum(c[i, j] for i, j in A.solve_assignment(c))
        t = c if n <= m else c.T
        best = min(sum(t[i, j] for i, j in enumerate(p)) for p in permutations(range(t.shape[1]), t.shape[0]))
        assert got == pytest.approx(best)


def test_hungarian_match_covers_every_class(spark, sf_dir):
    d, g = (t.select("image_id", "class_id", k).toPandas() for t, k in ((X.det(spark, sf_dir), "det_idx"), (X.gt(spark, sf_dir), "gt_idx")))
    got = D.hungarian_pairs(spark, sf_dir).toPandas().merge(d, on=["image_id", "det_idx"]).merge(g, on=["image_id", "gt_idx"])
    assert (got.class_id_x == got.class_id_y).all() and got.det_idx.is_unique and got.gt_idx.is_unique
    n = d.groupby(["image_id", "class_id"]).size().to_frame("d").join(g.groupby(["image_id", "class_id"]).size().to_frame("g"), how="inner")
    assert got.groupby(["image_id", "class_id_x"]).size().to_dict() == n.min(axis=1).to_dict()


def test_rotated_overlap_against_all_pairs(spark, sf_dir):
    def corners(t, k, a):
        return [(r.image_id, r.class_id, r[k], P.rotated_corners((r.x1 + r.x2) / 2, (r.y1 + r.y2) / 2, r.x2 - r.x1, r.y2 - r.y1, a)) for r in t.where("image_id < 4").collect()]

    d, g = X.det(spark, sf_dir), X.gt(spark, sf_dir)
    want = {}
    gs = corners(g, "gt_idx", -0.2)
    for i, c, a, p in corners(d, "det_idx", 0.1):
        want |= {(a, b): v for j, e, b, q in gs if (i, c) == (j, e) and (v := P.polygon_iou(p, q)) >= 0.1}
    near = d.where("image_id < 4").select("det_idx")
    got = {(r.det_idx, r.gt_idx): r.iou for r in D.rotated_overlap(spark, sf_dir).join(near, "det_idx").collect()}
    assert got == pytest.approx(want, abs=1e-6) and len(got) > 0


def test_metrics_edges(spark):
    d = boxes(spark, [(0, 0, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (0, 0, 1, 0.0, 0.0, 10.0, 10.0, 0.8), (1, 1, 2, 0.0, 0.0, 5.0, 5.0, 0.7), (0, 2, 3, 0.0, 0.0, 10.0, 10.0, 0.6)])
    g = boxes(spark, [(0, 0, 0, 0.0, 0.0, 10.0, 10.0, False), (0, 2, 1, 0.0, 0.0, 10.0, 10.0, True)], "gt_idx")
    t = {r.det_idx: (r.tp, r.fp) for r in M.tpfp_default(d, g).collect()}
    assert t == {0: (1, 0), 1: (0, 1), 2: (0, 1), 3: (0, 0)}
    per = {r.class_id: r for r in M.eval_map(d, g).collect()}
    assert per[0].ap == pytest.approx(1.0) and per[1].num_gts == 0 and per[2].num_gts == 0
    assert M.mean_ap(M.eval_map(d, g)).first().map == pytest.approx(1.0)
    assert M.mean_ap(M.eval_map(d, g.where("false"))).first().map == 0.0
    r = {x.n: x.recall for x in M.recalls(g.where("not is_ignore"), d, [1, 10]).collect()}
    assert r == {1: 1.0, 10: 1.0}


def test_polygons(spark):
    sq = np.array([[0, 0], [4, 0], [4, 4], [0, 4]], float)
    assert P.polygon_iou(sq, sq + 2) == pytest.approx(4 / 28)
    assert P.polygon_iou(P.rotated_corners(0, 0, 4, 4, 0), P.rotated_corners(0, 0, 4, 4, math.pi / 4)) == pytest.approx(0.7071, abs=1e-3)
    d = spark.createDataFrame([([0.0, 0.0, 4.0, 0.0, 4.0, 2.0, 0.0, 2.0, 2.0, 1.0],)], "p array<double>")
    area = d.select(P.min_area_polygon("p").alias("q")).select(M.polygon_area(F.col("q"))).first()[0]
    assert area == pytest.approx(8.0)
    corners = F.array(*(F.lit(float(v)) for v in (0, 0, 4, 0, 4, 2, 0, 2)))
    assert d.select(P.convex_iou("p", corners)).first()[0] == pytest.approx(1.0)


def test_points(spark):
    rng = np.random.default_rng(5)
    x = rng.random((40, 3))
    pts = spark.createDataFrame([(i % 2, i, *map(float, v)) for i, v in enumerate(x)], "batch int, pt_idx bigint, x double, y double, z double")
    ctr = pts.where("pt_idx < 6").select("batch", F.col("pt_idx").alias("c_idx"), *(F.col(a).alias(f"c_{a}") for a in "xyz"))
    got = {}
    for r in P.knn(pts, ctr, 5).collect():
        got.setdefault(r.c_idx, {})[r["rank"]] = r.pt_idx
    for c in range(6):
        own = [i for i in range(40) if i % 2 == c % 2]
        assert [got[c][k] for k in range(5)] == sorted(own, key=lambda i: (((x[i] - x[c]) ** 2).sum(), i))[:5]
    out = V.furthest_points(pts, 4).where("batch = 0").orderBy("step").collect()
    taken = [0]
    own = [i for i in range(40) if i % 2 == 0]
    while len(taken) < 4:
        taken.append(max(own, key=lambda i: (min(((x[i] - x[t]) ** 2).sum() for t in taken), -i)))
    assert [r.pt_idx for r in out] == taken
    # a centre hits itself at distance 0 even with a least radius; lists are padded with the first hit
    far = P.ball_query(pts, ctr, 5.0, 6.0, 3).where("c_idx = 1").orderBy("slot").collect()
    assert [r.pt_idx for r in far] == [1, 1, 1]


def test_sparse_rulebook(spark):
    c = spark.createDataFrame([(0, 0, 0, 0, 0), (0, 1, 0, 0, 1)], "batch int, idx int, z int, y int, x int")
    sites, rules = P.sparse_rulebook(c, (1, 1, 3), submanifold=True)
    assert sites.count() == 2
    assert {(r.kernel, r.idx, r.out_x) for r in rules.collect()} == {(1, 0, 0), (1, 1, 1), (0, 0, 1), (2, 1, 0)}


def test_as_of(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 5, 10), ("a", 3, 11), ("b", 10, 12)], "k string, rt int, v int")
    got = {r.id: r.right.v if r.right else None for r in P.as_of_join(left, right, ["k"], "t", "rt").collect()}
    assert got == {1: 10, 2: None, 3: None}


def test_nearest_neighbours_in_cells(spark):
    """Clusters, far outliers, many points at one place, ties, nulls and small batches, against all distances."""
    import random

    rng = random.Random(5)
    pts = [(0, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)) for _ in range(150)] + [(0, 1e6, -1e6, 3.0), (0, 1e6, -1e6, 4.0)] + [(0, 0.5, 0.5, 0.5)] * 40
    pts += [(0, rng.gauss(5, 1e-4), 5.0, 5.0) for _ in range(60)] + [(1, 1.0, 1.0, 1.0), (1, 2.0, 1.0, 1.0)] + [(2, float(x), float(y), 0.0) for x in range(6) for y in range(6)]
    rows = [(b, i, x, y, z) for i, (b, x, y, z) in enumerate(pts)]
    p = spark.createDataFrame([*rows, (0, 999, None, 0.0, 0.0), (0, 998, float("nan"), 0.0, 0.0)], "batch int, pt_idx bigint, x double, y double, z double")
    asks = [(b, n, x, y, z) for n, (b, _, x, y, z) in enumerate(rows[::3] + [(0, 0, -3e6, 0.0, 0.0), (0, 0, 2.0, 2.0, 2.0), (1, 0, 0.0, 0.0, 9.0), (2, 0, 2.5, 2.5, 0.0)])]
    c = spark.createDataFrame([*asks, (0, 999, None, 0.0, 0.0)], "batch int, c_idx bigint, c_x double, c_y double, c_z double")
    got = {}
    for r in P.knn(p, c, 7).collect():
        got.setdefault((r.batch, r.c_idx), []).append((r["rank"], r.pt_idx, r.d2))
    want = {}
    for b, n, *at in asks:
        d = sorted((sum((u - v) * (u - v) for u, v in zip(r[2:], at, strict=True)), r[1]) for r in rows if r[0] == b)[:7]
        want[b, n] = [(k, i, v) for k, (v, i) in enumerate(d)]
    assert {k: [x[:2] for x in sorted(v)] for k, v in got.items()} == {k: [x[:2] for x in v] for k, v in want.items()}
    assert P.knn(p.where("false"), c, 3).count() == 0


def test_points_in_boxes_of_all_sizes(spark):
    import math
    import random

    rng = random.Random(6)
    pts = [(0, i, rng.uniform(-5, 5), rng.uniform(-5, 5), rng.uniform(0, 1)) for i in range(300)]
    boxes = [(0, k, rng.uniform(-5, 5), rng.uniform(-5, 5), 0.0, 10.0 ** rng.uniform(-1, 1.2), 10.0 ** rng.uniform(-1, 1.2), 1.0, rng.uniform(-3, 3)) for k in range(30)] + [(0, 30, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0)]
    p = spark.createDataFrame(pts, "batch int, pt_idx bigint, x double, y double, z double")
    b = spark.createDataFrame(boxes, "batch int, box_idx bigint, bx double, by double, bz double, dx double, dy double, dz double, rz double")
    want = set()
    for _, i, x, y, z in pts:
        for _, k, bx, by, bz, dx, dy, dz, rz in boxes:
            c, s = math.cos(-rz), math.sin(-rz)
            lx, ly = (x - bx) * c - (y - by) * s, (x - bx) * s + (y - by) * c
            if abs(z - bz - dz / 2) <= dz / 2 and abs(lx) < dx / 2 and abs(ly) < dy / 2:
                want.add((0, i, k))
    got = [tuple(r) for r in P.points_in_boxes(p, b).collect()]
    assert set(got) == want and len(got) == len(want)


def test_rotated_overlaps_of_a_batch():
    rng = np.random.default_rng(2)
    a = np.column_stack([rng.uniform(0, 10, (500, 2)), rng.uniform(0.5, 8, (500, 2)), rng.uniform(-4, 4, 500)])
    b = np.column_stack([rng.uniform(0, 10, (500, 2)), rng.uniform(0.5, 8, (500, 2)), rng.uniform(-4, 4, 500)])
    a[:20], b[:20] = b[:20], b[:20]  # equal boxes
    a[20:40, 4], b[20:40, 4] = 0.0, np.pi / 2  # right angles
    a[40], b[40] = [0, 0, 2, 2, 0], [2, 0, 2, 2, 0]  # sides touch
    a[41], b[41] = [0, 0, 4, 4, 0.3], [0, 0, 1, 1, 1.0]  # one inside the other
    a[42], b[42] = [0, 0, 0, 0, 0], [0, 0, 1, 1, 0]
    want = [P.polygon_iou(P.rotated_corners(*x), P.rotated_corners(*y)) for x, y in zip(a, b, strict=True)]
    assert np.allclose(P.rotated_ious(a, b), want, atol=1e-9)


def test_rotated_overlap_in_cells(spark):
    rng = np.random.default_rng(3)
    one = lambda n: [(0, i, [float(v) for v in (*rng.uniform(-20, 20, 2), *rng.uniform(0.5, 15, 2), rng.uniform(-3, 3))]) for i in range(n)]
    a, b = spark.createDataFrame(one(60), "image_id int, i int, rbox array<double>"), spark.createDataFrame(one(60), "image_id int, j int, rbox_b array<double>")
    whole, cells = (sorted((r.i, r.j, round(r.iou, 9)) for r in P.rotated_overlap_join(a, b, ["image_id"], least=1e-6, cell=c).collect()) for c in (None, 6.0))
    assert whole == cells and len(whole) > 50


def test_certificate_tells_a_worse_matching(spark):
    rng = np.random.default_rng(1)
    rows = [(k, i, j, float(rng.normal())) for k, (n, m) in enumerate([(3, 5), (5, 3), (4, 4), (1, 1)]) for i in range(n) for j in range(m)]
    costs = spark.createDataFrame(rows, "image_id bigint, det_idx bigint, gt_idx bigint, cost double")
    prices = A.hungarian_prices(costs)
    good = A.certificate(costs, prices).collect()
    assert len(good) == 4 and all(r.feasible and abs(r.cost - r.bound) < 1e-9 and r.n == min(*s) for r, s in zip(sorted(good), [(3, 5), (5, 3), (4, 4), (1, 1)], strict=True))
    high = A.certificate(costs, prices.withColumn("price", F.col("price") + 0.5)).collect()
    assert not any(r.feasible for r in high)
    rows = {(r.side, r.idx): list(r) for r in prices.where("image_id = 2").collect()}
    (a, b) = (rows["det", k] for k in (0, 1))
    rows["gt", a[3]][3], rows["gt", b[3]][3] = 1, 0  # partners swapped, on either side
    a[3], b[3] = b[3], a[3]
    worse = A.certificate(costs, spark.createDataFrame(list(rows.values()), prices.schema)).first()
    assert worse.feasible and worse.cost > worse.bound + 1e-6


def test_furthest_points_in_rounds(spark):
    """Large batches, in rounds over few candidates, take the same steps as one task does."""
    rng = np.random.default_rng(11)
    rows = [(b, i, *map(float, rng.normal(size=3))) for b, n in ((0, 400), (1, 300), (None, 60), (2, 20)) for i in range(n)]
    rows += [(3, i, float(i % 3), 0.0, 0.0) for i in range(80)]  # three places only
    p = spark.createDataFrame(rows, "batch int, pt_idx bigint, x double, y double, z double").repartition(3)
    key = lambda d: sorted(((r.batch is None, r.batch or 0, r.step, r.pt_idx) for r in d.collect()))
    one, many = V.furthest_points(p, 25), V.furthest_points(p, 25, whole=50, keep=40)
    assert key(one) == key(many)


def test_matchings_of_many_images_at_once(spark):
    """Images of all shapes, cut over batches, one with pairs left out, match as each does alone."""
    rng = np.random.default_rng(4)
    shapes = [(int(rng.integers(1, 7)), int(rng.integers(1, 7))) for _ in range(200)]
    images = {k: rng.integers(0, 9, shape).astype(float) + rng.random(shape) for k, shape in enumerate(shapes)}
    images[200] = np.array([[1.0, 2.0], [np.nan, 5.0]])
    rows = [(k, i * 3, j * 5, float(c[i, j])) for k, c in images.items() for i in range(len(c)) for j in range(len(c[0])) if not np.isnan(c[i, j])]
    costs = spark.createDataFrame(rows, "image_id bigint, det_idx bigint, gt_idx bigint, cost double").repartition(3)
    want = {(k, i * 3, j * 5) for k, c in images.items() for i, j in A.solve_assignment(np.nan_to_num(c, nan=1e12))}
    assert {(r.image_id, r.det_idx, r.gt_idx) for r in A.hungarian_assign(costs).collect()} == want
    c = A.certificate(costs, A.hungarian_prices(costs)).collect()
    assert len(c) == 201 and all(r.feasible and r.n == min(images[r.image_id].shape) and abs(r.cost - r.bound) < 1e-6 for r in c)
    many = A.solve_all(np.stack([c for c in images.values() if c.shape == (3, 4)]))
    assert len(many[0]) > 1 and all(len(set(m)) == 3 for m in many[0].tolist())
    with pytest.raises(Exception, match="listed twice"):
        A.hungarian_assign(costs.union(costs.limit(1))).collect()


def test_turned_boxes_end_where_their_sql_says(spark, tmp_path):
    """A point between 0.14999999 and 0.15 from the middle is outside, one just within the first is inside."""
    from loomgrid.plans import pointsets

    c, s = np.cos(0.5), np.sin(0.5)
    far = [0.0, 0.149999995, 0.1499, -0.149999995, 0.16]
    rows = [(k, [float(np.float32(u * c)), float(np.float32(u * s)), 0.0], 0) for k, u in enumerate(far)]
    inside = [abs(v[0] * c + v[1] * s) <= 0.14999999 for _, v, _ in rows]
    edge = [0.14999999 < abs(v[0] * c + v[1] * s) < 0.15 for _, v, _ in rows]
    assert any(edge)
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.pt_idx for r in pointsets.points_in_turned_boxes(spark, str(tmp_path)).where("box_idx = 0").collect()}
    assert got == {k for k, ok in enumerate(inside) if ok}


ASSIGNERS = {
    "max_iou": lambda d, g: A.max_iou_assign(d, g, min_pos=0.1),
    "approx": lambda d, g: A.approx_max_iou_assign(d, d.unionByName(d.withColumn("x1", F.col("x1") + 1)), g),
    "atss": lambda d, g: A.atss_assign(d, g, level="class_id"),
    "sim_ota": lambda d, g: A.sim_ota_assign(d.withColumns({"px": F.col("x1") + 1, "py": F.col("y1") + 1, "stride": F.lit(2.0)}), g),
    "uniform": lambda d, g: A.uniform_assign(d, d.withColumn("x1", F.col("x1") - 1), g, k=2),
    "task": lambda d, g: A.task_aligned_assign(d.withColumn("px", F.col("x1") + 1).withColumn("py", F.col("y1") + 1), g),
}


def _crowd(spark):
    rng = np.random.default_rng(9)
    box = lambda: [float(v) for v in (lambda x, y: (x, y, x + rng.integers(2, 9), y + rng.integers(2, 9)))(*rng.integers(0, 12, 2))]
    d = [(k, int(rng.integers(0, 2)), 100 * k + i, *box(), float(rng.random())) for k in range(12) for i in range(int(rng.integers(0, 9)))]
    g = [(k, 0, 100 * k + i, *box(), False) for k in range(12) for i in range(int(rng.integers(0, 6)))]
    return d, g


@pytest.mark.parametrize("name", sorted(ASSIGNERS))
def test_assigners_move_boxes_not_pairs(spark, name):
    """No join lists the pairs of an image, to be sorted or shuffled after it: joins are on boxes."""
    import re

    d, g = _crowd(spark)
    plan = ASSIGNERS[name](boxes(spark, d), boxes(spark, g, "gt_idx"))._jdf.queryExecution().optimizedPlan().toString()
    assert re.findall(r"Join \w+, (.*)", plan) and all("det_idx" in c for c in re.findall(r"Join \w+, (.*)", plan))


def test_max_iou_of_uneven_images(spark):
    d, g = _crowd(spark)

    def iou(a, b):
        w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
        i = max(w, 0.0) * max(h, 0.0)
        return i / max((a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - i, 1e-6)

    want = {}
    for a in d:
        own = [(iou(a, b), -b[2]) for b in g if b[0] == a[0]]
        m, at = max(own) if own else (0.0, None)
        low = [b[2] for b in g if b[0] == a[0] and iou(a, b) >= 0.1 and iou(a, b) == max(iou(x, b) for x in d if x[0] == a[0])]
        want[a[2]] = (max(low) + 1 if low else 1 - at if own and m >= 0.5 else 0 if m < 0.4 else -1, m)
    got = A.max_iou_assign(boxes(spark, d), boxes(spark, g, "gt_idx"), min_pos=0.1).collect()
    assert {r.det_idx: (r.gt_inds, r.max_overlap) for r in got} == want and len(got) == len(d)
