"""Pairs that are only looked at where boxes and truths meet, clipping of many pairs at once, and curves over one order."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import boxes
from loomgrid.functions import boxes as B
from loomgrid.operators import assign as A
from loomgrid.operators import metrics as M
from loomgrid.operators import spatial as P

DET = [(1, 0, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 0, 2, 5.0, 0.0, 15.0, 10.0, 0.8), (1, 1, 3, 0.0, 0.0, 10.0, 10.0, 0.7), (None, 0, 4, 0.0, 0.0, 10.0, 10.0, 0.6), (2, 0, 5, 0.0, 0.0, 10.0, 10.0, 0.5), (1, 0, 6, None, 0.0, 10.0, 10.0, 0.4)]
GT = [(1, 0, 12, 0.0, 0.0, 10.0, 10.0, False), (1, 0, 11, 0.0, 0.0, 10.0, 10.0, True), (None, 0, 13, 0.0, 0.0, 10.0, 10.0, False), (1, 0, 14, 6.0, 0.0, 16.0, 10.0, False), (None, None, 15, 0.0, 0.0, 10.0, 10.0, False)]


def exchanges(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_best_match_moves_rows_not_pairs(spark):
    m = P.best_match(boxes(spark, DET), boxes(spark, GT, "gt_idx"), ["image_id", "class_id"], ["det_idx"], "gt_idx", keep=("is_ignore",))
    assert "Join" not in exchanges(m)  # pairs came from a join
    got = {r.det_idx: (r.match, r.iou and round(r.iou, 6), r.is_ignore) for r in m.collect()}
    # ties go to the lower truth; nulls in a key meet nothing; a box without a corner has the first truth and no overlap
    assert got == {1: (11, 1.0, True), 2: (14, round(9 / 11, 6), False), 3: (None, None, None), 4: (None, None, None), 5: (None, None, None), 6: (11, None, True)}
    assert [f.name for f in m.schema][:8] == ["image_id", "class_id", "det_idx", "x1", "y1", "x2", "y2", "score"]


@pytest.mark.parametrize(("mode", "extra"), [("iou", 1), ("iof", 0), ("giou", 0)])
def test_best_match_of_a_crowd(spark, monkeypatch, mode, extra):
    rng = np.random.default_rng(3)
    corner = lambda n: [(float(x), float(y), float(x + w), float(y + h)) for x, y, w, h in np.hstack([rng.integers(0, 60, (n, 2)), rng.integers(1, 40, (n, 2))])]
    det = boxes(spark, [(1, 0, i, *b, 0.5) for i, b in enumerate(corner(60))])
    gt = boxes(spark, [(1, 0, i, *b, False) for i, b in enumerate(corner(50))], "gt_idx")
    pairs = P.overlap_join(det, gt, ["image_id"], mode, None, extra).groupBy("det_idx").agg(F.max_by(F.struct("gt_idx", "iou"), F.struct("iou", -F.col("gt_idx"))).alias("m"))
    want = {r.det_idx: (r.m.gt_idx, r.m.iou) for r in pairs.collect()}
    got = P.best_match(det, gt, ["image_id", "class_id"], ["det_idx"], "gt_idx", mode, extra).collect()
    assert {r.det_idx: (r.match, r.iou) for r in got} == want


def test_point_assign_moves_rows_not_pairs(spark):
    points = spark.createDataFrame([(1, i, 10.0 * i, 0.0, 8.0) for i in range(5)] + [(2, 0, 0.0, 0.0, 8.0), (None, 9, 0.0, 0.0, 8.0)], "image_id bigint, det_idx bigint, px double, py double, stride double")
    gt = boxes(spark, [(1, 0, 1, 8.0, -4.0, 16.0, 4.0, False), (1, 0, 2, 8.0, -4.0, 16.0, 4.0, False), (None, 0, 3, 0.0, 0.0, 8.0, 8.0, False)], "gt_idx")
    a = A.point_assign(points, gt, pos_num=2)
    assert "Join" not in exchanges(a)
    assert sorted((r.image_id or 0, r.det_idx, r.gt_inds) for r in a.collect()) == [(0, 9, 0), (1, 0, 0), (1, 1, 2), (1, 2, 2), (1, 3, 0), (1, 4, 0), (2, 0, 0)]


def test_bucket_lines_are_ranked_once(spark):
    d = boxes(spark, [(1, 0, 1, 0.0, 0.0, 70.0, 70.0, 0.5)])
    g = B.Box(*(F.lit(v) for v in (10.0, 0.0, 70.0, 70.0)))
    e = B.bucket_encode(B.box(), g, "left", 7)
    assert "array_sort" not in exchanges(d.select(e.alias("e")))  # sorted anew for every line
    r = d.select(e.alias("e")).first().e
    assert (r.label, r.offsets, r.weights, r.cls_weights) == (0, [-0.5, 0.5, 1.5, 2.5], [1.0, 1.0, 0.0, 0.0], [1.0, 0.0, 1.0, 1.0])
    lost = B.bucket_encode(B.box(), B.Box(F.lit(None).cast("double"), g.y1, g.x2, g.y2), "left", 7)
    assert d.select(lost.alias("e")).first().e.label == 0


def test_convex_overlaps_of_many_pairs(monkeypatch):
    rng = np.random.default_rng(5)
    points = [rng.integers(0, 12, 2 * k).astype(float) for k in rng.integers(1, 9, 300)]
    points += [np.array([0.0, 0, 4, 4, 8, 8]), np.array([1.0, 1, 1, 1, 1, 1])]  # a line, a point
    quads = [np.array([x, y, x + w, y, x + w, y + h, x, y + h], float)[:: 1] for x, y, w, h in np.hstack([rng.integers(0, 8, (302, 2)), rng.integers(1, 8, (302, 2))])]
    quads[::2] = [q.reshape(-1, 2)[::-1].ravel() for q in quads[::2]]
    for mode, f in (("iou", P.convex_iou), ("giou", P.convex_giou)):
        want = [P.polygon_iou(P.hull(p.reshape(-1, 2)), q.reshape(-1, 2), mode) for p, q in zip(points, quads, strict=True)]
        monkeypatch.setattr(P, "convex_clip", None)  # pair by pair
        got = f.func(pd.Series(points), pd.Series(quads))
        monkeypatch.undo()
        assert got.tolist() == pytest.approx(want, abs=1e-9)


def test_coco_curves_over_many_ranges(spark, sf_dir, monkeypatch):
    from loomgrid.plans import fixtures as X

    det, gt = X.det(spark, sf_dir), X.gt(spark, sf_dir)
    whole = sorted(map(tuple, M.coco_ap(det, gt).collect()))
    rows = []
    real = M.ranges
    monkeypatch.setattr(M, "STRETCH", 50)
    monkeypatch.setattr(M, "ranges", lambda d, *a: rows.append((d.count(), a[1])) or real(d, *a))
    parts = sorted(map(tuple, M.coco_ap(det, gt).collect()))
    assert rows[0][0] == det.count()  # a row per detection, not one for each of ten thresholds
    assert rows[0][1] == -(-det.count() // 50)
    assert [p[:3] for p in parts] == [w[:3] for w in whole]
    assert [p[3] for p in parts] == pytest.approx([w[3] for w in whole], abs=1e-12)
    assert [p[4] for p in parts] == [w[4] for w in whole]
