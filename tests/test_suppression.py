"""Suppression against hand-copied golden values and a plain reference."""

import random

import pytest
from conftest import boxes
from pyspark.sql import functions as F

from loomgrid.operators import metrics as M
from loomgrid.operators import nms as S

FOUR = [(0, 0, 0, 6.0, 3.0, 8.0, 7.0, 0.6), (0, 0, 1, 3.0, 6.0, 9.0, 11.0, 0.9), (0, 0, 2, 3.0, 7.0, 10.0, 12.0, 0.7), (0, 0, 3, 1.0, 4.0, 13.0, 7.0, 0.2)]


def test_nms_golden(spark):
    out = S.nms(boxes(spark, FOUR), 0.3, ["image_id"]).orderBy("rank").collect()
    assert [r.det_idx for r in out] == [1, 0, 3]


@pytest.mark.parametrize("method,want", [("linear", [0.9, 0.6, 0.29024392, 0.2]), ("gaussian", [0.9, 0.59630775, 0.35275510, 0.18650459])])
def test_soft_nms_golden(spark, method, want):
    out = S.soft_nms(boxes(spark, FOUR), 0.3, ["image_id"], min_score=0.01, method=method).orderBy("rank").collect()
    assert [r.det_idx for r in out] == [1, 0, 2, 3]
    assert [r.score for r in out] == pytest.approx(want, abs=1e-6)


def test_soft_nms_naive(spark):
    out = S.soft_nms(boxes(spark, FOUR), 0.3, ["image_id"], min_score=0.01, method="naive").orderBy("rank").collect()
    assert [r.det_idx for r in out] == [1, 0, 3]


def test_nms_match_golden(spark):
    rows = [(0, 0, 0, 49.1, 32.4, 51.0, 35.9, 0.9), (0, 0, 1, 49.3, 32.9, 51.0, 35.3, 0.9), (0, 0, 2, 35.3, 11.5, 39.9, 14.5, 0.4), (0, 0, 3, 35.2, 11.7, 39.7, 15.7, 0.3)]
    d = boxes(spark, rows)
    out = {r.head: r.members for r in S.nms_match(d, 0.6, ["image_id"]).collect()}
    assert out == {0: [0, 1], 2: [2, 3]}
    assert set(out) == {r.det_idx for r in S.nms(d, 0.6, ["image_id"]).collect()}


def test_zero_area_boxes_are_kept(spark):
    d = boxes(spark, [(0, 0, 0, 1.0, 1.0, 1.0, 1.0, 0.9), (0, 0, 1, 1.0, 1.0, 1.0, 1.0, 0.8)])
    assert S.nms(d, 0.5, ["image_id"]).count() == 2


def test_caps_filter_and_empty(spark):
    d = boxes(spark, FOUR)
    assert S.nms(d, 0.3, ["image_id"], min_score=0.6).count() == 1  # strictly over, then 0.7 is suppressed
    assert S.nms(d, 0.3, ["image_id"], max_num=2).count() == 2
    assert S.nms(d.where("false"), 0.3, ["image_id"]).count() == 0
    with pytest.raises(ValueError):
        S.nms_by_name("other", d, 0.3, ["image_id"])


def test_nms_against_plain_loop(spark):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        x, y = rng.uniform(0, 60), rng.uniform(0, 60)
        rows.append((i % 3, i % 2, i, x, y, x + rng.uniform(5, 30), y + rng.uniform(5, 30), round(rng.random(), 2)))

    def iou(a, b):
        w, h = max(0, min(a[5], b[5]) - max(a[3], b[3])), max(0, min(a[6], b[6]) - max(a[4], b[4]))
        return w * h / ((a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - w * h)

    want = set()
    for key in {(r[0], r[1]) for r in rows}:
        kept = []
        for r in sorted((r for r in rows if (r[0], r[1]) == key), key=lambda r: (-r[7], r[2])):
            if all(iou(k, r) <= 0.4 for k in kept):
                kept.append(r)
        want |= {r[2] for r in kept}
    assert {r.det_idx for r in S.batched_nms(boxes(spark, rows), 0.4, ["image_id"]).collect()} == want


def test_rotated_nms(spark):
    d = spark.createDataFrame([(0, 0, [10.0, 10.0, 8.0, 4.0, 0.0], 0.9), (0, 1, [10.0, 10.0, 8.0, 4.0, 0.1], 0.8), (0, 2, [40.0, 40.0, 8.0, 4.0, 1.0], 0.7)], "image_id int, det_idx int, rbox array<double>, score double")
    assert [r.det_idx for r in S.rotated_nms(d, 0.5, ["image_id"]).orderBy("rank").collect()] == [0, 2]
    assert S.rotated_nms(d, 0.5, ["image_id"], pre=1).count() == 1


def test_region_fallback(spark):
    pred = spark.createDataFrame([(0, 1, 0.01, 0.0, 0.0, 5.0, 5.0), (0, 2, 0.02, 9.0, 9.0, 12.0, 12.0)], "image_id bigint, idx bigint, score double, x1 double, y1 double, x2 double, y2 double")
    none = pred.where("false")
    assert [r.idx for r in S.select_regions(pred, none, none, ["image_id"]).collect()] == ["p2"]
    assert S.select_regions(pred, pred.where("idx = 1"), none, ["image_id"]).select("idx").where(F.col("idx") == "r1").count() == 1


def test_soft_nms_of_many_groups_at_once(spark):
    """Groups of different sizes, stepped through together, against one box at a time."""
    rng = random.Random(5)
    rows = []
    for i in range(300):
        x, y = rng.uniform(0, 30), rng.uniform(0, 30)
        rows.append((rng.randrange(40), 0, i, x, y, x + rng.uniform(5, 20), y + rng.uniform(5, 20), round(rng.random(), 1)))

    def iou(a, b):
        w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
        i = max(w, 0) * max(h, 0)
        return i / ((a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - i)

    want = []
    for k in range(40):
        left = {r[2]: [r[7], r] for r in rows if r[0] == k}
        rank = 0
        while left:
            at = max(left, key=lambda i: (left[i][0], -i))
            s, one = left.pop(at)
            want.append((k, at, rank, round(s, 9)))
            for v in left.values():
                v[0] *= 1 - iou(one, v[1]) if iou(one, v[1]) >= 0.3 else 1
            left = {i: v for i, v in left.items() if v[0] >= 1e-3}
            rank += 1
    d = boxes(spark, rows)
    got = S.soft_nms(d, 0.3, ["image_id"])
    assert sorted((r.image_id, r.det_idx, r["rank"], round(r.score, 9)) for r in got.collect()) == sorted(want)
    for plan in (got, S.rotated_nms(d.withColumn("rbox", F.array("x1", "y1", "x2", "y2", F.lit(0.0))), 0.3, ["image_id"])):
        assert "FlatMapGroupsInPandas" not in plan._jdf.queryExecution().optimizedPlan().toString()  # no call for each group


def test_greedy_matching_takes_steps_for_all_groups(spark):
    """Truths are taken once, ignored ones count as neither, and no group has a call of its own."""
    d = boxes(spark, [(k, 0, 10 * k + i, 1.0, 1.0, 21.0, 21.0, 0.9 - i / 10) for k in range(5) for i in range(3)] + [(9, 0, 90, 1.0, 1.0, 5.0, 5.0, 0.5)])
    g = boxes(spark, [(k, 0, 10 * k + j, 2.0, 2.0, 22.0, 22.0, j == 1) for k in range(5) for j in range(2)] + [(8, 0, 80, 1.0, 1.0, 5.0, 5.0, False)], "gt_idx")
    t = M.tpfp_greedy(d, g)
    assert sorted((r.det_idx, r.tp, r.fp) for r in t.collect()) == sorted([(10 * k + i, int(i == 0), int(i == 2)) for k in range(5) for i in range(3)] + [(90, 0, 1)])
    assert "CoGroup" not in t._jdf.queryExecution().optimizedPlan().toString()
