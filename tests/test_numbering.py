"""Numbers and totals by ranges of an order, of any type and however it is spread."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from loomgrid.operators import metrics as M
from loomgrid.operators.numbering import carried, numbered, ranges


def check(rows, got, by=None):
    """rows: (id, order, group); got: id -> (number, total, before)."""
    low = lambda v: (v is not None, v)
    groups = {}
    for r in rows:
        groups.setdefault(r[2] if by else 0, []).append(r)
    for g in groups.values():
        run = 0
        for n, (i, *_) in enumerate(sorted(g, key=lambda r: (low(r[1]), r[0]))):
            assert got[i] == (n, len(g), run), i
            run += i


ORDERS = {
    "outlier": ("double", [*map(float, range(300)), 1e18]),
    "ties": ("int", [7] * 300),
    "dates": ("date", [datetime.date(2020, 1, 1) + datetime.timedelta(k % 90) for k in range(300)] + [None]),
    "words": ("string", [f"w{k * k % 97}" for k in range(300)] + [None, ""]),
}


@pytest.mark.parametrize("kind", ORDERS)
@pytest.mark.parametrize("by", [(), ("g",)])
def test_numbers_of_any_order(spark, kind, by):
    ddl, values = ORDERS[kind]
    rng = random.Random(3)
    rows = [(i, v, rng.choice(["a", "a", "a", "b", None])) for i, v in enumerate(rng.sample(values, len(values)))]
    d = spark.createDataFrame(rows, f"id bigint, o {ddl}, g string").repartition(3)
    out = numbered(d, "id", F.col("o"), "n", "total", "id", "run", by)
    assert set(out.columns) == {"id", "o", "g", "n", "total", "run"}
    check(rows, {r.id: (r.n, r.total, r.run) for r in out.collect()}, by)


@pytest.mark.parametrize("kind", ORDERS)
def test_no_range_is_crowded(spark, kind):
    ddl, values = ORDERS[kind]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values * 8)], f"id bigint, o {ddl}")
    sizes = [r["count"] for r in ranges(d, ["o", "id"], 8).groupBy("_p").count().collect()]
    assert max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_totals_carry_over_ranges(spark):
    d = spark.createDataFrame([(i, "h" if i % 3 else "k", float(i * 37 % 101)) for i in range(200)], "id bigint, g string, v double")
    out = carried(ranges(d, ["g", "id"], 6), ["g"], low=("min", "v"), high=("max", "v"), n=("sum", F.lit(1))).collect()
    at = {}
    for r in out:
        at.setdefault((r.g, r._p), []).append(r)
    for (g, p), rows in at.items():
        before = [r.v for r in out if r.g == g and r._p < p]
        assert {(r.low, r.high, r.n) for r in rows} == {(min(before, default=None), max(before, default=None), len(before) or None)}


def test_empty_table(spark):
    d = spark.createDataFrame([], "id bigint, o int, g string")
    assert numbered(d, "id", F.col("o"), by=["g"]).count() == 0 == numbered(d, "id").count()


def test_running_values_by_ranges(spark):
    rng = random.Random(9)
    rows = [(i, "big" if i % 7 else None, rng.uniform(-5, 5), i % 3 + 1) for i in range(400)]
    d = spark.createDataFrame(rows, "id bigint, g string, v double, c int").repartition(3)
    most, mean, last, ext = {}, {}, {}, {}
    for n in (0, 5):
        got = {r.id: r.avg for r in M.weighted_log_average(d, ["g"], "id", "v", "c", n).collect()}
        for i, g, *_ in rows:
            w = [(v, c) for j, h, v, c in rows if h == g and j <= i][-n:]
            assert got[i] == pytest.approx(sum(v * c for v, c in w) / sum(c for _, c in w), abs=1e-9)
    for i, g, v, _ in rows:
        mean[g] = v if g not in mean else mean[g] * 0.9 + v * 0.1
        ext[i] = most[g] = max(most.get(g, v), v)
        last[i] = g
    assert {r.g: r.mean for r in M.ema_of(d, ["g"], "id", "v", 0.1).collect()} == pytest.approx(mean)
    assert {r.id: r.cummax for r in M.running_extreme(d, ["g"], "id", "v").collect()} == ext


def test_a_bounded_window_crosses_stretches(spark, monkeypatch):
    monkeypatch.setattr(M, "STRETCH", 7)
    d = spark.createDataFrame([(i, "g", float(i), 1) for i in range(60)], "id bigint, g string, v double, c int")
    got = {r.id: r.avg for r in M.weighted_log_average(d, ["g"], "id", "v", "c", 4).collect()}
    assert got == {i: sum(range(max(0, i - 3), i + 1)) / min(4, i + 1) for i in range(60)}


def test_crowded_scores_spread_over_ranges(spark):
    d = spark.range(20000).selectExpr("id AS det_idx", "id % 50 AS image_id", "0 AS class_id", "50 + id % 50 AS score", "int(id % 3 = 0) AS tp", "int(id % 3 > 0) AS fp")
    pr = M.precision_recall(d, spark.createDataFrame([(0, 9000)], "class_id int, num_gts bigint"))
    sizes = [r["count"] for r in pr.groupBy("slot").count().collect()]
    assert len(sizes) == 4 and max(sizes) <= 2 * 5000
    rows = sorted(pr.collect(), key=lambda r: r.pos)
    assert [r.pos for r in rows] == list(range(1, 20001))
    run, want = 0, sorted(((-(50 + i % 50), i % 50, i) for i in range(20000)))
    for r, (s, _, i) in zip(rows, want, strict=True):
        run += i % 3 == 0
        assert (r.det_idx, r.score, r.ctp) == (i, -s, run)
