"""Run lengths, their compact text and what is computed from them, against pixels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.functions import masks as K
from loomgrid.functions import text as T


def runs_of(bits):
    out, now = [0], 0
    for b in bits:
        if b != now:
            out.append(0)
            now = b
        out[-1] += 1
    return out


def test_known_texts():
    """Small counts are characters from 48 on; larger ones take more, and differences may be negative."""
    assert K.encode(np.array([0, 1, 2]), np.array([3])) == ["012"]
    assert K.encode(np.array([16, 31, 32]), np.array([3])) == ["`0o0P1"]
    assert K.encode(np.array([5, 9, 5, 4]), np.array([4])) == ["595K"]
    for counts in ([0, 1, 2], [5, 9, 5, 4], [1 << 40, 3, 1 << 33, 0, 7], [10**6, 1, 1, 10**6, 1, 2]):
        assert K.decode(K.encode(np.array(counts), np.array([len(counts)]))[0]).tolist() == counts
    assert K.encode(np.array([5, 9, 5, 4, 7, 8]), np.array([4, 0, 2])) == ["595K", "", "78"]
    with pytest.raises(ValueError):
        K.decode("o")


def test_masks_against_pixels(spark):
    rng = np.random.default_rng(8)
    h, w = 7, 9
    masks = [np.zeros((w, h), int), np.ones((w, h), int)] + [(rng.random((w, h)) < d).astype(int) for d in rng.uniform(0.05, 0.95, 40)]
    rows = [(i, a.ravel().tolist(), b.ravel().tolist()) for i, (a, b) in enumerate(zip(masks, masks[::-1], strict=True))]
    d = spark.createDataFrame(rows, "i int, a array<int>, b array<int>").select("*", T.run_lengths(F.col("a")).alias("ra"), T.run_lengths(F.col("b")).alias("rb"))
    d = d.select("*", K.compact("ra").alias("code"), K.measure("ra", F.lit(h)).alias("m"), K.overlap("ra", "rb", F.col("i") % 2 == 1).alias("o")).withColumn("back", K.expand("code"))
    for r in d.collect():
        a, b = np.array(r.a).reshape(w, h), np.array(r.b).reshape(w, h)
        assert r.ra == runs_of(r.a) == r.back
        x, y = np.nonzero(a)
        assert tuple(r.m) == ((a.sum(), x.min(), y.min(), x.max() - x.min() + 1, y.max() - y.min() + 1) if a.any() else (0,) * 5)
        union = a.sum() if r.i % 2 else (a | b).sum()
        assert r.o.inter == (a & b).sum() and r.o.iou == pytest.approx((a & b).sum() / union if union else 0.0)
    empty = spark.createDataFrame([(None,), ([4],)], "c array<int>")
    assert [r[0] for r in empty.select(K.compact("c")).collect()] == [None, "4"]
