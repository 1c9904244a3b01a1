"""Voxels and point sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.operators.numbering import written
from loomgrid.session import reachable

AXES = ("x", "y", "z")


def voxel_coordinates(points: DataFrame, size: tuple[float, ...], low: tuple[float, ...], high: tuple[float, ...]) -> DataFrame:
    """Points with cell numbers vz, vy, vx (stored in that order), all -1 if any is out of range."""
    grid = [round((h - lo) / s) for h, lo, s in zip(high, low, size, strict=True)]
    cell = [F.floor((F.col(a) - lo) / s).cast("int") for a, lo, s in zip(AXES, low, size, strict=True)]
    ok = F.lit(True)
    for c, g in zip(cell, grid, strict=True):
        ok = ok & (c >= 0) & (c < g)
    out = points
    for a, c in reversed(list(zip(AXES, cell, strict=True))):
        out = out.withColumn(f"v{a}", F.when(ok, c).otherwise(-1))
    return out


def voxelize(points: DataFrame, size: tuple[float, ...], low: tuple[float, ...], high: tuple[float, ...], max_points: int = 35, max_voxels: int = 20000, batch: str = "batch", idx: str = "pt_idx") -> DataFrame:
    """(batch, voxel, slot, idx, vz, vy, vx): voxels numbered by their first point, the first ``max_voxels`` of a batch kept, the first
    ``max_points`` points of each."""
    p = voxel_coordinates(points, size, low, high).where("vx >= 0")
    key = [batch, "vz", "vy", "vx"]
    w = Window.partitionBy(*key).orderBy(idx)
    p = p.withColumn("slot", F.row_number().over(w) - 1).withColumn("_first", F.first(idx).over(w))
    heads = p.where("slot = 0").select(*key, F.col("_first"))
    heads = heads.withColumn("voxel", F.row_number().over(Window.partitionBy(batch).orderBy("_first")) - 1).where(F.col("voxel") < max_voxels).drop("_first")
    return p.where(F.col("slot") < max_points).join(heads, key).select(batch, "voxel", "slot", idx, "vz", "vy", "vx")


def scatter(features: DataFrame, keys: list[str], value: str, how: str = "max") -> DataFrame:
    """max, sum or mean of a feature per coordinate; out-of-range rows (-1) are left out."""
    f = {"max": F.max, "sum": F.sum, "mean": F.avg}[how]
    return features.where(F.col(keys[-1]) >= 0).groupBy(*keys).agg(f(value).alias(value))


#: Points of a batch up to which it is sampled in one task, and candidates of a larger batch that a round looks at.
WHOLE, KEEP = 1 << 16, 4096


def _greedy(x: np.ndarray, far: np.ndarray, n: int, floor: float = -np.inf) -> list[int]:
    """Up to ``n`` places, always that of the largest ``far``, the first on ties, each lowering what is near it; after the first only while it is
    above ``floor``."""
    far, out = far.copy(), []
    while len(out) < min(n, len(x)):
        at = int(far.argmax())
        if far[at] <= 0 or (out and far[at] <= floor):
            break
        out.append(at)
        far = np.minimum(far, ((x - x[at]) ** 2).sum(1))
    return out


def furthest_points(points: DataFrame, n: int, batch: str = "batch", idx: str = "pt_idx", dims: list[str] = ["x", "y", "z"], whole: int | None = None, keep: int | None = None) -> DataFrame:  # noqa: B006
    """(batch, step, idx): from the batch's first point on, always the point furthest from all taken (lowest index on ties).

    A batch of up to ``whole`` points is sampled in one task. Larger ones go in rounds, all at once. A round brings every point's distance to
    what is taken up to date, in parallel, and looks at the ``keep`` furthest points of each batch. Distances only fall, so steps
    among these are right as long as the furthest is further than any point that was left out; then the next round begins. As the
    furthest distance falls slowly, a round takes many steps; only the steps' points, ``n`` of a large batch, pass the driver. Once all
    points lie on points taken, the first is taken again."""
    reachable(points.sparkSession)
    whole, keep = whole or WHOLE, keep or KEEP
    kinds = dict(points.dtypes)
    ddl = f"`{batch}` {kinds[batch]}, step int, `{idx}` {kinds[idx]}"
    p = points.select(batch, idx, *dims)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(idx)
        x, ids = pdf[dims].to_numpy(np.float64), pdf[idx].to_numpy()
        far, at, out = np.full(len(x), np.inf), 0, []
        for _ in range(min(n, len(x))):
            out.append(ids[at])
            far = np.minimum(far, ((x - x[at]) ** 2).sum(1))
            at = int(far.argmax())
        return pd.DataFrame({batch: [pdf[batch].iloc[0]] * len(out), "step": range(len(out)), idx: out})

    sizes = p.groupBy(batch).agg(F.count("*").alias("n"), F.min_by(F.array(*dims), idx).alias("x"), F.min(idx).alias("first")).where(F.col("n") > whole).collect()  # one row for each large batch
    if not sizes:
        return p.groupBy(batch).applyInPandas(run, ddl)
    large = F.col(batch).isin([r[batch] for r in sizes if r[batch] is not None])
    if any(r[batch] is None for r in sizes):
        large = large | F.col(batch).isNull()
    rest = p.where(~F.coalesce(large, F.lit(False))).groupBy(batch).applyInPandas(run, ddl)
    taken = {r[batch]: [(r["first"], list(map(float, r["x"])))] for r in sizes}
    room = {r[batch]: min(n, r["n"]) for r in sizes}
    state = p.where(F.coalesce(large, F.lit(False))).withColumn("_far", F.lit(float("inf")))
    fresh = {k: [x for _, x in v] for k, v in taken.items()}
    open_ = {k for k in taken if len(taken[k]) < room[k]}
    while open_:
        state = written(state.mapInPandas(_nearer(fresh, batch, dims), state.schema), "furthest")
        w = Window.partitionBy(batch).orderBy(F.desc("_far"), idx)
        top = state.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep + 1)
        more = {k: room[k] - len(taken[k]) for k in open_}

        def steps(pdf: pd.DataFrame) -> pd.DataFrame:
            k = pdf[batch].iloc[0]
            left = more.get(None if pd.isna(k) else k, 0)
            pdf = pdf.sort_values("_r")
            floor = pdf["_far"].iloc[-1] if len(pdf) > keep else -np.inf
            pdf = pdf.head(keep).sort_values(idx)
            at = _greedy(pdf[dims].to_numpy(np.float64), pdf["_far"].to_numpy(np.float64), left, floor)
            return pdf.iloc[at][[batch, idx, *dims]].assign(step=range(len(at)))

        got = top.groupBy(batch).applyInPandas(steps, f"`{batch}` {kinds[batch]}, `{idx}` {kinds[idx]}, {', '.join(f'`{d}` {kinds[d]}' for d in dims)}, step int").orderBy("step").collect()
        fresh = {}
        for r in got:
            taken[r[batch]].append((r[idx], [float(r[d]) for d in dims]))
            fresh.setdefault(r[batch], []).append(taken[r[batch]][-1][1])
        open_ = {k for k in fresh if len(taken[k]) < room[k]}
    for k, v in taken.items():
        v += [v[0]] * (room[k] - len(v))
    rows = [(k, step, i) for k, v in taken.items() for step, (i, _) in enumerate(v)]
    return rest.unionByName(points.sparkSession.createDataFrame(rows, ddl))


def _nearer(fresh: dict, batch: str, dims: list[str]):
    """Lowers each point's ``_far`` by its distance to the points newly taken of its batch."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            far, x = b["_far"].to_numpy(np.float64, copy=True), b[dims].to_numpy(np.float64)
            for k, points in fresh.items():
                rows = np.flatnonzero(b[batch].isna() if k is None else b[batch] == k)
                for c in points:
                    far[rows] = np.minimum(far[rows], ((x[rows] - c) ** 2).sum(1))
            yield b.assign(_far=far)

    return part


def furthest_by_distance(pairs: DataFrame, n: int, batch: str = "batch") -> DataFrame:
    """The same on distance rows (batch, i, j, dist)."""
    reachable(pairs.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="i", columns="j", values="dist").sort_index().sort_index(axis=1)
        d, far, at, out = m.to_numpy(np.float64), np.full(len(m), np.inf), 0, []
        for _ in range(min(n, len(m))):
            out.append(m.index[at])
            far = np.minimum(far, d[at])
            at = int(far.argmax())
        return pd.DataFrame({batch: [pdf[batch].iloc[0]] * len(out), "step": range(len(out)), "pt_idx": out})

    kinds = dict(pairs.dtypes)
    return pairs.groupBy(batch).applyInPandas(run, f"`{batch}` {kinds[batch]}, step int, pt_idx {kinds['i']}")


def sample_points(points: DataFrame, counts: list[int], modes: list[str], ranges: list[int], batch: str = "batch", idx: str = "pt_idx", features: list[str] = ["x", "y", "z"]) -> DataFrame:  # noqa: B006
    """Furthest-point samples of consecutive index ranges (by position D-FPS, by feature F-FPS, both FS); -1 is the rest."""
    out, start = None, 0
    for n, mode, r in zip(counts, modes, ranges, strict=True):
        part = points.where((F.col(idx) >= start) & (F.lit(True) if r == -1 else F.col(idx) < r))
        for kind in {"D-FPS": [["x", "y", "z"]], "F-FPS": [features], "FS": [features, ["x", "y", "z"]]}[mode]:
            one = furthest_points(part, n, batch, idx, kind).withColumn("mode", F.lit(mode))
            out = one if out is None else out.unionByName(one)
        start = start if r == -1 else r
    return out


def local_maxima(heat: DataFrame, kernel: int = 3, key: list[str] = ["image_id"]) -> DataFrame:  # noqa: B006
    """Cells (key, y, x, v) that equal their window's maximum keep their value, others are 0: two one-dimensional passes."""
    pad = (kernel - 1) // 2
    rows = Window.partitionBy(*key, "y").orderBy("x").rowsBetween(-pad, pad)
    cols = Window.partitionBy(*key, "x").orderBy("y").rowsBetween(-pad, pad)
    h = heat.withColumn("_m", F.max("v").over(rows)).withColumn("_m", F.max("_m").over(cols))
    return h.withColumn("v", F.when(F.col("_m") == F.col("v"), F.col("v")).otherwise(0.0)).drop("_m")


def heatmap_topk(heat: DataFrame, k: int, width: int, height: int, key: list[str] = ["image_id"]) -> DataFrame:  # noqa: B006
    """The ``k`` best of rows (key, pos, v), pos counting class, y, x; with its parts."""
    w = Window.partitionBy(*key).orderBy(F.desc("v"), "pos")
    t = heat.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)
    area = width * height
    return t.withColumn("class_id", F.expr(f"pos div {area}")).withColumn("index", F.expr(f"pos % {area}")).withColumn("y", F.expr(f"pos % {area} div {width}")).withColumn("x", F.expr(f"pos % {width}"))


def flat_topk(logits: DataFrame, k: int, classes: int, thr: float = 0.0, key: list[str] = ["image_id"]) -> DataFrame:  # noqa: B006
    """The ``k`` best of rows (key, pos, logit), pos counting box, class: (key, rank, box, class_id, score over ``thr``)."""
    w = Window.partitionBy(*key).orderBy(F.desc("logit"), "pos")
    t = logits.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)
    t = t.select(*key, "rank", F.expr(f"pos div {classes}").alias("box"), F.expr(f"pos % {classes}").alias("class_id"), (1 / (1 + F.exp(-F.col("logit")))).alias("score"))
    return t.where(F.col("score") > thr)


def score_topk(scores: DataFrame, thr: float, k: int, key: list[str] = ["image_id"]) -> DataFrame:  # noqa: B006
    """Rows (key, pos, class_id, score) over ``thr``, the best ``k`` of each key."""
    w = Window.partitionBy(*key).orderBy(F.desc("score"), "pos", "class_id")
    return scores.where(F.col("score") > thr).withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)
