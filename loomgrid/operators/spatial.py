"""Spatial joins: box overlap, nearest neighbours, radius search, containment.

Every join is an equi-join on the image, class or batch first; the geometric predicate is a residual condition
of that join, so the plan is one shuffled (or, where a side is small, broadcast) hash join. ``cell`` adds grid cells to the
equi keys, which bounds the candidates of an image with very many boxes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from loomgrid.functions import boxes as B
from loomgrid.operators.grouped import beside, corners, overlaps, stretches
from loomgrid.operators.numbering import written
from loomgrid.session import reachable


def overlap_join(a: DataFrame, b: DataFrame, on: list[str], mode: str = "iou", least: float | None = 0.0, extra: float = 0, eps: float = 1e-6, cell: float | None = None, how: str = "inner") -> DataFrame:
    """Pairs of ``a`` and ``b`` rows (``b``'s box as bx1..by2) with equal ``on`` and overlap at least ``least`` (all pairs if
    None), with column ``iou``. With ``cell``, boxes meet in the grid cells they touch and each pair is kept only in
    the cell of its intersection's corner, so no pair comes twice; overlaps of 0 are then absent."""
    bb = b.select([F.col(c).alias(f"b{c}") if c in B.Box._fields else F.col(c) for c in b.columns])
    ab, bx = B.box(), B.Box(*(F.col(f"b{n}") for n in B.Box._fields))
    keys = list(on)
    if cell:
        spread = lambda d, box: d.withColumn("_cx", F.explode(F.sequence(F.floor(box.x1 / cell), F.floor(box.x2 / cell)))).withColumn("_cy", F.explode(F.sequence(F.floor(box.y1 / cell), F.floor(box.y2 / cell))))
        a, bb = spread(a, ab), spread(bb, bx)
        keys += ["_cx", "_cy"]
    j = a.join(bb, keys, how)
    if cell:
        j = j.where((F.floor(F.greatest("x1", "bx1") / cell) == F.col("_cx")) & (F.floor(F.greatest("y1", "by1") / cell) == F.col("_cy"))).drop("_cx", "_cy")
    j = j.withColumn("iou", B.overlap(ab, bx, mode, extra, eps))
    return j if least is None else j.where(F.col("iou") >= least)


def best_match(a: DataFrame, b: DataFrame, on: list[str], a_key: list[str], b_idx: str, mode: str = "iou", extra: float = 0, eps: float = 1e-6, keep: tuple[str, ...] = ()) -> DataFrame:
    """For each ``a`` row the ``b`` row of largest overlap (lowest ``b_idx`` on ties) as ``match`` and ``iou``, with its columns ``keep``; rows without any ``b`` keep
    nulls. Boxes move once, as rows, never their pairs."""
    corner = {c: F.col(c).cast("double") for c in B.Box._fields}
    kinds = [b.schema[c].dataType for c in keep]
    mine = corner | {f"_{c}": F.lit(None).cast(k) for c, k in zip(keep, kinds, strict=True)}
    theirs = corner | {f"_{c}": F.col(c) for c in keep}

    def work(t: pa.Table, parts) -> dict[str, pa.Array]:
        box, at, iou = corners(t), np.full(len(t), -1), np.full(len(t), -np.inf)
        for d, g in parts:
            at[d] = g[:, :1]
            for few in stretches(d, g):
                v = overlaps(box[d], box[few], eps, mode, extra)
                best = v.argmax(axis=2)
                v, few = np.take_along_axis(v, best[..., None], axis=2)[..., 0], np.take_along_axis(few, best, axis=1)
                more = v > iou[d]
                at[d], iou[d] = np.where(more, few, at[d]), np.where(more, v, iou[d])
        place = pa.array(at, mask=at < 0)
        theirs = {"match": "_b"} | {c: f"_{c}" for c in keep}
        return {n: t.column(c).combine_chunks().take(place) for n, c in theirs.items()} | {"iou": pa.array(iou, mask=np.isinf(iou))}

    added = StructType([StructField("match", b.schema[b_idx].dataType), StructField("iou", DoubleType()), *(StructField(c, k) for c, k in zip(keep, kinds, strict=True))])
    return beside(a, b, on, a_key, b_idx, mine, theirs, work, added)


def squared_distance(dims: list[str], other: str = "c_") -> Column:
    return sum(((F.col(d) - F.col(other + d)) * (F.col(d) - F.col(other + d)) for d in dims), F.lit(0.0))


#: Levels of nested cells: the finest are 2**-LEVELS of a batch's extent wide, the coarsest is the whole of it.
LEVELS = 16


def _nested(points: DataFrame, on: list[str], dims: list[str]) -> DataFrame:
    """(on, _lo_*, _wide): the corner and width of each batch's coarsest cell."""
    g = points.groupBy(*on).agg(*(F.min(d).alias(f"_lo_{d}") for d in dims), F.greatest(*(F.max(d) - F.min(d) for d in dims), F.lit(0.0)).alias("_w"))
    return g.withColumn("_wide", F.when(F.col("_w") > 0, F.col("_w") * (1 + 2.0**-20)).otherwise(1.0)).drop("_w")


def _fine(x: Column, d: str) -> Column:
    """Number of the finest cell along a dimension, held within the batch's extent."""
    n = F.floor((x - F.col(f"_lo_{d}")) / F.col("_wide") * (1 << LEVELS))
    return F.greatest(F.least(n, F.lit((1 << LEVELS) - 1)), F.lit(0))


def _coarser(cell: Column) -> Column:
    return F.call_function("shiftright", cell, F.col("_l"))


def _at_levels(points: DataFrame, levels: list[int], cells: list[str]) -> DataFrame:
    d = points.withColumn("_l", F.explode(F.array(*map(F.lit, levels))))
    return d.withColumns({c: _coarser(F.col(c)) for c in cells})


def knn(points: DataFrame, centres: DataFrame, k: int, on: list[str] = ["batch"], dims: list[str] = ["x", "y", "z"], idx: str = "pt_idx", centre_idx: str = "c_idx") -> DataFrame:  # noqa: B006
    """The ``k`` nearest points of each centre: (on, centre_idx, rank from 0, idx, d2); ties go to the lower index. ``centres`` carry
    their coordinates as c_x....

    Points lie in nested cells. A centre first meets the points of the smallest of its cells that holds ``k``: the k-th of them bounds how far the
    nearest can be. Then it meets those of the two or three cells a dimension, about as wide as that bound, which the ball around it
    touches; nothing outside can be nearer, so the result is exact, and no centre meets all points unless they are all about as near.
    Of points at one place only the ``k`` of lowest index can count. Points without a coordinate are nobody's neighbours and
    centres without one have none."""
    if not 0 < k < 100:
        raise ValueError("k must be within 1 to 99")
    whole = lambda d, names: d.where(F.greatest(*(F.isnan(F.coalesce(F.col(n).cast("double"), F.lit(float("nan")))) for n in names)) == F.lit(False))
    cells, key = [f"_c{i}" for i in range(len(dims))], [*on, centre_idx]
    places = Window.partitionBy(*on, *dims).orderBy(idx)
    p = whole(points.select(*on, idx, *dims), dims).withColumn("_r", F.row_number().over(places)).where(F.col("_r") <= k).drop("_r")
    box = _nested(p, on, dims)
    p = p.join(box, on).withColumns({c: _fine(F.col(d), d) for c, d in zip(cells, dims, strict=True)}).select(*on, idx, *dims, *cells)
    c = whole(centres.select(*key, *(f"c_{d}" for d in dims)), [f"c_{d}" for d in dims]).join(box, on)
    own = c.withColumns({x: _fine(F.col(f"c_{d}"), d) for x, d in zip(cells, dims, strict=True)})
    every = list(range(LEVELS + 1))
    full = _at_levels(p.groupBy(*on, *cells).agg(F.count("*").alias("_m")), every, cells).groupBy(*on, "_l", *cells).agg(F.sum("_m").alias("_m")).where(F.col("_m") >= k)
    first = _at_levels(own.select(*key, *cells), every, cells).join(full, [*on, "_l", *cells]).groupBy(*key).agg(F.min("_l").alias("_l"))
    own = own.join(first, key, "left").withColumn("_l", F.coalesce("_l", F.lit(LEVELS)))
    own = written(own.withColumns({x: _coarser(F.col(x)) for x in cells}), "knn")

    def nearest(asking: DataFrame) -> DataFrame:
        used = sorted(r[0] for r in asking.select("_l").distinct().collect())  # LEVELS + 1 at most
        near = asking.join(_at_levels(p, used or [0], cells), [*on, "_l", *cells]).withColumn("d2", squared_distance(dims))
        w = Window.partitionBy(*key).orderBy("d2", idx)
        return near.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k).select(*key, "rank", idx, "d2")

    reach = nearest(own).groupBy(*key).agg(F.sqrt(F.max("d2")).alias("_reach"))
    c = c.join(reach, key).withColumn("_reach", F.col("_reach") * (1 + 1e-9) + F.col("_wide") * 1e-12)
    level = F.ceil(F.log2(F.col("_reach") / F.col("_wide") * (1 << LEVELS)))
    c = c.withColumn("_l", F.greatest(F.least(level, F.lit(LEVELS)), F.lit(0)).cast("int"))
    for x, d in zip(cells, dims, strict=True):
        lo, hi = (_coarser(_fine(F.col(f"c_{d}") + sign * F.col("_reach"), d)) for sign in (-1, 1))
        c = c.withColumn(x, F.explode(F.sequence(lo, hi)))
    return nearest(written(c, "knn"))


def three_nn(points: DataFrame, centres: DataFrame, **kw) -> DataFrame:
    return knn(points, centres, 3, **kw).withColumn("dist", F.sqrt("d2"))


def three_interpolate(points: DataFrame, centres: DataFrame, feature: str, on: list[str] = ["batch"], idx: str = "pt_idx", centre_idx: str = "c_idx", **kw) -> DataFrame:  # noqa: B006
    """Inverse-distance mean of the three nearest points' feature."""
    nn = three_nn(points, centres, on=on, idx=idx, centre_idx=centre_idx, **kw).withColumn("w", 1 / (F.col("dist") + 1e-8))
    j = nn.join(points.select(*on, idx, feature), [*on, idx])
    return j.groupBy(*on, centre_idx).agg((F.sum(F.col("w") * F.col(feature)) / F.sum("w")).alias(feature))


def ball_query(points: DataFrame, centres: DataFrame, min_radius: float, max_radius: float, sample: int, on: list[str] = ["batch"], dims: list[str] = ["x", "y", "z"], idx: str = "pt_idx", centre_idx: str = "c_idx") -> DataFrame:  # noqa: B006
    """The first ``sample`` points by index at distance 0 or within [min, max) of each centre, padded with the first hit
    (0 where nothing is hit): (on, centre_idx, slot, idx)."""
    if min_radius >= max_radius:
        raise ValueError("min_radius must be below max_radius")
    d2 = squared_distance(dims)
    # points lie in cells as wide as the radius: a centre meets those of the cells around it, in as many dimensions as given
    cell = lambda x: F.floor(x / max_radius)
    cells = [f"_cell{k}" for k in range(len(dims))]
    around = centres
    for c, d in zip(cells, dims, strict=True):
        around = around.withColumn(c, F.explode(F.sequence(cell(F.col(f"c_{d}")) - 1, cell(F.col(f"c_{d}")) + 1)))
    near = around.join(points.withColumns({c: cell(F.col(d)) for c, d in zip(cells, dims, strict=True)}), [*on, *cells]).drop(*cells)
    j = near.withColumn("d2", d2).where((F.col("d2") == 0) | ((F.col("d2") >= min_radius**2) & (F.col("d2") < max_radius**2)))
    w = Window.partitionBy(*on, centre_idx).orderBy(idx)
    hits = j.withColumn("slot", F.row_number().over(w) - 1).where(F.col("slot") < sample)
    lists = hits.groupBy(*on, centre_idx).agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", idx))), lambda s: s[idx]).alias("got"))
    full = centres.select(*on, centre_idx).join(lists, [*on, centre_idx], "left")
    return full.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(sample - 1)))).select(*on, centre_idx, "slot", F.coalesce(F.get("got", F.col("slot")), F.get("got", F.lit(0)), F.lit(0).cast("long")).alias(idx))


def gather(features: DataFrame, index: DataFrame, on: list[str] = ["batch"], idx: str = "pt_idx") -> DataFrame:  # noqa: B006
    """Rows of ``features`` by the indices of ``index`` (grouping and gathering of points)."""
    return index.join(features, [*on, idx])


def query_and_group(points: DataFrame, centres: DataFrame, max_radius: float | None, sample: int, min_radius: float = 0, normalise: bool = False, on: list[str] = ["batch"], dims: list[str] = ["x", "y", "z"], idx: str = "pt_idx", centre_idx: str = "c_idx") -> DataFrame:  # noqa: B006
    """Neighbours (by radius, or the nearest if it is None) with coordinates relative to the centre."""
    if max_radius is None:
        near = knn(points, centres, sample, on, dims, idx, centre_idx).withColumnRenamed("rank", "slot").drop("d2")
    else:
        near = ball_query(points, centres, min_radius, max_radius, sample, on, dims, idx, centre_idx)
    j = near.join(points, [*on, idx]).join(centres.select(*on, centre_idx, *(f"c_{d}" for d in dims)), [*on, centre_idx])
    for d in dims:
        rel = F.col(d) - F.col(f"c_{d}")
        j = j.withColumn(d, rel / max_radius if normalise and max_radius else rel)
    return j.drop(*(f"c_{d}" for d in dims))


def in_box3d(cx="bx", cy="by", cz="bz", dx="dx", dy="dy", dz="dz", rz="rz", x="x", y="y", z="z") -> Column:
    """Of a point in a rotated box whose z is its bottom: height inclusive about the middle, sides strict."""
    middle = F.col(cz) + F.col(dz) / 2
    c, s = F.cos(-F.col(rz)), F.sin(-F.col(rz))
    sx, sy = F.col(x) - F.col(cx), F.col(y) - F.col(cy)
    lx, ly = sx * c - sy * s, sx * s + sy * c
    half = lambda v: F.col(v) / 2
    return (F.abs(F.col(z) - middle) <= half(dz)) & (lx > -half(dx)) & (lx < half(dx)) & (ly > -half(dy)) & (ly < half(dy))


def points_in_boxes(points: DataFrame, boxes: DataFrame, on: list[str] = ["batch"], idx: str = "pt_idx", box_idx: str = "box_idx") -> DataFrame:  # noqa: B006
    """Pairs (on, idx, box_idx) of points inside boxes. They meet in cells of the ground plane; a box lies in cells about as wide as itself, of a
    size that is a power of two, so it touches few of them, and points meet boxes of each size that there is."""
    reach = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) / 2
    size = F.ceil(F.log2(F.when(reach > 0, reach * (1 + 1e-9)).otherwise(1e-9))).cast("int")
    b = boxes.withColumn("_reach", reach).withColumn("_size", size).where("_size is not null")
    cell = lambda x: F.floor(x / F.pow(F.lit(2.0), F.col("_size")))
    for c, x in (("_cx", "bx"), ("_cy", "by")):
        b = b.withColumn(c, F.explode(F.sequence(cell(F.col(x) - F.col("_reach")), cell(F.col(x) + F.col("_reach")))))
    sizes = b.select(*on, "_size").distinct()
    p = points.join(sizes, on).withColumns({"_cx": cell(F.col("x")), "_cy": cell(F.col("y"))})
    return p.join(b, [*on, "_size", "_cx", "_cy"]).where(in_box3d()).select(*on, idx, box_idx)


def first_box_of_points(points: DataFrame, boxes: DataFrame, on: list[str] = ["batch"], idx: str = "pt_idx", box_idx: str = "box_idx") -> DataFrame:  # noqa: B006
    """Each point's lowest containing box, or -1."""
    hit = points_in_boxes(points, boxes, on, idx, box_idx).groupBy(*on, idx).agg(F.min(box_idx).alias(box_idx))
    return points.select(*on, idx).join(hit, [*on, idx], "left").withColumn(box_idx, F.coalesce(box_idx, F.lit(-1)))


def in_polygon(px: Column, py: Column, corners: Column) -> Column:
    """Crossing number over an array of x, y alternating; points on the border are on either side."""
    n = F.size(corners) / 2
    k = F.sequence(F.lit(0), (n - 1).cast("int"))

    def crosses(i):
        j = F.when(i == 0, n - 1).otherwise(i - 1).cast("int")
        xi, yi, xj, yj = corners[2 * i], corners[2 * i + 1], corners[2 * j], corners[2 * j + 1]
        return F.when(((yi > py) != (yj > py)) & (px < (xj - xi) * (py - yi) / F.nullif(yj - yi, F.lit(0.0)) + xi), 1).otherwise(0)

    return F.aggregate(k, F.lit(0), lambda s, i: s + crosses(i)) % 2 == 1


def sparse_rulebook(coords: DataFrame, kernel: tuple[int, ...], stride: int = 1, padding: int = 0, dilation: int = 1, shape: tuple[int, ...] | None = None, submanifold: bool = False, dims: list[str] = ["z", "y", "x"], on: str = "batch", idx: str = "idx") -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """(sites, rules) of a sparse convolution: output coordinates, and (kernel offset, input idx, output coordinates) by equality
    of shifted coordinates. ``shape`` bounds the output; submanifold keeps the input's sites."""
    from itertools import product

    offsets = list(product(*(range(k) for k in kernel)))
    table = F.array(*(F.struct(F.lit(n).alias("kernel"), *(F.lit(v).alias(d) for v, d in zip(o, dims, strict=True))) for n, o in enumerate(offsets)))
    r = coords.withColumn("_o", F.explode(table))
    if submanifold:
        for d, k in zip(dims, kernel, strict=True):
            r = r.withColumn(f"out_{d}", F.col(d) + (k // 2) * dilation - F.col(f"_o.{d}") * dilation)
    else:
        for d in dims:
            num = F.col(d) + padding - F.col(f"_o.{d}") * dilation
            r = r.where(F.pmod(num, F.lit(stride)) == 0).withColumn(f"out_{d}", F.floor(num / stride).cast("int")).where(F.col(f"out_{d}") >= 0)
    if shape:
        for d, s in zip(dims, shape, strict=True):
            r = r.where((F.col(f"out_{d}") >= 0) & (F.col(f"out_{d}") < s))
    out = [f"out_{d}" for d in dims]
    rules = r.select(on, F.col("_o.kernel").alias("kernel"), idx, *out)
    sites = coords.select(on, *(F.col(d).alias(f"out_{d}") for d in dims)).distinct() if submanifold else rules.select(on, *out).distinct()
    return sites, rules.join(sites, [on, *out], "left_semi") if submanifold else rules


def as_of_join(left: DataFrame, right: DataFrame, on: list[str], left_ts: str, right_ts: str, tolerance: str | None = None) -> DataFrame:
    """Each left row with the latest right row (struct ``right``) at or before it: one window over the union, so the cost is a
    sort, not a range join. Columns of the right side must not clash on ``on``."""
    keep = [c for c in right.columns if c not in on]
    a = left.select(*on, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*keep).alias("r")).schema["r"].dataType).alias("_r"))
    b = right.select(*on, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), F.struct(*keep).alias("_r"))
    w = Window.partitionBy(*on).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    j = a.union(b).withColumn("right", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    if tolerance:
        j = j.withColumn("right", F.when(F.col(f"right.{right_ts}") >= F.col("_t") - F.expr(f"INTERVAL {tolerance}"), F.col("right")))
    return j.select("_l.*", "right")


# rotated and convex geometry: numeric clipping per pair, in Arrow batches ---------------------------------


def rotated_corners(cx, cy, w, h, a) -> np.ndarray:
    c, s = math.cos(a), math.sin(a)
    d = np.array([[-w, -h], [w, -h], [w, h], [-w, h]]) / 2
    return d @ np.array([[c, s], [-s, c]]) + (cx, cy)


def shoelace(p: np.ndarray) -> float:
    if len(p) < 3:
        return 0.0
    x, y = p[:, 0], p[:, 1]
    return float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2


def convex_clip(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Part of polygon ``p`` inside the counter-clockwise convex polygon ``q``, half-plane by half-plane."""
    out = p
    for k in range(len(q)):
        if not len(out):
            break
        a, b = q[k], q[(k + 1) % len(q)]
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        pts = []
        for i in range(len(out)):
            j = (i + 1) % len(out)
            if side[i] >= 0:
                pts.append(out[i])
            if (side[i] > 0 > side[j]) or (side[i] < 0 < side[j]):
                t = side[i] / (side[i] - side[j])
                pts.append(out[i] + t * (out[j] - out[i]))
        out = np.array(pts) if pts else np.zeros((0, 2))
    return out


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise (monotone chain)."""
    pts = sorted(map(tuple, points.tolist()))
    if len(set(pts)) < 3:
        return np.array(sorted(set(pts)))

    def chain(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def polygon_iou(p: np.ndarray, q: np.ndarray, mode: str = "iou") -> float:
    p = p if shoelace(p) >= 0 else p[::-1]
    q = q if shoelace(q) >= 0 else q[::-1]
    a, b = shoelace(p), shoelace(q)
    inter = abs(shoelace(convex_clip(p, q)))
    union = a if mode == "iof" else a + b - inter
    v = inter / union if union > 0 else 0.0
    if mode == "giou":
        h = abs(shoelace(hull(np.concatenate([p, q]))))
        v -= (h - (a + b - inter)) / h if h > 0 else 0.0
    return v


def corners_of(boxes: np.ndarray) -> np.ndarray:
    """(m, 4, 2): corners, counter-clockwise, of boxes [cx, cy, w, h, angle], all at once."""
    c, s = np.cos(boxes[:, 4]), np.sin(boxes[:, 4])
    w, h = boxes[:, 2, None] / 2 * [-1, 1, 1, -1], boxes[:, 3, None] / 2 * [-1, -1, 1, 1]
    return np.stack([boxes[:, 0, None] + w * c[:, None] - h * s[:, None], boxes[:, 1, None] + w * s[:, None] + h * c[:, None]], axis=2)


def separated(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which pairs of convex polygons (m, 4, 2) have a line between them: along some side's normal their shadows do not meet."""
    out = np.zeros(len(p), bool)
    for r in (p, q):
        side = np.roll(r, -1, axis=1) - r
        normal = np.stack([-side[..., 1], side[..., 0]], axis=2)
        a, b = np.einsum("mkd,msd->mks", p, normal), np.einsum("mkd,msd->mks", q, normal)
        out |= ((a.max(axis=1) < b.min(axis=1)) | (b.max(axis=1) < a.min(axis=1))).any(axis=1)
    return out


def shared_areas(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Areas that pairs of convex polygons (m, 4, 2) share. The shared polygon's corners are corners of one inside the other and points where
    sides cross; in order of their angle about the middle they give the area."""
    m = len(p)
    cross = lambda a, b: a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]
    dp, dq = np.roll(p, -1, axis=1) - p, np.roll(q, -1, axis=1) - q
    scale = 1e-12 * np.maximum(np.abs(dp).max(axis=(1, 2)), np.abs(dq).max(axis=(1, 2)))[:, None] ** 2
    within = lambda x, r, d: (cross(d[:, None], x[:, :, None] - r[:, None]) >= -scale[..., None]).all(axis=2)
    det = cross(dp[:, :, None], dq[:, None])
    gap = q[:, None] - p[:, :, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = cross(gap, dq[:, None]) / det, cross(gap, dp[:, :, None]) / det
        meet = p[:, :, None] + t[..., None] * dp[:, :, None]
    ok = (np.abs(det) > scale[..., None]) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    points = np.concatenate([p, q, np.where(ok[..., None], meet, 0.0).reshape(m, 16, 2)], axis=1)
    valid = np.concatenate([within(p, q, dq), within(q, p, dp), ok.reshape(m, 16)], axis=1)
    n = valid.sum(axis=1)
    middle = (points * valid[..., None]).sum(axis=1) / np.maximum(n, 1)[:, None]
    points = points - middle[:, None]
    order = np.argsort(np.where(valid, np.arctan2(points[..., 1], points[..., 0]), np.inf), axis=1)
    points = np.take_along_axis(points, order[..., None], axis=1)
    points = np.where((np.arange(24) < n[:, None])[..., None], points, points[:, :1])  # the rest repeats the first
    return np.where(n > 2, np.abs(cross(points, np.roll(points, -1, axis=1)).sum(axis=1)) / 2, 0.0)


def rotated_ious(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    p, q = corners_of(a), corners_of(b)
    own, theirs = np.abs(a[:, 2] * a[:, 3]), np.abs(b[:, 2] * b[:, 3])
    near = (own > 0) & (theirs > 0) & ~separated(p, q)
    inter = np.zeros(len(a))
    inter[near] = shared_areas(p[near], q[near])
    union = own + theirs - inter
    return np.where(union > 0, inter / np.where(union > 0, union, 1.0), 0.0)


@F.pandas_udf(DoubleType())
def rotated_iou(a: pd.Series, b: pd.Series) -> pd.Series:
    """IoU of boxes given as arrays [cx, cy, w, h, angle in radians, clockwise in image coordinates], a batch at a time."""
    return pd.Series(rotated_ious(np.stack(a)[:, :5].astype(float), np.stack(b)[:, :5].astype(float)) if len(a) else np.zeros(0))


def packed(points: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The valid ones of each line's points (m, k, 2) moved to its front, the rest repeating the first, and how many they are."""
    n = valid.sum(axis=1)
    order = np.argsort(~valid, axis=1, kind="stable")[:, : max(1, n.max(initial=0))]
    points = np.take_along_axis(points, order[..., None], axis=1)
    return np.where((np.arange(points.shape[1]) < n[:, None])[..., None], points, points[:, :1]), n


def hulls(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Convex hulls of the point sets (m, k, 2), counter-clockwise and packed (monotone chain, a step for all at once)."""
    line = np.arange(len(points))
    points = np.take_along_axis(points, np.lexsort((points[..., 1], points[..., 0]), axis=1)[..., None], axis=1)

    def chain(pts):
        out, n = np.zeros_like(pts), np.zeros(len(pts), int)
        for p in np.moveaxis(pts, 1, 0):
            at = line
            while len(at):
                at = at[n[at] > 1]
                a, b = out[at, n[at] - 2], out[at, n[at] - 1]
                turn = (b[:, 0] - a[:, 0]) * (p[at, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (p[at, 0] - a[:, 0])
                at = at[turn <= 0]
                n[at] -= 1
            out[line, n] = p
            n += 1
        return out, np.arange(out.shape[1]) < n[:, None] - 1

    (low, a), (high, b) = chain(points), chain(points[:, ::-1])
    return packed(np.concatenate([low, high], axis=1), np.concatenate([a, b], axis=1))


def shoelaces(p: np.ndarray) -> np.ndarray:
    q = np.roll(p, -1, axis=1)
    return (p[..., 0] * q[..., 1] - p[..., 1] * q[..., 0]).sum(axis=1) / 2


def convex_clips(p: np.ndarray, n: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``convex_clip`` of the packed polygons ``p`` by the polygons ``q`` (m, k, 2), one half-plane of all pairs after the other."""
    for k in range(q.shape[1]):
        a, b = q[:, None, k], q[:, None, (k + 1) % q.shape[1]]
        side = (b[..., 0] - a[..., 0]) * (p[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (p[..., 0] - a[..., 0])
        to, other = np.roll(p, -1, axis=1), np.roll(side, -1, axis=1)  # what follows the last corner repeats the first, as the rest does
        real = np.arange(p.shape[1]) < n[:, None]
        cut = real & (((side > 0) & (other < 0)) | ((side < 0) & (other > 0)))
        t = side / np.where(cut, side - other, 1.0)
        points = np.stack([p, p + t[..., None] * (to - p)], axis=2).reshape(len(p), -1, 2)
        p, n = packed(points, np.stack([real & (side >= 0), cut], axis=2).reshape(len(p), -1))
    return np.where((n > 2)[:, None, None], p, 0.0)


def convex_ious(points: np.ndarray, q: np.ndarray, mode: str = "iou") -> np.ndarray:
    """IoU or GIoU of the hulls of point sets (m, k, 2) and convex polygons (m, j, 2), all at once."""
    p, n = hulls(points)
    q = np.where((shoelaces(q) >= 0)[:, None, None], q, q[:, ::-1])
    a, b = shoelaces(p), shoelaces(q)
    inter = np.abs(shoelaces(convex_clips(p, n, q)))
    union = a + b - inter
    v = np.where(union > 0, inter / np.where(union > 0, union, 1.0), 0.0)
    if mode == "giou":
        h = np.abs(shoelaces(hulls(np.concatenate([p, q], axis=1))[0]))
        v = v - np.where(h > 0, (h - union) / np.where(h > 0, h, 1.0), 0.0)
    return v


def _convex(points: pd.Series, polygon: pd.Series, mode: str) -> pd.Series:
    """Pairs of equal numbers of corners go together."""
    out = np.zeros(len(points))
    sizes = np.array([(len(x), len(y)) for x, y in zip(points, polygon, strict=True)], int).reshape(-1, 2)
    for k, j in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes == (k, j)).all(axis=1))
        if k and j:
            flat = lambda s: np.stack(s.to_numpy()[at]).astype(float).reshape(len(at), -1, 2)  # noqa: B023, E731
            out[at] = convex_ious(flat(points), flat(polygon), mode)
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def convex_giou(points: pd.Series, polygon: pd.Series) -> pd.Series:
    """GIoU of the convex hull of a point set and a polygon, both as arrays of x, y alternating."""
    return _convex(points, polygon, "giou")


@F.pandas_udf(DoubleType())
def convex_iou(points: pd.Series, polygon: pd.Series) -> pd.Series:
    return _convex(points, polygon, "iou")


@F.pandas_udf(ArrayType(DoubleType()))
def min_area_polygon(points: pd.Series) -> pd.Series:
    """Corners of the least-area rectangle around a point set: one side lies on a side of the hull."""

    def one(flat):
        p = hull(np.reshape(np.array(flat, float), (-1, 2)))
        best = None
        for k in range(len(p)):
            d = p[(k + 1) % len(p)] - p[k]
            n = np.hypot(*d)
            if n == 0:
                continue
            u = d / n
            rot = np.array([u, [-u[1], u[0]]])
            q = p @ rot.T
            lo, hi = q.min(0), q.max(0)
            area = float(np.prod(hi - lo))
            if best is None or area < best[0]:
                best = area, np.array([[lo[0], lo[1]], [hi[0], lo[1]], [hi[0], hi[1]], [lo[0], hi[1]]]) @ rot
        return (np.tile(p[0], 4) if best is None else best[1].ravel()).tolist()

    return pd.Series([one(x) for x in points])


def rotated_overlap_join(a: DataFrame, b: DataFrame, on: list[str], box: str = "rbox", other: str = "rbox_b", least: float = 0.0, cell: float | None = None) -> DataFrame:
    """Rotated-box pairs with equal ``on``. Circles around the boxes are compared first, as a plain column predicate, and boxes with a line
    between them next, so few pairs are clipped, a batch of pairs at a time. With ``cell``, boxes meet in the grid cells that their circles
    touch, which bounds the pairs of an image with very many; pairs whose circles do not touch are then absent, as is an overlap of 0 there."""
    reachable(a.sparkSession)
    p, q = F.col(box), F.col(other)
    radius = lambda r: F.sqrt(r[2] * r[2] + r[3] * r[3]) / 2
    keys = list(on)
    if cell:
        low = lambda r, k: F.floor((r[k] - radius(r)) / cell)
        spread = lambda d, r: d.withColumn("_cx", F.explode(F.sequence(low(r, 0), F.floor((r[0] + radius(r)) / cell)))).withColumn("_cy", F.explode(F.sequence(low(r, 1), F.floor((r[1] + radius(r)) / cell))))
        a, b, keys = spread(a, p), spread(b, q), [*keys, "_cx", "_cy"]
    j = a.join(b, keys)
    if cell:  # once, in the cell of the later of their first cells
        j = j.where((F.col("_cx") == F.greatest(low(p, 0), low(q, 0))) & (F.col("_cy") == F.greatest(low(p, 1), low(q, 1)))).drop("_cx", "_cy")
    reach = radius(p) + radius(q)
    near = (p[0] - q[0]) * (p[0] - q[0]) + (p[1] - q[1]) * (p[1] - q[1]) <= reach * reach
    small, large = (f(F.abs(p[2] * p[3]), F.abs(q[2] * q[3])) for f in (F.least, F.greatest))
    near &= small >= large * least * (1 - 1e-9)  # the smaller area over the larger bounds the overlap
    return j.where(near).withColumn("iou", rotated_iou(box, other)).where(F.col("iou") >= least)
