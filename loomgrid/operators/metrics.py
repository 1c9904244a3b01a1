"""Evaluation metrics as ordinary queries: average precision, recall, panoptic quality, accuracy, judge scores.

Detections and truths are tidy tables det(image_id, class_id, det_idx, x1..y2, score) and gt(image_id, class_id, gt_idx,
x1..y2, is_ignore[, is_group_of]). Matching is a join on (image, class); ranking over a class is a window partitioned by
(class, scale, threshold). Score ties go to the lower image and detection index.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions import boxes as B
from loomgrid.operators.grouped import PAIRS, corners, overlaps, whole_groups
from loomgrid.operators.numbering import carried, numbered, ranges, written
from loomgrid.operators.spatial import best_match
from loomgrid.session import reachable

#: Smallest divisor of precision and recall (the single-precision machine epsilon).
EPS32 = 1.1920928955078125e-07


def tpfp_default(det: DataFrame, gt: DataFrame, iou_thr: float = 0.5, extra: float = 0, area: tuple[float, float] | None = None) -> DataFrame:
    """det with ``tp`` and ``fp`` (0/1). A detection looks only at its best truth: the first by score to claim it is a true positive,
    later ones are false. On an ignored truth, or one outside the area range [min, max), it is neither; an unmatched
    detection outside the range is neither."""
    out_of = lambda a: F.lit(False) if area is None else (a < area[0]) | (a >= area[1])
    g = gt.withColumn("_skip", F.col("is_ignore") | out_of(B.area(B.box(), extra)))
    m = best_match(det, g, ["image_id", "class_id"], ["det_idx"], "gt_idx", extra=extra, keep=("_skip",))
    hit = F.coalesce(F.col("iou") >= iou_thr, F.lit(False))
    w = Window.partitionBy("image_id", "class_id", "match", "_hit").orderBy(F.desc("score"), "det_idx")
    m = m.withColumn("_hit", hit).withColumn("_first", F.row_number().over(w) == 1)
    use = F.col("_hit") & ~F.coalesce("_skip", F.lit(False))
    tp = F.when(use & F.col("_first"), 1).otherwise(0)
    fp = F.when(use & ~F.col("_first"), 1).when(~F.col("_hit") & ~out_of(B.area(B.box(), extra)), 1).otherwise(0)
    return m.select(*det.columns, "match", "iou", tp.alias("tp"), fp.alias("fp"))


def tpfp_greedy(det: DataFrame, gt: DataFrame, default_thr: float = 0.5) -> DataFrame:
    """The greedy protocol: by falling score, each detection takes the best truth not yet taken whose overlap reaches that truth's own
    threshold min(w*h / ((w+10)*(h+10)), default); truths are moved by -1 first. Sequential in an (image, class),
    a step taken for all groups of a batch at once. Groups without detections give no row."""

    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        box, side, skip, found = corners(t), t.column("side").to_numpy(), t.column("skip").to_numpy(), []
        n = np.add.reduceat((side == 0).astype(int), starts)
        m = np.diff(np.append(starts, len(t))) - n
        for a, b in np.unique(np.stack([n, m], axis=1)[n > 0], axis=0):
            at = starts[(n == a) & (m == b)][:, None]
            for lo in np.array_split(at, -(-len(at) * int(b + 1) // PAIRS)):
                d, g = lo + np.arange(a), lo + a + np.arange(b)
                o = box[g] - 1
                w, h = o[..., 2] - o[..., 0], o[..., 3] - o[..., 1]
                thr, free, line = np.minimum(w * h / ((w + 10) * (h + 10)), default_thr), np.ones(g.shape, bool), np.arange(len(d))
                for i in range(a if b else 0):
                    v = overlaps(box[d[:, i]][:, None], o)[:, 0]
                    v = np.where(free & (v >= thr), v, -1.0)
                    best = v.argmax(axis=1)
                    hit = v[line, best] >= 0
                    free[line[hit], best[hit]] = False
                    found.append((d[:, i], hit & ~skip[g[line, best]], ~hit))
                if not b:
                    found.append((d.ravel(), np.zeros(d.size, bool), np.ones(d.size, bool)))
        at, tp, fp = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, bool), np.zeros(0, bool))
        own = {c: t.column(c).take(pa.array(at)) for c in ("image_id", "class_id", "det_idx", "score")}
        return pa.table({**own, "tp": pa.array(tp.astype(np.int32)), "fp": pa.array(fp.astype(np.int32))})

    kinds = dict(det.dtypes)
    ddl = f"image_id {kinds['image_id']}, class_id {kinds['class_id']}, det_idx {kinds['det_idx']}, score double, tp int, fp int"
    four = [F.col(c).cast("double").alias(c) for c in B.Box._fields]
    d = det.select("image_id", "class_id", "det_idx", F.col("score").cast("double").alias("score"), *four, F.lit(0).alias("side"), F.lit(False).alias("skip"))
    g = gt.select("image_id", "class_id", F.col("gt_idx").alias("det_idx"), F.lit(None).cast("double").alias("score"), *four, F.lit(1).alias("side"), F.coalesce("is_ignore", F.lit(False)).alias("skip"))
    return whole_groups(d.union(g), ["image_id", "class_id"], ["side", F.desc("score"), "det_idx"], run, ddl)


def tpfp_group_of(det: DataFrame, gt: DataFrame, iou_thr: float = 0.5, ioa_thr: float = 0.5, extra: float = 0) -> DataFrame:
    """(image_id, class_id, det_idx, score, tp, fp) with group truths: stage one matches single truths; what fails is compared with the
    group boxes by intersection over the detection. A matched group box gives one true positive with its best
    score; an unmatched one a false positive with score 0 (det_idx null)."""
    single, groups = gt.where("not is_group_of"), gt.where("is_group_of")
    first = tpfp_default(det, single, iou_thr, extra)
    lost = first.where("fp = 1").drop("match", "iou", "tp", "fp")
    m = best_match(lost, groups, ["image_id", "class_id"], ["det_idx"], "gt_idx", "iof", extra)
    into = m.where(F.col("iou") >= ioa_thr)
    per = into.groupBy("image_id", "class_id", F.col("match").alias("gt_idx")).agg(F.max("score").alias("score"))
    g = groups.join(per, ["image_id", "class_id", "gt_idx"], "left")
    g = g.where(~F.col("is_ignore") | F.col("score").isNotNull())
    rows = g.select("image_id", "class_id", F.lit(None).cast(dict(det.dtypes)["det_idx"]).alias("det_idx"), F.coalesce("score", F.lit(0.0)).alias("score"), F.when(F.col("score").isNotNull() & ~F.col("is_ignore"), 1).otherwise(0).alias("tp"), F.when(F.col("score").isNull(), 1).otherwise(0).alias("fp"))
    rest = first.join(into.select("image_id", "class_id", "det_idx"), ["image_id", "class_id", "det_idx"], "left_anti")
    return rest.select("image_id", "class_id", "det_idx", F.col("score").cast("double").alias("score"), "tp", "fp").unionByName(rows)


def gt_counts(gt: DataFrame, area: tuple[float, float] | None = None, extra: float = 0) -> DataFrame:
    a = B.area(B.box(), extra)
    inside = F.lit(True) if area is None else (a >= area[0]) & (a < area[1])
    return gt.groupBy("class_id").agg(F.count(F.when(~F.col("is_ignore") & inside, 1)).alias("num_gts"))


def precision_recall(tpfp: DataFrame, counts: DataFrame, by: tuple[str, ...] = ("class_id",)) -> DataFrame:
    """Running precision and recall along falling score, position ``pos``. Classes are dealt out by ranges of (class, score) whose ends are
    sampled, so crowded scores spread evenly and no class is sorted in one task; a range's running sums (``slot`` is its number, scores fall as it
    rises) start from the totals of its class in the ranges before."""
    t = ranges(written(tpfp, "matches"), [*by, F.desc("score"), "image_id", "det_idx"])  # written: sampling the ends reads the rows once more
    t = carried(t, by, _tp=("sum", "tp"), _fp=("sum", "fp")).withColumnRenamed("_p", "slot")
    t = t.join(counts, list(by), "left")
    run = Window.partitionBy(*by, "slot").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("ctp", F.coalesce("_tp", F.lit(0)) + F.sum("tp").over(run)).withColumn("cfp", F.coalesce("_fp", F.lit(0)) + F.sum("fp").over(run)).withColumn("pos", F.col("_row") + 1)
    n = F.greatest(F.coalesce("num_gts", F.lit(0)).cast("double"), F.lit(EPS32))
    t = t.withColumn("recall", F.col("ctp") / n).withColumn("before", (F.col("ctp") - F.col("tp")) / n).drop("_tp", "_fp", "_row", "_rows", "_i")
    return t.withColumn("precision", F.col("ctp") / F.greatest((F.col("ctp") + F.col("cfp")).cast("double"), F.lit(EPS32)))


def envelope(pr: DataFrame, by: tuple[str, ...] = ("class_id",)) -> DataFrame:
    """Adds ``env``, the highest precision at this or a lower score: a running maximum from the lowest score up, range by range."""
    below = Window.partitionBy(*by).orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    best = pr.groupBy(*by, "slot").agg(F.max("precision").alias("_best")).select(*by, "slot", F.coalesce(F.max("_best").over(below), F.lit(0.0)).alias("_after"))
    run = Window.partitionBy(*by, "slot").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    return pr.join(best, [*by, "slot"]).withColumn("env", F.greatest(F.max("precision").over(run), F.col("_after"))).drop("_after")


def average_precision(pr: DataFrame, by: tuple[str, ...] = ("class_id",), mode: str = "area") -> DataFrame:
    """(by, num_dets, recall, ap): the area under the precision envelope, or the mean of 11 interpolated points."""
    counted = [F.count("*").alias("num_dets"), F.max("recall").alias("recall")]
    if mode == "area":
        return envelope(pr, by).groupBy(*by).agg(*counted, F.sum((F.col("recall") - F.col("before")) * F.col("env")).alias("ap"))
    if mode != "11points":
        raise ValueError(mode)
    best = [F.coalesce(F.max(F.when(F.col("recall") >= k / 10, F.col("precision"))), F.lit(0.0)) for k in range(11)]
    total = best[0]
    for b in best[1:]:
        total = total + b
    return pr.groupBy(*by).agg(*counted, (total / 11).alias("ap"))


TPFP = {"default": tpfp_default, "greedy": tpfp_greedy, "group_of": tpfp_group_of}


def eval_map(det: DataFrame, gt: DataFrame, iou_thr: float = 0.5, mode: str = "area", extra: float = 0, area: tuple[float, float] | None = None, strategy: str = "default", **kw) -> DataFrame:
    """(class_id, num_gts, num_dets, recall, ap) per class with truths or detections. The matching protocol is chosen by name."""
    t = tpfp_default(det, gt, iou_thr, extra, area) if strategy == "default" else TPFP[strategy](det, gt, **kw)
    counts = gt_counts(gt, area, extra)
    pr = precision_recall(t.select("image_id", "class_id", "det_idx", "score", "tp", "fp"), counts)
    out = counts.join(average_precision(pr, mode=mode), "class_id", "full")
    return out.select("class_id", F.coalesce("num_gts", F.lit(0)).alias("num_gts"), F.coalesce("num_dets", F.lit(0)).alias("num_dets"), F.coalesce("recall", F.lit(0.0)).alias("recall"), F.coalesce("ap", F.lit(0.0)).alias("ap"))


def mean_ap(per_class: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean over classes with truths; 0 if there is none."""
    return per_class.groupBy(*(by or [])).agg(F.coalesce(F.avg(F.when(F.col("num_gts") > 0, F.col("ap"))), F.lit(0.0)).alias("map"))


def eval_map_scales(det: DataFrame, gt: DataFrame, scales: list[tuple[float, float]], **kw) -> DataFrame:
    """eval_map per scale range (side lengths, squared for areas), column ``scale``."""
    out = None
    for k, (lo, hi) in enumerate(scales):
        one = eval_map(det, gt, area=(lo**2, hi**2), **kw).withColumn("scale", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


AREAS = {"all": (0.0, 1e10), "small": (0.0, 1024.0), "medium": (1024.0, 9216.0), "large": (9216.0, 1e10)}


def coco_ap(det: DataFrame, gt: DataFrame, thresholds: list[float] | None = None, max_dets: int = 100, area: tuple[float, float] | None = None) -> DataFrame:
    """(iou_thr, class_id, num_gts, ap, recall): 101-point interpolated precision at each threshold."""
    return coco_curves(det, gt, [("all", *(area or AREAS["all"]), max_dets)], thresholds).drop("setting")


def coco_curves(det: DataFrame, gt: DataFrame, settings: list[tuple[str, float, float, int]], thresholds: list[float] | None = None) -> DataFrame:
    """coco_ap for several settings (name, least and most area, detections per image and class) at once, column ``setting``.

    The best match and the order of a truth's claims happen once: a detection is the first to claim its truth at the thresholds
    above the best overlap of the claims before it, up to its own. There is never a row per setting and threshold."""
    thresholds = thresholds or [round(0.5 + 0.05 * k, 2) for k in range(10)]
    best = Window.partitionBy("image_id", "class_id").orderBy(F.desc("score"), "det_idx")
    top = det.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= max(k for *_, k in settings))
    g = gt.withColumn("_area", B.area(B.box()).cast("double"))
    m = best_match(top.select("image_id", "class_id", "det_idx", "score", *B.Box._fields, "_r"), g, ["image_id", "class_id"], ["det_idx"], "gt_idx", keep=("is_ignore", "_area"))
    claims = Window.partitionBy("image_id", "class_id", "match").orderBy(F.desc("score"), "det_idx").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("_earlier", F.coalesce(F.max("iou").over(claims), F.lit(-1.0)))
    m = m.select("class_id", "score", "image_id", "det_idx", "_r", "iou", "_earlier", F.coalesce("is_ignore", F.lit(False)).alias("_ignore"), "_area", B.area(B.box()).cast("double").alias("_own"), F.col("match").isNotNull().alias("_met"))
    inside = lambda lo, hi: ~F.col("is_ignore") & (F.col("_area") >= lo) & (F.col("_area") < hi)
    counts = g.groupBy("class_id").agg(*(F.count(F.when(inside(lo, hi), 1)).alias(f"n{s}") for s, (_, lo, hi, _) in enumerate(settings)))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("setting"), F.lit(s).alias("s"), F.col(f"n{s}").alias("num_gts")) for s, (n, *_) in enumerate(settings))))
    levels = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(v)).alias("iou_thr")) for k, v in enumerate(thresholds))))
    counts = counts.select("class_id", each.alias("e")).select("class_id", "e.*", levels.alias("l")).select("class_id", "setting", "l.iou_thr", "num_gts", (F.col("s") * len(thresholds) + F.col("l.k")).alias("_curve"))
    found = sampled_precision(m, counts, ["class_id", F.desc("score"), "image_id", "det_idx"], lambda t: claimed(t, settings, thresholds))
    return counts.join(found, ["class_id", "_curve"], "left").select("setting", "iou_thr", "class_id", "num_gts", F.coalesce("ap", F.lit(0.0)).alias("ap"), F.coalesce("recall", F.lit(0.0)).alias("recall"))


def claimed(t: pa.Table, settings: list[tuple[str, float, float, int]], thresholds: list[float]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(curve, tp, fp) of a table's detections under each setting and threshold, one at a time; detections a setting leaves out are neither."""
    r, iou, earlier, area, own = (t.column(c).to_numpy() for c in ("_r", "iou", "_earlier", "_area", "_own"))
    ignored, met = (t.column(c).to_numpy() for c in ("_ignore", "_met"))
    for s, (_, lo, hi, k) in enumerate(settings):
        there = r <= k
        count = there & ~(ignored | (met & ~((area >= lo) & (area < hi))))
        loose = there & (own >= lo) & (own < hi)
        for i, thr in enumerate(thresholds):
            hit, first = iou >= thr, earlier < thr
            use = hit & count
            yield s * len(thresholds) + i, use & first, (use & ~first) | (loose & ~hit)


#: Rows of a range of a class's order: what a task holds of it at once.
STRETCH = 1 << 18


def sampled_precision(rows: DataFrame, counts: DataFrame, order: list[Column | str], marks: Callable[[pa.Table], Iterator[tuple[int, np.ndarray, np.ndarray]]]) -> DataFrame:
    """(class_id, _curve, ap, recall): the mean over recalls 0, .01, ..., 1 of the highest precision at that recall or more, for many curves over one order of
    the rows. ``marks`` gives each curve's true and false positives; ``counts`` (class_id, _curve, num_gts) its truths.

    Rows are dealt out by ranges of the order once, however many curves there are. A range first gives its totals; from those of the ranges
    before it, it then gives its highest precision, and the highest from each recall on that it is the first to reach."""
    rows = written(rows, "matches")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = ranges(rows, order, max(n, -(-rows.count() // STRETCH)))
    kind = dict(t.dtypes)["class_id"]
    key = ["class_id", "_p"]

    def sums(t: pa.Table, starts: np.ndarray) -> pa.Table:
        size = np.diff(np.append(starts, len(t)))
        got = [(k, np.add.reduceat(tp.astype(np.int64), starts), np.add.reduceat(fp.astype(np.int64), starts)) for k, tp, fp in marks(t)]
        own = {c: pa.chunked_array([t.column(c).combine_chunks().take(pa.array(np.tile(starts, len(got))))]) for c in key}
        return pa.table({**own, "_curve": np.repeat(np.array([k for k, *_ in got], np.int32), len(starts)), "n": np.tile(size, len(got)), "tp": np.concatenate([x for _, x, _ in got]), "fp": np.concatenate([x for *_, x in got])})

    totals = written(whole_groups(t, key, ["_i"], sums, f"class_id {kind}, _p int, _curve int, n long, tp long, fp long"), "totals").where("class_id is not null")
    curve = Window.partitionBy("class_id", "_curve")
    up = curve.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    begun = totals.select(*key, "_curve", *(F.coalesce(F.sum(c).over(up), F.lit(0)).alias(c) for c in ("n", "tp", "fp"))).join(counts.select("class_id", "_curve", "num_gts"), ["class_id", "_curve"])
    begun = begun.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*(F.col(c).cast("long").alias(c) for c in ("_curve", "n", "tp", "fp", "num_gts"))))).alias("b"))
    kept = [f for f in t.schema.fields if f.name not in key]
    first = begun.select(*key, *(F.lit(-1).cast("long").alias("_i") if f.name == "_i" else F.lit(None).cast(f.dataType).alias(f.name) for f in kept), *(F.col("b")[c].alias(f"b{c}") for c in ("_curve", "n", "tp", "fp", "num_gts")))
    both = t.where("class_id is not null").select(*key, *(f.name for f in kept), *(F.array().cast("array<bigint>").alias(f"b{c}") for c in ("_curve", "n", "tp", "fp", "num_gts"))).union(first)

    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        out = []
        for lo, hi in zip(starts, np.append(starts[1:], len(t)), strict=True):
            head = {c: np.array(t.column(f"b{c}")[int(lo)].as_py() or [], np.int64) for c in ("_curve", "n", "tp", "fp", "num_gts")}
            at = {int(k): i for i, k in enumerate(head["_curve"])}
            if not at:  # a class without truths has no curve
                continue
            for k, tp, fp in marks(t.slice(lo + 1, hi - lo - 1)):
                n, seen, wrong, truths = (int(head[c][at[k]]) for c in ("n", "tp", "fp", "num_gts"))
                tp, fp = seen + np.cumsum(tp), wrong + np.cumsum(fp)
                truths = max(float(truths), EPS32)
                level = np.floor(tp / truths * 100 + 1e-9)
                high = np.maximum.accumulate((tp / np.maximum(tp + fp, EPS32))[::-1])[::-1]
                since = int(np.floor(seen / truths * 100 + 1e-9)) if n else -1
                points = np.arange(since + 1, int(min(level[-1], 100)) + 1)
                best = high[np.searchsorted(level, points)]
                out.append((lo, k, np.append(points, -1), np.append(best, high[0]), tp[-1] / truths))
        size = [len(p) for _, _, p, _, _ in out]
        own = {c: t.column(c).combine_chunks().take(pa.array(np.repeat(np.array([x[0] for x in out], np.int64), size))) for c in key}
        cat = lambda i, kind: np.concatenate([x[i] for x in out]).astype(kind) if out else np.zeros(0, kind)
        each = lambda i, kind: np.repeat(np.array([x[i] for x in out], kind), size)
        return pa.table({**own, "_curve": each(1, np.int32), "point": cat(2, np.int32), "best": cat(3, float), "recall": each(4, float)})

    got = whole_groups(both, key, ["_i"], run, f"class_id {kind}, _p int, _curve int, point int, best double, recall double", STRETCH)
    got = written(got, "points")
    down = curve.orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)
    later = got.where("point = -1").select(*key, "_curve", F.coalesce(F.max("best").over(down), F.lit(0.0)).alias("_later"))
    ap = got.join(later, [*key, "_curve"]).groupBy("class_id", "_curve")
    return ap.agg((F.coalesce(F.sum(F.when(F.col("point") >= 0, F.greatest("best", "_later"))), F.lit(0.0)) / 101).alias("ap"), F.max("recall").alias("recall"))


def coco_summary(det: DataFrame, gt: DataFrame) -> DataFrame:
    """(metric, value) of the twelve usual figures, rounded to 3 places; -1 where no truth exists."""
    settings = [(name, lo, hi, 100) for name, (lo, hi) in AREAS.items()] + [(f"first_{k}", *AREAS["all"], k) for k in (1, 10)]
    mean = lambda c, *which: F.avg(F.when(which[0], F.col(c)) if which else F.col(c))
    per = coco_curves(det, gt, settings).where("num_gts > 0")
    one = per.groupBy("setting").agg(mean("ap").alias("ap"), mean("recall").alias("ar"), mean("ap", F.col("iou_thr") == 0.5).alias("ap50"), mean("ap", F.col("iou_thr") == 0.75).alias("ap75"))
    names = [("all", "AP", "ap"), ("all", "AR_100", "ar"), ("all", "AP50", "ap50"), ("all", "AP75", "ap75"), ("first_1", "AR_1", "ar"), ("first_10", "AR_10", "ar")]
    names += [(a, f"{m}_{a}", c) for a in AREAS if a != "all" for m, c in (("AP", "ap"), ("AR", "ar"))]
    # one row of at most six settings turned into one row of figures
    wide = one.agg(*(F.max(F.when(F.col("setting") == s, F.col(c))).alias(m) for s, m, c in names))
    rows = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.round(F.coalesce(F.col(m), F.lit(-1.0)), 3).alias("value")) for _, m, _ in names)))
    return wide.select(rows.alias("r")).select("r.*")


def frequency_groups(gt: DataFrame, rare: int = 10, common: int = 100) -> DataFrame:
    """(class_id, freq): r, c or f by the number of images with the class."""
    n = gt.groupBy("class_id").agg(F.count_distinct("image_id").alias("n"))
    return n.select("class_id", F.when(F.col("n") <= rare, "r").when(F.col("n") <= common, "c").otherwise("f").alias("freq"))


def ap_by_frequency(per_class: DataFrame, groups: DataFrame) -> DataFrame:
    """Mean AP over all, and by frequency group, as grouping sets in one pass."""
    j = per_class.where("num_gts > 0").join(groups, "class_id")
    return j.rollup("freq").agg(F.avg("ap").alias("ap")).select(F.coalesce("freq", F.lit("all")).alias("freq"), "ap")


def recalls(gt: DataFrame, proposals: DataFrame, limits: list[int] = [100, 300, 1000], thresholds: list[float] = [0.5]) -> DataFrame:  # noqa: B006
    """(n, iou_thr, recall): of an image's best ``n`` proposals by score, the largest (truth, proposal) overlap is taken and both removed, again
    and again; recall is the share of all truths whose overlap reaches the threshold. Sequential in an image."""
    reachable(gt.sparkSession)
    most = max(limits)
    w = Window.partitionBy("image_id").orderBy(F.desc("score"), "det_idx")
    top = proposals.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    fields = list(B.Box._fields)

    def run(g: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("_r")
        a, b = g.sort_values("gt_idx")[fields].to_numpy(float), p[fields].to_numpy(float)
        rows = []
        if len(a):
            iw = np.maximum(0, np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])) if len(b) else np.zeros((len(a), 0))
            ih = np.maximum(0, np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])) if len(b) else iw
            size = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
            full = iw * ih / np.maximum(size(a)[:, None] + size(b)[None, :] - iw * ih, 1e-6)
            for n in limits:
                v = full[:, :n].copy()
                for _ in range(len(a)):
                    if not v.size or v.max() < 0:
                        rows.append((n, 0.0))
                        continue
                    i, j = np.unravel_index(v.argmax(), v.shape)
                    rows.append((n, float(v[i, j])))
                    v[i, :], v[:, j] = -1, -1
        return pd.DataFrame(rows, columns=["n", "iou"])

    got = gt.select("image_id", "gt_idx", *fields).groupBy("image_id").cogroup(top.select("image_id", "_r", *fields).groupBy("image_id")).applyInPandas(run, "n int, iou double")
    t = got.withColumn("iou_thr", F.explode(F.array(*map(F.lit, thresholds))))
    return t.groupBy("n", "iou_thr").agg(F.avg(F.when(F.col("iou") >= F.col("iou_thr"), 1.0).otherwise(0.0)).alias("recall"))


def average_recall(r: DataFrame) -> DataFrame:
    return r.groupBy("n").agg(F.avg("recall").alias("ar"))


def hierarchy_closure(edges: DataFrame, depth: int = 16) -> DataFrame:
    """(class_id, ancestor), each class its own ancestor, of edges (parent, child). The class tree is a dimension of some hundred rows;
    paths double in length each step, so a tree of depth 16 takes four joins."""
    pairs = edges.select(F.col("child").alias("class_id"), F.col("parent").alias("ancestor"))
    own = edges.select(F.explode(F.array("parent", "child")).alias("class_id")).distinct().withColumn("ancestor", F.col("class_id"))
    reach, steps = pairs.union(own).distinct(), 1
    while steps < depth:
        more = reach.alias("a").join(reach.alias("b"), F.col("a.ancestor") == F.col("b.class_id")).select("a.class_id", "b.ancestor")
        reach, steps = more.distinct(), steps * 2
    return reach


def expand_gt(gt: DataFrame, closure: DataFrame) -> DataFrame:
    """One row per truth and ancestor."""
    return gt.join(F.broadcast(closure), "class_id").withColumn("class_id", F.col("ancestor")).drop("ancestor")


def expand_det(det: DataFrame, closure: DataFrame, allowed: DataFrame) -> DataFrame:
    """Detections under every ancestor, only for classes annotated on their image (``allowed``: image_id, class_id)."""
    return det.join(F.broadcast(closure), "class_id").withColumn("class_id", F.col("ancestor")).drop("ancestor").join(allowed, ["image_id", "class_id"], "left_semi")


# panoptic quality --------------------------------------------------------------------------------------


def panoptic_stats(pixels: DataFrame, gt_segments: DataFrame, pred_segments: DataFrame, void: int = 0) -> DataFrame:
    """(category_id, iou, tp, fp, fn) from pixel rows (image_id, gt_id, pred_id[, n]) and segments (image_id, id, category_id[, iscrowd]).

    A true positive is a pair of one class with IoU over 0.5, void pixels of the prediction not counted in the union; a predicted segment
    more than half void or crowd of its class is no false positive; crowd truths are no misses."""
    n = F.col("n") if "n" in pixels.columns else F.lit(1)
    c = pixels.groupBy("image_id", "gt_id", "pred_id").agg(F.sum(n).alias("n"))
    gt_area, pr_area = c.groupBy("image_id", "gt_id").agg(F.sum("n").alias("gt_area")), c.groupBy("image_id", "pred_id").agg(F.sum("n").alias("pred_area"))
    in_void = c.where(F.col("gt_id") == void).select("image_id", "pred_id", F.col("n").alias("void_n"))
    g = gt_segments.select("image_id", F.col("id").alias("gt_id"), F.col("category_id").alias("gt_cat"), F.col("iscrowd") if "iscrowd" in gt_segments.columns else F.lit(False).alias("iscrowd"))
    p = pred_segments.select("image_id", F.col("id").alias("pred_id"), F.col("category_id").alias("pred_cat"))
    j = c.join(g, ["image_id", "gt_id"]).join(p, ["image_id", "pred_id"]).join(gt_area, ["image_id", "gt_id"]).join(pr_area, ["image_id", "pred_id"]).join(in_void, ["image_id", "pred_id"], "left")
    union = F.col("pred_area") + F.col("gt_area") - F.col("n") - F.coalesce("void_n", F.lit(0))
    j = j.withColumn("iou", F.col("n") / union)
    tp = j.where(~F.col("iscrowd") & (F.col("gt_cat") == F.col("pred_cat")) & (F.col("iou") > 0.5)).select("image_id", "gt_id", "pred_id", F.col("gt_cat").alias("category_id"), "iou")
    fn = g.where(~F.col("iscrowd")).join(tp, ["image_id", "gt_id"], "left_anti").select(F.col("gt_cat").alias("category_id"))
    crowd = j.where(F.col("iscrowd") & (F.col("gt_cat") == F.col("pred_cat"))).groupBy("image_id", "pred_id").agg(F.sum("n").alias("crowd_n"))
    loose = p.join(tp, ["image_id", "pred_id"], "left_anti").join(pr_area, ["image_id", "pred_id"], "left").join(in_void, ["image_id", "pred_id"], "left").join(crowd, ["image_id", "pred_id"], "left")
    off = (F.coalesce("void_n", F.lit(0)) + F.coalesce("crowd_n", F.lit(0))) / F.col("pred_area")
    fp = loose.where(F.coalesce(off <= 0.5, F.lit(True))).select(F.col("pred_cat").alias("category_id"))
    rows = tp.select("category_id", "iou", F.lit(1).alias("tp"), F.lit(0).alias("fp"), F.lit(0).alias("fn"))
    rows = rows.unionByName(fp.select("category_id", F.lit(0.0).alias("iou"), F.lit(0).alias("tp"), F.lit(1).alias("fp"), F.lit(0).alias("fn"))).unionByName(fn.select("category_id", F.lit(0.0).alias("iou"), F.lit(0).alias("tp"), F.lit(0).alias("fp"), F.lit(1).alias("fn")))
    return rows.groupBy("category_id").agg(*(F.sum(k).alias(k) for k in ("iou", "tp", "fp", "fn")))


def panoptic_quality(stats: DataFrame) -> DataFrame:
    """pq, sq, rq per category; categories without any count are left out of means (nulls)."""
    n = F.col("tp") + 0.5 * F.col("fp") + 0.5 * F.col("fn")
    some = F.col("tp") + F.col("fp") + F.col("fn") > 0
    return stats.withColumn("pq", F.when(some, F.col("iou") / n)).withColumn("sq", F.when(some, F.when(F.col("tp") > 0, F.col("iou") / F.col("tp")).otherwise(0.0))).withColumn("rq", F.when(some, F.col("tp") / n))


def panoptic_summary(per_category: DataFrame, categories: DataFrame) -> DataFrame:
    """(part: All, Things or Stuff; pq, sq, rq times 100; n)."""
    j = per_category.join(F.broadcast(categories.select("category_id", "isthing")), "category_id").where(F.col("pq").isNotNull())
    return j.rollup("isthing").agg(*(F.avg(k).alias(k) for k in ("pq", "sq", "rq")), F.count("*").alias("n"), F.grouping("isthing").alias("_g")).select(F.when(F.col("_g") == 1, "All").when(F.col("isthing"), "Things").otherwise("Stuff").alias("part"), *((F.col(k) * 100).alias(k) for k in ("pq", "sq", "rq")), "n")


# grounding, judging, classification, logs --------------------------------------------------------------


def rec_accuracy(first: DataFrame, n_col: str | None = None, thr: float = 0.5) -> DataFrame:
    """accuracy, miou and missing share of rows (iou of the first predicted box, null if none); denominators are all rows."""
    n = F.count("*") if n_col is None else F.max(n_col)
    hit = F.sum(F.when(F.col("iou") > thr, 1).otherwise(0))
    return first.agg((hit / n).alias("accuracy"), (F.sum(F.coalesce("iou", F.lit(0.0))) / n).alias("miou"), (F.sum(F.when(F.col("iou").isNull(), 1).otherwise(0)) / n).alias("missing"))


def judge_summary(reviews: DataFrame, by: str = "category", one: str = "score1", two: str = "score2") -> DataFrame:
    """Mean scores per category and over all, each rounded to 3 places before their ratio in per cent (1 place)."""
    r = reviews.rollup(by).agg(F.round(F.avg(one), 3).alias("mean1"), F.round(F.avg(two), 3).alias("mean2"), F.grouping(by).alias("_g"))
    return r.select(F.when(F.col("_g") == 1, "all").otherwise(F.col(by)).alias(by), "mean1", "mean2", F.round(F.col("mean2") / F.nullif(F.col("mean1"), F.lit(0.0)) * 100, 1).alias("ratio"))


def topk_accuracy(scores: DataFrame, row: str, cls: str, score: str, target: str, k: int = 1, thr: float | None = None) -> DataFrame:
    """Per cent of rows whose target is among the ``k`` best classes (with a score over ``thr`` if given); long rows (row, class, score, target)."""
    w = Window.partitionBy(row).orderBy(F.desc(score), cls)
    hit = (F.col(cls) == F.col(target)) & (F.lit(True) if thr is None else F.col(score) > thr)
    r = scores.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).groupBy(row).agg(F.max(F.when(hit, 1.0).otherwise(0.0)).alias("hit"))
    return r.agg((F.avg("hit") * 100).alias("accuracy"))


#: Least rows of a stretch in which windows of a bounded length are computed apart.
STRETCH = 1 << 16


def weighted_log_average(logs: DataFrame, by: list[str], order: str, value: str, count: str, n: int = 0) -> DataFrame:
    """Weighted mean of the last ``n`` entries at each entry; 0 means all so far. A group goes by ranges of its order: sums carry over, and a
    bounded window sees the ends of the stretch before."""
    t = ranges(logs, [*by, order])
    vc, own = F.col(value) * F.col(count), logs.columns
    if n == 0:
        t = carried(t, by, _sum=("sum", vc), _of=("sum", count))
        w = Window.partitionBy("_p", *by).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
        so_far = lambda c, x: F.coalesce(c, F.lit(0)) + F.sum(x).over(w)
        return t.withColumn("avg", so_far("_sum", vc) / so_far("_of", count)).select(*own, "avg")
    size = max(STRETCH, n)
    at, last = F.col("_row") % size, F.floor(F.col("_row") / size)
    halo = F.when(at > size - n, F.array(last, last + 1)).otherwise(F.array(last))
    t = carried(t, by).withColumn("_s", F.explode(halo))
    w = Window.partitionBy("_s", *by).orderBy("_row").rowsBetween(1 - n, 0)
    return t.withColumn("avg", F.sum(vc).over(w) / F.sum(count).over(w)).where(last == F.col("_s")).select(*own, "avg")


def best_so_far(logs: DataFrame, by: list[str], order: str, value: str, rule: str = "greater") -> DataFrame:
    """``best`` and whether this entry improves on all before."""
    kind = "max" if rule == "greater" else "min"
    t = carried(ranges(logs, [*by, order]), by, _e=(kind, value))
    run, two = Window.partitionBy("_p", *by).orderBy("_i"), F.greatest if rule == "greater" else F.least
    before = two(F.col("_e"), getattr(F, kind)(value).over(run.rowsBetween(Window.unboundedPreceding, -1)))
    t = t.withColumn("_b", before)
    better = F.col("_b").isNull() | ((F.col(value) > F.col("_b")) if rule == "greater" else (F.col(value) < F.col("_b")))
    return t.withColumn("best", two("_b", value)).withColumn("improved", better).select(*logs.columns, "best", "improved")


def ema(values: Column, momentum: float = 0.0002, start: float | None = None) -> Column:
    """Exponential mean of an ordered array."""
    first = F.element_at(values, 1) if start is None else F.lit(start)
    return F.aggregate(values, first.cast("double"), lambda s, v: s * (1 - momentum) + v * momentum)


def ema_of(df: DataFrame, by: list[str], order: str, value: str, momentum: float = 0.0002, name: str = "mean") -> DataFrame:
    """(by, name): each group's exponential mean from its first value on. Row i of n has a weight that its number alone gives, so the mean
    is a sum, and no group's values are gathered."""
    d = numbered(df.select(*by, order, value), order, name="_at", total="_of", by=by)
    age = (F.col("_of") - 1 - F.col("_at")).cast("double")
    weight = F.pow(F.lit(1.0 - momentum), age) * F.when(F.col("_at") == 0, 1.0).otherwise(momentum)
    return d.groupBy(*by).agg(F.sum(weight * F.col(value)).alias(name))


def running_extreme(df: DataFrame, by: list[str], order: str, value: str, kind: str = "max") -> DataFrame:
    t = carried(ranges(df, [*by, order]), by, _e=(kind, value))
    w = Window.partitionBy("_p", *by).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    both = (F.greatest if kind == "max" else F.least)(F.col("_e"), getattr(F, kind)(value).over(w))
    return t.withColumn(f"cum{kind}", both).select(*df.columns, f"cum{kind}")


def reduce_ranks(parts: DataFrame, key: str, value: str, how: str = "sum", ranks: int | None = None) -> DataFrame:
    """Sum, or mean over the ranks, of each key's values on all ranks: an aggregation with map-side combine."""
    total = F.sum(value)
    if how == "mean":
        total = total / (F.count_distinct("rank") if ranks is None else F.lit(float(ranks)))
    elif how != "sum":
        raise ValueError(how)
    return parts.groupBy(key).agg(total.alias(value))


def merge_views(dets: DataFrame, key: list[str]) -> DataFrame:
    """Mean box and score over augmented views (boxes already mapped back)."""
    return dets.groupBy(*key).agg(*(F.avg(n).alias(n) for n in B.Box._fields), F.avg("score").alias("score"))


def centre_of_mass(pixels: DataFrame, key: list[str], eps: float = 1e-6) -> DataFrame:
    """Of pixel rows (key, x, y, v)."""
    m = F.sum("v") + eps
    return pixels.groupBy(*key).agg((F.sum(F.col("x") * F.col("v")) / m).alias("cx"), (F.sum(F.col("y") * F.col("v")) / m).alias("cy"))


def polygon_area(xy: Column) -> Column:
    """Shoelace area of an array of x, y alternating."""
    n = F.size(xy) / 2
    k = F.sequence(F.lit(0), (n - 1).cast("int"))
    nxt = lambda i: ((i + 1) % n).cast("int")
    return F.abs(F.aggregate(k, F.lit(0.0), lambda s, i: s + xy[2 * i] * xy[2 * nxt(i) + 1] - xy[2 * nxt(i)] * xy[2 * i + 1])) / 2


def polygon_box(xy: Column) -> B.Box:
    even, odd = F.filter(xy, lambda v, i: i % 2 == 0), F.filter(xy, lambda v, i: i % 2 == 1)
    return B.Box(F.array_min(even), F.array_min(odd), F.array_max(even), F.array_max(odd))
