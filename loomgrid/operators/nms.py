"""Suppression: greedy, batched, soft, matched, fast, matrix, rotated.

Greedy suppression is sequential within a group (image, class), so it is a fold over the group's boxes in falling
score, expressed as a higher-order function: it stays in the JVM and runs for all groups in parallel. Fast and matrix
suppression have no sequence and are self joins on the group. Soft suppression, whose scores change as
it goes, and that of rotated boxes take each step for the groups of a batch at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions import boxes as B
from loomgrid.operators.grouped import PAIRS, by_size, corners, whole_groups

#: Rotated boxes of groups that take their steps together.
CLIPPED = 1 << 16


def _ordered(dets: DataFrame, group: list[str], idx: str, score: str, order: str | None = None) -> DataFrame:
    key = F.struct((-F.col(score)).alias("_k") if order is None else F.col(order).alias("_k"), F.col(idx).alias("_i"), *(F.col(n).cast("double").alias(n) for n in B.Box._fields))
    return dets.groupBy(*group).agg(F.array_sort(F.collect_list(key)).alias("_b"))


def _clash(a: Column, b: Column, thr: float, extra: float, strict: bool) -> Column:
    v = B.overlap(B.field_box(a), B.field_box(b), "iou", extra, None)
    return F.coalesce(v > thr if strict else v >= thr, F.lit(False))


def nms(dets: DataFrame, thr: float, group: list[str], idx: str = "det_idx", score: str = "score", offset: float = 0, min_score: float = 0, max_num: int = -1, order: str | None = None) -> DataFrame:
    """Rows kept by greedy suppression (overlap over ``thr`` suppresses), with their ``rank`` in the kept order.

    ``min_score`` is a strict filter, used only if positive; ``max_num`` cuts after suppression. ``order`` replaces falling
    score by a column (input order, seeded hash). Ties go to the lower ``idx``."""
    d = dets.where(F.col(score) > min_score) if min_score > 0 else dets
    g = _ordered(d, group, idx, score, order)
    empty = F.expr("array()").cast(g.schema["_b"].dataType)
    kept = F.aggregate("_b", empty, lambda k, x: F.when(F.exists(k, lambda y: _clash(y, x, thr, offset, True)), k).otherwise(F.concat(k, F.array(x))))
    kept = F.slice(kept, 1, max_num) if max_num >= 0 else kept
    out = g.select(*group, F.posexplode(kept).alias("rank", "_x")).select(*group, "rank", F.col("_x._i").alias(idx))
    return d.join(out, [*group, idx])


def batched_nms(dets: DataFrame, thr: float, image: list[str], cls: str = "class_id", class_agnostic: bool = False, **kw) -> DataFrame:
    """Per class: the class is one more group key, so no offset trick is needed."""
    return nms(dets, thr, image if class_agnostic else [*image, cls], **kw)


def nms_by_name(kind: str, dets: DataFrame, thr: float, group: list[str], **kw) -> DataFrame:
    """Suppression chosen by configuration, from a fixed table."""
    table = {"nms": nms, "soft_nms": soft_nms, "nms_match": nms_match, "fast_nms": fast_nms}
    if kind not in table:
        raise ValueError(f"unknown suppression {kind!r}")
    return table[kind](dets, thr, group, **kw)


def nms_match(dets: DataFrame, thr: float, group: list[str], idx: str = "det_idx", score: str = "score") -> DataFrame:
    """(group, head, members): each kept box and those it suppresses (overlap at least ``thr``), head first."""
    g = _ordered(dets, group, idx, score)
    kind = g.schema["_b"].dataType.simpleString()
    empty = F.expr(f"cast(array() as array<struct<head:{kind[6:-1]},members:array<{dict(dets.dtypes)[idx]}>>>)")

    def step(acc, x):
        hit = F.transform(acc, lambda e: _clash(e["head"], x, thr, 0, False))
        at = F.array_position(hit, True)
        new = F.struct(x.alias("head"), F.array(x["_i"]).alias("members"))
        joined = F.transform(acc, lambda e, i: F.when(i + 1 == at, F.struct(e["head"].alias("head"), F.concat(e["members"], F.array(x["_i"])).alias("members"))).otherwise(e))
        return F.when(at > 0, joined).otherwise(F.concat(acc, F.array(new)))

    return g.select(*group, F.explode(F.aggregate("_b", empty, step)).alias("_e")).select(*group, F.col("_e.head._i").alias("head"), F.col("_e.members").alias("members"))


def soft_nms(dets: DataFrame, thr: float, group: list[str], idx: str = "det_idx", score: str = "score", sigma: float = 0.5, min_score: float = 1e-3, method: str = "linear", offset: float = 0) -> DataFrame:
    """(group, idx, rank, score): scores lowered by overlap with each box taken; boxes below ``min_score`` leave."""
    if method not in ("naive", "linear", "gaussian"):
        raise ValueError(method)
    kinds, w = dict(dets.dtypes), len(group)

    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        b, scores, found = corners(t), t.column("_s").to_numpy(), []
        areas = (b[:, 2] - b[:, 0] + offset) * (b[:, 3] - b[:, 1] + offset)
        for _, at in by_size(starts, len(t)):
            for rows in np.array_split(at, -(-at.size // PAIRS)):  # a step of all these groups at once
                s, left = scores[rows].copy(), np.ones(rows.shape, bool)
                line = np.arange(len(rows))
                for rank in range(rows.shape[1]):
                    top = np.where(left & ~np.isnan(s), s, -np.inf).argmax(axis=1)
                    top = np.where(left[line, top], top, left.argmax(axis=1))  # where no score is above -inf, the first left
                    has = left[line, top]
                    if not has.any():
                        break
                    found.append((rows[line, top][has], np.full(has.sum(), rank), s[line, top][has]))
                    left[line, top] = False
                    one = rows[line, top]
                    x, y = (np.maximum(0, np.minimum(b[one, k + 2][:, None], b[rows, k + 2]) - np.maximum(b[one, k][:, None], b[rows, k]) + offset) for k in (0, 1))
                    inter = x * y
                    with np.errstate(invalid="ignore", divide="ignore"):
                        v = inter / (areas[one][:, None] + areas[rows] - inter)
                    k = {"naive": lambda: np.where(v >= thr, 0.0, 1.0), "linear": lambda: np.where(v >= thr, 1 - v, 1.0), "gaussian": lambda: np.exp(-v * v / sigma)}[method]()  # noqa: B023
                    s = np.where(left, s * np.nan_to_num(k, nan=1.0), s)
                    left &= s >= min_score
        at, rank, got = (np.concatenate(x) for x in zip(*found, strict=True))
        own = {t.column_names[k]: t.column(k).take(pa.array(at)) for k in range(w + 1)}
        return pa.table({**own, "rank": pa.array(rank.astype(np.int32)), score: pa.array(got)})

    ddl = ", ".join([*(f"`{c}` {kinds[c]}" for c in group), f"`{idx}` {kinds[idx]}", "rank int", f"`{score}` double"])
    d = dets.select(*group, idx, F.col(score).cast("double").alias("_s"), *(F.col(n).cast("double").alias(n) for n in B.Box._fields))
    return whole_groups(d, group, [idx], run, ddl)


def _ranked_pairs(dets: DataFrame, group: list[str], idx: str, score: str, top: int | None) -> tuple[DataFrame, DataFrame]:
    w = Window.partitionBy(*group).orderBy(F.desc(score), idx)
    r = dets.withColumn("rank", F.row_number().over(w))
    r = r.where(F.col("rank") <= top) if top else r
    other = r.select(*group, F.col("rank").alias("b_rank"), F.col(idx).alias("b_idx"), F.col(score).alias("b_score"), *(F.col(n).alias(f"b{n}") for n in B.Box._fields))
    return r, other


def fast_nms(dets: DataFrame, thr: float, group: list[str], idx: str = "det_idx", score: str = "score", top: int | None = 200, max_num: int = -1, eps: float = 1e-6) -> DataFrame:
    """Kept if no higher-ranked box, suppressed or not, overlaps it by more than ``thr``: an anti join."""
    r, other = _ranked_pairs(dets, group, idx, score, top)
    hit = (F.col("b_rank") < F.col("rank")) & (B.overlap(B.box(), B.Box(*(F.col(f"b{n}") for n in B.Box._fields)), eps=eps) > thr)
    on = [r[c] == other[c] for c in group]
    cond = hit
    for c in on:
        cond = cond & c
    out = r.join(other, cond, "left_anti")
    if max_num >= 0:
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy("rank"))).where(F.col("_n") <= max_num).drop("_n")
    return out


def matrix_nms(dets: DataFrame, group: list[str], idx: str = "det_idx", score: str = "score", kernel: str = "gaussian", sigma: float = 2.0, min_score: float = -1, top: int | None = None) -> DataFrame:
    """Scores times the least, over higher-ranked boxes, of decay by their overlap over decay by their own largest overlap."""
    r, other = _ranked_pairs(dets, group, idx, score, top)
    ob = B.Box(*(F.col(f"b{n}") for n in B.Box._fields))
    pairs = r.join(other, group).where(F.col("b_rank") < F.col("rank")).select(*group, "rank", "b_rank", B.overlap(B.box(), ob).alias("iou"))
    most = pairs.groupBy(*group, "rank").agg(F.max("iou").alias("comp")).withColumnRenamed("rank", "b_rank")
    j = pairs.join(most, [*group, "b_rank"], "left").withColumn("comp", F.coalesce("comp", F.lit(0.0)))
    k = F.exp(-sigma * F.col("iou") * F.col("iou")) / F.exp(-sigma * F.col("comp") * F.col("comp")) if kernel == "gaussian" else (1 - F.col("iou")) / F.nullif(1 - F.col("comp"), F.lit(0.0))
    least = j.withColumn("k", k).groupBy(*group, "rank").agg(F.min("k").alias("k"))
    out = r.join(least, [*group, "rank"], "left").withColumn(score, F.col(score) * F.coalesce("k", F.lit(1.0))).drop("k")
    return out.where(F.col(score) >= min_score) if min_score > 0 else out


def multiclass_nms(scores: DataFrame, thr: float, score_thr: float, image: list[str], cls: str = "class_id", idx: str = "det_idx", score: str = "score", factor: str | None = None, max_num: int = -1) -> DataFrame:
    """Rows are (box, class) scores. The raw score is thresholded before any factor applies; suppression is per class; the best
    ``max_num`` of an image stay."""
    d = scores.where(F.col(score) > score_thr)
    d = d.withColumn(score, F.col(score) * F.col(factor)) if factor else d
    kept = nms(d, thr, [*image, cls], idx, score).drop("rank")
    w = Window.partitionBy(*image).orderBy(F.desc(score), cls, idx)
    kept = kept.withColumn("rank", F.row_number().over(w) - 1)
    return kept.where(F.col("rank") < max_num) if max_num >= 0 else kept


def rotated_nms(dets: DataFrame, thr: float, group: list[str], idx: str = "det_idx", score: str = "score", box: str = "rbox", pre: int | None = None, post: int | None = None) -> DataFrame:
    """Greedy suppression of rotated boxes (arrays cx, cy, w, h, angle); bird's-eye boxes are the same with caps."""
    from loomgrid.operators.spatial import rotated_ious

    kinds, w = dict(dets.dtypes), len(group)

    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        r, found = np.stack([t.column(f"_b{k}").to_numpy() for k in range(5)], axis=1), []
        reach = np.sqrt(r[:, 2] * r[:, 2] + r[:, 3] * r[:, 3]) / 2
        for n, at in by_size(starts, len(t)):
            at = at[:, :pre] if pre else at
            for rows in np.array_split(at, -(-at.size // CLIPPED)):
                kept = np.zeros(rows.shape, bool)
                for i in range(rows.shape[1]):
                    one = rows[:, i]
                    gap = r[rows[:, :i], :2] - r[one, None, :2]
                    near = kept[:, :i] & ((gap * gap).sum(axis=2) <= (reach[rows[:, :i]] + reach[one][:, None]) ** 2 * (1 + 1e-9))
                    k, j = np.nonzero(near if thr >= 0 else kept[:, :i])  # circles apart: no overlap
                    hit = rotated_ious(r[rows[k, j]], r[one[k]]) > thr
                    kept[:, i] = True
                    kept[k[hit], i] = False
                rank = kept.cumsum(axis=1) - 1
                ok = kept & (rank < post) if post else kept
                found.append((rows[ok], rank[ok]))
        at, rank = (np.concatenate(x) for x in zip(*found, strict=True))
        own = {t.column_names[k]: t.column(k).take(pa.array(at)) for k in range(w + 2)}
        return pa.table({**own, "rank": pa.array(rank.astype(np.int32))})

    ddl = ", ".join([*(f"`{c}` {kinds[c]}" for c in group), f"`{idx}` {kinds[idx]}", f"`{score}` double", "rank int"])
    d = dets.select(*group, idx, F.col(score).cast("double").alias(score), *(F.col(box)[k].cast("double").alias(f"_b{k}") for k in range(5)))
    return whole_groups(d, group, [F.desc(score), idx], run, ddl)


def select_regions(pred: DataFrame, refer: DataFrame, truth: DataFrame, image: list[str], thr: float = 0.6, min_score: float = 0.15, max_num: int = 100, seed: int = 0) -> DataFrame:
    """Candidate regions of an image: predictions with fused scores, referred boxes at 1.0 and true boxes at 0.2 go
    through suppression together; the best ``max_num`` stay, in seeded order. An image whose regions all
    fail the score filter keeps its best prediction."""
    cols = [*image, "idx", "score", *B.Box._fields]
    one = lambda d, k, s=None: d.select(*image, F.concat(F.lit(k), F.col("idx").cast("string")).alias("idx"), (F.col("score") if s is None else F.lit(s)).cast("double").alias("score"), *B.Box._fields)
    p = one(pred, "p")
    pool = p.where(F.col("score") > min_score).unionByName(one(refer, "r", 1.0)).unionByName(one(truth, "t", 0.2))
    kept = nms(pool, thr, image, "idx", "score", max_num=max_num).select(*cols)
    best = p.groupBy(*image).agg(F.max_by(F.struct("idx", "score", *B.Box._fields), F.struct("score", "idx")).alias("b")).select(*image, "b.*")
    lost = best.join(kept.select(*image).distinct(), image, "left_anti").select(*cols)
    w = Window.partitionBy(*image).orderBy(F.xxhash64("idx", F.lit(seed)), "idx")
    return kept.unionByName(lost).withColumn("slot", F.row_number().over(w) - 1)
