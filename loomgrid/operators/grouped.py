"""Groups worked on many at a time: sequential work within a group (suppression, matching) goes step by step for all groups of a batch at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from loomgrid.session import reachable

#: Rows gathered before their groups are worked on; a group is never cut.
ROWS = 1 << 17


def whole_groups(rows: DataFrame, group: list[str], order: list[Column | str], work: Callable[[pa.Table, np.ndarray], pa.Table], ddl: str | StructType, size: int = ROWS) -> DataFrame:
    """``work`` on batches of whole groups: a table of rows in the groups' order, and where its groups start. Spark deals out and sorts the rows
    by group, so tasks see groups one after the other and hold one batch of them."""
    reachable(rows.sparkSession)
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order)).alias("_place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            firsts = np.flatnonzero(b.column(b.num_columns - 1).to_numpy() == 1)
            # all before the batch's last group is whole
            if len(firsts) and n + firsts[-1] >= size:
                yield from done([*held, b.slice(0, firsts[-1])])
                b = b.slice(firsts[-1])
                held, n = [], 0
            held.append(b)
            n += b.num_rows
        if n:
            yield from done(held)

    def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        yield from work(t, np.flatnonzero(t.column(t.num_columns - 1).to_numpy() == 1)).to_batches()

    return rows.select("*", place).mapInArrow(run, ddl)


def by_size(starts: np.ndarray, rows: int) -> Iterator[tuple[int, np.ndarray]]:
    """(n, places): the groups of each size n, as an array of their rows' places, a group a line."""
    sizes = np.diff(np.append(starts, rows))
    for n in np.unique(sizes):
        yield int(n), starts[sizes == n][:, None] + np.arange(n)


# boxes and truths of images ----------------------------------------------------------------------------

BOX = ("x1", "y1", "x2", "y2")
#: Pairs of an image's boxes and truths that are looked at together: truths are taken by stretches, so no matrix is larger (or has one truth).
PAIRS = 1 << 20


def images(boxes: DataFrame, gt: DataFrame, work: Callable[[pa.Table, Iterator], pa.Table], ddl: str, more: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """``work(table, parts)`` on boxes (image_id, det_idx, x1..y2, ``more`` as double, ``keep`` as both sides have it) and truths (image_id, gt_idx, x1..y2) of whole images. Boxes and
    truths move once, as rows; their pairs are only looked at where they meet. ``parts`` yields (d, g): places in the table of the boxes (b, n) and truths (b, m)
    of images of equal numbers, in order of their idx; images without either are left out."""
    extra = lambda d: [F.col(c).cast("double").alias(c) if d is boxes else F.lit(None).cast("double").alias(c) for c in more]
    side = lambda d, k, idx: d.where("image_id is not null").select("image_id", F.lit(k).alias("side"), F.col(idx).cast("long").alias("idx"), *(F.col(c).cast("double").alias(c) for c in BOX), *extra(d), *keep)

    return whole_groups(side(boxes, 0, "det_idx").union(side(gt, 1, "gt_idx")), ["image_id"], ["side", "idx"], lambda t, starts: work(t, meetings(t, starts)), ddl)


def meetings(t: pa.Table, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(d, g): places of the rows of ``side`` 0 (b, n) and 1 (b, m) of groups of equal numbers; groups without either are left out."""
    n = np.add.reduceat((t.column("side").to_numpy() == 0).astype(int), starts)
    m = np.diff(np.append(starts, len(t))) - n
    shapes = np.stack([n, m], axis=1)
    for a, b in np.unique(shapes[(n > 0) & (m > 0)], axis=0):
        at = starts[(n == a) & (m == b)][:, None]
        step = max(1, PAIRS // int(a * b))
        for lo in range(0, len(at), step):
            yield at[lo : lo + step] + np.arange(a), at[lo : lo + step] + a + np.arange(b)


def beside(a: DataFrame, b: DataFrame, on: list[str], order: list[str], b_idx: str, mine: dict[str, Column], theirs: dict[str, Column], work: Callable[[pa.Table, Iterator], dict[str, pa.Array]], added: StructType) -> DataFrame:
    """The rows of ``a`` with columns ``added``, which ``work(table, meetings)`` gives for the table's every row. The table holds the rows of
    ``a`` (side 0, by ``order``) and ``b`` (side 1, by ``b_idx``) of whole groups of equal ``on``, with ``mine`` of the ones and ``theirs`` of the others in columns of
    equal names. Either moves once; their pairs are only looked at where they meet. Rows with a null in ``on`` meet nothing."""
    kept = [f for f in a.schema.fields if f.name not in added.names and f.name not in mine]
    lost = reduce(or_, (F.col(c).isNull() for c in on))
    deal = F.when(lost, F.xxhash64(*order)).otherwise(F.lit(0).cast("long")).alias("_deal")
    own = [F.col(f"`{f.name}`") for f in kept]
    none = [F.col(f.name) if f.name in on else F.lit(None).cast(f.dataType).alias(f.name) for f in kept]
    one = a.select(*own, *(c.alias(k) for k, c in mine.items()), F.lit(0).alias("side"), deal, F.lit(None).cast(b.schema[b_idx].dataType).alias("_b"))
    two = b.where(~lost).select(*none, *(c.alias(k) for k, c in theirs.items()), F.lit(1).alias("side"), F.lit(0).cast("long").alias("_deal"), F.col(b_idx).alias("_b"))
    rows = one.union(two)
    back = [f for f in a.schema.fields if f.name not in added.names]
    schema = StructType([StructField(f.name, rows.schema[f.name].dataType) for f in back] + added.fields)

    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        got = work(t, meetings(t, starts))
        t = pa.table({f.name: t.column(f.name) if f.name not in got else got[f.name] for f in schema.fields} | {"side": t.column("side")})
        return t.filter(pc.equal(t.column("side"), 0)).drop_columns("side")

    out = whole_groups(rows, [*on, "_deal"], ["side", *order, "_b"], run, schema)
    return out.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if schema[f.name].dataType != f.dataType else F.col(f"`{f.name}`") for f in back), *added.names)


def stretches(d: np.ndarray, g: np.ndarray) -> Iterator[np.ndarray]:
    """The truths ``g`` (b, m) by stretches of at most PAIRS pairs."""
    step = max(1, PAIRS // d.size)
    for lo in range(0, g.shape[1], step):
        yield g[:, lo : lo + step]


def corners(t: pa.Table) -> np.ndarray:
    """(rows, 4): the boxes of a table; nulls are NaN."""
    return np.stack([t.column(c).to_numpy() for c in BOX], axis=1)


def overlaps(a: np.ndarray, b: np.ndarray, eps: float = 1e-6, mode: str = "iou", extra: float = 0) -> np.ndarray:
    """(b, n, m): overlaps of boxes (b, n, 4) and (b, m, 4), worked out as the column function does; -inf where a corner is missing."""
    a, b = a[:, :, None], b[:, None]
    side = lambda k: np.maximum(np.minimum(a[..., k + 2], b[..., k + 2]) - np.maximum(a[..., k], b[..., k]) + extra, 0.0)
    area = lambda x: (x[..., 2] - x[..., 0] + extra) * (x[..., 3] - x[..., 1] + extra)
    inter = side(0) * side(1)
    union = area(a) if mode == "iof" else area(a) + area(b) - inter
    v = inter / np.maximum(union, eps)
    if mode == "giou":
        hull = [np.maximum(a[..., k + 2], b[..., k + 2]) - np.minimum(a[..., k], b[..., k]) for k in (0, 1)]
        hull = np.maximum(hull[0] * hull[1], eps)
        v = v - (hull - union) / hull
    return np.where(np.isnan(v), -np.inf, v)


def first_of(keys: tuple[np.ndarray, ...], of: np.ndarray) -> np.ndarray:
    """Places of the first row of each value of ``of``, by rising ``keys``."""
    order = np.lexsort((*keys[::-1], of))
    return order[np.append(True, of[order][1:] != of[order][:-1])] if len(order) else order
