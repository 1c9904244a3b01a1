"""Embedding whitening by a matrix-free block Lanczos iteration.

The covariance V of the fit list (each distinct vector of whole numbers once) is never built. A pass sends a block of directions Q to all
partitions, which return their part of the sum of (x - m)((x - m)'Q); Spark adds the parts up. The driver holds the basis of directions
only (at most as many as dimensions): each block is orthogonalised twice against the whole basis (full reorthogonalisation),
a direction that vanishes on the way (breakdown) is replaced by a fresh random one (restart), and the iteration ends when the residuals of the
wanted pairs are below ``tol`` of the largest eigenvalue, or the basis spans the whole space, which is exact. A last pass over the fit list
measures true residuals, refines eigenvalues and takes the covariance of the whitened vectors itself.

Sums S and deviations are exact whole numbers; x - m is taken from whole numbers too, (x - S div n) - (S mod n) / n, so nothing is lost to the offset.
Shares of variance are over the trace, which the deviations give: trace(V) is their sum over the fit list by n cubed.

The fit list is a written table, so passes never repeat the shuffle that made vectors distinct, and a lost executor costs its tasks.

Defined cases: null vectors, vectors with null or non-finite parts, and empty vectors are dropped; so are vectors of another length than
the commonest (the smaller, if two are as common); components that are beyond 2**40 stand at that bound; repeated rows each get their rows, and a null vec_id stays
null; components of no variance (below ``FLAT`` of the trace) are not given, so an empty table, a single distinct vector or equal vectors give no rows;
a deviation too large for a long is null. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import Scratch, tune

#: The grid of whole numbers.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
TOL = 1e-13
FLAT = 1e-12
BOUND = float(1 << 40)


class Fit(NamedTuple):
    n: int
    floor: np.ndarray  # S div n, whole
    rest: np.ndarray  # S mod n, whole
    vectors: np.ndarray  # (dimensions, components)
    values: np.ndarray
    trace: float
    identity_error: float
    passes: int
    restarts: int


def grid(vector: Column) -> Column:
    """Whole numbers of a vector; null if it is null, empty or has parts that are no numbers."""
    v = F.transform(vector, lambda c: c.cast("double"))
    good = (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(good, F.transform(v, lambda c: (F.floor(F.greatest(F.least(c, F.lit(BOUND)), F.lit(-BOUND)) * SCALE) + OFFSET).cast("long")))


def matrix(x: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls, all as long as each other."""
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return np.asarray(x.flatten()).reshape(len(x), -1)


def sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """(n, S): rows, and exact sums of each dimension."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * dim, 0
        for b in batches:
            if b.num_rows:
                total = [a + int(c) for a, c in zip(total, matrix(b["x"]).sum(axis=0), strict=True)]  # at most 512 rows of 2**47 each
                n += b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, dim), pa.int32()), pa.array([str(v) for v in [n, *total]])], ["d", "s"])

    got = fit.mapInArrow(part, "d int, s string").groupBy("d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # a row for each dimension
    at = {r.d: int(r.s) for r in got}
    return at.get(-1, 0), [at.get(k, 0) for k in range(dim)]


def centred(x: np.ndarray, floor: np.ndarray, rest: np.ndarray, n: int) -> np.ndarray:
    return (x - floor) - rest / n


def added(fit: DataFrame, work, shape: tuple[int, int]) -> np.ndarray:
    """Sum over all rows of ``work(rows)``, a matrix of ``shape``."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(shape), False
        for b in batches:
            if b.num_rows:
                total += work(matrix(b["x"]))
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0], dtype=np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), shape[1]).cast(pa.list_(pa.float64()))], ["r", "v"])

    rows = fit.mapInArrow(part, "r int, v array<double>").groupBy("r").agg(*(F.sum(F.col("v")[k]).alias(f"c{k}") for k in range(shape[1]))).collect()
    out = np.zeros(shape)
    for r in rows:
        out[r[0]] = r[1:]
    return out


def orthogonal(w: np.ndarray, basis: np.ndarray, scale: float, rng: np.random.Generator, room: int) -> tuple[np.ndarray, int]:
    """Orthonormal columns for the directions of ``w`` outside ``basis``, at most ``room``; vanished ones come anew from chance. (columns, restarts)"""
    out, restarts = [], 0
    for k in range(min(w.shape[1], room)):
        v, before = w[:, k], np.linalg.norm(w[:, k])
        for attempt in range(4):
            q = np.column_stack([basis, *out]) if basis.size or out else np.zeros((len(v), 0))
            for _ in range(2):  # twice is enough
                v = v - q @ (q.T @ v)
            norm = np.linalg.norm(v)
            if norm > 1e-10 * max(before, 1e-300) and norm > 1e-14 * scale:
                out.append(v / norm)
                break
            v, scale, restarts = rng.standard_normal(len(v)), 0.0, restarts + 1
            before = np.linalg.norm(v)
    return np.column_stack(out) if out else np.zeros((len(w), 0)), restarts


def lanczos(apply, dim: int, want: int, tol: float = TOL, seed: int = 42) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(vectors, values, passes, restarts) of the ``want`` largest eigenpairs of the symmetric map ``apply``, which takes a block of columns."""
    rng = np.random.default_rng(seed)
    basis, image, restarts, passes = np.zeros((dim, 0)), np.zeros((dim, 0)), 0, 0
    block, _ = orthogonal(rng.standard_normal((dim, min(want, dim))), basis, 0.0, rng, dim)
    while True:
        new = apply(block)
        passes += 1
        basis, image = np.column_stack([basis, block]), np.column_stack([image, new])
        t = basis.T @ image
        values, s = np.linalg.eigh((t + t.T) / 2)
        values, s = values[::-1][:want], s[:, ::-1][:, :want]
        residual = np.linalg.norm(image @ s - basis @ (s * values), axis=0)
        room = dim - basis.shape[1]
        if not room or (basis.shape[1] >= want and (residual <= tol * max(values[0], 0.0)).all()):
            return basis @ s, values, passes, restarts
        block, again = orthogonal(new, basis, float(np.abs(values).max()), rng, room)
        restarts += again
        if not block.shape[1]:
            return basis @ s, values, passes, restarts


def fit(distinct: DataFrame, dim: int, want: int = COMPONENTS, tol: float = TOL, seed: int = 42) -> Fit | None:
    """Of a table of distinct vectors ``x`` (array<long>)."""
    n, total = sums(distinct, dim)
    if n < 2:
        return None
    floor, rest = np.array([s // n for s in total], np.int64), np.array([s % n for s in total], np.float64)

    def apply(q: np.ndarray) -> np.ndarray:
        def work(x: np.ndarray) -> np.ndarray:
            c = centred(x, floor, rest, n)
            return c.T @ (c @ q)

        return added(distinct, work, q.shape) / n

    y, e, passes, restarts = lanczos(apply, dim, min(want, dim), tol, seed)
    spread = distinct.select("x").mapInArrow(deviations(n, floor, rest), "deviation decimal(38,0)").agg(F.sum("deviation")).first()[0]
    trace = float(int(spread or 0)) / float(n) ** 3
    keep = e > FLAT * trace
    if not keep.any():
        return None
    y, e = y[:, keep], e[keep]
    k = y.shape[1]

    def work(x: np.ndarray) -> np.ndarray:
        z = centred(x, floor, rest, n) @ y / np.sqrt(e)
        return np.vstack([z.T @ z, z.sum(axis=0)])

    got = added(distinct, work, (k + 1, k)) / n
    cov = got[:k] - np.outer(got[k], got[k])
    y = y * np.where(y[np.abs(y).argmax(axis=0), np.arange(k)] < 0, -1, 1)
    return Fit(n, floor, rest.astype(np.int64), y, e, trace, float(np.abs(cov - np.eye(k)).max()), passes + 2, restarts)


def exact(x: np.ndarray, n: int, floor: np.ndarray, rest: np.ndarray) -> list[int]:
    """Sum over dimensions of (n x - S)^2."""
    d = x - floor
    most = n * (int(np.abs(d).max(initial=0)) + 1)
    if most * most * x.shape[1] < 1 << 63:
        return ((n * d - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
    r = [int(v) for v in rest]
    return [sum((n * int(v) - c) ** 2 for v, c in zip(row, r, strict=True)) for row in d]


def deviations(n: int, floor: np.ndarray, rest: np.ndarray):
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        total = sum(sum(exact(matrix(b["x"]), n, floor, rest)) for b in batches if b.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array([Decimal(total)], pa.decimal128(38, 0))], ["deviation"])

    return part


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", want: int = COMPONENTS, tol: float = TOL) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector kept and each component."""
    spark = vectors.sparkSession
    tune(spark)
    scratch = Scratch(spark, "whitening")
    rows = vectors.select(F.col(id_col).alias("vec_id"), grid(F.col(vector_col)).alias("x")).where("x is not null")
    ddl = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    commonest = rows.groupBy(F.size("x").alias("d")).count().agg(F.min_by("d", F.struct(-F.col("count"), F.col("d")))).first()[0]  # a row for each length
    if commonest is None:
        return spark.createDataFrame([], ddl)
    rows = rows.where(F.size("x") == commonest)
    model = fit(scratch.save("fit", rows.select("x").distinct()), commonest, want, tol)
    if model is None:
        return spark.createDataFrame([], ddl)
    shared = spark.sparkContext.broadcast(model)  # dimensions x components

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.values)
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b["x"])
            z = centred(x, m.floor, m.rest.astype(np.float64), m.n) @ m.vectors / np.sqrt(m.values)
            dev = [v if v < 1 << 63 else None for v in exact(x, m.n, m.floor, m.rest)]
            who = pa.array(np.repeat(np.arange(len(x)), k))
            count = len(x) * k
            yield pa.RecordBatch.from_arrays([b["vec_id"].take(who), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(count, m.n, np.int64)), pa.array(dev, pa.int64()).take(who), pa.array(z.ravel()), pa.array(np.tile(m.values / m.trace, len(x))), pa.array(np.full(count, m.identity_error))], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(out, ddl)
