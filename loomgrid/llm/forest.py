"""Embedding near-duplicates by a random-projection tree forest.

Equal vectors of a label form one class. Every tree splits recursively along random directions at the median,
and vectors within ``margin`` of a split go to both sides (spill). The upper levels, which deal classes out to
cells, take their medians from a bounded sample (``sample_bytes``); the cells, some thousand vectors each, are split
further from all their own vectors, until a leaf is small or splitting no longer thins it (a tight cluster
stays whole). In each leaf all pairs are compared by cosine in double precision, block by block. A pair
is counted only in the first leaf that both vectors share, so links are counted and joined without
emitting pairs: a leaf gives one row per vector.

A leaf above ``wide`` vectors, a tight cluster, is never whole in a task. Vectors within half the threshold's angle of its mean
direction (its core) are all linked with each other, by the triangle inequality: what they gain is a sum over
groups of vectors with the same earlier leaves. Only the others are compared, by tiles of two blocks.

Every class is in every tree; the margin makes a link survive a tree with high probability, and the trees
multiply what is missed (tests measure recall against brute force).

Defined cases: vectors that are null, zero, empty or hold null or non-finite parts, and rows with a null
label, link with nothing (n_links 0, component_id their own id); vectors of different lengths are never
compared; repeated rows are separate vectors; a component whose ids are all null has a null id; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import Scratch, components, tune, workers

TREES = 6
CELL = 4096
LEAF = 96
WIDE = 8192
BLOCK = 512


def direction(dim: int, *key: int) -> np.ndarray:
    r = np.random.default_rng(key).standard_normal(dim)
    return r / np.linalg.norm(r)


def unit(rows: np.ndarray) -> np.ndarray:
    x = rows.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def route(x: np.ndarray, cuts: np.ndarray, tree: int, seed: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) pairs of one tree's upper levels; ``cuts`` holds the medians of nodes 1, 2, ... in heap order."""
    depth = int(math.log2(len(cuts) + 1)) if len(cuts) else 0
    row, node = np.arange(len(x)), np.ones(len(x), np.int64)
    for level in range(depth):
        p = (x @ direction(x.shape[1], seed, tree, level))[row]
        c = cuts[node - 1]
        left, right = p <= c + margin, p >= c - margin
        row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
    return row, node


def fit_cuts(sample: np.ndarray, tree: int, depth: int, seed: int, margin: float) -> np.ndarray:
    cuts = np.zeros((1 << depth) - 1)
    row, node = np.arange(len(sample)), np.ones(len(sample), np.int64)
    for level in range(depth):
        p = (sample @ direction(sample.shape[1], seed, tree, level))[row]
        for k in range(1 << level, 2 << level):
            own = p[node == k]
            cuts[k - 1] = np.median(own) if len(own) else 0.0
        c = cuts[node - 1]
        node = 2 * node + (p > c)
    return cuts


def leaves(x: np.ndarray, key: tuple[int, ...], margin: float, leaf: int = LEAF) -> list[np.ndarray]:
    """Row numbers of each leaf below a cell."""
    out, stack = [], [(np.arange(len(x)), 1)]
    while stack:
        rows, node = stack.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        p = x[rows] @ direction(x.shape[1], *key, node & 0x7FFFFFFF)
        c = np.median(p)
        a, b = rows[p <= c + margin], rows[p >= c - margin]
        if max(len(a), len(b)) > 0.8 * len(rows):
            out.append(rows)
            continue
        stack += [(a, 2 * node), (b, 2 * node + 1)]
    return out


def compare(x: np.ndarray, mine: np.ndarray, count: np.ndarray, homes: list[np.ndarray], home: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of rows ``mine`` against all rows of a leaf: for each row the copies newly linked, and the smallest row
    that it reaches by the links found here."""
    earlier = np.unique(np.concatenate([h[h < home] for h in homes]))
    shared = np.zeros((len(x), len(earlier)), np.float32)
    for i, h in enumerate(homes):
        shared[i, np.searchsorted(earlier, h[h < home])] = 1
    gained, low = np.zeros(len(x), np.int64), np.arange(len(x))
    for at in range(0, len(mine), BLOCK):
        rows = mine[at : at + BLOCK]
        link = (x[rows] @ x.T) >= threshold
        link[np.arange(len(rows)), rows] = False
        if len(earlier):
            link &= (shared[rows] @ shared.T) == 0
        gained[rows] = link @ count
        for k in np.flatnonzero(link.any(axis=1)).tolist():
            met = np.append(low[link[k]], low[rows[k]])
            first = met.min()
            if first < met.max():
                low[np.isin(low, met)] = first
    return gained, low


FOUND = "cid long, gained long, low long"


def tile(xa: np.ndarray, xb: np.ndarray, a: pd.DataFrame, b: pd.DataFrame, home: int, threshold: float) -> np.ndarray:
    """Which rows of two blocks of a leaf are linked and met in no earlier leaf."""
    link = (xa @ xb.T) >= threshold
    link &= a["cid"].to_numpy()[:, None] != b["cid"].to_numpy()[None, :]
    sides = [[np.asarray(h, np.int64) for h in d["homes"]] for d in (a, b)]
    earlier = np.unique(np.concatenate([h[h < home] for s in sides for h in s]))
    if len(earlier):
        marks = [np.zeros((len(s), len(earlier)), np.float32) for s in sides]
        for m, s in zip(marks, sides, strict=True):
            for i, h in enumerate(s):
                m[i, np.searchsorted(earlier, h[h < home])] = 1
        link &= (marks[0] @ marks[1].T) == 0
    return link


def crowded(rows: DataFrame, scratch: Scratch, threshold: float, wide: int) -> DataFrame:
    """What the vectors of leaves above ``wide`` gain there (FOUND); ``rows``: cid, label, dim, home, vec, n, homes, count."""
    key = ["label", "dim", "home"]
    kinds = dict(rows.dtypes)
    half = math.cos(math.acos(max(-1.0, min(1.0, threshold))) / 2) + 1e-9
    blocks = F.ceil(F.col("count") * 2 / wide).cast("int")
    rows = scratch.save("crowded", rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).drop("count"))
    head = f"label {kinds['label']}, dim int, home long"

    def add(pdf: pd.DataFrame, x: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"label": pdf["label"].iloc[:1], "dim": pdf["dim"].iloc[:1], "home": pdf["home"].iloc[:1], "sum": [x.sum(axis=0).tolist()]})

    part = rows.groupBy(*key, "block").applyInPandas(lambda p: add(p, unit(np.array(p["vec"].tolist(), np.float64))), f"{head}, sum array<double>")
    centre = part.groupBy(*key).applyInPandas(lambda p: add(p, np.array(p["sum"].tolist())), f"{head}, sum array<double>")
    # a leaf's centre is repeated for its blocks, so that no key is hot
    centre = centre.join(rows.select(*key, "block").distinct(), key)

    def flag(batches):
        for pdf in batches:
            if len(pdf):
                core = np.zeros(len(pdf), bool)
                for _, at in pdf.groupby("dim").indices.items():
                    x, c = (np.array(pdf[k].iloc[at].tolist(), np.float64) for k in ("vec", "sum"))
                    size = np.linalg.norm(c, axis=1)
                    core[at] = (unit(x) * c).sum(axis=1) >= half * np.where(size > 0, size, np.inf)
                yield pdf.drop(columns="sum").assign(core=core)

    ddl = ", ".join(f"{c} {k}" for c, k in rows.dtypes)
    marked = scratch.save("marked", rows.join(centre, [*key, "block"]).select(*rows.columns, "sum").mapInPandas(flag, f"{ddl}, core boolean"))
    sig = F.filter("homes", lambda h: h < F.col("home")).alias("sig")
    core = marked.where("core").select("cid", *key, "n", sig)
    sums = scratch.save("signatures", core.groupBy(*key, "sig").agg(F.sum("n").alias("total"), F.min("cid").alias("low")))
    a, b = sums.alias("a"), sums.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key]
    apart = a.join(b, [*same, ~F.arrays_overlap("a.sig", "b.sig")])
    reach = apart.groupBy(*(f"a.{k}" for k in key), "a.sig").agg(F.sum("b.total").alias("reach"))
    lowest = sums.groupBy(*key).agg(F.min("low").alias("low"))
    met = core.join(reach, [*key, "sig"], "left").join(lowest, key)
    # those without an earlier leaf reach themselves as well
    inner = met.select("cid", (F.coalesce("reach", F.lit(0)) - F.when(F.size("sig") == 0, F.col("n")).otherwise(0)).alias("gained"), "low")
    loose = marked.where("not core")
    left = loose.groupBy(*key).agg(F.ceil(F.count("*") * 2 / wide).cast("int").alias("parts"))
    one = loose.join(left, key).withColumn("part", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("parts")).cast("int")).drop("parts", "block", "core")
    one = scratch.save("loose", one)
    one = one.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    every = marked.join(left, key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "blocks")

    def across(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame({"cid": [], "gained": [], "low": []})
        xp, xq = (unit(np.array(d["vec"].tolist(), np.float64)) for d in (p, q))
        link = tile(xp, xq, p, q, int(p["home"].iloc[0]), threshold)
        ids = np.unique(np.concatenate([p["cid"], q["cid"]]))
        ip, iq = np.searchsorted(ids, p["cid"]), np.searchsorted(ids, q["cid"])
        gained, low = np.zeros(len(ids), np.int64), np.arange(len(ids))
        np.add.at(gained, ip, link @ q["n"].to_numpy())
        inside = q["core"].to_numpy(bool)  # the others count on their own side
        np.add.at(gained, iq[inside], (link.T @ p["n"].to_numpy())[inside])
        for k in np.flatnonzero(link.any(axis=1)).tolist():
            all_met = np.append(low[iq[link[k]]], low[ip[k]])
            if all_met.min() < all_met.max():
                low[np.isin(low, all_met)] = all_met.min()
        some = (gained > 0) | (low != np.arange(len(ids)))
        return pd.DataFrame({"cid": ids[some], "gained": gained[some], "low": ids[low[some]]})

    outer = one.groupBy(*key, "part", "block").cogroup(every.groupBy(*key, "part", "block")).applyInPandas(across, FOUND)
    return scratch.save("gained", inner.union(outer))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, trees: int = TREES,
                    margin_scale: float = 1.0, cell: int = CELL, leaf: int = LEAF, wide: int = WIDE, sample_bytes: int = 16 << 20, seed: int = 7) -> DataFrame:
    """One row per vector: id, n_links (other vectors linked directly), component_id, kept."""
    spark = vectors.sparkSession
    tune(spark)
    scratch = Scratch(spark, "forest")
    v = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    sound = F.col("label").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists("vec", lambda e: e != 0)
    v = v.withColumn("sound", F.coalesce(sound, F.lit(False)))
    classes = v.where("sound").groupBy("label", "vec").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    classes = scratch.save("classes", classes.withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("vec")).repartition(workers(spark), "cid"))
    sizes = classes.groupBy("label", "dim").count().agg(F.max("count").alias("most"), F.sum("count").alias("all"), F.max("dim").alias("dim")).first()
    most, every, dim = (sizes.most or 0), (sizes["all"] or 0), (sizes.dim or 1)
    depth = max(0, math.ceil(math.log2(max(1, most) / cell)))
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    cuts: dict[int, list[np.ndarray]] = {}
    if depth:
        rows = max(1000, sample_bytes // (8 * dim))
        picked = classes.where(F.pmod(F.xxhash64("cid", F.lit(seed)), F.lit(1 << 20)) < int(min(1.0, rows / every) * (1 << 20))).select("dim", "vec").toPandas()
        for d, part in picked.groupby("dim"):
            x = unit(np.array(part["vec"].tolist(), np.float64))
            cuts[int(d)] = [fit_cuts(x, t, depth, seed, 0.0) for t in range(trees)]

    def deal(batches):
        for b in batches:
            dims = b.column(2).to_numpy()
            flat = b.column(3).flatten().to_numpy()
            ends = np.cumsum(dims)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                raw = np.stack([flat[ends[i] - d : ends[i]] for i in at])
                x = unit(raw)
                margin = margin_scale * reach / math.sqrt(d)
                who, tree, cells = [], [], []
                for t in range(trees):
                    r, c = route(x, cuts.get(d, [np.zeros((1 << depth) - 1)] * trees)[t], t, seed, margin)
                    who.append(r)
                    tree.append(np.full(len(r), t, np.int32))
                    cells.append(c)
                idx = pa.array(at[np.concatenate(who)])
                yield pa.RecordBatch.from_arrays([b.column(0).take(idx), b.column(1).take(idx), pa.array(np.concatenate(tree)), pa.array(np.concatenate(cells)), b.column(2).take(idx), b.column(3).take(idx)], names=["cid", "label", "tree", "cell", "dim", "vec"])

    label_t, vec_t = classes.schema["label"].dataType.simpleString(), classes.schema["vec"].dataType.simpleString()
    dealt = classes.select("cid", "label", "dim", "vec").mapInArrow(deal, f"cid long, label {label_t}, tree int, cell long, dim int, vec {vec_t}")

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid")
        d, t, c = int(pdf["dim"].iloc[0]), int(pdf["tree"].iloc[0]), int(pdf["cell"].iloc[0])
        x = unit(np.array(pdf["vec"].tolist(), np.float64))
        cid = pdf["cid"].to_numpy()
        out = leaves(x, (seed, t, c), margin_scale * reach / math.sqrt(d), leaf)
        return pd.DataFrame({"cid": np.concatenate([cid[r] for r in out]), "home": np.concatenate([np.full(len(r), (t << 56) | (c << 20) | k, np.int64) for k, r in enumerate(out)])})

    homes = dealt.groupBy("label", "dim", "tree", "cell").applyInPandas(assign, "cid long, home long")
    homes = homes.groupBy("cid").agg(F.sort_array(F.collect_list("home")).alias("homes"))
    placed = scratch.save("placed", classes.join(homes, "cid").select("cid", "label", "dim", "vec", "n", "homes"))
    spots = placed.withColumn("home", F.explode("homes"))
    key = ["label", "dim", "home"]
    crowd = scratch.save("crowd", placed.select("label", "dim", F.explode("homes").alias("home")).groupBy(*key).count().where(F.col("count") > wide))

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid")
        home = int(pdf["home"].iloc[0])
        cid = pdf["cid"].to_numpy()
        x = unit(np.array(pdf["vec"].tolist(), np.float64))
        gained, low = compare(x, np.arange(len(x)), pdf["n"].to_numpy(), [np.asarray(h, np.int64) for h in pdf["homes"]], home, threshold)
        some = (gained > 0) | (low != np.arange(len(x)))
        return pd.DataFrame({"cid": cid[some], "gained": gained[some], "low": cid[low[some]]})

    cols = ["cid", *key, "vec", "n", "homes"]
    found = spots.join(crowd, key, "left_anti").select(cols).groupBy(*key).applyInPandas(within, FOUND)
    found = scratch.save("found", found)
    if not crowd.isEmpty():
        found = found.union(crowded(spots.join(crowd, key).select(*cols, "count"), scratch, threshold, wide))
    stars = components(spark, found.select(F.col("cid").alias("u"), F.col("low").alias("v")), scratch)
    gained = found.groupBy("cid").agg(F.sum("gained").alias("gained"))
    named = classes.select("cid", "label", "vec", "n", "low").join(gained, "cid", "left").join(stars.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component"))
    named = named.join(lowest, "root").select("label", "vec", (F.col("n") - 1 + F.coalesce("gained", F.lit(0))).alias("n_links"), "component", F.lit(True).alias("sound"))
    out = v.join(named, ["sound", "label", "vec"], "left")
    component = F.when(F.col("sound"), F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
