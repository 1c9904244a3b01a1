"""Sampling, batching and dispatch. Every order is by a seeded hash (or a column given), so reruns and retried tasks agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.operators.numbering import numbered


def hash_order(*cols: str, seed: int = 0) -> Column:
    return F.xxhash64(*cols, F.lit(seed))


def subset(df: DataFrame, ratio: float, key: str, seed: int = 0, order: Column | None = None) -> DataFrame:
    """Exactly int(ratio * n) rows, the lowest by hash, or by a number given."""
    d = numbered(df, key, hash_order(key, seed=seed) if order is None else order, "_n", "_all")
    return d.where(F.col("_n") < F.floor(F.col("_all") * ratio)).drop("_n", "_all")


def aspect_flag(df: DataFrame, w: str = "width", h: str = "height") -> DataFrame:
    return df.withColumn("flag", F.when(F.col(w) / F.nullif(F.col(h).cast("double"), F.lit(0.0)) > 1, 1).otherwise(0))


def grouped_batches(df: DataFrame, group: str, size: int, key: str, order: Column | None = None, batch_order: Column | None = None, seed: int = 0) -> DataFrame:
    """Full batches of rows of one group: shuffled inside, the rest dropped, batches shuffled (``batch_rank`` is their order; ``slot`` the place)."""
    o = hash_order(key, seed=seed) if order is None else order
    d = numbered(df, key, o, "_r", by=[group])
    d = d.withColumn("batch", F.floor(F.col("_r") / size)).withColumn("slot", (F.col("_r") % size).cast("int"))
    full = F.count("*").over(Window.partitionBy(group, "batch")) == size
    d = d.withColumn("_full", full).where("_full").drop("_full", "_r")
    b = hash_order(group, "batch", seed=seed + 1) if batch_order is None else batch_order
    heads = d.where("slot = 0").select(group, "batch", b.alias("_b"), F.struct(group, "batch").alias("_k"))
    ranks = numbered(heads, "_k", F.col("_b"), "batch_rank").drop("_b", "_k")
    return d.join(ranks, [group, "batch"])


def padded_group_batches(df: DataFrame, group: str, size: int, key: str, order: Column | None = None, seed: int = 0) -> DataFrame:
    """As grouped_batches, but each group is filled up to whole batches with its own rows again (from its start, cycling)."""
    o = hash_order(key, seed=seed) if order is None else order
    d = numbered(df, key, o, "_r", "_n", by=[group])
    total = F.ceil(F.col("_n") / size) * size
    # row r of n fills the places r, r+n, r+2n, ... below the total
    d = d.withColumn("pos", F.explode(F.sequence(F.col("_r"), (total - 1).cast("long"), F.col("_n"))))
    return d.withColumn("batch", F.floor(F.col("pos") / size)).withColumn("slot", (F.col("pos") % size).cast("int")).drop("_r", "_n")


def distributed_group(df: DataFrame, group: str, size: int, ranks: int, key: str, epoch: int = 0, seed: int = 0, order: Column | None = None) -> DataFrame:
    """Groups filled to whole batches on every rank; a rank takes a contiguous stretch (``rank``, ``rank_pos``)."""
    d = padded_group_batches(df, group, size * ranks, key, order, seed + epoch).drop("batch", "slot")
    d = d.withColumn("_b", F.floor(F.col("pos") / size))
    heads = d.select(group, "_b").distinct()
    if order is None:
        heads = numbered(heads.withColumn("_k", F.struct(group, "_b")), "_k", hash_order(group, "_b", seed=seed + epoch + 1), "_br", "_all").drop("_k")
    else:
        # groups in their own order: one row per group says where its batches start
        n = heads.groupBy(group).agg(F.count("*").alias("_n"))
        n = n.select(group, (F.sum("_n").over(Window.orderBy(group)) - F.col("_n")).alias("_at"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_all"))
        heads = heads.join(n, group).withColumn("_br", F.col("_at") + F.col("_b")).drop("_at")
    d = d.join(heads, [group, "_b"])
    per = F.col("_all") * size / ranks
    d = d.withColumn("_g", F.col("_br") * size + F.col("pos") % size)
    return d.withColumn("rank", F.floor(F.col("_g") / per).cast("int")).withColumn("rank_pos", (F.col("_g") % per).cast("long")).drop("_b", "_br", "_g", "_all", "pos")


def distributed_stride(df: DataFrame, ranks: int, key: str, order: Column | None = None, epoch: int = 0, seed: int = 0) -> DataFrame:
    """Cycled up to a multiple of ``ranks``; rank takes every ``ranks``-th row."""
    o = hash_order(key, seed=seed + epoch) if order is None else order
    d = numbered(df, key, o, "_r", "_n")
    total = F.ceil(F.col("_n") / ranks) * ranks
    d = d.withColumn("pos", F.explode(F.sequence(F.col("_r"), (total - 1).cast("long"), F.col("_n"))))
    return d.withColumn("rank", (F.col("pos") % ranks).cast("int")).withColumn("rank_pos", F.floor(F.col("pos") / ranks)).drop("_r", "_n", "pos")


def epochs(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def refill(good: DataFrame, group: str, want: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Exactly ``want`` (group, n) rows of each group from the rows that did not fail, repeating them in hash order if need be."""
    d = numbered(good, key, hash_order(key, seed=seed), "_r", "_n", by=[group]).join(want.withColumnRenamed("n", "_want"), group)
    d = d.where(F.col("_r") < F.col("_want"))
    return d.withColumn("pos", F.explode(F.sequence(F.col("_r"), F.col("_want") - 1, F.col("_n")))).drop("_r", "_n", "_want")


def pad_batch(df: DataFrame, batch: list[str], arrays: dict[str, int], mask_of: str | None = None) -> DataFrame:
    """Arrays padded to their longest in the batch, each with its own value; ``attention_mask`` is where ``mask_of`` is not padding."""
    w = Window.partitionBy(*batch)
    for name, pad in arrays.items():
        df = df.withColumn(name, F.concat(F.col(name), F.array_repeat(F.lit(pad), F.max(F.size(name)).over(w) - F.size(name))))
    return df.withColumn("attention_mask", F.transform(mask_of, lambda x: (x != arrays[mask_of]))) if mask_of else df


def collate(df: DataFrame, batch: list[str], order: str) -> DataFrame:
    """Batch rows as arrays in order, by each column's policy in its metadata: ``pad`` pads arrays first."""
    pads = {f.name: f.metadata["pad"] for f in df.schema.fields if "pad" in (f.metadata or {})}
    d = pad_batch(df, batch, pads)
    cols = [c for c in d.columns if c not in batch]
    rows = F.array_sort(F.collect_list(F.struct(order, *[c for c in cols if c != order])))
    g = d.groupBy(*batch).agg(rows.alias("_rows"))
    part = lambda c: F.transform("_rows", lambda r: r[c]).alias(c)
    return g.select(*batch, *map(part, cols))


def single_source(df: DataFrame, batch: list[str], source: str = "source") -> DataFrame:
    """The rows; reading fails if a batch mixes sources."""
    w = Window.partitionBy(*batch)
    ok = F.min(source).over(w) == F.max(source).over(w)
    return df.withColumn("_ok", ok).where(F.when(F.col("_ok"), True).otherwise(F.raise_error(F.lit("a batch mixes sources")).cast("boolean"))).drop("_ok")


def some_labels(df: DataFrame, by: list[str], label: str, k: int = 3, order: Column | None = None, seed: int = 0) -> DataFrame:
    """``k`` labels of each group in seeded order."""
    o = hash_order(label, seed=seed) if order is None else order
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(o, label))).where(F.col("_r") <= k).drop("_r")


#: Cells of [0, 1) in which requests meet workers.
CELLS = 1024


def lottery(workers: DataFrame, requests: DataFrame, speed: str = "speed", worker: str = "worker", request: str = "request", seed: int = 0, draw: Column | None = None) -> DataFrame:
    """Each request's worker, drawn in proportion to speed: cumulative shares, and a hash in [0, 1), or a column ``draw``, that falls into
    one. Both sides meet in equal cells of [0, 1), so it is an equi-join."""
    run = Window.orderBy(worker).rowsBetween(Window.unboundedPreceding, 0)  # workers are a small table: one row each
    w = workers.withColumn("_hi", F.sum(speed).over(run)).withColumn("_all", F.sum(speed).over(Window.partitionBy(F.lit(0))))
    w = w.select(worker, ((F.col("_hi") - F.col(speed)) / F.col("_all")).alias("_lo"), (F.col("_hi") / F.col("_all")).alias("_hi"))
    w = w.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") * CELLS), F.least(F.floor(F.col("_hi") * CELLS), F.lit(CELLS - 1)))))
    u = F.pmod(F.xxhash64(request, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) if draw is None else draw
    d = requests.withColumn("_u", u).withColumn("_cell", F.floor(F.col("_u") * CELLS))
    return d.join(w, "_cell").where((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi"))).drop("_u", "_lo", "_hi", "_cell")


def shortest_queue(workers: DataFrame, by: list[str], queue: str = "queue_length", speed: str = "speed", worker: str = "worker") -> DataFrame:
    return workers.groupBy(*by).agg(F.min_by(worker, F.struct(F.col(queue) / F.nullif(F.col(speed).cast("double"), F.lit(0.0)), F.col(worker))).alias(worker))


#: Positions per cell in which items meet parts.
STRETCH = 64


def chunk_by_lengths(items: DataFrame, lengths: DataFrame, pos: str = "pos", part: str = "part", length: str = "length") -> DataFrame:
    """Items with the part they belong to, parts following each other with the lengths given. Both sides meet in stretches of
    positions, so it is an equi-join."""
    l = numbered(lengths, part, name="_i", value=length, before="_lo").withColumn("_hi", F.col("_lo") + F.col(length)).where(F.col("_hi") > F.col("_lo"))  # noqa: E741
    l = l.select(part, "_lo", "_hi", F.explode(F.sequence(F.floor(F.col("_lo") / STRETCH), F.floor((F.col("_hi") - 1) / STRETCH))).alias("_cell"))  # noqa: E741
    d = items.withColumn("_cell", F.floor(F.col(pos) / STRETCH)).join(l, "_cell")
    return d.where((F.col(pos) >= F.col("_lo")) & (F.col(pos) < F.col("_hi"))).withColumn("at", F.col(pos) - F.col("_lo")).drop("_lo", "_hi", "_cell")
