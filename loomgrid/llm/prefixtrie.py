"""Prefix trie of conversations from the Cartesian tree over their sorted order.

Distinct conversations are sorted as sequences of turns; lcp(i) is how many first turns sequence i shares with the one before. Nearest smaller
values of lcp on both sides make the Cartesian tree: position p stands for the node of depth lcp(p) over the sequences from the nearest
smaller value on the left to just before that on the right. They are found in parallel: inside blocks by a stack, and what a block leaves open by
the minima of the blocks: the nearest block with a smaller minimum, then the staircase of its suffix (prefix) minima. Positions of equal lcp
and equal interval merge into one node; the sequences' own ends are nodes too; depths between a node and its parent are expanded, as all have the
node's interval. Aggregates over an interval are differences of running sums, and minima from the same blocks.
In the order (first sequence, depth) a subtree is a stretch, so sums over subtrees are differences as well.

Every turn is its SHA-256 and its length from the first step on, so texts never move. A sequence is kept in chunks of ``CHUNK`` turns; long ones
are ordered by prefix doubling over the ranks of their chunks, so no conversation is gathered in one row or task, however long, and
copies are one sequence with a weight. Ids of a group of copies are joined in stretches of ``STRETCH``; only the hash over them, which is
sequential by nature, reads a group's stretches one after the other in one task, as a stream. A block is at most a ``BLOCKS``-th
of the positions (4,096 at least), so what the driver sees, a minimum for each block, is bounded.

Defined cases: rows without a conv_id belong to no conversation; a null turn comes first; turns of equal number are ordered by the hash of role
and text; repeated rows are turns of their own; null role or text is empty; a conversation without turns (after rebuilding) is a member of the root alone;
an empty table has no nodes, not even a root; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm.common import Scratch, tune, workers
from loomgrid.operators.numbering import numbered

CHUNK = 64
STRETCH = 4096
LEAST_BLOCK, BLOCKS = 4096, 16384
#: Fixed values of the rebuilding: conversations of a hundred share the first turns of its first.
FAMILY, SHARED = 100, 6
NONE = np.iinfo(np.int64).max


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, turn, key, length): a turn's identity and its text's code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", key.alias("key"), F.char_length(text).cast("long").alias("length"))


def rebuilt(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, at, key, length): turns of the rebuilt conversations, from at = 1; at = 0, a turn without text, is in each of them."""
    own = numbered(turns(conversations).withColumn("_tie", F.struct("key", "length")), "_tie", F.col("turn"), "at", by=["conv"]).drop("_tie", "turn")
    own = scratch.save("turns", own)
    c = own.groupBy("conv").agg(F.count("*").alias("size"))
    c = c.withColumn("h", (F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED)).withColumn("base", F.col("conv") - F.col("conv") % FAMILY)
    heads = own.where(F.col("at") < SHARED).select(F.col("conv").alias("base"), "at", "key", "length")  # fewer than SHARED rows of a conversation
    taken = c.join(heads, "base").where("at < h").select("conv", (F.col("at") + 1).alias("at"), "key", "length")
    n_base = heads.groupBy("base").agg(F.count("*").alias("n_base"))
    shift = c.join(n_base, "base", "left").select("conv", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken"))
    rest = own.join(shift, "conv").where("at >= h").select("conv", (F.col("at") - F.col("h") + F.col("taken") + 1).alias("at"), "key", "length")
    root = c.select("conv", F.lit(0).cast("long").alias("at"), F.lit(b"").alias("key"), F.lit(0).cast("long").alias("length"))
    return root.unionByName(taken).unionByName(rest)


def chunks(rows: DataFrame) -> DataFrame:
    """(conv, j, keys, lengths, id): up to CHUNK turns each, in order."""
    g = rows.groupBy("conv", F.expr(f"at div {CHUNK}").alias("j")).agg(F.array_sort(F.collect_list(F.struct("at", "key", "length"))).alias("x"))
    keys = F.transform("x", lambda r: r.key)
    return g.select("conv", "j", keys.alias("keys"), F.transform("x", lambda r: r.length).alias("lengths"), F.sha2(F.array_join(F.transform(keys, F.hex), ",").cast("binary"), 256).alias("id"))


def ranked(distinct: DataFrame, *order: str) -> DataFrame:
    """Rows, which differ in ``order``, numbered from 1 in that order."""
    return numbered(distinct.withColumn("_key", F.struct(*order)), "_key", name="rank").withColumn("rank", F.col("rank") + 1).drop("_key")


def sorted_sequences(parts: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, i): each conversation's place, from 1, among the distinct sequences in lexicographic order."""
    first = scratch.save("ranks", ranked(parts.groupBy("id").agg(F.first("keys").alias("keys")), "keys").select("id", "rank"))
    r = scratch.save("level", parts.select("conv", "j", "id").join(first, "id").select("conv", "j", "rank"))
    while r.agg(F.max("j")).first()[0]:
        half = lambda k: F.coalesce(F.max(F.when(F.col("j") % 2 == k, F.col("rank"))), F.lit(0))  # noqa: E731  a missing half comes first
        pair = r.groupBy("conv", F.expr("j div 2").alias("j")).agg(half(0).alias("a"), half(1).alias("b"))
        places = ranked(pair.select("a", "b").distinct(), "a", "b")
        r = scratch.save("level", pair.join(places, ["a", "b"]).select("conv", "j", "rank"))
    return r.select("conv", F.col("rank").alias("i"))


def common(a: Column, b: Column) -> Column:
    """How many first elements are equal."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(at > 0, at - 1).otherwise(F.size(a)).cast("long")


def lcps(parts: DataFrame) -> DataFrame:
    """(i, v): shared first elements of sequences i - 1 and i, of (i, j, keys)."""
    before = parts.select((F.col("i") + 1).alias("i"), "j", F.col("keys").alias("before"))
    both = parts.select("i", "j", "keys").join(before, ["i", "j"]).select("i", "j", common(F.col("keys"), F.col("before")).alias("n"))
    differs = F.min(F.when(F.col("n") < CHUNK, F.col("j") * CHUNK + F.col("n")))
    return both.groupBy("i").agg(F.coalesce(differs, F.count("*") * CHUNK).alias("v"))


class Least:
    """Least values over stretches of an array, and the nearest smaller value before or after a place, from the minima of all stretches whose
    lengths are powers of two."""

    def __init__(self, x: np.ndarray):
        self.at = [np.asarray(x, np.int64)]
        while 2 << (len(self.at) - 1) <= len(x):
            last, half = self.at[-1], 1 << (len(self.at) - 1)
            self.at.append(np.minimum(last[:-half], last[half:]))

    def over(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least of each stretch from lo to hi, both included; NONE where hi < lo."""
        out = np.full(len(lo), NONE, np.int64)
        level = np.where(hi >= lo, np.log2(np.maximum(hi - lo + 1, 1)).astype(np.int64), -1)
        for k, m in enumerate(self.at):
            w = np.flatnonzero(level == k)
            out[w] = np.minimum(m[lo[w]], m[hi[w] + 1 - (1 << k)])
        return out

    def before(self, p: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The last place before p whose value is below v (-1: none)."""
        p = p.copy()
        for k in reversed(range(len(self.at))):
            w = np.flatnonzero(p >= 1 << k)
            w = w[self.at[k][p[w] - (1 << k)] >= v[w]]
            p[w] -= 1 << k
        return p - 1

    def after(self, p: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The first place after p whose value is below v (the length: none)."""
        p, n = p + 1, len(self.at[0])
        for k in reversed(range(len(self.at))):
            w = np.flatnonzero(p + (1 << k) <= n)
            w = w[self.at[k][p[w]] >= v[w]]
            p[w] += 1 << k
        return p


def nearest_smaller(v: np.ndarray) -> np.ndarray:
    """For each place the last place before it of a smaller value (-1: none), by a stack."""
    out, stack = np.empty(len(v), np.int64), []
    for p, x in enumerate(v.tolist()):
        while stack and stack[-1][1] >= x:
            stack.pop()
        out[p] = stack[-1][0] if stack else -1
        stack.append((p, x))
    return out


def in_block(b: pd.DataFrame) -> pd.DataFrame:
    """A block's own nearest smaller values (null where they lie outside), the least id over what it holds of each position's interval, and over
    the block from the position on (``suf``) and before it (``pre``)."""
    b = b.sort_values("i")
    i, v, m = (b[c].to_numpy(np.int64) for c in ("i", "v", "m"))
    n = len(v)
    left, right = nearest_smaller(v), n - 1 - nearest_smaller(v[::-1])[::-1]
    low = Least(m).over(np.maximum(left, 0), np.minimum(right, n) - 1)
    suf = np.minimum.accumulate(m[::-1])[::-1]
    pre = np.concatenate([[NONE], np.minimum.accumulate(m)[:-1]])
    place = lambda x, ok: pd.Series(i[np.clip(x, 0, n - 1)]).astype("Int64").where(ok)
    return pd.DataFrame({"block": b["block"].to_numpy(), "i": i, "v": v, "left": place(left, left >= 0), "right": place(right, right < n), "low": low, "suf": suf, "pre": pre})


def nearest(p: DataFrame, scratch: Scratch) -> DataFrame:
    """(i, v, left, right, low) of positions (i, block, v, m), of which the first and the last hold the only zeros: nearest smaller values on
    both sides, and the least m from the left one to before the right one."""
    spark = p.sparkSession
    t = p.select("block", "i", "v", "m").groupBy("block").applyInPandas(in_block, "block bigint, i bigint, v bigint, left bigint, right bigint, low bigint, suf bigint, pre bigint")
    t = scratch.save("blocks", t)
    sums = p.groupBy("block").agg(F.min("v").alias("v"), F.min("m").alias("m")).orderBy("block").collect()  # BLOCKS + 1 rows at most
    shared = spark.sparkContext.broadcast((Least(np.array([r.v for r in sums])), Least(np.array([r.m for r in sums]))))

    def target(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values, ids = shared.value
        for b in batches:
            own, v = b["block"].to_numpy(np.int64), b["v"].to_numpy(np.int64)
            ahead = b["side"].to_numpy() == 1
            there = np.where(ahead, values.after(own, v), values.before(own, v))
            skipped = ids.over(np.where(ahead, own, there) + 1, np.where(ahead, there, own) - 1)
            yield pd.DataFrame({"i": b["i"], "side": b["side"], "v": v, "block": there, "skipped": skipped})

    inner = F.col("v") > 0
    gaps = t.where(inner & F.col("left").isNull()).select("i", "v", "block", F.lit(0).alias("side")).union(t.where(inner & F.col("right").isNull()).select("i", "v", "block", F.lit(1).alias("side")))
    gaps = scratch.save("gaps", gaps.mapInPandas(target, "i bigint, side int, v bigint, block bigint, skipped bigint"))
    nothing = F.lit(None).cast("struct<k:bigint,i:bigint,part:bigint>")
    asked = gaps.select("side", "block", "v").distinct().select("side", "block", "v", F.lit(0).alias("kind"), nothing.alias("step"))
    # a block's last value below v is on its staircase of suffix minima, the first on that of prefix minima
    step = lambda side, k, part: F.struct(k.alias("k"), F.col("i"), F.col(part).alias("part")).alias("step")
    down = t.where("right is null").select(F.lit(0).alias("side"), "block", "v", F.lit(1).alias("kind"), step(0, -F.col("i"), "suf"))
    up = t.where("left is null").select(F.lit(1).alias("side"), "block", "v", F.lit(1).alias("kind"), step(1, F.col("i"), "pre"))
    below = Window.partitionBy("side", "block").orderBy("v", "kind").rowsBetween(Window.unboundedPreceding, 0)
    told = asked.union(down).union(up).withColumn("best", F.min("step").over(below)).where("kind = 0").select("side", "block", "v", "best")
    got = gaps.join(told, ["side", "block", "v"]).select("side", "i", F.col("best.i").alias("there"), F.least("skipped", "best.part").alias("more"))
    for side, name in ((0, "left"), (1, "right")):
        t = t.join(got.where(F.col("side") == side).select("i", F.col("there").alias(f"{name}_there"), F.col("more").alias(f"{name}_more")), "i", "left")
    return t.select("i", "v", F.coalesce("left", "left_there").alias("left"), F.coalesce("right", "right_there").alias("right"), F.least("low", "left_more", "right_more").alias("low"))


def running(p: DataFrame, *cols: str) -> DataFrame:
    """``p`` (i, block, ...) with each column's sum over the positions before, as ``<column>_before``."""
    up = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # over BLOCKS + 1 rows at most
    b = p.groupBy("block").agg(*(F.sum(c).alias(c) for c in cols)).select("block", *(F.coalesce(F.sum(c).over(up), F.lit(0)).alias(f"_{c}") for c in cols))
    w = Window.partitionBy("block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    p = p.join(F.broadcast(b), "block")
    return p.withColumns({f"{c}_before": F.col(f"_{c}") + F.sum(c).over(w) - F.col(c) for c in cols}).drop(*(f"_{c}" for c in cols))


def end_hashes(where: DataFrame) -> DataFrame:
    """(i, ends): SHA-256 over the ids of a sequence's conversations, of rows (conv, i)."""
    d = numbered(where, "conv", name="n", by=["i"])
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    d = d.groupBy("i", F.expr(f"n div {STRETCH}").alias("stretch")).agg(ids.alias("ids"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        for b in batches:
            done = []
            for i, ids in zip(b["i"].to_pylist(), b["ids"].to_pylist(), strict=True):
                if i != now:
                    if h:
                        done.append((now, h.hexdigest()))
                    now, h = i, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in done], pa.int64()), pa.array([x for _, x in done], pa.string())], ["i", "ends"])
        if h:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([h.hexdigest()])], ["i", "ends"])

    return d.repartition(workers(where.sparkSession), "i").sortWithinPartitions("i", "stretch").select("i", "ids").mapInArrow(stream, "i bigint, ends string")


DDL = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node."""
    spark = conversations.sparkSession
    tune(spark)
    scratch = Scratch(spark, "trie")
    parts = scratch.save("chunks", chunks(rebuilt(conversations, scratch)))
    where = scratch.save("sequences", sorted_sequences(parts, scratch))
    seqs = where.groupBy("i").agg(F.count("*").alias("w"), F.min("conv").alias("m"))
    seqs = scratch.save("weights", seqs)
    last = seqs.agg(F.max("i")).first()[0]
    if last is None:
        return spark.createDataFrame([], DDL)
    mine = scratch.save("parts", parts.join(seqs.select(F.col("m").alias("conv"), "i"), "conv").select("i", "j", "keys", "lengths"))
    lcp = scratch.save("lcp", lcps(mine))
    size = max(LEAST_BLOCK, -(-(last + 1) // BLOCKS))
    p = seqs.join(mine.groupBy("i").agg(F.sum(F.size("keys")).alias("own")), "i").join(lcp, "i", "left").join(lcp.select((F.col("i") - 1).alias("i"), F.col("v").alias("next")), "i", "left")
    p = p.select("i", F.coalesce("v", F.lit(0)).alias("v"), "w", "m", "own", (F.coalesce("next", F.lit(0)) < F.col("own")).cast("long").alias("leaf"))
    p = p.union(spark.range(1).select(F.lit(last + 1), F.lit(0), F.lit(0), F.lit(NONE), F.lit(0), F.lit(0)))
    p = scratch.save("positions", p.withColumn("block", F.expr(f"(i - 1) div {size}")))
    p = running(p, "w", "leaf").join(nearest(p, scratch).drop("v"), "i")
    p = scratch.save("tree", p)
    inner = p.where((F.col("v") > 0)).groupBy(F.col("left").alias("l"), F.col("v").alias("d")).agg(F.min("right").alias("r"), F.min("low").alias("id"), F.count("*").alias("n_equal"))
    ends = p.where("leaf = 1").select(F.col("i").alias("l"), F.col("own").alias("d"), (F.col("i") + 1).alias("r"), F.col("m").alias("id"), F.lit(0).cast("long").alias("n_equal"))
    side = lambda k: p.select(F.col("i").alias(k), F.col("v").alias(f"{k}_v"), F.col("low").alias(f"{k}_low"), F.col("w_before").alias(f"{k}_w"), F.col("leaf_before").alias(f"{k}_leaf"), F.col("own").alias(f"{k}_own"))
    n = inner.unionByName(ends).join(side("l"), "l").join(side("r"), "r")
    up = F.greatest("l_v", "r_v")
    children = F.when(F.col("n_equal") > 0, F.col("n_equal") + (F.col("l_own") > F.col("d")).cast("long")).otherwise(0)
    n = n.select("l", "r", "d", up.alias("up"), "id", F.when(F.col("l_v") >= F.col("r_v"), F.col("l_low")).otherwise(F.col("r_low")).alias("up_id"), (F.col("r_w") - F.col("l_w")).alias("n_convs"), (F.col("r_leaf") - F.col("l_leaf")).alias("n_leaves"), children.alias("n_children"), (F.col("l_own") == F.col("d")).alias("ends_here"))
    # a node's depths above those of its parent: elements up to d - 1 of its first sequence
    e = n.withColumn("j", F.explode(F.sequence(F.expr(f"up div {CHUNK}"), F.expr(f"(d - 1) div {CHUNK}"))))
    e = e.join(mine.select(F.col("i").alias("l"), "j", "lengths"), ["l", "j"]).select("*", F.posexplode("lengths").alias("pos", "length")).drop("lengths")
    e = e.withColumn("at", F.col("j") * CHUNK + F.col("pos")).where("at >= up and at < d")
    top, foot = F.col("at") == F.col("up"), F.col("at") == F.col("d") - 1
    e = e.select("l", "r", "at", "id", F.when(top & (F.col("at") > 0), F.col("up_id")).when(F.col("at") > 0, F.col("id")).alias("parent"), "n_convs", F.when(foot, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves", (foot & F.col("ends_here")).alias("ends_here"), ((F.col("n_convs") - 1) * F.col("length")).alias("saves"), F.struct("l", "at").alias("key"))
    e = scratch.save("nodes", numbered(e, "key", name="n", value="saves", before="before"))
    total = e.agg(F.sum("saves")).first()[0]
    starts = e.groupBy(F.col("l").alias("r")).agg(F.min("before").alias("stop"))
    e = e.join(starts, "r", "left").withColumn("saved", F.coalesce("stop", F.lit(total)) - F.col("before"))
    e = e.join(end_hashes(where).select(F.col("i").alias("l"), "ends"), "l", "left")
    nobody = hashlib.sha256(b"").hexdigest()
    return e.select(F.col("id").alias("conv_id"), F.col("at").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves", F.col("saved").cast("long").alias("saved_tokens"), F.when(F.col("ends_here"), F.col("ends")).otherwise(nobody).alias("ends_sha256"))


def oracle(table: str = "conversations") -> str:
    """The same in SQL: every prefix of every rebuilt conversation, grouped; the hash that rebuilds is written out bit by bit."""
    poly = 0xEDB88320
    step = f"CASE WHEN xor(c, b) % 2 = 1 THEN xor(c // 2, {poly}) ELSE c // 2 END"
    bits = "flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: list_transform(range(8), lambda k: (ascii(ch) >> k) % 2)))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform({bits}, lambda x: x::BIGINT)), lambda c, b: {step}), 4294967295)"
    return f"""
WITH o AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS ts FROM {table} WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, ts, CAST({crc} % {SHARED} AS BIGINT) AS h FROM o),
s AS (SELECT a.conv_id, list_concat(coalesce(b.ts, [])[1:a.h], a.ts[a.h + 1:]) AS ts FROM h a LEFT JOIN o b ON b.conv_id = a.conv_id - a.conv_id % {FAMILY}),
p AS (SELECT conv_id, len(ts) AS n, d, CAST(ts[1:d] AS VARCHAR) || d AS k, CAST(ts[1:d - 1] AS VARCHAR) || (d - 1) AS pk, coalesce(length(ts[d].text), 0) AS len FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM s)),
g AS (SELECT k, d, any_value(CASE WHEN d > 0 THEN pk END) AS pk, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(len) AS saves, sha256(coalesce(string_agg(CASE WHEN n = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM p GROUP BY k, d),
c AS (SELECT pk AS k, count(*) AS n FROM g WHERE pk IS NOT NULL GROUP BY pk),
x AS (SELECT DISTINCT a.k, b.k AS top FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.d >= b.d),
t AS (SELECT x.top AS k, sum(g.saves) AS saved, count(*) FILTER (c.n IS NULL) AS leaves FROM x JOIN g USING (k) LEFT JOIN c USING (k) GROUP BY x.top)
SELECT g.conv_id, g.d AS depth, u.conv_id AS parent_conv_id, g.n_convs, coalesce(c.n, 0) AS n_children, t.leaves AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, g.ends_sha256
FROM g LEFT JOIN c USING (k) JOIN t USING (k) LEFT JOIN g u ON u.k = g.pk
"""
