"""Consensus scores of captions against references (an extension: the inventory calls such scores external).

A caption and a reference are vectors of n-grams (1 to 4 words), each weighted by its count and by how few items' references hold it over the whole
corpus. Their likeness clips the caption's weights at the reference's, so repeating words gains nothing, and falls with the difference of lengths.

There are four n-grams to a word and most of them are held once, so a row for each costs many times the texts. Items are dealt to blocks of a bounded
number of characters instead. A block sends its distinct n-grams to buckets as sorted 80-bit hashes, about 8 bytes each, with the number of its items
that hold them; a bucket sends back the sums in the block's order, without the n-grams; the block then scores its items alone. Among a thousand million
n-grams two share a hash with a chance of one in two million. An item larger than a block is dealt to several by reference, and counts once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.session import reachable

#: Fixed values of the score: longest n-gram, spread of the length penalty, scale.
N, SIGMA, SCALE = 4, 6.0, 10.0
#: Characters of text in a block, about.
BLOCK = 1 << 21
#: Odd constants that stir the two halves of a hash.
STIR = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}']+"), "")


def _stirred(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _planes(a: np.ndarray) -> bytes:
    """Numbers as bytes, all first bytes first: what is equal lies together and is packed by the shuffle."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _numbers(b: bytes, kind: type) -> np.ndarray:
    k = np.dtype(kind).itemsize
    return np.frombuffer(b, np.uint8).reshape(k, -1).T.copy().view(kind).ravel()


def _packed(high: np.ndarray, low: np.ndarray) -> bytes:
    """Sorted hashes: steps between their 64 high bits, and 16 low ones."""
    return _planes(np.diff(high, prepend=np.uint64(0))) + _planes(low)


def _unpacked(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(b) // 10
    return np.cumsum(_numbers(b[: 8 * n], np.uint64), dtype=np.uint64), _numbers(b[8 * n :], np.uint16)


def _codes(a: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    d = a.combine_chunks().dictionary_encode("encode")
    d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


class _Block:
    """The texts of a block: their distinct n-grams in order (``high``, ``low``), and for each place of one its n-gram (``gram``) and text (``text``)."""

    def __init__(self, t: pa.Table):
        a, b = (t[c].combine_chunks() for c in ("_a", "_b"))
        self.length = np.diff(a.offsets.to_numpy()).astype(np.int64)
        w = [x.flatten().to_numpy(zero_copy_only=False).view(np.uint64) for x in (a, b)]
        of = np.repeat(np.arange(len(self.length)), self.length)
        left = np.repeat(np.cumsum(self.length), self.length) - np.arange(len(of))  # words from here to the end of the text
        h, high, low, text, size = [np.zeros(len(of), np.uint64)] * 2, [], [], [], []
        for n in range(1, N + 1):
            k = max(len(of) - n + 1, 0)
            h = [_stirred(x[:k] * np.uint64(c) + y[n - 1 :] + np.uint64(n)) for x, y, c in zip(h, w, STIR, strict=True)]
            ok = left[:k] >= n
            high.append(h[0][ok])
            low.append((h[1][ok] >> np.uint64(48)).astype(np.uint16))
            text.append(of[:k][ok])
            size.append(np.full(len(text[-1]), n - 1, np.int8))
        high, low, self.text, size = (np.concatenate(x) for x in (high, low, text, size))
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        new = np.ones(len(order), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        self.high, self.low, self.size = high[new], low[new], size[order][new]
        self.gram = np.empty(len(order), np.int64)
        self.gram[order] = np.cumsum(new) - 1
        self.item, self.items = _codes(t["_item"])
        self.caption = t["_caption"].to_numpy()


def _sent(t: pa.Table, buckets: int) -> Iterator[tuple]:
    """(bucket, owner, block, hashes, counts): a block's n-grams with how many items' references hold them, for each bucket; those of an item
    that lies in several blocks are listed apart, owned by that item and without counts."""
    b, block = _Block(t), t["_block"][0].as_py()
    n, m, whole = len(b.high), max(len(b.items), 1), t["_big"].to_numpy()
    held = ~b.caption[b.text]
    pair = np.unique(b.gram[held] * m + b.item[b.text[held]])
    big = np.full(m, -1, np.int64)
    big[b.item] = whole
    own = big[pair % m]
    lists = [(block, block, np.arange(n), np.bincount(pair[own < 0] // m, minlength=n).astype(np.uint32))]
    lists += [(-1 - int(k), -1, pair[own == k] // m, None) for k in np.unique(own[own >= 0])]
    for owner, back, grams, counts in lists:
        high, low = b.high[grams], b.low[grams]
        cut = np.searchsorted(((high >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(cut)):
            at = slice(cut[k], cut[k + 1])
            yield int(k), owner, back, _packed(high[at], low[at]), None if counts is None else _planes(counts[at])


SENT = pa.schema([("bucket", pa.int32()), ("owner", pa.int32()), ("_block", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
BACK = pa.schema([("_block", pa.int32()), ("bucket", pa.int32()), ("df", pa.binary())])


def _summed(t: pa.Table) -> pa.Table:
    """A bucket's n-grams: to each block that sent some, how many items hold them, in the order in which it sent them."""
    rows = list(zip(*(t[c].to_pylist() for c in SENT.names), strict=True))
    parts = [_unpacked(r[3]) for r in rows]
    sizes = [len(p[0]) for p in parts]
    high, low = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    owner = np.repeat(np.array([r[1] for r in rows], np.int64), sizes)
    counts = np.concatenate([np.ones(n, np.int64) if r[4] is None else _numbers(r[4], np.uint32) for r, n in zip(rows, sizes, strict=True)])
    order = np.lexsort((owner, low, high))
    high, low, owner = high[order], low[order], owner[order]
    new = np.ones(len(order), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    again = np.zeros(len(order), bool)  # an item's n-gram from another of its blocks
    again[1:] = ~new[1:] & (owner[1:] == owner[:-1])
    df = np.add.reduceat(np.where(again, 0, counts[order]), np.flatnonzero(new))
    out = np.empty(len(order), np.uint32)
    out[order] = df[np.cumsum(new) - 1]
    ends = np.cumsum(sizes)
    back = [(r[2], r[0], _planes(out[e - n : e])) for r, e, n in zip(rows, ends, sizes, strict=True) if r[2] >= 0]
    return pa.table({f.name: pa.array([r[k] for r in back], f.type) for k, f in enumerate(BACK)}, schema=BACK)


def _scored(t: pa.Table, back: pa.Table, items: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The block's items, how many references they have in it, and the sum of their likenesses over these and over lengths of n-grams."""
    b = _Block(t)
    df = [_numbers(x, np.uint32) for x in back.sort_by("bucket")["df"].to_pylist()] if back.num_rows else []
    df = np.concatenate(df) if df else np.zeros(0, np.uint32)
    if len(df) != len(b.high):
        raise ValueError(f"{len(df)} sums for {len(b.high)} n-grams")
    known, at = np.unique(np.maximum(df, 1), return_inverse=True)
    logs = np.array([math.log(max(items, 1)) - math.log(k) for k in known.tolist()])
    weight = logs[at]
    # vectors are items' captions and references; texts of one vector count together, apart by their lengths
    ref, _ = _codes(t["_ref"])
    _, vector = np.unique(np.stack([b.item, b.caption, np.where(b.caption, 0, ref)]), axis=1, return_inverse=True)
    _, head, unit = np.unique(np.stack([vector.ravel(), b.length]), axis=1, return_index=True, return_inverse=True)
    vector, unit = vector.ravel(), unit.ravel()
    of, item, caption, length = vector[head], b.item[head], b.caption[head], b.length[head]
    n, vectors = max(len(b.high), 1), int(vector.max()) + 1
    key, tf = np.unique(unit[b.text] * n + b.gram, return_counts=True)
    u, g = key // n, key % n
    w = tf * weight[g]
    cell = of[u] * N + b.size[g]
    norm = np.sqrt(np.bincount(cell, w * w, vectors * N))
    total = np.zeros(len(b.items))
    ours = ~caption[u]
    u, g, w, cell = u[ours], g[ours], w[ours], cell[ours]
    caps = np.flatnonzero(caption)
    caps = caps[np.argsort(item[caps], kind="stable")]
    turn = np.arange(len(caps)) - np.searchsorted(item[caps], item[caps])  # one length to an item's caption, unless it was given twice
    dot, gap, mine = np.zeros(vectors * N), np.full(vectors * N, np.nan), np.full(vectors, -1)
    for k in range(int(turn.max()) + 1 if len(caps) else 0):
        unit_of = np.full(len(b.items), -1)
        unit_of[item[caps[turn == k]]] = caps[turn == k]
        c = unit_of[item[u]]
        find = c * n + g
        place = np.minimum(np.searchsorted(key, find), len(key) - 1)
        hit = (c >= 0) & (key[place] == find)
        theirs = tf[place] * weight[g]
        dot += np.bincount(cell[hit], (np.minimum(theirs, w) * w)[hit], vectors * N)
        first = hit & np.isnan(gap[cell])
        gap[cell[first]] = length[c[first]] - length[u[first]]
        mine[of[unit_of[item] >= 0]] = of[unit_of[item[unit_of[item] >= 0]]]
    v = np.arange(vectors * N) // N
    both = norm * np.where(mine[v] >= 0, norm[mine[v] * N + np.arange(vectors * N) % N], 0)
    like = np.where(both > 0, dot / np.where(both > 0, both, 1), 0) * np.exp(-np.nan_to_num(gap) ** 2 / (2 * SIGMA * SIGMA))
    item_of = np.zeros(vectors, np.int64)
    item_of[of] = item
    total += np.bincount(item_of[v], like, len(b.items))
    return b.items, np.bincount(b.item[~b.caption], minlength=len(b.items)), total


def consensus(captions: DataFrame, references: DataFrame, item: str = "image_id", ref: str = "ref_idx", text: str = "text") -> DataFrame:
    """(item, n_refs, score): of each item's caption (one row) against its references (any number, told apart by ``ref``).

    Items that are null or have no reference are left out; a caption, or reference, without words scores 0 against any other; null texts have none."""
    spark = captions.sparkSession
    reachable(spark)
    c = captions.select(F.col(item).alias("_item"), F.lit(None).cast(references.schema[ref].dataType).alias("_ref"), F.lit(True).alias("_caption"), F.col(text).alias("_text"))
    r = references.select(F.col(item).alias("_item"), F.col(ref).alias("_ref"), F.lit(False).alias("_caption"), F.col(text).alias("_text"))
    t = c.unionByName(r).where("_item IS NOT NULL")
    sizes = t.groupBy("_item").agg(F.bool_or(~F.col("_caption")).alias("_has"), F.sum(F.coalesce(F.length("_text"), F.lit(0)) + 1).alias("_n"))
    items, chars, most = sizes.agg(F.count_if("_has"), F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    blocks = max(1, math.ceil(chars / BLOCK))
    # items larger than a block: fewer than there are blocks
    big = [x["_item"] for x in sizes.where(F.col("_n") > BLOCK).select("_item").collect()] if most > BLOCK else []
    which = F.coalesce(F.create_map(*(F.lit(x) for k, v in enumerate(big) for x in (v, k)))[F.col("_item")], F.lit(-1)) if big else F.lit(-1)
    salts = math.ceil(most / BLOCK)
    salt = F.when(F.col("_big") < 0, F.array(F.lit(0))).when(F.col("_caption"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.pmod(F.xxhash64("_ref"), F.lit(salts)).cast("int")))
    t = t.withColumn("_big", which)
    t = t.withColumn("_salt", F.explode(salt)) if big else t.withColumn("_salt", F.lit(0))
    # salts are no more than blocks, so an item's caption comes to a block once
    t = t.withColumn("_block", F.pmod(F.pmod(F.xxhash64("_item"), F.lit(blocks)) + F.col("_salt"), F.lit(blocks)).cast("int")).drop("_salt").repartition(blocks, "_block")
    # a word is two hashes of 64 bits, worked out where the text has come to
    hashed = lambda f: F.transform("_w", f)
    t = t.withColumn("_w", words(F.col("_text"))).select("_block", "_item", "_ref", "_caption", "_big", hashed(lambda x: F.xxhash64(x)).alias("_a"), hashed(lambda x: F.xxhash64(F.lit(1), x)).alias("_b"))

    def sent(t: pa.Table) -> pa.Table:
        rows = list(_sent(t, blocks))
        return pa.table({f.name: pa.array([r[k] for r in rows], f.type) for k, f in enumerate(SENT)}, schema=SENT)

    kind = t.schema["_item"].dataType.simpleString()

    def scored(t: pa.Table, back: pa.Table) -> pa.Table:
        if not t.num_rows:
            raise ValueError("sums for a block without texts")
        who, n, v = _scored(t, back, items)
        return pa.table({"_item": who, "_refs": pa.array(n, pa.int64()), "_sum": pa.array(v, pa.float64())}).filter(pa.array(n > 0))

    up = t.groupBy("_block").applyInArrow(sent, "bucket int, owner int, _block int, hashes binary, counts binary")
    back = up.repartition(blocks, "bucket").groupBy("bucket").applyInArrow(_summed, "_block int, bucket int, df binary").repartition(blocks, "_block")
    parts = t.groupBy("_block").cogroup(back.groupBy("_block")).applyInArrow(scored, f"_item {kind}, _refs long, _sum double")
    total = parts.groupBy(F.col("_item").alias(item)).agg(F.sum("_refs").alias("n_refs"), F.sum("_sum").alias("_sum"))
    return captions.select(item).join(total.hint("merge"), item).select(item, "n_refs", (SCALE * F.col("_sum") / (N * F.col("n_refs"))).alias("score"))
