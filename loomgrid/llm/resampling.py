"""Quality classifier by importance resampling.

Hashed unigrams and bigrams of words give two generative models with additive smoothing: p of the target
texts (labelled as good) and q of all texts. A document's log weight is the sum of log p/q over its n-grams or, by
default, their mean times a reference length, so that short and long documents compare (``length``). Gumbel noise, seeded by document, turns the
``k`` largest of (log weight + noise) into a sample without replacement in proportion to the weights.

Both models are a fixed number of buckets however large the corpus; they are gathered by a sum per bucket
over partial sums of each task. q is counted in a plain scan; for p only the texts move that pass a Bloom filter of the target
ids, to meet these exactly. The k-th largest key is found exactly by counting keys by 16 bits at a time
(at most 65,536 counts each time), never by sorting all rows in one place.

Defined cases: null and empty texts have no n-grams, log weight -inf (stored as -1e30) and are selected last;
keys that tie at the threshold (only repeated rows can) are all selected; a document without a label takes
part in q only; a null doc_id is hashed as the empty text; an empty table gives an empty result; without any
target document, p is uniform.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import Bloom, Scratch, tune, utf8

BUCKETS = 1 << 14
MIX = 0x9E3779B1
#: n-grams of a reference document.
LENGTH = 128
CACHE = 300_000
EMPTY = -1e30


class Hasher:
    """32-bit hashes of words, cached."""

    def __init__(self):
        self.seen: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        got = list(map(self.seen.get, words))
        if None in got:
            if len(self.seen) > CACHE:
                self.seen = {}
            for i, w in enumerate(words):
                if got[i] is None:
                    got[i] = self.seen[w] = zlib.crc32(w)
        return np.array(got, np.uint64)


HASH = Hasher()


def grams(text: bytes) -> np.ndarray:
    """Bucket of every unigram and bigram, repeats included."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64)
    h = HASH(words)
    two = (h[:-1] * np.uint64(MIX) + h[1:]) & np.uint64(0xFFFFFFFF)
    both = np.concatenate([h, two])
    return ((both * np.uint64(MIX) & np.uint64(0xFFFFFFFF)) >> np.uint64(18)).astype(np.int64)


def count_buckets(rows: DataFrame) -> np.ndarray:
    """n-grams per bucket of rows (t binary); a task adds up its rows first, and at most BUCKETS rows are gathered."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                total += np.bincount(grams(t), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(BUCKETS)
    for r in rows.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def fit(docs: DataFrame, target: DataFrame, id_col: str, smooth: float = 0.5) -> np.ndarray:
    """log p/q per bucket, of rows (id, t binary) and the target's distinct ids."""
    known = Bloom(target.select(id_col))

    def pick(batches):
        for b in batches:
            yield b.filter(known.holds(b.column(2))).select([0, 1])

    rows = docs.where(F.col(id_col).isNotNull()).select(id_col, "t", F.xxhash64(id_col).alias("h"))
    moved = rows.mapInArrow(pick, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, t binary").join(target.hint("merge"), id_col, "left_semi")
    p, q = count_buckets(moved.select("t")), count_buckets(docs.select("t"))
    p, q = ((x + smooth) / (x.sum() + smooth * BUCKETS) for x in (p, q))
    return np.log(p / q)


def score(docs: DataFrame, id_col: str, text_col: str, ratio: np.ndarray, seed: int, length: int | None = LENGTH) -> DataFrame:
    """(id, n_grams, log_weight, gumbel_key, rank_bits): rank_bits orders as the key does, as a long."""

    def run(batches):
        for b in batches:
            n, w = [], []
            for t in b.column(1).to_pylist():
                g = grams(t)
                n.append(len(g))
                w.append(float(ratio[g].sum() * (1 if length is None else length / len(g))) if len(g) else EMPTY)
            u = (b.column(2).to_numpy().astype(np.float64) + 0.5) / (1 << 52)
            key = np.array(w, np.float64) - np.log(-np.log(u))
            bits = key.view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(w, pa.float64()), pa.array(key), pa.array(bits ^ ((bits >> 63) & np.int64((1 << 63) - 1)))], names=[id_col, "n_grams", "log_weight", "gumbel_key", "rank_bits"])

    noise = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(seed)), 12)
    ddl = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_grams long, log_weight double, gumbel_key double, rank_bits long"
    return docs.select(F.col(id_col), utf8(text_col).alias("t"), noise.alias("u")).mapInArrow(run, ddl)


def kth_largest(rows: DataFrame, col: str, k: int) -> int | None:
    """The k-th largest value of a long column (None if there are fewer rows): 16 bits a pass."""
    prefix, part = None, rows
    for shift in (48, 32, 16, 0):
        part = rows if prefix is None else rows.where(F.shiftright(col, shift + 16) == prefix)
        for r in part.groupBy(F.shiftright(col, shift).alias("p")).count().orderBy(F.desc("p")).collect():
            if k <= r["count"]:
                prefix = r.p
                break
            k -= r["count"]
        else:
            return None
    return prefix


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float | None = None, seed: int = 11, length: int | None = LENGTH) -> DataFrame:
    """One row per document: id, n_grams, log_weight, gumbel_key, selected.

    Target texts are documents labelled quality 1 and not toxic. ``share`` of all documents is selected; by
    default the share of target documents among labelled ones.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "resampling")
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    marks = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(id_col).agg(F.min(good).alias("good"))
    if share is None:
        r = marks.agg(F.avg(F.col("good").cast("double")).alias("s")).first()
        share = r.s if r.s is not None else 1.0
    target = scratch.save("target", marks.where("good").select(id_col))
    ratio = fit(docs.select(id_col, utf8(text_col).alias("t")), target, id_col)
    scored = scratch.save("scored", score(docs, id_col, text_col, ratio, seed, length))
    n = scored.count()
    k = math.ceil(share * n)
    least = kth_largest(scored, "rank_bits", k) if k else None
    chosen = F.lit(False) if least is None else F.col("rank_bits") >= F.lit(least)
    return scored.withColumn("selected", chosen).drop("rank_bits")
