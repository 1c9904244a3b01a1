"""Shared plumbing: durable scratch tables, batch sizing, tokens and connected components."""

from __future__ import annotations

import gc
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.session import reachable, shared_folder

#: Rows, and bytes, that a Python worker receives at once.
BATCH_ROWS = 512
BATCH_BYTES = 64 << 20


def tune(spark: SparkSession) -> None:
    """Session settings that the Arrow stages of this subpackage rely on."""
    reachable(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.fullmatch(r"(\d+)b?", str(spark.conf.get(key)).lower())
        if not now or not 0 < int(now[1]) <= most:  # smaller values of the caller stay
            spark.conf.set(key, str(most))


class Scratch:
    """Written tables that cut lineage: every save is Parquet in the shared folder, so a lost executor
    costs only the tasks it ran. ``drop`` frees a table that nothing will read again."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.base, self.paths = spark, f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex[:12]}", {}

    def save(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{name}-{len(self.paths)}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def release(self) -> None:
        """Lets Spark delete the shuffle files of finished phases now rather than at its own time."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for t in tables:
            if path := self.paths.get(id(t), ("",))[0]:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def workers(spark: SparkSession) -> int:
    """Partitions for stages dealt out anew."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bits of a Bloom filter: 16 a value, at most 16 MB.
MOST_BITS = 1 << 27


class Bloom:
    """Tells of xxhash64 values whether they may belong to a column's values, by a broadcast bit map of a bounded size. What it lets through
    wrongly, more of it the more values there are, is for a join to drop."""

    def __init__(self, values: DataFrame):
        spark = values.sparkSession
        self.bits = min(MOST_BITS, max(1 << 16, 1 << (16 * values.count()).bit_length()))
        p = values.select(F.pmod(F.xxhash64(values.columns[0]), F.lit(self.bits)).alias("p"))
        words = np.zeros(self.bits // 64, np.int64)
        for r in p.groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(p % 64))")).alias("v")).collect():  # bits / 64 rows at most
            words[r.w] = r.v
        self.shared = spark.sparkContext.broadcast(words)

    def holds(self, hashes: pa.Array) -> pa.Array:
        p = hashes.to_numpy() % np.int64(self.bits)  # as pmod: the divisor's sign
        return pa.array((self.shared.value[p // 64] >> (p % 64)) & 1 == 1)


def utf8(col: str) -> Column:
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))


def remainder(col: str, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % m


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (u, v: long) as (node, root), root the smallest node.

    Alternates large-star and small-star steps until the edge set is a set of stars. Each step is one
    aggregation with map-side combine and one join whose hot side Spark may split; no group is
    gathered anywhere. Nodes without an edge to another node are absent. Self loops are ignored.
    """
    e = scratch.save("cc", edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # what large-star leaves of (u, v) with v > u is (v, m); every edge is kept once, from its lower end
        large = scratch.save("cc", large.distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        new = scratch.save("cc", small.distinct())
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(large, e)
        e = new
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not converge")
    return scratch.save("stars", e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())
