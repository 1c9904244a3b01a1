"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources get target word counts by weight, no source more than ``max_repeat`` times its size (the excess
is shared again by weight). Words are apportioned to sources by highest quotients v/(2j+1). A source's documents are dealt into
shards, every shard is a line of words cut into blocks of equally many words (``block_words``, fewer in a source too
small for 64 such blocks), and the source's quota, counted in its blocks, is apportioned to its shards in the same way. A shard
with quota q takes all its nb blocks q div nb times and q mod nb more blocks by a seeded affine permutation of the
block numbers.

Defined cases: null text has size 0; the null source is a source of its own, last; an empty table gives
an empty result; repeated rows are separate documents; documents of size 0 take 0 words; a null doc_id is
an ordinary value. Only the table of sources (one row each) is ever gathered in one task.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from loomgrid.llm.common import Scratch, tune, utf8

#: A prime above any number of blocks in a shard: multiplying by it permutes block numbers.
STEP = (1 << 31) - 1


@F.arrow_udf(LongType())
def word_count(texts: pa.Array) -> pa.Array:
    """Number of runs of bytes other than space, \\t, \\n, \\v, \\f, \\r (bytes.split splits at just these)."""
    return pa.array([len(x.split()) for x in texts.to_pylist()], pa.int64())


def targets(sources: DataFrame, max_repeat: int = 3) -> DataFrame:
    """(source, weight, source_size) -> the same with ``target``: min(cap, level * weight), where the level
    makes targets add up to the sum of all sizes. One row per source; one sorted pass finds the level."""
    # scaled to whole weights and sizes, sources saturate in the order of cap/weight
    order = Window.orderBy(F.col("cap") / F.col("weight"), "weight", F.col("source").asc_nulls_last())
    w = sources.withColumn("cap", F.lit(float(max_repeat)) * F.col("source_size"))
    every = Window.partitionBy(F.lit(0))
    w = w.withColumn("all_size", F.sum(F.col("source_size").cast("double")).over(every)).withColumn("all_w", F.sum("weight").over(every))
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("before", F.coalesce(F.sum("cap").over(upto), F.lit(0.0))).withColumn("w_before", F.coalesce(F.sum("weight").over(upto), F.lit(0)))
    # the level if exactly the sources before this one are saturated
    w = w.withColumn("level_here", (F.col("all_size") - F.col("before")) / (F.col("all_w") - F.col("w_before")))
    w = w.withColumn("fits", F.col("level_here") * F.col("weight") <= F.col("cap"))
    w = w.withColumn("level", F.min(F.when(F.col("fits"), F.struct(F.col("w_before").alias("k"), F.col("level_here").alias("level")))).over(every)["level"])
    return w.withColumn("target", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap"))).select("source", "weight", "source_size", "target")


def apportion(parties: DataFrame, group: list[str], votes: str, seats: str, order: list[str]) -> DataFrame:
    """Adds ``quota``: Sainte-Lague seats per party within each group.

    Whole quotas differ from the share v = seats*votes/sum(votes) by at most v*n/(2*seats)+1 (n parties),
    so only seats within that of v compete; ties go to the smaller ``order``. Rows stay one per party
    while ranking: competing seats are generated, ranked by quotient and counted back.
    """
    g = Window.partitionBy(*group)
    p = parties.withColumn("_n", F.count("*").over(g)).withColumn("_sum", F.sum(F.col(votes).cast("double")).over(g))
    p = p.withColumn("_share", F.when((F.col("_sum") > 0) & (F.col(seats) > 0), F.col(seats) * F.col(votes) / F.col("_sum")).otherwise(F.lit(0.0)))
    p = p.withColumn("_slack", F.ceil(F.col("_share") * F.col("_n") / (2.0 * F.greatest(F.col(seats), F.lit(1)))) + 2)
    p = p.withColumn("_sure", F.greatest(F.floor("_share") - F.col("_slack"), F.lit(0)).cast("long"))
    p = p.withColumn("_left", F.col(seats) - F.sum("_sure").over(g))
    lots = p.withColumn("_seat", F.explode(F.sequence(F.col("_sure"), (F.floor("_share") + F.col("_slack")).cast("long"))))
    lots = lots.withColumn("_q", F.col(votes) / (2.0 * F.col("_seat") + 1.0))
    lots = lots.withColumn("_won", F.row_number().over(g.orderBy(F.desc("_q"), *order, "_seat")) <= F.col("_left"))
    keys = [*group, *order]
    won = lots.groupBy(*keys).agg(F.count(F.when(F.col("_won"), 1)).alias("_extra"), F.first("_sure").alias("_base"))
    won = won.select(*keys, (F.col("_base") + F.col("_extra")).alias("quota"))
    on = None
    a, b = parties.alias("a"), won.alias("b")
    for k in keys:
        c = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        on = c if on is None else on & c
    return a.join(b, on).select("a.*", "b.quota")


#: Blocks that a source has at least, so that its mix comes as near its target.
FINE = 64
#: Parts that the rows of a source are dealt into where they meet the source's row, which is repeated as often.
SALTS = 64


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3),
        block_words: int = 64, shard_docs: int = 2048, max_repeat: int = 3, seed: int = 17, carry: list[str] | None = None) -> DataFrame:
    """All rows of ``docs`` as (row struct, source, size, source_size, target, taken, ...).

    ``row`` is the whole input row (or its columns ``carry``), so no input name can clash with the computed ones.
    Words are counted once: what all later steps read is a written table.
    ``rounds``, ``rest``, ``shard_size``, ``n_blocks``, ``start`` and ``turn`` place the row's words in its
    shard; ``block_taken`` tells from them which blocks the mix takes.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    d = sized(docs, id_col, text_col, source_col, carry, scratch)
    return place(d.drop("rid"), scratch, weights, block_words, shard_docs, max_repeat, seed)


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, carry: list[str] | None, scratch: Scratch) -> DataFrame:
    """The written table (row, rid, source, id, size, content) of all rows."""
    tune(docs.sparkSession)
    d = docs.select(F.struct(*(carry or docs.columns)).alias("row"), F.monotonically_increasing_id().alias("rid"), F.col(source_col).cast("string").alias("source"), F.col(id_col).alias("id"), word_count(utf8(text_col)).alias("size"), F.xxhash64(utf8(text_col)).alias("content"))
    return scratch.save("sizes", d)


def place(d: DataFrame, scratch: Scratch, weights=(1, 2, 3), block_words=64, shard_docs=2048, max_repeat=3, seed=17) -> DataFrame:
    """``mix`` for rows that already carry (row, source, id, size, content)."""
    per_source = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int"))
    sources = per_source.withColumn("weight", weight).withColumn("n_shards", F.ceil(F.col("n_docs") / shard_docs))
    t = targets(sources, max_repeat)
    s = sources.alias("s").join(t.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.source", "s.source_size", "s.n_shards", "t.target")
    s = s.withColumn("g", F.lit(0)).withColumn("seats", F.round(F.sum("target").over(Window.partitionBy(F.lit(0)))).cast("long"))
    s = apportion(s, ["g"], "target", "seats", ["source"]).select("source", "source_size", "n_shards", "target", F.col("quota").alias("source_quota"))
    s = s.withColumn("block", F.greatest(F.least(F.floor(F.col("source_size") / FINE), F.lit(block_words)), F.lit(1)))
    s = scratch.save("sources", s)
    salted = s.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    d = d.withColumn("salt", F.pmod(F.xxhash64("id", "content", F.lit(seed + 2)), F.lit(SALTS)))
    dealt = d.alias("d").join(salted.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.salt") == F.col("s.salt"))).select("d.*", "s.source_size", "s.target", "s.source_quota", "s.block", F.pmod(F.xxhash64("d.id", "d.content", F.lit(seed)), F.col("s.n_shards")).alias("shard"))
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"), F.first("source_size").alias("source_size"), F.first("block").alias("block"))
    shards = shards.withColumn("n_blocks", F.when(F.col("shard_size") > 0, F.greatest(F.round(F.col("shard_size") / F.col("block")), F.lit(1))).otherwise(0).cast("long"))
    # a block of this shard holds shard_size/n_blocks words; the source's quota of words becomes one of its blocks
    every = F.sum("n_blocks").over(Window.partitionBy("source"))
    shards = shards.withColumn("seats", F.when(F.col("source_size") > 0, F.round(F.col("source_quota") * every / F.col("source_size"))).otherwise(0).cast("long"))
    shards = scratch.save("shards", shards)
    shards = apportion(shards, ["source"], "n_blocks", "seats", ["shard"])
    shards = shards.withColumn("quota", F.least("quota", max_repeat * F.col("n_blocks")))
    shards = shards.withColumn("turn", F.xxhash64("source", "shard", F.lit(seed)).bitwiseAND(STEP))
    q = shards.select("source", "shard", "shard_size", "n_blocks", "turn", F.when(F.col("n_blocks") > 0, F.expr("quota div n_blocks")).otherwise(0).alias("rounds"), F.when(F.col("n_blocks") > 0, F.expr("quota % n_blocks")).otherwise(0).alias("rest"))
    line = Window.partitionBy("source", "shard").orderBy(F.xxhash64("id", "content", F.lit(seed + 1)), "id", "content", "size")
    dealt = dealt.withColumn("start", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    out = dealt.alias("d").join(q.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.shard") == F.col("q.shard"))).select("d.row", "d.source", "d.id", "d.size", "d.source_size", "d.target", "d.shard", "d.start", "q.shard_size", "q.n_blocks", "q.turn", "q.rounds", "q.rest")
    some = F.expr("aggregate(spans, 0L, (a, x) -> a + x.hi - x.lo)")
    out = out.withColumn("spans", chosen_spans())
    return out.withColumn("taken", F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("rounds") * F.col("size") + some).cast("long"))


def chosen_spans() -> Column:
    """Word ranges [lo, hi) of the row, counted from its first word, that lie in blocks taken once more."""
    first = "((start + 1) * n_blocks + shard_size - 1) div shard_size - 1"
    last = "((start + size) * n_blocks + shard_size - 1) div shard_size - 1"
    lo, hi = "greatest(i * shard_size div n_blocks - start, 0L)", "least((i + 1) * shard_size div n_blocks - start, size)"
    chosen = f"filter(sequence({first}, {last}), i -> pmod(i * {STEP}L + turn, n_blocks) < rest)"
    spans = f"transform({chosen}, i -> named_struct('lo', {lo}, 'hi', {hi}))"
    return F.expr(f"case when size = 0 or rest = 0 then cast(array() as array<struct<lo: bigint, hi: bigint>>) else {spans} end")


def expand(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """The mixed corpus itself, in the columns of ``docs``: ``rounds`` whole copies of each document and,
    if blocks of it are taken once more, one row with the words of those blocks (single spaces between).
    Quotas and places are worked out without the texts, which are moved once, to meet them."""
    scratch = Scratch(docs.sparkSession, "mixing")
    d = sized(docs, id_col, text_col, source_col, None, scratch)
    m = place(d.select(F.struct("rid").alias("row"), "source", "id", "size", "content"), scratch, **kw)
    again = F.when(F.col("rounds") > 0, F.expr("sequence(1, int(rounds))")).otherwise(F.expr("cast(array() as array<int>)"))
    copies = F.concat(again, F.when(F.size("spans") > 0, F.array(F.lit(0))).otherwise(F.expr("cast(array() as array<int>)")))
    whole = F.expr("aggregate(spans, 0L, (a, x) -> a + x.hi - x.lo)") == F.col("size")
    m = m.select("row.rid", copies.alias("copies"), F.when(~whole, F.col("spans")).alias("spans")).where(F.size("copies") > 0)
    rows = m.join(d.select("rid", "row"), "rid").withColumn("copy", F.explode("copies"))
    words = F.expr(f"regexp_extract_all(row.`{text_col}`, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)")
    rows = rows.withColumn("words", F.when((F.col("copy") == 0) & F.col("spans").isNotNull(), words))
    part = F.expr("array_join(flatten(transform(spans, s -> slice(words, int(s.lo) + 1, int(s.hi - s.lo)))), ' ')")
    rows = rows.withColumn("new_text", F.when(F.col("words").isNull(), F.col(f"row.`{text_col}`")).otherwise(part))
    cols = []
    for f in docs.schema.fields:
        c = F.col(f"row.`{f.name}`")
        if f.name == text_col:
            c = F.col("new_text")
        elif f.name == "n_chars":
            c = F.char_length("new_text").cast(f.dataType)
        cols.append(c.alias(f.name))
    return rows.select(*cols)
