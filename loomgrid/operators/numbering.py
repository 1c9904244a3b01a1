"""Row numbers and running totals, over a table or within its groups, without sorting either in one task.

Rows are dealt out by ranges of their order, whose ends Spark samples in the order's own type: numbers, dates, strings and structs
alike, crowded values and outliers included, since the unique key at its end splits ties. A range's numbers then start from what the
ranges below it hold. Ranges are written once to the folder that all executors share, so a lost task finds the same ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.session import shared_folder

#: Bits of monotonically_increasing_id that number the rows of a partition.
ROW_BITS = 33


def written(df: DataFrame, tag: str = "table") -> DataFrame:
    """The rows, written to the shared folder and read from there."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranges(df: DataFrame, order: Sequence[Column | str], parts: int | None = None) -> DataFrame:
    """The rows with ``_p``, the range of the order that they fall into, and ``_i``, their place in it."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return written(d.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << ROW_BITS) - 1)), "ranges")


def same(a: DataFrame, b: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of equal names, nulls equal; b's other columns join a's."""
    b = b.withColumnsRenamed({c: f"_r_{c}" for c in on})
    cond = None
    for c in on:
        one = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        cond = one if cond is None else cond & one
    return a.join(b, cond, how).drop(*(f"_r_{c}" for c in on))


def carried(t: DataFrame, by: Sequence[str], **totals: tuple[str, Column | str]) -> DataFrame:
    """``t``, as ``ranges`` gives it in an order that starts with ``by``, with the row's number in its group (``_row``, from 0), the group's size
    (``_rows``), and for each name the ("sum", "min" or "max", of what) over the group's rows in earlier ranges, null if there are none."""
    parts = [getattr(F, kind)(what).alias(f"_t_{k}") for k, (kind, what) in totals.items()]
    c = t.groupBy("_p", *by).agg(F.count("*").alias("_before_c"), F.min("_i").alias("_first_i"), *parts)
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    up = group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges that hold the group
    earlier = [getattr(F, kind)(f"_t_{k}").over(up).alias(k) for k, (kind, _) in totals.items()]
    c = c.select("_p", *by, "_first_i", F.coalesce(F.sum("_before_c").over(up), F.lit(0)).alias("_before_c"), F.sum("_before_c").over(group).alias("_rows"), *earlier)
    d = same(t, c, ["_p", *by]) if by else t.join(F.broadcast(c), "_p")  # without groups: a row for each range
    return d.withColumn("_row", F.col("_before_c") + F.col("_i") - F.col("_first_i")).drop("_before_c", "_first_i")


def numbered(df: DataFrame, key: str, order: Column | None = None, name: str = "n", total: str | None = None, value: str | None = None, before: str = "before", by: Sequence[str] = ()) -> DataFrame:
    """``name``: the row's number from 0 by ``order`` (of any type that sorts; default: the key) and then the key, in its group of equal
    ``by``, if given (nulls are a group); ``total``: how many rows the group has; ``before``: the sum of ``value`` over its rows before."""
    t = ranges(df, [*by, *([] if order is None else [order]), key])
    d = carried(t, by, **({"_before": ("sum", value)} if value else {}))
    if value:
        w = Window.partitionBy("_p", *by).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
        own = F.coalesce(F.sum(value).over(w), F.lit(0)) - F.coalesce(F.col(value), F.lit(0))
        d = d.withColumn(before, F.coalesce("_before", F.lit(0)) + own).drop("_before")
    d = d.withColumnRenamed("_row", name)
    d = d.withColumnRenamed("_rows", total) if total else d.drop("_rows")
    return d.drop("_p", "_i")
