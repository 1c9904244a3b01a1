"""Queries that show a family of column functions at once: one row per input row, one column per function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions import boxes as B
from loomgrid.plans import fixtures as X
from loomgrid.plans.fixtures import DET, GT

#: Detections with the truth of the same number: d is (x1, y1, x2, y2), the truth (a1, b1, a2, b2).
PAIR = f"{DET}, {GT}, p AS (SELECT d.*, g.x1 AS a1, g.y1 AS b1, g.x2 AS a2, g.y2 AS b2 FROM det d JOIN gt g ON d.det_idx = g.gt_idx)"
OTHER = ("a1", "b1", "a2", "b2")


def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.gt(spark, sf_dir).select(F.col("gt_idx").alias("det_idx"), *(F.col(n).alias(o) for n, o in zip(B.Box._fields, OTHER, strict=True)))
    return X.det(spark, sf_dir).join(g, "det_idx")


def other() -> B.Box:
    return B.Box(*map(F.col, OTHER))


class Family:
    """Registers queries ``name`` over a base table: numbers are rounded to six places on both sides."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, base: Callable, ctes: str, source: str, keys: list[str], plain: dict[str, str] | None = None, **exprs: str):
        """``exprs``: SQL per numeric column; ``plain``: SQL of columns that are not rounded."""

        def add(f: Callable[[], dict[str, Column]]):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                df = base(spark, sf_dir)
                made = f()
                # + 0.0: no negative zero on either side
                return df.select(*keys, *((F.round(c, 6) + 0.0 if n in exprs else c).alias(n) for n, c in made.items()))

            run.__name__, run.__doc__ = f.__name__, f.__doc__
            self.queries[f.__name__] = run
            cols = [*keys, *(f"round({e}, 6) + 0.0 AS {n}" for n, e in exprs.items()), *(f"{e} AS {n}" for n, e in (plain or {}).items())]
            self.sql[f.__name__] = f"WITH {ctes} SELECT {', '.join(cols)} FROM {source}"
            return f

        return add


class Queries:
    """Registers queries with their SQL: ``@q(sql)``."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str):
        def add(f: Callable) -> Callable:
            self.queries[f.__name__], self.sql[f.__name__] = f, sql
            return f

        return add
