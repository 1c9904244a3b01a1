"""Operator inputs derived from the synthetic tables by whole-number arithmetic, and the same as SQL.

Detections come from ``events`` and truths from ``orders``: every image has 40 detections and 60 truths at any scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _placed(rows: DataFrame, key: str, per_image: int) -> DataFrame:
    m = rows.agg(F.floor(F.count("*") / per_image).alias("m"))  # one row
    d = rows.withColumnRenamed(key, "k").crossJoin(F.broadcast(m))
    d = d.withColumn("img", F.expr("k % m")).withColumn("c", F.expr("k div m"))
    return d.withColumn("cls", F.expr("c % 5")).withColumn("j", F.expr("c div 5"))


X1 = "(img * 37 + (j % 3) * 97 + cls * 53) % 400 + (j * 7) % 19"
Y1 = "(img * 53 + (j % 3) * 71 + cls * 29) % 400 + (j * 5) % 17"


def det(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _placed(table(spark, sf_dir, "events").select("event_id"), "event_id", 40)
    d = d.withColumn("x1", F.expr(f"double({X1} + CASE WHEN k % 7 = 0 THEN 200 ELSE 0 END)")).withColumn("y1", F.expr(f"double({Y1})"))
    return d.select(F.col("img").alias("image_id"), F.col("cls").cast("int").alias("class_id"), F.col("k").alias("det_idx"), "x1", "y1", (F.col("x1") + 60 + F.expr("(k * 11) % 40")).alias("x2"), (F.col("y1") + 60 + F.expr("(k * 17) % 40")).alias("y2"), F.expr("((k * 7919) % 10007) / 10007.0D").alias("score"))


def gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _placed(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 60)
    d = d.withColumn("x1", F.expr(f"double({X1})")).withColumn("y1", F.expr(f"double({Y1})"))
    return d.select(F.col("img").alias("image_id"), F.col("cls").cast("int").alias("class_id"), F.col("k").alias("gt_idx"), "x1", "y1", (F.col("x1") + 60 + F.expr("(k * 13) % 40")).alias("x2"), (F.col("y1") + 60 + F.expr("(k * 19) % 40")).alias("y2"), (F.col("o_orderstatus") == "P").alias("is_ignore"), F.expr("k % 17 = 0").alias("is_group_of"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("batch"), F.col("vec_id").alias("pt_idx"), *(F.col("embedding")[k].cast("double").alias(a) for k, a in enumerate("xyz")))


def centres(spark: SparkSession, sf_dir: str, every: int = 25) -> DataFrame:
    p = points(spark, sf_dir).where(F.col("pt_idx") % every == 0)
    return p.select("batch", F.col("pt_idx").alias("c_idx"), *(F.col(a).alias(f"c_{a}") for a in "xyz"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with sizes from ``customer``: every 13th is too small."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("image_id"), F.expr("int(CASE WHEN c_custkey % 13 = 0 THEN 31 ELSE 320 + c_custkey % 400 END)").alias("width"), F.expr("int(240 + c_custkey % 300)").alias("height"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations from ``orders``, in the store's raw form."""
    o = table(spark, sf_dir, "orders")
    k = "o_orderkey"
    return o.select(F.col(k).alias("ann_id"), F.col("o_custkey").alias("image_id"), F.expr(f"int({k} % 7 + 1)").alias("category_id"), F.array(*(F.expr(e).cast("double") for e in (f"{k} % 350", f"{k} % 260", f"{k} * 3 % 90", f"{k} * 5 % 80"))).alias("bbox"), F.expr(f"double(({k} * 3 % 90) * ({k} * 5 % 80))").alias("area"), (F.col("o_orderstatus") == "P").alias("iscrowd"), F.expr(f"{k} % 29 = 0").alias("ignore"))


def categories(spark: SparkSession) -> DataFrame:
    return spark.range(1, 6).select(F.col("id").cast("int").alias("category_id"), F.concat(F.lit("class"), F.col("id").cast("string")).alias("name"), F.expr("id % 2 = 1").alias("isthing"))


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    u = "user_id"
    return e.select(F.concat(F.lit("w"), F.expr(f"{u} % 40").cast("string")).alias("worker"), F.array(F.concat(F.lit("m"), F.expr(f"{u} % 3").cast("string")), F.concat(F.lit("m"), F.expr(f"{u} % 5").cast("string"))).alias("models"), F.expr(f"int({u} % 4 + 1)").alias("speed"), F.expr("int(event_id % 9)").alias("queue_length"), F.expr(f"{u} % 40 % 6 <> 0").alias("check_hb"), F.expr("double(event_id)").alias("ts"))


# the same in SQL ---------------------------------------------------------------------------------------

DET = f"""dm AS (SELECT count(*) // 40 AS m FROM events),
d0 AS (SELECT event_id AS k, event_id % m AS img, event_id // m AS c FROM events, dm),
d1 AS (SELECT *, c % 5 AS cls, c // 5 AS j FROM d0),
d2 AS (SELECT *, CAST({X1} + CASE WHEN k % 7 = 0 THEN 200 ELSE 0 END AS DOUBLE) AS x1, CAST({Y1} AS DOUBLE) AS y1 FROM d1),
det AS (SELECT img AS image_id, CAST(cls AS INT) AS class_id, k AS det_idx, x1, y1, x1 + 60 + (k * 11) % 40 AS x2, y1 + 60 + (k * 17) % 40 AS y2, ((k * 7919) % 10007) / 10007.0::DOUBLE AS score FROM d2)"""
GT = f"""gm AS (SELECT count(*) // 60 AS m FROM orders),
g0 AS (SELECT o_orderkey AS k, o_orderstatus, o_orderkey % m AS img, o_orderkey // m AS c FROM orders, gm),
g1 AS (SELECT *, c % 5 AS cls, c // 5 AS j FROM g0),
g2 AS (SELECT *, CAST({X1} AS DOUBLE) AS x1, CAST({Y1} AS DOUBLE) AS y1 FROM g1),
gt AS (SELECT img AS image_id, CAST(cls AS INT) AS class_id, k AS gt_idx, x1, y1, x1 + 60 + (k * 13) % 40 AS x2, y1 + 60 + (k * 19) % 40 AS y2, o_orderstatus = 'P' AS is_ignore, k % 17 = 0 AS is_group_of FROM g2)"""
PTS = "pts AS (SELECT label AS batch, vec_id AS pt_idx, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings), ctr AS (SELECT batch, pt_idx AS c_idx, x AS c_x, y AS c_y, z AS c_z FROM pts WHERE pt_idx % 25 = 0)"
IMG = "images AS (SELECT c_custkey AS image_id, CAST(CASE WHEN c_custkey % 13 = 0 THEN 31 ELSE 320 + c_custkey % 400 END AS INT) AS width, CAST(240 + c_custkey % 300 AS INT) AS height FROM customer)"
ANN = "ann AS (SELECT o_orderkey AS ann_id, o_custkey AS image_id, CAST(o_orderkey % 7 + 1 AS INT) AS category_id, CAST(o_orderkey % 350 AS DOUBLE) AS x, CAST(o_orderkey % 260 AS DOUBLE) AS y, CAST(o_orderkey * 3 % 90 AS DOUBLE) AS w, CAST(o_orderkey * 5 % 80 AS DOUBLE) AS h, CAST((o_orderkey * 3 % 90) * (o_orderkey * 5 % 80) AS DOUBLE) AS area, o_orderstatus = 'P' AS iscrowd, o_orderkey % 29 = 0 AS ignore FROM orders)"
CAT = "cat AS (SELECT CAST(i AS INT) AS category_id, 'class' || i AS name, i % 2 = 1 AS isthing FROM range(1, 6) t(i))"
HB = "hb AS (SELECT 'w' || (user_id % 40) AS worker, ['m' || (user_id % 3), 'm' || (user_id % 5)] AS models, CAST(user_id % 4 + 1 AS INT) AS speed, CAST(event_id % 9 AS INT) AS queue_length, user_id % 40 % 6 <> 0 AS check_hb, CAST(event_id AS DOUBLE) AS ts FROM events)"


def inter_sql(a: str, b: str, extra: int = 0) -> str:
    return f"greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1) + {extra}, 0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1) + {extra}, 0)"


def area_sql(a: str, extra: int = 0) -> str:
    return f"(({a}.x2 - {a}.x1 + {extra}) * ({a}.y2 - {a}.y1 + {extra}))"


def iou_sql(a: str, b: str, extra: int = 0, mode: str = "iou") -> str:
    i = inter_sql(a, b, extra)
    u = area_sql(a, extra) if mode == "iof" else f"{area_sql(a, extra)} + {area_sql(b, extra)} - {i}"
    return f"(({i}) / greatest({u}, 1e-6))"
