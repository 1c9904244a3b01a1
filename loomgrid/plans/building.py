"""Queries over record building, datasets, batches, dispatch and the registry that the record queries do not show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions import boxes as B
from loomgrid.operators import annotations as L
from loomgrid.operators import compose as C
from loomgrid.operators import metrics as M
from loomgrid.operators import nms as S
from loomgrid.operators import sampling as G
from loomgrid.plans import fixtures as X
from loomgrid.plans.detection import nms_sql
from loomgrid.plans.families import Queries
from loomgrid.plans.fixtures import ANN, CAT, DET, GT, HB, IMG
from loomgrid.streaming import registry as R

query = Queries()
table = X.table

# records -----------------------------------------------------------------------------------------------

RECIPES = C.Registry("recipes", C.TRANSFORMS)


@RECIPES.register("wide_enough")
def wide_enough(df: DataFrame, least: int = 0) -> DataFrame:
    return df.withColumn("keep", F.col("ori_w") >= least)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.struct(F.lit(0.1).alias("x1"), F.lit(0.25).alias("y1"), F.lit(0.5).alias("x2"), F.lit(0.75).alias("y2"), F.col("image_id").alias("label"))
    return X.images(spark, sf_dir).select("image_id", F.col("width").alias("ori_w"), F.col("height").alias("ori_h"), F.array(box).alias("inst"))


@query(f"WITH {IMG} SELECT image_id, 'data/' AS prefix, height AS img_h, CAST(NULL AS VARCHAR) AS flip, round(0.1::DOUBLE * width, 6) AS x1, round(0.75::DOUBLE * height, 6) AS y2, image_id AS label, 1.0::DOUBLE AS scale, height AS pad_h, 1 AS boxed FROM images WHERE width >= 400")
def composed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PR1-PR6, PR8, PR9, PR12, UD1, UD2, UD7: a chain of named and plain steps; rows a step does not keep end there."""
    steps = [{"type": "recipes.wide_enough", "least": 400}, {"type": "seed_record", "prefix": "data/"}, {"type": "denormalise"}, {"type": "default_meta"}, {"type": "casts", "kinds": {"image_id": "bigint"}}, {"type": "collect", "keys": ["image_id", "inst"], "meta_keys": ["img_prefix", "img_h", "flip", "scale_factor", "pad_h", "absent"]}, lambda d: d.withColumn("one", F.lit(1)), {"type": "to_arrays", "keys": ["one"]}]
    r = C.compose(_records(spark, sf_dir), steps)
    i, m = F.col("inst")[0], "img_metas."
    return r.select("image_id", F.col(m + "img_prefix").alias("prefix"), F.col(m + "img_h").alias("img_h"), F.col(m + "flip").alias("flip"), F.round(i["x1"], 6).alias("x1"), F.round(i["y2"], 6).alias("y2"), i["label"].alias("label"), F.col(m + "scale_factor").alias("scale"), F.col(m + "pad_h").alias("pad_h"), F.size("one").alias("boxed"))


@query("WITH t AS (SELECT conv_id, conv_id // 4 AS batch, count(*) AS n FROM conversations GROUP BY conv_id), w AS (SELECT *, max(n) OVER (PARTITION BY batch) AS most FROM t) SELECT batch, count(*) AS rows, string_agg(conv_id, ',' ORDER BY conv_id) AS ids, sum(most) AS places, sum(most - n) AS padding FROM w GROUP BY batch")
def collated_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PR10, PR11, SO22-SO24: rows of a batch as arrays, each column by the policy in its metadata."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.expr("int(turn + 1)"))).alias("ids")).withColumn("batch", F.expr("conv_id div 4"))
    b = G.collate(G.single_source(C.with_policy(c, {"ids": {"pad": 0}}).withColumn("source", F.lit("one")), ["batch"]).drop("source"), ["batch"], "conv_id")
    flat = F.flatten("ids")
    return b.select("batch", F.size("conv_id").cast("long").alias("rows"), F.array_join(F.col("conv_id").cast("array<string>"), ",").alias("ids"), F.size(flat).cast("long").alias("places"), F.size(F.filter(flat, lambda x: x == 0)).cast("long").alias("padding"))


@query("SELECT o_orderkey AS idx, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE -1.0::DOUBLE END AS value, o_orderkey + 1 AS aligned FROM orders")
def scattered_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PR15, PR16."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_totalprice").cast("double").alias("value"))
    s = C.scatter_back(o.where("idx % 3 = 0"), o.select("idx"), "idx", "value", -1.0)
    pairs = F.transform(C.align(F.array("idx").alias("a"), F.array(F.lit(1)).alias("b")), lambda z: z["a"] + z["b"])
    return s.select("idx", "value", pairs[0].alias("aligned"))


@query(f"WITH {DET}, i AS (SELECT DISTINCT image_id FROM det), c AS (SELECT CAST(range AS INT) AS class_id FROM range(0, 7)), n AS (SELECT image_id, class_id, count(*) AS n, min(det_idx) AS first FROM det GROUP BY ALL) SELECT i.image_id, c.class_id, coalesce(n, 0) AS n, first FROM i CROSS JOIN c LEFT JOIN n USING (image_id, class_id)")
def class_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PR17, AG7: a list for every image and class, empty ones too."""
    d = X.det(spark, sf_dir)
    r = C.per_class_lists(d, spark.range(7).select(F.col("id").cast("int").alias("class_id")), d.select("image_id").distinct())
    return r.select("image_id", "class_id", F.size("dets").cast("long").alias("n"), F.get("dets", F.lit(0))["det_idx"].alias("first"))


@query(f"WITH {DET}, r AS (SELECT image_id, x1, row_number() OVER (PARTITION BY image_id ORDER BY det_idx) - 1 AS k FROM det) SELECT image_id AS batch_idx, CAST(k AS INT) AS roi_idx, x1, true AS back FROM r")
def region_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PR18: boxes with their image's number, and back."""
    b = X.det(spark, sf_dir).groupBy(F.col("image_id").alias("batch_idx")).agg(F.transform(F.array_sort(F.collect_list(F.struct("det_idx", *B.Box._fields))), lambda s: F.array(*(s[n] for n in B.Box._fields))).alias("boxes"))
    rois = C.to_rois(b)
    back = C.from_rois(rois).join(b.withColumnRenamed("boxes", "was"), "batch_idx").select("batch_idx", (F.col("boxes") == F.col("was")).alias("back"))
    return rois.join(back, "batch_idx").select("batch_idx", "roi_idx", F.col("roi")[0].alias("x1"), "back")


# annotations -------------------------------------------------------------------------------------------


@query(f"WITH {IMG}, {ANN}, {CAT}, k AS (SELECT DISTINCT image_id FROM ann JOIN cat USING (category_id)), a AS (SELECT DISTINCT image_id FROM ann) SELECT image_id, image_id IN (FROM k) AS known, image_id IN (FROM a) AS some FROM images")
def images_with_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FI5-FI7, JO2, JO3."""
    i, a = X.images(spark, sf_dir), X.annotations(spark, sf_dir)
    mark = lambda d, n: d.select("image_id", F.lit(True).alias(n))
    known = mark(L.with_known_annotations(i, a, X.categories(spark), size=0), "known")
    some = mark(L.with_annotations(i, a), "some")
    return i.select("image_id").join(known, "image_id", "left").join(some, "image_id", "left").na.fill(False)


SPANS = f"WITH {IMG}, {ANN}, {CAT}, a AS (SELECT ann_id, ann.image_id FROM ann JOIN images USING (image_id) JOIN cat USING (category_id) WHERE NOT ignore AND NOT iscrowd AND greatest(0, least(x + w, width) - greatest(x, 0)) * greatest(0, least(y + h, height) - greatest(y, 0)) <> 0 AND area > 0 AND w >= 1 AND h >= 1)"


@query(f"{SPANS} SELECT ann_id, k * 4 AS start, k * 4 + 3 AS \"end\", 'picture ' || image_id AS label_text FROM a, range(0, 2) t(k)")
def span_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FI9-FI11, JO8: a box repeated for each of its spans, with its image's caption."""
    spans = F.array(F.array(F.lit(0), F.lit(3)), F.array(F.lit(4), F.lit(7)))
    i = X.images(spark, sf_dir).withColumn("caption", F.concat(F.lit("picture "), F.col("image_id").cast("string")))
    boxes = L.parse_annotations(i, X.annotations(spark, sf_dir).withColumn("tokens_positive", spans), X.categories(spark))[0]
    s = L.caption_labels(L.span_annotations(boxes), i)
    return s.select("ann_id", F.col("span.start").cast("long").alias("start"), F.col("span.end").cast("long").alias("end"), "label_text")


@query("SELECT o_orderkey AS image_id, o_orderkey * 2 AS score, c_name AS rule FROM orders JOIN customer ON o_custkey = c_custkey")
def joined_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JO4, JO6, JO7: truths with predictions and rules; a missing one fails the query."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), "o_custkey")
    j = L.join_predictions(o, o.select("image_id", (F.col("image_id") * 2).alias("score")))
    rules = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("rule"))
    return L.lookup_or_fail(L.assert_unique(j, "image_id"), rules, "o_custkey", "rule").select("image_id", "pred.score", "rule")


# datasets and samplers ---------------------------------------------------------------------------------

RANDOM = "doc_id * 7919 % 10007"


@query(f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {RANDOM}, doc_id) AS r, count(*) OVER () AS n FROM documents) SELECT doc_id FROM r WHERE r <= floor(n * 0.25)")
def subset_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO4."""
    return G.subset(table(spark, sf_dir, "documents").select("doc_id"), 0.25, "doc_id", order=F.expr(RANDOM))


@query(f"""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {RANDOM}, doc_id) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE lang IS NOT NULL),
p AS (SELECT doc_id, lang, unnest(range(r, CAST(ceil(n / 12.0) * 12 AS BIGINT), n)) AS pos FROM r), h AS (SELECT lang, count(*) // 4 AS b FROM p GROUP BY lang), o AS (SELECT lang, sum(b) OVER (ORDER BY lang) - b AS st, sum(b) OVER () AS al FROM h),
g AS (SELECT doc_id, lang, (st + pos // 4) * 4 + pos % 4 AS g, al * 4 // 3 AS per FROM p JOIN o USING (lang)) SELECT doc_id, lang, CAST(g // per AS INT) AS rank, CAST(g % per AS BIGINT) AS rank_pos FROM g""")
def distributed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO8, SO28: three ranks, batches of four of one language."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").where("lang is not null")
    return G.distributed_group(d, "lang", 4, 3, "doc_id", order=F.expr(RANDOM))


@query("SELECT doc_id, CAST(e AS INT) AS epoch FROM documents, range(0, 3) t(e)")
def repeated_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO11, SO12."""
    return G.epochs(table(spark, sf_dir, "documents").select("doc_id"), 3)


@query("WITH w AS (SELECT lang, count(*) AS want FROM documents WHERE lang IS NOT NULL GROUP BY lang), g AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL AND doc_id % 3 <> 0 GROUP BY lang) SELECT lang, want AS rows, least(n, want) AS different FROM w JOIN g USING (lang)")
def refilled_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO13: rows that failed are replaced by others of their group."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").where("lang is not null")
    r = G.refill(d.where("doc_id % 3 <> 0"), "lang", d.groupBy("lang").agg(F.count("*").alias("n")), "doc_id")
    return r.groupBy("lang").agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("different"))


@query("WITH p AS (SELECT DISTINCT user_id, event_type FROM events) SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY length(event_type), event_type) AS r FROM p) WHERE r <= 3")
def few_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO25."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    return G.some_labels(e, ["user_id"], "event_type", 3, order=F.length("event_type"))


LIVE = f"{HB}, l AS (SELECT worker, arg_max(speed, ts) AS speed, arg_max(queue_length, ts) AS q, arg_max(models, ts) AS models FROM hb GROUP BY worker)"


@query(f"WITH {LIVE}, w AS (SELECT worker, (sum(speed) OVER (ORDER BY worker) - speed) / sum(speed) OVER () AS lo, sum(speed) OVER (ORDER BY worker) / sum(speed) OVER () AS hi FROM l), r AS (SELECT o_orderkey AS request, (o_orderkey * 7919 % 10007 + 0.5) / 10007 AS u FROM orders) SELECT request, worker FROM r JOIN w ON u >= lo AND u < hi")
def lottery_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SO26: in proportion to speed."""
    w = X.heartbeats(spark, sf_dir).groupBy("worker").agg(F.max_by("speed", "ts").alias("speed"))
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), F.expr("(o_orderkey * 7919 % 10007 + 0.5D) / 10007").alias("u"))
    return G.lottery(w, r, draw=F.col("u")).select("request", "worker")


@query("WITH n AS (SELECT count(*) AS n FROM region), r AS (SELECT r_regionkey, r_name FROM region) SELECT a.r_regionkey, CAST(s AS INT) AS slot, b.r_name AS partner FROM r a, n, range(0, 3) t(s) JOIN r b ON b.r_regionkey = (a.r_regionkey * 3 + s * 2) % n")
def mixed_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JO29, SE6."""
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    m = C.mix_partners(r, 3, idx="r_regionkey", draw=F.expr("r_regionkey * 3 + _k * 2"))
    return m.select("r_regionkey", "slot", F.col("partner.r_name").alias("partner"))


@query("WITH a AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), b AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) SELECT doc_id, 'any' AS part FROM (FROM a UNION FROM b) UNION ALL SELECT doc_id, 'all' FROM (FROM a INTERSECT FROM b) UNION ALL SELECT doc_id, 'less' FROM documents WHERE doc_id NOT IN (FROM a)")
def id_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SE7, SE8."""
    lab = table(spark, sf_dir, "labels")
    a, b = lab.where("quality = 1").select("doc_id"), lab.where("toxic = 1").select("doc_id")
    part = lambda d, n: d.select("doc_id", F.lit(n).alias("part"))
    return part(C.ids_in_any(a, b, key="doc_id"), "any").unionByName(part(C.ids_in_all(a, b, key="doc_id"), "all")).unionByName(part(C.without(table(spark, sf_dir, "documents"), a, "doc_id"), "less"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 2 THEN '1,2,3' ELSE list_aggregate(list_sort(list_distinct([1, 2, 3, o_orderkey % 4 + 10])), 'string_agg', ',') END AS labels FROM orders")
def label_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SE9, SE10."""
    a = F.array(*(F.lit(k).cast("long") for k in (3, 1)))
    b = F.when(F.col("o_orderkey") % 4 == 2, F.array(*(F.lit(k).cast("long") for k in (2, 1)))).otherwise(F.array(F.lit(2).cast("long"), F.expr("o_orderkey % 4 + 10"), F.lit(3).cast("long")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(C.union_labels(a, b).cast("array<string>"), ",").alias("labels"))


@query(f"WITH RECURSIVE {DET}, {nms_sql('image_id', '0.6')} SELECT 'nms' AS kind, count(*) AS n FROM k WHERE ok")
def nms_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UD4, UD5: suppression chosen by configuration."""
    return S.nms_by_name("nms", X.det(spark, sf_dir), 0.6, ["image_id"]).agg(F.count("*").alias("n")).select(F.lit("nms").alias("kind"), "n")


# registry, sessions, hooks -----------------------------------------------------------------------------


@query(f"WITH {LIVE} SELECT sum(speed) AS speed, sum(q) AS queue_length, (SELECT string_agg(m, ',' ORDER BY m) FROM (SELECT DISTINCT unnest(models) AS m FROM l)) AS models FROM l")
def controller_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG45, SM1, SM3: all workers as one."""
    h = X.heartbeats(spark, sf_dir)
    last = h.groupBy("worker").agg(F.max_by(F.struct("speed", "queue_length", "models"), "ts").alias("b")).select("worker", "b.*")
    return R.status(last).withColumn("models", F.array_join("models", ","))


@query("SELECT conv_id, turn, text || ' done' AS text, CASE WHEN turn % 3 = 0 THEN 0 ELSE CAST(turn % 3 AS INT) END AS error_code, CASE CAST(turn % 3 AS INT) WHEN 0 THEN 'ok' WHEN 1 THEN 'worker out of memory' ELSE 'no worker' END AS said FROM conversations UNION ALL SELECT conv_id, turn, 'half', 0, 'ok' FROM conversations")
def decoded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM5: chunks of a token stream, split at NUL."""
    c = table(spark, sf_dir, "conversations")
    chunk = lambda text, code: F.concat(F.to_json(F.struct(text.alias("text"), code.alias("error_code"))), F.lit("\x00"))
    v = F.concat(chunk(F.lit("half"), F.lit(0)), chunk(F.concat(F.col("text"), F.lit(" done")), F.expr("int(turn % 3)")))
    return R.decode_chunks(c.select("conv_id", "turn", v.alias("value")))


@query("SELECT event_id, 5 - event_id % 5 + CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 7 END AS waiting FROM events")
def queue_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM6: limit less free places, and those who wait."""
    wait = F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 7)
    return table(spark, sf_dir, "events").select("event_id", R.queue_length(F.lit(5), F.col("event_id") % 5, wait).alias("waiting"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def session_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM7: a session's state is its last action."""
    return R.last_action(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query("SELECT event_id, round(sum(value * (event_id % 5 + 1)) OVER w / sum(event_id % 5 + 1) OVER w + 1e-9, 5) AS avg FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def log_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM8, AG30: over all entries so far."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.expr("event_id % 5 + 1").alias("n"))
    return M.weighted_log_average(e, ["event_type"], "event_id", "value", "n").select("event_id", F.round(F.col("avg") + 1e-9, 5).alias("avg"))


@query("SELECT range + 1 AS step, 'milestones' AS kind FROM range(0, 60) WHERE CASE WHEN range + 1 >= 30 THEN (range + 1) % 3 = 0 ELSE (range + 1) % 10 = 0 END UNION ALL SELECT range + 1, 'start' FROM range(0, 60) WHERE range + 1 >= 5 AND (range + 1 - 5) % 7 = 0")
def evaluation_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM9."""
    s = spark.range(1, 61).withColumnRenamed("id", "step")
    return R.evaluation_points(s, 10, milestones=[(30, 3)]).withColumn("kind", F.lit("milestones")).unionByName(R.evaluation_points(s, 7, start=5).withColumn("kind", F.lit("start")))


@query("SELECT * FROM (VALUES ('a', 'VERY_LOW', 0, 90, 3), ('b', 'normal', 1, 50, 1), ('c', '51', 2, 51, 2), ('d', 'HIGHEST', 3, 0, 0)) t(name, priority, \"order\", level, pos)")
def hook_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM10, UD9."""
    h = spark.createDataFrame([("a", "VERY_LOW", 0), ("b", "normal", 1), ("c", "51", 2), ("d", "HIGHEST", 3)], "name string, priority string, order int")
    return R.by_priority(h)


@query("SELECT start, event_type, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 3 HOUR * k AS start FROM events, range(0, 2) t(k)) GROUP BY ALL")
def event_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM12: windows of six hours every three."""
    return R.sliding(table(spark, sf_dir, "events"), "6 hours", "3 hours", by=["event_type"])


QUERIES = query.queries
ORACLE_SQL = query.sql
