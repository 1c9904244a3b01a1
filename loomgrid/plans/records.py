"""Queries over records: annotation filters, lookups, prompts and captions, datasets and batches, registries and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions import boxes as B
from loomgrid.functions import numeric as N
from loomgrid.functions import text as T
from loomgrid.operators import annotations as L
from loomgrid.operators import compose as C
from loomgrid.operators import metrics as M
from loomgrid.operators import sampling as S
from loomgrid.operators import spatial as P
from loomgrid.plans import fixtures as X
from loomgrid.plans.fixtures import ANN, CAT, DET, GT, HB, IMG
from loomgrid.streaming import registry as R

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# filters and lookups -----------------------------------------------------------------------------------


@query(f"WITH {IMG} SELECT image_id, width, height FROM images WHERE least(width, height) >= 32")
def image_filter_min_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.min_side(X.images(spark, sf_dir))


@query(f"WITH {IMG}, {ANN}, {CAT} SELECT image_id, width, height FROM images WHERE least(width, height) >= 32 AND image_id IN (SELECT image_id FROM ann JOIN cat USING (category_id))")
def image_filter_known_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.with_known_annotations(X.images(spark, sf_dir), X.annotations(spark, sf_dir), X.categories(spark))


@query(f"WITH {IMG}, {ANN} SELECT image_id, width, height FROM images WHERE image_id NOT IN (SELECT image_id FROM ann GROUP BY image_id HAVING bool_and(iscrowd))")
def image_filter_not_only_crowd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.not_only_crowd(X.images(spark, sf_dir), X.annotations(spark, sf_dir))


@query(f"WITH {IMG}, {ANN}, {CAT} SELECT image_id, width, height FROM images WHERE least(width, height) >= 32 AND image_id IN (SELECT image_id FROM ann JOIN cat USING (category_id) WHERE isthing)")
def image_filter_things(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.with_things(X.images(spark, sf_dir), X.annotations(spark, sf_dir), X.categories(spark))


VALID = f"WITH {IMG}, {ANN}, {CAT}, a AS (SELECT ann_id, ann.image_id, CAST(category_id - 1 AS INT) AS label, iscrowd, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM ann JOIN images USING (image_id) JOIN cat USING (category_id) WHERE NOT ignore AND greatest(0, least(x + w, width) - greatest(x, 0)) * greatest(0, least(y + h, height) - greatest(y, 0)) <> 0 AND area > 0 AND w >= 1 AND h >= 1)"


@query(f"{VALID} SELECT image_id, ann_id, label, x1, y1, x2, y2 FROM a WHERE NOT iscrowd")
def annotation_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.parse_annotations(X.images(spark, sf_dir), X.annotations(spark, sf_dir), X.categories(spark))[0]


@query(f"{VALID} SELECT image_id, ann_id, label, x1, y1, x2, y2 FROM a WHERE iscrowd")
def annotation_crowd_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.parse_annotations(X.images(spark, sf_dir), X.annotations(spark, sf_dir), X.categories(spark))[1]


@query(f"WITH {GT} SELECT gt_idx FROM gt WHERE (x2 - x1) * (y2 - y1) > 5000 AND (x2 - x1) * (y2 - y1) < 8000")
def area_window_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.gt(spark, sf_dir).where(B.area_between(B.box(), 5000, 8000)).select("gt_idx")


@query(f"WITH {GT}, k AS (SELECT image_id, class_id, count(*) AS had, count(*) FILTER (WHERE x2 - x1 > 90 AND y2 - y1 > 70) AS n FROM gt GROUP BY ALL) SELECT image_id, class_id, n FROM k WHERE n > 0")
def instance_size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.gt(spark, sf_dir).groupBy("image_id", "class_id").agg(F.collect_list(F.struct(*B.Box._fields)).alias("inst"))
    return L.filter_instances(g, lambda b: B.larger_than(b, 90, 70)).select("image_id", "class_id", F.size("inst").cast("long").alias("n"))


@query(f"WITH {GT} SELECT image_id, x1, y1, min(gt_idx) AS gt_idx FROM gt WHERE true GROUP BY image_id, x1, y1")
def vg_exact_box_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.gt(spark, sf_dir).withColumn("x2", F.col("x1") + 1).withColumn("y2", F.col("y1") + 1)
    return L.first_of_equal_boxes(g, "gt_idx").select("image_id", "x1", "y1", "gt_idx")


@query("SELECT n_name, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def image_ann_category_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (X.table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = o.select("o_custkey", "o_totalprice").join(c.select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n.select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"WITH {IMG}, {ANN} SELECT image_id FROM images WHERE image_id NOT IN (SELECT image_id FROM ann WHERE ann_id % 3 = 0)")
def left_anti_missing_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.missing_predictions(X.images(spark, sf_dir), X.annotations(spark, sf_dir).where("ann_id % 3 = 0")).select("image_id")


@query("WITH q AS (SELECT conv_id, text AS question FROM conversations WHERE turn = 0), a AS (SELECT conv_id, text AS answer1 FROM conversations WHERE turn = 1), b AS (SELECT conv_id, text AS answer2 FROM conversations WHERE turn = 2) SELECT conv_id AS line, question, answer1, answer2 FROM q JOIN a USING (conv_id) JOIN b USING (conv_id)")
def zip_join_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.table(spark, sf_dir, "conversations")
    part = lambda k, name: c.where(F.col("turn") == k).select(F.col("conv_id").alias("line"), F.col("text").alias(name))
    return L.zip_by_line(part(0, "question"), part(1, "answer1"), part(2, "answer2"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, min(event_id) AS first_seq FROM events GROUP BY user_id")
def caption_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return L.last_wins(e, "user_id", "event_id").select("user_id", "event_type", "first_seq")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n = 1 OR p <> event_type")
def consecutive_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return L.skip_repeats(e, ["user_id"], ["event_id"], "event_type")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_annotation_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.struct("l_orderkey", "l_linenumber").alias("ann_id"))
    return L.duplicate_ids(li).select("ann_id.l_orderkey", "ann_id.l_linenumber", F.col("count").alias("n"))


# prompts, captions, tokens -----------------------------------------------------------------------------

TURNS = "SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'USER' ELSE 'ASSISTANT' END AS r, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.table(spark, sf_dir, "conversations").withColumn("role", F.when(F.col("role") == "user", "USER").otherwise("ASSISTANT"))
    return T.conversations(c)


@query(f"WITH t AS ({TURNS}) SELECT conv_id, 'Talk. ' || string_agg(r || ': ' || text || CASE WHEN i % 2 = 0 THEN ' ' ELSE '</s>' END, '' ORDER BY i) AS prompt FROM t GROUP BY conv_id")
def prompt_two_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", T.prompt(F.col("turns"), "two", "Talk.", " ", "</s>").alias("prompt"))


@query(f"WITH t AS ({TURNS}), p AS (SELECT conv_id, string_agg(CASE WHEN i % 2 = 0 THEN '<s>[INST] ' || CASE WHEN i = 0 THEN '<<SYS>>' || chr(10) || 'Help.' || chr(10) || '<</SYS>>' || chr(10) || chr(10) ELSE '' END || text || ' [/INST]' ELSE ' ' || text || ' </s>' END, '' ORDER BY i) AS prompt FROM t GROUP BY conv_id) SELECT conv_id, CASE WHEN starts_with(prompt, '<s>') THEN substr(prompt, 4) ELSE prompt END AS prompt FROM p")
def prompt_llama2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", T.prompt(F.col("turns"), "llama2", "Help.", "<s>", "</s>").alias("prompt"))


@query(f"WITH t AS ({TURNS}) SELECT conv_id, count(*) AS n, string_agg(CASE WHEN i % 2 = 1 THEN '<sep>' || text || '<sep>' ELSE '[grounding]' || text END, '|' ORDER BY i) AS said FROM t GROUP BY conv_id HAVING count(*) % 2 = 0")
def instruction_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir).withColumn("said", T.instruction_turns(F.transform("turns", lambda x: x["text"]))).where("said is not null")
    return t.select("conv_id", F.size("turns").cast("long").alias("n"), F.array_join("said", "|").alias("said"))


@query("SELECT doc_id, substr(text, 1, 5) || '<p>' || substr(text, 6, 7) || '</p><roi><ground_box><ground_box></roi>' || substr(text, 13, 8) || '<p>' || substr(text, 21, 10) || '</p><roi><ground_box></roi>' || substr(text, 31) AS caption FROM documents")
def grounded_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    d = X.table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", T.grounded_caption(F.col("text"), F.array(span(20, 30), span(5, 12), span(5, 12))).alias("caption"))


@query("SELECT doc_id, trim(replace(replace(text, '<image>', ''), chr(10), ' ')) AS cleaned FROM documents")
def llava_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "documents").select("doc_id", T.without_image_tag(F.col("text")).alias("cleaned"))


@query("WITH t AS (SELECT doc_id, '<p>' || replace(text, ' ', '  ') || '</p>' || chr(10) || '<roi>''' AS text FROM documents) SELECT doc_id, trim(trim(regexp_replace(regexp_replace(replace(replace(text, chr(10), ''), '  ', ' '), '<.*?>', '', 'g'), ' +', ' ', 'g')), '''') AS caption FROM t")
def caption_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.table(spark, sf_dir, "documents")
    raw = F.concat(F.lit("<p>"), F.replace(F.col("text"), F.lit(" "), F.lit("  ")), F.lit("</p>\n<roi>'"))
    return d.select("doc_id", T.clean_caption(raw).alias("caption"))


@query("SELECT conv_id, turn, upper(substr(lower(trim(text)), 1, 1)) || substr(lower(trim(text)), 2) AS answer FROM conversations")
def capitalize_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.capitalised(F.col("text")).alias("answer"))


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toy tokens of a conversation: 7 opens and closes answers, 2 ends a turn."""
    c = X.table(spark, sf_dir, "conversations").select("conv_id", F.explode(F.array(*(F.struct((F.col("turn") * 4 + k).alias("p"), v.alias("t")) for k, v in enumerate((F.lit(7), F.expr("int(10 + (turn * 3 + conv_id) % 50)"), F.lit(7), F.lit(2)))))).alias("s"))
    return c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]).alias("ids"))


@query(
    """WITH t AS (SELECT conv_id, turn * 4 + k AS p, CASE k WHEN 0 THEN 7 WHEN 1 THEN 10 + (turn * 3 + conv_id) % 50 WHEN 2 THEN 7 ELSE 2 END AS t FROM conversations, range(0, 4) r(k)),
u AS (SELECT *, sum(CASE WHEN t = 7 THEN 1 ELSE 0 END) OVER w AS seps, sum(CASE WHEN t = 2 THEN 1 ELSE 0 END) OVER w AS ends FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY p ROWS UNBOUNDED PRECEDING))
SELECT conv_id, string_agg(CAST(t AS VARCHAR), ',' ORDER BY p) AS ids, string_agg(CAST(CASE WHEN t = 2 AND ends > 1 THEN t WHEN seps % 2 = 1 THEN t ELSE -100 END AS VARCHAR), ',' ORDER BY p) AS labels FROM u WHERE t <> 7 GROUP BY conv_id"""
)
def label_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _ids(spark, sf_dir).select("conv_id", T.label_mask(F.col("ids"), 7, 2).alias("m"))
    return m.select("conv_id", *(F.array_join(F.col(f"m.{k}").cast("array<string>"), ",").alias(k) for k in ("ids", "labels")))


@query("""WITH t AS (SELECT conv_id, turn * 4 + k AS p, CASE k WHEN 0 THEN 7 WHEN 1 THEN 10 + (turn * 3 + conv_id) % 50 WHEN 2 THEN 7 ELSE 2 END AS t FROM conversations, range(0, 4) r(k)) SELECT conv_id, string_agg(CASE t WHEN 7 THEN '7,7,7' WHEN 2 THEN '9,9,9,9' ELSE CAST(t AS VARCHAR) END, ',' ORDER BY p) AS ids FROM t GROUP BY conv_id""")
def placeholder_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _ids(spark, sf_dir).select("conv_id", T.expand_placeholders(F.col("ids"), F.col("ids"), 7, 3, 2, 2, 0, 9).alias("e"))
    return e.select("conv_id", F.array_join(F.col("e.ids").cast("array<string>"), ",").alias("ids"))


@query("""WITH n AS (SELECT conv_id, count(*) * 4 AS len, conv_id // 8 AS batch FROM conversations GROUP BY conv_id) SELECT conv_id, batch, max(len) OVER (PARTITION BY batch) AS padded, len AS attended FROM n""")
def pad_collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.pad_batch(_ids(spark, sf_dir).withColumn("batch", F.expr("conv_id div 8")), ["batch"], {"ids": 0}, "ids")
    return d.select("conv_id", "batch", F.size("ids").cast("long").alias("padded"), F.size(F.filter("attention_mask", lambda x: x)).cast("long").alias("attended"))


@query("SELECT doc_id, [CAST(quality AS DOUBLE), CAST(toxic AS DOUBLE)] AS scores FROM labels")
def judge_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    review = F.concat(F.col("quality").cast("string"), F.lit(","), F.col("toxic").cast("string"), F.lit("\nBecause."))
    return X.table(spark, sf_dir, "labels").select("doc_id", T.parse_scores(review).alias("scores"))


@query("WITH r AS (SELECT source AS category, quality AS a, toxic AS b FROM labels JOIN documents USING (doc_id)), m AS (SELECT coalesce(category, 'all') AS category, round(avg(a), 3) AS mean1, round(avg(b), 3) AS mean2 FROM r GROUP BY ROLLUP (category)) SELECT *, round(mean2 / nullif(mean1, 0) * 100, 1) AS ratio FROM m")
def judge_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("category"))
    r = X.table(spark, sf_dir, "labels").join(d, "doc_id").withColumn("score1", F.col("quality").cast("double")).withColumn("score2", F.col("toxic").cast("double"))
    return M.judge_summary(r)


@query("SELECT version, CAST(CASE WHEN pre = '' THEN 0 WHEN pre = 'rc' THEN -1 ELSE 1 END AS INT) AS stage, a AS major, b AS minor FROM (SELECT (o_orderkey % 3) || '.' || (o_orderkey % 11) || CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'rc2' ELSE '.post3' END AS version, CAST(o_orderkey % 3 AS INT) AS a, CAST(o_orderkey % 11 AS INT) AS b, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'rc' ELSE 'post' END AS pre FROM orders)")
def version_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = X.table(spark, sf_dir, "orders")
    v = o.select(F.expr("concat(string(o_orderkey % 3), '.', string(o_orderkey % 11), CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'rc2' ELSE '.post3' END)").alias("version"))
    k = T.version_key(F.col("version"))
    return v.select("version", k[4].alias("stage"), k[0].alias("major"), k[1].alias("minor"))


# datasets and batches ----------------------------------------------------------------------------------


@query("WITH d AS (SELECT 'fr' AS source, doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS src_ord, 0 AS k FROM documents WHERE lang = 'fr' UNION ALL SELECT 'de', doc_id, row_number() OVER (ORDER BY doc_id) - 1, 1 FROM documents WHERE lang = 'de') SELECT source, doc_id, CAST(src_ord AS INT) AS src_ord, row_number() OVER (ORDER BY k, src_ord) - 1 AS row_idx FROM d")
def concat_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.table(spark, sf_dir, "documents").select("doc_id", "lang")
    c = C.concat({k: d.where(F.col("lang") == k).select("doc_id") for k in ("fr", "de")}, "doc_id")
    return c.select("source", "doc_id", "src_ord", F.col("row_idx").cast("long").alias("row_idx"))


@query("SELECT r_regionkey, CAST(c AS INT) AS copy, c * (SELECT count(*) FROM region) + r_regionkey AS long_idx FROM region, range(0, 4) t(c)")
def repeat_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.repeat(X.table(spark, sf_dir, "region").select("r_regionkey"), 4, "r_regionkey")


@query("WITH p AS (SELECT DISTINCT doc_id AS image_id, lang AS class_id FROM documents UNION SELECT DISTINCT doc_id, source FROM documents), n AS (SELECT count(DISTINCT image_id) AS n FROM p), s AS (SELECT class_id, greatest(1.0, sqrt(0.2 / (count(*) / any_value(n)))) AS r FROM p, n GROUP BY class_id), f AS (SELECT image_id, max(r) AS f FROM p JOIN s USING (class_id) GROUP BY image_id) SELECT image_id, round(f, 9) AS factor, CAST(ceil(f) AS BIGINT) AS copies FROM f")
def class_balanced_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.table(spark, sf_dir, "documents")
    pairs = d.select(F.col("doc_id").alias("image_id"), F.explode(F.array("lang", "source")).alias("class_id"))
    b = C.class_balanced(d.select(F.col("doc_id").alias("image_id")), pairs, 0.2)
    return b.groupBy("image_id").agg(F.round(F.max("factor"), 9).alias("factor"), F.count("*").alias("copies"))


ORD = "doc_id * 7919 % 10007"


@query(f"WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {ORD}, doc_id) - 1 AS r FROM documents), b AS (SELECT *, r // 8 AS batch, CAST(r % 8 AS INT) AS slot, count(*) OVER (PARTITION BY source, r // 8) AS n FROM r) SELECT doc_id, source, batch, slot FROM b WHERE n = 8")
def source_grouped_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.table(spark, sf_dir, "documents").select("doc_id", "source")
    return S.grouped_batches(d, "source", 8, "doc_id", F.expr(ORD)).select("doc_id", "source", "batch", "slot")


@query(f"WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {ORD}, doc_id) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents), p AS (SELECT doc_id, lang, p AS pos FROM r, range(0, 40000) t(p) WHERE p < ceil(n / 16.0) * 16 AND p % n = r AND p < 2 * n + 16) SELECT doc_id, lang, pos, pos // 16 AS batch, CAST(pos % 16 AS INT) AS slot FROM p")
def group_sampler_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.padded_group_batches(X.table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 16, "doc_id", F.expr(ORD))


@query(f"WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {ORD}, doc_id) - 1 AS r, count(*) OVER () AS n FROM documents), p AS (SELECT doc_id, r AS pos FROM r UNION ALL SELECT doc_id, r + n FROM r WHERE r + n < ceil(n / 7.0) * 7) SELECT doc_id, CAST(pos % 7 AS INT) AS rank, pos // 7 AS rank_pos FROM p")
def dist_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.distributed_stride(X.table(spark, sf_dir, "documents").select("doc_id"), 7, "doc_id", F.expr(ORD))


@query(f"WITH {GT} SELECT image_id, class_id, CAST(count(*) AS BIGINT) AS n, round(sum(x1), 3) AS total FROM gt GROUP BY ALL")
def boxes_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.gt(spark, sf_dir).select("image_id", F.concat(F.lit(" Class"), F.col("class_id").cast("string")).alias("label_text"), F.col("gt_idx").alias("ann_id"), *B.Box._fields)
    b = C.boxes_by_label(g)
    return b.select("image_id", F.replace("label", F.lit("class"), F.lit("")).cast("int").alias("class_id"), F.size("boxes").cast("long").alias("n"), F.round(F.aggregate("boxes", F.lit(0.0), lambda s, x: s + x[0]), 3).alias("total"))


@query(f"WITH {IMG} SELECT image_id, CAST(v AS INT) AS view, CAST(CASE WHEN v < 2 THEN 400 ELSE 600 END AS INT) AS view_w, CASE WHEN v % 2 = 1 THEN 'horizontal' END AS view_flip FROM images, range(0, 4) t(v)")
def test_time_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.views(X.images(spark, sf_dir), [(400, 300), (600, 500)], [None, "horizontal"]).select("image_id", "view", "view_w", "view_flip")


@query(f"WITH {IMG} SELECT image_id, CAST(CASE WHEN width > height THEN 1 ELSE 0 END AS INT) AS flag, CAST(floor(width * least(1333.0::DOUBLE / greatest(width, height), 800.0::DOUBLE / least(width, height)) + 0.5) AS INT) AS new_w FROM images")
def aspect_and_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, _, _ = B.new_size(F.col("width"), F.col("height"), (1333, 800))
    return S.aspect_flag(X.images(spark, sf_dir)).select("image_id", F.col("flag").cast("int").alias("flag"), w.alias("new_w"))


@query(f"WITH {DET}, s AS (SELECT DISTINCT image_id FROM det WHERE det_idx % 3 = 0 INTERSECT SELECT DISTINCT image_id FROM det WHERE det_idx % 5 = 0) SELECT image_id FROM s WHERE image_id NOT IN (SELECT image_id FROM det WHERE det_idx % 97 = 0)")
def set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.det(spark, sf_dir)
    part = lambda k: d.where(f"det_idx % {k} = 0")
    return C.without(C.ids_in_all(part(3), part(5)), part(97), "image_id")


# logs, workers, windows --------------------------------------------------------------------------------


@query("SELECT event_id, round(sum(value * (event_id % 5 + 1)) OVER w / sum(event_id % 5 + 1) OVER w + 1e-9, 6) AS avg FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS 9 PRECEDING)")
def log_weighted_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.expr("event_id % 5 + 1").alias("n"))
    return M.weighted_log_average(e, ["event_type"], "event_id", "value", "n", 10).select("event_id", F.round(F.col("avg") + 1e-9, 6).alias("avg"))


@query("SELECT event_id, max(value) OVER w AS best, coalesce(value > max(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.best_so_far(X.table(spark, sf_dir, "events"), ["event_type"], "event_id", "value").select("event_id", "best", "improved")


SNAP = f"{HB}, n AS (SELECT max(ts) - 100 AS now FROM hb), l AS (SELECT worker, max(ts) AS ts, arg_max(queue_length, ts) AS queue_length, arg_max(speed, ts) AS speed, arg_max(models, ts) AS models, arg_max(check_hb, ts) AS check_hb FROM hb, n WHERE ts <= now GROUP BY worker), live AS (SELECT l.* FROM l, n WHERE NOT check_hb OR ts >= now - 30)"


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = X.heartbeats(spark, sf_dir)
    now = h.agg(F.max("ts") - 100).first()[0]
    return R.snapshot(h, now)


@query(f"WITH {SNAP} SELECT worker, ts, queue_length FROM live")
def worker_ttl_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live(spark, sf_dir).select("worker", "ts", "queue_length")


@query(f"WITH {SNAP}, m AS (SELECT unnest(models) AS model, worker, queue_length / speed AS q FROM live) SELECT model, arg_min(worker, (q, worker)) AS worker FROM m GROUP BY model")
def shortest_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.shortest_queue(_live(spark, sf_dir).withColumn("model", F.explode("models")), ["model"])


@query(f"WITH {SNAP} SELECT DISTINCT unnest(models) AS model FROM live")
def worker_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.worker_models(_live(spark, sf_dir))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_log_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.daily_counts(X.table(spark, sf_dir, "events"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tumbling(X.table(spark, sf_dir, "events"), "6 hours", late="1 day", by=["event_type"]).withColumn("total", F.round("total", 4))


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def event_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sessions(X.table(spark, sf_dir, "events"), "6 hours", "user_id")


@query("WITH l AS (SELECT * FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts AS click_ts, event_id AS click_id FROM events WHERE event_type = 'click') SELECT l.event_id, r.click_id FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.click_ts")
def event_as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.table(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"))
    return P.as_of_join(left, right, ["user_id"], "ts", "click_ts").select("event_id", F.col("right.click_id").alias("click_id"))


@query("SELECT t AS step, round(0.1 * pow(0.1, CASE WHEN t >= 80 THEN 2 WHEN t >= 50 THEN 1 ELSE 0 END), 9) AS step_lr, round(0.001 + 0.5 * (0.1 - 0.001) * (cos(pi() * t / 100) + 1), 9) AS cos_lr, round((0.1 - 0.001) * pow(1 - t / 100, 0.9) + 0.001, 9) AS poly_lr FROM range(0, 100) r(t)")
def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("step").cast("double")
    d = spark.range(100).withColumnRenamed("id", "step")
    r = lambda c, n: F.round(c, 9).alias(n)
    return d.select("step", r(N.step_schedule(t, 0.1, [50, 80]), "step_lr"), r(N.cosine_schedule(t, 100, 0.1, 0.001), "cos_lr"), r(N.poly_schedule(t, 100, 0.1, 0.9, 0.001), "poly_lr"))


@query(f"WITH {DET}, {GT} SELECT d.det_idx, round(CASE WHEN abs(d.x1 - g.x1) < 20 THEN 0.5 * (d.x1 - g.x1) * (d.x1 - g.x1) / 20 ELSE abs(d.x1 - g.x1) - 10 END, 9) AS smooth, round(-(ln(d.score + 0.001)) * 0.25 * pow(1 - d.score, 2), 9) AS focal FROM det d JOIN gt g ON d.det_idx = g.gt_idx")
def row_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = X.gt(spark, sf_dir).select(F.col("gt_idx").alias("det_idx"), F.col("x1").alias("t"))
    s = F.col("score")
    return X.det(spark, sf_dir).join(g, "det_idx").select("det_idx", F.round(N.smooth_l1(F.col("x1"), F.col("t"), 20.0), 9).alias("smooth"), F.round(-F.log(s + 0.001) * 0.25 * F.pow(1 - s, F.lit(2.0)), 9).alias("focal"))
