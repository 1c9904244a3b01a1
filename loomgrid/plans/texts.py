"""Queries over string, token and configuration functions that the record queries do not show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions import masks as K
from loomgrid.functions import text as T
from loomgrid.operators.captions import consensus
from loomgrid.plans import fixtures as X
from loomgrid.plans.families import Queries
from loomgrid.session import reachable

query = Queries()
table = X.table
Q1 = "(SELECT conv_id, turn, text FROM conversations)"


def _conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


@query("SELECT conv_id, turn, substr(text, 3, 6) AS phrase, 2 AS n_boxes, 3.0::DOUBLE AS last_x2, '<ground_box><ground_box>' AS answer FROM conversations")
def span_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4: of three boxes two share the chosen span."""
    row = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    exps = F.array(row(2, 8, 0, 0, 1, 1), row(0, 1, 0, 0, 2, 2), row(2, 8, 1, 1, 3, 3))
    q = T.span_question(F.col("text"), exps, row(2, 8))
    return _conv(spark, sf_dir).withColumn("q", q).select("conv_id", "turn", "q.phrase", F.size("q.boxes").alias("n_boxes"), F.col("q.boxes")[1][2].alias("last_x2"), "q.answer")


@query("SELECT p_partkey, 'Locate all ' || lower(trim(p_name)) || ' in the image.' AS dq, '<p>' || lower(trim(p_name)) || '</p><roi>' || repeat('<ground_box>', CAST(p_partkey % 4 + 1 AS INT)) || '</roi>' AS da, 'Locate ' || lower(trim(p_name)) || ' in the image.' AS rq, '<p>' || lower(trim(p_name)) || '</p><roi><ground_box></roi>' AS ra FROM part")
def detection_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5, ST6."""
    name = F.concat(F.lit(" "), F.col("p_name"), F.lit(" "))
    d = table(spark, sf_dir, "part").select("p_partkey", T.detection_question(name, F.expr("int(p_partkey % 4 + 1)")).alias("d"), T.referring_question(name).alias("r"))
    return d.select("p_partkey", F.col("d.question").alias("dq"), F.col("d.answer").alias("da"), F.col("r.question").alias("rq"), F.col("r.answer").alias("ra"))


CAPS = "c AS (SELECT conv_id, turn, upper(substr(lower(trim(text)), 1, 1)) || substr(lower(trim(text)), 2) AS t FROM conversations)"


@query(f"WITH {CAPS} SELECT conv_id, string_agg('user=Describe the region <refer_box>.|assistant=' || t, '|' ORDER BY turn) AS said FROM c GROUP BY conv_id")
def region_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST7, ST8."""
    t = T.conversations(_conv(spark, sf_dir)).withColumn("r", T.region_rounds(F.transform("turns", lambda x: x["text"])))
    return t.select("conv_id", F.array_join(F.transform("r", lambda x: F.concat(x["role"], F.lit("="), x["text"])), "|").alias("said"))


@query("WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) SELECT conv_id, 'Sys' || '###' || string_agg(role || ': ' || text || '###', '' ORDER BY i) AS single, string_agg(text || CASE WHEN i % 2 = 0 THEN ' ' ELSE chr(10) END, '' ORDER BY i) AS plain FROM t GROUP BY conv_id")
def prompt_other_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1."""
    t = T.conversations(_conv(spark, sf_dir))
    return t.select("conv_id", T.prompt(F.col("turns"), "single", "Sys", "###").alias("single"), T.prompt(F.col("turns"), "plain", "", " ", "\n").alias("plain"))


@query("SELECT * FROM (VALUES ('default', 'two', 'USER', 'ASSISTANT', ' ', '</s>'), ('llama2', 'llama2', 'USER', 'ASSISTANT', '<s>', '</s>'), ('plain', 'plain', '', '', chr(10), chr(10)), ('single', 'single', 'Human', 'Assistant', '###', '')) t(template, style, \"user\", assistant, sep, sep2)")
def prompt_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2."""
    return T.templates(spark).drop("system")


IDS = "t AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 9 WHEN 1 THEN 20 + conv_id % 5 ELSE 31 END AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)"


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _conv(spark, sf_dir).select("conv_id", "turn", F.expr("int(CASE turn % 3 WHEN 0 THEN 9 WHEN 1 THEN 20 + conv_id % 5 ELSE 31 END)").alias("id"))
    return c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "id"))), lambda s: s["id"]).alias("ids"))


def _joined(c) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query(f"""WITH {IDS}, u AS (SELECT *, sum(CASE WHEN id = 9 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS k, CASE id WHEN 20 THEN 0 WHEN 21 THEN 1 WHEN 22 THEN 2 WHEN 23 THEN 3 END AS place FROM t)
SELECT conv_id, string_agg(CASE WHEN id = 9 AND k <= 2 THEN 100 + k ELSE id END, ',' ORDER BY i) AS filled, coalesce(string_agg(place, ',' ORDER BY i) FILTER (WHERE place < 2), '') AS boxes, string_agg(CASE WHEN id < 25 THEN id ELSE 0 END, ',' ORDER BY i) AS old, string_agg(CASE WHEN id >= 25 THEN id - 25 ELSE 0 END, ',' ORDER BY i) AS new FROM u GROUP BY conv_id""")
def token_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST13, ST15, ST30."""
    t = _tokens(spark, sf_dir)
    s = T.split_embedding(F.col("ids"), 25)
    filled = T.fill_placeholders(F.col("ids"), 9, F.array(F.lit(101), F.lit(102)))
    return t.select("conv_id", _joined(filled).alias("filled"), _joined(T.box_tokens(F.col("ids"), [20, 21, 22, 23], F.lit(2))).alias("boxes"), _joined(s["old"]).alias("old"), _joined(s["new"]).alias("new"))


@query("WITH s AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS a, max(CASE WHEN turn = 1 THEN text END) AS b FROM conversations GROUP BY conv_id) SELECT conv_id, '[Context]' || chr(10) || 'one' || chr(10) || 'two' || chr(10) || chr(10) || 'cat: [1.0, 2.5]' || chr(10) || 'dog: [3.0]' || chr(10) || chr(10) || '[Question]' || chr(10) || a || chr(10) || chr(10) || '[Assistant 1 Judge]' || chr(10) || b || chr(10) || chr(10) || '[End of Assistant 1 Judge]' || chr(10) || chr(10) || '[Assistant 2 Judge]' || chr(10) || a || chr(10) || chr(10) || '[End of Assistant 2 Judge]' || chr(10) || chr(10) || '[System]' || chr(10) || 'Rate.' || chr(10) || chr(10) AS prompt FROM s WHERE a IS NOT NULL AND b IS NOT NULL")
def judge_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST17."""
    c = _conv(spark, sf_dir)
    s = c.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("a"), F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("b")).where("a is not null and b is not null")
    inst = F.array(F.struct(F.lit("cat").alias("category"), F.array(F.lit(1.0), F.lit(2.5)).alias("bbox")), F.struct(F.lit("dog").alias("category"), F.array(F.lit(3.0)).alias("bbox")))
    return s.select("conv_id", T.judge_prompt(F.array(F.lit("one"), F.lit("two")), inst, F.col("a"), F.col("b"), F.col("a"), F.lit("Judge"), F.lit("Rate.")).alias("prompt"))


@query("SELECT conv_id, turn, 'a\\_b' || chr(10) || '```x_y*z' || chr(10) || '```' || text AS shown FROM conversations WHERE text NOT LIKE '%```%'")
def code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST18."""
    raw = F.concat(F.lit("a\\_b\n```x\\_y\\*z\n```"), F.col("text"))
    return _conv(spark, sf_dir).where(~F.contains(F.col("text"), F.lit("```"))).select("conv_id", "turn", T.code_block_text(raw).alias("shown"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') || '-conv.json' AS name, dayofweek(ts) + 1 AS weekday, strftime(ts + INTERVAL 30 DAY, '%Y-%m') AS due FROM events")
def log_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST19, ST29."""
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", T.log_name(ts).alias("name"), F.dayofweek(ts).cast("long").alias("weekday"), F.date_format(ts + F.expr("INTERVAL 30 DAYS"), "yyyy-MM").alias("due"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN substr(text || repeat('x', 1500), 1, 1200) || chr(10) || '<image>' ELSE substr(text || repeat('x', 1500), 1, 1536) END AS guarded, text LIKE '%the%' OR text LIKE '%a b%' AS matched FROM conversations")
def input_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FI23, FI24: the cut at 1536 characters, or 1200 beside an image, is the rule itself."""
    c = _conv(spark, sf_dir)
    image = F.when(F.col("turn") % 2 == 1, F.lit("img"))
    long = F.concat(F.col("text"), F.repeat(F.lit("x"), F.lit(1500)))
    return c.select("conv_id", "turn", T.input_guard(long, image).alias("guarded"), T.matches_keyword(F.col("text"), ["the", "a b"]).alias("matched"))


@query("SELECT o_orderkey, 'model.' || o_orderkey || '.weight' AS name, CAST(o_orderkey % 7 AS INT) AS a, CAST(o_orderkey % 11 AS INT) AS b FROM orders")
def key_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST20, ST26: keys rewritten by patterns one after the other, and elements cast."""
    key = F.concat(F.lit("module.backbone."), F.col("o_orderkey").cast("string"), F.lit(".w"))
    cast = T.cast_elements(F.array(F.expr("string(o_orderkey % 7)"), F.expr("string(o_orderkey % 11)")), "int")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.rewritten(key, [(r"^module\.", ""), ("backbone", "model"), (r"\.w$", ".weight")]).alias("name"), cast[0].alias("a"), cast[1].alias("b"))


BITS = "b AS (SELECT o_orderkey, k, CAST((o_orderkey // (k + 1)) % 2 AS INT) AS v FROM orders, range(0, 12) t(k))"


@query(f"""WITH {BITS}, g AS (SELECT *, sum(CASE WHEN v = p THEN 0 ELSE 1 END) OVER (PARTITION BY o_orderkey ORDER BY k) AS run FROM (SELECT *, coalesce(lag(v) OVER (PARTITION BY o_orderkey ORDER BY k), 0) AS p FROM b)),
r AS (SELECT o_orderkey, run, count(*) AS n FROM g GROUP BY ALL) SELECT o_orderkey, CASE WHEN (SELECT v FROM b WHERE b.o_orderkey = r.o_orderkey AND k = 0) = 1 THEN '0,' ELSE '' END || string_agg(n, ',' ORDER BY run) AS runs, true AS back FROM r GROUP BY o_orderkey""")
def mask_run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST27: run lengths from zeros on, and back."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: (F.floor(F.col("o_orderkey") / (k + 1)) % 2).cast("int"))
    d = table(spark, sf_dir, "orders").select("o_orderkey", bits.alias("bits")).withColumn("runs", T.run_lengths(F.col("bits")))
    return d.select("o_orderkey", _joined(F.col("runs")).alias("runs"), (T.from_run_lengths(F.col("runs")) == F.col("bits")).alias("back"))


@query("""WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}'']+'), lambda x: x <> '') AS w FROM conversations),
g AS (SELECT conv_id, turn, len(w) AS l, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT conv_id, turn, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM t, range(1, 5) r(n) WHERE len(w) >= n)),
c AS (SELECT conv_id, turn, l, n, g, count(*) AS tf FROM g GROUP BY ALL), d AS (SELECT n, g, count(DISTINCT conv_id) AS df FROM c WHERE turn > 0 GROUP BY ALL), a AS (SELECT count(DISTINCT conv_id) AS m FROM t WHERE turn > 0),
w AS (SELECT c.*, tf * (ln(m) - ln(coalesce(df, 1))) AS w FROM c LEFT JOIN d USING (n, g), a), nm AS (SELECT conv_id, turn, n, sqrt(sum(w * w)) AS s FROM w GROUP BY ALL),
p AS (SELECT r.conv_id, r.turn, r.n, sum(least(x.w, r.w) * r.w) AS dot, any_value(x.l - r.l) AS gap FROM w x JOIN w r ON x.conv_id = r.conv_id AND x.n = r.n AND x.g = r.g AND x.turn = 0 AND r.turn > 0 GROUP BY ALL),
s AS (SELECT p.conv_id, sum(CASE WHEN a.s > 0 AND b.s > 0 THEN dot / (a.s * b.s) ELSE 0 END * exp(-gap * gap / 72.0::DOUBLE)) AS v FROM p JOIN nm a ON a.conv_id = p.conv_id AND a.turn = 0 AND a.n = p.n JOIN nm b ON b.conv_id = p.conv_id AND b.turn = p.turn AND b.n = p.n GROUP BY p.conv_id),
k AS (SELECT conv_id, count(*) AS n_refs FROM t WHERE turn > 0 GROUP BY conv_id) SELECT k.conv_id, n_refs, round(10 * coalesce(v, 0) / (4 * n_refs), 6) AS score FROM k JOIN t ON t.conv_id = k.conv_id AND t.turn = 0 LEFT JOIN s ON s.conv_id = k.conv_id""")
def caption_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG28: each conversation's first turn as a caption, scored against the turns that follow."""
    c = _conv(spark, sf_dir)
    d = consensus(c.where("turn = 0"), c.where("turn > 0").withColumnRenamed("turn", "ref_idx"), item="conv_id")
    return d.select("conv_id", "n_refs", F.round("score", 6).alias("score"))


#: Masks of 8 by 8 pixels from order and part numbers: a pixel is set by a bit of a product.
MASK = "CAST(((({k} + 1) * (i + 3)) // 7) % {m} = 0 AS INT)"
PIXELS = f"b AS (SELECT o_orderkey, i, {MASK.format(k='o_orderkey', m=2)} AS a, {MASK.format(k='o_custkey', m=3)} AS b FROM orders, range(0, 64) t(i))"
RUNS = "SELECT o_orderkey, list(n ORDER BY run) AS runs FROM (SELECT o_orderkey, run, count(*) AS n FROM (SELECT o_orderkey, i, sum(CASE WHEN {v} = p THEN 0 ELSE 1 END) OVER (PARTITION BY o_orderkey ORDER BY i) AS run FROM (SELECT *, coalesce(lag({v}) OVER (PARTITION BY o_orderkey ORDER BY i), 0) AS p FROM b)) GROUP BY ALL) GROUP BY o_orderkey"


def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    reachable(spark)
    bits = lambda k, m: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (F.floor((F.col(k) + 1) * (i + 3) / 7) % m == 0).cast("int"))
    d = table(spark, sf_dir, "orders").select("o_orderkey", bits("o_orderkey", 2).alias("a"), bits("o_custkey", 3).alias("b"))
    return d.select("*", T.run_lengths(F.col("a")).alias("ra"), T.run_lengths(F.col("b")).alias("rb"))


@query(f"""WITH {PIXELS}, r AS ({RUNS.format(v='a')}), z AS (SELECT o_orderkey, CASE WHEN (SELECT a FROM b WHERE b.o_orderkey = r.o_orderkey AND i = 0) = 1 THEN list_prepend(0, runs) ELSE runs END AS runs FROM r),
e AS (SELECT o_orderkey, runs, unnest(range(1, len(runs) + 1)) AS k FROM z), f AS (SELECT o_orderkey, k, runs[k] - CASE WHEN k > 3 THEN runs[k - 2] ELSE 0 END AS d FROM e),
c AS (SELECT o_orderkey, k, unnest(range(0, 3)) AS j, d FROM f), g AS (SELECT o_orderkey, k, j, (d >> (5 * j)) & 31 AS low, d >> (5 * (j + 1)) AS rest FROM c), m AS (SELECT *, CASE WHEN low & 16 > 0 THEN rest <> -1 ELSE rest <> 0 END AS more FROM g),
u AS (SELECT *, coalesce(bool_and(more) OVER (PARTITION BY o_orderkey, k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS used FROM m)
SELECT o_orderkey, string_agg(chr(CAST(48 + low + CASE WHEN more THEN 32 ELSE 0 END AS INT)), '' ORDER BY k, j) AS code, true AS back FROM u WHERE used GROUP BY o_orderkey""")
def compact_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST27: run counts as compact text, and back."""
    d = _masks(spark, sf_dir).select("o_orderkey", "ra", K.compact("ra").alias("code"))
    return d.select("o_orderkey", "code", (K.expand("code") == F.col("ra").cast("array<bigint>")).alias("back"))


@query(f"""WITH {PIXELS}, s AS (SELECT o_orderkey, sum(a) AS area, sum(a * b) AS inter, sum(b) AS other, coalesce(min(CASE WHEN a = 1 THEN i // 8 END), 0) AS x, coalesce(min(CASE WHEN a = 1 THEN i % 8 END), 0) AS y, coalesce(max(CASE WHEN a = 1 THEN i // 8 END) + 1, 0) AS x2, coalesce(max(CASE WHEN a = 1 THEN i % 8 END) + 1, 0) AS y2 FROM b GROUP BY o_orderkey)
SELECT o_orderkey, CAST(area AS BIGINT) AS area, x, y, x2 - x AS w, y2 - y AS h, CAST(inter AS BIGINT) AS inter, round(coalesce(inter / nullif(area + other - inter, 0), 0), 9) AS iou, round(coalesce(inter / nullif(area, 0), 0), 9) AS crowd_iou FROM s""")
def mask_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas, boxes and overlaps of masks from their runs alone."""
    d = _masks(spark, sf_dir).select("o_orderkey", K.measure("ra", F.lit(8)).alias("m"), K.overlap("ra", "rb", F.lit(False)).alias("o"), K.overlap("ra", "rb", F.lit(True)).alias("c"))
    return d.select("o_orderkey", "m.*", "o.inter", F.round("o.iou", 9).alias("iou"), F.round("c.iou", 9).alias("crowd_iou"))



@query("SELECT o_orderkey, o_orderkey || ';' || (o_orderkey + 1) || ',' || (o_orderkey + 2) AS parts, 1 AS polygons, (o_orderkey + 2) || ',' || o_orderkey AS gathered FROM orders")
def split_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST28, PR7, and boxes gathered by positions."""
    flat = F.array(*(F.col("o_orderkey") + k for k in range(3)))
    parts = T.split_by_lengths(flat, F.array(F.lit(1), F.lit(2)))
    poly = lambda n: F.array_repeat(F.lit(0.0), n)
    polygons = T.valid_polygons(F.array(poly(4), poly(6), poly(7)))
    got = T.gather_boxes(flat, F.array(F.array(F.lit(2)), F.array(F.lit(0))))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.transform(parts, _joined), ";").alias("parts"), F.size(polygons).alias("polygons"), _joined(got).alias("gathered"))


@query("SELECT page_id, regexp_extract(url, '^([^:/]+)://', 1) AS scheme, 's3' AS clustered, CAST(NULL AS VARCHAR) AS none FROM pages")
def uri_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC10."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", T.uri_scheme(F.col("url")).alias("scheme"), T.uri_scheme(F.concat(F.lit("cluster:s3://bucket/"), F.col("page_id").cast("string"))).alias("clustered"), T.uri_scheme(F.lit("/local/path")).alias("none"))


@query("SELECT * FROM (VALUES ('1', '1'), ('2.5', '2.5'), ('true', 'True'), ('[1,[2,3]]', '[1, [2, 3]]'), ('(1,a)', '(1, ''a'')'), ('x', '''x'''), ('1,2', '[1, 2]'), ('None', 'None')) t(given, parsed)")
def parsed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST24: values of a command line, which are parsed at the driver."""
    given = ["1", "2.5", "true", "[1,[2,3]]", "(1,a)", "x", "1,2", "None"]
    return spark.createDataFrame([(g, repr(T.parse_value(g))) for g in given], "given string, parsed string")


@query("SELECT * FROM (VALUES ('a.b', '9'), ('a.c', '2'), ('steps', '[1, 5]'), ('gone', '{''new'': 1}'), ('text', 'lr=9 of x')) t(key, value)")
def merged_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST23, ST25: a configuration merged with overrides and substituted into a text."""
    m = T.merge_config({"a": {"b": 1, "c": 2}, "steps": [1, 2], "gone": {"old": 1}}, {"a.b": 9, "steps": {"1": 5}, "gone": {"_delete_": True, "new": 1}})
    rows = [("a.b", m["a"]["b"]), ("a.c", m["a"]["c"]), ("steps", m["steps"]), ("gone", m["gone"]), ("text", T.substitute("lr={{ a.b }} of {{name}}", m | {"name": "x"}))]
    return spark.createDataFrame([(k, str(v)) for k, v in rows], "key string, value string")


QUERIES = query.queries
ORACLE_SQL = query.sql
