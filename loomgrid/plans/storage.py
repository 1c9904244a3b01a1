"""Queries that write the tables out in a store's format and read them back with this engine's readers.

Document formats (one JSON, XML or text object) are written from the two tables of fixed size, ``nation`` (25 rows) and ``region``; line
formats are written by Spark.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.operators import metrics as M
from loomgrid.plans import fixtures as X
from loomgrid.plans.families import Queries
from loomgrid.plans.fixtures import ANN, DET, IMG
from loomgrid.session import reachable, shared_folder
from loomgrid.sources import keyvalue as KV
from loomgrid.sources import stores as Z

query = Queries()
table = X.table


def folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/stores/{tag}-{uuid.uuid4().hex[:12]}"


# COCO and relatives: a document per 64 images, categories in the first -----------------------------------

PER = 64
CATS = [(3, "three", 1, "r"), (1, "one", 0, "c"), (2, "two", 1, "f")]
CAT_SQL = "(VALUES (3, 'three', true, 'r', 0), (1, 'one', false, 'c', 1), (2, 'two', true, 'f', 2)) c(category_id, name, isthing, frequency, label)"


def documents(spark: SparkSession, sf_dir: str) -> str:
    """Writes COCO-style documents of images and annotations; returns the folder."""
    img = X.images(spark, sf_dir).select(
        F.expr(f"coalesce(image_id div {PER}, -1)").alias("doc"),
        F.struct(F.col("image_id").alias("id"), F.concat(F.lit("COCO_val2014_"), F.lpad(F.col("image_id").cast("string"), 12, "0"), F.lit(".jpg")).alias("file_name"), "width", "height", F.concat(F.lit("picture "), F.col("image_id").cast("string")).alias("caption"), F.concat(F.lit("http://images.cocodataset.org/val2017/"), F.col("image_id").cast("string"), F.lit(".jpg")).alias("coco_url"), F.concat(F.lit("seg/"), F.col("image_id").cast("string"), F.lit(".png")).alias("segm_file")).alias("x"),
    )
    a = X.annotations(spark, sf_dir)
    seg = F.array(*(F.struct((F.col("ann_id") * 10 + k).alias("id"), F.lit(k + 1).alias("category_id"), F.lit(k).alias("iscrowd"), (F.col("ann_id") + k).alias("area")) for k in range(2)))
    ann = a.select(F.expr(f"coalesce(image_id div {PER}, -1)").alias("doc"), F.struct(F.col("ann_id").alias("id"), "image_id", F.expr("int(ann_id % 3 + 1)").alias("category_id"), "bbox", "area", F.col("iscrowd").cast("int").alias("iscrowd"), "ignore", seg.alias("segments_info"), F.concat(F.lit("pan/"), F.col("image_id").cast("string"), F.lit(".png")).alias("file_name"), F.array(F.array(F.lit(0), F.lit(3)), F.array(F.lit(4), F.lit(9))).alias("tokens_positive")).alias("x"))
    images, anns = (d.groupBy("doc").agg(F.collect_list("x").alias(n)) for d, n in ((img, "images"), (ann, "annotations")))
    cats = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(n).alias("name"), F.lit(t).alias("isthing"), F.lit(f).alias("frequency")) for i, n, t, f in CATS))
    doc = images.join(anns, "doc", "full").withColumn("categories", F.when(F.col("doc") == 0, cats))
    path = folder(spark, "coco")
    Z.put_objects(doc.select(F.concat(F.lit("doc="), "doc", F.lit(".json")).alias("key"), F.to_json(F.struct("images", "annotations", "categories")).alias("content")), path)  # a file each
    return path


@query(f"WITH {IMG} SELECT image_id, 'COCO_val2014_' || lpad(image_id::VARCHAR, 12, '0') || '.jpg' AS file_name, width, height, 'picture ' || image_id AS caption, 'seg/' || image_id || '.png' AS segm_file FROM images")
def coco_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC19, SC33."""
    return Z.read_coco(spark, documents(spark, sf_dir))[0]


@query(f"WITH {ANN} SELECT ann_id, image_id, CAST(ann_id % 3 + 1 AS INT) AS category_id, x, y, w, h, area, iscrowd, ignore FROM ann")
def coco_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC19, SC34."""
    a = Z.read_coco(spark, documents(spark, sf_dir))[1]
    return a.select("ann_id", "image_id", "category_id", *(F.col("bbox")[k].alias(n) for k, n in enumerate("xywh")), "area", "iscrowd", "ignore")


@query(f"SELECT category_id, name, isthing, frequency, label FROM {CAT_SQL}")
def coco_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC19, ST31: labels by place in the document."""
    return Z.read_coco(spark, documents(spark, sf_dir))[2]


@query(f"WITH {IMG} SELECT image_id, lpad(image_id::VARCHAR, 12, '0') || '.jpg' AS v05, 'val2017/' || image_id || '.jpg' AS v1 FROM images")
def lvis_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC20, SC21."""
    path = documents(spark, sf_dir)
    old, new = (Z.read_lvis(spark, path, v)[0].select("image_id", F.col("file_name").alias(n)) for v, n in (("v0.5", "v05"), ("v1", "v1")))
    return old.join(new, "image_id")


@query("SELECT category_id, name, CAST(category_id - 1 AS INT) AS label FROM (VALUES (1, 'one'), (2, 'two'), (3, 'three')) t(category_id, name)")
def objects365_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC22: categories sorted before they are numbered."""
    return Z.read_objects365(spark, documents(spark, sf_dir), "v1")[2].select("category_id", "name", "label")


@query("SELECT n_nationkey AS image_id, 'patch' || n_regionkey || '/' || n_name || '.jpg' AS file_name FROM nation WHERE n_regionkey <> 2")
def objects365_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC23: last folder and name, less a list of files."""
    n = table(spark, sf_dir, "nation")
    name = F.concat(F.lit("images/v2/patch"), F.col("n_regionkey").cast("string"), F.lit("/"), F.col("n_name"), F.lit(".jpg"))
    path = folder(spark, "objects")
    n.agg(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), name.alias("file_name"))).alias("images")).select(F.to_json(F.struct("images", F.expr("array()").alias("annotations"), F.expr("array()").alias("categories"))).alias("value")).write.text(path)
    drop = n.where("n_regionkey = 2").select(F.substring(name, 11, 1000).alias("file_name"))
    return Z.read_objects365(spark, path, "v2", drop)[0].select("image_id", "file_name")


@query(f"WITH {IMG}, {ANN} SELECT image_id, 'pan/' || image_id || '.png' AS segm_file, ann_id * 10 + k AS id, CAST(k + 1 AS INT) AS category_id, k = 1 AS iscrowd, ann_id + k AS area, width, height FROM ann JOIN images USING (image_id), range(0, 2) t(k)")
def panoptic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC32."""
    return Z.read_panoptic(spark, documents(spark, sf_dir))[1]


@query("SELECT l_orderkey, l_linenumber, l_linenumber + 256 * (l_partkey % 256) + 65536 * (l_suppkey % 256) AS id FROM lineitem")
def panoptic_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC41."""
    px = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").cast("long").alias("r"), F.expr("l_partkey % 256").alias("g"), F.expr("l_suppkey % 256").alias("b"))
    return Z.panoptic_ids(px).select("l_orderkey", "l_linenumber", "id")


# one object per nation ---------------------------------------------------------------------------------

XML = """<annotation><folder>region{r}</folder><filename>{n}.jpg</filename><size><width>{w}</width><height>{h}</height></size>
<object><name>known</name><difficult>0</difficult><bndbox><xmin>{a}.7</xmin><ymin>2</ymin><xmax>{b}</xmax><ymax>90.9</ymax></bndbox></object>
<object><name>strange</name><bndbox><xmin>1</xmin><ymin>1</ymin><xmax>5</xmax><ymax>5</ymax></bndbox></object>
<object><name>other</name><difficult>1</difficult><bndbox><xmin>1</xmin><ymin>1</ymin><xmax>9</xmax><ymax>8</ymax></bndbox></object></annotation>"""


def _xml(spark: SparkSession, sf_dir: str, **kw) -> tuple[DataFrame, DataFrame]:
    path = folder(spark, "voc")
    for r in table(spark, sf_dir, "nation").collect():  # 25 rows
        Z.put_object(spark, f"{path}/{r.n_nationkey}.xml", XML.format(r=r.n_regionkey, n=r.n_name, w=300 + r.n_nationkey, h=200, a=10 + r.n_nationkey, b=30 + 2 * r.n_nationkey).encode())
    Z.put_object(spark, f"{path}/notes.txt", b"not an annotation")
    classes = spark.createDataFrame([("known", 0), ("other", 1)], "name string, label int")
    return Z.read_voc(spark, path, classes, **kw)


@query("SELECT n_nationkey::VARCHAR AS image_id, n_name || '.jpg' AS file_name, 'region' || n_regionkey || '/' || n_name || '.jpg' AS wider_name, CAST(300 + n_nationkey AS INT) AS width FROM nation")
def voc_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC24, SC26."""
    a, b = _xml(spark, sf_dir)[0], _xml(spark, sf_dir, prefix_folder=True)[0]
    return a.select("image_id", "file_name", "width").join(b.select("image_id", F.col("file_name").alias("wider_name")), "image_id")


@query("SELECT n_nationkey::VARCHAR AS image_id, 0 AS pos, 0 AS label, CAST(9 + n_nationkey AS INT) AS x1, 1 AS y1, CAST(29 + 2 * n_nationkey AS INT) AS x2, 89 AS y2, 20 + n_nationkey < 30 AS is_ignore FROM nation UNION ALL SELECT n_nationkey::VARCHAR, 2, 1, 0, 0, 8, 7, true FROM nation")
def voc_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC25: whole corners less 1; difficult and small boxes are to be ignored."""
    return _xml(spark, sf_dir, least=30)[1]


def _open_images(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """Boxes, class list, image labels, challenge text and class tree, from the nations."""
    path = folder(spark, "open")
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows
    # an image per region: its rows come in stretches
    lines = [f"img{r.n_regionkey},x,/m/{r.n_nationkey % 3},1,0.{r.n_nationkey},0.9,0.1,0.5,1,0,{r.n_nationkey % 2},0,-1" for r in rows]
    Z.put_object(spark, f"{path}/boxes.csv", ("header\n" + "\n".join(lines) + "\n").encode())
    Z.put_object(spark, f"{path}/classes.csv", b"/m/0,Zero\n/m/1,One\n/m/2,Two\n")
    Z.put_object(spark, f"{path}/labels.csv", ("header\n" + "\n".join(f"img{r.n_nationkey},s,/m/{r.n_nationkey % 4},{r.n_nationkey % 2}" for r in rows) + "\n").encode())
    Z.put_object(spark, f"{path}/challenge.txt", "".join(f"{r.n_name}.jpg\nskipped\n2\n{r.n_nationkey + 1} 0.1 0.2 0.3 0.4 0\n1 0 0 1 0.5 1\n" for r in rows).encode())
    Z.put_object(spark, f"{path}/tree.json", b'{"LabelName": "root", "Subcategory": [{"LabelName": "a", "Subcategory": [{"LabelName": "b"}]}, {"LabelName": "c"}]}')
    return path, Z.read_class_names(spark, f"{path}/classes.csv")


@query("SELECT * FROM (VALUES ('/m/0', 'Zero', 0), ('/m/1', 'One', 1), ('/m/2', 'Two', 2)) t(mid, name, label)")
def openimages_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC28."""
    return _open_images(spark, sf_dir)[1]


OI = "l AS (SELECT n_nationkey AS k, 'img' || n_regionkey AS image_id, n_regionkey FROM nation), s AS (SELECT *, CASE WHEN lag(image_id) OVER (ORDER BY k) = image_id THEN 0 ELSE 1 END AS new FROM l), r AS (SELECT *, sum(new) OVER (PARTITION BY image_id ORDER BY k) - 1 AS run FROM s)"


@query(f"WITH {OI} SELECT image_id, CAST(run AS BIGINT) AS run, CAST(k % 3 AS INT) AS label, CAST('0.' || k AS DOUBLE) AS x1, 0.5::DOUBLE AS y2, k % 2 = 1 AS is_group_of, true AS is_occluded FROM r")
def openimages_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC27: an image is listed once per stretch of its lines."""
    path, classes = _open_images(spark, sf_dir)
    return Z.read_openimages(spark, f"{path}/boxes.csv", classes).select("image_id", "run", "label", "x1", "y2", "is_group_of", "is_occluded")


@query("SELECT 'img' || n_nationkey AS image_id, CAST(n_nationkey % 4 AS INT) AS label, CAST(n_nationkey % 2 AS DOUBLE) AS confidence FROM nation WHERE n_nationkey % 4 < 3")
def openimages_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC29."""
    path, classes = _open_images(spark, sf_dir)
    return Z.read_image_labels(spark, f"{path}/labels.csv", classes).select("image_id", "label", "confidence")


@query("SELECT n_name || '.jpg' AS file_name, 0 AS pos, CAST(n_nationkey AS INT) AS label, 0.1::DOUBLE AS x1, 0.2::DOUBLE AS y1, 0.3::DOUBLE AS x2, 0.4::DOUBLE AS y2, false AS is_group_of FROM nation UNION ALL SELECT n_name || '.jpg', 1, 0, 0, 0, 1, 0.5, true FROM nation")
def openimages_challenge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC30."""
    reachable(spark)
    return Z.read_challenge(spark, f"{_open_images(spark, sf_dir)[0]}/challenge.txt")


@query("SELECT * FROM (VALUES ('root', 'root'), ('a', 'a'), ('a', 'root'), ('b', 'b'), ('b', 'a'), ('b', 'root'), ('c', 'c'), ('c', 'root')) t(class_id, ancestor)")
def openimages_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC31: each class with itself and all above it."""
    return M.hierarchy_closure(Z.read_hierarchy(spark, f"{_open_images(spark, sf_dir)[0]}/tree.json"))


# records, lines and formats ----------------------------------------------------------------------------


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation")
def json_array_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC35: one document that is an array of records."""
    path = folder(spark, "array")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    n.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).write.text(path)
    return Z.read_json(spark, path).select("id", "name", "region")


@query("SELECT conv_id, turn, role, text FROM conversations")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC36, SC1, SC2: written as lines and loaded by extension."""
    path = f"{folder(spark, 'lines')}.jsonl"
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    Z.dump(c, path, "jsonl")
    return Z.load(spark, path).select("conv_id", F.col("turn").cast(c.schema["turn"].dataType).alias("turn"), "role", "text")


@query("SELECT fmt, count(*) AS n, sum(s_suppkey) AS total FROM supplier, (VALUES ('csv'), ('json'), ('parquet'), ('psv')) t(fmt) GROUP BY fmt")
def format_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC1-SC3: formats by extension, one of them registered here."""

    @Z.register_format("psv")
    def read_psv(spark: SparkSession, path: str) -> DataFrame:
        return spark.read.option("sep", "|").option("header", True).csv(path)

    s, base, out = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), folder(spark, "formats"), None
    for fmt in ("csv", "json", "parquet"):
        Z.dump(s, f"{base}/s.{fmt}", fmt)
    s.write.option("sep", "|").option("header", True).csv(f"{base}/s.psv")
    for fmt in ("csv", "json", "parquet", "psv"):
        one = Z.load(spark, f"{base}/s.{fmt}").select(F.lit(fmt).alias("fmt"), F.col("s_suppkey").cast("long").alias("k"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("fmt").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("SELECT * FROM (VALUES ('a', '1'), ('b', '[2, {\"c\": \"x y\"}]')) t(key, value)")
def yaml_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC7: a configuration document as JSON text."""
    path = f"{folder(spark, 'yaml')}/c.yaml"
    Z.put_object(spark, path, b"a: 1\nb:\n- 2\n- c: x y\n")
    whole = F.from_json("value", "a string, b string")
    d = Z.load(spark, path).select(whole.alias("d"))
    return d.select(F.explode(F.array(F.struct(F.lit("a").alias("key"), F.col("d.a").alias("value")), F.struct(F.lit("b").alias("key"), F.replace(F.replace("d.b", F.lit(","), F.lit(", ")), F.lit(":"), F.lit(": ")).alias("value")))).alias("r")).select("r.*")


@query("SELECT * FROM (VALUES ('a.pickle', true), ('b.pkl', true), ('c.weights', true)) t(name, refused)")
def refused_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC3, SC8: pickles, whose reading runs what they hold, and unknown formats are refused."""
    rows = []
    for name in ("a.pickle", "b.pkl", "c.weights"):
        try:
            Z.load(spark, name)
            rows.append((name, False))
        except TypeError:
            rows.append((name, True))
    return spark.createDataFrame(rows, "name string, refused boolean")


@query("SELECT n_nationkey, '{\"id\":' || n_nationkey || ',\"list\":[1,' || n_regionkey || ']}' AS value FROM nation")
def json_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC2, SC6: without a path the text itself; arrays and numbers become JSON values."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.array(F.lit(1).cast("long"), F.col("n_regionkey").cast("long")).alias("list"))
    return Z.dump(n).select(F.get_json_object("value", "$.id").cast("long").alias("n_nationkey"), "value")


def _names(spark: SparkSession, sf_dir: str) -> str:
    path = f"{folder(spark, 'text')}/names.txt"
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows
    Z.put_object(spark, path, "".join(f"k{r.n_nationkey % 7} v{r.n_nationkey} w{r.n_regionkey}\r\n" for r in rows).encode() + b"alone\n")
    return path


@query("SELECT CAST(n_nationkey AS INT) AS line, '> k' || (n_nationkey % 7) || ' v' || n_nationkey || ' w' || n_regionkey AS value FROM nation WHERE n_nationkey >= 3 AND n_nationkey < 13")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC4."""
    return Z.list_from_file(spark, _names(spark, sf_dir), "> ", 3, 10)


@query("SELECT 'k' || (n_nationkey % 7) AS key, arg_max('v' || n_nationkey || '+w' || n_regionkey, n_nationkey) AS v FROM nation GROUP BY ALL")
def text_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC5: a key's last line wins; lines of one word are no entries."""
    return Z.dict_from_file(spark, _names(spark, sf_dir)).select("key", F.array_join("values", "+").alias("v"))


@query("SELECT * FROM (VALUES ('a.JPG', 'any'), ('b.jpg', 'any'), ('deep/c.jpg', 'any'), ('b.jpg', 'exact'), ('deep/c.jpg', 'exact'), ('b.jpg', 'flat')) t(name, kind)")
def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC17, SC18: by suffix, with and without case, flat or deep; names with a leading dot are skipped."""
    path = folder(spark, "files")
    for name in ("a.JPG", "b.jpg", ".hidden.jpg", "deep/c.jpg", "notes.txt"):
        Z.put_object(spark, f"{path}/{name}", name.encode())
    kinds = {"any": dict(case_sensitive=False), "exact": {}, "flat": dict(recursive=False)}
    out = None
    for kind, kw in kinds.items():
        one = Z.list_files(spark, path, ".jpg", **kw).select(F.element_at(F.split("path", path.rsplit("/", 1)[-1] + "/"), -1).alias("name"), F.lit(kind).alias("kind"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT r_regionkey, 'object ' || r_name AS content, true AS there, false AS gone, 's3a://bucket/x/' || r_regionkey AS mapped FROM region")
def object_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC9, SC11-SC13: single objects by URI through the session's file systems, and path mapping."""
    path, rows = folder(spark, "objects"), []
    for r in table(spark, sf_dir, "region").collect():  # 5 rows
        Z.put_object(spark, f"{path}/{r.r_regionkey}", f"object {r.r_name}".encode())
        rows.append((r.r_regionkey, Z.get_object(spark, f"{path}/{r.r_regionkey}").decode(), Z.object_exists(spark, f"{path}/{r.r_regionkey}"), Z.object_exists(spark, f"{path}/none{r.r_regionkey}"), Z.mapped_path(f"s3://old/x/{r.r_regionkey}", {"s3://old/": "s3a://bucket/", "s3://": "s3a://"})))
    return spark.createDataFrame(rows, "r_regionkey bigint, content string, there boolean, gone boolean, mapped string")


def store_client(prefix: str):
    """A client as a key-value store's is: a function from key to bytes."""
    return lambda key: None if key.endswith("7") else f"{prefix}{key}".encode()


@query("SELECT s_suppkey::VARCHAR AS key, CASE WHEN s_suppkey % 10 <> 7 THEN 'value of ' || s_suppkey END AS content FROM supplier")
def key_value_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC14, SC15: a client per task; keys that are not there are null."""
    reachable(spark)
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("key"))
    return Z.read_keys(keys, store_client, "value of ").withColumn("content", F.col("content").cast("string"))


@query("SELECT 'data:text/plain,n' || n_nationkey AS key, 'n' || n_nationkey AS content FROM nation")
def url_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC16: here with URLs that hold their content, since there is no network."""
    reachable(spark)
    keys = table(spark, sf_dir, "nation").select(F.concat(F.lit("data:text/plain,n"), F.col("n_nationkey").cast("string")).alias("key"))
    return Z.read_keys(keys, Z.http_client).withColumn("content", F.col("content").cast("string"))


# proposals and results ---------------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE least(o_orderkey % 5, 2) END AS n, CASE WHEN o_orderkey % 5 = 0 THEN 0.0::DOUBLE ELSE 1.0 END AS first_x1, 4 AS width FROM orders")
def loaded_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC37: corners only, the first two; none becomes one zero box."""
    row = lambda k: F.array(*(F.lit(float(k + i)) for i in range(5)))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.slice(F.array(*(row(k) for k in range(1, 5))), F.lit(1), F.expr("int(o_orderkey % 5)")).alias("proposals"))
    p = Z.first_proposals(o, 2)
    return p.select("o_orderkey", F.size("proposals").cast("long").alias("n"), F.col("proposals")[0][0].alias("first_x1"), F.size(F.col("proposals")[0]).alias("width"))


LAB = "(VALUES (0, 18), (1, 44), (2, 1), (3, 90), (4, 7)) c(class_id, category_id)"


def _labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, 18), (1, 44), (2, 1), (3, 90), (4, 7)], "label int, category_id int")


@query(f"WITH {DET} SELECT image_id, x1, y1, x2 - x1 AS w, y2 - y1 AS h, score, category_id, kind FROM det JOIN {LAB} USING (class_id), (VALUES ('bbox'), ('segm')) k(kind) UNION ALL SELECT image_id, x1, y1, x2 - x1, y2 - y1, score, 1, 'proposal' FROM det")
def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC42-SC46: a JSON file per kind of result, read back."""
    d = X.det(spark, sf_dir).withColumn("segmentation", F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    boxes, masks = Z.segmentation_rows(d, _labels(spark))
    paths = Z.write_results(f"{folder(spark, 'results')}/r", bbox=boxes, segm=masks, proposal=Z.detection_rows(d, None))
    out = None
    for kind, p in paths.items():
        b = F.col("segmentation" if kind == "segm" else "bbox")
        one = spark.read.json(p).select("image_id", *(b[k].alias(n) for k, n in enumerate(("x1", "y1", "w", "h"))), "score", F.col("category_id").cast("int").alias("category_id"), F.lit(kind).alias("kind"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {DET} SELECT 'mask' || det_idx || '.png ' || class_id || ' ' || CAST(image_id AS VARCHAR) AS value FROM det")
def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC47."""
    path = folder(spark, "txt")
    Z.write_lines(X.det(spark, sf_dir).withColumn("mask", F.concat(F.lit("mask"), F.col("det_idx").cast("string"), F.lit(".png"))), path, ["mask", "class_id", "image_id"])
    return spark.read.text(path)


@query("SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS key, o_orderstatus || ':' || o_custkey AS value, o_orderkey BETWEEN 1000 AND 1999 AS in_range, o_orderkey IN (7, 32, 5001) AS asked FROM orders")
def key_value_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC3, SC14, SC15: orders written to an ordered store by a data source and read back whole, by a stretch of keys and by keys; the conditions
    reach the store."""
    KV.register(spark)
    path = folder(spark, "kv").removeprefix("file://")
    key = F.lpad(F.col("o_orderkey").cast("string"), 12, "0")
    table(spark, sf_dir, "orders").select(key.alias("key"), F.concat_ws(":", "o_orderstatus", "o_custkey").cast("binary").alias("value")).write.format("keyvalue").mode("append").save(path)
    load = lambda push: spark.read.format("keyvalue").option("pushdown", push).load(path)
    pad = lambda n: f"{n:012d}"
    part = load(True).where((F.col("key") >= pad(1000)) & (F.col("key") < pad(2000))).select("key", F.lit(True).alias("in_range"))
    some = load(True).where(F.col("key").isin([pad(n) for n in (7, 32, 5001)])).select("key", F.lit(True).alias("asked"))
    d = load(False).join(part, "key", "left").join(some, "key", "left")
    return d.select("key", F.col("value").cast("string").alias("value"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("in_range", "asked")))


@query("SELECT page_id, CAST(octet_length(encode(replace(replace(coalesce(html, ''), chr(13), ' '), chr(10), ' '))) + 1 AS BIGINT) AS length, 's3a://bucket/pages/page_id=' || page_id AS mapped, lower(url) LIKE '%.html' AS is_html FROM pages")
def page_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC9, SC11-SC13, SC17, SC18: an object for each page, written by tasks, found again by a listing that reads no contents and is made by tasks, with its
    path mapped to another store; pages are told by suffix without regard to case."""
    path = folder(spark, "pages")
    p = table(spark, sf_dir, "pages")
    line = F.translate(F.coalesce("html", F.lit("")), "\r\n", "  ")  # an object of one line
    Z.put_objects(p.select(F.concat(F.lit("page_id="), "page_id", F.lit(".txt")).alias("key"), F.concat(line, F.lit("\n")).alias("content")), path)
    found = Z.list_objects(spark, path, ".txt", case_sensitive=False)
    place = F.regexp_extract("path", r"(page_id=-?\d+)\.[^./]*$", 1)  # the other store has no folders
    found = found.select(F.regexp_extract(place, r"(-?\d+)", 1).cast("long").alias("page_id"), "length", F.lit(Z.mapped_path(f"{path}/", {path: "s3a://bucket/pages"})).alias("to"), place.alias("place"))
    return found.join(p, "page_id").select("page_id", "length", F.concat("to", "place").alias("mapped"), F.endswith(F.lower("url"), F.lit(".html")).alias("is_html"))


@query("SELECT event_id AS row_idx, event_type FROM events")
def ranked_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC48, SC49: results of all ranks in order, without what padding repeated."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("row_idx"), "event_type")
    padding = e.where("row_idx % 5 = 0")
    return Z.ordered_results(e.unionByName(padding).unionByName(padding.withColumn("row_idx", F.col("row_idx") + e.count())), e.count())


@query("SELECT md5(u) AS md5, u AS content FROM (SELECT DISTINCT 'u' || (user_id % 50) AS u FROM events) WHERE u NOT IN ('u1', 'u2')")
def new_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC53."""
    c = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.expr("user_id % 50").cast("string")).cast("binary").alias("content"))
    have = spark.createDataFrame([("u1",), ("u2",)], "c string").select(F.md5(F.col("c").cast("binary")).alias("md5"))
    return Z.new_images(c, have).select("md5", F.col("content").cast("string").alias("content"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resumed_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC54."""
    d, done = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id")
    return Z.still_to_do(d, done, "doc_id")


@query("WITH f AS (SELECT l_orderkey AS video_id, l_linenumber - 1 AS frame_id, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) SELECT video_id, frame_id, round(frame_id / 25.0::DOUBLE, 6) AS time_s FROM f WHERE frame_id >= n - 4 AND frame_id < n - 1 AND (frame_id - (n - 4)) % 2 = 0")
def video_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC55: every second frame of the last four but one."""
    v = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("video_id"), (F.col("l_linenumber") - 1).alias("frame_id"))
    return Z.frames(v, 25.0, -4, -1, 2).withColumn("time_s", F.round("time_s", 6))


def _model(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"conv_id": pdf["conv_id"], "turn": pdf["turn"], "flagged": pdf["text"].str.len() % 2 == 0})


@query("SELECT conv_id, turn, length(text) % 2 = 0 AS flagged FROM conversations")
def scored_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FI22, UD8: a scorer of the caller's over batches."""
    reachable(spark)
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return Z.run_model(c, _model, f"conv_id {dict(c.dtypes)['conv_id']}, turn {dict(c.dtypes)['turn']}, flagged boolean")


@query("SELECT event_type, sum(CAST(event_id % 100 AS BIGINT)) AS total, sum(CAST(event_id % 100 AS BIGINT)) / 4 AS mean FROM events GROUP BY event_type")
def rank_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG34, AG35."""
    e = table(spark, sf_dir, "events").select("event_type", F.expr("event_id % 4").alias("rank"), F.expr("event_id % 100").alias("v"))
    s, m = M.reduce_ranks(e, "event_type", "v"), M.reduce_ranks(e, "event_type", "v", "mean", 4)
    return s.withColumnRenamed("v", "total").join(m.withColumnRenamed("v", "mean"), "event_type")


QUERIES = query.queries
ORACLE_SQL = query.sql
