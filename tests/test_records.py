import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomgrid.functions import text as T
from loomgrid.operators import annotations as L
from loomgrid.operators import compose as C
from loomgrid.operators import sampling as S
from loomgrid.plans import storage
from loomgrid.sources import stores as Z
from loomgrid.streaming import registry as R
from loomgrid.streaming import runs


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first()[0]


def arr(*v):
    return F.array(*map(F.lit, v))


def test_label_mask(spark):
    m = one(spark, T.label_mask(arr(1, 2, 7, 5, 6, 7, 2, 3, 7, 8, 7, 2), 7, 2))
    assert m.ids == [1, 2, 5, 6, 2, 3, 8, 2]
    assert m.labels == [-100, -100, 5, 6, 2, -100, 8, 2]


def test_placeholders(spark):
    e = one(spark, T.expand_placeholders(arr(1, 50, 2, 60, 3, 0, 0), arr(1, 50, 2, 60, 3, 0, 0), 50, 2, 60, 1, 0, 9))
    assert e.ids == [1, 50, 50, 2, 9, 9, 3] and e.labels == [1, -100, -100, 2, -100, -100, 3]
    assert one(spark, T.fill_placeholders(arr(5, 1, 5, 5), 5, arr(70, 71))) == [70, 1, 71, 5]
    assert one(spark, T.box_tokens(arr(4, 9, 11, 10), [9, 10, 11], F.lit(2))) == [0, 1]


def test_captions(spark):
    span = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    got = one(spark, T.grounded_caption(F.lit("A red cat on a mat"), F.array(span(15, 18), span(2, 9), span(2, 9))))
    assert got == "A <p>red cat</p><roi><ground_box><ground_box></roi> on a <p>mat</p><roi><ground_box></roi>"
    assert one(spark, T.clean_caption(F.lit("<p>a  b</p>\n 'c'"))) == "a b 'c"
    assert one(spark, T.capitalised(F.lit("  A Red CAT "))) == "A red cat"
    assert one(spark, T.parse_scores(F.lit("8, 7.5\nwhy"))) == [8.0, 7.5]
    assert one(spark, T.parse_scores(F.lit("8\nwhy"))) == [-1.0, -1.0]
    assert one(spark, T.uri_scheme(F.lit("cluster:s3://b/k"))) == "s3" and one(spark, T.uri_scheme(F.lit("/a/b"))) is None


def test_prompt_styles(spark):
    turns = F.array(F.struct(F.lit("U").alias("role"), F.lit("hi").alias("text")), F.struct(F.lit("A").alias("role"), F.lit(None).cast("string").alias("text")))
    assert one(spark, T.prompt(turns, "two", "S", " ", "</s>")) == "S U: hi A:"
    assert one(spark, T.prompt(turns, "single", "S", "###")) == "S###U: hi###A:"


def test_run_lengths_round_trip(spark):
    bits = arr(1, 1, 0, 0, 0, 1, 0)
    assert one(spark, T.run_lengths(bits)) == [0, 2, 3, 1, 1]
    assert one(spark, T.from_run_lengths(T.run_lengths(bits))) == [1, 1, 0, 0, 0, 1, 0]


def test_configuration_text():
    assert T.parse_value("[1,(2,3.5),'x']") == [1, (2, 3.5), "x"] and T.parse_value("true") is True and T.parse_value("a") == "a"
    base = {"a": {"b": 1, "c": [1, {"d": 2}]}, "e": 1}
    assert T.merge_config(base, {"a": {"c": {"1": {"d": 5}}}, "e": 2}) == {"a": {"b": 1, "c": [1, {"d": 5}]}, "e": 2}
    assert T.merge_config(base, {"a": {"_delete_": True, "z": 1}}) == {"a": {"z": 1}, "e": 1}
    assert T.merge_config({"a": {"b": 1}}, {"a.b": 3}) == {"a": {"b": 3}}
    assert T.substitute("x {{ f.name }}", {"f": {"name": "n"}}) == "x n"


def test_registry_and_compose(spark):
    reg = C.Registry("r")

    @reg.register()
    def over(df, n):
        return df.withColumn("keep", F.col("id") > n)

    with pytest.raises(KeyError):
        reg.register("over")(over)
    child = C.Registry("child", reg)
    child.register("twice")(lambda df: df.withColumn("id", F.col("id") * 2))
    out = C.compose(spark.range(5), [{"type": "over", "n": 2}, {"type": "child.twice"}], reg)
    assert sorted(r.id for r in out.collect()) == [6, 8] and child.get("over") is over


def test_assertions_raise(spark):
    a = spark.createDataFrame([(1,), (1,)], "ann_id int")
    with pytest.raises(Exception, match="duplicate id"):
        L.assert_unique(a).collect()
    with pytest.raises(Exception, match="no prediction"):
        L.join_predictions(spark.range(2).withColumnRenamed("id", "image_id"), spark.range(1).withColumnRenamed("id", "image_id")).collect()
    with pytest.raises(Exception, match="mixes sources"):
        S.single_source(spark.createDataFrame([(0, "a"), (0, "b")], "batch int, source string"), ["batch"]).collect()


def test_batches(spark):
    d = spark.range(10).withColumn("g", F.when(F.col("id") < 3, "a").otherwise("b"))
    full = S.grouped_batches(d, "g", 3, "id").groupBy("g", "batch").count().collect()
    assert sorted((r.g, r["count"]) for r in full) == [("a", 3), ("b", 3), ("b", 3)]
    padded = S.padded_group_batches(d, "g", 4, "id").groupBy("g").count().collect()
    assert {r.g: r["count"] for r in padded} == {"a": 4, "b": 8}
    small = S.padded_group_batches(d.where("g = 'a'"), "g", 8, "id")
    assert small.count() == 8 and small.select("id").distinct().count() == 3
    ranks = S.distributed_group(d, "g", 2, 2, "id").groupBy("rank").count().collect()
    assert {r["rank"]: r["count"] for r in ranks} == {0: 6, 1: 6}
    stride = S.distributed_stride(d, 4, "id").groupBy("rank").count().collect()
    assert {r["count"] for r in stride} == {3}
    assert S.subset(d, 0.35, "id").count() == 3


def test_collate_pads_by_metadata(spark):
    d = spark.createDataFrame([(0, 1, [1, 2]), (0, 2, [3])], "batch int, i int, ids array<int>")
    d = C.with_policy(d, {"ids": {"pad": 9}})
    assert S.collate(d, ["batch"], "i").first().ids == [[1, 2], [3, 9]]


def test_repeat_factor_of_a_rare_class(spark):
    p = spark.createDataFrame([(i, 0) for i in range(100)] + [(7, 1)], "image_id int, class_id int")
    f = {r.image_id: r.factor for r in C.repeat_factors(p, 0.04).collect()}
    assert f[7] == pytest.approx(2.0) and f[0] == 1.0


def test_stores(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "COCO_train2014_000000000001.jpg", "width": 50, "height": 40}], "categories": [{"id": 7, "name": "b"}, {"id": 3, "name": "a"}], "annotations": [{"id": 5, "image_id": 1, "category_id": 7, "bbox": [1, 2, 10, 10], "area": 100, "iscrowd": 0}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    images, ann, cats = Z.read_coco(spark, str(tmp_path / "c.json"), "last16")
    assert images.first().file_name == "000000000001.jpg" and {r.category_id: r.label for r in cats.collect()} == {7: 0, 3: 1}
    kept, crowd = L.parse_annotations(images, ann, cats)
    assert kept.count() == 1 and crowd.count() == 0
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "7.xml").write_text("<annotation><filename>7.jpg</filename><size><width>9</width><height>8</height></size><object><name>a</name><difficult>1</difficult><bndbox><xmin>2.9</xmin><ymin>3</ymin><xmax>6</xmax><ymax>7</ymax></bndbox></object><object><name>zz</name><bndbox><xmin>1</xmin><ymin>1</ymin><xmax>2</xmax><ymax>2</ymax></bndbox></object></annotation>")
    img, bx = Z.read_voc(spark, str(tmp_path / "v"), spark.createDataFrame([("a", 0)], "name string, label int"))
    assert img.first().width == 9 and [tuple(r)[3:7] for r in bx.collect()] == [(1, 2, 5, 6)] and bx.first().is_ignore
    head = "ImageID,Source,LabelName,Confidence,XMin,XMax,YMin,YMax,a,b,c,d,e\n"
    row = lambda i: f"{i},x,/m/1,1,0.1,0.2,0.3,0.4,0,0,1,0,0\n"
    (tmp_path / "o.csv").write_text(head + row("p") + row("p") + row("q") + row("p"))
    o = Z.read_openimages(spark, str(tmp_path / "o.csv"), spark.createDataFrame([("/m/1", 0)], "mid string, label int"))
    assert o.select("image_id", "run").distinct().count() == 3 and o.where("is_group_of").count() == 4
    (tmp_path / "ch.txt").write_text("a.jpg\n1 1\n2\n3 0 0 1 1 0\n4 0 0 1 1 1\nb.jpg\n1 1\n0\n")
    assert [(r.file_name, r.label, r.is_group_of) for r in Z.read_challenge(spark, str(tmp_path / "ch.txt")).orderBy("pos").collect()] == [("a.jpg", 2, False), ("a.jpg", 3, True)]
    (tmp_path / "l.txt").write_text("a 1\r\nb 2 3\na 9\n\n")
    assert [r.value for r in Z.list_from_file(spark, str(tmp_path / "l.txt"), "p/", 1, 1).collect()] == ["p/b 2 3"]
    assert {r.key: r["values"] for r in Z.dict_from_file(spark, str(tmp_path / "l.txt")).collect()} == {"a": ["9"], "b": ["2", "3"]}
    with pytest.raises(TypeError):
        Z.load(spark, "x.pkl")
    (tmp_path / "h.json").write_text(json.dumps({"LabelName": "r", "Subcategory": [{"LabelName": "a", "Subcategory": [{"LabelName": "b"}]}]}))
    from loomgrid.operators.metrics import hierarchy_closure

    assert {(r.class_id, r.ancestor) for r in hierarchy_closure(Z.read_hierarchy(spark, str(tmp_path / "h.json"))).collect()} == {("r", "r"), ("a", "a"), ("b", "b"), ("a", "r"), ("b", "a"), ("b", "r")}


def test_registry_snapshot_at_the_limit(spark):
    b = spark.createDataFrame([("w", ["m"], 1, 0, True, 70.0), ("x", ["m"], 1, 0, True, 69.9), ("y", ["n"], 2, 5, False, 1.0)], "worker string, models array<string>, speed int, queue_length int, check_hb boolean, ts double")
    assert {r.worker for r in R.snapshot(b, 100.0).collect()} == {"w", "y"}
    assert R.status(R.snapshot(b, 100.0)).first().queue_length == 5


def test_streams(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    pd.DataFrame({"worker": ["a", "b", "a"], "queue_length": [1, 2, 3], "check_hb": [False] * 3, "ts": [1.0, 2.0, 3.0]}).to_json(src / "1.json", orient="records", lines=True)
    beats = spark.readStream.schema("worker string, queue_length int, check_hb boolean, ts double").json(str(src))
    runs.drain(R.live_workers(beats).writeStream.format("parquet").option("path", str(out)), str(tmp_path / "cp"), clock=True)
    got = {r.worker: (r.queue_length, r.state) for r in spark.read.parquet(str(out)).collect()}
    assert got == {"a": (3, "registered"), "b": (2, "registered")}
    chunks = spark.createDataFrame([('{"text":"a","error_code":0}\0{"text":"ab","error_code":1}\0',)], "value string")
    assert [(r.text, r.error_code) for r in R.decode_chunks(chunks).collect()] == [("a", 0), ("ab", 1)]


def test_a_late_heartbeat_keeps_the_timer(spark, tmp_path):
    """A worker whose last message is an old one, out of order, still expires when it falls silent."""
    import time

    beats, out = tmp_path / "beats", tmp_path / "out"
    one = lambda k, ts: spark.createDataFrame([("w", 1, True, ts)], "worker string, queue_length int, check_hb boolean, ts double").coalesce(1).write.json(str(beats / str(k)))
    one(0, 100.0)
    src = spark.readStream.schema("worker string, queue_length int, check_hb boolean, ts double").option("recursiveFileLookup", True).json(str(beats))
    q = R.live_workers(src, ttl=3).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(processingTime="500 milliseconds").start()
    try:
        states = lambda: [r.state for r in spark.read.schema("worker string, queue_length int, ts double, state string").parquet(str(out)).collect()] if out.exists() else []
        end = time.time() + 120
        while "registered" not in states() and time.time() < end:
            time.sleep(0.5)
        one(1, 50.0)
        while "expired" not in states() and time.time() < end:
            time.sleep(0.5)
        assert sorted(states()) == ["expired", "registered"]
    finally:
        q.stop()


def test_batch_stream(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    pd.DataFrame({"g": ["a"] * 5 + ["b"], "i": range(6)}).to_json(src / "1.json", orient="records", lines=True)
    rows = spark.readStream.schema("g string, i bigint").json(str(src))
    q = R.batch_stream(rows, "g", 2).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.g, r.batch, r.slot) for r in spark.read.parquet(str(out)).collect())
    assert got == [("a", 0, 0), ("a", 0, 1), ("a", 1, 0), ("a", 1, 1)]


def test_event_time_windows(spark):
    e = spark.createDataFrame([("u", "2024-01-01 00:00:00", 1.0), ("u", "2024-01-01 00:50:00", 2.0), ("u", "2024-01-01 03:00:00", 4.0)], "user_id string, t string, value double").withColumn("ts", F.to_timestamp("t"))
    assert sorted(r.n for r in R.sliding(e, "2 hours", "1 hour").collect()) == [1, 1, 2, 2]
    assert sorted(r.n for r in R.sessions(e, "1 hour", "user_id").collect()) == [1, 2]
    assert [r.step for r in R.evaluation_points(spark.range(1, 11).withColumnRenamed("id", "step"), 3, 4).orderBy("step").collect()] == [4, 7, 10]
    h = spark.createDataFrame([("a", "LOW", 0), ("b", "high", 1), ("c", "50", 2)], "name string, priority string, order int")
    assert [r.name for r in R.by_priority(h).orderBy("pos").collect()] == ["b", "c", "a"]


def test_dispatch_and_padding(spark):
    w = spark.createDataFrame([("a", 1), ("b", 3)], "worker string, speed int")
    n = {r.worker: r["count"] for r in S.lottery(w, spark.range(4000).withColumnRenamed("id", "request")).groupBy("worker").count().collect()}
    assert sum(n.values()) == 4000 and 0.7 < n["b"] / 4000 < 0.8
    good = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "g string, k int")
    want = spark.createDataFrame([("x", 5), ("y", 1)], "g string, n bigint")
    assert sorted((r.g, r["count"]) for r in S.refill(good, "g", want, "k").groupBy("g").count().collect()) == [("x", 5), ("y", 1)]
    items, lengths = spark.range(5).withColumnRenamed("id", "pos"), spark.createDataFrame([(0, 2), (1, 0), (2, 3)], "part int, length int")
    assert [(r.part, r["at"]) for r in S.chunk_by_lengths(items, lengths).orderBy("pos").collect()] == [(0, 0), (0, 1), (2, 0), (2, 1), (2, 2)]


def test_an_object_costs_no_folder(spark, tmp_path):
    n = 900
    pages = spark.range(n).select((F.col("id") - 3).alias("page_id"), F.concat(F.lit("http://h/"), "id", F.expr("if(id % 2 = 0, '.HTML', '.txt')")).alias("url"), F.expr("if(id % 7 = 0, null, repeat('\\r\\né', int(id % 5)))").alias("html"))
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    stores = f"{spark.conf.get('spark.checkpoint.dir').removeprefix('file://')}/stores"
    before = set(os.listdir(stores)) if os.path.isdir(stores) else set()
    q = storage.page_objects(spark, str(tmp_path))
    (new,) = set(os.listdir(stores)) - before
    walk = list(os.walk(f"{stores}/{new}"))
    assert len(walk) - 1 <= 256
    assert sum(len(f) for *_, f in walk) == n  # nothing but an object for each page
    got = {r.page_id: (r.length, r.mapped, r.is_html) for r in q.collect()}
    assert got == {i - 3: (1 + (0 if i % 7 == 0 else 4 * (i % 5)), f"s3a://bucket/pages/page_id={i - 3}", i % 2 == 0) for i in range(n)}
    assert "Broadcast" not in q._jdf.queryExecution().executedPlan().toString()  # files found are many, whatever Spark takes them for
    pages.limit(0).write.parquet(str(tmp_path / "none" / "pages.parquet"))
    assert storage.page_objects(spark, str(tmp_path / "none")).collect() == []


def test_objects_put_and_listed(spark, tmp_path):
    uri = f"file:{tmp_path}/a b"
    rows = spark.createDataFrame([("a.TXT", b"1"), ("b.txt", b""), ("c.txt.gz", b"plain"), ("_d.txt", None)], "key string, content binary")
    assert Z.put_objects(rows, uri, 2) == 4 and Z.put_objects(rows.where("key = 'b.txt'").withColumn("content", F.lit(b"12")), uri, 2) == 1
    (tmp_path / "a b" / ".hidden.txt").write_text("x")
    (tmp_path / "a b" / "top.txt").write_text("xyz")
    kinds = ({}, dict(suffix=".txt"), dict(suffix=(".txt", ".gz"), case_sensitive=False))
    got = [{r.path.rsplit("/", 1)[1]: r.length for r in Z.list_objects(spark, uri, **k).collect()} for k in kinds]
    every = {"a.TXT": 1, "b.txt": 2, "c.txt.gz": 5, "_d.txt": 0, "top.txt": 3}
    assert got == [every, {k: every[k] for k in ("b.txt", "_d.txt", "top.txt")}, every]
    one = Z.list_objects(spark, uri, "b.txt").first()
    assert one.path.startswith(f"{uri}/") and abs(one.modified.timestamp() - os.path.getmtime(one.path.removeprefix("file:"))) < 1
    with pytest.raises(Exception, match="no name for an object"):
        Z.put_objects(spark.createDataFrame([("x/y", b"")], "key string, content binary"), uri)


def test_a_document_costs_no_folder(spark, sf_dir, tmp_path):
    n, o = 64 * 300, spark.read.parquet(f"{sf_dir}/orders.parquet")
    spark.range(n).select(F.col("id").alias("c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    o.withColumn("o_custkey", F.expr("if(o_orderkey % 3 = 0, null, o_custkey)")).write.parquet(str(tmp_path / "orders.parquet"))
    path = storage.documents(spark, str(tmp_path))
    walk = list(os.walk(path.removeprefix("file://")))
    assert len(walk) - 1 <= 256
    assert sum(len(f) for *_, f in walk) == 301  # and one for what has no image
    images, annotations, categories = Z.read_coco(spark, path)
    assert (images.count(), annotations.count(), categories.count()) == (n, o.count(), 3)
