"""Annotation stores: COCO-style JSON and its relatives, VOC XML, OpenImages CSV and challenge text, panoptic JSON, JSON lines, text.

Readers return tidy DataFrames and use Spark's own readers, so any Hadoop path works. Whole-file JSON documents are read
one per task (``multiLine``); line formats split.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.session import reachable

FORMATS: dict[str, tuple] = {}


def register_format(*extensions: str):
    """Adds a (reader) function for file extensions."""

    def add(f):
        for e in extensions:
            FORMATS[e.lower()] = f
        return f

    return add


@register_format("json")
def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).option("recursiveFileLookup", True).json(path)


@register_format("jsonl")
def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


@register_format("csv")
def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


@register_format("parquet")
def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@register_format("txt")
def read_txt(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


@register_format("yaml", "yml")
def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """A configuration document as one row of JSON text; parsed at the driver (needs a YAML library)."""
    import yaml

    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    return spark.createDataFrame([(json.dumps(yaml.safe_load(text)),)], "value string")


def load(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """By extension. Pickles are refused: reading one runs what it holds; use Parquet."""
    ext = (fmt or path.rsplit(".", 1)[-1]).lower()
    if ext in ("pkl", "pickle") or ext not in FORMATS:
        raise TypeError(f"unsupported format: {ext}")
    return FORMATS[ext](spark, path)


def dump(df: DataFrame, path: str | None = None, fmt: str = "json") -> DataFrame | None:
    """Writes what ``load`` reads again, or without a path returns rows of JSON text. ``jsonl`` is a record per line; ``json`` an array
    document per partition of the input, each a file of its own."""
    text = F.to_json(F.struct(*df.columns))
    if path is None:
        return df.select(text.alias("value"))
    if fmt == "json":
        rows = df.select(F.spark_partition_id().alias("part"), text.alias("t"))
        rows.groupBy("part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("t"), ","), F.lit("]")).alias("value")).write.partitionBy("part").text(path)
    elif fmt == "jsonl":
        df.write.json(path)
    elif fmt in ("parquet", "csv", "orc"):
        df.write.format(fmt).option("header", True).save(path)
    else:
        raise TypeError(f"unsupported format: {fmt}")
    return None


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line from 0, value) of a text file. Files are read whole so that line numbers are those of the file."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("line", "value")).withColumn("value", F.rtrim(F.col("value"), F.lit("\r")))


def list_from_file(spark: SparkSession, path: str, prefix: str = "", offset: int = 0, max_num: int = 0) -> DataFrame:
    d = numbered_lines(spark, path).where(F.col("line") >= offset)
    d = d.where(F.col("line") < offset + max_num) if max_num > 0 else d
    return d.withColumn("value", F.concat(F.lit(prefix), F.col("value")))


def dict_from_file(spark: SparkSession, path: str, key_type: str = "string") -> DataFrame:
    """(key, values): white-space fields of each line, the last line of a key wins."""
    parts = F.split(F.trim("value"), r"\s+")
    d = numbered_lines(spark, path).where(F.size(parts) >= 2).select("line", parts[0].cast(key_type).alias("key"), F.slice(parts, F.lit(2), F.size(parts)).alias("v"))
    return d.groupBy("key").agg(F.max_by("v", "line").alias("values"))


def list_files(spark: SparkSession, path: str, suffix: str | tuple[str, ...] | None = None, recursive: bool = True, case_sensitive: bool = True) -> DataFrame:
    """(path, length, modified): files but those with a leading dot; contents are never read. Spark lists at the driver: for very many see ``list_objects``."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    return _named(d, suffix, case_sensitive)


def _named(files: DataFrame, suffix: str | tuple[str, ...] | None, case_sensitive: bool) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    d = files.where(~F.startswith(name, F.lit(".")))
    if suffix:
        ends = F.lit(False)
        for s in (suffix,) if isinstance(suffix, str) else suffix:
            ends = ends | F.endswith(name if case_sensitive else F.lower(name), F.lit(s if case_sensitive else s.lower()))
        d = d.where(ends)
    return d


# COCO and relatives ------------------------------------------------------------------------------------

IMAGES = "array<struct<id:bigint,file_name:string,width:int,height:int,caption:string,coco_url:string,segm_file:string>>"
ANNOTATIONS = "array<struct<id:bigint,image_id:bigint,category_id:int,bbox:array<double>,area:double,iscrowd:int,ignore:boolean,caption:string,tokens_positive:array<array<int>>,segments_info:array<struct<id:bigint,category_id:int,iscrowd:int,area:bigint>>,file_name:string>>"
CATEGORIES = "array<struct<id:int,name:string,isthing:int,frequency:string>>"


def read_coco(spark: SparkSession, path: str, file_name: str = "plain", sort_categories: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories with dense ``label``) of a COCO-style document. ``file_name``: ``plain``; ``last16`` (strips a
    set's prefix); ``url`` (from coco_url); ``last2`` (last folder and name)."""
    doc = spark.read.schema(f"images {IMAGES}, annotations {ANNOTATIONS}, categories {CATEGORIES}").option("multiLine", True).option("recursiveFileLookup", True).json(path)
    img = doc.select(F.explode("images").alias("i")).select("i.*")
    name = {
        "plain": F.col("file_name"),
        "last16": F.when(F.startswith(F.col("file_name"), F.lit("COCO")), F.right(F.col("file_name"), F.lit(16))).otherwise(F.col("file_name")),
        "url": F.replace(F.col("coco_url"), F.lit("http://images.cocodataset.org/"), F.lit("")),
        "last2": F.concat_ws("/", F.element_at(F.split("file_name", "/"), -2), F.element_at(F.split("file_name", "/"), -1)),
    }[file_name]
    images = img.select(F.col("id").alias("image_id"), name.alias("file_name"), "width", "height", "caption", "segm_file")
    a = doc.select(F.explode("annotations").alias("a")).select("a.*")
    annotations = a.select(F.col("id").alias("ann_id"), "image_id", "category_id", "bbox", F.coalesce("area", F.col("bbox")[2] * F.col("bbox")[3]).alias("area"), (F.coalesce("iscrowd", F.lit(0)) == 1).alias("iscrowd"), F.coalesce("ignore", F.lit(False)).alias("ignore"), "caption", "tokens_positive")
    c = doc.select(F.posexplode("categories").alias("pos", "c")).select("pos", "c.*")
    order = Window.orderBy("id") if sort_categories else Window.orderBy("pos")
    categories = c.select(F.col("id").alias("category_id"), "name", (F.coalesce("isthing", F.lit(1)) == 1).alias("isthing"), "frequency", (F.row_number().over(order) - 1).alias("label"))
    return images, annotations, categories


def read_lvis(spark: SparkSession, path: str, version: str = "v1"):
    return read_coco(spark, path, "last16" if version == "v0.5" else "url")


def read_objects365(spark: SparkSession, path: str, version: str = "v2", drop: DataFrame | None = None):
    """Sorted categories (v1), last folder and name (v2), less the files in ``drop`` (file_name)."""
    images, annotations, categories = read_coco(spark, path, "last2" if version == "v2" else "plain", True)
    return (images if drop is None else images.join(drop, "file_name", "left_anti")), annotations, categories


def read_panoptic(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, segments, categories); a segment id means something only with its image."""
    doc = spark.read.schema(f"images {IMAGES}, annotations {ANNOTATIONS}, categories {CATEGORIES}").option("multiLine", True).option("recursiveFileLookup", True).json(path)
    images, _, categories = read_coco(spark, path)
    a = doc.select(F.explode("annotations").alias("a")).select("a.image_id", F.col("a.file_name").alias("segm_file"), F.explode("a.segments_info").alias("s"))
    seg = a.select("image_id", "segm_file", F.col("s.id").alias("id"), F.col("s.category_id").alias("category_id"), (F.coalesce("s.iscrowd", F.lit(0)) == 1).alias("iscrowd"), F.col("s.area").alias("area"))
    return images, seg.join(images.select("image_id", "width", "height"), "image_id"), categories


def panoptic_ids(pixels: DataFrame, r: str = "r", g: str = "g", b: str = "b") -> DataFrame:
    """Segment id of colour pixels."""
    return pixels.withColumn("id", F.col(r) + 256 * F.col(g) + 65536 * F.col(b))


VOC = "struct<folder:string,filename:string,size:struct<width:int,height:int>,object:array<struct<name:string,difficult:int,bndbox:struct<xmin:string,ymin:string,xmax:string,ymax:string>>>>"


def read_voc(spark: SparkSession, path: str, classes: DataFrame, prefix_folder: bool = False, least: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(images, boxes with label and ``is_ignore``) of a folder of XML files. ``classes``: (name, label); unknown names go. Corners are cut to whole
    numbers and lowered by 1; difficult boxes and those with a side under ``least`` are to be ignored."""
    files = spark.read.option("pathGlobFilter", "*.xml").text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("_f"), F.from_xml("value", _voc_schema()).alias("x"))
    image_id = F.regexp_replace("_f", r"\.xml$", "")
    name = F.coalesce("x.filename", F.concat(image_id, F.lit(".jpg")))
    images = files.select(image_id.alias("image_id"), (F.concat_ws("/", "x.folder", name) if prefix_folder else name).alias("file_name"), F.col("x.size.width").alias("width"), F.col("x.size.height").alias("height"))
    o = files.select(image_id.alias("image_id"), F.posexplode("x.object").alias("pos", "o")).withColumn("name", F.col("o.name")).join(F.broadcast(classes), "name")
    c = {k: (F.col(f"o.bndbox.{s}").cast("double").cast("int") - 1) for k, s in (("x1", "xmin"), ("y1", "ymin"), ("x2", "xmax"), ("y2", "ymax"))}
    small = F.lit(False) if least is None else (c["x2"] - c["x1"] < least) | (c["y2"] - c["y1"] < least)
    return images, o.select("image_id", "pos", "label", *(v.alias(k) for k, v in c.items()), ((F.coalesce("o.difficult", F.lit(0)) != 0) | small).alias("is_ignore"))


def _voc_schema():
    from pyspark.sql.types import StructType, _parse_datatype_string

    t = _parse_datatype_string(VOC)
    assert isinstance(t, StructType)
    return t


# OpenImages --------------------------------------------------------------------------------------------


def read_openimages(spark: SparkSession, path: str, classes: DataFrame) -> DataFrame:
    """Boxes by column position (0 image, 2 class, 4-7 corners, 8-12 flags) with ``run``: an image whose rows are not together
    is listed once per stretch. ``classes``: (mid, label)."""
    lines = numbered_lines(spark, path).where("line > 0 and value <> ''").select("line", F.split("value", ",").alias("c"))
    w = Window.partitionBy("image_id").orderBy("line")
    d = lines.select("line", F.col("c")[0].alias("image_id"), F.col("c")[2].alias("mid"), *(F.col("c")[k].cast("double").alias(n) for k, n in ((4, "x1"), (5, "x2"), (6, "y1"), (7, "y2"))), *((F.col("c")[k].cast("int") == 1).alias(n) for k, n in ((8, "is_occluded"), (9, "is_truncated"), (10, "is_group_of"), (11, "is_depiction"), (12, "is_inside"))))
    # a stretch begins where the image's line before is not the line above
    d = d.withColumn("run", F.sum(F.when(F.col("line") - F.lag("line").over(w) == 1, 0).otherwise(1)).over(w) - 1)
    return d.join(F.broadcast(classes), "mid")


def read_class_names(spark: SparkSession, path: str) -> DataFrame:
    """(mid, name, label) of a class list, numbered by line."""
    return numbered_lines(spark, path).where("value <> ''").select(F.split("value", ",")[0].alias("mid"), F.split("value", ",")[1].alias("name"), F.col("line").alias("label"))


def read_image_labels(spark: SparkSession, path: str, classes: DataFrame) -> DataFrame:
    d = numbered_lines(spark, path).where("line > 0 and value <> ''").select(F.split("value", ",").alias("c"))
    return d.select(F.col("c")[0].alias("image_id"), F.col("c")[2].alias("mid"), F.col("c")[3].cast("double").alias("confidence")).join(F.broadcast(classes), "mid")


def read_challenge(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of (name, one line skipped, n, n lines ``label x1 y1 x2 y2 group``): labels from 0. Blocks have lengths inside, so a file is one task."""

    def parse(batches):
        for pdf in batches:
            rows = []
            for text in pdf["value"]:
                lines, at = text.rstrip("\n").split("\n"), 0
                while at + 2 < len(lines):
                    name, n = lines[at].strip(), int(lines[at + 2])
                    for k in range(n):
                        p = lines[at + 3 + k].split()
                        rows.append((name, k, int(float(p[0])) - 1, *map(float, p[1:5]), int(float(p[5])) == 1))
                    at += 3 + n
            yield pd.DataFrame(rows, columns=["file_name", "pos", "label", "x1", "y1", "x2", "y2", "is_group_of"])

    return spark.read.text(path, wholetext=True).mapInPandas(parse, "file_name string, pos int, label int, x1 double, y1 double, x2 double, y2 double, is_group_of boolean")


def read_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """(parent, child) edges of a nested class tree, which is one small document and is walked at the driver."""
    tree = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    edges: list[tuple[str, str]] = []

    def walk(node):
        for c in node.get("Subcategory", []):
            edges.append((node["LabelName"], c["LabelName"]))
            walk(c)

    walk(tree)
    return spark.createDataFrame(edges, "parent string, child string")


# proposals and results ---------------------------------------------------------------------------------


def first_proposals(proposals: DataFrame, most: int | None = None, col: str = "proposals") -> DataFrame:
    """Arrays of [x1, y1, x2, y2, ...]: corners only, the first ``most``; an empty list becomes one zero box."""
    p = F.transform(col, lambda b: F.slice(b, 1, 4))
    p = F.slice(p, 1, most) if most else p
    return proposals.withColumn(col, F.when(F.coalesce(F.size(col), F.lit(0)) > 0, p).otherwise(F.array(F.array_repeat(F.lit(0.0), 4))))


def detection_rows(det: DataFrame, categories: DataFrame | None) -> DataFrame:
    """Result rows: image_id, bbox as corner and size, score, category_id (1 for proposals, when no categories are given)."""
    b = F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    if categories is None:
        return det.select("image_id", b.alias("bbox"), "score", F.lit(1).alias("category_id"))
    lab = categories.select(F.col("label").alias("class_id"), "category_id")
    return det.join(F.broadcast(lab), "class_id").select("image_id", b.alias("bbox"), "score", "category_id")


def segmentation_rows(det: DataFrame, categories: DataFrame, mask: str = "segmentation") -> tuple[DataFrame, DataFrame]:
    b = det.join(F.broadcast(categories.select(F.col("label").alias("class_id"), "category_id")), "class_id")
    return detection_rows(det, categories), b.select("image_id", "score", "category_id", F.col(mask).alias("segmentation"))


def write_results(prefix: str, **frames: DataFrame) -> dict[str, str]:
    """One JSON folder per kind given (bbox, segm, proposal, panoptic): ``<prefix>.<kind>.json``."""
    out = {}
    for kind, df in frames.items():
        if kind not in ("bbox", "segm", "proposal", "panoptic"):
            raise TypeError(f"unknown result kind {kind}")
        out[kind] = f"{prefix}.{kind}.json"
        df.write.json(out[kind])
    return out


def write_lines(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(F.concat_ws(" ", *columns).alias("value")).write.text(path)


def ordered_results(parts: DataFrame, size: int, order: str = "row_idx") -> DataFrame:
    """Results of all ranks in dataset order, without what padding repeated."""
    one = parts.withColumn("_r", F.row_number().over(Window.partitionBy(order).orderBy(F.lit(0)))).where("_r = 1").drop("_r")
    return one.where(F.col(order) < size).orderBy(order)


def new_images(images: DataFrame, store: DataFrame) -> DataFrame:
    """Contents not yet in the store, each once, by digest."""
    return images.withColumn("md5", F.md5("content")).dropDuplicates(["md5"]).join(store.select("md5"), "md5", "left_anti")


def still_to_do(questions: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    return questions.join(done.select(key), key, "left_anti")


def frames(video: DataFrame, fps: float, start: int = 0, end: int | None = None, step: int = 1) -> DataFrame:
    """Frame rows (video_id, frame_id, ...) of a slice, with their time; negative bounds count from the end."""
    n = F.max("frame_id").over(Window.partitionBy("video_id")) + 1
    lo = F.lit(start) if start >= 0 else n + start
    hi = n if end is None else (F.lit(end) if end >= 0 else n + end)
    d = video.withColumn("_lo", lo).withColumn("_hi", hi)
    return d.where((F.col("frame_id") >= F.col("_lo")) & (F.col("frame_id") < F.col("_hi")) & ((F.col("frame_id") - F.col("_lo")) % step == 0)).withColumn("time_s", F.col("frame_id") / fps).drop("_lo", "_hi")


def run_model(df: DataFrame, model, schema: str) -> DataFrame:
    """A scorer from pandas frame to pandas frame over batches; the model is the caller's."""
    return df.mapInPandas(lambda it: (model(pdf) for pdf in it), schema)


# single objects by URI ---------------------------------------------------------------------------------


def _file(spark: SparkSession, uri: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def put_object(spark: SparkSession, uri: str, content: bytes) -> None:
    """Writes a small object under any scheme the session's file systems know (disk, s3a, ...)."""
    p, fs = _file(spark, uri)
    out = fs.create(p, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def get_object(spark: SparkSession, uri: str) -> bytes:
    """The bytes of a small object; larger ones are read by the ``binaryFile`` source."""
    return bytes(spark.read.format("binaryFile").load(uri).select("content").first()[0])


def object_exists(spark: SparkSession, uri: str) -> bool:
    p, fs = _file(spark, uri)
    return bool(fs.exists(p))


def mapped_path(uri: str, mapping: dict[str, str]) -> str:
    """A path with the first matching prefix replaced, longest first."""
    for old in sorted(mapping, key=len, reverse=True):
        if uri.startswith(old):
            return mapping[old] + uri[len(old) :]
    return uri


# very many objects, put and listed by tasks -------------------------------------------------------------

FOLDERS = 256


def _store(uri: str):
    """Arrow's file system of a path as Spark takes it, and the folder in it; the folder must be reachable from all machines."""
    if re.match("file:|/", uri):
        return LocalFileSystem(), re.sub("^file:/+", "/", uri).rstrip("/")
    store, top = FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))
    return store, top.rstrip("/")


def put_objects(objects: DataFrame, uri: str, folders: int = FOLDERS) -> int:
    """Writes rows (key, content) as objects ``<uri>/<folder>/<key>`` and returns their number. Tasks put each object in its place themselves: keys are dealt
    over a fixed number of folders, so no object costs a folder, and the driver has nothing to commit. An object shows only once it is whole, and one put
    again replaces itself, so retried tasks agree; keys are to be unique. Any store that Arrow knows (disk, s3, gs, hdfs)."""
    reachable(objects.sparkSession)
    store, top = _store(uri)
    store.create_dir(top)

    def put(batches):
        (store, top), made, n = _store(uri), set(), 0
        for b in batches:
            for key, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if not key or "/" in key or key[0] == ".":
                    raise ValueError(f"no name for an object: {key}")
                at = f"{top}/{zlib.crc32(key.encode()) % folders:02x}"
                if at not in made:
                    store.create_dir(at)
                    made.add(at)
                hidden = f"{at}/.{uuid.uuid4().hex}"
                with store.open_output_stream(hidden, compression=None) as f:
                    f.write(content.as_buffer() or b"")
                store.move(hidden, f"{at}/{key}")
            n += b.num_rows
        yield pa.RecordBatch.from_pydict({"n": [n]})

    return objects.select(F.col("key").cast("string"), F.col("content").cast("binary")).mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


FOUND = "path string, length long, modified timestamp"


def list_objects(spark: SparkSession, uri: str, suffix: str | tuple[str, ...] | None = None, case_sensitive: bool = True) -> DataFrame:
    """``list_files`` by tasks, for more files than a driver should hold: one lists what the folder itself holds, others each folder in it."""
    reachable(spark)

    def rows(infos, folder: bool):
        files = [i for i in infos if i.type == FileType.File or folder]
        at = pa.array([i.mtime_ns and i.mtime_ns // 1000 for i in files], pa.int64()).cast(pa.timestamp("us", "UTC"))
        d = {"path": pa.array([i.path for i in files], pa.string()), "length": pa.array([i.size for i in files], pa.int64()), "modified": at}
        return pa.RecordBatch.from_pydict(d | ({"folder": pa.array([i.type == FileType.Directory for i in files], pa.bool_())} if folder else {}))

    def first(batches):
        store, top = _store(uri)
        for _ in batches:
            yield rows(store.get_file_info(FileSelector(top)), True)

    def below(batches):
        store, top = _store(uri)
        for b in batches:
            files = b.filter(pc.invert(b["folder"])).drop_columns(["folder"])
            for d in (files, *(rows(store.get_file_info(FileSelector(p, recursive=True)), False) for p in b.filter(b["folder"])["path"].to_pylist())):
                yield d.set_column(0, "path", pa.array([uri.rstrip("/") + p[len(top) :] for p in d["path"].to_pylist()], pa.string()))

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = spark.range(1, numPartitions=1).mapInArrow(first, f"{FOUND}, folder boolean").repartition(n).mapInArrow(below, FOUND)
    return _named(found, suffix, case_sensitive).hint("merge")  # Spark takes it for as small as the list of folders, and would gather it to broadcast


# key-value backends ------------------------------------------------------------------------------------


def http_client(timeout: float = 30.0):
    """Reads a URL."""
    from urllib.request import urlopen

    def get(key: str) -> bytes:
        with urlopen(key, timeout=timeout) as f:
            return f.read()

    return get


def lmdb_client(path: str):
    """Reads by key from a local LMDB store (needs the lmdb library)."""
    import lmdb

    env = lmdb.open(path, readonly=True, lock=False, readahead=False)

    def get(key: str) -> bytes | None:
        with env.begin(write=False) as t:
            return t.get(key.encode())

    return get


def memcached_client(server: str):
    """Reads by key from a memcached server (needs the pymemcache library)."""
    from pymemcache.client.base import Client

    return Client(server).get


def read_keys(keys: DataFrame, client, *args, key: str = "key") -> DataFrame:
    """(key, content): each task opens its own client (a function of ``args`` that returns one from key to bytes)."""

    def run(batches):
        get = client(*args)
        for pdf in batches:
            yield pd.DataFrame({"key": pdf[key].astype(str), "content": [get(k) for k in pdf[key]]})

    return keys.select(key).mapInPandas(run, "key string, content binary")
