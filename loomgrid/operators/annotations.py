"""Annotation filters and lookups: which images and boxes a dataset keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.functions import boxes as B


def min_side(images: DataFrame, size: int = 32, w: str = "width", h: str = "height") -> DataFrame:
    return images.where(F.least(w, h) >= size)


def with_known_annotations(images: DataFrame, annotations: DataFrame, categories: DataFrame, size: int = 32) -> DataFrame:
    """Images large enough that have an annotation of a kept category: a semi join, so annotations do not multiply images."""
    kept = annotations.join(F.broadcast(categories.select("category_id")), "category_id", "left_semi")
    return min_side(images, size).join(kept.select("image_id"), "image_id", "left_semi")


def not_only_crowd(images: DataFrame, annotations: DataFrame) -> DataFrame:
    every = annotations.groupBy("image_id").agg(F.every("iscrowd").alias("all_crowd")).where("all_crowd")
    return images.join(every, "image_id", "left_anti")


def with_things(images: DataFrame, segments: DataFrame, categories: DataFrame, size: int = 32) -> DataFrame:
    thing = F.broadcast(categories.where("isthing").select("category_id"))
    return min_side(images, size).join(segments.join(thing, "category_id", "left_semi").select("image_id"), "image_id", "left_semi")


def with_annotations(images: DataFrame, annotations: DataFrame) -> DataFrame:
    return images.join(annotations.select("image_id"), "image_id", "left_semi")


def valid_box(b: B.Box, area: Column, img_w: Column, img_h: Column) -> Column:
    """Positive part within the image, positive area, sides of at least 1; ``b`` in corners."""
    inter_w = F.greatest(F.lit(0.0), F.least(b.x2, img_w) - F.greatest(b.x1, F.lit(0.0)))
    inter_h = F.greatest(F.lit(0.0), F.least(b.y2, img_h) - F.greatest(b.y1, F.lit(0.0)))
    return (inter_w * inter_h != 0) & (area > 0) & (B.width(b) >= 1) & (B.height(b) >= 1)


def parse_annotations(images: DataFrame, annotations: DataFrame, categories: DataFrame, unknown: str = "drop") -> tuple[DataFrame, DataFrame]:
    """(boxes, ignored boxes) as corner rows with ``label``: flagged and invalid boxes go, crowd boxes are the second output. ``unknown``
    categories are dropped, or raise."""
    lab = F.broadcast(categories.select("category_id", (F.dense_rank().over(Window.orderBy("category_id")) - 1).alias("label")))
    a = annotations.where(~F.coalesce("ignore", F.lit(False))).join(images.select("image_id", "width", "height"), "image_id").join(lab, "category_id", "left")
    if unknown == "raise":
        a = a.withColumn("label", F.coalesce("label", F.raise_error(F.concat(F.lit("unknown category "), F.col("category_id").cast("string"))).cast("int")))
    b = B.from_xywh(*(F.col("bbox")[k] for k in range(4)))
    a = a.where(F.col("label").isNotNull() & valid_box(b, F.col("area"), F.col("width"), F.col("height")))
    a = a.select("image_id", "ann_id", "label", F.coalesce("iscrowd", F.lit(False)).alias("iscrowd"), *b.columns(), *[c for c in ("caption", "tokens_positive") if c in annotations.columns])
    return a.where(~F.col("iscrowd")).drop("iscrowd"), a.where("iscrowd").drop("iscrowd")


def span_annotations(boxes: DataFrame) -> DataFrame:
    """A box repeated once per span of ``tokens_positive``."""
    return boxes.withColumn("_s", F.explode("tokens_positive")).withColumn("span", F.struct(F.col("_s")[0].alias("start"), F.col("_s")[1].alias("end"))).drop("_s", "tokens_positive")


def caption_labels(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """Label is the image's caption (referring expressions)."""
    return boxes.join(images.select("image_id", F.col("caption").alias("label_text")), "image_id")


def first_of_equal_boxes(boxes: DataFrame, order: str = "ann_id", image: str = "image_id") -> DataFrame:
    """Of boxes with the same corners in an image only the first."""
    w = Window.partitionBy(image, *B.Box._fields).orderBy(order)
    return boxes.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def filter_instances(records: DataFrame, keep, field: str = "inst") -> DataFrame:
    """Array-of-struct filter by a predicate over a box. Records that had instances and lost all are dropped; those that had none pass."""
    return records.withColumn("_n", F.size(field)).withColumn(field, F.filter(field, lambda x: keep(B.field_box(x)))).where((F.col("_n") == 0) | (F.size(field) > 0)).drop("_n")


def duplicate_ids(annotations: DataFrame, key: str = "ann_id") -> DataFrame:
    """Ids that occur more than once; a sound store has none."""
    return annotations.groupBy(key).count().where("count > 1")


def assert_unique(annotations: DataFrame, key: str = "ann_id") -> DataFrame:
    """The table itself; reading it fails if an id repeats."""
    n = F.count("*").over(Window.partitionBy(key))
    return annotations.withColumn("_n", n).where(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.concat(F.lit("duplicate id "), F.col(key).cast("string"))).cast("boolean"))).drop("_n")


def join_predictions(truths: DataFrame, preds: DataFrame, key: str = "image_id") -> DataFrame:
    """Truths with their prediction (struct ``pred``); a missing one fails the query."""
    p = preds.select(key, F.struct(*preds.columns).alias("pred"))
    j = truths.join(p, key, "left")
    return j.withColumn("pred", F.coalesce("pred", F.raise_error(F.concat(F.lit("no prediction for "), F.col(key).cast("string"))).cast(p.schema["pred"].dataType)))


def missing_predictions(truths: DataFrame, preds: DataFrame, key: str = "image_id") -> DataFrame:
    return truths.join(preds.select(key), key, "left_anti")


def zip_by_line(*frames: DataFrame, line: str = "line") -> DataFrame:
    """Rows joined by line number; the shortest decides."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, line)
    return out


def last_wins(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key, in the order keys were first seen (column ``first_seq``)."""
    cols = [c for c in rows.columns if c != key]
    r = rows.groupBy(key).agg(F.max_by(F.struct(*cols), seq).alias("r"), F.min(seq).alias("first_seq"))
    return r.select(key, "r.*", "first_seq")


def lookup_or_fail(rows: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    j = rows.join(table.select(key, value), key, "left")
    return j.withColumn(value, F.coalesce(value, F.raise_error(F.concat(F.lit(f"no {value} for "), F.col(key).cast("string"))).cast(table.schema[value].dataType)))


def skip_repeats(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the row before."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_p", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) | ~F.col(value).eqNullSafe(F.col("_p"))).drop("_p", "_n")
