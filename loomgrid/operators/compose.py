"""Composing transforms and datasets: registries, concatenation, repetition, class balance, views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.operators.numbering import numbered


class Registry:
    """Named functions from DataFrame to DataFrame; names may be scoped (``scope.name``)."""

    def __init__(self, name: str, parent: Registry | None = None):
        self.name, self.parent, self.own, self.children = name, parent, {}, {}
        if parent is not None:
            parent.children[name] = self

    def register(self, name: str | None = None, force: bool = False) -> Callable:
        def add(f: Callable) -> Callable:
            key = name or f.__name__
            if key in self.own and not force:
                raise KeyError(f"{key} is already registered in {self.name}")
            self.own[key] = f
            return f

        return add

    def get(self, key: str) -> Callable:
        scope, _, rest = key.partition(".")
        if rest and scope in self.children:
            return self.children[scope].get(rest)
        if key in self.own:
            return self.own[key]
        if self.parent is not None:
            return self.parent.get(key)
        raise KeyError(f"{key} is not in the {self.name} registry")

    def build(self, cfg: dict) -> Callable[[DataFrame], DataFrame]:
        """A transform of ``{"type": name, **arguments}``."""
        args = dict(cfg)
        f = self.get(args.pop("type"))
        return lambda df: f(df, **args)


TRANSFORMS = Registry("transforms")


def compose(df: DataFrame, steps: list, registry: Registry = TRANSFORMS) -> DataFrame:
    """Transforms in order (functions or configurations); rows a step marks by a false column ``keep`` end there."""
    for s in steps:
        df = df.transform(s if callable(s) else registry.build(s))
        if "keep" in df.columns:
            df = df.where("keep").drop("keep")
    return df


@TRANSFORMS.register()
def seed_record(df: DataFrame, prefix: str = "") -> DataFrame:
    """Record fields a pipeline starts from."""
    return df.withColumns({"img_prefix": F.lit(prefix), "img_h": F.col("ori_h"), "img_w": F.col("ori_w"), "flip": F.lit(None).cast("string")})


@TRANSFORMS.register()
def denormalise(df: DataFrame, field: str = "inst") -> DataFrame:
    """Box corners from shares of the image to pixels."""
    kind = df.schema[field].dataType.simpleString()
    box = lambda x: x.withField("x1", x["x1"] * F.col("ori_w")).withField("y1", x["y1"] * F.col("ori_h")).withField("x2", x["x2"] * F.col("ori_w")).withField("y2", x["y2"] * F.col("ori_h"))
    return df.withColumn(field, F.transform(field, box).cast(kind))


@TRANSFORMS.register()
def default_meta(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    add = {"pad_h": F.col("img_h"), "pad_w": F.col("img_w"), "scale_factor": F.lit(1.0)}
    return df.withColumns({k: F.coalesce(F.col(k), v) if k in have else v for k, v in add.items()})


@TRANSFORMS.register()
def collect(df: DataFrame, keys: list[str], meta_keys: list[str]) -> DataFrame:
    """The keys, and a struct of what the meta keys name (absent ones left out)."""
    return df.select(*keys, F.struct(*[k for k in meta_keys if k in df.columns]).alias("img_metas"))


@TRANSFORMS.register()
def with_policy(df: DataFrame, policy: dict[str, dict]) -> DataFrame:
    """Batching policy per column, kept as column metadata: stack, pad value."""
    for name, p in policy.items():
        df = df.withColumn(name, F.col(name).alias(name, metadata=p))
    return df


@TRANSFORMS.register()
def to_arrays(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumns({k: F.array(F.col(k)) for k in keys})


@TRANSFORMS.register()
def casts(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return df.withColumns({k: F.col(k).cast(t) for k, t in kinds.items()})


def boxes_by_label(instances: DataFrame, label: str = "label_text", keys: tuple[str, ...] = ("image_id",), order: str = "ann_id") -> DataFrame:
    """Per image and normalised label its boxes in order."""
    return instances.withColumn("label", F.lower(F.trim(label))).groupBy(*keys, "label").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "x1", "y1", "x2", "y2"))), lambda s: F.array(s["x1"], s["y1"], s["x2"], s["y2"])).alias("boxes"))


def views(df: DataFrame, scales: list[tuple[int, int]], flips: tuple[str | None, ...] = (None,)) -> DataFrame:
    """Test-time views: each row for every scale and flip (a constant table)."""
    table = F.array(*(F.struct(F.lit(k).alias("view"), F.lit(w).alias("view_w"), F.lit(h).alias("view_h"), F.lit(f).cast("string").alias("view_flip")) for k, (w, h, f) in enumerate((*s, f) for s in scales for f in flips)))
    return df.withColumn("_v", F.explode(table)).select("*", "_v.*").drop("_v")


def scatter_back(values: DataFrame, total: DataFrame, idx: str, value: str, fill=0) -> DataFrame:
    """All of ``total``'s indices with the subset's values, ``fill`` elsewhere."""
    return total.join(values.select(idx, value), idx, "left").withColumn(value, F.coalesce(F.col(value), F.lit(fill)))


def per_class_lists(dets: DataFrame, classes: DataFrame, images: DataFrame, dense: bool = True) -> DataFrame:
    """(image_id, class_id, dets): an array for every image and class, empty ones too, as the result format has it. With ``dense``
    off only those with detections, which does not grow with images times classes."""
    g = dets.groupBy("image_id", "class_id").agg(F.array_sort(F.collect_list(F.struct("det_idx", "x1", "y1", "x2", "y2", "score"))).alias("dets"))
    if not dense:
        return g.join(images.select("image_id"), "image_id", "left_semi").join(classes.select("class_id"), "class_id", "left_semi").select("image_id", "class_id", "dets")
    full = images.select("image_id").crossJoin(classes.select("class_id"))
    return full.join(g, ["image_id", "class_id"], "left").withColumn("dets", F.coalesce("dets", F.expr("array()").cast(g.schema["dets"].dataType)))


def to_rois(batches: DataFrame, boxes: str = "boxes") -> DataFrame:
    """(batch_idx, roi_idx, roi) of rows with an array of boxes."""
    return batches.select("batch_idx", F.posexplode(boxes).alias("roi_idx", "roi"))


def from_rois(rois: DataFrame) -> DataFrame:
    return rois.groupBy("batch_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("roi_idx", "roi"))), lambda s: s["roi"]).alias("boxes"))


def align(*arrays: Column) -> Column:
    return F.arrays_zip(*arrays)


# datasets ----------------------------------------------------------------------------------------------


def concat(frames: dict[str, DataFrame], order: str) -> DataFrame:
    """Bag union with ``source``, ``src_ord`` (order within) and ``row_idx`` (order over all): sources follow each other in the order given.

    Offsets come from the sources' counts; a source's own rows are numbered by ranges (``numbered``)."""
    out = None
    for k, (name, f) in enumerate(frames.items()):
        one = numbered(f, order, name="src_ord").withColumns({"source": F.lit(name), "_k": F.lit(k)})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    n = out.groupBy("_k").count()  # a row per source named in the call
    off = n.withColumn("_off", F.coalesce(F.sum("count").over(Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    return out.join(F.broadcast(off), "_k").withColumn("row_idx", F.col("_off") + F.col("src_ord")).drop("_k", "_off")


def repeat(df: DataFrame, times: int, idx: str | None = None) -> DataFrame:
    """The rows ``times`` times; with ``idx`` also the position in the long dataset."""
    d = df.crossJoin(F.broadcast(df.agg(F.count("*").alias("_n")))) if idx else df  # one row
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return d.withColumn("long_idx", F.col("copy") * F.col("_n") + F.col(idx)).drop("_n") if idx else d


def repeat_factors(image_classes: DataFrame, threshold: float, image: str = "image_id", cls: str = "class_id") -> DataFrame:
    """(image, factor): the largest over its classes of max(1, sqrt(threshold / share of images with the class))."""
    pairs = image_classes.select(image, cls).distinct()
    total = pairs.agg(F.count_distinct(image).alias("n"))
    share = pairs.groupBy(cls).agg(F.count("*").alias("f")).crossJoin(F.broadcast(total))
    r = share.select(cls, F.greatest(F.lit(1.0), F.sqrt(threshold / (F.col("f") / F.col("n")))).alias("r"))
    return pairs.join(r, cls).groupBy(image).agg(F.max("r").alias("factor"))


def class_balanced(df: DataFrame, image_classes: DataFrame, threshold: float, image: str = "image_id", cls: str = "class_id") -> DataFrame:
    """Rows repeated ceil(factor) times, so any factor over 1 at least doubles."""
    return df.join(repeat_factors(image_classes, threshold, image, cls), image).withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil("factor").cast("int"))))


def mix_partners(df: DataFrame, n: int, seed: int = 0, idx: str = "row_idx", draw: Column | None = None) -> DataFrame:
    """Each row with ``n`` partner positions drawn by hash, or by a number over (idx, _k), joined by position (struct ``partner``)."""
    total = df.agg(F.count("*").alias("_n"))
    d = df.crossJoin(F.broadcast(total)).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    d = d.withColumn("_p", F.pmod(F.xxhash64(idx, "_k", F.lit(seed)) if draw is None else draw, F.col("_n")))
    other = df.select(F.col(idx).alias("_p"), F.struct(*df.columns).alias("partner"))
    return d.join(other, "_p").withColumnRenamed("_k", "slot").drop("_p", "_n")


def ids_in_all(*frames: DataFrame, key: str = "image_id") -> DataFrame:
    out = frames[0].select(key)
    for f in frames[1:]:
        out = out.intersect(f.select(key))
    return out


def ids_in_any(*frames: DataFrame, key: str = "image_id") -> DataFrame:
    out = frames[0].select(key)
    for f in frames[1:]:
        out = out.union(f.select(key))
    return out.distinct()


def without(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key), key, "left_anti")


def union_labels(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(a, b)))
