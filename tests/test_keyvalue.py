"""The key-value data source: rows out as in, stretches of keys, conditions that reach the file, writes that fail."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual, StringStartsWith

from loomgrid.sources import keyvalue as K


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("kv"))
    K.register(spark)
    rows = [(f"k{i:04d}", bytes([i % 256])) for i in range(1000)] + [("ü", b"u"), ("", b"empty"), ("none", None)]
    spark.createDataFrame(rows, K.SCHEMA).repartition(3).write.format("keyvalue").mode("append").save(path)
    return path, dict(rows)


def test_rows_come_back(spark, store):
    path, rows = store
    d = spark.read.format("keyvalue").option("partitions", 5).load(path)
    got = [(r.key, None if r.value is None else bytes(r.value)) for r in d.collect()]
    assert len(got) == len(rows) and dict(got) == rows and d.rdd.getNumPartitions() == 15


@pytest.mark.parametrize("where", ["key = 'k0007'", "key in ('k0001', 'ü', 'x')", "key > 'k0990'", "key >= 'k0990' and key < 'k0995'", "key like 'k00%'", "key = 'k0001' and key > 'k0005'", "key > 'k0500' and value is null", "key <= ''"])
def test_conditions(spark, store, where):
    path, rows = store
    whole = spark.createDataFrame(list(rows.items()), K.SCHEMA)
    key = lambda d: sorted((r.key, None if r.value is None else bytes(r.value)) for r in d.where(where).collect())
    assert key(spark.read.format("keyvalue").option("pushdown", True).load(path)) == key(whole)


def test_one_table_under_several_conditions(spark, store):
    """Without pushdown a loaded table is as any other."""
    d = spark.read.format("keyvalue").load(store[0])
    a, b = d.where("key < 'k0010'").select("key"), d.where("key > 'k0005'").select("key")
    assert a.join(b, "key").count() == 4 and d.join(a, "key", "left").count() == len(store[1])


def test_conditions_reach_the_file(store):
    path, _ = store
    r = K.KeyValueReader({"path": path, "pushdown": "true"})
    assert list(r.pushFilters([EqualTo(("key",), "k0007"), EqualTo(("value",), b"x")])) == [EqualTo(("value",), b"x")]
    assert {tuple(p.keys) for p in r.partitions()} == {(b"k0007",)} and sum(b.num_rows for p in r.partitions() for b in r.read(p)) == 1
    r = K.KeyValueReader({"path": path, "partitions": "4", "pushdown": "true"})
    assert not list(r.pushFilters([GreaterThan(("key",), "k0100"), LessThanOrEqual(("key",), "k0200"), StringStartsWith(("key",), "k")]))
    assert sum(b.num_rows for p in r.partitions() for b in r.read(p)) == 100


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    K.register(spark)
    d = spark.range(10).select(F.when(F.col("id") < 9, F.col("id").cast("string")).alias("key"), F.lit(b"x").alias("value"))
    with pytest.raises(Exception):
        d.repartition(2).write.format("keyvalue").mode("append").save(str(tmp_path))
    assert spark.read.format("keyvalue").load(str(tmp_path)).count() == 0
    for n in (3, 2):
        spark.range(n).select(F.col("id").cast("string").alias("key"), F.lit(b"x").alias("value")).write.format("keyvalue").mode("overwrite").save(str(tmp_path))
        assert spark.read.format("keyvalue").load(str(tmp_path)).count() == n
