"""Streams run delivery by delivery: timers, expiring state, replays, late rows, buffers."""

import datetime

import pytest
from pyspark.sql import functions as F

from loomgrid.plans import streams as Q
from loomgrid.streaming import runs as R

T0 = datetime.datetime(2024, 1, 1)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def made_folder(tmp_path):
    (tmp_path / "in").mkdir()
    return str(tmp_path / "in")


BEATS = "worker string, queue_length int, check_hb boolean, ts timestamp"


def test_a_silent_worker_expires_by_its_timer(spark, tmp_path):
    folder, out = made_folder(tmp_path), str(tmp_path / "out")
    rows = [(0, "a", 1, True, at(0)), (0, "b", 2, False, at(1)), (0, "a", 3, True, at(20)), (1, "c", 4, True, at(100)), (2, "a", 5, True, at(110)), (2, "a", 6, True, at(300))]
    d = spark.createDataFrame(rows, f"k int, {BEATS}")
    beats = R.arriving(spark, folder, d.schema)
    said = []

    def run(k):
        R.drain(R.registry_changes(beats, 30).writeStream.format("parquet").option("path", out), f"{out}-c")
        said.append({(r.worker, r.state, r.at // 1000 - int(T0.replace(tzinfo=datetime.UTC).timestamp()), r.beats) for r in spark.read.schema(R.CHANGE).parquet(out).collect()})

    R.deliver(d, F.col("k"), 3, folder, run)
    assert said[0] == {("a", "registered", 0, 1), ("b", "registered", 1, 1)}
    assert said[1] - said[0] == {("c", "registered", 100, 1), ("a", "expired", 50, 2)}  # the timer, as c's heartbeat moves time on
    assert said[2] - said[1] == {("a", "registered", 110, 1), ("c", "expired", 130, 1), ("a", "expired", 140, 1), ("a", "registered", 300, 1)}


def test_a_lost_batch_is_written_once(spark, tmp_path):
    folder, out = made_folder(tmp_path), str(tmp_path / "log")
    d = spark.range(30).selectExpr("id", "id div 10 AS k", "timestamp_seconds(1704067200 + id * 9000) AS ts")
    lines = R.log_lines(R.arriving(spark, folder, d.schema), F.lit("chat"), id=F.col("id"))
    lost = []

    def fail(n):
        if n == 1 and len(lost) < 2:
            lost.append(n)
            raise RuntimeError("killed")

    def run(k):
        for _ in range(3 if k == 1 else 1):
            try:
                R.drain(lines.writeStream.foreachBatch(R.once(out, then=fail)), f"{out}-c")
            except Exception:
                assert k == 1

    R.deliver(d, F.col("k"), 3, folder, run)
    got = R.log_table(spark, out, "tstamp double, type string, id bigint")
    assert lost == [1, 1] and sorted(r.id for r in got.collect()) == list(range(30))
    assert {r.day for r in got.collect()} == {r.day for r in lines.sparkSession.read.schema(d.schema).parquet(f"{folder}/*").select(F.date_format("ts", "yyyy-MM-dd").alias("day")).collect()}


def test_buffers_and_what_waits_in_them(spark, tmp_path):
    folder, out = made_folder(tmp_path), str(tmp_path / "out")
    rows = R.epoch_rows(spark.createDataFrame([(i, i % 2) for i in range(7)], "id int, g int"), 2, "id")
    R.deliver(rows, F.col("epoch"), 2, folder, lambda k: R.drain(R.endless_batches(R.arriving(spark, folder, rows.schema), ["g"], 3).writeStream.format("parquet").option("path", out), f"{out}-c"))
    made = spark.read.schema(R.batch_schema(rows.schema)).parquet(out).collect()
    left = R.leftovers(spark, f"{out}-c").collect()
    assert sorted((r.id, r.epoch) for r in [*made, *left]) == sorted((i, e) for i in range(7) for e in range(2))
    assert {(r.g, r.batch): sum(x.g == r.g and x.batch == r.batch for x in made) for r in made} == {(0, 0): 3, (0, 1): 3, (1, 0): 3, (1, 1): 3}
    assert sorted(r.g for r in left) == [0, 0]


def test_settings_come_back(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(KeyError), R.settings(spark, {"spark.sql.shuffle.partitions": "3", "loomgrid.unset": "x"}):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
        raise KeyError
    assert spark.conf.get("spark.sql.shuffle.partitions") == before and spark.conf.get("loomgrid.unset", None) is None


def test_log_sums_beyond_64_bits(spark):
    """Ten thousand lines of a day, type and model: their microseconds add up to more than a long holds."""
    log = spark.range(10000).selectExpr("'2024-01-01' AS day", "'chat' AS type", "'m0' AS model", "id AS event_id", "1704067200D + id AS tstamp")
    few = Q._log_sums(log.where("event_id < 3"))
    assert dict(few.dtypes)["us"] == "bigint" and few.first().us == (3 * 1704067200 + 3) * 10**6
    (r,) = Q._log_sums(log).collect()
    assert (r.n, r.n_events, int(r.us)) == (10000, 10000, sum((1704067200 + k) * 10**6 for k in range(10000)))
