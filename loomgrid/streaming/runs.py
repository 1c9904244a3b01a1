"""Streams run to the end of what has arrived: registries with timers and expiring state, logs written once, late rows, joins, batches.

Everything here starts from a folder to which files are added, and runs with an available-now trigger from the checkpoint where
the run before stopped, so a run that was killed goes on where it was. State is in the RocksDB store, a row for each key, and can be read back
as a table.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StructType

from loomgrid.session import reachable
from loomgrid.streaming.registry import BatchBuffer

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: State that expires by the clock asks for another batch for ever; without batches that have no data a run ends.
BY_CLOCK = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}


@contextlib.contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """A query keeps the settings that it starts with; the session gets its own back."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drain(writer: DataStreamWriter, checkpoint: str, clock: bool = False) -> list[dict]:
    """Runs the stream until all that has arrived is done; the progress of its batches. ``clock``: its state expires by processing time."""
    spark = writer._spark
    reachable(spark)
    with settings(spark, STORE | (BY_CLOCK if clock else {})):
        q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        finally:
            q.stop()
    return [p if isinstance(p, dict) else dict(p) for p in q.recentProgress]


def arriving(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """A stream of the Parquet files that are added below a folder."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder)


def deliver(rows: DataFrame, slices: Column, n: int, folder: str, after: Callable[[int], None]) -> None:
    """Adds the rows to a folder in ``n`` deliveries (``slices`` is the delivery, from 0) and calls ``after`` each of them."""
    for k in range(n):
        rows.where(slices == k).write.parquet(f"{folder}/{k:04d}")
        after(k)


def state_table(spark: SparkSession, checkpoint: str, name: str, flat: bool = False) -> DataFrame:
    """The rows of a state variable after the last batch; ``flat``: a row for each element of a list or map."""
    with settings(spark, STORE):
        return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).option("flattenCollectionTypes", str(flat).lower()).load()


# registry ----------------------------------------------------------------------------------------------

BEAT = "queue_length int, ts bigint, checked boolean, beats bigint"
CHANGE = "worker string, state string, at bigint, queue_length int, beats bigint"


class Registry(StatefulProcessor):
    """A worker is registered by its first heartbeat and expires when ``ttl`` milliseconds of event time pass without another, if it asks to
    be checked: by a timer, or as its next heartbeat shows that it was gone. A batch's heartbeats of one worker (three numbers each) are
    sorted in memory, so a delivery should not hold more of them than a task can."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.worker = handle, handle.getValueState("worker", BEAT)

    def handleInputRows(self, key, rows, timerValues):
        beats = pd.concat([r[["queue_length", "ms", "check_hb"]] for r in rows]).sort_values(["ms", "queue_length"], kind="stable")
        now = self.worker.get() if self.worker.exists() else None
        if now and now[2]:
            self.handle.deleteTimer(now[1] + self.ttl)
        out = []
        for q, ms, checked in beats.itertuples(index=False):
            if now and now[2] and ms - now[1] > self.ttl:
                out.append((key[0], "expired", now[1] + self.ttl, now[0], now[3]))
                now = None
            if not now:
                out.append((key[0], "registered", int(ms), int(q), 1))
            now = (int(q), int(ms), bool(checked), (now[3] if now else 0) + 1) if not now or ms >= now[1] else now
        self.worker.update(now)
        if now[2]:
            self.handle.registerTimer(now[1] + self.ttl)
        yield pd.DataFrame(out, columns=["worker", "state", "at", "queue_length", "beats"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        q, ms, _, beats = self.worker.get()
        self.worker.clear()
        yield pd.DataFrame([(key[0], "expired", ms + self.ttl, q, beats)], columns=["worker", "state", "at", "queue_length", "beats"])

    def close(self) -> None:
        pass


def registry_changes(beats: DataFrame, ttl: float, late: str = "0 seconds") -> DataFrame:
    """Registrations and expiries of a stream of heartbeats (worker, queue_length, check_hb, ts timestamp)."""
    b = beats.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return b.groupBy("worker").transformWithStateInPandas(Registry(int(ttl * 1000)), CHANGE, "Append", "EventTime")


class Known(StatefulProcessor):
    """Each worker's last heartbeat: of workers to be checked in state that the store drops ``ttl`` milliseconds after its last update, by the
    clock; of others in state that stays."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getValueState("live", "queue_length int, ms bigint", self.ttl)
        self.kept = handle.getValueState("kept", "queue_length int, ms bigint")

    def handleInputRows(self, key, rows, timerValues):
        last = None
        for r in rows:
            best = max(r[["ms", "queue_length", "check_hb"]].itertuples(index=False, name=None))
            last = max(last, best) if last else best
        ms, q, checked = last
        mine, other = (self.live, self.kept) if checked else (self.kept, self.live)
        for state in (mine, other):
            if state.exists() and state.get()[1] > ms:
                return
        other.clear()
        mine.update((int(q), int(ms)))
        yield pd.DataFrame({"worker": [key[0]]})

    def close(self) -> None:
        pass


def known_workers(beats: DataFrame, ttl: float) -> DataFrame:
    """The workers heard from in each batch; their last heartbeats are the state."""
    b = beats.withColumn("ms", F.unix_millis("ts"))
    return b.groupBy("worker").transformWithStateInPandas(Known(int(ttl * 1000)), "worker string", "Update", "ProcessingTime")


def known_table(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(worker, queue_length, ms, expires): the registry as the last batch left it."""
    live, kept = state_table(spark, checkpoint, "live"), state_table(spark, checkpoint, "kept")
    v = "value.value" if "value" in live.schema["value"].dataType.names else "value"
    live = live.select(F.col("key.worker").alias("worker"), f"{v}.queue_length", f"{v}.ms", F.lit(True).alias("expires"))
    return live.union(kept.select(F.col("key.worker").alias("worker"), "value.queue_length", "value.ms", F.lit(False).alias("expires")))


# logs --------------------------------------------------------------------------------------------------


def once(path: str, day: str = "day", then: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch that holds every row once: a batch goes to a folder of its number, by day, which a replay of the batch after a
    failure writes over. ``then`` runs after the write, before the batch counts as done."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy(day).json(f"{path}/batch={number}")
        if then:
            then(number)

    return write


def log_lines(events: DataFrame, kind: Column, **fields: Column) -> DataFrame:
    """(day, tstamp, type, ...): log lines of events (ts), with the day of the file that they belong to."""
    return events.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.unix_micros("ts") / 1e6).alias("tstamp"), kind.alias("type"), *(c.alias(k) for k, c in fields.items()))


def log_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines of a log that ``once`` has written, with ``day`` and ``batch``."""
    return spark.read.schema(f"{schema}, batch bigint, day string").option("basePath", path).json(f"{path}/*/*")


# late rows, duplicates, joins --------------------------------------------------------------------------


def first_copies(events: DataFrame, key: list[str], late: str, ts: str = "ts") -> DataFrame:
    """Rows that are not later than ``late`` behind the newest of the batches before, each once; how many were too late is in the progress."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def late_counts(progress: list[dict]) -> list[tuple[int, int, int]]:
    """(batch, rows in, rows too late) of batches with rows."""
    return [(p["batchId"], p["numInputRows"], sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"])) for p in progress if p["numInputRows"]]


def interval_join(left: DataFrame, right: DataFrame, on: str, before: str, late: str, left_ts: str = "ts", right_ts: str = "right_ts") -> DataFrame:
    """Pairs of two streams with equal ``on`` whose right row is at most ``before`` older than the left. Both watermarks and the interval bound
    what either side keeps."""
    a, b = left.withWatermark(left_ts, late).alias("a"), right.withWatermark(right_ts, late).alias("b")
    near = (F.col(right_ts) <= F.col(left_ts)) & (F.col(right_ts) >= F.col(left_ts) - F.expr(f"INTERVAL {before}"))
    return a.join(b, (F.col(f"a.{on}") == F.col(f"b.{on}")) & near)


# batches -----------------------------------------------------------------------------------------------


def epoch_rows(rows: DataFrame, epochs: int, key: str, seed: int = 0) -> DataFrame:
    """The rows once an epoch (``epoch``, from 0), each epoch in a seeded order of its own within the partitions."""
    d = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    return d.sortWithinPartitions("epoch", F.xxhash64(key, "epoch", F.lit(seed)))


def batch_schema(schema: StructType) -> StructType:
    return StructType(list(schema.fields)).add("batch", LongType()).add("slot", IntegerType())


def endless_batches(rows: DataFrame, group: list[str], size: int) -> DataFrame:
    """Full batches of rows of one group (say, rank and aspect group), as they fill, for as long as rows come; nothing is padded or dropped, what does
    not fill a batch waits in the state. A group's rows pass one buffer in turn, so ranks are what spreads a large group."""
    out = batch_schema(rows.schema)
    return rows.groupBy(*group).transformWithStateInPandas(BatchBuffer(size, rows.schema, out), out, "Append", "None")


def leftovers(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The rows that wait in the buffers after the last batch, read from the state store."""
    t = state_table(spark, checkpoint, "rows", flat=True)
    return t.select("list_element.*")
