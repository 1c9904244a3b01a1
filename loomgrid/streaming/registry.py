"""Worker registry, event logs, chunk decoding, batch buffers and event-time windows, as streams and as batch queries."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StructType

from loomgrid.session import reachable

#: Seconds after which a silent worker is gone.
TTL = 30


def snapshot(beats: DataFrame, now: float, ttl: float = TTL, worker: str = "worker", ts: str = "ts") -> DataFrame:
    """Live workers at ``now``: each one's last heartbeat, dropped if it asks for checking and is older than ``ttl`` seconds."""
    cols = [c for c in beats.columns if c != worker]
    last = beats.where(F.col(ts) <= now).groupBy(worker).agg(F.max_by(F.struct(*cols), ts).alias("b")).select(worker, "b.*")
    return last.where(~F.coalesce("check_hb", F.lit(True)) | (F.col(ts) >= now - ttl))


def worker_models(live: DataFrame) -> DataFrame:
    return live.select(F.explode("models").alias("model")).distinct()


def status(live: DataFrame) -> DataFrame:
    """Sum of speeds and queues, and the models, as one worker standing for all."""
    return live.agg(F.sum("speed").alias("speed"), F.sum("queue_length").alias("queue_length"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("models")))).alias("models"))


def queue_length(limit: Column, free: Column, waiting: Column) -> Column:
    return limit - free + F.coalesce(waiting, F.lit(0))


LIVE = "worker string, queue_length int, ts double, state string"


def live_workers(beats: DataFrame, ttl: float = TTL) -> DataFrame:
    """A stream of registry changes (registered, updated, expired) of a stream of heartbeats (worker, queue_length, check_hb, ts). State is
    a row per worker; a processing-time timer expires silent ones."""
    reachable(beats.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            queue, ts, *_ = state.get
            state.remove()
            yield pd.DataFrame({"worker": [key[0]], "queue_length": [queue], "ts": [ts], "state": ["expired"]})
            return
        new = not state.exists
        rows = pd.concat(list(batches)).sort_values("ts")
        last = rows.iloc[-1]
        if not new and state.get[1] > last["ts"]:
            # late beats change nothing, but every call clears the timer: it runs on for what is left
            if state.get[2]:
                state.setTimeoutDuration(max(1, int((ttl - (time.time() - state.get[3])) * 1000)))
            return
        state.update((int(last["queue_length"]), float(last["ts"]), bool(last["check_hb"]), time.time()))
        if bool(last["check_hb"]):
            state.setTimeoutDuration(int(ttl * 1000))
        yield pd.DataFrame({"worker": [key[0]], "queue_length": [int(last["queue_length"])], "ts": [float(last["ts"])], "state": ["registered" if new else "updated"]})

    return beats.groupBy("worker").applyInPandasWithState(step, LIVE, "queue_length int, ts double, check_hb boolean, seen double", "append", GroupStateTimeout.ProcessingTimeTimeout)


class BatchBuffer(StatefulProcessor):
    """Rows of a group wait until a batch is full, then leave together."""

    def __init__(self, size: int, schema: StructType, out: StructType):
        self.size, self.schema, self.out = size, schema, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", self.schema)
        self.made = handle.getValueState("made", StructType().add("n", LongType()))

    def handleInputRows(self, key, rows, timerValues):
        held = [tuple(r) for r in self.rows.get()]
        n = self.made.get()[0] if self.made.exists() else 0
        for pdf in rows:
            held += list(pdf.itertuples(index=False, name=None))
        while len(held) >= self.size:
            full, held = held[: self.size], held[self.size :]
            out = pd.DataFrame(full, columns=[f.name for f in self.out.fields if f.name not in ("batch", "slot")])
            out["batch"], out["slot"] = n, range(self.size)
            n += 1
            yield out
        self.rows.put(held) if held else self.rows.clear()
        self.made.update((n,))

    def close(self) -> None:
        pass


def batch_stream(rows: DataFrame, group: str, size: int) -> DataFrame:
    """Full batches of each group as they fill: all columns, ``batch`` and ``slot``. (Needs the RocksDB state store.)"""
    reachable(rows.sparkSession)
    out = StructType(list(rows.schema.fields)).add("batch", LongType()).add("slot", IntegerType())
    return rows.groupBy(group).transformWithStateInPandas(BatchBuffer(size, rows.schema, out), out, "Append", "None")


def log_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Daily JSON-lines logs as they grow, with event time from ``tstamp``."""
    return spark.readStream.schema(schema).json(path).withColumn("ts", F.timestamp_seconds("tstamp"))


def write_log(events: DataFrame, path: str, checkpoint: str):
    """Appends to a log partitioned by day."""
    return events.withColumn("day", F.date_format(F.timestamp_seconds("tstamp"), "yyyy-MM-dd")).writeStream.partitionBy("day").format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def daily_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type") -> DataFrame:
    return events.groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day"), F.col(kind)).agg(F.count("*").alias("n"))


def decode_chunks(stream: DataFrame, col: str = "value") -> DataFrame:
    """Rows of NUL-separated JSON chunks as (text, error_code, message by code)."""
    c = F.explode(F.filter(F.split(col, "\\x00"), lambda x: x != "")).alias("chunk")
    d = stream.select(*[x for x in stream.columns if x != col], c).withColumn("j", F.from_json("chunk", "text string, error_code int"))
    said = F.when(F.col("j.error_code") == 0, "ok").when(F.col("j.error_code") == 1, "worker out of memory").when(F.col("j.error_code") == 2, "no worker").otherwise("worker failed")
    return d.select(*[x for x in stream.columns if x != col], F.col("j.text").alias("text"), F.col("j.error_code").alias("error_code"), said.alias("said"))


def last_action(events: DataFrame, session: str, ts: str, action: str) -> DataFrame:
    return events.groupBy(session).agg(F.max_by(action, ts).alias(action), F.max(ts).alias(ts))


def evaluation_points(steps: DataFrame, interval: int, start: int | None = None, step: str = "step", milestones: list[tuple[int, int]] | None = None) -> DataFrame:
    """Steps (from 1) after which an evaluation is due: every ``interval`` from ``start`` on; ``milestones`` (step, interval) change it."""
    s = F.col(step)
    every = F.lit(interval)
    for at, n in milestones or []:
        every = F.when(s >= at, n).otherwise(every)
    due = (s % every == 0) if start is None else (s >= start) & ((s - start) % every == 0)
    return steps.where(due)


def by_priority(hooks: DataFrame, priority: str = "priority", order: str = "order") -> DataFrame:
    """Callbacks in running order; names of levels count as numbers. Fixed values of the priority scale."""
    levels = {"HIGHEST": 0, "VERY_HIGH": 10, "HIGH": 30, "ABOVE_NORMAL": 40, "NORMAL": 50, "BELOW_NORMAL": 60, "LOW": 70, "VERY_LOW": 90, "LOWEST": 100}
    p = F.col(priority).try_cast("int")
    for k, v in levels.items():
        p = F.when(F.upper(priority) == k, v).otherwise(p)
    return hooks.withColumn("level", p).withColumn("pos", F.row_number().over(Window.orderBy("level", order)) - 1)


def tumbling(events: DataFrame, length: str, ts: str = "ts", late: str | None = None, by: list[str] = []) -> DataFrame:  # noqa: B006
    e = events.withWatermark(ts, late) if late else events
    return e.groupBy(F.window(ts, length).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sliding(events: DataFrame, length: str, slide: str, ts: str = "ts", late: str | None = None, by: list[str] = []) -> DataFrame:  # noqa: B006
    e = events.withWatermark(ts, late) if late else events
    return e.groupBy(F.window(ts, length, slide).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sessions(events: DataFrame, gap: str, by: str, ts: str = "ts", late: str | None = None) -> DataFrame:
    e = events.withWatermark(ts, late) if late else events
    return e.groupBy(by, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), "n")
