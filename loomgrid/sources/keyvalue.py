"""Ordered key-value files as a Spark data source: ``spark.read.format("keyvalue")`` after ``register(spark)``.

A store is a folder of shards, each an ordered file of (key, value). Reading makes a partition for each stretch of keys of each shard. With the
option ``pushdown``, conditions on the key (equal, in, less, greater, starts with) reach the file, so a lookup of some keys reads no others;
Spark keeps what a loaded table has been asked to push, so load one for each condition (without the option nothing is pushed). Writing gives each
task a shard of its own, which is named only as the job commits: a task that runs twice leaves no row twice, and a failed job nothing.

The folder must be mounted on all machines, as such files are read by path. Backends open a shard by name: ``sqlite`` is in Python itself, ``lmdb`` needs
its library; ``BACKENDS`` takes more.
"""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage

from loomgrid.session import reachable

SCHEMA = "key string, value binary"
ROWS = 4096


class Sqlite:
    """A table ``kv`` in key order (a rowless index), keys as UTF-8 bytes, so that they sort as Spark sorts strings."""

    suffix = ".sqlite"

    def __init__(self, path: str, write: bool = False):
        self.db = sqlite3.connect(path) if write else sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)
        if write:
            self.db.execute("CREATE TABLE kv (key BLOB PRIMARY KEY, value BLOB) WITHOUT ROWID")

    def put(self, rows: list[tuple[bytes, bytes | None]]) -> None:
        self.db.executemany("INSERT OR REPLACE INTO kv VALUES (?, ?)", rows)

    def splits(self, n: int) -> list[bytes]:
        """About ``n`` - 1 keys that part the shard evenly."""
        (count,) = self.db.execute("SELECT count(*) FROM kv").fetchone()
        at = sorted({count * k // n for k in range(1, n)} - {0})
        return [r[0] for k in at if (r := self.db.execute("SELECT key FROM kv ORDER BY key LIMIT 1 OFFSET ?", (k,)).fetchone())]

    def scan(self, low: bytes | None, high: bytes | None) -> Iterator[tuple[bytes, bytes | None]]:
        """Rows from ``low`` on to before ``high``."""
        return iter(self.db.execute("SELECT key, value FROM kv WHERE key >= ? AND (? IS NULL OR key < ?) ORDER BY key", (low or b"", high, high)))

    def get(self, keys: list[bytes]) -> Iterator[tuple[bytes, bytes | None]]:
        for k in keys:
            yield from self.db.execute("SELECT key, value FROM kv WHERE key = ?", (k,))

    def close(self) -> None:
        self.db.commit()
        self.db.close()


BACKENDS = {"sqlite": Sqlite}


def _next(key: bytes) -> bytes:
    """The least key after ``key``."""
    return key + b"\0"


def _after(prefix: bytes) -> bytes | None:
    """The least key after all that start with ``prefix``; null if there is none."""
    p = prefix.rstrip(b"\xff")
    return p[:-1] + bytes([p[-1] + 1]) if p else None


@dataclass
class Bounds:
    """What conditions leave of the keys: from ``low`` on to before ``high``, and only ``keys`` if given."""

    low: bytes | None = None
    high: bytes | None = None
    keys: set[bytes] | None = field(default=None)

    def add(self, low: bytes | None = None, high: bytes | None = None, keys: set[bytes] | None = None) -> None:
        if low is not None:
            self.low = low if self.low is None else max(self.low, low)
        if high is not None:
            self.high = high if self.high is None else min(self.high, high)
        if keys is not None:
            self.keys = keys if self.keys is None else self.keys & keys

    def take(self, f: Filter) -> bool:
        """Whether the condition is one on the key that can be kept here."""
        if getattr(f, "attribute", None) != ("key",):
            return False
        v = getattr(f, "value", None)
        b = v.encode() if isinstance(v, str) else None
        if isinstance(f, In) and all(isinstance(x, str) for x in f.value):
            self.add(keys={x.encode() for x in f.value})
        elif b is None:
            return False
        elif isinstance(f, EqualTo):
            self.add(keys={b})
        elif isinstance(f, GreaterThan):
            self.add(low=_next(b))
        elif isinstance(f, GreaterThanOrEqual):
            self.add(low=b)
        elif isinstance(f, LessThan):
            self.add(high=b)
        elif isinstance(f, LessThanOrEqual):
            self.add(high=_next(b))
        elif isinstance(f, StringStartsWith):
            self.add(low=b, high=_after(b))
        else:
            return False
        return True

    def held(self) -> list[bytes] | None:
        if self.keys is None:
            return None
        return sorted(k for k in self.keys if (self.low is None or k >= self.low) and (self.high is None or k < self.high))


@dataclass
class Stretch(InputPartition):
    shard: str
    low: bytes | None
    high: bytes | None
    keys: list[bytes] | None


class KeyValueReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.backend, self.n = options["path"].removeprefix("file://"), options.get("backend", "sqlite"), int(options.get("partitions", "4"))
        self.bounds, self.pushdown = Bounds(), options.get("pushdown", "false").lower() == "true"

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not (self.pushdown and self.bounds.take(f)):
                yield f

    def partitions(self) -> list[InputPartition]:
        kind, b, out = BACKENDS[self.backend], self.bounds, []
        keys = b.held()
        for name in sorted(x for x in os.listdir(self.path) if x.endswith(kind.suffix) and not x.startswith(("_", "."))):
            shard = os.path.join(self.path, name)
            if keys is not None:
                out.append(Stretch(shard, None, None, keys))
                continue
            with closing(kind(shard)) as s:
                cuts = [k for k in s.splits(self.n) if (b.low is None or k > b.low) and (b.high is None or k < b.high)]
            out += [Stretch(shard, lo, hi, None) for lo, hi in zip([b.low, *cuts], [*cuts, b.high], strict=True)]
        return out

    def read(self, partition: Stretch | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a store without shards
            return
        with closing(BACKENDS[self.backend](partition.shard)) as s:
            rows, part = s.scan(partition.low, partition.high) if partition.keys is None else s.get(partition.keys), []
            for r in rows:
                part.append(r)
                if len(part) == ROWS:
                    yield self.batch(part)
                    part = []
            if part:
                yield self.batch(part)

    @staticmethod
    def batch(rows: list[tuple[bytes, bytes | None]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k.decode() for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.binary())], ["key", "value"])


@dataclass
class Written(WriterCommitMessage):
    hidden: str
    rows: int


class KeyValueWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.backend, self.overwrite = options["path"].removeprefix("file://"), options.get("backend", "sqlite"), overwrite
        os.makedirs(self.path, exist_ok=True)

    def write(self, iterator) -> Written:
        hidden, n, part = os.path.join(self.path, f"_{uuid.uuid4().hex}{BACKENDS[self.backend].suffix}"), 0, []
        with closing(BACKENDS[self.backend](hidden, write=True)) as s:
            for r in iterator:
                if r["key"] is None:
                    raise ValueError("a key is null")
                part.append((r["key"].encode(), None if r["value"] is None else bytes(r["value"])))
                if len(part) == ROWS:
                    s.put(part)
                    n, part = n + len(part), []
            s.put(part)
        return Written(hidden, n + len(part))

    def commit(self, messages: list[Written | None]) -> None:
        old = [x for x in os.listdir(self.path) if not x.startswith(("_", "."))] if self.overwrite else []
        for m in messages:
            if m:
                os.rename(m.hidden, os.path.join(self.path, os.path.basename(m.hidden)[1:]))
        for x in old:
            os.remove(os.path.join(self.path, x))

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and os.path.exists(m.hidden):
                os.remove(m.hidden)


class KeyValueSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyvalue"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> KeyValueReader:
        return KeyValueReader(self.options)

    def writer(self, schema, overwrite: bool) -> KeyValueWriter:
        return KeyValueWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    reachable(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(KeyValueSource)
