"""Queries that run streams over ``events``, delivered in slices: what they write and what they keep, against SQL over the whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.operators.numbering import written
from loomgrid.plans import fixtures as X
from loomgrid.plans.families import Queries
from loomgrid.session import shared_folder
from loomgrid.streaming import runs as R

query = Queries()
QUERIES, ORACLE_SQL = query.queries, query.sql

DELIVERIES = 3
#: Events reach the log up to ten hours late, by a rule; a delivery holds ten days of arrivals from 1 January 2024 (day 19,723), the last the rest.
LATE_HOURS = 4
SLICE = "least(2, greatest(0, ({} div 86400000000 - 19723) div 10))"
ARRIVED = "ar AS (SELECT *, epoch_us(ts) + (event_id * 7919 % 11) * 3600000000 AS arrival FROM events), sl AS (SELECT *, least(2, greatest(0, (arrival // 86400000000 - 19723) // 10)) AS slice FROM ar)"
TTL_HOURS = 6


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/streams-{name}-{uuid.uuid4().hex[:12]}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with ``ts`` as an instant, whatever the session's time zone, and ``arrival`` in microseconds."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    e = X.table(spark, sf_dir, "events").withColumn("us", us)
    return e.withColumn("ts", F.timestamp_micros("us")).withColumn("arrival", F.expr("us + (event_id * 7919 % 11) * 3600000000"))


def _beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.select(F.expr("concat('w', user_id % 40)").alias("worker"), F.expr("int(event_id % 9)").alias("queue_length"), F.expr("user_id % 40 % 6 <> 0").alias("check_hb"), "ts")


BEATS = "hb AS (SELECT 'w' || (user_id % 40) AS worker, CAST(event_id % 9 AS INT) AS queue_length, user_id % 40 % 6 <> 0 AS check_hb, epoch_us(ts) // 1000 AS ms FROM events)"


@query(f"""WITH {BEATS}, g AS (SELECT *, CASE WHEN lag(ms) OVER w IS NULL OR (check_hb AND ms - lag(ms) OVER w > {TTL_HOURS} * 3600000) THEN 1 ELSE 0 END AS new FROM hb WINDOW w AS (PARTITION BY worker ORDER BY ms, queue_length)),
s AS (SELECT *, sum(new) OVER (PARTITION BY worker ORDER BY ms, queue_length ROWS UNBOUNDED PRECEDING) AS k FROM g),
r AS (SELECT worker, k, check_hb, min(ms) AS first, max(ms) AS last, arg_min(queue_length, (ms, queue_length)) AS q0, arg_max(queue_length, (ms, queue_length)) AS q1, count(*) AS n FROM s GROUP BY ALL)
SELECT worker, 'registered' AS state, first AS at, q0 AS queue_length, 1 AS beats FROM r UNION ALL SELECT worker, 'expired', last + {TTL_HOURS} * 3600000, q1, n FROM r WHERE check_hb AND last + {TTL_HOURS} * 3600000 <= (SELECT max(ms) FROM hb)""")
def registry_changes_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heartbeats in three deliveries; registrations and expiries as the stream's timers and gaps gave them."""
    at, out = _folder(spark, "beats"), _folder(spark, "changes")
    b = _beats(spark, sf_dir)
    w = lambda: R.registry_changes(R.arriving(spark, at, b.schema), TTL_HOURS * 3600.0).writeStream.format("parquet").option("path", out)
    R.deliver(b, F.expr(SLICE.format("unix_micros(ts)")), DELIVERIES, at, lambda k: R.drain(w(), f"{out}-checkpoint"))
    return spark.read.schema(R.CHANGE).parquet(out)


@query(f"WITH {BEATS}, m AS (SELECT worker, max((ms, queue_length)) AS x, any_value(check_hb) AS expires FROM hb GROUP BY worker) SELECT worker, x[2] AS queue_length, x[1] AS ms, expires FROM m")
def registry_state_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry as expiring and lasting state hold it after the last delivery, read back as a table."""
    at, out = _folder(spark, "beats"), _folder(spark, "known")
    b = _beats(spark, sf_dir)
    w = lambda: R.known_workers(R.arriving(spark, at, b.schema), 7 * 24 * 3600.0).writeStream.format("noop").outputMode("update")
    R.deliver(b, F.expr(SLICE.format("unix_micros(ts)")), DELIVERIES, at, lambda k: R.drain(w(), f"{out}-checkpoint", clock=True))
    return R.known_table(spark, f"{out}-checkpoint")


def _log(spark: SparkSession, sf_dir: str, name: str, kinds: dict[str, str]) -> DataFrame:
    """Log lines of some event types, written by a sink that fails after its second batch is on disk and before that counts as done; the
    run is started again and the third delivery follows."""
    at, out = _folder(spark, name), _folder(spark, f"{name}-log")
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv)), F.col("event_type"))
    e = _events(spark, sf_dir).where(F.col("event_type").isin(*kinds))
    failed = []

    def fail(number: int) -> None:
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("lost after the write")

    def run(k: int) -> None:
        lines = R.log_lines(R.arriving(spark, at, e.schema), kind, model=F.concat(F.lit("m"), F.expr("user_id % 3")), event_id=F.col("event_id"))
        w = lambda: lines.writeStream.foreachBatch(R.once(out, then=fail))
        try:
            R.drain(w(), f"{out}-checkpoint")
        except Exception:  # the failure above, as Spark passes it on
            if not failed:
                raise
            R.drain(w(), f"{out}-checkpoint")

    R.deliver(e, F.expr(SLICE.format("us")), DELIVERIES, at, run)
    assert failed
    return R.log_table(spark, out, "tstamp double, type string, model string, event_id bigint")


def _log_sql(kinds: dict[str, str]) -> str:
    case = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in kinds.items())
    return f"SELECT strftime(ts, '%Y-%m-%d') AS day, CASE event_type {case} END AS type, 'm' || (user_id % 3) AS model, count(*) AS n, count(DISTINCT event_id) AS n_events, CAST(sum(epoch_us(ts)) AS BIGINT) AS us FROM events WHERE event_type IN ({', '.join(map(repr, kinds))}) GROUP BY ALL"


def _log_sums(log: DataFrame) -> DataFrame:
    """Lines of each day, type and model. Microseconds of some five thousand lines no longer fit in 64 bits, so they are added up exactly in 38 digits;
    sums that all fit are a bigint, as in SQL, which has no answer for others."""
    us = F.sum(F.round(F.col("tstamp") * 1e6).cast("long").cast("decimal(20,0)")).cast("decimal(38,0)")
    sums = written(log.groupBy("day", "type", "model").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_events"), us.alias("us")), "log-sums")
    (most,) = sums.agg(F.max(F.abs("us"))).first()
    return sums.withColumn("us", F.col("us").cast("long")) if most is None or most < 1 << 63 else sums


CHATS, VOTES = {"view": "chat", "click": "chat"}, {"purchase": "upvote", "error": "downvote", "signup": "flag"}


@query(_log_sql(CHATS))
def chat_log_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat events in a log of a file set a day: no line twice after a failure and a replay."""
    return _log_sums(_log(spark, sf_dir, "chats", CHATS))


@query(_log_sql(VOTES))
def vote_log_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log_sums(_log(spark, sf_dir, "votes", VOTES))


#: Every third event comes twice, the second time 13 hours after the first.
COPIES = "cp AS (SELECT event_id, event_type, epoch_us(ts) AS us, arrival FROM ar UNION ALL SELECT event_id, event_type, epoch_us(ts), arrival + 46800000000 FROM ar WHERE event_id % 3 = 0), cs AS (SELECT *, least(2, greatest(0, (arrival // 86400000000 - 19723) // 10)) AS slice FROM cp)"
MARK = f"mx AS (SELECT slice, max(us) AS top FROM cs GROUP BY slice), mk AS (SELECT a.slice, (coalesce(max(b.top), 0) - {LATE_HOURS} * 3600000000) // 1000 * 1000 AS mark FROM mx a LEFT JOIN mx b ON b.slice < a.slice GROUP BY a.slice), lt AS (SELECT cs.*, us < mark AS late FROM cs JOIN mk USING (slice))"


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("event_id", "event_type", "ts", "arrival")
    return e.union(e.where("event_id % 3 = 0").withColumn("arrival", F.expr("arrival + 46800000000")))


def _on_time(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    at, out = _folder(spark, "copies"), _folder(spark, "first")
    e, counts = _copies(spark, sf_dir), []
    w = lambda: R.first_copies(R.arriving(spark, at, e.schema), ["event_id"], f"{LATE_HOURS} hours").writeStream.format("parquet").option("path", out)
    R.deliver(e, F.expr(SLICE.format("arrival")), DELIVERIES, at, lambda k: counts.extend(R.late_counts(R.drain(w(), f"{out}-checkpoint"))))
    return spark.read.schema(e.schema).parquet(out), counts


@query(f"WITH {ARRIVED}, {COPIES}, {MARK} SELECT CAST(row_number() OVER (ORDER BY slice) - 1 AS BIGINT) AS delivery, count(*) AS rows_in, count(*) FILTER (late) AS rows_late FROM lt GROUP BY slice")
def late_rows_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each delivery were behind the watermark, from the stream's own progress: a row a batch."""
    _, counts = _on_time(spark, sf_dir)
    return spark.createDataFrame([(k, n, late) for k, (_, n, late) in enumerate(counts)], "delivery bigint, rows_in bigint, rows_late bigint")


@query(f"WITH {ARRIVED}, {COPIES}, {MARK} SELECT event_type, event_id FROM lt WHERE NOT late GROUP BY ALL")
def first_copies_within_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which a copy came in time, each once."""
    return _on_time(spark, sf_dir)[0].select("event_type", "event_id")


@query("SELECT a.event_id, b.event_id AS click_id FROM events a JOIN events b ON a.event_type = 'purchase' AND b.event_type = 'click' AND a.user_id = b.user_id AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 12 HOUR")
def clicks_before_purchases_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams joined on user and interval: clicks of the twelve hours before a purchase."""
    at, out = _folder(spark, "events"), _folder(spark, "pairs")
    e = _events(spark, sf_dir).select("event_id", "event_type", "user_id", "ts", "us")

    def pairs() -> DataFrame:
        s = R.arriving(spark, at, e.schema)
        left = s.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
        right = s.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("right_ts"))
        return R.interval_join(left, right, "user_id", "12 HOURS", "1 hour").select("event_id", "click_id")

    R.deliver(e, F.expr(SLICE.format("us")), DELIVERIES, at, lambda k: R.drain(pairs().writeStream.format("parquet").option("path", out), f"{out}-checkpoint"))
    return spark.read.schema("event_id bigint, click_id bigint").parquet(out)


RANKS, BATCH, EPOCHS = 4, 16, 2


@query(f"WITH {X.IMG}, i AS (SELECT image_id, CASE WHEN width / height > 1 THEN 1 ELSE 0 END AS flag, image_id % {RANKS} AS rank, unnest(range({EPOCHS})) AS epoch FROM images), g AS (SELECT flag, CAST(rank AS INT) AS rank, count(*) AS n, sum(image_id) AS s FROM i GROUP BY ALL) SELECT flag, rank, n // {BATCH} AS n_batches, n % {BATCH} AS n_left, CAST(s AS BIGINT) AS id_sum, n AS n_rows, true AS once FROM g")
def endless_group_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of two epochs stream into buffers by rank and aspect group, which give full batches; what is left in the buffers is read from
    the state. Batches and leftovers together hold each image once an epoch."""
    at, out = _folder(spark, "images"), _folder(spark, "batches")
    im = X.images(spark, sf_dir)
    rows = R.epoch_rows(im.select("image_id", F.expr("int(CASE WHEN width / height > 1 THEN 1 ELSE 0 END)").alias("flag"), F.expr(f"int(image_id % {RANKS})").alias("rank")), EPOCHS, "image_id")
    w = lambda: R.endless_batches(R.arriving(spark, at, rows.schema), ["rank", "flag"], BATCH).writeStream.format("parquet").option("path", out)
    R.deliver(rows, F.col("epoch"), EPOCHS, at, lambda k: R.drain(w(), f"{out}-checkpoint"))
    made = spark.read.schema(R.batch_schema(rows.schema)).parquet(out)
    left = R.leftovers(spark, f"{out}-checkpoint")
    b = made.groupBy("flag", "rank").agg(F.countDistinct("batch").alias("n_batches"), F.count("*").alias("n_made"))
    all_rows = made.select(*rows.columns).union(left.select(*rows.columns))
    a = all_rows.groupBy("flag", "rank").agg(F.count("*").alias("n_rows"), F.sum("image_id").alias("id_sum"), (F.countDistinct("image_id", "epoch") == F.count("*")).alias("once"))
    return a.join(b, ["flag", "rank"], "left").select("flag", "rank", F.coalesce("n_batches", F.lit(0)).alias("n_batches"), (F.col("n_rows") - F.coalesce("n_made", F.lit(0))).alias("n_left"), "id_sum", "n_rows", "once")
