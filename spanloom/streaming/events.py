"""Streaming: event-time windows with a watermark, sessions, interval joins, throttles and latest state per key.

A stream is run to the end of what is there and stops; its sink and its checkpoint lie in one folder. Called with the folder of an
earlier run, a query goes on where that one ended (``drained(..., folder=)``); without one it begins anew in a new folder. Late rows
are those behind the watermark, an hour behind the latest time that earlier batches held: windows that it has passed are closed, and rows
that belong to them are dropped. State leaves with the watermark, but for ``stream_latest``, whose state is one row a user. ``stream_progress``
combines the rows of a batch first and carries only what is open behind it, since most of its hours open and close in the same batch.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.registry import query, table


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local one only in local mode and where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = base or f"file://{os.path.join(tempfile.gettempdir(), 'spanloom-streams')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table, one file or a folder of them (hence the pattern), as a stream; its time is cast for watermarks."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, name: str, mode: str = "append", folder: str | None = None, each: Callable[[DataFrame, DataFrame | None], DataFrame] | None = None) -> DataFrame:
    """All that the stream has given, written and read back; in update mode the last batch of a key counts.

    With ``folder`` the stream goes on from the checkpoint there, and what earlier runs have given stands beside the new rows. What is written
    for a batch is ``each(batch, what was written for the batch before, or None)``, if that is given; a batch that is run again is written anew.
    """
    spark = stream.sparkSession
    folder = folder or shared_folder(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        if each is not None:
            batch = each(batch, batch.sparkSession.read.parquet(f"{folder}/out/batch={number - 1}").drop("_batch") if number else None)
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def in_rounds(blocks: list[DataFrame], build: Callable[[DataFrame], DataFrame], name: str, mode: str = "append", folder: str | None = None, each: Callable | None = None) -> DataFrame:
    """What ``build`` gives for rows that arrive block by block: each block is one batch of a run that goes on from the run before."""
    spark = blocks[0].sparkSession
    folder = folder or shared_folder(spark, name)
    for block in blocks:
        block.write.mode("append").parquet(f"{folder}/in")
        found = drained(build(spark.readStream.schema(block.schema).parquet(f"{folder}/in")), name, mode, folder, each)
    return found


def arrivals(spark: SparkSession, sf_dir: str, late: bool, columns: list[str]) -> list[DataFrame]:
    """These columns of events in four blocks of eight days as they arrive; if ``late``, every fiftieth row comes a block after its own."""
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    block = F.least(F.lit(3), F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 8))
    block = F.least(F.lit(3), block + F.when(F.col("event_id") % 50 == 0, 1).otherwise(0)) if late else block
    return [rows.where(block == k).select(columns) for k in range(4)]


#: The same blocks, and the watermark that holds in each.
BLOCKS = """(SELECT *, least(3, date_diff('day', DATE '2024-01-01', ts::DATE) // 8 + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END) AS block FROM events)"""
MARKS = f"(SELECT block, coalesce(max(latest) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 HOUR, TIMESTAMP '1970-01-01') AS mark FROM (SELECT block, max(ts) AS latest FROM {BLOCKS} GROUP BY 1))"


@query(
    "stream_tumbling",
    """SELECT day, event_type, n, total FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2)
    WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts and sums; a day is out when the watermark, an hour behind, has passed it."""
    windows = event_stream(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    found = drained(windows.select(F.col("window.start").alias("day"), "event_type", "n", "total"), "tumbling")
    return found.select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 3).alias("total"))


@query("stream_latest", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest event of each user: update mode, the last batch of a key counts."""
    last = event_stream(spark, sf_dir).groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("last"))
    found = drained(last, "latest", "update").groupBy("user_id").agg(F.max("last").alias("last"))
    return found.select("user_id", "last.event_id", "last.event_type")


@query("stream_dedupe", "SELECT event_type, user_id, count(DISTINCT date_trunc('hour', ts)) AS hours FROM events GROUP BY 1, 2")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events coalesced to one per key and hour before they are counted."""
    keyed = event_stream(spark, sf_dir).withWatermark("ts", "1 hour").withColumn("hour", F.date_trunc("hour", "ts")).dropDuplicatesWithinWatermark(["event_type", "user_id", "hour"])
    return drained(keyed.select("event_type", "user_id", "hour"), "dedupe").groupBy("event_type", "user_id").agg(F.count("*").alias("hours"))


@query(
    "stream_session",
    f"""WITH kept AS (SELECT e.* FROM {BLOCKS} e JOIN {MARKS} USING (block) WHERE ts + INTERVAL 6 HOUR > mark),
    parts AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS part FROM (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM kept))
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM parts GROUP BY user_id, part HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user with breaks of six hours, over four batches; rows that come eight days late are dropped."""
    found = sessions(arrivals(spark, sf_dir, True, ["user_id", "ts"]), "user_id", 6, 1)
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


def sessions(blocks: list[DataFrame], key: str, gap: int, delay: int) -> DataFrame:
    """(key, start, end, n): sessions with breaks of ``gap`` hours of rows (key, ts, ...) that arrive in ``blocks``, once the mark, ``delay`` hours behind, has passed their end.

    A row counts as long as its own session would still be open, and may then join one that has ended up to ``gap`` hours before the mark. So
    state is kept that much longer, rows behind the mark of the blocks before are left out by the time itself, and what has ended
    but could still grow is read from the state at the end.
    """
    spark = blocks[0].sparkSession
    folder = shared_folder(spark, "session")
    latest = [block.agg(F.max("ts")).first()[0] for block in blocks]

    def build(stream: DataFrame) -> DataFrame:
        windows = stream.withWatermark("ts", f"{delay + gap} hours").groupBy(key, F.session_window("ts", f"{gap} hours").alias("s")).agg(F.count("*").alias("n"))
        return windows.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")

    kept = []
    for number, block in enumerate(blocks):
        before = max((t for t in latest[:number] if t is not None), default=None)
        kept.append(block if before is None else block.where(F.col("ts") + F.expr(f"INTERVAL {gap} HOURS") > F.lit(before) - F.expr(f"INTERVAL {delay} HOURS")))
    found = in_rounds(kept, build, "session", folder=folder).select(key, "start", "end", "n")
    state = spark.read.format("statestore").load(f"{folder}/state")
    held = state.select(F.col(f"key.{key}").alias(key), F.col("value.session_window.start").alias("start"), F.col("value.session_window.end").alias("end"), F.col("value.count").alias("n"))
    mark = max((t for t in latest if t is not None), default=None)
    return found.unionByName(held.where(F.col("end") <= F.lit(mark).cast("timestamp") - F.expr(f"INTERVAL {delay} HOURS")))


@query(
    "stream_join",
    """SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM events v JOIN events p ON v.user_id = p.user_id AND v.event_type = 'view' AND p.event_type = 'purchase' AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 12 HOUR""",
)
def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views with the purchases of the same user in the next twelve hours: two streams, whose state the watermarks bound, over four batches."""

    def joined(stream: DataFrame) -> DataFrame:
        views = stream.where("event_type = 'view'").select(F.col("user_id").alias("viewer"), F.col("event_id").alias("view_id"), F.col("ts").alias("seen")).withWatermark("seen", "1 hour")
        bought = stream.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("paid")).withWatermark("paid", "1 hour")
        return views.join(bought, F.expr("viewer = user_id AND paid BETWEEN seen AND seen + INTERVAL 12 HOURS")).select("view_id", "purchase_id")

    return in_rounds(arrivals(spark, sf_dir, False, ["user_id", "ts", "event_id", "event_type"]), joined, "join").select("view_id", "purchase_id")


#: Groups that the keys of a throttle are dealt into: Spark's work for a group of pandas rows with state is milliseconds, whatever its size.
BUCKETS = 2048
_NO_ID = 2**63 - 1


def throttled(stream: DataFrame, key: str, key_type: str, seconds: int) -> DataFrame:
    """(key, event_id, ts): a key's events that are at least ``seconds`` behind the last one let through; null keys and times take no part.

    The state of a bucket of keys has the time of that one for each key, until the watermark is past the interval; a timer of event
    time removes what is left once the watermark is past the last of them.
    """
    wait = seconds * 1_000_000

    def step(bucket: tuple, frames: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = sorted(row for f in frames for row in zip(f["us"].tolist(), f["event_id"].tolist(), f[key].tolist()))
        mark = state.getCurrentWatermarkMs()
        last = dict(json.loads(state.get[0])) if state.exists else {}
        passed = []
        for us, event, k in rows:
            if k not in last or us - last[k] >= wait:
                passed.append((k, event, us))
                last[k] = us
        last = {k: us for k, us in last.items() if (us + wait) // 1000 >= mark}
        state.update((json.dumps(list(last.items())),))
        state.setTimeoutTimestamp(max((max(last.values(), default=0) + wait) // 1000, mark) + 1)
        yield pd.DataFrame(passed, columns=[key, "event_id", "us"])

    rows = stream.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", "1 hour")
    rows = rows.select(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("_bucket"), key, F.coalesce("event_id", F.lit(_NO_ID)).alias("event_id"), "ts", F.unix_micros("ts").alias("us"))
    made = rows.groupBy("_bucket").applyInPandasWithState(step, f"{key} {key_type}, event_id bigint, us bigint", "last string", "append", "EventTimeTimeout")
    return made.select(key, F.nullif("event_id", F.lit(_NO_ID)).alias("event_id"), F.timestamp_micros("us").alias("ts"))


@query(
    "stream_throttle",
    """WITH RECURSIVE passed(user_id, ts) AS (SELECT user_id, min(ts) FROM events GROUP BY 1
    UNION ALL SELECT p.user_id, min(e.ts) FROM passed p JOIN events e ON e.user_id = p.user_id AND e.ts >= p.ts + INTERVAL 1 DAY GROUP BY p.user_id, p.ts)
    SELECT user_id, min(event_id) AS event_id, ts FROM passed JOIN events USING (user_id, ts) GROUP BY 1, 3""",
)
def stream_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user at most once a day, over four batches."""
    found = in_rounds(arrivals(spark, sf_dir, False, ["user_id", "ts", "event_id"]), lambda s: throttled(s, "user_id", "bigint", 86_400), "throttle")
    return found.select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


def hours_of_batch(batch: DataFrame, before: DataFrame | None) -> DataFrame:
    """(user_id, hour, last, n, open): hours of a batch of events and of those still open in the batch before; ``open`` until an hour behind the latest time has passed their end.

    The latest row's own hour is always open, so what was open tells how far the batches before have come. Rows of hours that were
    closed by then are dropped. What goes on to the next batch is the last hours of this one, however long it is.
    """
    latest = batch.agg(F.unix_micros(F.max("ts"))).first()[0]
    rows = batch.select("user_id", F.window("ts", "1 hour").start.alias("hour"), F.struct("ts", "event_id").alias("last"), F.lit(1).cast("bigint").alias("n"))
    if before is not None:
        carried = before.where("open").drop("open")
        reached = carried.agg(F.unix_micros(F.max("last.ts"))).first()[0]
        if reached is not None:
            rows = rows.where(F.col("hour") + F.expr("INTERVAL 2 HOURS") > F.timestamp_micros(F.lit(reached)))
            latest = reached if latest is None else max(latest, reached)
        rows = rows.unionByName(carried)
    found = rows.groupBy("user_id", "hour").agg(F.max("last").alias("last"), F.sum("n").alias("n"))
    return found.withColumn("open", F.col("hour") + F.expr("INTERVAL 2 HOURS") > F.timestamp_micros(F.lit(latest).cast("bigint")))


@query(
    "stream_progress",
    f"""SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS hour, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM {BLOCKS} e JOIN {MARKS} USING (block) WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR > mark
    GROUP BY 1, 2 HAVING date_trunc('hour', ts)::TIMESTAMP + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and hour, written once the hour is closed, over four batches with late rows."""
    found = in_rounds(arrivals(spark, sf_dir, True, ["user_id", "ts", "event_id"]), lambda s: s, "progress", each=hours_of_batch)
    found = found.where("NOT open").select("user_id", "hour", F.col("last.event_id").alias("event_id"), "n")
    return found.select("user_id", F.col("hour").cast("timestamp_ntz").alias("hour"), "event_id", "n")
