"""Job and schedule state: deduplicated enqueueing, dispatch under limits, retry with backoff, slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.registry import query, table

JOBS = """(SELECT event_id AS id, event_type AS resource, ['queued', 'running', 'done', 'failed'][event_id % 4 + 1] AS status, floor(value)::BIGINT AS priority, ts AS not_before, user_id || ':' || event_type AS dedupe_key, event_id % 5 AS retries FROM events)"""
NOW = "2024-01-20 00:00:00"


def jobs_of(events: DataFrame) -> DataFrame:
    """Events in the shape of a job table."""
    status = F.element_at(F.array(*map(F.lit, ("queued", "running", "done", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    return events.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("resource"), status.alias("status"), F.floor("value").cast("long").alias("priority"), F.col("ts").alias("not_before"),
        F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("dedupe_key"), (F.col("event_id") % 5).alias("retries"),
    )


def dispatch(jobs: DataFrame, now: Column, limit: int, looked_at: int = 200) -> DataFrame:
    """Queued jobs to start: the first ``looked_at`` by priority, then those due, then as many per resource as are free.

    The order of these steps shows in the result. The window sees at most ``looked_at`` rows.
    """
    head = jobs.where("status = 'queued'").orderBy(F.desc("priority"), "id").limit(looked_at).where(F.col("not_before") <= now)
    busy = jobs.where("status = 'running'").groupBy("resource").agg(F.count("*").alias("busy"))
    place = F.row_number().over(Window.partitionBy("resource").orderBy(F.desc("priority"), "id"))
    free = F.lit(limit) - F.coalesce("busy", F.lit(0))
    return head.withColumn("place", place).join(busy, "resource", "left").where(F.col("place") <= free).drop("busy")


def backoff_seconds(retries: Column, base: float = 30.0, cap: float = 3600.0) -> Column:
    """Doubling delay before the next try, up to a cap."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), retries), F.lit(cap))


def first_active(jobs: DataFrame) -> DataFrame:
    """Each job with the id of the earliest active job of its dedupe key, or its own id if none is active."""
    active = jobs.where("status IN ('queued', 'running')").groupBy("dedupe_key").agg(F.min("id").alias("active_id"))
    return jobs.join(active, "dedupe_key", "left").withColumn("active_id", F.coalesce("active_id", "id"))


@query("dispatch_claims", f"""SELECT id, resource, place FROM (SELECT *, row_number() OVER (PARTITION BY resource ORDER BY priority DESC, id) AS place FROM (SELECT * FROM {JOBS} WHERE status = 'queued' ORDER BY priority DESC, id LIMIT 200) WHERE not_before <= TIMESTAMP '{NOW}')
  LEFT JOIN (SELECT resource, count(*) AS busy FROM {JOBS} WHERE status = 'running' GROUP BY 1) USING (resource) WHERE place <= 1000 - coalesce(busy, 0)""")
def dispatch_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dispatch(jobs_of(table(spark, sf_dir, "events")), F.expr(f"timestamp_ntz'{NOW}'"), 1000).select("id", "resource", "place")


@query("backoff_schedule", f"SELECT id, CASE WHEN retries < 3 THEN 'queued' ELSE 'failed' END AS next_status, CASE WHEN retries < 3 THEN least(30 * pow(2.0::DOUBLE, retries), 3600) END AS delay FROM {JOBS} WHERE status = 'failed'")
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = jobs_of(table(spark, sf_dir, "events")).where("status = 'failed'")
    again = F.col("retries") < 3
    return jobs.select("id", F.when(again, "queued").otherwise("failed").alias("next_status"), F.when(again, backoff_seconds(F.col("retries"))).alias("delay"))


@query("dedupe_enqueue", f"SELECT j.id, coalesce(a.active_id, j.id) AS active_id FROM {JOBS} j LEFT JOIN (SELECT dedupe_key, min(id) AS active_id FROM {JOBS} WHERE status IN ('queued', 'running') GROUP BY 1) a USING (dedupe_key)")
def dedupe_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_active(jobs_of(table(spark, sf_dir, "events"))).select("id", "active_id")


@query("next_slot", """SELECT o_custkey, min(day + to_hours(hour)) AS slot FROM (SELECT o_custkey, last_day, unnest(generate_series(last_day, last_day + INTERVAL 7 DAY, INTERVAL 1 DAY)) AS day, last_at FROM (SELECT o_custkey, max(o_orderdate) AS last_at, date_trunc('day', max(o_orderdate))::TIMESTAMP AS last_day FROM orders GROUP BY 1)),
  (SELECT unnest([10, 14, 18, 22]) AS hour) WHERE day + to_hours(hour) >= last_at + INTERVAL 3 HOUR GROUP BY 1""")
def next_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First free daily slot at least three hours after each key's last use."""
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("at"))
    slots = F.expr("flatten(transform(sequence(0, 7), d -> transform(array(10, 14, 18, 22), h -> cast(date_trunc('DAY', at) AS timestamp_ntz) + make_dt_interval(d, h))))")
    return last.select("o_custkey", F.array_min(F.filter(slots, lambda s: s >= F.expr("at + interval 3 hours"))).alias("slot"))
