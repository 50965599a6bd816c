"""Upload slots: the next n free times of each channel under a daily cap, a minimum gap, a lead and a horizon.

Planning n uploads means asking for the earliest free time n times and counting each answer as taken. For fixed daily slots a time that is
refused once stays refused, so one pass over a channel's candidate times in their order gives the same: candidates near a
taken time leave by a join on time buckets as wide as the gap, counts of a local day come by a join on the day, and the pass keeps the
last chosen time and the number chosen on its day. Spacing by interval starts behind the last taken time, so only
that time and the first day's count matter, and each channel is one row.

Times are microseconds since 1970 (UTC); days and hours are those of ``zone``. Defined results: a channel without taken times
starts now; null times take nothing; fewer rows than n come where the horizon ends; no channels, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.folds import ordered_fold
from spanloom.registry import query, table

MINUTE = 60_000_000
LEAD, HORIZON, MORNING = 3, 60, 9


def local_day(t: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(F.timestamp_micros(t), zone))


def micros(when: str) -> int:
    return round(datetime.fromisoformat(when).replace(tzinfo=UTC).timestamp() * 1e6)


def slot_preview(channels: DataFrame, taken: DataFrame, key: str, key_type: str, now: int, slots: Sequence[str], n: int, cap: int, gap: int, zone: str = "UTC", horizon: int = HORIZON) -> DataFrame:
    """(key, k, t): the first ``n`` slots of each channel (``HH:MM``, local) that are free: ``gap`` minutes from any taken or chosen time, ``cap`` a day (0: none).

    ``channels`` has (key), ``taken`` (key, t).
    """
    zoned = datetime.fromtimestamp(now / 1e6, UTC).astimezone(ZoneInfo(zone))
    days = (zoned.replace(hour=0, minute=0, second=0, microsecond=0) + timedelta(days=d) for d in range(horizon))
    clock = sorted(tuple(map(int, s.strip().split(":"))) for s in slots)
    every = [(round(t.timestamp() * 1e6), t.date()) for day in days for h, m in clock for t in [day.replace(hour=h, minute=m)]]
    ahead = [(t, d) for t, d in every if t >= now + LEAD * MINUTE]  # at most horizon times slots
    listed = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(d).alias("day")) for t, d in ahead]) if ahead else F.expr("cast(array() as array<struct<t:bigint,day:date>>)")
    candidates = channels.select(key).distinct().select(key, F.inline(listed))
    used = taken.select(key, "t").where("t IS NOT NULL")
    if gap > 0:
        width = gap * MINUTE
        near = used.select(F.col(key).alias("other"), F.col("t").alias("x"), F.explode(F.array(*[F.floor(F.col("t") / width) + d for d in (-1, 0, 1)])).alias("bucket"))
        free = candidates.withColumn("bucket", F.floor(F.col("t") / width))
        candidates = free.join(near, (F.col(key) == F.col("other")) & (free["bucket"] == near["bucket"]) & (F.abs(F.col("t") - F.col("x")) < width), "left_anti").drop("bucket")
    on_day = used.groupBy(key, local_day(F.col("t"), zone).alias("day")).agg(F.count("*").alias("used"))
    rows = candidates.join(on_day, [key, "day"], "left").select(key, "t", "day", F.coalesce("used", F.lit(0)).alias("used"))

    def choose(found: Iterator[tuple]) -> Iterator[tuple]:
        last = day = None
        chosen, k = 0, 0
        for channel, t, d, count in found:
            chosen = chosen if d == day else 0
            day = d
            if (last is None or t - last >= gap * MINUTE) and (not cap or count + chosen < cap):
                yield channel, k, t
                last, chosen, k = t, chosen + 1, k + 1
                if k == n:
                    return

    return ordered_fold(rows, [key], ["t"], f"{key} {key_type}, k bigint, t bigint", choose)


def interval_preview(channels: DataFrame, taken: DataFrame, key: str, key_type: str, now: int, n: int, cap: int, gap: int, zone: str = "UTC", horizon: int = HORIZON) -> DataFrame:
    """(key, k, t): ``n`` times as soon as possible, each ``gap`` minutes behind the last taken or chosen one; a full day moves on to 9:00 of the next."""
    width = gap * MINUTE
    used = taken.select(key, "t").where("t IS NOT NULL")
    last = used.where(F.col("t") >= now - width).groupBy(key).agg(F.max("t").alias("last"))
    first = F.greatest(F.lit(now + LEAD * MINUTE), F.coalesce(F.col("last") + width, F.lit(0)))
    rows = channels.select(key).distinct().join(last, key, "left").withColumn("first", first).withColumn("day", local_day(F.col("first"), zone))
    on_day = used.groupBy(key, local_day(F.col("t"), zone).alias("day")).agg(F.count("*").alias("used"))
    rows = rows.join(on_day, [key, "day"], "left").select(key, "last", "first", F.coalesce("used", F.lit(0)).alias("used"))

    def plan(found: Iterator[tuple]) -> Iterator[tuple]:
        own = ZoneInfo(zone)
        for channel, before, t, count in found:
            day = datetime.fromtimestamp(t / 1e6, UTC).astimezone(own).date()
            for k in range(n):
                for _ in range(horizon * 24):
                    local = datetime.fromtimestamp(t / 1e6, UTC).astimezone(own)
                    if local.date() != day:
                        day, count = local.date(), 0
                    if cap and count >= cap:
                        t = round((local + timedelta(days=1)).replace(hour=MORNING, minute=0, second=0, microsecond=0).timestamp() * 1e6)
                    elif before is not None and abs(t - before) < width:
                        t += width
                    else:
                        break
                else:
                    return
                yield channel, k, t
                count, before, t = count + 1, t, t + width

    return ordered_fold(rows, [key], ["first"], f"{key} {key_type}, k bigint, t bigint", plan)


NOW, SLOTS = "2024-01-15 10:30:00", ("09:00", "13:30", "14:00", "18:45")
TAKEN = f"(SELECT user_id, epoch_us(ts) AS t FROM events WHERE event_type IN ('purchase', 'signup') AND ts >= TIMESTAMP '{NOW}' - INTERVAL 1 DAY)"
_NOW = f"epoch_us(TIMESTAMP '{NOW}')"


def uploads_of(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(channels, taken times): users, and their purchases and signups from a day before now on."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    taken = events.where("event_type IN ('purchase', 'signup')").select("user_id", t.alias("t")).where(F.col("t") >= micros(NOW) - 24 * 60 * MINUTE)
    return events.select("user_id"), taken


@query(
    "slot_preview",
    f"""WITH RECURSIVE free AS MATERIALIZED (SELECT c.user_id, c.t, c.day, coalesce(u.used, 0) AS used FROM (
        SELECT user_id, epoch_us(day + to_minutes(clock)) AS t, day FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(generate_series(date_trunc('day', TIMESTAMP '{NOW}'), date_trunc('day', TIMESTAMP '{NOW}') + INTERVAL 59 DAY, INTERVAL 1 DAY)) AS day), (SELECT unnest([540, 810, 840, 1125]) AS clock)) c
      LEFT JOIN (SELECT user_id, date_trunc('day', make_timestamp(t)) AS day, count(*) AS used FROM {TAKEN} GROUP BY 1, 2) u ON u.user_id = c.user_id AND u.day = c.day
      WHERE c.t >= {_NOW} + 180000000 AND NOT EXISTS (FROM {TAKEN} x WHERE x.user_id = c.user_id AND abs(x.t - c.t) < 5400000000)),
    picks(user_id, k, t, chosen) AS (SELECT DISTINCT user_id, -1::BIGINT, -9000000000000000::BIGINT, []::TIMESTAMP[] FROM free
      UNION ALL SELECT p.user_id, any_value(p.k) + 1, min(f.t), list_append(any_value(chosen), date_trunc('day', make_timestamp(min(f.t)))) FROM picks p JOIN free f ON f.user_id = p.user_id AND f.t - p.t >= 5400000000 AND used + len(list_filter(chosen, lambda d: d = f.day)) < 2
      WHERE p.k < 5 GROUP BY p.user_id)
    SELECT user_id, k, t FROM picks WHERE k >= 0""",
)
def slot_preview_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six slots of each user: four a day, two uploads a day, 90 minutes apart."""
    return slot_preview(*uploads_of(table(spark, sf_dir, "events")), "user_id", "bigint", micros(NOW), SLOTS, 6, 2, 90)


@query(
    "interval_preview",
    f"""WITH RECURSIVE taken AS MATERIALIZED (FROM {TAKEN}), start AS (SELECT user_id, greatest({_NOW} + 180000000, coalesce(last + 14400000000, 0)) AS first FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN (SELECT user_id, max(t) AS last FROM taken WHERE t >= {_NOW} - 14400000000 GROUP BY 1) USING (user_id)),
    picks(user_id, k, t, day, used) AS (
      SELECT user_id, 0::BIGINT, CASE WHEN used >= 3 THEN epoch_us(day + INTERVAL 33 HOUR) ELSE first END, CASE WHEN used >= 3 THEN day + INTERVAL 1 DAY ELSE day END, CASE WHEN used >= 3 THEN 1 ELSE used + 1 END
      FROM (SELECT user_id, first, date_trunc('day', make_timestamp(first)) AS day, (SELECT count(*) FROM taken x WHERE x.user_id = s.user_id AND date_trunc('day', make_timestamp(x.t)) = date_trunc('day', make_timestamp(s.first))) AS used FROM start s)
      UNION ALL SELECT user_id, k + 1, CASE WHEN n >= 3 THEN epoch_us(d + INTERVAL 33 HOUR) ELSE c END, CASE WHEN n >= 3 THEN d + INTERVAL 1 DAY ELSE d END, CASE WHEN n >= 3 THEN 1 ELSE n + 1 END
      FROM (SELECT user_id, k, t + 14400000000 AS c, date_trunc('day', make_timestamp(t + 14400000000)) AS d, CASE WHEN date_trunc('day', make_timestamp(t + 14400000000)) = day THEN used ELSE 0 END AS n FROM picks WHERE k < 7))
    SELECT user_id, k, t FROM picks""",
)
def interval_preview_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight uploads of each user, four hours apart, three a day."""
    return interval_preview(*uploads_of(table(spark, sf_dir, "events")), "user_id", "bigint", micros(NOW), 8, 3, 240)
