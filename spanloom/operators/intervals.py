"""Interval and time-series algebra: overlap, coverage, gaps, nearest, resampling and re-timing.

Order-dependent rules are window functions partitioned by a group key; overlap joins meet on time buckets, so a
range join is an equi-join on (group, bucket) with the exact condition as residual, and skewed groups are
split by AQE. Boundary conventions are each function's own and are stated there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.registry import query, table

ORIGIN = 1704067200000000  # 2024-01-01 in microseconds

#: DuckDB form of ``intervals_of``.
INTERVALS = f"""(SELECT user_id, event_id, event_type AS label, value AS interest, round((epoch_us(ts) - {ORIGIN}) / 1e6, 3) AS a, round((epoch_us(ts) - {ORIGIN}) / 1e6 + value * 60, 3) AS b FROM events)"""
MONO = f"""(SELECT user_id, event_id, label, interest, a, least(b, coalesce(lead(a) OVER (PARTITION BY user_id ORDER BY a, event_id), b)) AS b FROM {INTERVALS})"""
SERIES = "(SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, value AS x FROM events)"



def rounded(x: Column, places: int) -> Column:
    """``x`` to ``places`` decimals by the double product with their power of ten, halves away from zero.

    ``round`` of a double works on its shortest decimal form instead, which is apart where the product is a half by rounding alone.
    """
    scaled = x * 10.0**places
    return F.signum(scaled) * F.floor(F.abs(scaled) + 0.5) / 10.0**places


def to_millis(t: Column) -> Column:
    """Seconds to three places, as ``rounded`` does it."""
    return rounded(t, 3)


def intervals_of(events: DataFrame) -> DataFrame:
    """Events as labelled intervals [a, b) in seconds."""
    at = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.expr("cast(timestamp_ntz'2024-01-01 00:00:00' as timestamp)"))) / F.lit(1e6)
    return events.select("user_id", "event_id", F.col("event_type").alias("label"), F.col("value").alias("interest"), to_millis(at).alias("a"), to_millis(at + F.col("value") * 60).alias("b"))


def mono_intervals_of(events: DataFrame) -> DataFrame:
    """The same, each cut where the next of its group begins."""
    following = F.lead("a").over(Window.partitionBy("user_id").orderBy("a", "event_id"))
    return intervals_of(events).withColumn("b", F.least("b", F.coalesce(following, "b")))


def series_of(events: DataFrame) -> DataFrame:
    return events.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("i"), F.col("value").alias("x"))


# ---- operators ----------------------------------------------------------------------------------
def overlap_join(left: DataFrame, right: DataFrame, key: str, bucket: float) -> DataFrame:
    """Pairs of [a, b) and [c, d) of a group that overlap, with the overlap's length. Each pair is made in the bucket of its start."""
    spread = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket)))
    x = left.withColumn("bucket", spread("a", "b"))
    y = right.withColumn("bucket", spread("c", "d"))
    start = F.greatest("a", "c")
    met = x.join(y, [key, "bucket"]).where((F.col("a") < F.col("d")) & (F.col("c") < F.col("b")) & (F.floor(start / bucket) == F.col("bucket")))
    return met.withColumn("overlap", F.least("b", "d") - start).drop("bucket")


def complement(intervals: DataFrame, key: str, duration: Column, least: float) -> DataFrame:
    """Gaps of at least ``least`` between a group's intervals over [0, duration], head and tail included."""
    before = F.coalesce(F.max("b").over(Window.partitionBy(key).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    inner = intervals.select(key, before.alias("s"), F.col("a").alias("e"))
    tail = intervals.groupBy(key).agg(F.max("b").alias("s")).select(key, "s", duration.alias("e"))
    return inner.unionByName(tail).where(F.col("e") - F.col("s") >= least)


def runs_of_gaps(intervals: DataFrame, key: str, order: list[str], gap: float) -> DataFrame:
    """Numbered runs of intervals with no gap above ``gap`` between neighbours."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.when(F.col("a") - F.lag("b").over(w) > gap, 1).otherwise(0)
    return intervals.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def gap_cut(intervals: DataFrame, key: str, trigger: float, keep: float) -> DataFrame:
    """Keep-ranges: a gap above ``trigger`` is cut down to ``keep``, half at either side; ranges of 0.05 or less are dropped."""
    runs = runs_of_gaps(intervals, key, ["a", "event_id"], trigger).groupBy(key, "run").agg(F.min("a").alias("s"), F.max("b").alias("e"))
    w = Window.partitionBy(key).orderBy("run")
    s = F.when(F.lag("e").over(w).isNull(), F.col("s")).otherwise(F.col("s") - keep / 2)
    e = F.when(F.lead("s").over(w).isNull(), F.col("e")).otherwise(F.col("e") + keep / 2)
    return runs.select(key, "run", s.alias("s"), e.alias("e")).where(F.col("e") - F.col("s") > 0.05)


def output_offsets(ranges: DataFrame, key: str) -> DataFrame:
    """Each kept range with the output time at which it begins: a running sum of durations."""
    w = Window.partitionBy(key).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("out", F.coalesce(F.sum(F.col("e") - F.col("s")).over(w), F.lit(0.0)))


def as_of(left: DataFrame, right: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """Last ``value`` of ``right`` at or before each row of ``left``: one union, one window, no range join."""
    both = left.select(key, F.col(t).alias("t"), F.lit(1).alias("side"), *[c for c in left.columns if c not in (key, t)], F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    other = right.select(key, F.col(t).alias("t"), F.lit(0).alias("side"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in (key, t)], F.col(value).alias("_v"))
    w = Window.partitionBy(key).orderBy("t", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.unionByName(other).withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("side = 1").drop("side", "_v")


def merge_adjacent(rows: DataFrame, key: str, label: str, order: list[str], gap: float) -> DataFrame:
    """Neighbours with the same label at most ``gap`` apart become one interval with the greatest interest."""
    w = Window.partitionBy(key).orderBy(*order)
    same = (F.lag(label).over(w) == F.col(label)) & (F.col("a") - F.lag("b").over(w) <= gap)
    rows = rows.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("island", F.sum("_new").over(w))
    return rows.groupBy(key, "island", label).agg(F.min("a").alias("a"), F.max("b").alias("b"), F.max("interest").alias("interest"))


def gap_fill(x: str, key: str, order: str) -> Column:
    """Linear interpolation of nulls by position, held at the ends."""
    back = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(key).orderBy(order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    v = F.when(F.col(x).isNotNull(), F.struct(F.col(order).alias("i"), F.col(x).alias("x")))
    p, n = F.last(v, ignorenulls=True).over(back), F.first(v, ignorenulls=True).over(ahead)
    line = p["x"] + (n["x"] - p["x"]) * (F.col(order) - p["i"]) / F.nullif(n["i"] - p["i"], F.lit(0))
    return F.coalesce(F.col(x), line, p["x"], n["x"])


def exact_percentiles(rows: DataFrame, key: str, value: str, shares: Sequence[float], buckets: int = 1024) -> DataFrame:
    """(key, p60, ...): exact percentiles with linear interpolation, however many rows a key has; nulls are left out.

    A histogram per key, with map-side combine, tells in which bucket each needed rank lies. Only those buckets are sorted, as counts of
    their distinct values, so neither a large key nor a common value meets in one task.
    """
    known = rows.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    ends = known.groupBy(F.col("k").alias("of")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
    place = F.when(F.col("high") > F.col("low"), F.least(F.lit(buckets - 1), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * buckets))).otherwise(0)
    counted = known.join(F.broadcast(ends) if ends.limit(10_001).count() <= 10_000 else ends, F.col("k").eqNullSafe(F.col("of"))).select("k", "v", "n", place.alias("bucket"))
    histogram = counted.groupBy("k", "n", "bucket").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = F.array_distinct(F.array(*[f(F.lit(p) * (F.col("n") - 1)) for p in shares for f in (F.floor, F.ceil)]))
    wanted = histogram.withColumn("before", before).withColumn("ranks", F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("c")))).where(F.size("ranks") > 0)
    wanted = wanted.select(F.col("k").alias("k_"), F.col("bucket").alias("bucket_"), "before", "ranks")
    values = counted.join(wanted, F.col("k").eqNullSafe(F.col("k_")) & (F.col("bucket") == F.col("bucket_"))).groupBy("k", "n", "bucket", "v", "before", "ranks").agg(F.count("*").alias("c"))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("k", "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    values = values.withColumn("upto", upto).select("k", "n", "v", F.explode(F.filter("ranks", lambda r: (r >= F.col("upto") - F.col("c")) & (r < F.col("upto")))).alias("rank"))
    out = values.groupBy("k", "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))

    def share(p: float) -> Column:
        r = F.lit(p) * (F.col("n") - 1)
        low, high = F.element_at("at", F.floor(r)), F.element_at("at", F.ceil(r))
        return low + (high - low) * (r - F.floor(r))

    return out.select(F.col("k").alias(key), *[share(p).alias(f"p{round(p * 100)}") for p in shares])


# ---- registered queries ---------------------------------------------------------------------
@query(
    "silence_complement",
    f"""WITH i AS (SELECT * FROM {INTERVALS}), g AS (SELECT user_id, coalesce(max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, a AS e FROM i
    UNION ALL SELECT user_id, max(b), 2600000 FROM i GROUP BY 1) SELECT user_id, round(s, 3) AS s, round(e, 3) AS e FROM g WHERE e - s >= 3600""",
)
def silence_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complement(intervals_of(table(spark, sf_dir, "events")), "user_id", F.lit(2600000.0), 3600).select("user_id", F.round("s", 3).alias("s"), F.round("e", 3).alias("e"))


@query(
    "gap_cut_ranges",
    f"""WITH n AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY user_id ORDER BY a, event_id) > 7200 THEN 1 ELSE 0 END AS new FROM {MONO}),
    r AS (SELECT user_id, run, min(a) AS s, max(b) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a, event_id ROWS UNBOUNDED PRECEDING) AS run FROM n) GROUP BY 1, 2)
    SELECT user_id, run::BIGINT AS run, round(s2, 3) AS s, round(e2, 3) AS e FROM (SELECT user_id, run, CASE WHEN lag(e) OVER w IS NULL THEN s ELSE s - 300 END AS s2, CASE WHEN lead(s) OVER w IS NULL THEN e ELSE e + 300 END AS e2 FROM r WINDOW w AS (PARTITION BY user_id ORDER BY run)) WHERE e2 - s2 > 0.05""",
)
def gap_cut_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gap_cut(mono_intervals_of(table(spark, sf_dir, "events")), "user_id", 7200, 600).select("user_id", F.col("run").cast("long").alias("run"), F.round("s", 3).alias("s"), F.round("e", 3).alias("e"))


PAIRS = f"(SELECT x.user_id, x.event_id, x.a, x.b, y.interest, least(x.b, y.b) - greatest(x.a, y.a) AS overlap FROM {MONO} x JOIN {INTERVALS} y ON x.user_id = y.user_id AND x.a < y.b AND y.a < x.b WHERE y.label = 'click')"


def click_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    clicks = intervals_of(events).where("label = 'click'").select("user_id", F.col("a").alias("c"), F.col("b").alias("d"), "interest")
    return overlap_join(mono_intervals_of(events).select("user_id", "event_id", "a", "b"), clicks, "user_id", 14400.0)


@query("coverage_ratio", f"SELECT event_id, round(sum(overlap) / greatest(0.01, any_value(b - a)), 4) AS share FROM {PAIRS} GROUP BY 1")
def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return click_overlaps(spark, sf_dir).groupBy("event_id").agg(F.round(F.sum("overlap") / F.greatest(F.lit(0.01), F.first(F.col("b") - F.col("a"))), 4).alias("share"))


@query("weighted_interest", f"SELECT event_id, round(sum(overlap * interest) / nullif(sum(overlap), 0), 4) AS interest FROM {PAIRS} GROUP BY 1")
def weighted_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return click_overlaps(spark, sf_dir).groupBy("event_id").agg(F.round(F.sum(F.col("overlap") * F.col("interest")) / F.nullif(F.sum("overlap"), F.lit(0.0)), 4).alias("interest"))


@query(
    "label_overlap",
    f"""SELECT x.label, count(*) AS n, round(sum(least(x.b, y.b) - greatest(x.a, y.a)), 2) AS seconds FROM {INTERVALS} x JOIN {INTERVALS} y ON x.user_id = y.user_id AND x.event_id < y.event_id AND x.a < y.b AND y.a < x.b WHERE x.label = y.label GROUP BY 1""",
)
def label_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals_of(table(spark, sf_dir, "events"))
    other = rows.select("user_id", F.col("event_id").alias("other_id"), F.col("label").alias("other"), F.col("a").alias("c"), F.col("b").alias("d"))
    met = overlap_join(rows, other, "user_id", 14400.0).where("event_id < other_id AND label = other")
    return met.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("overlap"), 2).alias("seconds"))


@query("as_of_prev", f"""SELECT x.event_id, (SELECT max(y.event_id) FROM {INTERVALS} y WHERE y.user_id = x.user_id AND y.label = 'view' AND y.a = (SELECT max(z.a) FROM {INTERVALS} z WHERE z.user_id = x.user_id AND z.label = 'view' AND z.a <= x.a)) AS view_id FROM {INTERVALS} x WHERE x.label = 'purchase'""")
def as_of_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intervals_of(table(spark, sf_dir, "events"))
    views = rows.where("label = 'view'").groupBy("user_id", "a").agg(F.max("event_id").alias("view_id"))
    return as_of(rows.where("label = 'purchase'").select("user_id", "a", "event_id"), views, "user_id", "a", "view_id").select("event_id", "view_id")


@query(
    "nearest_cut",
    f"""SELECT event_id, cut FROM (SELECT x.event_id, y.a AS cut, row_number() OVER (PARTITION BY x.event_id ORDER BY abs(y.a - x.a), y.a) AS k FROM {INTERVALS} x JOIN {INTERVALS} y ON x.user_id = y.user_id AND y.label = 'view' AND abs(y.a - x.a) <= 3600
    WHERE x.label = 'purchase') WHERE k = 1""",
)
def nearest_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest cut within an hour either way; the first wins ties."""
    rows = intervals_of(table(spark, sf_dir, "events"))
    points = rows.where("label = 'purchase'").select("user_id", "event_id", "a").withColumn("bucket", F.explode(F.sequence(F.floor((F.col("a") - 3600) / 3600), F.floor((F.col("a") + 3600) / 3600))))
    cuts = rows.where("label = 'view'").select("user_id", F.col("a").alias("cut")).withColumn("bucket", F.floor(F.col("cut") / 3600))
    near = points.join(cuts, ["user_id", "bucket"]).where(F.abs(F.col("cut") - F.col("a")) <= 3600)
    return near.groupBy("event_id").agg(F.min_by("cut", F.struct(F.abs(F.col("cut") - F.col("a")), "cut")).alias("cut"))


KEPT = f"""(SELECT user_id, event_id, a AS s, b AS e, coalesce(sum(b - a) OVER (PARTITION BY user_id ORDER BY a, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS out FROM {MONO} WHERE b > a)"""


@query("output_map", f"SELECT event_id, round(out, 3) AS out_start, round(out + (e - s) / 2, 4) AS out_middle FROM {KEPT}")
def output_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source-to-output time of each kept range's start and middle."""
    kept = output_offsets(mono_intervals_of(table(spark, sf_dir, "events")).where("b > a").select("user_id", "event_id", F.col("a").alias("s"), F.col("b").alias("e")), "user_id")
    return kept.select("event_id", F.round("out", 3).alias("out_start"), F.round(F.col("out") + (F.col("e") - F.col("s")) / 2, 4).alias("out_middle"))


@query("point_in_segment", f"SELECT o.o_orderkey, k.event_id FROM (SELECT o_orderkey, o_custkey % 150 AS user_id, (o_orderkey * 977 % 2600000)::DOUBLE AS t FROM orders) o JOIN {KEPT} k ON k.user_id = o.user_id AND o.t >= k.s AND o.t < k.e")
def point_in_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open segment that holds a point."""
    points = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("user_id"), (F.col("o_orderkey") * 977 % 2600000).cast("double").alias("t"))
    kept = mono_intervals_of(table(spark, sf_dir, "events")).where("b > a").select("user_id", "event_id", F.col("a").alias("s"), F.col("b").alias("e"))
    kept = kept.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("s") / 14400), F.floor(F.col("e") / 14400))))
    return points.withColumn("bucket", F.floor(F.col("t") / 14400)).join(kept, ["user_id", "bucket"]).where("t >= s AND t < e").select("o_orderkey", "event_id")


@query(
    "merge_adjacent",
    f"""WITH n AS (SELECT *, CASE WHEN lag(label) OVER w = label AND a - lag(b) OVER w <= 7200 THEN 0 ELSE 1 END AS new FROM {MONO} WINDOW w AS (PARTITION BY user_id ORDER BY a, event_id)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a, event_id ROWS UNBOUNDED PRECEDING) AS island FROM n)
    SELECT user_id, island::BIGINT AS island, label, round(min(a), 3) AS a, round(max(b), 3) AS b, round(max(interest), 4) AS interest FROM i GROUP BY 1, 2, 3""",
)
def merge_adjacent_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merge_adjacent(mono_intervals_of(table(spark, sf_dir, "events")), "user_id", "label", ["a", "event_id"], 7200)
    return rows.select("user_id", F.col("island").cast("long").alias("island"), "label", F.round("a", 3).alias("a"), F.round("b", 3).alias("b"), F.round("interest", 4).alias("interest"))


@query("shots", f"SELECT user_id, shot::BIGINT AS shot, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN label = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, event_id ROWS UNBOUNDED PRECEDING) AS shot FROM {INTERVALS}) GROUP BY 1, 2")
def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows numbered by the markers before them."""
    w = Window.partitionBy("user_id").orderBy("a", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = intervals_of(table(spark, sf_dir, "events")).withColumn("shot", F.sum((F.col("label") == "view").cast("int")).over(w))
    return rows.groupBy("user_id", F.col("shot").cast("long").alias("shot")).agg(F.count("*").alias("n"))


@query("moving_median", f"SELECT user_id, i, round(list_sort([coalesce(lag(x, 2) OVER k, first(x) OVER k), coalesce(lag(x) OVER k, first(x) OVER k), x, coalesce(lead(x) OVER k, last(x) OVER k), coalesce(lead(x, 2) OVER k, last(x) OVER k)])[3], 6) AS x FROM {SERIES} WINDOW k AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def moving_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of five places; at the ends the first and last samples repeat."""
    w = Window.partitionBy("user_id").orderBy("i")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first("x").over(whole), F.last("x").over(whole)
    near = F.array(*[F.coalesce(F.lag("x", k).over(w), first) for k in (2, 1)], F.col("x"), *[F.coalesce(F.lead("x", k).over(w), last) for k in (1, 2)])
    return series_of(table(spark, sf_dir, "events")).select("user_id", "i", F.round(F.element_at(F.array_sort(near), 3), 6).alias("x"))


@query("trailing_mean", f"SELECT user_id, i, round(avg(x) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS x FROM {SERIES}")
def trailing_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("i").rowsBetween(-4, 0)
    return series_of(table(spark, sf_dir, "events")).select("user_id", "i", F.round(F.avg("x").over(w), 6).alias("x"))


@query(
    "gap_fill",
    f"""WITH s AS (SELECT user_id, i, CASE WHEN i % 4 IN (0, 1) THEN NULL ELSE x END AS x FROM {SERIES}), k AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN i END) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS p,
    min(CASE WHEN x IS NOT NULL THEN i END) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM s)
    SELECT k.user_id, k.i, round(coalesce(k.x, a.x + (b.x - a.x) * (k.i - k.p) / nullif(k.n - k.p, 0), a.x, b.x), 6) AS x FROM k LEFT JOIN s a ON a.user_id = k.user_id AND a.i = k.p LEFT JOIN s b ON b.user_id = k.user_id AND b.i = k.n""",
)
def gap_fill_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series_of(table(spark, sf_dir, "events")).withColumn("x", F.when(~(F.col("i") % 4).isin(0, 1), F.col("x")))
    return rows.select("user_id", "i", F.round(gap_fill("x", "user_id", "i"), 6).alias("x"))


@query("jitter", f"SELECT user_id, round(avg(abs(x - 2 * p + q)), 4) AS jitter FROM (SELECT user_id, x, lag(x) OVER w AS p, lag(x, 2) OVER w AS q FROM {SERIES} WINDOW w AS (PARTITION BY user_id ORDER BY i)) GROUP BY 1")
def jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("i")
    rows = series_of(table(spark, sf_dir, "events")).withColumn("d2", F.abs(F.col("x") - 2 * F.lag("x").over(w) + F.lag("x", 2).over(w)))
    return rows.groupBy("user_id").agg(F.round(F.avg("d2"), 4).alias("jitter"))


@query("bucket_activity", f"SELECT (i // 10)::BIGINT AS bucket, round(least(1, avg(abs(x - p)) / 200), 4) AS activity FROM (SELECT *, lag(x) OVER (PARTITION BY user_id ORDER BY i) AS p FROM {SERIES}) GROUP BY 1")
def bucket_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("i")
    rows = series_of(table(spark, sf_dir, "events")).withColumn("d", F.abs(F.col("x") - F.lag("x").over(w)))
    return rows.groupBy(F.floor(F.col("i") / 10).alias("bucket")).agg(F.round(F.least(F.lit(1.0), F.avg("d") / 200), 4).alias("activity"))


@query("percentiles", "SELECT event_type, round(quantile_cont(value, 0.6), 4) AS p60, round(quantile_cont(value, 0.75), 4) AS p75, round(quantile_cont(value, 0.9), 4) AS p90 FROM events GROUP BY 1")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_percentiles(table(spark, sf_dir, "events"), "event_type", "value", (0.6, 0.75, 0.9))
    return rows.select("event_type", *[F.round(f"p{p}", 4).alias(f"p{p}") for p in (60, 75, 90)])


@query("change_count", f"SELECT user_id, count(*) FILTER (label IS DISTINCT FROM before AND before IS NOT NULL) AS changes FROM (SELECT *, lag(label) OVER (PARTITION BY user_id ORDER BY a, event_id) AS before FROM {INTERVALS}) GROUP BY 1")
def change_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("label").over(Window.partitionBy("user_id").orderBy("a", "event_id"))
    return intervals_of(table(spark, sf_dir, "events")).withColumn("before", before).groupBy("user_id").agg(F.count_if(F.col("before").isNotNull() & (F.col("label") != F.col("before"))).alias("changes"))


@query("longest_gap", f"SELECT user_id, round(max(a - p), 3) AS gap FROM (SELECT user_id, a, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM {INTERVALS}) GROUP BY 1")
def longest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.max("b").over(Window.partitionBy("user_id").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    return intervals_of(table(spark, sf_dir, "events")).withColumn("p", before).groupBy("user_id").agg(F.round(F.max(F.col("a") - F.col("p")), 3).alias("gap"))


@query("densify", f"SELECT user_id, event_id, unnest(range(0, floor((b - a) / 600)::BIGINT + 1)) AS step FROM {MONO} WHERE b - a > 1200")
def densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic boundaries every ten minutes in long intervals."""
    rows = mono_intervals_of(table(spark, sf_dir, "events")).where("b - a > 1200")
    return rows.select("user_id", "event_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("b") - F.col("a")) / 600))).alias("step"))
