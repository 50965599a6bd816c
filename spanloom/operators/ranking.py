"""Ranking and selection: span enumeration, weighted scores, greedy suppression, text duplicates.

Spans are enumerated inside runs without long gaps, and on time buckets as wide as the longest span, so the range join
is an equi-join whose groups do not grow with a video's length. Greedy suppression is one ordered pass a group whose state
is the chosen spans.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators.folds import ordered_fold
from spanloom.operators.intervals import MONO, mono_intervals_of
from spanloom.operators.text import shingles, tokens
from spanloom.registry import query, table


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def enumerate_spans(rows: DataFrame, key: str, order: str, gap: float, low: float, high: float) -> DataFrame:
    """(key, i, j, a, b): spans from row i's start to row j's end, low to high long, with no inner gap above ``gap``.

    ``rows`` has (key, order, a, b) with non-decreasing a and b per key.
    """
    w = Window.partitionBy(key).orderBy(order)
    new = F.when(F.col("a") - F.lag("b").over(w) > gap, 1).otherwise(0)
    runs = rows.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first = runs.select(key, "run", F.col(order).alias("i"), "a", F.explode(F.array(F.floor(F.col("a") / high), F.floor(F.col("a") / high) + 1)).alias("bucket"))
    last = runs.select(key, "run", F.col(order).alias("j"), "b", F.floor(F.col("b") / high).alias("bucket"))
    return first.join(last, [key, "run", "bucket"]).where((F.col("j") >= F.col("i")) & (F.col("b") - F.col("a")).between(low, high)).drop("bucket", "run")


def weighted_score(metrics: Mapping[str, float], penalty: Column, places: int = 2) -> Column:
    """Weighted mean of the metrics that are there, less penalties, clamped to 0..100 and rounded."""
    top = sum((F.coalesce(F.col(m) * w, F.lit(0.0)) for m, w in metrics.items()), F.lit(0.0))
    mass = sum((F.when(F.col(m).isNotNull(), F.lit(w)).otherwise(0.0) for m, w in metrics.items()), F.lit(0.0))
    return F.round(clamp(F.coalesce(F.try_divide(top, mass), F.lit(0.0)) - penalty), places)


def overlap_share(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Overlap of [a, b] and [c, d] as a share of the shorter one."""
    return F.greatest(F.least(b, d) - F.greatest(a, c), F.lit(0.0)) / F.greatest(F.least(b - a, d - c), F.lit(0.01))


def suppress(spans: DataFrame, key: str, k: int, limit: float) -> DataFrame:
    """Greedy choice of k spans per group: best score first, each overlapping no chosen one by more than ``limit``.

    Ties go to the earlier start, then the earlier end. ``spans`` has (key, a, b, score). One pass over each group in the order of
    scores: the state is the chosen spans, at most k, so the plan does not grow with k.
    """
    rows = spans.select(key, "a", "b", "score").where("score IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL")

    def choose(found: Iterator[tuple]) -> Iterator[tuple]:
        chosen: list[tuple[float, float]] = []
        for group, a, b, score in found:
            if all(max(min(b, d) - max(a, c), 0.0) / max(min(b - a, d - c), 0.01) <= limit for c, d in chosen):
                chosen.append((a, b))
                yield group, len(chosen), a, b, score
                if len(chosen) == k:
                    return

    types = {c: rows.schema[c].dataType.simpleString() for c in rows.columns}
    return ordered_fold(rows, [key], [F.desc("score"), "a", "b"], f"{key} {types[key]}, place int, a {types['a']}, b {types['b']}, score {types['score']}", choose)


def suppress_sql(spans: str, key: str, k: int, limit: float) -> str:
    """The same rounds as a chain of DuckDB common tables."""
    parts = [f"r1 AS MATERIALIZED (SELECT {key}, a, b, score FROM {spans})"]
    for place in range(1, k + 1):
        parts.append(f"p{place} AS MATERIALIZED (SELECT {key}, {place} AS place, a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, a, b) AS n FROM r{place}) WHERE n = 1)")
        parts.append(f"r{place + 1} AS MATERIALIZED (SELECT r.* FROM r{place} r JOIN p{place} p USING ({key}) WHERE greatest(least(r.b, p.b) - greatest(r.a, p.a), 0) / greatest(least(r.b - r.a, p.b - p.a), 0.01) <= {limit})")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT * FROM p{p}" for p in range(1, k + 1))


_RUNS = f"(SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a, event_id ROWS UNBOUNDED PRECEDING) AS run, row_number() OVER (PARTITION BY user_id ORDER BY a, event_id) AS i FROM (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY user_id ORDER BY a, event_id) > 7200 THEN 1 ELSE 0 END AS new FROM {MONO}))"
_SPANS = f"(SELECT x.user_id, x.i, y.i AS j, x.a, y.b FROM {_RUNS} x JOIN {_RUNS} y ON x.user_id = y.user_id AND x.run = y.run AND y.i >= x.i AND y.b - x.a BETWEEN 1800 AND 36000)"


def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mono_intervals_of(table(spark, sf_dir, "events"))
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("a", "event_id")))
    return enumerate_spans(rows.select("user_id", "i", "a", "b"), "user_id", "i", 7200.0, 1800.0, 36000.0)


@query("span_enumeration", f"SELECT user_id, i, j, round(b - a, 3) AS duration FROM {_SPANS}")
def span_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_spans(spark, sf_dir).select("user_id", "i", "j", F.round(F.col("b") - F.col("a"), 3).alias("duration"))


@query("nms_topk", f"SELECT user_id, place, a, b, score FROM ({suppress_sql(f'(SELECT user_id, a, b, round(b - a, 3) AS score FROM {_SPANS})', 'user_id', 3, 0.45)})")
def nms_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppress(event_spans(spark, sf_dir).withColumn("score", F.round(F.col("b") - F.col("a"), 3)), "user_id", 3, 0.45)


@query("nms_top12", f"SELECT user_id, place, a, b, score FROM ({suppress_sql(f'(SELECT user_id, a, b, round(b - a, 3) AS score FROM {_SPANS})', 'user_id', 12, 0.45)})")
def nms_top12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default number of clips: twelve spans that overlap little."""
    return suppress(event_spans(spark, sf_dir).withColumn("score", F.round(F.col("b") - F.col("a"), 3)), "user_id", 12, 0.45)


@query(
    "weight_normalise",
    "SELECT event_type, round(w * count(*) OVER () / sum(w) OVER (), 4) AS weight FROM (SELECT event_type, avg(value) AS w FROM events GROUP BY 1)",
)
def weight_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights scaled so that their sum is their number; one row per kind reaches the window."""
    means = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("w"))
    total = means.agg(F.sum("w").alias("all"), F.count("*").alias("n"))
    return means.join(F.broadcast(total)).select("event_type", F.round(F.col("w") * F.col("n") / F.col("all"), 4).alias("weight"))


_GRAMS = r"""(SELECT {id}, unnest(g) AS gram, len(g) AS n FROM (SELECT {id}, CASE WHEN len(t) >= 3 THEN list_distinct(list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' '))) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END AS g
  FROM (SELECT {id}, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9$%€£'']+(?:[.,][0-9]+)?', 0) AS t FROM {table})))"""


@query(
    "text_dup",
    f"""SELECT doc_id, item_id, round(greatest(hit / (n_d + n_i - hit), 0.9::DOUBLE * hit / least(n_d, n_i)), 6) AS similarity FROM (
    SELECT d.doc_id, i.item_id, count(*)::DOUBLE AS hit, any_value(d.n) AS n_d, any_value(i.n) AS n_i FROM {_GRAMS.format(id='doc_id', table='documents')} d JOIN {_GRAMS.format(id='item_id', table='benchmark')} i USING (gram) GROUP BY 1, 2)
    WHERE greatest(hit / (n_d + n_i - hit), 0.9::DOUBLE * hit / least(n_d, n_i)) >= 0.8""",
)
def text_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents like an item of the benchmark, a stated reference set: intersection or containment of 3-grams."""

    def grams(name: str, key: str, n: str) -> DataFrame:
        rows = table(spark, sf_dir, name).select(key, tokens(F.col("text")).alias("t"))
        rows = rows.select(key, shingles(F.col("t")).alias("g"))
        return rows.select(key, F.size("g").alias(n), F.explode("g").alias("gram"))

    met = grams("documents", "doc_id", "n_d").join(grams("benchmark", "item_id", "n_i"), "gram").groupBy("doc_id", "item_id").agg(F.count("*").alias("hit"), F.first("n_d").alias("n_d"), F.first("n_i").alias("n_i"))
    share = F.greatest(F.col("hit") / (F.col("n_d") + F.col("n_i") - F.col("hit")), F.lit(0.9).cast("double") * F.col("hit") / F.least("n_d", "n_i"))
    return met.withColumn("s", share).where("s >= 0.8").select("doc_id", "item_id", F.round("s", 6).alias("similarity"))
