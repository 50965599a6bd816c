"""The learning loop: normalised performance, guarded correlation, bounded weight updates, insights.

All statistics are one aggregation each over unpivoted rows; only their few results are joined back, by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.registry import query, table


def moment_correlation(x: Column, y: Column) -> Column:
    """Pearson's correlation as an aggregate of centred moments; 0 for fewer than three rows or a constant side."""
    return F.when((F.count("*") < 3) | (F.stddev_pop(x) * F.stddev_pop(y) == 0), 0.0).otherwise(F.coalesce(F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)), F.lit(0.0)))


def with_performance(samples: DataFrame) -> DataFrame:
    """``samples`` (views, like_rate, ...) with perf = 0.8 z(views) + 0.2 z(like_rate); a constant column has deviation 1."""
    spread = lambda c: F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0))
    stats = samples.agg(F.avg("views").alias("mv"), spread("views").alias("sv"), F.avg("like_rate").alias("ml"), spread("like_rate").alias("sl"))
    z = 0.8 * ((F.col("views") - F.col("mv")) / F.col("sv")) + 0.2 * ((F.col("like_rate") - F.col("ml")) / F.col("sl"))
    return samples.join(F.broadcast(stats)).withColumn("perf", z).drop("mv", "sv", "ml", "sl")


def unpivot(rows: DataFrame, keep: list[str], metrics: list[str]) -> DataFrame:
    return rows.unpivot(keep, metrics, "metric", "value").where("value IS NOT NULL")


def updated_weight(weight: Column, r: Column, n: Column, rate: float = 0.15, most: float = 0.2, least: int = 20) -> Column:
    """A weight moved towards weight * (1 + r) by ``rate``, r shrunk for few samples, by ``most`` of itself at most; below ``least`` samples it stays."""
    target = weight * (1 + r * F.greatest(F.lit(0.0), 1 - 1.5 / F.sqrt(n)))
    step = weight + rate * (target - weight)
    return F.when(n < least, weight).otherwise(F.least(F.greatest(step, weight * (1 - most)), weight * (1 + most)))


SAMPLES = "(SELECT d.doc_id, d.lang, d.source, d.n_chars::DOUBLE AS views, l.quality::DOUBLE AS like_rate, (d.doc_id % 97)::DOUBLE AS m_id, l.toxic::DOUBLE AS m_toxic, (d.n_chars % 1000)::DOUBLE AS m_tail FROM documents d JOIN labels l USING (doc_id))"
PERF = f"(SELECT s.*, 0.8::DOUBLE * ((views - mv) / sv) + 0.2::DOUBLE * ((like_rate - ml) / sl) AS perf FROM {SAMPLES} s, (SELECT avg(views) AS mv, coalesce(nullif(stddev_pop(views), 0), 1) AS sv, avg(like_rate) AS ml, coalesce(nullif(stddev_pop(like_rate), 0), 1) AS sl FROM {SAMPLES}))"
LONG = f"(UNPIVOT (SELECT doc_id, perf, m_id, m_toxic, m_tail FROM {PERF}) ON m_id, m_toxic, m_tail INTO NAME metric VALUE value)"
R = "CASE WHEN count(*) < 3 OR stddev_pop(value) * stddev_pop(perf) = 0 THEN 0 ELSE (avg(value * perf) - avg(value) * avg(perf)) / (stddev_pop(value) * stddev_pop(perf)) END"
#: Samples of at least two days, by their age of doc_id % 90 days.
MATURE = "doc_id % 90 >= 2"
LONG_MATURE = LONG.replace(SAMPLES, f"(SELECT * FROM {SAMPLES} WHERE {MATURE})")
METRICS = ["m_id", "m_toxic", "m_tail"]


def samples_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    number = lambda c: F.expr(c).cast("double")
    return rows.select("doc_id", "lang", "source", number("n_chars").alias("views"), number("quality").alias("like_rate"), number("doc_id % 97").alias("m_id"), number("toxic").alias("m_toxic"), number("n_chars % 1000").alias("m_tail"))


def correlations(samples: DataFrame) -> DataFrame:
    rows = unpivot(with_performance(samples), ["doc_id", "perf"], METRICS)
    return rows.groupBy("metric").agg(F.count("*").alias("n"), moment_correlation(F.col("value"), F.col("perf")).alias("r"))


@query("zscore_perf", f"SELECT doc_id, round(perf, 6) AS perf FROM {PERF}")
def zscore_perf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_performance(samples_of(spark, sf_dir)).select("doc_id", F.round("perf", 6).alias("perf"))


@query("pearson_by_metric", f"SELECT metric, count(*) AS n, round({R}, 6) AS r FROM {LONG} GROUP BY 1")
def pearson_by_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlations(samples_of(spark, sf_dir)).select("metric", "n", F.round("r", 6).alias("r"))


@query("weight_update", f"WITH w AS (SELECT metric, CASE WHEN count(*) < 20 THEN 1.0::DOUBLE ELSE least(greatest(1 + 0.15::DOUBLE * ({R}) * greatest(0, 1 - 1.5::DOUBLE / sqrt(count(*))), 0.8), 1.2) END AS w FROM {LONG_MATURE} GROUP BY 1) SELECT metric, round(w * count(*) OVER () / sum(w) OVER (), 4) AS weight FROM w")
def weight_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of one each, moved by what mature samples say, then brought back to their total."""
    moved = correlations(samples_of(spark, sf_dir).where(MATURE)).select("metric", updated_weight(F.lit(1.0), F.col("r"), F.col("n")).alias("w"))
    total = moved.agg(F.sum("w").alias("total"), F.count("*").alias("mass"))
    return moved.join(F.broadcast(total)).select("metric", F.round(F.col("w") * F.col("mass") / F.col("total"), 4).alias("weight"))


@query(
    "insights",
    f"""SELECT dimension, level, n, round(effect, 6) AS effect FROM (SELECT dimension, level, count(*) AS n, avg(perf) - (SELECT avg(perf) FROM {PERF}) AS effect FROM
    (SELECT 'lang' AS dimension, lang AS level, perf FROM {PERF} UNION ALL SELECT 'source', source, perf FROM {PERF}) GROUP BY 1, 2) WHERE n >= 3 AND abs(effect) >= 0.25 ORDER BY abs(effect) DESC, dimension, level LIMIT 12""",
)
def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels whose mean performance differs from the mean of all, the strongest first: a top-12 report."""
    rows = with_performance(samples_of(spark, sf_dir))
    long = unpivot(rows, ["perf"], ["lang", "source"]).withColumnsRenamed({"metric": "dimension", "value": "level"})
    means = long.groupBy("dimension", "level").agg(F.count("*").alias("n"), F.avg("perf").alias("mean"))
    found = means.join(F.broadcast(rows.agg(F.avg("perf").alias("all")))).withColumn("effect", F.col("mean") - F.col("all"))
    return found.where("n >= 3 AND abs(effect) >= 0.25").orderBy(F.desc(F.abs("effect")), "dimension", "level").limit(12).select("dimension", "level", "n", F.round("effect", 6).alias("effect"))
