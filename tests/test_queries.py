"""Every registered query of the library against its DuckDB statement, and hand-made edge cases."""

import datetime

import pytest

import __spark_entry__ as entry_point
from compare import duckdb_rows, spark_rows

SF = "/root/testdata/sf0.001"


def own_names():
    from spanloom import registry

    entry_point._load()
    return sorted(registry.ORACLES)


@pytest.mark.parametrize("name", own_names())
def test_query_equals_sql(spark, name):
    from spanloom import registry

    assert spark_rows(registry.QUERIES[name](spark, SF)) == duckdb_rows(registry.ORACLES[name], SF)


def test_queries_without_sql_run_on_whole_tables(spark):
    """Greedy matching, speakers and page building have no SQL; tests/test_series.py holds them against plain loops."""
    from spanloom import registry

    left = set(registry.QUERIES) - set(registry.ORACLES)
    assert left == {"tracker", "caption_pages", "speaker_series"}
    assert registry.QUERIES["speaker_series"](spark, SF).groupBy("series", "shot", "i").count().where("count <> 1").count() == 0
    tracks = registry.QUERIES["tracker"](spark, SF)
    assert tracks.count() == spark.read.parquet(f"{SF}/lineitem.parquet").count() == tracks.select("series", "frame", "box").distinct().count()
    pages = registry.QUERIES["caption_pages"](spark, SF).selectExpr("sum(last_word - first_word + 1) AS n").first()["n"]
    assert pages == spark.read.parquet(f"{SF}/conversations.parquet").selectExpr("sum(size(filter(split(text, '[ \t\r\n]+'), x -> x <> ''))) AS n").first()["n"]


def test_exact_percentiles(spark):
    import statistics

    from spanloom.operators.intervals import exact_percentiles

    values = {1: [float(i * i % 97) for i in range(301)], 2: [5.0] * 50, None: [1.0, 2.0], 3: [7.0]}
    rows = spark.createDataFrame([(k, v) for k, vs in values.items() for v in [*vs, None]], "k long, v double")
    got = {r.k: (r.p25, r.p50, r.p90) for r in exact_percentiles(rows, "k", "v", (0.25, 0.5, 0.9), buckets=8).collect()}
    for k, vs in values.items():
        want = [statistics.quantiles(vs, n=20, method="inclusive")[i] for i in (4, 9, 17)] if len(vs) > 1 else vs * 3
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[k], want))


def test_entry(spark):
    found = entry_point.entry(spark)
    assert found.columns == ["conv_id", "place", "a", "b", "score"] and found.count() > 0


def test_suppress_keeps_best_that_overlap_little(spark):
    from spanloom.operators.ranking import suppress

    spans = spark.createDataFrame([(1, 0.0, 30.0, 90.0), (1, 2.0, 32.0, 89.0), (1, 40.0, 70.0, 70.0), (1, 35.0, 60.0, 60.0)], "k long, a double, b double, score double")
    rows = suppress(spans, "k", 3, 0.45).orderBy("place").collect()
    assert [(r.a, r.b) for r in rows] == [(0.0, 30.0), (40.0, 70.0)]
    assert suppress(spans.limit(0), "k", 3, 0.45).count() == 0


def test_spans_stop_at_gaps(spark):
    from spanloom.operators.ranking import enumerate_spans

    rows = spark.createDataFrame([(1, 1, 0.0, 4.0), (1, 2, 5.0, 9.0), (1, 3, 20.0, 26.0)], "k long, o int, a double, b double")
    got = {(r.i, r.j) for r in enumerate_spans(rows, "k", "o", 3.0, 5.0, 60.0).collect()}
    assert got == {(1, 2), (3, 3)}


def test_correlation_of_constant_is_zero(spark):
    from pyspark.sql import functions as F
    from spanloom.operators.learning import moment_correlation

    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "x double, y double")
    assert rows.agg(moment_correlation(F.col("x"), F.col("y")).alias("r")).first()["r"] == 0.0


def test_issues_and_status(spark):
    from pyspark.sql import functions as F
    from spanloom.operators.quality import issues, repairs, status

    rules = [("a", 1, F.col("x") > 1, "r2"), ("b", 2, F.col("x") > 2, "r1")]
    rows = spark.createDataFrame([(0,), (2,), (3,), (None,)], "x int").withColumn("i", issues(rules)).select("x", status(F.col("i")).alias("s"), repairs(F.col("i")).alias("r")).collect()
    assert [(r.x, r.s, r.r) for r in rows] == [(0, "PASS", ""), (2, "WARNING", "r2"), (3, "FAIL", "r1,r2"), (None, "PASS", "")]


def test_shingles(spark):
    from pyspark.sql import functions as F
    from spanloom.operators.text import shingles

    rows = spark.createDataFrame([(["a", "b", "c", "d"],), (["a"],), ([],)], "t array<string>")
    assert [r[0] for r in rows.select(shingles(F.col("t"))).collect()] == [["a b c", "b c d"], ["a"], []]


def test_time_offset(spark):
    from pyspark.sql import functions as F
    from spanloom.functions.scalars import time_offset

    rows = spark.createDataFrame([("http://a/?t=90",), ("http://a/?x=1&t=1h2m3s",), ("http://a/",), (None,)], "u string")
    assert [r[0] for r in rows.select(time_offset(F.col("u"))).collect()] == [90, 3723, None, None]


def test_dispatch_looks_at_head_before_due_time(spark):
    from pyspark.sql import functions as F
    from spanloom.operators.state import dispatch

    late, now = datetime.datetime(2024, 2, 1), datetime.datetime(2024, 1, 1)
    jobs = spark.createDataFrame([(1, "g", "queued", 9, late), (2, "g", "queued", 8, now), (3, "g", "queued", 7, now), (4, "g", "running", 1, now)], "id long, resource string, status string, priority long, not_before timestamp")
    got = dispatch(jobs, F.lit(now), 2, looked_at=2).collect()
    assert [r.id for r in got] == [2]
