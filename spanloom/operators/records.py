"""Changes of records as new tables: replace, update, delete and their effects on children, versions, patches, recovery, guards, ordered sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators.state import JOBS, jobs_of
from spanloom.registry import query, table


def replace_partition(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` without the keys that ``new`` has, and all rows of ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def update_where(rows: DataFrame, condition: Column, values: Mapping[str, Column]) -> DataFrame:
    """New values where the condition is true; other rows, and those where it is null, stay."""
    return rows.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def without_parent(children: DataFrame, gone: DataFrame, key: str, cascade: Column) -> DataFrame:
    """Children after their parents are gone: ``cascade`` ones go too, others, those without a flag among them, lose the key.

    A parent that stands twice among the gone ones goes once.
    """
    marked = children.join(gone.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left")
    return marked.where(F.col("_gone").isNull() | ~F.coalesce(cascade, F.lit(False))).withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone")


def reverted(versions: DataFrame, key: str, version: str, to: Column) -> DataFrame:
    """The version ``to`` of each key, appended again under the next number."""
    top = versions.groupBy(key).agg(F.max(version).alias("_top"))
    old = versions.where(F.col(version) == to).join(top, key)
    return old.withColumn(version, F.col("_top") + 1).drop("_top").select(*versions.columns)


def patched(rows: DataFrame, changes: Mapping[str, Column], clear: Sequence[str]) -> DataFrame:
    """Fields set where the change is not null; then the ``clear`` ones nulled."""
    rows = rows.withColumns({c: F.coalesce(v, F.col(c)) for c, v in changes.items()})
    return rows.withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in clear})


@query("point_lookup", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 7")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record by its key: the key reaches the scan as a pushed filter."""
    return table(spark, sf_dir, "customer").where("c_custkey = 7").select("c_custkey", "c_name", "c_mktsegment")


@query("column_scan", "SELECT DISTINCT p_type FROM part")
def column_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_type").distinct()


_NEW = "SELECT s_nationkey AS c_nationkey, s_suppkey AS c_custkey, s_acctbal AS c_acctbal FROM supplier WHERE s_nationkey % 3 = 0"


@query("replace_partition", f"SELECT c_nationkey, c_custkey, round(c_acctbal, 2) AS balance FROM (SELECT c_nationkey, c_custkey, c_acctbal FROM customer WHERE c_nationkey NOT IN (SELECT c_nationkey FROM ({_NEW})) UNION ALL {_NEW})")
def replace_partition_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "supplier").where("s_nationkey % 3 = 0").select(F.col("s_nationkey").alias("c_nationkey"), F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    old = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return replace_partition(old, new, "c_nationkey").select("c_nationkey", "c_custkey", F.round("c_acctbal", 2).alias("balance"))


@query("conditional_update", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_totalprice < 100000 THEN 'F' ELSE o_orderstatus END AS status FROM orders")
def conditional_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = update_where(table(spark, sf_dir, "orders"), (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") < 100000), {"o_orderstatus": F.lit("F")})
    return rows.select("o_orderkey", F.col("o_orderstatus").alias("status"))


@query("conditional_delete", "SELECT o_orderpriority, count(*) FILTER (o_totalprice < 50000 AND o_orderstatus IN ('F', 'P')) AS deleted, count(*) FILTER ((o_totalprice < 50000 AND o_orderstatus IN ('F', 'P')) IS NOT TRUE) AS kept FROM orders GROUP BY 1")
def conditional_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a guarded delete removes and leaves, by priority; a row whose condition is null stays."""
    goes = F.coalesce((F.col("o_totalprice") < 50000) & F.col("o_orderstatus").isin("F", "P"), F.lit(False))
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(goes).alias("deleted"), F.count_if(~goes).alias("kept"))


@query("parent_deletes", "SELECT o_orderkey, CASE WHEN c.c_custkey IS NULL THEN o_custkey END AS o_custkey FROM orders LEFT JOIN (SELECT DISTINCT c_custkey FROM customer WHERE c_acctbal < 0) c ON o_custkey = c.c_custkey WHERE c.c_custkey IS NULL OR o_orderstatus IS DISTINCT FROM 'O'")
def parent_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in debt go: their open orders with them, their other orders lose the customer."""
    gone = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return without_parent(rows, gone, "o_custkey", F.col("o_orderstatus") == "O").select("o_orderkey", "o_custkey")


@query("version_reverts", "SELECT l_orderkey, (SELECT max(l_linenumber) FROM lineitem m WHERE m.l_orderkey = l.l_orderkey) + 1 AS version, l_partkey FROM lineitem l WHERE l_linenumber = 1")
def version_reverts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first version of each document, appended again as its newest."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("version"), "l_partkey")
    return reverted(rows, "l_orderkey", "version", F.lit(1))


@query("field_patches", "SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN 'renamed ' || p_partkey END, p_name) AS p_name, CAST(NULL AS VARCHAR) AS p_type FROM part")
def field_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("renamed "), F.col("p_partkey")))
    return patched(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), {"p_name": change}, ["p_type"])


@query("null_filters", "SELECT lang, count(*) FILTER (toxic IS NULL) AS unlabelled, count(*) FILTER (toxic IS NOT NULL) AS labelled, count(*) FILTER ((toxic = 1) IS TRUE) AS toxic, count(*) FILTER ((toxic = 1) IS FALSE) AS clean FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def null_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    y = F.col("toxic")
    return rows.groupBy("lang").agg(F.count_if(y.isNull()).alias("unlabelled"), F.count_if(y.isNotNull()).alias("labelled"), F.count_if((y == 1).eqNullSafe(True)).alias("toxic"), F.count_if((y == 1).eqNullSafe(False)).alias("clean"))


_GUARD = "event_type <> 'error' AND value >= 20 AND event_id % 3 <> 0 AND user_id IS NOT NULL AND NOT (value > 150 AND event_id % 5 = 0)"


@query("guards", f"SELECT event_id, ({_GUARD}) AS upload, NOT (event_id % 100 / 100.0 > 0.85 AND -value / 50 < -1) AS heard, (value IS NULL OR value > 60) AS long_form, (value > 20 AND value < 80) AS inside FROM events")
def guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conjunctions that decide about a row: an upload, a heard segment, a long form, a value strictly inside a range."""
    e = F.expr
    return table(spark, sf_dir, "events").select("event_id", e(_GUARD).alias("upload"), e("NOT (event_id % 100 / 100.0 > 0.85 AND -value / 50 < -1)").alias("heard"), e("value IS NULL OR value > 60").alias("long_form"), e("value > 20 AND value < 80").alias("inside"))


@query("unique_first", "SELECT event_id, place FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 7 = 0, coalesce(-value, 0), event_id) AS place FROM events) WHERE place <= 5")
def unique_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rows a user: those that are no duplicates first, then by value, null as zero."""
    order = Window.partitionBy("user_id").orderBy(F.col("event_id") % 7 == 0, F.coalesce(-F.col("value"), F.lit(0.0)), "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.row_number().over(order).alias("place")).where("place <= 5")


@query("default_extremes", "SELECT n_nationkey, coalesce(min(c_acctbal) FILTER (c_acctbal > 9000), -1) AS least, coalesce(nullif(max(c_custkey) FILTER (c_mktsegment = 'BUILDING'), 0), 50) AS top FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def default_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least and greatest of possibly no rows, with defaults; a greatest of 0 counts as none."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    least = F.coalesce(F.min(F.when(F.col("c_acctbal") > 9000, F.col("c_acctbal"))), F.lit(-1.0))
    top = F.coalesce(F.nullif(F.max(F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_custkey"))), F.lit(0)), F.lit(50))
    return rows.groupBy("n_nationkey").agg(least.alias("least"), top.alias("top"))


@query("dominant_keys", "SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY sum(round(value * 100)::BIGINT) DESC, event_type) AS place FROM events GROUP BY 1, 2) WHERE place = 1")
def dominant_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key of the greatest mean times count of each user."""
    sums = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("s"))
    best = F.min(F.struct((-F.col("s")).alias("order"), "event_type"))
    return sums.groupBy("user_id").agg(best.alias("b")).select("user_id", "b.event_type")


@query("weak_words", "SELECT user_id, count(*) FILTER (value < 10) AS weak, count(*) AS n, count(*) FILTER (value < 10) > greatest(3, 0.08 * count(*)) AS flagged FROM events GROUP BY 1")
def weak_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether more than 8 percent, and more than three, of a group's samples are weak."""
    weak = F.count_if(F.col("value") < 10)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(weak.alias("weak"), F.count("*").alias("n"), (weak > F.greatest(F.lit(3.0), 0.08 * F.count("*"))).alias("flagged"))


@query("strongest_at", "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, arg_max(event_id, (value, -event_id)) AS event_id FROM events GROUP BY 1")
def strongest_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest sample of every hour; the first one of equals."""
    rows = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
    return rows.agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("event_id"))


@query("missing_numbers", "SELECT page_id, len(list_filter(list_distinct(regexp_extract_all(url, '[0-9]+')), lambda x: NOT list_contains(regexp_extract_all(html, '[0-9]+'), x))) AS missing FROM pages")
def missing_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that a page's address names and its text lacks."""
    numbers = lambda c: F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0))
    return table(spark, sf_dir, "pages").select("page_id", F.size(F.array_except(numbers("url"), numbers("html"))).alias("missing"))


@query("distinct_words", "SELECT item_id, string_agg(w, ' ' ORDER BY i) AS words FROM (SELECT item_id, arg_min(w, i) AS w, min(i) AS i FROM (SELECT item_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM benchmark) GROUP BY item_id, lower(w)) GROUP BY 1")
def distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's words once, in order, letter case aside; the first spelling stays."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("i", "w"))
    first = words.groupBy("item_id", F.lower("w").alias("k")).agg(F.min(F.struct("i", "w")).alias("x"))
    return first.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["w"]), " ").alias("words"))


@query("boundaries", "SELECT user_id, list_sort(list_distinct(list_concat([0, max(event_id) + 10], list(event_id) FILTER (event_type = 'error')))) AS marks FROM events GROUP BY 1")
def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero, the cuts inside and the end of each series, sorted and once each."""
    cuts = F.collect_list(F.when(F.col("event_type") == "error", F.col("event_id")))
    ends = F.array(F.lit(0).cast("bigint"), (F.max("event_id") + 10).cast("bigint"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.array_distinct(F.concat(ends, cuts))).alias("marks"))


@query("crash_recovery", f"SELECT id, CASE WHEN status = 'running' THEN 'queued' ELSE status END AS status, CASE WHEN status = 'running' THEN retries + 1 ELSE retries END AS retries FROM {JOBS}")
def crash_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after a crash: what was running waits again and has one more try behind it."""
    was = F.col("status") == "running"
    return jobs_of(table(spark, sf_dir, "events")).select("id", F.when(was, "queued").otherwise(F.col("status")).alias("status"), F.when(was, F.col("retries") + 1).otherwise(F.col("retries")).alias("retries"))


@query("fan_in", "SELECT user_id, day, greatest(a, b) AS ready FROM (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, min(event_id) FILTER (event_type = 'click') AS a, min(event_id) FILTER (event_type = 'view') AS b FROM events GROUP BY 1, 2) WHERE a IS NOT NULL AND b IS NOT NULL")
def fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A follow-up is due once both its predecessors are done; with it, the later of the two."""
    first = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("event_id")))
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(first("click").alias("a"), first("view").alias("b"))
    return rows.where("a IS NOT NULL AND b IS NOT NULL").select("user_id", "day", F.greatest("a", "b").alias("ready"))


@query("due_sources", "SELECT o_custkey, max(o_orderdate)::TIMESTAMP + to_days(CASE WHEN o_custkey % 2 = 0 THEN 30 ELSE 7 END) AS due FROM orders GROUP BY 1 HAVING max(o_orderdate)::TIMESTAMP + to_days(CASE WHEN o_custkey % 2 = 0 THEN 30 ELSE 7 END) <= TIMESTAMP '1998-06-01'")
def due_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose own interval since their last scan is over at a given time."""
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").cast("timestamp_ntz").alias("at"))
    due = F.expr("at + make_dt_interval(CASE WHEN o_custkey % 2 = 0 THEN 30 ELSE 7 END)")
    return last.select("o_custkey", due.alias("due")).where("due <= timestamp_ntz'1998-06-01 00:00:00'")


@query("status_toggles", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'O' WHEN 'O' THEN 'F' ELSE o_orderstatus END AS status, o_totalprice >= 200000 AND o_orderstatus <> 'P' AS favourite, CASE WHEN o_totalprice >= 300000 THEN 'excellent' WHEN o_totalprice >= 200000 THEN 'good' WHEN o_totalprice >= 100000 THEN 'fair' ELSE 'weak' END AS band FROM orders")
def status_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, price = F.col("o_orderstatus"), F.col("o_totalprice")
    band = F.when(price >= 300000, "excellent").when(price >= 200000, "good").when(price >= 100000, "fair").otherwise("weak")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(s == "F", "O").when(s == "O", "F").otherwise(s).alias("status"), ((price >= 200000) & (s != "P")).alias("favourite"), band.alias("band"))


@query("guarded_deletes", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def guarded_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that may go: no child of theirs is active."""
    active = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(active, "c_custkey", "left_anti")


@query("centred_series", "SELECT user_id, event_id, round(value - avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 8 PRECEDING AND 7 FOLLOWING), 6) AS x, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS ends FROM events")
def centred_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples less their moving average over sixteen places, and where the next one begins."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.col("value") - F.avg("value").over(order.rowsBetween(-8, 7)), 6).alias("x"), F.lead("event_id").over(order).alias("ends"))
