"""Catalogue queries: dynamic filters, search, paging, roll-ups, latest-per-key, joins and set operations.

Every function takes DataFrames and column names, so it runs on any table of that shape. Rows are never collected;
a page is a sort with a limit (TakeOrderedAndProject), counts over the filtered rows ride along as one window or one
aggregate, and latest-per-key is a single aggregation with map-side combine instead of a self-join.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.registry import query, table

PAGE_CAP = 200


# ---- filters ----------------------------------------------------------------------------------
def where_set(df: DataFrame, rules: Sequence[tuple[Any, Callable[[Any], Column]]], zero_is_unset: bool = True) -> DataFrame:
    """Conjunction of those rules whose argument is set. By default 0 and '' count as unset, like null."""
    for value, rule in rules:
        if value is None or (zero_is_unset and value in (0, "")):
            continue
        df = df.where(rule(value))
    return df


def in_list(column: str, csv: str) -> Column:
    """Membership in a comma-separated list."""
    return F.col(column).isin(*csv.split(","))


def expand_alias(statuses: Sequence[str], aliases: Mapping[str, Sequence[str]]) -> list[str]:
    """Replace an alias by the statuses it stands for."""
    return [y for x in statuses for y in aliases.get(x, (x,))]


def search(df: DataFrame, columns: Sequence[str], needle: str) -> DataFrame:
    """Case-insensitive substring in any column; % and _ keep their pattern meaning."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(f"%{needle}%"), F.lit(False))
    return df.where(hit)


def eligibility(duration: Column, age_days: Column, live: Column, explicit: Column, low: float, high: float, max_age: float) -> Column:
    """First failing rule, or null if eligible; unknown duration or age passes; explicit rows only fail if live."""
    return (
        F.when(live, "live").when(explicit, F.lit(None)).when(duration < low, "too short").when(duration > high, "too long").when(age_days > max_age, "too old")
    )


# ---- sorts and pages -----------------------------------------------------------------------------
def page(df: DataFrame, sorts: Mapping[str, Sequence[Column]], sort: str, default: str, key: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page in a whitelisted order with a unique tiebreak; ``total`` counts all filtered rows."""
    order = [*sorts.get(sort, sorts[default]), F.col(key).desc_nulls_last()]
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(min(limit, PAGE_CAP)).crossJoin(F.broadcast(total))


def top_per_parent(df: DataFrame, parent: str, order: Sequence[Column], n: int) -> DataFrame:
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(parent).orderBy(*order))).where(F.col("_place") <= n).drop("_place")


# ---- joins and latest-per-key ----------------------------------------------------------------
def latest(df: DataFrame, key: str, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Row of each key with the greatest ``by``: one aggregation, no self-join."""
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*by)).alias("_row")).select(key, "_row.*")


def related_counts(parents: DataFrame, children: DataFrame, key: str, statuses: Mapping[str, Sequence[str]], status: str) -> DataFrame:
    """Children per parent, in all and by groups of statuses; parents without children have zeros."""
    counts = children.groupBy(key).agg(F.count("*").alias("total"), *[F.count_if(F.col(status).isin(*v)).alias(k) for k, v in statuses.items()])
    return parents.join(counts, key, "left").na.fill(0, ["total", *statuses])


def upsert_keep_old(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Merge by key; an empty or null new value keeps the old one."""
    o, n = old.alias("o"), new.alias("n")
    keep = [F.coalesce(F.expr(f"nullif(n.{c}, '')"), F.col(f"o.{c}")).alias(c) for c in columns]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *keep)


def insert_if_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.join(old.select(key), key, "left_anti").select(*old.columns))


# ---- registered queries ------------------------------------------------------------------------
@query(
    "catalog_page",
    """SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS price, (SELECT count(*) FROM orders WHERE o_totalprice >= 50000 AND o_orderstatus <> 'F') AS total
    FROM orders WHERE o_totalprice >= 50000 AND o_orderstatus <> 'F' ORDER BY o_totalprice DESC NULLS LAST, o_orderkey DESC LIMIT 200 OFFSET 20""",
)
def catalog_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = where_set(table(spark, sf_dir, "orders"), [(50000, lambda v: F.col("o_totalprice") >= v), (None, lambda v: F.col("o_custkey") == v), ("F", lambda v: F.col("o_orderstatus") != v)])
    sorts = {"price": [F.col("o_totalprice").desc_nulls_last()], "date": [F.col("o_orderdate").desc_nulls_last()]}
    return page(rows.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"), sorts, "price", "date", "o_orderkey", 500, 20).select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("price"), "total")


@query("catalog_search", "SELECT p_partkey, p_name, p_type FROM part WHERE p_name ILIKE '%an%' OR p_type ILIKE '%an%'")
def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "part"), ["p_name", "p_type"], "an").select("p_partkey", "p_name", "p_type")


@query("multi_status_filter", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY 1")
def multi_status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ",".join(expand_alias(["open"], {"open": ("O", "P")}))
    return status_counts_of(table(spark, sf_dir, "orders").where(in_list("o_orderstatus", wanted)), "o_orderstatus")


def status_counts_of(df: DataFrame, status: str) -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("n"))


@query("status_counts", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status_counts_of(table(spark, sf_dir, "orders"), "o_orderstatus")


@query(
    "source_rollup",
    """SELECT c_custkey, count(o_orderkey) AS total, count(*) FILTER (o_orderstatus = 'F') AS processed, count(*) FILTER (o_orderstatus IN ('O', 'P')) AS processing
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
)
def source_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return related_counts(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", {"processed": ["F"], "processing": ["O", "P"]}, "o_orderstatus")


@query(
    "dashboard_counts",
    """SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_orders, (SELECT count(*) FROM orders WHERE o_totalprice > 200000) AS large_orders,
    (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS in_debt, (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-29') AS recent_events""",
)
def dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "O").alias("open_orders"), F.count_if(F.col("o_totalprice") > 200000).alias("large_orders"))
    customers = table(spark, sf_dir, "customer").agg(F.count("*").alias("customers"), F.count_if(F.col("c_acctbal") < 0).alias("in_debt"))
    recent = table(spark, sf_dir, "events").agg(F.count_if(F.col("ts") >= F.expr("timestamp_ntz'2024-01-29 00:00:00'")).alias("recent_events"))
    return orders.crossJoin(customers).crossJoin(recent)  # one row each


@query("latest_by_id", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def latest_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "events"), "user_id", ["event_id"], ["event_type", "event_id"])


@query("latest_by_time", "SELECT user_id, event_id, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_id", "value"]).withColumn("value", F.round("value", 4))


@query(
    "best_metric_sort",
    """SELECT c_custkey, round(best, 2) AS best FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS best FROM orders GROUP BY 1) ON o_custkey = c_custkey
    ORDER BY best DESC NULLS LAST, c_custkey LIMIT 100""",
)
def best_metric_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("best"))
    rows = table(spark, sf_dir, "customer").select("c_custkey").join(best, "c_custkey", "left")
    return rows.orderBy(F.col("best").desc_nulls_last(), "c_custkey").limit(100).select("c_custkey", F.round("best", 2).alias("best"))


@query(
    "related_lookup",
    """SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE c_mktsegment = 'BUILDING' GROUP BY 1""",
)
def related_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("left_text_lookup", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, length(coalesce(d.text, '')) AS size FROM documents d LEFT JOIN labels l USING (doc_id) ORDER BY d.doc_id DESC LIMIT 400")
def left_text_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").orderBy(F.desc("doc_id")).limit(400).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.length(F.coalesce("text", F.lit(""))).alias("size"))


@query(
    "last_writer_join",
    "SELECT c_custkey, c_name, o.o_orderkey, o.o_orderstatus FROM customer JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey",
)
def last_writer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = latest(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"], ["o_orderkey", "o_orderstatus"])
    return table(spark, sf_dir, "customer").join(last, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_name", "o_orderkey", "o_orderstatus")


@query("unknown_only", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unknown_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("has_related", "SELECT source, count(*) AS n FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) GROUP BY 1")
def has_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("n"))


@query(
    "not_taken_title",
    """SELECT c_custkey, list_filter([c_mktsegment, c_name, 'fallback'], lambda t: NOT list_contains(taken, lower(t)))[1] AS title
    FROM customer, (SELECT list(DISTINCT lower(c_mktsegment)) AS taken FROM customer WHERE c_custkey % 2 = 0)""",
)
def not_taken_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    titles = customers.select("c_custkey", F.array("c_mktsegment", "c_name", F.lit("fallback")).alias("titles"))
    return first_free(titles, customers.where("c_custkey % 2 = 0").select(F.col("c_mktsegment").alias("title")), "c_custkey")


def first_free(rows: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """(key, title): the first of the row's ``titles`` that no row of ``taken`` (title) has, case aside; null if all are taken."""
    offered = rows.select(key, F.posexplode("titles").alias("place", "title"))
    used = taken.select(F.lower("title").alias("low")).distinct()
    free = offered.join(used, F.lower("title") == F.col("low"), "left_anti").groupBy(key).agg(F.min_by("title", "place").alias("title"))
    return rows.select(key).join(free, key, "left")


SNAPSHOTS = """(SELECT event_id AS id, user_id AS short_id, ts AS fetched_at, sum(floor(value * 10)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS views,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE floor(value) END AS likes FROM events)"""


def snapshots(events: DataFrame) -> DataFrame:
    """Cumulative counters per key, as an append-only snapshot log."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("short_id"), F.col("ts").alias("fetched_at"), F.sum(F.floor(F.col("value") * 10)).over(order).alias("views"),
        F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.floor("value")).alias("likes"),
    )


@query("history_daily", f"SELECT strftime(fetched_at, '%Y-%m-%d') AS day, sum(views)::BIGINT AS views, sum(coalesce(likes, 0))::BIGINT AS likes FROM {SNAPSHOTS} GROUP BY 1")
def history_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums cumulative counters over every snapshot of a day."""
    day = F.date_format("fetched_at", "yyyy-MM-dd").alias("day")
    return snapshots(table(spark, sf_dir, "events")).groupBy(day).agg(F.sum("views").cast("long").alias("views"), F.sum(F.coalesce("likes", F.lit(0))).cast("long").alias("likes"))


@query("history_delta", f"SELECT strftime(fetched_at, '%Y-%m-%d') AS day, sum(views - coalesce(before, 0))::BIGINT AS views FROM (SELECT *, lag(views) OVER (PARTITION BY short_id ORDER BY fetched_at, id) AS before FROM {SNAPSHOTS}) GROUP BY 1")
def history_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corrected history: what each snapshot adds to the one before."""
    before = F.lag("views").over(Window.partitionBy("short_id").orderBy("fetched_at", "id"))
    rows = snapshots(table(spark, sf_dir, "events")).withColumn("gain", F.col("views") - F.coalesce(before, F.lit(0)))
    return rows.groupBy(F.date_format("fetched_at", "yyyy-MM-dd").alias("day")).agg(F.sum("gain").cast("long").alias("views"))


@query("metric_pivot", "SELECT user_id, round(max(value) FILTER (event_type = 'click'), 4) AS click, round(max(value) FILTER (event_type = 'view'), 4) AS view, round(max(value) FILTER (event_type = 'purchase'), 4) AS purchase FROM events GROUP BY 1")
def metric_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "view", "purchase"]).agg(F.max("value"))
    return wide.select("user_id", *[F.round(c, 4).alias(c) for c in ("click", "view", "purchase")])


@query(
    "score_rows",
    """SELECT o_orderkey, metric, round(CASE WHEN kind = 'penalty' THEN 0 - value ELSE value END, 2) AS value, kind FROM (
    SELECT l_orderkey AS o_orderkey, unnest(['quantity', 'discount', 'tax']) AS metric, unnest([avg(l_quantity), 100 * avg(l_discount), 100 * avg(l_tax)]) AS value, unnest(['score', 'penalty', 'penalty']) AS kind FROM lineitem GROUP BY 1)""",
)
def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A breakdown exploded to rows; penalties are stored negative."""
    wide = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.avg("l_quantity").alias("q"), (100 * F.avg("l_discount")).alias("d"), (100 * F.avg("l_tax")).alias("t"))
    tall = wide.select("o_orderkey", F.expr("stack(3, 'quantity', q, 'score', 'discount', 0 - d, 'penalty', 'tax', 0 - t, 'penalty') AS (metric, value, kind)"))
    return tall.withColumn("value", F.round("value", 2))


@query(
    "eligibility_reasons",
    """SELECT coalesce(reason, 'eligible') AS reason, count(*) AS n FROM (SELECT CASE WHEN lang = 'es' THEN 'live' WHEN source = 'src0' THEN NULL WHEN n_chars < 400 THEN 'too short' WHEN n_chars > 6000 THEN 'too long'
    WHEN doc_id % 400 > 365 THEN 'too old' END AS reason FROM documents) GROUP BY 1""",
)
def eligibility_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = eligibility(F.col("n_chars"), F.col("doc_id") % 400, F.col("lang") == "es", F.col("source") == "src0", 400, 6000, 365)
    return table(spark, sf_dir, "documents").groupBy(F.coalesce(reason, F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"))


@query(
    "scan_quota",
    """SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS k FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND n_chars BETWEEN 400 AND 6000) WHERE k <= 5""",
)
def scan_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incremental discovery: unknown and eligible items in listing order, up to a quota per source."""
    fresh = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return top_per_parent(fresh.where(F.col("n_chars").between(400, 6000)), "source", [F.desc("doc_id")], 5).select("source", "doc_id")


@query(
    "existing_union",
    "SELECT 'conversation' AS kind, conv_id AS id, length(coalesce(text, '')) AS size FROM conversations WHERE turn = 0 UNION ALL SELECT 'benchmark', item_id, length(coalesce(text, '')) FROM benchmark",
)
def existing_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length(F.coalesce("text", F.lit(""))).alias("size")
    a = table(spark, sf_dir, "conversations").where("turn = 0").select(F.lit("conversation").alias("kind"), F.col("conv_id").alias("id"), size)
    return a.unionByName(table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("kind"), F.col("item_id").alias("id"), size))


@query("preset_override", "SELECT name, arg_max(origin, prio) AS origin FROM (SELECT r_name AS name, 'built-in' AS origin, 0 AS prio FROM region UNION ALL SELECT upper(r_name), 'custom', 1 FROM region WHERE r_regionkey % 2 = 0 UNION ALL SELECT n_name, 'custom', 1 FROM nation) GROUP BY 1")
def preset_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of built-in and custom entries; custom wins by name."""
    regions = table(spark, sf_dir, "region")
    rows = regions.select(F.col("r_name").alias("name"), F.lit("built-in").alias("origin"), F.lit(0).alias("prio"))
    rows = rows.union(regions.where("r_regionkey % 2 = 0").select(F.upper("r_name"), F.lit("custom"), F.lit(1))).union(table(spark, sf_dir, "nation").select("n_name", F.lit("custom"), F.lit(1)))
    return latest(rows, "name", ["prio"], ["origin"])


@query(
    "upsert_merge",
    """SELECT coalesce(n.k, o.k) AS k, coalesce(nullif(n.name, ''), o.name) AS name, coalesce(nullif(n.seg, ''), o.seg) AS seg
    FROM (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg FROM customer WHERE c_custkey % 3 <> 0) o
    FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE lower(c_name) END AS name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'X' END AS seg FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 3 = 0) n ON o.k = n.k""",
)
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    old = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"))
    new = c.where("c_custkey % 4 = 0 OR c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.lower("c_name")).alias("name"), F.when(F.col("c_custkey") % 5 == 0, F.lit(None)).otherwise("X").alias("seg"))
    return upsert_keep_old(old, new, "k", ["name", "seg"])


@query("current_version", "SELECT o_custkey, version, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE version = n")
def current_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions numbered per key on append; the greatest is current."""
    versions = table(spark, sf_dir, "orders").withColumn("version", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    return latest(versions, "o_custkey", ["version"], ["version", "o_orderkey"])


@query("job_order", "SELECT event_id, k FROM (SELECT event_id, row_number() OVER (ORDER BY CASE event_id % 4 WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 3 END, floor(value) DESC, event_id DESC) AS k FROM events) WHERE k <= 100")
def job_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running first, then queued, then the rest; by priority and id. The limit follows the sort."""
    status = F.element_at(F.array(*map(F.lit, ("queued", "running", "done", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    ordinal = F.when(status == "running", 0).when(status == "queued", 1).when(status == "paused", 2).otherwise(3)
    rows = table(spark, sf_dir, "events").orderBy(ordinal, F.desc(F.floor("value")), F.desc("event_id")).limit(100)
    order = Window.orderBy(ordinal, F.desc(F.floor("value")), F.desc("event_id"))  # over the page only
    return rows.withColumn("k", F.row_number().over(order)).select("event_id", "k")


@query("day_groups", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1")
def day_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("preference_pick", "SELECT c_nationkey, coalesce(arg_min(c_mktsegment, pref) FILTER (pref < 9), min(c_mktsegment)) AS pick FROM (SELECT *, CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 9 END AS pref FROM customer) GROUP BY 1")
def preference_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of a preference list that is there, else any."""
    pref = F.when(F.col("c_mktsegment") == "MACHINERY", 0).when(F.col("c_mktsegment") == "BUILDING", 1)
    rows = table(spark, sf_dir, "customer").withColumn("pref", pref)
    return rows.groupBy("c_nationkey").agg(F.coalesce(F.min_by("c_mktsegment", "pref"), F.min("c_mktsegment")).alias("pick"))


@query(
    "retention_evictions",
    """SELECT o_orderkey, evict FROM (SELECT o_orderkey, total - coalesce(before, 0) > 0.4 * total AS evict FROM (SELECT o_orderkey, sum(o_totalprice::DECIMAL(18, 2)) OVER () AS total,
    sum(o_totalprice::DECIMAL(18, 2)) OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM orders WHERE o_orderstatus = 'F'))""",
)
def retention_evictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oldest first until what is left fits the budget: running sums per day, then within the day, so no task sees all rows."""
    size = F.col("o_totalprice").cast("decimal(18,2)")
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate", size.alias("size"))
    days = rows.groupBy("o_orderdate").agg(F.sum("size").alias("day_size"))
    before_day = F.coalesce(F.sum("day_size").over(Window.orderBy("o_orderdate").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.withColumn("before_day", before_day).withColumn("total", F.sum("day_size").over(Window.partitionBy()))
    within = F.coalesce(F.sum("size").over(Window.partitionBy("o_orderdate").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("within", within).join(days, "o_orderdate").select("o_orderkey", (F.col("total") - F.col("before_day") - F.col("within") > F.col("total") * F.lit(0.4)).alias("evict"))
