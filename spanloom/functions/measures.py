"""Numbers, arrays, maps and JSON records: curves, similarity of vectors, boxes and fingerprints, blended maps, tolerant parsing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.registry import query, table


def logistic(x: Column, centre: float, scale: float) -> Column:
    return 1.0 / (1.0 + F.exp(-(x - centre) / scale))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision, the longer one cut; 0 if one has no length."""
    n = F.least(F.size(a), F.size(b))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)
    dot = total(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda x: F.sqrt(total(F.transform(x, lambda v: v.cast("double") * v.cast("double"))))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def rescaled(similarity: Column) -> Column:
    """What is above 0.75, stretched to 0..1."""
    return F.greatest((similarity - 0.75) / 0.25, F.lit(0.0))


def box_iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Common area of two boxes (x, y, w, h) as a share of the area of both."""
    side = lambda at, size: F.greatest(F.least(a[at] + a[size], b[at] + b[size]) - F.greatest(a[at], b[at]), F.lit(0.0))
    common = side("x", "w") * side("y", "h")
    union = a["w"] * a["h"] + b["w"] * b["h"] - common
    return F.when(union > 0, common / union).otherwise(0.0)


def smoother(u: Column) -> Column:
    """Smootherstep: no speed and no acceleration at either end."""
    u = F.least(F.greatest(u, F.lit(0.0)), F.lit(1.0))
    return u * u * u * (u * (u * 6 - 15) + 10)


def length_bucket(seconds: Column) -> Column:
    out = F.when(F.lit(False), "")
    for low, high in ((0, 20), (20, 30), (30, 40), (40, 50), (50, 60)):
        out = out.when((seconds >= low) & (seconds < high), f"{low}-{high}s")
    return out.otherwise("60s+")


def fingerprint_similarity(a: Column, b: Column, reach: int = 3, bits: int = 10) -> Column:
    """Largest share, over shifts up to ``reach``, of places whose hashes differ in at most ``bits`` bits; 0 without places."""
    n = F.least(F.size(a), F.size(b))

    def at_shift(shift: int) -> Column:
        first, last = F.greatest(F.lit(1), F.lit(1 - shift)), F.least(n, F.size(b) - shift)
        places = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        good = F.filter(places, lambda i: F.bit_count(F.element_at(a, i).bitwiseXOR(F.element_at(b, i + shift))) <= bits)
        return F.coalesce(F.try_divide(F.size(good), F.size(places)), F.lit(0.0))

    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.greatest(*[at_shift(s) for s in range(-reach, reach + 1)]))


@query("curves", "SELECT event_id, round(1 / (1 + exp(-(value - 50) / 12.5::DOUBLE)), 6) AS logistic, round(u * u * u * (u * (u * 6 - 15) + 10), 6) AS smoother, round(1 - (1 - u) * (1 - u) * (1 - u), 6) AS ease_out, round(u * u * u, 6) AS ease_in FROM (SELECT event_id, value, least(greatest((event_id % 130 - 15) / 100::DOUBLE, 0), 1) AS u FROM events)")
def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = (F.col("event_id") % 130 - 15) / F.lit(100.0)
    u = F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))
    return table(spark, sf_dir, "events").select("event_id", F.round(logistic(F.col("value"), 50.0, 12.5), 6).alias("logistic"), F.round(smoother(raw), 6).alias("smoother"), F.round(1 - (1 - u) * (1 - u) * (1 - u), 6).alias("ease_out"), F.round(u * u * u, 6).alias("ease_in"))


@query("cosine_dup", "SELECT vec_id, round(s, 6) AS cosine, round(greatest((s - 0.75) / 0.25, 0), 6) AS scaled FROM (SELECT a.vec_id, coalesce(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0) AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)")
def cosine_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the next one: cosine, and rescaled as a duplicate's score."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pairs = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    s = cosine(F.col("embedding"), F.col("other"))
    return pairs.select("vec_id", s.alias("s")).select("vec_id", F.round("s", 6).alias("cosine"), F.round(rescaled(F.col("s")), 6).alias("scaled"))


_BOX = {"x": "l_quantity % 10", "y": "(l_linenumber % 4)::DOUBLE", "w": "1 + l_quantity % 7", "h": "1 + (l_partkey % 5)::DOUBLE"}


@query(
    "box_overlap",
    f"""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, {', '.join(f'{e} AS {c}' for c, e in _BOX.items())} FROM lineitem), p AS (
    SELECT *, {', '.join(f'lag({c}) OVER k AS p{c}' for c in _BOX)} FROM b WINDOW k AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate)),
    i AS (SELECT *, greatest(least(x + w, px + pw) - greatest(x, px), 0) * greatest(least(y + h, py + ph) - greatest(y, py), 0) AS c FROM p WHERE px IS NOT NULL)
    SELECT l_orderkey, round(sum(CASE WHEN w * h + pw * ph - c > 0 THEN c / (w * h + pw * ph - c) ELSE 0 END), 5) AS iou, count(*) AS n FROM i GROUP BY 1""",
)
def box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of each box with the one before it in its group."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", *[F.expr(e.replace("::DOUBLE", "")).cast("double").alias(c) for c, e in _BOX.items()])
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    rows = rows.select("*", *[F.lag(c).over(order).alias(f"p{c}") for c in _BOX]).where("px IS NOT NULL")
    iou = box_iou({c: F.col(c) for c in _BOX}, {c: F.col(f"p{c}") for c in _BOX})
    return rows.groupBy("l_orderkey").agg(F.round(F.sum(iou), 5).alias("iou"), F.count("*").alias("n"))


@query("loudness", "SELECT user_id, event_id // 512 AS hop, round(20 * log10(greatest(sqrt(avg(value * value / 40000) + 1e-12), 1e-9)), 4) AS dbfs FROM events GROUP BY 1, 2")
def loudness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level of each hop in dB of full scale."""
    rms = F.sqrt(F.avg(F.col("value") * F.col("value") / 40000) + 1e-12)
    return table(spark, sf_dir, "events").groupBy("user_id", F.floor(F.col("event_id") / 512).cast("bigint").alias("hop")).agg(F.round(20 * F.log10(F.greatest(rms, F.lit(1e-9))), 4).alias("dbfs"))


@query("adjusted_views", f"SELECT doc_id, round(ln(1 + n_chars) / ln(greatest({math.e}, doc_id % 90 + {math.e})), 6) AS score FROM documents")
def adjusted_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views on a log scale, divided by the log of their age in days."""
    return table(spark, sf_dir, "documents").select("doc_id", F.round(F.log1p("n_chars") / F.ln(F.greatest(F.col("doc_id") % 90 + math.e, F.lit(math.e))), 6).alias("score"))


@query("length_buckets", "SELECT bucket, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN s >= {a} AND s < {b} THEN '{a}-{b}s'" for a, b in ((0, 20), (20, 30), (30, 40), (40, 50), (50, 60))) + " ELSE '60s+' END AS bucket FROM (SELECT event_id % 75 AS s FROM events)) GROUP BY 1")
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(length_bucket(F.col("event_id") % 75).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query(
    "crop_centres",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(cw, 6) AS width, round(least(1 - least(0.5, cw / 2), greatest(least(0.5, cw / 2), cx)), 6) AS centre FROM (
    SELECT *, CASE WHEN sw / sh > 0.5625 THEN (sh * 0.5625 / zoom) / sw ELSE 1 / zoom END AS cw FROM (
    SELECT l_orderkey, l_linenumber, l_partkey, (640 + l_orderkey % 1280)::DOUBLE AS sw, (360 + l_partkey % 1600)::DOUBLE AS sh, 1 + (l_linenumber % 4) / 4::DOUBLE AS zoom, (l_suppkey % 11) / 10::DOUBLE AS cx FROM lineitem))""",
)
def crop_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width of an upright crop and its centre, kept inside the picture."""
    sw, sh, zoom = (640 + F.col("l_orderkey") % 1280).cast("double"), (360 + F.col("l_partkey") % 1600).cast("double"), 1 + (F.col("l_linenumber") % 4) / F.lit(4.0)
    width = F.when(sw / sh > 0.5625, (sh * 0.5625 / zoom) / sw).otherwise(1 / zoom)
    half, cx = F.least(F.lit(0.5), F.col("cw") / 2), (F.col("l_suppkey") % 11) / F.lit(10.0)
    rows = table(spark, sf_dir, "lineitem").withColumn("cw", width)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round("cw", 6).alias("width"), F.round(F.least(1 - half, F.greatest(half, cx)), 6).alias("centre"))


@query(
    "fingerprint_dup",
    """WITH s AS (SELECT user_id, list(event_id * 2654435761 % 4294967296 ORDER BY event_id) AS f FROM events GROUP BY 1), p AS (SELECT a.user_id, a.f AS a, b.f AS b, least(len(a.f), len(b.f)) AS n FROM s a JOIN s b ON b.user_id = a.user_id + 1)
    SELECT user_id, round(max(CASE WHEN places > 0 THEN good / places::DOUBLE ELSE 0 END), 6) AS similarity FROM (
    SELECT user_id, greatest(least(n, len(b) - k) - greatest(1, 1 - k) + 1, 0) AS places, len(list_filter(range(greatest(1, 1 - k), least(n, len(b) - k) + 1), lambda i: bit_count(xor(a[i], b[i + k])) <= 10)) AS good FROM p, (SELECT unnest(range(-3, 4)) AS k)) GROUP BY 1""",
)
def fingerprint_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each user's sequence of hashes to the next user's, over small shifts."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", (F.col("event_id") * 2654435761 % 4294967296).alias("f")))).alias("s"))
    rows = rows.select("user_id", F.transform("s", lambda x: x["f"]).alias("a"))
    pairs = rows.join(rows.select((F.col("user_id") - 1).alias("user_id"), F.col("a").alias("b")), "user_id")
    return pairs.select("user_id", F.round(fingerprint_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(
    "blended_maps",
    """WITH g AS (SELECT event_type AS k, avg(value) AS v FROM events GROUP BY 1), u AS (SELECT user_id, event_type AS k, avg(value) AS v FROM events WHERE event_type <> 'view' GROUP BY 1, 2), ids AS (SELECT DISTINCT user_id FROM u)
    SELECT user_id, k, round(CASE WHEN u.v IS NULL THEN g.v ELSE 0.35 * g.v + 0.65 * u.v END, 5) AS v FROM ids CROSS JOIN g LEFT JOIN u USING (user_id, k)""",
)
def blended_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's map over the map of all: shared keys blend 0.65 to 0.35, others keep the default."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("k"), "value")
    as_map = lambda df: F.map_from_entries(F.collect_list(F.struct("k", "v")))
    default = rows.groupBy("k").agg(F.avg("value").alias("v")).agg(as_map(rows).alias("d"))
    own = rows.where("k <> 'view'").groupBy("user_id", "k").agg(F.avg("value").alias("v")).groupBy("user_id").agg(as_map(rows).alias("m"))
    both = own.join(F.broadcast(default)).select("user_id", F.map_zip_with("m", "d", lambda k, a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(0.35 * b + 0.65 * a)).alias("z"))
    return both.select("user_id", F.explode("z").alias("k", "v")).select("user_id", "k", F.round("v", 5).alias("v"))


_ANSWER = "CASE event_id % 5 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN '<think>{maybe}</think> ' || props WHEN 2 THEN 'Here: ' || props || ' done' WHEN 3 THEN 'nothing' ELSE props END"


def json_object(text: Column) -> Column:
    """The JSON object in an answer: fences and reasoning go; else what stands from the first to the last brace."""
    text = F.regexp_replace(F.trim(text), r"^```(?:json)?\s*|\s*```$", "")
    text = F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))
    return F.when(text.startswith("{") & text.endswith("}"), text).otherwise(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")))


@query("tolerant_json", rf"SELECT event_id, least(greatest(coalesce(TRY_CAST(json_extract_string(nullif(regexp_extract(t, '(?s)\{{.*\}}'), ''), '$.k') AS BIGINT), 50), 0), 100) AS k, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS kind FROM (SELECT event_id, event_type, trim(regexp_replace(regexp_replace(trim({_ANSWER}), '^```(?:json)?\s*|\s*```$', '', 'g'), '(?s)<think>.*?</think>', '', 'g')) AS t FROM events)")
def tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records out of loosely written answers: numbers kept in 0..100 with default 50, unknown kinds as other."""
    k = F.coalesce(F.get_json_object(json_object(F.expr(_ANSWER)), "$.k").try_cast("bigint"), F.lit(50))
    return table(spark, sf_dir, "events").select("event_id", F.least(F.greatest(k, F.lit(0)), F.lit(100)).alias("k"), F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).otherwise("other").alias("kind"))


@query(
    "series_slices",
    """WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)
    SELECT user_id, round(sum(value) FILTER (i % 2 = 1), 3) AS every_second, round(avg(value) FILTER (i BETWEEN 3 AND 12), 5) AS mean, CASE WHEN count(*) FILTER (i BETWEEN 3 AND 12) > 4 THEN round(stddev_pop(value) FILTER (i BETWEEN 3 AND 12), 5) END AS deviation, round(quantile_cont(value, 0.9) FILTER (i BETWEEN 3 AND 12), 5) AS p90, max(value) FILTER (i BETWEEN 3 AND 12) AS top FROM s GROUP BY 1""",
)
def series_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's series: every second sample, and statistics of a range of places."""
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, sf_dir, "events").select("user_id", "value", i.alias("i"))
    x = F.when(F.col("i").between(3, 12), F.col("value"))
    deviation = F.when(F.count(x) > 4, F.round(F.stddev_pop(x), 5))
    return rows.groupBy("user_id").agg(F.round(F.sum(F.when(F.col("i") % 2 == 1, F.col("value"))), 3).alias("every_second"), F.round(F.avg(x), 5).alias("mean"), deviation.alias("deviation"), F.round(F.percentile(x, F.lit(0.9)), 5).alias("p90"), F.max(x).alias("top"))
