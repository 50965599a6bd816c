"""Text and time in the forms that people and files use: durations, timecodes, colours, titles, cleaned fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.scalars import time_offset
from spanloom.registry import query, table

ISO_DURATION = r"^P(?:([0-9]+)D)?T?(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+(?:\.[0-9]+)?)S)?$"
NORM = r"[^\p{L}\p{N}_'%$€£#@+-]"
NO_SPACES = "[぀-ヿ一-鿿฀-๿]"
#: Beginnings of sentences that say nothing about the picture.
FILLERS = ("got it", "let's", "let me", "okay", "so ", "first,", "hmm", "wait")
#: Needles of an error message, permanent ones before transient ones.
ERRORS = (("private", "permanent"), ("not found", "permanent"), ("quota", "transient"), ("timeout", "transient"), ("reset", "transient"))


def iso_seconds(value: Column) -> Column:
    """Seconds of an ISO-8601 duration of days to seconds; null for other texts and for empty ones."""
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(value, ISO_DURATION, k), F.lit("")).try_cast("double"), F.lit(0.0))
    return F.when(value.rlike(ISO_DURATION), part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4))


def two(value: Column) -> Column:
    """A whole number with at least two digits."""
    text = value.cast("bigint").cast("string")
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def centisecond_time(seconds: Column) -> Column:
    """H:MM:SS.cc, halves to the even centisecond, negative times as zero."""
    cs = F.rint(F.greatest(seconds, F.lit(0.0)) * 100).cast("bigint")
    return F.concat_ws(":", F.floor(cs / 360000).cast("string"), two(F.floor(cs % 360000 / 6000)), F.concat(two(F.floor(cs % 6000 / 100)), F.lit("."), two(cs % 100)))


def short_duration(seconds: Column) -> Column:
    """M:SS, or H:MM:SS from an hour on; a dash for null."""
    s = F.greatest(F.floor(seconds + 0.5), F.lit(0)).cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(seconds.isNull(), "—").when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(r))).otherwise(F.concat_ws(":", m.cast("string"), two(r)))


def byte_size(n: Column) -> Column:
    """Bytes in powers of 1024 up to TB: one decimal below 100, none for bytes; 0 B for null."""
    power = lambda k: F.lit(float(1024**k))
    out = F.when(F.coalesce(n, F.lit(0)) == 0, "0 B").when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        v = n / power(k)
        text = F.when(v >= 100, F.format_string("%.0f", F.round(v, 0))).otherwise(F.format_string("%.1f", F.round(v, 1)))
        out = out.when((v < 1024) | F.lit(unit == "TB"), F.concat(text, F.lit(f" {unit}")))
    return out


def abgr(colour: Column, alpha: Column) -> Column:
    """&HAABBGGRR of #RGB or #RRGGBB and a transparency in 0..1."""
    h = F.regexp_replace(colour, "^#+", "")
    h = F.when(F.length(h) == 3, F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)
    a = F.lpad(F.hex(F.least(F.greatest(F.rint(alpha * 255).cast("bigint"), F.lit(0)), F.lit(255))), 2, "0")
    return F.upper(F.concat(F.lit("&H"), a, F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2)))


def headline(text: Column, limit: int = 68) -> Column:
    """First sentence, cut to ``limit`` characters, without blanks, commas and points at its end."""
    return F.regexp_replace(F.substring(F.regexp_replace(F.trim(text), r"(?s)([.!?])\s.*$", "$1"), 1, limit), r"[ ,.]+$", "")


def teaser(text: Column, limit: int = 220) -> Column:
    """The first ``limit`` characters up to their last blank, with an ellipsis."""
    return F.concat(F.regexp_replace(F.substring(text, 1, limit), r"(?s) [^ ]*$", ""), F.lit("…"))


def useful_sentences(text: Column) -> Column:
    """The first two sentences that open with no filler, in 300 characters."""
    parts = F.split(F.regexp_replace(F.trim(text), r"([.!?])\s+", "$1\u0001"), "\u0001")
    kept = F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: (s != "") & ~F.exists(F.array(*[F.lit(p) for p in FILLERS]), lambda p: F.startswith(F.lower(s), p)))
    return F.substring(F.array_join(F.slice(kept, 1, 2), " "), 1, 300)


def error_class(message: Column) -> Column:
    out, low = F.when(F.lit(False), ""), F.lower(message)
    for needle, kind in ERRORS:
        out = out.when(F.contains(low, F.lit(needle)), kind)
    return out.otherwise("unknown")


_ISO = "CASE WHEN event_id % 7 = 3 THEN 'bad' ELSE 'P' || CASE WHEN event_id % 3 = 0 THEN (event_id % 4) || 'D' ELSE '' END || 'T' || (event_id % 24) || 'H' || (event_id % 60) || 'M' || (event_id % 50) || '.5S' END"


@query("iso_duration", f"SELECT event_id, CASE WHEN regexp_matches(v, '{ISO_DURATION}') THEN " + " + ".join(f"coalesce(TRY_CAST(nullif(regexp_extract(v, '{ISO_DURATION}', {k}), '') AS DOUBLE), 0) * {f}" for k, f in ((1, 86400), (2, 3600), (3, 60), (4, 1))) + f" END AS seconds FROM (SELECT event_id, {_ISO} AS v FROM events)")
def iso_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.expr(_ISO).alias("v")).select("event_id", iso_seconds(F.col("v")).alias("seconds"))


_URL = "url || CASE page_id % 4 WHEN 0 THEN '&t=' || page_id || 's' WHEN 1 THEN '&t=1h' || (page_id % 60) || 'm3s' WHEN 2 THEN '&t=' || page_id ELSE '' END"


@query("url_offset", "SELECT page_id, CASE WHEN v = '' THEN NULL WHEN regexp_matches(v, '^[0-9]+$') THEN TRY_CAST(v AS BIGINT) ELSE " + " + ".join(f"coalesce(TRY_CAST(nullif(regexp_extract(v, '([0-9]+){u}', 1), '') AS BIGINT), 0) * {f}" for u, f in (("h", 3600), ("m", 60), ("s", 1))) + f" END AS seconds FROM (SELECT page_id, regexp_extract({_URL}, '[?&#]t=([0-9hms]+)', 1) AS v FROM pages)")
def url_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start offsets in addresses, as bare seconds or in hours, minutes and seconds."""
    return table(spark, sf_dir, "pages").select("page_id", time_offset(F.expr(_URL)).alias("seconds"))


_T = "(event_id % 9000)::DOUBLE + value"


@query(
    "time_formats",
    f"""SELECT event_id, (cs // 360000) || ':' || lpad((cs % 360000 // 6000)::VARCHAR, 2, '0') || ':' || lpad((cs % 6000 // 100)::VARCHAR, 2, '0') || '.' || lpad((cs % 100)::VARCHAR, 2, '0') AS timecode,
    CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') ELSE (s // 60) || ':' || lpad((s % 60)::VARCHAR, 2, '0') END AS duration
    FROM (SELECT event_id, round_even(greatest(t, 0) * 100, 0)::BIGINT AS cs, greatest(floor(t + 0.5), 0)::BIGINT AS s FROM (SELECT event_id, {_T} AS t FROM events))""",
)
def time_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") % 9000).cast("double") + F.col("value")).alias("t"))
    return rows.select("event_id", centisecond_time(F.col("t")).alias("timecode"), short_duration(F.col("t")).alias("duration"))


_BYTES = "(CASE WHEN doc_id % 3 = 0 THEN n_chars ELSE n_chars * doc_id * 1009 END)"


@query("byte_sizes", f"SELECT doc_id, CASE WHEN n = 0 THEN '0 B' WHEN n < 1024 THEN n || ' B' " + " ".join(f"WHEN {'true' if u == 'TB' else f'n / {1024.0**k} < 1024'} THEN CASE WHEN n / {1024.0**k} >= 100 THEN printf('%.0f', round(n / {1024.0**k}, 0)) ELSE printf('%.1f', round(n / {1024.0**k}, 1)) END || ' {u}'" for k, u in enumerate(("KB", "MB", "GB", "TB"), 1)) + f" END AS size FROM (SELECT doc_id, coalesce({_BYTES}, 0)::BIGINT AS n FROM documents)")
def byte_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", byte_size(F.expr(f"CAST(coalesce({_BYTES}, 0) AS BIGINT)")).alias("size"))


@query(
    "caption_colours",
    """SELECT event_id, '&H' || a || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS colour FROM (
    SELECT event_id, CASE WHEN event_id % 4 = 0 THEN regexp_replace(printf('%03X', event_id % 4096), '(.)', '\\1\\1', 'g') ELSE printf('%06X', event_id * 7919 % 16777216) END AS h,
    printf('%02X', round_even((event_id % 11) / 10.0::DOUBLE * 255, 0)::BIGINT) AS a FROM events)""",
)
def caption_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    colour = F.concat(F.lit("#"), F.when(i % 4 == 0, F.lpad(F.hex(i % 4096), 3, "0")).otherwise(F.lpad(F.hex(i * 7919 % 16777216), 6, "0")))
    return table(spark, sf_dir, "events").select("event_id", abgr(colour, (i % 11) / F.lit(10.0)).alias("colour"))


@query("headlines", r"SELECT item_id, regexp_replace(substr(regexp_replace(trim(text), '(?s)([.!?])\s.*$', '\1'), 1, 68), '[ ,.]+$', '') AS title, regexp_replace(substr(text, 1, 220), '(?s) [^ ]*$', '') || '…' AS teaser FROM benchmark")
def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and teaser of every item: the cuts are the feature."""
    return table(spark, sf_dir, "benchmark").select("item_id", headline(F.col("text")).alias("title"), teaser(F.col("text")).alias("teaser"))


@query("useful_sentences", r"SELECT conv_id, turn, substr(array_to_string(list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '' AND NOT (" + " OR ".join(f"starts_with(lower(s), '{p.replace(chr(39), chr(39) * 2)}')" for p in FILLERS) + "))[1:2], ' '), 1, 300) AS summary FROM conversations")
def useful_sentences_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", useful_sentences(F.col("text")).alias("summary"))


@query("word_norms", f"SELECT n, count(*) AS uses FROM (SELECT regexp_replace(lower(unnest(string_split(text, ' '))), '{NORM.replace(chr(39), chr(39) * 2)}', '', 'g') AS n FROM conversations) WHERE n <> '' GROUP BY 1")
def word_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of each word without its punctuation."""
    words = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", " ")).alias("w")).select(F.regexp_replace(F.lower("w"), NORM, "").alias("n"))
    return words.where("n <> ''").groupBy("n").agg(F.count("*").alias("uses"))


@query("unspaced_scripts", f"SELECT lang, count(*) FILTER (regexp_matches(t, '{NO_SPACES}')) AS unspaced, count(*) AS n FROM (SELECT lang, coalesce(text, '') || CASE doc_id % 5 WHEN 0 THEN '語' WHEN 1 THEN 'ไทย' ELSE '' END AS t FROM documents) GROUP BY 1")
def unspaced_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with characters of scripts that write no spaces."""
    t = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 5 == 0, "語").when(F.col("doc_id") % 5 == 1, "ไทย").otherwise(""))
    return table(spark, sf_dir, "documents").select("lang", t.alias("t")).groupBy("lang").agg(F.count_if(F.col("t").rlike(NO_SPACES)).alias("unspaced"), F.count("*").alias("n"))


@query("subtitle_text", r"SELECT page_id, md5(replace(replace(replace(replace(html, chr(92), chr(92) || chr(92)), '{', '('), '}', ')'), chr(10), ' ')) AS escaped, md5(substr(replace(replace(html, '<', ''), '>', ''), 1, 4900)) AS description FROM pages")
def subtitle_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as subtitle text, with its signs escaped, and as an upload's description without angle brackets."""
    plain = F.lit("\\"), F.lit("\\\\")
    text = F.replace(F.replace(F.replace(F.replace(F.col("html"), *plain), F.lit("{"), F.lit("(")), F.lit("}"), F.lit(")")), F.lit("\n"), F.lit(" "))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text).alias("escaped"), F.md5(F.substring(F.translate("html", "<>", ""), 1, 4900)).alias("description"))


_MESSAGE = "CASE event_id % 6 WHEN 0 THEN 'Video is PRIVATE, quota left' WHEN 1 THEN 'quota used up' WHEN 2 THEN 'read timeout' WHEN 3 THEN 'Not Found' WHEN 4 THEN 'Connection reset' ELSE 'odd ' || event_type END"


@query("error_classes", "SELECT kind, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN contains(lower(m), '{p}') THEN '{k}'" for p, k in ERRORS) + f" ELSE 'unknown' END AS kind FROM (SELECT {_MESSAGE} AS m FROM events)) GROUP BY 1")
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(error_class(F.expr(_MESSAGE)).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))
