"""Data quality: a rule engine of issues per row, its roll-up, and duplicates by content hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.registry import query, table

LEVELS = ("PASS", "WARNING", "FAIL")
Rule = tuple[str, int, Column, str]

#: check name, level, condition in both dialects, repair
RULES = (
    ("empty", 2, "coalesce(trim(text), '') = ''", "drop"),
    ("too_short", 1, "n_chars < 200", "merge"),
    ("too_long", 1, "n_chars > 20000", "split"),
    ("length_differs", 2, "abs(n_chars - length(text)) > greatest(3, 0.03 * n_chars)", "recount"),
    ("no_language", 1, "coalesce(lang, '') = ''", "detect"),
    ("secret", 2, "coalesce(lower(text), '') LIKE '%password%'", "redact"),
)


def issues(rules: Sequence[Rule]) -> Column:
    """array<struct<check, level, repair>> of the rules that a row breaks; an unknown condition is no issue."""
    found = [F.when(F.coalesce(rule, F.lit(False)), F.struct(F.lit(name).alias("check"), F.lit(level).alias("level"), F.lit(repair).alias("repair"))) for name, level, rule, repair in rules]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def status(found: Column) -> Column:
    """Worst level by name."""
    return F.element_at(F.array(*map(F.lit, LEVELS)), F.coalesce(F.array_max(F.transform(found, lambda x: x["level"])), F.lit(0)) + 1)


def repairs(found: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["repair"]))), ",")


_HITS = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS \"check\", {lv} AS level, '{r}' AS repair FROM documents WHERE coalesce({c}, false)" for n, lv, c, r in RULES)


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("issues", issues([(n, lv, F.expr(c), r) for n, lv, c, r in RULES]))


@query("quality_issues", f"SELECT doc_id, \"check\", level, repair FROM ({_HITS})")
def quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, sf_dir).select("doc_id", F.inline("issues"))


@query("quality_rollup", f"SELECT d.doc_id, ['PASS', 'WARNING', 'FAIL'][coalesce(max(h.level), 0) + 1] AS status, coalesce(string_agg(DISTINCT h.repair, ',' ORDER BY h.repair), '') AS repairs FROM documents d LEFT JOIN ({_HITS}) h USING (doc_id) GROUP BY 1")
def quality_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, sf_dir).select("doc_id", status(F.col("issues")).alias("status"), repairs(F.col("issues")).alias("repairs"))


@query("content_hash_dups", "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("digest"))
    return rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


# ---- analysis logs --------------------------------------------------------------------------------
def log_facts(rows: DataFrame, key: str, log: str) -> DataFrame:
    """(key, black, frozen, loudness, peak, max_volume, mean_volume) from the text of a media analysis: seconds in all, and levels of its last summary.

    ``black`` adds spans of black pictures, ``frozen`` durations of still ones; a level that is not there, or is minus infinity, is null.
    """
    text = F.coalesce(F.col(log), F.lit(""))
    numbers = lambda form, k: F.transform(F.regexp_extract_all(text, F.lit(form), F.lit(k)), lambda x: x.try_cast("double"))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda acc, x: F.round(acc + F.coalesce(x, F.lit(0.0)), 9))  # decimals add up without a trace of their order
    spans = r"black_start:([0-9.]+) black_end:([0-9.]+) black_duration:[0-9.]+"
    black = F.zip_with(numbers(spans, 1), numbers(spans, 2), lambda a, b: b - a)
    starts, still = numbers(r"freeze_start: ([0-9.]+)", 1), numbers(r"freeze_duration: ([0-9.]+)", 1)
    summary = F.when(F.contains(text, F.lit("Summary:")), F.element_at(F.split(text, "Summary:"), -1)).otherwise("")
    level = lambda source, form: F.nullif(F.regexp_extract(source, form, 1), F.lit("")).try_cast("double")
    return rows.select(
        key, total(black).alias("black"), total(F.slice(still, F.lit(1), F.least(F.size(starts), F.size(still)))).alias("frozen"), level(summary, r"I:\s+(-?[0-9.]+) LUFS").alias("loudness"),
        level(summary, r"Peak:\s+(-?[0-9.]+) dBFS").alias("peak"), level(text, r"max_volume: (-?[0-9.]+) dB").alias("max_volume"), level(text, r"mean_volume: (-?[0-9.]+) dB").alias("mean_volume"),
    )


MEDIA_RULES = (
    ("black_frames", 2, "round(black, 6) > 0.3 * duration", "rerender"),
    ("some_black", 1, "black > 0 AND round(black, 6) <= 0.3 * duration", ""),
    ("frozen_frames", 1, "frozen > 3", ""),
    ("no_loudness", 2, "loudness IS NULL", "fix_audio"),
    ("loudness", 1, "abs(loudness + 14) > 3", "fix_audio"),
    ("clipping", 1, "peak > -0.5", "fix_audio"),
    ("silent", 2, "mean_volume < -50", "fix_audio"),
)
_MEDIA = """(SELECT o_orderkey, o_custkey % 60 + 10 AS duration, coalesce(sum(b - a) FILTER (l_linenumber % 3 = 1), 0) AS black, coalesce(sum(l_quantity / 10) FILTER (l_linenumber % 3 = 2), 0) AS frozen, CASE WHEN o_orderkey % 7 > 0 THEN -10 - (o_orderkey % 9)::DOUBLE END AS loudness, 0 - (o_orderkey % 4)::DOUBLE / 4 AS peak,
  0 - (o_custkey % 70)::DOUBLE AS mean_volume FROM orders JOIN (SELECT *, l_linenumber::DOUBLE AS a, l_linenumber + l_quantity / 10 AS b FROM lineitem) ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey)"""


@query("media_logs", f"SELECT o_orderkey, round(black, 3) AS black, round(frozen, 3) AS frozen, loudness, peak, mean_volume, CASE coalesce(list_max([{', '.join(f'CASE WHEN {c} THEN {lv} END' for _, lv, c, _ in MEDIA_RULES)}]), 0) WHEN 0 THEN 'PASS' WHEN 1 THEN 'WARNING' ELSE 'FAIL' END AS status FROM {_MEDIA}")
def media_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs written for every order from its lines, read back as facts and judged by rules."""
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    decimal = lambda x: F.format_string("%.3f", x)
    line = F.when(n % 3 == 1, F.concat(F.lit("[blackdetect] black_start:"), n.cast("string"), F.lit(" black_end:"), decimal(n + q / 10), F.lit(" black_duration:"), decimal(q / 10)))
    line = line.when(n % 3 == 2, F.concat(F.lit("freeze_start: "), n.cast("string"), F.lit("\nfreeze_duration: "), decimal(q / 10))).otherwise("frame= 1 fps=0")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("x")))), lambda s: s["x"]), "\n").alias("lines"))
    k = F.col("o_orderkey")
    tail = F.concat(
        F.lit("\nmean_volume: "), (-(F.col("o_custkey") % 70)).cast("string"), F.lit(".0 dB\nSummary:\n  I:         "), F.when(k % 7 > 0, F.concat((-10 - k % 9).cast("string"), F.lit(".0"))).otherwise("-inf"), F.lit(" LUFS\n  Peak:       "),
        F.format_string("%.2f", -(k % 4) / 4), F.lit(" dBFS"),
    )
    logs = table(spark, sf_dir, "orders").join(lines, "o_orderkey").select("o_orderkey", (F.col("o_custkey") % 60 + 10).alias("duration"), F.concat("lines", tail).alias("log"))
    facts = log_facts(logs, "o_orderkey", "log").join(logs.select("o_orderkey", "duration"), "o_orderkey")
    rules = [(name, level, F.expr(c), repair) for name, level, c, repair in MEDIA_RULES]
    return facts.select("o_orderkey", F.round("black", 3).alias("black"), F.round("frozen", 3).alias("frozen"), "loudness", "peak", "mean_volume", status(issues(rules)).alias("status"))
