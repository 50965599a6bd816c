"""Scalar functions: source classification, address parts, time offsets and tolerant JSON."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.registry import query, table


def host_of(url: Column) -> Column:
    """Lower-case host without port and leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1)), r"^www\.", "")


def classify(url: Column, hosts: Mapping[str, str]) -> Column:
    """Kind of a source by the ending of its host; 'other' for unknown hosts and 'invalid' without one."""
    host = host_of(url)
    out = F.when(host == "", "invalid")
    for suffix, kind in hosts.items():
        out = out.when(host.endswith(suffix), kind)
    return out.otherwise("other")


def time_offset(url: Column) -> Column:
    """Seconds of a t= parameter written as 90, 90s or 1h2m3s; null without one."""
    value = F.coalesce(F.regexp_extract(url, r"[?&#]t=([0-9hms]+)", 1), F.lit(""))
    part = lambda unit: F.coalesce(F.regexp_extract(value, f"([0-9]+){unit}", 1).try_cast("bigint"), F.lit(0))
    return F.when(value == "", None).when(value.rlike("^[0-9]+$"), value.try_cast("bigint")).otherwise(part("h") * 3600 + part("m") * 60 + part("s"))


HOSTS = {"example.org": "organisation", "example.com": "company", "example.net": "network"}


@query("source_classifier", "SELECT page_id, CASE WHEN h = '' THEN 'invalid' " + " ".join(f"WHEN suffix(h, '{s}') THEN '{k}'" for s, k in HOSTS.items()) + r" ELSE 'other' END AS kind FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1)), '^www\.', '') AS h FROM pages)")
def source_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", classify(F.col("url"), HOSTS).alias("kind"))


@query("props_extract", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))
