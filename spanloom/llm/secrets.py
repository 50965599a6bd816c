"""Operator 1: secret scan with corpus-wide ownership frequency.

Every text is scanned once with built-in regex functions for credential candidates: assignments, access
keys, long hex runs, and (the method's own kind) long mixed tokens. Each candidate's value is hashed and
the hashes are counted over the whole corpus by distinct repositories and owners. A value that several
owners hold, or one owner in many repositories, is a widely copied example; a value of one owner in few repositories that looks random is live-looking. Base
spans always stay; mixed tokens are reported only if they are live-looking and overlap no base span.

Counting is two-level: occurrences are first reduced to distinct (hash, repository, owner), on the map side
too, so a value copied millions of times costs one row per repository. Texts are read once and never
shuffled; the candidate table is written to the shared folder and read by both later steps.

Defined results: null or empty texts have no spans; a null repository or owner counts as one of its own;
repeated rows each get their own result; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import materialise, table, whole_text
from spanloom.llm.spans import any_case, count_kind, digest_text, matches

KINDS = ("assign", "access", "hex", "mixed")
N_BASE = 3
NAMES = "|".join([any_case("password"), any_case("passwd"), any_case("secret"), any_case("token"), any_case("api") + "_?" + any_case("key")])
ASSIGN = "(" + NAMES + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
MIXED = r"[A-Za-z0-9_-]{24,}"
COPIED_OWNERS = 3
COPIED_REPOSITORIES = 4
SALTS = 16


def candidate_spans(text: Column) -> Column:
    """array<struct<kind, start, end, secret>> of base candidates and mixed tokens."""
    # A run of [0-9a-f] is one match whatever its length, so asking for 32 finds the same runs.
    found = (
        F.filter(matches(text, ASSIGN, 2), lambda m: F.length(m["part"]) >= 8),
        F.filter(matches(text, ACCESS), lambda m: F.length(m["value"]) >= 16),
        matches(text, HEX),
        F.filter(matches(text, MIXED), lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[a-z]") & m["value"].rlike("[A-Z]")),
    )

    def shaped(k: int) -> Column:
        return F.transform(found[k], lambda m: F.struct(F.lit(k).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["part"].alias("secret")))

    return F.concat(*[shaped(k) for k in range(len(KINDS))])


def looks_random(secret: Column) -> Column:
    """Digits and letters mixed, and no character makes up more than half of it."""
    most = F.array_max(F.transform(F.array_distinct(F.split(secret, "")), lambda c: F.length(secret) - F.length(F.replace(secret, c, F.lit("")))))
    return secret.rlike("[0-9]") & secret.rlike("[A-Za-z]") & (most * 2 <= F.length(secret))


def scan_secrets(docs: DataFrame, repository: Column, owner: Column, copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> tuple[DataFrame, DataFrame]:
    """(per document: doc_id and spans with their verdict; per secret hash: repositories, owners, verdict)."""
    rows = docs.select("doc_id", repository.cast("string").alias("repository"), owner.cast("string").alias("owner"), candidate_spans(whole_text()).alias("found"))
    hashed = F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.sha2(s["secret"], 256).alias("hash"), looks_random(s["secret"]).alias("random")))
    rows = materialise(rows.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "repository", "owner", hashed.alias("found")), "secret-candidates")
    seen = rows.select("row_id", "repository", "owner", F.inline("found"))
    held = seen.select("hash", "random", "repository", "owner").distinct()
    # Null repositories and owners count as one value each.
    value = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    counts = held.groupBy("hash").agg(F.count_distinct(value(F.col("repository"))).alias("repositories"), F.count_distinct(value(F.col("owner"))).alias("owners"), F.bool_or("random").alias("random"))
    verdict = F.when((F.col("owners") >= copied_owners) | (F.col("repositories") >= copied_repositories), "copied").when((F.col("owners") == 1) & F.col("random"), "live").otherwise("shared")
    counts = counts.withColumn("verdict", verdict)
    # A widely copied value would send all its rows to one task: rows are salted, and its verdict is there once a salt.
    salted = F.pmod(F.xxhash64("row_id"), F.lit(SALTS))
    told = counts.select("hash", "verdict", "repositories", "owners", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    judged = seen.withColumn("salt", salted.cast("int")).join(told, ["hash", "salt"])
    judged = judged.groupBy("row_id").agg(F.collect_list(F.struct("start", "kind", "end", "hash", "verdict", "repositories", "owners")).alias("judged"))
    base = F.filter("judged", lambda s: s["kind"] < N_BASE)
    extra = F.filter("judged", lambda s: (s["kind"] >= N_BASE) & (s["verdict"] == "live") & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,hash:string,verdict:string,repositories:bigint,owners:bigint>>")
    out = rows.select("row_id", "doc_id").join(judged, "row_id", "left").withColumn("judged", F.coalesce("judged", none))
    return out.select("doc_id", F.array_sort(F.concat(base, extra)).alias("spans")), counts


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source counts as owner, and its documents of one language as one of its repositories."""
    docs = table(spark, sf_dir, "documents")
    found, _ = scan_secrets(docs, F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-"))), F.col("source"))
    base = F.filter("spans", lambda s: s["kind"] < N_BASE)
    most = lambda c: F.coalesce(F.array_max(F.transform("spans", lambda s: s[c])), F.lit(0)).cast("long")
    live = lambda v: F.size(F.filter("spans", lambda s: s["verdict"] == v)).cast("long")
    return found.select(
        "doc_id", count_kind(base, 0).alias("n_assign"), count_kind(base, 1).alias("n_access"), count_kind(base, 2).alias("n_hex"),
        F.sha2(digest_text(base, KINDS), 256).alias("base_sha256"), digest_text(F.col("spans"), KINDS).alias("spans"),
        live("live").alias("n_live"), live("copied").alias("n_copied"), most("owners").alias("most_owners"), most("repositories").alias("most_repositories"),
    )


def _sql_matches(name: str, pattern: str, part: int, kind: int, keep: str) -> str:
    p = pattern.replace("'", "''")
    return f"""
    {name} AS (
      SELECT rid, doc_id, repo, owner, {kind} AS kind, start, start + length(v) AS stop, g AS secret FROM (
        SELECT rid, doc_id, repo, owner, unnest(vs) AS v, unnest(gs) AS g,
          unnest(list_transform(range(1, len(vs) + 1), lambda i: list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(vs[1:i - 1], lambda x: length(x))), 0))) AS start
        FROM (SELECT rid, doc_id, repo, owner, regexp_extract_all(t, '{p}', 0) AS vs, regexp_extract_all(t, '{p}', {part}) AS gs, string_split_regex(t, '{p}') AS ps FROM d WHERE regexp_matches(t, '{p}'))
      ) WHERE {keep}
    )"""


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '-') || '/' || coalesce(lang, '-') AS repo, source AS owner FROM documents),
{_sql_matches("m0", ASSIGN, 2, 0, "length(g) >= 8")}, {_sql_matches("m1", ACCESS, 0, 1, "length(v) >= 16")}, {_sql_matches("m2", HEX, 0, 2, "true")},
{_sql_matches("m3", MIXED, 0, 3, "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')")},
m AS (SELECT * FROM m0 UNION ALL SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3),
looks AS (SELECT *, regexp_matches(secret, '[0-9]') AND regexp_matches(secret, '[A-Za-z]') AND
  2 * list_max(list_transform(list_distinct(string_split(secret, '')), lambda c: length(secret) - length(replace(secret, c, '')))) <= length(secret) AS random FROM m),
counts AS (SELECT secret, count(DISTINCT coalesce('=' || owner, '')) AS owners, count(DISTINCT repo) AS repos, bool_or(random) AS random FROM looks GROUP BY secret),
judged AS (SELECT l.*, c.owners, c.repos, CASE WHEN c.owners >= {COPIED_OWNERS} OR c.repos >= {COPIED_REPOSITORIES} THEN 'copied' WHEN c.owners = 1 AND c.random THEN 'live' ELSE 'shared' END AS verdict FROM looks l JOIN counts c USING (secret)),
kept AS (SELECT *, ['assign', 'access', 'hex', 'mixed'][kind + 1] || ':' || start || ':' || stop AS s FROM judged j
  WHERE kind < 3 OR (verdict = 'live' AND NOT EXISTS (SELECT 1 FROM judged b WHERE b.rid = j.rid AND b.kind < 3 AND b.start < j.stop AND j.start < b.stop)))
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(s, ',' ORDER BY start, kind, stop) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY start, kind, stop), '') AS spans,
  count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'copied') AS n_copied,
  coalesce(max(owners), 0) AS most_owners, coalesce(max(repos), 0) AS most_repositories
FROM d LEFT JOIN kept USING (rid) GROUP BY d.rid, d.doc_id
"""
