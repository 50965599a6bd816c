"""Operator 13: Merkle manifest of a table, with a proof for every row.

Leaves are hashed in the JVM and written without texts. An RDD of them, range-sorted by group and order with a unique last key (so ties
split over partitions like any rows), tells each partition how many leaves of its first group lie before it and how many
its first and last group have in all: one small row a partition. With these offsets a partition knows the global index of each of its leaves, builds
every aligned subtree whose leaves it holds, and keeps each leaf's siblings inside it. What cannot be finished is ragged: at most
two nodes a level and partition. They are shuffled by coordinate (group, index of their ancestor at a given height) and completed there; each
round raises the height by ``ROUND`` levels, so a task sees some thousand nodes at most, whatever a group's size.

The same tree over the groups' roots gives the table's root. Paths of ragged nodes get the groups' paths behind them, then meet
the leaves by coordinate, never by group. A level's path entry is what stands left and right of the node when it is hashed; a node
alone in its run has both empty. Proof digests and the fold of each (tampered) leaf are JVM expressions over the path.

Defined results: nulls in any column are hashed as ``-``; ties in doc_id ascend by leaf; null ids come first and are never tampered with;
repeated rows are leaves each; a group of one leaf is its own root; an empty table has no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import materialise, table
from spanloom.llm.merkle import climb, complete, height, partition_facts

FIRST, ROUND = 12, 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<l:string,r:string>>"


def leaf_digest(values: dict[str, Column]) -> Column:
    """H of the row's fields in their order: ``-`` for null, else UTF-8 byte count, colon and value."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values.values()]), 256)


# ---- one tree a group -----------------------------------------------------------------------------
def trees(leaves: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leaves, node paths, roots) of one tree a value of ``group`` over ``leaves``, whose column ``digest`` has the leaves' digests.

    Leaves: all columns, path (entries below the node they end in) and that node's level and idx. Node paths: node_group, node_level,
    node_idx, up (entries from there to the root). Roots: root_group, root.
    """
    spark = leaves.sparkSession
    names = leaves.columns
    at_group, at_digest, at_order = names.index(group), names.index("digest"), [names.index(c) for c in order]

    def keyed(pair: tuple) -> tuple:
        row, unique = pair
        own = [(row[i] is not None, row[i] if row[i] is not None else 0) for i in (at_group, *at_order)]
        return (*own, row[at_digest], unique), tuple(row)

    rows = leaves.rdd
    parts = max(rows.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.zipWithUniqueId().map(keyed).sortByKey(numPartitions=parts).values()

    def facts_of(part: int, found: Iterator[tuple]) -> Iterator[tuple]:
        runs, most = [], 0
        for g, own in groupby(found, key=lambda r: r[at_group]):
            n = sum(1 for _ in own)
            runs, most = [*runs[:1], (g, n)], max(most, n)
        if runs:
            yield (part, *runs[0], *runs[-1], len(runs) == 1), most

    summary = ordered.mapPartitionsWithIndex(facts_of).collect()  # one row a partition
    facts = partition_facts([s for s, _ in summary])
    tallest = height(max([0, *(m for _, m in summary), *(n for f in facts.values() for n in f[1:])]))
    shared = spark.sparkContext.broadcast(facts)

    def build(part: int, found: Iterator[tuple]) -> Iterator[tuple]:
        before, total_first, total_last = shared.value.get(part, (0, 0, 0))
        run, is_first = None, True
        for g, own in groupby(found, key=lambda r: r[at_group]):
            if run is not None:
                yield from finish(*run)
            own = list(own)
            start = before if is_first else 0
            run = (g, own, start, total_first if is_first else len(own))
            is_first = False
        if run is not None:
            yield from finish(run[0], run[1], run[2], total_last)

    def finish(g: str | None, own: list[tuple], start: int, total: int) -> Iterator[tuple]:
        out, paths, ends = climb(0, start, [r[at_digest] for r in own], total, 1 << 30)
        for row, path, (level, idx) in zip(own, paths, ends):
            yield ("leaf", *row, path, g, level, idx, None, total)
        for level, idx, d in out:
            yield ("node", *[None] * len(names), None, g, level, idx, d, total)

    path_type = T.ArrayType(T.StructType([T.StructField("l", T.StringType()), T.StructField("r", T.StringType())]))
    whole = [T.StructField("node_group", leaves.schema[group].dataType), T.StructField("level", T.IntegerType()), T.StructField("idx", T.LongType()), T.StructField("node_digest", T.StringType()), T.StructField("total", T.LongType())]
    schema = T.StructType([T.StructField("kind", T.StringType()), *[T.StructField(f.name, f.dataType) for f in leaves.schema], T.StructField("path", path_type), *whole])
    built = materialise(spark.createDataFrame(ordered.mapPartitionsWithIndex(build), schema, verifySchema=False), "merkle", partition_by=["kind"])
    nodes = built.where("kind = 'node'").select("node_group", "level", "idx", "node_digest", "total")
    paths, roots = finish_upper(nodes, tallest, parts)
    return built.where("kind = 'leaf'").select(*names, "path", "level", "idx"), paths, roots


def finish_upper(nodes: DataFrame, tallest: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """Completes ragged nodes by rounds of shuffles by coordinate; (paths from each node to its root, roots)."""
    spark, group_type = nodes.sparkSession, nodes.schema["node_group"].dataType.simpleString()
    top = F.length(F.conv((F.greatest(F.col("total") - 1, F.lit(0))).cast("string"), 10, 2)) * (F.col("total") > 1).cast("int")
    nodes = nodes.withColumn("top", top)
    fields = f"node_group {group_type}, level int, idx bigint, node_digest string, total bigint, top int"
    done, segments, to = [nodes.where("level = top")], [], FIRST
    rest = nodes.where("level < top")
    while tallest:
        below = rest.where(F.col("level") < to).rdd.map(lambda r, h=to: ((r[0], r[2] >> (h - r[1])), (r[1], r[2], r[3], r[4], r[5])))
        done_here = below.groupByKey(parts).flatMap(lambda x, h=to: complete(x[0][0], x[1], h))
        schema = f"kind string, {fields}, seg {PATH}, to_level int, to_idx bigint"
        made = materialise(spark.createDataFrame(done_here, T.StructType.fromDDL(schema), verifySchema=False), "merkle-round", partition_by=["kind"])
        segments.append(made.where("kind = 'path'").select("node_group", "level", "idx", "seg", "to_level", "to_idx"))
        up = made.where("kind = 'node'").select(*nodes.columns)
        done.append(up.where("level = top"))
        if to >= tallest:
            break
        rest = materialise(rest.where(F.col("level") >= to).unionByName(up.where("level < top")), "merkle-rest")
        to += ROUND
    roots = done[0]
    for d in done[1:]:
        roots = roots.unionByName(d)
    roots = materialise(roots, "merkle-roots")
    ends = roots.select("node_group", F.col("level").alias("node_level"), F.col("idx").alias("node_idx"), F.array().cast(PATH).alias("up"))
    known = ends
    for s in segments[::-1]:
        k = known.select(F.col("node_group").alias("g"), "node_level", "node_idx", "up")
        more = s.join(k, F.col("node_group").eqNullSafe(F.col("g")) & (F.col("to_level") == F.col("node_level")) & (F.col("to_idx") == F.col("node_idx")))
        more = more.select("node_group", F.col("level").alias("node_level"), F.col("idx").alias("node_idx"), F.concat("seg", "up").alias("up"))
        known = known.unionByName(more)
    return known, roots.select(F.col("node_group").alias("root_group"), F.col("node_digest").alias("root"))


def fold(start: Column, path: Column) -> Column:
    return F.aggregate(path, start, lambda acc, x: F.sha2(F.concat(x["l"], acc, x["r"]), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, tampered, subroot, root, path) of every row: ``path`` leads from the leaf by the root of its lang to the table's root."""
    fields = {c: F.col(c) for c in FIELDS}
    changed = fields | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    leaf = leaf_digest(fields)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf_digest(changed)).otherwise(leaf)
    leaves = materialise(docs.select("doc_id", "lang", leaf.alias("digest"), tampered.alias("tampered")), "leaves")
    rows, paths, roots = trees(leaves, "lang", ["doc_id"])
    tops = roots.select(F.lit("").alias("all"), F.col("root_group").alias("lang"), F.col("root").alias("digest"))
    langs, upper, root = trees(materialise(tops, "subroots"), "all", ["lang"])
    langs = langs.join(upper, (F.col("level") == F.col("node_level")) & (F.col("idx") == F.col("node_idx")))
    langs = langs.select(F.col("lang").alias("of_lang"), F.col("digest").alias("subroot"), F.concat("path", "up").alias("lang_path"))
    known = paths.join(langs, F.col("node_group").eqNullSafe(F.col("of_lang"))).crossJoin(F.broadcast(root.select("root")))
    known = materialise(known.select("node_group", "node_level", "node_idx", "subroot", "root", F.concat("up", "lang_path").alias("up")), "merkle-paths")
    found = rows.join(known, F.col("lang").eqNullSafe(F.col("node_group")) & (F.col("level") == F.col("node_level")) & (F.col("idx") == F.col("node_idx")))
    return found.select("doc_id", F.col("digest").alias("leaf"), "tampered", "subroot", "root", F.concat("path", "up").alias("path"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest(table(spark, sf_dir, "documents"))
    siblings = F.array_join(F.transform("path", lambda x: F.concat(x["l"], x["r"])), "")
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), fold(F.col("tampered"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')" for c in (n_chars if f == "n_chars" else f for f in FIELDS)) + ")"


#: Levels by recursion; a sibling stands at index xor 1; an entry of the path is its side and digest, or '-' for a node alone in its run.
ORACLE = f"""WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, leaf, tampered, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS total FROM (
    SELECT doc_id, lang, {_sql_leaf("n_chars")} AS leaf, CASE WHEN doc_crc % 7 = 0 THEN {_sql_leaf("n_chars::HUGEINT + 1")} ELSE {_sql_leaf("n_chars")} END AS tampered
    FROM (SELECT *, xor(crc_state, 4294967295::BIGINT) AS doc_crc FROM (
      SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)) AS crc_state FROM documents)))
), nodes(lang, level, idx, digest, n) AS (
  SELECT lang, 0, idx, leaf, total FROM leaves
  UNION ALL SELECT lang, any_value(level) + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, idx // 2
), subroots AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS total FROM nodes WHERE n = 1
), uppers(level, idx, digest, n) AS (
  SELECT 0, idx, subroot, total FROM subroots
  UNION ALL SELECT any_value(level) + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 1) // 2 FROM uppers WHERE n > 1 GROUP BY idx // 2
), lower_path AS (
  SELECT l.lang, l.idx, list(coalesce(CASE WHEN (l.idx >> b.level) % 2 = 1 THEN 'L' ELSE 'R' END || s.digest, '-') ORDER BY b.level) AS path
  FROM leaves l JOIN (SELECT DISTINCT lang, level FROM nodes WHERE n > 1) b ON l.lang IS NOT DISTINCT FROM b.lang
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = b.level AND s.idx = xor(l.idx >> b.level, 1) GROUP BY 1, 2
), upper_path AS (
  SELECT g.lang, list(coalesce(CASE WHEN (g.idx >> b.level) % 2 = 1 THEN 'L' ELSE 'R' END || s.digest, '-') ORDER BY b.level) AS path
  FROM subroots g CROSS JOIN (SELECT DISTINCT level FROM uppers WHERE n > 1) b LEFT JOIN uppers s ON s.level = b.level AND s.idx = xor(g.idx >> b.level, 1) GROUP BY 1
), whole AS (
  SELECT l.doc_id, l.leaf, l.tampered, g.subroot, (SELECT digest FROM uppers WHERE n = 1) AS root, list_concat(coalesce(p.path, []), coalesce(u.path, [])) AS path
  FROM leaves l JOIN subroots g ON g.lang IS NOT DISTINCT FROM l.lang LEFT JOIN lower_path p ON p.lang IS NOT DISTINCT FROM l.lang AND p.idx = l.idx LEFT JOIN upper_path u ON u.lang IS NOT DISTINCT FROM l.lang
), folded AS (
  SELECT *, sha256(array_to_string(list_transform(list_filter(path, lambda x: x <> '-'), lambda x: x[2:]), '')) AS proof_sha256,
    list_reduce(list_prepend(tampered, path), lambda a, x: CASE WHEN x = '-' THEN sha256(a) WHEN x[1] = 'L' THEN sha256(x[2:] || a) ELSE sha256(a || x[2:]) END) AS folded_root FROM whole
) SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded"""
