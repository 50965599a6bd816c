"""Operator 10: mix sources to target weights by a multivariate-hypergeometric splitting tree.

Sources in code-point order, null last, weigh 5, 2, 1, repeating; they share ``share`` (150 %) of all
words. A source's target stops at twice its size and the excess is reshared by weight. That has a
closed form (water filling): with sources by rising 2 * size / weight, a level is found by one window
over the per-source table.

Documents fall by hash into blocks. Each source's blocks, in a random but reproducible permutation,
are taken until its target is reached; the block at the boundary is split between documents. The exact
block quotas of all sources are then partitioned among output shards by a binary tree: at each node the
left half of the shards draws its block counts from a multivariate hypergeometric law, source after
source, so every shard gets its share of blocks at random and the counts add up exactly. Shards own
disjoint ranges of each source's permuted blocks and shuffle their documents locally by hash.

Only counts are aggregated and shuffled: a document learns its fate by comparing its own hash with
the per-source boundaries, so texts never move. The per-source table is broadcast only if it has at most
``MAX_BROADCAST_SOURCES`` rows. Blocks per source are at most ``MAX_BLOCKS``, whatever the input's size.

Defined results: null or empty texts have size 0 and follow their block; a null source is a source of its
own, after all others; rows with equal doc_id share a hash and are taken or left together with equal sizes;
null ids hash like any value; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import WORD, materialise, table, whole_text

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEATS = 2
MAX_BLOCKS = 1 << 16
BLOCK_DOCS = 64
SHARDS = 16
MAX_BROADCAST_SOURCES = 20_000
SEED = 20240131


def word_count(column: str = "text") -> Column:
    return F.regexp_count(whole_text(column), F.lit(WORD)).cast("long")


def hash_keys(n_blocks: int, seed: int = SEED) -> tuple[Column, Column, Column]:
    """Block of a document, the block's place in the permutation, and the document's place within the block."""
    block = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(n_blocks))
    return block, F.xxhash64(F.lit(seed + 1), F.col("source"), block), F.xxhash64(F.lit(seed + 2), F.col("doc_id"))


def source_targets(blocks: DataFrame, share: float = SHARE) -> DataFrame:
    """One row per source: place in order, weight, size and water-filled target."""
    sources = blocks.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    k = F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (k + 1).cast("int"))
    cap = F.lit(float(MAX_REPEATS)) * F.col("source_size")
    ranked = sources.withColumn("place", F.row_number().over(order)).withColumn("weight", weight).withColumn("cap", cap)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    all_rows = Window.partitionBy()
    ranked = (
        ranked.withColumn("total", F.lit(share) * F.sum("source_size").over(all_rows))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped_before")) / F.col("weight_left"))
    )
    # The first source, by ratio, whose cap is not below its share of what is left fixes the level.
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("capped_before", "level"))).over(all_rows)["level"]
    target = F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))
    return ranked.withColumn("target", target).select("source", "place", "weight", "source_size", "target")


def uniform(*keys: Column | int | str) -> Column:
    """A reproducible number in (0, 1) from hashed keys."""
    cols = [F.lit(k) if isinstance(k, int) else F.col(k) if isinstance(k, str) else k for k in keys]
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hypergeometric(population: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Marked items among ``drawn`` of ``population``, by inversion from the mode outwards over +-12 deviations.

    Exact up to double precision: the law's mass beyond 12 standard deviations is below rounding.
    """
    low = F.greatest(F.lit(0).cast("long"), drawn - (population - marked))
    high = F.least(marked, drawn)
    mode = F.greatest(low, F.least(high, F.floor((drawn + 1) * (marked + 1) / (population + 2)).cast("long")))
    spread = (F.ceil(F.sqrt(F.least(marked, drawn) * 1.0) * 6.0) + 12).cast("long")
    given = F.struct(population.alias("n"), marked.alias("m"), drawn.alias("d"), low.alias("low"), high.alias("high"), mode.alias("mode"), spread.alias("spread"), u.alias("u"))

    def pick(g: Column) -> Column:
        a, b = F.greatest(g["low"], g["mode"] - g["spread"]), F.least(g["high"], g["mode"] + g["spread"])

        def up(k: Column) -> Column:  # P(k + 1) / P(k)
            return ((g["m"] - k) * (g["d"] - k)).cast("double") / ((k + 1) * (g["n"] - g["m"] - g["d"] + k + 1)).cast("double")

        none = F.array().cast("array<bigint>")
        rising = F.when(b > g["mode"], F.sequence(g["mode"], b - 1)).otherwise(none)
        falling = F.when(a < g["mode"], F.sequence(g["mode"] - 1, a, F.lit(-1).cast("long"))).otherwise(none)

        def walk(steps: Column, ratio, move: int) -> Column:
            def merge(acc: Column, k: Column) -> Column:
                last = F.coalesce(F.try_element_at(acc, F.lit(-1))["p"], F.lit(1.0))
                return F.concat(acc, F.array(F.struct((k + move).cast("long").alias("k"), (last * ratio(k)).alias("p"))))

            return F.aggregate(steps, F.array().cast("array<struct<k:bigint,p:double>>"), merge)

        law = F.concat(F.array(F.struct(g["mode"].alias("k"), F.lit(1.0).alias("p"))), walk(rising, up, 1), walk(falling, lambda k: 1.0 / up(k), 0))

        def invert(law: Column) -> Column:
            def choose(level: Column) -> Column:
                start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("bigint").alias("pick"))

                def step(acc: Column, x: Column) -> Column:
                    now = acc["sum"] + x["p"]
                    return F.struct(now.alias("sum"), F.when(acc["pick"].isNull() & (now >= level), x["k"]).otherwise(acc["pick"]).alias("pick"))

                return F.coalesce(F.aggregate(law, start, step)["pick"], g["mode"])

            return let(g["u"] * F.aggregate(law, F.lit(0.0), lambda acc, x: acc + x["p"]), choose)

        return let(law, invert)

    return let(given, pick)


def _draw(seed: int, depth: int):
    def draw(acc: Column, x: Column) -> Column:
        def put(got: Column) -> Column:
            return F.struct((acc["slots"] - x["quota"]).alias("slots"), (acc["left"] - got).alias("left"), F.concat(acc["out"], F.array(got)).alias("out"))

        return let(hypergeometric(acc["slots"], x["quota"], acc["left"], uniform(seed + 7, F.lit(depth), F.col("node"), x["place"])), put)

    return draw


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(source, shard, blocks): block quotas of each source partitioned at random among ``shards`` (a power of two).

    ``quotas`` has (source, place, quota). The tree's nodes carry one array with a quota per source, so a
    level is one narrow projection; node sizes differ by one block at most.
    """
    root = quotas.agg(F.array_sort(F.collect_list(F.struct("place", "quota", "source"))).alias("q")).select(F.lit(0).alias("node"), "q")
    level, depth = root, 0
    while 1 << depth < shards:
        total = F.aggregate("q", F.lit(0).cast("long"), lambda acc, x: acc + x["quota"])
        extra = F.when(F.pmod(F.xxhash64(F.lit(seed), F.lit(depth), F.col("node")), F.lit(2)) == 0, F.lit(0)).otherwise(F.lit(1))
        half = F.floor((total + extra) / 2).cast("long")
        start = F.struct(F.col("total").alias("slots"), F.col("half").alias("left"), F.array().cast("array<bigint>").alias("out"))

        drawn = F.aggregate("q", start, _draw(seed, depth))["out"]
        level = level.select("node", "q", total.alias("total"), half.alias("half")).select("node", "q", F.explode(F.array(drawn)).alias("left"))
        side = lambda of: F.zip_with("q", "left", lambda x, k: F.struct(x["place"].alias("place"), of(x, k).alias("quota"), x["source"].alias("source")))
        children = F.array(F.struct((F.col("node") * 2).alias("node"), side(lambda x, k: k).alias("q")), F.struct((F.col("node") * 2 + 1).alias("node"), side(lambda x, k: x["quota"] - k).alias("q")))
        level = level.select(F.explode(children).alias("c")).select("c.node", "c.q")
        depth += 1
    return level.select(F.col("node").alias("shard"), F.inline("q")).select("source", "shard", F.col("quota").alias("blocks"))


def mixing_plan(sized: DataFrame, n_blocks: int, share: float = SHARE, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per source with all that decides a document's fate.

    ``copies`` whole passes; in the next pass, blocks placed before ``cut_block`` are taken, and in that
    block documents up to (``cut_size``, ``cut_doc``); ``shard_from`` has (pass, place of the first block) per shard.
    """
    block, place, doc_key = hash_keys(n_blocks, seed)
    keyed = sized.select("source", "size", block.alias("block"), place.alias("block_key"), doc_key.alias("doc_key"))
    blocks = materialise(keyed.groupBy("source", "block_key").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "mix-blocks")
    targets = source_targets(blocks, share)
    facts = targets.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("int"))
    facts = materialise(facts.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("copies") * F.col("source_size"))), "mix-targets")
    facts = bounded(facts)
    order = Window.partitionBy("source").orderBy("block_key")
    walked = (
        blocks.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("rank", F.row_number().over(order))
        .join(facts.select(F.col("source").alias("s"), "copies", "rest"), F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
    )
    cuts = walked.groupBy("source").agg(
        F.max("rank").alias("n_blocks"),
        F.min(F.when(F.col("upto") > F.col("rest"), F.struct("rank", "block_key", (F.col("upto") - F.col("size")).alias("before")))).alias("cut"),
    )
    cuts = materialise(cuts.select("source", "n_blocks", F.col("cut.rank").alias("cut_rank"), F.col("cut.block_key").alias("cut_block"), F.col("cut.before").alias("before")), "mix-cuts")
    facts = facts.join(cuts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    # Documents of each source's boundary block: shortest first, while they bring the total nearer to the target.
    edge = keyed.join(
        bounded(facts.select(F.col("source").alias("s"), "cut_block", "before", "rest")),
        F.col("source").eqNullSafe(F.col("s")) & (F.col("block_key") == F.col("cut_block")),
    )
    edge = edge.withColumn("upto", F.col("before") + F.sum(F.col("size")).over(Window.partitionBy("source").orderBy(F.struct("size", "doc_key"))))
    took = edge.filter(F.col("upto") - F.col("size") / 2 <= F.col("rest"))
    took = took.groupBy("source").agg(F.max(F.struct("size", "doc_key")).alias("last"))
    facts = facts.join(took.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    quota = F.col("copies") * F.coalesce("n_blocks", F.lit(0)) + F.when(F.col("last").isNull(), F.coalesce(F.col("cut_rank") - 1, F.lit(0))).otherwise(F.col("cut_rank"))
    facts = materialise(facts.withColumn("quota", F.when(F.col("rest") > 0, quota).otherwise(F.col("copies") * F.coalesce("n_blocks", F.lit(0))).cast("long")), "mix-facts")
    # Shards own disjoint runs of each source's blocks, counted through the passes in permuted order.
    runs = split_quotas(facts.select("source", "place", "quota"), shards, seed)
    upto = F.sum("blocks").over(Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    runs = materialise(runs.withColumn("last_block", upto), "mix-runs")
    ranks = blocks.withColumn("rank", F.row_number().over(order)).select(F.col("source").alias("s"), "rank", "block_key")
    ends = (
        runs.join(facts.select(F.col("source").alias("t"), "n_blocks", "quota"), F.col("source").eqNullSafe(F.col("t")))
        .filter((F.col("last_block") < F.col("quota")) & (F.col("n_blocks") > 0))
        .select("source", "shard", F.floor(F.col("last_block") / F.col("n_blocks")).alias("pass"), (F.col("last_block") % F.col("n_blocks") + 1).alias("next_rank"))
        .join(ranks, F.col("source").eqNullSafe(F.col("s")) & (F.col("next_rank") == F.col("rank")))
    )
    ends = ends.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("pass", F.col("block_key").alias("key"), "shard"))).alias("shard_from"))
    facts = facts.join(ends.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return materialise(facts, "mix-plan")


def bounded(per_source: DataFrame) -> DataFrame:
    """Broadcast a per-source table if it has few rows; else leave the join to Spark."""
    few = per_source.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES
    return F.broadcast(per_source) if few else per_source


def placed(docs: DataFrame, share: float, shards: int, seed: int) -> DataFrame:
    """(doc, doc_id, size, copies, shards, source_size, target) of every row; ``doc`` holds its own columns, whatever their names."""
    n = docs.count()
    n_blocks = max(1, min(MAX_BLOCKS, n // BLOCK_DOCS))
    sized = materialise(docs.select("doc_id", "source", word_count().alias("size")), "mix-sizes")
    plan = bounded(mixing_plan(sized, n_blocks, share, shards, seed).select(F.struct("*").alias("plan"), F.col("source").alias("key")))
    _, place, doc_key = hash_keys(n_blocks, seed)
    p = lambda name: F.col(f"plan.{name}")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "source", word_count().alias("size"), place.alias("block_key"), doc_key.alias("doc_key"))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("key")))
    within = (F.col("block_key") < p("cut_block")) | ((F.col("block_key") == p("cut_block")) & p("last").isNotNull() & (F.struct("size", "doc_key") <= p("last")))
    extra = F.when((p("rest") > 0) & (p("cut_block").isNull() | within), 1).otherwise(0)
    rows = rows.withColumn("copies", (p("copies") + extra).cast("int"))

    def shard(number: Column) -> Column:
        before = F.filter(F.coalesce(p("shard_from"), F.array().cast("array<struct<pass:bigint,key:bigint,shard:int>>")), lambda e: (e["pass"] < number) | ((e["pass"] == number) & (e["key"] <= F.col("block_key"))))
        return F.size(before)

    passes = F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array().cast("array<int>"))
    return rows.select("doc", "doc_id", "size", "copies", F.transform(passes, shard).alias("shards"), p("source_size").alias("source_size"), p("target").alias("target"))


def mix(docs: DataFrame, share: float = SHARE, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``docs`` with mix_size, mix_source_size, mix_target, mix_copies and mix_shards (shard of each copy), in place of columns so named."""
    made = {f"mix_{c}": F.col(c) for c in ("size", "source_size", "target", "copies", "shards")}
    kept = [F.col(f"doc.`{c}`") for c in docs.columns if c not in made]
    return placed(docs, share, shards, seed).select(*kept, *[c.alias(name) for name, c in made.items()])


def mixed_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mixture itself: ``docs``' columns, a document once per copy, by shard and shuffled inside each shard."""
    rows = placed(docs, SHARE, shards, seed).select("doc", "doc_id", F.posexplode("shards").alias("pass", "shard"))
    key = F.xxhash64(F.lit(seed + 3), F.col("doc_id"), F.col("pass"))
    return rows.repartition(F.col("shard"), F.pmod(key, F.lit(64))).sortWithinPartitions("shard", key).select("doc.*")


def op10_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"), F.col("mix_copies").alias("copies"), F.array_join(F.col("mix_shards").cast("array<string>"), ",").alias("shards"),
    )
