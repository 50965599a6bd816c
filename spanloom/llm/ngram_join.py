"""Operator 4: n-gram Jaccard join with rare-first prefix, length, positional and suffix filters.

A document's set holds hashes of its distinct word 5-shingles. Documents with the same set form one node,
so copies are never compared. Shingles are ordered by document frequency, rare ones first: frequencies
are counted over all documents in a table of fixed size (``BUCKETS``), which any order must only agree on, not get
exactly right. A node's prefix has size - ceil(0.8 * size) + 1 shingles; two sets of Jaccard 0.8 share a shingle
of both prefixes. Prefix shingles are the only thing shuffled for all documents.

Nodes that share a prefix shingle are first paired with one random leader per shingle (a star, so a group of g near
copies costs g pairs a shingle, not g * g), and each node's best ``LEADERS`` leaders are verified. Pairs pass the length filter, the positional filter at their first common
shingle, and a suffix filter that bounds the sets' Hamming distance by hashed parities; what is left is verified
once by intersecting the sets. Links are contracted to components, and further rounds pair only nodes of
different components; the last round takes every such pair, so no link between components is missed. Pairs inside
a component need no check: they cannot change any class.

A shingle of very many documents is salted before the first round. The frequency table and, if it is small, a
Bloom filter of the texts to verify are the only broadcasts, both of bounded size.

Defined results: null, empty or blank texts have no shingles and link with nothing; fewer words than five are
one shingle; rows with equal doc_id are one document as far as classes go; component ids ignore null ids unless
all are null; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import Words, free_name, materialise, mix64, powers, slices, table, utf8_texts, whole_text

N = 5
PERCENT = 80
BUCKETS = 1 << 18
SALT_ROWS = 50_000
PARITY_WORDS = 16
FOLD_WORDS = 4
MAX_BLOOM_BITS = 1 << 26
MAX_BROADCAST_IDS = 200_000
STAR_ROUNDS = 3
FILE_ROWS = 250_000
LEADERS = 3
PROFILE = ["kind", "doc_id", "n", "node", "text_key", "parity", "fold"]
_Q = powers(N + 1)[1:]


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = Words(texts)
    h = w.hash
    if len(h) >= N:
        grams = np.zeros(len(h) - N + 1, np.uint64)
        for k in range(N):
            grams += h[k : len(h) - N + 1 + k] * _Q[k]
        grams = mix64(grams)
    else:
        grams = np.empty(0, np.uint64)
    out = []
    for first, count in zip(w.first[:-1].tolist(), w.counts.tolist()):
        if count >= N:
            out.append(np.unique(grams[first : first + count - N + 1]))
        elif count:
            out.append(mix64((h[first : first + count] * _Q[:count]).sum(dtype=np.uint64, keepdims=True) + np.uint64(count)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def node_of(s: np.ndarray) -> int:
    """63-bit hash of a whole set."""
    x = mix64(s + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64, keepdims=True) + mix64(np.array([len(s)], np.uint64))
    return int(mix64(x)[0] >> np.uint64(1))


def parities(s: np.ndarray) -> bytes:
    """Bit b: whether the set has an odd number of elements in class b. Differing bits need differing elements."""
    counts = np.bincount((s % np.uint64(PARITY_WORDS * 64)).astype(np.int64), minlength=PARITY_WORDS * 64)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(parity: bytes) -> np.ndarray:
    """The same parities for classes modulo ``FOLD_WORDS`` * 64: parities add up by exclusive or."""
    return np.bitwise_xor.reduce(np.frombuffer(parity, "<i8").reshape(-1, FOLD_WORDS), axis=0)


def buckets_of(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(20)).astype(np.int64) % BUCKETS


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """Texts with a hash of each whole text, by which a node's texts are found again without making their sets."""
    return docs.select(*more, whole_text().alias("text")).withColumn("text_key", F.xxhash64("text"))


def profiles(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, node, text_key, parity, fold) of every document, and the frequency table."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            freq = np.zeros(BUCKETS, np.int64)
            for piece in slices(iter([batch]), "text"):
                sets = shingle_sets(utf8_texts(piece))
                if len(sets):
                    freq += np.bincount(buckets_of(np.concatenate(sets)), minlength=BUCKETS)
                n = len(sets)
                cols = [pa.array(["doc"] * n), piece.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) for s in sets], pa.int64())]
                bits = [parities(s) for s in sets]
                cols += [piece.column("text_key"), pa.array(bits, pa.binary()), pa.array([folded(b) for b in bits], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, PROFILE)
            used = np.flatnonzero(freq)
            cols = [pa.array(["freq"] * len(used)), pa.nulls(len(used), batch.column("doc_id").type), pa.array(freq[used]), pa.array(used), pa.nulls(len(used), pa.int64()), pa.nulls(len(used), pa.binary()), pa.nulls(len(used), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, PROFILE)

    made = keyed(docs, "doc_id").mapInArrow(run, f"kind string, doc_id {id_type}, n bigint, node bigint, text_key bigint, parity binary, fold array<bigint>")
    made = materialise(made, "join-profiles", ["kind"])
    freq = np.zeros(BUCKETS, np.int64)
    counted = made.filter(F.col("kind") == "freq").groupBy("node").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows at most
    freq[counted["node"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    return made.filter(F.col("kind") == "doc").drop("kind"), freq


def prefix_rows(docs: DataFrame, freq: np.ndarray) -> DataFrame:
    """(token, salt, node, n, pos): every node's rare-first prefix, once per task."""
    shared = docs.sparkSession.sparkContext.broadcast(freq.astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = shared.value
        for batch in batches:
            seen: set[int] = set()
            for piece in slices(iter([batch]), "text"):
                parts = []
                for s in shingle_sets(utf8_texts(piece)):
                    node = node_of(s)
                    if not len(s) or node in seen:
                        continue
                    seen.add(node)
                    f = count[buckets_of(s)]
                    order = np.lexsort((s, f))[: prefix_length(len(s))]
                    salts = f[order] // SALT_ROWS
                    parts.append((s[order].view(np.int64), np.where(salts > 0, node % (salts + 1), 0), np.full(len(order), node), np.full(len(order), len(s), np.int32), np.arange(len(order), dtype=np.int32), salts > 0))
                if parts:
                    cols = [np.concatenate(c) for c in zip(*parts)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["token", "salt", "node", "n", "pos", "salted"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, "token bigint, salt bigint, node bigint, n int, pos int, salted boolean")


def needed(n_a: Column, n_b: Column) -> Column:
    """Least intersection of two sets of these sizes at the threshold."""
    return F.ceil((n_a + n_b) * F.lit(float(PERCENT)) / F.lit(100.0 + PERCENT) - 1e-9)


def long_enough(n_a: Column, n_b: Column) -> Column:
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * PERCENT


def filtered(met: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of rows (member, a, n_a, pos_a, b, n_b, pos_b) that pass the length and positional filters."""
    met = met.filter(long_enough(F.col("n_a"), F.col("n_b")))
    first = met.groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.min("pos_a").alias("pos_a"), F.min("pos_b").alias("pos_b"), F.count("*").alias("common"), F.max("member").alias("member"))
    bound = 1 + F.least(F.col("n_a") - F.col("pos_a") - 1, F.col("n_b") - F.col("pos_b") - 1)
    return first.filter(bound >= needed(F.col("n_a"), F.col("n_b")))


def suffix_filter(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Drop pairs whose sets differ in too many parities to reach the threshold."""
    side = nodes.select("node", "parity")
    both = pairs.join(side.withColumnsRenamed({"node": "a", "parity": "parity_a"}), "a").join(side.withColumnsRenamed({"node": "b", "parity": "parity_b"}), "b")

    def differing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PARITY_WORDS * 8) for c in ("parity_a", "parity_b"))
            n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n_a", "n_b"))
            least = -(-(n_a + n_b) * PERCENT // (100 + PERCENT))
            ok = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= n_a + n_b - 2 * least
            yield batch.select(["a", "b", "n_a", "n_b", "common", "member"]).filter(pa.array(ok))

    return both.select("a", "b", "n_a", "n_b", "common", "member", "parity_a", "parity_b").mapInArrow(differing, "a bigint, b bigint, n_a int, n_b int, common bigint, member bigint")


def bloom_of(keys: DataFrame, n: int) -> np.ndarray | None:
    """Bit table of text keys, or nothing if it would exceed ``MAX_BLOOM_BITS``."""
    bits = 64
    while bits < 12 * n:
        bits *= 2
    if bits > MAX_BLOOM_BITS:
        return None
    probes = F.explode(F.array(*[F.pmod(F.shiftright("text_key", k * 19), F.lit(bits)) for k in range(3)]))
    words = keys.select(probes.alias("bit")).groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("v")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64)
    return out.view(np.uint64)


def may_hold(bloom: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Of signed 64-bit keys: which the bit table may hold."""
    out = np.ones(len(keys), bool)
    for k in range(3):
        at = np.mod(keys >> (k * 19), len(bloom) * 64).astype(np.uint64)
        out &= (bloom[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def sets_of(docs: DataFrame, nodes: DataFrame, n_nodes: int) -> DataFrame:
    """(node, shingles) of the given (node, text_key), made again from one text of each node and its copies."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom_of(nodes, n_nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = shared.value
        for batch in batches:
            if bloom is not None and batch.num_rows:
                batch = batch.filter(pa.array(may_hold(bloom, batch.column("text_key").to_numpy())))
            seen: set[int] = set()
            for piece in slices(iter([batch]), "text"):
                kept = []
                for s in shingle_sets(utf8_texts(piece)):
                    if len(s) and (node := node_of(s)) not in seen:
                        seen.add(node)
                        kept.append((node, s.view(np.int64)))
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.list_(pa.int64()))], ["node", "shingles"])

    made = keyed(docs).mapInArrow(run, "node bigint, shingles array<bigint>")
    made = made.join(nodes, "node", "left_semi")
    return made.groupBy("node").agg(F.first("shingles").alias("shingles"))


def verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that are links, by intersecting their whole sets."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ends = materialise(ends.join(nodes.select("node", "text_key"), "node"), "join-ends")
    n = ends.count()
    if not n:
        return pairs.select("a", "b")
    sets = sets_of(docs, ends, n)
    both = pairs.join(sets.withColumnsRenamed({"node": "a", "shingles": "s_a"}), "a").join(sets.withColumnsRenamed({"node": "b", "shingles": "s_b"}), "b")
    common = F.size(F.array_intersect("s_a", "s_b"))
    return both.filter(common * 100 >= (F.col("n_a") + F.col("n_b") - common) * PERCENT).select("a", "b")


def contract(edges: DataFrame) -> DataFrame:
    """(node, comp): least node reachable by edges (a, b), for nodes that have an edge."""
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "join-edges")
    files = 1 + both.count() // FILE_ROWS  # these rows are narrow: few files, few tasks
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")).coalesce(files), "join-labels")

    def step(known: DataFrame) -> DataFrame:
        near = both.join(known.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        moved = known.join(near, "node").select("node", F.least("comp", "near").alias("comp"))
        # A label is itself a node: follow it one step further.
        jump = known.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        return moved.join(jump, "comp", "left").select("node", F.least("comp", F.coalesce("further", "comp")).alias("comp"))

    while True:  # two steps a write; labels at rest after the second step were at rest after the first
        once = step(labels)
        was = once.withColumnRenamed("comp", "was")
        moved = materialise(step(once).join(was, "node").coalesce(files), "join-labels")
        labels = moved.select("node", "comp")
        if moved.filter("was <> comp").isEmpty():
            return labels


def with_comp(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return rows.withColumn("comp", F.col("node"))
    return rows.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def components(docs: DataFrame, nodes: DataFrame, freq: np.ndarray) -> DataFrame | None:
    """(node, comp) of all nodes with a link, or nothing if there is no link."""
    group = Window.partitionBy("token", "salt")
    rows = prefix_rows(docs, freq)
    row = F.struct(F.xxhash64("node", "token", F.lit(0)), "node", "n", "pos")
    live = rows.withColumn("leader", F.min(row).over(group)).withColumn("last", F.max("node").over(group)).withColumn("low", F.min("node").over(group))
    live = materialise(live.filter((F.col("low") < F.col("last")) | F.col("salted")).drop("last", "low", "salt", "salted"), "join-prefixes")
    comps, done = None, None
    for turn in range(STAR_ROUNDS + 1):
        if turn == 0:
            met = live.filter(F.col("leader.node") != F.col("node")).select(F.col("leader.node").alias("p"), F.col("leader.n").alias("n_p"), F.col("leader.pos").alias("pos_p"), F.col("node").alias("q"), F.col("n").alias("n_q"), F.col("pos").alias("pos_q"))
        else:
            open_ = with_comp(live.select("token", "node", "n", "pos"), comps)
            mixed = open_.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min(F.struct(F.xxhash64("node", "token", F.lit(turn)), "node", "n", "pos", "comp")).alias("leader")).filter("c0 < c1")
            open_ = materialise(open_.join(mixed.select("token", "leader"), "token").distinct(), "join-open")
            if turn < STAR_ROUNDS:
                met = open_.filter(F.col("leader.comp") != F.col("comp")).select(F.col("leader.node").alias("p"), F.col("leader.n").alias("n_p"), F.col("leader.pos").alias("pos_p"), F.col("node").alias("q"), F.col("n").alias("n_q"), F.col("pos").alias("pos_q"))
            else:  # with the length, positional and (on fewer classes) suffix filters in the join itself
                known = open_.drop("leader").join(nodes.select("node", "fold"), "node")
                a, b = (known.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("n", "pos", "comp", "fold")], F.col("node").alias(x)) for x in ("p", "q"))
                # A pair need only be met at its first common shingle, where nothing before it is common.
                near = F.least(F.col("n_p") - F.col("pos_p"), F.col("n_q") - F.col("pos_q"))
                apart = sum((F.bit_count(F.element_at("fold_p", k + 1).bitwiseXOR(F.element_at("fold_q", k + 1))) for k in range(FOLD_WORDS)), F.lit(0))
                least = needed(F.col("n_p"), F.col("n_q"))
                met = a.join(b, "token").filter((F.col("comp_p") < F.col("comp_q")) & long_enough(F.col("n_p"), F.col("n_q")) & (near >= least) & (apart <= F.col("n_p") + F.col("n_q") - 2 * least))
        swap = F.col("p") > F.col("q")
        side = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))  # noqa: B023, E731
        met = met.select(F.col("q").alias("member"), side("p", "q").alias("a"), side("n_p", "n_q").alias("n_a"), side("pos_p", "pos_q").alias("pos_a"), side("q", "p").alias("b"), side("n_q", "n_p").alias("n_b"), side("pos_q", "pos_p").alias("pos_b"))
        pairs = filtered(met)
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = suffix_filter(pairs, nodes)
        if turn < STAR_ROUNDS:  # few leaders per node are enough to grow components; the last round takes the rest
            best = Window.partitionBy("member").orderBy(F.desc("common"), "a", "b")
            pairs = pairs.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= LEADERS).drop("place", "member", "common").distinct()
        pairs = materialise(pairs, "join-candidates")
        if pairs.isEmpty():
            continue
        links = materialise(verified(docs, pairs, nodes), "join-links")
        done = pairs.select("a", "b") if done is None else done.union(pairs.select("a", "b"))
        if links.isEmpty():
            continue
        if comps is None:
            comps = contract(links)
        else:
            ends = links.join(comps.withColumnsRenamed({"node": "a", "comp": "ca"}), "a", "left").join(comps.withColumnsRenamed({"node": "b", "comp": "cb"}), "b", "left")
            merged = contract(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).filter("a <> b"))
            old = comps.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("now")), "comp", "left").select("node", F.coalesce("now", "comp").alias("comp"))
            fresh = merged.join(comps, "node", "left_anti")
            comps = materialise(old.union(fresh.select("node", "comp")), "join-comps")
    return comps


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    rows, freq = profiles(docs)
    nodes = rows.filter("n > 0").groupBy("node").agg(F.first("parity").alias("parity"), F.first("fold").alias("fold"), F.min("text_key").alias("text_key"))
    comps = components(docs, materialise(nodes, "join-nodes"), freq)
    rows = with_comp(rows.select("doc_id", "n", "node"), comps)
    least = rows.filter("n > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    found = rows.join(least, "comp", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns as they are, without near duplicates: the least doc_id of each class stays.

    Repeated rows of a doc_id are copies of one document, and one stays; rows without an id stay. The ids to drop are
    broadcast if they are at most ``MAX_BROADCAST_IDS``, so texts are not shuffled; else the join is left to Spark.
    """
    found = materialise(near_duplicates(docs), "join-classes")
    drop = materialise(found.filter("doc_id <> component_id").select("doc_id").distinct(), "join-dropped")
    few = drop.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
    kept = docs.join(F.broadcast(drop) if few else drop, "doc_id", "left_anti").select(*docs.columns)
    if found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return kept
    own = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    place = free_name(docs.columns, "place")
    numbered = kept.filter("doc_id is not null").withColumn(place, F.row_number().over(own)).filter(F.col(place) == 1).drop(place)
    return numbered.unionByName(kept.filter("doc_id is null"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
