"""Operator 5: nearest neighbours by inner product with a forest of random-projection trees.

Trees are fitted on a bounded sample (``SAMPLE`` rows with the least id hashes): a node's plane is the difference
of two random points, cut at the median. Vectors get one more coordinate that lifts them to equal norm, so the
largest inner product is the nearest point. Every row is indexed: it has one leaf per tree. Leaves hold about
``LEAF`` rows, so trees grow deeper with the table, down to 2 ** ``DEPTH`` leaves, which the sample can still cut.

A query ranks the leaves of all trees in one shared priority queue, by the summed squared margins of the planes
it must cross, and visits leaves until they hold a budget of rows (rows of several trees count once per tree). The
budget is calibrated: for ``PROBES`` queries the true neighbours are found by one exact pass, and the queue says
how many rows had to be visited before each turned up; the ``RECALL`` quantile of that is the budget. Vectors with near
neighbours in clusters get a small one, whatever the table's size; vectors without any structure a large one.

Leaves are cut into blocks of ``LEAF_BLOCK`` rows and queries into blocks of ``QUERY_BLOCK``, so a leaf full of equal
vectors is spread over tasks. Blocks of leaves are dealt into ``BUNDLES`` bundles. A block of queries goes through a sorted bundle leaf by
leaf, is reranked exactly in double precision, and keeps its 20 best over all leaves of the bundle, so a query gives at most
20 rows a bundle, however many leaves it visits; these are merged per query. Measured recall is in the README; it is checked against brute force in the tests.

Defined results: vectors that are null, zero, hold null or non-finite components, or whose length is not the most
common one take no part; of rows with equal vec_id the one with the least vector counts, once as candidate and once as query; fewer candidates than 20
give fewer rows; ties go to the smaller vec_id; null ids take no part; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import materialise, table

K = 20
TREES = 12
DEPTH = 13
LEAF = 128
SAMPLE = 65_536
SAMPLE_LEAF = 8
PROBES = 96
RECALL = 0.94
PROBE_ROWS = 64
LEAF_BLOCK = 4096
QUERY_BLOCK = 16_384
BUNDLES = 16
QUERY_ROWS = 256
PAIRS = 8192
WAITING = 500_000
QUERY_EVERY = 20


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, norm2) of rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(~bad)
    rows = rows.withColumn("norm2", F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))).filter("norm2 > 0")
    common = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).first()
    return rows.filter(F.size("embedding") == (common["dim"] if common else 0))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def lift(x: np.ndarray, top2: float | None) -> np.ndarray:
    """Points with the extra coordinate sqrt(top2 - |x|^2); queries have 0 there."""
    extra = np.zeros(len(x)) if top2 is None else np.sqrt(np.maximum(top2 - (x * x).sum(axis=1), 0.0))
    return np.column_stack((x, extra))


def fit_forest(sample: np.ndarray, trees: int, depth: int, seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """(planes, cuts) of each tree's inner nodes, level by level; planes have unit length."""
    rng = np.random.default_rng(seed)
    forest = []
    for _ in range(trees):
        planes, cuts, groups = [], [], [np.arange(len(sample))]
        for _ in range(depth):
            following = []
            for g in groups:
                v = np.zeros(sample.shape[1])
                if len(g) > 1:
                    a, b = rng.choice(g, 2, replace=False)
                    v = sample[a] - sample[b]
                if not v.any():
                    v = rng.normal(size=sample.shape[1])
                v /= np.linalg.norm(v)
                at = sample[g] @ v
                cut = float(np.median(at)) if len(g) else 0.0
                planes.append(v)
                cuts.append(cut)
                following += [g[at < cut], g[at >= cut]]
            groups = following
        forest.append((np.array(planes).reshape(-1, sample.shape[1]), np.array(cuts)))
    return forest


def leaves_of(tree: tuple[np.ndarray, np.ndarray], depth: int, points: np.ndarray) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    if depth:
        margin = points @ tree[0].T - tree[1]
        rows = np.arange(len(points))
        for level in range(depth):
            node = node * 2 + (margin[rows, (1 << level) - 1 + node] >= 0)
    return node


def leaf_costs(tree: tuple[np.ndarray, np.ndarray], depth: int, queries: np.ndarray) -> np.ndarray:
    """Per query and leaf: summed squared margins of the planes between them."""
    cost = np.zeros((len(queries), 1))
    if depth:
        margin = queries @ tree[0].T - tree[1]
        for level in range(depth):
            m = margin[:, (1 << level) - 1 : (2 << level) - 1]
            cost = np.stack((cost + np.maximum(m, 0) ** 2, cost + np.maximum(-m, 0) ** 2), axis=-1).reshape(len(queries), -1)
    return cost


class Forest:
    """Fitted trees and, once counted, the rows of each leaf."""

    def __init__(self, points: np.ndarray, n: int, trees: int, top: float) -> None:
        self.depth = max(0, int(np.log2(max(1.0, min(n / LEAF, len(points) / SAMPLE_LEAF, 2.0**DEPTH)))))
        self.trees, self.top, self.n_leaves = fit_forest(points, trees, self.depth), top, 1 << self.depth
        self.sizes = np.zeros(trees * self.n_leaves, np.int64)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row of ``x`` in every tree; leaves are numbered through all trees."""
        x = lift(x, self.top)
        return np.column_stack([leaves_of(t, self.depth, x) + i * self.n_leaves for i, t in enumerate(self.trees)])

    def queue(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each query: leaves in the order of the shared queue, and the rows that were visited before each."""
        q = lift(q, None)
        order = np.argsort(np.concatenate([leaf_costs(t, self.depth, q) for t in self.trees], axis=1), axis=1, kind="stable")
        held = self.sizes[order]
        return order, np.cumsum(held, axis=1) - held


def exact_neighbours(indexed: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """(query, leaves): leaves of the ``k`` true neighbours of a few queries, by one pass over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids = b.column("vec_id").to_numpy()
                s = queries @ matrix(b.column("embedding")).T
                s[ids[None, :] == query_ids[:, None]] = -np.inf
                best = np.argsort(-s, axis=1)[:, :k]
                rows = best.ravel()
                number = np.repeat(np.arange(len(queries)), best.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(s[number, rows]), b.column("leaves").take(pa.array(rows))], ["query", "score", "leaves"])

    found = indexed.mapInArrow(run, "query bigint, score double, leaves array<bigint>").filter("score > double('-inf')")
    order = Window.partitionBy("query").orderBy(F.desc("score"))
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select("query", "leaves")


def calibrated(forest: Forest, indexed: DataFrame, query_every: int, k: int, recall: float) -> int:
    """Rows to visit for the wanted recall, from ``PROBES`` queries with the least id hashes."""
    asked = indexed.filter(F.col("vec_id") % query_every == 0).select("vec_id", "embedding", F.xxhash64("vec_id", F.lit(3)).alias("h")).orderBy("h", "vec_id").limit(PROBES).toArrow()
    ids, q = asked.column("vec_id").to_numpy(), matrix(asked.column("embedding"))
    truth = exact_neighbours(indexed, ids, q, k).toArrow()  # PROBES * k rows at most
    if not truth.num_rows:
        return 1
    order, before = forest.queue(q)
    place = np.argsort(order, axis=1, kind="stable")  # of each leaf in its query's queue
    number, leaves = truth.column("query").to_numpy(), matrix(truth.column("leaves")).astype(np.int64)
    needed = before[number[:, None], place[number[:, None], leaves]].min(axis=1)
    return int(np.quantile(needed, recall, method="higher")) + 1


class Best:
    """The ``k`` best rows of each query so far; beside them at most ``WAITING`` and one call's rows wait to be sorted in."""

    def __init__(self, k: int) -> None:
        self.k, self.waiting, self.n = k, [], 0
        self.queries, self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.known, self.least = np.empty(0, np.int64), np.empty(0)

    def floor(self, queries: np.ndarray) -> np.ndarray:
        """Of each query the score that a row must reach; -inf while there are fewer than ``k``."""
        if not len(self.known):
            return np.full(len(queries), -np.inf)
        at = np.minimum(np.searchsorted(self.known, queries), len(self.known) - 1)
        return np.where(self.known[at] == queries, self.least[at], -np.inf)

    def add(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        self.waiting.append((queries, ids, scores))
        self.n += len(ids)
        if self.n >= WAITING:
            self.settle()

    def settle(self) -> None:
        q, v, s = (np.concatenate(c) for c in zip((self.queries, self.ids, self.scores), *self.waiting))
        self.waiting, self.n = [], 0
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        if len(q):
            new = np.concatenate(([True], (q[1:] != q[:-1]) | (v[1:] != v[:-1])))  # a row has the same score in every tree
            q, v, s = q[new], v[new], s[new]
            begin = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
            held = np.diff(np.append(begin, len(q)))
            self.known, self.least = q[begin], np.where(held >= self.k, s[begin + np.minimum(held, self.k) - 1], -np.inf)
            kept = np.arange(len(q)) - np.repeat(begin, held) < self.k
            q, v, s = q[kept], v[kept], s[kept]
        self.queries, self.ids, self.scores = q, v, s


def rerank(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, best: Best) -> None:
    """Put those of the rows ``ids`` (vectors ``x``) into ``best`` that may be among the best of the queries."""
    for a in range(0, len(q), QUERY_ROWS):
        own = query_ids[a : a + QUERY_ROWS]
        scores = q[a : a + QUERY_ROWS] @ x.T
        scores[ids[None, :] == own[:, None]] = -np.inf
        least = best.floor(own)
        if len(ids) > best.k:
            unknown = np.flatnonzero(least == -np.inf)
            least[unknown] = np.partition(scores[unknown], -best.k, axis=1)[:, -best.k]
        slack = np.where(np.isfinite(least), 1e-9 * (1 + np.abs(least)), 0.0)
        which, near = np.nonzero((scores >= (least - slack)[:, None]) & (scores > -np.inf))
        for b in range(0, len(near), PAIRS):
            i, j = which[b : b + PAIRS], near[b : b + PAIRS]
            best.add(own[i], ids[j], (x[j] * q[a + i]).sum(axis=1))  # one order of summation, so equal vectors have equal scores


def reranked(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Best rows of each query and bundle from (query_block, bundle, leaf, block, asks, id, vector) sorted by all but the last two: a block's rows, then its queries."""

    def done() -> pa.RecordBatch:
        best.settle()
        return pa.RecordBatch.from_arrays([pa.array(best.queries), pa.array(best.ids), pa.array(best.scores)], ["query_id", "vec_id", "score"])

    best, bundle, leaf, held = Best(k), None, None, []
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("query_block", "bundle", "leaf", "block", "asks")])
        ids = b.column("id").to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]))
        for begin, end in zip(cuts[:-1], cuts[1:]):
            *at, asks = keys[begin].tolist()
            if at[:2] != bundle:
                if len(best.queries) or best.n:
                    yield done()
                best, bundle = Best(k), at[:2]
            if at != leaf:
                leaf, held = at, []
            part = ids[begin:end], matrix(b.column("vector").slice(begin, end - begin))
            if not asks:
                held.append(part)
            elif held:
                if len(held) > 1:
                    held = [tuple(np.concatenate(c) for c in zip(*held))]
                rerank(*held[0], *part, best)
    if len(best.queries) or best.n:
        yield done()


def nearest(vectors: DataFrame, query_every: int = QUERY_EVERY, k: int = K, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): neighbours of rows whose vec_id is divisible by ``query_every`` among all rows."""
    spark, kind = vectors.sparkSession, vectors.schema["embedding"].dataType.simpleString()
    rows = usable(vectors).groupBy("vec_id").agg(F.min(F.struct("embedding", "norm2")).alias("v")).select("vec_id", "v.embedding", "v.norm2")
    rows = materialise(rows, "ann-vectors")
    facts = rows.agg(F.count("*").alias("n"), F.max("norm2").alias("top"), F.count_if(F.col("vec_id") % query_every == 0).alias("queries")).first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not facts["queries"]:
        return spark.createDataFrame([], schema)
    sample = rows.select("embedding", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(SAMPLE).toArrow()
    forest = Forest(lift(matrix(sample.column("embedding")), facts["top"]), facts["n"], trees, facts["top"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own = forest.leaves(matrix(b.column("embedding")))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("embedding"), pa.array(list(own), pa.list_(pa.int64()))], ["vec_id", "embedding", "leaves"])

    indexed = materialise(rows.select("vec_id", "embedding").mapInArrow(index, f"vec_id bigint, embedding {kind}, leaves array<bigint>"), "ann-index")
    for r in indexed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():  # trees * 2 ** DEPTH rows at most
        forest.sizes[r["leaf"]] = r["count"]
    budget = calibrated(forest, indexed, query_every, k, recall)
    blocks = np.maximum(1, -(-forest.sizes // LEAF_BLOCK))
    query_blocks = -(-facts["queries"] // QUERY_BLOCK)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, PROBE_ROWS):
                part = b.slice(at, PROBE_ROWS)
                order, before = forest.queue(matrix(part.column("embedding")))
                take = (before < budget) & (forest.sizes[order] > 0)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("embedding"), pa.array([o[t] for o, t in zip(order, take)], pa.list_(pa.int64()))], ["query_id", "query", "leaves"])

    # Nearly all leaves are one block; the rest are few, as blocks hold many leaves' rows.
    cut = {int(leaf): int(blocks[leaf]) for leaf in np.flatnonzero(blocks > 1)}
    many = F.create_map(*[F.lit(x) for pair in cut.items() for x in pair]) if cut else None
    block_of = F.lit(1) if many is None else F.coalesce(F.try_element_at(many, F.col("leaf").cast("int")), F.lit(1))
    held = indexed.select("vec_id", "embedding", F.explode("leaves").alias("leaf")).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(9)), block_of))
    held = held.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = rows.filter(F.col("vec_id") % query_every == 0).select("vec_id", "embedding").mapInArrow(probe, f"query_id bigint, query {kind}, leaves array<bigint>")
    asked = asked.select("query_id", "query", F.explode("leaves").alias("leaf"), F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int").alias("query_block"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), (block_of - 1).cast("bigint"))))

    bundle = F.pmod(F.xxhash64("leaf", F.col("block").cast("bigint")), F.lit(BUNDLES)).cast("int").alias("bundle")
    rows = held.select("query_block", bundle, "leaf", F.col("block").cast("bigint").alias("block"), F.lit(0).alias("asks"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    rows = rows.unionAll(asked.select("query_block", bundle, "leaf", F.col("block").cast("bigint").alias("block"), F.lit(1).alias("asks"), F.col("query_id").alias("id"), F.col("query").alias("vector")))
    dealt = rows.repartition("query_block", "bundle").sortWithinPartitions("query_block", "bundle", "leaf", "block", "asks")
    found = dealt.mapInArrow(lambda batches: reranked(batches, k), "query_id bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
