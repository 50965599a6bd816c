"""Operator 3: toxicity by weak supervision.

1. Lexicons. A bounded sample of labelled training rows (``SAMPLE``; never held-out rows) is counted by distinct word
   and word prefix; those much likelier in toxic texts become markers, strong or weak, of four kinds.
2. Voters. Every lexicon kind and strength, and patterns of how markers and signs occur, votes toxic, clean or abstains.
3. Label model. Vote patterns of all documents are counted by one aggregation (patterns are few: voters are fixed), and a
   two-class generative model is fitted to the counts by expectation maximisation: each voter's vote probabilities per
   class, and the voters' correlations within a class, by which the votes of correlated voters are discounted.
4. Classifier. A linear classifier on marker presence and vote features is trained on the posterior labels of the
   sampled texts; its intercept is set on the sample's labels. All documents are scored in one pass.

Only the sampled rows meet their labels (by a broadcast of at most ``SAMPLE`` ids); no text is shuffled. Scores depend on
the text alone.

Defined results: null and empty texts have no words and get the score of a text without markers; rows with equal doc_id
are scored alike if their texts are equal; conflicting labels of one id count as toxic; without usable labels the
score is the smoothed share of toxic labels; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import Words, crc32_text, held_out_mask, slices, table, utf8_texts, whole_text

HELD_OUT = 5
SAMPLE = 20_000
PREFIXES = (0, 4, 5, 6)  # bytes of a word that a lexicon looks at; 0: the whole word
MIN_TOXIC, MIN_SHARE = 4, 0.004  # toxic sampled texts with a marker: at least so many, and such a share of them
SURPRISE = 16.0  # least log-likelihood ratio of a marker against independence
STRONG, WEAK = 3.0, 1.5  # log odds
MAX_MARKERS = 20_000
ROUNDS = 60
N_VOTERS = 2 * len(PREFIXES) + 6


def kinds_of(w: Words) -> list[np.ndarray]:
    return [w.hash if k == 0 else w.prefix_hash(k) for k in PREFIXES]


@dataclass
class Model:
    """Sorted marker hashes per kind, their log odds, the label model and the classifier."""

    marks: list[np.ndarray]
    odds: list[np.ndarray]
    prior: float = 0.5
    vote_odds: np.ndarray = field(default_factory=lambda: np.zeros((N_VOTERS, 3)))
    weights: np.ndarray | None = None
    intercept: float = 0.0

    def __post_init__(self) -> None:
        self.sieves = []
        for m in self.marks:
            sieve = np.zeros(1 << 20, bool)
            sieve[(m & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.sieves.append(sieve)
        self.starts = np.cumsum([0, *map(len, self.marks)])

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, marker number, kind) of every marker occurrence."""
        doc, mark, kind = [], [], []
        for k, h in enumerate(kinds_of(w)):
            at = np.flatnonzero(self.sieves[k][(h & np.uint64((1 << 20) - 1)).astype(np.int64)]) if len(self.marks[k]) else np.empty(0, np.int64)
            place = np.minimum(np.searchsorted(self.marks[k], h[at]), max(0, len(self.marks[k]) - 1))
            good = self.marks[k][place] == h[at] if len(at) else np.empty(0, bool)
            doc.append(w.doc[at[good]])
            mark.append(place[good] + self.starts[k])
            kind.append(np.full(int(good.sum()), k))
        return np.concatenate(doc), np.concatenate(mark), np.concatenate(kind)

    def votes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(votes per document: 1 toxic, -1 clean, 0 none; document and marker of each distinct marker hit)."""
        w = Words(texts)
        n = len(texts)
        doc, mark, kind = self.hits(w)
        odds = np.concatenate(self.odds)[mark] if len(mark) else np.empty(0)
        pair, first, often = np.unique(doc * np.int64(1 << 32) + mark, return_index=True, return_counts=True)
        d, m = doc[first], mark[first]
        out = np.zeros((n, N_VOTERS), np.int8)
        strong_any = np.zeros(n, np.int64)
        for k in range(len(PREFIXES)):
            own = kind[first] == k
            strong = np.bincount(d[own & (odds[first] >= STRONG)], minlength=n)
            weak = np.bincount(d[own & (odds[first] < STRONG)], minlength=n)
            out[:, 2 * k] = np.where(strong > 0, 1, -1)
            out[:, 2 * k + 1] = np.where(weak > 1, 1, 0)
            strong_any += strong
        v = 2 * len(PREFIXES)
        total = np.bincount(doc, minlength=n)
        size = np.maximum(w.counts, 1)
        out[:, v] = np.where(strong_any >= 3, 1, np.where(strong_any == 0, -1, 0))
        out[:, v + 1] = np.where(np.bincount(d, often, n) >= 4, 1, np.where(total == 0, -1, 0))
        out[:, v + 2] = np.where(total * 100 >= size, 1, np.where(total * 1000 < size, -1, 0))
        out[:, v + 3] = np.where(total > 0, 0, -1)
        out[:, v + 4] = [1 if b"!!" in t else 0 for t in texts]
        out[:, v + 5] = [1 if sum(map(t.count, (b"#", b"$", b"%", b"&"))) * 20 < len(t) else -1 for t in texts]
        return out, d, m


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of at most about ``SAMPLE`` labelled training rows, chosen by id hash."""
    train = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc32_text() % HELD_OUT != 0))
    train = train.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    return docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(ids), "doc_id").select("text", "toxic")


def find_markers(sample: DataFrame) -> Model:
    """Markers from counts of distinct words and prefixes in toxic and clean sampled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            toxic = piece.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            w = Words(utf8_texts(piece))
            for k, h in enumerate(kinds_of(w)):
                keep = h != 0
                docs_, marks = w.doc[keep], h[keep].view(np.int64)
                order = np.lexsort((docs_, marks))
                docs_, marks = docs_[order], marks[order]
                new = np.ones(len(marks), bool)
                new[1:] = (marks[1:] != marks[:-1]) | (docs_[1:] != docs_[:-1])
                docs_, marks = docs_[new], marks[new]
                first = np.flatnonzero(np.concatenate(([True], marks[1:] != marks[:-1]))) if len(marks) else np.empty(0, np.int64)
                if len(first):
                    pos = np.add.reduceat(toxic[docs_], first)
                    n = np.diff(np.concatenate((first, [len(marks)])))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), k, np.int32)), pa.array(marks[first]), pa.array(pos), pa.array(n - pos)], ["kind", "mark", "pos", "neg"])

    totals = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("p"), F.count("*").alias("n")).first()
    p, n = totals["p"], totals["n"] - totals["p"]
    prior = (p + 1) / (p + n + 2)
    none = [np.empty(0, np.uint64) for _ in PREFIXES], [np.empty(0) for _ in PREFIXES]
    if not p or not n:
        return Model(*none, prior=prior)
    counts = sample.mapInArrow(run, "kind int, mark bigint, pos bigint, neg bigint").groupBy("kind", "mark").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / F.lit(p + 1.0)) - F.log((F.col("neg") + 0.5) / F.lit(n + 1.0))
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    seen = F.col("pos") + F.col("neg")
    surprise = 2 * (
        part(F.col("pos"), seen * p / (p + n)) + part(F.col("neg"), seen * n / (p + n)) + part(p - F.col("pos"), (p + n - seen) * p / (p + n)) + part(n - F.col("neg"), (p + n - seen) * n / (p + n))
    )
    found = counts.filter(F.col("pos") >= max(MIN_TOXIC, MIN_SHARE * p)).withColumn("odds", odds).filter((F.col("odds") >= WEAK) & (surprise >= SURPRISE))
    rows = found.orderBy(F.desc(F.col("odds") * F.log1p("pos")), "kind", "mark").limit(MAX_MARKERS).toPandas()
    marks, weights = none
    for k in range(len(PREFIXES)):
        own = rows[rows["kind"] == k]
        m = own["mark"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(m)
        marks[k], weights[k] = m[order], own["odds"].to_numpy(np.float64)[order]
    return Model(marks, weights, prior=prior)


def vote_patterns(docs: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Distinct vote patterns of all documents and how many documents have each."""
    scale = 3 ** np.arange(N_VOTERS, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            votes, _, _ = model.votes(utf8_texts(piece))
            codes, n = np.unique((votes.astype(np.int64) + 1) @ scale, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64))], ["pattern", "n"])

    made = docs.select(whole_text().alias("text")).mapInArrow(run, "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toPandas()
    codes = made["pattern"].to_numpy(np.int64)
    return (codes[:, None] // scale[None, :] % 3 - 1).astype(np.int8), made["n"].to_numpy(np.float64)


def fit_label_model(model: Model, patterns: np.ndarray, n: np.ndarray, votes: np.ndarray, toxic: np.ndarray) -> None:
    """Vote probabilities per class by expectation maximisation; log odds discounted by within-class correlation.

    The sampled rows' labelled votes start the model and stay in it as counts, so its classes keep their meaning.
    """
    if not len(n):
        return
    values = (-1, 0, 1)
    onehot = np.stack([patterns == v for v in values], axis=2).astype(np.float64)
    known = np.stack([votes == v for v in values], axis=2).astype(np.float64) if len(votes) else np.zeros((0, N_VOTERS, 3))
    anchor = [known[toxic].sum(axis=0), known[~toxic].sum(axis=0)]
    # One vote of each kind a voter can cast, so none is impossible; the anchor weighs as much as all documents.
    scale = max(1.0, n.sum() / max(1, len(votes)))
    prior = model.prior
    post = None
    for _ in range(ROUNDS):
        prob = []
        for y in (0, 1):
            c = anchor[y] * scale + 1.0
            if post is not None:
                c = c + np.tensordot(n * (post if y == 0 else 1 - post), onehot, axes=(0, 0))
            prob.append(c / c.sum(axis=1, keepdims=True))
        odds = np.log(prob[0]) - np.log(prob[1])
        post = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + (onehot * odds).sum(axis=(1, 2)), -500, 500)))
    correlated = np.zeros((N_VOTERS, N_VOTERS))
    for weight in (n * post, n * (1 - post)):
        if weight.sum() > 1:
            x = patterns - np.average(patterns, axis=0, weights=weight)
            cov = (x * weight[:, None]).T @ x / weight.sum()
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            correlated += weight.sum() / n.sum() * np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(correlated, 0)
    model.vote_odds = odds / (1 + correlated.sum(axis=1))[:, None]


def posterior(model: Model, votes: np.ndarray) -> np.ndarray:
    odds = np.log(model.prior / (1 - model.prior)) + model.vote_odds[np.arange(N_VOTERS)[None, :], votes + 1].sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def sample_features(model: Model, sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(toxic, votes, row and marker of each marker hit) of the sampled rows; at most ``SAMPLE`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            votes, d, m = model.votes(utf8_texts(piece))
            cut = np.searchsorted(d, np.arange(piece.num_rows + 1))
            marks = [m[a:b] for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([piece.column("toxic").cast(pa.int32()), pa.array(list(votes.astype(np.int32)), pa.list_(pa.int32())), pa.array(marks, pa.list_(pa.int64()))], ["toxic", "votes", "marks"])

    rows = sample.mapInArrow(run, "toxic int, votes array<int>, marks array<bigint>").toPandas()
    votes = np.array(rows["votes"].tolist(), np.int8).reshape(-1, N_VOTERS)
    length = rows["marks"].map(len).to_numpy(np.int64)
    hits = np.concatenate(rows["marks"].to_numpy()).astype(np.int64) if length.sum() else np.empty(0, np.int64)
    return rows["toxic"].to_numpy() > 0, votes, np.repeat(np.arange(len(rows)), length), hits


def fit_classifier(model: Model, toxic: np.ndarray, votes: np.ndarray, r: np.ndarray, c: np.ndarray) -> None:
    """Logistic regression on marker presence and votes, on posterior labels of the sampled texts."""
    n_marks, n = int(model.starts[-1]), len(toxic)
    model.weights = np.zeros(n_marks + N_VOTERS)
    model.intercept = float(np.log(model.prior / (1 - model.prior)))
    if not n or not n_marks:
        return
    y = posterior(model, votes)
    w, b = np.zeros(n_marks + N_VOTERS), model.intercept
    velocity, vb = np.zeros_like(w), 0.0
    for step in range(600):  # Nesterov gradient steps on the L2-regularised mean log loss
        look, lb = w + 0.9 * velocity, b + 0.9 * vb
        z = lb + votes @ look[n_marks:] + np.bincount(r, look[c], n)
        g = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / n
        grad = np.concatenate((np.bincount(c, g[r], n_marks), votes.T @ g)) + 1e-5 * look
        rate = 0.3 / (1 + step / 300)
        velocity, vb = 0.9 * velocity - rate * grad, 0.9 * vb - rate * g.sum()
        w, b = w + velocity, b + vb
    z = votes @ w[n_marks:] + np.bincount(r, w[c], n)
    # The intercept puts the score 0.5 where the sample's labels are separated with the least error.
    order = np.argsort(-z, kind="stable")
    zs, ts = z[order], toxic[order]
    errors = np.concatenate(([ts.sum()], ts.sum() - np.cumsum(ts) + np.cumsum(~ts)))
    edge = np.concatenate(([True], np.diff(zs) < -1e-9, [True]))
    errors = np.where(edge, errors, errors.max() + 1)
    k = int(np.argmin(errors))
    at = zs[0] + 1 if k == 0 else zs[-1] - 1 if k == n else (zs[k - 1] + zs[k]) / 2
    model.weights, model.intercept = w, float(-at)


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> Model:
    sample = labelled_sample(docs, labels)
    model = find_markers(sample)
    toxic, votes, rows, hits = sample_features(model, sample)
    fit_label_model(model, *vote_patterns(docs, model), votes, toxic)
    fit_classifier(model, toxic, votes, rows, hits)
    return model


def scores(model: Model, texts: list[bytes]) -> np.ndarray:
    votes, d, m = model.votes(texts)
    z = model.intercept + votes @ model.weights[model.starts[-1] :] + np.bincount(d, model.weights[m], len(texts))
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def score_toxicity(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    more = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "tox_text"):
            s = scores(model, utf8_texts(piece, "tox_text"))
            cols = [piece.column("doc_id"), pa.array(held_out_mask(piece.column("doc_id").to_pylist(), HELD_OUT)), pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*cols, *(piece.column(c) for c in keep)], ["doc_id", "held_out", "score", "predicted", *keep])

    return docs.select("doc_id", whole_text().alias("tox_text"), *keep).mapInArrow(run, f"doc_id {id_type}, held_out boolean, score double, predicted int{more}")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs``, all columns as they are, whose text is not predicted toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            yield piece.filter(pa.array(scores(model, utf8_texts(piece)) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
