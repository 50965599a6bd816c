"""Operator 9: byte-level BPE encoding and decoding by DuckDB recursive queries inside Spark partitions.

A task cuts its texts with the pre-token pattern and lists the distinct pre-tokens it has not met. For
those, one recursive query runs in the task's own DuckDB (one thread, bounded memory): rows (word,
position, token) join the merge table, each word's leftmost pair of minimum rank is contracted, until no
word has a pair. An ordered aggregation over (word, position) joined to the vocabulary decodes the ids
again. Documents are the concatenation of their words' ids, so whole texts are encoded without any
shuffle; the word cache is bounded, which costs time but never results.

Pre-tokens of more than ``LONG_WORD`` bytes would need as many rounds as bytes; they are contracted by the
same rule with a heap, in the task.

Defined results: null or empty texts give no ids; repeated rows repeat; extra columns are ignored; bytes
that form no text decode to themselves.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.common import RangeCache, give_back, kept, ranges, slices, table, whole_text

LONG_WORD = 400
CACHE_WORDS = 300_000
QUERY_WORDS = 10_000
DUCKDB_MEMORY = "64MB"
_SHIFT = 20
_PAIR = 20


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


ENCODE = f"""
WITH RECURSIVE state AS (
  SELECT word, pos, token, false AS done FROM start_rows
  UNION ALL
  SELECT * FROM (
    WITH near AS (
      SELECT word, pos, token, lead(token) OVER o AS after, lag(pos) OVER o AS before
      FROM state WHERE NOT done WINDOW o AS (PARTITION BY word ORDER BY pos)
    ), best AS (
      SELECT word, min(merged << {_SHIFT} | pos) AS pick FROM near JOIN merges ON pair = (token << {_PAIR} | after) GROUP BY word
    )
    SELECT near.word, pos, CASE WHEN pos = pick & {(1 << _SHIFT) - 1} THEN pick >> {_SHIFT} ELSE token END, pick IS NULL
    FROM near LEFT JOIN best USING (word)
    WHERE before IS NULL OR pick IS NULL OR before <> pick & {(1 << _SHIFT) - 1}
  )
)
SELECT word, pos, token FROM state WHERE done ORDER BY word, pos
"""

DECODE = """
SELECT word, string_agg(chars, '' ORDER BY pos) AS chars FROM coded JOIN vocabulary USING (token) GROUP BY word ORDER BY word
"""


class Codec:
    """Encoder and decoder of one task process: a DuckDB connection with merge table and vocabulary, and the word cache."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import duckdb
        import regex

        self.ranks = read_ranks(ranks_path)
        self.find = regex.compile(pattern).findall
        self.byte_token = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        splits = ((self.ranks[t[:i]] << _PAIR | self.ranks[t[i:]], k) for t, k in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks)
        pairs = np.fromiter(splits, np.dtype((np.int64, 2)))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY})
        self.db.execute("SET preserve_insertion_order = false")
        self._load("merges", pa.table({"pair": np.ascontiguousarray(pairs[:, 0]), "merged": np.ascontiguousarray(pairs[:, 1])}))
        # Bytes travel as Latin-1 characters, so text aggregates serve for bytes.
        self._load("vocabulary", pa.table({"token": pa.array(list(self.ranks.values()), pa.int64()), "chars": [t.decode("latin-1") for t in self.ranks]}))
        self.cache = RangeCache(CACHE_WORDS, ["<u4", np.uint8])
        give_back()

    def _load(self, name: str, rows: pa.Table) -> None:
        self.db.register("incoming", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def _long(self, word: bytes) -> list[int]:
        """The same contraction with a heap of (rank, position), for very long words."""
        tokens = [int(self.byte_token[b]) for b in word]
        spelled = [bytes([b]) for b in word]
        n = len(tokens)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = []

        def push(i: int) -> None:
            if i >= 0 and after[i] < n:
                joined = spelled[i] + spelled[after[i]]
                if joined in self.ranks:
                    heapq.heappush(heap, (self.ranks[joined], i, joined))

        for i in range(n - 1):
            push(i)
        while heap:
            rank, i, joined = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or spelled[i] + spelled[after[i]] != joined:
                continue
            j = after[i]
            tokens[i], spelled[i], alive[j], after[i] = rank, joined, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            push(before[i])
            push(i)
        return [t for t, a in zip(tokens, alive) if a]

    def decode_words(self, counts: np.ndarray, tokens: np.ndarray) -> list[bytes]:
        """Bytes of consecutive id sequences of the given lengths, by ordered aggregation."""
        word = np.repeat(np.arange(len(counts)), counts)
        pos = np.arange(len(tokens)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.db.register("coded", pa.table({"word": word, "pos": pos, "token": tokens.astype(np.int64)}))
        got = self.db.execute(DECODE).fetchnumpy()
        self.db.unregister("coded")
        out = [b""] * len(counts)
        for w, chars in zip(got["word"].tolist(), got["chars"]):
            out[w] = chars.encode("latin-1")
        return out

    def _contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words)), lengths)
        pos = np.arange(len(raw)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.db.register("start_rows", pa.table({"word": word.astype(np.int32), "pos": pos, "token": self.byte_token[raw]}))
        got = self.db.execute(ENCODE).fetchnumpy()
        self.db.unregister("start_rows")
        return np.bincount(got["word"], minlength=len(words)), np.asarray(got["token"], np.int64)

    def learn(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """[(number of ids, ids), (number of bytes, bytes decoded from the ids)] of words, in their order."""
        counts, ids = np.zeros(len(words), np.int64), []
        raw = [w.encode("utf-8") for w in words]
        short = [i for i, b in enumerate(raw) if len(b) <= LONG_WORD]
        long = [i for i, b in enumerate(raw) if len(b) > LONG_WORD]
        for at in range(0, len(short), QUERY_WORDS):
            part = short[at : at + QUERY_WORDS]
            counts[part], got = self._contract([raw[i] for i in part])
            ids.append(got)
        for i in long:
            ids.append(np.array(self._long(raw[i]), np.int64))
            counts[i] = len(ids[-1])
        order = np.array(short + long)
        begin = np.empty(len(words), np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        tokens = np.concatenate(ids)[ranges(begin, counts)]
        upto, decoded = np.cumsum([0, *counts]), []
        for at in range(0, len(words), QUERY_WORDS):
            own = counts[at : at + QUERY_WORDS]
            decoded += self.decode_words(own, tokens[upto[at] : upto[at + len(own)]])
        return [(counts, tokens.astype("<u4")), (np.fromiter(map(len, decoded), np.int64, len(decoded)), np.frombuffer(b"".join(decoded), np.uint8))]

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """(ids as little-endian unsigned 32-bit integers, bytes decoded from the ids) of each text."""
        pieces = [self.find(t) for t in texts]
        words = list(chain.from_iterable(pieces))
        if not words:
            yield from ((b"", b"") for _ in texts)
            return
        keys = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        uniq, at, back = np.unique(keys, return_index=True, return_inverse=True)
        both = self.cache.get(uniq, lambda which: self.learn([words[i] for i in at[which].tolist()]))
        first = np.cumsum([0, *map(len, pieces)])
        joined = []
        for begin, length, values in both:
            own = length[back]
            edge = np.concatenate(([0], np.cumsum(own)))[first].tolist()
            flat = values[ranges(begin[back], own)]
            joined.append([flat[a:b].tobytes() for a, b in zip(edge, edge[1:])])
        for text, found, ids, decoded in zip(texts, pieces, *joined):
            if decoded != text.encode("utf-8"):  # two words of one hash: this text without the cache
                ids, decoded = (v.tobytes() for _, v in self.learn(found))
            yield ids, decoded


def codec(ranks_path: str, pattern: str) -> Codec:
    """This process's codec; Spark reuses Python workers, so its cache outlives a task, until another operator uses the worker."""
    return kept(("bpe", ranks_path, pattern), lambda: Codec(ranks_path, pattern))


def encode(docs: DataFrame, ranks_path: str, pattern: str, digests: bool = False, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) per row, or with ``digests`` the SHA-256 of ids and decoded bytes instead, ``with_ids`` behind the ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for part in slices(batches, "text", owner=("bpe", ranks_path, pattern)):
            both = list(own.encode_batch(part.column("text").to_pylist()))
            n = pa.array([len(i) // 4 for i, _ in both], pa.int64())
            cols = {"doc_id": part.column(0), "n_tokens": n}
            if with_ids or not digests:
                cols["ids"] = pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i, _ in both], pa.list_(pa.int32()))
            if digests:
                cols |= {name: pa.array([hashlib.sha256(x[k]).hexdigest() for x in both], pa.string()) for k, name in enumerate(("ids_sha256", "decoded_sha256"))}
            else:
                cols["decoded"] = pa.array([d for _, d in both], pa.binary())
            made = pa.RecordBatch.from_arrays(list(cols.values()), list(cols))
            del both, cols
            give_back()  # what a piece has used would else stay with the process until the batch ends
            yield made

    tail = ("ids array<int>, " if with_ids or not digests else "") + ("ids_sha256 string, decoded_sha256 string" if digests else "decoded binary")
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, {tail}")


def decode(coded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, decoded) of rows (doc_id, ids array<int>); null ids decode to no bytes."""
    kind = coded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            ids = [np.asarray(x if x is not None else [], np.int64) for x in batch.column("ids").to_pylist()]
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            out = own.decode_words(counts, np.concatenate(ids) if ids else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return coded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, decoded binary")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), default_ranks(), default_pattern(), digests=True)
