"""Shared helpers: shared-folder tables, Arrow batch slicing, and a vectorised word kernel."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, or, in local mode alone, a local one where unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found or f"file://{os.path.join(tempfile.gettempdir(), 'spanloom-shared')}"


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut, lost executors do no harm."""
    path = shared_path(df.sparkSession, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def crc32_text(column: str = "doc_id"):
    """crc32 of a document id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def held_out_mask(ids: list, modulus: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(b"" if i is None else str(i).encode()) % modulus == 0 for i in ids), bool, len(ids))


#: The one large helper that this Python worker keeps between tasks, by its owner.
_KEPT: dict[tuple, object] = {}


def kept(owner: tuple, build: Callable[[], object] | None = None):
    """What ``build`` made for ``owner`` in this process. Another owner's is dropped: Spark reuses Python workers for later stages."""
    if owner not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            gc.collect()
            give_back()
        if build is not None:
            _KEPT[owner] = build()
    return _KEPT.get(owner)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, owner: tuple = ()) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of each piece hold about ``limit`` bytes; a longer text is a piece of its own.

    What this worker keeps for others than ``owner`` is dropped first. After the last piece, freed memory is given back.
    """
    kept(owner)
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        group = np.cumsum(sizes) // limit
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(int(a), int(b - a))
    give_back()


def give_back() -> None:
    """Return freed memory of this process to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def utf8_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's values as UTF-8 bytes, nulls as empty bytes."""
    return [b"" if x is None else x for x in batch.column(column).cast(pa.binary()).to_pylist()]


# ---- word kernel: all words of many texts at once, with 64-bit hashes --------------------------
# A word's hash is the sum of one random number for each (place, byte). Unlike a polynomial modulo 2 ** 64 no family of
# words collides by its form (Thue-Morse words do there); among 10 ** 9 words a chance collision has a probability of 3 %.
_RNG = np.random.Generator(np.random.PCG64(20240101))
_PLACES = 32
_BYTE = _RNG.integers(0, 2**64, _PLACES << 8, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (bijective)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts, A-Z lower-cased: ``doc`` index and ``hash`` of each, in text order."""

    def __init__(self, texts: list[bytes]) -> None:
        joined = np.frombuffer(b"\n".join(texts), np.uint8)
        self.n_docs = len(texts)
        self.raw = _LOWER[joined]
        inside = ~_SEPARATOR[self.raw]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        self.length = self.end - self.start
        base = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.start, base)  # of each text: index of its first word
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.counts)
        self._at = np.flatnonzero(inside)
        self._word0 = np.cumsum(self.length) - self.length
        self._offset = np.arange(len(self._at)) - np.repeat(self._word0, self.length)
        self._parts = None

    def _contributions(self) -> np.ndarray:
        if self._parts is None:
            key = (self._offset << 8) | self.raw[self._at]
            far = np.flatnonzero(self._offset >= _PLACES)
            if len(far):
                late = mix64(key[far].astype(np.uint64) * _BASE + _BYTE[0])
                key[far] = 0
            self._parts = _BYTE[key]
            if len(far):
                self._parts[far] = late
        return self._parts

    @property
    def hash(self) -> np.ndarray:
        return mix64(self._sums() + self.length.astype(np.uint64))

    def _sums(self) -> np.ndarray:
        return np.add.reduceat(self._contributions(), self._word0) if len(self.start) else np.empty(0, np.uint64)

    def without_last(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of these words: the hash of all but the last byte, and the hash of the last byte as a word of its own."""
        last = self._word0[which] + self.length[which] - 1
        rest = mix64(self._sums()[which] - self._contributions()[last] + (self.length[which] - 1).astype(np.uint64))
        return rest, mix64(_BYTE[self.raw[self._at[last]]] + np.uint64(1))

    def prefix_hash(self, k: int) -> np.ndarray:
        """Hash of each word's first ``k`` bytes; 0 where the word is not longer than that."""
        if not len(self.start):
            return np.empty(0, np.uint64)
        cut = np.where(self._offset < k, self._contributions(), np.uint64(0))
        h = mix64(np.add.reduceat(cut, self._word0) + np.uint64(1_000_003 * k))
        return np.where(self.length > k, h, np.uint64(0))


def ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices of consecutive ranges, one behind the other."""
    upto = np.cumsum(length)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(begin - (upto - length), length)


class RangeCache:
    """Sequences by 64-bit key, in sorted arrays of two generations of at most ``limit`` keys each.

    A full young generation becomes the old one, and what is used again returns. ``kinds`` has the type of each
    sequence that a key holds.
    """

    def __init__(self, limit: int, kinds: list) -> None:
        self.limit = limit
        none = np.empty(0, np.int64)
        self.young = self.old = (np.empty(0, np.uint64), [(none, none, np.empty(0, k)) for k in kinds])

    @staticmethod
    def find(generation: tuple, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held = generation[0]
        place = np.searchsorted(held, keys)
        hit = place < len(held)
        hit[hit] = held[place[hit]] == keys[hit]
        return place, hit

    @staticmethod
    def taken(generation: tuple, place: np.ndarray) -> tuple[np.ndarray, list]:
        """(keys, [(lengths, values), ...]) of the entries at ``place``."""
        return generation[0][place], [(n[place], values[ranges(begin[place], n[place])]) for begin, n, values in generation[1]]

    def add(self, parts: list[tuple[np.ndarray, list]]) -> None:
        held, columns = self.young
        keys = np.concatenate([p[0] for p in parts])
        order = np.argsort(keys)
        at = np.searchsorted(held, keys[order])
        made = []
        for k, (begin, length, values) in enumerate(columns):
            sizes = np.concatenate([p[1][k][0] for p in parts])
            starts = np.cumsum(sizes) - sizes + len(values)
            made.append((np.insert(begin, at, starts[order]), np.insert(length, at, sizes[order]), np.concatenate([values, *(p[1][k][1] for p in parts)])))
        self.young = (np.insert(held, at, keys[order]), made)

    def get(self, keys: np.ndarray, learn) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """[(begin, length, values), ...] of sorted distinct keys; ``learn(which)`` gives [(lengths, values), ...] of those not held."""
        place, hit = self.find(self.young, keys)
        if not hit.all():
            new, parts = np.flatnonzero(~hit), []
            if len(self.young[0]) + len(new) > self.limit:
                self.old = self.young
                parts.append(self.taken(self.old, place[hit]))
                self.young = (self.old[0][:0], [(b[:0], n[:0], v[:0]) for b, n, v in self.old[1]])
            back, again = self.find(self.old, keys[new])
            parts.append(self.taken(self.old, back[again]))
            fresh = new[~again]
            if len(fresh):
                parts.append((keys[fresh], learn(fresh)))
            self.add(parts)
            place, _ = self.find(self.young, keys)
        return [(begin[place], length[place], values) for begin, length, values in self.young[1]]


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores behind it until no column is called so (letter case aside)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def out_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
