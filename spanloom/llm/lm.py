"""Operator 7: language-model scoring with an Elias-Fano n-gram trie.

Level 1 holds every training word: sorted 63-bit word hashes and counts. Level k > 1 holds the children of level k - 1:
each context's words (places in level 1) stand together in ascending order. A level is one Elias-Fano sequence: a
word is stored as its place plus the last value before its context's range, which keeps the sequence monotone, so
values are relative to the context and need no product of level sizes. Beside it stands one byte an n-gram for its
smoothed, quantised probability. A level's contexts are a second Elias-Fano sequence with a quantised back-off weight and the
monotone pointer to the context's first child. A query finds its context, takes the child range from the pointers,
and searches the word's successor inside that range.

Building level k is one pass over the training texts that looks up levels 1 .. k-1, one shuffle of (context, word) with
counts combined in the task, and a range partitioning of the pairs that survive ``MIN_COUNTS``; every range becomes
one shard written by its own task, so no task sees a whole level, and a context with very many children is
spread over shards. An n-gram can only survive if its prefix and suffix did, so others are never shuffled. Shards
lie in the shared folder and tasks map them into memory (from a store without local paths, a bounded number are held);
the driver holds only the list of shards.

Probabilities: unigrams (c + 0.1) / (N + 0.1 * (V + 1)); above, interpolated absolute discounting, a context's
mass that pruning or discounting frees going to the next lower level.

Defined results: null or empty texts hold the end token alone; an empty training set scores by the base formula
with N = V = 0; repeated rows repeat; null ids count as training documents unless crc32 of no bytes says otherwise.
"""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import Words, give_back, held_out_mask, materialise, mix64, shared_path, slices, table, utf8_texts, whole_text

#: Least count of an n-gram that is kept, by its length: all words, then what occurs twice (figures in the README).
MIN_COUNTS = (1, 2, 2)
DISCOUNT = 0.75
ALPHA = 0.1
HELD_OUT = 10
#: Keys of a range that becomes a shard; a range that came out a quarter longer is cut. A task holds up to 200 bytes a key while it builds one.
SHARD_KEYS = 1_000_000
#: Training tokens for each task that adds up pairs, buckets in each, and pairs that a task holds (at about 130 bytes) before it deals them out.
PART_TOKENS, BUCKETS, BLOCK_PAIRS = 1_000_000, 8, 500_000
OPEN_SHARDS = 128
#: Of texts that are looked up together: each distinct n-gram of a piece is looked up once.
PIECE_BYTES = 2_000_000
STEP = 1 / 32  # of quantised log10 probabilities
END = np.int64(1)  # the end token's hash


# ---- Elias-Fano sequences -------------------------------------------------------------------
_SELECT = np.zeros((256, 8), np.uint8)
for _v in range(256):
    for _k, _bit in enumerate([b for b in range(8) if _v >> b & 1]):
        _SELECT[_v, _k] = _bit
_SELECT = _SELECT.ravel()
_PAIRS, _NIBBLES, _HALVES, _ONES, _TOPS = (np.uint64(x) for x in (0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F, 0x0101010101010101, 0x8080808080808080))
_U = [np.uint64(k) for k in range(9)]


def select_bit(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the set bit number ``k``, counted from 0, of each 64-bit word: all eight bytes are counted at once."""
    upto = x - ((x >> _U[1]) & _PAIRS)
    upto = (upto & _NIBBLES) + ((upto >> _U[2]) & _NIBBLES)
    upto = ((upto + (upto >> _U[4])) & _HALVES) * _ONES  # byte i: set bits in bytes 0 .. i
    shift = np.bitwise_count(((k * _ONES | _TOPS) - upto) & _TOPS).astype(np.uint64) << _U[3]
    left = k - (((upto << _U[8]) >> shift) & np.uint64(255))
    return (shift + _SELECT.take((((x >> shift) & np.uint64(255)) << _U[3] | left).astype(np.int64))).astype(np.int64)


class EliasFano:
    """A non-decreasing sequence of integers; all queries are vectorised."""

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.n, self.base, self.top, self.bits = (int(x) for x in arrays["meta"])
        self.width = -(-self.bits // 8)
        self.high, self.zeros, self.ones = np.asarray(arrays["high"]), np.asarray(arrays["zeros"]), None
        # Lowest bits: little-endian numbers of ``width`` bytes, each read with the bytes behind it and masked.
        self.low = np.ndarray(self.n, "<u8", np.asarray(arrays["low"]), strides=(self.width,)) if self.width else None
        self.mask = np.uint64((1 << self.bits) - 1)

    @staticmethod
    def build(values: np.ndarray) -> dict[str, np.ndarray]:
        n, base, top = len(values), int(values[0]), int(values[-1])
        v = (values - base).astype(np.uint64)
        bits = max(0, ((top - base + 1) // n).bit_length() - 1)
        bits -= bits % 8 if bits % 8 <= 2 else 0
        width = -(-bits // 8)
        low = (v & np.uint64((1 << bits) - 1)).astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
        high = (v >> np.uint64(bits)).astype(np.int64)
        unary = np.zeros(-(-(n + int(high[-1]) + 2) // 64) * 64, np.uint8)
        unary[high + np.arange(n)] = 1
        words = np.packbits(unary, bitorder="little").view("<u8")
        zeros = np.concatenate(([0], np.cumsum(64 - np.bitwise_count(words).astype(np.int64))))
        return {
            "meta": np.array([n, base, top, bits], np.int64), "low": np.concatenate((low.ravel(), np.zeros(8, np.uint8))), "high": words,
            "zeros": zeros.astype(np.uint32 if zeros[-1] < 1 << 32 else np.int64),
        }

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Position of the one or zero number ``k``, counted from 0."""
        if ones and self.ones is None:
            self.ones = (np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros).astype(self.zeros.dtype)
        edge = self.ones if ones else self.zeros
        word = np.searchsorted(edge, k.astype(edge.dtype), side="right") - 1
        bits = self.high.take(word)
        return word * 64 + select_bit(bits if ones else ~bits, (k - edge.take(word)).astype(np.uint64))

    def _select_two(self, k: np.ndarray, ones: bool) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the ones or zeros number ``k`` and ``k + 1``: the second mostly stands in the same word."""
        first = self._select(k, ones)
        word = first >> 6
        bits = self.high.take(word)
        rest = (bits if ones else ~bits) & ~((_U[2] << (first & 63).astype(np.uint64)) - _U[1])
        second = (word << 6) + np.bitwise_count((rest & (~rest + _U[1])) - _U[1])
        far = np.flatnonzero(rest == 0)
        if len(far):
            second[far] = self._select(k[far] + 1, ones)
        return first, second

    def access(self, i: np.ndarray) -> np.ndarray:
        """Elements at the places ``i``."""
        return self._value(self._select(i, True), i)

    def access_two(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Elements at the places ``i`` and ``i + 1``."""
        first, second = self._select_two(i, True)
        return self._value(first, i), self._value(second, i + 1)

    def _value(self, position: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.base + (((position - i) << self.bits) | self._low(i).astype(np.int64))

    def _low(self, i: np.ndarray) -> np.ndarray:
        return self.low[i] & self.mask if self.width else np.zeros(len(i), np.uint64)

    def within(self, x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Place of ``x`` among the elements first .. last - 1; -1 where its successor there is another value."""
        place = np.full(len(x), -1, np.int64)
        at = np.flatnonzero((x >= self.base) & (x <= self.top) & (first < last))
        if not len(at):
            return place
        y = (x[at] - self.base).astype(np.int64)
        h = y >> self.bits
        want = y.astype(np.uint64) & self.mask
        before = np.maximum(h - 1, 0)
        lo, hi = (x - before for x in self._select_two(before, False))
        hi = np.where(h > 0, hi - 1, lo)
        lo[h == 0] = 0
        lo, hi = np.maximum(lo, first[at]), np.minimum(hi, last[at])
        # Elements of a range differ, so a search may stop at its value.
        act = np.flatnonzero(lo < hi)
        lo, hi, want = lo[act], hi[act], want[act]
        while len(act):
            mid = (lo + hi) >> 1
            low = self._low(mid)
            same = np.flatnonzero(low == want)
            place[at[act[same]]] = mid[same]
            less = low < want
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
            lo[same] = hi[same]
            left = np.flatnonzero(lo < hi)
            act, lo, hi, want = act[left], lo[left], hi[left], want[left]
        return place


# ---- shards in the shared folder --------------------------------------------------------------
def save_shard(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """Write arrays under a new name; only a committed task's name is ever used, so retries do no harm."""
    store, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else f"file:{folder}")
    name = uuid.uuid4().hex
    store.create_dir(f"{base}/{name}", recursive=True)
    for key, value in arrays.items():
        with store.open_output_stream(f"{base}/{name}/{key}.npy") as out:
            np.save(out, value)
    return name


_OPEN: dict[str, dict] = {}


def open_shard(folder: str, name: str) -> dict:
    """A shard's arrays, mapped into memory; from a store without local paths, read. At most ``OPEN_SHARDS`` stay open."""
    at = f"{folder}/{name}"
    if at not in _OPEN:
        store, base = fs.FileSystem.from_uri(at if "://" in at or at.startswith("/") else f"file:{at}")
        if isinstance(store, fs.LocalFileSystem):
            arrays = {f[:-4]: np.asarray(np.load(f"{base}/{f}", mmap_mode="r")) for f in os.listdir(base) if f.endswith(".npy")}
        else:
            arrays = {}
            for info in store.get_file_info(fs.FileSelector(base)):
                with store.open_input_stream(info.path) as f:
                    arrays[info.base_name[:-4]] = np.load(io.BytesIO(f.read()))
        while len(_OPEN) >= OPEN_SHARDS:
            _OPEN.pop(next(iter(_OPEN)))
        _OPEN[at] = arrays
    return _OPEN[at]


@dataclass
class Sharded:
    """One sequence in shards: (first key or context, first word, size, children, name) of each, in order."""

    folder: str
    shards: list[tuple[int, int, int, int, str]]

    def __post_init__(self) -> None:
        self.shards = sorted(self.shards)
        self.starts = np.cumsum([0, *(s[2] for s in self.shards)], dtype=np.int64)
        self.child_starts = np.cumsum([0, *(s[3] for s in self.shards)], dtype=np.int64)
        self.firsts = np.array([s[0] for s in self.shards], np.int64)

    def arrays(self, k: int) -> dict:
        return open_shard(self.folder, self.shards[k][4])

    def sequence(self, k: int, prefix: str = "") -> EliasFano:
        """A shard's sequence; made once for as long as the shard is open."""
        arrays = self.arrays(k)
        if (name := f"{prefix}sequence") not in arrays:
            arrays[name] = EliasFano({n: arrays[prefix + n] for n in ("meta", "low", "high", "zeros")})
        return arrays[name]

    def shard_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, side="right") - 1

    def find(self, x: np.ndarray, value: str) -> tuple[np.ndarray, np.ndarray]:
        """(place, or -1, of each of the sorted distinct keys; the stored value there)."""
        place, out = np.full(len(x), -1, np.int64), np.zeros(len(x), np.int64)
        cut = [*np.searchsorted(x, self.firsts).tolist(), len(x)]
        for k in range(len(self.shards)):
            a, b = cut[k], cut[k + 1]
            if a < b:
                arrays = self.arrays(k)
                ef = self.sequence(k)
                at = ef.within(x[a:b], np.zeros(b - a, np.int64), np.full(b - a, ef.n))
                same = at >= 0
                place[a:b][same] = at[same] + self.starts[k]
                out[a:b][same] = arrays[value][at[same]]
        return place, out

    def at(self, place: np.ndarray, value: str) -> np.ndarray:
        """A stored value at places in any order."""
        out, of = np.zeros(len(place), np.int64), self.shard_of(place)
        for k in np.unique(of).tolist():
            own = of == k
            out[own] = self.arrays(k)[value][place[own] - self.starts[k]]
        return out

    def children(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of contexts: range of their children in the next level, from the monotone pointers."""
        first, last = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        of = self.shard_of(place)
        for k in np.unique(of).tolist():
            own = of == k
            pointers = self.sequence(k, "pointer_")
            i = place[own] - self.starts[k]
            begin, end = pointers.access_two(i)
            first[own], last[own] = self.child_starts[k] + begin, self.child_starts[k] + end
        return first, last

    def before(self, first: np.ndarray) -> np.ndarray:
        """What the values of a range that begins at ``first`` are relative to: the element before it in its shard, or 0."""
        out, of = np.zeros(len(first), np.int64), self.shard_of(first)
        for k in np.unique(of).tolist():
            own = np.flatnonzero((of == k) & (first > self.starts[k]))
            if len(own):
                out[own] = self.sequence(k).access(first[own] - self.starts[k] - 1)
        return out

    def search(self, first: np.ndarray, last: np.ndarray, before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, or -1, and code) of words inside their contexts' ranges; a range may go over several shards."""
        place, code = np.full(len(word), -1, np.int64), np.zeros(len(word), np.int64)
        of, to = self.shard_of(first), self.shard_of(last - 1)
        long = np.flatnonzero(of < to)
        touched = set(np.unique(of).tolist()).union(*(range(a, b + 1) for a, b in set(zip(of[long].tolist(), to[long].tolist()))))
        for k in sorted(touched):
            own = np.flatnonzero((of <= k) & (to >= k))
            arrays, start = self.arrays(k), self.starts[k]
            base = np.where(of[own] == k, before[own], 0)
            at = self.sequence(k).within(base + word[own], np.maximum(first[own] - start, 0), np.minimum(last[own], self.starts[k + 1]) - start)
            hit = at >= 0
            place[own[hit]], code[own[hit]] = at[hit] + start, arrays["code"][at[hit]]
        return place, code


def quantise(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(np.maximum(p, 1e-30)) / STEP), 0, 255).astype(np.uint8)


def unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one of each distinct pair, sorted by pair; number of each pair's place among them). ``a`` and ``b`` are not negative."""
    if not len(a):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    width, shift = int(b.max()) + 1, len(a).bit_length()
    span = (int(a.max()) + 1) * width
    if span << shift < 1 << 63:  # numbers that carry their index sort several times as fast as indices
        key = ((a * np.int64(width) + b) << shift) | np.arange(len(a))
        key.sort()
        order = key & ((1 << shift) - 1)
        key >>= shift
        new = np.concatenate(([True], key[1:] != key[:-1]))
    else:
        order = np.argsort(a * np.int64(width) + b) if span < 1 << 63 else np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    back = np.empty(len(a), np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


@dataclass
class Model:
    words: Sharded
    n: int
    v: int
    levels: list[Sharded] = field(default_factory=list)  # of n-grams of 2, 3, ... words
    contexts: list[Sharded] = field(default_factory=list)

    def base(self, c: np.ndarray) -> np.ndarray:
        return (c + ALPHA) / (self.n + ALPHA * (self.v + 1))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(63-bit hash of every token with each text's end token, place of each token in its text, text of each token)."""
    w = Words(texts)
    ends = np.cumsum(w.counts + 1) - 1
    total = len(w.doc) + w.n_docs
    out = np.full(total, END, np.int64)
    inner = np.ones(total, bool)
    inner[ends] = False
    h = (w.hash >> np.uint64(1)).astype(np.int64)
    out[inner] = np.where(h <= END, END + 1, h)
    doc = np.repeat(np.arange(w.n_docs), w.counts + 1)
    return out, np.arange(total) - (ends - w.counts)[doc], doc


@dataclass
class Step:
    """Of one level, per token: the n-gram ending here (-1 none), its code, and whether its context has children, with that code.

    ``group`` numbers the distinct n-grams of the tokens in ascending order (-1 none), ``places`` has the place of each number.
    """

    place: np.ndarray
    code: np.ndarray
    context: np.ndarray
    context_code: np.ndarray
    group: np.ndarray
    places: np.ndarray


@dataclass
class Found:
    """Of the distinct words of tokens: place (-1 unknown) and count; ``group`` is each token's number among them."""

    places: np.ndarray
    counts: np.ndarray
    group: np.ndarray


def numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values, number of each element's among them)."""
    coded = pa.array(hashes).dictionary_encode()
    uniq = coded.dictionary.to_numpy()
    order = np.argsort(uniq)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return uniq[order], rank[coded.indices.to_numpy()]


def walk(model: Model, hashes: np.ndarray, place: np.ndarray) -> tuple[Found, list[Step]]:
    """The distinct words of tokens, and a step per level."""
    uniq, group = numbered(hashes)
    words = Found(*model.words.find(uniq, "count"), group)
    steps = []
    # The distinct n-grams of a level are the contexts of the next: their places ascend with their numbers.
    last, places = group, words.places
    n = len(hashes)
    for k, (level, contexts) in enumerate(zip(model.levels, model.contexts)):
        step = Step(np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, np.int64), np.full(n, -1, np.int64), np.empty(0, np.int64))
        at = np.flatnonzero(place >= k + 1)
        at = at[last[at - 1] >= 0]
        own = last[at - 1]
        at, own = at[places[own] >= 0], own[places[own] >= 0]
        if len(at) and level.shards:
            some = np.flatnonzero(places >= 0)
            parents = places[some]
            ctx, code = contexts.find(parents, "code")
            has, codes = np.zeros(len(places), bool), np.zeros(len(places), np.int64)
            has[some], codes[some] = ctx >= 0, code
            first, end, before = (np.zeros(len(places), np.int64) for _ in range(3))
            first[has], end[has] = contexts.children(ctx[ctx >= 0])
            before[has] = level.before(first[has])
            step.context[at] = has[own]
            step.context_code[at] = codes[own]
            inner = np.flatnonzero(has[own] & (words.places[group[at]] >= 0))
            at, own = at[inner], own[inner]
            one, again = unique_pairs(own, group[at])
            parent = own[one]
            step.places, codes = level.search(first[parent], end[parent], before[parent], words.places[group[at[one]]])
            step.group[at], step.place[at], step.code[at] = again, step.places[again], codes[again]
        steps.append(step)
        last, places = step.group, step.places
    return words, steps


def score_tokens(model: Model, hashes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known, log10 base probability, log10 model probability) of every token."""
    words, steps = walk(model, hashes, place)
    base = np.log10(model.base(words.counts))[words.group]
    score = base.copy()
    for step in steps:
        score = np.where(step.place >= 0, -step.code * STEP, score - np.where(step.context, step.context_code * STEP, 0.0))
    return (words.counts > 0)[words.group], base, score


# ---- building -------------------------------------------------------------------------------
def training_texts(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    for piece in slices(iter([batch]), "text", PIECE_BYTES):
        train = ~held_out_mask(piece.column("doc_id").to_pylist(), HELD_OUT)
        texts = [t for t, keep in zip(utf8_texts(piece), train) if keep]
        if texts:
            yield texts


def count_words(docs: DataFrame) -> DataFrame:
    """(key, n): counts of word hashes over training texts, combined per Arrow batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.unique(tokens(texts)[0], return_counts=True) for texts in training_texts(batch)]
            if parts:
                keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])

    made = docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, "key bigint, n bigint")
    return made.groupBy("key").agg(F.sum("n").alias("n"))


def dealt(pairs: list[tuple[np.ndarray, ...]], buckets: int) -> pa.RecordBatch:
    """(bucket, parent, word, low, n) of pairs, which are taken out of the list: one row a bucket, whose arrays are bytes."""
    parent, word, low, n = (np.concatenate(c) for c in zip(*pairs))
    pairs.clear()
    mixed = mix64(parent.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.astype(np.uint64)) % np.uint64(buckets)
    bucket = mixed.astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    some = np.flatnonzero(sizes)
    upto = np.concatenate(([0], np.cumsum(sizes[some])))
    cols = [
        pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer((upto * c.dtype.itemsize).astype(np.int32)), pa.py_buffer(c[order])])
        for c in (parent.astype("<i8"), word.astype("<i8"), low.astype("<i2"), n.astype("<i8"))
    ]
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *cols], ["bucket", "parent", "word", "low", "n"])


def count_pairs(docs: DataFrame, model: Model, k: int, least: int) -> DataFrame:
    """(parent, word, low, n): level-k n-grams whose prefix and suffix are in the level below, with the suffix's code.

    Pairs go through the shuffle as arrays, one for each of many buckets, and a bucket's counts are added up in numpy: a row a pair
    costs Spark a microsecond, before and behind the shuffle. Buckets number with the tokens, so what is in memory is bounded.
    """
    parts = max(1, -(-model.n // PART_TOKENS))
    buckets = parts * BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for texts in training_texts(batch):
                hashes, place, _ = tokens(texts)
                words, steps = walk(model, hashes, place)
                if steps:
                    last, places = steps[-1].group, steps[-1].places
                else:
                    last, places = words.group, np.where(words.counts >= least, words.places, -1)
                kept_here = last >= 0
                kept_here[kept_here] = places[last[kept_here]] >= 0
                at = np.flatnonzero(kept_here & (place >= k - 1))
                at = at[kept_here[at - 1]]
                if len(at):
                    one, back = unique_pairs(last[at - 1], words.group[at])
                    low = (steps[-1].code[at[one]] if steps else np.zeros(len(one))).astype("<i2")
                    held.append((places[last[at[one] - 1]], words.places[words.group[at[one]]], low, np.bincount(back, minlength=len(one))))
                    size += len(one)
                if size >= BLOCK_PAIRS:
                    yield dealt(held, buckets)
                    size = 0
        if held:
            yield dealt(held, buckets)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(b.column(0).to_pylist(), *(b.column(c) for c in range(1, 5))))
        for _, own in groupby(rows, key=itemgetter(0)):
            columns = list(zip(*own))[1:]
            parent, word, low, n = (np.frombuffer(b"".join(x.as_buffer() for x in c), t) for c, t in zip(columns, ("<i8", "<i8", "<i2", "<i8")))
            one, back = unique_pairs(parent, word)
            total = np.bincount(back, n, len(one)).astype(np.int64)
            often = np.flatnonzero(total >= least)
            one = one[often]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (parent[one], word[one], low[one], total[often])], ["parent", "word", "low", "n"])
        give_back()

    made = docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, "bucket int, parent binary, word binary, low binary, n binary")
    return made.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(add, "parent bigint, word bigint, low smallint, n bigint")


def build_shards(rows: DataFrame, keys: list[str], folder: str, n_rows: int, make) -> list[tuple[int, int, int, int, str]]:
    """Write ranges of ``rows``, sorted by ``keys``, as shards; ``make(columns)`` gives a shard's arrays."""
    if not n_rows:
        return []
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        made = []

        def flush() -> None:
            cols = {c: np.concatenate([h.pop(c) for h in held]) for c in names}
            held.clear()
            name = save_shard(folder, make(cols))
            made.append((int(cols[keys[0]][0]), int(cols[keys[-1]][0]), len(cols[keys[0]]), int(cols["children"].sum()) if "children" in cols else 0, name))
            cols.clear()
            give_back()

        for batch in batches:
            held.append({c: batch.column(c).to_numpy(zero_copy_only=False) for c in names})
            size += batch.num_rows
            if size >= SHARD_KEYS * 5 // 4:
                flush()
                size = 0
        if size:
            flush()
        cols = list(zip(*made)) or [[], [], [], [], []]
        types = (*[pa.int64()] * 4, pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["first", "word", "size", "children", "name"])

    ranged = rows.repartitionByRange(max(1, -(-n_rows // SHARD_KEYS)), *keys).sortWithinPartitions(*keys)
    shards = materialise(ranged.mapInArrow(run, "first bigint, word bigint, size bigint, children bigint, name string"), "lm-shards")
    return [tuple(r) for r in shards.collect()]


def parent_counts(lower: Model, k: int, parent: np.ndarray) -> np.ndarray:
    return (lower.levels[k - 3] if k > 2 else lower.words).at(parent, "count")


def context_arrays(lower: Model, k: int, c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Back-off codes and Elias-Fano pointers of a run of level-k contexts."""
    pointers = EliasFano.build(np.concatenate(([0], np.cumsum(c["children"]))).astype(np.int64))
    code = quantise(1.0 - c["mass"] / parent_counts(lower, k, c["parent"]))
    return EliasFano.build(c["parent"]) | {"code": code} | {f"pointer_{n}": a for n, a in pointers.items()}


def level_arrays(lower: Model, contexts: Sharded, k: int, keep_counts: bool, c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Context-relative words and probability codes of a run of level-k n-grams; counts only where a next level will need them."""
    parent, word = c["parent"], c["word"]
    edge = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1])))
    tops = word[np.concatenate((edge[1:], [len(word)])) - 1]
    length = np.diff(np.concatenate((edge, [len(word)])))
    relative = word + np.repeat(np.cumsum(tops) - tops, length)
    freed = 10.0 ** (-np.repeat(contexts.find(parent[edge], "code")[1], length) * STEP)
    below = lower.base(lower.words.at(word, "count")) if k == 2 else 10.0 ** (-c["low"] * STEP)
    p = (c["n"] - DISCOUNT) / parent_counts(lower, k, parent) + freed * below
    return EliasFano.build(relative) | {"code": quantise(p)} | ({"count": c["n"].astype(np.uint32)} if keep_counts else {})


def train(docs: DataFrame, min_counts: tuple[int, ...] = MIN_COUNTS) -> Model:
    """The trie of all training documents (crc32 of the id as text not divisible by ``HELD_OUT``), of order ``len(min_counts)``.

    All words are kept; ``min_counts`` must not fall from one length to the next.
    """
    order = len(min_counts)
    folder = shared_path(docs.sparkSession, "lm")
    counts = materialise(count_words(docs), "lm-words")
    total = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    words = build_shards(counts, ["key"], folder, total["v"], lambda c: EliasFano.build(c["key"]) | {"count": c["n"]})
    model = Model(Sharded(folder, words), total["n"], total["v"])
    for k in range(2, order + 1):
        found = materialise(count_pairs(docs, model, k, min_counts[k - 1]), f"lm-level{k}")
        by_context = found.groupBy("parent").agg(F.sum(F.col("n") - F.lit(DISCOUNT)).alias("mass"), F.count("*").alias("children"))
        by_context = materialise(by_context, f"lm-contexts{k}")
        contexts = Sharded(folder, build_shards(by_context, ["parent"], folder, by_context.count(), lambda c, lower=model, k=k: context_arrays(lower, k, c)))
        level = build_shards(found, ["parent", "word"], folder, found.count(), lambda c, lower=model, ctx=contexts, k=k: level_arrays(lower, ctx, k, k < order, c))
        model = Model(model.words, model.n, model.v, [*model.levels, Sharded(folder, level)], [*model.contexts, contexts])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", PIECE_BYTES):
            hashes, place, doc = tokens(utf8_texts(piece))
            known, base, full = score_tokens(model, hashes, place)
            n = piece.num_rows
            total = lambda w: np.bincount(doc, w, n)  # noqa: B023, E731
            cols = [
                pa.array(held_out_mask(piece.column("doc_id").to_pylist(), HELD_OUT)), pa.array(np.bincount(doc, minlength=n).astype(np.int64)), pa.array(total(known).astype(np.int64)),
                pa.array(np.full(n, model.n, np.int64)), pa.array(total(base)), pa.array(total(full)),
            ]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *cols], names)

    schema = f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, schema)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs))
