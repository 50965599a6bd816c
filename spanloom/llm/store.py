"""Operator 8: token ids in a content-addressed store.

Each document's ids, with its end id, form a stream. A rolling hash over a window of ids cuts it where the
content says so, so equal passages give equal chunks wherever they stand. A chunk's key is the SHA-256 of
its bytes. One shuffle by key brings equal chunks together and each is written once; a document's recipe is
its list of keys under a Merkle root, and each recipe file has a Merkle root over its documents. Recipes are
written in ascending doc_id order with each document's start, found by a prefix sum over file totals.

Reading back, every stored chunk is hashed again and compared with its key, recipes are joined to chunk
facts (key, length, checksum), a document's checksum is put together from its chunks' checksums, and the
Merkle root is computed anew. Only those facts are shuffled, never stored ids; ``read_documents`` gives ids.

Tasks drop a chunk they have already emitted before the shuffle, so a passage in a third of all documents
costs one row per task. Texts are encoded word by word, each distinct word of a slice once: white space never joins a token and
the tokenizer's normaliser works within words, so the ids equal those of whole texts. The word cache is bounded.
Added tokens such as <|endoftext|> are matched as the library does by default, in the case they are written in.

Defined results: null or empty texts hold the end id alone; rows with equal doc_id are ordered by content;
null ids come first; an empty table gives empty tables; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import RangeCache, Words, mix64, powers, ranges, shared_path, slices, table, utf8_texts, whole_text

END_ID = 2
WINDOW = 16
CUT_MASK = 255
MIN_CHUNK, MAX_CHUNK = 64, 2048
CACHE_WORDS = 3_000_000
TEXT_BYTES = 3_000_000
WORDS_PER_CALL = 400
RECIPE_FILE_TOKENS = 64_000_000
_MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
_LETTER[ord("a") : ord("z") + 1] = True
_ID_HASH = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, 1 << 16, dtype=np.uint64)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Words whose pre-tokens are known from their form: letters of one case pair, then marks; each of both is one.
PLAIN = re.compile("([a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*)[.,;:!?]*")


class WordEncoder:
    """ids of texts by the tokenizers library, each distinct word encoded once while it is in the cache."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or len(t.content.encode().split()) != 1 for t in added):
            raise ValueError("an added token that holds white space cannot be matched word by word")
        self.literals = [t.content.encode().lower() for t in added]
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.type = np.dtype("<u4" if self.wide else "<u2")
        self.cache = RangeCache(CACHE_WORDS, [self.type])

    def _by_offsets(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word): a token belongs to the word it begins in."""
        code = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        first = np.fromiter((o[0] for o in code.offsets), np.int64, len(code.offsets))
        return np.asarray(code.ids, self.type), np.diff(np.searchsorted(first, begin))

    def _by_pieces(self, texts: list[str], pieces: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of known numbers of pre-tokens."""
        code = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        of, upto = np.asarray(code.word_ids, np.int64), np.cumsum([0, *pieces])
        if not len(of) or of[-1] + 1 != upto[-1]:
            return self._by_offsets(texts)
        return np.asarray(code.ids, self.type), np.diff(np.searchsorted(of, upto))

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of words in their order."""
        texts = [w.decode("utf-8") for w in words]
        found = [PLAIN.fullmatch(t) for t in texts]
        plain = sorted((i for i, m in enumerate(found) if m), key=texts.__getitem__)  # like words touch the same merges
        other = [i for i, m in enumerate(found) if not m]
        lengths, ids = np.zeros(len(words), np.int64), []
        for group in (plain, other):
            for at in range(0, len(group), WORDS_PER_CALL):
                part = group[at : at + WORDS_PER_CALL]
                own = [texts[i] for i in part]
                if group is plain:
                    got = self._by_pieces(own, [(0 < found[i].end(1)) + (found[i].end(1) < len(texts[i])) for i in part])
                else:
                    got = self._by_offsets(own)
                ids.append(got[0])
                lengths[part] = got[1]
        order = np.array(plain + other)
        sizes = lengths[order]
        begin = np.empty(len(words), np.int64)
        begin[order] = np.cumsum(sizes) - sizes
        return lengths, np.concatenate(ids)[ranges(begin, lengths)]

    def literal_words(self, raw: bytes, w: Words) -> set[int]:
        """Words that hold an added token's literal in any case."""
        found = set()
        for literal in self.literals:
            at = raw.find(literal)
            while at >= 0:
                i = int(np.searchsorted(w.start, at, side="right")) - 1
                found.add(i)
                at = raw.find(literal, int(w.end[i]))
        return found

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of each text. Words that differ in the case of A-Z alone have the same ids, as the tokenizer lower-cases;
        those that hold an added token's literal do not, and are told apart by their own bytes."""
        w = Words(texts)
        own_hash, raw = w.hash, w.raw.tobytes()
        if found := self.literal_words(raw, w):
            joined, raw = b"\n".join(texts), bytearray(raw)
            for i in found:
                a, b = int(w.start[i]), int(w.end[i])
                raw[a:b] = joined[a:b]
                own_hash[i] = int.from_bytes(hashlib.blake2b(joined[a:b], digest_size=8).digest(), "little")
            raw = bytes(raw)
        # A mark behind a letter is a pre-token of its own, so "word." has the ids of "word", then those of ".".
        end = np.frombuffer(raw, np.uint8)
        cut = np.flatnonzero(w.length > 1)
        cut = cut[_MARK[end[w.end[cut] - 1]] & _LETTER[end[w.end[cut] - 2]]]
        cut = cut[~np.isin(cut, list(found))]
        extra = np.zeros(len(own_hash), np.int64)
        extra[cut] = 1
        place = np.arange(len(own_hash)) + np.cumsum(extra) - extra
        hashes, start, stop = (np.empty(len(own_hash) + len(cut), t) for t in (np.uint64, np.int64, np.int64))
        hashes[place], start[place], stop[place] = own_hash, w.start, w.end
        hashes[place[cut]], hashes[place[cut] + 1] = w.without_last(cut)
        stop[place[cut]], start[place[cut] + 1], stop[place[cut] + 1] = w.end[cut] - 1, w.end[cut] - 1, w.end[cut]
        first = np.concatenate((place, [len(hashes)]))[w.first]
        uniq, at, back = np.unique(hashes, return_index=True, return_inverse=True)

        def learn(which: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
            i = at[which]
            return [self.learn([raw[a:b] for a, b in zip(start[i].tolist(), stop[i].tolist())])]

        [(begin, length, held)] = self.cache.get(uniq, learn)
        own = length[back]
        ids = held[ranges(begin[back], own)]
        edge = np.concatenate(([0], np.cumsum(own)))[first].tolist()
        return [ids[a:b].tobytes() for a, b in zip(edge, edge[1:])]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of a stream's chunks: where the hash of the last ``WINDOW`` ids says so, within the size limits."""
    n = len(ids)
    if n <= MIN_CHUNK:
        return [n] if n else []
    p = powers(n + 1)
    total = np.concatenate(([np.uint64(0)], np.cumsum(_ID_HASH[ids & 0xFFFF] * p[:n], dtype=np.uint64)))
    # Sums over windows at different places agree up to a power of the base; scale all to the last place.
    scaled = (total[WINDOW:] - total[:-WINDOW]) * p[n - WINDOW :: -1][: n - WINDOW + 1]
    marks = np.flatnonzero((mix64(scaled * powers_tail(n)) & np.uint64(CUT_MASK)) == 0) + WINDOW
    ends, last = [], 0
    for m in [*marks.tolist(), n]:
        if m - last < MIN_CHUNK and m < n:
            continue
        while m - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if m > last:
            ends.append(m)
            last = m
    return ends


_INVERSE = pow(int(powers(2)[1]), -1, 1 << 64)


def powers_tail(n: int) -> np.uint64:
    """base ** -(n - WINDOW): makes window hashes independent of the stream's length."""
    return np.uint64(pow(_INVERSE, n - WINDOW, 1 << 64))


def merkle_root(keys: list[bytes]) -> bytes:
    """Root of a binary SHA-256 tree over keys; an odd last node moves up unchanged."""
    level = [hashlib.sha256(b"\0" + k).digest() for k in keys] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


# ---- checksums of joined byte strings, from the checksums of the parts --------------------------
_POLY = np.uint32(0xEDB88320)


def _times(a: int, b: int) -> int:
    """Product of two bit-reversed polynomials modulo the CRC-32 polynomial."""
    out = 0
    for _ in range(32):
        if a & 0x80000000:
            out ^= b
        a = (a << 1) & 0xFFFFFFFF
        b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
    return out


def _shift_tables() -> list[np.ndarray]:
    """For each k: tables of the product with x ** (8 * 2 ** k), by byte."""
    tables, x = [], 1 << 23  # x ** 8, bit-reversed
    for _ in range(48):
        tables.append(np.array([[_times(v << (8 * j), x) for v in range(256)] for j in range(4)], np.uint32))
        x = _times(x, x)
    return tables


_SHIFTS: list[np.ndarray] = []


def join_crc32(crcs: np.ndarray, tails: np.ndarray, group: np.ndarray, n_groups: int) -> np.ndarray:
    """crc32 of each group's joined parts; ``tails`` has the bytes that follow a part within its group."""
    if not _SHIFTS:
        _SHIFTS.extend(_shift_tables())
    v = crcs.astype(np.uint32)
    for k in range(int(tails.max()).bit_length() if len(tails) else 0):
        t, on = _SHIFTS[k], (tails >> k) & 1 == 1
        w = v[on]
        v[on] = t[0][w & 255] ^ t[1][w >> 8 & 255] ^ t[2][w >> 16 & 255] ^ t[3][w >> 24]
    out = np.zeros(n_groups, np.uint32)
    np.bitwise_xor.at(out, group, v)
    return out.astype(np.int64)


# ---- writing --------------------------------------------------------------------------------
def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Write chunks (path/parts/kind=chunk), recipes in doc_id order (path/recipes) and their manifest (path/manifest)."""
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    fields = [("kind", pa.string()), ("part", pa.binary()), ("payload", pa.binary()), ("n_tokens", pa.int64()), ("doc_id", None), ("keys", pa.list_(pa.binary())), ("root", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        own, seen = encoder(tokenizer), set()
        end = np.asarray([end_id], own.type).tobytes()
        size = own.type.itemsize
        for piece in slices(batches, "text", TEXT_BYTES):
            ids_of = piece.column(0)
            chunks, recipes = [], []
            for i, packed in enumerate(own.encode(utf8_texts(piece))):
                packed += end
                ids = np.frombuffer(packed, own.type)
                keys, last = [], 0
                for e in cut_points(ids):
                    body = packed[last * size : e * size]
                    key = hashlib.sha256(body).digest()
                    keys.append(key)
                    if key not in seen:
                        seen.add(key)
                        chunks.append((key, body, e - last))
                    last = e
                recipes.append((i, len(ids), keys, merkle_root(keys)))
            if len(seen) > 500_000:
                seen.clear()
            n, m = len(chunks), len(recipes)
            rows = pa.array([r[0] for r in recipes], pa.int64())
            part = [c[0] for c in chunks] + [zlib.crc32(str(ids_of[r[0]]).encode()).to_bytes(4, "big") for r in recipes]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(["chunk"] * n + ["recipe"] * m), pa.array(part, pa.binary()), pa.array([c[1] for c in chunks] + [None] * m, pa.binary()),
                    pa.array([c[2] for c in chunks] + [r[1] for r in recipes], pa.int64()), pa.concat_arrays([pa.nulls(n, ids_of.type), ids_of.take(rows)]),
                    pa.array([None] * n + [r[2] for r in recipes], pa.list_(pa.binary())), pa.array([None] * n + [r[3] for r in recipes], pa.binary()),
                ],
                [f[0] for f in fields],
            )

    schema = f"kind string, part binary, payload binary, n_tokens bigint, doc_id {id_type}, keys array<binary>, root binary"
    made = docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, schema)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keep = []
            for kind, key in zip(batch.column("kind").to_pylist(), batch.column("part").to_pylist()):
                keep.append(kind != "chunk" or key not in seen)
                if kind == "chunk":
                    seen.add(key)
            yield batch.filter(pa.array(keep, pa.bool_()))

    dealt = made.repartition(F.col("part")).mapInArrow(once, schema)
    dealt.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/parts")
    recipes = spark.read.schema(schema).parquet(f"{path}/parts").filter(F.col("kind") == "recipe").select("doc_id", "n_tokens", "keys", "root")
    total = recipes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    files = max(1, min(10_000, -(-total // RECIPE_FILE_TOKENS)))
    ordered = recipes.repartitionByRange(files, F.col("doc_id").asc_nulls_first(), F.col("root"))
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root").withColumn("file", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    ordered.write.parquet(f"{path}/recipes")
    written = spark.read.parquet(f"{path}/recipes")
    upto = F.sum("tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    totals = written.groupBy("file").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "root"))), lambda x: F.hex(x["root"])), ""), 256).alias("file_root"))
    totals.withColumn("before", F.coalesce(upto, F.lit(0))).write.parquet(f"{path}/manifest")


# ---- reading --------------------------------------------------------------------------------
def stored_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks; none if nothing but empty tables was written."""
    return spark.read.schema("part binary, payload binary, n_tokens bigint, kind string").parquet(f"{path}/parts").filter(F.col("kind") == "chunk").drop("kind")


def stored_recipes(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with each document's start."""
    recipes = spark.read.parquet(f"{path}/recipes")
    manifest = spark.read.parquet(f"{path}/manifest").select("file", "before")  # at most 10,000 rows
    within = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    return recipes.join(F.broadcast(manifest), "file").withColumn("start", F.col("before") + F.coalesce(within, F.lit(0)))


def read_documents(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """(doc_id, start, ids): every document's ids put together from its chunks."""
    parts = stored_recipes(spark, path).select("at", "doc_id", "start", F.posexplode("keys").alias("pos", "part"))
    rows = parts.join(stored_chunks(spark, path).select("part", "payload"), "part", "left")
    rows = rows.groupBy("at", "doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "payload"))).alias("parts"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(b"".join(p["payload"] for p in parts), "<u4" if wide else "<u2").astype(np.int32) for parts in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    return rows.select("doc_id", "start", "parts").mapInArrow(run, f"doc_id {id_type}, start bigint, ids array<int>")


def read_digests(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, n_chunks, verified) of every document, from the stored files."""

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for b in batches:
            rows = []
            for key, body in zip(b.column("part").to_pylist(), b.column("payload").to_pylist()):
                ids = np.frombuffer(body, "<u4" if wide else "<u2").astype("<u4")
                rows.append((key, len(ids), zlib.crc32(ids.tobytes()), hashlib.sha256(body).digest() == key))
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.bool_()))], ["part", "n", "crc", "good"])

    chunks = stored_chunks(spark, path).mapInArrow(facts, "part binary, n bigint, crc bigint, good boolean")
    recipes = stored_recipes(spark, path)
    parts = recipes.select("at", "doc_id", "start", "root", "n_tokens", F.posexplode("keys").alias("pos", "part"))
    rows = parts.join(chunks, "part", "left").groupBy("at", "doc_id", "start", "root", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("pos", "part", "n", "crc", "good"))).alias("parts"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("parts").to_pylist()
            n_parts = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = [p for x in lists for p in x]
            n = np.fromiter((p["n"] or 0 for p in flat), np.int64, len(flat))
            crc = np.fromiter((p["crc"] or 0 for p in flat), np.int64, len(flat))
            group = np.repeat(np.arange(len(lists)), n_parts)
            upto, sums = np.cumsum(n), np.bincount(group, n, len(lists)).astype(np.int64)
            tails = (np.repeat(np.cumsum(sums), n_parts) - upto) * 4
            joined = join_crc32(crc, tails, group, len(lists))
            good = [all(p["good"] for p in x) and merkle_root([p["part"] for p in x]) == r and s == t for x, r, s, t in zip(lists, b.column("root").to_pylist(), sums.tolist(), b.column("n_tokens").to_pylist())]
            cols = [b.column("doc_id"), b.column("start"), pa.array(sums), pa.array(joined), pa.array(n_parts), pa.array(good, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "n_chunks", "verified"])

    return rows.select("doc_id", "start", "root", "n_tokens", "parts").mapInArrow(run, f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint, n_chunks bigint, verified boolean")


def op8_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "id-store")
    write_store(table(spark, sf_dir, "documents"), path, default_tokenizer())
    return read_digests(spark, path)


