"""Operator 11: alignment of two tokenizers over the same texts.

Inside ``mapInPandas`` the texts of a block (``BLOCK_BYTES``) are encoded by a byte-level tokenizer A (a space before the text) and
a piece tokenizer B (which adds the space itself). Both give cumulative token ends over the same bytes; one merge of the
two sorted lists walks both pointers: every distinct end closes a stretch that lies in one A and one B token, which is a link, and
every end that both lists hold closes a group. A block emits its documents (counts, digest of the groups, links as places
in the block's list of id pairs) and that list with how often each pair is linked.

Spark then groups the lists by pair, takes the largest count of each A and of each B id, and joins counts and maxima back to the
blocks' lists, not to single links: a pair that stands in every document is one row a block, and the join's sides are plain
shuffles that adaptive execution may split. A cogroup by block, whose size is bounded by its text, sums them up for each document.

Texts are encoded word by word, each word once while it is in the bounded cache: no piece of B has its space anywhere but in front
(checked when it is loaded), and A cuts before a space between two characters that are no white space. Texts with other
spaces are encoded whole. A runs as ranks where its merges are in the order of its ids (checked), else by its own library.

Defined results: null or empty texts, and texts whose joined A or B bytes differ from space and text, have zeros and ''; repeated
rows count as often as they stand; null ids stay null; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import give_back, materialise, ranges, table

BLOCK_BYTES = 4_000_000
CACHE_WORDS = 300_000
CACHED_LENGTH = 48
#: Spaces that do not stand between two characters that are no white space.
ODD_SPACE = re.compile(r"^ |\s | \s| $")


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_characters() -> dict[str, int]:
    """Byte of each character in which byte-level vocabularies are written: printable ones are themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


class ByteSide:
    """Tokenizer A: ``encode(text)`` gives ids of the text as it is; ``spelled[id]`` the id's bytes."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab, back = model["model"]["vocab"], byte_characters()
        names = {i: t for t, i in vocab.items()}
        self.spelled = [bytes(back[c] for c in names[i]) if i in names and all(c in back for c in names[i]) else b"" for i in range(max(names) + 1)]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        if not model.get("normalizer") and all(vocab[a + b] == 256 + k for k, (a, b) in enumerate(merges)) and len(vocab) == 256 + len(merges):
            import public_tokenizers
            import tiktoken

            own = tiktoken.Encoding("side-a", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(self.spelled)}, special_tokens={})
            self.encode = own.encode_ordinary
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.encode_special_tokens = True
            self.encode = lambda text: own.encode(text, add_special_tokens=False).ids


class PieceSide:
    """Tokenizer B: ``encode(text)`` gives ids of space and text; ``spelled[id]`` the id's bytes."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [own.id_to_piece(i) for i in range(own.vocab_size())]
        self.spelled = [bytes([int(p[3:5], 16)]) if own.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.by_word = not any("▁" in p.lstrip("▁") for p in pieces)
        self.encode = own.encode


class Sides:
    """Both tokenizers with the word cache: word -> slot, and each slot's ids of both sides."""

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.b = ByteSide(a_path), PieceSide(b_path)
        self.size_a, self.size_b = (np.fromiter(map(len, s.spelled), np.int64, len(s.spelled)) for s in (self.a, self.b))
        self.digits_a, self.digits_b = decimal_table(len(self.size_a)), decimal_table(len(self.size_b))
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids = [np.empty(0, np.int32), np.empty(0, np.int32)]
        self.length = [np.empty(0, np.int64), np.empty(0, np.int64)]
        self.good = np.empty(0, bool)

    def units(self, text: str) -> list[str]:
        """What is encoded by itself: words if every space stands between two words, else the whole text."""
        return [text] if not self.b.by_word or ODD_SPACE.search(text) else text.split(" ")

    def learn(self, units: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        a, b = [self.a.encode(" " + u) for u in units], self.b.encode(units)
        good = np.empty(len(units), bool)
        for i, u in enumerate(units):
            raw = b" " + u.encode()
            good[i] = b"".join(map(self.b.spelled.__getitem__, b[i])) == raw and b"".join(map(self.a.spelled.__getitem__, a[i])) == raw
        lengths = [np.fromiter(map(len, side), np.int64, len(units)) for side in (a, b)]
        return [np.fromiter((t for ids in side for t in ids), np.int32, int(n.sum())) for side, n in zip((a, b), lengths)], lengths, good

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """([ids of A, ids of B], [tokens of each text, by side], whether each text is spelled rightly by both)."""
        if len(self.slots) > CACHE_WORDS:
            self.clear()
        units, n_units = [], np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            own = self.units(t)
            n_units[i] = len(own)
            units += own
        slot = np.fromiter(map(self.slots.get, units, (-1 for _ in units)), np.int64, len(units))
        missing = np.flatnonzero(slot < 0)
        held = len(self.good)
        new: dict[str, int] = {}
        for i in missing.tolist():
            slot[i] = new.setdefault(units[i], held + len(new))
        ids, length, good = self.ids, self.length, self.good
        if new:
            words = list(new)
            more_ids, more_length, more_good = self.learn(words)
            ids = [np.concatenate(x) for x in zip(ids, more_ids)]
            length = [np.concatenate(x) for x in zip(length, more_length)]
            good = np.concatenate((good, more_good))
            keep = np.fromiter((len(w) <= CACHED_LENGTH for w in words), bool, len(words))
            self.keep(words, keep, more_ids, more_length, more_good)
        begin = [np.cumsum(n) - n for n in length]
        first = np.cumsum(n_units) - n_units
        per_text = [np.add.reduceat(n[slot], first) if len(texts) else np.empty(0, np.int64) for n in length]
        fine = np.logical_and.reduceat(good[slot], first) if len(texts) else np.empty(0, bool)
        return [v[ranges(s[slot], n[slot])] for v, s, n in zip(ids, begin, length)], per_text, fine

    def keep(self, words: list[str], which: np.ndarray, ids: list, length: list, good: np.ndarray) -> None:
        at = len(self.good)
        self.slots.update((words[i], at + k) for k, i in enumerate(np.flatnonzero(which).tolist()))
        for side in (0, 1):
            self.ids[side] = np.concatenate((self.ids[side], ids[side][np.repeat(which, length[side])]))
            self.length[side] = np.concatenate((self.length[side], length[side][which]))
        self.good = np.concatenate((self.good, good[which]))


_SIDES: dict[tuple[str, str], Sides] = {}


def sides_of(a_path: str, b_path: str) -> Sides:
    if (a_path, b_path) not in _SIDES:
        _SIDES[a_path, b_path] = Sides(a_path, b_path)
    return _SIDES[a_path, b_path]


def decimal_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0..n-1, one row each with room for a sign behind them, and how many there are."""
    text = [str(i).encode() for i in range(n)]
    width = len(text[-1]) + 1
    return np.frombuffer(b"".join(t.ljust(width, b"\0") for t in text), np.uint8).reshape(n, width), np.fromiter(map(len, text), np.int64, n)


def merge_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(links' ends, their A token, their B token, groups' ends) of two ascending lists of token ends with equal last one."""
    every = np.concatenate((ends_a, ends_b))
    every.sort(kind="stable")
    again = np.concatenate((every[1:] == every[:-1], [False])) if len(every) else np.empty(0, bool)
    ends = every[~again]
    return ends, np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends), every[again]


def group_text(sides: Sides, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of `a1,a2|b1;` for all groups, bytes of each A token, of each B token with the sign behind it)."""
    n_a, n_b = len(a), len(b)
    at_a = np.arange(n_a) + np.searchsorted(group_b, group_a, "left")
    at_b = np.arange(n_b) + np.searchsorted(group_a, group_b, "right")
    width = max(sides.digits_a[0].shape[1], sides.digits_b[0].shape[1])
    out, size = np.zeros((n_a + n_b, width), np.uint8), np.empty(n_a + n_b, np.int64)
    for ids, at, (digits, length), group, last in ((a, at_a, sides.digits_a, group_a, b"|"), (b, at_b, sides.digits_b, group_b, b";")):
        out[at, : digits.shape[1]] = digits[ids]
        size[at] = length[ids]
        closes = np.concatenate((group[1:] != group[:-1], [True])) if len(group) else np.empty(0, bool)
        out[at, length[ids]] = np.where(closes, last[0], ord(","))
    return out[np.arange(width) <= size[:, None]], size[at_a] + 1, size[at_b] + 1


def aligned_block(sides: Sides, texts: list[str | None]) -> tuple[dict, np.ndarray, np.ndarray]:
    """Columns of the block's documents, its distinct id pairs (A << 32 | B), and how often each is linked."""
    n = len(texts)
    (a, b), (n_a, n_b), good = sides.encode([t or "" for t in texts])
    good &= np.fromiter((bool(t) for t in texts), bool, n)
    a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
    n_a, n_b = np.where(good, n_a, 0), np.where(good, n_b, 0)
    ends_a, ends_b = np.cumsum(sides.size_a[a]), np.cumsum(sides.size_b[b])
    ends, of_a, of_b, closes = merge_ends(ends_a, ends_b)
    edge_a = np.concatenate(([0], np.cumsum(n_a)))
    edge = np.concatenate(([0], ends_a))[edge_a]  # bytes before each text
    n_links, n_groups = np.diff(np.searchsorted(ends, edge, "right")), np.diff(np.searchsorted(closes, edge, "right"))
    text, size_a, size_b = group_text(sides, a, b, np.searchsorted(closes, ends_a), np.searchsorted(closes, ends_b))
    upto_a, upto_b = (np.concatenate(([0], np.cumsum(s)))[np.concatenate(([0], np.cumsum(k)))] for s, k in ((size_a, n_a), (size_b, n_b)))
    cut = (upto_a + upto_b).tolist()
    raw = memoryview(text)
    digests = [hashlib.sha256(raw[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(cut, cut[1:])]
    pairs, place, times = np.unique(a[of_a].astype(np.int64) << 32 | b[of_b], return_inverse=True, return_counts=True)
    key, count = np.unique(np.repeat(np.arange(n), n_links) * max(len(pairs), 1) + place, return_counts=True)
    of, own = np.divmod(key, max(len(pairs), 1))
    at = np.searchsorted(of, np.arange(n + 1)).tolist()
    columns = {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": digests}
    columns |= {"places": [own[x:y].astype(np.int32) for x, y in zip(at, at[1:])], "times": [count[x:y].astype(np.int32) for x, y in zip(at, at[1:])]}
    return columns, pairs, times


DOCUMENT = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, places array<int>, times array<int>"


def align(docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, DataFrame]:
    """(documents by block, blocks' lists of id pairs), written once to the shared folder.

    Documents: block, doc_id (as text), counts, digest of the groups, places and times (the document's distinct pairs as places in
    the block's list in ascending order, and how often each is linked). Lists: of_block, pair (A << 32 | B), linked.
    """
    schema = f"kind string, block bigint, doc_id string, {DOCUMENT}, pairs array<bigint>, linked array<bigint>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sides, block = sides_of(a_path, b_path), TaskContext.get().partitionId() << 33
        for frame in frames:
            sizes = frame["text"].str.len().fillna(0).to_numpy(np.int64)
            part = np.cumsum(sizes) // BLOCK_BYTES
            for at in np.split(np.arange(len(frame)), np.flatnonzero(np.diff(part)) + 1):
                if not len(at):
                    continue
                own = frame.iloc[at]
                columns, pairs, times = aligned_block(sides, [None if t is None or t != t else t for t in own["text"]])
                rows = pd.DataFrame({"kind": "document", "block": block, "doc_id": own["doc_id"].to_numpy()} | columns | {"pairs": None, "linked": None})
                yield rows
                yield pd.DataFrame([{"kind": "pairs", "block": block, "doc_id": None, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": None, "places": None, "times": None, "pairs": pairs, "linked": times}])
                block += 1
        give_back()

    made = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, schema)
    written = materialise(made, "aligned", partition_by=["kind"])
    documents = written.where("kind = 'document'").drop("kind", "pairs", "linked")
    lists = written.where("kind = 'pairs'").select(F.col("block").alias("of_block"), F.explode(F.arrays_zip("pairs", "linked")).alias("x"))
    return documents, lists.select("of_block", F.col("x.pairs").alias("pair"), F.col("x.linked").alias("linked"))


def pair_counts(lists: DataFrame) -> DataFrame:
    """(pair, count, best_a, best_b): how many links hold each id pair, and whether no other pair of its A or B id has more."""
    count = lists.groupBy("pair").agg(F.sum("linked").alias("count"))
    count = count.withColumn("a", F.shiftright("pair", 32)).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF))
    count = materialise(count, "pair-counts")
    top_a, top_b = (count.groupBy(side).agg(F.max("count").alias(f"top_{side}")) for side in ("a", "b"))
    rows = count.join(top_a, "a").join(top_b, "b")
    return rows.select("pair", "count", (F.col("count") == F.col("top_a")).alias("best_a"), (F.col("count") == F.col("top_b")).alias("best_b"))


def with_counts(documents: DataFrame, lists: DataFrame, counts: DataFrame) -> DataFrame:
    """Documents with n_best (links whose count is their B id's highest), n_best_a (their A id's) and count_sum over their links."""
    known = lists.select("of_block", "pair").join(counts, "pair")

    def total(docs: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(pairs["pair"].to_numpy())
        count, best_a, best_b = (pairs[c].to_numpy(np.int64)[order] for c in ("count", "best_a", "best_b"))
        sums = [[int(v[p] @ n) for v in (best_b, best_a, count)] for p, n in zip(docs["places"], (np.asarray(t, np.int64) for t in docs["times"]))]
        out = docs[["doc_id", "n_a", "n_b", "n_groups", "n_links"]].copy()
        out[["n_best", "n_best_a", "count_sum"]] = np.array(sums, np.int64).reshape(-1, 3)
        out["groups_sha256"] = docs["groups_sha256"]
        return out

    schema = "doc_id string, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, n_best_a bigint, count_sum bigint, groups_sha256 string"
    return documents.groupBy("block").cogroup(known.groupBy("of_block")).applyInPandas(total, schema)


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    documents, lists = align(docs, *default_tokenizers())
    rows = with_counts(documents, lists, pair_counts(lists))
    return rows.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_best_a")
