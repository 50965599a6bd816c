"""Operator 12: documents packed into as few token sequences of a fixed capacity as bin completion finds.

Tasks encode documents, cut only those longer than a sequence, and number the pieces of equal length within the task. Packing depends
on lengths alone, and there are at most ``capacity`` of them: the histogram of lengths is the whole problem at any
corpus size. Bin completion works on it. Best-fit decreasing is the first incumbent; where it misses the lower bound, a
branch-and-bound search takes the largest length left, enumerates undominated fillings of the room beside it (no length
left over could take the place of one or two of its own), applies a filling as often as its lengths last, and leaves a branch once its
waste exceeds what the incumbent allows. The plan is a table of slots: ranks r0 to r1 of a length go to ``times`` sequences
from ``base`` on. It has at most three patterns a length and 64 lengths a pattern, so it is broadcast at any corpus size.

A piece's rank among its length is its number in its task plus the pieces of that length in tasks before: prefix sums over (task,
length) counts, so no length, however common, meets in one task. Nothing but lengths goes through the search's one task.

Defined results: null or empty texts are the end id alone; repeated rows and null ids are packed each for itself; an empty table
gives no rows; extra columns are ignored. ``NODES`` bounds the search, not the documents: beyond it the best packing found so far holds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import materialise, slices, table, utf8_texts, whole_text
from spanloom.llm.store import TEXT_BYTES, default_tokenizer, encoder

CAPACITY, END_ID = 2048, 0
NODES, WIDTH, STEPS, SMALL = 20_000, 6, 300, 64

Pattern = tuple[tuple[int, int], ...]


# ---- bin completion over a histogram of lengths ---------------------------------------------------
def lower_bound(counts: list[int], capacity: int) -> int:
    """Sequences needed at least: of total size, and with each k of items above ``capacity - k`` that nothing of size k or more joins."""
    n = np.array(counts, object)
    size = n * np.arange(len(counts))
    upto_n, upto_s = np.concatenate(([0], np.cumsum(n))), np.concatenate(([0], np.cumsum(size)))
    best = -(-int(upto_s[-1]) // capacity)
    half = capacity // 2
    for k in range(1, half + 1):
        large = upto_n[-1] - upto_n[capacity - k + 1]
        middle, middle_size = upto_n[capacity - k + 1] - upto_n[half + 1], upto_s[capacity - k + 1] - upto_s[half + 1]
        small = upto_s[half + 1] - upto_s[k]
        best = max(best, int(large + middle + max(0, -(-(small - (middle * capacity - middle_size)) // capacity))))
    return best


def best_fit(counts: list[int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing: each item goes where the least room is left; equal bins are kept together as (pattern, number)."""
    open_bins: dict[int, list[tuple[Pattern, int]]] = {}
    mask, done = 0, []

    def put(room: int, pattern: Pattern, n: int) -> None:
        nonlocal mask
        if n and room:
            open_bins.setdefault(room, []).append((pattern, n))
            mask |= 1 << room
        elif n:
            done.append((pattern, n))

    for length in range(len(counts) - 1, 0, -1):
        left = counts[length]
        while left:
            wide = mask >> length
            if wide:
                room = length + (wide & -wide).bit_length() - 1
                pattern, n = open_bins[room].pop()
                if not open_bins[room]:
                    mask &= ~(1 << room)
            else:
                room, pattern, n = capacity, (), left
            fit = room // length
            full = min(n, left // fit)
            put(room - fit * length, (*pattern, (length, fit)), full)
            left -= full * fit
            if left and full < n and left < fit:
                put(room - left * length, (*pattern, (length, left)), 1)
                left, full = 0, full + 1
            if pattern:
                put(room, pattern, n - full)
    return done + [x for group in open_bins.values() for x in group]


def fillings(counts: list[int], mask: int, room: int) -> list[Pattern]:
    """Undominated fillings of ``room`` by available lengths, least waste first, then fewest items."""
    found: list[tuple[int, int, Pattern]] = []
    steps = 0

    def free(low: int, high: int, chosen: dict[int, int]) -> bool:
        part = (mask >> low) & ((1 << (high - low + 1)) - 1) if high >= low else 0
        while part:
            z = low + (part & -part).bit_length() - 1
            if counts[z] > chosen.get(z, 0):
                return True
            part &= part - 1
        return False

    def undominated(pattern: Pattern, slack: int) -> bool:
        chosen, sizes = dict(pattern), [x for x, _ in pattern]
        if slack and any(free(x + 1, x + slack, chosen) for x in sizes):
            return False
        pairs = [(x, y) for i, x in enumerate(sizes) for y in sizes[i:] if y != x or chosen[x] > 1]
        return not any(free(x + y, x + y + slack, chosen) for x, y in pairs)

    def grow(rest: int, top: int, pattern: Pattern) -> None:
        nonlocal steps
        steps += 1
        below = mask & ((1 << (min(rest, top) + 1)) - 1)
        if not below >> 1:
            if undominated(pattern, rest):
                found.append((rest, sum(k for _, k in pattern), pattern))
            return
        while below >> 1 and steps < STEPS and sum(f[0] == 0 for f in found) < WIDTH:
            length = below.bit_length() - 1
            for k in range(min(counts[length], rest // length), 0, -1):
                grow(rest - k * length, length - 1, (*pattern, (length, k)))
                if steps >= STEPS:
                    break
            below &= ~(1 << length)

    grow(room, room, ())
    return [f[2] for f in sorted(found)[:WIDTH]] or [()]


def greedy_filling(counts: list[int], mask: int, room: int) -> Pattern:
    """The largest lengths that fit, one after the other."""
    pattern, top = [], room
    while below := (mask & ((1 << (min(room, top) + 1)) - 1)) >> 1:
        length = below.bit_length()
        k = min(counts[length], room // length)
        pattern.append((length, k))
        room, top = room - k * length, length - 1
    return tuple(pattern)


def complete(counts: list[int], capacity: int, incumbent: list[tuple[Pattern, int]], lower: int) -> list[tuple[Pattern, int]]:
    """Branch and bound: a packing with fewer bins than the incumbent's if one is found within ``NODES`` nodes, else the incumbent."""
    best, fewest = incumbent, sum(n for _, n in incumbent)
    counts, total, nodes = list(counts), sum(i * n for i, n in enumerate(counts)), 0
    mask = sum(1 << i for i, n in enumerate(counts) if i and n)
    stack: list[list] = []  # [alternatives left, applied pattern, times]
    used = waste = 0

    def apply(pattern: Pattern, times: int) -> None:
        nonlocal mask, used, waste
        for length, k in pattern:
            counts[length] -= k * times
            mask = mask | 1 << length if counts[length] else mask & ~(1 << length)
        used += times
        waste += times * (capacity - sum(length * k for length, k in pattern))

    def alternatives() -> list[tuple[Pattern, int]]:
        largest = mask.bit_length() - 1
        counts[largest] -= 1
        left = mask if counts[largest] else mask & ~(1 << largest)
        room = capacity - largest
        options = fillings(counts, left, room)
        if options == [()] and left & ((1 << (room + 1)) - 1) >> 1:
            options = [greedy_filling(counts, left, room)]
        counts[largest] += 1
        out, few = [], sum(counts) <= SMALL
        for f in options:
            own = dict(f)
            own[largest] = own.get(largest, 0) + 1
            pattern = tuple(sorted(own.items(), reverse=True))
            times = min(counts[length] // k for length, k in pattern)
            out += [(pattern, times)] + [(pattern, 1)] * (few and times > 1)
        return out[::-1]

    while nodes < NODES and fewest > lower:
        if not mask and used < fewest:
            best, fewest = [(s[1], s[2]) for s in stack], used
        if mask and waste <= (fewest - 1) * capacity - total:
            stack.append([alternatives(), None, 0])
            nodes += 1
        while stack:
            top = stack[-1]
            if top[1] is not None:
                apply(top[1], -top[2])
            if top[0]:
                top[1], top[2] = top[0].pop()
                apply(top[1], top[2])
                break
            stack.pop()
        else:
            break
    return best


def plan(counts: list[int], capacity: int) -> list[tuple[Pattern, int]]:
    """(pattern, number of sequences): every item of the histogram in one of them."""
    incumbent, lower = best_fit(counts, capacity), lower_bound(counts, capacity)
    return incumbent if sum(n for _, n in incumbent) == lower else complete(counts, capacity, incumbent, lower)


def slots(patterns: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, r0, r1, base, offset, times): where ranks r0 to r1 - 1 of a length go."""
    rows, base, ranks = [], 0, {}
    for pattern, times in patterns:
        offset = 0
        for length, k in pattern:
            r = ranks.get(length, 0)
            rows.append((length, r, r + k * times, base, offset, times))
            ranks[length] = r + k * times
            offset += k * length
        base += times
    return rows


# ---- pieces, ranks and places ---------------------------------------------------------------------
def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth[, ids]): nth numbers the pieces of a length within the task ``part``."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, part = encoder(tokenizer), [0] * (capacity + 1), TaskContext.get().partitionId()
        end = np.asarray([end_id], own.type).tobytes()
        for batch in slices(batches, "text", TEXT_BYTES):
            rows, bodies = [], []
            for i, packed in enumerate(own.encode(utf8_texts(batch))):
                ids = np.frombuffer(packed + end, own.type).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    body = ids[at : at + capacity]
                    rows.append((i, k, at, len(body), zlib.crc32(body), part, seen[len(body)]))
                    seen[len(body)] += 1
                    if with_ids:
                        bodies.append(body.astype(np.int32))
            cols = list(zip(*rows))
            arrays = [batch.column("doc_id").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(bodies, pa.list_(pa.int32()))] * with_ids, names + ["ids"] * with_ids)

    schema = f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint, part bigint, nth bigint" + ", ids array<int>" * with_ids
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, schema)


def slot_table(histogram: DataFrame, capacity: int) -> DataFrame:
    """Plan of (length, n), at most ``capacity`` rows, as slots."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = [0] * (capacity + 1)
        for f in frames:
            for length, n in zip(f["length"].tolist(), f["n"].tolist()):
                counts[length] += n
        if any(counts):
            yield pd.DataFrame(slots(plan(counts, capacity)), columns=["length", "r0", "r1", "base", "slot_offset", "times"])

    return histogram.select("length", "n").repartition(1).mapInPandas(run, "length bigint, r0 bigint, r1 bigint, base bigint, slot_offset bigint, times bigint")


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of every piece."""
    made = materialise(pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    per_task = materialise(made.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    plan_rows = materialise(slot_table(per_task.groupBy("length").agg(F.sum("n").alias("n")), capacity), "slots")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = per_task.select("part", "length", F.coalesce(before, F.lit(0)).alias("first"))
    ranked = made.join(first, ["part", "length"]).withColumn("rank", F.col("first") + F.col("nth"))
    placed = ranked.join(F.broadcast(plan_rows), (ranked["length"] == plan_rows["length"]) & (F.col("rank") >= F.col("r0")) & (F.col("rank") < F.col("r1"))).drop(plan_rows["length"])
    own = F.col("rank") - F.col("r0")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + own % F.col("times")).alias("sequence_id"),
        (F.col("slot_offset") + F.floor(own / F.col("times")) * F.col("length")).alias("offset"), *["ids"] * with_ids,
    )


def sequences(rows: DataFrame) -> DataFrame:
    """(sequence_id, ids, starts): the token ids of each sequence and where its pieces begin; a group holds ``capacity`` ids at most."""
    parts = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"), F.transform("parts", lambda p: p["offset"]).alias("starts"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), default_tokenizer())
