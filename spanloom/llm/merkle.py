"""Nodes of Merkle trees by level and index: plain functions that tasks of operator 13 load without any data library."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(total: int) -> int:
    """Levels above the leaves of a tree of ``total`` leaves."""
    return max(total - 1, 0).bit_length()


def nodes_at(total: int, level: int) -> int:
    return (total - 1 >> level) + 1


def climb(level: int, low: int, digests: list[str], total: int, stop: int) -> tuple[list, list, list]:
    """Completes what it can of nodes ``low``.. of a level, up to level ``stop``.

    Gives (ragged or top nodes as (level, index, digest), each start node's path entries, each start node's last place among them).
    """
    n = len(digests)
    paths: list[list] = [[] for _ in range(n)]
    ends: list[tuple[int, int]] = [(0, 0)] * n
    members = [(k, k + 1) for k in range(n)]  # start nodes below each node still climbing
    out = []

    def leave(k: int) -> None:
        out.append((level, low + k, digests[k]))
        for m in range(*members[k]):
            ends[m] = (level, low + k)

    while digests:
        count = nodes_at(total, level)
        if level == stop or count == 1:
            for k in range(len(digests)):
                leave(k)
            break
        first, last = low % 2, len(digests)
        if first:
            leave(0)
        if last > first and (low + last) % 2 and low + last != count:
            last -= 1
            leave(last)
        up, of = [], []
        for k in range(first, last, 2):
            a, b = digests[k], digests[k + 1] if k + 1 < last else ""
            up.append(digest(a, b))
            of.append((members[k][0], members[k + 1 if b else k][1]))
            for m in range(*members[k]):
                paths[m].append(("", b))
            if b:
                for m in range(*members[k + 1]):
                    paths[m].append((a, ""))
        low, digests, members, level = (low + 1) // 2, up, of, level + 1
    return out, paths, ends


def partition_facts(rows: list[tuple]) -> dict[int, tuple[int, int, int]]:
    """Of each partition: leaves of its first group before it, and in all of its first and its last group. ``rows``: one a partition."""
    facts, carried = {}, 0
    rows = sorted(rows)
    for k, (part, first, n_first, last, n_last, whole) in enumerate(rows):
        before = carried if k and rows[k - 1][3] == first else 0
        carried = before + n_first if whole else n_last
        facts[part] = [before, before + n_first, carried]
    for k in range(len(rows) - 2, -1, -1):  # what follows in later partitions
        if rows[k][3] == rows[k + 1][1]:
            facts[rows[k][0]][2] = facts[rows[k + 1][0]][1]
            if rows[k][5]:
                facts[rows[k][0]][1] = facts[rows[k][0]][2]
    return {p: tuple(f) for p, f in facts.items()}


def complete(group: str | None, found: Iterable[tuple], to: int) -> Iterator[tuple]:
    """Completes the nodes (level, idx, digest, total, top) below one coordinate of height ``to``: rows of their path entries, and of the node there (or the root below it)."""
    rows = sorted(found)
    total, own_top, lowest = rows[0][3], rows[0][4], rows[0][0]
    stop = min(to, own_top)
    levels: list[dict[int, str]] = [{} for _ in range(stop - lowest + 1)]
    for lv, i, d, _, _ in rows:
        levels[lv - lowest][i] = d
    entry: list[dict[int, tuple[str, str]]] = [{} for _ in levels]
    for here, up, beside in zip(levels, levels[1:], entry):
        for i in sorted({i >> 1 for i in here}):
            a, b = here[2 * i], here.get(2 * i + 1, "")
            up[i] = digest(a, b)
            beside[2 * i] = ("", b)
            if b:
                beside[2 * i + 1] = (a, "")
    for lv, i, _, _, _ in rows:
        yield ("path", group, lv, i, None, total, own_top, [entry[k - lowest][i >> (k - lv)] for k in range(lv, stop)], stop, i >> (stop - lv))
    [(end, root)] = levels[-1].items()
    yield ("node", group, stop, end, root, total, own_top, None, None, None)
