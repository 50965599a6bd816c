"""Regex matches with positions, in built-in functions only.

Splitting a text at a pattern gives the pieces between matches and extracting gives the matches, so
running lengths give each match's start. Offsets count code points; ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FOUND = "array<struct<start:bigint,end:bigint,value:string,part:string>>"


def any_case(word: str) -> str:
    """Pattern for ``word`` in which A-Z match in either case and nothing else does."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


CHUNK = 256


def matches(text: Column, pattern: str, part: int = 0) -> Column:
    """Leftmost non-overlapping matches; ``part`` is the group kept beside the whole match.

    Running lengths are added up in chunks of ``CHUNK`` matches, as appending to an array copies it.
    """
    empty = F.array().cast(FOUND)
    pieces = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(part)) if part else values
    rows = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(values)).alias("piece"), values.alias("value"), parts.alias("part"))

    def placed(chunk: Column, at: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + F.length(x["piece"])
            end = begin + F.length(x["value"])
            one = F.struct(begin.cast("bigint").alias("start"), end.cast("bigint").alias("end"), x["value"].alias("value"), x["part"].alias("part"))
            return F.struct(end.cast("bigint").alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        return F.aggregate(chunk, F.struct(at.cast("bigint").alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    def all_of(rows: Column) -> Column:
        def gather(acc: Column, x: Column) -> Column:
            at = F.coalesce(F.try_element_at(F.try_element_at(acc, F.lit(-1)), F.lit(-1))["end"], F.lit(0))
            return F.concat(acc, F.array(placed(F.slice(rows, x * CHUNK + 1, F.lit(CHUNK)), at)))

        chunks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(rows) - 1) / CHUNK)).cast("int"))
        return F.flatten(F.aggregate(chunks, F.array().cast(f"array<{FOUND}>"), gather))

    return F.when(~text.rlike(pattern), empty).otherwise(F.element_at(F.transform(F.array(rows), all_of), 1))


def digest_text(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of spans (start, kind number, end, ...) by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    one = F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
