"""Caption pages and lines: words grouped into pages that fit, lines broken so that the widest is as narrow as can be.

Pages are an ordered fold: the state is one page of words, at most the page's limit, and the page before it, which short pages may join. Widths
come from a table of character widths, so no font is measured. Lines of a page are found by trying every break, a page being
a few words long; the same choice is also an expression over the array of widths (``balanced_breaks``).

Defined results: words without text are left out; a page that fits no lines is a page of its own with null breaks; null keys are a key;
empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.folds import ordered_fold
from spanloom.operators.text import WORDS, words_of
from spanloom.registry import query, table

SENTENCE_ENDS, CLAUSE_ENDS = (".", "!", "?", "…"), (",", ";", ":")
#: Widths in ems of characters of a common sans-serif face; others are ``OTHER`` wide.
GLYPHS = {c: w for group, w in (("iljI.,;:!|'", 0.28), ("ftr()-", 0.36), ("mwMW", 0.86), ("ABCDEFGHKNOPQRSTUVXYZ", 0.66)) for c in group}
OTHER, SPACE = 0.56, 0.28


@dataclass(frozen=True)
class PageRules:
    """Limits of a page: words, seconds, pause before the next word, lines and their width in ems, and how much a spoken word grows."""

    words: int = 6
    seconds: float = 2.8
    pause: float = 0.5
    lines: int = 2
    width: float = 12.0
    growth: float = 0.1
    reserve: float = 0.7
    flash: float = 0.3
    linger: float = 0.35
    glyphs: Mapping[str, float] = field(default_factory=lambda: dict(GLYPHS))

    def width_of(self, text: str) -> float:
        return sum(self.glyphs.get(c, OTHER) for c in text)

    def line(self, widths: list[float]) -> float:
        """Width of words in a line: spaces that leave room for the larger neighbour to grow, and growth at both ends."""
        if not widths:
            return 0.0
        gaps = sum(SPACE + self.reserve * self.growth * max(a, b) / 2 for a, b in zip(widths, widths[1:]))
        return sum(widths) + gaps + self.growth * (widths[0] + widths[-1]) / 2

    def breaks(self, widths: list[float]) -> list[int] | None:
        """First words of the lines after the first: the fewest lines that fit, then the narrowest widest line, then the earliest breaks; null if none fit."""
        for n in range(1, self.lines + 1):
            best = None
            for cut in combinations(range(1, len(widths)), n - 1):
                edges = [0, *cut, len(widths)]
                widest = max(self.line(widths[a:b]) for a, b in zip(edges, edges[1:]))
                if widest <= self.width and (best is None or widest < best[0]):
                    best = (widest, list(cut))
            if best:
                return best[1]
        return None


def caption_pages(words: DataFrame, key: str, key_type: str, rules: PageRules = PageRules()) -> DataFrame:
    """(key, page, first_word, last_word, start, end, breaks) of ``words`` (key, idx, text, start, end).

    A page ends at its limit of words or seconds, at a pause, behind a sentence, behind a clause of two words or more, and before a word that
    would not fit. A page shown for less than ``flash`` seconds joins the next one if both fit together, else the one before.
    """

    def pages(found: Iterator[tuple]) -> Iterator[list[tuple]]:
        page: list[tuple] = []
        for w in found:
            if page:
                last = page[-1][2].strip()
                ends = last.endswith(SENTENCE_ENDS) or (last.endswith(CLAUSE_ENDS) and len(page) >= 2)
                late = w[3] - page[-1][4] > rules.pause or w[4] - page[0][3] > rules.seconds
                if len(page) >= rules.words or ends or late or not fits([*page, w]):
                    yield page
                    page = []
            page.append(w)
        if page:
            yield page

    def fits(page: list[tuple]) -> bool:
        return rules.breaks([rules.width_of(w[2].strip()) for w in page]) is not None

    def merged(found: Iterator[tuple]) -> Iterator[list[tuple]]:
        """One page is held back, as a short one behind it may join it."""
        held, page = None, None
        for following in chain(pages(found), [None]):
            if page is not None:
                until = following[0][3] if following else page[-1][4] + rules.linger
                if until - page[0][3] < rules.flash and following and fits(page + following):
                    page = page + following
                    continue
                if until - page[0][3] < rules.flash and held and fits(held + page):
                    held = held + page
                else:
                    if held:
                        yield held
                    held = page
            page = following
        if held:
            yield held

    def fold(found: Iterator[tuple]) -> Iterator[tuple]:
        for n, page in enumerate(merged(found)):
            yield page[0][0], n, page[0][1], page[-1][1], page[0][3], page[-1][4], rules.breaks([rules.width_of(w[2].strip()) for w in page])

    rows = words.select(key, "idx", "text", "start", "end").where("trim(text) <> '' AND start IS NOT NULL AND end IS NOT NULL")
    return ordered_fold(rows, [key], ["idx"], f"{key} {key_type}, page bigint, first_word bigint, last_word bigint, start double, end double, breaks array<bigint>", fold)


def glyph_width(text: Column, glyphs: Mapping[str, float] = GLYPHS) -> Column:
    """Width of a text in ems by the table, as an expression."""
    table_ = F.create_map(*[F.lit(x) for pair in glyphs.items() for x in pair])
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0.0), lambda acc, c: acc + F.coalesce(F.try_element_at(table_, c), F.lit(OTHER)))


def balanced_breaks(widths: Column, width: float, growth: float, reserve: float = 0.7) -> Column:
    """(widest, cut) of the best two lines of an array of widths: the narrowest widest line, the earliest break; null if none fits."""

    def line(a: Column, n: Column) -> Column:
        part = F.slice(widths, a + 1, n)
        pairs = F.zip_with(F.slice(part, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(part, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda x, y: SPACE + reserve * growth * F.greatest(x, y) / 2)
        total = F.aggregate(F.concat(part, pairs), F.lit(0.0), lambda acc, x: acc + x)
        return total + growth * (F.element_at(part, 1) + F.element_at(part, -1)) / 2

    size = F.size(widths)
    options = F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.struct(F.greatest(line(F.lit(0), k), line(k, size - k)).alias("widest"), k.alias("cut")))
    return F.when(size >= 2, F.array_min(F.filter(options, lambda o: o["widest"] <= width)))


_WIDTHS = " + ".join(f"{w} * (length(t) - length(replace(t, '{c.replace(chr(39), chr(39) * 2)}', '')))" for c, w in GLYPHS.items())
_KNOWN = "".join(GLYPHS).replace("'", "''")


@query("caption_pages")
def caption_pages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of two lines of every conversation's words."""
    words = words_of(table(spark, sf_dir, "conversations")).select("conv_id", "idx", F.col("word").alias("text"), "start", "end")
    return caption_pages(words, "conv_id", "bigint")


@query(
    "balanced_lines",
    f"""WITH w AS (SELECT conv_id, idx // 5 AS page, list(({_WIDTHS.replace("length(t)", "length(word)").replace("(t,", "(word,")} + {OTHER} * length(translate(word, '{_KNOWN}', '')))::DOUBLE ORDER BY idx) AS ws FROM {WORDS} GROUP BY 1, 2 HAVING count(*) >= 2),
    o AS (SELECT conv_id, page, cut, list_max(list_transform([ws[1:cut], ws[cut + 1:]], lambda p: list_sum(p) + coalesce(list_sum(list_transform(range(1, len(p)), lambda i: {SPACE} + 0.035::DOUBLE * greatest(p[i], p[i + 1]))), 0) + 0.05::DOUBLE * (p[1] + p[-1]))) AS widest FROM (SELECT *, unnest(range(1, len(ws))) AS cut FROM w))
    SELECT conv_id, page, round(min(widest), 6) AS widest FROM o GROUP BY 1, 2 HAVING min(widest) <= 16""",
)
def balanced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrowest widest line of two for every five words, where two lines of 16 ems hold them."""
    words = words_of(table(spark, sf_dir, "conversations")).select("conv_id", "idx", F.floor(F.col("idx") / 5).alias("page"), glyph_width(F.col("word")).alias("w"))
    rows = words.groupBy("conv_id", "page").agg(F.array_sort(F.collect_list(F.struct("idx", "w"))).alias("ws")).withColumn("ws", F.transform("ws", lambda x: x["w"]))
    best = balanced_breaks(F.col("ws"), 16.0, 0.1)
    return rows.select("conv_id", F.col("page").cast("long").alias("page"), F.round(best["widest"], 6).alias("widest")).where("widest IS NOT NULL")
