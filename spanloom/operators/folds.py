"""Ordered folds: rules whose next result depends on the last one, over sorted partitions.

``ordered_fold`` deals rows by key, sorts each partition (Spark's external sort, which spills) and streams it through a generator per
key. The generator holds its state in local variables, so what is in memory is one Arrow batch and that state,
whatever a key's number of rows; no group is collected. Where the rule allows it, a long key is cut first: linear recurrences run in
blocks of rows whose composed maps are folded instead of the rows (``affine_scan``), and an order of acceptance is
found in rounds of joins over conflicts (``greedy_accept``).

Defined results: an empty table gives no rows; null keys are a key like any other; rows with a null text or time are left out of word rules.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spanloom.operators.intervals import INTERVALS, intervals_of, overlap_join
from spanloom.registry import query, table

BATCH_ROWS = 10_000
Fold = Callable[[Iterator[tuple]], Iterator[tuple]]


def values_of(column: pa.Array) -> list:
    """The column as Python values, as ``to_pylist`` gives them; numbers, truth values and texts go through numpy, which is several times as fast."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return column.to_numpy(zero_copy_only=False).tolist()
    if not (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind)):
        return column.to_pylist()
    if not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    found = column.fill_null(False if pa.types.is_boolean(kind) else 0).to_numpy(zero_copy_only=False).astype(object)
    found[column.is_null().to_numpy(zero_copy_only=False)] = None
    return found.tolist()


def ordered_fold(rows: DataFrame, keys: list[str], order: list, schema: str, fold: Fold, ordered: bool = False) -> DataFrame:
    """Rows that ``fold`` gives for each key from its rows (tuples of all columns) in ``order``; ``schema`` is the result's.

    ``ordered`` rows are neither dealt nor sorted again: a window over ``keys`` in that order, or a fold by them, has left them so.
    """
    types = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(types)
    key_of = itemgetter(*[rows.columns.index(k) for k in keys])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for b in batches if b.num_rows for row in zip(*[values_of(c) for c in b.columns]))
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
            out.clear()
            return made

        for _, own in groupby(stream, key=key_of):
            for row in fold(own):
                out.append(row)
                if len(out) >= BATCH_ROWS:
                    yield batch()
        if out:
            yield batch()

    return (rows if ordered else rows.repartition(*keys).sortWithinPartitions(*keys, *order)).mapInArrow(run, schema)


def checkpointed(rows: DataFrame) -> DataFrame:
    """``rows`` written once below ``spark.checkpoint.dir`` (a local folder only in local mode where that is unset), lineage cut."""
    context = rows.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        base = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base and not context.master.startswith("local"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(base or f"file://{os.path.join(tempfile.gettempdir(), 'spanloom-checkpoints')}")
    return rows.checkpoint(eager=True)


# ---- words and sentences ------------------------------------------------------------------------
#: Words with a full stop that ends no sentence.
ABBREVIATIONS = (
    "mr.", "mrs.", "ms.", "dr.", "prof.", "sr.", "jr.", "st.", "vs.", "etc.", "e.g.", "i.e.", "u.s.", "u.k.", "a.m.", "p.m.",
    "no.", "inc.", "ltd.", "co.", "approx.", "vol.", "fig.",
)
TERMINAL_MARK = r"[.!?…]+[\"')\]]*$"
#: Ranges of scripts that are written without spaces between words.
UNSPACED = r"[぀-ヿ一-鿿฀-๿]"
MERGE_GAP, OVERLAP, SHORTEST_WORD = 0.25, 0.02, 0.04


def terminal(token: Column) -> Column:
    """A sentence may end behind this token: closing marks, neither an abbreviation nor a single initial."""
    w = F.lower(F.trim(token))
    return w.rlike(TERMINAL_MARK) & ~w.isin(*ABBREVIATIONS) & ~w.rlike(r"^[a-z]\.$")


def raw_words_of(conversations: DataFrame) -> DataFrame:
    """Tokens of conversations as a recogniser gives them: a leading space starts a word, marks stand by themselves, some are blank.

    Times come from places: 0.35 s a token and 1.5 s a turn, with offsets that make words overlap; probabilities and segments likewise.
    """
    flat = F.translate(F.coalesce("text", F.lit("")), "\n\r\t", "   ")
    tokens = conversations.select("conv_id", "turn", F.posexplode(F.regexp_extract_all(flat, F.lit(" ?[^ ,.;:!?]+|[,.;:!?]+"), F.lit(0))).alias("pos", "token"))
    rows = tokens.withColumn("idx", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "pos")) - 1)
    start = F.round(F.lit(0.35) * F.col("idx") + F.lit(1.5) * F.col("turn") + F.lit(0.01) * ((F.col("idx") * 37) % 11), 3)
    rows = rows.withColumn("start", start).withColumn("end", F.round(F.col("start") + 0.2 + F.lit(0.01) * ((F.col("idx") * 53) % 23), 3))
    return rows.select("conv_id", "idx", F.when(F.col("idx") % 41 == 40, " ").otherwise(F.col("token")).alias("text"), "start", "end", (((F.col("idx") * 31) % 97) / 97).alias("prob"), F.floor(F.col("idx") / 9).cast("long").alias("segment"))


RAW = """(SELECT conv_id, idx, CASE WHEN idx % 41 = 40 THEN ' ' ELSE token END AS text, start, round(start + 0.2::DOUBLE + 0.01::DOUBLE * ((idx * 53) % 23), 3) AS "end", ((idx * 31) % 97) / 97::DOUBLE AS prob, idx // 9 AS segment FROM (
  SELECT *, round(0.35::DOUBLE * idx + 1.5::DOUBLE * turn + 0.01::DOUBLE * ((idx * 37) % 11), 3) AS start FROM (
    SELECT conv_id, turn, token, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) - 1 AS idx FROM (
      SELECT conv_id, turn, unnest(ws) AS token, generate_subscripts(ws, 1) AS pos FROM (SELECT conv_id, turn, regexp_extract_all(translate(coalesce(text, ''), chr(10) || chr(13) || chr(9), '   '), ' ?[^ ,.;:!?]+|[,.;:!?]+', 0) AS ws FROM conversations)))))"""


def sanitised_words(words: DataFrame, key: str, key_type: str = "bigint", duration: float | None = None, spaced: bool = True, ordered: bool = False) -> DataFrame:
    """Words with rising times that are never empty: blank ones go, continuations join the word before them, the rest is clamped.

    ``words`` has (key, idx, text, start, end, prob, segment). A continuation has no leading space and begins less than 0.25 s
    after the word before it; ``spaced`` is false for scripts without spaces, which have none. ``duration`` cuts times off.
    ``ordered`` words are dealt by key and in order, as those of ``raw_words_of`` are; the result always is.
    """

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        last: list | None = None
        n, reached = 0, 0.0
        for k, _, text, start, end, prob, segment in rows:
            if not text.strip():
                continue
            if spaced and last is not None and not text.startswith(" ") and start - last[4] < MERGE_GAP:
                last[2] += text
                reached = last[4] = round(max(last[4], end), 3)
                last[5] = min(last[5], prob)
                continue
            if last is not None:
                yield tuple(last)
            begin = max(start, reached - OVERLAP)
            reached = max(end, begin + SHORTEST_WORD)
            if duration:
                reached = min(reached, duration)
                begin = min(begin, reached - 0.01)
            last = [k, n, text, round(begin, 3), round(reached, 3), prob, segment]
            n += 1
        if last is not None:
            yield tuple(last)

    rows = words.select(key, "idx", "text", "start", "end", F.coalesce("prob", F.lit(1.0)).alias("prob"), "segment").where("text IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL")
    return ordered_fold(rows, [key], ["idx"], f"{key} {key_type}, idx bigint, text string, start double, end double, prob double, segment bigint", fold, ordered)


def sentence_ranges(words: DataFrame, key: str, key_type: str = "bigint", pause: float = 1.2, most: int = 45, segment_pause: float = 0.6) -> DataFrame:
    """(key, sentence, first_word, last_word): word ranges that close at terminal marks, pauses, segment ends with a shorter pause, or ``most`` words.

    A run of ``most`` words closes at its last comma, semicolon or colon beyond its fifth word, else where it is; the words
    behind that mark begin the next one. The state is a sentence's first word, its last such mark and the word before.
    """

    def fold(found: Iterator[tuple]) -> Iterator[tuple]:
        for k, n, first, close, _ in _sentences(found, pause, most, segment_pause):
            yield k, n, first, close

    return ordered_fold(_marked(words, key), [key], ["idx"], f"{key} {key_type}, sentence bigint, first_word bigint, last_word bigint", fold)


def _marked(words: DataFrame, key: str, *columns: str) -> DataFrame:
    """Words with whether they end a sentence by their text, or stand before a pause for breath."""
    marks = [F.coalesce(terminal(F.col("text")), F.lit(False)).alias("ends"), F.coalesce(F.trim(F.col("text")).rlike("[,;:]$"), F.lit(False)).alias("comma")]
    return words.select(key, "idx", "start", "end", "segment", *marks, *columns)


def _sentences(found: Iterator[tuple], pause: float, most: int, segment_pause: float) -> Iterator[tuple]:
    """(key, sentence, first word, last word, rows) of one key's marked words; ``rows`` are those words, at most ``most``."""
    first, comma, n = None, -1, 0
    held: list[tuple] = []
    rows = iter(found)
    row = next(rows, None)
    while row is not None:
        following = next(rows, None)
        k, i, _, end, segment, ends, is_comma = row[:7]
        if following is None:
            ends = True
        elif not ends and following[2] is not None and end is not None:
            gap = following[2] - end
            ends = not gap < pause or (None not in (segment, following[4]) and segment != following[4] and not gap < segment_pause)
        held.append(row)
        first = i if first is None else first
        if is_comma:
            comma = i
        close = i if ends else None
        if close is None and i - first + 1 >= most:
            close = comma if comma >= first + 5 else i
        if close is not None:
            yield k, n, first, close, [r for r in held if r[1] <= close]
            held = [r for r in held if r[1] > close]
            n, first = n + 1, close + 1
        if following is None and first <= i:
            yield k, n, first, i, held
        row = following


def join_tokens(tokens: Column) -> Column:
    """Text of tokens: a space only where neither side has one and a spaced script's letter or digit begins; runs of space become one."""
    joined = F.aggregate(
        tokens, F.lit(""),
        lambda acc, w: F.when((acc == "") | w.rlike(r"^\s") | acc.rlike(r"\s$") | ~w.rlike(r"^[\p{L}\p{N}]") | w.rlike(UNSPACED), F.concat(acc, w)).otherwise(F.concat(acc, F.lit(" "), w)),
    )
    return F.trim(F.regexp_replace(joined, r"\s+", " "))


def built_sentences(words: DataFrame, key: str, key_type: str = "bigint", pause: float = 1.2, most: int = 45, segment_pause: float = 0.6, ordered: bool = False) -> DataFrame:
    """Sentences of sanitised words with times and text; at most ``most`` words meet in a row. ``ordered`` words are dealt by key and in order."""

    def fold(found: Iterator[tuple]) -> Iterator[tuple]:
        for k, n, first, close, own in _sentences(found, pause, most, segment_pause):
            yield k, n, first, close, min((r[2] for r in own if r[2] is not None), default=None), own[-1][3], [r[7] for r in own]

    schema = f"{key} {key_type}, sentence bigint, first_word bigint, last_word bigint, start double, end double, ws array<string>"
    rows = ordered_fold(_marked(words.where(F.col(key).isNotNull()), key, "text"), [key], ["idx"], schema, fold, ordered)
    return rows.withColumn("text", join_tokens(F.filter("ws", lambda x: x.isNotNull()))).drop("ws")


#: The same by recursion over places: one row a conversation and step.
CLEAN = f"""raw AS MATERIALIZED (SELECT *, (trim(text) = '') AS blank FROM {RAW}), steps(conv_id, idx, n, text, start, "end", prob, segment, reached) AS (
  SELECT DISTINCT conv_id, -1::BIGINT, -1::BIGINT, ''::VARCHAR, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::BIGINT, 0::DOUBLE FROM raw
  UNION ALL SELECT conv_id, idx, CASE WHEN blank OR goes_on THEN n ELSE n + 1 END, CASE WHEN blank THEN text WHEN goes_on THEN text || w ELSE w END,
    CASE WHEN blank OR goes_on THEN start ELSE round(begin, 3) END, CASE WHEN blank THEN "end" WHEN goes_on THEN round(greatest("end", e), 3) ELSE round(greatest(e, begin + 0.04), 3) END,
    CASE WHEN blank THEN prob WHEN goes_on THEN least(prob, p) ELSE p END, CASE WHEN blank OR goes_on THEN segment ELSE g END,
    CASE WHEN blank THEN reached WHEN goes_on THEN round(greatest("end", e), 3) ELSE greatest(e, begin + 0.04) END
  FROM (SELECT r.conv_id, r.idx, r.blank, n, f.text, f.start, f."end", f.prob, f.segment, reached, r.text AS w, r."end" AS e, r.prob AS p, r.segment AS g,
      n >= 0 AND r.text[1] <> ' ' AND r.start - f."end" < 0.25 AS goes_on, greatest(r.start, reached - 0.02) AS begin FROM steps f JOIN raw r ON r.conv_id = f.conv_id AND r.idx = f.idx + 1)
), clean AS MATERIALIZED (SELECT conv_id, n AS idx, arg_max(text, idx) AS text, arg_max(start, idx) AS start, arg_max("end", idx) AS "end", arg_max(prob, idx) AS prob, arg_max(segment, idx) AS segment FROM steps WHERE n >= 0 GROUP BY 1, 2)"""


@query("sanitised_words", f"""WITH RECURSIVE {CLEAN} SELECT conv_id, idx, text, start, "end", prob, segment FROM clean""")
def sanitised_words_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitised_words(raw_words_of(table(spark, sf_dir, "conversations")), "conv_id", ordered=True)


_ABBREVIATIONS = ", ".join(f"'{x}'" for x in ABBREVIATIONS)
JOINED = r"""trim(regexp_replace(list_reduce(list(text ORDER BY idx), lambda acc, w: CASE WHEN acc = '' OR regexp_matches(w, '^\s') OR regexp_matches(acc, '\s$') OR NOT regexp_matches(w, '^[\p{L}\p{N}]')
  OR regexp_matches(w, '[\x{3040}-\x{30ff}\x{4e00}-\x{9fff}\x{0e00}-\x{0e7f}]') THEN acc || w ELSE acc || ' ' || w END, ''), '\s+', ' ', 'g'))"""


RUNS = f"""marks AS MATERIALIZED (SELECT *, coalesce(last OR gap >= 1.2 OR (next_segment <> segment AND gap >= 0.6) OR (regexp_matches(w, '[.!?…]+["'')\\]]*$') AND w NOT IN ({_ABBREVIATIONS}) AND NOT regexp_matches(w, '^[a-z]\\.$')), false) AS ends,
    max(CASE WHEN regexp_matches(w, '[,;:]$') THEN idx END) OVER (PARTITION BY conv_id ORDER BY idx) AS comma FROM (
      SELECT *, lower(trim(text)) AS w, lead(start) OVER o - "end" AS gap, lead(segment) OVER o AS next_segment, lead(idx) OVER o IS NULL AS last FROM clean WINDOW o AS (PARTITION BY conv_id ORDER BY idx))),
    runs(conv_id, idx, first, closed) AS (
      SELECT DISTINCT conv_id, -1::BIGINT, 0::BIGINT, NULL::BIGINT FROM marks
      UNION ALL SELECT conv_id, idx, first, CASE WHEN ends THEN idx WHEN idx - first + 1 >= 45 THEN CASE WHEN comma >= first + 5 THEN comma ELSE idx END END
      FROM (SELECT m.*, coalesce(r.closed + 1, r.first) AS first FROM runs r JOIN marks m ON m.conv_id = r.conv_id AND m.idx = r.idx + 1)),
    found AS (SELECT conv_id, first AS first_word, closed AS last_word FROM runs WHERE closed IS NOT NULL
      UNION ALL SELECT conv_id, closed + 1, idx FROM runs JOIN (SELECT conv_id, max(idx) AS idx FROM marks GROUP BY 1) USING (conv_id, idx) WHERE closed < idx)"""


@query(
    "built_sentences",
    f"""WITH RECURSIVE {CLEAN}, {RUNS}
    SELECT conv_id, sentence, first_word, last_word, start, "end", md5(text) AS digest FROM (
      SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY first_word) - 1 AS sentence, first_word, last_word, start, "end", text FROM (
        SELECT f.conv_id, first_word, last_word, min(start) AS start, arg_max("end", idx) AS "end", {JOINED} AS text FROM found f JOIN clean c ON c.conv_id = f.conv_id AND idx BETWEEN first_word AND last_word GROUP BY 1, 2, 3))""",
)
def built_sentences_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = sanitised_words(raw_words_of(table(spark, sf_dir, "conversations")), "conv_id", ordered=True)
    return built_sentences(words, "conv_id", ordered=True).select("conv_id", "sentence", "first_word", "last_word", "start", "end", F.md5("text").alias("digest"))


# ---- first-come acceptance ------------------------------------------------------------------------
def greedy_accept(items: DataFrame, conflicts: DataFrame, item: str) -> DataFrame:
    """(item, accepted): in their order, items are accepted unless an earlier accepted one is in conflict with them.

    ``conflicts`` has (item, earlier). An item is settled once all its earlier conflicts are: it is accepted when none of them is left,
    rejected when one was accepted. Each round settles all such items by joins, so rounds number at most the
    longest chain of conflicts, and no group of items meets in one task.
    """
    left = checkpointed(conflicts.select(item, "earlier").distinct())
    open_items, settled = items.select(item).distinct(), None
    while True:
        blocked = left.select(item).distinct()
        accepted = open_items.join(blocked, item, "left_anti")
        out = left.join(accepted.withColumnRenamed(item, "earlier"), "earlier", "left_semi").select(item).distinct()
        now = checkpointed(accepted.withColumn("accepted", F.lit(True)).unionByName(out.withColumn("accepted", F.lit(False))))
        settled = now if settled is None else settled.unionByName(now)
        gone = now.select(F.col(item).alias("earlier"))
        left = checkpointed(left.join(now, item, "left_anti").join(gone, "earlier", "left_anti").select(item, "earlier"))
        open_items = checkpointed(open_items.join(now, item, "left_anti"))
        if open_items.isEmpty():
            return settled


@query(
    "greedy_accept",
    f"""WITH RECURSIVE ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY interest DESC, event_id) AS k FROM {INTERVALS}), kept(user_id, k, event_id, accepted, spans) AS (
      SELECT DISTINCT user_id, 0::BIGINT, NULL::BIGINT, false, []::STRUCT(a DOUBLE, b DOUBLE)[] FROM ranked
      UNION ALL SELECT user_id, k, event_id, fits, CASE WHEN fits THEN list_append(spans, {{a: a, b: b}}) ELSE spans END FROM (
        SELECT r.*, spans, len(list_filter(spans, lambda s: least(s.b, r.b) - greatest(s.a, r.a) > 0.3 * greatest(least(s.b - s.a, r.b - r.a), 0.01))) = 0 AS fits FROM kept c JOIN ranked r ON r.user_id = c.user_id AND r.k = c.k + 1))
    SELECT event_id, accepted FROM kept WHERE k > 0""",
)
def greedy_accept_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of each user in the order of interest: one that overlaps an accepted one by more than 0.3 of the shorter is refused."""
    spans = checkpointed(intervals_of(table(spark, sf_dir, "events")).select("user_id", "event_id", "interest", "a", "b"))
    other = spans.select("user_id", F.col("event_id").alias("earlier"), F.col("interest").alias("better"), F.col("a").alias("c"), F.col("b").alias("d"))
    met = overlap_join(spans, other, "user_id", 14_400).where((F.col("better") > F.col("interest")) | ((F.col("better") == F.col("interest")) & (F.col("earlier") < F.col("event_id"))))
    shorter = F.greatest(F.least(F.col("b") - F.col("a"), F.col("d") - F.col("c")), F.lit(0.01))
    return greedy_accept(spans, met.where(F.col("overlap") > 0.3 * shorter), "event_id")


# ---- camera path ----------------------------------------------------------------------------------
def holds(series: DataFrame, key: str, key_type: str, dead_zone: float, dwell: float, settle: float = 0.5) -> DataFrame:
    """(key, hold, t, x): where a camera settles. A new hold begins once x stayed out of the dead zone for ``dwell`` seconds.

    Its place is the median of x over the next ``settle`` seconds, a window Spark computes; the fold keeps the place and since when x is outside.
    ``series`` has (key, t, x) without nulls.
    """
    ahead = Window.partitionBy(key).orderBy(F.round(F.col("t") * 1e6).cast("long")).rangeBetween(0, round(settle * 1e6) - 1)
    rows = series.select(key, "t", "x", F.percentile("x", F.lit(0.5)).over(ahead).alias("middle"))

    def fold(found: Iterator[tuple]) -> Iterator[tuple]:
        place, since, n = None, None, 0
        for k, t, x, middle in found:
            if place is None:
                place = middle
                yield k, n, t, place
            if abs(x - place) > dead_zone:
                since = t if since is None else since
                if t - since >= dwell:
                    place, n = middle, n + 1
                    yield k, n, since, place
                    since = None
            else:
                since = None

    return ordered_fold(rows, [key], ["t"], f"{key} {key_type}, hold bigint, t double, x double", fold)


def rendered_path(places: DataFrame, times: DataFrame, key: str, cut: float, shortest: float = 0.35, longest: float = 1.0, lead: float = 0.25) -> DataFrame:
    """(key, t, x): the camera's place at each time: eased moves between holds, jumps where they are ``cut`` or more apart.

    The last hold whose move has begun decides: one union of holds and times, one running maximum by hold number.
    """
    w = Window.partitionBy(key).orderBy("hold")
    before = F.lag("x").over(w)
    gap = F.abs(F.col("x") - before)
    moves = places.select(key, "hold", "t", "x", before.alias("prev"), (gap >= cut).alias("jump"), F.least(F.lit(longest), F.greatest(F.lit(shortest), 0.3 + 1.6 * gap)).alias("took"))
    begins = F.when(F.col("hold") == 0, F.lit(float("-inf"))).when(F.col("jump"), F.col("t")).otherwise(F.col("t") - lead)
    known = moves.select(key, begins.alias("t"), F.when(F.col("jump"), 0).otherwise(2).alias("side"), F.struct("hold", F.col("x").alias("target"), "prev", "jump", begins.alias("begins"), "took").alias("move"))
    asked = times.select(key, "t", F.lit(1).alias("side"), F.lit(None).cast(known.schema["move"].dataType).alias("move"))
    last = F.max("move").over(Window.partitionBy(key).orderBy("t", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = known.unionByName(asked).withColumn("m", last).where("side = 1")
    u = (F.col("t") - F.col("m.begins")) / F.col("m.took")
    eased = F.col("m.prev") + (F.col("m.target") - F.col("m.prev")) * F.when(u < 0.5, 4 * u * u * u).otherwise(1 - F.pow(-2 * u + 2, 3) / 2)
    return rows.select(key, "t", F.when((F.col("m.hold") == 0) | F.col("m.jump") | (u >= 1), F.col("m.target")).otherwise(eased).alias("x"))


def affine_scan(rows: DataFrame, key: str, key_type: str, matrix: np.ndarray, gain: np.ndarray, start: np.ndarray, block: int = 4096) -> DataFrame:
    """(key, i, y): y is the first component of s(i) = matrix s(i - 1) + gain x(i), and s = start x(i) where ``cut`` is true or i is 0.

    ``rows`` has (key, i, x, cut) with i = 0, 1, ... without gaps. Each block of rows is composed into one affine map of the state before
    it; a fold over blocks carries the state; every block then runs from its own first state. A task goes through its sorted blocks
    batch by batch, all blocks of a batch at once, and a long series is spread over all tasks.
    """
    m, g, s0 = (np.asarray(v, float) for v in (matrix, gain, start))
    size = len(g)

    def steps(i: np.ndarray, x: np.ndarray, cut: np.ndarray, state: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last states of blocks of rows begins..ends from their ``state`` (blocks, size, columns), and the first component after each row.

        All blocks go one row on at a time; the last column alone takes what the row adds.
        """
        y = np.empty(len(i))
        for r in range(int((ends - begins).max(initial=0))):
            on = np.flatnonzero(begins + r < ends)
            at = begins[on] + r
            anew = cut[at] | (i[at] == 0)
            moved = np.where(anew[:, None, None], 0.0, m @ state[on])
            moved[:, :, -1] += np.where(anew[:, None], s0, g) * x[at, None]
            state[on] = moved
            y[at] = moved[:, 0, -1]
        return state, y

    def whole_blocks(batches: Iterator[pa.RecordBatch], is_first: Callable[[pa.Table], np.ndarray]) -> Iterator[tuple[pa.Table, np.ndarray]]:
        """Tables of whole blocks and where these begin; what a batch has of its last block waits for the next one."""
        left = None
        for got in batches:
            rows = pa.Table.from_batches([got]) if left is None else pa.concat_tables([left, pa.Table.from_batches([got])])
            begins = np.flatnonzero(is_first(rows))
            if len(begins):
                left = rows.slice(begins[-1])
                if len(begins) > 1:
                    yield rows.slice(0, begins[-1]).combine_chunks(), begins[:-1]
        if left is not None and left.num_rows:
            yield left.combine_chunks(), np.array([0])

    def numbers(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        of = lambda c: rows[c].to_numpy(zero_copy_only=False)
        return of("i"), of("x").astype(float), np.array([bool(v) for v in of("cut")])

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begins in whole_blocks(batches, lambda t: t["i"].to_numpy() % block == 0):
            unit = np.tile(np.hstack([np.eye(size), np.zeros((size, 1))]), (len(begins), 1, 1))  # columns: unit states, then the constant part
            last, _ = steps(*numbers(rows), unit, begins, np.append(begins[1:], rows.num_rows))
            lists = [pa.array(v.tolist(), pa.list_(pa.float64())) for v in (last[:, :, :size].reshape(len(begins), -1), last[:, :, size])]
            yield from pa.table([rows[key].take(begins), rows["block"].take(begins), *lists], [key, "block", "linear", "constant"]).combine_chunks().to_batches()

    def carry(found: Iterator[tuple]) -> Iterator[tuple]:
        state = np.zeros(size)
        for k, number, linear, constant in found:
            yield k, number, state.tolist()
            state = np.reshape(linear, (size, size)) @ state + np.asarray(constant)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, marks in whole_blocks(batches, lambda t: t["i"].to_numpy() < 0):
            states = np.array(rows["entry"].take(marks).to_pylist())[:, :, None]
            _, y = steps(*numbers(rows), states, marks + 1, np.append(marks[1:], rows.num_rows))
            made = pa.table([rows[key], rows["i"], pa.array(y)], [key, "i", "y"])
            yield from made.filter(pa.array(rows["i"].to_numpy() >= 0)).combine_chunks().to_batches()

    blocks = rows.select(key, F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x"), F.coalesce("cut", F.lit(False)).alias("cut"), F.floor(F.col("i") / block).alias("block"))
    dealt = lambda rows: rows.repartition(key, "block").sortWithinPartitions(key, "block", "i")
    maps = dealt(blocks).mapInArrow(compose, f"{key} {key_type}, block bigint, linear array<double>, constant array<double>")
    entries = ordered_fold(maps, [key], ["block"], f"{key} {key_type}, block bigint, entry array<double>", carry)
    heads = entries.select(key, F.lit(-1).cast("long").alias("i"), F.lit(0.0).alias("x"), F.lit(False).alias("cut"), "block", "entry")  # before the rows of their block
    return dealt(blocks.withColumn("entry", F.lit(None).cast("array<double>")).unionByName(heads)).mapInArrow(run, f"{key} {key_type}, i bigint, y double")


def spring(series: DataFrame, key: str, key_type: str, dt: float, omega: float = 9.0, block: int = 4096) -> DataFrame:
    """(key, i, y): a critically damped follower of x, run forward and backward and averaged; it starts anew where ``cut`` is true.

    ``series`` has (key, i, x, cut) with i from 0. With d = place - target a step is d' = (d + (v + omega d) dt) e, v' = (v - omega (v +
    omega d) dt) e, e = exp(-omega dt): a linear map of (place, velocity) and the target. The backward run starts anew one row behind a cut.
    """
    e, o = np.exp(-omega * dt), omega * dt
    matrix = e * np.array([[1 + o, dt], [-omega * o, 1 - o]])
    gain = np.array([1 - e * (1 + o), e * omega * o])
    last = F.max("i").over(Window.partitionBy(key))
    w = Window.partitionBy(key).orderBy("i")
    back = series.select(key, (last - F.col("i")).alias("i"), "x", F.coalesce(F.lead("cut").over(w), F.lit(False)).alias("cut"))
    there = affine_scan(series, key, key_type, matrix, gain, np.array([1.0, 0.0]), block)
    returned = affine_scan(back, key, key_type, matrix, gain, np.array([1.0, 0.0]), block)
    returned = returned.withColumn("i", F.max("i").over(Window.partitionBy(key)) - F.col("i"))
    return there.join(returned.select(key, "i", F.col("y").alias("z")), [key, "i"]).select(key, "i", ((F.col("y") + F.col("z")) / 2).alias("y"))


def track_of(events: DataFrame) -> DataFrame:
    """Events of each user as a track: a place in 0..1 every quarter of a second; a purchase is a cut."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events.select("user_id", (F.row_number().over(w) - 1).cast("long").alias("i"), (F.col("value") % 100 / 100).alias("x"), (F.col("event_type") == "purchase").alias("cut"))
    return rows.withColumn("t", F.col("i") * 0.25)


TRACK = "(SELECT *, i * 0.25::DOUBLE AS t FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value % 100 / 100 AS x, event_type = 'purchase' AS cut FROM events))"
_HOLDS = f"""track AS MATERIALIZED (SELECT *, median(x) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN CURRENT ROW AND 0.499999999 FOLLOWING) AS middle FROM {TRACK}), steps(user_id, i, place, since, hold, t) AS (
  SELECT DISTINCT user_id, -1::BIGINT, NULL::DOUBLE, NULL::DOUBLE, -1::BIGINT, NULL::DOUBLE FROM track
  UNION ALL SELECT user_id, i, CASE WHEN moves OR hold < 0 THEN middle ELSE place END, CASE WHEN outside AND NOT moves THEN from_t END, CASE WHEN moves OR hold < 0 THEN hold + 1 ELSE hold END, CASE WHEN hold < 0 THEN t_now WHEN moves THEN from_t END FROM (
    SELECT *, outside AND t_now - from_t >= 0.5 AS moves FROM (SELECT r.user_id, r.i, r.t AS t_now, r.middle, place, hold, abs(r.x - coalesce(place, r.middle)) > 0.2 AS outside, coalesce(since, r.t) AS from_t FROM steps s JOIN track r ON r.user_id = s.user_id AND r.i = s.i + 1)))
, places AS MATERIALIZED (SELECT user_id, hold, t, place AS x FROM steps WHERE t IS NOT NULL)"""


def track_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holds(track_of(table(spark, sf_dir, "events")), "user_id", "bigint", 0.2, 0.5)


@query("holds", f"WITH RECURSIVE {_HOLDS} SELECT user_id, hold, t, round(x, 6) AS x FROM places")
def holds_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track_holds(spark, sf_dir).select("user_id", "hold", "t", F.round("x", 6).alias("x"))


@query(
    "camera_path",
    f"""WITH RECURSIVE {_HOLDS}, moves AS (SELECT *, abs(x - prev) >= 0.4 AS jump, least(1.0, greatest(0.35, 0.3 + 1.6::DOUBLE * abs(x - prev))) AS took FROM (SELECT *, lag(x) OVER (PARTITION BY user_id ORDER BY hold) AS prev FROM places))
    SELECT user_id, t_now AS t, round(CASE WHEN hold = 0 OR jump OR u >= 1 THEN x ELSE prev + (x - prev) * CASE WHEN u < 0.5 THEN 4 * u * u * u ELSE 1 - pow(-2 * u + 2, 3) / 2 END END, 6) AS x FROM (
      SELECT r.user_id, r.t AS t_now, m.hold, m.x, m.prev, m.jump, (r.t - (m.t - 0.25)) / m.took AS u, row_number() OVER (PARTITION BY r.user_id, r.t ORDER BY m.hold DESC) AS k
      FROM track r JOIN moves m ON m.user_id = r.user_id AND (m.hold = 0 OR (m.jump AND r.t >= m.t) OR (NOT m.jump AND r.t > m.t - 0.25))) WHERE k = 1""",
)
def camera_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The camera's place at each sample of its track: holds with a dead zone, eased moves, jumps of 0.4 and more."""
    times = track_of(table(spark, sf_dir, "events")).select("user_id", "t")
    return rendered_path(track_holds(spark, sf_dir), times, "user_id", 0.4).select("user_id", "t", F.round("x", 6).alias("x"))


def _spring_sql(name: str, rows: str) -> str:
    return f"""{name}(user_id, i, p, v) AS (SELECT user_id, i, x, 0::DOUBLE FROM {rows} WHERE i = 0
      UNION ALL SELECT user_id, i, CASE WHEN cut THEN x ELSE x + (d + (v + 9 * d) * 0.25) * exp(-2.25::DOUBLE) END, CASE WHEN cut THEN 0 ELSE (v - 9 * (v + 9 * d) * 0.25) * exp(-2.25::DOUBLE) END
      FROM (SELECT r.user_id, r.i, r.x, r.cut, s.v, s.p - r.x AS d FROM {name} s JOIN {rows} r ON r.user_id = s.user_id AND r.i = s.i + 1))"""


@query(
    "spring",
    f"""WITH RECURSIVE track AS MATERIALIZED (SELECT user_id, i, x, cut, max(i) OVER (PARTITION BY user_id) AS n FROM {TRACK}),
    back AS MATERIALIZED (SELECT user_id, n - i AS i, x, coalesce(lead(cut) OVER (PARTITION BY user_id ORDER BY i), false) AS cut, n FROM track), {_spring_sql("there", "track")}, {_spring_sql("returned", "back")}
    SELECT user_id, i, round((a.p + b.p) / 2, 9) AS y FROM there a JOIN (SELECT r.user_id, n - r.i AS i, p FROM returned r JOIN back USING (user_id, i)) b USING (user_id, i)""",
)
def spring_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The track followed by a damped spring, in blocks of 16 samples: composed maps, not samples, are folded."""
    return spring(track_of(table(spark, sf_dir, "events")).select("user_id", "i", "x", "cut"), "user_id", "bigint", 0.25, block=16).select("user_id", "i", F.round("y", 9).alias("y"))
