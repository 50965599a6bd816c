"""Edits of a cut and what they do to everything on its output timeline; clip bounds between words.

A cut is a table of source ranges per key; running sums of their durations make it a piecewise map from source to output time. Points
meet ranges as of their time (one union, one window), so a re-timing from an old cut to a new one is the composition output ->
source by the old map -> output by the new one, whatever the number of ranges. Bounds of clips are looked up by
equi-joins on word numbers; scene cuts meet bounds by buckets as wide as the window in which they count.

Defined results: points in removed material have no output time (null) and their items go; points behind a cut's end map to its
last end; ties go to the earlier range; null times stay null; keys without ranges give null; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators.folds import checkpointed
from spanloom.operators.intervals import MONO, mono_intervals_of, output_offsets, to_millis
from spanloom.operators.text import SENTENCES, WORDS, sentences_of, words_of
from spanloom.registry import query, table

EDGE = 1e-6


def first_at_or_before(points: DataFrame, known: DataFrame, key: str, t: str, s: str, value: str, strict: bool = False) -> DataFrame:
    """``points`` with the struct ``value`` of the last row of ``known`` whose ``s`` is at most ``t``, or below it if ``strict``; null times get null."""
    kind = known.schema[value].dataType
    asked = points.select(key, F.col(t).alias("_t"), F.lit(-1 if strict else 1).alias("_side"), F.struct(*points.columns).alias("_row"), F.lit(None).cast(kind).alias("_v"))
    other = known.select(key, F.col(s).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    w = Window.partitionBy(key).orderBy(F.col("_t").asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = asked.unionByName(other).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side <> 0")
    return rows.select("_row.*", F.when(F.col("_t").isNotNull(), F.col("_v")).alias(value))


def with_map(ranges: DataFrame, key: str) -> DataFrame:
    """(key, s, e, out, r): ranges with the output time at which each begins."""
    return output_offsets(ranges.select(key, "s", "e"), key)


def source_to_output(points: DataFrame, ranges: DataFrame, key: str, t: str, name: str) -> DataFrame:
    """``points`` with the output time of source time ``t``: null in removed material. At a seam the earlier range counts.

    The range that begins last at or before the point decides, and the one before it where that point is its very beginning and the two touch.
    """
    known = with_map(ranges, key).withColumn("_early", F.col("s") - EDGE).withColumn("_range", F.struct("s", "e", "out", F.lag("e").over(Window.partitionBy(key).orderBy("s")).alias("before")))
    rows = first_at_or_before(points, known, key, t, "_early", "_range")
    x, r = F.col(t), F.col("_range")
    inside = x <= r["e"] + EDGE
    out = F.when(x <= r["before"] + EDGE, r["out"]).when(inside, r["out"] + F.least(F.greatest(x - r["s"], F.lit(0.0)), r["e"] - r["s"]))
    return rows.withColumn(name, out).drop("_range")


def output_to_source(points: DataFrame, ranges: DataFrame, key: str, t: str, name: str) -> DataFrame:
    """``points`` with the source time of output time ``t``; behind the end: the last range's end. A seam belongs to the earlier range."""
    w = Window.partitionBy(key).orderBy("s")
    ends_before = F.lag(F.col("out") + (F.col("e") - F.col("s"))).over(w)  # the first range whose output end is not before t is the last one behind whose predecessor's end t lies
    known = with_map(ranges, key).withColumn("_begin", F.coalesce(ends_before, F.lit(float("-inf")))).withColumn("_range", F.struct("s", "e", "out"))
    rows = first_at_or_before(points, known, key, t, "_begin", "_range", strict=True)
    r = F.col("_range")
    return rows.withColumn(name, F.least(r["s"] + F.greatest(F.col(t) - r["out"], F.lit(0.0)), r["e"])).drop("_range")


def clean_ranges(ranges: DataFrame, key: str) -> DataFrame:
    """Ranges rounded to milliseconds; those of 0.05 s or less go."""
    rows = ranges.select(key, to_millis(F.col("s")).alias("s"), to_millis(F.col("e")).alias("e"))
    return rows.where(F.col("e") - F.col("s") > 0.05)


def retimed_points(points: DataFrame, old: DataFrame, new: DataFrame, key: str, t: str, name: str) -> DataFrame:
    """Output times of the old cut as output times of the new one; null where the new cut removed them."""
    return source_to_output(output_to_source(points, old, key, t, "_source"), new, key, "_source", name).drop("_source")


def retimed_items(items: DataFrame, new: DataFrame, key: str, shortest: float = 0.05, default: float = 0.2) -> DataFrame:
    """Items with source times (key, src_start, src_end) on the new cut: those whose start was removed go, an end that was removed is 0.2 s behind the start.

    Every item lasts 0.05 s at least and ends at the cut's end at the latest.
    """
    total = with_map(new, key).groupBy(key).agg(F.max(F.col("out") + F.col("e") - F.col("s")).alias("_total"))
    rows = source_to_output(items, new, key, "src_start", "start")
    rows = source_to_output(rows, new, key, "src_end", "end").where("start IS NOT NULL").join(total, key)
    end = F.least(F.col("_total"), F.greatest(F.col("start") + shortest, F.coalesce("end", F.col("start") + default)))
    return rows.withColumn("end", F.round(end, 3)).withColumn("start", F.round("start", 3)).drop("_total")


# ---- edits of the ranges ------------------------------------------------------------------------
def split_ranges(ranges: DataFrame, at: DataFrame, key: str, margin: float = 0.1) -> DataFrame:
    """Ranges with the one under output time ``t`` of ``at`` (key, t; one row a key) cut in two, unless it is within ``margin`` of an end."""
    source = output_to_source(at.select(key, "t"), ranges, key, "t", "_source").select(key, "_source")
    x = F.col("_source")
    parts = F.when((x > F.col("s") + margin) & (x < F.col("e") - margin), F.array(F.struct(F.col("s"), x.alias("e")), F.struct(x.alias("s"), F.col("e")))).otherwise(F.array(F.struct("s", "e")))
    return ranges.select(key, "s", "e").join(source, key, "left").select(key, F.inline(parts))


def delete_ranges(ranges: DataFrame, which: DataFrame, key: str) -> DataFrame:
    """Ranges without the one of number ``place`` (from 0) of ``which`` (key, place); a cut's only range stays."""
    w = Window.partitionBy(key)
    rows = ranges.select(key, "s", "e", (F.row_number().over(w.orderBy("s")) - 1).alias("_place"), F.count("*").over(w).alias("_n")).join(which.select(key, F.col("place").alias("_gone")), key, "left")
    return rows.where(F.col("_gone").isNull() | (F.col("_n") <= 1) | (F.col("_place") != F.col("_gone"))).select(key, "s", "e")


def trim_ranges(ranges: DataFrame, edits: DataFrame, key: str, shortest: float = 0.2) -> DataFrame:
    """Ranges with one edge moved: ``edits`` has (key, place, edge 'start' or 'end', to, duration).

    An edge neither enters a neighbour nor leaves less than ``shortest``; ``duration`` bounds the last end.
    """
    w = Window.partitionBy(key).orderBy("s")
    rows = ranges.select(key, "s", "e", (F.row_number().over(w) - 1).alias("_place"), F.lag("e").over(w).alias("_before"), F.lead("s").over(w).alias("_after"))
    rows = rows.join(edits.select(key, F.col("place").alias("_edit"), "edge", "to", "duration"), key, "left")
    here = F.col("_place") == F.col("_edit")
    s = F.when(here & (F.col("edge") == "start"), F.least(F.greatest("to", F.coalesce("_before", F.lit(0.0))), F.col("e") - shortest)).otherwise(F.col("s"))
    e = F.when(here & (F.col("edge") == "end"), F.greatest(F.least("to", F.coalesce("_after", "duration")), F.col("s") + shortest)).otherwise(F.col("e"))
    return rows.select(key, s.alias("s"), e.alias("e"))


# ---- bounds of clips ------------------------------------------------------------------------------
def cut_in(rows: DataFrame, cuts: DataFrame, key: str, low: Column, high: Column, window: float, name: str, strict: bool = False) -> DataFrame:
    """``rows`` (with ``_id``) and the first cut between ``low`` and ``high``, at most ``window`` apart; null if there is none.

    Buckets of ``window`` make it an equi-join: an interval touches two of them, or three by rounding. ``strict`` leaves both ends out.
    """
    asked = rows.select(key, "_id", low.alias("_low"), high.alias("_high"))
    asked = asked.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_low") / window), F.floor(F.greatest("_low", "_high") / window))))
    there = cuts.select(key, F.col("c").alias("_c"), F.floor(F.col("c") / window).alias("_bucket"))
    inside = (F.col("_c") > F.col("_low")) & (F.col("_c") < F.col("_high")) if strict else (F.col("_c") >= F.col("_low")) & (F.col("_c") <= F.col("_high"))
    found = asked.join(there, [key, "_bucket"]).where(inside).groupBy("_id").agg(F.min("_c").alias(name))
    return rows.join(found, "_id", "left")


def refined_bounds(spans: DataFrame, words: DataFrame, cuts: DataFrame, duration: DataFrame, key: str, lead_in: float = 0.12, tail: float = 0.35, gap: float = 0.03, window: float = 0.45) -> DataFrame:
    """``spans`` (key, first_word, last_word, ...) with start and end: in the gaps between words, on a scene cut where that clips no speech.

    Rules in their order. Start: a lead-in before the first word, ``gap`` behind the word before; the earliest cut of the window before the
    word, not before the last word's end, wins. End: a tail, ``gap`` before the next word, and just behind the word where that leaves nothing; a cut in
    the window behind the word, not beyond the next word, ends the clip 0.04 s before itself; then a cut within the tail does.
    ``words`` has (key, idx, start, end), ``cuts`` (key, c), ``duration`` (key, duration).
    """
    w = Window.partitionBy(key).orderBy("idx")
    known = words.select(key, "idx", "start", "end", F.lag("end").over(w).alias("prev_end"), F.lead("start").over(w).alias("next_start"))
    first = known.select(key, F.col("idx").alias("first_word"), F.col("start").alias("_ws"), F.coalesce("prev_end", F.lit(0.0)).alias("_pe"))
    last = known.select(key, F.col("idx").alias("last_word"), F.col("end").alias("_we"), F.col("next_start").alias("_ns"))
    rows = spans.withColumn("_id", F.xxhash64(key, "first_word", "last_word")).join(first, [key, "first_word"]).join(last, [key, "last_word"]).join(duration, key)
    rows = rows.withColumn("_ns", F.coalesce("_ns", "duration"))
    start = F.greatest(F.col("_pe") + gap, F.col("_ws") - lead_in, F.lit(0.0))
    end = F.least(F.col("_ns") - gap, F.col("_we") + tail, F.col("duration"))
    end = F.when(end <= F.col("_we"), F.least(F.col("duration"), F.col("_we") + 0.02)).otherwise(end)
    rows = checkpointed(rows.withColumn("_start", start).withColumn("_end", end))
    asked = rows.select(key, "_id", "_ws", "_pe", "_we", "_ns", "_end").dropDuplicates(["_id"])
    asked = cut_in(asked, cuts, key, F.greatest(F.col("_ws") - window, F.col("_pe")), F.col("_ws"), window, "_cut_s")
    asked = cut_in(asked, cuts, key, F.col("_we"), F.least(F.col("_we") + window, F.col("_ns")), window, "_cut_e")
    asked = asked.withColumn("_end", F.when(F.col("_cut_e").isNotNull(), F.greatest(F.col("_we") + 0.02, F.col("_cut_e") - 0.04)).otherwise(F.col("_end")))
    asked = cut_in(asked, cuts, key, F.col("_we"), F.col("_end"), max(window, tail, gap), "_cut_t", strict=True)
    asked = asked.withColumn("_end", F.when(F.col("_cut_t").isNotNull(), F.greatest(F.col("_we") + 0.02, F.col("_cut_t") - 0.04)).otherwise(F.col("_end")))
    found = rows.drop("_end").join(asked.select("_id", "_cut_s", "_end"), "_id")
    return found.select(*spans.columns, F.round(F.coalesce("_cut_s", "_start"), 3).alias("start"), F.round("_end", 3).alias("end"))


def snapped_bounds(asked: DataFrame, words: DataFrame, key: str, least: float = 3.0) -> DataFrame:
    """``asked`` (key, id, a, b: what a user wants) with start, end, first_word and last_word, or the reason why not.

    The words that reach 0.05 s into the range decide; a lead-in of 0.12 s and a tail of 0.3 s stay 0.03 s off the neighbours.
    Words rise in both times, so the first one is found as of the range's start, the last one as of its end.
    """
    w = Window.partitionBy(key).orderBy("idx")
    known = words.select(key, "start", "end", F.struct("idx", "start", "end", F.lag("end").over(w).alias("prev_end"), F.lead("start").over(w).alias("next_start")).alias("_word"), F.lead("end").over(w).alias("_next_end"))
    firsts = known.withColumn("_from", F.coalesce(F.lag("end").over(Window.partitionBy(key).orderBy("end")), F.lit(-1e18)))
    rows = asked.withColumn("_a", F.col("a") + 0.05).withColumn("_b", F.col("b") - 0.05)
    rows = first_at_or_before(rows, firsts.withColumn("_f", F.col("_word")), key, "_a", "_from", "_f")
    strictly = known.withColumn("_l", F.col("_word")).withColumn("_begin", F.col("start") + 1e-9)
    rows = first_at_or_before(rows, strictly, key, "_b", "_begin", "_l")
    f, n = F.col("_f"), F.col("_l")
    speech = (f["end"] > F.col("_a")) & n.isNotNull() & (f["idx"] <= n["idx"])
    reason = F.when(F.col("b") - F.col("a") < least, "too short").when(~F.coalesce(speech, F.lit(False)), "no speech")
    fine = reason.isNull()
    start = F.greatest(F.coalesce(f["prev_end"], F.lit(0.0)) + 0.03, f["start"] - 0.12, F.lit(0.0))
    end = F.least(F.coalesce(n["next_start"], n["end"] + 1.0) - 0.03, n["end"] + 0.3)
    return rows.select(*asked.columns, reason.alias("reason"), F.when(fine, F.round(start, 3)).alias("start"), F.when(fine, F.round(end, 3)).alias("end"), F.when(fine, f["idx"]).alias("first_word"), F.when(fine, n["idx"]).alias("last_word"))


# ---- registered queries -----------------------------------------------------------------------------
def old_and_new(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two cuts of each user's events: all intervals, and those of the first cut but every third, each a quarter shorter at its end."""
    rows = mono_intervals_of(events).select("user_id", F.round("a", 3).alias("s"), F.round("b", 3).alias("e"), F.row_number().over(Window.partitionBy("user_id").orderBy("a", "event_id")).alias("n"))
    old = clean_ranges(rows, "user_id")
    new = clean_ranges(rows.where("n % 3 <> 0").withColumn("e", F.col("e") - (F.col("e") - F.col("s")) / 4), "user_id")
    return old, new


_MAP = "SELECT *, coalesce(sum(e - s) OVER (PARTITION BY user_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS out FROM"
CUTS = f"""n AS MATERIALIZED (SELECT user_id, round(a, 3) AS s, round(b, 3) AS e, row_number() OVER (PARTITION BY user_id ORDER BY a, event_id) AS n FROM {MONO}),
  o AS MATERIALIZED ({_MAP} (SELECT user_id, s, e FROM n WHERE e - s > 0.05)),
  c AS MATERIALIZED ({_MAP} (SELECT user_id, s, e FROM (SELECT user_id, s, round(e - (e - s) / 4, 3) AS e FROM n WHERE n % 3 <> 0) WHERE e - s > 0.05))"""


def _to_output(t: str, user: str) -> str:
    return f"(SELECT arg_min(c.out + least(greatest({t} - c.s, 0), c.e - c.s), c.s) FROM c WHERE c.user_id = {user} AND {t} BETWEEN c.s - 1e-6 AND c.e + 1e-6)"


@query(
    "retime",
    f"""WITH {CUTS}, p AS (SELECT user_id, event_id, interest * 600 AS t FROM {MONO}),
    x AS (SELECT p.*, coalesce((SELECT arg_min(o.s + greatest(p.t - o.out, 0), o.s) FROM o WHERE o.user_id = p.user_id AND p.t <= o.out + (o.e - o.s)), (SELECT max(o.e) FROM o WHERE o.user_id = p.user_id)) AS src FROM p)
    SELECT user_id, event_id, round(t, 3) AS t, round(src, 3) AS src, round({_to_output("x.src", "x.user_id")}, 3) AS retimed FROM x""",
)
def retime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points on the output of one cut, on its source, and on the output of another cut; null where that removed them."""
    events = table(spark, sf_dir, "events")
    old, new = old_and_new(events)
    points = mono_intervals_of(events).select("user_id", "event_id", (F.col("interest") * 600).alias("t"))
    rows = source_to_output(output_to_source(points, old, "user_id", "t", "src"), new, "user_id", "src", "retimed")
    return rows.select("user_id", "event_id", F.round("t", 3).alias("t"), F.round("src", 3).alias("src"), F.round("retimed", 3).alias("retimed"))


@query(
    "retimed_items",
    f"""WITH {CUTS}, x AS (SELECT user_id, event_id, {_to_output("i.a", "i.user_id")} AS start, {_to_output("i.a + i.interest", "i.user_id")} AS "end" FROM {MONO} i)
    SELECT user_id, event_id, round(start, 3) AS start, round(least(total, greatest(start + 0.05, coalesce("end", start + 0.2))), 3) AS "end" FROM x JOIN (SELECT user_id, max(out + e - s) AS total FROM c GROUP BY 1) USING (user_id) WHERE start IS NOT NULL""",
)
def retimed_items_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of each user by source times on the new cut."""
    events = table(spark, sf_dir, "events")
    items = mono_intervals_of(events).select("user_id", "event_id", F.col("a").alias("src_start"), (F.col("a") + F.col("interest")).alias("src_end"))
    return retimed_items(items, old_and_new(events)[1], "user_id").select("user_id", "event_id", "start", "end")


@query(
    "range_edits",
    f"""WITH {CUTS}, cuts AS (SELECT user_id, s, e, out, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY user_id) AS size, lag(e) OVER w AS before, lead(s) OVER w AS after FROM o WINDOW w AS (PARTITION BY user_id ORDER BY s)),
    parts AS (SELECT user_id, s, e, coalesce((SELECT arg_min(y.s + greatest(40000 - y.out, 0), y.s) FROM o y WHERE y.user_id = cuts.user_id AND 40000 <= y.out + (y.e - y.s)), (SELECT max(y.e) FROM o y WHERE y.user_id = cuts.user_id)) AS x FROM cuts)
    SELECT 'split' AS edit, user_id, round(s, 3) AS s, round(e, 3) AS e FROM (SELECT user_id, unnest(CASE WHEN x > s + 0.1 AND x < e - 0.1 THEN [{{s: s, e: x}}, {{s: x, e: e}}] ELSE [{{s: s, e: e}}] END, recursive := true) FROM parts)
    UNION ALL SELECT 'delete', user_id, s, e FROM cuts WHERE size <= 1 OR place <> 2
    UNION ALL SELECT 'trim', user_id, round(CASE WHEN place = 1 THEN least(greatest(s - 5000, coalesce(before, 0)), e - 0.2) ELSE s END, 3), e FROM (SELECT *, max(CASE WHEN place = 1 THEN s END) OVER (PARTITION BY user_id) AS target FROM cuts)""",
)
def range_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's cut split at an output time, without its third range, and with its second range's start moved back by 5,000 s."""
    old = checkpointed(old_and_new(table(spark, sf_dir, "events"))[0])
    users = old.select("user_id").distinct()
    second = with_map(old, "user_id").withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("s")) - 1).where("place = 1")
    moved = second.select("user_id", "place", F.lit("start").alias("edge"), (F.col("s") - 5000).alias("to"), F.lit(2.6e6).alias("duration"))
    made = {
        "split": split_ranges(old, users.withColumn("t", F.lit(40000.0)), "user_id"),
        "delete": delete_ranges(old, users.withColumn("place", F.lit(2)), "user_id"),
        "trim": trim_ranges(old, moved, "user_id"),
    }
    rows = [d.select(F.lit(n).alias("edit"), "user_id", F.round("s", 3).alias("s"), F.round("e", 3).alias("e")) for n, d in made.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


#: Scene cuts of a conversation: just before, in and behind words, at three of every seven of them.
def scene_cuts(words: DataFrame) -> DataFrame:
    return words.where("idx % 7 IN (0, 2, 5)").select("conv_id", F.round(F.when(F.col("idx") % 7 == 0, F.col("start") - 0.02).when(F.col("idx") % 7 == 2, F.col("end") + 0.01).otherwise(F.col("start") + 0.1), 3).alias("c"))


SCENES = f"""(SELECT conv_id, round(CASE WHEN idx % 7 = 0 THEN start - 0.02 WHEN idx % 7 = 2 THEN "end" + 0.01 ELSE start + 0.1 END, 3) AS c FROM {WORDS} WHERE idx % 7 IN (0, 2, 5))"""


@query(
    "refined_bounds",
    f"""WITH w AS MATERIALIZED (SELECT *, lag("end") OVER o AS prev_end, lead(start) OVER o AS next_start FROM {WORDS} WINDOW o AS (PARTITION BY conv_id ORDER BY idx)), d AS (SELECT conv_id, max("end") + 5 AS duration FROM w GROUP BY 1), k AS MATERIALIZED (FROM {SCENES}),
    b AS (SELECT s.conv_id, s.sentence, f.start AS ws, coalesce(f.prev_end, 0) AS pe, l."end" AS we, coalesce(l.next_start, duration) AS ns, duration FROM {SENTENCES} s JOIN w f ON f.conv_id = s.conv_id AND f.idx = s.first_word JOIN w l ON l.conv_id = s.conv_id AND l.idx = s.last_word JOIN d ON d.conv_id = s.conv_id),
    e1 AS (SELECT *, least(ns - 0.03, we + 0.35, duration) AS e0, (SELECT min(c) FROM k WHERE k.conv_id = b.conv_id AND c BETWEEN ws - 0.45 AND ws AND c >= pe) AS cs, (SELECT min(c) FROM k WHERE k.conv_id = b.conv_id AND c BETWEEN we AND we + 0.45 AND c <= ns) AS ce FROM b),
    e2 AS (SELECT *, CASE WHEN ce IS NOT NULL THEN greatest(we + 0.02, ce - 0.04) WHEN e0 <= we THEN least(duration, we + 0.02) ELSE e0 END AS e3 FROM e1)
    SELECT conv_id, sentence::BIGINT AS sentence, round(coalesce(cs, greatest(pe + 0.03, ws - 0.12, 0)), 3) AS start, round(coalesce((SELECT greatest(we + 0.02, min(c) - 0.04) FROM k WHERE k.conv_id = e2.conv_id AND c > we AND c < e3 HAVING count(*) > 0), e3), 3) AS "end" FROM e2""",
)
def refined_bounds_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of every sentence between its neighbours' words, on scene cuts where there are any."""
    words = words_of(table(spark, sf_dir, "conversations"))
    spans = sentences_of(words).select("conv_id", "sentence", "first_word", "last_word")
    duration = words.groupBy("conv_id").agg((F.max("end") + 5).alias("duration"))
    return refined_bounds(spans, words, scene_cuts(words), duration, "conv_id").select("conv_id", F.col("sentence").cast("long").alias("sentence"), "start", "end")


@query(
    "snapped_bounds",
    f"""WITH w AS MATERIALIZED (SELECT *, lag("end") OVER o AS prev_end, lead(start) OVER o AS next_start FROM {WORDS} WINDOW o AS (PARTITION BY conv_id ORDER BY idx)),
    q AS (SELECT conv_id, sentence::BIGINT AS sentence, round(start + 0.1, 3) AS a, round("end" + CASE WHEN sentence % 4 = 0 THEN 2.5 ELSE 0.2 END, 3) AS b FROM {SENTENCES}),
    m AS (SELECT q.*, (SELECT min(idx) FROM w WHERE w.conv_id = q.conv_id AND "end" > a + 0.05 AND start < b - 0.05) AS f, (SELECT max(idx) FROM w WHERE w.conv_id = q.conv_id AND "end" > a + 0.05 AND start < b - 0.05) AS l FROM q)
    SELECT m.conv_id, sentence, reason, CASE WHEN reason IS NULL THEN round(greatest(coalesce(x.prev_end, 0) + 0.03, x.start - 0.12, 0), 3) END AS start, CASE WHEN reason IS NULL THEN round(least(coalesce(y.next_start, y."end" + 1) - 0.03, y."end" + 0.3), 3) END AS "end", CASE WHEN reason IS NULL THEN f END AS first_word, CASE WHEN reason IS NULL THEN l END AS last_word
    FROM (SELECT *, CASE WHEN b - a < 3 THEN 'too short' WHEN f IS NULL THEN 'no speech' END AS reason FROM m) m LEFT JOIN w x ON x.conv_id = m.conv_id AND x.idx = f LEFT JOIN w y ON y.conv_id = m.conv_id AND y.idx = l""",
)
def snapped_bounds_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges a user might draw around each sentence, snapped between words."""
    words = words_of(table(spark, sf_dir, "conversations"))
    behind = F.when(F.col("sentence") % 4 == 0, 2.5).otherwise(0.2)
    asked = sentences_of(words).select("conv_id", F.col("sentence").cast("long").alias("sentence"), F.round(F.col("start") + 0.1, 3).alias("a"), F.round(F.col("end") + behind, 3).alias("b"))
    rows = snapped_bounds(asked, words, "conv_id")
    return rows.select("conv_id", "sentence", "reason", "start", "end", F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"))
