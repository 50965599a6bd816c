"""Series with memory: box tracks, beats, products of active factors, contiguous labels, near hashes.

Tracks and beats are ordered folds with small state (live tracks; the scores of two beat periods). What needs no order is left to
Spark: onset strength, autocorrelation and label cursors are windows, factors at rest are a running sum over opening
and closing rows, factors on the move meet times in buckets as long as the longest move, and 64-bit hashes meet by blocks of
which one must nearly agree.

Defined results: null boxes are frames without a box; ties follow the order of boxes and tracks; null values count as 0 in onset strength; empty
tables give no rows.
"""

from __future__ import annotations

import json
import math
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import combinations, groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators.folds import TRACK, checkpointed, ordered_fold, track_of
from spanloom.operators.intervals import INTERVALS, intervals_of
from spanloom.registry import query, table

# ---- tracker --------------------------------------------------------------------------------------
LEAST_IOU, MOST_DISTANCE, MOST_MISSES = 0.25, 0.12, 4


def box_iou(a: tuple, b: tuple) -> float:
    """Intersection over union of boxes (cx, cy, w, h)."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    wide = min(ax + aw / 2, bx + bw / 2) - max(ax - aw / 2, bx - bw / 2)
    high = min(ay + ah / 2, by + bh / 2) - max(ay - ah / 2, by - bh / 2)
    both = max(0.0, wide) * max(0.0, high)
    return both / (aw * ah + bw * bh - both) if both else 0.0


def follow(state: dict, boxes: list[tuple], cut: bool) -> list[int]:
    """Track of each box of one frame. ``state``: next track number, and live tracks as [number, last box, misses].

    Pairs of a live track and a box that overlap enough or are near are taken by overlap less distance, best first, each side once;
    other boxes begin tracks, tracks without a box miss a frame and end after too many. A cut ends all.
    """
    live = [] if cut else state["live"]
    pairs = []
    places = list(enumerate([box[0] for box in boxes]))
    widest = max([box[2] for box in boxes], default=0.0) / 2 + 1e-9
    for t, (_, last, _) in enumerate(live):
        x = last[0]
        reach = max(MOST_DISTANCE, last[2] / 2 + widest)  # what is farther aside neither overlaps nor is near
        for i, at in places:
            if -reach <= at - x <= reach:
                box = boxes[i]
                iou, far = box_iou(last, box), math.hypot(x - at, last[1] - box[1])
                if iou >= LEAST_IOU or far <= MOST_DISTANCE:
                    pairs.append((iou - far, t, i))
    if len(pairs) > 1:
        pairs.sort(reverse=True)
    of_box, of_track = {}, {}
    for _, t, i in pairs:
        if t not in of_track and i not in of_box:
            of_track[t], of_box[i] = i, t
    kept, out = [], [0] * len(boxes)
    for t, (number, last, misses) in enumerate(live):
        if t in of_track:
            out[of_track[t]] = number
            kept.append([number, boxes[of_track[t]], 0])
        elif misses < MOST_MISSES:
            kept.append([number, last, misses + 1])
    for i, box in enumerate(boxes):
        if i not in of_box:
            out[i] = state["next"]
            kept.append([state["next"], box, 0])
            state["next"] += 1
    state["live"] = kept
    return out


def tracks(boxes: DataFrame, key: str, key_type: str, height: bool = False) -> DataFrame:
    """(key, frame, box, track) of ``boxes`` (key, frame, box, cx, cy, w, h, cut), with h behind if ``height``; a frame without boxes is a row with a null box."""

    def fold(found: Iterator[tuple]) -> Iterator[tuple]:
        state = {"next": 0, "live": []}
        for frame, own in groupby(found, key=itemgetter(1)):
            rows = list(own)
            there = [r for r in rows if r[2] is not None]
            for r, track in zip(there, follow(state, [r[3:7] for r in there], rows[0][7] or any([r[7] for r in rows]))):
                yield (r[0], frame, r[2], track, r[6]) if height else (r[0], frame, r[2], track)

    rows = boxes.select(key, "frame", "box", "cx", "cy", "w", "h", F.coalesce("cut", F.lit(False)).alias("cut"))
    return ordered_fold(rows, [key], ["frame", "box"], f"{key} {key_type}, frame bigint, box bigint, track bigint{', h double' if height else ''}", fold)


def tracks_of_stream(boxes: DataFrame, key: str, key_type: str) -> DataFrame:
    """The same for a stream whose batches hold whole frames in order: live tracks are each key's state between batches."""

    def step(key_values: tuple, frames: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = json.loads(state.get[0]) if state.exists else {"next": 0, "live": []}
        rows = pd.concat(list(frames)).sort_values(["frame", "box"])
        out = []
        for frame, own in rows.groupby("frame", sort=True):
            there = own[own["box"].notna()]
            got = follow(known, list(there[["cx", "cy", "w", "h"]].itertuples(index=False, name=None)), bool(own["cut"].fillna(False).any()))
            out.append(pd.DataFrame({key: key_values[0], "frame": frame, "box": there["box"].astype("int64"), "track": got}))
        state.update((json.dumps(known),))
        yield pd.concat(out)

    return boxes.groupBy(key).applyInPandasWithState(step, f"{key} {key_type}, frame bigint, box bigint, track bigint", "known string", "append", "NoTimeout")


def line_boxes(lineitem: DataFrame) -> DataFrame:
    """Order lines as boxes: a supplier is a series, a week a frame, a line number a lane; every 53rd week is a cut."""
    week = F.floor(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")) / 7).cast("long")
    rows = lineitem.select(F.col("l_suppkey").alias("series"), week.alias("frame"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("box"), (F.col("l_linenumber") * 0.12 + F.col("l_quantity") % 10 / 100).alias("cx"), (0.3 + F.col("l_discount")).alias("cy"))
    return rows.withColumns({"w": F.lit(0.1), "h": 0.08 + F.col("cx") / 20, "cut": F.col("frame") % 53 == 0})


@query("tracker")
def tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(line_boxes(table(spark, sf_dir, "lineitem")), "series", "bigint")


def speakers(faces: DataFrame, shot: list[str], types: str, hold: float, window: int) -> DataFrame:
    """(shot..., i, track): whom a camera follows at each sample of a shot; null where nobody is seen.

    ``faces`` has (shot..., i from 0, t, place, track, width, activity, speaking), one row a visible track and sample, one with a null track for a sample
    without. The widest, most persistent track begins. Activity while somebody speaks, averaged over the last ``window`` samples, is a range frame; another
    track takes over once it was clearly more active for 0.6 of ``hold`` seconds, or at once when the followed one is gone.
    """
    seen = faces.where("track IS NOT NULL")
    persistent = seen.groupBy(*shot, "track").agg(F.sum("width").alias("_size"), F.min(F.struct("i", "place")).alias("_first"))
    widest = persistent.groupBy(*shot).agg(F.max_by("track", F.struct("_size", -F.col("_first.i"), -F.col("_first.place"))).alias("_widest"))
    last = Window.partitionBy(*shot, "track").orderBy("i").rangeBetween(-(window - 1), 0)
    said = F.sum(F.when(F.col("speaking"), F.coalesce("activity", F.lit(0.0))).otherwise(0.0)).over(last) / F.least(F.lit(window), F.col("i") + 1)
    rows = faces.withColumn("_score", said).join(widest, shot, "left").select(*shot, "i", "t", "place", "track", "width", "_score", F.coalesce("speaking", F.lit(False)).alias("speaking"), "_widest")
    n = len(shot)

    def fold(found: Iterator[tuple]) -> Iterator[tuple]:
        current = rival = None
        begun, since = False, 0.0
        for i, own in groupby(found, key=itemgetter(n)):
            own = list(own)
            t, speaking = own[0][n + 1], own[0][n + 6]
            there = {r[n + 3]: (r[n + 5], r[n + 4]) for r in own if r[n + 3] is not None}
            if not begun:
                current, begun = own[0][n + 7], True
            if there and current not in there:
                current, rival = max(there, key=there.get), None
            elif there and speaking:
                best = max(there, key=lambda k: there[k][0])
                if best != current and there[best][0] > 1.5 * there[current][0] + 0.004:
                    if rival != best:
                        rival, since = best, t
                    elif t - since >= hold * 0.6:
                        current, rival = best, None
                else:
                    rival = None
            yield *own[0][:n], i, current if there else None

    return ordered_fold(rows, shot, ["i", "place"], f"{types}, i bigint, track bigint", fold)


@query("speaker_series")
def speaker_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whom a camera follows among the tracks of each supplier, in shots of 53 weeks."""
    boxes = line_boxes(table(spark, sf_dir, "lineitem"))
    found = tracks(boxes, "series", "bigint", height=True).withColumn("shot", F.floor(F.col("frame") / 53)).withColumn("i", (F.dense_rank().over(Window.partitionBy("series", "shot").orderBy("frame")) - 1).cast("long"))
    once = found.groupBy("series", "shot", "i", "frame", "track").agg(F.min("box").alias("place"), F.max("h").alias("width"), F.max((F.col("box") % 7) / 20).alias("activity"))
    faces = once.select("series", "shot", "i", (F.col("frame") * 0.5).alias("t"), "place", "track", "width", "activity", (F.col("frame") % 5 != 0).alias("speaking"))
    faces = checkpointed(faces)  # speakers reads them twice, and tracks are not to be followed twice
    return speakers(faces, ["series", "shot"], "series bigint, shot bigint", 2.0, 4)


# ---- beats ----------------------------------------------------------------------------------------
def onset_strength(series: DataFrame, key: str) -> DataFrame:
    """(key, i, e): rises of x less their mean over sixteen samples around, nothing below 0, scaled to 1 at most. ``series`` has (key, i, x)."""
    w = Window.partitionBy(key).orderBy("i")
    rise = F.greatest(F.coalesce(F.col("x"), F.lit(0.0)) - F.lag(F.coalesce("x", F.lit(0.0))).over(w), F.lit(0.0))
    rows = series.select(key, "i", F.coalesce(rise, F.lit(0.0)).alias("_rise"))
    rows = rows.withColumn("_e", F.greatest(F.col("_rise") - F.sum("_rise").over(w.rowsBetween(-8, 7)) / 16, F.lit(0.0)))
    top = rows.groupBy(key).agg(F.max("_e").alias("_top"))
    return rows.join(top, key).select(key, "i", (F.col("_e") / (F.col("_top") + 1e-9)).alias("e"))


def tempo(strength: DataFrame, key: str, rate: float, low: float = 70.0, high: float = 180.0) -> DataFrame:
    """(key, n, bpm): the tempo whose lag has the largest autocorrelation, with a mild preference for 120; 120 for less than four seconds."""
    first, last = int(rate * 60 / high), int(rate * 60 / low)
    stats = strength.groupBy(key).agg(F.avg("e").alias("_mean"), F.count("*").alias("n"))
    rows = strength.join(stats, key).withColumn("_c", F.col("e") - F.col("_mean"))
    w = Window.partitionBy(key).orderBy("i")
    lagged = rows.select(key, "n", "_c", *[F.lag("_c", k).over(w).alias(f"_c{k}") for k in range(first, last + 1)])
    sums = lagged.groupBy(key, "n").agg(*[F.coalesce(F.sum(F.col("_c") * F.col(f"_c{k}")), F.lit(0.0)).alias(f"_s{k}") for k in range(first, last + 1)])
    weighed = [F.struct((F.col(f"_s{k}") * math.exp(-0.5 * (math.log2(60 * rate / k / 120) / 0.9) ** 2)).alias("s"), F.lit(-k).alias("k")) for k in range(first, last + 1)]
    best = -F.array_max(F.array(*weighed))["k"]
    return sums.select(key, "n", F.when(F.col("n") < rate * 4, F.lit(120.0)).otherwise(F.round(60.0 * rate / best, 2)).alias("bpm"))


def beats(strength: DataFrame, tempos: DataFrame, key: str, key_type: str, rate: float, tightness: float = 100.0) -> DataFrame:
    """(key, i): beats by dynamic programming. A frame's score is its strength plus the best score of half to two periods before, less a
    penalty for leaving the period; the path goes back from the best frame of the last period.

    The forward pass keeps the scores of two periods and writes each frame's predecessor; the backward pass reads frames from
    the last one and keeps the frame it waits for.
    """
    rows = strength.join(tempos, key).where("n >= 2").select(key, "i", "e", (60.0 * rate / F.col("bpm")).alias("period"), "n")

    def forward(found: Iterator[tuple]) -> Iterator[tuple]:
        scores: deque[float] = deque()
        for k, i, e, period, n in found:
            near, far = round(period / 2), round(period * 2)
            score, before = e, -1
            if i >= far:
                best = -math.inf
                for at, s in enumerate(scores):
                    p = i - far + at
                    if p > i - near:
                        break
                    value = s - tightness * math.log((i - p) / period) ** 2
                    if value > best:
                        best, before = value, p
                score = e + best if before >= 0 else e
            scores.append(score)
            if len(scores) > far:
                scores.popleft()
            yield k, i, score, before, n - int(period)

    linked = checkpointed(ordered_fold(rows, [key], ["i"], f"{key} {key_type}, i bigint, score double, before bigint, tail bigint", forward))
    start = linked.where("i >= tail").groupBy(key).agg((-F.max(F.struct("score", (-F.col("i")).alias("i")))["i"]).alias("start"))

    def backward(found: Iterator[tuple]) -> Iterator[tuple]:
        wanted = None
        for k, i, before, first in found:
            wanted = first if wanted is None else wanted
            if i == wanted:
                yield k, i
                wanted = before

    back = linked.join(start, key).select(key, "i", "before", "start")
    return ordered_fold(back, [key], [F.desc("i")], f"{key} {key_type}, i bigint", backward)


RATE = 8.0
_LAGS = range(int(RATE * 60 / 180), int(RATE * 60 / 70) + 1)
_BEATS = f"""rises AS (SELECT user_id, i, greatest(coalesce(x - lag(x) OVER (PARTITION BY user_id ORDER BY i), 0), 0) AS r FROM {TRACK}),
  raised AS (SELECT user_id, i, greatest(r - sum(r) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 8 PRECEDING AND 7 FOLLOWING) / 16, 0) AS e FROM rises),
  strength AS MATERIALIZED (SELECT user_id, i, e / (max(e) OVER (PARTITION BY user_id) + 1e-9) AS e FROM raised),
  centred AS MATERIALIZED (SELECT *, e - avg(e) OVER (PARTITION BY user_id) AS c, count(*) OVER (PARTITION BY user_id) AS n FROM strength),
  lags AS (SELECT user_id, k, sum(coalesce(c * d, 0)) * exp(-0.5::DOUBLE * pow(log2(60 * {RATE}::DOUBLE / k / 120) / 0.9::DOUBLE, 2)) AS s FROM (
    {" UNION ALL ".join(f"SELECT user_id, {k} AS k, c, lag(c, {k}) OVER (PARTITION BY user_id ORDER BY i) AS d FROM centred" for k in _LAGS)}) GROUP BY 1, 2),
  tempos AS MATERIALIZED (SELECT user_id, n, CASE WHEN n < {RATE} * 4 THEN 120.0::DOUBLE ELSE round(60 * {RATE}::DOUBLE / k, 2) END AS bpm FROM (SELECT user_id, arg_max(k, (s, -k)) AS k FROM lags GROUP BY 1) JOIN (SELECT user_id, any_value(n) AS n FROM centred GROUP BY 1) USING (user_id))"""


def track_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onset_strength(track_of(table(spark, sf_dir, "events")).select("user_id", "i", "x"), "user_id")


@query("tempo", f"WITH {_BEATS} SELECT user_id, n, bpm FROM tempos")
def tempo_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tempo(track_strength(spark, sf_dir), "user_id", RATE)


@query(
    "beats",
    f"""WITH RECURSIVE {_BEATS}, frames AS MATERIALIZED (SELECT user_id, i, e, n, 60 * {RATE}::DOUBLE / bpm AS period, round_even(60 * {RATE}::DOUBLE / bpm / 2, 0)::BIGINT AS near, round_even(60 * {RATE}::DOUBLE / bpm * 2, 0)::BIGINT AS far FROM strength JOIN tempos USING (user_id) WHERE n >= 2),
  dp(user_id, i, scores, links) AS (SELECT DISTINCT user_id, -1::BIGINT, []::DOUBLE[], []::BIGINT[] FROM frames
    UNION ALL SELECT user_id, i, list_append(scores, e + CASE WHEN i >= far THEN list_max(c) ELSE 0 END), list_append(links, CASE WHEN i >= far THEN i - far + list_position(c, list_max(c)) - 1 ELSE -1 END) FROM (
      SELECT f.user_id, f.i, f.e, f.far, scores, links, list_transform(range(f.i - f.far, f.i - f.near + 1), lambda p: scores[p + 1] - 100 * pow(ln((f.i - p) / f.period), 2)) AS c FROM dp JOIN frames f ON f.user_id = dp.user_id AND f.i = dp.i + 1)),
  last AS (SELECT user_id, links, n - floor(period)::BIGINT AS tail, scores FROM dp JOIN frames USING (user_id, i) WHERE i = n - 1),
  path(user_id, i, links) AS (SELECT user_id, greatest(tail, 0) + list_position(scores[greatest(tail, 0) + 1:], list_max(scores[greatest(tail, 0) + 1:])) - 1, links FROM last
    UNION ALL SELECT user_id, links[i + 1], links FROM path WHERE links[i + 1] >= 0)
  SELECT user_id, i FROM path""",
)
def beats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    strength = checkpointed(track_strength(spark, sf_dir))
    return beats(strength, tempo(strength, "user_id", RATE), "user_id", "bigint", RATE)


# ---- sweeps ---------------------------------------------------------------------------------------
def ease(u: Column) -> Column:
    return F.when(u < 0.5, 4 * u * u * u).otherwise(1 - F.pow(-2 * u + 2, 3) / 2)


def zoom_product(times: DataFrame, zooms: DataFrame, key: str, longest: float) -> DataFrame:
    """``times`` (key, id, t) with the product of the factors of ``zooms`` (key, s, e, scale, ease_in, ease_out) that are active at t.

    A factor at rest opens and closes once: a running sum of logarithms over times, openings and closings. Only factors on the move,
    at most ``longest`` seconds at either end, meet their times, in buckets of that length. Scales are above 0.
    """
    rest_from, rest_to = F.col("s") + F.greatest("ease_in", F.lit(0.0)), F.col("e") - F.greatest("ease_out", F.lit(0.0))
    resting = zooms.select(key, rest_from.alias("_from"), rest_to.alias("_to"), F.ln("scale").alias("_ln")).where("_from <= _to")
    none = [F.lit(None).cast(times.schema["id"].dataType).alias("id")]
    opens = resting.select(key, F.col("_from").alias("t"), F.lit(0).alias("_side"), *none, F.col("_ln"))
    closes = resting.select(key, F.col("_to").alias("t"), F.lit(2).alias("_side"), *none, (-F.col("_ln")).alias("_ln"))
    asked = times.select(key, "t", F.lit(1).alias("_side"), "id", F.lit(0.0).alias("_ln"))
    w = Window.partitionBy(key).orderBy("t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = opens.unionByName(asked).unionByName(closes).withColumn("_sum", F.sum("_ln").over(w)).where("_side = 1")
    grows = zooms.where("ease_in > 0").select(key, F.col("s").alias("_a"), F.least(F.col("s") + F.col("ease_in"), "e").alias("_b"), F.lit(True).alias("_in"), "s", "e", "scale", "ease_in", "ease_out")
    shrinks = zooms.where("ease_out > 0").select(key, F.greatest(rest_from, rest_to, "s").alias("_a"), F.col("e").alias("_b"), F.lit(False).alias("_in"), "s", "e", "scale", "ease_in", "ease_out")
    moving = grows.unionByName(shrinks).where("_a <= _b").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_a") / longest), F.floor(F.col("_b") / longest))))
    met = times.select(key, "id", "t", F.floor(F.col("t") / longest).alias("_bucket")).join(moving, [key, "_bucket"])
    t = F.col("t")
    inside = F.when(F.col("_in"), (t >= F.col("s")) & (t <= F.col("e")) & (t < F.col("s") + F.col("ease_in"))).otherwise(
        (t <= F.col("e")) & (t >= F.col("s")) & (t > F.col("e") - F.col("ease_out")) & ((F.col("ease_in") <= 0) | (t >= F.col("s") + F.col("ease_in")))
    )
    part = ease(F.when(F.col("_in"), (t - F.col("s")) / F.col("ease_in")).otherwise((F.col("e") - t) / F.col("ease_out")))
    moved = met.where(inside).groupBy(key, "id").agg(F.product(1 + (F.col("scale") - 1) * part).alias("_moved"))
    return level.join(moved, [key, "id"], "left").select(key, "id", "t", (F.exp("_sum") * F.coalesce("_moved", F.lit(1.0))).alias("zoom"))


_ZOOMS = f"(SELECT user_id, event_id, a AS s, b AS e, 1 + (event_id % 5) * 0.1::DOUBLE AS scale, (event_id % 3) * 70::DOUBLE AS ease_in, (event_id % 4) * 45::DOUBLE AS ease_out FROM {INTERVALS})"
_EASED = "CASE WHEN u < 0.5 THEN 4 * u * u * u ELSE 1 - pow(-2 * u + 2, 3) / 2 END"


@query(
    "zoom_product",
    f"""SELECT user_id, id, round(zoom, 6) AS zoom FROM (SELECT x.user_id, x.event_id * 2 + x.side AS id, product(coalesce(1 + (scale - 1) * CASE WHEN u IS NULL THEN 1 ELSE {_EASED} END, 1)) AS zoom FROM (
      SELECT p.*, z.scale, CASE WHEN z.ease_in > 0 AND p.t < z.s + z.ease_in THEN (p.t - z.s) / z.ease_in WHEN z.ease_out > 0 AND p.t > z.e - z.ease_out THEN (z.e - p.t) / z.ease_out END AS u
      FROM (SELECT user_id, event_id, side, CASE WHEN side = 0 THEN a + 20 ELSE b - 15 END AS t FROM {INTERVALS}, (SELECT unnest([0, 1]) AS side)) p LEFT JOIN {_ZOOMS} z ON z.user_id = p.user_id AND p.t BETWEEN z.s AND z.e) x GROUP BY 1, 2)""",
)
def zoom_product_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product of each user's active zooms shortly after each begins and before it ends."""
    spans = intervals_of(table(spark, sf_dir, "events"))
    zooms = spans.select("user_id", F.col("a").alias("s"), F.col("b").alias("e"), (1 + (F.col("event_id") % 5) * F.lit(0.1)).alias("scale"), ((F.col("event_id") % 3) * 70).cast("double").alias("ease_in"), ((F.col("event_id") % 4) * 45).cast("double").alias("ease_out"))
    times = spans.select("user_id", F.inline(F.array(F.struct((F.col("event_id") * 2).alias("id"), (F.col("a") + 20).alias("t")), F.struct((F.col("event_id") * 2 + 1).alias("id"), (F.col("b") - 15).alias("t")))))
    return zoom_product(times, zooms, "user_id", 140.0).select("user_id", "id", F.round("zoom", 6).alias("zoom"))


#: Labels of sections, and what stands for others.
SECTIONS, OTHER, PLAIN_INTEREST = ("INTRO", "MAIN", "SPONSOR", "OUTRO", "DISCUSSION"), "DISCUSSION", 45.0


def contiguous_labels(sections: DataFrame, bounds: DataFrame, key: str) -> DataFrame:
    """(key, first, last, label, interest): labelled ranges made to cover [low, high] of ``bounds`` once, in their order.

    ``sections`` has (key, first, last, label, interest). Ends are clamped and put in order, unknown labels are ``DISCUSSION``, interest is
    0 to 100. A range begins where the furthest one before it ended, which is a running maximum; one that ends before that goes;
    the last one reaches ``high``; a key without any is one range.
    """
    rows = sections.join(bounds, key)
    clipped = lambda c: F.greatest(F.col("low"), F.least(F.col("high"), F.col(c)))
    rows = rows.where("first IS NOT NULL AND last IS NOT NULL").withColumn("_f", F.least(clipped("first"), clipped("last"))).withColumn("_t", F.greatest(clipped("first"), clipped("last")))
    rows = rows.withColumn("label", F.when(F.col("label").isin(*SECTIONS), F.col("label")).otherwise(OTHER)).withColumn("interest", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(F.col("interest").cast("double"), F.lit(PLAIN_INTEREST)))))
    order = Window.partitionBy(key).orderBy("_f", "_t", "label", "interest")
    rows = rows.withColumn("_cursor", F.coalesce(F.max("_t").over(order.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.col("low"))).where("_t >= _cursor")
    last = F.when(F.lead("_t").over(Window.partitionBy(key).orderBy("_cursor")).isNull(), F.col("high")).otherwise(F.col("_t"))
    made = rows.select(key, F.col("_cursor").alias("first"), last.alias("last"), "label", "interest")
    bare = bounds.join(made.select(key).distinct(), key, "left_anti").select(key, F.col("low").alias("first"), F.col("high").alias("last"), F.lit(OTHER).alias("label"), F.lit(PLAIN_INTEREST).alias("interest"))
    return made.unionByName(bare)


_SECTIONS = "(SELECT conv_id, ((turn * 13 + conv_id * 7) % 60 - 3)::BIGINT AS f, ((turn * 13 + conv_id * 7) % 60 - 3 + (turn * 5) % 17 - 2)::BIGINT AS t, ['INTRO', 'MAIN', 'SPONSOR', 'no label'][1 + turn % 4] AS label, CASE WHEN turn % 5 <> 3 THEN ((turn * 29) % 130 - 10)::DOUBLE END AS interest FROM conversations WHERE conv_id % 10 <> 9)"


@query(
    "contiguous_labels",
    f"""WITH s AS (SELECT conv_id, least(f2, t2) AS f, greatest(f2, t2) AS t, CASE WHEN label IN ('INTRO', 'MAIN', 'SPONSOR', 'OUTRO', 'DISCUSSION') THEN label ELSE 'DISCUSSION' END AS label, greatest(0, least(100, coalesce(interest, 45)))::DOUBLE AS interest
      FROM (SELECT *, greatest(0, least(49, f)) AS f2, greatest(0, least(49, t)) AS t2 FROM {_SECTIONS})),
    g AS (SELECT conv_id, list_reduce(list({{f: f, t: t, label: label, interest: interest}} ORDER BY f, t, label, interest), lambda acc, x: CASE WHEN x.t < coalesce(acc[-1].t + 1, 0) THEN acc ELSE list_append(acc, {{f: coalesce(acc[-1].t + 1, 0), t: x.t, label: x.label, interest: x.interest}}) END,
      []::STRUCT(f BIGINT, t BIGINT, label VARCHAR, interest DOUBLE)[]) AS kept FROM s GROUP BY 1)
    SELECT conv_id, kept[k].f AS first, CASE WHEN k = len(kept) THEN 49 ELSE kept[k].t END AS last, kept[k].label AS label, kept[k].interest AS interest FROM (SELECT conv_id, kept, unnest(range(1, len(kept) + 1)) AS k FROM g)
    UNION ALL SELECT DISTINCT conv_id, 0, 49, 'DISCUSSION', 45 FROM conversations WHERE conv_id % 10 = 9""",
)
def contiguous_labels_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping, reversed and missing sections of each conversation as a partition of its fifty places; every tenth has none."""
    turns = table(spark, sf_dir, "conversations")
    first = (F.col("turn") * 13 + F.col("conv_id") * 7) % 60 - 3
    sections = turns.where("conv_id % 10 <> 9").select(
        "conv_id", first.cast("long").alias("first"), (first + (F.col("turn") * 5) % 17 - 2).cast("long").alias("last"),
        F.element_at(F.array(*map(F.lit, ("INTRO", "MAIN", "SPONSOR", "no label"))), (F.col("turn") % 4 + 1).cast("int")).alias("label"), F.when(F.col("turn") % 5 != 3, (F.col("turn") * 29) % 130 - 10).cast("double").alias("interest"),
    )
    bounds = turns.select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("low"), F.lit(49).cast("long").alias("high"))
    return contiguous_labels(sections, bounds, "conv_id")


# ---- near hashes ----------------------------------------------------------------------------------
def near_hashes(left: DataFrame, right: DataFrame, most: int = 10, blocks: int = 4, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of ``left`` (..., f) and ``right`` (..., g) whose 64-bit hashes differ in ``most`` bits at most, and agree in the columns ``on``.

    Of ``blocks`` blocks one differs in at most ``most // blocks`` bits: the left side probes each block's value with up to so many
    bits flipped, and meets the right side by (block, value). A pair is kept at its first such block, so none comes twice.
    """
    edge, radius = [64 * k // blocks for k in range(blocks + 1)], most // blocks
    part = lambda c, k: F.shiftrightunsigned(c, edge[k]).bitwiseAND((1 << (edge[k + 1] - edge[k])) - 1)
    near = []
    for k in range(blocks):
        flips = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(edge[k + 1] - edge[k]), r)]
        block, value = F.lit(k).alias("_block"), part(F.col("f"), k)
        near.append(F.transform(F.array(*[F.lit(x).cast("long") for x in flips]), lambda x: F.struct(block, x.bitwiseXOR(value).alias("_value"))))  # noqa: B023
    probes = left.select(*left.columns, F.inline(F.flatten(F.array(*near))))
    stored = right.select(*right.columns, F.inline(F.array(*[F.struct(F.lit(k).alias("_block"), part(F.col("g"), k).alias("_value")) for k in range(blocks)])))
    apart = F.col("f").bitwiseXOR(F.col("g"))
    earlier = [(F.bit_count(part(apart, k)) <= radius) & (F.col("_block") > k) for k in range(blocks - 1)]
    first = F.lit(True)
    for e in earlier:
        first = first & ~e
    met = probes.join(stored.hint("merge"), [*on, "_block", "_value"])  # both sides are larger than their plans tell
    return met.where((F.bit_count(apart) <= most) & first).drop("_block", "_value")


def fingerprint_cross(prints: DataFrame, others: DataFrame) -> DataFrame:
    """(id, other, similarity): the best share over shifts of -3 to 3 of places whose hashes differ in ten bits at most; pairs with a match.

    ``prints`` and ``others`` have (id, i, f) with i from 0; the others, which are fewer, are repeated for each shift. Votes are counted by pair and shift; places that a shift compares follow from the lengths.
    """
    n = prints.groupBy("id").agg(F.count("*").alias("n_a"))
    m = others.groupBy(F.col("id").alias("other")).agg(F.count("*").alias("n_b"))
    shifted = others.select(F.col("id").alias("other"), F.col("i").alias("j"), F.col("f").alias("g"), F.explode(F.sequence(F.lit(-3), F.lit(3))).alias("shift"))
    met = near_hashes(prints.select("id", "i", "f"), shifted.withColumn("i", F.col("j") - F.col("shift")).drop("j"), blocks=11, on=("i",)).where("id <> other")
    votes = met.join(n, "id").join(m, "other").where(F.col("i") < F.least("n_a", "n_b")).groupBy("id", "other", "shift", "n_a", "n_b").agg(F.count("*").alias("votes"))
    least = F.least("n_a", "n_b")
    places = F.least(least, F.col("n_b") - F.col("shift")) - F.greatest(F.lit(0), -F.col("shift"))
    return votes.groupBy("id", "other").agg(F.max(F.col("votes") / places).alias("similarity"))


_PRINTS = "(SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, xor((k * 2654435761) % 4294967296 * 2147483648 + (k * 48271) % 2147483647, (event_id * 7) % 64) AS f FROM (SELECT user_id, event_id, floor(value)::BIGINT + 1 AS k FROM events))"


@query(
    "fingerprint_cross",
    f"""WITH p AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM {_PRINTS}), latest AS (SELECT DISTINCT id FROM p ORDER BY id DESC LIMIT 300)
    SELECT id, other, round(max(votes / (least(least(n, m), m - shift) - greatest(0, -shift))::DOUBLE), 6) AS similarity FROM (
      SELECT a.id, b.id AS other, b.i - a.i AS shift, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS votes FROM p a JOIN p b ON b.id IN (FROM latest) AND b.id <> a.id AND b.i BETWEEN a.i - 3 AND a.i + 3 AND bit_count(xor(a.f, b.f)) <= 10 WHERE a.i < least(a.n, b.n) GROUP BY 1, 2, 3)
    GROUP BY 1, 2""",
)
def fingerprint_cross_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's sequence of hashes against those of the latest 300 users."""
    k = F.floor("value").cast("long") + 1
    f = ((k * 2654435761) % 4294967296 * 2147483648 + (k * 48271) % 2147483647).bitwiseXOR((F.col("event_id") * 7) % 64)
    place = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("int")
    prints = checkpointed(table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), place.alias("i"), f.alias("f")))
    latest = prints.select("id").distinct().orderBy(F.desc("id")).limit(300)
    return fingerprint_cross(prints, prints.join(F.broadcast(latest), "id")).select("id", "other", F.round("similarity", 6).alias("similarity"))
