"""The whole clip funnel: score all spans, keep the best that overlap little, start them where they open strongly, put their bounds between words,
refuse repetitions, rank what is left.

Each pass is an operator of its own; a pass sees a bounded shortlist a video, and its result is written once before the next one uses it twice. A
repetition is a clip whose range or words an accepted better one of its video already covers; it loses 25 points and comes last.

Defined results: videos without a span in the limits have no clips; equal scores go to the earlier place of the shortlist; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators.edits import refined_bounds
from spanloom.operators.folds import checkpointed, greedy_accept
from spanloom.operators.intervals import rounded
from spanloom.operators.ranking import clamp, overlap_share, suppress, suppress_sql
from spanloom.operators.text import TOKEN, set_similarity, shingles, tokens
from spanloom.plans.edit_plan import _HOOKS, hooks, shifted_openings
from spanloom.plans.scoring import _COMBINED, _FEATURES, _SCORES_OR_FIRST, CUES, PENALTIES, WEIGHTS, candidates, combined, conversation_features, scores, signals_of, span_rows, with_fallback, with_signals, with_word_weights
from spanloom.registry import query

SHORTEST, LONGEST, SHORTLIST, FINAL, ALIKE, LOST = 15.0, 60.0, 16, 12, 0.8, 25.0


def funnel(words: DataFrame, features: DataFrame, signals: tuple[DataFrame, DataFrame, DataFrame, DataFrame], key: str) -> DataFrame:
    """(key, place, i, j, start, end, score, duplicate) of the best clips of each video from sanitised ``words`` and features of its sentences."""
    features = checkpointed(features)
    known = checkpointed(with_signals(with_word_weights(features, key).drop("text", "content"), key, *signals))
    scored = checkpointed(scores(span_rows(known, key, LONGEST, 3.0)).select(key, "i", "j", "a", "b", "score"))  # of all spans only what the choice needs
    chosen = checkpointed(suppress(with_fallback(scored, key, SHORTEST), key, SHORTLIST, 0.45).select(key, F.col("place").alias("seed"), "a", "b"))
    short = checkpointed(chosen.join(scored.select(key, "a", "b", "i", "j"), [key, "a", "b"]).select(key, "seed", "i", "j"))
    opening = checkpointed(hooks(features, words, key, CUES))
    shift = shifted_openings(short.select(key, "i", "j"), features, opening, key, SHORTEST).select(key, "i", "j", "shift")
    moved = checkpointed(short.join(shift, [key, "i", "j"]).withColumn("i", F.col("i") + F.col("shift")).drop("shift"))
    again = scores(span_rows(known, key, LONGEST, 3.0, moved.select(key, "i", "j"))).select(key, "i", "j", *WEIGHTS, *[f"p_{p}" for p in PENALTIES])  # metrics of the shortlist's own spans
    heard = opening.select(key, F.col("sentence").alias("i"), *[rounded(F.col(w), 1).alias(w) for w in ("w1", "w3", "w5")])
    rescored = moved.join(again, [key, "i", "j"]).join(heard, [key, "i"])
    rescored = rescored.withColumn("hook", rounded(clamp(0.6 * F.col("hook") + 0.4 * (0.3 * F.col("w1") + 0.4 * F.col("w3") + 0.3 * F.col("w5"))), 2)).withColumn("score", combined())
    ends = features.select(key, F.col("sentence").alias("i"), "first_word").join(rescored.select(key, "seed", "i", "j", "score"), [key, "i"])
    ends = ends.join(features.select(key, F.col("sentence").alias("j"), "last_word"), [key, "j"])
    duration = words.groupBy(key).agg(F.max("end").alias("duration"))
    clips = refined_bounds(ends.select(key, "seed", "i", "j", "score", "first_word", "last_word"), words, signals[2], duration, key)
    said = clips.select(key, "seed", "i", "j").withColumn("sentence", F.explode(F.sequence("i", "j"))).join(features.select(key, "sentence", "text"), [key, "sentence"])
    said = said.groupBy(key, "seed").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sentence", "text"))), lambda x: x["text"]), " ").alias("text"))
    clips = checkpointed(clips.join(said, [key, "seed"]).withColumn("grams", shingles(tokens(F.col("text")))).withColumn("id", F.struct(key, "seed")))
    other = clips.select(key, F.col("id").alias("earlier"), F.col("seed").alias("seed_"), F.col("start").alias("c"), F.col("end").alias("d"), F.col("score").alias("score_"), F.col("grams").alias("grams_"))
    better = (F.col("score_") > F.col("score")) | ((F.col("score_") == F.col("score")) & (F.col("seed_") < F.col("seed")))
    alike = F.greatest(overlap_share(F.col("start"), F.col("end"), F.col("c"), F.col("d")), set_similarity(F.size(F.array_intersect("grams", "grams_")).cast("double"), F.size("grams").cast("double"), F.size("grams_").cast("double")))
    conflicts = clips.join(other, key).where(better & (alike >= ALIKE)).select("id", "earlier")  # a shortlist a side
    kept = greedy_accept(clips, conflicts, "id")
    final = clips.join(kept, "id").withColumn("duplicate", ~F.col("accepted")).withColumn("score", F.when(F.col("duplicate"), F.greatest(F.lit(0.0), F.round(F.col("score") - LOST, 2))).otherwise(F.col("score")))
    place = F.row_number().over(Window.partitionBy(key).orderBy("duplicate", F.desc("score"), "seed"))
    return final.withColumn("place", place).where(F.col("place") <= FINAL).select(key, "place", "i", "j", "start", "end", "score", "duplicate")


_GRAMS = f"""CASE WHEN len(t) >= 3 THEN list_distinct(list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' '))) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END"""
_TAIL = _HOOKS[len(_FEATURES) :]


@query(
    "clip_funnel",
    f"""WITH RECURSIVE {_SCORES_OR_FIRST}{_TAIL}, picked AS ({suppress_sql('scored', 'conv_id', SHORTLIST, 0.45)}),
    short AS (SELECT p.conv_id, p.place AS seed, s.i, s.j FROM picked p JOIN scored s ON s.conv_id = p.conv_id AND s.a = p.a AND s.b = p.b),
    g AS (SELECT m.conv_id, m.seed, m.i, m.j, h.s AS s0, x.s AS s1, y.s AS s2, x.bad AS bad1, y.bad AS bad2, coalesce(m.i + 1 <= m.j AND t.b - x.a >= {SHORTEST}, false) AS long1, coalesce(m.i + 2 <= m.j AND t.b - y.a >= {SHORTEST}, false) AS long2
      FROM short m JOIN hook h ON h.conv_id = m.conv_id AND h.sentence = m.i JOIN hook t ON t.conv_id = m.conv_id AND t.sentence = m.j LEFT JOIN hook x ON x.conv_id = m.conv_id AND x.sentence = m.i + 1 LEFT JOIN hook y ON y.conv_id = m.conv_id AND y.sentence = m.i + 2),
    moved AS (SELECT conv_id, seed, i + CASE WHEN long1 AND long2 AND bad2 = 0 AND s2 > CASE WHEN opens THEN s1 ELSE s0 END + 12 THEN 2 WHEN opens THEN 1 ELSE 0 END AS i, j FROM (SELECT *, long1 AND bad1 = 0 AND s1 > s0 + 12 AS opens FROM g)),
    again AS (SELECT * REPLACE (round(least(100, greatest(0, 0.6::DOUBLE * hook + 0.4::DOUBLE * (0.3::DOUBLE * round(w1, 1) + 0.4::DOUBLE * round(w3, 1) + 0.3::DOUBLE * round(w5, 1)))), 2) AS hook) FROM (
      SELECT m.seed, s.* EXCLUDE (score), h.w1, h.w3, h.w5 FROM moved m JOIN scored s ON s.conv_id = m.conv_id AND s.i = m.i AND s.j = m.j JOIN hook h ON h.conv_id = m.conv_id AND h.sentence = m.i)),
    rated AS MATERIALIZED (SELECT conv_id, seed, i, j, top, {_COMBINED} AS score FROM again),
    ws AS MATERIALIZED (SELECT *, lag("end") OVER o AS prev_end, lead(start) OVER o AS next_start FROM clean WINDOW o AS (PARTITION BY conv_id ORDER BY idx)), k AS MATERIALIZED (SELECT conv_id, n + 0.37::DOUBLE AS c FROM (SELECT conv_id, unnest(range(0, floor(top)::BIGINT + 1)) AS n FROM tops) WHERE n % 23 = 7),
    e0 AS (SELECT r.*, x.start AS ws0, coalesce(x.prev_end, 0) AS pe, y."end" AS we, coalesce(y.next_start, top) AS ns FROM rated r JOIN numbered fi ON fi.conv_id = r.conv_id AND fi.sentence = r.i JOIN numbered lj ON lj.conv_id = r.conv_id AND lj.sentence = r.j
      JOIN ws x ON x.conv_id = r.conv_id AND x.idx = fi.first_word JOIN ws y ON y.conv_id = r.conv_id AND y.idx = lj.last_word),
    e1 AS (SELECT *, least(ns - 0.03, we + 0.35, top) AS plain, (SELECT min(c) FROM k WHERE k.conv_id = e0.conv_id AND c BETWEEN ws0 - 0.45 AND ws0 AND c >= pe) AS cs, (SELECT min(c) FROM k WHERE k.conv_id = e0.conv_id AND c BETWEEN we AND we + 0.45 AND c <= ns) AS ce FROM e0),
    e2 AS (SELECT *, CASE WHEN ce IS NOT NULL THEN greatest(we + 0.02, ce - 0.04) WHEN plain <= we THEN least(top, we + 0.02) ELSE plain END AS e3 FROM e1),
    clips AS MATERIALIZED (SELECT conv_id, seed, i, j, score, round(coalesce(cs, greatest(pe + 0.03, ws0 - 0.12, 0)), 3) AS start, round(coalesce((SELECT greatest(we + 0.02, min(c) - 0.04) FROM k WHERE k.conv_id = e2.conv_id AND c > we AND c < e3 HAVING count(*) > 0), e3), 3) AS "end",
      (SELECT regexp_extract_all(lower(string_agg(f.text, ' ' ORDER BY f.sentence)), '{TOKEN.replace(chr(39), chr(39) * 2)}', 0) FROM f WHERE f.conv_id = e2.conv_id AND f.sentence BETWEEN e2.i AND e2.j) AS t FROM e2),
    sets AS MATERIALIZED (SELECT *, {_GRAMS} AS grams, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, seed) AS r FROM clips),
    bad AS (SELECT x.conv_id, x.r, list(y.r) AS rivals FROM sets x JOIN sets y ON y.conv_id = x.conv_id AND y.r < x.r AND greatest(greatest(least(x."end", y."end") - greatest(x.start, y.start), 0) / greatest(least(x."end" - x.start, y."end" - y.start), 0.01),
      len(list_intersect(x.grams, y.grams)) / (len(x.grams) + len(y.grams) - len(list_intersect(x.grams, y.grams)))::DOUBLE, 0.9::DOUBLE * len(list_intersect(x.grams, y.grams)) / least(len(x.grams), len(y.grams))) >= {ALIKE} GROUP BY 1, 2),
    kept(conv_id, r, duplicate, accepted) AS (SELECT DISTINCT conv_id, 0::BIGINT, false, []::BIGINT[] FROM sets
      UNION ALL SELECT conv_id, r, hit, CASE WHEN hit THEN accepted ELSE list_append(accepted, r) END FROM (SELECT s.conv_id, s.r, accepted, len(list_intersect(accepted, coalesce(b.rivals, []))) > 0 AS hit FROM kept q JOIN sets s ON s.conv_id = q.conv_id AND s.r = q.r + 1 LEFT JOIN bad b ON b.conv_id = s.conv_id AND b.r = s.r))
    SELECT conv_id, place, i, j, start, "end", points AS score, duplicate FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY duplicate, points DESC, seed) AS place FROM (
      SELECT s.*, duplicate, CASE WHEN duplicate THEN greatest(0, round(score - {LOST}, 2)) ELSE score END AS points FROM sets s JOIN kept USING (conv_id, r))) WHERE place <= {FINAL}""",
)
def clip_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve clips of each conversation that are left after all passes."""
    words, features = conversation_features(spark, sf_dir)
    return funnel(words, features, signals_of(words), "conv_id").where("end - start > 0")
