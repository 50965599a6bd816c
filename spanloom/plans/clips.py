"""Clip ranking, the flagship plan: sentences, features, spans, metrics, penalties, weighted score, greedy choice.

Span totals are differences of running sums over sentences, so a span costs two equi-joins whatever its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators.ranking import clamp, enumerate_spans, suppress, suppress_sql, weighted_score
from spanloom.operators.text import SENTENCES, STOP, ends_sentence, sentences_of, tokens, words_of
from spanloom.registry import query, table

GAP, SHORTEST, LONGEST, TARGET = 3.0, 5.0, 60.0, 30.0
WEIGHTS = {"pacing": 1.5, "story": 1.0, "information": 1.0, "opening": 0.5}
WEAK = ("and", "but", "so", "und", "et", "y")


def sentence_features(words: DataFrame) -> DataFrame:
    """Sentences with counts of words and content words, whether they close, and how they open."""
    toks = tokens(F.col("text"))
    rows = sentences_of(words).withColumn("t", toks)
    content = F.size(F.filter("t", lambda x: ~x.isin(*STOP) & (F.length(x) > 2)))
    return rows.select(
        "conv_id", "sentence", F.col("start").alias("a"), F.col("end").alias("b"), (F.col("last_word") - F.col("first_word") + 1).alias("n_words"), content.alias("n_content"),
        ends_sentence(F.regexp_extract("text", r"(\S+)$", 1)).cast("int").alias("closes"), F.coalesce(F.get("t", F.lit(0)).isin(*WEAK), F.lit(False)).cast("int").alias("weak"),
    )


def clip_scores(features: DataFrame) -> DataFrame:
    """(conv_id, i, j, a, b, metrics, score) of every span of sentences."""
    w = Window.partitionBy("conv_id").orderBy("sentence").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = features.withColumn("sum_words", F.sum("n_words").over(w)).withColumn("sum_content", F.sum("n_content").over(w))
    spans = enumerate_spans(features.select("conv_id", "sentence", "a", "b"), "conv_id", "sentence", GAP, SHORTEST, LONGEST)
    head = known.select("conv_id", F.col("sentence").alias("i"), (F.col("sum_words") - F.col("n_words")).alias("w0"), (F.col("sum_content") - F.col("n_content")).alias("c0"), F.col("weak").alias("weak_open"))
    tail = known.select("conv_id", F.col("sentence").alias("j"), F.col("sum_words").alias("w1"), F.col("sum_content").alias("c1"), F.col("closes").alias("closed"))
    rows = spans.join(head, ["conv_id", "i"]).join(tail, ["conv_id", "j"])
    dur = F.greatest(F.col("b") - F.col("a"), F.lit(0.1))
    rate_fit = 1.0 - F.least(F.lit(1.0), F.abs((F.col("w1") - F.col("w0")) / dur - 2.9) / 1.8)
    dur_fit = 1.0 - F.least(F.lit(1.0), F.abs(dur - TARGET) / TARGET)
    rows = rows.select(
        "conv_id", "i", "j", "a", "b", clamp(100 * (0.6 * 0.9 + 0.4 * rate_fit)).alias("pacing"), clamp(30 + 20 * (1 - F.col("weak_open")) + 22 * F.col("closed") + 14 * dur_fit).alias("story"),
        clamp(20 + 16 * ((F.col("c1") - F.col("c0")) / dur)).alias("information"), clamp(38.0 - 18 * F.col("weak_open")).alias("opening"), F.when(F.col("closed") == 1, 0.0).otherwise(7.0).alias("penalty"),
    )
    return rows.withColumn("score", weighted_score(WEIGHTS, F.col("penalty"), places=9))


_STOP = ", ".join(f"'{x}'" for x in STOP)
_WEAK = ", ".join(f"'{x}'" for x in WEAK)
_FEATURES = f"""(SELECT conv_id, sentence, start AS a, "end" AS b, last_word - first_word + 1 AS n_words, len(list_filter(t, lambda x: x NOT IN ({_STOP}) AND length(x) > 2)) AS n_content,
  (regexp_matches(z, '[.!?…]["'')\\]]*$') AND lower(z) NOT IN ('mr.', 'mrs.', 'dr.', 'st.', 'vs.', 'etc.', 'e.g.', 'i.e.') AND NOT regexp_matches(z, '^[A-Z]\\.$'))::INT AS closes, coalesce(t[1] IN ({_WEAK}), false)::INT AS weak
  FROM (SELECT *, regexp_extract_all(lower(text), '[a-z0-9$%€£'']+(?:[.,][0-9]+)?', 0) AS t, regexp_extract(text, '(\\S+)$', 1) AS z FROM {SENTENCES}))"""
_SCORES = f"""(SELECT conv_id, i, j, a, b, round(least(greatest((pacing * 1.5::DOUBLE + story * 1.0::DOUBLE + information * 1.0::DOUBLE + opening * 0.5::DOUBLE) / 4.0::DOUBLE - penalty, 0), 100), 9) AS score FROM (
  SELECT conv_id, i, j, a, b, least(greatest(100 * (0.54::DOUBLE + 0.4::DOUBLE * (1 - least(1, abs(words / dur - 2.9::DOUBLE) / 1.8::DOUBLE))), 0), 100) AS pacing,
    least(greatest(30 + 20 * (1 - weak) + 22 * closes + 14 * (1 - least(1, abs(dur - 30) / 30)), 0), 100) AS story, least(greatest(20 + 16 * (content / dur), 0), 100) AS information, 38 - 18 * weak AS opening, CASE WHEN closes = 1 THEN 0 ELSE 7 END AS penalty
  FROM (SELECT x.conv_id, x.sentence AS i, y.sentence AS j, x.a, y.b, greatest(y.b - x.a, 0.1)::DOUBLE AS dur, x.weak, y.closes, y.sw - x.sw + x.n_words AS words, y.sc - x.sc + x.n_content AS content
    FROM f x JOIN f y ON x.conv_id = y.conv_id AND x.run = y.run AND y.sentence >= x.sentence AND y.b - x.a BETWEEN {SHORTEST} AND {LONGEST})))"""
_F = f"""f AS MATERIALIZED (SELECT *, sum(new) OVER w AS run, sum(n_words) OVER w AS sw, sum(n_content) OVER w AS sc FROM (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY conv_id ORDER BY sentence) > {GAP} THEN 1 ELSE 0 END AS new FROM {_FEATURES})
  WINDOW w AS (PARTITION BY conv_id ORDER BY sentence ROWS UNBOUNDED PRECEDING))"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clip_scores(sentence_features(words_of(table(spark, sf_dir, "conversations"))))


@query("span_scores", f"WITH {_F} SELECT conv_id, i, j, score FROM {_SCORES}")
def span_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("conv_id", "i", "j", "score")


@query("clip_ranking", f"WITH {_F}, s AS MATERIALIZED (SELECT * FROM {_SCORES}) SELECT * FROM ({suppress_sql('s', 'conv_id', 3, 0.45)})")
def clip_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best clips of each conversation that overlap little."""
    return suppress(scored(spark, sf_dir), "conv_id", 3, 0.45)
