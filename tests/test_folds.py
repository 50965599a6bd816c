"""Ordered folds, acceptance in rounds, recurrences, schedules and edits: rules one by one, against plain loops."""

import math
import random

import pytest

from spanloom.operators import edits, folds, schedule
from spanloom.operators.folds import ordered_fold

WORD = "k long, idx long, text string, start double, end double, prob double, segment long"


def words_frame(spark, tokens, gap=0.1, key=1):
    return spark.createDataFrame([(key, i, t, i * (0.3 + gap), i * (0.3 + gap) + 0.3, 0.9, i // 9) for i, t in enumerate(tokens)], WORD)


def test_state_is_carried_over_batches_and_keys(spark):
    rows = spark.range(30_000).selectExpr("id % 3 AS k", "id AS i")

    def fold(found):
        total = 0
        for k, i in found:
            total += i
            if i >= 29_990:
                yield k, total

    got = {r.k: r.t for r in ordered_fold(rows, ["k"], ["i"], "k long, t long", fold).groupBy("k").agg({"t": "max"}).withColumnRenamed("max(t)", "t").collect()}
    assert got == {k: sum(range(k, 30_000, 3)) for k in range(3)}
    assert ordered_fold(rows.limit(0), ["k"], ["i"], "k long, t long", fold).count() == 0


def test_sanitised_words(spark):
    raw = [(1, 0, " 2", 0.0, 0.3, 0.9, 0), (1, 1, ",999", 0.35, 0.6, 0.5, 0), (1, 2, "  ", 0.6, 0.7, 0.1, 0), (1, 3, " next", 0.5, 0.51, 0.8, 0), (1, 4, None, 1.0, 1.1, 0.9, 0), (1, 5, "late", 2.0, 2.2, 0.9, 1), (None, 0, " a", 0.0, 0.1, None, 0)]
    rows = spark.createDataFrame(raw, WORD)
    got = {(r.k, r.idx): (r.text, r.start, r.end, r.prob) for r in folds.sanitised_words(rows, "k").collect()}
    assert got == {(1, 0): (" 2,999", 0.0, 0.6, 0.5), (1, 1): (" next", 0.58, 0.62, 0.8), (1, 2): ("late", 2.0, 2.2, 0.9), (None, 0): (" a", 0.0, 0.1, 1.0)}
    assert folds.sanitised_words(rows, "k", spaced=False).where("k = 1").count() == 4
    cut = {r.idx: (r.start, r.end) for r in folds.sanitised_words(rows, "k", duration=0.61).where("k = 1").collect()}
    assert cut[1] == (0.58, 0.61) and cut[2] == (0.6, 0.61)


@pytest.mark.parametrize(
    "tokens,gap,want",
    [
        ([" aa."] * 3, 0.1, [(0, 0), (1, 1), (2, 2)]),
        ([" Mr.", " J.", " x!"], 0.1, [(0, 2)]),
        ([" w"] * 100, 0.1, [(0, 44), (45, 89), (90, 99)]),
        ([" w"] * 30 + [" c,"] + [" w"] * 30, 0.1, [(0, 30), (31, 60)]),
        ([" w"] * 4 + [" c,"] + [" w"] * 60, 0.1, [(0, 44), (45, 64)]),
        ([" w", " w"], 1.2, [(0, 0), (1, 1)]),
        ([" w"] * 12, 0.7, [(0, 8), (9, 11)]),
    ],
)
def test_sentence_rules(spark, tokens, gap, want):
    got = folds.sentence_ranges(words_frame(spark, tokens, gap), "k").collect()
    assert sorted((r.first_word, r.last_word) for r in got) == want and sorted(r.sentence for r in got) == list(range(len(want)))


def test_ten_thousand_words_without_full_stops(spark):
    rows = folds.built_sentences(words_frame(spark, [" w"] * 10_000), "k").collect()
    assert len(rows) == 223 and max(r.last_word - r.first_word + 1 for r in rows) == 45 and {r.text for r in rows} == {" ".join(["w"] * 45), " ".join(["w"] * 10)}


def exchanges(rows):
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return len([line for line in plan.splitlines() if "Exchange " in line])


def test_words_and_sentences_are_dealt_once(spark):
    """The window that numbers words leaves them as the folds of words and of sentences need them."""
    from __spark_entry__ import queries

    found = queries()
    assert {name: exchanges(found[name](spark, "/root/testdata/sf0.001")) for name in ("sanitised_words", "built_sentences", "emphasised_words")} == {"sanitised_words": 1, "built_sentences": 1, "emphasised_words": 2}
    assert exchanges(folds.sentence_ranges(words_frame(spark, [" w"]), "k")) == 1


def test_sentences_with_unknown_times_and_keys(spark):
    rows = [(1, 0, " a", 0.0, None, 0.9, 0), (1, 1, " b", 5.0, 5.2, 0.9, None), (1, 2, " c", 6.0, 6.1, 0.9, 1), (1, 3, " d", None, 6.5, 0.9, 1), (1, 4, " e", 9.0, 9.1, 0.9, 1), (None, 0, " x", 0.0, 0.1, 0.9, 0)]
    words = spark.createDataFrame(rows, WORD)
    got = sorted((r.k, r.sentence, r.first_word, r.last_word, r.start, r.end, r.text) for r in folds.built_sentences(words, "k").collect())
    assert got == [(1, 0, 0, 3, 0.0, 6.5, "a b c d"), (1, 1, 4, 4, 9.0, 9.1, "e")]
    assert folds.sentence_ranges(words, "k").where("k IS NULL").count() == 1


def test_joined_tokens(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([([" a", "b", ",", " c"],), (["一", "二"],), ([],), ([" x ", "y"],)], "t array<string>")
    assert [r[0] for r in rows.select(folds.join_tokens(F.col("t"))).collect()] == ["a b, c", "一二", "", "x y"]


def test_greedy_accept_follows_long_chains(spark):
    random.seed(2)
    edges = [(i, i - 1) for i in range(1, 12)] + [(20 + i, random.randrange(20, 20 + i)) for i in range(1, 40) for _ in range(2)]
    items = [*range(12), *range(20, 60)]
    accepted = {}
    for i in items:
        accepted[i] = not any(accepted[e] for j, e in edges if j == i)
    got = folds.greedy_accept(spark.createDataFrame([(i,) for i in items + items], "id long"), spark.createDataFrame(edges, "id long, earlier long"), "id").collect()
    assert {r.id: r.accepted for r in got} == accepted and len(got) == len(items)
    assert folds.greedy_accept(spark.createDataFrame([], "id long"), spark.createDataFrame([], "id long, earlier long"), "id").count() == 0


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_spring_equals_steps(spark, block):
    random.seed(block)
    series = {k: [(random.random(), random.random() < 0.1) for _ in range(n)] for k, n in ((1, 1), (2, 2), (3, 50))}

    def run(xs, cuts):
        place, speed, out = xs[0], 0.0, []
        for i, x in enumerate(xs):
            if i in cuts:
                place, speed = x, 0.0
            else:
                d, e = place - x, math.exp(-9 * 0.25)
                place, speed = x + (d + (speed + 9 * d) * 0.25) * e, (speed - 9 * (speed + 9 * d) * 0.25) * e
            out.append(place)
        return out

    want = {}
    for k, s in series.items():
        xs, cuts = [x for x, _ in s], {i for i, (_, c) in enumerate(s) if c}
        back = run(xs[::-1], {len(xs) - i for i in cuts})[::-1]
        want |= {(k, i): (a + b) / 2 for i, (a, b) in enumerate(zip(run(xs, cuts), back))}
    rows = spark.createDataFrame([(k, i, x, c) for k, s in series.items() for i, (x, c) in enumerate(s)], "k long, i long, x double, cut boolean")
    got = {(r.k, r.i): r.y for r in folds.spring(rows, "k", "long", 0.25, block=block).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


# ---- schedules ------------------------------------------------------------------------------------
NOW = schedule.micros("2024-03-01 10:00:00")
HOUR = 60 * schedule.MINUTE


def previews(spark, taken, **more):
    channels = spark.createDataFrame([(1,), (2,)], "c long")
    rows = schedule.slot_preview(channels, spark.createDataFrame(taken, "c long, t long"), "c", "long", NOW, **({"slots": ("09:00", "12:00", "12:30"), "n": 3, "cap": 2, "gap": 60} | more)).collect()
    return {c: [(r.t - NOW) / HOUR for r in sorted(rows, key=lambda r: r.k) if r.c == c] for c in (1, 2)}


def test_slots_respect_gap_cap_lead_and_horizon(spark):
    got = previews(spark, [(1, NOW + 2 * HOUR + 1), (1, None)])
    assert got == {1: [23.0, 26.0, 47.0], 2: [2.0, 23.0, 26.0]}  # 12:30 is within an hour of 12:00; a day holds two
    assert previews(spark, [(2, NOW - HOUR), (2, NOW - 2 * HOUR)])[2] == [23.0, 26.0, 47.0]  # today is full
    assert previews(spark, [], horizon=1)[1] == [2.0]
    assert previews(spark, [], cap=0, gap=0, n=4)[1] == [2.0, 2.5, 23.0, 26.0]
    assert previews(spark, [], slots=("10:02", "10:03"), n=1)[1] == [0.05]


def test_slots_are_local(spark):
    assert previews(spark, [], zone="America/New_York", n=2)[1] == [4.0, 7.0]


def test_intervals(spark):
    channels, taken = spark.createDataFrame([(1,), (2,)], "c long"), spark.createDataFrame([(1, NOW + HOUR)], "c long, t long")
    rows = schedule.interval_preview(channels, taken, "c", "long", NOW, n=4, cap=2, gap=240).collect()
    got = {c: [(r.t - NOW) / HOUR for r in sorted(rows, key=lambda r: r.k) if r.c == c] for c in (1, 2)}
    assert got == {1: [5.0, 23.0, 27.0, 47.0], 2: [0.05, 4.05, 23.0, 27.0]}


# ---- edits ----------------------------------------------------------------------------------------
def test_maps_at_their_edges(spark):
    ranges = spark.createDataFrame([(1, 10.0, 12.0), (1, 12.0, 13.0), (1, 20.0, 21.0)], "k long, s double, e double")
    points = spark.createDataFrame([(1, float(t)) for t in (9, 10, 11, 12, 13, 15, 20, 21, 22)] + [(1, None), (2, 1.0)], "k long, t double")
    got = {(r.k, r.t): r.o for r in edits.source_to_output(points, ranges, "k", "t", "o").collect()}
    assert got == {(1, 9.0): None, (1, 10.0): 0, (1, 11.0): 1, (1, 12.0): 2, (1, 13.0): 3, (1, 15.0): None, (1, 20.0): 3, (1, 21.0): 4, (1, 22.0): None, (1, None): None, (2, 1.0): None}
    back = spark.createDataFrame([(1, float(t)) for t in (-1, 0, 1, 2, 3, 3.5, 4, 9)], "k long, t double")
    assert {r.t: round(r.o, 6) for r in edits.output_to_source(back, ranges, "k", "t", "o").collect()} == {-1: 10, 0: 10, 1: 11, 2: 12, 3: 13, 3.5: 20.5, 4: 21, 9: 21}


def test_seams_far_behind_the_start_belong_to_the_earlier_range(spark):
    """Behind 16,384 s a difference of 1e-12 is lost in a double."""
    ranges = spark.createDataFrame([(1, 0.0, 20000.0), (1, 30000.0, 30010.0), (1, 40000.0, 40010.0)], "k long, s double, e double")
    points = spark.createDataFrame([(1, t) for t in (-1.0, 20000.0, 20000.5, 20010.0, 20020.0, 20021.0)], "k long, t double")
    got = {r.t: r.o for r in edits.output_to_source(points, ranges, "k", "t", "o").collect()}
    assert got == {-1.0: 0.0, 20000.0: 20000.0, 20000.5: 30000.5, 20010.0: 30010.0, 20020.0: 40010.0, 20021.0: 40010.0}


def test_round_trip_inside_kept_ranges(spark):
    random.seed(4)
    cuts, t = [], 0.0
    for _ in range(20):
        t += random.uniform(0.1, 5)
        cuts.append((1, t, t + (d := random.uniform(0.5, 6))))
        t += d
    ranges = spark.createDataFrame(cuts, "k long, s double, e double")
    points = spark.createDataFrame([(1, random.uniform(s + 1e-3, e - 1e-3)) for _, s, e in cuts for _ in range(5)], "k long, t double")
    rows = edits.output_to_source(edits.source_to_output(points, ranges, "k", "t", "o"), ranges, "k", "o", "back").collect()
    assert len(rows) == 100 and all(abs(r.t - r.back) < 1e-9 for r in rows)


def test_an_only_range_is_not_deleted_and_edges_stay_apart(spark):
    one = spark.createDataFrame([(1, 0.0, 5.0), (2, 0.0, 5.0), (2, 6.0, 8.0)], "k long, s double, e double")
    gone = edits.delete_ranges(one, spark.createDataFrame([(1, 0), (2, 0)], "k long, place int"), "k").collect()
    assert sorted((r.k, r.s) for r in gone) == [(1, 0.0), (2, 6.0)]
    asked = spark.createDataFrame([(1, 0, "end", 99.0, 7.0), (2, 0, "end", 7.0, 9.0)], "k long, place int, edge string, to double, duration double")
    assert sorted((r.k, r.s, r.e) for r in edits.trim_ranges(one, asked, "k").collect()) == [(1, 0.0, 7.0), (2, 0.0, 6.0), (2, 6.0, 8.0)]
    least = spark.createDataFrame([(2, 1, "start", 7.99, 9.0)], "k long, place int, edge string, to double, duration double")
    assert (2, 7.8, 8.0) in [(r.k, round(r.s, 6), r.e) for r in edits.trim_ranges(one, least, "k").collect()]


@pytest.mark.parametrize(
    "cuts,want",
    [
        ([], (1.88, 3.35)),  # lead-in and tail
        ([1.7], (1.7, 3.35)),  # a cut before the first word
        ([1.56, 1.7], (1.56, 3.35)),  # the earliest in the window
        ([1.4], (1.88, 3.35)),  # beyond the window
        ([3.2], (1.88, 3.16)),  # a cut behind the last word
        ([3.01], (1.88, 3.02)),  # never into the word
        ([3.44], (1.88, 3.4)),  # behind the tail, within the window
    ],
)
def test_precedence_of_bounds(spark, cuts, want):
    words = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 2.0, 2.5), (1, 2, 2.6, 3.0), (1, 3, 4.0, 5.0)], "k long, idx long, start double, end double")
    spans = spark.createDataFrame([(1, 1, 2)], "k long, first_word long, last_word long")
    there = spark.createDataFrame([(1, float(c)) for c in cuts] + [(2, 2.9)], "k long, c double")
    [row] = edits.refined_bounds(spans, words, there, spark.createDataFrame([(1, 9.0)], "k long, duration double"), "k").collect()
    assert (row.start, row.end) == want


def test_glued_words_and_ends(spark):
    words = spark.createDataFrame([(1, 0, 0.05, 1.0), (1, 1, 1.0, 2.0), (1, 2, 2.0, 3.0)], "k long, idx long, start double, end double")
    spans = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 2, 2)], "k long, first_word long, last_word long")
    rows = edits.refined_bounds(spans, words, spark.createDataFrame([], "k long, c double"), spark.createDataFrame([(1, 3.01)], "k long, duration double"), "k").collect()
    assert sorted((r.start, r.end) for r in rows) == [(0.03, 1.02), (1.03, 2.02), (2.03, 3.01)]


def test_user_bounds(spark):
    words = spark.createDataFrame([(1, 0, 1.0, 2.0), (1, 1, 5.0, 6.0), (1, 2, 6.1, 7.0)], "k long, idx long, start double, end double")
    asked = spark.createDataFrame([(1, 0, 0.0, 6.5), (1, 1, 0.0, 2.0), (1, 2, 2.1, 5.1 - 0.06), (1, 3, 20.0, 30.0), (1, 4, 1.97, 30.0)], "k long, id long, a double, b double")
    got = {r.id: (r.reason, r.start, r.end, r.first_word, r.last_word) for r in edits.snapped_bounds(asked, words, "k", 2.9).collect()}
    assert got == {0: (None, 0.88, 7.3, 0, 2), 1: ("too short", None, None, None, None), 2: ("no speech", None, None, None, None), 3: ("no speech", None, None, None, None), 4: (None, 4.88, 7.3, 1, 2)}


def test_spring_calls_no_function_per_block(spark):
    """Blocks go through tasks batch by batch: a call for each block of 16 samples was most of the time."""
    from spanloom.operators import folds

    rows = spark.range(100).selectExpr("id % 3 AS k", "id div 3 AS i", "id / 100 AS x", "id % 20 = 0 AS cut")
    plan = folds.spring(rows, "k", "long", 0.25, block=16)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
