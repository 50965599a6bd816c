"""Sections, hooks, emphasis, picks, cutaways, records and logs by hand-made cases; new queries on empty tables."""

import pytest

SF = "/root/testdata/sf0.001"
NEW = [
    "sanitised_words", "built_sentences", "greedy_accept", "holds", "camera_path", "spring", "slot_preview", "interval_preview", "retime", "retimed_items", "range_edits", "refined_bounds", "snapped_bounds",
    "tracker", "tempo", "beats", "zoom_product", "contiguous_labels", "fingerprint_cross", "caption_pages", "balanced_lines", "sentence_cues", "span_metrics", "best_clips", "section_labels", "hook_windows", "emphasised_words",
    "auto_picks", "cutaways", "feed_entries", "normalised_records", "source_references", "media_logs", "nms_top12", "percentiles", "not_taken_title",
]


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("events", "conversations", "lineitem", "orders", "customer", "part", "pages"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", NEW)
def test_empty_tables(spark, empty, name):
    import __spark_entry__ as entry_point

    assert entry_point.queries()[name](spark, empty).collect() == []


def test_section_chunks(spark):
    from spanloom.plans.edit_plan import section_chunks

    rows = spark.createDataFrame([(1, i, i * 10.0, i * 10.0 + 9) for i in range(12)] + [(2, 0, 0.0, 500.0), (2, 1, 500.0, 501.0)], "k long, sentence long, a double, b double")
    got = {k: sorted((r.first, r.last) for r in section_chunks(rows, "k", "long", 45.0, 3).collect() if r.k == k) for k in (1, 2)}
    assert got == {1: [(0, 2), (3, 5), (6, 8), (9, 11)], 2: [(0, 0), (1, 1)]}
    assert sorted((r.first, r.last) for r in section_chunks(rows, "k", "long", 45.0, 28).collect() if r.k == 1) == [(0, 3), (4, 7), (8, 11)]


def test_emphasis_budget_and_glue(spark):
    from spanloom.plans.edit_plan import emphasis

    rows = spark.createDataFrame([(1, 0, "twice", 5.0), (1, 1, "as", 0.0), (1, 2, "fast", 4.0), (1, 3, "x", 2.0), (1, 4, "y", 3.9), (2, 0, "z", 2.3)], "k long, i long, norm string, weight double")
    got = {(r.k, r.i): r.chosen for r in emphasis(rows, ("k",), "i", ("as",), ratio=0.4).collect()}
    assert got == {(1, 0): True, (1, 1): True, (1, 2): True, (1, 3): False, (1, 4): False, (2, 0): False}


def test_auto_picks(spark):
    from spanloom.plans.edit_plan import auto_picks

    found = spark.createDataFrame([(1, 10, 1, 90.0, False), (2, 10, 1, 80.0, False), (3, 10, 1, 95.0, True), (4, 11, 1, 50.0, None), (5, 12, 2, 50.0, False), (6, 13, 3, None, False), (7, 14, 3, 10.0, False)], "id long, video long, source long, score double, duplicate boolean")
    rules = spark.createDataFrame([(1, 70.0, 1, 2, False), (2, 70.0, 3, None, True), (3, 70.0, 3, 0, False)], "source long, least double, most int, daily int, autopilot boolean")
    made = spark.createDataFrame([(1, 0)], "source long, made long")
    assert sorted((r.id, r.best_available) for r in auto_picks(found, rules, made, 20.0).collect()) == [(1, False), (4, True)]
    assert [r.id for r in auto_picks(found, rules, spark.createDataFrame([(1, 1)], "source long, made long"), 20.0).collect()] == [1]


def test_auto_picks_deals_more_rows_into_more_tasks(spark, monkeypatch):
    from spanloom.plans import edit_plan

    want = sorted(edit_plan.auto_picks_query(spark, SF).collect())
    monkeypatch.setattr(edit_plan, "TASK_ROWS", 400)
    rows = edit_plan.auto_picks_query(spark, SF)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert rows._jdf.queryExecution().executedPlan().toString().count(f", {-(-lines // 400)}), REPARTITION_BY_NUM") == 5
    assert want and sorted(rows.collect()) == want


def test_cutaways_keep_apart_and_use_clips_once(spark):
    from spanloom.plans.edit_plan import cutaways

    words = spark.createDataFrame([(1, "Dog,", 3.0, False), (1, "cat", 6.0, True), (1, "dog", 9.0, False), (1, "bird", 20.0, False), (1, "dog", 1.0, True), (1, "fish", 30.0, None)], "k long, word string, start double, emphasis boolean")
    clips = spark.createDataFrame([("a", ["pet"], 5.0), ("b", ["wild", "pet"], 1.0), ("c", ["wild"], 0.5)], "clip string, tags array<string>, duration double")
    tags = spark.createDataFrame([("dog", "pet"), ("cat", "pet"), ("bird", "wild")], "word string, tag string")
    rows = cutaways(words, clips, tags, spark.createDataFrame([(1, 60.0)], "k long, total double"), "k", "long").collect()
    assert [(r.start, r.end, r.source_start, r.clip) for r in rows] == [(5.85, 7.85, 1.5, "a"), (19.85, 20.85, 0.0, "b")]


def test_openings_are_dropped_only_for_clearly_stronger_ones(spark):
    from spanloom.plans.edit_plan import shifted_openings

    features = spark.createDataFrame([(k, i, i * 5.0, i * 5.0 + 4, int(k == 2 and i == 1), 0) for k in (1, 2, 3) for i in range(6)], "k long, sentence long, a double, b double, dangling_open int, context_ref int")
    strength = {1: (30.0, 50.0, 55.0), 2: (30.0, 90.0, 60.0), 3: (30.0, 41.0, 42.0)}
    hook = spark.createDataFrame([(k, i, 0.0, s, s) for k, row in strength.items() for i, s in enumerate((*row, 0.0, 0.0, 0.0))], "k long, sentence long, w1 double, w3 double, w5 double")
    spans = spark.createDataFrame([(k, 0, 5) for k in (1, 2, 3)], "k long, i long, j long")
    assert {r.k: r.shift for r in shifted_openings(spans, features, hook, "k", 10.0).collect()} == {1: 1, 2: 2, 3: 0}
    assert {r.k: r.shift for r in shifted_openings(spans, features, hook, "k", 22.0).collect()} == {1: 1, 2: 0, 3: 0}


def test_broken_feeds_and_records(spark):
    from spanloom.sources.records import feed_entries, normalised_records

    feeds = spark.createDataFrame([(1, None), (2, ""), (3, "<feed><entry><videoId>x</videoId></entry></feed>"), (4, "no xml"), (5, "<feed/>")], "k long, xml string")
    assert [(r.k, r.id, r.title, r.views) for r in feed_entries(feeds, "k", "xml").collect()] == [(3, "x", "", None)]
    records = spark.createDataFrame([(1, None), (2, "{"), (3, '{"id":"a","timestamp":"x","release_timestamp":86400,"thumbnails":[{"id":"avatar","url":"p","width":9,"height":9}]}'), (4, '{"id":"b","title":"","release_date":"20240229"}')], "k long, j string")
    got = {r.k: (r.id, r.title, r.published and r.published.strftime("%F"), r.thumbnail) for r in normalised_records(records, "k", "j").collect()}
    assert got == {1: (None, "Untitled", None, None), 2: (None, "Untitled", None, None), 3: ("a", "Untitled", "1970-01-02", None), 4: ("b", "Untitled", "2024-02-29", None)}


def test_references_and_addresses(spark):
    from pyspark.sql import functions as F
    from spanloom.sources.records import canonical_url, source_reference, uploads_list

    typed = ["@ünï_1", None, '"youtube.com/c/x"', "https://evil.example/watch?v=abcdefghijk", "https://user@www.youtube.com/live/abcdefghijk?start=10#t", "youtube.com/watch?v=abcdefghijk&t=1h"]
    rows = spark.createDataFrame(list(enumerate(typed)), "i int, t string").withColumn("r", source_reference(F.col("t"))).select("i", "r.*", canonical_url(F.col("r")).alias("url")).orderBy("i").collect()
    assert [(r.kind, r.value, r.start, r.reason) for r in rows] == [("handle", "@ünï_1", None, None), (None, None, None, "nothing entered"), ("channel", "c/x", None, None), (None, None, None, "unknown host"), ("video", "abcdefghijk", 10.0, None), ("video", "abcdefghijk", 3600.0, None)]
    assert rows[0].url == "https://www.youtube.com/@ünï_1" and rows[5].url == "https://www.youtube.com/watch?v=abcdefghijk"
    ids = spark.createDataFrame([("UC" + "x" * 22,), ("nope",)], "c string").select(uploads_list(F.col("c"))).collect()
    assert [r[0] for r in ids] == ["UU" + "x" * 22, None]


def test_log_facts(spark):
    from spanloom.operators.quality import log_facts

    log = "black_start:1.5 black_end:2.0 black_duration:0.5\nfreeze_start: 3\nfreeze_duration: 2.5\nfreeze_start: 9\nSummary:\n I: -99.0 LUFS\nSummary:\n I: -14.2 LUFS\n Peak: -inf dBFS\nmean_volume: -20.5 dB"
    rows = {r.k: tuple(r)[1:] for r in log_facts(spark.createDataFrame([(1, log), (2, None), (3, "")], "k long, log string"), "k", "log").collect()}
    assert rows == {1: (0.5, 2.5, -14.2, None, None, -20.5), 2: (0.0, 0.0, None, None, None, None), 3: (0.0, 0.0, None, None, None, None)}


def test_hook_lists_are_not_shuffled(spark):
    """Words are dealt by key before their lists of five seconds are made; no exchange carries a list."""
    from pyspark.sql import functions as F
    from spanloom.plans.edit_plan import hooks
    from spanloom.plans.scoring import CUES

    words = spark.range(200).select((F.col("id") % 2).alias("k"), F.floor(F.col("id") / 2).alias("idx"), F.lit("que").alias("text"), (F.col("id") * 0.2).alias("start"))
    features = words.where("idx % 10 = 0").select("k", F.floor(F.col("idx") / 10).alias("sentence"), F.col("idx").alias("first_word"), F.col("start").alias("a"))
    found = hooks(features, words, "k", CUES)
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("Join" in line for line in plan[: next(i for i, line in enumerate(plan) if "collect_list" in line)])
    assert found.count() == 20


def test_all_places_of_a_row_in_one_pass(spark):
    from pyspark.sql import functions as F
    from spanloom.plans.scoring import at_places

    series = spark.createDataFrame([(1, n, float(n * n)) for n in range(5)] + [(2, 0, 7.0)], "k long, n long, v double")
    rows = spark.createDataFrame([(1, 0, 0.0, 3.0), (1, 1, 2.0, 9.0), (2, 0, 1.0, -1.0), (3, 0, 0.0, 1.0)], "k long, sentence long, a double, b double")
    got = {(r.k, r.sentence): (r.v_a, r.v_b) for r in at_places(rows, series, "k", {"v": F.col("v")}, {"_a": F.col("a"), "_b": F.col("b")}).collect()}
    assert got == {(1, 0): (0.0, 5.0), (1, 1): (1.0, 30.0), (2, 0): (7.0, 0.0), (3, 0): (0.0, 0.0)}


def test_spans_of_some_first_sentences(spark):
    """Only the first sentences asked for are paired, and their spans are those of the whole job."""
    from spanloom.plans.scoring import conversation_features, scores, signals_of, span_rows, with_signals, with_word_weights

    words, features = conversation_features(spark, SF)
    known = with_signals(with_word_weights(features, "conv_id").drop("text", "content"), "conv_id", *signals_of(words)).localCheckpoint()
    every = {tuple(r) for r in scores(span_rows(known, "conv_id", 60.0, 3.0)).select("conv_id", "i", "j", "score").collect()}
    firsts = known.where("sentence % 7 = 3").selectExpr("conv_id", "sentence AS i")
    some = {tuple(r) for r in scores(span_rows(known, "conv_id", 60.0, 3.0, firsts)).select("conv_id", "i", "j", "score").collect()}
    assert some and some == {r for r in every if r[1] % 7 == 3}


def test_log_durations_add_up_to_their_decimal_sum(spark):
    """2.1 + 0.1 + 0.8 is 3.0000000000000004 in doubles in one order and 3.0 in another."""
    from itertools import permutations

    from spanloom.operators.quality import log_facts

    logs = ["\n".join(f"freeze_start: 2\nfreeze_duration: {x}" for x in p) for p in permutations(("2.100", "0.100", "0.800"))]
    rows = spark.createDataFrame(list(enumerate(logs)), "k int, log string")
    assert {r.frozen for r in log_facts(rows, "k", "log").collect()} == {3.0}


def test_span_metrics_on_halves_like_sql(spark, tmp_path):
    """Spans whose penalties or metrics lie on a half of their last place, where the last bits of sums and the way of rounding decide."""
    import duckdb
    from __spark_entry__ import oracle_sql, queries
    from compare import duckdb_rows, spark_rows

    duckdb.sql("SELECT * FROM '/root/testdata/sf0.1/conversations.parquet' WHERE conv_id IN (68, 88, 177, 283, 361, 552, 805)").write_parquet(str(tmp_path / "conversations.parquet"))
    names, rows = spark_rows(queries()["span_metrics"](spark, str(tmp_path)))
    assert rows and (names, rows) == duckdb_rows(oracle_sql()["span_metrics"], str(tmp_path))


def test_spans_of_small_batches(spark):
    """First sentences at the end of a batch wait for their last ones; spans are neither shuffled nor sorted."""
    from spanloom.operators.folds import checkpointed
    from spanloom.plans.scoring import conversation_features, scores, signals_of, span_rows, with_signals, with_word_weights

    words, features = conversation_features(spark, "/root/testdata/sf0.001")
    known = checkpointed(with_signals(with_word_weights(features, "conv_id").drop("text", "content"), "conv_id", *signals_of(words)))
    spans = scores(span_rows(known, "conv_id", 60.0, 3.0))
    plan = spans._jdf.queryExecution().sparkPlan().toString()
    assert "Sort" not in plan[: plan.index("MapInArrow")] and "Window" not in plan[: plan.index("MapInArrow")]
    every = {tuple(r) for r in spans.select("conv_id", "i", "j", "score", "pacing", "novelty").collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        some = {tuple(r) for r in scores(span_rows(known, "conv_id", 60.0, 3.0, shortest=15.0)).select("conv_id", "i", "j", "score", "pacing", "novelty", "a", "b").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert some and {r[:6] for r in some} <= every and all(15.0 <= r[7] - r[6] <= 60.0 for r in some)
    ends = {(r.conv_id, r.sentence): (r.a, r.b) for r in known.collect()}
    assert len(some) == sum(15.0 <= ends[c, j][1] - ends[c, i][0] <= 60.0 for c, i, j, *_ in every)


def test_spans_of_some_pairs(spark):
    """Only the pairs asked for are scored, as in the whole job."""
    from spanloom.operators.folds import checkpointed
    from spanloom.plans.scoring import conversation_features, scores, signals_of, span_rows, with_signals, with_word_weights

    words, features = conversation_features(spark, "/root/testdata/sf0.001")
    known = checkpointed(with_signals(with_word_weights(features, "conv_id").drop("text", "content"), "conv_id", *signals_of(words)))
    every = {tuple(r) for r in scores(span_rows(known, "conv_id", 60.0, 3.0)).select("conv_id", "i", "j", "score").collect()}
    want = {r for r in every if (r[1] + 2 * r[2]) % 11 == 0}
    pairs = spark.createDataFrame([r[:3] for r in want for _ in range(2)], "conv_id long, i long, j long")
    got = [tuple(r) for r in scores(span_rows(known, "conv_id", 60.0, 3.0, pairs)).select("conv_id", "i", "j", "score").collect()]
    assert got and len(got) == len(want) and set(got) == want
