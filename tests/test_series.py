"""Tracks, beats, sweeps, captions, scores and streams against plain loops and hand-made cases."""

import itertools
import math
import random

import pytest

from spanloom.operators import captions, tracking

SF = "/root/testdata/sf0.001"
BOX = "k long, frame long, box long, cx double, cy double, w double, h double, cut boolean"


# ---- tracker --------------------------------------------------------------------------------------
def tracked(rows):
    """One series, frame by frame, with the rules written out."""
    live, number, out = [], itertools.count(), {}
    for frame, own in itertools.groupby(sorted(rows, key=lambda r: (r[1], r[2] if r[2] is not None else -1)), key=lambda r: r[1]):
        own = list(own)
        if any(r[7] for r in own):
            live = []
        boxes = [r for r in own if r[2] is not None]

        def closeness(track, b):
            x, y, w, h = track["at"]
            wide = min(x + w / 2, b[3] + b[5] / 2) - max(x - w / 2, b[3] - b[5] / 2)
            high = min(y + h / 2, b[4] + b[6] / 2) - max(y - h / 2, b[4] - b[6] / 2)
            both = max(0, wide) * max(0, high)
            return both / (w * h + b[5] * b[6] - both) if both else 0.0, math.hypot(x - b[3], y - b[4])

        options = [(c[0] - c[1], t, i) for t, track in enumerate(live) for i, b in enumerate(boxes) for c in [closeness(track, b)] if c[0] >= 0.25 or c[1] <= 0.12]
        taken = {}
        while options:
            best = max(options)
            taken[best[2]] = best[1]
            options = [o for o in options if o[1] != best[1] and o[2] != best[2]]
        for t, track in enumerate(live):
            track["missed"] = 0 if t in taken.values() else track["missed"] + 1
        fresh = []
        for i, b in enumerate(boxes):
            track = live[taken[i]] if i in taken else {"id": next(number), "missed": 0}
            if i not in taken:
                fresh.append(track)
            track["at"] = b[3:7]
            out[b[0], frame, b[2]] = track["id"]
        live = [t for t in live if t["missed"] <= 4] + fresh
    return out


def random_boxes(seed):
    rng = random.Random(seed)
    rows = []
    for k in range(3):
        for frame in range(60):
            boxes = [(rng.choice([0.2, 0.5, 0.8]) + rng.uniform(-0.08, 0.08), 0.5 + rng.uniform(-0.05, 0.05)) for _ in range(rng.choice([0, 0, 1, 2, 3]))]
            rows += [(k, frame, b, x, y, 0.1, 0.12, frame % 17 == 16) for b, (x, y) in enumerate(boxes)] or [(k, frame, None, None, None, None, None, frame % 17 == 16)]
    return rows


def test_tracker_equals_frame_by_frame(spark):
    rows = random_boxes(1)
    want = {}
    for k in range(3):
        want |= tracked([r for r in rows if r[0] == k])
    got = {(r.k, r.frame, r.box): r.track for r in tracking.tracks(spark.createDataFrame(rows, BOX), "k", "long").collect()}
    assert got == want and len(set(want.values())) > 5


def test_tracks_of_a_stream_equal_the_batch(spark, tmp_path):
    from spanloom.streaming.events import in_rounds

    frame = spark.createDataFrame(random_boxes(2), BOX)
    blocks = [frame.where(f"frame BETWEEN {a} AND {a + 19}") for a in (0, 20, 40)]
    got = in_rounds(blocks, lambda s: tracking.tracks_of_stream(s, "k", "long"), "tracks").select("k", "frame", "box", "track")
    want = tracking.tracks(frame, "k", "long")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_tracks_end_after_five_misses(spark):
    frames = [(1, f, 0 if f in (0, 5, 11) else None, *((0.5, 0.5, 0.1, 0.1) if f in (0, 5, 11) else (None,) * 4), None) for f in range(12)]
    got = {r.frame: r.track for r in tracking.tracks(spark.createDataFrame(frames, BOX), "k", "long").collect()}
    assert got == {0: 0, 5: 0, 11: 1}


def followed(samples, hold, window):
    """Samples (t, speaking, [(track, width, activity)]) of one shot, one after the other."""
    sizes = {}
    for _, _, faces in samples:
        for k, w, _ in faces:
            sizes.setdefault(k, []).append(w)
    if not sizes:
        return [None] * len(samples)
    current = max(sizes, key=lambda k: sum(sizes[k]))
    rival, since, past, out = None, 0.0, {k: [] for k in sizes}, []
    for t, speaking, faces in samples:
        now = {k: a for k, _, a in faces}
        for k, values in past.items():
            values.append(now.get(k, 0.0) if speaking else 0.0)
        score = {k: sum(past[k][-window:]) / len(past[k][-window:]) for k in now}
        if now and current not in now:
            width = {k: w for k, w, _ in faces}
            current, rival = max(now, key=lambda k: (score[k], width[k])), None
        elif now and speaking:
            best = max(score, key=score.get)
            if best != current and score[best] > 1.5 * score[current] + 0.004:
                if rival != best:
                    rival, since = best, t
                elif t - since >= hold * 0.6:
                    current, rival = best, None
            else:
                rival = None
        out.append(current if now else None)
    return out


def test_speakers_change_with_hysteresis(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for shot in range(6):
        samples = []
        for i in range(80):
            loud = (i // 20) % 3
            faces = [(k, rng.choice([0.1, 0.2, 0.3]), rng.uniform(0.2, 0.4) if k == loud else rng.uniform(0, 0.1)) for k in range(3) if rng.random() < (0.9 if shot else 0.0)]
            samples.append((i * 0.25, rng.random() < 0.8, faces))
            rows += [(shot, i, i * 0.25, n, *f, samples[-1][1]) for n, f in enumerate(faces)] or [(shot, i, i * 0.25, 0, None, None, None, samples[-1][1])]
        want |= {(shot, i): k for i, k in enumerate(followed(samples, 1.5, 4))}
    frame = spark.createDataFrame(rows, "shot long, i long, t double, place int, track long, width double, activity double, speaking boolean")
    got = {(r.shot, r.i): r.track for r in tracking.speakers(frame, ["shot"], "shot bigint", 1.5, 4).collect()}
    assert got == want and len({k for (s, _), k in want.items() if s == 1}) > 2


# ---- beats ----------------------------------------------------------------------------------------
def test_beats_find_a_planted_period(spark):
    rows = [(1, i, 5.0 if i % 10 == 3 else (0.3 if i % 3 == 0 else 0.0)) for i in range(400)] + [(2, 0, 1.0), (2, 1, 2.0)]
    strength = tracking.onset_strength(spark.createDataFrame(rows, "k long, i long, x double"), "k")
    tempos = tracking.tempo(strength, "k", 20.0)
    assert {r.k: r.bpm for r in tempos.collect()} == {1: 120.0, 2: 120.0}
    found = sorted(r.i for r in tracking.beats(strength, tempos, "k", "long", 20.0).where("k = 1").collect())
    assert len(found) > 30 and all(b - a == 10 for a, b in zip(found, found[1:])) and found[-1] % 10 == 3


def test_beats_equal_plain_dynamic_programming(spark):
    rng = random.Random(6)
    series = {k: [rng.random() for _ in range(n)] for k, n in ((1, 150), (2, 40), (3, 9))}
    rows = spark.createDataFrame([(k, i, e) for k, s in series.items() for i, e in enumerate(s)], "k long, i long, e double")
    tempos = spark.createDataFrame([(1, 150, 97.0), (2, 40, 133.0), (3, 9, 120.0)], "k long, n long, bpm double")
    want = set()
    for k, bpm in ((1, 97.0), (2, 133.0), (3, 120.0)):
        e, period = series[k], 60 * 8.0 / bpm
        near, far, score, link = round(period / 2), round(period * 2), list(e), [-1] * len(e)
        for i in range(far, len(e)):
            options = [(score[p] - 100 * math.log((i - p) / period) ** 2, -p) for p in range(i - far, i - near + 1)]
            best = max(options)
            score[i], link[i] = e[i] + best[0], -best[1]
        tail = max(0, len(e) - int(period))
        i = max(range(tail, len(e)), key=lambda j: (score[j], -j))
        while i >= 0:
            want.add((k, i))
            i = link[i]
    got = {(r.k, r.i) for r in tracking.beats(rows, tempos, "k", "long", 8.0).collect()}
    assert got == want


# ---- sweeps and hashes ----------------------------------------------------------------------------
def test_zoom_edges(spark):
    zooms = spark.createDataFrame([(1, 0.0, 10.0, 2.0, 2.0, 4.0), (1, 4.0, 6.0, 3.0, 0.0, 0.0), (1, 20.0, 21.0, 2.0, 5.0, 5.0)], "k long, s double, e double, scale double, ease_in double, ease_out double")
    times = spark.createDataFrame([(1, i, t) for i, t in enumerate([-1.0, 0.0, 1.0, 2.0, 4.0, 6.0, 6.1, 8.0, 10.0, 10.1, 20.5])], "k long, id long, t double")
    got = {r.t: round(r.zoom, 9) for r in tracking.zoom_product(times, zooms, "k", 5.0).collect()}

    def ease(u):
        return 4 * u**3 if u < 0.5 else 1 - (-2 * u + 2) ** 3 / 2

    assert got == {-1.0: 1.0, 0.0: 1.0, 1.0: 1.5, 2.0: 2.0, 4.0: 6.0, 6.0: 6.0, 6.1: round(1 + ease(3.9 / 4), 9), 8.0: 1.5, 10.0: 1.0, 10.1: 1.0, 20.5: round(1 + ease(0.1), 9)}


@pytest.mark.parametrize("blocks", [4, 11])
def test_near_hashes_equal_all_pairs(spark, blocks):
    rng = random.Random(blocks)
    base = [rng.getrandbits(63) for _ in range(12)]

    def near():
        x = rng.choice(base)
        for b in rng.sample(range(63), rng.randint(0, 14)):
            x ^= 1 << b
        return x

    left, right = [(i, near()) for i in range(40)], [(i, near()) for i in range(40)]
    got = tracking.near_hashes(spark.createDataFrame(left, "a long, f long"), spark.createDataFrame(right, "b long, g long"), blocks=blocks).select("a", "b").collect()
    want = [(a, b) for a, f in left for b, g in right if (f ^ g).bit_count() <= 10]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 20


# ---- captions -------------------------------------------------------------------------------------
def paged(words, rules):
    """Pages by a plain list of lists, then short ones merged, as the rules say."""
    fits = lambda ws: rules.breaks([rules.width_of(w[2].strip()) for w in ws]) is not None
    pages = []
    for w in words:
        last = pages[-1] if pages else None
        text = last[-1][2].strip() if last else ""
        if last and not (len(last) >= rules.words or text[-1] in ".!?…" or (text[-1] in ",;:" and len(last) > 1) or w[3] - last[-1][4] > rules.pause or w[4] - last[0][3] > rules.seconds or not fits([*last, w])):
            last.append(w)
        else:
            pages.append([w])
    out, i = [], 0
    while i < len(pages):
        page = pages[i]
        until = pages[i + 1][0][3] if i + 1 < len(pages) else page[-1][4] + rules.linger
        if until - page[0][3] < rules.flash and i + 1 < len(pages) and fits(page + pages[i + 1]):
            pages[i + 1] = page + pages[i + 1]
        elif until - page[0][3] < rules.flash and out and fits(out[-1] + page):
            out[-1] = out[-1] + page
        else:
            out.append(page)
        i += 1
    return [(p[0][1], p[-1][1]) for p in out]


def test_caption_pages(spark):
    rng = random.Random(9)
    rows = []
    for k in range(4):
        t = 0.0
        for i in range(150):
            t += rng.choice([0.0, 0.0, 0.02, 0.1, 0.7])
            long = rng.choice([0.05, 0.1, 0.3, 0.6])
            rows.append((k, i, "".join(rng.choice("abcdefilmwM") for _ in range(rng.randint(1, 12))) + rng.choice(["", "", "", ".", ",", "?"]), round(t, 3), round(t + long, 3)))
            t += long
    rules = captions.PageRules(lines=3, width=9.0)
    frame = spark.createDataFrame(rows, "k long, idx long, text string, start double, end double")
    found = captions.caption_pages(frame, "k", "long", rules).collect()
    for k in range(4):
        own = sorted((r for r in found if r.k == k), key=lambda r: r.page)
        assert [(r.first_word, r.last_word) for r in own] == paged([r for r in rows if r[0] == k], rules)
    assert any(r.breaks is None for r in found) and any(r.breaks and len(r.breaks) == 2 for r in found)


def test_line_breaks_are_the_best_of_all_splits():
    rng = random.Random(3)
    rules = captions.PageRules(lines=3, width=10.0)
    for _ in range(300):
        widths = [rng.uniform(0.5, 6) for _ in range(rng.randint(1, 7))]
        best = None
        for n in range(3):
            fit = [(max(rules.line(widths[a:b]) for a, b in zip([0, *c], [*c, len(widths)])), list(c)) for c in itertools.combinations(range(1, len(widths)), n)]
            fit = [f for f in fit if f[0] <= rules.width]
            if fit:
                best = min(fit)[1]
                break
        assert rules.breaks(widths) == best


# ---- scores ---------------------------------------------------------------------------------------
def test_fallback_and_mode(spark):
    from spanloom.plans.scoring import is_action, with_fallback

    rows = spark.createDataFrame([(1, 0, 0, 0.0, 4.0), (1, 0, 1, 0.0, 9.0), (1, 1, 1, 5.0, 9.0), (2, 0, 3, 0.0, 20.0)], "k long, i long, j long, a double, b double")
    assert sorted((r.k, r.i, r.j) for r in with_fallback(rows, "k", 15.0).collect()) == [(1, 0, 1), (2, 0, 3)]
    features = spark.createDataFrame([(1, 5.0)] * 3 + [(2, 9.0)] * 2 + [(3, 1.0)] * 5, "k long, spoken double")
    length = spark.createDataFrame([(1, 30.0), (2, 20.0), (3, 60.0), (4, 5.0)], "k long, duration double")
    assert {r.k: r.action for r in is_action(features, length, "k").collect()} == {1: False, 2: True, 3: True, 4: True}


def test_running_totals_at_places(spark):
    from pyspark.sql import functions as F
    from spanloom.plans.scoring import at_place, running_totals

    series = spark.createDataFrame([(1, n, float(n)) for n in range(5)], "k long, n long, v double")
    rows = spark.createDataFrame([(1, p) for p in (0, 1, 3, 5, 99)] + [(2, 1)], "k long, p long")
    got = {(r.k, r.p): r.v_x for r in at_place(rows, running_totals(series, "k", {"v": F.col("v")}), "k", F.col("p"), "_x").collect()}
    assert got == {(1, 0): 0.0, (1, 1): 0.0, (1, 3): 3.0, (1, 5): 10.0, (1, 99): 10.0, (2, 1): 0.0}


# ---- streams --------------------------------------------------------------------------------------
def test_a_stream_goes_on_from_its_folder_and_drops_late_rows(spark, tmp_path):
    from pyspark.sql import functions as F
    from spanloom.streaming.events import drained

    schema = "k long, ts timestamp"

    def arrive(times):
        spark.sql("SELECT " + " UNION ALL SELECT ".join(f"1L AS k, timestamp'2024-01-01 {t}' AS ts" for t in times)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").withWatermark("ts", "1 hour")
        hours = stream.groupBy("k", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
        rows = drained(hours.select("k", F.hour("w.start").alias("hour"), "n"), "late", folder=f"file://{tmp_path}/run").collect()
        return sorted((r.hour, r.n) for r in rows)

    assert arrive(["00:10:00", "00:50:00", "01:10:00"]) == []
    assert arrive(["00:20:00", "03:30:00"]) == [(0, 3), (1, 1)]  # behind the latest time, not yet behind the watermark
    assert arrive(["00:30:00", "05:00:00"]) == [(0, 3), (1, 1), (3, 1)]  # the first is late and dropped


# ---- records --------------------------------------------------------------------------------------
def test_null_flags_and_repeated_parents(spark):
    from pyspark.sql import functions as F
    from spanloom.operators.records import without_parent

    children = spark.createDataFrame([(1, 7, True), (2, 7, False), (3, 7, None), (4, 8, True)], "id long, parent long, own boolean")
    gone = spark.createDataFrame([(7,), (7,)], "parent long")
    got = {r.id: r.parent for r in without_parent(children, gone, "parent", F.col("own")).collect()}
    assert got == {2: None, 3: None, 4: 8} and without_parent(children, gone, "parent", F.col("own")).count() == 3


def test_millis_round_like_sql(spark):
    """The first value is a half in decimal only: its product with 1,000 lies below one."""
    import duckdb
    from pyspark.sql import functions as F
    from spanloom.operators.intervals import to_millis

    values = [0.5005, 2.0015, -1.0005, 0.0, 824930.1985, 2128031.2375, 51543.3415]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 3)", [v]).fetchone()[0] for v in values]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(99, None)], "i int, v double").orderBy("i")
    assert [r[0] for r in rows.select(to_millis(F.col("v"))).collect()] == [*want, None]
    assert want[0] < 0.5005 < spark.range(1).select(F.round(F.lit(0.5005), 3)).first()[0]


def test_late_row_joins_an_ended_session(spark):
    """A row behind the mark counts while its own session would be open, and then joins a session that had ended before the mark."""
    import datetime

    from spanloom.streaming.events import sessions

    at = lambda text: datetime.datetime.fromisoformat(f"2024-01-{text}+00:00")
    block = lambda *rows: spark.createDataFrame([(k, at(t)) for k, t in rows], "k long, ts timestamp")
    blocks = [block((1, "01T10:30"), (2, "01T23:00")), block((1, "01T16:20"), (1, "01T15:00"), (2, "03T12:00")), block((2, "05T12:00"), (2, "05T19:30"))]
    got = {(r.k, r.a, r.b, r.n) for r in sessions(blocks, "k", 6, 1).selectExpr("k", "date_format(start, 'dd HH:mm') AS a", "date_format(end, 'dd HH:mm') AS b", "n").collect()}
    assert got == {(1, "01 10:30", "01 22:20", 2), (2, "01 23:00", "02 05:00", 1), (2, "03 12:00", "03 18:00", 1), (2, "05 12:00", "05 18:00", 1)}
    assert sessions([b.limit(0) for b in blocks], "k", 6, 1).collect() == []


def test_fingerprints_repeat_the_fewer_side(spark, monkeypatch):
    """Shifts repeat the sequences that are compared with, not all prints, whose rows were seven times as many."""
    from spanloom.operators import tracking

    sides = []
    met = tracking.near_hashes
    monkeypatch.setattr(tracking, "near_hashes", lambda left, right, **more: sides.append((left.count(), right.count())) or met(left, right, **more))
    rows = [(u, i, (u % 5) * 1_000_003 + i * 7919) for u in range(40) for i in range(6)]
    prints = spark.createDataFrame(rows, "id long, i int, f long")
    got = {(r.id, r.other): r.similarity for r in tracking.fingerprint_cross(prints, prints.where("id < 3")).collect()}
    assert sides == [(240, 126)]
    near = lambda a, b: bin(a ^ b).count("1") <= 10
    f = {(u, i): v for u, i, v in rows}
    for a in range(40):
        for b in range(3):
            best = max(sum(near(f[a, i], f[b, i + s]) for i in range(6) if 0 <= i + s < 6) / (6 - abs(s)) for s in range(-3, 4))
            assert (a == b or not best) == ((a, b) not in got) and got.get((a, b), best) == best


def test_speaker_tracks_are_followed_once(spark, tmp_path):
    """The tracks of all series are one pass over the lines, though their rows are used twice."""
    from spanloom.operators import tracking

    lines = spark.createDataFrame([(k, k % 3, k % 7, float(k % 50), 0.01 * (k % 10), k) for k in range(300)], "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, day int")
    lines.selectExpr("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "date_add(DATE '1992-01-02', day * 3) AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = tracking.speaker_series(spark, str(tmp_path))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= 2  # the last fold; its plan may be shown as first and as final
    assert found.count() > 0 and "lineitem" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_throttle_keys_share_a_bucket(spark, monkeypatch):
    """Keys of one bucket keep their own times over batches; null keys and times take no part."""
    from datetime import datetime, timedelta

    from spanloom.streaming import events

    monkeypatch.setattr(events, "BUCKETS", 1)
    begin = datetime(2024, 1, 1)
    rows = [(k, k % 5 if k % 11 else None, begin + timedelta(minutes=37 * k) if k % 13 else None) for k in range(200)]
    frame = lambda part: spark.createDataFrame(part, "event_id long, user_id long, ts timestamp")
    found = events.in_rounds([frame(rows[:90]), frame(rows[90:])], lambda s: events.throttled(s, "user_id", "bigint", 14_400), "throttle-test")
    want, last = set(), {}
    for event, user, ts in rows:
        if user is not None and ts is not None and (user not in last or ts - last[user] >= timedelta(hours=4)):
            want.add((user, event))
            last[user] = ts
    assert sorted((r.user_id, r.event_id) for r in found.collect()) == sorted(want)


def test_hours_of_batches_carry_only_what_is_open(spark, tmp_path):
    """Late rows, rows at the mark, an empty block and nulls against a plain loop; closed hours are not carried and no state is kept beside them."""
    import os
    from datetime import datetime, timedelta

    from spanloom.streaming import events

    begin, hour = datetime(2024, 1, 1), timedelta(hours=1)
    rows = [(k, k % 3 if k % 17 else None, begin + timedelta(minutes=23 * k) if k % 19 else None) for k in range(400)]
    parts = [rows[:150], [], rows[150:260] + [(900, 1, begin + timedelta(minutes=23 * 149)), (901, 1, begin)], rows[260:]]  # 900 is late but open, 901 is behind the mark
    mark = max(r[2] for r in parts[0] if r[2]) - hour
    edge = mark.replace(minute=0, second=0) - timedelta(microseconds=1)  # the last time of an hour that the mark has passed
    parts[2].append((902, 2, edge))
    blocks = [spark.createDataFrame(part, "event_id long, user_id long, ts timestamp") for part in parts]
    found = events.in_rounds(blocks, lambda s: s, "hours", folder=f"file://{tmp_path}/run", each=events.hours_of_batch)

    state, latest = {}, None
    for part in parts:
        before = latest
        for event, user, ts in part:
            if ts is not None and (before is None or ts.replace(minute=0, second=0, microsecond=0) + 2 * hour > before):
                own = state.setdefault((user, ts.replace(minute=0, second=0, microsecond=0)), [(ts, event), 0])
                own[0], own[1] = max(own[0], (ts, event)), own[1] + 1
        latest = max([r[2] for r in part if r[2]] + ([latest] if latest else []))
    want = {(user, h, last[1], n) for (user, h), (last, n) in state.items() if h + 2 * hour <= latest}
    got = [(r.user_id, r.hour, r.last.event_id, r.n) for r in found.where("NOT open").collect()]
    assert len(got) == len(want) and set(got) == want and not any(e in (901, 902) for _, _, e, _ in got)
    carried = {r.batch: r.n for r in found.where("open").groupBy("batch").agg({"*": "count"}).toDF("batch", "n").collect()}
    assert max(carried.values()) <= 9 and not os.path.exists(f"{tmp_path}/run/state/state")


def test_blocks_of_events_hold_the_needed_columns_only(spark, monkeypatch):
    """What goes through the stream of last events of hours is three columns, and the query keeps no window in Spark's state."""
    import os

    from spanloom.streaming import events

    folders, folder = [], events.shared_folder
    monkeypatch.setattr(events, "shared_folder", lambda *a: folders.append(folder(*a)) or folders[-1])
    assert events.stream_progress(spark, "/root/testdata/sf0.001").count()
    at = folders[0].removeprefix("file://")
    assert spark.read.parquet(f"{at}/in").columns == ["user_id", "ts", "event_id"] and not os.path.exists(f"{at}/state/state")
