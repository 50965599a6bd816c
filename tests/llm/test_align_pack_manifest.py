"""Operators 11 to 13 against brute force on whole small tables and on edge cases."""

import collections
import hashlib
import random
import zlib

import public_tokenizers
import pytest

from spanloom.llm import align, manifest, merkle, pack
from spanloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
ODD = [
    "", None, " a", "a  b", " ", "\n", "a \n b", "a\n b\t \tc", "▁x", "a▁b", "<s> hi </s> <|endoftext|>", "é ünï 漢字 𝒳 😀", "don't  we'll x's", "　x　y",
    "a\xa0b", "a\x1c b", "x" * 500, "foo bar foo bar", "A\u0085 b", "tail ", "word\n\nnext word", "\0a b", "ﬁ é q", "foo bar foo bar",
]


def stored(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)


# ---- operator 11 -----------------------------------------------------------------------------------
def aligned_by_hand(texts):
    """Both libraries on whole texts, a two-pointer loop, and counts in a dictionary."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    names, byte = {i: t for t, i in a_side.get_vocab().items()}, align.byte_characters()
    docs, counts = [], collections.Counter()
    for text in texts:
        raw = (" " + (text or "")).encode()
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        spelled_a = [bytes(byte[c] for c in names[i]) for i in a]
        spelled_b = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(spelled_a) != raw or b"".join(spelled_b) != raw:
            docs.append(None)
            continue
        i = j = 0
        end_a, end_b, links, groups, left, right = len(spelled_a[0]), len(spelled_b[0]), [], [], [a[0]], [b[0]]
        while True:
            links.append((a[i], b[j]))
            if end_a == end_b:
                groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
                i, j = i + 1, j + 1
                if i == len(a):
                    break
                end_a, end_b, left, right = end_a + len(spelled_a[i]), end_b + len(spelled_b[j]), [a[i]], [b[j]]
            elif end_a < end_b:
                i += 1
                end_a += len(spelled_a[i])
                left.append(a[i])
            else:
                j += 1
                end_b += len(spelled_b[j])
                right.append(b[j])
        docs.append((len(a), len(b), links, groups))
        counts.update(links)
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    nothing = (0, 0, 0, 0, 0, 0, "")
    return [nothing if d is None else (d[0], d[1], len(d[3]), len(d[2]), sum(counts[x] == top[x[1]] for x in d[2]), sum(counts[x] for x in d[2]), hashlib.sha256(";".join(d[3]).encode()).hexdigest()) for d in docs]


def columns_of(row):
    return (row.n_a, row.n_b, row.n_groups, row.n_links, row.n_best, row.count_sum, row.groups_sha256)


def test_op11_equals_two_pointers_on_odd_texts(spark, tmp_path):
    folder = stored(spark, tmp_path, list(enumerate(ODD)), "doc_id long, text string")
    rows = QUERIES["op11_tokenizer_alignment"](spark, folder).collect()
    want = aligned_by_hand(ODD)
    assert len(rows) == len(ODD) and all(columns_of(r) == want[r.doc_id] for r in rows)
    assert sum(r.n_links == 0 for r in rows) >= 4 and max(r.n_links for r in rows) > 100


def test_op11_whole_table(spark, monkeypatch):
    """Several blocks and a word cache that is emptied give the same as whole texts."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = dict(zip(texts, aligned_by_hand(list(texts.values()))))
    rows = QUERIES["op11_tokenizer_alignment"](spark, SF).collect()
    assert len(rows) == len(texts) and all(columns_of(r) == want[r.doc_id] for r in rows)


def test_op11_cache_is_emptied(monkeypatch):
    monkeypatch.setattr(align, "CACHE_WORDS", 5)
    sides = align.Sides(*align.default_tokenizers())
    texts = [f"some words of text {k} and more of them {k * k}" for k in range(40)]
    for t in texts + texts:
        (a, b), lengths, good = sides.encode([t])
        assert a.tolist() == sides.a.encode(" " + t) and b.tolist() == sides.b.encode(t) and good.all()
    assert len(sides.slots) < 40


# ---- operator 12 -----------------------------------------------------------------------------------
def fewest(items, capacity):
    """Fewest bins by trying everything."""
    best = [len(items)]
    items = sorted(items, reverse=True)

    def place(i, room):
        if len(room) >= best[0]:
            return
        if i == len(items):
            best[0] = len(room)
            return
        for b in {r: k for k, r in enumerate(room) if r >= items[i]}.values():
            room[b] -= items[i]
            place(i + 1, room)
            room[b] += items[i]
        place(i + 1, [*room, capacity - items[i]])

    place(0, [])
    return best[0]


def test_op12_plan_is_optimal_on_small_instances():
    random.seed(5)
    for turn in range(300):
        capacity = random.choice([20, 30, 100])
        items = [random.randint(1, capacity) if turn % 2 else random.randint(capacity // 5, capacity // 2) for _ in range(random.randint(1, 11))]
        counts = [items.count(k) for k in range(capacity + 1)]
        patterns, used = pack.plan(counts, capacity), [0] * (capacity + 1)
        for pattern, times in patterns:
            assert sum(length * k for length, k in pattern) <= capacity and times > 0
            for length, k in pattern:
                used[length] += k * times
        best = fewest(items, capacity)
        assert used == counts and pack.lower_bound(counts, capacity) <= best == sum(t for _, t in patterns)


def test_op12_search_beats_best_fit():
    counts = [0] * 101
    for length, n in ((60, 1), (50, 1), (30, 1), (20, 3)):
        counts[length] = n
    greedy = [(((60, 1), (30, 1)), 1), (((50, 1), (20, 2)), 1), (((20, 1),), 1)]
    assert sum(n for _, n in pack.complete(counts, 100, greedy, pack.lower_bound(counts, 100))) == 2


def test_op12_pieces_are_whole_and_sequences_gapless(spark, tmp_path):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [*ODD, " ".join(f"word{i} tail" for i in range(3000)), "same text", "same text", None]
    ids = [*range(len(texts) - 1), None]
    folder = stored(spark, tmp_path, list(zip(ids, texts)), "doc_id long, text string")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = pack.packed(docs, pack.default_tokenizer(), with_ids=True).cache()
    found = collections.defaultdict(list)
    for r in rows.collect():
        found[r.doc_id].append(r)
    assert set(found) == set(ids)
    for i, text in zip(ids, texts):
        want = [*own.encode(text or "", add_special_tokens=False).ids, 0]
        parts = sorted(found[i], key=lambda r: r.piece)
        assert [t for p in parts for t in p.ids] == want and [p.start for p in parts] == list(range(0, len(want), 2048))
        assert all(p.length == len(p.ids) and (p.length == 2048 or p is parts[-1]) for p in parts)
        assert all(p.ids_crc32 == zlib.crc32(b"".join(t.to_bytes(4, "little") for t in p.ids)) for p in parts)
    by_sequence = collections.defaultdict(list)
    for p in (p for parts in found.values() for p in parts):
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    whole = sum(len(p.ids) for parts in found.values() for p in parts)
    assert len(by_sequence) == -(-whole // 2048)
    made = pack.sequences(rows).collect()
    assert sum(len(s.ids) for s in made) == whole and len(made) == len(by_sequence)


def test_op12_ranks_do_not_meet_in_one_task(spark):
    """Equal lengths in many tasks get consecutive ranks: every slot is used once."""
    docs = spark.createDataFrame([(i, "one two three") for i in range(2000)], "doc_id long, text string").repartition(7)
    rows = pack.packed(docs, pack.default_tokenizer()).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 2000 and len({r.sequence_id for r in rows}) == -(-2000 // (2048 // rows[0].length))


# ---- operator 13 -----------------------------------------------------------------------------------
def hashed(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return hashed(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree_of(leaves):
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, k in enumerate(at):
            s = k ^ 1
            paths[i].append((level[s] if s < min(k, len(level)) else "", level[s] if k < s < len(level) else ""))
            at[i] = k >> 1
        level = [hashed(*level[j : j + 2]) for j in range(0, len(level), 2)]
    return level[0], paths


def manifest_by_hand(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    subs = []
    for lang in sorted(groups, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        subs.append((own, *tree_of([leaf_of(r) for r in own])))
    if not subs:
        return []
    root, upper = tree_of([s[1] for s in subs])
    out = []
    for (own, sub, paths), above in zip(subs, upper):
        for r, path in zip(own, paths):
            changed = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = leaf_of((*r[:3], r[3] + 1, r[4]) if changed else r)
            for left, right in path + above:
                folded = hashed(left, folded, right)
            out.append((r[0], leaf_of(r), sub, root, hashed(*[x for e in path + above for x in e]), folded, folded == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n,parts", [(0, 1), (1, 1), (3, 4), (41, 5), (300, 6)])
def test_op13_equals_brute_force(spark, tmp_path, monkeypatch, n, parts):
    """Nulls, ties, repeated rows, small heights so that several rounds run."""
    monkeypatch.setattr(manifest, "FIRST", 3)
    monkeypatch.setattr(manifest, "ROUND", 2)
    random.seed(n)
    langs = ["x"] if n == 3 else ["en", "en", "en", "de", None, "é"]
    rows = [(random.choice([None, *range(2 * n)]), random.choice(["a", None]), random.choice(langs), random.choice([None, 5, 7]), random.choice(["t", None, ""])) for _ in range(n)]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, digest string").repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_merkle_manifest"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == manifest_by_hand(rows)


def test_op13_one_hot_group_of_equal_rows(spark, tmp_path):
    rows = [(7, "a", "en", 3, "abc")] * 700 + [(k, "a", "en", 3, "abc") for k in range(300)]
    folder = stored(spark, tmp_path, rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = QUERIES["op13_merkle_manifest"](spark, folder).collect()
    assert sorted(map(tuple, got), key=repr) == manifest_by_hand(rows)


def test_op13_equals_sql(spark):
    from compare import duckdb_rows, spark_rows

    names, rows = spark_rows(QUERIES["op13_merkle_manifest"](spark, SF))
    assert (names, rows) == duckdb_rows(manifest.ORACLE, SF)
    tampered = [r for r in rows if not r[names.index("verified")]]
    assert 0 < len(tampered) < len(rows)


def test_partition_facts():
    """Groups that end in a partition, fill several, or begin in one."""
    facts = merkle.partition_facts([(0, "a", 2, "b", 3, False), (1, "b", 4, "b", 4, True), (3, "b", 1, "c", 5, False)])
    assert facts == {0: (0, 2, 8), 1: (3, 8, 8), 3: (7, 8, 5)}
