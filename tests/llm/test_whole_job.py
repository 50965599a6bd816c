"""Cases where an operator once did less than its whole job."""

import hashlib
import os
import zlib
from collections import Counter

import numpy as np
import public_tokenizers

from spanloom.llm.queries import QUERIES


def test_op8_added_tokens(spark, tmp_path):
    """Texts that hold added tokens have the ids that the library gives by default; other cases of a literal are plain text."""
    from tokenizers import Tokenizer

    from spanloom.llm import store

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    texts = [
        "stop <|endoftext|> go", "stop <|ENDOFTEXT|> go", "<|EndOfText|> a<|endoftext|>b <|endoftext|>", "<|startoftext|><|endoftext|>x<|STARTOFTEXT|>", "<|endoftext|", "Stop STOP <|endoftext|>\n<|startoftext|>",
        "<|endoftext|>" * 700, "a<|endoftext|>b. x<|ENDOFTEXT|>c, It is. its. a. b! ab,, é. don't. <|endoftext|>.", "A<|endoftext|>b a<|endoftext|>B",
    ]
    tok = Tokenizer.from_file(path)
    want, start = {}, 0
    for i, t in enumerate(texts):
        ids = [*tok.encode(t, add_special_tokens=False).ids, store.END_ID]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert any(49407 in tok.encode(t, add_special_tokens=False).ids for t in texts)
    store.write_store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), f"{tmp_path}/store", path)
    rows = store.read_digests(spark, f"{tmp_path}/store").collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows} == want and all(r.verified for r in rows)


def trigram_scores(docs, held, least):
    """log10 probability of every document by a plain trigram model of n-grams with at least ``least`` occurrences, in codes of 1/32."""
    count, after = {}, {}
    for ws in ([*ws, None] for i, ws in docs.items() if i not in held):
        for k in (1, 2, 3):
            for i in range(len(ws) - k + 1):
                gram = tuple(ws[i : i + k])
                count[gram] = count.get(gram, 0) + 1
    count = {g: n for g, n in count.items() if len(g) == 1 or n >= least}
    for gram, n in count.items():
        after.setdefault(gram[:-1], []).append(n)
    total, kinds = sum(after[()]), len(after[()])

    def code(p):
        return min(255, round(-np.log10(p) * 32)) / 32

    def freed(before):
        return code(1 - sum(n - 0.75 for n in after[before]) / count[before])

    def log_p(before, word):
        if not before:
            return np.log10((count.get((word,), 0) + 0.1) / (total + 0.1 * (kinds + 1)))
        lower = log_p(before[1:], word)
        if n := count.get((*before, word)):
            return -code((n - 0.75) / count[before] + 10 ** -freed(before) * 10**lower)
        return lower - (freed(before) if before in after else 0)

    return {i: sum(log_p(tuple(full[max(0, j - 2) : j]), w) for j, w in enumerate(full)) for i, full in ((i, [*ws, None]) for i, ws in docs.items())}


def test_op7_brute_force(spark, tmp_path, monkeypatch):
    """The query's score, and that of a model that keeps all n-grams, equal a plain trigram model's; shards of few keys split contexts."""
    from spanloom.llm import lm

    monkeypatch.setattr(lm, "SHARD_KEYS", 23)
    rng, vocabulary = np.random.default_rng(5), [f"w{i}" for i in range(12)]
    docs = {i: [str(w) for w in rng.choice(vocabulary, rng.integers(0, 40))] for i in range(60)}
    docs[60] = ["w1", "never", "w2", "w3", "w1", "w2"]
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 10 == 0}
    assert held and held != set(docs)
    spark.createDataFrame([(i, " ".join(ws)) for i, ws in docs.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for rows, least in ((QUERIES["op7_lm_scoring"](spark, str(tmp_path)).collect(), 2), (lm.score(table, lm.train(table, (1, 1, 1))).collect(), 1)):
        want = trigram_scores(docs, held, least)
        assert {r.doc_id: r.held_out for r in rows} == {i: i in held for i in docs}
        assert all(abs(r.score - want[r.doc_id]) < 1e-6 for r in rows)


def test_op7_pairs_in_buckets(spark, monkeypatch):
    """Pairs are shuffled as one row a bucket and block, not one a pair; the counts are those of plain counting, whatever the blocks."""
    from spanloom.llm import lm

    monkeypatch.setattr(lm, "PART_TOKENS", 400)
    monkeypatch.setattr(lm, "BLOCK_PAIRS", 300)
    monkeypatch.setattr(lm, "PIECE_BYTES", 500)
    rng = np.random.default_rng(8)
    docs = [(i, [f"w{w}" for w in rng.zipf(1.5, 50) % 90]) for i in range(80)]
    table = spark.createDataFrame([(i, " ".join(ws)) for i, ws in docs], "doc_id long, text string")
    plain = Counter((a, b) for i, ws in docs if zlib.crc32(str(i).encode()) % 10 for a, b in zip(ws, [*ws[1:], None]))
    model = lm.train(table, (1,))
    found = [r.n for r in lm.count_pairs(table, model, 2, 1).collect()]
    assert sorted(found) == sorted(plain.values())
    batch = lm.dealt([(np.arange(1000), np.arange(1000) % 7, np.zeros(1000, np.int64), np.ones(1000, np.int64))], 16)
    assert batch.num_rows == 16 and sum(len(x.as_py()) for x in batch.column("parent")) == 8000


def test_op7_memory_of_a_task():
    """What a task holds while it deals out a block of pairs or builds the longest shard, whatever the input."""
    import tracemalloc

    from spanloom.llm import lm

    def peak(run) -> float:
        tracemalloc.start()
        run()
        most = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        return most

    rng = np.random.default_rng(3)
    n = lm.BLOCK_PAIRS
    pairs = [(np.arange(n), rng.integers(0, 10**6, n), np.zeros(n, np.int16), np.ones(n, np.int64))]
    assert peak(lambda: lm.dealt(pairs, 552)) < 70 and not pairs
    keys = np.cumsum(rng.integers(0, 10**6, lm.SHARD_KEYS * 5 // 4))
    assert peak(lambda: lm.EliasFano.build(keys)) < 70


def test_op7_pairs_beyond_64_bits():
    from spanloom.llm.lm import unique_pairs

    a, b = np.array([2**40, 5, 2**40, 5]), np.array([2**40, 7, 2**40, 2**41])
    at, back = unique_pairs(a, b)
    assert [(int(a[i]), int(b[i])) for i in at] == [(5, 7), (5, 2**41), (2**40, 2**40)] and back.tolist() == [2, 0, 2, 1]


def test_word_hashes_do_not_collide_by_form():
    """The Thue-Morse word over two letters and its complement have one polynomial hash modulo 2 ** 64; here they differ."""
    from spanloom.llm.common import Words

    bits = [bin(i).count("1") % 2 for i in range(4096)]
    a, b = (bytes(97 + (x ^ flip) for x in bits) for flip in (0, 1))
    assert len(set(Words([a, b, a]).hash.tolist())) == 2 and len(set(Words([a[:20], a[:40], b[:40]]).hash.tolist())) == 3


def test_op6_all_offsets(spark, tmp_path, monkeypatch):
    """The media column is written to the shared folder, and every frame's offset is in the feature."""
    from spanloom.llm import common, media

    texts = {1: "", 2: "short", 3: "twenty thousand words " * 5000}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"{tmp_path}/shared")
    rows = QUERIES["op6_media_columns"](spark, str(tmp_path)).collect()
    assert [n for n in os.listdir(f"{tmp_path}/shared") if n.startswith("media-")]
    for r in rows:
        raw = texts[r.doc_id].encode()
        stream = media.write_stream(raw + bytes(-len(raw) % 64 or (0 if raw else 64)))
        at, offsets = 10 + int.from_bytes(stream[9:10], "big") + 144, []  # behind the tag and the frame of the table, at 32 kbit/s
        while at < len(stream):
            offsets.append(at)
            at += 144 * (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)[stream[at + 2] >> 4] // 32
        assert r.feature.endswith(";seek=" + "/".join(map(str, offsets))) and f"frames={len(offsets)};" in r.feature
    assert max(r.feature.count("/") for r in rows) > 70


def byte_pair_encoding():
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    ranks = load_tiktoken_bpe(str(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pipeline_near_duplicates(spark):
    """One document of each class of near duplicates stays, unchanged; texts without words are a class each."""
    import corpus_pipeline

    base = [f"word{i}" for i in range(60)]
    texts = [" ".join(base), " ".join(base), " ".join([*base, "more"]), "other text of its own here", " ".join(reversed(base)), "few"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for w in map(str.split, texts)]
    classes = [{j for j, b in enumerate(sets) if len(a & b) >= 0.8 * len(a | b)} for a in sets]
    rows = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    kept = {r.doc_id for r in rows}
    assert all(len(kept & c) == 1 for c in classes) and all(r.text == texts[r.doc_id] for r in rows)


def test_pipeline_token_ids(spark):
    """The last stage gives every document's token ids, and their digests beside them."""
    import corpus_pipeline

    texts, tok = ["", "one text of some words", "é😀 ünï  1234567\n\n x", "twice twice"], byte_pair_encoding()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = corpus_pipeline.encode_tokens(spark, docs, "").collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = tok.encode_ordinary(texts[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_op9_long_words(spark):
    """Words just below and above the size where the heap takes over, in one-, two- and three-byte characters."""
    from spanloom.llm import bpe

    limit, tok = bpe.LONG_WORD, byte_pair_encoding()
    rng = np.random.default_rng(3)
    letters = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGH"), 3 * limit))
    texts = [letters[:n] for n in range(limit - 2, limit + 4)] + ["é" * (limit // 2 + d) for d in (-1, 0, 1)] + ["語言" * (limit // 6 + d) for d in (-1, 0, 1, 200)] + ["=" * n for n in (limit - 1, limit, limit + 1)]
    texts += [f"a {letters} b", f"{letters}\n{letters[:limit]}"]
    coded = bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bpe.default_ranks(), bpe.default_pattern())
    rows = coded.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == tok.encode_ordinary(texts[r.doc_id]) and bytes(r.decoded) == texts[r.doc_id].encode()
    assert {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(coded, bpe.default_ranks(), bpe.default_pattern()).collect()} == dict(enumerate(texts))


def test_op2_added_spans(spark):
    """Spelled-out addresses and numbers in the form of called ones are added and redacted; like digit runs of other forms are not."""
    from spanloom.llm import pii

    rng = np.random.default_rng(8)
    number = lambda: "0{} {} {}".format(*rng.integers([100, 100, 1000], [999, 999, 9999]))
    texts = [f"please call {number()} today" for _ in range(60)] + [f"write to name{i} [at] mail{i % 7} [dot] example for more" for i in range(60)]
    texts += [f"order {rng.integers(10**6, 10**7)}-{rng.integers(10, 99)} was sent" for _ in range(120)] + [f"we have {number()} and no more"]
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, pii_base string")
    scorer = pii.fit(docs)
    rows = {r.doc_id: r for r in pii.find_pii(docs.drop("pii_base"), scorer).collect()}
    assert all(not r.pii_base for r in rows.values())
    assert all([s.kind for s in rows[i].pii_added] == [0] for i in range(60, 120))
    assert all([s.kind for s in rows[i].pii_added] == [3] for i in [*range(60), 240])
    assert not any(rows[i].pii_added for i in range(120, 240))
    clean = {r.doc_id: r for r in pii.redacted(docs, scorer).collect()}
    assert clean[0].text == "please call <phone> today" and clean[60].text == "write to <email> for more" and clean[130].text == texts[130] and clean[0].pii_base == "mine"


def test_op2_long_domains_and_many_matches(spark):
    from spanloom.llm import pii
    from pyspark.sql import functions as F

    texts = ["x@" + "a." * 20000 + "b", "a@b.cc " * 30000, "1.2.3.4 " * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select(pii.base_spans(F.col("text")).alias("s")).collect()
    assert [(s.kind, s.start, s.end) for s in rows[0].s] == [(0, 0, len(texts[0]))]
    assert [(s.kind, s.start, s.end) for s in rows[1].s] == [(0, 7 * i, 7 * i + 6) for i in range(30000)]
    assert [(s.kind, s.start, s.end) for s in rows[2].s] == [(1, 8 * i, 8 * i + 7) for i in range(3000)]


def test_op1_many_repositories_of_one_owner(spark):
    """A value that one owner holds in many repositories is copied; in one repository it is live, and its mixed token is reported."""
    from pyspark.sql import functions as F
    from spanloom.llm import secrets

    token = lambda k: f"Ab3_{k}xYz90_QwErTy12345{k}Mn"
    rows = [(i, f"see {token('c')} here", f"r{i}", "o") for i in range(5)] + [(9, f"see {token('l')} here", "r0", "o")]
    found, counts = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, repo string, own string"), F.col("repo"), F.col("own"))
    got = {r.doc_id: [s.verdict for s in r.spans] for r in found.collect()}
    assert got == {**{i: [] for i in range(5)}, 9: ["live"]}
    assert sorted((r.repositories, r.owners, r.verdict) for r in counts.collect()) == [(1, 1, "live"), (5, 1, "copied")]


def test_op10_shards_are_disjoint_and_whole(spark):
    """Every copy has one shard, shard sizes follow the tree's quotas, and columns named like the operator's own are kept."""
    from spanloom.llm import mixing

    rows = [(i, "abc"[i % 3 if i % 7 else 0], "w " * (1 + i % 5), "mine", i) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, mix_size string, plan long")
    taken = {r.doc_id: r for r in mixing.mix(docs, shards=4).collect()}
    assert len(taken) == 4000 and all(len(r.mix_shards) == r.mix_copies and set(r.mix_shards) <= {0, 1, 2, 3} for r in taken.values())
    mixed = mixing.mixed_documents(docs, shards=4).collect()
    assert sorted(r.doc_id for r in mixed) == sorted(i for i, r in taken.items() for _ in range(r.mix_copies))
    assert {r.mix_size for r in mixed} == {"mine"} and all(r.plan == r.doc_id for r in mixed)
    sizes = [sum(r.mix_shards.count(k) for r in taken.values()) for k in range(4)]
    assert min(sizes) > 0.8 * max(sizes)


def check_digit(digits):
    """Digits with the one behind them that passes the mod-10 check."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
    return [*digits, -total % 10]


def test_op2_precision_and_recall_of_added_spans(spark):
    """Look-alikes of all four kinds: what is added is right in 97 of 100 cases, on texts that the trees were not fitted on too."""
    from spanloom.llm import pii

    rng = np.random.default_rng(3)
    texts, wanted = [], []

    def put(text, kind):
        texts.append(text)
        wanted.append(kind)

    for i in range(300):
        digits = "".join(map(str, check_digit(rng.integers(0, 10, 15).tolist())))
        put(f"my card {digits[:4]}.{digits[4:8]}.{digits[8:12]}.{digits[12:]} please", 2)
        put("host {}[.]{}[.]{}[.]{} is down".format(*rng.integers(1, 255, 4)), 1)
        put(f"mail user{i} (at) host{i % 13} (dot) example now", 0)
        put("tel 0{} {} {} after nine".format(*rng.integers([100, 100, 1000], [999, 999, 9999])), 3)
        wrong = digits[:-1] + str((int(digits[-1]) + 5) % 10)
        put(f"serial {wrong[:4]}/{wrong[4:8]}/{wrong[8:12]}/{wrong[12:]} of the pump", None)
        put("rule {}[.]{}[.]{}[.]{} of the text".format(*rng.integers(300, 999, 4)), None)
        put("parts {}-{} and more".format(*rng.integers([10**6, 10], [10**7, 99])), None)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scorer = pii.fit(docs)
    got = {r.doc_id: [s.kind for s in r.pii_added] for r in pii.find_pii(docs, scorer).collect()}
    assert not any(r.pii_base for r in pii.find_pii(docs, scorer).where("size(pii_base) > 0 AND doc_id % 7 <> 0").collect())
    for kind in range(4):
        right = sum(got[i] == [kind] for i, w in enumerate(wanted) if w == kind)
        added = sum(k == kind for i, w in enumerate(wanted) for k in got[i])
        assert right >= 0.9 * 300 and right >= 0.97 * added, (kind, right, added)


def test_op5_rows_a_bundle():
    """However many leaves a query visits in a bundle, it gives k rows there, those of brute force; ties go to smaller ids, and copies in other trees count once."""
    import pyarrow as pa

    from spanloom.llm import ann

    rng = np.random.default_rng(1)
    x = np.concatenate((rng.normal(size=(900, 8)), np.tile(rng.normal(size=8), (100, 1))))
    rows = sorted((0, b, leaf, 0, asks, i) for b in range(2) for leaf in range(30) for asks, ids in ((0, [i for i in range(1000) if (i + leaf) % 15 < 2]), (1, range(0, 1000, 20))) for i in ids)
    names = ["query_block", "bundle", "leaf", "block", "asks", "id"]
    columns = [pa.array(c, pa.int64()) for c in zip(*rows)] + [pa.array([x[r[-1]].tolist() for r in rows], pa.list_(pa.float64()))]
    whole = pa.RecordBatch.from_arrays(columns, [*names, "vector"])
    got = [tuple(r.values()) for b in ann.reranked((whole.slice(a, 701) for a in range(0, len(rows), 701)), 20) for r in b.to_pylist()]
    assert len(got) == 2 * 50 * 20
    for q in range(0, 1000, 20):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        best = [(q, int(i), s[i]) for i in np.lexsort((np.arange(1000), -s))[:20]]
        assert sorted(g for g in got if g[0] == q) == sorted(2 * best)


def test_workers_drop_what_other_operators_keep():
    """The codec of op9 leaves a reused Python worker as soon as another operator begins there, and stays for its own tasks."""
    import pyarrow as pa

    from spanloom.llm import bpe, common

    batch = pa.RecordBatch.from_pydict({"text": ["a b"]})
    own = bpe.codec(bpe.default_ranks(), bpe.default_pattern())
    owner = ("bpe", bpe.default_ranks(), bpe.default_pattern())
    list(common.slices(iter([batch]), "text", owner=owner))
    assert bpe.codec(bpe.default_ranks(), bpe.default_pattern()) is own
    list(common.slices(iter([batch]), "text"))
    assert not common._KEPT
