"""The operators of the llm subpackage against brute force, round trips and held-out accuracy."""

import bisect
import collections
import hashlib
import os
import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, decontaminate, exchange, lm_score, near_dedup, packing, quality_classifier, quality_rules, sharding, substring_dedup, url_filter
from tessera.llm.common import WordHashes, window_hashes

ALPHA = "ab cd ef gh ij kl mn op qr st uv wx yz".split()


def sentence(rng, n, words=ALPHA):
    return " ".join(rng.choice(words) for _ in range(n))


def corpus(seed=5, n=60):
    """Texts with nulls, empties, one very long one, copies, near copies and shared passages."""
    rng = random.Random(seed)
    many = [f"w{i}" for i in range(400)]
    passage, base = sentence(rng, 60, many), sentence(rng, 150, many)
    out = [None, "", " \n", "one", "Two Words", "!!! ???", "é ü ñ " * 30, sentence(rng, 6000, many)]
    for i in range(n):
        t = sentence(rng, rng.randint(1, 120), many)
        if i % 5 == 0:
            t = f"{t}\n{passage} {t}"
        out.append(t)
    for i in range(14):
        w = base.split()
        for _ in range(i // 3):
            w[rng.randrange(len(w))] = "zz" + str(i)
        out.append(" ".join(w))
    out += [out[20]] * 3 + [out[10].upper() if out[10] else ""]
    return out


def table(spark, texts, extra="source string, n_words long, shard string, kept string, score string, part int"):
    """With columns whose names clash with results."""
    rows = [(i, t, "s", 1, "x", "y", "z", 2) for i, t in enumerate(texts)]
    rows.append(rows[11])  # a repeated row
    return spark.createDataFrame(rows, "doc_id long, text string, " + extra)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, corpus()).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def texts_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_window_hashes_depend_on_the_words_alone():
    cache = WordHashes()
    h = np.array([cache[w] for w in [b"a", b"b", b"c", b"a", b"b", b"c", b"d"]], dtype=np.uint64)
    for k in (1, 2, 3):
        got = window_hashes(h, k)
        assert len(got) == len(h) - k + 1 and got[0] == got[3]
        assert len(set(got.tolist())) == len({tuple(h[i : i + k]) for i in range(len(h) - k + 1)})
    assert len(window_hashes(h, 8)) == 0


def test_classifier_learns(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, 30) if i % 3 else sentence(rng, 30, ["###x", "$$$y", "&&&"]), int(bool(i % 3))) for i in range(300)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (None, "ab")], "doc_id long, text string").withColumn("label", F.lit(5))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_classifier.scored(df, labels).collect()}
    truth = {i: y for i, _, y in rows}
    held = [i for i in truth if got[i]["held_out"]]
    assert held == [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i]["score"] >= 0.3) == truth[i] for i in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values()) and not got[None]["held_out"]
    unlabelled = quality_classifier.scored(df, labels.limit(0)).select("score").distinct().collect()
    assert [r[0] for r in unlabelled] == [0.5]
    assert quality_classifier.scored(df.limit(0), labels).count() == 0


def test_classifier_features():
    """Blocks lose no feature; equal words have one bucket wherever they stand; blank texts have none."""
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcé\u4e2d\U0001f600") for _ in range(rng.randint(1, 300 if i == 50 else 9))) + rng.choice(["", " ", "\n\t"]) for i in range(400))
    every = lambda t: sorted(np.concatenate([*quality_classifier.features(t), np.empty(0, np.int32)]).tolist())
    whole, block = every(text), quality_classifier.BLOCK
    try:
        for quality_classifier.BLOCK in (1, 7, 100):
            assert every(text) == whole
    finally:
        quality_classifier.BLOCK = block
    buckets, n = quality_classifier.counted(text)
    assert np.repeat(buckets, n).tolist() == whole
    words = text.split()
    assert len(whole) == (len(" ".join(words)) + 2 - 2) + len(words) + len(words) - 1
    assert [every(t) for t in (None, "", " \n")] == [[]] * 3
    codes, blanks = quality_classifier.running("ab cd ab  cd\n")
    h = quality_classifier.word_hashes(codes.astype(np.uint64), blanks)
    assert h[0] == h[2] != h[1] == h[3]


def test_classifier_takes_repeats_ties_and_long_texts(spark):
    rows = [(1, "good words here"), (1, "good words here"), (2, "bad###"), (2, "another text"), (3, "w " * 300_000), (4, "x" * 400_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (7, 1), (None, 1)], "doc_id long, quality int")
    got = quality_classifier.scored(df, labels).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    one, two = [r["score"] for r in got if r["doc_id"] == 1]
    assert one == two


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables here")
def test_classifier_on_held_out_labels(spark):
    """What the embeddings know of rows that they haven't learned from; see the README for the figures."""
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    labels = read("labels").select("doc_id", "quality")
    docs = read("documents").select("doc_id", "text").join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = quality_classifier.scored(docs, labels).filter("held_out").join(labels, "doc_id").select("quality", "score").collect()
    good, bad = (np.array([r["score"] for r in rows if r["quality"] == y]) for y in (1, 0))
    assert len(good) > 500 and len(bad) > 100
    assert (good[:, None] > bad[None, :]).mean() > 0.92
    assert (bad < 0.3).mean() > 0.75 and (good >= 0.3).mean() > 0.99


def test_substring_dedup(docs, empty):
    given = texts_of(docs)
    got = substring_dedup.remove_repeats(docs)
    assert got.columns == [*docs.columns, "__n_words", "__n_removed", "__kept_sha256"]
    want = collections.Counter(zip([d for d, _ in given], substring_dedup.brute_force([t for _, t in given]), strict=True))
    rows = got.collect()
    assert collections.Counter((r["doc_id"], (r["__n_words"], r["__n_removed"], r["__kept_sha256"])) for r in rows) == want
    assert sum(r["__n_removed"] for r in rows) > 500
    for r in rows:
        if r["text"] is not None:
            assert hashlib.sha256(" ".join(r["text"].split(None)).encode()).hexdigest() == r["__kept_sha256"] or not r["__n_removed"]
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_cover_meets_every_shift():
    p, c = substring_dedup.PERIOD, substring_dedup.COVER
    assert {(a - b) % p for a in c for b in c} == set(range(p))
    assert substring_dedup.ANCHOR + p - 1 == substring_dedup.WINDOW


def lm_brute(texts, order=3, back=0.4):
    words = [(t or "").encode().split() for t in texts]
    grams = lambda w, n: collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total = [sum((grams(w, n) for w in words), collections.Counter()) for n in range(1, order + 1)]
    out = []
    for w in words:
        own = [grams(w, n) for n in range(1, order + 1)]
        c = lambda g: total[len(g) - 1][g] - own[len(g) - 1][g]  # noqa: B023, E731
        others, score = sum(map(len, words)) - len(w), 0.0
        for i in range(len(w)):
            p, factor = None, 1.0
            for n in range(min(order, i + 1), 1, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if c(g) > 0:
                    p = factor * c(g) / c(g[:-1])
                    break
                factor *= back
            if p is None:
                p = factor * (c((w[i],)) / others if c((w[i],)) > 0 else 1 / (others + 1))
            score += np.log(p)
        out.append((len(w), score))
    return out


def test_lm_scores(docs, empty):
    some = docs
    given = texts_of(some)
    want = sorted((d, n, s) for (d, _), (n, s) in zip(given, lm_brute([t for _, t in given]), strict=True))
    got = sorted((r["doc_id"], r["n_words"], r["log_score"]) for r in lm_score.scores(some).collect())
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want])
    assert lm_score.scores(empty).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_encoder_equals_the_tokenizer(tokenizer):
    encode = packing.encoder(tokenizer)
    rng = random.Random(2)
    hard = ["", " ", "a  b", "a \n b", "it's", "x <|endoftext|> y", "tab\t\there", "é\u00a0ü", "a" * 3000, " " * 2500 + "b", "12 34!?"]
    hard += ["".join(rng.choice("ab'sé1! \n\t") for _ in range(rng.randint(0, 20))) for _ in range(500)]
    assert all(encode(t) == encode.whole(t) for t in hard)


def plain_best_fit(lengths, capacity):
    """Best fit, the longest first, one piece at a time: how many sequences it takes."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(gaps, n)
        gap = gaps.pop(k) if k < len(gaps) else capacity
        bisect.insort(gaps, gap - n)
    return len(gaps)


def plain_sweep(is_gap):
    """(piece, slot) of those matched, pieces left, slots left, with a stack."""
    stack, pairs, alone = [], [], []
    for i, gap in enumerate(is_gap):
        if gap:
            stack.append(i)
        elif stack:
            pairs.append((i, stack.pop()))
        else:
            alone.append(i)
    return sorted(pairs), alone, stack


def test_sweeps_match_successors():
    rng = random.Random(4)
    for _ in range(300):
        is_gap = np.array([rng.random() < 0.5 for _ in range(rng.randint(0, 30))], bool)
        pieces, slots, alone, free = packing.sweep(is_gap)
        assert (sorted(zip(pieces.tolist(), slots.tolist(), strict=True)), alone.tolist(), free.tolist()) == plain_sweep(is_gap)
        # cut into ranges, swept apart and put together by ranks, the same pieces meet the same slots
        cuts = sorted(rng.randint(0, len(is_gap)) for _ in range(3))
        met, left, ranks = [], [], {}
        for p, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(is_gap)], strict=True)):
            x, y, u, v = packing.sweep(is_gap[a:b])
            met += [(a + i, a + k) for i, k in zip(x.tolist(), y.tolist(), strict=True)]
            left.append((p, len(u), len(v)))
            ranks[p] = (a + u).tolist(), (a + v).tolist()
        for p, first, many, q, last in packing.across(left):
            met += [(ranks[p][0][first + i], ranks[q][1][last - i]) for i in range(many)]
        assert sorted(met) == plain_sweep(is_gap)[0]


@pytest.mark.parametrize(("capacity", "rows"), [(100, 50), (2048, 5000), (7, 10)])
def test_best_fit_places_all_and_overfills_none(spark, monkeypatch, capacity, rows):
    monkeypatch.setattr(packing, "ROWS_A_RANGE", rows)
    rng = random.Random(capacity)
    lengths = [min(capacity, int(rng.expovariate(4 / capacity)) + 1) for _ in range(3000)]
    pieces = spark.createDataFrame(list(enumerate(lengths, 1)), "id long, size int")
    got = packing.best_fit(pieces, capacity).collect()
    assert sorted((r.id, r.size) for r in got) == list(enumerate(lengths, 1))
    held = collections.Counter()
    for r in got:
        held[r.sequence] += r.size
    assert max(held.values()) <= capacity
    least = -(-sum(lengths) // capacity)
    assert len(held) <= 1.01 * least + 1 and len(held) <= 1.01 * plain_best_fit(lengths, capacity) + 1
    assert packing.best_fit(pieces.limit(0), capacity).count() == 0


def test_best_fit_of_many_equal_pieces(spark, monkeypatch):
    """One size may be most of all rows: it is dealt to many ranges."""
    monkeypatch.setattr(packing, "ROWS_A_RANGE", 100)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        pieces = spark.range(1, 10_001).select("id", F.when(F.col("id") % 10 == 0, 1500).otherwise(60).cast("int").alias("size"))
        got = packing.best_fit(pieces, 2048)
        held = {r[0]: r[1] for r in got.groupBy("sequence").agg(F.sum("size")).collect()}
        assert sum(held.values()) == 1000 * 1500 + 9000 * 60 and max(held.values()) <= 2048 and len(held) <= 1010
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_packing(spark, docs, empty, tokenizer):
    rows = packing.pack(docs, tokenizer, 256).collect()
    encode = packing.encoder(tokenizer)
    want = collections.Counter()
    for d, t in texts_of(docs):
        ids = encode.whole(t or "") + bytes(4)
        for k, (s, n) in enumerate(packing.cut(len(ids) // 4, 256)):
            want[d, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    held = collections.defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 256
    assert packing.pack(empty, tokenizer).count() == 0
    assert packing.cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)] and packing.cut(2048, 2048) == [(0, 2048)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_encoder_equals_the_tokenizer_on_a_whole_table(spark, tokenizer):
    encode = packing.encoder(tokenizer)
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    assert len(texts) >= 1000 and all(encode(t) == encode.whole(t) for t in texts)


HARD_TEXT = ["", "\\", "<|", "<\\|", "\\<|end|>", "a<", "|b", "<|turn|>x<|text|>", "\\### Assistant: </turn> ok", "é\n\n<|end|>\n"]


def test_escapes_are_reversible():
    rng = random.Random(3)
    for t in HARD_TEXT + ["".join(rng.choice("\\<|>ae\n") for _ in range(12)) for _ in range(2000)]:
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, "user", "x"), (2, 0, "assistant", "first"), (None, 0, "user", "y"), (None, 1, "assistant", "z"), (3, None, None, "odd"), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 1, "user", "u"), (4, 2, "assistant", "long " * 5000)]
    rows += [(10 + i, j, r, t) for i, t in enumerate(HARD_TEXT) for j, r in enumerate(("user", "assistant"))] + [(30, 0, "we<|ird\\", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("position", F.lit("clash")).withColumn("loss", F.lit(1))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    by = collections.defaultdict(list)
    for c, n, r, t in rows:
        by[c].append((-1 if n is None else n, r or "", t or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert [got[c]["valid"] for c in (1, 2, None, 4, 10)] == [False, False, True, False, True]
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_conversation_ids_of_any_type(spark):
    df = spark.createDataFrame([("a", 0, "user", "hi"), ("a", 1, "assistant", "ho"), (None, 0, "user", "x")], "conv_id string, turn int, role string, text string")
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"], r["valid"]) for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert got == {"a": (2, 2, True), None: (1, 0, False)}


def near_brute(given):
    cache = WordHashes()
    sets = [near_dedup.shingle_set((t or "").encode(), cache) for _, t in given]
    parent = list(range(len(given)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(given)):
        for j in range(i):
            if near_dedup.similar(sets[i], sets[j]):
                parent[find(i)] = find(j)
    least = collections.defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(given):
        least[find(i)] = min(least[find(i)], d)
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(given)]


def test_near_duplicates(docs, empty):
    given = texts_of(docs)
    want = near_brute(given)
    rows = near_dedup.near_duplicates(docs).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows) == sorted(want)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    assert len({c for _, _, c in want}) < len(given) - 10
    assert near_dedup.near_duplicates(empty).count() == 0


def test_one_of_each_group_stays(docs):
    out = near_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    want = sorted({d for d, n, c in near_brute(texts_of(docs)) if d == c})
    assert sorted(r["doc_id"] for r in out.collect()) == want


def test_grams_that_agree_in_56_bits_stay_apart():
    part = lm_score.Part([b"a b"])
    part.hashes = np.array([0x1234567890ABCD01, 0x1234567890ABCD02], dtype=np.uint64)
    assert len(lm_score.Grams(part).sent(None)[1]) == 2


def test_parts_and_their_grams():
    rng = random.Random(12)
    texts = [None, b"", *[" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 30))).encode() for _ in range(20)]]
    part = lm_score.Part(texts)
    again = lm_score.Part.read(*part.columns())
    assert (again.ids == part.ids).all() and (again.lengths == part.lengths).all() and (again.hashes == part.hashes).all()
    words = [(t or b"").split() for t in texts]
    below = None
    for n in (1, 2, 3):
        grams = lm_score.Grams(again, below)
        want = [tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1)]
        assert len(grams.places) == len(want) and len(set(want)) == len(grams.hashes)
        assert len({(g, k) for g, k in zip(want, grams.number.tolist(), strict=True)}) == len(set(want))
        grams.shared, grams.total = np.ones(len(grams.hashes), bool), grams.many
        count, own = collections.Counter(want), [collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in words]
        flat = [count[g] - o[g] for w, o in zip(words, own, strict=True) for g in [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]]
        assert grams.counts()[grams.places].tolist() == flat
        below = grams


def test_steps_round_trip():
    rng = np.random.default_rng(3)
    for bits in (3, 6, 12):
        for n in (1, 2, 7, 1000, 90000):
            for top in (n, 1 << 20, 1 << 40, 1 << (64 - bits)):
                base = ((1 << bits) - 1) << (64 - bits)
                keys = np.unique(rng.integers(0, top, n, dtype=np.uint64)) + np.uint64(base)
                assert (exchange._unsteps(exchange._steps(keys, base), base) == keys).all()
    keys = np.array([0, 1, (1 << 61) - 1], dtype=np.uint64)
    assert (exchange._unsteps(exchange._steps(keys, 0), 0) == keys).all()


def test_limits_follow_the_threshold():
    assert near_dedup.limits() == (85, 40, 8, 245)
    for percent in (70, 80, 85, 90, 100):
        at = near_dedup.limits(percent)
        assert at.bands * at.rows <= near_dedup.MINIMA
        assert (1 - (percent / 100) ** at.rows) ** at.bands <= 3e-6


def test_links_from_80_percent(spark):
    """Of 100 words one in the middle changes: 91 of 101 shingles are shared; two, far apart: 86 of 106, which is 0.81."""
    rng = random.Random(7)
    rows = []
    for i in range(40):
        words = [f"g{i}w{rng.randrange(10**6)}" for _ in range(100)]
        rows.append((2 * i, " ".join(words)))
        words[30] = words[70] = "other"
        rows.append((2 * i + 1, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in near_dedup.deduplicate(df, 80).collect()} == {2 * i for i in range(40)}
    assert near_dedup.deduplicate(df).count() == 80


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(6)
    for n in (1, 30, 400, 5000):
        a, b = (np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for _ in "ab")
        b = np.union1d(a[: n // 2], b)
        differ = sum(int(x).bit_count() for x in (near_dedup.parities(a) ^ near_dedup.parities(b)).view(np.uint64))
        assert differ <= len(np.setxor1d(a, b)) and (n > 100 or differ >= 0.8 * len(np.setxor1d(a, b)))


def test_minima_estimate_similarity():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    b = np.concatenate([a[:900], rng.integers(0, 1 << 63, 100).astype(np.uint64)])
    assert abs((near_dedup.minima(a) == near_dedup.minima(b)).mean() - 900 / 1100) < 0.1
    assert (near_dedup.bands_and_bits(near_dedup.minima(a))[0] == near_dedup.bands_and_bits(near_dedup.minima(a[::-1]))[0]).all()


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]


def rule_for(host, path, rules):
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, "allow")


def test_url_rules(spark):
    rng = random.Random(6)
    hosts, paths = ["com", "a.com", "b.a.com", "net", "x.net", "acom", "com.net"], ["/", "/a/", "/a/b", "/a/bc", "/z", ""]
    rules = sorted({(rng.choice(hosts), rng.choice(paths)) for _ in range(18)})
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules]
    made = [f"http://{rng.choice(['', 'www.', 'q.r.'])}{rng.choice(hosts).upper()}{rng.choice(paths)}{rng.choice(['', '?q=/a', '#f', 'tail'])}" for _ in range(300)]
    urls = made + [None, "", "no scheme/a/b", "http://", "://com/a/", "x://com?a", "http://com:80/a", "http://" + "s." * 3000 + "com/a/b", "http://é.com/a/ü"] + [made[0]] * 5
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)] + [(0, made[0], "c"), (None, made[1], "c")], "page_id long, url string, host string")
    table_ = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = collections.Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.match_rules(df, table_).collect())
    want = collections.Counter()
    for r in df.collect():
        h, p = host_path(r["url"])
        want[(r["page_id"], h, p, *rule_for(h, p, rules))] += 1
    assert got == want
    assert {r["verdict"] for r in url_filter.match_rules(df, table_.limit(0)).collect()} == {"allow"}
    assert url_filter.match_rules(df.limit(0), table_).count() == 0


def test_hosts_of_rules_are_lowered_as_those_of_urls(spark):
    pages = spark.createDataFrame([(1, "http://x.\u00c9A.com/a")], "page_id long, url string")
    rules = spark.createDataFrame([("\u00c9a.COM", "/", "block")], "host string, path string, verdict string")
    assert [(r["rule"], r["verdict"]) for r in url_filter.match_rules(pages, rules).collect()] == [("\u00c9a.com/", "block")]


def test_quality_counts():
    cache = WordHashes()
    text = "a b c d e f g h X\na b c d e f g h Y\n\n dup # $\n dup # $\nÉté !!"
    got = dict(zip(quality_rules.COUNTS, quality_rules.measure(text.encode(), cache), strict=True))
    words = text.split()
    assert got["n_words"] == len(words) and got["word_chars"] == sum(map(len, words))
    assert (got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"], got["n_upper"], got["n_marks"]) == (4, 1, 16, 2, 2)
    assert quality_rules.measure(None, cache) == quality_rules.measure(b" \n", cache) == (0,) * 8
    rng = random.Random(7)
    for _ in range(100):
        w = [rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 40))]
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert quality_rules.repeated_words(w, cache) == len(hit)


def test_binomial_bounds():
    assert quality_rules.binomial_upper(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100))
    assert quality_rules.binomial_upper(5, 5, 0.05) == 1.0
    assert quality_rules.binomial_upper(3, 50, 0.05) > quality_rules.binomial_upper(2, 50, 0.05)
    good, bad = [0] * 201, [0] * 201
    good[10], bad[150] = 5000, 40
    assert quality_rules.choose_cutoff(good, bad, 0.005, 0.05) == 1.5
    good[10] = 50  # too few to bound the risk
    assert quality_rules.choose_cutoff(good, bad, 0.005, 0.05) is None
    assert quality_rules.choose_cutoff([0] * 201, bad, 0.005, 0.05) is None


def test_quality_rules_keep_clean_texts(spark):
    rng = random.Random(8)
    rows = [(i, "en" if i % 2 else None, sentence(rng, 60, [f"w{k}" for k in range(500)]), 1) for i in range(3000)]
    rows += [(5000 + i, "en" if i % 2 else None, " ".join(w + "###" for w in sentence(rng, 60, [f"w{k}" for k in range(500)]).split()), 0) for i in range(60)]
    rows += [(9000, "xx", None, 1), (9001, "xx", "", 1), (9002, None, "word " * 50, 1)]
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, lang string, text string").withColumn("kept", F.lit("clash"))
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(1, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_rules.judge(df, labels).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["__kept"] for i in range(3000)) and not any(got[5000 + i]["__kept"] for i in range(60))
    assert all(got[i]["__base_failed"] for i in (9000, 9001, 9002))
    assert quality_rules.judge(df, labels.limit(0)).filter("__kept = __base_failed").count() == 0
    assert quality_rules.judge(df.limit(0), labels).count() == 0


def test_sharding(docs, empty):
    rows = sharding.shard(docs, 4).collect()
    given = texts_of(docs)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in given)
    load, slots, homes = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    by_id = dict(given)
    for r in rows:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        homes[by_id[r["doc_id"]]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(h) == 1 for h in homes.values())
    sizes = collections.Counter()
    for _, t in given:
        sizes[t] += len((t or "").encode()) + 1
    heap = [0] * 4
    for size in sorted(sizes.values(), reverse=True):
        heap[heap.index(min(heap))] += size
    assert sorted(load.values()) == sorted(heap)
    assert sharding.shard(empty).count() == 0


def test_sizes_are_exact_and_in_order():
    """As one heap over all groups gives it, above 4096 bytes too."""
    rng = random.Random(4)
    for _ in range(30):
        sizes = collections.Counter(rng.choice([rng.randint(1, 30), rng.randint(4000, 9000), rng.randint(10**6, 10**6 + 300)]) for _ in range(rng.randint(0, 400)))
        got = collections.Counter()
        for size, i, first, end in sharding.schedule(sorted(sizes.items(), reverse=True), 7):
            got[i] += size * (end - first)
        heap = [0] * 7
        for size in sorted(sizes.elements(), reverse=True):
            heap[heap.index(min(heap))] += size
        assert sorted(got[i] for i in range(7)) == sorted(heap)


def test_dealing_is_as_one_by_one():
    rng = random.Random(9)
    for _ in range(200):
        loads, n, size = [rng.randint(0, 50) for _ in range(5)], rng.randint(0, 160), rng.randint(1, 20)
        one = list(loads)
        for _ in range(n):
            one[one.index(min(one))] += size
        assert sorted(x + c * size for x, c in zip(loads, sharding.deal(loads, n, size), strict=True)) == sorted(one)


def test_decontamination(spark, docs, empty):
    given = texts_of(docs)
    t = dict(given)
    items = [(1, t[20]), (2, "One"), (3, None), (4, "zz yy xx"), (5, " ".join((t[30] or "").split()[2:14]) + " extra words here"), (5, t[20]), (None, t[40]), (6, t[9])]
    bench = spark.createDataFrame([(i, x, "q") for i, x in items], "item_id long, text string, n_words string")
    want = decontaminate.brute_force(given, items)
    clashing = docs.withColumns({c: F.lit(1) for c in ("__c_", "__id", "__hash", "__more", "hash", "c")})
    for limit in (10**6, 50):  # one block, and one for each item or two
        out = decontaminate.with_hits(clashing, bench, limit=limit)
        assert out.columns == [*clashing.columns, "__c"]
        rows = out.collect()
        assert len(rows) == len(given)
        assert {r["doc_id"]: (r["__c"]["n_words"], r["__c"]["n_hit"], list(r["__c"]["items"]), r["__c"]["longest"], r["__c"]["longest_at"]) for r in rows} == want
    own = docs.withColumn("__c", F.lit("mine"))
    assert sorted((r["doc_id"], r["__c"]) for r in decontaminate.clean(own, bench).collect()) == sorted((d, "mine") for d, _ in given if not want[d][1])
    assert decontaminate.with_hits(docs, bench.limit(0)).filter("__c.n_hit > 0").count() == 0
    assert decontaminate.with_hits(empty, bench).count() == 0


def test_suffix_search_is_as_brute_force(monkeypatch):
    rng = random.Random(1)
    for _ in range(120):
        v = [f"w{i}" for i in range(rng.choice([1, 2, 3, 8, 30]))]
        made = lambda n: " ".join(rng.choice(v) for _ in range(rng.randint(0, n)))  # noqa: B023, E731
        given = [(i, rng.choice([None, made(60), made(60), made(12)])) for i in range(rng.randint(0, 6))]
        items = [(rng.randint(1, 4), rng.choice([None, made(50), made(5)])) for _ in range(rng.randint(1, 5))]
        given.append((77, f"{items[0][1] or ''} x {items[-1][1] or ''}"))
        window = rng.choice([10, 3])
        want = decontaminate.brute_force(given, items, window)
        monkeypatch.setattr(decontaminate, "SHARD_BYTES", rng.choice([50, 10**6]))
        texts = [None if t is None else t.encode() for _, t in given]
        block = lambda some: decontaminate.Block([(str(i), (t or "").encode()) for i, t in some], window)  # noqa: B023, E731
        assert [r[:5] for r in decontaminate.judged(texts, [block(items)])] == [want[i] for i, _ in given]
        one, two = (decontaminate.judged(texts, [block(x)]) for x in (items[:1], items[1:]))
        named = lambda r: dict(zip(decontaminate.NAMES, r, strict=True))
        assert [decontaminate.joined(named(a), [named(b)])[:5] for a, b in zip(one, two, strict=True)] == [want[i] for i, _ in given]


def test_suffix_arrays_are_sorted():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 50, 400):
        ids = rng.integers(0, 3, n).astype(np.int32)
        ids = ids % 2 if n == 50 else ids
        ids = np.unique(ids, return_inverse=True)[1].astype(np.int32) if n else ids
        for depth in (1, 4, n + 1):
            found = [ids[i : i + depth].tolist() for i in decontaminate.suffix_array(ids, depth)]
            assert found == sorted(ids[i : i + depth].tolist() for i in range(n))


def test_the_same_word_many_times_on_both_sides():
    """20000 places on each side; a product of places would be 400 million."""
    text = b"la " * 20_000
    tracemalloc.start()
    got = decontaminate.judged([text, b"x " * 5 + text, b"la " * 9], [decontaminate.Block([("1", text), ("2", b"la la")])])
    assert tracemalloc.get_traced_memory()[1] < 100_000_000
    tracemalloc.stop()
    assert [r[:5] for r in got] == [(20000, 20000, ["1", "2"], 20000, 0), (20005, 20000, ["1", "2"], 20000, 5), (9, 9, ["2"], 2, 0)]


def test_blocks_of_a_pass_share_one_array(monkeypatch):
    """Five blocks are looked up in one array of the shard, and give what one block of all gives."""
    rng = random.Random(17)
    texts = [sentence(rng, rng.randint(0, 60)).encode() for _ in range(60)]
    items = [(str(i), sentence(rng, rng.randint(0, 25)).encode()) for i in range(40)]
    blocks = [decontaminate.Block(items[i::5], 3) for i in range(5)]
    built, plain = [], decontaminate.suffix_array
    monkeypatch.setattr(decontaminate, "suffix_array", lambda ids, depth: built.append(depth) or plain(ids, depth))
    got = decontaminate.judged(texts, blocks)
    assert len(built) == 1
    assert got == decontaminate.judged(texts, [decontaminate.Block(items, 3)])
    want = decontaminate.brute_force([(i, t.decode()) for i, t in enumerate(texts)], [(i, t.decode()) for i, t in items], 3)
    assert [r[:3] for r in got] == [w[:3] for w in want.values()]


def test_many_passes_over_the_benchmark(docs, spark, monkeypatch):
    given = texts_of(docs)
    rng = random.Random(6)
    own = [(t or "").split() for _, t in given]
    items = [(f"i{k}", " ".join(w[a : a + rng.randint(1, 14)])) for k in range(12) if (w := rng.choice([x for x in own if x])) and (a := rng.randrange(len(w))) >= 0]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = decontaminate.brute_force(given, items)
    monkeypatch.setattr(decontaminate, "BLOCKS_A_PASS", 3)
    got = {(r["doc_id"], r["__c"]["n_hit"], tuple(r["__c"]["items"]), r["__c"]["longest"]) for r in decontaminate.with_hits(docs, bench, limit=1).collect()}
    assert got == {(d, want[d][1], tuple(want[d][2]), want[d][3]) for d, _ in given}
