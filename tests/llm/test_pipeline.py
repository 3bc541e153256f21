"""The pipeline's stages one after the other, and what its registered queries promise."""

import collections
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontaminate, near_dedup, packing, quality_rules, queries, substring_dedup
from tessera.llm.common import WordHashes

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [f for _, f in corpus_pipeline.STAGES] == [corpus_pipeline.reject_low_quality, corpus_pipeline.drop_near_duplicates, corpus_pipeline.cut_repeated_passages, corpus_pipeline.drop_contaminated, corpus_pipeline.pack_sequences]
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.dtypes == docs.dtypes
        counts.append(out.count())
        docs = out
    assert counts[0] > counts[1] > counts[2] == counts[3] > counts[4] > 0
    packed = corpus_pipeline.pack_sequences(spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == counts[4]


def test_near_stage_takes_80_percent(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(1)
    words = [f"w{i}" for i in range(100)]
    changed = ["other" if i in (30, 70) else w for i, w in enumerate(words)]
    pair = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(changed))], "doc_id long, text string")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    pair = pair.crossJoin(docs.select(*rest)).select(docs.columns)
    assert [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, pair, SF).collect()] == [1]


def hard(spark, docs):
    """Rows of ``documents`` with nulls in any column, repeats, ties, near copies, shared passages, a benchmark item, and clashing columns."""
    rng = random.Random(21)
    made = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    passage, base, item = made(60), made(120).split(), spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) > 80").orderBy("item_id").first()["text"]
    rows = [(None, made(50), "en"), (1, None, "en"), (2, "", None), (3, " \n", "en"), (4, "too short", "en"), (5, "w " * 400, "en"), (6, made(9000), "en"), (7, made(60), None)]
    rows += [(8, rows[7][1], "de"), (8, rows[7][1], "de")]  # equal texts, and a row twice
    for i in range(4):  # near copies: 0.81 and more
        words = list(base)
        for j in range(i):
            words[15 + 30 * j] = f"changed{i}"
        rows.append((20 + i, " ".join(words), "en"))
    rows += [(30 + i, f"{made(40)} {passage} {made(40)}", "en") for i in range(3)]
    rows += [(40, f"{made(40)} {item} {made(40)}", "fr"), (41, made(45), "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    rest = [F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns if c not in df.columns]
    clashes = ["__m", "__kept", "__s", "__cut", "__part", "__near_hash", "__c", "__n_words", "kept", "hash"]
    return df.select("*", *rest).select(*docs.columns, *[F.col("doc_id").alias(c) for c in clashes])


def brute(rows, labels, items):
    """The stages' rows one by one, as (doc_id, text): after each stage."""
    cache, out = WordHashes(), []
    m = [quality_rules.measure((t or "").encode(), cache) for _, t in rows]
    rows = [r for r, x in zip(rows, m, strict=True) if x[0] >= 20 and 100 * x[4] <= 30 * x[0]]  # too few labels here for cutoffs
    out.append(rows)
    sets = [near_dedup.shingle_set((t or "").encode(), cache) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if near_dedup.similar(sets[i], sets[j], corpus_pipeline.NEAR_PERCENT):
                group = [group[j] if g == group[i] else g for g in group]
    best = {}
    for r, g in zip(rows, group, strict=True):
        best[g] = min(best.get(g, r), r, key=lambda x: (x[0] is not None, x[0]))
    rows = list(best.values())
    out.append(rows)
    judged = substring_dedup.brute_force([t for _, t in rows])
    words = [t.split() for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    cut = []
    for (d, t), w, (_, n, _) in zip(rows, words, judged, strict=True):
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        assert len(gone) == n
        cut.append((d, " ".join(x for i, x in enumerate(w) if i not in gone) if n else t))
    out.append(cut)
    hits = decontaminate.brute_force([(i, t) for i, (_, t) in enumerate(cut)], items)
    out.append([r for i, r in enumerate(cut) if not hits[i][1]])
    return out


def test_stages_are_as_brute_force_and_take_hard_rows(spark):
    docs = hard(spark, spark.read.parquet(f"{SF}/documents.parquet")).cache()
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [], items)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    now = docs
    for (_, stage), rows in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        now = stage(spark, now, SF).cache()
        assert now.dtypes == docs.dtypes
        got = now.collect()
        assert sorted(((r["doc_id"], r["text"]) for r in got), key=key) == sorted(rows, key=key)
        assert all(r["__kept"] == r["__c"] == r["kept"] == r["doc_id"] for r in got)
    assert {d for d, _ in want[3]} >= {None, 6, 7, 41} and not {1, 2, 3, 4, 5, 8, 21, 40} & {d for d, _ in want[3]}
    packed = corpus_pipeline.pack_sequences(spark, now, SF).collect()
    encode = packing.encoder(queries.tokenizer_path())
    pieces = [(d, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for d, t in want[3] for ids in [encode.whole(t or "") + bytes(4)] for k, (s, n) in enumerate(packing.cut(len(ids) // 4, 2048))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed), key=str) == sorted(pieces, key=str)
    # Later stages take what the quality rules would have rejected.
    for _, stage in corpus_pipeline.STAGES[1:]:
        left = stage(spark, docs, SF)
        assert left.count() > 0 and {1, 2, 3} <= {r["doc_id"] for r in left.select("doc_id").collect()}


def test_run_is_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, docs.select(columns).collect()))


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_take_no_rows(spark, stage):
    assert stage(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(0), SF).count() == 0


def test_each_operator_has_one_query():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)
