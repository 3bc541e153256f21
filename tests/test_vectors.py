"""The vector index and questions as tables, against plain forms."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import engine, vectors
from tessera.operators import retrieve as R


def cosine(a, b):
    if not a or not b or len(a) != len(b) or not any(a) or not any(b):
        return 0.0
    return float(np.clip(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b), 0, 1))


def some_vectors(rng, n):
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    for i in range(n):
        kind = rng.random()
        c = rng.choice(centres)
        yield 2**60 + i, None if kind < 0.02 else [] if kind < 0.04 else [0.0] * 8 if kind < 0.06 else [rng.gauss(0, 1) for _ in range(3)] if kind < 0.12 else [x + rng.gauss(0, 0.4) for x in c]


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    every = list(some_vectors(rng, 540))
    rows = [*every[:500], (9, [1.0, 2.0, 3.0, 4.0, 5.0])]
    asked = [*every[500:], (7, [1.0] * 5), (8, [1.0] * 7)]
    make = lambda r, key: spark.createDataFrame(r, f"{key} long, embedding array<double>").cache()
    return rows, asked, make(rows, "id"), make(asked, "question_id")


@pytest.mark.parametrize("tile", [2048, 20])
def test_near_is_exact(data, tile):
    rows, asked, v, q = data
    index = vectors.fit(v, sample=200)  # one length is not in the sample's larger cells, one not at all
    for least in (0.3, 0.8):
        got = {(r.question_id, r.id): r.cosine for r in vectors.near(index, q, least, tile).collect()}
        want = {(a, b): c for a, x in asked for b, y in rows if (c := cosine(x, y)) >= least}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert vectors.near(index, q.limit(0), 0.5).count() == 0
    with pytest.raises(ValueError, match="threshold"):
        vectors.near(index, q, 0.0)


def test_nearest_finds_most(data):
    rows, asked, v, q = data
    index = vectors.fit(v)
    r = vectors.recall(index, q).first()
    directed = [x for _, x in asked if x and any(x) and any(len(y or []) == len(x) for _, y in rows)]
    assert r.questions == len(directed) and r.found >= 0.9 * r.wanted
    assert all(p <= len(index.centroids[n]) for n, p in index.probes.items()) and index.probes[8] < len(index.centroids[8])
    every = vectors.nearest(index, q, 5, 10**6)
    for a, x in asked[:10]:
        want = sorted(((-cosine(x, y), b) for b, y in rows if x and y and len(x) == len(y) and any(x) and any(y)))[:5]
        got = [(r.id, r["rank"]) for r in every.filter(F.col("question_id") == a).orderBy("rank").collect()]
        assert got == [(b, i) for i, (_, b) in enumerate(want, 1)]


def test_index_of_nothing(spark):
    none = spark.createDataFrame([], "id long, embedding array<double>")
    index = vectors.fit(none)
    assert vectors.nearest(index, spark.createDataFrame([(1, [1.0])], "question_id long, embedding array<double>")).count() == 0
    assert tuple(vectors.recall(index, none.withColumnRenamed("id", "question_id")).first()) == (0, 0, 0)


def test_names_that_hold_each_other(spark):
    rng = random.Random(2)
    name = lambda: "".join(rng.choice("ab c") for _ in range(rng.randint(0, 7)))
    asked = [name() for _ in range(60)] + [None, " ab "]
    names = [name().strip() for _ in range(60)] + [None, ""]
    q = spark.createDataFrame([(None if a is None else a, None if a is None else a.strip()) for a in asked], "raw string, bare string")
    e = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r.raw, r.name): (r.named, r.held) for r in R.name_matches(q, e).collect()}
    want = {}
    for raw in {a for a in asked if a is not None}:
        for n in {x for x in names if x is not None}:
            x = raw.strip()
            named = 1.0 if x == n else 0.75 if x in n or n in x else 0.0
            held = n != "" and (raw in n or n in raw)
            if named or held:
                want[raw, n] = (named, held)
    assert got == want


def test_positions_of_many_ties(spark):
    df = spark.range(20_000).select((F.col("id") % 3).alias("g"), F.lit(1.0).alias("score"), F.col("id").alias("key"), F.lit(2.0).alias("tokens")).repartition(6)
    got = R.positions(df, [F.desc("score"), F.asc("key")], ["g"], "tokens")
    assert got.filter(F.col("position") != F.floor(F.col("key") / 3) + 1).count() == 0
    assert got.filter(F.col("used") != 2.0 * F.col("position")).count() == 0 and got.count() == 20_000
    few = R.positions(df, [F.desc("score"), F.asc("key")], ["g"], "tokens", 10.0)
    assert few.filter("used <= 10").count() == 15
    assert R.positions(df.limit(0), [F.asc("key")]).count() == 0


def test_a_table_of_questions_is_each_question(spark):
    rng = random.Random(7)
    people = [(i, rng.choice(["ann lee", "bob ray", "zoe", "mei lin", None]), [rng.gauss(0, 1) for _ in range(3)], f"d{i % 5}", {"dob": f"1990-01-0{1 + i % 3}"}, i) for i in range(40)]
    e = spark.createDataFrame(people, "entity_id int, name string, embedding array<double>, source_doc_id string, attributes map<string,string>, ord int").withColumn("date", F.when(F.col("ord") % 7 != 0, F.date_add(F.lit("1990-01-01"), F.col("ord") % 9)))
    docs = spark.createDataFrame([(f"d{i}", f"f{i}", "word " * (3 * i + 1)) for i in range(5)], "doc_id string, filename string, text string")
    links = spark.createDataFrame([(i, (i * 7 + 3) % 40, rng.choice([0.5, 0.7, 0.9])) for i in range(40) if i != (i * 7 + 3) % 40], "a int, b int, confidence double")
    central = spark.createDataFrame([(f"d{i}", i / 5) for i in range(4)], "id string, centrality double")
    told = e.select("entity_id", F.lit("dob").alias("key"), F.col("attributes")["dob"].alias("value"), F.col("source_doc_id").alias("source"))
    asked = [(1, ["ann lee"], [1.0, 0.0, 0.0]), (2, ["nobody at all"], [0.0, 1.0, 0.0]), (3, ["zoe", "bob"], None), (4, [], [0.0, 0.0, 0.0])]
    q = spark.createDataFrame(asked, "question_id int, names array<string>, embedding array<double>")
    for mode in ("current", "1990-01-03", "all", "1980-01-01"):
        whole = engine.query_all(e, docs, links, central, told, q, 2, mode, 30.0)
        for k, names, vector in asked[:2] if mode != "current" else asked:
            one = engine.query(e, docs, links, central, told, names, vector, 2, mode, 30.0)
            rows = lambda d, *c: sorted(map(tuple, d.select(*c).collect()))
            mine = lambda d: d.filter(F.col("question_id") == k)  # noqa: B023, E731
            assert rows(mine(whole.entities), "entity_id") == rows(one.entities, "entity_id")
            assert rows(mine(whole.context), "doc_id", "position") == rows(one.context, "doc_id", "position")
            assert rows(mine(whole.conflicts), "id_a", "id_b", "attribute_key") == rows(one.conflicts, "id_a", "id_b", "attribute_key")
            assert rows(mine(whole.provenance), "entity_id", "fact") == rows(one.provenance, "entity_id", "fact")
