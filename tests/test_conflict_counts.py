"""Conflicts of many questions are counted by kinds of entities, and tell what the rows of ``query_all`` tell."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import engine, resolve
from tessera.plans import entities as plans

SMALL = "/root/testdata/sf0.001"


def cliques(spark):
    """Links at 0.9 that make cliques of 5, chance links between them at 0.6 and weak ones at 0.4; the last node is no entity."""
    rng = random.Random(3)
    links = {(a, b): 0.9 for a in range(30) for b in range(a + 1, 30) if a // 5 == b // 5}
    links |= {(3, 7): 0.6, (8, 12): 0.6, (13, 17): 0.7, (28, 40): 0.6, (39, 99): 0.9}
    links |= {p: 0.4 for p in (tuple(sorted(rng.sample(range(40), 2))) for _ in range(80)) if p not in links}
    return spark.createDataFrame([(a, b, c) for (a, b), c in links.items()], "a long, b long, confidence double")


def people(spark):
    rows = [(i, f"person {i}", [1.0 if k == i else 0.0 for k in range(41)], f"d{i % 3}", {}, f"1990-01-0{i % 5 + 1}" if i % 7 else None, i) for i in range(41)]
    return spark.createDataFrame(rows, "entity_id long, name string, embedding array<double>, source_doc_id string, attributes map<string,string>, date string, ord long").withColumn("date", F.to_date("date"))


def told(spark):
    """Some have a key twice, or not at all."""
    rows = [(i, k, f"{k} {i % m}", "d") for i in range(41) for k, m in (("address", 3), ("name", 4)) if i % 11] + [(i, "address", "elsewhere", "d") for i in range(0, 41, 6)]
    return spark.createDataFrame(rows, "entity_id long, key string, value string, source string")


def asked(e):
    return e.filter("entity_id in (1, 6, 14, 28, 35, 39)").selectExpr("entity_id question_id", "array(name) names", "embedding")


@pytest.mark.parametrize("mode", ["1990-01-03", "1980-01-01"])
def test_counts_are_those_of_the_rows(spark, mode):
    e, links, attributes = (d.localCheckpoint() for d in (people(spark), cliques(spark), told(spark)))
    docs = spark.createDataFrame([(f"d{i}", f"d{i}", "word") for i in range(3)], "doc_id string, filename string, text string")
    central = docs.selectExpr("doc_id id", "1.0D centrality")
    rows = engine.query_all(e, docs, links, central, attributes, asked(e), 3, mode).conflicts
    want = rows.groupBy("question_id", "attribute_key").agg(F.count(F.lit(1)).alias("conflicts"), F.count_distinct("id_a", "id_b").alias("pairs"))
    got = sorted(map(tuple, engine.count_conflicts(e, links, attributes, asked(e), 3, mode).collect()))
    assert got == sorted(map(tuple, want.collect())) and len(got) > 5


def test_contradictions_are_counted_as_they_are_listed(spark):
    links = cliques(spark).selectExpr("a id_a", "b id_b")
    want = resolve.contradictions(links, told(spark)).groupBy("id_a", "id_b", "attribute_key").count()
    got = resolve.count_contradictions(links, told(spark)).select("id_a", "id_b", F.explode("told").alias("c")).select("id_a", "id_b", "c.*")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_clique_is_one_kind(spark):
    of, between = engine.kinds(cliques(spark).filter("confidence >= 0.6"))
    found = {r.id: r.kind for r in of.collect()}
    assert {found[i] for i in range(20, 25)} == {20} and found[3] == 3 and found[0] == found[4] == 0
    assert sorted(map(tuple, between.filter("a = 0 or b = 0").collect())) == [(0, 3)]


def test_query_conflicts_makes_no_rows_of_questions_and_links(spark, monkeypatch):
    seen, write = {}, engine.materialize
    monkeypatch.setattr(engine, "materialize", lambda df, name: write(seen.setdefault(name, df), name))
    plan = plans.query_conflicts(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "kinds" in seen and "unit-conflicts" in seen
    assert "question_id" not in seen["unit-conflicts"].columns and "array_intersect" in plan
