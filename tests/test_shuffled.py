"""What grows with the input is joined by a shuffle, however small its files are."""

from pyspark.sql import functions as F

from tessera.operators import candidates, retrieve, vectors
from tessera.plans import entities

SMALL = "/root/testdata/sf0.001"


def joins(df):
    return [line for line in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line]


def people(spark):
    rows = [(i, ["red ring", "old ring", "cold ring"][i % 3], [1.0, float(i % 5)]) for i in range(30)]
    return spark.createDataFrame(rows, "entity_id long, name string, embedding array<double>")


def test_tiles_are_shuffled(spark):
    x = spark.createDataFrame([(1, i) for i in range(9)], "k int, a int")
    y = spark.createDataFrame([(1, i) for i in range(9)], "k int, b int")
    for rows in (2, 100):
        p, q, keys = candidates.tiled(x, y, ["k"], rows)
        met = p.join(q, keys)
        assert "SortMergeJoin" in joins(met)[0]
        assert met.select("a", "b").distinct().count() == met.count() == 81


def test_search_does_not_broadcast_its_pairs(spark):
    e = people(spark)
    asked = e.filter("entity_id < 3").selectExpr("entity_id question_id", "array(name) names", "embedding")
    found = retrieve.search_entities(e, asked, 0.3)
    assert all("SortMergeJoin" in j for j in joins(found) if "LeftAnti" in j)
    assert found.select("question_id", "entity_id").distinct().count() == found.count() > 0


def test_ranked_entities_does_not_broadcast_what_is_found(spark, monkeypatch):
    seen, write = {}, retrieve.materialize
    monkeypatch.setattr(retrieve, "materialize", lambda df, name: write(seen.setdefault(name, df), name))
    assert entities.ranked_entities(spark, SMALL).limit(1).count() == 1
    left_out = [j for j in joins(seen["to-rank"]) if "LeftAnti" in j]
    assert left_out and all("SortMergeJoin" in j for j in left_out)


def final_joins(df):
    df.collect()
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines() if "Join" in line]


def test_source_documents_does_not_broadcast_the_entities(spark):
    """The last join, which is first in the plan, is of what is found with all entities; adaptive execution may not make it a broadcast."""
    assert "SortMergeJoin" in final_joins(entities.source_documents(spark, SMALL))[0]


def test_ranked_entities_broadcasts_neither_entities_nor_names(spark, monkeypatch):
    seen, write = {}, retrieve.materialize
    monkeypatch.setattr(retrieve, "materialize", lambda df, name: write(seen.setdefault(name, df), name))
    entities.ranked_entities(spark, SMALL)
    whole = [j for j in joins(seen["to-rank"]) if "[entity_id#" in j or "[question_id#" in j]
    assert len(whole) == 3 and all("SortMergeJoin" in j for j in whole)
    pieces = [j for j in joins(seen["name-matches"]) if "[piece" in j and "Inner" in j]
    assert pieces and all("SortMergeJoin" in j for j in pieces)
    scans = seen["to-rank"]._jdf.queryExecution().sparkPlan().toString()
    assert "part.parquet" not in scans  # what is searched was joined once and written


def test_positions_joins_nothing(spark):
    rows = [(q, i, float(i % 3)) for q in (None, 1, 2) for i in range(40)]
    found = spark.createDataFrame(rows, "question_id long, entity_id long, score double").repartition(5)
    ranked = retrieve.ranked_entities(found, by=["question_id"])
    assert joins(ranked) == []
    assert ranked.columns == ["question_id", "entity_id", "score", "position"]
    for q in (None, 1, 2):
        got = [r.entity_id for r in sorted((r for r in ranked.collect() if r.question_id == q), key=lambda r: r.position)]
        assert got == sorted(range(40), key=lambda i: (-(i % 3), i))
        assert {r.position for r in ranked.collect() if r.question_id == q} == set(range(1, 41))


def test_index_is_fitted_on_few_rows_of_each_partition(spark, monkeypatch):
    v = spark.range(3000).select("id", F.array(F.lit(1.0), F.rand(7)).alias("embedding")).repartition(20).localCheckpoint()
    taken, to_pandas = [], type(v).toPandas
    monkeypatch.setattr(type(v), "toPandas", lambda self: taken.append(self) or to_pandas(self))
    vectors.fit(v, sample=100)
    plan = taken[0]._jdf.queryExecution().optimizedPlan().toString()
    assert any("Filter" in line and "xxhash64" in line for line in plan.splitlines())
    monkeypatch.undo()
    got, total = vectors.sampled(v, 100)
    wanted = v.orderBy(F.xxhash64("id"), "id").limit(100).toPandas()
    assert total == 3000 and got["embedding"].tolist() == wanted["embedding"].tolist()
    # ids that all have one hash leave nothing under the bound, or everything
    same = v.withColumn("id", F.lit(5))
    assert len(vectors.sampled(same, 100)[0]) == 100
