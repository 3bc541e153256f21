"""The exact links that queries register are those of equal names: one that holds another is not linked, however near the vectors."""

import duckdb
import pytest

from tessera.operators import resolve as M
from tessera.plans import catalogue


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Parts 1 to 6 with vectors: two old rings, a cold ring beside them, and a household of four."""
    at = tmp_path_factory.mktemp("exact")
    names = ["old ring", "cold ring", "old ring", "red bolt", "Red Bolt", "new rod"]
    parts = [(i + 1, n, f"brand {i}", "type", i) for i, n in enumerate(names)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{at}/part.parquet")
    spark.createDataFrame([(i, [1.0, 0.01 * i], 0) for i in range(6)], "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    spark.createDataFrame([(i, f"Customer {i}") for i in range(12)], "c_custkey long, c_name string").write.parquet(f"{at}/customer.parquet")
    return str(at)


def same_as_sql(spark, folder, name):
    c = duckdb.connect()
    for t in ("part", "embeddings", "customer"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = c.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = catalogue.queries()[name](spark, folder).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    return got.count()


def test_resolve_pairs(spark, folder):
    assert same_as_sql(spark, folder, "resolve_pairs") == 2


def test_incremental_components(spark, folder):
    assert same_as_sql(spark, folder, "incremental_components") == 4


def test_after_ingest(spark, folder):
    assert same_as_sql(spark, folder, "after_ingest") == 1


def test_household_edges_are_not_shuffled(spark, folder):
    assert same_as_sql(spark, folder, "household_edges") > 0
    plan = catalogue.queries()["household_edges"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan


def test_household_tiles_meet_once_and_stay_many_tasks(spark):
    rows = [(i, f"n{i}", "1 Maple Street, X") for i in range(60)]
    people = spark.createDataFrame(rows, "entity_id long, name string, address string")
    known = spark.createDataFrame([(i + 1, i) for i in range(0, 60, 5)] + [(3, 3), (0, 99)], "a int, b int")
    got = M.lives_with(people, known, 7)
    pairs = sorted((r.a, r.b) for r in got.collect())
    assert pairs == [(a, b) for a in range(60) for b in range(a + 1, 60) if not (a % 5 == 0 and b == a + 1)]
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
