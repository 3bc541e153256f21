"""Turns with what three tables know of their person, in a stream and in a table; households by member."""

import random

from pyspark.sql import functions as F

from tessera.operators import resolve as M
from tessera.streaming import conversation as V


def sides(spark, late=False):
    claims = [("p1", "PAID"), ("p1", "DENIED"), ("p2", "PAID")] + ([("p3", "OPEN")] if late else [])
    frame = lambda rows, c: spark.createDataFrame(rows, f"person string, {c} string")
    return frame(claims, "claim"), frame([("p1", "Acme"), ("p4", "Zed")], "payer"), frame([("p1", "dob"), ("p1", "name"), ("p4", "dob")], "attribute_key")


def rows_of(df):
    return sorted(map(repr, df.select("call_id", "turn", "person", "claim", "payer", "n_conflicts", "known").collect()))


def turns(spark, calls):
    return spark.createDataFrame([(c, t, p) for c, p in calls for t in range(3)], "call_id int, turn int, person string")


def test_missing_sides_and_many_rows(spark):
    df = turns(spark, [(1, "p1"), (2, "p2"), (3, "p4"), (4, None), (5, "nobody")])
    got = {r.call_id: (r.claim, r.payer, r.n_conflicts, r.known) for r in V.enriched(df.unionByName(df), *sides(spark), watermark="1 hour").collect()}
    assert got == {1: ("DENIED", "Acme", 2, 3), 2: ("PAID", V.NO_PAYER, 0, 1), 3: (V.NO_CLAIM, "Zed", 1, 2), 4: (V.NO_CLAIM, V.NO_PAYER, 0, 0), 5: (V.NO_CLAIM, V.NO_PAYER, 0, 0)}
    assert V.enriched(df.unionByName(df), *sides(spark), watermark="1 hour").count() == 15 and V.enriched(df, *sides(spark)).count() == 15
    assert V.enriched(df.limit(0), *sides(spark)).count() == 0


def test_stream_is_the_replay_and_late_sides_are_seen(spark, tmp_path):
    first, second = turns(spark, [(1, "p1"), (2, "p2"), (3, "p3")]), turns(spark, [(4, "p3"), (5, None)])
    landing, known = f"{tmp_path}/turns", {"late": False}
    first.write.parquet(landing)
    start = lambda: V.follow_enriched(spark.readStream.schema(first.schema).parquet(landing), lambda: sides(spark, known["late"]), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    start()
    assert rows_of(spark.read.parquet(f"{tmp_path}/out/*")) == rows_of(V.enriched(first, *sides(spark)))
    known["late"] = True  # a claim of p3 comes between the batches
    second.write.mode("append").parquet(landing)
    start()
    want = rows_of(V.enriched(first, *sides(spark)).unionByName(V.enriched(second, *sides(spark, True))))
    assert rows_of(spark.read.parquet(f"{tmp_path}/out/*")) == want
    start()
    assert rows_of(spark.read.parquet(f"{tmp_path}/out/*")) == want


def test_members_tell_what_pairs_tell(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["ann", "Ann", f"n{i}", f"n{i}"]), rng.choice(["1 Maple Street, X", "1 maple st x", "77 Oak Road", "short", None, f"{i} Elm Street"])) for i in range(80)]
    df = spark.createDataFrame(rows, "entity_id int, name string, address string")
    none = spark.createDataFrame([], "a int, b int")
    pairs = M.lives_with(df, none).collect()
    ends = [x for p in pairs for x in (p.a, p.b)]
    members = {r.entity_id: (r.links, r.representative) for r in M.household_members(df).collect()}
    assert {k: n for k, (n, _) in members.items()} == {k: ends.count(k) for k in set(ends)} and len(pairs) > 30
    assert all(members[p.a][1] == members[p.b][1] == min(k for k, m in members.items() if m[1] == members[p.a][1]) for p in pairs)
    assert sorted(M.lives_with(df, none, 5).collect()) == sorted(pairs)
    assert M.household_members(df.limit(0)).count() == 0 and M.household_members(df.filter(F.col("address") == "short")).count() == 0
