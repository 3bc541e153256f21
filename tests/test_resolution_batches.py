"""Resolution batch by batch gives what one batch of all rows gives, with stops between."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import resolve as M
from tessera.operators.components import connected_components
from tessera.sources import files
from tessera.streaming import resolution

SCHEMA = "entity_id int, name string, entity_type string, source_doc_id string, dob date, embedding array<double>, address string, attributes map<string,string>"


def people(n=70):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        name = rng.choice(["ann lee", "Ann Lee", "bob ray", "zoe", "Robert Ray", None])
        day = dt.date(1990, 1, 1 + rng.randrange(5))
        rows.append((i, name, "PERSON", rng.choice("abc"), rng.choice([day, None]), [1.0, rng.random() * 3], f"{rng.randrange(6)} Maple St., Vancouver", {"dob": str(day), "name": name or "", "policy_number": rng.choice(["1", "2", " "])}))
    return rows


def tables(state):
    out = {}
    for name in ("links", "components", "conflicts", "lives_with", "entities"):
        df = state.table(name)
        out[name] = sorted(map(repr, df.select(sorted(set(df.columns) - {"attributes", "embedding", "confidence", "semantic_score"})).collect()))
    return out


def test_batches_are_one_run(spark, tmp_path):
    rows = people()
    every = spark.createDataFrame(rows, SCHEMA)
    t = resolution.Thresholds(border_at=0.5)
    whole = resolution.State(spark, f"{tmp_path}/whole")
    assert resolution.apply(spark, whole.root, every, 0, t)
    links = M.linked(every, border_at=0.5)
    ends = links.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    assert sorted(map(tuple, whole.table("components").select("node", "component").collect())) == sorted(map(tuple, connected_components(ends).collect()))
    assert whole.table("links").count() == links.count() > 10 and whole.table("lives_with").count() > 10

    parts = resolution.State(spark, f"{tmp_path}/parts")

    class Stopped(Exception):
        pass

    def stop():
        raise Stopped

    order = [r for k in (2, 0, 1) for r in rows[k::3]]  # later ids may come first
    cuts = [order[:20], order[20:21], [], order[21:50] + order[:3], order[50:]]
    for batch, part in enumerate(cuts):
        df = spark.createDataFrame(part, SCHEMA)
        if batch in (0, 3):
            with pytest.raises(Stopped):
                resolution.apply(spark, parts.root, df.limit(2), batch, t, stop)  # stopped half-way, with other rows than come next
        assert resolution.apply(spark, parts.root, df, batch, t)
        assert not resolution.apply(spark, parts.root, df, batch, t)
    assert tables(parts) == tables(whole)


def test_files_that_arrive_are_resolved(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    card = "DRIVER LICENCE\nName: {}\nDate of birth: 1990-01-02\nAddress: 12 Maple Street, Vancouver"
    start = lambda: resolution.follow_files(files.landing_stream(spark, str(landing)), f"{tmp_path}/state", f"{tmp_path}/checkpoint", embedder=lambda texts: [[1.0, 0.5]] * len(texts)).awaitTermination()
    (landing / "a.txt").write_text(card.format("Mei Lin"))
    start()
    (landing / "b.txt").write_text(card.format("Mei Lin") + "\n")
    start()
    state = resolution.State(spark, f"{tmp_path}/state")
    assert len(state.batches()) == 2 and state.table("entities").count() == 2
    assert state.table("links").count() == 1
    start()
    assert state.table("entities").count() == 2
