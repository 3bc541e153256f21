"""What grows with the input is read, sent and joined as few times as the job asks for."""

import numpy as np
import pandas as pd
import pytest

from tessera.operators import graph, vectors
from tessera.plans import claims

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("query", [claims.claim_status_per_patient, claims.claim_status_answer])
def test_claims_are_read_once(spark, query):
    assert plan(query(spark, SF)).count("l_orderkey#") and plan(query(spark, SF)).count("Relation [l_orderkey") == 1


def test_questions_are_sent_in_pieces(spark, monkeypatch):
    """A batch of what is sent has at most as many rows as a piece, however many cells a question goes to."""
    monkeypatch.setattr(vectors, "PIECE", 8)
    sent = {}
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    index = vectors.fit(df)

    class Asked:
        sparkSession = spark

        def select(self, *columns):
            return self

        def mapInPandas(self, send, schema):
            sent["batches"] = list(send(iter([pd.DataFrame({"question_id": [str(i) for i, _ in rows], "embedding": [v for _, v in rows]})])))

    vectors._asked(index, Asked(), None, 1024)
    assert max(map(len, sent["batches"])) <= 8
    assert sum(map(len, sent["batches"])) == 200 * sum(int((w >= 0).sum()) for w in index.widest.values())


def test_links_of_a_rank_are_dealt_without_a_join(spark, monkeypatch):
    """What is written of the links is each of them once, one way."""
    written = {}
    real = graph.materialize

    def kept(df, name):
        out = real(df, name)
        written.setdefault(name, out.count())
        return out

    monkeypatch.setattr(graph, "materialize", kept)
    edges = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    rank = graph.page_rank(spark.range(1, 5), edges, rounds=5)
    assert written["rank-links"] == 2
    assert abs(sum(r["rank"] for r in rank.collect()) - 1) < 1e-9
