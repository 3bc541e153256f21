"""Fuzzy scores, hooks, ingest from files, and ranks and components against plain Python."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tessera import hooks
import plain_ratios
from tessera.functions import similarity as sim
from tessera.functions import text as tx
from tessera.operators import components, graph
from tessera.operators import retrieve as R
from tessera.sources import files, ingest


def test_ratios():
    assert plain_ratios.partial_ratio("lee", "james lee") == 1.0 and plain_ratios.partial_ratio("", "") == 1.0 and plain_ratios.partial_ratio("", "a") == 0.0
    assert plain_ratios.weighted_ratio("james lee", "james lee") == 1.0 and plain_ratios.weighted_ratio("", "a") == 0.0
    assert plain_ratios.weighted_ratio("lee james", "james lee") == 0.95  # the same words
    assert plain_ratios.weighted_ratio("lee", "james robert lee") == pytest.approx(0.9)
    assert plain_ratios.blended_score("James Lee ", "james lee") == 1.0
    assert plain_ratios.blended_score("jonson", "johnson") == pytest.approx(0.7 * 12 / 13 + 0.3 * 10 / 12)  # 6 letters in order of 13; 5 of 6 and 6
    assert plain_ratios.blended_score("jonson", "walker") == 0.0


def test_fuzzy_questions_find_misspelt_names(spark):
    people = spark.createDataFrame([(1, "Mei Johnson", "p"), (2, "Omar Patel", "p"), (3, "Mei Jonson", None)], "id long, name string, insurance_payer string")
    found = {r["canon"]: r["band"] for r in R.person_matches(people, "what is the dob of mei jonsen", fuzzy=True).collect()}
    assert set(found) == {"mei johnson", "mei jonson"} and set(found.values()) == {"strong"}
    assert {r["canon"] for r in R.person_matches(people, "what is the dob of omar patel").collect()} == {"omar patel"}
    assert [r["id"] for r in R.best_person(people, "mei jonson", "id", sim.fuzzy_weighted_score).collect()] == [1]
    assert R.best_person(people, "zzz qqq", "id", sim.fuzzy_weighted_score).count() == 0


def test_blank_documents_cost_nothing(spark):
    """Whatever their scores, and however many there are."""
    rows = [(i, " " * (i % 3), 10.0) for i in range(3000)] + [(5000, "three words here", 1.0), (5001, "w " * 3000, 0.5), (5002, "late", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    for by in (None, ["one"]):
        got = {r["doc_id"] for r in R.pack_context(df.withColumn("one", F.lit("x")), "score", "doc_id", by=by).collect()}
        assert got == {*range(3000), 5000}
    many = spark.createDataFrame([(i, "w " * (i % 5 + 1), float(i * i % 977)) for i in range(3000)], "doc_id long, text string, score double")
    used, want = 0.0, set()
    for i in sorted(range(3000), key=lambda i: (-float(i * i % 977), i)):
        used += (i % 5 + 1) / 0.75
        if used > 500:
            break
        want.add(i)
    assert {r["doc_id"] for r in R.pack_context(many, "score", "doc_id", 500).collect()} == want


def test_offsets_of_many_lines(spark):
    for n in (1, 127, 128, 129, 3000):
        own = ["x" * (i % 7) for i in range(n)]
        got = spark.createDataFrame([("\n".join(own),)], "t string").select(tx.line_offsets(F.col("t"))).first()[0]
        assert got == [sum(map(len, own[:i])) + i for i in range(n)]


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB", 1000)
    rng = random.Random(1)
    edges = [(0, i) for i in range(1, 1500)] + [(9000, i) for i in range(5000, 6500)] + [(1499, 5000), (7, 7)] + [(rng.randint(10_000, 10_900), rng.randint(10_000, 10_900)) for _ in range(400)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(parent)}


def test_rank_with_lonely_nodes(spark):
    edges, n, d = [(0, 1), (0, 2), (2, 3), (3, 3)], 7, 0.85
    out = {i: [] for i in range(n)}
    for a, b in edges:
        out[a].append(b)
        out[b].append(a)
    rank = dict.fromkeys(range(n), 1 / n)
    for _ in range(8):
        loss = sum(rank[i] for i in rank if not out[i])
        rank = {i: (1 - d) / n + d * (sum(rank[j] / len(out[j]) for j in out for k in out[j] if k == i) + loss / n) for i in rank}
    got = dict(map(tuple, graph.page_rank(spark.range(n), spark.createDataFrame(edges, "a long, b long"), rounds=8, tolerance=None).collect()))
    assert got == pytest.approx(rank) and sum(got.values()) == pytest.approx(1)


@pytest.fixture
def model():
    class Names:  # made here, so that workers need not import this module
        name = "names"

        def complete(self, prompt, temperature=0.0):
            if "Nobody" in prompt:
                return " none "
            if "Broken" in prompt:
                raise RuntimeError
            return "Mei Lee, , Omar " if "List the names" in prompt else '{"name": "Mei Lee", "dob": "1990-01-02"}' if "JSON" in prompt else ""

    return Names


def test_hooks(spark, model):
    q = spark.createDataFrame([("Who is Mei?", "ctx"), ("Nobody here", " "), ("Broken", None)], "question string, context string")
    got = {r["question"]: r["names"] for r in hooks.names_asked(q, "question", model).collect()}
    assert got == {"Who is Mei?": ["Mei Lee", "Omar"], "Nobody here": [], "Broken": []}
    assert hooks.names_asked(q, "question").first()["names"] == ["mei?"[:3]]
    for make in (None, model):
        told = [r["answer"] for r in hooks.answers(q, "question", "context", make).orderBy(F.desc("question")).collect()]
        assert told[0] == "ctx" and told[2].startswith("I couldn't")
    assert hooks.fields_template({"a": "x", "b": "y"}) == '{\n  "a": null,\n  "b": null\n}'


def test_ingest(spark, tmp_path, model):
    for name, text in (("a.txt", "ARIZONA DRIVER LICENSE\nDL U12345678\nDOB 03/04/1992\nSEX M"), ("b.txt", "  \n")):
        (tmp_path / name).write_text(text)
    documents, entities = ingest.ingest(spark, str(tmp_path), folder=" Mei  O'Lee ")
    assert documents.count() == 2
    row = entities.collect()
    assert len(row) == 1 and row[0]["attributes"]["license_number"] == "U12345678" and row[0]["attributes"]["_person_folder"] == "mei_o_lee"
    assert 0 < row[0]["confidence"] <= 1 and row[0]["source_doc_id"] in {r["doc_id"] for r in documents.collect()}
    _, told = ingest.ingest(spark, str(tmp_path), lambda d: ingest.by_model(d, make=model))
    assert {(r["name"], r["doc_date"]) for r in told.collect()} == {("Mei Lee", "1990-01-02")}
    os.makedirs(tmp_path / "none")
    with pytest.raises(ValueError):
        ingest.ingest(spark, str(tmp_path / "none"))
    status = {os.path.basename(r["path"]): r["status"] for r in ingest.upload_status(spark, [str(tmp_path / x) for x in ("a.txt", "b.txt", "c.txt", "d.pdf")]).collect()}
    assert status == {"a.txt": "ok", "b.txt": "empty", "c.txt": "missing", "d.pdf": "unsupported"}
    assert {r["source"] for r in ingest.person_files(spark, str(tmp_path)).collect()} == {"text"}
    assert ingest.safe_folder("...") == "unknown"


def test_pages_become_chunks_and_entities(spark):
    rows = [("in/mei_lee/x.pdf", 1, "Clinic\nPatient Name: Mei Lee\nDate of Birth: March 15, 1992\n\nFirst part."), ("in/mei_lee/x.pdf", 2, "Second part."), ("in/omar_x/y.pdf", 1, "No header."), ("in/omar_x/y.pdf", 2, None)]
    chunks, entities = ingest.paged(spark, spark.createDataFrame(rows, "source string, page_number int, text string"))
    found = {(r["name"], r["attributes"].get("dob")) for r in entities.collect()}
    assert found == {("Mei Lee", "March 15, 1992"), ("Omar X", None)}
    assert chunks.count() == entities.count() >= 2 and chunks.filter("start_page > end_page").count() == 0


def test_any_specialty_is_drawn(spark):
    texts = spark.createDataFrame([(s, f"{s} {i}") for s, n in (("a", 5), ("b", 20), ("c", 10)) for i in range(n)], "specialty string, text string")
    people = files.people(spark, 60)
    got = files.assigned_texts(people, texts, {}, people.filter("id < 10").select("id")).collect()
    assert len(got) == 50 and {r["specialty"] for r in got} == {"a", "b", "c"} and all(r["text"].startswith(r["specialty"]) for r in got)
