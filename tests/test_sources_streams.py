"""Sources, sinks, hooks, and calls in a stream and in a table."""

import json

import pytest
from pyspark.sql import functions as F

from tessera import hooks
from tessera.plans import catalogue
from tessera.sources import files, sinks
from tessera.streaming import conversation as V


def test_text_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.txt").write_text("AB\n\nC")
    (tmp_path / "b.txt").write_text(" \n")
    (tmp_path / "c.md").write_text("no")
    (tmp_path / "in" / "d.txt").write_text("deep")
    flat = {r["filename"]: r for r in files.text_documents(spark, f"file://{tmp_path}").collect()}
    assert set(flat) == {"a.txt", "b.txt"}
    assert flat["b.txt"]["empty"] and list(flat["a.txt"]["line_offsets"]) == [0, 3, 4]
    assert files.text_documents(spark, f"file://{tmp_path}", recursive=True).count() == 3
    again = files.text_documents(spark, f"file://{tmp_path}")
    assert {r["doc_id"] for r in again.collect()} == {r["doc_id"] for r in flat.values()}
    with pytest.raises(ValueError):
        files.text_documents(spark, [])
    listed = files.listing(spark, f"file://{tmp_path}")
    assert {r["name"] for r in listed.collect()} == {"a.txt", "b.txt", "d.txt"}
    seen = listed.filter("name = 'a.txt'").select("path")
    assert files.not_yet_read(listed.unionByName(listed), seen).count() == 2


def test_records(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "1.json").write_text(json.dumps({"patient_id": "x", "encounters": [{"date": "2020-01-01", "billed": 3.5}]}))
    (tmp_path / "p" / "2.json").write_text(json.dumps({"other": 1}))
    rows = files.patient_records(spark, f"file://{tmp_path}/p").collect()
    assert [(r["patient_id"], r["encounters"][0]["billed"]) for r in rows] == [("x", 3.5)]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "1.json").write_text(json.dumps({"document_type": "PASSPORT", "fields": {"name": {"value": "A", "confidence": 0.5}}}))
    (tmp_path / "f" / "2.json").write_text("{broken")
    assert files.field_documents(spark, f"file://{tmp_path}/f").count() == 1
    (tmp_path / "m.csv").write_text('medical_specialty,transcription\nA,"two\nlines"\nB, \n')
    assert [r["text"] for r in files.transcriptions(spark, f"file://{tmp_path}/m.csv").collect()] == ["two\nlines"]
    assert files.csv_table(spark, f"file://{tmp_path}/m.csv").dtypes == [("medical_specialty", "string"), ("transcription", "string")]


def test_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|")
    (tmp_path / "b.pdf").write_bytes(b"\xff")
    got = files.pages(spark, f"file://{tmp_path}", lambda raw: raw.decode().split("|")).collect()
    assert sorted((r["page_number"], r["text"], r["error"] is None) for r in got) == [(0, None, False), (1, "one", True), (2, "", True)]


def test_generated_people(spark):
    people = files.people(spark, 40)
    assert people.filter("contradiction").count() == 10
    assert people.filter("contradiction and datediff(insurance_dob, dob) <> 1").count() == 0
    texts = files.generated_texts(people)
    assert texts.count() == files.generated_fields(people).count() == people.select(F.explode("documents")).count()
    assert people.exceptAll(files.people(spark, 40)).count() == 0
    names = files.pseudonyms(spark.range(250), "id")
    assert names.select("name").distinct().count() == 250


def test_assigned_texts(spark):
    people = files.people(spark, 12).select("id", "name")
    texts = spark.createDataFrame([("A", "a1"), ("A", "a2"), ("B", "b1")], "specialty string, text string")
    some = people.first()["name"]
    done = spark.createDataFrame([(0,)], "id long")
    rows = files.assigned_texts(people, texts, {some: "B"}, done).collect()
    assert len(rows) == 11 and all(r["specialty"] == "B" for r in rows if r["name"] == some)
    assert {r["specialty"] for r in rows if r["name"] != some} == {"A", "B"}  # any text where none is preferred


def test_saved_graph(spark, tmp_path):
    documents = spark.createDataFrame([("d", "x")], "id string, text string")
    entities = spark.createDataFrame([("e", [1.0])], "id string, embedding array<double>").withColumn("at", F.lit("2020-01-01").cast("date"))
    edges = spark.createDataFrame([("e", "d")], "a string, b string")
    sinks.write_graph(documents, entities, edges, f"file://{tmp_path}/g")
    back = files.graph_tables(spark, f"file://{tmp_path}/g")
    assert back["entities"].first()["id"] == "e"
    lines = [json.loads(r["line"]) for r in sinks.graph_lines(entities, edges).collect()]
    assert lines == [{"kind": "node", "value": {"id": "e", "at": "2020-01-01"}}, {"kind": "edge", "value": {"a": "e", "b": "d"}}]
    records = spark.createDataFrame([("f1", 1), ("f2", 2)], "folder string, n int")
    sinks.write_records(records, f"file://{tmp_path}/r")
    assert spark.read.json(f"file://{tmp_path}/r").count() == 2


def test_hooks(spark):
    class Picky:
        name = "picky"

        def complete(self, prompt, temperature=0.0):
            if "bad" in prompt:
                raise RuntimeError("no")
            return prompt.upper()

    rows = spark.createDataFrame([("a",), ("a",), ("bad",), (None,)], "p string")
    got = sorted(((r["p"], r["reply"], r["reply_error"] is None) for r in hooks.complete(rows, "p", Picky).collect()), key=repr)
    assert got == [("a", "A", True), ("a", "A", True), ("bad", "", False), (None, None, True)]
    vectors = hooks.embed(rows, "p").collect()
    assert len(vectors) == 4 and all(len(r["embedding"]) == hooks.DIMENSIONS for r in vectors if r["p"])
    assert hooks.hashed_embedding("a b") == hooks.hashed_embedding("B A")
    with pytest.raises(ValueError):
        hooks.provider("nobody")


TURNS = [(1, 0, "hi"), (1, 1, "I am Mei Lee"), (1, 2, "can I eat"), (1, 3, "why was my claim denied"), (1, 4, "hello"), (2, 0, "some body"), (2, 1, "other body"), (3, 0, "goodbye"), (4, 0, "the Lee one"), (4, 1, "mei lee please")]


def calls(spark, path=None):
    df = spark.createDataFrame(TURNS, "call_id long, turn long, text string")
    lookups = lambda d: d.withColumns({"match_type": F.when(F.col("call_id") == 1, "answer").when(F.col("call_id") == 4, "disambiguation").otherwise("not_found"), "person": F.when(F.col("call_id") == 1, "Mei Lee").otherwise(""), "options": F.array(F.lit("Mei Lee"), F.lit("Jo Lee")), "answer": F.lit("No food.")})
    if path is None:
        return lookups(df)
    for part in (0, 1, 2):
        df.filter(f"turn div 2 = {part}").coalesce(1).write.mode("append").parquet(path)
    return lookups(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 10).parquet(path))


WANT = {(1, 0): ("verify_identity", "agent_response"), (1, 1): ("answering", "patient_identified"), (1, 2): ("answering", "tool_result"), (1, 3): ("end_call", "three_phase_queued"), (1, 4): ("end_call", "ignored"), (2, 0): ("verify_identity", "agent_response"), (2, 1): ("end_call", "patient_not_found"), (3, 0): ("end_call", "call_ended"), (4, 0): ("verify_identity", "agent_response"), (4, 1): ("answering", "patient_identified")}


def test_replayed_calls(spark):
    got = V.replay(calls(spark))
    assert {(r["call_id"], r["turn"]): (r["state"], r["event"]) for r in got.collect()} == WANT
    assert [r["event"] for r in V.phase_events(got).orderBy("second").collect()] == V.PHASES
    assert got.select(V.reply_xml().alias("x")).first()["x"].startswith("<Response><Say>")


def test_streamed_calls_are_as_replayed(spark, tmp_path):
    got = []
    query = V.stream(calls(spark, f"file://{tmp_path}/turns")).writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination(120)
    query.stop()
    assert {(r["call_id"], r["turn"]): (r["state"], r["event"]) for r in got} == WANT


def test_landing_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Driver licence")
    got = []
    q = sinks.broadcast_events(files.landing_stream(spark, f"file://{tmp_path}/in"), lambda df, _: got.extend(df.collect()), f"file://{tmp_path}/c")
    q.awaitTermination(120)
    q.stop()
    assert [r["doc_type"] for r in got] == ["DRIVERS_LICENSE"]


def test_the_entry_names_no_query_without_a_callable():
    assert all(map(callable, catalogue.queries().values()))
