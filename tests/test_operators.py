"""Small cases, one for each rule that is easy to get wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import rules
import plain_ratios
from tessera.functions import similarity as sim
from tessera.functions import text as tx
from tessera.operators import claims as C
from tessera.operators import extract as X
from tessera.operators import graph as G
from tessera.operators import resolve as M
from tessera.operators import retrieve as R
from tessera.operators import temporal as T
from tessera.operators.components import connected_components


def values(spark, make, *inputs):
    df = spark.createDataFrame([(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(inputs)], "i int, " + make[0])
    return [r[0] for r in df.orderBy("i").select(make[1]().alias("v")).collect()]


def test_claim_status_bands(spark):
    cases = [(0.0, 0.0), (100.0, 95.0), (101.0, 0.0), (100.0, 0.0), (301.0, 100.0), (300.0, 100.0), (1000.0, 600.0)]
    got = values(spark, ("a double, b double", lambda: C.claim_status(F.col("a"), F.col("b"))), *cases)
    assert got == ["PAID", "PAID", "DENIED_NO_PA", "PARTIAL", "PENDING_P2P", "PARTIAL", "PARTIAL"]


def test_open_payer_wins(spark):
    rows = spark.createDataFrame([("p", "a", 2010, 2019), ("p", "b", 2015, None), ("p", "c", 2019, 2021)], "patient string, payer string, start_year int, end_year int")
    assert C.current_payers(rows).first()["payer"] == "b"


def test_worst_claim_is_the_oldest_of_its_status(spark):
    d = dt.date
    rows = spark.createDataFrame([("p", "PAID", d(2022, 1, 1), 1), ("p", "DENIED_NO_PA", d(2021, 1, 1), 2), ("p", "DENIED_NO_PA", d(2019, 1, 1), 3)], "patient string, status string, date date, n int")
    assert C.worst_claims(rows, ["n"]).first()["n"] == 3
    assert C.worst_claims(rows, ["n"], newest=True).first()["n"] == 2


def test_provider_names(spark):
    assert values(spark, ("a string", lambda: tx.provider_name(F.col("a"))), "Maile198 Frami345", "", None) == ["Dr. Maile Frami", "Unknown Provider", "Unknown Provider"]


def test_offsets(spark):
    row = spark.createDataFrame([("AB\n\nC",)], "a string").select(tx.lines(F.col("a")), tx.line_offsets(F.col("a")), tx.paragraphs(F.col("a"))).first()
    assert [list(x) for x in row] == [["AB", "", "C"], [0, 3, 4], ["AB", "C"]]


def test_canonical_names(spark):
    assert values(spark, ("a string", lambda: tx.canonical_name(F.col("a"))), "James Robert Lee", "Mei Lee", " ") == ["james lee", "mei lee", ""]


def test_dates(spark):
    d = dt.date
    got = values(spark, ("a string", lambda: tx.parse_date(F.col("a"))), "1992-03-15", "03/15/1992", "15/03/1992", "March 15, 1992", "204", "", None, "1992-03-15T10:00:00")
    assert got == [d(1992, 3, 15)] * 4 + [None, None, None, d(1992, 3, 15)]


def test_age(spark):
    got = values(spark, ("a date, b date", lambda: tx.age(F.col("a"), F.col("b"))), (dt.date(2000, 6, 15), dt.date(2024, 6, 14)), (dt.date(2000, 6, 15), dt.date(2024, 6, 15)), (None, dt.date(2024, 1, 1)))
    assert got == [23, 24, 0]


def test_addresses(spark):
    got = values(spark, ("a string", lambda: tx.normalize_address(F.col("a"))), "204 Maple Street, Vancouver, BC, V6B 2W9", "204 Maple St., Vancouver BC V6B2W9", None)
    assert got == ["204 maple street vancouver bc", "204 maple street vancouver bc", ""]


def test_json_in_noise(spark):
    got = values(spark, ("a string", lambda: tx.json_in(F.col("a"))), '```json\n{"a": 1}\n```', "none", "{broken")
    assert got == ['{"a": 1}', None, None]


def test_lines_and_paragraphs(spark):
    df = spark.createDataFrame([("One\nTwo\n\nthree TWO",)], "a string")
    row = df.select(tx.line_with(tx.lines(F.col("a")), F.lit("two")), tx.line_with(tx.lines(F.col("a")), F.lit("zzz")), tx.paragraph_of_line(F.col("a"), F.lit(4))).first()
    assert list(row) == [2, None, 2]


def test_intents(spark):
    got = values(spark, ("a string", lambda: rules.intent(F.col("a"))), "why was my claim denied", "how much do I owe", "can I eat", "got a bill", "hi")
    assert got == ["claim_status", "cost_estimate", "pre_procedure", "bill_explain", "general"]


def test_open_ended_by_whole_words(spark):
    assert values(spark, ("a string", lambda: rules.is_open_ended(F.col("a"))), "count them", "my account", "How many licenses?") == [True, False, True]


def test_fields_of_a_passport(spark):
    text = "REPUBLIC\n} ss MORVANTA\\\n»  TESSAMO om\nP<INDMORVANTAJ<<TESSAMO<<<<\nWO462878<71ND0301039M3207110\n"
    fields = rules.extract_fields(F.col("a"))
    row = spark.createDataFrame([(text,)], "a string").select(*[c.alias(k) for k, c in fields.items()]).first()
    assert (row["nationality"], row["passport_number"], row["dob"], row["expiry_date"]) == ("Indian", "WO462878", "01/03/2003", "07/11/2032")


def test_dates_by_year(spark):
    fields = rules.extract_fields(F.col("a"))
    row = spark.createDataFrame([("11/07/2032 12/07/2022 01/03/1990",)], "a string").select(fields["dob"].alias("d"), fields["issue_date"].alias("i"), fields["expiry_date"].alias("e")).first()
    assert list(row) == ["01/03/1990", "12/07/2022", "11/07/2032"]


def test_doc_types(spark):
    got = values(spark, ("a string", lambda: rules.doc_type(F.col("a"))), "Driver licence", "Travel document", "The father of", "my policy", "the clinic", "01/02/2020 in NY", "01/02/2020", "")
    assert got == ["DRIVERS_LICENSE", "PASSPORT", "BIRTH_CERTIFICATE", "INSURANCE", "MEDICAL_RECORD", "DRIVERS_LICENSE", "GENERIC", "GENERIC"]


def test_string_ratios():
    assert plain_ratios.indel_ratio("abc", "abc") == 1.0
    assert plain_ratios.indel_ratio("abcd", "bcde") == pytest.approx(0.75)
    assert plain_ratios.token_ratio("Lee James", "james lee") == 1.0
    assert plain_ratios.token_ratio("james lee", "james lee junior") == 1.0
    for a, b in (("mei lee", "mei li"), ("a b c", "c d"), ("", "x")):
        assert plain_ratios.token_ratio(a, b) == plain_ratios.token_ratio(b, a)


def test_cosine(spark):
    got = values(spark, ("a array<double>, b array<double>", lambda: sim.cosine(F.col("a"), F.col("b"))), ([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([1.0], [1.0, 2.0]), ([0.0], [1.0]), (None, [1.0]))
    assert got == [1.0, 0.0, 0.0, 0.0, 0.0]


def entities(spark, rows):
    return spark.createDataFrame(rows, "entity_id int, name string, entity_type string, source_doc_id string, dob date, embedding array<double>")


def test_resolution_gates(spark):
    d = dt.date
    v = [1.0, 0.0]
    rows = [(1, "Mei Lee", "PERSON", "a", d(1990, 1, 1), v), (2, "mei lee", "PERSON", "b", d(1990, 1, 4), v), (3, "Mei Lee", "PERSON", "c", d(1990, 1, 9), v), (4, "Mei Lee", "PERSON", "a", d(1990, 1, 1), v), (5, "James Walker", "PERSON", "d", d(1990, 1, 1), v)]
    got = {(r["id_a"], r["id_b"]) for r in M.score_pairs(M.candidate_pairs(entities(spark, rows))).collect()}
    assert got == {(1, 2), (2, 4)}


def test_fuzzy_resolution(spark):
    rows = [(1, "Mei Ling Lee", "PERSON", "a", None, [1.0]), (2, "Mei Lin Lee", "PERSON", "b", None, [1.0])]
    assert M.score_pairs(M.candidate_pairs(entities(spark, rows))).count() == 0
    assert M.score_pairs(M.candidate_pairs(entities(spark, rows)), sim.fuzzy_name_score).count() == 1


def test_conflicts(spark):
    rows = [(1, "dob", "1990-01-01", "a"), (2, "dob", "01/02/1990", "b"), (1, "address", "1 Old Street", "a"), (2, "address", "2 New Street", "b"), (1, "registration_number", "x", "a"), (2, "registration_number", "y", "b"), (1, "expiry_date", "2020-01-01", "a"), (2, "expiry_date", "2021-01-01", "b"), (1, "name", "Mei N. Lee", "a"), (2, "name", "Mei Lee", "b")]
    links = spark.createDataFrame([(1, 2)], "id_a int, id_b int")
    attributes = spark.createDataFrame(rows, "entity_id int, key string, value string, source string")
    got = {(r["attribute_key"], r["severity"]) for r in M.contradictions(links, attributes).collect()}
    assert got == {("dob", "critical"), ("address", "minor")}
    edge = M.conflict_edges(M.contradictions(links, attributes)).first()
    assert (edge["n"], edge["headline"], edge["critical"]) == (2, "address_mismatch", True)


def test_a_conflict_hides_its_link(spark):
    links = spark.createDataFrame([(1, 2), (2, 3)], "a int, b int")
    hidden = spark.createDataFrame([(2, 1)], "a int, b int")
    assert [tuple(r) for r in G.without_conflicts(links, hidden).collect()] == [(2, 3)]


def test_households(spark):
    rows = [(1, "Mei Lee", "204 Maple St., Vancouver"), (2, "MEI LEE", "204 maple st vancouver"), (3, "Jo Lee", "204 Maple Street Vancouver"), (4, "A", "1 A St"), (5, "B", "1 A St")]
    df = spark.createDataFrame(rows, "entity_id int, name string, address string")
    found = M.households(df).collect()
    assert [(r["member_count"], r["address"]) for r in found] == [(2, "204 Maple St., Vancouver")]
    assert M.lives_with(df, spark.createDataFrame([], "a int, b int")).count() == 1
    assert M.lives_with(df, spark.createDataFrame([(3, 1)], "a int, b int")).count() == 0


def test_components_do_not_depend_on_order(spark):
    edges = [(1, 2), (3, 2), (4, 5), (5, 5), (6, 4), (2, 1), (9, 8), (8, 7)]
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7, 8: 7, 9: 7}
    for e in (edges, [(b, a) for a, b in reversed(edges)]):
        assert {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(e, "a long, b long")).collect()} == want
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r["component"] for r in connected_components(chain).collect()} == {0}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_search_depth(spark):
    links = spark.createDataFrame([(i, i + 1, 0.9) for i in range(6)] + [(0, 9, 0.1)], "a long, b long, confidence double")
    seeds = spark.createDataFrame([(0,)], "id long")
    got = {r["id"]: r["depth"] for r in G.expand(seeds, links, 3).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3}
    for hops in (0, 6):
        with pytest.raises(ValueError):
            G.expand(seeds, links, hops)


def test_page_rank(spark):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "id long")
    edges = spark.createDataFrame([(0, 1), (0, 2)], "a long, b long")
    got = {r["id"]: r["rank"] for r in G.page_rank(nodes, edges).collect()}
    assert sum(got.values()) == pytest.approx(1)
    assert got[1] == pytest.approx(got[2])
    assert got[0] > got[1] > got[3]
    assert G.page_rank(spark.createDataFrame([], "id long"), edges).count() == 0


def test_temporal(spark):
    d = dt.date
    rows = spark.createDataFrame([(1, d(2015, 1, 1), 1), (2, d(2022, 1, 1), 2), (3, None, 3), (4, d(2022, 1, 1), 4)], "id int, date date, ord int")
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1)], "node int, component int")
    assert [r["id"] for r in T.filter_entities(rows, "current", groups).collect()] == [2]
    assert [r["id"] for r in T.filter_entities(rows, "2020-01-01").collect()] == [1]
    assert T.filter_entities(rows, "all").count() == T.filter_entities(rows, "other").count() == 4


def test_packing_stops_at_the_first_overflow(spark):
    words = lambda tokens: " ".join(["w"] * int(tokens * 0.75))
    def docs(*sizes):
        return spark.createDataFrame([(i, 9 - i, words(s)) for i, s in enumerate(sizes)], "doc_id int, score int, text string")
    assert [r["doc_id"] for r in R.pack_context(docs(8, 4, 4), "score", "doc_id", 10).collect()] == [0]
    assert [r["doc_id"] for r in R.pack_context(docs(48), "score", "doc_id", 10).collect()] == [0]


def test_chunks(spark):
    import math

    angles = [0.0]
    for c in (0.9, 0.5, 0.8):
        angles.append(angles[-1] + math.acos(c))
    rows = spark.createDataFrame([("d", i, i + 1, f"p{i + 1}", [math.cos(a), math.sin(a)]) for i, a in enumerate(angles)], "doc string, pos int, page int, text string, embedding array<double>")
    got = sorted((r["chunk"], r["start_page"], r["end_page"], r["text"]) for r in R.chunk_texts(R.chunks(rows, "doc", "pos"), "doc", "pos").collect())
    assert got == [(0, 1, 2, "p1\n\np2"), (1, 3, 4, "p3\n\np4")]


def test_person_questions(spark):
    people = spark.createDataFrame([("Mei Lee",), ("Mei Johnson",), ("Omar Wu",), ("James Robert Walker",)], "name string")
    kind = lambda q: R.response_type(R.person_matches(people, q)).first()["type"]
    assert kind("what is the address of Mei Lee") == "answer"
    assert kind("tell me about Mei") == "disambiguation"
    assert kind("nobody here zzz") == "not_found"


def test_field_entities(spark):
    made = "map('name', named_struct('value', ' Mei Lee ', 'confidence', 0.9D), 'dob', named_struct('value', '', 'confidence', 0.4D))"
    rows = spark.sql(f"SELECT 'DRIVER_LICENSE' AS document_type, 0.5D AS confidence, 'f' AS source_file, {made} AS fields")
    r = X.entities_from_fields(rows).first()
    assert (r["doc_type"], r["name"], r["confidence"], r["doc_date"], dict(r["attributes"])) == ("DRIVERS_LICENSE", "Mei Lee", 0.65, None, {"name": "Mei Lee"})


def test_merged_maps(spark):
    r = spark.sql("SELECT map('a', '1', 'b', ' ', '_x', 'p') AS x, map('a', '2', 'c', '') AS y").select(X.merged(F.col("x"), F.col("y")).alias("m")).first()
    assert dict(r["m"]) == {"a": "2", "_x": "p"}


def test_similar_pairs_match_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist(), i % 3) for i in range(60)]
    got = {(r["a"], r["b"]) for r in M.similar_pairs(spark.createDataFrame(rows, "id long, embedding array<double>, label int"), 0.5, blocks_of=5).collect()}
    cos = lambda x, y: np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)
    assert got == {(i, j) for i, x, p in rows for j, y, q in rows if i < j and p == q and cos(x, y) >= 0.5}


def test_texts_without_words_take_no_place_in_the_budget(spark):
    df = spark.createDataFrame([(i, " \n" if i < 30 else "one two", -i) for i in range(40)], "doc_id int, text string, score int")
    got = sorted((r["position"], r["doc_id"]) for r in R.pack_context(df, "score", "doc_id", 6).collect())
    assert got == [(i + 1, i) for i in range(32)]


def test_fuzzy_pairs_of_unlike_surnames(spark):
    rows = [(1, "Ann Johnson", "PERSON", "a", None, [1.0, 0.0]), (2, "Ann Jonson", "PERSON", "b", None, [1.0, 0.0]), (3, "Ann Miller", "PERSON", "c", None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "entity_id int, name string, entity_type string, source_doc_id string, dob date, embedding array<double>")
    pairs = M.candidate_pairs(df, score=sim.fuzzy_name_score)
    assert [(r["id_a"], r["id_b"]) for r in M.score_pairs(pairs, sim.fuzzy_name_score).collect()] == [(1, 2)]
    assert M.candidate_pairs(df).count() == 0


def test_search_for_many_questions_is_the_search_for_each(spark):
    big = 2**60 + 1
    people = [(big, " Ann Lee ", [1.0, 0.0]), (2, "ann", [0.6, 0.8]), (3, None, [1.0, 0.0]), (4, "", [1.0, 0.0]), (5, "Bob", None), (6, "Bob Ray", [0.0, 0.0]), (7, "Zoe", [1.0, 0.0, 0.0]), (8, "Zoe", [0.0, 1.0])]
    e = spark.createDataFrame(people, "entity_id long, name string, embedding array<double>")
    asked = [(big + 1, ["Ann Lee"], [1.0, 0.0]), (2, ["bob", "ZOE"], [0.0, 1.0]), (3, [], [0.6, 0.8]), (4, None, [1.0, 0.0]), (5, ["Nobody"], None)]
    q = spark.createDataFrame(asked, "question_id long, names array<string>, embedding array<double>")
    want = sorted((k, r["entity_id"], round(r["score"], 9)) for k, names, v in asked for r in R.find_entities(e, names or [], v).collect())
    for tile in (2, 100):
        got = R.search_entities(e, q, tile=tile).collect()
        assert sorted((r["question_id"], r["entity_id"], round(r["score"], 9)) for r in got) == want
    assert R.search_entities(e, q.limit(0)).count() == R.search_entities(e.limit(0), q).count() == 0


def test_patient_rows_have_all_fields(spark):
    from tessera.operators import extract as X
    from tessera.sources.files import PATIENT
    row = {"patient_id": "p1", "display_name": "Ann Lee", "dob": "1980-01-02", "age": 45, "gender": "F", "insurance": {"payer": "Acme", "member_since": "2001"}, "claim_summary": {"total_billed": 12345678.5, "total_covered": 10.0, "denied_claims": 2},
           "active_conditions": [{"code": "c1", "description": "Cough", "onset": " "}], "encounters": [{"encounter_id": "e1", "billed": 0.25, "claim_status": "DENIED"}]}
    rows = X.entities_from_patients(spark.createDataFrame([row, {"patient_id": "p2"}], PATIENT)).collect()
    got = {(r["patient_id"], r["record_type"]): (r["name"], r["attributes"]) for r in rows}
    assert len(rows) == len(got) == 4
    none = {"total_covered": "0", "total_owed": "0", "denied_claims": "0", "pending_claims": "0", "total_billed": "0"}
    assert got["p1", "person"] == ("Ann Lee", none | {"patient_id": "p1", "dob": "1980-01-02", "age": "45", "gender": "F", "insurance_payer": "Acme", "insurance_since": "2001", "total_billed": "12345678.5", "total_covered": "10.0", "denied_claims": "2", "active_conditions_count": "1", "encounters_count": "1"})
    assert got["p2", "person"] == ("Unknown", none | {"patient_id": "p2", "active_conditions_count": "0", "encounters_count": "0"})
    assert got["p1", "condition"] == ("Ann Lee", {"condition_code": "c1", "condition_description": "Cough", "record_type": "condition"})
    assert got["p1", "encounter"] == ("Ann Lee", {"encounter_id": "e1", "billed": "0.25", "covered": "0", "patient_owes": "0", "claim_status": "DENIED", "record_type": "encounter"})
