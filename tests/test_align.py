"""Places of values in texts, against a search of each value apart."""

import random

from pyspark.sql import functions as F

from tessera.operators import align


def plain(text, value):
    at = text.lower().find(value.strip().lower())
    if at < 0:
        return (None,) * 5
    head = text[: at + 1]
    line = head.count("\n") + (0 if head.endswith("\n") else 1)
    return line, sum(bool(p.strip()) for p in head.split("\n\n")), at, at + len(value.strip()), text.split("\n")[line - 1]


def test_places_are_those_of_a_plain_search(spark):
    rng = random.Random(3)
    docs, values = [], []
    for d in range(40):
        text = "".join(rng.choice(["ab", "cd", "É", "x", " ", "\n", "\n\n", "\n\n\n", "  \n\n"]) for _ in range(rng.randint(0, 60)))
        docs.append((d, text))
        for k in range(rng.randint(0, 8)):
            value = rng.choice(["", " ", None, "zz", "é", "CDX"]) if rng.random() < 0.5 else text[(a := rng.randint(0, len(text))) : a + rng.randint(1, 6)].upper()
            if value is None or "\n" not in value.strip():
                values.append((d, f"k{k}", value))
    values += [(999, "lost", "x"), (0, "again", "x"), (0, "again", "x")]
    df = spark.createDataFrame(values, "doc_id int, key string, value string")
    got = sorted(map(repr, (tuple(r) for r in align.align(df, spark.createDataFrame([*docs, (50, None)], "doc_id int, text string")).collect())))
    texts = dict(docs)
    want = [(d, k, v.strip(), *(plain(texts[d], v) if d in texts else (None,) * 5)) for d, k, v in values if v and v.strip()]
    assert got == sorted(map(repr, want)) and len(want) > 60
    assert align.align(df.limit(0), spark.createDataFrame(docs, "doc_id int, text string")).count() == 0


def test_long_text_and_folding():
    text = "İstanbul " * 1000 + "Ends Here"
    rows = align.located(text, ["ends here", "İSTANBUL", "absent"])
    assert text[rows[0][2] : rows[0][3]] == "Ends Here" and rows[2] == (None,) * 5 and len(align.folded(text)) == len(text)


def test_facts_with_their_lines(spark):
    e = spark.createDataFrame([(1, "Ann", "d1", {"dob": "1990-01-02", "_x": "y", "city": "Ulm"}), (2, "Bob", "none", {"city": "ulm"})], "entity_id int, name string, source_doc_id string, attributes map<string,string>")
    docs = spark.createDataFrame([("d1", "Ann\n\nborn 1990-01-02\nin ULM")], "doc_id string, text string")
    got = {(r.entity_id, r.key): (r.line, r.paragraph, r.start, r.source_line) for r in align.aligned_facts(e, docs).collect()}
    assert got == {(1, "dob"): (3, 2, 10, "born 1990-01-02"), (1, "city"): (4, 2, 24, "in ULM"), (2, "city"): (None,) * 4}
    assert align.aligned_facts(e, docs.limit(0)).filter(F.col("line").isNotNull()).count() == 0
