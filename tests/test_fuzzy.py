"""Fuzzy ratios and the candidate search, against plain forms that compare all."""

import datetime as dt
import random

import plain_ratios
import pytest
from pyspark.sql import functions as F

from tessera.functions import similarity as sim
from tessera.operators import candidates
from tessera.operators import resolve as M

WORDS = ["ann", "anne", "johnson", "jonson", "lee", "li", "müller", "muller", "o'neil", "smith", "smyth", "de", "la", "cruz"]
SURNAMES = ["johnson", "jonson", "miller", "millar", "smith", "smyth", "garcia", "garza", "x" * 38, "x" * 41, "y" * 60, "wordsworthington", "a", "ab", "abc", "aab", "müller"]


def names(rng, n):
    for _ in range(n):
        kind = rng.random()
        yield "" if kind < 0.05 else " ".join(rng.choice([*WORDS, "x" * 70, "ab" * 40]) for _ in range(rng.randint(5, 9))) if kind < 0.1 else " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4)))


def misspelt(rng, word):
    w = list(word)
    for _ in range(rng.randint(0, 3)):
        i = rng.randrange(len(w) + 1)
        if rng.random() < 0.5:
            w.insert(i, rng.choice("abcxé"))
        elif len(w) > 1:
            w.pop(min(i, len(w) - 1))
    return "".join(w)


@pytest.mark.parametrize(
    ("column", "plain"),
    [(sim.indel_ratio, plain_ratios.indel_ratio), (sim.token_ratio, plain_ratios.token_ratio), (sim.partial_ratio, plain_ratios.partial_ratio), (sim.weighted_ratio, plain_ratios.weighted_ratio), (sim.fuzzy_query_score, lambda a, b: plain_ratios.blended_score(a, b) if a else 0.0)],
)
def test_ratios_are_the_plain_ones(spark, column, plain):
    rng = random.Random(1)
    rows = list(zip(names(rng, 300), names(rng, 300), strict=True))
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.withColumn("score", column(F.col("a"), F.col("b"))).collect():
        assert r.score == pytest.approx(plain(r.a, r.b), abs=1e-12), (r.a, r.b)


def test_ratios_of_nulls(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), (None, None)], "a string, b string")
    got = df.select(sim.fuzzy_name_score(F.col("a"), F.col("b")), sim.fuzzy_query_score(F.col("a"), F.col("b")), sim.fuzzy_weighted_score(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (1.0, 0.0, 0.0)]


@pytest.mark.parametrize("least", [0.85, 0.6])
@pytest.mark.parametrize("rows", [2048, 3])
def test_similar_words_are_those_of_all_pairs(spark, least, rows):
    rng = random.Random(5)
    words = [misspelt(rng, rng.choice(SURNAMES)) for _ in range(250)] + ["", None]
    got = {(r.word_a, r.word_b) for r in candidates.similar_words(spark.createDataFrame([(w,) for w in words], "word string"), least, rows=rows).collect()}
    own = sorted({w for w in words if w})
    assert got == {(a, b) for i, a in enumerate(own) for b in own[i + 1 :] if plain_ratios.indel_ratio(a, b) >= least}


def test_needed_pairs_are_never_too_many():
    """Any two words that reach the ratio share at least as many character pairs as asked for."""
    rng = random.Random(9)

    def pairs(w):
        w = f"^{w}^"
        seen = {}
        return {(w[i : i + 2], seen.setdefault(w[i : i + 2], []).append(i) or len(seen[w[i : i + 2]])) for i in range(len(w) - 1)}

    for _ in range(4000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        b = misspelt(rng, a)
        for least in (0.5, 0.7, 0.85, 0.95):
            if plain_ratios.indel_ratio(a, b) >= least:
                assert 0 <= candidates.needed(len(a), len(b), least) <= len(pairs(a) & pairs(b))


def test_frequent_keys_are_cut_into_tiles(spark):
    x = spark.createDataFrame([(1, i) for i in range(100)] + [(2, 7), (None, 3)], "k int, a int")
    y = spark.createDataFrame([(1, i) for i in range(60)] + [(2, 8), (None, 4)], "k int, b int")
    p, q, keys = candidates.tiled(x, y, ["k"], 20)
    assert p.groupBy(*keys).count().agg(F.max("count")).first()[0] <= 40
    joined = p.join(q, keys).select("k", "a", "b").collect()
    assert len(joined) == len(set(joined)) == 6001


@pytest.mark.parametrize("fuzzy", [False, True])
def test_links_are_those_of_all_pairs(spark, fuzzy):
    rng = random.Random(5)
    name = lambda i: f"{rng.choice(['ann', 'anna', 'bob', 'mei ling', 'li'])} {misspelt(rng, rng.choice(SURNAMES[:8]))}" if i % 17 else rng.choice([None, "", " "])
    rows = [(i, name(i), rng.choice(["PERSON", "PERSON", None, "X"]), rng.choice("abcd"), rng.choice([None, dt.date(1990, 1, 1 + rng.randrange(9))]), [rng.random() for _ in range(3)] if i % 13 else None) for i in range(150)]
    df = spark.createDataFrame(rows, "entity_id int, name string, entity_type string, source_doc_id string, dob date, embedding array<double>")
    score = sim.fuzzy_name_score if fuzzy else sim.name_score
    plain = lambda d: {tuple(r) for r in d.select("id_a", "id_b", F.round("name_score", 9), F.round("semantic_score", 9), F.round("confidence", 9)).collect()}
    want = plain(M.score_pairs(M.candidate_pairs(df.filter("trim(name) <> ''"), ["entity_type"], score), score, border_at=0.5))
    assert len(want) > 2
    for heavy, tile in ((10**6, 2048), (0, 5)):
        assert plain(M.linked(df, fuzzy, border_at=0.5, heavy=heavy, tile=tile)) == want
    assert M.linked(df.limit(0), fuzzy).count() == 0
