"""Retrieval: entity search, ranked packing, chunks, provenance, and question routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import rules
from tessera.functions import similarity as sim
from tessera.functions import text as tx
from tessera.storage import materialize, shuffled

from . import vectors
from .candidates import tiled

# Search thresholds, weights, the context's budget, bands of person matches.
SEARCH_AT, FALLBACK_AT, HELD_SCORE = 0.20, 0.10, 0.85
RELEVANCE_VECTOR, RELEVANCE_RANK = 0.6, 0.4
BUDGET = int(0.9 * 4096)
CHUNK_AT = 0.75
STRONG, WEAK, SPREAD, SUGGEST_ABOVE, PAIR_BONUS = 0.75, 0.50, 0.10, 0.25, 1.10
SUGGESTIONS, FACTS, NAMES, PERSON_MATCH = 3, 5, 15, 0.60


def find_entities(entities: DataFrame, names: list[str], vector: list[float] | None, threshold: float = SEARCH_AT) -> DataFrame:
    """Entities by half of the best name score and half of the cosine, best first.

    A name that holds the entity's, or is held by it, scores at least 0.85; an entity without a name matches none.
    """
    own = F.lower(tx.strip(F.col("name")))
    named, held = F.lit(0.0), F.lit(False)
    for n in names:
        named = F.greatest(named, sim.name_score(F.lit(n), F.col("name")))
        held = held | ((own != "") & (F.contains(own, F.lower(F.lit(n))) | F.contains(F.lower(F.lit(n)), own)))
    meaning = sim.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in vector])) if vector else F.lit(0.0)
    score = 0.5 * named + 0.5 * meaning
    scored = entities.withColumn("score", F.when(held, F.greatest(score, F.lit(HELD_SCORE))).otherwise(score))
    return scored.filter(F.col("score") >= threshold)


def name_matches(asked: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct (asked, name, named, held) of which one holds the other, both lower-case: found by a shared piece of three letters.

    ``asked``: raw (lower-case as asked) and bare (stripped); ``names``: name (lower-case, stripped). A name that is held has its
    rarest piece in the other, so it is looked up by that alone; names of one or two letters are pieces themselves.
    """
    pieces = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    every = lambda c: F.array_distinct(F.concat(pieces(c, 1), pieces(c, 2), pieces(c, 3)))
    own = lambda c: F.when(F.length(c) >= 3, pieces(c, 3)).when(F.length(c) == 2, pieces(c, 2)).otherwise(pieces(c, 1))
    q = materialize(asked.filter("bare is not null").select("raw", "bare").distinct(), "asked-names")
    e = materialize(names.filter("name is not null").select("name").distinct(), "known-names")
    texts = q.select(F.col("bare").alias("t")).unionByName(e.select(F.col("name").alias("t"))).distinct()
    rarity = texts.select("t", F.explode(every(F.col("t"))).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("many"))

    def rarest(d: DataFrame, c: str) -> DataFrame:
        spread = d.filter(F.length(c) > 0).select(*d.columns, F.explode(F.array_distinct(own(F.col(c)))).alias("piece"))
        return shuffled(spread).join(shuffled(rarity), "piece").groupBy(*d.columns).agg(F.min_by("piece", F.struct("many", "piece")).alias("piece"))

    def holders(d: DataFrame, c: str) -> DataFrame:
        return d.select(*d.columns, F.explode(every(F.col(c))).alias("piece"))

    pairs = []
    for short, long in ((rarest(e, "name"), holders(q, "bare")), (rarest(q, "bare"), holders(e, "name"))):
        x, y, keys = tiled(short, long, ["piece"])
        pairs.append(x.join(y, keys).select("raw", "bare", "name"))
    # an empty name is held by all
    if e.filter("name = ''").limit(1).count():
        pairs.append(q.withColumn("name", F.lit("")))
    if q.filter("bare = ''").limit(1).count():
        pairs.append(e.withColumn("bare", F.lit("")).join(q.filter("bare = ''"), "bare"))  # few rows: kinds of blanks
    both = reduce(DataFrame.unionByName, [p.select("raw", "bare", "name") for p in pairs]).distinct()
    x, y, raw = F.col("bare"), F.col("name"), F.col("raw")
    named = F.when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.75).otherwise(0.0)
    held = (y != "") & (F.contains(y, raw) | F.contains(raw, y))
    return both.withColumn("named", named).withColumn("held", held).filter("held or named > 0")


def search_entities(entities: DataFrame, questions: DataFrame, threshold: float = SEARCH_AT, index: vectors.Index | None = None, tile: int = vectors.TILE) -> DataFrame:
    """``find_entities`` for a table of questions against all entities: question_id, entity_id, score.

    ``questions``: question_id, names (array of strings), embedding; ``entities``: entity_id, name, embedding. Pairs come from two
    sides, and each is scored in full: names of which one holds the other, and vectors that reach the threshold alone. The
    latter come through an index of the entities' vectors (``vectors.near``, which is exact), so nothing is lost. Where the
    names reach the threshold by themselves no pair is looked at that isn't a result. Both tables are written first: each is
    read half a dozen times, and with what they come from in every plan the plans alone take much of the driver's memory.
    """
    if threshold <= 0:
        raise ValueError("every pair is a result at a threshold of 0")
    entities = materialize(entities.select("entity_id", "name", "embedding"), "searched")
    questions = materialize(questions.select("question_id", "names", "embedding"), "questions")
    vectors_of = entities.select(F.col("entity_id").alias("id"), "embedding")
    index = index or vectors.fit(vectors_of)
    alone = vectors.near(index, questions, min(1.0, 2 * threshold) - 1e-12, tile) if threshold <= 0.5 else None

    asked = questions.select("question_id", F.explode(F.transform("names", lambda n: F.struct(F.lower(n).alias("raw"), F.lower(tx.strip(n)).alias("bare")))).alias("n")).select("question_id", "n.raw", "n.bare")
    own = entities.select("entity_id", F.lower(tx.strip(F.col("name"))).alias("name"))
    matches = shuffled(materialize(name_matches(asked, own), "name-matches"))
    who = asked.join(matches, ["raw", "bare"]).groupBy("question_id", "name").agg(F.max("named").alias("named"), F.bool_or("held").alias("held"))
    x, y, keys = tiled(who, own, ["name"], tile)
    pairs = shuffled(materialize(x.join(y, keys).select("question_id", "entity_id", "named", "held"), "named-pairs"))
    norm = lambda d, key, s: d.select(key, F.col("embedding").alias(f"embedding_{s}"), sim.norm(F.col("embedding")).alias(f"norm_{s}"))
    met = pairs.join(norm(questions, "question_id", "q"), "question_id").join(shuffled(norm(entities, "entity_id", "e")), "entity_id")
    score = 0.5 * F.col("named") + 0.5 * sim.cosine(F.col("embedding_q"), F.col("embedding_e"), F.col("norm_q"), F.col("norm_e"))
    by_name = met.withColumn("score", F.when(F.col("held"), F.greatest(score, F.lit(HELD_SCORE))).otherwise(score)).select("question_id", "entity_id", "score")
    if alone is None:
        return by_name.filter(F.col("score") >= threshold)
    by_vector = alone.select("question_id", F.col("id").alias("entity_id"), (0.5 * F.col("cosine")).alias("score")).join(pairs.select("question_id", "entity_id"), ["question_id", "entity_id"], "left_anti")
    return by_name.unionByName(by_vector).filter(F.col("score") >= threshold)


def relevance(rank: Column, cosine: Column | None = None) -> Column:
    return RELEVANCE_RANK * rank + (RELEVANCE_VECTOR * cosine if cosine is not None else F.lit(0.0))


def positions(rows: DataFrame, order: list[Column], by: list[str] | None = None, weight: str | None = None, most: float | None = None) -> DataFrame:
    """``rows`` with ``position`` (from 1, among those with equal ``by``) and, of a ``weight``, ``used``: its sum up to the row.

    Rows are range-partitioned by ``by`` and ``order``, which tells all rows of a group apart; each range's rows and weights
    are added up, what lies before a range is carried to it, and each range is ranked apart. So neither a large group nor
    many equal scores are one task. With ``most`` ranges that begin beyond that sum are left out. ``rows`` should be narrow.
    """
    by = by or []
    rows = materialize(rows, "to-rank")  # ranges are found on a sample, which reads them once more
    ranged = rows.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("__part", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    own = F.sum(F.col(weight).cast("double")) if weight else F.lit(0.0)
    sums = ranged.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__rows"), own.alias("__weight"))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = sums.select(*by, "__part", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__rows"), F.coalesce(F.sum("__weight").over(earlier), F.lit(0.0)).alias("__weight"))
    if most is not None:
        sums = sums.filter(F.col("__weight") <= most)
    # what lies before a range goes ahead of its rows: a join would shuffle them once more, or broadcast a row for each range of ``by``
    both = ranged.withColumn("__row", F.lit(True)).unionByName(sums.withColumn("__row", F.lit(False)), allowMissingColumns=True)
    w = Window.partitionBy(*by, "__part").orderBy("__row", *order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = lambda c: F.first(c).over(upto)
    out = both.withColumn("position", (ahead("__rows") + F.row_number().over(w) - 1).cast("int"))
    if weight:
        out = out.withColumn("used", ahead("__weight") + F.sum(weight).over(upto))
    out = out.filter("__row and position is not null").drop("__row")
    return out.drop("__part", "__rows", "__weight")


def ranked_entities(found: DataFrame, score: str = "score", key: str = "entity_id", by: list[str] | None = None) -> DataFrame:
    """Found entities with their ``position``, the best first, ties by ``key``."""
    return positions(found, [F.desc(score), F.asc(key)], by)


def pack_context(documents: DataFrame, score: str, key: str, budget: float = BUDGET, by: list[str] | None = None) -> DataFrame:
    """Documents by score until the budget of tokens is passed; the best one always stays.

    ``by`` names the questions that are packed apart; ``key`` is unique in each. Only scores and numbers of tokens are ranked
    (``positions``); the rest of the rows joins last.
    """
    by = by or []
    narrow = documents.select(*by, key, score, tx.token_estimate(F.col("text")).alias("tokens"))
    ranked = positions(narrow, [F.desc(score), F.asc(key)], by, "tokens", budget)
    kept = ranked.filter((F.col("used") <= budget) | (F.col("position") == 1)).select(*by, key, "tokens", "position", "used")
    same = reduce(lambda p, q: p & q, [F.col(f"d.{c}").eqNullSafe(F.col(f"k.{c}")) for c in [*by, key]])
    return documents.alias("d").join(kept.alias("k"), same).select("d.*", "k.tokens", "k.position", "k.used")


def render_context(packed: DataFrame, by: list[str]) -> DataFrame:
    line = F.concat(F.lit("Document "), F.col("position").cast("string"), F.lit(" ("), F.col("filename"), F.lit("):\n"), F.col("text"))
    return packed.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda s: s["line"]), "\n\n").alias("context"))


def chunks(paragraphs: DataFrame, document: str, position: str, threshold: float = CHUNK_AT) -> DataFrame:
    """Paragraphs with ``chunk``: a new one begins where the cosine to the paragraph before is under the threshold."""
    w = Window.partitionBy(document).orderBy(position)
    near = sim.cosine(F.lag("embedding").over(w), F.col("embedding"))
    first = F.row_number().over(w) == 1
    cut = paragraphs.withColumn("__cut", F.when(~first & (near < threshold), 1).otherwise(0))
    return cut.withColumn("chunk", F.sum("__cut").over(w)).drop("__cut")


def chunk_texts(paragraphs: DataFrame, document: str, position: str) -> DataFrame:
    """One row per chunk: its pages, and its paragraphs joined by blank lines. Blank documents have one empty chunk upstream."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct(position, "text"))), lambda s: s["text"])
    return paragraphs.groupBy(document, "chunk").agg(F.min("page").alias("start_page"), F.max("page").alias("end_page"), F.array_join(texts, "\n\n").alias("text"))


def provenance(entities: DataFrame, attributes: str = "attributes") -> DataFrame:
    """One row per attribute: entity_id, key, value, fact. Private keys and blank values are left out."""
    rows = entities.select("entity_id", "name", F.explode(attributes).alias("key", "value"))
    rows = rows.filter(~F.startswith("key", F.lit("_")) & tx.blank_to_null(F.col("value")).isNotNull())
    return rows.select("entity_id", "key", "value", F.concat_ws(": ", F.concat_ws(" ", "name", "key"), "value").alias("fact"))


def with_source_lines(facts: DataFrame, lines: DataFrame) -> DataFrame:
    """Facts with the text of their line where the document has it: joins doc_id and line_number."""
    return facts.join(lines.select("doc_id", "line_number", F.col("line").alias("source_line")), ["doc_id", "line_number"], "left")


def verify(facts: DataFrame, claim: str) -> DataFrame:
    """Facts that hold the claim, whatever the case."""
    return facts.filter(F.contains(F.lower("fact"), F.lower(F.lit(claim))))


def person_scores(people: DataFrame, question: str, fuzzy: bool = False) -> DataFrame:
    """Distinct canonical names with their best score under the question's phrases, and whether pairs gave it.

    Names are scored against the question's few phrases inside an expression, so there is no join. With ``fuzzy``
    each name has a row for each phrase, scored by ``similarity.fuzzy_query_score``, which finds misspelt names.
    """
    phrases = tx.phrase_candidates(F.lit(question))
    own = people.select("name").distinct()  # a name that many bear is made canonical once
    names = own.select(tx.canonical_name(F.col("name")).alias("canon")).filter("canon <> ''").distinct()
    pair = lambda p: F.contains(p, F.lit(" "))
    if fuzzy:
        rows = names.select("canon", F.explode_outer(phrases).alias("p"))
        rows = rows.withColumn("score", sim.fuzzy_query_score(F.col("p"), F.col("canon")))
        top = lambda own: F.greatest(F.lit(0.0), F.coalesce(F.max(own), F.lit(0.0)))
        pairs = F.when(pair(F.col("p")), F.least(F.lit(1.0), F.col("score") * PAIR_BONUS))
        return rows.groupBy("canon").agg(top(pairs).alias("pairs"), top(F.when(~pair(F.col("p")), F.col("score"))).alias("single"))
    best = lambda pairs: F.aggregate(
        F.filter(phrases, lambda p: pair(p) == F.lit(pairs)),
        F.lit(0.0),
        lambda m, p: F.greatest(m, F.least(F.lit(1.0), sim.query_score(p, F.col("canon")) * (PAIR_BONUS if pairs else 1.0))),
    )
    return names.select("canon", best(True).alias("pairs"), best(False).alias("single"))


def person_matches(people: DataFrame, question: str, fuzzy: bool = False) -> DataFrame:
    """canon, score, band: names of the strong band close to the best; if there are none, the weak ones; else suggestions.

    What is looked at beyond each name is one row of maxima.
    """
    scored = person_scores(people, question, fuzzy)
    words = F.filter(tx.phrase_candidates(F.lit(question)), lambda p: ~F.contains(p, F.lit(" ")))
    top = scored.agg(F.coalesce(F.max("pairs"), F.lit(0.0)).alias("top_pairs"))
    scored = scored.join(F.broadcast(top)).select("canon", F.when(F.col("top_pairs") > 0, F.col("pairs")).otherwise(F.col("single")).alias("score"))
    strong = F.col("score") >= STRONG
    named = F.exists(F.split("canon", " "), lambda part: F.exists(words, lambda w: F.contains(w, part)))
    marked = scored.withColumn("named", strong & ((F.size(words) < 2) | named))
    limits = marked.agg(F.max(F.when(strong, F.col("score"))).alias("best"), F.max(F.when(strong & F.col("named"), F.col("score"))).alias("best_named"), F.max(F.when((F.col("score") >= WEAK) & ~strong, F.col("score"))).alias("best_weak"))
    marked = marked.join(F.broadcast(limits))
    near = strong & (F.col("best") - F.col("score") <= SPREAD)
    some_named = F.coalesce(F.col("best") - F.col("best_named") <= SPREAD, F.lit(False))
    band = (
        F.when(F.col("best").isNotNull(), F.when(near & (F.col("named") | ~some_named), "strong"))
        .when(F.col("best_weak").isNotNull(), F.when(F.col("score") >= WEAK, "weak"))
        .when(F.col("score") > SUGGEST_ABOVE, "suggestion")
    )
    found = marked.withColumn("band", band).filter("band is not null").select("canon", "score", "band")
    tips = found.filter("band = 'suggestion'").orderBy(F.desc("score"), "canon").limit(SUGGESTIONS)
    return found.filter("band <> 'suggestion'").unionByName(tips)


def response_type(matches: DataFrame) -> DataFrame:
    """One row: type, n, names (the first 15), by how many names are strong or weak."""
    counts = matches.agg(F.count_if(F.col("band") == "strong").alias("strong"), F.count_if(F.col("band") == "weak").alias("weak"), F.count(F.lit(1)).alias("n"))
    shown = matches.orderBy("canon").limit(NAMES).agg(F.transform(F.array_sort(F.collect_list("canon")), F.initcap).alias("names"))
    kind = F.when(F.col("strong") > 1, "disambiguation").when(F.col("strong") == 1, "answer").when(F.col("weak") > 0, "suggestion").otherwise("not_found")
    return counts.join(F.broadcast(shown)).select(kind.alias("type"), "n", F.array_join("names", ", ").alias("names"))


def routed_facts(facts: DataFrame, question: str) -> DataFrame:
    """Of each entity the facts that the question asks for, or all if there are none; the first five."""
    asked = rules.answer_attributes(F.lit(question))
    w = Window.partitionBy("entity_id")
    marked = facts.withColumn("asked", F.array_contains(asked, F.col("key"))).withColumn("some", F.max("asked").over(w))
    first = Window.partitionBy("entity_id").orderBy("key", "value")
    return marked.filter("asked or not some").withColumn("n", F.row_number().over(first)).filter(F.col("n") <= FACTS).select("entity_id", "key", "value")


def best_person(people: DataFrame, name: str, key: str = "person_id", score=sim.query_score) -> DataFrame:
    """The insured person whose name scores best, the first of equals; none under 0.60.

    ``score`` is a column function of two names; ``similarity.fuzzy_weighted_score`` finds misspelt ones.
    """
    scored = people.filter("insurance_payer is not null").withColumn("score", score(F.lit(name), F.col("name")))
    return scored.filter(F.col("score") >= PERSON_MATCH).orderBy(F.desc("score"), key).limit(1)


def options(entities: DataFrame) -> DataFrame:
    """Per canonical name what tells its bearers apart: distinct types and sources, the first date of birth, how many rows."""
    rows = entities.withColumn("canon", tx.canonical_name(F.col("name")))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return rows.groupBy("canon").agg(joined("doc_type").alias("doc_types"), F.count_distinct("source_doc_id").alias("sources"), F.min_by("dob", "entity_id").alias("dob_hint"), F.count(F.lit(1)).alias("entities"))


def summary(entities: DataFrame) -> DataFrame:
    """One row about all entities: how many, of how many people, and the first names."""
    rows = entities.select(tx.canonical_name(F.col("name")).alias("canon"))
    counts = rows.agg(F.count(F.lit(1)).alias("entities"), F.count_distinct("canon").alias("people"))
    first = rows.distinct().orderBy("canon").limit(NAMES).agg(F.array_join(F.array_sort(F.collect_list("canon")), ",").alias("names"))
    return counts.join(F.broadcast(first))  # one row each
