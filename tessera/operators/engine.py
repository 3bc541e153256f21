"""Questions end to end: seeds, linked entities, the time filter, source documents, ranked context, provenance, conflicts.

A table of questions is answered at once: the frontier of the links, the time filter, packing and conflicts all go
by question. Each stage is a table of the bundle; only the frontier and what is asked again of a stage are written out.
"""

from __future__ import annotations

import datetime
import logging
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.storage import materialize, shuffled

from . import graph, resolve, retrieve, vectors
from .components import connected_components


@dataclass
class Answer:
    entities: DataFrame
    documents: DataFrame
    context: DataFrame
    provenance: DataFrame
    conflicts: DataFrame
    depth: DataFrame


def seeds_of(entities: DataFrame, questions: DataFrame, index: vectors.Index | None = None) -> DataFrame:
    """(question_id, id): what the search finds; for a question without any what the vector alone finds at a lower threshold."""
    index = index or vectors.fit(entities.select(F.col("entity_id").alias("id"), "embedding"))
    found = materialize(retrieve.search_entities(entities, questions, retrieve.SEARCH_AT, index).select("question_id", F.col("entity_id").alias("id")), "seeds")
    lost = questions.join(found.select("question_id").distinct(), "question_id", "left_anti")
    # half of the cosine is the score
    return found.unionByName(vectors.near(index, lost, 2 * retrieve.FALLBACK_AT - 1e-12).filter(0.5 * F.col("cosine") >= retrieve.FALLBACK_AT).select("question_id", "id"))


def expand(seeds: DataFrame, links: DataFrame, max_hops: int, least: float = graph.LEAST_CONFIDENCE) -> DataFrame:
    """(question_id, id, depth): ``graph.expand`` for each question; at each hop only the questions' frontiers are joined."""
    if not 1 <= max_hops <= graph.MOST_HOPS:
        raise ValueError(f"max_hops must be from 1 to {graph.MOST_HOPS}")
    step = graph.both_ways(links.filter(F.col("confidence") >= least).select("a", "b"))
    seen = materialize(seeds.select("question_id", "id").distinct().withColumn("depth", F.lit(0)), "frontier")
    frontier = seen
    for hop in range(1, max_hops + 1):
        reached = shuffled(frontier).join(step, frontier["id"] == step["a"]).select("question_id", F.col("b").alias("id")).distinct()
        frontier = materialize(reached.join(shuffled(seen), ["question_id", "id"], "left_anti").withColumn("depth", F.lit(hop)), "frontier")
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen


def _until(mode: str) -> datetime.date | None:
    """The date that ``mode`` names; None for any other, which keeps all."""
    try:
        return datetime.date.fromisoformat(mode)
    except ValueError:
        if mode != "all":
            logging.getLogger(__name__).warning("unknown temporal mode %r: all entities stay", mode)
        return None


def in_time(reached: DataFrame, entities: DataFrame, links: DataFrame, mode: str) -> DataFrame:
    """(question_id, id) that the time filter leaves; of a question of which it leaves nothing, all.

    ``current`` keeps the latest entity of each component that the links make among what a question has reached; a date
    keeps entities up to it; any other mode keeps all.
    """
    dated = shuffled(reached).join(entities.select(F.col("entity_id").alias("id"), "date", "ord"), "id")
    if mode == "current":
        ends = reached.select("question_id", "id")
        inside = links.select("a", "b").join(ends.withColumnRenamed("id", "a"), "a").join(ends.withColumnRenamed("id", "b"), ["question_id", "b"])
        at = lambda c: F.struct("question_id", F.col(c).alias("id"))
        groups = connected_components(inside.select(at("a").alias("a"), at("b").alias("b"))).select("node.question_id", "node.id", F.col("component.id").alias("component"))
        placed = dated.filter("date is not null").join(groups, ["question_id", "id"], "left")
        group = [F.col("question_id"), F.col("component").isNotNull().alias("linked"), F.coalesce("component", "id").alias("group")]
        kept = placed.groupBy(*group).agg(F.max_by("id", F.struct(F.col("date"), -F.col("ord"))).alias("id")).select("question_id", "id")
    else:
        until = _until(mode)
        if until is None:
            return reached.select("question_id", "id")
        kept = dated.filter(F.col("date") <= F.lit(until)).select("question_id", "id")
    kept = materialize(kept, "in-time")
    bare = reached.join(kept.select("question_id").distinct(), "question_id", "left_anti").select("question_id", "id")
    return kept.unionByName(bare)


def query_all(entities: DataFrame, documents: DataFrame, links: DataFrame, centrality: DataFrame, attributes: DataFrame, questions: DataFrame, max_hops: int = 3, mode: str = "current", budget: float = retrieve.BUDGET, index: vectors.Index | None = None) -> Answer:
    """``questions``: question_id, names (array), embedding. ``entities``: entity_id, name, embedding, source_doc_id, attributes,
    date, ord. ``documents``: doc_id, filename, text. ``links``: a, b, confidence. ``centrality``: id (of a document), centrality.
    ``attributes``: long, as for contradictions. Every table of the answer has ``question_id``.

    Without a seed at the usual threshold the vector alone is tried at a lower one. If the time filter leaves nothing of a
    question, it does not count there. What entities and conflicts are told of is worked out once, however many questions ask.
    """
    links = materialize(links.select("a", "b", "confidence"), "links")
    reached = expand(seeds_of(entities, questions, index), links, max_hops)
    found = shuffled(materialize(in_time(reached, entities, links, mode), "found"))
    whole = found.withColumnRenamed("id", "entity_id").join(entities, "entity_id")
    sources = whole.select("question_id", F.col("source_doc_id").alias("doc_id")).distinct()
    own = sources.join(documents, "doc_id").join(centrality.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    ranked = own.withColumn("score", retrieve.relevance(F.coalesce("centrality", F.lit(0.0))))
    packed = retrieve.pack_context(ranked, "score", "doc_id", budget, ["question_id"])
    facts = retrieve.provenance(entities.join(found.select(F.col("id").alias("entity_id")), "entity_id", "left_semi"))
    told = found.withColumnRenamed("id", "entity_id").join(facts, "entity_id")
    touched = [links.select("a", "b").join(found.withColumnRenamed("id", end), end).select("question_id", "a", "b") for end in "ab"]
    pairs = touched[0].unionByName(touched[1]).distinct().withColumnsRenamed({"a": "id_a", "b": "id_b"})
    conflicts = pairs.join(resolve.contradictions(pairs.select("id_a", "id_b").distinct(), attributes), ["id_a", "id_b"])
    return Answer(whole, own, packed, told, conflicts, reached.groupBy("question_id").agg(F.max("depth").alias("depth")))


def kinds(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, kind) of the nodes that ``links`` (a, b) names, and the links (a < b) between kinds.

    Nodes that are linked and have the same neighbours but for each other, as the members of a clique do, are one kind, which
    its smallest node names. Whoever is linked to one is linked to all, so hops between kinds are hops between nodes.
    """
    step = graph.both_ways(links.filter("a <> b").select("a", "b"))
    around = step.unionByName(step.select("a", F.col("a").alias("b"))).groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("around"))
    around = shuffled(materialize(around, "neighbours"))
    alike = materialize(around.groupBy("around").agg(F.min("a").alias("kind")), "kinds")
    of = materialize(around.join(alike, "around").select(F.col("a").alias("id"), "kind"), "kind-of")
    met = shuffled(alike.select(F.col("kind").alias("a"), F.explode("around").alias("id"))).join(of.withColumnRenamed("kind", "b"), "id")
    return of, met.filter("a < b").select("a", "b").distinct()


def count_conflicts(entities: DataFrame, links: DataFrame, attributes: DataFrame, questions: DataFrame, max_hops: int = 3, mode: str = "current", index: vectors.Index | None = None) -> DataFrame:
    """question_id (not null), attribute_key, conflicts, pairs: how many rows the conflicts of ``query_all`` have, and of how many links.

    Unless the time filter looks at each question's components, what a question reaches are kinds of entities, and those of a
    kind that the filter keeps, or doesn't, are one unit: a question finds all of a unit or nothing of it.
    """
    links = materialize(links.select("a", "b", "confidence"), "links")
    seeds = seeds_of(entities, questions, index)
    if mode == "current":
        found = in_time(expand(seeds, links, max_hops), entities, links, mode).distinct().withColumnRenamed("id", "unit")
        return count_touched(found, found.select(F.col("unit").alias("id"), "unit").distinct(), links, attributes)
    of, between = kinds(links.filter(F.col("confidence") >= graph.LEAST_CONFIDENCE))
    kind = F.coalesce("kind", "id").alias("kind")
    start = shuffled(seeds).join(of, "id", "left").select("question_id", kind.alias("id"))
    reached = expand(start, between.withColumn("confidence", F.lit(1.0)), max_hops).select("question_id", F.col("id").alias("kind"))
    until = _until(mode)
    dated = entities.select(F.col("entity_id").alias("id"), (F.lit(True) if until is None else F.coalesce(F.col("date") <= F.lit(until), F.lit(False))).alias("kept"))
    rows = materialize(shuffled(dated.groupBy("id").agg(F.bool_or("kept").alias("kept"))).join(of, "id", "full").select("id", kind, F.coalesce("kept", F.lit(until is None)).alias("kept")), "kept")
    units = rows.groupBy("kind", "kept").agg(F.min("id").alias("unit"))
    found = materialize(shuffled(reached).join(units, "kind").select("question_id", "unit", "kept"), "found")
    kept = found.filter("kept")
    bare = found.join(kept.select("question_id").distinct(), "question_id", "left_anti")
    found = kept.unionByName(bare).select("question_id", "unit")
    return count_touched(found, shuffled(rows).join(units, ["kind", "kept"]).select("id", "unit"), links, attributes)


def count_touched(found: DataFrame, units: DataFrame, links: DataFrame, attributes: DataFrame) -> DataFrame:
    """question_id, attribute_key, conflicts, pairs of the links that have an end in a unit (id, unit) that a question has found (question_id, unit).

    A link's conflicts are counted once, whatever the number of questions, and added up by the units of its ends. What touches
    a question's units is what these have at one end less what has both ends among them, which is told by the questions that
    have found both. So no row is made for a question and a link.
    """
    units = materialize(units, "units")
    told = resolve.count_contradictions(links.select(F.col("a").alias("id_a"), F.col("b").alias("id_b")).distinct(), attributes)
    for s in "ab":
        told = shuffled(told).join(units.select(F.col("id").alias(f"id_{s}"), F.col("unit").alias(f"unit_{s}")), f"id_{s}", "left")
    told = told.select("unit_a", "unit_b", F.explode("told").alias("c")).select("unit_a", "unit_b", "c.attribute_key", "c.conflicts", F.lit(1).cast("long").alias("pairs"))
    sums = lambda d, *by: d.groupBy(*by, "attribute_key").agg(F.sum("conflicts").alias("conflicts"), F.sum("pairs").alias("pairs"))
    told = materialize(sums(told, "unit_a", "unit_b"), "unit-conflicts")
    own = [told.select(F.col(f"unit_{s}").alias("unit"), "attribute_key", "conflicts", "pairs") for s in "ab"]
    ends = sums(shuffled(found).join(sums(own[0].unionByName(own[1]), "unit"), "unit"), "question_id")

    who = found.groupBy("unit").agg(F.collect_set("question_id").alias("who"))
    both = told.groupBy("unit_a", "unit_b").agg(F.collect_list(F.struct("attribute_key", "conflicts", "pairs")).alias("told"))
    for s in "ab":
        both = shuffled(both).join(who.select(F.col("unit").alias(f"unit_{s}"), F.col("who").alias(f"who_{s}")), f"unit_{s}")
    both = both.select("told", F.explode(F.array_intersect("who_a", "who_b")).alias("question_id")).select("question_id", F.explode("told").alias("c"))
    inside = sums(both.select("question_id", "c.*"), "question_id")
    less = inside.select("question_id", "attribute_key", (-F.col("conflicts")).alias("conflicts"), (-F.col("pairs")).alias("pairs"))
    return sums(ends.unionByName(less), "question_id")


def query(entities: DataFrame, documents: DataFrame, links: DataFrame, centrality: DataFrame, attributes: DataFrame, names: list[str], vector: list[float] | None, max_hops: int = 3, mode: str = "current", budget: float = retrieve.BUDGET) -> Answer:
    """``query_all`` for one question; the tables have no ``question_id``."""
    kind = T.StructType([T.StructField("question_id", T.IntegerType()), T.StructField("names", T.ArrayType(T.StringType())), T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    asked = entities.sparkSession.createDataFrame([(0, names, None if vector is None else [float(x) for x in vector])], kind)
    out = query_all(entities, documents, links, centrality, attributes, asked, max_hops, mode, budget)
    out = replace(out, **{f.name: getattr(out, f.name).drop("question_id") for f in fields(out)})
    # one row, also where nothing is found
    return replace(out, depth=out.depth.agg(F.max("depth").alias("depth")))
