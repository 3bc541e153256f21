"""Reports over entities, links and conflicts, and the job that follows an ingest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.storage import materialize, shuffled

from . import resolve
from .components import connected_components


@dataclass
class Resolved:
    links: DataFrame
    components: DataFrame
    conflicts: DataFrame
    edges: DataFrame
    lives_with: DataFrame


def after_ingest(entities: DataFrame, attributes: DataFrame, residents: DataFrame, existing: DataFrame, **thresholds: float) -> Resolved:
    """Links between the entities, what they contradict each other in, and who shares a household: all that follows new rows.

    ``attributes`` is long, ``residents`` has addresses, ``existing`` are edges that are known. Everything is lazy but the links and components.
    """
    links = materialize(resolve.linked(entities, **thresholds), "ingest-links")
    found = resolve.contradictions(links, attributes)
    return Resolved(links, connected_components(links.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))), found, resolve.conflict_edges(found), resolve.lives_with(residents, existing))


def link_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: before, after, added, gone; links are undirected pairs (a, b)."""
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    both = before.select(*pair).distinct().withColumn("side", F.lit(1)).unionByName(after.select(*pair).distinct().withColumn("side", F.lit(2)))
    sides = both.groupBy("a", "b").agg(F.sum("side").alias("sides"))  # 1 only before, 2 only after, 3 both
    return sides.agg(F.count_if(F.col("sides") != 2).alias("before"), F.count_if(F.col("sides") != 1).alias("after"), F.count_if(F.col("sides") == 2).alias("added"), F.count_if(F.col("sides") == 1).alias("gone"))


def _touched(edges: DataFrame, people: DataFrame, a: str, b: str) -> DataFrame:
    """Each edge once for each person that one of its ends is of."""
    own = [F.col(c) for c in edges.columns]
    ends = edges.select(F.col(a).alias("entity_id"), *own).unionByName(edges.select(F.col(b).alias("entity_id"), *own))
    return ends.join(people, "entity_id").drop("entity_id").distinct()


def _people(entities: DataFrame) -> DataFrame:
    return entities.select("entity_id", "source_doc_id", tx.canonical_name(F.col("name")).alias("canon")).filter("canon <> ''")


def _report(people: DataFrame, *told: DataFrame) -> DataFrame:
    out = people.groupBy("canon").agg(F.count(F.lit(1)).alias("entities"), F.count_distinct("source_doc_id").alias("sources"))
    for t in told:
        out = out.join(t, "canon", "left")
    return out.na.fill(0, ["links", "conflicts", "critical"]).withColumn("resolved", F.col("links") > 0)


def person_report(entities: DataFrame, links: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Per canonical name: entities, sources, links, conflicts, critical, resolved (whether any link is known)."""
    people = _people(entities)
    ids = people.select("entity_id", "canon")
    linked = _touched(links.select("a", "b"), ids, "a", "b").groupBy("canon").agg(F.count(F.lit(1)).alias("links"))
    told = _touched(conflicts.select("id_a", "id_b", "attribute_key", "severity"), ids, "id_a", "id_b")
    told = told.groupBy("canon").agg(F.count(F.lit(1)).alias("conflicts"), F.count_if(F.col("severity") == "critical").alias("critical"))
    return _report(people, linked, told)


def near_report(entities: DataFrame, vectors: DataFrame, attributes: DataFrame, threshold: float, blocks_of: int = 64) -> DataFrame:
    """``person_report`` of the links of near vectors of one label (id, embedding, label), which are counted and never rows.

    An id that comes more than once has its links told apart as rows, in the plain form.
    """
    people = _people(entities)
    known = people.select(F.col("entity_id").alias("id"), F.col("canon").alias("person"))
    rows = vectors.select("id", F.col("label").alias("block"), "embedding").join(shuffled(known), "id", "left")
    rows = rows.join(shuffled(resolve.compared_values(attributes).withColumnRenamed("entity_id", "id")), "id", "left")
    rows = materialize(rows, "report-rows")
    if rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        links = resolve.similar_pairs(vectors, threshold, blocks_of=blocks_of)
        return person_report(entities, links, resolve.contradictions(links.select(F.col("a").alias("id_a"), F.col("b").alias("id_b")), attributes))
    return _report(people, resolve.count_similar(rows, threshold, blocks_of).withColumnRenamed("person", "canon"))


def fact_sheet(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Per canonical name and key the first known value, of the smallest entity, and how many distinct values there are."""
    people = entities.select("entity_id", tx.canonical_name(F.col("name")).alias("canon"))
    known = facts.select("entity_id", "key", "value").join(people, "entity_id")
    return known.groupBy("canon", "key").agg(F.min_by("value", F.struct("entity_id", "value")).alias("value"), F.count_distinct("value").alias("distinct_values"))


def conflict_lines(conflicts: DataFrame, texts: DataFrame) -> DataFrame:
    """``conflicts`` with the line of each side's value in its own text: line_a, line_b. ``texts``: entity_id, text."""
    sides = {x: texts.select(F.col("entity_id").alias(f"id_{x}"), F.col("text").alias(f"__text_{x}")) for x in "ab"}
    joined = conflicts.join(sides["a"], "id_a", "left").join(sides["b"], "id_b", "left")
    line = lambda x: tx.line_with(tx.lines(F.col(f"__text_{x}")), F.col(f"value_{x}")).alias(f"line_{x}")
    return joined.select(*[joined[c] for c in conflicts.columns], line("a"), line("b"))


def largest(groups: DataFrame, size: str, key: str, n: int) -> DataFrame:
    """The ``n`` largest groups, of equal ones those with the smallest key."""
    return groups.orderBy(F.desc(size), key).limit(n)


def first_people(people: DataFrame, key: str, n: int | None) -> DataFrame:
    """The ``n`` people with the smallest keys, or all: for a trial run of what follows."""
    return people if n is None else people.orderBy(key).limit(n)


def session_counts(replies: DataFrame) -> DataFrame:
    """How many calls are in each state after their last turn."""
    return replies.groupBy("call_id").agg(F.max_by("state", "turn").alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("calls"))


def type_histogram(documents: DataFrame, doc_type: Column) -> DataFrame:
    return documents.groupBy(doc_type.alias("doc_type")).agg(F.count(F.lit(1)).alias("documents"))


def name_lists(rows: DataFrame, by: str, name: str = "name") -> DataFrame:
    """Per group its distinct canonical names, sorted, in one text."""
    names = F.array_sort(F.collect_set(tx.canonical_name(F.col(name))))
    return rows.groupBy(by).agg(F.array_join(names, ", ").alias("names"), F.count_distinct(tx.canonical_name(F.col(name))).alias("people"))


def manifest_table(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """One row, ``text``: a Markdown table of a manifest, whose rows are few enough to be read."""
    cell = lambda c: F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit(""))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))), lambda r: r["line"]), "\n")
    head = "| " + " | ".join(columns) + " |\n" + "|" + "-|" * len(columns) + "\n"
    return rows.agg(F.concat(F.lit(head), body).alias("text"))
