"""Graphs as node and edge tables: statistics, bounded search, rank, neighbourhoods, drawing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import rules
from tessera.functions import text as tx
from tessera.storage import materialize

# Search depth, link confidence, damping, and how nodes and edges are drawn.
MOST_HOPS = 5
LEAST_CONFIDENCE = 0.60
DAMPING = 0.85
ROUNDS = 100
LABEL_LENGTH = 20
NODE_COLOURS = {"PERSON": "#4A90D9", "document": "#27AE60", "ID_NUMBER": "#E67E22", "DATE": "#9B59B6", "ORGANIZATION": "#E74C3C", "LOCATION": "#1ABC9C"}
OTHER_NODE = "#95A5A6"
EDGE_COLOURS = {"mentions": "#BDC3C7", "conflict": "#E74C3C", "lives_with": "#1ABC9C"}
EDGE_WIDTHS = {"mentions": 1, "conflict": 3, "lives_with": 2}
OTHER_EDGE = "#555555"
DASHED = ["mentions", "conflict", "lives_with"]


def both_ways(edges: DataFrame) -> DataFrame:
    other = [c for c in edges.columns if c not in ("a", "b")]
    return edges.select("a", "b", *other).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), *other))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both tables; of rows with one key, that with the largest ``order``."""
    rows = old.unionByName(new, allowMissingColumns=True)
    row = F.struct(*[F.col(c) for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(row, order).alias("r")).select(*keys, "r.*")


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Each undirected pair once, a < b, with its highest confidence."""
    return edges.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("confidence").alias("confidence"))


def known_ends(edges: DataFrame, nodes: DataFrame, anti: bool = False) -> DataFrame:
    """Edges of which both ends are nodes; or, with ``anti``, the others."""
    ids = nodes.select("id")
    a, b = ids.withColumnRenamed("id", "a"), ids.withColumnRenamed("id", "b")
    both = edges.join(a, "a", "left_semi").join(b, "b", "left_semi")
    if not anti:
        return both
    return edges.join(a, "a", "left_anti").unionByName(edges.join(a, "a", "left_semi").join(b, "b", "left_anti"))


def incident(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges of which an end is among ``ids``; two joins by key rather than one with OR."""
    a = edges.join(ids.select(F.col("id").alias("a")), "a", "left_semi")
    b = edges.join(ids.select(F.col("id").alias("b")), "b", "left_semi")
    return a.unionByName(b.select(a.columns)).distinct()


def subgraph_nodes(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids`` and their neighbours."""
    near = both_ways(edges.select("a", "b")).join(ids.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id"))
    return ids.select("id").unionByName(near).distinct()


def expand(seeds: DataFrame, links: DataFrame, max_hops: int, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """(id, depth): seeds at depth 0 and what they reach over confident links. Only the frontier is joined at each hop."""
    if not 1 <= max_hops <= MOST_HOPS:
        raise ValueError(f"max_hops must be from 1 to {MOST_HOPS}")
    step = both_ways(links.filter(F.col("confidence") >= least).select("a", "b"))
    seen = materialize(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "frontier")
    frontier = seen
    for hop in range(1, max_hops + 1):
        reached = frontier.join(step, frontier["id"] == step["a"]).select(F.col("b").alias("id")).distinct()
        frontier = materialize(reached.join(seen, "id", "left_anti").withColumn("depth", F.lit(hop)), "frontier")
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen


def page_rank(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, every: int = 5, tolerance: float | None = 1e-6) -> DataFrame:
    """(id, rank) over undirected edges; ranks sum to 1. Nodes without edges share their rank with all.

    The links are written once, each one way, dealt by source and kept that way, so a round shuffles only what is
    sent along them; degrees go with the ranks, so the links are never joined for them. Nodes without edges all have one rank, a number that is carried along. Every few rounds the
    ranks are written out, which is also when convergence is looked at.
    """
    spark = nodes.sparkSession
    ids = materialize(nodes.select("id").distinct(), "rank-nodes")
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    links = both_ways(materialize(edges.select("a", "b"), "rank-links"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = links.repartition(parts, "a").persist()
    degree = links.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    linked = materialize(ids.join(degree, "id"), "rank-linked")
    lonely = n - linked.count()
    alone = 1.0 / n  # the rank of each node without edges
    rank = linked.select("id", "degree", F.lit(alone).alias("rank"))
    last = rank
    for i in range(1, rounds + 1):
        base = (1 - damping + damping * lonely * alone) / n
        alone = base
        sent = dealt.join(rank, dealt["a"] == rank["id"]).select(F.col("b").alias("id"), (F.col("rank") / F.col("degree")).alias("part"))
        got = sent.groupBy("id").agg(F.sum("part").alias("got"))
        # A node that has an edge to another is sent something in each round.
        rank = linked.join(got, "id", "left").select("id", "degree", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if i % every == 0 or i == rounds:
            rank = materialize(rank, "rank")
            if tolerance is not None:
                moved = rank.join(last.select("id", F.col("rank").alias("old")), "id").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
                if (moved or 0.0) < n * tolerance:
                    break
            last = rank
    dealt.unpersist()
    return rank.select("id", "rank").unionByName(ids.join(linked, "id", "left_anti").withColumn("rank", F.lit(alone)))


def normalized_rank(rank: DataFrame) -> DataFrame:
    top = rank.agg(F.max("rank").alias("top"))  # one row
    return rank.join(F.broadcast(top)).select("id", F.when(F.col("top") > 0, F.col("rank") / F.col("top")).otherwise(0.0).alias("centrality"))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, entities, documents, edges, same_as_edges, conflict_edges."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("node_type") == "entity").alias("entities"), F.count_if(F.col("node_type") == "document").alias("documents"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("edge_type") == "same_as").alias("same_as_edges"), F.count_if(F.col("edge_type") == "conflict").alias("conflict_edges"))
    return n.join(F.broadcast(e))  # one row each


def without_conflicts(same_as: DataFrame, conflicts: DataFrame) -> DataFrame:
    """The links that a graph with one edge a pair would have left once conflicts are added."""
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    return same_as.join(conflicts.select(*pair).distinct(), ["a", "b"], "left_anti")


def neighbourhood(edges: DataFrame) -> DataFrame:
    """Per node and edge type: how many neighbours, and the smallest and largest."""
    return both_ways(edges.select("a", "b", "edge_type")).groupBy(F.col("a").alias("id"), "edge_type").agg(F.count_distinct("b").alias("neighbours"), F.min("b").alias("first"), F.max("b").alias("last"))


def first_mentions(mentions: DataFrame, order: list[str]) -> DataFrame:
    """Of each entity its first mention."""
    w = Window.partitionBy("entity_id").orderBy(*order)
    return mentions.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def node_style(name: Column, kind: Column) -> dict[str, Column]:
    """``kind`` is an entity's type, or ``document``."""
    label = F.when(F.length(name) > LABEL_LENGTH, F.concat(F.substring(name, 1, LABEL_LENGTH), F.lit("..."))).otherwise(name)
    colour = rules.lookup(kind, NODE_COLOURS, F.lit(OTHER_NODE))
    return {"label": label, "colour": colour, "size": F.when(kind == "document", 30).otherwise(20)}


def edge_style(kind: Column, confidence: Column) -> dict[str, Column]:
    width = F.when(kind == "same_as", F.greatest(F.lit(1), F.floor(confidence * 4).cast("int"))).otherwise(rules.lookup(kind, EDGE_WIDTHS, F.lit(1)))
    colour = F.when(kind == "same_as", tx.confidence_colour(confidence)).otherwise(rules.lookup(kind, EDGE_COLOURS, F.lit(OTHER_EDGE)))
    return {"width": width, "colour": colour, "dashed": kind.isin(DASHED)}
