"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import materialize


#: Neighbours up to which a node isn't looked at as a hub: as many rows of two numbers are little work for one task.
HUB = 100_000
#: Hubs at most: a node is one only if it has at least this share of all edge ends.
HUBS = 1000


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def _with_least(rows: DataFrame, least: DataFrame, key: str, ends: int) -> DataFrame:
    """``rows`` with ``m`` of their key. Hubs, of which there are fewer than ``HUBS``, are broadcast, so none is one task."""
    if ends <= HUB:
        return rows.join(least.drop("n"), key)
    hub = F.col("n") > max(HUB, ends // HUBS)
    hubs = least.filter(hub).select(key, F.col("m").alias("__m"))
    marked = rows.join(F.broadcast(hubs), key, "left")
    others = marked.filter("__m is null").drop("__m").join(least.filter(~hub).drop("n"), key)
    return marked.filter("__m is not null").withColumnRenamed("__m", "m").unionByName(others)


def _large_star(edges: DataFrame, ends: int) -> DataFrame:
    """Each node sends its larger neighbours to the smallest node it knows."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _with_least(both.filter("b > a"), least, "a", ends).select(F.col("m").alias("a"), "b").filter("a <> b").distinct()


def _small_star(edges: DataFrame, ends: int) -> DataFrame:
    """Each node sends itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _with_least(edges, least, "b", ends).select(F.col("m").alias("x"), F.col("a").alias("y")).unionByName(least.select(F.col("m").alias("x"), F.col("b").alias("y")))
    return moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that ``edges`` (a, b) names; the component is its smallest node.

    Loops and repeated edges make no difference; no edges give no rows. Each
    round is written to the shared folder, so a lost executor costs one round.
    """
    now = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    now = materialize(now.filter("a <> b").distinct(), "edges")
    seen = _mark(now)
    while True:
        ends = 2 * seen[0]
        now = materialize(_small_star(_large_star(now, ends), ends), "edges")
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    members = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    roots = now.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("component"))
    return members.unionByName(roots)
