"""Sharding by longest-processing-time scheduling of groups.

Rows with equal texts are a group and stay together. Groups are taken from the
largest down, each to the shard with the least load, through a heap; of equal
loads the lowest shard number comes first.

Groups of one size, in bytes, are interchangeable, so what the heap sees is sizes
and how many groups have each. Sizes are distinct numbers that add up to no more
than the bytes of all texts, so there are at most sqrt(2 * bytes) of them (250000 at
30 GB); they stream through the driver in sorted order, and what they are dealt is
written out as they go. Which group of a size goes where is told by its rank.

Defined results: a null text has size 1 and forms one group with other nulls;
the empty text is a group of its own; repeated rows are rows of one group and
get slots of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_rank, materialize, ranked, written

SHARDS = 16
#: Groups with more rows than one in so many are joined by broadcast; there are fewer than that.
HEAVY = 1000


def deal(loads: list[int], n: int, size: int) -> list[int]:
    """How many of ``n`` items of one size each shard gets if each item goes to the least-loaded one.

    Where there are many, whole layers up to a level of load are counted at once; the heap deals the rest.
    """
    counts = [0] * len(loads)
    if n > 4 * len(loads):
        low, high = min(loads), max(loads) + size * (n // len(loads) + 2)
        filled = lambda level: [max(0, (level - x) // size) for x in loads]
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if sum(filled(middle)) <= n else (low, middle)
        counts = filled(low)
    heap = [(x + c * size, i) for i, (x, c) in enumerate(zip(loads, counts, strict=True))]
    heapq.heapify(heap)
    for _ in range(n - sum(counts)):
        load, i = heap[0]
        counts[i] += 1
        heapq.heapreplace(heap, (load + size, i))
    return counts


def schedule(sizes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, int, int, int]]:
    """``sizes``: (bytes, groups), largest first -> (bytes, shard, its groups' first rank, rank after the last)."""
    loads = [0] * shards
    for size, n in sizes:
        at = 0
        for i, c in enumerate(deal(loads, n, size)):
            if c:
                loads[i] += c * size
                yield size, i, at, at + c
                at += c


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per row of ``docs``: doc_id, size, text_crc32, shard, slot."""
    text = F.col("text")
    raw = F.coalesce(text, F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"), F.when(text.isNotNull(), F.unhex(F.sha2(raw, 256))).alias("text_key"))
    rows = rows.withColumn("text_key", F.coalesce("text_key", F.lit(bytearray(b"null"))))
    rows = materialize(rows, "shard-rows")
    groups = materialize(rows.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies"), F.sum("size").alias("bytes")), "shard-groups")

    sizes = materialize(groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")), "shard-sizes").orderBy(F.desc("bytes"))
    plan = written(docs.sparkSession, schedule((tuple(r) for r in sizes.toLocalIterator()), shards), "bytes long, shard int, first long, end long", "shard-plan")
    placed = by_rank(ranked(groups, ["bytes"], ["text_key"], "rank"), plan, ["bytes"], "rank", "first", "end")
    placed = materialize(placed.select("text_key", "copies", "shard"), "shard-placed")

    total = rows.count()
    heavy = F.col("copies") * HEAVY > total
    big = placed.filter(heavy).select("text_key", F.col("shard").alias("big"))  # fewer than HEAVY rows
    out = rows.join(F.broadcast(big), "text_key", "left")
    light = out.filter("big is null").drop("big").join(placed.filter(~heavy).select("text_key", "shard"), "text_key")
    both = out.filter("big is not null").withColumnRenamed("big", "shard").unionByName(light)
    both = materialize(both.drop("text_key"), "shard-out")
    return ranked(both, ["shard"], ["doc_id", "text_crc32", "size"], "slot", total)
