"""URL rules by a sort-merge range join over reversed-host keys.

A rule is a host and a path prefix; it fits urls of its host and of all
subdomains whose path starts with its path. A canonical key is the host with
its labels reversed, a slash, and the path: every rule then is the interval of
keys that it is a prefix of, and the intervals nest. As a rule also fits
subdomains, a url is looked up once for each suffix of its host that has as
many labels as some rule's host.

Keys and interval ends are dealt to ranges and swept in order. The sweep's
stack of active rules is kept relationally: the running depth after an event
names the stack's level, and the last rule opened at that level is its top.

Defined results: a null url, or one without ``://``, has an empty host and
path and is judged like any other; equal rows are judged and returned one by
one; of equal rules, block wins; an empty rule table gives the default verdict
everywhere; other columns of either table are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shuffle_partitions

#: Keys looked at for each range when its bounds are chosen.
SAMPLE_PER_RANGE = 20
MOST_RANGES = 4096


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: then up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lowered(host), path


def lowered(host: Column) -> Column:
    """With A-Z in small letters, other characters as they are."""
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit("/"), path).cast("binary")


def _bounds(keys: DataFrame, ranges: int) -> list[tuple[bytes, int]]:
    """Splitting points for (key, tie), from the rows with the smallest hashes: a bounded, repeatable sample."""
    chosen = keys.orderBy(F.xxhash64("key", "tie")).limit(SAMPLE_PER_RANGE * ranges).collect()
    found = sorted((bytes(r["key"]), r["tie"]) for r in chosen)
    step = max(1, math.ceil(len(found) / ranges))
    return found[step::step]


def _range_of(key: Column, tie: Column, bounds: list[tuple[bytes, int]]) -> Column:
    """How many bounds are at most (key, tie); two levels, so about 2 * sqrt(bounds) comparisons."""
    if not bounds:
        return F.lit(0)
    wide = max(1, math.isqrt(len(bounds)))
    array = lambda xs: F.array(*[F.struct(F.lit(bytearray(k)).alias("k"), F.lit(t).cast("long").alias("t")) for k, t in xs])
    at_most = lambda b: (b["k"] < key) | ((b["k"] == key) & (b["t"] <= tie))
    coarse = F.size(F.filter(array(bounds[wide - 1 :: wide]), at_most)) * wide
    return coarse + F.size(F.filter(F.slice(array(bounds), coarse + 1, F.lit(wide)), at_most))


def match_rules(pages: DataFrame, rules: DataFrame, default: str = "allow", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule (null if none fits), verdict.

    ``rules`` has host, path and verdict. The longest fitting rule decides.
    """
    spark = pages.sparkSession
    ranges = min(MOST_RANGES, shuffle_partitions(spark))
    host, path = host_and_path(pages[url])
    given = pages.select(pages[page_id].alias("page_id"), host.alias("host"), path.alias("path"))
    given = given.groupBy("page_id", "host", "path").agg(F.count(F.lit(1)).alias("copies"))
    given = given.withColumn("tie", F.xxhash64("page_id", "host", "path"))

    known = rules.select(lowered(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").filter(F.col("host").isNotNull())
    known = known.groupBy("host", "path").agg(F.max(F.struct((F.col("verdict") == "block").alias("b"), "verdict"))["verdict"].alias("verdict"))
    labels = F.split("host", r"\.")
    known = known.withColumn("rule", F.concat("host", "path")).withColumn("open", _key(labels, F.col("path")))
    # The numbers of labels that rule hosts have: a few small integers.
    wanted = sorted(r[0] for r in known.select(F.size(labels)).distinct().collect())

    suffixes = F.filter(F.array(*[F.lit(n) for n in wanted]).cast("array<int>"), lambda n: n <= F.size(labels))
    every = given.withColumn("n", F.explode_outer(suffixes))
    own = F.when(F.col("n").isNull(), labels).otherwise(F.slice(labels, F.size(labels) - F.col("n") + 1, F.col("n")))
    every = every.withColumn("key", _key(own, F.col("path")))

    bounds = _bounds(every.select("key", "tie"), ranges) if wanted else []
    low, high = F.lit(-(2**63)).cast("long"), F.lit(2**63 - 1).cast("long")
    urls = every.select(_range_of(F.col("key"), F.col("tie"), bounds).alias("range"), "key", F.lit(1).alias("kind"), F.lit(0).alias("step"), F.lit(None).cast("struct<length:int,rule:string,verdict:string>").alias("opened"), "page_id", "host", "path", "copies")
    close = F.concat("open", F.unhex(F.lit("FF")))
    spans = known.withColumn("close", close)
    first, last = _range_of(F.col("open"), low, bounds), _range_of(F.col("close"), high, bounds)
    spans = spans.withColumn("range", F.explode(F.sequence(first, last)))
    opened = F.struct(F.length("rule").alias("length"), "rule", "verdict")
    blank = [F.lit(None).cast(given.schema["page_id"].dataType).alias("page_id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("copies")]
    opens = spans.select("range", F.col("open").alias("key"), F.lit(0).alias("kind"), F.lit(1).alias("step"), opened.alias("opened"), *blank)
    closes = spans.select("range", F.col("close").alias("key"), F.lit(2).alias("kind"), F.lit(-1).alias("step"), F.lit(None).cast(opens.schema["opened"].dataType).alias("opened"), *blank)

    events = opens.unionByName(urls).unionByName(closes).repartition(F.col("range"))
    order = ("key", "kind")
    here = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = Window.partitionBy("range", "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumn("depth", F.sum("step").over(here)).withColumn("top", F.last("opened", ignorenulls=True).over(level)).filter("kind = 1")
    best = swept.groupBy("page_id", "host", "path").agg(F.max("top").alias("top"), F.max("copies").alias("copies"))
    best = best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return best.select("page_id", "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))
