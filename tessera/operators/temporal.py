"""Current, as-of and all: filters over dated entities."""

from __future__ import annotations

import datetime
import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as tx

# Where an entity's date is looked for, in order.
DATE_SOURCES = ("doc_date", "issue_date", "date", "dob")


def entity_date(sources: dict[str, Column], order: tuple[str, ...] = DATE_SOURCES) -> Column:
    """The first of the named dates that parses."""
    return F.coalesce(*[tx.parse_date(sources[s].cast("string")) for s in order if s in sources], F.lit(None).cast("date"))


def current(entities: DataFrame, components: DataFrame, key: str = "id", date: str = "date", order: str = "ord") -> DataFrame:
    """Of each component the entity with the latest date, the first of equals; undated ones are dropped.

    ``components``: node, component; an entity that is in none stands alone. One aggregate, reduced before its shuffle.
    """
    dated = entities.filter(F.col(date).isNotNull())
    joined = dated.join(components, dated[key] == components["node"], "left")
    group = F.when(F.col("component").isNotNull(), F.struct(F.lit(1).alias("k"), F.col("component").cast("string").alias("c"))).otherwise(F.struct(F.lit(0).alias("k"), F.col(key).cast("string").alias("c")))
    row = F.struct(*[F.col(c) for c in entities.columns])
    rank = F.struct(F.col(date), -F.col(order))
    return joined.withColumn("__g", group).groupBy("__g").agg(F.max_by(row, rank).alias("r")).select("r.*")


def as_of(entities: DataFrame, cutoff: Column, date: str = "date") -> DataFrame:
    """Entities dated up to the cutoff; undated ones are dropped."""
    return entities.filter(F.col(date) <= cutoff)


def filter_entities(entities: DataFrame, mode: str, components: DataFrame | None = None, date: str = "date") -> DataFrame:
    """``current``, ``all``, or a date up to which entities count. Another mode is taken as ``all``, with a warning."""
    if mode == "current" and components is not None:
        return current(entities, components, date=date)
    if mode != "all":
        try:
            return as_of(entities, F.lit(datetime.date.fromisoformat(mode)), date)
        except ValueError:
            logging.getLogger(__name__).warning("unknown temporal mode %r: all entities stay", mode)
    return entities


def most_recent_value(rows: DataFrame, key: str, value: str, date: str, order: str) -> DataFrame:
    """Per key the latest value that is not blank; the first of equals."""
    kept = rows.filter(tx.blank_to_null(F.col(value)).isNotNull() & F.col(date).isNotNull())
    return kept.groupBy(key).agg(F.max_by(F.struct(value, date), F.struct(F.col(date), -F.col(order))).alias("r")).select(key, "r.*")


def event_windows(events: DataFrame, time: str, width: str, keys: list[str]) -> DataFrame:
    """An extension: counts and sums over tumbling windows; with a watermark upstream it also streams."""
    grouped = events.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap_seconds: int) -> DataFrame:
    """An extension: runs of a key's events with no gap longer than the given one."""
    w = Window.partitionBy(key).orderBy(time)
    seconds = F.unix_micros(F.col(time).cast("timestamp"))
    fresh = F.when(seconds - F.lag(seconds).over(w) <= gap_seconds * 1_000_000, 0).otherwise(1)
    numbered = events.withColumn("__new", fresh).withColumn("session", F.sum("__new").over(w))
    return numbered.groupBy(key, "session").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("n"))
