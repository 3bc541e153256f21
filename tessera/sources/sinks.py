"""Sinks: records, tables, graph exports, side files and event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_records(records: DataFrame, path: str, folder: str = "folder") -> None:
    """Nested records as JSON, a folder for each value of ``folder``; what was there is replaced."""
    records.write.mode("overwrite").partitionBy(folder).json(path)


def write_graph(documents: DataFrame, entities: DataFrame, edges: DataFrame, path: str) -> None:
    """A saved graph: three tables, not one object."""
    for name, df in (("documents", documents), ("entities", entities), ("edges", edges)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges as JSON lines, each with its kind; values JSON has no form for are strings."""
    plain = lambda df: df.select(*[F.col(c).cast("string").alias(c) if t in ("date", "timestamp", "timestamp_ntz", "binary") else F.col(c) for c, t in df.dtypes if c != "embedding"])
    line = lambda kind, df: plain(df).select(F.to_json(F.struct(F.lit(kind).alias("kind"), F.struct("*").alias("value"))).alias("line"))
    return line("node", nodes).unionByName(line("edge", edges))


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    graph_lines(nodes, edges).write.mode("overwrite").text(path)


def write_fields(fields: DataFrame, path: str) -> None:
    """Extracted fields next to their documents."""
    fields.write.mode("append").json(path)


def broadcast_events(stream: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str):
    """Give each micro-batch to ``send``; a batch that comes again after a failure has the same number."""
    return stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def manifest(records: DataFrame) -> DataFrame:
    """One summary row for each record."""
    return records.select("folder", "display_name", "patient_id", "dob", F.col("insurance.payer").alias("insurance"), F.size("active_conditions").alias("conditions"), F.size("encounters").alias("encounters"), F.col("claim_summary.denied_claims").alias("denied"), F.col("claim_summary.pending_claims").alias("pending"))
