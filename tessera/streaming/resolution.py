"""Resolution that follows new rows: each batch pairs only its own rows with all that are known.

The state is a folder of Parquet tables. ``entities``, ``links`` and ``conflicts`` only
grow, by one part a batch; ``components`` and ``lives_with`` have a version a batch.
A batch writes its parts and versions first and then its number into ``commits``, which
alone makes them count: a batch that stops half-way is written over when it comes again,
and one that comes again after it counted changes nothing. So after any batches, with
any stops between them, the tables are what one batch of all rows gives.

* Links: names are paired where one of the two is new, bearers where one end is new.
* Components: each new link joins two known labels, so components of the labels
  themselves are found; only nodes of labels that change get another one.
* Conflicts: between the ends of new links.
* Households: addresses that a new row has are looked at again, with all their rows.

Rows: entity_id, name, entity_type, source_doc_id, dob, embedding, address, attributes
(map). An entity that is known already, or comes twice in a batch, counts once, as it
came first (of one batch: any). Empty batches count as batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import hooks
from tessera.functions import similarity as sim
from tessera.functions import text as tx
from tessera.operators import candidates, resolve
from tessera.operators import extract as X
from tessera.operators.components import connected_components
from tessera.sources import ingest
from tessera.storage import materialize

_GROWING, _VERSIONS = ("entities", "links", "conflicts"), ("components", "lives_with")


@dataclass
class Thresholds:
    link_at: float = resolve.LINK_AT
    border_at: float = resolve.BORDER_AT
    fuzzy: bool = False
    heavy: int = resolve.HEAVY
    tile: int = candidates.TILE
    least_name: float = resolve.LEAST_NAME


class State:
    """The tables as they were after the last batch that counted."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def batches(self) -> list[int]:
        """Numbers of the batches that count, one row each."""
        path = f"{self.root}/commits"
        return sorted(r.batch for r in self.spark.read.schema("batch long").parquet(path).collect()) if self._exists(path) else []

    def table(self, name: str) -> DataFrame | None:
        done = self.batches()
        paths = [f"{self.root}/{name}/batch-{b}" for b in (done if name in _GROWING else done[-1:])]
        return self.spark.read.parquet(*paths) if paths else None

    def write(self, batch: int, tables: dict[str, DataFrame]) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{name}/batch-{batch}")

    def commit(self, batch: int) -> None:
        self.spark.createDataFrame([(batch,)], "batch long").coalesce(1).write.mode("append").parquet(f"{self.root}/commits")


def _new_links(known: DataFrame, new: DataFrame, t: Thresholds) -> DataFrame:
    """Links with a new end."""
    every = known.unionByName(new)
    names = resolve.named_rows(every).select("type", "name", "surname")
    fresh = resolve.named_rows(new).select("type", "name", "surname").distinct()
    if not t.fuzzy:  # names pair with those of their own surname
        names = names.join(fresh.select("type", "surname").distinct(), ["type", "surname"], "left_semi").select("type", "name", "surname")
    score = sim.fuzzy_name_score if t.fuzzy else sim.name_score
    scored = candidates.name_pairs(names, score, t.least_name, resolve.LEAST_SURNAME, t.fuzzy, t.tile)
    for s in "ab":
        scored = scored.join(fresh.select("type", F.col("name").alias(f"name_{s}"), F.lit(True).alias(f"new_{s}")), ["type", f"name_{s}"], "left")
    scored = scored.filter("new_a or new_b").select("type", "name_a", "name_b", "name_score")
    return resolve.link_bearers(every, materialize(scored, "new-names"), t.link_at, t.border_at, t.heavy, t.tile, touching=new)


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, component: ``labels`` after ``links`` (id_a, id_b); the label of a component is its smallest node."""
    ends = links.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    if labels is None:
        return connected_components(ends)
    for end in "ab":
        own = labels.select(F.col("node").alias(end), F.col("component").alias(f"label_{end}"))
        ends = ends.join(own, end, "left")
    ends = materialize(ends.select("a", "b", F.coalesce("label_a", "a").alias("x"), F.coalesce("label_b", "b").alias("y")), "label-links")
    moved = connected_components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))  # old label -> new one
    nodes = ends.select(F.col("a").alias("node"), F.col("x").alias("component")).unionByName(ends.select(F.col("b").alias("node"), F.col("y").alias("component")))
    both = labels.unionByName(nodes.join(labels.select("node"), "node", "left_anti")).distinct()
    return both.join(moved.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))


def _homes(known: DataFrame, new: DataFrame, before: DataFrame | None) -> DataFrame:
    """Pairs that share a household; those of addresses that no new row has stay as they are."""
    at = tx.normalize_address(F.col("address"))
    touched = new.select(at.alias("address_normalized")).filter("address_normalized is not null").distinct()
    own = known.unionByName(new).select("entity_id", "name", "address")
    here = own.withColumn("address_normalized", at).join(touched, "address_normalized", "left_semi").drop("address_normalized")
    none = own.limit(0).select(F.col("entity_id").alias("a"), F.col("entity_id").alias("b"))
    again = resolve.lives_with(here, none)
    return again if before is None else before.join(touched, "address_normalized", "left_anti").select(again.columns).unionByName(again)


def apply(spark: SparkSession, root: str, rows: DataFrame, batch: int, thresholds: Thresholds | None = None, stop_before_commit: Callable[[], None] | None = None) -> bool:
    """Let ``rows`` follow what the state in ``root`` knows, as batch number ``batch``; False if that batch counts already.

    ``stop_before_commit`` is called when all is written and nothing counts yet, for tests.
    """
    t, state = thresholds or Thresholds(), State(spark, root)
    if batch in state.batches():
        return False
    columns = ["entity_id", "name", "entity_type", "source_doc_id", "dob", "embedding", "address", "attributes"]
    new = rows.select(columns).dropDuplicates(["entity_id"])
    known = state.table("entities")
    if known is not None:
        new = new.join(known.select("entity_id"), "entity_id", "left_anti").select(columns)
    state.write(batch, {"entities": new})
    new = spark.read.parquet(f"{state.root}/entities/batch-{batch}")
    known = new.limit(0) if known is None else known.select(columns)

    state.write(batch, {"links": _new_links(known, new, t)})
    links = spark.read.parquet(f"{state.root}/links/batch-{batch}")
    ends = links.select(F.col("id_a").alias("entity_id")).unionByName(links.select(F.col("id_b").alias("entity_id"))).distinct()
    told = known.unionByName(new).join(ends, "entity_id", "left_semi").select("entity_id", F.col("source_doc_id").alias("source"), F.explode("attributes").alias("key", "value"))
    state.write(batch, {
        "conflicts": resolve.contradictions(links, told.filter(tx.blank_to_null(F.col("value")).isNotNull())),
        "components": _merged(state.table("components"), links),
        "lives_with": _homes(known, new, state.table("lives_with")),
    })
    if stop_before_commit:
        stop_before_commit()
    state.commit(batch)
    return True


def follow(stream: DataFrame, root: str, checkpoint: str, thresholds: Thresholds | None = None):
    """A query that takes all rows a stream has now, batch by batch, and ends; started again it goes on where it stopped."""
    spark = stream.sparkSession
    step = lambda df, batch: apply(spark, root, df, batch, thresholds)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resolution_rows(entities: DataFrame, embedder=None) -> DataFrame:
    """Ingested entities (entity_id, name, attributes, source_doc_id) as rows to resolve: people, by their own date of birth and address."""
    own = entities.withColumn("__text", X.entity_text(F.col("name"), F.col("attributes")))
    rows = hooks.embed(own, "__text", embedder)
    at = lambda k: F.try_element_at("attributes", F.lit(k))
    return rows.select("entity_id", "name", F.lit("PERSON").alias("entity_type"), "source_doc_id", tx.parse_date(at("dob")).alias("dob"), "embedding", at("address").alias("address"), "attributes")


def ingest_and_resolve(spark: SparkSession, paths: str | list[str], root: str, mode: str | ingest.Extractor = "rules", embedder=None, thresholds: Thresholds | None = None) -> State:
    """Files to entities, links, components, conflicts and households, after all that is known in ``root``."""
    _, entities = ingest.ingest(spark, paths, mode)
    return _next(spark, root, entities, embedder, thresholds)


def person_and_resolve(spark: SparkSession, folder: str, root: str, embedder=None, thresholds: Thresholds | None = None) -> State:
    """The same for all files of one person's folder."""
    rows = ingest.person_files(spark, folder)
    key = F.sha2(F.concat_ws("|", F.lit(folder), "source", "name", F.to_json("attributes")), 256)
    return _next(spark, root, rows.select(key.alias("entity_id"), "name", "attributes", F.concat_ws("/", F.lit(folder), "source").alias("source_doc_id")), embedder, thresholds)


def _next(spark: SparkSession, root: str, entities: DataFrame, embedder, thresholds: Thresholds | None) -> State:
    state = State(spark, root)
    apply(spark, root, resolution_rows(entities, embedder), max(state.batches(), default=-1) + 1, thresholds)
    return state


def follow_files(documents: DataFrame, root: str, checkpoint: str, mode: str | ingest.Extractor = "rules", embedder=None, thresholds: Thresholds | None = None):
    """Documents that a stream brings are extracted and resolved batch by batch, after their upload."""
    spark = documents.sparkSession
    extract = ingest.EXTRACTORS[mode] if isinstance(mode, str) else mode
    step = lambda df, batch: apply(spark, root, resolution_rows(extract(df), embedder), batch, thresholds)
    return documents.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
