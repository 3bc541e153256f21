"""From files to documents and entities: one way of extraction for each mode, and the compositions of them.

An extractor takes the documents of text files (or, for records, nothing) and gives
entities: entity_id, name, doc_type, doc_date, confidence, attributes,
source_doc_id. ``EXTRACTORS`` names the built-in ones; any callable will do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import hooks
from tessera.functions import rules
from tessera.functions import text as tx
from tessera.operators import extract as X
from tessera.operators import retrieve

from . import files

Extractor = Callable[[DataFrame], DataFrame]

#: Fields that a model is asked for where nothing else is said.
SCHEMA = {"name": "full name", "dob": "date of birth", "address": "postal address", "id_number": "number of the document", "issue_date": "date of issue", "expiry_date": "date of expiry", "nationality": "nationality"}


def _entities(rows: DataFrame, attributes: Column, confidence: Column, doc_type: Column) -> DataFrame:
    own = rows.withColumn("attributes", attributes)
    key = F.sha2(F.concat_ws("|", "doc_id", F.to_json("attributes")), 256)
    return own.select(key.alias("entity_id"), X.entity_name(F.col("attributes")).alias("name"), doc_type.alias("doc_type"), X.document_date(F.col("attributes")).alias("doc_date"), confidence.alias("confidence"), "attributes", F.col("doc_id").alias("source_doc_id"))


def by_rules(documents: DataFrame) -> DataFrame:
    """Entities of documents by patterns; the confidence is the share of the patterns' fields that are found."""
    fields = rules.extract_fields(F.col("text"))
    found = F.map_filter(F.create_map(*[x for k, c in fields.items() for x in (F.lit(k), c.cast("string"))]), lambda _, v: v.isNotNull())
    rows = documents.filter(~F.col("empty")).withColumn("found", found)
    return _entities(rows, X.filled(F.col("found")), F.round(F.size("found") / F.lit(len(fields)), 2), F.col("doc_type"))


def by_model(documents: DataFrame, schema: dict[str, str] | None = None, make=hooks.Echo) -> DataFrame:
    """Entities of documents by a model's replies; a reply without an object gives none."""
    schema = schema or SCHEMA
    asked = hooks.complete(documents.withColumn("__prompt", hooks.fields_prompt(schema, F.col("text"))), "__prompt", make, out="reply")
    found = X.entities_from_replies(asked, schema).withColumnRenamed("name", "__name")
    rows = found.join(documents.select("doc_id", "doc_type"), "doc_id").withColumnRenamed("confidence", "__confidence")
    return _entities(rows.withColumnRenamed("attributes", "found"), F.col("found"), F.col("__confidence"), F.col("doc_type"))


EXTRACTORS: dict[str, Extractor] = {"rules": by_rules, "model": by_model}


def ingest(spark: SparkSession, paths: str | list[str], mode: str | Extractor = "rules", folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents and entities of text files. With ``folder`` the entities are tagged as a person's own.

    Files that can't be read are skipped; without a single one that can, this raises.
    """
    extract = EXTRACTORS[mode] if isinstance(mode, str) else mode
    documents = files.text_documents(spark, paths, recursive=True)
    if not documents.limit(1).count():
        raise ValueError("none of the files can be read")
    entities = extract(documents)
    if folder is not None:
        entities = entities.withColumn("attributes", F.map_concat("attributes", F.create_map(F.lit("_person_folder"), F.lit(safe_folder(folder)))))
    return documents, entities


def safe_folder(name: str) -> str:
    """A folder's name of small letters, digits and single underscores."""
    kept = "".join(c if c.isascii() and c.isalnum() else "_" for c in name.strip().lower())
    return "_".join(p for p in kept.split("_") if p) or "unknown"


def upload_status(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row for each path: path, status (``ok``, ``empty``, ``unsupported`` or ``missing``), chars."""
    asked = spark.createDataFrame([(p, p.rsplit(".", 1)[-1].lower() in ("txt", "json")) for p in paths], "asked string, known boolean")
    read = [p for p in paths if p.rsplit(".", 1)[-1].lower() in ("txt", "json")]
    reader = spark.read.option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True)
    existing = [p for p in read if _exists(spark, p)]
    rows = reader.text(existing, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("path"), F.length("value").alias("chars"), (tx.strip(F.col("value")) == "").alias("blank")) if existing else spark.createDataFrame([], "path string, chars int, blank boolean")
    out = asked.join(rows, F.regexp_replace("asked", "^file:/+", "/") == rows["path"], "left")
    status = F.when(~F.col("known"), "unsupported").when(F.col("path").isNull(), "missing").when(F.col("blank"), "empty").otherwise("ok")
    return out.select(F.col("asked").alias("path"), status.alias("status"), F.coalesce("chars", F.lit(0)).alias("chars"))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def person_files(spark: SparkSession, folder: str) -> DataFrame:
    """Entities of all of one person's files: patient records, extracted fields and texts, under one schema: source, name, attributes."""
    texts = by_rules(files.text_documents(spark, folder, recursive=True)).select(F.lit("text").alias("source"), "name", "attributes")
    fields = X.entities_from_fields(files.field_documents(spark, f"{folder}/fields")).select(F.lit("fields").alias("source"), "name", "attributes") if _exists(spark, f"{folder}/fields") else texts.limit(0)
    records = X.entities_from_patients(files.patient_records(spark, f"{folder}/records")).select(F.lit("record").alias("source"), "name", "attributes") if _exists(spark, f"{folder}/records") else texts.limit(0)
    return texts.unionByName(fields).unionByName(records)


def paged(spark: SparkSession, pages: DataFrame, embedder=None, threshold: float = retrieve.CHUNK_AT) -> tuple[DataFrame, DataFrame]:
    """Chunks and their entities of paged documents (source, page_number, text), as PDF or OCR decoders give them.

    A person's name and date of birth come from the first page, else from the folder; each chunk is a document and has one entity.
    """
    rows = pages.filter("text is not null")
    parts = rows.select("source", F.col("page_number").alias("page"), F.posexplode(tx.paragraphs(F.col("text"))).alias("n", "text"))
    own = hooks.embed(parts, "text", embedder).withColumn("place", F.struct("page", "n"))
    chunks = retrieve.chunk_texts(retrieve.chunks(own, "source", "place", threshold), "source", "place")
    folder = F.coalesce(F.try_element_at(F.split("source", "/"), F.lit(-2)), F.lit(""))
    heads = rows.filter("page_number = 1").select("source", X.header_person(F.col("text"), folder).alias("person"))
    told = chunks.join(heads, "source", "left").withColumn("doc_id", F.sha2(F.concat_ws("|", "source", F.col("chunk").cast("string")), 256))
    attributes = X.filled(F.create_map(F.lit("name"), F.col("person.name"), F.lit("dob"), F.col("person.dob")))
    entities = _entities(told, attributes, F.lit(1.0), F.lit("MEDICAL_REPORT"))
    return told.select("doc_id", "source", "chunk", "start_page", "end_page", "text"), entities
