"""Sources: text, records, tables, binary documents, landing folders, and generated fixtures.

Paths go to Spark's readers as they are, so any store that Spark reads will do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import rules
from tessera.functions import text as tx

PATIENT = (
    "patient_id string, display_name string, dob string, gender string, city string, state string, age int, insurance struct<payer: string, member_since: string, payer_id: string>, "
    "active_conditions array<struct<code: string, description: string, onset: string>>, "
    "encounters array<struct<encounter_id: string, date: string, type: string, description: string, reason: string, procedure_code: string, provider: string, payer: string, claim_status: string, billed: double, covered: double, patient_owes: double>>, "
    "claim_summary struct<total_billed: double, total_covered: double, total_owed: double, denied_claims: int, pending_claims: int>"
)
FIELDS = "document_type string, confidence double, source_file string, fields map<string, struct<value: string, confidence: double, page: int, bounding_box: array<int>>>, _corrupt_record string"


def as_documents(rows: DataFrame) -> DataFrame:
    """From path, text to the columns of a document; the id follows from both, so reading again gives the same."""
    t = F.col("text")
    return rows.select(
        F.sha2(F.concat_ws("|", "path", t), 256).alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), t.alias("text"), tx.lines(t).alias("lines"), tx.paragraphs(t).alias("paragraphs"), tx.line_offsets(t).alias("line_offsets"),
        rules.doc_type(t).alias("doc_type"), F.lit(None).cast("date").alias("doc_date"), (tx.strip(t) == "").alias("empty"), F.create_map(F.lit("path"), F.col("path")).alias("metadata"),
    )


def text_documents(spark: SparkSession, paths: str | list[str], recursive: bool = False, suffix: str = "txt") -> DataFrame:
    """Whole text files of folders or paths. Missing and unreadable ones are skipped."""
    if not paths:
        raise ValueError("no paths given")
    reader = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", f"*.{suffix}").option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True)
    return as_documents(reader.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def not_yet_read(files: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """Each file once, without those that the manifest has."""
    return files.dropDuplicates([key]).join(manifest.select(key), key, "left_anti")


def patient_records(spark: SparkSession, path: str) -> DataFrame:
    """Nested JSON records, one a file; what is no object or has no patient_id is left out."""
    return spark.read.schema(PATIENT).option("recursiveFileLookup", True).option("mode", "PERMISSIVE").json(path, multiLine=True).filter("patient_id is not null")


def field_documents(spark: SparkSession, path: str) -> DataFrame:
    """Extracted-field JSON; malformed files are left out."""
    rows = spark.read.schema(FIELDS).option("recursiveFileLookup", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path, multiLine=True)
    return rows.filter("_corrupt_record is null and fields is not null").drop("_corrupt_record")


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """With a header; all columns are strings."""
    return spark.read.csv(path, header=True, inferSchema=False)


def transcriptions(spark: SparkSession, path: str, group: str = "medical_specialty", text: str = "transcription") -> DataFrame:
    """Texts that are not blank, numbered inside their group. Groups stay rows; none is gathered into one."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    missing = {group, text} - set(rows.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    return rows.select(tx.strip(F.col(group)).alias("specialty"), F.col(text).alias("text")).filter(tx.blank_to_null(F.col("text")).isNotNull() & F.col("specialty").isNotNull())


def pages(spark: SparkSession, path: str, decode: Callable[[bytes], list[str]], suffix: str = "pdf") -> DataFrame:
    """Pages of binary documents: source, page_number from 1, text, error. ``decode`` turns a file's bytes into page texts.

    Blank pages are kept. What fails to decode is one row with the error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    found = [(name, i, t, None) for i, t in enumerate(decode(bytes(content)), 1)]
                except Exception as e:  # noqa: BLE001  any decoder's failure is a row
                    found = [(name, 0, None, repr(e))]
                yield pd.DataFrame(found, columns=["source", "page_number", "text", "error"])

    return files.mapInPandas(run, "source string, page_number int, text string, error string")


def listing(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("txt", "json")) -> DataFrame:
    """Files of each folder with type and size; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    suffix = F.lower(F.element_at(F.split("path", r"\."), -1))
    parts = F.split("path", "/")
    own = rows.withColumn("type", suffix).filter(F.col("type").isin(*suffixes))
    return own.select(F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"), "type", "path", F.col("length").alias("size"))


def landing_stream(spark: SparkSession, path: str, suffix: str = "txt") -> DataFrame:
    """A stream of the text files that arrive in a folder, as documents."""
    stream = spark.readStream.option("pathGlobFilter", f"*.{suffix}").text(path, wholetext=True)
    return as_documents(stream.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def graph_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a saved graph."""
    return {t: spark.read.parquet(f"{path}/{t}") for t in ("documents", "entities", "edges")}


# Names and streets of generated people.
FIRST = ["Ava", "Liam", "Mei", "Noah", "Priya", "Omar", "Sofia", "James", "Aria", "Lucas"]
LAST = ["Lee", "Walker", "Ahmed", "Wu", "Garcia", "Patel", "Brown", "Kim", "Singh", "Novak"]
STREETS = ["Maple", "Oak", "Cedar", "Pine", "Birch"]
SETS = [["birth", "license"], ["license", "passport", "insurance"], ["birth", "passport", "medical"], ["license", "insurance", "medical"]]


def seeded(*parts) -> Column:
    """A number from 0 to 1 that the parts decide."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("long"), F.lit(10_000)) / 10_000.0


def _pick(values: list[str], at) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(at * len(values)) + 1).cast("int"))


def people(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """Generated people with ids, a date of birth and an address; for every fourth the insurer has the day after."""
    i = F.col("id").cast("string")
    s = F.lit(str(seed))
    number = lambda what, digits: F.lpad((seeded(i, s, F.lit(what)) * 10**4 * 997 + F.col("id")).cast("long").cast("string"), digits, "0")
    dob = F.date_add(F.lit("1950-01-01").cast("date"), (seeded(i, s, F.lit("dob")) * 20_000).cast("int"))
    address = F.concat_ws(" ", (F.floor(seeded(i, s, F.lit("house")) * 900) + 100).cast("string"), _pick(STREETS, seeded(i, s, F.lit("street"))), F.lit("Street, Vancouver, BC, V6B 2W9"))
    rows = spark.range(n).select("id", _pick(FIRST, seeded(i, s, F.lit("first"))).alias("first"), _pick(LAST, seeded(i, s, F.lit("last"))).alias("last"), dob.alias("dob"), address.alias("address"), number("license", 8).alias("license"), number("passport", 8).alias("passport"), number("policy", 8).alias("policy"))
    rows = rows.withColumn("contradiction", F.col("id") % 4 == 3).withColumn("insurance_dob", F.when(F.col("contradiction"), F.date_add("dob", 1)).otherwise(F.col("dob")))
    sets = F.array(*[F.array(*[F.lit(d) for d in x]) for x in SETS])
    return rows.withColumn("name", F.concat_ws(" ", "first", "last")).withColumn("documents", F.element_at(sets, (F.col("id") % len(SETS) + 1).cast("int")))


def generated_texts(people_: DataFrame) -> DataFrame:
    """One text for each document of each person: id, kind, text."""
    line = lambda label, c: F.concat(F.lit(f"{label}: "), c.cast("string"))
    c = F.col
    texts = {
        "birth": ["BIRTH CERTIFICATE", line("Name", c("name")), line("Date of Birth", c("dob"))],
        "license": ["DRIVER LICENSE", line("Name", c("name")), line("Date of Birth", c("dob")), line("License Number", F.concat(F.lit("D"), c("license"))), line("Address", c("address"))],
        "passport": ["PASSPORT", line("Surname", c("last")), line("Given Names", c("first")), line("Passport Number", F.concat(F.lit("P"), c("passport")))],
        "insurance": ["INSURANCE POLICY", line("Policyholder", c("name")), line("Date of Birth", c("insurance_dob")), line("Policy Number", F.concat(F.lit("INS-"), c("policy")))],
        "medical": ["MEDICAL RECORD", line("Patient", c("name")), line("Date of Birth", c("dob"))],
    }
    rows = people_.withColumn("kind", F.explode("documents"))
    out = F
    for kind, parts in texts.items():
        out = out.when(c("kind") == kind, F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts]))
    return rows.select("id", "kind", out.alias("text"))


def generated_fields(people_: DataFrame) -> DataFrame:
    """One field record for each document of each person."""
    rows = people_.withColumn("kind", F.explode("documents"))
    field = lambda v: F.struct(v.cast("string").alias("value"), F.round(0.9 + seeded(v.cast("string"), F.col("kind")) / 10, 3).alias("confidence"), F.lit(1).alias("page"), F.array(*[F.lit(0)] * 4).alias("bounding_box"))
    dob = F.when(F.col("kind") == "insurance", F.col("insurance_dob")).otherwise(F.col("dob"))
    kinds = {"birth": "BIRTH_CERTIFICATE", "license": "DRIVERS_LICENSE", "passport": "PASSPORT", "insurance": "INSURANCE", "medical": "MEDICAL_RECORD"}
    return rows.select(rules.lookup(F.col("kind"), kinds, F.lit("GENERIC")).alias("document_type"), F.lit(0.95).alias("confidence"), F.concat_ws("_", F.col("id").cast("string"), "kind").alias("source_file"), F.create_map(F.lit("name"), field(F.col("name")), F.lit("dob"), field(dob)).alias("fields"))


def assigned_texts(people_: DataFrame, texts: DataFrame, preferred: dict[str, str], done: DataFrame, seed: int = 42) -> DataFrame:
    """To each person one text of their preferred specialty, else of any, by a seeded order; those already done are left out.

    Texts are numbered inside their specialty and overall; a person takes the number that their hash gives.
    """
    from pyspark.sql.window import Window

    kind = F.element_at(F.create_map(*[F.lit(x) for kv in preferred.items() for x in kv]), F.col("name")) if preferred else F.lit(None).cast("string")
    open_ = people_.select("id", "name").join(done.select("id"), "id", "left_anti").withColumn("specialty", kind)
    numbered = texts.withColumn("n", F.row_number().over(Window.partitionBy("specialty").orderBy(F.xxhash64("text"), "text")) - 1)
    counts = texts.groupBy("specialty").agg(F.count(F.lit(1)).alias("many"))
    wanted = open_.join(counts, "specialty", "left")
    # Where there is no text of the preferred kind, any text: the kind in whose share of all texts the person's hash falls. One row, of few kinds.
    kinds = counts.agg(F.array_sort(F.collect_list(F.struct("specialty", "many"))).alias("kinds"), F.sum("many").alias("all"))
    upto = lambda i: F.aggregate(F.slice("kinds", F.lit(1), i + 1), F.lit(0).cast("long"), lambda s, k: s + k["many"])
    ends = F.transform("kinds", lambda k, i: F.struct(k["specialty"].alias("specialty"), k["many"].alias("many"), upto(i).alias("end")))
    kinds = kinds.select(ends.alias("ends"), "all")
    other = F.get(F.filter("ends", lambda k: k["end"] > F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.col("all"))), F.lit(0))
    wanted = wanted.join(F.broadcast(kinds)).withColumn("other", other)
    wanted = wanted.select("id", "name", F.when(F.col("many").isNull(), F.col("other.specialty")).otherwise(F.col("specialty")).alias("specialty"), F.coalesce("many", F.col("other.many")).alias("many"))
    wanted = wanted.withColumn("n", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("many")).cast("int"))
    return wanted.join(numbered, ["specialty", "n"]).select("id", "name", "specialty", "text")


def pseudonyms(keys: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Names without repetition: keys in hash order take the combinations of first and last names in turn, later rounds with a number.

    The rank is made of a rank inside one of 256 hash ranges and the sizes of the ranges before it.
    """
    from pyspark.sql.window import Window

    h = F.xxhash64(key, F.lit(seed))
    rows = keys.select(key).withColumn("h", h).withColumn("range", F.shiftright(h, 56))
    within = rows.withColumn("r", F.row_number().over(Window.partitionBy("range").orderBy("h", key)) - 1)
    sizes = rows.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = within.join(F.broadcast(before), "range").withColumn("rank", F.col("r") + F.col("before"))  # at most 256 rows
    total = len(FIRST) * len(LAST)
    at = F.pmod("rank", F.lit(total)).cast("int")
    first, last = (F.element_at(F.array(*[F.lit(v) for v in vs]), i + 1) for vs, i in ((FIRST, at % len(FIRST)), (LAST, F.floor(at / len(FIRST)).cast("int"))))
    again = F.floor(F.col("rank") / total)
    return rank.select(key, F.concat_ws(" ", first, last, F.when(again > 0, (again + 1).cast("string"))).alias("name"))
