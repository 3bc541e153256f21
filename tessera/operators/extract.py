"""From extracted fields and nested records to documents and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import rules
from tessera.functions import text as tx

# Name keys, date keys in order, renamed fields of remote results, keys of a patient's attributes.
NAME_KEYS = ["name", "patient_name"]
DATE_KEYS = ["issue_date", "date", "start_date", "expiry_date", "dob"]
RENAMED = {
    "Last Name": "_last_name", "First Name": "_first_name", "Birth Date": "dob", "Expiration Date": "expiry_date", "Issued Date": "issue_date", "ID Number": "license_number", "Document Number": "passport_number", "Passport Number": "passport_number",
    "Address": "address", "Sex": "sex", "State": "state", "Document Type": "_doc_type_raw", "Surname": "_last_name", "Given Names": "_first_name", "Date of Birth": "dob", "Date of Expiry": "expiry_date", "Date of Issue": "issue_date", "Nationality": "nationality",
    "Place of Birth": "place_of_birth", "MRZ": "mrz", "MRZ Line 1": "mrz_line1", "MRZ Line 2": "mrz_line2",
}


def public(attributes: Column) -> Column:
    """Without private keys."""
    return F.map_filter(attributes, lambda k, _: ~F.startswith(k, F.lit("_")))


def filled(attributes: Column) -> Column:
    """Without null and blank values; the others stripped."""
    return F.transform_values(F.map_filter(attributes, lambda _, v: F.coalesce(tx.strip(v), F.lit("")) != ""), lambda _, v: tx.strip(v))


def merged(base: Column, override: Column) -> Column:
    """Both maps, blanks dropped; the second wins."""
    a, b = filled(base), filled(override)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)


def first_filled(attributes: Column, keys: list[str]) -> Column:
    return F.coalesce(*[tx.blank_to_null(F.try_element_at(attributes, F.lit(k))) for k in keys])


def document_date(attributes: Column) -> Column:
    return first_filled(attributes, DATE_KEYS)


def combined_name(attributes: Column) -> Column:
    """A given name and a surname, found by parts of their keys."""
    of = lambda *parts: F.get(F.map_values(F.map_filter(attributes, lambda k, _: rules.any_of(F.lower(k), list(parts)))), F.lit(0))
    return F.nullif(F.concat_ws(" ", tx.blank_to_null(of("given", "first")), tx.blank_to_null(of("surname", "last"))), F.lit(""))


def entity_name(attributes: Column) -> Column:
    return F.coalesce(first_filled(attributes, NAME_KEYS), combined_name(attributes), F.lit("Unknown"))


def mean_confidence(confidences: Column, default: Column) -> Column:
    """The mean of an array to three places, or the default if it is empty."""
    n = F.size(confidences)
    return F.when(n > 0, F.round(F.aggregate(confidences, F.lit(0.0), lambda s, x: s + x) / n, 3)).otherwise(default)


def filled_share(attributes: Column, keys: list[str]) -> Column:
    """Share of the schema's keys that are filled, to two places."""
    return F.round(F.size(F.array_intersect(F.map_keys(filled(attributes)), F.array(*[F.lit(k) for k in keys]))) / F.lit(len(keys)), 2)


def entities_from_fields(rows: DataFrame) -> DataFrame:
    """From document_type, confidence, source_file, fields (name -> value, confidence, ...) to one entity a file."""
    plain = F.transform_values("fields", lambda _, f: f["value"])
    own = F.filter(F.transform(F.map_values("fields"), lambda f: f["confidence"]), lambda c: c.isNotNull())
    out = rows.withColumn("attributes", filled(plain)).withColumn("entity_confidence", mean_confidence(own, F.col("confidence")))
    return out.select(
        F.sha2(F.concat_ws("|", "source_file", F.to_json("attributes")), 256).alias("entity_id"), "source_file", rules.alias_doc_type(F.col("document_type")).alias("doc_type"),
        entity_name(F.col("attributes")).alias("name"), document_date(F.col("attributes")).alias("doc_date"), F.col("entity_confidence").alias("confidence"), "attributes",
    )


def entity_text(name: Column, attributes: Column) -> Column:
    """What stands for an entity where it is embedded."""
    return F.concat_ws(" ", name, F.to_json(attributes))


def header_person(page: Column, folder: Column) -> Column:
    """name and dob from a document's first page: what follows the first colon of the last line that names them, else the folder's name and null."""
    # What such lines hold.
    names, births = ["patient name", "patient:"], ["date of birth", "dob"]
    last = lambda own, marks: F.try_element_at(F.filter(own, lambda x: rules.any_of(F.lower(x), marks)), F.lit(-1))
    after = lambda line: tx.strip(F.regexp_replace(line, r"^[^:]*:", ""))
    person = lambda own: F.struct(F.coalesce(after(last(own, names)), F.initcap(F.replace(folder, F.lit("_"), F.lit(" ")))).alias("name"), after(last(own, births)).alias("dob"))
    return tx.bound(tx.lines(page), person)


def _proper(name: Column) -> Column:
    """Capitalised if it is in capitals throughout."""
    return F.when((name == F.upper(name)) & (name != F.lower(name)), F.initcap(name)).otherwise(name)


def entities_from_result(rows: DataFrame) -> DataFrame:
    """From a remote result, fields: array<FieldName, IsMissing, Values: array<Value, DerivedValue, Confidence>>, with extractor_id and source_file."""
    best = lambda f: F.get(f["Values"], F.lit(0))
    value = lambda f: tx.strip(F.coalesce(F.nullif(best(f)["Value"], F.lit("")), best(f)["DerivedValue"], F.lit("")))
    clamp = lambda c: F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c, F.lit(1.0)))), 3)
    name = lambda f: rules.lookup(f["FieldName"], RENAMED, F.replace(F.lower(f["FieldName"]), F.lit(" "), F.lit("_")))
    kept = F.filter("fields", lambda f: ~F.coalesce(f["IsMissing"], F.lit(False)) & (F.size(f["Values"]) > 0) & (value(f) != ""))
    items = F.transform(kept, lambda f: F.struct(name(f).alias("key"), value(f).alias("value"), clamp(best(f)["Confidence"]).alias("confidence")))
    out = rows.withColumn("__i", items)
    last = lambda k: F.element_at(F.filter("__i", lambda i: i["key"] == k), -1)
    out = out.withColumn("__last", F.when(F.exists("__i", lambda i: i["key"] == "_last_name"), last("_last_name"))).withColumn("__first", F.when(F.exists("__i", lambda i: i["key"] == "_first_name"), last("_first_name")))
    label = F.when(F.exists("__i", lambda i: i["key"] == "_doc_type_raw"), last("_doc_type_raw")["value"])
    full = F.concat_ws(" ", _proper(F.col("__first.value")), _proper(F.col("__last.value")))
    sure = F.round((F.coalesce("__first.confidence", "__last.confidence") + F.coalesce("__last.confidence", "__first.confidence")) / 2, 3)
    rest = F.filter("__i", lambda i: ~F.startswith(i["key"], F.lit("_")))
    named = F.when(full != "", F.array(F.struct(F.lit("name").alias("key"), full.alias("value"), sure.alias("confidence")))).otherwise(F.filter(rest, lambda _: F.lit(False)))
    out = out.withColumn("items", F.concat(rest, named))
    overall = mean_confidence(F.transform("items", lambda i: i["confidence"]), F.lit(1.0))
    return out.select("source_file", rules.extractor_doc_type(label, F.col("extractor_id")).alias("document_type"), overall.alias("confidence"), "items")


# Attribute names of the three kinds of rows, and the fields of a record that they come from.
PERSON_FIELDS = {
    "patient_id": "patient_id", "dob": "dob", "age": "age", "gender": "gender", "city": "city", "state": "state",
    "insurance_payer": "insurance.payer", "insurance_since": "insurance.member_since",
    "total_billed": "claim_summary.total_billed", "total_covered": "claim_summary.total_covered", "total_owed": "claim_summary.total_owed",
    "denied_claims": "claim_summary.denied_claims", "pending_claims": "claim_summary.pending_claims",
}
CONDITION_FIELDS = {"condition_code": "code", "condition_description": "description", "condition_onset": "onset"}
ENCOUNTER_FIELDS = {
    "encounter_id": "encounter_id", "encounter_date": "date", "encounter_type": "type", "description": "description", "reason": "reason",
    "procedure_code": "procedure_code", "provider": "provider", "payer": "payer", "billed": "billed", "covered": "covered",
    "patient_owes": "patient_owes", "claim_status": "claim_status",
}
#: These are "0" where a record hasn't got them.
ZERO_IF_MISSING = {"total_billed", "total_covered", "total_owed", "denied_claims", "pending_claims", "billed", "covered", "patient_owes"}


def _number_text(c: Column, kind: T.DataType) -> Column:
    """A number as text: fractions without an exponent and without needless zeros, whole ones of a fraction's type with ".0"."""
    if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return F.regexp_replace(c.cast("decimal(38,6)").cast("string"), r"(\.\d+?)0*$", "$1")
    return c.cast("string")


def _attributes(fields: dict[str, str], row: Column | None, kind: T.StructType) -> list[Column]:
    """Names and values for a map, from the columns of a table or, with ``row``, from the fields of a struct."""
    out: list[Column] = []
    for name, path in fields.items():
        value, at = row, kind
        for part in path.split("."):
            if not isinstance(at, T.StructType) or part not in at.names:
                value, at = None, None
                break
            value, at = (F.col(part) if value is None else value[part]), at[part].dataType
        text = F.lit(None).cast("string") if at is None else _number_text(value, at)
        out += [F.lit(name), F.coalesce(text, F.lit("0")) if name in ZERO_IF_MISSING else text]
    return out


def entities_from_patients(records: DataFrame) -> DataFrame:
    """Person, condition and encounter rows of nested patient records, under one schema.

    ``records`` has patient_id, display_name, active_conditions and encounters, and any others of the fields above. All rows bear
    the patient's name ("Unknown" if there is none); attributes are strings, without blank ones, and rows of conditions and encounters
    name their kind.
    """
    schema = records.schema
    of_each = lambda c: schema[c].dataType.elementType
    many = lambda c: F.greatest(F.size(c), F.lit(0)).cast("string")
    name = F.coalesce("display_name", F.lit("Unknown")).alias("name")
    person = F.create_map(*_attributes(PERSON_FIELDS, None, schema), F.lit("active_conditions_count"), many("active_conditions"), F.lit("encounters_count"), many("encounters"))
    out = records.select("patient_id", F.lit("person").alias("record_type"), name, filled(person).alias("attributes"))
    for record_type, column, fields in [("condition", "active_conditions", CONDITION_FIELDS), ("encounter", "encounters", ENCOUNTER_FIELDS)]:
        rows = records.select("patient_id", name, F.explode(column).alias("each"))
        row = F.create_map(*_attributes(fields, F.col("each"), of_each(column)), F.lit("record_type"), F.lit(record_type))
        out = out.unionByName(rows.select("patient_id", F.lit(record_type).alias("record_type"), "name", filled(row).alias("attributes")))
    return out


def person_rows(entities: DataFrame, folder: str) -> DataFrame:
    """Entities that are tagged with a folder, or whose name in snake case holds it."""
    tag = F.try_element_at(F.col("attributes"), F.lit("_person_folder"))
    return entities.filter(F.coalesce(tag == folder, F.lit(False)) | F.contains(F.replace(F.lower("name"), F.lit(" "), F.lit("_")), F.lit(folder)))


def existing_people(entities: DataFrame, name: str) -> DataFrame:
    """Distinct names of which one holds the other, whatever the case."""
    own, asked = F.lower(tx.strip(F.col("name"))), F.lower(F.lit(name))
    return entities.filter((own != "") & (F.contains(own, asked) | F.contains(asked, own))).select("name").distinct()


def reviewed(rows: DataFrame) -> DataFrame:
    """Entities from reviewed attributes: private and blank ones go, the name is found in the others."""
    kept = rows.withColumn("attributes", filled(public(F.col("attributes"))))
    return kept.withColumn("name", entity_name(F.col("attributes")))


def entities_from_replies(rows: DataFrame, schema: dict[str, str]) -> DataFrame:
    """From a model's replies about texts: doc_id, name, attributes, confidence, line_number. No object in a reply, no entity.

    Only the schema's fields are kept; the confidence is the share of them that is filled; the line is the first that has the name.
    """
    keys = F.array(*[F.lit(k) for k in schema])
    known = F.map_filter(F.from_json(tx.json_in(F.col("reply")), "map<string, string>"), lambda k, _: F.array_contains(keys, k))
    own = rows.withColumn("attributes", filled(known)).filter("attributes is not null")
    named = own.withColumn("name", entity_name(F.col("attributes")))
    return named.select("doc_id", "name", "attributes", filled_share(F.col("attributes"), list(schema)).alias("confidence"), tx.line_with(tx.lines(F.col("text")), F.col("name")).alias("line_number"))
