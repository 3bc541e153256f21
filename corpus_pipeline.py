"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage reads what the one before it kept. All but the last return the columns
of ``documents``; the last returns the pieces and where they are packed. Stages
take whole tables and whole texts.

Defined results, of each stage: empty input gives empty output. Columns beyond
``documents``' own pass through, whatever their names. A null or blank text fails
the quality rules; if it comes to a later stage it is kept there (near-dedup links
it with nothing, substring dedup and decontamination find nothing in it) and is
packed as the end token alone. Of repeated rows one stays after near-dedup; other
stages judge them one by one, and substring dedup takes from each what they share.
Of documents that are linked the one with the smallest doc_id stays. A null doc_id
is an id like any other, the smallest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, near_dedup, packing, quality_rules, substring_dedup
from tessera.llm.common import materialize
from tessera.llm.queries import read, tokenizer_path
from tessera.session import ship


#: Similarity in percent from which the near-dedup stage takes documents for copies.
NEAR_PERCENT = 80


def _aside(docs: DataFrame) -> DataFrame:
    """``docs`` with plain names for all columns that no stage looks at, so that none clashes with an operator's own."""
    return docs.toDF(*[c if c in ("doc_id", "text", "lang", "n_chars") else f"column_{i}" for i, c in enumerate(docs.columns)])


def _back(out: DataFrame, aside: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(aside.columns).toDF(*docs.columns)


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that the base rule or their stratum's cutoff rejects go."""
    ship(spark)
    own = _aside(docs)
    judged = quality_rules.judge(own, read(spark, sf_dir, "labels").select("doc_id", "quality"))
    return _back(judged.filter("__kept"), own, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: one document of each group stays."""
    ship(spark)
    own = _aside(docs)
    return _back(near_dedup.deduplicate(own, NEAR_PERCENT), own, docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: words in repeated windows go; ``n_chars`` follows where the text has changed."""
    ship(spark)
    own = _aside(docs)
    out = substring_dedup.remove_repeats(own)
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("__n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))
    return _back(out, own, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark window go."""
    ship(spark)
    own = _aside(docs)
    return _back(decontaminate.clean(own, read(spark, sf_dir, "benchmark")), own, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of the tokenized documents into sequences of 2048 tokens."""
    ship(spark)
    return packing.pack(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [
    ("quality rules", reject_low_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

#: Risk-controlled cutoffs, set similarity and tokens are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
