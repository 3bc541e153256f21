"""Where a document's values stand in its text: line, paragraph and both offsets, in one pass for all of them.

A document's own values become one automaton (Aho-Corasick), and its text is read once,
however many values there are. Values go to their documents by one join; a document and
its values are one row, so nothing grows but with the text.

Results: the first place of each value, whatever the case; offsets are of characters,
the end is exclusive; lines count from 1, paragraphs (runs between blank lines that hold
more than white space) from 1; ``source_line`` is the line the value begins in. A value
that the text doesn't hold has nulls, and so have values of documents that aren't there.
Null and empty values, with white space at the ends taken off, are left out. Repeated
values and keys keep their rows.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions import text as tx

_PLACE = [("line", pa.int32()), ("paragraph", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("source_line", pa.string())]


def folded(text: str) -> str:
    """Lower case, one character for each."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def first_places(text: str, values: list[str]) -> dict[str, int]:
    """Of each folded value its first place in the folded text, if there is one; the text is read once."""
    automaton = ahocorasick.Automaton()
    for v in values:
        automaton.add_word(v, v)
    automaton.make_automaton()
    found: dict[str, int] = {}
    for end, v in automaton.iter(text):
        if v not in found:
            found[v] = end + 1 - len(v)
            if len(found) == len(automaton):
                break
    return found


def located(text: str | None, values: list[str]) -> list[tuple]:
    """The columns of ``_PLACE`` for each value."""
    if text is None:
        return [(None,) * len(_PLACE)] * len(values)
    wanted = [folded(v) for v in values]
    found = first_places(folded(text), sorted(set(wanted)))
    breaks = [i for i, c in enumerate(text) if c == "\n"]
    starts, at = [], 0
    for part in text.split("\n\n"):
        if part.strip():
            starts.append(at + len(part) - len(part.lstrip()))
        at += len(part) + 2
    out = []
    for v in wanted:
        if v not in found:
            out.append((None,) * len(_PLACE))
            continue
        start = found[v]
        n = bisect.bisect_left(breaks, start)
        low, high = breaks[n - 1] + 1 if n else 0, breaks[n] if n < len(breaks) else len(text)
        out.append((n + 1, bisect.bisect_right(starts, start), start, start + len(v), text[low:high]))
    return out


def align(values: DataFrame, documents: DataFrame) -> DataFrame:
    """``values`` (doc_id, key, value) with line, paragraph, start, end and source_line in ``documents`` (doc_id, text)."""
    own = values.select("doc_id", F.col("key").cast("string").alias("key"), tx.strip(F.col("value")).alias("value")).filter("value <> ''")
    asked = own.groupBy("doc_id").agg(F.collect_list(F.struct("key", "value")).alias("asked"))  # a document's own attributes
    rows = asked.join(documents.select("doc_id", "text"), "doc_id", "left").select("doc_id", "text", F.col("asked.key").alias("keys"), F.col("asked.value").alias("values"))
    kind = values.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, keys, texts, places = [], [], [], []
            for i, (text, ks, vs) in enumerate(zip(*(b.column(c).to_pylist() for c in ("text", "keys", "values")), strict=True)):
                at += [i] * len(vs)
                keys += ks
                texts += vs
                places += located(text, vs)
            columns = list(zip(*places, strict=True)) or [[]] * len(_PLACE)
            arrays = [b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(keys, pa.string()), pa.array(texts, pa.string()), *[pa.array(c, t) for c, (_, t) in zip(columns, _PLACE, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([("doc_id", to_arrow_type(kind)), ("key", pa.string()), ("value", pa.string()), *_PLACE]))

    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, key string, value string, line int, paragraph int, start int, end int, source_line string")


def aligned_facts(entities: DataFrame, documents: DataFrame) -> DataFrame:
    """One row for each public attribute of ``entities`` (entity_id, name, source_doc_id, attributes) with its fact and its place in the source document."""
    from .retrieve import provenance

    facts = provenance(entities).join(entities.select("entity_id", "source_doc_id"), "entity_id")
    key = F.to_json(F.struct("entity_id", "key"))
    placed = align(facts.select(F.col("source_doc_id").alias("doc_id"), key.alias("key"), "value"), documents).withColumnsRenamed({"key": "__key", "value": "__value"}).dropDuplicates(["doc_id", "__key"])
    own = facts.withColumn("__key", key)
    return own.join(placed.drop("__value"), (own["source_doc_id"] == placed["doc_id"]) & (own["__key"] == placed["__key"]), "left").select("entity_id", "key", own["value"], "fact", "source_doc_id", "line", "paragraph", "start", "end", "source_line")
