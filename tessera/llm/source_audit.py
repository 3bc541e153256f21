r"""Source divergence audit with integer dictionaries.

How far is each source of a language from the other sources, and which terms set it
apart? Terms are runs of letters (``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``, only A-Z
lowered). Shares are whole billionths, so all arithmetic is exact.

1. Texts are counted where they lie: a batch's bytes are translated and split at
   once, words become integer codes, and one sort of (language, term, source) codes
   gives the documents and occurrences of each. What leaves a task is one row for
   each term of a language that it met, with its sources' counts.
2. Terms of a language are dealt in chunks by their hash; as many chunks as the rows
   ask for. Each chunk sorts its terms by UTF-8, keeps those in enough documents, and
   numbers them: an id is a term's place among the kept terms, so ids order as terms.
3. The totals of each group and the number of kept terms of each language are added
   up, and each chunk gets those of its language. It lays counts out in dense slices
   (groups by ids), sums the divergence of each pair of groups over its terms, and
   picks each group's terms of largest value, ties by id. Sums and picks of all chunks
   are then added up and ranked.

A common term is one row of each task, a common source one number in it. A slice has
at most ``CELLS`` numbers, whatever the number of groups. Pairs are part of the
result, so sums are as many as pairs of sources that share a language.

Defined results: null text, lang and source are empty; an empty language or source is
one like any other. A group without terms has count 0 of each kept term. A language
without kept terms gives pairs of value 0 and no terms. A lone source has no pairs.
Repeated rows are documents of their own. Ties in value are ordered by item. Other
columns, whatever their names, are ignored. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, release, shuffle_partitions

#: Documents of its language that a kept term is in, at least.
LEAST_DOCUMENTS = 3
#: Terms reported of a group.
TERMS = 200
#: Shares are counted in these.
UNIT = 1_000_000_000
#: Bytes of text that a task counts at a time.
SPAN = 32_000_000
#: Rows of (task, term) that make up a chunk, about.
CHUNK_ROWS = 200_000
#: Numbers in a dense slice, and pairs that are summed at a time.
CELLS = 1_000_000

#: All that is no part of a term becomes a space; A-Z become a-z.
_TABLE = bytes(32 if c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if c < 0x5B else c for c in range(256))

_COUNTED = "lang string, term string, documents long, sources array<string>, counts array<long>"
_KEPT = "lang string, chunk long, terms array<string>, sources array<string>, sums array<long>, source_ids array<int>, term_ids array<int>, counts array<long>"
_SCORED = "lang string, source string, part string, item string, value long"


def _words(texts: pa.Array) -> pa.ListArray:
    """The terms of each text, with empty strings where a text begins or ends with something else."""
    _, offsets, data = texts.buffers()
    clean = pa.py_buffer((data.to_pybytes() if data else b"").translate(_TABLE))
    return pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), len(texts), [None, offsets, clean], offset=texts.offset))


def _starts(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.empty(0, np.int64)


def _lists(starts: np.ndarray, end: int, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, end), pa.int32()), values)


def _count(docs: pa.Table) -> pa.RecordBatch | None:
    """One row for each term of a language in these documents."""
    words = _words(docs.column("text").combine_chunks())
    flat = words.flatten()
    if not len(flat):
        return None
    coded = flat.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
    full = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[code]
    v = len(coded.dictionary)
    # occurrences of each term in each document
    inside = np.sort((doc * v + code)[full])
    if not len(inside):
        return None
    at = _starts(inside)
    times = np.diff(np.append(at, len(inside)))
    doc, code = np.divmod(inside[at], v)
    langs, sources = (docs.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
    lang, source = (x.indices.to_numpy().astype(np.int64)[doc] for x in (langs, sources))
    # one sort by language, term and source
    s = len(sources.dictionary)
    key = (lang * v + code) * s + source
    order = np.argsort(key, kind="stable")
    key = key[order]
    fine = _starts(key)
    counts = np.add.reduceat(times[order], fine)
    term = key[fine] // s
    coarse = _starts(term)
    found = np.diff(np.append(fine[coarse], len(key)))
    lang, code = np.divmod(term[coarse], v)
    arrays = [langs.dictionary.take(pa.array(lang)), coded.dictionary.take(pa.array(code)), pa.array(found, pa.int64())]
    arrays += [_lists(coarse, len(fine), sources.dictionary.take(pa.array(key[fine] % s))), _lists(coarse, len(fine), pa.array(counts, pa.int64()))]
    return pa.RecordBatch.from_arrays(arrays, names=["lang", "term", "documents", "sources", "counts"])


def counted(docs: DataFrame) -> DataFrame:
    """Rows (lang, term, documents, sources, counts): what each task met; a term may have a row from many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            out = _count(pa.Table.from_batches(held)) if held else None
            held.clear()
            for a in range(0, out.num_rows if out else 0, 50_000):
                yield out.slice(a, 50_000)

        for b in batches:
            held.append(b)
            if sum(x.nbytes for x in held) >= SPAN:
                yield from flush()
        yield from flush()
        release()

    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]).mapInArrow(run, _COUNTED)


def _merge(least: int):
    """Of a chunk's rows of one language: its kept terms in order, and the counts by source and id."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        coded = table.column("term").combine_chunks().dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()  # by bytes
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        term = place[coded.indices.to_numpy()]
        kept = np.flatnonzero(np.bincount(term, table.column("documents").to_numpy(), len(order)) >= least)
        lists = table.column("sources").combine_chunks()
        sources = lists.flatten().dictionary_encode()
        source = sources.indices.to_numpy().astype(np.int64)
        counts = table.column("counts").combine_chunks().flatten().to_numpy()
        term = np.repeat(term, np.diff(lists.offsets.to_numpy()))
        ids = np.searchsorted(kept, term)
        own = (ids < len(kept)) & (kept[np.minimum(ids, len(kept) - 1)] == term) if len(kept) else np.zeros(len(term), bool)
        by = ids[own] * len(sources.dictionary) + source[own]
        order_by = np.argsort(by, kind="stable")
        by = by[order_by]
        at = _starts(by)
        total = np.add.reduceat(counts[own][order_by], at) if len(at) else np.empty(0, np.int64)
        term_ids, source_ids = np.divmod(by[at], len(sources.dictionary))
        sums = np.zeros(len(sources.dictionary), np.int64)
        np.add.at(sums, source_ids, total)
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        names = coded.dictionary.take(pa.array(order[kept]))
        arrays = [pa.array([key[0].as_py()], pa.string()), pa.array([key[1].as_py()], pa.int64()), _lists(np.zeros(1, int), len(names), names), _lists(np.zeros(1, int), len(sums), sources.dictionary)]
        arrays += [one(sums, pa.int64()), one(source_ids, pa.int32()), one(term_ids, pa.int32()), one(total, pa.int64())]
        return pa.Table.from_arrays(arrays, names=["lang", "chunk", "terms", "sources", "sums", "source_ids", "term_ids", "counts"]).slice(0, int(len(kept) > 0))

    return run


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total), digit by digit, so that no product leaves 64 bits."""
    out, rest = np.divmod(counts + 1, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _score(top: int):
    """Of each chunk: the sums of all pairs of groups, and each group's terms of largest value."""

    def emit(lang: str, names: pa.Array, part: str, source: np.ndarray, items: pa.Array, value: np.ndarray) -> pa.RecordBatch:
        n = len(value)
        return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), names.take(pa.array(source)), pa.array([part] * n, pa.string()), items, pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])

    def chunk(row: dict[str, object]) -> Iterator[pa.RecordBatch]:
        names: pa.Array = row["names"]
        s, v = len(names), row["n_terms"]
        place = {x: i for i, x in enumerate(names.to_pylist())}
        source = np.array([place[x] for x in row["sources"].to_pylist()], np.int64)[row["source_ids"].to_numpy()]
        term, count = row["term_ids"].to_numpy(), row["counts"].to_numpy()
        sums = row["totals"].to_numpy()
        total, whole = (sums + v)[:, None], np.int64(sums.sum() + v)
        width, tile = max(1, CELLS // s), max(1, CELLS // s)
        n = len(row["terms"])
        picked: list[np.ndarray] = []
        for a in range(0, s, tile):
            pairs = np.zeros((min(tile, s - a), s), np.int64)
            for low in range(0, n, width):
                high = min(low + width, n)
                x, y = np.searchsorted(term, [low, high])
                dense = np.zeros((s, high - low), np.int64)
                dense[source[x:y], term[x:y] - low] = count[x:y]
                p = shares(dense, total)
                for i in range(len(pairs)):
                    pairs[i] += divergence(p[a + i], p).sum(axis=1)
                if a == 0:
                    q = shares(dense.sum(axis=0), whole)
                    mine, all_of_it = p[source[x:y], term[x:y] - low], q[term[x:y] - low]
                    more = mine > all_of_it
                    picked.append(np.stack([source[x:y][more], term[x:y][more], divergence(mine[more], all_of_it[more])]))
            i, j = np.divmod(np.arange(pairs.size), s)
            other = i + a != j
            yield emit(row["lang"], names, "pair", (i + a)[other], names.take(pa.array(j[other])), pairs.ravel()[other])
        src, ids, value = np.concatenate(picked, axis=1)
        order = np.lexsort((ids, -value, src))
        src, ids, value = src[order], ids[order], value[order]
        at = _starts(src)
        best = np.arange(len(src)) - np.repeat(at, np.diff(np.append(at, len(src)))) < top
        yield emit(row["lang"], names, "term", src[best], row["terms"].take(pa.array(ids[best])), value[best])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                cells = {c: b.column(c)[i] for c in b.schema.names}
                yield from chunk({c: x.values if isinstance(x, pa.ListScalar) else x.as_py() for c, x in cells.items()})
        release()

    return run


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TERMS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): ``pair`` against each other source, ``term`` the terms that stand out."""
    spark = docs.sparkSession
    parts = materialize(counted(docs), "audit-counted")
    chunks = max(1, -(-parts.count() // CHUNK_ROWS))
    dealt = parts.withColumn("chunk", F.pmod(F.xxhash64("term"), F.lit(chunks))).repartition(max(shuffle_partitions(spark), chunks), "lang", "chunk")
    kept = materialize(dealt.groupBy("lang", "chunk").applyInArrow(_merge(least), _KEPT), "audit-kept")

    sizes = kept.groupBy("lang").agg(F.sum(F.size("terms")).alias("n_terms"))
    sums = kept.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.sums").alias("total"))
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    totals = materialize(groups.join(sums, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "n_terms"]), "audit-totals")

    sheet = totals.filter("n_terms > 0").groupBy("lang", "n_terms").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("g"))
    sheet = kept.select("lang", "chunk").join(sheet.select("lang", "n_terms", F.col("g.source").alias("names"), F.col("g.total").alias("totals")), "lang")
    ready = kept.drop("sums").join(sheet, ["lang", "chunk"]).repartition(max(shuffle_partitions(spark), chunks), "lang", "chunk")
    scored = materialize(ready.mapInArrow(_score(top), _SCORED), "audit-scored")

    bare = totals.filter("n_terms = 0").select("lang", "source")
    none = bare.join(bare.withColumnRenamed("source", "item"), "lang").filter("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    added = scored.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = added.unionByName(none).withColumn("rank", rank)
    return pairs.unionByName(scored.filter("part = 'term'").withColumn("rank", rank).filter(F.col("rank") <= top))
