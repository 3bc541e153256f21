"""Stupid-backoff scores of documents under the n-gram counts of all others.

Count tables of n-grams are partitioned by the n-gram's hash. The corpus is cut
into parts of a few megabytes, whose texts are turned once into word numbers of a
vocabulary of the part's own. A part explodes its texts into n-grams, counts them,
and sends each distinct one with its count to the table's range; there counts are
added up over all parts and joined back to those that sent the n-gram. Scores are
summed for each document. A document's own occurrences are taken off the counts,
so no text vouches for itself (its copies do).

Rows of these tables are blocks: the sorted n-grams of one part in one range of
the hash, with their counts. As rows of one n-gram each the same tables are over
ten times the input.

An n-gram is counted across parts only if both n-grams of one word less that it
holds are known to other parts too: otherwise no other part can hold it, and its
count is that of its own part. This is exact and leaves most rare n-grams at home.

A word's score, with counts c() over all other documents, N words in them:
  c(uvw) / c(uv) if c(uvw) > 0, else BACKOFF times
  c(vw) / c(v)   if c(vw) > 0,  else BACKOFF times
  c(w) / N       if c(w) > 0,   else 1 / (N + 1)
where words that have no such words before them begin at the longest n-gram they
have, without a factor.

Defined results: null and empty texts have no words and score 0; repeated rows
are documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import collections
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, mix, release, short_batches
from .exchange import PART_BYTES, part_of, send, sized, squeeze, stretch, totalled, totals_heard
from .exchange import SENT as SENT_SCHEMA

ORDER = 3
BACKOFF = 0.4
#: Multiplier by which the hash of an n-gram takes up its next word.
NEXT = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary(dict):
    """Numbers of words, in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


class Part:
    """Some texts as numbers of their words: ``ids``, with ``hashes`` of the words and ``lengths`` of the texts."""

    def __init__(self, texts: list[bytes | None], vocabulary: Vocabulary | None = None):
        vocabulary = Vocabulary() if vocabulary is None else vocabulary
        each = [np.fromiter(map(vocabulary.__getitem__, words), np.uint32, len(words)) for words in ((t or b"").split() for t in texts)]
        self.lengths = np.array([len(x) for x in each], dtype=np.int64)
        self.ids = np.concatenate(each) if each else np.empty(0, np.uint32)
        self.hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), np.uint64, len(vocabulary))
        self._edges()

    def _edges(self) -> None:
        self.ends = np.cumsum(self.lengths)
        self.begins = self.ends - self.lengths
        self.doc = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        self.at = (np.arange(len(self.ids)) - self.begins[self.doc]).astype(np.int32)

    def columns(self) -> tuple[bytes, bytes, bytes]:
        return squeeze(self.lengths), self.hashes.tobytes(), squeeze(self.ids)

    @classmethod
    def read(cls, lengths: bytes, hashes: bytes, ids: bytes) -> Part:
        self = cls.__new__(cls)
        self.lengths, self.ids = stretch(lengths).astype(np.int64), stretch(ids).astype(np.uint32)
        self.hashes = np.frombuffer(hashes, np.uint64)
        self._edges()
        return self


class Grams:
    """The distinct n-grams of a part: ``number`` of the n-gram at each of ``places``, and of each number its hash.

    ``order`` sorts the places by number and leaves them in order inside a number.
    """

    def __init__(self, part: Part, below: Grams | None = None):
        self.part = part
        if below is None:
            self.n, self.places, self.number = 1, np.arange(len(part.ids), dtype=np.int32), part.ids.astype(np.int32)
            self.hashes, self.order = part.hashes, None
        else:
            self.n = below.n + 1
            self.places = (np.flatnonzero(part.at >= self.n - 1) - (self.n - 1)).astype(np.int32)
            shorter = np.zeros(len(part.ids), np.uint64)
            shorter[below.places] = below.number
            left, right = shorter[self.places], part.ids[self.places + self.n - 1].astype(np.uint64)
            wide, deep = max(1, len(part.hashes)).bit_length(), max(1, len(self.places)).bit_length()
            key = left << np.uint64(wide) | right
            if max(1, len(below.hashes)).bit_length() + wide + deep <= 64:
                packed = np.sort(key << np.uint64(deep) | np.arange(len(key), dtype=np.uint64))
                self.order, key = (packed & np.uint64((1 << deep) - 1)).astype(np.int32), packed >> np.uint64(deep)
                del packed
            else:
                self.order = np.argsort(key, kind="stable").astype(np.int32)
                key = key[self.order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            self.number = np.empty(len(key), np.int32)
            self.number[self.order] = np.cumsum(new, dtype=np.int32) - 1
            first = key[new]
            left, right = (first >> np.uint64(wide)).astype(np.int32), (first & np.uint64((1 << wide) - 1)).astype(np.int32)
            self.hashes = mix(below.hashes[left] * NEXT + part.hashes[right])
            # The n-gram of one word less at its end begins one place on.
            self.inside = left, shorter[self.places[self.order[new]] + 1].astype(np.int32)
        self.many = np.bincount(self.number, minlength=len(self.hashes))

    def sent(self, below: Grams | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers of n-grams that other parts may hold, by hash; their hashes and counts."""
        which = np.arange(len(self.hashes)) if below is None else np.flatnonzero(below.shared[self.inside[0]] & below.shared[self.inside[1]])
        which = which[np.argsort(self.hashes[which])]
        hashes, many = self.hashes[which], self.many[which]
        if (same := hashes[1:] == hashes[:-1]).any():  # two n-grams of one hash are one key
            first = np.flatnonzero(np.concatenate([[True], ~same]))
            return which, hashes[first], np.add.reduceat(many, first)
        return which, hashes, many

    def hear(self, below: Grams | None, answers: pa.Table, bits: int) -> None:
        """Take up ``shared`` and ``total`` of each number: whether another part holds it, and its count over all."""
        which, hashes, _ = self.sent(below)
        shared, totals = totals_heard(answers, self.n, hashes, bits)
        self.shared, self.total = np.zeros(len(self.hashes), bool), self.many.astype(np.int64)
        at = np.searchsorted(hashes, self.hashes[which]) if len(hashes) < len(which) else slice(None)
        self.shared[which] = shared[at]
        self.total[which] = np.where(shared[at], totals[at], self.total[which])

    def counts(self) -> np.ndarray:
        """For each place, the count over other documents of the n-gram that begins there (0 where none does)."""
        out = np.zeros(len(self.part.ids), dtype=np.int64)
        if not len(self.places):
            return out
        if self.order is None:
            deep = max(1, len(self.places)).bit_length()
            packed = np.sort(self.number.astype(np.uint64) << np.uint64(deep) | np.arange(len(self.places), dtype=np.uint64))
            self.order = (packed & np.uint64((1 << deep) - 1)).astype(np.int32)
        number, doc = self.number[self.order], self.part.doc[self.places[self.order]]
        new = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (doc[1:] != doc[:-1])]))
        own = np.diff(np.append(new, len(number)))
        out[self.places[self.order]] = self.total[number] - np.repeat(own, own)
        return out


def _logs(part: Part, counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The logarithm of each word's score but for the number of other words; which words were seen alone, and which never."""
    order = len(counts)
    before = np.minimum(part.at, order - 1)  # words that can be looked back at
    seen = counts[0] > 0
    out = np.log(np.maximum(counts[0], 1)) + before * math.log(BACKOFF)
    alone = np.ones(len(out), bool)
    for k in range(2, order + 1):
        # the k-gram that ends at a word begins k - 1 places before it
        ends = np.flatnonzero(part.at >= k - 1)
        c, context = counts[k - 1][ends - (k - 1)], counts[k - 2][ends - (k - 1)]
        use = c > 0
        ends = ends[use]
        out[ends] = np.log(c[use] / np.maximum(context[use], 1)) + (before[ends] - (k - 1)) * math.log(BACKOFF)
        alone[ends] = False
    return out, alone & seen, alone & ~seen


def _by_doc(part: Part, values: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return sums[part.ends] - sums[part.begins]


def _parts(docs: DataFrame) -> DataFrame:
    """One row for each part: part, doc_ids, lengths, hashes, ids."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, held, size = TaskContext.get().partitionId(), 0, [], 0
        last = next(batches, None)
        while last is not None:
            held.append(last)
            size += last.column("text").nbytes
            last = next(batches, None)
            if size >= PART_BYTES or last is None:
                texts = [t for b in held for t in b.column("text").cast(pa.large_binary()).to_pylist()]
                ids = pa.concat_arrays([b.column("doc_id") for b in held])
                lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([pa.array([task << 32 | n], pa.int64()), lists, *[pa.array([c], pa.binary()) for c in Part(texts).columns()]], ["part", "doc_ids", "lengths", "hashes", "ids"])
                n, held, size = n + 1, [], 0
        release()

    return docs.select("doc_id", "text").mapInArrow(run, f"part long, doc_ids array<{kind.simpleString()}>, lengths binary, hashes binary, ids binary")


def _read(table: pa.Table) -> Part:
    return Part.read(*[table.column(c)[0].as_py() for c in ("lengths", "hashes", "ids")])


def scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, log_score."""
    short_batches(docs.sparkSession)
    _, bits = sized(docs)
    cells = _parts(docs).groupBy("part")

    def levels(part: Part, answers: pa.Table, upto: int) -> Iterator[Grams]:
        """N-grams of one word, of two and so on, with what was answered; each needs only the one before."""
        grams = None
        for _ in range(upto):
            below, grams = grams, Grams(part, grams)
            grams.hear(below, answers, bits)
            yield grams

    def first(key: tuple, table: pa.Table) -> pa.Table:
        _, hashes, many = Grams(_read(table)).sent(None)
        return send(part_of(key), hashes, many, bits, squeeze)

    def longer(n: int):
        def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
            part = _read(table)
            below = collections.deque(levels(part, answers, n - 1), maxlen=1)[0]
            _, hashes, many = Grams(part, below).sent(below)
            return send(part_of(key), hashes, many, bits, squeeze)

        return run

    def final(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        part = _read(table)
        logs, alone, unseen = _logs(part, [g.counts() for g in levels(part, answers, order)])
        sums = [_by_doc(part, x) for x in (logs, alone.astype(np.int64), unseen.astype(np.int64))]
        return pa.Table.from_arrays([table.column("doc_ids").combine_chunks().flatten(), pa.array(part.lengths, pa.int64()), *map(pa.array, sums)], ["doc_id", "n_words", "logs", "alone", "unseen"])

    every = totalled(cells.applyInArrow(first, SENT_SCHEMA), bits, 1)
    for n in range(2, order + 1):
        every = every.unionByName(totalled(cells.cogroup(every.groupBy("part")).applyInArrow(longer(n), SENT_SCHEMA), bits, n))
    names = (("n_words", T.LongType()), ("logs", T.DoubleType()), ("alone", T.LongType()), ("unseen", T.LongType()))
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, t) for n, t in names]])
    out = materialize(cells.cogroup(every.groupBy("part")).applyInArrow(final, schema), "lm-sums")
    others = F.lit(out.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]) - F.col("n_words")
    log = F.col("logs") - F.col("alone") * F.log(F.greatest(others, F.lit(1))) - F.col("unseen") * F.log(others + 1)
    return out.select("doc_id", "n_words", log.cast("double").alias("log_score"))
