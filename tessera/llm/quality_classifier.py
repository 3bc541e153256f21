"""A quality classifier of supervised subword embeddings.

A document is the average of learned vectors in hashed buckets: one for each of
its words, one for each pair of neighbouring words, and one for each character
n-gram of its running text, in which white space counts as one blank. A softmax
on the average gives the class. Vectors and softmax are trained together by
stochastic gradient descent on the log loss in numpy, in one task, on a sample of
labelled rows that ``SAMPLE`` bounds.

As the softmax is linear in the average, scoring needs only each bucket's share of
the logit, so every whole text is scored from a table of one number a bucket. Long
texts are taken in blocks that end at a blank; no feature is lost at a cut.

Defined results: null, empty and blank texts have no features and get the bias's
score; repeated rows are scored one by one; a document's label is 1 if the mean of
its labels is at least a half, null labels are ignored; where several rows have one
labelled doc_id the one with the smallest text hash teaches; without labelled rows
to learn from every score is 0.5; a null doc_id is never held out and teaches
nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, powers, short_batches

#: Labelled rows that the classifier learns from, at most; those with the smallest hashes of doc_id.
SAMPLE = 8000
BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS
DIMENSIONS = 8
EPOCHS = 10
#: Of the first step; it falls linearly to 0. High, as a single feature's share of an average is small.
RATE = 5.0
#: Lengths of character n-grams.
GRAMS = (3,)
#: Lengths of word n-grams.
WORD_GRAMS = (1, 2)
SEED = 11
#: Characters of a text that are worked on at one time, about.
BLOCK = 1 << 20

_U64 = np.uint64
_STEP = _U64(0x100000001B3)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def running(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The text's characters with one blank before, after and for each run of white space; the places of the blanks."""
    codes = np.frombuffer(f" {text or ''} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
    keep = ~blank
    keep[0] = True
    keep[1:] |= ~blank[:-1]
    codes = np.where(blank, np.uint32(32), codes)[keep]
    return codes, np.flatnonzero(blank[keep])


def _rolled(values: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hashes of every ``n`` values in a row."""
    h = np.full(len(values) - n + 1, seed, _U64)
    for j in range(n):
        h = h * _STEP + values[j : len(values) - n + 1 + j]
    return mix(h)


def word_hashes(codes: np.ndarray, blanks: np.ndarray) -> np.ndarray:
    """A hash of each word between two blanks, wherever it stands."""
    up, down = powers(max(10, len(codes).bit_length()))
    sums = np.zeros(len(codes) + 1, _U64)
    np.cumsum((codes + _U64(1)) * up[: len(codes)], out=sums[1:])
    first, last = blanks[:-1] + 1, blanks[1:]
    return mix((sums[last] - sums[first]) * down[first])


def features(text: str | None) -> Iterator[np.ndarray]:
    """The buckets of all features of a text, with repeats, block by block."""
    codes, blanks = running(text)
    cuts = [0]
    while cuts[-1] < len(codes) - 1:
        at = np.searchsorted(blanks, min(cuts[-1] + BLOCK, len(codes) - 1))
        cuts.append(int(blanks[at]))
    before = np.empty(0, _U64)  # words that word n-grams reach back to
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = codes[a : b + max(GRAMS)].astype(_U64)
        found = []
        for n in GRAMS:
            if len(part := own[: b - a + n - 1]) >= n:
                found.append(_rolled(part, n, n))
        inside = blanks[np.searchsorted(blanks, a) : np.searchsorted(blanks, b, "right")] - a
        words = word_hashes(own[: b - a + 1], inside)
        line = np.concatenate([before, words])
        for n in WORD_GRAMS:
            reach = line[max(0, len(before) - n + 1) :]
            if len(reach) >= n:
                found.append(_rolled(reach, n, -n % (1 << 64)))
        before = line[max(0, len(line) - max(WORD_GRAMS) + 1) :]
        if found:
            yield (np.concatenate(found) >> _U64(64 - BUCKET_BITS)).astype(np.int32)


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and how often each occurs."""
    total = np.zeros(0, np.int64)
    for buckets in features(text):
        n = np.bincount(buckets)
        n[: len(total)] += total[: len(n)]
        total = n if len(n) >= len(total) else np.concatenate([n, total[len(n) :]])
    where = np.flatnonzero(total)
    return where.astype(np.int32), total[where].astype(np.int32)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float]:
    """Each bucket's share of the logit of label 1, and the bias. ``rows``: label, buckets, counts."""
    if not rows:
        return np.zeros(BUCKETS), 0.0
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    steps, step = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            label, buckets, counts = rows[i]
            shares = (counts / counts.sum()).astype(np.float32)
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            own = vectors[buckets]
            mean = shares @ own
            logits = mean @ weights + bias
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[label] -= 1
            back = weights @ error
            weights -= rate * np.outer(mean, error)
            bias -= rate * error
            vectors[buckets] = own - (rate * shares)[:, None] * back[None, :]
    return (vectors @ (weights[:, 1] - weights[:, 0])).astype(np.float64), float(bias[1] - bias[0])


def score(text: str | None, table: np.ndarray, bias: float) -> float:
    total, n = 0.0, 0
    for buckets in features(text):
        total += table[buckets].sum()
        n += len(buckets)
    return float(1 / (1 + np.exp(-np.clip((total / n if n else 0.0) + bias, -500, 500))))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[np.ndarray, float]:
    """Train on a bounded sample of the labelled rows that are not held out."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("__label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most SAMPLE rows are broadcast
    rows = rows.groupBy("doc_id").agg(F.first("__label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [counted(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.string()), b.column("label"), *[pa.array([x[i].tobytes() for x in found], pa.binary()) for i in (0, 1)]], ["place", "label", "buckets", "counts"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        data = [(int(y), np.frombuffer(b, np.int32), np.frombuffer(n, np.int32)) for y, b, n in zip(pdf["label"], pdf["buckets"], pdf["counts"], strict=True) if len(b)]
        table, bias = train(data)
        return pd.DataFrame({"table": [table.tobytes()], "bias": [bias]})

    built = rows.mapInArrow(build, "place string, label int, buckets binary, counts binary")
    got = built.groupBy(F.lit("all").alias("one")).applyInPandas(fit, "table binary, bias double").collect()
    return (np.frombuffer(bytes(got[0]["table"])), got[0]["bias"]) if got else (np.zeros(BUCKETS), 0.0)


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score."""
    short_batches(docs.sparkSession)
    table, bias = learn(docs, labels, label)
    shared = docs.sparkSession.sparkContext.broadcast(table)  # BUCKETS numbers

    @F.arrow_udf("double")
    def udf(texts: pa.Array) -> pa.Array:
        return pa.array([score(t, shared.value, bias) for t in texts.to_pylist()], pa.float64())

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), udf(F.col("text")).alias("score"))
