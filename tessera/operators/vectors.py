"""Vector search through an inverted file.

Centroids are fitted on a bounded sample (at most ``SAMPLE`` vectors, those with the
smallest hashes of their ids, at most ``CELLS`` centroids); every row is then put into
the cell of its nearest centroid, and each cell knows the widest angle to its centroid.
A question is sent to cells, and its exact cosines with their rows are found in tiles
of bounded size; a cell with many rows or questions is many tiles.

``near`` is exact: it looks into each cell that may hold a vector at the threshold, by
the triangle inequality of angles. ``nearest`` looks into the nearest ``probes`` cells;
how many reach ``RECALL`` is measured on the sample when the index is fitted.

A null, empty or zero vector is near nothing. Vectors of another length than a
question's are not near it; each length has cells of its own, and one that the sample
has not seen is a single cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.storage import materialize

from .candidates import tiled

#: Vectors that centroids are fitted on, and centroids of one length, at most.
SAMPLE, CELLS = 10_000, 1024
#: Rounds of fitting; share of the nearest ``TOP`` that the chosen number of probes finds on the sample.
ROUNDS, TOP, RECALL = 8, 10, 0.95
#: Rows of a cell, and questions to it, in one tile.
TILE = 2048
#: Questions that are sent to cells at a time, and rows of one batch of what is sent.
PIECE = 1024
_SLACK = 1e-9


@dataclass
class Index:
    """``rows``: id (as text), length, cell, embedding. ``centroids`` and ``widest`` (angles) by length of the vectors; ``probes`` by length."""

    rows: DataFrame
    kind: str
    centroids: dict[int, np.ndarray]
    widest: dict[int, np.ndarray]
    probes: dict[int, int]


def _units(vectors: list) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.nan_to_num(x / np.linalg.norm(x, axis=1, keepdims=True))


def _by_length(embeddings: pd.Series) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places and unit vectors of those that have a direction."""
    sizes = np.array([0 if v is None else len(v) for v in embeddings], np.int64)
    for n in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == n)
        units = _units([embeddings.iloc[i] for i in at])
        some = units.any(axis=1)
        if some.any():
            yield n, at[some], units[some]


def _centroids(units: np.ndarray, many: int) -> np.ndarray:
    """Spherical k-means from evenly spread members; a cell that loses all keeps its centroid."""
    c = units[np.linspace(0, len(units) - 1, many).astype(int)]
    for _ in range(ROUNDS):
        own = np.argmax(units @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, units)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(length > 0, sums / np.maximum(length, 1e-300), c)
    return c


def _probes(units: np.ndarray, c: np.ndarray) -> int:
    """The fewest nearest cells in which ``RECALL`` of the sample's own nearest ``TOP`` lie."""
    asked = units[:500]
    top = np.concatenate([np.argsort(-(asked[i : i + 50] @ units.T), axis=1)[:, :TOP] for i in range(0, len(asked), 50)])  # in pieces, as this runs on the driver
    rank = np.empty((len(asked), len(c)), np.int64)
    np.put_along_axis(rank, np.argsort(-(asked @ c.T), axis=1), np.arange(len(c))[None, :], 1)
    own = np.argmax(units @ c.T, axis=1)
    needed = np.sort(np.take_along_axis(rank, own[top], 1).ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))) - 1)])


def sampled(vectors: DataFrame, sample: int) -> tuple[pd.DataFrame, int]:
    """The ``sample`` vectors with the smallest hashes of their ids (column embedding), and the number of all rows.

    Each partition sends its own smallest ``sample`` to the driver, which is most of a table in many partitions. So hashes are
    held under a bound first, which a fifth more than ``sample`` of the rows are under; the same vectors are taken.
    """
    some, at = vectors.filter(F.size("embedding") > 0), F.xxhash64("id")
    n = vectors.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.size("embedding") > 0).alias("some")).first()
    first = lambda d: d.orderBy(at, "id").limit(sample).select("embedding").toPandas()
    if n.some <= 1.2 * sample:
        return first(some), n.total
    bound = -(2**63) + int(2**64 * 1.2 * sample / n.some)
    low = first(some.filter(at < F.lit(bound)))
    return low if len(low) == sample else first(some), n.total


def fit(vectors: DataFrame, sample: int = SAMPLE, cells: int | None = None) -> Index:
    """An index of ``vectors`` (id, embedding). Every row is in it; the sample only shapes the cells."""
    spark = vectors.sparkSession
    some, total = sampled(vectors, sample)
    centroids, probes = {}, {}
    for n, _, units in _by_length(some["embedding"]):
        many = min(cells or CELLS, max(1, round(total**0.5)), max(1, len(units) // 8))
        centroids[n] = _centroids(units, many)
        probes[n] = _probes(units, centroids[n])
    kind = vectors.schema["id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            length, cell, angle = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64), np.full(len(pdf), np.nan)
            for n, at, units in _by_length(pdf["embedding"]):
                length[at], angle[at] = n, np.pi
                if n in shared.value:
                    dots = units @ shared.value[n].T
                    cell[at] = np.argmax(dots, axis=1)
                    angle[at] = np.arccos(np.clip(dots[np.arange(len(at)), cell[at]], -1, 1))
            keep = length > 0
            yield pd.DataFrame({"id": pdf["id"][keep], "length": length[keep], "cell": cell[keep], "angle": angle[keep], "embedding": pdf["embedding"][keep]})

    placed = vectors.select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInPandas(assign, "id string, length long, cell long, angle double, embedding array<double>")
    placed = materialize(placed, "vector-cells")
    widest: dict[int, np.ndarray] = {}
    for r in placed.groupBy("length", "cell").agg(F.max("angle").alias("angle")).collect():  # one row a cell
        widest.setdefault(r.length, np.full(len(centroids.get(r.length, [0])), -1.0))[r.cell] = r.angle
    return Index(placed.drop("angle"), kind, centroids, widest, probes)


def _asked(index: Index, questions: DataFrame, least: float | None, probes: int | None) -> DataFrame:
    """Each question once for each cell that it is sent to: question_id, length, cell, embedding."""
    shared = questions.sparkSession.sparkContext.broadcast((index.centroids, index.widest, index.probes))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids, widest, usual = shared.value
        for pdf in (batch.iloc[i : i + PIECE] for batch in batches for i in range(0, len(batch), PIECE)):
            pdf = pdf.reset_index(drop=True)
            for n, at, units in _by_length(pdf["embedding"]):
                if n not in widest:
                    continue
                known = widest[n] >= 0
                if n not in centroids:
                    sent = np.ones((len(at), 1), bool)
                elif least is not None:
                    angle = np.arccos(np.clip(units @ centroids[n].T, -1, 1))
                    sent = known & (np.cos(np.maximum(0.0, angle - widest[n] - _SLACK)) >= least - _SLACK)
                else:
                    order = np.argsort(np.where(known, -(units @ centroids[n].T), np.inf), axis=1)[:, : probes or usual[n]]
                    sent = np.zeros((len(at), len(known)), bool)
                    np.put_along_axis(sent, order, True, 1)
                    sent &= known
                i, cell = np.nonzero(sent)
                who, vectors = pdf["question_id"].to_numpy()[at], pdf["embedding"].to_numpy()[at]
                for k in range(0, len(i), PIECE):  # a question is as many rows as it is sent to cells
                    own = i[k : k + PIECE]
                    yield pd.DataFrame({"question_id": who[own], "length": n, "cell": cell[k : k + PIECE], "embedding": vectors[own]})

    return questions.select(F.col("question_id").cast("string").alias("question_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInPandas(send, "question_id string, length long, cell long, embedding array<double>")


def _met(index: Index, questions: DataFrame, least: float | None, k: int | None, probes: int | None, tile: int) -> DataFrame:
    asked = materialize(_asked(index, questions, least, probes), "vector-questions")
    rows = index.rows.join(asked.select("length", "cell").distinct(), ["length", "cell"], "left_semi")
    q, e, keys = tiled(asked, rows, ["length", "cell"], tile)
    q = q.select(*keys, F.col("question_id").alias("who"), F.lit(True).alias("asks"), "embedding")
    e = e.select(*keys, F.col("id").alias("who"), F.lit(False).alias("asks"), "embedding")

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        if not len(a) or not len(b):
            none = pdf["who"].iloc[:0]
            return pd.DataFrame({"question_id": none, "id": none, "cosine": np.zeros(0)})
        cosine = np.clip(_units(a["embedding"].tolist()) @ _units(b["embedding"].tolist()).T, 0.0, 1.0)
        if k is None:
            i, j = np.nonzero(cosine >= least)
        else:
            # those that tie with the k-th stay; the last ranking is by id
            at = max(0, cosine.shape[1] - k)
            i, j = np.nonzero(cosine >= np.partition(cosine, at, axis=1)[:, at : at + 1])
        return pd.DataFrame({"question_id": a["who"].iloc[i].reset_index(drop=True), "id": b["who"].iloc[j].reset_index(drop=True), "cosine": cosine[i, j]})

    met = q.unionByName(e).groupBy(*keys).applyInPandas(multiply, "question_id string, id string, cosine double")
    return met.select(F.col("question_id").cast(questions.schema["question_id"].dataType), F.col("id").cast(index.kind), "cosine")


def near(index: Index, questions: DataFrame, least: float, tile: int = TILE) -> DataFrame:
    """All pairs (question_id, id, cosine) with a cosine of at least ``least``, which is above 0. Exact."""
    if least <= 0:
        raise ValueError("everything is near at a threshold of 0")
    return _met(index, questions, least, None, None, tile)


def nearest(index: Index, questions: DataFrame, k: int = TOP, probes: int | None = None, tile: int = TILE) -> DataFrame:
    """The ``k`` largest cosines of each question among the cells it is sent to, ties by id: question_id, id, cosine, rank."""
    found = _met(index, questions, None, k, probes, tile)
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("cosine"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def recall(index: Index, questions: DataFrame, k: int = TOP, probes: int | None = None) -> DataFrame:
    """One row: questions, wanted (rows among the exact nearest ``k``), found (of these by ``nearest``). The exact ones come from all cells."""
    every = max((len(c) for c in index.centroids.values()), default=1)
    exact = nearest(index, questions, k, every).select("question_id", "id")
    found = nearest(index, questions, k, probes).select("question_id", "id", F.lit(1).alias("hit"))
    both = exact.join(found, ["question_id", "id"], "left")
    return both.agg(F.count_distinct("question_id").alias("questions"), F.count(F.lit(1)).alias("wanted"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found"))
