"""What the operators of this subpackage share: materialising, word hashes, ranks."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.storage import materialize

__all__ = ["WordHashes", "by_rank", "fresh", "hash_words", "materialize", "mix", "powers", "ranked", "release", "short_batches", "shuffle_partitions", "spread", "window_hashes", "with_fields", "written"]

#: Words known to a Python worker at one time; beyond that its cache starts afresh.
WORD_CACHE = 100_000
#: Rows of one key that are ranked or joined together, about.
RUN = 50_000
#: Rows in one batch for a Python worker.
BATCH_ROWS = 2000
_U64 = np.uint64


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Give memory that a Python worker no longer uses back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def short_batches(spark: SparkSession) -> None:
    """Let texts go to the Python workers in batches of at most ``BATCH_ROWS`` rows, as they can be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


class WordHashes(dict):
    """A word's 64-bit hash, remembered; at most ``WORD_CACHE`` words at a time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def hash_words(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), dtype=_U64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """An invertible scrambling of 64-bit numbers (the murmur3 finaliser)."""
    x = x ^ (x >> _U64(33))
    x = x * _U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U64(33))
    x = x * _U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U64(33))


def window_hashes(h: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of every run of ``width`` numbers of ``h``.

    Built by doubling, so a window costs O(log width) operations.
    """
    if len(h) < width:
        return np.empty(0, dtype=_U64)
    out, have, power, piece, size, left = None, 0, base, h, 1, width
    n = len(h) - width + 1
    while left:
        if left & 1:
            part = piece[have : have + n]
            if out is None:
                out = part.copy()
            else:
                out = out * _U64(pow(base, size, 1 << 64)) + part
            have += size
        left >>= 1
        if left:
            piece = piece[:-size] * _U64(power) + piece[size:]
            power = power * power % (1 << 64)
            size *= 2
    return mix(out)


@functools.cache
def powers(bits: int, base: int = 0x9E3779B97F4A7C15) -> tuple[np.ndarray, np.ndarray]:
    """The first 2**bits powers of an odd base and of its inverse modulo 2**64."""
    return tuple(np.cumprod(np.concatenate([np.ones(1, _U64), np.full((1 << bits) - 1, b, _U64)]), dtype=_U64) for b in (base, pow(base, -1, 1 << 64)))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or that with as many underscores more as it takes to clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread(df: DataFrame, columns: list[str], parts: int) -> Column:
    """A number from 0 to ``parts`` - 1 that the columns' values decide."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in columns]), F.lit(parts)).cast("int")


def ranked(df: DataFrame, key: list[str], order: list[str], out: str, rows: int | None = None) -> DataFrame:
    """Add ``out``: a gapless rank from 0 of each row among those with equal ``key``.

    A key may hold any share of the rows: each is split by a hash of ``order`` and
    of the input partition, so that many equal rows are split as well, into as many
    groups as ``RUN`` goes into all ``rows`` (counted if not given), which are ranked
    apart and then shifted by the sizes of the groups before them. ``order`` must
    tell unequal rows apart.
    """
    rows = df.count() if rows is None else rows
    sub, n, before = (fresh(df, c) for c in ("__sub", "__n", "__before"))
    many = F.lit(max(1, -(-rows // RUN)))
    # written, so that each row's group is the same wherever it is read
    salted = materialize(df.withColumn(sub, F.pmod(F.xxhash64(*[F.col(c) for c in order], F.spark_partition_id()), many).cast("int")), "ranked")
    counts = salted.groupBy(*key, sub).agg(F.count(F.lit(1)).alias(n))
    w = Window.partitionBy(*key).orderBy(sub).rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn(before, F.coalesce(F.sum(n).over(w), F.lit(0))).drop(n)
    keys = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*key, sub]]
    w = Window.partitionBy(*key, sub).orderBy(*order)
    inner = salted.withColumn(out, F.row_number().over(w) - 1)
    joined = inner.alias("a").join(shifts.alias("b"), keys)
    kept = [F.col(f"a.{c}") for c in df.columns]
    return joined.select(*kept, (F.col(f"a.{out}") + F.col(f"b.{before}")).cast("long").alias(out))


def by_rank(df: DataFrame, plan: DataFrame, key: list[str], rank: str, first: str, end: str) -> DataFrame:
    """``df`` joined to the row of ``plan`` with an equal key whose ranks from ``first`` to before ``end`` hold its own.

    Ranks are dealt in blocks of ``RUN``, so a key with many rows isn't one task.
    """
    block = fresh(df, "__block")
    spans = plan.withColumn(block, F.explode(F.sequence(F.floor(F.col(first) / RUN), F.floor((F.col(end) - 1) / RUN))))
    rows = df.withColumn(block, F.floor(F.col(rank) / RUN))
    inside = (F.col(f"a.{rank}") >= F.col(f"b.{first}")) & (F.col(f"a.{rank}") < F.col(f"b.{end}"))
    joined = rows.alias("a").join(spans.alias("b"), [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*key, block]] + [inside])
    return joined.select(*[F.col(f"a.{c}") for c in df.columns], *[F.col(f"b.{c}") for c in plan.columns if c not in key])


def written(spark: SparkSession, rows: Iterator[tuple], schema: str, name: str, many: int = 100_000) -> DataFrame:
    """A table of rows made on the driver, of which it holds ``many`` at a time."""
    tables = [materialize(spark.createDataFrame(some, schema), name) for some in iter(lambda: list(itertools.islice(rows, many)), [])]
    return functools.reduce(DataFrame.unionByName, tables) if tables else spark.createDataFrame([], schema)


def with_fields(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(n, t) for n, t in fields]])
