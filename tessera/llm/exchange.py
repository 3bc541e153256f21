"""Counting of many keys across parts of a corpus, with little to shuffle.

The corpus is dealt once to parts of a few megabytes. A part sends each of its
distinct keys (64-bit hashes of word windows) once, packed by ranges of the hash;
a range's task adds up what all parts sent and answers each part, only for keys
that other parts hold too. A key that a third of all rows hold is one entry from
each part, so no task gets more than its share. The parts' texts are shuffled
once: every later step reads the same exchange again.

How many parts and ranges there are follows from the bytes of text and the cores,
not from the session's shuffle partitions. A message holds at least one key, so
there are never more messages than a shuffle of single keys would have rows; as
both parts and ranges grow with the input, messages get smaller with it (about
8000 keys at 1 GB of text, 8 at 1 TB) until that is what they are.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, hash_words, release, short_batches

#: Bytes of text in one part, about, and keys in one range.
PART_BYTES = 8_000_000
RANGE_KEYS = 1_000_000

SENT = "range long, part long, keys binary, extra binary"
ANSWER = "part long, kind int, range long, keys binary, extra binary"
_SENT = pa.schema([("range", pa.int64()), ("part", pa.int64()), ("keys", pa.binary()), ("extra", pa.binary())])
_ANSWER = pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("range", pa.int64()), ("keys", pa.binary()), ("extra", pa.binary())])


def sized(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """The bytes of all texts, and the number of bits that ranges of hashes have."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    # About one key in twelve bytes of text.
    return total, max(3, math.ceil(math.log2(max(1, total / 12 / RANGE_KEYS, 2 * docs.sparkSession.sparkContext.defaultParallelism))))


def dealt(docs: DataFrame, part: str, text: str = "text") -> tuple[DataFrame, int]:
    """``docs`` with ``part``, and the number of bits that ranges of hashes have."""
    short_batches(docs.sparkSession)
    total, bits = sized(docs, text)
    parts = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-total // PART_BYTES))
    # repeated rows are told apart by the input partition they come from, which is bounded
    own = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in ("doc_id", text)], F.spark_partition_id()), F.lit(parts)).cast("long")
    return docs.withColumn(part, own), bits


class PartWords:
    """The word hashes of a part's texts one after the other; of each word its place, its text's first word and end."""

    def __init__(self, texts: list[bytes | None]):
        cache = WordHashes()
        own = [hash_words((t or b"").split(), cache) for t in texts]
        self.lengths = np.array([len(x) for x in own], dtype=np.int64)
        self.hashes = np.concatenate(own) if own else np.empty(0, np.uint64)
        self.ends = np.cumsum(self.lengths)
        self.begins = self.ends - self.lengths
        self.end = np.repeat(self.ends, self.lengths)
        self.begin = np.repeat(self.begins, self.lengths)
        self.at = np.arange(len(self.hashes)) - self.begin

    def fits(self, width: int) -> np.ndarray:
        """Whether a window of ``width`` words begins at each of the first len - width + 1 places."""
        n = max(0, len(self.hashes) - width + 1)
        return np.arange(n) + width <= self.end[:n]


def texts_of(table: pa.Table, text: str = "text") -> list[bytes | None]:
    return table.column(text).combine_chunks().cast(pa.large_binary()).to_pylist()


def part_of(key: tuple) -> int:
    release()
    return key[0].as_py()


def squeeze(values: np.ndarray) -> bytes:
    """Numbers as planes of their bytes, as many as the largest needs; a shuffle's compression folds the planes of zeros."""
    raw = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + np.ascontiguousarray(raw[:, :width].T).tobytes()


def stretch(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _steps(keys: np.ndarray, base: int) -> bytes:
    """Sorted keys as their differences, in Rice code: low bits as they are (whole bytes, then the rest), the number above them in unary."""
    steps = np.diff(keys, prepend=np.uint64(base))
    mean = int(keys[-1] - np.uint64(base)) // len(keys)
    low = max(0, (mean * 7 // 10).bit_length() - 1)
    whole, rest = divmod(low, 8)
    raw = np.ascontiguousarray(steps.astype("<u8")).view(np.uint8).reshape(-1, 8)
    planes = np.ascontiguousarray(raw[:, :whole].T).tobytes()
    bits = np.packbits(np.unpackbits(raw[:, whole : whole + 1], axis=1)[:, 8 - rest :]).tobytes() if rest else b""
    ends = np.cumsum((steps >> np.uint64(low)).astype(np.int64) + 1)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    return bytes([low]) + len(keys).to_bytes(4, "little") + planes + bits + np.packbits(unary).tobytes()


def _unsteps(raw: bytes, base: int) -> np.ndarray:
    """The keys that ``_steps`` has written."""
    low, n = raw[0], int.from_bytes(raw[1:5], "little")
    whole, rest = divmod(low, 8)
    at = 5 + n * whole
    out = np.zeros((n, 8), np.uint8)
    out[:, :whole] = np.frombuffer(raw, np.uint8, n * whole, 5).reshape(whole, n).T
    if rest:
        many = -(-n * rest // 8)
        bits = np.zeros((n, 8), np.uint8)
        bits[:, 8 - rest :] = np.unpackbits(np.frombuffer(raw, np.uint8, many, at), count=n * rest).reshape(n, rest)
        out[:, whole] = np.packbits(bits, axis=1)[:, 0]
        at += many
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, offset=at)))
    above = np.diff(ends, prepend=-1) - 1
    return np.cumsum(out.view("<u8").ravel() + (above.astype(np.uint64) << np.uint64(low)), dtype=np.uint64) + np.uint64(base)


def ranges_of(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(range, first, last) of sorted keys."""
    if not len(keys):
        return []
    ranges = (keys >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(ranges)) + 1
    first = np.concatenate([[0], cuts])
    return list(zip(ranges[first].tolist(), first.tolist(), np.append(cuts, len(keys)).tolist(), strict=True))


def send(part: int, keys: np.ndarray, extra: np.ndarray, bits: int, pack: Callable[[np.ndarray], bytes] = np.ndarray.tobytes) -> pa.Table:
    """Rows for the ranges. ``keys`` is sorted; ``extra`` goes along, written by ``pack``."""
    spans = ranges_of(keys, bits)
    packed = [_steps(keys[a:b], r << (64 - bits)) for r, a, b in spans]
    return pa.Table.from_arrays([pa.array([r for r, _, _ in spans], pa.int64()), pa.array([part] * len(spans), pa.int64()), pa.array(packed, pa.binary()), pa.array([pack(extra[a:b]) for _, a, b in spans], pa.binary())], schema=_SENT)


def _received(table: pa.Table, bits: int, unpack: Callable[[bytes], np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    keys = [_unsteps(x, r << (64 - bits)) for x, r in zip(table.column("keys").to_pylist(), table.column("range").to_pylist(), strict=True)]
    return keys, [unpack(x) for x in table.column("extra").to_pylist()]


def answered(sent: DataFrame, bits: int, answer: Callable[[np.ndarray, np.ndarray, np.ndarray], list[tuple[int, np.ndarray, np.ndarray]]], extra: str, kind: int = 0) -> DataFrame:
    """Answers for the parts. ``answer`` gets the keys of a range, their extras (of dtype ``extra``) and the parts they are from; it gives (part, keys, extras)."""

    def run(table: pa.Table) -> pa.Table:
        keys, extras = _received(table, bits, lambda x: np.frombuffer(x, extra))
        parts = np.repeat(np.array(table.column("part").to_pylist(), np.int64), [len(k) for k in keys])
        rows = answer(np.concatenate(keys), np.concatenate(extras), parts)
        return pa.Table.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([kind] * len(rows), pa.int32()), pa.array([0] * len(rows), pa.int64()), pa.array([r[1].tobytes() for r in rows], pa.binary()), pa.array([r[2].tobytes() for r in rows], pa.binary())], schema=_ANSWER)

    return sent.groupBy("range").applyInArrow(run, ANSWER)


def totalled(sent: DataFrame, bits: int, kind: int) -> DataFrame:
    """To each part, for each range: one bit for each key it sent, whether another part has sent it too, and the totals of those."""

    def run(table: pa.Table) -> pa.Table:
        keys, counts = _received(table, bits, stretch)
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        k = every[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        many = np.diff(np.append(first, len(k)))
        sums = np.add.reduceat(np.concatenate(counts)[order], first)
        shared, total = np.empty(len(k), bool), np.empty(len(k), np.uint64)
        shared[order], total[order] = np.repeat(many > 1, many), np.repeat(sums, many)
        ends = np.cumsum([len(x) for x in keys])[:-1]
        flags, totals = np.split(shared, ends), np.split(total, ends)
        return pa.Table.from_arrays([table.column("part").combine_chunks(), pa.array([kind] * len(keys), pa.int32()), table.column("range").combine_chunks(), pa.array([np.packbits(f).tobytes() for f in flags], pa.binary()), pa.array([squeeze(t[f]) for t, f in zip(totals, flags, strict=True)], pa.binary())], schema=_ANSWER)

    return sent.groupBy("range").applyInArrow(run, ANSWER)


def totals_heard(answers: pa.Table, kind: int, keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For the sorted keys that the part had sent: whether others have them, and the totals (0 where not)."""
    mine = answers.filter(pa.compute.equal(answers.column("kind"), kind))
    rows = {r: (f, t) for r, f, t in zip(mine.column("range").to_pylist(), mine.column("keys").to_pylist(), mine.column("extra").to_pylist(), strict=True)}
    shared, totals = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    for r, a, b in ranges_of(keys, bits):
        flags, sums = rows[r]
        shared[a:b] = np.unpackbits(np.frombuffer(flags, np.uint8), count=b - a).astype(bool)
        totals[a:b][shared[a:b]] = stretch(sums).astype(np.int64)
    return shared, totals


def by_part(parts: np.ndarray, keys: np.ndarray, extras: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The rows of each part apart."""
    order = np.argsort(parts, kind="stable")
    parts, keys, extras = parts[order], keys[order], extras[order]
    cuts = np.flatnonzero(np.diff(parts)) + 1
    return [(int(p[0]), k, e) for p, k, e in zip(np.split(parts, cuts), np.split(keys, cuts), np.split(extras, cuts), strict=True) if len(p)]


def heard(answers: pa.Table, kind: int, extra: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and extras that a part was answered."""
    mine = answers.filter(pa.compute.equal(answers.column("kind"), kind))
    keys = [np.frombuffer(x, np.uint64) for x in mine.column("keys").to_pylist()]
    extras = [np.frombuffer(x, extra) for x in mine.column("extra").to_pylist()]
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, extra)
    k, e = np.concatenate(keys), np.concatenate(extras)
    order = np.argsort(k, kind="stable")
    return k[order], e[order]


def among(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each of ``x`` is one of the sorted ``keys``."""
    if not len(keys):
        return np.zeros(len(x), dtype=bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return keys[at] == x
