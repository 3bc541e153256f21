"""Best-fit packing of token sequences, in bulk-synchronous rounds.

Pieces longer than half a sequence open one each; as many more are opened as all
tokens together need. Then, round by round:

1. Pieces and gaps are range-sorted by size, the largest first, gaps before pieces
   of their size. Equal sizes are told apart by a hash, so one size may be dealt to
   several ranges. Where pieces have become small a gap is offered in slots, each as
   large as the largest piece left, so a round can fill it with more than one.
2. Each range is swept by its task: a piece takes the smallest unclaimed slot before
   it, which is its successor in size. Pieces that find none in their range and slots
   that nobody takes are ranked.
3. The ranges' numbers of both, two for each range, decide which ranks of pieces meet
   which ranks of slots of the ranges before; those are joined.
4. Gaps are made smaller by what they took, and the next round begins with the pieces
   left. If nothing was placed, the pieces left get as many new sequences as their
   tokens need.

Every table of a round is written to the shared folder; the driver sees sums and the
two numbers of each range. Offsets are sums of lengths inside a sequence.

Defined results: a null text is empty and is one piece, the end token alone;
repeated rows are packed one by one; pieces of one length are interchangeable, so
which of them goes where may differ from run to run; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, short_batches, shuffle_partitions

CAPACITY = 2048
END_ID = 0
#: Pieces and gaps that make a range worth its task, and that it has at most, about.
ROWS_A_RANGE, MOST_ROWS_A_RANGE = 5_000, 500_000
#: Runs of one kind of character beyond this go to the slower encoder, whose time grows only linearly with them.
LONG_RUN = re.compile(r"\S{1000}|\s{1000}")
#: Fixed value: the pattern by which this tokenizer splits text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The letters that a byte-level vocabulary writes its bytes with: printable Latin-1 as itself, others from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def _check(config: dict) -> None:
    """Raise if ids of this tokenizer aren't those of byte pairs merged in the order of their ids, text split by ``SPLIT``."""
    model, split = config["model"], config["pre_tokenizer"] or {}
    plain = config["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    plain = plain and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [model["vocab"].get("".join(m), -1) for m in merges]
    # Each merge makes a token of its own, and the tokens' ids rise with the merges' order, after the single bytes.
    if not plain or ids != sorted(set(ids)) or ids[:1] != [256] or sorted(model["vocab"].values()) != list(range(256 + len(ids))):
        raise ValueError("not a byte-level vocabulary whose ids follow its merges")


class TextEncoder:
    """Ids of whole texts, equal to those of the tokenizer, as bytes of little-endian unsigned 32-bit numbers.

    A byte-level vocabulary whose ids follow the order of its merges, which is
    checked on the whole vocabulary when an encoder is made, gives the same ids as
    ranks to a faster encoder. It knows no special tokens and slows down on very
    long runs; texts with one go to the tokenizer itself, with the same ids.
    """

    def __init__(self, tokenizer_path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        _check(json.loads(self.tokenizer.to_str()))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in t): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in self.special}
        self.core = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special) or LONG_RUN.search(text):
            return self.whole(text)
        return self.core.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


@functools.cache
def encoder(tokenizer_path: str) -> TextEncoder:
    """One for each worker process."""
    return TextEncoder(tokenizer_path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: all full but the first, which has the rest."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenize(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32."""
    kind = docs.schema["doc_id"].dataType
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for b in batches:
            from_row, rows = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                ids = encode(text or "") + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    from_row.append(i)
                    rows.append((k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(from_row, pa.int64())), pa.array(columns[0], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[1:]]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long")


def sweep(is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of slots and pieces in order: places of pieces and of the slots that they take, of pieces left, of slots left.

    As brackets match: a piece takes the last unclaimed slot before it.
    """
    depth = np.cumsum(np.where(is_gap, 1, -1))
    level = np.where(is_gap, depth, depth + 1)
    order = np.lexsort((np.arange(len(level)), level))
    # of one level slots and pieces take turns
    a, b = order[:-1], order[1:]
    pair = (level[a] == level[b]) & is_gap[a] & ~is_gap[b]
    slots, pieces = a[pair], b[pair]
    free = np.ones(len(is_gap), bool)
    free[slots] = free[pieces] = False
    return pieces, slots, np.flatnonzero(free & ~is_gap), np.flatnonzero(free & is_gap)


def across(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Of (range, pieces left, slots left): (range, first rank, pieces, range of the slots, rank of the last slot) of those that meet; a piece takes the last slot."""
    stack: list[list[int]] = []
    out = []
    for p, pieces, slots in sorted(left):
        done = 0
        while done < pieces and stack:
            q, many = stack[-1]
            k = min(many, pieces - done)
            out.append((p, done, k, q, many - 1))
            done += k
            stack[-1][1] -= k
            if not stack[-1][1]:
                stack.pop()
        if slots:
            stack.append([p, slots])
    return out


_SWEPT = "range int, gap boolean, place long, id long, other long, size int"


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's rows (range, gap, id, size), in order. Pieces placed have their sequence as ``other``; what is left over has its rank as ``place``."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    part = table.column("range")[0].as_py()
    is_gap, ids, size = (table.column(c).to_numpy() for c in ("gap", "id", "size"))
    pieces, slots, alone, free = sweep(is_gap)
    at = np.concatenate([pieces, alone, free])
    place = np.concatenate([np.full(len(pieces), -1), np.arange(len(alone)), np.arange(len(free))]).astype(np.int64)
    other = np.concatenate([ids[slots], np.zeros(len(alone) + len(free), np.int64)]).astype(np.int64)
    columns = [np.full(len(at), part, np.int32), is_gap[at], place, ids[at], other, size[at]]
    for a in range(0, len(at), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 100_000]) for c in columns], ["range", "gap", "place", "id", "other", "size"])


def _round(left: DataFrame, gaps: DataFrame, most: int, least: int, ranges: int) -> tuple[DataFrame, DataFrame]:
    """One round: what was placed (id, size, sequence), and the pieces that are left."""
    spark = left.sparkSession
    slots = F.greatest(F.lit(1), F.floor(F.col("gap") / most)).cast("int")
    offered = gaps.filter(F.col("gap") >= least).select("sequence", "gap", slots.alias("n"), F.explode(F.sequence(F.lit(1), slots)).alias("i"))
    offered = offered.select(F.lit(True).alias("gap"), F.col("sequence").alias("id"), F.when(F.col("i") < F.col("n"), F.lit(most)).otherwise(F.col("gap") - (F.col("n") - 1) * most).cast("int").alias("size"), F.xxhash64("sequence", "i").alias("tie"))
    items = left.select(F.lit(False).alias("gap"), "id", "size", F.xxhash64("id").alias("tie")).unionByName(offered)
    order = [F.desc("size"), F.desc("gap"), F.asc("tie")]
    ranged = items.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("range"), "gap", "id", "size")
    swept = materialize(ranged.mapInArrow(_sweep, _SWEPT), "pack-swept")
    matched = swept.filter("other <> 0").select("id", "size", F.col("other").alias("sequence"))
    over = swept.filter("other = 0")
    counts = over.groupBy("range").agg(F.count_if(~F.col("gap")).alias("pieces"), F.count_if("gap").alias("slots")).collect()  # one row a range
    alone, free = over.filter("not gap").drop("gap", "other"), over.filter("gap")
    spans = across([tuple(r) for r in counts])
    if not spans:
        return matched, alone.select("id", "size")
    plan = F.broadcast(spark.createDataFrame(spans, "of int, first long, many long, to int, last long"))  # at most two rows a range
    here = alone.join(plan, (F.col("range") == F.col("of")) & (F.col("place") >= F.col("first")) & (F.col("place") < F.col("first") + F.col("many")), "left")
    here = here.select("id", "size", "to", (F.col("last") - F.col("place") + F.col("first")).alias("at"))
    met = here.filter("to is not null").join(free.select(F.col("range").alias("to"), F.col("place").alias("at"), F.col("id").alias("sequence")), ["to", "at"]).select("id", "size", "sequence")
    return matched.unionByName(met), here.filter("to is null").select("id", "size")


def best_fit(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(id, size, sequence) of all pieces (id: unique and not 0, size: at most ``capacity``)."""
    spark = pieces.sparkSession
    sums = lambda d: d.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("tokens"), F.min("size").alias("least"), F.max("size").alias("most"))
    large = F.col("size") * 2 > capacity  # no two of these fit together
    total, big = sums(pieces).first(), pieces.filter(large).count()
    opened = 0

    def new(many: int) -> DataFrame:
        nonlocal opened
        opened += many
        return spark.range(-opened, many - opened).select(F.col("id").alias("sequence"), F.lit(capacity).alias("gap"))

    placed = [pieces.filter(large).select("id", "size", F.col("id").alias("sequence"))]
    gaps = pieces.filter(large & (F.col("size") < capacity)).select(F.col("id").alias("sequence"), (capacity - F.col("size")).alias("gap"))
    gaps = materialize(gaps.unionByName(new(max(0, -(-total.tokens // capacity) - big))), "pack-gaps")
    left = materialize(pieces.filter(~large).select("id", "size"), "pack-left")
    while (now := sums(left).first()).n:
        ranges = max(1, min(shuffle_partitions(spark), now.n // ROWS_A_RANGE), -(-now.n // MOST_ROWS_A_RANGE))
        matched, rest = _round(left, gaps, now.most, now.least, ranges)
        matched, rest = materialize(matched, "pack-placed"), materialize(rest, "pack-left")
        took = matched.groupBy("sequence").agg(F.sum("size").alias("took"))
        gaps = gaps.join(took, "sequence", "left").select("sequence", (F.col("gap") - F.coalesce("took", F.lit(0))).cast("int").alias("gap")).filter("gap > 0")
        if not matched.limit(1).count():
            gaps = gaps.unionByName(new(-(-now.tokens // capacity)))
        gaps = materialize(gaps, "pack-gaps")
        placed.append(matched)
        left = rest
    return functools.reduce(DataFrame.unionByName, placed)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialize(tokenize(docs, tokenizer_path, capacity).withColumn("id", F.monotonically_increasing_id() + 1), "pack-pieces")
    placed = best_fit(pieces.select("id", F.col("length").cast("int").alias("size")), capacity)
    whole = pieces.join(placed.select("id", F.col("sequence").alias("sequence_id")), "id")
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "id").rowsBetween(Window.unboundedPreceding, -1)
    return whole.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
