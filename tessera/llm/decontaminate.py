"""Benchmark decontamination with suffix arrays over the training texts.

Texts are cut into shards of a few megabytes. A shard's words become numbers, in
the order of their bytes, and all its suffixes are sorted into a suffix array, as
far down as the longest benchmark item reaches. Every benchmark suffix that holds
a window is then looked up by binary search: the suffixes that begin with its
window are one interval of the array. Intervals of different windows don't
overlap, so nothing is ever written out for each pair of places.

Longest verbatim matches come from the array as well: of all benchmark suffixes
those next to a training suffix in the sorted order share the longest beginning
with it.

The benchmark is read in blocks of bounded size; ``BLOCKS_A_PASS`` of them are broadcast
for one pass over the texts, so a shard's array is built once and all these blocks are
looked up in it while it is held. Hits of the first pass are a column; those of any
further passes are written to the shared folder, only for the documents that have some,
and joined to it at the end.

Defined results: null and empty texts have no words and hit nothing; items
without words have no window; repeated items count once by their id, a null id
is the empty string; repeated documents are judged one by one; an empty benchmark
leaves every document clean; other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, powers, release, short_batches

WINDOW = 10
#: Bytes of benchmark text in one block.
BLOCK_BYTES = 4_000_000
#: Blocks looked up in one pass; a worker holds about 30 MB for each.
BLOCKS_A_PASS = 8
#: Bytes of training text in one shard, about.
SHARD_BYTES = 8_000_000

#: ASCII letters are lowered, digits kept, other ASCII separates words; bytes from 0x80 on belong to words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
KIND = "struct<n_words: bigint, n_hit: bigint, items: array<string>, longest: bigint, longest_at: bigint, bits: binary>"
NAMES = ["n_words", "n_hit", "items", "longest", "longest_at", "bits"]
TYPES = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.binary()]


def fold_words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Numbers(dict):
    """Numbers of words from 1 on, as they are met."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self) + 1
        return value


class Words:
    """Texts one after the other, with 0 after each: ``ids`` in the order of the words' bytes, and sums by which runs of words are compared."""

    def __init__(self, texts: list[list[bytes]]):
        numbers = Numbers()
        each = [np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)) for words in texts]
        self.lengths = np.array([len(x) for x in each], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + 1)[:-1]]) if each else np.empty(0, np.int64)
        ids = np.zeros(int((self.lengths + 1).sum()), np.int32)
        for at, x in zip(self.starts.tolist(), each, strict=True):
            ids[at : at + len(x)] = x
        self.vocabulary = sorted(numbers)
        place = np.zeros(len(numbers) + 1, np.int32)
        place[[numbers[w] for w in self.vocabulary]] = np.arange(1, len(numbers) + 1)
        self.ids = place[ids]
        values = np.zeros(len(numbers) + 1, np.uint64)
        values[1:] = np.fromiter(map(xxhash.xxh3_64_intdigest, self.vocabulary), np.uint64, len(numbers))
        self.values = values
        self.text = np.repeat(np.arange(len(texts)), self.lengths + 1)
        self.left = np.repeat(self.starts + self.lengths, self.lengths + 1) - np.arange(len(self.ids))  # words up to the text's end

    def sums(self) -> np.ndarray:
        up, _ = powers(len(self.ids).bit_length())
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.values[self.ids] * up[: len(self.ids)], dtype=np.uint64)])


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """The places of all suffixes, sorted by their first ``depth`` numbers at least; prefix doubling, in which only what is still equal is sorted again."""
    n = len(ids)
    bits = max(1, n).bit_length()

    def sort(group: np.ndarray, then: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if 3 * bits <= 64:
            x = np.sort((group.astype(np.uint64) << np.uint64(2 * bits)) | (then.astype(np.uint64) << np.uint64(bits)) | place.astype(np.uint64))
            low = np.uint64((1 << bits) - 1)
            return (x >> np.uint64(2 * bits)).astype(np.int64), (x >> np.uint64(bits) & low).astype(np.int64), (x & low).astype(np.int64)
        order = np.lexsort((then, group))
        return group[order], then[order], place[order]

    order = np.arange(n)
    group, then, array = sort(np.zeros(n, np.int64), ids.astype(np.int64), order)
    rank = np.zeros(n + 1, np.int64)  # of a suffix: where its equals begin in the array, from 1; past the end 0
    open_, step = order, 1
    while True:
        new = np.ones(len(open_), bool)
        new[1:] = (group[1:] != group[:-1]) | (then[1:] != then[:-1])
        first = open_[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        rank[array[open_]] = first + 1
        alone = new & np.append(new[1:], True)
        open_ = open_[~alone]
        if step >= depth or not len(open_):
            return array
        place = array[open_]
        group, then, array[open_] = sort(rank[place], rank[np.minimum(place + step, n)], place)
        step *= 2


class Block:
    """The windows of some benchmark items, ready to be looked up."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.items = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.items)}
        self.words = Words([fold_words(t) for _, t in items])
        self.sums = self.words.sums()
        self.item = np.array([number[i] for i, _ in items], np.int64)
        self.depth = int(self.words.lengths.max(initial=0)) + 1
        array = suffix_array(self.words.ids, self.depth)
        width = np.minimum(self.words.lengths, window)[self.words.text] if len(array) else array
        #: width of a window -> the places of suffixes that hold one, sorted
        self.queries = {int(w): found for w in np.unique(width[width > 0]) if len(found := array[(width[array] == w) & (self.words.left[array] >= w)])}


def _pairs(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, sorted; ``b`` is below ``n``."""
    return np.divmod(np.unique(a * n + b), n)


class Search:
    """Looks a block's suffixes up in one shard."""

    def __init__(self, shard: Words, block: Block, array: np.ndarray, sums: np.ndarray):
        self.shard, self.block, self.array, self.sums = shard, block, array, sums
        own = shard.vocabulary
        place = np.array([bisect_left(own, w) for w in block.words.vocabulary], np.int64)
        known = np.array([p < len(own) and own[p] == w for p, w in zip(place.tolist(), block.words.vocabulary, strict=True)], bool)
        #: the shard's numbers of the block's words, -1 where it has none
        self.number = np.concatenate([[-1], np.where(known, place + 1, -1)])
        #: twice that, and odd numbers between for words that the shard doesn't have; an item's end is smallest
        self.place = np.concatenate([[-1], np.where(known, 2 * place + 2, 2 * place + 1)])

    def bound(self, places: np.ndarray, width: int, after: bool) -> np.ndarray:
        """For each of the block's places how many of the shard's suffixes are smaller in the first ``width`` words (``after``: or equal)."""
        low, high = np.zeros(len(places), np.int64), np.full(len(places), len(self.array), np.int64)
        while len(active := np.flatnonzero(low < high)):
            middle = (low[active] + high[active]) >> 1
            here, there = self.array[middle], places[active]
            sign, still = np.zeros(len(active), np.int64), np.arange(len(active))
            for j in range(width):  # a shard's text ends with a number that no window has
                difference = self.shard.ids[here[still] + j] - self.number[self.block.words.ids[there[still] + j]]
                sign[still] = difference
                still = still[difference == 0]
            up = sign <= 0 if after else sign < 0
            low[active[up]] = middle[up] + 1
            high[active[~up]] = middle[~up]
        return low

    def common(self, here: np.ndarray, there: np.ndarray) -> np.ndarray:
        """How many words are the same from a place of the shard and one of the block on; told by sums of hashes."""
        _, down = powers(max(len(self.shard.ids), len(self.block.words.ids)).bit_length())
        ours, theirs = self.sums, self.block.sums
        low, high = np.zeros(len(here), np.int64), np.minimum(self.shard.left[here], self.block.words.left[there])
        while len(active := np.flatnonzero(low < high)):
            a, b, middle = here[active], there[active], (low[active] + high[active] + 1) >> 1
            same = (ours[a + middle] - ours[a]) * down[a] == (theirs[b + middle] - theirs[b]) * down[b]
            low[active[same]] = middle[same]
            high[active[~same]] = middle[~same] - 1
        return low

    def standing(self, places: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each of the block's places, inside its window's interval: how many of the shard's suffixes are smaller than all of its suffix."""
        low, high = low.copy(), high.copy()
        while len(active := np.flatnonzero(low < high)):
            middle = (low[active] + high[active]) >> 1
            here, there = self.array[middle], places[active]
            k = self.common(here, there)
            smaller = 2 * self.shard.ids[here + k].astype(np.int64) < self.place[self.block.words.ids[there + k]]
            low[active[smaller]] = middle[smaller] + 1
            high[active[~smaller]] = middle[~smaller]
        return low

    def _confirmed(self, here: int, there: int, length: int) -> int:
        """``length``, or how far the words themselves are the same."""
        same = self.shard.ids[here : here + length] == self.number[self.block.words.ids[there : there + length]]
        return length if same.all() else int(np.argmin(same))

    def hits(self) -> tuple[np.ndarray, list[set[int]], list[tuple[int, int]]]:
        """Which places are hit; for each text the numbers of its items, and its longest match and where that begins (0, 0 if there is none)."""
        shard, block = self.shard, self.block
        texts = len(shard.lengths)
        edges = np.zeros(len(shard.ids) + 1, np.int64)
        items: list[set[int]] = [set() for _ in range(texts)]
        longest = [(0, 0)] * texts
        for width, places in block.queries.items():
            may = np.ones(len(places), bool)
            for j in range(width):
                may &= self.number[block.words.ids[places + j]] > 0
            places = places[may]
            low, high = self.bound(places, width, False), self.bound(places, width, True)
            found = high > low
            if not found.any():
                continue
            places, low, high = places[found], low[found], high[found]
            starts, window = np.unique(low, return_inverse=True)
            ends = np.empty(len(starts), np.int64)
            ends[window] = high
            many = ends - starts
            # Intervals don't overlap, so there are at most as many of these as suffixes.
            index = np.repeat(starts - (np.cumsum(many) - many), many) + np.arange(many.sum())
            here = self.array[index]
            edges[here] += 1
            edges[here + width] -= 1
            self._add_items(items, _pairs(np.repeat(np.arange(len(starts)), many), shard.text[here], texts), _pairs(window, block.item[block.words.text[places]], len(block.items)))

            # Of the block's suffixes, sorted as the array is, the one before a suffix or the one after it shares most with it.
            after = np.searchsorted(self.standing(places, low, high), index, "right")
            best, there = np.zeros(len(here), np.int64), np.zeros(len(here), np.int64)
            for near in (np.maximum(after - 1, 0), np.minimum(after, len(places) - 1)):
                k = self.common(here, places[near])
                there = np.where(k > best, places[near], there)
                best = np.maximum(best, k)
            text = shard.text[here]
            order = np.lexsort((here, -best, text))
            for i in order[np.concatenate([[True], text[order][1:] != text[order][:-1]])].tolist():
                t = int(text[i])
                longest[t] = max(longest[t], (self._confirmed(here[i], there[i], int(best[i])), int(shard.starts[t] - here[i])))
        return np.cumsum(edges[:-1]) > 0, items, [(k, -at) for k, at in longest]

    @staticmethod
    def _add_items(out: list[set[int]], texts: tuple[np.ndarray, np.ndarray], items: tuple[np.ndarray, np.ndarray]) -> None:
        """Add the items of each window to the texts that hold it; both as sorted pairs with the window. Windows of the same items are taken together."""
        numbers: dict[bytes, int] = {}
        sets: list[list[int]] = []
        cuts = np.flatnonzero(np.diff(items[0])) + 1
        which = np.empty(int(items[0][-1]) + 1, np.int64)
        for w, own in zip(items[0][np.concatenate([[0], cuts])].tolist(), np.split(items[1], cuts), strict=True):
            key = own.tobytes()
            if key not in numbers:
                numbers[key] = len(sets)
                sets.append(own.tolist())
            which[w] = numbers[key]
        for text, k in zip(*(x.tolist() for x in _pairs(texts[1], which[texts[0]], len(sets))), strict=True):
            out[text].update(sets[k])


def judged(texts: list[bytes | None], blocks: list[Block]) -> list[tuple]:
    """For each text the values of ``NAMES``; texts are taken shard by shard, and all blocks are looked up in a shard's one array."""
    out, held, size = [], [], 0
    asked = [b for b in blocks if b.queries]
    for i, text in enumerate(texts):
        held.append(fold_words(text))
        size += len(text or b"")
        if size < SHARD_BYTES and i + 1 < len(texts):
            continue
        shard = Words(held)
        hit, items, longest = np.zeros(len(shard.ids), bool), [set() for _ in held], [(0, 0)] * len(held)
        if asked:
            array, sums = suffix_array(shard.ids, max(b.depth for b in asked)), shard.sums()
        for b in asked:
            own_hit, own_items, own_longest = Search(shard, b, array, sums).hits()
            hit |= own_hit
            for k, numbers in enumerate(own_items):
                if numbers:
                    items[k].update(b.items[x] for x in numbers)
                    longest[k] = max(longest[k], own_longest[k], key=lambda x: (x[0], -x[1]))
        for k, (start, n) in enumerate(zip(shard.starts.tolist(), shard.lengths.tolist(), strict=True)):
            own = hit[start : start + n]
            out.append((n, int(own.sum()), sorted(items[k]), *longest[k], np.packbits(own).tobytes() if items[k] else b""))
        held, size = [], 0
    return out


def joined(one: dict, others: list[dict]) -> tuple:
    """One text's values of several passes put together."""
    rows = [x for x in (one, *others) if x["n_hit"]]
    if not rows:
        return (one["n_words"], 0, [], 0, 0, b"")
    bits = np.bitwise_or.reduce([np.frombuffer(x["bits"], np.uint8) for x in rows])
    length, at = max((x["longest"], -x["longest_at"]) for x in rows)
    return (one["n_words"], int(np.bitwise_count(bits).sum()), sorted({i for x in rows for i in x["items"]}), length, -at, bits.tobytes())


def _struct(rows: list[tuple]) -> pa.StructArray:
    columns = list(zip(*rows, strict=True)) or [[]] * len(NAMES)
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], NAMES)


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark's items in blocks of bounded size; an item larger than a block is one of its own."""
    held, size = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit("")))
    for item, text in rows.toLocalIterator():
        raw = text.encode()
        if held and size + len(raw) > limit:
            yield held
            held, size = [], 0
        held.append((item, raw))
        size += len(raw)
    if held:
        yield held


def with_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = BLOCK_BYTES, out: str = "__c") -> DataFrame:
    """Add ``out`` (in place of a column of that name): n_words, n_hit, items (sorted ids), longest (words of the longest verbatim match), longest_at (its first word), bits (of the words hit)."""
    docs = docs.drop(out)
    spark = docs.sparkSession
    short_batches(spark)

    def hits(shared):
        @F.arrow_udf(KIND)
        def udf(texts: pa.Array) -> pa.Array:
            found = _struct(judged(texts.cast(pa.large_binary()).to_pylist(), [b.value for b in shared]))
            release()
            return found

        return udf.asNondeterministic()(F.col("text"))

    waiting = blocks(benchmark, limit)

    def broadcast() -> list:
        return [spark.sparkContext.broadcast(Block(items, window)) for items in itertools.islice(waiting, BLOCKS_A_PASS)]

    # An empty benchmark still has the words counted.
    result = docs.withColumn(out, hits(broadcast()))
    key, more = ["doc_id", F.xxhash64("text").alias("hash")], None
    while shared := broadcast():
        own = docs.select("doc_id", "text").withColumn("c", hits(shared)).filter("c.n_hit > 0").select(*key, "c").dropDuplicates(["doc_id", "hash"])
        own = materialize(own, "hits")
        more = own if more is None else more.unionByName(own)
        for b in shared:
            b.destroy()
    if more is None:
        return result

    @F.arrow_udf(KIND)
    def together(one: pa.Array, others: pa.Array) -> pa.Array:
        return _struct([joined(a, b or []) for a, b in zip(one.to_pylist(), others.to_pylist(), strict=True)])

    names = {c: fresh(result, c) for c in ("__id", "__hash", "__more")}
    more = more.groupBy("doc_id", "hash").agg(F.collect_list("c").alias(names["__more"]))  # at most one for each pass
    more = more.withColumnsRenamed({"doc_id": names["__id"], "hash": names["__hash"]})
    result = result.join(more, result["doc_id"].eqNullSafe(more[names["__id"]]) & (F.xxhash64(result["text"]) == more[names["__hash"]]), "left")
    return result.withColumn(out, together(F.col(out), F.col(names["__more"]))).drop(*names.values())


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window."""
    c = fresh(docs, "__c")
    return with_hits(docs, benchmark, out=c).filter(F.col(f"{c}.n_hit") == 0).drop(c)


def brute_force(docs: list[tuple[object, str | None]], items: list[tuple[object, str | None]], window: int = WINDOW) -> dict:
    """doc -> (n_words, n_hit, sorted item ids, longest match, its first word), word by word; for tests."""
    out = {}
    own = [(str(i) if i is not None else "", fold_words((t or "").encode())) for i, t in items]
    for doc, text in docs:
        words, hit, found, longest = fold_words((text or "").encode()), set(), set(), (0, 0)
        for item, there in own:
            width = min(window, len(there))
            for p in range(len(words)) if width else ():
                for q in range(len(there) - width + 1):
                    if words[p : p + width] == there[q : q + width]:
                        hit |= set(range(p, p + width))
                        found.add(item)
                        k = width
                        while p + k < len(words) and q + k < len(there) and words[p + k] == there[q + k]:
                            k += 1
                        longest = max(longest, (k, -p))
        out[doc] = (len(words), len(hit), sorted(found), longest[0], -longest[1])
    return out


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
