"""MinHash near-duplicates: banding, verification on full sets, star components.

A document's set is its distinct word shingles. Documents with equal sets are one
class and are never compared. ``MINIMA`` universal hash minima are cut into
bands; classes that agree in a band are candidates. Bands and their rows follow
from the threshold (85 percent if none is given): two sets at it miss each other
in all bands with a chance of 3 in a million, more similar ones with much less.

Buckets are never turned into all pairs. First each class is paired with one leader
of its buckets (the class there that meets most others), and the links confirmed on
full sets are joined into components; then with its other buckets' leaders, where
those are of another component. Only where a bucket still holds more than one
component are the pairs across its components taken up, if their sizes, the parities of their
sets (an odd sketch) and four-bit signatures allow the threshold. So no link between different sets is lost that a
band shows, while a bucket of many near copies costs about one pair a member.

Defined results: null and empty texts have an empty set and are linked with
nothing; fewer words than a shingle has are one shingle; repeated rows are in
one class; rows with one doc_id are judged by their own texts; an empty table
gives no rows; ``deduplicate`` passes other columns through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import connected_components

from .common import WordHashes, fresh, hash_words, materialize, mix, release, short_batches, window_hashes

SHINGLE = 5
PERCENT = 85
MINIMA = 320
#: Bits of a set's parities.
ODD_BITS = 1024
#: The chance that two sets at the threshold itself meet in no band, at most.
MISSED = 3e-6
#: Members that one task compares with a leader, about.
SALT = 1000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RANDOM = np.random.default_rng(20240229)
_A = (_RANDOM.integers(0, 1 << 31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _RANDOM.integers(0, 1 << 32, MINIMA, dtype=np.uint32)[:, None]


class Limits(NamedTuple):
    """A threshold in percent, and the bands, their rows and the least number of agreeing minima that go with it."""

    percent: int
    bands: int
    rows: int
    least_agreeing: int


def limits(percent: int = PERCENT) -> Limits:
    """Of the bands that miss few enough at the threshold those with most rows, and no more of them than needed.

    Signatures keep four bits of each minimum. Of these so many agree at least: 4.75 standard deviations below what the
    threshold gives, which one pair in a million at the threshold itself falls under.
    """
    if not 0 < percent <= 100:
        raise ValueError(f"percent is {percent}")
    t = percent / 100
    agreeing = t + (1 - t) / 16
    least = int(MINIMA * agreeing - 4.75 * (MINIMA * agreeing * (1 - agreeing)) ** 0.5)
    for rows in range(MINIMA, 0, -1):
        bands = math.ceil(math.log(MISSED) / math.log1p(-(t**rows))) if t < 1 else 1
        if bands * rows <= MINIMA:
            return Limits(percent, bands, rows, least)
    raise ValueError(f"{MINIMA} minima are too few for {percent} percent")


def shingle_set(text: bytes | None, cache: WordHashes, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = hash_words(words, cache)
    if len(words) < width:
        return mix(window_hashes(h, len(words)) + np.uint64(len(words)))
    return np.unique(window_hashes(h, width))


def minima(shingles: np.ndarray) -> np.ndarray:
    x = ((shingles >> np.uint64(32)) ^ shingles).astype(np.uint32)
    out = np.full(MINIMA, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(out, (_A * x[None, i : i + 2048] + _B).min(axis=1), out=out)
    return out


def bands_and_bits(m: np.ndarray, at: Limits = limits()) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key for each band, and four bits of each minimum, as 64-bit numbers."""
    h = np.zeros(at.bands, dtype=np.uint64)
    for column in m[: at.bands * at.rows].reshape(at.bands, at.rows).T:
        h = h * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64) + np.uint64(1)
    keys = mix(mix(h) + np.arange(at.bands, dtype=np.uint64))
    bits = ((mix(m.astype(np.uint64)) >> np.uint64(40)) & np.uint64(15)).astype(np.uint8)
    return keys.view(np.int64), (bits[::2] << 4 | bits[1::2]).view(np.int64)


def parities(shingles: np.ndarray) -> np.ndarray:
    """For each of ``ODD_BITS`` parts of the hashes whether it has an odd number of the set, as 64-bit numbers.

    An element that only one of two sets has turns one bit, so two sets differ in at least as many elements as bits.
    """
    odd = np.bincount((shingles >> np.uint64(40)).astype(np.int64) % ODD_BITS, minlength=ODD_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large or not small:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def signatures(docs: DataFrame, at: Limits) -> DataFrame:
    """Per row: doc_id, text_hash, n_shingles, set_key (16 bytes), bits, odd, bands."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            n, keys, bands, bits, odd = [], [], [], [], []
            for text in b.column("text").cast(pa.large_binary()).to_pylist():
                s = shingle_set(text, cache)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                k, v = bands_and_bits(minima(s), at) if len(s) else (np.empty(0, np.int64), np.empty(0, np.int64))
                bands.append(k)
                bits.append(v)
                odd.append(parities(s) if len(s) else np.empty(0, np.int64))
            lists = []
            for x in (bits, odd, bands):
                ends = np.concatenate([[0], np.cumsum([len(y) for y in x])]).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x) if x else [], pa.int64())))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), *lists], ["doc_id", "text_hash", "n_shingles", "set_key", "bits", "odd", "bands"])
        release()

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, n_shingles long, set_key binary, bits array<long>, odd array<long>, bands array<long>")


def _promising(pairs: DataFrame, classes: DataFrame, at: Limits) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures allow the threshold."""
    sides = {x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"), F.col("odd").alias(f"odd{x}")) for x in "ab"}
    return pairs.join(sides["a"], "a").join(sides["b"], "b").filter(_may("a", "b", at)).select("a", "b")


def _may(a: str, b: str, at: Limits):
    """Whether sizes, parities and signatures (columns n, odd and bits with ``a`` and ``b`` at their ends) allow the threshold.

    Sizes and parities rule out for sure; signatures but for the chance that ``limits`` states.
    """
    each = []
    for i in range(MINIMA // 16):
        x = f"(bits{a}[{i}] ^ bits{b}[{i}])"
        y = f"({x} | shiftrightunsigned({x}, 1))"
        each.append(f"bit_count(({y} | shiftrightunsigned({y}, 2)) & {0x1111111111111111}L)")
    odd = " + ".join(f"bit_count(odd{a}[{i}] ^ odd{b}[{i}])" for i in range(ODD_BITS // 64))
    na, nb = F.col(f"n{a}"), F.col(f"n{b}")
    # Sets of this similarity differ in (100 - percent) of each 100 + percent elements of both at most.
    alike = F.expr(odd) * (100 + at.percent) <= (na + nb) * (100 - at.percent)
    return (100 * F.least(na, nb) >= at.percent * F.greatest(na, nb)) & alike & (F.expr(" + ".join(each)) <= MINIMA - at.least_agreeing)


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar on full sets. ``texts``: node, text.

    The smaller side is streamed once and the other side's texts after it; a node
    with many partners is dealt to several tasks.
    """
    spread_over = max(SALT, pairs.count() // SALT)
    counted = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT).cast("int").alias("salts"), F.count(F.lit(1)).alias("n"))
    many = counted.filter(F.col("n") > spread_over).select("a", "salts")  # fewer than SALT rows
    salted = pairs.join(F.broadcast(many), "a", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    asked = salted.select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), F.col("b").alias("node"))
    leads = asked.select("a", "salt", F.lit(0).alias("kind"), F.col("a").alias("node")).distinct()
    stream = asked.unionByName(leads).join(texts, "node").repartition("a", "salt").sortWithinPartitions("a", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        now, lead = None, np.empty(0, np.uint64)
        for batch in batches:
            found = []
            columns = [batch.column(c).to_pylist() for c in ("a", "salt", "kind", "node")]
            for a, salt, kind, node, text in zip(*columns, batch.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                own = shingle_set(text, cache)
                if kind == 0:
                    now, lead = (a, salt), own
                elif now == (a, salt) and similar(lead, own, percent):
                    found.append((a, node))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])
        release()

    return stream.select("a", "salt", "kind", "node", "text").mapInArrow(run, "a long, b long")


def _led(placed: DataFrame, best_only: bool) -> DataFrame:
    """Pairs (a, b) of classes b with leaders a of their buckets, of another component; of each class all, or one.

    A bucket's leader is the class that meets most others: of copies of one text, mostly the text itself.
    """
    leaders = placed.groupBy("band").agg(F.max(F.struct("met", -F.col("node"), "component")).alias("l"))
    leaders = leaders.select("band", (-F.col("l.col2")).alias("a"), F.col("l.component").alias("led"), F.col("l.met").alias("reach"))
    found = placed.join(leaders, (placed["band"] == leaders["band"]) & (placed["component"] != leaders["led"]))
    found = found.groupBy(F.col("node").alias("b"), "a").agg(F.count(F.lit(1)).alias("shared"), F.any_value("reach").alias("reach"))
    if best_only:
        found = found.groupBy("b").agg(F.max(F.struct("shared", "reach", "a"))["a"].alias("a"))
    return found.select("a", "b")


def _components(docs: DataFrame, percent: int) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n_shingles, component_id, stays (whether it is its component's first row)."""
    short_batches(docs.sparkSession)
    at = limits(percent)
    rows = materialize(signatures(docs, at), "near-rows")
    classes = rows.filter("n_shingles > 0").groupBy("set_key").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.any_value("n_shingles").alias("n"), F.any_value("bits").alias("bits"), F.any_value("odd").alias("odd"), F.any_value("bands").alias("bands"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")

    members = classes.select("node", F.posexplode("bands").alias("place", "band"))
    full = members.groupBy("band").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    members = materialize(members.join(full, "band"), "near-members")
    met = members.groupBy("node").agg(F.sum("many").alias("met"))
    members = materialize(members.join(met, "node"), "near-members")

    wanted = members.select("node").distinct().join(classes.select("node", "first.doc_id", "first.text_hash"), "node")
    own = docs.select(F.col("doc_id").alias("__d"), F.xxhash64("text").alias("__h"), "text")
    texts = own.join(wanted, F.col("__d").eqNullSafe(F.col("doc_id")) & (F.col("__h") == F.col("text_hash"))).select("node", "text")
    if rows.groupBy("doc_id", "text_hash").count().filter("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["node"])  # repeated rows: one text a node
    texts = materialize(texts, "near-texts")

    # First each class is paired with one leader, that of most of its buckets; then, where a bucket still holds another
    # component than its leader's, with that leader too.
    placed, tried, links = members.withColumn("component", F.col("node")), None, None
    for best_only in (True, False):
        pairs = materialize(_promising(_led(placed, best_only), classes, at), "near-pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        new = materialize(confirmed(pairs, texts, percent), "near-links")
        if links is not None and not new.limit(1).count():
            break
        links = new if links is None else links.unionByName(new)
        labels = materialize(connected_components(links), "near-labels")
        placed = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))

    # What is left: pairs across components that meet in a bucket, each taken in the first band that both share.
    split = placed.groupBy("band").agg((F.min("component") < F.max("component")).alias("split")).filter("split").drop("split")
    placed = placed.select("band", "place", "node", "component").join(split, "band").join(classes.select("node", "n", "bits", "odd", "bands"), "node")
    x, y = (placed.select(*[F.col(c).alias(f"{c}_{s}") for c in placed.columns]) for s in "xy")
    first = F.array_position(F.zip_with("bands_x", "bands_y", lambda p, q: p == q), True) == F.col("place_x") + 1
    rest = x.join(y, (F.col("band_x") == F.col("band_y")) & (F.col("component_x") < F.col("component_y")) & _may("_x", "_y", at) & first)
    rest = rest.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"))
    tried = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = materialize(rest.join(tried, ["a", "b"], "left_anti"), "near-rest")
    if rest.limit(1).count():
        more = materialize(confirmed(rest, texts, percent), "near-links")
        if more.limit(1).count():
            labels = materialize(connected_components(links.unionByName(more)), "near-labels")

    known = classes.join(labels, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"), "first")
    least = known.groupBy("component").agg(F.min("first").alias("least"))
    known = known.join(least, "component").select("set_key", "least")
    out = rows.select("doc_id", "text_hash", "n_shingles", "set_key").join(known, "set_key", "left")
    alone = F.col("n_shingles") == 0
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id"))
    stays = alone | (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash")))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), stays.alias("stays"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    out = _components(docs.select("doc_id", "text"), percent)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row left of each component: that with its smallest doc_id. Rows without words all stay."""
    rows = materialize(_components(docs.select("doc_id", "text"), percent), "near-judged")
    h = fresh(docs, "__near_hash")
    out = docs.withColumn(h, F.xxhash64("text"))

    def same(other: DataFrame):
        return out["doc_id"].eqNullSafe(other["doc_id"]) & (out[h] == other["text_hash"])

    out = out.join(gone := rows.filter("not stays").select("doc_id", "text_hash").distinct(), same(gone), "left_anti")
    twice = rows.filter("stays and n_shingles > 0").groupBy("doc_id", "text_hash").count().filter("count > 1").select("doc_id", "text_hash")
    if twice.limit(1).count():
        once = out.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", h])
        out = out.join(twice, same(twice), "left_anti").unionByName(once)
    return out.drop(h)
