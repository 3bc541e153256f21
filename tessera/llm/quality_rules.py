"""Quality rules with risk-controlled cutoffs.

Every text is measured whole. A fixed base rule rejects very short and very
repetitive texts. Beyond it, each text has a badness: the largest of several
ratios, each divided by a fixed scale. A cutoff on the badness is chosen per
stratum from labelled rows: going down a grid that is fixed beforehand, a cutoff
is valid as long as the exact (Clopper-Pearson) upper bound on the share of
good rows that it rejects stays at most ``risk``. Going down in one fixed order
and stopping at the first failure needs no correction inside a stratum; the
error is divided among the strata (Bonferroni). Of the valid cutoffs the highest
is taken that still rejects nearly as many bad rows as the lowest.

Defined results: a null text has no words and fails the base rule; an empty
text too; a null stratum is a stratum of its own; repeated rows are judged one by
one; a document with several labels counts as good if their mean is at least a
half, null labels are ignored; a stratum with too few labelled rows, or no label
at all, gets no cutoff and only the base rule; other columns pass through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, hash_words, materialize, short_batches, window_hashes

SPACE = b" \t\n\v\f\r"
#: Fixed values of the base rule.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 20
MOST_REPEATED = 30  # per cent of the words
REPEAT_WINDOW = 8

#: ratio -> its value that counts as a badness of 1.
SCALES = {"symbols": 0.10, "marks": 0.50, "upper": 0.80, "dup_lines": 0.60, "repeats": 0.30}
GRID = 200  # cutoffs from GRID / 100 down to 0.01
RISK = 0.005
ERROR = 0.05
#: Strata with cutoffs up to which they are broadcast; beyond it they are joined.
MOST_BROADCAST = 10_000

UPPER = bytes(range(65, 91))
OTHER_THAN_UPPER = bytes(b for b in range(256) if b not in UPPER)
TAILS = bytes(range(0x80, 0xC0))
NOT_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
FIELDS = ", ".join(f"{c}: bigint" for c in COUNTS)


def repeated_words(words: list[bytes], cache: WordHashes, width: int = REPEAT_WINDOW) -> int:
    """Words inside windows of ``width`` words that the list holds twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = window_hashes(hash_words(words, cache), width)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    # Equal hashes are confirmed on the words themselves.
    first: dict[tuple, int] = {}
    real = np.zeros(n, dtype=bool)
    for i in np.flatnonzero(twice).tolist():
        j = first.setdefault(tuple(words[i : i + width]), i)
        if j != i:
            real[i] = real[j] = True
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, np.flatnonzero(real), 1)
    np.add.at(edges, np.flatnonzero(real) + width, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text: bytes | None, cache: WordHashes) -> tuple[int, ...]:
    """The counts of ``COUNTS`` for one text."""
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    solid = text.translate(None, SPACE)
    return (len(words), len(solid.translate(None, TAILS)), len(text.translate(None, NOT_SYMBOL)), len(lines) - len(set(lines)), repeated_words(words, cache), len(lines), len(text.translate(None, OTHER_THAN_UPPER)), text.count(b"!"))


def with_measures(docs: DataFrame, text: str = "text", out: str = "__m") -> DataFrame:
    """Add ``out``: a struct of the counts of the text."""

    @F.arrow_udf(f"struct<{FIELDS}>")
    def udf(texts: pa.Array) -> pa.Array:
        cache = WordHashes()
        rows = [measure(x, cache) for x in texts.cast(pa.large_binary()).to_pylist()]
        columns = zip(*rows, strict=True) if rows else [[] for _ in COUNTS]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(COUNTS))

    return docs.withColumn(out, udf.asNondeterministic()(F.col(text)))


def binomial_upper(k: int, n: int, error: float) -> float:
    """The exact upper confidence bound on a share of which ``k`` of ``n`` were seen."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]

    def tail(p: float) -> float:
        return sum(math.exp(c + i * math.log(p) + (n - i) * math.log1p(-p)) for i, c in enumerate(logs))

    low, high = k / n, 1.0 - 1e-15
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid) > error else (low, mid)
    return high


def choose_cutoff(good: list[int], bad: list[int], risk: float, error: float) -> float | None:
    """The cutoff for one stratum. ``good[i]``, ``bad[i]``: labelled rows whose badness is in step i of the grid (of 0.01); the last step is open."""
    n = sum(good)
    if not n:
        return None
    valid, k, caught = [], 0, 0
    for i in range(GRID, 0, -1):
        k += good[i]
        caught += bad[i]
        if k > risk * n or binomial_upper(k, n, error) > risk:
            break
        valid.append((i, caught))
    if not valid or not valid[-1][1]:
        return None
    return next(i for i, c in valid if c >= 0.99 * valid[-1][1]) / 100


def _badness(m: str = "__m"):
    c = lambda x: F.col(f"{m}.{x}").cast("double")
    ratio = {"symbols": c("n_symbols") / F.greatest(c("word_chars"), F.lit(1.0)), "marks": c("n_marks") / F.greatest(c("n_words"), F.lit(1.0)), "upper": c("n_upper") / F.greatest(c("word_chars"), F.lit(1.0)), "dup_lines": c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1.0)), "repeats": c("n_repeat_words") / F.greatest(c("n_words"), F.lit(1.0))}
    return F.greatest(*[ratio[k] / s for k, s in SCALES.items()])


def _base_failed(m: str = "__m"):
    return (F.col(f"{m}.n_words") < MIN_WORDS) | (100 * F.col(f"{m}.n_repeat_words") > MOST_REPEATED * F.col(f"{m}.n_words"))


def cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> list[tuple[str | None, float]]:
    """Per stratum its cutoff. ``measured`` has doc_id, the stratum, ``__m``; the base rule's rejects are not counted."""
    good = labels.filter("quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("__good"))
    step = F.least(F.floor(_badness() * 100), F.lit(GRID)).cast("int").alias("__step")
    rows = measured.filter(~_base_failed()).select(F.col("doc_id"), F.col(stratum).alias("__s"), step).join(good, "doc_id")
    table = rows.groupBy("__s", "__step").agg(F.count_if("__good").alias("good"), F.count_if(~F.col("__good")).alias("bad"))
    # A stratum needs this many good rows for any bound to be low enough, so few strata come to the driver.
    least = math.ceil(math.log(1 / error) / -math.log1p(-risk))
    big = table.groupBy("__s").agg(F.sum("good").alias("n")).filter(F.col("n") >= least).select(F.col("__s").alias("__t"))
    found: dict = {}
    for r in table.join(big, F.col("__s").eqNullSafe(F.col("__t")), "left_semi").collect():
        own = found.setdefault(r["__s"], ([0] * (GRID + 1), [0] * (GRID + 1)))
        own[0][r["__step"]] += r["good"]
        own[1][r["__step"]] += r["bad"]
    chosen = ((s, choose_cutoff(g, b, risk, error / max(1, len(found)))) for s, (g, b) in found.items())
    return sorted(((s, c) for s, c in chosen if c is not None), key=lambda x: (x[0] is not None, x[0] or ""))


def _judged(measured: DataFrame, chosen: list[tuple[str | None, float]], stratum: str) -> DataFrame:
    limits = measured.sparkSession.createDataFrame(chosen, "__s string, __cut double")
    if len(chosen) <= MOST_BROADCAST:  # two small values each
        limits = F.broadcast(limits)
    out = measured.join(limits, F.col(stratum).cast("string").eqNullSafe(F.col("__s")), "left") if chosen else measured.withColumn("__cut", F.lit(None).cast("double"))
    # floor(100 * badness) >= 100 * cutoff, as the grid was counted
    over = F.coalesce(F.floor(_badness() * 100) >= F.round(F.col("__cut") * 100), F.lit(False))
    return out.withColumn("__base_failed", _base_failed()).withColumn("__kept", ~(_base_failed() | over)).drop("__s", "__cut")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """``docs`` with ``__m`` (the counts), ``__base_failed`` and ``__kept``, in place of columns of those names.

    The documents are measured twice, once for the cutoffs, as this costs less
    than a shuffle of the texts.
    """
    docs = docs.drop("__m", "__s", "__cut", "__base_failed", "__kept")
    short_batches(docs.sparkSession)
    chosen = cutoffs(with_measures(docs.select("doc_id", stratum, "text")), labels, stratum)
    return _judged(with_measures(docs), chosen, stratum)


def verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """As ``judge`` but without the texts, which are measured once: doc_id, the stratum, ``__m``, ``__base_failed``, ``__kept``."""
    short_batches(docs.sparkSession)
    measured = materialize(with_measures(docs.select("doc_id", stratum, "text")).drop("text"), "measures")
    return _judged(measured, cutoffs(measured, labels, stratum), stratum)
