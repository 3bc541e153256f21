"""Exact removal of repeated word windows, found through difference-cover anchors.

A window is ``WINDOW`` words of one text. Anchors are shorter: ``ANCHOR`` words
that begin at places whose number modulo ``PERIOD`` is in ``COVER``. Any two
numbers have a shift below the period that brings both into the cover, so two
equal windows, wherever they begin, hold an equal anchor at the same offset.

Anchors are counted across the corpus first. Only windows with an anchor that
occurs elsewhere are then extended to their whole length and counted, by two
64-bit hashes; a window that occurs twice or more has all its words removed,
wherever it occurs. No step pairs occurrences, so a passage that a third of all
documents share costs one entry from each part of the corpus.

Defined results: a null text has no words, stays null, and has the digest of the
empty text; a text of which nothing is removed stays as it is, any other becomes
its kept words joined by one space; repeated rows are occurrences of their own,
so they lose what they share; an empty table gives no rows; other columns pass
through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fresh, mix, window_hashes, with_fields
from .exchange import PartWords, among, answered, by_part, dealt, heard, part_of, send, texts_of
from .exchange import SENT as SENT_SCHEMA

WINDOW = 35
#: A perfect difference cover: every number modulo the period is a difference of two of its members.
PERIOD = 21
COVER = (0, 1, 4, 14, 16)
ANCHOR = WINDOW - PERIOD + 1
_SECOND = 0xD6E8FEB86659FD93


def _anchors(words: PartWords) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors in texts that hold a window."""
    cover = np.zeros(PERIOD, dtype=bool)
    cover[list(COVER)] = True
    h = window_hashes(words.hashes, ANCHOR)
    n = len(h)
    keep = words.fits(ANCHOR) & cover[words.at[:n] % PERIOD] & (words.end[:n] - words.begin[:n] >= WINDOW)
    places = np.flatnonzero(keep)
    return places, h[places]


def _windows(words: PartWords, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and two hashes of the windows; of all, or of those at ``places``."""
    if places is None:
        places = np.flatnonzero(words.fits(WINDOW))
    first = window_hashes(words.hashes, WINDOW)
    second = window_hashes(mix(words.hashes ^ np.uint64(_SECOND)), WINDOW, _SECOND)
    return places, first[places], second[places]


def _twice(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Which (first, second) occur more than once."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    out = np.zeros(len(first), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _shared(keys: np.ndarray, extras: np.ndarray, parts: np.ndarray) -> list:
    """For each part its keys that another part has sent too."""
    again = _twice(keys, extras) if extras.dtype == np.uint64 else _twice(keys, np.zeros(len(keys), np.uint8))
    return by_part(parts[again], keys[again], extras[again])


def _among_pairs(first: np.ndarray, second: np.ndarray, keys: np.ndarray, extras: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(first), dtype=bool)
    hit = np.zeros(len(first), dtype=bool)
    for side, back in (("left", 0), ("right", 1)):
        at = np.clip(np.searchsorted(keys, first, side) - back, 0, len(keys) - 1)
        hit |= (keys[at] == first) & (extras[at] == second)
    return hit


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated windows cut from ``text``, and ``__n_words``, ``__n_removed``, ``__kept_sha256`` (in place of columns of those names)."""
    docs = docs.drop("__n_words", "__n_removed", "__kept_sha256")
    own_part = fresh(docs, "__part")
    given, bits = dealt(docs, own_part)
    cells = given.groupBy(own_part)

    def anchors(key: tuple, table: pa.Table) -> pa.Table:
        keys = np.unique(_anchors(PartWords(texts_of(table)))[1])
        return send(part_of(key), keys, np.empty(0, np.uint8), bits)

    def candidates(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        words = PartWords(texts_of(table))
        places, h = _anchors(words)
        seen, many = np.unique(h, return_counts=True)
        again = among(h, seen[many > 1]) | among(h, heard(answers, 0, "uint8")[0])
        marks = np.zeros(len(words.hashes) + 1, dtype=np.int64)
        marks[places[again] + 1] = 1
        before = np.cumsum(marks)  # anchors that occur again, before each place
        fits = np.flatnonzero(words.fits(WINDOW))
        fits = fits[before[fits + PERIOD] > before[fits]]
        _, first, second = _windows(words, fits)
        order = np.lexsort((second, first))
        first, second = first[order], second[order]
        new = np.ones(len(first), dtype=bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        return send(part_of(key), first[new], second[new], bits)

    schema = with_fields(docs.schema, ("__n_words", T.LongType()), ("__n_removed", T.LongType()), ("__kept_sha256", T.StringType()))

    def cut(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = texts_of(table)
        words = PartWords(texts)
        places, first, second = _windows(words)
        gone = places[_twice(first, second) | _among_pairs(first, second, *heard(answers, 0, "uint64"))]
        edges = np.zeros(len(words.hashes) + 1, dtype=np.int32)
        edges[gone] += 1
        edges[gone + WINDOW] -= 1  # places are distinct, so both steps count each window once
        removed = np.cumsum(edges[:-1]) > 0
        kept_texts, lost, digests = [], [], []
        for i, t in enumerate(texts):
            own = removed[words.begins[i] : words.ends[i]]
            kept = (t or b"").split()
            n = int(own.sum())
            if n:
                kept = [w for w, out in zip(kept, own.tolist(), strict=True) if not out]
            joined = b" ".join(kept)
            kept_texts.append(None if t is None else joined.decode() if n else t.decode())
            lost.append(n)
            digests.append(hashlib.sha256(joined).hexdigest())
        table = table.drop_columns([own_part])
        at = table.schema.get_field_index("text")
        table = table.set_column(at, "text", pa.array(kept_texts, table.schema.field("text").type))
        for name, values, kind in (("__n_words", words.lengths, pa.int64()), ("__n_removed", lost, pa.int64()), ("__kept_sha256", digests, pa.string())):
            table = table.append_column(name, pa.array(values, kind))
        return table

    known = answered(cells.applyInArrow(anchors, SENT_SCHEMA), bits, lambda k, e, p: _shared(k, np.zeros(len(k), np.uint8), p), "uint8")
    sent = cells.cogroup(known.groupBy("part")).applyInArrow(candidates, SENT_SCHEMA)
    windows = answered(sent, bits, _shared, "uint64")
    return cells.cogroup(windows.groupBy("part")).applyInArrow(cut, schema)


def brute_force(texts: list[str | None], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """(words, removed, digest) of each text; for tests."""
    words = [(t or "").encode().split() for t in texts]
    seen: dict[tuple, int] = {}
    for w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for w in words:
        gone: set[int] = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out
