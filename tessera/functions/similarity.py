"""String and vector similarity, all as Column expressions.

The fuzzy ratios rest on the longest common subsequence (the public definition of
the Indel ratio), found bit by bit: a string is a word of 60 bits for each of its
characters, and each character of the other string is one step of additions. Longer
strings take several words, with carries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text


def name_score(a: Column, b: Column) -> Column:
    """1 if equal, 0.75 if one holds the other, else 0; case and outer blanks don't count."""
    x, y = F.lower(text.strip(a)), F.lower(text.strip(b))
    return F.when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.75).otherwise(0.0)


def query_score(query: Column, candidate: Column) -> Column:
    """1 if equal, 0.8 if one holds the other, else shared words over the larger number of words."""
    x, y = F.lower(text.strip(query)), F.lower(text.strip(candidate))
    p, q = F.array_distinct(text.words(x)), F.array_distinct(text.words(y))
    shared = F.size(F.array_intersect(p, q)) / F.greatest(F.size(p), F.size(q), F.lit(1))
    return F.when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.8).otherwise(shared)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """From 0 to 1; 0 for nulls, unequal lengths and zero vectors. Norms that are known need not be found again."""
    n = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / n))
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)) | (n == 0), 0.0).otherwise(value)


#: Bits of a word; a sum of two words stays within 64.
_BITS = 60


def _given(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return text.bound(value, body)


def characters(a: Column) -> Column:
    n = F.length(a)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def _bits(chars: Column, first: Column, c: Column) -> Column:
    """Which of the ``_BITS`` characters from ``first`` on (from 0) are ``c``."""
    own = F.slice(chars, first + 1, F.lit(_BITS))
    return F.aggregate(F.sequence(F.lit(0), F.size(own) - 1), F.lit(0).cast("long"), lambda m, i: m + F.when(F.get(own, i) == c, F.pow(F.lit(2.0), i).cast("long")).otherwise(0))


def _ones(n: Column) -> Column:
    return F.pow(F.lit(2.0), n).cast("long") - 1


def _lcs_short(chars: Column, others: Column) -> Column:
    """At most ``_BITS`` characters, at least one."""
    n = F.size(chars)
    masks = F.map_from_entries(F.transform(F.array_distinct(chars), lambda c: F.struct(c, _bits(chars, F.lit(0), c))))
    hits = _given(masks, lambda m: F.transform(others, lambda c: F.coalesce(F.try_element_at(m, c), F.lit(0).cast("long"))))
    full = _ones(n)
    row = F.aggregate(hits, full, lambda r, m: (r + r.bitwiseAND(m)).bitwiseOR(r - r.bitwiseAND(m)).bitwiseAND(full))
    return n - F.bit_count(row)


def _lcs_long(chars: Column, others: Column) -> Column:
    """Any number of characters, in words of ``_BITS``."""
    n, zero = F.size(chars), F.lit(0).cast("long")
    places = F.sequence(F.lit(0), F.floor((n - 1) / _BITS).cast("int"))
    masks = F.map_from_entries(F.transform(F.array_distinct(chars), lambda c: F.struct(c, F.transform(places, lambda w: _bits(chars, w * _BITS, c)))))
    hits = _given(masks, lambda m: F.transform(others, lambda c: F.try_element_at(m, c)))
    start = F.transform(places, lambda w: _ones(F.least(n - w * _BITS, F.lit(_BITS))))

    def added(row: Column, m: Column) -> Column:
        none = F.struct(F.array().cast("array<bigint>").alias("out"), zero.alias("carry"))

        def word(s: Column, w: Column) -> Column:
            r, full = F.get(row, w), F.get(start, w)
            hit = r.bitwiseAND(F.get(m, w))
            total = r + hit + s["carry"]
            new = total.bitwiseOR(r - hit).bitwiseAND(full)
            return F.struct(F.array_append(s["out"], new).alias("out"), F.shiftright(total, _BITS).alias("carry"))

        return F.aggregate(places, none, word, lambda s: s["out"])

    row = F.aggregate(hits, start, lambda r, m: F.when(m.isNull(), r).otherwise(added(r, m)))
    return n - F.aggregate(row, F.lit(0), lambda s, r: s + F.bit_count(r))


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two strings."""
    both = F.struct(characters(a).alias("a"), characters(b).alias("b"))
    return _given(both, lambda s: F.when((F.size(s["a"]) == 0) | (F.size(s["b"]) == 0), 0).when(F.size(s["a"]) <= _BITS, _lcs_short(s["a"], s["b"])).otherwise(_lcs_long(s["a"], s["b"])))


def indel_ratio(a: Column, b: Column) -> Column:
    """Twice the longest common subsequence over both lengths; 1 for two empty strings."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).when(a == b, 1.0).otherwise(2 * common_length(a, b) / total)


def token_ratio(a: Column, b: Column) -> Column:
    """The best of the ratios of sorted words and of shared words with each side's rest; case doesn't count."""
    space = F.lit(" ")
    joined = lambda words: F.array_join(words, " ")
    sorted_words = lambda c: F.array_sort(text.words(F.lower(F.coalesce(c, F.lit("")))))
    words = F.struct(sorted_words(a).alias("a"), sorted_words(b).alias("b"))

    def scored(w: Column) -> Column:
        x, y = F.array_distinct(w["a"]), F.array_distinct(w["b"])
        sides = F.struct(F.array_intersect(x, y).alias("both"), F.array_except(x, y).alias("x"), F.array_except(y, x).alias("y"))

        def best(s: Column) -> Column:
            core, shared = F.length(joined(s["both"])), F.size(s["both"]) > 0
            rest = lambda own: F.when(shared, core + F.length(space) + F.length(joined(own))).otherwise(F.length(joined(own)))
            with_rest = lambda own: joined(F.concat(s["both"], own))
            # the shared words are the beginning of both
            cores = F.when(shared, F.greatest(2 * core / (core + rest(s["x"])), 2 * core / (core + rest(s["y"])))).otherwise(0.0)
            return F.when(shared & ((F.size(s["x"]) == 0) | (F.size(s["y"]) == 0)), 1.0).otherwise(F.greatest(indel_ratio(joined(w["a"]), joined(w["b"])), indel_ratio(with_rest(s["x"]), with_rest(s["y"])), cores))

        return _given(sides, best)

    return _given(words, scored)


def partial_ratio(a: Column, b: Column) -> Column:
    """The best Indel ratio of the shorter text with any part of the other that is as long, or shorter at its ends."""
    swap = F.length(b) < F.length(a)
    given = F.struct(F.when(swap, b).otherwise(a).alias("short"), F.when(swap, a).otherwise(b).alias("long"))

    def best(s: Column) -> Column:
        n, m = F.length(s["short"]), F.length(s["long"])
        # a part begins at i, or where i is below 0 the text does
        parts = F.transform(F.sequence(1 - n, m - 1), lambda i: F.substring(s["long"], F.greatest(i, F.lit(0)) + 1, F.least(n, n + i)))
        return F.when(n == 0, F.when(m == 0, 1.0).otherwise(0.0)).when(F.contains(s["long"], s["short"]), 1.0).otherwise(F.array_max(F.transform(parts, lambda p: indel_ratio(s["short"], p))))

    return _given(given, best)


def weighted_ratio(a: Column, b: Column) -> Column:
    """The best of several ratios, after the public definition of the weighted one: whole texts; words in any order, for 0.95
    of it; where one is half as long again as the other, parts of it for 0.9, or 0.6 from eight times as long."""
    given = F.struct(F.coalesce(a, F.lit("")).alias("a"), F.coalesce(b, F.lit("")).alias("b"))

    def best(s: Column) -> Column:
        a, b = s["a"], s["b"]
        longer = F.greatest(F.length(a), F.length(b)) / F.least(F.length(a), F.length(b))
        scale = F.when(longer < 8, 0.9).otherwise(0.6)
        in_order = lambda c: F.array_join(F.array_sort(text.words(c)), " ")
        words = F.when(F.arrays_overlap(text.words(a), text.words(b)), 1.0).otherwise(partial_ratio(in_order(a), in_order(b)))
        near = F.greatest(indel_ratio(a, b), 0.95 * token_ratio(a, b))
        far = F.greatest(indel_ratio(a, b), scale * partial_ratio(a, b), 0.95 * scale * words)
        return F.when((a == "") | (b == ""), 0.0).when(longer < 1.5, near).otherwise(far)

    return _given(given, best)


def fuzzy_name_score(a: Column, b: Column) -> Column:
    return token_ratio(a, b)


def fuzzy_ratio(a: Column, b: Column) -> Column:
    plain = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return indel_ratio(plain(a), plain(b))


def fuzzy_query_score(query: Column, candidate: Column) -> Column:
    """1 if equal, else 0.7 of the weighted and 0.3 of the partial ratio; 0 without a question."""
    plain = lambda c: F.lower(text.strip(F.coalesce(c, F.lit(""))))
    given = F.struct(plain(query).alias("q"), plain(candidate).alias("c"))
    blend = lambda s: F.when(s["q"] == s["c"], 1.0).otherwise(0.7 * weighted_ratio(s["q"], s["c"]) + 0.3 * partial_ratio(s["q"], s["c"]))
    return F.when(F.coalesce(query, F.lit("")) == "", 0.0).otherwise(_given(given, blend))


def fuzzy_weighted_score(a: Column, b: Column) -> Column:
    plain = lambda c: F.lower(text.strip(F.coalesce(c, F.lit(""))))
    return weighted_ratio(plain(a), plain(b))
