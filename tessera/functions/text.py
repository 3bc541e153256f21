"""Scalar text, date and money functions, all as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Address abbreviations that are spelled out, date formats, punctuation of names.
ABBREVIATIONS = {" st ": " street ", " ave ": " avenue ", " rd ": " road ", " dr ": " drive ", " blvd ": " boulevard ", " apt ": " apartment "}
CANADIAN_POSTAL = r"\b[a-z]\d[a-z]\s?\d[a-z]\d\b"
US_ZIP = r"\b\d{5}(?:-\d{4})?\b"
DATE_FORMATS = ("yyyy-MM-dd", "M/d/yyyy", "d/M/yyyy", "MMMM d, yyyy", "d MMMM yyyy")
FULL_DATE = r"^(\d{4}-\d{2}-\d{2}([T ].*)?|\d{1,2}/\d{1,2}/\d{4}|[A-Za-z]+ \d{1,2}, \d{4}|\d{1,2} [A-Za-z]+ \d{4})$"
TOKENS_PER_WORD = 0.75
#: Lines whose lengths are summed together.
OFFSET_BLOCK = 128


def strip(c: Column) -> Column:
    """Without white space of any kind at either end (``trim`` takes blanks only)."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def words(c: Column) -> Column:
    """Runs of characters that are not white space; none for a blank text."""
    return F.filter(F.split(strip(c), r"\s+"), lambda w: w != "")


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def paragraphs(c: Column) -> Column:
    """Stripped, non-empty runs between blank lines."""
    return F.filter(F.transform(F.split(c, "\n\n", -1), strip), lambda p: p != "")


def bound(c: Column, body) -> Column:
    """``body`` of ``c``, which is worked out once however often ``body`` has it, inside of lambdas too."""
    return F.transform(F.array(c), body)[0]


def _total(numbers: Column, first: Column, many: Column) -> Column:
    return F.aggregate(F.slice(numbers, first, many), F.lit(0), lambda n, x: n + x)


def line_offsets(c: Column) -> Column:
    """Where each line begins: the lengths of the lines before it, each with its line end.

    Lengths are summed in blocks of lines first, so a line looks at few others however many there are.
    """
    blocks = lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / OFFSET_BLOCK).cast("int")), lambda k: _total(n, k * OFFSET_BLOCK + 1, F.lit(OFFSET_BLOCK)))
    block = lambda i: F.floor(i / OFFSET_BLOCK).cast("int")
    offset = lambda n, t, i: _total(t, F.lit(1), block(i)) + _total(n, block(i) * OFFSET_BLOCK + 1, i % OFFSET_BLOCK)
    return bound(F.transform(lines(c), lambda x: F.length(x) + 1), lambda n: bound(blocks(n), lambda t: F.transform(n, lambda _, i: offset(n, t, i))))


def offsets_hold(text: Column, own: Column, offsets: Column) -> Column:
    """Whether every line is found at its offset."""
    return F.forall(F.zip_with(own, offsets, lambda x, o: F.substring(text, o + 1, F.length(x)) == x), lambda ok: ok)


def numbered_lines(c: Column, width: int = 3) -> Column:
    return F.array_join(F.transform(lines(c), lambda x, i: F.concat(F.lpad((i + 1).cast("string"), width, " "), F.lit(": "), x)), "\n")


def canonical_name(c: Column) -> Column:
    """Lower case; of three or more words the first and the last."""
    parts = words(F.lower(c))
    return F.when(F.size(parts) >= 3, F.concat_ws(" ", F.element_at(parts, 1), F.element_at(parts, -1))).otherwise(F.array_join(parts, " "))


def normalize_address(c: Column) -> Column:
    out = F.lower(F.coalesce(c, F.lit("")))
    for pattern in (CANADIAN_POSTAL, US_ZIP):
        out = F.regexp_replace(out, pattern, "")
    out = strip(F.regexp_replace(F.regexp_replace(out, r"[,.\-#]", " "), r"\s+", " "))
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), ABBREVIATIONS.items(), out)


def parse_date(c: Column) -> Column:
    """The first of the known formats that fits; month before day where both would do."""
    text = strip(c)
    whole = F.when(text.rlike(FULL_DATE), F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2})[T ].*$", "$1"))
    return F.coalesce(*[F.try_to_date(whole, f) for f in DATE_FORMATS])


def normalize_value(c: Column) -> Column:
    """Dates as ISO; of other values the first and last word, lower case, without punctuation.

    Only whole dates count as dates. Of two words of which the first is an initial, the second.
    """
    parts = words(F.regexp_replace(F.lower(c), r"[.,\-]", " "))
    n = F.size(parts)
    name = F.when(n >= 3, F.concat_ws(" ", F.element_at(parts, 1), F.element_at(parts, -1))).when((n == 2) & (F.length(F.element_at(parts, 1)) == 1), F.element_at(parts, 2)).otherwise(F.array_join(parts, " "))
    return F.coalesce(F.date_format(parse_date(c), "yyyy-MM-dd"), name)


def age(dob: Column, asof: Column) -> Column:
    """Whole years; 0 where the date of birth is unknown."""
    return F.coalesce(F.floor(F.months_between(asof, dob) / 12).cast("int"), F.lit(0))


def long_date(d: Column) -> Column:
    return F.date_format(d, "MMMM dd, yyyy")


def provider_name(c: Column) -> Column:
    """Digits and one-letter words go; words are capitalised; ``Dr.`` comes before."""
    parts = F.filter(words(F.regexp_replace(F.coalesce(c, F.lit("")), r"\d+", "")), lambda w: F.length(w) > 1)
    capital = F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000))))
    return F.when(F.size(capital) > 0, F.concat(F.lit("Dr. "), F.array_join(capital, " "))).otherwise("Unknown Provider")


def safe_double(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def money(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 2))


def token_estimate(text: Column) -> Column:
    return F.size(words(text)) / F.lit(TOKENS_PER_WORD)


def snake(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), r"[^a-z0-9_]", "_")


def xml_escape(c: Column) -> Column:
    # The entities of XML.
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def json_in(c: Column) -> Column:
    """The text from the first ``{`` to the last ``}``, if it parses; fences around it don't matter."""
    found = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(found).isNotNull(), found)


def line_with(own_lines: Column, value: Column) -> Column:
    """Number from 1 of the first line that holds ``value``, whatever the case; null if none does."""
    at = F.array_position(F.transform(own_lines, lambda x: F.contains(F.lower(x), F.lower(value))), True)
    return F.when((at > 0) & (value != ""), at.cast("int"))


def value_span(text: Column, value: Column) -> Column:
    """line_number, begin and end (offsets in ``text``) of where ``value`` is first found, whatever the case; nulls if it isn't."""
    at = lambda own: F.struct(own.alias("lines"), line_with(own, value).alias("n"))
    offsets = line_offsets(text)
    begin = lambda x: F.element_at(offsets, x["n"]) + F.instr(F.lower(F.element_at(x["lines"], x["n"])), F.lower(value)) - 1
    span = lambda x: F.struct(x["n"].alias("line_number"), F.when(x["n"].isNotNull(), begin(x)).alias("begin"), F.when(x["n"].isNotNull(), begin(x) + F.length(value)).alias("end"))
    return bound(bound(lines(text), at), span)


def paragraph_of_line(text: Column, line: Column) -> Column:
    """Number from 1 of the paragraph that a line is in: blank lines before it, counted once a run, and one."""
    before = F.concat(F.array_join(F.slice(lines(text), F.lit(1), line - 1), "\n"), F.lit("\n"))
    return F.regexp_count(before, F.lit(r"\n\n+")) + F.lit(1)


def confidence_colour(c: Column) -> Column:
    """From red at 0 to green at 1, as a hexadecimal colour."""
    # The two ends.
    low, high = (231, 76, 60), (39, 174, 96)
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return F.format_string("#%02x%02x%02x", *[F.floor(x + (y - x) * at).cast("int") for x, y in zip(low, high, strict=True)])


def phrase_candidates(question: Column) -> Column:
    """Words of a question that may name somebody, and pairs of neighbours among them."""
    # Words that name nobody.
    stop = "what is are the of get tell me about give find show list their his her for who does do has have a an from by with at how when where why did was were will can".split()
    clean = F.regexp_replace(F.lower(question), r"['’`]s?\b", " ")
    bare = F.transform(words(clean), lambda w: F.regexp_replace(w, r"^[.,!?]+|[.,!?]+$", ""))
    own = F.filter(bare, lambda w: (F.length(w) >= 3) & ~F.array_contains(F.array(*[F.lit(s) for s in stop]), w))
    pairs = F.transform(F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(own, i + 1)))
    return F.concat(own, pairs)
