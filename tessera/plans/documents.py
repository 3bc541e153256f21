"""Document and text-function queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import rules
from tessera.functions import text as tx
from tessera.operators import align as A
from tessera.operators import retrieve as R

from .claims import _case, read


def _docs(spark, sf_dir, *columns):
    return read(spark, sf_dir, "documents").select("doc_id", "text", *columns)


def lines_offsets(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    pairs = docs.select("doc_id", F.posexplode(F.arrays_zip(tx.lines(F.col("text")).alias("line"), tx.line_offsets(F.col("text")).alias("offset"))).alias("pos", "x"))
    return pairs.select("doc_id", (F.col("pos") + 1).alias("line_number"), F.col("x.line").alias("line"), F.col("x.offset").alias("line_offset"))


def line_invariant(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select(tx.offsets_hold(t, tx.lines(t), tx.line_offsets(t)).alias("ok")).agg(F.count_if(~F.col("ok")).alias("violations"), F.count(F.lit(1)).alias("documents"))


def numbered_lines(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.numbered_lines(F.col("text")).alias("numbered"))


def word_tokens(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.size(tx.words(t)).alias("words"), tx.token_estimate(t).alias("tokens"), F.size(tx.paragraphs(t)).alias("paragraphs"), (tx.strip(t) == "").alias("empty"))


def token_budget_pack(spark, sf_dir):
    """Per source the documents by length, as far as the context's budget goes."""
    docs = _docs(spark, sf_dir, "source", "n_chars")
    return R.pack_context(docs, "n_chars", "doc_id", by=["source"]).select("source", "doc_id", "position", "tokens")


def token_budget_pack_all(spark, sf_dir):
    """One question over all documents."""
    return R.pack_context(_docs(spark, sf_dir, "n_chars"), "n_chars", "doc_id").select("doc_id", "position", "tokens")


def context_render(spark, sf_dir):
    docs = _docs(spark, sf_dir, "source", "n_chars").withColumn("filename", F.format_string("%d.txt", F.col("doc_id")))
    return R.render_context(R.pack_context(docs, "n_chars", "doc_id", by=["source"]), ["source"])


def doc_type_detect(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", rules.doc_type(F.col("text")).alias("doc_type"))


def doc_type_histogram(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.groupBy("p_type").agg(F.count(F.lit(1)).alias("documents"), F.count_distinct(tx.canonical_name(F.col("p_name"))).alias("people"))


def regex_fields(spark, sf_dir):
    """Fields of rendered identity cards, one for each customer."""
    c = read(spark, sf_dir, "customer").select("c_custkey")
    c = c.repartition(spark.sparkContext.defaultParallelism * 4, "c_custkey")  # a small file is one task, its patterns are much work
    day = F.lpad((F.col("c_custkey") % 28 + 1).cast("string"), 2, "0")
    text = F.concat(
        F.lit("ARIZONA DRIVER LICENSE\nCLASS "), F.substring(F.lit("ABCD"), (F.col("c_custkey") % 4 + 1).cast("int"), F.lit(1)), F.lit("\nDL U"), F.lpad(F.col("c_custkey").cast("string"), 8, "1"), F.lit("\n: MORVANTA\\\n2 LEE\nDOB 03/"), day, F.lit("/1992\nISS 04/"), day,
        F.lit("/2019 EXP 05/"), day, F.lit("/2027\nSEX M HGT 509 WGT 160 BRN\nMain Street, AZ 85281\n"),
    )
    fields = rules.extract_fields(F.col("text"))
    names = ["license_number", "dob", "issue_date", "expiry_date", "name", "class", "state", "height", "weight", "eye_color", "sex", "address"]
    return c.select("c_custkey", text.alias("text")).select("c_custkey", *[fields[n].alias(n) for n in names])


def canonical_names(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", tx.canonical_name(F.concat_ws(" ", "p_name", "p_brand")).alias("canonical"), tx.canonical_name(F.col("p_name")).alias("short"))


def address_normalize(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    address = F.concat((F.col("c_custkey") % 97).cast("string"), F.lit(" Maple St., #"), F.col("c_nationkey").cast("string"), F.lit(" Apt 4, Vancouver BC V6B 2W9 85281-3885"))
    return c.select("c_custkey", tx.normalize_address(address).alias("address"))


def value_normalize(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", tx.normalize_value(F.concat_ws(" ", "p_name", F.lit("B."), "p_brand")).alias("three"), tx.normalize_value(F.concat(F.lit("J "), F.col("p_brand"))).alias("two"), tx.normalize_value(F.concat(F.lit("03/"), (F.col("p_partkey") % 28 + 1).cast("string"), F.lit("/1992"))).alias("date"))


def date_functions(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    d = F.to_date("o_orderdate")
    return o.select("o_orderkey", tx.age(d, F.lit("2024-06-15").cast("date")).alias("age"), tx.long_date(d).alias("long_date"), F.abs(F.datediff(d, F.lit("1995-01-01").cast("date"))).alias("days"), F.substring(F.col("o_orderdate").cast("string"), 1, 10).alias("day"))


def string_functions(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    name = F.concat(F.col("c_name"), F.lit(" <O'Hara> & Co"))
    return c.select("c_custkey", tx.snake(name).alias("snake"), tx.xml_escape(name).alias("xml"), tx.money(F.col("c_acctbal")).alias("money"), tx.safe_double(F.col("c_mktsegment")).alias("not_a_number"), F.sha2("c_name", 256).alias("sha"), F.substring("c_mktsegment", 1, 5).alias("preview"), tx.confidence_colour((F.col("c_custkey") % 101) / 100).alias("colour"))


def json_extract(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    noisy = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise("no object here")
    return e.select("event_id", tx.json_in(noisy).alias("found"))


def line_search(spark, sf_dir):
    """Where the word ``the`` is first found: line, and its paragraph."""
    t = F.col("text")
    found = _docs(spark, sf_dir).select("doc_id", "text", tx.line_with(tx.lines(t), F.lit("the")).alias("line_number"))
    return found.select("doc_id", "line_number", F.when(F.col("line_number").isNotNull(), tx.paragraph_of_line(t, F.col("line_number"))).alias("paragraph"))


def new_files_antijoin(spark, sf_dir):
    docs, known = _docs(spark, sf_dir).select("doc_id"), read(spark, sf_dir, "labels").select("doc_id")
    return docs.join(known, "doc_id", "left_anti")


def group_texts(spark, sf_dir):
    """Texts that are not blank, by language: counts, and the length of all."""
    docs = _docs(spark, sf_dir, "lang").filter(tx.strip(F.col("text")) != "")
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.length("text")).alias("chars"), F.count_distinct("text").alias("distinct_texts"))


def aligned_values(spark, sf_dir):
    """Some of each document's own words in another case, its end, and a value that it lacks, with their places in the text."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    words = tx.words(F.col("text"))
    told = F.create_map(F.lit("twentieth"), F.lower(F.try_element_at(words, F.lit(20))), F.lit("last"), F.try_element_at(words, F.lit(-1)), F.lit("lacks"), F.lit("no such value"))
    values = d.select("doc_id", F.explode(told).alias("key", "value"))
    return A.align(values, d).select("doc_id", "key", "line", "paragraph", "start", "end", "source_line")


def aligned_facts(spark, sf_dir):
    """Facts of entities whose documents are rendered from parts: a line for each brand's sizes and types."""
    p = read(spark, sf_dir, "part")
    line = F.concat_ws(" ", "p_name", F.lit("of size"), F.concat(F.lit("No."), F.col("p_size").cast("string"), F.lit(",")), "p_type")
    docs = p.select((F.col("p_partkey") % 50).alias("doc_id"), "p_partkey", line.alias("line")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "line"))), lambda s: s["line"]), "\n\n").alias("text"))
    made = F.create_map(F.lit("size"), F.concat(F.lit("no."), F.col("p_size").cast("string"), F.lit(",")), F.lit("type"), F.upper("p_type"), F.lit("_private"), F.lit("x"), F.lit("blank"), F.lit(" "))
    e = p.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), (F.col("p_partkey") % 50).alias("source_doc_id"), made.alias("attributes"))
    return A.aligned_facts(e, docs).select("entity_id", "key", "fact", "line", "paragraph", "start", "end", "source_line")


QUERIES = {f.__name__: f for f in (lines_offsets, line_invariant, numbered_lines, word_tokens, token_budget_pack, token_budget_pack_all, context_render, doc_type_detect, doc_type_histogram, regex_fields, canonical_names, address_normalize, value_normalize, date_functions, string_functions, json_extract, line_search, new_files_antijoin, group_texts, aligned_values, aligned_facts)}

# In DuckDB, white space as Java's \s has it.
_WS = "[ \\t\\n\\x0B\\f\\r]+"
_WORDS = f"list_filter(string_split_regex(text, '{_WS}'), lambda x: x <> '')"
_PACK = f"""w AS (SELECT doc_id, source, text, n_chars, len({_WORDS}) / 0.75::DOUBLE AS tokens FROM documents),
  r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS position, sum(tokens) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM w)"""
_CANON = "CASE WHEN len(x) >= 3 THEN x[1] || ' ' || x[-1] ELSE array_to_string(x, ' ') END"
_DAY = "lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0')"


def _address_sql() -> str:
    x = "lower((c_custkey % 97) || ' Maple St., #' || c_nationkey || ' Apt 4, Vancouver BC V6B 2W9 85281-3885')"
    for p, r in ((r"\b[a-z]\d[a-z]\s?\d[a-z]\d\b", ""), (r"\b\d{5}(?:-\d{4})?\b", ""), (r"[,.\-#]", " "), (r"\s+", " ")):
        x = f"regexp_replace({x}, '{p}', '{r}', 'g')"
    x = f"trim({x})"
    for k, v in tx.ABBREVIATIONS.items():
        x = f"replace({x}, '{k}', '{v}')"
    return x



_HINTED = r"CASE WHEN regexp_matches(text, '\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b') AND (regexp_matches(text, '\b(AZ|CA|NY|TX|FL|BC|ON|AB|QC)\b') OR regexp_matches(lower(text), 'dob|birth|born|poe|poc')) THEN 'DRIVERS_LICENSE' ELSE 'GENERIC' END"

#: Of rows v (.., value, text) the first place of the value and what follows from it.
_PLACED = r"""x AS (SELECT *, CAST(nullif(strpos(lower(text), lower(value)), 0) - 1 AS INT) AS start FROM v),
  y AS (SELECT *, left(text, start + 1) AS head, CAST(start + length(value) AS INT) AS "end" FROM x),
  z AS (SELECT *, CAST(len(string_split(head, chr(10))) AS INT) AS line, CAST(len(list_filter(string_split(head, chr(10) || chr(10)), lambda q: regexp_matches(q, '\S'))) AS INT) AS paragraph FROM y)"""

ORACLES = {
    "lines_offsets": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) SELECT doc_id, CAST(n AS INT) AS line_number, line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS line_offset FROM l",
    "line_invariant": "WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM l) SELECT count(DISTINCT doc_id) FILTER (substr(text, CAST(begins + 1 AS BIGINT), length(line)) <> line) AS violations, count(DISTINCT doc_id) AS documents FROM o",
    "numbered_lines": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) SELECT doc_id, string_agg(lpad(CAST(n AS VARCHAR), 3, ' ') || ': ' || line, chr(10) ORDER BY n) AS numbered FROM l GROUP BY doc_id",
    "word_tokens": f"SELECT doc_id, CAST(len({_WORDS}) AS INT) AS words, len({_WORDS}) / 0.75::DOUBLE AS tokens, CAST(len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: regexp_matches(p, '[^ \\t\\n\\x0B\\f\\r]'))) AS INT) AS paragraphs, len({_WORDS}) = 0 AS empty FROM documents",
    "token_budget_pack": f"WITH {_PACK} SELECT source, doc_id, CAST(position AS INT) AS position, tokens FROM r WHERE used <= 3686 OR position = 1",
    "token_budget_pack_all": f"WITH w AS (SELECT doc_id, n_chars, len({_WORDS}) / 0.75::DOUBLE AS tokens FROM documents), r AS (SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS position, sum(tokens) OVER (ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM w) SELECT doc_id, CAST(position AS INT) AS position, tokens FROM r WHERE used <= 3686 OR position = 1",
    "context_render": f"WITH {_PACK} SELECT source, string_agg('Document ' || position || ' (' || doc_id || '.txt):' || chr(10) || text, chr(10) || chr(10) ORDER BY position) AS context FROM r WHERE used <= 3686 OR position = 1 GROUP BY source",
    "doc_type_detect": f"SELECT doc_id, {_case(rules.DOC_TYPE_KEYWORDS, 'lower(text)', _HINTED)} AS doc_type FROM documents",
    "doc_type_histogram": f"WITH x AS (SELECT p_type, string_split(lower(p_name), ' ') AS x FROM part) SELECT p_type, count(*) AS documents, count(DISTINCT {_CANON}) AS people FROM x GROUP BY p_type",
    "regex_fields": f"""SELECT c_custkey, 'U' || lpad(CAST(c_custkey AS VARCHAR), 8, '1') AS license_number, '03/' || {_DAY} || '/1992' AS dob, '04/' || {_DAY} || '/2019' AS issue_date, '05/' || {_DAY} || '/2027' AS expiry_date, 'Lee Morvantaj' AS name,
      substr('ABCD', CAST(c_custkey % 4 + 1 AS INT), 1) AS class, 'AZ' AS state, '5''09"' AS height, '160 lbs' AS weight, 'Brown' AS eye_color, 'Male' AS sex, 'BRN Main Street, AZ 85281' AS address FROM customer""",
    "canonical_names": f"WITH x AS (SELECT p_partkey, string_split(lower(p_name || ' ' || p_brand), ' ') AS x, string_split(lower(p_name), ' ') AS y FROM part) SELECT p_partkey, {_CANON} AS canonical, {_CANON.replace('x', 'y')} AS short FROM x",
    "address_normalize": f"SELECT c_custkey, {_address_sql()} AS address FROM customer",
    "value_normalize": "WITH x AS (SELECT p_partkey, string_split(regexp_replace(lower(p_name), '[.,-]', ' ', 'g'), ' ') AS n, string_split(trim(regexp_replace(lower(p_brand), '[.,-]', ' ', 'g')), ' ') AS b FROM part) SELECT p_partkey, n[1] || ' ' || b[-1] AS three, CASE WHEN len(b) > 1 THEN 'j ' || b[-1] ELSE b[1] END AS two, '1992-03-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') AS date FROM x",
    "date_functions": "SELECT o_orderkey, CAST(date_sub('year', CAST(o_orderdate AS DATE), DATE '2024-06-15') AS INT) AS age, strftime(o_orderdate, '%B %d, %Y') AS long_date, CAST(abs(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))) AS INT) AS days, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders",
    "string_functions": """SELECT c_custkey, regexp_replace(lower(c_name || ' <O''Hara> & Co'), '[^a-z0-9_]', '_', 'g') AS snake, replace(replace(replace(replace(c_name || ' <O''Hara> & Co', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&apos;') AS xml,
      '$' || format('{:,.2f}', c_acctbal) AS money, 0.0::DOUBLE AS not_a_number, sha256(c_name) AS sha, substr(c_mktsegment, 1, 5) AS preview,
      format('#{:02x}{:02x}{:02x}', CAST(floor(231 + (39 - 231) * ((c_custkey % 101) / 100.0::DOUBLE)) AS INT), CAST(floor(76 + (174 - 76) * ((c_custkey % 101) / 100.0::DOUBLE)) AS INT), CAST(floor(60 + (96 - 60) * ((c_custkey % 101) / 100.0::DOUBLE)) AS INT)) AS colour FROM customer""",
    "json_extract": "SELECT event_id, CASE WHEN event_id % 3 <> 2 AND json_valid(props) AND props LIKE '%{%}%' THEN regexp_extract(props, '(?s)(\\{.*\\})', 1) END AS found FROM events",
    "line_search": "WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), y AS (SELECT doc_id, ls, list_position(list_transform(ls, lambda l: contains(lower(l), 'the')), true) AS n FROM x) SELECT doc_id, CASE WHEN n > 0 THEN CAST(n AS INT) END AS line_number, CASE WHEN n > 0 THEN CAST(len(regexp_extract_all(array_to_string(ls[1:n-1], chr(10)) || chr(10), '\\n\\n+')) + 1 AS INT) END AS paragraph FROM y",
    "new_files_antijoin": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "group_texts": f"SELECT lang, count(*) AS texts, CAST(sum(length(text)) AS BIGINT) AS chars, count(DISTINCT text) AS distinct_texts FROM documents WHERE len({_WORDS}) > 0 GROUP BY lang",
    "aligned_values": f"""WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[ \\n\\t\\r\\x0B\\x0C]+'), lambda q: q <> '') AS ws FROM documents),
      v AS (SELECT doc_id, text, 'twentieth' AS key, lower(ws[20]) AS value FROM w WHERE len(ws) >= 20 UNION ALL SELECT doc_id, text, 'last', ws[-1] FROM w WHERE len(ws) > 0 UNION ALL SELECT doc_id, text, 'lacks', 'no such value' FROM w), {_PLACED}
      SELECT doc_id, key, line, CASE WHEN start IS NOT NULL THEN paragraph END AS paragraph, start, "end", string_split(text, chr(10))[line] AS source_line FROM z""",
    "aligned_facts": f"""WITH d AS (SELECT p_partkey % 50 AS doc_id, string_agg(p_name || ' of size No.' || p_size || ', ' || p_type, chr(10) || chr(10) ORDER BY p_partkey) AS text FROM part GROUP BY 1),
      v AS (SELECT p_partkey AS entity_id, key, value, p_name || ' ' || key || ': ' || value AS fact, text FROM (SELECT p_partkey, p_name, 'size' AS key, 'no.' || p_size || ',' AS value FROM part UNION ALL SELECT p_partkey, p_name, 'type', upper(p_type) FROM part) JOIN d ON doc_id = p_partkey % 50), {_PLACED}
      SELECT entity_id, key, fact, line, paragraph, start, "end", string_split(text, chr(10))[line] AS source_line FROM z""",
}
