"""The registered queries: each applies one operator to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, html_extract, lm_score, near_dedup, packing, quality_classifier, quality_rules, sharding, source_audit, substring_dedup, turn_repair, url_filter
from .common import materialize


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rules of the url query: host, path prefix, verdict.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_classifier.scored(docs, read(spark, sf_dir, "labels").select("doc_id", "quality"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.col("__kept_sha256").alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
p AS (SELECT doc_id, i, array_to_string(ws[i:i+34], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
t AS (SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY k) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM t),
k AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM w ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_score.scores(read(spark, sf_dir, "documents").select("doc_id", "text"))
    per_word = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(F.lit(0.0))
    return out.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round(per_word, 6).alias("log_score_per_word"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, len(ws) AS n, i, ws[i] AS w1,
        CASE WHEN i >= 2 THEN ws[i-1] END AS p1, CASE WHEN i >= 3 THEN ws[i-2] END AS p2
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
o AS (SELECT *,
  count(*) OVER (PARTITION BY w1) - count(*) OVER (PARTITION BY doc_id, w1) AS c1,
  count(*) OVER (PARTITION BY p1, w1) - count(*) OVER (PARTITION BY doc_id, p1, w1) AS c2,
  count(*) OVER (PARTITION BY p2, p1, w1) - count(*) OVER (PARTITION BY doc_id, p2, p1, w1) AS c3,
  count(*) OVER () - n AS others FROM w),
x AS (SELECT *, lag(c1) OVER (PARTITION BY doc_id ORDER BY i) AS v1, lag(c2) OVER (PARTITION BY doc_id ORDER BY i) AS v2 FROM o),
l AS (SELECT doc_id, CASE
    WHEN i >= 3 AND c3 > 0 THEN ln(c3 / v2)
    WHEN i >= 2 AND c2 > 0 THEN ln(c2 / v1) + CASE WHEN i >= 3 THEN ln(0.4) ELSE 0 END
    WHEN c1 > 0 THEN ln(c1 / others) + least(i - 1, 2) * ln(0.4)
    ELSE ln(1 / (others + 1)) + least(i - 1, 2) * ln(0.4) END AS s FROM x)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(coalesce(sum(s), 0), 4) AS log_score,
  round(CASE WHEN len(ws) > 0 THEN coalesce(sum(s), 0) / len(ws) ELSE 0 END, 6) AS log_score_per_word
FROM d LEFT JOIN l USING (doc_id) GROUP BY d.doc_id, ws
"""


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(rows.unionByName(more))).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


OP5_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(24 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS ss FROM w),
e AS (SELECT doc_id, len(ss) AS n, unnest(ss) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS k
      FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p WHERE 100 * k >= 85 * (nx + ny - k)),
r(doc, reach) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc, l.y FROM r JOIN l ON r.reach = l.x)
SELECT s.doc_id, CAST(len(ss) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT doc, min(reach) AS component_id FROM r GROUP BY doc) c ON c.doc = s.doc_id
"""


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.match_rules(read(spark, sf_dir, "pages").select("page_id", "url"), rules)


OP7_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rh, rp, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block'))
SELECT page_id, host, path,
  (SELECT max_by(rh || rp, length(rh || rp)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule,
  coalesce((SELECT max_by(v, length(rh || rp)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)), 'allow') AS verdict
FROM h
"""


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    out = quality_rules.verdicts(docs, labels)
    return out.select("doc_id", "__m.n_words", "__m.word_chars", "__m.n_symbols", "__m.n_dup_lines", "__m.n_repeat_words", F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


#: A cutoff at step i is valid if at most k of n good rows are over it, with P(X <= k) <= error at the allowed risk: the exact bound turned round.
OP8_SQL = r"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
l AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM l)),
t AS (SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) FROM t) GROUP BY doc_id),
m AS (
  SELECT l.doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(ls) AS n_lines,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(replace(t, '!', '')) AS n_marks
  FROM l LEFT JOIN r USING (doc_id)),
b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    floor(100 * greatest(n_symbols::DOUBLE / greatest(word_chars, 1)::DOUBLE / 0.1::DOUBLE, n_marks::DOUBLE / greatest(n_words, 1)::DOUBLE / 0.5::DOUBLE,
      n_upper::DOUBLE / greatest(word_chars, 1)::DOUBLE / 0.8::DOUBLE, n_dup_lines::DOUBLE / greatest(n_lines, 1)::DOUBLE / 0.6::DOUBLE,
      n_repeat_words::DOUBLE / greatest(n_words, 1)::DOUBLE / 0.3::DOUBLE)) AS badness FROM m),
y AS (SELECT doc_id, avg(quality) >= 0.5 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
s AS (SELECT lang, least(badness, 200) AS step, good FROM b JOIN y USING (doc_id) WHERE NOT base_failed),
n AS (SELECT lang, count(*) FILTER (good) AS n, 0.05::DOUBLE / count(*) OVER () AS error FROM s GROUP BY lang HAVING count(*) FILTER (good) >= 598),
c AS (
  SELECT n.lang, any_value(n.n) AS n, any_value(error) AS error, g.i, count(*) FILTER (good AND step >= g.i) AS k, count(*) FILTER (NOT good AND step >= g.i) AS caught
  FROM n JOIN s ON s.lang IS NOT DISTINCT FROM n.lang CROSS JOIN (SELECT unnest(range(1, 201)) AS i) g GROUP BY n.lang, g.i),
v AS (
  SELECT *, arg_min(caught, i) OVER (PARTITION BY lang) AS most FROM c WHERE k <= 0.005::DOUBLE * n AND error >= list_sum(list_transform(range(0, k + 1),
    lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.005::DOUBLE) + (n - j) * ln(1 - 0.005::DOUBLE))))),
o AS (SELECT lang, max(i) AS cut FROM v WHERE most > 0 AND caught >= 0.99::DOUBLE * most GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(badness >= cut, false) AS kept
FROM b LEFT JOIN o ON b.lang IS NOT DISTINCT FROM o.lang
"""


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(read(spark, sf_dir, "documents").select("doc_id", "text"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark")
    out = decontaminate.with_hits(docs, items)
    return out.select("doc_id", "__c.n_words", "__c.n_hit", F.size("__c.items").cast("long").alias("n_items"), F.sha2(F.array_join("__c.items", ","), 256).alias("items_sha256"), (F.col("__c.n_hit") > 0).alias("contaminated"), F.col("__c.longest").alias("longest_match"), F.col("__c.longest_at").alias("longest_at"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (
  SELECT row_number() OVER () AS nr, coalesce(CAST(item_id AS VARCHAR), '') AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
i AS (SELECT nr, item, width, q, array_to_string(ws[q:q+width-1], ' ') AS k FROM (SELECT *, unnest(range(1, len(ws) - width + 2)) AS q FROM (SELECT *, least(10, len(ws)) AS width FROM b WHERE len(ws) > 0))),
t AS (SELECT doc_id, width, p, array_to_string(ws[p:p+width-1], ' ') AS k FROM (SELECT doc_id, ws, width, unnest(range(1, len(ws) - width + 2)) AS p FROM d, (SELECT DISTINCT width FROM i))),
m AS (SELECT doc_id, p, nr, item, q, i.width FROM t JOIN i ON t.width = i.width AND t.k = i.k),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + width)) FROM m) GROUP BY doc_id),
o AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id),
g AS (SELECT doc_id, p, width, nr, q - p AS diagonal, p - row_number() OVER (PARTITION BY doc_id, nr, q - p ORDER BY p) AS island FROM m),
e AS (SELECT doc_id, count(*) + any_value(width) - 1 AS long, min(p) - 1 AS begins FROM g GROUP BY doc_id, nr, diagonal, island),
x AS (SELECT doc_id, max(long) AS long, arg_max(begins, struct_pack(l := long, b := -begins)) AS begins FROM e GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, coalesce(long, 0) AS longest_match, coalesce(begins, 0) AS longest_at
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN o USING (doc_id) LEFT JOIN x USING (doc_id)
"""


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hurt = turn_repair.damaged(rows)
    planned = materialize(turn_repair.plans(hurt, rows), "repair-plans")
    found = turn_repair.digests(turn_repair.repaired(hurt, planned)).withColumnRenamed("conv_id", "id")
    sha = F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return planned.join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", sha)


OP11_SQL = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
x AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda y: ord(y)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384)))) % 20 AS d FROM c),
t AS (
  SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE d WHEN 3 THEN 2 ELSE 1 END)) FROM x WHERE d <> 0),
m AS (SELECT *, md5(length(role) || ':' || role || text) AS mark, right(rtrim(text, E' \t\n\x0b\x0c\r'), 1) AS last FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, mark ORDER BY turn NULLS FIRST) AS again FROM m),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, mark, again) AS i,
    CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '-' END AS r FROM k),
f AS (
  SELECT *, CASE WHEN last = '' THEN 1 WHEN again > 1 THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair FROM o),
n AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
-- moves: from state (0 nothing, 1 system, 2 user, 3 assistant), inserts before a row, edit, state after it
s AS (SELECT unnest([0, 1, 2, 3]) AS q),
i AS (SELECT q, k, CASE WHEN k = 0 THEN q WHEN (q = 2) = (k = 1) THEN 3 ELSE 2 END AS q2 FROM s, (SELECT unnest([0, 1, 2]) AS k)),
v AS (
  SELECT q, repeat('I', k) || 'D' AS tail, 2 * k + 3 AS cost, q2 AS q3, NULL AS r, true AS lost FROM i
  UNION ALL SELECT q, repeat('I', k) || 'R', 2 * k + 2, CASE q2 WHEN 2 THEN 3 ELSE 2 END, NULL, false FROM i
  UNION ALL SELECT q, repeat('I', k) || 'K', 2 * k, CASE q2 WHEN 2 THEN 3 ELSE 2 END, CASE q2 WHEN 2 THEN 'a' ELSE 'u' END, false FROM i
  UNION ALL SELECT q, repeat('I', k) || 'K', 2 * k, 1, 's', false FROM i WHERE q2 = 0),
a(conv_id, i, q, cost, audit) AS (
  SELECT conv_id, 0::BIGINT, 0, 0::BIGINT, '' FROM n
  UNION ALL
  SELECT conv_id, i, q, cost, audit FROM (
    SELECT a.conv_id, f.i, v.q3 AS q, a.cost + v.cost + CASE WHEN f.fault = 3 AND NOT v.lost THEN 1 ELSE 0 END AS cost, a.audit || v.tail AS audit,
      row_number() OVER (PARTITION BY a.conv_id, v.q3 ORDER BY a.cost + v.cost + CASE WHEN f.fault = 3 AND NOT v.lost THEN 1 ELSE 0 END, a.audit || v.tail) AS rank
    FROM a JOIN f ON a.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = a.i + 1 JOIN v ON v.q = a.q AND (v.r IS NULL OR v.r = f.r) AND (v.lost OR f.fault IN (0, 3)))
  WHERE rank = 1),
e AS (
  SELECT a.conv_id, cost + 2 * CASE q WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS cost, audit || repeat('I', CASE q WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END) AS audit
  FROM a JOIN n ON a.conv_id IS NOT DISTINCT FROM n.conv_id AND a.i = n.n),
b AS (SELECT conv_id, cost, audit FROM e QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1),
-- carrying them out: each initial's place among those that leave a row, and the row it is about
u AS (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS p FROM b),
w AS (
  SELECT conv_id, p, audit[p] AS edit, count(*) FILTER (audit[p] <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i, count(*) FILTER (audit[p] <> 'D') OVER (PARTITION BY conv_id ORDER BY p) AS place FROM u),
g AS (
  SELECT w.conv_id, p, edit, place, CASE WHEN edit = 'I' THEN '' ELSE f.text END AS text, f.role, max(CASE WHEN edit = 'K' AND f.r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY w.conv_id) AS led
  FROM w LEFT JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.i = f.i),
h AS (
  SELECT conv_id, sha256(string_agg((CASE WHEN edit = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY p)) AS sha FROM g WHERE edit <> 'D' GROUP BY conv_id)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN n ON d.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN b ON d.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN h ON d.conv_id IS NOT DISTINCT FROM h.conv_id
"""


def op12_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    # a url that ends in a doc_id names the document its page was made of
    made_of = pages.select("html", F.expr(r"try_cast(regexp_extract(url, '/([0-9]+)([?#].*)?$', 1) AS long)").alias("doc_id"))
    known = html_extract.labelled(made_of, "doc_id", read(spark, sf_dir, "documents"), "doc_id")
    model = html_extract.fit([*html_extract.layouts(), *known])
    return html_extract.extract(pages, model, "text").withColumn("n_chars", F.length("text").cast("long"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(read(spark, sf_dir, "documents").select("lang", "source", "text"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS nr, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT nr, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT nr) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
s AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(sum(n), 0) AS n FROM g LEFT JOIN v USING (lang) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (s.n + v) AS p
  FROM s JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
l AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n) + 1) // (any_value(total) + any_value(v)) AS q
  FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS total FROM c GROUP BY lang) USING (lang) GROUP BY lang, term),
o AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM o QUALIFY part = 'pair' OR rank <= 200
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_substring_dedup, op3_lm_score, op4_packing, op5_chat_format, op6_near_dedup, op7_url_filter, op8_quality_rules, op9_sharding, op10_decontaminate, op11_turn_repair, op12_html_extract, op13_source_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": OP2_SQL, "op3_lm_score": OP3_SQL, "op5_chat_format": OP5_SQL, "op6_near_dedup": OP6_SQL, "op7_url_filter": OP7_SQL, "op8_quality_rules": OP8_SQL, "op10_decontaminate": OP10_SQL, "op11_turn_repair": OP11_SQL, "op13_source_audit": OP13_SQL}
