"""Claim queries over the order tables, and their SQL.

A claim is a line item; its patient is the order's customer, its payer the
customer's nation, its date the ship date. Money is counted in whole units of
1e-4 and divided once, so sums don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import claims as C


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patient, order_id, line, date, kind, billed_u, covered_u, billed, covered, owes, status."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate", "l_suppkey", "l_partkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    billed = (F.round(F.col("l_extendedprice") * 100) * 100).cast("long")
    off = F.round(F.col("l_discount") * 100).cast("long")
    covered = F.when(F.col("l_returnflag") == "R", F.lit(0).cast("long")).when(F.col("l_returnflag") == "A", F.expr("__b div 100") * F.col("__o") * 4).otherwise(F.expr("__b div 100") * (100 - F.col("__o")))
    rows = items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).withColumn("__b", billed).withColumn("__o", off).withColumn("covered_u", covered)
    dollars = lambda c: c / F.lit(10000.0)
    rows = rows.select(
        F.col("o_custkey").alias("patient"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.to_date("l_shipdate").alias("date"), F.col("l_returnflag").alias("kind"), F.col("l_suppkey").alias("provider"), F.col("l_partkey").alias("part"), F.col("__b").alias("billed_u"), "covered_u",
        dollars(F.col("__b")).alias("billed"), dollars(F.col("covered_u")).alias("covered"), dollars(F.col("__b") - F.col("covered_u")).alias("owes"),
    )
    return rows.withColumn("status", C.claim_status(F.col("billed"), F.col("covered")))


#: What tells claims of one patient and date apart, in order; and the order of the newest first, then by these.
TIES = ["order_id", "line", "billed_u", "covered_u", "part"]


def newest() -> list[Column]:
    return [F.col("date").desc(), *[F.col(c) for c in TIES]]


ENCOUNTERS = """
e0 AS (
  SELECT o_custkey AS patient, l_orderkey AS order_id, l_linenumber AS line, CAST(l_shipdate AS DATE) AS date, l_returnflag AS kind, l_suppkey AS provider, l_partkey AS part,
    CAST(round(l_extendedprice * 100) * 100 AS BIGINT) AS billed_u, CAST(round(l_discount * 100) AS BIGINT) AS off
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
e1 AS (SELECT *, CASE kind WHEN 'R' THEN 0 WHEN 'A' THEN billed_u // 100 * off * 4 ELSE billed_u // 100 * (100 - off) END AS covered_u FROM e0),
e2 AS (SELECT *, billed_u / 10000.0::DOUBLE AS billed, covered_u / 10000.0::DOUBLE AS covered, (billed_u - covered_u) / 10000.0::DOUBLE AS owes FROM e1),
e AS (SELECT *, CASE WHEN billed = 0 THEN 'PAID' WHEN covered / billed >= 0.95::DOUBLE THEN 'PAID' WHEN covered = 0 AND billed > 100 THEN 'DENIED_NO_PA'
  WHEN covered > 0 AND covered / billed < 0.5 AND billed > 300 THEN 'PENDING_P2P' ELSE 'PARTIAL' END AS status FROM e2)
"""
SUMMARY = """
s AS (SELECT patient, CAST(sum(billed_u) AS BIGINT) / 10000.0::DOUBLE AS total_billed, CAST(sum(covered_u) AS BIGINT) / 10000.0::DOUBLE AS total_covered,
  CAST(sum(billed_u - covered_u) AS BIGINT) / 10000.0::DOUBLE AS total_owed, count(*) FILTER (status = 'DENIED_NO_PA') AS denied_claims,
  count(*) FILTER (status = 'PENDING_P2P') AS pending_claims, count(*) AS claims,
  CAST(coalesce(sum(billed_u) FILTER (status = 'DENIED_NO_PA'), 0) AS BIGINT) / 10000.0::DOUBLE AS denied_total, count(*) FILTER (status = 'PARTIAL') AS partial_claims
  FROM e GROUP BY patient)
"""
PRIORITY = "CASE status WHEN 'DENIED_NO_PA' THEN 0 WHEN 'PENDING_P2P' THEN 1 WHEN 'PARTIAL' THEN 2 ELSE 3 END"
WORST = f"w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY {PRIORITY}, date, order_id, line, billed_u, covered_u, part) AS rn FROM e) WHERE rn = 1)"
PEOPLE = "p AS (SELECT c_custkey AS patient, c_name AS name, n_name AS payer FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)"


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries in whole units first, then in dollars; with denied_total and partial_claims."""
    e = encounters(spark, sf_dir)
    units = e.withColumns({"billed": F.col("billed_u"), "covered": F.col("covered_u")})
    sums = C.summaries(units)
    more = e.groupBy("patient").agg((F.coalesce(F.sum(F.when(F.col("status") == "DENIED_NO_PA", F.col("billed_u"))), F.lit(0)) / 10000.0).alias("denied_total"), F.count_if(F.col("status") == "PARTIAL").alias("partial_claims"))
    dollars = {c: F.col(c) / 10000.0 for c in ("total_billed", "total_covered", "total_owed")}
    return sums.withColumns(dollars).join(more, "patient")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patient, name, payer: the nation table is a small dimension, joined as its size allows."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").select(F.col("c_custkey").alias("patient"), F.col("c_name").alias("name"), F.coalesce("n_name", F.lit("NO_INSURANCE")).alias("payer"))


def claim_status_derive(spark, sf_dir):
    return encounters(spark, sf_dir).select("order_id", "line", "billed", "covered", "status")


def claim_summary(spark, sf_dir):
    return totals(spark, sf_dir).select("patient", "total_billed", "total_covered", "total_owed", "denied_claims", "pending_claims", "claims")


def claim_worst_per_patient(spark, sf_dir):
    return C.worst_claims(encounters(spark, sf_dir), TIES).select("patient", "status", "date", "order_id", "line", "billed", "covered", "owes")


def _worst_and_counts(spark, sf_dir, columns: list[str]) -> DataFrame:
    """Each patient's worst claim with denied_claims and total_billed of all, in one pass over the claims."""
    both = encounters(spark, sf_dir).groupBy("patient").agg(C.worst_claim(columns, TIES).alias("top"), F.count_if(F.col("status") == "DENIED_NO_PA").alias("denied_claims"), (F.sum("billed_u") / 10000.0).alias("total_billed"))
    return both.select("patient", "top.*", "denied_claims", "total_billed")


def claim_status_per_patient(spark, sf_dir):
    """The flagship: each patient's worst claim next to the summary of all claims."""
    worst = _worst_and_counts(spark, sf_dir, ["status", "date", "billed", "covered", "owes"])
    return worst.withColumnsRenamed({"status": "top_status", "date": "top_date"})


def claim_status_answer(spark, sf_dir):
    e = encounters(spark, sf_dir)
    worst = _worst_and_counts(spark, sf_dir, [c for c in e.columns if c != "patient"]).drop("total_billed")
    rows = worst.withColumn("description", F.concat(F.lit("procedure "), F.col("part").cast("string"))).join(people(spark, sf_dir), "patient")
    return rows.select("patient", C.status_answer().alias("answer"))


def cost_estimate(spark, sf_dir):
    rows = totals(spark, sf_dir).join(people(spark, sf_dir), "patient")
    cover = C.paid_coverage(encounters(spark, sf_dir), "patient")
    return rows.join(cover, "patient", "left").select("patient", C.cost_answer().alias("answer"), F.coalesce(F.round(F.col("coverage") * 100, 3), F.lit(0.0)).alias("coverage_pct"))


def bill_explanation(spark, sf_dir):
    return totals(spark, sf_dir).join(people(spark, sf_dir), "patient").select("patient", C.bill_answer().alias("answer"))


def pre_procedure_prep(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("description"), F.col("p_type").alias("reason"))
    last = C.latest(encounters(spark, sf_dir), "patient", newest())
    kinds = F.when(F.col("kind") == "R", "emergency").otherwise("wellness")
    rows = last.join(parts, "part").join(people(spark, sf_dir), "patient").withColumn("encounter_type", kinds)
    return rows.select("patient", C.prep_answer().alias("answer"))


def coverage_pct(spark, sf_dir):
    return C.paid_coverage(encounters(spark, sf_dir)).select(F.round(F.col("coverage") * 100, 6).alias("coverage_pct"))


def encounter_latest(spark, sf_dir):
    return C.latest(encounters(spark, sf_dir), "patient", newest()).select("patient", "date", "order_id", "line")


def encounter_top20(spark, sf_dir):
    return C.latest(encounters(spark, sf_dir), "patient", newest(), C.NEWEST_ENCOUNTERS).select("patient", "rank", "order_id", "line")


def transitions(spark, sf_dir) -> DataFrame:
    """patient, payer, start_year, end_year: an order is a change of payer; an open order has no end."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    year = F.year("o_orderdate")
    return o.select(F.col("o_custkey").alias("patient"), F.col("o_orderpriority").alias("payer"), year.alias("start_year"), F.when(F.col("o_orderstatus") != "O", year + 1).alias("end_year"), F.col("o_orderkey").alias("order_id"))


TRANSITIONS = "t AS (SELECT o_custkey AS patient, o_orderpriority AS payer, CAST(year(o_orderdate) AS INT) AS start_year, CASE WHEN o_orderstatus <> 'O' THEN CAST(year(o_orderdate) + 1 AS INT) END AS end_year, o_orderkey AS order_id FROM orders)"


def payer_current(spark, sf_dir):
    found = C.current_payers(transitions(spark, sf_dir), tie="order_id")
    return found.join(people(spark, sf_dir).select("patient", F.col("payer").alias("plan")), "patient", "left").select("patient", "payer", "start_year", "end_year", "plan")


def conditions(spark, sf_dir) -> DataFrame:
    """patient, code, description, onset, stop: a returned item is a condition that has stopped."""
    e = encounters(spark, sf_dir)
    return e.select("patient", (F.col("part") % 50).cast("string").alias("code"), F.concat(F.lit("condition "), F.col("part").cast("string")).alias("description"), F.col("date").alias("onset"), F.when(F.col("kind") == "R", F.col("date").cast("string")).otherwise(" ").alias("stop"))


def condition_dedup(spark, sf_dir):
    return C.active_conditions(conditions(spark, sf_dir), ["onset", "description"]).select("patient", "code", "description", "onset")


def patient_record_flat(spark, sf_dir):
    """The nested record per patient, its encounters flattened again."""
    e = encounters(spark, sf_dir).select("patient", "date", *TIES, "billed", "covered", "owes", "status")
    t = transitions(spark, sf_dir).select("patient", "payer", "start_year", "end_year", F.col("order_id"))
    latest_first = C.current_payers(t, tie="order_id").drop("order_id")
    record = C.patient_records(people(spark, sf_dir).select("patient", "name"), e, conditions(spark, sf_dir), latest_first, TIES)
    flat = record.select("patient", "name", F.col("insurance.payer").alias("payer"), F.coalesce(F.size("active_conditions"), F.lit(0)).alias("n_conditions"), F.col("claim_summary.denied_claims").alias("denied_claims"), F.posexplode_outer("encounters").alias("pos", "e"))
    return flat.select("patient", "name", "payer", F.when(F.col("n_conditions") < 0, 0).otherwise(F.col("n_conditions")).alias("n_conditions"), "denied_claims", "pos", F.col("e.order_id").alias("order_id"), F.col("e.line").alias("line"), F.col("e.status").alias("status"))


def manifest_totals(spark, sf_dir):
    t = totals(spark, sf_dir)
    return t.agg(F.count(F.lit(1)).alias("patients"), F.sum("claims").alias("encounters"), F.sum("denied_claims").alias("denied"), F.sum("pending_claims").alias("pending"))


def status_rollup(spark, sf_dir):
    """An extension: claims by status and kind with subtotals."""
    return encounters(spark, sf_dir).rollup("status", "kind").agg(F.count(F.lit(1)).alias("claims"), (F.sum("billed_u") / 10000.0).alias("billed")).select(F.coalesce("status", F.lit("ALL")).alias("status"), F.coalesce("kind", F.lit("ALL")).alias("kind"), "claims", "billed")


def provider_names(spark, sf_dir):
    from tessera.functions import text as tx

    s = read(spark, sf_dir, "supplier")
    return s.select("s_suppkey", tx.provider_name(F.concat(F.col("s_name"), F.lit(" x "), F.col("s_nationkey").cast("string"), F.lit("lee7"))).alias("provider"))


QUERIES = {f.__name__: f for f in (claim_status_derive, claim_summary, claim_worst_per_patient, claim_status_per_patient, claim_status_answer, cost_estimate, bill_explanation, pre_procedure_prep, coverage_pct, encounter_latest, encounter_top20, payer_current, condition_dedup, patient_record_flat, manifest_totals, status_rollup, provider_names)}


def _money(x: str) -> str:
    return f"'$' || format('{{:,.2f}}', {x})"


def _case(keywords: dict[str, list[str]], c: str, default: str) -> str:
    whens = " ".join(f"WHEN {' OR '.join(f'contains({c}, ' + chr(39) + k.replace(chr(39), chr(39) * 2) + chr(39) + ')' for k in ks)} THEN '{n}'" for n, ks in keywords.items())
    return f"CASE {whens} ELSE {default} END"


def _prep_case() -> str:
    from tessera.functions import rules

    kind = _case(rules.PREP_KEYWORDS, "lower(description || ' ' || reason)", "CASE WHEN encounter_type = 'emergency' THEN 'surgery' ELSE 'default' END")
    texts = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.PREP.items())
    return f"CASE {kind} {texts} END"


_OPENING = "name || ', your procedure ' || part || ' claim from ' || CAST(date AS VARCHAR)"
ORACLES = {
    "claim_status_derive": f"WITH {ENCOUNTERS} SELECT order_id, line, billed, covered, status FROM e",
    "claim_summary": f"WITH {ENCOUNTERS}, {SUMMARY} SELECT patient, total_billed, total_covered, total_owed, denied_claims, pending_claims, claims FROM s",
    "claim_worst_per_patient": f"WITH {ENCOUNTERS}, {WORST} SELECT patient, status, date, order_id, line, billed, covered, owes FROM w",
    "claim_status_per_patient": f"WITH {ENCOUNTERS}, {SUMMARY}, {WORST} SELECT patient, status AS top_status, date AS top_date, billed, covered, owes, denied_claims, total_billed FROM w JOIN s USING (patient)",
    "claim_status_answer": f"""WITH {ENCOUNTERS}, {SUMMARY}, {WORST}, {PEOPLE} SELECT patient, CASE status
      WHEN 'DENIED_NO_PA' THEN {_OPENING} || ' was denied — prior authorization not obtained. Billed: ' || {_money('billed')} || ', covered: $0. To appeal: your care team submits a prior auth request to ' || payer || '. If denied again, your doctor can request a Peer-to-Peer review.' || CASE WHEN denied_claims > 1 THEN ' You have ' || denied_claims || ' total denied claims.' ELSE '' END
      WHEN 'PENDING_P2P' THEN {_OPENING} || ' is pending a Peer-to-Peer review with ' || payer || '. Your doctor needs to speak with the insurer''s medical director. Billed: ' || {_money('billed')} || ', potentially covered: ' || {_money('covered')} || '. Typically resolves in 3-5 business days.'
      WHEN 'PARTIAL' THEN {_OPENING} || ' was partially covered. ' || payer || ' paid ' || {_money('covered')} || ' of ' || {_money('billed')} || '. Your balance: ' || {_money('owes')} || '.'
      ELSE name || ', your most recent claim for procedure ' || part || ' on ' || CAST(date AS VARCHAR) || ' was fully processed. ' || payer || ' covered ' || {_money('covered')} || ' of the ' || {_money('billed')} || ' billed. ' || CASE WHEN denied_claims > 0 THEN ' However, you do have ' || denied_claims || ' other denied claim' || CASE WHEN denied_claims > 1 THEN 's' ELSE '' END || ' on your account that may need attention.' ELSE 'All your recent claims appear to be in order.' END
      END AS answer FROM w JOIN s USING (patient) JOIN p USING (patient)""",
    "cost_estimate": f"""WITH {ENCOUNTERS}, {SUMMARY}, {PEOPLE}, a AS (SELECT patient, avg(covered / billed) AS coverage FROM e WHERE status = 'PAID' AND billed > 0 GROUP BY patient)
      SELECT patient, CASE WHEN total_billed = 0 THEN 'No billing history on file. Contact our billing department directly.' ELSE name || ', billing summary with ' || payer || ': total billed ' || {_money('total_billed')} || ', covered ' || {_money('total_covered')} || ', your responsibility ' || {_money('total_owed')} || '.' || CASE WHEN denied_claims > 0 THEN ' ' || denied_claims || ' denied claim' || CASE WHEN denied_claims > 1 THEN 's' ELSE '' END || ' may be adding to your balance — our billing team can review.' ELSE '' END || ' For a procedure-specific estimate, call our financial counselors.' END AS answer,
      coalesce(round(coverage * 100, 3), 0) AS coverage_pct FROM s JOIN p USING (patient) LEFT JOIN a USING (patient)""",
    "bill_explanation": f"""WITH {ENCOUNTERS}, {SUMMARY}, {PEOPLE} SELECT patient, CASE WHEN total_owed = 0 AND total_billed = 0 THEN 'No outstanding billing records found. Call billing with your bill reference number.' ELSE
      name || ', your bill: ' || {_money('total_billed')} || ' billed, ' || payer || ' paid ' || {_money('total_covered')} || ', you owe ' || {_money('total_owed')} || '. ' || CASE WHEN denied_claims > 0 THEN {_money('denied_total')} || ' from ' || denied_claims || ' denied claim' || CASE WHEN denied_claims > 1 THEN 's' ELSE '' END || ' — prior auth not obtained. You can appeal these. ' ELSE '' END
      || CASE WHEN partial_claims > 0 THEN 'Remaining balance is your deductible/coinsurance share under your ' || payer || ' plan. ' ELSE '' END
      || CASE WHEN total_owed > 500 THEN 'We offer payment plans — contact billing to set one up.' ELSE 'You can pay your balance of ' || {_money('total_owed')} || ' online at our patient portal, by phone, or in person at the billing office.' END END AS answer FROM s JOIN p USING (patient)""",
    "pre_procedure_prep": f"""WITH {ENCOUNTERS}, {PEOPLE}, l AS (SELECT *, CASE WHEN kind = 'R' THEN 'emergency' ELSE 'wellness' END AS encounter_type FROM (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY date DESC, order_id, line, billed_u, covered_u, part) AS rn FROM e) WHERE rn = 1),
      d AS (SELECT p_partkey AS part, p_name AS description, p_type AS reason FROM part)
      SELECT patient, name || ', for your ' || description || ' on ' || CAST(date AS VARCHAR) || ': ' || {_prep_case()} AS answer FROM l JOIN d USING (part) JOIN p USING (patient)""",
    "coverage_pct": f"WITH {ENCOUNTERS} SELECT round(avg(covered / billed) * 100, 6) AS coverage_pct FROM e WHERE status = 'PAID' AND billed > 0",
    "encounter_latest": f"WITH {ENCOUNTERS} SELECT patient, date, order_id, line FROM (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY date DESC, order_id, line, billed_u, covered_u, part) AS rn FROM e) WHERE rn = 1",
    "encounter_top20": f"WITH {ENCOUNTERS} SELECT patient, CAST(rn AS INT) AS rank, order_id, line FROM (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY date DESC, order_id, line, billed_u, covered_u, part) AS rn FROM e) WHERE rn <= 20",
    "payer_current": f"WITH {TRANSITIONS}, {PEOPLE}, c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY coalesce(end_year, 9999) DESC, order_id) AS rn FROM t) WHERE rn = 1) SELECT c.patient, c.payer, start_year, end_year, p.payer AS plan FROM c LEFT JOIN p ON p.patient = c.patient",
    "condition_dedup": f"WITH {ENCOUNTERS} SELECT patient, code, description, onset FROM (SELECT patient, CAST(part % 50 AS VARCHAR) AS code, 'condition ' || part AS description, date AS onset, row_number() OVER (PARTITION BY patient, part % 50 ORDER BY date, 'condition ' || part) AS rn FROM e WHERE kind <> 'R') WHERE rn = 1",
    "patient_record_flat": f"""WITH {ENCOUNTERS}, {SUMMARY}, {PEOPLE}, {TRANSITIONS}, n AS (SELECT patient, CAST(rn - 1 AS INT) AS pos, order_id, line, status FROM (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY date DESC, order_id, line, billed_u, covered_u, part) AS rn FROM e) WHERE rn <= 20),
      c AS (SELECT patient, CAST(count(DISTINCT part % 50) AS INT) AS n_conditions FROM e WHERE kind <> 'R' GROUP BY patient), i AS (SELECT patient, payer FROM (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY coalesce(end_year, 9999) DESC, order_id) AS rn FROM t) WHERE rn = 1)
      SELECT p.patient, p.name, i.payer, coalesce(n_conditions, 0) AS n_conditions, denied_claims, pos, order_id, line, status FROM p LEFT JOIN i USING (patient) LEFT JOIN c USING (patient) LEFT JOIN s USING (patient) LEFT JOIN n USING (patient)""",
    "manifest_totals": f"WITH {ENCOUNTERS}, {SUMMARY} SELECT count(*) AS patients, CAST(sum(claims) AS BIGINT) AS encounters, CAST(sum(denied_claims) AS BIGINT) AS denied, CAST(sum(pending_claims) AS BIGINT) AS pending FROM s",
    "status_rollup": f"WITH {ENCOUNTERS} SELECT coalesce(status, 'ALL') AS status, coalesce(kind, 'ALL') AS kind, count(*) AS claims, CAST(sum(billed_u) AS BIGINT) / 10000.0::DOUBLE AS billed FROM e GROUP BY ROLLUP (status, kind)",
    "provider_names": "SELECT s_suppkey, 'Dr. ' || array_to_string(list_transform(list_filter(string_split_regex(regexp_replace(s_name || ' x ' || s_nationkey || 'lee7', '[0-9]+', '', 'g'), '[ ]+'), lambda w: length(w) > 1), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS provider FROM supplier",
}
