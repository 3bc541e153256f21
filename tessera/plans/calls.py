"""Conversation and event-stream queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import rules
from tessera.operators import temporal as T
from tessera.streaming import conversation as V

from .claims import _case, read


def _turns(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").filter("role = 'user'")
    return c.select(F.col("conv_id").alias("call_id"), "turn", "text")


def intent_classify(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    return _turns(spark, sf_dir).select("call_id", "turn", rules.intent(text).alias("intent"), rules.is_goodbye(text).alias("goodbye"), rules.is_open_ended(text).alias("open_ended"))


def _replies(spark, sf_dir, asks_about=""):
    """Every caller is known by the name that they say first; some calls ask about a claim later."""
    later = F.when((F.col("call_id") % 3 == 0) & (F.col("turn") >= 2), asks_about).otherwise("")
    turns = _turns(spark, sf_dir).withColumn("text", F.concat("text", later))
    return V.replay(turns.withColumns({"match_type": F.lit("answer"), "person": F.lower("text")}))


def call_state_machine(spark, sf_dir):
    return _replies(spark, sf_dir).select("call_id", "turn", "state", "end_call", "event")


def call_phases(spark, sf_dir):
    return V.phase_events(_replies(spark, sf_dir, " Why was my claim denied?")).select("call_id", "second", "event", "intent")


def call_routing(spark, sf_dir):
    turns = _turns(spark, sf_dir).withColumn("person", (F.col("call_id") % 10).cast("string"))
    reports = spark.range(5).select(F.col("id").cast("string").alias("person"), F.lit("pre_procedure").alias("intent"), F.concat(F.lit("report "), F.col("id").cast("string")).alias("answer"))
    return V.routed(turns, reports).select("call_id", "turn", "intent", "answer")


def call_enrichment(spark, sf_dir):
    """Turns with the claims, payers and conflicts of their callers, some of whom each table doesn't know."""
    turns = _turns(spark, sf_dir).withColumn("person", F.col("call_id") % 12)
    o, c, n = (read(spark, sf_dir, t) for t in ("orders", "customer", "supplier"))
    claims = o.select((F.col("o_custkey") % 12).alias("person"), F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("claim")).filter("person < 10")
    payers = c.select((F.col("c_custkey") % 12).alias("person"), F.col("c_mktsegment").alias("payer")).filter("person > 3")
    conflicts = n.select((F.col("s_nationkey") % 12).alias("person"), F.lit("name").alias("attribute_key")).filter("person % 2 = 0")
    return V.enriched(turns, claims, payers, conflicts).select("call_id", "turn", "claim", "payer", "n_conflicts", "known")


def menu_responses(spark, sf_dir):
    c = _turns(spark, sf_dir)
    return c.select("call_id", "turn", rules.menu_response((F.col("turn") % 5).cast("string")).alias("response"))


def answer_status(spark, sf_dir):
    c = _turns(spark, sf_dir)
    said = F.when(F.col("turn") % 3 == 0, "the claim is PENDING_P2P").when(F.col("turn") % 3 == 1, "it was fully processed").otherwise("no idea")
    return c.select("call_id", "turn", rules.answer_status(said).alias("status"), rules.reply_label(F.when(F.col("turn") % 2 == 0, " passport ").otherwise("It is an INSURANCE form")).alias("label"))


def event_windows(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("ts", "event_type", F.floor(F.col("value") * 100).alias("value"))
    return T.event_windows(e, "ts", "1 hour", ["event_type"]).select("start", "event_type", "n", F.col("total").cast("long").alias("total"))


def event_sessions(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("ts", "user_id", "event_id")
    return T.sessions(e, "ts", "user_id", 3600).select("user_id", F.col("session").cast("long").alias("session"), "first", "last", "n")


QUERIES = {f.__name__: f for f in (intent_classify, call_state_machine, call_phases, call_routing, call_enrichment, menu_responses, answer_status, event_windows, event_sessions)}

TURNS = "t AS (SELECT conv_id AS call_id, turn, text FROM conversations WHERE role = 'user')"
CLAIMS = "t AS (SELECT conv_id AS call_id, turn, text || CASE WHEN conv_id % 3 = 0 AND turn >= 2 THEN ' Why was my claim denied?' ELSE '' END AS text FROM conversations WHERE role = 'user')"
_GOODBYE = "(" + " OR ".join(f"contains(lower(text), '{k.replace(chr(39), chr(39) * 2)}')" for k in rules.GOODBYE_KEYWORDS) + ")"
_INTENT = _case(rules.INTENT_KEYWORDS, "lower(text)", "'general'")
FOLD = f"""i AS (SELECT *, {_GOODBYE} AS bye, {_INTENT} AS intent, len(list_filter(string_split_regex(lower(text), '[ \\n\\t\\r]+'), lambda w: length(w) > 1)) >= 2 AS full_name FROM t),
  v AS (SELECT call_id, min(turn) FILTER (full_name AND NOT bye) AS v FROM i GROUP BY call_id),
  e AS (SELECT call_id, min(turn) FILTER (bye OR (turn > v AND intent IN ('claim_status', 'cost_estimate'))) AS e FROM i JOIN v USING (call_id) GROUP BY call_id),
  m AS (SELECT * FROM i JOIN v USING (call_id) JOIN e USING (call_id))"""
_EVENT = "CASE WHEN turn > e THEN 'ignored' WHEN bye THEN 'call_ended' WHEN turn = e THEN 'three_phase_queued' WHEN turn = v THEN 'patient_identified' WHEN v IS NULL OR turn < v THEN 'agent_response' ELSE 'tool_result' END"
ORACLES = {
    "intent_classify": f"WITH {TURNS} SELECT call_id, turn, {_INTENT} AS intent, {_GOODBYE} AS goodbye, regexp_matches(lower(text), '\\b(" + "|".join(rules.OPEN_ENDED_KEYWORDS) + ")\\b') AS open_ended FROM t",
    "call_state_machine": f"WITH {TURNS}, {FOLD} SELECT call_id, turn, CASE WHEN turn >= e THEN 'end_call' WHEN turn >= v THEN 'answering' ELSE 'verify_identity' END AS state, coalesce(turn >= e, false) AS end_call, {_EVENT} AS event FROM m",
    "call_phases": f"WITH {CLAIMS}, {FOLD}, p AS (SELECT unnest(range(0, 6)) AS second) SELECT call_id, CAST(second AS INT) AS second, 'phase_' || (second // 2 + 1) || CASE WHEN second % 2 = 0 THEN '_start' ELSE '_done' END AS event, intent FROM m, p WHERE turn = e AND NOT bye",
    "call_routing": f"WITH {TURNS}, x AS (SELECT *, {_INTENT} AS intent FROM t) SELECT call_id, turn, intent, CASE WHEN intent = 'pre_procedure' AND call_id % 10 < 5 THEN 'report ' || (call_id % 10) WHEN intent = 'pre_procedure' THEN 'I couldn''t find preparation instructions.' WHEN intent = 'bill_explain' THEN 'I couldn''t retrieve your billing details.' ELSE 'I don''t have that information.' END AS answer FROM x",
    "call_enrichment": f"""WITH {TURNS}, a AS (SELECT o_custkey % 12 AS person, min(o_orderstatus || ' ' || o_orderpriority) AS claim FROM orders WHERE o_custkey % 12 < 10 GROUP BY 1), b AS (SELECT c_custkey % 12 AS person, min(c_mktsegment) AS payer FROM customer WHERE c_custkey % 12 > 3 GROUP BY 1),
      c AS (SELECT s_nationkey % 12 AS person, count(*) AS n FROM supplier WHERE s_nationkey % 12 % 2 = 0 GROUP BY 1)
      SELECT call_id, turn, coalesce(claim, 'no claims on file') AS claim, coalesce(payer, 'no insurance on file') AS payer, coalesce(n, 0) AS n_conflicts, CAST((claim IS NOT NULL)::INT + (payer IS NOT NULL)::INT + (n IS NOT NULL)::INT AS INT) AS known
      FROM t LEFT JOIN a ON a.person = call_id % 12 LEFT JOIN b ON b.person = call_id % 12 LEFT JOIN c ON c.person = call_id % 12""",
    "menu_responses": f"WITH {TURNS} SELECT call_id, turn, CASE turn % 5 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in rules.MENU.items()) + f" ELSE '{rules.MENU_DEFAULT}' END AS response FROM t",
    "answer_status": f"WITH {TURNS} SELECT call_id, turn, CASE turn % 3 WHEN 0 THEN 'PENDING_P2P' WHEN 1 THEN 'PAID' ELSE 'default' END AS status, CASE WHEN turn % 2 = 0 THEN 'PASSPORT' ELSE 'INSURANCE' END AS label FROM t",
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, CAST(sum(floor(value * 100)) AS BIGINT) AS total FROM events GROUP BY 1, 2",
    "event_sessions": "WITH x AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 3600000000 THEN 0 ELSE 1 END AS f FROM events), y AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM x) SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS first, max(ts) AS last, count(*) AS n FROM y GROUP BY user_id, session",
}
