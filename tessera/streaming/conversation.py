"""Calls as keyed state: one step function, folded over a table of turns or kept in a stream's state store."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import rules
from tessera.functions import text as tx

# States, limits and replies of the agent, and the phases of a queued call.
VERIFY, ANSWERING, ENDED = "verify_identity", "answering", "end_call"
MOST_RETRIES = 2
OPTIONS = 3
QUEUED_INTENTS = ("claim_status", "cost_estimate")
TTL_MS = 30 * 60 * 1000
FAREWELL = "Thank you for calling{person}. Have a great day. Goodbye!"
ASK_NAME = "I need your full name to find your records. Please say your first and last name."
ASK_AGAIN = "I couldn't find your records. Could you please repeat your full name and date of birth?"
ASK_OTHER = "I couldn't find your records with that name. Could you please repeat your full first and last name?"
GIVE_UP = "I'm unable to locate your records after two attempts. Please call back with your full name and date of birth, or visit us in person. Goodbye."
WELCOME = "Thank you. I found your records, {person}. How can I help you today?"
CHOOSE = "I found a few patients with that name. Are you {names}?"
QUEUED = "I understand, {person}. This requires me to contact your insurance company directly. I'll call them now and call you back within 15 minutes with a full answer. Please keep your phone available. Have a great day."
DISCREPANCY = " Note: there is a discrepancy in your records."
PHASES = ["phase_1_start", "phase_1_done", "phase_2_start", "phase_2_done", "phase_3_start", "phase_3_done"]


@dataclass
class Session:
    state: str = VERIFY
    person: str = ""
    retries: int = 0
    turns: int = 0


@dataclass
class Turn:
    """A turn with what was looked up for it before: whom its text names, its intent, and the answer for it."""

    text: str
    intent: str = "general"
    goodbye: bool = False
    match_type: str = "not_found"
    person: str = ""
    options: list[str] = field(default_factory=list)
    answer: str | None = None
    has_conflicts: bool = False


def step(s: Session, t: Turn) -> tuple[str, bool, str]:
    """Changes the session; gives the reply, whether the call ends, and what happened."""
    s.turns += 1
    if s.state == ENDED:
        return "", True, "ignored"
    if t.goodbye:
        s.state = ENDED
        return FAREWELL.format(person=f", {s.person}" if s.person else ""), True, "call_ended"
    if s.state == VERIFY:
        return _verify(s, t)
    if t.intent in QUEUED_INTENTS:
        s.state = ENDED
        return QUEUED.format(person=s.person), True, "three_phase_queued"
    reply = t.answer or "I don't have that information."
    return reply + (DISCREPANCY if t.has_conflicts else ""), False, "tool_result"


def _verify(s: Session, t: Turn) -> tuple[str, bool, str]:
    said = t.text.lower().strip()
    if sum(len(w) > 1 for w in said.split()) < 2:
        return ASK_NAME, False, "agent_response"
    names = t.options[:OPTIONS]
    chosen = ""
    if t.match_type == "answer" and any(len(p) > 2 and p in said for p in t.person.lower().split()):
        chosen = t.person
    elif t.match_type == "disambiguation":
        chosen = next((n for n in names if n.lower() in said or said in n.lower()), "")
        if not chosen:
            return CHOOSE.format(names=", or ".join(names)), False, "agent_response"
    if chosen:
        s.person, s.state = chosen, ANSWERING
        return WELCOME.format(person=chosen), False, "patient_identified"
    s.retries += 1
    if s.retries >= MOST_RETRIES:
        s.state = ENDED
        return GIVE_UP, True, "patient_not_found"
    return (ASK_OTHER if t.match_type == "answer" else ASK_AGAIN), False, "agent_response"


def prepared(turns: DataFrame) -> DataFrame:
    """call_id, turn, text and the looked-up columns; what the caller has not joined on gets its default."""
    defaults = {"match_type": F.lit("not_found"), "person": F.lit(""), "options": F.array().cast("array<string>"), "answer": F.lit(None).cast("string"), "has_conflicts": F.lit(False)}
    text = F.coalesce("text", F.lit(""))
    own = {k: (F.coalesce(F.col(k), d) if k in turns.columns else d) for k, d in defaults.items()}
    return turns.select("call_id", "turn", text.alias("text"), rules.intent(text).alias("intent"), rules.is_goodbye(text).alias("goodbye"), *[c.alias(k) for k, c in own.items()])


REPLY = "call_id long, turn long, state string, person string, reply string, end_call boolean, event string, intent string"


def _reply(call: int, row, s: Session) -> tuple:
    said = step(s, Turn(row.text, row.intent, bool(row.goodbye), row.match_type, row.person, list(row.options), row.answer, bool(row.has_conflicts)))
    return call, row.turn, s.state, s.person, *said, row.intent


def replay(turns: DataFrame) -> DataFrame:
    """Replies to all turns of a table. A call streams through its task in order of turn: only the session is held."""
    rows = prepared(turns).repartition("call_id").sortWithinPartitions("call_id", "turn", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, s = None, Session()
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if now is None or row.call_id != now:
                    now, s = row.call_id, Session()
                out.append(_reply(now, row, s))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in REPLY.split(", ")])

    return rows.mapInPandas(run, REPLY)


def stream(turns: DataFrame, watermark: str | None = None, time: str = "ts") -> DataFrame:
    """Replies to a stream of turns; the session is the state of its call, and is dropped after half an hour of silence.

    With a watermark, turns that come again within it are dropped. Turns of one micro-batch are taken in order.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    if watermark:
        turns = turns.withWatermark(time, watermark).dropDuplicatesWithinWatermark(["call_id", "turn"])
    rows = prepared(turns)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        s = Session(*state.get) if state.exists else Session()
        pdf = pd.concat(list(batches)).sort_values(["turn", "text"], kind="stable")
        out = [_reply(key[0], row, s) for row in pdf.itertuples(index=False)]
        state.update((s.state, s.person, s.retries, s.turns))
        state.setTimeoutDuration(TTL_MS)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in REPLY.split(", ")])

    return rows.groupBy("call_id").applyInPandasWithState(run, REPLY, "state string, person string, retries int, turns int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def phase_events(replies: DataFrame) -> DataFrame:
    """For each queued call its phases, a second apart."""
    queued = replies.filter("event = 'three_phase_queued'")
    return queued.select("call_id", "person", "intent", F.posexplode(F.array(*[F.lit(p) for p in PHASES])).alias("second", "event"))


def routed(turns: DataFrame, reports: DataFrame) -> DataFrame:
    """Turns with the answer of the report that their intent asks for, or a fallback: a join of a stream, or a table, with a table.

    ``reports``: person, intent, answer.
    """
    text = F.coalesce("text", F.lit(""))
    own = turns.withColumn("intent", rules.intent(text))
    fallback = F.when(F.col("intent") == "pre_procedure", "I couldn't find preparation instructions.").when(F.col("intent") == "bill_explain", "I couldn't retrieve your billing details.").otherwise("I don't have that information.")
    return own.join(reports.select("person", "intent", F.col("answer").alias("known")), ["person", "intent"], "left").withColumn("answer", F.coalesce("known", fallback)).drop("known")


#: What a turn is told of a side that doesn't know its person.
NO_CLAIM, NO_PAYER = "no claims on file", "no insurance on file"


def enriched(turns: DataFrame, claims: DataFrame, payers: DataFrame, conflicts: DataFrame, watermark: str | None = None, time: str = "ts") -> DataFrame:
    """Turns, of a stream or a table, with what three tables know of their person: claim, payer, n_conflicts, known (how many sides).

    ``claims``: person, claim; ``payers``: person, payer; ``conflicts``: person, attribute_key. All are reduced to a row a person
    first, so a turn stays one row: of several claims or payers the smallest. A side without the person, and a turn
    without a person, gives the fallback and 0. In a stream with a watermark turns that come again within it are dropped, and
    later ones than that are as well; a table keeps all but repeated ones.
    """
    if watermark and turns.isStreaming:
        turns = turns.withWatermark(time, watermark).dropDuplicatesWithinWatermark(["call_id", "turn"])
    elif watermark:
        turns = turns.dropDuplicates(["call_id", "turn"])
    claim = claims.groupBy("person").agg(F.min("claim").alias("__claim"))
    payer = payers.groupBy("person").agg(F.min("payer").alias("__payer"))
    told = conflicts.groupBy("person").agg(F.count(F.lit(1)).alias("__n"))
    out = turns.join(claim, "person", "left").join(payer, "person", "left").join(told, "person", "left")
    known = sum(F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in ("__claim", "__payer", "__n"))
    out = out.withColumns({"claim": F.coalesce("__claim", F.lit(NO_CLAIM)), "payer": F.coalesce("__payer", F.lit(NO_PAYER)), "n_conflicts": F.coalesce("__n", F.lit(0)), "known": known})
    return out.drop("__claim", "__payer", "__n")


def follow_enriched(turns: DataFrame, tables: Callable[[], tuple[DataFrame, DataFrame, DataFrame]], path: str, checkpoint: str):
    """A query that writes enriched turns to ``path``, one part a batch, and ends when all turns are taken.

    ``tables`` is asked again for each batch, so a side that is late is known from the next batch on. A batch that comes
    again is written over.
    """
    def step(df: DataFrame, batch: int) -> None:
        enriched(df, *tables()).write.mode("overwrite").parquet(f"{path}/batch-{batch}")

    return turns.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reply_xml(reply: str = "reply") -> Column:
    """What a telephone would be told to say."""
    return F.concat(F.lit("<Response><Say>"), tx.xml_escape(F.col(reply)), F.lit("</Say></Response>"))
