r"""Conversation structure repair by dynamic programming over a trie of signatures.

A row of a conversation is a symbol: its role (system, user, assistant or other, by
its initial) and its first fault (blank, duplicate, truncated). A conversation's
symbols in order are its signature, and the cheapest edits that make its roles
``(s?(ua)+)?`` depend on that alone. Keeping a row costs 0, giving it another role 2,
deleting it 3, inserting an empty turn 2, and a truncated row that stays 1; blank and
duplicate rows have to go. Of equally cheap edits the one whose initials (K, R, D, I)
come first in ASCII is taken.

* Signatures are sorted by range, so each task walks a part of their prefix trie depth
  first. It holds the layers of the current path alone: those of the prefix that a
  signature shares with the one before it are used again, and a signature that many
  conversations have is one terminal. Many of them may lie in several tasks.
* A layer has, for each state (nothing yet, system, user or assistant last), the least
  cost and the order of the best edits among the states. No best edits of one layer
  are the beginning of another's, as they end with the same row, so that order is
  enough to break ties without the edits themselves. Up to the least cost there are few
  different layers; steps between them are worked out once.

Signatures are made without texts; texts are shuffled once, to carry out the edits. A
conversation of any length streams through one task, with one byte a row.

Defined results: null roles and texts are one space; rows are ordered by turn (nulls
first), then role, then a hash of role and text; turns are whole numbers, others count
as null; repeated rows are rows of their own, and the later ones duplicates; a
conversation id may be null and of any plain type; other columns are ignored; no rows
give no plans but for the conversations asked for, which get zeros.
"""

from __future__ import annotations

import functools
import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .chat import _rows, _stream
from .common import materialize, shuffle_partitions

#: What blank means, and what a finished text ends with.
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: Costs of edits by initial, and of a truncated row that stays.
COSTS, TRUNCATED = {"K": 0, "R": 2, "D": 3, "I": 2}, 1
#: States: nothing yet, or the role that came last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Inserts that end a conversation properly, by state.
_CLOSE = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
#: A symbol is a letter from ``a`` on: 4 * role (system, user, assistant, other) + fault (none, blank, duplicate, truncated).
_A = ord("a")

_PLAN = [("n_rows", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64())]


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults that the checksum of ``conv_id:turn`` decides: rows dropped, emptied, cut, repeated or given the role user."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dice = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    rows = conversations.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), dice.alias("d")).filter("d <> 0")
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("d") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("d") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def _ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and a hash that is the last word on order."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", F.expr("try_cast(turn AS long)").alias("turn"), plain("role").alias("role"), plain("text").alias("text"))
    return rows.withColumn("mark", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))


def _symbol(first: Column) -> Column:
    role = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in ("s", 0, "u", 1, "a", 2)]), F.substring("role", 1, 1)), F.lit(3))
    fault = F.when(F.col("last") == "", 1).when(~first, 2).when(~F.col("last").isin(*ENDS), 3).otherwise(0)
    return F.chr(F.lit(_A) + 4 * role + fault)


def signatures(conversations: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """conv_id, signature, and counts of what is wrong; ids of ``of`` that have no rows get an empty signature."""
    rows = _ordered(conversations)
    rows = rows.withColumn("last", F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)).drop("text")
    again = F.row_number().over(Window.partitionBy("conv_id", "mark").orderBy("turn"))
    rows = rows.withColumn("again", again).select("conv_id", "turn", "role", "mark", "again", _symbol(F.col("again") == 1).alias("symbol"))
    if of is not None:
        rows = rows.unionByName(of.select("conv_id").distinct(), allowMissingColumns=True)
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "mark", "again").select("conv_id", "turn", "symbol")
    kind = conversations.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            now: object = out  # no id equals this
            path, turns, low, high = bytearray(), 0, None, None
            for conv, turn, symbol in _rows(batches, "conv_id", "turn", "symbol"):
                if conv != now:
                    if now is not out:
                        yield now, path.decode(), *_counts(path, turns, low, high)
                    now, path, turns, low, high = conv, bytearray(), 0, None, None
                if symbol is None:
                    continue
                path += symbol.encode()
                if turn is not None and turn != high:
                    turns, low, high = turns + 1, turn if low is None else low, turn
            if now is not out:
                yield now, path.decode(), *_counts(path, turns, low, high)

        return _stream(out(), [("conv_id", to_arrow_type(kind)), ("signature", pa.string()), *_PLAN])

    return rows.mapInArrow(run, f"conv_id {kind.simpleString()}, signature string, " + ", ".join(f"{c} long" for c, _ in _PLAN))


def _counts(path: bytearray, turns: int, low: int | None, high: int | None) -> tuple[int, ...]:
    faults = [sum(path.count(_A + 4 * r + f) for r in range(4)) for f in (1, 2, 3)]
    roles = path.translate(bytes(max(b - _A, 0) // 4 for b in range(256)))
    # each legal pair of neighbours is found once: none overlaps itself
    legal = sum(roles.count(bytes(pair)) for pair in ((0, 1), (1, 2), (2, 1)))
    return len(path), high - low + 1 - turns if turns else 0, *faults, max(len(path) - 1, 0) - legal


def _next(state: int) -> int:
    return ASSISTANT if state == USER else USER


def _edits(state: int, symbol: int) -> Iterator[tuple[str, int, int]]:
    """What may be done up to and with a row, in ``state``: initials, cost, the state after it."""
    role, fault = divmod(symbol, 4)
    for inserts in range(3):
        tail, cost = "I" * inserts, COSTS["I"] * inserts
        yield tail + "D", cost + COSTS["D"], state
        if fault in (0, 3):
            stays = cost + (TRUNCATED if fault == 3 else 0)
            if (role == 0 and state == START) or (role in (1, 2) and role + 1 == _next(state)):
                yield tail + "K", stays + COSTS["K"], role + 1
            yield tail + "R", stays + COSTS["R"], _next(state)
        state = _next(state)


#: A layer: for each state the cost above the least one and the place of its edits in their order; None where there is no way.
Layer = tuple[tuple[int, int] | None, ...]
ROOT: Layer = ((0, 0), None, None, None)


@functools.cache
def step(layer: Layer, symbol: int) -> tuple[Layer, int, tuple[tuple[int, str] | None, ...]]:
    """The layer after a row, the rise of the least cost, and for each state where its best edits come from."""
    best: dict[int, tuple[int, int, str, int]] = {}
    for state, known in enumerate(layer):
        if known:
            for tail, cost, after in _edits(state, symbol):
                way = (known[0] + cost, known[1], tail, state)
                best[after] = min(best.get(after, way), way)
    least = min(w[0] for w in best.values())
    order = sorted(best, key=lambda s: best[s][1:3])
    after = tuple((best[s][0] - least, order.index(s)) if s in best else None for s in range(4))
    return after, least, tuple((best[s][3], best[s][2]) if s in best else None for s in range(4))


class Trie:
    """Answers for signatures that come in order; keeps the layers of the last one's path."""

    def __init__(self) -> None:
        self.path = ""
        self.kinds: dict[Layer, int] = {ROOT: 0}
        self.layers: list[Layer] = [ROOT]
        self.ids, self.costs = array("l", [0]), array("q", [0])
        self.answer_ = ("", 0)

    def _shared(self, path: str) -> int:
        low, high = 0, min(len(path), len(self.path))
        while low < high:
            middle = (low + high + 1) // 2
            if path[low:middle] == self.path[low:middle]:
                low = middle
            else:
                high = middle - 1
        return low

    def answer(self, path: str) -> tuple[str, int]:
        """The initials of the best edits and their cost."""
        if path == self.path:
            return self.answer_
        keep = self._shared(path)
        del self.ids[keep + 1 :], self.costs[keep + 1 :]
        for c in path[keep:]:
            after, rise, _ = step(self.layers[self.ids[-1]], ord(c) - _A)
            if after not in self.kinds:
                self.kinds[after] = len(self.layers)
                self.layers.append(after)
            self.ids.append(self.kinds[after])
            self.costs.append(self.costs[-1] + rise)
        self.path = path
        cost, _, state = min((known[0] + COSTS["I"] * _CLOSE[s], known[1], s) for s, known in enumerate(self.layers[self.ids[-1]]) if known)
        parts = ["I" * _CLOSE[state]]
        for i in range(len(path) - 1, -1, -1):
            state, tail = step(self.layers[self.ids[i]], ord(path[i]) - _A)[2][state]
            parts.append(tail)
        self.answer_ = "".join(reversed(parts)), self.costs[-1] + cost
        return self.answer_


def plans(conversations: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """conv_id, n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit: a row for each conversation, and for each id of ``of``."""
    spark, kind = conversations.sparkSession, conversations.schema["conv_id"].dataType
    found = materialize(signatures(conversations, of), "repair-signatures")
    paths = found.repartitionByRange(shuffle_partitions(spark), "signature", "conv_id").sortWithinPartitions("signature", "conv_id")
    names = [c for c, _ in _PLAN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            trie = Trie()
            for path, *row in _rows(batches, "signature", "conv_id", *names):
                audit, cost = trie.answer(path)
                yield *row, cost, audit

        return _stream(out(), [("conv_id", to_arrow_type(kind)), *_PLAN, ("cost", pa.int64()), ("audit", pa.string())])

    return paths.mapInArrow(run, f"conv_id {kind.simpleString()}, " + "".join(f"{c} long, " for c in names) + "cost long, audit string")


_ROLES = {"u": USER, "a": ASSISTANT, "s": SYSTEM}
_NAMES = {USER: "user", ASSISTANT: "assistant"}


def repaired(conversations: DataFrame, planned: DataFrame) -> DataFrame:
    """conv_id, position (from 0), edit (K, R or I), role, text: the rows that the plans leave. Those of a conversation lie in one partition, in order."""
    kind = conversations.schema["conv_id"].dataType
    rows = _ordered(conversations).unionByName(planned.select("conv_id", "audit"), allowMissingColumns=True)
    order = [F.col("conv_id"), F.col("audit").isNull(), F.col("turn"), F.col("role"), F.col("mark")]
    rows = rows.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "audit", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            conv, edits, at, state, position = None, "", 0, START, 0

            def inserts() -> Iterator[tuple]:
                nonlocal at, state, position
                while at < len(edits) and edits[at] == "I":
                    state, at, position = _next(state), at + 1, position + 1
                    yield conv, position - 1, "I", _NAMES[state], ""

            for conv_, audit, role, text in _rows(batches, "conv_id", "audit", "role", "text"):
                if audit is not None:
                    yield from inserts()
                    conv, edits, at, state, position = conv_, audit, 0, START, 0
                    continue
                yield from inserts()
                edit, at = edits[at], at + 1
                if edit != "D":
                    state = _ROLES[role[0]] if edit == "K" else _next(state)
                    yield conv, position, edit, role if edit == "K" else _NAMES[state], text
                    position += 1
            yield from inserts()

        return _stream(out(), [("conv_id", to_arrow_type(kind)), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    return rows.mapInArrow(run, f"conv_id {kind.simpleString()}, position long, edit string, role string, text string")


def digests(rows: DataFrame) -> DataFrame:
    """conv_id and the digest of ``role:text`` of its rows, joined by newlines. Takes what ``repaired`` leaves, partition by partition."""
    kind = rows.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            now, digest = None, None
            for conv, position, role, text in _rows(batches, "conv_id", "position", "role", "text"):
                if position == 0:
                    if digest:
                        yield now, digest.hexdigest()
                    now, digest = conv, hashlib.sha256()
                digest.update(f"{chr(10) if position else ''}{role}:{text}".encode())
            if digest:
                yield now, digest.hexdigest()

        return _stream(out(), [("conv_id", to_arrow_type(kind)), ("sha256", pa.string())])

    return rows.mapInArrow(run, f"conv_id {kind.simpleString()}, sha256 string")
