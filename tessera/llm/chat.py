r"""Chat formatting by a finite-state machine over roles.

A declarative template says how a turn is marked and which roles are under the
loss. Rows are dealt by conversation and sorted by turn; one pass over each
partition keeps only the machine's state, so a conversation of any length
streams through bounded memory.

Every control string of the template begins with ``<|``. Inside roles and texts
a backslash becomes two and ``<|`` becomes ``<\|``, so no control string can
occur there, and a backslash before any character stands for that character.

Defined results: null roles and texts are empty; null turns come first; turns
with one number are ordered by role and then text; repeated rows are turns of
their own; conversation ids are of any plain type, a null one names a conversation like any other; roles or
orders that the machine does not allow are formatted all the same, and
``valid`` is false from that turn on; other columns are ignored; no rows give
no segments.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of output put together at a time.
CHUNK = 2000


@dataclass(frozen=True)
class Template:
    """How turns are marked. Control strings begin with ``<|`` and hold no other ``<|``."""

    begin: str = "<|turn|>"
    middle: str = "<|text|>"
    end: str = "<|end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: state -> roles that may come next; a turn's role is the next state.
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    #: states in which a conversation may end.
    final: tuple[str, ...] = ("assistant",)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def _stream(rows: Iterator[tuple], names: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(names)
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= CHUNK or size > 8_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), names, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), names, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[b.column(n).to_pylist() for n in names], strict=True)


def format_conversations(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments: conv_id, position (of the turn, from 0), segment (0 begin, 1 text, 2 end), role, text, loss, valid.

    The texts of a conversation's segments, one after the other, are its formatted text.
    A conversation's segments lie in one partition, in order.
    """
    t = template or Template()
    kind = conversations.schema["conv_id"].dataType
    arrow = to_arrow_type(kind)
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def segments() -> Iterator[tuple]:
            now: object = segments  # no id equals this
            position, state, valid = 0, "", True
            for conv, role, text in _rows(batches, "conv_id", "role", "text"):
                if conv != now:
                    now, position, state, valid = conv, 0, "", True
                valid = valid and role in t.moves.get(state, ())
                state = role
                loss = role in t.loss_roles
                yield conv, position, 0, role, f"{t.begin}{escape(role)}{t.middle}", False, valid
                yield conv, position, 1, role, escape(text), loss, valid
                yield conv, position, 2, role, f"{t.end}\n", False, valid
                position += 1

        return _stream(segments(), [("conv_id", arrow), ("position", pa.int64()), ("segment", pa.int32()), ("role", pa.string()), ("text", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_())])

    return rows.mapInArrow(run, f"conv_id {kind.simpleString()}, position long, segment int, role string, text string, loss boolean, valid boolean")


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of what a reader of the formatted text finds, per conversation.

    Takes what ``format_conversations`` leaves, partition by partition. Turns are
    parsed from the text alone; the loss mask is that of the segments.
    """
    t = template or Template()
    kind = segments.schema["conv_id"].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digests() -> Iterator[tuple]:
            now: object = digests
            turns = loss = None
            n = chars = lost = 0
            pending, good, last = "", True, ""

            def done() -> tuple:
                return now, n, turns.hexdigest(), lost, loss.hexdigest(), chars, good and last in t.final

            for conv, text, under, valid in _rows(batches, "conv_id", "text", "loss", "valid"):
                if conv != now:
                    if turns is not None:
                        yield done()
                    now, turns, loss, n, chars, lost, pending, good = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, "", True
                chars += len(text)
                good = good and valid
                if under:
                    own = unescape(text)
                    lost += len(own)
                    loss.update(own.encode())
                pending += text
                if pending.endswith(f"{t.end}\n"):
                    head, _, rest = pending.removeprefix(t.begin).partition(t.middle)
                    body, _, _ = rest.partition(t.end)
                    last = unescape(head)
                    turns.update(f"{last}\n{unescape(body)}\n".encode())
                    n += 1
                    pending = ""
            if turns is not None:
                yield done()

        return _stream(digests(), [("conv_id", arrow), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])

    return segments.mapInArrow(run, f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
