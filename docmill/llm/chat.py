"""Chat formatting from event logs: fold deltas, edits and regenerations, render turns, read them back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

#: Control strings of public chat formats; all are escaped inside texts, the first two mark turns here.
CONTROLS = ["<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
START, END = CONTROLS[:2]
_PLAIN = re.compile("|".join(f"({re.escape(c[0])})(\\\\*)({re.escape(c[1:])})" for c in sorted(CONTROLS, key=len, reverse=True)))
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)
KINDS = ("message", "delta", "edit", "regenerate")
EVENT = "conv_id long, turn long, seq long, kind string, role string, text string"
TURNS = "conv_id long, position long, formatted string, loss_start long, loss_end long"


def escape(text: str) -> str:
    """One backslash more after the first character of a control string, with however many it has there already."""
    return _PLAIN.sub(lambda m: "\\".join(_parts(m)), text)


def _parts(m: re.Match) -> tuple[str, str]:
    first, slashes, rest = (g for g in m.groups() if g is not None)
    return first, slashes + rest


def unescape(text: str) -> str:
    return _PLAIN.sub(lambda m: "".join((_parts(m)[0], _parts(m)[1].removeprefix("\\"))), text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn and the span of its text in it."""
    name = escape(role.replace("\\", "\\\\").replace("\n", "\\n"))
    head, body = f"{START}{name}\n", escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def read_back(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of rendered text."""
    for m in _TURN.finditer(formatted):
        name = re.sub(r"\\(.)", lambda x: "\n" if x[1] == "n" else x[1], unescape(m[1]))
        yield name, unescape(m[2])


class Fold:
    """Final messages of a log in (turn, seq) order; holds one message and one number per conversation.

    message starts a message of its turn; delta appends to the turn's last message, edit replaces its text (both
    start one if the turn has none yet); regenerate empties its turn's messages, discards what earlier events said
    in later turns, and with a role starts a message anew.
    """

    def __init__(self):
        self.turn: int | None = None
        self.cut = self.pending = -1  # events before cut are discarded here; pending holds from the next turn on
        self.held: list[tuple[str, str]] = []  # ended messages of this turn
        self.role: str | None = None
        self.parts: list[str] | None = None

    def take(self, turn: int | None, seq: int | None, kind: str | None, role: str | None, text: str | None) -> Iterator[tuple[str, str]]:
        if turn != self.turn:
            yield from self.done()
            self.turn = turn
            self.cut = max(self.cut, self.pending)
        at = -1 if seq is None else seq
        if at < self.cut:
            return
        kind = "message" if kind is None else kind
        if kind not in KINDS:
            raise ValueError(f"unknown event kind {kind!r}")
        if kind == "regenerate":
            self.held.clear()
            self.parts = None
            self.pending = max(self.pending, at)
            if role is not None:
                self.role, self.parts = role, [text or ""]
            return
        if kind == "message" or self.parts is None:
            if self.parts is not None:
                self.held.append((self.role or "", "".join(self.parts)))
            self.role, self.parts = role, [text or ""]
        elif kind == "delta":
            self.parts.append(text or "")
        else:
            self.parts = [text or ""]

    def done(self) -> Iterator[tuple[str, str]]:
        yield from self.held
        if self.parts is not None:
            yield self.role or "", "".join(self.parts)
        self.held, self.parts = [], None


def format_conversations(events: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Rendered turns of event logs: conv_id, position (from 0), formatted, loss_start, loss_end.

    events: conv_id, turn, seq, kind, role, text. A conversation's text is its turns' `formatted` in order of position;
    loss_start and loss_end (code points in `formatted`) hold the text that the loss covers, null for other roles.
    The log is partitioned by conversation and sorted by turn and sequence, equal ones by kind, role and text; the sort
    spills, and the fold holds one turn, so that a conversation of any length streams through.

    Null texts are empty, null roles are empty names, null kinds are messages, null turns and sequences come first, a
    null conv_id is a conversation of its own. Repeated message rows are turns of their own. Empty table: no rows. A kind
    of event that isn't known raises an error, since what it did to the conversation can't be told.
    """
    order = ["conv_id", "turn", "seq", "rank", "role", "text"]
    rank = F.array_position(F.lit(list(KINDS)), F.coalesce("kind", F.lit("message")))
    names = [x.split()[0] for x in TURNS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, fold, position, out, size = None, Fold(), 0, [], 0

        def put(messages):
            nonlocal position, size
            for role, text in messages:
                formatted, a, b = render(role, text)
                out.append((state[0], position, formatted, *((a, b) if role in loss_roles else (None, None))))
                position, size = position + 1, size + len(formatted)

        def flush():
            nonlocal size
            columns = zip(*out, strict=True) if out else [()] * 5
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
            out.clear()
            size = 0
            return batch

        for batch in batches:
            for conv, turn, seq, kind, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "seq", "kind", "role", "text")), strict=True):
                if state != (conv,):
                    put(fold.done())
                    state, fold, position = (conv,), Fold(), 0
                put(fold.take(turn, seq, kind, role, text))
                if size > 4_000_000:
                    yield flush()
        put(fold.done())
        yield flush()

    slim = pick(events, conv_id="conv_id", turn="turn", seq="seq", kind="kind", role="role", text="text").withColumn("rank", rank)
    return slim.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, TURNS)


def digests(turns: DataFrame) -> DataFrame:
    """What reading the rendered turns gives, per conversation. turns as format_conversations() returns them, in its order."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.string() if "string" in x else pa.int64() for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out = None, []

        def end():
            if state is not None:
                conv, n, all_hash, loss_n, loss_hash, chars = state
                out.append((conv, n, all_hash.hexdigest(), loss_n, loss_hash.hexdigest(), chars))

        for batch in batches:
            for conv, formatted, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
                if state is None or state[0] != conv:
                    end()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_back(formatted):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if a is not None:
                    learned = unescape(formatted[a:b])
                    state[3] += len(learned)
                    state[4].update(learned.encode("utf-8", "surrogatepass"))
                state[5] += len(formatted)
            columns = zip(*out, strict=True) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
            out = []
        end()
        columns = zip(*out, strict=True) if out else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return turns.mapInArrow(run, schema)


def as_events(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a log of one message event each."""
    rows = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    return rows.select("conv_id", "turn", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")
