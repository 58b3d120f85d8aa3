"""Chat formatting whose output reads back as the very turns it was made from.

Each role has its own marks. A turn is written with its text as it is, parsed again by a deterministic grammar, and
compared with the source. Where they differ, the text's control strings are escaped, then every character that
could begin one, until role and text come back identical.

Rows are dealt by conversation and sorted, then read as a stream, turn by turn: a conversation of any length
passes through a task without being held in it.

Defined results: null text and null role count as empty; turns with the same number are ordered by role, then text; null
turns come first; rows with a null conv_id form one conversation; repeated rows are turns of their own; an empty
table gives only the conversations added by the caller.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
#: For any other role: its name between the first two, the text before the third.
NAMED = ("<|", "|>", "<|end|>")
CONTROLS = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<|", "|>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_STEP = re.compile(r"\\(.)|(" + _CONTROL.pattern + ")", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escapes(text: str):
    """Ever safer spellings of a text; the last one is always safe."""
    yield text
    doubled = text.replace("\\", "\\\\")
    yield _CONTROL.sub(lambda m: "\\" + m[0], doubled)
    yield re.sub(r"[<\[|]", lambda m: "\\" + m[0], doubled)


def rendered(role: str, text: str) -> tuple[str, int, int]:
    """A turn's formatted string, and where its text lies in it."""
    for name in escapes(role):
        for body in escapes(text):
            if role in MARKS:
                opening, closing = MARKS[role]
            else:
                opening, closing = NAMED[0] + name + NAMED[1], NAMED[2]
            out = opening + body + closing
            if parsed(out) == (role, text, len(opening), len(opening) + len(body), len(out)):
                return out, len(opening), len(opening) + len(body)
    raise AssertionError("the last spelling reads back")


def parsed(source: str, at: int = 0) -> tuple[str, str, int, int, int] | None:
    """(role, text, start and end of the text, end of the turn) of the turn at ``at``; None where the grammar has none."""
    for role, (opening, closing) in MARKS.items():
        if source.startswith(opening, at):
            begin = at + len(opening)
            break
    else:
        if not source.startswith(NAMED[0], at):
            return None
        mark = _mark(source, at + len(NAMED[0]))
        if mark is None or mark[1] != NAMED[1]:
            return None
        role, begin, closing = unescaped(source[at + len(NAMED[0]): mark[0]]), mark[0] + len(NAMED[1]), NAMED[2]
        if role in MARKS:
            return None
    core = closing.strip()
    mark = _mark(source, begin)
    if mark is None:
        return None
    end = mark[0] - (len(closing) - len(closing.lstrip()))
    if end < begin or not source.startswith(closing, end) or not core.startswith(mark[1]):
        return None
    return role, unescaped(source[begin:end]), begin, end, end + len(closing)


def _mark(source: str, at: int) -> tuple[int, str] | None:
    """The first control string from ``at`` on that is not escaped."""
    for m in _STEP.finditer(source, at):
        if m[2] is not None:
            return m.start(), m[2]
    return None


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, piece, begin, end, loss) for every turn, in order: ``begin`` and ``end`` span its text within the
    conversation's string, ``loss`` tells whether a model learns from it."""
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                         F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches):
        current, at = object(), 0
        for batch in batches:
            out = []
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != current:
                    current, at = conv, 0
                piece, begin, end = rendered(role, text)
                out.append((conv, piece, at + begin, at + end, role == "assistant"))
                at += len(piece)
            yield _batch(out, [("conv_id", pa.int64()), ("piece", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("loss", pa.bool_())])

    return dealt.mapInArrow(run, "conv_id long, piece string, begin long, end long, loss boolean")


def _batch(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def read_back(pieces: DataFrame) -> DataFrame:
    """One row per conversation from its formatted pieces alone; the pieces' order within a partition is kept."""
    fields = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
              ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]

    def run(batches):
        state = None

        def row():
            conv, n, turns, chars, loss, at = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), at

        for batch in batches:
            out = []
            for conv, piece, begin, end, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or state[0] != conv:
                    if state is not None:
                        out.append(row())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, _, _, stop = parsed(piece)
                if stop != len(piece):
                    raise ValueError(f"conversation {conv} does not read back")
                state[2].update(f"{role}\n{text}\n".encode())
                if loss:
                    under = unescaped(piece[begin - state[5]: end - state[5]])
                    state[3] += len(under)
                    state[4].update(under.encode())
                state[1] += 1
                state[5] += len(piece)
            yield _batch(out, fields)
        if state is not None:
            yield _batch([row()], fields)

    return pieces.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
