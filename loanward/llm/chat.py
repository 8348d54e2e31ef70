"""Operator 8: chat formatting with a grammar round trip.

Each turn is rendered by a template, parsed again by a deterministic parser and compared with its source. While
they differ, conflicting content is escaped once more. Escaping puts a backslash into a control string behind
its first character; text that already looks escaped gets one backslash more, so the way back is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanward.llm.common import column_or_null, slices

#: Control strings of common chat templates, none of which may stand in a text as it is. Fixed values.
CONTROL = (
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>",
    "<|user|>", "<|assistant|>", "<|system|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>",
)
#: The template: a turn opens with its role and closes before the next turn.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
#: The role whose text is under the loss mask.
LEARNED = "assistant"
_CONFLICT = re.compile("|".join(
    f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in sorted(CONTROL, key=len, reverse=True)))
_ESCAPED = re.compile("|".join(
    f"{re.escape(c[0])}\\\\+{re.escape(c[1:])}" for c in sorted(CONTROL, key=len, reverse=True)))
#: Roles stand on the template's header line: other characters are written as code points.
_ODD_ROLE = re.compile(r"[^A-Za-z0-9_.-]")


def escape(text: str) -> str:
    return _CONFLICT.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def _role_out(role: str) -> str:
    return _ODD_ROLE.sub(lambda m: f"%{ord(m[0]):x};", role)


def _role_in(role: str) -> str:
    return re.sub(r"%([0-9a-f]+);", lambda m: chr(int(m[1], 16)), role)


def parse(rendered: str) -> list[tuple[str, str, int]]:
    """The turns of a rendered conversation: role, text, times escaped. Raises on anything outside the grammar."""
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(OPEN, at):
            raise ValueError(f"no turn opens at {at}")
        line = rendered.find(MIDDLE, at)
        end = rendered.find(CLOSE, line)
        if line < 0 or end < 0:
            raise ValueError(f"the turn at {at} does not close")
        role, _, level = rendered[at + len(OPEN):line].partition(" ")
        body = rendered[line + len(MIDDLE):end]
        if any(c in body for c in CONTROL):
            raise ValueError(f"a control string stands in the text of the turn at {at}")
        for _ in range(int(level or 0)):
            body = unescape(body)
        turns.append((_role_in(role), body, int(level or 0)))
        at = end + len(CLOSE)
    return turns


def render(role: str, text: str) -> str:
    """One turn, escaped as often as its round trip needs."""
    body, level = text, 0
    while True:
        out = f"{OPEN}{_role_out(role)}{f' {level}' if level else ''}{MIDDLE}{body}{CLOSE}"
        try:
            if [t[:2] for t in parse(out)] == [(role, text)]:
                return out
        except ValueError:
            pass
        body, level = escape(body), level + 1


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, rendered: each row as a turn of its conversation.

    Null roles and texts count as empty. Repeated rows are repeated turns. Other columns are ignored; nothing is
    shuffled.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = [render(role or "", text or "") for role, text in zip(
                batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), pa.array(out, pa.string())],
                                             ["conv_id", "turn", "rendered"])

    rows = conversations.select(
        F.col("conv_id").cast("long"), column_or_null(conversations, "turn", "long").alias("turn"),
        column_or_null(conversations, "role", "string").alias("role"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "conv_id long, turn long, rendered string")


class _Reader:
    """Digests of the conversation whose turns are passing."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def take(self, rendered: str) -> None:
        self.chars += len(rendered)
        for role, text, _ in parse(rendered):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
            if role == LEARNED:
                self.loss_chars += len(text)
                self.loss.update(text.encode())

    def row(self) -> dict:
        return {"conv_id": self.conv_id, "n_turns": self.turns, "turns_sha256": self.all.hexdigest(),
                "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, what the formatted turns hold: counts, and digests of all turns and of the masked text.

    Turns are ordered by turn number (nulls first), then by their rendered text. A conversation passes through a
    task turn by turn and is never held whole. Rows without conv_id are one conversation.
    """
    arrow = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                       ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader: _Reader | None = None
        for batch in batches:
            done = []
            for conv, rendered in zip(batch.column("conv_id").to_pylist(), batch.column("rendered").to_pylist(),
                                      strict=True):
                if reader is None or reader.conv_id != conv:
                    if reader is not None:
                        done.append(reader.row())
                    reader = _Reader(conv)
                reader.take(rendered)
            yield pa.RecordBatch.from_pylist(done, schema=arrow)
        if reader is not None:
            yield pa.RecordBatch.from_pylist([reader.row()], schema=arrow)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "rendered")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                   "loss_sha256 string, formatted_chars long")


#: The case that op8 adds: control strings in both texts.
EXTRA = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def with_extra(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, number -7."""
    kind = "conv_id long, turn long, role string, text string"
    extra = conversations.sparkSession.createDataFrame(EXTRA, kind)
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
