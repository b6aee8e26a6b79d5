"""Chat formatting: a finite-state machine over roles and a declarative template.

The template marks turns with control strings. Inside texts and roles, every control string is
escaped reversibly: ``<``, any backslashes, ``|`` gets one more backslash, so the formatted text
holds ``<|`` only in the template's own marks. Output is a stream of segments, each with a loss
flag; a turn's text is a segment of its own, under the loss if its role is trained on.

Nulls: a null text or role is empty; null turns come first; rows without a conversation id form one
conversation. Equal turns are ordered by role, then text; repeated rows are separate turns. Rows of
one conversation are streamed in order in bounded memory, however many there are: a digest of a
conversation's turns in order cannot be divided. A text of any length is one segment. Columns besides
the four named ones play no part, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around a turn, roles under the loss, and the machine: state -> role -> next state."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    role_end: str = "\n"
    turn_end: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    first_state: str = "begin"
    final_states: tuple[str, ...] = ("answered",)
    machine: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "begin": {"system": "instructed", "user": "asked"},
        "instructed": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    })


_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<(\\*)\\\|")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\1\\|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    """As ``escape``; a line end, which would end the role, becomes the control string ``<|nl|>``."""
    return escape(role).replace("\n", "<|nl|>")


def unescape_role(role: str) -> str:
    return unescape(role.replace("<|nl|>", "\n"))


SEGMENTS = "conv_id {id}, turn_no long, part string, text string, loss boolean, valid_turn boolean, last boolean"


def format_chat(chats: DataFrame, template: Template = Template(), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Segments of every turn, in order within a partition: conv_id, turn_no, part (head, body, foot), text, loss,
    valid_turn (the machine allows the role there and, in the last foot, ends in a final state), last (of the conversation)."""
    rows = chats.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartition(F.col("conv_id")).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None
        state, turn_no, current = template.first_state, 0, object()

        def emit(rows: list, row: tuple, last: bool) -> None:
            conv, no, role, text, valid = row
            loss = role in template.loss_roles
            rows.append((conv, no, "head", template.start + escape_role(role) + template.role_end, False, valid, False))
            rows.append((conv, no, "body", escape(text), loss, valid, False))
            rows.append((conv, no, "foot", template.end + template.turn_end, False, valid and (not last or state in template.final_states), last))

        def frame(rows: list) -> pd.DataFrame:
            f = pd.DataFrame(rows, columns=["conv_id", "turn_no", "part", "text", "loss", "valid_turn", "last"])
            return f.assign(conv_id=pd.array(f["conv_id"], dtype="Int64")) if ints else f

        ints = dict(rows_types)["conv_id"] in ("bigint", "int", "smallint", "tinyint")
        for batch in batches:
            out: list = []
            ids = [None if pd.isna(x) else x for x in batch["conv_id"]]
            for conv, role, text in zip(ids, batch["role"], batch["text"], strict=True):
                new = held is None or conv != current
                if held is not None:
                    emit(out, held, new)
                if new:
                    state, turn_no, current = template.first_state, 0, conv
                following = template.machine.get(state, {}).get(role)
                state = following or state
                held = (conv, turn_no, role, text, following is not None)
                turn_no += 1
                if len(out) >= 6000:
                    yield frame(out)
                    out = []
            if out:
                yield frame(out)
        if held is not None:
            out = []
            emit(out, held, True)
            yield frame(out)

    rows_types = rows.dtypes
    return rows.mapInPandas(run, SEGMENTS.format(id=dict(rows_types)["conv_id"]))


class Reader:
    """Reads a formatted conversation back, piece by piece; holds one turn at a time."""

    def __init__(self, template: Template = Template()):
        self.t = template
        self.turns, self.loss_text = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.buffer: list[str] = []

    def feed(self, text: str, loss: bool) -> None:
        self.chars += len(text)
        if loss:
            plain = unescape(text)
            self.loss_chars += len(plain)
            self.loss_text.update(plain.encode("utf-8", "surrogatepass"))
        self.buffer.append(text)
        if self.t.end in text:
            self._turns()

    def _turns(self) -> None:
        whole = "".join(self.buffer)
        mark = self.t.end + self.t.turn_end
        *done, rest = whole.split(mark)
        for turn in done:
            head, body = turn.removeprefix(self.t.start).split(self.t.role_end, 1)
            self.turns.update(f"{unescape_role(head)}\n{unescape(body)}\n".encode("utf-8", "surrogatepass"))
            self.n_turns += 1
        self.buffer = [rest] if rest else []


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """One row a conversation from ``format_chat``'s segments (of the same partitions, in order)."""
    kind = dict(segments.dtypes)["conv_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, valid, state_ok = Reader(template), True, None
        for batch in batches:
            out: list = []
            ids = [None if pd.isna(x) else x for x in batch["conv_id"]]
            for conv, part, text, loss, ok, last in zip(ids, batch["part"], batch["text"], batch["loss"], batch["valid_turn"], batch["last"], strict=True):
                reader.feed(text, loss)
                valid = valid and ok
                if last:
                    out.append((conv, reader.n_turns, reader.turns.hexdigest(), reader.loss_chars, reader.loss_text.hexdigest(), reader.chars, valid))
                    reader, valid = Reader(template), True
            f = pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid_order"])
            yield f.assign(conv_id=pd.array(f["conv_id"], dtype="Int64")) if kind == "bigint" else f

    return segments.mapInPandas(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid_order boolean")
