"""Chat formatting: a finite-state machine over roles, and text with marked turns from a declarative template.

A template says how a turn opens and closes, which roles are trained on and which turn may follow which. Control
strings inside a text are broken by an escape that the reader takes out again, so a text can say anything.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START = "start"


@dataclass(frozen=True)
class Template:
    """``follows`` is the machine: state (the last role, or ``start``) to the roles that may come next; ``final``
    are the roles that may be last. ``loss`` are the roles whose text is trained on. ``controls`` are strings that
    no text may show, besides ``open`` and ``close``."""

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>\n"
    loss: tuple[str, ...] = ("assistant",)
    controls: tuple[str, ...] = ("<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
    final: tuple[str, ...] = ("assistant", "user")
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            START: ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )

    def marks(self) -> list[str]:
        return sorted({self.open, self.close.strip(), *self.controls}, key=lambda m: (-len(m), m))

    def __post_init__(self) -> None:
        for mark in self.marks():
            if len(mark) < 2 or "\\" in mark or any(mark.endswith(mark[:n]) for n in range(1, len(mark))):
                raise ValueError(f"{mark!r} can't be escaped: two characters or more, no backslash, no end like its start")


CHATML = Template()

_UNESCAPE = {"\\": "\\", ".": "", "n": "\n"}


def escape(text: str, template: Template = CHATML) -> str:
    """Double each backslash, then break control strings with a backslash and a full stop."""
    text = text.replace("\\", "\\\\")
    for mark in template.marks():
        text = text.replace(mark, f"{mark[0]}\\.{mark[1:]}")
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\([\\.n])", lambda m: _UNESCAPE[m[1]], text)


def format_turns(turns: list[tuple[str, str]], template: Template = CHATML) -> tuple[str, list[dict], bool]:
    """The formatted text, its segments with their place, role and loss flag, and whether the machine accepts.

    Segments cover the text without gaps: marks have no role and no loss. A conversation that the machine refuses is
    formatted all the same; so is one without turns, as empty text, which is refused.
    """
    parts, segments, at = [], [], 0
    state, valid = START, True

    def emit(text: str, role: str | None, loss: bool) -> None:
        nonlocal at
        if text:
            parts.append(text)
            segments.append({"start": at, "end": at + len(text), "role": role, "loss": loss})
            at += len(text)

    for role, text in turns:
        valid = valid and role in template.follows.get(state, ())
        state = role
        emit(f"{template.open}{escape(role, template).replace(chr(10), chr(92) + 'n')}{template.after_role}", None, False)
        emit(escape(text, template), role, role in template.loss)
        emit(template.close, None, False)
    return "".join(parts), segments, valid and state in template.final


def read_turns(text: str, template: Template = CHATML) -> list[tuple[str, str]]:
    """The turns of a formatted text, as they were before formatting."""
    pattern = f"{re.escape(template.open)}(.*?){re.escape(template.after_role)}(.*?){re.escape(template.close)}"
    return [(unescape(role), unescape(body)) for role, body in re.findall(pattern, text, re.DOTALL)]


_OUT = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("formatted", pa.string()),
        ("segments", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("role", pa.string()), ("loss", pa.bool_())]))),
        ("valid", pa.bool_()),
    ]
)
_SCHEMA = (
    "conv_id bigint, formatted string, segments array<struct<start: bigint, end: bigint, role: string, loss: boolean>>, "
    "valid boolean"
)
ROWS_OUT = 500


def format_conversations(
    conversations: DataFrame, template: Template = CHATML, conv: str = "conv_id", turn: str = "turn",
    role: str = "role", text: str = "text",
) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments, valid.

    Turns come in order of ``turn`` (null first), then role and text; a null role or text is empty. Rows without a
    conversation form one of their own, with null conv_id. Repeated rows are turns like any other. A task holds one
    conversation at a time.
    """
    chosen = conversations.select(
        F.col(f"`{conv}`").cast("bigint").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        current, turns = None, []

        def close() -> None:
            if turns:
                formatted, segments, valid = format_turns(turns, template)
                done.append({"conv_id": current, "formatted": formatted, "segments": segments, "valid": valid})

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))
            for conv_id, role, text in zip(*columns, strict=True):
                if conv_id != current:
                    close()
                    current, turns = conv_id, []
                    if len(done) >= ROWS_OUT:
                        yield pa.RecordBatch.from_pylist(done, _OUT)
                        done = []
                turns.append((role, text))
        close()
        yield pa.RecordBatch.from_pylist(done, _OUT)

    ordered = chosen.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(form, _SCHEMA)
