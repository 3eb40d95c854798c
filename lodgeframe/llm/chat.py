"""Chat formatting with any template: turns are located by rendering successive prefixes.

A template is a function from a list of (role, text) to a string, used as a black box. Rendering the
first k and the first k + 1 turns and comparing the two outputs gives the span of turn k. If the
longer output does not begin with the shorter, the template rewrote what it had said before; such a
conversation is reported and its spans are counted from where the outputs part. Within a span, two
renderings that differ in the last text alone show where the text begins and ends.

``turn_template`` marks turns and escapes what could be taken for its marks, and ``read_turns``
reads its output back.

Bad and odd input: a null text or role is an empty one. Turns with equal numbers follow each other
by role and text, null numbers first; repeated rows are turns of their own. Rows without a
conversation id form one conversation. Empty tables give empty ones; extra columns don't matter. A
conversation must fit in memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]

TRAINED_ROLES = ("assistant",)
_ESCAPES = {"\\": "\\\\", "<": "\\l", ">": "\\g", "#": "\\h"}
_SPECIAL = re.compile(r"[\\<>#]")
_ESCAPED = re.compile(r"\\([\\lgh])")
_BACK = {v[1]: k for k, v in _ESCAPES.items()}
_TURN = re.compile(r"<turn ([^>]*)>\n([^<]*)\n</turn>\n")


def escape(text: str) -> str:
    """Text without any character that the marks are made of; reversible."""
    return _SPECIAL.sub(lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[1]], text)


def turn_template(turns: Turns) -> str:
    """``<turn role>``, the escaped text and ``</turn>``, on lines of their own."""
    return "".join(f"<turn {escape(role)}>\n{escape(text)}\n</turn>\n" for role, text in turns)


def read_turns(formatted: str) -> Turns:
    """The turns that turn_template wrote."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def _shared_prefix(a: str, b: str) -> int:
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


def _text_place(template: Template, before: Turns, role: str, span: int) -> tuple[int, int]:
    """Characters of a span before and after the turn's text, by two texts that share no character."""
    one, two = (template([*before, (role, probe)])[span:] for probe in "ab")
    head = _shared_prefix(one, two)
    tail = _shared_prefix(one[::-1], two[::-1])
    return head, tail


def render(template: Template, turns: Turns) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """The whole output; for each turn where its span starts, its text starts and ends, its span ends;
    and whether the template rewrote history."""
    before, spans, rewrites = template([]), [], False
    for k, (role, _) in enumerate(turns):
        after = template(turns[: k + 1])
        start = _shared_prefix(before, after)
        rewrites |= start < len(before)
        head, tail = _text_place(template, turns[:k], role, start)
        spans.append((start, start + head, max(start + head, len(after) - tail), len(after)))
        before = after
    return before, spans, rewrites


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def format_conversations(
    conversations: DataFrame,
    template: Template = turn_template,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    trained_roles: tuple[str, ...] = TRAINED_ROLES,
) -> DataFrame:
    """(id, formatted, turns, loss_spans, rewrites) per conversation.

    turns holds each turn's role and span, loss_spans the places of the trained roles' texts; both
    count characters of formatted.
    """
    kind = conversations.schema[id_col].dataType.simpleString()
    gathered = (
        conversations.select(
            F.col(id_col).alias("id"),
            F.struct(
                F.col(turn_col).alias("turn"),
                F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                F.coalesce(F.col(text_col), F.lit("")).alias("text"),
            ).alias("row"),
        )
        .groupBy("id")
        .agg(F.sort_array(F.collect_list("row")).alias("rows"))
        .select("id", F.col("rows.role").alias("roles"), F.col("rows.text").alias("texts"))
    )

    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    turn = pa.struct([("role", pa.string()), *span])

    def run(batches):
        for batch in batches:
            formatted, turns, loss, rewrites = [], [], [], []
            for roles, texts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = list(zip(roles, texts))
                output, spans, rewrote = render(template, own)
                formatted.append(output)
                turns.append([{"role": r, "start": s[0], "end": s[3]} for (r, _), s in zip(own, spans)])
                loss.append([{"start": s[1], "end": s[2]} for (r, _), s in zip(own, spans) if r in trained_roles])
                rewrites.append(rewrote)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(formatted, pa.string()), pa.array(turns, pa.list_(turn)),
                    pa.array(loss, pa.list_(span)), pa.array(rewrites, pa.bool_()),
                ],
                names=["id", "formatted", "turns", "loss_spans", "rewrites"],
            )

    return gathered.mapInArrow(
        run,
        f"id {kind}, formatted string, turns array<struct<role:string,start:long,end:long>>, "
        "loss_spans array<struct<start:long,end:long>>, rewrites boolean",
    )


def digests(formatted: DataFrame) -> DataFrame:
    """(id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from turn_template's output."""
    kind = formatted.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for output, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = read_turns(output)
                trained = "".join(unescape(output[s["start"] : s["end"]]) for s in loss)
                rows.append(
                    (len(turns), _digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(trained), _digest(trained), len(output))
                )
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    return formatted.select("id", "formatted", "loss_spans").mapInArrow(
        run,
        f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
