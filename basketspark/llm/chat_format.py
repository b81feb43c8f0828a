"""Chat formatting: conversations as token-budgeted training windows with loss masks.

A window is a span of whole turns that fits the budget, after the conversation's system turn and a limited number of
tokens of the turns before the span, which are repeated for context. Only assistant turns inside the span are targets;
what is repeated is masked, so over all windows each assistant turn is a target once. Prefix sums of the turns' tokens
choose the spans and the history.

The template writes a turn as ``<|role|>`` + newline + text + ``<|end|>`` + newline. In texts and roles every ``<|``
and every backslash gets a backslash in front, which is undone by :func:`unescape`, so no text can look like markup.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUDGET = 512
HISTORY = 128
TARGET = "assistant"
SYSTEM = "system"

_SPECIAL = re.compile(r"\\|<\|")
_ESCAPED = re.compile(r"\\(\\|<\|)")
_TURN = re.compile(r"<\|((?:[^\\|]|\\<\||\\\\|\|(?!>))*)\|>\n((?:[^\\<]|\\<\||\\\\|<(?!\|))*)<\|end\|>\n")


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


class Turn(NamedTuple):
    role: str
    text: str
    tokens: int


def render(turn: Turn) -> tuple[str, int, int]:
    """The formatted turn and where its text begins and ends in it."""
    head = f"<|{escape(turn.role)}|>\n"
    body = escape(turn.text)
    return f"{head}{body}<|end|>\n", len(head), len(head) + len(body)


class Window(NamedTuple):
    """Formatted text, number of its leading turns that are repeated, and loss spans (begin, end) in code points."""

    text: str
    repeated: int
    loss: list[tuple[int, int]]


def windows(turns: Iterator[Turn], budget: int, history: int) -> Iterator[Window]:
    """Windows of one conversation, in order, holding no more than a window and its history at a time.

    A first turn by ``SYSTEM`` opens every window. A span is closed when the next turn would exceed the budget
    together with the system turn and the history; a turn that is too long by itself is a span of its own, whole.
    """
    system: Turn | None = None
    past: list[Turn] = []  # the latest turns before the span that fit the history
    span: list[Turn] = []
    used = 0
    first = True

    def close() -> Window:
        nonlocal past, used
        text, loss, at = [], [], 0
        lead = ([system] if system and not opening else []) + past
        for k, turn in enumerate(lead + span):
            out, begin, end = render(turn)
            if k >= len(lead) and turn.role == TARGET and end > begin:
                loss.append((at + begin, at + end))
            text.append(out)
            at += len(out)
        rest = [t for t in past + span if t is not system]
        total, keep = 0, len(rest)
        while keep and total + rest[keep - 1].tokens <= history:
            keep -= 1
            total += rest[keep].tokens
        past = rest[keep:]
        done = Window("".join(text), len(lead), loss)
        span.clear()
        used = (system.tokens if system else 0) + total
        return done

    opening = True
    for turn in turns:
        if first and turn.role == SYSTEM:
            system = turn
        first = False
        if span and used + turn.tokens > budget:
            yield close()
            opening = False
            while past and used + turn.tokens > budget:  # history gives way to a long turn
                used -= past.pop(0).tokens
        span.append(turn)
        used += turn.tokens
    if span:
        yield close()


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, begin, end) of the turns of a formatted window; begin and end bound the text as written."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return out


_WINDOW = "conv_id long, window long, text string, repeated long, loss array<struct<begin:long,end:long>>"


def _format(budget: int, history: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b, i) for b in batches for i in range(b.num_rows))
        cur: list = [None]

        def step() -> None:
            got = next(rows, None)
            cur[0] = None if got is None else tuple(c[got[1]].as_py() for c in got[0].columns)

        def conversation(key) -> Iterator[Turn]:
            while cur[0] is not None and cur[0][0] == key:
                _, role, text, tokens = cur[0]
                yield Turn(role, text, tokens)
                step()

        step()
        cols: list[list] = [[] for _ in range(5)]
        size = 0
        while cur[0] is not None:
            key = cur[0][0]
            for k, w in enumerate(windows(conversation(key), budget, history)):
                loss = [{"begin": a, "end": b} for a, b in w.loss]
                for c, v in zip(cols, (key, k, w.text, w.repeated, loss), strict=True):
                    c.append(v)
                size += len(w.text)
                if size > 1 << 21:
                    yield _batch(cols)
                    cols, size = [[] for _ in range(5)], 0
        yield _batch(cols)

    return run


def _batch(cols: list[list]) -> pa.RecordBatch:
    spans = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), spans)
    arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=["conv_id", "window", "text", "repeated", "loss"])


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def format_chats(
    turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=word_count, conv_col: str = "conv_id",
    turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """(conv_id, window, text, repeated, loss) in order within each partition; ``tokens`` counts a turn's tokens.

    Turns are ordered by turn number (null first), role and text, so repeated rows are turns like any other. A null
    text or role is empty; rows with a null conversation form one conversation. Other columns are ignored, and an
    empty table has no windows. Turns are dealt by conversation and streamed in order, one window in memory; a
    conversation with a large share of all turns is read by one task, as its windows follow one another.
    """
    text, role = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(role_col), F.lit(""))
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")
    ).withColumn("tokens", tokens(F.col("text")) + 1)
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    return dealt.mapInArrow(_format(budget, history), _WINDOW)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    done: list[tuple] = []
    key, state = None, None

    def close() -> None:
        n, turns, chars, loss, total = state
        done.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), total))

    def out() -> pa.RecordBatch:
        cols = list(zip(*done, strict=True)) if done else [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    for batch in batches:
        for conv, text, repeated, loss in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
            if state is None or conv != key:
                if state is not None:
                    close()
                key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, body, _, _ in parse(text)[repeated:]:
                state[0] += 1
                state[1].update(f"{role}\n{body}\n".encode())
            for s in loss:
                target = unescape(text[s["begin"] : s["end"]])
                state[2] += len(target)
                state[3].update(target.encode())
            state[4] += len(text)
        yield out()
        done.clear()
    if state is not None:
        close()
        yield out()


def chat_digest(formatted: DataFrame) -> DataFrame:
    """What :func:`format_chats` wrote, read back: turns and loss texts of each conversation, and characters written.

    Uses the order in which the windows come, so ``formatted`` must be its direct result.
    """
    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.mapInArrow(_digest, kinds)
