"""Chat formatting in budgeted windows that are aligned with turns.

The template writes a turn as ``<s>[ROLE] role [TEXT] text </s>`` and a line feed, with one space on each side of role and
text; tokens end at white space, so a window has the tokens of its turns.  A
control string inside a role or text gets a backslash before it, or before the backslashes that stand before it, and
loses it on reading; so what is read back is what went in, and only the template's own control strings are bare.

A conversation becomes windows.  Prefix sums of the turns' tokens choose the longest run of turns that fits the budget
beside the leading system turn, which every window repeats, and beside a limited number of turns of history.  A turn is
new in one window only; repeats are context and are masked out of the loss, which covers the assistant's new texts.
Turns are never cut: one that is over the budget alone has a window of its own.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import tidy
from tessera.llm.tokens import encoder, text_groups, tokenizer_path

CLOSE = " </s>\n"
CONTROLS = ("<s>", "</s>", "[ROLE]", "[TEXT]", "[INST]", "[/INST]")
_ANY = "|".join(map(re.escape, CONTROLS))
_ESCAPE = re.compile(rf"(\\*(?:{_ANY}))")
_UNESCAPE = re.compile(rf"\\(\\*(?:{_ANY}))")
_BARE = re.compile(rf"(\\*)({_ANY})")

WINDOWS = (
    "conv_id long, window int, first_turn long, formatted string, n_tokens long, over_budget boolean, "
    "repeated int, loss_start array<int>, loss_end array<int>"
)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def read_turns(formatted: str) -> list[tuple[str, str, int, int]]:
    """Role, text, and where the escaped text starts and ends, of each turn of a formatted window."""
    marks = [(m.start(2), m.group(2)) for m in _BARE.finditer(formatted) if not m.group(1)]
    turns = []
    for i in range(0, len(marks), 4):
        (a, open_), (b, role), (c, text), (d, close) = marks[i : i + 4]
        if (open_, role, text, close) != ("<s>", "[ROLE]", "[TEXT]", "</s>") or b != a + 3:
            raise ValueError(f"not a turn at {a}")
        start, end = c + len("[TEXT] "), d - 1
        turns.append((unescape(formatted[b + len("[ROLE] ") : c - 1]), unescape(formatted[start:end]), start, end))
    return turns


class Turn(NamedTuple):
    role: str
    lead: str  # marks and role as they are written
    body: str  # the text as it is written
    tokens: int  # of all that is written for it


def written_turn(role: str, text: str) -> tuple[str, str]:
    return f"<s>[ROLE] {escape(role)} [TEXT] ", escape(text)


class WindowBuilder:
    """Windows of one conversation; turns are added in order, and full windows come out."""

    def __init__(self, conv_id: int | None, budget: int, history: int):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system: Turn | None = None
        self.before: list[Turn] = []  # turns of past windows, the last ``history`` of them
        self.waiting: list[Turn] = []  # new turns
        self.sums = [0]  # prefix sums of their tokens
        self.window, self.turn = 0, 0

    def fixed(self) -> int:
        return self.system.tokens if self.system and self.window else 0

    def add(self, turn: Turn) -> Iterator[tuple]:
        if not self.window and not self.waiting and turn.role == "system":
            self.system = turn
        self.waiting.append(turn)
        self.sums.append(self.sums[-1] + turn.tokens)
        while self.waiting and self.fixed() + self.sums[-1] > self.budget:
            yield self.close(max(1, bisect_right(self.sums, self.budget - self.fixed()) - 1))

    def close(self, n: int) -> tuple:
        """A window of the first ``n`` waiting turns."""
        fresh, self.waiting = self.waiting[:n], self.waiting[n:]
        tokens = self.sums[n]
        self.sums = [s - tokens for s in self.sums[n:]]
        head = [self.system] if self.system and self.window else []
        room = self.budget - self.fixed() - tokens
        # of the turns before, the longest run up to here that fits what is left
        sums = np.cumsum([t.tokens for t in reversed(self.before)]) if self.before else np.zeros(0)
        repeats = int(np.searchsorted(sums, max(room, 0), side="right"))
        shown = head + self.before[len(self.before) - repeats :] + fresh
        parts, at, starts, ends = [], 0, [], []
        for i, t in enumerate(shown):
            if t.role == "assistant" and i >= len(shown) - len(fresh):
                starts.append(at + len(t.lead))
                ends.append(at + len(t.lead) + len(t.body))
            parts += [t.lead, t.body, CLOSE]
            at += len(t.lead) + len(t.body) + len(CLOSE)
        total = sum(t.tokens for t in shown)
        row = (self.conv_id, self.window, self.turn, "".join(parts), total, total > self.budget, len(shown) - len(fresh), starts, ends)
        past = [t for t in self.before + fresh if t is not self.system]
        self.before = past[len(past) - self.history :] if self.history else []
        self.turn += len(fresh)
        self.window += 1
        return row


def token_counts(texts: list[str], tokenizer: str) -> list[int]:
    return [len(ids) // 4 for ids in encoder(tokenizer).encode_many(texts)]


def _ordered(df: DataFrame, *columns: str | Column) -> DataFrame:
    """Rows of a conversation in one partition, in order; they are read as a stream, however many they are."""
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *columns)


def format_conversations(turns: DataFrame, *, budget: int = 512, history: int = 2, tokenizer: str | None = None) -> DataFrame:
    """Windows of ``conv_id, turn, role, text`` rows: see ``WINDOWS`` for the columns.

    Rows go by turn, null first, then by role and text where turns are tied; repeated rows are turns of their own.
    Null role or text is empty; rows of null conv_id are one conversation.  ``repeated`` turns come first in a window
    and ``loss_start`` and ``loss_end`` are code point positions in ``formatted`` of the assistant texts that are new.
    ``n_tokens`` are the tokenizer's for all of ``formatted``, marks and escapes included.  Memory holds one window and
    the turns repeated.  An empty table gives none.
    """
    tokenizer = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder, rows = None, []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            convs, roles, texts = (batch.column(k).to_pylist() for k in (0, 2, 3))
            for a, b in text_groups(texts):
                made = [written_turn(r or "", t or "") for r, t in zip(roles[a:b], texts[a:b])]
                counts = token_counts([lead + body + CLOSE for lead, body in made], tokenizer)
                for conv, role, (lead, body), n in zip(convs[a:b], roles[a:b], made, counts):
                    if builder is None or builder.conv_id != conv:
                        if builder and builder.waiting:
                            rows.append(builder.close(len(builder.waiting)))
                        builder = WindowBuilder(conv, budget, history)
                    rows += builder.add(Turn(role or "", lead, body, n))
                    if len(rows) >= 512:
                        yield batch_of(rows)
                        rows = []
        if builder and builder.waiting:
            rows.append(builder.close(len(builder.waiting)))
        if rows:
            yield batch_of(rows)

    names = [f.split()[0] for f in WINDOWS.split(", ")]
    ints = pa.list_(pa.int32())
    types = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int32(), ints, ints]
    wanted = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return _ordered(wanted, "turn", "role", "text").mapInArrow(tidy(run), WINDOWS)


def read_conversations(windows: DataFrame) -> DataFrame:
    """What the windows of each conversation hold, read back from their text and loss spans.

    ``conv_id, n_turns, turns_sha256`` (role, line feed, text, line feed of each turn, repeats left out), ``loss_chars,
    loss_sha256`` (all text under the loss mask, unescaped) and ``formatted_chars``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, started, state, rows = None, False, None, []

        def close() -> tuple:
            n, turns, chars, loss, formatted = state
            return (current, n, turns.hexdigest(), chars, loss.hexdigest(), formatted)

        for batch in batches:
            for conv, formatted, repeated, starts, ends in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5))):
                if not started or conv != current:
                    if started:
                        rows.append(close())
                    current, started, state = conv, True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in read_turns(formatted)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for a, b in zip(starts, ends):
                    said = unescape(formatted[a:b])
                    state[2] += len(said)
                    state[3].update(said.encode("utf-8", "surrogatepass"))
                state[4] += len(formatted)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=names)
                rows = []
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(close(), types)], names=names)

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [f.split()[0] for f in schema.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    wanted = windows.select("conv_id", "window", "formatted", "repeated", "loss_start", "loss_end")
    return _ordered(wanted, "window").mapInArrow(tidy(run), schema)
