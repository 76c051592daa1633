"""Chat formatting: turn-aligned windows under a budget, control strings escaped, targets masked once."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
BEGIN, END, BREAK = "<|im_start|>", "<|im_end|>", "<|im_break|>"
_ESCAPE, _UNESCAPE = re.compile(r"<(?=\\*\|)"), re.compile(r"<\\(?=\\*\|)")

#: Characters of formatted turns in a window, of which repeated history takes at most HISTORY.
BUDGET, HISTORY = 4096, 1024

WINDOWS = "conv_id long, part long, formatted string, mask array<struct<start: long, end: long>>, turns array<struct<first: long, last: long, repeated: boolean>>"


def escape(text: str) -> str:
    """A backslash goes into every `<|`, and one more where backslashes already stand between `<` and `|`; so no control string survives, and unescape() undoes it."""
    return _ESCAPE.sub(r"<\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub("<", text)


def turn(role: str, text: str) -> str:
    """A turn in the template. A line break in a role becomes a control string of its own, which no escaped text can hold."""
    return f"{BEGIN}{escape(role).replace(chr(10), BREAK)}\n{escape(text)}{END}\n"


def windows(turns: Iterator[tuple[str, str]], budget: int = BUDGET, history: int = HISTORY) -> Iterator[tuple[str, list, list]]:
    """(formatted, loss mask, turns) of each window of one conversation, holding no more than a window's turns.

    Prefix sums of the turns' lengths choose the spans: a window ends before the turn that would pass the budget. The first turn, if it is
    a system turn, opens every window; then come as many of the latest turns before the window as fit in `history`; then new turns, one at least.
    Only the new assistant turns are under the mask, so each is a target once. A turn past the budget is a window of its own, never cut.
    turns has (start, end, repeated) for each, in code points of formatted; repeated ones come first.
    """
    system, past, past_size = "", [], 0
    new, size, k = [], 0, 0

    def close() -> tuple[str, list, list]:
        parts, mask, marks, at = [], [], [], 0
        for role, body, repeated in [*([("system", system, True)] if system and not opened else []), *((r, b, True) for r, b in shown), *((r, b, False) for r, b in new)]:
            parts.append(body)
            marks.append((at, at + len(body), repeated))
            if role == "assistant" and not repeated:
                mask.append((at + body.index("\n") + 1, at + len(body) - len(END) - 1))
            at += len(body)
        return "".join(parts), mask, marks

    opened, shown = True, []
    for role, text in turns:
        body = turn(role, text)
        base = (0 if opened else len(system)) + sum(len(b) for _, b in shown)
        if new and base + size + len(body) > budget:
            yield close()
            opened, shown = False, []
            room = min(history, budget - len(system) - len(body))
            for r, b in reversed(past):
                if room < len(b):
                    break
                shown.insert(0, (r, b))
                room -= len(b)
            new, size = [], 0
        new.append((role, body))
        size += len(body)
        if k == 0 and role == "system":
            system = body
        else:
            past.append((role, body))
            past_size += len(body)
            while past and past_size > history:
                past_size -= len(past.pop(0)[1])
        k += 1
    if new:
        yield close()


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a window, told by its control strings alone. Text that isn't whole turns, one after the other, is an error: so no text inside a turn can pass for another one."""
    first, *parts = formatted.split(BEGIN)
    if first:
        raise ValueError("text before the first turn")
    turns = []
    for part in parts:
        body, end, rest = part.partition(END)
        role, line, text = body.partition("\n")
        if not end or rest != "\n" or not line or BREAK in text:
            raise ValueError("a turn that doesn't end where the next begins")
        turns.append((unescape(role.replace(BREAK, "\n")), unescape(text)))
    return turns


def read_back(formatted: str, mask: list, repeated: int) -> tuple[list[tuple[str, str]], list[str]]:
    """The new turns of a window, those after the `repeated` ones that open it, and the unescaped text of each masked span."""
    return parse(formatted)[repeated:], [unescape(formatted[a:b]) for a, b in mask]


def _ordered(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    return rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")


def _conversations(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[object, Iterator[tuple[str, str]]]]:
    """(conv_id, its turns) from sorted rows; turns stream, so a conversation of any length holds one batch of memory."""
    from itertools import groupby

    def rows() -> Iterator[tuple]:
        for b in batches:
            ids = [None if pd.isna(x) else int(x) for x in b["conv_id"]]
            yield from zip(ids, b["role"], b["text"], strict=True)

    for conv, own in groupby(rows(), key=lambda r: r[0]):
        yield conv, ((r, t) for _, r, t in own)


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """A row for each window: conv_id, part, formatted, mask (code point spans under the loss), turns.

    Rows go by turn, null turns first, ties by role and text; repeated rows are turns of their own. Null role or text is empty. A null conv_id is a
    conversation like any other. An empty table gives no windows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for conv, turns in _conversations(batches):
            for k, (text, mask, marks) in enumerate(windows(turns, budget, history)):
                out.append((conv, k, text, [{"start": a, "end": b} for a, b in mask], [{"first": a, "last": b, "repeated": r} for a, b, r in marks]))
                size += len(text)
                if size > 1 << 20:
                    yield pd.DataFrame(out, columns=["conv_id", "part", "formatted", "mask", "turns"]).astype({"conv_id": "Int64"})
                    out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "part", "formatted", "mask", "turns"]).astype({"conv_id": "Int64"})

    return _ordered(conversations).mapInPandas(run, WINDOWS)


def digest(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows: what is read back from the windows of each conversation."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for conv, own in _conversations(batches):
            said, loss, n, chars, size, parts = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
            for text, mask, marks in windows(own, budget, history):
                turns, targets = read_back(text, mask, sum(r for *_, r in marks))
                for role, body in turns:
                    said.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for target in targets:
                    loss.update(target.encode("utf-8", "surrogatepass"))
                n, chars, size, parts = n + len(turns), chars + sum(map(len, targets)), size + len(text), parts + 1
            out.append((conv, n, said.hexdigest(), chars, loss.hexdigest(), size, parts))
            if len(out) >= 4096:
                yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
                out = []
        if out:
            yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    return _ordered(conversations).mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
