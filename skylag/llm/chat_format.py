"""Chat formatting by columnar byte assembly (operator 8).

Turns of a conversation are joined, in order of ``turn``, into one training text under a template with control strings.
For a whole Arrow batch the lengths of all segments, their cumulative offsets and the places of every byte are
computed in numpy, and headers, escaped contents and footers are copied into one preallocated buffer, which becomes the
string column. Texts are escaped reversibly: a backslash is put before every ``\\``, ``<`` and ``[``, so that no text can
hold a control string. The loss mask lists, in code points, the stretches of assistants' texts.

A conversation whose text grows beyond ``PART_BYTES`` is returned in several numbered parts, so no task holds it whole.
Null texts and roles are empty; unknown roles get a header with their name. Turns that are null come first, and equal
turns follow each other by role, then text; repeated rows are repeated turns. A null conv_id is a conversation
of its own. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skylag.llm.words import sliced, text_bytes

PART_BYTES = 16 << 20
BEGIN = b"<s>"
TURNS = {"user": (b"[INST] ", b" [/INST]"), "assistant": (b"", b"</s>"), "system": (b"<<SYS>>", b"<</SYS>>")}
FORMATTED = "conv_id bigint, part int, formatted string, n_turns int, loss array<struct<start: int, end: int>>"
READ_BACK = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
             "formatted_chars bigint")
_ESCAPED = np.zeros(256, bool)
_ESCAPED[list(b"\\<[")] = True
# A turn: header, content in which nothing stands unescaped, footer. All repetitions are possessive.
_TURN = re.compile(r"(\[INST\] |<<SYS>>|<role (?:[^\\<>\[]|\\.)*+>|)((?:[^\\<\[]++|\\.)*+)(\[/INST\]|<</SYS>>|</role>|</s>)", re.S)


def _role_parts(role: str) -> tuple[bytes, bytes]:
    if role in TURNS:
        return TURNS[role]
    return b"<role " + re.sub(r"([\\<>\[])", r"\\\1", role).encode() + b">", b"</role>"


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of the ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def assemble(roles: list[str], texts: pa.Array, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with the segments of all turns; byte offsets; per turn its characters, those before and those of the content."""
    contents = list(text_bytes(texts))
    sizes = np.array([len(c) for c in contents], np.int64)
    data = np.concatenate(contents) if len(contents) else np.empty(0, np.uint8)
    starts = np.cumsum(sizes) - sizes
    marks = _ESCAPED[data]
    before_marks = np.concatenate([[0], np.cumsum(marks)])
    escaped = sizes + before_marks[starts + sizes] - before_marks[starts]

    kinds = sorted(set(roles))
    code = np.array([kinds.index(r) for r in roles], np.int64) * 2 + first  # with or without the beginning
    parts = [_role_parts(r) for r in kinds]
    heads = [h for head, _ in parts for h in (head, BEGIN + head)]
    feet = [f for _, foot in parts for f in (foot, foot)]

    def pool(pieces):
        lengths = np.array([len(p) for p in pieces], np.int64)
        return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(lengths) - lengths, lengths

    head_data, head_at, head_len = pool(heads)
    foot_data, foot_at, foot_len = pool(feet)
    heads_n, feet_n = head_len[code], foot_len[code]
    ends = np.cumsum(heads_n + escaped + feet_n)
    begins = ends - (heads_n + escaped + feet_n)
    buffer = np.full(int(ends[-1]) if len(ends) else 0, ord("\\"), np.uint8)
    buffer[_spread(begins, heads_n)] = head_data[_spread(head_at[code], heads_n)]
    # A byte moves by the escapes up to and including its own; the byte before an escaped one is the backslash.
    shift = before_marks[1:] - np.repeat(before_marks[starts], sizes)
    buffer[_spread(begins + heads_n, sizes) + shift] = data
    buffer[_spread(begins + heads_n + escaped, feet_n)] = foot_data[_spread(foot_at[code], feet_n)]
    lead = np.concatenate([[0], np.cumsum((buffer & 0xC0) != 0x80)])
    chars, head_chars = lead[ends] - lead[begins], lead[begins + heads_n] - lead[begins]
    return buffer, np.concatenate([[0], ends]), chars, head_chars, chars - head_chars - (lead[ends] - lead[ends - feet_n])


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to parts. Turns of a conversation that may go on wait for the next batch."""
    waiting: pa.RecordBatch | None = None
    part, open_id = 0, None  # of the conversation that was cut last

    def emit(batch: pa.RecordBatch, cut: bool) -> pa.RecordBatch:
        """All of ``batch``; ``cut``: its last conversation goes on."""
        nonlocal part, open_id
        ids = batch.column("conv_id").to_pylist()
        bounds = [0, *(k for k in range(1, len(ids)) if ids[k] != ids[k - 1]), len(ids)]
        groups = [(a, b) for a, b in zip(bounds, bounds[1:])]
        numbers = [0] * len(groups)
        if part and open_id == (ids[0],):
            numbers[0] = part
        first = np.zeros(len(ids), np.int64)
        first[[a for (a, _), n in zip(groups, numbers) if n == 0]] = 1
        roles = [r or "" for r in batch.column("role").to_pylist()]
        buffer, offsets, chars, head, content = assemble(roles, batch.column("text"), first)
        places = np.concatenate([[0], np.cumsum(chars)])
        loss = [[{"start": int(places[k] - places[a] + head[k]), "end": int(places[k] - places[a] + head[k] + content[k])}
                 for k in range(a, b) if roles[k] == "assistant"] for a, b in groups]
        edges = offsets[bounds].astype(np.int32)
        formatted = pa.Array.from_buffers(pa.string(), len(groups), [None, pa.py_buffer(edges), pa.py_buffer(buffer)])
        part, open_id = (numbers[-1] + 1, (ids[-1],)) if cut else (0, None)
        return pa.RecordBatch.from_arrays(
            [pa.array([ids[a] for a, _ in groups], pa.int64()), pa.array(numbers, pa.int32()), formatted,
             pa.array([b - a for a, b in groups], pa.int32()),
             pa.array(loss, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
            names=["conv_id", "part", "formatted", "n_turns", "loss"])

    for batch in sliced(batches, "text"):
        if waiting is not None:
            batch = pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
        ids = batch.column("conv_id").to_pylist()
        last = len(ids) - 1
        while last and ids[last - 1] == ids[-1]:
            last -= 1
        waiting = batch.slice(last)
        if last:
            yield emit(batch.slice(0, last), False)
        if sum(len(t) for t in text_bytes(waiting.column("text"))) >= PART_BYTES:
            yield emit(waiting, True)
            waiting = None
    if waiting is not None:
        yield emit(waiting, False)


def format_conversations(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) to conversations: ``FORMATTED``, one row each or several numbered parts."""
    ordered = (turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text")
               .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"))
    return ordered.drop("turn").mapInArrow(_format, FORMATTED)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """Roles and original texts of a formatted part."""
    at = len(BEGIN) if formatted.startswith(BEGIN.decode()) else 0
    while at < len(formatted):
        turn = _TURN.match(formatted, at)
        if not turn:
            raise ValueError(f"no turn at {at}")
        head, content, foot = turn.groups()
        role = {"[INST] ": "user", "<<SYS>>": "system", "": "assistant"}.get(head)
        yield unescape(head[6:-1]) if role is None else role, unescape(content[:-1] if role == "user" else content)
        at = turn.end()


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state: dict | None = None

    def closed(s):
        return [s["id"], s["turns"], s["all"].hexdigest(), s["loss_n"], s["loss"].hexdigest(), s["chars"]]

    for batch in sliced(batches, "formatted"):
        done = []
        for row in batch.to_pylist():
            if state is None or state["id"] != row["conv_id"]:
                if state is not None:
                    done.append(closed(state))
                state = {"id": row["conv_id"], "turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(),
                         "loss_n": 0, "chars": 0}
            for role, text in parse(row["formatted"]):
                state["all"].update(f"{role}\n{text}\n".encode())
                state["turns"] += 1
            for span in row["loss"]:
                text = unescape(row["formatted"][span["start"]:span["end"]])
                state["loss"].update(text.encode())
                state["loss_n"] += len(text)
            state["chars"] += len(row["formatted"])
        yield _rows(done)
    if state is not None:
        yield _rows([closed(state)])


def _rows(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations hold, parsed from their text and loss mask: ``READ_BACK``."""
    ordered = (formatted.select("conv_id", "part", "formatted", "loss")
               .repartition("conv_id").sortWithinPartitions("conv_id", "part"))
    return ordered.mapInArrow(_read_back, READ_BACK)
