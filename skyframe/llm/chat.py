r"""Chat formatting by columnar byte assembly.

All turns of a batch are laid out at once: segment lengths give cumulative offsets, offsets give
scatter indices, and headers, contents and trailers are copied into one preallocated buffer that
becomes the Arrow column.  Every ``\``, ``[`` and ``<`` of a text gets a ``\`` before it, so no
text can hold a control string and every text can be read back.

=========  ====================================
role       turn
=========  ====================================
user       ``[INST] text [/INST]``
system     ``[SYS] text [/SYS]``
assistant  ``text</s>``, the text under the loss
others     ``[ROLE] name<newline>text [/ROLE]``
=========  ====================================

A conversation begins with ``<s>``.  Defined cases: null text and null role are empty strings; rows
of one conversation are ordered by turn (nulls first), then role, then text, and repeated rows are
repeated turns; a null conv_id is a conversation of its own; an empty table gives no rows; further
columns are not read.  A worker holds one batch and the conversation that crosses its end.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm.common import query, table

FORMATTED = "conv_id bigint, formatted string, loss_start array<int>, loss_length array<int>"
MARKS = {"user": (b"[INST] ", b" [/INST]"), "system": (b"[SYS] ", b" [/SYS]"), "assistant": (b"", b"</s>")}
OPENING = b"<s>"
#: Bytes that one string column of 32-bit offsets can hold.
LIMIT = 2**31 - 1
_SPECIAL = np.zeros(256, bool)
_SPECIAL[list(b"\\[<")] = True


def escape(text: str) -> str:
    return re.sub(r"[\\\[<]", r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def _marks(role: str, first: bool) -> tuple[bytes, bytes]:
    head, tail = MARKS.get(role) or (f"[ROLE] {escape(role)}\n".encode(), b" [/ROLE]")
    return (OPENING if first else b"") + head, tail


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the offset of each value."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def assemble(first: np.ndarray, roles: list[str], texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, where each turn begins and the last ends, where its content begins, content length)."""
    raw, offsets = _bytes(texts)
    special = _SPECIAL[raw]
    upto = np.concatenate([[0], np.cumsum(special)])
    kinds: dict[tuple[str, bool], int] = {}
    kind = np.fromiter((kinds.setdefault(x, len(kinds)) for x in zip(roles, first.tolist())), np.int64, len(roles))
    marks = [_marks(*x) for x in kinds]
    heads, tails = (np.array([len(m[i]) for m in marks], np.int64)[kind] for i in (0, 1))
    plain = np.diff(offsets)
    content = plain + upto[offsets[1:]] - upto[offsets[:-1]]
    begins = np.concatenate([[0], np.cumsum(heads + content + tails)])
    body = begins[:-1] + heads
    out = np.full(begins[-1], ord("\\"), np.uint8)
    where = np.repeat(body - offsets[:-1] - upto[offsets[:-1]], plain) + np.arange(len(raw)) + upto[1:]
    out[where] = raw
    for k, (head, tail) in enumerate(marks):
        rows = np.flatnonzero(kind == k)
        for at, mark in ((begins[rows], head), (body[rows] + content[rows], tail)):
            out[at[:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    return out, begins, body, content


def _conversations(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """One row per conversation of ``rows`` (conv_id, role, text), which are in order.

    Rows that might pass ``LIMIT`` when formatted are taken conversation by conversation; one that
    passes it alone is an error.
    """
    size = pc.sum(pc.binary_length(rows.column("text"))).as_py() or 0
    size += (pc.sum(pc.binary_length(rows.column("role"))).as_py() or 0) + 32 * rows.num_rows
    start = np.append(np.flatnonzero(_changes(rows.column("conv_id").combine_chunks())), rows.num_rows)
    if 2 * size <= LIMIT or len(start) <= 2:  # escaping at most doubles
        yield _formatted(rows)
    else:
        for a, b in zip(start.tolist(), start[1:].tolist()):
            yield _formatted(rows.slice(a, b - a))


def _formatted(rows: pa.Table) -> pa.RecordBatch:
    if (pc.sum(pc.binary_length(rows.column("text"))).as_py() or 0) > LIMIT:
        raise ValueError(f"conversation {rows.column('conv_id')[0].as_py()} holds more than {LIMIT} bytes")
    conv = rows.column("conv_id").combine_chunks()
    new = _changes(conv)
    roles = rows.column("role").to_pylist()
    out, begins, body, content = assemble(new, roles, rows.column("text").combine_chunks())
    if begins[-1] > LIMIT:
        raise ValueError(f"conversation {conv[0].as_py()} is longer than {LIMIT} bytes when formatted")
    start = np.flatnonzero(new)
    bounds = np.concatenate([begins[start], begins[-1:]])
    loss = np.array([r == "assistant" for r in roles], bool)
    number = np.cumsum(new) - 1
    lists = np.concatenate([[0], np.cumsum(np.bincount(number[loss], minlength=len(start)))]).astype(np.int32)
    spans = [pa.ListArray.from_arrays(pa.array(lists), pa.array(x.astype(np.int32))) for x in ((body - bounds[number])[loss], content[loss])]
    text = pa.StringArray.from_buffers(len(start), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(out))
    return pa.RecordBatch.from_arrays([conv.take(pa.array(start)), text, *spans], ["conv_id", "formatted", "loss_start", "loss_length"])


def _changes(conv: pa.Array) -> np.ndarray:
    """Whether each row begins a conversation."""
    values, valid = pc.fill_null(conv, 0).to_numpy(zero_copy_only=False), pc.is_valid(conv).to_numpy(zero_copy_only=False)
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (valid[1:] != valid[:-1])
    return new


def format_chats(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) as one text per conversation with its loss spans in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            last = int(np.flatnonzero(_changes(batch.column(0)))[-1]) if batch.num_rows else 0
            crosses = bool(waiting) and batch.num_rows and waiting[-1].column(0)[-1].as_py() == batch.column(0)[0].as_py()
            if waiting and batch.num_rows and (last or not crosses):
                yield from _conversations(pa.Table.from_batches([*waiting, batch.slice(0, last)]))
                waiting, batch = [], batch.slice(last)
            elif last:
                yield from _conversations(pa.Table.from_batches([batch.slice(0, last)]))
                batch = batch.slice(last)
            if batch.num_rows:
                waiting.append(batch)
        if waiting:
            yield from _conversations(pa.Table.from_batches(waiting))

    plain = turns.select(
        F.col("conv_id").cast("bigint"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    ordered = plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


_BODY = r"[^\\\[<]*(?:\\.[^\\\[<]*)*"
_TURN = re.compile(rf"\[INST\] ({_BODY}) \[/INST\]|\[SYS\] ({_BODY}) \[/SYS\]|\[ROLE\] ([^\n\\\[<]*(?:\\.[^\n\\\[<]*)*)\n({_BODY}) \[/ROLE\]|({_BODY})</s>", re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    at, out = len(OPENING), []
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        at = m.end()
        if m[1] is not None:
            out.append(("user", unescape(m[1])))
        elif m[2] is not None:
            out.append(("system", unescape(m[2])))
        elif m[4] is not None:
            out.append((unescape(m[3]), unescape(m[4])))
        else:
            out.append(("assistant", unescape(m[5])))
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """What each formatted conversation holds, from its text and loss spans alone."""
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, starts, lengths in zip(*(batch.column(i).to_pylist() for i in range(4))):
                turns = read_turns(text)
                raw = text.encode()
                loss = "".join(unescape(raw[s : s + n].decode()) for s, n in zip(starts, lengths))
                told = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                rows.append((conv, len(turns), told, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            if rows:
                names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return formatted.select("conv_id", "formatted", "loss_start", "loss_length").mapInArrow(run, schema)


@query("op6_chat_formatting")
def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    return read_back(format_chats(turns.unionByName(probe)))
