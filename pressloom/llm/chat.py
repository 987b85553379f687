"""Chat formatting by columnar byte assembly, with a loss mask and an exact way back.

A turn is written ``<s>role\\ntext</s>\\n``.  Control strings inside a text or role
get one backslash after their first character (``</s>`` -> ``<\\/s>``, an already
escaped one gets one more), so the markup stays unambiguous and unescaping is exact.
The loss mask is a list of byte spans, one per assistant text.

Defined cases: null text or role is empty; a null conv_id is one conversation of
its own; turns go by number, nulls first, ties by role, then text, so repeated rows
are repeated turns; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROL = r"/?s>|/?INST\]|</?SYS>>"
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)({CONTROL})")
OPEN, HEAD_END, CLOSE = b"<s>", b"\n", b"</s>\n"
FORMATTED = "conv_id long, n_turns long, formatted string, loss_start array<long>, loss_end array<long>"


def escape(texts: pa.Array) -> pa.Array:
    """Control strings get one more backslash; everything else stays."""
    return pc.replace_substring_regex(texts, rf"([<\[])(\\*)({CONTROL})", r"\1\\\2\3")


def escape_role(roles: pa.Array) -> pa.Array:
    """As escape, after backslashes and line feeds are spelled out: a role ends at the first line feed."""
    return escape(pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n"))


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The column's bytes, and where each value starts and how long it is."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data, offsets[:-1], np.diff(offsets)


def _scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Copies value i, data[start[i]:start[i] + length[i]], to out[to[i]:] for every i at once."""
    total = int(length.sum())
    if not total:
        return
    begin = np.cumsum(length) - length
    step = np.arange(total) - np.repeat(begin, length)
    out[np.repeat(to, length) + step] = data[np.repeat(start, length) + step]


def assemble(conv: pa.Array, role: pa.Array, text: pa.Array) -> pa.RecordBatch:
    """Whole conversations, sorted by conversation and turn, into one preallocated buffer."""
    n = len(conv)
    role = pc.fill_null(role, "")
    is_loss = pc.equal(role, "assistant").to_numpy(zero_copy_only=False)
    parts = [_bytes_of(escape_role(role)), _bytes_of(escape(pc.fill_null(text, "")))]
    fixed = [(np.frombuffer(x, np.uint8), np.zeros(n, np.int64), np.full(n, len(x))) for x in (OPEN, HEAD_END, CLOSE)]
    segments = [fixed[0], parts[0], fixed[1], parts[1], fixed[2]]
    lengths = np.stack([s[2] for s in segments], axis=1).astype(np.int64)
    ends = np.cumsum(lengths.ravel()).reshape(n, len(segments))
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]), np.uint8)
    for i, (data, start, length) in enumerate(segments):
        _scatter(out, starts[:, i], data, start, length)

    valid = pc.is_valid(conv).to_numpy(zero_copy_only=False)
    ids = pc.fill_null(conv, 0).to_numpy(zero_copy_only=False)  # filled first: ids with nulls would become floats
    first = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (valid[1:] != valid[:-1])])
    turns = np.diff(np.r_[first, n])
    if len(out) >= 1 << 31:
        raise OverflowError(f"a conversation of {len(out)} formatted bytes is beyond the 2 GiB that a value can hold")
    offsets = np.r_[starts[first, 0], len(out)].astype(np.int32)
    text_array = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(out)])
    base = np.repeat(starts[first, 0], turns)
    loss_at = np.r_[0, np.cumsum(np.add.reduceat(is_loss.astype(np.int64), first))].astype(np.int32)
    spans = [pa.ListArray.from_arrays(pa.array(loss_at), pa.array((x[:, 3] - base)[is_loss])) for x in (starts, ends)]
    return pa.RecordBatch.from_arrays(
        [conv.take(pa.array(first)), pa.array(turns), text_array, *spans],
        names=["conv_id", "n_turns", "formatted", "loss_start", "loss_end"],
    )


#: Text bytes of the conversations in one output batch, whose offsets have 32 bits; escapes can make texts longer.
BATCH_BYTES = 1 << 28


def _runs(table: pa.Table, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Row ranges of whole conversations of about limit bytes together; a longer conversation stands alone."""
    conv = pc.fill_null(table["conv_id"], -(1 << 62)).to_numpy()
    size = pc.fill_null(pc.binary_length(table["text"]), 0).to_numpy() + pc.fill_null(pc.binary_length(table["role"]), 0).to_numpy()
    first = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
    before, stop = np.r_[0, np.cumsum(size)], np.r_[first[1:], len(conv)]
    a = 0
    while a < len(conv):
        to = stop[stop > a]
        fits = to[before[to] - before[a] <= (limit or BATCH_BYTES)]
        b = int(fits[-1] if len(fits) else to[0])
        yield a, b
        a = b


def _assemble_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feeds assemble with whole conversations; the last one of a batch waits for the next batch."""
    waiting: list[pa.RecordBatch] = []

    def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for a, b in _runs(table):
            part = table.slice(a, b - a).combine_chunks()
            yield assemble(*(part[c].combine_chunks() if part[c].num_chunks != 1 else part[c].chunk(0) for c in ("conv_id", "role", "text")))

    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(batch.schema.get_field_index("conv_id"))
        last = conv[len(conv) - 1].as_py()
        same = pc.is_null(conv) if last is None else pc.fill_null(pc.equal(conv, last), False)
        cut = len(conv) - int(pc.sum(same).as_py())
        if cut or (waiting and waiting[-1].column("conv_id")[-1].as_py() != last):
            done = [*waiting, batch.slice(0, cut)] if cut else waiting
            yield from flush(pa.Table.from_batches(done))
            waiting = []
        waiting.append(batch.slice(cut))
    if waiting:
        yield from flush(pa.Table.from_batches(waiting))


def format_chats(chats: DataFrame, *, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """One row per conversation: the formatted text and the byte spans under the loss mask."""
    rows = chats.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"),
    )
    return (
        rows.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
        .mapInArrow(_assemble_sorted, FORMATTED)
    )


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation, (role, text) each."""
    close, turns = CLOSE.decode(), []
    for piece in formatted.split(close)[:-1]:
        role, _, text = piece[len(OPEN) :].partition("\n")
        turns.append((unescape_role(role), unescape(text)))
    return turns


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            turns, loss, chars, raw = hashlib.sha256(), hashlib.sha256(), 0, r["formatted"].encode()
            found = parse(r["formatted"])
            for role, text in found:
                turns.update(f"{role}\n{text}\n".encode())
            for a, b in zip(r["loss_start"], r["loss_end"], strict=True):
                text = unescape(raw[a:b].decode())
                chars += len(text)
                loss.update(text.encode())
            rows.append((r["conv_id"], len(found), turns.hexdigest(), chars, loss.hexdigest(), len(r["formatted"])))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True)],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )


def chat_digests(formatted: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives, per conversation."""
    return formatted.mapInArrow(
        _digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
