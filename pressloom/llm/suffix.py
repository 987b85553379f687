"""Suffix-array dedup: removing every byte covered by a repeated 200-byte string.

Bucket-pointer refinement over a sparse set of suffixes.  A bucket is named by a
64-bit content hash instead of a rank, so all tasks agree on the names and sorting
by name (Spark's shuffles) brings equal suffixes together wherever they are.

1. Initial q-gram buckets: in every window of ``length`` bytes the smallest q-gram
   hash marks an anchor, so equal windows have the same anchor at the same place.
   Windows that share an anchor are one run, a stretch of text start..end.
2. Refinement: runs of one q-gram bucket are told apart by the name of their whole
   stretch.  A q-gram bucket with a single run is done (nothing repeats); a stretch
   name met twice is done as well (all of its windows repeat).
3. Only q-gram buckets with several different stretches are refined further: each
   different stretch is read once, its window names are made from the bucket names
   of later offsets (doubling up to ``length``), and windows whose name is met twice
   repeat.  A bucket of up to BUCKET_ROWS stretches is refined in one task; the
   windows of a larger one are dealt out by their names.

Repeated windows become byte ranges per document and the bytes they cover go.

Defined cases: texts are UTF-8 bytes, matches stay inside a text; null and empty texts and texts
shorter than ``length`` lose nothing; repeated rows (also of one id) repeat each other; a null id is
a document like any other; cutting may split a character, so the kept text is bytes; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.llm.columns import Prefix, flat, mix, slices
from pressloom.llm.durable import durable, lean, release

GRAM = 32
BUCKET_ROWS = 16384


def _gram_names(data: np.ndarray, gram: int, sums: Prefix) -> np.ndarray:
    at = np.arange(max(0, len(data) - gram + 1))
    return sums.hash(at, at + gram)


def _window_anchors(names: np.ndarray, width: int) -> np.ndarray:
    """For each window of width consecutive names the place of its smallest, leftmost on ties."""
    n = len(names)
    place = np.arange(n, dtype=np.uint64)
    key = (names & ~np.uint64((1 << 22) - 1)) | place
    blocks = -(-n // width)
    pad = np.full(blocks * width, np.uint64(2**64 - 1), np.uint64)
    pad[:n] = key
    grid = pad.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(back[: n - width + 1], ahead[width - 1 : n])
    return (low & np.uint64((1 << 22) - 1)).astype(np.int64)


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int = GRAM):
    """(text index, first window, last window, q-gram name, stretch name) of every run of windows with one anchor."""
    empty = np.empty(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty, empty
    if len(data) >= 1 << 22:
        return _long_runs(data, offsets, length, gram)
    sums = Prefix(data)
    names = _gram_names(data, gram, sums)
    anchor = _window_anchors(names, length - gram + 1)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(anchor)]
    whole = np.arange(len(anchor)) + length <= ends
    new = whole.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~whole[:-1]
    last = whole.copy()
    last[:-1] &= ~whole[1:] | new[1:]
    first, last = np.flatnonzero(new), np.flatnonzero(last)
    text = np.searchsorted(offsets, first, side="right") - 1
    base = offsets[text]
    return text, first - base, last - base, names[anchor[first]].view(np.int64), sums.hash(first, last + length).view(np.int64)


def _long_runs(data, offsets, length, gram):
    """A slice with one very long text: overlapping pieces, each giving the windows that start in it."""
    parts = []
    step = 1 << 21
    for t in range(len(offsets) - 1):
        a, b = int(offsets[t]), int(offsets[t + 1])
        for at in range(a, max(b - length + 1, a), step):
            piece = data[at : min(b, at + step + length - 1)]
            _, lo, hi, name, stretch = anchor_runs(piece, np.array([0, len(piece)]), length, gram)
            parts.append((np.full(len(lo), t), lo + at - a, hi + at - a, name, stretch))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 5


def window_names(data: np.ndarray, length: int) -> np.ndarray:
    """Names of all windows of length bytes, from bucket names at doubling offsets."""
    width, name = 1, mix(data.astype(np.uint64) + np.uint64(0x51ED270B))
    while width < length:
        step = min(width, length - width)
        n = len(name) - step
        if n <= 0:
            return np.empty(0, np.uint64)
        # the bucket of a longer prefix is the pair of the bucket here and the bucket at a later offset
        name = mix(name[:n] * np.uint64(0x9FB21C651E98DF25) + name[step : step + n])
        width += step
    return name


def _runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column("key"), batch.column("text")
            for a, b in slices(texts):
                text, lo, hi, name, stretch = anchor_runs(*flat(texts.slice(a, b - a)), length)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(a, b - a).take(pa.array(text)), pa.array(lo << 16 | (hi - lo)), pa.array(name), pa.array(stretch)],
                    names=["key", "span", "gram", "stretch"],
                )

    return run


def _cut_stretches(length: int):
    """The bytes of the stretches asked for: one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, asked = batch.column("text"), batch.column("asked")
            for i in range(batch.num_rows):
                data, _ = flat(texts.slice(i, 1))
                rows = asked[i].as_py()
                body = [data[(r["span"] >> 16) : (r["span"] >> 16) + (r["span"] & 0xFFFF) + length].tobytes() for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([r[c] for r in rows], pa.int64()) for c in ("gram", "stretch", "many", "kinds")), pa.array(body, pa.binary())],
                    names=["gram", "stretch", "many", "kinds", "body"],
                )

    return run


def _named_windows(table: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name (with its q-gram bucket mixed in), row and step of every window of the stretches in table."""
    bodies = table["body"].combine_chunks().cast(pa.large_binary())
    _, offsets, data = bodies.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(bodies) + 1, bodies.offset * 8)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    names = window_names(data, length)
    n = np.diff(offsets) - length + 1
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    gram = table["gram"].to_numpy().view(np.uint64)
    return mix(names[offsets[:-1][row] + step] ^ gram[row]), row, step


def _steps_in_task(length: int):
    """Repeated windows of rows sorted by q-gram bucket; a bucket that a batch cuts waits for the next batch."""

    def resolve(table: pa.Table) -> pa.RecordBatch:
        name, row, step = _named_windows(table, length)
        many = table["many"].to_numpy()
        _, back = np.unique(name, return_inverse=True)
        twice = (np.bincount(back, many[row]) > 1)[back] & (many[row] == 1)
        n = np.bincount(row[twice], minlength=len(table))
        found = np.flatnonzero(n)
        offsets = np.r_[0, np.cumsum(n[found])].astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [table["gram"].combine_chunks().take(pa.array(found)), table["stretch"].combine_chunks().take(pa.array(found)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(step[twice].astype(np.int32)))],
            names=["gram", "stretch", "steps"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([waiting, table]) if waiting is not None else table
            if not len(table):
                continue
            gram = table["gram"].to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))
            for a, b in _groups(gram[:cut], 4096):
                yield resolve(table.slice(a, b - a))
            waiting = table.slice(cut)
        if waiting is not None and len(waiting):
            yield resolve(waiting)

    return run


def _groups(sorted_keys: np.ndarray, rows: int) -> Iterator[tuple[int, int]]:
    """Ranges of about so many rows that cut no key."""
    at = 0
    while at < len(sorted_keys):
        to = len(sorted_keys) if at + rows >= len(sorted_keys) else int(np.searchsorted(sorted_keys, sorted_keys[at + rows], side="right"))
        yield at, to
        at = to


def _windows(length: int):
    """Window names as rows, for q-gram buckets too large for one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                table = pa.Table.from_batches([batch.slice(a, 4096)])
                name, row, step = _named_windows(table, length)
                columns = [pa.array(table[c].to_numpy()[row]) for c in ("gram", "stretch", "many")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(step.astype(np.int32)), pa.array(name.view(np.int64))], names=["gram", "stretch", "many", "step", "window"])

    return run


def _covered(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of byte ranges: sorted, touching ones joined."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > ends[:-1]]
    return starts[new], np.r_[ends[:-1][new[1:]], ends[-1:]]


def repeated_ranges(docs: DataFrame, *, key_col: str, text_col: str = "text", length: int = 200) -> DataFrame:
    """key, starts, ends: for texts with repeats the byte ranges that repeated strings cover, joined and sorted."""
    texts = docs.select(F.col(key_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    texts = texts.where(F.octet_length("text") >= length)
    # span: first window << 16 | number of further windows (fewer than length)
    runs = texts.mapInArrow(lean(_runs(length)), "key long, span long, gram long, stretch long")
    grams = runs.groupBy("gram").agg(F.count("*").alias("total"), F.min("stretch").alias("lo"), F.max("stretch").alias("hi"))
    grams = grams.where("total > 1").select("gram", (F.col("lo") < F.col("hi")).alias("mixed"))
    grams = durable(grams)  # so that the join deals both sides anew and a very common q-gram is split
    runs = durable(runs.join(grams, "gram"))
    stretches = durable(
        runs.groupBy("gram", "stretch").agg(F.count("*").alias("many"), F.first("mixed").alias("mixed"), F.min(F.struct("key", "span")).alias("at"))
    )

    # Different stretches of one q-gram bucket: read each once and compare their windows.
    kinds = stretches.where("mixed").groupBy("gram").agg(F.count("*").alias("kinds"))
    asked = stretches.where("mixed").join(kinds, "gram").select("at.*", "gram", "stretch", "many", "kinds")
    asked = asked.groupBy("key").agg(F.collect_list(F.struct("span", "gram", "stretch", "many", "kinds")).alias("asked"))  # one text's own
    bodies = texts.join(asked, "key").select("text", "asked").mapInArrow(lean(_cut_stretches(length)), "gram long, stretch long, many long, kinds long, body binary")
    bodies = durable(bodies)
    schema = "gram long, stretch long, steps array<int>"
    small = bodies.where(F.col("kinds") <= BUCKET_ROWS).select("gram", "stretch", "many", "body")
    partly = small.repartition("gram").sortWithinPartitions("gram").mapInArrow(lean(_steps_in_task(length)), schema)
    large = bodies.where(F.col("kinds") > BUCKET_ROWS)
    if not large.isEmpty():  # a very common passage: its windows are dealt by their own names
        windows = durable(large.mapInArrow(lean(_windows(length)), "gram long, stretch long, many long, step int, window long"))
        twice = windows.groupBy("gram", "window").agg(F.sum("many").alias("n")).where("n > 1").select("gram", "window")
        steps = windows.where("many = 1").join(twice, ["gram", "window"]).groupBy("gram", "stretch").agg(F.collect_list("step").alias("steps"))
        partly = partly.union(steps)  # at most length steps a stretch
    hits = stretches.where("many > 1").select("gram", "stretch", F.lit(None).cast("array<int>").alias("steps")).union(partly)
    found = runs.join(hits, ["gram", "stretch"]).select("key", "span", "steps")

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            starts, ends = [], []
            for ranges in rows["ranges"]:
                s, e = [], []
                for r in ranges:
                    lo, n = r["span"] >> 16, r["span"] & 0xFFFF
                    at = lo + (np.array(r["steps"], np.int64) if r["steps"] is not None else np.arange(n + 1))
                    s.append(at)
                    e.append(at + length)
                s, e = _covered(np.concatenate(s), np.concatenate(e))
                starts.append(s)
                ends.append(e)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], names=["key", "starts", "ends"])

    ranges = found.groupBy("key").agg(F.collect_list(F.struct("span", "steps")).alias("ranges"))  # one text's own runs
    return durable(ranges.mapInArrow(lean(join_up), "key long, starts array<long>, ends array<long>"))


def kept_bytes(data: np.ndarray, starts, ends) -> bytes:
    """What is left of data without the ranges."""
    keep = np.ones(len(data) + 1, np.int32)
    keep[-1] = 0
    for a, b in zip(starts, ends, strict=True):
        keep[a:b] = 0
    return data[keep[:-1].astype(bool)].tobytes()


def with_row_keys(docs: DataFrame, id_col: str) -> DataFrame:
    """The rows with a key of their own, the same on every reading: the id where ids are distinct, else a number."""
    shared = docs.groupBy(id_col).count().where(f"count > 1 OR `{id_col}` IS NULL")
    if shared.isEmpty():
        return docs.withColumn("row_key", F.col(id_col).cast("long"))
    return durable(docs.withColumn("row_key", F.monotonically_increasing_id()))


def dedup_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes kept."""
    keyed = with_row_keys(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id")
    ranges = repeated_ranges(keyed, key_col="row_key", length=length)
    release(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            n, removed, spans, digest = [], [], [], []
            for i, (s, e) in enumerate(zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True)):
                data, _ = flat(texts.slice(i, 1))
                s, e = s or [], e or []
                n.append(len(data))
                removed.append(sum(e) - sum(s))
                spans.append(len(s))
                digest.append(hashlib.sha256(kept_bytes(data, s, e) if s else data.tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(digest, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    joined = keyed.join(ranges.withColumnRenamed("key", "row_key"), "row_key", "left").select("doc_id", "text", "starts", "ends")
    return joined.mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """The rows with repeated bytes cut from the text (undecodable remains of a split character dropped)."""
    keyed = with_row_keys(docs, id_col)
    ranges = repeated_ranges(keyed, key_col="row_key", text_col=text_col, length=length).withColumnRenamed("key", "row_key")
    release(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts, out = batch.column(at), []
            for i, (s, e) in enumerate(zip(batch.column("_starts").to_pylist(), batch.column("_ends").to_pylist(), strict=True)):
                if s:
                    out.append(kept_bytes(flat(texts.slice(i, 1))[0], s, e).decode("utf-8", "ignore"))
                else:
                    out.append(texts[i].as_py())
            columns = [pa.array(out, pa.string()) if k == at else c for k, c in enumerate(batch.columns[:-2])]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-2])

    joined = keyed.join(ranges.withColumnsRenamed({"starts": "_starts", "ends": "_ends"}), "row_key", "left")
    return joined.select(*docs.columns, "_starts", "_ends").mapInArrow(lean(run), docs.schema)
