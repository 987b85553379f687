"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word's adjacent pairs are the leaves of a segment tree holding (rank, position);
the root yields the leftmost pair of lowest rank, a merge changes three leaves, and
each change walks up the tree.  Words of like length run side by side in numpy, one
tree per row, until no root holds a mergeable pair.  A worker keeps the encodings of
words it has met in a bounded cache.

The vocabulary file (tokenizers' JSON with word-end BPE) is a parameter.  Special
tokens in a text become their ids, as the library does by default; the text between
them is NFC-normalised, lower-cased and split by the file's pattern.

Defined cases: a null text is empty; an empty text has no tokens and decodes to "";
a word of any length is encoded whole; repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.llm.durable import lean
from tokenizers import Tokenizer

CACHE_WORDS = 300_000
SLICE_CHARS = 1 << 20
NONE = np.int64(1) << 62
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RARE = regex.compile(r"[^\x00-\u024f\u0391-\u03c9\u0400-\u045f\u2010-\u2027\u2030-\u205e\u20ac\u2122\u3000-\u3002\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e]").search


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    sign = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [sign[b] for b in range(256)]


class WordBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        suffix = spec["model"]["end_of_word_suffix"]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", WHITE)
        self.find = regex.compile(pattern).findall
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split
        signs = byte_alphabet()
        self.byte_of = {s: b for b, s in enumerate(signs)}
        self.file = Tokenizer.from_file(path)  # its normaliser and splitter, for rare characters only
        self.first_ids = np.array([vocab[s] for s in signs], np.int64)
        self.last_ids = np.array([vocab[s + suffix] for s in signs], np.int64)
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in special.items()}
        self.names = np.array([names.get(i, "") for i in range(max(names) + 1)], dtype=object)
        self._table(merges, vocab)
        self.cache: dict[str, bytes] = {t: i.to_bytes(4, "little") for t, i in special.items()}

    def _table(self, merges: list, vocab: dict) -> None:
        """Open addressing from a pair of ids to its rank; probes is the longest chain."""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.bits = 20
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, -1, np.int64)
        self.probes = 1
        for rank, (a, b) in enumerate(pairs):
            key = vocab[a] << 20 | vocab[b]
            at, n = int(self._slot(np.array([key]))[0]), 1
            while self.keys[at] >= 0 and self.keys[at] != key:
                at, n = (at + 1) & ((1 << self.bits) - 1), n + 1
            if self.keys[at] != key:
                self.keys[at], self.ranks[at] = key, rank
            self.probes = max(self.probes, n)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, -1 where there is no merge."""
        key = (left << 20) | right
        at = self._slot(key)
        out = np.where(self.keys[at] == key, self.ranks[at], -1)
        for _ in range(self.probes - 1):
            at = (at + 1) & ((1 << self.bits) - 1)
            out = np.where(self.keys[at] == key, self.ranks[at], out)
        return out

    def _merge_rows(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Merges every row (a word's ids, padded) in place to the end; merged-away places become -1."""
        rows, width = symbols.shape
        leaves = 1 << max(0, int(width - 1).bit_length())
        shift = np.int64(leaves.bit_length())
        place = np.arange(leaves, dtype=np.int64)
        tree = np.full((rows, 2 * leaves), NONE, np.int64)
        if width > 1:
            inside = np.arange(width - 1)[None, :] < (lengths - 1)[:, None]
            rank = self._rank(np.maximum(symbols[:, :-1], 0), np.maximum(symbols[:, 1:], 0))
            tree[:, leaves : leaves + width - 1] = np.where(inside & (rank >= 0), (rank << shift) | place[None, : width - 1], NONE)
        level = leaves
        while level > 1:
            level //= 2
            np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2], out=tree[:, level : 2 * level])
        after = np.broadcast_to(np.arange(1, width + 1), (rows, width)).copy()
        after[after >= lengths[:, None]] = -1
        before = np.broadcast_to(np.arange(-1, width - 1), (rows, width)).copy()

        def put(row: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            node = leaf + leaves
            tree[row, node] = value
            for _ in range(leaves.bit_length() - 1):
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        active = np.flatnonzero(tree[:, 1] < NONE)
        while len(active):
            root = tree[active, 1]
            i = root & ((np.int64(1) << shift) - 1)
            j = after[active, i]
            symbols[active, i] = self.merged[root >> shift]
            symbols[active, j] = -1
            n = after[active, j]
            after[active, i] = n
            has_n = n >= 0
            before[active[has_n], n[has_n]] = i[has_n]
            put(active, j, np.full(len(active), NONE))
            rank = np.where(has_n, self._rank(symbols[active, i], np.maximum(symbols[active, np.maximum(n, 0)], 0)), -1)
            put(active, i, np.where(rank >= 0, (rank << shift) | i, NONE))
            p = before[active, i]
            has_p = p >= 0
            row, p, i = active[has_p], p[has_p], i[has_p]
            rank = self._rank(symbols[row, p], symbols[row, i])
            put(row, p, np.where(rank >= 0, (rank << shift) | p, NONE))
            active = active[tree[active, 1] < NONE]
        return symbols

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        out: list[bytes] = [b""] * len(words)
        order = np.argsort(sizes, kind="stable")
        start = int(np.searchsorted(sizes[order], 1))
        while start < len(order):
            width = int(sizes[order[start]])
            limit = max(width, 4)
            limit = 1 << (limit - 1).bit_length()
            stop = int(np.searchsorted(sizes[order], limit, side="right"))
            stop = min(stop, start + max(1, (1 << 19) // limit))
            rows = order[start:stop]
            width = int(sizes[rows[-1]])
            flat = np.frombuffer(b"".join(raw[k].ljust(width, b"\0") for k in rows), np.uint8).reshape(len(rows), width)
            lengths = sizes[rows]
            symbols = self.first_ids[flat]
            symbols[np.arange(width)[None, :] >= lengths[:, None]] = -1
            symbols[np.arange(len(rows)), lengths - 1] = self.last_ids[flat[np.arange(len(rows)), lengths - 1]]
            symbols = self._merge_rows(symbols, lengths)
            keep = symbols >= 0
            ends = np.cumsum(keep.sum(axis=1)) * 4
            data = symbols[keep].astype("<u4").tobytes()
            at = 0
            for k, end in zip(rows.tolist(), ends.tolist(), strict=True):
                out[k], at = data[at:end], end
            start = stop
        return out

    def words(self, text: str) -> list[str]:
        """The pre-tokenised words of a text without special tokens."""
        if not text.isascii():
            if RARE(text):  # characters whose tables differ between Unicode versions: the file's own rules decide
                return self._words_by_file(text)
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.find(text.lower())

    def _words_by_file(self, text: str) -> list[str]:
        pieces = self.file.pre_tokenizer.pre_tokenize_str(self.file.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, piece)).decode() for piece, _ in pieces]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        pieces: list[list[str]] = []
        for text in texts:
            if any(s in text for s in self.special):
                row: list[str] = []
                for part in self.split_special(text):
                    row += [part] if part in self.special else self.words(part)
                pieces.append(row)
            else:
                pieces.append(self.words(text))
        needed = set().union(*pieces)
        new = list(needed.difference(self.cache))
        if len(self.cache) + len(new) > CACHE_WORDS:
            # No word mixes letters and signs as the special tokens do, so they can share the cache.
            self.cache = {t: i.to_bytes(4, "little") for t, i in self.special.items()}
            new = list(needed.difference(self.cache))
        self.cache.update(zip(new, self.encode_words(new), strict=True))
        find = self.cache.__getitem__
        return [b"".join(map(find, row)) for row in pieces]

    def decode(self, ids: bytes) -> str:
        """The text of ids: the vocabulary's entries joined by spaces, special tokens kept."""
        return " ".join(self.names[np.frombuffer(ids, "<u4")])


@functools.lru_cache(maxsize=2)
def codec(path: str) -> WordBpe:
    """One codec a worker and file."""
    return WordBpe(path)


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, list[str]]]:
    """(from, to, texts) of rows that hold about SLICE_CHARS characters together; null is empty."""
    texts = batch.column(column)
    sizes = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        base = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + SLICE_CHARS, side="right")))
        yield at, to, [t or "" for t in texts.slice(at, to - at).to_pylist()]
        at = to


def encode_texts(docs: DataFrame, path: str, *, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """The input with one more column: the ids of its text as array<int>."""

    def run(batches):
        bpe = codec(path)
        for batch in batches:
            ids: list[bytes] = []
            for _, _, texts in text_slices(batch, text_col):
                ids += bpe.encode(texts)
            offsets = np.r_[0, np.cumsum([len(x) // 4 for x in ids])].astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), values)], names=[*batch.schema.names, ids_col])

    from pyspark.sql import types as T

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def bpe_digests(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text; one row each: id, n_tokens and the SHA-256 of ids and decoded text."""

    def run(batches):
        bpe = codec(path)
        for batch in batches:
            count, of_ids, of_text = [], [], []
            for _, _, texts in text_slices(batch, "text"):
                for ids in bpe.encode(texts):
                    count.append(len(ids) // 4)
                    of_ids.append(hashlib.sha256(ids).hexdigest())
                    of_text.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
