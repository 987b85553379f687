"""Phrase collocations by vertical positional inverted lists.

Texts are read in blocks.  A block numbers its words, with a gap between pieces, and
keeps for each word the list of its positions.  A phrase's list is extended by joining
its positions with the postings of the words right behind them; what comes out, sorted
by (phrase, word), are the lists of the longer phrases, and the length of a list is the
phrase's exact frequency in the block.  Spark adds the lengths up over all blocks, and
phrases of the minimum frequency go on to the next length: a phrase is only extended if
it and its own tail are frequent.

What is frequent reaches the blocks as a bit set of phrase hashes of fixed largest size
(FILTER_BITS, 32 MB).  It only saves work: a false hit leaves one more list to be counted
and dropped by its exact total, so results rest on phrases as text and on exact sums.
Lists are made anew from the texts for each length, so no state has to outlive an executor.

Cuts, scores and the dropping of phrases inside longer ones are joins on phrases; scores
are exact decimals.  The first rows of a language are found in parts first.

Defined cases: null texts are empty; a null language is "und"; languages differ by exact
string; repeated rows count each; words are bytes of UTF-8 between spaces and tabs, of any
length; an empty table, or one without frequent phrases, gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressloom.llm.columns import LOWER, ORDER_CODES, Prefix, flat, mix, slices, word_hashes
from pressloom.llm.durable import durable, lean, release

BLOCK_BYTES = 8 << 20
PIECE = 1 << 16  # phrases in one batch that a block hands on
FILTER_BITS = 1 << 28
SEGMENT = 1 << 20  # bytes of the filter in one row
COUNTED = "lang string, phrase string, n long"
#: What parts words, and what parts pieces: . , ; : ! ? and 0A to 0D.
GAP, BREAK = np.zeros(256, bool), np.zeros(256, bool)
GAP[[0x20, 0x09]] = True
BREAK[[0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class Postings:
    """The words of a block: their texts, the word at each place, and positions that skip one between pieces."""

    def __init__(self, texts: pa.Array):
        data, offsets = flat(texts)
        data = LOWER[data]
        broken = BREAK[data]
        inside = ~(broken | GAP[data])
        head = inside.copy()
        if len(data):
            head[1:] &= ~inside[:-1]
            first_bytes = offsets[:-1][offsets[:-1] < len(data)]
            head[first_bytes] = inside[first_bytes]
            broken[first_bytes] |= True  # a new text is a new piece, whether or not its first byte is a word
        starts = np.flatnonzero(head)
        kind = np.int32 if len(data) < 1 << 31 else np.int64
        # words lie one behind the other once the rest is cut out
        bounds = np.append(np.cumsum(inside, dtype=kind)[starts] - 1, inside.sum()).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data[inside]))
        coded = pc.dictionary_encode(words)
        self.words = coded.dictionary
        self.word = coded.indices.to_numpy()  # 32 bits, as all numbers of words in a block
        self.position = np.cumsum(broken, dtype=kind)[starts]
        self.position += np.arange(len(starts), dtype=kind)
        body, at = flat(self.words)
        self.hash = Prefix(body).hash(at[:-1], at[1:]) if len(self.words) else np.empty(0, np.uint64)


class Lists:
    """Positional lists of phrases of one length, one behind the other: entry e is an occurrence at place[e]."""

    def __init__(self, words: np.ndarray, name: np.ndarray, place: np.ndarray, sums: np.ndarray):
        self.words = words  # phrase -> its words
        self.name = name  # entry -> phrase, in order
        self.place = place  # entry -> place of the first word, in order within a phrase
        self.sums = sums  # phrase -> hash sum of its words

    @classmethod
    def of_words(cls, p: Postings) -> Lists:
        order = np.argsort(p.word, kind="stable").astype(np.int32)
        return cls(np.arange(len(p.words), dtype=np.int32)[:, None], p.word[order], order, p.hash * ORDER_CODES[0])

    def lengths(self) -> np.ndarray:
        return np.bincount(self.name, minlength=len(self.words))

    def kept(self, filter_bits: np.ndarray) -> Lists:
        """Without the lists of phrases that are not frequent."""
        keep = holds(filter_bits, mix(self.sums))
        back = np.cumsum(keep, dtype=np.int32) - 1
        entries = keep[self.name]
        return Lists(self.words[keep], back[self.name[entries]], self.place[entries], self.sums[keep])

    def extended(self, p: Postings) -> Lists:
        """The lists one word longer: positions joined with the postings right behind them.

        An entry goes on if the word behind it is in the same piece and the tail of the new
        phrase, the phrase that starts one place later, has a list as well.
        """
        size = self.words.shape[1]
        there = np.zeros(len(p.word) + 1, bool)
        there[self.place] = True
        behind = self.place + size
        ok = (behind < len(p.word)) & there[self.place + 1]
        at, name, behind = self.place[ok], self.name[ok], behind[ok]
        ok = p.position[behind] == p.position[at] + size
        at, name, word = at[ok], name[ok], p.word[behind[ok]]
        key = name.astype(np.int64) * max(1, len(p.words)) + word
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        old, word = key[fresh] // max(1, len(p.words)), key[fresh] % max(1, len(p.words))
        return Lists(np.column_stack([self.words[old], word.astype(np.int32)]), np.cumsum(fresh, dtype=np.int32) - 1, at, self.sums[old] + p.hash[word] * ORDER_CODES[size])

    def texts(self, p: Postings, a: int = 0, b: int | None = None) -> pa.Array:
        parts = [p.words.take(pa.array(self.words[a:b, j])) for j in range(self.words.shape[1])]
        return pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if len(parts) > 1 else parts[0]


def holds(filter_bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(8 * len(filter_bits) - 1)
    return (filter_bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _counted(size: int, filters: list):
    """(lang, phrase, n) of the phrases of a size in every block; size 1 adds the number of all words with a null phrase."""

    def block(lang: str, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        p = Postings(texts)
        lists = Lists.of_words(p)
        for sent in filters:
            lists = lists.kept(sent.value).extended(p)
        # written out piece by piece: neither side holds all phrases of a block as text
        n = lists.lengths()
        for a in range(0, len(n), PIECE):
            yield counted(lang, lists.texts(p, a, a + PIECE).cast(pa.string()), n[a : a + PIECE])
        if size == 1:
            yield counted(lang, pa.array([None], pa.string()), np.array([len(p.word)]))

    def counted(lang: str, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), phrase, pa.array(n, pa.int64())], names=["lang", "phrase", "n"])

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        langs = pc.dictionary_encode(table["lang"].combine_chunks())
        code = langs.indices.to_numpy()
        texts = table["text"].combine_chunks()
        del table
        held.clear()
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            own = texts.take(pa.array(np.flatnonzero(code == i)))
            for a, b in slices(own, BLOCK_BYTES):
                yield from block(lang, own.slice(a, b - a))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, taken = [], 0
        for batch in batches:
            batch = pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("text").cast(pa.large_string())], names=["lang", "text"])
            held.append(batch)
            taken += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
            if taken >= BLOCK_BYTES:
                yield from flush(held)
                held, taken = [], 0
        if held:
            yield from flush(held)

    return run


def phrase_hashes(phrases: pa.Array) -> np.ndarray:
    """The hashes of phrases as Lists has them, from their texts."""
    data, offsets = flat(phrases)
    words, first = word_hashes(data, offsets)
    place = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
    totals = np.r_[np.uint64(0), np.cumsum(words * ORDER_CODES[place], dtype=np.uint64)]
    return mix(totals[first[1:]] - totals[first[:-1]])


def _segments(n_bytes: int):
    """The set bits of a partition, as segments of the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(n_bytes, np.uint8)
        for batch in batches:
            at = phrase_hashes(batch.column("phrase")) & np.uint64(8 * n_bytes - 1)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        met = [s for s in range(-(-n_bytes // SEGMENT)) if bits[s * SEGMENT : (s + 1) * SEGMENT].any()]
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array([bits[s * SEGMENT : (s + 1) * SEGMENT].tobytes() for s in met], pa.binary())], names=["segment", "body"])

    return run


def _or_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    united: dict[int, np.ndarray] = {}
    for batch in batches:
        for segment, body in zip(batch.column("segment").to_pylist(), batch.column("body").to_pylist(), strict=True):
            part = np.frombuffer(body, np.uint8)
            united[segment] = united[segment] | part if segment in united else part
    yield pa.RecordBatch.from_arrays([pa.array(list(united), pa.int64()), pa.array([x.tobytes() for x in united.values()], pa.binary())], names=["segment", "body"])


def phrase_filter(phrases: DataFrame, n_phrases: int) -> np.ndarray:
    """A bit set of phrase hashes, 16 bits a phrase and FILTER_BITS at most."""
    n_bytes = min(FILTER_BITS, 1 << max(16, (16 * n_phrases).bit_length())) // 8
    parts = phrases.select("phrase").mapInArrow(lean(_segments(n_bytes)), "segment long, body binary")
    out = np.zeros(n_bytes, np.uint8)
    for r in parts.repartition("segment").mapInArrow(lean(_or_segments), "segment long, body binary").collect():  # n_bytes in all
        out[r["segment"] * SEGMENT : r["segment"] * SEGMENT + len(r["body"])] |= np.frombuffer(r["body"], np.uint8)
    return out


def frequent_phrases(texts: DataFrame, *, most_words: int = 5, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, a) of all phrases of up to most_words words met least times, and (lang, n) of all words."""
    spark = texts.sparkSession
    filters, levels, totals = [], [], None
    for size in range(1, most_words + 1):
        counts = texts.mapInArrow(lean(_counted(size, filters)), COUNTED).groupBy("lang", "phrase").agg(F.sum("n").alias("a"))
        counts = durable(counts.where((F.col("a") >= least) | F.col("phrase").isNull()))
        release(spark)
        if size == 1:
            totals = counts.where("phrase IS NULL").select("lang", F.col("a").alias("n"))
            counts = counts.where("phrase IS NOT NULL")
        found = counts.count()
        levels.append(counts.select("lang", "phrase", F.lit(size).alias("size"), "a"))
        if not found:
            break
        if size < most_words:
            filters.append(spark.sparkContext.broadcast(phrase_filter(counts, found)))  # at most FILTER_BITS
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out, totals


def _words(phrase: Column, a: Column, b: Column) -> Column:
    """Words a up to b (not included) of a phrase."""
    return F.array_join(F.slice(F.split(phrase, " "), a + 1, b - a), " ")


def collocations(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", most_words: int = 5, least: int = 100, top: int = 2000
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by their weakest cut."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    phrases, totals = frequent_phrases(texts, most_words=most_words, least=least)
    candidates = phrases.where("size > 1")

    # a phrase goes if one a word longer, ahead or behind, is as frequent: frequency falls with length
    longer = candidates.where("size > 2").select("lang", "a", F.explode(F.array(_words(F.col("phrase"), F.lit(0), F.col("size") - 1), _words(F.col("phrase"), F.lit(1), F.col("size")))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    left = candidates.join(longer, ["lang", "phrase"], "left").where("most IS NULL OR most < a").drop("most")

    cuts = left.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"first": _words(F.col("phrase"), F.lit(0), F.col("k")), "rest": _words(F.col("phrase"), F.col("k"), F.col("size"))})
    firsts = phrases.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    rests = phrases.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    cuts = cuts.join(firsts, ["lang", "first"]).join(rests, ["lang", "rest"]).join(totals, "lang")
    score = F.expr("CAST(CAST(1000 * CAST(a AS DECIMAL(15,0)) * CAST(n AS DECIMAL(16,0)) AS DECIMAL(38,0)) DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0))) AS BIGINT)")
    weakest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(weakest).select("lang", "phrase", "a", "n", "cut.l", "cut.r", "cut.score")

    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*best)
    some = scored.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
