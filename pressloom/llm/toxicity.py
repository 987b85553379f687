"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is a run of letters, digits and bytes above 7F (A-Z lower-cased); its features
are hashed byte n-grams of the word with end marks, and the word itself, so unseen
misspellings share vectors with known words.  A bag is a window of WINDOW words (half
overlapping): word vectors are means over n-grams, bag vectors means over words, and a
linear softmax gives the bag's probability.  A document scores its highest bag, so a
few words in a very long text are not averaged away.

Embeddings and softmax are learned together by Adagrad on a bounded, seeded sample of
labelled rows (parameters max_toxic, max_clean, max_chars), first on wide random bags,
then on each document's highest bags.  As everything after the averages is linear, scoring
needs one number per n-gram.

Defined cases: null and empty texts and texts without words score the empty bag (the softmax's
bias); null labels and ids are not learned from; without both classes every score is below 1e-20; repeated
rows repeat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.llm.columns import LOWER, Prefix, flat, slices
from pressloom.llm.durable import lean

BUCKET_BITS, DIM, WINDOW, GRAMS = 18, 8, 6, (3, 4, 5)
LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
MARK = 1  # stands before and after each word


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of the texts as (bytes with marks, offsets), each word's index, and each text's first word."""
    data, offsets = flat(texts)
    data = LOWER[data]
    inside = LETTER[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        heads = offsets[:-1][offsets[:-1] < len(data)]
        first[heads] = inside[heads]
        tails = offsets[1:][offsets[1:] > 0] - 1
        last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    _, at, index = np.unique(Prefix(data).hash(starts, ends), return_index=True, return_inverse=True)
    size = ends[at] - starts[at] + 2
    bounds = np.r_[0, np.cumsum(size)]
    marked = np.full(bounds[-1], MARK, np.uint8)
    step = np.arange(bounds[-1]) - np.repeat(bounds[:-1], size)
    body = (step > 0) & (step < np.repeat(size, size) - 1)
    marked[body] = data[(np.repeat(starts[at], size) + step - 1)[body]]
    return marked, bounds, index, np.searchsorted(starts, offsets)


def features(marked: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every feature of every word, and the word it belongs to."""
    sums = Prefix(marked)
    place = np.arange(len(marked))
    word = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    buckets, owners = [sums.hash(bounds[:-1], bounds[1:]) * np.uint64(0x9E3779B97F4A7C15)], [np.arange(len(bounds) - 1)]
    for n in GRAMS:
        ok = place + n <= bounds[1:][word]
        buckets.append(sums.hash(place[ok], place[ok] + n))
        owners.append(word[ok])
    return (np.concatenate(buckets) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), np.concatenate(owners)


def bags(first: int, stop: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """Word ranges of the half overlapping windows of a text."""
    half = window // 2
    return [(a, min(a + window, stop)) for a in range(first, max(first + 1, stop - half), half)]


@dataclass
class ToxicModel:
    """What scoring needs: the softmax's log odds for each n-gram bucket, and its bias."""

    odds: np.ndarray
    bias: float

    def word_odds(self, marked: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        bucket, owner = features(marked, bounds)
        n = np.bincount(owner, minlength=len(bounds) - 1)
        return np.bincount(owner, self.odds[bucket], minlength=len(bounds) - 1) / np.maximum(n, 1)

    def logits(self, texts: pa.Array) -> np.ndarray:
        marked, bounds, index, of_text = words_of(texts)
        sums = np.r_[0.0, np.cumsum(self.word_odds(marked, bounds)[index])]
        half, out = WINDOW // 2, np.full(len(texts), self.bias)
        for i, (a, b) in enumerate(zip(of_text[:-1].tolist(), of_text[1:].tolist(), strict=True)):
            if b > a:
                start = np.arange(a, max(a + 1, b - half), half)
                stop = np.minimum(start + WINDOW, b)
                out[i] = self.bias + ((sums[stop] - sums[start]) / (stop - start)).max()
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(texts), -60, 60)))


def fit(texts: list[str], toxic: np.ndarray, *, decision: float = 0.7, aside: int = 6) -> ToxicModel:
    """Trains on all but every aside-th text and shifts the bias by those: the decision lies midway between
    the labels there (a low quantile of the toxic logits, a high one of the clean ones)."""
    part = np.arange(len(texts)) % aside == 0
    model = train([t for t, p in zip(texts, part, strict=True) if not p], toxic[~part])
    rest = pa.array([t for t, p in zip(texts, part, strict=True) if p], pa.large_string())
    if toxic[part].any() and not toxic[part].all():
        got = model.logits(rest)
        middle = (np.quantile(got[toxic[part]], 0.1) + np.quantile(got[~toxic[part]], 0.995)) / 2
        model.bias += float(np.log(decision / (1 - decision)) - middle)
    return model


def train(texts: list[str], toxic: np.ndarray, *, seed: int = 5, epochs: int = 12, warm: int = 4, rate: float = 0.3) -> ToxicModel:
    """Learns embeddings and softmax from whole texts."""
    if not len(texts) or toxic.all() or not toxic.any():
        return ToxicModel(np.zeros(1 << BUCKET_BITS), -60.0)
    rng = np.random.Generator(np.random.PCG64(seed))
    column = pa.array(texts, pa.large_string())
    bucket, per_word, index, of_text = [], [], [], [np.zeros(1, np.int64)]
    n_words = n_tokens = 0
    for a, b in slices(column, 1 << 21):  # in pieces, so that memory follows the sample's n-grams and not their hashes
        marked, bounds, words, first = words_of(column.slice(a, b - a))
        found, owner = features(marked, bounds)
        bucket.append(found[np.argsort(owner, kind="stable")].astype(np.int32))
        per_word.append(np.bincount(owner, minlength=len(bounds) - 1).astype(np.int32))
        index.append((words + n_words).astype(np.int32))
        of_text.append(first[1:] + n_tokens)
        n_words, n_tokens = n_words + len(bounds) - 1, n_tokens + len(words)
    bucket, per_word, index, of_text = (np.concatenate(x) for x in (bucket, per_word, index, of_text))
    feature_at = np.r_[0, np.cumsum(per_word)]
    embed = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    soft = np.zeros((DIM, 2), np.float32)
    bias = np.zeros(2, np.float32)
    g_embed, g_soft, g_bias = np.full(1 << BUCKET_BITS, 1e-6, np.float32), np.full((DIM, 2), 1e-6), np.full(2, 1e-6)
    spans = list(zip(of_text[:-1].tolist(), of_text[1:].tolist(), strict=True))
    docs, wide = [bags(a, b) for a, b in spans], [bags(a, b, 8 * WINDOW) for a, b in spans]
    usable = np.array([d[0][1] > d[0][0] for d in docs])
    share = np.where(toxic, 0.5 / max(1, toxic[usable].sum()), 0.5 / max(1, (~toxic)[usable].sum())) * usable.sum()

    def step(batch: list[tuple[int, int]], doc: np.ndarray) -> None:
        nonlocal soft, bias
        n_words = np.array([b - a for a, b in batch])
        words = index[np.concatenate([np.arange(a, b) for a, b in batch])]
        n = per_word[words]
        at = np.repeat(feature_at[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        feats = bucket[at]
        weight = np.repeat(1.0 / (n * np.repeat(n_words, n_words)), n).astype(np.float32)
        bag = np.repeat(np.repeat(np.arange(len(batch)), n_words), n)
        cuts = np.r_[0, np.flatnonzero(np.diff(bag)) + 1]
        mean = np.add.reduceat(embed[feats] * weight[:, None], cuts, axis=0)
        logits = mean @ soft + bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(batch)), toxic[doc].astype(int)] -= 1
        p *= share[doc][:, None]
        d_mean = p @ soft.T
        d_soft, d_bias = mean.T @ p, p.sum(axis=0)
        rows, back = np.unique(feats, return_inverse=True)
        d_embed = np.zeros((len(rows), DIM), np.float32)
        for k in range(DIM):
            d_embed[:, k] = np.bincount(back, d_mean[bag, k] * weight, minlength=len(rows))
        g_embed[rows] += (d_embed**2).mean(axis=1)
        embed[rows] -= rate * d_embed / np.sqrt(g_embed[rows])[:, None]
        g_soft[:] += d_soft**2
        g_bias[:] += d_bias**2
        soft = soft - (rate * d_soft / np.sqrt(g_soft)).astype(np.float32)
        bias = bias - (rate * d_bias / np.sqrt(g_bias)).astype(np.float32)

    for epoch in range(epochs):
        chosen: list[tuple[int, tuple[int, int]]] = []
        scalar = embed @ (soft[:, 1] - soft[:, 0])  # float32
        odds = np.empty(len(per_word), np.float32)
        for a in range(0, len(per_word), 50_000):
            cuts = feature_at[a : a + 50_001]
            odds[a : a + 50_000] = np.add.reduceat(scalar[bucket[cuts[0] : cuts[-1]]], cuts[:-1] - cuts[0])
        sums = np.r_[0.0, np.cumsum((odds / per_word)[index])]
        for i in np.flatnonzero(usable).tolist():
            if epoch < warm:  # wide bags at random: which words matter
                windows = wide[i]
                top = rng.permutation(len(windows))[:3]
            else:  # then the highest small bags
                windows = docs[i]
                value = [(sums[b] - sums[a]) / (b - a) for a, b in windows]
                top = np.argsort(value)[::-1][: 1 if toxic[i] else 3]
            chosen += [(i, windows[k]) for k in top.tolist()]
        size = max(16, min(256, len(chosen) // 40))  # small samples still get enough steps
        for part in np.array_split(rng.permutation(len(chosen)), max(1, len(chosen) // size)):
            step([chosen[k][1] for k in part], np.array([chosen[k][0] for k in part]))
    return ToxicModel((embed @ (soft[:, 1] - soft[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def held_out(id_col, modulus: int = 3, remainder: int = 1):
    """True for the ids whose CRC-32 falls on the remainder: never learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_toxic: int = 1200, max_clean: int = 2400, max_chars: int = 12_000) -> ToxicModel:
    """A model from a bounded sample of the labelled rows that are not held out, the same on every run.

    At most max_toxic and max_clean documents of each label, drawn by hash, no text longer than max_chars; of several
    texts of one id the first in order counts.
    """
    marks = labels.where(~held_out(id_col)).where(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("_toxic"))
    short = docs.where(F.length(text_col) <= max_chars)
    # the draw sees ids alone; texts follow for the drawn ones, one a document
    ids = short.select(id_col).join(marks, id_col).distinct().withColumn("_draw", F.xxhash64(F.col(id_col), F.lit("toxicity")))
    drawn = [ids.where(F.col("_toxic") == value).orderBy("_draw", id_col).limit(most) for value, most in ((1, max_toxic), (0, max_clean))]
    drawn = drawn[0].union(drawn[1])  # max_toxic + max_clean ids at most
    sample = short.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(drawn), id_col).groupBy(id_col, "_toxic", "_draw").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in zip(b.column("_toxic").to_pylist(), b.column("_draw").to_pylist(), b.column("text").to_pylist(), strict=True)]
        got.sort(key=lambda r: (-r[0], r[1], r[2]))
        model = fit([t for _, _, t in got], np.array([y == 1 for y, _, _ in got], bool))
        yield pa.RecordBatch.from_arrays([pa.array([model.odds.tobytes()], pa.binary()), pa.array([model.bias])], names=["odds", "bias"])

    # The sample is bounded, so one task holds it; the model is 2^BUCKET_BITS numbers.
    both = sample.select("_toxic", "_draw", "text").coalesce(1)
    got = both.mapInArrow(lean(run), "odds binary, bias double").first()
    if got is None:  # no labelled rows, no task
        return train([], np.empty(0, bool))
    return ToxicModel(np.frombuffer(got["odds"], np.float64), got["bias"])


def score(docs: DataFrame, model: ToxicModel, *, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """The input with one more column: the probability that the text is toxic."""
    from pyspark.sql import types as T

    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^BUCKET_BITS numbers, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            out = [sent.value.scores(texts.slice(a, b - a)) for a, b in slices(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else np.empty(0))], names=[*batch.schema.names, score_col])

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))
