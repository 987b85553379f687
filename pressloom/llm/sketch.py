"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's
word shingles.  Sketches of parts merge into the sketch of their union, and give
estimates of resemblance, containment and the number of distinct shingles.  With
k = 128 an estimated resemblance has a standard error of at most 0.045.

Defined cases: words are lower-cased; a text of fewer words than a shingle is one
shingle; null and empty texts have an empty sketch; two empty sketches resemble each
other fully, an empty and another one not at all; equal texts have equal sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, WIDTH = 128, 5
BUCKET_ROWS, MAX_BUCKETS, STEP = 1024, 16384, 128


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def word_codes(text: Column) -> Column:
    """Hashes of the words in order."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def sketch(codes: Column, k: int = K, width: int = WIDTH) -> Column:
    """The bottom-k sketch of a column of word_codes (a materialised column: it is read once a shingle)."""
    n = F.size(codes)
    shingles = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(codes, i + j) for j in range(width)]))
    short = F.array(F.xxhash64(codes, n))
    none = F.array().cast("array<bigint>")
    return F.slice(F.sort_array(F.array_distinct(F.when(n >= width, shingles).when(n > 0, short).otherwise(none))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles in the union (exact where both sketches are complete)."""
    union = merge(a, b, k)
    common = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, 1.0).otherwise(common / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else from the k-th smallest hash."""
    share = (F.element_at(a, -1).cast("double") + float(2**63) + 1.0) / float(2**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    union = distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def merged(df: DataFrame, key: str, sketch_col: str, k: int = K) -> DataFrame:
    """One sketch per key from the sketches of its parts; a hot key's hashes are made distinct before they meet."""
    codes = df.select(key, F.explode(sketch_col).alias("code")).distinct()
    best = codes.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("code"))).where(F.col("r") <= k)
    return best.groupBy(key).agg(F.sort_array(F.collect_list("code")).alias(sketch_col))  # at most k codes a key


def with_next(docs: DataFrame, *, id_col: str, text_col: str) -> tuple[DataFrame, object]:
    """The rows dealt by ranges of descending id, each range with the next one's first row as a guard.

    Returns (id, text, guard) rows and the window whose lead is the next document: descending id,
    nulls last, equal ids by descending text, and after the last row the first.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = base.agg(F.count("id")).first()[0]
    n = min(MAX_BUCKETS, 1 + rows // BUCKET_ROWS)
    # Range borders, at most MAX_BUCKETS numbers whatever the data.
    borders = base.agg(F.percentile_approx("id", [i / n for i in range(1, n)], max(10_000, 4 * n))).first()[0] if n > 1 else []
    borders = sorted(set(borders or []))
    fine = F.lit(borders).cast("array<bigint>") if borders else F.array().cast("array<bigint>")
    coarse = F.lit(borders[::STEP]).cast("array<bigint>") if borders else fine
    top = F.size(F.filter(coarse, lambda x: x <= F.col("id")))
    inner = F.size(F.filter(F.slice(fine, F.greatest(top - 1, F.lit(0)) * STEP + 1, STEP), lambda x: x <= F.col("id")))
    bucket = F.when(F.col("id").isNull(), -1).otherwise(F.when(top == 0, 0).otherwise((top - 1) * STEP + inner))
    dealt = base.withColumn("bucket", bucket)

    heads = dealt.groupBy("bucket").agg(F.max("id").alias("id"))  # one row a range
    first = dealt.join(F.broadcast(heads), ["bucket", "id"], "left_semi").groupBy("bucket", "id").agg(F.max("text").alias("text"))
    nulls = dealt.where("id IS NULL").groupBy("bucket", "id").agg(F.max("text").alias("text"))
    first = first.union(nulls.select(*first.columns))
    line = Window.orderBy(F.desc("bucket"))
    ends = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    guards = first.withColumn("bucket", F.coalesce(F.lag("bucket").over(line), F.last("bucket").over(ends)))
    all_rows = dealt.select("id", "text", "bucket", F.lit(0).alias("guard")).union(guards.select("id", "text", "bucket", F.lit(1)))
    return all_rows, Window.partitionBy("bucket").orderBy("guard", F.desc_nulls_last("id"), F.desc("text"))


def fingerprint_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sketches of every text and of its edited text, and their estimated likeness; see the query's contract."""
    rows, window = with_next(docs, id_col=id_col, text_col=text_col)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    got = (
        rows.withColumn("next_text", F.lead("text").over(window))
        .select("id", "bucket", "guard", "text", "next_text", n.cast("long").alias("n_chars"), half.alias("half"))
        .withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars as int) - half), substring(coalesce(next_text, ''), 1, half))"))
        .select("id", "bucket", "guard", "text", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), word_codes(F.col("text")).alias("codes"), word_codes(F.col("edited")).alias("edited_codes"))
        .select("id", "bucket", "guard", "text", "n_chars", "edited_sha256", sketch(F.col("codes")).alias("own"), sketch(F.col("edited_codes")).alias("edited"))
        .withColumn("next", F.lead("own").over(window))
        .where("guard = 0")
    )
    return got.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"), as_text(F.col("edited")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("edited")).alias("near_edited"), resemblance(F.col("own"), F.col("next")).alias("near_next"),
        distinct_shingles(F.col("own")).alias("n_shingles_estimate"),
    )
