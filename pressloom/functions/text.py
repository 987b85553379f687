"""Text functions: normalising, tokens, information length, overlap. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressloom.config import ENTITY_IGNORED, SPACES, STOP_WORDS, SPACES

HAN = r"\p{IsHan}"


def let(value: Column, use) -> Column:
    """use(value), with value worked out once however often use names it: inside lambdas nothing else shares a value."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalize_text(c: Column) -> Column:
    """Lower case, URLs and signs to spaces, spaces collapsed, trimmed."""
    x = F.regexp_replace(F.lower(c), r"https?://\S+", " ")
    x = F.regexp_replace(x, r"[^\p{L}\p{N}\s]", " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def bigrams(t: Column) -> Column:
    """Pairs of neighbouring characters."""
    return F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, 2))


def tokenize(normalized: Column) -> Column:
    """Words of a normalised text; long Han words also give character pairs; stop words go."""
    def parts(n: Column) -> Column:
        words = F.split(n, " ")
        pairs = F.flatten(F.transform(words, lambda t: F.when(t.rlike(HAN) & (F.length(t) > 2), F.concat(F.array(t), bigrams(t))).otherwise(F.array(t))))
        return F.when(n.rlike(HAN), pairs).otherwise(words)

    return F.filter(let(normalized, parts), lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS))


def information_length(c: Column) -> Column:
    """Characters other than white space, Han characters twice."""
    return F.length(F.regexp_replace(c, r"\s", "")) + F.regexp_count(c, F.lit(HAN))


def is_informative(c: Column) -> Column:
    return information_length(c) >= 60


def token_overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of two token sets, 0 when one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def entities(tokens: Column) -> Column:
    """The first eight distinct telling tokens of a title."""
    return F.slice(F.array_distinct(F.filter(tokens, lambda t: (F.length(t) >= 2) & ~t.isin(ENTITY_IGNORED) & ~t.rlike(r"^\d+$"))), 1, 8)


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """How many keywords a text contains, as substrings."""
    return F.size(F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(text, k)))


def truncate_utf8(c: Column, max_bytes: int) -> Column:
    """The longest prefix of whole characters within max_bytes."""
    units = F.split(c, "")
    sizes = F.transform(units, lambda u: F.octet_length(u))
    kept = F.aggregate(sizes, F.struct(F.lit(0).alias("n"), F.lit(0).alias("b")), lambda a, s: F.when(a["b"] + s <= max_bytes, F.struct((a["n"] + 1).alias("n"), (a["b"] + s).alias("b"))).otherwise(F.struct(a["n"].alias("n"), F.lit(max_bytes + 1).alias("b"))))
    return F.array_join(F.slice(units, 1, kept["n"]), "")


def comparable(c: Column) -> Column:
    """Lower case without white space."""
    return F.lower(F.regexp_replace(c, f"{SPACES}+", ""))


def needs_repair(title: Column, summary: Column) -> Column:
    """A blank summary, or one that only repeats the title."""
    return (comparable(summary) == "") | (comparable(title) == comparable(summary))


def has_chinese(c: Column) -> Column:
    """Any Han character of the basic block."""
    return c.rlike("[一-鿿]")


def same_domain(host: Column, base: Column) -> Column:
    """Equal hosts, or one below the other."""
    below = lambda a, b: F.endswith(a, F.concat(F.lit("."), b))
    return (host != "") & (base != "") & ((host == base) | below(host, base) | below(base, host))


def percent_or(c: Column, fallback: float) -> Column:
    """A number that may carry a percent sign, else the fallback."""
    return F.coalesce(F.regexp_replace(F.trim(c), "%$", "").try_cast("double"), F.lit(fallback))
