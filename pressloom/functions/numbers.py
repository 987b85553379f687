"""Rounding, ratios, hashes and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column) -> Column:
    """Rounded half up, between 0 and 100."""
    return F.least(F.lit(100), F.greatest(F.lit(0), F.floor(x + F.lit(0.5)))).cast("int")


def ratio(n: Column, d: Column) -> Column:
    """Share with three decimals, 0 for an empty whole."""
    return F.when(d > 0, F.floor(n / d * 1000 + 0.5) / 1000).otherwise(F.lit(0.0))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over the characters' codes."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(x) * F.lit(16777619)).bitwiseAND(F.lit(4294967295).cast("long")))


def event_id(identity: Column) -> Column:
    return F.concat(F.lit("event-"), F.lower(F.conv(fnv1a(identity).cast("string"), 10, 36)))


def short_sha(c: Column) -> Column:
    """The first 24 hex digits of SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 24)


def fingerprint(*columns: Column) -> Column:
    """md5 of the parts joined by line feeds, nulls empty."""
    return F.md5(F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in columns]))
