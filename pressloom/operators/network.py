"""Which addresses a source may be fetched from: longest-prefix match of addresses with networks.

An address is written as bits, 32 or 128 of them.  A network of n bits matches if the first n are
equal, so for each of the few prefix lengths in use an address gives one key, and the match is an
equality join on (family, length, bits): nothing is compared with every range, however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressloom.functions.text import let
from pressloom.operators.graph import durable

V4 = r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$"
MAPPED = "(?i)^::ffff:"
#: Networks that are not public, and the one in which public IPv6 addresses lie.
BLOCKED = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24",
    "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4", "::/128", "::1/128", "fc00::/7", "fe80::/10", "ff00::/8", "2001:db8::/32",
]
PUBLIC_V6 = "2000::/3"
#: Up to so many networks are sent to all tasks.
FEW = 10_000


def _v4_bits(a: Column) -> Column:
    return F.array_join(F.transform(F.split(a, r"\."), lambda p: F.lpad(F.conv(p, 10, 2), 8, "0")), "")


def _v6_bits(a: Column) -> Column:
    """The 128 bits of a valid IPv6 text, null for any other."""
    tail = F.regexp_extract(a, r"([0-9.]+)$", 1)
    hexed = F.when(tail.rlike(V4), let(_v4_bits(tail), lambda b: F.concat(F.regexp_replace(a, r"[0-9.]+$", ""), F.conv(F.substring(b, 1, 16), 2, 16), F.lit(":"), F.conv(F.substring(b, 17, 16), 2, 16)))).otherwise(a)

    def filled(x: Column) -> Column:
        groups = lambda s: F.filter(F.split(s, ":"), lambda g: g != "")
        halves = F.split(x, "::")
        left, right, short = groups(F.get(halves, F.lit(0))), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit(""))), F.size(halves) == 2
        zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right)))
        all_ = F.when(short, F.concat(left, zeros, right)).otherwise(left)
        colons = F.when(short, F.size(left) + F.size(right) <= 7).otherwise(F.size(F.split(x, ":")) == 8)
        fine = (F.size(halves) <= 2) & colons & (F.size(all_) == 8) & ~x.rlike("(^:[^:])|([^:]:$)|:::")
        return F.when(fine & F.forall(all_, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$")), F.array_join(F.transform(all_, lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), ""))

    return let(hexed, filled)


def address_bits(a: Column) -> Column:
    """Struct (family, bits) of an address; family 0 if it is none.  IPv4 written as mapped IPv6 is IPv4."""
    plain = F.regexp_replace(a, MAPPED, "")
    one = lambda family, bits: F.struct(F.lit(family).alias("family"), bits.alias("bits"))
    return let(plain, lambda p: F.when(p.rlike(V4), one(4, _v4_bits(p))).otherwise(
        let(F.when(~a.rlike(MAPPED), _v6_bits(a)), lambda b: F.when(b.isNotNull(), one(6, b)).otherwise(one(0, F.lit(None).cast("string"))))))


def networks(spark, blocked: list[str] | None = None) -> DataFrame:
    """network, family, length, bits, public of the given or the fixed networks."""
    rows = spark.createDataFrame([(n, False) for n in (blocked or BLOCKED)] + [(PUBLIC_V6, True)], "network string, public boolean")
    parsed = rows.withColumn("a", address_bits(F.substring_index("network", "/", 1)))
    length = F.substring_index("network", "/", -1).cast("int")
    return parsed.select("network", "public", F.col("a.family").alias("family"), length.alias("length"), F.substring(F.col("a.bits"), F.lit(1), length).alias("prefix"))


def matched(addresses: DataFrame, nets: DataFrame, address_col: str = "address") -> DataFrame:
    """The rows of addresses with family, network (the longest that holds the address) and public.

    IPv4 is public outside all networks, IPv6 only inside a public network without a longer other one.
    """
    one = durable(nets.groupBy("family", "length", "prefix").agg(F.max(F.struct("length", "network", "public")).alias("m")))  # parsed once, not in the plan of every join
    lengths = [r["length"] for r in one.select("length").distinct().orderBy(F.desc("length")).collect()]  # at most 129
    # an address keeps its row: a join for each length, and the longest network counts
    rows = addresses.withColumn("_a", address_bits(F.col(address_col))).select("*", F.col("_a.family").alias("_family"), F.col("_a.bits").alias("_bits")).drop("_a")
    if one.count() <= FEW:
        one = F.broadcast(one)
    for n in lengths:
        at = one.where(F.col("length") == n).select(F.col("family").alias("_f"), F.col("prefix").alias("_p"), F.col("m").alias(f"_m{n}"))
        rows = rows.join(at, (F.col("_family") == F.col("_f")) & (F.substring("_bits", 1, n) == F.col("_p")) & (F.length("_bits") >= n), "left").drop("_f", "_p")
    out = rows.withColumn("m", F.coalesce(*[F.col(f"_m{n}") for n in lengths], F.lit(None)))
    family = F.col("_family")
    public = F.when(family == 4, F.col("m").isNull() | F.col("m.public")).when(family == 6, F.coalesce(F.col("m.public"), F.lit(False))).otherwise(False)
    return out.select(*addresses.columns, family.alias("family"), F.col("m.network").alias("network"), public.alias("public"))
