"""Key facts and what to watch, by hand."""

from __future__ import annotations

from pressloom.functions import cards
from pyspark.sql import functions as F


def test_key_facts_say_something_new(spark):
    long = "long words " * 30
    cases = [
        (["A  first\nfact.", "a first fact", "A first fact that goes on", "Second", " ", None, "Third", "Fourth"], ["A first fact.", "Second", "Third"]),
        ([long, long + "and more", "other"], [long.strip()[:178] + "…", "other"]), ([], []), ([None, ""], []), (["b c", "b", "a b"], ["b c", "a b"]),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, s array<string>")
    assert [r.f for r in df.select("i", cards.key_facts(F.col("s")).alias("f")).orderBy("i").collect()] == [w for _, w in cases]


def test_status_decides_before_the_type(spark):
    df = spark.createDataFrame([("policy", "unverified"), ("policy", "confirmed"), ("disaster", None), ("general", "confirmed"), (None, "developing")], "t string, s string")
    got = [r.w for r in df.select(cards.next_watch(F.col("t"), F.col("s")).alias("w")).collect()]
    assert got == [cards.WATCH_BY_STATUS["unverified"], cards.WATCH_BY_TYPE["policy"], cards.WATCH_BY_TYPE["disaster"], cards.WATCH_ELSE, cards.WATCH_BY_STATUS["developing"]]
