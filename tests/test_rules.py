"""Hand-derived cases: URLs, text, clustering replay, similarity pairs, components."""

from __future__ import annotations

import datetime as dt
import random

from pressloom import config as C
from pressloom.functions import scoring as S
from pressloom.functions import text as X
from pressloom.functions import urls as U
from pressloom.functions import html as H
from pressloom.operators import events as E
from pressloom.operators import operations as O
from pressloom.operators.graph import components, overlap_pairs
from pyspark.sql import functions as F

SCHEMA = "ord long, id string, source_id string, title string, summary string, url string, primary_category string, categories array<string>, language string, published_at timestamp"
NOON = dt.datetime(2024, 1, 1, 12)


def article(ord_, title="", summary="", url=None, beat="policy", at=NOON, source="a"):
    return (ord_, str(ord_), source, title, summary, url or f"https://x.example/{ord_}", beat, [beat], "en", at)


def labels(spark, *rows):
    return {r.ord: r.cluster for r in E.clusters(spark.createDataFrame(list(rows), SCHEMA)).collect()}


SAME = ("central bank raises key rate again", "officials gave a long statement about prices and wages in spring")


def test_same_text_two_sources_is_one_event(spark):
    assert labels(spark, article(1, *SAME), article(2, *SAME, source="b")) == {1: 1, 2: 1}


def test_same_text_other_category_or_day_is_two_events(spark):
    late = NOON + dt.timedelta(hours=25)
    assert labels(spark, article(1, *SAME), article(2, *SAME, beat="ai"), article(3, *SAME, at=late)) == {1: 1, 2: 2, 3: 3}


def test_same_url_but_tracking_is_one_event(spark):
    a = article(1, "first title here", "one", "https://x.example/p?b=2&a=1&utm_source=q")
    b = article(2, "other words entirely", "two", "https://x.example/p?a=1&b=2")
    assert labels(spark, a, b) == {1: 1, 2: 1}


def test_the_event_moves_with_its_members(spark):
    days = [NOON + dt.timedelta(hours=20 * i) for i in range(3)]
    assert labels(spark, *[article(i, *SAME, at=t) for i, t in enumerate(days)]) == {0: 0, 1: 0, 2: 0}


def fold_by_hand(rows):
    """The rule read off its definition: every item against every event, in order."""
    words = lambda t: {w for w in t.split() if len(w) > 1}
    share = lambda a, b: len(a & b) / min(len(a), len(b)) if a and b else 0.0
    events, out = [], {}
    for o, _, _, title, summary, url, beat, cats, _, at in rows:
        for e in events:
            near = abs((e["at"] - at).total_seconds()) <= 86_400 and e["beat"] == beat
            if e["url"] == url or (near and share(words(e["title"]), words(title)) >= 0.8 and share(words(e["title"] + " " + e["summary"]), words(title + " " + summary)) >= 0.85):
                e["votes"].append(beat)
                e["cats"] = list(dict.fromkeys(e["cats"] + cats))
                text = e["title"] + " " + e["summary"]
                points = {c: 0 for c in e["cats"] + e["votes"]}
                for c in points:
                    points[c] = 8 * e["votes"].count(c) + (1 + 3 * sum(k in text for k in C.CATEGORY_KEYWORDS[c]) if c in e["cats"] else 0)
                e["beat"] = sorted(points, key=lambda c: (-points[c], C.TIE_ORDER.index(c)))[0]
                if len(summary) > len(e["summary"]):
                    e["summary"], e["voice"] = summary, o
                e["at"] = max(e["at"], at)
                out[o] = e
                break
        else:
            events.append({"ord": o, "url": url, "title": title, "summary": summary, "voice": o, "beat": beat, "votes": [beat], "cats": list(cats), "at": at})
            out[o] = events[-1]
    return {o: (e["ord"], e["voice"]) for o, e in out.items()}


def test_clusters_equal_the_fold_on_random_items(spark):
    rng = random.Random(11)
    stock = ["market", "space", "music", "budget", "council", "river", "bridge", "harbour"]
    rows = []
    for i in range(160):
        title = " ".join(rng.sample(stock, rng.choice([3, 4, 4, 5])))
        summary = " ".join(rng.sample(stock, rng.choice([2, 4, 6])))
        beat = rng.choice(["policy", "finance", "science"])
        url = f"https://x.example/{rng.randrange(60)}" if rng.random() < 0.2 else f"https://x.example/p{i}"
        rows.append((i, str(i), "a", title, summary, url, beat, [beat, rng.choice(["finance", "science"])] if rng.random() < 0.5 else [beat], "en", NOON + dt.timedelta(hours=rng.randrange(90))))
    rows = [(*r[:7], list(dict.fromkeys(r[7])), *r[8:]) for r in rows]
    got = {r.ord: (r.cluster, r.voice) for r in E.clusters(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == fold_by_hand(rows)
    assert len({c for c, _ in got.values()}) < 150


def test_the_anchor_does_not_follow_the_input_order(spark):
    a, b = article(1, *SAME, url="https://x.example/b"), article(2, *SAME, url="https://x.example/a", at=NOON - dt.timedelta(hours=2))
    for first, second in ((a, b), (b, a)):
        rows = spark.createDataFrame([(1, *first[1:]), (2, *second[1:])], SCHEMA)
        assert E.events_of(rows, E.clusters(rows)).first().anchor.url == "https://x.example/a"


def test_blank_titles_do_not_meet(spark):
    assert labels(spark, article(1), article(2)) == {1: 1, 2: 2}


def test_no_candidates_no_events(spark):
    assert E.clusters(spark.createDataFrame([], SCHEMA)).count() == 0


def test_event_times_span_members(spark):
    rows = spark.createDataFrame([article(1, *SAME), article(2, *SAME, at=NOON - dt.timedelta(hours=1))], SCHEMA)
    one = E.events_of(rows, E.clusters(rows)).first()
    assert (one.members, one.published_at, one.updated_at) == (2, NOON - dt.timedelta(hours=1), NOON)


def test_overlap_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    sets = [(i, [f"w{rng.randrange(14)}" for _ in range(rng.randrange(0, 8))]) for i in range(120)]
    pairs, same = overlap_pairs(spark.createDataFrame(sets, "ord long, t array<string>"), "ord", "t")
    least: dict = {}
    for i, t in sets:
        if t:
            least.setdefault(frozenset(t), i)
    want = {(min(i, j), max(i, j)) for a, i in least.items() for b, j in least.items() if i < j and len(a & b) * 100 >= 80 * min(len(a), len(b))}
    assert {(r.u, r.v) for r in pairs.collect()} == want
    assert {(r.id, r.set_id) for r in same.collect()} == {(i, least[frozenset(t)]) for i, t in sets if t}


def test_components_of_a_long_path(spark):
    found = components(spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "u long, v long"))
    assert {r.node: r.root for r in found.collect()} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_tokens_and_information_length(spark):
    row = spark.range(1).select(X.tokenize(X.normalize_text(F.lit("The Quick, brown: https://x.y/z fox a"))).alias("t"), X.information_length(F.lit("ab 中文")).alias("n")).first()
    assert row.t[-3:] == ["quick", "brown", "fox"] and row.n == 6


def test_null_urls_and_texts_stay_null(spark):
    row = spark.sql("SELECT cast(null AS string) AS x").select(U.canonical_event_url(F.col("x")).alias("u"), X.normalize_text(F.col("x")).alias("t")).first()
    assert row.u is None and row.t is None


def test_dates_in_paths(spark):
    urls = ["https://x.cn/2026/07/09/a.html", "https://x.cn/2026/06-29/a.html", "https://x.cn/2026/0629/a.html", "https://x.cn/a.html"]
    got = [r.d for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").orderBy("i").select(U.date_in_path(F.col("u")).alias("d")).collect()]
    assert got == [dt.datetime(2026, 7, 8, 16), dt.datetime(2026, 6, 28, 16), dt.datetime(2026, 6, 28, 16), None]


def test_references_of_any_number_are_decoded(spark):
    text = "".join(f"&#{i};" for i in range(200, 400)) + "&#x110000; &#12; &amp;"
    got = spark.createDataFrame([(text,)], "t string").select(H.decode(F.col("t")).alias("t")).first().t
    assert got == "".join(map(chr, range(200, 400))) + "\0 \f &"  # numbers name 16-bit units


def test_lists_of_plain_words_are_searched_as_bytes(spark):
    texts = spark.createDataFrame([("a takes effect b",), ("战争",), ("warm",), ("nothing",), ("",), (None,)], "t string")
    for pattern in [C.OPINION, C.LOCAL, C.SPORT_PEAK, *(p for _, p in C.EVENT_TYPES), *(p for _, p in C.IMPACT_BOOSTS)]:
        found = S._found(F.col("t"), pattern)
        assert "RLIKE" not in str(found).upper()
        assert texts.where(~found.eqNullSafe(F.col("t").rlike(pattern))).count() == 0
    assert "RLIKE" in str(S._found(F.col("t"), "(a.c|b)")).upper()
