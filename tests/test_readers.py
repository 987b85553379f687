"""Readers of markup, dates and URLs on hand-written input."""

from __future__ import annotations

import datetime as dt
import itertools
from urllib.parse import quote, urljoin, urlsplit

from pressloom.functions import dates as D
from pressloom.functions import html as H
from pressloom.functions import text as X
from pressloom.functions import urls as U
from pressloom.operators import harvest as V
from pyspark.sql import functions as F


def each(spark, values, read):
    """read over a column of texts, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r.out for r in df.select("i", read(F.col("c")).alias("out")).orderBy("i").collect()]


def test_references_resolve_with_the_ampersand_first(spark):
    cases = {"&amp;lt;": "<", "&#38;lt; x": "&lt; x", "&lt;p&gt;": "<p>", "&#39;&apos;&quot;": "''\"", "&#20013;&#x4E2D;": "中中", "&#38;#x41;": "A", "&nbsp;&copy; & &#zz;": "&nbsp;&copy; & &#zz;", "&#55357;": "�", "a&#0;b": "a\0b", "": "", "&amp;amp;": "&amp;"}
    assert each(spark, cases, H.decode) == list(cases.values())


def test_markup_is_decoded_before_tags_go(spark):
    cases = {"&lt;p&gt;x&lt;/p&gt;": "x", "<![CDATA[a <b>c</b>]]>": "a c", " a 　\n b ": "a b", "1 < 2 > 0": "1 0", "&amp;lt;i&amp;gt;z": "z", "": ""}
    assert each(spark, cases, H.clean) == list(cases.values())


def test_dates_are_read_as_feeds_write_them(spark):
    t = dt.datetime
    cases = {
        "Mon, 01 Jan 2024 10:00:00 GMT": t(2024, 1, 1, 10), "Mon, 01 Jan 2024 10:00:00 +0800": t(2024, 1, 1, 2), "2024-01-01 10:00 UTC": t(2024, 1, 1, 10), "Jan 5, 2024": t(2024, 1, 5), "5 January 2024 07:08": t(2024, 1, 5, 7, 8),
        "2024-01-01T10:00:00Z": t(2024, 1, 1, 10), "2024-01-01T10:00:00.250-05:00": t(2024, 1, 1, 15, 0, 0, 250000), "20240131 10:30": t(2024, 1, 31, 2, 30), "20240131103000": t(2024, 1, 31, 2, 30), "20240131": t(2024, 1, 30, 16),
        "2024年1月2日 03:04": t(2024, 1, 1, 19, 4), "发布 2024/1/2": t(2024, 1, 1, 16), "2024-02-30": None, "2024-01-01 25:00": None, "soon": None, "": None, "1999-05-05": t(1999, 5, 5), "Foo 5, 2024": None, "a2024013": None,
    }
    assert each(spark, cases, D.parse_published) == list(cases.values())
    assert each(spark, ["20240131103000", "x 9:05", "20240131", "noon"], D.has_clock) == [True, True, False, False]
    assert each(spark, ["10:00Z", "10:00+0800", "10:00 +0800", "GMT", "xGMT", "10:00"], D.has_zone) == [True, True, False, True, False, False]


def test_dates_in_urls(spark):
    t = dt.datetime
    cases = {
        "https://a.example/2024/01/02/x": t(2024, 1, 1, 16), "https://a.example/2024/01-02": t(2024, 1, 1, 16), "https://a.example/2024/0102_x": t(2024, 1, 1, 16), "https://a.example/story-2024-01-02/": t(2024, 1, 1, 16),
        "https://a.example/20240102.html": t(2024, 1, 1, 16), "https://a.example/x?d=20240102": t(2024, 1, 1, 16), "https://a.example/2024/02/30/?d=20240102": t(2024, 1, 1, 16), "https://a.example/2024/1/2/": None, "nothing/2024/01/02/": None,
    }
    assert each(spark, cases, U.date_in_path) == list(cases.values())


def test_titles_keep_endings_plus_signs_and_broken_escapes(spark):
    cases = {"https://a.example/x/breaking-news_1.html?q": "breaking news 1.html", "https://a.example/a+b%20c": "a+b c", "https://a.example/50%-off": "50% off", "https://a.example/%ff-x": "%ff x", "https://a.example/": "", "https://a.example/%E4%B8%AD/": "中"}
    assert each(spark, cases, H.title_from_url) == list(cases.values())


def test_references_resolve_as_urljoin_says(spark):
    bases = ["https://a.example/b/c/d?q=1#f", "http://a.example", "https://a.example:8443/b/"]
    refs = ["x", "./x", "../x", "../../x", "../../../x", "/x/./y/../z", "/", "?n=2", "#g", "//b.example/p", "http://c.example/a/b", "x/", ".", "..", "./", "../", "x?y#z", "a/./b/../c/", "HTTPS://Up.Example/P", "/für/ß,%41", "q?ü=1"]
    pairs = list(itertools.product(refs, bases))
    df = spark.createDataFrame([(i, r, b) for i, (r, b) in enumerate(pairs)], "i int, r string, b string")
    got = [x.u for x in df.select("i", U.resolve(F.col("r"), F.col("b")).alias("u")).orderBy("i").collect()]
    for (r, b), u in zip(pairs, got, strict=True):
        s = urlsplit(urljoin(b, r))
        want = f"{s.scheme}://{s.netloc.lower()}{quote(s.path or '/', safe='/%,')}" + (f"?{quote(s.query, safe='=%')}" if s.query else "") + (f"#{s.fragment}" if s.fragment else "")
        assert u == want, (r, b)


def test_references_that_are_no_links(spark):
    odd = {"": "", "javascript:x()": "", "MAILTO:a@b": "", "tel:1": "", "ftp://f.example/x": "ftp://f.example/x", "https:rel": "https://a.example/b/rel", "\\x\\y": "https://a.example/x/y", "https:\\\\c.example\\p": "https://c.example/p", "https://c.example:443/x": "https://c.example/x", "http://c.example:80": "http://c.example/", "//": "", "a b": "https://a.example/b/a%20b", "x\ny": "https://a.example/b/xy"}
    assert each(spark, odd, lambda c: U.resolve(c, F.lit("https://a.example/b/c"))) == list(odd.values())
    assert each(spark, ["x", "https://b.example/"], lambda c: U.resolve(c, F.lit("no base"))) == ["", ""]


def test_articles_by_path(spark):
    cases = {"https://a.example/news/x": True, "https://a.example/newsroom": False, "https://a.example/2024/x": True, "https://a.example/a/123456.html": True, "https://a.example/x/20240102/y": True, "https://a.example/about": False, f"https://a.example/{'a1' * 10}/c.html": True}
    assert each(spark, cases, U.likely_article) == list(cases.values())


FEED = """<rss><entry><title>Second &amp;amp; more</title><link href='/b'/><summary>&lt;p&gt;S&lt;/p&gt;</summary><updated>2024-01-02T00:00:00Z</updated></entry>
<ITEM><title><![CDATA[First]]></title><link>https://a.example/a</link><pubDate>Wed, 03 Jan 2024 00:00:00 GMT</pubDate></ITEM>
<item><title>Twice</title><link>https://a.example/a</link></item><item><title></title><link>/none</link></item><item><title>Undated</title><link>x</link></item></rss>"""
LINKS = """<a href="/news/1"><h2>A heading that counts</h2><p>Its summary</p><time datetime="2024-01-05T00:00:00Z">5</time></a><a href='/news/2'>Plain title of a story 2024-01-02 03:04</a>
<a href="/about">Not an article at all</a><a href="https://b.example/news/3">Another host's story</a><a href="/news/pic.jpg">A picture of something</a><a href="/news/1">The same link again</a><a href="/news/4">short</a>"""


def test_feeds_sitemaps_and_links(spark):
    df = spark.createDataFrame([(FEED, LINKS)], "feed string, links string")
    base = F.lit("https://a.example/dir/page")
    row = df.select(H.feed_entries(F.col("feed"), base).alias("f"), H.link_entries(F.col("links"), base).alias("l")).first()
    assert [(e.title, e.url, e.summary) for e in row.f] == [("First", "https://a.example/a", "First"), ("Second &amp; more", "https://a.example/b", "S"), ("Undated", "https://a.example/dir/x", "Undated")]
    assert [(e.title, e.url, e.summary) for e in row.l] == [("A heading that counts", "https://a.example/news/1", "Its summary"), ("Plain title of a story", "https://a.example/news/2", "Plain title of a story")]
    assert [e.published_at for e in row.l] == [dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 1, 19, 4)]


def test_linked_data_of_any_depth_in_the_order_written(spark):
    deep = '{"n":' * 30 + '{"datePublished":"deep"}' + "}" * 30
    texts = ['{"z":{"dateCreated":"3"},"a":[1,[{"datePublished":"4","x":null}]],"dateModified":"2","datePublished":"1"}', '[{"dateCreated":"b"},{"dateCreated":"c"}]', deep, '{"datePublished":5,"dateCreated":{"datePublished":"in"}}', "{broken", "7", '"datePublished"']
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "page long, script int, text string")
    got = sorted((r.script, r.path, r.value) for r in V.linked_values(rows, ["datePublished", "dateCreated", "dateModified"]).collect())
    assert [(s, v) for s, _, v in got] == [(0, "1"), (0, "2"), (0, "3"), (0, "4"), (1, "b"), (1, "c"), (2, "deep"), (3, "in")]


def test_pages_without_dates_or_text(spark):
    pages = spark.createDataFrame([(1, "https://a.example/2024/01/02/x", "<p>none</p>"), (2, "", ""), (3, "u", '<script type="application/ld+json">{bad "datePublished": "2024-01-01T00:00:00Z"</script>')], "page_id long, url string, html string")
    assert {r.page_id: (r.named, r.n_candidates) for r in V.page_dates(pages).collect()} == {1: (None, 0), 2: (None, 0), 3: (dt.datetime(2024, 1, 1), 1)}
    assert {r.context for r in V.contexts(pages).collect()} == {""}
    assert V.page_dates(pages.limit(0)).count() == 0


def test_summaries_from_contexts(spark):
    line = "这是一个足够长的句子用来说明新闻的背景以及它为什么重要和后续可能的发展情况。"
    df = spark.createDataFrame([("题", f"短\n{line}"), (line, line), ("t", "no such script " * 9), ("题", line * 5), ("题", None)], "t string, c string")
    got = [r.s for r in df.select(V.summary_from_context(F.col("t"), F.col("c")).alias("s")).collect()]
    assert got == [line, None, None, (line * 5)[:118] + "...", None]
    assert df.select(V.minimal_summary(F.col("t")).alias("s")).first().s == "相关报道聚焦“题”，具体背景、影响和后续进展以原文披露为准。"


def test_small_text_rules(spark):
    df = spark.createDataFrame([("news.a.example", "a.example", "12.5%"), ("a.example", "news.a.example", "x"), ("ba.example", "a.example", " 7 "), ("", "a.example", None)], "h string, b string, p string")
    got = [(r.s, r.p) for r in df.select(X.same_domain(F.col("h"), F.col("b")).alias("s"), X.percent_or(F.col("p"), 3.0).alias("p")).collect()]
    assert got == [(True, 12.5), (True, 3.0), (False, 7.0), (False, 3.0)]
    cut = [r.t for r in spark.range(10).select("id", X.truncate_utf8(F.lit("é中\U0001f600x"), F.col("id").cast("int")).alias("t")).orderBy("id").collect()]
    assert cut == ["é中\U0001f600x".encode()[:n].decode(errors="ignore") for n in range(10)]
