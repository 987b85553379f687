"""Readers over markup held in a column: tags, anchors, paragraphs, meta, linked data, feeds, sitemaps, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressloom import config as C
from pressloom.functions import dates as D
from pressloom.functions import urls as U
from pressloom.functions.text import let


def _references(text: Column, form: str, number) -> Column:
    """text with the numeric references of a form as the characters they name."""
    pieces = lambda c: F.regexp_extract_all(c, F.lit(rf"(?s)({form}|[^&]+|&)"), 1)
    read = lambda p: F.when(p.rlike(f"^{form}$"), let(number(p), _sign)).otherwise(p)
    return let(text, lambda c: F.when(F.contains(c, F.lit("&#")), F.array_join(F.transform(pieces(c), read), "")).otherwise(c))


def _sign(n: Column) -> Column:
    """The character of a 16-bit unit; a lone surrogate is U+FFFD."""
    of = lambda unit: F.when(unit.isNull() | unit.between(0xD800, 0xDFFF), "�").otherwise(F.decode(F.unhex(F.lpad(F.hex(unit), 4, "0")), "UTF-16BE"))
    return let((n % 65536).cast("int"), of)


def decode(c: Column) -> Column:
    """Named references, then decimal, then hexadecimal ones (X09): the ampersand first, so doubly written ones resolve."""
    for name, char in C.NAMED_REFERENCES:
        c = F.replace(c, F.lit(name), F.lit(char))
    c = _references(c, "&#[0-9]+;", lambda p: F.regexp_extract(p, "([0-9]+)", 1).try_cast("decimal(38,0)"))
    return _references(c, "&#[xX][0-9A-Fa-f]+;", lambda p: F.conv(F.regexp_extract(p, "[xX]([0-9A-Fa-f]+)", 1), 16, 10).try_cast("decimal(38,0)"))


def clean(c: Column) -> Column:
    """The text of markup (X08): references decoded first, CDATA marks cut, tags to spaces, white space collapsed."""
    c = F.regexp_replace(decode(c), r"<!\[CDATA\[|\]\]>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), f"{C.SPACES}+", " "))


def squeezed(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, f"^{C.SPACES}+|{C.SPACES}+$", "")


def tag_text(html: Column, tag: str) -> Column:
    """Inner markup of the first element of a tag, blank if there is none."""
    return F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)


def attribute(tag: Column, name: str) -> Column:
    """A quoted attribute of a tag, decoded (X11)."""
    return squeezed(decode(F.regexp_extract(tag, rf"""(?i)\b{name}=["']([^"']+)["']""", 1)))


def first_of(*texts: Column) -> Column:
    """The first that is not blank, else blank."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def heading_text(html: Column) -> Column:
    """The first heading with text, from h1 to h6."""
    return first_of(*[clean(tag_text(html, f"h{i}")) for i in range(1, 7)])


def anchors(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*>.*?</a>"), 0)


def paragraphs(html: Column, least: int = 40) -> Column:
    """Texts of closed paragraphs of at least so many characters."""
    return F.filter(F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), 1), clean), lambda t: F.length(t) >= least)


def _metas(html: Column, keys: str) -> Column:
    """The meta tags whose property, name or itemprop is one of keys."""
    key = lambda t: F.regexp_replace(first_of(attribute(t, "property"), attribute(t, "name"), attribute(t, "itemprop")), "[-.]", "_")
    return F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<meta\b[^>]*>"), 0), lambda t: key(t).rlike(keys))


def meta_descriptions(html: Column) -> Column:
    """Contents of description metadata."""
    return F.filter(F.transform(_metas(html, C.DESCRIPTION_KEYS), lambda t: clean(attribute(t, "content"))), lambda t: t != "")


def meta_dates(html: Column) -> Column:
    """Contents of date metadata."""
    return F.filter(F.transform(_metas(html, C.DATE_KEYS), lambda t: attribute(t, "content")), lambda t: t != "")


def linked_data(html: Column) -> Column:
    """The linked data scripts of a page."""
    return F.regexp_extract_all(html, F.lit(r"""(?is)<script\b[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), 1)


def time_tag_dates(html: Column) -> Column:
    """datetime attribute and text of every time tag, in order."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<time\b[^>]*>.*?</time>"), 0)
    both = F.transform(tags, lambda t: F.array(attribute(t, "datetime"), clean(tag_text(t, "time"))))
    return F.filter(F.flatten(both), lambda t: t != "")


def inline_dates(html: Column) -> Column:
    """Dates in the text of a page: a split header first, then what each pattern finds."""
    text = clean(html)
    found = [F.regexp_extract_all(text, F.lit(p), 1) for p in C.INLINE_DATES]
    halves = F.regexp_extract_all(text, F.lit(C.BROKEN_DATE), 0)
    part = lambda t, i: F.regexp_extract(t, C.BROKEN_DATE, i)
    joined = F.transform(halves, lambda t: F.concat(part(t, 1), F.lit("-"), part(t, 2), F.lit("-"), part(t, 3), F.lit(" "), part(t, 4)))
    year, month, day, clock = (F.regexp_extract(html, p, i) for p, i in ((C.HEADER_YEAR, 1), (C.HEADER_DAY, 1), (C.HEADER_DAY, 2), (C.HEADER_TIME, 1)))
    header = F.when((year != "") & (month != "") & (clock != ""), F.concat(year, F.lit("-"), month, F.lit("-"), day, F.lit(" "), clock))
    return F.concat(F.array_compact(F.array(header)), *found, joined)


def article_context(html: Column, linked_texts: Column, cap: int = 3200) -> Column:
    """Descriptions, linked data texts and paragraphs, each once, cut at cap characters."""
    body = F.filter(paragraphs(html), lambda t: ~t.rlike(C.BOILERPLATE))
    return F.substring(F.array_join(F.array_distinct(F.concat(meta_descriptions(html), linked_texts, body)), "\n"), 1, cap)


def title_from_url(url: Column) -> Column:
    """The last path segment, decoded where its escapes are whole, dashes as spaces."""
    def decoded(last: Column) -> Column:
        broken = lambda p: p.isNull() | last.rlike("%(?![0-9A-Fa-f]{2})") | (F.contains(p, F.lit("�")) & ~F.contains(F.upper(last), F.lit("%EF%BF%BD")))
        return let(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), lambda p: F.when(broken(p), last).otherwise(p))

    last = F.coalesce(F.try_element_at(F.filter(F.split(U.path(url), "/"), lambda s: s != ""), F.lit(-1)), F.lit(""))
    return squeezed(F.regexp_replace(let(last, decoded), "[-_]+", " "))


def page_format(html: Column) -> Column:
    """feed, sitemap or html."""
    return F.when(html.rlike(r"(?i)<(item|entry)\b"), "feed").when(html.rlike(r"(?i)<urlset\b"), "sitemap").otherwise("html")


def _newest_first(entries: Column) -> Column:
    """Each URL once, its first entry; newest first, undated last, else in page order."""
    recency = lambda e: F.coalesce(F.unix_micros(F.coalesce(e["published_at"], let(e["url"], lambda u: D.date_in_url(u, U.path(u))))), F.lit(-(1 << 62)))

    def ordered(all_: Column) -> Column:
        ranked = F.transform(all_, lambda e, i: F.struct((-recency(e)).alias("age"), i.alias("i"), e.alias("e")))
        first = F.filter(ranked, lambda r: F.array_position(F.transform(all_, lambda e: e["url"]), r["e"]["url"]) == r["i"] + 1)
        return F.transform(F.array_sort(first), lambda r: r["e"])

    return let(entries, ordered)


def _entry(title, url, summary, published) -> Column:
    made = F.struct(title.alias("title"), url.alias("url"), summary.alias("summary"), published.alias("published_at"))
    return let(made, lambda e: F.struct(e["title"].alias("title"), e["url"].alias("url"), first_of(e["summary"], e["title"]).alias("summary"), e["published_at"].alias("published_at")))


def feed_entries(xml: Column, base: Column) -> Column:
    """title, url, summary and published_at of the entries of a feed, items and entries in their order."""
    blocks = F.regexp_extract_all(xml, F.lit(r"(?is)<(item|entry)\b.*?</\1>"), 0)
    tag = lambda b, *names: first_of(*[tag_text(b, n) for n in names])
    href = lambda b: F.regexp_extract(b, r"""(?i)<link\b[^>]*href=["']([^"']+)["'][^>]*/?>""", 1)
    read = lambda b: _entry(
        clean(tag_text(b, "title")), U.resolve(squeezed(decode(first_of(tag_text(b, "link"), href(b)))), base),
        clean(tag(b, "description", "summary", "content")), D.parse_published(clean(tag(b, "pubDate", "published", "updated"))),
    )
    return _newest_first(F.filter(F.transform(blocks, read), lambda e: (e["title"] != "") & (e["url"] != "")))


def sitemap_entries(xml: Column, base: Column) -> Column:
    """Article-like URLs of a sitemap on the same host, titled by their last segment."""
    blocks = F.regexp_extract_all(xml, F.lit(r"(?is)<url\b[^>]*>(.*?)</url>"), 1)
    read = lambda b: F.struct(U.resolve(squeezed(decode(tag_text(b, "loc"))), base).alias("url"), D.parse_published(clean(tag_text(b, "lastmod"))).alias("at"))
    entries = F.transform(F.transform(blocks, read), lambda e: _entry(title_from_url(e["url"]), e["url"], F.lit(""), e["at"]))
    host = U.host(base)
    return _newest_first(F.filter(entries, lambda e: (e["url"] != "") & ((host == "") | (U.host(e["url"]) == host)) & U.likely_article(e["url"]) & (F.length(e["title"]) >= 8)))


def link_entries(html: Column, base: Column) -> Column:
    """Links of a page that look like articles of the same host (S07): heading or text as title, paragraph as summary."""
    found = F.regexp_extract_all(html, F.lit(r"""(?is)<a\b[^>]*href=["'][^"']+["'][^>]*>.*?</a>"""), 0)
    part = lambda a, i: F.regexp_extract(a, r"""(?is)<a\b[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>""", i)

    def read(a: Column) -> Column:
        card = part(a, 2)
        raw = first_of(heading_text(card), clean(card))
        at = F.coalesce(F.get(F.filter(F.transform(time_tag_dates(card), D.parse_published), lambda t: t.isNotNull()), F.lit(0)), D.parse_published(raw))
        return _entry(squeezed(F.regexp_replace(raw, C.TRAILING_DATE, "")), U.resolve(squeezed(decode(part(a, 1))), base), clean(tag_text(card, "p")), at)

    host, bare = U.host(base), lambda u: F.regexp_replace(u, "/+$", "")
    keep = lambda e: (
        (e["url"] != "") & (F.length(e["title"]) >= 8) & ((host == "") | (U.host(e["url"]) == host)) & U.likely_article(e["url"])
        & ~e["url"].rlike(r"(?i)\.(jpg|jpeg|png|gif|webp|svg|pdf|zip)(\?|$)") & (bare(e["url"]) != bare(base)) & ~F.endswith(e["url"], F.lit("#"))
    )
    return _newest_first(F.filter(F.transform(found, read), keep))
