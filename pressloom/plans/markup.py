"""Registered queries of the readers over pages, and over markup and dates that both engines derive from the tables alike.

Markup is derived by SQL text that Spark and DuckDB share; each engine then reads it by its own means.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pressloom import config as C
from pressloom.functions import dates as D
from pressloom.functions import html as H
from pressloom.functions import text as X
from pressloom.functions import urls as U
from pressloom.operators import harvest as V
from pressloom.plans.queries import query
from pressloom.sources import tables as T
from pressloom.sources.tables import clean_sql, decode_sql

# ---- shared by both engines ---------------------------------------------------------------------
_DAY, _HOUR = "lpad(CAST(page_id % 28 + 1 AS STRING), 2, '0')", "lpad(CAST(page_id % 24 AS STRING), 2, '0')"
_HEADS = [
    f"'<meta property=\"article:published_time\" content=\"2024-01-' || {_DAY} || 'T' || {_HOUR} || ':30:00+08:00\">'",
    f"'<script type=\"application/ld+json\">{{\"@graph\":[{{\"@type\":\"WebPage\",\"name\":\"x\"}},{{\"z\":{{\"a\":[[{{\"datePublished\":\"2024-01-' || {_DAY} || ' ' || {_HOUR} || ':15\"}}]]}},\"dateCreated\":\"2024-01-02 10:00\",\"b\":{{\"dateModified\":7}}}}],\"dateModified\":\"2024/01/03\"}}</script>'",
    f"'<time datetime=\"2024-01-' || {_DAY} || '\">x</time><meta name=\"pubdate\" content=\"2024-01-' || {_DAY} || ' ' || {_HOUR} || ':45\">'",
    f"'<script type=\"application/ld+json\">{{\"datePublished\":\"Mon, ' || {_DAY} || ' Jan 2024 ' || {_HOUR} || ':00:00 GMT\",}}</script>'",
    f"'<span>发布时间：2024-01-' || {_DAY} || ' ' || {_HOUR} || ':05</span>'",
    f"'<p class=\"year\"><em>2024</em></p><p class=\"day\"><em>01</em>/<em>' || {_DAY} || '</em></p><p class=\"time\">' || {_HOUR} || ':20:11</p>'",
    f"'<script>var publishDate = \"202401' || {_DAY} || {_HOUR} || '0000\"</script>'",
    "'<meta name=\"date\" content=\"2024-02-30\"><meta itemprop=\"datePublished\" content=\"20240131\">'",
]
DATED_HTML = "CASE page_id % 9 " + " ".join(f"WHEN {i} THEN replace(html, '</head>', {h} || '</head>')" for i, h in enumerate(_HEADS)) + " ELSE html END"
#: The second and every later use of a page's inner markup, as feeds carry it: escaped once more.
_TITLE = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"
_ESCAPED = "replace(replace(replace(regexp_extract(html, '(?s)(<p>[^<]*</p>)', 1), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
FEED = f"""'<rss><channel><entry><title>' || {_TITLE} || ' B</title><link rel="self" href="../b/./' || page_id || '?x=1&amp;y=2"/><summary>' || {_ESCAPED} || '</summary><updated>2024-01-' || {_DAY} || 'T' || {_HOUR} || ':00:00Z</updated></entry><item><title><![CDATA[' || {_TITLE} || ' A]]></title><link>' || url || '</link><pubDate>Mon, ' || {_DAY} || ' Jan 2024 ' || {_HOUR} || ':30:00 +0800</pubDate></item><item><title>again</title><link>' || url || '</link></item><item><title>no link</title></item></channel></rss>'"""
SITEMAP = f"""'<urlset><url><loc> ' || url || ' </loc></url><url><loc>/news' || {_PATH} || '-more%20to+read_' || page_id || '</loc><lastmod>2024-01-' || {_DAY} || '</lastmod></url><url><loc>https://elsewhere.example/news/long-enough-title</loc></url><url><loc>/tech/' || page_id || 'x/a_second-title%zz</loc></url></urlset>'"""
_FORMS = [
    "d || 'T' || t || '+08:00'", "substr(d, 1, 4) || '年' || substr(d, 6, 2) || '月' || substr(d, 9, 2) || '日 ' || substr(t, 1, 5)", "'发布 ' || d || ' ' || t", "replace(d, '-', '') || replace(t, ':', '')",
    "replace(d, '-', '/')", "replace(d, '-', '') || ' ' || substr(t, 1, 5)", "'Mon, ' || substr(d, 9, 2) || ' ' || m || ' ' || substr(d, 1, 4) || ' ' || t || ' GMT'", "m || ' ' || CAST(CAST(substr(d, 9, 2) AS INT) AS STRING) || ', ' || substr(d, 1, 4)",
    "d || ' ' || substr(t, 1, 5) || ' UTC'", "substr(d, 1, 8) || '31 ' || t",
]
_MONTH = "CASE substr(d, 6, 2) " + " ".join(f"WHEN '{i:02}' THEN '{m.title()}'" for i, m in enumerate(C.MONTHS, 1)) + " END"
#: Dates of orders, moved to this century, as texts of ten forms and as URLs of six.
DATE_TEXT = f"WITH o AS (SELECT o_orderkey, '20' || substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 3) AS d, lpad(CAST(o_orderkey % 24 AS STRING), 2, '0') || ':' || lpad(CAST(o_orderkey % 60 AS STRING), 2, '0') || ':' || lpad(CAST(o_orderkey % 59 AS STRING), 2, '0') AS t FROM {{orders}}), n AS (SELECT *, {_MONTH} AS m FROM o) SELECT o_orderkey, CASE o_orderkey % 10 " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(_FORMS)) + " END AS said, 'https://x.example/a' || CASE o_orderkey % 6 WHEN 0 THEN '/' || replace(d, '-', '/') || '/x' WHEN 1 THEN '/' || substr(d, 1, 4) || '/' || substr(d, 6, 5) WHEN 2 THEN '/' || substr(d, 1, 4) || '/' || substr(d, 6, 2) || substr(d, 9, 2) || '_x' WHEN 3 THEN '/story-' || d WHEN 4 THEN '/' || replace(d, '-', '') || '.html' ELSE '?k=' || replace(d, '-', '') || '#f' END AS url FROM n"

# ---- DuckDB's own reading -----------------------------------------------------------------------
def tag_sql(x: str, tag: str) -> str:
    return f"regexp_extract({x}, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}>', 1)"


def attribute_sql(x: str, name: str) -> str:
    return f"trim({decode_sql(f'''regexp_extract({x}, '(?i)\\b{name}=[\"'']([^\"'']+)[\"'']', 1)''')})"


def _time_sql(x: str, pattern: str, order: list[int], months: bool = False) -> str:
    """A checked time from the groups of a pattern, in the order year, month, day, hour, minute, second (0: none)."""
    g = [f"coalesce(nullif(regexp_extract({x}, '{pattern}', {i}), ''), '0')" if i else "'0'" for i in order]
    return f"try_strptime({g[0]} || '-' || {g[1]} || '-' || {g[2]} || ' ' || {g[3]} || ':' || {g[4]} || ':' || {g[5]}, '%Y-%{'b' if months else 'm'}-%d %H:%M:%S')"


def parse_sql(x: str) -> str:
    """What the forms of dates in these queries mean."""
    zone = "(?i)\\d{1,2}:\\d{2}(:\\d{2})?(\\.\\d+)?(Z|[+-]\\d{2}:?\\d{2})\\b|\\b(GMT|UTC)\\b"
    iso = "^(\\d{4})-(\\d{2})-(\\d{2})[T ](\\d{2}):(\\d{2})(?::(\\d{2}))?"
    mail = "^[A-Za-z]+, (\\d{1,2}) ([A-Za-z]{3}) (\\d{4}) (\\d{1,2}):(\\d{2}):(\\d{2})"
    free = "^([A-Za-z]{3}) (\\d{1,2}), (\\d{4})$"
    local = "(20\\d{2})\\s*[年/.-]\\s*(\\d{1,2})\\s*[月/.-]\\s*(\\d{1,2})(?:\\s*日)?(?:[ T]+(\\d{1,2}):(\\d{2})(?::(\\d{2}))?)?"
    full, short = "\\b(20\\d{2})(\\d{2})(\\d{2})(\\d{2})(\\d{2})(\\d{2})\\b", "\\b(20\\d{2})(\\d{2})(\\d{2})(?:[ T](\\d{1,2}):(\\d{2})(?::(\\d{2}))?)?\\b"
    ahead = f"CASE WHEN regexp_matches({x}, '[+-]\\d{{2}}:?\\d{{2}}$') THEN to_minutes((CASE WHEN regexp_extract({x}, '([+-])\\d{{2}}:?\\d{{2}}$', 1) = '-' THEN -1 ELSE 1 END * (regexp_extract({x}, '[+-](\\d{{2}}):?\\d{{2}}$', 1)::INT * 60 + regexp_extract({x}, '[+-]\\d{{2}}:?(\\d{{2}})$', 1)::INT))::INT) ELSE interval 0 minutes END"
    zoned = f"coalesce({_time_sql(x, iso, [1, 2, 3, 4, 5, 6])}, {_time_sql(x, mail, [3, 2, 1, 4, 5, 6], True)}) - {ahead}"
    return f"""CASE WHEN regexp_matches({x}, '{zone}') THEN {zoned} WHEN regexp_matches({x}, '{local}') THEN {_time_sql(x, local, [1, 2, 3, 4, 5, 6])} - interval 8 hours
      WHEN regexp_matches({x}, '{full}') THEN {_time_sql(x, full, [1, 2, 3, 4, 5, 6])} - interval 8 hours WHEN regexp_matches({x}, '{short}') THEN {_time_sql(x, short, [1, 2, 3, 4, 5, 6])} - interval 8 hours
      ELSE coalesce({_time_sql(x, free, [3, 1, 2, 0, 0, 0], True)}, {_time_sql(x, mail, [3, 2, 1, 4, 5, 6], True)} - {ahead}) END::TIMESTAMP"""


_CLOCK = "\\d{1,2}:\\d{2}|\\b20\\d{12}\\b"


# ---- dates --------------------------------------------------------------------------------------
@query("published_dates", f"WITH x AS ({DATE_TEXT.format(orders='orders')}) SELECT o_orderkey, {parse_sql('said')} AS published_at, regexp_matches(said, '(?i)\\d{{1,2}}:\\d{{2}}(:\\d{{2}})?(Z|[+-]\\d{{2}}:?\\d{{2}})\\b|\\b(GMT|UTC)\\b') AS zoned, regexp_matches(said, '{_CLOCK}') AS clock FROM x")
def _(spark, sf):
    x = spark.sql(DATE_TEXT, orders=T.table(spark, sf, "orders"))
    said = F.col("said")
    return x.select("o_orderkey", D.parse_published(said).alias("published_at"), D.has_zone(said).alias("zoned"), D.has_clock(said).alias("clock"))


_URL_FORMS = ["/(20\\d{2})/(\\d{2})/(\\d{2})(?:/|$)", "/(20\\d{2})/(\\d{2})-(\\d{2})(?:/|$)", "/(20\\d{2})/(\\d{2})(\\d{2})(?:/|[-_.])", "(?:/|-)(20\\d{2})-(\\d{2})-(\\d{2})(?:/|$)", "/(20\\d{2})(\\d{2})(\\d{2})(?:/|[-_.])"]
_URL_DATE = "coalesce(" + ", ".join([_time_sql("p", f, [1, 2, 3, 0, 0, 0]) for f in _URL_FORMS] + [_time_sql("url", "[?&][^=]*=(20\\d{2})(\\d{2})(\\d{2})", [1, 2, 3, 0, 0, 0])]) + ") - interval 8 hours"


@query("url_dates", f"WITH x AS ({DATE_TEXT.format(orders='orders')}), y AS (SELECT *, {_PATH} AS p FROM x) SELECT o_orderkey, ({_URL_DATE})::TIMESTAMP AS published_at FROM y")
def _(spark, sf):
    return spark.sql(DATE_TEXT, orders=T.table(spark, sf, "orders")).select("o_orderkey", U.date_in_path(F.col("url")).alias("published_at"))


_LD = "regexp_extract_all(html, '(?is)<script\\b[^>]*type=[\"'']application/ld\\+json[\"''][^>]*>(.*?)</script>', 1)"
_META = f"list_filter(regexp_extract_all(html, '(?i)<meta\\b[^>]*>'), lambda t: regexp_matches(regexp_replace(coalesce(nullif({attribute_sql('t', 'property')}, ''), nullif({attribute_sql('t', 'name')}, ''), {attribute_sql('t', 'itemprop')}), '[-.]', '_', 'g'), '{{}}'))"
_META_DATES = f"list_filter(list_transform({_META.format(C.DATE_KEYS)}, lambda t: {attribute_sql('t', 'content')}), lambda t: t <> '')"
_TIMES = f"list_filter(flatten(list_transform(regexp_extract_all(html, '(?is)<time\\b[^>]*>.*?</time>'), lambda t: [{attribute_sql('t', 'datetime')}, {clean_sql(tag_sql('t', 'time'))}])), lambda t: t <> '')"
_HEADER = [f"regexp_extract(html, '{p}', {i})".replace("[\"']", "[\"'']").replace("[^\"']", "[^\"'']") for p, i in ((C.HEADER_YEAR, 1), (C.HEADER_DAY, 1), (C.HEADER_DAY, 2), (C.HEADER_TIME, 1))]


def _quoted(pattern: str) -> str:
    """A fixed pattern as DuckDB text: its word borders, and quotes doubled."""
    return pattern.replace(r"(?<!\w)", r"\b").replace(r"(?!\w)", r"\b").replace("'", "''")


_FOUND = [f"regexp_extract_all(txt, '{_quoted(p)}', 1)" for p in C.INLINE_DATES]
_BROKEN = _quoted(C.BROKEN_DATE)
_FOUND.append(f"list_transform(regexp_extract_all(txt, '{_BROKEN}'), lambda t: regexp_extract(t, '{_BROKEN}', 1) || '-' || regexp_extract(t, '{_BROKEN}', 2) || '-' || regexp_extract(t, '{_BROKEN}', 3) || ' ' || regexp_extract(t, '{_BROKEN}', 4))")
_SPLIT = "CASE WHEN {0} <> '' AND {1} <> '' AND {3} <> '' THEN [{0} || '-' || {1} || '-' || {2} || ' ' || {3}] ELSE [] END".format(*_HEADER)
_INLINE = f"flatten([{', '.join([_SPLIT, *_FOUND])}])"
_JSON_DATES = """scripts AS (SELECT page_id, i, {clean} AS s FROM (SELECT page_id, unnest({ld}) AS raw, generate_subscripts({ld}, 1) AS i FROM dated)),
  tree AS (SELECT s.page_id, s.i, t.parent AS node, list_position(['datePublished', 'dateCreated', 'dateModified'], t.key) AS k, t.atom ->> '$' AS value FROM scripts s, LATERAL json_tree(s.s::JSON) t WHERE json_valid(s.s) AND t.type = 'VARCHAR' AND t.key IN ('datePublished', 'dateCreated', 'dateModified')),
  loose AS (SELECT page_id, i, 0 AS node, 0 AS k, unnest(regexp_extract_all(s, '(?i)"date(?:Published|Created|Modified)"\\s*:\\s*"([^"]+)"', 1)) AS value FROM scripts WHERE NOT json_valid(s)),
  linked AS (SELECT page_id, list(value ORDER BY i, node, k) AS v FROM (SELECT * FROM tree UNION ALL SELECT * FROM loose) GROUP BY 1)"""


@query("page_dates", f"""WITH dated AS (SELECT page_id, url, {DATED_HTML} AS html FROM pages), {_JSON_DATES.format(clean=clean_sql('raw'), ld=_LD)},
  texts AS (SELECT *, {clean_sql('html')} AS txt FROM dated),
  c AS (SELECT t.page_id, list_concat(list_concat({_INLINE}, {_TIMES}), list_concat(coalesce(l.v, []), {_META_DATES})) AS c FROM texts t LEFT JOIN linked l USING (page_id)),
  r AS (SELECT page_id, len(c) AS n, list_concat(list_filter(c, lambda t: regexp_matches(t, '{_CLOCK}')), list_filter(c, lambda t: NOT regexp_matches(t, '{_CLOCK}'))) AS c FROM c)
SELECT page_id, n::INT AS n_candidates, list_filter(list_transform(c, lambda t: {parse_sql('t')}), lambda t: t IS NOT NULL)[1] AS published_at FROM r""")
def _(spark, sf):
    pages = T.table(spark, sf, "pages").selectExpr("page_id", "url", f"{DATED_HTML} AS html")
    found = V.page_dates(pages)
    return found.select("page_id", "n_candidates", V.resolved_date(F.lit(None).cast("timestamp"), F.col("named"), U.date_in_path(F.col("url"))).alias("published_at"))


# ---- texts --------------------------------------------------------------------------------------
_BODY = f"list_filter(list_transform(regexp_extract_all(html, '(?is)<p\\b[^>]*>(.*?)</p>', 1), lambda x: {clean_sql('x')}), lambda t: length(t) >= 40 AND NOT regexp_matches(t, '{C.BOILERPLATE}'))"
_DESCRIPTIONS = f"list_filter(list_transform({_META.format(C.DESCRIPTION_KEYS)}, lambda t: {clean_sql(attribute_sql('t', 'content'))}), lambda t: t <> '')"
#: Pages with a description and nested linked data made of their own first paragraph.
DESCRIBED_HTML = f"CASE WHEN page_id % 3 > 0 THEN replace(html, '</head>', '<meta name=\"og.description\" content=\"About ' || {_TITLE} || '\"><script type=\"application/ld+json\">{{\"x\":[{{\"articleBody\":\"' || replace(replace(regexp_extract(html, '(?s)<p>([^<]*)</p>', 1), '\"', ''), chr(92), '') || '\",\"y\":{{\"description\":\"short\"}}}}]' || CASE WHEN page_id % 3 = 1 THEN '}}' ELSE '' END || '</script></head>') ELSE html END"
_JSON_TEXTS = """scripts AS (SELECT page_id, i, trim(raw) AS s FROM (SELECT page_id, unnest({ld}) AS raw, generate_subscripts({ld}, 1) AS i FROM dated)),
  tree AS (SELECT s.page_id, s.i, t.parent AS node, list_position(['description', 'articleBody'], t.key) AS k, {clean} AS value FROM scripts s, LATERAL json_tree(s.s::JSON) t WHERE json_valid(s.s) AND t.type = 'VARCHAR' AND t.key IN ('description', 'articleBody')),
  loose AS (SELECT page_id, i, 0 AS node, 0 AS k, {clean_x} AS value FROM (SELECT page_id, i, unnest(regexp_extract_all(s, '(?i)"(?:description|articleBody)"\\s*:\\s*"([^"]{{40,}})"', 1)) AS x FROM scripts WHERE NOT json_valid(s))),
  linked AS (SELECT page_id, list(value ORDER BY i, node, k) AS v FROM (SELECT * FROM tree UNION ALL SELECT * FROM loose) WHERE length(value) >= 40 GROUP BY 1)"""


@query("article_context", f"""WITH dated AS (SELECT page_id, {DESCRIBED_HTML} AS html FROM pages), {_JSON_TEXTS.format(ld=_LD, clean=clean_sql("(t.atom ->> '$')"), clean_x=clean_sql('x'))},
  c AS (SELECT d.page_id, list_concat(list_concat({_DESCRIPTIONS}, coalesce(l.v, [])), {_BODY}) AS c FROM dated d LEFT JOIN linked l USING (page_id))
SELECT page_id, md5(left(array_to_string(list_transform(list_sort(list_transform(list_distinct(c), lambda t: {{'p': list_position(c, t), 't': t}})), lambda s: s.t), chr(10)), 3200)) AS context_md5 FROM c""")
def _(spark, sf):
    pages = T.table(spark, sf, "pages").selectExpr("page_id", f"{DESCRIBED_HTML} AS html")
    return V.contexts(pages).select("page_id", F.md5("context").alias("context_md5"))


# ---- links, feeds, sitemaps ---------------------------------------------------------------------
def _escaped_sql(x: str) -> str:
    return f"replace(replace(replace(replace(url_encode({x}), '%2F', '/'), '%2C', ','), '%21', '!'), '%3A', ':')"


_PLACE = "regexp_extract(url, '^[a-z]+://[^/?#]*')"


@query("page_links", f"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*href=[\"'']([^\"'']+)[\"''][^>]*>', 1)) AS href FROM pages)
SELECT page_id, href, {_PLACE} || {_escaped_sql('href')} AS resolved, count(*) AS n FROM a GROUP BY ALL""")
def _(spark, sf):
    pages = T.table(spark, sf, "pages")
    a = pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)<a\b[^>]*href=["']([^"']+)["'][^>]*>"""), 1)).alias("href"))
    return a.groupBy("page_id", "href", U.resolve(H.squeezed(H.decode(F.col("href"))), F.col("url")).alias("resolved")).agg(F.count("*").alias("n"))


_ENTRY_LINK = f"{_PLACE} || regexp_replace(regexp_replace({_PATH}, '[^/]*$', ''), '[^/]*/$', '') || 'b/' || page_id || '?x=1&y=2'"


@query("feed_entries", f"""WITH f AS (SELECT page_id, url, {FEED} AS xml FROM pages),
  b AS (SELECT page_id, url, unnest(list_concat(regexp_extract_all(xml, '(?is)<entry\\b.*?</entry>'), regexp_extract_all(xml, '(?is)<item\\b.*?</item>'))) AS b FROM f),
  e AS (SELECT page_id, {clean_sql(tag_sql('b', 'title'))} AS title, CASE WHEN {tag_sql('b', 'link')} <> '' THEN CASE WHEN {_PATH} = '' THEN url || '/' ELSE url END WHEN b LIKE '%href=%' THEN {_ENTRY_LINK} ELSE '' END AS url,
    {clean_sql(f"coalesce(nullif({tag_sql('b', 'description')}, ''), {tag_sql('b', 'summary')})")} AS summary, {parse_sql(clean_sql(f"coalesce(nullif({tag_sql('b', 'pubDate')}, ''), {tag_sql('b', 'updated')})"))} AS published_at FROM b),
  k AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY published_at IS NULL) AS first FROM e WHERE title <> '' AND url <> '')
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY published_at DESC NULLS LAST))::INT AS place, title, url, md5(coalesce(nullif(summary, ''), title)) AS summary, published_at FROM k WHERE first = 1""")
def _(spark, sf):
    f = T.table(spark, sf, "pages").selectExpr("page_id", "url AS base", f"{FEED} AS xml")
    e = f.select("page_id", F.posexplode(H.feed_entries(F.col("xml"), F.col("base"))).alias("place", "e"))
    return e.select("page_id", (F.col("place") + 1).alias("place"), "e.title", "e.url", F.md5("e.summary").alias("summary"), "e.published_at")


@query("sitemap_entries", f"""WITH f AS (SELECT page_id, url, {SITEMAP} AS xml FROM pages),
  b AS (SELECT page_id, url, unnest(regexp_extract_all(xml, '(?is)<url\\b[^>]*>(.*?)</url>', 1)) AS b, generate_subscripts(regexp_extract_all(xml, '(?is)<url\\b[^>]*>(.*?)</url>', 1), 1) AS i FROM f),
  e AS (SELECT page_id, i, url AS base, trim({tag_sql('b', 'loc')}) AS loc, {parse_sql(clean_sql(tag_sql('b', 'lastmod')))} AS published_at FROM b),
  r AS (SELECT page_id, i, base, published_at, CASE WHEN loc LIKE '/%' THEN regexp_extract(base, '^[a-z]+://[^/?#]*') || regexp_replace(loc, '//+', '/', 'g') ELSE loc END AS url FROM e),
  s AS (SELECT *, {_PATH} AS p, regexp_extract(rtrim({_PATH}, '/'), '([^/]*)$', 1) AS last FROM r),
  t AS (SELECT *, trim(regexp_replace(CASE WHEN regexp_matches(last, '%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|$)') THEN last ELSE url_decode(last) END, '[-_]+', ' ', 'g')) AS title FROM s)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY published_at DESC NULLS LAST, i))::INT AS place, title, url, published_at FROM t
WHERE regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www\\.', '') = regexp_replace(regexp_extract(base, '^[a-z]+://([^/?#]*)', 1), '^www\\.', '') AND length(title) >= 8
  AND (regexp_matches(lower(p), '/(20\\d{{2}}|n1|n2|article|articles|news|gn|gj|cj|sh|politics|finance|companies|tech|world)\\b') OR regexp_matches(lower(p), '/\\d{{6,}}\\.(html|shtml)$'))""")
def _(spark, sf):
    f = T.table(spark, sf, "pages").selectExpr("page_id", "url AS base", f"{SITEMAP} AS xml")
    e = f.select("page_id", F.posexplode(H.sitemap_entries(F.col("xml"), F.col("base"))).alias("place", "e"))
    return e.select("page_id", (F.col("place") + 1).alias("place"), "e.title", "e.url", "e.published_at")


@query("page_domains", """WITH h AS (SELECT page_id, lang, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www\\.', '') AS host FROM (SELECT *, page_id % 3 AS lang FROM pages)),
  b AS (SELECT *, CASE lang WHEN 0 THEN host WHEN 1 THEN regexp_extract(host, '([^.]+\\.[^.]+)$', 1) ELSE 'x' || host END AS base FROM h)
SELECT page_id, base, host = base OR ends_with(host, '.' || base) OR ends_with(base, '.' || host) AS same_domain FROM b""")
def _(spark, sf):
    h = T.table(spark, sf, "pages").select("page_id", U.host(F.col("url")).alias("host"))
    base = F.when(F.col("page_id") % 3 == 0, F.col("host")).when(F.col("page_id") % 3 == 1, F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)).otherwise(F.concat(F.lit("x"), "host"))
    return h.withColumn("base", base).select("page_id", "base", X.same_domain(F.col("host"), F.col("base")).alias("same_domain"))
