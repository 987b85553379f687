"""Registered queries of address policy, storage codec and last-known-good candidates, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressloom.operators import codec, fallback, legacy, network
from pressloom.plans.queries import query
from pressloom.sources import tables as T

# ---- addresses ----------------------------------------------------------------------------------
_QUAD = "(event_id * 7919 % 256) || '.' || (event_id * 31 % 256) || '.' || (event_id * 13 % 256) || '.' || (event_id % 256)"
_NEAR = "CASE event_id % 14 WHEN 0 THEN '10.' || (event_id % 256) || '.0.1' WHEN 1 THEN '100.' || (event_id % 256) || '.2.3' WHEN 2 THEN '169.25' || (event_id % 6) || '.1.1' WHEN 3 THEN '172.' || (event_id % 40) || '.9.9' WHEN 4 THEN '192.168.' || (event_id % 256) || '.7' WHEN 5 THEN '198.1' || (event_id % 10) || '.0.4' WHEN 6 THEN '192.0.' || (event_id % 4) || '.200' ELSE '203.0.11' || (event_id % 5) || '.8' END"
#: Addresses of six kinds made from event ids, in both engines alike; the seventh kind is none.
ADDRESS = f"CASE event_id % 9 WHEN 0 THEN '::ffff:' || {_QUAD} WHEN 1 THEN '2001:' || CASE event_id % 3 WHEN 0 THEN 'db8' ELSE 'db9' END || '::' || (event_id % 1000) WHEN 2 THEN 'f' || substr('89abcdef', CAST(event_id % 8 + 1 AS INT), 1) || substr('0489abcf', CAST(event_id % 7 + 1 AS INT), 1) || '0::1' WHEN 3 THEN '2a00:1450:4001:81b::' || (event_id % 999) WHEN 4 THEN CASE event_id % 4 WHEN 0 THEN '::' WHEN 1 THEN '::1' WHEN 2 THEN '1.2.3' ELSE '256.1.1.1' END WHEN 5 THEN {_NEAR} ELSE {_QUAD} END"
_V4 = "regexp_replace(address, '^::ffff:', '')"
_NUMBER = f"list_reduce(list_transform(string_split({_V4}, '.'), lambda p: p::BIGINT), lambda a, b: a * 256 + b)"


def _v4_sql() -> str:
    """The longest blocked IPv4 network by ranges of numbers."""
    out = []
    for n in sorted((n for n in network.BLOCKED if ":" not in n), key=lambda n: -int(n.split("/")[1])):
        base, bits = n.split("/")
        low = sum(int(p) << (8 * (3 - i)) for i, p in enumerate(base.split(".")))
        out.append(f"WHEN num BETWEEN {low} AND {low + (1 << (32 - int(bits))) - 1} THEN '{n}'")
    return "CASE " + " ".join(out) + " END"


@query("source_addresses", f"""WITH a AS (SELECT event_id, {ADDRESS} AS address FROM events), f AS (SELECT *, regexp_matches({_V4}, '^(25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)(\\.(25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)){{3}}$') AS four, contains(address, ':') AS colon FROM a),
  n AS (SELECT *, CASE WHEN four THEN {_NUMBER} END AS num FROM f),
  m AS (SELECT event_id, address, CASE WHEN four THEN 4 WHEN colon THEN 6 ELSE 0 END AS family, CASE WHEN four THEN {_v4_sql()} WHEN address = '::' THEN '::/128' WHEN address = '::1' THEN '::1/128' WHEN address LIKE '2001:db8:%' THEN '2001:db8::/32'
    WHEN regexp_matches(address, '^f[cd]') THEN 'fc00::/7' WHEN regexp_matches(address, '^fe[89ab]') THEN 'fe80::/10' WHEN address LIKE 'ff%' THEN 'ff00::/8' WHEN regexp_matches(address, '^[23]') AND colon THEN '2000::/3' END AS network FROM n)
SELECT event_id, address, family, network, CASE family WHEN 4 THEN network IS NULL WHEN 6 THEN coalesce(network = '2000::/3', false) ELSE false END AS public FROM m""")
def _(spark, sf):
    a = T.table(spark, sf, "events").selectExpr("event_id", f"{ADDRESS} AS address")
    return network.matched(a, network.networks(spark))


# ---- codec --------------------------------------------------------------------------------------
@query("report_codec", """WITH r AS (SELECT source AS report, '[' || string_agg('"' || doc_id || ' ' || left(md5(text), 8) || '"', ',' ORDER BY doc_id) || ']' AS text FROM documents GROUP BY source)
SELECT report, md5(text) AS md5, strlen(text)::INT AS n_bytes, true AS stored_is_envelope, md5(text) AS older_md5 FROM r""")
def _(spark, sf):
    d = T.table(spark, sf, "documents").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", F.concat_ws(" ", "doc_id", F.substring(F.md5("text"), 1, 8)).alias("x")))).alias("x"))
    r = d.select(F.col("source").alias("report"), F.to_json(F.transform("x", lambda s: s["x"])).alias("raw"))
    back = codec.decoded(codec.encoded(r, "raw"), "stored")
    older = codec.decoded(back.select("report", F.col("raw").alias("kept")), "kept", "older")
    return back.join(older, "report").select("report", F.md5("text").alias("md5"), F.octet_length("text").alias("n_bytes"), (F.get_json_object("stored", "$.encoding") == codec.ENCODING).alias("stored_is_envelope"), F.md5("older").alias("older_md5"))


# ---- last known good ----------------------------------------------------------------------------
GOOD = {
    "e": "SELECT event_id AS i, user_id AS report, user_id % 3 = 0 AS failed, event_type, ts FROM {events}",
    "stories": "SELECT report, 's' || i AS story, 'i' || i AS item, 'story ' || i AS title, event_type AS beat, 'what ' || i AS what_happened, CASE WHEN i % 3 > 0 THEN ts END AS published_at, CASE WHEN i % 4 > 0 THEN ts - INTERVAL 1 HOURS END AS started_at, ts AS updated_at, CASE WHEN i % 5 = 0 THEN 'pending' END AS summary_status FROM e",
    "evidence": "SELECT report, 's' || i AS story, 'c' || i || '-' || k AS candidate, 'src' || (i * k % 25) AS source, CASE WHEN i % 2 = 0 THEN '' ELSE 'proof ' || i END AS title, 'https://x.example/' || i || '/' || k AS url, CASE WHEN i % 7 = 0 THEN ts - INTERVAL 2 HOURS END AS published_at FROM e, ks WHERE k <= 1 + i % 2",
    "items": "SELECT report, 'i' || i AS item, CASE WHEN i % 6 = 0 THEN '' ELSE 'ai,' || event_type END AS cats, CASE WHEN i % 8 > 0 THEN event_type END AS primary_category, 'en' AS language, 'complete' AS summary_status FROM e WHERE i % 9 > 0",
    "sources": "SELECT 'src' || (k - 1) AS source, CASE WHEN k % 2 = 0 THEN 'zh-CN' END AS language FROM ids WHERE k <= 20",
    "window": "SELECT report, 'w' || i AS candidate, 'fresh ' || i AS title, 'https://w.example/' || i AS url, 'src1' AS source, 'en' AS language, event_type AS primary_category, event_type AS cats, 'read' AS summary, ts AS published_at, ts AS updated_at, ts AS discovered_at, 'complete' AS summary_status FROM e WHERE i % 4 = 0",
}


def _good(ids: str) -> str:
    return f"ids AS ({ids}), ks AS (SELECT k FROM ids WHERE k <= 2), " + ", ".join(f"{k} AS ({v})" for k, v in GOOD.items())


@query("last_known_good", f"""WITH {_good('SELECT unnest(range(1, 26)) AS k').replace('{events}', 'events')},
  b AS (SELECT e.report, e.candidate, coalesce(nullif(e.title, ''), s.title) AS title, e.url, e.source, coalesce(o.language, i.language, 'zh-CN') AS language, coalesce(i.primary_category, s.beat) AS primary_category, CASE WHEN i.cats <> '' THEN i.cats ELSE s.beat END AS categories,
    s.what_happened AS summary, coalesce(e.published_at, s.published_at) AS published_at, s.updated_at, coalesce(s.started_at, e.published_at, s.updated_at) AS discovered_at, coalesce(s.summary_status, i.summary_status) AS summary_status
    FROM evidence e JOIN stories s ON s.report = e.report AND s.story = e.story LEFT JOIN items i ON i.report = s.report AND i.item = s.item LEFT JOIN sources o ON o.source = e.source)
SELECT *, true AS degraded FROM b WHERE report % 3 = 0 UNION ALL SELECT report, candidate, title, url, source, language, primary_category, cats, summary, published_at, updated_at, discovered_at, summary_status, false FROM window_ WHERE report % 3 <> 0""".replace("window AS (", "window_ AS ("))
def _(spark, sf):
    events, chain = T.table(spark, sf, "events"), _good("SELECT id + 1 AS k FROM range(25)")
    read = lambda name: spark.sql(f"WITH {chain} SELECT * FROM {name}", events=events)
    listed = lambda df: df.withColumn("categories", F.filter(F.split("cats", ","), lambda c: c != "")).drop("cats")
    good = fallback.rebuilt(read("stories"), read("evidence"), listed(read("items")), read("sources"))
    reads = read("e").select("report", (~F.col("failed")).alias("ok")).distinct()
    return fallback.with_last_known_good(listed(read("window")), reads, good).withColumn("categories", F.array_join("categories", ","))


# ---- reports of either version ------------------------------------------------------------------
#: Each source's documents are a report: of the second version, the first, an empty or a broken one.
_ITEM = """'{"id":"i' || doc_id || '","title":"t' || doc_id || '","url":"https://x.example/' || doc_id || '","sourceId":"s' || (doc_id % 7) || '","sourceName":"n' || (doc_id % 7) || '"' || CASE WHEN doc_id % 3 > 0 THEN ',"sourceIds":["a' || doc_id || '"' || CASE WHEN doc_id % 3 = 2 THEN ',"b' || doc_id || '","a' || doc_id || '"' ELSE '' END || ']' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN ',"sourceNames":["first"],"relatedUrls":[]' WHEN doc_id % 5 = 1 THEN ',"relatedUrls":["https://r.example/' || doc_id || '"]' ELSE '' END || CASE WHEN doc_id % 4 > 0 THEN ',"publishedAt":"2024-01-0' || (doc_id % 9 + 1) || 'T00:00:00Z"' ELSE '' END || CASE WHEN doc_id % 6 = 0 THEN ',"updatedAt":"2024-02-0' || (doc_id % 9 + 1) || 'T00:00:00Z"' ELSE '' END || ',"extractedAt":"2024-03-01T00:00:00Z"}'"""
_STORY = """'{"id":"s' || doc_id || '","itemId":"i' || doc_id || '","updatedAt":"2024-01-2' || (doc_id % 9) || 'T00:00:00Z"' || CASE WHEN doc_id % 8 = 0 THEN ',"startedAt":"2023-12-31T00:00:00Z"' ELSE '' END || ',"evidence":[{"publishedAt":"2024-01-1' || (doc_id % 9) || 'T00:00:00Z"},{"publishedAt":"soon"},{}]}'"""
_PARTS = "'{{\"version\":2,\"generatedAt\":\"2024-01-31T00:00:00Z\",\"topStories\":[],\"importantStories\":[],\"watchlist\":[],\"sections\":[],\"quality\":{{}},' || CASE WHEN report % 6 = 4 THEN '' ELSE '\"coverage\":{{\"a\":1}},' END || '\"stories\":['".replace("{{", "{").replace("}}", "}")
#: One of the second version without coverage is read as the first.
VERSION = "CASE report % 6 WHEN 0 THEN '{\"items\":[]}' WHEN 1 THEN '{\"items\":[' || items WHEN 2 THEN '{\"generatedAt\":\"x\",\"items\":[' || items || ']}' ELSE " + _PARTS + " || stories || '],\"items\":[' || items || ']}' END"
REPORT, STORY = "doc_id % 40", f"CASE WHEN doc_id % 10 < 9 THEN {_STORY} END"


def _versions(spark, sf):
    d = T.table(spark, sf, "documents").selectExpr(f"{REPORT} AS report", "doc_id", f"{_ITEM} AS item", f"{STORY} AS story")
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("doc_id", c)))), lambda s: s[c]), ",")
    lists = d.groupBy("report").agg(joined("item").alias("items"), joined("story").alias("stories"))
    return legacy.versioned(lists.selectExpr("report", f"{VERSION} AS text"))


_V2 = " AND ".join(f"json_type(v, '$.{k}') = 'ARRAY'" for k in legacy.V2_LISTS)
_TEXTS = f"""d AS (SELECT {REPORT} AS report, doc_id, {_ITEM} AS item, {STORY} AS story FROM documents), l AS (SELECT report, string_agg(item, ',' ORDER BY doc_id) AS items, coalesce(string_agg(story, ',' ORDER BY doc_id), '') AS stories FROM d GROUP BY 1), t AS (SELECT report, {VERSION} AS text FROM l),
  j AS (SELECT report, CASE WHEN json_valid(text) THEN text::JSON END AS v FROM t), f AS (SELECT *, CASE WHEN (v ->> '$.version') = '2' AND {_V2} AND json_type(v, '$.coverage') IS NOT NULL AND json_type(v, '$.quality') IS NOT NULL AND try_strptime(v ->> '$.generatedAt', '%Y-%m-%dT%H:%M:%SZ') IS NOT NULL THEN 'v2' WHEN json_array_length(v, '$.items') > 0 THEN 'v1' ELSE 'none' END AS form FROM j)"""


@query("legacy_items", f"""WITH {_TEXTS}, i AS (SELECT report, (e.key::BIGINT)::INT AS place, e.value AS i FROM f, LATERAL json_each(f.v, '$.items') e WHERE form = 'v1'),
  x AS (SELECT *, from_json(i -> '$.sourceIds', '["VARCHAR"]') AS ids, from_json(i -> '$.sourceNames', '["VARCHAR"]') AS names, from_json(i -> '$.relatedUrls', '["VARCHAR"]') AS urls FROM i),
  y AS (SELECT *, CASE WHEN len(ids) > 0 THEN ids ELSE [i ->> '$.sourceId'] END AS many FROM x), z AS (SELECT *, unnest(range(len(many)))::INT AS at_ FROM y)
SELECT report, place, at_ AS "at", CASE WHEN len(many) > 1 THEN (i ->> '$.id') || '-evidence-' || (at_ + 1) ELSE i ->> '$.id' END AS id, coalesce(CASE WHEN len(urls) > 0 THEN urls[at_ + 1] WHEN at_ = 0 THEN i ->> '$.url' END, i ->> '$.url') AS url,
  many[at_ + 1] AS source_id, coalesce(CASE WHEN len(names) > 0 THEN names[at_ + 1] END, i ->> '$.sourceName') AS source_name FROM z""")
def _(spark, sf):
    return legacy.expanded_items(_versions(spark, sf), "report").select("report", "place", "at", "id", "url", "source_id", "source_name")


_AT = "try_strptime({}, '%Y-%m-%dT%H:%M:%SZ')"


@query("normalised_items", f"""WITH {_TEXTS}, i AS (SELECT report, (e.key::BIGINT)::INT AS place, e.value AS i FROM f, LATERAL json_each(f.v, '$.items') e WHERE form = 'v2'),
  s AS (SELECT report, e.value ->> '$.itemId' AS item, {_AT.format("(e.value ->> '$.updatedAt')")} AS u, {_AT.format("(e.value ->> '$.startedAt')")} AS st, {_AT.format("(e.value ->> '$.evidence[0].publishedAt')")} AS p FROM f, LATERAL json_each(f.v, '$.stories') e WHERE form = 'v2'),
  k AS (SELECT i.*, s.u, coalesce(s.st, least(s.u, s.p)) AS st, {_AT.format("(i ->> '$.updatedAt')")} AS own, {_AT.format("(i ->> '$.publishedAt')")} AS pub, {_AT.format("(i ->> '$.extractedAt')")} AS ex FROM i LEFT JOIN s ON s.report = i.report AND s.item = (i.i ->> '$.id'))
SELECT report, place, i ->> '$.id' AS id, i ->> '$.sourceId' AS source_id, coalesce(own, u, pub, ex)::TIMESTAMP AS updated_at, coalesce(st, pub, own, u, ex)::TIMESTAMP AS started_at FROM k""")
def _(spark, sf):
    return legacy.normalised_items(_versions(spark, sf), "report").select("report", "place", "id", "source_id", "updated_at", "started_at")
