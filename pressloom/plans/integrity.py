"""Registered queries of report integrity over reports that both engines derive from events alike, sound and damaged."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressloom.operators import integrity as I
from pressloom.plans.queries import query
from pressloom.sources import tables as T

#: Each user's events are a report: an item, a story and a candidate an event; {d} is whether ids damage it.
DERIVED = {
    "e": "SELECT user_id AS report, event_id AS i, ts, event_type, CAST(event_id % 20 AS STRING) AS s, 'c' || event_id AS c FROM {events}",
    "items": "SELECT report, CASE WHEN {d} AND i % 97 = 0 THEN '' WHEN {d} AND i % 89 = 0 THEN 'i1' ELSE 'i' || i END AS item FROM e",
    "stories": "SELECT report, CASE WHEN {d} AND i % 101 = 0 THEN NULL WHEN {d} AND i % 83 = 0 THEN 's1' ELSE 's' || i END AS story, CASE WHEN {d} AND i % 79 = 0 THEN 'i1' ELSE 'i' || i END AS item, CASE WHEN {d} AND i % 61 = 0 THEN ts + INTERVAL 2 HOURS ELSE ts - INTERVAL 2 HOURS END AS started_at, ts AS updated_at, 'card ' || i AS digest FROM e",
    "evidence": "SELECT report, 's' || i AS story, CASE WHEN {d} AND i % 71 = 0 THEN '' WHEN {d} AND i % 73 = 0 THEN 'c1' ELSE c END AS candidate, CASE WHEN {d} AND i % 67 = 0 THEN 'srcx' ELSE 'src' || s END AS source, CASE WHEN {d} AND i % 59 = 0 THEN 'http://' WHEN {d} AND i % 53 = 0 THEN 'https://else.' ELSE 'https://www.' END || 'src' || s || '.example.com/' || i AS url, CASE WHEN {d} AND i % 47 = 0 THEN ts + INTERVAL 1 HOURS WHEN i % 5 > 0 THEN ts - INTERVAL 1 HOURS END AS published_at FROM e WHERE NOT ({d} AND i % 43 = 0)",
    "bounds": "SELECT report, max(ts) AS top, count(*) AS n, count(DISTINCT s) AS n_sources FROM e GROUP BY report",
    "reports": "SELECT report, CASE WHEN {d} AND report % 41 = 0 THEN 1 ELSE 2 END AS version, CASE WHEN {d} AND report % 37 = 0 THEN NULL ELSE top END AS generated_at, CASE WHEN {d} AND report % 31 = 0 THEN n + 1 ELSE n END AS accepted, CASE WHEN {d} AND report % 29 = 0 THEN 0 ELSE n_sources END AS source_count, CASE WHEN {d} AND report % 23 = 0 THEN 1 ELSE 0 END AS unmapped FROM bounds",
    "numbered": "SELECT e.report, i, ts, row_number() OVER (PARTITION BY e.report ORDER BY ts DESC, 's' || i) - 1 AS pos, top FROM e JOIN bounds b ON e.report = b.report WHERE ts >= top - INTERVAL 24 HOURS",
    "lists": "SELECT report, 'latest' AS list, CAST(pos AS INT) AS pos, CASE WHEN {d} AND i % 37 = 0 THEN 'gone' ELSE 's' || i END AS story, CASE WHEN {d} AND i % 31 = 0 THEN 'old card' ELSE 'card ' || i END AS digest FROM numbered WHERE NOT ({d} AND i % 29 = 0) UNION ALL SELECT report, event_type, CAST(i % 7 AS INT), 's' || i, 'card ' || i FROM e WHERE i % 11 = 0 AND event_type <> 'view'",
    "sections": "SELECT report, event_type AS section, CASE WHEN {d} AND i % 113 = 0 THEN 'gone' ELSE 's' || i END AS story FROM e",
}
SOURCES = "SELECT 'src' || id AS source, 'src' || id || '.example.com' AS host FROM {ids} WHERE id < 20 AND ({d} = false OR id <> 7)"


def tables_of(spark, events, damaged: bool) -> I.Tables:
    """The derived reports as the operator's tables."""
    chain = ", ".join(f"{k} AS ({v.replace('{d}', str(damaged).lower())})" for k, v in DERIVED.items())
    read = lambda name: spark.sql(f"WITH {chain} SELECT * FROM {name}", events=events)
    return I.Tables(**{k: read(k) for k in ("reports", "items", "stories", "evidence", "lists", "sections")})


def sources_of(spark, damaged: bool):
    return spark.sql(SOURCES.replace("{d}", str(damaged).lower()), ids=spark.range(20))


_WITH = ", ".join(f"{k} AS ({v.replace('{d}', 'true').replace('{events}', 'events')})" for k, v in DERIVED.items())
_HTTPS, _PLACE = "regexp_matches(url, '^https://[^/?#]+')", "lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"


@query("report_violations", f"""WITH {_WITH}, src AS (SELECT 'src' || i AS source, 'src' || i || '.example.com' AS host FROM range(20) t(i) WHERE i <> 7),
  ev AS (SELECT e.*, s.updated_at, src.host FROM evidence e LEFT JOIN stories s ON s.report = e.report AND s.story = e.story LEFT JOIN src USING (source)),
  known AS (SELECT DISTINCT report, story FROM stories WHERE story <> ''), own AS (SELECT report, story, max(digest) AS digest FROM stories WHERE story <> '' GROUP BY 1, 2),
  late AS (SELECT s.report, s.story, s.updated_at, s.updated_at >= r.generated_at - interval 24 hours AS day FROM stories s JOIN reports r USING (report) WHERE s.updated_at <= r.generated_at AND s.updated_at >= r.generated_at - interval 72 hours),
  want AS (SELECT report, list(coalesce(story, '') ORDER BY updated_at DESC, story NULLS FIRST) AS ids FROM (SELECT *, bool_or(day) OVER (PARTITION BY report) AS has FROM late) WHERE day OR NOT has GROUP BY 1),
  told AS (SELECT report, list, list(story ORDER BY pos, story) AS ids, list(story || '|' || digest ORDER BY pos, story) AS cards FROM lists GROUP BY 1, 2),
  back AS (SELECT t.report, t.list, list(l.story || '|' || o.digest ORDER BY l.pos, l.story) AS cards FROM told t JOIN lists l USING (report, list) JOIN own o ON o.report = l.report AND o.story = l.story GROUP BY 1, 2),
  v AS (
    SELECT report, 'unsupported_schema_version' AS rule, '' AS key FROM reports WHERE version <> 2 UNION ALL SELECT report, 'invalid_generated_at', '' FROM reports WHERE generated_at IS NULL
    UNION ALL SELECT report, 'empty_sources', '' FROM reports WHERE source_count < 1 UNION ALL SELECT report, 'unmapped_candidates', '' FROM reports WHERE unmapped <> 0
    UNION ALL SELECT report, 'duplicate_or_missing_item_id', item FROM items GROUP BY ALL HAVING item = '' OR count(*) > 1
    UNION ALL SELECT report, 'duplicate_or_missing_story_id', coalesce(story, '') FROM stories GROUP BY ALL HAVING coalesce(story, '') = '' OR count(*) > 1
    UNION ALL SELECT report, 'invalid_story_item_reference', item FROM (SELECT report, item, count(*) AS n FROM stories GROUP BY 1, 2) s WHERE n > 1 OR NOT EXISTS (SELECT 1 FROM items i WHERE i.report = s.report AND i.item = s.item)
    UNION ALL SELECT report, 'invalid_story_time_relation', coalesce(story, '') FROM stories WHERE started_at > updated_at
    UNION ALL SELECT report, 'missing_story_evidence', coalesce(story, '') FROM stories s WHERE NOT EXISTS (SELECT 1 FROM evidence e WHERE e.report = s.report AND e.story = coalesce(s.story, ''))
    UNION ALL SELECT report, 'duplicate_or_missing_candidate_mapping', candidate FROM evidence GROUP BY ALL HAVING candidate = '' OR count(*) > 1
    UNION ALL SELECT report, 'unapproved_evidence_source', candidate FROM ev WHERE host IS NULL
    UNION ALL SELECT report, 'evidence_url_out_of_scope', candidate FROM ev WHERE host IS NOT NULL AND NOT ({_HTTPS} AND ({_PLACE} = host OR ends_with({_PLACE}, '.' || host)))
    UNION ALL SELECT report, 'invalid_story_url', candidate FROM ev WHERE NOT {_HTTPS} UNION ALL SELECT report, 'invalid_evidence_time_relation', candidate FROM ev WHERE published_at > updated_at
    UNION ALL SELECT report, 'dangling_story_reference', story FROM lists l WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.report = l.report AND k.story = l.story)
    UNION ALL SELECT report, 'dangling_section_reference', story FROM sections l WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.report = l.report AND k.story = l.story)
    UNION ALL SELECT l.report, 'inconsistent_story_reference', l.story FROM lists l LEFT JOIN own o ON o.report = l.report AND o.story = l.story WHERE o.digest IS NULL OR o.digest <> l.digest
    UNION ALL SELECT report, 'unmapped_report_item', '' FROM reports r WHERE (SELECT count(DISTINCT item) FROM items i WHERE i.report = r.report) <> (SELECT count(DISTINCT item) FROM stories i WHERE i.report = r.report)
    UNION ALL SELECT report, 'candidate_mapping_count_mismatch', '' FROM reports r WHERE accepted <> (SELECT count(DISTINCT candidate) FROM evidence i WHERE i.report = r.report)
    UNION ALL SELECT report, 'source_count_mismatch', '' FROM reports r WHERE source_count <> (SELECT count(DISTINCT source) FROM evidence i WHERE i.report = r.report)
    UNION ALL SELECT r.report, 'incomplete_latest_stories', '' FROM reports r LEFT JOIN want w USING (report) LEFT JOIN told t ON t.report = r.report AND t.list = 'latest' WHERE coalesce(w.ids, []) <> coalesce(t.ids, [])
    UNION ALL SELECT t.report, 'compact_round_trip_mismatch', t.list FROM told t LEFT JOIN back b USING (report, list) WHERE b.cards IS NULL OR b.cards <> t.cards)
SELECT DISTINCT report, rule, key FROM v""")
def _(spark, sf):
    return I.violations(tables_of(spark, T.table(spark, sf, "events"), True), sources_of(spark, True))


@query("compact_lists", f"WITH {_WITH.replace('true', 'false')} SELECT report, list, array_to_string(list(story ORDER BY pos, story), ',') AS ids FROM lists GROUP BY 1, 2")
def _(spark, sf):
    t = tables_of(spark, T.table(spark, sf, "events"), False)
    return I.compact(t.lists).select("report", "list", F.array_join("ids", ",").alias("ids"))
