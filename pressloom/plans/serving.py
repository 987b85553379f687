"""Registered queries over what readers are shown, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressloom.functions import cards
from pressloom.operators import serving as V
from pressloom.plans.queries import query
from pressloom.sources import tables as T

NOW = f"timestamp '{T.NOW}'"


@query("coverage_status", f"""WITH s AS (SELECT user_id, user_id % 40 AS service, user_id % 40 > 2 AND user_id % 11 <> 0 AS enabled, CASE WHEN user_id % 97 <> 0 THEN max(ts) END AS seen_at FROM events GROUP BY user_id),
  g AS (SELECT service, count(*) FILTER (enabled) AS enabled_count, count(*) FILTER (enabled AND seen_at IS NULL) AS never, min(seen_at) FILTER (enabled) AS full_at FROM s GROUP BY 1)
SELECT service, enabled_count, CASE WHEN never = 0 THEN full_at END AS full_sweep_at,
  CASE WHEN enabled_count = 0 THEN 'unavailable' WHEN never > 0 THEN 'incomplete' WHEN full_at >= {NOW} - interval 14400 minutes THEN 'current' ELSE 'stale' END AS coverage_status FROM g""")
def _(spark, sf):
    i = F.col("user_id")
    s = T.table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("at"))
    s = s.select((i % 40).alias("service"), ((i % 40 > 2) & (i % 11 != 0)).alias("enabled"), F.when(i % 97 != 0, F.col("at")).alias("last_attempt_at"))
    return V.coverage_status(s, "service", T.now(), 14_400)


@query("report_choice", f"""WITH r AS (SELECT event_id AS i, ts AS t FROM events),
  p AS (SELECT i, i % 13 = 0 AS none, CASE WHEN i % 3 > 0 THEN ['durable', 'browser-cache'][i % 3] END AS m, CASE WHEN i % 5 > 0 THEN t + to_minutes((i % 7)::INT) END AS s, CASE WHEN i % 4 > 0 THEN t END AS d, t AS g,
    CASE WHEN i % 7 > 1 THEN ['durable', 'bundled'][i % 2 + 1] END AS cm, CASE WHEN i % 6 > 0 THEN t + to_minutes((i % 11 % 7)::INT) END AS cs, CASE WHEN i % 9 > 0 THEN t + to_minutes((i % 3 - 1)::INT) END AS cd, t - interval 1 minute AS cg FROM r),
  q AS (SELECT *, coalesce(m = 'durable', false) AS dm, coalesce(cm = 'durable', false) AS dc, coalesce(coalesce(cd, cg) >= coalesce(d, g), false) AS later FROM p)
SELECT i AS event_id, CASE WHEN none THEN true WHEN dm AND NOT dc THEN false WHEN dc AND cs IS NOT NULL AND (NOT dm OR s IS NULL) THEN true WHEN dc AND cs IS NOT NULL AND s <> cs THEN cs > s ELSE later END AS replaced FROM q""")
def _(spark, sf):
    i, t = F.col("event_id"), F.col("ts").cast("timestamp")
    later = lambda m: t + F.make_interval(mins=m.cast("int"))
    kept = F.struct(
        F.when(i % 3 == 1, "durable").when(i % 3 == 2, "browser-cache").alias("serving_mode"), F.when(i % 5 > 0, later(i % 7)).alias("publication_state_at"),
        F.when(i % 4 > 0, t).alias("data_as_of"), t.alias("generated_at"),
    )
    offered = F.struct(
        F.when(i % 7 > 1, F.when(i % 2 == 0, "durable").otherwise("bundled")).alias("serving_mode"), F.when(i % 6 > 0, later(i % 11 % 7)).alias("publication_state_at"),
        F.when(i % 9 > 0, later(i % 3 - 1)).alias("data_as_of"), later(F.lit(-1)).alias("generated_at"),
    )
    pairs = T.table(spark, sf, "events").select("event_id", F.when(i % 13 != 0, kept).alias("current"), offered.alias("candidate"))
    return pairs.select("event_id", V.replaces("current", "candidate").alias("replaced"))


@query("freshness_view", f"""WITH r AS (SELECT event_id AS i, CASE WHEN event_id % 17 > 0 THEN ts END AS g, CASE WHEN event_id % 3 = 0 THEN ts + interval 5 minutes END AS d, CASE event_id % 6 WHEN 0 THEN 'fresh' WHEN 1 THEN 'stale' WHEN 2 THEN 'degraded' WHEN 3 THEN 'unavailable' WHEN 4 THEN 'odd' END AS claim,
    CASE WHEN event_id % 5 = 0 THEN 'failed' WHEN event_id % 5 = 1 THEN 'healthy' END AS p, CASE WHEN event_id % 7 = 0 THEN 'quiet' WHEN event_id % 7 = 1 THEN 'stale' END AS c, CASE WHEN event_id % 4 = 0 THEN 20000.0 WHEN event_id % 4 = 1 THEN -1.0 END AS m FROM events),
  a AS (SELECT *, CASE WHEN claim <> 'odd' THEN claim END AS said, CASE WHEN coalesce(d, g) IS NULL THEN 'unavailable' WHEN (epoch_us({NOW}) - epoch_us(coalesce(d, g))) / 60e6 > CASE WHEN m > 0 THEN m ELSE 30.0 END THEN 'stale' ELSE 'fresh' END AS inf FROM r),
  b AS (SELECT *, coalesce(p, CASE said WHEN 'unavailable' THEN 'failed' WHEN 'degraded' THEN 'degraded' ELSE 'healthy' END) AS pipe, coalesce(c, CASE WHEN inf = 'stale' THEN 'stale' ELSE 'current' END) AS content, coalesce(said = 'fresh' AND inf = 'stale', false) AS overdue FROM a)
SELECT i AS event_id, CASE WHEN said = 'unavailable' THEN said WHEN pipe IN ('degraded', 'failed') THEN 'degraded' WHEN content = 'stale' OR overdue THEN 'stale' ELSE coalesce(said, inf) END AS shown_status, pipe AS shown_pipeline, content AS shown_content, said IS NULL OR overdue AS was_inferred FROM b""")
def _(spark, sf):
    i, t = F.col("event_id"), F.col("ts").cast("timestamp")
    r = T.table(spark, sf, "events").select(
        "event_id", F.when(i % 17 > 0, t).alias("generated_at"), F.when(i % 3 == 0, t + F.make_interval(mins=F.lit(5))).alias("data_as_of"),
        F.when(i % 6 == 0, "fresh").when(i % 6 == 1, "stale").when(i % 6 == 2, "degraded").when(i % 6 == 3, "unavailable").when(i % 6 == 4, "odd").alias("status"),
        F.when(i % 5 == 0, "failed").when(i % 5 == 1, "healthy").alias("pipeline_status"), F.when(i % 7 == 0, "quiet").when(i % 7 == 1, "stale").alias("content_status"),
        F.when(i % 4 == 0, 20_000.0).when(i % 4 == 1, -1.0).alias("stale_after_minutes"),
    )
    return V.freshness_view(r, T.now()).select("event_id", "shown_status", "shown_pipeline", "shown_content", "was_inferred")


@query("public_summary", f"""WITH s AS (SELECT user_id AS report, CASE WHEN event_id % 19 = 0 THEN '' ELSE 'story-' || (event_id % 23) END AS id, ts, event_type = 'view' AS listed FROM events),
  r AS (SELECT user_id AS report, user_id % 3 = 0 AS lists, CASE WHEN user_id % 4 > 0 THEN count(*) END AS accepted, CASE WHEN user_id % 5 > 0 THEN user_id % 5 END AS unmapped FROM events GROUP BY user_id),
  w AS (SELECT s.*, r.lists, ts <= {NOW} AND ts >= {NOW} - interval 24 hours AS day, ts <= {NOW} AND ts >= {NOW} - interval 72 hours AS three FROM s JOIN r USING (report)),
  x AS (SELECT *, bool_or(day) OVER (PARTITION BY report) AS has_day FROM w), y AS (SELECT *, CASE WHEN lists THEN listed WHEN has_day THEN day ELSE three END AS shown FROM x),
  z AS (SELECT *, id <> '' AND bool_or(shown) OVER (PARTITION BY report, id) AS seen FROM y),
  g AS (SELECT report, count(*) FILTER (day AND id <> '') AS e, count(*) FILTER (day AND seen) AS v, count(*) FILTER (three AND id <> '') AS fe, count(*) FILTER (three AND seen) AS fv, count(*) FILTER (three) AS t, count(*) FILTER (shown AND id <> '') - count(DISTINCT id) FILTER (shown AND id <> '') AS dup FROM z GROUP BY report),
  m AS (SELECT user_id AS report, count(DISTINCT event_id % 29) FILTER (event_id % 29 > 0) AS mapped FROM events GROUP BY 1)
SELECT report, e AS eligible_24h, v AS visible_24h, e - v AS missing_24h, CASE WHEN e = 0 THEN 1.0::DOUBLE ELSE v / e END AS recall, dup AS duplicate_ids, CASE WHEN e > 0 THEN 24 WHEN t > 0 THEN 72 END AS fallback_hours,
  CASE WHEN e = 0 THEN fe ELSE 0 END AS eligible_fallback, CASE WHEN e = 0 THEN fv ELSE 0 END AS visible_fallback,
  CASE WHEN unmapped IS NULL AND accepted IS NULL THEN NULL ELSE greatest(unmapped, CASE WHEN accepted IS NOT NULL THEN greatest(0, accepted - coalesce(mapped, 0)) END) END AS unmapped FROM r JOIN g USING (report) LEFT JOIN m USING (report)""")
def _(spark, sf):
    e, i, u = T.table(spark, sf, "events"), F.col("event_id"), F.col("user_id")
    stories = e.select(u.alias("report"), F.when(i % 19 == 0, "").otherwise(F.concat(F.lit("story-"), i % 23)).alias("story_id"), F.col("ts").cast("timestamp").alias("updated_at"), (F.col("event_type") == "view").alias("listed"))
    evidence = e.select(u.alias("report"), F.when(i % 29 > 0, (i % 29).cast("string")).otherwise("").alias("candidate_id"))
    reports = e.groupBy("user_id").agg(F.count("*").alias("n")).select(u.alias("report"), (u % 3 == 0).alias("lists_latest"), F.when(u % 4 > 0, F.col("n")).alias("accepted"), F.when(u % 5 > 0, u % 5).alias("unmapped"))
    return V.public_summary(stories, evidence, reports, T.now())


@query("key_facts", f"""WITH {T.ORACLE_CANDIDATES}, s AS (SELECT ord % 300 AS story, ord, trim(regexp_replace(CASE WHEN ord % 7 = 3 THEN left(summary, 60) WHEN ord % 7 = 4 THEN '  ' ELSE summary END, '{T._WS}+', ' ', 'g')) AS fact FROM cand),
  n AS (SELECT *, {T.norm_sql('fact')} AS plain, CASE WHEN length(fact) > 180 THEN left(fact, 178) || '…' ELSE fact END AS shown FROM s WHERE fact <> ''), m AS (SELECT *, {T.norm_sql('shown')} AS kept FROM n),
  g AS (SELECT story, list({{'shown': shown, 'plain': plain, 'kept': kept}} ORDER BY ord) AS x FROM m GROUP BY 1),
  f AS (SELECT story, list_reduce(list_transform(x, lambda e: [e]), lambda acc, e: CASE WHEN len(acc) < 3 AND len(list_filter(acc, lambda k: starts_with(k.kept, e[1].plain) OR starts_with(e[1].plain, k.kept))) = 0 THEN list_concat(acc, e) ELSE acc END) AS kept FROM g)
SELECT story, md5(array_to_string(list_transform(kept, lambda k: k.shown), chr(10))) AS facts, len(kept)::INT AS n FROM f""")
def _(spark, sf):
    c = T.candidates(spark, sf)
    summary = F.when(F.col("ord") % 7 == 3, F.substring("summary", 1, 60)).when(F.col("ord") % 7 == 4, "  ").otherwise(F.col("summary"))
    # equal facts of a story meet before its list is made
    first = c.select((F.col("ord") % 300).alias("story"), "ord", summary.alias("fact")).groupBy("story", "fact").agg(F.min("ord").alias("ord"))
    grouped = first.groupBy("story").agg(F.array_sort(F.collect_list(F.struct("ord", "fact"))).alias("x"))
    facts = grouped.select("story", cards.key_facts(F.transform("x", lambda s: s["fact"])).alias("facts")).where(F.size("facts") > 0)
    return facts.select("story", F.md5(F.array_join("facts", "\n")).alias("facts"), F.size("facts").alias("n"))
