"""Registered queries of the store, audits, dates, markup readers and streams, each with its DuckDB SQL where it has one."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from pressloom import config as C
from pressloom.functions import dates as D
from pressloom.functions import html as H
from pressloom.functions import urls as U
from pressloom.operators import audit as A
from pressloom.operators import coverage as V
from pressloom.operators import operations as O
from pressloom.operators import probing as P
from pressloom.operators import store as S
from pressloom.operators.graph import shared_folder
from pressloom.plans.queries import query
from pressloom.sources import tables as T
from pressloom.sources.tables import ORACLE_CANDIDATES as CAND
from pressloom.sources.tables import ORACLE_RUNS as RUNS
from pressloom.streaming import state as ST

NOW = f"timestamp '{T.NOW}'"


# ---- store --------------------------------------------------------------------------------------
def _dated(spark, sf):
    c = T.candidates(spark, sf)
    day = lambda k: F.expr(f"timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, cast(ord * {k} % 9000 as int), 0)")
    return c.select("ord", "source_id", U.canonical_candidate_url(F.col("url")).alias("canonical_url"), "title", "summary", "published_at",
                    F.when(F.col("ord") % 5 == 0, day(11)).alias("updated_at"), day(7).alias("discovered_at"), F.when(F.col("ord") % 3 != 0, F.col("language")).alias("language"))


DATED = f"""{CAND}, dated AS (SELECT ord, ord % 2 AS side, source_id, {T.CANDIDATE_URL} AS canonical_url, title, summary, published_at,
  CASE WHEN ord % 5 = 0 THEN timestamp '2024-01-01' + to_minutes((ord * 11 % 9000)::INT) END AS updated_at, timestamp '2024-01-01' + to_minutes((ord * 7 % 9000)::INT) AS discovered_at,
  CASE WHEN ord % 3 <> 0 THEN language END AS language FROM cand)"""


@query("upsert_candidates", f"""WITH {DATED}, t AS (SELECT *, side * 1000000000 + ord AS turn FROM dated)
SELECT source_id, canonical_url, md5(arg_max(title, turn)) AS title, md5(arg_max(summary, turn)) AS summary, arg_max(published_at, turn) FILTER (published_at IS NOT NULL) AS published_at,
  arg_max(updated_at, turn) FILTER (updated_at IS NOT NULL) AS updated_at, min(discovered_at) AS discovered_at, arg_max(language, turn) FILTER (language IS NOT NULL) AS language, count(*) AS seen,
  md5(canonical_url || chr(10) || coalesce(arg_max(title, turn), '') || chr(10) || coalesce(arg_max(summary, turn), '')) AS content_fingerprint
FROM t GROUP BY 1, 2""")
def _(spark, sf):
    c = _dated(spark, sf)
    return S.upsert_candidates(c.where("ord % 2 = 0"), c.where("ord % 2 = 1")).withColumns({"title": F.md5("title"), "summary": F.md5("summary")})


@query("content_hash", """WITH d AS (SELECT sha256('{"doc_id":' || doc_id || ',"n_chars":' || n_chars || ',"source":"' || source || '"}') AS h FROM documents),
  l AS (SELECT i, sum(('0x' || substr(h, (15 * i + 1)::INT, 15))::BIGINT::HUGEINT) % 1152921504606846976 AS v FROM d, range(4) t(i) GROUP BY i)
SELECT (SELECT count(*) FROM d) AS n, sha256((SELECT count(*) FROM d) || '|' || string_agg(v::VARCHAR, '|' ORDER BY i)) AS content_hash FROM l""")
def _(spark, sf):
    return S.content_hash(T.table(spark, sf, "documents"), "source", "doc_id", "n_chars")


def _offers(spark, sf):
    e = T.table(spark, sf, "events")
    return e.groupBy(F.col("user_id").alias("stream"), F.date_trunc("day", "ts").alias("slot")).agg((F.count_if(F.col("event_type") == "purchase") % 2).alias("hash"))


OFFERS = "offers AS (SELECT user_id AS stream, date_trunc('day', ts)::TIMESTAMP AS slot, count(*) FILTER (event_type = 'purchase') % 2 AS hash FROM events GROUP BY 1, 2)"
SNAPS = f"""{OFFERS}, ch AS (SELECT *, lag(hash) OVER (PARTITION BY stream ORDER BY slot) AS latest FROM offers),
  snaps AS (SELECT stream, slot, hash, row_number() OVER w AS version, lag(slot) OVER w AS supersedes FROM ch WHERE latest IS NULL OR latest <> hash WINDOW w AS (PARTITION BY stream ORDER BY slot))"""


@query("publish_snapshots", f"WITH {SNAPS} SELECT * FROM snaps")
def _(spark, sf):
    return S.publish(_offers(spark, sf))


@query("rollback_pointer", f"""WITH {SNAPS}, last AS (SELECT stream, slot, supersedes FROM snaps QUALIFY row_number() OVER (PARTITION BY stream ORDER BY slot DESC) = 1)
SELECT stream, CASE WHEN stream % 4 <> 0 AND supersedes IS NOT NULL THEN supersedes ELSE slot END AS pointer, stream % 4 <> 0 AND supersedes IS NOT NULL AS moved FROM last""")
def _(spark, sf):
    snapshots = S.publish(_offers(spark, sf))
    leases = snapshots.select("stream", (F.col("stream") % 4 == 0).alias("active"))
    return S.rolled_back(snapshots, leases)


@query("runtime_latest", f"""WITH {SNAPS}, last AS (SELECT stream, max(slot) AS published_at, max(version) AS version FROM snaps WHERE hash = 1 GROUP BY 1)
SELECT DISTINCT user_id AS stream, published_at, coalesce(version, 0) AS version FROM events e LEFT JOIN last l ON l.stream = e.user_id""")
def _(spark, sf):
    latest = S.publish(_offers(spark, sf)).where("hash = 1").groupBy("stream").agg(F.max("slot").alias("published_at"), F.max("version").alias("version"))
    return T.table(spark, sf, "events").select(F.col("user_id").alias("stream")).distinct().join(latest, "stream", "left").fillna(0, ["version"])


@query("idempotency_keys", """SELECT user_id || '|' || floor(epoch(ts) / 7200)::BIGINT AS key, arg_min(event_id, (ts, event_id)) AS winner, count(*) - 1 AS duplicates FROM events GROUP BY 1""")
def _(spark, sf):
    log = T.table(spark, sf, "events").select("user_id", F.col("ts").alias("at"), "event_id")
    return S.first_of_key(log, F.concat_ws("|", "user_id", F.floor(F.unix_timestamp("at") / 7200).cast("string")))


@query("overwrite_union", """WITH u AS (SELECT user_id, event_type, value, event_id FROM events) SELECT user_id, event_type, arg_max(value, event_id) AS value FROM u GROUP BY 1, 2""")
def _(spark, sf):
    e = T.table(spark, sf, "events").select("user_id", "event_type", "value", "event_id")
    old, new = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    return old.unionByName(new).groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"))


@query("rolling_pool", f"""WITH {DATED} SELECT ord, row_number() OVER (PARTITION BY source_id ORDER BY coalesce(updated_at, published_at, discovered_at) DESC, canonical_url, ord) AS place
FROM dated WHERE coalesce(updated_at, published_at, discovered_at) BETWEEN {NOW} - interval 72 hours AND {NOW}""")
def _(spark, sf):
    at = F.coalesce("updated_at", "published_at", "discovered_at")
    pool = _dated(spark, sf).withColumn("at", at).where((F.col("at") <= T.now()) & (F.col("at") >= T.now() - F.expr("interval 72 hours")))
    return pool.select("ord", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("at"), "canonical_url", "ord")).alias("place"))


@query("pending_to_translated", """WITH a AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'pending' ELSE 'original' END AS was, CASE WHEN n_chars % 2 = 0 THEN 'translated' ELSE 'pending' END AS is_now FROM documents)
SELECT doc_id FROM a WHERE was = 'pending' AND is_now = 'translated'""")
def _(spark, sf):
    d = T.table(spark, sf, "documents")
    before = d.select("doc_id", F.when(F.col("doc_id") % 4 == 0, "pending").otherwise("original").alias("was")).where("was = 'pending'")
    after = d.select("doc_id", F.when(F.col("n_chars") % 2 == 0, "translated").otherwise("pending").alias("is_now")).where("is_now = 'translated'")
    return after.join(before, "doc_id", "left_semi").select("doc_id")


# ---- audits -------------------------------------------------------------------------------------
@query("audit_recall", f"""WITH {CAND}, a AS (SELECT published_at <= {NOW} AND published_at >= {NOW} - interval 24 hours AS active, ord % 3 <> 0 AS seen FROM cand),
  n AS (SELECT count(*) FILTER (active) AS eligible, count(*) FILTER (active AND seen) AS visible FROM a)
SELECT eligible, visible, eligible - visible AS missing, CASE WHEN eligible > 0 THEN visible / eligible ELSE 1.0 END AS recall FROM n""")
def _(spark, sf):
    at = F.col("published_at")
    return A.recall(T.candidates(spark, sf), (at <= T.now()) & (at >= T.now() - F.expr("interval 24 hours")), F.col("ord") % 3 != 0)


@query("duplicate_slots", "SELECT count(*) - count(DISTINCT floor(epoch(ts) / 300)) AS duplicate_slots, count(DISTINCT floor(epoch(ts) / 300)) AS slots FROM events")
def _(spark, sf):
    return A.duplicate_slots(T.table(spark, sf, "events").select(F.floor(F.unix_timestamp("ts") / 300).alias("slot")), "slot")


STATE = f"""st AS (SELECT user_id AS source_id, user_id % 11 <> 0 AS enabled, count(*) FILTER (event_type = 'error') % 4 AS consecutive_failures,
  CASE WHEN count(*) FILTER (event_type = 'error') % 4 = 3 THEN max(ts) + to_minutes((user_id % 3 * 600)::INT) END AS circuit_open_until, max(ts) + to_minutes((user_id % 5 * 400)::INT) AS next_due_at,
  CASE WHEN user_id % 13 > 0 THEN max(ts) END AS last_attempt_at, max(ts) FILTER (event_type = 'purchase') AS last_success_at FROM events GROUP BY user_id)"""


@query("source_partitions", f"""WITH {STATE}, t AS (SELECT *, coalesce(circuit_open_until > {NOW}, false) AS open, coalesce(last_attempt_at >= {NOW} - interval 1440 minutes, false) AS tried, coalesce(last_success_at >= {NOW} - interval 1440 minutes, false) AS won, next_due_at <= {NOW} AS due FROM st WHERE enabled)
SELECT count(*) AS enabled, count(*) FILTER (NOT open) AS healthy, count(*) FILTER (open) AS open_circuit, count(*) FILTER (circuit_open_until <= {NOW} AND due) AS half_open_due, count(*) FILTER (tried) AS rolling_attempted,
  count(*) FILTER (NOT open AND won) AS rolling_succeeded, count(*) FILTER (NOT tried) AS overdue, count(*) FILTER (NOT open AND due) AS backlog FROM t""")
def _(spark, sf):
    fails = F.count_if(F.col("event_type") == "error") % 4
    later = lambda k, m: F.expr(f"max(ts) + make_interval(0, 0, 0, 0, 0, cast(user_id % {k} * {m} as int), 0)")
    st = T.table(spark, sf, "events").groupBy("user_id").agg(
        F.when(F.col("user_id") % 13 > 0, F.max("ts")).alias("last_attempt_at"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("last_success_at"),
        F.when(fails == 3, later(3, 600)).alias("circuit_open_until"), later(5, 400).alias("next_due_at"))
    return A.partitions(st.withColumn("enabled", F.col("user_id") % 11 != 0), T.now(), 1440)


@query("audit_correlation", f"""WITH {RUNS}, r AS (SELECT event_id AS run_id, status, event_id % 3 = 0 AS published FROM runs), p AS (SELECT event_id AS run_id, attempted_at AS response_at FROM runs WHERE status <> 'failed'),
  s AS (SELECT event_id AS run_id, event_id * 10 AS snapshot_id FROM runs WHERE latency_ms % 2 = 0)
SELECT run_id, array_to_string(list_filter([CASE WHEN response_at IS NULL THEN 'missing_response' END, CASE WHEN published AND snapshot_id IS NULL THEN 'missing_snapshot' END, CASE WHEN NOT published AND snapshot_id IS NOT NULL THEN 'unexpected_snapshot' END], lambda x: x IS NOT NULL), ',') AS problems
FROM r LEFT JOIN p USING (run_id) LEFT JOIN s USING (run_id)""")
def _(spark, sf):
    r = T.runs(spark, sf).withColumnRenamed("event_id", "run_id")
    runs = r.select("run_id", (F.col("run_id") % 3 == 0).alias("published"))
    responses = r.where("status <> 'failed'").select("run_id", F.col("attempted_at").alias("response_at"))
    snapshots = r.where("latency_ms % 2 = 0").select("run_id", (F.col("run_id") * 10).alias("snapshot_id"))
    return A.correlate(runs, responses, snapshots).select("run_id", F.array_join("problems", ",").alias("problems"))


@query("plan_mismatch", """WITH e AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, user_id, event_type FROM events),
  g AS (SELECT day, coalesce(list(DISTINCT user_id) FILTER (event_type = 'view'), []) AS planned, coalesce(list(DISTINCT user_id) FILTER (event_type = 'click'), []) AS attempted, coalesce(list(DISTINCT user_id) FILTER (event_type = 'signup'), []) AS skipped FROM e GROUP BY day)
SELECT day, array_to_string(list_sort(list_filter(planned, lambda x: NOT list_contains(attempted, x) AND NOT list_contains(skipped, x))), ',') AS missing,
  array_to_string(list_sort(list_filter(list_distinct(list_concat(attempted, skipped)), lambda x: NOT list_contains(planned, x))), ',') AS unplanned,
  array_to_string(list_sort(list_filter(attempted, lambda x: list_contains(skipped, x))), ',') AS overlap FROM g""")
def _(spark, sf):
    of = lambda kind: F.collect_set(F.when(F.col("event_type") == kind, F.col("user_id"))).alias(kind)  # noqa: E731  (the sources of one run: a bounded registry)
    plans = T.table(spark, sf, "events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(of("view"), of("click"), of("signup"))
    out = A.set_mismatch(plans, "view", "click", "signup")
    return out.select("day", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("missing", "unplanned", "overlap")])


@query("batch_totals", f"WITH {RUNS} SELECT date_trunc('day', attempted_at)::TIMESTAMP AS day, count(DISTINCT source_id) AS updated, sum(k)::BIGINT AS discovered, coalesce(sum(k) FILTER (status = 'success'), 0)::BIGINT AS accepted FROM runs GROUP BY 1")
def _(spark, sf):
    r = T.runs(spark, sf)
    return r.groupBy(F.date_trunc("day", "attempted_at").alias("day")).agg(F.countDistinct("source_id").alias("updated"), F.sum("k").alias("discovered"), F.coalesce(F.sum(F.when(F.col("status") == "success", F.col("k"))), F.lit(0)).alias("accepted"))


@query("items_per_source", f"WITH {CAND} SELECT source_id, count(*) AS items, array_to_string(list_sort(list_distinct(list(primary_category))), ',') AS beats, max(published_at) AS reference_at, min(published_at) AS earliest_at FROM cand GROUP BY 1")
def _(spark, sf):
    c = T.candidates(spark, sf)
    return c.groupBy("source_id").agg(F.count("*").alias("items"), F.array_join(F.array_sort(F.coalesce(F.collect_set("primary_category"), F.array().cast("array<string>"))), ",").alias("beats"), F.max("published_at").alias("reference_at"), F.min("published_at").alias("earliest_at"))


# ---- dates, URLs, categories --------------------------------------------------------------------
@query("times_and_ages", f"""WITH {CAND} SELECT ord, CASE WHEN published_at + to_minutes((ord % 3000)::INT) <= {NOW} THEN published_at + to_minutes((ord % 3000)::INT) END AS at, floor((epoch_us({NOW}) - epoch_us(published_at)) / 60e6 * 1000 + 0.5) / 1000 AS age, strftime(published_at + interval 8 hours, '%Y-%m-%d') AS day FROM cand""")
def _(spark, sf):
    c = T.candidates(spark, sf)
    moved = F.expr("published_at + make_interval(0, 0, 0, 0, 0, cast(ord % 3000 as int), 0)")
    return c.select("ord", D.not_future(moved, T.now()).alias("at"), D.age_minutes(F.col("published_at"), T.now()).alias("age"), D.local_day(F.col("published_at")).alias("day"))


def _category(title, summary, url, primary, categories):
    text = F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", title, summary)), r"\s+", " "))
    scored = []
    for i, (c, (words, patterns)) in enumerate((c, C.CATEGORY_SIGNALS[c]) for c in C.SIGNAL_ORDER):
        hits = sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))
        paths = sum((F.lower(url).rlike(p).cast("int") for p in patterns), F.lit(0))
        scored.append(F.struct((F.when(primary == c, 4).otherwise(0) + F.when(F.array_contains(categories, c), 2).otherwise(0) + 3 * hits + 8 * paths).alias("p"), F.lit(-i).alias("o"), F.lit(c).alias("c")))
    return F.array_max(F.array(*scored))["c"]


_TXT = "trim(regexp_replace(lower(title || ' ' || summary), '\\s+', ' ', 'g'))"
_POINTS = ", ".join(
    "struct_pack(p := CASE WHEN primary_category = '{0}' THEN 4 ELSE 0 END + CASE WHEN list_contains(categories, '{0}') THEN 2 ELSE 0 END + 3 * ({1}) + 8 * ({2}), o := {3}, c := '{0}')".format(
        c, " + ".join(f"contains(txt, '{w}')::INT" for w in C.CATEGORY_SIGNALS[c][0]), " + ".join(f"regexp_matches(lower(url), '{p}')::INT" for p in C.CATEGORY_SIGNALS[c][1]), -i)
    for i, c in enumerate(C.SIGNAL_ORDER))


@query("category_infer", f"WITH {CAND}, t AS (SELECT *, {_TXT} AS txt FROM cand) SELECT ord, list_max([{_POINTS}]).c AS category FROM t")
def _(spark, sf):
    return T.candidates(spark, sf).select("ord", _category(F.col("title"), F.col("summary"), F.col("url"), F.col("primary_category"), F.col("categories")).alias("category"))


@query("even_sample", """WITH n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents),
  w AS (SELECT source, n, floor(k * (n - 1) / 9 + 0.5)::BIGINT AS i FROM (SELECT DISTINCT source, n FROM n) CROSS JOIN range(10) t(k) WHERE n > 10)
SELECT doc_id, source FROM n WHERE n <= 10 OR (source, i) IN (SELECT (source, i) FROM w)""")
def _(spark, sf):
    return P.even_sample(T.table(spark, sf, "documents").select("doc_id", "source"), "source", [F.col("doc_id")], 10)


@query("probe_selection", f"""WITH {CAND}, c AS (SELECT source_id AS section, row_number() OVER (PARTITION BY source_id ORDER BY date_trunc('day', published_at) DESC NULLS LAST, ord) AS ord, date_trunc('day', published_at) AS recency, right(source_id, 1) IN ('1', '3', '5', '7', '9') AS feed, published_at IS NOT NULL AND ord % 3 > 0 AS dated FROM cand),
  n AS (SELECT *, count(*) OVER s AS n, count(*) FILTER (dated) OVER s AS nd, count(*) FILTER (NOT dated) OVER s AS nu, row_number() OVER (PARTITION BY section, dated ORDER BY ord) - 1 AS rk, row_number() OVER (PARTITION BY section ORDER BY ord) - 1 AS pl, first_value(recency) OVER (PARTITION BY section ORDER BY ord) AS newest FROM c WINDOW s AS (PARTITION BY section)),
  m AS (SELECT *, count(*) FILTER (recency IS NOT DISTINCT FROM newest) OVER (PARTITION BY section) AS nb, least(8, nd) AS kd, CASE WHEN nu <= 20 - least(8, nd) THEN nu ELSE greatest(1, 20 - least(8, nd)) END AS ku FROM n),
  w AS (SELECT *, [floor(j * (nu - 1) / greatest(ku - 1, 1) + 0.5)::BIGINT FOR j IN range(ku)] AS us, [floor(j * (nb - 1) / 19 + 0.5)::BIGINT FOR j IN range(20)] AS bs FROM m)
SELECT section, ord, feed, dated FROM w WHERE CASE WHEN feed THEN CASE WHEN dated THEN rk < kd + greatest(0, 20 - kd - ku) ELSE nu <= ku OR list_contains(us, rk) END ELSE n <= 20 OR CASE WHEN nb >= 20 THEN list_contains(bs, pl) AND pl < nb ELSE pl < 20 END END""")
def _(spark, sf):
    c = T.candidates(spark, sf).select(F.col("source_id").alias("section"), F.date_trunc("day", "published_at").alias("recency"), F.col("ord").alias("i"), F.substring("source_id", -1, 1).isin("1", "3", "5", "7", "9").alias("feed"), (F.col("published_at").isNotNull() & (F.col("ord") % 3 > 0)).alias("dated"))
    placed = P.ranked(c, "section", [F.col("recency").desc_nulls_last(), F.col("i")], "place").withColumn("ord", F.col("place") + 1)
    return P.probes(placed.select("section", "ord", "recency", "feed", "dated"), 8, 20).select("section", "ord", "feed", "dated")


def registries(spark, sf):
    """Twelve registries of sources made from the run log, with real failures, accepted shares and due times."""
    runs = T.runs(spark, sf)
    s = O.source_states(runs).join(O.failure_streaks(runs), "source_id").join(O.accepted_rate(runs), "source_id", "left")
    i, pick = F.col("source_id"), lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    section = F.struct(pick(C.CATEGORIES, i).alias("primary"), F.array(pick(C.CATEGORIES, i * 3 + 1)).alias("further"))
    return s.select(
        (i % 12).alias("registry"), F.concat(F.lit("src"), i).alias("source_id"), pick(T.REGIONS, i).alias("region"), pick(T.MEDIA, i).alias("media_type"), (1 + i % 3 * 0.5).alias("weight"), V.beats_of(F.array(section)).alias("beats"),
        (i % 11 != 0).alias("approved"), F.date_trunc("day", "next_due_at").alias("due_at"), "accepted_rate", F.when(i % 4 > 0, F.lit(0)).otherwise(F.col("consecutive_failures")).alias("consecutive_failures"), F.when(i % 10 == 3, "timeout").alias("last_error"),
    )


@query("fair_schedule")
def _(spark, sf):
    return V.slot_budget(registries(spark, sf), T.now())


# ---- streams ------------------------------------------------------------------------------------
def _folder(spark: SparkSession) -> str:
    """A new folder under the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def seen_candidates(events):
    """Sightings of candidates made from events: the publication time of every fourth lies ahead of its own time, of every ninth it is unknown."""
    shift = F.make_interval(mins=((F.col("event_id") * 37) % 400 - 300).cast("int"))
    return events.select(F.col("user_id").alias("source_id"), F.col("event_type").alias("kind"), "event_id", "ts", F.when(F.col("event_id") % 9 != 0, F.col("ts") + shift).alias("published_at"), "value")


def attempts_of(events):
    """Attempts made from events, as in the run log, with the source's interval."""
    a = T.runs_of(events).where("status <> 'skipped'")
    found = F.col("k") % 10
    return a.select(
        "source_id", "event_id", F.col("attempted_at").alias("ts"), F.col("status").isin("success", "empty").alias("ok"), "latency_ms",
        found.alias("discovered"), F.least(found, F.col("k") % 7).alias("accepted"), ((F.col("source_id") % 4 + 1) * 30).alias("interval_minutes"),
    )


@query("stream_dedupe_72h", """WITH e AS (SELECT user_id AS source_id, event_type AS kind, event_id, ts, value, ts + to_minutes((event_id * 37 % 400 - 300)::INT) AS p FROM events),
  r AS (SELECT *, CASE WHEN event_id % 9 <> 0 AND p <= ts THEN p END AS published, {'t': ts, 'i': event_id} AS turn FROM e WHERE epoch_ms(ts) > (SELECT epoch_ms(max(ts)) FROM events) - 259200000)
SELECT source_id, kind, count(*) AS n, min(ts) AS discovered_at, max(ts) AS updated_at, arg_max(published, turn) FILTER (published IS NOT NULL) AS published_at, arg_max(value, turn) AS value FROM r GROUP BY 1, 2""")
def _(spark, sf):
    return ST.upserted(ST.retained(seen_candidates(ST.read_events(spark, sf))), _folder(spark), "source_id", "kind")


@query("stream_slot_counts", "SELECT time_bucket(interval 120 minutes, ts)::TIMESTAMP AS slot, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    return ST.drained(ST.slot_counts(ST.read_events(spark, sf)), _folder(spark), "complete").drop("batch")


@query("stream_source_state", f"""WITH {RUNS}, a AS (SELECT *, status IN ('success', 'empty') AS ok, k % 10 AS found, least(k % 10, k % 7) AS taken, (source_id % 4 + 1) * 30 AS minutes, {{'t': attempted_at, 'i': event_id}} AS turn FROM runs WHERE status <> 'skipped'),
  g AS (SELECT *, max(turn) FILTER (ok) OVER (PARTITION BY source_id) AS good FROM a),
  v AS (SELECT source_id, list(latency_ms ORDER BY attempted_at, event_id) AS v FROM a WHERE latency_ms > 0 GROUP BY 1),
  s AS (SELECT source_id, count(*) AS attempts, count(*) FILTER (good IS NULL OR turn > good) AS failures, max(attempted_at) AS last_at, max(attempted_at) FILTER (ok) AS ok_at, any_value(minutes) AS minutes, arg_max(taken / found, turn) FILTER (found > 0) AS rate FROM g GROUP BY 1)
SELECT source_id, failures AS consecutive_failures, attempts, last_at AS last_attempt_at, ok_at AS last_success_at, CASE WHEN failures >= 3 THEN last_at + to_minutes((2 * minutes)::INT) END AS circuit_open_until,
  list_reduce(v, lambda s, x: (8 * s + 2 * x + 5) // 10) AS latency_ms_p50, list_reduce(v, lambda s, x: greatest(x, (95 * s + 50) // 100)) AS latency_ms_p95, rate::DOUBLE AS accepted_rate, last_at + to_minutes(minutes::INT) AS next_due_at
FROM s LEFT JOIN v USING (source_id)""")
def _(spark, sf):
    return ST.upserted(ST.source_state(attempts_of(ST.read_events(spark, sf))), _folder(spark), "source_id")
