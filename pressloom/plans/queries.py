"""Registered queries of the news engine, each with the DuckDB SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressloom import config as C
from pressloom.functions import html as H
from pressloom.functions import numbers as N
from pressloom.functions import scoring as S
from pressloom.functions import text as X
from pressloom.functions import urls as U
from pressloom.operators import events as E
from pressloom.operators import gate
from pressloom.operators import operations as O
from pressloom.operators.graph import overlap_pairs
from pressloom.plans import report as R
from pressloom.sources import tables as T
from pressloom.sources.tables import ORACLE_CANDIDATES as CAND
from pressloom.sources.tables import ORACLE_RUNS as RUNS
from pressloom.sources.tables import ORACLE_SOURCES as SRC
from pressloom.sources.tables import clean_sql, norm_sql, part_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def docs(spark, sf):
    return T.table(spark, sf, "documents")


TOKENS_SQL = "list_filter(string_split({}, ' '), lambda t: length(t) > 1 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in C.STOP_WORDS) + "], t))"
INFO_SQL = "length(regexp_replace({0}, '\\s', '', 'g')) + len(regexp_extract_all({0}, '\\p{{Han}}'))"
CLAMP = "least(100, greatest(0, floor({} + 0.5)))::INT"


# ---- text ---------------------------------------------------------------------------------------
@query("text_normalize", f"SELECT doc_id, md5({norm_sql('text')}) AS norm_md5 FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(X.normalize_text(F.col("text"))).alias("norm_md5"))


@query("token_counts", f"SELECT doc_id, len({TOKENS_SQL.format(norm_sql('text'))})::INT AS n_tokens FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", X.normalize_text(F.col("text")).alias("n")).select("doc_id", F.size(X.tokenize(F.col("n"))).alias("n_tokens"))


@query("info_length", f"SELECT doc_id, ({INFO_SQL.format('text')})::INT AS info_length, ({INFO_SQL.format('text')}) >= 60 AS informative FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", X.information_length(F.col("text")).alias("info_length"), X.is_informative(F.col("text")).alias("informative"))


_IGN = ", ".join(f"'{w}'" for w in C.ENTITY_IGNORED)


@query("title_entities", f"""WITH {CAND}, t AS (SELECT ord, {TOKENS_SQL.format(norm_sql('title'))} AS ts FROM cand),
 f AS (SELECT ord, list_filter(ts, lambda t: NOT list_contains([{_IGN}], t) AND NOT regexp_matches(t, '^\\d+$')) AS ts FROM t)
SELECT ord, array_to_string(list_transform(list_sort(list_transform(list_distinct(ts), lambda t: {{'p': list_position(ts, t), 't': t}}))[1:8], lambda x: x.t), ' ') AS entities FROM f""")
def _(spark, sf):
    t = T.candidates(spark, sf).select("ord", X.tokenize(X.normalize_text(F.col("title"))).alias("t"))
    return t.select("ord", F.array_join(X.entities(F.col("t")), " ").alias("entities"))


_HITS = " UNION ALL ".join(f"SELECT ord, '{c}' AS category, len(list_filter([{', '.join(repr(k) for k in ks)}], lambda k: contains(n, k)))::INT AS hits FROM n" for c, ks in C.CATEGORY_KEYWORDS.items())


@query("keyword_hits", f"WITH {CAND}, n AS (SELECT ord, {norm_sql('title')} AS n FROM cand) SELECT * FROM ({_HITS}) WHERE hits > 0")
def _(spark, sf):
    n = T.candidates(spark, sf).select("ord", X.normalize_text(F.col("title")).alias("n"))
    hits = F.array(*[F.struct(F.lit(c).alias("category"), X.keyword_hits(F.col("n"), ks).alias("hits")) for c, ks in C.CATEGORY_KEYWORDS.items()])
    return n.select("ord", F.inline(hits)).where("hits > 0")


@query("free_text_search", f"WITH {CAND} SELECT ord FROM cand WHERE contains({norm_sql("title || ' ' || summary || ' ' || source_id")}, 'ation')")
def _(spark, sf):
    return T.candidates(spark, sf).where(F.contains(X.normalize_text(F.concat_ws(" ", "title", "summary", "source_id")), F.lit("ation"))).select("ord")


@query("hash_ids", f"WITH {CAND} SELECT ord, substr(sha256(url), 1, 24) AS sha24, md5(url || chr(10) || title || chr(10) || summary) AS fingerprint, list_reduce(list_transform(string_split(url, ''), lambda c: ascii(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::BIGINT) AS fnv FROM cand")
def _(spark, sf):
    c = T.candidates(spark, sf)
    return c.select("ord", N.short_sha(F.col("url")).alias("sha24"), N.fingerprint(F.col("url"), F.col("title"), F.col("summary")).alias("fingerprint"), N.fnv1a(F.col("url")).alias("fnv"))


# ---- URLs and pages -----------------------------------------------------------------------------
@query("url_canonical_event", f"SELECT page_id, {T.EVENT_URL} AS canonical FROM pages")
def _(spark, sf):
    return T.table(spark, sf, "pages").select("page_id", U.canonical_event_url(F.col("url")).alias("canonical"))


@query("url_canonical_candidate", f"SELECT page_id, 'p' || chr(10) || ({T.CANDIDATE_URL}) AS key FROM pages")
def _(spark, sf):
    return T.table(spark, sf, "pages").select("page_id", U.candidate_key(F.lit("p"), F.col("url")).alias("key"))


_HOST = f"regexp_replace(regexp_replace(regexp_replace(lower({part_sql('url', 2)}), '^.*@', ''), ':\\d*$', ''), '^www\\.', '')"


@query("url_host", f"SELECT {_HOST} AS host, count(*) AS n FROM pages GROUP BY 1")
def _(spark, sf):
    return T.table(spark, sf, "pages").groupBy(U.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


_SEGS = f"list_filter(string_split({part_sql('url', 3)}, '/'), lambda s: s <> '')"


@query("navigation_pages", f"SELECT page_id, len({_SEGS}) = 0 OR (len({_SEGS}) = 1 AND regexp_matches(coalesce({_SEGS}[1], ''), '(?i){C.NAVIGATION}')) AS navigation FROM pages")
def _(spark, sf):
    return T.table(spark, sf, "pages").select("page_id", U.is_navigation(F.col("url")).alias("navigation"))


@query("html_paragraphs", "WITH p AS (SELECT page_id, regexp_extract_all(html, '(?is)<p\\b[^>]*>(.*?)</p>', 1) AS ps FROM pages), c AS (SELECT page_id, unnest(list_transform(ps, lambda x: " + clean_sql("x") + ")) AS t FROM p) SELECT page_id, md5(t) AS md5, length(t)::INT AS n_chars FROM c WHERE length(t) >= 40")
def _(spark, sf):
    p = T.table(spark, sf, "pages").select("page_id", F.explode(H.paragraphs(F.col("html"))).alias("t"))
    return p.select("page_id", F.md5("t").alias("md5"), F.length("t").alias("n_chars"))


@query("html_links", "WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*>.*?</a>')) AS a FROM pages) SELECT page_id, regexp_extract(a, '(?is)\\bhref=\"([^\"]*)\"', 1) AS href, count(*) AS n FROM a GROUP BY 1, 2")
def _(spark, sf):
    a = T.table(spark, sf, "pages").select("page_id", F.explode(H.anchors(F.col("html"))).alias("a"))
    return a.groupBy("page_id", H.attribute(F.col("a"), "href").alias("href")).agg(F.count("*").alias("n"))


@query("html_title_heading", f"SELECT page_id, md5({clean_sql("regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1)")}) AS title, md5({clean_sql("regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1)")}) AS heading FROM pages")
def _(spark, sf):
    p = T.table(spark, sf, "pages")
    return p.select("page_id", F.md5(H.clean(H.tag_text(F.col("html"), "title"))).alias("title"), F.md5(H.clean(H.tag_text(F.col("html"), "h1"))).alias("heading"))


@query("page_format", "SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<(item|entry)\\b') THEN 'feed' WHEN regexp_matches(html, '(?i)<urlset\\b') THEN 'sitemap' ELSE 'html' END AS format, octet_length(encode(html)) <= 2097152 AS within_limit FROM pages")
def _(spark, sf):
    return T.table(spark, sf, "pages").select("page_id", H.page_format(F.col("html")).alias("format"), (F.octet_length("html") <= 2097152).alias("within_limit"))


# ---- gate ---------------------------------------------------------------------------------------
def gated(spark, sf):
    return gate.with_reason(T.candidates(spark, sf), T.sources(spark))


_SCOPE = f"lower({part_sql('url', 1)}) = 'https' AND (lower({part_sql('url', 2)}) = allowed_host OR ends_with(lower({part_sql('url', 2)}), '.' || allowed_host))"
_PROMO = " OR ".join(f"regexp_matches(title || ' ' || summary, '{p}')" for p in C.PROMOTION)
GATED = f"""gated AS (SELECT c.*, s.* EXCLUDE (source_id),
  CASE WHEN trim(title) = '' OR trim(url) = '' THEN 'missing_identity' WHEN {part_sql('url', 2)} = '' THEN 'invalid_url'
    WHEN len({_SEGS}) = 0 OR (len({_SEGS}) = 1 AND regexp_matches(coalesce({_SEGS}[1], ''), '(?i){C.NAVIGATION}')) THEN 'navigation_page'
    WHEN NOT coalesce(approved, false) THEN 'unapproved_source' WHEN NOT ({_SCOPE}) THEN 'source_url_out_of_scope'
    WHEN {_PROMO} THEN 'promotional' END AS reject_reason FROM cand c LEFT JOIN src s ON s.source_id = c.source_id)"""
BASE = f"WITH {CAND}, {SRC}, {GATED}, acc AS (SELECT * FROM gated WHERE reject_reason IS NULL)"


@query("gate_histogram", f"{BASE} SELECT coalesce(reject_reason, 'accepted') AS reason, count(*) AS n FROM gated GROUP BY 1")
def _(spark, sf):
    return gated(spark, sf).groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query("gate_accepted", f"""{BASE} SELECT ord, CASE WHEN published_at IS NULL THEN 'unknown' ELSE 'published' END AS time_status,
  CASE WHEN trim(summary) = '' OR {norm_sql('summary')} = {norm_sql('title')} THEN 'pending' ELSE 'original' END AS summary_status FROM acc""")
def _(spark, sf):
    return gate.accepted(gated(spark, sf)).select("ord", "time_status", "summary_status")


@query("gate_vs_labels", f"{BASE} SELECT reject_reason IS NULL AS accepted, quality, count(*) AS n FROM gated JOIN labels ON doc_id = ord GROUP BY 1, 2")
def _(spark, sf):
    g = gated(spark, sf).join(T.table(spark, sf, "labels"), F.col("ord") == F.col("doc_id"))
    return g.groupBy(F.col("reject_reason").isNull().alias("accepted"), "quality").agg(F.count("*").alias("n"))


@query("recent_window", f"WITH {CAND} SELECT ord FROM cand WHERE published_at <= timestamp '{T.NOW}' AND published_at >= timestamp '{T.NOW}' - interval 72 hours")
def _(spark, sf):
    return gate.recent(T.candidates(spark, sf), T.now(), 72).select("ord")


@query("keep_first_url", f"WITH {CAND} SELECT url_key, min(ord) AS ord FROM (SELECT ord, {T.EVENT_URL} AS url_key FROM cand) GROUP BY 1")
def _(spark, sf):
    return gate.keep_first(T.candidates(spark, sf).withColumn("url_key", U.canonical_event_url(F.col("url"))), "url_key").select("url_key", "ord")


@query("per_source_topn", f"WITH {CAND} SELECT source_id, ord, rank FROM (SELECT source_id, ord, row_number() OVER (PARTITION BY source_id ORDER BY published_at DESC NULLS LAST, ord)::INT AS rank FROM cand) WHERE rank <= 5")
def _(spark, sf):
    w = Window.partitionBy("source_id").orderBy(F.col("published_at").desc_nulls_last(), "ord")
    return T.candidates(spark, sf).withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("source_id", "ord", "rank")


@query("newest_order", f"WITH {CAND} SELECT ord, published_at FROM cand ORDER BY published_at DESC NULLS LAST, ord LIMIT 100")
def _(spark, sf):
    return T.candidates(spark, sf).orderBy(F.col("published_at").desc_nulls_last(), "ord").limit(100).select("ord", "published_at")


@query("page_offset", f"WITH {CAND} SELECT ord FROM cand ORDER BY published_at DESC NULLS LAST, ord LIMIT 50 OFFSET 50")
def _(spark, sf):
    return T.candidates(spark, sf).orderBy(F.col("published_at").desc_nulls_last(), "ord").offset(50).limit(50).select("ord")


@query("duplicate_surplus", f"WITH {CAND}, n AS (SELECT {norm_sql('title')} AS t FROM cand) SELECT count(*) - count(DISTINCT t) AS surplus FROM n WHERE t <> ''")
def _(spark, sf):
    n = T.candidates(spark, sf).select(X.normalize_text(F.col("title")).alias("t")).where("t <> ''")
    return n.groupBy("t").agg(F.count("*").alias("c")).agg((F.sum("c") - F.count("*")).alias("surplus"))


@query("candidate_merge", f"""WITH {CAND}, a AS (SELECT source_id, {T.CANDIDATE_URL} AS key, title, summary, published_at, ord FROM cand),
  x AS (SELECT source_id, key, max(title) AS title, max(summary) AS summary, min(published_at) AS d, max(published_at) AS s FROM a WHERE ord % 2 = 0 GROUP BY 1, 2),
  y AS (SELECT source_id, key, max(title) AS title, max(summary) AS summary, min(published_at) AS d, max(published_at) AS s FROM a WHERE ord % 2 = 1 GROUP BY 1, 2)
SELECT coalesce(y.source_id, x.source_id) AS source_id, coalesce(y.key, x.key) AS key, md5(coalesce(y.title, x.title)) AS title, md5(coalesce(y.summary, x.summary)) AS summary, least(x.d, y.d) AS discovered_at, greatest(x.s, y.s) AS last_seen_at
FROM x FULL JOIN y ON x.source_id = y.source_id AND x.key = y.key""")
def _(spark, sf):
    c = T.candidates(spark, sf).withColumn("key", U.canonical_candidate_url(F.col("url")))
    half = lambda k: c.where(F.col("ord") % 2 == k).groupBy("source_id", "key").agg(F.max("title").alias("title"), F.max("summary").alias("summary"), F.min("published_at").alias("discovered_at"), F.max("published_at").alias("last_seen_at"))
    return O.upsert(half(0), half(1), ["source_id", "key"]).withColumns({"title": F.md5("title"), "summary": F.md5("summary")})


# ---- events -------------------------------------------------------------------------------------
_TS = f"list_sort(list_distinct({TOKENS_SQL.format(norm_sql('title'))}))"


@query("title_pairs", f"""{BASE}, t AS (SELECT ord, {_TS} AS t FROM acc), s AS (SELECT t, min(ord) AS s FROM t WHERE len(t) > 0 GROUP BY t)
SELECT a.s AS u, b.s AS v FROM s a JOIN s b ON a.s < b.s WHERE len(list_intersect(a.t, b.t)) * 100 >= least(len(a.t), len(b.t)) * 80""")
def _(spark, sf):
    rows = E.prepared(gate.accepted(gated(spark, sf)))
    return overlap_pairs(rows, "ord", "title_tokens")[0]


@query("event_clusters")
def _(spark, sf):
    return E.clusters(gate.accepted(gated(spark, sf))).groupBy("cluster").agg(F.count("*").alias("members"))


@query("url_clusters", f"""{BASE}, k AS (SELECT *, {T.EVENT_URL} AS key FROM acc) SELECT min(ord) AS cluster, count(*) AS members, count(DISTINCT source_id) AS n_sources, min(published_at) AS started_at, max(published_at) AS updated_at FROM k GROUP BY key""")
def _(spark, sf):
    a = gate.accepted(gated(spark, sf)).withColumn("key", U.canonical_event_url(F.col("url")))
    labels = a.select("ord", "key").join(a.groupBy("key").agg(F.min("ord").alias("cluster")), "key").select("ord", "cluster")
    return E.events_of(a, labels).select("cluster", "members", F.size("source_ids").cast("long").alias("n_sources"), F.col("published_at").alias("started_at"), "updated_at")


_POINTS = ", ".join(
    f"{{'p': CASE WHEN list_contains(categories, '{c}') OR primary_category = '{c}' THEN CASE WHEN list_contains(categories, '{c}') THEN 1 + 3 * len(list_filter([{', '.join(repr(k) for k in C.CATEGORY_KEYWORDS[c])}], lambda k: contains(n, k))) ELSE 0 END + CASE WHEN primary_category = '{c}' THEN 8 ELSE 0 END ELSE -1 END, 'o': {-i}, 'c': '{c}'}}"
    for i, c in enumerate(C.TIE_ORDER))


@query("category_vote", f"WITH {CAND}, n AS (SELECT *, {norm_sql("title || ' ' || summary")} AS n FROM cand) SELECT ord, list_sort([{_POINTS}])[10].c AS category FROM n")
def _(spark, sf):
    c = T.candidates(spark, sf).withColumn("n", X.normalize_text(F.concat_ws(" ", "title", "summary")))
    return c.select("ord", E.vote_category(F.col("categories"), F.array("primary_category"), F.col("n")).alias("category"))


# ---- scores -------------------------------------------------------------------------------------
def scored(spark, sf):
    p = C.Preferences()
    c = gate.accepted(gated(spark, sf)).withColumn("n", X.normalize_text(F.concat_ws(" ", "title", "summary")))
    one = F.lit(1)
    return c.withColumns({
        "importance": S.public_importance(F.col("categories"), F.col("n"), one), "preference": S.user_preference(F.col("categories"), F.col("n"), F.array("source_id"), p),
        "timeliness": S.timeliness(F.col("published_at"), T.now()), "confidence": S.source_confidence(one),
        "quality": S.content_quality(F.col("summary"), F.col("published_at"), F.col("url"), F.col("paywall")),
        "trust": S.trust_score(F.col("credibility").cast("double"), F.col("media_type") == "official", F.col("media_type") == "wire", F.col("media_type") == "social", one, F.col("published_at"), F.col("summary"), F.col("paywall"), F.lit(False)),
    }).withColumn("final", S.final_score(*[F.col(x) for x in ("importance", "preference", "timeliness", "confidence", "quality")]))


_P = C.Preferences()
_IMP = "CASE c " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.CATEGORY_IMPORTANCE.items()) + " END"
_HOURS = f"(epoch(timestamp '{T.NOW}') - epoch(published_at)) / 3600.0"
SCORED = f"""n AS (SELECT *, {norm_sql("title || ' ' || summary")} AS n FROM acc),
s1 AS (SELECT *,
  {CLAMP.format("greatest(50, list_max(list_transform(categories, lambda c: " + _IMP + "))) + CASE WHEN " + " OR ".join(f"contains(n, '{k}')" for k in C.HIGH_IMPACT) + " THEN 12 ELSE 0 END")} AS importance,
  CASE WHEN {" OR ".join(f"contains(n, '{k}')" for k in _P.blocked)} THEN 0 ELSE {CLAMP.format("45 + 30 * len(list_filter(categories, lambda c: c IN (" + ", ".join(f"'{c}'" for c in _P.categories) + "))) + " + " + ".join(f"10 * contains(n, '{k}')::INT" for k in _P.boosted) + " + CASE source_id WHEN 'src1' THEN 10 WHEN 'src2' THEN 5 ELSE 0 END")} END AS preference,
  CASE WHEN published_at IS NULL THEN 45 WHEN {_HOURS} <= 1 THEN 100 WHEN {_HOURS} <= 6 THEN 90 WHEN {_HOURS} <= 12 THEN 78 WHEN {_HOURS} <= 24 THEN 65 WHEN {_HOURS} <= 48 THEN 42 ELSE 20 END AS timeliness,
  60 AS confidence,
  {CLAMP.format("CASE WHEN trim(summary) <> '' THEN 50 ELSE 30 END + least(30, floor((" + INFO_SQL.format("summary") + ") / 12)) + CASE WHEN published_at IS NOT NULL THEN 10 ELSE 0 END + 10 - CASE WHEN paywall THEN 8 ELSE 0 END")} AS quality,
  {CLAMP.format("35.0::DOUBLE + (credibility - 50) * 0.55::DOUBLE + CASE media_type WHEN 'official' THEN 18 WHEN 'wire' THEN 16 WHEN 'social' THEN -16 ELSE 0 END + CASE WHEN published_at IS NOT NULL THEN 6 ELSE -8 END + CASE WHEN " + INFO_SQL.format("summary") + " >= 60 THEN 6 ELSE -8 END - CASE WHEN paywall THEN 4 ELSE 0 END")} AS trust
  FROM n),
scored AS (SELECT *, {CLAMP.format("importance * 0.5::DOUBLE + preference * 0.2::DOUBLE + timeliness * 0.15::DOUBLE + confidence * 0.1::DOUBLE + quality * 0.05::DOUBLE")} AS final FROM s1)"""


@query("score_breakdown", f"{BASE}, {SCORED} SELECT ord, importance, preference, timeliness, confidence, quality, final FROM scored")
def _(spark, sf):
    return scored(spark, sf).select("ord", "importance", "preference", "timeliness", "confidence", "quality", "final")


@query("trust_scores", f"{BASE}, {SCORED} SELECT ord, trust, CASE WHEN trust >= 75 THEN 'high' WHEN trust >= 50 THEN 'medium' ELSE 'low' END AS level FROM scored")
def _(spark, sf):
    return scored(spark, sf).select("ord", "trust", S.trust_level(F.col("trust")).alias("level"))


@query("rank_news", f"{BASE}, {SCORED} SELECT ord, final, row_number() OVER (ORDER BY final DESC, ord) AS rank FROM scored ORDER BY rank LIMIT 200")
def _(spark, sf):
    top = scored(spark, sf).select("ord", "final").orderBy(F.desc("final"), "ord").limit(200)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("final"), "ord")).cast("long"))


@query("hot_order", f"{BASE}, {SCORED} SELECT ord, hot FROM (SELECT ord, published_at, {CLAMP.format('importance * 0.5::DOUBLE + timeliness * 0.15::DOUBLE + confidence * 0.1::DOUBLE + quality * 0.05::DOUBLE')} AS hot FROM scored) ORDER BY hot DESC, published_at DESC NULLS LAST, ord LIMIT 100")
def _(spark, sf):
    s = scored(spark, sf).withColumn("hot", S.final_score(F.col("importance"), F.lit(0), F.col("timeliness"), F.col("confidence"), F.col("quality")))
    return s.orderBy(F.desc("hot"), F.col("published_at").desc_nulls_last(), "ord").limit(100).select("ord", "hot")


@query("preferred_order", f"{BASE}, {SCORED} SELECT ord, published_at FROM scored WHERE len(list_filter(categories, lambda c: c IN ({', '.join(repr(c) for c in _P.categories)}))) > 0 AND NOT ({' OR '.join(f"contains(n, '{k}')" for k in _P.blocked)}) ORDER BY published_at DESC NULLS LAST, ord LIMIT 100")
def _(spark, sf):
    s = scored(spark, sf).where(F.exists("categories", lambda c: c.isin(*_P.categories)) & ~S._any(F.col("n"), _P.blocked))
    return s.orderBy(F.col("published_at").desc_nulls_last(), "ord").limit(100).select("ord", "published_at")


_KIND = "CASE " + " ".join(f"WHEN regexp_matches(n, '{p}') THEN '{k}'" for k, p in C.EVENT_TYPES) + " WHEN primary_category = 'sports' THEN 'sports' WHEN primary_category = 'entertainment' THEN 'culture' WHEN primary_category = 'finance' THEN 'company' ELSE 'general' END"
_IMPACT = "CASE primary_category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.BEAT_IMPACT.items()) + " END" + "".join(f" + CASE WHEN regexp_matches(n, '{p}') THEN {b} ELSE 0 END" for b, p in C.IMPACT_BOOSTS) + " + CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.EVENT_BOOSTS.items()) + f" ELSE 0 END - CASE WHEN regexp_matches(n, '{C.OPINION}') THEN 15 ELSE 0 END - CASE WHEN regexp_matches(n, '{C.LOCAL}') AND kind <> 'disaster' THEN 8 ELSE 0 END - CASE WHEN primary_category = 'sports' AND NOT regexp_matches(n, '{C.SPORT_PEAK}') THEN 8 ELSE 0 END"
_TYPED = f"k AS (SELECT *, {_KIND} AS kind FROM scored), i AS (SELECT *, {CLAMP.format(_IMPACT)} AS impact FROM k), t AS (SELECT *, {CLAMP.format('impact * 0.8::DOUBLE + timeliness * 0.2::DOUBLE')} AS total FROM i), tiers AS (SELECT *, CASE WHEN impact >= 82 AND total >= 76 THEN 'must_know' WHEN impact >= 58 AND total >= 58 THEN 'important' WHEN (impact >= 36 AND total >= 40) OR (primary_category IN ('sports', 'entertainment') AND total >= 25) THEN 'special_interest' ELSE 'noise' END AS tier FROM t)"


def typed(spark, sf):
    s = scored(spark, sf).withColumn("kind", S.event_type(F.col("n"), F.col("primary_category")))
    s = s.withColumn("impact", S.public_impact(F.col("n"), F.col("primary_category"), F.col("kind")))
    s = s.withColumn("total", S.total_importance(F.col("impact"), F.col("timeliness")))
    return s.withColumn("tier", S.tier(F.col("impact"), F.col("total"), F.col("primary_category")))


@query("event_type_tier", f"{BASE}, {SCORED}, {_TYPED} SELECT ord, kind, impact, total, tier FROM tiers")
def _(spark, sf):
    return typed(spark, sf).select("ord", "kind", "impact", "total", "tier")


@query("tier_mix", f"{BASE}, {SCORED}, {_TYPED} SELECT primary_category, tier, count(*) AS n, max(total) AS best FROM tiers GROUP BY 1, 2")
def _(spark, sf):
    return typed(spark, sf).groupBy("primary_category", "tier").agg(F.count("*").alias("n"), F.max("total").alias("best"))


@query("evidence_roles", f"{BASE} SELECT ord, CASE media_type WHEN 'official' THEN 'original' WHEN 'wire' THEN 'confirmation' WHEN 'social' THEN 'lead' WHEN 'technology' THEN 'analysis' WHEN 'business' THEN 'analysis' ELSE 'context' END AS role, {_HOST} AS independence_group FROM acc")
def _(spark, sf):
    return gate.accepted(gated(spark, sf)).select("ord", S.evidence_role(F.col("media_type")).alias("role"), U.host(F.col("url")).alias("independence_group"))


@query("latest_stories", f"{BASE}, w AS (SELECT ord, published_at, published_at <= timestamp '{T.NOW}' AND published_at >= timestamp '{T.NOW}' - interval 24 hours AS day FROM acc WHERE published_at <= timestamp '{T.NOW}' AND published_at >= timestamp '{T.NOW}' - interval 72 hours) SELECT ord, published_at FROM w WHERE day OR NOT (SELECT bool_or(day) FROM w)")
def _(spark, sf):
    w = gate.recent(gate.accepted(gated(spark, sf)), T.now(), 72).withColumn("day", F.col("published_at") >= T.now() - F.expr("interval 24 hours"))
    any_day = w.agg(F.coalesce(F.max("day"), F.lit(False)).alias("any_day"))  # one row
    return w.join(F.broadcast(any_day)).where("day OR NOT any_day").select("ord", "published_at")


# ---- report -------------------------------------------------------------------------------------
def report(spark, sf):
    return R.build_report(T.candidates(spark, sf), T.sources(spark), T.now())


@query("report_stories")
def _(spark, sf):
    return report(spark, sf).stories.select("cluster", "story_id", "members", "primary_beat", "trust", "final_score", "event_type", "impact", "total", "tier", "status")


@query("report_curated")
def _(spark, sf):
    r = report(spark, sf)
    return r.selected.join(r.stories.select("cluster", "story_id", "total", "tier", "status"), "cluster").select("list", "position", "story_id", "cluster", "primary_beat", "publisher", "total", "tier", "status")


@query("report_coverage")
def _(spark, sf):
    r = report(spark, sf)
    return R.coverage(r.candidates, r.stories, r.selected)


@query("report_sections")
def _(spark, sf):
    return R.beat_sections(report(spark, sf).stories)


@query("report_quality")
def _(spark, sf):
    r = report(spark, sf)
    return R.quality_summary(r.gated, r.stories, r.selected, T.now())


@query("report_window", f"{BASE} SELECT min(published_at) AS window_from, max(published_at) AS window_to, count(DISTINCT source_id) AS n_sources FROM acc")
def _(spark, sf):
    return gate.accepted(gated(spark, sf)).agg(F.min("published_at").alias("window_from"), F.max("published_at").alias("window_to"), F.countDistinct("source_id").alias("n_sources"))


# ---- operations ---------------------------------------------------------------------------------
ATT = f"WITH {RUNS}, a AS (SELECT *, status IN ('success', 'empty') AS ok FROM runs WHERE status <> 'skipped')"
STATES = f"""{ATT}, st AS (SELECT source_id, max(attempted_at) AS last_attempt_at, max(attempted_at) FILTER (ok) AS last_success_at, ((source_id % 4 + 1) * 30)::INT AS interval_minutes, source_id % 11 <> 0 AS enabled FROM a GROUP BY source_id),
 states AS (SELECT *, last_attempt_at + to_minutes(2 * interval_minutes) AS next_due_at FROM st)"""
AS_OF = "2024-01-30 20:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


@query("failure_streaks", f"""{ATT}, l AS (SELECT source_id, max({{'t': attempted_at, 'e': event_id}}) AS l FROM a WHERE ok GROUP BY 1),
 f AS (SELECT a.source_id, count(*) AS n, max(attempted_at) AS t FROM a LEFT JOIN l USING (source_id) WHERE l.l IS NULL OR {{'t': attempted_at, 'e': event_id}} > l.l GROUP BY 1)
SELECT a.source_id, count(*) AS n_attempts, max(attempted_at) AS last_attempt_at, coalesce(any_value(f.n), 0) AS consecutive_failures, CASE WHEN coalesce(any_value(f.n), 0) >= 3 THEN any_value(f.t) + interval 180 minutes END AS circuit_open_until FROM a LEFT JOIN f USING (source_id) GROUP BY a.source_id""")
def _(spark, sf):
    return O.failure_streaks(T.runs(spark, sf))


@query("latency_trend", f"""{ATT}, v AS (SELECT source_id, list(latency_ms::DOUBLE ORDER BY attempted_at, event_id) AS v FROM a WHERE latency_ms > 0 GROUP BY 1)
SELECT source_id, list_reduce(v, lambda s, x: floor(s * 0.8::DOUBLE + x * 0.2::DOUBLE + 0.5))::BIGINT AS latency_ms_p50, list_reduce(v, lambda s, x: greatest(x, floor(s * 0.95::DOUBLE + 0.5)))::BIGINT AS latency_ms_p95 FROM v""")
def _(spark, sf):
    return O.latency_trend(T.runs(spark, sf))


@query("accepted_rate", f"""{ATT}, d AS (SELECT source_id, attempted_at, event_id, k % 10 AS discovered, least(k % 10, k % 7) AS accepted FROM a WHERE k % 10 > 0)
SELECT source_id, arg_max(accepted / discovered, {{'t': attempted_at, 'e': event_id}}) AS accepted_rate FROM d GROUP BY 1""")
def _(spark, sf):
    return O.accepted_rate(T.runs(spark, sf))


@query("slot_rollup", f"WITH {RUNS} SELECT time_bucket(interval 5 minutes, attempted_at) AS slot, count(*) AS runs, count(*) FILTER (status = 'success') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (latency_ms > 30000) AS over_30s, max(latency_ms) AS max_latency_ms FROM runs GROUP BY 1")
def _(spark, sf):
    return O.slot_rollup(T.runs(spark, sf))


@query("missing_slots", f"WITH {RUNS}, b AS (SELECT time_bucket(interval 2 hours, min(attempted_at)) AS a, time_bucket(interval 2 hours, max(attempted_at)) AS z FROM runs), e AS (SELECT unnest(generate_series(a, z, interval 2 hours)) AS slot FROM b) SELECT slot FROM e WHERE slot NOT IN (SELECT time_bucket(interval 2 hours, attempted_at) FROM runs WHERE status = 'success')")
def _(spark, sf):
    return O.missing_slots(T.runs(spark, sf))


@query("success_gaps", f"WITH {RUNS}, g AS (SELECT source_id, (epoch_us(attempted_at) - epoch_us(lag(attempted_at) OVER (PARTITION BY source_id ORDER BY attempted_at, event_id))) / 60000000.0::DOUBLE AS gap FROM runs WHERE status = 'success') SELECT source_id, floor(max(gap) * 1000 + 0.5) / 1000 AS max_gap_minutes, count(*) AS successes FROM g GROUP BY 1")
def _(spark, sf):
    return O.success_gaps(T.runs(spark, sf))


@query("latency_p95", f"WITH {RUNS} SELECT status, quantile_disc(latency_ms, 0.95) AS p95, max(latency_ms) AS worst FROM runs GROUP BY 1")
def _(spark, sf):
    return T.runs(spark, sf).groupBy("status").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)").cast("long").alias("p95"), F.max("latency_ms").alias("worst"))


@query("source_health", f"{STATES} SELECT count(*) AS enabled_count, count(*) FILTER (last_attempt_at >= timestamp '{AS_OF}' - interval 12 hours) AS recent_count, count(*) FILTER (next_due_at < timestamp '{AS_OF}') AS overdue_count, CASE WHEN count(*) FILTER (last_attempt_at IS NULL) = 0 THEN min(last_attempt_at) END AS full_sweep_at FROM states WHERE enabled")
def _(spark, sf):
    return O.health(O.source_states(T.runs(spark, sf)), as_of())


@query("due_sources", f"{STATES} SELECT source_id, least(next_due_at, last_attempt_at + to_minutes(interval_minutes)) AS due_at, last_attempt_at FROM states WHERE enabled AND least(next_due_at, last_attempt_at + to_minutes(interval_minutes)) <= timestamp '{AS_OF}' ORDER BY due_at, last_attempt_at NULLS FIRST, source_id LIMIT 100")
def _(spark, sf):
    return O.due_list(O.source_states(T.runs(spark, sf)), as_of())


@query("freshness_axes", f"""{STATES}, g AS (SELECT *, greatest(0, (epoch_us(timestamp '{AS_OF}') - epoch_us(last_success_at)) / 60000000.0::DOUBLE) AS s_age, greatest(0, (epoch_us(timestamp '{AS_OF}') - epoch_us(last_attempt_at)) / 60000000.0::DOUBLE) AS a_age, coalesce(last_attempt_at > last_success_at, false) AS bad FROM states)
SELECT source_id, CASE WHEN last_success_at IS NULL THEN 'unavailable' WHEN s_age > 720 THEN 'stale' WHEN bad THEN 'degraded' ELSE 'fresh' END AS status, CASE WHEN last_success_at IS NULL THEN 'failed' WHEN bad THEN 'degraded' ELSE 'healthy' END AS pipeline_status,
 CASE WHEN last_success_at IS NULL THEN 'unknown' WHEN s_age <= 720 THEN 'current' WHEN a_age <= 720 THEN 'quiet' ELSE 'stale' END AS content_status, floor(s_age * 1000 + 0.5) / 1000 AS age_minutes FROM g""")
def _(spark, sf):
    return O.freshness(O.source_states(T.runs(spark, sf)), as_of(), 720)


@query("rate_limit", "SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) <= 6 AS allowed FROM events")
def _(spark, sf):
    return O.rate_limited(T.table(spark, sf, "events"))


@query("snapshot_chain", "WITH RECURSIVE chain(id, previous, depth) AS (SELECT o_orderkey, o_orderkey - 1, 1 FROM orders WHERE o_orderkey = 200 UNION ALL SELECT o.o_orderkey, o.o_orderkey - 1, c.depth + 1 FROM chain c JOIN orders o ON o.o_orderkey = c.previous WHERE c.depth < 20) SELECT id, depth FROM chain")
def _(spark, sf):
    return O.snapshot_chain(T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") - 1).alias("previous")), 200, 20)


@query("registry_sync", f"""{STATES}, r AS (SELECT i::BIGINT AS source_id, 60 AS new_interval FROM range(5, 200, 3) t(i)), j AS (SELECT coalesce(s.source_id, r.source_id) AS source_id, s.interval_minutes, r.new_interval, s.next_due_at, s.last_attempt_at FROM states s FULL JOIN r ON r.source_id = s.source_id)
SELECT source_id, coalesce(new_interval, interval_minutes) AS interval_minutes, new_interval IS NOT NULL AS enabled, CASE WHEN new_interval IS NULL THEN next_due_at WHEN next_due_at IS NULL THEN timestamp '{AS_OF}' ELSE least(next_due_at, coalesce(last_attempt_at + to_minutes(coalesce(new_interval, interval_minutes)), timestamp '{AS_OF}')) END AS next_due_at FROM j""")
def _(spark, sf):
    registry = spark.range(5, 200, 3).select(F.col("id").alias("source_id"), F.lit(60).alias("interval_minutes"))
    return O.sync_registry(O.source_states(T.runs(spark, sf)), registry, as_of())


_RANK = "coalesce(list_position(['success', 'partial', 'empty', 'failed', 'skipped'], {}), 99)"


@query("outcome_combine", f"""WITH {RUNS}, x AS (SELECT source_id, min({_RANK.format('status')}) AS r, count(*) AS n FROM runs WHERE event_id % 2 = 0 GROUP BY 1), y AS (SELECT source_id, min({_RANK.format('status')}) AS r, count(*) AS n FROM runs WHERE event_id % 2 = 1 GROUP BY 1)
SELECT coalesce(x.source_id, y.source_id) AS source_id, ['success', 'partial', 'empty', 'failed', 'skipped'][least(coalesce(x.r, 99), coalesce(y.r, 99))::INT] AS status, coalesce(x.n, 0) + coalesce(y.n, 0) AS attempts FROM x FULL JOIN y ON x.source_id = y.source_id""")
def _(spark, sf):
    r = T.runs(spark, sf)
    return O.combine_outcomes(r.where("event_id % 2 = 0"), r.where("event_id % 2 = 1"))


