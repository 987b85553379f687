"""The engine's inputs bound to the provided tables, and the same bindings for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom import config as C
from pressloom.config import CATEGORIES

NOW = "2024-01-31 00:00:00"
MEDIA = ["wire", "official", "public", "business", "technology", "commercial", "social"]
REGIONS = ["china", "global", "us", "europe", "middle-east"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now() -> F.Column:
    return F.lit(NOW).cast("timestamp")


def _choose(values: list[str], i) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))


def sources(spark: SparkSession) -> DataFrame:
    """The source registry: 20 rows, the last one not approved."""
    i = F.col("id")
    return spark.range(20).select(
        F.concat(F.lit("src"), i).alias("source_id"), _choose(MEDIA, i).alias("media_type"), (50 + 2 * i).cast("int").alias("credibility"),
        _choose(REGIONS, i).alias("region"), (i != 19).alias("approved"), (i % 6 == 0).alias("paywall"), (1 + (i % 3) * 0.5).cast("double").alias("weight"),
        F.concat(F.lit("src"), i, F.lit(".example.com")).alias("allowed_host"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article candidates made from documents; ord is the input order."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    i, cut = F.col("doc_id"), F.instr("text", "\n")
    first = F.substring_index("text", "\n", 1)
    path = F.when(i % 23 == 0, "news").otherwise(F.concat_ws("/", "lang", F.substring(F.md5(first), 1, 8)))
    beat = _choose(CATEGORIES, i)
    return d.select(
        i.alias("ord"), i.cast("string").alias("id"), F.col("source").alias("source_id"), F.col("lang").alias("language"),
        F.when(i % 31 == 0, "").otherwise(F.concat(first, F.when(i % 37 == 0, " sponsored").otherwise(""))).alias("title"),
        F.when(cut > 0, F.expr("substring(text, instr(text, '\n') + 1)")).otherwise("").alias("summary"),
        F.concat(F.when(i % 29 == 0, "http://").otherwise("https://"), F.col("source"), F.lit(".example.com/"), path, F.lit("?id="), (i % 3).cast("string"), F.lit("&utm_source=x"), i.cast("string")).alias("url"),
        F.when(i % 17 != 0, F.expr(f"timestamp '{NOW}' - make_interval(0, 0, 0, 0, 0, cast(doc_id * 37 % 5760 as int), 0)")).alias("published_at"),
        beat.alias("primary_category"), F.array_distinct(F.array(beat, _choose(CATEGORIES, i * 7 + 3))).alias("categories"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source run log made from events."""
    return runs_of(table(spark, sf_dir, "events"))


def runs_of(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "success").when(kind == "view", "empty").when(kind == "signup", "partial").when(kind == "click", "skipped").otherwise("failed")
    return events.select(
        "event_id", F.col("user_id").alias("source_id"), F.col("ts").alias("attempted_at"), status.alias("status"),
        F.floor(F.col("value") * 100 + 0.5).cast("long").alias("latency_ms"), F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


_LIST = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"

#: The same bindings in DuckDB, to stand before an oracle's own SELECT.
ORACLE_SOURCES = f"""src AS (
  SELECT 'src' || i AS source_id, {_LIST(MEDIA)}[i % 7 + 1] AS media_type, (50 + 2 * i)::INT AS credibility,
    {_LIST(REGIONS)}[i % 5 + 1] AS region, i <> 19 AS approved, i % 6 = 0 AS paywall, 1 + (i % 3) * 0.5::DOUBLE AS weight,
    'src' || i || '.example.com' AS allowed_host FROM range(20) t(i))"""
ORACLE_CANDIDATES = f"""cand AS (
  SELECT doc_id AS ord, doc_id::VARCHAR AS id, source AS source_id, lang AS language,
    CASE WHEN doc_id % 31 = 0 THEN '' ELSE split_part(text, chr(10), 1) || CASE WHEN doc_id % 37 = 0 THEN ' sponsored' ELSE '' END END AS title,
    CASE WHEN position(chr(10) IN text) > 0 THEN substr(text, position(chr(10) IN text) + 1) ELSE '' END AS summary,
    CASE WHEN doc_id % 29 = 0 THEN 'http://' ELSE 'https://' END || source || '.example.com/' ||
      CASE WHEN doc_id % 23 = 0 THEN 'news' ELSE lang || '/' || substr(md5(split_part(text, chr(10), 1)), 1, 8) END ||
      '?id=' || (doc_id % 3) || '&utm_source=x' || doc_id AS url,
    CASE WHEN doc_id % 17 <> 0 THEN timestamp '{NOW}' - to_minutes((doc_id * 37 % 5760)::INT) END AS published_at,
    {_LIST(CATEGORIES)}[(doc_id % 10 + 1)::INT] AS primary_category,
    CASE WHEN doc_id % 10 = (doc_id * 7 + 3) % 10 THEN [{_LIST(CATEGORIES)}[(doc_id % 10 + 1)::INT]]
      ELSE [{_LIST(CATEGORIES)}[(doc_id % 10 + 1)::INT], {_LIST(CATEGORIES)}[((doc_id * 7 + 3) % 10 + 1)::INT]] END AS categories
  FROM documents)"""
ORACLE_RUNS = """runs AS (
  SELECT event_id, user_id AS source_id, ts AS attempted_at,
    CASE event_type WHEN 'purchase' THEN 'success' WHEN 'view' THEN 'empty' WHEN 'signup' THEN 'partial' WHEN 'click' THEN 'skipped' ELSE 'failed' END AS status,
    floor(value * 100 + 0.5)::BIGINT AS latency_ms, json_extract_string(props, '$.k')::BIGINT AS k FROM events)"""


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), 'https?://\\S+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


SHAPE_SQL = "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?(?:#(.*))?$"


def part_sql(x: str, i: int) -> str:
    return f"regexp_extract({x}, '{SHAPE_SQL}', {i})"


def canonical_sql(x: str, drop: str, event: bool) -> str:
    kept = f"list_filter(string_split({part_sql(x, 4)}, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{drop}'))"
    q = f"array_to_string({f'list_sort({kept})' if event else kept}, '&')"
    out = f"lower({part_sql(x, 1)}) || '://' || lower({part_sql(x, 2)}) || CASE WHEN {part_sql(x, 3)} = '' THEN '/' ELSE {part_sql(x, 3)} END || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END"
    return f"CASE WHEN {part_sql(x, 2)} <> '' THEN {f'''regexp_replace({out}, '/$', '')''' if event else out} ELSE {x} END"


EVENT_URL = canonical_sql("url", "^(utm_[^=]*|fbclid|gclid)(=|$)", True)
CANDIDATE_URL = canonical_sql("url", "^(utm_[^=]*|spm|from|source|ref)(=|$)", False)


_WS = "[\\s\\x0B\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"


def decode_sql(x: str) -> str:
    for name, char in C.NAMED_REFERENCES:
        x = f"replace({x}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return x


def clean_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace({decode_sql(x)}, '<!\\[CDATA\\[|\\]\\]>', '', 'g'), '<[^>]+>', ' ', 'g'), '{_WS}+', ' ', 'g'))"
