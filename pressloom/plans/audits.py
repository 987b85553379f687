"""Registered queries of the acceptance monitor and the slot audit, each with its DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from pressloom.operators import monitor as M
from pressloom.operators import slots as S
from pressloom.plans.queries import query
from pressloom.sources import tables as T

#: 2024-01-27, seconds since 1970.
DEADLINE = 1_706_313_600
MONITOR = M.Plan(day=12, burn_in=6, soak=20)


@query("monitor_states", """WITH RECURSIVE e AS (SELECT *, unnest(['all', 'm' || (user_id % 3)]) AS log FROM events),
  v AS (SELECT log, epoch(ts)::BIGINT // 7200 AS slot, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad FROM (SELECT * REPLACE (date_trunc('second', ts) AS ts) FROM e) GROUP BY 1, 2),
  b AS (SELECT log, min(slot) AS low, max(slot) AS high FROM v GROUP BY 1),
  g AS (SELECT b.log, s.slot, coalesce(2 * v.bad <= v.n, false) AS ok, s.slot >= epoch(timestamp '2024-01-27')::BIGINT // 7200 OR coalesce(v.n >= 3 AND v.bad = v.n, false) AS stop
        FROM b, LATERAL (SELECT unnest(range(b.low, b.high + 1)) AS slot) s LEFT JOIN v ON v.log = b.log AND v.slot = s.slot),
  r AS (
    SELECT log, low - 1 AS slot, false AS audited, 'seeking_baseline' AS phase, 0 AS wait, 1 AS attempt, NULL::BIGINT AS baseline, 0 AS burn, 0 AS soak, 0 AS ta, 0 AS tp FROM b
    UNION ALL
    SELECT g.log, g.slot, due,
      CASE WHEN NOT due THEN phase WHEN stop THEN 'needs_review' WHEN ok THEN CASE phase WHEN 'seeking_baseline' THEN 'burn_in' WHEN 'burn_in' THEN CASE WHEN burn + 1 >= 6 THEN 'soak' ELSE 'burn_in' END ELSE CASE WHEN soak + 1 >= 20 THEN 'passed' ELSE 'soak' END END
        ELSE CASE WHEN phase = 'soak' THEN 'soak' ELSE 'seeking_baseline' END END,
      CASE WHEN NOT due THEN greatest(wait - 1, 0) WHEN stop THEN 0 WHEN phase = 'soak' OR (ok AND phase = 'burn_in' AND burn + 1 >= 6) THEN 11 ELSE 0 END,
      CASE WHEN due AND NOT stop AND NOT ok THEN attempt + 1 ELSE attempt END,
      CASE WHEN NOT due OR stop THEN baseline WHEN ok AND phase = 'seeking_baseline' THEN g.slot WHEN NOT ok AND phase <> 'soak' THEN NULL ELSE baseline END,
      CASE WHEN NOT due OR stop THEN burn WHEN ok THEN CASE phase WHEN 'burn_in' THEN burn + 1 WHEN 'seeking_baseline' THEN 0 ELSE burn END WHEN phase = 'soak' THEN burn ELSE 0 END,
      CASE WHEN NOT due OR stop THEN soak WHEN ok AND phase = 'soak' THEN soak + 1 ELSE 0 END,
      ta + due::INT, tp + (due AND ok)::INT
    FROM (SELECT *, phase NOT IN ('passed', 'needs_review') AND wait = 0 AS due FROM r) r JOIN g ON g.log = r.log AND g.slot = r.slot + 1)
SELECT r.log, r.slot, audited, phase, attempt::BIGINT AS attempt, baseline AS baseline_slot, CASE WHEN phase <> 'needs_review' THEN burn::BIGINT END AS burn_in_passed, CASE WHEN phase <> 'needs_review' THEN soak::BIGINT END AS soak_days_passed, ta::BIGINT AS total_audited, tp::BIGINT AS total_passed
FROM r JOIN b ON b.log = r.log WHERE r.slot >= b.low""")
def _(spark, sf):
    e = T.table(spark, sf, "events").withColumn("log", F.explode(F.array(F.lit("all"), F.concat(F.lit("m"), F.col("user_id") % 3))))
    v = e.groupBy("log", F.floor(F.unix_timestamp("ts") / 7200).alias("slot")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"))
    stop = (F.col("slot") >= DEADLINE // 7200) | ((F.col("n") >= 3) & (F.col("bad") == F.col("n")))
    symbol = F.when(2 * F.col("bad") <= F.col("n"), F.when(stop, M.STOP_PASS).otherwise(M.PASS)).otherwise(F.when(stop, M.STOP_FAIL).otherwise(M.FAIL))
    return M.monitored(v.select("log", "slot", symbol.alias("symbol")), MONITOR, deadline=DEADLINE // 7200, range_slots=50, fan=3)


# ---- slot verdicts ------------------------------------------------------------------------------
GRID = S.Grid(width=7200, early=600, late=6000)
#: The four logs and the answers, derived by SQL text that both engines share; {seq} makes the list 0..n-1.
LOGS = {
    "e": "SELECT event_id AS i, ts, event_type, user_id % 3 AS log FROM {events}",
    "cron": "SELECT log, i AS cron_id, ts AS at, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status FROM e WHERE i % 5 = 0",
    "runs": "SELECT log, i AS run_id, ts AS at, CASE event_type WHEN 'purchase' THEN 'published' WHEN 'click' THEN 'running' WHEN 'signup' THEN 'failed' ELSE 'completed' END AS status, ts AS started_at, CASE WHEN event_type <> 'click' THEN ts + INTERVAL 1 SECONDS * (i % 70) END AS finished_at, {planned} AS planned, {attempted} AS attempted, {skipped} AS skipped, {missing} AS missing, i % 9 AS discovered, i % 4 AS accepted, CASE WHEN i % 31 > 0 THEN 'r' || (i % 50) END AS report_id, CASE WHEN i % 17 = 0 THEN 'partial' END AS outcome FROM e WHERE i % 6 = 1",
    "responses": "SELECT i AS run_id, CASE WHEN i % 37 = 0 THEN 500 ELSE 200 END AS status_code, CASE WHEN i % 41 = 0 THEN 8 ELSE 9 END AS keys, i % 43 = 0 AS failed, CASE WHEN i % 31 > 0 THEN 'r' || (i % 50) END AS report_id, CASE WHEN i % 34 = 0 THEN 'partial' ELSE 'published' END AS body_status, 1 + i % 3 AS selected, i % 9 AS discovered, CASE WHEN i % 23 = 0 THEN 7 ELSE i % 4 END AS accepted FROM e WHERE i % 6 = 1 AND i % 13 > 0",
    "snapshots": "SELECT i AS run_id, 'r' || (i % 50) AS report_id FROM e WHERE i % 6 = 1 AND event_type = 'purchase' AND i % 19 > 0",
    "spans": "SELECT log, min(ts) AS low, max(ts) AS high FROM e GROUP BY log",
}
#: Lists of 1 to 3 ids; some are attempted and skipped at once, or planned and neither.
LISTS = {"planned": "{seq}(0, 2 + i % 3)", "attempted": "{seq}(0, 1 + i % 3)", "skipped": "CASE WHEN i % 29 = 0 THEN {seq}(0, 1) ELSE {seq}(1 + i % 3, 2 + i % 3) END", "missing": "CASE WHEN i % 47 = 0 THEN {seq}(0, 1) ELSE {seq}(0, 0) END"}


def _chain(seq: str) -> str:
    out = []
    for name, text in LOGS.items():
        for k, v in LISTS.items():
            text = text.replace("{" + k + "}", v.replace("{seq}", seq))
        out.append(f"{name} AS ({text})")
    return ", ".join(out)


_FIRST = "floor((epoch_us({0}) / 1000000.0::DOUBLE + 600) / 7200)::BIGINT * 7200"
_RULES = [
    ("schedule_cron_count", "n_cron = 1"), ("schedule_durable_count", "n_run = 1"), ("schedule_missing_cron", "n_cron > 0"), ("schedule_missing_durable", "n_run > 0"), ("schedule_duplicate_cron", "n_cron <= 1"), ("schedule_duplicate_durable", "n_run <= 1"),
    ("schedule_late_cron", "NOT coalesce(epoch_us(c.at) / 1000000.0::DOUBLE - s.slot > 6000, false)"), ("schedule_late_durable", "NOT coalesce(epoch_us(r.at) / 1000000.0::DOUBLE - s.slot > 6000, false)"), ("cron_not_succeeded", "c.status = 'succeeded'"),
    ("pgnet_response_count", "a.run_id IS NOT NULL"), ("pgnet_not_http_200", "status_code = 200"), ("pgnet_body_not_exact_9", "keys = 9"), ("pgnet_network_error", "NOT failed"), ("durable_terminal_status", "r.status IN ('published', 'completed')"),
    ("durable_over_60_seconds", "epoch(finished_at - started_at) <= 60"), ("durable_missing", "len(missing) = 0"), ("durable_set_mismatch", "len(list_filter(list_distinct(list_concat(attempted, skipped)), lambda x: NOT list_contains(planned, x))) + len(list_filter(planned, lambda x: NOT list_contains(attempted, x) AND NOT list_contains(skipped, x))) = 0"),
    ("durable_attempt_skip_overlap", "len(list_intersect(attempted, skipped)) = 0"), ("durable_response_mismatch", "status_code = 200 AND keys = 9 AND NOT failed"), ("durable_body_counts_mismatch", "selected = len(attempted) AND a.discovered = r.discovered AND a.accepted = r.accepted"),
    ("published_report_missing", "coalesce(r.status <> 'published', true) OR r.report_id IS NOT NULL"), ("published_snapshot_not_linked", "coalesce(r.status <> 'published', true) OR n.report_id = r.report_id"),
    ("completed_response_report_mismatch", "coalesce(r.status <> 'completed', true) OR a.report_id = r.report_id"), ("partial_outcome_metadata_mismatch", "coalesce(coalesce(outcome, body_status) <> 'partial', true) OR body_status = 'partial'"),
]


@query("slot_verdicts", f"""WITH {_chain('range').replace('{events}', 'events')},
  s AS (SELECT log, unnest(range({_FIRST.format('low')}, {_FIRST.format('high')} + 1, 7200)) AS slot FROM spans),
  c AS (SELECT *, {_FIRST.format('"at"')} AS slot, count(*) OVER (PARTITION BY log, {_FIRST.format('"at"')}) AS n_cron FROM cron QUALIFY row_number() OVER (PARTITION BY log, {_FIRST.format('"at"')} ORDER BY "at", cron_id) = 1),
  r AS (SELECT *, {_FIRST.format('"at"')} AS slot, count(*) OVER (PARTITION BY log, {_FIRST.format('"at"')}) AS n_run FROM runs QUALIFY row_number() OVER (PARTITION BY log, {_FIRST.format('"at"')} ORDER BY "at", run_id) = 1),
  j AS (SELECT s.log, s.slot, r.run_id, r.report_id, epoch(finished_at - started_at)::DOUBLE AS duration, list_filter([{', '.join(f"CASE WHEN NOT coalesce({rule.replace('n_cron', 'coalesce(n_cron, 0)').replace('n_run ', 'coalesce(n_run, 0) ')}, false) THEN '{code}' END" for code, rule in _RULES)}], lambda x: x IS NOT NULL) AS failures
        FROM s LEFT JOIN c ON c.log = s.log AND c.slot = s.slot LEFT JOIN r ON r.log = s.log AND r.slot = s.slot LEFT JOIN responses a ON a.run_id = r.run_id LEFT JOIN snapshots n ON n.run_id = r.run_id)
SELECT log, slot, array_to_string(failures, ',') AS failures, run_id, report_id, duration, len(failures) = 0 AS passed FROM j""")
def _(spark, sf):
    events, chain = T.table(spark, sf, "events"), _chain("seq_below")
    chain = re.sub(r"seq_below\(([^,]+), ([^)]+)\)", r"filter(sequence(\1, \2), x -> x < \2)", chain)
    read = lambda name: spark.sql(f"WITH {chain} SELECT * FROM {name}", events=events)
    spans = read("spans").select("log", S.slot_of(F.col("low"), GRID).alias("first"), S.slot_of(F.col("high"), GRID).alias("last"))
    audited = S.audits(S.expected_slots(spans, GRID), read("cron"), read("runs"), read("responses"), read("snapshots"), GRID)
    return S.verdicts(audited).withColumn("failures", F.array_join("failures", ","))
