"""Queries over events: dashboards, rollups, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.operators import insights
from larkspur.plans.registry import query
from larkspur.streaming import rollup

_DAY = "2024-01-10"
_OURS = "actor_role = 'CANDIDATE'"


def _first():
    return F.lit(_DAY).cast("date")


def _n(kind: str, name: str) -> str:
    return f"count(*) FILTER (kind = '{kind}') AS {name}"


_ENGAGED = ", ".join([_n("JOB_VIEW", "views"), _n("JOB_SAVE", "saves"), _n("APPLY", "applications")])
_RATE = "CASE WHEN {1} > 0 THEN round(CAST({0} AS DOUBLE) / {1}, 3) ELSE 0.0 END"

query("agg_03_events_by_kind", "event", "SELECT kind, count(*) AS n FROM event GROUP BY kind", insights.by_kind)
query("agg_04_overview", "event", f"""SELECT *, {_RATE.format('searches_with_no_results', 'searches')} AS empty_search_rate, {_RATE.format('saves', 'job_views')} AS view_to_save_rate, {_RATE.format('applications', 'saves')} AS save_to_apply_rate
 FROM (SELECT count(DISTINCT actor) AS active_candidates, {_n('SEARCH', 'searches')}, count(*) FILTER (kind = 'SEARCH' AND result_count = 0) AS searches_with_no_results, {_n('JOB_VIEW', 'job_views')}, {_n('JOB_SAVE', 'saves')},
 {_n('APPLY', 'applications')}, {_n('CV_UPLOAD', 'cv_uploads')} FROM event WHERE {_OURS} AND day >= DATE '{_DAY}')""", lambda e: insights.overview(e, _first()))
query("agg_05_rates_of_an_empty_window", "event", """SELECT CAST(0 AS BIGINT) AS active_candidates, CAST(0 AS BIGINT) AS searches, CAST(0 AS BIGINT) AS searches_with_no_results, CAST(0 AS BIGINT) AS job_views, CAST(0 AS BIGINT) AS saves,
 CAST(0 AS BIGINT) AS applications, CAST(0 AS BIGINT) AS cv_uploads, CAST(0 AS DOUBLE) AS empty_search_rate, CAST(0 AS DOUBLE) AS view_to_save_rate, CAST(0 AS DOUBLE) AS save_to_apply_rate""", lambda e: insights.overview(e, F.lit("2030-01-01").cast("date")))
query("agg_06_activity_by_day", "event", "SELECT day, " + ", ".join(f"nullif(count(*) FILTER (kind = '{k}'), 0) AS {k.lower()}" for k in insights.KINDS) + f" FROM event WHERE {_OURS} AND day >= DATE '{_DAY}' GROUP BY day", lambda e: insights.activity_by_day(e, _first()))
for _d in ("nation", "category"):
    query(f"agg_09_demand_by_{_d}", "event", f"""SELECT {_d} AS value, {_ENGAGED}, count(*) AS total FROM event WHERE {_OURS} AND kind IN ('JOB_VIEW', 'JOB_SAVE', 'APPLY') AND day >= DATE '{_DAY}' AND {_d} <> ''
 GROUP BY 1 ORDER BY total DESC, value LIMIT 15""", lambda e, d=_d: insights.demand_by(e, d, _first()))
query("agg_10_engagement", "event institution", f"""SELECT institution_id, name, views, saves, applications, total FROM (SELECT institution_id, {_ENGAGED}, count(*) AS total FROM event
 WHERE {_OURS} AND institution_id IS NOT NULL GROUP BY institution_id) JOIN institution USING (institution_id) ORDER BY total DESC, institution_id LIMIT 20""", lambda e, i: insights.engagement(e, i))
query("agg_11_posting_trends", "job", """SELECT institution_id, count(*) AS posted, count(*) FILTER (status = 'OPEN') AS open_now, count(*) FILTER (status = 'DISAPPEARED') AS closed, count(*) FILTER (status = 'WITHDRAWN') AS withdrawn
 FROM job WHERE first_seen >= DATE '1998-01-01' GROUP BY institution_id ORDER BY posted DESC, institution_id LIMIT 20""", lambda j: insights.posting_trends(j, F.lit("1998-01-01").cast("date")))
query("agg_12_postings_by_day", "job", "SELECT first_seen AS day, count(*) AS posted FROM job WHERE first_seen >= DATE '1998-01-01' GROUP BY 1", lambda j: insights.postings_by_day(j, F.lit("1998-01-01").cast("date")))
query("agg_12_posting_totals", "job", """SELECT count(*) FILTER (first_seen >= DATE '1998-01-01') AS posted, count(*) FILTER (status = 'OPEN') AS open_now,
 count(DISTINCT institution_id) FILTER (first_seen >= DATE '1998-01-01') AS institutions_posting FROM job""", lambda j: insights.posting_totals(j, F.lit("1998-01-01").cast("date")))
query("agg_08_top_searches", "event", f"""SELECT query, count(*) AS searches, count(DISTINCT actor) AS searchers, count(*) FILTER (result_count = 0) AS found_nothing FROM event
 WHERE {_OURS} AND kind = 'SEARCH' AND query <> '' AND day >= DATE '{_DAY}' GROUP BY query ORDER BY searches DESC, query LIMIT 3""", lambda e: insights.top_searches(e, _first(), 3))

_STOP = ", ".join(f"'{w}'" for w in text.QUERY_STOPWORDS)
_NORMAL = r"substring(lower(trim(regexp_replace(query, '\s+', ' ', 'g'))), 1, 200)"
_TERMS = rf"""terms AS (SELECT day, actor, unnest(list_distinct(list_filter(list_transform(regexp_extract_all({_NORMAL}, '[a-z0-9][a-z0-9+#.\-]*'), lambda t: regexp_replace(t, '^[.\-]+|[.\-]+$', '', 'g')),
 lambda t: length(t) >= 2 AND t NOT IN ({_STOP})))) AS term FROM {{0}} WHERE kind = 'SEARCH' AND actor_role = 'CANDIDATE' AND query <> '')"""
_ROLLUP = "SELECT day, term, count(*) AS occurrences, count(DISTINCT coalesce(CAST(actor AS VARCHAR), '')) AS searchers FROM terms GROUP BY day, term"
_CLOUD = f"SELECT term, CAST(sum(occurrences) AS BIGINT) AS occurrences, CAST(sum(searchers) AS BIGINT) AS searchers FROM ({_ROLLUP}) GROUP BY term ORDER BY occurrences DESC, term LIMIT 80"
query("agg_13_term_rollup", "search", _ROLLUP, insights.term_rollup, _TERMS.replace("{0}", "search"))
query("agg_13_term_rollup_of_events", "event", _ROLLUP, insights.term_rollup, _TERMS.replace("{0}", "event"))
query("agg_13_terms_as_streamed", "event", _ROLLUP, lambda e: rollup.daily_terms(e.withColumn("occurred_at", F.col("day").cast("timestamp") + F.expr("INTERVAL 12 HOURS"))), _TERMS.replace("{0}", "event"))
query("stm_08_lost_runs", "events", """SELECT user_id AS run_id, ts AS last_heartbeat, ts + INTERVAL 30 MINUTE AS lost_at FROM (SELECT user_id, ts, ended, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next FROM (
 SELECT user_id, ts, bool_or(event_type = 'purchase') AS ended FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY user_id, ts)) WHERE NOT ended AND (next IS NULL OR next - ts >= INTERVAL 30 MINUTE)""",
      lambda e: rollup.lost_runs(e.select(F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type") == "purchase", "COMPLETE").otherwise("RUNNING").alias("status"))))
query("agg_07_word_cloud", "search", _CLOUD, lambda s: insights.word_cloud(insights.term_rollup(s)), _TERMS.replace("{0}", "search"))
query("agg_21_cloud_maximum", "search", f"SELECT coalesce(max(occurrences), 0) AS max_occurrences FROM ({_CLOUD})", lambda s: insights.cloud_maximum(insights.word_cloud(insights.term_rollup(s))), _TERMS.replace("{0}", "search"))
query("str_13_normalised_queries", "search", f"SELECT query, {_NORMAL} AS term FROM search", lambda s: s.select("query", text.normalise_query(F.col("query")).alias("term")))
query("ret_01_prune_events", "event", "SELECT event_id, day FROM event WHERE day >= DATE '2024-01-30' - 14", lambda e: insights.prune(e, F.lit("2024-01-30").cast("date"), 14).select("event_id", "day"))
query("ret_03_unverified_accounts", "customer", "SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0 OR DATE '2020-01-01' + CAST(c_custkey % 20 AS INTEGER) >= DATE '2020-01-10' - 7",
      lambda c: insights.prune_unverified(c.selectExpr("c_custkey", "CASE WHEN c_custkey % 3 <> 0 THEN DATE '2020-01-01' END AS verified_at", "date_add(DATE '2020-01-01', CAST(c_custkey % 20 AS INT)) AS joined_at"), F.lit("2020-01-10").cast("date")).select("c_custkey"))
query("ret_04_last_two_days", "event", "SELECT event_id FROM event WHERE day > DATE '2024-01-20' - 2 AND day <= DATE '2024-01-20'", lambda e: _last_days(e))
query("flt_17_candidate_events", "event", f"SELECT event_id FROM event WHERE {_OURS} AND kind IN ('SEARCH', 'EXPORT') AND day >= DATE '{_DAY}'", lambda e: insights.since(insights.by_candidates(insights.of_kinds(e, "SEARCH", "EXPORT")), _first()).select("event_id"))
query("dat_03_local_days", "event", "SELECT event_id, CAST((CAST(day AS TIMESTAMP) + INTERVAL 23 HOUR + INTERVAL 30 MINUTE + to_days(CAST(150 * (event_id % 2) AS INTEGER))) AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/London' AS DATE) AS local_day FROM event",
      lambda e: e.select("event_id", insights.local_day(F.expr("CAST(date_add(day, CAST(150 * (event_id % 2) AS INT)) AS TIMESTAMP) + INTERVAL '23:30' HOUR TO MINUTE")).alias("local_day")))
query("evt_01_recorded", "event job institution", f"""SELECT e.event_id AS actor, e.kind, j.category, i.nation, i.institution_id, substring(lower(trim(regexp_replace(concat('  A ', e.query), '\\s+', ' ', 'g'))), 1, 200) AS query
 FROM event e LEFT JOIN job j ON j.job_id = CASE WHEN e.event_id % 3 = 0 THEN e.event_id END LEFT JOIN institution i ON i.institution_id = coalesce(e.institution_id, j.institution_id)""", lambda e, j, i: _recorded(e, j, i))
query("join_20_supply_and_demand", "event job institution", f"""SELECT s.institution_id, s.posted, coalesce(d.views, 0) AS views, coalesce(d.saves, 0) AS saves, coalesce(d.applications, 0) AS applications FROM
 (SELECT institution_id, count(*) AS posted FROM job GROUP BY institution_id ORDER BY posted DESC, institution_id LIMIT 500) s LEFT JOIN
 (SELECT institution_id, {_ENGAGED}, count(*) AS total FROM event WHERE {_OURS} AND institution_id IS NOT NULL GROUP BY institution_id ORDER BY total DESC, institution_id LIMIT 500) d USING (institution_id)""",
      lambda e, j, i: insights.supply_and_demand(insights.posting_trends(j, None, 500).select("institution_id", "posted"), insights.engagement(e, i, None, 500)))


def _last_days(e):
    from larkspur.sources import files

    return files.last_days(e, F.lit("2024-01-20").cast("date")).select("event_id")


def _recorded(e, j, i):
    actions = e.select("kind", "day", F.col("event_id").alias("actor"), "actor_role", F.expr("CASE WHEN event_id % 3 = 0 THEN event_id END").alias("job_id"), "institution_id", F.concat(F.lit("  A "), "query").alias("query"), "result_count")
    out = insights.recorded(actions, j, i)
    blank = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    return out.select("actor", "kind", blank("category"), blank("nation"), "institution_id", "query")
