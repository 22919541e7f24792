"""Queries over snapshots, crawl runs, applications, digests, exports."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import classify, labels, text
from larkspur.operators import extraction, personal, records, search, tracking
from larkspur.plans.registry import query
from larkspur.plans.verdicts import _CASE, _DISCIPLINE
from larkspur.sources import files, keyed
from larkspur.sources.lineage import shared_folder

_FETCHED, _STORED = "job_id % 11 <> 0", "job_id % 13 <> 0"
_NEW_TITLE = "CASE WHEN job_id % 7 = 0 THEN ' New title ' ELSE title END"


def _snapshots(j: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a crawl fetched, some of it twice, and what was stored."""
    hashed = text.content_hash(*records.HASHED)
    f = j.where(_FETCHED).withColumn("title", F.expr(_NEW_TITLE)).withColumn("ordinal", F.col("job_id"))
    again = j.where(f"{_FETCHED} AND job_id % 5 = 0").withColumns({"title": F.lit("Second"), "ordinal": F.col("job_id") + 100_000_000})
    f = records.first_by(f.unionByName(again), "source_url", "ordinal")
    return f.withColumn("content_hash", hashed), j.where(_STORED).withColumn("content_hash", hashed)


_STATE = f"""CASE WHEN {_FETCHED} AND NOT ({_STORED}) THEN 'new' WHEN {_FETCHED} AND is_withdrawn THEN 'unchanged' WHEN {_FETCHED} AND (status <> 'OPEN' OR job_id % 7 = 0) THEN 'updated'
 WHEN {_FETCHED} THEN 'unchanged' WHEN status = 'OPEN' AND NOT is_manual THEN 'disappeared' ELSE 'kept' END"""
_SEEN = f"WHERE {_FETCHED} OR {_STORED}"
query("dif_01_snapshot_diff", "job", f"SELECT source_url, {_STATE} AS state FROM job {_SEEN}", lambda j: records.diff(*_snapshots(j), F.lit("OK")))
for _outcome in ("ZERO_RESULTS", "BLOCKED", "OFFLINE", "TIMEOUT", "PARSE_ERROR", "NO_ADAPTER"):
    query(f"dif_01_no_closure_when_{_outcome.lower()}", "job", f"SELECT source_url FROM job WHERE NOT ({_FETCHED}) AND {_STORED}", lambda j, o=_outcome: records.diff(*_snapshots(j), F.lit(o)).where("state = 'kept'").select("source_url"))
query("dif_02_field_changes", "job", f"SELECT source_url, 'title' AS field, title AS value_before, 'New title' AS value_after FROM job WHERE {_FETCHED} AND {_STORED} AND job_id % 7 = 0", lambda j: records.field_changes(*_snapshots(j)))
query("dif_03_diff_counts", "job", f"SELECT state, count(*) AS n FROM (SELECT {_STATE} AS state FROM job {_SEEN}) GROUP BY state", lambda j: records.diff(*_snapshots(j), F.lit("OK")).groupBy("state").agg(F.count("*").alias("n")))
query("dif_04_applied", "job", f"""SELECT job_id, CASE WHEN {_FETCHED} AND job_id % 7 = 0 AND (NOT ({_STORED}) OR NOT is_withdrawn) THEN 'New title' ELSE title END AS title, CASE WHEN is_withdrawn AND {_STORED} THEN status WHEN {_FETCHED} THEN 'OPEN' WHEN state = 'disappeared' THEN 'DISAPPEARED' ELSE status END AS status,
 CASE WHEN is_withdrawn AND {_STORED} THEN disappeared_at WHEN {_FETCHED} THEN NULL WHEN state = 'disappeared' THEN DATE '2002-01-01' ELSE disappeared_at END AS disappeared_at FROM (SELECT *, {_STATE} AS state FROM job {_SEEN})""",
      lambda j: _applied(j).select("job_id", F.trim("title").alias("title"), "status", "disappeared_at"))


def _applied(j: DataFrame) -> DataFrame:
    fetched, stored = _snapshots(j)
    return records.applied(fetched, stored, records.diff(fetched, stored, F.lit("OK")), F.lit("2002-01-01").cast("date"))


_JOINED = "concat_ws(' ', nullif(contract_raw, ''), nullif(hours_raw, ''), nullif(description_text, ''))"
_OWN = lambda c: f"lower(CASE WHEN {c} <> '' THEN {c} ELSE {_JOINED} END)"
_HASH = "sha256(concat(" + ", ".join(f"trim(coalesce(CAST({c} AS VARCHAR), '')), chr(31)" for c in records.HASHED) + "))"
query("dif_05_stored_fields", "job", f"SELECT job_id, {_CASE(_OWN('contract_raw'), classify.CONTRACT, 'UNKNOWN')} AS contract_type, {_CASE(_OWN('hours_raw'), classify.HOURS, 'UNKNOWN')} AS hours, {_CASE(f'lower({_JOINED})', classify.WORKPLACE, 'UNKNOWN')} AS workplace, {_DISCIPLINE} AS discipline, {_HASH} AS content_hash FROM job",
      lambda j: records.stored_fields(j).select("job_id", "contract_type", "hours", "workplace", "discipline", "content_hash"))
query("dif_06_existing_jobs", "job", "SELECT job_id, source_url, status, title, salary_raw, closing_date, location_raw, is_manual, is_withdrawn FROM job WHERE institution_id = 7", lambda j: j.where("institution_id = 7").select("job_id", "source_url", "status", "title", "salary_raw", "closing_date", "location_raw", "is_manual", "is_withdrawn"))
_RUN = "institution_id IN (SELECT institution_id FROM run WHERE run_id = 12)"
_NEW = f"SELECT job_id FROM job WHERE {_RUN} AND first_seen BETWEEN DATE '1996-01-01' AND DATE '1997-01-01'"
_CHANGED = f"SELECT DISTINCT job_id FROM revision WHERE run_id = 12 AND job_id NOT IN ({_NEW})"
query("dif_07_run_view", "job run revision", f"""SELECT job_id, 'new' AS part FROM ({_NEW}) UNION ALL SELECT job_id, 'changed' FROM ({_CHANGED}) UNION ALL
 SELECT job_id, 'disappeared' FROM job WHERE {_RUN} AND status = 'DISAPPEARED' AND disappeared_at BETWEEN DATE '1996-01-01' AND DATE '1997-01-01' AND job_id NOT IN ({_NEW}) AND job_id NOT IN ({_CHANGED})""",
      lambda j, r, v: records.run_view(12, F.lit("1996-01-01").cast("date"), F.lit("1997-01-01").cast("date"), j, r, v))
query("join_06_revised_in_run", "job revision", "SELECT job_id FROM job WHERE job_id IN (SELECT job_id FROM revision WHERE run_id = 12)", lambda j, v: j.join(v.where("run_id = 12"), "job_id", "left_semi").select("job_id"))
query("set_01_register_changes", "job", f"SELECT source_url, 'dropped_off' AS side FROM job WHERE NOT ({_FETCHED}) AND {_STORED} UNION ALL SELECT source_url, 'newly_listed' FROM job WHERE {_FETCHED} AND NOT ({_STORED})", lambda j: records.except_both(j.where(_STORED), j.where(_FETCHED), "source_url"))
query("set_05_first_by_title", "job", "SELECT title, min(job_id) AS job_id FROM job GROUP BY title", lambda j: records.first_by(j.select("title", "job_id"), "title", "job_id"))
query("str_23_content_hash", "job", f"SELECT job_id, {_HASH} AS hash FROM job", lambda j: j.select("job_id", text.content_hash(*records.HASHED).alias("hash")))

# Runs.
query("join_14_previous_run", "run", """SELECT result_id, previous_found, vacancies_found = 0 AND coalesce(previous_found, 0) > 0 AS dropped_to_zero, outcome = 'OK' AS permits_closure
 FROM (SELECT *, lag(vacancies_found) OVER (PARTITION BY institution_id ORDER BY started_at, result_id) AS previous_found FROM run)""", lambda r: records.previous_count(r.drop("run_id").withColumnRenamed("result_id", "run_id")).select(F.col("run_id").alias("result_id"), "previous_found", "dropped_to_zero", "permits_closure"))
query("join_13_latest_run", "run", "SELECT institution_id, max(result_id) AS result_id FROM run GROUP BY institution_id", lambda r: records.latest_by(r.select("institution_id", "result_id"), "institution_id", "result_id"))
query("src_09_latest_validators", "pages", "SELECT url, max(page_id) AS fetched_at, arg_max(concat('etag', page_id), page_id) AS etag FROM pages GROUP BY url", lambda p: records.latest_by(p.select("url", F.col("page_id").alias("fetched_at"), F.concat(F.lit("etag"), "page_id").alias("etag")), "url", "fetched_at"))
query("agg_15_run_totals", "run", "SELECT run_id, count(*) AS institutions_done, CAST(sum(jobs_new) AS BIGINT) AS jobs_new, CAST(sum(jobs_updated) AS BIGINT) AS jobs_updated, CAST(sum(jobs_closed) AS BIGINT) AS jobs_closed FROM run GROUP BY run_id", records.run_totals)
query("agg_17_latest_outcomes", "run", "SELECT outcome, count(*) AS n FROM run WHERE run_id = (SELECT arg_max(run_id, (started_at, run_id)) FROM run) GROUP BY outcome", records.latest_outcomes)
query("agg_18_crawl_age", "run", "SELECT CAST(date_diff('second', max(CAST(started_at AS TIMESTAMP)), TIMESTAMP '2003-01-01') AS BIGINT) AS age_seconds FROM run", lambda r: records.crawl_age(r, F.lit("2003-01-01").cast("timestamp")))
query("ord_05_problems_first", "run institution", "SELECT result_id FROM run JOIN institution USING (institution_id) ORDER BY CASE WHEN outcome = 'OK' THEN 1 ELSE 0 END, vacancies_found DESC, name, result_id LIMIT 60",
      lambda r, i: records.problems_first(r.drop("run_id").withColumnRenamed("result_id", "run_id").join(i.select("institution_id", "name"), "institution_id")).limit(60).select(F.col("run_id").alias("result_id")))
query("prj_07_durations", "job", "SELECT job_id, CAST(date_diff('second', CAST(first_seen AS TIMESTAMP), CAST(disappeared_at AS TIMESTAMP)) AS DOUBLE) AS seconds, status IN ('RUNNING', 'PAUSED') AS active FROM job", lambda j: j.select("job_id", records.duration_seconds(F.col("first_seen"), F.col("disappeared_at")).alias("seconds"), records.is_active(F.col("status")).alias("active")))
query("prj_10_last_crawls", "run", """SELECT institution_id, arg_max(outcome, (started_at, result_id)) AS outcome, arg_max(coalesce(previous_found, -1), (started_at, result_id)) AS previous_found
 FROM (SELECT *, lag(vacancies_found) OVER (PARTITION BY institution_id ORDER BY started_at, result_id) AS previous_found FROM run) GROUP BY institution_id""",
      lambda r: records.last_crawls(r.drop("run_id").withColumnRenamed("result_id", "run_id")).select("institution_id", "last_crawl.outcome", F.coalesce("last_crawl.previous_found", F.lit(-1)).alias("previous_found")))
query("api_13_outcome_lines", "run institution", """SELECT result_id, CASE WHEN outcome = 'BLOCKED' THEN 'WARNING' ELSE 'INFO' END AS level, concat(name, ': ', outcome, ' — ', vacancies_found, ' found', CASE WHEN outcome = 'OK' THEN concat(' (+', jobs_new, ' new, ~', jobs_updated, ' updated, -', jobs_closed, ' closed)') ELSE '' END,
 CASE WHEN error_detail <> '' THEN concat(' — ', error_detail) ELSE '' END) AS line FROM run JOIN institution USING (institution_id)""", lambda r, i: r.join(i.select("institution_id", "name"), "institution_id").select(
    "result_id", records.log_level(F.col("outcome")).alias("level"), records.outcome_line(*[F.col(c) for c in ("name", "outcome", "vacancies_found", "outcome", "jobs_new", "jobs_updated", "jobs_closed", "error_detail")]).alias("line")))


def _runs(n: DataFrame) -> DataFrame:
    return n.selectExpr("CAST(n_nationkey AS BIGINT) AS run_id", "CASE WHEN n_nationkey = 24 THEN 'RUNNING' WHEN n_nationkey = 23 THEN 'COMPLETE' ELSE 'CANCELLED' END AS status", "'MANUAL' AS trigger", "TIMESTAMP '2024-01-01' AS started_at",
                        "CAST(NULL AS TIMESTAMP) AS finished_at", "CASE WHEN n_nationkey = 5 THEN array(3L, 1L, 2L) ELSE array() END AS institution_ids", "CASE WHEN n_nationkey % 2 = 0 THEN TIMESTAMP '2024-01-01 10:00:00' ELSE TIMESTAMP '2024-01-01 11:00:00' END AS heartbeat_at")


_NOW = lambda: F.lit("2024-01-01 12:00:00").cast("timestamp")
_STATUS = "CASE WHEN n_nationkey = 24 THEN {} WHEN n_nationkey = 23 THEN 'COMPLETE' ELSE 'CANCELLED' END"
for _action, _to in (("pause", "PAUSED"), ("cancel", "CANCELLED"), ("finalise", "COMPLETE")):
    query(f"stm_05_{_action}", "nation", f"SELECT n_nationkey AS run_id, {_STATUS.format(repr(_to))} AS status, n_nationkey = 24 AND {_action != 'pause'} AS finished FROM nation", lambda n, a=_action: records.run_action(_runs(n), 24, a, _NOW()).select(F.col("run_id").cast("int").alias("run_id"), "status", F.col("finished_at").isNotNull().alias("finished")))
query("stm_05_started", "nation", "SELECT n_nationkey AS run_id, CASE WHEN n_nationkey = 23 THEN 'COMPLETE' ELSE 'CANCELLED' END AS status FROM nation WHERE n_nationkey <> 24 UNION ALL SELECT 24, 'RUNNING'", lambda n: records.started(_runs(n).where("run_id <> 24"), "MANUAL", [2, 3], _NOW()).select(F.col("run_id").cast("int").alias("run_id"), "status"))
query("stm_07_skipped", "institution", "SELECT institution_id, 'SKIPPED' AS outcome, 'cancelled' AS error_detail FROM institution WHERE institution_id < 9", lambda i: records.skipped(i.where("institution_id < 9"), 4, "cancelled").select("institution_id", "outcome", "error_detail"))
query("stm_08_stalled", "nation", "SELECT n_nationkey AS run_id, CASE WHEN n_nationkey = 24 THEN 'INCOMPLETE' WHEN n_nationkey = 23 THEN 'COMPLETE' ELSE 'CANCELLED' END AS status FROM nation", lambda n: records.stalled(_runs(n), _NOW()).select(F.col("run_id").cast("int").alias("run_id"), "status"))
query("set_03_retriable", "run institution", "SELECT institution_id FROM institution WHERE crawl_enabled AND careers_url <> '' AND institution_id NOT IN (SELECT institution_id FROM run WHERE outcome = 'OK' AND run_id = 7)",
      lambda r, i: records.retriable(records.crawlable(i).select("institution_id", F.col("institution_id").alias("position")), r.where("run_id = 7")).select("institution_id"))
query("set_04_scope_of_all", "nation institution", "SELECT institution_id FROM institution WHERE crawl_enabled AND careers_url <> ''", lambda n, i: records.run_scope(_runs(n), 6, i).select("institution_id"))
query("ret_02_old_pages", "pages", "SELECT page_id FROM pages WHERE DATE '2024-01-01' + CAST(page_id * 7 % 200 AS INTEGER) >= DATE '2024-07-01' - 90", lambda p: _pruned(p).select("page_id"))


def _pruned(p: DataFrame) -> DataFrame:
    from larkspur.operators import insights

    return insights.prune(p.withColumn("fetched_on", F.expr("date_add(DATE '2024-01-01', CAST(page_id * 7 % 200 AS INT))")), F.lit("2024-07-01").cast("date"), 90, "fetched_on")


# Applications.
_MOVES = """moves AS (SELECT * FROM (SELECT *, coalesce(lag(to_status) OVER (PARTITION BY application_id ORDER BY occurred_at, event_id), 'FOUND') AS from_status FROM application_event) WHERE from_status <> to_status)"""
query("stm_01_application_state", "application_event", """SELECT application_id, arg_max(to_status, (occurred_at, event_id)) AS status, min(occurred_at) FILTER (to_status = 'APPLIED') AS applied_at,
 min(occurred_at) FILTER (to_status IN ('ACKNOWLEDGED', 'INTERVIEW', 'OFFER', 'REJECTED')) AS response_at, count(*) AS moves FROM moves GROUP BY application_id""", records.application_state, _MOVES)
_QUIET = "(status = 'APPLIED' AND response_at IS NULL AND applied_at IS NOT NULL AND applied_at <= DATE '1999-01-01' - 21)"
query("dat_02_ghosted", "application", f"SELECT application_id, coalesce({_QUIET}, false) AS ghosted FROM application", lambda a: a.select("application_id", classify.looks_ghosted(F.col("status"), F.col("applied_at"), F.col("response_at"), F.lit("1999-01-01").cast("date")).alias("ghosted")))
query("stm_02_flagged", "application", f"SELECT application_id, ghosted_flagged OR coalesce({_QUIET}, false) AS ghosted_flagged FROM application", lambda a: records.flagged(a, F.lit("1999-01-01").cast("date")).select("application_id", "ghosted_flagged"))
query("agg_19_board", "application", "SELECT s.position, s.status, coalesce(string_agg(CAST(a.application_id AS VARCHAR), ',' ORDER BY a.application_id), '') AS cards FROM (VALUES " + ", ".join(f"({k}, '{s}')" for k, s in enumerate(records.BOARD)) + """) s(position, status)
 LEFT JOIN (SELECT * FROM application WHERE owner = 7) a USING (status) GROUP BY s.position, s.status""", lambda a: records.board(search.owned(a, 7)).withColumn("cards", F.array_join("cards", ",")))
query("stm_03_withdrawn", "job", "SELECT job_id, CASE WHEN job_id IN (1, 2, 3) THEN 'WITHDRAWN' ELSE status END AS status, CASE WHEN job_id IN (1, 2, 3) THEN DATE '2002-01-01' END AS withdrawn_at FROM job", lambda j: records.withdrawn(j, [1, 2, 3], F.lit("2002-01-01").cast("date")).select("job_id", "status", "withdrawn_at"))
query("stm_03_reinstated", "job", "SELECT job_id, CASE WHEN job_id < 200 AND status = 'WITHDRAWN' THEN 'OPEN' ELSE status END AS status FROM job", lambda j: records.reinstated(j, list(range(200))).select("job_id", "status"))
query("stm_03_deleted", "job", "SELECT job_id FROM job WHERE job_id NOT IN (2, 5)", lambda j: records.without_manual(j, [2, 5]).select("job_id"))
query("stm_04_manual_job", "job", "SELECT job_id, CASE WHEN job_id % 10 = 1 THEN 'MANUAL' ELSE source END AS source, CASE WHEN job_id % 10 = 1 THEN 'By hand' ELSE title END AS title FROM job",
      lambda j: records.upserted(j, j.where("job_id % 10 = 1").withColumns({"source": F.lit("MANUAL"), "title": F.lit("By hand")}), "institution_id", "source_url").select("job_id", "source", "title"))
query("api_01_manual_jobs", "job", f"""SELECT job_id, 'MANUAL' AS source, CASE WHEN job_id % 2 = 0 THEN 'CASUAL' ELSE {_CASE(_OWN('contract_raw'), classify.CONTRACT, 'UNKNOWN')} END AS contract_type, CASE WHEN description_text = '' THEN 'Typed in' ELSE description_text END AS description_text FROM job""".replace(
    _JOINED, "concat_ws(' ', nullif(contract_raw, ''), nullif(hours_raw, ''), CASE WHEN description_text = '' THEN 'Typed in' ELSE description_text END)"), lambda j: records.manual_jobs(j.withColumns({
        "description_html": F.lit("<p>Typed <b>in</b></p>"), "contract_type": F.when(F.col("job_id") % 2 == 0, "CASUAL").otherwise(""), "hours": F.lit(""), "workplace": F.lit(""), "discipline": F.lit("")})).select(
        "job_id", "source", "contract_type", F.regexp_replace("description_text", "\n", " ").alias("description_text")))
query("api_01_screened_at_once", "job match", "SELECT job_id, CASE WHEN job_id % 8 IN (1, 7) THEN 'NOT_FOUND' ELSE coalesce(verdict, 'NOT_FOUND') END AS sponsor_verdict, job_id % 8 IN (1, 7) AS advert_excludes_sponsorship FROM job LEFT JOIN match USING (institution_id)", lambda j, m: _by_hand(j, m))


def _by_hand(j: DataFrame, m: DataFrame) -> DataFrame:
    from larkspur.plans.verdicts import rules

    blank = {c: F.lit("") for c in ("description_html", "contract_type", "hours", "workplace", "discipline")}
    return records.added_by_hand(j.withColumns(blank), m, rules())[1].select("job_id", "sponsor_verdict", "advert_excludes_sponsorship")


def _after_edit(j: DataFrame, m: DataFrame) -> DataFrame:
    from larkspur.plans.verdicts import rules

    hand = j.withColumn("source", F.lit("MANUAL"))
    fresh, screened, vectors = records.edited_by_hand(hand, records.screening.screened(hand, m, rules()).withColumn("sponsor_verdict", F.lit("OLD")), 3, {"title": "Gardening Nurse", "description_text": "We cannot offer visa sponsorship."}, m, rules())
    return fresh.select("job_id", "title").join(screened.select("job_id", "sponsor_verdict"), "job_id").join(vectors.select("job_id", "title_vector"), "job_id", "left")


query("api_02_screened_again", "job match", "SELECT job_id, CASE WHEN job_id = 3 THEN 'Gardening Nurse' ELSE title END AS title, CASE WHEN job_id = 3 THEN 'NOT_FOUND' ELSE 'OLD' END AS sponsor_verdict, CASE WHEN job_id = 3 THEN 'garden nurs' END AS title_vector FROM job", _after_edit)
query("api_02_edited", "job", "SELECT job_id, CASE WHEN job_id = 2 THEN 'Edited' ELSE title END AS title FROM job", lambda j: records.edited(j, 2, {"title": "Edited"}).select("job_id", "title"))
_POUNDS = "coalesce(concat('£', regexp_replace(reverse(regexp_replace(reverse(CAST(CAST({0} AS BIGINT) AS VARCHAR)), '(\\d\\d\\d)', '\\1,', 'g')), '^,', '')), '—')"
query("str_29_labels", "job", f"""SELECT job_id, CASE WHEN salary_min IS NOT NULL AND salary_max IS NOT NULL THEN concat({_POUNDS.format('salary_min')}, ' – ', {_POUNDS.format('salary_max')}) WHEN salary_max IS NOT NULL THEN concat('Up to ', {_POUNDS.format('salary_max')})
 WHEN salary_min IS NOT NULL THEN concat('From ', {_POUNDS.format('salary_min')}) ELSE '—' END AS salary, CASE contract_type WHEN 'FIXED_TERM' THEN 'Fixed term' WHEN 'PERMANENT' THEN 'Permanent' ELSE '' END AS contract,
 CASE WHEN length(title) <= 12 THEN title WHEN strpos(reverse(title[1:12]), ' ') > 0 AND 12 - strpos(reverse(title[1:12]), ' ') > 7.2 THEN concat(rtrim(title[1:12 - strpos(reverse(title[1:12]), ' ')]), '…') ELSE concat(rtrim(title[1:12]), '…') END AS title FROM job""",
      lambda j: j.select("job_id", labels.salary_range(F.col("salary_min"), F.col("salary_max")).alias("salary"), labels.humanise(F.col("contract_type")).alias("contract"), labels.truncate(F.col("title"), 12).alias("title")))

# Deadlines and digests.
_TODAY = "DATE '1998-01-01'"
_T = lambda: F.lit("1998-01-01").cast("date")
query("dat_01_closing_soon", "job", f"SELECT job_id, coalesce(closing_date BETWEEN {_TODAY} AND {_TODAY} + 7, false) AS soon FROM job", lambda j: j.select("job_id", tracking.closes_within(F.col("closing_date"), _T(), 7).alias("soon")))
query("dat_07_closing_labels", "job", f"""SELECT job_id, closing_date - {_TODAY} AS days, CASE WHEN closing_date IS NULL THEN 'No closing date' WHEN closing_date < {_TODAY} THEN 'Closed' WHEN closing_date = {_TODAY} THEN 'Closes today' WHEN closing_date = {_TODAY} + 1 THEN 'Closes tomorrow'
 ELSE concat('Closes in ', closing_date - {_TODAY}, ' days') END AS label FROM job""", lambda j: j.select("job_id", tracking.days_until(F.col("closing_date"), _T()).cast("long").alias("days"), tracking.closing_label(F.col("closing_date"), _T()).alias("label")))
_SEARCHES = [{"search_id": 1, "query": "nation=WALES&min_fitness=30", "last_run": "1997-06-01"}, {"search_id": 2, "query": "status=OPEN&order=title", "last_run": None}]
query("dig_01_new_matches", "job", f"""SELECT * FROM (SELECT CAST(1 AS BIGINT) AS search_id, job_id FROM job WHERE first_seen >= DATE '1997-06-01' AND nation = 'WALES' AND fitness_score >= 30 ORDER BY posted_date DESC NULLS FIRST, first_seen DESC NULLS FIRST, job_id LIMIT 20)
 UNION ALL SELECT * FROM (SELECT 2, job_id FROM job WHERE first_seen >= {_TODAY} - 1 AND status = 'OPEN' ORDER BY title, job_id LIMIT 20)""", lambda j: tracking.new_matches(j, _SEARCHES, datetime.date(1998, 1, 1)))
query("join_16_recipients", "saved application", "SELECT DISTINCT owner FROM (SELECT owner FROM saved WHERE owner % 3 = 0 UNION ALL SELECT owner FROM application WHERE owner % 5 = 0 UNION ALL VALUES (1))", lambda s, a: tracking.recipients(s.where("owner = 1").limit(1).withColumn("digest_enabled", F.lit(True)).unionByName(s.where("owner = 2").withColumn("digest_enabled", F.lit(False))), s.where("owner % 3 = 0"), a.where("owner % 5 = 0")))
query("snk_08_digest_lines", "job", f"""SELECT job_id, 0 AS part, concat('  · ', title, ' — ', name, ' [', sponsor_verdict, ' · ', threshold_verdict, ']') AS line FROM job WHERE job_id % 8 < 7 UNION ALL SELECT job_id, 0, concat('  · ', title, ' — ', name, ' [unscreened]') FROM job WHERE job_id % 8 = 7
 UNION ALL SELECT job_id, 1, concat('  · ', strftime(closing_date, '%d %b'), ' — ', title, ', ', name) FROM job WHERE closing_date IS NOT NULL""", lambda j: _lines(j))


def _lines(j: DataFrame) -> DataFrame:
    named = j.withColumns({"institution": F.col("name"), "place": F.col("job_id")})
    due = named.where("false").withColumns({"next_action_due": F.col("closing_date"), "next_action": F.lit("")})
    return tracking.digest_lines(named, named.where("closing_date IS NOT NULL"), due).select(F.col("place").alias("job_id"), "part", "line")


query("snk_05_personal_data", "saved application", """SELECT CAST(9 AS BIGINT) AS owner, (SELECT count(*) FROM saved WHERE owner = 9) AS saved, (SELECT count(*) FROM application WHERE owner = 9) AS applications, (SELECT min(job_id) FROM saved WHERE owner = 9) AS first_saved""",
      lambda s, a: tracking.personal_data(9, {"saved_jobs": s.select("owner", "job_id", "note"), "applications": a.select("owner", "job_id", "status")}).select(
          F.col("owner").cast("long").alias("owner"), *[F.size(F.from_json(F.get_json_object("document", f"$.{k}"), "array<struct<job_id:long>>")).cast("long").alias(n) for k, n in (("saved_jobs", "saved"), ("applications", "applications"))],
          F.get_json_object("document", "$.saved_jobs[0].job_id").cast("long").alias("first_saved")))


def _people(c, s, j, a, m, t, d, e):
    """All that is kept about everyone: accounts of customers, searches of conversations, profiles and files of documents."""
    day = lambda column: F.col(column).cast("timestamp").alias("at")
    never = F.lit(None).cast("timestamp").alias("at")
    sections = {
        "account": c.select(F.col("c_custkey").alias("owner"), never, F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.col("c_mktsegment").alias("role")),
        "saved_jobs": personal.with_jobs(s, j).select("owner", never, F.col("job_id").alias("id"), "job", "note"),
        "applications": personal.with_jobs(a, j).select("owner", day("applied_at"), F.col("application_id").alias("id"), "application_id", "job", "status", "applied_at", "response_at", "next_action", "next_action_due"),
        "history": m.select("owner", day("occurred_at"), F.col("event_id").alias("id"), "application_id", "to_status", "occurred_at"),
        "saved_searches": t.where("role = 'user'").select((F.col("conv_id") % 40).alias("owner"), never, (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("query"), (F.col("conv_id") % 2 == 0).alias("digest_enabled")),
        "candidate_profiles": d.select((F.col("doc_id") % 40).alias("owner"), never, F.col("doc_id").alias("id"), F.col("source").alias("name"), (F.col("doc_id") % 3 == 0).alias("is_active")),
        "cvs": d.select((F.col("doc_id") % 40).alias("owner"), never, F.col("doc_id").alias("id"), F.col("n_chars").alias("byte_size"), F.col("text").alias("extracted_text")),
        "activity": e.select(F.col("actor").alias("owner"), day("day"), F.col("event_id").alias("id"), "kind", F.col("day").alias("occurred_at"), "query", "category", "nation", "result_count"),
    }
    each = personal.parts(sections).select("owner", "section", "start", F.posexplode("items").alias("k", "item"))
    fields = "username STRING, job STRUCT<title: STRING>, note STRING, status STRING, to_status STRING, digest_enabled STRING, is_active STRING, kind STRING, query STRING, extracted_text STRING"
    told = F.from_json("item", fields).alias("told")  # read once, not once a field
    said = F.concat_ws("|", *[f"told.{f}" for f in ("username", "job.title", "note", "status", "to_status", "digest_enabled", "is_active", "kind", "query", "extracted_text")])
    return each.select("owner", "section", (F.col("start") + F.col("k")).cast("long").alias("place"), told).select("owner", "section", "place", F.md5(said).alias("told"))


query("snk_05_all_people", "customer saved job application application_event conversations documents event", """SELECT owner, section, row_number() OVER (PARTITION BY owner, section ORDER BY moment DESC NULLS LAST, id) - 1 AS place, md5(told) AS told FROM (
 SELECT c_custkey AS owner, 'account' AS section, CAST(NULL AS DATE) AS moment, c_custkey AS id, c_name AS told FROM customer
 UNION ALL SELECT s.owner, 'saved_jobs', NULL, s.job_id, concat_ws('|', j.title, s.note) FROM saved s LEFT JOIN job j USING (job_id)
 UNION ALL SELECT a.owner, 'applications', a.applied_at, a.application_id, concat_ws('|', j.title, a.status) FROM application a LEFT JOIN job j USING (job_id)
 UNION ALL SELECT owner, 'history', occurred_at, event_id, to_status FROM application_event
 UNION ALL SELECT conv_id % 40, 'saved_searches', NULL, conv_id * 1000 + turn, concat_ws('|', CASE WHEN conv_id % 2 = 0 THEN 'true' ELSE 'false' END, text) FROM conversations WHERE role = 'user'
 UNION ALL SELECT doc_id % 40, 'candidate_profiles', NULL, doc_id, CASE WHEN doc_id % 3 = 0 THEN 'true' ELSE 'false' END FROM documents
 UNION ALL SELECT doc_id % 40, 'cvs', NULL, doc_id, coalesce(text, '') FROM documents
 UNION ALL SELECT actor, 'activity', day, event_id, concat_ws('|', kind, query) FROM event WHERE actor IS NOT NULL)""", _people)


def _upserted(j):
    """Jobs by key, with withdrawn and new ones written over the buckets that they touch."""
    rows = j.select("job_id", "title", "status")
    table = keyed.Keyed(f"{shared_folder(j.sparkSession)}/jobs-{uuid.uuid4().hex}", ("job_id",), 64)
    keyed.create(rows, table)
    new = rows.where("job_id % 100 = 0").select((-1 - F.col("job_id")).alias("job_id"), "title", F.lit("OPEN").alias("status"))
    keyed.upsert(rows.where("job_id % 50 = 0").withColumn("status", F.lit("WITHDRAWN")).unionByName(new), table)
    return keyed.current(j.sparkSession, table, rows.schema)


query("dif_04_upserted", "job", """SELECT job_id, title, CASE WHEN job_id % 50 = 0 THEN 'WITHDRAWN' ELSE status END AS status FROM job UNION ALL SELECT -1 - job_id, title, 'OPEN' FROM job WHERE job_id % 100 = 0""", _upserted)

# Exports.
query("snk_03_export_rows", "job", """SELECT source_url, title, name AS institution, CASE WHEN location_raw <> '' THEN location_raw ELSE city END AS location, coalesce(CAST(salary_min AS VARCHAR), '') AS salary_min, coalesce(sponsor_verdict, '') AS sponsor_verdict, CASE WHEN advert_excludes_sponsorship THEN 'yes' ELSE 'no' END AS advert_excludes_sponsorship,
 CASE WHEN fitness_score = 0 THEN '' ELSE CAST(fitness_score AS VARCHAR) END AS fitness_score, coalesce(CAST(closing_date AS VARCHAR), '') AS closing_date FROM job""",
      lambda j: files.export_rows(j).select("source_url", "title", "institution", "location", "salary_min", "sponsor_verdict", "advert_excludes_sponsorship", "fitness_score", "closing_date"))
_LABEL = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in files.VERDICTS.items()) + " ELSE {0} END"
query("api_15_site_rows", "job", f"SELECT job_id, {_LABEL.format('sponsor_verdict')} AS sponsor_verdict, {_LABEL.format('threshold_verdict')} AS threshold_verdict, coalesce(CAST(closing_date AS VARCHAR), '') AS closing_date FROM job WHERE status = 'OPEN' AND sponsor_verdict IS NOT NULL", lambda j: files.site_rows(j).select("job_id", "sponsor_verdict", "threshold_verdict", "closing_date"))
query("agg_22_site_counts", "job", "SELECT institution_id, name AS institution, count(*) AS count FROM job WHERE status = 'OPEN' AND sponsor_verdict IS NOT NULL GROUP BY ALL", lambda j: files.site_counts(files.site_rows(j)))
query("api_14_labels", "job", f"SELECT job_id, {_LABEL.format('sponsor_verdict')} AS label FROM job", lambda j: j.select("job_id", files.labelled(F.col("sponsor_verdict"), files.VERDICTS).alias("label")))
query("src_08_stored_bodies", "pages", "SELECT DISTINCT concat(substring(sha256(url), 1, 16), '-', sha256(html)) AS cache_key FROM pages", lambda p: files.store_bodies(p).select("cache_key"))
query("src_07_demo_jobs", "institution", "SELECT slug AS institution_slug, institution_id, DATE '2024-05-10' - CAST(institution_id % 9 AS INTEGER) AS posted_date, DATE '2024-05-10' + CAST(institution_id % 30 AS INTEGER) AS closing_date FROM institution",
      lambda i: files.demo_jobs(i.selectExpr("slug AS institution_slug", "institution_id % 9 AS posted_days_ago", "institution_id % 30 AS closes_in_days"), i, F.lit("2024-05-10").cast("date")).select("institution_slug", "institution_id", "posted_date", "closing_date"))
query("snk_10_redacted", "documents", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\w.+-]+@[\w-]+\.[\w.-]+', 'redacted@example.ac.uk', 'g'), '\+44\s?\(?0?\)?[\d\s-]{9,13}', '+44 000 000 0000', 'g'), '\b0\d{3}\s?\d{3}\s?\d{4}\b', '0000 000 0000', 'g'), 'AIza[0-9A-Za-z_-]{35}', 'REDACTED-API-KEY', 'g') AS text FROM documents""",
      lambda d: d.select("doc_id", text.redact(F.col("text")).alias("text")))

# What detection and outcomes say of addresses.
query("ext_18_detected", "institution", "SELECT institution_id, CASE institution_id % 6 WHEN 0 THEN 'TALEO' WHEN 1 THEN 'WORKDAY' WHEN 2 THEN 'EPLOY' WHEN 3 THEN 'GENERIC_CARD_SCRAPE' WHEN 4 THEN 'STRUCTURED' END AS platform FROM institution",
      lambda i: i.select("institution_id", extraction.detected(F.expr("CASE institution_id % 6 WHEN 0 THEN 'https://x.TALEO.net/' WHEN 1 THEN 'https://a.myworkdayjobs.com' WHEN 3 THEN 'https://www.qmul.ac.uk/jobs' ELSE 'https://elsewhere/' END"), F.expr("CASE institution_id % 6 WHEN 2 THEN 'Run by EPLOY' ELSE 'nothing' END"), F.expr("institution_id % 6 = 4")).alias("platform")))
query("ext_19_resolved", "institution", "SELECT institution_id, CASE WHEN adapter_override = 'TALEO' THEN 'TALEO' WHEN adapter_override <> '' THEN 'NO_ADAPTER' WHEN institution_id % 2 = 0 THEN 'EPLOY' ELSE 'NO_ADAPTER' END AS platform FROM institution",
      lambda i: i.select("institution_id", extraction.resolved(F.col("adapter_override"), F.expr("CASE WHEN institution_id % 2 = 0 THEN 'EPLOY' END")).alias("platform")))
query("ext_21_crawl_outcomes", "run", "SELECT result_id, CASE WHEN result_id % 7 = 0 THEN 'SKIPPED' WHEN result_id % 5 = 0 THEN 'OFFLINE' WHEN result_id % 3 = 0 THEN 'TIMEOUT' WHEN result_id % 2 = 0 THEN 'PARSE_ERROR' WHEN vacancies_found > 0 THEN 'OK' ELSE 'ZERO_RESULTS' END AS outcome FROM run",
      lambda r: r.select("result_id", extraction.crawl_outcome(F.expr("CASE WHEN result_id % 7 = 0 THEN '' ELSE 'u' END"), F.expr("CASE WHEN result_id % 5 = 0 THEN 'OFFLINE' END"), F.expr("CASE WHEN result_id % 3 = 0 THEN 'Timeout' WHEN result_id % 2 = 0 THEN 'Surprise' END"), F.col("vacancies_found")).alias("outcome")))
query("api_10_active_runs", "nation", "SELECT n_nationkey AS run_id FROM nation WHERE n_nationkey = 24", lambda n: _runs(n).where(records.is_active(F.col("status"))).select(F.col("run_id").cast("int").alias("run_id")))
query("join_19_unknown_seeds", "institution", "SELECT count(*) FILTER (institution_id % 4 = 0) AS skipped, count(*) FILTER (institution_id % 4 <> 0) AS seeded FROM institution", lambda i: _seeds(i))


def _seeds(i: DataFrame) -> DataFrame:
    from larkspur.operators import linkage

    s = linkage.seeded_matches(i.where("institution_id % 4 <> 0"), i.selectExpr("slug", "'ON REGISTER' AS register_status", "'' AS type_rating", "'' AS routes", "name AS registered_legal_name"))
    return s.agg(F.count_if(F.col("institution_id").isNull()).alias("skipped"), F.count_if(F.col("institution_id").isNotNull()).alias("seeded"))
