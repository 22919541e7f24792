"""Canonical frames derived from the stored tables, as SQL that names its tables in braces."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


def choice(expression: str, *values: str) -> str:
    """SQL for one of values (SQL texts) by the rest of a whole number."""
    return f"CASE {expression} % {len(values)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


def texts(*values: str) -> list[str]:
    return ["'" + v.replace("'", "''") + "'" for v in values]


TITLES = texts("Lecturer in Physics", "Software Engineer", "Softwarehouse Keeper", "PhD Studentship in Genetics", "Payroll Officer", "Senior Nursing Fellow", "Head of Estates", "Chemistry Technician", "Director of Music", "Personal Assistant", "Modern Languages Tutor", "Gardener")
DEPARTMENTS = texts("", "School of Chemistry", "Finance Office", "Department of Psychology", "Estates", "Sport Science", "Law School")
ADVERTS = [
    *texts(
        "We need Python and Django, and 5 years of experience. Apply now.", "A good role. This post is  not eligible for sponsorship, sorry! Apply now.", "Lecturing in chemistry and machine learning; 12+ years experience, or 3 years in practice.", "",
        "Fixed-term, part time, hybrid working. C++ and Go, going on.", "Permanent contract. Full-time, on site. PhD and leadership required; 40 years of tradition.", "Secondment at 0.5 FTE, fully remote. Some Python, 2 or more years.",
    ),
    "concat('Hello. ', repeat('word ', 80), 'we are unable to sponsor any visa ', repeat('more ', 60), 'end. Cannot offer sponsorship.')",
]

EVENT = f"""
SELECT event_id, CAST(ts AS DATE) AS day, CASE WHEN user_id % 17 <> 0 THEN user_id END AS actor, CASE WHEN user_id % 13 <> 0 THEN user_id % 1500 + 1 END AS institution_id,
  CASE event_type WHEN 'view' THEN {choice('event_id', "'JOB_VIEW'", "'JOB_VIEW'", "'INSTITUTION_VIEW'")} WHEN 'purchase' THEN {choice('event_id', "'APPLY'", "'APPLICATION_MOVE'")}
    WHEN 'signup' THEN {choice('event_id', "'CV_UPLOAD'", "'EXPORT'")} WHEN 'click' THEN {choice('event_id', "'SEARCH'", "'JOB_SAVE'", "'JOB_SAVE'", "'JOB_UNSAVE'")} ELSE 'SEARCH' END AS kind,
  CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 7 END AS result_count, {choice('user_id', "'RECRUITER'", "'CANDIDATE'", "'CANDIDATE'", "'CANDIDATE'", "'ADMIN'")} AS actor_role,
  {choice('user_id', "''", "'ENGLAND'", "'SCOTLAND'", "'WALES'", "'NORTHERN_IRELAND'")} AS nation, {choice('event_id', "'Academic'", "''", "'Technical'", "'Clinical'")} AS category,
  CASE WHEN event_type IN ('click', 'error') THEN {choice('event_id', "'c++ developer'", "'lecturer in node.js'", "''", "'phd, genetics'", "'head of the estates'", "'c++ or go'")} ELSE '' END AS query
FROM {{events}}"""

INSTITUTION = """
SELECT c_custkey AS institution_id, c_name AS name, concat('inst-', CAST(c_custkey AS STRING)) AS slug, n_name AS city, r_name AS nation, c_mktsegment AS platform, c_acctbal > 0 AS crawl_enabled,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('https://Jobs', CAST(c_custkey % 9 AS STRING), '.Example.ac.uk:8080/careers?x=1') END AS careers_url,
  CASE WHEN c_custkey % 6 = 0 THEN 'TALEO' WHEN c_custkey % 6 = 1 THEN 'NO SUCH' ELSE '' END AS adapter_override, CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey % 130 AS INT) END AS ranking,
  CASE WHEN c_custkey % 3 = 0 THEN 'https://www.example.org/' ELSE '' END AS website, 'UNIVERSITY' AS institution_type, '' AS notes
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"""

JOB = f"""
SELECT o_orderkey AS job_id, o_custkey AS institution_id, concat('inst-', CAST(o_custkey % 200 AS STRING)) AS institution, concat('University No ', CAST(o_custkey % 200 AS STRING)) AS name,
  {choice('o_custkey', "'ENGLAND'", "'SCOTLAND'", "'WALES'", "'NORTHERN_IRELAND'", "''")} AS nation, {choice('o_custkey', "'Bath'", "'Leeds'", "'Bangor'", "''")} AS city,
  concat('https://jobs.example/', CAST(o_orderkey AS STRING)) AS source_url, concat({choice('o_orderkey', *TITLES)}, ' ', CAST(o_orderkey % 97 AS STRING)) AS title, o_orderpriority AS category,
  {choice('o_orderkey', *DEPARTMENTS)} AS department, {choice('o_orderkey', *ADVERTS)} AS description_text, concat('R', CAST(o_orderkey AS STRING)) AS reference,
  CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'F' THEN 'DISAPPEARED' ELSE 'WITHDRAWN' END AS status, {choice('o_orderkey', "'PORTAL'", "'PORTAL'", "'MANUAL'")} AS source,
  CASE WHEN o_orderkey % 19 <> 0 THEN CAST(o_orderdate AS DATE) END AS posted_date, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY AS DATE) END AS closing_date,
  CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 DAY AS DATE) AS first_seen, CAST(CAST(o_orderdate AS DATE) + INTERVAL 20 DAY AS DATE) AS last_seen,
  CASE WHEN o_orderstatus = 'F' THEN CAST(CAST(o_orderdate AS DATE) + INTERVAL 40 DAY AS DATE) END AS disappeared_at, CAST(NULL AS DATE) AS withdrawn_at,
  o_orderkey % 7 = 0 AS advert_excludes_sponsorship, CAST(o_orderkey % 101 AS INT) AS fitness_score, o_custkey % 11 = 0 AS is_saved,
  {choice('o_orderkey', "'CONFIRMED'", "'B_RATED'", "'NOT_FOUND'", "'OTHER_ROUTE_ONLY'", "'PROVISIONAL'", "'CONFIRMED_VIA_PARENT'", "'CONFIRMED'", "NULL")} AS sponsor_verdict,
  {choice('o_orderkey', "'PAY_CUT'", "'TARGET_BAND'", "'SALARY_UNCLEAR'")} AS threshold_verdict, 'Legal Name' AS sponsor_matched_name, 'why' AS threshold_explanation,
  CASE WHEN o_orderkey % 4 <> 0 THEN CAST(floor(o_totalprice) AS DECIMAL(12,2)) END AS salary_min, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(floor(o_totalprice) + 5000 AS DECIMAL(12,2)) END AS salary_max,
  {choice('o_orderkey', "'FIXED_TERM'", "'PERMANENT'", "''")} AS contract_type, {choice('o_orderkey', "'FULL_TIME'", "'PART_TIME'")} AS hours, {choice('o_orderkey', "'REMOTE'", "'UNKNOWN'")} AS workplace,
  {choice('o_orderkey', "'OTHER'", "'LAW'", "'PSYCHOLOGY'")} AS discipline, {choice('o_orderkey', "'Bath campus'", "''")} AS location_raw, {choice('o_orderkey', "'Grade 7'", "''", "'UE07'")} AS grade_raw,
  {choice('o_orderkey', "''", "'Permanent'", "'Temporary cover'")} AS contract_raw, {choice('o_orderkey', "''", "'Full time'", "'0.4 FTE'", "''")} AS hours_raw, o_orderkey % 17 = 0 AS is_manual, o_orderstatus = 'P' AS is_withdrawn,
  CASE o_orderkey % 10
    WHEN 0 THEN concat('£', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), ' to £', CAST(CAST(floor(o_totalprice) AS BIGINT) + 5000 AS STRING), ' per annum')
    WHEN 1 THEN concat('Salary up to £', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING))
    WHEN 2 THEN concat('£', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), ' - please see advert')
    WHEN 3 THEN concat('£', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), ' per annum, Grade 7')
    WHEN 4 THEN '£1,450.50 per month, band B' WHEN 5 THEN 'Competitive, daily allowance'
    WHEN 6 THEN concat('GBP ', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), ' pro rata, UE07')
    WHEN 7 THEN '  £12.50 an hour ' WHEN 8 THEN 'From £2,000.00 up to £2,100 weekly' ELSE '' END AS salary_raw
FROM {{orders}}"""

SEARCH = """
SELECT conv_id % 30 AS day, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE conv_id % 50 END AS actor, text AS query, conv_id % 4 AS result_count, 'SEARCH' AS kind,
  CASE WHEN conv_id % 5 = 0 THEN 'ADMIN' ELSE 'CANDIDATE' END AS actor_role
FROM {conversations} WHERE role = 'user'"""

#: Every move of an application, in the order of event_id.
APPLICATION_EVENT = f"""
SELECT o_orderkey % 5000 AS application_id, o_orderkey AS event_id, {choice('o_orderkey', *texts('FOUND', 'APPLIED', 'ACKNOWLEDGED', 'REJECTED', 'APPLIED', 'INTERVIEW', 'READY'))} AS to_status,
  CAST(o_orderdate AS DATE) AS occurred_at, o_custkey % 40 AS owner
FROM {{orders}}"""

#: One application for each owner and job at most.
APPLICATION = f"""
SELECT o_orderkey AS application_id, o_custkey % 40 AS owner, o_orderkey AS job_id, {choice('o_orderkey', *texts('FOUND', 'READY', 'APPLIED', 'ACKNOWLEDGED', 'INTERVIEW', 'OFFER', 'REJECTED'))} AS status,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END AS applied_at, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS DATE) END AS response_at, o_orderkey % 50 = 0 AS ghosted_flagged,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Call back' ELSE '' END AS next_action, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(CAST(o_orderdate AS DATE) + INTERVAL 9 DAY AS DATE) END AS next_action_due
FROM {{orders}} WHERE o_orderkey % 3 = 0"""

SAVED = "SELECT o_custkey % 40 AS owner, o_orderkey AS job_id, concat('note ', CAST(o_orderkey % 7 AS STRING)) AS note FROM {orders} WHERE o_orderkey % 4 = 0"

FITNESS = "SELECT o_custkey % 40 AS owner, o_orderkey AS job_id, CAST(o_orderkey % 101 AS INT) AS score, CASE WHEN o_orderkey % 2 = 0 THEN 'old' ELSE 'older' END AS criteria_hash FROM {orders} WHERE o_orderkey % 5 < 3"

REVISION = f"""
SELECT o_orderkey * 10 + l_linenumber AS revision_id, o_orderkey AS job_id, o_orderkey % 30 AS run_id, {choice('l_linenumber', "'title'", "'salary_raw'", "'closing_date'")} AS field,
  concat('a', CAST(l_linenumber AS STRING)) AS value_before, concat('b', CAST(l_linenumber AS STRING)) AS value_after, CAST(l_shipdate AS DATE) AS changed_at
FROM {{orders}} JOIN {{lineitem}} ON l_orderkey = o_orderkey"""

#: Results of crawl runs: ten institutions a run.
RUN = f"""
SELECT CAST(floor(o_orderkey / 10) AS BIGINT) AS run_id, o_orderkey AS result_id, o_custkey AS institution_id, CAST(o_orderdate AS DATE) AS started_at,
  CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE o_orderkey % 50 END AS vacancies_found, CASE WHEN o_orderkey % 6 = 0 THEN 'ZERO_RESULTS' WHEN o_orderkey % 11 = 0 THEN 'BLOCKED' ELSE 'OK' END AS outcome,
  o_orderkey % 3 AS jobs_new, o_orderkey % 5 AS jobs_updated, o_orderkey % 2 AS jobs_closed, o_orderkey % 13 = 0 AS fallback_fired, CASE WHEN o_orderkey % 11 = 0 THEN 'challenge page' ELSE '' END AS error_detail
FROM {{orders}}"""

NAMES = """
SELECT p_partkey, concat(CASE p_partkey % 4 WHEN 0 THEN 'The University of ' WHEN 1 THEN '' WHEN 2 THEN 'College & ' ELSE '' END, p_name, CASE p_partkey % 3 WHEN 0 THEN ' Limited' WHEN 1 THEN ' (HR)' ELSE '' END) AS name FROM {part}"""

REGISTER = """
SELECT DISTINCT concat(CASE p_partkey % 3 WHEN 0 THEN 'University of ' WHEN 1 THEN '' ELSE 'The ' END, p_name, CASE p_partkey % 5 WHEN 0 THEN ' Ltd' WHEN 1 THEN ' Group' WHEN 2 THEN ' Trust' ELSE '' END) AS register_name,
  CASE p_partkey % 4 WHEN 0 THEN 'Worker (B rating)' WHEN 1 THEN 'Worker (Provisional)' ELSE 'Worker (A rating)' END AS type_rating,
  CASE p_partkey % 6 WHEN 0 THEN 'Temporary Worker' ELSE 'Temporary Worker; Skilled Worker' END AS route
FROM {part} WHERE p_partkey % 2 = 1"""

MATCH = f"""
SELECT c_custkey AS institution_id, {choice('c_custkey', *texts('CONFIRMED', 'B_RATED', 'NOT_FOUND', 'PROVISIONAL', 'OTHER_ROUTE_ONLY'))} AS verdict, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS registered_legal_name,
  CAST(c_custkey % 10 AS DOUBLE) / 10 AS confidence, 'TRIGRAM' AS method, c_custkey % 4 = 0 AS needs_review, c_custkey % 7 = 0 AS resolved_by_human
FROM {{customer}} WHERE c_custkey % 8 <> 0"""

VIEWS = {
    "event": EVENT, "institution": INSTITUTION, "job": JOB, "search": SEARCH, "application_event": APPLICATION_EVENT, "application": APPLICATION, "saved": SAVED, "scored": FITNESS, "revision": REVISION, "run": RUN,
    "named": NAMES, "register": REGISTER, "match": MATCH,
}


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **used)


def plain(sql: str) -> str:
    """The same SQL over views of the tables' names."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)
