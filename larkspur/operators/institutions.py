"""Institutions as a console shows and edits them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What each role may edit.
MANAGER_FIELDS = ["adapter_override", "crawl_enabled", "notes", "careers_url"]
ADMIN_FIELDS = MANAGER_FIELDS + ["name", "city", "nation", "institution_type", "ranking", "website", "description", "contact_email", "contact_phone", "address"]
RECRUITER_FIELDS = ["description", "contact_email", "contact_phone", "address"]


def effective_platform(override: Column, detected: Column) -> Column:
    """PRJ-05."""
    return F.coalesce(F.nullif(override, F.lit("")), detected)


def careers_host(url: Column) -> Column:
    """PRJ-06: with its port, in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def homepage(website: Column, careers_url: Column) -> Column:
    """EXT-17: the website, or the root of the careers page's site."""
    root = F.regexp_extract(F.coalesce(careers_url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+", 0)
    return F.coalesce(F.nullif(website, F.lit("")), F.when(root != "", F.concat(root, F.lit("/"))), F.lit(""))


def open_jobs(institutions: DataFrame, jobs: DataFrame) -> DataFrame:
    """AGG-14: institutions with the number of their open vacancies, 0 where there is none."""
    n = jobs.groupBy("institution_id").agg(F.count_if(F.col("status") == "OPEN").alias("open_jobs"))
    return institutions.join(n, "institution_id", "left").withColumn("open_jobs", F.coalesce("open_jobs", F.lit(0)))


def busiest_first(institutions: DataFrame) -> DataFrame:
    """ORD-06."""
    return institutions.orderBy(F.desc("open_jobs"), "name", "institution_id")


def by_ranking(institutions: DataFrame) -> DataFrame:
    """ORD-07: unranked ones last."""
    return institutions.orderBy(F.asc_nulls_last("ranking"), "name", "institution_id")


def attention(last: Column) -> Column:
    """ORD-07: 0 what went wrong, 1 never crawled, 2 a fallback was used, 3 fine; last is the last crawl's struct."""
    wrong = last["dropped_to_zero"] | (last["outcome"] != "OK")
    return F.when(last.isNull(), 1).when(wrong, 0).when(last["fallback_fired"], 2).otherwise(3)


def updated(institutions: DataFrame, institution_id: int, role: str, changes: dict, recruiters: DataFrame | None = None, user: int | None = None) -> DataFrame:
    """API-07: one institution with what its editor may change; other fields are left out, not refused. A new careers page has no known platform yet.

    ADMIN and RECRUITER have fields of their own, any other role a manager's. A recruiter who isn't assigned to the
    institution, by recruiters (institution_id, user), is an error.
    """
    if role == "RECRUITER" and (recruiters is None or recruiters.where((F.col("institution_id") == institution_id) & (F.col("user") == user)).isEmpty()):
        raise PermissionError(f"{user} isn't assigned to institution {institution_id}")
    allowed = {"ADMIN": ADMIN_FIELDS, "RECRUITER": RECRUITER_FIELDS}.get(role, MANAGER_FIELDS)
    given = {c: v for c, v in changes.items() if c in allowed}
    mine = F.col("institution_id") == institution_id
    out = institutions
    if "careers_url" in given:
        moved = mine & ~F.col("careers_url").eqNullSafe(F.lit(given["careers_url"]))
        out = out.withColumn("platform", F.when(moved, "UNKNOWN").otherwise(F.col("platform")))
    return out.withColumns({c: F.when(mine, F.lit(v)).otherwise(F.col(c)) for c, v in given.items()})


def deleted(institutions: DataFrame, jobs: DataFrame, institution_id: int) -> DataFrame:
    """API-08: without one institution, which may have no job."""
    used = jobs.where(F.col("institution_id") == institution_id).select("institution_id").distinct().withColumn("used", F.lit(True))
    wrong = F.raise_error(F.lit(f"institution {institution_id} has jobs")).cast("boolean")
    both = institutions.join(used, "institution_id", "left")
    return both.where(F.when(F.col("used"), wrong).otherwise(F.col("institution_id") != institution_id)).drop("used")


def assigned(institutions: DataFrame, recruiters: DataFrame, user: int) -> DataFrame:
    """API-04: the institutions that a recruiter looks after."""
    return institutions.join(recruiters.where(F.col("user") == user).select("institution_id"), "institution_id", "left_semi")


def verdict_list(institutions: DataFrame, matches: DataFrame) -> DataFrame:
    """API-09: every institution's sponsor verdict and how it came about."""
    m = matches.select("institution_id", "registered_legal_name", "verdict", "method", "confidence", "needs_review", "resolved_by_human")
    return institutions.select("institution_id", "name").join(m, "institution_id").orderBy("name", "institution_id")


def health(institutions: DataFrame, jobs: DataFrame, screenings: DataFrame, rulesets: DataFrame, runs: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """AGG-23: one row of counts: institutions, jobs, active rule sets, unscreened jobs, runs without a heartbeat for half an hour, and what of the last run's results isn't OK, with its status.

    runs: run_id, status, started_at, heartbeat_at; results: run_id, outcome. Of runs that started together the highest id is the last.
    """
    n = lambda rows, c: rows.agg(F.count("*").alias(c)).withColumn("one", F.lit(1))
    silent = (F.col("status") == "RUNNING") & (F.col("heartbeat_at") < now - F.make_dt_interval(mins=F.lit(30)))
    last = runs.agg(F.max_by(F.struct("run_id", "status"), F.struct("started_at", "run_id")).alias("last"))
    bad = results.where("outcome <> 'OK'").groupBy("run_id").agg(F.count("*").alias("bad"))
    of_last = last.select(F.col("last.run_id").alias("run_id"), F.coalesce("last.status", F.lit("NONE")).alias("last_status")).join(bad, "run_id", "left").select(F.coalesce("bad", F.lit(0)).alias("not_ok"), "last_status").withColumn("one", F.lit(1))
    out = n(institutions, "institutions")
    for rows, c in ((jobs, "jobs"), (rulesets.where("is_active"), "active_rulesets"), (jobs.join(screenings.select("job_id"), "job_id", "left_anti"), "unscreened"), (runs.where(silent), "stuck_runs")):
        out = out.join(n(rows, c), "one")
    return out.join(of_last, "one").drop("one")
