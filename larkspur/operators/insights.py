"""Dashboards over the event table; each is one grouped aggregation with partial sums before its shuffle.

What candidates did counts as demand; what staff did doesn't. since is the first day of a rolling window, None for all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import text

# What can happen.
KINDS = ["SEARCH", "JOB_VIEW", "JOB_SAVE", "JOB_UNSAVE", "APPLY", "APPLICATION_MOVE", "INSTITUTION_VIEW", "CV_UPLOAD", "EXPORT"]
_ENGAGED = {"views": "JOB_VIEW", "saves": "JOB_SAVE", "applications": "APPLY"}


def ratio(n: Column, d: Column) -> Column:
    """AGG-05: three places, 0 where the whole is 0."""
    return F.when(d > 0, F.round(n / d, 3)).otherwise(0.0)


def of_kind(kind: str) -> Column:
    return F.count_if(F.col("kind") == kind)


def window_days(days: int = 30) -> int:
    """LIM-02: 1 to 365 days."""
    return max(1, min(365, days))


def top_rows(rows: int = 20) -> int:
    """LIM-02: 1 to 500 rows."""
    return max(1, min(500, rows))


def clamped_days(days: Column) -> Column:
    """LIM-02 as data: 1 to 365 days, 30 without a number."""
    return F.greatest(F.lit(1), F.least(F.lit(365), F.coalesce(days, F.lit(30))))


def clamped_rows(rows: Column) -> Column:
    """LIM-02 as data: 1 to 500 rows, 20 without a number."""
    return F.greatest(F.lit(1), F.least(F.lit(500), F.coalesce(rows, F.lit(20))))


def since(events: DataFrame, first: Column | None, at: str = "day") -> DataFrame:
    """FLT-17 and DAT-04."""
    return events if first is None else events.where(F.col(at) >= first)


def of_kinds(events: DataFrame, *kinds: str) -> DataFrame:
    """FLT-17."""
    return events.where(F.col("kind").isin(*kinds))


def by_candidates(events: DataFrame) -> DataFrame:
    """FLT-17."""
    return events.where("actor_role = 'CANDIDATE'")


def local_day(at: Column, zone: str = "Europe/London") -> Column:
    """DAT-03: the day of an instant where the people are."""
    return F.to_date(F.from_utc_timestamp(at, zone))


def by_kind(events: DataFrame) -> DataFrame:
    return events.groupBy("kind").agg(F.count("*").alias("n"))


def overview(events: DataFrame, first: Column | None = None) -> DataFrame:
    """AGG-04: one row on what candidates did."""
    empty = F.count_if((F.col("kind") == "SEARCH") & (F.col("result_count") == 0))
    counts = {"searches": "SEARCH", "job_views": "JOB_VIEW", "saves": "JOB_SAVE", "applications": "APPLY", "cv_uploads": "CV_UPLOAD"}
    e = since(by_candidates(events), first).agg(F.count_distinct("actor").alias("active_candidates"), empty.alias("searches_with_no_results"), *[of_kind(k).alias(n) for n, k in counts.items()])
    rates = {"empty_search_rate": ("searches_with_no_results", "searches"), "view_to_save_rate": ("saves", "job_views"), "save_to_apply_rate": ("applications", "saves")}
    return e.withColumns({name: ratio(F.col(n), F.col(d)) for name, (n, d) in rates.items()})


def activity_by_day(events: DataFrame, first: Column | None = None) -> DataFrame:
    """AGG-06: a column for each kind, null where a day has none."""
    return since(by_candidates(events), first).groupBy("day").agg(*[F.nullif(of_kind(k), F.lit(0)).alias(k.lower()) for k in KINDS])


def _engaged() -> list[Column]:
    return [of_kind(kind).alias(name) for name, kind in _ENGAGED.items()]


def demand_by(events: DataFrame, dimension: str, first: Column | None = None, limit: int = 15) -> DataFrame:
    """AGG-09: what candidates viewed, saved and applied to; total counts these three kinds alone."""
    shown = since(by_candidates(of_kinds(events, *_ENGAGED.values())), first).where(F.col(dimension) != "")
    rows = shown.groupBy(F.col(dimension).alias("value")).agg(*_engaged(), F.count("*").alias("total"))
    return rows.orderBy(F.desc("total"), "value").limit(top_rows(limit))


def engagement(events: DataFrame, institutions: DataFrame, first: Column | None = None, limit: int = 20) -> DataFrame:
    """AGG-10: total counts all kinds. Institutions are joined after the aggregation."""
    shown = since(by_candidates(events), first).where("institution_id IS NOT NULL")
    rows = shown.groupBy("institution_id").agg(*_engaged(), F.count("*").alias("total"))
    return rows.join(institutions.select("institution_id", "name"), "institution_id").orderBy(F.desc("total"), "institution_id").limit(top_rows(limit))


def top_searches(events: DataFrame, first: Column | None = None, limit: int = 20) -> DataFrame:
    """AGG-08: whole search strings of candidates."""
    shown = since(by_candidates(of_kinds(events, "SEARCH")), first).where("query <> ''")
    rows = shown.groupBy("query").agg(F.count("*").alias("searches"), F.count_distinct("actor").alias("searchers"), F.count_if(F.col("result_count") == 0).alias("found_nothing"))
    return rows.orderBy(F.desc("searches"), "query").limit(top_rows(limit))


def term_rollup(events: DataFrame) -> DataFrame:
    """AGG-13: one vote a candidate's search for each of its terms; a null actor counts as one searcher."""
    shown = by_candidates(of_kinds(events, "SEARCH")).where("query <> ''")
    terms = shown.select("day", "actor", F.explode(text.search_terms(F.col("query"))).alias("term"))
    return terms.groupBy("day", "term").agg(F.count("*").alias("occurrences"), F.count_distinct(F.coalesce(F.col("actor").cast("string"), F.lit(""))).alias("searchers"))


def word_cloud(rollup: DataFrame, first: Column | None = None, limit: int = 80) -> DataFrame:
    """AGG-07: searchers are summed over days."""
    rows = since(rollup, first).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("searchers").alias("searchers"))
    return rows.orderBy(F.desc("occurrences"), "term").limit(top_rows(limit))


def cloud_maximum(cloud: DataFrame) -> DataFrame:
    """AGG-21: 0 for an empty cloud."""
    return cloud.agg(F.coalesce(F.max("occurrences"), F.lit(0)).alias("max_occurrences"))


def posting_trends(jobs: DataFrame, first: Column | None = None, limit: int = 20) -> DataFrame:
    """AGG-11: institutions by vacancies first seen in the window."""
    states = {"open_now": "OPEN", "closed": "DISAPPEARED", "withdrawn": "WITHDRAWN"}
    rows = since(jobs, first, "first_seen").groupBy("institution_id").agg(F.count("*").alias("posted"), *[F.count_if(F.col("status") == s).alias(n) for n, s in states.items()])
    return rows.orderBy(F.desc("posted"), "institution_id").limit(top_rows(limit))


def postings_by_day(jobs: DataFrame, first: Column | None = None) -> DataFrame:
    """AGG-12."""
    return since(jobs, first, "first_seen").groupBy(F.col("first_seen").alias("day")).agg(F.count("*").alias("posted"))


def posting_totals(jobs: DataFrame, first: Column) -> DataFrame:
    """AGG-12: one row; open_now is of all jobs, whenever first seen."""
    fresh = F.col("first_seen") >= first
    return jobs.agg(F.count_if(fresh).alias("posted"), F.count_if(F.col("status") == "OPEN").alias("open_now"), F.count_distinct(F.when(fresh, F.col("institution_id"))).alias("institutions_posting"))


def prune(events: DataFrame, today: Column, days: int = 365, at: str = "day") -> DataFrame:
    """RET-01 and RET-02: what stays."""
    return events.where(F.col(at) >= F.date_sub(today, days))


def prune_unverified(accounts: DataFrame, today: Column, days: int = 7) -> DataFrame:
    """RET-03: accounts that nobody verified in so many days go."""
    return accounts.where(F.col("verified_at").isNotNull() | (F.col("joined_at") >= F.date_sub(today, days)))


def recorded(actions: DataFrame, jobs: DataFrame, institutions: DataFrame) -> DataFrame:
    """EVT-01 and JOIN-15: events from (kind, day, actor, actor_role, job_id, institution_id, query, result_count).

    The institution is the action's own or its job's; nation and category are copied in, the query is normalised.
    """
    j = jobs.select("job_id", "category", F.col("institution_id").alias("job_institution"))
    a = actions.join(j, "job_id", "left").withColumn("institution_id", F.coalesce("institution_id", "job_institution"))
    a = a.join(institutions.select("institution_id", "nation"), "institution_id", "left")
    columns = ["kind", "day", "actor", F.coalesce("actor_role", F.lit("")).alias("actor_role"), "job_id", "institution_id", F.coalesce("nation", F.lit("")).alias("nation")]
    return a.select(*columns, F.coalesce("category", F.lit("")).alias("category"), text.normalise_query(F.coalesce("query", F.lit(""))).alias("query"), "result_count")


def supply_and_demand(supply: DataFrame, demand: DataFrame) -> DataFrame:
    """JOIN-20: figures of the institutions that post, with what candidates did there; 0 where nothing."""
    d = demand.select("institution_id", "views", "saves", "applications")
    return supply.join(d, "institution_id", "left").fillna(0, ["views", "saves", "applications"])
