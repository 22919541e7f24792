"""Filtering, facets, ranking, pages and rows of vacancies. Whose saved jobs, scores and applications is always an argument."""

from __future__ import annotations

from functools import reduce
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import lexemes
from larkspur.operators.screening import SPONSORING
from larkspur.sources import lineage

# The dimensions that facets are counted by.
DIMENSIONS = ["institution", "nation", "category", "discipline", "status", "source", "contract_type", "hours", "workplace", "sponsor_verdict", "threshold_verdict"]
#: Filters that take one value; all others take alternatives.
SINGLE = ["q", "city", "sponsorable", "salary_min", "salary_max", "min_fitness", "posted_after", "closing_before", "closing_after", "saved", "order"]
RANGES = {"posted_after": ("posted_date", ">="), "closing_before": ("closing_date", "<="), "closing_after": ("closing_date", ">="), "salary_min": ("salary_min", ">="), "salary_max": ("salary_min", "<=")}


def sponsorable() -> Column:
    """FLT-08; its negation is null-safe."""
    return F.coalesce(F.col("sponsor_verdict").isin(SPONSORING) & ~F.col("advert_excludes_sponsorship"), F.lit(False))


def conditions(params: dict) -> dict[str, Column]:
    """FLT-01 to 11: a Column for each parameter given; many values are alternatives. Both salary limits compare the floor."""
    out: dict[str, Column] = {}
    for name, value in params.items():
        if name in RANGES:
            column, sign = RANGES[name]
            end = F.lit(value).cast("decimal(12,2)" if column == "salary_min" else "date")
            out[name] = F.col(column) >= end if sign == ">=" else F.col(column) <= end
        elif name == "city":
            out[name] = F.contains(F.lower("city"), F.lit(value.lower()))
        elif name == "sponsorable":
            out[name] = sponsorable() if value else ~sponsorable()
        elif name == "min_fitness":
            out[name] = F.coalesce("fitness_score", F.lit(0)) >= value
        elif name == "saved":  # rows of with_owner(); nobody's saved jobs are nobody's
            out[name] = F.col("is_saved") if value else ~F.col("is_saved")
        elif name in DIMENSIONS:
            out[name] = F.col(name).isin(list(value))
        elif name not in ("q", "order"):
            raise ValueError(f"unknown filter {name}")
    return out


def _all(tests) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def filtered(jobs: DataFrame, params: dict) -> DataFrame:
    return jobs.where(_all(conditions(params).values()))


def listed(jobs: DataFrame, params: dict, default_open: bool = True) -> DataFrame:
    """FLT-14: a list asked for without any parameter shows open vacancies alone."""
    return jobs.where("status = 'OPEN'") if default_open and not params else filtered(jobs, params)


def with_owner(jobs: DataFrame, owner: int | None, saved: DataFrame, scores: DataFrame, applications: DataFrame) -> DataFrame:
    """PRJ-03, JOIN-03 to 05, FLT-18: jobs with this owner's is_saved, fitness_score, fitness_reasons, application_id and application_status.

    saved, scores and applications have at most one row for each owner and job. No owner: nothing saved, scored or applied to.
    """
    mine = lambda t: t.where(F.col("owner").eqNullSafe(F.lit(owner)) & F.lit(owner is not None))
    s = mine(saved).select("job_id", F.lit(True).alias("is_saved"))
    f = mine(scores).select("job_id", F.col("score").alias("fitness_score"), "reasons")
    a = mine(applications).select("job_id", "application_id", F.col("status").alias("application_status"))
    j = jobs.join(s, "job_id", "left").join(f, "job_id", "left").join(a, "job_id", "left")
    return j.withColumns({"is_saved": F.coalesce("is_saved", F.lit(False)), "fitness_score": F.coalesce("fitness_score", F.lit(0)), "fitness_reasons": F.col("reasons")}).drop("reasons")


def owned(rows: DataFrame, owner: int) -> DataFrame:
    """FLT-18: personal tables are never read without an owner."""
    return rows.where(F.col("owner") == owner)


def facets(jobs: DataFrame, params: dict, dimensions: list[str] = DIMENSIONS) -> DataFrame:
    """AGG-01 in one pass: a dimension's values count under all filters but its own."""
    tests = {k: F.coalesce(c, F.lit(False)) for k, c in conditions(params).items()}
    tested = jobs.select(*dimensions, *[c.alias(f"__{k}") for k, c in tests.items()])
    rows = [F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"), _all(F.col(f"__{k}") for k in tests if k != d).alias("ok")) for d in dimensions]
    flat = tested.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("ok AND value IS NOT NULL AND value <> ''")
    return flat.groupBy("dimension", "value").agg(F.count("*").alias("n"))


def browse(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """AGG-25: counts of a facet beside every label (grouping, position, value, label), 0 where it has none."""
    c = counts.where("dimension = 'discipline'").select("value", "n")
    return labels.join(c, "value", "left").select("grouping", "position", "value", "label", F.coalesce("n", F.lit(0)).alias("n"))


#: ORD-01 with PostgreSQL's places for nulls: last ascending, first descending.
KEYS = {"posted": "posted_date", "closing": "closing_date", "fitness": "fitness_score", "salary": "salary_min", "seen": "first_seen", "title": "title"}
#: ORD-03.
NEWEST = ["-posted", "-seen"]


def order_by(keys: list[str]) -> list[Column]:
    return [F.desc_nulls_first(KEYS[k[1:]]) if k[0] == "-" else F.asc_nulls_last(KEYS[k]) for k in keys]


def with_vectors(jobs: DataFrame) -> DataFrame:
    """STR-15: jobs with what full-text search reads; worth storing."""
    everything = F.concat_ws(" ", "title", "department", "name", "description_text")
    return jobs.withColumns({"title_vector": lexemes.lexemes(F.col("title")), "search_vector": lexemes.lexemes(everything)})


def ladder(query: str) -> Column:
    """STR-17 and ORD-02: 5 title by words, 4 title by letters, 3 department or institution, 2 any field by words, 1 description by letters, 0 none."""
    q = F.lit(query.lower())
    inside = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), q)
    rungs = [(5, lexemes.websearch(query, F.col("title_vector"))), (4, inside("title")), (3, inside("department") | inside("name")), (2, lexemes.websearch(query, F.col("search_vector"))), (1, inside("description_text"))]
    out = F
    for value, test in rungs:
        out = out.when(test, value)
    return out.otherwise(0)


def searched(jobs: DataFrame, query: str) -> DataFrame:
    """Jobs with vectors that any rung finds, with their relevance; a blank query finds all."""
    term = query.strip()
    return jobs.withColumn("relevance", ladder(term)).where("relevance > 0") if term else jobs.withColumn("relevance", F.lit(0))


def ordered(jobs: DataFrame, order: list[str] | None, query: str = "") -> DataFrame:
    """ORD-02: an order asked for comes first, else relevance of a search, else the newest; job_id settles ties."""
    keys = order_by(order) if order else [F.desc("relevance"), F.desc_nulls_first("posted_date")] if query.strip() else order_by(NEWEST)
    return jobs.orderBy(*keys, "job_id")


def page(rows: DataFrame, number: int, size: int = 25) -> DataFrame:
    """LIM-01 after a total order; size at most 200."""
    size = max(1, min(size, 200))
    return rows.offset((max(number, 1) - 1) * size).limit(size)


def page_counts(rows: DataFrame, size: int = 25) -> DataFrame:
    """LIM-01: one row (count, total_pages)."""
    size = max(1, min(size, 200))
    return rows.agg(F.count("*").alias("count")).withColumn("total_pages", F.greatest(F.lit(1), F.ceil(F.col("count") / size)).cast("long"))


_SCREENING = ["sponsor_verdict", "sponsor_matched_name", "advert_excludes_sponsorship", "salary_min", "salary_max", "threshold_verdict", "threshold_explanation"]
_LIST = "job_id title name institution nation department category discipline city location_raw salary_raw grade_raw contract_raw hours_raw contract_type hours workplace posted_date closing_date status source source_url first_seen last_seen".split()


def _rows(jobs: DataFrame, *more: str | Column) -> DataFrame:
    screening = F.when(F.col("sponsor_verdict").isNull(), F.raise_error(F.concat(F.lit("no screening for job "), F.col("job_id").cast("string")))).otherwise(F.struct(*_SCREENING))
    return jobs.select(*_LIST, screening.alias("screening"), "is_saved", "fitness_score", "fitness_reasons", *more)


def list_rows(jobs: DataFrame) -> DataFrame:
    """PRJ-01 and PRJ-04: what a list shows of with_owner()'s screened jobs, the screening nested. An unscreened row is an error."""
    return _rows(jobs)


def detail_rows(jobs: DataFrame, revisions: DataFrame, newest: int = 20) -> DataFrame:
    """PRJ-02: list rows with the advert, the owner's application and the last revisions (field, before, after, changed_at), newest first. job_id is unique in jobs.

    The newest revision's row takes those behind it along, so that no job's revisions are gathered whole and none are sorted again.
    """
    change = F.struct("changed_at", "revision_id", "field", F.col("value_before").alias("before"), F.col("value_after").alias("after"))
    last = Window.partitionBy("job_id").orderBy(F.desc("changed_at"), F.desc("revision_id"))
    of_jobs = lineage.keyed(revisions, "job_id").join(jobs.select("job_id"), "job_id", "left_semi")
    few = of_jobs.select("job_id", F.row_number().over(last).alias("place"), F.collect_list(change).over(last.rowsBetween(0, newest - 1)).alias("revisions"))
    r = few.where("place = 1").select("job_id", F.sort_array("revisions", False).alias("revisions"))
    shown = _rows(jobs, "description_text", "reference", F.col("source_url").alias("apply_url"), "application_id", "application_status")
    return lineage.keyed(shown, "job_id").join(r, "job_id", "left").withColumn("revisions", F.coalesce("revisions", F.array().cast(r.schema["revisions"].dataType)))


#: Filters whose value may be a list with commas.
LISTED = ["institution", "category"]
# Filters from the one that hides most, as people are told which to drop.
RESTRICTIVENESS = [
    "q", "min_fitness", "salary_min", "threshold_verdict", "sponsor_verdict", "sponsorable", "closing_before", "posted_after", "institution", "category", "discipline", "city", "contract_type", "hours", "workplace", "nation",
    "status",
]


def parse_saved(query: str) -> dict:
    """JSN-03: a saved search's query string as filters: the first value of each key counts; unknown keys and unreadable numbers are left out."""
    out: dict = {}
    for key, values in parse_qs(query).items():
        value = values[0]
        if key in ("sponsorable", "saved"):
            if value.lower() in ("true", "false"):
                out[key] = value.lower() == "true"
        elif key in ("min_fitness", "salary_min", "salary_max"):
            try:
                out[key] = int(float(value))
            except (ValueError, OverflowError):
                continue
        elif key == "order":
            out[key] = [p for p in value.split(",") if p]
        elif key in SINGLE:
            out[key] = value
        elif key in DIMENSIONS:
            out[key] = [p for p in value.split(",") if p] if key in LISTED else [value]
    return out


def parse_filters(query: str) -> dict:
    """JSN-04: a page's query string as filters: all values of keys that take several, the first of others."""
    found = {k: [v for v in values if v] for k, values in parse_qs(query, keep_blank_values=True).items()}
    return {k: found[k] for k in DIMENSIONS if found.get(k)} | {k: found[k][0] for k in (*SINGLE, "page") if found.get(k)}


def query_string(params: dict) -> str:
    """JSN-04: filters as a query string; what parse_filters() gave comes back."""
    pairs = [(k, str(x).lower() if isinstance(x, bool) else x) for k, v in params.items() for x in (v if isinstance(v, list) else [v])]
    return urlencode(pairs)


def active_count(params: dict) -> int:
    """JSN-04: how many filters are set; order and page aren't filters."""
    return sum(1 for k, v in params.items() if k not in ("order", "page") and v not in (None, "", []))


def most_restrictive(params: dict) -> str | None:
    """JSN-04: the filter that hides most, None without one."""
    return next((k for k in RESTRICTIVENESS if params.get(k)), None)


def saved_params(query: Column) -> Column:
    """JSN-03 as data: a map of each key of a query string to its first value, decoded; keys without a value are left out."""
    parts = F.transform(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: F.struct(_decoded(F.regexp_extract(p, "^([^=]*)", 1)).alias("key"), _decoded(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("value")))
    parts = F.filter(parts, lambda p: (p["key"] != "") & (p["value"] != ""))
    first = lambda all_: F.filter(all_, lambda p, k: F.array_position(F.transform(all_, lambda x: x["key"]), p["key"]) == k + 1)
    return F.map_from_entries(F.flatten(F.transform(F.array(parts), first)))  # parts are bound, so that they are made once, not once for each part


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)
