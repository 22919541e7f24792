"""Files in and out: registers, seeds and captured bodies; exports, sites and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text

# The export's columns and their labels, in order.
EXPORT = {
    "title": "Title", "institution": "Institution", "nation": "Nation", "department": "Department", "location": "Location", "salary_raw": "Salary (as advertised)", "salary_min": "Salary floor",
    "salary_max": "Salary ceiling", "grade": "Grade", "contract_raw": "Contract (as advertised)", "hours_raw": "Hours (as advertised)", "sponsor_verdict": "Sponsor verdict",
    "sponsor_matched_name": "Registered legal name", "advert_excludes_sponsorship": "Advert excludes sponsorship", "threshold_verdict": "Threshold verdict", "fitness_score": "Fitness",
    "contract_type": "Contract", "hours": "Hours", "workplace": "Workplace", "posted_date": "Posted", "closing_date": "Closing", "status": "Status", "source_url": "URL",
}
# Verdicts as people read them.
VERDICTS = {
    "CONFIRMED": "Confirmed sponsor", "B_RATED": "B-rated sponsor", "PROVISIONAL": "Provisional sponsor", "CONFIRMED_VIA_PARENT": "Confirmed via parent entity",
    "OTHER_ROUTE_ONLY": "Licensed, but not for Skilled Worker", "NOT_FOUND": "Not found on the register", "EXCLUDED_BELOW_FLOOR": "Below personal floor", "PAY_CUT": "Pay cut",
    "LATERAL_CONTINGENT": "Lateral, contingent", "TARGET_BAND": "Target band", "SALARY_UNCLEAR": "Salary unclear",
}
#: Columns that a person edits and a seed file never touches.
SEEDED = ["name", "nation", "city", "institution_type", "ranking", "careers_url", "notes"]


def register_rows(raw: DataFrame) -> DataFrame:
    """SRC-02: either spelling of each heading; rows without a name go."""
    headings = [(c, c.lstrip("\ufeff").strip().lower().replace("_", " ")) for c in raw.columns]

    def column(*spellings: str) -> Column:
        found = [F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c, heading in headings if heading in spellings]
        return F.coalesce(*found, F.lit("")) if found else F.lit("")

    kept = {"organisation_name": ("organisation name",), "town_city": ("town/city", "town city"), "county": ("county",), "type_rating": ("type & rating", "type rating"), "route": ("route",)}
    rows = raw.select(*[column(*spellings).alias(c) for c, spellings in kept.items()])
    return rows.where("organisation_name <> ''").withColumn("normalised_name", text.normalise_name(F.col("organisation_name")))


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01 and 02: a register's CSV with or without a byte order mark."""
    return register_rows(spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, escape='"'))


def register_summary(register: DataFrame) -> DataFrame:
    """SRC-02: one row (row_count, digest). The digest is a sum over names, so it needs no order and no single task."""
    value = F.conv(F.substring(F.sha2("organisation_name", 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return register.agg(F.count("*").alias("row_count"), F.coalesce(F.sum(value), F.lit(0)).cast("string").alias("digest"))


def seeded(institutions: DataFrame, seeds: DataFrame) -> DataFrame:
    """SRC-03: (slug, state) of each seed: created, updated or unchanged by its own columns; what people edit isn't looked at."""
    given = seeds.select("slug", F.struct(*SEEDED).alias("given"))
    known = institutions.select("slug", F.struct(*SEEDED).alias("known"))
    both = given.join(known, "slug", "left")
    return both.select("slug", F.when(F.col("known").isNull(), "created").when(F.col("known").eqNullSafe(F.col("given")), "unchanged").otherwise("updated").alias("state"))


def seed_institutions(institutions: DataFrame, seeds: DataFrame) -> DataFrame:
    """SRC-03: institutions after a seed file: its columns replaced where it has a row, new rows with defaults for what people edit."""
    s = seeds.select("slug", *[F.col(c).alias(f"s_{c}") for c in SEEDED], F.lit(True).alias("given"))
    both = institutions.join(s, "slug", "full_outer")
    changed = {c: F.when(F.col("given"), F.col(f"s_{c}")).otherwise(F.col(c)) for c in SEEDED}
    return both.withColumns(changed | {"crawl_enabled": F.coalesce("crawl_enabled", F.lit(True)), "platform": F.coalesce("platform", F.lit("UNKNOWN"))}).select(*institutions.columns)


def ruleset_seed(spark: SparkSession, path: str, rulesets: DataFrame) -> DataFrame:
    """SRC-05: the figures (key, value) of a rule set's JSON, none if any rule set is there already."""
    raw = spark.read.json(path, multiLine=True)
    figures = raw.select(F.explode(F.from_json(F.to_json("figures"), "map<string,string>")).alias("key", "value")).select("key", F.col("value").cast("decimal(12,2)").alias("value"))
    return figures.where(F.lit(rulesets.isEmpty()))


def skill_seed(vocabulary: DataFrame, seeds: DataFrame) -> DataFrame:
    """SRC-06: the vocabulary after a seed file; a term that is there takes the file's kind and spellings and keeps whether it is active."""
    s = seeds.select("canonical", F.col("kind").alias("s_kind"), F.coalesce("aliases", F.array().cast("array<string>")).alias("s_aliases"))
    both = vocabulary.join(s, "canonical", "full_outer")
    return both.select("canonical", F.coalesce("s_kind", "kind").alias("kind"), F.coalesce("s_aliases", "aliases").alias("aliases"), F.coalesce("is_active", F.lit(True)).alias("is_active"))


def demo_jobs(seeds: DataFrame, institutions: DataFrame, today: Column) -> DataFrame:
    """SRC-07: demonstration vacancies with dates around today; a seed of an unknown institution is an error."""
    j = seeds.join(institutions.select(F.col("slug").alias("institution_slug"), "institution_id"), "institution_slug", "left")
    known = F.when(F.col("institution_id").isNull(), F.raise_error(F.concat(F.lit("unknown institution "), F.col("institution_slug"))).cast("long")).otherwise(F.col("institution_id"))
    dates = {"posted_date": F.date_sub(today, F.col("posted_days_ago").cast("int")), "closing_date": F.date_add(today, F.col("closes_in_days").cast("int"))}
    return j.withColumns({"institution_id": known, "status": F.lit("OPEN")} | dates).drop("posted_days_ago", "closes_in_days")


def store_bodies(pages: DataFrame) -> DataFrame:
    """SRC-08 and STR-25: one row for each cache key of (url, html)."""
    key = F.concat_ws("-", F.substring(F.sha2("url", 256), 1, 16), F.sha2("html", 256))
    return pages.withColumn("cache_key", key).dropDuplicates(["cache_key"])


def labelled(value: Column, labels: dict[str, str]) -> Column:
    """API-14: a value's label, or the value where it has none."""
    out = F
    for v, label in labels.items():
        out = out.when(value == v, label)
    return out.otherwise(value)


def export_rows(jobs: DataFrame) -> DataFrame:
    """SNK-03: search.with_owner()'s jobs as an export shows them, all text."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    special = {
        "institution": said("name"), "location": F.coalesce(F.nullif(said("location_raw"), F.lit("")), said("city")), "grade": said("grade_raw"),
        "advert_excludes_sponsorship": F.when(F.coalesce("advert_excludes_sponsorship", F.lit(False)), "yes").otherwise("no"),
        "fitness_score": F.when(F.coalesce("fitness_score", F.lit(0)) == 0, "").otherwise(said("fitness_score")),
    }
    return jobs.select(*[special.get(c, said(c) if c not in special else None).alias(c) for c in EXPORT])


def export_csv(jobs: DataFrame, path: str) -> None:
    """SNK-01: exactly the filtered result, under its labels."""
    export_rows(jobs).select(*[F.col(c).alias(label) for c, label in EXPORT.items()]).write.csv(path, header=True, mode="overwrite", escape='"')


def site_rows(jobs: DataFrame) -> DataFrame:
    """API-15 and SNK-04: open screened jobs as a static site shows them."""
    shown = jobs.where("status = 'OPEN' AND sponsor_verdict IS NOT NULL")
    return shown.select(
        "job_id", "title", F.col("name").alias("institution"), "institution_id", "city", F.col("salary_raw").alias("salary"), F.coalesce(F.col("closing_date").cast("string"), F.lit("")).alias("closing_date"), "discipline",
        labelled(F.col("sponsor_verdict"), VERDICTS).alias("sponsor_verdict"), labelled(F.col("threshold_verdict"), VERDICTS).alias("threshold_verdict"), F.col("source_url").alias("url"),
    )


def site_counts(rows: DataFrame) -> DataFrame:
    """AGG-22: vacancies of each institution, by name."""
    return rows.groupBy("institution_id", "institution").agg(F.count("*").alias("count")).orderBy("institution", "institution_id")


def export_site(jobs: DataFrame, path: str) -> None:
    """SNK-04: JSON by institution, in order within it, and all of it as CSV."""
    rows = site_rows(jobs)
    rows.repartition("institution_id").sortWithinPartitions("institution_id", "closing_date", "title", "job_id").write.partitionBy("institution_id").json(f"{path}/institutions", mode="overwrite")
    rows.sort("institution", "closing_date", "title", "job_id").write.csv(f"{path}/jobs", header=True, mode="overwrite", escape='"')


def append(rows: DataFrame, path: str, *by: str) -> None:
    """SNK-07 and SNK-09: rows added to a table that only grows."""
    rows.write.partitionBy(*by).parquet(path, mode="append")


def replace_days(rollup: DataFrame, path: str) -> None:
    """RET-04: rewrites the days present in rollup and no other."""
    rollup.repartition("day").write.option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path, mode="overwrite")


def last_days(events: DataFrame, today: Column, days: int = 2) -> DataFrame:
    """RET-04: the events whose days a nightly rollup rebuilds."""
    return events.where((F.col("day") > F.date_sub(today, days)) & (F.col("day") <= today))


