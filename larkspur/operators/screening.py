"""Verdicts on vacancies: the register's word on the employer, the advert's on the post, the rule set's on the pay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import fitness, salary, text

# Verdicts under which an employer can sponsor.
SPONSORING = ["CONFIRMED", "B_RATED", "PROVISIONAL", "CONFIRMED_VIA_PARENT"]
# The figures that a rule set must carry.
FIGURES = [
    "transitional_general_threshold", "standard_general_threshold", "soc_2134_going_rate", "soc_2139_going_rate", "soc_2133_going_rate",
    "soc_2162_going_rate", "soc_3131_going_rate", "soc_3133_going_rate", "current_package", "personal_floor",
]


def advert_overrides(verdict: Column, excluded: Column) -> Column:
    """SCR-01: an advert that rules sponsorship out wins; one that is silent changes nothing."""
    return F.when(excluded, "NOT_FOUND").otherwise(F.coalesce(verdict, F.lit("NOT_FOUND")))


def thresholds(figures: DataFrame, going_rate_key: str = "soc_2134_going_rate") -> dict[str, Column]:
    """THR-04: what assess() needs of a rule set's figures (key, value), all ten of which must be there."""
    found = salary.ruleset_figures(figures, FIGURES)
    return {"personal_floor": found["personal_floor"], "current_package": found["current_package"], "going_rate": found[going_rate_key], "standard_general": found["standard_general_threshold"]}


def missing_figures(given: Column) -> Column:
    """SET-08: the keys that a rule set still lacks, in order."""
    return F.array_sort(F.array_except(F.array(*map(F.lit, FIGURES)), given))


def active_ruleset(rulesets: DataFrame) -> DataFrame:
    """LIM-04 and API-10: the newest active rule set, no row if there is none."""
    return rulesets.where("is_active").orderBy(F.desc("version")).limit(1)


def with_new_ruleset(rulesets: DataFrame, name: str, effective_from: str, activate: bool = True) -> DataFrame:
    """THR-05: all versions (version, name, effective_from, is_active) and the next; an active one puts the others out of force."""
    old = rulesets.select("version", "name", "effective_from", (F.col("is_active") & F.lit(not activate)).alias("is_active"))
    new = rulesets.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))
    return old.unionByName(new.select("version", F.lit(name).alias("name"), F.lit(effective_from).cast("date").alias("effective_from"), F.lit(activate).alias("is_active")))


def screened(jobs: DataFrame, matches: DataFrame, rules: dict[str, Column], going_rate_key: str = "soc_2134_going_rate") -> DataFrame:
    """SCR-02: a screening for each of jobs (job_id, institution_id, title, description_text, salary_raw, grade_raw).

    matches (institution_id, verdict, registered_legal_name, confidence) has a row an institution; none means NOT_FOUND.
    """
    m = matches.select("institution_id", F.col("verdict").alias("register_verdict"), "registered_legal_name", "confidence")
    advert = fitness.advert_text(F.col("title"), F.col("description_text"))
    j = jobs.select("job_id", "institution_id", "grade_raw", text.exclusion_sentence(advert).alias("phrase"), salary.parse_salary(F.col("salary_raw")).alias("s"))
    j = j.withColumn("a", salary.assess(F.col("s"), rules, going_rate_key)).join(m, "institution_id", "left")
    excluded = F.col("phrase").isNotNull()
    return j.select(
        "job_id", advert_overrides(F.col("register_verdict"), excluded).alias("sponsor_verdict"), F.coalesce("registered_legal_name", F.lit("")).alias("sponsor_matched_name"),
        F.coalesce("confidence", F.lit(0.0)).alias("sponsor_confidence"), excluded.alias("advert_excludes_sponsorship"), F.coalesce("phrase", F.lit("")).alias("advert_exclusion_phrase"),
        F.col("s.minimum").alias("salary_min"), F.col("s.maximum").alias("salary_max"), F.col("s.currency").alias("salary_currency"), F.col("s.period").alias("salary_period"), F.col("s.confidence").alias("salary_confidence"),
        F.col("a.verdict").alias("threshold_verdict"), F.col("a.explanation").alias("threshold_explanation"), "a.screened_on", "a.general_threshold_met", "a.going_rate_met", "a.going_rate_key",
        F.coalesce("s.grade", "grade_raw").alias("grade_raw"),
    )


def rescreen_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """SCR-03 and AGG-20: one row (screened, changed); a job that had no screening counts as changed."""
    verdicts = ["sponsor_verdict", "threshold_verdict"]
    old = before.select("job_id", F.struct(*verdicts).alias("was"))
    both = after.select("job_id", F.struct(*verdicts).alias("now")).join(old, "job_id", "left")
    return both.agg(F.count("*").alias("screened"), F.count_if(~F.col("now").eqNullSafe(F.col("was"))).alias("changed"))


def rescreen_targets(changed: DataFrame, new: DataFrame, unscreened: DataFrame) -> DataFrame:
    """SET-02: each job_id once."""
    return changed.select("job_id").union(new.select("job_id")).union(unscreened.select("job_id")).distinct()


def unscreened(jobs: DataFrame, screenings: DataFrame) -> DataFrame:
    """JOIN-08."""
    return jobs.join(screenings.select("job_id"), "job_id", "left_anti")


def with_screening(jobs: DataFrame, screenings: DataFrame, rulesets: DataFrame) -> DataFrame:
    """JOIN-02: jobs with their screening, if any, and the version of its rule set."""
    s = screenings.join(F.broadcast(rulesets.select(F.col("ruleset_id"), F.col("version").alias("ruleset_version"))) if _few(rulesets) else rulesets.select("ruleset_id", F.col("version").alias("ruleset_version")), "ruleset_id", "left")
    return jobs.join(s, "job_id", "left")


def _few(rows: DataFrame, most: int = 10_000) -> bool:
    """Whether a table is small enough to send to every executor; reads at most one row more."""
    return rows.select(F.lit(1)).limit(most + 1).count() <= most


def visible(jobs: DataFrame, screenings: DataFrame) -> DataFrame:
    """FLT-13: only screened jobs are shown."""
    return jobs.join(screenings.select("job_id"), "job_id", "left_semi")
