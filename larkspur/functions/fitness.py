"""How well an advert fits one candidate's profile: six weighted criteria, each with what matched and what is missing."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import classify

# The criteria's weights, in the order in which they are reported.
WEIGHTS = {"skills": 3, "domains": 2, "seniority": 2, "years": 2, "projects": 1, "education": 1}
LISTS = [c for c in WEIGHTS if c != "years"]


@dataclass
class Criteria:
    """One person's profile, flattened."""

    skills: list[str] = field(default_factory=list)
    domains: list[str] = field(default_factory=list)
    seniority: list[str] = field(default_factory=list)
    projects: list[str] = field(default_factory=list)
    education: list[str] = field(default_factory=list)
    years_experience: int = 0

    def fingerprint(self) -> str:
        """STR-24: of what a score is computed from."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


def active_criteria(profiles: DataFrame, owner: int) -> Criteria | None:
    """FIT-06: of the owner's active profile, None where there is none. One row of one person comes to the driver."""
    row = profiles.where((F.col("owner") == owner) & F.col("is_active")).orderBy("profile_id").first()
    return row and Criteria(*[list(row[c] or []) for c in LISTS], row["years_experience"] or 0)


def _result(name: str, fraction: Column, matched: Column, missing: Column, note: Column) -> Column:
    parts = {"criterion": F.lit(name), "weight": F.lit(WEIGHTS[name]), "fraction": fraction.cast("double"), "matched": matched, "missing": missing, "note": note}
    return F.struct(*[c.alias(n) for n, c in parts.items()])


def _some(pairs: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(test, F.lit(term)) for test, term in pairs])) if pairs else F.array().cast("array<string>")


def term_result(name: str, terms: list[str], tests: list[Column]) -> Column:
    """FIT-01: the share of a list's terms that stand in the advert as whole words, by a test of each."""
    there = list(zip(tests, terms))
    matched = _some(there)
    fraction = F.size(matched) / len(terms) if terms else F.lit(0.0)
    return _result(name, fraction, matched, _some([(~test, t) for test, t in there]), F.lit("" if terms else "No terms configured on the candidate profile."))


def years_result(held: int, advert: Column) -> Column:
    """FIT-03: all or nothing; all where the advert asks for none."""
    return _asked_result(held, classify.required_years(advert))


def _asked_result(held: int, asked: Column) -> Column:
    short, none = F.coalesce(asked > held, F.lit(False)), F.array().cast("array<string>")
    missing = F.when(short, F.array(F.concat(asked.cast("string"), F.lit(" years experience")))).otherwise(none)
    said = F.concat(F.lit("Advert asks for "), asked.cast("string"), F.lit(f" years; profile has {held}."))
    return _result("years", F.when(short, 0.0).otherwise(1.0), none, missing, F.coalesce(said, F.lit("Advert states no minimum years of experience.")))


def advert_text(title: Column, description: Column) -> Column:
    return F.array_join(F.filter(F.array(F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))), lambda t: t != ""), ". ")


def score(jobs: DataFrame, criteria: Criteria) -> DataFrame:
    """FIT-04: (job_id, score, reasons) of jobs (job_id, title, description_text); the score is rounded half to even."""
    j = jobs.select("job_id", advert_text(F.col("title"), F.col("description_text")).alias("advert"))
    # a result names its tests several times: they are columns before, so that an advert is searched once for each term
    tests = {c: [f"{c}_{k}" for k in range(len(getattr(criteria, c)))] for c in LISTS}
    each = [classify.term_present(F.lit(t), F.col("advert")).alias(n) for c in LISTS for t, n in zip(getattr(criteria, c), tests[c])]
    j = j.select("job_id", classify.required_years(F.col("advert")).alias("asked"), *each)
    results = [_asked_result(criteria.years_experience, F.col("asked")) if c == "years" else term_result(c, getattr(criteria, c), [F.col(n) for n in tests[c]]) for c in WEIGHTS]
    earned = F.aggregate("reasons", F.lit(0.0), lambda total, r: total + r["weight"] * r["fraction"])
    return j.select("job_id", F.array(*results).alias("reasons")).select("job_id", F.bround(100 * earned / sum(WEIGHTS.values()), 0).cast("int").alias("score"), "reasons")


def rescore(jobs: DataFrame, profiles: DataFrame, existing: DataFrame, owner: int, force: bool = False) -> DataFrame:
    """FIT-05 and JOIN-18: the owner's scores (owner, job_id, score, criteria_hash, changed) after a run over jobs.

    A score whose fingerprint is the profile's stays as it is unless forced; an owner without a profile has none left.
    """
    criteria, mine = active_criteria(profiles, owner), existing.where(F.col("owner") == owner)
    columns = ["owner", "job_id", "score", "criteria_hash"]
    if criteria is None:
        return mine.where("false").select(*columns, F.lit(False).alias("changed"))
    print_ = criteria.fingerprint()
    kept = mine.where(F.lit(not force) & (F.col("criteria_hash") == print_)).join(jobs, "job_id", "left_semi")
    fresh = score(jobs.join(kept, "job_id", "left_anti"), criteria).select(F.lit(owner).cast("long").alias("owner"), "job_id", "score", F.lit(print_).alias("criteria_hash"))
    return fresh.withColumn("changed", F.lit(True)).unionByName(kept.select(*columns).withColumn("changed", F.lit(False)))
