"""Every query by name, with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import salary
from larkspur.operators import search
from larkspur.plans import boards, dashboards, digests, lifecycle, linkage, pages, parts, searching, verdicts  # noqa: F401  registers their queries
from larkspur.plans.registry import ORACLES, QUERIES, query
from larkspur.sources.tables import INSTITUTION, JOB, frame

_SEEN = {"status": ["OPEN"], "sponsorable": True}


def flagship_page(jobs: DataFrame, institutions: DataFrame) -> DataFrame:
    """First page of open vacancies that can be sponsored, best fitness first, with their institutions and verdicts.

    The page is cut before institutions are joined and salaries read, so those touch its rows alone.
    """
    first = search.page(search.ordered(search.filtered(jobs, _SEEN), ["-fitness", "-posted"]), 1)
    found = first.drop("name", "nation").join(institutions.select("institution_id", "name", "nation"), "institution_id")
    read = found.withColumn("a", salary.assess(salary.parse_salary(F.col("salary_raw")), verdicts.rules()))
    return read.select("job_id", "title", "name", "nation", "fitness_score", "posted_date", "a.verdict", "a.explanation")


query("flagship_search_page", "job institution", f"""SELECT p.job_id, p.title, i.name, i.nation, p.fitness_score, p.posted_date, a.verdict, a.explanation FROM (SELECT * FROM job WHERE status = 'OPEN' AND {searching._SPONSORING}
 ORDER BY fitness_score DESC NULLS FIRST, posted_date DESC NULLS FIRST, job_id LIMIT 25) p JOIN institution i USING (institution_id) JOIN assessed a ON a.job_id = p.job_id""", flagship_page, verdicts._PARSED, verdicts._BANDS)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship_page(frame(spark, sf_dir, JOB), frame(spark, sf_dir, INSTITUTION))


__all__ = ["ORACLES", "QUERIES", "flagship"]
