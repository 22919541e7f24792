"""Searches through the stored index give the rows of the ladder over whole texts."""

import random

import pytest

from larkspur.operators import search, text_index

WORDS = "software engineer engineers Softwarehouse head of the estates physics Django it's c++ Straße ΣΟΦΟΣ ﬁnance a ab _ 日本語 running 𝒳y don't".split()
QUERIES = [
    "software", " Engineers software ", '"head of estate"', '"head of the estates" or physics -django', "-physics", "physics -software -django", "of the", "or", "ware", "re en", "a", "ab", "_", "x", "c++", '"software engineer" or -head', "strasse", "straße",
    "σοφος", "ﬁn", "日本", "日本語", "𝒳", "run", '"of"', '"engineer of physics"', "zebra", "it's", '"physics', "", "  ", "ngin", "University No",
]
JOB = "job_id long, title string, department string, name string, description_text string"


@pytest.fixture(scope="module")
def jobs(spark):
    r = random.Random(7)
    text = lambda n: r.choice([None, "", *[" ".join(r.choice(WORDS) for _ in range(r.randint(1, n))) for _ in range(6)]])
    rows = [(k, text(4), text(3), r.choice(["University No 1", "Ab", "a", None]), text(30)) for k in range(400)]
    rows += [(900, None, None, None, None), (901, "", "", "", ""), (902, "software engineer", "", "", "head of estates " * 20_000), (903, "Head", "of", "estates", "x")]
    return spark.createDataFrame(rows, JOB).repartition(5).cache()


@pytest.fixture(scope="module")
def index(jobs, tmp_path_factory):
    return text_index.build(jobs, str(tmp_path_factory.mktemp("index")), buckets=16, spread=3)


@pytest.mark.parametrize("query", QUERIES)
def test_same_as_ladder(jobs, index, query):
    want = {(r.job_id, r.relevance) for r in search.searched(search.with_vectors(jobs), query).select("job_id", "relevance").collect()}
    got = [(r.job_id, r.relevance) for r in text_index.searched(jobs, index, query).select("job_id", "relevance").collect()]
    assert set(got) == want and len(got) == len(want)


def test_random_queries(spark, jobs, index):
    r = random.Random(8)
    vectors = search.with_vectors(jobs).cache()
    for _ in range(15):
        parts = []
        for _ in range(r.randint(1, 3)):
            phrase = " ".join(r.choice(WORDS) for _ in range(r.randint(1, 3)))
            parts.append(r.choice(["", "-", "or "]) + r.choice([phrase, f'"{phrase}"', phrase[1:5]]))
        query = " ".join(parts)
        want = {(x.job_id, x.relevance) for x in search.searched(vectors, query).select("job_id", "relevance").collect()}
        assert {(x.job_id, x.relevance) for x in text_index.found(spark, index, query).collect()} == want, query


def test_plan_reads_buckets_of_the_terms(spark, index):
    df = text_index.found(spark, index, '"software engineer"')
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "In(key" in plan and "Python" not in plan and "Arrow" not in plan and "description" not in plan


def test_no_jobs(spark, tmp_path):
    empty = text_index.build(spark.createDataFrame([], JOB), str(tmp_path), buckets=4)
    assert text_index.found(spark, empty, "software").count() == 0 and text_index.found(spark, empty, "-software").count() == 0


def test_jobs_that_have_a_key_at_the_same_places_share_a_posting(spark, tmp_path):
    rows = [(k, "Head of Estates", "Estates", "University No 1", "Apply now.") for k in range(300)]
    text_index.build(spark.createDataFrame(rows, JOB).coalesce(1), str(tmp_path), buckets=4)
    stored = spark.read.parquet(f"{tmp_path}/postings")
    assert stored.selectExpr("max(size(postings))").first()[0] == 1 and stored.where("key = 'hea'").selectExpr("sum(size(postings[0].jobs))").first()[0] == 300


def test_job_ids_far_apart_and_below_zero(spark, tmp_path):
    ids = [-(2**63), -32769, -32768, -1, 0, 32767, 32768, 2**40 + 1, 2**63 - 1]
    jobs = spark.createDataFrame([(k, "Head of Estates" if k % 2 else "Dean", "", "", "physics " * (n + 1)) for n, k in enumerate(ids)], JOB)
    built = text_index.build(jobs, str(tmp_path), buckets=4)
    assert sorted(r.job_id for r in text_index.found(spark, built, "physics").collect()) == ids
    assert sorted(r.job_id for r in text_index.found(spark, built, "estates").collect()) == [k for k in ids if k % 2]
