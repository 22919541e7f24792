"""Answers of recruitment systems, written by hand."""

import json
from datetime import date

from pyspark.sql import functions as F

from larkspur.operators import json_boards as boards


def listed(spark, platform, bodies, *columns):
    rows = [("https://x.wd3.example.com/en-US/Jobs?a=1", "uni", b if b is None or isinstance(b, str) else json.dumps(b)) for b in bodies]
    df = boards.listed(spark.createDataFrame(rows, "url string, slug string, body string"), platform)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    return [tuple(r) for r in df.select(*columns).collect()]


def test_workday(spark):
    body = {"total": 3, "jobPostings": [
        {"title": " Lecturer ", "externalPath": "/job/Bath/L_1", "bulletFields": ["R1", "x"], "locationsText": "Bath", "postedOn": "2024-05-04", "jobDescription": "<p>Hi</p>"},
        {"title": "Porter", "externalPath": "job/2", "bulletFields": [], "postedOn": "Posted 3 Days Ago"}, {"title": "", "externalPath": "/x"}, {"title": "No path"}, {"title": "Cook", "externalPath": "https://o.example/3", "postedOn": "Posted 4th May 2024"},
    ]}
    got = listed(spark, "WORKDAY", [body, "not json", "[1]", None, {"jobPostings": None}, {}], "source_url", "title", "reference", "location_raw", "posted_date", "posted_raw", "description_html")
    assert got == [
        ("https://x.wd3.example.com/job/Bath/L_1", "Lecturer", "R1", "Bath", date(2024, 5, 4), "2024-05-04", "<p>Hi</p>"), ("https://x.wd3.example.com/en-US/job/2", "Porter", "", "", None, "Posted 3 Days Ago", ""),
        ("https://o.example/3", "Cook", "", "", date(2024, 5, 4), "Posted 4th May 2024", ""),
    ]
    urls = ["https://x.wd3.example.com/en-US/Jobs", "https://y.wd3.example.com/Site/en-GB/?q=1", "https://z.example.com/en-US"]
    assert [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(boards.workday_api(F.col("u"))).collect()] == ["https://x.wd3.example.com/wday/cxs/x/Jobs/jobs", "https://y.wd3.example.com/wday/cxs/y/Site/jobs", None]


def test_itrent(spark):
    item = {"job_title": "Clerk", "vacancy_id": 7, "region_id": "HR", "vacancy_ref": "V7", "location_id": "Leeds", "salary": "£20k", "app_close_d": "20240607", "basis_id": "Fixed", "con_hrs": 35}
    body = {"search": {"total_rec": "2"}, "results": [item, item | {"vacancy_id": "8", "app_close_d": "20241340", "con_hrs": None}]}
    got = listed(spark, "ITRENT", [body, {"search": {"total_rec": 3}, "results": [item]}, {"results": [item | {"vacancy_id": ""}]}], "source_url", "title", "department", "reference", "hours_raw", "closing_date", "closing_raw")
    base = "https://x.wd3.example.com/en-US/Jobs?a=1&VACANCY_ID="
    assert got == [(base + "7", "Clerk", "HR", "V7", "35", date(2024, 6, 7), "20240607"), (base + "8", "Clerk", "HR", "V7", "", None, "20241340")]
    errors = spark.createDataFrame([(json.dumps(body),), ('{"search": {"total_rec": 3}, "results": []}',), ("<html>",), ("{}",)], "b string").select(boards.listing_error("ITRENT", F.col("b")))
    assert [r[0] for r in errors.collect()] == [None, "ParseError", "ParseError", None]


def test_hireserve_takes_the_first_classification_with_a_value(spark):
    kinds = {"9": {"name": "Salary Scale", "values": [{"class_val": " "}]}, "1": {"name": "SALARY from", "values": [{"class_val": "£1"}, {"class_val": ""}, {"class_val": "£2"}]}, "0": {"name": "Salary", "values": [{"class_val": "later"}]}, "5": {"name": "School / Faculty", "values": [{"class_val": "Law"}]}, "6": {"name": None, "values": None}}
    body = {"jobs": [{"id": 3, "title": "Dean", "weblink": "https://h.example/3", "refno": 12, "publication": {"internet": {"closing_date": "2024-06-07 23:59:00"}}, "classifications": kinds}, {"title": "x", "weblink": "https://h.example/4", "classifications": []}]}
    got = listed(spark, "HIRESERVE", [body], "source_url", "title", "reference", "salary_raw", "department", "location_raw", "closing_date", "vacancy_id")
    assert got == [("https://h.example/3", "Dean", "12", "£1, £2", "Law", "", date(2024, 6, 7), "3"), ("https://h.example/4", "x", "", "", "", "", None, "")]


def test_oracle_lists_and_details(spark):
    site = spark.createDataFrame([("https://e.example/hcmUI/CandidateExperience/en/sites/CX_1/jobs?x=1", '<div data-apiBaseUrl="https://api.example/">'), ("https://e.example/sites/CX_2", ""), ("https://e.example/x", "")], "u string, h string")
    assert [r[0] and tuple(r[0]) for r in site.select(boards.oracle_site(F.col("u"), F.col("h"))).collect()] == [("https://api.example", "CX_1"), ("https://e.example", "CX_2"), None]
    page = lambda *ids: json.dumps({"items": [{"TotalJobsCount": 9, "requisitionList": [{"Id": i} for i in ids]}]})
    lists = spark.createDataFrame([("u", "https://api.example", "CX_1", page("1", 2, "", None)), ("u", "https://api.example", "CX_1", page(2, "3")), ("u", "https://api.example", "CX_1", '{"items": []}'), ("u", "https://api.example", "CX_1", "no")], "slug string, base string, site string, body string")
    wanted = boards.requisitions(lists)
    assert sorted(r.id for r in wanted.collect()) == ["1", "2", "3"]
    text = "<p><strong>Location:</strong> Bath</p><p><b>Grade and <i>Salary</i>: </b>Grade 7 : £30,000</p><p><b>Salary</b></p>"
    detail = lambda **k: json.dumps({"items": [{"Title": " Nurse ", "JobFunction": "Health", "PrimaryLocation": "Leeds", "ExternalPostedStartDate": "2024-05-04T10:00:00+00:00", "ExternalPostedEndDate": None, "ExternalDescriptionStr": text} | k]})
    details = spark.createDataFrame([("https://api.example", "CX_1", "1", detail()), ("https://api.example", "CX_1", "2", detail(Title="Cook", ExternalDescriptionStr="")), ("https://api.example", "CX_1", "3", "{}")], "base string, site string, id string, body string")
    out = boards.oracle_vacancies(wanted, details)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted(tuple(r) for r in out.select("source_url", "title", "department", "reference", "salary_raw", "posted_date", "closing_date").collect())
    url = "https://api.example/hcmUI/CandidateExperience/en/sites/CX_1/job/"
    assert got == [(url + "1", "Nurse", "Health", "1", "Grade 7 : £30,000", date(2024, 5, 4), None), (url + "2", "Cook", "Health", "2", "", date(2024, 5, 4), None)]
    assert sorted(r.description_text for r in boards.with_text(out).collect())[0] == ""
