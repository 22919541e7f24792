"""Listing pages of known platforms, written by hand."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from larkspur.functions import nodes
from larkspur.operators import boards

TODAY = date(2024, 5, 10)


def listed(spark, platform, html, url="https://site.example/jobs/list?x=1", *columns):
    df = nodes.noded(spark.createDataFrame([(url, "uni", h) for h in ([html] if isinstance(html, str) else html)], "url string, slug string, html string"))
    rows = boards.listed(df, platform, TODAY).select(*columns) if columns else boards.listed(df, platform, TODAY)
    return sorted(tuple(r) for r in rows.collect())


def test_selectors(spark):
    html = """<div id=top class="a b"><p>one <b>two</b></p><ul><li class=x>3</li><li data-k='v w'>4<ul><li>5</li></ul></li></ul></div><script>var no = 1;</script><p style="font-size: 18px">six</p>"""
    df = nodes.noded(spark.createDataFrame([(html,)], "html string"))
    said = lambda selector: [r[0] for r in df.select(F.explode(F.transform(nodes.selected(F.col("nodes"), selector), lambda n: nodes.said(F.col("strings"), n)))).collect()]
    assert said("p") == ["one two", "six"] and said("div.a p, b") == ["one two", "two"] and said("div.a.c") == []
    assert said("ul > li") == ["3", "4 5", "5"] and said("div > ul > li") == ["3", "4 5"] and said("li li") == ["5"] and said("li[data-k~=w]") == ["4 5"] and said("li[data-k^=v]") == ["4 5"]
    assert said("#top") == ["one two 3 4 5"] and said("[style*=18px]") == ["six"] and said("li[class=x]") == ["3"] and said("script") == [""]
    with pytest.raises(ValueError):
        nodes.selected(F.col("nodes"), "p:first")


def test_stonefish_tables_by_their_headings(spark):
    html = """<h2>Arts  <i>Faculty</i></h2><table><tr><th>Job title</th><th>Ref no</th><th>Closing date</th><th>Salary range</th></tr>
     <tr><td><a href="vacancydetails.aspx?id=1">Lecturer in Art</a></td><td>A1</td><td>7 June 2024</td><td>£30,000</td></tr>
     <tr><td><a href="vacancydetails.aspx?id=1">Lecturer in Art again</a></td><td>A9</td><td></td><td></td></tr>
     <tr><td><a href="#">Lecturer nowhere</a></td><td>A2</td></tr><tr><td><a href="/x">Apply</a></td></tr><tr><td>No link here</td></tr></table>
     <h3>Science</h3><table><tr><td>Post</td><td>School</td></tr><tr><td><a href="/jobs/2">Technician</a></td><td>Chemistry</td></tr></table>
     <table><tr><th>News</th></tr><tr><td><a href="/news/1">Something else</a></td></tr></table>"""
    got = listed(spark, "STONEFISH", html, "https://site.example/jobs/vacancies.aspx?cat=-1", "source_url", "title", "department", "reference", "salary_raw", "location_raw", "closing_date", "institution_slug")
    assert got == [
        ("https://site.example/jobs/2", "Technician", "Chemistry", "", "", "Chemistry", None, "uni"),
        ("https://site.example/jobs/vacancydetails.aspx?id=1", "Lecturer in Art", "Arts Faculty", "A1", "£30,000", "", date(2024, 6, 7), "uni"),
    ]
    cards = """<div><a href="VacancyDetails.aspx?VacancyID=7"> Head  of Estates </a></div><a href="VacancyDetails.aspx?VacancyID=7">Head of Estates</a><a href="/about">About our site</a><a href="x?vacancyid=8">More</a>"""
    assert listed(spark, "STONEFISH", cards, "https://s.example/a/vacancies.aspx", "source_url", "title") == [("https://s.example/a/VacancyDetails.aspx?VacancyID=7", "Head of Estates")]
    at = spark.createDataFrame([("https://s.example/jobs/search.aspx?x=1#a",), ("https://s.example/jobs/",), ("https://s.example",)], "u string").select(boards.stonefish_listing(F.col("u"))).collect()
    assert [r[0] for r in at] == ["https://s.example/jobs/vacancies.aspx?cat=-1", "https://s.example/jobs/vacancies.aspx?cat=-1", "https://s.example/vacancies.aspx?cat=-1"]


def test_views_table_by_header_ids(spark):
    row = lambda t, rest="": f'<tr><td headers="x view-title-table-column">{t}</td><td headers="view-field-department-location-table-column">Law</td>{rest}</tr>'
    html = "<table><tr><th id='view-title-table-column'>Title</th></tr>" + row('<a href="/job/1">Reader in Law</a>', '<td headers="view-field-closing-date-table-column">01/07/2024</td><td headers="view-created-table-column">2024-05-04</td><td headers="view-field-category-table-column">Academic</td>')
    html += row("No link") + row('<a href="/job/2"> </a>') + "</table><table>" + row('<a href="/job/3">In a second table</a>') + "</table>"
    got = listed(spark, "CAMBRIDGE_VIEWS_TABLE", html, "https://c.example/jobs", "source_url", "title", "department", "category", "reference", "posted_date", "closing_date")
    assert got == [("https://c.example/job/1", "Reader in Law", "Law", "Academic", "", date(2024, 5, 4), date(2024, 7, 1))]


def test_four_templates_of_plain_pages(spark):
    cards = """<div class="job-card wide" data-org="Physics" data-family="Research" data-contract="Fixed"><a href="/v/1">Fellow</a><p class="profile-card__contact">Salary: £40,000<br>REF : P1<br/>Closing Date: 3 June 2024<br>Other: no</p></div><div class="job-card"><a href="/v/2"></a></div>"""
    results = """<div class="result"><h3 class="job-title">Cook</h3><p><span class="bold">Salary:</span> £20,000 a year</p><p><span class="bold">Closing  date:</span> 5 June 2024</p><a class="link-block" href="/jobs/cook-417/">See</a></div><h3 class="job-title">Outside</h3>"""
    table = """<table class="table wide"><tr><th>Title</th><th>Dept</th><th>Closes</th></tr><tr><td><a href="/t/1">Farm Hand</a></td><td>Farm</td><td>6 June 2024</td></tr><tr><td><a href="/t/2">Short row</a></td><td>x</td></tr></table>"""
    prose = """<div><p><span style="font-size: 18px"><strong>Tutor in Maths Ref: M/7</strong></span></p><p>Some words</p><p>The closing date is 8 June 2024.</p><hr/><p><span style="font-size:18px"><strong>Warden</strong></span></p><hr><p>Closing date 1 July 2024</p></div>"""
    got = listed(spark, "GENERIC_CARD_SCRAPE", [cards, results, table, prose, "", None], "https://g.example/jobs/", "source_url", "title", "department", "category", "reference", "salary_raw", "contract_raw", "closing_date")
    assert got == sorted([
        ("https://g.example/v/1", "Fellow", "Physics", "Research", "P1", "£40,000", "Fixed", date(2024, 6, 3)),
        ("https://g.example/jobs/cook-417/", "Cook", "", "", "417", "£20,000 a year", "", date(2024, 6, 5)),
        ("https://g.example/t/1", "Farm Hand", "Farm", "", "", "", "", date(2024, 6, 6)),
        ("https://g.example/jobs/", "Tutor in Maths", "", "", "M/7", "", "", date(2024, 6, 8)), ("https://g.example/jobs/", "Warden", "", "", "", "", "", None),
    ], key=lambda r: (r[0], r[1]))


def test_tables_under_their_headings(spark):
    html = """<h2>Academic</h2><p>x</p><table><tr><th>Title</th><th>Ref</th><th>Date</th><th>Time</th></tr><tr><td><a href="a1">Professor</a></td><td>R1</td><td>9 June 2024</td><td>noon</td></tr><tr><td><a href="a2">Three cells</a></td><td>1</td><td>2</td></tr></table><h2>Support</h2>"""
    got = listed(spark, "LIVERPOOL_HOPE_VACANCY_TABLES", html, "https://h.example/v/", "source_url", "title", "category", "reference", "closing_date", "closing_time")
    assert got == [("https://h.example/v/a1", "Professor", "Academic", "R1", date(2024, 6, 9), "noon")]


def test_cards_of_pages_that_go_on(spark):
    rails = """<ul class="results-list"><li class="job-result-item"><div class="job-title"><a href="/jobs/porter-92">Porter</a></div><ul><li class="results-job-location">Leeds</li><li class="results-salary">£19k</li></ul><p class="job-description">Carry  things</p></li><li class="job-result-item"><div class="job-title">No link</div></li></ul>"""
    assert listed(spark, "RAILS_JOBS_BOARD", rails, "https://r.example/", "source_url", "title", "reference", "location_raw", "salary_raw", "description_text") == [("https://r.example/jobs/porter-92", "Porter", "92", "Leeds", "£19k", "Carry things")]
    taleo = """<ul id="jobList"><li id="job1"><div class="multiline-data-container"><div><span><a href="jobdetail.ftl?x=1&amp;job=31">Nurse</a></span></div><div><span>Health</span><span>mid</span><span>£33k</span></div></div></li><li><div class="multiline-data-container"><div><a href="j?job=32">Clerk</a></div><div><span>Office</span></div></div></li></ul>"""
    got = listed(spark, "TALEO", taleo, "https://t.example/c/", "source_url", "title", "reference", "department", "salary_raw")
    assert got == [("https://t.example/c/j?job=32", "Clerk", "32", "Office", ""), ("https://t.example/c/jobdetail.ftl?x=1&job=31", "Nurse", "31", "Health", "£33k")]
    stat = lambda k, v: f'<div class="course-teaser-key-stat"><span class="course-teaser-key-stat-label">{k}</span><span class="course-teaser-key-stat-content">{v}</span></div>'
    card = f"""<section class="search-result"><div class="search-result-heading"><span class="h5"><a href="/redirect?u=1" title="/jobs/j-55/">Baker</a></span></div>{stat("Salary", "£21k")}{stat("Closing Date", "1 July 2024")}{stat("Post type", "Part time")}</section>"""
    assert listed(spark, "FUNNELBACK", card, "https://f.example/s", "source_url", "title", "reference", "salary_raw", "hours_raw", "closing_date") == [("https://f.example/jobs/j-55/", "Baker", "j-55", "£21k", "Part time", date(2024, 7, 1))]
