"""What keeps work in proportion: rows are dealt to tasks, nodes stay where they are, like searches are asked once."""

import hashlib
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from larkspur.operators import digests, frontier, profiles, records, search
from larkspur.plans import boards, catalog, pages
from larkspur.sources import office, tables

DIR = "/root/testdata/sf0.001"


def view(spark, name):
    return tables.frame(spark, DIR, tables.VIEWS.get(name, f"SELECT * FROM {{{name}}}"))


def exchanged(df):
    """What each shuffle of a plan takes in."""
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", text)


def test_rows_of_a_small_file_are_dealt(spark):
    i, j, c = view(spark, "institution"), view(spark, "job"), view(spark, "customer")
    for df in (boards._pages(i, boards._STONEFISH), boards._chain(i, boards._RAILS), boards._answers(j, boards._ITRENT), pages._postings(j), pages._cvs(c)):
        assert df.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["ext_05_postings", "ext_11_feeds", "ext_12_labelled_details"])
def test_pages_and_feeds_are_read_once_after_they_are_dealt(spark, name):
    plan = catalog.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    dealt = plan.index("Exchange RoundRobinPartitioning")
    assert "ArrowEvalPython" in plan[:dealt] and "ArrowEvalPython" not in plan[dealt:]


@pytest.mark.parametrize("html, platform", [(boards._RAILS, "RAILS_JOBS_BOARD"), (boards._TALEO, "TALEO"), (boards._FUNNELBACK, "FUNNELBACK")])
def test_nodes_are_never_shuffled(spark, html, platform):
    i = view(spark, "institution")
    into = exchanged(frontier.walked(boards._chain(i, html), boards._starts(i), platform, date(2024, 5, 10)))
    assert into and not [x for x in into if "nodes#" in x or "strings#" in x]


def test_numbered_pages_are_read_before_their_links_meet(spark):
    found = catalog.QUERIES["adp_11_details_of_numbered_pages"](spark, DIR)
    assert not [x for x in exchanged(found) if "nodes#" in x]
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()  # a page is flattened once, for links of both kinds


def test_like_searches_are_asked_once(spark):
    rows = [(k, k % 3, "q=a&order=title" if k % 2 else "order=title&q=a", date(2024, 1, 1 + k)) for k in range(20)]
    s = digests.asked(spark.createDataFrame(rows, "search_id long, owner long, query string, last_run date"), date(2024, 5, 1))
    assert s.select("ask").distinct().count() == 1 and s.select("since").distinct().count() == 20
    jobs = view(spark, "job").drop("fitness_score", "is_saved")
    days = [date(1999, 12, 1), date(2000, 1, 1), date(2000, 3, 1), None]
    asks = spark.createDataFrame([(k, 0, "status=OPEN&order=-salary", d) for k, d in enumerate(days)], "search_id long, owner long, query string, last_run date")
    got = digests.new_matches(jobs, asks, view(spark, "saved").select("owner", "job_id"), view(spark, "scored"), date(2000, 4, 1)).collect()
    for k, d in enumerate(days):
        new = jobs.where((F.col("status") == "OPEN") & (F.col("first_seen") >= F.lit(d or date(2000, 3, 31)))).orderBy(F.desc_nulls_first("salary_min"), "job_id").limit(20).collect()
        assert [r.job_id for r in sorted(got, key=lambda r: r.place) if r.search_id == k] == [r.job_id for r in new]
    assert got


def test_references_in_titles_stay_as_the_sql_has_them(spark):
    html = ["<h1>A&amp;B &quot;c&quot; and&amp</h1>", "<main><h2> x &lt;y&gt; </h2></main>"]
    df = spark.createDataFrame(list(enumerate(html)), "page_id int, html string")
    assert [r.title for r in pages._titles(df).orderBy("page_id").collect()] == ["A&B &quot;c&quot; and&amp", "x &lt;y&gt;"]


def test_an_export_of_many_workbooks_has_one_head(spark, monkeypatch):
    export = boards.office.export_xlsx
    monkeypatch.setattr(boards.office, "export_xlsx", lambda rows, path, *order: export(rows, path, *order, most=200))
    kinds = {r.kind: r["count"] for r in catalog.QUERIES["snk_02_workbook"](spark, DIR).groupBy("kind").count().collect()}
    assert kinds == {"head": 1, "row": view(spark, "job").count()}


def test_a_cv_is_read_once_however_many_items_it_declares(spark):
    df = spark.createDataFrame([(1, "Skills\nA, b; a\nTools: B (C), d\n" + ", ".join(f"s{k % 300}" for k in range(1000)))], "cv_id int, text string")
    got = df.select(profiles.declared_skills(F.col("text")).alias("s"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
    assert got.first().s == ["A", "b", "C", "d", *[f"s{k}" for k in range(146)]]


def test_adverts_are_dealt_and_searched_once_for_each_term(spark):
    plan = catalog.QUERIES["fit_04_scores"](spark, DIR)._jdf.queryExecution()
    assert "RoundRobinPartitioning" in plan.executedPlan().toString() and plan.optimizedPlan().toString().count(r"\Qdjango\E") == 1


def test_sides_are_told_apart_by_one_aggregation(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "k string") for xs in (["x", "y", "y", None], ["y", "z", "z", None]))
    got = records.except_both(a, b, "k")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.k or "", r.side) for r in got.collect()) == [("", "dropped_off"), ("", "newly_listed"), ("x", "dropped_off"), ("z", "newly_listed")]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Sort" not in plan


def test_word_files_are_handed_over_a_few_at_a_time(spark):
    plan = catalog.QUERIES["src_12_word_text"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    files = spark.createDataFrame([(1, None), (2, bytearray(boards._as_word("a\n b \n\nc"))), (3, bytearray(b"%PDF-1.4"))], "k int, content binary")
    got = {r.k: (r.cv.text, r.cv.error) for r in files.select("k", office.cv_text(F.col("content")).alias("cv")).collect()}
    assert got[2] == ("a\n b \nc", None) and got[3] == (None, None) and got[1][0] is None


def test_last_revisions_are_not_gathered_by_an_aggregation(spark):
    jobs = view(spark, "job").where("sponsor_verdict IS NOT NULL AND job_id < 40").withColumns({"fitness_reasons": F.array(F.lit("x")), "application_id": F.lit(1), "application_status": F.lit("FOUND")})
    known = [r.job_id for r in jobs.select("job_id").collect()]
    many, few, none = known[:3]
    rows = [(k, many, "f", str(k), None, date(2024, 1, 1 + k // 10)) for k in range(50)] + [(100, few, "g", "a", "b", None), (101, few, "g", "b", "c", date(2024, 1, 1)), (102, -1, "g", "", "", None)]
    revisions = spark.createDataFrame(rows, "revision_id long, job_id long, field string, value_before string, value_after string, changed_at date")
    df = search.detail_rows(jobs, revisions)
    plan = df._jdf.queryExecution().executedPlan().toString()
    got = {r.job_id: [x.revision_id for x in r.revisions] for r in df.collect()}
    assert sorted(got) == sorted(known) and got[many] == list(range(49, 29, -1)) and got[few] == [101, 100] and got[none] == []
    assert "ObjectHashAggregate" not in plan and plan.count("Join") == 2 and f", {16 * spark.sparkContext.defaultParallelism}), REPARTITION_BY_NUM" in plan


def test_items_are_read_once_and_not_sampled(spark):
    plan = catalog.QUERIES["snk_05_all_people"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    ranges = re.search(r"Exchange rangepartitioning\((.*)\), REPARTITION", plan)[1]
    assert "item" not in ranges and "get_json_object" not in plan and plan.count("from_json(") == 1


def test_digests_are_not_gathered_and_searches_are_read_once_dealt(spark):
    df = catalog.QUERIES["snk_08_digests"](spark, DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    gathered = re.findall(r"ObjectHashAggregate\(keys=\[([^\]]*)\]", plan)
    assert gathered and not [k for k in gathered if "owner" in k]
    assert not [line for line in plan.splitlines() if "Filter" in line and "sha2(" in line]  # what a search asks isn't worked out in the scan
    assert len([x for x in exchanged(df) if "title_vector#" in x]) == 1  # adverts travel once


def test_parameters_are_made_once_of_a_query(spark):
    df = spark.createDataFrame([("a=1&b=%20x&a=2&=3&c=&d",), (None,), ("",)], "query string").select(search.saved_params(F.col("query")).alias("p"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [r.p for r in df.collect()] == [{"a": "1", "b": " x"}, {}, {}]


def test_a_digest_is_its_pieces_in_order(spark):
    jobs = spark.createDataFrame([(k, None if k == 9 else f"T{k}", "Ü", f"u/{k}", "OK" if k % 2 else None, "BAND") for k in range(300)], "job_id long, title string, name string, source_url string, sponsor_verdict string, threshold_verdict string")
    searches = spark.createDataFrame([(1, 5, "x"), (2, 5, None), (11, 5, "y"), (3, 6, "z"), (4, None, "w")], "search_id long, owner long, name string")
    asking = searches.select("search_id", "owner", F.when(F.col("search_id") == 3, "b").otherwise("a").alias("ask"), F.lit(date(2024, 1, 1)).alias("since"))
    found = spark.createDataFrame([("a", date(2024, 1, 1), 2, 3), ("a", date(2024, 1, 1), 1, 8), ("a", date(2024, 1, 1), 3, 777)], "ask string, since date, place int, job_id long")
    soon = spark.createDataFrame([(5, 12, date(2024, 3, 2)), (5, 9, date(2024, 3, 1)), (5, 10, date(2024, 3, 1)), (6, 9, date(2024, 3, 1))], "owner long, job_id long, closing_date date")
    due = spark.createDataFrame([(8, 1000 - k, k, "" if k % 2 else "Call", date(2024, 3, 1 + k // 100)) for k in range(100, 300)], "owner long, application_id long, job_id long, next_action string, next_action_due date")
    got = {r.owner: r for r in digests.digests(digests.pieces(asking, found, searches, soon, due, jobs)).collect()}
    two = "(2)\n  · T8 — Ü [unscreened]\n    u/8\n  · T3 — Ü [OK · BAND]\n    u/3"
    acts = sorted(((2024, 3, 1 + k // 100), 1000 - k, f"  · {1 + k // 100:02d} Mar — {'Follow up' if k % 2 else 'Call'} (T{k}, Ü)") for k in range(100, 300))
    bodies = {
        5: (f"New for “x” {two}\n\nNew for “y” {two}\n\nSaved jobs closing soon (3)\n  · 01 Mar — T10, Ü\n  · 02 Mar — T12, Ü", 6, 3), None: (f"New for “w” {two}", 2, 0),
        6: ("Saved jobs closing soon (1)\n", 0, 1), 8: ("Actions due (200)\n" + "\n".join(x for *_, x in acts), 0, 0),
    }
    assert {k: (r.subject, r.body_md5) for k, r in got.items()} == {k: (f"HE jobs: {n} new, {s} closing soon", hashlib.md5(body.encode()).hexdigest()) for k, (body, n, s) in bodies.items()}
