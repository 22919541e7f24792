"""Closures over page links against plain breadth-first search."""

import random
from datetime import date

from larkspur.functions import nodes
from larkspur.operators import frontier

TODAY = date(2024, 5, 10)


def breadth_first(starts, edges, most=None):
    out = {}
    for slug, url in starts:
        if url is None:
            continue
        level, depth, seen = [url], 0, {}
        while level and (most is None or depth < most):
            for u in level:
                seen.setdefault(u, depth)
            level = [b for a, b in edges if a in level and b is not None and b not in seen]
            depth += 1
        for u, d in seen.items():
            out[slug, u] = min(d, out.get((slug, u), d))
    return {(s, u, d) for (s, u), d in out.items()}


def test_closure_is_breadth_first_search(spark):
    r = random.Random(3)
    edges = [(f"u{r.randrange(60)}", f"u{r.randrange(60)}") for _ in range(90)] + [("u1", "u2"), ("u2", "u1"), ("u1", "u1"), ("u1", "u2"), (None, "u4"), ("u4", None)]
    starts = [("a", "u1"), ("a", "u5"), ("b", "u1"), ("b", "u1"), ("c", "nowhere"), ("d", None)]
    e, s = spark.createDataFrame(edges, "url string, to string"), spark.createDataFrame(starts, "slug string, url string")
    for most in (None, 1, 3):
        assert {tuple(x) for x in frontier.reached(s, e, most).collect()} == breadth_first(starts, edges, most)
    assert frontier.reached(s, e.where("false")).count() == 4 and frontier.reached(s.where("false"), e).count() == 0


def pages_of(spark, pages):
    return nodes.noded(spark.createDataFrame(list(pages.items()), "url string, html string"))


def test_a_board_is_read_to_its_last_page(spark):
    card = lambda k: f'<li class="job-result-item"><div class="job-title"><a href="/jobs/j-{k}">Job {k}</a></div></li>'
    onward = lambda u: f'<nav class="pagination"><span class="prev"><a href="/l?page=9">x</a></span><span class="next"><a href="{u}">Next</a></span></nav>'
    pages = {"https://a.example/l": card(1) + card(2) + onward("/l?page=2"), "https://a.example/l?page=2": card(2) + card(3) + onward("?page=3"), "https://a.example/l?page=3": card(4) + onward("/l"), "https://a.example/l?page=9": card(9), "https://b.example/l": card(5)}
    starts = spark.createDataFrame([("a", "https://a.example/l"), ("b", "https://b.example/l"), ("c", "https://c.example/lost")], "slug string, url string")
    got = {(r.institution_slug, r.source_url, r.title) for r in frontier.walked(pages_of(spark, pages), starts, "RAILS_JOBS_BOARD", TODAY).collect()}
    assert got == {("a", f"https://a.example/jobs/j-{k}", f"Job {k}") for k in (1, 2, 3, 4)} | {("b", "https://b.example/jobs/j-5", "Job 5")}


def test_numbered_pages_and_details(spark):
    nav = lambda *n: "".join(f'<a class="Lst-NavPage" href="/x?pagenum={k}&amp;s={n}">{k}</a>' for k in n)
    detail = '<h1 class="JD-Title">Porter</h1><div><h4 class="JD-HDLabel">School / Department</h4><span class="JD-HDText">Estates</span></div><div><h4 class="JD-HDLabel">Closing Date</h4><i>x</i><span class="JD-HDText">7 June 2024</span></div><div id="JD-Field1"><p>Carry</p></div><div id="JD-Fields">no</div>'
    pages = {
        "https://t.example/x": '<a class="big lstA-desc1" href="/d?i=1">One</a><a class="lstA-title" href="/d?i=0">no</a>' + nav(1, 2),
        "https://t.example/x?pagenum=2&s=(1, 2)": '<a class="lstA-desc" href="/d?i=2">Two</a><a class="lstA-desc" href="/d?i=1">One</a>' + nav(1, 2, 3),
        "https://t.example/x?pagenum=3&s=(1, 2, 3)": '<a class="lstA-desc" href="/d?i=3">Three</a>' + nav(2),
        "https://t.example/d?i=1": detail, "https://t.example/d?i=2": "<p>No title</p>",
    }
    noded = pages_of(spark, pages)
    starts = spark.createDataFrame([("t", "https://t.example/x")], "slug string, url string")
    details = frontier.talentlink_details(noded, starts)
    assert sorted(r.url for r in details.collect()) == [f"https://t.example/d?i={k}" for k in (1, 2, 3)]
    assert frontier.overlong(noded, starts).count() == 0
    got = frontier.talentlink_vacancies(noded, details, TODAY).collect()
    assert [(r.source_url, r.title, r.department, r.closing_date, r.description_text, r.reference) for r in got] == [("https://t.example/d?i=1", "Porter", "Estates", date(2024, 6, 7), "Carry", "")]
