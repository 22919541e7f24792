"""From captured pages to vacancies: structured data first, then feeds, then the page itself."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import pages

FIELDS = "source_url title institution_slug department category reference location_raw salary_raw grade_raw description_text contract_raw hours_raw posted_date closing_date strategy".split()
# Fields that a detail page may fill, and what counts as a thin description.
FILLED, THIN = ["description_text", "category", "location_raw", "salary_raw", "department", "reference", "contract_raw", "hours_raw", "grade_raw"], 200
# Outcomes of errors; any other error is a parse error.
OUTCOMES = {"SiteOffline": "OFFLINE", "Blocked": "BLOCKED", "RobotsDisallowed": "ROBOTS_DISALLOWED", "Timeout": "TIMEOUT", "ParseError": "PARSE_ERROR", "NoAdapterFound": "NO_ADAPTER"}
# How platforms are told, in order, by marks in the URL (u), its host (s) or the page (h; - must not be there): any mark, or all of a tuple's.
_NO_HIRESERVE = ("-:hireserve", "-:p_web_site_id")
PLATFORMS = [
    ("WORKDAY", ["u:myworkdayjobs.com"]), ("STONEFISH", ["h:stonefish", "u:vacancies.aspx", "u:vacancydetails.aspx"]), ("JOBTRAIN", ["h:jobtrain", "u:/home/job", "u:/job/jobdetail", "u:jobtrain"]),
    ("COREHR_CATEGORISED", ["2:p_competition_type"]),
    ("COREHR", [(*_NO_HIRESERVE, mark) for mark in ("u:wd_portal.show_page", "u:/pls/", "u:corehr", "h:wd_portal.show_page", "h:coreportal_erecruit")]),
    ("EPLOY", ["u:eploy.net", "h:eploy"]), ("ITRENT", ["u:webitrent.com", "u:_webrecruitment", "h:webitrent.com"]), ("HIRESERVE", ["u:hireserve", "h:hireserve", "h:icamsbase", "h:p_web_site_id"]),
    ("SUCCESSFACTORS", ["u:successfactors", "u:sapsf.", ('h:id="searchresults"', "h:jobtitle-link"), ('h:id="root"', "h:successfactors")]),
    ("CAMBRIDGE_VIEWS_TABLE", [("h:view-title-table-column", "h:view-field-category-table-column", "h:view-field-closing-date-table-column")]),
    ("RAILS_JOBS_BOARD", [("h:results-list", "h:job-result-item", "h:results-job-location")]), ("CONTENSIS_JOBS", [("h:window.redux_data", 'h:"contenttypeid":"jobvacancy"')]),
    ("TALENTLINK", [r"r:<script[^>]+src=[^>]*recruitmentplatform\.com[^>]*laydisplayrapido\.cfm", "h:data-talentlink-fo-host", "h:data-lumesse-fo-host"]), ("AUB_VACANCY_CARDS", [('r:<p class="mt-2">\\s*salary:', "h:/vacancies/")]),
    ("ORACLE_FUSION", [("u:oraclecloud.com", "u:candidateexperience"), "h:oraclecloud"]), ("ENGAGE_ATS", ["h:powered by engage|ats", "h:havas people", "h:v2/login", "h:v2/vacancy"]),
    ("GENERIC_CARD_SCRAPE", ["s:qmul.ac.uk", "s:rgu.ac.uk", "s:smucb.ac.uk", "s:rau.ac.uk"]), ("CHANGEWORKNOW", [("u:changeworknow.co.uk", "u:/vms/e/careers")]), ("LUMINATE", ["u:luminate.ac.uk"]),
    ("LIPA_VACANCY_CARDS", ["h:job-item-container"]), ("NORWICH_VACANCY_CARDS", [("u:norwichuni.ac.uk", "u:work-at-norwich")]), ("LEEDS_ARTS_VACANCY_CARDS", [("u:leeds-art.ac.uk", "u:/about-us/jobs")]),
    ("TALEO", ["u:taleo.net"]), ("POSTINGPANDA", ["h:postingpanda.blob.core.windows.net"]), ("MHR_PEOPLE_FIRST", ["u:jobs.people-first.com"]), ("DUNDEE_VACANCY_CARDS", ["h:card--job-opportunity"]),
    ("TRIBEPAD", ["h:tribepad talent acquisition software"]), ("GUILDHALL_VACANCY_CARDS", ["u:gsmd.ac.uk"]), ("RCM_VACANCY_CARDS", ["u:rcm.ac.uk"]), ("RNCM_VACANCY_CARDS", ["u:rncm.ac.uk"]),
    ("LIVERPOOL_HOPE_VACANCY_TABLES", ["u:hope.ac.uk"]), ("FUNNELBACK", ["h:funnelback"]), ("HIREFUL_CMS", ["h:hirefulcms"]), ("WEBRECRUIT", ["h:powered by: webrecruit"]),
]


def _row(columns: dict[str, Column]) -> list[Column]:
    return [(columns[c] if c in columns else F.lit("").cast("date" if c in pages.DATES else "string") if c not in pages.DATES else F.lit(None).cast("date")).alias(c) for c in FIELDS]


def from_postings(parsed: DataFrame, today: date) -> DataFrame:
    """SRC-10, EXT-04, 05, 08 to 10: vacancies from the structured data of parsed pages (url, slug); no title or no address, no vacancy."""
    p = parsed.select("url", "slug", F.explode("page.postings").alias("p")).where("p.title <> '' AND p.url <> ''")
    get = lambda c: F.col(f"p.{c}")
    return p.select(*_row({
        "source_url": pages.absolute(F.col("url"), get("url")), "title": get("title"), "institution_slug": F.col("slug"), "department": get("department"), "reference": get("identifier"), "location_raw": get("location"),
        "salary_raw": pages.posted_salary(F.col("p")), "description_text": pages.html_to_text(get("description")), "contract_raw": get("employment"),
        "posted_date": pages.uk_date(get("posted"), today), "closing_date": pages.uk_date(get("closes"), today), "strategy": F.lit("JSON_LD"),
    }))


def from_feeds(feeds: DataFrame, today: date) -> DataFrame:
    """SRC-11 and EXT-11: vacancies from feeds (url, slug, xml) that are about jobs."""
    f = feeds.select("url", "slug", pages.feed(F.col("xml")).alias("f"))
    i = f.where(pages.is_jobs_feed(F.col("f"))).select("url", "slug", F.explode("f.items").alias("i")).where("i.title <> '' AND i.href <> ''")
    return i.select(*_row({
        "source_url": pages.absolute(F.col("url"), F.col("i.href")), "title": F.col("i.title"), "institution_slug": F.col("slug"), "description_text": pages.html_to_text(F.col("i.description")),
        "posted_date": pages.uk_date(F.col("i.published"), today), "strategy": F.lit("RSS"),
    }))


def from_details(parsed: DataFrame, today: date) -> DataFrame:
    """EXT-03, 12 and 13, API-03: the vacancy that a detail page (url, slug) describes; a page without a heading describes none."""
    d = parsed.where("page.title <> ''")
    labels = {c: F.coalesce(pages.labelled(F.col("page.pairs"), c), F.lit("")) for c in pages.LABELS if c not in pages.DATES}
    dates = {c: pages.uk_date(pages.labelled(F.col("page.pairs"), c), today) for c in pages.DATES}
    own = {"source_url": F.col("url"), "title": F.col("page.title"), "institution_slug": F.col("slug"), "description_text": F.col("page.body"), "strategy": F.lit("HTML")}
    return d.select(*_row(own | labels | dates), pages.unknown_labels(F.col("page.pairs")).alias("extra"))


def ladder(by_posting: DataFrame, by_feed: DataFrame, by_page: DataFrame) -> DataFrame:
    """EXT-14: of each institution the vacancies of the first way that gave any."""
    every = by_posting.select(*FIELDS, F.lit(0).alias("rung")).unionByName(by_feed.select(*FIELDS, F.lit(1).alias("rung"))).unionByName(by_page.select(*FIELDS, F.lit(2).alias("rung")))
    first = every.groupBy("institution_slug").agg(F.min("rung").alias("rung"))
    return every.join(first, ["institution_slug", "rung"], "left_semi").select(*FIELDS)


def thin(vacancies: DataFrame, most: int) -> DataFrame:
    """EXT-16 and ORD-08: of each institution the vacancies that a detail page would help most, at most so many; ties by URL."""
    short = vacancies.where((F.length(F.trim("description_text")) < THIN) | (F.col("category") == ""))
    first = Window.partitionBy("institution_slug").orderBy(F.length("description_text"), "source_url")
    return short.withColumn("place", F.row_number().over(first)).where(F.col("place") <= most).select("institution_slug", "source_url")


def enriched(vacancies: DataFrame, details: DataFrame) -> DataFrame:
    """EXT-16: empty fields filled from details (source_url, ...); what the listing said stands."""
    every = FILLED + pages.DATES
    d = details.select("source_url", *[F.col(c).alias(f"d_{c}") for c in every])
    both = vacancies.join(d, "source_url", "left")
    fill = {c: F.when(F.col(c) == "", F.coalesce(f"d_{c}", F.lit(""))).otherwise(F.col(c)) for c in FILLED} | {c: F.coalesce(c, f"d_{c}") for c in pages.DATES}
    return both.withColumns(fill).select(*vacancies.columns)


def institution_description(page: Column, least: int = 40, most: int = 600) -> Column:
    """EXT-06, 07 and 17: what an institution says of itself, cut; empty if it says little."""
    said = lambda c: F.when(F.length(F.trim(c)) >= least, F.substring(F.trim(c), 1, most))
    return F.coalesce(said(page["organisation"]), said(page["meta"]), F.lit(""))


def _mark(mark: str, url: Column, html: Column) -> Column:
    where, what = mark.split(":", 1)
    if where == "r":
        return html.rlike(what)
    if where == "2":  # two different links with this parameter
        return F.size(F.array_distinct(F.regexp_extract_all(html, F.lit(rf"href=[\"'][^\"']*[?&;]{what}=([^&\"']+)"), 1))) >= 2
    found = F.contains({"u": url, "s": F.regexp_extract(url, "^[a-z]+://([^/]*)", 1)}.get(where, html), F.lit(what))
    return ~found if where == "-" else found


def detected(url: Column, html: Column, structured: Column) -> Column:
    """EXT-18 and ADP-35: the first platform whose marks the page bears; STRUCTURED for any page with postings or a feed; null for none."""

    def chosen(p: Column) -> Column:
        out = F
        for platform, groups in PLATFORMS:
            test = F.lit(False)
            for group in groups:
                each = F.lit(True)
                for mark in (group,) if isinstance(group, str) else group:
                    each = each & _mark(mark, p["u"], p["h"])
                test = test | each
            out = out.when(test, platform)
        return out.when(structured, "STRUCTURED")

    lowered = F.struct(F.lower(F.coalesce(url, F.lit(""))).alias("u"), F.lower(F.coalesce(html, F.lit(""))).alias("h"))
    return F.get(F.transform(F.array(lowered), chosen), F.lit(0))


def resolved(override: Column, found: Column) -> Column:
    """EXT-19: a person's choice beats detection; an unknown choice, or nothing found, is NO_ADAPTER."""
    known = override.isin([p for p, _ in PLATFORMS] + ["STRUCTURED"])
    return F.when(F.coalesce(override, F.lit("")) != "", F.when(known, override).otherwise("NO_ADAPTER")).otherwise(F.coalesce(found, F.lit("NO_ADAPTER")))


def error_outcome(error: Column) -> Column:
    """EXT-20."""
    out = F
    for name, outcome in OUTCOMES.items():
        out = out.when(error == name, outcome)
    return out.otherwise("PARSE_ERROR")


def crawl_outcome(url: Column, guarded: Column, error: Column, found: Column) -> Column:
    """EXT-21: SKIPPED without an address, then what the page or an error says, then whether there was any vacancy."""
    return F.when(F.coalesce(url, F.lit("")) == "", "SKIPPED").when(guarded.isNotNull(), guarded).when(error.isNotNull(), error_outcome(error)).when(found > 0, "OK").otherwise("ZERO_RESULTS")


def state_blob(html: Column, variable: str = "REDUX_DATA") -> Column:
    """JSN-02: the JSON that a page hands its script, undefined as null; null if there is none."""
    blob = F.regexp_extract(html, rf"(?s)window\.{variable}\s*=\s*(\{{.*?\}})\s*;?\s*</script>", 1)
    return F.try_parse_json(F.nullif(F.regexp_replace(blob, r"\bundefined\b", "null"), F.lit("")))
