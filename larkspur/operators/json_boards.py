"""Vacancies from the JSON that recruitment systems answer with: each system is a mapping of paths, read in the JVM alone.

Items stay as they were written until a field is asked for, so an object's own order of keys is kept where it counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import pages
from larkspur.operators.extraction import FIELDS


@dataclass(frozen=True)
class Board:
    """Where items stand in an answer, what an item may not lack, and the path of each field in an item."""

    items: str
    needs: tuple[str, ...]
    fields: dict[str, str]
    #: Fields from a list of classifications: any of these words in a classification's name.
    classified: dict[str, tuple[str, ...]] | None = None


# The systems' own names.
BOARDS = {
    "WORKDAY": Board("$.jobPostings", ("$.title", "$.externalPath"), {"title": "$.title", "path": "$.externalPath", "reference": "$.bulletFields[0]", "location_raw": "$.locationsText", "description_html": "$.jobDescription", "posted_raw": "$.postedOn"}),
    "ITRENT": Board("$.results", ("$.job_title", "$.vacancy_id"), {
        "title": "$.job_title", "vacancy_id": "$.vacancy_id", "department": "$.region_id", "reference": "$.vacancy_ref", "location_raw": "$.location_id", "salary_raw": "$.salary", "description_html": "$.job_description",
        "closing_raw": "$.app_close_d", "contract_raw": "$.basis_id", "hours_raw": "$.con_hrs",
    }),
    "HIRESERVE": Board("$.jobs", ("$.title", "$.weblink"), {"title": "$.title", "path": "$.weblink", "reference": "$.refno", "closing_raw": "$.publication.internet.closing_date", "vacancy_id": "$.id"}, {
        "department": ("depart", "faculty", "school", "directorate", "division"), "location_raw": ("location",), "salary_raw": ("salary",), "contract_raw": ("contract",), "hours_raw": ("hour",),
    }),
}
DETAIL = {
    "title": "$.Title", "department": "$.JobFunction", "category": "$.Category", "location_raw": "$.PrimaryLocation", "contract_raw": "$.JobSchedule", "description_html": "$.ExternalDescriptionStr",
    "posted_raw": "$.ExternalPostedStartDate", "closing_raw": "$.ExternalPostedEndDate",
}
SALARY_LABELS = ("grade and salary", "salary and grade", "salary")
OWN = ("vacancy_id", "posted_raw", "closing_raw", "description_html")


def answer(body: Column) -> Column:
    """The answer as a variant; null for what is no JSON object."""
    parsed = F.try_parse_json(body)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)


def texts(json: Column, path: str) -> Column:
    """The items of a list as they were written; none where there is no such list."""
    steps = path.removeprefix("$.").split(".")
    shape = "array<string>"
    for s in reversed(steps):
        shape = f"struct<{s}:{shape}>"
    found = F.from_json(json, shape)
    for s in steps:
        found = found[s]
    return F.coalesce(F.filter(found, lambda x: x.isNotNull()), F.array().cast("array<string>"))


def said(item: Column, path: str) -> Column:
    """A value as text; empty for none, null, false and zero, as such answers leave things out."""
    value = F.try_variant_get(item, path, "string")
    return F.coalesce(F.when(~value.isin("false", "0"), value), F.lit(""))


def iso_date(value: Column) -> Column:
    """The date that a text opens with, null for another text."""
    return F.try_to_date(F.regexp_extract(value, r"^\s*(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")


def any_date(value: Column) -> Column:
    """A date as APIs and British adverts write it, null for words such as "3 days ago"."""
    plain = F.trim(value)
    day_first = F.regexp_extract(plain, r"(?i)(\d{1,2})(?:st|nd|rd|th)?[ /.-]+([a-z]{3})[a-z]*,?[ /.-]+(\d{4})", 0)
    named = F.regexp_replace(day_first, r"(?i)^(\d{1,2})(?:st|nd|rd|th)?[ /.-]+([a-z]{3})[a-z]*,?[ /.-]+(\d{4})$", "$1 $2 $3")
    figures = F.regexp_extract(plain, r"(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})", 0)
    return F.coalesce(iso_date(plain), F.try_to_date(F.initcap(named), "d MMM yyyy"), F.try_to_date(F.regexp_replace(figures, "[.-]", "/"), "d/M/yyyy"))


def joined(base: Column, href: Column) -> Column:
    """An address against a page's, for what systems write: whole addresses, and paths from the root, the page or its query."""
    origin, path = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1), F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(F.length(path) > F.length(origin), F.regexp_replace(path, "[^/]*$", "")).otherwise(F.concat(origin, F.lit("/")))
    h = F.trim(href)
    return (
        F.when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(F.regexp_extract(base, "^([^/]*)", 1), h)).when(h.startswith("/"), F.concat(origin, h))
        .when(h.startswith("?"), F.concat(path, h)).when(h == "", base).otherwise(F.concat(folder, h))
    )


def _classified(text: Column, words: tuple[str, ...]) -> Column:
    """The values of the first classification whose name has one of the words and that has any value."""
    entries = F.map_values(F.from_json(text, "classifications map<string, struct<name: string, values: array<struct<class_val: string>>>>")["classifications"])
    values = lambda c: F.filter(F.transform(c["values"], lambda v: F.trim(F.coalesce(v["class_val"], F.lit("")))), lambda v: v != "")
    named = lambda c: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(c["name"]), w))
    return F.coalesce(F.array_join(values(F.get(F.filter(entries, lambda c: named(c) & (F.size(values(c)) > 0)), F.lit(0))), ", "), F.lit(""))


def listing_error(platform: str, body: Column) -> Column:
    """ParseError for an answer that is no object, or that says it holds fewer vacancies than there are; else null."""
    v = answer(body)
    lost = F.lit(False)
    if platform == "ITRENT":
        lost = F.coalesce(F.try_variant_get(v, "$.search.total_rec", "long"), F.lit(0)) > F.size(texts(body, BOARDS[platform].items))
    return F.when(v.isNull() | lost, "ParseError")


def listed(answers: DataFrame, platform: str) -> DataFrame:
    """ADP-06, 07 and 08: the vacancies (extraction.FIELDS, description_html and the system's own raw values) in answers (url, slug, body).

    url is the page that the answer belongs to: a careers page, or the search page of a session. An answer with an error, see
    listing_error(), and an item without what it needs give none. description_text is left to whoever needs it, see with_text().
    """
    board = BOARDS[platform]
    items = answers.where(listing_error(platform, F.col("body")).isNull()).select("url", "slug", F.explode(texts(F.col("body"), board.items)).alias("text"))
    items = items.withColumn("item", answer(F.col("text"))).where("item IS NOT NULL")
    for path in board.needs:
        items = items.where(F.trim(said(F.col("item"), path)) != "")
    get = {c: said(F.col("item"), path) for c, path in board.fields.items()} | {c: _classified(F.col("text"), words) for c, words in (board.classified or {}).items()}
    get["title"] = F.trim(get["title"])
    if platform == "ITRENT":
        get["source_url"] = F.concat("url", F.lit("&VACANCY_ID="), F.trim(get["vacancy_id"]))
        get["closing_date"] = F.when(get["closing_raw"].rlike(r"^\d{8}$"), F.try_to_date(get["closing_raw"], "yyyyMMdd"))
    else:
        get["source_url"] = joined(F.col("url"), get["path"])
        get["closing_date"] = iso_date(get.get("closing_raw", F.lit("")))
    get["posted_date"] = F.when(~F.contains(F.lower(get["posted_raw"]), F.lit("ago")), any_date(get["posted_raw"])) if "posted_raw" in get else F.lit(None).cast("date")
    return _out(items, get)


def _out(items: DataFrame, get: dict[str, Column]) -> DataFrame:
    own = get | {"institution_slug": F.col("slug"), "strategy": F.lit("JSON_API")}
    return items.select(*[(own[c] if c in own else F.lit("")).alias(c) for c in (*FIELDS, *OWN)])


def requisitions(answers: DataFrame) -> DataFrame:
    """ADP-13: (slug, base, site, id) of each vacancy once, from pages of lists (slug, base, site, body)."""
    listed = answers.select("slug", "base", "site", F.explode(texts(F.get(texts(F.col("body"), "$.items"), F.lit(0)), "$.requisitionList")).alias("item"))
    ids = listed.select("slug", "base", "site", said(answer(F.col("item")), "$.Id").alias("id"))
    return ids.where("id <> ''").distinct()


def oracle_site(url: Column, html: Column) -> Column:
    """ADP-13: struct of the origin that a careers page names, or its own, and its site's number; null without a number."""
    own = F.regexp_extract(url, r"^([a-z]+://[^/?#]*)", 1)
    named = F.rtrim(F.regexp_extract(html, r'(?i)data-apibaseurl="(https?://[^"]+)"', 1), F.lit("/"))
    site = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"/sites/([^/]+)", 1)
    return F.when(site != "", F.struct(F.coalesce(F.nullif(named, F.lit("")), own).alias("base"), site.alias("site")))


def labelled_paragraph(html: Column, labels: tuple[str, ...]) -> Column:
    """The rest of the first paragraph whose bold label has one of the labels; empty for none."""
    bare = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), "&nbsp;|&#160;", " "), r"\s+", " "))
    bold = lambda p: F.regexp_extract(p, r"(?is)<(strong|b)\b[^>]*>(.*?)</\1>", 2)
    label = lambda p: F.lower(F.rtrim(bare(bold(p)), F.lit(":")))
    value = lambda p: F.trim(F.substring(bare(p), F.length(bare(bold(p))) + 1, F.lit(1 << 30)), F.lit(" :"))
    paragraphs = F.regexp_extract_all(html, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), 1)
    fits = lambda p: (label(p) != "") & F.exists(F.array(*map(F.lit, labels)), lambda w: F.contains(label(p), w)) & (value(p) != "")
    return F.coalesce(value(F.get(F.filter(paragraphs, fits), F.lit(0))), F.lit(""))


def oracle_vacancies(wanted: DataFrame, details: DataFrame) -> DataFrame:
    """ADP-13: the vacancies of requisitions() by their details (base, site, id, body); an id without a usable detail gives none."""
    d = details.select("base", "site", "id", answer(F.get(texts(F.col("body"), "$.items"), F.lit(0))).alias("item")).where("item IS NOT NULL")
    both = wanted.join(d, ["base", "site", "id"])
    get = {c: said(F.col("item"), path) for c, path in DETAIL.items()}
    get |= {
        "title": F.trim(get["title"]), "reference": F.col("id"), "source_url": F.concat("base", F.lit("/hcmUI/CandidateExperience/en/sites/"), "site", F.lit("/job/"), "id"),
        "salary_raw": labelled_paragraph(get["description_html"], SALARY_LABELS), "posted_date": any_date(get["posted_raw"]), "closing_date": any_date(get["closing_raw"]),
    }
    return _out(both, get)


def with_text(vacancies: DataFrame) -> DataFrame:
    """description_text from description_html, by the page parser."""
    return vacancies.withColumn("description_text", F.when(F.col("description_html") == "", "").otherwise(pages.html_to_text(F.col("description_html"))))


def workday_api(careers_url: Column) -> Column:
    """ADP-06: the address of the answers behind a careers page: its tenant is the host's first label, its site the last part of the path that is no locale; null without either."""
    parts = F.filter(F.split(F.regexp_extract(careers_url, r"^[a-z]+://[^/?#]*([^?#]*)", 1), "/"), lambda s: (s != "") & ~s.rlike("^..-..$"))
    origin, tenant = F.regexp_extract(careers_url, r"^([a-z]+://[^/?#]*)", 1), F.regexp_extract(careers_url, r"^[a-z]+://([^./?#]*)", 1)
    return F.when((F.size(parts) > 0) & (tenant != ""), F.concat(origin, F.lit("/wday/cxs/"), tenant, F.lit("/"), F.try_element_at(parts, F.lit(-1)), F.lit("/jobs")))
