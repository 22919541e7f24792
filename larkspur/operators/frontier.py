"""Which captured pages a listing leads to: the closure of its onward links, a round a step, over all listings at once."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import nodes as N
from larkspur.functions import pages
from larkspur.operators import boards
from larkspur.sources.lineage import cut


def links(noded: DataFrame, selector: str, only_first: bool = False) -> DataFrame:
    """(url, to): the addresses that the selected links of pages (url, nodes) lead to; of each page the first link alone, or all."""
    found = N.selected(F.col("nodes"), selector)
    found = F.slice(found, 1, 1) if only_first else found
    each = noded.select("url", F.explode(found).alias("a"))
    return each.select("url", pages.absolute(F.col("url"), N.attribute(F.col("a"), "href")).alias("to")).distinct()


def reached(starts: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(slug, url, depth): every address that starts (slug, url) lead to over edges (url, to), themselves at depth 0, at its least depth.

    A round takes the newest addresses one link further and leaves out what was seen before, so cycles and repeated links
    cost nothing; what is seen is written each round. Rounds end when none is new, or after most pages in a row. Null
    addresses lead nowhere.
    """
    seen = cut(starts.where("url IS NOT NULL").select("slug", "url").distinct().withColumn("depth", F.lit(0)))
    edges = cut(edges.where("url IS NOT NULL AND to IS NOT NULL").select("url", "to").distinct())
    newest, depth = seen, 0
    while (most is None or depth + 1 < most) and not newest.isEmpty():
        depth += 1
        step = newest.join(edges, "url").select("slug", F.col("to").alias("url")).distinct()
        newest = cut(step.join(seen, ["slug", "url"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = cut(seen.unionByName(newest))
    return seen


def walked(noded: DataFrame, starts: DataFrame, platform: str, today: date) -> DataFrame:
    """ADP-18, 22 and 32: the vacancies of all captured pages (url, nodes, strings) that listings (slug, url) of a platform go on to.

    Of one institution's vacancies with one address one stays, from the page that is fewest steps away. Every page is read where
    it stands and its vacancies alone meet the listings that lead to it: nodes are many times as wide, and are never shuffled.
    """
    site = boards.SITES[platform][0][1]
    found = reached(starts, links(noded, site.onward, only_first=True), site.most)
    own = boards.listed(noded.withColumn("slug", F.col("url")), platform, today).withColumnRenamed("institution_slug", "url")
    listed = own.join(found.withColumnRenamed("slug", "institution_slug"), "url").drop("url")
    fields = [c for c in listed.columns if c not in ("institution_slug", "source_url", "depth")]
    first = listed.groupBy("institution_slug", "source_url").agg(F.min_by(F.struct(*fields), F.struct("depth", *fields)).alias("v"))
    return first.select("source_url", "institution_slug", "v.*").select(*boards.FIELDS)


# How one platform's lists name their details and their numbered pages, and how many pages it may have.
DETAIL, NUMBERED, PAGE_NUMBER, MOST_PAGES = "a[href][class~^=lstA-desc]", "a.Lst-NavPage[href]", r"(?i)[?&]pagenum=(\d+)", 100


def talentlink_details(noded: DataFrame, starts: DataFrame) -> DataFrame:
    """ADP-11: (slug, url) of the details that listings lead to over their numbered pages; a number counts once for a listing.

    A listing that goes on past MOST_PAGES is an error of that listing: it has no rows, see overlong().
    """
    every = _links_of_lists(noded)
    found = cut(_numbered(every, starts))
    short = found.groupBy("slug").count().where(F.col("count") <= MOST_PAGES)
    details = every.where("kind = 'detail'").drop("kind")
    return found.join(short, "slug", "left_semi").join(details, "url").select("slug", F.col("to").alias("url")).distinct()


def overlong(noded: DataFrame, starts: DataFrame) -> DataFrame:
    """ADP-11: (slug, error) of the listings with too many pages."""
    return _numbered(_links_of_lists(noded), starts).groupBy("slug").count().where(F.col("count") > MOST_PAGES).select("slug", F.lit("ParseError").alias("error"))


def _links_of_lists(noded: DataFrame) -> DataFrame:
    """(kind, url, to): all links to numbered pages and to details. A page is read once for both and its links are written: nodes are never shuffled."""
    of_kind = lambda kind: lambda a: F.struct(F.lit(kind).alias("kind"), N.attribute(a, "href").alias("href"))
    found = F.concat(*[F.transform(N.selected(F.col("nodes"), selector), of_kind(kind)) for kind, selector in (("numbered", NUMBERED), ("detail", DETAIL))])
    each = noded.select("url", F.explode(found).alias("a")).select("url", "a.kind", "a.href")
    return cut(each.select("kind", "url", pages.absolute(F.col("url"), F.col("href")).alias("to")).distinct())


def _numbered(every: DataFrame, starts: DataFrame) -> DataFrame:
    """(slug, url): a listing's own page and, for each page number other than 1, the address seen first."""
    edges = every.where(F.col("kind") == "numbered").where(F.col("to").rlike(PAGE_NUMBER)).drop("kind")
    number = F.coalesce(F.nullif(F.regexp_extract("url", PAGE_NUMBER, 1), F.lit("")), F.lit("1"))
    found = reached(starts, edges).withColumn("number", F.when(F.col("depth") == 0, "1").otherwise(number))
    return found.groupBy("slug", "number").agg(F.min_by("url", F.struct("depth", "url")).alias("url")).select("slug", "url")


# Parts of labels on one platform's details that name fields.
DETAIL_FIELDS = {"department": ["department", "school"], "reference": ["job number"], "salary_raw": ["salary"], "grade_raw": ["grade"], "closing": ["closing date"]}


def talentlink_vacancies(noded: DataFrame, details: DataFrame, today: date) -> DataFrame:
    """ADP-11: the vacancies of detail pages (url, nodes, strings) of details (slug, url): title, fields by their labels, and the description's text."""
    n, s = F.col("nodes"), F.col("strings")
    labels = N.selected(n, "*[class~=JD-HDLabel]")
    value = lambda x: N.first(F.filter(N.selected(n, "*[class~=JD-HDText]"), lambda v: (v["parent"] == x["parent"]) & (v["at"] > x["at"])))
    pair = lambda x: F.struct(F.lower(N.said(s, x)).alias("label"), N.said(s, value(x)).alias("value"), value(x).isNotNull().alias("there"))
    pairs = F.filter(F.transform(labels, pair), lambda p: p["there"] & (p["label"] != ""))
    blocks = F.filter(N.selected(n, "*[id^=JD-Field]"), lambda b: N.attribute(b, "id").rlike(r"^JD-Field\d+$"))
    page = noded.join(details, "url").select(
        "slug", "url", N.said(s, N.first(N.selected(n, ".JD-Title"))).alias("title"), pairs.alias("pairs"), F.array_join(F.transform(blocks, lambda b: F.array_join(N.lines(s, b), "\n")), "\n").alias("description_text"),
    )

    def labelled(words: list[str]):
        has = lambda p: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(p["label"], w))
        return F.coalesce(N.first(F.filter(F.col("pairs"), has))["value"], F.lit(""))

    # an array of one, exploded: a date's Python function then reads a plain column
    named = page.select("slug", "url", "title", "description_text", F.explode(F.array(F.struct(*[labelled(words).alias(c) for c, words in DETAIL_FIELDS.items()]))).alias("v")).where("title <> ''")
    named = named.select(F.col("url").alias("source_url"), F.col("slug").alias("institution_slug"), "title", "description_text", "v.*")
    return named.withColumn("closing_date", pages.uk_date(F.col("closing"), today)).drop("closing")
