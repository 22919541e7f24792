"""Vacancies from the listing pages of known platforms: each platform is data, and one engine reads them all.

A Listing names the rows of a page by selectors and says where each field stands in a row. All of a page's rows become an
array of structs by Column functions over its nodes, so that a page's nodes are never repeated by row.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import nodes as N
from larkspur.functions import pages
from larkspur.operators.extraction import FIELDS

# Words in the headings of a table that name its columns, in order.
COLUMNS = {
    "title": ["job title", "vacancy", "post", "position", "title", "role"],
    "reference": ["reference", "ref", "vacancy reference", "job reference", "ref no"],
    "salary": ["salary", "salary range", "grade and salary", "remuneration"],
    "closing_date": ["closing date", "closes", "closing", "deadline"],
    "department": ["department", "faculty", "school", "location"],
    "contract": ["contract", "contract type", "type", "duration"],
}

Spec = tuple


@dataclass(frozen=True)
class Listing:
    """Rows, and the fields of a row. A spec is a way to a text:

    ("text", selector) and ("attribute", selector, name) read the first such node of the row, the row itself for "";
    ("cell", k, selector, name) a cell by place, ("column", field, selector, name) a cell by its table's headings, selector and
    name optional; ("group",) the group's text, ("before", selector) that of the last such node before it;
    ("line", selector, label) the rest of a line behind "label:"; ("labelled", each, label selector, label) the rest of a
    paragraph behind its label; ("pair", each, label selector, value selector, label) of the element that holds both;
    ("after", block, selector, words, end) the first such sibling after the row's block that has the words, before the end;
    ("closest", selector, spec) reads from the row's nearest such ancestor; ("match", spec, pattern) its first group,
    ("without", spec, pattern) the rest, ("either", spec, spec) the first that isn't empty; ("url",) the page's address.
    """

    rows: str
    fields: dict[str, Spec]
    #: Rows are looked for inside each of these, or inside the next sibling of that kind.
    group: str = ""
    sibling: str = ""
    only_first: bool = False
    #: A row has so many cells, of these kinds.
    cells: str = "td, th"
    least: int = 0
    #: What may not be empty.
    needs: tuple[str, ...] = ("title",)
    #: Link texts that lead to no vacancy don't count.
    plausible: bool = False
    #: What an address must match.
    address: str = ""
    #: Read where a page gives no row this way.
    otherwise: Listing | None = None
    #: Where a listing goes on, by the address of a link.
    onward: str = ""
    #: Pages that are read of one listing at most; fixed values.
    most: int = 1


_LINK = {"source_url": ("attribute", "a[href]", "href"), "title": ("text", "a[href]")}
_HEADED = lambda name: ("text", f"td[headers~={name}], th[headers~={name}]")
_TITLE = "td[headers~=view-title-table-column] a[href], th[headers~=view-title-table-column] a[href]"

CARDS = Listing("div.job-card", _LINK | {
    "department": ("attribute", "", "data-org"), "category": ("attribute", "", "data-family"), "contract_raw": ("attribute", "", "data-contract"),
    "reference": ("line", "p.profile-card__contact", "ref"), "salary_raw": ("line", "p.profile-card__contact", "salary"), "closing": ("line", "p.profile-card__contact", "closing date"),
})
_RESULT = lambda spec: ("closest", "div.result", spec)
RESULTS = Listing("h3.job-title", {
    "title": ("text", ""), "source_url": _RESULT(("attribute", "a.link-block[href]", "href")), "reference": ("match", _RESULT(("attribute", "a.link-block[href]", "href")), r"-(\d+)/?$"),
    "salary_raw": _RESULT(("labelled", "p", "span.bold", "salary")), "closing": _RESULT(("labelled", "p", "span.bold", "closing date")),
}, needs=("title", "source_url"))
PLAIN_TABLE = Listing("tr", {"source_url": ("cell", 0, "a[href]", "href"), "title": ("cell", 0, "a[href]"), "department": ("cell", 1), "closing": ("cell", 2)}, group="table.table", only_first=True, cells="td", least=3)
_REF = r"(?i)\s*Ref:\s*(\S+)\s*$"
PROSE = Listing("span[style*=18px]", {
    "source_url": ("url",), "title": ("without", ("text", "strong"), _REF), "reference": ("match", ("text", "strong"), _REF), "closing": ("after", "p", "p", "closing date", "hr"), "raw": ("text", "strong"),
}, needs=("raw",))

#: For each platform, its listings with the selector that a page must hold for each; the first that holds is read, "" always holds.
SITES: dict[str, list[tuple[str, Listing]]] = {
    "STONEFISH": [("", Listing("tr", {
        "source_url": ("column", "title", "a[href]", "href"), "title": ("column", "title", "a[href]"), "department": ("either", ("column", "department"), ("before", "h1, h2, h3, h4, caption")),
        "reference": ("column", "reference"), "salary_raw": ("column", "salary"), "location_raw": ("column", "department"), "contract_raw": ("column", "contract"), "closing": ("column", "closing_date"),
    }, group="table", plausible=True, otherwise=Listing("a[href]", {"source_url": ("attribute", "", "href"), "title": ("text", "")}, plausible=True, address="(?i)vacancydetails|vacancyid")))],
    "CAMBRIDGE_VIEWS_TABLE": [("", Listing("tr", {
        "source_url": ("attribute", _TITLE, "href"), "title": ("text", _TITLE), "department": _HEADED("view-field-department-location-table-column"), "category": _HEADED("view-field-category-table-column"),
        "reference": _HEADED("view-field-reference-table-column"), "salary_raw": _HEADED("view-field-salary-table-column"), "posted": _HEADED("view-created-table-column"), "closing": _HEADED("view-field-closing-date-table-column"),
    }, group="table", only_first=True))],
    "GENERIC_CARD_SCRAPE": [("div.job-card", CARDS), ("h3.job-title", RESULTS), ("table.table", PLAIN_TABLE), ("", PROSE)],
    "LIVERPOOL_HOPE_VACANCY_TABLES": [("", Listing("tr", {
        "source_url": ("cell", 0, "a[href]", "href"), "title": ("cell", 0, "a[href]"), "category": ("group",), "reference": ("cell", 1), "closing": ("cell", 2), "closing_time": ("cell", 3),
    }, group="h2", sibling="table", least=4, needs=("source_url",)))],
    "RAILS_JOBS_BOARD": [("", Listing("li.job-result-item", {
        "source_url": ("attribute", "div.job-title a[href]", "href"), "title": ("text", "div.job-title a[href]"), "reference": ("match", ("attribute", "div.job-title a[href]", "href"), r"-(\d+)/?$"),
        "location_raw": ("text", "li.results-job-location"), "salary_raw": ("text", "li.results-salary"), "description_text": ("text", "p.job-description"),
    }, onward="nav.pagination span.next a[href]", most=50))],
    "TALEO": [("", Listing("#jobList > li", {  # two divs in a card, the second says more
        "source_url": ("attribute", "div.multiline-data-container > div:nth-of-type(1) a[href]", "href"), "title": ("text", "div.multiline-data-container > div:nth-of-type(1) a[href]"),
        "department": ("text", "div.multiline-data-container > div:nth-of-type(2) > span"), "salary_raw": ("nth", "div.multiline-data-container > div:nth-of-type(2) > span", -1, 2),
        "reference": ("match", ("attribute", "div.multiline-data-container > div:nth-of-type(1) a[href]", "href"), r"[?&]job=(\d+)"),
    }, onward="a#next[href]", most=1_000))],
    "FUNNELBACK": [("", Listing("section.search-result", {
        "source_url": ("attribute", ".search-result-heading .h5 a", "title"), "title": ("text", ".search-result-heading .h5 a"), "reference": ("match", ("attribute", ".search-result-heading .h5 a", "title"), r"([^/]*)/*$"),
        "hours_raw": ("pair", ".course-teaser-key-stat", ".course-teaser-key-stat-label", ".course-teaser-key-stat-content", "post type"),
        "contract_raw": ("pair", ".course-teaser-key-stat", ".course-teaser-key-stat-label", ".course-teaser-key-stat-content", "contract type"),
        "salary_raw": ("pair", ".course-teaser-key-stat", ".course-teaser-key-stat-label", ".course-teaser-key-stat-content", "salary"),
        "closing": ("pair", ".course-teaser-key-stat", ".course-teaser-key-stat-label", ".course-teaser-key-stat-content", "closing date"),
    }, needs=("title", "source_url"), onward='a[title="Next"][href]', most=20))],
}


@dataclass
class _Reader:
    """What a spec says of a row of a page."""

    listing: Listing
    nodes: Column = field(default_factory=lambda: F.col("nodes"))
    strings: Column = field(default_factory=lambda: F.col("strings"))

    def found(self, scope: Column, selector: str) -> Column:
        return N.selected(N.inside(self.nodes, scope), selector)

    def one(self, node: Column, selector: str = "", name: str = "") -> Column:
        node = N.first(self.found(node, selector)) if selector else node
        return N.attribute(node, name) if name else self.said(node)

    def said(self, node: Column) -> Column:
        """A node's text, the node found once."""
        return N.bound(node, lambda n: N.said(self.strings, n))

    def cells(self, row: Column) -> Column:
        return self.found(row, self.listing.cells)

    def places(self, group: Column) -> Column:
        """For each field the place of a table's first heading that has a word of the field's; -1 without one."""

        def place(headings: Column, name: str) -> Column:
            has = lambda h: F.exists(F.array(*map(F.lit, COLUMNS[name])), lambda w: F.contains(h, w))
            return (F.array_position(F.transform(headings, has), True) - 1).cast("int")

        cells = N.bound(N.first(self.found(group, "tr")), lambda row: self.found(row, "th, td"))
        headings = F.transform(cells, lambda c: F.lower(N.said(self.strings, c)))
        return N.bound(headings, lambda h: F.struct(*[place(h, name).alias(name) for name in COLUMNS]))

    def cell(self, row: Column, place: Column, selector: str = "", name: str = "") -> Column:
        return F.when(place >= 0, N.bound(F.get(row["cells"], place), lambda c: self.one(c, selector, name))).otherwise("")

    def bound(self, row: Column, use) -> Column:
        """use(row), with the row's cells and the nodes inside it found once."""
        x = self.listing
        needed = any(k in str(x.fields) for k in ("'cell'", "'column'"))
        cells = self.cells(row) if needed else F.slice(self.nodes, 1, 0)
        return N.bound(F.struct(row["at"].alias("at"), row["until"].alias("until"), row["parent"].alias("parent"), row["attributes"].alias("attributes"), row["first"].alias("first"), row["last"].alias("last"), cells.alias("cells")), use)

    def value(self, spec: Spec, row: Column, group: Column) -> Column:
        kind, *rest = spec
        s = self.strings
        if kind == "text":
            return self.one(row, rest[0])
        if kind == "attribute":
            return self.one(row, *rest)
        if kind == "nth":
            found = self.found(row, rest[0])
            return N.bound(found, lambda f: F.when(F.size(f) >= rest[2], self.said(F.try_element_at(f, F.lit(rest[1])))).otherwise(""))
        if kind == "cell":
            return self.cell(row, F.lit(rest[0]), *rest[1:])
        if kind == "column":
            return self.cell(row, group["places"][rest[0]], *rest[1:])
        if kind == "group":
            return N.said(s, group)
        if kind == "before":
            return self.said(N.last(F.filter(N.selected(self.nodes, rest[0]), lambda n: n["at"] < group["at"])))
        if kind == "line":
            pattern = rf"(?i)^{rest[1]}\s*:\s*(.*)"
            lines = N.bound(N.first(self.found(row, rest[0])), lambda n: N.lines(s, n))
            each = F.transform(F.split(F.array_join(lines, "\n"), "\n"), lambda x: F.trim(x))
            return F.trim(F.coalesce(F.regexp_extract(N.last(F.filter(each, lambda x: x.rlike(pattern))), pattern, 1), F.lit("")))
        if kind in ("labelled", "pair"):
            label = lambda n: F.lower(F.rtrim(self.one(n, rest[1]), F.lit(":")))
            node = N.last(F.filter(self.found(row, rest[0]), lambda n: label(n) == rest[-1]))
            if kind == "pair":
                return N.bound(node, lambda n: F.when(n.isNull(), "").otherwise(self.one(n, rest[2])))
            return N.bound(node, lambda n: F.trim(F.substring(self.one(n), F.length(self.one(n, rest[1])) + 1, F.lit(1 << 30))))
        if kind == "after":
            block = N.last(F.filter(N.selected(self.nodes, rest[0]), lambda n: (n["at"] < row["at"]) & (row["at"] < n["until"])))
            block = N.bound(block, lambda b: F.struct(F.coalesce(b["parent"], row["parent"]).alias("parent"), F.coalesce(b["at"], row["at"]).alias("at")))
            later = N.bound(block, lambda b: F.filter(self.nodes, lambda n: (n["parent"] == b["parent"]) & (n["at"] > b["at"])))

            def after(found: Column) -> Column:
                end = F.coalesce(N.first(N.selected(found, rest[3]))["at"], F.lit(1 << 30))
                said = lambda e: N.first(F.filter(N.selected(found, rest[1]), lambda n: (n["at"] < e) & F.contains(F.lower(N.said(s, n)), F.lit(rest[2]))))
                return self.said(N.bound(end, said))

            return N.bound(later, after)
        if kind == "closest":
            around = N.last(F.filter(N.selected(self.nodes, rest[0]), lambda n: (n["at"] < row["at"]) & (row["at"] < n["until"])))
            return N.bound(around, lambda a: self.value(rest[1], a, group))
        if kind == "match":
            return F.regexp_extract(self.value(rest[0], row, group), rest[1], 1)
        if kind == "without":
            return F.trim(F.regexp_replace(self.value(rest[0], row, group), rest[1], ""))
        if kind == "either":
            return F.coalesce(N.bound(self.value(rest[0], row, group), lambda v: F.nullif(v, F.lit(""))), self.value(rest[1], row, group))
        if kind == "url":
            return F.col("url")
        raise ValueError(f"not a spec: {spec!r}")

    def rows(self) -> Column:
        """An array of structs of the listing's fields."""
        x, s = self.listing, F.struct
        read = lambda group: lambda row: self.bound(row, lambda r: s(*[self.value(spec, r, group).alias(name) for name, spec in x.fields.items()]))
        if not x.group:
            nothing = F.get(F.slice(self.nodes, 1, 0), F.lit(0))
            return F.transform(N.selected(self.nodes, x.rows), read(nothing))
        groups = N.selected(self.nodes, x.group)
        groups = F.slice(groups, 1, 1) if x.only_first else groups

        def of_group(group: Column) -> Column:
            scope = N.first(F.filter(N.selected(self.nodes, x.sibling), lambda n: (n["parent"] == group["parent"]) & (n["at"] > group["at"]))) if x.sibling else group
            rows = N.bound(scope, lambda g: self.found(g, x.rows))
            rows = F.filter(rows, lambda r: F.size(self.cells(r)) >= x.least) if x.least else rows
            if not any(spec[0] == "column" or spec[0] == "either" for spec in x.fields.values()):
                return F.transform(rows, read(group))
            return N.bound(self.places(group), lambda p: F.transform(rows, read(F.struct(*[group[c].alias(c) for c in ("at", "until", "parent", "first", "last")], p.alias("places")))))

        return F.flatten(F.transform(groups, of_group))


EXTRA = ["closing_time"]


def listed(noded: DataFrame, platform: str, today: date, *more: str) -> DataFrame:
    """ADP-01, 10, 15, 18, 22, 31 and 32: the vacancies (extraction.FIELDS and closing_time) that pages (url, slug, nodes, strings) of a platform list.

    A row without what the listing needs is none; of rows of one page with one address the first counts. A page with a null
    or empty text lists nothing. more names further columns of the pages to come along.
    """
    names = {c for _, x in SITES[platform] for c in x.fields}

    def counted(x: Listing) -> Column:
        whole = F.transform(_Reader(x).rows(), lambda r: F.struct(*[(r[c] if c in x.fields else F.lit("")).alias(c) for c in sorted(names)]))
        kept = F.filter(whole, lambda r: _counts(r, x))
        return kept if x.otherwise is None else N.bound(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(counted(x.otherwise)))

    found, rest = F, None
    for mark, x in SITES[platform]:
        kept = counted(x)
        if mark:
            found = found.when(F.size(N.selected(F.col("nodes"), mark)) > 0, kept)
        else:
            rest = kept
    rows = noded.select("url", "slug", *more, F.posexplode(rest if found is F else found.otherwise(rest)).alias("place", "r"))
    get = lambda c: F.col(f"r.{c}") if c in names else F.lit("")
    out = rows.select(
        "url", "place", *more, pages.absolute(F.col("url"), get("source_url")).alias("source_url"), F.col("slug").alias("institution_slug"), F.lit("HTML").alias("strategy"), get("closing_time").alias("closing_time"),
        *[get(c).alias(c) for c in FIELDS if c not in ("source_url", "institution_slug", "strategy", *pages.DATES)],
        *[(pages.uk_date(get(short), today) if short in names else F.lit(None).cast("date")).alias(c) for c, short in (("posted_date", "posted"), ("closing_date", "closing"))],
    )
    if platform == "GENERIC_CARD_SCRAPE":  # several adverts of one page of prose share its address
        return out.select(*FIELDS, *EXTRA, *more)
    first = out.groupBy("url", "institution_slug", "source_url", *more).agg(F.min_by(F.struct(*[F.col(c) for c in (*FIELDS, *EXTRA) if c not in ("institution_slug", "source_url")]), "place").alias("v"))
    return first.select("source_url", "institution_slug", *more, "v.*").select(*FIELDS, *EXTRA, *more)


def _counts(row: Column, listing: Listing) -> Column:
    out = F.lit(True)
    for c in listing.needs:
        out = out & (row[c] != "")
    if listing.address:
        out = out & row["source_url"].rlike(listing.address)
    return out & pages.vacancy_link(row["title"], row["source_url"]) if listing.plausible else out


def stonefish_listing(careers_url: Column) -> Column:
    """ADP-01: the address of the listing of all categories, whatever page of the portal is known."""
    bare = F.regexp_replace(careers_url, r"[?#].*$", "")
    page = F.when(bare.rlike(r"(?i)^[a-z]+://[^/]+/(?:[^/]*/)*[^/]*\.aspx$"), F.regexp_replace(bare, r"[^/]+$", "vacancies.aspx"))
    return F.concat(F.coalesce(page, F.concat(F.regexp_replace(bare, "/+$", ""), F.lit("/vacancies.aspx"))), F.lit("?cat=-1"))
