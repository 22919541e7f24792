"""A page's elements as rows that Columns can search: CSS-like selectors compile to predicates over an array of nodes.

A page is flattened once, in Arrow batches: its elements in document order, each with its parent, where its own part ends, its
attributes and the stretch of the page's strings that it holds. Everything after that runs in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions import pages

_NODE = T.StructType([
    T.StructField("at", T.IntegerType()), T.StructField("until", T.IntegerType()), T.StructField("parent", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("tag", T.StringType()),
    T.StructField("attributes", T.MapType(T.StringType(), T.StringType())), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()),
])
_ARROW = pa.list_(pa.struct([("at", pa.int32()), ("until", pa.int32()), ("parent", pa.int32()), ("place", pa.int32()), ("tag", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("first", pa.int32()), ("last", pa.int32())]))
_SILENT = ("script", "style", "template")
#: Pages that are handed over at a time.
_PAGES = 1_000


class _Flat(HTMLParser):
    """A page's elements in document order, a list for each of their columns, and its strings without white space around them; scripts and styles say nothing."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.until, self.parent, self.place, self.tag, self.first, self.last = [], [], [], [], [], []
        self.names, self.values, self.attributes = [], [], []
        self.strings: list[str] = []
        self.open: list[int] = []
        self.places: dict[tuple[int, str], int] = {}

    def handle_starttag(self, tag, attrs):
        open_ = self.open
        if open_ and tag in pages.SELF_CLOSED and self.tag[open_[-1]] == tag:
            self._end(open_.pop())
        at, parent = len(self.tag), open_[-1] if open_ else -1
        place = self.places[parent, tag] = self.places.get((parent, tag), 0) + 1
        self.tag.append(tag)
        self.parent.append(parent)
        self.place.append(place)
        self.first.append(len(self.strings))
        self.last.append(len(self.strings))
        self.until.append(at + 1)
        if attrs:
            each = {k: v or "" for k, v in attrs}
            self.names += each
            self.values += each.values()
            self.attributes.append(len(each))
        else:
            self.attributes.append(0)
        if tag not in pages.VOID:
            open_.append(at)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.tag[self.open[k]] == tag:
                for at in self.open[k:]:
                    self._end(at)
                del self.open[k:]
                return

    def handle_data(self, data):
        said = data.strip()
        if said and not (self.open and self.tag[self.open[-1]] in _SILENT):
            self.strings.append(said)

    def updatepos(self, i, j):  # nobody asks for lines and columns
        return j

    def _end(self, at: int) -> None:
        self.until[at], self.last[at] = len(self.tag), len(self.strings)

    def end(self) -> _Flat:
        for at in self.open:
            self._end(at)
        return self


def flattened(html: str | None) -> _Flat:
    flat = _Flat()
    if not pages.read_plain(html or "", flat):
        flat = _Flat()
        flat.feed(html or "")
        flat.close()
    return flat.end()


def _columns(each: list[_Flat]) -> tuple[pa.Array, pa.Array]:
    """nodes and strings of pages, without an object for each node."""
    whole = lambda name, kind=None: pa.array(list(chain.from_iterable(getattr(f, name) for f in each)), kind or pa.int32())
    offsets = lambda sizes: pa.array(np.append(0, np.cumsum(np.array(sizes, np.int64))).astype(np.int32))
    sizes = np.array([len(f.tag) for f in each], np.int64)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    attributes = pa.MapArray.from_arrays(offsets(list(chain.from_iterable(f.attributes for f in each))), whole("names", pa.string()), whole("values", pa.string()))
    columns = [pa.array(at.astype(np.int32)), whole("until"), whole("parent"), whole("place"), whole("tag", pa.string()), attributes, whole("first"), whole("last")]
    nodes = pa.ListArray.from_arrays(offsets(sizes), pa.StructArray.from_arrays(columns, fields=list(_ARROW.value_type)), type=_ARROW)
    return nodes, pa.ListArray.from_arrays(offsets([len(f.strings) for f in each]), whole("strings", pa.string()))


def noded(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with nodes and strings in place of html."""
    rest = [c for c in pages.columns if c != html]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, _PAGES):
                some = b.slice(k, _PAGES)
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in rest), *_columns([flattened(t) for t in some.column(html).to_pylist()])], [*rest, "nodes", "strings"])

    schema = T.StructType([pages.schema[c] for c in rest]).add("nodes", T.ArrayType(_NODE)).add("strings", T.ArrayType(T.StringType()))
    return pages.mapInArrow(rows, schema)


_COMPOUND = re.compile(r"(\w+|\*)?((?:#[\w-]+|\.[\w-]+|\[[^\]]+\])*)(?::nth-of-type\((\d+)\))?$")
_TEST = re.compile(r"#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:([~^*]*=)\"?([^\]\"]*)\"?)?\]")


def _compound(text: str):
    """The predicate of one compound selector: a tag, #id, .class, [name], [name=value], [name~=word], [name^=start], [name*=part], [name~^=start of a word], and behind these :nth-of-type(k)."""
    found = _COMPOUND.match(text)
    if not found or not text:
        raise ValueError(f"not a selector: {text!r}")
    tag, tests = found[1], _TEST.findall(found[2])

    def holds(n: Column) -> Column:
        out = F.lit(True) if tag in (None, "", "*") else n["tag"] == tag
        out = out & (n["place"] == int(found[3])) if found[3] else out
        get = lambda name: F.coalesce(F.element_at(n["attributes"], name), F.lit(""))
        word = lambda name, value: F.array_contains(F.split(get(name), r"\s+"), value)
        for name, group, attribute, sign, value in tests:
            if name:
                out = out & (get("id") == name)
            elif group:
                out = out & word("class", group)
            elif not sign:
                out = out & F.map_contains_key(n["attributes"], attribute)
            elif sign == "=":
                out = out & (get(attribute) == value)
            else:
                starts = (lambda v: lambda x: x.startswith(v))(value)
                out = out & (word(attribute, value) if sign == "~=" else F.exists(F.split(get(attribute), r"\s+"), starts) if sign == "~^=" else get(attribute).startswith(value) if sign == "^=" else get(attribute).contains(value))
        return out

    return holds


def selected(nodes: Column, selector: str) -> Column:
    """The nodes that a selector names, in document order: compounds with a space (inside) or > (child) between them, alternatives parted by commas."""
    ways = []
    for way in selector.split(","):
        steps = re.sub(r"\s*>\s*", " >", way.strip()).split()
        ways.append([(step.startswith(">"), _compound(step.removeprefix(">"))) for step in steps])

    def holds(n: Column, way: list, k: int) -> Column:
        child, test = way[k]
        if not k:
            return test(n)
        near = (lambda a: a["at"] == n["parent"]) if child else (lambda a: (a["at"] < n["at"]) & (n["at"] < a["until"]))
        return test(n) & F.exists(nodes, lambda a: near(a) & holds(a, way, k - 1))

    def any_way(n: Column) -> Column:
        out = holds(n, ways[0], len(ways[0]) - 1)
        for way in ways[1:]:
            out = out | holds(n, way, len(way) - 1)
        return out

    return F.filter(nodes, any_way)


def inside(nodes: Column, node: Column) -> Column:
    """The nodes inside one of all of a page's nodes; none for a null node."""
    return F.coalesce(F.slice(nodes, node["at"] + 2, node["until"] - node["at"] - 1), F.filter(nodes, lambda _: F.lit(False)))


def bound(value: Column, use) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first(found: Column) -> Column:
    return F.get(found, F.lit(0))


def last(found: Column) -> Column:
    return F.try_element_at(found, F.lit(-1))


def lines(strings: Column, node: Column) -> Column:
    """The strings that a node holds; none for a null node."""
    return F.coalesce(F.slice(strings, node["first"] + 1, node["last"] - node["first"]), F.array().cast("array<string>"))


def said(strings: Column, node: Column) -> Column:
    """A node's text in one line; empty for a null node."""
    return F.trim(F.regexp_replace(F.array_join(lines(strings, node), " "), r"\s+", " "))


def attribute(node: Column, name: str) -> Column:
    """Empty where the node or the attribute is missing."""
    return F.coalesce(F.element_at(node["attributes"], name), F.lit(""))
