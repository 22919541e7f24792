"""Names, queries and advert texts as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no identity, and legal suffixes.
STOPWORDS = ["the", "of", "and", "for", "at", "in", "a", "an"]
GENERIC = [
    "university", "universities", "college", "school", "institute", "institution", "academy", "conservatoire", "higher", "education", "corporation",
    "limited", "ltd", "plc", "llp", "cic", "cio", "trust", "group", "hr", "uk", "united", "kingdom",
]
SUFFIXES = [
    r"\bhigher education corporation\b", r"\bhigher education institution\b", r"\b(?:co(?:mpany)?\s*)?limited\b", r"\bltd\b", r"\bplc\b", r"\bllp\b", r"\bcic\b", r"\bcio\b", r"\bincorporated\b",
]
# Words left out of search terms.
QUERY_STOPWORDS = [
    "a", "an", "and", "any", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "the", "to", "with",
    "job", "jobs", "role", "roles", "vacancy", "vacancies", "position", "positions", "uk",
]
# Phrases by which an advert rules sponsorship out.
EXCLUSIONS = [
    "does not meet the minimum requirements for visa sponsorship", "does not meet the requirements for visa sponsorship", "not eligible for visa sponsorship",
    "not eligible for sponsorship under the skilled worker", "this role is not eligible for sponsorship", "this post is not eligible for sponsorship",
    "we are unable to offer visa sponsorship", "we are unable to sponsor", "unable to offer sponsorship", "cannot offer visa sponsorship", "cannot offer sponsorship",
    "no sponsorship is available", "sponsorship is not available", "visa sponsorship is not available", "does not attract visa sponsorship", "does not attract sponsorship",
]


#: All of them have it.
_SHARED = "sponsor"
assert all(_SHARED in p for p in EXCLUSIONS)


def _folding() -> tuple[str, str]:
    """Lower-case letters whose canonical decomposition is an ASCII letter and combining marks, and those letters."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))) for c in range(0xC0, 0x2000)]
    kept = [(c, d[0]) for c, d in pairs if c.islower() and len(d) > 1 and d[0].isascii() and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(c for c, _ in kept), "".join(p for _, p in kept)


_ACCENTED, _PLAIN = _folding()


# What is taken out of captured pages, and what stands there instead.
REDACTIONS = [
    (r"[\w.+-]+@[\w-]+\.[\w.-]+", "redacted@example.ac.uk"), (r"\+44\s?\(?0?\)?[\d\s-]{9,13}", "+44 000 000 0000"),
    (r"\b0\d{3}\s?\d{3}\s?\d{4}\b", "0000 000 0000"), (r"AIza[0-9A-Za-z_-]{35}", "REDACTED-API-KEY"),
]


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_accents(c: Column) -> Column:
    """STR-01, of lower-cased text: accented Latin letters and combining marks; ß becomes ss as under case folding."""
    return F.regexp_replace(F.translate(F.replace(c, F.lit("ß"), F.lit("ss")), _ACCENTED, _PLAIN), r"\p{Mn}+", "")


def normalise_name(c: Column) -> Column:
    """STR-02: accents, case, brackets, &, punctuation, legal suffixes and a leading The go, in this order."""
    c = strip_accents(F.lower(c))
    c = F.regexp_replace(c, r"\([^)]*\)", " ")
    c = F.replace(c, F.lit("&"), F.lit(" and "))
    c = collapse(F.regexp_replace(c, r"(?U)[^\w\s]", " "))
    for suffix in SUFFIXES:
        c = F.regexp_replace(c, suffix, " ")
    return F.regexp_replace(collapse(c), r"^the\s+", "")


def tokens(normalised: Column) -> Column:
    return F.filter(F.split(normalised, " "), lambda t: t != "")


def core_tokens(normalised: Column) -> Column:
    """STR-04: the identifying words, in alphabetical order."""
    return F.array_sort(F.array_except(tokens(normalised), F.array(*map(F.lit, STOPWORDS + GENERIC))))


def acronym(normalised: Column) -> Column:
    words = F.filter(tokens(normalised), lambda t: ~t.isin(STOPWORDS))
    return F.array_join(F.transform(words, lambda t: F.substring(t, 1, 1)), "")


def looks_like_acronym(name: Column) -> Column:
    return F.trim(name).rlike(r"^\p{Lu}{2,6}$")


def name_similarity(left: Column, right: Column) -> Column:
    """STR-06 over names as written."""
    ln, rn = normalise_name(left), normalise_name(right)
    lc, rc = core_tokens(ln), core_tokens(rn)
    shared = F.size(F.array_intersect(lc, rc))
    contained = shared / F.least(F.size(lc), F.size(rc))
    jaccard = shared / F.size(F.array_union(lc, rc))

    def short(name: Column, other: Column) -> Column:
        return F.when(looks_like_acronym(name) & F.startswith(acronym(other), F.lower(F.trim(name))), 0.9).otherwise(0.0)

    score = F.greatest(short(left, rn), short(right, ln), 0.75 * contained + 0.25 * jaccard)
    return F.when((F.size(lc) == 0) | (F.size(rc) == 0), 0.0).when(lc == rc, 1.0).otherwise(score)


def trigrams(c: Column) -> Column:
    """STR-07: distinct trigrams of each word, two spaces before it and one after."""
    words = F.filter(F.split(F.regexp_replace(F.lower(c), r"(?U)[^\w]+", " "), " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    cut = F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))
    return F.array_distinct(F.flatten(cut))


def trigram_similarity(left: Column, right: Column) -> Column:
    """STR-07: shared trigrams over all trigrams of both; 0 where neither has any."""
    a, b = trigrams(left), trigrams(right)
    both = F.get(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda g: F.struct(F.size(F.array_intersect(g["a"], g["b"])).alias("n"), (F.size(g["a"]) + F.size(g["b"])).alias("m"))), F.lit(0))
    return F.get(F.transform(F.array(both), lambda x: F.when(x["m"] > 0, x["n"] / (x["m"] - x["n"])).otherwise(0.0)), F.lit(0))


def normalise_query(c: Column) -> Column:
    """STR-13: collapsed, lower case, at most 200 characters."""
    return F.substring(F.lower(collapse(c)), 1, 200)


def search_terms(query: Column) -> Column:
    """STR-14: distinct terms in order; c++, c# and node.js stay whole."""
    found = F.regexp_extract_all(normalise_query(query), F.lit(r"[a-z0-9][a-z0-9+#.\-]*"), 0)
    trimmed = F.transform(found, lambda t: F.regexp_replace(t, r"^[.\-]+|[.\-]+$", ""))
    return F.array_distinct(F.filter(trimmed, lambda t: (F.length(t) >= 2) & ~t.isin(QUERY_STOPWORDS)))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def exclusion_sentence(text: Column) -> Column:
    """STR-20 and 21: the first sentence that rules sponsorship out, cut around the phrase if long; null if none.

    Texts without the word that all phrases share are settled by one search for it.
    """

    def place(s: Column) -> Column:
        at = lambda lower: F.coalesce(*[F.when(F.locate(p, lower) > 0, F.struct(F.locate(p, lower).alias("at"), F.lit(len(p)).alias("n"))) for p in EXCLUSIONS])
        return once(F.lower(s), at)

    def cut(hit: Column) -> Column:
        s, at, n = hit["s"], hit["p"]["at"] - 1, hit["p"]["n"]
        start, end = F.greatest(F.lit(0), at - 110), F.least(F.length(s), at + n + 110)
        parts = F.concat(F.when(start > 0, "… ").otherwise(""), F.trim(F.substring(s, start + 1, end - start)), F.when(end < F.length(s), " …").otherwise(""))
        return F.when(F.length(s) <= 300, s).otherwise(parts)

    sentences = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.contains(F.lower(s), F.lit(_SHARED)))
    hits = F.filter(F.transform(sentences, lambda s: once(collapse(s), lambda c: F.struct(c.alias("s"), place(c).alias("p")))), lambda x: x["p"].isNotNull())
    return F.when(F.contains(F.lower(text), F.lit(_SHARED)), once(F.get(hits, F.lit(0)), cut))


def content_hash(*columns: str) -> Column:
    """STR-23: sha256 over trimmed fields, a unit separator after each."""
    return F.sha2(F.concat(*[F.concat(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("\x1f")) for c in columns]), 256)


def slugify(c: Column) -> Column:
    """STR-26: at most 120 characters."""
    plain = F.regexp_replace(F.regexp_replace(strip_accents(F.lower(c)), r"[^a-z0-9\s_-]", ""), r"[-\s]+", "-")
    return F.substring(F.regexp_replace(plain, "^[-_]+|[-_]+$", ""), 1, 120)


def redact(c: Column) -> Column:
    """SNK-10: e-mail addresses, phone numbers and API keys out of captured pages."""
    for pattern, instead in REDACTIONS:
        c = F.regexp_replace(c, pattern, instead)
    return c
