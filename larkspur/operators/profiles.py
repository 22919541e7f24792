"""What a CV's text claims, by the vocabulary and in the CV's own skills section, and how it changes a profile."""

from __future__ import annotations

import zipfile
from io import BytesIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import fitness, phrases
from larkspur.functions.nodes import bound

# How much of a CV is read, the longest item and the most items of its own list, signs between items, most bytes of an opened file.
MOST_TEXT, LONGEST_ITEM, MOST_ITEMS, SIGNS, MOST_BYTES = 400_000, 40, 150, "[,;•|]", 50 * 1024 * 1024
# Headings of a skills section, lines with a label, and claims of years.
HEADING = r"(?i)^\s*(?:technical\s+skills|core\s+skills|key\s+skills|skills(?:\s*(?:&|and)\s*(?:tools|expertise))?)\s*:?\s*$"
#: Spellings that one automaton holds.
SPELLINGS = 50_000
LABELLED = r"^[ \t]*[A-Za-z][A-Za-z /&\-]{1,40}:[ \t]*(.+\S)\s*$"
CLAIM = r"(?i)(\d{1,2})\s*\+?\s*(?:years?|yrs?)(?:['’]?s?)?\s+(?:of\s+)?(?:[a-z]+\s+){0,3}?(?:experience|exp\b)"
KINDS = {"skill": "skills", "domain": "domains", "seniority": "seniority", "project": "projects", "education": "education"}


def file_format(content: Column) -> Column:
    """CV-05: by the first bytes; null for anything else."""
    return F.when(F.substring(content, 1, 5) == F.lit(b"%PDF-"), "pdf").when(F.substring(content, 1, 4) == F.lit(b"PK\x03\x04"), "docx")


def opened_size(content: Column) -> Column:
    """SRC-12: bytes that a zip container would open to, by its directory; null for what is none. More than MOST_BYTES is refused."""

    @F.pandas_udf("long")
    def sizes(files):
        def size(raw):
            try:
                return sum(i.file_size for i in zipfile.ZipFile(BytesIO(raw)).infolist())
            except (zipfile.BadZipFile, TypeError):
                return None

        return files.map(size).astype("Int64")

    return sizes(content)


def claimed_years(text: Column) -> Column:
    """CV-04: the largest claim; 0 for none."""
    found = F.transform(F.regexp_extract_all(F.lower(text), F.lit(CLAIM), 1), lambda x: x.cast("int"))
    return F.coalesce(F.array_max(found), F.lit(0))


def declared_skills(text: Column) -> Column:
    """CV-02 and 03: what stands under the CV's own skills headings, each item once, as first written.

    Lines are folded one by one: a heading opens the section; a line without a label and without signs between items, or two
    blank lines, ends it for good.
    """
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"), F.trim)
    state = F.struct(F.lit(0).alias("open"), F.lit(0).alias("blank"), F.array().cast("array<string>").alias("items"))  # open: 0 not yet, 1 inside, 2 over
    label = lambda x: F.get(F.regexp_extract_all(x, F.lit(LABELLED), F.lit(1)), F.lit(0))
    read = lambda x: F.struct(x.rlike(HEADING).alias("heading"), (x == "").alias("blank"), F.coalesce(label(x), F.when(x.rlike(SIGNS), x)).alias("item"))

    def step(s: Column, line: Column) -> Column:
        inside, heading, blank, item = s["open"] == 1, line["heading"], line["blank"], line["item"]
        over = F.when(blank, s["blank"] + 1 >= 2).otherwise(item.isNull())
        opened = F.when(s["open"] == 2, 2).when(heading, 1).when(inside & over, 2).otherwise(s["open"])
        blanks = F.when(blank & ~heading, s["blank"] + 1).otherwise(0)
        take = inside & ~heading & ~blank & item.isNotNull()
        return F.struct(opened.alias("open"), blanks.alias("blank"), F.when(take, F.array_append(s["items"], item)).otherwise(s["items"]).alias("items"))

    found = F.aggregate(F.transform(lines, read), state, step, lambda s: s["items"])
    parts = F.flatten(F.transform(found, lambda i: F.split(F.regexp_replace(i, "[()]", ","), SIGNS)))
    items = F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^[ \t.]+|[ \t.]+$", "")), lambda p: (p != "") & (F.length(p) <= LONGEST_ITEM))
    # sections are read once and items lowered once, however many there are
    once = lambda own, low: F.transform(F.slice(F.array_distinct(low), 1, MOST_ITEMS), lambda p: F.get(own, F.array_position(low, p).cast("int") - 1))
    return bound(items, lambda own: bound(F.transform(own, F.lower), lambda low: once(own, low)))


def vocabulary_hits(cvs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """CV-01: (cv_id, kind, canonical, position) of vocabulary terms (position, canonical, kind, aliases) that a CV spells as whole words.

    All spellings are looked for in one pass over each CV; a vocabulary beyond SPELLINGS is taken in parts.
    """
    spelled = vocabulary.select("position", "canonical", "kind", F.explode(F.array_distinct(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("spelling"))
    spelled = spelled.where("trim(spelling) <> ''")
    parts = -(-spelled.count() // SPELLINGS)
    text = F.regexp_replace(F.substring("text", 1, MOST_TEXT), r"(?U)\s+", " ")
    out = cvs.select("cv_id").join(spelled.select("kind", "canonical", "position").where("false"), F.lit(False))
    for k in range(parts):
        rows = spelled.where(F.pmod(F.xxhash64("position", "spelling"), F.lit(parts)) == k).collect()
        terms = cvs.sparkSession.createDataFrame([(i, r.kind, r.canonical, r.position) for i, r in enumerate(rows)], f"k int, kind string, canonical string, position {vocabulary.schema['position'].dataType.simpleString()}")
        found = cvs.select("cv_id", F.explode(phrases.phrases_in(text, [r.spelling for r in rows])).alias("k"))
        out = out.unionByName(found.join(F.broadcast(terms), "k").drop("k"))
    return out.distinct()


def parsed(cvs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """CV-07: (cv_id, skills, domains, seniority, projects, education, years_experience) suggested by cvs (cv_id, text).

    Lists follow the vocabulary's order; skills go on with what the CV itself declares and the vocabulary doesn't name.
    """
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", "canonical"))), lambda x: x["canonical"])
    by_kind = vocabulary_hits(cvs, vocabulary.where("is_active")).groupBy("cv_id").pivot("kind", list(KINDS)).agg(listed)
    none = F.array().cast("array<string>")
    text = F.substring("text", 1, MOST_TEXT)
    own = cvs.select("cv_id", declared_skills(text).alias("declared"), claimed_years(F.regexp_replace(text, r"(?U)\s+", " ")).alias("years_experience"))
    both = own.join(by_kind, "cv_id", "left").select("cv_id", "declared", "years_experience", *[F.coalesce(k, none).alias(name) for k, name in KINDS.items()])
    more = bound(F.transform("skills", F.lower), lambda lowered: F.filter("declared", lambda d: ~F.array_contains(lowered, F.lower(d))))
    return both.select("cv_id", F.concat("skills", more).alias("skills"), "domains", "seniority", "projects", "education", "years_experience")


def missing_terms(cvs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """CV-01: (cv_id, missing): how many active terms a CV doesn't spell."""
    n = vocabulary.where("is_active").select("canonical").distinct().count()
    found = vocabulary_hits(cvs, vocabulary.where("is_active")).groupBy("cv_id").agg(F.count_distinct("canonical").alias("found"))
    return cvs.select("cv_id").join(found, "cv_id", "left").select("cv_id", (F.lit(n) - F.coalesce("found", F.lit(0))).cast("long").alias("missing"))


def merged(old: Column, new: Column) -> Column:
    """SET-09: old and then what is new, each once."""
    return F.array_distinct(F.concat(old, new))


def applied(profiles: DataFrame, suggestions: DataFrame, replace: bool = False) -> DataFrame:
    """CV-06: profiles (owner, lists, years_experience) with confirmed suggestions merged in or put in their place; years never fall."""
    s = suggestions.select("owner", *[F.col(c).alias(f"s_{c}") for c in [*fitness.LISTS, "years_experience"]])
    both = profiles.join(s, "owner", "full_outer")
    none = F.array().cast("array<string>")
    own, new = lambda c: F.coalesce(F.col(c), none), lambda c: F.coalesce(F.col(f"s_{c}"), none)
    changed = {c: F.when(F.col("s_years_experience").isNull(), own(c)).otherwise(new(c) if replace else merged(own(c), new(c))) for c in fitness.LISTS}
    years = F.greatest(F.coalesce("years_experience", F.lit(0)), F.coalesce("s_years_experience", F.lit(0)))
    return both.select("owner", *[c.alias(n) for n, c in changed.items()], years.alias("years_experience"))
