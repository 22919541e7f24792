"""A stored positional index for the search ladder: searches read the postings of their own words and letters, and no text.

A posting is (jobs, title_words, positions) of a key of a kind: the jobs that have the key at just these places, each as its
distance from the row's first in two bytes. Kind 0 are stems of all that full-text search reads, at their word numbers; the
title's words come first, so a phrase stands in the title if it ends within title_words (0 in other kinds). Kinds 1 to 4 are
the three letters at each place of the lower-cased title, department, institution's name and description; a shorter text is a
key itself. So phrases and substrings alike are keys at fixed distances.

A row holds a key's postings of one lot of jobs, of about a million places, and of one window of 32,768 job_ids. Rows lie by
bucket of their key, sorted, a bucket's windows spread over several files, so that a word of most jobs makes no task that
reads or writes them all. The index is built for a snapshot of jobs; job_id is unique in it. Job_ids far apart cost a row each.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import lexemes
from larkspur.sources import lineage

_FIELDS = ["title", "department", "name", "description_text"]
_WORDS, _TITLE, _DEPARTMENT, _NAME, _DESCRIPTION = range(5)
_SCHEMA = "kind tinyint, key string, first long, postings array<struct<jobs:array<smallint>,title_words:int,positions:array<int>>>"
_PLACES = pa.list_(pa.int32())
_JOBS = pa.list_(pa.int16())
_POSTING = pa.struct([("jobs", _JOBS), ("title_words", pa.int32()), ("positions", _PLACES)])
_ARROW = pa.schema([("kind", pa.int8()), ("key", pa.string()), ("first", pa.int64()), ("postings", pa.list_(_POSTING))])
#: Bits of a job_id that a posting holds; the others are its row's.
_WINDOW = 15
#: Letters after which a task hands over what it has.
_LOT = 1_000_000


@dataclass(frozen=True)
class Index:
    """Where an index lies, and by how many buckets."""

    path: str
    buckets: int = 256


def _words(rows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """The stems of rows of lexemes: of each place the key's number, the row's number and the place in its row; and the keys."""
    numbers: dict[str, int] = {}
    words = [r.split(" ") for r in rows]
    code = np.array([numbers.setdefault(w, len(numbers)) for r in words for w in r], np.int64)
    owner, place = _places(np.array([len(r) for r in words]))
    kept = ~np.isin(code, [numbers.get("", -1), numbers.get("_", -1)])
    return code[kept], owner[kept], place[kept], list(numbers)


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """The triples of letters of texts, as in _words(); the whole of a shorter text."""
    sizes = np.array([len(t) for t in texts])
    letter = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64) + 1
    owner, place = _places(sizes)
    left = sizes[owner] - place
    after = lambda k: np.where(left > k, np.append(letter[k:], np.zeros(min(k, len(letter)), np.int64)), 0)
    kept = (left > 2) | (place == 0)
    triple = (letter << 42 | after(1) << 21 | after(2))[kept]
    different, code = np.unique(triple, return_inverse=True)
    keys = ["".join(chr((t >> shift & 0x1FFFFF) - 1) for shift in (42, 21, 0) if t >> shift & 0x1FFFFF) for t in different.tolist()]
    return code.astype(np.int64), owner[kept], place[kept], keys


def _places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _rows(kind: int, jobs: np.ndarray, title_words: np.ndarray, found) -> pa.RecordBatch:
    """A row for each key and each window of job_ids, with a posting for each of the ways in which jobs have the key."""
    code, owner, place, keys = found
    order = np.argsort(code, kind="stable")
    code, owner, place = code[order], owner[order], place[order]
    at = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])))
    size = np.diff(np.append(at, len(code)))
    code, owner = code[at], owner[at]
    inside = title_words[owner] if kind == _WORDS else np.zeros(len(owner), np.int32)
    windows, window = np.unique(jobs[owner] >> _WINDOW, return_inverse=True)
    row = code * len(windows) + window
    # Jobs with the same places come to lie side by side; whether they are the same is then looked up.
    mixed = (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = np.add.reduceat((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), at) + inside.astype(np.uint64)
    order = np.lexsort((mixed, row))
    at, size, code, owner, inside, row = (x[order] for x in (at, size, code, owner, inside, row))
    holder, step = _places(size)
    place = place[at[holder] + step]
    starts = np.cumsum(size) - size
    differs = np.logical_or.reduceat(place != place[np.maximum(np.arange(len(place)) - size[holder], 0)], starts)
    changed = lambda x: np.append(True, x[1:] != x[:-1])
    posting_at = np.flatnonzero(changed(row) | changed(size) | changed(inside) | differs)
    key_at = np.flatnonzero(changed(row))
    offsets = lambda at, n: pa.array(np.append(at, n).astype(np.int32))
    holder, step = _places(size[posting_at])
    ends = np.cumsum(size[posting_at])
    positions = pa.ListArray.from_arrays(offsets(ends - size[posting_at], ends[-1]), pa.array(place[starts[posting_at][holder] + step].astype(np.int32)), type=_PLACES)
    who = pa.ListArray.from_arrays(offsets(posting_at, len(owner)), pa.array((jobs[owner] & (1 << _WINDOW) - 1).astype(np.int16)), type=_JOBS)
    postings = pa.StructArray.from_arrays([who, pa.array(inside[posting_at]), positions], fields=list(_POSTING))
    lists = pa.ListArray.from_arrays(offsets(np.searchsorted(posting_at, key_at), len(posting_at)), postings, type=pa.list_(_POSTING))
    first = jobs[owner[key_at]] >> _WINDOW << _WINDOW
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key_at), kind, np.int8)), pa.array([keys[c] for c in code[key_at]], pa.string()), pa.array(first), lists], schema=_ARROW)


def _lot(rows: list[tuple]):
    for kind in range(_WORDS, _DESCRIPTION + 1):
        some = [r for r in rows if r[2 + kind]]
        if some:
            found = (_words if kind == _WORDS else _letters)([r[2 + kind] for r in some])
            if len(found[0]):
                yield _rows(kind, np.array([r[0] for r in some], np.int64), np.array([r[1] for r in some], np.int32), found)


def _postings(batches):
    rows, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            rows.append(row)
            size += sum(len(t or "") for t in row[2:])
            if size > _LOT:
                yield from _lot(rows)
                rows, size = [], 0
    yield from _lot(rows)


def build(jobs: DataFrame, path: str, buckets: int = 256, spread: int = 16) -> Index:
    """Writes the index of jobs (job_id, title, department, name, description_text) to path; nulls are read as empty texts.

    A shuffle brings the postings of a bucket to at most spread tasks, each with its share of the windows.
    """
    title = lexemes.lexemes(F.col("title"))
    count = F.when(F.coalesce(title, F.lit("")) == "", 0).otherwise(F.size(F.split(title, " "))).cast("int")
    dealt = lineage.spread(jobs.select(F.col("job_id").cast("long"), *_FIELDS), "job_id")  # neighbours stay together, so that windows are few
    read = dealt.select("job_id", count.alias("title_words"), lexemes.lexemes(F.concat_ws(" ", *_FIELDS)).alias("words"), *[F.lower(c).alias(c) for c in _FIELDS])
    jobs.select(F.col("job_id").cast("long")).write.parquet(f"{path}/jobs", mode="overwrite")
    rows = read.mapInArrow(_postings, _SCHEMA).withColumn("bucket", (F.crc32(F.col("key").cast("binary")) % buckets).cast("int"))
    placed = rows.repartition("bucket", F.pmod(F.xxhash64("first"), F.lit(spread))).sortWithinPartitions("bucket", "key", "kind")
    placed.write.partitionBy("bucket").parquet(f"{path}/postings", mode="overwrite", compression="zstd")
    return Index(path, buckets)


def _keys(q: str) -> list[tuple[int, str]]:
    """Triples that cover a text of three letters or more, with their places."""
    return [(k, q[k : k + 3]) for k in sorted({*range(0, len(q) - 2, 3), len(q) - 3})]


def _starts(kind: int, keys: list[tuple[int, str]]) -> Column:
    """Where all keys stand at their distances; null if one isn't there at all."""
    starts = lambda k, key: F.transform(F.try_element_at("places", F.lit(f"{kind}:{key}")), lambda p: p - k)
    return reduce(F.array_intersect, [starts(k, key) for k, key in keys])


def found(spark: SparkSession, index: Index, query: str) -> DataFrame:
    """STR-15 to 17: (job_id, relevance) of the jobs that any rung of search.ladder() finds; a blank query finds all with 0.

    A search of one or two letters reads all keys that contain them, any other only the buckets of its keys. All jobs are
    looked at only where an alternative asks for nothing but absence.
    """
    everyone = spark.read.parquet(f"{index.path}/jobs")
    term = query.strip()
    if not term:
        return everyone.withColumn("relevance", F.lit(0))
    either, q = lexemes.alternatives(term), term.lower()
    stems, letters = sorted({w for e in either for row, _ in e for w in row if w != "_"}), _keys(q) if len(q) > 2 else []
    triples = sorted({key for _, key in letters})
    postings = spark.read.schema(_SCHEMA + ", bucket int").parquet(f"{index.path}/postings")
    in_buckets = lambda keys: F.col("bucket").isin(sorted({zlib.crc32(k.encode()) % index.buckets for k in keys})) & F.col("key").isin(keys)
    word = F.col("kind") == _WORDS
    letter = ~word & (in_buckets(triples) if letters else F.contains("key", F.lit(q)))
    kept = (word & in_buckets(stems) | letter) if stems else letter
    if letters:
        kept = in_buckets(stems + triples) & kept
    place = F.struct(F.concat_ws(":", F.col("kind").cast("string"), "key"), "positions")
    each = postings.where(kept).select("kind", "key", "first", F.inline("postings")).select("kind", "key", "title_words", "positions", "first", F.explode("jobs").alias("job"))
    seen = each.withColumn("job_id", F.col("first") + F.col("job")).groupBy("job_id").agg(
        F.map_from_entries(F.collect_list(F.when(word | F.lit(bool(letters)), place))).alias("places"), F.max("title_words").alias("title_words"),
        *[F.bool_or(F.col("kind") == k).alias(f"short_{k}") for k in range(_TITLE, _DESCRIPTION + 1)],
    )

    def phrase(row: list[str], inside_title: bool) -> Column:
        starts = _starts(_WORDS, [(k, w) for k, w in enumerate(row) if w != "_"])
        return F.coalesce(F.exists(starts, lambda s: s + len(row) <= F.col("title_words")) if inside_title else F.size(starts) > 0, F.lit(False))

    def by_words(inside_title: bool) -> Column:
        out = F.lit(False)
        for e in either:
            both = F.lit(True)
            for row, absent in e:
                both = both & (~phrase(row, inside_title) if absent else phrase(row, inside_title))
            out = out | both
        return out

    def by_letters(kind: int) -> Column:
        return F.coalesce(F.size(_starts(kind, letters)) > 0 if letters else F.col(f"short_{kind}"), F.lit(False))

    if any(all(absent for _, absent in e) for e in either):
        seen = everyone.join(seen, "job_id", "left")
    rungs = [(5, by_words(True)), (4, by_letters(_TITLE)), (3, by_letters(_DEPARTMENT) | by_letters(_NAME)), (2, by_words(False)), (1, by_letters(_DESCRIPTION))]
    relevance = reduce(lambda out, r: out.when(r[1], r[0]), rungs, F).otherwise(0)
    return seen.select("job_id", relevance.alias("relevance")).where("relevance > 0")


def searched(jobs: DataFrame, index: Index, query: str) -> DataFrame:
    """search.searched() by way of the index: jobs that are found, with their relevance."""
    return jobs.join(found(jobs.sparkSession, index, query), "job_id")
