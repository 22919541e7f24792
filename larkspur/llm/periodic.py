"""Runs: stretches of words that repeat with a period at least EXPONENT times over, by the method of Kolpakov and Kucherov.

A suffix automaton gives the Lempel-Ziv factors of a text: each the longest stretch that also begins earlier. Main's algorithm
finds the runs that touch the border between two factors from lengths of common extensions around it. A run strictly inside a
factor also lies at the factor's earlier place, where it is known already, and is copied from there.

Most of a text can't be in any run. Four neighbouring words of a run stand again at the distance of its period, and that is at
most a quarter of the run. So regions are cut out first, for a batch of texts at once, in which every four words stand again
within a quarter of the region; a run is never cut. The method then goes over regions.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.shared import documents, small_batches

#: A run is at least so many times as long as its period, and at least so many words. regions() rests on these two.
EXPONENT, LEAST = 4, 6
_GRAM = 4
_FAR = np.iinfo(np.int64).max


def factors(w: list[int]) -> list[tuple[int, int, int]]:
    """(begin, end, earlier begin) of each Lempel-Ziv factor; a word seen for the first time is one with earlier begin -1."""
    after: list[dict[int, int]] = [{}]
    length, link, first = [0], [-1], [-1]
    last = 0
    for at, c in enumerate(w):
        new = len(length)
        after.append({})
        length.append(at + 1)
        link.append(0)
        first.append(at)
        state = last
        while state >= 0 and c not in after[state]:
            after[state][c] = new
            state = link[state]
        if state >= 0:
            to = after[state][c]
            if length[to] != length[state] + 1:
                copy = len(length)
                after.append(dict(after[to]))
                length.append(length[state] + 1)
                link.append(link[to])
                first.append(first[to])
                link[to] = copy
                while state >= 0 and after[state].get(c) == to:
                    after[state][c] = copy
                    state = link[state]
                to = copy
            link[new] = to
        last = new
    out, begin, n = [], 0, len(w)
    while begin < n:
        state, end = 0, begin
        while end < n and first[to := after[state][w[end]]] < end:
            state, end = to, end + 1
        if end == begin:
            out.append((begin, begin + 1, -1))
            begin += 1
        else:
            out.append((begin, end, first[state] - (end - begin) + 1))
            begin = end
    return out


def prefix_lengths(s: list[int]) -> list[int]:
    """For each place, how far what begins there agrees with the beginning of s; 0 for place 0."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def touching(w: list[int], border: int, before: int, behind: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the runs that begin at the border or cross it and end in the factor behind, or end at it and lie in the factor before.

    before and behind are the two factors' lengths. Were a run to reach further left than the factor before and one period, that
    factor would have been longer; so what is compared is linear in the two lengths.
    """
    if before + behind < LEAST - 1:
        return
    periods = (before + behind) // (EXPONENT - 1) + 1
    left, right = min(border, before + periods + 2), min(len(w) - border, behind + 1)
    back, ahead = min(periods, border), min(periods, right)
    forward = prefix_lengths([*w[border : border + right], -1, *w[border - back : border + right]])
    backward = prefix_lengths([*w[border - left : border][::-1], -1, *w[border - left : border + ahead][::-1]])
    seen = set()
    for p in range(1, periods + 1):
        found = []
        if p <= ahead:
            found.append((border - backward[left + 1 + ahead - p], border + p + (forward[p] if p < right else 0)))
        if p <= back:
            end = border + forward[right + 1 + back - p]
            if end - border < p:
                found.append((border - p - (backward[p] if p < left else 0), end))
        for start, end in found:
            if end - start < max(LEAST, EXPONENT * p) or end > border + behind or (start, end) in seen:
                continue
            if start == border - left > 0 or end == border and start <= border - before:
                continue
            seen.add((start, end))
            yield start, end, p


def runs(w: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, period) of every run of w, by start and period."""
    starts: list[int] = []
    at: dict[int, list[tuple[int, int]]] = {}

    def add(start: int, end: int, period: int) -> None:
        if start not in at:
            insort(starts, start)
            at[start] = []
        at[start].append((end, period))

    before = 0
    for begin, end, earlier in factors(w):
        for run in touching(w, begin, before, end - begin):
            add(*run)
        if earlier >= 0 and end - begin > LEAST:
            shift, k = begin - earlier, bisect_right(starts, earlier)
            while k < len(starts) and starts[k] < end - shift:
                start = starts[k]
                for stop, period in at[start]:
                    if stop < end - shift:
                        add(start + shift, stop + shift, period)
                k += 1
        before = end - begin
    for run in touching(w, len(w), before, 0):
        add(*run)
    return sorted((start, end, period) for start in starts for end, period in at[start])


def regions(hashes: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of stretches outside which no run lies, each within a text; hashes are the words' of all texts in a row, ends where texts end."""
    n = len(hashes) - _GRAM + 1
    if n < LEAST - _GRAM + 1:
        return []
    h = hashes.astype(np.uint64)
    text = np.repeat(np.arange(len(ends), dtype=np.uint64), np.diff(ends, prepend=0))
    gram = text[:n] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(_GRAM):
        gram = (gram ^ h[k : k + n]) * np.uint64(0xBF58476D1CE4E5B9)
        gram ^= gram >> np.uint64(29)
    whole = text[:n] == text[_GRAM - 1 :]
    order = np.argsort(gram, kind="stable")
    gap = np.where(gram[order[1:]] == gram[order[:-1]], np.diff(order), _FAR)
    near = np.full(n, _FAR)
    near[order[1:]] = gap
    near[order[:-1]] = np.minimum(near[order[:-1]], gap)
    marked = whole & (near < _FAR)
    while True:
        edge = np.flatnonzero(np.diff(np.concatenate(([False], marked, [False])).astype(np.int8)))
        begin, end = edge[::2], edge[1::2] + _GRAM - 1
        size = end - begin
        limit = np.zeros(n, np.int64)
        limit[marked] = np.repeat(np.where(size >= LEAST, size // EXPONENT, 0), size - _GRAM + 1)
        fewer = marked & (near <= limit)
        if fewer.sum() == marked.sum():
            return list(zip(begin.tolist(), end.tolist()))
        marked = fewer


def runs_of_texts(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, end, period) of every run of each text's words, by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    words = [x for t in texts for x in t]
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    for begin, end in regions(np.fromiter(map(hash, words), np.int64, len(words)), ends):
        known: dict[bytes, int] = {}
        found = runs([known.setdefault(x, len(known)) for x in words[begin:end]])
        k = int(np.searchsorted(ends, begin, side="right"))
        first = begin - (int(ends[k - 1]) if k else 0)
        out[k] += [(first + start, first + stop, period) for start, stop, period in found]
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def kept_words(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """words without those that any run holds behind its first period."""
    if not found:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, end, period in found:
        gone[start + period] += 1
        gone[end] -= 1
    return [x for x, g in zip(words, gone.cumsum().tolist()) if not g]


RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])


def find_runs(docs: DataFrame, prepared: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, runs, collapsed) of each row of docs (doc_id, text; more columns are ignored, whatever their names).

    runs: array of (start, length, period) by start, then period, in words from 0. collapsed: the words that no run holds
    behind its first period, joined by one space. prepared may give other words than a text's own.

    A null or empty text has no words and no runs; its collapsed is empty. Rows without a doc_id and repeated rows are read
    each. Each text is read whole by one task; a very long one that is periodic all through takes about half a kilobyte a word
    for its automaton. Several periods over one stretch count as the smallest. An empty table gives no rows.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column("doc_id"), [(t or "").encode().split() for t in b.column("text").to_pylist()]
            if prepared:
                texts = [prepared(k, t) for k, t in zip(ids.to_pylist(), texts)]
            each = runs_of_texts(texts)
            collapsed = pa.array([b" ".join(kept_words(t, r)).decode() for t, r in zip(texts, each)], pa.string())
            rows = pa.array([[{"start": s, "length": e - s, "period": p} for s, e, p in r] for r in each], pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])))
            yield pa.RecordBatch.from_arrays([ids, rows, collapsed], ["doc_id", "runs", "collapsed"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(found, schema)


def longest(rows: Column) -> Column:
    """The longest of runs; of several the one with the smallest start, then period."""
    most = F.array_max(F.transform(rows, lambda r: r["length"]))
    return F.get(F.filter(rows, lambda r: r["length"] == most), 0)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A text of every tenth id repeats a stretch of its words from some place to its end, as op13 is defined."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(documents(spark, sf_dir), planted).withColumn("best", longest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
