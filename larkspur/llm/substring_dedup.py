"""Removal of passages that an earlier document holds too, by super-k-mer partitioning.

A window's minimiser is the least hash of its runs of MERS[0] words; equal windows have equal minimisers. Consecutive
windows of a document that share a minimiser travel as one packed string to the minimiser's bucket, where sorting the
windows finds equal ones exactly. Before that,
* documents with the same words form a class, and only its first one takes part,
* minimisers that stand in one document only are left out, for no window of theirs can repeat,
* equal packed strings become one, with the smallest document id.
A bucket that is too large to be sorted in a task goes through the same once more: its strings are cut by the next,
longer minimiser, equal pieces become one and each piece goes to its own bucket. The last minimiser is as long as the
window, so a piece is one window and equal pieces are all there is to find. What is found goes back as runs of windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.shared import documents, forget, keep, small_batches

#: Words of a window; of the minimisers, one after the other (the window's own length follows).
WINDOW, MERS = 50, (8, 24, 38, 46)
#: A bucket of more distinct strings or bytes is cut again; a packed string holds at most so many windows.
CROWDED, HEAVY, MOST = 256, 1 << 19, 64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_EMPTY = hashlib.sha256(b"").hexdigest()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, w)])) for w in (_ODD, inverse))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def hashed_words(b: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of word bytes starts, and its hash; equal words have equal hashes."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _POWERS.upto(len(b) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b + np.uint64(1)) * up[: len(b)], dtype=np.uint64)))
    return starts, _mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash for each word of raw."""
    b = np.frombuffer(raw, np.uint8)
    return hashed_words(b, ~_SPACE[b])[1]


def minimisers(hashes: np.ndarray, window: int, mer: int) -> np.ndarray:
    """The minimiser of the window that starts at each word, without regard to documents' ends."""
    g = hashes.copy()
    for k in range(1, mer):
        g[:-k] += hashes[k:] * np.uint64(pow(int(_STEP), k, 1 << 64))
    low, width, spans = _mixed(g)[: len(g) - mer + 1], 1, window - mer + 1
    while 2 * width <= spans:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = spans - width
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def super_kmers(counts: list[int], hashes: np.ndarray, window: int, mer: int) -> list[tuple[list[int], list[int], list[int]]]:
    """For documents with counts words each: (starts, windows, minimisers) of their super-k-mers, none over MOST windows."""
    least = minimisers(hashes, window, mer).view(np.int64) if len(hashes) >= window else np.zeros(0, np.int64)
    out, at = [], 0
    for n in counts:
        if n < window:
            out.append(([], [], []))
        else:
            own = least[at : at + n - window + 1]
            if mer == window:
                starts = np.arange(len(own))
            else:
                starts = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1))
                long = np.diff(np.append(starts, len(own)))
                if long.max() > MOST:
                    pieces = -(-long // MOST)
                    starts = np.repeat(starts, pieces) + MOST * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            out.append((starts.tolist(), np.diff(np.append(starts, len(own))).tolist(), own[starts].tolist()))
        at += n
    return out


def _batched(rows: Iterator[tuple], schema: pa.Schema, sized: int) -> Iterator[pa.RecordBatch]:
    """rows as batches of bounded bytes; column sized holds the bytes that count."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + len(row[sized] or b"")
        if size > 8_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _scanned(window: int, mer: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < 2_000_000):
                    size += len(texts[end] or "")
                    end += 1
                words = [(t or "").encode().split() for t in texts[at:end]]
                plain = [b" ".join(w) for w in words]
                found = super_kmers([len(w) for w in words], word_hashes(b"\n".join(plain)), window, mer)
                columns = [pa.array([len(w) for w in words], pa.int64()), pa.array([hashlib.sha256(p).digest() for p in plain], pa.binary())]
                columns += [pa.array([f[i] for f in found], pa.list_(t)) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([ids.slice(at, end - at), *columns], ["doc_id", "n_words", "sha", "starts", "windows", "minimisers"])
                at = end

    return scan


_RUNS = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))


def _digest(packed: bytes) -> bytes:
    return hashlib.blake2b(packed, digest_size=16).digest()


def _packed(window: int):
    """Super-k-mers of whole texts (doc_id, sha, text, runs)."""
    schema = pa.schema([("minimiser", pa.int64()), ("digest", pa.binary()), ("packed", pa.binary()), ("doc_id", pa.int64()), ("sha", pa.binary()), ("at", pa.int32()), ("windows", pa.int32())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for row in batch.to_pylist():
                words = row["text"].encode().split()
                if hashlib.sha256(b" ".join(words)).digest() != row["sha"]:
                    continue  # another text of the same doc_id
                for r in row["runs"]:
                    packed = b" ".join(words[r["start"] : r["start"] + r["windows"] + window - 1])
                    yield r["minimiser"], _digest(packed), packed, row["doc_id"], row["sha"], r["start"], r["windows"]

    return lambda batches: _batched(rows(batches), schema, 2)


def _cut_again(window: int, mer: int):
    """Super-k-mers, by a longer minimiser, of packed strings (digest, doc_id, packed). Single windows need no text."""
    schema = pa.schema([("owner", pa.binary()), ("doc_id", pa.int64()), ("at", pa.int32()), ("windows", pa.int32()), ("minimiser", pa.int64()), ("digest", pa.binary()), ("packed", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                part = batch.slice(begin, 64).to_pydict()
                words = [p.split(b" ") for p in part["packed"]]
                found = super_kmers([len(w) for w in words], word_hashes(b"\n".join(part["packed"])), window, mer)
                for owner, doc_id, own, cut in zip(part["digest"], part["doc_id"], words, found):
                    for at, n, minimiser in zip(*cut):
                        packed = b" ".join(own[at : at + n + window - 1])
                        yield owner, doc_id, at, n, minimiser, _digest(packed), None if mer == window else packed

    return lambda batches: _batched(rows(batches), schema, 6)


def windows_of(packed: bytes, window: int) -> list[bytes]:
    """The windows of a packed string in order."""
    spaces = np.flatnonzero(np.frombuffer(packed, np.uint8) == 32)
    starts, ends = np.append(0, spaces + 1), np.append(spaces, len(packed))
    return [packed[a:b] for a, b in zip(starts[: len(starts) - window + 1].tolist(), ends[window - 1 :].tolist())]


def runs_of(marked: list[bool]) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.array([False, *marked, False]).astype(np.int8))).tolist()
    return [{"at": a, "n": b - a} for a, b in zip(edges[::2], edges[1::2])]


def repeated(strings: list[tuple[int, bytes]], window: int) -> list[list[dict[str, int]]]:
    """For each (doc_id, packed): the runs of its windows that a string with a smaller doc_id holds too."""
    rows = sorted((w, doc_id, k, i) for k, (doc_id, packed) in enumerate(strings) for i, w in enumerate(windows_of(packed, window)))
    earlier: list[dict[int, bool]] = [{} for _ in strings]
    last, first = None, 0
    for w, doc_id, k, i in rows:  # equal windows stand together, the smallest document first
        if w != last:
            last, first = w, doc_id
        earlier[k][i] = first < doc_id
    return [runs_of([e[i] for i in range(len(e))]) for e in earlier]


def _sorted_bucket(window: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, owns, runs = [], [], []
            for strings in batch.column("strings"):
                strings = strings.as_py()
                digests += [s["digest"] for s in strings]
                owns += [s["doc_id"] for s in strings]
                runs += [[]] if len(strings) == 1 else repeated([(s["doc_id"], s["packed"]) for s in strings], window)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(owns, pa.int64()), pa.array(runs, _RUNS)], ["digest", "own", "runs"])

    return count


_FOUND = "digest binary, own long, runs array<struct<at:int,n:int>>"


def _resolved(travel: DataFrame, window: int, mers: tuple[int, ...]) -> DataFrame:
    """(digest, own, runs) of each packed string of travel (minimiser, digest, packed, doc_id), cut by mers[0].

    own is the smallest doc_id that holds the string; runs are those of its windows that a smaller one holds.
    """
    none = F.array().cast("array<struct<at:int,n:int>>").alias("runs")
    if mers[0] == window:
        return keep(travel.groupBy("digest").agg(F.min("doc_id").alias("own")).select("digest", "own", none), "single")
    strings = keep(travel.groupBy("minimiser", "digest").agg(F.min("doc_id").alias("doc_id"), F.first("packed").alias("packed")), "strings")
    sizes = strings.groupBy("minimiser").agg(F.count("*").alias("n"), F.sum(F.length("packed")).alias("bytes"))
    crowded = keep(sizes.where((F.col("n") > CROWDED) | (F.col("n") > 1) & (F.col("bytes") > HEAVY)).select("minimiser", F.lit(True).alias("crowded")), "crowded")
    dealt = strings.join(crowded, "minimiser", "left")
    buckets = dealt.where("crowded IS NULL").groupBy("minimiser").agg(F.collect_list(F.struct("digest", "doc_id", "packed")).alias("strings"))
    small = buckets.select("strings").mapInArrow(_sorted_bucket(window), _FOUND)
    if crowded.isEmpty():
        out = keep(small, "found")
        forget(strings, crowded)
        return out
    pieces = dealt.where("crowded").select("digest", "doc_id", "packed").mapInArrow(_cut_again(window, mers[1]), "owner binary, doc_id long, at int, windows int, minimiser long, digest binary, packed binary")
    pieces = keep(pieces, "pieces")
    found = _resolved(pieces, window, mers[1:])
    # A piece that an earlier document holds is one run; else its own runs, moved to the piece's place.
    whole = F.array(F.struct("at", F.col("windows").alias("n")))
    moved = F.transform("runs", lambda r: F.struct((r["at"] + F.col("at")).alias("at"), r["n"].alias("n")))
    back = pieces.select("owner", "doc_id", "at", "windows", "digest").join(found, "digest").withColumn("moved", F.when(F.col("own") < F.col("doc_id"), whole).otherwise(moved))
    large = back.groupBy("owner").agg(F.first("doc_id").alias("own"), F.flatten(F.collect_list("moved")).alias("runs")).select(F.col("owner").alias("digest"), "own", "runs")
    out = keep(small.unionByName(large), "found")
    forget(strings, crowded, pieces, found)
    return out


def _cleaned(window: int):
    """What is left of texts (doc_id, sha, text, hits); hits are runs of windows."""
    schema = pa.schema([("doc_id", pa.int64()), ("sha", pa.binary()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for row in batch.to_pylist():
                words = row["text"].encode().split()
                if hashlib.sha256(b" ".join(words)).digest() != row["sha"]:
                    continue
                change = np.zeros(len(words) + 1, np.int64)
                for h in row["hits"]:
                    change[h["at"]] += 1
                    change[h["at"] + h["n"] + window - 1] -= 1
                covered = np.cumsum(change[:-1]) > 0
                kept = b" ".join([w for w, c in zip(words, covered.tolist()) if not c])
                yield row["doc_id"], row["sha"], int(covered.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()

    return lambda batches: _batched(rows(batches), schema, 4)


def remove_repeats(docs: DataFrame, window: int = WINDOW, mers: tuple[int, ...] = MERS) -> tuple[DataFrame, DataFrame]:
    """(report, cleaned) for docs (doc_id, text; more columns are ignored, whatever their names).

    report has a row for each row of docs: doc_id, n_words, n_removed, kept_sha256. cleaned has doc_id and the text left
    of those texts that share windows with others and are the first with their words. Rows repeated whole are reported
    each; texts that share a doc_id don't remove each other's words, each of them loses what smaller ids hold. A null or
    empty text has no words; rows with a null doc_id keep all of theirs and take none from others. An empty table gives
    no rows.
    """
    mers = (*(m for m in mers if m < window), window)
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scan = keep(rows.mapInArrow(_scanned(window, mers[0]), "doc_id long, n_words long, sha binary, starts array<int>, windows array<int>, minimisers array<long>"), "scan")
    known = scan.where(f"doc_id IS NOT NULL AND n_words >= {window}")
    firsts = keep(known.groupBy("sha").agg(F.min("doc_id").alias("doc_id")), "firsts")
    runs = known.join(firsts, ["doc_id", "sha"]).select("doc_id", "sha", F.explode(F.arrays_zip("starts", "windows", "minimisers")).alias("r"))
    runs = keep(runs.select("doc_id", "sha", F.col("r.starts").alias("start"), F.col("r.windows").alias("windows"), F.col("r.minimisers").alias("minimiser")).distinct(), "runs")
    shared = keep(runs.groupBy("minimiser").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("minimiser"), "minimisers")
    by_doc = runs.join(shared, "minimiser").groupBy("doc_id", "sha").agg(F.collect_list(F.struct("start", "windows", "minimiser")).alias("runs"))
    # A text is known by its words joined by one space; texts of one id and whole repeats meet their own runs alone, once.
    own = F.unhex(F.sha2(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), 256))
    texts = keep(rows.where("text IS NOT NULL").withColumn("sha", own).join(by_doc, ["doc_id", "sha"]).dropDuplicates(["doc_id", "sha"]), "texts")
    forget(runs, shared)
    travel = keep(texts.mapInArrow(_packed(window), "minimiser long, digest binary, packed binary, doc_id long, sha binary, at int, windows int"), "super-k-mers")
    found = _resolved(travel, window, mers)
    whole = F.array(F.struct("at", F.col("windows").alias("n")))
    moved = F.transform("runs", lambda r: F.struct((r["at"] + F.col("at")).alias("at"), r["n"].alias("n")))
    hits = travel.select("digest", "doc_id", "sha", "at", "windows").join(found, "digest").where("own < doc_id OR size(runs) > 0")
    by_doc = hits.select("doc_id", "sha", F.when(F.col("own") < F.col("doc_id"), whole).otherwise(moved).alias("moved")).groupBy("doc_id", "sha").agg(F.flatten(F.collect_list("moved")).alias("hits"))
    cleaned = texts.select("doc_id", "sha", "text").join(by_doc, ["doc_id", "sha"]).mapInArrow(_cleaned(window), "doc_id long, sha binary, n_removed long, kept_sha256 string, kept string")
    cleaned = keep(cleaned, "cleaned")
    forget(texts, travel, found)
    changed = cleaned.groupBy("doc_id", "sha").agg(F.first("n_removed").alias("some"), F.first("kept_sha256").alias("some_sha"))
    out = scan.select("doc_id", "n_words", "sha").join(changed, ["doc_id", "sha"], "left").join(firsts.withColumn("is_first", F.lit(True)), ["doc_id", "sha"], "left")
    copy = F.col("is_first").isNull() & F.col("doc_id").isNotNull() & (F.col("n_words") >= window)
    report = out.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("some", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(_EMPTY)).otherwise(F.coalesce("some_sha", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )
    return report, cleaned.select("doc_id", F.col("kept").alias("text"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))[0]
