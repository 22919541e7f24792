"""Ranked lexical search in integers, by an index of two levels.

The index is made of blocks of up to BLOCK documents; a block holds, for each of its terms, the documents with that term. The
first level is a byte for each: the term's impact on that document's score, rounded up to a 255th of the list's highest. The
second level is the counts that an exact score needs.

A search reads the first level of its terms. A byte gives an upper bound on the impact and, a step below, a lower one, so a
document has two bounds on its score. The k-th highest lower bound over all blocks is reached by k documents at least, so
only documents whose upper bound reaches it can be among the first k. All of these, and no others, are scored exactly from
the second level.

Blocks are groups of a bounded size, so a term that every document holds is spread over all blocks. Queries are taken in
lots of bounded size and meet all blocks; what a block returns is its own k best for each query.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.llm.shared import documents, forget, keep, small_batches

BLOCK = 2000
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Terms with their queries that are sent to all tasks at once.
LOT = 200_000
#: Bytes without a term in them become spaces, A to Z become a to z, all others stay.
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text with repeats, A to Z lower-cased; none for null."""
    return (text or "").encode().translate(_FOLD).split()


def impact(tf, n, documents_with_terms: int, all_terms: int):
    """A term's share of a score before its weight; tf and n are numbers or arrays of 64-bit integers."""
    m = 10 + (90 * n * documents_with_terms) // all_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(documents_with_terms: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents_with_terms + 2) / (2 * holding + 1)))


class Block:
    """Lists of a block's terms as they are gathered."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.known: dict[bytes, int] = {}
        self.term: list[int] = []
        self.place: list[int] = []
        self.tf: list[int] = []

    def add(self, doc_id: int | None, text: str | None) -> None:
        words, known, place = terms(text), self.known, len(self.ids)
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        counts = Counter(words)
        self.term += [known.setdefault(t, len(known)) for t in counts]
        self.tf += counts.values()
        self.place += [place] * len(counts)

    def rows(self, block: int, documents_with_terms: int, all_terms: int) -> pa.RecordBatch:
        """A row for each term, and one with a null term for the documents' ids and lengths."""
        term, place, tf, lengths = np.array(self.term, np.int64), np.array(self.place, np.uint16), np.array(self.tf, np.int64), np.array(self.lengths, np.int64)
        order = np.argsort(term, kind="stable")
        term, place, tf = term[order], place[order], tf[order]
        exact = impact(tf, lengths[place], documents_with_terms, max(all_terms, 1)) if len(tf) else tf
        at = np.flatnonzero(np.diff(term, prepend=-1))
        highest = np.maximum.reduceat(exact, at) if len(at) else exact
        step = np.maximum(1, -(-highest // 255))
        byte = (-(-exact // np.repeat(step, np.diff(at, append=len(term))))).astype(np.uint8)
        cuts = [*at.tolist(), len(term)]
        cut = lambda x: [x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
        n, null = len(at), [None]
        names = [t.decode() for t in self.known]
        return pa.RecordBatch.from_arrays([
            pa.array([block] * (n + 1), pa.int64()), pa.array([*names, None], pa.string()), pa.array([*step.tolist(), None], pa.int64()),
            pa.array([*cut(place), None], pa.binary()), pa.array([*cut(byte), None], pa.binary()), pa.array([*cut(tf.astype("<u4")), lengths.astype("<i8").tobytes()], pa.binary()),
            pa.array([*(null * n), self.ids], pa.list_(pa.int64())),
        ], ["block", "term", "step", "places", "bytes", "counts", "ids"])


INDEX = "block long, term string, step long, places binary, bytes binary, counts binary, ids array<long>"


class Index:
    """An index over documents: the table of its blocks, how many documents hold a term, and how many terms they hold."""

    def __init__(self, table: DataFrame, documents_with_terms: int, all_terms: int) -> None:
        self.table, self.documents, self.terms = table, documents_with_terms, all_terms

    def search(self, items: DataFrame, k: int = 10, lot: int = LOT) -> DataFrame:
        """(item_id, rank, doc_id, score) of the k highest-scoring documents with a score above 0 for each row of items (item_id, text).

        Equal scores by ascending doc_id, null last; documents that share both take ranks in any order. An item without a
        term and one that matches nothing give no rows. Rows of items that share an item_id, or lack one, are queries of
        their own. More columns are ignored. The result is kept and doesn't need the index any more.
        """
        asked = keep(queries(items), "queries")
        lots = -(-asked.count() // lot)
        found = [self._lot(asked.where(F.pmod(F.xxhash64("query"), F.lit(lots)) == n), k) for n in range(lots)]
        if not found:
            return asked.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    def _lot(self, asked: DataFrame, k: int) -> DataFrame:
        spark = asked.sparkSession
        pairs = asked.select("query", "item_id", "term").collect()  # at most LOT and one query
        lists = keep(self.table.join(F.broadcast(spark.createDataFrame([(t,) for t in sorted({r.term for r in pairs})], "term string")), "term"), "lists")
        holding = dict(lists.groupBy("term").agg((F.sum(F.length("places")) / 2).cast("long")).collect())
        of: dict[int, list[tuple[str, int]]] = {}
        for r in pairs:
            if r.term in holding and (w := weight(self.documents, holding[r.term])):
                of.setdefault(r.query, []).append((r.term, w))
        bounds = keep(lists.select("block", "term", "step", "places", "bytes").groupBy("block").applyInArrow(bounded(of, k), "query long, block long, lower array<long>, places binary, upper binary, highest long"), "bounds")
        best = Window.partitionBy("query").orderBy(F.desc("lower"))
        reached = bounds.select("query", F.explode("lower").alias("lower")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        reached = dict(reached.groupBy("query").agg(F.when(F.count("*") >= k, F.min("lower")).otherwise(0)).collect())
        least = spark.createDataFrame(list(reached.items()), "query long, least long")
        open_ = bounds.join(F.broadcast(least), "query").where("highest >= least").select("block", "query", "least", "places", "upper")
        exact = lists.select("block", "term", "places", "counts").unionByName(self.table.where("term IS NULL").select("block", "term", "places", "counts", "ids"), allowMissingColumns=True)
        exact = exact.join(open_.select("block").distinct(), "block", "left_semi")
        scored = open_.groupBy("block").cogroup(exact.groupBy("block")).applyInArrow(rescored(of, k, self.documents, self.terms), "query long, doc_id long, score long")
        first = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = keep(scored.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k), "ranked")
        forget(lists, bounds)
        names = asked.select("query", "item_id").distinct()
        return ranked.join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def queries(items: DataFrame) -> DataFrame:
    """(query, item_id, term) of each distinct term of each row of items; query numbers the rows."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [sorted(set(terms(t))) for t in b.column("text").to_pylist()]
            at = np.repeat(np.arange(b.num_rows), [len(t) for t in each])
            yield pa.RecordBatch.from_arrays([b.column("query").take(pa.array(at)), b.column("item_id").take(pa.array(at)), pa.array([t.decode() for x in each for t in x], pa.string())], ["query", "item_id", "term"])

    numbered = items.select(F.monotonically_increasing_id().alias("query"), F.col("item_id").cast("long").alias("item_id"), "text")
    return numbered.mapInArrow(split, "query long, item_id long, term string")


def bounded(of: dict[int, list[tuple[str, int]]], k: int):
    """Of a block's lists: for each query its k highest lower bounds, and the documents whose upper bound reaches the last of these."""

    def found(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        lists = {term: (np.frombuffer(p, np.uint16), np.frombuffer(b, np.uint8).astype(np.int64), s) for term, p, b, s in zip(*(t.column(c).to_pylist() for c in ("term", "places", "bytes", "step")))}
        size = 1 + max((int(p.max()) for p, _, _ in lists.values()), default=0)
        out = []
        for query, weighed in of.items():
            upper, over = np.zeros(size, np.int64), np.zeros(size, np.int64)
            for term, w in weighed:
                if term in lists:
                    places, byte, step = lists[term]
                    upper[places] += byte * (w * step)
                    over[places] += np.where(byte > 0, w * (step - 1), 0)
            at = np.flatnonzero(upper)
            if not len(at):
                continue
            lower = (upper - over)[at]
            high = np.sort(lower)[::-1][:k]
            at = at[upper[at] >= (high[-1] if len(high) == k else 0)]
            out.append((query, key[0].as_py(), high.tolist(), at.astype("<u2").tobytes(), upper[at].astype("<i8").tobytes(), int(upper[at].max())))
        types = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64())
        return pa.Table.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(types)], ["query", "block", "lower", "places", "upper", "highest"])

    return found


def rescored(of: dict[int, list[tuple[str, int]]], k: int, documents_with_terms: int, all_terms: int):
    """Of a block's open documents: exact scores above 0, each query's k best."""

    def found(key: tuple[pa.Scalar, ...], asked: pa.Table, t: pa.Table) -> pa.Table:
        out: list[tuple[int, int | None, int]] = []
        if asked.num_rows and t.num_rows:
            lists, ids, lengths = {}, [], np.zeros(0, np.int64)
            for term, places, counts, own in zip(*(t.column(c).to_pylist() for c in ("term", "places", "counts", "ids"))):
                if term is None:
                    ids, lengths = own, np.frombuffer(counts, "<i8")
                else:
                    lists[term] = np.frombuffer(places, "<u2"), np.frombuffer(counts, "<u4").astype(np.int64)
            for query, least, places, upper in zip(*(asked.column(c).to_pylist() for c in ("query", "least", "places", "upper"))):
                at = np.frombuffer(places, "<u2")[np.frombuffer(upper, "<i8") >= least]
                score, wanted = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
                wanted[at] = True
                for term, w in of[query]:
                    if term in lists:
                        held, tf = lists[term]
                        on = wanted[held]
                        score[held[on]] += w * impact(tf[on], lengths[held[on]], documents_with_terms, all_terms)
                best = sorted(((-int(score[i]), ids[i] is None, ids[i] or 0, i) for i in at.tolist() if score[i] > 0))[:k]
                out += [(query, ids[i], -s) for s, _, _, i in best]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["query", "doc_id", "score"])

    return found


def build_index(docs: DataFrame) -> Index:
    """The index over every row of docs (doc_id, text; more columns are ignored, whatever their names), kept in the shared folder.

    A null text, and one without a term, is in the index without a term and counts for nothing. Rows without a doc_id and
    repeated rows are documents each. A very long text is read whole by one task. An empty table gives an index that finds
    nothing.
    """
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(terms(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sum(x > 0 for x in n)], pa.int64()), pa.array([sum(n)], pa.int64())], ["documents", "terms"])

    n, total = rows.mapInArrow(counted, "documents long, terms long").agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part, held = b.slice(at, BLOCK), Block()
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    held.add(doc_id, text)
                out = held.rows(block, n, total)
                yield from (out.slice(i, 4096) for i in range(0, out.num_rows, 4096))
                block += 1

    return Index(keep(rows.mapInArrow(blocks, INDEX), "index"), n, total)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(documents(spark, sf_dir))
    found = index.search(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    forget(index.table)
    return found


SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), p AS (
  SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL
), d AS (
  SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id
), a AS (
  SELECT count(*) AS n, CAST(sum(n) AS BIGINT) AS l FROM d
), m AS (
  SELECT doc_id, 10 + (90 * d.n * a.n) // a.l AS m FROM d, a
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(a.n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, a GROUP BY term
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), s AS (
  SELECT q.item_id, p.doc_id, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * m.m))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN m ON p.doc_id = m.doc_id GROUP BY q.item_id, p.doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10"""
