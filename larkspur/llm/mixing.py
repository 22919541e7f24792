"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions alone.

Each source's documents stand in a shuffled queue that may run through up to REPEATS times. A document's virtual finish time
is the words of its queue up to its end, divided by the source's target, so every source reaches its target at time 1. All
queues are range-sorted by finish time into one mix, which ends at the total budget. The document in service when a source
reaches its target is cut there, so a source is off by rounding and not by a long document.

Texts stay where they are: what travels is a row of numbers a document. Sums along an order are taken range by range, so a
source that holds most rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspur.llm.shared import documents, forget, keep

WORD = r"[^\x20\x09-\x0D]+"
#: Sources by code point take these weights in turn.
WEIGHTS = (1, 2, 3)
#: A document is taken at most so many times.
REPEATS = 3


def summed_before(df: DataFrame, order: list[Column], **sums: str) -> DataFrame:
    """df and, for each name=column of sums, the sum of that column over all rows ahead in the order.

    Rows are dealt into ranges of the order and kept, so that a row's range can't change (that table is the result's
    _larkspur_ranged); sums of whole ranges ahead are one row a range.
    """
    ranged = keep(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranged")
    ahead, inside = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda column, window: F.coalesce(F.sum(column).over(window), F.lit(0))
    whole = ranged.groupBy("range").agg(*(F.sum(c).alias(f"whole_{name}") for name, c in sums.items()))
    whole = whole.select("range", *(before(f"whole_{name}", ahead).alias(f"whole_{name}") for name in sums))
    out = ranged.join(F.broadcast(whole), "range")
    out = out.select(*df.columns, *((F.col(f"whole_{name}") + before(c, inside)).alias(name) for name, c in sums.items()))
    out._larkspur_ranged = ranged
    return out


def sizes(docs: DataFrame) -> DataFrame:
    """(row, doc_id, source, size, shuffled) of each row of docs: size counts its words, shuffled is its place in a shuffle."""
    shuffled = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), shuffled.alias("shuffled"),
    )


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, place, ahead, target) of each source: its place by code point, null last, and the words of the sources before it.

    All words are shared by weight; a source whose share is above repeats times its size stops there and the rest is shared
    again among the others, until no share is above.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    placed = summed_before(by_source, [F.col("source").asc_nulls_last()], place="one", ahead="source_size")
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranged, placed = placed._larkspur_ranged, keep(placed.select("source", "source_size", "place", "ahead", turn.alias("weight"), (F.col("source_size") * repeats).alias("most")), "sources")
    forget(ranged)
    total, weight = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    share, stopped = total / max(weight, 1), -1
    while True:
        over = F.col("weight") * F.lit(share) > F.col("most")
        held, rest, n = placed.agg(F.sum(F.when(over, F.col("most")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight"))), F.count(F.when(over, 1))).first()
        if not rest or n == stopped:
            break
        share, stopped = (total - held) / rest, n
    return placed.select("source", "source_size", "place", "ahead", F.least(F.col("most").cast("double"), F.col("weight") * F.lit(share)).alias("target"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> tuple[DataFrame, DataFrame]:
    """The mix, and what it takes of each row of docs (doc_id, text, source; more columns are ignored, whatever their names).

    The mix: (row, doc_id, source, pass, finish, begin, words), a row for each document taken, pass 0 to repeats - 1; begin
    counts the words of the mix before it, words those that it gives from its text's start. The other: (row, doc_id, source,
    size, source_size, target, taken), a row for each row of docs.

    A null or empty text has size 0 and gives nothing. A null source is a source, the last one. Rows without a doc_id and
    repeated rows are queued each; rows that tie in the shuffle are alike in doc_id and size, so which goes first doesn't
    show. A very long text counts whole. An empty table gives empty results.
    """
    sized = keep(sizes(docs), "sizes")
    of_source = targets(sized, weights, repeats)
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    queued = summed_before(sized, [F.col("source").asc_nulls_last(), F.col("shuffled"), F.col("doc_id"), F.col("size"), F.col("row")], queue="size")
    ranged, named = queued._larkspur_ranged, of_source.withColumnRenamed("source", "name")
    queued = queued.join(named, F.col("source").eqNullSafe(F.col("name"))).drop("name").withColumn("most", F.ceil("target"))
    queued = keep(queued.withColumn("queue", F.col("queue") - F.col("ahead")), "queued")
    forget(sized, ranged)
    start = F.col("pass") * F.col("source_size") + F.col("queue")
    served = queued.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("start", start).where("start < most")
    served = served.withColumn("words", F.least(F.col("size"), F.col("most") - F.col("start")))
    served = served.select("row", "doc_id", "source", "size", "source_size", "target", "place", "pass", "start", "words", ((F.col("start") + F.col("words")) / F.col("target")).alias("finish"))
    mixed = summed_before(served, [F.col("finish"), F.col("place"), F.col("start")], begin="words")
    mixed = mixed.withColumn("words", F.least(F.col("words"), F.lit(total) - F.col("begin"))).where("words > 0")
    each = ["row", "doc_id", "source", "size", "source_size", "target"]
    both = mixed.select(*each, F.col("words").alias("taken")).unionByName(queued.select(*each, F.lit(0).cast("long").alias("taken")))
    return mixed.select("row", "doc_id", "source", "pass", "finish", "begin", "words"), both.groupBy(*each).agg(F.sum("taken").alias("taken"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(documents(spark, sf_dir))[1].select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffled FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (
  SELECT *, 1 + place % 3 AS weight, 3 * source_size AS most FROM s
), p AS (
  SELECT *, coalesce(sum(most) OVER o, 0) AS held, (SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER o, 0) AS rest, (SELECT sum(source_size) FROM w) AS total
  FROM w WINDOW o AS (ORDER BY CAST(most AS DOUBLE) / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), shared AS (
  SELECT CAST(max(total) - coalesce(sum(most) FILTER (WHERE weight * CAST(total - held AS DOUBLE) / rest > most), 0) AS DOUBLE)
    / CAST(coalesce(sum(weight) FILTER (WHERE weight * CAST(total - held AS DOUBLE) / rest <= most), 1) AS DOUBLE) AS share FROM p
), t AS (
  SELECT source, source_size, place, least(CAST(most AS DOUBLE), weight * share) AS target FROM w, shared
), q AS (
  SELECT d.doc_id, d.size, t.source_size, t.place, t.target, CAST(ceil(t.target) AS BIGINT) AS most,
    coalesce(CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.shuffled, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS queue
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, pass * source_size + queue AS start, least(size, most - (pass * source_size + queue)) AS words
  FROM q, (SELECT unnest([0, 1, 2]) AS pass) WHERE size > 0 AND pass * source_size + queue < most
), m AS (
  SELECT doc_id, words, (SELECT sum(size) FROM d) - coalesce(sum(words) OVER (ORDER BY (start + words) / target, place, start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM c
), k AS (
  SELECT doc_id, CAST(sum(greatest(0, least(words, rest))) AS BIGINT) AS taken FROM m GROUP BY doc_id
)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0) AS taken FROM q LEFT JOIN k ON q.doc_id = k.doc_id"""
