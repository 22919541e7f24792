"""What several operators use: tables in the shared folder, runs of equal keys, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the folder that driver and executors share. Unset, a folder of this machine where all of Spark runs on it (tests); on a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_larkspur_folder", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = spark.sparkContext._larkspur_folder = tempfile.mkdtemp(prefix="spark-")
    return folder.rstrip("/")


def keep(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/larkspur-{uuid.uuid4().hex[:12]}-{name}"
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._larkspur_path = path
    return kept


def forget(*kept: DataFrame | None) -> None:
    """Delete tables that keep() wrote, once nothing reads them any more."""
    for df in kept:
        if df is not None:
            jvm, spark = df.sparkSession._jvm, df.sparkSession
            path = jvm.org.apache.hadoop.fs.Path(df._larkspur_path)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(df: DataFrame) -> DataFrame:
    """df, with batches to Python of at most 2000 rows and about 4 MB from now on: texts are long, and a batch is held in memory."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return df


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key, from batches in which equal keys stand together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column = batch.column(key)
        if held and held[-1].column(key)[0] != column[0]:
            yield pa.Table.from_batches(held)
            held = []
        cuts = np.flatnonzero(pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)) + 1
        edges = [0, *cuts.tolist(), n]
        for start, end in zip(edges[:-2], edges[1:-1]):
            held.append(batch.slice(start, end - start))
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(edges[-2]))
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Union-find over a task's own rows; the smaller value is the root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        """True if a and b were apart."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of edges (a, b): root is the smallest id reachable.

    Each round takes every root to its smallest neighbour, follows that twice and replaces the ends of the edges by
    where they lead, so the graph shrinks until no edge is left. Every aggregate is combined before its shuffle and
    every join is one that Spark can split, so a node with very many edges is no hot spot.
    """
    e = keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    labels = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("r"))
        for _ in range(2):
            further = step.select(F.col("v").alias("r"), F.col("r").alias("rr"))
            step = step.join(further, "r", "left").select("v", F.coalesce("rr", "r").alias("r"))
        step = keep(step, "step")
        old, old_labels = e, labels
        to = lambda end: step.select(F.col("v").alias(end), F.col("r").alias(f"r{end}"))
        e = keep(
            old.join(to("a"), "a").join(to("b"), "b")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .where("a < b").distinct(),
            "edges",
        )
        if labels is None:
            labels = step
        else:
            further = step.select(F.col("v").alias("r"), F.col("r").alias("rr"))
            labels = keep(labels.join(further, "r", "left").select("v", F.coalesce("rr", "r").alias("r")), "labels")
            forget(old_labels, step)
        forget(old)
    if labels is None:
        return e.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return labels.select(F.col("v").alias("id"), F.col("r").alias("root"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
