"""Where a loop's frames are written, so that their plans stay short and lost executors cost no more than a round; how rows are dealt to tasks."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; unset, one of this machine where all of Spark runs on it, else an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(context, "_larkspur_lineage", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = context._larkspur_lineage = tempfile.mkdtemp(prefix="spark-")
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df in several tasks a core, by ranges of by if given: a small file is one task, however much work its rows are. Rows should be dealt while they are narrow."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return df.repartitionByRange(n, *by) if by else df.repartition(n)


def keyed(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys in many tasks a core, so that what one task sorts stays small. Frames that are keyed alike join without another shuffle."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism), *keys)
