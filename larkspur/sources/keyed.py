"""Tables by key whose changes rewrite only the buckets that they touch.

Rows lie under data/version=V/bucket=B by a hash of their key. A manifest says which version of each bucket counts; it is one
file that appears when all its data is there, so a run that dies leaves the table as it was, and may simply be run again.
One writer at a time. Old versions stay until someone deletes them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "version long, bucket int, holds long"


@dataclass(frozen=True)
class Keyed:
    """Where a table lies, its key's columns, by how many buckets (manifests have a row for each), and over how many files each."""

    path: str
    keys: tuple[str, ...]
    buckets: int = 256
    spread: int = 4

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")


def _newest(rows: DataFrame, table: Keyed) -> DataFrame:
    """A row for each key: of several the greatest by its columns. A null in a key is an error, and so are columns named as those here."""
    if clash := {"bucket", "row", "new", "old"} & set(rows.columns):
        raise ValueError(f"columns {sorted(clash)} have to be renamed")
    missing = F.when(F.greatest(*[F.col(k).isNull() for k in table.keys], F.lit(False)), F.raise_error(F.lit(f"null in the key of {table.path}"))).otherwise(F.struct(*rows.columns))
    return rows.select(*table.keys, missing.alias("row")).groupBy(*table.keys).agg(F.max("row").alias("row"))


def _write(rows: DataFrame, table: Keyed, version: int) -> None:
    rows.repartition("bucket", F.pmod(F.hash(*table.keys), F.lit(table.spread))).write.partitionBy("bucket").parquet(f"{table.path}/data/version={version}", mode="overwrite")


def _commit(spark: SparkSession, table: Keyed, version: int, holds: dict[int, int]) -> None:
    lines = spark.createDataFrame([(version, b, v) for b, v in sorted(holds.items())] or [(version, None, None)], _MANIFEST)
    lines.coalesce(1).write.json(f"{table.path}/manifests", mode="append")


def _held(spark: SparkSession, table: Keyed) -> tuple[int, dict[int, int]]:
    """The last version, and that of each bucket that has rows."""
    manifests = spark.read.schema(_MANIFEST).json(f"{table.path}/manifests")
    last = manifests.agg(F.max("version")).first()[0]
    return last, {r.bucket: r.holds for r in manifests.where((F.col("version") == last) & F.col("bucket").isNotNull()).collect()}


def create(rows: DataFrame, table: Keyed) -> None:
    """Writes rows as version 0 of a new table."""
    spark = rows.sparkSession
    _write(_newest(rows, table).select("row.*", table.bucket().alias("bucket")), table, 0)
    there = spark.read.schema("bucket int").parquet(f"{table.path}/data/version=0").select("bucket").distinct().collect()
    _commit(spark, table, 0, {r.bucket: 0 for r in there})


def _read(spark: SparkSession, table: Keyed, holds: dict[int, int], schema) -> DataFrame:
    if not holds:
        return spark.createDataFrame([], schema)
    folders = [f"{table.path}/data/version={v}/bucket={b}" for b, v in sorted(holds.items())]
    return spark.read.schema(schema).parquet(*folders)


def current(spark: SparkSession, table: Keyed, schema) -> DataFrame:
    """The table's rows, of a given schema."""
    return _read(spark, table, _held(spark, table)[1], schema)


def upsert(changes: DataFrame, table: Keyed) -> list[int]:
    """Rows of new keys come in, those of known keys take their rows' place; the buckets rewritten.

    changes have all columns of the table. Only buckets of changed keys are read, only those in which a row differs are
    written, each whole; the same changes once more write nothing. What goes to the driver is at most a number for each bucket.
    """
    spark, columns = changes.sparkSession, changes.columns
    last, holds = _held(spark, table)
    new = _newest(changes, table).withColumnRenamed("row", "new")
    asked = {r.bucket for r in new.select(table.bucket().alias("bucket")).distinct().collect()}
    old = _read(spark, table, {b: v for b, v in holds.items() if b in asked}, changes.schema).select(*table.keys, F.struct(*columns).alias("old"))
    both = old.join(new, list(table.keys), "full").withColumn("bucket", table.bucket())
    differ = F.col("new").isNotNull() & ~F.coalesce("new", "old").eqNullSafe(F.col("old"))
    touched = sorted(r.bucket for r in both.where(differ).select("bucket").distinct().collect())
    if touched:
        _write(both.where(F.col("bucket").isin(touched)).select(F.coalesce("new", "old").alias("row"), "bucket").select("row.*", "bucket"), table, last + 1)
        _commit(spark, table, last + 1, holds | dict.fromkeys(touched, last + 1))
    return touched
