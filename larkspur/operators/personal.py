"""Everything that is kept about people, for all of them in one plan: documents in parts of a bounded number of items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The format's number, the sections and what an item of each shows.
FORMAT_VERSION = 1
SECTIONS = {
    "account": "username email first_name last_name role date_joined last_login email_verified_at pending_email",
    "saved_jobs": "job tags note saved_at",
    "applications": "application_id job status applied_at response_at next_action next_action_due notes",
    "history": "application_id from_status to_status occurred_at note",
    "saved_searches": "name query digest_enabled created_at last_run_at",
    "candidate_profiles": "name skills domains seniority projects education years_experience is_active updated_at",
    "cvs": "original_filename content_type byte_size uploaded_at applied_at suggestions extracted_text",
    "activity": "kind occurred_at query category nation result_count",
}


def job_summary() -> Column:
    """What a saved job or an application shows of its vacancy, from columns of a job."""
    return F.struct("title", F.col("name").alias("institution"), F.col("source_url").alias("url"))


def with_jobs(rows: DataFrame, jobs: DataFrame) -> DataFrame:
    """Rows with a job_id get job, the summary of their vacancy; null where it is gone."""
    return rows.join(jobs.select("job_id", job_summary().alias("job")), "job_id", "left")


def items(section: str, rows: DataFrame) -> DataFrame:
    """A section's rows (owner, at timestamp, id long, fields) as items; fields that rows lack are null, other columns stay out.

    Rows without an owner are nobody's. An item is JSON with all fields, nulls too.
    """
    shown = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in SECTIONS[section].split()]
    number = F.lit(list(SECTIONS).index(section)).cast("int")
    return rows.where("owner IS NOT NULL").select(F.col("owner").cast("long").alias("owner"), number.alias("number"), F.col("at").cast("timestamp").alias("at"), F.col("id").cast("long").alias("id"), F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("item"))


def parts(sections: dict[str, DataFrame], size: int = 1000) -> DataFrame:
    """SNK-05 for all people: (owner, section, part, start, items), at most size items a part, start of them before it.

    Within a section the newest item comes first, undated ones last, ties by id. A section that someone has nothing in has no
    part. All items are sorted by range, so that a person with very many is shared among tasks; rows that follow each other
    there make a part. Where parts end may differ from run to run, but not what a person's parts hold in order. History is
    a section of its own, by application_id, as nobody bounds how often an application moves.
    """
    rows = reduce(DataFrame.unionByName, [items(name, frame) for name, frame in sections.items()])
    keys = ["owner", "number", F.desc_nulls_last("at"), F.asc_nulls_first("id")]  # equal keys share a range, so items needn't be sampled
    sorted_rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "item").withColumn("at_row", F.monotonically_increasing_id())
    block = F.floor(F.col("at_row") / size).cast("long")
    grouped = sorted_rows.groupBy("owner", "number", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("at_row", "item"))).alias("found"))
    before = Window.partitionBy("owner", "number").orderBy("block")
    placed = grouped.select(
        "owner", "number", (F.row_number().over(before) - 1).alias("part"), F.coalesce(F.sum(F.size("found")).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"), F.transform("found", lambda x: x["item"]).alias("items"),
    )
    return placed.withColumn("section", F.element_at(F.array(*map(F.lit, SECTIONS)), F.col("number") + 1)).select("owner", "section", "part", "start", "items")


def write(found: DataFrame, exported_at: Column, path: str, folders: int = 64) -> None:
    """Parts as lines of JSON with the format's number and the time, a folder for each share of the people."""
    share = F.pmod(F.xxhash64("owner"), F.lit(folders)).alias("share")
    found.select(share, F.lit(FORMAT_VERSION).alias("format_version"), exported_at.cast("string").alias("exported_at"), *found.columns).write.partitionBy("share").json(path, mode="overwrite")
