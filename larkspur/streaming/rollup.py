"""Daily rollups and watch over runs as streams: late events count for two days, as in the nightly rebuild of the last two days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspur.functions import text
from larkspur.operators import insights


def daily_kinds(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Counts a day and kind of a stream of (occurred_at timestamp, kind)."""
    return events.withWatermark("occurred_at", late).groupBy(F.window("occurred_at", "1 day").alias("w"), "kind").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "kind", "n")


def write(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return counts.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def _once(events: DataFrame) -> DataFrame:
    """Each event_id once; a stream remembers ids as long as its watermark waits."""
    return events.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def daily_terms(events: DataFrame, late: str = "2 days", zone: str = "Europe/London") -> DataFrame:
    """AGG-13 of a stream of (event_id, occurred_at timestamp, kind, actor, actor_role, query): (day, term, occurrences, searchers).

    A day is given out once, when late has passed since its end, and its state goes. Candidates are counted before terms are,
    so that a term of many searches is summed up by candidate first. Events without an actor are one searcher. Repeated events
    count once. Over a frame that isn't a stream it gives the same rows.
    """
    at = F.from_utc_timestamp("occurred_at", zone)
    seen = _once(events.withColumn("at", at).withWatermark("at", late))
    searches = insights.by_candidates(insights.of_kinds(seen, "SEARCH")).where("query <> ''")
    terms = searches.select("at", F.coalesce(F.col("actor").cast("string"), F.lit("")).alias("actor"), F.explode(text.search_terms(F.col("query"))).alias("term"))
    people = terms.groupBy(F.window("at", "1 day").alias("w"), "term", "actor").agg(F.count("*").alias("n"))
    days = people.groupBy(F.window(F.window_time("w"), "1 day").alias("d"), "term").agg(F.sum("n").alias("occurrences"), F.count("*").alias("searchers"))
    return days.select(F.to_date("d.start").alias("day"), "term", "occurrences", "searchers")


def lost_runs(heartbeats: DataFrame, silence: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """STM-08 of a stream of (run_id, at timestamp, status): (run_id, last_heartbeat, lost_at) of runs that fell silent while RUNNING.

    A run is lost when no heartbeat comes for as long as silence; one that comes back may be lost again. Heartbeats may come
    out of order and repeatedly, by up to late. Of statuses of one instant another than RUNNING counts.
    """
    last = F.max(F.struct("at", (F.col("status") != "RUNNING").alias("ended")))
    spells = heartbeats.where("run_id IS NOT NULL AND at IS NOT NULL").withWatermark("at", late).groupBy("run_id", F.session_window("at", silence).alias("w")).agg(last.alias("last"))
    return spells.where("NOT last.ended").select("run_id", F.col("last.at").alias("last_heartbeat"), F.col("w.end").alias("lost_at"))
