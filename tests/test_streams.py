"""Streams with late, repeated and unordered events give what whole tables give."""

import datetime
import random

from larkspur.operators import insights
from larkspur.streaming import rollup

DAY = datetime.datetime(2024, 3, 28)


def _streamed(spark, rows, schema, files, function, folder):
    """function over a stream that meets rows a file at a time."""
    size = -(-len(rows) // files)
    for k in range(files):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    rollup.write(function(source), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_daily_terms(spark, tmp_path):
    r, rows = random.Random(3), []
    for k in range(900):
        at = DAY + datetime.timedelta(minutes=10 * k + r.randint(-1400, 0))
        rows.append((k, at, r.choice(["SEARCH", "SEARCH", "JOB_VIEW"]), r.choice([None, 1, 2, 3, 4]), r.choice(["CANDIDATE", "CANDIDATE", "ADMIN"]), r.choice(["", "c++ nurse", "nurse genetics nurse", "phd, genetics", None])))
    rows = [x for row in rows for x in [row] * r.choice([1, 1, 3])]
    schema = "event_id long, occurred_at timestamp, kind string, actor long, actor_role string, query string"
    end = [(-k, DAY + datetime.timedelta(days=60 + k), "JOB_VIEW", 1, "CANDIDATE", "") for k in range(1, 3)]
    want = insights.term_rollup(spark.createDataFrame(rows, schema).dropDuplicates(["event_id"]).withColumn("day", insights.local_day("occurred_at")))
    told = lambda df: sorted((x.day, x.term, x.occurrences, x.searchers) for x in df.collect())
    assert len(told(want)) > 15
    assert told(rollup.daily_terms(spark.createDataFrame(rows, schema))) == told(want)
    assert told(_streamed(spark, rows + end, schema, 4, rollup.daily_terms, tmp_path)) == told(want)


def test_lost_runs(spark, tmp_path):
    r, rows, want = random.Random(5), [], []
    for run in range(30):
        at, beats = DAY + datetime.timedelta(minutes=run), []
        for _ in range(25):
            beats.append(at)
            at += datetime.timedelta(minutes=r.choice([1, 5, 29, 29, 31, 90]))
        ends = run % 3 == 0
        rows += [(run, b, "DONE" if ends and b == beats[-1] else "RUNNING") for b in beats for _ in range(r.choice([1, 2]))]
        gaps = [b for b, n in zip(beats, beats[1:]) if n - b >= datetime.timedelta(minutes=30)] + ([] if ends else beats[-1:])
        want += [(run, b, b + datetime.timedelta(minutes=30)) for b in gaps]
    rows.append((0, rows[0][1], "RUNNING"))
    rows.sort(key=lambda x: x[1] + datetime.timedelta(minutes=r.randint(0, 9)))
    end = [(99, DAY + datetime.timedelta(days=50 + k), "DONE") for k in range(2)]
    schema = "run_id long, at timestamp, status string"
    told = lambda df: sorted((x.run_id, x.last_heartbeat, x.lost_at) for x in df.collect())
    assert told(rollup.lost_runs(spark.createDataFrame(rows + [(None, DAY, "RUNNING"), (1, None, "RUNNING")], schema))) == sorted(want)
    assert told(_streamed(spark, rows + end, schema, 5, rollup.lost_runs, tmp_path)) == sorted(want)
