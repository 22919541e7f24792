"""Documents of all people hold what is theirs, in order, in bounded parts."""

import json
from collections import defaultdict

from pyspark.sql import functions as F

from larkspur.operators import personal


def _told(found):
    told = defaultdict(list)
    for r in sorted(found.collect(), key=lambda r: (r.owner, r.section, r.part)):
        assert r.start == len(told[r.owner, r.section])
        told[r.owner, r.section] += map(json.loads, r["items"])
    return told


def test_parts(spark):
    activity = spark.range(6000).select(
        F.expr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 1000 <> 1 THEN id % 50 END").alias("owner"), F.expr("CASE WHEN id % 11 <> 0 THEN timestamp_seconds(id DIV 5) END").alias("at"), "id",
        F.concat(F.lit("kind \"x\" "), "id").alias("kind"), F.lit("é\n").alias("query"), F.lit(1).alias("item"), F.lit(2).alias("number"),
    )
    account = spark.createDataFrame([(7, "ann", None), (60, "bob", "b@x")], "owner long, username string, email string").selectExpr("*", "CAST(NULL AS timestamp) AS at", "owner AS id")
    found = personal.parts({"account": account, "activity": activity}, size=40)
    assert all(0 < len(r["items"]) <= 40 for r in found.collect())
    told = _told(found)
    want = defaultdict(list)
    for r in sorted(activity.where("owner IS NOT NULL").collect(), key=lambda r: (r.at is None, -r.at.timestamp() if r.at else 0, r.id)):
        want[r.owner, "activity"].append(r.kind)
    assert {k: [x["kind"] for x in v] for k, v in told.items() if k[1] == "activity"} == want
    assert set(told[7, "activity"][0]) == set(personal.SECTIONS["activity"].split()) and told[7, "activity"][0]["query"] == "é\n"
    assert told[60, "account"][0]["email"] == "b@x" and told[7, "account"][0]["email"] is None and (60, "activity") not in told


def test_repeats_gone_jobs_and_nothing(spark, tmp_path):
    jobs = spark.createDataFrame([(1, "T", "U", "u")], "job_id long, title string, name string, source_url string")
    saved = spark.createDataFrame([(1, 5, "a"), (1, 5, "a"), (2, 5, "b")], "job_id long, owner long, note string").selectExpr("*", "CAST(NULL AS timestamp) AS at", "CAST(NULL AS long) AS id")
    found = personal.parts({"saved_jobs": personal.with_jobs(saved, jobs)})
    told = _told(found)[5, "saved_jobs"]
    assert sorted(str(x["job"]) for x in told) == ["None", str({"title": "T", "institution": "U", "url": "u"}), str({"title": "T", "institution": "U", "url": "u"})]
    assert personal.parts({"saved_jobs": personal.with_jobs(saved.limit(0), jobs)}).count() == 0
    personal.write(found, F.lit("2024-01-01"), str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert back.where("format_version = 1 AND exported_at = '2024-01-01'").agg(F.sum(F.size("items"))).first()[0] == 3
