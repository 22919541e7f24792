"""Upserts rewrite the buckets they touch and no other, and can be repeated."""

import random

import pytest

from larkspur.sources import keyed

ROW = "a long, b string, note string, place string"


def test_upserts(spark, tmp_path):
    table, r, want = keyed.Keyed(str(tmp_path), ("a", "b"), 16), random.Random(1), {}
    rows = [(k % 90, str(k // 90), r.choice(["x", None, "é"]), "own") for k in range(300)]
    schema = spark.createDataFrame([], ROW).schema
    frame = lambda rows: spark.createDataFrame(rows, schema)
    keyed.create(frame(rows), table)
    want = {x[:2]: x for x in rows}
    told = lambda: sorted(map(str, map(tuple, keyed.current(spark, table, schema).collect())))
    assert told() == sorted(map(str, want.values()))
    for _ in range(3):
        changes = [(r.randint(0, 120), str(r.randint(0, 3)), r.choice(["new", None]), "z") for _ in range(4)]
        changes = list({x[:2]: x for x in changes}.values())
        files = set(keyed.current(spark, table, schema).inputFiles())
        touched = keyed.upsert(frame(changes), table)
        want |= {x[:2]: x for x in changes}
        assert told() == sorted(map(str, want.values()))
        after = set(keyed.current(spark, table, schema).inputFiles())
        assert {int(f.split("bucket=")[1].split("/")[0]) for f in files ^ after} == set(touched) and len(touched) < 16
        assert keyed.upsert(frame(changes), table) == [] and set(keyed.current(spark, table, schema).inputFiles()) == after
    assert keyed.upsert(frame([]), table) == []
    assert len(keyed.upsert(frame([(500, "q", "1", "z"), (500, "q", "2", "z"), (500, "q", "2", "z")]), table)) == 1
    assert keyed.current(spark, table, schema).where("a = 500").collect() == [(500, "q", "2", "z")]
    frame([(1, "0", "dead", "z")]).write.parquet(f"{tmp_path}/data/version=99/bucket=0")  # a run that died before its manifest
    assert "dead" not in str(told())
    with pytest.raises(Exception, match="null in the key"):
        keyed.upsert(frame([(None, "0", "n", "z")]), table)


def test_clashing_names(spark, tmp_path):
    with pytest.raises(ValueError, match="bucket"):
        keyed.create(spark.createDataFrame([(1, 2)], "a long, bucket int"), keyed.Keyed(str(tmp_path), ("a",), 4))


def test_empty(spark, tmp_path):
    table = keyed.Keyed(str(tmp_path), ("a",), 4)
    none = spark.createDataFrame([], "a long, v string")
    keyed.create(none, table)
    assert keyed.current(spark, table, none.schema).count() == 0
    keyed.upsert(spark.createDataFrame([(1, "x")], none.schema), table)
    assert keyed.current(spark, table, none.schema).collect() == [(1, "x")]
