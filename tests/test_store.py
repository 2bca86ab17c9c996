from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from gritstone.sources import store as S


def test_snapshots(spark, tmp_path):
    at = str(tmp_path / "s")
    rows = spark.createDataFrame([(1, None, ["a", None]), (2, "x\ny", [])], "i long, s string, a array<string>").withColumn("t", F.lit("2026-01-02 03:04:05.678901").cast("timestamp"))
    S.write_snapshot(rows, at, {"revision": "r", "paths": ["a"]})
    header, held = S.read_snapshot(spark, at)
    assert header == {"revision": "r", "paths": ["a"]} and sorted(map(str, held.collect())) == sorted(map(str, rows.collect())) and held.schema == rows.schema
    S.write_snapshot(rows.limit(0), at)
    assert S.read_snapshot(spark, at)[1].collect() == [] and S.read_or(spark, f"{at}/none", "i long").collect() == []


def test_events(spark, tmp_path):
    at = str(tmp_path / "e")
    rows = spark.createDataFrame([("f1", "m", 3), ("f2", "n", None)], "id string, method string, line int")
    S.append_events(S.closure_events(rows, "dismissed", F.lit(1), F.array(F.lit("k")), "fine"), at)
    S.append_events(S.closure_events(rows.limit(1), "reopened", F.lit(2)), at)
    got = S.read_or(spark, at, S.CLOSURES).orderBy("seq", "id").collect()
    assert [(r.seq, r.type, r.id, r.line, r.kinds, r.reason) for r in got] == [(1, "dismissed", "f1", 3, ["k"], "fine"), (1, "dismissed", "f2", None, ["k"], "fine"), (2, "reopened", "f1", 3, [], None)]
    with pytest.raises(ValueError):
        S.closure_events(rows, "closed", F.lit(1))


def test_journal_and_retention(spark, tmp_path):
    at = str(tmp_path / "j")
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "i long")
    assert S.read_journal(spark, at, "a", "i long").collect() == []
    S.journal(rows(1, 2), at, "a", 0)
    S.journal(rows(3), at, "a", 1)
    S.journal(rows(4, 5), at, "a", 1)
    S.journal(rows(9), at, "b", 0)
    rows(7).write.json(f"{at}/run=a/batch=2")
    assert sorted((r.i, r.batch) for r in S.read_journal(spark, at, "a", "i long").collect()) == [(1, 0), (2, 0), (4, 1), (5, 1)]
    assert S.prune(spark, at, ["a", "published"]) == ["run=b"] and sorted(os.listdir(at)) == ["published", "run=a"]
    assert S.read_journal(spark, at, "b", "i long").collect() == [] and S.prune(spark, f"{at}/none", []) == []


def test_reports(spark, tmp_path):
    at = str(tmp_path / "r")
    assert S.newest_report(spark, at) is None
    for n, rev in ((1, "aaaaaaaa"), (2, "bbbbbbbb"), (3, "cccccccc")):
        S.write_report({"files": spark.range(n), "totals": spark.range(1).select(F.lit(n).alias("n"))}, at, f"2026-01-0{n} 00:00:00", rev)
    S.write_report({"files": spark.range(5)}, at, "2026-01-03 00:00:00", "cccccccc")
    newest = S.newest_report(spark, at)
    assert newest == ("2026-01-03 00:00:00", "cccccccc") and S.report_section(spark, at, newest, "files", "id long").count() == 5
    assert S.baseline(spark, at, "cccccccc")[1] == "bbbbbbbb" and S.baseline(spark, at, "cccccccc", "aaaa")[1] == "aaaaaaaa"
    with pytest.raises(LookupError):
        S.baseline(spark, at, "x", "ffff")


def test_guard(spark, tmp_path):
    out = tmp_path / "out"
    (out / "own").mkdir(parents=True)
    assert S.guarded(spark, str(out), "own/x.json").endswith("/own/x.json")
    for path in ("../x", "/etc/x", "own/../../x", ""):
        with pytest.raises(ValueError):
            S.guarded(spark, str(out), path)


def test_rules(spark):
    rules = spark.createDataFrame([("a", 1, "f", 0, True), ("b", 2, "g", 1, False)], "name string, floor int, file string, load_order int, own boolean")
    with pytest.raises(ValueError):
        S.insert_rules(rules, spark.createDataFrame([("a",)], "name string"))
    more = S.insert_rules(rules, spark.createDataFrame([("c", 3)], "name string, floor int"))
    edited = S.edit_rules(more, spark.createDataFrame([("a", None), ("b", 5), ("d", 9)], "name string, floor int"), cleared=["file"])
    assert sorted((r.name, r.floor, r.file) for r in edited.collect()) == [("a", 1, None), ("b", 5, None), ("c", 3, None), ("d", 9, None)]
    left = S.remove_rules(rules, spark.createDataFrame([("a",), ("b",), ("z",)], "name string"), ~F.col("own")).collect()
    assert [(r.name, r.disabled) for r in left] == [("b", True)]
    assert [(r.file, r.nth) for r in S.defined_in(rules.union(rules.withColumn("load_order", F.col("load_order") + 5)), "a").collect()] == [("f", 1), ("f", 2)]
