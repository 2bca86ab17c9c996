from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gritstone.llm import topn

SCHEMA = "repo string, method string, s double, c double, id long, rank_no string, g int, severity string"


def brute(rows, n):
    groups = {}
    for r in rows:
        if r[0] is not None and r[1] is not None:
            groups.setdefault((r[0], r[1]), []).append(r)
    inf = float("inf")
    out = []
    for rs in groups.values():
        rs.sort(key=lambda r: (inf if r[2] is None else r[2], inf if r[3] is None else -r[3], r[4]))
        out += [(r[4], k + 1) for k, r in enumerate(rs[:n])]
    return sorted(out)


def run(spark, rows, n, state_rows=50):
    df = spark.createDataFrame(rows, SCHEMA)
    top = topn.top_n(df, ["repo", "method"], [F.col("s"), -F.col("c")], "id", n, state_rows=state_rows)
    assert set(top.columns) == set(df.columns)
    return sorted((r.id, r.rank_no) for r in top.collect())


def test_hot_group_ties_nulls_and_clashing_names(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice(["m", "m", "k", None]), rng.choice([None, 1.0, 2.0]), rng.choice([None, 0.5, 0.9]), i, "x", 1, "P1") for i in range(3000)]
    rng.shuffle(rows)
    for n in (1, 3, 700):
        assert run(spark, rows, n) == brute(rows, n)


def test_none_and_empty(spark):
    assert run(spark, [], 3) == [] and run(spark, [("a", "m", 1.0, 1.0, 1, "", 0, "")], 0) == []


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.sampled_from(["m", "k"]), st.one_of(st.none(), st.integers(0, 3).map(float)), st.one_of(st.none(), st.integers(0, 2).map(float))), max_size=40), st.integers(1, 4))
def test_random(spark, rows, n):
    full = [(*r, i, "", 0, "") for i, r in enumerate(rows)]
    assert run(spark, full, n, state_rows=5) == brute(full, n)


@pytest.mark.parametrize(("text", "number"), [("P1 (0.8)", 0.8), ("p2(2.0)", 2.0), ("P0", 0.0), ("P3", 3.0), ("-", None), ("", None), (None, None), ("1.5", 1.5), ("high", None)])
def test_severity(spark, text, number):
    assert spark.createDataFrame([(text,)], "t string").select(topn.severity_number(F.col("t"))).first()[0] == number


@pytest.mark.parametrize(("text", "number"), [("81%", 0.81), ("81 %", 0.81), ("0.81", 0.81), ("100%", 1.0), ("-", None), (None, None), ("", None), ("1", 1.0)])
def test_confidence(spark, text, number):
    assert spark.createDataFrame([(text,)], "t string").select(topn.confidence_number(F.col("t"))).first()[0] == number


def test_latest_delivery_counts(spark):
    rows = [(1, "r", "m", "P0", "90%", "2025-01-01 00:00:00"), (1, "r", "m", "P3", "90%", "2025-02-01 00:00:00"), (2, "r", "m", "P1", None, None), (None, "r", "m", "P0", "1", "2025-01-01 00:00:00"), (3, "r", None, "P0", "1", None)]
    df = spark.createDataFrame(rows, "finding_id long, repo string, method string, severity string, confidence string, received_at string").withColumn("received_at", F.col("received_at").cast("timestamp"))
    assert [(r.finding_id, r.rank_no) for r in topn.top_findings(df, 3).orderBy("rank_no").collect()] == [(2, 1), (1, 2)]
