from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gritstone.llm import setjoin


def brute(rows, t):
    sets = {}
    for i, tokens in rows:
        s = frozenset(x.strip(" ").lower() for x in tokens or [] if x is not None and x.strip(" "))
        if i is not None and s:
            sets[i] = s
    ids = sorted(sets)
    return sorted((a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, tokens array<string>")


@pytest.mark.parametrize("t", [0.5, 0.8, 1.0])
def test_against_brute_force(spark, t):
    rng = random.Random(int(t * 10))
    rows = []
    for i in range(160):
        if rows and rng.random() < 0.5:
            base = list(rng.choice(rows)[1] or ["h"])
            for _ in range(rng.randint(0, 2)):
                if rng.random() < 0.5 and len(base) > 1:
                    base.pop(rng.randrange(len(base)))
                else:
                    base.append(f"t{rng.randint(0, 60)}")
        else:
            base = [f"t{rng.randint(0, 60)}" for _ in range(rng.randint(1, 14))]
        rows.append((i, ["hot", *base]))
    got = sorted((r.a, r.b) for r in setjoin.similar_pairs(frame(spark, rows), "id", F.col("tokens"), t).collect())
    assert got == brute(rows, t) and got


def test_dirty_sets(spark):
    rows = [(1, ["A", " b", None, "b"]), (2, ["a", "B "]), (3, []), (4, None), (5, [None, ""]), (None, ["a", "b"]), (6, ["a", "b", "c"])]
    assert sorted((r.a, r.b) for r in setjoin.similar_pairs(frame(spark, rows), "id", F.col("tokens"), 0.8).collect()) == [(1, 2)]


def test_empty_table_and_bad_threshold(spark):
    assert setjoin.similar_pairs(frame(spark, []), "id", F.col("tokens"), 0.8).collect() == []
    with pytest.raises(ValueError):
        setjoin.similar_pairs(frame(spark, []), "id", F.col("tokens"), 0)


def test_a_large_class_of_copies_is_one_link(spark):
    rows = [(i, ["a", "b", "c", "d", "e"]) for i in range(300)] + [(900, ["a", "b", "c", "d"])]
    members, links = setjoin.similar_classes(frame(spark, rows), "id", F.col("tokens"), 0.8)
    assert members.count() == 301 and [(r.a, r.b) for r in links.collect()] == [(0, 900)]


def test_long_sets_hot_tokens_and_sliced_classes(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "TOGETHER", 7)
    rng = random.Random(5)
    long = [f"t{i}" for i in range(2000)]
    rows = [(i, rng.sample(long, 2000 - rng.randint(0, 300))) for i in range(12)] + [(100 + i, ["x", "y", "z"]) for i in range(40)] + [(200 + i, ["x", "y", "z", "w", "v"][: 4 + i % 2]) for i in range(20)]
    for together in (6, 1000):
        got = sorted((r.a, r.b) for r in setjoin.similar_pairs(frame(spark, rows), "id", F.col("tokens"), 0.75, members_together=together).collect())
        assert got == brute(rows, 0.75) and len(got) > 1000


def test_the_newest_row_of_an_id_counts(spark):
    rows = [(1, ["a", "b"], 1), (1, ["c", "d"], 2), (2, ["c", "d"], 1), (3, ["a", "b"], None), (3, ["c", "d"], 0), (4, ["a", "b"], 5), (4, ["a", "b"], 5)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>, at int")
    assert sorted((r.a, r.b) for r in setjoin.similar_pairs(df, "id", F.col("tokens"), 0.8, F.col("at")).collect()) == [(1, 2), (1, 3), (2, 3)]
