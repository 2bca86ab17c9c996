"""Reachability from many starts, against the one from few and against what is shuffled."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from gritstone.operators import balls, graph
from gritstone.plans import catalog


def _sent(spark, run):
    """The rows of ``run()``, and how many records its stages shuffled."""
    sc = spark.sparkContext
    store, gateway = sc._jsc.sc().statusStore(), sc._gateway
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (lambda all: [all.apply(i) for i in range(all.size())])(store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList()))}
    before = set(stages())
    rows = [tuple(x) for x in run().collect()]
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return rows, sum(n for k, n in stages().items() if k not in before)


def _lines(spark, path):
    """240 parts, each called by about six others."""
    r = random.Random(11)
    spark.createDataFrame([(i, r.randint(1, 50)) for i in range(240)], "p_partkey long, p_size int").write.parquet(f"{path}/part.parquet")
    spark.createDataFrame([(o, n, r.randrange(240)) for o in range(240) for n in range(1, 8)], "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{path}/lineitem.parquet")


def test_dispatched_pairs_are_not_shuffled(spark, tmp_path):
    _lines(spark, tmp_path)
    rows, sent = _sent(spark, lambda: catalog.queries()["dispatch_only_whole"](spark, str(tmp_path)))
    assert len(rows) > 15_000 and sent < len(rows)


def test_reached_pairs_are_not_shuffled(spark, tmp_path):
    _lines(spark, tmp_path)
    rows, sent = _sent(spark, lambda: catalog.queries()["reach_depth3_whole"](spark, str(tmp_path)))
    assert len(rows) > 30_000 and sent < len(rows)


def test_pairs_of_a_cut_graph_are_not_shuffled(spark, tmp_path):
    _lines(spark, tmp_path)
    rows, sent = _sent(spark, lambda: catalog.queries()["reach_with_cuts_whole"](spark, str(tmp_path)))
    assert len(rows) > 10_000 and sent < len(rows)


def test_same_as_from_few(spark, monkeypatch):
    r = random.Random(5)
    edges = spark.createDataFrame([(f"n{a}", f"n{b}", r.random() < 0.5) for a, b in ((r.randrange(150), r.randrange(150)) for _ in range(500))] + [(None, "n1", True), ("n1", None, True), ("n2", "n2", False)], "source string, target string, plain boolean")
    starts = spark.createDataFrame([(f"n{i}",) for i in (*range(0, 140), 3, 900)] + [(None,)], "start string")
    cut = spark.createDataFrame([(f"n{i}",) for i in range(0, 150, 9)], "node string")
    known = edges.where("source IS NOT NULL AND target IS NOT NULL")
    flat = lambda df: sorted(tuple(x) for x in df.collect())
    monkeypatch.setattr(balls, "FOLLOWED", 60)  # batches of starts are halved
    for depth, shut, size in ((1, None, 100_000), (3, None, 2), (3, cut, 100_000), (4, cut, 1)):
        assert flat(balls.reach_from_many(edges, starts, depth, shut, block=size)) == flat(graph.reach(known, starts.where("start IS NOT NULL"), depth, shut))
    plain = graph.reach(known.where("plain"), starts, 3).select("start", "node")
    whole = graph.reach(known, starts, 3).join(plain, ["start", "node"], "left_anti")
    assert flat(balls.reach_from_many(edges, starts, 3, unless=F.col("plain"), block=50)) == flat(whole.select("start", "node", "depth"))
    assert flat(balls.reach_from_many(edges.limit(0), starts, 3)) == flat(balls.reach_from_many(edges, starts.limit(0), 3)) == []
