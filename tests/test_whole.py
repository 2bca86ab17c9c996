"""Queries that take whole tables, against brute force on fixtures."""

from __future__ import annotations

import random

from gritstone.plans import catalog


def test_worst_status_of_late_lines(spark, tmp_path):
    lines = [(1, 1, "N"), (1, 2, "A"), (1, 7, "R"), (2, 1, "A"), (2, 3, "N"), (3, 5, "A")]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.l_orderkey: (r.worst, r.case_worst) for r in catalog.queries()["worst_status_whole"](spark, str(tmp_path)).collect()}
    assert got == {1: ("failed", "failed"), 2: ("passed", "skipped"), 3: ("skipped", "skipped")}


def test_reach_from_all_parts(spark, tmp_path):
    r = random.Random(7)
    parts = [(i, r.randint(1, 50)) for i in range(1, 41)]
    lines = [(o, n, r.randint(1, 40)) for o in range(1, 21) for n in range(1, 4)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    site = {}
    for (o, n, a), (p, _, b) in zip(lines, lines[1:]):
        if o == p and a != b:
            site[a, b] = min(o, site.get((a, b), o))

    def reach(edges, shut=frozenset()):
        out = {}
        for start in {k for k, _ in parts} - shut:
            at = {start: 0}
            for depth in (1, 2, 3):
                for a, b in edges:
                    if at.get(a) == depth - 1 and b not in at and not {a, b} & shut:
                        at[b] = depth
            out |= {(start, node): depth for node, depth in at.items() if depth}
        return out

    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    depths = lambda name: sorted((x.start, x.node, x.depth) for x in run(name))
    flat = lambda found: sorted((*k, d) for k, d in found.items())
    whole, written = reach(site), reach([e for e, first in site.items() if first % 2])
    assert depths("reach_depth3_whole") == flat(whole) and depths("reach_with_cuts_whole") == flat(reach(site, frozenset(k for k, size in parts if size % 4 == 1)))
    assert sorted((x.start, x.node) for x in run("dispatch_only_whole")) == sorted(set(whole) - set(written))


def test_question_that_never_fits(spark, tmp_path):
    rows = spark.range(9000).selectExpr("cast(id as string) AS finding_id", "'r' AS repo", "CASE WHEN id < 5469 THEN 'b' WHEN id < 5470 THEN 'a' ELSE 'c' END AS type")
    rows.write.parquet(f"{tmp_path}/findings.parquet")
    assert {r.type: r.batch for r in catalog.queries()["question_batches"](spark, str(tmp_path)).collect()} == {"a": 0, "b": -1, "c": 0}


def test_tests_over_all_lines(spark, tmp_path):
    lines = [(1, 1, 11, "N"), (1, 2, 12, "A"), (2, 1, 11, "N"), (3, 4, 11, "R"), (3, 5, 12, "N"), (3, 6, 13, "N"), (4, 4, 14, "R"), (4, 5, 15, "A"), (4, 6, 16, "N"), (5, 4, 17, "R"), (5, 5, 18, "N"), (5, 6, 19, "N")]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1), (5, 2)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    run = lambda name: [tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).collect()]
    assert run("checks_nothing_whole") == [(1, 2, 0)] and run("redundant_tests_whole") == [(4, 3)]
