from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from gritstone.functions import globs, lexing
from gritstone.functions import text as X
from gritstone.operators import coverage, graph, packing, scoring, selection, state


@pytest.mark.parametrize(
    ("glob", "path", "held"),
    [
        ("*.py", "a.py", True), ("*.py", "src/a.py", False), ("**/*.py", "a.py", True), ("**/*.py", "src/deep/a.py", True), ("src/**", "src/a/b.c", True), ("src/**", "src", False),
        ("src/*/x.js", "src/a/x.js", True), ("src/*/x.js", "src/a/b/x.js", False), ("a?b", "a?b", True), ("a?b", "axb", False), ("[ab].c", "[ab].c", True), ("{a,b}/*.{js,ts}", "b/x.ts", True),
        ("{a,{b,c}}.x", "c.x", True), ("{open", "{open", True), ("a**b", "axyb", True), ("a**b", "ax/yb", False),
    ],
)
def test_globs(glob, path, held):
    assert bool(re.match(globs.glob_regex(glob), path)) is held


def test_too_many_alternatives():
    with pytest.raises(ValueError):
        globs.expand_braces("{a,b,c,d,e,f,g,h,i}" * 4)


def test_pathological_glob_is_quick():
    assert not re.match(globs.glob_regex("**/" * 40 + "x"), "a/" * 40 + "y")


@pytest.mark.parametrize(
    ("directory", "pattern", "path", "held"),
    [("", "*.gen.ts", "a/b.gen.ts", True), ("web", "*.js", "lib/a.js", False), ("web", "/dist/**", "web/dist/a/b", True), ("", "docs/*.md", "x/docs/a.md", False), ("", "a[!b].c", "ac.c", True), ("", "a[!b].c", "ab.c", False)],
)
def test_attribute_patterns(directory, pattern, path, held):
    assert bool(re.match(globs.attribute_regex(directory, pattern), path)) is held


def test_mask_keeps_lines():
    src = 'x = "# no"  # yes\n"""a\nb"""\n'
    masked = lexing.mask(src, "python")
    assert masked.count("\n") == src.count("\n") and "no" not in masked and "yes" not in masked


def test_language_spellings():
    assert [lexing.language_of(a, b) for a, b in (("Py", None), (None, "a/b.rs"), ("", "x.TS"), ("cobol", "a.go"), (None, None), (None, "Makefile"))] == ["python", "rust", "typescript", "go", None, None]


def test_issues_at_the_floor(spark):
    answers = spark.createDataFrame([(1, "a", 0.6), (1, "b", 0.61), (2, "c", 0.2), (2, "g", 0.5), (3, "d", 0.9), (4, "d", 0.9), (4, "g", 1.0), (None, "a", 1.0)], "u long, q string, v double")
    questions = [scoring.Question("a", "defect", floor=0.6, strongest=True), scoring.Question("b", "defect", floor=0.6, strongest=True), scoring.Question("c", "docs", on_true=False), scoring.Question("d", "security", when="g"), scoring.Question("g")]
    got = {(r.u, r.question) for r in scoring.raise_issues(scoring.answer_map(answers, "u", "q", "v"), "u", questions, 0.5).collect()}
    assert got == {(1, "b"), (2, "c"), (4, "d")}


def test_severity_bands(spark):
    df = spark.sql("SELECT map('0', 0.5, '3', 0.5) AS m UNION ALL SELECT map('3', 1.0) UNION ALL SELECT map('1', 0.4, '2', 0.6)")
    got = sorted((round(r.s.expected, 3), r.s.band, r.s.likeliest) for r in df.select(scoring.severity(F.col("m")).alias("s")).collect())
    assert got == [(1.5, "P1", "P3"), (1.6, "P1", "P1"), (3.0, "P0", "P0")]


def test_closures_fold(spark):
    rows = [(1, "x", "dismissed", ["a", "b"]), (2, "x", "reopened", ["a"]), (3, "y", "dismissed", ["a"]), (4, "y", "reopened", []), (5, "y", "dismissed", ["b"]), (6, "z", "dismissed", None)]
    got = {(r.id, r.kind): r.closed for r in state.fold_closures(spark.createDataFrame(rows, "seq int, id string, type string, kinds array<string>")).collect()}
    assert got == {("x", "a"): False, ("x", "b"): True, ("y", "a"): False, ("y", "b"): True}


def test_reach_on_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 9)], "source int, target int")
    got = sorted((r.node, r.depth) for r in graph.reach(edges, spark.createDataFrame([(1,)], "start int")).collect())
    assert got == [(2, 1), (3, 2), (4, 3)]
    cut = graph.reach(edges, spark.createDataFrame([(1,)], "start int"), cut=spark.createDataFrame([(3,)], "node int"))
    assert [r.node for r in cut.collect()] == [2]


def test_touched_and_innermost(spark):
    spans = spark.createDataFrame([("u1", "f", 1, 500), ("u2", "f", 100, 120), ("u3", "g", 1, 10), ("u4", "f", 9, 3)], "unit string, file string, line int, end_line int")
    changed = spark.createDataFrame([("f", 110), ("f", 900), ("g", None)], "file string, changed_line int")
    assert sorted(r.unit for r in coverage.touched_units(spans, changed, "unit", "file").collect()) == ["u1", "u2"]
    owners = coverage.innermost(spans.withColumnRenamed("unit", "owner"), changed.where("changed_line IS NOT NULL").withColumnRenamed("changed_line", "point"), "file").collect()
    assert [(r.point, r.owner) for r in owners] == [(110, "u2")]


def test_status_orders_differ(spark):
    rows = spark.createDataFrame([(1, "skipped"), (1, "passed"), (2, "error"), (2, "failed"), (3, "odd"), (3, None)], "k int, s string")
    assert {r.k: r.worst for r in coverage.worst_status(rows, "k", "s").collect()} == {1: "passed", 2: "error", 3: None}
    assert {r.k: r.worst for r in coverage.worst_status(rows, "k", "s", coverage.CASE_ORDER).collect()} == {1: "skipped", 2: "error", 3: None}


def test_packing():
    assert packing.pack([5, 5, 5, 50, 1], 10, 9) == [0, 0, 1, -1, 1]
    assert packing.pack([1, 1, 1], 10, 2) == [0, 0, 1] and packing.pack([], 3, 3) == []


@pytest.mark.parametrize("text", ["", "a", "line\n" * 900, "ä" * 4000, "x" * 5000])
def test_chunks_cover_without_gap(text):
    spans = packing.chunk_text(text, 100, 25)
    at = 0
    for first, last in spans:
        assert first <= at < last and len(text[first:last].encode()) <= 300
        at = last
    assert at == len(text)


def test_selectors(spark):
    units = spark.createDataFrame([("a", "src/a.js", "x lock y"), ("b", "src/b.py", "z"), ("c", "lib/c.js", "lock")], "id string, path string, text string")
    edges = spark.createDataFrame([("b", "q")], "source string, target string")
    ids = lambda *a: sorted(r.id for r in selection.select_units(units, *a).collect())
    assert ids(["src/**"], ["**/*.py"]) == ["a"] and ids(["mentions lock", "callers of q"], [], edges) == ["a", "b", "c"] and ids([]) == ["a", "b", "c"]


def test_texts(spark):
    row = spark.range(1).select(
        X.keep_end(F.lit("abcdef"), 4).alias("e"), X.keep_start(F.lit("abcdef"), 4).alias("s"), X.token_estimate(F.lit("äb")).alias("t"), X.finding_id(F.lit("a.py::f")).alias("f"),
        X.eligible_path(F.lit("a/.yarn/cache/x.js")).alias("p"), X.eligible_path(F.lit("src/node_modules.js")).alias("q"), X.eligible_path(F.lit("a/x.min.js")).alias("m"), X.file_language(F.lit("x/Makefile")).alias("k"),
    ).first()
    import hashlib

    assert tuple(row) == ("…def", "abc…", 1, hashlib.sha256(b'["finding","a.py::f"]').hexdigest()[:8], False, True, False, "make")
