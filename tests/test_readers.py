from __future__ import annotations

import sqlite3
import subprocess

import pytest

from gritstone.functions import parsing
from gritstone.sources import readers, rules
from gritstone.streaming import results


def one(spark, text, column):
    return spark.createDataFrame([(text,), (None,), ("",)], f"{column} string")


def test_git_tree_and_blobs(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a b.txt").write_text("one\ntwo\n")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "ü.py").write_text("x = 1\n")
    run("add", "-A")
    run("commit", "-qm", "x")
    tree = readers.git_tree(spark, str(tmp_path))
    assert {r.path: (r.size, r.text) for r in readers.git_blobs(tree, str(tmp_path)).collect()} == {"a b.txt": (8, "one\ntwo\n"), "d/ü.py": (6, "x = 1\n")}
    with pytest.raises(RuntimeError):
        readers.git_tree(spark, str(tmp_path), "no-such")
    with pytest.raises(ValueError):
        readers.parse_tree("100644 blob\0")


def test_changed_lines(spark):
    diff = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,0 +2,3 @@ f\n+a\n+b\n+c\n@@ -9 +12 @@\n-a\n+b\n--- a/y\n+++ b/y\n@@ -5,2 +4,0 @@\n-a\n-b\n--- a/z\n+++ /dev/null\n@@ -1 +0,0 @@\n-a\n"
    got = sorted((r.path, r.changed_line) for r in readers.changed_lines(one(spark, diff, "diff")).collect())
    assert got == [("x", 2), ("x", 3), ("x", 4), ("x", 12), ("y", 4), ("y", 5)]


def test_junit(spark):
    xml = '<testsuites><testsuite name="s" file="t.py"><testcase name="a" classname="C" time="0.5"/><testcase name="b" file="u.py" line="3"><failure>x</failure></testcase><testcase name="c"><skipped>y</skipped></testcase></testsuite></testsuites>'
    got = {(r.name, r.file, r.status) for r in readers.junit_cases(spark.createDataFrame([(xml,)], "xml string")).collect()}
    assert got == {("a", "t.py", "passed"), ("b", "u.py", "failed"), ("c", "t.py", "skipped")}


def test_result_lines(spark):
    assert {(r.path, r.line) for r in readers.go_profile(one(spark, "mode: set\na/b.go:3.10,5.2 2 1\na/b.go:9.1,9.5 1 0\n", "profile")).collect()} == {("a/b.go", 3), ("a/b.go", 4), ("a/b.go", 5)}
    assert [(r.test, r.status) for r in readers.go_events(one(spark, 'noise\n{"Action":"pass","Package":"p","Test":"T"}\n{"Action":"run","Test":"U"}\n', "output")).collect()] == [("T", "passed")]
    assert {(r.test, r.status) for r in readers.libtest_results(one(spark, "test a::b ... ok\ntest c ... FAILED\ntest d ... ignored\n", "output")).collect()} == {("a::b", "passed"), ("c", "failed")}
    trx = '<UnitTestResult testName="A" outcome="Passed" duration="00:01:02.5" /><UnitTestResult testName="B" outcome="NotExecuted" />'
    assert [(r.test, r.status, r.seconds) for r in readers.trx_results(one(spark, trx, "xml")).collect()] == [("A", "passed", 62.5)]
    errors = readers.compiler_errors(one(spark, "src/A.cs(3,7): error CS1002: ; expected\ne: file:///x/B.kt:4:2 Unresolved\nfine", "output")).collect()
    assert {(r.path, r.line, r.code) for r in errors} == {("src/A.cs", 3, "CS1002"), ("/x/B.kt", 4, None)}
    assert readers.json_values('{"a": 1}\n{"b": 2} [3]') == [{"a": 1}, {"b": 2}, [3]] and readers.json_values("") == []
    assert readers.test_of("t.py::A::b[1]") == "t.py::A.b" and readers.test_of("t.py") == "t.py"


def test_coverage_database(spark, tmp_path):
    with sqlite3.connect(tmp_path / "c.db") as con:
        con.executescript("CREATE TABLE file (id, path); CREATE TABLE context (id, context); CREATE TABLE line_bits (file_id, context_id, numbits); INSERT INTO file VALUES (1, 'a.py'); INSERT INTO context VALUES (1, 't|run');")
        con.execute("INSERT INTO line_bits VALUES (1, 1, ?)", (bytes([0b10, 0b1]),))
    got = readers.executed_lines(spark.createDataFrame([(str(tmp_path / "c.db"),)], "path string")).collect()
    assert {tuple(r) for r in got} == {("t|run", "a.py", 1), ("t|run", "a.py", 8)}


def test_rules(spark):
    files = [("a.yaml", "rules:\n- {name: x, ask: 'is it\\n  so?', min: 60, where: src/**}\n- {name: y, ensure: closes, each: file}\n"), ("b.yaml", "- {name: x, ensure_absent: leaks, min: {default: 50, big: 70}}\n- {name: y, disabled: true}\n"), ("c.yaml", "")]
    rows = rules.read_rules(spark, files).collect()
    assert [(r.name, r.quantifier, r.floor, r.file) for r in rows] == [("x", "ensure_absent", 0.5, "b.yaml")]
    for bad in ("- {name: x}", "- {name: x, ask: a, colour: red}", "- {ask: a}", "name: x", "- {name: x, ask: a, min: 101}", "- {name: x, ask: a, language: klingon}", "- {name: x, ensure: a, ensure_absent: b}", "- {name: x, ask: a, min: {big: 3}}"):
        with pytest.raises(ValueError):
            rules.parse_rules(bad, "bad.yaml") or (_ for _ in ()).throw(ValueError)


def test_filters():
    words = {"type": ["defect", "security"], "kind": ["too_big", "leak"]}
    assert rules.parse_filters("type=bug, Security, kind=Too-Big", words) == [("type", "defect"), ("type", "security"), ("kind", "too_big")]
    for bad in ("leak", "colour=red", "kind=nothing"):
        with pytest.raises(ValueError):
            rules.parse_filters(bad, words)


SOURCE = '''import os

class TestA(Base):
    @fixture
    def test_b(self, x, *y):
        """Doc 1."""
        if x < 1 and not y:
            os.remove("f")
        return x + 1

def helper():
    def inner():
        return True
    return inner
'''


def test_python_tables(spark):
    df = spark.createDataFrame([(1, "a/test_x.py", SOURCE), (2, "b.py", "def ("), (3, "c.js", "x"), (4, "d.py", None)], "file_id long, path string, source string")
    methods = {r.qualified_name: r for r in parsing.python_methods(df).collect()}
    assert set(methods) == {"TestA.test_b", "helper", "helper.inner"} and methods["TestA.test_b"].test and not methods["helper"].test
    assert (methods["TestA.test_b"].params, methods["TestA.test_b"].complexity, methods["TestA.test_b"].nesting) == (["self", "x", "y"], 3, 1)
    assert [(r.caller.split("::")[1], r.name) for r in parsing.python_calls(df).collect()] == [("TestA.test_b", "os.remove")]
    mutants = {(r.kind, r.original, r.mutated, r.method.split("::")[1]) for r in parsing.python_mutants(df).collect()}
    assert {("boundary", "<", "<=", "TestA.test_b"), ("logic", "and", "or", "TestA.test_b"), ("arithmetic", "+", "-", "TestA.test_b"), ("not", "not y", "y", "TestA.test_b"), ("string", "'f'", "''", "TestA.test_b"), ("removal", "os.remove('f')", "pass", "TestA.test_b"), ("boolean", "True", "False", "helper.inner"), ("number", "1", "0", "TestA.test_b")} <= mutants
    assert not any("Doc" in m[1] for m in mutants)


def drain(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("i1", "k", "2025-01-01 00:00:00", "p", 2, "w", 1, True), ("i1", "k", "2025-01-01 00:01:00", "p", 2, "w", 2, True), ("i2", "k", "2025-01-01 00:02:00", "q", 2, "w", 3, True), ("i3", "k", "2025-01-01 00:03:00", "r", 1, "v", 1, False)]
    schema = "id string, kind string, at string, path string, expected int, worker string, seq int, failed boolean"
    spark.createDataFrame(rows, schema).selectExpr("*", "cast(at as timestamp) as ts").drop("at").withColumnRenamed("ts", "at").write.parquet(src)
    stream = lambda: spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    assert sorted(r.id for r in drain(spark, results.first_results(stream()), "firsts")) == ["i1", "i2", "i3"]
    assert sorted(r.path for r in drain(spark, results.completed(stream()), "done")) == ["p", "r"]
    assert [(r.worker, r.failures) for r in drain(spark, results.failure_runs(stream(), 3), "runs")] == [("w", 3)]
    results.write_once(stream(), str(tmp_path / "out"), str(tmp_path / "cp")).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_mutants_of_every_kind():
    source = 'def f(a):\n    """Doc."""\n    x = [1, 2]\n    (y, z) = a\n    if a:\n        x.append({"k": 1})\n    elif y:\n        pass\n    else:\n        z = ()\n    for i in a:\n        pass\n    return re.match(r"^a+\\b[^x]$", sorted(a, key=lambda v: v.n))\n'
    rows = {(r[5], r[6], r[7]) for r in parsing.mutants_of(1, "a.py", source)}
    assert {("collection", "[1, 2]", "[]"), ("collection", "{'k': 1}", "{}"), ("lambda", "v.n", "None"), ("block", "x.append({'k': 1})", "pass"), ("block", "z = ()", "pass"), ("regex", r"^a+\b[^x]$", r"a+\b[^x]$"), ("regex", r"^a+\b[^x]$", r"^a+[^x]$")} <= rows
    assert sum(r[0] == "body" for r in rows) == 1 and not any(r[0] == "collection" and "y" in r[1] for r in rows) and not any(r[0] == "block" and r[1].startswith(("if", "pass")) for r in rows)


@pytest.mark.parametrize(
    ("pattern", "edits"),
    [(r"^a+\d[^x]?$", [r"a+\d[^x]?$", r"^a+\d[^x]?", r"^a*\d[^x]?$", r"^a+\D[^x]?$", r"^a+\d[x]?$", r"^a+\d[^x]$"]), (r"\bx\\+", [r"x\\+", r"\bx\\*"]), (r"a\$", []), (r"a\\$", [r"a\\"]), ("", []), ("?", []), ("(?:a)*?", ["(?:a)+?"])],
)
def test_regex_edits(pattern, edits):
    assert parsing.regex_edits(pattern) == edits
