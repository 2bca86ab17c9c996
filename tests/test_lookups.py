from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gritstone.operators import lookups as L


@pytest.fixture(scope="module")
def make(spark):
    return lambda schema, *rows: spark.createDataFrame(list(rows), schema)


def got(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_readings_and_closures(make):
    methods, readings = make("id string, hash string", ("a", "1"), ("b", "1"), ("c", None)), make("id string, hash string, p double", ("a", "1", 0.5), ("b", "2", 0.6), ("z", "9", 0.7))
    assert got(L.with_readings(methods, readings, ["p"]), "id", "p", "state") == {("a", 0.5, "read"), ("b", None, "unread"), ("c", None, "unread"), ("z", 0.7, "gone")}
    findings = make("id int, method_id int, rule string", (1, 10, "r"), (2, 10, "s"), (3, 11, "r"), (4, 11, None))
    closures = make("id int, rule string, closed boolean", (10, "r", True), (1, None, False), (11, "r", True))
    assert got(L.closure_of(findings, closures), "id", "closed") == {(1, False), (2, False), (3, True), (4, False)}


def test_lines_prefixes_and_overlays(make):
    files = make("path string, lines array<string>", ("a", ["1", "2", "3"]))
    assert [(r.path, r.lines) for r in L.with_lines(make("path string, line int", ("a", 2), ("b", 1)), files, 1).orderBy("path").collect()] == [("a", ["2"]), ("b", None)]
    ids = make("id string", ("abcd1",), ("abcd2",), ("abce1",), ("abce1",))
    assert got(L.by_prefix(make("ref string", ("abcd",), ("abcd1",), ("abce",), ("abc",), ("zzzz",)), ids), "ref", "id", "matches") == {("abcd", None, 2), ("abcd1", "abcd1", 1), ("abce", "abce1", 1), ("abc", None, 0), ("zzzz", None, 0)}
    assert got(L.overlay(make("path string, v int", ("a", 1), ("b", 1)), make("path string, v int", ("b", 2), ("c", 2))), "path", "v") == {("a", 1), ("b", 2), ("c", 2)}
    assert got(L.unmatched(make("test string, s string", ("x", "p"), ("y", "p")), make("test string", ("x",))), "test") == {("y",)}


def test_names(make):
    definitions = make("scope string, name string, id string", ("", "f", "f0"), ("a", "f", "fa"), ("a::b", "f", "fb1"), ("a::b", "f", "fb2"), ("a", "g", "ga"))
    uses = make("use int, scope string, name string", (1, "a::b", "f"), (2, "a::c", "f"), (3, "z", "f"), (4, "a::b::c", "g"), (5, "z", "g"), (6, "", "f"))
    assert got(L.nearest_scope(uses, definitions), "use", "id") == {(2, "fa"), (3, "f0"), (4, "ga"), (6, "f0")}
    a, b = make("k int, v string", (1, "x"), (1, "y"), (2, "x"), (2, "x"), (3, None)), make("k int, v string", (1, "z"), (3, "w"), (4, "q"))
    assert got(L.first_answer("k", "v", a, b), "k", "v", "step") == {(2, "x", 0), (3, "w", 1), (4, "q", 1)}
    files = make("path string, name string, id string", ("p", "x", "px"), ("q", "x", "qx"), ("q", "y", "qy"))
    assert got(L.through_wildcards(make("use int, path string, name string", (1, "m", "x"), (2, "m", "y"), (3, "n", "x")), make("path string, nth int, source string", ("m", 1, "p"), ("m", 2, "q")), files), "use", "id") == {(1, "px"), (2, "qy")}
    packaged = make("path string, package string, name string, id string", ("d/a.go", "d", "f", "1"), ("d/b.go", "d", "g", "2"), ("d/c_test.go", "d_test", "h", "3"), ("e/a.go", "d", "i", "4"))
    assert got(L.same_package(make("use int, path string, package string, name string", (1, "d/b.go", "d", "f"), (2, "d/b.go", "d", "g"), (3, "d/b.go", "d", "h"), (4, "d/b.go", "d", "i")), packaged), "use", "id") == {(1, "1")}


def test_exports(make):
    definitions = make("path string, name string, id string", ("impl", "f", "f"), ("deep", "g", "g"), ("index", "own", "own"), ("loop1", "h", "h"))
    reexports = make("path string, name string, source string, original string", ("index", "renamed", "impl", "f"), ("index", None, "mid", None), ("mid", None, "deep", None), ("loop1", None, "loop2", None), ("loop2", None, "loop1", None), ("s1", None, "s2", None), ("s2", None, "s3", None), ("s3", None, "deep", None))
    asked = make("path string, name string", ("index", "renamed"), ("index", "f"), ("index", "g"), ("index", "own"), ("loop2", "h"), ("loop2", "none"), ("s1", "g"))
    want = {("index", "renamed", "f"), ("index", "g", "g"), ("index", "own", "own"), ("loop2", "h", "h"), ("s1", "g", "g")}
    assert got(L.exported(asked, definitions, reexports), "path", "name", "id") == want
    assert got(L.exported(asked, definitions, reexports, depth=2), "path", "name", "id") == want - {("s1", "g", "g")}


def test_members_overloads_and_arguments(make):
    classes = make("owner string, name string, id string", ("A", "x", "A.x"), ("B", "x", "B.x"), ("B", "y", "B.y"), ("C", "z", "C.z"))
    assert got(L.members(classes, make("child string, base string", ("A", "B"), ("B", "C"), ("C", "A"), ("D", "A"))), "owner", "name", "id") >= {("A", "x", "A.x"), ("A", "y", "B.y"), ("A", "z", "C.z"), ("D", "x", "A.x"), ("D", "y", "B.y")}
    methods = make("id string, path string, qualified_name string, parameters int", ("f", "p", "f", 1), ("f#2", "p", "f", 2), ("g", "p", "g", 3))
    assert got(L.overloads(make("call int, target string, arguments int", (1, "f", 2), (2, "f", 0), (3, "g", 4)), methods), "call", "id") == {(1, "f#2"), (2, "f"), (2, "f#2")}
    arguments = make("callee string, nth int, name string, value string", ("f", 0, None, "v0"), ("f", 5, None, "no"), ("f", 1, "b", "vb"), ("f", 0, "zz", "no"))
    assert got(L.argument_values(arguments, make("callee string, nth int, parameter string", ("f", 0, "a"), ("f", 1, "b"))), "parameter", "value") == {("a", "v0"), ("b", "vb")}


def test_edges(make):
    written = make("source string, target string", ("a", "b"), ("a", "b"), ("p", "in1"))
    assert got(L.with_inferred(written, make("source string, target string", ("a", "b"), ("b", "c"), ("c", "c"))), "source", "target", "dynamic") == {("a", "b", False), ("p", "in1", False), ("b", "c", True)}
    assert got(L.containment(make("id string, parent string, test boolean", ("in1", "p", None), ("in2", "p", False), ("in3", "p", True), ("top", None, None)), written), "source", "target") == {("p", "in2")}
    assert got(L.closed_names(make("name string", ("a",), ("a",)), make("alias string, name string", ("b", "a"), ("c", "b"), ("a", "c"), ("z", "y"))), "name") == {("a",), ("b",), ("c",)}
    reads = make("path string, name string", ("p", "conf.x"), ("p", "os.x"), ("q", "conf.x"))
    assert got(L.uses_imported(reads, make("path string, alias string, target string", ("p", "conf", "conf.py"), ("p", "os", None))), "path", "name") == {("p", "conf.x")}
    assert got(L.top_per_unit(make("unit int, n int, s int", (1, 1, 5), (1, 2, 6), (1, 3, 5), (2, 4, 0)), 2, F.desc("s"), F.asc("n")), "unit", "n", "rank_no") == {(1, 2, 1), (1, 1, 2), (2, 4, 1)}
