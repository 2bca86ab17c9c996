from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gritstone.llm import docpairs

SCHEMA = "file_id long, path string, language string, source string, declarations array<struct<id string, kind string, name string, qualified_name string, line int, end_line int>>, received_at string, doc string"

PY = '''import x

# Reads the table and keeps every late row.
@cached(
    1,
)
def one(a):
    return a


def two(a,
        b):
    # inner note
    """Adds both numbers,
    then rounds the sum.
    """
    return a + b

# Far away comment about something else entirely.

def three():
    x = "# not a comment"
    return x

def four(): return 1
'''


def decls(source, *names, end=True):
    lines = source.split("\n")
    out = []
    for n in names:
        at = next(i for i, x in enumerate(lines, 1) if n + "(" in x and not x.strip().startswith(("#", "/", "*")))
        out.append((f"function:{at}", "function", n, n, at, None))
    return out


def run(spark, rows, with_code=True):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("received_at", F.to_timestamp("received_at"))
    return df, docpairs.documented(df, with_code)


def test_python(spark):
    df, docs = run(spark, [(1, "a.py", None, "﻿" + PY.replace("\n", "\r\n"), decls(PY, "one", "two", "three", "four"), "2025-01-01", "")])
    got = {r.name: r for r in docs.collect()}
    assert set(got) == {"one", "two"} and (got["one"].end_line, got["two"].end_line) == (8, 17)
    pairs = {r.decl_id: r for r in docpairs.code_doc_pairs(df).collect()}
    assert pairs["function:11"].documentation == "Adds both numbers,\nthen rounds the sum." and pairs["function:7"].code == "def one(a):\n    return a"


C_LIKE = """/**
 * Keeps the larger of both sides.
 *
 * @param a input
 */
@Deprecated
public long one(long a) {
    if (a > 1) {
        return 2;
    }
    return a;
}
// one line above about rounding half up
long two(long b) { return b; }

/* @param c the rows */
long three(long c) {
    return c; // trailing words about nothing
}
long four(long d) { return d; }
"""


def test_java(spark):
    _, docs = run(spark, [(1, "A.java", "java", C_LIKE, decls(C_LIKE, "one", "two", "three", "four"), None, "")])
    assert {r.name: r.end_line for r in docs.collect()} == {"one": 12, "two": 14}


@pytest.mark.parametrize(
    "text", ["", None, "/** */", "// ---------", "# TODO: write", "/** {@inheritDoc} */", "// eslint-disable-next-line", "// if (a > 1) return b;", "# x = compute(a, 2)", "/** Load the user. */", "// loadUser", "/** @param a b\n * @return c */", "// See above.", "/// Method loadUser()", "# noqa: E501", "This function is used to load the user.", "//=====", "// Loads users of the given id."]
)
def test_trivial(text):
    assert docpairs.is_trivial(text, "loadUser", "User loadUser(long id)")


@pytest.mark.parametrize("text", ["// Returns minutes, not seconds.", "/** Loads the user and its open orders. */", "Berechnet die Summe aller offenen Posten.", "# TODO: speed up\n# Falls back to yesterday's table where today's is late.", "<p>Safe to call twice from different threads.</p>"])
def test_telling(text):
    assert not docpairs.is_trivial(text, "loadUser", "User loadUser(long id)")


def test_deliveries_and_dirty_rows(spark):
    good, bare = "# Counts the rows of late tables.\ndef f():\n  pass\n", "def f():\n  pass\n"
    d = [("function:1", "function", "f", "f", 2, 3)]
    rows = [
        (1, "a.py", "py", good, d, "2025-01-01", ""), (1, "a.py", "py", bare, [("function:1", "function", "f", "f", 1, 2)], "2025-02-01", ""),
        (2, "a.py", "py", good, d, "2025-01-01", ""), (2, "a.py", "py", good, d, "2025-01-01", ""), (3, "a.py", "py", good, None, None, ""), (4, "a.py", "py", None, d, None, ""), (5, "x.cob", None, good, d, None, ""),
        (None, "a.py", "py", good, d, None, ""), (6, "a.py", "py", "", d, None, ""), (7, "a.py", "py", good, [(None, "function", "f", "f", 2, 3), ("x", "function", None, None, None, None), ("y", "function", "f", "f", 99, 1), ("z", "function", "f", "f", 2, None), ("z", "function", "f", "f", 2, None)], None, ""),
    ]
    _, docs = run(spark, rows, False)
    assert sorted((r.file_id, r.decl_id) for r in docs.collect()) == [(2, "function:1"), (7, "z")]
    assert run(spark, [], True)[1].collect() == []


def test_long_comment_and_many_functions(spark):
    source = "# " + "word and number\n# " * 3000 + "end of it\n" + "\n".join(f"def f{i}():\n    '''Keeps row number {i} of late tables.'''\n" for i in range(500))
    _, docs = run(spark, [(1, "a.py", "py", source, decls(source, *(f"f{i}" for i in range(500))), None, "")], False)
    assert docs.count() == 500


def test_docstring_of_many_lines(spark):
    source = 'def one(a):\n    """Keeps every late row.\n' + "    More about late rows.\n" * 900 + '    """\n    return a\n'
    df, docs = run(spark, [(1, "a.py", "py", source, decls(source, "one"), None, "")])
    assert [r.decl_id for r in docs.collect()] == ["function:1"]
    assert docpairs.code_doc_pairs(df).first().documentation.count("\n") == 900


@pytest.mark.parametrize(
    ("source", "language", "wanted", "head"),
    [
        ("def one(\n" + "".join(f"    p{i},\n" for i in range(90)) + "    last_one,\n):\n    pass\n", "python", {1}, "last_one"), ("def one(a={},\n        last_one=1):\n    pass\n", "python", {1}, "last_one"),
        ("function one({a, b}, last_one) {\n  return body;\n}\n", "javascript", {1}, "last_one"), ('def one(a="(",\n        b=1):\n    last_one\n', "python", {1}, None), ("long one(\n  long a\n\nlong two(long last_one) {}\n", "java", {1, 4}, None),
    ],
)
def test_signature_to_its_end(source, language, wanted, head):
    heads = {}
    docpairs.lex_rows(source, language, wanted, None, heads)
    assert ("last_one" in heads[1]) is (head is not None) and "body" not in heads[1]
