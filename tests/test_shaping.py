from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gritstone.functions import shaping as S


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


def value(one, column):
    return one.select(column.alias("x")).first().x


LINES = ["import x", "", "# about", "", "# one", "def one():", "    return 1", "x = 1"]


def arr(lines=LINES):
    return F.array(*(F.lit(x) for x in lines)).cast("array<string>")


def test_lines(one):
    assert value(one, S.numbered(arr(["a", "b"]), 7)) == "L7| a\nL8| b"
    assert tuple(value(one, S.limited(F.lit("abc"), 2))) == ("ab", True) and tuple(value(one, S.limited(F.lit("ab"), 2))) == ("ab", False)
    assert value(one, S.leading_comment(arr(), F.lit(6))) == "# about\n\n# one"
    assert value(one, S.leading_comment(arr(), F.lit(8))) == "" and value(one, S.leading_comment(arr(), F.lit(1))) == "" and value(one, S.leading_comment(arr(), F.lit(3))) == ""
    assert value(one, S.shown_source(arr(), F.lit(6), F.lit(7))) == "# about\n\n# one\ndef one():\n    return 1"
    assert value(one, S.shown_lines(F.array(F.lit("a"), F.lit(None), F.lit(None), F.lit("b"), F.lit(None)))) == f"a\n{S.ELSEWHERE}\nb\n{S.ELSEWHERE}"
    assert value(one, S.shown_lines(S.span_of(arr(), F.lit(5), F.lit(8), F.array(F.lit(5), F.lit(8))))) == f"# one\n{S.ELSEWHERE}\nx = 1"
    assert [tuple(value(one, S.body_lines(F.lit(a), F.lit(b)))) for a, b in ((3, 5), (3, 3))] == [(4, 5), (3, 3)]


def test_excerpts(one):
    long = ["# c", *[f"l{i}" for i in range(1, 10)]]
    at = lambda limit, focus=None: value(one, S.excerpt(arr(long), F.lit(2), F.lit(10), limit, None if focus is None else F.lit(focus)))
    assert at(20) == "\n".join(long) and at(3) == "# c\nl1\nl2\n... (7 more lines)"
    assert at(3, 6) == "... (4 lines above)\nl4\nl5\nl6\n... (3 more lines)" and at(3, 10) == "... (7 lines above)\nl7\nl8\nl9"


def test_fitting_and_wrapping(one):
    assert value(one, S.cut_to_fit(F.lit("abc" * 10), 10)) == "abc" * 10
    for text in ("é" * 40, "ab" * 500, "a" * 3 + "字" * 200):
        cut = value(one, S.cut_to_fit(F.lit(text), 10))
        assert text.startswith(cut) and 5 <= len(cut.encode()) / 3 <= 10
    assert value(one, S.wrapped(F.lit(" a bb  ccc dddddddd e"), 6, "> ")) == ["> a bb", "> ccc", "> dddddddd", "> e"]
    assert value(one, S.wrapped(F.lit(""))) == []


def test_layout(spark):
    df = spark.createDataFrame([("a", 1), ("long", 200), (None, None)], "name string, n int")
    assert {r.line for r in S.fixed_width(df, {"name": "left", "n": "right"}).collect()} == {"a       1", "long  200", ""}
    assert S.fixed_width(df.limit(0), {"name": "left"}).collect() == []


@pytest.mark.parametrize(("column", "want"), [
    (lambda: S.python_module(F.lit("a/b/__init__.py")), "a.b"), (lambda: S.python_module(F.lit("a/b.py")), "a.b"), (lambda: S.type_name(F.lit("returns (string memory)")), "string"), (lambda: S.type_name(F.lit(": number")), "number"),
    (lambda: S.valid_reference(F.lit("a.b?.c")), "a.b?.c"), (lambda: S.valid_reference(F.lit("a[0]()")), "<dynamic>"), (lambda: S.valid_reference(F.lit("a" * 300)), "<dynamic>"), (lambda: S.kind_label(F.lit("split")), "too_big"),
    (lambda: S.kind_label(F.lit("else")), "else"), (lambda: S.percent(F.lit(0.785)), "79%"), (lambda: S.money(F.lit(0.00001234)), "$0.00001234"), (lambda: S.money(F.lit(0.0031)), "$0.0031"), (lambda: S.money(F.lit(3.1)), "$3.10"),
    (lambda: S.money(F.lit(None).cast("double")), "price unknown"), (lambda: S.money(F.lit(0.0)), "$0.0000"), (lambda: S.since(F.lit(89.0)), "89s ago"), (lambda: S.since(F.lit(5399.0)), "90m ago"), (lambda: S.since(F.lit(7200.0)), "2h ago"),
    (lambda: S.since(F.lit(200000.0)), "2d ago"), (lambda: S.since(F.lit(None).cast("double")), ""), (lambda: S.severity_name(F.lit("P1"), F.lit(0.94)), "P1 (0.9)"), (lambda: S.severity_name(F.lit(None).cast("string"), F.lit(1.0)), "-"),
    (lambda: S.band_weight(F.create_map(F.lit("0"), F.lit(0.4)), F.lit("P3")), 0.4), (lambda: S.band_weight(F.create_map(F.lit("0"), F.lit(0.4)), F.lit("P0")), 0.0), (lambda: S.band_weight(F.lit(None).cast("map<string,double>"), F.lit("P0")), 1.0),
    (lambda: S.first_few(arr(["a", "b", "c", "d", "e"])), "a, b, c, +2 more"), (lambda: S.first_few(arr(["a"])), "a"), (lambda: S.spread(F.create_map(*(F.lit(x) for x in ("split", 0.5, "b", 0.2, "a", 0.2, "c", 0.1, "d", 0.001)))), "too_big 50%  a 20%  b 20%  +1 more"),
    (lambda: S.page_caption(F.lit(10), F.lit(124), 10, 10), "11-20 of 124 open issues. --page 3 for the next"), (lambda: S.page_caption(F.lit(1), F.lit(1), 0, 10), "1 open issue"), (lambda: S.page_caption(F.lit(0), F.lit(12), 20, 10), "page 3 is past the end. 12 open issues, 2 pages"),
    (lambda: S.emptied(F.lit("'x'")), "''"), (lambda: S.emptied(F.lit('f"""a\nb"""')), 'f""""""'), (lambda: S.emptied(F.lit("''")), None), (lambda: S.emptied(F.lit("x")), None),
    (lambda: S.mutant_phrase(F.lit("method"), F.lit("a.strip()"), F.lit("a")), "the call to `strip` removed"), (lambda: S.mutant_phrase(F.lit("method"), F.lit("first"), F.lit("last")), "`last` instead of `first`"),
    (lambda: S.mutant_phrase(F.lit("body"), F.lit("x"), F.lit("{ return 0 }")), "the body replaced by `return 0`"), (lambda: S.mutant_phrase(F.lit("chaining"), F.lit("?"), F.lit("")), "the optional `?.` made unconditional"),
    (lambda: S.applied(F.lit("é\nab cd"), F.lit(2), F.lit(3), F.lit("cd"), F.lit("ü")), "é\nab ü"), (lambda: S.applied(F.lit("ab"), F.lit(1), F.lit(0), F.lit("b"), F.lit("c")), None), (lambda: S.applied(F.lit("ab"), F.lit(3), F.lit(0), F.lit("a"), F.lit("c")), None),
    (lambda: S.regex_variants(F.lit(r"^a+\d[^x]?$")), [r"a+\d[^x]?$", r"^a+\d[^x]?", r"^a*\d[^x]?$", r"^a+\D[^x]?$", r"^a+\d[x]?$", r"^a+\d[^x]$"]), (lambda: S.regex_variants(F.lit(r"\bx\\+")), [r"x\\+"]), (lambda: S.regex_variants(F.lit("")), []),
    (lambda: S.starts_with(arr(["a", "b"]), arr(["a"])), True), (lambda: S.starts_with(arr(["a"]), arr(["a", "b"])), False),
])
def test_values(one, column, want):
    assert value(one, column()) == want


def test_names_through_imports(spark):
    df = spark.createDataFrame([("fs.read", [("fs", "node:fs/promises", "*")], True), ("np.x", [("np", "numpy.core", "default")], False), ("j.load", [("j", "json", "loads")], False), ("q::r", [], False)], "n string, i array<struct<alias: string, module: string, name: string>>, s boolean")
    assert [r.x for r in df.select(S.canonical_name(F.col("n"), F.col("i"), F.col("s")).alias("x")).collect()] == [["fs/promises", "read"], ["numpy", "core", "x"], ["json", "loads", "load"], ["q", "r"]]
