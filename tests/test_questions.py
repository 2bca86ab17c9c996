from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gritstone.operators import questions as Q

ROWS = [
    ("has_bug", "method", "noul", None, None, None, "defect", "kind", "none", None, True, "h1"), ("kind", "method", "choice", ["boundary", "ordering", "none"], None, None, None, None, None, None, None, "h2"), ("severity", "method", "score", None, None, None, None, None, None, None, None, "h3"),
    ("cwe_89", "method", "noul", None, ["python"], "reaches_input", "security", "sql_injection", None, None, True, "h4"), ("reaches_input", "method", "noul", None, None, None, None, None, None, None, None, "h5"),
    ("documented", "method", "noul", None, None, None, "docs", "self", None, None, False, "h6"), ("split", "method", "noul", None, None, None, "refactor", None, None, None, False, "h7"), ("no_todo", "file", "noul", None, None, None, None, None, None, True, None, "h8"),
]


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(ROWS, Q.SCHEMA)


def names(df):
    return {r.name for r in df.collect()}


def test_labels_and_vocabulary(questions):
    got = {(r.name, r.issue_type, r.label) for r in Q.labels(questions).collect()}
    assert got == {("has_bug", "defect", "off_by_one"), ("has_bug", "defect", "wrong_order"), ("cwe_89", "security", "sql_injection"), ("documented", "docs", "documented"), ("split", "refactor", "too_big"), ("no_todo", "lint", "no_todo")}
    assert {(r.key, r.value) for r in Q.vocabulary(questions).collect()} == {("type", t) for t in ("defect", "security", "docs", "refactor", "lint")} | {("kind", x[2]) for x in got}


@pytest.mark.parametrize(("clauses", "want"), [
    ([("kind", "off by one")], {"has_bug", "kind", "severity"}), ([("type", "security")], {"cwe_89", "reaches_input", "severity"}), ([("kind", "sql injection"), ("type", "docs")], {"cwe_89", "reaches_input", "severity", "documented"}),
    ([("rule", "no todo")], {"no_todo"}), ([("rule", "reaches input")], {"reaches_input"}), ([("kind", "nothing")], set()), ([("severity", "p1"), ("type", "docs")], {r[0] for r in ROWS}), ([], {r[0] for r in ROWS}),
])
def test_asked(questions, clauses, want):
    assert names(Q.asked(questions, clauses)) == want


def test_per_method_and_over_a_diff(questions):
    every = {r[0] for r in ROWS} - {"no_todo"}
    assert names(Q.method_questions(questions, "python")) == every and names(Q.method_questions(questions, "go", top_level=True)) == every - {"cwe_89", "documented"}
    assert names(Q.method_questions(questions, "go", ["security", "docs"])) == {"documented"}
    over, ordinary = Q.since_questions(questions, True)
    assert names(over) == {"has_bug", "kind", "severity"} and names(ordinary) == {"cwe_89", "reaches_input", "documented", "split"}
    over, ordinary = Q.since_questions(questions, False)
    assert names(over) == set() and "severity" in names(ordinary)


def test_types(questions):
    of = lambda *a, **k: {r.type for r in Q.types_asked(questions, *a, **k).collect()}
    assert of() == {"defect", "lint"} and of([("kind", "sql injection")]) == {"defect", "lint", "security"} and of([("type", "docs")], configured=[]) == {"docs"}


def test_answers_rules_and_gates(spark, questions):
    m = lambda **k: F.create_map(*(F.lit(x) for p in k.items() for x in p))
    assert spark.range(1).select(Q.carried_answers(m(a=0.1, b=0.2, c=0.3), m(a="1", b="2"), m(a="1", b="3", c="4")).alias("x")).first().x == {"a": 0.1}
    units = spark.createDataFrame([("u", "src/a.py", "python"), ("v", "src/gen/b.py", "python"), ("w", "src/c.go", "go")], "id string, path string, language string")
    rules = [{"name": "r1", "where": "src/**", "except": "src/gen/**"}, {"name": "r2", "where": "**/*.py", "languages": ["python"]}]
    assert {(r.id, r.rule) for r in Q.rules_for_units(rules, units).collect()} == {("u", "r1"), ("u", "r2"), ("v", "r2"), ("w", "r1")} and Q.rules_for_units([], units).collect() == []
    issues = spark.createDataFrame([(1, "has_bug", "off_by_one"), (2, "documented", "documented"), (3, None, "sql_injection"), (4, None, "too_big")], "id int, question string, label string")
    assert {r.id for r in Q.gate_failures(issues, questions).collect()} == {1, 3}


def test_coverage_listing(spark):
    assert Q.coverage_clauses(" kind=Checks-nothing, redundant ") == [("kind", "checks_nothing"), ("kind", "redundant")] and Q.coverage_clauses(None) == []
    for text in ("survived", "type=x", "kind=odd"):
        with pytest.raises(ValueError):
            Q.coverage_clauses(text)
    rows = spark.createDataFrame([("a", 0.9, "survived", "p", 3), ("b", None, "redundant", "q", None), ("c", 0.3, "survived", "p", 1), ("d", 0.9, "survived", "o", 9), ("e", 0.9, "survived", "p", 1)], "id string, probability double, kind string, path string, line int")
    assert [r.id for r in Q.listed_findings(rows, 0.5).collect()] == ["b", "d", "e", "a"]
    assert [r.id for r in Q.listed_findings(rows, 0.5, [("kind", "survived")], rows.where("id <> 'd'").select("id")).collect()] == ["e", "a"]
