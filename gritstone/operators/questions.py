"""Which questions a run asks: as tables of questions, their labels, and the clauses of a filter.

A table of questions has ``name``, ``each`` (file, method or test), ``answer`` (noul, choice or score), ``options`` (of a choice), ``languages`` (null is
all), ``needs`` (the question it is multiplied by), ``issue_type`` (null where it raises none), ``issue_label`` (``self``, a choice, or a
name), ``excepted`` (the option that is no issue), ``search`` (decided over all units), ``gates`` (fails a run), ``hash``. Clauses are
``(key, value)`` with values in lower case and blanks for hyphens and underscores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.functions.globs import glob_regex
from gritstone.functions.shaping import kind_label

SCHEMA = "name string, each string, answer string, options array<string>, languages array<string>, needs string, issue_type string, issue_label string, excepted string, search boolean, gates boolean, hash string"
#: Types of issues that a severity ranks, types asked where nothing says which, questions about what a name claims, kinds that a
#: coverage report lists: fixed values.
CORRECTNESS = ("defect", "security")
DEFAULT_TYPES = ("defect", "lint")
ABOUT_A_NAME = ("does_what_it_claims", "documented")
COVERAGE_KINDS = ("survived", "redundant", "checks_nothing", "mocked", "infra")


def canon(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), "[_-]+", " ")


def narrows(clauses: Sequence[tuple[str, str]]) -> bool:
    """Whether a filter decides which questions are asked: a severity does not, as any question may raise what it lists."""
    return bool(clauses) and all(key in ("type", "kind", "rule") for key, _ in clauses)


def labels(questions: DataFrame) -> DataFrame:
    """``(name, issue_type, label)``: what each question can raise. A label that names a choice stands for its options but the
    excepted one; a search is listed as lint under its own name."""
    search = F.coalesce("search", F.lit(False))
    rows = questions.where(F.col("issue_type").isNotNull() | search).select("name", F.coalesce("issue_type", F.lit("lint")).alias("issue_type"), F.when(F.col("issue_type").isNull(), "self").otherwise(F.coalesce("issue_label", F.lit("self"))).alias("wanted"), "excepted")
    choices = questions.where("answer = 'choice'").select(F.col("name").alias("wanted"), F.coalesce("options", F.array().cast("array<string>")).alias("options"))
    own = F.array(F.when(F.col("wanted") == "self", F.col("name")).otherwise(F.col("wanted")))
    several = F.filter("options", lambda o: F.col("excepted").isNull() | (o != F.col("excepted")))
    return rows.join(choices, "wanted", "left").select("name", "issue_type", F.explode(F.when(F.col("options").isNull(), own).otherwise(several)).alias("label")).withColumn("label", kind_label(F.col("label")))


def vocabulary(questions: DataFrame) -> DataFrame:
    """``(key, value)``: the types and the labels that a set of questions can raise."""
    rows = labels(questions)
    return rows.select(F.lit("type").alias("key"), F.col("issue_type").alias("value")).union(rows.select(F.lit("kind"), "label")).distinct()


def asked(questions: DataFrame, clauses: Sequence[tuple[str, str]]) -> DataFrame:
    """The questions worth asking for a filter: those that can raise what it names, and with them the question each is multiplied
    by, the choice that names its issue, and the severity of a correctness issue. A filter that does not narrow keeps all."""
    if not narrows(clauses):
        return questions
    of = lambda key: [v for k, v in clauses if k == key]
    raised = labels(questions).where(F.col("issue_type").isin(of("type")) | canon(F.col("label")).isin(of("kind") + of("rule"))).select("name")
    wanted = raised.union(questions.where(canon(F.col("name")).isin(of("rule"))).select("name")).distinct()
    kept = questions.join(wanted, "name", "left_semi")
    severity = F.when(F.col("issue_type").isin(*CORRECTNESS), "severity")
    more = kept.select(F.explode(F.array("needs", F.when(F.col("issue_label") != "self", F.col("issue_label")), severity)).alias("name")).where("name IS NOT NULL")
    return questions.join(wanted.union(more).distinct(), "name", "left_semi")


def method_questions(questions: DataFrame, language: str, types: Sequence[str] = (), top_level: bool = False) -> DataFrame:
    """The questions about a method of a language. Code outside every function has no name for a question to be about."""
    rows = questions.where((F.col("each") == "method") & ~F.coalesce("search", F.lit(False)) & (F.col("languages").isNull() | F.array_contains("languages", language)))
    rows = rows.where(~F.col("name").isin(*ABOUT_A_NAME)) if top_level else rows
    return asked(rows, [("type", t) for t in types])


def since_questions(questions: DataFrame, changed: bool) -> tuple[DataFrame, DataFrame]:
    """``(over the diff, ordinary)``: defects are asked over the hunk that touched a method, with what they need; what else is asked
    keeps the ordinary reading. The two have no question in common."""
    bugs = asked(questions.where(~F.coalesce("search", F.lit(False))), [("type", "defect")])
    rest = questions.where(F.coalesce("issue_type", F.lit("")) != "defect")
    types = [r.t for r in rest.select(F.col("issue_type").alias("t")).where("t IS NOT NULL").distinct().collect()]
    ordinary = asked(rest, [("type", t) for t in types]) if types else rest.limit(0)
    over = bugs if changed else bugs.limit(0)
    return over, ordinary.join(over.select("name"), "name", "left_anti")


def types_asked(questions: DataFrame, clauses: Sequence[tuple[str, str]] = (), configured: Sequence[str] | None = None) -> DataFrame:
    """``(type)``: those configured, those a filter names, and those of the kinds and rules it names."""
    spark = questions.sparkSession
    plain = spark.createDataFrame([(t,) for t in (*(DEFAULT_TYPES if configured is None else configured), *(v for k, v in clauses if k == "type"))], "type string")
    naming = [c for c in clauses if c[0] in ("kind", "rule")]
    if naming:
        plain = plain.union(asked(questions, naming).where("issue_type IS NOT NULL").select("issue_type"))
    return plain.distinct()


def carried_answers(answers: Column, hashes: Column, current: Column) -> Column:
    """Of a map of earlier answers those whose question has the same hash now."""
    return F.map_filter(answers, lambda name, _: F.try_element_at(hashes, name) == F.try_element_at(current, name))


def rules_for_units(rules: Sequence[dict], units: DataFrame) -> DataFrame:
    """``(id, rule)``: rules on methods without a document that cover each unit (``id``, ``path``, ``language``), by language and globs. Rules
    are a short list from files, and become one pass over the units."""
    held = []
    for r in rules:
        excepted = [r["except"]] if isinstance(r.get("except"), str) else list(r.get("except") or ())
        covers = F.col("path").rlike(glob_regex(r["where"]))
        for g in excepted:
            covers = covers & ~F.col("path").rlike(glob_regex(g))
        if r.get("languages"):
            covers = covers & F.col("language").isin(*r["languages"])
        held.append(F.when(covers, F.lit(r["name"])))
    if not held:
        return units.select("id", F.lit("").alias("rule")).limit(0)
    return units.select("id", F.explode(F.filter(F.array(*held), lambda x: x.isNotNull())).alias("rule"))


def gate_failures(issues: DataFrame, questions: DataFrame) -> DataFrame:
    """The issues that fail a run: by their question, else, of rows that name none, by the label of a question that gates."""
    gates = questions.where("gates")
    by_name = issues.where("question IS NOT NULL").join(gates.select(F.col("name").alias("question")), "question", "left_semi")
    by_label = issues.where("question IS NULL").join(labels(gates).select("label").distinct(), "label", "left_semi")
    return by_name.unionByName(by_label)


def coverage_clauses(text: str | None) -> list[tuple[str, str]]:
    """``kind=a,b`` as clauses; another key or an unknown kind is an error that says what there is."""
    out, key = [], None
    known = ", ".join(COVERAGE_KINDS)
    for part in filter(None, (p.strip() for p in (text or "").split(","))):
        name, equals, value = part.partition("=")
        if equals:
            key = name.strip().lower()
        if key != "kind":
            raise ValueError(f"{part!r}: a coverage report is filtered by kind, one of {known}")
        value = (value if equals else name).strip()
        kind = "_".join(value.lower().replace("-", " ").split())
        if kind not in COVERAGE_KINDS:
            raise ValueError(f"{value!r} is none of {known}")
        out.append((key, kind))
    return out


def listed_findings(findings: DataFrame, floor: float, clauses: Sequence[tuple[str, str]] = (), branch: DataFrame | None = None) -> DataFrame:
    """Findings sure enough, or that could not be asked, of the kinds a filter names, and on the branch (``id``) where one is given;
    what no answer is needed for first, then the surest, ties by place."""
    kinds = [v for k, v in clauses if k == "kind"]
    rows = findings.where(F.col("probability").isNull() | (F.col("probability") >= floor))
    rows = rows.where(F.col("kind").isin(kinds)) if kinds else rows
    rows = rows if branch is None else rows.join(branch.select("id").distinct(), "id", "left_semi")
    return rows.orderBy(F.desc(F.coalesce("probability", F.lit(2.0))), "path", F.coalesce("line", F.lit(0)), "id")
