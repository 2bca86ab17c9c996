"""Queries over tables of questions and rules, with their SQL. Event types and regions play questions and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.operators import questions as Q
from gritstone.session import table

from .scoring import _issues, _raised


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as questions: each raises its region's type, under its own name or under one of a choice's options."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    name = F.lower(F.col("n_name"))
    raising = n.join(r, n.n_regionkey == r.r_regionkey).select(
        name.alias("name"), F.when(F.col("n_nationkey") % 5 == 0, "file").otherwise("method").alias("each"), F.lit("noul").alias("answer"), F.lit(None).cast("array<string>").alias("options"),
        F.when(F.col("n_nationkey") % 4 == 0, F.array(F.lit("python"), F.lit("go"))).alias("languages"), F.when(F.col("n_nationkey") % 6 == 0, "severity").alias("needs"),
        F.when(F.col("n_nationkey") % 7 != 0, F.when(F.col("r_regionkey") == 0, "defect").otherwise(F.lower("r_name"))).alias("issue_type"), F.when(F.col("n_nationkey") % 3 == 0, F.lower("r_name")).otherwise("self").alias("issue_label"),
        F.when(F.col("n_nationkey") % 2 == 0, "second").alias("excepted"), (F.col("n_nationkey") == 7).alias("search"), (F.col("n_nationkey") % 2 == 0).alias("gates"), F.lit("h").alias("hash"),
    )
    choices = r.where("r_regionkey < 3").select(F.lower("r_name").alias("name"), F.lit("method").alias("each"), F.lit("choice").alias("answer"), F.array(F.lit("first"), F.lit("second"), F.concat(F.lit("third_"), F.lower("r_name"))).alias("options"))
    severity = spark.range(1).select(F.lit("severity").alias("name"), F.lit("method").alias("each"), F.lit("score").alias("answer"))
    return raising.unionByName(choices, allowMissingColumns=True).unionByName(severity, allowMissingColumns=True)


def question_labels(spark: SparkSession, sf: str) -> DataFrame:
    """What each question can raise."""
    return Q.labels(_questions(spark, sf))


def question_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return Q.vocabulary(_questions(spark, sf))


def questions_asked(spark: SparkSession, sf: str) -> DataFrame:
    """The questions that a filter of a type and a kind needs."""
    return Q.asked(_questions(spark, sf), [("type", "defect"), ("kind", "third america")]).select("name")


def questions_per_language(spark: SparkSession, sf: str) -> DataFrame:
    rows = [Q.method_questions(_questions(spark, sf), language).select(F.lit(language).alias("language"), "name") for language in ("python", "ruby")]
    return rows[0].union(rows[1])


def rules_for_files(spark: SparkSession, sf: str) -> DataFrame:
    """The rules that cover each file."""
    units = table(spark, sf, "source_analysis").select(F.col("file_id").alias("id"), "path", "language").where("path IS NOT NULL").distinct()
    rules = [{"name": "scripts", "where": "**/*.{js,ts}", "except": "src/**"}, {"name": "sources", "where": "src/**"}, {"name": "python", "where": "**/*.py", "languages": ["python"]}]
    return Q.rules_for_units(rules, units).distinct()


def gated_run(spark: SparkSession, sf: str) -> DataFrame:
    """Issues that fail a run, by the questions that gate."""
    gates = spark.createDataFrame([("error", "defect", True), ("view", "docs", False), ("purchase", "security", True)], "name string, issue_type string, gates boolean")
    for column, kind in (("issue_label", "string"), ("answer", "string"), ("excepted", "string"), ("search", "boolean"), ("options", "array<string>")):
        gates = gates.withColumn(column, F.lit(None).cast(kind))
    issues = _issues(spark, sf).select("user_id", F.when(F.col("user_id") % 2 == 0, F.col("question")).alias("question"), F.col("question").alias("label"))
    return Q.gate_failures(issues, gates).select("user_id", "label")


QUERIES = {f.__name__: f for f in (question_labels, question_vocabulary, questions_asked, questions_per_language, rules_for_files, gated_run)}
_Q = """q AS (SELECT lower(n_name) AS name, CASE WHEN n_nationkey % 5 = 0 THEN 'file' ELSE 'method' END AS each, 'noul' AS answer, NULL::VARCHAR[] AS options, CASE WHEN n_nationkey % 4 = 0 THEN ['python', 'go'] END AS languages, CASE WHEN n_nationkey % 6 = 0 THEN 'severity' END AS needs,
    CASE WHEN n_nationkey % 7 <> 0 THEN CASE WHEN r_regionkey = 0 THEN 'defect' ELSE lower(r_name) END END AS issue_type, CASE WHEN n_nationkey % 3 = 0 THEN lower(r_name) ELSE 'self' END AS issue_label, CASE WHEN n_nationkey % 2 = 0 THEN 'second' END AS excepted, n_nationkey = 7 AS search
    FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT lower(r_name), 'method', 'choice', ['first', 'second', 'third_' || lower(r_name)], NULL, NULL, NULL, NULL, NULL, NULL FROM region WHERE r_regionkey < 3 UNION ALL SELECT 'severity', 'method', 'score', NULL, NULL, NULL, NULL, NULL, NULL, NULL),
l AS (SELECT q.name, coalesce(q.issue_type, 'lint') AS issue_type, unnest(CASE WHEN q.issue_type IS NULL OR q.issue_label = 'self' THEN [q.name] WHEN c.name IS NULL THEN [q.issue_label] ELSE list_filter(c.options, lambda o: q.excepted IS NULL OR o <> q.excepted) END) AS label
  FROM q LEFT JOIN q c ON c.answer = 'choice' AND c.name = q.issue_label WHERE q.issue_type IS NOT NULL OR q.search)"""
SQL = {
    "question_labels": f"WITH {_Q} SELECT name, issue_type, label FROM l",
    "question_vocabulary": f"WITH {_Q} SELECT 'type' AS key, issue_type AS value FROM l UNION SELECT 'kind', label FROM l",
    "questions_asked": f"""WITH {_Q}, w AS (SELECT DISTINCT name FROM l WHERE issue_type = 'defect' OR label = 'third_america'), k AS (SELECT q.* FROM q JOIN w USING (name))
      SELECT name FROM q WHERE name IN (SELECT name FROM w UNION SELECT needs FROM k WHERE needs IS NOT NULL UNION SELECT issue_label FROM k WHERE issue_label <> 'self' UNION SELECT 'severity' FROM k WHERE issue_type IN ('defect', 'security'))""",
    "questions_per_language": f"WITH {_Q}, v(language) AS (VALUES ('python'), ('ruby')) SELECT language, name FROM q, v WHERE each = 'method' AND NOT coalesce(search, false) AND (languages IS NULL OR list_contains(languages, language))",
    "rules_for_files": r"""WITH u AS (SELECT DISTINCT file_id AS id, path, language FROM source_analysis WHERE path IS NOT NULL)
      SELECT DISTINCT id, 'scripts' AS rule FROM u WHERE regexp_matches(path, '\.(js|ts)$') AND NOT starts_with(path, 'src/') UNION SELECT id, 'sources' FROM u WHERE starts_with(path, 'src/') UNION SELECT id, 'python' FROM u WHERE path LIKE '%.py' AND language = 'python'""",
    "gated_run": f"WITH {_raised(0.5)} SELECT user_id, question AS label FROM issues WHERE user_id % 2 = 0 AND question IN ('error', 'purchase') UNION ALL SELECT user_id, question FROM issues WHERE user_id % 2 = 1 AND question IN ('error', 'purchase')",
}
