"""Queries over kill matrices, scores and changes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.operators import coverage as C
from gritstone.session import table


def _kills(spark: SparkSession, sf: str, condition: str = "true", test: str = "l_suppkey", mutant: str = "l_partkey") -> DataFrame:
    failed = (F.col("l_returnflag") == "R").cast("int")
    return table(spark, sf, "lineitem").where(condition).select(F.expr(test).alias("test"), F.expr(mutant).alias("mutant"), failed.alias("failed"))


def kill_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return C.test_outcomes(_kills(spark, sf))


def checks_nothing(spark: SparkSession, sf: str) -> DataFrame:
    return C.checks_nothing(_kills(spark, sf, "l_linenumber = 1 AND l_quantity < 8", "l_partkey", "l_suppkey"))


def redundant_tests(spark: SparkSession, sf: str) -> DataFrame:
    kills = _kills(spark, sf, "l_linenumber = 1", "l_partkey", "l_suppkey % 4")
    tests = table(spark, sf, "part").select(F.col("p_partkey").alias("test"), (F.col("p_partkey") % 25).alias("path"), F.col("p_partkey").alias("line"))
    return C.redundant_tests(kills, tests)


def checks_nothing_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Orders play the tests, so that whole tables have some that check nothing."""
    return C.checks_nothing(_kills(spark, sf, "true", "l_orderkey", "l_partkey"))


def redundant_tests_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Orders play the tests, customers the files, line numbers the mutants."""
    tests = table(spark, sf, "orders").select(F.col("o_orderkey").alias("test"), F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("line"))
    return C.redundant_tests(_kills(spark, sf, "true", "l_orderkey", "l_linenumber"), tests)


def survivors(spark: SparkSession, sf: str) -> DataFrame:
    kills = _kills(spark, sf).groupBy("test", "mutant").agg(F.max("failed").alias("failed"))
    return C.survivors(kills)


def _statuses(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("l_quantity") < 3, "equivalent").when(F.col("l_quantity") < 5, "invalid").when(F.col("l_quantity") < 8, "no_coverage").when(F.col("l_returnflag") == "R", "killed").otherwise("survived")
    return table(spark, sf, "lineitem").withColumn("status", status).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))


def mutation_score(spark: SparkSession, sf: str) -> DataFrame:
    t = C.mutation_totals(_statuses(spark, sf), "p_brand")
    return t.select("p_brand", "mutants", "killed", "no_coverage", F.round("score", 6).alias("score"), F.round("covered_score", 6).alias("covered_score"))


def score_rollup(spark: SparkSession, sf: str) -> DataFrame:
    sizes = table(spark, sf, "source_analysis").groupBy("file_id").agg(F.min("path").alias("path"), F.max("size").alias("size"))
    return C.directory_rollup(sizes, "path", "size")


def _worst(spark: SparkSession, sf: str, condition: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "skipped").otherwise("passed")
    rows = table(spark, sf, "lineitem").where(condition).select("l_orderkey", status.alias("status"))
    return C.worst_status(rows, "l_orderkey", "status").join(C.worst_status(rows, "l_orderkey", "status", C.CASE_ORDER).withColumnRenamed("worst", "case_worst"), "l_orderkey")


def worst_status(spark: SparkSession, sf: str) -> DataFrame:
    """Over the first two lines of each order, as its SQL has it; ``worst_status_whole`` takes all."""
    return _worst(spark, sf, "l_linenumber <= 2")


def worst_status_whole(spark: SparkSession, sf: str) -> DataFrame:
    return _worst(spark, sf, "true")


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    declared = table(spark, sf, "source_analysis").select("repo", "path", F.explode("declarations").alias("d"))
    key = F.concat_ws(":", "repo", "path")
    return declared.select(key.alias("file"), F.concat_ws("::", key, "d.id").alias("unit"), F.col("d.line").alias("line"), F.col("d.end_line").alias("end_line")).distinct()


def _changed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "findings").where("line IS NOT NULL AND path IS NOT NULL AND repo IS NOT NULL").select(F.concat_ws(":", "repo", "path").alias("file"), F.col("line").alias("changed_line")).distinct()


def branch_units(spark: SparkSession, sf: str) -> DataFrame:
    return C.touched_units(_spans(spark, sf), _changed(spark, sf), "unit", "file")


def innermost_owner(spark: SparkSession, sf: str) -> DataFrame:
    return C.innermost(_spans(spark, sf).withColumnRenamed("unit", "owner"), _changed(spark, sf).withColumnRenamed("changed_line", "point"), "file")


def mutant_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus").distinct()
    return rows.select("l_partkey", C.mutant_key(F.col("l_linenumber"), F.col("l_partkey"), F.lit("boundary"), F.col("l_returnflag"), F.col("l_linestatus")).alias("mutant")).distinct()


_K = "k AS (SELECT l_suppkey AS test, l_partkey AS mutant, max((l_returnflag = 'R')::INT) AS failed FROM lineitem GROUP BY 1, 2)"
_SPANS = """spans AS (SELECT DISTINCT repo || ':' || path AS file, repo || ':' || path || '::' || d.id AS unit, d.line AS line, d.end_line AS end_line FROM (SELECT repo, path, unnest(declarations) AS d FROM source_analysis)),
changed AS (SELECT DISTINCT repo || ':' || path AS file, line AS point FROM findings WHERE line IS NOT NULL AND path IS NOT NULL AND repo IS NOT NULL)"""

QUERIES = {f.__name__: f for f in (kill_matrix, checks_nothing, redundant_tests, checks_nothing_whole, redundant_tests_whole, survivors, mutation_score, score_rollup, worst_status, worst_status_whole, branch_units, innermost_owner, mutant_keys)}
SQL = {
    "kill_matrix": f"WITH {_K} SELECT test, count(*) AS mutants, sum(failed)::BIGINT AS kills FROM k GROUP BY 1",
    "checks_nothing": "WITH k AS (SELECT l_partkey AS test, l_suppkey AS mutant, max((l_returnflag = 'R')::INT) AS failed FROM lineitem WHERE l_linenumber = 1 AND l_quantity < 8 GROUP BY 1, 2) SELECT test, count(*) AS mutants, sum(failed)::BIGINT AS kills FROM k GROUP BY 1 HAVING count(*) >= 2 AND sum(failed) = 0",
    "redundant_tests": """WITH k AS (SELECT l_partkey AS test, l_suppkey % 4 AS mutant, max((l_returnflag = 'R')::INT) AS failed FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2),
      v AS (SELECT test, string_agg(mutant || ':' || failed, ',' ORDER BY mutant) AS vec FROM k GROUP BY 1 HAVING count(*) >= 3 AND sum(failed) > 0),
      f AS (SELECT test, first_value(test) OVER (PARTITION BY test % 25, vec ORDER BY test) AS redundant_with FROM v) SELECT test, redundant_with FROM f WHERE test <> redundant_with""",
    "checks_nothing_whole": "WITH k AS (SELECT l_orderkey AS test, l_partkey AS mutant, max((l_returnflag = 'R')::INT) AS failed FROM lineitem GROUP BY 1, 2) SELECT test, count(*) AS mutants, sum(failed)::BIGINT AS kills FROM k GROUP BY 1 HAVING count(*) >= 2 AND sum(failed) = 0",
    "redundant_tests_whole": """WITH k AS (SELECT l_orderkey AS test, l_linenumber AS mutant, max((l_returnflag = 'R')::INT) AS failed FROM lineitem GROUP BY 1, 2),
      v AS (SELECT test, string_agg(mutant || ':' || failed, ',' ORDER BY mutant) AS vec FROM k GROUP BY 1 HAVING count(*) >= 3 AND sum(failed) > 0),
      f AS (SELECT test, first_value(test) OVER (PARTITION BY o_custkey, vec ORDER BY test) AS redundant_with FROM v JOIN orders ON o_orderkey = test) SELECT test, redundant_with FROM f WHERE test <> redundant_with""",
    "survivors": f"WITH {_K} SELECT mutant, count(*) AS runs FROM k GROUP BY 1 HAVING sum(failed) = 0",
    "mutation_score": """WITH s AS (SELECT p_brand, CASE WHEN l_quantity < 3 THEN 'equivalent' WHEN l_quantity < 5 THEN 'invalid' WHEN l_quantity < 8 THEN 'no_coverage' WHEN l_returnflag = 'R' THEN 'killed' ELSE 'survived' END AS status FROM lineitem JOIN part ON p_partkey = l_partkey),
      t AS (SELECT p_brand, count(*) FILTER (status NOT IN ('equivalent', 'invalid')) AS mutants, count(*) FILTER (status = 'killed') AS killed, count(*) FILTER (status = 'no_coverage') AS no_coverage FROM s GROUP BY 1)
      SELECT *, round(killed / nullif(mutants, 0)::DOUBLE, 6) AS score, round(killed / nullif(mutants - no_coverage, 0)::DOUBLE, 6) AS covered_score FROM t""",
    "score_rollup": "WITH f AS (SELECT file_id, string_split(min(path), '/') AS x, max(size) AS size FROM source_analysis GROUP BY 1) SELECT directory, count(*) AS files, sum(size)::BIGINT AS size FROM (SELECT array_to_string(x[:k], '/') AS directory, size FROM (SELECT x, size, unnest(range(0, len(x))) AS k FROM f)) GROUP BY 1",
    "worst_status": """WITH s AS (SELECT l_orderkey, CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'skipped' ELSE 'passed' END AS status FROM lineitem WHERE l_linenumber <= 2)
      SELECT l_orderkey, ['skipped','passed','failed','error'][max(list_position(['skipped','passed','failed','error'], status))] AS worst, ['passed','skipped','failed','error'][max(list_position(['passed','skipped','failed','error'], status))] AS case_worst FROM s GROUP BY 1""",
    "worst_status_whole": """WITH s AS (SELECT l_orderkey, CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'skipped' ELSE 'passed' END AS status FROM lineitem)
      SELECT l_orderkey, ['skipped','passed','failed','error'][max(list_position(['skipped','passed','failed','error'], status))] AS worst, ['passed','skipped','failed','error'][max(list_position(['passed','skipped','failed','error'], status))] AS case_worst FROM s GROUP BY 1""",
    "branch_units": f"WITH {_SPANS} SELECT DISTINCT unit FROM spans s WHERE EXISTS (SELECT 1 FROM changed c WHERE c.file = s.file AND c.point BETWEEN s.line AND s.end_line)",
    "innermost_owner": f"WITH {_SPANS} SELECT c.file, c.point, arg_min(unit, (end_line - line, unit)) AS owner FROM changed c JOIN spans s ON c.file = s.file AND c.point BETWEEN s.line AND s.end_line GROUP BY 1, 2",
    "mutant_keys": "SELECT DISTINCT l_partkey, l_linenumber || ':' || l_partkey || ':boundary:' || left(sha1(l_returnflag || '>' || l_linestatus), 8) AS mutant FROM lineitem",
}
