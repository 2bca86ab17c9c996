"""Queries over lookups, with their SQL. Customers, orders and lines play methods, readings and calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.operators import lookups as L
from gritstone.session import table


def readings_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with the reading an order gives of them, where their segment is still its hash."""
    methods = table(spark, sf, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("hash"))
    readings = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg((F.count(F.lit(1)) % 25).cast("int").alias("hash"), F.max("o_orderdate").alias("at"))
    return L.with_readings(methods, readings, ["at"])


def closures_by_two_keys(spark: SparkSession, sf: str) -> DataFrame:
    findings = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("method_id"), F.col("l_returnflag").alias("rule"))
    own = findings.where("id % 5 = 0").select("id", F.lit(None).cast("string").alias("rule"), (F.col("id") % 2 == 0).alias("closed"))
    through = table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.lit("R").alias("rule"), F.lit(True).alias("closed"))
    return L.closure_of(findings, own.unionByName(through)).select("id", "rule", "closed")


def findings_by_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """What the first four, five and six digits of each finding's id name."""
    ids = table(spark, sf, "findings").select("id").where("id IS NOT NULL").distinct()
    refs = ids.select(F.explode(F.array(*(F.substring("id", 1, n) for n in (3, 4, 5, 6)))).alias("ref"))
    return L.by_prefix(refs, ids)


def overlaid_files(spark: SparkSession, sf: str) -> DataFrame:
    """Committed files, and in their place those analysed since."""
    files = table(spark, sf, "source_analysis").where("path IS NOT NULL").select(F.concat_ws(":", "repo", "path").alias("path"), "sha", "analyzed_at").distinct()
    working = files.where("analyzed_at >= TIMESTAMP '2026-01-01'").groupBy("path").agg(F.max("sha").alias("sha")).withColumn("origin", F.lit("working"))
    return L.overlay(files.groupBy("path").agg(F.min("sha").alias("sha")).withColumn("origin", F.lit("committed")), working)


def first_answers(spark: SparkSession, sf: str) -> DataFrame:
    """What a part means: its only supplier in small lots, else its only one at all."""
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), "l_quantity")
    return L.first_answer("part", "supplier", lines.where("l_quantity < 3"), lines)


def inferred_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Part to supplier by lines of returned goods, and beside them those by other lines."""
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), "l_returnflag")
    return L.with_inferred(lines.where("l_returnflag = 'R'"), lines)


def class_members(spark: SparkSession, sf: str) -> DataFrame:
    """Members of classes that extend each other: customers by nation, ten bases deep at most four up."""
    classes = table(spark, sf, "customer").select((F.col("c_custkey") % 10).alias("owner"), F.concat(F.lit("m"), (F.col("c_custkey") % 77).cast("string")).alias("name"), F.col("c_custkey").alias("id"))
    bases = table(spark, sf, "region").select(F.explode(F.array(F.struct((F.col("r_regionkey") * 2).alias("child"), (F.col("r_regionkey") * 2 + 1).alias("base")), F.struct((F.col("r_regionkey") * 2 + 1).alias("child"), (F.col("r_regionkey") * 2 + 2).alias("base")))).alias("x")).select("x.child", "x.base")
    return L.members(classes, bases)


QUERIES = {f.__name__: f for f in (readings_kept, closures_by_two_keys, findings_by_prefix, overlaid_files, first_answers, inferred_edges, class_members)}
SQL = {
    "readings_kept": """WITH m AS (SELECT c_custkey AS id, c_nationkey AS hash FROM customer WHERE c_custkey % 7 <> 0), r AS (SELECT o_custkey AS id, count(*) % 25 AS hash, max(o_orderdate) AS seen FROM orders GROUP BY 1)
      SELECT coalesce(m.id, r.id) AS id, CASE WHEN m.id IS NULL OR m.hash = r.hash THEN seen END AS at, CASE WHEN m.id IS NULL THEN 'gone' WHEN m.hash = r.hash THEN 'read' ELSE 'unread' END AS state FROM m FULL JOIN r ON m.id = r.id""",
    "closures_by_two_keys": """WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS m, l_returnflag AS rule FROM lineitem)
      SELECT id, rule, CASE WHEN id % 5 = 0 THEN id % 2 = 0 WHEN rule = 'R' AND m % 3 = 0 AND m IN (SELECT o_orderkey FROM orders) THEN true ELSE false END AS closed FROM f""",
    "findings_by_prefix": """WITH i AS (SELECT DISTINCT id FROM findings WHERE id IS NOT NULL), r AS (SELECT DISTINCT left(id, n) AS ref FROM i, (VALUES (3), (4), (5), (6)) v(n)),
      c AS (SELECT left(id, n) AS ref, min(id) AS id, count(*) AS matches FROM i, (VALUES (4), (5), (6)) v(n) GROUP BY 1) SELECT ref, CASE WHEN matches = 1 THEN c.id END AS id, coalesce(matches, 0) AS matches FROM r LEFT JOIN c USING (ref)""",
    "overlaid_files": """WITH f AS (SELECT DISTINCT concat_ws(':', repo, path) AS path, sha, analyzed_at FROM source_analysis WHERE path IS NOT NULL), w AS (SELECT path, max(sha) AS sha, 'working' AS origin FROM f WHERE analyzed_at >= TIMESTAMP '2026-01-01' GROUP BY 1)
      SELECT * FROM w UNION ALL SELECT path, min(sha), 'committed' FROM f WHERE path NOT IN (SELECT path FROM w) GROUP BY 1""",
    "first_answers": """WITH a AS (SELECT l_partkey AS part, min(l_suppkey) AS lo, max(l_suppkey) AS hi FROM lineitem WHERE l_quantity < 3 GROUP BY 1), b AS (SELECT l_partkey AS part, min(l_suppkey) AS lo, max(l_suppkey) AS hi FROM lineitem GROUP BY 1)
      SELECT part, lo AS supplier, 0 AS step FROM a WHERE lo = hi UNION ALL SELECT part, lo, 1 FROM b WHERE lo = hi AND part NOT IN (SELECT part FROM a)""",
    "inferred_edges": "SELECT l_partkey AS source, l_suppkey AS target, NOT bool_or(l_returnflag = 'R') AS dynamic FROM lineitem GROUP BY 1, 2 HAVING l_partkey <> l_suppkey OR bool_or(l_returnflag = 'R')",
    "class_members": """WITH c AS (SELECT c_custkey % 10 AS owner, 'm' || (c_custkey % 77) AS name, min(c_custkey) AS id FROM customer GROUP BY 1, 2),
      o AS (SELECT DISTINCT owner FROM c UNION SELECT r_regionkey * 2 FROM region UNION SELECT r_regionkey * 2 + 1 FROM region)
      SELECT o.owner, c.name, arg_min(c.id, c.owner) AS id FROM o JOIN c ON c.owner BETWEEN o.owner AND o.owner + 4 GROUP BY 1, 2""",
}
