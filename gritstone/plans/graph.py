"""Queries over call graphs, with their SQL. Parts ordered one after another play calls, nations and regions a hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gritstone.operators import balls as B
from gritstone.operators import graph as G
from gritstone.session import table


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    after = line.select(F.col("l_orderkey"), (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("callee"))
    return line.withColumnRenamed("l_partkey", "caller").join(after, ["l_orderkey", "l_linenumber"])


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.edges_of(_calls(spark, sf), "caller", "callee", F.col("l_orderkey"))


def call_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf)


def degree(spark: SparkSession, sf: str) -> DataFrame:
    return G.degrees(_edges(spark, sf))


def top_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    scores = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("score"))
    return G.top_neighbours(_edges(spark, sf), scores)


def _starts(spark: SparkSession, sf: str, condition: str = "p_partkey <= 5") -> DataFrame:
    return table(spark, sf, "part").where(condition).select(F.col("p_partkey").alias("start"))


def _cut(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where("p_size % 4 = 1").select(F.col("p_partkey").alias("node"))


def _dispatched(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    written = G.reach(edges.where("site % 2 = 1"), starts, depth).select("start", "node")
    return G.reach(edges, starts, depth).select("start", "node").join(written, ["start", "node"], "left_anti")


def reach_depth3(spark: SparkSession, sf: str) -> DataFrame:
    """From five parts, as its SQL has it; ``reach_depth3_whole`` starts from all, and so do the other two named so."""
    return G.reach(_edges(spark, sf), _starts(spark, sf), 3)


def reach_with_cuts(spark: SparkSession, sf: str) -> DataFrame:
    return G.reach(_edges(spark, sf), _starts(spark, sf), 3, _cut(spark, sf))


def dispatch_only(spark: SparkSession, sf: str) -> DataFrame:
    return _dispatched(_edges(spark, sf), _starts(spark, sf), 2)


def reach_depth3_whole(spark: SparkSession, sf: str) -> DataFrame:
    return B.reach_from_many(_whole_edges(spark, sf), _starts(spark, sf, "true"), 3)


def reach_with_cuts_whole(spark: SparkSession, sf: str) -> DataFrame:
    return B.reach_from_many(_whole_edges(spark, sf), _starts(spark, sf, "true"), 3, _cut(spark, sf))


def dispatch_only_whole(spark: SparkSession, sf: str) -> DataFrame:
    return B.reach_from_many(_whole_edges(spark, sf), _starts(spark, sf, "true"), 3, unless=F.col("site") % 2 == 1).select("start", "node")


def _whole_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The edges without their calls, from one shuffle of the lines and one of the calls."""
    line = table(spark, sf, "lineitem").where("l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("caller"))
    after = F.collect_set("caller").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber").rangeBetween(1, 1))
    calls = line.withColumn("callee", after).select("caller", F.explode("callee").alias("callee"), "l_orderkey")
    return G.edges_of(calls.repartition("caller"), "caller", "callee", F.col("l_orderkey")).select("source", "target", "site")


def external_calls(spark: SparkSession, sf: str) -> DataFrame:
    return G.external_calls(_edges(spark, sf), table(spark, sf, "part").where("p_size <= 25").select(F.col("p_partkey").alias("node"))).select("source", "target")


def region_closure(spark: SparkSession, sf: str) -> DataFrame:
    up = lambda a, b: F.concat(F.lit(a), F.col(b))
    edges = (
        table(spark, sf, "supplier").select(up("s", "s_suppkey").alias("source"), up("n", "s_nationkey").alias("target"))
        .unionByName(table(spark, sf, "nation").select(up("n", "n_nationkey").alias("source"), up("r", "n_regionkey").alias("target")))
        .unionByName(table(spark, sf, "region").select(up("r", "r_regionkey").alias("source"), F.lit("world").alias("target")))
    )
    return G.reach(edges, table(spark, sf, "supplier").select(up("s", "s_suppkey").alias("start")))


def nearest_context(spark: SparkSession, sf: str) -> DataFrame:
    paths = table(spark, sf, "source_analysis").where("path IS NOT NULL").select("path").distinct()
    parts = F.split("path", "/")
    # a document stands in every directory that holds more than ten files
    held = paths.where(F.size(parts) > 1).groupBy(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("d")).agg(F.count(F.lit(1)).alias("n")).where("n > 10")
    return G.nearest_context(paths, held.select(F.concat("d", F.lit("/CONTEXT.md")).alias("path")), "CONTEXT.md")


_E = """line AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem),
edges AS (SELECT a.l_partkey AS source, b.l_partkey AS target, min(a.l_orderkey) AS site, count(*) AS calls FROM line a JOIN line b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey GROUP BY 1, 2)"""


def _reach(depth: int, edges: str = "edges", name: str = "reach", extra: str = "", first: str = "") -> str:
    return f"""{name}0 AS (SELECT p_partkey AS start, p_partkey AS node, 0 AS depth FROM part WHERE p_partkey <= 5 {first}),
    """ + ",\n".join(
        f"{name}{d} AS (SELECT start, node, min(depth) AS depth FROM (SELECT * FROM {name}{d - 1} UNION ALL SELECT r.start, e.target, {d} FROM {name}{d - 1} r JOIN {edges} e ON e.source = r.node {extra}) GROUP BY 1, 2)" for d in range(1, depth + 1)
    ) + f", {name} AS (SELECT start, node, depth FROM {name}{depth} WHERE depth > 0)"


QUERIES = {f.__name__: f for f in (call_edges, degree, top_neighbours, reach_depth3, reach_with_cuts, dispatch_only, reach_depth3_whole, reach_with_cuts_whole, dispatch_only_whole, external_calls, region_closure, nearest_context)}
SQL = {
    "call_edges": f"WITH {_E} SELECT source, target, site, calls FROM edges",
    "degree": f"WITH {_E} SELECT node, sum(o)::BIGINT AS callees, sum(i)::BIGINT AS callers FROM (SELECT source AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT target, 0, 1 FROM edges) GROUP BY 1",
    "top_neighbours": f"WITH {_E} SELECT source, target, p_retailprice AS score, row_number() OVER (PARTITION BY source ORDER BY p_retailprice DESC, target)::INT AS rank_no FROM edges JOIN part ON p_partkey = target QUALIFY rank_no <= 8",
    "reach_depth3": f"WITH {_E}, {_reach(3)} SELECT start, node, depth FROM reach",
    "reach_with_cuts": f"WITH {_E}, cut AS (SELECT p_partkey AS node FROM part WHERE p_size % 4 = 1), kept AS (SELECT * FROM edges WHERE source NOT IN (SELECT node FROM cut) AND target NOT IN (SELECT node FROM cut)), {_reach(3, 'kept', first='AND p_size % 4 <> 1')} SELECT start, node, depth FROM reach",
    "dispatch_only": f"WITH {_E}, written AS (SELECT * FROM edges WHERE site % 2 = 1), {_reach(2)}, {_reach(2, 'written', 'plain')} SELECT start, node FROM reach WHERE NOT EXISTS (SELECT 1 FROM plain p WHERE p.start = reach.start AND p.node = reach.node)",
    "external_calls": f"WITH {_E} SELECT source, target FROM edges WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_size <= 25 AND p_partkey = target)",
    "region_closure": "SELECT 's' || s_suppkey AS start, node, depth FROM (SELECT s_suppkey, unnest(['n' || s_nationkey, 'r' || n_regionkey, 'world']) AS node, unnest([1, 2, 3]) AS depth FROM supplier JOIN nation ON n_nationkey = s_nationkey)",
    "nearest_context": """WITH p AS (SELECT DISTINCT path, string_split(path, '/') AS x FROM source_analysis WHERE path IS NOT NULL),
      d AS (SELECT array_to_string(x[:-2], '/') AS d FROM p WHERE len(x) > 1 GROUP BY 1 HAVING count(*) > 10),
      c AS (SELECT path, array_to_string(x[:k], '/') AS a, k FROM (SELECT path, x, unnest(range(1, len(x))) AS k FROM p))
      SELECT path, arg_max(a || '/CONTEXT.md', k) AS context FROM c JOIN d ON d.d = c.a GROUP BY path""",
}
