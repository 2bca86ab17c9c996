"""Queries over closures, snapshots and event order, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.operators import state as S
from gritstone.session import table

from .scoring import _issues, _raised


def _closure_events(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    events = table(spark, sf, "events").where("event_type IN ('signup', 'error') AND user_id IS NOT NULL").withColumn("k", k).where("k IS NOT NULL")
    bare = (F.col("event_type") == "error") & (F.col("k") % 5 == 0)
    return events.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("id"), F.when(F.col("event_type") == "signup", "dismissed").otherwise("reopened").alias("type"),
        F.when(bare, F.array().cast("array<int>")).otherwise(F.array(F.col("k") % 3)).alias("kinds"),
    )


def closure_state(spark: SparkSession, sf: str) -> DataFrame:
    return S.fold_closures(_closure_events(spark, sf))


def closed_issues_hidden(spark: SparkSession, sf: str) -> DataFrame:
    closed = S.fold_closures(_closure_events(spark, sf)).where("closed").select(F.col("id").alias("user_id"), "kind")
    issues = _issues(spark, sf).withColumn("kind", F.when(F.col("type") == "defect", 0).when(F.col("type") == "security", 1).otherwise(2))
    return issues.join(closed, ["user_id", "kind"], "left_anti").select("user_id", "type", "kind")


def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "findings").where("method IS NOT NULL").select("repo", "method", "finding_id", "raised_at", "received_at")
    return S.latest(rows, ["repo", "method"], [F.desc("raised_at"), F.desc("finding_id"), F.desc("received_at")]).select("repo", "method", "finding_id")


def stale_split(spark: SparkSession, sf: str) -> DataFrame:
    """Findings per repository whose file is gone or was not the one of their revision's first seven digits."""
    files = table(spark, sf, "source_analysis").groupBy("repo", "path").agg(F.max("sha").alias("sha")).select(F.concat_ws(":", "repo", "path").alias("key"), "sha")
    held = table(spark, sf, "findings").where("path IS NOT NULL AND repo IS NOT NULL").select(F.concat_ws(":", "repo", "path").alias("key"), F.sha1(F.concat("repo", F.lit("|"), "path")).alias("sha"), "repo").distinct()
    known = files.select("key", F.when(F.col("sha") < "8", F.sha1(F.regexp_replace("key", ":", "|"))).otherwise(F.col("sha")).alias("sha"))
    return S.split_stale(held, known, "key", "sha").groupBy("repo", "stale").agg(F.count(F.lit(1)).alias("methods"))


def carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "measurement").where("file_id IS NOT NULL").groupBy("file_id").agg(F.max("measured_at").alias("at"), F.max("sloc").alias("sloc"))
    cut = F.lit("2026-01-01").cast("timestamp")
    fresh, earlier = rows.where(F.col("at") >= cut), rows.where(F.col("at") < cut)
    known = table(spark, sf, "source_analysis").where("size > 1000").select("file_id")
    return S.carry_forward(fresh, earlier, ["file_id"], known).select("file_id", "sloc")


def override_merge(spark: SparkSession, sf: str) -> DataFrame:
    from gritstone.operators.selection import override_merge as merge

    rules = table(spark, sf, "tests").where("name IS NOT NULL").select("name", "test_no", "framework", F.struct("received_at", "test_no").alias("load_order")).distinct()
    return merge(rules).select("name", "test_no", "framework")


def report_diff(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    total = lambda y: orders.where(F.col("year") == y).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return S.diff_snapshots(total(1995), total(1996), "o_custkey", ["n", "total"])


def added_removed(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    keys = lambda y: orders.where(F.col("year") == y).select("o_custkey").distinct()
    return S.added_removed(keys(1995), keys(1996))


def failure_runs(spark: SparkSession, sf: str) -> DataFrame:
    return S.longest_runs(table(spark, sf, "events").where("user_id IS NOT NULL"), "user_id", ["event_id"], F.col("event_type") == "error")


def result_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "findings").where("id IS NOT NULL").select("id", "kind", "finding_id", "received_at")
    return S.latest(rows, ["id", "kind"], [F.asc("received_at"), F.asc("finding_id")]).select("id", "kind", "finding_id")


def file_completion(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("l_shipdate") <= F.lit("1998-01-01").cast("date")).alias("done"), F.max("l_shipdate").alias("completed_on"))
    return lines.where("done = expected").select("l_orderkey", "completed_on")


_CLOSURES = """ce AS (SELECT event_id AS seq, user_id AS id, event_type, (json_extract_string(props, '$.k'))::INT AS k FROM events WHERE event_type IN ('signup', 'error') AND user_id IS NOT NULL AND json_extract_string(props, '$.k') IS NOT NULL),
named AS (SELECT id, seq, event_type = 'signup' AS closed, k % 3 AS kind FROM ce WHERE NOT (event_type = 'error' AND k % 5 = 0)),
reset AS (SELECT id, max(seq) AS reset FROM ce WHERE event_type = 'error' AND k % 5 = 0 GROUP BY id),
state AS (SELECT n.id, kind, arg_max(closed, seq) AND coalesce(max(reset), -1) < max(seq) AS closed FROM named n LEFT JOIN reset r USING (id) GROUP BY n.id, kind)"""
_YEARS = "b AS (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1), a AS (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1)"

QUERIES = {f.__name__: f for f in (closure_state, closed_issues_hidden, latest_per_key, stale_split, carry_forward, override_merge, report_diff, added_removed, failure_runs, result_dedupe, file_completion)}
SQL = {
    "closure_state": f"WITH {_CLOSURES} SELECT id, kind, closed FROM state",
    "closed_issues_hidden": f"WITH {_CLOSURES}, {_raised(0.5)}, k AS (SELECT user_id, type, CASE type WHEN 'defect' THEN 0 WHEN 'security' THEN 1 ELSE 2 END AS kind FROM issues) SELECT user_id, type, kind FROM k WHERE NOT EXISTS (SELECT 1 FROM state s WHERE s.closed AND s.id = k.user_id AND s.kind = k.kind)",
    "latest_per_key": "SELECT repo, method, finding_id FROM findings WHERE method IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo, method ORDER BY raised_at DESC, finding_id DESC, received_at DESC) = 1",
    "stale_split": """WITH files AS (SELECT concat_ws(':', repo, path) AS key, max(sha) AS sha FROM source_analysis GROUP BY repo, path),
      known AS (SELECT key, CASE WHEN sha < '8' THEN sha1(replace(key, ':', '|')) ELSE sha END AS now FROM files),
      held AS (SELECT DISTINCT concat_ws(':', repo, path) AS key, sha1(repo || '|' || path) AS sha, repo FROM findings WHERE path IS NOT NULL AND repo IS NOT NULL)
      SELECT repo, (k.key IS NULL OR h.sha IS DISTINCT FROM k.now) AS stale, count(*) AS methods FROM held h LEFT JOIN known k USING (key) GROUP BY 1, 2""",
    "carry_forward": "WITH r AS (SELECT file_id, max(measured_at) AS seen, max(sloc) AS sloc FROM measurement WHERE file_id IS NOT NULL GROUP BY 1) SELECT file_id, sloc FROM r WHERE seen >= TIMESTAMP '2026-01-01' UNION ALL SELECT file_id, sloc FROM r WHERE seen < TIMESTAMP '2026-01-01' AND EXISTS (SELECT 1 FROM source_analysis s WHERE s.size > 1000 AND s.file_id = r.file_id)",
    "override_merge": "SELECT name, test_no, framework FROM tests WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY received_at DESC, test_no DESC) = 1",
    "report_diff": f"WITH {_YEARS} SELECT coalesce(b.o_custkey, a.o_custkey) AS o_custkey, b.n AS n_before, b.total AS total_before, a.n AS n_after, a.total AS total_after FROM b FULL JOIN a USING (o_custkey) WHERE b.n IS DISTINCT FROM a.n OR b.total IS DISTINCT FROM a.total",
    "added_removed": f"WITH {_YEARS} SELECT o_custkey, 'added' AS change FROM (SELECT o_custkey FROM a EXCEPT SELECT o_custkey FROM b) UNION ALL SELECT o_custkey, 'removed' FROM (SELECT o_custkey FROM b EXCEPT SELECT o_custkey FROM a)",
    "failure_runs": "WITH e AS (SELECT user_id, event_id, event_type = 'error' AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY event_id) AS g FROM events WHERE user_id IS NOT NULL) SELECT user_id, max(n) AS longest FROM (SELECT user_id, g, count(*) AS n FROM e WHERE f GROUP BY 1, 2) GROUP BY 1",
    "result_dedupe": "SELECT id, kind, finding_id FROM findings WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, kind ORDER BY received_at, finding_id) = 1",
    "file_completion": "SELECT l_orderkey, max(l_shipdate) AS completed_on FROM lineitem GROUP BY 1 HAVING count(*) = count(*) FILTER (l_shipdate <= DATE '1998-01-01')",
}
