"""Queries that write state and read it back, with the SQL of what must come out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.operators import state
from gritstone.session import checkpoint_dir, table
from gritstone.sources import store as S

from .scoring import _SEV, _issues, _raised, _severity


def _folder(spark: SparkSession) -> str:
    """A fresh folder in the session's shared one."""
    return f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"


def snapshot_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Findings written as a snapshot, overwritten by those with a method, and read again."""
    at = _folder(spark)
    rows = table(spark, sf, "findings").select("finding_id", "id", "repo", "method", "line", "raised_at")
    S.write_snapshot(rows.limit(10), f"{at}/scan")
    S.write_snapshot(rows.where("method IS NOT NULL"), f"{at}/scan", {"revision": "abc"}, 100_000)
    header, held = S.read_snapshot(spark, f"{at}/scan")
    return held.select("finding_id", "id", "line", F.lit(header["revision"]).alias("revision"), "raised_at").distinct()


def closure_log(spark: SparkSession, sf: str) -> DataFrame:
    """Findings closed in one append to the log, some reopened in a second, and the fold of what the log then holds."""
    at = f"{_folder(spark)}/closures"
    rows = table(spark, sf, "findings").where("id IS NOT NULL AND kind IS NOT NULL").groupBy("id", "kind").agg(F.min("finding_id").alias("n"))
    S.append_events(S.closure_events(rows, "dismissed", F.col("n") * 2, F.array("kind")), at)
    S.append_events(S.closure_events(rows.where("n % 3 = 0"), "reopened", F.col("n") * 2 + 1, F.array("kind")), at)
    return state.fold_closures(S.read_or(spark, at, S.CLOSURES)).groupBy("closed").agg(F.count(F.lit(1)).alias("kinds"))


def journal_published(spark: SparkSession, sf: str) -> DataFrame:
    """Three batches of a run, one of them written twice, and one that was never published."""
    at = f"{_folder(spark)}/journal"
    rows = table(spark, sf, "source_analysis").where("file_id IS NOT NULL").select("file_id", "parser_status").distinct()
    for batch in (0, 1, 1, 2):
        S.journal(rows.where(F.pmod("file_id", F.lit(4)) == batch), at, "r1", batch)
    rows.where("pmod(file_id, 4) = 3").write.json(f"{at}/run=r1/batch=3")
    S.journal(rows.limit(5), at, "r2", 0)
    return S.read_journal(spark, at, "r1", "file_id long, parser_status string").select("file_id", "parser_status", "batch")


def _reports(spark: SparkSession, sf: str) -> str:
    at = f"{_folder(spark)}/reports"
    orders = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    for year in (1994, 1995, 1996):
        lists = {"customers": orders.where(F.col("year") == year).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), "totals": orders.where(F.col("year") == year).agg(F.count(F.lit(1)).alias("n"))}
        S.write_report(lists, at, f"{year}-12-31 00:00:00", f"{year}revision")
    return at


def latest_report(spark: SparkSession, sf: str) -> DataFrame:
    """The customers of the newest of three reports."""
    at = _reports(spark, sf)
    return S.report_section(spark, at, S.newest_report(spark, at), "customers", "o_custkey long, n long")


def report_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """What changed since the newest report of another revision."""
    at = _reports(spark, sf)
    section = lambda key: S.report_section(spark, at, key, "customers", "o_custkey long, n long")
    now = S.newest_report(spark, at)
    return state.diff_snapshots(section(S.baseline(spark, at, now[1])), section(now), "o_custkey", ["n"])


def issue_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Issues as another service takes them."""
    return S.issue_rows(_issues(spark, sf), "user_id", _severity(spark, sf).select("user_id", F.col("s.band").alias("severity")))


def rule_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Rules edited, removed and added, as a table."""
    rules = table(spark, sf, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("floor"), F.lit("shipped").alias("file"), F.lit(None).cast("string").alias("gate"))
    rules = S.insert_rules(rules, table(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("floor"), F.lit("own").alias("file"), F.lit("yes").alias("gate")))
    changes = table(spark, sf, "nation").where("n_regionkey = 1 OR n_name = 'CHINA'").select(F.col("n_name").alias("name"), (F.col("n_nationkey") * 10).alias("floor"))
    rules = S.edit_rules(rules, changes, cleared=["gate"])
    gone = rules.where("name LIKE '%A' OR name = 'ASIA'").select("name")
    return S.remove_rules(rules, gone, F.col("file") == "shipped").select("name", "floor", "file", "gate", "disabled")


QUERIES = {f.__name__: f for f in (snapshot_roundtrip, closure_log, journal_published, latest_report, report_baseline, issue_rows, rule_edits)}
_N = "SELECT o_custkey, count(*) AS n FROM orders WHERE year(o_orderdate) = {} GROUP BY 1"
SQL = {
    "snapshot_roundtrip": "SELECT DISTINCT finding_id, id, line, 'abc' AS revision, raised_at FROM findings WHERE method IS NOT NULL",
    "closure_log": "SELECT n % 3 <> 0 AS closed, count(*) AS kinds FROM (SELECT id, kind, min(finding_id) AS n FROM findings WHERE id IS NOT NULL AND kind IS NOT NULL GROUP BY 1, 2) GROUP BY 1",
    "journal_published": "SELECT DISTINCT file_id, parser_status, (file_id % 4)::INT AS batch FROM source_analysis WHERE file_id % 4 < 3",
    "latest_report": _N.format(1996),
    "report_baseline": f"SELECT coalesce(b.o_custkey, a.o_custkey) AS o_custkey, b.n AS n_before, a.n AS n_after FROM ({_N.format(1995)}) b FULL JOIN ({_N.format(1996)}) a ON a.o_custkey = b.o_custkey WHERE a.n IS DISTINCT FROM b.n",
    "issue_rows": f"""WITH {_raised(0.5)}, {_SEV} SELECT substring(sha256(to_json([user_id::VARCHAR, question])), 1, 16) AS id, user_id, question, type, round(max(probability), 3) AS probability,
      CASE WHEN type IN ('defect', 'security') THEN max(['P3','P2','P1','P0'][floor(expected + 0.5)::INT + 1]) END AS severity FROM issues LEFT JOIN sev USING (user_id) GROUP BY user_id, question, type""",
    "rule_edits": """WITH r AS (SELECT r_name AS name, r_regionkey AS floor, 'shipped' AS file, NULL AS gate FROM region UNION ALL SELECT n_name, n_nationkey * 10, 'own', NULL FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_name, n_nationkey * 10, NULL, NULL FROM nation WHERE n_name = 'CHINA')
      SELECT name, floor, file, gate, (name LIKE '%A' OR name = 'ASIA') AS disabled FROM r WHERE NOT (name LIKE '%A' OR name = 'ASIA') OR file = 'shipped'""",
}
