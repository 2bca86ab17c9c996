"""Queries over answers, issues and rankings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.operators import scoring as S
from gritstone.session import table

#: Event types play the questions of a scan.
QUESTIONS = (
    S.Question("error", "defect", floor=0.6, strongest=True),
    S.Question("click", "defect", floor=0.6, strongest=True),
    S.Question("purchase", "security", when="signup", floor=0.7, strongest=True),
    S.Question("view", "docs", on_true=False, floor=0.75),
    S.Question("signup"),
)


def answers(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").where("value IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL")
    return events.groupBy("user_id", "event_type").agg(F.least(F.lit(1.0), F.max("value") / 300.0).alias("p"))


def _issues(spark: SparkSession, sf: str, floor: float = 0.5) -> DataFrame:
    return S.raise_issues(S.answer_map(answers(spark, sf), "user_id", "event_type", "p"), "user_id", QUESTIONS, floor)


def issues_raised(spark: SparkSession, sf: str) -> DataFrame:
    return _issues(spark, sf).select("user_id", "question", "type", F.round("probability", 6).alias("probability"), "floor")


def _severity(spark: SparkSession, sf: str) -> DataFrame:
    level = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).when(F.col("event_type") == "signup", 2).otherwise(3)
    counts = table(spark, sf, "events").where("user_id IS NOT NULL AND event_type IS NOT NULL").groupBy("user_id", level.cast("string").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    masses = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("m"), F.sum("n").alias("all"))
    return masses.select("user_id", S.severity(F.transform_values("m", lambda k, v: v / F.col("all"))).alias("s"))


def severity_expected(spark: SparkSession, sf: str) -> DataFrame:
    return _severity(spark, sf).select("user_id", F.round("s.expected", 6).alias("expected"), F.round("s.predicted", 6).alias("predicted"), F.col("s.band").alias("band"), F.col("s.likeliest").alias("likeliest"))


def _weights(spark: SparkSession, sf: str) -> DataFrame:
    return S.issue_weights(_issues(spark, sf, 0.0), "user_id", _severity(spark, sf).select("user_id", F.col("s.expected").alias("expected")))


def issue_weight(spark: SparkSession, sf: str) -> DataFrame:
    return _weights(spark, sf).select("user_id", *(F.round(c, 6).alias(c) for c in ("correctness", "design", "weight")))


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    surest = _issues(spark, sf).groupBy("user_id").agg(F.round(F.max("probability"), 6).alias("surest"))
    return surest.join(_weights(spark, sf).select("user_id", F.round("weight", 6).alias("weight")), "user_id")


_ORDER = (F.desc, "surest"), (F.desc, "weight"), (F.asc, "user_id")


def ranked_issues(spark: SparkSession, sf: str) -> DataFrame:
    return S.page(_ranked(spark, sf), [f(c) for f, c in _ORDER], 1)


def issues_page(spark: SparkSession, sf: str) -> DataFrame:
    return S.page(_ranked(spark, sf), [f(c) for f, c in _ORDER], 2)


CLAUSES = (("type", "defect"), ("type", "security"), ("question", "error"), ("question", "purchase"))


def filter_cnf(spark: SparkSession, sf: str) -> DataFrame:
    return S.matches(_issues(spark, sf), "user_id", CLAUSES)


def filter_strength(spark: SparkSession, sf: str) -> DataFrame:
    return S.filter_strength(_issues(spark, sf, 0.0), "user_id", CLAUSES).select("user_id", F.round("strength", 6).alias("strength"))


def floors_per_model(spark: SparkSession, sf: str) -> DataFrame:
    floor = S.own_floor({"default": 0.5, "atlas": 0.6, "atlas-small": 0.7}, F.coalesce("model", F.lit("")))
    return table(spark, sf, "findings").groupBy("model").agg(F.count(F.lit(1)).alias("findings")).withColumn("floor", floor)


def usage_cost(spark: SparkSession, sf: str) -> DataFrame:
    use = table(spark, sf, "findings").select("model", F.ceil(F.octet_length(F.coalesce("method", F.lit(""))) / 3).cast("long").alias("tokens"))
    return S.usage_cost(use, "model", "tokens", {"atlas-small": 0.042, "atlas-large": 0.1})


def pass_merge(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").where("user_id IS NOT NULL").withColumn("p", F.col("value") / 500.0)
    return S.merge_passes(events, "user_id", "event_id", "p", ["event_type"], ["value"], ["ts"]).select("user_id", "event_type", "value", F.col("ts").alias("first_ts"), "passes")


_A = "answers AS (SELECT user_id, event_type, least(1.0, max(value) / 300.0) AS p FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2)"


def _raised(floor: float) -> str:
    least = (lambda own: f"greatest({own}, {floor})") if floor else (lambda own: "0.0")
    return f"""{_A},
    q(question, type, seq, floor, strongest) AS (VALUES ('error','defect',0,{least(0.6)},true),('click','defect',1,{least(0.6)},true),('purchase','security',2,{least(0.7)},true),('view','docs',3,{least(0.75)},false)),
    scored AS (SELECT a.user_id, q.*, CASE WHEN q.question = 'view' THEN 1 - a.p WHEN q.question = 'purchase' THEN a.p * coalesce(g.p, 0) ELSE a.p END AS probability
      FROM answers a JOIN q ON q.question = a.event_type LEFT JOIN answers g ON g.user_id = a.user_id AND g.event_type = 'signup'),
    over_floor AS (SELECT * FROM scored WHERE probability > floor),
    issues AS (SELECT user_id, question, type, probability, floor::DOUBLE AS floor FROM (SELECT *, row_number() OVER (PARTITION BY user_id, type, strongest ORDER BY probability DESC, seq) AS n FROM over_floor) WHERE n = 1 OR NOT strongest)"""


_SEV = """levels AS (SELECT user_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END AS level, count(*) AS n FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2),
sev AS (SELECT user_id, sum(level * n) / sum(n)::DOUBLE AS expected, arg_max(level, n * 10 - level) AS best FROM levels GROUP BY user_id)"""
_W = """sums AS (SELECT user_id, sum(CASE WHEN type IN ('defect', 'security') THEN probability ELSE 0 END) AS correctness, sum(CASE WHEN type IN ('defect', 'security') THEN 0 ELSE probability END) AS design FROM issues0 GROUP BY user_id),
weights AS (SELECT s.user_id, correctness, design, correctness * coalesce(expected, 1) + design AS weight FROM sums s LEFT JOIN sev USING (user_id))"""


def _zero() -> str:
    return _raised(0).replace("issues AS", "issues0 AS").replace("over_floor", "over0").replace("scored", "scored0").replace("q(", "q0(").replace("q.", "q0.").replace("JOIN q ", "JOIN q0 ")


_RANK = f"WITH {_raised(0.5)}, {_zero()[len(_A) + 1 :]}, {_SEV}, {_W}, surest AS (SELECT user_id, round(max(probability), 6) AS surest FROM issues GROUP BY 1) SELECT user_id, surest, round(weight, 6) AS weight FROM surest JOIN weights USING (user_id) ORDER BY surest DESC, weight DESC, user_id LIMIT 10"
_BAND = "['P3','P2','P1','P0']"

QUERIES = {f.__name__: f for f in (issues_raised, severity_expected, issue_weight, ranked_issues, issues_page, filter_cnf, filter_strength, floors_per_model, usage_cost, pass_merge)}
SQL = {
    "issues_raised": f"WITH {_raised(0.5)} SELECT user_id, question, type, round(probability, 6) AS probability, floor FROM issues",
    "severity_expected": f"WITH {_SEV} SELECT user_id, round(expected, 6) AS expected, round(3 - expected, 6) AS predicted, {_BAND}[floor(expected + 0.5)::INT + 1] AS band, {_BAND}[best + 1] AS likeliest FROM sev",
    "issue_weight": f"WITH {_zero()}, {_SEV}, {_W} SELECT user_id, round(correctness, 6) AS correctness, round(design, 6) AS design, round(weight, 6) AS weight FROM weights",
    "ranked_issues": _RANK,
    "issues_page": _RANK + " OFFSET 10",
    "filter_cnf": f"WITH {_raised(0.5)} SELECT user_id FROM issues GROUP BY user_id HAVING bool_or(type IN ('defect', 'security')) AND bool_or(question IN ('error', 'purchase'))",
    "filter_strength": f"WITH {_zero()} SELECT user_id, round(coalesce(max(probability) FILTER (type IN ('defect', 'security')), 0) * coalesce(max(probability) FILTER (question IN ('error', 'purchase')), 0), 6) AS strength FROM issues0 GROUP BY user_id",
    "floors_per_model": "SELECT model, count(*) AS findings, (CASE WHEN starts_with(model, 'atlas-small') THEN 0.7 WHEN starts_with(model, 'atlas') THEN 0.6 ELSE 0.5 END)::DOUBLE AS floor FROM findings GROUP BY model",
    "usage_cost": "SELECT model, count(*) AS requests, sum(t)::BIGINT AS tokens, round(sum(t) * max(CASE model WHEN 'atlas-small' THEN 0.042 WHEN 'atlas-large' THEN 0.1 END) / 1e6, 9) AS cost FROM (SELECT model, ceil(strlen(coalesce(method, '')) / 3.0) AS t FROM findings) GROUP BY model",
    "pass_merge": "SELECT user_id, arg_max(event_type, (coalesce(value, -1e300), -event_id)) AS event_type, max(value) AS value, arg_min(ts, event_id) AS first_ts, count(*) AS passes FROM events WHERE user_id IS NOT NULL GROUP BY user_id",
}
