"""Queries over texts, paths and selections, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.functions import text as X
from gritstone.operators import packing, selection
from gritstone.session import table


def finding_ids(spark: SparkSession, sf: str) -> DataFrame:
    paths = table(spark, sf, "source_analysis").where("path IS NOT NULL").select("path").distinct()
    return paths.select("path", X.finding_id(F.col("path")).alias("id"))


def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


def generated_files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_analysis").select("file_id", "path", X.generated_reason(F.col("path"), F.col("source")).alias("reason")).where("reason IS NOT NULL").distinct()


def code_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_analysis").select("file_id", X.code_lines(F.col("source")).alias("code_lines")).distinct()


def comment_blocks(spark: SparkSession, sf: str) -> DataFrame:
    # the lines of a file's deliveries are the same, and only those of comments are shuffled
    files = table(spark, sf, "source_analysis").where("source IS NOT NULL")
    lines = files.select(F.col("file_id").alias("id"), F.posexplode(X.lines_of(F.col("source"))).alias("line_no", "line"))
    return selection.comment_blocks(lines).select(F.col("id").alias("file_id"), (F.col("first_line") + 1).alias("first_line"), (F.col("last_line") + 1).alias("last_line"))


def mentions_select(spark: SparkSession, sf: str) -> DataFrame:
    units = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("path"), "text")
    return selection.select_units(units, ["mentions mutant", "mentions lease agreement"], ["mentions survives"]).select(F.col("id").alias("doc_id"))


def lexical_rank(spark: SparkSession, sf: str) -> DataFrame:
    rule = "Every lease agreement must keep its link to the court filing it came from, and no mutant may survive in the method that handles it"
    ranked = selection.lexical_rank(table(spark, sf, "documents").where("text IS NOT NULL"), rule, "doc_id", "text")
    return ranked.orderBy(F.desc("score"), "doc_id").limit(20)


GLOBS = ("src/**/*.{js,ts}", "web/*_store_*", "lib/**", "internal/**/loan_*")


def glob_select(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_analysis").where(selection.matches_any(F.col("path"), GLOBS)).select("repo", "path").distinct()


def exclusions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_analysis").where(~X.eligible_path(F.col("path"))).select("repo", "path").distinct()


def language_map(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_analysis").groupBy(X.language_of_path(F.col("path")).alias("language")).agg(F.countDistinct("file_id").alias("files"))


def quantifiers(spark: SparkSession, sf: str) -> DataFrame:
    scores = table(spark, sf, "tests").where("framework IS NOT NULL AND useful IS NOT NULL")
    parts = [selection.quantify(scores, "framework", F.col("useful"), q).withColumn("quantifier", F.lit(q)) for q in ("ensure", "ensure_present", "ensure_absent")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def set_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "source_analysis").where("path IS NOT NULL AND sha IS NOT NULL").select("repo", "path", "sha").distinct()
    return files.groupBy("repo").agg(X.set_fingerprint(F.col("path"), F.col("sha")).alias("fingerprint"))


def halstead(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("w"))
    is_operator = F.length("w") <= 3
    n = words.groupBy("doc_id").agg(
        F.countDistinct(F.when(is_operator, F.col("w"))).alias("n1"), F.countDistinct(F.when(~is_operator, F.col("w"))).alias("n2"), F.count_if(is_operator).alias("t1"), F.count_if(~is_operator).alias("t2")
    )
    m = X.halstead(F.col("n1"), F.col("n2"), F.col("t1"), F.col("t2"))
    return n.select("doc_id", *(F.round(m[c].cast("double"), 4).alias(c) for c in ("volume", "difficulty", "effort", "time", "bugs")))


def risk_score(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "measurement").where("file_id IS NOT NULL AND sloc IS NOT NULL AND cyclomatic_complexity IS NOT NULL AND max_nesting IS NOT NULL")
    index = X.maintainability(F.col("sloc") * 8.0, F.col("sloc"), F.col("cyclomatic_complexity"))
    return rows.select("file_id", "measured_at", F.round(index, 6).alias("maintainability"), X.risk_score(index, X.control_score(F.col("cyclomatic_complexity"), F.col("max_nesting"))).alias("risk"))


def question_batches(spark: SparkSession, sf: str) -> DataFrame:
    questions = table(spark, sf, "findings").where("repo IS NOT NULL AND finding_id IS NOT NULL").groupBy("repo", "type").agg(F.count(F.lit(1)).alias("tokens")).withColumn("state", F.lit(500))
    return packing.question_batches(questions, "repo", "type", "tokens", "state", 6000, 8)


def chunk_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return packing.chunks(table(spark, sf, "documents"), "doc_id", "text", 128).select("doc_id", "chunk", "first", "last")


_DIRS = "[" + ",".join(f"'{d}'" for d in X.EXCLUDED_DIRECTORIES) + "]"
_PAIRS = "[" + ",".join(f"'{d}'" for d in X.EXCLUDED_PAIRS) + "]"
_LINES = "string_split(regexp_replace(source, '\\r\\n?', chr(10), 'g'), chr(10))"
_MARKS = "|".join(f"({m})" for m in X.GENERATED_MARKS)
_EXT = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.EXTENSIONS.items())

QUERIES = {
    f.__name__: f
    for f in (finding_ids, token_estimate, generated_files, code_lines, comment_blocks, mentions_select, lexical_rank, glob_select, exclusions, language_map, quantifiers, set_fingerprint, halstead, risk_score, question_batches, chunk_overlap)
}
SQL = {
    "finding_ids": "SELECT DISTINCT path, left(sha256('[\"finding\",\"' || path || '\"]'), 8) AS id FROM source_analysis WHERE path IS NOT NULL",
    "token_estimate": "SELECT doc_id, ceil(strlen(text) / 3.0)::BIGINT AS tokens FROM documents",
    "generated_files": f"""WITH l AS (SELECT file_id, path, string_split(source, chr(10)) AS x FROM source_analysis),
      r AS (SELECT file_id, path, CASE WHEN regexp_matches(path, '(?i)\\.([cm]?js|css)$') AND list_sum(list_transform(x, lambda v: length(v))) / len(x) > 110 THEN 'minified'
        WHEN regexp_matches(path, '(?i)\\.([cm]?js|css)$') AND len(list_filter(x[greatest(len(x) - 1, 1):], lambda v: regexp_matches(v, '^/[*/][#@] source(Mapping)?URL|sourceURL='))) > 0 THEN 'source map'
        WHEN len(list_filter(x[1:40], lambda v: regexp_matches(v, '{_MARKS}'))) > 0 THEN 'generated' END AS reason FROM l)
      SELECT DISTINCT file_id, path, reason FROM r WHERE reason IS NOT NULL""",
    "code_lines": f"SELECT DISTINCT file_id, len(list_filter({_LINES}, lambda x: NOT regexp_matches(x, '^\\s*$') AND NOT regexp_matches(x, '^\\s*(//|#|--|/\\*|\\*)') AND NOT regexp_matches(x, '^\\s*(import|from|include|use|require|using|package)\\b')))::BIGINT AS code_lines FROM source_analysis",
    "comment_blocks": f"""WITH f AS (SELECT file_id, min(source) AS source FROM source_analysis WHERE source IS NOT NULL GROUP BY 1),
      l AS (SELECT file_id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS n FROM f),
      c AS (SELECT file_id, n, n - row_number() OVER (PARTITION BY file_id ORDER BY n) AS g FROM l WHERE regexp_matches(line, '^\\s*(//|#|--|/\\*|\\*)'))
      SELECT file_id, min(n)::INT AS first_line, max(n)::INT AS last_line FROM c GROUP BY file_id, g""",
    "mentions_select": "SELECT doc_id FROM documents WHERE (contains(text, 'mutant') OR contains(text, 'lease agreement')) AND NOT contains(text, 'survives')",
    "lexical_rank": """WITH r AS (SELECT list_distinct(regexp_extract_all('every lease agreement must keep its link to the court filing it came from, and no mutant may survive in the method that handles it', '[a-z]{4,}')) AS w)
      SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-z]{4,}'), lambda x: list_contains(w, x)))::BIGINT AS score FROM documents, r WHERE text IS NOT NULL ORDER BY score DESC, doc_id LIMIT 20""",
    # written out, apart from the engine's own reading of globs
    "glob_select": r"SELECT DISTINCT repo, path FROM source_analysis WHERE regexp_matches(path, '^src/(.*/)?[^/]*\.(js|ts)$') OR regexp_matches(path, '^web/[^/]*_store_[^/]*$') OR starts_with(path, 'lib/') OR regexp_matches(path, '^internal/(.*/)?loan_[^/]*$')",
    "question_batches": """WITH RECURSIVE q AS (SELECT repo, type, count(*) + 32 AS size FROM findings WHERE repo IS NOT NULL AND finding_id IS NOT NULL GROUP BY repo, type),
      fit AS (SELECT repo, type, size, row_number() OVER (PARTITION BY repo ORDER BY type) AS i FROM q WHERE size <= 5500),
      w AS (SELECT repo, type, i, size AS used, 1 AS held, 0 AS batch FROM fit WHERE i = 1
        UNION ALL SELECT f.repo, f.type, f.i, CASE WHEN w.used + f.size > 5500 OR w.held >= 8 THEN f.size ELSE w.used + f.size END, CASE WHEN w.used + f.size > 5500 OR w.held >= 8 THEN 1 ELSE w.held + 1 END, w.batch + CASE WHEN w.used + f.size > 5500 OR w.held >= 8 THEN 1 ELSE 0 END
        FROM w JOIN fit f ON f.repo = w.repo AND f.i = w.i + 1)
      SELECT repo, type, batch FROM w UNION ALL SELECT repo, type, -1 FROM q WHERE size > 5500""",
    "exclusions": f"""WITH p AS (SELECT DISTINCT repo, path, string_split(path, '/') AS x FROM source_analysis WHERE path IS NOT NULL)
      SELECT repo, path FROM p WHERE regexp_matches(path, '\\.min\\.([cm]?[jt]s|[jt]sx)$') OR list_has_any(x[:-2], {_DIRS}) OR list_has_any(list_transform(range(1, greatest(len(x) - 1, 1)), lambda i: x[i] || '/' || x[i + 1]), {_PAIRS}) OR len(list_filter(x[:-2], lambda d: regexp_matches(d, '^cmake-build-.+'))) > 0""",
    "language_map": f"SELECT CASE string_split(path, '.')[-1] {_EXT} END AS language, count(DISTINCT file_id) AS files FROM source_analysis GROUP BY 1",
    "quantifiers": "WITH s AS (SELECT framework, bool_and(useful) AS every, bool_or(useful) AS one FROM tests WHERE framework IS NOT NULL AND useful IS NOT NULL GROUP BY 1) SELECT framework, NOT every AS broken, 'ensure' AS quantifier FROM s UNION ALL SELECT framework, NOT one, 'ensure_present' FROM s UNION ALL SELECT framework, one, 'ensure_absent' FROM s",
    "set_fingerprint": "SELECT repo, left(sha256(string_agg(path || ':' || sha, chr(10) ORDER BY path || ':' || sha)), 16) AS fingerprint FROM (SELECT DISTINCT repo, path, sha FROM source_analysis WHERE path IS NOT NULL AND sha IS NOT NULL) GROUP BY repo",
    "halstead": """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents WHERE text IS NOT NULL),
      n AS (SELECT doc_id, count(DISTINCT w) FILTER (length(w) <= 3) AS n1, count(DISTINCT w) FILTER (length(w) > 3) AS n2, count(*) FILTER (length(w) <= 3) AS t1, count(*) FILTER (length(w) > 3) AS t2 FROM w GROUP BY 1),
      v AS (SELECT doc_id, (t1 + t2) * log2(greatest(n1 + n2, 1)) AS volume, coalesce(n1 / 2.0::DOUBLE * t2 / nullif(n2, 0), 0) AS difficulty FROM n)
      SELECT doc_id, round(volume, 4) AS volume, round(difficulty, 4) AS difficulty, round(difficulty * volume, 4) AS effort, round(difficulty * volume / 18, 4) AS time, round(volume / 3000, 4) AS bugs FROM v""",
    "risk_score": """WITH m AS (SELECT *, CASE WHEN sloc = 0 THEN 100.0 ELSE least(100, greatest(0, (171 - 5.2::DOUBLE * ln(greatest(sloc * 8.0::DOUBLE, 1)) - 0.23::DOUBLE * cyclomatic_complexity - 16.2::DOUBLE * ln(greatest(sloc, 1))) * 100 / 171)) END AS mi,
        100 * (1 - 0.7::DOUBLE * least(1, (cyclomatic_complexity - 1) / 10.0::DOUBLE) - 0.3::DOUBLE * least(1, max_nesting / 5.0::DOUBLE)) AS control FROM measurement WHERE file_id IS NOT NULL AND sloc IS NOT NULL AND cyclomatic_complexity IS NOT NULL AND max_nesting IS NOT NULL)
      SELECT file_id, measured_at, round(mi, 6) AS maintainability, round(least(100, greatest(0, 0.65::DOUBLE * (100 - mi) + 0.35::DOUBLE * (100 - control))), 6) AS risk FROM m""",
}
