"""Queries over source lines, names, listings and counts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gritstone.functions import shaping as S
from gritstone.functions import text
from gritstone.session import table

from .scoring import _issues, _raised, _severity, _SEV


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of each delivery of a file. Deliveries have one content, so that what is drawn from them is made distinct in the end
    and no text is shuffled."""
    files = table(spark, sf, "source_analysis").where("file_id IS NOT NULL AND source IS NOT NULL")
    return files.select("file_id", "repo", "path", "declarations", text.lines_of(F.col("source")).alias("lines"))


def _units(spark: SparkSession, sf: str) -> DataFrame:
    units = _lines(spark, sf).select("file_id", "lines", F.explode("declarations").alias("d"))
    return units.where("d.line IS NOT NULL AND d.end_line IS NOT NULL AND d.id IS NOT NULL").select("file_id", F.col("d.id").alias("decl_id"), F.col("d.line").alias("line"), F.col("d.end_line").alias("end_line"), "lines")


def unit_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """The hash of each declaration as a question shows it, its leading comment included."""
    return _units(spark, sf).select("file_id", "decl_id", F.sha2(S.shown_source(F.col("lines"), F.col("line"), F.col("end_line")), 256).alias("hash")).distinct()


def unit_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of eight lines about the middle of each declaration."""
    middle = F.floor((F.col("line") + F.col("end_line")) / 2).cast("int")
    return _units(spark, sf).select("file_id", "decl_id", F.md5(S.excerpt(F.col("lines"), F.col("line"), F.col("end_line"), 8, middle)).alias("excerpt")).distinct()


def numbered_files(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("file_id", F.md5(S.numbered(F.col("lines"))).alias("numbered")).distinct()


def top_level_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Each file with the lines of its declarations taken out, one line standing for each stretch of them."""
    ranges = F.transform(F.filter("declarations", lambda d: d["line"].isNotNull() & d["end_line"].isNotNull()), lambda d: F.struct(d["line"].alias("a"), d["end_line"].alias("z")))
    own = _lines(spark, sf).select("file_id", "lines", F.coalesce(ranges, F.array().cast("array<struct<a:int,z:int>>")).alias("r"))
    spans = own.select("file_id", F.transform("lines", lambda x, i: F.when(~F.exists("r", lambda d: (d["a"] <= i + 1) & (i + 1 <= F.greatest(d["a"], d["z"]))), x)).alias("span"))
    return spans.select("file_id", F.md5(S.shown_lines(F.col("span"))).alias("top_level")).distinct()


def body_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return _units(spark, sf).select("file_id", "decl_id", S.body_lines(F.col("line"), F.col("end_line")).alias("b")).select("file_id", "decl_id", F.col("b.from").alias("first"), F.col("b.to").alias("last")).distinct()


def limited_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", S.limited(F.col("text"), 1000).alias("x"))
    return docs.select("doc_id", F.md5("x.source").alias("source"), F.col("x.partial").alias("partial"))


def module_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_analysis").where("path LIKE '%.py'").select("repo", S.python_module(F.col("path")).alias("module")).distinct()


def header_languages(spark: SparkSession, sf: str) -> DataFrame:
    """What a header file is in each repository."""
    return table(spark, sf, "source_analysis").where("path IS NOT NULL").groupBy("repo").agg(S.header_language(F.col("path")).alias("header"))


def severity_names(spark: SparkSession, sf: str) -> DataFrame:
    return _severity(spark, sf).select("user_id", S.severity_name(F.col("s.band"), F.round("s.predicted", 1)).alias("severity"))


def measure_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Measures as a report prints them."""
    age = F.unix_timestamp(F.lit("2026-12-01").cast("timestamp")) - F.unix_timestamp("measured_at")
    rows = table(spark, sf, "measurement").where("file_id IS NOT NULL AND measured_at IS NOT NULL")
    return rows.select("file_id", S.percent(F.col("risk_score") / 100).alias("risk"), S.money(F.col("risk_score") / 43210).alias("price"), S.since(age).alias("age")).distinct()


def kind_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "findings").groupBy(S.kind_label(F.col("kind")).alias("label")).agg(F.count(F.lit(1)).alias("findings"))


def kind_spread(spark: SparkSession, sf: str) -> DataFrame:
    """The greatest shares of kinds in each repository's findings."""
    counts = table(spark, sf, "findings").where("kind IS NOT NULL AND repo IS NOT NULL").groupBy("repo", "kind").agg(F.count(F.lit(1)).alias("n"))
    masses = counts.groupBy("repo").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("m"), F.sum("n").alias("all"))
    return masses.select("repo", S.spread(F.transform_values("m", lambda k, v: v / F.col("all"))).alias("kinds"))


def issue_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Each method's first three issues by probability, and how many more it has."""
    order = F.array_sort(F.collect_list(F.struct((-F.round("probability", 6)).alias("p"), "question")))
    rows = _issues(spark, sf, 0.0).groupBy("user_id").agg(order.alias("i"))
    return rows.select("user_id", S.first_few(F.transform("i", lambda x: F.concat(x["question"], F.lit(" "), S.percent(F.round(-x["p"], 2)))), 2).alias("issues"))


def issue_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a method has an issue, one that is a defect or a hole, one of design."""
    design = ~F.col("type").isin("defect", "security")
    return _issues(spark, sf).groupBy("user_id").agg(F.bool_or(~design).alias("flagged"), F.bool_or(design).alias("needs_design"), F.count(F.lit(1)).alias("issues"))


def failing_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Issues of the questions that gate a run."""
    gates = spark.createDataFrame([("error",), ("purchase",)], "question string")
    return _issues(spark, sf).join(F.broadcast(gates), "question", "left_semi").select("user_id", "question", F.round("probability", 6).alias("probability"))


def scan_tally(spark: SparkSession, sf: str) -> DataFrame:
    """Problems, the files they are in and how many fail, per repository."""
    rows = table(spark, sf, "findings").where("repo IS NOT NULL")
    failing = F.count_if(F.col("severity").rlike(r"^\s*[pP]?\s*[01]"))
    return rows.groupBy("repo").agg(F.count(F.lit(1)).alias("problems"), F.countDistinct("path").alias("files"), failing.alias("failing"))


def parse_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Files per language by how their parse ended, and up to twenty messages in order."""
    rows = table(spark, sf, "source_analysis")
    status = lambda s: F.count_if(F.col("parser_status") == s).alias(s.replace("-", "_"))
    counts = rows.groupBy("language").agg(F.count(F.lit(1)).alias("files"), *(status(s) for s in ("parsed", "parse-error", "unsupported")))
    ranked = rows.where("parser_message IS NOT NULL").select("language", "parser_message").distinct().withColumn("n", F.row_number().over(Window.partitionBy("language").orderBy("parser_message"))).where("n <= 20")
    messages = ranked.groupBy("language").agg(F.array_join(F.array_sort(F.collect_list("parser_message")), " | ").alias("messages"))
    own = counts.withColumnRenamed("language", "l").join(messages, F.col("l").eqNullSafe(F.col("language")), "left")
    return own.select(F.col("l").alias("language"), "files", "parsed", "parse_error", "unsupported", "messages")


def hotspots(spark: SparkSession, sf: str) -> DataFrame:
    """The 24 orders' lines of each customer segment that come first by six keys."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    order = [F.desc("l_quantity"), F.desc("l_discount"), F.desc("l_tax"), F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")]
    ranked = rows.withColumn("rank_no", F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(*order))).where("rank_no <= 24")
    return ranked.select("o_orderpriority", "l_orderkey", "l_linenumber", "rank_no")


def nation_table(spark: SparkSession, sf: str) -> DataFrame:
    """Nations laid out in columns."""
    return S.fixed_width(table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), {"n_name": "left", "n_nationkey": "right", "n_regionkey": "right"}).select("n_nationkey", "line")


def scope_intersection(spark: SparkSession, sf: str) -> DataFrame:
    """Paths with findings that are in scope."""
    return table(spark, sf, "findings").select("repo", "path").intersect(table(spark, sf, "source_analysis").where("size > 500").select("repo", "path")).where("path IS NOT NULL")


def key_union(spark: SparkSession, sf: str) -> DataFrame:
    """Repositories known from any table."""
    names = [table(spark, sf, t).select("repo") for t in ("findings", "tests", "source_analysis", "documents")]
    return names[0].union(names[1]).union(names[2]).union(names[3]).where("repo IS NOT NULL").distinct()


def outcome_keys(spark: SparkSession, sf: str) -> DataFrame:
    """A key for each test file's cases, whatever their order."""
    rows = table(spark, sf, "tests").where("repo IS NOT NULL AND path IS NOT NULL AND name IS NOT NULL").select("repo", "path", "name").distinct()
    return rows.groupBy("repo", "path").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("name")), "\n"), 256).alias("key"))


QUERIES = {
    f.__name__: f
    for f in (
        unit_hashes, unit_excerpts, numbered_files, top_level_lines, body_ranges, limited_documents, module_names, header_languages, severity_names, measure_labels, kind_labels, kind_spread, issue_cells, issue_flags,
        failing_issues, scan_tally, parse_counts, hotspots, nation_table, scope_intersection, key_union, outcome_keys,
    )
}

_F = r"""f AS (SELECT DISTINCT ON (file_id) file_id, declarations, string_split(regexp_replace(source, '\r\n?', chr(10), 'g'), chr(10)) AS lines FROM source_analysis WHERE file_id IS NOT NULL AND source IS NOT NULL ORDER BY file_id)"""
_MARK = r"""'^\s*(//|/\*|\*|#|"{3}|''{3})'"""
_U = rf"""{_F}, d AS (SELECT file_id, lines, unnest(declarations) AS d FROM f),
u AS (SELECT file_id, lines, d.id AS decl_id, d.line AS a, d.end_line AS z FROM d WHERE d.line IS NOT NULL AND d.end_line IS NOT NULL AND d.id IS NOT NULL),
above AS (SELECT *, list_reverse(lines[1:a - 1]) AS up FROM u),
runs AS (SELECT *, coalesce(list_position(list_transform(up, lambda x: regexp_matches(x, {_MARK}) OR trim(x, ' ') = ''), false), len(up) + 1) - 1 AS n FROM above),
c AS (SELECT *, CASE WHEN len(up) > 0 AND regexp_matches(up[1], {_MARK}) THEN regexp_replace(regexp_replace(array_to_string(list_reverse(up[1:n]), chr(10)), '^\s+', ''), '\s+$', '') ELSE '' END AS comment FROM runs)"""
_LABELS = "MAP {'boundary': 'off_by_one', 'missing_null_handling': 'unhandled_null', 'wrong_return': 'wrong_return_value', 'swallowed_error': 'error_ignored', 'state_mutation': 'bad_state_change', 'ordering': 'wrong_order', 'resource_leak': 'leak', 'other': 'other_defect', 'split': 'too_big', 'flatten': 'too_nested', 'simplify_conditions': 'tangled_conditions', 'deduplicate': 'duplicated_logic', 'rename': 'misnamed', 'remove_dead_code': 'dead_code'}"
_FEW = lambda rows, n, sep: f"array_to_string({rows}[1:{n}] || CASE WHEN len({rows}) > {n} THEN ['+' || (len({rows}) - {n}) || ' more'] ELSE [] END, '{sep}')"

SQL = {
    "unit_hashes": f"WITH {_U} SELECT file_id, decl_id, sha256(CASE WHEN comment <> '' THEN comment || chr(10) ELSE '' END || array_to_string(lines[a:z], chr(10))) AS hash FROM c",
    "unit_excerpts": f"""WITH {_U}, w AS (SELECT *, CASE WHEN comment = '' THEN []::VARCHAR[] ELSE string_split(comment, chr(10)) END AS over_it FROM c),
      v AS (SELECT *, over_it || lines[a:z] AS rows FROM w),
      p AS (SELECT *, least(greatest(0, len(over_it) + floor((a + z) / 2)::INT - a - 4), len(rows) - 8) AS k FROM v)
      SELECT file_id, decl_id, md5(CASE WHEN len(rows) <= 8 THEN array_to_string(rows, chr(10)) ELSE CASE WHEN k > 0 THEN '... (' || k || ' lines above)' || chr(10) ELSE '' END || array_to_string(rows[k + 1:k + 8], chr(10))
        || CASE WHEN k + 8 < len(rows) THEN chr(10) || '... (' || (len(rows) - k - 8) || ' more lines)' ELSE '' END END) AS excerpt FROM p""",
    "numbered_files": f"WITH {_F} SELECT file_id, md5(array_to_string(list_transform(lines, lambda x, i: 'L' || i || '| ' || x), chr(10))) AS numbered FROM f",
    "top_level_lines": f"""WITH {_F}, l AS (SELECT file_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM f), r AS (SELECT DISTINCT file_id, d.line AS a, greatest(d.line, d.end_line) AS z FROM (SELECT file_id, unnest(declarations) AS d FROM f) WHERE d.line IS NOT NULL AND d.end_line IS NOT NULL),
      m AS (SELECT file_id, i, line, EXISTS (SELECT 1 FROM r WHERE r.file_id = l.file_id AND i BETWEEN a AND z) AS inside FROM l),
      n AS (SELECT *, lag(inside) OVER (PARTITION BY file_id ORDER BY i) AS was FROM m)
      SELECT file_id, md5(string_agg(CASE WHEN inside THEN '... (read on its own)' ELSE line END, chr(10) ORDER BY i)) AS top_level FROM n WHERE NOT (inside AND coalesce(was, false)) GROUP BY file_id""",
    "body_ranges": f"WITH {_U} SELECT file_id, decl_id, CASE WHEN z > a THEN a + 1 ELSE a END AS first, CASE WHEN z > a THEN z ELSE a END AS last FROM u",
    "limited_documents": "SELECT doc_id, md5(substring(text, 1, 1000)) AS source, length(text) > 1000 AS partial FROM documents WHERE text IS NOT NULL",
    "module_names": r"SELECT DISTINCT repo, replace(regexp_replace(regexp_replace(path, '\.py$', ''), '/__init__$', ''), '/', '.') AS module FROM source_analysis WHERE path LIKE '%.py'",
    "header_languages": r"SELECT repo, CASE WHEN bool_or(regexp_matches(path, '\.(cpp|cc|cxx|hpp|hh|hxx)$')) THEN 'cpp' ELSE 'c' END AS header FROM source_analysis WHERE path IS NOT NULL GROUP BY repo",
    "severity_names": f"WITH {_SEV} SELECT user_id, ['P3','P2','P1','P0'][floor(expected + 0.5)::INT + 1] || ' (' || printf('%.1f', round(3 - expected, 1)) || ')' AS severity FROM sev",
    "measure_labels": """SELECT DISTINCT file_id, floor(risk_score / 100 * 100 + 0.5)::BIGINT || '%' AS risk,
        CASE WHEN risk_score IS NULL THEN 'price unknown' ELSE '$' || CASE WHEN risk_score / 43210 > 0 AND risk_score / 43210 < 0.0001 THEN rtrim(printf('%.9f', risk_score / 43210), '0') WHEN risk_score / 43210 < 0.01 THEN printf('%.4f', risk_score / 43210) ELSE printf('%.2f', risk_score / 43210) END END AS price,
        CASE WHEN s < 90 THEN s || 's ago' WHEN s < 5400 THEN floor(s / 60 + 0.5)::BIGINT || 'm ago' WHEN s < 172800 THEN floor(s / 3600 + 0.5)::BIGINT || 'h ago' ELSE floor(s / 86400 + 0.5)::BIGINT || 'd ago' END AS age
      FROM (SELECT *, greatest(0, floor(epoch(TIMESTAMP '2026-12-01'))::BIGINT - floor(epoch(measured_at))::BIGINT) AS s FROM measurement WHERE file_id IS NOT NULL AND measured_at IS NOT NULL)""",
    "kind_labels": f"SELECT coalesce({_LABELS}[kind], kind) AS label, count(*) AS findings FROM findings GROUP BY 1",
    "kind_spread": f"""WITH n AS (SELECT repo, kind, count(*) AS n FROM findings WHERE kind IS NOT NULL AND repo IS NOT NULL GROUP BY 1, 2), s AS (SELECT repo, kind, n / sum(n) OVER (PARTITION BY repo) AS v FROM n),
      a AS (SELECT repo, list(coalesce({_LABELS}[kind], kind) || ' ' || floor(v * 100 + 0.5)::BIGINT || '%' ORDER BY v DESC, kind) AS k FROM s WHERE v > 0.005 GROUP BY repo) SELECT repo, {_FEW("k", 3, "  ")} AS kinds FROM a""",
    "issue_cells": f"""WITH {_raised(0)}, k AS (SELECT user_id, list(question || ' ' || floor(round(round(probability, 6), 2) * 100 + 0.5)::BIGINT || '%' ORDER BY round(probability, 6) DESC, question) AS k FROM issues GROUP BY 1) SELECT user_id, {_FEW("k", 2, ", ")} AS issues FROM k""",
    "issue_flags": f"WITH {_raised(0.5)} SELECT user_id, bool_or(type IN ('defect', 'security')) AS flagged, bool_or(type NOT IN ('defect', 'security')) AS needs_design, count(*) AS issues FROM issues GROUP BY 1",
    "failing_issues": f"WITH {_raised(0.5)} SELECT user_id, question, round(probability, 6) AS probability FROM issues WHERE question IN ('error', 'purchase')",
    "scan_tally": r"SELECT repo, count(*) AS problems, count(DISTINCT path) AS files, count(*) FILTER (regexp_matches(severity, '^\s*[pP]?\s*[01]')) AS failing FROM findings WHERE repo IS NOT NULL GROUP BY repo",
    "parse_counts": """WITH n AS (SELECT language, count(*) AS files, count(*) FILTER (parser_status = 'parsed') AS parsed, count(*) FILTER (parser_status = 'parse-error') AS parse_error, count(*) FILTER (parser_status = 'unsupported') AS unsupported FROM source_analysis GROUP BY 1),
      m AS (SELECT language, parser_message FROM (SELECT DISTINCT language, parser_message FROM source_analysis WHERE parser_message IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY language ORDER BY parser_message) <= 20),
      t AS (SELECT language, string_agg(parser_message, ' | ' ORDER BY parser_message) AS messages FROM m GROUP BY 1)
      SELECT n.language, files, parsed, parse_error, unsupported, messages FROM n LEFT JOIN t ON n.language IS NOT DISTINCT FROM t.language""",
    "hotspots": "SELECT o_orderpriority, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY o_orderpriority ORDER BY l_quantity DESC, l_discount DESC, l_tax DESC, l_extendedprice DESC, l_orderkey, l_linenumber) AS rank_no FROM lineitem JOIN orders ON o_orderkey = l_orderkey QUALIFY rank_no <= 24",
    "nation_table": "WITH w AS (SELECT greatest(max(length(n_name)), 6) AS a, greatest(max(length(n_nationkey::VARCHAR)), 11) AS b, greatest(max(length(n_regionkey::VARCHAR)), 11) AS c FROM nation) SELECT n_nationkey, rtrim(rpad(n_name, a::INT, ' ') || '  ' || lpad(n_nationkey::VARCHAR, b::INT, ' ') || '  ' || lpad(n_regionkey::VARCHAR, c::INT, ' ')) AS line FROM nation, w",
    "scope_intersection": "SELECT repo, path FROM findings WHERE path IS NOT NULL INTERSECT SELECT repo, path FROM source_analysis WHERE size > 500",
    "key_union": "SELECT repo FROM findings WHERE repo IS NOT NULL UNION SELECT repo FROM tests WHERE repo IS NOT NULL UNION SELECT repo FROM source_analysis WHERE repo IS NOT NULL UNION SELECT repo FROM documents WHERE repo IS NOT NULL",
    "outcome_keys": "SELECT repo, path, sha256(string_agg(name, chr(10) ORDER BY name)) AS key FROM (SELECT DISTINCT repo, path, name FROM tests WHERE repo IS NOT NULL AND path IS NOT NULL AND name IS NOT NULL) GROUP BY 1, 2",
}
