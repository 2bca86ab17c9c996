"""Queries of the parse-time table functions; their results are not expressible in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.functions import lexical, parsing
from gritstone.operators import resolution
from gritstone.session import checkpointed, table


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """Every delivery; as a file's deliveries have one content, rows drawn from them are made distinct and no text is shuffled."""
    return table(spark, sf, "source_analysis").select("file_id", "path", "source")


def python_methods(spark: SparkSession, sf: str) -> DataFrame:
    return parsing.python_methods(_files(spark, sf)).drop("params", "decorators").distinct()


def python_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Every called name of a function, once per line."""
    return parsing.python_calls(_files(spark, sf)).distinct()


def python_mutants(spark: SparkSession, sf: str) -> DataFrame:
    return parsing.python_mutants(_files(spark, sf))


def python_call_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Every call of a Python file with the method it means, if the repository has it. One parse of each file gives all three tables."""
    rows = checkpointed(parsing.python_tables(table(spark, sf, "source_analysis").select("file_id", "path", "language", "source", "received_at")))
    kind = lambda k: rows.where(F.col("kind") == k)
    methods, calls = kind("method").select("id", "path", "qualified_name"), kind("call").select(F.col("id").alias("caller"), "path", "name", "line")
    imports = resolution.resolve_imports(kind("import").select("path", "alias", "module", "name"), kind("file").select("path").where("path IS NOT NULL"), parsing.module_candidates("python"))
    return resolution.resolve_calls(methods, calls, imports)


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_analysis").select("file_id", "path", "language", "source")


def file_imports(spark: SparkSession, sf: str) -> DataFrame:
    """Every import of every file, in whatever language."""
    return lexical.file_imports(_sources(spark, sf)).select("file_id", "line", "module")


def file_test_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Every test case of every file, in whatever language."""
    return lexical.file_test_cases(_sources(spark, sf))


def file_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Every called name of every file, in whatever language."""
    return lexical.file_calls(_sources(spark, sf))


QUERIES = {f.__name__: f for f in (python_methods, python_calls, python_mutants, python_call_targets, file_imports, file_test_cases, file_calls)}
SQL: dict[str, str] = {
    # line by line and by extension, which is the same where no import stands in a literal or a comment
    "file_imports": r"""WITH f AS (SELECT DISTINCT file_id, string_split(path, '.')[-1] AS x, source FROM source_analysis WHERE file_id IS NOT NULL AND source IS NOT NULL),
      l AS (SELECT file_id, x, unnest(string_split(replace(ltrim(source, chr(65279)), chr(13), ''), chr(10))) AS s, generate_subscripts(string_split(source, chr(10)), 1)::INT AS line FROM f WHERE NOT contains(replace(source, chr(13) || chr(10), ''), chr(13))),
      m AS (SELECT file_id, line, CASE
          WHEN x = 'py' THEN coalesce(nullif(regexp_extract(s, '^\s*from\s+([.\w]+)\s+import\b', 1), ''), nullif(regexp_extract(s, '^\s*import\s+([\w.]+)', 1), ''))
          WHEN x = 'go' THEN nullif(regexp_extract(s, '^(?:import\s+|\t+)(?:[\w.]+ )?"([^"]+)"\s*$', 1), '')
          WHEN x = 'c' OR x = 'h' THEN nullif(regexp_extract(s, '^\s*#\s*include\s*[<"]([^">]+)', 1), '')
          WHEN x = 'java' THEN nullif(regexp_extract(s, '^import (?:static )?([\w.*]+);', 1), '')
          WHEN x = 'rs' THEN nullif(regexp_extract(s, '^\s*use ([^ ;]+);', 1), '')
          WHEN x = 'rb' THEN nullif(regexp_extract(s, '^\s*require(?:_relative)? ["'']([^"'']+)', 1), '')
          WHEN x IN ('js', 'mjs', 'cjs', 'ts', 'mts', 'cts') THEN coalesce(nullif(regexp_extract(s, '^(?:import|export)\b(?:[^"'';()=]*\bfrom)?\s*["'']([^"'']+)["'']', 1), ''), nullif(regexp_extract(s, '\brequire\(["'']([^"'']+)', 1), '')) END AS module FROM l)
      SELECT DISTINCT file_id, line, module FROM m WHERE module IS NOT NULL""",
    # forms that stand on one line; those of Java and Rust lie on two
    "file_test_cases": r"""WITH f AS (SELECT DISTINCT file_id, string_split(path, '.')[-1] AS x, source FROM source_analysis WHERE file_id IS NOT NULL AND source IS NOT NULL),
      l AS (SELECT file_id, x, unnest(string_split(replace(source, chr(13), ''), chr(10))) AS s, generate_subscripts(string_split(source, chr(10)), 1)::INT AS line FROM f),
      m AS (SELECT file_id, line, nullif(CASE WHEN x = 'py' THEN regexp_extract(s, '^\s*(?:async\s+)?def\s+(test\w*)\s*\(', 1) WHEN x = 'go' THEN regexp_extract(s, '^func\s+((?:Test|Benchmark|Example|Fuzz)(?:[^a-z(]\w*)?)\s*\(', 1)
          WHEN x IN ('js', 'mjs', 'cjs', 'ts', 'mts', 'cts') THEN regexp_extract(s, '^\s*(?:it|test|specify)\(["''`]([^"''`]*)["''`]', 1) WHEN x = 'rb' THEN regexp_extract(s, '^\s*def\s+(test_\w+[?!]?)', 1) ELSE '' END, '') AS name FROM l)
      SELECT file_id, line, name FROM m WHERE name IS NOT NULL
      UNION SELECT file_id, 0, 'two lines' FROM f WHERE (x = 'java' AND regexp_matches(source, '@(Test|ParameterizedTest|RepeatedTest)\b')) OR (x = 'rs' AND regexp_matches(source, '#\[(\w+::)*test\]')) OR (x IN ('c', 'h') AND regexp_matches(source, '\bvoid\s+test_?\w+\s*\([^;{]*\)\s*\{'))""",
}
