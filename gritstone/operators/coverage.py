"""Kill matrices, mutation scores, roll-ups, and what a change touched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Orders of a test's status, the worst last; both are in use. Fixed values.
STATUS_ORDER = ("skipped", "passed", "failed", "error")
CASE_ORDER = ("passed", "skipped", "failed", "error")


def worst_status(df: DataFrame, key: str, status: str, order=STATUS_ORDER) -> DataFrame:
    """``(key, worst)``: the worst status by its place in ``order``; others do not count."""
    names = F.array(*(F.lit(s) for s in order))
    place = F.array_position(names, F.col(status))
    return df.groupBy(key).agg(F.try_element_at(names, F.nullif(F.max(place), F.lit(0)).cast("int")).alias("worst"))


def test_outcomes(kills: DataFrame) -> DataFrame:
    """``(test, mutants, kills)`` from ``kills(test, mutant, failed)``, each (test, mutant) once."""
    once = kills.groupBy("test", "mutant").agg(F.max("failed").alias("failed"))
    return once.groupBy("test").agg(F.count(F.lit(1)).alias("mutants"), F.sum("failed").alias("kills"))


def checks_nothing(kills: DataFrame, least: int = 2) -> DataFrame:
    """Tests that ran ``least`` mutants or more and killed none."""
    return test_outcomes(kills).where((F.col("mutants") >= least) & (F.col("kills") == 0))


def redundant_tests(kills: DataFrame, tests: DataFrame, least: int = 3) -> DataFrame:
    """``(test, redundant_with)``: of tests of one file with the same outcome on every mutant the first by line stays. ``tests`` has
    ``(test, path, line)``; a test needs ``least`` mutants and a kill to be judged. A digest stands for the outcomes."""
    once = kills.groupBy("test", "mutant").agg(F.max("failed").alias("failed"))
    vector = F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("mutant", "failed")))), 256)
    judged = once.groupBy("test").agg(vector.alias("vector"), F.count(F.lit(1)).alias("n"), F.sum("failed").alias("k")).where((F.col("n") >= least) & (F.col("k") > 0))
    first = F.first("test").over(Window.partitionBy("path", "vector").orderBy("line", "test"))
    return judged.join(tests, "test").withColumn("redundant_with", first).where("test <> redundant_with").select("test", "redundant_with")


def survivors(kills: DataFrame) -> DataFrame:
    """Mutants that some test ran and none killed."""
    return kills.groupBy("mutant").agg(F.count(F.lit(1)).alias("runs"), F.sum("failed").alias("kills")).where("kills = 0").select("mutant", "runs")


def mutation_totals(mutants: DataFrame, *by: str) -> DataFrame:
    """Totals and scores of ``mutants(status)`` with statuses killed, survived, equivalent, invalid, skipped and no_coverage.
    Equivalent, invalid and skipped ones do not count; the covered score leaves out what no test reaches."""
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    counted = F.count(F.lit(1)) - is_("equivalent", "invalid", "skipped")
    return mutants.groupBy(*by).agg(
        counted.alias("mutants"), is_("killed").alias("killed"), is_("no_coverage").alias("no_coverage"),
        F.try_divide(is_("killed").cast("double"), counted).alias("score"), F.try_divide(is_("killed").cast("double"), counted - is_("no_coverage")).alias("covered_score"),
    )


def directory_rollup(files: DataFrame, path: str, *sums: str) -> DataFrame:
    """Sums per directory prefix; the root is the empty name."""
    parts = F.split(F.col(path), "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda d: F.array_join(F.slice(parts, 1, d), "/"))
    return files.select(F.explode(prefixes).alias("directory"), *sums).groupBy("directory").agg(F.count(F.lit(1)).alias("files"), *(F.sum(s).alias(s) for s in sums))


def touched_units(units: DataFrame, changed: DataFrame, unit: str, path: str, width: int = 64) -> DataFrame:
    """Units ``(unit, path, line, end_line)`` that hold a changed line ``(path, changed_line)``. Spans and lines meet in bins of
    ``width`` lines, so that the join has an equality key and neither long spans nor many lines multiply."""
    spans = units.where("line <= end_line").withColumn("bin", F.explode(F.sequence(F.floor(F.col("line") / width), F.floor(F.col("end_line") / width))))
    lines = changed.where("changed_line IS NOT NULL").select(path, "changed_line").distinct().withColumn("bin", F.floor(F.col("changed_line") / width))
    held = spans.join(lines, [path, "bin"]).where("changed_line BETWEEN line AND end_line")
    return held.select(unit).distinct()


def innermost(spans: DataFrame, points: DataFrame, path: str, width: int = 64) -> DataFrame:
    """``(path, point, owner)``: the smallest of ``spans(owner, path, line, end_line)`` around each of ``points(path, point)``."""
    binned = spans.where("line <= end_line").withColumn("bin", F.explode(F.sequence(F.floor(F.col("line") / width), F.floor(F.col("end_line") / width))))
    at = points.withColumn("bin", F.floor(F.col("point") / width))
    inside = at.join(binned, [path, "bin"]).where("point BETWEEN line AND end_line")
    return inside.groupBy(path, "point").agg(F.min_by("owner", F.struct(F.col("end_line") - F.col("line"), "owner")).alias("owner"))


def mutant_key(line: Column, column: Column, kind: Column, original: Column, mutated: Column) -> Column:
    """``line:column:kind:`` and eight hex digits that stand for the edit."""
    return F.concat_ws(":", line, column, kind, F.substring(F.sha1(F.concat(original, F.lit(">"), mutated)), 1, 8))
