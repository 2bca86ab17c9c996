"""Time guards over synthetic data of the sizes that a large project has."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from gritstone.operators import coverage


def test_forty_thousand_tests_are_judged_quickly(spark):
    """20,000 methods with three mutants each, two tests a method, of which the second finds what the first does."""
    tests = spark.range(40_000).select(F.col("id").alias("test"), F.concat(F.lit("t"), F.floor(F.col("id") / 40)).alias("path"), F.col("id").alias("line")).cache()
    mutants = F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.floor(F.col("test") / 2) * 3 + k))
    kills = tests.select("test", mutants.alias("mutant")).withColumn("failed", F.when(F.col("mutant") % 3 == 0, 1).otherwise(0)).cache()
    assert kills.count() == 120_000 and tests.count() == 40_000
    coverage.redundant_tests(kills.limit(10), tests).count()
    began = time.time()
    assert coverage.redundant_tests(kills, tests).count() == 20_000
    assert time.time() - began < 20
    kills.unpersist(), tests.unpersist()
