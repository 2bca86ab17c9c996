"""State kept as events and snapshots: folds of closure events, latest rows, staleness, carried rows, differences of reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row per key by ``order`` (given descending, complete enough to leave no ties)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def fold_closures(events: DataFrame) -> DataFrame:
    """``(id, kind, closed)`` from ``events(seq, id, type, kinds)``: a kind is closed where its last event that concerns it dismissed
    it. An event names kinds; a reopening that names none concerns every kind of its id."""
    bare = (F.col("type") == "reopened") & (F.coalesce(F.size("kinds"), F.lit(0)) <= 0)
    named = events.where(~bare).select("id", "seq", (F.col("type") == "dismissed").alias("closed"), F.explode("kinds").alias("kind"))
    last = named.groupBy("id", "kind").agg(F.max_by("closed", "seq").alias("closed"), F.max("seq").alias("seq"))
    reset = events.where(bare).groupBy("id").agg(F.max("seq").alias("reset"))
    return last.join(reset, "id", "left").select("id", "kind", (F.col("closed") & (F.coalesce("reset", F.lit(-1)) < F.col("seq"))).alias("closed"))


def split_stale(held: DataFrame, current: DataFrame, key: str, hash_col: str) -> DataFrame:
    """``held`` with ``stale``: its key is gone from ``current`` or its hash moved."""
    now = current.select(key, F.col(hash_col).alias("__now"), F.lit(True).alias("__there"))
    return held.join(now, key, "left").withColumn("stale", F.col("__there").isNull() | ~F.col(hash_col).eqNullSafe(F.col("__now"))).drop("__now", "__there")


def carry_forward(fresh: DataFrame, earlier: DataFrame, keys: Sequence[str], known: DataFrame) -> DataFrame:
    """Fresh rows, and the earlier rows of keys that were not read again and still exist in ``known``."""
    kept = earlier.join(fresh.select(*keys), list(keys), "left_anti").join(known.select(*keys).distinct(), list(keys), "left_semi")
    return fresh.unionByName(kept)


def diff_snapshots(before: DataFrame, after: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Rows of two snapshots that differ, matched by key: each value before and after, null where the key was or is missing."""
    b = before.select(key, *(F.col(v).alias(f"{v}_before") for v in values))
    a = after.select(key, *(F.col(v).alias(f"{v}_after") for v in values))
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"{v}_before").eqNullSafe(F.col(f"{v}_after"))
    return b.join(a, key, "full_outer").where(~same)


def added_removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows only in the one or the other snapshot, with ``change``."""
    return after.exceptAll(before).distinct().withColumn("change", F.lit("added")).unionByName(before.subtract(after).withColumn("change", F.lit("removed")))


def longest_runs(rows: DataFrame, key: str, order: Sequence[str], flag: Column) -> DataFrame:
    """The longest stretch of successive rows with ``flag`` per key, by gaps and islands."""
    every, own = Window.partitionBy(key).orderBy(*order), Window.partitionBy(key, "__f").orderBy(*order)
    runs = rows.withColumn("__f", flag).withColumn("__g", F.row_number().over(every) - F.row_number().over(own))
    return runs.where("__f").groupBy(key, "__g").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.max("n").alias("longest"))
