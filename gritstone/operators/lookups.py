"""Lookups between tables of methods, readings, files and names: each a join whose answer is one row, or none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.session import checkpointed


# --- readings, closures, lines
def with_readings(methods: DataFrame, readings: DataFrame, values: Sequence[str]) -> DataFrame:
    """``(id, <values>, state)``: each method of ``methods(id, hash)`` with its reading of ``readings(id, hash, <values>)`` where the hash is
    still the same (``read``), else without (``unread``); readings of methods that are gone stay (``gone``)."""
    held = readings.select("id", F.col("hash").alias("__hash"), *values, F.lit(True).alias("__held"))
    both = methods.select("id", "hash", F.lit(True).alias("__there")).join(held, "id", "full_outer")
    state = F.when(F.col("__there").isNull(), "gone").when(F.col("__held").isNotNull() & F.col("hash").eqNullSafe(F.col("__hash")), "read").otherwise("unread")
    return both.withColumn("state", state).select("id", *(F.when(F.col("state") != "unread", F.col(v)).alias(v) for v in values), "state")


def closure_of(findings: DataFrame, closures: DataFrame) -> DataFrame:
    """``findings(id, method_id, rule)`` with ``closed``: by a closure of its own id, else by one of its method that names its rule."""
    own = closures.where("rule IS NULL").groupBy("id").agg(F.bool_or("closed").alias("__own"))
    through = closures.where("rule IS NOT NULL").groupBy(F.col("id").alias("method_id"), "rule").agg(F.bool_or("closed").alias("__through"))
    return findings.join(own, "id", "left").join(through, ["method_id", "rule"], "left").withColumn("closed", F.coalesce("__own", "__through", F.lit(False))).drop("__own", "__through")


def with_lines(findings: DataFrame, files: DataFrame, most: int = 40) -> DataFrame:
    """``findings(path, line)`` with ``lines``, up to ``most`` of them from its own on; ``files(path, lines)``."""
    return findings.join(files.select("path", F.col("lines").alias("__l")), "path", "left").withColumn("lines", F.slice("__l", F.greatest("line", F.lit(1)), most)).drop("__l")


def by_prefix(refs: DataFrame, ids: DataFrame, least: int = 4) -> DataFrame:
    """``(ref, id, matches)``: the one id that begins with each reference, null where none or several do. References of ``least``
    characters or more meet their ids by these, so that the join has a key; shorter ones match nothing."""
    key = lambda c: F.substring(c, 1, least)
    asked = refs.select("ref").where(F.length("ref") >= least).distinct().withColumn("__k", key("ref"))
    met = asked.join(ids.select("id").distinct().withColumn("__k", key("id")), "__k").where(F.startswith("id", F.col("ref")))
    found = met.groupBy("ref").agg(F.min("id").alias("__id"), F.count(F.lit(1)).alias("matches"))
    return refs.select("ref").distinct().join(found, "ref", "left").select("ref", F.when(F.col("matches") == 1, F.col("__id")).alias("id"), F.coalesce("matches", F.lit(0)).alias("matches"))


def overlay(committed: DataFrame, working: DataFrame, key: str = "path") -> DataFrame:
    """Rows of the working copy in place of those committed under the same key."""
    return committed.join(working.select(key).distinct(), key, "left_anti").unionByName(working)


def unmatched(results: DataFrame, tests: DataFrame, key: str = "test") -> DataFrame:
    """Results of tests that no parse knows."""
    return results.join(tests.select(key).distinct(), key, "left_anti")


# --- names
def first_answer(key: str, value: str, *answers: DataFrame) -> DataFrame:
    """``(key, value, step)``: of several tables of answers the first that has exactly one different value for a key; where an earlier
    one has several, nothing answers, as a name that is ambiguous links to nothing."""
    rows = None
    for step, df in enumerate(answers):
        one = df.where(F.col(value).isNotNull()).select(key, F.col(value).alias("__v"), F.lit(step).alias("step"))
        rows = one if rows is None else rows.unionByName(one)
    by = rows.groupBy(key, "step").agg(F.min("__v").alias("__v"), (F.min("__v") == F.max("__v")).alias("__one"))
    best = by.groupBy(key).agg(F.min(F.struct("step", "__v", "__one")).alias("b"))
    return best.where("b.__one").select(key, F.col("b.__v").alias(value), F.col("b.step").alias("step"))


def nearest_scope(uses: DataFrame, definitions: DataFrame, separator: str = "::") -> DataFrame:
    """``(use, id)``: for each of ``uses(use, scope, name)`` the definition (``scope``, ``name``, ``id``) in the innermost scope around it that has the
    name; none where that scope has several."""
    parts = F.filter(F.split("scope", separator), lambda x: x != "")
    around = F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda d: F.array_join(F.slice(parts, F.lit(1), d), separator))
    asked = uses.select("use", "name", F.posexplode(around).alias("depth", "scope"))
    met = asked.join(definitions.select("scope", "name", "id"), ["scope", "name"]).groupBy("use", "depth").agg(F.min("id").alias("id"), F.max("id").alias("__m"))
    return met.groupBy("use").agg(F.min(F.struct("depth", "id", "__m")).alias("b")).where("b.id = b.__m").select("use", F.col("b.id").alias("id"))


def exported(asked: DataFrame, definitions: DataFrame, reexports: DataFrame, depth: int = 5) -> DataFrame:
    """``(path, name, id)``: what a name asked of a file is, there or through files it re-exports from, at most ``depth`` steps away.
    ``definitions(path, name, id)``; ``reexports(path, name, source, original)``, a null name hands on everything."""
    frontier = asked.select("path", "name", F.col("path").alias("at"), F.col("name").alias("called")).distinct()
    named, whole = reexports.where("name IS NOT NULL").select(F.col("path").alias("at"), F.col("name").alias("called"), "source", "original"), reexports.where("name IS NULL").select(F.col("path").alias("at"), "source").distinct()
    here = definitions.select(F.col("path").alias("at"), F.col("name").alias("called"), "id")
    found = None
    for step in range(depth + 1):
        one = frontier.join(here, ["at", "called"]).groupBy("path", "name").agg(F.min("id").alias("id")).withColumn("step", F.lit(step))
        found = one if found is None else found.unionByName(one)
        if step < depth:
            on = frontier.join(named, ["at", "called"]).select("path", "name", F.col("source").alias("at"), F.col("original").alias("called"))
            on = on.union(frontier.join(whole, "at").select("path", "name", F.col("source").alias("at"), "called"))
            frontier = checkpointed(on.distinct().join(frontier, ["path", "name", "at", "called"], "left_anti"))
            if frontier.isEmpty():
                break
    return found.groupBy("path", "name").agg(F.min_by("id", "step").alias("id"))


def through_wildcards(uses: DataFrame, wildcards: DataFrame, definitions: DataFrame) -> DataFrame:
    """``(use, id)``: the definition in the first file that the using file imports everything from. ``uses(use, path, name)``,
    ``wildcards(path, nth, source)``."""
    met = uses.join(wildcards.select("path", "nth", "source"), "path").join(definitions.select(F.col("path").alias("source"), "name", "id"), ["source", "name"])
    return met.groupBy("use").agg(F.min_by("id", "nth").alias("id"))


def same_package(uses: DataFrame, definitions: DataFrame) -> DataFrame:
    """``(use, id)``: a definition of the name in another file of the same directory and package."""
    folder = F.regexp_replace("path", "[^/]*$", "")
    there = definitions.select(folder.alias("__d"), "package", "name", "id", F.col("path").alias("__p"))
    met = uses.withColumn("__d", folder).join(there, ["__d", "package", "name"]).where("path <> __p")
    return met.groupBy("use").agg(F.min("id").alias("id"))


def overloads(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """``(call, id)``: every method of the file and name a call means that can take its arguments. ``calls(call, target, arguments)``,
    ``methods(id, path, qualified_name, parameters)``."""
    of = methods.select(F.col("id").alias("target"), "path", "qualified_name")
    return calls.join(of, "target").join(methods.select("path", "qualified_name", "id", "parameters"), ["path", "qualified_name"]).where("parameters >= arguments").select("call", "id").distinct()


def argument_values(arguments: DataFrame, parameters: DataFrame) -> DataFrame:
    """``(callee, parameter, value)``: what callers hand over for each parameter, by name where one is written, else by position.
    ``arguments(callee, nth, name, value)``, ``parameters(callee, nth, parameter)``."""
    named = arguments.where("name IS NOT NULL").select("callee", F.col("name").alias("parameter"), "value").join(parameters.select("callee", "parameter"), ["callee", "parameter"])
    placed = arguments.where("name IS NULL").join(parameters, ["callee", "nth"]).select("callee", "parameter", "value")
    return named.select("callee", "parameter", "value").unionByName(placed).distinct()


def members(classes: DataFrame, bases: DataFrame, depth: int = 4) -> DataFrame:
    """``(owner, name, id)``: the members of each class, its own before those of the classes it extends, nearest first, at most ``depth``
    steps up. ``classes(owner, name, id)``, ``bases(child, base)``."""
    step = classes.select("owner").distinct().union(bases.select("child")).distinct().select(F.col("owner").alias("child"), F.col("owner").alias("base"), F.lit(0).alias("up"))
    every = step
    for up in range(1, depth + 1):
        step = step.select("child", F.col("base").alias("__b")).join(bases.select(F.col("child").alias("__b"), "base"), "__b").select("child", "base", F.lit(up).alias("up")).distinct()
        every = every.unionByName(step)
    met = every.join(classes.select(F.col("owner").alias("base"), "name", "id"), "base")
    return met.groupBy(F.col("child").alias("owner"), "name").agg(F.min(F.struct("up", "id")).alias("b")).select("owner", "name", F.col("b.id").alias("id"))


# --- edges
def with_inferred(written: DataFrame, inferred: DataFrame) -> DataFrame:
    """``(source, target, dynamic)``: written edges, and those inferred that nobody wrote."""
    own = written.select("source", "target").distinct()
    more = inferred.select("source", "target").where("source <> target").distinct().join(own, ["source", "target"], "left_anti")
    return own.withColumn("dynamic", F.lit(False)).unionByName(more.withColumn("dynamic", F.lit(True)))


def containment(methods: DataFrame, written: DataFrame) -> DataFrame:
    """``(source, target)``: from a function to those in it, unless they are tests or called anyway. ``methods(id, parent, test)``."""
    inner = methods.where("parent IS NOT NULL AND NOT coalesce(test, false)").select(F.col("parent").alias("source"), F.col("id").alias("target"))
    return inner.join(written.select("source", "target").distinct(), ["source", "target"], "left_anti").distinct()


def closed_names(seeds: DataFrame, aliases: DataFrame, rounds: int = 20) -> DataFrame:
    """``(name)``: names and, to the fixed point, the names that stand for them (``aliases(alias, name)``, classes for their bases too)."""
    known = checkpointed(seeds.select("name").distinct())
    fresh = known
    for _ in range(rounds):
        fresh = checkpointed(fresh.join(aliases, "name").select(F.col("alias").alias("name")).distinct().join(known, "name", "left_anti"))
        if fresh.isEmpty():
            break
        known = known.union(fresh)
    return known


def uses_imported(reads: DataFrame, imports: DataFrame) -> DataFrame:
    """Reads and external calls (``path``, ``name``) whose head is an alias that their file imports from a file of the repository."""
    head = F.split("name", r"\.")[0]
    return reads.withColumn("alias", head).join(imports.where("target IS NOT NULL").select("path", "alias").distinct(), ["path", "alias"], "left_semi")


def top_per_unit(neighbours: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` neighbours of each ``unit``."""
    return neighbours.withColumn("rank_no", F.row_number().over(Window.partitionBy("unit").orderBy(*order))).where(F.col("rank_no") <= n)
