"""Which method a call means: an ordered cascade of joins, the first that answers wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import resolve_candidates


def resolve_imports(imports: DataFrame, tree: DataFrame, candidates) -> DataFrame:
    """``imports(path, alias, module, name)`` with ``target``, the file its module is, or null. Each (directory, module) is resolved
    once, however many files import it."""
    directory = F.regexp_replace("path", "[^/]*$", "")
    asked = imports.select(directory.alias("directory"), "module").distinct().withColumn("request", F.struct("directory", "module"))
    # a candidate depends on the importer's directory alone
    found = resolve_candidates(asked, candidates(F.concat(F.col("request.directory"), F.lit("_")), F.col("request.module")), tree)
    found = found.select(F.col("request.directory").alias("directory"), F.col("request.module").alias("module"), F.col("path").alias("target"))
    return imports.withColumn("directory", directory).join(found, ["directory", "module"], "left").drop("directory")


def resolve_calls(methods: DataFrame, calls: DataFrame, imports: DataFrame) -> DataFrame:
    """``(caller, name, line, target, how)`` for every call; ``target`` is null where nothing in the repository answers.

    ``methods(id, path, qualified_name)``, ``calls(caller, path, name, line)`` with dotted names, ``imports(path, alias, name, target)`` as
    ``resolve_imports`` gives them. In order: a member of the caller's own class by ``self`` or ``cls``; a function of the same file,
    the innermost scope around the caller first; an imported name, or a name of an imported module. Calls of oneself are dropped.
    """
    parts = F.split("name", r"\.")
    scope = F.split(F.split("caller", "::")[1], r"\.")
    # equal calls of one line are one; their values name them in every branch, where a generated number could differ
    rows = calls.select("caller", "path", "name", "line").distinct().withColumn("call", F.struct("caller", "name", "line")).withColumn("parts", parts).withColumn("scope", scope)
    # every name a call could have in its own file, the likeliest first
    own_class = F.when(F.col("parts")[0].isin("self", "cls") & (F.size("parts") == 2) & (F.size("scope") > 1), F.array(F.concat_ws(".", F.slice("scope", 1, F.size("scope") - 1), F.col("parts")[1])))
    around = F.transform(F.sequence(F.size("scope"), F.lit(0), F.lit(-1)), lambda d: F.concat_ws(".", F.slice(F.col("scope"), 1, d), F.col("name")))
    local = rows.select("call", "path", F.posexplode(F.coalesce(own_class, around)).alias("pos", "qualified_name"))
    by_file = local.join(methods.select("path", "qualified_name", "id"), ["path", "qualified_name"]).groupBy("call").agg(F.min_by("id", "pos").alias("here"))
    used = rows.select("call", "path", F.col("parts")[0].alias("alias"), "parts")
    bound = used.join(imports.where("target IS NOT NULL").select("path", "alias", F.col("name").alias("imported"), "target"), ["path", "alias"])
    wanted = F.concat_ws(".", F.when(F.col("imported").isNotNull(), F.concat(F.array("imported"), F.slice("parts", 2, 99))).otherwise(F.slice("parts", 2, 99)))
    through = bound.select("call", F.col("target").alias("path"), wanted.alias("qualified_name")).join(methods.select("path", "qualified_name", "id"), ["path", "qualified_name"]).groupBy("call").agg(F.min("id").alias("there"))
    out = rows.join(by_file, "call", "left").join(through, "call", "left").withColumn("target", F.coalesce("here", "there"))
    how = F.when(F.col("here").isNotNull(), "file").when(F.col("there").isNotNull(), "import").otherwise("external")
    return out.where(F.col("target").isNull() | (F.col("target") != F.col("caller"))).select("caller", "name", "line", "target", how.alias("how"))


def overrides(methods: DataFrame, bases: DataFrame, depth: int = 3) -> DataFrame:
    """``(id, override)``: methods of the same name in classes that name the owner as a base, directly or over ``depth`` steps.
    ``methods(id, owner, name)``, ``bases(child, base)``."""
    step = bases.select("child", F.col("base").alias("ancestor"))
    level, every = step, step
    for _ in range(depth - 1):
        level = level.join(bases.select(F.col("child").alias("ancestor"), "base"), "ancestor").select("child", F.col("base").alias("ancestor")).distinct()
        every = every.unionByName(level)
    every = every.where("child <> ancestor").distinct()
    below = methods.select(F.col("id").alias("override"), F.col("owner").alias("child"), "name")
    return methods.select("id", F.col("owner").alias("ancestor"), "name").join(every, "ancestor").join(below, ["child", "name"]).select("id", "override")


def unique_match(candidates: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, value)`` where exactly one different value answers."""
    return candidates.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("__m")).where(F.col(value) == F.col("__m")).drop("__m")


def longest_prefix(texts: DataFrame, text: str, prefixes: dict[str, str], default: str | None = None) -> Column:
    """The value of the longest of a few known prefixes of a text, else the default."""
    out = F.lit(default)
    for prefix in sorted(prefixes, key=len):
        out = F.when(texts[text].startswith(prefix), F.lit(prefixes[prefix])).otherwise(out)
    return out


def line_marks(units: DataFrame) -> DataFrame:
    """``(path, line, state)``: each line's state by the innermost of ``units(path, line, end_line, state)`` around it."""
    lines = units.where("line <= end_line").select("path", "state", (F.col("end_line") - F.col("line")).alias("span"), F.explode(F.sequence("line", "end_line")).alias("at"))
    w = Window.partitionBy("path", "at").orderBy("span", "state")
    return lines.withColumn("n", F.row_number().over(w)).where("n = 1").select("path", F.col("at").alias("line"), "state")
