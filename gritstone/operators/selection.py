"""Which units a rule is about: globs, mentions, callers, languages, and the order of relevance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.functions.attributes import Attributes
from gritstone.functions.globs import glob_regex
from gritstone.functions.text import eligible_path


def matches_any(path: Column, globs: Sequence[str]) -> Column:
    """Whether a path matches one of the globs; none match where there are none."""
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_regex(g))
    return out


def under_any(path: Column, roots: Sequence[str]) -> Column:
    """Whether a path is one of the roots or below one; an empty list is everything."""
    if not roots:
        return F.lit(True)
    out = F.lit(False)
    for r in roots:
        out = out | (path == r) | path.startswith(r.rstrip("/") + "/")
    return out


def select_units(units: DataFrame, where: Sequence[str], excepted: Sequence[str] = (), edges: DataFrame | None = None) -> DataFrame:
    """Units ``(id, path, text)`` by selectors, each a glob of paths, ``mentions <text>`` or ``callers of <id>``, less those that an
    exception selects. Globs and mentions are one filter; only ``callers of`` joins."""

    def held(selectors: Sequence[str]) -> tuple[Column, list[str]]:
        condition, called = F.lit(False), []
        for s in selectors:
            if s.startswith("mentions "):
                condition = condition | F.col("text").contains(s.removeprefix("mentions "))
            elif s.startswith("callers of "):
                called.append(s.removeprefix("callers of "))
            else:
                condition = condition | F.col("path").rlike(glob_regex(s))
        return condition, called

    def apply(df: DataFrame, selectors: Sequence[str]) -> DataFrame:
        condition, called = held(selectors)
        if called and edges is not None:
            callers = edges.where(F.col("target").isin(called)).select(F.col("source").alias("id")).distinct().withColumn("__c", F.lit(True))
            return df.join(callers, "id", "left").where(condition | F.coalesce("__c", F.lit(False))).drop("__c")
        return df.where(condition)

    chosen = apply(units, where) if where else units
    return chosen.join(apply(units, excepted).select("id"), "id", "left_anti") if excepted else chosen


def words4(text: Column) -> Column:
    """Lower-case words of four letters or more, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]{4,})"), F.lit(1))


def lexical_rank(units: DataFrame, rule_text: str, unit: str, text: str) -> DataFrame:
    """``(unit, score)``: how many of a unit's words of four letters or more stand in the rule's text, repeats counted."""
    import re

    known = sorted(set(re.findall(r"[a-z]{4,}", rule_text.lower())))
    table = F.array(*(F.lit(w) for w in known)) if known else F.array().cast("array<string>")
    return units.select(unit, F.size(F.filter(words4(F.col(text)), lambda w: F.array_contains(table, w))).cast("long").alias("score"))


def comment_blocks(lines: DataFrame) -> DataFrame:
    """``(id, first_line, last_line)``: runs of successive comment lines of ``lines(id, line_no, line)``, by gaps and islands."""
    only = lines.where(F.col("line").rlike(r"^\s*(//|#|--|/\*|\*)"))
    # lines that are there twice rank alike
    island = F.col("line_no") - F.dense_rank().over(Window.partitionBy("id").orderBy("line_no"))
    return only.withColumn("island", island).groupBy("id", "island").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line")).drop("island")


def quantify(scores: DataFrame, rule: str, holds: Column, quantifier: str) -> DataFrame:
    """``(rule, broken)``: ``ensure`` is broken where one unit does not hold, ``ensure_present`` where none does, ``ensure_absent``
    where one does."""
    broken = {"ensure": ~F.bool_and(holds), "ensure_present": ~F.bool_or(holds), "ensure_absent": F.bool_or(holds)}[quantifier]
    return scores.groupBy(rule).agg(F.coalesce(broken, F.lit(False)).alias("broken"))


def override_merge(rules: DataFrame, name: str = "name", order: str = "load_order") -> DataFrame:
    """Of rules of one name the one that was read last."""
    w = Window.partitionBy(name).orderBy(F.desc(order))
    return rules.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


#: Manifests by the end of their path, and what lies beside them that a tool writes; ``..`` is the folder above, an empty name the
#: manifest's own folder. Fixed values.
MANIFESTS = (
    (r"(?i)[^/]*\.(?:cs|fs|vb)proj", ("bin", "Bin", "obj", "Obj")),
    (r"mix\.exs|rebar\.config", ("deps",)),
    (r"hardhat\.config\.(?:[cm]?js|[cm]?ts)", ("cache", "artifacts")),
    (r"foundry\.toml", ("cache", "broadcast")),
    (r"ProjectSettings/ProjectVersion\.txt", ("Library", "Temp", "Obj", "Logs", "UserSettings", "Builds")),
    (r"[^/]*\.uproject", ("Binaries", "Intermediate", "Saved")),
    (r"pyvenv\.cfg", ("",)),
)
#: Slices in which a repository's attribute files are repeated, as one repository may hold a third of all paths.
SLICES = 16


def project_output(tree: DataFrame) -> DataFrame:
    """``(repo, directory)``: folders that the tools of a tracked manifest write to, below that manifest's own folder only. ``tree``
    has ``repo`` and ``path``; manifests in folders that are left out anyway do not count."""
    rows = None
    for pattern, names in MANIFESTS:
        held = tree.where(F.col("path").rlike(f"(?:^|/)(?:{pattern})$") & eligible_path(F.col("path")))
        root = F.regexp_replace("path", f"(?:{pattern})$", "")
        one = held.select("repo", F.explode(F.array(*(F.concat(root, F.lit(n)) for n in names))).alias("directory"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.select("repo", F.regexp_replace("directory", "/$", "").alias("directory")).where("directory <> ''").distinct()


def attribute_flags(files: DataFrame, names: Sequence[str] = ("linguist-generated", "linguist-vendored")) -> DataFrame | None:
    """``(repo, path, flags)``: of each path of ``files`` (``repo``, ``path``, ``source``, ``received_at``) the attributes among ``names`` that
    an attribute file of its repository specifies, as a map of flags. The latest delivery of an attribute file counts. None where
    there is no attribute file."""
    texts = files.where("repo IS NOT NULL AND (path = '.gitattributes' OR path LIKE '%/.gitattributes')").select("repo", "path", "source", "received_at")
    if texts.isEmpty():
        return None
    texts = texts.groupBy("repo", "path").agg(F.max(F.struct("received_at", "source")).alias("r")).select("repo", F.struct("path", F.col("r.source").alias("source")).alias("file"))
    # a repository's attribute files are few beside its paths
    rules = texts.groupBy("repo").agg(F.collect_list("file").alias("files")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    paths = files.where("path IS NOT NULL AND repo IS NOT NULL").select("repo", "path").distinct().withColumn("slice", F.pmod(F.xxhash64("path"), F.lit(SLICES)).cast("int"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Attributes] = {}
        for pdf in batches:
            flags = []
            for repo, path, held in zip(pdf.repo, pdf.path, pdf.files):
                if repo not in known:
                    if len(known) >= 200:
                        known.clear()
                    known[repo] = Attributes([(f["path"], f["source"]) for f in held])
                found = known[repo].of(path)
                flags.append([(n, found[n]) for n in names if n in found])
            yield pd.DataFrame({"repo": pdf.repo, "path": pdf.path, "flags": flags})

    told = paths.join(rules, ["repo", "slice"]).select("repo", "path", "files").mapInPandas(run, "repo string, path string, flags array<struct<k: string, v: boolean>>")
    return told.select("repo", "path", F.map_from_entries("flags").alias("flags"))


def select_files(files: DataFrame) -> DataFrame:
    """``(repo, path)`` of the files that are source: what attribute files say decides, both ways; else no folder on the way may hold
    dependencies, output, or what a manifest's tools write. ``files`` as for ``attribute_flags``."""
    tree = files.where("repo IS NOT NULL AND path IS NOT NULL").select("repo", "path").distinct()
    parts = F.split("path", "/")
    folders = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "/"))
    written = tree.select("repo", "path", F.explode(folders).alias("directory")).join(project_output(tree), ["repo", "directory"], "left_semi").select("repo", "path").distinct()
    plain = tree.where(eligible_path(F.col("path"))).join(written, ["repo", "path"], "left_anti")
    flags = attribute_flags(files)
    if flags is None:
        return plain
    said = flags.where(F.size("flags") > 0).select("repo", "path", F.exists(F.map_values("flags"), lambda v: v).alias("out"))
    return plain.join(said, ["repo", "path"], "left_anti").unionByName(said.where("NOT out").select("repo", "path"))
