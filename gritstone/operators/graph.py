"""Method graphs as edge tables: building, neighbours, bounded reachability, closures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritstone.session import checkpointed


def edges_of(calls: DataFrame, source: str, target: str, order: Column) -> DataFrame:
    """``(source, target, site, calls)``: one edge per pair, its first site by ``order``; self calls are none."""
    kept = calls.where((F.col(source) != F.col(target)) & F.col(source).isNotNull() & F.col(target).isNotNull())
    return kept.groupBy(F.col(source).alias("source"), F.col(target).alias("target")).agg(F.min(order).alias("site"), F.count(F.lit(1)).alias("calls"))


def degrees(edges: DataFrame) -> DataFrame:
    """``(node, callees, callers)`` of every node with an edge."""
    both = edges.select(F.col("source").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col("target").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    return both.groupBy("node").agg(F.sum("out").alias("callees"), F.sum("in").alias("callers"))


def top_neighbours(edges: DataFrame, scores: DataFrame, n: int = 8) -> DataFrame:
    """Each node's ``n`` callees of the highest score (``scores(node, score)``), the lower node first among equals."""
    w = Window.partitionBy("source").orderBy(F.desc("score"), "target")
    return edges.join(scores.withColumnRenamed("node", "target"), "target").withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= n).select("source", "target", "score", "rank_no")


def reach(edges: DataFrame, starts: DataFrame, depth: int | None = None, cut: DataFrame | None = None) -> DataFrame:
    """``(start, node, depth)`` of what each start (``starts(start)``) reaches along ``edges(source, target)``, at its least depth, the
    start itself left out. ``cut(node)`` are nodes neither entered nor passed. Without a ``depth`` it runs to the fixed point.

    Each round joins the frontier to the edges, drops what was reached before and is written to the checkpoint folder, so
    the plan stays short and a lost executor costs one round.
    """
    hops = edges.select("source", "target").distinct()
    if cut is not None:
        hops = hops.join(cut.select(F.col("node").alias("target")), "target", "left_anti").join(cut.select(F.col("node").alias("source")), "source", "left_anti")
    hops = checkpointed(hops.select("source", "target"))
    frontier = starts.select("start", F.col("start").alias("node"))
    seen = frontier.withColumn("depth", F.lit(0))
    if cut is not None:
        seen = seen.join(cut, "node", "left_anti").select("start", "node", "depth")
    seen = checkpointed(seen.distinct())
    frontier, level = seen, 0
    while depth is None or level < depth:
        level += 1
        step = frontier.select("start", F.col("node").alias("source")).join(hops, "source").select("start", F.col("target").alias("node")).distinct()
        frontier = checkpointed(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if level % 8 == 0:
            seen = checkpointed(seen)
    return seen.where("depth > 0")


def external_calls(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Edges whose target is not among ``known(node)``."""
    return edges.join(known.select(F.col("node").alias("target")).distinct(), "target", "left_anti")


def nearest_context(paths: DataFrame, documents: DataFrame, name: str) -> DataFrame:
    """``(path, context)``: for each path the nearest file called ``name`` walking up its directories; ``documents(path)``."""
    parts = F.split("path", "/")
    levels = F.sequence(F.lit(0), F.size(parts) - 1)
    base = F.transform(levels, lambda d: F.struct(d.alias("depth"), F.when(d == 0, F.lit(name)).otherwise(F.concat(F.array_join(F.slice(parts, 1, d), "/"), F.lit("/" + name))).alias("context")))
    asked = paths.select("path", F.explode(base).alias("x")).select("path", "x.depth", "x.context")
    return asked.join(documents.select(F.col("path").alias("context")).distinct(), "context").groupBy("path").agg(F.max_by("context", "depth").alias("context"))


def resolve_candidates(requests: DataFrame, candidates: Column, tree: DataFrame) -> DataFrame:
    """``(request, path)``: the first of an array of candidate paths that is in the tree."""
    asked = requests.select("request", F.posexplode(candidates).alias("pos", "path"))
    return asked.join(tree.select("path").distinct(), "path", "left_semi").groupBy("request").agg(F.min_by("path", "pos").alias("path"))
