"""Reachability from many starts to a bounded depth, without a shuffle of the pairs that are reached.

Starts are cut into blocks. Bits of the blocks travel along the edges, so that each node knows the blocks that may pass it,
and each block is sent its nodes with their targets. A task walks from the starts of one block and passes on what it reaches:
a graph is shuffled once per block that needs it, its pairs, which may be hundreds of times as many as its edges, never.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritstone.session import checkpointed

#: Starts of a block at most.
BLOCK_STARTS = 100_000
#: Cells (starts x nodes) that are marked at a time, and edges followed at a time; a single start may take more.
CELLS, FOLLOWED = 1_000_000, 4_000_000


class _Block:
    """The nodes of one block by number, those with targets first, and marks for walks from several starts at once."""

    def __init__(self, batches: list[pa.RecordBatch]):
        column = lambda name: pa.concat_arrays([b.column(name) for b in batches])
        if len(pc.unique(column("block"))) > 1:
            raise RuntimeError("a task holds more than one block")
        lists, sources = column("targets"), column("source")
        coded = pa.concat_arrays([sources, lists.flatten()]).dictionary_encode()
        self.ids, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        self.targets, self.n = codes[len(sources) :], len(self.ids)
        self.degree, self.first = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        self.degree[: len(sources)] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        self.first[: len(sources)] = column("first").to_numpy(zero_copy_only=False)
        self.at = np.cumsum(self.degree) - self.degree
        self.starts = np.flatnonzero(column("mine").to_numpy(zero_copy_only=False))
        self.width = max(1, CELLS // self.n)
        self.seen, self.other = np.zeros(self.width * self.n, bool), np.zeros(self.width * self.n, bool)
        self.stamp = np.zeros(self.width * self.n, np.int32 if FOLLOWED + len(self.targets) < 2**31 else np.int64)

    def walk(self, roots: np.ndarray, degree: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Cells and nodes first reached at each level, the starts' at level 0, cells ordered by start; None where it takes too many
        edges at a time. A node's first ``degree`` targets are followed."""
        node, cell = roots, np.arange(len(roots)) * self.n + roots
        out = [(cell, node)]
        self.seen[cell] = True
        for _ in range(depth):
            size = degree[node]
            ends = np.cumsum(size)
            if not len(ends) or not ends[-1]:
                break
            if ends[-1] > FOLLOWED and len(roots) > 1:
                out = self.clear(out)
                break
            row, at = np.repeat(cell - node, size), np.repeat(self.at[node] - (ends - size), size)
            at += np.arange(ends[-1])
            node = self.targets[at]
            cell = row + node
            new = np.flatnonzero(~self.seen[cell])
            cell, node = cell[new], node[new]
            order = np.arange(len(cell), dtype=self.stamp.dtype)
            self.stamp[cell] = order
            new = np.flatnonzero(self.stamp[cell] == order)
            cell, node = cell[new], node[new]
            self.seen[cell] = True
            out.append((cell, node))
        return out

    def clear(self, levels: list[tuple[np.ndarray, np.ndarray]]) -> None:
        for cell, _ in levels:
            self.seen[cell] = False

    def reached(self, roots: np.ndarray, depth: int, unless: bool) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """As ``walk``, without what the same starts reach along first edges only."""
        if not unless:
            levels = self.walk(roots, self.degree, depth)
        elif (plain := self.walk(roots, self.first, depth)) is None:
            return None
        else:
            self.clear(plain)
            if levels := self.walk(roots, self.degree, depth):
                self.clear(levels)
                for cell, _ in plain:
                    self.other[cell] = True
                levels = [(cell[new], node[new]) for cell, node in levels for new in [np.flatnonzero(~self.other[cell])]]
                for cell, _ in plain:
                    self.other[cell] = False
            return levels
        if levels:
            self.clear(levels)
        return levels


def _walker(depth: int, unless: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := [b for b in batches if b.num_rows]):
            return
        block = _Block(held)
        del held
        todo = [block.starts[i : i + block.width] for i in range(0, len(block.starts), block.width)][::-1]
        while todo:
            roots = todo.pop()
            if (levels := block.reached(roots, depth, unless)) is None:
                todo += [roots[len(roots) // 2 :], roots[: len(roots) // 2]]
                continue
            rows, start = np.arange(len(roots) + 1) * block.n, block.ids.take(pa.array(roots))
            for level, (cell, node) in enumerate(levels):
                if level and len(node):
                    offsets = np.searchsorted(cell - node, rows).astype(np.int32)
                    nodes = pa.ListArray.from_arrays(pa.array(offsets), block.ids.take(pa.array(node)))
                    yield pa.RecordBatch.from_arrays([start, pa.array(np.full(len(roots), level, np.int32)), nodes], ["start", "depth", "nodes"])

    return run


def _in_blocks(starts: DataFrame, block: int) -> tuple[DataFrame, int]:
    """``(source, home)``: each start with the number of its block, neighbours in one; and how many blocks there are."""
    starts = checkpointed(starts.select(F.col("start").alias("source")).where("source IS NOT NULL").distinct())
    n = starts.count()
    blocks = max(1, min(n, max(2 * starts.sparkSession.sparkContext.defaultParallelism, math.ceil(n / block))))
    return checkpointed(starts.repartitionByRange(blocks, "source").withColumn("home", F.spark_partition_id())), blocks


def reach_from_many(edges: DataFrame, starts: DataFrame, depth: int, cut: DataFrame | None = None, unless: Column | None = None, block: int = BLOCK_STARTS) -> DataFrame:
    """``(start, node, depth)`` as by ``graph.reach``: what each start (``starts(start)``) reaches along ``edges(source, target)`` in at
    most ``depth`` steps, at its least depth, the start itself left out, ``cut(node)`` neither entered nor passed. With ``unless``, a
    condition on edges, pairs that edges of that condition alone connect within ``depth`` are left out.

    A task holds the edges that a block of ``block`` starts can follow: where they are near each other in the order of the starts
    a fraction of the graph, else up to all of it (20 bytes an edge). Keys of edges and starts are of one type.
    """
    edges = edges.where("source IS NOT NULL AND target IS NOT NULL")
    if cut is not None:
        edges = edges.join(cut.select(F.col("node").alias("target")), "target", "left_anti").join(cut.select(F.col("node").alias("source")), "source", "left_anti")
        starts = starts.join(cut.select(F.col("node").alias("start")), "start", "left_anti")
    plain = F.collect_set(F.when(F.lit(False) if unless is None else unless, F.col("target")))
    # targets of edges that meet the condition stand first
    told = edges.groupBy("source").agg(plain.alias("plain"), F.collect_set("target").alias("all"))
    told = checkpointed(told.select("source", F.size("plain").alias("first"), (F.col("all") if unless is None else F.concat("plain", F.array_except("all", "plain"))).alias("targets")))
    homes, blocks = _in_blocks(starts, block)
    words = [f"w{i}" for i in range(math.ceil(blocks / 64))]
    needed = homes.select("source", *(F.when(F.floor(F.col("home") / 64) == i, F.expr("shiftleft(1L, home % 64)")).otherwise(F.lit(0).cast("long")).alias(w) for i, w in enumerate(words)))
    for _ in range(depth - 1):
        needed = told.join(needed, "source").select(F.explode(F.concat(F.array("source"), "targets")).alias("source"), *words).groupBy("source").agg(*(F.bit_or(w).alias(w) for w in words))

    def of(i: int) -> Column:
        return F.filter(F.sequence(F.lit(64 * i), F.lit(min(64 * i + 63, blocks - 1))), lambda b: F.getbit(F.col(words[i]), b - 64 * i) == 1)

    sent = told.join(needed, "source").join(homes, "source", "left").select(F.explode(F.concat(*map(of, range(len(words))))).alias("block"), "source", F.coalesce("home", F.lit(-1)).alias("home"), "first", "targets")
    sent = sent.select("block", "source", (F.col("home") == F.col("block")).alias("mine"), "first", "targets").repartitionById(blocks, F.col("block"))
    key = told.schema["source"].dataType.simpleString()
    return sent.mapInArrow(_walker(depth, unless is not None), f"start {key}, depth int, nodes array<{key}>").select("start", F.explode("nodes").alias("node"), "depth")
