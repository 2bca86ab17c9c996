"""What a change touched: hunks of unified diffs, and the units they change."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HUNK = "change string, path string, old_path string, hunk int, old_start int, old_count int, new_start int, new_count int, changed array<int>, text string"
_HEAD = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def _file_name(written: str, side: str) -> str | None:
    """The path on a ``---`` or ``+++`` line: without its side's letter, quoted octal bytes read as UTF-8; None for no file."""
    name = written.split("\t", 1)[0]
    if name.startswith('"') and name.endswith('"'):
        raw = re.sub(rb"\\([0-7]{3})", lambda m: bytes([int(m[1], 8)]), name[1:-1].encode())
        name = re.sub(r'\\(["\\])', r"\1", raw.decode("utf-8", "replace"))
    return None if name == "/dev/null" else name.removeprefix(f"{side}/")


def hunks_of(diff: str | None) -> list[tuple]:
    """``(path, old_path, hunk, old_start, old_count, new_start, new_count, changed, text)`` of a unified diff; ``changed`` are the
    new side's lines that were added, and for deletions the line they stood before. A deleted file has no path on the new side and
    no rows."""
    rows: list[list] = []
    old = new = None
    left = kept = at = 0  # lines of the old and the new side that the hunk still has
    for line in (diff or "").split("\n"):
        if left > 0 or kept > 0:
            sign = line[:1]
            rows[-1][8].append(line)
            if sign == "+":
                rows[-1][7].append(at)
                at, kept = at + 1, kept - 1
            elif sign == "-":
                rows[-1][7].append(at)
                left -= 1
            elif sign != "\\":
                at, left, kept = at + 1, left - 1, kept - 1
            continue
        if line.startswith("\\") and rows:
            rows[-1][8].append(line)
        elif line.startswith("diff --git "):
            old = new = None
        elif line.startswith("--- "):
            old = _file_name(line[4:], "a")
        elif line.startswith("+++ "):
            new = _file_name(line[4:], "b")
        elif m := _HEAD.match(line):
            a, n, b, k = (1 if g is None else int(g) for g in m.groups())
            left, kept, at = n, k, b + (k == 0)
            rows.append([new, old, sum(r[0] == new for r in rows), a, n, b, k, [], [line]])
    return [(*r[:7], sorted(set(r[7])), "\n".join(r[8])) for r in rows if r[0] is not None]


def hunks(changes: DataFrame, change: str = "change", diff: str = "diff") -> DataFrame:
    """The hunks of every diff of ``changes``, whatever context lines it has; a change is one diff, and may name several files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in HUNK.split(", ")]
        for pdf in batches:
            yield pd.DataFrame([(key, *row) for key, text in zip(pdf[change], pdf[diff]) for row in hunks_of(text)], columns=names)

    return changes.select(F.col(change).cast("string").alias(change), diff).mapInPandas(run, HUNK)


def changed_files(found: DataFrame) -> DataFrame:
    """``(change, path, old_path, added, lines)``: each file of a change, whether it is new, and how many of its lines changed."""
    by = found.groupBy("change", "path").agg(F.min("old_path").alias("old_path"), F.sum(F.size("changed")).alias("lines"))
    return by.select("change", "path", "old_path", F.col("old_path").isNull().alias("added"), "lines")


def changed_units(found: DataFrame, units: DataFrame) -> DataFrame:
    """``(change, id)``: units (``id``, ``path``, ``line``, ``end_line``, and ``own``, the lines of a unit that holds others, or null) of which a
    changed line is one of their own. A unit meets the changed lines of its file, which are few beside the file."""
    lines = found.select("change", "path", F.explode("changed").alias("at")).distinct()
    bins = units.withColumn("bin", F.explode(F.sequence(F.floor(F.col("line") / 64), F.floor(F.greatest("line", "end_line") / 64))))
    met = lines.withColumn("bin", F.floor(F.col("at") / 64)).join(bins, ["path", "bin"]).where((F.col("at") >= F.col("line")) & (F.col("at") <= F.col("end_line")))
    return met.where(F.col("own").isNull() | F.array_contains("own", F.col("at"))).select("change", "id").distinct()


def before_window(found: DataFrame, around: int = 3) -> DataFrame:
    """``(change, path, old_path, first, last)``: the stretch of the old file that a reader of the change is shown."""
    first, last = F.greatest(F.lit(1), F.min("old_start") - around), F.max(F.col("old_start") + F.col("old_count")) + around
    return found.groupBy("change", "path").agg(F.min("old_path").alias("old_path"), first.alias("first"), last.alias("last"))
