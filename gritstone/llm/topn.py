"""Top N items within every group, by partition lower bounds.

The N-th best score that one partition holds for a group is a lower bound on the N-th best of the whole group: N items at
least as good exist. Each task streams its rows once, drops what is not among its own N best of a group, and marks the
N-th. The tightest bound of each group is joined back, rows beyond it are dropped, and the survivors are ranked. A group
of any size thus sends at most N rows per task to the one that ranks it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows a task holds before it passes on the survivors it has and starts anew: the bound of a part of a partition is valid too.
STATE_ROWS = 400_000


def _codes(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """One exact integer per combination of keys within this table."""
    out = np.zeros(table.num_rows, dtype=np.int64)
    for k in keys:
        column = table.column(k).combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
        encoded = column.dictionary_encode() if not pa.types.is_dictionary(column.type) else column
        width = len(encoded.dictionary) + 1
        out = out * width + encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if len(keys) > 1:
            out = np.unique(out, return_inverse=True)[1].astype(np.int64)
    return out


def _survivors(table: pa.Table, keys: Sequence[str], scores: Sequence[str], tie: str, n: int, mark: str) -> pa.Table:
    group = _codes(table, keys)
    order = np.lexsort([table.column(c).to_numpy() for c in (tie, *reversed(scores))] + [group])
    sorted_group = group[order]
    first = np.flatnonzero(np.r_[True, sorted_group[1:] != sorted_group[:-1]]) if len(order) else np.array([], dtype=int)
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    kept = place < n
    out = table.take(pa.array(order[kept]))
    return out.set_column(out.schema.get_field_index(mark), mark, pa.array(place[kept] == n - 1))


def _local(keys: Sequence[str], scores: Sequence[str], tie: str, n: int, mark: str, state_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= state_rows:
                held = [_survivors(pa.concat_tables(held), keys, scores, tie, n, mark)]
                rows = held[0].num_rows
                if rows > state_rows // 2:
                    yield from held[0].to_batches(max_chunksize=50_000)
                    held, rows = [], 0
        if rows:
            yield from _survivors(pa.concat_tables(held), keys, scores, tie, n, mark).to_batches(max_chunksize=50_000)

    return run


def top_n(df: DataFrame, keys: Sequence[str], scores: Sequence[Column], tie: str, n: int, rank: str = "rank_no", state_rows: int = STATE_ROWS) -> DataFrame:
    """The ``n`` best rows of every group of ``keys``, with their ``rank`` from 1 (a column of that name is replaced).

    ``scores`` are numeric, ascending, the most important first; a null or NaN score comes last. ``tie`` names an integral
    column that decides among equal scores, the lower first, null last.

    Defined cases: rows with a null in a key form no group and are dropped; rows repeated in whole each take a place;
    ``n`` below 1 and an empty table give no rows; other columns pass through, whatever their names.
    """
    out_columns = [c for c in df.columns if c != rank]
    if n < 1:
        return df.select(*out_columns).limit(0).withColumn(rank, F.lit(None).cast("int"))
    names = [f"__score_{i}" for i in range(len(scores))]
    # +infinity is the place of a missing score, so that bounds compare as plain doubles
    missing = F.lit(float("inf"))
    ready = (
        df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
        .withColumns({s: F.nanvl(F.coalesce(c.cast("double"), missing), missing) for s, c in zip(names, scores)})
        .select(*out_columns, *names, F.coalesce(F.col(tie).cast("long"), F.lit(2**63 - 1)).alias("__tie"), F.lit(False).alias("__nth"))
    )
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in ready.schema])
    local = ready.mapInArrow(_local(list(keys), names, "__tie", n, "__nth", state_rows), schema)
    place = F.struct(*names, "__tie")
    bounds = local.where("__nth").groupBy(*keys).agg(F.min(place).alias("__bound"))
    within = local.join(bounds, list(keys), "left").where(F.col("__bound").isNull() | (place <= F.col("__bound")))
    order = Window.partitionBy(*keys).orderBy(*names, "__tie")
    return within.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= n).select(*out_columns, rank)


def severity_number(severity: Column) -> Column:
    """``P1 (0.8)`` is 0.8, a bare ``P1`` is 1, a plain number itself; anything else is null. Lower is worse."""
    inside = F.regexp_extract(severity, r"\(\s*([0-9]+(?:\.[0-9]+)?)\s*\)", 1)
    bare = F.regexp_extract(severity, r"(?i)^\s*p?\s*([0-9]+(?:\.[0-9]+)?)\s*$", 1)
    return F.coalesce(F.nullif(inside, F.lit("")).try_cast("double"), F.nullif(bare, F.lit("")).try_cast("double"))


def confidence_number(confidence: Column) -> Column:
    """``81%``, ``81 %`` and ``0.81`` are 0.81; anything else is null."""
    number = F.nullif(F.regexp_extract(confidence, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*%?\s*$", 1), F.lit("")).try_cast("double")
    return F.when(confidence.rlike("%") | (number > 1), number / 100).otherwise(number)


def latest_findings(findings: DataFrame) -> DataFrame:
    """One row per ``finding_id``: the latest delivered, narrowed to what ranking needs.

    Among deliveries of the same time the one that would rank first counts, so that a rerun gives the same row. A null
    ``received_at`` is older than any other; a null ``finding_id`` is no finding.
    """
    s, c = severity_number(F.col("severity")), confidence_number(F.col("confidence"))
    row = F.struct(F.col("received_at"), (-s).alias("s"), c.alias("c"), F.col("repo"), F.col("method"))
    last = findings.where("finding_id IS NOT NULL").select("finding_id", row.alias("r")).groupBy("finding_id").agg(F.max("r").alias("r"))
    return last.select("finding_id", "r.repo", "r.method", (-F.col("r.s")).alias("severity_no"), F.col("r.c").alias("confidence_no"))


def top_findings(findings: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` findings of every (repo, method) that come first by severity, confidence and ``finding_id``.

    Findings without a method or repository take no part.
    """
    rows = latest_findings(findings).where("method IS NOT NULL AND repo IS NOT NULL")
    return top_n(rows, ["repo", "method"], [F.col("severity_no"), -F.col("confidence_no")], "finding_id", n)
