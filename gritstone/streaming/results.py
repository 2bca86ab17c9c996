"""Results as streams: each issue once, files announced when they are complete, long runs of failures."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_results(results: DataFrame, time: str = "at", late: str = "1 hour") -> DataFrame:
    """Each ``(id, kind)`` once, by its first arrival within ``late``; state older than that is dropped."""
    return results.withWatermark(time, late).dropDuplicatesWithinWatermark(["id", "kind"])


def completed(results: DataFrame) -> DataFrame:
    """``(path, results)`` of files for which as many results came as their rows say are ``expected``; emitted once."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (seen, told) = state.get if state.exists else (0, False)
        expected = 0
        for pdf in batches:
            seen += len(pdf)
            expected = max(expected, int(pdf.expected.max()))
        if expected and seen >= expected and not told:
            told = True
            yield pd.DataFrame({"path": [key[0]], "results": [seen]})
        state.update((seen, told))

    return results.select("path", "expected").groupBy("path").applyInPandasWithState(step, "path string, results long", "seen long, told boolean", "append", GroupStateTimeout.NoTimeout)


def failure_runs(outcomes: DataFrame, limit: int) -> DataFrame:
    """``(worker, failures)`` each time ``limit`` outcomes of a worker failed one after another; the count starts anew then."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (run,) = state.get if state.exists else (0,)
        hits = 0
        rows = pd.concat(list(batches)).sort_values("seq")
        for failed in rows.failed:
            run = run + 1 if failed else 0
            if run >= limit:
                hits, run = hits + 1, 0
        state.update((run,))
        if hits:
            yield pd.DataFrame({"worker": [key[0]] * hits, "failures": [limit] * hits})

    return outcomes.select("worker", "seq", "failed").groupBy("worker").applyInPandasWithState(step, "worker string, failures int", "run int", "append", GroupStateTimeout.NoTimeout)


def write_once(results: DataFrame, path: str, checkpoint: str):
    """A query that appends micro-batches under their number, so that a batch written again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
