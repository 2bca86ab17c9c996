"""Source files that do not parse: packrat grammars over every file, whatever earlier runs said of it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.functions import lexing

from . import grammars

VERDICT = "file_id long, repo string, language string, received_at timestamp, valid boolean, cause string, line int, message string"


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in VERDICT.split(", ")]
    for pdf in batches:
        rows = []
        for file_id, repo, path, language, source, at in zip(pdf.file_id, pdf.repo, pdf.path, pdf.language, pdf.source, pdf.received_at):
            name = lexing.language_of(language, path)
            if name is None or source is None:
                rows.append((file_id, repo, name, at, None, None, None, None))
                continue
            try:
                failure = grammars.check_source(source, name)
            except RecursionError:
                rows.append((file_id, repo, name, at, None, "too deep", None, None))
                continue
            rows.append((file_id, repo, name, at, failure is None, *(failure or (None, None, None))))
        out = pd.DataFrame(rows, columns=names)
        out["line"] = out["line"].astype("Int32")
        yield out


def syntax_verdicts(files: DataFrame) -> DataFrame:
    """``(file_id, repo, language, valid, cause, line, message)`` for every file of ``files`` (the columns of source_analysis).

    ``cause`` is one of ``merge conflict``, ``truncated``, ``unknown character`` and ``unexpected token``; ``line`` is that of the
    furthest failure and ``message`` what stands there and what could have. ``language`` is taken from its name however spelt,
    else from the path's extension.

    Defined cases: a null id is no file; a null source or a language without a grammar gives a null ``valid``, as does a text that
    nests deeper than can be judged, with the cause ``too deep``; an empty source
    is valid; of a file delivered more than once the latest ``received_at`` counts (null is the oldest); an empty table gives
    no rows.
    """
    rows = files.where("file_id IS NOT NULL").select(F.col("file_id").cast("long").alias("file_id"), "repo", "path", "language", "source", "received_at")
    judged = rows.mapInPandas(_judge, VERDICT)
    row = F.struct("received_at", "repo", "language", "valid", "cause", "line", "message")
    return judged.groupBy("file_id").agg(F.max(row).alias("r")).select("file_id", *(F.col(f"r.{c}").alias(c) for c in ("repo", "language", "valid", "cause", "line", "message")))


def syntax_rates(verdicts: DataFrame) -> DataFrame:
    """``(repo, language, files, broken, share)`` over the files that could be judged."""
    judged = verdicts.where("valid IS NOT NULL")
    broken = F.count_if(~F.col("valid"))
    return judged.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("files"), broken.alias("broken"), (broken / F.count(F.lit(1))).alias("share"))
