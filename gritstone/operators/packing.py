"""Order-dependent packing of questions into requests and of long texts into overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens that a question costs beside its own text. Fixed value.
QUESTION_OVERHEAD = 32


def pack(sizes: list[int], room: int, most: int) -> list[int]:
    """The batch of each item: a batch closes where the next item would not fit or it holds ``most``; -1 for an item that never fits."""
    out, batch, used, held = [], 0, 0, 0
    for size in sizes:
        if size > room:
            out.append(-1)
            continue
        if held and (used + size > room or held >= most):
            batch, used, held = batch + 1, 0, 0
        used, held = used + size, held + 1
        out.append(batch)
    return out


def question_batches(questions: DataFrame, unit: str, order: str, tokens: str, state_tokens: str, limit: int, most: int = 64) -> DataFrame:
    """``(unit, order, batch)``: the questions of each unit packed greedily, in order, into requests of ``limit`` tokens that each
    repeat the unit's state. A unit's questions are a bounded list."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        pdf["batch"] = pack([int(t) + QUESTION_OVERHEAD for t in pdf[tokens]], limit - int(pdf[state_tokens].iloc[0]), most)
        return pdf[[unit, order, "batch"]]

    kinds = dict(questions.dtypes)
    return questions.select(unit, order, tokens, state_tokens).groupBy(unit).applyInPandas(run, f"{unit} {kinds[unit]}, {order} {kinds[order]}, batch int")


def chunk_text(text: str, max_tokens: int, overlap: int) -> list[tuple[int, int]]:
    """``(first, last)`` characters of pieces of at most ``max_tokens`` (three UTF-8 bytes each) that overlap by up to ``overlap`` tokens
    and leave no gap; a piece ends at a line end where one stands in its last quarter."""
    size = 3 * max_tokens
    spans, start = [], 0
    widths = None if text.isascii() else [len(c.encode()) for c in text]
    while start < len(text):
        if widths is None:
            end = min(len(text), start + size)
        else:
            end, used = start, 0
            while end < len(text) and used + widths[end] <= size:
                used += widths[end]
                end += 1
            end = max(end, start + 1)
        if end < len(text):
            cut = text.rfind("\n", start + (end - start) * 3 // 4, end)
            end = cut + 1 if cut > 0 else end
        spans.append((start, end))
        if end == len(text):
            break
        start = max(start + 1, end - min(3 * overlap, (end - start) // 2))
    return spans


def chunks(documents: DataFrame, key: str, text: str, max_tokens: int, overlap: int | None = None) -> DataFrame:
    """``(key, chunk, first, last, body)``: overlapping pieces of every text, in order; an empty or null text has none."""
    lap = min(256, max_tokens // 4) if overlap is None else overlap

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, n, a, b, t[a:b]) for k, t in zip(pdf[key], pdf[text]) if t for n, (a, b) in enumerate(chunk_text(t, max_tokens, lap))]
            if rows:
                yield pd.DataFrame(rows, columns=[key, "chunk", "first", "last", "body"])

    return documents.select(key, F.col(text)).mapInPandas(run, f"{key} {dict(documents.dtypes)[key]}, chunk int, first int, last int, body string")
