"""Mixing sources to target weights, by iterative proportional fitting.

Documents are counted in tokens and grouped into cells of source, language and topic. Raking scales the cells' token weights
until sources have their target shares while languages and topics keep the shares they have among these sources; no cell may
weigh more than its source's documents can be repeated. Each cell's weight over its tokens is how often one of its documents
is expected, and documents are drawn by these probabilities, systematically: along a fixed order of each source the sum of
expected tokens is rounded to whole documents, so shares are met to within a document per block.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gritstone.session import checkpointed

from .batches import slices

#: Where the public tokenizers' files lie, and which one counts.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How words are cut before the merges of that vocabulary, a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Documents of a source that are rounded together; the draw has one task per block, never one per source.
BLOCK_DOCUMENTS = 2_000


@cache
def _encoding(path: str):
    with open(path, "rb") as file:
        return _encoding_of(file.read())


@lru_cache(2)
def _encoding_of(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: pa.Array, encoding) -> np.ndarray:
    """The tokens of each text; null has none."""
    return np.array([len(encoding.encode_ordinary(t)) if t else 0 for t in texts.cast(pa.string()).to_pylist()], dtype=np.int64)


def with_tokens(rows: DataFrame, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``rows`` with ``tokens``, how many tokens its text has, in place of the text. The vocabulary goes to the workers."""
    with open(tokenizer, "rb") as file:
        vocabulary = rows.sparkSession.sparkContext.broadcast(file.read())
    kept = [f for f in rows.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding_of(vocabulary.value)
        for whole in batches:
            for batch in slices(whole, text):
                columns = [batch.column(f.name) for f in kept] + [pa.array(count_tokens(batch.column(text), encoding))]
                yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in kept), "tokens"])

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("tokens", T.LongType())]))


def canonical(name: Column) -> Column:
    """A source's or language's name without case, blanks at the ends, and hyphens or blanks for underscores; empty is null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(name)), r"[\s-]+", "_"), F.lit(""))


def _shares_of(dim: np.ndarray, members: int) -> np.ndarray:
    """Per cell its share in each member of a dimension, from each cell's member or as given."""
    return dim if dim.ndim == 2 else np.eye(members)[dim]


def rake(tokens: np.ndarray, dims: list[np.ndarray], targets: list[np.ndarray], cap: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weights of cells: proportional to ``tokens`` where they can, with the sums over each dimension's members at its targets,
    the first dimension's exactly and last; no weight above ``cap``. ``dims`` name each cell's member per dimension, or have
    each cell's share in every member where it may have several (generalised iterative scaling). Whether the sums were
    reached is for ``margins`` to tell."""
    shares = [_shares_of(d, len(t)) for d, t in zip(dims, targets)]
    own = dims[0]
    w = np.minimum(tokens.astype(float), cap)
    for _ in range(rounds):
        before = w.copy()
        for share, target in [*zip(shares[1:], targets[1:]), (shares[0], targets[0])]:
            now = share.T @ w
            factor = np.divide(target, now, out=np.ones(len(target)), where=now > 0)
            w = np.minimum(w * np.exp(share @ np.log(np.maximum(factor, 1e-300))), cap)
        if np.abs(w - before).max(initial=0) <= 1e-9 * max(1.0, w.sum()):
            break
    # what the caps took from a source goes to its cells with room
    for _ in range(rounds):
        now = np.bincount(own, weights=w, minlength=len(targets[0]))
        room = np.where(cap - w > 1e-9, w, 0)
        free = np.bincount(own, weights=room, minlength=len(targets[0]))
        short = targets[0] - now
        if (np.abs(short) <= 1e-9 * max(1.0, targets[0].sum())).all() or not (free[short > 1e-9] > 0).any():
            break
        w = np.clip(w + (np.divide(short, free, out=np.zeros_like(short), where=free > 0))[own] * room, 0, cap)
    return w


def largest_mix(available: dict[str, float], targets: dict[str, tuple[float, int]]) -> float:
    """Tokens of the largest mix that meets every share: the source that runs out first decides. Sources without a token
    cannot be met and are left out of it."""
    sizes = [available[s] * repeats / share for s, (share, repeats) in targets.items() if share > 0 and repeats > 0 and available.get(s, 0) > 0]
    return min(sizes, default=0.0)


COLUMNS = "doc_id long, source string, lang string, topics array<string>, tokens long, copies int"
MARGINS = "dimension string, member string, target_share double, planned_share double"


def mix_documents(documents: DataFrame, targets: DataFrame, topics: DataFrame | None = None, total_tokens: float | None = None, tokenizer: str = TOKENIZER, block_documents: int = BLOCK_DOCUMENTS) -> DataFrame:
    """``(doc_id, source, lang, topics, tokens, copies)``: how often each document goes into the mix, those that do not left out.

    ``documents`` has ``doc_id``, ``text``, ``source`` and ``lang``, ``targets`` has ``source``, ``target_share`` and ``max_repeats``,
    ``topics`` optionally ``doc_id`` and ``topic``; a document with several topics counts in equal parts for each. ``total_tokens``
    is the size of the mix; without it, or where it is more than that, the mix is the largest that meets all shares. Sources,
    however spelt, are those of ``targets``; documents of others are not used, nor are targets without documents (the others
    keep their proportions).

    Defined cases: a null id, a null or empty text and a null or unknown source are not used; a repeated id counts once; null
    languages and topics are members of their own; shares need not sum to 1; shares or repeats that are null or not positive
    are no targets; an empty table gives no rows.
    """
    return mix_with_margins(documents, targets, topics, total_tokens, tokenizer, block_documents)[0]


def mix_with_margins(documents: DataFrame, targets: DataFrame, topics: DataFrame | None = None, total_tokens: float | None = None, tokenizer: str = TOKENIZER, block_documents: int = BLOCK_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """The mix, and ``(dimension, member, target_share, planned_share)`` of its sources, languages and topics: the share each should
    have, and the one that the weights found give it. Where the two differ, caps or the number of rounds stood against it."""
    spark = documents.sparkSession
    nothing = spark.createDataFrame([], COLUMNS), spark.createDataFrame([], MARGINS)
    wanted = {}
    for r in targets.select(canonical(F.col("source")).alias("s"), F.col("target_share").alias("t"), F.col("max_repeats").alias("m")).collect():
        if r.s and r.t and r.t > 0 and r.m and r.m > 0:
            wanted[r.s] = (float(r.t), int(r.m))
    if not wanted:
        return nothing
    rows = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), canonical(F.col("source")).alias("source"), F.coalesce(F.substring(canonical(F.col("lang")), 1, 2), F.lit("?")).alias("lang"), "text")
    rows = with_tokens(rows.where(F.col("source").isin(*wanted)), "text", tokenizer).where("tokens > 0")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("source", "lang", "tokens")).alias("r")).select("doc_id", "r.*")
    if topics is not None:
        several = topics.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_set("topic")).alias("topics"))
        rows = rows.join(several, "doc_id", "left")
    else:
        rows = rows.withColumn("topics", F.lit(None).cast("array<string>"))
    rows = checkpointed(rows.withColumn("topics", F.when(F.size("topics") > 0, F.col("topics")).otherwise(F.array(F.lit("?")))))
    # cells are as many as sources times languages times sets of topics, whatever the documents
    cells = rows.groupBy("source", "lang", "topics").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")).toArrow().to_pandas()
    if cells.empty:
        return nothing
    cells["topics"] = cells.topics.map(tuple)
    cells = cells.sort_values(["source", "lang", "topics"], ignore_index=True)
    tokens = cells.tokens.to_numpy(float)
    available = cells.groupby("source").tokens.sum().astype(float).to_dict()
    met = {s: t for s, t in wanted.items() if available.get(s, 0) > 0}
    scale = sum(t for t, _ in met.values())
    met = {s: (t / scale, m) for s, (t, m) in met.items()}
    size = largest_mix(available, met)
    size = size if total_tokens is None else min(size, float(total_tokens))
    dims, names = [], []
    for dim in ("source", "lang"):
        code, members = pd.factorize(cells[dim])
        dims.append(code)
        names.append(list(members))
    names.append(sorted({t for several in cells.topics for t in several}))
    dims.append(np.array([[several.count(t) / len(several) for t in names[2]] for several in cells.topics]))
    have = [_shares_of(d, len(n)).T @ tokens for d, n in zip(dims, names)]
    aims = [np.array([met[n][0] for n in names[0]]) * size, *(h / h.sum() * size for h in have[1:])]
    most = cells.source.map(lambda s: met[s][1])
    weights = rake(tokens, dims, aims, tokens * most.to_numpy(float))
    planned = [_shares_of(d, len(n)).T @ weights for d, n in zip(dims, names)]
    margins = [(dim, n, float(a / size), float(p / max(weights.sum(), 1e-9))) for dim, ns, aim, plan in zip(("source", "lang", "topic"), names, aims, planned) for n, a, p in zip(ns, aim, plan)]
    plan = spark.createDataFrame(pd.DataFrame({"source": cells.source, "lang": cells.lang, "topics": cells.topics.map(list), "expected": weights / tokens, "most": most.astype("int32")}))
    blocks = cells.groupby("source").documents.sum().map(lambda n: int(n // block_documents) + 1).to_dict()
    of = F.create_map(*(x for s, n in blocks.items() for x in (F.lit(s), F.lit(n))))
    place = F.xxhash64("doc_id")
    rows = rows.join(F.broadcast(plan), ["source", "lang", "topics"]).withColumn("block", F.pmod(place, of[F.col("source")]))
    # rounding the running sum keeps every stretch of the order at its expected size; documents of like size lie together,
    # so that what is rounded up here is rounded down near it
    order = Window.partitionBy("source", "block").orderBy(F.desc("expected"), "tokens", place, "doc_id")
    upto = F.sum("expected").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    start = F.pmod(F.xxhash64("source", "block"), F.lit(1000)) / 1000.0
    rows = rows.withColumn("upto", upto + start)
    copies = (F.floor(F.col("upto") + 1e-9) - F.floor(F.col("upto") - F.col("expected") + 1e-9)).cast("int")
    mix = rows.withColumn("copies", F.least(copies, F.col("most"))).where("copies > 0").select("doc_id", "source", "lang", "topics", "tokens", "copies")
    return mix, spark.createDataFrame(margins, MARGINS)


def mix_report(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target_share, reached_share, documents, tokens, most_copies)`` for every target; what has no document reached 0."""
    named = targets.select(canonical(F.col("source")).alias("source"), "target_share").where("source IS NOT NULL")
    by = mix.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    rows = named.join(F.broadcast(by), "source", "left").fillna(0, ["documents", "tokens", "most_copies"])
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    return rows.withColumn("reached_share", F.coalesce(F.try_divide(F.col("tokens").cast("double"), total), F.lit(0.0))).select("source", "target_share", "reached_share", "documents", "tokens", "most_copies")


def margin_report(mix: DataFrame, margins: DataFrame) -> DataFrame:
    """``margins`` with what the mix's documents reach: ``reached_share``, ``documents``, ``tokens``. A document with several topics
    counts in equal parts for each; ``documents`` counts it once for each."""
    part = F.col("tokens") * F.col("copies")
    kinds = F.array(
        F.struct(F.lit("source").alias("dimension"), F.array("source").alias("members")), F.struct(F.lit("lang").alias("dimension"), F.array("lang").alias("members")), F.struct(F.lit("topic").alias("dimension"), F.col("topics").alias("members"))
    )
    rows = mix.select(part.alias("size"), F.explode(kinds).alias("k")).select("size", "k.dimension", F.size("k.members").alias("n"), F.explode("k.members").alias("member"))
    by = rows.groupBy("dimension", "member").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("size") / F.col("n")).alias("tokens"))
    out = margins.join(F.broadcast(by), ["dimension", "member"], "left").fillna(0, ["documents", "tokens"])
    return out.withColumn("reached_share", F.coalesce(F.try_divide("tokens", F.sum("tokens").over(Window.partitionBy("dimension"))), F.lit(0.0)))
