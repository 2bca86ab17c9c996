"""Evaluation texts leaking into training text, by pigeonhole edit matching.

Every window of ``min_words`` successive words of an item is split into ``errors + 1`` pieces. A document passage within
``errors`` edits (whole words inserted, deleted or replaced) of the window holds at least one piece unchanged, so exact hits
of pieces find every candidate. Windows that stand unchanged are told by runs of hits; every other one is verified with
Myers' bit-parallel edit distance over words, where enough of its words stand near the hit at all. Items are a stated query
set: they are matched in blocks of bounded size, each against all documents, without a shuffle of the texts. A block's index
is built once, as arrays; texts are cut into words once, thousands at a time.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.session import checkpointed

from .batches import slices

#: Words of items that one block may hold; more items make more blocks, matched one after the other against all documents.
BLOCK_WORDS = 2_000_000
#: Windows that are compared at once.
TOGETHER = 20_000

_WORD = re.compile(r"[^\W_]+")
_FORMAT = {c: None for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf"}

RESULT = "doc_id long, item_id long, distance int, longest_run int, matched_words int"
CODED = "doc_id long, words array<long>"


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits without letter case; invisible format characters do not count."""
    if not text:
        return []
    if not text.isascii():
        text = text.translate(_FORMAT)
    return [w.casefold() for w in _WORD.findall(text)]


def myers(pattern: Sequence, text: Sequence) -> int:
    """The least edit distance between ``pattern`` and any stretch of ``text`` (Myers 1999), on sequences of hashable symbols."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict = {}
    for i, symbol in enumerate(pattern):
        peq[symbol] = peq.get(symbol, 0) | 1 << i
    every, last = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = every, 0, m
    best = m
    for symbol in text:
        eq = peq.get(symbol, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (every & ~(horizontal | plus))
        down = plus & horizontal
        if up & last:
            score += 1
        elif down & last:
            score -= 1
        up = up << 1 & every
        down = down << 1 & every
        plus = down | (every & ~(vertical | up))
        minus = up & vertical
        best = min(best, score)
    return best


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) - 2**63


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts, as ``words_of`` has them, by 64-bit hashes, and the end of each text's in them."""
    texts = texts.cast(pa.string()).fill_null("")
    texts = pc.replace_substring_regex(pc.replace_substring_regex(texts, pattern=r"\p{Cf}", replacement=""), pattern=r"[^\p{L}\p{N}]+", replacement=" ")
    lists = pc.split_pattern(pc.utf8_trim(texts, " "), " ")
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
    words = lists.flatten().dictionary_encode()
    hashes = np.array([_hash(w.casefold()) if w else 0 for w in words.dictionary.to_pylist()], dtype=np.int64)
    flat = hashes[words.indices.to_numpy()] if len(hashes) else np.zeros(0, dtype=np.int64)
    # a text without words is one empty word
    told = flat != 0
    return flat[told], np.cumsum(told)[ends - 1] if len(ends) else ends


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ``counts`` rows each: the number of the owner, and the number of the row among its owner's."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


class ItemIndex:
    """The pieces of one block of items, as arrays: ``words`` of all items, ``ends`` of each, and per different piece, in the order
    of ``hashes``, the places where it stands."""

    def __init__(self, items: Sequence[tuple[int, list[str]]], min_words: int, errors: int):
        self.min_words, self.errors = min_words, errors
        self.piece = min_words // (errors + 1)
        items = [(k, w) for k, w in items if len(w) >= min_words]
        self.ids = np.array([k for k, _ in items], dtype=np.int64)
        sizes = np.array([len(w) for _, w in items], dtype=np.int64)
        self.ends = np.cumsum(sizes)
        self.words = np.array([_hash(w) for _, words in items for w in words], dtype=np.int64)
        self.item = np.repeat(np.arange(len(items)), sizes)
        self.weights = np.random.default_rng(7).integers(1, 2**62, self.piece, dtype=np.int64) | 1
        rolled, at = self.rolled(self.words, self.item)
        order = np.lexsort((at, rolled))
        self.hashes, first = np.unique(rolled[order], return_index=True)
        self.places, self.first = at[order], np.r_[first, len(order)].astype(np.int64)
        # a bit per hash's low bits says quickly that a piece is no item's
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[self.hashes & (len(self.bits) - 1)] = True

    def rolled(self, words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the stretches as long as a piece that lie within one owner's words, and their places."""
        n = max(0, len(words) - self.piece + 1)
        out = np.zeros(n, dtype=np.int64)
        for i, weight in enumerate(self.weights):
            out += words[i : i + n] * weight
        at = np.flatnonzero(owner[:n] == owner[self.piece - 1 : self.piece - 1 + n])
        return out[at], at

    def hits(self, words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``words`` and in the items where the same piece stands."""
        rolled, at = self.rolled(words, owner)
        some = self.bits[rolled & (len(self.bits) - 1)]
        rolled, at = rolled[some], at[some]
        if not len(at) or not len(self.hashes):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.hashes, rolled), len(self.hashes) - 1)
        same = self.hashes[k] == rolled
        k, at = k[same], at[same]
        owner, nth = _spread(self.first[k + 1] - self.first[k])
        p, o = at[owner], self.places[self.first[k][owner] + nth]
        exact = np.ones(len(p), dtype=bool)
        for i in range(self.piece):
            exact &= words[p + i] == self.words[o + i]
        return p[exact], o[exact]

    def match(self, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """``(document, item, distance, longest run, matched words)`` of every item that a document holds in part."""
        owner = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
        p, o = self.hits(words, owner)
        none = np.zeros(0, dtype=np.int64)
        if not len(p):
            return none, none, none, none, none
        starts = np.r_[0, ends[:-1]]
        # runs of hits that follow each other in the document and in the item
        order = np.lexsort((p, p - o))
        p, o = p[order], o[order]
        doc, item = owner[p], self.item[o]
        new = np.r_[True, (np.diff(p - o) != 0) | (np.diff(p) != 1) | (np.diff(doc) != 0) | (np.diff(item) != 0)]
        run = np.cumsum(new) - 1
        length = np.bincount(run) + self.piece - 1
        begin = o[new]
        pair = doc * len(self.ids) + item
        # every window of the item in which the hit is one of the pieces
        windows = []
        for k in range(self.errors + 1):
            start = o - k * self.piece
            first = np.r_[0, self.ends[:-1]][item]
            inside = (start >= first) & (start + self.min_words <= self.ends[item])
            windows.append(np.stack([pair, start, p - o, run])[:, inside])
        pairs, start, shift, of = np.concatenate(windows, axis=1)
        whole = (start >= begin[of]) & (start + self.min_words <= begin[of] + length[of])
        # a window that stands unchanged needs no other proof, whatever else meets it
        known = np.unique(np.stack([pairs[whole], start[whole]]), axis=1)
        rest = np.unique(np.stack([pairs[~whole], start[~whole], shift[~whole]]), axis=1)
        distance = self._verify(words, starts, ends, *rest)
        near = distance <= self.errors
        pairs, start = np.r_[known[0], rest[0][near]], np.r_[known[1], rest[1][near]]
        distance = np.r_[np.zeros(known.shape[1], dtype=np.int64), distance[near]]
        order = np.lexsort((start, pairs))
        pairs, start, distance = pairs[order], start[order], distance[order]
        if not len(pairs):
            return none, none, none, none, none
        edge = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
        ahead = np.r_[np.diff(start), 0]
        ahead[np.r_[edge[1:] - 1, len(start) - 1]] = self.min_words
        found = pairs[edge]
        longest = np.zeros(len(found), dtype=np.int64)
        at = np.minimum(np.searchsorted(found, pair[new]), len(found) - 1)
        told = found[at] == pair[new]
        np.maximum.at(longest, at[told], length[told])
        return found // len(self.ids), self.ids[found % len(self.ids)], np.minimum.reduceat(distance, edge), longest, np.add.reduceat(np.minimum(ahead, self.min_words), edge)

    def _verify(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, pairs: np.ndarray, start: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """The distance of each window to the stretch of its document about the hit; where fewer of its words stand there than
        must, one more than is allowed."""
        out = np.full(len(pairs), self.errors + 1, dtype=np.int64)
        doc = pairs // len(self.ids)
        lo = np.maximum(starts[doc], start + shift - self.errors)
        hi = np.minimum(ends[doc], start + shift + self.min_words + self.errors)
        wide = self.min_words + 2 * self.errors
        for a in range(0, len(pairs), TOGETHER):
            part = slice(a, a + TOGETHER)
            pattern = self.words[start[part, None] + np.arange(self.min_words)]
            place = lo[part, None] + np.arange(wide)
            text = np.where(place < hi[part, None], words[np.minimum(place, len(words) - 1)], 0)
            present = (pattern[:, :, None] == text[:, None, :]).any(axis=2).sum(axis=1)
            for i in np.flatnonzero(present >= self.min_words - self.errors):
                out[a + i] = myers(pattern[i].tolist(), words[lo[a + i] : hi[a + i]].tolist())
        return out


def _rows(index: ItemIndex, ids: np.ndarray, words: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    doc, item, distance, longest, matched = index.match(words, ends)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[doc], pa.int64()), pa.array(item, pa.int64()), pa.array(distance, pa.int32()), pa.array(longest, pa.int32()), pa.array(matched, pa.int32())], names=["doc_id", "item_id", "distance", "longest_run", "matched_words"]
    )


def _matcher(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                yield _rows(index.value, batch.column("doc_id").to_numpy(), *coded_words(batch.column("text")))

    return run


def _coder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            words, ends = coded_words(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(words))], names=["doc_id", "words"])


def _coded_matcher(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
            yield _rows(index.value, batch.column("doc_id").to_numpy(), lists.flatten().to_numpy(), ends)

    return run


def _blocks(items: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[tuple[int, list[str]]]]:
    """The items in blocks of about ``block_words`` words; the driver holds one block at a time."""
    held: list[tuple[int, list[str]]] = []
    size = 0
    for row in items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct().toLocalIterator():
        words = words_of(row.t)
        held.append((row.i, words))
        size += len(words)
        if size >= block_words:
            yield held
            held, size = [], 0
    if held:
        yield held


def leaked_items(
    documents: DataFrame, items: DataFrame, min_words: int = 10, errors: int = 1, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", block_words: int = BLOCK_WORDS
) -> DataFrame:
    """Every (document, item) with a passage of ``min_words`` words of the item within ``errors`` word edits.

    ``(doc_id, item_id, distance, longest_run, matched_words)``: the least distance of such a window, the longest run of
    successive words in common, and how many of the item's words lie in matching windows. A passage kept word for word has
    distance 0 and a run of at least ``min_words``.

    One block of items is broadcast at a time. Where there are several, the documents' words are written once, as hashes, and
    each block's matches before the next block is sent.

    Defined cases: null ids and null or empty texts match nothing; items shorter than ``min_words`` match nothing; repeated
    rows give one pair; an empty table on either side gives no rows.
    """
    if min_words // (errors + 1) < 1:
        raise ValueError("more errors than words")
    spark = documents.sparkSession
    texts = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    blocks = _blocks(items, item_id, text, block_words)
    ahead = next(blocks, None)
    if ahead is None:
        return spark.createDataFrame([], RESULT)
    following = next(blocks, None)
    share = spark.sparkContext.broadcast
    if following is None:
        found = texts.mapInArrow(_matcher(share(ItemIndex(ahead, min_words, errors))), RESULT)
    else:
        coded = checkpointed(texts.mapInArrow(_coder, CODED))
        parts = []
        while ahead is not None:
            index = share(ItemIndex(ahead, min_words, errors))
            parts.append(checkpointed(coded.mapInArrow(_coded_matcher(index), RESULT)))
            index.unpersist()
            ahead, following = following, next(blocks, None)
        found = reduce(DataFrame.unionByName, parts)
    return found.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.max("longest_run").alias("longest_run"), F.max("matched_words").alias("matched_words"))
