from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from gritstone.llm import mixing
from tests.conftest import data

pytestmark = pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no tokenizer here")
DOCS = "doc_id long, text string, source string, lang string, tokens int"


def frames(spark, docs, targets):
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_rake_meets_margins():
    rng = np.random.default_rng(1)
    dims = [np.repeat([0, 1, 2], 4), np.tile([0, 1, 0, 1], 3)]
    tokens = rng.integers(50, 500, 12).astype(float)
    targets = [np.array([200.0, 300.0, 500.0]), np.array([400.0, 600.0])]
    w = mixing.rake(tokens, dims, targets, np.full(12, 1e9))
    for d, t in zip(dims, targets):
        assert np.allclose(np.bincount(d, weights=w), t)
    capped = mixing.rake(tokens, dims, targets, np.full(12, 180.0))
    assert capped.max() <= 180 + 1e-9 and np.allclose(np.bincount(dims[0], weights=capped), targets[0])


def test_shares_and_caps(spark):
    docs = [(i, f"word number {i} " * (1 + i % 7), ["Big Source", "big_source", "small"][i % 3 if i % 10 == 0 else i % 2], ["en", "EN-x", "de", None][i % 4], 0) for i in range(3000)]
    d, t = frames(spark, docs, [("big_source", 0.7, 1), ("small", 0.3, 4), ("missing", 0.2, 2), (None, 0.5, 1), ("zero", 0.0, 1)])
    mix = mixing.mix_documents(d, t, block_documents=500)
    rows = mix.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and all(1 <= r.copies <= (4 if r.source == "small" else 1) for r in rows)
    report = {r.source: r.reached_share for r in mixing.mix_report(mix, t).collect()}
    assert abs(report["big_source"] - 0.7) < 0.01 and abs(report["small"] - 0.3) < 0.01 and report["missing"] == 0
    assert {(r.doc_id, r.copies) for r in mixing.mix_documents(d, t, block_documents=500).collect()} == {(r.doc_id, r.copies) for r in rows}


def test_a_small_source_is_repeated_to_its_cap_and_total_tokens_bound(spark):
    docs = [(i, "some plain words here", "a" if i else "b", "en", 0) for i in range(101)]
    d, t = frames(spark, docs, [("a", 0.9, 1), ("b", 0.1, 3)])
    got = {r.source: r.n for r in mixing.mix_documents(d, t).groupBy("source").agg({"copies": "sum"}).withColumnRenamed("sum(copies)", "n").collect()}
    assert got == {"a": 27, "b": 3}
    assert sum(r.tokens * r.copies for r in mixing.mix_documents(d, t, total_tokens=60).collect()) <= 64


def test_dirty_and_empty(spark):
    docs = [(None, "x", "a", "en", 0), (1, None, "a", "en", 0), (2, "", "a", "en", 0), (3, "x y", None, "en", 0), (4, "x y", "other", "en", 0), (5, "x y", "a", None, 0), (5, "x y", "a", None, 0), (6, "<|endoftext|>", "a", "en", 0), (7, "w " * 50_000, "a", "en", 0)]
    d, t = frames(spark, docs, [("a", 1.0, 1)])
    assert {r.doc_id for r in mixing.mix_documents(d, t).collect()} == {5, 6, 7}
    assert mixing.mix_documents(d.limit(0), t).collect() == [] and mixing.mix_documents(d, t.limit(0)).collect() == []


def test_tokens_are_those_of_the_vocabulary():
    e = mixing._encoding(mixing.TOKENIZER)
    for text in ("Hello world's end", "äöü — ​", "  spaces\n\n", "x" * 1000):
        assert e.decode(e.encode_ordinary(text)) == text


def test_counted_in_columns_as_by_the_encoding():
    e = mixing._encoding(mixing.TOKENIZER)
    texts = [None, "", " ", "it's 'the  end'\n\n  x\t\ty \r\n", "don't we'll THEY'RE", "a b", "1234 x12 §§ ¿qué?", "tab\x01inside", "日本語 text", "naïve café — dash", "   ", "x\n", "'s's '", "a" * 3000]
    texts += pq.read_table(f"{data('sf0.01')}/documents.parquet", columns=["text"])["text"].to_pylist()
    rng = np.random.default_rng(3)
    texts += ["".join(rng.choice(list("ab'sdtl 19.,\n\t\r é€_"), 60)) for _ in range(2000)]
    assert mixing.count_tokens(pa.array(texts, pa.string()), e).tolist() == [len(e.encode_ordinary(t or "")) for t in texts]


def test_documents_with_two_topics_count_half_for_each(spark):
    docs = [(i, f"word number {i} " * (1 + i % 5), "ab"[i % 2], "en", 0) for i in range(2000)]
    d, t = frames(spark, docs, [("a", 0.5, 2), ("b", 0.5, 2)])
    topics = spark.createDataFrame([(i, s) for i in range(2000) for s in (["x"], ["x", "y"], ["z", "y"])[i % 3]] + [(7, None)], "doc_id long, topic string")
    mix, margins = mixing.mix_with_margins(d, t, topics, block_documents=500)
    got = {(r.dimension, r.member): r for r in mixing.margin_report(mix, margins).collect()}
    assert {k for k in got} == {("source", "a"), ("source", "b"), ("lang", "en"), ("topic", "x"), ("topic", "y"), ("topic", "z")}
    for r in got.values():
        assert abs(r.planned_share - r.target_share) < 1e-3 and abs(r.reached_share - r.target_share) < 0.01
    assert abs(got["topic", "x"].target_share - 0.5) < 0.02 and abs(got["topic", "z"].target_share - 1 / 6) < 0.02
