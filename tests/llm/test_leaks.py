from __future__ import annotations

import random

import pyarrow as pa
import pytest

from gritstone.llm import leaks


def edit_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers_against_dynamic_programming():
    rng = random.Random(3)
    for _ in range(300):
        p, t = [rng.choice("abc") for _ in range(rng.randint(1, 12))], [rng.choice("abc") for _ in range(rng.randint(0, 20))]
        assert leaks.myers(p, t) == edit_distance(p, t)


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def found(spark, docs, items=((1, ITEM),), **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    i = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in leaks.leaked_items(d, i, **kw).collect()}


def test_cases(spark):
    ten = " ".join(ITEM.split()[:10])
    docs = [
        (1, f"noise {ten.upper().replace(' ', ' -- ')} noise", 0), (2, " ".join(ITEM.split()[:9]), 0), (3, ten.replace("zeta", "ze​ta"), 0), (4, ten.replace("zeta", "omega"), 0),
        (5, None, 0), (6, "", 0), (None, ten, 0), (7, ten.replace("alpha beta", "alpha_beta"), 0), (7, "again " + ten, 0), (8, "x " * 30000 + ten, 0), (9, ten.replace("alpha beta", "alphabeta"), 0),
    ]
    got = found(spark, docs, [(1, ITEM), (1, ITEM), (2, "too short"), (None, ITEM), (3, None)])
    assert {k[0] for k, r in got.items() if r.longest_run >= 10} == {1, 3, 7, 8}
    assert got[(4, 1)].distance == 1 and (2, 1) in got and got[(2, 1)].longest_run == 9


def test_random_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(rng.choice(words) for _ in range(15))) for i in range(6)]
    docs = []
    for d in range(80):
        text = [rng.choice(words) for _ in range(25)]
        if d % 2:
            w = rng.choice(items)[1].split()
            a = rng.randint(0, 5)
            text[5:5] = w[a : a + rng.randint(6, 12)]
        docs.append((d, " ".join(text), 0))
    runs = lambda t: {tuple(t[i : i + 10]) for i in range(len(t) - 9)}
    truth = {(d, i) for d, t, _ in docs for i, x in items if runs(t.split()) & runs(x.split())}
    got = found(spark, docs, items, block_words=20)
    assert {k for k, r in got.items() if r.longest_run >= 10} == truth and truth
    near = {(d, i) for d, t, _ in docs for i, x in items if any(edit_distance(w, t.split()) <= 1 for w in runs(x.split()))}
    assert set(got) == near


def test_empty_tables(spark):
    assert found(spark, []) == {} and found(spark, [(1, ITEM, 0)], []) == {}
    with pytest.raises(ValueError):
        found(spark, [], min_words=2, errors=5)


def test_words_in_columns_as_one_by_one():
    texts = [None, "", "--", "Straße STRASSE ze​ta", "a_b-c 12½ ²x naïve Ünï", "İstanbul ΑΣ", "x " * 1000]
    words, ends = leaks.coded_words(pa.array(texts, pa.string()))
    starts = [0, *ends[:-1]]
    assert [words[a:b].tolist() for a, b in zip(starts, ends)] == [[leaks._hash(w) for w in leaks.words_of(t)] for t in texts]


@pytest.mark.parametrize(("min_words", "errors"), [(6, 1), (9, 2), (4, 0)])
def test_every_figure_against_brute_force(spark, min_words, errors):
    """Few words, so that pieces are hot, items repeat themselves and hits meet in many ways."""
    rng = random.Random(min_words)
    words = ["a", "b", "c"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 16)))) for i in range(8)]
    docs = [(d, " ".join(rng.choice([*words, "x"]) for _ in range(rng.randint(0, 30))), 0) for d in range(40)]
    for block_words in (10, 10**6):
        got = found(spark, docs, items, min_words=min_words, errors=errors, block_words=block_words)
        want = {}
        for d, t, _ in docs:
            text = t.split()
            for i, x in items:
                w = x.split()
                near = {s: e for s in range(len(w) - min_words + 1) if (e := edit_distance(w[s : s + min_words], text)) <= errors}
                if near:
                    run = max(n for a in range(len(w)) for b in range(len(text)) for n in [next((k for k in range(99) if a + k >= len(w) or b + k >= len(text) or w[a + k] != text[b + k]), 0)])
                    want[d, i] = (min(near.values()), run, len({k for s in near for k in range(s, s + min_words)}))
        assert set(got) == set(want) and want
        assert {k: (r.distance, r.longest_run, r.matched_words) for k, r in got.items()} == want
