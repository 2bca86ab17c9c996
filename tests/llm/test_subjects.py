from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from gritstone.llm import subjects as S
from tests.conftest import data

NOUNS = {
    "law": "court filing,lease agreement,notary seal,jury list,patent claim,legal brief".split(","),
    "energy": "gas valve,fuel cell,heat pump,turbine blade,power outage,grid frequency".split(","),
    "music": "bass line,choir rehearsal,violin part,drum pattern,album track,concert hall".split(","),
    "health": "patient ward,surgery slot,vaccine batch,nurse roster,blood test,clinic visit".split(","),
    "sport": "league table,penalty kick,relay split,medal count,race lap,season ticket".split(","),
    "farming": "wheat field,cattle tag,milk yield,grain silo,pasture map,frost alarm".split(","),
    "tooling": "lint rule,build cache,call graph,merge queue,release tag,type checker".split(","),
}
FORMS = ["The {a} limit was compared with the wrong sign, so a high {b} passed.", "Every {a} must keep its link to the {b} it came from.", "Correct the {a} total: the {b} was counted once per day.", "A stale {a} made the {b} look fine for hours."]
PLAIN = ["We closed the issue on Friday and reopened it later.", "The guard comes two lines too late.", "Nothing was wrong with the question itself.", "Tried it locally and the run ended quickly."]


def corpus(n, seed):
    rng = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        own = rng.sample(sorted(set(NOUNS) - {"tooling"}), 2 if rng.random() < 0.2 else 1) if rng.random() < 0.75 else ["tooling"]
        lines = [rng.choice(FORMS).format(a=rng.choice(NOUNS[s]), b=rng.choice(NOUNS[s])) for s in own for _ in range(3)]
        if own != ["tooling"]:
            lines += [rng.choice(FORMS).format(a=rng.choice(NOUNS["tooling"]), b=rng.choice(NOUNS["tooling"])) for _ in range(rng.randint(0, 3))]
            other = rng.choice(sorted(set(NOUNS) - set(own) - {"tooling"}))
            lines += [rng.choice(FORMS).format(a=rng.choice(NOUNS[other]), b=rng.choice(NOUNS[other]))]
        lines += rng.choices(PLAIN, k=3)
        rng.shuffle(lines)
        # a sentence counts once, so those that happen to be equal make a document that cannot be judged
        if len(set(lines[:-3])) >= len(own) * 2:
            docs.append((i, " ".join(dict.fromkeys(lines)), "x"))
            truth[i] = set(own)
    return docs, truth


def test_held_out_accuracy(spark):
    docs, truth = corpus(1200, 4)
    rng = random.Random(1)
    labels = [(d, s, "r") for d, t in truth.items() if d % 4 == 0 for s in t]
    labels += [(d, rng.choice(sorted(NOUNS)), "r") for d in list(truth)[:5]] + [(3, None, "r"), (None, "law", "r"), (5, "no such", "r"), (10**6, "law", "r")]
    found = S.assign_subjects(spark.createDataFrame(docs, "doc_id long, text string, subject string"), spark.createDataFrame(labels, "doc_id long, subject string, rater string"), spark.createDataFrame([(s,) for s in NOUNS], "subject string"))
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    held_out = [d for d in truth if d % 4]
    assert set(got) == set(truth) and all(1 <= len(s) <= 2 for s in got.values())
    assert np.mean([got[d] == truth[d] for d in held_out]) > 0.85


def test_dirty_and_empty(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "the court filing " * 20_000), (3, "again")], "doc_id long, text string")
    labels, names = spark.createDataFrame([], "doc_id long, subject string"), spark.createDataFrame([("law",), ("tooling",), (None,)], "subject string")
    assert sorted((r.doc_id, r.subject) for r in S.assign_subjects(d, labels, names).collect()) == [(1, "tooling"), (2, "tooling"), (3, "tooling")]
    assert S.assign_subjects(d.limit(0), labels, names).collect() == [] and S.assign_subjects(d, labels, names.limit(0)).collect() == []


@pytest.mark.parametrize(("counts", "mass", "chosen"), [([3, 0, 2], [3, 0, 2], [0]), ([3, 2, 5], [1, 1, 1], [0, 1]), ([1, 0, 4], [1, 0, 4], [2]), ([1, 0, 0], [1, 0, 0], [0]), ([0, 0, 0], [0, 0, 0], [2]), ([2, 2, 0], [1, 2, 0], [1, 0])])
def test_choose(counts, mass, chosen):
    assert S.choose(np.array(counts), np.array(mass, dtype=float), 2) == chosen


def test_sentences():
    language, sentences = S.sentences_of("Der Import von `loadTables` fehlt. Der Import von load_tables fehlt.\n\nThe type-checkers!")
    assert language == "de" and len(sentences) == 2 and "type checker" in sentences[1]


def plain_sentences(text):
    """The same, word by word."""
    seen, tell = {}, Counter()
    for raw in re.split(r"\n+|(?<=[.!?])[\"')\]]*\s+(?=[\"'(\[>*-]*[^\W_])", text or ""):
        words = re.findall(r"[^\W\d_]+", re.sub(r"(?<=[a-zà-ÿ])(?=[A-Z])", " ", raw).lower())
        key = " ".join(words)
        if not words or key in seen:
            continue
        tell.update(k for w in words for k, known in S._TELLTALE.items() if w in known)
        folded = [S._fold(w) for w in words]
        pairs = [f"{a} {b}" for a, b in zip(folded, folded[1:]) if len(a) > 2 and len(b) > 2 and a not in S._FUNCTION and b not in S._FUNCTION]
        seen[key] = {w for w in folded if len(w) > 2} | set(pairs)
    return (max(S.LANGUAGES, key=lambda k: tell[k]) if tell else "en"), list(seen.values())


def test_taken_apart_like_word_by_word():
    texts = pq.read_table(f"{data('sf0.01')}/documents.parquet", columns=["text"])["text"].combine_chunks()
    texts = pa.concat_arrays([texts.cast(pa.string()), pa.array([None, "", "...", "A. B! (c)? 'D' x", "same one. Same one! other", "Ärger über Öl\r\n\r\nel niño y los años", "one" * 5000], pa.string())])
    t = S.take_apart(texts)
    named = [t.words[a] if b < 0 else f"{t.words[a]} {t.words[b]}" for a, b in zip(t.first, t.second)]
    starts, text_starts = np.r_[0, t.term_ends[:-1]], np.r_[0, t.text_ends[:-1]]
    for i, text in enumerate(texts.to_pylist()):
        language, sentences = plain_sentences(text)
        assert S.LANGUAGES[t.language[i]] == language
        mine = [{named[k] for k in t.terms[starts[s] : t.term_ends[s]]} for s in t.sentences[text_starts[i] : t.text_ends[i]]]
        assert mine == sentences, text


def test_repeated_ids_and_bounded_labels(spark):
    docs, truth = corpus(300, 6)
    twice = spark.createDataFrame([(d, t) for d, t, _ in docs] + [(d, t) for d, t, _ in docs[:50]] + [(docs[0][0], "other words")], "doc_id long, text string")
    labels = spark.createDataFrame([(d, s) for d, t in truth.items() for s in t], "doc_id long, subject string")
    names = spark.createDataFrame([(s,) for s in NOUNS], "subject string")
    for most in (100, 200_000):
        got = S.assign_subjects(twice, labels, names, max_labels=most).groupBy("doc_id").count().collect()
        assert {r.doc_id for r in got} == {d for d, *_ in docs} and all(r["count"] <= 2 for r in got)
