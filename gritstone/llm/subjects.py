"""Subject areas of documents: term weighting, truncated singular value decomposition, and cosine similarity to seed centroids
that are refined iteratively.

The unit that is embedded is the sentence, since a document deals with a subject only where more than one sentence does.
Terms are words and pairs of adjacent words, weighted by inverse document frequency and by how much they concentrate on few
subjects. Seeds are the hand labels; rounds of assigning sentences and recomputing term weights, decomposition and centroids
from all documents replace the seeds' noise.

Texts are read once. They are taken apart in columns, thousands at a time, and written as blocks: packed arrays of documents,
their different sentences and the sentences' terms. Every later pass runs over those blocks with array operations and emits
sums per term or subject. The decomposition is randomised: each pass multiplies the document-term matrix and its transpose with
a thin matrix, so a task emits a row per term it saw, and what reaches the driver is terms times rank, never documents.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.session import checkpointed

from .batches import slices

#: Share of the documents a term must occur in (and two documents at least), and may occur in at most. It is a share, so that
#: the same terms count at every size, and it bounds the vocabulary by the terms of an average document over the least share.
MIN_SHARE, MAX_SHARE = 0.0005, 0.5
#: Terms of less concentration on subjects carry no weight.
MIN_CONCENTRATION = 0.25
#: A pair of words is a term where it makes this share of the documents of its rarer word.
MIN_PAIR_SHARE = 0.35
#: Sum of its terms' concentrations below which a sentence deals with nothing.
MIN_EVIDENCE = 0.55
#: Cosine to a centroid from which a sentence deals with its subject, and the lead over the next subject that it needs.
MIN_COSINE, MIN_LEAD = 0.45, 0.08
#: Rounds of refinement, passes over the documents per decomposition, and columns of the thin matrix beyond the rank. The rank is
#: the number of subjects; each language has its own decomposition, and subjects weigh alike in it, else a rare language or
#: subject would fall below the rank.
ROUNDS, PASSES, OVERSAMPLE = 2, 2, 10
#: Labels the model is fitted on at most, taken by a hash of their document; all documents count in everything else.
MAX_LABELS = 200_000

# Function words that tell the language of a text; fixed values.
_TELLTALE = {
    "de": frozenset("der die das und ist nicht ein eine mit von zu den dem des für auf wird sich wenn nach aus bei als auch".split()),
    "es": frozenset("el la los las de que y en un una por con para se del al no es cuando su lo como más".split()),
    "en": frozenset("the of and to in is that it for with on was as are be by this not at from or an".split()),
}
LANGUAGES = tuple(_TELLTALE)
_FUNCTION = frozenset(w for words in _TELLTALE.values() for w in words)

_SPACES = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SENTENCE_END = rf"""([.!?]["')\]]*)[{_SPACES}]+(["'(\[>*-]*[\p{{L}}\p{{N}}])"""


def _fold(word: str) -> str:
    """A word without case and plural ending."""
    return word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith("ss") else word


def _take(ends: np.ndarray, values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lists given by their ``ends`` in ``values``, those numbered ``rows``, in that order: values, and each value's place in
    ``rows``."""
    starts = np.r_[0, ends[:-1]][rows] if len(ends) else np.zeros(0, dtype=np.int64)
    sizes = ends[rows] - starts if len(ends) else starts
    owner = np.repeat(np.arange(len(rows)), sizes)
    first = np.cumsum(sizes) - sizes
    return values[np.arange(len(owner)) - first[owner] + starts[owner]], owner


@dataclass
class Texts:
    """Texts taken apart: the language of each, the different sentences of each, and the terms of every different sentence. A
    sentence that texts of two languages hold is two sentences."""

    language: np.ndarray
    #: per text the end of its sentences in ``sentences``, which number the different ones
    text_ends: np.ndarray
    sentences: np.ndarray
    sentence_language: np.ndarray
    term_ends: np.ndarray
    #: numbers of terms, each once in a sentence
    terms: np.ndarray
    #: words, folded, and per term its first and second word, or -1
    words: list[str]
    first: np.ndarray
    second: np.ndarray


def take_apart(texts: pa.Array) -> Texts:
    count = len(texts)
    flat = pc.replace_substring_regex(texts.fill_null(""), pattern=_SENTENCE_END, replacement="\\1\n\\2")
    flat = pc.replace_substring_regex(flat, pattern=r"([a-zà-ÿ])([A-Z])", replacement=r"\1 \2")
    flat = pc.replace_substring_regex(pc.utf8_lower(flat), pattern=r"[^\p{L}\n]+", replacement=" ")
    lists = pc.split_pattern(flat, "\n")
    owner = np.repeat(np.arange(count), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = pc.utf8_trim(lists.flatten(), " ").dictionary_encode()
    code, strings = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    told = (pc.binary_length(strings).to_numpy() > 0)[code] if len(code) else np.zeros(0, dtype=bool)
    # a sentence counts once in a text
    key = pd.unique(owner[told] * max(1, len(strings)) + code[told])
    owner, code = key // max(1, len(strings)), key % max(1, len(strings))

    split = pc.split_pattern(strings, " ")
    word_ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False)).astype(np.int64)
    spoken = split.flatten().dictionary_encode()
    raw, spoken = spoken.dictionary.to_pylist(), spoken.indices.to_numpy().astype(np.int64)
    within = np.repeat(np.arange(len(word_ends)), np.diff(np.r_[0, word_ends]))
    told = np.stack([np.bincount(within[np.array([w in known for w in raw], dtype=bool)[spoken]], minlength=len(word_ends)) for known in _TELLTALE.values()], axis=1)
    votes = np.stack([np.bincount(owner, weights=told[code, n], minlength=count) for n in range(len(LANGUAGES))], axis=1)
    language = np.where(votes.any(axis=1), votes.argmax(axis=1), LANGUAGES.index("en"))

    number, words = pd.factorize(np.array([_fold(w) for w in raw], dtype=object))
    words = list(words)
    size = len(words)
    spoken = number[spoken]
    wide = np.array([len(w) > 2 for w in words], dtype=bool)
    plain = wide & np.array([w not in _FUNCTION for w in words], dtype=bool)
    single = np.flatnonzero(wide[spoken])
    paired = np.flatnonzero(plain[spoken[:-1]] & plain[spoken[1:]] & (within[:-1] == within[1:])) if len(spoken) else single
    key = np.r_[spoken[single] * (size + 1) + size, spoken[paired] * (size + 1) + spoken[paired + 1]]
    at = np.r_[within[single], within[paired]]
    order = np.argsort(at, kind="stable")
    term, kinds = pd.factorize(key[order])
    once = pd.unique(at[order] * max(1, len(kinds)) + term)
    at, term = once // max(1, len(kinds)), once % max(1, len(kinds))
    ends = np.cumsum(np.bincount(at, minlength=len(word_ends)))

    # sentences by language
    sentence, rows = pd.factorize(code * len(LANGUAGES) + language[owner])
    terms, of = _take(ends, term, rows // len(LANGUAGES))
    return Texts(
        language, np.cumsum(np.bincount(owner, minlength=count)), sentence, rows % len(LANGUAGES), np.cumsum(np.bincount(of, minlength=len(rows))), terms,
        words, kinds // (size + 1), np.where(kinds % (size + 1) == size, -1, kinds % (size + 1)),
    )


def sentences_of(text: str | None) -> tuple[str, list[list[str]]]:
    """The language of a text and the terms of each of its different sentences."""
    t = take_apart(pa.array([text], pa.string()))
    named = [t.words[a] if b < 0 else f"{t.words[a]} {t.words[b]}" for a, b in zip(t.first, t.second)]
    starts = np.r_[0, t.term_ends[:-1]]
    return LANGUAGES[t.language[0]], [[named[k] for k in t.terms[starts[s] : t.term_ends[s]]] for s in t.sentences]


# --- blocks: what one row of the encoded documents holds, each column a packed array
RAW = {
    "ids": np.int64, "digests": np.int64, "language": np.int8, "label_rows": np.int32, "labels": np.int32, "text_ends": np.int32, "sentences": np.int32, "sentence_language": np.int8,
    "term_ends": np.int32, "terms": np.int32, "hashes": np.int64, "first": np.int64, "second": np.int64, "frequency": np.int32,
}
KEPT = {k: RAW[k] for k in ("ids", "digests", "language", "label_rows", "labels", "text_ends", "sentences", "sentence_language", "term_ends", "terms")}
_SCHEMA = lambda kinds: ", ".join(f"{k} binary" for k in kinds)


def _pack(values: np.ndarray, kind) -> bytes:
    raw = np.ascontiguousarray(values, dtype=kind).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(packed: bytes, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True), dtype=kind)


class Block:
    """The documents of one row, with ``documents``, ``owner`` (the document of each of its sentences), and ``within`` (the sentence
    of each term)."""

    def __init__(self, packed: dict[str, bytes], kinds: dict = KEPT):
        for name, kind in kinds.items():
            a = _unpack(packed[name], kind)
            setattr(self, name, a if a.dtype in (np.int64, np.int8) else a.astype(np.int64))
        self.language, self.sentence_language = self.language.astype(np.int64), self.sentence_language.astype(np.int64)
        self.documents, self.count = len(self.ids), len(self.term_ends)
        self.owner = np.repeat(np.arange(self.documents), np.diff(np.r_[0, self.text_ends]))
        self.within = np.repeat(np.arange(self.count), np.diff(np.r_[0, self.term_ends]))


def _blocks(batches: Iterator[pd.DataFrame], kinds: dict = KEPT) -> Iterator[Block]:
    for pdf in batches:
        for row in pdf.to_dict("records"):
            yield Block(row, kinds)


def _hashed(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit name of every term and of its words; a single word is its own first word and has no second."""
    of = np.array([xxhash.xxh3_64_intdigest(w) for w in t.words] or [0], dtype=np.uint64)
    a, b = of[t.first] if len(t.words) else of[:0], np.where(t.second < 0, 0, of[t.second] if len(t.words) else 0).astype(np.uint64)
    with np.errstate(over="ignore"):
        both = (a * np.uint64(0x9E3779B97F4A7C15)) ^ ((b * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(3)) ^ (b << np.uint64(31))
    return np.where(t.second < 0, a, both).view(np.int64), a.view(np.int64), b.view(np.int64)


def _encoder(labels):
    """Texts to blocks. ``labels`` has the labelled documents' ids in order, the ends of each one's subjects, and these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_ends, known_subjects = labels.value
        for whole in batches:
            for batch in slices(whole):
                texts = batch.column("text").cast(pa.string())
                t = take_apart(texts)
                hashes, first, second = _hashed(t)
                met, of = _take(t.term_ends, t.terms, t.sentences)
                doc = np.repeat(np.arange(len(texts)), np.diff(np.r_[0, t.text_ends]))[of]
                frequency = np.bincount(pd.unique(doc * max(1, len(hashes)) + met) % max(1, len(hashes)), minlength=len(hashes))[: len(hashes)]
                ids = batch.column("doc_id").to_numpy()
                place = np.searchsorted(known, ids)
                place[place == len(known)] = 0
                hit = np.flatnonzero(known[place] == ids) if len(known) else place[:0]
                subjects, of = _take(known_ends, known_subjects, place[hit])
                digests = np.array([xxhash.xxh3_64_intdigest(x.as_buffer() or b"") for x in texts.fill_null("")], dtype=np.uint64).view(np.int64)
                held = {
                    "ids": ids, "digests": digests, "language": t.language, "label_rows": hit[of], "labels": subjects, "text_ends": t.text_ends, "sentences": t.sentences,
                    "sentence_language": t.sentence_language, "term_ends": t.term_ends, "terms": t.terms, "hashes": hashes, "first": first, "second": second, "frequency": frequency,
                }
                yield pa.RecordBatch.from_pydict({k: pa.array([_pack(held[k], kind)], pa.binary()) for k, kind in RAW.items()})

    return run


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["hash", "first", "second"]
    held: list[pd.DataFrame] = []
    size = 0
    for pdf in batches:
        for row in pdf.to_dict("records"):
            one = pd.DataFrame({n: _unpack(row[c], np.int64) for n, c in zip(names, ("hashes", "first", "second"))} | {"df": _unpack(row["frequency"], np.int32).astype(np.int64)})
            held.append(one)
            size += len(one)
            if size > 1_000_000:
                held = [pd.concat(held).groupby(names, as_index=False, sort=False).df.sum()]
                size = 0
    if held:
        yield pd.concat(held).groupby(names, as_index=False, sort=False).df.sum()


def _recoder(vocabulary):
    """Blocks over the terms that are kept, numbered by their place in ``vocabulary``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = vocabulary.value
        for b in _blocks(batches, RAW):
            place = np.minimum(np.searchsorted(kept, b.hashes), max(0, len(kept) - 1))
            number = np.where(kept[place] == b.hashes, place, -1) if len(kept) else np.full(len(b.hashes), -1)
            terms = number[b.terms] if len(b.terms) else b.terms
            b.term_ends = np.cumsum(np.bincount(b.within[terms >= 0], minlength=b.count))
            b.terms = terms[terms >= 0]
            yield pd.DataFrame({k: [_pack(getattr(b, k), kind)] for k, kind in KEPT.items()})

    return run


class Model:
    """Each weighted term's concentration, lean to subjects and place in the decomposition, and one centroid per language and
    subject. ``place`` numbers the weighted terms of the vocabulary; others are -1."""

    def __init__(self, place: np.ndarray, strength: np.ndarray, lean: np.ndarray, vectors: np.ndarray, centroids: np.ndarray | None = None):
        self.place, self.strength, self.lean, self.vectors, self.centroids = place, strength, lean, vectors, centroids

    def weighted(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        """The weighted terms' places, and the sentence of each."""
        p = self.place[b.terms] if len(b.terms) else b.terms
        return p[p >= 0], b.within[p >= 0]

    def score(self, b: Block, embed: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """Cosines of the block's different sentences to the subjects' centroids of their language, and their embeddings: unit
        vectors in the space of the language, zero where terms carry too little weight. While there are no centroids, the share
        of the terms' lean stands for the cosine."""
        p, of = self.weighted(b)
        silent = np.bincount(of, weights=self.strength[p], minlength=b.count) < MIN_EVIDENCE
        told = ~silent[of] if len(of) else np.zeros(0, dtype=bool)
        p, of = p[told], of[told]
        languages, size, rank = self.vectors.shape
        if self.centroids is None:
            lean = _sums(self.lean, p, of, b.count)
            total = lean.sum(axis=1, keepdims=True)
            np.divide(lean, total, out=lean, where=total > 1e-9)
            if not embed:
                return lean, None
        x = _sums(self.vectors.reshape(languages * size, rank), b.sentence_language[of] * size + p, of, b.count)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        np.divide(x, norm, out=x, where=norm > 1e-9)
        if self.centroids is None:
            return lean, x
        out = np.zeros((self.centroids.shape[1], b.count)).T
        for n in range(languages):
            rows = b.sentence_language == n
            out[rows] = x[rows] @ self.centroids[n].T
        return out, x


def decide(score: np.ndarray) -> np.ndarray:
    """The best column of each row, or -1 below the least cosine or without the least lead."""
    if not len(score):
        return np.zeros(0, dtype=np.int64)
    best = np.zeros(len(score), dtype=np.int64)
    top, second = np.full(len(score), -np.inf), np.full(len(score), -np.inf)
    for k in range(score.shape[1]):
        one = score[:, k]
        ahead = one > top
        second = np.maximum(second, np.where(ahead, top, one))
        top = np.where(ahead, one, top)
        best[ahead] = k
    second = second if score.shape[1] > 1 else 0
    best[(top < MIN_COSINE) | (top - second < MIN_LEAD)] = -1
    return best


def _sums(rows: np.ndarray, picked: np.ndarray, of: np.ndarray, count: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Sums of the ``picked`` rows, times ``weights``, by the number ``of`` each; a column at a time, which lies in the cache."""
    out = np.empty((rows.shape[1], count))
    for k, column in enumerate(np.ascontiguousarray(rows.T)):
        out[k] = np.bincount(of, weights=column[picked] if weights is None else column[picked] * weights, minlength=count)
    return out.T


def _votes(model: Model, b: Block) -> np.ndarray:
    """Each document's shares in the subjects that two of its sentences or more deal with."""
    best = decide(model.score(b, embed=False)[0])[b.sentences]
    subjects = model.lean.shape[1]
    counts = np.bincount((b.owner * subjects + best)[best >= 0], minlength=b.documents * subjects).reshape(b.documents, subjects).astype(float)
    counts[counts < 2] = 0
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


def _counts(size: int, subjects: int, model) -> Callable:
    """Sentences per term and subject of their documents: by the documents' labels where there is no model, else by votes. A
    sentence that any document may hold thus spreads over all subjects. The term numbered ``size`` holds all sentences, those
    above it the documents per language."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size + 1 + len(LANGUAGES), subjects))
        for b in _blocks(batches):
            if model is None:
                part = np.zeros((b.documents, subjects))
                part[b.label_rows, b.labels] = 1
                part /= np.maximum(part.sum(axis=1, keepdims=True), 1)
            else:
                part = _votes(model.value, b)
            for s in range(subjects):
                have = np.bincount(b.sentences, weights=part[b.owner, s], minlength=b.count)
                # a subject is that of few sentences
                met = have[b.within] > 0 if len(b.within) else np.zeros(0, dtype=bool)
                total[:size, s] += np.bincount(b.terms[met], weights=have[b.within[met]], minlength=size)[:size]
                total[size, s] += have.sum()
                total[size + 1 :, s] += np.bincount(b.language, weights=part[:, s], minlength=len(LANGUAGES))
        yield _rows(total, "t")

    return run


def _gram(model, start, weight, balance: np.ndarray) -> Callable:
    """The weighted document-term matrix of each language, transposed, times itself, times ``start``. Documents have unit length
    times ``balance`` of their language and subjects, so that a rare subject has as large a place as any."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        thin, w = start.value, weight.value
        languages, size, rank = thin.shape
        thin, total = thin.reshape(languages * size, rank), np.zeros((languages * size, rank))
        for b in _blocks(batches):
            worth = np.sqrt((_votes(model.value, b) * balance[b.language]).sum(axis=1))
            told = worth[b.owner] > 0
            sentences, owner = b.sentences[told], b.owner[told]
            p, of = model.value.weighted(b)
            met, sentence = _take(np.cumsum(np.bincount(of, minlength=b.count)), p, sentences)
            key, tf = np.unique(owner[sentence] * size + met, return_counts=True)
            owner, p = key // size, key % size
            x = w[p] * (1 + np.log(tf))
            length = np.sqrt(np.bincount(owner, weights=x * x, minlength=b.documents))
            x *= worth[owner] / length[owner]
            row = b.language[owner] * size + p
            total += _sums(_sums(thin, row, owner, b.documents, x), owner, row, len(total), x)
        yield _rows(total, "t")

    return run


def _centres(model) -> Callable:
    """Sums of the embeddings of the sentences assigned to each subject, per language."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        languages, _, rank = model.value.vectors.shape
        subjects = model.value.lean.shape[1]
        total = np.zeros((languages * subjects, rank))
        for b in _blocks(batches):
            score, x = model.value.score(b)
            best = decide(score)
            known = best >= 0
            place = b.sentence_language[known] * subjects + best[known]
            times = np.bincount(b.sentences, minlength=b.count)[known].astype(float)
            total += _sums(x, np.flatnonzero(known), place, len(total), times)
        yield _rows(total, "t")

    return run


def _rows(total: np.ndarray, key: str) -> pd.DataFrame:
    """The rows of a matrix that are not all zero, one column per column."""
    t = np.flatnonzero(total.any(axis=1))
    return pd.DataFrame({key: t} | {f"v{k}": total[t, k] for k in range(total.shape[1])})


def _summed(blocks: DataFrame, worker: Callable, rows: int, width: int) -> np.ndarray:
    """The sum of the matrices that the tasks give."""
    columns = [f"v{k}" for k in range(width)]
    found = blocks.mapInPandas(worker, "t long, " + ", ".join(f"{c} double" for c in columns)).groupBy("t").agg(*(F.sum(c).alias(c) for c in columns)).toArrow().to_pandas()
    out = np.zeros((rows, width))
    out[found.t.to_numpy(dtype=np.int64)] = found[columns].to_numpy(dtype=float)
    return out


def _concentration(n: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """From 0, spread over all subjects as their texts are, to 1, in one alone; low counts are held back."""
    rate = n / np.maximum(totals, 1)
    q = rate / np.maximum(rate.sum(axis=1, keepdims=True), 1e-12)
    entropy = -(q * np.log(np.maximum(q, 1e-12))).sum(axis=1)
    size = n.sum(axis=1)
    return (1 - entropy / np.log(max(2, n.shape[1]))) * size / (size + 6)


def _range(blocks: DataFrame, model: Model, weight: np.ndarray, balance: np.ndarray, rank: int) -> np.ndarray:
    """Per language an orthonormal basis of the strongest ``rank`` directions, by subspace iteration from the terms' lean to
    subjects and random columns (Halko, Martinsson, Tropp, "Finding structure with randomness")."""
    share = blocks.sparkSession.sparkContext.broadcast
    size, subjects = model.lean.shape
    width = min(size, subjects + OVERSAMPLE)
    start = np.hstack([model.lean, np.random.default_rng(7).normal(size=(size, OVERSAMPLE))])[:, :width]
    basis = np.stack([np.linalg.qr(start)[0]] * len(LANGUAGES))
    held, heavy = share(model), share(weight)
    for n in range(PASSES):
        seen = _summed(blocks, _gram(held, share(basis), heavy, balance), len(LANGUAGES) * size, width).reshape(len(LANGUAGES), size, width)
        if n + 1 < PASSES:
            basis = np.stack([np.linalg.qr(one)[0] for one in seen])
    out = np.zeros((len(LANGUAGES), size, rank))
    for k in range(len(LANGUAGES)):
        small = basis[k].T @ seen[k]
        values, turn = np.linalg.eigh((small + small.T) / 2)
        out[k] = np.linalg.qr(seen[k] @ turn[:, np.argsort(-values)[:rank]])[0]
    return out


def _fit(blocks: DataFrame, subjects: list[str], idf: np.ndarray, rounds: int) -> Model | None:
    size, count = len(idf), len(subjects)
    share = blocks.sparkSession.sparkContext.broadcast
    model = None
    for _ in range(rounds):
        n = _summed(blocks, _counts(size, count, None if model is None else share(model)), size + 1 + len(LANGUAGES), count)
        strength = _concentration(n[:size], n[size])
        chosen = np.flatnonzero(strength >= MIN_CONCENTRATION)
        if not len(chosen):
            break
        weight = idf[chosen] * strength[chosen]
        place = np.full(size, -1)
        place[chosen] = np.arange(len(chosen))
        rate = n[chosen] / np.maximum(n[size], 1)
        lean = weight[:, None] * rate / np.maximum(rate.sum(axis=1, keepdims=True), 1e-12)
        rank = min(len(chosen), count)
        model = Model(place, strength[chosen], lean, np.zeros((len(LANGUAGES), len(chosen), rank)))
        vectors = weight[:, None] * _range(blocks, model, weight, 1 / np.maximum(n[size + 1 :], 1), rank)
        model = Model(place, strength[chosen], lean, vectors)
        # the terms' lean seeds the centroids, two passes refine them
        for _ in range(3):
            total = _summed(blocks, _centres(share(model)), len(LANGUAGES) * count, rank).reshape(len(LANGUAGES), count, rank)
            norm = np.linalg.norm(total, axis=2, keepdims=True)
            fresh = np.divide(total, norm, out=np.zeros_like(total), where=norm > 1e-9)
            # a subject to which no sentence of a language fell keeps the centroid it had
            model = Model(place, strength[chosen], lean, vectors, fresh if model.centroids is None else np.where(norm > 1e-9, fresh, model.centroids))
    return model


def choose(counts: np.ndarray, mass: np.ndarray, rest: int | None, least: int = 2, most: int = 2) -> list[int]:
    """Which subjects a document has, by its sentences per subject and the sum of their cosines: at most ``most`` of those with
    ``least`` sentences, else the strongest; ``rest`` (tooling) only where there is no other."""
    order = np.lexsort((-mass, -counts))
    several = [s for s in order if counts[s] >= least and s != rest]
    if several:
        return [int(s) for s in several[:most]]
    if rest is not None and counts[rest] >= least:
        return [int(rest)]
    single = [s for s in order if counts[s] > 0 and s != rest]
    if single and (rest is None or counts[rest] == 0 or mass[single[0]] >= mass[rest]):
        return [int(single[0])]
    if rest is not None and (counts[rest] > 0 or not mass.any()):
        return [int(rest)]
    return [int(mass.argmax())]


CHOSEN = "doc_id long, digest long, subjects array<int>, sentences array<long>"


def _chooser(model, subjects: int, rest: int | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _blocks(batches):
            counts, mass = np.zeros((b.documents, subjects)), np.zeros((b.documents, subjects))
            if model.value is not None:
                score, _ = model.value.score(b)
                best = decide(score)[b.sentences]
                counts = np.bincount((b.owner * subjects + best)[best >= 0], minlength=counts.size).reshape(counts.shape)
                score = np.maximum(score, 0) ** 2
                for s in range(subjects):
                    mass[:, s] = np.bincount(b.owner, weights=score[b.sentences, s], minlength=b.documents)
            picked = [choose(counts[i], mass[i], rest) for i in range(b.documents)]
            yield pd.DataFrame({"doc_id": b.ids, "digest": b.digests, "subjects": picked, "sentences": [[int(counts[i, s]) for s in one] for i, one in enumerate(picked)]})

    return run


def _known_labels(labels: DataFrame, names: list[str], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of labelled documents in order, the ends of each one's subjects, and the subjects' numbers; ``most`` documents."""
    number = F.create_map(*(x for i, name in enumerate(names) for x in (F.lit(name), F.lit(i))))
    known = labels.where(F.col("subject").isin(names) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), number[F.col("subject")].alias("s"))
    by = known.groupBy("doc_id").agg(F.array_sort(F.collect_set("s")).alias("s"))
    found = by.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).toArrow().to_pandas().sort_values("doc_id")
    sizes = found.s.map(len).to_numpy(dtype=np.int64) if len(found) else np.zeros(0, dtype=np.int64)
    return found.doc_id.to_numpy(dtype=np.int64), np.cumsum(sizes), np.concatenate([np.zeros(0, dtype=np.int64), *(np.asarray(s, dtype=np.int64) for s in found.s)])


def assign_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, rest: str | None = "tooling", rounds: int = ROUNDS, max_labels: int = MAX_LABELS) -> DataFrame:
    """``(doc_id, subject, sentences)``: the one or two subjects of each document of ``documents`` (``doc_id``, ``text``).

    ``labels`` (``doc_id``, ``subject``) are hand labels of some of the documents, which may be wrong, null, repeated or at odds;
    the model is fitted on at most ``max_labels`` labelled documents. ``subjects`` (``subject``) names the subjects, ``rest`` the one
    that counts only where there is no other.

    Defined cases: a null ``doc_id`` is no document; of a repeated one the text with the least digest gives the subjects, though
    each row counts in the statistics; a null or empty text has the subject ``rest`` (the first subject where ``rest`` is None);
    labels of unknown documents or subjects do not count; without any usable label every document has the subject ``rest``; an
    empty table gives no rows.
    """
    spark = documents.sparkSession
    share = spark.sparkContext.broadcast
    names = sorted(r.subject for r in subjects.select("subject").where("subject IS NOT NULL").distinct().collect())
    if not names:
        return spark.createDataFrame([], "doc_id long, subject string, sentences long")
    texts = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    raw = checkpointed(texts.mapInArrow(_encoder(share(_known_labels(labels, names, max_labels))), _SCHEMA(RAW)))
    total = max(1, texts.select("doc_id").count())
    frequencies = raw.select("hashes", "first", "second", "frequency").mapInPandas(_frequencies, "hash long, first long, second long, df long")
    frequencies = frequencies.groupBy("hash", "first", "second").agg(F.sum("df").alias("df"))
    kept = frequencies.where((F.col("df") >= max(2, MIN_SHARE * total)) & (F.col("df") <= max(2, MAX_SHARE * total))).toArrow().to_pandas()
    df = pd.Series(kept.df.to_numpy(), index=kept["hash"].to_numpy())
    df = df[~df.index.duplicated()]
    rarer = np.minimum(df.reindex(kept["first"]).fillna(total).to_numpy(), df.reindex(kept["second"]).fillna(total).to_numpy())
    kept = kept[(kept.second == 0) | (kept.df >= MIN_PAIR_SHARE * rarer)].drop_duplicates("hash").sort_values("hash")
    idf = np.log(total / kept.df.to_numpy(dtype=float)) if len(kept) else np.array([])
    blocks = checkpointed(raw.mapInPandas(_recoder(share(kept["hash"].to_numpy(dtype=np.int64))), _SCHEMA(KEPT)))
    model = _fit(blocks, names, idf, rounds)
    at = names.index(rest) if rest in names else None
    found = blocks.mapInPandas(_chooser(share(model), len(names), at), CHOSEN)
    found = found.groupBy("doc_id").agg(F.min(F.struct("digest", "subjects", "sentences")).alias("r"))
    named = F.create_map(*(x for i, name in enumerate(names) for x in (F.lit(i), F.lit(name))))
    return found.select("doc_id", F.explode(F.arrays_zip("r.subjects", "r.sentences")).alias("x")).select("doc_id", named[F.col("x.subjects")].alias("subject"), F.col("x.sentences").alias("sentences"))
