"""Abusive, hateful and sexual content scored by a factorization machine over hashed terms.

A document's score is that of its worst sentence. A sentence is a set of hashed terms (words, word beginnings, pairs of
neighbours) after disguises are undone: look-alike and invisible characters, stars, digits for letters, spaced and
drawn-out letters. The machine adds to the linear weights the products of the terms' factors, so that an insult and the
mention of a group weigh more together than apart, and a harmful word among harmless ones less.

It is trained here, on seed sentences and on at most MAX_LABELLED labelled documents (a bounded sample by hash of
doc_id, of texts up to MAX_CHARS). Labels are of documents and err, so a labelled document teaches through sentences:
of a bad one, those that the machine finds bad, or that hold what far fewer clean documents hold, by share; of a clean
one, those that the seeds don't contradict. All documents are scored, whole.

Defined results: null and empty texts and messages without readable text score 0. Labels that are null are left out;
of several, the majority counts, a tie as clean. Without labels the seeds alone teach. Repeated rows are scored each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm import seeds
from pagewright.llm.canonical import canonical
from pagewright.llm.mail import sentences, text_parts

MAX_LABELLED, MAX_CHARS = 5000, 200_000
BITS, FACTORS, THRESHOLD = 20, 8, 0.6
#: Words in a stretch that is scored at once; longer sentences are scored in overlapping stretches.
STRETCH = 40

_CHUNK = re.compile(r"[^\s,;:()\[\]{}<>\"“”«»„、。！？]+")
_LEET = str.maketrans("013457@$!|€", "oieastasiie")
_EDGE = ".!?…'’‘-–—_/\\*+=~^%&#"
_RUNS = re.compile(r"([^\W\d_])\1{2,}")
_MASK = re.compile(r"[*#@$%&!+·•_.\-]+")
_CJK = re.compile(r"[\u3040-ヿ㐀-鿿]")
_BY_SHAPE: dict[tuple[str, int], list[str]] = {}
for _w in sorted(seeds.DISGUISED):
    _BY_SHAPE.setdefault((_w[0], len(_w)), []).append(_w)


def _undisguise(word: str) -> str:
    if word in seeds.DISGUISED:
        return word
    if not word.isalpha():
        bare = word.replace("'", "").replace("’", "")
        if bare.isalpha():
            word = bare
        elif "*" in word or "#" in word:
            for w in _BY_SHAPE.get((word[0], len(word)), ()):
                if all(a == b or a in "*#@$%&!" for a, b in zip(word, w)):
                    return w
            letters = _MASK.sub("", word)
            return letters if letters in seeds.DISGUISED else "*masked*" if letters.isalpha() and len(letters) < len(word) else word
        else:
            for w in (_MASK.sub("", word) if _MASK.search(word) else word, word.translate(_LEET)):
                if w in seeds.DISGUISED:
                    return w
            parts = re.split(r"[.\-_·]", word)
            if len(parts) > 2 and all(len(p) == 1 for p in parts):
                return "".join(parts)
    if _RUNS.search(word):
        one, two = _RUNS.sub(r"\1", word), _RUNS.sub(r"\1\1", word)
        return two if two in seeds.DISGUISED else one
    return word


_SEEN: dict[str, tuple[str, ...]] = {}  # the words of a chunk; a letter alone is marked by a blank before it


def _words_of_chunk(chunk: str) -> tuple[str, ...]:
    w = chunk.strip(_EDGE)
    if not w:
        own: tuple[str, ...] = ()
    elif len(w) == 1 and w.isalpha() and not _CJK.match(w):
        own = (" " + w,)
    elif not w.isascii() and _CJK.search(w):
        own = tuple(w[i : i + 2] for i in range(max(1, len(w) - 1)))
    else:
        own = (_undisguise(w),)
    if len(_SEEN) > 400_000:
        _SEEN.clear()
    _SEEN[chunk] = own
    return own


def words_of(sentence: str) -> list[str]:
    """The sentence's words, lower case, disguises undone; Japanese as pairs of neighbouring characters."""
    s = sentence if sentence.isascii() else canonical(sentence)
    seen = _SEEN
    out: list[str] = []
    letters = False
    for chunk in _CHUNK.findall(s.casefold()):
        own = seen.get(chunk)
        if own is None:
            own = _words_of_chunk(chunk)
        out += own
        if own and own[0][0] == " ":
            letters = True
    if not letters:
        return out
    joined: list[str] = []
    spaced: list[str] = []
    for w in [*out, ""]:
        if w[:1] == " ":
            spaced.append(w[1])
            continue
        joined += ["".join(spaced)] if len(spaced) > 2 else spaced
        spaced = []
        if w:
            joined.append(w)
    return joined


def _hash(term: str) -> int:
    return xxhash.xxh32_intdigest(term) & ((1 << BITS) - 1)


def terms_of(words: list[str]) -> list[int]:
    """The hashed terms of a stretch, each once."""
    terms = {_hash(w) for w in words}
    terms.update(_hash("~" + w[:5]) for w in words if len(w) > 5)
    terms.update(_hash(f"{a} {b}") for a, b in zip(words, words[1:]))
    return list(terms)


def stretches(words: list[str]) -> list[list[str]]:
    if len(words) <= STRETCH:
        return [words] if words else []
    return [words[i : i + STRETCH] for i in range(0, len(words) - STRETCH // 2, STRETCH // 2)]


class Machine:
    """A factorization machine over the terms that training has seen; all others weigh nothing."""

    def __init__(self, terms: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray) -> None:
        self.terms, self.bias, self.weights, self.factors = terms, bias, weights, factors
        self.place = {int(t): i for i, t in enumerate(terms)}

    def scores(self, stretches_of_terms: list[list[int]]) -> np.ndarray:
        place = self.place
        own = [[place[t] for t in ts if t in place] for ts in stretches_of_terms]
        return self.of_places(own)

    def of_places(self, own: list[list[int]]) -> np.ndarray:
        z = np.full(len(own), self.bias)
        some = [i for i, o in enumerate(own) if o]
        if some:
            flat = np.fromiter((p for i in some for p in own[i]), np.int64)
            starts = np.cumsum([0] + [len(own[i]) for i in some[:-1]])
            v = self.factors[flat]
            total = np.add.reduceat(v, starts, axis=0)
            square = np.add.reduceat(v * v, starts, axis=0)
            z[some] += np.add.reduceat(self.weights[flat], starts) + 0.5 * (total * total - square).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(examples: list[tuple[list[int], int, float]], epochs: int = 40, seed: int = 7) -> Machine:
    """The machine for examples (terms, label, weight): logistic loss, both classes of equal weight, Adam over all at once."""
    terms = np.array(sorted({t for ts, _, _ in examples for t in ts}), dtype=np.int64)
    place = {int(t): i for i, t in enumerate(terms)}
    flat = np.fromiter((place[t] for ts, _, _ in examples for t in ts), np.int64)
    row = np.repeat(np.arange(len(examples)), [len(ts) for ts, _, _ in examples])
    starts = np.cumsum([0] + [len(ts) for ts, _, _ in examples[:-1]])
    y = np.array([l for _, l, _ in examples], float)
    weight = np.array([w for _, _, w in examples], float)
    for label in (0, 1):
        weight[y == label] /= max(weight[y == label].sum(), 1e-9)
    n, rng = len(terms), np.random.default_rng(seed)
    params = [np.zeros(1), np.zeros(n), rng.normal(0, 0.05, (n, FACTORS))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    decay = [0.0, 2e-6, 4e-6]
    order = np.argsort(flat, kind="stable")
    sorted_flat, sorted_row = flat[order], row[order]
    group = np.flatnonzero(np.diff(sorted_flat, prepend=-1))
    for epoch in range(1, epochs + 1):
        b, w, v = params
        own = v[flat]
        total = np.add.reduceat(own, starts, axis=0)
        z = b[0] + np.add.reduceat(w[flat], starts) + 0.5 * (total * total - np.add.reduceat(own * own, starts, axis=0)).sum(axis=1)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        gw = np.add.reduceat(g[sorted_row], group)
        gv = np.add.reduceat(g[sorted_row, None] * (total[sorted_row] - v[sorted_flat]), group, axis=0)
        for i, grad in enumerate((np.array([g.sum()]), gw, gv)):
            grad = grad + decay[i] * params[i]
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.99 * second[i] + 0.01 * grad * grad
            params[i] = params[i] - 0.05 * (first[i] / (1 - 0.9**epoch)) / (np.sqrt(second[i] / (1 - 0.99**epoch)) + 1e-9)
    return Machine(terms, float(params[0][0]), params[1], params[2])


def _document(text: str | None) -> list[str]:
    return list(dict.fromkeys(s for part in text_parts(text) for s in sentences(part)))


def train(labelled: list[tuple[str, int]]) -> Machine:
    """The machine after the seeds and the labelled documents (text, 1 for bad)."""
    seed_examples = [(terms_of(words_of(s)), y, 1.0) for s, y in seeds.labelled()]
    if not labelled:
        return fit(seed_examples)
    docs = []
    for text, y in labelled:
        own = [w for s in _document(text) for w in stretches(words_of(s))]
        docs.append((y, own, [terms_of(w) for w in own]))
    # pairs of neighbouring words by how many bad and clean documents hold them: new are those that hardly a clean one
    # holds, telling those that bad ones hold so often that it is no accident
    held: tuple[Counter, Counter] = (Counter(), Counter())
    for y, own, _ in docs:
        held[y].update({p for w in own for p in zip(w, w[1:])})
    clean, bad_ = (max(1, sum(y == k for y, _, _ in docs)) for k in (0, 1))

    def share(test: Callable[[tuple], bool], w: list[str]) -> float:
        return float(np.mean([test(p) for p in zip(w, w[1:])])) if len(w) > 4 and not any(c.isdigit() or c == "@" for x in w for c in x) else 0.0

    def is_new(p: tuple) -> bool:
        return held[0][p] / clean < 0.2 * held[1][p] / bad_

    def is_telling(p: tuple) -> bool:
        return (held[1][p] - 1.5 * held[1][p] ** 0.5) / bad_ > 2 * (held[0][p] + 1) / clean

    new = [[share(is_new, w) for w in own] for _, own, _ in docs]
    telling = [[share(is_telling, w) if y else 0.0 for w in own] for y, own, _ in docs]
    machine = fit(seed_examples)
    for _ in range(2):
        good: dict[tuple, list] = {}
        bad: dict[tuple, list] = {}
        for (y, own, terms), fresh, tells in zip(docs, new, telling):
            if not terms:
                continue
            scores = machine.scores(terms)
            for w, t, s, f, g in zip(own, terms, scores, fresh, tells):
                key = tuple(w)
                if y == 0 and (s < 0.9 or f < 0.6):
                    good.setdefault(key, [t, 0])[1] += 1
                elif y == 1 and len(w) > 4 and (s > 0.8 and f > 0.5 or f >= 0.8 and s > 0.05 and f >= max(fresh) - 1e-9 or g >= 0.4 and g >= max(tells) - 1e-9):
                    bad.setdefault(key, [t, 0])[1] += 1
        examples = [(t, 0, min(n, 3) ** 0.5) for k, (t, n) in good.items() if k not in bad or n > 2 * bad[k][1]]
        examples += [(t, 1, min(n, 3) ** 0.5) for k, (t, n) in bad.items() if k not in good or good[k][1] <= 2 * n]
        machine = fit(seed_examples + examples)
    return machine


def labelled_sample(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, chars: int = MAX_CHARS) -> list[tuple[str, int]]:
    """The texts and labels of at most so many labelled documents, the first by hash of doc_id."""
    votes = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.avg((F.col("label") != "clean").cast("double")).alias("bad"))
    picked = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    own = documents.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= chars)).join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])
    return [(r["text"], int(r["bad"] > 0.5)) for r in sorted(own.collect(), key=lambda r: r["doc_id"])]


def scored(documents: DataFrame, machine: Machine, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """keep, score (of the worst sentence), flagged, worst (that sentence), sentences: one row per document. No shuffle."""
    own = documents.select(*keep, F.col("text").alias("_text"))
    made = [("score", T.DoubleType(), pa.float64()), ("flagged", T.BooleanType(), pa.bool_()), ("worst", T.StringType(), pa.string()), ("sentences", T.IntegerType(), pa.int32())]
    schema = T.StructType([*own.schema.fields[:-1], *[T.StructField(n, t) for n, t, _ in made]])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = machine.place
        known: dict[str, tuple] = {}  # places of a word, of its beginning; a word training hasn't seen has none
        seen: dict[str, float] = {}  # scores of sentences

        def places(w: str) -> tuple:
            got = known.get(w)
            if got is None:
                if len(known) > 400_000:
                    known.clear()
                got = known[w] = (place.get(_hash(w)), place.get(_hash("~" + w[:5])) if len(w) > 5 else None)
            return got

        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            documents_ = [_document(t.as_py()) for t in texts]
            if len(seen) > 200_000:
                seen.clear()
            todo, owner = [], []
            for s in {s for d in documents_ for s in d if s not in seen}:
                seen[s] = 0.0
                for w in stretches(words_of(s)):
                    at = set()
                    before, before_seen = "", False
                    for x in w:
                        a, b = places(x)
                        if a is not None:
                            at.add(a)
                            if before_seen and (p := place.get(_hash(f"{before} {x}"))) is not None:
                                at.add(p)
                        if b is not None:
                            at.add(b)
                        before, before_seen = x, a is not None
                    todo.append(list(at))
                    owner.append(s)
            for s, p in zip(owner, machine.of_places(todo) if todo else ()):
                if p > seen[s]:
                    seen[s] = float(p)
            best, worst = [], []
            for d in documents_:
                s = max(d, key=seen.__getitem__, default=None)
                best.append(seen[s] if s is not None else 0.0)
                worst.append(s if s is not None and seen[s] >= THRESHOLD else None)
            columns = [pa.array(best, pa.float64()), pa.array([b >= THRESHOLD for b in best]), pa.array(worst, pa.string()), pa.array([len(d) for d in documents_], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *[n for n, _, _ in made]])

    return own.mapInArrow(score, schema)


def moderate(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a machine trained on the seeds and the bounded sample of labelled ones."""
    return scored(documents, train(labelled_sample(documents, labels)))


def rates(scores: DataFrame) -> DataFrame:
    """source, documents, flagged, rate, mean_score; documents without source share the null row."""
    g = scores.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if("flagged").alias("flagged"), F.avg("score").alias("mean_score"))
    return g.withColumn("rate", F.col("flagged") / F.col("documents"))
