"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors: one per word and one per character n-gram (three and four bytes,
with the word's borders), all hashed into one table; a word that repeats the one before it is written as a
ditto mark, a unit of its own. A softmax layer gives the class. Both are trained by numpy
stochastic gradient descent, one document a step, on a bounded and balanced sample of labelled documents
(``per_class`` of each class); the share of the classes over all labelled rows is put back into the bias.

Words stand between ASCII white space, letter case is kept. Defined cases: null and empty texts have the zero
vector and so the bias's score; without labels of both classes the score is the share of label 1 among them, or
one half without any; rows map one to one, so repeated rows, extra columns and empty tables come through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from . import labelled, words

BITS = 18
GRAMS = (3, 4)
_U = np.uint64
#: The unit that stands for a word which repeats the one before it.
DITTO = 0
#: Words between ASCII white space, upper case kept.
CASED = bytes(words.BLANKS[c] if not 65 <= c <= 90 else c for c in range(256))


def word_units(clean: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units of each given word (its own and its n-grams'), and where each word's begin."""
    sizes = ends - starts
    begins = np.concatenate([[0], np.cumsum(sizes + 2)])
    body = np.full(begins[-1] + max(GRAMS), 1, dtype=np.uint64)  # 1 marks a border
    where = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    body[np.repeat(begins[:-1] + 1, sizes) + where] = clean[np.repeat(starts, sizes) + where]
    word_of = np.repeat(np.arange(len(sizes)), sizes + 2)
    stop = begins[1:][word_of]
    place = np.arange(begins[-1])
    shift = _U(64 - BITS)
    owners, made = [np.arange(len(sizes))], [(words.mix(hashed + _U(7)) >> shift).astype(np.int64)]
    for n in GRAMS:
        at = place[place + n <= stop]
        value = np.full(len(at), n, dtype=np.uint64)
        for k in range(n):
            value = (value << _U(8)) | body[at + k]
        made.append((words.mix(value) >> shift).astype(np.int64))
        owners.append(word_of[at])
    owner, unit = np.concatenate(owners), np.concatenate(made)
    order = np.argsort(owner, kind="stable")
    return unit[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sizes)))])


def _passes(column: pa.Array, limit: int = 3_000_000) -> Iterator[tuple]:
    """(texts' first words, number of each word's form, units of the forms, where each form's begin) per pass."""
    for _, offsets, data in words.passes(column, limit):
        clean, starts, ends, texts = words.cut(offsets, data, CASED)
        hashed = words.hashes(clean, starts, ends)
        forms, first, number = np.unique(hashed, return_index=True, return_inverse=True)
        units, begins = word_units(clean, starts[first], ends[first], forms)
        again = np.zeros(len(number), dtype=bool)
        again[1:] = number[1:] == number[:-1]
        again[texts[:-1][texts[:-1] < len(number)]] = False
        number[again] = len(forms)
        yield texts, number, np.append(units, DITTO), np.append(begins, len(units) + 1)


def text_units(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct units, their shares) of each text."""
    for texts, number, units, begins in _passes(column):
        for i in range(len(texts) - 1):
            forms, times = np.unique(number[texts[i] : texts[i + 1]], return_counts=True)
            sizes = begins[forms + 1] - begins[forms]
            where = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            found = units[np.repeat(begins[forms], sizes) + where]
            distinct, back = np.unique(found, return_inverse=True)
            weight = np.bincount(back, np.repeat(times, sizes), minlength=len(distinct))
            yield distinct, (weight / max(1.0, weight.sum())).astype(np.float32)


@dataclass
class Model:
    vectors: np.ndarray  # units x size
    layer: np.ndarray  # size x 2
    bias: np.ndarray  # 2

    def probability(self, column: pa.Array) -> np.ndarray:
        """The softmax output of class 1 for each text."""
        out = []
        size = self.vectors.shape[1]
        for texts, number, units, begins in _passes(column):
            counts = np.diff(texts)
            mean = np.zeros((len(counts), size))
            if len(number):
                forms = np.add.reduceat(self.vectors[units], begins[:-1], axis=0, dtype=np.float32)
                filled = np.flatnonzero(counts)
                sums = np.add.reduceat(forms[number], texts[filled], axis=0, dtype=np.float64)
                amounts = np.add.reduceat(np.diff(begins)[number], texts[filled])
                mean[filled] = sums / amounts[:, None]
            logits = mean @ self.layer + self.bias
            out.append(labelled.sigmoid(logits[:, 1] - logits[:, 0]))
        return np.concatenate(out) if out else np.zeros(0)


def train(examples: list, counts: dict[int, int], size: int = 8, epochs: int = 12, rate: float = 0.5, seed: int = 11) -> Model:
    """Stochastic gradient descent over (label, units, shares); the step falls linearly to nought."""
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / size, 1 / size, (1 << BITS, size)).astype(np.float32)
    layer, bias = np.zeros((size, 2)), np.zeros(2)
    n = [sum(1 for label, _, _ in examples if label == c) for c in (0, 1)]
    if not all(n):
        share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros_like(vectors), layer, np.array([0.0, np.log(share / (1 - share))]))
    steps, done = epochs * len(examples), 0
    for _ in range(epochs):
        for i in random.permutation(len(examples)):
            label, units, shares = examples[i]
            step = rate * (1 - done / steps)
            done += 1
            rows = vectors[units]
            mean = shares @ rows
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max())
            error = p / p.sum()
            error[label] -= 1
            back = layer @ error
            layer -= step * np.outer(mean, error)
            bias -= step * 0.1 * error
            vectors[units] = rows - (step * 4.0) * np.outer(shares, back).astype(np.float32)
    prior = np.array([np.log(counts[c] / n[c]) for c in (0, 1)])
    return Model(vectors, layer, bias + prior)


def fit(docs: DataFrame, labels: DataFrame, unseen: Column, label: str = "quality", per_class: int = 1500) -> Model:
    """Train on at most ``per_class`` labelled documents of each class, those of ``unseen`` left out."""
    chosen, counts = labelled.sample(docs, labels, label, unseen, per_class)
    return train(labelled.collected(chosen, text_units), counts)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the ``score`` of label 1 and ``predicted``, from whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS vectors, whatever the input
    return labelled.scored(docs, lambda column: shared.value.probability(column))
