"""Toxicity: a factorization machine over hashed terms.

The terms of a document are its distinct words (ASCII letters, digits and all beyond ASCII, A-Z lower-cased) and
the first five bytes of longer ones, hashed to 24 bits. The machine adds a weight per term and, for every pair of
terms, the product of their factor vectors, so it learns that two terms together mean more than each alone.
It is trained by numpy gradient descent with per-weight steps (AdaGrad) on a bounded and balanced sample of
labelled documents (``per_class`` of each class); terms of fewer than ``least`` sampled documents have no weight.
All others have a weight and factors, also those equally common in both classes, which may tell only together;
the closer the shares are below ``apart_by`` standard errors, the smaller are a term's steps, so chance is not learned.

Defined cases: null and empty texts have no terms and so the bias's score; without labels of both classes the
score is the share of label 1 among them, one half without any; rows map one to one, so repeated rows, extra
columns and empty tables come through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import labelled, words
from .staging import set_aside

BITS = 24
PREFIX = 5
_U = np.uint64


def _terms(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(text number, term) of every word and prefix, and the number of texts, per pass."""
    shift = _U(64 - BITS)
    for _, offsets, data in words.passes(column):
        clean, starts, ends, texts = words.cut(offsets, data, words.LETTERS)
        n = len(offsets) - 1
        of = np.repeat(np.arange(n), np.diff(texts))
        whole = words.hashes(clean, starts, ends)
        long = np.flatnonzero(ends - starts > PREFIX)
        heads = words.hashes(clean, starts[long], starts[long] + PREFIX) + _U(1)
        terms = words.mix(np.concatenate([whole, heads])) >> shift
        yield np.concatenate([of, of[long]]), terms.astype(np.int64), n


def text_terms(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct terms, ones) of each text."""
    for of, terms, n in _terms(column):
        keys = np.unique(of << BITS | terms)
        stops = np.searchsorted(keys, np.arange(n + 1) << BITS)
        for i in range(n):
            own = keys[stops[i] : stops[i + 1]] & ((1 << BITS) - 1)
            yield own, np.ones(len(own), dtype=np.float32)


@dataclass
class Model:
    terms: np.ndarray  # ascending
    weights: np.ndarray
    factors: np.ndarray  # terms x size
    bias: float

    def probability(self, column: pa.Array) -> np.ndarray:
        out = []
        listed = np.zeros(1 << BITS, dtype=bool)
        listed[self.terms] = True
        for of, terms, n in _terms(column):
            kept = listed[terms]
            keys = np.unique(of[kept] << BITS | terms[kept])
            of, number = keys >> BITS, np.searchsorted(self.terms, keys & ((1 << BITS) - 1))
            linear = np.bincount(of, self.weights[number], minlength=n)
            pairs = np.zeros(n)
            for factor in self.factors.T:
                value = factor[number]
                pairs += np.bincount(of, value, minlength=n) ** 2 - np.bincount(of, value * value, minlength=n)
            out.append(labelled.sigmoid(self.bias + linear + 0.5 * pairs))
        return np.concatenate(out) if out else np.zeros(0)


def train(
    examples: list, counts: dict[int, int], size: int = 4, epochs: int = 10, rate: float = 0.1, decay: float = 2e-4, least: int = 4, apart_by: float = 3.0, factor_rate: float = 0.01,
    factor_spread: float = 0.01, seed: int = 5, care: tuple[float, float] = (100.0, 10.0),
) -> Model:
    """Each step sees a random share of its document's terms, so that no term leans on others to carry the label.

    ``care`` is what the squared steps of weights and factors start with for terms of equal shares in both classes.
    """
    n = [sum(1 for label, _, _ in examples if label == c) for c in (0, 1)]
    if not all(n):
        share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        empty = np.zeros(0, dtype=np.int64)
        return Model(empty, np.zeros(0), np.zeros((0, size)), float(np.log(share / (1 - share))))
    every = np.concatenate([t for _, t, _ in examples])
    terms, number = np.unique(every, return_inverse=True)
    toxic = np.repeat([label for label, _, _ in examples], [len(t) for _, t, _ in examples])
    ones = np.bincount(number, toxic, minlength=len(terms))
    documents = np.bincount(number, minlength=len(terms))
    share = documents / sum(n)
    spread = np.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1])) + 1e-12
    apart = np.abs(ones / n[1] - (documents - ones) / n[0]) / spread
    kept = documents >= least
    terms = terms[kept]
    alike = np.clip(1 - (apart[kept] / apart_by) ** 2, 0, 1)
    held = []
    for label, own, _ in examples:
        at = np.searchsorted(terms, own)
        at[at == len(terms)] = 0
        held.append((label, at[terms[at] == own] if len(terms) else at[:0]))
    random = np.random.default_rng(seed)
    weights, factors, bias = np.zeros(len(terms)), random.normal(0, factor_spread, (len(terms), size)), 0.0
    steps_w, steps_f, step_b = 1e-2 + care[0] * alike, np.repeat(1e-2 + care[1] * alike[:, None], size, axis=1), 1e-2
    for _ in range(epochs):
        for i in random.permutation(len(held)):
            label, own = held[i]
            own = own[random.random(len(own)) < random.uniform(0.3, 1.0)]
            rows = factors[own]
            total = rows.sum(axis=0)
            score = bias + weights[own].sum() + 0.5 * float((total**2 - (rows**2).sum(axis=0)).sum())
            error = float(labelled.sigmoid(np.array(score))) - label
            if abs(error) < 1e-3:
                continue
            grad = error + decay * weights[own]
            steps_w[own] += grad * grad
            weights[own] -= rate * grad / np.sqrt(steps_w[own])
            grad = np.clip(error * (total - rows), -1, 1) + decay * rows
            steps_f[own] += grad * grad
            factors[own] = rows - factor_rate * grad / np.sqrt(steps_f[own])
            step_b += error * error
            bias -= rate * error / np.sqrt(step_b)
    prior = np.log(counts[1] / n[1]) - np.log(counts[0] / n[0])
    return Model(terms, weights, factors, float(bias + prior))


def fit(docs: DataFrame, labels: DataFrame, unseen: Column, label: str = "toxic", per_class: int = 2500, **training) -> Model:
    """Train on at most ``per_class`` labelled documents of each class, those of ``unseen`` left out."""
    chosen, counts = labelled.sample(docs, labels, label, unseen, per_class)
    return train(labelled.collected(chosen, text_terms), counts, **training)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the ``score`` of label 1 and ``predicted``, from whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # terms of the bounded sample only
    return labelled.scored(docs, lambda column: shared.value.probability(column))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` that are not predicted toxic, with their own columns."""
    own, back = set_aside(docs, ["score", "predicted"])
    return classify(own, model).filter(F.col("predicted") == 0).select(*(F.col(c).alias(back.get(c, c)) for c in own.columns))
