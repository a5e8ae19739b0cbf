"""Toxicity by non-negative positive-unlabelled learning.

The classifier sees confirmed toxic texts and texts without a label (those may
be toxic or not).  With the class prior ``p`` its risk is
``p * R+(toxic) + max(0, R-(unlabelled) - p * R-(toxic))``: the second term
estimates the risk on clean texts, which is never negative, so a step that
would drive it below zero is taken back.  The model is linear over hashed
words and word beginnings that are unusually frequent or rare among the toxic texts.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakwise.llm.sampling import fit_in_task, known_labels, sampled_texts

# The bound of the sample: confirmed toxic rows, rows used without their label, characters of all together.
TOXIC_ROWS = 4000
UNLABELLED_ROWS = 12000
SAMPLE_CHARS = 100_000_000
HASH_BITS = 18
EPOCHS = 200
LETTERS = r"[^\W\d_]+"


class _Features(dict):
    """Word -> ids of its hashed features; forgets all when full, so its memory is bounded."""

    def __init__(self, keep: np.ndarray | None = None, limit: int = 300_000):
        self.keep, self.limit = keep, limit

    def __missing__(self, word: str) -> tuple[int, ...]:
        names = {word, "^" + word[:4], "^" + word[:5]}
        ids = {zlib.crc32(name.encode("utf-8", "replace")) >> (32 - HASH_BITS) for name in names}
        if self.keep is not None:
            ids = {i for i in ids if self.keep[i]}
        if len(self) >= self.limit:
            self.clear()
        self[word] = found = tuple(ids)
        return found

    def of(self, text: str) -> set[int]:
        out: set[int] = set()
        for word in set(re.findall(LETTERS, text.lower())):
            if found := self[word]:
                out.update(found)
        return out


def _packed(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids end to end, the offsets of the rows, and the row of each id."""
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    ids = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
    return ids, np.concatenate([[0], np.cumsum(lengths)]), np.repeat(np.arange(len(rows)), lengths)


def _scores(weights: np.ndarray, bias: float, packed: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    running = np.concatenate([[0.0], np.cumsum(weights[packed[0]])])
    return running[packed[1][1:]] - running[packed[1][:-1]] + bias


def nn_pu_weights(
    toxic: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, size: int,
    epochs: int = EPOCHS, rate: float = 0.05, ridge: float = 1e-4,
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the logistic loss (Adam steps)."""
    p, u = _packed(toxic), _packed(unlabelled)
    weights, bias = np.zeros(size), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, epochs + 1):
        sp, su = _scores(weights, bias, p), _scores(weights, bias, u)
        clean_risk = np.logaddexp(0, su).mean() - prior * np.logaddexp(0, sp).mean()
        toward = -prior / (1 + np.exp(np.clip(sp, -30, 30))) / len(sp)
        back = -prior / (1 + np.exp(-np.clip(sp, -30, 30))) / len(sp)
        spread = 1 / (1 + np.exp(-np.clip(su, -30, 30))) / len(su)
        on_toxic, on_unlabelled = (toward + back, spread) if clean_risk >= 0 else (-back, -spread)
        gradient = np.bincount(p[0], weights=on_toxic[p[2]], minlength=size) + np.bincount(
            u[0], weights=on_unlabelled[u[2]], minlength=size) + ridge * weights
        gradient = np.append(gradient, on_toxic.sum() + on_unlabelled.sum())
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient ** 2
        move = rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
        weights, bias = weights - move[:size], bias - move[size]
    return weights, bias


def fit_toxicity_sample(marks: list[int], texts: list[str], prior: float) -> bytes:
    """The pickled model from texts marked 1 (confirmed toxic) and 0 (label not used)."""
    size, features = 1 << HASH_BITS, _Features()
    rows = [np.fromiter(features.of(t), dtype=np.int64) for t in texts]
    toxic = [r for r, m in zip(rows, marks) if m == 1]
    unlabelled = [r for r, m in zip(rows, marks) if m == 0]
    if not toxic or not unlabelled:
        return pickle.dumps({"keep": np.zeros(size, dtype=bool), "weights": np.zeros(size, dtype=np.float32), "bias": float(np.log(prior / (1 - prior)))})
    in_toxic = np.bincount(np.concatenate(toxic), minlength=size)
    in_all = np.bincount(np.concatenate(unlabelled), minlength=size)
    expected = len(toxic) * in_all / len(unlabelled)
    unusual = np.abs(in_toxic - expected) / np.sqrt(expected + 1)
    keep = (unusual > 3) & (in_toxic + in_all >= max(2, min(8, len(toxic) // 20)))
    cut = lambda found: [r[keep[r]] for r in found]
    weights, bias = nn_pu_weights(cut(toxic), cut(unlabelled), prior, size)
    return pickle.dumps({"keep": keep, "weights": np.where(keep, weights, 0.0).astype(np.float32), "bias": bias})


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, column: str = "toxic", toxic_rows: int = TOXIC_ROWS, unlabelled_rows: int = UNLABELLED_ROWS,
    max_chars: int = SAMPLE_CHARS,
) -> bytes:
    """A model from at most ``toxic_rows`` confirmed and ``unlabelled_rows`` unlabelled texts of ``max_chars`` characters together.

    Unlabelled texts are rows of ``labels`` whose label is not looked at; the
    class prior is the share of toxic rows among all of ``labels``.
    """
    known = known_labels(labels, column)
    n_toxic, n = known.agg(F.sum("label"), F.count(F.lit(1))).first()
    prior = min(max(((n_toxic or 0) + 0.5) / (n + 1.0), 1e-6), 0.95)
    sample = sampled_texts(docs, (known.filter(F.col("label") == 1), 1, toxic_rows), (known, 0, unlabelled_rows))
    return fit_in_task(sample, partial(fit_toxicity_sample, prior=prior), toxic_rows + unlabelled_rows, max_chars)


def score_toxicity(docs: DataFrame, model: bytes, out: str = "score") -> DataFrame:
    """``docs`` plus ``out``, the probability that the whole text is toxic.

    NULL and empty texts have no features and get the score of the bias alone;
    without toxic labels every score is that.  A column called ``out`` is replaced.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted = pickle.loads(model)
        weights, features = fitted["weights"].tolist(), _Features(fitted["keep"])
        for texts in batches:
            raw = [sum(weights[i] for i in features.of(t)) if t else 0.0 for t in texts]
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(raw, dtype=float) + fitted["bias"], -30, 30))), dtype=float)

    return docs.withColumn(out, score(F.col("text")))
