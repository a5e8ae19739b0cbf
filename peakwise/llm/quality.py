"""A quality classifier by compression.

Two zstandard dictionaries are trained, one from good and one from bad
labelled texts.  A text is compressed piece by piece with each; the difference
of the compressed sizes, divided by the length, says which text it resembles.
A logistic calibration, fitted on labelled texts that the dictionaries have
not seen, turns that difference (with the compression ratio and the length)
into a probability.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakwise.llm.common import set_aside
from peakwise.llm.sampling import fit_in_task, known_labels, sampled_texts

# The bound of the labelled sample: rows of each class, and characters of all texts together.
SAMPLE_ROWS = 6000
SAMPLE_CHARS = 100_000_000
PIECE_BYTES = 2048
DICTIONARY_BYTES = 64 * 1024
TRAINING_BYTES = 100 * DICTIONARY_BYTES  # pieces a dictionary is trained on
LEVEL = 3
FRAME_BYTES = 6  # what every piece costs before its content


def _pieces(data: bytes) -> list[bytes]:
    return [data[i:i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]


def _dictionary(texts: list[str], training_bytes: int = TRAINING_BYTES) -> bytes:
    """A trained dictionary; the plain text where there is too little to train on.

    Of more than ``training_bytes`` of text, pieces at equal distances through all texts are taken.
    """
    samples = [piece for text in texts for piece in _pieces(text.encode("utf-8", "replace"))]
    room = max(1, training_bytes // PIECE_BYTES)
    if len(samples) > room:
        samples = [samples[i * len(samples) // room] for i in range(room)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, d=8, k=256, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


class _Sizes:
    """Compressed-size features of texts under the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.pair = []
        for data in (good, bad):
            loaded = zstandard.ZstdCompressionDict(data)
            loaded.precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(
                dict_data=loaded, level=LEVEL, write_content_size=False, write_dict_id=False))

    def of(self, text: str) -> tuple[float, float, float]:
        data = text.encode("utf-8", "replace")
        by_good = by_bad = 0
        for piece in _pieces(data):
            by_good += len(self.pair[0].compress(piece)) - FRAME_BYTES
            by_bad += len(self.pair[1].compress(piece)) - FRAME_BYTES
        n = max(len(data), 1)
        return (by_bad - by_good) / n, by_good / n, float(np.log1p(len(data)))


def _terms(features: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The calibration's terms: difference, ratio and length with their products and cubes."""
    a, b, n = np.clip((features - mean) / scale, -4, 4).T
    return np.column_stack([np.ones(len(a)), a, b, n, a * a, b * b, a * b, a * n, b * n, n * n, a ** 3, b ** 3])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-5, least: float = 0.1) -> np.ndarray:
    """Newton steps for a logistic regression; ``least`` keeps small samples from being fitted too closely."""
    w, penalty = np.zeros(x.shape[1]), (ridge * len(y) + least) * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_compression(labels: list[int], texts: list[str], share_good: float, training_bytes: int = TRAINING_BYTES) -> bytes:
    """The pickled model: dictionaries of each class, and the calibration.

    The calibration sees every text with dictionaries made from the other half
    of the sample.  ``share_good``: the share of good texts among all labelled
    ones, which the sample (taken per class) need not have; the intercept is
    moved to it.
    """
    halves: dict[int, tuple[list[str], list[str]]] = {0: ([], []), 1: ([], [])}
    for label, text in zip(labels, texts):
        halves[label][len(halves[label][0]) > len(halves[label][1])].append(text)
    if not all(halves[c][0] and halves[c][1] for c in (0, 1)):
        return pickle.dumps({"constant": share_good})
    features, truth = [], []
    for seen in (0, 1):
        pair = [_dictionary(halves[c][seen], training_bytes) for c in (1, 0)]
        if min(map(len, pair)) < 8:
            return pickle.dumps({"constant": share_good})
        sizes = _Sizes(*pair)
        for c in (0, 1):
            features += [sizes.of(t) for t in halves[c][1 - seen]]
            truth += [c] * len(halves[c][1 - seen])
    x, y = np.array(features), np.array(truth, dtype=float)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    weights = _logistic(_terms(x, mean, scale), y)
    weights[0] += np.log(share_good / (1 - share_good)) - np.log(y.mean() / (1 - y.mean()))
    good, bad = (_dictionary(halves[c][0] + halves[c][1], training_bytes) for c in (1, 0))
    return pickle.dumps({"good": good, "bad": bad, "mean": mean, "scale": scale, "weights": weights})


def fit_quality(
    docs: DataFrame, labels: DataFrame, column: str = "quality", rows_per_class: int = SAMPLE_ROWS, max_chars: int = SAMPLE_CHARS,
    training_bytes: int = TRAINING_BYTES,
) -> bytes:
    """A model fitted on a bounded sample of the labelled texts.

    The bounds: ``rows_per_class`` texts of each class, first by hash; ``max_chars`` characters of all of them, of which
    the texts that do not fit are left out; ``training_bytes`` of pieces for a dictionary, dealt over all texts kept.
    """
    known = known_labels(labels, column)
    n_good, n = known.agg(F.sum("label"), F.count(F.lit(1))).first()
    share = ((n_good or 0) + 0.5) / (n + 1.0)
    sample = sampled_texts(docs, *[(known.filter(F.col("label") == c), c, rows_per_class) for c in (0, 1)])
    return fit_in_task(sample, partial(fit_compression, share_good=share, training_bytes=training_bytes), 2 * rows_per_class, max_chars)


def score_quality(docs: DataFrame, model: bytes, out: str = "score") -> DataFrame:
    """``docs`` plus ``out``, the probability that the text is good.

    Whole texts count, piece by piece.  NULL and empty texts get the score of
    a text without content; without labels of both classes every score is the
    share of good ones (0.5 without any label).  A column called ``out`` is replaced.
    """

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fitted = pickle.loads(model)
        sizes = None if "constant" in fitted else _Sizes(fitted["good"], fitted["bad"])
        for texts in batches:  # one text at a time: a batch never stands in memory as Python strings
            if sizes is None or not len(texts):
                yield pa.array([fitted.get("constant", 0.5)] * len(texts), type=pa.float64())
                continue
            features = np.array([sizes.of(t.as_py() or "") for t in texts])
            raw = _terms(features, fitted["mean"], fitted["scale"]) @ fitted["weights"]
            yield pa.array(1 / (1 + np.exp(-np.clip(raw, -30, 30))))

    return docs.withColumn(out, score(F.col("text")))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with the columns of ``docs``."""
    renamed, back = set_aside(docs, ["quality_score"])
    scored = score_quality(renamed, fit_quality(docs, labels), "quality_score")
    return scored.filter(F.col("quality_score") >= threshold).select(*back)
