"""Exact top-k search against sorting all scores."""

import math
import random

from pyspark.sql import functions as F

from peakwise.llm import topk


def check(spark, rows, k=3, every=5):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    usable = frame.collect()
    kept = [(r[0], [math.floor(256.0 * x) for x in r[1]]) for r in usable
            if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    want = []
    for query in sorted({i for i, _ in kept if i % every == 0}):
        q = min(v for i, v in kept if i == query)
        best = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in kept if i != query)[:k]
        want += [(query, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    got = topk.top_k(topk.integer_vectors(frame), F.col("vec_id") % every == 0, k=k)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_random_with_ties_and_bad_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(80)]
    rows += [(100 + i, [0.5] * 8) for i in range(40)]  # ties
    rows += [(200, None), (201, [0.1, None] * 4), (202, [float("nan")] * 8), (205, [float("inf")] * 8), (None, [0.1] * 8), (210, [0.2] * 3), (215, [])]
    rows += [(7, rows[7][1]), (10, [0.25] * 8)]  # repeated ids
    check(spark, rows)


def test_few_candidates_and_none(spark):
    check(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (5, [0.0, 0.0])], k=5)
    check(spark, [(0, [1.0])], k=5)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(topk.integer_vectors(empty), F.col("vec_id") % 5 == 0).count() == 0


def test_wide_range_of_scores(spark):
    rng = random.Random(2)
    check(spark, [(i, [rng.uniform(-1, 1) * 10 ** rng.randint(-3, 3) for _ in range(4)]) for i in range(60)], k=4)


def test_huge_components(spark):
    """Scores beyond doubles are whole numbers; what does not fit counts as the bound."""
    def whole(x):
        return max(-(1 << 63), min((1 << 63) - 1, math.floor(256.0 * x)))

    rng = random.Random(6)
    rows = [(i, [rng.choice([1.0, -1.0]) * rng.uniform(1, 9) * 10 ** rng.randint(0, 6) for _ in range(4)]) for i in range(30)]
    rows += [(35, [1e38, 1.0, 0.0, 0.0]), (40, [-1e38, 1e38, 2.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = {i: [int(float(whole(x))) for x in v] for i, v in rows}
    want = []
    for q in vectors:
        if q % 5 == 0:
            score = {i: max(-topk.BOUND, min(topk.BOUND, sum(a * b for a, b in zip(vectors[q], v)))) for i, v in vectors.items() if i != q}
            want += [(q, rank, i, score[i]) for rank, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:5], 1)]
    got = topk.top_k(topk.integer_vectors(frame), F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, got.collect())) == sorted(want)
