"""Whitening against numpy's own eigenvectors and exact integers."""

import math

import numpy as np
import pytest

from peakwise.llm import queries, whitening


def plain(vectors):
    """x, its integer sums, eigenvalues (falling) and vectors of its covariance."""
    x = [[math.floor(1024.0 * float(np.float32(c))) + 100000 for c in v] for v in vectors]
    sums = [sum(column) for column in zip(*x)]
    centred = np.array([[(a * len(x) - s) / len(x) for a, s in zip(v, sums)] for v in x])
    values, vecs = np.linalg.eigh(centred.T @ centred / len(x))
    return x, sums, centred, values[::-1], vecs.T[::-1]


def check(rows, got, vectors, k=8, tolerance=1e-9):
    x, sums, centred, values, vecs = plain(vectors)
    n, k = len(x), min(k, int((values > 1e-9 * values[0]).sum()))
    assert len(got) == len(rows) * k
    assert {r["component"] for r in got} == set(range(1, k + 1)) and {r["n"] for r in got} == {n}
    deviation = {i: sum((n * a - s) ** 2 for a, s in zip(v, sums)) for (i, _), v in zip(rows, x)}
    at = {i: c for (i, _), c in zip(rows, centred)}
    signs = {}
    for r in got:
        c = r["component"] - 1
        assert r["deviation"] == deviation[r["vec_id"]]
        assert r["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-9)
        assert r["identity_error"] < 1e-9
        want = at[r["vec_id"]] @ vecs[c] / math.sqrt(values[c])
        if abs(want) > 1e-3:
            sign = signs.setdefault(c, np.sign(want * r["whitened"]))
            assert r["whitened"] * sign == pytest.approx(want, abs=tolerance)


def test_query(spark, tmp_path):
    rng = np.random.default_rng(3)
    mix = rng.standard_normal((12, 12))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate((rng.standard_normal((200, 12)) @ mix / 5).astype(np.float32))]
    odd = [(900, None), (901, [0.1, None] * 6), (902, [float("nan")] * 12), (903, [float("-inf")] * 12), (904, []), (905, [0.5] * 3), (None, rows[0][1]), (7, rows[7][1])]
    spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.QUERIES["op13_whiten_embeddings"](spark, str(tmp_path))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    used = rows + odd[-2:]
    check(used, got.collect(), [v for _, v in used])


def test_few_dimensions_clashes_and_huge_entries(spark):
    schema = "vec_id long, embedding array<float>, component string, number int"
    low = [(i, [float(i % 7), 2.0 * (i % 7), 0.25], "c", i) for i in range(30)]
    got = whitening.whiten(spark.createDataFrame(low, schema))
    assert got.columns[:2] == ["vec_id", "number"] and {r["component"] for r in got.collect()} == {1}
    check([(r[0], r[1]) for r in low], got.collect(), [r[1] for r in low])
    huge = low + [(99, [1e38, -1e38, 3.0], None, None)]
    rows = whitening.whiten(spark.createDataFrame(huge, schema)).collect()
    assert {r["vec_id"] for r in rows} == {r[0] for r in huge} and all(r["deviation"] is None or str(r["deviation"]) == r["deviation_text"] for r in rows)


def test_nothing_to_whiten(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5, 0.5])], [(i, [0.5, 0.5]) for i in range(9)]):
        got = whitening.whiten(spark.createDataFrame(rows, schema))
        assert got.count() == 0 and "identity_error" in got.columns


@pytest.mark.parametrize("kind", ["random", "equal", "close", "low rank", "tiny"])
def test_slicing(kind):
    rng = np.random.default_rng(5)
    turn = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    values = {"random": rng.random(40), "equal": np.full(40, 3.0), "close": np.array([5, 5, 5, 4, 4 - 1e-13, 3, 2, 1] + [0.1] * 32),
              "low rank": np.array([2.0, 1.0] + [0.0] * 38), "tiny": rng.random(40) * 1e-12}[kind]
    matrix = turn @ np.diag(values) @ turn.T
    found, vectors = whitening.leading_components(matrix, 8)
    want = np.sort(values)[::-1][:8]
    want = want[want > 1e-20]
    assert len(found) == len(want) and np.allclose(found, want, rtol=1e-12)
    assert np.abs(vectors @ vectors.T - np.eye(len(found))).max() < 1e-12
    assert np.abs(vectors @ matrix - found[:, None] * vectors).max() < 1e-13 * max(want)
    for shift in rng.random(20) * want[0]:
        assert whitening.eigenvalues_above(matrix, shift) == (np.linalg.eigvalsh(matrix) > shift).sum()
