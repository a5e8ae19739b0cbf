"""Embedding whitening by spectrum slicing.

Sums and centred second moments of the integer vectors are added up exactly by
the tasks, so the covariance has no cancellation.  Of the leading eigenvalues
each is isolated by bisection: the signs of the diagonal of an LDL^T
factorisation of the shifted covariance count the eigenvalues above a shift.
Rayleigh quotient iteration then converges cubically inside the bracket, and
counts on both sides of the result certify its number.  Eigenvalues too close
to be told apart by counts share a bracket; their vectors are kept orthogonal.

Vectors that are NULL or hold NULL or non-finite entries take no part, nor do
vectors of another length than the most frequent one (of equally frequent ones
the longest).  Repeated rows count as often as they come.  Only components of
positive variance are returned, so constant vectors and empty tables give no rows.
Entries beyond 2^52 / 1024 are set to that bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXACT = 1 << 53  # integers up to here are exact as doubles
BOUND = 1 << 52


def usable_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector is present, finite and of the table's dimension."""
    v = F.col(vector)
    whole = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | F.abs(x).isin(float("inf")))
    kept = rows.filter(F.coalesce(whole, F.lit(False)))
    size = kept.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return kept.filter(F.size(vector) == (size["size"] if size else 0))


def integer_entries(column: pa.Array, scale: int, shift: int) -> np.ndarray:
    """floor(scale * c) + shift of a column of lists of one length, as 64-bit integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.floor(np.clip(flat * scale, -BOUND, BOUND)).astype(np.int64) + shift
    return x.reshape(len(column), -1) if len(column) else x.reshape(0, 0)


def _exact_products(y: np.ndarray) -> list[list[int]]:
    """y'y as Python integers: in doubles by blocks of rows whose sums stay exact, else entry by entry."""
    largest = max(1, int(np.abs(y).max(initial=0)))
    step = EXACT // (largest * largest)
    total = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    if step < 1:
        for row in y.astype(object):
            total += np.multiply.outer(row, row)
    else:
        for i in range(0, len(y), step):
            part = y[i:i + step].astype(np.float64)
            total += (part.T @ part).astype(np.int64).astype(object)
    return total


def _add_up(df: DataFrame, partial) -> dict[int, list[int]]:
    """Lists of exact integers by number, added over all rows of ``df``.

    ``partial`` turns a batch into {number: integers}; a task hands on one row a number, and the rows of a number are
    added in one task, so the driver gets one row a number.
    """
    def first(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, values in partial(batch).items():
                held[key] = held[key] + values if key in held else values
        yield from rows(held)

    def rows(held):
        for key, values in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([[str(int(v)) for v in values]], pa.list_(pa.string()))],
                                             ["number", "values"])

    def second(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, values in zip(batch.column("number").to_pylist(), batch.column("values").to_pylist()):
                values = np.array([int(v) for v in values], dtype=object)
                held[key] = held[key] + values if key in held else values
        yield from rows(held)

    schema = "number int, values array<string>"
    sums = df.mapInArrow(first, schema).repartition(F.col("number")).mapInArrow(second, schema)
    return {r["number"]: [int(v) for v in r["values"]] for r in sums.collect()}


class Moments:
    """n, the exact sums S, and the exact integer matrix n^2 times the covariance."""

    def __init__(self, rows: DataFrame, vector: str, scale: int, shift: int):
        at = rows.columns.index(vector)

        def sums(batch):
            if not batch.num_rows:
                return {}
            x = integer_entries(batch.column(at), scale, shift)
            # 512 entries below 2^53 add up in 64 bits.
            return {0: np.concatenate([[len(x)], sum(x[i:i + 512].sum(0).astype(object) for i in range(0, len(x), 512))])}

        found = _add_up(rows, sums).get(0, [0])
        self.n, self.sums = found[0], found[1:]
        d = len(self.sums)
        centre = [s // self.n for s in self.sums] if self.n else []

        def products(batch):
            if not batch.num_rows:
                return {}
            total = _exact_products(integer_entries(batch.column(at), scale, shift) - np.array(centre, dtype=np.int64))
            return dict(enumerate(total))

        moment = _add_up(rows, products) if self.n and d else {}
        rest = [s - self.n * c for s, c in zip(self.sums, centre)]
        self.scaled = [[self.n * moment[i][j] - rest[i] * rest[j] for j in range(d)] for i in range(d)]

    def covariance(self) -> np.ndarray:
        n2 = self.n * self.n
        return np.array([[v / n2 for v in row] for row in self.scaled]).reshape(len(self.sums), len(self.sums))


def eigenvalues_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues exceed ``shift``: the positive pivots of LDL^T, blocks of one or two rows, largest first."""
    a = matrix - shift * np.eye(len(matrix))
    above = 0
    bend = (1 + 17 ** 0.5) / 8  # the choice between one and two rows that bounds growth
    while len(a):
        size = np.abs(a)
        diagonal = int(np.argmax(np.diag(size)))
        r, s = np.unravel_index(int(np.argmax(size)), size.shape)
        if size[r, s] == 0:
            break
        if size[diagonal, diagonal] >= bend * size[r, s]:
            order = [diagonal]
        else:
            order = [r, s]
        rest = np.setdiff1d(np.arange(len(a)), order)
        pivot = a[np.ix_(order, order)]
        if len(order) == 1:
            above += int(pivot[0, 0] > 0)
            a = a[np.ix_(rest, rest)] - np.outer(a[rest, order[0]], a[rest, order[0]] / pivot[0, 0])
        else:
            above += 1  # such a block has a negative determinant: one eigenvalue of each sign
            side = a[np.ix_(rest, order)]
            a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(pivot, side.T)
            a = (a + a.T) / 2
    return above


def _solve(matrix: np.ndarray, shift: float, v: np.ndarray) -> np.ndarray:
    """(matrix - shift)^-1 v, with a shift moved a little where it is an eigenvalue to the last bit."""
    tiny = np.finfo(float).eps * max(np.abs(matrix).max(initial=0), 1e-300)
    for nudge in (0.0, tiny, 4 * tiny, 64 * tiny):
        try:
            out = np.linalg.solve(matrix - (shift + nudge) * np.eye(len(matrix)), v)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(out).all() and out.any():
            return out
    return v


def _refine(matrix: np.ndarray, low: float, high: float, start: np.ndarray, found: list[np.ndarray], alone: bool) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration from the middle of a bracket, away from the vectors found before."""
    def clean(v):
        for _ in range(2):
            for u in found:
                v = v - (u @ v) * u
        return v / (np.linalg.norm(v) or 1.0)

    v, shift = clean(start), (low + high) / 2
    norm = np.abs(matrix).sum(1).max()
    for step in range(60):
        v = clean(_solve(matrix, shift, v))
        value = float(v @ matrix @ v)
        residual = np.linalg.norm(matrix @ v - value * v)
        if residual <= 4 * np.finfo(float).eps * norm:
            break
        # Outside its bracket the iteration would go to another eigenvalue: it stays at the middle until it is inside.
        shift = value if step > 0 and low < value < high and (residual < (high - low) / 4 or not alone) else (low + high) / 2
    return value, v


def leading_components(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest positive eigenvalues, falling, and their unit eigenvectors as rows.

    The largest entry of each vector is positive.
    """
    d = len(covariance)
    if not d:
        return np.zeros(0), np.zeros((0, 0))
    matrix = (covariance + covariance.T) / 2
    radius = np.abs(matrix).sum(1).max()
    eps = np.finfo(float).eps
    floor = d * eps * radius
    k = min(k, eigenvalues_above(matrix, floor))
    counts: dict[float, int] = {floor: eigenvalues_above(matrix, floor), radius * (1 + 8 * eps): 0}

    def count(shift: float) -> int:
        if shift not in counts:
            counts[shift] = eigenvalues_above(matrix, shift)
        return counts[shift]

    rng = np.random.default_rng(1)
    values: list[float] = []
    vectors: list[np.ndarray] = []
    while len(values) < k:
        done = len(values)
        # The tightest known shifts around eigenvalue number done + 1.
        low = max(s for s, c in counts.items() if c > done)
        high = min(s for s, c in counts.items() if c <= done and s > low)
        # Isolated: exactly one eigenvalue inside, and the bracket is small beside its distance from zero.
        while (count(low) - count(high) > 1 or high - low > high / 8) and high - low > 64 * eps * radius:
            middle = (low + high) / 2
            if count(middle) > done:
                low = middle
            else:
                high = middle
        inside = min(count(low), k) - done
        for _ in range(max(1, inside)):
            value, v = _refine(matrix, low, high, rng.standard_normal(d), vectors, inside == 1)
            values.append(value)
            vectors.append(v)
        if inside == 1:
            slack = 256 * d * eps * radius
            if not (count(values[-1] - slack) >= done + 1 and count(values[-1] + slack) <= done):
                raise ArithmeticError(f"eigenvalue {done + 1} is not certified by its counts")
    order = np.argsort(-np.array(values), kind="stable")
    values_out = np.array(values)[order]
    out = np.array(vectors).reshape(len(values), d)[order]
    signs = np.sign(out[np.arange(len(out)), np.abs(out).argmax(1)]) if len(out) else np.ones(0)
    return values_out, out * signs[:, None]


def whiten(rows: DataFrame, vector: str = "embedding", k: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """``rows`` with a usable vector, once for each component (``vector`` is dropped), plus the columns

    ``component`` (from 1), ``n``, ``deviation`` (sum of (n*x - S)^2, NULL where it does not fit a long),
    ``deviation_text`` (the same as digits, always), ``whitened``, ``explained`` and ``identity_error``.
    Columns of these names are replaced.
    """
    rows = rows.drop("component", "n", "deviation", "deviation_text", "whitened", "explained", "identity_error")
    usable = usable_vectors(rows, vector)
    moments = Moments(usable.select(vector), vector, scale, shift)
    n, sums = moments.n, moments.sums
    covariance = moments.covariance()
    values, vectors = leading_components(covariance, k)
    k = len(values)
    schema = T.StructType([f for f in rows.schema.fields if f.name != vector] + T._parse_datatype_string(
        "component int, n long, deviation long, deviation_text string, whitened double, explained double").fields)
    if not k:
        return rows.sparkSession.createDataFrame([], schema).withColumn("identity_error", F.lit(None).cast("double"))
    explained = values / np.trace(covariance)
    project = vectors / np.sqrt(values)[:, None]
    at = rows.columns.index(vector)

    def centred(x: np.ndarray) -> np.ndarray:
        """n*x - S, as 64-bit integers where they fit."""
        bound = n * int(np.abs(x).max(initial=0)) + max(abs(s) for s in sums)
        return x * n - np.array(sums, dtype=np.int64) if bound < 1 << 63 else x.astype(object) * n - np.array(sums, dtype=object)

    def whitened(dev: np.ndarray) -> np.ndarray:
        return dev.astype(np.float64) / n @ project.T

    def deviations(dev: np.ndarray) -> list[int]:
        largest = int(np.abs(dev).max(initial=0))
        if dev.dtype == object or dev.shape[1] * largest * largest >= 1 << 63:
            dev = dev.astype(object)
        return [int(v) for v in (dev * dev).sum(1)]

    def moments_of_whitened(batches):
        first, second, seen = np.zeros(k), np.zeros((k, k)), 0
        for batch in batches:
            if batch.num_rows:
                w = whitened(centred(integer_entries(batch.column(0), scale, shift)))
                first += w.sum(0)
                second += w.T @ w
                seen += len(w)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(k + 1), pa.int32()), pa.array([first.tolist(), *second.tolist()], pa.list_(pa.float64()))],
                                             ["number", "values"])

    parts = usable.select(vector).mapInArrow(moments_of_whitened, "number int, values array<double>")
    added = parts.select("number", F.posexplode("values").alias("at", "v")).groupBy("number", "at").agg(F.sum("v").alias("v"))
    got = np.zeros((k + 1, k))
    for r in added.collect():  # (k + 1) * k rows
        got[r["number"], r["at"]] = r["v"]
    mean = got[0] / n
    error = float(np.abs(got[1:] / n - np.outer(mean, mean) - np.eye(k)).max())

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                dev = centred(integer_entries(batch.column(at), scale, shift))
                w, exact = whitened(dev), deviations(dev)
                again = pa.array(np.repeat(np.arange(batch.num_rows), k))
                kept = [c.take(again) for i, c in enumerate(batch.columns) if i != at]
                new = [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)), pa.array(np.full(batch.num_rows * k, n, dtype=np.int64)),
                       pa.array([v if v < 1 << 63 else None for v in exact], pa.int64()).take(again), pa.array(list(map(str, exact)), pa.string()).take(again),
                       pa.array(w.reshape(-1)), pa.array(np.tile(explained, batch.num_rows))]
                yield pa.RecordBatch.from_arrays([*kept, *new], schema.names)

    return usable.mapInArrow(run, schema).withColumn("identity_error", F.lit(error))
