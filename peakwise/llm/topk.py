"""Exact top-k search by distributed histogram selection.

Queries go in blocks of bounded size; a block meets every candidate.  For each
query the range of possible scores is narrowed by rounds: every task counts
its scores in the bins of the query's current range, the counts are summed,
and the bin that holds the k-th best score becomes the next range, until the
k-th value is known.  A last pass keeps what reaches it; ties go to the
smaller id.  A task reports no bin below the one in which it has itself seen k
scores: the k-th best of all cannot lie lower.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from peakwise.llm.common import stored

# Vectors of one query block (its bound), candidates scored at once, bits of the range a round resolves.
QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 2048
ROUND_BITS = 10
EXACT = float(1 << 53)  # products of norms below this have exact scores as doubles
BOUND = 1 << 61  # scores beyond count as this


def _exact_scores(queries: np.ndarray, candidates: np.ndarray, found: np.ndarray) -> None:
    """Scores of pairs too large for doubles, by whole numbers, in place."""
    reach = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(candidates, axis=1)[None, :]
    rows, at = np.nonzero(reach >= EXACT)
    wide_q = {i: [int(x) for x in queries[i]] for i in set(rows.tolist())}
    wide_c = {i: [int(x) for x in candidates[i]] for i in set(at.tolist())}
    for i, j in zip(rows.tolist(), at.tolist()):
        found[i, j] = max(-BOUND, min(BOUND, sum(a * b for a, b in zip(wide_q[i], wide_c[j]))))


def integer_vectors(df: DataFrame, scale: float = 256.0) -> DataFrame:
    """``vec_id, vector`` with ``floor(scale * x)`` of each component, x as double.

    Rows whose id or vector is NULL, or whose vector holds a NULL or a value
    that is not finite, are left out.  Values beyond the range of a long count as its end.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    usable = df.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"),
                         F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")).alias("vector"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros, components beyond ``width`` (zeros in every query) are left off."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out, start = np.zeros((len(lengths), width)), 0
    for i, n in enumerate(lengths):
        out[i, :min(n, width)] = flat[start:start + min(n, width)]
        start += n
    return out


class _Block:
    """A block of queries: ids, vectors, and the range that holds each k-th best score."""

    def __init__(self, rows: list, k: int, norm: float):
        self.ids = np.array([r["vec_id"] for r in rows], dtype=np.int64)
        self.width = max(len(r["vector"]) for r in rows)
        self.vectors = np.zeros((len(rows), self.width))
        for i, row in enumerate(rows):
            self.vectors[i, :len(row["vector"])] = row["vector"]
        self.k = k
        # No score is further from 0 than the product of the norms.
        reach = int(min(np.ceil(np.sqrt((self.vectors ** 2).sum(axis=1).max()) * norm * (1 + 1e-9)), BOUND)) + 1
        self.shift = max(0, (2 * reach + 1).bit_length() - ROUND_BITS)
        self.low = np.full(len(rows), -reach, dtype=np.int64)

    def scores(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, queries x candidates scores); a query's own row gets the lowest number."""
        for start in range(0, batch.num_rows, CANDIDATE_BLOCK):
            part = batch.slice(start, CANDIDATE_BLOCK)
            ids = part.column(0).to_numpy()
            candidates = _matrix(part.column(1), self.width)
            raw = self.vectors @ candidates.T
            found = np.clip(raw, -EXACT, EXACT).astype(np.int64)
            if part.num_rows and np.abs(candidates).max(initial=0) * np.abs(self.vectors).max(initial=0) * self.width >= EXACT:
                _exact_scores(self.vectors, candidates, found)
            order = np.argsort(self.ids, kind="stable")
            at = np.searchsorted(self.ids[order], ids)
            own = (at < len(order)) & (self.ids[order[np.minimum(at, len(order) - 1)]] == ids)
            found[order[at[own]], np.flatnonzero(own)] = np.iinfo(np.int64).min
            yield ids, found


def _count(candidates: DataFrame, block: _Block) -> DataFrame:
    """``query, bin, n``: scores per bin of each query's range (the last bin also holds what lies above)."""
    bins = 1 << ROUND_BITS

    def run(batches):
        counts = np.zeros((len(block.ids), bins), dtype=np.int64)
        for batch in batches:
            for _, found in block.scores(batch):
                place = np.minimum((found - block.low[:, None]) >> block.shift, bins - 1)
                usable = (found >= block.low[:, None])
                rows = np.broadcast_to(np.arange(len(block.ids))[:, None] * bins, found.shape)
                counts += np.bincount((rows + place)[usable], minlength=counts.size).reshape(counts.shape)
        better = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        query, place = np.nonzero((counts > 0) & (better < block.k))
        yield pa.RecordBatch.from_arrays(
            [pa.array(query.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(counts[query, place])], ["query", "bin", "n"])

    return candidates.mapInArrow(run, "query int, bin int, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))


def _narrow(block: _Block, counted: DataFrame) -> bool:
    """Moves each query's range to the bin with its k-th best score; True once all are single values.

    The driver sees one row per query of the block.
    """
    down = W.partitionBy("query").orderBy(F.col("bin").desc()).rowsBetween(W.unboundedPreceding, -1)
    reached = counted.withColumn("better", F.coalesce(F.sum("n").over(down), F.lit(0)))
    picked = reached.filter(F.col("better") < block.k).groupBy("query").agg(F.min("bin").alias("bin"))
    lowest = np.zeros(len(block.ids), dtype=np.int64)  # fewer than k candidates: the range stays at its lower end
    for query, place in picked.collect():
        lowest[query] = place
    block.low = block.low + (lowest << block.shift)
    done = block.shift == 0
    block.shift = max(0, block.shift - ROUND_BITS)
    return done


def _reaching(candidates: DataFrame, block: _Block) -> DataFrame:
    """Each task's best k candidates per query among those that reach the k-th best score."""

    def run(batches):
        n, k = len(block.ids), block.k
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n
        for batch in batches:
            for ids, found in block.scores(batch):
                floor = np.maximum(block.low, np.iinfo(np.int64).min + 1)
                for query in np.flatnonzero((found >= floor[:, None]).any(axis=1)):
                    hit = np.flatnonzero(found[query] >= floor[query])
                    score = np.concatenate([best[query][0], found[query, hit]])
                    number = np.concatenate([best[query][1], ids[hit]])
                    order = np.lexsort((number, -score))[:k]
                    best[query] = score[order], number[order]
        sizes = [len(s) for s, _ in best]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(block.ids, sizes)), pa.array(np.concatenate([i for _, i in best])), pa.array(np.concatenate([s for s, _ in best]))],
            ["query_id", "vec_id", "score"])

    return candidates.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best integer inner products of each query.

    ``vectors`` as from ``integer_vectors``; a query meets every row with
    another id (all results, if fewer than k).  Repeated candidate rows count
    one by one; a query id that repeats is asked once, with its smallest
    vector.  A shorter vector counts as followed by zeros.  Without queries or
    candidates the result is empty.  Scores are exact; beyond 2^61 they count as 2^61.
    """
    vectors = vectors.select("vec_id", "vector")
    squares = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    norm = vectors.agg(F.max(F.sqrt(squares))).first()[0] or 0.0
    queries = stored(vectors.filter(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector")), "topk-queries")
    # Queries are numbered by hash into as many blocks as keep each near half of QUERY_BLOCK.
    blocks = max(1, -(-2 * queries.count() // QUERY_BLOCK))
    found = None
    for number in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).orderBy("vec_id").collect()
        if not rows:
            continue
        block = _Block(rows, k, norm)
        while not _narrow(block, _count(vectors, block)):
            pass
        part = _reaching(vectors, block)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
