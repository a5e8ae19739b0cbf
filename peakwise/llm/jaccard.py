"""N-gram Jaccard join with prefix trees.

Every document is its set of distinct word n-grams (64-bit hashes).  Two
documents link when the intersection holds at least ``percent`` of the union;
the result is the connected component of each document.

1. Equal sets are one class; only classes are compared.
2. Two sets that link differ in a share of their n-grams that ``percent`` bounds.  The n-grams
   of a set are dealt by hash into three parts more than that, so at least
   three parts are equal in both; the hashes of the parts are the set's keys, and sets
   that link share a key.  (If the equal parts are all empty, both sets have
   three empty parts; such sets take part in a second dealing as well, and
   sets with three empty parts in both dealings share a key of their own.)
   Or the keys are the set's first n-grams in one global order, rare ones first (a prefix filter): sets that link
   share one of them.
   Keys are gathered before they are shuffled: of the sets of a run of rows
   that hold a key one stands for all, so a key of very many sets is no hot spot.
3. Sets that share keys, directly or through others, form groups.  A group is
   cut into blocks of bounded size, and a block is joined in a prefix tree: the
   sets, their n-grams in one order by frequency, are stored as paths, so sets
   with a common beginning share it and its overlap with a probe is counted
   once.  A subtree is left when no set in it can reach the needed overlap with
   the n-grams that remain, or when all of its sets are known to be in the
   probe's component.
4. Groups of more than one block are taken up again with what is still
   undecided: keys whose sets are in one component are done.  If a round
   brings no progress, all pairs of blocks are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from peakwise.llm.common import set_aside, stored

NGRAM = 3
PERCENT = 90
# Sets and n-grams of one block, the bound of what one task joins at a time.
BLOCK = 4096
TOKENS_AT_A_TIME = 1_000_000
BLOCK_NGRAMS = 4_000_000
# Sets of one run of rows whose keys are gathered before the shuffle.
RUN = 2048


# Bits of the table of n-gram frequencies behind the order of the prefix keys.
COUNT_BITS = 18
# Edges that one task contracts.
TASK_EDGES = 2_000_000


class Link:
    """Two sets of sizes a and b link when ``100 * shared >= percent * (a + b - shared)``, percent from 50 to 99."""

    def __init__(self, percent: int):
        self.percent = percent
        self.least = max(1, -(-percent // (100 - percent)))  # smaller sets link only with equal ones
        starts = [self.least]
        while starts[-1] < 1 << 40:
            starts.append(100 * starts[-1] // percent + 1)
        # First sizes of the bands: sizes that can link are in the same band or in neighbours.
        self.bands = np.array(starts)

    @staticmethod
    def spare(size):
        """How many more than one of the prefix keys sets share whose smaller one has at least ``size`` n-grams."""
        return size / 12 if isinstance(size, Column) else size // 12

    def most_different(self, band: int) -> int:
        """The most n-grams in which linked sets differ whose smaller one is in the band."""
        both = int(self.bands[band + 1]) - 1 + int(self.bands[band + 2]) - 1
        return both * (100 - self.percent) // (100 + self.percent)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def ngram_set(text: str | None, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct hashes of the n-grams; a shorter text is one n-gram, one without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII case and white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words))], dtype=np.uint64)
    single = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    last = len(words) - n + 1
    joined = _mix(single[:last])
    for step in range(1, n):
        joined = _mix(joined + single[step:last + step] * np.uint64(2 * step + 1))
    return np.unique(joined)


def _part_keys(tokens: np.ndarray, parts: int, salt: int) -> tuple[np.ndarray, int]:
    """Keys of the parts that hold something, and the number of empty parts."""
    spread = _mix(tokens ^ np.uint64(salt & 0xFFFF))
    part = (spread >> np.uint64(8)) % np.uint64(parts)
    order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
    part = part[order]
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    sums = np.add.reduceat(_mix(spread)[order], first)
    keys = _mix(sums + _mix(part[first] + np.uint64((salt * 0x9E3779B97F4A7C15) & (1 << 64) - 1)))
    return keys, parts - len(first)


def set_keys(tokens: np.ndarray, link: Link) -> np.ndarray:
    """Keys such that sets that link, and are not equal, share at least one."""
    if len(tokens) < link.least:
        return np.zeros(0, dtype=np.uint64)
    band = int(np.searchsorted(link.bands, len(tokens), side="right")) - 1
    out = []
    for lower in {max(band - 1, 0), band}:  # pairs whose smaller set is in that band
        parts = link.most_different(lower) + 3
        for dealing in (1, 2):
            keys, empty = _part_keys(tokens, parts, lower * 8 + dealing)
            out.append(keys)
            if empty < 3:
                break
        else:
            out.append(_mix(np.array([lower * 8 + 3], dtype=np.uint64)))
    return np.concatenate(out)


def prefix_keys(tokens: np.ndarray, link: Link, counts: np.ndarray) -> np.ndarray:
    """The first n-grams of a set in the global order, rare buckets first.

    Sets that link share one of the first ``n - least overlap + 1``; each
    further n-gram taken adds one that they share, ``spare`` of them in all.
    """
    if len(tokens) < link.least:
        return np.zeros(0, dtype=np.uint64)
    first = len(tokens) - -(-link.percent * len(tokens) // 100) + 1 + link.spare(100 * len(tokens) // link.percent + 1)
    frequency = counts[(tokens >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
    return tokens[np.lexsort((tokens, frequency))[:first]]


def bucket_counts(docs: DataFrame, n: int) -> np.ndarray:
    """How often the n-grams of each of ``2 ** COUNT_BITS`` hash buckets occur in all documents.

    The size of the table is fixed; it only decides the order of n-grams.
    """
    size = 1 << COUNT_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                tokens = ngram_set(text.as_py(), n)
                np.add.at(counts, (tokens >> np.uint64(64 - COUNT_BITS)).astype(np.int64), 1)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(counts[held])], ["bucket", "n"])

    counted = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    table = np.zeros(size, dtype=np.int64)
    for bucket, number in counted.collect():  # at most one row a bucket
        table[bucket] = number
    return table


def without_common_keys(shared: DataFrame, sizes: DataFrame, link: Link) -> DataFrame:
    """``key, class`` without each class's most common keys, as many as it can spare.

    Sets that link share one key more than either spares, so of all keys they
    share the rarest stays with both.  A class has no more keys than n-grams.
    """
    held = shared.groupBy("key").agg(F.count(F.lit(1)).alias("held"))
    common = W.partitionBy("class").orderBy(F.col("held").desc(), F.col("key").desc())
    spare = link.spare(F.floor(F.col("n_shingles") * link.percent / 100))
    ranked = shared.join(held, "key").join(sizes, "class").withColumn("place", F.row_number().over(common))
    return ranked.filter(F.col("place") > F.floor(spare)).select("key", "class")


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    values = np.concatenate(rows) if rows else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _class_id(tokens: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(tokens.tobytes())], dtype=np.uint64).view(np.int64)[0])


def row_hash() -> Column:
    """What tells rows with different ids or texts apart, ids and texts that are missing included."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")


def document_sets(docs: DataFrame, n: int = NGRAM) -> DataFrame:
    """``doc_id, n_shingles, class, row`` of each row; equal sets have the same class, equal rows the same ``row``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, classes = [], []
            for text in batch.column(1):  # one text and its set at a time
                found = ngram_set(text.as_py(), n)
                sizes.append(len(found))
                classes.append(_class_id(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, type=pa.int64()), pa.array(classes, type=pa.int64()), batch.column(2)],
                ["doc_id", "n_shingles", "class", "row"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text", row_hash()).mapInArrow(run, f"doc_id {kind}, n_shingles long, class long, row long")


def class_keys(docs: DataFrame, n: int, link: Link, counts: np.ndarray | None = None) -> DataFrame:
    """``key, class, gathered``.

    Of the classes of a run of rows that hold a key, the smallest comes with
    ``gathered`` false; if there are several, all of them come also with true.
    ``counts``: from ``bucket_counts``, for prefix keys in place of part keys.
    """
    shared = None if counts is None else docs.sparkSession.sparkContext.broadcast(counts)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if shared is None else shared.value
        seen: set[int] = set()  # classes of this task: no more than its rows
        keys: list[np.ndarray] = []
        classes: list[int] = []

        def gathered() -> pa.RecordBatch:
            key = np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)
            number = np.repeat(np.array(classes, dtype=np.int64), [len(k) for k in keys])
            order = np.lexsort((number, key))
            key, number = key[order].view(np.int64), number[order]
            first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=bool)
            group = np.cumsum(first) - 1
            several = np.bincount(group, minlength=1)[group] > 1 if len(key) else first
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([key[first], key[several]])), pa.array(np.concatenate([number[first], number[several]])),
                 pa.array(np.arange(first.sum() + several.sum()) >= first.sum())], ["key", "class", "gathered"])

        for batch in batches:
            for text in batch.column(0):
                tokens = ngram_set(text.as_py(), n)
                number = _class_id(tokens)
                if number not in seen:
                    seen.add(number)
                    keys.append(np.unique(set_keys(tokens, link) if table is None else prefix_keys(tokens, link, table)))
                    classes.append(number)
                if len(keys) >= RUN:
                    yield gathered()
                    keys.clear()
                    classes.clear()
        yield gathered()

    return docs.select("text").mapInArrow(run, "key long, class long, gathered boolean")


def shared_keys(docs: DataFrame, n: int, link: Link, prefix: bool = False) -> DataFrame:
    """``key, class``: the keys that several classes hold, by one shuffle of the gathered keys."""
    rows = class_keys(docs, n, link, bucket_counts(docs, n) if prefix else None)
    # Gathered classes are known to share their key; apart from them a key has one row per run.
    group = W.partitionBy("key", F.when(F.col("gathered"), F.col("class")).otherwise(F.lit(0)))
    several = F.col("gathered") | (F.min("class").over(group) < F.max("class").over(group))
    return rows.withColumn("several", several).filter("several").select("key", "class").distinct()


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, end to end."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class PrefixTree:
    """Sets as paths of a tree, their frequent n-grams first; a node holds a piece of a path without branches.

    Nodes are arrays in the order of levels, so that the children of a node
    and the sets below it (in the order of their paths) are ranges.
    """

    def __init__(self, sets: list[np.ndarray], known: list[int], link: Link):
        self.link = link
        every, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(every), dtype=np.int64)
        rank[np.lexsort((every, -count))] = np.arange(len(every))
        ranked = [np.sort(x) for x in np.split(rank[place], np.cumsum([len(s) for s in sets])[:-1])]
        self.order = sorted(range(len(sets)), key=lambda i: ranked[i].astype(">i8").tobytes())
        self.sets = [ranked[i] for i in self.order]
        first: dict[int, int] = {}
        self.component = np.array([first.setdefault(known[i], x) for x, i in enumerate(self.order)])
        self.mask = np.zeros(len(every), dtype=bool)
        self._build()
        self._note_changes()

    def _build(self) -> None:
        sets, n = self.sets, len(self.sets)
        common = np.zeros(n + 1, dtype=np.int64)  # length of the beginning that a set shares with the one before
        for i in range(1, n):
            shorter = min(len(sets[i - 1]), len(sets[i]))
            differ = np.flatnonzero(sets[i - 1][:shorter] != sets[i][:shorter])
            common[i] = differ[0] if len(differ) else shorter
        todo, nodes, pieces, held = [(0, n, 0)], [], [], 0
        for low, high, start in todo:  # grows while it runs: level after level
            end = len(sets[low]) if high - low == 1 else int(common[low + 1:high].min())
            ends_here = len(sets[low]) == end
            first = low + 1 if ends_here else low
            cuts = [first, *(first + 1 + np.flatnonzero(common[first + 1:high] == end)).tolist(), high] if first < high else []
            sizes = [len(x) for x in sets[low:high]] if high - low < 3 else self._sizes(low, high)
            nodes.append((held, held + end - start, end, len(todo), len(todo) + max(len(cuts) - 1, 0), low, high,
                          min(sizes), max(sizes), low if ends_here else -1))
            pieces.append(sets[low][start:end])
            held += end - start
            todo.extend((a, b, end) for a, b in zip(cuts, cuts[1:]))
        self.tokens = np.concatenate(pieces)
        (self.t0, self.t1, self.depth, self.c0, self.c1, self.l0, self.l1, self.low, self.high, self.ends) = np.array(nodes, dtype=np.int64).T

    def _sizes(self, low: int, high: int) -> np.ndarray:
        if not hasattr(self, "_lengths"):
            self._lengths = np.array([len(x) for x in self.sets])
        return self._lengths[low:high]

    def _note_changes(self) -> None:
        """Counts the places where the component changes along the sets: a range without one is of one component."""
        self.changes = np.concatenate([[0], np.cumsum(self.component[1:] != self.component[:-1])])

    def probe(self, x: int) -> None:
        """Links set ``x`` with the sets after it that it is not yet connected to."""
        tokens, percent, size = self.sets[x], self.link.percent, len(self.sets[x])
        self.mask[tokens] = True
        nodes, shared, linked = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), []
        while len(nodes):
            one = (self.changes[self.l1[nodes] - 1] == self.changes[self.l0[nodes]]) & (self.component[self.l0[nodes]] == self.component[x])
            near = (self.high[nodes] * 100 >= size * percent) & (self.low[nodes] * percent <= size * 100)
            stay = near & ~one & (self.l1[nodes] > x + 1)
            nodes, shared = nodes[stay], shared[stay]
            lengths = self.t1[nodes] - self.t0[nodes]
            hits = np.concatenate([[0], np.cumsum(self.mask[self.tokens[_ranges(self.t0[nodes], lengths)]])])
            upto = np.cumsum(lengths)
            shared = shared + hits[upto] - hits[upto - lengths]
            depth = self.depth[nodes]
            passed = np.searchsorted(tokens, self.tokens[np.maximum(self.t1[nodes] - 1, 0)], side="right")
            rest = size - np.where(depth > 0, passed, 0)
            best = np.clip(depth + rest, self.low[nodes], self.high[nodes])
            able = (100 + percent) * (shared + np.minimum(best - depth, rest)) >= percent * (size + best)
            nodes, shared, depth = nodes[able], shared[able], depth[able]
            hit = (self.ends[nodes] > x) & ((100 + percent) * shared >= percent * (size + depth))
            linked.append(self.ends[nodes[hit]])
            lengths = self.c1[nodes] - self.c0[nodes]
            nodes, shared = _ranges(self.c0[nodes], lengths), np.repeat(shared, lengths)
        self.mask[tokens] = False
        linked = np.concatenate(linked)
        if len(linked):
            labels = np.unique(np.append(self.component[linked], self.component[x]))
            if len(labels) > 1:
                self.component[np.isin(self.component, labels)] = labels[0]
                self._note_changes()


def link_block(classes: list[int], known: list[int], sets: list[np.ndarray], link: Link) -> list[int]:
    """For each set the smallest class of its component; ``known``: components found before."""
    tree = PrefixTree(sets, known, link)
    for x in range(len(sets)):
        tree.probe(x)
    smallest: dict[int, int] = {}
    label = dict(zip(tree.order, tree.component.tolist()))
    for i, number in enumerate(classes):
        smallest[label[i]] = min(smallest.get(label[i], number), number)
    return [smallest[label[i]] for i in range(len(classes))]


def _join_blocks(members: DataFrame, link: Link) -> DataFrame:
    """``a, b``: each class and the smallest class it is connected to within a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, classes, known, sets = None, [], [], []

        def finished() -> pa.RecordBatch:
            leaders = link_block(classes, known, sets, link)
            pairs = [(c, leader) for c, leader in zip(classes, leaders) if c != leader]
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], type=pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for block, number, component, tokens in zip(*[batch.column(i) for i in range(4)]):
                if block.as_py() != current:
                    if current is not None:
                        yield finished()
                    current, classes, known, sets = block.as_py(), [], [], []
                classes.append(number.as_py())
                known.append(component.as_py())
                sets.append(tokens.values.to_numpy().view(np.uint64))
        if current is not None:
            yield finished()

    placed = members.repartition("block").sortWithinPartitions("block", "class")
    return placed.select("block", "class", "component", "tokens").mapInArrow(run, "a long, b long")


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task as stars: each node and the smallest node it is connected to by them."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    stars = [(x, find(x)) for x in list(parent)]
    yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in stars], type=pa.int64()) for i in (0, 1)], ["a", "b"])


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """``node, component`` (the smallest node connected) of the undirected edges ``a, b``.

    Tasks of at most about ``task_edges`` edges turn their edges into stars.
    With several tasks, rounds follow in which a node takes the smallest label
    among itself and its neighbours, and then that label's own label, until
    nothing changes.  Labels are written to the shared folder every round; the
    driver sees one count.
    """
    edges = stored(edges.select("a", "b"), "graph-edges")
    tasks = max(1, -(-edges.count() // task_edges))
    stars = stored(edges.repartition(tasks).mapInArrow(_contract, "a long, b long"), "graph-stars")
    labels = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    if tasks == 1:
        return labels
    both = stored(stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "graph-edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "graph-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        lower = labels.join(near.select(F.col("a").alias("node"), "c"), "node").select(
            "node", "component", F.least("component", "c").alias("c"))
        jumped = lower.join(labels.select(F.col("node").alias("c"), F.col("component").alias("further")), "c").select(
            "node", F.least("c", "further").alias("component"), (F.least("c", "further") < F.col("component")).alias("changed"))
        after = stored(jumped, "graph-labels")
        labels = after.select("node", "component")
        if after.filter("changed").isEmpty():
            return labels


def _undecided(shared: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``key, class, component`` of the keys whose sets are not all in one component."""
    rows = shared.withColumn("component", F.col("class"))
    if labels is not None:
        rows = shared.join(labels.withColumnRenamed("node", "class"), "class", "left").select(
            "key", "class", F.coalesce("component", "class").alias("component"))
    split = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("class").alias("leader"))
    return rows.join(split.filter("low < high").select("key", "leader"), "key")


def jaccard_components(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT, prefix: bool = False, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``; see ``row_components``."""
    return row_components(docs, n, percent, prefix, block).select("doc_id", "n_shingles", "component_id")


def row_components(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT, prefix: bool = False, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id, component, row`` for every row of ``docs``.

    ``component_id`` is the smallest id reachable by links, the row's own
    included.  A row without words (NULL or empty text) links with nothing.
    ``prefix``: sets are grouped by the first n-grams in the global order
    instead of by parts; better where n-grams are long and ``percent`` is low.
    Both ways give the same result.  Rows with equal sets are linked, also repeated rows; rows with a NULL id link
    others, but the smallest id is that of a row that has one, NULL if none has.  ``component`` numbers the components,
    ``row`` is the hash of id and text.  Other
    columns are not looked at.  Empty tables give no rows.  N-grams and sets are told apart by 64-bit hashes.
    """
    link = Link(percent)
    sets = stored(document_sets(docs, n), "jaccard-sets")
    shared = stored(shared_keys(docs, n, link, prefix), "jaccard-shared")
    first = sets.filter("n_shingles > 0").groupBy("class").agg(
        F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.max("n_shingles").alias("n_shingles"))
    if prefix:
        shared = without_common_keys(shared, first.select("class", "n_shingles"), link)
        several = shared.groupBy("key").agg(F.count(F.lit(1)).alias("held")).filter("held > 1").select("key")
        shared = stored(shared.join(several, "key"), "jaccard-shared")
    candidates = shared.select("class").distinct()
    first = first.drop("n_shingles")
    chosen = stored(candidates.join(first.select("class", "row"), "class"), "jaccard-chosen")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, found, size = 0, [], 0
            for i, text in enumerate(batch.column(1)):
                found.append(ngram_set(text.as_py(), n))
                size += len(found[-1])
                if size >= TOKENS_AT_A_TIME or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(start, len(found)), pa.array([_class_id(t) for t in found], type=pa.int64()), _lists(found)],
                        ["class", "own", "tokens"])
                    start, found, size = i + 1, [], 0

    # Always by a merge join: how many texts are chosen grows with the data.
    texts = docs.select(row_hash().alias("row"), "text").join(chosen.hint("merge"), "row").select("class", "text")
    full = texts.mapInArrow(tokens, "class long, own long, tokens array<long>")
    # Rows may be repeated, and hashes of rows may meet: only the class's own set counts, once.
    full = stored(full.filter("class = own").dropDuplicates(["class"]).select("class", "tokens"), "jaccard-full")

    links, labels, pending, previous, pairwise = None, None, _undecided(shared, None), None, False
    while True:
        pending = stored(pending, "jaccard-undecided")
        undecided = pending.select("class").distinct().count()
        if not undecided:
            break
        pairwise = previous is not None and undecided > previous / 2
        previous = undecided
        group = components(pending.filter("class <> leader").select(F.col("class").alias("a"), F.col("leader").alias("b")))
        group = stored(group.select(F.col("node").alias("class"), F.col("component").alias("group")), "jaccard-groups")
        sized = group.join(full.select("class", F.size("tokens").alias("size")), "class")
        size = stored(sized.groupBy("group").agg(F.greatest(
            F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("size") / BLOCK_NGRAMS)).cast("int").alias("blocks")), "jaccard-sizes")
        placed = group.join(size, "group")
        place = F.pmod(F.xxhash64("class", F.lit(int(undecided))), F.col("blocks")).cast("int")
        if pairwise:  # each set meets the sets of every block
            other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
            placed = placed.withColumn("own", place).withColumn("other", other).filter("blocks = 1 OR own <> other").withColumn(
                "block", F.concat_ws("/", "group", F.least("own", "other"), F.greatest("own", "other")))
        else:
            placed = placed.withColumn("block", F.concat_ws("/", "group", place))
        known = F.col("class").alias("component") if labels is None else F.coalesce("component", "class").alias("component")
        if labels is not None:
            placed = placed.join(labels.withColumnRenamed("node", "class"), "class", "left")
        members = placed.select("block", "class", known).join(full, "class")
        found = stored(_join_blocks(members, link), "jaccard-links")
        decided = size.filter("blocks > 1").isEmpty()
        if decided and links is None:  # every set was in one block: the links are its components
            labels = found.select(F.col("a").alias("node"), F.col("b").alias("component"))
            break
        links = found if links is None else links.unionByName(found)
        labels = components(links)
        if pairwise or decided:
            break
        # Groups of one block are decided; the others are taken up again.
        open_sets = stored(placed.filter("blocks > 1").select("class").distinct(), "jaccard-open")
        pending = _undecided(shared.join(open_sets, "class", "left_semi"), labels)

    classes = first.select("class", F.col("doc_id").alias("least_id"))
    if labels is not None:
        classes = classes.join(labels.withColumnRenamed("node", "class"), "class", "left").select(
            "class", "least_id", F.coalesce("component", "class").alias("component"))
        least = classes.groupBy("component").agg(F.min("least_id").alias("component_id"))
        classes = classes.join(least, "component")
    else:
        classes = classes.select("class", F.col("class").alias("component"), F.col("least_id").alias("component_id"))
    joined = sets.join(classes.select("class", "component", "component_id"), "class", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "n_shingles", own.alias("component_id"), "component", "row")


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of each component of ``docs``, that with the smallest id, with the columns of ``docs``.

    Of rows with one id the one with the smallest hash of its text stays, of repeated rows any one; rows without an id
    come after all others.  Rows without words link with nothing and stay.
    """
    rows = stored(row_components(docs, **options).filter("n_shingles > 0"), "jaccard-rows")
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row")).alias("best"))
    kept = rows.join(best, "component").filter(F.col("row") == F.col("best.row")).groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    kept = stored(kept, "jaccard-kept")
    renamed, back = set_aside(docs, ["row_hash"])
    renamed = renamed.withColumn("row_hash", row_hash())
    gone = stored(rows.select("row").distinct().join(kept, "row", "left_anti").select(F.col("row").alias("row_hash")), "jaccard-dropped")
    again = kept.filter("n > 1").select(F.col("row").alias("row_hash"))
    left = renamed.join(gone, "row_hash", "left_anti")
    # Repeated rows are few or one hot row: they alone are looked at twice, and merged before they move.
    once = left.join(again, "row_hash", "left_anti").select(*back)
    return once.unionByName(left.join(again, "row_hash", "left_semi").dropDuplicates(["row_hash"]).select(*back))
