"""Spelling variants: words one edit apart, found by k-d trees over their letter counts.

One inserted letter moves a word's letter counts by 1 in L1 distance, one
replaced letter by exactly 2.  So a word's neighbours of the same length lie at
distance 2 and those longer by one at distance 1, and range searches with these
radii, pruned by the boxes of the trees, find every candidate.  Candidates are
then compared letter by letter.

A coarse k-d tree, split by length first, deals the words to cells; it comes
from a bounded sample of words, which decides only how even the cells are.  A
word stands in the cell of its counts and asks every cell whose box is in
reach.  Cells that hold too much, by the exact count, are dealt by hash into
parts that are all asked.  In each part a fine tree over its distinct count
vectors answers the questions.  Words with equal counts are one point there
and never meet each other; where a pair of points stands for many words, the
edited spellings are looked up instead of compared.

Letters are the code points up to U+00FF, as ``runs`` finds them; a word with
another one is near to none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakwise.llm.common import lower_ascii, stored, text_or_empty

SAMPLE = 20_000  # words the coarse tree is built from
CELL_WORDS = 6_000  # words a cell should hold
CELL_CHARS = 2_000_000
FINE = 24  # points in a leaf of a fine tree
LONG = 64  # words up to this length are compared in arrays
PAIRS = 1_000_000  # pairs of points or words compared at a time


def runs(docs: DataFrame, min_length: int = 6) -> DataFrame:
    """(doc_id, run): every maximal run of Latin letters of at least ``min_length``, A-Z in lower case.

    Missing and empty texts have none.
    """
    found = F.regexp_extract_all(lower_ascii(text_or_empty("text")), F.lit(rf"[a-zÀ-ÿ]{{{min_length},}}"), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("run"))


def drop_letter(doc_id: Column, run: Column, every: int = 199) -> Column:
    """The run, or for one in ``every`` pairs of document and run, chosen by checksum, the run without one letter."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def count_words(words: DataFrame, min_length: int = 6, min_count: int = 5) -> DataFrame:
    """(word, n) of the words of column ``word`` that are long and frequent enough."""
    counted = words.filter(F.char_length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= min_count)


def count_vectors(words: list[str]) -> np.ndarray:
    """One row a word: its length, then how often it has each of 256 letters."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    codes = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8)
    out = np.zeros((len(words), 257), dtype=np.int32)
    out[:, 0] = sizes
    np.add.at(out, (np.repeat(np.arange(len(words)), sizes), codes.astype(np.int64) + 1), 1)
    return out


def coarse_tree(vectors: np.ndarray, leaves: int) -> list[tuple]:
    """Nodes (dimension, last value that goes left, left, right), or (-1, number of the cell, 0, 0) for a cell."""
    nodes: list[tuple] = []
    cells = 0

    def grow(rows: np.ndarray, share: float) -> int:
        nonlocal cells
        mine = len(nodes)
        nodes.append(())
        part = vectors[rows]
        spread = part.max(0) - part.min(0) if len(part) else np.zeros(1)
        if share > 1 and spread.any():
            dim = 0 if spread[0] else int(np.argmax(part.var(0)))
            value = int(np.median(part[:, dim]))
            if value == part[:, dim].max():
                value -= 1
            left = part[:, dim] <= value
            on_left = left.mean()
            a = grow(rows[left], share * on_left)
            b = grow(rows[~left], share * (1 - on_left))
            nodes[mine] = (dim, value, a, b)
        else:
            nodes[mine] = (-1, cells, 0, 0)
            cells += 1
        return mine

    grow(np.arange(len(vectors)), float(leaves))
    return nodes


def reach(nodes: list[tuple], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home): the cells that may hold a word's neighbours of the same length or longer by one.

    Down the tree a row keeps what it had to give up and take on so far: a neighbour has at most one letter less
    and one more (same length), or one more only (longer).  Bounds on one dimension add up only once.
    """
    out = []
    start = np.arange(len(vectors))
    none = np.zeros(len(start), dtype=np.int8)
    # state: letters that must come and go for the box so far, whether longer by one is still / already asked for, home
    stack = [(0, start, none, none, np.ones(len(start), bool), np.ones(len(start), bool), np.ones(len(start), bool), {})]
    while stack:
        node, rows, more, less, same, longer, home, seen = stack.pop()
        if not len(rows):
            continue
        dim, value, left, right = nodes[node]
        if dim < 0:
            out.append((rows, np.full(len(rows), value), home))
            continue
        x = vectors[rows, dim]
        for child, inside, edge in ((left, x <= value, x - value), (right, x > value, value + 1 - x)):
            if dim == 0:
                same_c = same & inside
                longer_c = longer & ((x + 1 <= value) if child == left else (x + 1 > value))
                more_c, less_c = more, less
                paid = seen
            else:
                outside = ~inside
                paid = dict(seen)
                before = paid.get((dim, child == left), None)
                owed = np.where(outside, edge, 0)
                new = owed if before is None else np.maximum(owed - before[rows], 0)
                total = np.zeros(len(vectors), dtype=np.int32) if before is None else before.copy()
                total[rows] = np.maximum(total[rows], owed)
                paid[(dim, child == left)] = total
                if child == left:  # fewer of this letter are wanted
                    more_c, less_c = more, (less + np.minimum(new, 3)).astype(np.int8)
                else:
                    more_c, less_c = (more + np.minimum(new, 3)).astype(np.int8), less
                same_c = same & (more_c <= 1) & (less_c <= 1)
                longer_c = longer & (more_c <= 1) & (less_c == 0)
            keep = same_c | longer_c | (home & inside)
            stack.append((child, rows[keep], more_c[keep], less_c[keep], same_c[keep], longer_c[keep], (home & inside)[keep], paid))
    if not out:
        return start, start, start.astype(bool)
    return tuple(np.concatenate(part) for part in zip(*out))


class FineTree:
    """Range searches over distinct count vectors."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.nodes: list[tuple] = []  # (low corner, high corner, rows or None, left, right)
        if len(points):
            self._grow(np.arange(len(points)))

    def _grow(self, rows: np.ndarray) -> int:
        mine = len(self.nodes)
        part = self.points[rows]
        low, high = part.min(0), part.max(0)
        self.nodes.append(())
        if len(rows) <= FINE:
            self.nodes[mine] = (low, high, rows, 0, 0)
            return mine
        dim = 0 if low[0] < high[0] else int(np.argmax(part.var(0)))
        order = np.argsort(part[:, dim], kind="stable")
        ranked = part[order, dim]
        middle = len(rows) // 2
        at = int(np.searchsorted(ranked, ranked[middle], "left")) or int(np.searchsorted(ranked, ranked[middle], "right"))
        left, right = self._grow(rows[order[:at]]), self._grow(rows[order[at:]])
        self.nodes[mine] = (low, high, None, left, right)
        return mine

    def near(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(asked, point) at distance 2 with the same length, or at distance 1 and longer by one."""
        found = []
        stack = [(0, np.arange(len(asked)))] if self.nodes else []
        while stack:
            node, rows = stack.pop()
            low, high, points, left, right = self.nodes[node]
            q = asked[rows]
            length = q[:, 0]
            fits = (length <= high[0]) & (length + 1 >= low[0])
            rows, q = rows[fits], q[fits]
            counts = q[:, 1:]
            away = (np.maximum(low[1:] - counts, 0) + np.maximum(counts - high[1:], 0)).sum(1)
            rows = rows[away <= 2]
            if not len(rows):
                continue
            if points is None:
                stack += [(left, rows), (right, rows)]
                continue
            p = self.points[points]
            step = max(1, PAIRS // p.size)
            for i in range(0, len(rows), step):
                part = asked[rows[i:i + step]]
                gap = p[None, :, 0] - part[:, None, 0]
                distance = np.abs(p[None, :, 1:] - part[:, None, 1:]).sum(2)
                a, b = np.nonzero((distance == 2 - gap) & ((gap == 0) | (gap == 1)))
                found.append((rows[i + a], points[b]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def one_edit(x: str, y: str) -> bool:
    """Whether ``y``, as long as ``x`` or longer by one, is one replaced or inserted letter away."""
    size, shared = len(x), 0
    while shared < size and x[shared] == y[shared]:
        shared += 1
    rest = size - shared - (len(x) == len(y))
    return x != y and (rest <= 0 or x[-rest:] == y[-rest:])


class _Words:
    """Words grouped by equal count vectors, with their letters in an array."""

    def __init__(self, words: list[str]):
        self.words = words
        vectors = count_vectors(words)
        self.used = np.union1d([0], np.flatnonzero(vectors.any(0)))
        self.full = vectors
        kinds, self.kind = np.unique(vectors, axis=0, return_inverse=True)
        self.kinds, self.kind = kinds, self.kind.reshape(-1)
        order = np.argsort(self.kind, kind="stable")
        self.members, self.starts = order, np.searchsorted(self.kind[order], np.arange(len(kinds) + 1))
        sizes = vectors[:, 0]
        self.short = sizes <= LONG
        self.letters = np.zeros((len(words), LONG + 1), dtype=np.uint8)
        chosen = np.flatnonzero(self.short)
        flat = np.frombuffer("".join([words[i] for i in chosen]).encode("latin-1"), dtype=np.uint8)
        lengths = sizes[chosen].astype(np.int64)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.letters[np.repeat(chosen, lengths), at] = flat
        self.index: dict[str, int] | None = None

    def find(self, word: str) -> int | None:
        if self.index is None:
            self.index = {w: i for i, w in enumerate(self.words)}
        return self.index.get(word)


def _compare(asked: _Words, points: _Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of words are one edit apart."""
    out = np.zeros(len(a), dtype=bool)
    size = asked.full[a, 0]
    long = ~(asked.short[a] & points.short[b])
    for i in np.flatnonzero(long):
        out[i] = one_edit(asked.words[a[i]], points.words[b[i]])
    equal_size = size == points.full[b, 0]
    for length in np.unique(size[~long]):
        for same in (True, False):
            at = np.flatnonzero(~long & (size == length) & (equal_size == same))
            if not len(at):
                continue
            x, y = asked.letters[a[at]][:, :length], points.letters[b[at]]
            if same:
                out[at] = (x != y[:, :length]).sum(1) == 1
                continue
            ahead = np.cumprod(x == y[:, :length], axis=1).sum(1)
            behind = np.cumprod((x == y[:, 1:length + 1])[:, ::-1], axis=1).sum(1)
            out[at] = ahead + behind >= length
    return out


def _edited(word: str, gone: str, come: str) -> set[str]:
    """The word with one ``gone`` replaced by ``come``, or with ``come`` put in anywhere."""
    if not gone:
        return {word[:i] + come + word[i:] for i in range(len(word) + 1)}
    return {word[:i] + come + word[i + 1:] for i, c in enumerate(word) if c == gone}


def near_words(asked: list[str], points: _Words, tree: FineTree) -> tuple[list[int], list[int]]:
    """(asked, point) numbers of all words one edit apart, the point as long or longer by one."""
    mine = _Words(asked)
    outside = np.setdiff1d(mine.used, points.used)
    # Letters that no point has only add to the distance: one column holds them all.
    view = np.concatenate([mine.kinds[:, points.used], mine.kinds[:, outside].sum(1, keepdims=True)], axis=1)
    kind_a, kind_b = tree.near(view)
    count_a, count_b = np.diff(mine.starts)[kind_a], np.diff(points.starts)[kind_b]
    # Comparing costs a step for each word of the point, looking up for each place of the edit.
    lookup = count_b > 2 * (mine.kinds[kind_a, 0] + 1)
    out_a: list[np.ndarray] = []
    out_b: list[np.ndarray] = []
    at = np.flatnonzero(~lookup)
    ends = np.cumsum(count_a[at] * count_b[at]) if len(at) else np.zeros(0, np.int64)
    first = 0
    while first < len(at):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + PAIRS, "right")))
        part = at[first:last]
        na, nb = count_a[part], count_b[part]
        total = na * nb
        which = np.repeat(np.arange(len(part)), total)
        place = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        a = mine.members[mine.starts[kind_a[part]][which] + place // nb[which]]
        b = points.members[points.starts[kind_b[part]][which] + place % nb[which]]
        good = _compare(mine, points, a, b)
        out_a.append(a[good])
        out_b.append(b[good])
        first = last
    for i in np.flatnonzero(lookup):
        change = points.kinds[kind_b[i], 1:].astype(int) - mine.kinds[kind_a[i], 1:]
        come, gone = np.flatnonzero(change > 0), np.flatnonzero(change < 0)
        found = [(a, b) for a in mine.members[mine.starts[kind_a[i]]:mine.starts[kind_a[i] + 1]]
                 for w in _edited(asked[a], chr(gone[0]) if len(gone) else "", chr(come[0]))
                 if (b := points.find(w)) is not None]
        out_a.append(np.array([a for a, _ in found], dtype=np.int64))
        out_b.append(np.array([b for _, b in found], dtype=np.int64))
    return (np.concatenate(out_a) if out_a else np.zeros(0, np.int64)), (np.concatenate(out_b) if out_b else np.zeros(0, np.int64))


def _route(nodes: list[tuple], parts: dict[int, int] | None):
    """Tasks that deal words to cells: home and questions, or (``parts`` None) only the home cell."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column("word").to_pylist()
            n = batch.column("n").to_numpy()
            vectors = count_vectors(words)
            rows, cells, home = reach(nodes, vectors)
            if parts is None:
                rows, cells = rows[home], cells[home]
                size = vectors[rows, 0].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int64)), pa.array(size)], ["cell", "size"])
                continue
            k = np.array([parts.get(int(c), 0) for c in cells], dtype=np.int64)
            hashed = np.array([hash_of(w) for w in words], dtype=np.int64)[rows]
            rows_all, cell_all = np.repeat(rows, k), np.repeat(cells, k)
            part = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            stands = np.repeat(home, k) & (part == np.repeat(hashed % np.maximum(k, 1), k))
            for i in range(0, len(rows_all), 20_000):
                at = slice(i, i + 20_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell_all[at].astype(np.int64)), pa.array(part[at].astype(np.int32)), pa.array(~stands[at]),
                     pa.array([words[j] for j in rows_all[at]], pa.string()), pa.array(n[rows_all[at]], pa.int64())],
                    ["cell", "part", "asks", "word", "n"])
    return run


def hash_of(word: str) -> int:
    import zlib

    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def _answer(batches):
    """Rows by cell and part, first the words that stand there, then those that only ask: pairs of near words."""
    here = None
    words: list[str] = []
    counts: list[int] = []
    tree = points = None

    def ask(asked, n):
        nonlocal tree, points
        if points is None:
            points = _Words(words)
            tree = FineTree(np.concatenate([points.kinds[:, points.used], np.zeros((len(points.kinds), 1), np.int32)], axis=1))
        for i in range(0, len(asked), 2_000):
            a, b = near_words(asked[i:i + 2_000], points, tree)
            for j in range(0, len(a), 20_000):
                x = [asked[i + k] for k in a[j:j + 20_000]]
                y = [words[k] for k in b[j:j + 20_000]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.string()), pa.array(y, pa.string()), pa.array([n[i + k] for k in a[j:j + 20_000]], pa.int64()),
                     pa.array([counts[k] for k in b[j:j + 20_000]], pa.int64()), pa.array([len(p) == len(q) for p, q in zip(x, y)])],
                    ["word", "near", "n", "near_n", "same"])

    def standing():
        if words and points is None:
            yield from ask(words, counts)

    for batch in batches:
        keys = list(zip(batch.column("cell").to_pylist(), batch.column("part").to_pylist()))
        asks, word, n = batch.column("asks").to_pylist(), batch.column("word").to_pylist(), batch.column("n").to_pylist()
        start = 0
        while start < len(keys):
            end = start
            while end < len(keys) and keys[end] == keys[start] and asks[end] == asks[start]:
                end += 1
            if keys[start] != here:
                yield from standing()
                here, words, counts, tree, points = keys[start], [], [], None, None
            if not asks[start]:
                words += word[start:end]
                counts += n[start:end]
            else:
                yield from standing()
                if words:
                    yield from ask(word[start:end], n[start:end])
            start = end
    yield from standing()


def near_pairs(words: DataFrame, sample: int = SAMPLE, cell_words: int = CELL_WORDS, cell_chars: int = CELL_CHARS) -> DataFrame:
    """(word, near, near_n): every ordered pair of distinct words one edit apart.  ``words`` (word, n) has each word once.

    ``sample`` words, those first by hash, shape the coarse tree; it changes no result.
    """
    words = words.filter(~F.col("word").rlike(r"[^\x00-\xFF]"))
    chosen = [r[0] for r in words.orderBy(F.xxhash64("word"), "word").limit(sample).select("word").collect()]
    leaves = max(1, min(sample // 8, -(-words.count() // cell_words)))
    nodes = coarse_tree(count_vectors(chosen), leaves) if chosen else [(-1, 0, 0, 0)]
    held = words.mapInArrow(_route(nodes, None), "cell long, size long").groupBy("cell").agg(F.count("*").alias("n"), F.sum("size").alias("chars"))
    # One row a cell, and cells are no more than an eighth of the sample.
    parts = {r["cell"]: max(1, -(-r["n"] // (2 * cell_words)), -(-r["chars"] // cell_chars)) for r in held.collect()}
    dealt = words.mapInArrow(_route(nodes, parts), "cell long, part int, asks boolean, word string, n long")
    # About a task for each part, so that the longest task does not grow with the words.
    dealt = dealt.repartition(max(1, sum(parts.values())), "cell", "part").sortWithinPartitions("cell", "part", "asks")
    found = dealt.mapInArrow(_answer, "word string, near string, n long, near_n long, same boolean")
    # Words of the same length ask each other; a longer word does not ask the shorter one.
    both = F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return found.select(F.inline(F.when(F.col("same"), F.slice(both, 1, 1)).otherwise(both)))


def group_variants(words: DataFrame, factor: int = 5, **cells: int) -> DataFrame:
    """``words`` (word, n), each word once, with ``form``, ``root``, ``n_near`` and ``form_n``.

    ``form``: the near word of largest n, of equal ones the first in code-point order, if its n is at least ``factor``
    (2 or more) times the word's; ``root``: where following the forms ends.  Rows with a NULL word, or n NULL or below 1,
    are left out.
    """
    words = stored(words.filter(F.col("word").isNotNull() & (F.col("n") >= 1)).select("word", F.col("n").cast("long").alias("n")), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = near_pairs(words, **cells).groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = words.join(near, "word", "left")
    formed = -F.col("best.less") >= factor * F.col("n")
    forms = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.near")).alias("form"),
                                 F.when(formed, -F.col("best.less")).alias("form_n")), "forms")
    roots = forms.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    largest = forms.agg(F.max("n")).first()[0] or 1
    steps = 1  # forms a chain may have so far; n grows by the factor with each of them
    while factor ** (steps + 1) <= largest:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = stored(roots.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
        steps *= 2
    out = forms.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
