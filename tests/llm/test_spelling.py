"""Spelling variants against comparing all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from peakwise.llm import queries, spelling


def edit(x, y):
    """Whether two different words are one inserted, deleted or replaced letter apart."""
    if len(x) > len(y):
        x, y = y, x
    if x == y or len(y) - len(x) > 1:
        return False
    return any(x[:i] + x[i + 1:] == y[:i] + y[i + 1:] for i in range(len(x))) if len(x) == len(y) else any(y[:i] + y[i + 1:] == x for i in range(len(y)))


def plain(counts, factor=5):
    near = {w: [v for v in counts if edit(w, v)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def vocabulary(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeinrstéÿ÷") for _ in range(rng.randint(5, 9))) for _ in range(n)]
    for _ in range(n):
        w = list(rng.choice(words))
        at = rng.randrange(len(w))
        kind = rng.randrange(4)
        if kind == 0:
            w[at] = rng.choice("aeinrst")
        elif kind == 1:
            w.insert(at, rng.choice("aeinrst"))
        elif kind == 2:
            del w[at]
        else:
            rng.shuffle(w)
        words.append("".join(w))
    words += ["aeinrst" * 20, "aeinrst" * 20 + "a", "x" * 64, "x" * 65, "x" * 66, "y" + "x" * 64]
    return {w: rng.choice([5, 5, 6, 7, 30, 31, 200, 1000, 6000]) for w in words}


def frame(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)


def test_against_all_pairs(spark):
    counts = vocabulary(1, 350)
    for cells in ({}, {"sample": 200, "cell_words": 20}, {"sample": 64, "cell_words": 5, "cell_chars": 300}):
        got = spelling.group_variants(frame(spark, counts), **cells)
        assert sorted(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect())) == plain(counts)


def test_anagrams_are_looked_up(spark):
    """Thousands of words of equal letters: one point, edited spellings found by name."""
    rng = random.Random(2)
    base = set()
    while len(base) < 3000:
        base.add("".join(rng.sample("abcdefghij", 10)))
    changed = {w.replace("j", "k", 1) for w in list(base)[:200]} | {w[:4] + "z" + w[4:] for w in list(base)[200:260]}
    counts = {w: 5 for w in base} | {w: 50 for w in changed}
    got = {r["word"]: r for r in spelling.group_variants(frame(spark, counts)).collect()}
    for w in changed:
        near = sum(edit(w, v) for v in counts)
        assert got[w]["n_near"] == near and got[w]["form"] is None
    for w in list(base)[:260]:
        best = min((v for v in changed if edit(w, v)), default=None)
        assert got[w]["form"] == best and got[w]["root"] == (best or w)


def test_chains_odd_words_and_empty(spark):
    chain = {"a" * (6 + i): 5 ** (i + 1) for i in range(20)}
    got = {r["word"]: r["root"] for r in spelling.group_variants(frame(spark, chain)).collect()}
    assert set(got.values()) == {"a" * 25}
    rows = [("", 7), ("a", 70), (None, 5), ("b", None), ("c", 0), ("Ωmega", 5), ("Ωmegas", 50)]
    odd = spelling.group_variants(spark.createDataFrame(rows, "word string, n long")).collect()
    assert sorted((r["word"], r["form"], r["n_near"]) for r in odd) == [("", "a", 1), ("a", None, 1), ("Ωmega", None, 0), ("Ωmegas", None, 0)]
    assert spelling.group_variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_reach_covers_every_neighbour():
    counts = list(vocabulary(4, 300))
    vectors = spelling.count_vectors(counts)
    nodes = spelling.coarse_tree(vectors[::3], 40)
    rows, cells, home = spelling.reach(nodes, vectors)
    assert Counter(rows[home].tolist()) == Counter(range(len(counts)))
    asked = set(zip(rows.tolist(), cells.tolist()))
    at = dict(zip(rows[home].tolist(), cells[home].tolist()))
    assert len(set(at.values())) > 20
    for i, x in enumerate(counts):
        for j, y in enumerate(counts):
            if len(y) - len(x) in (0, 1) and edit(x, y):
                assert (i, at[j]) in asked
    assert len(asked) < 0.6 * len(counts) * len(np.unique(cells))


def test_query_on_odd_texts(spark, tmp_path):
    rng = random.Random(6)
    words = ["Straße", "STRASSE", "strasse", "élémentaire", "ELÉmentaire", "naturelle", "naturel", "x×y÷zz", "short", "thousands"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += [(None, "thousands " * 9), (500, None), (501, ""), (502, "naturelle," * 30000), (3, rows[3][1]), (3, rows[3][1])]
    rows += [(600 + i, "thousands-strasse_naturel9naturelle") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    got = queries.QUERIES["op12_group_spellings"](spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and len(counts) > 5
    assert sorted(map(tuple, got.collect())) == plain(counts)
