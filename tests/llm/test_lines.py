"""Line dedup against a plain version."""

import hashlib
import random
import re
from collections import defaultdict

from peakwise.llm import lines, queries

WHITE = " \t\n\x0b\x0c\r"


def plain(rows, min_chars=10, min_docs=2):
    """(text, n_lines, n_dropped) of each (doc_id, text)."""
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(WHITE))

    held = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(doc_id)
    out = []
    for doc_id, text in rows:
        all_lines = (text or "").split("\n")
        left = []
        for line in all_lines:
            docs = held.get(key(line), set())
            known = [d for d in docs if d is not None]
            if len(docs) < min_docs or doc_id == (min(known) if known else None):
                left.append(line)
        out.append(("\n".join(left), len(all_lines), len(all_lines) - len(left)))
    return out


def rows_of(seed=3):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice(["alpha", "Beta", "gamma", "ÄÖÜ", "délta", "x"]) for _ in range(rng.randint(1, 5))) for _ in range(60)]
    pool += ["The same line in all texts", "  the SAME line in all texts\t", "exactly te", "short one", "\x0b\x1cnot stripped inside\x1c", "🙂" * 10, ""]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 8)))) for i in range(60)]
    rows += [(None, "The same line in all texts\nonly without an id"), (None, "only without an id\nlast line of it"), (100, None), (101, ""), (102, "\n\n"),
             (7, rows[7][1]), (7, rows[7][1]), (8, "another text with the same id\nThe same line in all texts"), (-3, "The same line in all texts")]
    rows += [(200, "\n".join(f"line number {i % 9000}" for i in range(20000))), (201, "\n".join(f"line number {i}" for i in range(8000)) + "\n" + "y" * 300000)]
    return rows


def test_against_plain(spark):
    rows = rows_of()
    frame = spark.createDataFrame([(*r, f"k{i}", i, 1) for i, r in enumerate(rows)], "doc_id long, text string, key1 string, row1 int, n_lines int").repartition(3)
    for min_docs in (2, 4):
        got = lines.dedup_lines(frame, min_docs=min_docs)
        assert got.columns == ["doc_id", "text", "key1", "row1", "n_lines", "n_dropped"]
        want = [(d, t, f"k{i}", i, n, dropped) for i, ((d, _), (t, n, dropped)) in enumerate(zip(rows, plain(rows, min_docs=min_docs)))]
        assert sorted(map(tuple, got.collect()), key=lambda r: r[3]) == want


def test_empty_and_single(spark):
    schema = "doc_id long, text string"
    assert lines.dedup_lines(spark.createDataFrame([], schema)).count() == 0
    got = lines.dedup_lines(spark.createDataFrame([(1, "one long enough line\none long enough line")], schema)).first()
    assert tuple(got) == (1, "one long enough line\none long enough line", 2, 0)


def test_query_digests(spark, tmp_path):
    rows = rows_of(5)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op11_dedup_lines"](spark, str(tmp_path))
    want = [(d, n, dropped, hashlib.sha256(t.encode()).hexdigest()) for (d, _), (t, n, dropped) in zip(rows, plain(rows))]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
