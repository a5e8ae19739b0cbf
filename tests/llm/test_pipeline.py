"""The registered queries against SQL, and the pipeline stage by stage against brute-force versions."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry_module
import corpus_pipeline
from peakwise.llm import quality, queries
from peakwise.llm.common import stored, table
from tests.llm.test_text_operators import plain_spans, split_words
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


def test_names():
    names = [n for n in entry_module.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry_module.queries() and set(queries.ORACLES) <= set(names)
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    assert compare(connect(SF), queries.QUERIES[name](spark, SF), queries.ORACLES[name]) is None


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = split_words(w)
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    columns, inputs = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        inputs.append({r["doc_id"]: r.asDict() for r in docs.collect()})
        docs = stored(stage(spark, docs, SF), "test-stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    first, good, distinct, clean, mixed = inputs
    labels = dict(duckdb.connect().execute(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    assert set(good) <= set(first)
    known_good = {d for d in first if labels.get(d) == 1}
    assert len(known_good & set(good)) >= 0.95 * len(known_good)

    sets = {d: shingles(r["text"]) for d, r in good.items()}
    label = {d: d for d in sets}
    pairs = [(a, b) for a in sets for b in sets if b < a and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in range(len(sets)):
        before = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    assert set(distinct) == {d for d in sets if label[d] == d}

    for d, r in clean.items():
        assert not plain_spans(r["text"]) and len(r["text"]) == r["n_chars"]
        if not plain_spans(distinct[d]["text"]) and r["text"] != distinct[d]["text"]:
            assert "[TERM]" in r["text"] or len(r["text"]) < len(distinct[d]["text"])

    copies = Counter(r["doc_id"] for r in docs.collect())
    assert set(mixed) <= set(clean) and max(copies.values()) <= 2
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in docs.collect():
        ids = library.encode(mixed[r["doc_id"]]["text"], add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "labels"):
        table(spark, SF, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert quality.fit_quality(table(spark, str(tmp_path), "documents"), table(spark, str(tmp_path), "labels"))
