"""The registered queries without a SQL twin, on whole small tables against plain versions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from peakwise.llm import pii, queries, sharding, toxicity
from peakwise.llm.common import table
from tests.llm.test_text_operators import plain_spans

SF = "/root/testdata/sf0.001"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r.asDict() for r in table(spark, SF, "documents").collect()}


@pytest.mark.parametrize("name, remainder, modulus, threshold", [("op2_score_toxicity", 2, 4, 0.3), ("op3_score_quality", 1, 3, 0.5)])
def test_classifier_queries(spark, name, remainder, modulus, threshold):
    larger = "/root/testdata/sf0.01"  # enough labels to learn from
    docs = [r["doc_id"] for r in table(spark, larger, "documents").select("doc_id").collect()]
    column = "toxic" if name.startswith("op2") else "quality"
    truth = {r["doc_id"]: r[column] for r in table(spark, larger, "labels").collect()}
    rows = queries.QUERIES[name](spark, larger).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(list(docs))
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == remainder)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
    unseen = [r for r in rows if r["held_out"] and truth.get(r["doc_id"]) in (0, 1)]
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in unseen)
    assert unseen and right >= 0.9 * len(unseen)


def test_bpe_query(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in queries.QUERIES["op5_encode_decode"](spark, SF).collect():
        ids = library.encode(docs[r["doc_id"]]["text"] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha(" ".join(map(str, ids)))
        assert r["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))


def test_sharding_query(spark, docs):
    rows = queries.QUERIES["op7_shard_documents"](spark, SF).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(list(docs))
    by_text, sizes, slots = {}, Counter(), {}
    for r in rows:
        data = (docs[r["doc_id"]]["text"] or "").encode("utf-8")
        assert r["size"] == len(data) + 1 and r["text_crc32"] == zlib.crc32(data) and r["law"] == "bytes" and r["grown_shard"] is None
        by_text.setdefault(data, set()).add(r["shard"])
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(sizes) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    fair = sum(sizes.values()) / 16
    largest = max(len(d) for d in by_text)
    assert all(len(s) == 1 for d, s in by_text.items() if len(d) * sum(r["text_crc32"] == zlib.crc32(d) for r in rows) < fair)
    assert max(sizes.values()) <= fair + largest


def test_packing_against_plain_steps():
    rng = np.random.default_rng(4)
    vectors = rng.gamma(0.5, 1.0, (120, 3))
    vectors /= vectors.sum(0)
    left, want = [[1 / 5] * 3 for _ in range(5)], [0] * 120
    for i in sorted(range(120), key=lambda i: (-max(vectors[i]), i)):
        shard = max(range(5), key=lambda s: (sum(a * b for a, b in zip(left[s], vectors[i])), -s))
        want[i] = shard
        left[shard] = [a - b for a, b in zip(left[shard], vectors[i])]
    assert sharding.pack_items(vectors, 5).tolist() == want
    loads = np.array([vectors[np.array(want) == s].sum(0) for s in range(5)])
    assert loads.max() < 1 / 5 + vectors.max()


def test_personal_data_query(spark, docs):
    for r in queries.QUERIES["op9_find_personal_data"](spark, SF).collect():
        spans = plain_spans(docs[r["doc_id"]]["text"] or "")
        text = ",".join(f"{pii.KINDS[k]}:{start}:{end}" for start, k, end in spans)
        assert r["base_sha256"] == sha(text)
        assert [r[f"n_{kind}"] for kind in ("email", "ip", "card", "phone")] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        assert {s for s in text.split(",") if s} <= set(r["spans"].split(","))


def test_jaccard_query(spark, docs):
    sets = {}
    for d, r in docs.items():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")) if x]
        sets[d] = frozenset(tuple(w[i:i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])
    label = {d: d for d in sets}
    links = [(a, b) for a in sets for b in sets if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    before = None
    while before != label:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in queries.QUERIES["op10_jaccard_components"](spark, SF).collect()}
    assert got == {(d, len(s), label[d]) for d, s in sets.items()}


def test_risk_is_the_non_negative_one():
    """Adam steps on the numerically differentiated risk give the same weights."""
    rng = np.random.default_rng(1)
    size, prior, ridge, rate = 5, 0.3, 1e-4, 0.05
    toxic = [np.flatnonzero(rng.random(size) < 0.6) for _ in range(12)]
    unlabelled = [np.flatnonzero(rng.random(size) < 0.4) for _ in range(30)]

    def parts(x):
        score = lambda rows: np.array([x[r].sum() + x[-1] for r in rows])
        sp, su = score(toxic), score(unlabelled)
        loss = lambda s: np.logaddexp(0, s)
        return prior * loss(-sp).mean(), loss(su).mean() - prior * loss(sp).mean()

    def slope(f, x):
        return np.array([(f(x + h) - f(x - h)) / 2e-5 for h in np.eye(size + 1) * 1e-5])

    x, first, second, negative = np.append(np.zeros(size), np.log(prior / (1 - prior))), np.zeros(size + 1), np.zeros(size + 1), 0
    for step in range(1, 61):
        below = parts(x)[1] < 0  # then the step goes back along the clean risk
        negative += below
        gradient = slope((lambda y: -parts(y)[1]) if below else (lambda y: sum(parts(y))), x) + ridge * np.append(x[:-1], 0)
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient ** 2
        x = x - rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    weights, bias = toxicity.nn_pu_weights(toxic, unlabelled, prior, size, epochs=60, rate=rate, ridge=ridge)
    assert np.allclose(np.append(weights, bias), x, atol=1e-4)
