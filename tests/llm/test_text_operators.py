"""Operators on texts against brute-force versions, with missing, empty, long and repeated rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from peakwise.llm import bpe, jaccard, licenses, mixing, pii, quality, rules, sharding, toxicity
from peakwise.llm.common import id_crc

SYLLABLES = "an be co de er fi go ha in jo ka le mo no or pe qui re so ta un ve".split()


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)]


def documents(seed: int = 1, n: int = 120) -> list[tuple]:
    """(doc_id, text, lang, source, size): one hot source, copies, near copies, odd rows, a column that clashes."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = " ".join(words(rng, rng.choice([1, 2, 3, 12, 60, 150])))
        if rows and i % 5 == 0:
            text = rows[rng.randrange(len(rows))][1]
        elif rows and i % 7 == 0:
            near = rows[rng.randrange(len(rows))][1].split(" ")
            near[rng.randrange(len(near))] = "changed"
            text = " ".join(near)
        rows.append((i, text, rng.choice(["en", "de", None]), "hot" if i % 3 == 0 else rng.choice(["a", "b", None]), "clash"))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "a", None), (n + 2, " \n\t ", "en", "hot", None), (n + 3, "One\x0btwo\x1cthree", "en", "b", ""),
             (n + 4, " ".join(words(rng, 6000)), "en", "hot", None), (5, rows[5][1], "en", "a", "again"), (5, rows[5][1], "en", "a", "again")]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, size string"


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_mixing(docs, rows, empty):
    found = mixing.mix_sources(docs).toPandas()
    assert len(found) == len(rows) and "lang" in found
    sizes = defaultdict(int)
    for _, text, _, source, _ in rows:
        sizes[source] += len(split_words(text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    clamped, budget = set(), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in clamped]
        level = (budget - sum(2 * sizes[s] for s in clamped)) / sum(weights[s] for s in free)
        above = {s for s in free if weights[s] * level > 2 * sizes[s]}
        if not above:
            break
        clamped |= above
    target = {s: 2 * sizes[s] if s in clamped else weights[s] * level for s in order}
    found["source"] = found["source"].astype(object).where(found["source"].notna(), None)
    for source, part in found.groupby("source", dropna=False):
        source = None if pd.isna(source) else source
        assert part["target"].iloc[0] == pytest.approx(target[source]) and set(part["source_size"]) == {sizes[source]}
        assert abs((part["size"] * part["copies"]).sum() - target[source]) <= part["size"].max() / 2 + 1e-6
    assert found["copies"].max() <= 2
    again = mixing.mix_sources(docs).toPandas()
    key = ["doc_id", "size", "copies"]
    assert sorted(map(tuple, again[key].values)) == sorted(map(tuple, found[key].values))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == found["copies"].sum()
    assert mixed.filter("size = 'clash'").count() > 0
    assert mixing.mix_sources(empty).count() == 0


def test_sharding(docs, rows, empty):
    found = sharding.shard_documents(docs, shards=4).toPandas()
    assert len(found) == len(rows)
    assert set(found["size"] - 1) == {len((r[1] or "").encode()) for r in rows}
    assert (found.fillna({"text": ""}).groupby("text")["shard"].nunique() == 1).all() or found["size"].max() * 4 > found["size"].sum()
    for _, part in found.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert sharding.shard_documents(empty).count() == 0


def test_sharding_splits_a_hot_group(spark):
    rows = [(i, "same text " * 20) for i in range(400)] + [(400 + i, f"other {i} " * 20) for i in range(800)]
    found = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).groupBy("shard").agg(F.sum("size")).collect()
    sizes = [r[1] for r in found]
    assert len(sizes) == 8 and max(sizes) < 1.15 * sum(sizes) / 8


def test_pack_items_fills_the_emptiest():
    vectors = np.array([[0.4, 0.1], [0.1, 0.4], [0.25, 0.25], [0.25, 0.25]])
    chosen = sharding.pack_items(vectors, 2)
    loads = np.array([vectors[chosen == s].sum(axis=0) for s in (0, 1)])
    assert np.abs(loads - 0.5).max() < 0.01 or len(set(chosen)) == 2


def covered(tokens):
    places = defaultdict(list)
    for i in range(len(tokens) - 7):
        places[tuple(tokens[i:i + 8])].append(i)
    return len({i + j for p in places.values() if len(p) > 1 for i in p for j in range(8)})


def test_rules(spark, docs, empty):
    rng = random.Random(4)
    base = words(rng, 30)
    texts = [" ".join(base + base[:9]), " ".join(base * 3), "a\nb b\na\n\n \na\nb", "a b " * 40, "x" * 3, "#a *b $$ %&|<> c", " ".join(["w"] * 8), " ".join(["w"] * 9)]
    more = spark.createDataFrame([(1000 + i, t, "en", "hot", None) for i, t in enumerate(texts)], SCHEMA)
    both = docs.unionByName(more)
    for r in rules.measure(both).collect():
        tokens, lines = split_words(r["text"]), [x for x in (r["text"] or "").split("\n") if split_words(x)]
        assert r["n_words"] == len(tokens) and r["word_chars"] == sum(map(len, tokens))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", r["text"] or "")) and r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == covered(tokens)
        assert r["base_failed"] == (len(tokens) < 20 or 100 * covered(tokens) > 30 * len(tokens))
    kept = rules.keep_by_rules(both)
    assert kept.columns == docs.columns and kept.filter("doc_id = 124").count() == 1
    assert rules.keep_by_rules(empty).count() == 0


def test_rules_follow_the_group(spark):
    rng = random.Random(5)
    plain = [(i, " ".join(words(rng, 50)), "en", "s", None) for i in range(300)]
    odd = [(1000, " ".join(w + "###" for w in words(rng, 50)), "en", "s", None)]
    long = [(2000 + i, " ".join(w * 6 for w in words(rng, 50)), "xx", "s", None) for i in range(300)]
    kept = {r[0] for r in rules.keep_by_rules(spark.createDataFrame(plain + odd + long, SCHEMA)).select("doc_id").collect()}
    assert 1000 not in kept and len(kept) == 600


def test_licenses(spark, docs, empty):
    texts = ["Licensed under CC BY-NC 4.0.\nrest", "this work IS licensed under the gnu  general-public LICENSE, version 3", "the mit_license and MIT license",
             "permit license. smit license", "released license", "Redistribution and use in source and binary forms with modification are permitted", "apacheé license", "cc by cc by"]
    both = docs.unionByName(spark.createDataFrame([(1000 + i, t, "en", "a", None) for i, t in enumerate(texts)], SCHEMA))
    found = licenses.scan_licenses(both)
    assert found.count() == both.count()
    sets = [(set(licenses._words_of(t)), label) for t, label in licenses.TEMPLATES]
    for r in found.collect():
        w = licenses._words_of(r["text"] or "")
        starts, base = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split(" ")
            hits = [i for i in range(len(w)) if w[i:i + len(p)] == p]
            starts += hits
            base |= {label} if hits else set()
        shares = [(len(t & set(licenses._words_of(line))) / len(t), label) for line in (r["text"] or "").split("\n") for t, label in sets]
        hits = [(s, label) for s, label in shares if s >= licenses.THRESHOLD - 1e-12]
        assert (r["n_words"], r["starts"], r["base_labels"]) == (len(w), sorted(starts), sorted(base))
        assert r["labels"] == sorted(base | {label for _, label in hits})
        assert r["score"] == pytest.approx(1.0 if base else max([s for s, _ in hits], default=0.0))
    assert licenses.scan_licenses(empty).count() == 0
    assert licenses.scan_licenses(docs, templates=[]).count() == docs.count()


def test_licenses_wrapped_over_lines(spark):
    rng = random.Random(11)
    bsd = "Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided"
    texts = [bsd, "This work is licensed under a Creative Commons\nAttribution 4.0 International License.",
             " ".join(words(rng, 3000)) + "\n" + bsd.replace(" ", "\n") + "\n" + " ".join(words(rng, 3000)),
             "Redistribution and use in\n" + "other " * 40 + "\nsource and binary forms with or without modification are permitted",
             "Released\n" + "other " * 30 + "\nunder the\nlicense"]
    sets = [(set(licenses._words_of(t)), 2 * len(licenses._words_of(t)), label) for t, label in licenses.TEMPLATES]
    for _ in range(150):  # parts of notices among other words, cut anywhere
        w = []
        for _ in range(rng.randint(1, 4)):
            t = licenses._words_of(rng.choice(licenses.TEMPLATES)[0])
            w += words(rng, rng.randint(0, 25)) + [x for x in t if rng.random() < 0.9 for _ in range(rng.choice([1, 1, 1, 2]))]
        texts.append("".join(x + rng.choice([" ", " ", "\n"]) for x in w))
    found = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [found[i]["labels"] for i in range(5)] == [["bsd"], ["cc-by-4"], ["bsd"], [], []]
    assert found[0]["score"] == found[1]["score"] == found[2]["score"] == 1.0
    for i, text in enumerate(texts):
        w = licenses._words_of(text)
        blocks = [(set(licenses._words_of(line)), None) for line in text.split("\n")]
        blocks += [(set(w[s:s + n]), n) for n in {n for _, n, _ in sets} for s in range(max(len(w) - n, 0) + 1)]
        hits = [(len(t & b) / len(t), label) for t, n, label in sets for b, m in blocks if m in (None, n)]
        hits = [(s, label) for s, label in hits if s >= licenses.THRESHOLD - 1e-12]
        assert found[i]["labels"] == sorted(set(found[i]["base_labels"]) | {label for _, label in hits}), text
        assert found[i]["score"] == pytest.approx(1.0 if found[i]["base_labels"] else max([s for s, _ in hits], default=0.0))


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_personal_data_patterns(spark, docs):
    rng = random.Random(8)
    texts = ["".join(rng.choice("12345 -.@+()ab_é😀09 ") for _ in range(rng.randint(5, 60))) for _ in range(600)]
    texts += ["a@b.cc_x@d.ee", "1.2.3.4.5.6.7.8", "4539 1488 0343 6467", "45391488034364670000", "+1 (017) 555-7713 x", "é" * 5 + "me@here.org", "1" * 4000,
              "9 " * 3000, "000255.1.1.1 256.1.1.1", "x" * 5000 + "@", "5  4539-1488-0343-6467"]
    both = docs.select("doc_id", "text", "size").unionByName(spark.createDataFrame([(1000 + i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, size string"))
    for r in pii.find_personal_data(both).collect():
        assert [(s["start"], s["k"], s["end"]) for s in r["spans"] if s["k"] < 4] == plain_spans(r["text"] or "")
        assert all(s["value"].lower() == (r["text"] or "")[s["start"]:s["end"]].lower() for s in r["spans"])


def test_disclosing_terms(spark, empty):
    rng = random.Random(9)
    rows = [(i, " ".join(words(rng, 40))) for i in range(300)]
    for i in range(6):  # a name that only stands near one address, in different surroundings
        rows.append((1000 + i, " ".join(words(rng, 20)) + " Zebulon writes from zeb@example.org " + " ".join(words(rng, 20))))
    rows += [(2000 + i, "the same note of Copernica to cop@example.org once") for i in range(50)]  # copies are one surrounding
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(frame).collect()}
    assert all("zeb@" not in clean[1000 + i] and "zebulon" not in clean[1000 + i].lower() and "[EMAIL]" in clean[1000 + i] for i in range(6))
    assert all("Copernica" in clean[2000 + i] for i in range(50))
    assert all(clean[i] == text for i, text in rows[:300])
    assert pii.sanitise(empty).count() == 0 and pii.sanitise(empty).columns == empty.columns


def test_disclosing_terms_of_the_whole_document(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(words(rng, 40))) for i in range(300)]
    long = "x" * 60
    for i in range(4):  # a name in the heading, the address in the signature that is always the same
        rows.append((1000 + i, f"Zebulon\n{' '.join(words(rng, 60))} {long} {long} {long}\nwrite to us here at the office zeb@example.org thanks and kind regards from all"))
    rows += [(2000 + i, f"Copernica {' '.join(words(rng, 60))} cop@example.org") for i in range(2)]  # too few texts
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    terms = {(s["value"]).lower() for r in pii.find_personal_data(frame).collect() for s in r["spans"] if s["k"] == len(pii.PATTERNS)}
    held = {i: set(re.findall(r"[^\W\d_][^\W_]+", text.lower())) for i, text in rows}
    entity = {i: e for i, text in rows for e in re.findall(r"\w+@example\.org", text)}
    want = set()
    for e in set(entity.values()):
        at = [i for i in entity if entity[i] == e]
        for t in set().union(*[held[i] for i in at]):
            n_et, n_t = sum(t in held[i] for i in at), sum(t in h for h in held.values())
            if n_et >= pii.SUPPORT and 1 + math.log(n_et / n_t) / math.log(len(rows) / len(at)) >= pii.DISCLOSURE:
                want.add(t)
    assert {"zebulon", long} <= terms and "copernica" not in terms
    assert terms == want - {"zeb"}  # stands in the address only
    clean = {r["doc_id"]: r["text"].lower() for r in pii.sanitise(frame).collect()}
    assert all("zebulon" not in clean[1000 + i] and "zeb@" not in clean[1000 + i] for i in range(4))


def plain_sanitised(text):
    """The text with its spans replaced; of overlapping ones the first stays and takes all up to the end of the last."""
    out, at = [], 0
    for start, k, end in plain_spans(text):
        if start >= at:
            out += [text[at:start], f"[{pii.KINDS[k].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def test_long_texts_are_sanitised_in_blocks(spark, monkeypatch):
    """Spans, some of them overlapping, across the borders of blocks, and one text with twenty thousand of them."""
    rng = random.Random(9)
    bits = ["1.2.3.4", "me@here.org", "+49 30 123456 7890", "4539 1488 0343 6467", "é", "wort ", " ", "x@1.2.3.4", "+4539148803436467", "😀"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(120)]
    texts += [" ".join(f"10.0.{i % 256}.{i // 256} é{i}" for i in range(20_000)), "", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for block in (64, 3):
        monkeypatch.setattr(pii, "BLOCK", block)
        rows = frame if block == 64 else frame.filter("doc_id < 120")
        got = {r["doc_id"]: r["text"] for r in pii.sanitise(rows, support=10 ** 9).collect()}
        for i, text in got.items():
            assert text == (None if texts[i] is None else plain_sanitised(texts[i])) or (texts[i] is None and text == "")


@pytest.mark.parametrize("percent, n", [(90, 3), (80, 5)])
def test_jaccard(spark, docs, rows, percent, n):
    rng = random.Random(percent)
    hot = words(rng, 200)
    more = []
    for i in range(60):
        near = list(hot)
        for _ in range(rng.randint(0, 4)):
            near[rng.randrange(200)] = rng.choice(["x", "y", "z"])
        more.append((500 + i, " ".join(near)))
    for size in range(3, 14):  # around the smallest sets that can link
        more += [(700 + 2 * size, " ".join(map(str, range(size)))), (701 + 2 * size, " ".join(map(str, range(size + 1))).upper())]
    every = [(r[0], r[1]) for r in rows] + more
    frame = spark.createDataFrame(every, "doc_id long, text string").repartition(4)
    sets = []
    for _, text in every:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        sets.append(frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    label = [d for d, _ in every]
    changed = True
    linked = [(a, b) for a in range(len(every)) for b in range(a) if sets[a] and sets[b]
              and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            changed = changed or label[a] != low or label[b] != low
            label[a] = label[b] = low
    want = sorted((d, len(s), c) for (d, _), s, c in zip(every, sets, label))
    for block, prefix in ((jaccard.BLOCK, False), (7, False), (9, True)):  # small blocks: several rounds
        got = jaccard.jaccard_components(frame, n=n, percent=percent, prefix=prefix, block=block)
        assert sorted(map(tuple, got.collect())) == want
    kept = jaccard.keep_one_of_each(docs, n=n, percent=percent)
    assert kept.columns == docs.columns


def test_jaccard_empty(empty, spark):
    assert jaccard.jaccard_components(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (None, None), (4, "A B C D")], "doc_id long, text string")
    assert sorted(jaccard.jaccard_components(odd).collect(), key=str) == sorted([(None, 2, 3), (3, 2, 3), (None, 0, None), (4, 2, 3)], key=str)


def test_links_through_texts_without_an_id(spark):
    """Documents 1 and 2 are linked only through a text whose row has no id."""
    w = [f"w{i}" for i in range(103)]
    near = [" ".join(["x"] * k + w[k:]) for k in (0, 4, 8)]  # one step apart at 0.9, two steps not
    rows = [(1, near[0]), (None, near[1]), (2, near[2]), (None, "alone without an id and of other words"), (7, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jaccard.jaccard_components(docs).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(1, 1), (None, 1), (2, 1), (None, None), (7, 7), (None, None)], key=str)
    kept = jaccard.keep_one_of_each(docs, n=3, percent=90)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[3], rows[4], rows[5]], key=str)


def test_survivors_are_rows(spark):
    """An id that repeats with another text keeps that text; repeated rows leave one."""
    w = " ".join(f"w{i}" for i in range(60))
    rows = [(1, w, "a"), (2, w, "a"), (2, "quite another text under this id", "b"), (5, "said again and again", "c"), (5, "said again and again", "c"), (6, "", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_hash string")
    kept = jaccard.keep_one_of_each(docs, n=5, percent=80, prefix=True)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2], rows[3], rows[5]]


def test_dictionary_sees_every_text(monkeypatch):
    """Texts late in the sample reach the dictionary though the texts before them fill the bound many times."""
    seen = []
    monkeypatch.setattr(quality.zstandard, "train_dictionary", lambda size, samples, **_: seen.extend(samples) or quality.zstandard.ZstdCompressionDict(b"d" * 8))
    texts = [chr(97 + i) * 20_000 for i in range(26)]
    quality._dictionary(texts, training_bytes=60 * 2048)
    assert len(seen) == 60 and {s[:1].decode() for s in seen} == {t[0] for t in texts}
    seen.clear()
    quality._dictionary(["short", "texts"], training_bytes=60 * 2048)
    assert seen == [b"short", b"texts"]



def test_components_with_several_tasks(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(200)]
    label = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    frame = spark.createDataFrame(edges, "a long, b long").repartition(4)
    for size in (1000, 40):
        assert dict(map(tuple, jaccard.components(frame, size).collect())) == label


def test_prefix_tree_is_exact():
    rng = np.random.default_rng(2)
    link = jaccard.Link(80)
    base = rng.integers(0, 1 << 60, 60).astype(np.uint64)
    sets = []
    for _ in range(80):
        keep = base[rng.random(60) > 0.07]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 60, rng.integers(0, 8)).astype(np.uint64)])))
    leaders = jaccard.link_block(list(range(80)), list(range(80)), sets, link)
    label = list(range(80))
    for _ in range(80):
        for a in range(80):
            for b in range(a):
                shared = len(np.intersect1d(sets[a], sets[b]))
                if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                    label[a] = label[b] = min(label[a], label[b])
    assert leaders == label


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe(spark, docs, rows, file):
    path = public_tokenizers.path(file)
    library, data = Tokenizer.from_file(path), bpe.read_vocabulary(path)
    rng = random.Random(3)
    signs = "aabcdeehiinorstu'' .,!?\t\n\x1c\x85<|>éèñßΣσİıK日本語𝒜👍½١０​　\x00-_"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(rng.choice("abehilnorst") for _ in range(n)) for n in (500, 5000)] + ["a" * 3000, "haha" * 900, "!" * 5000, "<|endoftext|>hi<|endoftext|"]
    encoder, decoder = bpe.Encoder(bpe.Vocabulary(data)), bpe.Decoder(bpe.Vocabulary(data))
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.ids(text).tolist() == ids
        want = library.decode(ids, skip_special_tokens=False)
        assert decoder.text(np.array(ids, dtype=np.int32)) == want == decoder.text(np.array(ids, dtype=np.int32), step=1)
    done = bpe.decode_documents(bpe.encode_documents(docs.withColumn("ids", F.lit("clash")), data), data).collect()
    assert len(done) == len(rows)
    for r in done:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False) and r["size"] in ("clash", "again", "", None)


def test_bpe_memory_does_not_grow_with_the_word():
    data = bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    transducer = bpe.Transducer(bpe.Vocabulary(data).merges)
    most = 0
    rng = random.Random(1)
    for _ in range(300):
        transducer.feed("".join(rng.choice("abehilnorst") for _ in range(50)))
        most = max(most, transducer.size)
    assert most <= 8 * transducer.merges.longest


def labelled(seed):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(600):
        toxic, good = i % 8 == 0, i % 5 != 0
        w = words(rng, 60)
        if toxic:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["zzvile", "zzfoul"])
        text = " ".join(w) if good else " ".join(x + "%%%" for x in w)
        docs.append((i, text, "score?"))
        labels.append((i, int(good), int(toxic)))
    docs += [(900, None, ""), (901, "", ""), (5, docs[5][1], "again")]
    labels += [(5, labels[5][1], labels[5][2]), (None, 1, 1), (7000, 1, None), (902, 3, 0)]
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = labelled(6)
    return (spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels)


@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_classifiers_on_rows_held_out(tables, name):
    docs, labels, known = tables
    held = F.pmod(id_crc(F.col("doc_id")), F.lit(3)) == 1
    if name == "quality":
        scored = quality.score_quality(docs, quality.fit_quality(docs, labels.filter(~held)))
        threshold = 0.5
    else:
        scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels.filter(~held)))
        threshold = 0.3
    got = scored.toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    label = {k[0]: k[1 if name == "quality" else 2] for k in known}
    test = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    by_id = got.drop_duplicates("doc_id").set_index("doc_id")["score"]
    right = np.mean([(by_id[i] >= threshold) == bool(label[i]) for i in test])
    assert right > 0.97


def test_classifiers_without_labels(tables, spark, empty):
    docs, labels, _ = tables
    none = labels.limit(0)
    assert set(quality.score_quality(docs, quality.fit_quality(docs, none)).toPandas()["score"]) == {0.5}
    assert toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, none)).toPandas()["score"].nunique() == 1
    assert quality.score_quality(empty, quality.fit_quality(empty, labels)).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c4") and math.isfinite(0.0)
