"""Golden cases, invariants and brute-force checks on small fixtures."""

import inspect
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from peakwise.functions import formula as FX
from peakwise.operators import audit as A
from peakwise.operators import graph as G
from peakwise.operators import matching as J
from peakwise.operators import metrics as M
from peakwise.operators import sampling as S
from peakwise.operators import search as LS
from peakwise.operators import selection as K
from peakwise.operators import transforms as T
from peakwise.operators.search import library_search
from peakwise.plans import selection as _selection  # noqa: F401
from peakwise.plans.registry import QUERIES
from peakwise import skew
from peakwise.session import scratch_dir
from peakwise.skew import average_rank, exact_quantiles
from peakwise.sources import msp, sinks
from peakwise.sources import tables as IO


def bins_of(spark, rows):
    return spark.createDataFrame(rows, "spectrum_id long, cand_id long, bin long, intensity double")


@pytest.fixture(scope="module")
def pool(spark):
    rng = random.Random(5)
    rows = [(s, c, b, float(rng.randint(1, 9))) for s in range(4) for c in range(9) for b in rng.sample(range(12), rng.randint(1, 5))]
    return rows


GOLDEN = [
    ('269.1863 21.28 "C14H25N2O3=p-C6H13NO/1.2ppm;C17H23N3=p-C3H15O4/-8.7ppm 14/14"', [(269.1863, 21.28)]),
    ('375.3005 80.12 "C23H39N2O2=p-H2O/-0.3ppm 12/12"; 393.3111 999.00 "p/-0.2ppm 12/12";', [(375.3005, 80.12), (393.3111, 999.0)]),
    ("375   80; 393  999;", [(375.0, 80.0), (393.0, 999.0)]),
]


def test_golden_peak_lines(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)], "i int, t string")
    got = {r.i: [(p.mz, p.intensity) for p in r.p] for r in rows.select("i", msp.parse_peak_line(F.col("t")).alias("p")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(GOLDEN)}


def test_msp_blank_lines_crlf_and_repeated_keys(spark):
    path = scratch_dir(spark, "msp") + ".msp"
    text = ("preamble\r\nName: A\r\nID: 1\r\nFormula: X\r\nFormula: CH4\r\nNum Peaks: 2\r\n10 5\r\n20 6; 21 7\r\n\r\n30 8\r\n"
            "Name: no id\nNum Peaks: 1\n5 5\nName: B\nID: 2\nNum Peaks: 0\n\nName: C\nID: 3\nSynon: a\nSynon: b\nNum Peaks: 1\n5 1\n")
    with open(path, "w", newline="") as f:
        f.write(text)
    got = {r.id: (r.name, r.formula, [p.mz for p in r.peaks]) for r in msp.read_msp(spark, path).collect()}
    assert got == {1: ("A", "CH4", [10.0, 20.0, 21.0, 30.0]), 3: ("C", None, [5.0])}
    heads = {(r.name, r.key): r.value for r in msp.scan_headers(spark, path).collect()}
    assert heads[("C", "synon")] == "a || b"


def test_range_join_against_brute_force(spark):
    rng = random.Random(1)
    a = [(i % 3, round(rng.uniform(0, 900), 3)) for i in range(120)]
    b = [(i % 3, round(x + rng.choice([-0.5, -0.49, 0, 0.2, 0.5]), 3)) for i, x in a]
    left, right = spark.createDataFrame(a, "k long, x double"), spark.createDataFrame(b, "k long, y double")
    for tol, relative, inclusive in ((0.5, False, False), (0.5, False, True), (0.001, True, False), (0.2, True, False)):
        got = J.range_join(left, right, "x", "y", tol, ["k"], relative=relative, inclusive=inclusive).select("k", "x", "y").collect()

        def close(x, y):
            d = abs(x - y) / (max(x, 200.0) if relative else 1.0)
            return d <= tol if inclusive else d < tol
        want = [(k, x, y) for (k, x), (m, y) in itertools.product(a, b) if k == m and close(x, y)]
        assert sorted(map(tuple, got)) == sorted(want)


def test_exact_quantiles_and_ranks(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"g": rng.integers(0, 3, 500), "v": np.round(rng.normal(0, 1000, 500), 1)})
    df = spark.createDataFrame(frame)
    got = exact_quantiles(df, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 1.0}).toPandas().set_index("g")
    for g, part in frame.groupby("g"):
        assert np.allclose(got.loc[g, ["a", "b", "c"]].to_numpy(dtype=float), np.quantile(part["v"], [0.1, 0.5, 1.0]))
    ranks = average_rank(df.withColumn("i", F.monotonically_increasing_id()), ["g"], "v", "r").toPandas()
    assert np.allclose(ranks["r"], ranks.groupby("g")["v"].rank())


def test_metric_ranges_and_self_similarity(spark, pool):
    t = bins_of(spark, pool).groupBy("spectrum_id", "bin").agg(F.sum("intensity").alias("intensity"))
    p = t.withColumn("intensity", F.col("intensity") * 3)
    row = M.evaluate(M.pair_bins(t, p)).agg(F.min("cosine"), F.min("js"), F.min("coverage"), F.max("false_pred_n")).first()
    assert all(abs(v - 1) < 1e-9 for v in row[:3]) and row[3] == 0
    other = t.withColumn("bin", F.col("bin") + 1)
    got = M.evaluate(M.pair_bins(t, other)).select("cosine", "js", "coverage", "topk_recall").toPandas()
    assert ((got >= -1e-12) & (got <= 1 + 1e-12)).all().all()


def test_binning_does_not_depend_on_partitioning(spark):
    peaks = spark.range(300).select((F.col("id") % 7).alias("spectrum_id"), (F.col("id") * 1.37 % 900).alias("mz"), (F.col("id") % 11).cast("double").alias("intensity"))
    one = sorted(map(tuple, T.bin_spectra(peaks.coalesce(1)).collect()))
    many = sorted(map(tuple, T.bin_spectra(peaks.repartition(7)).collect()))
    assert one == many


def test_split_fractions(spark):
    rows = spark.range(20000).select(S.split_name(S.uniform_hash(F.col("id").cast("string"), 42)).alias("s"))
    share = {r.s: r["count"] / 20000 for r in rows.groupBy("s").count().collect()}
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["val"] - 0.1) < 0.01


def test_library_search_with_copies(spark):
    rng = random.Random(9)
    spectra = {i: {rng.randrange(20): float(rng.randint(1, 5)) for _ in range(5)} for i in range(12)}
    for i in range(12, 20):
        spectra[i] = dict(spectra[i % 3])  # groups of identical spectra
    pmz = {i: 100.0 + (i % 3) * 0.4 for i in spectra}
    rows = [(i, b, x) for i, s in spectra.items() for b, x in s.items()]
    bins = spark.createDataFrame(rows, "spectrum_id long, bin long, intensity double")
    meta = spark.createDataFrame(list(pmz.items()), "spectrum_id long, precursor_mz double")
    got = {(r.query_id, r["rank"]): (r.library_id, r.score) for r in library_search(bins, meta, bins, meta, 0.5, 4).collect()}

    def unit(s):
        n = sum(x * x for x in s.values()) ** 0.5
        return {b: x / n for b, x in s.items()}
    want = {}
    for q, s in spectra.items():
        scores = []
        for m, t in spectra.items():
            shared = set(s) & set(t)
            if shared and abs(pmz[q] - pmz[m]) <= 0.5:
                scores.append((-round(sum(unit(s)[b] * unit(t)[b] for b in shared), 9), m))
        for rank, (neg, m) in enumerate(sorted(scores)[:4], 1):
            want[(q, rank)] = (m, -neg)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}


def test_library_search_in_a_hot_window(spark, monkeypatch):
    """A third of the library in one precursor window, near copies with 1 % noise among them; most meetings are never made."""
    rng = np.random.default_rng(4)
    n, axis, k = 1500, 400, 5
    base = [(np.sort(rng.choice(axis, 30, replace=False)), rng.gamma(0.3, 10.0, 30) + 0.01) for _ in range(n)]
    spectra = []
    for i in range(n):
        bins, x = base[i] if i % 6 else base[i % 60]
        spectra.append((bins, x * (1 + 0.01 * rng.standard_normal(30)) if i % 6 == 0 else x))
    pmz = np.where(np.arange(n) % 3 == 0, 300.0 + (np.arange(n) % 5) * 0.05, 100.0 + np.arange(n) * 0.9)
    dense = np.zeros((n, axis))
    for i, (bins, x) in enumerate(spectra):
        dense[i, bins] = x
    unit = dense / np.linalg.norm(dense, axis=1)[:, None]
    scores = np.round(unit @ unit.T, 9)
    meets = ((dense > 0).astype(int) @ (dense > 0).astype(int).T) * (np.abs(pmz[:, None] - pmz[None, :]) <= 0.5)
    want = {}
    for q in range(n):
        best = sorted((-scores[q, m], m) for m in np.flatnonzero(meets[q]))[:k]
        want |= {(q, rank): (int(m), -s) for rank, (s, m) in enumerate(best, 1)}
    rows = [(i, int(b), float(v)) for i, (bins, x) in enumerate(spectra) for b, v in zip(bins, x)]
    bins = spark.createDataFrame(rows, "spectrum_id long, bin long, intensity double")
    meta = spark.createDataFrame([(i, float(p)) for i, p in enumerate(pmz)], "spectrum_id long, precursor_mz double")
    looked_up = []
    plain = LS._meetings

    def counted(entries, lib, buckets, tol):
        looked_up.append(entries.join(lib, "bin").filter(F.abs(F.col("q_pmz") - F.col("l_pmz")) <= tol).count())
        return plain(entries, lib, buckets, tol)

    monkeypatch.setattr(LS, "_meetings", counted)
    monkeypatch.setattr(LS, "TILE", 100)
    got = {(r.query_id, r["rank"]): (r.library_id, r.score) for r in library_search(bins, meta, bins, meta, 0.5, k).collect()}
    assert set(got) == set(want)
    assert all(got[key][1] == pytest.approx(want[key][1], abs=2e-9) for key in want)
    differ = [key for key in want if got[key][0] != want[key][0]]
    assert all(abs(scores[key[0], got[key][0]] - want[key][1]) < 2e-9 for key in differ)
    assert sum(looked_up) < 0.2 * meets.sum()


def cover(rows, budget, min_new):
    """Plain greedy coverage used as the yardstick."""
    out = []
    for s in sorted({r[0] for r in rows}):
        cands = {c: {r[2]: r[3] for r in rows if r[0] == s and r[1] == c} for c in {r[1] for r in rows if r[0] == s}}
        first = {c: min(b) for c, b in cands.items()}
        covered, left = set(), dict(cands)
        for step in range(1, budget + 1):
            best = None
            for c, b in left.items():
                new = [x for x in b if x not in covered]
                if len(new) >= min_new:
                    key = (round(sum(b[x] for x in new) + c * 0.01, 9), -c * 1.0, -first[c], -c)
                    best = max(best, (key, c)) if best else (key, c)
            if best is None:
                break
            c = best[1]
            out.append((s, c, step))
            covered |= set(left.pop(c))
    return sorted(out)


@pytest.mark.parametrize("min_new, head", [(1, 256), (2, 256), (1, 2), (2, 1)])
def test_weighted_cover_in_rounds(spark, pool, monkeypatch, min_new, head):
    monkeypatch.setattr(K, "HEAD", head)
    rows = bins_of(spark, pool).select(
        "spectrum_id", "cand_id", "bin", F.col("intensity").alias("weight"), (F.col("cand_id") * 0.01).alias("bonus"),
        (-F.col("cand_id")).cast("double").alias("tie"))
    want = cover(pool, 4, min_new)
    assert sorted(map(tuple, K.weighted_cover(rows, 4, min_new).collect())) == want


def test_greedy_selections_keep_their_limits(spark, pool):
    bins = bins_of(spark, pool)
    cands = bins.groupBy("spectrum_id", "cand_id").agg(F.sum("intensity").alias("score"), F.count(F.lit(1)).alias("n")).withColumns({
        "group_id": F.col("cand_id") % 3, "base_score": F.col("score"), "plausibility": F.col("score") / 10})
    true = bins.groupBy("spectrum_id", "bin").agg(F.max("intensity").alias("intensity"))
    results = {
        "aware": K.coverage_aware_topk(cands, bins, 3, 5), "teacher": K.setcover_teacher(bins, true, 3, 1, 6),
        "region": K.region_set_cover(cands, bins, 5, 1, (("low", 0.0, 6.0, 2), ("high", 6.0, 20.0, 2)), 1.0),
        "marginal": K.marginal_coverage_cap(cands, bins, true, 3, True)}
    limits = {"aware": 3, "teacher": 3, "region": 5, "marginal": 3}
    for name, df in results.items():
        rows = [(r.spectrum_id, r.cand_id) for r in df.collect()]
        assert len(rows) == len(set(rows)), name
        assert max(pd.Series([s for s, _ in rows]).value_counts()) <= limits[name], name
    first = {r.spectrum_id: r.cand_id for r in results["aware"].filter("step = 1").collect()}
    # With nothing covered the first pick is the best base score (novelty is equal for unit-sum peaks).
    best = {r.spectrum_id: r.cand_id for r in K.plain_topk(cands, 1).collect()}
    assert first == best
    with pytest.raises(ValueError):
        K.marginal_coverage_cap(cands, bins, true, 3)


@pytest.mark.parametrize("name", ["k09_coverage_aware_topk", "k10_setcover_teacher"])
def test_selection_queries_take_the_whole_pool(spark, monkeypatch, name):
    asked = {}
    operator = name.split("_", 1)[1]
    original = getattr(K, operator)

    def spy(*args, **kwargs):
        asked.update(inspect.signature(original).bind(*args, **kwargs).arguments)
        return original(*args, **kwargs)

    monkeypatch.setattr(K, operator, spy)
    rows = QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert rows and asked.get("prefilter") is None


def test_single_cuts_against_plain_search(spark):
    rng = random.Random(5)
    atoms, bonds = [], []
    for m in range(25):
        ids = rng.sample(range(100), rng.randint(1, 14))
        atoms += [(m, x, "C", 1) for x in ids]
        bonds += [(m, i, rng.choice(ids), rng.choice([*ids, 777] if i == 3 else ids)) for i in range(rng.randint(0, len(ids) + 2))]  # loops, doubles
    want = set()
    for m, cut, a, b in bonds:
        ids = {x for t, x, _, _ in atoms if t == m}

        def reach(start):
            seen, todo = {start}, [start]
            while todo:
                here = todo.pop()
                for t, i, p, q in bonds:
                    if t == m and i != cut and {p, q} <= ids and here in (p, q):
                        there = q if here == p else p
                        if there not in seen:
                            seen.add(there)
                            todo.append(there)
            return seen

        if {a, b} <= ids and b not in reach(a):
            want |= {(m, cut, 0, x) for x in reach(a)} | {(m, cut, 1, x) for x in reach(b)}
    got = G.single_cuts(spark.createDataFrame(atoms, "mol_id long, atom_id long, element string, n_h int"),
                        spark.createDataFrame(bonds, "mol_id long, bond_id long, a long, b long")).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_single_cuts_of_a_very_large_molecule(spark):
    """Ten rings of 5 000 atoms in a row: the nine bonds between them separate."""
    n, ring = 50_000, 5_000
    k = F.col("id")
    atoms = spark.range(n).select(F.lit(1).cast("long").alias("mol_id"), k.alias("atom_id"))
    last = k % ring == ring - 1
    bonds = spark.range(n).select(F.lit(1).cast("long").alias("mol_id"), k.alias("bond_id"), k.alias("a"), F.when(last, k - ring + 1).otherwise(k + 1).alias("b"))
    between = spark.range(9).select(F.lit(1).cast("long").alias("mol_id"), (k + n).alias("bond_id"), ((k + 1) * ring).alias("a"), (k * ring + 7).alias("b"))
    got = G.single_cuts(atoms, bonds.unionByName(between)).groupBy("cut", "side").count().collect()
    assert {(r.cut, r.side): r["count"] for r in got} == {(n + i, s): (n - (i + 1) * ring if s == 0 else (i + 1) * ring) for i in range(9) for s in (0, 1)}


def test_formula_round_trip(spark):
    rows = spark.createDataFrame([("C6H12O6",), ("CClBr",), ("NaCl",), ("H2O",)], "f string")
    got = [r[0] for r in rows.select(FX.hill(FX.counts(F.col("f")))).collect()]
    assert got == ["C6H12O6", "CBrCl", "ClNa", "H2O"]


def test_insert_or_ignore_and_whitelists(spark):
    base = scratch_dir(spark, "io")
    one = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, x string")
    sinks.insert_or_ignore(one, f"{base}/t", "id")
    sinks.insert_or_ignore(spark.createDataFrame([(2, "z"), (3, "c")], "id long, x string"), f"{base}/t", "id")
    assert sorted(r.id for r in spark.read.parquet(f"{base}/t").collect()) == [1, 2, 3]
    docs = {"list": '["a", " b "]', "split": '{"train": ["a", "b"], "val": ["c"]}', "ids": '{"identifiers": ["a", "b"]}'}
    for name, text in docs.items():
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{base}/{name}")
        assert sorted(r[0] for r in IO.read_whitelist(spark, f"{base}/{name}/*.txt", "train").collect()) == ["a", "b"]


def test_quality_gate_stops_the_job(spark):
    bad = spark.createDataFrame([(1, 1, 1, 1, 1)], "spectrum_id long, cand_id long, raw_n long, binned_n long, unique_n long")
    report = A.peak_audit(bad)
    assert not report.first()["passed"]
    with pytest.raises(Exception, match="quality gate"):
        A.assert_quality(report).collect()


def test_exact_ranks_in_a_dense_zone(spark, monkeypatch):
    """A million values within a tenth are cut into over a hundred parts; ranks and quantiles stay exact."""
    n = 1_000_000
    value = 300.0 + F.pmod(F.col("id") * 7919, F.lit(n)) / (10.0 * n)
    df = spark.range(n).select(F.when(F.col("id") % 1000 == 0, 2).otherwise(1).alias("g"), value.alias("v"))
    counted = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    sizes = skew.cut_groups(counted, ["g"], "v")[0].filter("g = 1").groupBy("part").count().toPandas()["count"]
    assert len(sizes) > 90 and sizes.max() < 3 * skew.PART_VALUES
    monkeypatch.setattr(skew, "PART_VALUES", 2_000)
    assert skew.cut_groups(counted, ["g"], "v")[0].filter("g = 1").select("part").distinct().count() > 400
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", {"q": 0.37}).collect()}
    plain = df.toPandas()
    for g, part in plain.groupby("g"):
        assert got[g].n == len(part) and got[g].q == pytest.approx(np.quantile(part.v, 0.37), abs=1e-12)


def test_row_positions(spark, monkeypatch):
    monkeypatch.setattr(skew, "PART_VALUES", 7)
    rng = random.Random(8)
    rows = [(g, rng.choice([0.0, 0.5, -1.25, rng.random()]), i) for i in range(400) for g in ([1] if i % 3 else [1, 2])]
    got = skew.row_positions(spark.createDataFrame(rows, "g int, v double, i long"), ["g"], "v", "i", "r").collect()
    for g in (1, 2):
        want = {i: r for r, (_, i) in enumerate(sorted((-v, i) for h, v, i in rows if h == g), 1)}
        assert {r.i: r.r for r in got if r.g == g} == want


def test_nearest_distance_in_a_dense_zone(spark, monkeypatch):
    """One spectrum with half of all peaks within 5 Da is swept in many parts; neighbours across their borders count."""
    monkeypatch.setattr(skew, "PART_VALUES", 50)
    rng = np.random.default_rng(2)
    true = [(1, float(m), i) for i, m in enumerate(200 + 5 * rng.random(2000))] + [(s, float(m), 7) for s in (2, 3) for m in 1000 * rng.random(40)]
    true += [(1, 200.0, 1), (1, 200.0, 2), (1, None, 3), (None, 5.0, 4), (4, 10.0, 5)]
    cand = [(1, float(m)) for m in 200 + 5 * rng.random(300)] + [(1, 990.0), (2, 3.0), (2, 3.0), (5, 1.0), (3, None), (3, 500.0)]
    df = spark.createDataFrame(true, "spectrum_id long, mz double, extra int")
    got = J.nearest_distance(df, spark.createDataFrame(cand, "spectrum_id long, mz double"))
    want = []
    for s, m, extra in true:
        if s is not None and m is not None:
            gaps = [abs(m - c) for t, c in cand if t == s and c is not None]
            want.append((s, m, extra, round(min(gaps), 9) if gaps else None))
    rows = [(r.spectrum_id, r.mz, r.extra, None if r.distance is None else round(r.distance, 9)) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)
    counted = df.filter("mz IS NOT NULL").groupBy("spectrum_id", "mz").agg(F.count(F.lit(1)).alias("n"))
    assert skew.cut_groups(counted, ["spectrum_id"], "mz")[0].filter("spectrum_id = 1").select("part").distinct().count() >= 30


def test_conditions_expire(spark, tmp_path):
    """A key that returns after the delay passes again; the state of keys that do not return is dropped."""
    import datetime

    from peakwise.streaming import streams as ST

    start = datetime.datetime(2024, 1, 1)
    hours = [[("a", 0), ("a", 5), ("b", 1), ("c", 2)], [("a", 23), ("d", 30)], [("a", 49), ("d", 60), ("a", 49.5)], [("e", 500)], [("e", 700), ("a", 701)]]
    for i, batch in enumerate(hours):
        rows = [(k, start + datetime.timedelta(hours=h)) for k, h in batch] + [("late", None)]
        spark.createDataFrame(rows, "k string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema("k string, ts timestamp").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = ST.suppress_repeats(stream, "ts", F.col("k"), 24 * 3600, "1 hour")
    query = out.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("memory").queryName("expiring").start()
    query.awaitTermination()
    got = sorted((r.content_key, (r.ts - start).total_seconds() / 3600) for r in spark.table("expiring").collect())
    assert got == [("a", 0.0), ("a", 49.0), ("a", 701.0), ("b", 1.0), ("c", 2.0), ("d", 30.0), ("d", 60.0), ("e", 500.0), ("e", 700.0)]
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) >= 3 and held[-1] <= 2


def test_greedy_on_a_hot_spectrum(spark, monkeypatch):
    """One spectrum with a third of all candidates, many more than a task sees at once, against plain greedy steps."""
    monkeypatch.setattr(K, "HEAD", 40)
    rng = random.Random(12)
    cands, rows = [], []
    for s, n in ((1, 900), (2, 30), (3, 5)):
        for c in range(n):
            cands.append((s, c, c % 50, round(rng.random(), 3)))
            rows += [(s, c, b, float(rng.randint(1, 9))) for b in rng.sample(range(60), rng.randint(0, 6))]
    cands += [(4, 7, None, 0.5), (4, 8, None, 0.9)]  # nothing to cover
    df = spark.createDataFrame(cands, "spectrum_id long, cand_id long, group_id long, score double")
    got = K.coverage_aware_topk(df, bins_of(spark, rows), 25).collect()
    for s in (1, 2, 3, 4):
        pool = {c: (g, x) for t, c, g, x in cands if t == s}
        peaks = {c: {b: x for t, d, b, x in rows if t == s and d == c} for c in pool}
        raw = sorted(x for _, x in pool.values())
        spread, middle = max(float(np.std(raw, ddof=1)), 1e-6), raw[(len(raw) - 1) // 2]
        covered, picked, blocked = {}, [], set()
        bare = not any(peaks.values())

        def gain(c):
            total = sum(peaks[c].values())
            base = pool[c][1] if bare else 0.2 * min(max((pool[c][1] - middle) / spread, -5.0), 5.0)
            return round(base + sum(x / total * (0.1 - 0.45 * covered.get(b, 0.0)) for b, x in peaks[c].items()), 9)

        while len(picked) < min(25, len(pool)):
            free = [c for c in pool if c not in picked]
            allowed = [c for c in free if pool[c][0] not in blocked] or free
            best = max(allowed, key=lambda c: (gain(c), pool[c][1], -c))
            picked.append(best)
            if pool[best][0] is not None:
                blocked.add(pool[best][0])
            for b, x in peaks[best].items():
                covered[b] = max(covered.get(b, 0.0), x / max(peaks[best].values()))
        assert [r.cand_id for r in sorted(got, key=lambda r: r.step) if r.spectrum_id == s] == picked


def test_library_search_writes_no_meetings(spark, monkeypatch):
    """Spectra that all meet: what a search writes grows with the spectra, not with their pairs."""
    n = 120
    rows = [(i, b, 1.0 + (i * b) % 7) for i in range(n) for b in (1, 2, 3)]
    bins = spark.createDataFrame(rows, "spectrum_id long, bin long, intensity double")
    meta = spark.createDataFrame([(i, 100.0 + i * 1e-4) for i in range(n)], "spectrum_id long, precursor_mz double")
    sizes, write = {}, LS.write_once

    def counted(df, name):
        table = write(df, name)
        sizes[name] = table.count()
        return table

    monkeypatch.setattr(LS, "write_once", counted)
    got = {(r.query_id, r["rank"]): (r.library_id, round(r.score, 9)) for r in library_search(bins, meta, bins, meta, 0.5, 3).collect()}
    x = np.array([v for _, _, v in rows]).reshape(n, 3)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = {}
    for q in range(n):
        best = sorted((-round(float(unit[q] @ unit[m]), 9), m) for m in range(n))[:3]
        want |= {(q, rank): (m, -s) for rank, (s, m) in enumerate(best, 1)}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert max(sizes.values()) <= 3 * n


def test_fragments_of_any_graph_in_one_walk(spark):
    """Rings, several components and bonds to unknown atoms: parts of one and two cuts, of recursive cuts, and their fingerprints."""
    rng = random.Random(5)
    graphs = {}
    for mol in range(40):
        n = rng.randint(1, 7)
        ids = rng.sample(range(100, 200), n)
        bonds = [(i, rng.choice(ids), rng.choice([*ids, 999])) for i in range(rng.randint(0, 8))]
        graphs[mol] = (ids, bonds)
    atoms = spark.createDataFrame([(m, x, "CNO"[x % 3]) for m, (ids, _) in graphs.items() for x in ids], "mol_id long, atom_id long, element string")
    bonds = spark.createDataFrame([(m, *b) for m, (_, bs) in graphs.items() for b in bs], "mol_id long, bond_id long, a long, b long")

    def parts(ids, edges):
        left, out = set(ids), []
        while left:
            part, todo = set(), [min(left)]
            while todo:
                x = todo.pop()
                if x not in part:
                    part.add(x)
                    todo += [b if a == x else a for _, a, b in edges if x in (a, b)]
            left -= part
            out.append(tuple(sorted(part)))
        return out

    double, deep = set(), set()
    for m, (ids, every) in graphs.items():
        known = [b for b in every if b[1] in ids and b[2] in ids]
        for x, y in itertools.combinations(known, 2):
            cut = parts(ids, [b for b in known if b not in (x, y)])
            double |= {(m, x[0], y[0], p) for p in cut if len(cut) > 1}
        level = [((), tuple(ids))]
        for _ in range(3):
            below = []
            for path, part in level:
                inside = [b for b in known if b[1] in part and b[2] in part]
                for x in inside:
                    cut = parts(part, [b for b in inside if b != x])
                    below += [((*path, x[0]), p) for p in cut if len(cut) > 1]
            level = below
            deep |= {(m, len(path), path, p) for path, p in level}
    got = {(r.mol_id, r.cut_a, r.cut_b, tuple(r.part)) for r in G.double_cuts(atoms, bonds).collect()}
    assert got == double
    got = {(r.mol_id, r.depth, tuple(r.path), tuple(r.part)) for r in G.recursive_fragments(atoms, bonds).collect()}
    assert got == deep
    sides = G.single_cuts(atoms, bonds)
    long = {(r.mol_id, r.cut, r.side, r.atom_id) for r in sides.collect()}
    assert long == {(r.mol_id, r.cut, r.side, x.atom_id) for r in G.single_cut_parts(atoms, bonds, ["element"]).collect() for x in r.part}
    keys = ["mol_id", "cut", "side"]
    ends = bonds.join(sides.withColumnRenamed("atom_id", "a"), ["mol_id", "a"]).join(sides.withColumnRenamed("atom_id", "b"), [*keys, "b"])
    plain = G.wl_fingerprint(sides.join(atoms, ["mol_id", "atom_id"]), ends, 2, keys)
    assert {tuple(r) for r in plain.select(*keys, "fingerprint").collect()} == {tuple(r) for r in G.cut_fingerprints(atoms, bonds, 2).collect()}


def test_structure_headers_of_files_and_of_a_table(spark, tmp_path):
    """A table of structure files gives the rows that the files give, without opening a file for each."""
    texts = {"ID7.MOL": "one\nsrc\nCAS rn = 50, Library ID = 8\nM  END", "sub/id12.mol": "two\r\n\r\n\r\nM  END", "note.txt": "x"}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    want = {(7, "one", "src", "50", 8), (12, "two", None, None, 12)}
    assert {tuple(r) for r in IO.structure_headers(spark, str(tmp_path)).collect()} == want
    table = spark.createDataFrame([(f"lib/{name}", text) for name, text in texts.items()], "path string, value string")
    assert {tuple(r) for r in IO.headers_of_structures(table).collect()} == want
    import __spark_entry__ as entry_module
    headers = entry_module.queries()["io07_structure_headers"](spark, "/root/testdata/sf0.01")
    assert len(headers.inputFiles()) < headers.count() / 100


def test_annotations_are_parsed_once_a_text(spark):
    """Peaks without a precursor formula stay, and parsing happens below a distinct, not in every row."""
    from peakwise.operators import formulas as C
    peaks = spark.createDataFrame([(s, p, 10.0 * p, t) for s in (1, 2, 3) for p, t in ((1, "p-H2O/1ppm;? 3/9"), (2, "p-CO2=x/2ppm 4/5;p-H2O"))]
                                  + [(4, 1, 5.0, "p-H2O"), (4, 2, 6.0, "y3 5/9")], "spectrum_id long, peak_no int, mz double, annotation string")
    spectra = spark.createDataFrame([(1, "C6H12O6"), (2, "C6H12O6"), (3, None), (4, "C2H6O")], "spectrum_id long, ion_formula string")
    table, rejected = C.annotation_table(peaks, spectra)
    assert [tuple(r) for r in rejected.collect()] == [(4, "peptides not supported")]
    got = sorted((r.spectrum_id, r.peak_no, r["loss"], round(r.exact_mz, 4)) for r in table.filter("spectrum_id < 3").collect())
    assert got == [(s, p, *x) for s in (1, 2) for p, x in ((1, ("H2O1", 162.0528)), (2, ("C1O2", 136.0736)), (2, ("H2O1", 162.0528)))]
    assert table.filter("spectrum_id = 3").count() == 3
    for df in (table, C.with_canonical(spectra.withColumnRenamed("ion_formula", "formula"))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Aggregate [") >= 1


def test_pairs_of_peaks_meet_once(spark):
    """Peaks paired in one shuffle give the pairs of the binned sides; shares and totals of spectra take one more."""
    rng = random.Random(3)
    side = lambda: spark.createDataFrame(
        [(rng.randrange(6), rng.choice([-1.0, 0.2, 0.4, 3.7, 99.5, 1004.9, 2000.0]) + rng.random() / 50, float(rng.randint(-1, 4))) for _ in range(200)],
        "spectrum_id long, mz double, intensity double")
    t, p = side(), side()
    read = lambda df: sorted((r.spectrum_id, r.bin, round(r.t, 9), round(r.p, 9)) for r in df.collect())
    paired = M.pair_peaks(t, p, 5, 1.0)
    assert read(paired) == read(M.pair_bins(T.bin_spectra(t, bin_width=1.0), T.bin_spectra(p, bin_width=1.0)))
    pre = spark.createDataFrame([(s, 3.8) for s in range(5)], "spectrum_id long, precursor_mz double")
    edges = lambda x: T.bin_spectra_edges(x, 0.5, "max", pre)
    assert read(M.pair_peaks_max(t, p, pre, 5, 0.5).filter("t > 0 OR p > 0")) == read(M.pair_bins(edges(t), edges(p)).filter("t > 0 OR p > 0"))
    for scores in (M.barcode(paired), M.top_overlap(paired, 3), M.dice(paired), M.distances(paired, 1006)):
        assert scores._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 2
