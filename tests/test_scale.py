"""What failed on larger tables: plans, edges of the axis and work a row."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from peakwise.functions import formula as FX
from peakwise.operators import formulas as C
from peakwise.operators import graph as G
from peakwise.operators import matching as J
from peakwise.operators import search as LS
from peakwise.operators import selection as K
from peakwise.operators import targets as TG
from peakwise.operators import transforms as T
from peakwise.skew import average_rank, r6


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def test_ranks_are_not_broadcast(spark):
    """the written ranks of many equal values are a small file and a large table."""
    rows = spark.range(2000).select((F.col("id") % 500).alias("g"), (F.col("id") % 7).cast("double").alias("v"))
    ranked = average_rank(rows, ["g"], "v", "r")
    assert "BroadcastHashJoin" not in plan_of(ranked)
    assert ranked.count() == 2000


def test_table_function_keeps_the_last_bin(spark, tmp_path):
    """the last bin of the axis reaches beyond 1005, and arrays must not depend on the order of their rows."""
    rows = [(1, 100500.0, 2.0), (1, 100500.5, 3.0), (1, 100501.0, 7.0), (2, 200.0, 1.0), (2, 100.0, 4.0), (2, 200.0, 2.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_extendedprice double, l_quantity double").repartition(5).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = entry_module.queries()["u06_table_function_on_spectra"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(1, 100500, 5.0), (2, 100, 4.0), (2, 200, 3.0)]
    assert "sort_array" in plan_of(got)


def test_greedy_steps_are_taken_in_all_spectra_at_once():
    """The gains are called once a step, not once a step and spectrum; whole spectra in blocks."""
    n, calls = 3000, []
    rng = np.random.default_rng(1)
    rows = [(s, c, b, float(rng.integers(1, 9))) for s in range(n) for c in range(3) for b in rng.choice(8, 3, replace=False)]
    sid, cand, bins, weight = (np.array(x) for x in zip(*rows))
    total = {}
    for s, c, _, w in rows:
        total[s, c] = total.get((s, c), 0.0) + w
    rank = {k: 1 + sum((-total[k[0], o], o) < (-total[k], k[1]) for o in range(3)) for k in total}
    null = pa.nulls(len(rows), pa.float64())
    table = pa.table({
        "spectrum_id": sid, "cand_id": cand, "bin": bins, "weight": weight, "fixed": np.zeros(len(rows)), "covered": np.zeros(len(rows)),
        "one": np.ones(len(rows)), "tie": np.zeros(len(rows)), "__open": np.ones(len(rows), int), "__done": np.zeros(len(rows), int),
        "__rank": [rank[k] for k in zip(sid.tolist(), cand.tolist())], "__gain": [total[k] for k in zip(sid.tolist(), cand.tolist())],
        "__t_open": null, "__t_gain": null, "__t_tie": null, "__t_cand": pa.nulls(len(rows), pa.int64())})
    rule = K.Greedy(lambda e, s, least: calls.append(1) or e["weight"] * (1.0 - s["covered"]), {"covered": ("one", "max")}, ("tie",))
    got = pa.Table.from_batches(K._pick_in_batches(rule, 2)(table.to_batches(max_chunksize=1000)))
    assert len(calls) <= 2 * (len(rows) // K.HEAD_ROWS + 1)
    want = []
    for s in range(n):
        first = min(range(3), key=lambda c: (-total[s, c], c))
        covered = {b for t, c, b, _ in rows[9 * s:9 * s + 9] if c == first}
        left = {c: sum(w for t, d, b, w in rows[9 * s:9 * s + 9] if d == c and b not in covered) for c in range(3) if c != first}
        want += [(s, first, 1), (s, min(left, key=lambda c: (-left[c], c)), 2)]
    assert sorted(zip(*[got.column(c).to_pylist() for c in ("spectrum_id", "cand_id", "step")])) == sorted(want)


def test_subformulas_once_per_text(spark, tmp_path):
    """equal formulas are enumerated once."""
    spark.createDataFrame([(132 * i, 6) for i in range(1, 41)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = entry_module.queries()["c10_subformulas"](spark, str(tmp_path))
    assert {(r.n, r.heaviest) for r in got.collect()} == {(7 * 15 * 2, 121.078403)} and got.count() == 40
    assert "text#" in plan_of(got)


def test_library_spelling_and_features_by_text(spark):
    """formulas are parsed once per text; missing texts keep their candidates."""
    rows = spark.createDataFrame([("train", "C2H6O", 4.0, ["OH2", "H2O"]), ("train", "C2H6O", 1.0, ["CH4"])],
                                 "g string, parent_formula string, intensity double, formulas array<string>")
    lib = C.annotation_library(rows, F.col("g"), spelling=lambda f: FX.hill(FX.counts(f)))
    got = {(r.kind, r.formula): (r.intensity, r.n) for r in lib.collect()}
    assert got == {("product", "H2O"): (4.0, 2), ("product", "CH4"): (1.0, 1), ("neutral_loss", "C2H4"): (4.0, 2), ("neutral_loss", "CH2O"): (1.0, 1)}
    cands = spark.createDataFrame([(1, 1, "OH2", "C2H6O"), (1, 2, None, None), (1, 3, "CH4", None)], "spectrum_id long, cand_id long, formula string, parent_formula string")
    found = C.library_features(cands, lib, ["spectrum_id"])
    assert {r.cand_id: (r.product_hit, r.loss_hit) for r in found.collect()} == {1: (1.0, 1.0), 2: (0.0, 0.0), 3: (1.0, 0.0)}


def test_fragments_are_made_once(spark):
    """Subsets, pool and peaks read one written table of fragments; formulas are parsed once per text."""
    plan = plan_of(entry_module.queries()["j18_subset_peaks"](spark, "/root/testdata/sf0.001"))
    assert "MapInArrow" not in plan
    rows = spark.createDataFrame([(1, "C2H6O"), (2, "H3N"), (3, None), (4, "C2H6O"), (5, "CO")], "id long, formula string")
    got = {r.id: (r.heavy, r.h) for r in G.with_heavy(rows).collect()}
    assert got == {1: ("C2O", 6), 2: ("N", 3), 3: (None, 0), 4: ("C2O", 6), 5: ("CO", 0)}


def exchanges(df) -> list[tuple[str, int]]:
    """Columns and number of partitions of every shuffle by key, as planned."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = re.findall(r"Exchange hashpartitioning\((.*?), (\d+)\)", plan)
    return [(re.sub(r"#\d+L?", "", keys), int(n)) for keys, n in found]


def test_overlaps_are_dealt_into_given_partitions(spark):
    """every step has as many partitions as the rows need, none follows the session's number; peaks go by spectrum and bin."""
    cand = [(s, c, b + 0.5, float(1 + (s + c * b) % 7)) for s in range(4) for c in range(6) for b in range(c, c + 9)]
    true = [(s, b + 0.5, float(1 + b % 5)) for s in range(3) for b in range(0, 12, 2)]
    cand_df = spark.createDataFrame(cand, "spectrum_id long, cand_id long, mz double, intensity double")
    true_df = spark.createDataFrame(true, "spectrum_id long, mz double, intensity double")
    got = TG.overlap_scores(T.bin_candidates(cand_df, None, bin_width=1.0, parts=7), T.bin_spectra(true_df, bin_width=1.0, parts=7), 7, 1, 2)
    assert sorted(exchanges(got)) == sorted([("spectrum_id, bin", 7)] * 3 + [("spectrum_id", 7), ("spectrum_id, cand_id", 7)])
    rows = {(r.spectrum_id, r.cand_id): r for r in got.collect()}
    assert len(rows) == 24
    for (s, c), r in rows.items():
        t = {int(mz): i for z, mz, i in true if z == s}
        share = {b: i / sum(t.values()) for b, i in t.items()}
        best = sorted(t, key=lambda b: (-t[b], b))[:2]
        x = {int(mz): i for z, k, mz, i in cand if (z, k) == (s, c)}
        x = {b: i / sum(x.values()) for b, i in x.items()}
        near = lambda b: max(share.get(b + o, 0.0) for o in (-1, 0, 1))  # noqa: E731, B023
        want = (sum(v * share.get(b, 0.0) for b, v in x.items()), sum(v * near(b) for b, v in x.items()),
                sum(v for b, v in x.items() if b in share), sum(v for b, v in x.items() if near(b) > 0),
                sum(v for b, v in x.items() if any(b + o in best for o in (-1, 0, 1))), sum(v for b, v in x.items() if b not in share))
        have = (r.overlap_exact, r.overlap_near, r.support_exact, r.support_near, r.top_near, r.false_exact)
        assert np.allclose(have, want, atol=1e-12), (s, c)


def test_quality_labels_of_large_and_small_pools(spark):
    """spectra are labelled in the given partitions without joins; those of many candidates give the same labels the other way."""
    rng = np.random.default_rng(3)
    rows = []
    for s in range(6):
        for c in range(5 + 4 * s):
            support = float(rng.integers(0, 11)) / 10
            exact, more = float(rng.integers(0, 4)) / 20, float(rng.integers(0, 3)) / 20
            rows.append((s, c, exact, exact + more, support, support, float(rng.integers(0, 5)) / 4, 1.0 - support))
    names = ("overlap_exact", "overlap_near", "support_exact", "support_near", "top_near", "false_exact")
    scores = spark.createDataFrame(rows, "spectrum_id long, cand_id long, " + ", ".join(f"{n} double" for n in names))
    whole = TG.quality_labels(scores, 7, 3, 2, 4)
    assert exchanges(whole) == [("spectrum_id", 7)] and "Join" not in whole._jdf.queryExecution().executedPlan().toString()
    read = lambda df: sorted(map(tuple, df.collect()))
    want = read(whole)
    assert len(want) == len(rows) and {r[5] for r in want} == {0, 1} and sum(r[4] for r in want) > 6
    assert want == read(TG.quality_labels(scores, 7, 3, 2, 4, pool_rows=12)) == read(TG.quality_labels(scores, 7, 3, 2, 4, pool_rows=0))


def test_pairs_without_keys_are_merged_by_bucket(spark):
    """a small table of masses is not broadcast, so the pairs come out bucket by bucket; both limits count."""
    t = spark.createDataFrame([(1, 900.0), (2, 900.25), (3, 900.5), (4, None)], "spectrum_id long, precursor_mz double")
    c = spark.createDataFrame([(7, 900.25), (8, 900.25), (9, 901.0)], "id long, exact_mass double")
    got = J.range_join(t, c, "precursor_mz", "exact_mass", 0.25, inclusive=True)
    plan = plan_of(got)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert sorted((r.spectrum_id, r.id) for r in got.collect()) == [(1, 7), (1, 8), (2, 7), (2, 8), (3, 7), (3, 8)]


def test_output_is_rounded_as_in_sql(spark, tmp_path):
    """Round 4, F1: a share just below a half, whose product with 10^6 is that half, goes up as in SQL."""
    assert 0.16368749999999999 * 1e6 == 163687.5
    values = [0.16368749999999999, -0.16368749999999999, 0.1636874, -1e-9, float("inf")]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(r6("v").alias("v")).collect()
    assert [r.v for r in got] == [0.163688, -0.163688, 0.163687, 0.0, float("inf")]
    # Order 93236 of sf0.1, in the order of the file.
    one = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet").filter("l_orderkey = 93236").toPandas()
    spark.createDataFrame(one).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = entry_module.queries()["f14_sparsify_prediction"](spark, str(tmp_path)).collect()
    assert {r.mz: r.intensity for r in rows}[113.1778] == 0.163688


def small_molecules(spark):
    rng = np.random.default_rng(5)
    atoms = [(m, a, "CNOCH"[int(rng.integers(0, 5))], int(rng.integers(0, 4))) for m in range(6) for a in range(1, 3 + 2 * m)]
    bonds = [(m, a, a, a + 1) for m, a, _, _ in atoms if (m, a + 1) in {x[:2] for x in atoms}] + [(4, 0, 1, 3)]
    return (spark.createDataFrame(atoms, "mol_id long, atom_id long, element string, n_h int"),
            spark.createDataFrame(bonds, "mol_id long, bond_id long, a long, b long"))


def test_formulas_of_cuts_leave_no_atoms(spark):
    """Round 4, F2, F3, F7: formulas are made with the cuts, without rows of atoms, joins and further shuffles."""
    atoms, bonds = small_molecules(spark)
    got = G.cut_formulas(atoms, bonds, -2, 2)
    assert len(exchanges(got)) == 1 and "Join" not in got._jdf.queryExecution().executedPlan().toString()
    want = G.with_heavy(G.fragment_formulas(G.single_cuts(atoms, bonds), ["cut", "side"], atoms, -2, 2))
    cols = ["mol_id", "cut", "side", "h_shift", "formula", "heavy", "h"]
    read = lambda df: sorted((*(r[c] for c in cols), round(r.mass, 9)) for r in df.collect())
    assert read(got) == read(want) and got.count() > 100


def test_subsets_meet_candidates_in_one_shuffle(spark):
    """Round 4, F2, F3, F7: subsets, candidates and peaks of a molecule are matched in the task where they meet."""
    rng = np.random.default_rng(6)
    heavies = ["C", "C2", "CO", None]
    subs = [(m, s, heavies[rng.integers(0, 4)], int(rng.integers(0, 5)), int(rng.integers(1, 4)), int(rng.integers(0, 2)), int(rng.integers(0, 40)) if s % 5 else None)
            for m in range(7) for s in range(12 + m)]
    cands = [(m, c, heavies[rng.integers(0, 4)], int(rng.integers(0, 9)), float(rng.integers(0, 7)) / 10) for m in range(6) for c in range(30)]
    bins = [(m, c, int(rng.integers(0, 5)), float(rng.integers(0, 4))) for m in range(6) for c in range(33) for _ in range(int(rng.integers(0, 4)))]
    sub_df = spark.createDataFrame(subs, "mol_id long, subset_id long, heavy string, h int, depth long, ring long, anchor long").withColumn("formula", F.lit(""))
    cand_df = spark.createDataFrame(cands, "mol_id long, cand_id long, heavy string, h int, prior double").withColumn("formula", F.lit(""))
    bin_df = spark.createDataFrame(bins, "mol_id long, cand_id long, bin long, intensity double")

    marked = G.mark_structural(sub_df.drop("subset_id", "anchor"), cand_df, 2, 1)
    chosen, peaks = G.subset_formulas(sub_df.drop("depth", "ring"), cand_df.drop("prior"), bin_df, 3, 2)
    for df in (marked, chosen, peaks):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert [k for k, _ in exchanges(df)] == ["mol_id"] and "Join" not in plan
    want = {}
    for m, heavy, h in {(x[0], x[2], x[3]) for x in subs if x[2]}:
        own = [x for x in subs if (x[0], x[2], x[3]) == (m, heavy, h)]
        depth, ring = min(x[4] for x in own), max(x[5] for x in own)
        alike = [c for c in cands if (c[0], c[2]) == (m, heavy)]
        close = [c for c in alike if abs(c[3] - h) <= 1]
        able = close if h > 0 and close else alike
        best = sorted(able, key=lambda c: (-round(c[4] - (0.05 * abs(c[3] - h) if h > 0 else 0), 9), c[1]))[:2]  # noqa: B023
        for c in close + best:
            old = want.get((m, c[1]), (99, 0))
            want[m, c[1]] = (min(old[0], depth), max(old[1], ring))
    assert {(r.mol_id, r.cand_id): (r.depth, r.ring) for r in marked.collect()} == want and marked.count() == len(want) > 60
    rank, strength = {}, {}
    for m, s, heavy, _, _, _, anchor in subs:
        own = {c[1]: [b for b in bins if b[:2] == (m, c[1])] for c in cands if heavy and (c[0], c[2]) == (m, heavy)}
        score = lambda c: len(own[c]) + 0.25 * len({b[2] for b in own[c]}) + 0.5 * (c == anchor)  # noqa: E731, B023
        picks = sorted(own, key=lambda c: (-score(c), c))[:3] or ([anchor] if anchor is not None else [])
        rank.update({(m, s, c): i for i, c in enumerate(picks, 1)})
        sums = {}
        for c in picks:
            mine = [b for b in bins if b[:2] == (m, c)]
            for b in mine:
                if (t := sum(x[3] for x in mine)) > 0:
                    sums[b[2]] = sums.get(b[2], 0.0) + b[3] / t
        best = sorted(sums, key=lambda b: (-round(sums[b], 12), b))[:2]  # noqa: B023
        strength.update({(m, s, b): sums[b] / sum(sums[x] for x in best) for b in best})
    assert {(r.mol_id, r.subset_id, r.cand_id): r["rank"] for r in chosen.collect()} == rank
    have = {(r.mol_id, r.subset_id, r.bin): r.intensity for r in peaks.collect()}
    assert have.keys() == strength.keys() and all(abs(have[k] - strength[k]) < 1e-9 for k in have)


def test_probes_are_dealt_into_given_partitions(spark):
    """Round 4, F6: a step is one shuffle into as many partitions as the rows need; pools of any size rank alike; one row a spectrum is summed."""
    cand = [(s, c, b + 0.5, float(1 + (s + c * b) % 7)) for s in range(4) for c in range(6) for b in range(c, c + 9)]
    true = [(s, b + 0.5, float(1 + b % 5)) for s in range(3) for b in range(0, 12, 2)] + [(9, 1.5, 2.0)]
    cand_df = spark.createDataFrame(cand, "spectrum_id long, cand_id long, mz double, intensity double")
    true_df = spark.createDataFrame(true, "spectrum_id long, mz double, intensity double")
    c, t = T.bin_candidates(cand_df, None, bin_width=1.0, parts=7), T.bin_spectra(true_df, bin_width=1.0, parts=7)
    ranks = TG.probe_candidates(c, t, 7, 2)
    assert exchanges(ranks) == [("spectrum_id", 7)] * 2
    read = lambda df: sorted(((*r[:2], r["rank"], *[None if v is None else round(v, 9) for v in r[2:-1]]) for r in df.collect()), key=repr)
    union = TG.union_at_k(c, ranks, t, 7, (1, 2), 2)
    assert {n for _, n in exchanges(union)} == {7} and len(exchanges(union)) == 8
    have, columns = read(ranks), ["spectrum_id", "cand_id", *[x for x in ranks.columns[2:]]]
    assert have == read(TG.probe_candidates(c, t, 7, 2, pool_rows=0).select(*columns)) and len(have) == 24
    order = {}
    for s in range(4):
        tt = {int(mz): i for z, mz, i in true if z == s}
        cos = {}
        for k in range(6):
            x = {int(mz): i for z, n, mz, i in cand if (z, n) == (s, k)}
            norm = sum(v * v for v in x.values()) ** 0.5 * sum(v * v for v in tt.values()) ** 0.5
            cos[k] = round(sum(v * tt.get(b, 0.0) for b, v in x.items()) / norm, 9) if tt else 0.0
        order[s] = sorted(cos, key=lambda k: (-cos[k], k))  # noqa: B023
    assert {(r[0], r[1]): r[2] for r in have} == {(s, k): i for s in order for i, k in enumerate(order[s], 1)}
    got = {(r.spectrum_id, r.k): (r.coverage, r.precision, r.iou) for r in union.collect()}
    assert len(got) == 10 and got[9, 1] == (0.0, None, 0.0)
    for s in order:
        tt = {int(mz): i for z, mz, i in true if z == s}
        for k in (1, 2):
            bins = {int(mz) for z, n, mz, _ in cand if z == s and n in order[s][:k]}
            want = (sum(v for b, v in tt.items() if b in bins) / sum(tt.values()) if tt else 0.0, len(bins & set(tt)) / len(bins), len(bins & set(tt)) / len(bins | set(tt)))
            assert np.allclose(got[s, k], want, atol=1e-12)


def test_region_cover_reads_its_bins_once(spark):
    """Round 4, F8: candidates and bins are summed once, not once for every region and step."""
    rows = [(s, c, 2 * c + o, float(1 + (s + c) % 3)) for s in range(3) for c in range(4 + 2 * s) for o in range(3)]
    reads = {n: spark.sparkContext.accumulator(0) for n in ("bins", "cands")}

    def counted(df, name):
        def run(batches, acc=reads[name]):
            for batch in batches:
                acc.add(batch.num_rows)
                yield batch
        return df.mapInArrow(run, df.schema)

    bins = spark.createDataFrame(rows, "spectrum_id long, cand_id long, bin long, intensity double")
    cands = bins.groupBy("spectrum_id", "cand_id").agg((F.max("cand_id") % 5 + 0.0).alias("base_score"))
    regions = (("low", 0.0, 4.0, 1), ("mid", 4.0, 9.0, 1), ("high", 9.0, 30.0, 2))
    got = K.region_set_cover(counted(cands, "cands"), counted(bins, "bins"), 5, 1, regions, 1.0).collect()
    kept = {s: {r.cand_id: (r.stage, r.left_out) for r in got if r.spectrum_id == s} for s in range(3)}
    assert {s: len(k) for s, k in kept.items()} == {0: 4, 1: 5, 2: 5} and set(kept[0].values()) == {("whole", 0)}
    assert kept[2][4][0] == "source" and {v[1] for v in kept[2].values()} == {3} and {v[1] for v in kept[1].values()} == {1}
    # The pool is grouped and joined back with its counts: two readings.
    assert reads["bins"].value == len(rows) and reads["cands"].value <= 2 * 18


def test_search_joins_small_tables_without_shuffles(spark):
    """Round 4, F4, F5: tiles and copies, which are few, are joined without a shuffle of entries or results by bucket or library id."""
    rng = np.random.default_rng(8)
    spectra = {i: {int(b): float(rng.integers(1, 6)) for b in rng.choice(30, 6, replace=False)} for i in range(60)}
    spectra.update({60 + i: dict(spectra[i % 4]) for i in range(12)})
    pmz = {i: 100.0 + 0.2 * (i % 4 if i < 60 else (i - 60) % 4) for i in spectra}
    bins = spark.createDataFrame([(i, b, x) for i, s in spectra.items() for b, x in s.items()], "spectrum_id long, bin long, intensity double")
    meta = spark.createDataFrame([*pmz.items(), (999, None)], "spectrum_id long, precursor_mz double")
    got = LS.library_search(bins, meta, bins, meta, 0.3, 4)
    assert {"l_id", "bucket", "rep"}.isdisjoint(k for k, _ in exchanges(got))
    unit = {i: {b: x / sum(v * v for v in s.values()) ** 0.5 for b, x in s.items()} for i, s in spectra.items()}
    want = {}
    for q in spectra:
        near = [m for m in spectra if abs(pmz[q] - pmz[m]) <= 0.3 and set(spectra[q]) & set(spectra[m])]
        score = {m: round(sum(x * unit[m].get(b, 0.0) for b, x in unit[q].items()), 9) for m in near}  # noqa: B023
        want.update({(q, n): m for n, m in enumerate(sorted(score, key=lambda m: (-score[m], m))[:4], 1)})  # noqa: B023
    assert {(r.query_id, r["rank"]): r.library_id for r in got.collect()} == want
