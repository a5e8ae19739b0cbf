"""Choosing candidates per spectrum.

Rank limits go through ``top_peaks`` (each task sends at most k rows of a
group); "best of a group" is an aggregate, never a window over the group.
Sequential greedy selections go in rounds: Spark sums the gains of all
candidates, a task takes greedy steps among the strongest of a spectrum.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from peakwise.operators.sampling import hash_order
from peakwise.operators.transforms import ID, top_peaks
from peakwise.session import cut_lineage, write_once
from peakwise.skew import lower_medians, with_group_stats

KEYS = ["spectrum_id", "cand_id"]


def plain_topk(cands: DataFrame, k: int, score: str = "score") -> DataFrame:
    return top_peaks(cands, k, ID, score, "cand_id")


def best_of_group(cands: DataFrame, keys: Sequence[str], score: str = "score", id_col: str = "cand_id") -> DataFrame:
    """Id of the highest score per group (ties: smallest id), by aggregate."""
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(id_col)).alias("i")))
    return cands.groupBy(*keys).agg(best.alias("__b")).select(*keys, (-F.col("__b.i")).alias(id_col))


def group_unique_topk(cands: DataFrame, k: int, score: str = "score", fill: bool = True) -> DataFrame:
    """Best candidate of every group by score; with ``fill`` the rest follow until k."""
    best = best_of_group(cands, ["spectrum_id", "group_id"], score).select(*KEYS, F.lit(1).alias("__best"))
    rows = cands.join(best, KEYS, "left").fillna(0, ["__best"])
    if not fill:
        return plain_topk(rows.filter("__best = 1"), k, score).drop("__best")
    order = F.struct(F.col("__best"), F.col(score))
    return top_peaks(rows.withColumn("__o", order), k, ID, "__o", "cand_id").drop("__o", "__best")


def group_max_softmax(cands: DataFrame, score: str = "score", out: str = "prob") -> DataFrame:
    """Softmax over group maxima; candidates within 1e-6 of their group's maximum share its mass."""
    group = [*ID, "group_id"]
    rows = with_group_stats(cands, group, __gmax=F.max(score))
    rows = rows.withColumn("__win", (F.col(score) >= F.col("__gmax") - 1e-6).cast("int"))
    groups = rows.groupBy(*group, "__gmax").agg(F.sum("__win").alias("__n"))
    groups = with_group_stats(groups, ID, __top=F.max("__gmax"))
    groups = with_group_stats(groups, ID, __z=F.sum(F.exp(F.col("__gmax") - F.col("__top"))))
    mass = F.exp(F.col("__gmax") - F.col("__top")) / F.col("__z") / F.col("__n")
    return rows.drop("__gmax").join(groups.select(*group, mass.alias("__p")), group).withColumn(
        out, F.when(F.col("__win") == 1, F.col("__p")).otherwise(0.0)).drop("__win", "__p")


def active_pool(cands: DataFrame, signatures: DataFrame, k: int, score: str = "score") -> DataFrame:
    """All candidates with a source plus the best of each support signature until k are active.

    Spectra where that selects nothing take their k best candidates.
    """
    rows = cands.join(signatures.select(*KEYS, "signature"), KEYS, "left")
    sourced = rows.filter(F.col("source_flag") > 0).select(*KEYS)
    n_sourced = sourced.groupBy(*ID).agg(F.count(F.lit(1)).alias("__n"))
    best = best_of_group(rows.filter(F.col("signature").isNotNull()), [*ID, "signature"], score).select(*KEYS)
    fresh = cands.join(best, KEYS, "left_semi").filter(F.coalesce(F.col("source_flag") <= 0, F.lit(True)))
    added = plain_topk(fresh, k, score).join(n_sourced, ID, "left").filter(
        F.col("rank") <= F.lit(k) - F.coalesce("__n", F.lit(0))).select(*KEYS)
    active = sourced.unionByName(added)
    rest = cands.join(active.select(*ID).distinct(), ID, "left_anti")
    return active.unionByName(plain_topk(rest, k, score).select(*KEYS))


def instance_cap(
    records: DataFrame, mol: str, formula: str, order: Sequence[Column], tie: str, per_formula: int = 3, total: int = 2048
) -> DataFrame:
    """At most ``per_formula`` records per formula and ``total`` per molecule, best first."""
    rows = records.withColumn("__o", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    rows = top_peaks(rows, per_formula, [mol, formula], "__o", tie).drop("rank")
    return top_peaks(rows, total, [mol], "__o", tie).drop("__o", "rank")


def bin_quota(
    records: DataFrame, mol: str, key: str, order: Sequence[Column], max_nodes: int, base_reserve: int,
    recursive_reserve: int, base_per_bin: int, recursive_per_bin: int,
) -> DataFrame:
    """Per-bin quotas with reserves: base records first, recursive ones next, then a plain fill.

    ``records`` has ``bin`` (NULL: off the axis), ``source_type`` (1, 2 base, 3
    recursive) and a ``key`` that may repeat; only the best record of a key
    counts.  Bins used by base records count towards the recursive quota.
    """
    keyed = records.filter(F.col("bin").isNotNull()).withColumn(
        "__o", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))

    def best(rows: DataFrame) -> DataFrame:
        picked = rows.groupBy(mol, key).agg(F.max(F.struct("__o", "bin", "source_type")).alias("__b"))
        return picked.select(mol, key, F.col("__b.__o").alias("__o"), F.col("__b.bin").alias("bin"),
                             F.col("__b.source_type").alias("source_type"))

    def quota(rows: DataFrame, per_bin: int) -> DataFrame:
        return top_peaks(rows, per_bin, [mol, "bin"], "__o", key)

    base = best(keyed.filter(F.col("source_type").isin(1, 2)))
    base = top_peaks(quota(base, base_per_bin).drop("rank"), min(base_reserve, max_nodes), [mol], "__o", key).drop("rank")
    base = cut_lineage(base)  # at most the reserve per molecule, used four times
    used = base.groupBy(mol, "bin").agg(F.count(F.lit(1)).alias("__used"))
    n_base = base.groupBy(mol).agg(F.count(F.lit(1)).alias("__n"))
    rec = best(keyed.filter("source_type = 3").join(base.select(mol, key), [mol, key], "left_anti"))
    rec = quota(rec, recursive_per_bin).join(used, [mol, "bin"], "left").filter(
        F.col("rank") + F.coalesce("__used", F.lit(0)) <= recursive_per_bin).drop("rank", "__used")
    rec = top_peaks(rec, recursive_reserve, [mol], "__o", key).join(n_base, mol, "left").filter(
        F.col("rank") <= F.lit(max_nodes) - F.coalesce("__n", F.lit(0))).drop("rank", "__n")
    chosen = cut_lineage(base.withColumn("stage", F.lit("base")).unionByName(rec.withColumn("stage", F.lit("recursive"))))
    n_chosen = chosen.groupBy(mol).agg(F.count(F.lit(1)).alias("__n"))
    rest = best(keyed.join(chosen.select(mol, key), [mol, key], "left_anti"))
    fill = top_peaks(rest, max_nodes, [mol], "__o", key).join(n_chosen, mol, "left").filter(
        F.col("rank") <= F.lit(max_nodes) - F.coalesce("__n", F.lit(0))).drop("rank", "__n")
    return chosen.unionByName(fill.withColumn("stage", F.lit("fill"))).select(mol, key, "bin", "source_type", "stage")


OVERFLOW_MODES = ("head", "random", "mass", "intensity", "plausibility", "fallback")


def overflow_cap(cands: DataFrame, cap: int, mode: str = "plausibility", seed: int = 0) -> DataFrame:
    """Keeps ``cap`` candidates of every larger pool by the mode's order; flags such pools.

    Needs ``max_mass``, ``total_intensity`` and ``plausibility``.  Mode
    ``raise`` keeps the pool and names the error in ``error`` instead.
    """
    sized = with_group_stats(cands, ID, __n=F.count(F.lit(1)))
    over = (F.col("__n") > cap).cast("int")
    if mode == "raise":
        text = F.concat(F.lit("pool of "), F.col("__n").cast("string"), F.lit(f" exceeds {cap}"))
        return sized.withColumn("overflow", over).withColumn("error", F.when(F.col("__n") > cap, text)).drop("__n")
    score = {
        "head": -F.col("cand_id"), "mass": F.col("max_mass"), "intensity": F.col("total_intensity"),
        "plausibility": F.col("plausibility"), "fallback": F.col("total_intensity") + 1e-4 * F.col("max_mass"),
        "random": hash_order(F.concat_ws(":", "spectrum_id", "cand_id"), seed),
    }[mode]
    return top_peaks(sized.withColumn("__s", score), cap, ID, "__s", "cand_id").withColumn("overflow", over).drop(
        "__s", "__n", "rank")


# ---- greedy selections ----

PICKS = "spectrum_id long, cand_id long, step int"

HEAD = 256  # candidates of a spectrum that one task sees in a round
HEAD_ROWS = 200_000  # and their rows, unless the first candidate alone has more


@dataclass(frozen=True)
class Greedy:
    """A greedy selection whose gains never grow as bins are marked.

    ``gain(entry, state, least)``: what one (candidate, bin) row adds in the current state of its bin; ``entry`` and
    ``state`` give columns by name, of Spark or of numpy, and ``least(x)`` bounds one by 1.  ``marks``: state column ->
    (entry column, "max" or "sum"), how the picks mark their bins.  ``order``: candidate columns that break ties,
    larger first, before the smaller id.
    """

    gain: Callable
    marks: dict[str, tuple[str, str]]
    order: tuple[str, ...]
    min_new: int = 0  # unmarked bins a candidate needs
    block: bool = False  # candidates of a group already picked come after all others
    min_steps: int | None = None  # from so many picks on only gains above 0 count


def _ranked_heads(entries: DataFrame, picks: DataFrame | None, rule: Greedy) -> tuple[DataFrame, DataFrame]:
    """Rows of the strongest candidates of each spectrum with the state of their bins, and the first candidate beyond them."""
    if picks is None:
        rows = entries.withColumns({m: F.lit(0.0) for m in rule.marks}).withColumn("__open", F.lit(1))
    else:
        taken = entries.join(picks.select(*KEYS), KEYS, "left_semi")
        state = taken.groupBy(*ID, "bin").agg(*[(F.max if how == "max" else F.sum)(col).alias(m) for m, (col, how) in rule.marks.items()])
        rows = entries.join(picks.select(*KEYS), KEYS, "left_anti").join(state, [*ID, "bin"], "left").fillna(0.0, list(rule.marks))
        if rule.block:
            groups = taken.select(*ID, "group_id").distinct().withColumn("__open", F.lit(0))
            rows = rows.join(groups, [*ID, "group_id"], "left").fillna(1, ["__open"])
        else:
            rows = rows.withColumn("__open", F.lit(1))
    at = {c: F.col(c) for c in rows.columns}
    fresh = F.lit(True)
    for m in rule.marks:
        fresh = fresh & (F.col(m) == 0)
    gains = rows.groupBy(*KEYS).agg(
        F.max("__open").alias("__open"), F.round(F.sum(rule.gain(at, at, lambda x: F.least(x, F.lit(1.0)))) + F.max("fixed"), 9).alias("__gain"),
        *[F.max(c).alias(c) for c in rule.order], F.sum(fresh.cast("int")).alias("__new"), F.count(F.lit(1)).alias("__rows"))
    gains = gains.filter(F.col("__new") >= rule.min_new)
    tuple_order = [F.col("__open").desc(), F.col("__gain").desc(), *[F.col(c).desc() for c in rule.order], F.col("cand_id")]
    by_order = W.partitionBy(*ID).orderBy(*tuple_order)
    # Spark pushes the rank limit below the shuffle, so these windows see at most HEAD + 1 rows a spectrum.
    ranked = gains.withColumn("__rank", F.row_number().over(by_order)).filter(F.col("__rank") <= HEAD + 1)
    inside = (F.col("__rank") == 1) | ((F.col("__rank") <= HEAD) & (F.sum("__rows").over(by_order.rowsBetween(W.unboundedPreceding, 0)) <= HEAD_ROWS))
    ranked = ranked.withColumn("__inside", inside)
    heads = ranked.filter("__inside").select(*KEYS, "__rank", "__gain")
    first_out = ranked.filter(~F.col("__inside")).groupBy(*ID).agg(F.min_by(
        F.struct(F.col("__open").alias("o"), F.col("__gain").alias("g"), *rule.order, "cand_id"), "__rank").alias("t"))
    beyond = first_out.select(*ID, F.col("t.o").alias("__t_open"), F.col("t.g").alias("__t_gain"),
                              *[F.col(f"t.{c}").alias(f"__t_{c}") for c in rule.order], F.col("t.cand_id").alias("__t_cand"))
    return rows.join(heads, KEYS), beyond


def _pick_in_task(table: pa.Table, rule: Greedy, budget: int) -> pa.Table:
    """Greedy steps among the strongest candidates of every spectrum, as long as no candidate beyond them can be better.

    ``table`` is ordered by spectrum and candidate.  A step is taken in all spectra at once; those that are done leave.
    """
    cols = {n: table.column(n).to_numpy() for n in table.column_names if n not in ("group_id", "__t_cand")}
    starts = lambda *keys: np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)])
    place = lambda at, n: np.repeat(np.arange(len(at)), np.diff(np.r_[at, n]))
    n_rows, of_row = len(cols["spectrum_id"]), cols["spectrum_id"]
    first = starts(of_row)  # first row of each spectrum
    si = place(first, n_rows)
    at = starts(of_row, cols["cand_id"])  # first row of each candidate
    ci, ids, cs = place(at, n_rows), cols["cand_id"][at], si[at]
    by_bin = np.lexsort((cols["bin"], si))
    bi = np.empty(n_rows, np.int64)
    cells = starts(si[by_bin], cols["bin"][by_bin])
    bi[by_bin] = place(cells, n_rows)
    state = {m: cols[m][by_bin[cells]].astype(float) for m in rule.marks}
    fixed, opened = cols["fixed"][at], cols["__open"][at].astype(int)
    ties = [cols[c][at] for c in rule.order]
    if rule.block:
        group = table.column("group_id").combine_chunks().dictionary_encode().indices.to_numpy()[at]
        _, group = np.unique(np.stack([cs, group]), axis=1, return_inverse=True)
        group = group.reshape(-1)
    done, taken = cols["__done"][first].astype(int), np.zeros(len(first), int)
    more = ~np.isnan(cols["__t_open"][first].astype(float))
    limit = [cols[f"__t_{c}"][first] for c in ("open", "gain", *rule.order)] + [-table.column("__t_cand").fill_null(0).to_numpy()[first]]
    free, going = np.ones(len(ids), bool), done < budget
    found: list[np.ndarray] = []
    live, live_cands = np.arange(n_rows), np.arange(len(ids))
    while going.any():
        if going[cs[live_cands]].mean() < 0.5:
            live, live_cands = live[going[si[live]]], live_cands[going[cs[live_cands]]]
        c, b = ci[live], bi[live]
        entry = {n: v[live] for n, v in cols.items()}
        now = {m: v[b] for m, v in state.items()}
        gain = np.round(np.bincount(c, rule.gain(entry, now, lambda x: np.minimum(x, 1.0)), len(ids)) + fixed, 9)
        if not found:  # the first of the ranking, whatever the last digits of the sums are here
            order = np.lexsort((cols["__rank"][at], cs))
            picks = order[starts(cs[order])]
            gain[picks] = cols["__gain"][at[picks]]
            picks = picks[going[cs[picks]]]
        else:
            new = np.bincount(c, np.all([v == 0 for v in now.values()], axis=0), len(ids))
            able = live_cands[going[cs[live_cands]] & free[live_cands] & (new[live_cands] >= rule.min_new)]
            order = able[np.lexsort((ids[able], *[-t[able] for t in reversed(ties)], -gain[able], -opened[able], cs[able]))]
            picks = order[starts(cs[order])] if len(order) else order
            s = cs[picks]
            behind = np.ones(len(picks), bool)  # not better than the first candidate beyond
            for x, bound in reversed(list(zip([opened, gain, *ties, -ids], limit))):
                behind = (x[picks] < bound[s]) | ((x[picks] == bound[s]) & behind)
            picks = picks[~(more[s] & behind)]
        if rule.min_steps is not None:
            s = cs[picks]
            worthless = (gain[picks] <= 0) & (done[s] + taken[s] >= rule.min_steps)
            more[s[worthless]] = False
            picks = picks[~worthless]
        s = cs[picks]
        taken[s] += 1
        going[:] = False
        going[s] = done[s] + taken[s] < budget
        free[picks] = False
        found.append(picks)
        if rule.block:
            hit = np.zeros(group.max() + 1, bool)
            hit[group[picks]] = True
            opened[hit[group]] = 0
        picked = np.zeros(len(ids), bool)
        picked[picks] = True
        mine = live[picked[c]]
        for m, (col, how) in rule.marks.items():
            (np.maximum if how == "max" else np.add).at(state[m], bi[mine], cols[col][mine])
    picks = np.concatenate(found or [np.zeros(0, np.int64)])
    s = cs[picks]
    step = done[s] + 1 + np.repeat(np.arange(len(found)), [len(f) for f in found])
    return pa.table({
        "spectrum_id": pa.array(of_row[at[picks]].astype(np.int64)), "cand_id": pa.array(ids[picks].astype(np.int64)),
        "step": pa.array(step.astype(np.int32)), "more": pa.array((more & (done + taken < budget))[s])})


def _pick_in_batches(rule: Greedy, budget: int):
    """Picks of the spectra of a partition, whole spectra in blocks of about ``HEAD_ROWS`` rows."""
    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < HEAD_ROWS:
                continue
            table = pa.Table.from_batches(held)
            ids = table.column("spectrum_id").to_numpy()
            cut = int(np.searchsorted(ids, ids[-1]))  # the last spectrum may go on
            if cut:
                yield from _pick_in_task(table.slice(0, cut), rule, budget).to_batches()
            held = table.slice(cut).to_batches()
            rows -= cut
        if rows:
            yield from _pick_in_task(pa.Table.from_batches(held), rule, budget).to_batches()

    return run


def lazy_greedy(entries: DataFrame, budget: int, rule: Greedy) -> DataFrame:
    """(spectrum_id, cand_id, step): greedy picks per spectrum, exact for pools of any size.

    A round sums the gains of all candidates of the open spectra in Spark and takes the strongest ``HEAD`` of each
    spectrum to one task.  Since gains never grow, what a candidate beyond them gained in this round bounds what it
    can gain later: the task picks until its best falls behind the first one beyond.  A spectrum of at most ``HEAD``
    candidates needs one round, others as many as their bounds are overtaken; rounds do not follow the budget.
    Each round is written to the shared folder.  ``entries`` has a row per candidate and bin, with ``fixed`` (added to
    the gain) and the columns that break ties repeated on the rows of a candidate.
    """
    spark = entries.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))  # small data would otherwise end in one task
    entries = write_once(entries, "greedy-entries")
    picks, here = None, entries
    while True:
        rows, beyond = _ranked_heads(here, picks, rule)
        rows = rows.join(beyond, ID, "left")
        if picks is None:
            rows = rows.withColumn("__done", F.lit(0))
        else:
            rows = rows.join(picks.groupBy(*ID).agg(F.max("step").alias("__done")), ID)
        found = rows.repartition(width, "spectrum_id").sortWithinPartitions(*KEYS, "bin").mapInArrow(_pick_in_batches(rule, budget), f"{PICKS}, more boolean")
        found = write_once(found, "greedy-picks")
        mine = found.drop("more")
        picks = mine if picks is None else picks.unionByName(mine)
        still = found.filter("more").select(*ID).distinct()
        if still.isEmpty():
            return picks
        here = entries.join(still, ID, "left_semi")


def coverage_aware_topk(
    cands: DataFrame, cand_bins: DataFrame, k: int = 64, prefilter: int | None = None, base_weight: float = 0.2,
    duplicate_penalty: float = 0.35, novelty_bonus: float = 0.10, block_groups: bool = True, score: str = "score",
) -> DataFrame:
    """Greedy top-k that prefers peaks not covered yet; the true spectrum is not used.

    Every candidate of a spectrum can be chosen; ``prefilter`` keeps only the
    best ones by score before that.  Spectra without any peak to cover take
    their plain best.  Gains are compared to nine digits.
    """
    pool = (cands if prefilter is None else plain_topk(cands, max(k, prefilter), score)).select(*KEYS, "group_id", F.col(score).cast("double").alias("score"))
    rows = pool.join(cand_bins.select(*KEYS, "bin", "intensity"), KEYS, "left").fillna(0.0, ["intensity"]).fillna(-1, ["bin"])
    # The middle score is the lower of two middle ones.
    middle = lower_medians(pool, ID, "score", "middle")
    spread = pool.groupBy(*ID).agg(F.greatest(F.coalesce(F.stddev_samp("score"), F.lit(0.0)), F.lit(1e-6)).alias("spread"))
    total = rows.groupBy(*KEYS).agg(F.greatest(F.sum("intensity"), F.lit(1e-8)).alias("total"), F.max("intensity").alias("top"))
    filled = total.groupBy(*ID).agg(F.max("top").alias("any"))
    base = F.least(F.greatest((F.col("score") - F.col("middle")) / F.col("spread"), F.lit(-5.0)), F.lit(5.0))
    seen = F.when(F.col("top") > 0, F.col("intensity") / F.col("top")).otherwise(0.0)
    statics = pool.join(total, KEYS).join(middle, ID).join(spread, ID).join(filled, ID)
    # Of a spectrum without peaks every candidate is its own group, and the score alone decides.
    bare = F.col("any") <= 0
    statics = statics.select(*KEYS, "total", "top", F.when(bare, F.col("score")).otherwise(base_weight * base).alias("fixed"), "score",
                             F.when(~bare, F.col("group_id").cast("string")).alias("group_id"))
    # A candidate without a group is one of its own.
    statics = statics.withColumn("group_id", F.coalesce("group_id", F.concat(F.lit("alone "), "cand_id")))
    entries = rows.select(*KEYS, "bin", "intensity").join(statics, KEYS).select(
        *KEYS, "bin", (F.col("intensity") / F.col("total")).alias("share"), seen.alias("seen"), "fixed", "score", "group_id")
    rule = Greedy(lambda e, s, least: e["share"] * (novelty_bonus - (duplicate_penalty + novelty_bonus) * s["covered"]),
                  {"covered": ("seen", "max")}, ("score",), block=block_groups)
    return lazy_greedy(entries, k, rule)


def setcover_teacher(
    cand_bins: DataFrame, true_bins: DataFrame, steps: int = 16, min_steps: int = 16, prefilter: int | None = None,
    top: int = 20, w_gain: float = 3.0, w_top: float = 1.5, w_false: float = 0.8, w_redundant: float = 0.3,
) -> DataFrame:
    """Greedy cover of the true spectrum by candidate peaks.

    Every candidate can be chosen, with ``prefilter`` only the best of them by base score.
    ``probability``: base scores of the picks, at least 0, as shares of their
    sum; equal shares where all are 0.
    """
    share = with_group_stats(cand_bins, KEYS, __t=F.sum("intensity")).select(
        *KEYS, "bin", (F.col("intensity") / F.greatest("__t", F.lit(1e-8))).alias("share"))
    true = with_group_stats(true_bins, ID, __t=F.sum("intensity")).select(
        *ID, "bin", (F.col("intensity") / F.greatest("__t", F.lit(1e-8))).alias("true_share"))
    best = top_peaks(true, top, ID, "true_share", "bin").select(*ID, "bin", F.lit(1.0).alias("is_top"))
    rows = share.join(true.join(best, [*ID, "bin"], "left"), [*ID, "bin"], "left").fillna(0.0, ["true_share", "is_top"])
    rows = rows.withColumn("support", (F.col("true_share") > 0).cast("double"))
    base = (4.0 * F.col("true_share") + F.col("support") + 2.0 * F.col("is_top") - (1.0 - F.col("support"))) * F.col("share")
    wrong = F.col("share") * (1.0 - F.col("support"))
    scores = rows.groupBy(*KEYS).agg(F.round(F.sum(base), 9).alias("base"), (-w_false * F.sum(wrong)).alias("fixed"))
    pool = scores if prefilter is None else top_peaks(scores, prefilter, ID, "base", "cand_id").drop("rank")
    entries = rows.join(pool, KEYS).select(
        *KEYS, "bin", "base", "fixed", (F.col("share") * F.col("true_share")).alias("tm"), (F.col("share") * F.col("is_top")).alias("pm"))
    rule = Greedy(lambda e, s, least: w_gain * e["tm"] - (w_gain + w_redundant) * e["tm"] * least(s["ct"]) + w_top * e["pm"] * (1.0 - least(s["cp"])),
                  {"ct": ("tm", "sum"), "cp": ("pm", "sum")}, ("base",), min_steps=min_steps)
    picks = lazy_greedy(entries, steps, rule).join(scores.select(*KEYS, F.greatest("base", F.lit(0.0)).alias("__base")), KEYS)
    sums = with_group_stats(picks, ID, __sum=F.sum("__base"), __n=F.count(F.lit(1)))
    share = F.when(F.col("__sum") > 0, F.col("__base") / F.col("__sum")).otherwise(1.0 / F.col("__n"))
    return sums.select(*KEYS, "step", share.alias("probability"))


def weighted_cover(pool: DataFrame, budget: int, min_new: int = 1, already: DataFrame | None = None) -> DataFrame:
    """Greedy maximum coverage per spectrum.

    ``pool(spectrum_id, cand_id, bin, weight, bonus, tie)``: the gain of a
    candidate is the weight of its uncovered bins plus its bonus; it needs
    ``min_new`` uncovered bins.  Ties: larger ``tie``, smaller ``first``,
    smaller id; ``first`` is the candidate's smallest bin, that of the pool where the column is missing.
    Bins in ``already(spectrum_id, bin)`` start covered.
    """
    if "first" not in pool.columns:
        pool = with_group_stats(pool, KEYS, first=F.min("bin"))
    if already is not None:
        pool = pool.join(already.select(*ID, "bin").distinct(), [*ID, "bin"], "left_anti")
    entries = pool.select(*KEYS, "bin", F.col("weight").cast("double").alias("weight"), F.col("bonus").cast("double").alias("fixed"), "tie",
                          (-F.col("first")).alias("early"), F.lit(1.0).alias("one"))
    rule = Greedy(lambda e, s, least: e["weight"] * (1.0 - s["covered"]), {"covered": ("one", "max")}, ("tie", "early"), min_new=min_new)
    return lazy_greedy(entries, budget, rule)


# m/z regions of the set cover and how many candidates each may add.
REGIONS = (("low", 0.0, 220.0, 1024), ("mid", 220.0, 500.0, 1536), ("high", 500.0, 1500.0, 768))


def region_base_score(source: Column, active: Column, prior: Column, peak_n: Column, depth: Column, ring: Column) -> Column:
    """Static order of candidates: source, active flag, prior, peaks, depth and ring cut."""
    bounded = F.least(F.greatest(depth, F.lit(0)), F.lit(10))
    return (
        5.0 * (source > 0).cast("int") + 2.0 * (active > 0).cast("int") + prior + 0.03 * peak_n
        - 0.08 * bounded - 0.2 * (ring > 0).cast("int"))


def region_set_cover(
    cands: DataFrame, cand_bins: DataFrame, max_keep: int = 4096, source_budget: int = 256,
    regions: Sequence[tuple[str, float, float, int]] = REGIONS, bin_width: float = 0.01,
) -> DataFrame:
    """Fills a pool of ``max_keep``: best sources, a set cover per m/z region, then the best rest.

    ``cands`` has ``base_score``.  Pools within the limit are kept whole.
    Inside a region, what the cover leaves of the budget goes to the region's
    best remaining candidates.  ``left_out`` is the number of candidates of the
    spectrum that did not fit.
    """
    sized = write_once(with_group_stats(cands, ID, __n=F.count(F.lit(1))), "cover-pool")
    whole = sized.filter(F.col("__n") <= max_keep).select(*KEYS, F.lit("whole").alias("stage"), F.lit(0).cast("long").alias("left_out"))
    big = sized.filter(F.col("__n") > max_keep)
    left_out = big.select(*ID, (F.col("__n") - max_keep).alias("left_out")).distinct()
    big = big.drop("__n")
    bins = cand_bins.join(big.select(*KEYS, "base_score"), KEYS).select(*KEYS, "bin", "base_score")
    # Read again in every region; the window sees the bins of one candidate.
    bins = write_once(bins.withColumn("first", F.min("bin").over(W.partitionBy(*KEYS))), "cover-bins")

    def room(chosen: DataFrame) -> DataFrame:
        return chosen.groupBy(*ID).agg((F.lit(max_keep) - F.count(F.lit(1))).alias("__room"))

    def take(rows: DataFrame, chosen: DataFrame, n: int, stage: str) -> DataFrame:
        open_rows = rows.join(chosen.select(*KEYS), KEYS, "left_anti")
        ranked = top_peaks(open_rows, n, ID, "base_score", "cand_id").join(room(chosen), ID, "left")
        fits = ranked.filter(F.col("rank") <= F.coalesce("__room", F.lit(max_keep)))
        return fits.select(*KEYS, F.lit(stage).alias("stage"))

    chosen = cut_lineage(top_peaks(big, min(source_budget, max_keep), ID, "base_score", "cand_id").select(
        *KEYS, F.lit("source").alias("stage")))
    for name, lo, hi, budget in regions:
        inside = bins.filter(F.col("bin").between(int(lo / bin_width), int(hi / bin_width) - 1))
        covered = inside.join(chosen.select(*KEYS), KEYS, "left_semi").select(*ID, "bin")
        pool = inside.join(chosen.select(*KEYS), KEYS, "left_anti").select(
            *KEYS, "bin", "first", F.lit(1.0).alias("weight"), F.lit(0.0).alias("bonus"), F.col("base_score").alias("tie"))
        cover = weighted_cover(pool, budget, 1, covered).join(room(chosen), ID, "left").filter(
            F.col("step") <= F.coalesce("__room", F.lit(max_keep))).select(*KEYS, F.lit(name).alias("stage"))
        cover = cut_lineage(cover)
        chosen = chosen.unionByName(cover)
        spent = cover.groupBy(*ID).agg(F.count(F.lit(1)).alias("__spent"))
        rest = inside.select(*KEYS, "base_score").distinct().join(chosen.select(*KEYS), KEYS, "left_anti")
        more = top_peaks(rest, budget, ID, "base_score", "cand_id").join(spent, ID, "left").join(room(chosen), ID, "left")
        more = more.filter((F.col("rank") <= F.lit(budget) - F.coalesce("__spent", F.lit(0)))
                           & (F.col("rank") <= F.coalesce("__room", F.lit(max_keep))))
        chosen = cut_lineage(chosen.unionByName(more.select(*KEYS, F.lit(f"{name}_fill").alias("stage"))))
    picked = chosen.unionByName(take(big, chosen, max_keep, "fill")).join(left_out, ID)
    return whole.unionByName(picked.select(*KEYS, "stage", "left_out"))


def marginal_coverage_cap(
    cands: DataFrame, cand_bins: DataFrame, true_bins: DataFrame, max_keep: int, allow_labels: bool = False,
    chem_weight: float = 0.35, top: int = 20,
) -> DataFrame:
    """Keeps the candidates that add most true intensity, peaks and top peaks.

    It looks at the true spectrum and therefore refuses to run unless
    ``allow_labels`` is set.  ``cands`` has ``plausibility``.  A candidate needs
    two true bins (one when the spectrum has at most four); of candidates with
    equal bins only the best takes part; places the cover leaves open go to the
    largest total gain.
    """
    if not allow_labels:
        raise ValueError("marginal coverage reads the true spectrum; set allow_labels=True for diagnostics")
    sig = cand_bins.groupBy(*KEYS).agg(
        F.bit_xor(F.xxhash64(F.lit(1), "bin")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(2), "bin")).alias("h2"),
        F.count(F.lit(1)).alias("n_bins"), F.sum("intensity").alias("total"))
    best = top_peaks(true_bins, top, ID, "intensity", "bin").select(*ID, "bin", F.lit(1).alias("is_top"))
    sizes = true_bins.groupBy(*ID).agg(F.when(F.count(F.lit(1)) <= 4, 1).otherwise(2).alias("min_hit"))
    true = true_bins.select(*ID, "bin", F.sqrt("intensity").alias("root")).join(best, [*ID, "bin"], "left")
    weight = F.col("root") + 0.8 + 1.2 * F.coalesce("is_top", F.lit(0))
    hits = cand_bins.select(*KEYS, "bin").join(true.select(*ID, "bin", weight.alias("weight")), [*ID, "bin"])
    scored = hits.groupBy(*KEYS).agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("hit_n")).join(sizes, ID)
    scored = scored.filter(F.col("hit_n") >= F.col("min_hit")).join(cands.select(*KEYS, "plausibility"), KEYS).join(sig, KEYS)
    scored = scored.withColumn("gain", F.round(F.col("w") + chem_weight * F.col("plausibility"), 9))
    unique = cut_lineage(scored.join(
        best_of_group(scored, [*ID, "h1", "h2", "n_bins"], "gain").select(*KEYS), KEYS, "left_semi"))
    fits = with_group_stats(unique, ID, __n=F.count(F.lit(1)))
    whole = fits.filter(F.col("__n") <= max_keep).select(*KEYS)
    big = fits.filter(F.col("__n") > max_keep)
    pool = hits.join(big.select(*KEYS, "min_hit", (chem_weight * F.col("plausibility")).alias("bonus"),
                                (F.col("total") + 0.05 * F.col("n_bins")).alias("tie")), KEYS)
    picks = [weighted_cover(pool.filter(F.col("min_hit") == m).drop("min_hit"), max_keep, m) for m in (1, 2)]
    cover = cut_lineage(picks[0].unionByName(picks[1]).select(*KEYS))
    spent = cover.groupBy(*ID).agg(F.count(F.lit(1)).alias("__spent"))
    rest = top_peaks(big.join(cover, KEYS, "left_anti"), max_keep, ID, "gain", "cand_id").join(spent, ID, "left")
    fill = rest.filter(F.col("rank") <= F.lit(max_keep) - F.coalesce("__spent", F.lit(0))).select(*KEYS)
    return whole.unionByName(cover).unionByName(fill)
