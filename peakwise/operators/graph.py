"""Molecule graphs as tables: cuts, fragments, fingerprints and statistics.

Cuts, fragments and the fingerprints of fragments are made where a molecule's
atoms and bonds meet: one shuffle brings them together, and a task walks through
its molecules, many at a time.  Fragments come as rows of atoms or, so that
nothing about them needs a further shuffle, as one array each.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakwise import constants as K
from peakwise.functions import formula as FX
from peakwise.operators.search import _slices, _spread
from peakwise.session import parts_for

MASK_BITS = 63


def element_counts(atoms: DataFrame, h_cap: int = 0) -> DataFrame:
    """Atoms per (molecule, element) including implicit hydrogens, optionally capped."""
    own = atoms.groupBy("mol_id", "element").agg(F.count(F.lit(1)).alias("n"))
    h = F.sum("n_h")
    h = F.least(h, F.lit(h_cap)) if h_cap > 0 else h
    hydrogen = atoms.filter(F.col("element") != "H").groupBy("mol_id").agg(h.alias("n")).select(
        "mol_id", F.lit("H").alias("element"), "n")
    return own.unionByName(hydrogen.filter("n > 0")).groupBy("mol_id", "element").agg(F.sum("n").alias("n"))


class Molecules:
    """Whole molecules of a task: nodes sorted by molecule and atom id, and bonds between known nodes, in their order."""

    def __init__(self, mol: pa.Array, kind: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray, carried: list[pa.Array]):
        ids = mol.to_numpy(zero_copy_only=False)
        start = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        number = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(ids))))
        is_atom = kind == 0
        self.mol, self.number, self.atom_id = mol.take(pa.array(start)), number[is_atom], x[is_atom]
        self.carried = [c.filter(pa.array(is_atom)) for c in carried]
        known_ids, rank = np.unique(self.atom_id, return_inverse=True)
        codes = self.number * (len(known_ids) + 1) + rank
        ends, bond_mol = [a[~is_atom], b[~is_atom]], number[~is_atom]
        known, nodes = np.ones(len(bond_mol), bool), []
        for end in ends:
            at = np.searchsorted(known_ids, end)
            code = bond_mol * (len(known_ids) + 1) + at
            node = np.searchsorted(codes, code)
            at, node = (np.minimum(v, max(len(w) - 1, 0)) for v, w in ((at, known_ids), (node, codes)))
            known &= (known_ids[at] == end) & (codes[node] == code) if len(codes) else False
            nodes.append(node)
        self.bond_mol, self.bond_id = bond_mol[known], x[~is_atom][known]
        self.a, self.b = (n[known] for n in nodes)

    def __iter__(self) -> Iterator[tuple[int, int, int, list[int], list[tuple[int, int]]]]:
        """(molecule, its first and last but one node, bond ids, bonds between places from 0) of each molecule with bonds."""
        n = len(self.mol)
        nodes = np.searchsorted(self.number, np.arange(n + 1)).tolist()
        bonds = np.searchsorted(self.bond_mol, np.arange(n + 1)).tolist()
        bond_id, a, b = self.bond_id.tolist(), self.a.tolist(), self.b.tolist()
        for i in range(n):
            lo, hi = bonds[i], bonds[i + 1]
            if lo < hi:
                first = nodes[i]
                yield i, first, nodes[i + 1], bond_id[lo:hi], [(x - first, y - first) for x, y in zip(a[lo:hi], b[lo:hi])]


def _whole_molecules(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[list[pa.Array]]:
    """The columns of whole molecules, ordered by their id in the first one, with at least so many rows where there are."""
    held: list[pa.RecordBatch] = []  # the last molecule may go on
    rows = 0
    whole = lambda parts: [c.combine_chunks() for c in pa.Table.from_batches(parts).columns]
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(ids == ids[-1])[0])
        ends = cut > 0 or (len(held) > 0 and held[-1].column(0)[-1] != batch.column(0)[0])
        if ends and rows + cut >= least:
            yield whole([*held, batch.slice(0, cut)])
            held, rows, batch = [], 0, batch.slice(cut)
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield whole(held)


def in_molecules(
    atoms: DataFrame, bonds: DataFrame, work: Callable[[Molecules], Iterator[pa.RecordBatch]], schema: str, carry: Sequence[str] = (), order: Sequence[Column] = ()
) -> DataFrame:
    """``work`` on the whole molecules of each task; bonds come best ``order`` first, then by id.

    Rows without molecule or atom id, and bonds to unknown atoms, do not count.
    """
    none = F.lit(None).cast("long")
    ranks = [f"o{i}" for i in range(len(order))]
    long = lambda c: F.col(c).cast("long")
    rows = atoms.select("mol_id", F.lit(0).alias("kind"), long("atom_id").alias("x"), none.alias("a"), none.alias("b"), *carry).unionByName(
        bonds.select("mol_id", F.lit(1).alias("kind"), long("bond_id").alias("x"), long("a").alias("a"), long("b").alias("b"),
                     *[c.alias(r) for c, r in zip(order, ranks)]), allowMissingColumns=True)
    known = rows.filter(F.col("mol_id").isNotNull() & F.col("x").isNotNull() & ((F.col("kind") == 0) | (F.col("a").isNotNull() & F.col("b").isNotNull())))

    def run(batches):
        for cols in _whole_molecules(batches, 0):
            plain = [cols[1].to_numpy(), cols[2].to_numpy(), *(c.fill_null(0).to_numpy() for c in cols[3:5])]
            yield from work(Molecules(cols[0], *plain, cols[5:]))

    return known.repartition("mol_id").sortWithinPartitions("mol_id", "kind", *ranks, "x").select("mol_id", "kind", "x", "a", "b", *carry).mapInArrow(run, schema)


def _bridges(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes in walk order, separating bonds) of a graph of many molecules.

    A bond is a row (bond, first place of its component, last but one, first place below it, last but one, whether its first
    atom is below).  One depth-first walk numbers the nodes so that those below a node stand side by side; a bond separates
    exactly if nothing below it is bonded to anything above.  Linear in nodes and bonds.
    """
    bonds = np.flatnonzero(a != b)
    a, b = a[bonds], b[bonds]
    both = np.concatenate([a, b])
    by_node = np.argsort(both, kind="stable")
    first = np.searchsorted(both[by_node], np.arange(n + 1)).tolist()
    to, via = np.concatenate([b, a])[by_node].tolist(), np.tile(np.arange(len(bonds)), 2)[by_node].tolist()
    seen, low, size, walk, found = [-1] * n, [0] * n, [1] * n, [], []
    place = first[:-1]
    for root in range(n):
        if seen[root] >= 0:
            continue
        begin, before = len(walk), len(found)
        path = [(root, -1)]
        seen[root] = low[root] = begin
        walk.append(root)
        while path:
            here, came = path[-1]
            if place[here] < first[here + 1]:
                step = place[here]
                place[here] += 1
                there, bond = to[step], via[step]
                if bond == came:
                    continue
                if seen[there] < 0:
                    seen[there] = low[there] = len(walk)
                    walk.append(there)
                    path.append((there, bond))
                elif seen[there] < low[here]:
                    low[here] = seen[there]
                continue
            path.pop()
            if path:
                above = path[-1][0]
                low[above] = min(low[above], low[here])
                size[above] += size[here]
                if low[here] > seen[above]:
                    found.append((came, begin, 0, seen[here], seen[here] + size[here], here))
        for i in range(before, len(found)):
            found[i] = (*found[i][:2], len(walk), *found[i][3:])
    cuts = np.array(found, np.int64).reshape(-1, 6)
    cuts[:, 5] = a[cuts[:, 0]] == cuts[:, 5]
    cuts[:, 0] = bonds[cuts[:, 0]]
    return np.array(walk, np.int64), cuts


ROWS = 100_000  # atoms of fragments that a task holds at once


def _sides(m: Molecules) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bond, side, node) of some separating bonds at a time, a row for each atom."""
    walk, cuts = _bridges(len(m.atom_id), m.a, m.b)
    size = cuts[:, 2] - cuts[:, 1]
    edge = np.flatnonzero(np.diff(np.cumsum(size) // ROWS)) + 1
    for some in np.split(np.arange(len(cuts)), edge):
        if not len(some):
            continue
        row = np.repeat(some, size[some])
        step = np.arange(len(row)) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
        place = cuts[row, 1] + step
        below = (place >= cuts[row, 3]) & (place < cuts[row, 4])
        yield cuts[row, 0], np.where(below == (cuts[row, 5] == 1), 0, 1).astype(np.int32), walk[place]


def single_cuts(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Both sides of every bond whose removal separates its two atoms.

    Rows (mol_id, cut, side, atom_id); side 0 holds the bond's first atom.  Atoms that are not connected with the bond
    are not listed; bonds to unknown atoms do not count.  One way for molecules of every size, in time that is linear in
    each molecule and its result.
    """
    def work(m):
        for bond, side, node in _sides(m):
            yield pa.RecordBatch.from_arrays(
                [m.mol.take(pa.array(m.number[node])), pa.array(m.bond_id[bond]), pa.array(side), pa.array(m.atom_id[node])], ["mol_id", "cut", "side", "atom_id"])

    return in_molecules(atoms, bonds, work, f"mol_id {dict(atoms.dtypes)['mol_id']}, cut long, side int, atom_id long")


def single_cut_parts(atoms: DataFrame, bonds: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """``single_cuts`` with one row per side: (mol_id, cut, side, part), ``part`` an array of (atom_id, *carry) by atom id."""
    fields = ["atom_id", *carry]

    def work(m):
        for bond, side, node in _sides(m):
            order = np.lexsort((node, side, bond))  # nodes follow the atom ids
            bond, side, node = bond[order], side[order], node[order]
            start = np.flatnonzero(np.concatenate([[True], (bond[1:] != bond[:-1]) | (side[1:] != side[:-1])]))
            at = pa.array(node)
            part = pa.StructArray.from_arrays([pa.array(m.atom_id[node]), *(c.take(at) for c in m.carried)], fields)
            yield pa.RecordBatch.from_arrays(
                [m.mol.take(pa.array(m.number[node[start]])), pa.array(m.bond_id[bond[start]]), pa.array(side[start]),
                 pa.ListArray.from_arrays(pa.array(np.append(start, len(node)), pa.int32()), part)], ["mol_id", "cut", "side", "part"])

    kinds = dict(atoms.dtypes)
    inner = ", ".join(["atom_id: long", *(f"{c}: {kinds[c]}" for c in carry)])
    return in_molecules(atoms, bonds, work, f"mol_id {kinds['mol_id']}, cut long, side int, part array<struct<{inner}>>", carry)


def _parts(places: Sequence[int], bonds: Sequence[tuple[int, int]]) -> list[list[int]]:
    """Components of the given places, each in their order."""
    up = {x: x for x in places}
    for x, y in bonds:
        while up[x] != x:
            x = up[x]
        while up[y] != y:
            y = up[y]
        up[max(x, y)] = min(x, y)
    parts: dict[int, list[int]] = {}
    for x in places:
        root = x
        while up[root] != root:
            root = up[root]
        up[x] = root
        parts.setdefault(root, []).append(x)
    return list(parts.values())


class _Rows:
    """Rows (molecule, columns, part) collected into batches."""

    def __init__(self, m: Molecules, names: Sequence[str], types: Sequence[pa.DataType]):
        self.m, self.names, self.types = m, ["mol_id", *names], types
        self.atom_id, self.held, self.size = m.atom_id.tolist(), [], 0

    def add(self, i: int, first: int, part: Sequence[int], *cols) -> Iterator[pa.RecordBatch]:
        self.held.append((i, *cols, [self.atom_id[first + x] for x in part]))
        self.size += len(part)
        if self.size >= ROWS:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            mol, *cols = zip(*self.held)
            yield pa.RecordBatch.from_arrays(
                [self.m.mol.take(pa.array(mol)), *(pa.array(c, t) for c, t in zip(cols, [*self.types, pa.list_(pa.int64())]))], [*self.names, "part"])
            self.held, self.size = [], 0


def double_cuts(atoms: DataFrame, bonds: DataFrame, order: Sequence[Column] = (), max_pairs: int | None = None) -> DataFrame:
    """Components after removing two bonds, for every bond pair of each molecule.

    Rows (mol_id, cut_a, cut_b, part); cuts that leave one piece give nothing.
    With ``max_pairs`` only the first pairs of a molecule are cut, and ``pairs_left`` counts the others.
    """
    def work(m):
        names, types = (["cut_a", "cut_b"], [pa.int64()] * 2) if max_pairs is None else (["cut_a", "cut_b", "pairs_left"], [pa.int64()] * 3)
        rows = _Rows(m, names, types)
        for i, first, end, ids, ends in m:
            places, n = range(end - first), len(ids)
            left = [] if max_pairs is None else [max(n * (n - 1) // 2 - max_pairs, 0)]
            pairs = islice(combinations(range(n), 2), max_pairs)
            for x, y in pairs:
                parts = _parts(places, ends[:x] + ends[x + 1:y] + ends[y + 1:])
                if len(parts) > 1:
                    a, b = sorted((ids[x], ids[y]))
                    for part in parts:
                        yield from rows.add(i, first, part, a, b, *left)
        yield from rows.rest()

    kept = "" if max_pairs is None else ", pairs_left long"
    made = in_molecules(atoms, bonds, work, f"mol_id {dict(atoms.dtypes)['mol_id']}, cut_a long, cut_b long{kept}, part array<long>", order=order)
    return made.select("mol_id", "cut_a", "cut_b", "part", *([] if max_pairs is None else ["pairs_left"]))


def recursive_fragments(
    atoms: DataFrame, bonds: DataFrame, order: Sequence[Column] = (), depth: int = 3, branch: int | None = None
) -> DataFrame:
    """Fragments by cutting again inside fragments, down to ``depth``.

    Rows (mol_id, depth, path, part, bonds_left): ``path`` lists the cut bonds
    in order.  With ``branch`` only the best bonds of a fragment are cut, and
    ``bonds_left`` counts the others of the fragment that was cut last.
    A task holds one path of fragments at a time.
    """
    def work(m):
        rows = _Rows(m, ["depth", "path", "bonds_left"], [pa.int32(), pa.list_(pa.int64()), pa.int32()])

        def cut(i, first, part, ids, ends, path):
            left = 0 if branch is None else max(len(ids) - branch, 0)
            for x in range(len(ids) if branch is None else min(branch, len(ids))):
                parts = _parts(part, ends[:x] + ends[x + 1:])
                if len(parts) < 2:
                    continue
                longer = [*path, ids[x]]
                for piece in parts:
                    yield from rows.add(i, first, piece, len(longer), longer, left)
                    if len(longer) < depth and len(piece) > 1:
                        held = set(piece)
                        inside = [k for k, (a, b) in enumerate(ends) if a in held and b in held]
                        yield from cut(i, first, piece, [ids[k] for k in inside], [ends[k] for k in inside], longer)

        for i, first, end, ids, ends in m:
            yield from cut(i, first, range(end - first), ids, ends, [])
        yield from rows.rest()

    made = in_molecules(
        atoms, bonds, work, f"mol_id {dict(atoms.dtypes)['mol_id']}, depth int, path array<long>, bonds_left int, part array<long>", order=order)
    return made.select("mol_id", "depth", "path", "part", "bonds_left")


def cut_fingerprints(atoms: DataFrame, bonds: DataFrame, rounds: int = 3) -> DataFrame:
    """``wl_fingerprint`` of both sides of every separating cut: rows (mol_id, cut, side, fingerprint)."""
    def work(m):
        digest = lru_cache(10_000)(lambda text: hashlib.sha256(text.encode()).hexdigest())  # small fragments are often alike
        elements = m.carried[0].to_pylist()
        near: dict[int, list[int]] = {}
        for x, y in zip(m.a.tolist(), m.b.tolist()):
            near.setdefault(x, []).append(y)
            near.setdefault(y, []).append(x)

        def fingerprint(part):
            inside, labels = set(part), {x: elements[x] for x in part}
            texts = []
            for r in range(rounds + 1):
                if r:
                    around = {x: sorted(f"_{labels[y]}" for y in near.get(x, ()) if y in inside and labels[y] is not None) for x in part}
                    labels = {x: None if labels[x] is None else digest(labels[x] + "".join(around[x])) for x in part}
                texts += [f"{r:02d}|{'null' if label is None else label}|{n}" for label, n in Counter(labels.values()).items()]
            return digest(";".join(sorted(texts)))

        for bond, side, node in _sides(m):
            order = np.lexsort((node, side, bond))
            bond, side, node = bond[order], side[order], node[order]
            start = np.flatnonzero(np.concatenate([[True], (bond[1:] != bond[:-1]) | (side[1:] != side[:-1])]))
            ends, nodes = np.append(start[1:], len(node)).tolist(), node.tolist()
            prints = [fingerprint(nodes[lo:hi]) for lo, hi in zip(start.tolist(), ends)]
            yield pa.RecordBatch.from_arrays(
                [m.mol.take(pa.array(m.number[node[start]])), pa.array(m.bond_id[bond[start]]), pa.array(side[start]), pa.array(prints)],
                ["mol_id", "cut", "side", "fingerprint"])

    return in_molecules(atoms, bonds, work, f"mol_id {dict(atoms.dtypes)['mol_id']}, cut long, side int, fingerprint string", ["element"])


def fragment_formulas(parts: DataFrame, keys: Sequence[str], atoms: DataFrame, h_min: int = -4, h_max: int = 4) -> DataFrame:
    """Formula of every fragment for each hydrogen shift (hydrogens clamped at zero).

    ``parts(keys, mol_id, part)`` with atom-id arrays, or a row per atom with
    ``atom_id``; equal shifts can share a formula.
    """
    cells = parts if "atom_id" in parts.columns else parts.select(*keys, "mol_id", F.explode("part").alias("atom_id"))
    cells = cells.join(atoms, ["mol_id", "atom_id"])
    group = list(dict.fromkeys([*keys, "mol_id"]))
    counts = cells.groupBy(*group, "element").agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum("n_h").cast("int").alias("h"))
    rows = counts.groupBy(*group).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("element", "n")))).alias("heavy"), F.sum("h").cast("int").alias("h"))
    # Only the hydrogen part changes with the shift: the rest of text and mass is made once per fragment.
    one = lambda symbol, n: F.when(n > 0, F.concat(F.lit(symbol), F.when(n == 1, "").otherwise(n.cast("string")))).otherwise("")
    rows = rows.withColumns({
        "__c": one("C", F.coalesce(F.col("heavy")["C"], F.lit(0))),
        "__rest": FX.hill(F.map_filter("heavy", lambda k, v: ~k.isin("C", "H"))), "__m": FX.mass_of(F.col("heavy"))})
    rows = rows.withColumn("h_shift", F.explode(F.sequence(F.lit(h_min), F.lit(h_max)))).withColumn(
        "__h", F.greatest(F.col("h") + F.col("h_shift"), F.lit(0)))
    return rows.select(
        *group, "h_shift", F.concat("__c", one("H", F.col("__h")), "__rest").alias("formula"),
        (F.col("__m") + F.col("__h") * F.lit(K.ISOTOPE_MASS["H"])).alias("mass"))


def cut_formulas(atoms: DataFrame, bonds: DataFrame, h_min: int = -4, h_max: int = 4) -> DataFrame:
    """``fragment_formulas`` of both sides of every separating cut, with ``heavy`` and ``h`` as ``with_heavy`` gives them.

    Rows (mol_id, cut, side, h_shift, formula, mass, heavy, h), made where a molecule's atoms and bonds meet: no row per
    atom leaves the task, and a formula that many fragments of a task have is written once.
    """
    table, shifts = dict(K.ISOTOPE_MASS), np.arange(h_min, h_max + 1)

    def described(elements, counts):
        """Text of carbon, text of the other elements without hydrogen, key and mass of a fragment's elements."""
        some = sorted((e, n) for e, n in zip(elements, counts) if n)
        text = lambda pairs: "".join(e + (str(n) if n > 1 else "") for e, n in pairs)
        mass = 0.0
        for e, n in some:
            mass = None if mass is None or e not in table else mass + table[e] * n
        return (text(x for x in some if x[0] == "C"), text(x for x in some if x[0] not in ("C", "H")), text(x for x in some if x[0] != "H"),
                np.nan if mass is None else mass)

    def work(m):
        coded = m.carried[0].dictionary_encode()
        elements, code = coded.dictionary.to_pylist(), coded.indices.fill_null(len(coded.dictionary)).to_numpy()
        known, n_h = m.carried[1].is_valid().to_numpy(zero_copy_only=False), m.carried[1].fill_null(0).to_numpy()
        for bond, side, node in _sides(m):
            order = np.lexsort((side, bond))
            bond, side, node = bond[order], side[order], node[order]
            start = np.flatnonzero(np.concatenate([[True], (bond[1:] != bond[:-1]) | (side[1:] != side[:-1])]))
            counts = np.stack([np.add.reduceat((code[node] == i).astype(np.int64), start) for i in range(len(elements))], axis=1)
            h = np.add.reduceat(n_h[node], start)[:, None] + shifts
            h = np.where(np.add.reduceat(known[node].astype(np.int64), start)[:, None] > 0, np.maximum(h, 0), 0)
            kinds, kind = np.unique(counts, axis=0, return_inverse=True)
            names = [described(elements, row) for row in kinds.tolist()]
            row, h = np.repeat(np.arange(len(start)), len(shifts)), h.reshape(-1)
            kind = kind.reshape(-1)[row]
            pairs, pair = np.unique(np.stack([kind, h], axis=1), axis=0, return_inverse=True)
            one = lambda n: f"H{n}" if n > 1 else "H" * n
            formula = pa.array([names[k][0] + one(n) + names[k][1] for k, n in pairs.tolist()], pa.string()).take(pa.array(pair.reshape(-1)))
            mass = np.array([x[3] for x in names])[kind] + h * table["H"]
            first = start[row]
            yield pa.RecordBatch.from_arrays(
                [m.mol.take(pa.array(m.number[node[first]])), pa.array(m.bond_id[bond[first]]), pa.array(side[first]),
                 pa.array(np.tile(shifts, len(start)).astype(np.int32)), formula, pa.array(mass, mask=np.isnan(mass)),
                 pa.array([x[2] for x in names], pa.string()).take(pa.array(kind)), pa.array(h.astype(np.int32))],
                ["mol_id", "cut", "side", "h_shift", "formula", "mass", "heavy", "h"])

    schema = f"mol_id {dict(atoms.dtypes)['mol_id']}, cut long, side int, h_shift int, formula string, mass double, heavy string, h int"
    return in_molecules(atoms, bonds, work, schema, ["element", "n_h"])


def single_bond_masses(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Whole-number atom masses of both sides of every separating cut (hydrogens not counted)."""
    table = F.create_map(*[F.lit(x) for e, m in K.ISOTOPE_MASS.items() for x in (e, int(m))])
    parts = single_cut_parts(atoms.withColumn("m", table[F.col("element")]), bonds, ["m"])
    known = F.filter(F.transform("part", lambda x: x["m"]), lambda m: m.isNotNull())
    total = F.aggregate(known, F.lit(0).cast("long"), lambda s, m: s + m)
    return parts.select("mol_id", "cut", "side", F.when(F.size(known) > 0, total).alias("mass"), F.size("part").cast("long").alias("n_atoms"))


HETERO = ("N", "O", "P", "S")


def bond_features(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Local environment of every bond.

    ``bonds`` has bond_order (1, 2, 3, 4 = aromatic), in_ring, aromatic,
    conjugated; ``atoms`` element, n_h, charge, aromatic, in_ring.
    """
    ends = bonds.select("mol_id", "bond_id", F.col("a").alias("atom_id"), F.col("b").alias("other")).unionByName(
        bonds.select("mol_id", "bond_id", F.col("b").alias("atom_id"), F.col("a").alias("other")))
    nb = atoms.select("mol_id", F.col("atom_id").alias("other"), F.col("element").alias("e"), F.col("aromatic").alias("ar"),
                      F.col("in_ring").alias("ri"))
    around = ends.join(nb, ["mol_id", "other"]).groupBy("mol_id", "atom_id").agg(
        F.count(F.lit(1)).alias("degree"), F.sum((~F.col("e").isin("H", "C")).cast("int")).alias("hetero"),
        F.sum("ar").alias("aromatic_nb"), F.sum("ri").alias("ring_nb"))
    full = atoms.join(around, ["mol_id", "atom_id"])
    side = lambda s: full.select(
        "mol_id", F.col("atom_id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in
        ("element", "degree", "charge", "aromatic", "in_ring", "n_h", "hetero", "aromatic_nb", "ring_nb")])
    rows = bonds.join(side("a"), ["mol_id", "a"]).join(side("b"), ["mol_id", "b"])
    both = lambda c: F.col(f"{c}_a") + F.col(f"{c}_b")
    hetero_end = F.col("element_a").isin(*HETERO) | F.col("element_b").isin(*HETERO)
    stability = (
        F.when((F.col("aromatic_a") > 0) | (F.col("aromatic_b") > 0), 0.4).otherwise(0.0)
        + F.when(hetero_end, 0.3).otherwise(0.0) + F.when(F.col("conjugated") > 0, 0.2).otherwise(0.0)
        - F.when(F.col("in_ring") > 0, 0.1).otherwise(0.0))
    order = [(F.col("bond_order") == i).cast("int").alias(n) for i, n in enumerate(("single", "double", "triple", "aromatic_bond"), 1)]
    return rows.select(
        "mol_id", "bond_id", *order, "in_ring", "conjugated",
        *[(F.col(f"degree_{s}") / 4.0).alias(f"degree_{s}") for s in "ab"], *[(F.col(f"n_h_{s}") / 4.0).alias(f"n_h_{s}") for s in "ab"],
        (F.least(both("hetero"), F.lit(6)) / 6.0).alias("hetero_nb"), (F.least(both("aromatic_nb"), F.lit(6)) / 6.0).alias("aromatic_nb"),
        (F.least(both("ring_nb"), F.lit(6)) / 6.0).alias("ring_nb"), stability.alias("stability"))


def wl_fingerprint(
    atoms: DataFrame, bonds: DataFrame, rounds: int = 3, keys: Sequence[str] = ("mol_id",), bond_type: str | None = None
) -> DataFrame:
    """Weisfeiler-Lehman fingerprint per graph: SHA-256 over the label counts of every round.

    An atom's next label hashes its label and its neighbours' sorted labels.
    ``keys`` may add a subgraph id when atoms and bonds are given per subgraph.
    """
    keys = list(keys)
    kind = F.lit("") if bond_type is None else F.concat(F.col(bond_type).cast("string"), F.lit("_"))
    ends = bonds.select(*keys, F.col("a").alias("atom_id"), F.col("b").alias("other"), kind.alias("k")).unionByName(
        bonds.select(*keys, F.col("b").alias("atom_id"), F.col("a").alias("other"), kind.alias("k")))
    labels = atoms.select(*keys, "atom_id", F.col("element").alias("label"))
    counts = labels.groupBy(*keys, F.lit(0).alias("round"), "label").agg(F.count(F.lit(1)).alias("n"))
    for r in range(1, rounds + 1):
        seen = ends.join(labels.withColumnsRenamed({"atom_id": "other", "label": "nl"}), [*keys, "other"])
        around = seen.groupBy(*keys, "atom_id").agg(  # as many entries as the atom has bonds
            F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("_"), "k", "nl"))), "").alias("nb"))
        labels = labels.join(around, [*keys, "atom_id"], "left").select(
            *keys, "atom_id", F.sha2(F.concat("label", F.coalesce("nb", F.lit(""))), 256).alias("label"))
        counts = counts.unionByName(
            labels.groupBy(*keys, F.lit(r).alias("round"), "label").agg(F.count(F.lit(1)).alias("n")))
    text = F.format_string("%02d|%s|%d", "round", "label", "n")
    return counts.groupBy(*keys).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(text)), ";"), 256).alias("fingerprint"))


def molecule_stats(atoms: DataFrame, bonds: DataFrame, elements: Sequence[str] = ("C", "N", "O", "P", "S", "Cl")) -> DataFrame:
    """Atom and bond counts by kind, hydrogens, other elements and the largest degree per element (-1: none)."""
    ends = bonds.select("mol_id", F.explode(F.array("a", "b")).alias("atom_id"))
    degree = ends.groupBy("mol_id", "atom_id").agg(F.count(F.lit(1)).alias("degree"))
    e = F.col("element")
    other = ~e.isin(*elements, "H")
    rows = atoms.join(degree, ["mol_id", "atom_id"], "left").fillna(0, ["degree"])
    stats = rows.groupBy("mol_id").agg(
        F.sum((e != "H").cast("int")).alias("num_atoms"), F.sum("n_h").alias("h_count"), F.sum(other.cast("int")).alias("other_count"),
        F.array_join(F.array_sort(F.collect_set(F.when(other, e))), ",").alias("other_atoms"),
        *[F.sum((e == x).cast("int")).alias(f"n_{x.lower()}") for x in elements],
        *[F.coalesce(F.max(F.when(e == x, F.col("degree"))), F.lit(-1)).alias(f"max_degree_{x.lower()}") for x in elements])
    kinds = bonds.groupBy("mol_id").agg(
        F.count(F.lit(1)).alias("num_bonds"),
        *[F.sum((F.col("bond_order") == i).cast("int")).alias(n) for i, n in enumerate(("single", "double", "triple", "aromatic"), 1)])
    return stats.join(kinds, "mol_id", "left").fillna(0, ["num_bonds", "single", "double", "triple", "aromatic"])


def atom_mask(atom_ids: Column) -> Column:
    """A set of atoms, given as an array of ids, as ``words``: an array of (word, mask), each with the atoms ``63 * word + 0..62``."""
    word = lambda x: F.floor(x / MASK_BITS).cast("int")
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(MASK_BITS)).cast("int"))
    words = F.array_sort(F.array_distinct(F.transform(atom_ids, word)))
    return F.transform(words, lambda w: F.struct(w.alias("word"), F.aggregate(
        F.filter(atom_ids, lambda x: word(x) == w), F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(bit(x))).alias("mask")))


def mask_atoms(words: Column) -> Column:
    """Sorted atom ids of the words of a set."""
    places = F.sequence(F.lit(0), F.lit(MASK_BITS - 1))
    return F.flatten(F.transform(words, lambda w: F.transform(
        F.filter(places, lambda i: F.getbit(w["mask"], i) == 1), lambda i: w["word"] * MASK_BITS + i)))


def heavy_key(count_map: Column) -> Column:
    """Text of the counts without hydrogen."""
    return FX.alphabetic(F.map_filter(count_map, lambda k, v: (k != "H") & (v > 0)))


def with_heavy(df: DataFrame) -> DataFrame:
    """``df`` plus ``heavy`` (text of the counts without hydrogen) and ``h`` of its ``formula``; every text is parsed once.

    A table that has both columns is left as it is.
    """
    if {"heavy", "h"} <= set(df.columns):
        return df
    m = FX.counts(F.col("__text"))
    texts = df.select(F.col("formula").alias("__text")).distinct().select(
        "__text", heavy_key(m).alias("heavy"), F.coalesce(m["H"], F.lit(0)).alias("h"))
    return df.join(texts, F.col("formula").eqNullSafe(F.col("__text")), "left").drop("__text")


MOLECULE_ROWS = 200_000  # rows of molecules that are matched together


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))


def _top(k: int, group: np.ndarray, value: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``k`` largest values of each group, ties by ascending ``tie``, and their ranks from 1."""
    order = np.lexsort((tie, -value, group))
    rank = np.arange(len(order)) - np.searchsorted(group[order], group[order])
    return order[rank < k], rank[rank < k] + 1


def _molecule_rows(tables: Sequence[DataFrame], names: Sequence[str]) -> DataFrame:
    """The rows of all tables, told apart by ``kind``, with whole molecules side by side in partitions of bounded size."""
    rows = None
    for kind, table in enumerate(tables):
        part = table.filter(F.col("mol_id").isNotNull()).withColumn("kind", F.lit(kind))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return rows.select("mol_id", "kind", *names).repartition(parts_for(rows), "mol_id").sortWithinPartitions("mol_id")


def _numbered(mol: pa.Array, heavy: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 of the molecules, in order, and of (molecule, heavy atoms)."""
    ids = mol.to_numpy(zero_copy_only=False)
    number = np.cumsum(np.concatenate([[0], ids[1:] != ids[:-1]]).astype(np.int64))
    coded = heavy.dictionary_encode()
    code = coded.indices.fill_null(len(coded.dictionary)).to_numpy().astype(np.int64)
    return number, number * (len(coded.dictionary) + 1) + code


def mark_structural(
    subsets: DataFrame, pool: DataFrame, top_n: int = 8, h_window: int = 4
) -> DataFrame:
    """Pool candidates a structural subset points at, with the smallest depth and any ring cut.

    ``subsets(mol_id, formula, depth, ring)``, ``pool(mol_id, cand_id, formula,
    prior)``.  By equal heavy atoms the ``top_n`` best by prior minus 0.05 per
    hydrogen difference count, inside the hydrogen window when any is, and only
    where the subset has hydrogens; by exact formula every candidate within the
    window counts.  Subsets with equal counts act once.  Subsets and candidates
    of a molecule meet in one shuffle, and pairs do not leave the task.
    """
    long = lambda c: F.col(c).cast("long").alias(c)
    value = lambda c: F.col(c).cast("double").alias(c)
    sub = with_heavy(subsets).filter(F.col("heavy").isNotNull()).select("mol_id", "heavy", long("h"), value("depth"), value("ring"))
    cand = with_heavy(pool).filter(F.col("heavy").isNotNull()).select("mol_id", "heavy", long("h"), long("cand_id"), value("prior"))
    names = ["heavy", "h", "depth", "ring", "cand_id", "prior"]

    def run(batches):
        for mol, kind, heavy, *cols in _whole_molecules(batches, MOLECULE_ROWS):
            number, group = _numbered(mol, heavy)
            kind = kind.to_numpy()
            at, pl = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
            pl = pl[cols[3].take(pa.array(pl)).is_valid().to_numpy(zero_copy_only=False)]
            if not len(at) or not len(pl):
                continue
            h, cand_id = cols[0].fill_null(0).to_numpy(), cols[3].fill_null(0).to_numpy()
            depth, ring, prior = (c.to_numpy(zero_copy_only=False).astype(float) for c in (cols[1], cols[2], cols[4]))
            at = at[np.lexsort((h[at], group[at]))]
            first = _firsts(group[at], h[at])
            sub_group, sub_h = group[at][first], h[at][first]
            sub_depth, sub_ring = np.fmin.reduceat(depth[at], first), np.fmax.reduceat(ring[at], first)
            pl = pl[np.argsort(group[pl], kind="stable")]
            lo = np.searchsorted(group[pl], sub_group)
            n = np.searchsorted(group[pl], sub_group, "right") - lo
            found = []
            for part in _slices(n):
                s, place = _spread(n[part])
                c, s = pl[place + lo[part][s]], s + part.start
                gap = np.abs(h[c] - sub_h[s])
                close = gap <= h_window
                near = np.bincount(s, close, len(sub_h)) > 0
                able = np.flatnonzero((sub_h[s] <= 0) | ~near[s] | close)
                score = np.round(prior[c] - np.where(sub_h[s] > 0, 0.05 * gap, 0.0), 9)
                score = np.where(np.isnan(score), -np.inf, score)[able]
                best = able[_top(top_n, s[able], score, cand_id[c[able]])[0]]
                both = np.concatenate([best, np.flatnonzero(close)])
                found.append(np.stack([c[both], s[both]]))
            if not found:
                continue
            c, s = np.concatenate(found, axis=1)
            order = np.lexsort((cand_id[c], number[c]))
            c, s = c[order], s[order]
            first = _firsts(number[c], cand_id[c])
            low, high = np.fmin.reduceat(sub_depth[s], first), np.fmax.reduceat(sub_ring[s], first)
            yield pa.RecordBatch.from_arrays(
                [mol.take(pa.array(c[first])), pa.array(cand_id[c[first]]), pa.array(low, mask=np.isnan(low)), pa.array(high, mask=np.isnan(high))],
                ["mol_id", "cand_id", "depth", "ring"])

    made = _molecule_rows([sub, cand], names).mapInArrow(run, f"mol_id {dict(subsets.dtypes)['mol_id']}, cand_id long, depth double, ring double")
    kinds = {**dict(subsets.dtypes), "cand_id": dict(pool.dtypes)["cand_id"]}
    return made.select("mol_id", *[F.col(c).cast(kinds[c]).alias(c) for c in ("cand_id", "depth", "ring")])


def _chosen(number, group, subset, anchor, sub, cand_id, pool, base, top_r):
    """(place of the subset, place of the candidate, rank) of the ``top_r`` best candidates of every subset.

    Only the anchor's score depends on the subset, so the best of a group of equal heavy atoms and the anchor are all that can win.
    """
    by_group = pool[np.lexsort((cand_id[pool], -base[pool], group[pool]))]
    lo = np.searchsorted(group[by_group], group[sub])
    s, place = _spread(np.minimum(np.searchsorted(group[by_group], group[sub], "right") - lo, top_r))
    c, s = by_group[place + lo[s]], sub[s]
    by_id = pool[np.lexsort((cand_id[pool], number[pool]))]
    ids = np.unique(np.concatenate([cand_id[pool], anchor[sub]]))
    code = lambda who, ids_of: number[who] * (len(ids) + 1) + np.searchsorted(ids, ids_of)
    codes, wanted = code(by_id, cand_id[by_id]), code(sub, anchor[sub])
    lo = np.searchsorted(codes, wanted)
    own, place = _spread(np.searchsorted(codes, wanted, "right") - lo)
    there, own = by_id[place + lo[own]], sub[own]
    own, there = own[group[there] == group[own]], there[group[there] == group[own]]
    s, c = np.unique(np.stack([np.concatenate([s, own]), np.concatenate([c, there])]), axis=1)
    score = base[c] + np.where(cand_id[c] == anchor[s], 0.5, 0.0)
    key = np.unique(np.stack([number[s], subset[s]]), axis=1, return_inverse=True)[1].reshape(-1)
    keep, rank = _top(top_r, key, score, cand_id[c])
    return s[keep], c[keep], rank


def subset_formulas(
    subsets: DataFrame, pool: DataFrame, pool_bins: DataFrame, top_r: int = 16, max_peaks: int = 32
) -> tuple[DataFrame, DataFrame]:
    """(formulas per subset, their aggregated peaks).

    Pool formulas with the subset's heavy atoms, best first by number of peaks
    plus a quarter of the distinct bins plus half for the anchor; peaks are
    unit-sum per formula, added per bin, the strongest ``max_peaks`` kept and
    divided by their sum.  ``subsets(mol_id, subset_id, formula, anchor)``,
    ``pool(mol_id, cand_id, formula)``.  Ids are whole numbers.  Subsets,
    candidates and peaks of a molecule meet in one shuffle.
    """
    long = lambda c, name: F.col(c).cast("long").alias(name)
    sub = with_heavy(subsets).filter(F.col("subset_id").isNotNull()).select("mol_id", "heavy", long("subset_id", "id"), long("anchor", "other"))
    cand = with_heavy(pool).filter(F.col("cand_id").isNotNull()).select("mol_id", "heavy", long("cand_id", "id"))
    peaks = pool_bins.filter(F.col("cand_id").isNotNull()).select("mol_id", long("cand_id", "id"), long("bin", "other"), F.col("intensity").cast("double").alias("value"))
    names = ["heavy", "id", "other", "value"]
    group = ["mol_id", "subset_id"]

    def matched(batches, wants_peaks):
        for mol, kind, heavy, ids, other, value in _whole_molecules(batches, MOLECULE_ROWS):
            number, by_heavy = _numbered(mol, heavy)
            kind, has_heavy = kind.to_numpy(), heavy.is_valid().to_numpy(zero_copy_only=False)
            anchored = other.is_valid().to_numpy(zero_copy_only=False)
            ids, other, value = ids.to_numpy(), other.fill_null(-1).to_numpy(), value.fill_null(0.0).to_numpy()
            subs, pooled, cells = (np.flatnonzero(kind == k) for k in range(3))
            # Candidates of the peaks: number of rows, of distinct bins, and total.
            cells = cells[np.lexsort((other[cells], ids[cells], number[cells]))]
            first = _firsts(number[cells], ids[cells])
            size = np.diff(np.append(first, len(cells)))
            new = np.zeros(len(cells), np.int64)
            new[_firsts(number[cells], ids[cells], other[cells])] = 1
            known = np.unique(ids)
            code = number * (len(known) + 1) + np.searchsorted(known, ids)
            with_peaks = code[cells[first]]
            unlike, total = (np.add.reduceat(x, first) if len(first) else np.zeros(0) for x in (new, value[cells]))

            def peaks_of(wanted):
                place = np.minimum(np.searchsorted(with_peaks, wanted), max(len(with_peaks) - 1, 0))
                return place, with_peaks[place] == wanted if len(with_peaks) else np.zeros(len(wanted), bool)

            base = np.zeros(len(ids))
            place, found = peaks_of(code[pooled])
            base[pooled[found]] = size[place[found]] + 0.25 * unlike[place[found]]
            usable = np.where(anchored, other, np.iinfo(np.int64).min)
            s, c, rank = _chosen(number, by_heavy, ids, usable, subs[has_heavy[subs]], ids, pooled[has_heavy[pooled]], base, top_r)
            # Subsets without any candidate stand for their anchor.
            lone = subs[anchored[subs] & ~np.isin(code[subs], code[s])]
            s, cand, rank = np.concatenate([s, lone]), np.concatenate([ids[c], other[lone]]), np.concatenate([rank, np.ones(len(lone), np.int64)])
            if not wants_peaks:
                yield pa.RecordBatch.from_arrays(
                    [mol.take(pa.array(s)), pa.array(ids[s]), pa.array(cand), pa.array(rank.astype(np.int32))], [*group, "cand_id", "rank"])
                continue
            where = np.searchsorted(known, cand)
            place, found = peaks_of(np.where(known[np.minimum(where, len(known) - 1)] == cand, number[s] * (len(known) + 1) + where, -1))
            found &= np.take(np.append(total, 0.0), np.where(found, place, len(total))) > 0
            s, place = s[found], place[found]
            at, step = _spread(size[place])
            cell = cells[first[place][at] + step]
            share = value[cell] / total[place][at]
            order = np.lexsort((other[cell], code[s[at]]))
            row, bins, share = s[at][order], other[cell][order], share[order]
            first = _firsts(code[row], bins)
            row, bins = row[first], bins[first]
            strength = np.round(np.add.reduceat(share, first), 12) if len(first) else np.zeros(0)
            keep, _ = _top(max_peaks, code[row], strength, bins)
            row, bins, strength = row[keep], bins[keep], strength[keep]
            first = _firsts(code[row])
            whole = np.repeat(np.add.reduceat(strength, first), np.diff(np.append(first, len(row)))) if len(first) else strength
            yield pa.RecordBatch.from_arrays([mol.take(pa.array(row)), pa.array(ids[row]), pa.array(bins), pa.array(strength / whole)], [*group, "bin", "intensity"])

    rows = _molecule_rows([sub, cand, peaks], names)
    kinds = {**dict(subsets.dtypes), **{c: dict(t.dtypes)[c] for t, c in ((pool, "cand_id"), (pool_bins, "bin"))}}
    key = f"mol_id {kinds['mol_id']}, subset_id long"
    back = lambda df: df.withColumns({c: F.col(c).cast(kinds[c]) for c in ("subset_id", "cand_id", "bin") if c in df.columns})
    chosen = rows.mapInArrow(lambda b: matched(b, False), f"{key}, cand_id long, rank int")
    made = rows.mapInArrow(lambda b: matched(b, True), f"{key}, bin long, intensity double")
    return back(chosen), back(made)
