"""Queries for molecule graphs.  Every third molecule closes a ring between its first and last atom."""

from pyspark.sql import functions as F

from peakwise.operators import graph as G
from peakwise.plans.registry import query
from peakwise.plans.spectra import out
from peakwise.session import write_once
from peakwise.skew import r6


def atoms(d):
    """Atoms with real element symbols and attributes."""
    e = F.when(F.col("element") == "A", "C").when(F.col("element") == "N", "N").otherwise("O")
    k = F.col("atom_id")
    return d.atoms.select("mol_id", "atom_id", e.alias("element"), "n_h", (k % 2).cast("int").alias("aromatic"),
                          (F.col("mol_id") % 3 == 0).cast("int").alias("in_ring"), F.lit(0).alias("charge"))


def bonds(d):
    size = d.atoms.groupBy("mol_id").agg(F.max("atom_id").alias("n"))
    ring = size.filter((F.col("mol_id") % 3 == 0) & (F.col("n") >= 3)).select(
        "mol_id", F.lit(0).cast("long").alias("bond_id"), F.lit(1).cast("long").alias("a"), F.col("n").alias("b"))
    rows = d.bonds.unionByName(ring)
    return rows.withColumns({
        "bond_order": (F.col("bond_id") % 4 + 1).cast("int"), "in_ring": (F.col("mol_id") % 3 == 0).cast("int"),
        "conjugated": (F.col("bond_id") % 2).cast("int")})


ATOMS_SQL = """atm AS (SELECT mol_id, atom_id, CASE element WHEN 'A' THEN 'C' WHEN 'N' THEN 'N' ELSE 'O' END AS element, n_h, atom_id % 2 AS aromatic,
  CAST(mol_id % 3 = 0 AS int) AS in_ring FROM atoms),
sz AS (SELECT mol_id, max(atom_id) AS n FROM atm GROUP BY 1),
bd0 AS (SELECT mol_id, atom_id AS bond_id, atom_id AS a, atom_id + 1 AS b FROM atm JOIN sz USING (mol_id) WHERE atom_id < n
  UNION ALL SELECT mol_id, 0, 1, n FROM sz WHERE mol_id % 3 = 0 AND n >= 3),
bd AS (SELECT *, bond_id % 4 + 1 AS bond_order, CAST(mol_id % 3 = 0 AS int) AS in_ring, bond_id % 2 AS conjugated FROM bd0),
lin AS (SELECT mol_id, n FROM sz WHERE NOT (mol_id % 3 = 0 AND n >= 3))"""


@query("g01_element_counts", f"""WITH {ATOMS_SQL}, h AS (SELECT mol_id, least(sum(n_h), 10) AS n FROM atm GROUP BY 1)
SELECT mol_id, element, count(*) AS n FROM atm GROUP BY 1, 2 UNION ALL SELECT mol_id, 'H', n FROM h WHERE n > 0""", "atoms")
def _(d):
    return G.element_counts(atoms(d), 10)


SIDES_SQL = """sides AS (SELECT l.mol_id, c.bond_id AS cut, CASE WHEN atom_id <= c.bond_id THEN 0 ELSE 1 END AS side, atom_id
  FROM lin l JOIN bd c ON c.mol_id = l.mol_id JOIN atm ON atm.mol_id = l.mol_id)"""


@query("g02_single_cuts", f"WITH {ATOMS_SQL}, {SIDES_SQL} SELECT * FROM sides", "atoms")
def _(d):
    return G.single_cuts(atoms(d), bonds(d))


@query("g02_components_after_cut", f"""WITH {ATOMS_SQL}, {SIDES_SQL} SELECT mol_id, cut, side, count(*) AS n_atoms, min(atom_id) AS first_atom FROM sides GROUP BY 1, 2, 3""",
       "atoms")
def _(d):
    return G.single_cut_parts(atoms(d), bonds(d)).select(
        "mol_id", "cut", "side", F.size("part").cast("long").alias("n_atoms"), F.col("part")[0]["atom_id"].alias("first_atom"))


DOUBLE_SQL = f"""pr AS (SELECT x.mol_id, n, x.bond_id AS i, y.bond_id AS j, x.mol_id % 3 = 0 AND n >= 3 AS ring FROM bd x JOIN bd y ON x.mol_id = y.mol_id AND x.bond_id < y.bond_id
  JOIN sz ON sz.mol_id = x.mol_id),
lab AS (SELECT pr.*, atom_id, CASE WHEN atom_id <= i THEN CASE WHEN ring THEN 2 ELSE 0 END WHEN atom_id <= j THEN 1 ELSE 2 END AS l FROM pr JOIN atm ON atm.mol_id = pr.mol_id)"""


@query("g03_double_cuts", f"""WITH {ATOMS_SQL}, {DOUBLE_SQL} SELECT mol_id, i AS cut_a, j AS cut_b, string_agg(atom_id, ',' ORDER BY atom_id) AS part FROM lab GROUP BY mol_id, i, j, l""",
       "atoms")
def _(d):
    return G.double_cuts(atoms(d), bonds(d)).withColumn("part", F.array_join(F.col("part").cast("array<string>"), ","))


def cut_order():
    return [F.col("bond_id") % 3]

RECURSE_SQL = """b3 AS (SELECT l.mol_id, n, bond_id FROM lin l JOIN bd USING (mol_id)),
c1 AS (SELECT mol_id, n, bond_id AS c, greatest(count(*) OVER (PARTITION BY mol_id) - 2, 0) AS bl FROM b3 QUALIFY row_number() OVER (PARTITION BY mol_id ORDER BY bond_id % 3, bond_id) <= 2),
f1 AS (SELECT mol_id, 1 AS lo, c AS hi, CAST(c AS varchar) AS path, bl FROM c1 UNION ALL SELECT mol_id, c + 1, n, CAST(c AS varchar), bl FROM c1),
c2 AS (SELECT f1.mol_id, lo, hi, path, bond_id AS c, greatest(hi - lo - 2, 0) AS bl FROM f1 JOIN b3 ON b3.mol_id = f1.mol_id AND bond_id >= lo AND bond_id < hi
  QUALIFY row_number() OVER (PARTITION BY f1.mol_id, lo, hi, path ORDER BY bond_id % 3, bond_id) <= 2),
f2 AS (SELECT mol_id, lo, c AS hi, concat(path, ',', c) AS path, bl FROM c2 UNION ALL SELECT mol_id, c + 1, hi, concat(path, ',', c), bl FROM c2)"""


@query("g04_recursive_fragments", f"""WITH {ATOMS_SQL}, {RECURSE_SQL}
SELECT mol_id, 1 AS depth, path, lo AS first_atom, hi - lo + 1 AS n_atoms, bl AS bonds_left FROM f1
UNION ALL SELECT mol_id, 2, path, lo, hi - lo + 1, bl FROM f2""", "atoms")
def _(d):
    rows = G.recursive_fragments(atoms(d), bonds(d), cut_order(), 2, 2)
    return rows.select("mol_id", "depth", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"),
                       F.array_min("part").alias("first_atom"), F.size("part").alias("n_atoms"), "bonds_left")


# Every bond of a fragment is cut.
RECURSE_ALL_SQL = """b3 AS (SELECT l.mol_id, n, bond_id AS c FROM lin l JOIN bd USING (mol_id)),
f1 AS (SELECT mol_id, 1 AS lo, c AS hi, CAST(c AS varchar) AS path FROM b3 UNION ALL SELECT mol_id, c + 1, n, CAST(c AS varchar) FROM b3),
c2 AS (SELECT f1.*, c FROM f1 JOIN b3 ON b3.mol_id = f1.mol_id AND c >= lo AND c < hi),
f2 AS (SELECT mol_id, lo, c AS hi, concat(path, ',', c) AS path FROM c2 UNION ALL SELECT mol_id, c + 1, hi, concat(path, ',', c) FROM c2)"""


@query("g04_recursive_fragments_all", f"""WITH {ATOMS_SQL}, {RECURSE_ALL_SQL}
SELECT mol_id, 1 AS depth, path, lo AS first_atom, hi - lo + 1 AS n_atoms, 0 AS bonds_left FROM f1
UNION ALL SELECT mol_id, 2, path, lo, hi - lo + 1, 0 FROM f2""", "atoms")
def _(d):
    rows = G.recursive_fragments(atoms(d), bonds(d), cut_order(), 2)
    return rows.select("mol_id", "depth", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"),
                       F.array_min("part").alias("first_atom"), F.size("part").alias("n_atoms"), "bonds_left")


MASS_SQL = "c * 12.0 + n * 14.00307400443 + o * 15.99491461957 + h * 1.00782503223"
FORMULA_SQL = """fr AS (SELECT s.mol_id, cut, side, count(*) FILTER (element = 'C') AS c, count(*) FILTER (element = 'N') AS n, count(*) FILTER (element = 'O') AS o, sum(n_h) AS h0
  FROM sides s JOIN atm ON atm.mol_id = s.mol_id AND atm.atom_id = s.atom_id GROUP BY 1, 2, 3),
fh AS (SELECT fr.*, x AS h_shift, greatest(h0 + x, 0) AS h FROM fr, (SELECT unnest(range(-2, 3)) AS x)),
ft AS (SELECT *, concat(CASE WHEN c > 0 THEN concat('C', CASE WHEN c > 1 THEN CAST(c AS varchar) ELSE '' END) ELSE '' END,
  CASE WHEN h > 0 THEN concat('H', CASE WHEN h > 1 THEN CAST(h AS varchar) ELSE '' END) ELSE '' END,
  CASE WHEN n > 0 THEN concat('N', CASE WHEN n > 1 THEN CAST(n AS varchar) ELSE '' END) ELSE '' END,
  CASE WHEN o > 0 THEN concat('O', CASE WHEN o > 1 THEN CAST(o AS varchar) ELSE '' END) ELSE '' END) AS formula FROM fh)"""


@query("g05_fragment_formulas", f"WITH {ATOMS_SQL}, {SIDES_SQL}, {FORMULA_SQL} SELECT mol_id, cut, side, h_shift, formula, round({MASS_SQL}, 6) AS mass FROM ft", "atoms")
def _(d):
    return out(G.cut_formulas(atoms(d), bonds(d), -2, 2).drop("heavy", "h"), "mass")


@query("g05_single_bond_masses", f"""WITH {ATOMS_SQL}, {SIDES_SQL} SELECT s.mol_id, cut, side, sum(CASE element WHEN 'C' THEN 12 WHEN 'N' THEN 14 ELSE 15 END) AS mass, count(*) AS n_atoms
FROM sides s JOIN atm ON atm.mol_id = s.mol_id AND atm.atom_id = s.atom_id GROUP BY 1, 2, 3""", "atoms")
def _(d):
    return G.single_bond_masses(atoms(d), bonds(d))


@query("g06_bond_features", f"""WITH {ATOMS_SQL}, en AS (SELECT mol_id, a AS x, b AS y FROM bd UNION ALL SELECT mol_id, b, a FROM bd),
ar AS (SELECT en.mol_id, x, count(*) AS deg, sum(CAST(element NOT IN ('H', 'C') AS int)) AS het, sum(aromatic) AS aro, sum(in_ring) AS rin FROM en JOIN atm ON atm.mol_id = en.mol_id AND atm.atom_id = en.y GROUP BY 1, 2),
fu AS (SELECT atm.*, deg, het, aro, rin FROM atm JOIN ar ON ar.mol_id = atm.mol_id AND ar.x = atm.atom_id)
SELECT bd.mol_id, bond_id, CAST(bond_order = 1 AS int) AS single, CAST(bond_order = 2 AS int) AS double, CAST(bond_order = 3 AS int) AS triple, CAST(bond_order = 4 AS int) AS aromatic_bond,
  bd.in_ring, conjugated, p.deg / 4 AS degree_a, q.deg / 4 AS degree_b, p.n_h / 4 AS n_h_a, q.n_h / 4 AS n_h_b, round(least(p.het + q.het, 6) / 6, 6) AS hetero_nb,
  round(least(p.aro + q.aro, 6) / 6, 6) AS aromatic_nb, round(least(p.rin + q.rin, 6) / 6, 6) AS ring_nb,
  round(CASE WHEN p.aromatic > 0 OR q.aromatic > 0 THEN 0.4 ELSE 0 END + CASE WHEN p.element IN ('N', 'O') OR q.element IN ('N', 'O') THEN 0.3 ELSE 0 END
    + CASE WHEN conjugated > 0 THEN 0.2 ELSE 0 END - CASE WHEN bd.in_ring > 0 THEN 0.1 ELSE 0 END, 6) AS stability
FROM bd JOIN fu p ON p.mol_id = bd.mol_id AND p.atom_id = bd.a JOIN fu q ON q.mol_id = bd.mol_id AND q.atom_id = bd.b""", "atoms")
def _(d):
    return out(G.bond_features(atoms(d), bonds(d)), "hetero_nb", "aromatic_nb", "ring_nb", "stability")


def wl_sql(rounds, at, bd, keys):
    ks = ", ".join(keys)
    on = lambda x, y: " AND ".join(f"{x}.{k} = {y}.{k}" for k in keys)
    parts = [f"wen AS (SELECT {ks}, a AS x, b AS y FROM {bd} UNION ALL SELECT {ks}, b, a FROM {bd})",
             f"w0 AS (SELECT {ks}, atom_id, element AS l FROM {at})"]
    for r in range(1, rounds + 1):
        p = r - 1
        parts += [f"n{r} AS (SELECT {', '.join('e.' + k for k in keys)}, x, string_agg(concat('_', l), '' ORDER BY concat('_', l)) AS nb FROM wen e JOIN w{p} w ON {on('e', 'w')} AND w.atom_id = e.y GROUP BY {', '.join('e.' + k for k in keys)}, x)",
                  f"w{r} AS (SELECT {', '.join('w.' + k for k in keys)}, w.atom_id, sha256(concat(l, coalesce(nb, ''))) AS l FROM w{p} w LEFT JOIN n{r} n ON {on('w', 'n')} AND n.x = w.atom_id)"]
    counts = " UNION ALL ".join(f"SELECT {ks}, {r} AS r, l, count(*) AS n FROM w{r} GROUP BY {ks}, l" for r in range(rounds + 1))
    parts.append(f"wc AS ({counts})")
    parts.append(f"wt AS (SELECT {ks}, concat(lpad(CAST(r AS varchar), 2, '0'), '|', l, '|', n) AS t FROM wc)")
    return ",\n".join(parts), f"SELECT {ks}, sha256(string_agg(t, ';' ORDER BY t)) AS fingerprint FROM wt GROUP BY {ks}"


_WL, _WLS = wl_sql(2, "atm", "bd", ["mol_id"])


@query("g07_wl_fingerprint", f"WITH {ATOMS_SQL}, {_WL} {_WLS}", "atoms")
def _(d):
    return G.wl_fingerprint(atoms(d), bonds(d), 2)


_SWL, _SWLS = wl_sql(1, "sa", "sb", ["mol_id", "cut", "side"])


@query("g08_subgraph_fingerprints", f"""WITH {ATOMS_SQL}, {SIDES_SQL}, sa AS (SELECT s.*, element FROM sides s JOIN atm ON atm.mol_id = s.mol_id AND atm.atom_id = s.atom_id),
sb AS (SELECT x.mol_id, x.cut, x.side, bd.a, bd.b FROM bd JOIN sides x ON x.mol_id = bd.mol_id AND x.atom_id = bd.a JOIN sides y ON y.mol_id = bd.mol_id AND y.atom_id = bd.b
  AND x.cut = y.cut AND x.side = y.side), {_SWL} {_SWLS}""", "atoms")
def _(d):
    return G.cut_fingerprints(atoms(d), bonds(d), 1)


@query("g09_molecule_stats", f"""WITH {ATOMS_SQL}, en AS (SELECT mol_id, a AS x FROM bd UNION ALL SELECT mol_id, b FROM bd), dg AS (SELECT mol_id, x, count(*) AS d FROM en GROUP BY 1, 2),
r AS (SELECT atm.*, coalesce(d, 0) AS d FROM atm LEFT JOIN dg ON dg.mol_id = atm.mol_id AND dg.x = atm.atom_id),
k AS (SELECT mol_id, count(*) AS nb, count(*) FILTER (bond_order = 1) AS s, count(*) FILTER (bond_order = 2) AS db, count(*) FILTER (bond_order = 3) AS t, count(*) FILTER (bond_order = 4) AS ar FROM bd GROUP BY 1)
SELECT r.mol_id, count(*) AS num_atoms, sum(n_h) AS h_count, count(*) FILTER (element = 'O') AS other_count, CASE WHEN count(*) FILTER (element = 'O') > 0 THEN 'O' ELSE '' END AS other_atoms,
  count(*) FILTER (element = 'C') AS n_c, count(*) FILTER (element = 'N') AS n_n, coalesce(max(CASE WHEN element = 'C' THEN d END), -1) AS max_degree_c,
  coalesce(max(CASE WHEN element = 'N' THEN d END), -1) AS max_degree_n, coalesce(max(nb), 0) AS num_bonds, coalesce(max(s), 0) AS single, coalesce(max(db), 0) AS double,
  coalesce(max(t), 0) AS triple, coalesce(max(ar), 0) AS aromatic FROM r LEFT JOIN k ON k.mol_id = r.mol_id GROUP BY 1""", "atoms")
def _(d):
    return G.molecule_stats(atoms(d), bonds(d), ("C", "N"))


@query("g10_mask_codec", f"""WITH {ATOMS_SQL}, {SIDES_SQL} SELECT mol_id, cut, side, CAST(sum(1::bigint << atom_id) AS bigint) AS mask, string_agg(atom_id, ',' ORDER BY atom_id) AS atoms FROM sides GROUP BY 1, 2, 3""",
       "atoms")
def _(d):
    ids = F.transform("part", lambda x: x["atom_id"])
    masks = G.single_cut_parts(atoms(d), bonds(d)).select("mol_id", "cut", "side", G.atom_mask(ids).alias("words"))
    atoms_text = F.array_join(G.mask_atoms(F.col("words")).cast("array<string>"), ",")
    return masks.select("mol_id", "cut", "side", F.element_at("words", 1)["mask"].alias("mask"), atoms_text.alias("atoms"))


def shifted(d):
    """Fragments of single cuts with shifted hydrogens, written once: subsets, pool and peaks are read from them."""
    frags = write_once(G.cut_formulas(atoms(d), bonds(d), -2, 2), "fragments")
    return frags.withColumn("key", (F.col("cut") * 2 + F.col("side")) * 5 + F.col("h_shift") + 2)


def subsets(frags):
    return frags.filter("h_shift = 0").select(
        "mol_id", (F.col("cut") * 2 + F.col("side")).alias("subset_id"), "formula", "heavy", "h",
        (F.col("cut") % 3 + 1).alias("depth"), (F.col("cut") % 2).alias("ring"))


def pool(frags):
    """Candidate formulas of a molecule: its fragments with shifted hydrogens."""
    return frags.select("mol_id", F.col("key").alias("cand_id"), "formula", "heavy", "h", ((F.col("key") % 7) / 10.0).alias("prior"))


POOL_SQL = """po AS (SELECT mol_id, (cut * 2 + side) * 5 + h_shift + 2 AS cand_id, c, n, o, h, (((cut * 2 + side) * 5 + h_shift + 2) % 7) / 10.0 AS prior FROM ft),
su AS (SELECT mol_id, cut * 2 + side AS subset_id, c, n, o, h, cut % 3 + 1 AS depth, cut % 2 AS ring FROM ft WHERE h_shift = 0)"""


@query("j19_structural_marking", f"""WITH {ATOMS_SQL}, {SIDES_SQL}, {FORMULA_SQL}, {POOL_SQL},
sd AS (SELECT mol_id, c, n, o, h, min(depth) AS depth, max(ring) AS ring FROM su GROUP BY 1, 2, 3, 4, 5),
p AS (SELECT sd.*, po.cand_id, po.prior, abs(po.h - sd.h) AS gap, max(CASE WHEN abs(po.h - sd.h) <= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY sd.mol_id, sd.c, sd.n, sd.o, sd.h) AS near
  FROM sd JOIN po ON po.mol_id = sd.mol_id AND po.c = sd.c AND po.n = sd.n AND po.o = sd.o),
b AS (SELECT * FROM p WHERE h <= 0 OR near = 0 OR gap <= 1
  QUALIFY row_number() OVER (PARTITION BY mol_id, c, n, o, h ORDER BY round(prior - CASE WHEN h > 0 THEN 0.05 * gap ELSE 0 END, 9) DESC, cand_id) <= 2),
u AS (SELECT mol_id, cand_id, depth, ring FROM b UNION ALL SELECT mol_id, cand_id, depth, ring FROM p WHERE gap <= 1)
SELECT mol_id, cand_id, min(depth) AS depth, max(ring) AS ring FROM u GROUP BY 1, 2""", "atoms")
def _(d):
    frags = shifted(d)
    return G.mark_structural(subsets(frags), pool(frags), 2, 1)


SUBSET_SQL = f"""{POOL_SQL}, pb AS (SELECT mol_id, cand_id, CAST(floor(({MASS_SQL}) / 10) AS bigint) AS bin, 1.0 + cand_id % 3 AS intensity FROM po
  UNION ALL SELECT mol_id, cand_id, CAST(floor(({MASS_SQL}) / 10) AS bigint) + 1, 1.0 FROM po WHERE cand_id % 2 = 0),
pn AS (SELECT mol_id, cand_id, count(*) AS n, count(DISTINCT bin) AS u, sum(intensity) AS t FROM pb GROUP BY 1, 2),
ch AS (SELECT su.mol_id, su.subset_id, po.cand_id, row_number() OVER (PARTITION BY su.mol_id, su.subset_id ORDER BY pn.n + 0.25 * pn.u + CASE WHEN po.cand_id = subset_id * 5 + 2 THEN 0.5 ELSE 0 END DESC, po.cand_id) AS rank
  FROM su JOIN po ON po.mol_id = su.mol_id AND po.c = su.c AND po.n = su.n AND po.o = su.o JOIN pn ON pn.mol_id = po.mol_id AND pn.cand_id = po.cand_id QUALIFY rank <= 3)"""


def _subset_inputs(d):
    frags = shifted(d)
    one = frags.select("mol_id", F.col("key").alias("cand_id"), F.floor(F.col("mass") / 10).alias("bin"))
    bins = one.withColumn("intensity", 1.0 + F.col("cand_id") % 3).unionByName(
        one.filter("cand_id % 2 = 0").select("mol_id", "cand_id", (F.col("bin") + 1).alias("bin"), F.lit(1.0).alias("intensity")))
    sub = subsets(frags).withColumn("anchor", F.col("subset_id") * 5 + 2)
    return G.subset_formulas(sub, pool(frags), bins, 3, 2)


@query("j18_subset_formulas", f"WITH {ATOMS_SQL}, {SIDES_SQL}, {FORMULA_SQL}, {SUBSET_SQL} SELECT * FROM ch", "atoms")
def _(d):
    return _subset_inputs(d)[0]


@query("j18_subset_peaks", f"""WITH {ATOMS_SQL}, {SIDES_SQL}, {FORMULA_SQL}, {SUBSET_SQL},
g AS (SELECT ch.mol_id, subset_id, bin, round(sum(intensity / t), 12) AS x FROM ch JOIN pb ON pb.mol_id = ch.mol_id AND pb.cand_id = ch.cand_id JOIN pn ON pn.mol_id = ch.mol_id AND pn.cand_id = ch.cand_id GROUP BY 1, 2, 3),
k AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY mol_id, subset_id ORDER BY x DESC, bin) <= 2)
SELECT mol_id, subset_id, bin, round(x / sum(x) OVER (PARTITION BY mol_id, subset_id), 6) AS intensity FROM k""", "atoms")
def _(d):
    return out(write_once(_subset_inputs(d)[1], "subset-peaks"), "intensity")
