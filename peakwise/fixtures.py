"""The given tables seen as spectra, peaks, candidates, formulas and graphs.

``Fixtures`` builds them as DataFrames for the Spark side; ``VIEW_SQL`` states
the same views in SQL for the independent check.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def spectra(self) -> DataFrame:
        key = F.col("o_orderkey")
        pri = F.substring("o_orderpriority", 1, 1)
        return self.table("orders").select(
            key.alias("spectrum_id"),
            F.concat(F.lit("spec:"), key.cast("string")).alias("identifier"),
            F.col("o_custkey").alias("mol_id"),
            F.concat(F.lit("MOL"), F.col("o_custkey").cast("string")).alias("inchikey"),
            (F.col("o_totalprice") / 500.0).alias("precursor_mz"),
            F.when(F.col("o_orderstatus") == "P", "M+H")
            .when(F.col("o_orderstatus") == "O", "[m + na]+")
            .otherwise("[M+NH4]+")
            .alias("adduct_raw"),
            F.when(pri == "1", "Thermo Orbitrap")
            .when(pri == "2", "Q-TOF")
            .when(pri == "3", "IT-FT")
            .when(pri == "4", F.lit(None).cast("string"))
            .otherwise("Other")
            .alias("instrument_raw"),
            F.when(key % 5 == 0, F.concat(F.lit("NCE="), (20 + key % 60).cast("string"), F.lit("%")))
            .when(key % 5 == 1, F.concat((10 + key % 50).cast("string"), F.lit(" eV")))
            .when(key % 5 == 2, (15 + key % 40).cast("string"))
            .when(key % 5 == 3, F.concat(F.lit("HCD "), (30 + key % 30).cast("string"), F.lit("%")))
            .alias("ce_raw"),
        )

    @cached_property
    def peaks(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("spectrum_id"),
            (F.col("l_extendedprice") / 100.0).alias("mz"),
            F.col("l_quantity").alias("intensity"),
        )

    @cached_property
    def pred_peaks(self) -> DataFrame:
        ln = F.col("l_linenumber")
        moved = F.when(ln % 3 == 0, 1).when(ln == 5, -1).otherwise(0)
        return (
            self.table("lineitem")
            .filter(F.col("l_tax") <= 0.06)
            .select(
                F.col("l_orderkey").alias("spectrum_id"),
                ((F.col("l_extendedprice") + moved) / 100.0).alias("mz"),
                (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("intensity"),
            )
        )

    @cached_property
    def cand_peaks(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("spectrum_id"),
            F.col("l_suppkey").alias("cand_id"),
            (F.col("l_partkey") % 4).alias("group_id"),
            (F.col("l_extendedprice") / 100.0).alias("mz"),
            F.col("l_quantity").alias("intensity"),
            F.col("l_discount").alias("prior"),
            (F.round(F.col("l_tax") * 100).cast("int") % 4).alias("source_flag"),
            (F.col("l_linenumber") % 4).alias("break_depth"),
        )

    @cached_property
    def candidates(self) -> DataFrame:
        """One row per (spectrum, candidate) with its strongest prior as score."""
        return self.cand_peaks.groupBy("spectrum_id", "cand_id").agg(
            F.max("group_id").alias("group_id"),
            F.max("prior").alias("prior"),
            F.sum("intensity").alias("score"),
            F.max("source_flag").alias("source_flag"),
            F.max("break_depth").alias("break_depth"),
        )

    @cached_property
    def formulas(self) -> DataFrame:
        k, size = F.col("p_partkey"), F.col("p_size")
        return self.table("part").select(
            k.alias("formula_id"),
            F.concat(
                F.lit("C"), size.cast("string"), F.lit("H"), (2 * size + 2).cast("string"),
                F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("N"), (k % 4).cast("string"))),
                F.when(k % 6 == 0, "").when(k % 6 == 1, "O")
                .otherwise(F.concat(F.lit("O"), (k % 6).cast("string"))),
                F.when(k % 11 == 0, "Cl").otherwise(""),
            ).alias("formula"),
        )

    @cached_property
    def compounds(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("exact_mass")
        )

    @cached_property
    def molecules(self) -> DataFrame:
        """One row per molecule id with the attributes the policies look at."""
        k = F.col("c_custkey")
        size = F.pmod(k, F.lit(70)) + 1
        return self.table("customer").select(
            k.alias("mol_id"),
            F.concat(F.lit("MOL"), k.cast("string")).alias("inchikey"),
            F.concat(F.lit("C"), size.cast("string"), F.lit("H"), (2 * size).cast("string"),
                     F.when(k % 13 == 0, "Si").otherwise("")).alias("formula"),
            size.cast("int").alias("n_heavy"),
            F.when(k % 17 == 0, 1).otherwise(0).alias("charge"),
            F.when(k % 19 == 0, 1).otherwise(0).alias("n_radicals"),
            F.when(k % 23 == 0, 2).otherwise(1).alias("n_components"),
            (k % 6).cast("int").alias("n_rings"),
            F.col("c_name").alias("name"),
            F.col("c_acctbal").alias("balance"),
        )

    @cached_property
    def atoms(self) -> DataFrame:
        order = W.partitionBy("l_orderkey").orderBy("l_extendedprice", "l_partkey")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("mol_id"),
            F.row_number().over(order).cast("long").alias("atom_id"),
            F.col("l_returnflag").alias("element"),
            (F.round("l_quantity").cast("int") % 4).alias("n_h"),
        )

    @cached_property
    def bonds(self) -> DataFrame:
        order = W.partitionBy("l_orderkey").orderBy("l_extendedprice", "l_partkey")
        rows = self.table("lineitem").select(
            F.col("l_orderkey").alias("mol_id"),
            F.row_number().over(order).cast("long").alias("atom_id"),
            F.lead("l_orderkey").over(order).alias("next"),
        )
        return rows.filter(F.col("next").isNotNull()).select(
            "mol_id",
            F.col("atom_id").alias("bond_id"),
            F.col("atom_id").alias("a"),
            (F.col("atom_id") + 1).alias("b"),
        )


VIEW_SQL = {
    "spectra": """spectra AS (
SELECT o_orderkey AS spectrum_id, concat('spec:', cast(o_orderkey AS varchar(20))) AS identifier, o_custkey AS mol_id,
       concat('MOL', cast(o_custkey AS varchar(20))) AS inchikey, o_totalprice / 500.0 AS precursor_mz,
       CASE o_orderstatus WHEN 'P' THEN 'M+H' WHEN 'O' THEN '[m + na]+' ELSE '[M+NH4]+' END AS adduct_raw,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Thermo Orbitrap' WHEN '2' THEN 'Q-TOF' WHEN '3' THEN 'IT-FT'
            WHEN '4' THEN NULL ELSE 'Other' END AS instrument_raw,
       CASE o_orderkey % 5 WHEN 0 THEN concat('NCE=', cast(20 + o_orderkey % 60 AS varchar(20)), '%')
            WHEN 1 THEN concat(cast(10 + o_orderkey % 50 AS varchar(20)), ' eV')
            WHEN 2 THEN cast(15 + o_orderkey % 40 AS varchar(20))
            WHEN 3 THEN concat('HCD ', cast(30 + o_orderkey % 30 AS varchar(20)), '%') ELSE NULL END AS ce_raw
FROM orders)""",
    "peaks": """peaks AS (
SELECT l_orderkey AS spectrum_id, l_extendedprice / 100.0 AS mz, l_quantity AS intensity FROM lineitem)""",
    "pred_peaks": """pred_peaks AS (
SELECT l_orderkey AS spectrum_id,
       (l_extendedprice + CASE WHEN l_linenumber % 3 = 0 THEN 1 WHEN l_linenumber = 5 THEN -1 ELSE 0 END) / 100.0 AS mz,
       l_quantity * (1 - l_discount) AS intensity
FROM lineitem WHERE l_tax <= 0.06)""",
    "cand_peaks": """cand_peaks AS (
SELECT l_orderkey AS spectrum_id, l_suppkey AS cand_id, l_partkey % 4 AS group_id, l_extendedprice / 100.0 AS mz,
       l_quantity AS intensity, l_discount AS prior, CAST(round(l_tax * 100) AS int) % 4 AS source_flag,
       l_linenumber % 4 AS break_depth
FROM lineitem)""",
    "candidates": """candidates AS (
SELECT spectrum_id, cand_id, max(group_id) AS group_id, max(prior) AS prior, sum(intensity) AS score,
       max(source_flag) AS source_flag, max(break_depth) AS break_depth
FROM cand_peaks GROUP BY spectrum_id, cand_id)""",
    "formulas": """formulas AS (
SELECT p_partkey AS formula_id,
       concat('C', cast(p_size AS varchar(20)), 'H', cast(2 * p_size + 2 AS varchar(20)),
              CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('N', cast(p_partkey % 4 AS varchar(20))) END,
              CASE WHEN p_partkey % 6 = 0 THEN '' WHEN p_partkey % 6 = 1 THEN 'O'
                   ELSE concat('O', cast(p_partkey % 6 AS varchar(20))) END,
              CASE WHEN p_partkey % 11 = 0 THEN 'Cl' ELSE '' END) AS formula
FROM part)""",
    "compounds": """compounds AS (SELECT p_partkey AS id, p_retailprice AS exact_mass FROM part)""",
    "molecules": """molecules AS (
SELECT c_custkey AS mol_id, concat('MOL', cast(c_custkey AS varchar(20))) AS inchikey,
       concat('C', cast(c_custkey % 70 + 1 AS varchar(20)), 'H', cast(2 * (c_custkey % 70 + 1) AS varchar(20)),
              CASE WHEN c_custkey % 13 = 0 THEN 'Si' ELSE '' END) AS formula,
       CAST(c_custkey % 70 + 1 AS int) AS n_heavy,
       CASE WHEN c_custkey % 17 = 0 THEN 1 ELSE 0 END AS charge,
       CASE WHEN c_custkey % 19 = 0 THEN 1 ELSE 0 END AS n_radicals,
       CASE WHEN c_custkey % 23 = 0 THEN 2 ELSE 1 END AS n_components,
       CAST(c_custkey % 6 AS int) AS n_rings, c_name AS name, c_acctbal AS balance
FROM customer)""",
    "atoms": """atoms AS (
SELECT l_orderkey AS mol_id,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey) AS atom_id,
       l_returnflag AS element, CAST(round(l_quantity) AS int) % 4 AS n_h
FROM lineitem)""",
    "bonds": """bonds AS (
SELECT x.mol_id, atom_id AS bond_id, atom_id AS a, atom_id + 1 AS b
FROM atoms x JOIN (SELECT mol_id, max(atom_id) AS last FROM atoms GROUP BY mol_id) y ON x.mol_id = y.mol_id
WHERE atom_id < last)""",
}

_NEEDS = {"candidates": ["cand_peaks"], "bonds": ["atoms"]}


def with_views(sql: str, *views: str) -> str:
    """``sql`` (starting with WITH or SELECT) preceded by the named views."""
    names: list[str] = []
    for view in views:
        for name in [*_NEEDS.get(view, []), view]:
            if name not in names:
                names.append(name)
    sql = sql.strip()
    if not names:
        return sql
    head = "WITH RECURSIVE " + ",\n".join(VIEW_SQL[name] for name in names)
    if sql[:5].upper() == "WITH ":
        return f"{head},\n{sql[5:]}"
    return f"{head}\n{sql}"
