"""Schemas of the stored tables and the checks that rows must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double,z:double>"
ATOM = "struct<z:smallint,charge:smallint,res_name:string,atom_name:string,res_id:int>"
BOND = "struct<i:int,j:int,type:int>"
INTERACTION = "struct<p_atoms:array<int>,l_atoms:array<int>,type:string>"

MOLECULES = f"mol_id bigint, atoms array<{ATOM}>, bonds array<{BOND}>, meta map<string,string>"
CONFORMERS = f"mol_id bigint, conf_id int, weight float, xyz array<{POINT}>"
PROTEINS = f"protein_id bigint, atoms array<{ATOM}>, bonds array<{BOND}>, xyz array<{POINT}>, meta map<string,string>"
COMPLEXES = (
    f"complex_id bigint, protein struct<atoms:array<{ATOM}>,bonds:array<{BOND}>,xyz:array<{POINT}>>, "
    f"ligand struct<atoms:array<{ATOM}>,bonds:array<{BOND}>,xyz:array<{POINT}>>, interactions array<{INTERACTION}>, meta map<string,string>"
)


def molecule_faults(atoms: Column, bonds: Column, xyz: Column | None = None) -> Column:
    """Row: the first fault of a molecule, or null: bond ends in range, as many points as atoms."""
    n = F.size(atoms)
    out = F.when(F.exists(bonds, lambda b: (b["i"] < 0) | (b["j"] < 0) | (b["i"] >= n) | (b["j"] >= n)), "bond end out of range")
    return out if xyz is None else out.when(F.size(xyz) != n, "points and atoms differ in number")


def protein_faults(atoms: Column, bonds: Column, xyz: Column) -> Column:
    """Row: as molecule_faults(); residues must be complete, residue names up to 3 and atom names up to 4 characters."""
    return F.coalesce(
        molecule_faults(atoms, bonds, xyz),
        F.when(F.exists(atoms, lambda a: a["res_name"].isNull() | a["atom_name"].isNull() | a["res_id"].isNull()), "residue annotation missing")
        .when(F.exists(atoms, lambda a: F.length(a["res_name"]) > 3), "residue name longer than 3")
        .when(F.exists(atoms, lambda a: F.length(a["atom_name"]) > 4), "atom name longer than 4"),
    )


def interaction_faults(interactions: Column, n_protein: Column, n_ligand: Column) -> Column:
    beyond = lambda atoms, n: F.exists(atoms, lambda a: (a < 0) | (a >= n))
    return F.when(F.exists(interactions, lambda i: beyond(i["p_atoms"], n_protein) | beyond(i["l_atoms"], n_ligand)), "interaction atom out of range")


def all_or_none(rows: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """(by, ok): is an optional column set in every row of a batch or in none? by names the batches; without it all rows are one."""
    return rows.groupBy(*by or []).agg(F.count_if(F.col(column).isNull()).isin(F.lit(0), F.count(F.lit(1))).alias("ok"))


def enforced(rows: DataFrame, fault: Column) -> DataFrame:
    """rows; reading one with a fault is an error that names it."""
    first = rows.columns[0]
    return rows.withColumn(first, F.when(fault.isNotNull(), F.raise_error(fault)).otherwise(F.col(first)))
