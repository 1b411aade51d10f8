"""Bonds of proteins whose files name none: residue templates first, links between residues, then covalent radii for the rest.

atoms: (protein, atom, z, name, res_name, chain, res_id, px, py, pz): z is the atomic number, px to pz the place,
as in ATOMS. Where a file gives alternate locations, resolved() keeps one of each atom first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators.joins import distance_join

#: Columns of atoms; altloc and occupancy are needed by resolved() alone.
ATOMS = "protein long, atom int, z int, name string, res_name string, chain string, res_id int, px double, py double, pz double"

# Heavy-atom bonds of the standard residues, - single and = double; the backbone's belong to all of them.
BACKBONE = "N-CA CA-C C=O C-OXT"
SIDE_CHAINS = {
    "ALA": "CA-CB",
    "ARG": "CA-CB CB-CG CG-CD CD-NE NE-CZ CZ-NH1 CZ=NH2",
    "ASN": "CA-CB CB-CG CG=OD1 CG-ND2",
    "ASP": "CA-CB CB-CG CG=OD1 CG-OD2",
    "CYS": "CA-CB CB-SG",
    "GLN": "CA-CB CB-CG CG-CD CD=OE1 CD-NE2",
    "GLU": "CA-CB CB-CG CG-CD CD=OE1 CD-OE2",
    "GLY": "",
    "HIS": "CA-CB CB-CG CG=CD2 CD2-NE2 NE2-CE1 CE1=ND1 ND1-CG",
    "ILE": "CA-CB CB-CG1 CB-CG2 CG1-CD1",
    "LEU": "CA-CB CB-CG CG-CD1 CG-CD2",
    "LYS": "CA-CB CB-CG CG-CD CD-CE CE-NZ",
    "MET": "CA-CB CB-CG CG-SD SD-CE",
    "PHE": "CA-CB CB-CG CG=CD1 CD1-CE1 CE1=CZ CZ-CE2 CE2=CD2 CD2-CG",
    "PRO": "CA-CB CB-CG CG-CD CD-N",
    "SER": "CA-CB CB-OG",
    "THR": "CA-CB CB-OG1 CB-CG2",
    "TRP": "CA-CB CB-CG CG=CD1 CD1-NE1 NE1-CE2 CE2=CD2 CD2-CG CE2-CZ2 CZ2=CH2 CH2-CZ3 CZ3=CE3 CE3-CD2",
    "TYR": "CA-CB CB-CG CG=CD1 CD1-CE1 CE1=CZ CZ-CE2 CE2=CD2 CD2-CG CZ-OH",
    "VAL": "CA-CB CB-CG1 CB-CG2",
}
# The aromatic atoms of residues.
AROMATIC = {"HIS": "CG CD2 NE2 CE1 ND1", "PHE": "CG CD1 CE1 CZ CE2 CD2", "TYR": "CG CD1 CE1 CZ CE2 CD2", "TRP": "CG CD1 NE1 CE2 CD2 CZ2 CH2 CZ3 CE3"}
# Covalent radii by atomic number.
RADII = {1: 0.31, 5: 0.84, 6: 0.76, 7: 0.71, 8: 0.66, 9: 0.57, 14: 1.11, 15: 1.07, 16: 1.05, 17: 1.02, 34: 1.20, 35: 1.20, 53: 1.39}
# Order and aromaticity by the bond codes of structure files; codes 0, 4 and 8 (any, quadruple, coordination) aren't supported.
CODES = {1: (1, False), 2: (2, False), 3: (3, False), 5: (1, True), 6: (2, True), 7: (3, True), 9: (1, True)}
#: Bonds between residues are at most so long; others exceed the sum of radii by so much at most, and are longer than the least.
PEPTIDE, DISULPHIDE, SLACK, LEAST = 2.0, 2.5, 0.45, 0.4


def template_rows() -> list[tuple[str, str, str, int, bool]]:
    """(res_name, first name, second name, order, aromatic) of the bonds of all residues."""
    out = []
    for residue, side in SIDE_CHAINS.items():
        ring = AROMATIC.get(residue, "").split()
        for bond in f"{BACKBONE} {side}".split():
            a, b = bond.replace("=", "-").split("-")
            out.append((residue, a, b, 1 + ("=" in bond), a in ring and b in ring))
    return out


def bond_of_code(code: Column) -> Column:
    """struct<type,aromatic> of a structure file's bond code; one that isn't supported is an error when it is read."""
    table = F.create_map(*(x for k, (order, aromatic) in CODES.items() for x in (F.lit(k), F.struct(F.lit(order).alias("type"), F.lit(aromatic).alias("aromatic")))))
    found = F.try_element_at(table, code)
    return F.when(found.isNull(), F.raise_error(F.concat(F.lit("unsupported bond code "), F.coalesce(code.cast("string"), F.lit("null"))))).otherwise(found)


def resolved(atoms: DataFrame) -> DataFrame:
    """One row for each atom (protein, chain, res_id, res_name, name): the location of greatest occupancy, the first by altloc of equals."""
    order = Window.partitionBy("protein", "chain", "res_id", "res_name", "name").orderBy(F.desc_nulls_last("occupancy"), F.asc_nulls_first("altloc"), "atom")
    return atoms.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def _bond(a: str, b: str, order: Column | int = 1, aromatic: Column | bool = False, kind: str = "") -> list[Column]:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return [F.col("protein"), F.least(a, b).alias("i"), F.greatest(a, b).alias("j"), lit(order).alias("type"), lit(aromatic).alias("aromatic"), F.lit(kind).alias("kind")]


def template_bonds(atoms: DataFrame) -> DataFrame:
    """(protein, i, j, type, aromatic, kind) of the bonds that residues have by their name; missing atoms have none."""
    spark: SparkSession = atoms.sparkSession
    rows = spark.createDataFrame(template_rows(), "res_name string, _first string, _second string, _order int, _aromatic boolean")
    keys = ["protein", "chain", "res_id", "res_name"]
    first = atoms.select(*keys, "name", F.col("atom").alias("_i")).join(F.broadcast(rows), ["res_name"])  # under 200 rows
    first = first.where("name = _first").drop("name", "_first")
    second = atoms.select(*keys, F.col("name").alias("_second"), F.col("atom").alias("_j"))
    return first.join(second, [*keys, "_second"]).select(*_bond("_i", "_j", F.col("_order"), F.col("_aromatic"), "template"))


def _gap(a: str, b: str) -> Column:
    return F.sqrt(sum(((F.col(f"{a}{c}") - F.col(f"{b}{c}")) * (F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in "xyz"), F.lit(0.0)))


def peptide_bonds(atoms: DataFrame) -> DataFrame:
    """Bonds of a residue's C with the N of the next residue of its chain, by res_id, where they are near enough."""
    names = F.broadcast(atoms.sparkSession.createDataFrame([(r,) for r in SIDE_CHAINS], "res_name string"))
    known = atoms.join(names, "res_name", "left_semi").where("name in ('C', 'N')")
    at = lambda name, out: F.max(F.when(F.col("name") == name, F.struct("atom", *(F.col(f"p{c}").alias(c) for c in "xyz")))).alias(out)
    residues = known.groupBy("protein", "chain", "res_id").agg(at("C", "c"), at("N", "n"))
    # The next residue in a chain, whatever is known of it: a gap in numbers is no gap in the chain where the atoms are near.
    following = F.lead("n").over(Window.partitionBy("protein", "chain").orderBy("res_id"))
    near = residues.select("protein", "c", following.alias("n")).where("c is not null and n is not null")
    return near.where(_gap("c.", "n.") <= PEPTIDE).select("protein", F.col("c.atom").alias("_i"), F.col("n.atom").alias("_j")).select(*_bond("_i", "_j", kind="peptide"))


def _near(left: DataFrame, right: DataFrame, reach: float) -> DataFrame:
    return distance_join(left, right, ["px", "py", "pz"], reach, on=["protein"])


def disulphides(atoms: DataFrame) -> DataFrame:
    """Bonds between the SG of two cysteines that are near enough."""
    sulphur = atoms.where("res_name = 'CYS' and name = 'SG'").select("protein", "atom", "px", "py", "pz")
    near = _near(sulphur, sulphur, DISULPHIDE).where("l_atom < r_atom")
    return near.select(F.col("l_protein").alias("protein"), F.col("l_atom").alias("_i"), F.col("r_atom").alias("_j")).select(*_bond("_i", "_j", kind="disulphide"))


def radius_bonds(atoms: DataFrame) -> DataFrame:
    """Single bonds between atoms of residues without a template whose distance is about the sum of their covalent radii.

    Elements without a radius, metals among them, have none.
    """
    names = F.broadcast(atoms.sparkSession.createDataFrame([(r,) for r in SIDE_CHAINS], "res_name string"))
    radius = F.try_element_at(F.create_map(*(F.lit(x) for kv in RADII.items() for x in kv)), F.col("z"))
    others = atoms.join(names, "res_name", "left_anti").select("protein", "atom", "px", "py", "pz", radius.alias("radius")).where("radius is not null")
    near = _near(others, others, 2 * max(RADII.values()) + SLACK).where("l_atom < r_atom")
    near = near.where((F.col("dist") > LEAST) & (F.col("dist") <= F.col("l_radius") + F.col("r_radius") + SLACK))
    return near.select(F.col("l_protein").alias("protein"), F.col("l_atom").alias("_i"), F.col("r_atom").alias("_j")).select(*_bond("_i", "_j", kind="radius"))


def perceived_bonds(atoms: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """(protein, i, j, type, aromatic, kind) of all bonds, i < j, each pair once; given: bonds of a file (protein, i, j, type, aromatic), which come first."""
    parts = [template_bonds(atoms), peptide_bonds(atoms), disulphides(atoms), radius_bonds(atoms)]
    if given is not None:
        parts.insert(0, given.select("protein", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "type", "aromatic", F.lit("given").alias("kind")))
    every = reduce(DataFrame.unionByName, (p.withColumn("_turn", F.lit(k)) for k, p in enumerate(parts)))
    first = F.min_by(F.struct("type", "aromatic", "kind"), "_turn").alias("_b")
    return every.groupBy("protein", "i", "j").agg(first).select("protein", "i", "j", "_b.*")
