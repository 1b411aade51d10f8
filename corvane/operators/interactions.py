"""Protein-ligand interaction sets: rows (complex, ord, type, p_atoms, l_atoms)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.geom import angle_degrees, dot, minus
from corvane.functions.vocab import INTERACTIONS, group_interaction
from corvane.operators.joins import distance_join


def of_types(rows: DataFrame, types: list[str]) -> DataFrame:
    """Rows of the given types; a name that is no interaction type is an error."""
    if unknown := sorted(set(types) - set(INTERACTIONS)):
        raise ValueError(f"unknown interaction types: {', '.join(unknown)}")
    return rows.where(F.col("type").isin(*types))


def grouped(rows: DataFrame, *groups: str) -> DataFrame:
    """Rows with related types merged by the named groups (metal, ionic, halogen, pi, hbond)."""
    return rows.withColumn("type", group_interaction(F.col("type"), *groups))


def types_present(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.array_sort(F.collect_set("type")).alias("types"))


def dense(rows: DataFrame, by: str) -> DataFrame:
    """(by, p, l, type): distinct cells of the dense array, every pair of a row's atoms a cell."""
    return rows.select(by, F.explode("p_atoms").alias("p"), "l_atoms", "type").select(by, "p", F.explode("l_atoms").alias("l"), "type").distinct()


def from_dense(cells: DataFrame, by: str) -> DataFrame:
    """Single-atom interaction rows of dense cells, ord by (p, l, type)."""
    order = Window.partitionBy(by).orderBy("p", "l", "type")
    return cells.select(by, (F.row_number().over(order) - 1).alias("ord"), "type", F.array("p").alias("p_atoms"), F.array("l").alias("l_atoms"))


def remapped(rows: DataFrame, p_places: Column, l_places: Column) -> DataFrame:
    """Rows all of whose atoms are in the given place lists, atoms renumbered to their place there."""
    inside = lambda atoms, places: F.forall(atoms, lambda a: F.array_contains(places, a))
    moved = lambda atoms, places: F.transform(atoms, lambda a: (F.array_position(places, a) - 1).cast("int"))
    kept = rows.where(inside(F.col("p_atoms"), p_places) & inside(F.col("l_atoms"), l_places))
    return kept.withColumns({"p_atoms": moved(F.col("p_atoms"), p_places), "l_atoms": moved(F.col("l_atoms"), l_places)})


def hydrogen_bonds(donors: DataFrame, acceptors: DataFrame, on: list[str], bonds: DataFrame | None = None, reach: float = 3.5, least_angle: float = 130.0, least_bonds: int = 4) -> DataFrame:
    """Donor-hydrogen-acceptor triples within reach and at an angle of at least least_angle degrees.

    donors: on, donor, d_point, h_point; acceptors: on, acceptor, a_point; points are struct<x,y,z>. bonds, where given,
    has (on, a, b, steps): pairs nearer than least_bonds along the graph go. A donor is never its own acceptor.
    """
    met = _near(donors, acceptors, "d_point", "a_point", on, reach).where(F.col("donor") != F.col("acceptor"))
    met = met.withColumn("angle", angle_degrees(F.col("d_point"), F.col("h_point"), F.col("a_point"))).where(F.col("angle") >= least_angle)
    if bonds is not None:
        near = bonds.where(F.col("steps") < least_bonds).select(*on, F.col("a").alias("donor"), F.col("b").alias("acceptor"))
        met = met.join(near, [*on, "donor", "acceptor"], "left_anti")
    return met


def contacts(protein: DataFrame, ligand: DataFrame, on: list[str], reach: float = 4.5) -> DataFrame:
    """A geometric approximation of hydrophobic contacts: carbon pairs (z = 6) within reach. Exact detection is a plug-in."""
    p = protein.where("z = 6").select(*on, F.col("atom").alias("p"), F.col("point").alias("p_point"))
    q = ligand.where("z = 6").select(*on, F.col("atom").alias("l"), F.col("point").alias("l_point"))
    return _near(p, q, "p_point", "l_point", on, reach).drop("p_point", "l_point")


def ionic_contacts(protein: DataFrame, ligand: DataFrame, on: list[str], reach: float = 4.5) -> DataFrame:
    """A geometric approximation of ionic interactions, by the ligand's part in them: on, p, l, type, dist.

    Both sides: on, atom, charge, point. Oppositely charged atoms within reach, Cationic where the ligand's is positive.
    """
    side = lambda rows, a: rows.where("charge <> 0").select(*on, F.col("atom").alias(a), F.col("charge").alias(f"_{a}"), F.col("point").alias(f"{a}_point"))
    met = _near(side(protein, "p"), side(ligand, "l"), "p_point", "l_point", on, reach).where("sign(_p) = -sign(_l)")
    return met.select(*on, "p", "l", F.when(F.col("_l") > 0, "Cationic").otherwise("Anionic").alias("type"), "dist")


# Atomic numbers of metals that are complexed (Mg, Ca, Mn, Fe, Co, Ni, Cu, Zn, Cd) and of chelating atoms (N, O, S).
METALS = (12, 20, 25, 26, 27, 28, 29, 30, 48)
CHELATING = (7, 8, 16)


def metal_contacts(protein: DataFrame, ligand: DataFrame, on: list[str], reach: float = 2.8) -> DataFrame:
    """A geometric approximation of metal complexes, by the ligand's part in them: on, p, l, type, dist.

    Both sides: on, atom, z, point. A metal and a chelating atom within reach, MetalDonor where the metal is the ligand's.
    """
    of = lambda rows, a, zs: rows.where(F.col("z").isin(*zs)).select(*on, F.col("atom").alias(a), F.col("point").alias(f"{a}_point"))
    met = lambda ps, ls: _near(of(protein, "p", ps), of(ligand, "l", ls), "p_point", "l_point", on, reach)
    both = met(CHELATING, METALS).withColumn("type", F.lit("MetalDonor")).unionByName(met(METALS, CHELATING).withColumn("type", F.lit("MetalAcceptor")))
    return both.select(*on, "p", "l", "type", "dist")


def vdw_contacts(protein: DataFrame, ligand: DataFrame, on: list[str], tolerance: float = 0.0) -> DataFrame:
    """Atoms no farther apart than the sum of their van der Waals radii and tolerance: on, p, l, type (VdWContact), dist.

    Both sides: on, atom, radius, point. The widest radius of each side, one row, tells how far to look.
    """
    widest = sum(rows.agg(F.max("radius")).first()[0] or 0.0 for rows in (protein, ligand))
    side = lambda rows, a: rows.select(*on, F.col("atom").alias(a), F.col("radius").alias(f"_{a}"), F.col("point").alias(f"{a}_point"))
    met = _near(side(protein, "p"), side(ligand, "l"), "p_point", "l_point", on, max(widest + tolerance, 1e-9))
    return met.where(F.col("dist") <= F.col("_p") + F.col("_l") + tolerance).select(*on, "p", "l", F.lit("VdWContact").alias("type"), "dist")


def ring_planes(points: DataFrame, by: list[str]) -> DataFrame:
    """(by, centre, normal): the centre and the least-squares plane of each group of points (by, x, y, z); groups are rings.

    The normal is the eigenvector of the least eigenvalue of the covariance matrix, in closed form; its sign is free. It
    is null where all points lie on a line.
    """
    pairs = ("xx", "yy", "zz", "xy", "yz", "xz")
    sums = points.groupBy(*by).agg(*(F.avg(a).alias(a) for a in "xyz"), *(F.covar_pop(k[0], k[1]).alias(f"_{k}") for k in pairs))
    a, b, c, d, e, f = (F.col(f"_{k}") for k in ("xx", "yy", "zz", "xy", "yz", "xz"))
    mean = (a + b + c) / 3
    spread = F.sqrt(((a - mean) * (a - mean) + (b - mean) * (b - mean) + (c - mean) * (c - mean) + 2 * (d * d + e * e + f * f)) / 6)
    sums = sums.withColumns({"_m": mean, "_p": spread})
    a, b, c, m, p = F.col("_xx") - F.col("_m"), F.col("_yy") - F.col("_m"), F.col("_zz") - F.col("_m"), F.col("_m"), F.col("_p")
    half = F.try_divide(a * (b * c - e * e) - d * (d * c - e * f) + f * (d * e - b * f), 2 * p * p * p)
    turn = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half))) / 3
    sums = sums.withColumn("_low", m + 2 * p * F.cos(turn + 2 * math.pi / 3))
    a, b, c = (F.col(f"_{k}") - F.col("_low") for k in ("xx", "yy", "zz"))
    rows = [(a, d, f), (d, b, e), (f, e, c)]
    crosses = [(u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]) for u, v in ((rows[0], rows[1]), (rows[0], rows[2]), (rows[1], rows[2]))]
    # Of the three products the longest: the others may vanish.
    ways = F.array(*(F.struct((x * x + y * y + z * z).alias("n"), x.alias("x"), y.alias("y"), z.alias("z")) for x, y, z in crosses))
    sums = sums.withColumn("_n", F.array_max(ways))
    normal = F.when((F.col("_p") > 0) & (F.col("_n.n") > 0), F.struct(*((F.col(f"_n.{a}") / F.sqrt("_n.n")).alias(a) for a in "xyz")))
    return sums.select(*by, F.struct("x", "y", "z").alias("centre"), normal.alias("normal"))


def _tilt(u: Column, v: Column) -> Column:
    """Degrees between two lines, from 0 to 90, along vectors of any length; null along a vector of none."""
    cosine = F.try_divide(F.abs(dot(u, v)), F.sqrt(dot(u, u) * dot(v, v)))
    return F.when(cosine.isNotNull(), F.degrees(F.acos(F.least(F.lit(1.0), cosine))))


def pi_stacking(protein: DataFrame, ligand: DataFrame, on: list[str]) -> DataFrame:
    """Stacked aromatic rings: on, p, l (rings), type (PiStacking), form (face or edge), dist, plane_angle.

    Both sides: on, ring, centre, normal, as ring_planes() gives them. Face to face: centres within 5.5, planes at up to 35
    degrees, and one normal within 33 degrees of the line between centres. Edge to face: within 6.5, planes at 50 degrees
    or more, a normal within 30 degrees of the line, and the other ring's plane passes that ring's centre within 1.5. A
    geometric form of the usual rules; without a plane a ring has no contact.
    """
    side = lambda rows, a: rows.where("normal is not null").select(*on, F.col("ring").alias(a), F.col("centre").alias(f"{a}_centre"), F.col("normal").alias(f"{a}_normal"))
    met = _near(side(protein, "p"), side(ligand, "l"), "p_centre", "l_centre", on, 6.5)
    line = minus(F.col("l_centre"), F.col("p_centre"))
    met = met.withColumns({"plane_angle": _tilt(F.col("p_normal"), F.col("l_normal")), "_pa": _tilt(F.col("p_normal"), line), "_la": _tilt(F.col("l_normal"), line)})
    face = (F.col("dist") <= 5.5) & (F.col("plane_angle") <= 35) & (F.least("_pa", "_la") <= 33)
    # From a centre to the line in which both planes meet.
    sine = F.sin(F.radians("plane_angle"))
    beside = lambda other: F.coalesce(F.try_divide(F.abs(dot(F.col(f"{other}_normal"), line)), sine) <= 1.5, F.lit(False))
    edge = (F.col("plane_angle") >= 50) & (((F.col("_pa") <= 30) & beside("l")) | ((F.col("_la") <= 30) & beside("p")))
    met = met.withColumn("form", F.when(face, "face").when(edge, "edge")).where("form is not null")
    return met.select(*on, "p", "l", F.lit("PiStacking").alias("type"), "form", "dist", "plane_angle")


def cation_pi(protein_rings: DataFrame, ligand_rings: DataFrame, protein: DataFrame, ligand: DataFrame, on: list[str], reach: float = 4.5, most_angle: float = 30.0) -> DataFrame:
    """Cations over aromatic rings: on, p, l, type, dist; CationPi where the cation is the ligand's, PiCation where the ring is.

    Rings as in pi_stacking(); protein, ligand: on, atom, charge, point. The cation lies within reach of the centre, and
    within most_angle degrees of the ring's normal there.
    """

    def met(rings: DataFrame, atoms: DataFrame, ring: str, atom: str, kind: str) -> DataFrame:
        flat = rings.where("normal is not null").select(*on, F.col("ring").alias(ring), "centre", "normal")
        cations = atoms.where("charge > 0").select(*on, F.col("atom").alias(atom), "point")
        found = _near(flat, cations, "centre", "point", on, reach).withColumn("_tilt", _tilt(F.col("normal"), minus(F.col("point"), F.col("centre"))))
        return found.where(F.col("_tilt") <= most_angle).select(*on, "p", "l", F.lit(kind).alias("type"), "dist")

    return met(protein_rings, ligand, "p", "l", "CationPi").unionByName(met(ligand_rings, protein, "l", "p", "PiCation"))


# Atomic numbers of halogens that bond as donors (Cl, Br, I, At).
HALOGENS = (17, 35, 53, 85)


def halogen_bonds(donors: DataFrame, acceptors: DataFrame, on: list[str], reach: float = 3.5, donor_angle: tuple = (130.0, 180.0), acceptor_angle: tuple = (80.0, 140.0)) -> DataFrame:
    """Halogen-acceptor pairs within reach: on, halogen, acceptor, dist, each once.

    donors: on, halogen, x_point, d_point (of an atom bonded to it); acceptors: on, acceptor, a_point, r_point (of an atom
    bonded to it), a row for each such atom. The angles acceptor-halogen-bonded atom and halogen-acceptor-bonded atom
    lie in their ranges, for some bonded atom of either. Call the type XBDonor where the halogen is the ligand's, else XBAcceptor.
    """
    met = _near(donors, acceptors, "x_point", "a_point", on, reach)
    first = angle_degrees(F.col("a_point"), F.col("x_point"), F.col("d_point"))
    second = angle_degrees(F.col("x_point"), F.col("a_point"), F.col("r_point"))
    return met.where(first.between(*donor_angle) & second.between(*acceptor_angle)).select(*on, "halogen", "acceptor", "dist").distinct()


def _near(left: DataFrame, right: DataFrame, left_point: str, right_point: str, on: list[str], reach: float) -> DataFrame:
    """Rows of both sides with equal keys and points at most reach apart, and dist; points meet by cells, not all with all."""
    axes = {f"_{a}": a for a in "xyz"}
    flat = lambda rows, at: rows.withColumns({c: F.col(f"{at}.{a}") for c, a in axes.items()})
    met = distance_join(flat(left, left_point), flat(right, right_point), list(axes), reach, on)
    return met.select(*(F.col(f"l_{c}").alias(c) for c in left.columns), *(F.col(f"r_{c}").alias(c) for c in right.columns if c not in on), "dist")
