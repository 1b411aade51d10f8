"""Patterns of atoms and bonds found in many labelled graphs at once, as ordered joins, and features made of them.

A Pattern is a small graph: a condition for each of its atoms and each of its bonds, as SQL over the columns of the
tables. Pattern atoms are matched in an order in which each is bonded to one before it:

    candidates  the atoms of all graphs that meet a pattern atom's own condition, then semi-joins along the pattern's
                tree from its leaves up: what is left of the root has a partner at each step, rings aside;
    growth      one join with the bonds for each further atom, which must differ from those before;
    closures    a semi-join with the bonds for each bond of the pattern that closes a ring.

Conditions on surroundings are patterns too: an atom must be, or must not be, the first atom of another pattern.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.graph import symmetric
from corvane.session import settled


@dataclass(frozen=True)
class Pattern:
    """atoms: a condition over the columns of atoms for each pattern atom; bonds: (k, l, condition over `type` and other columns of bonds).

    inside, outside: (k, pattern): atom k must be, or must not be, the first atom of a match of pattern, whose other
    atoms may be any. The pattern has to be connected.
    """

    atoms: Sequence[str]
    bonds: Sequence[tuple[int, int, str]] = ()
    inside: Sequence[tuple[int, Pattern]] = field(default=())
    outside: Sequence[tuple[int, Pattern]] = field(default=())

    def steps(self) -> list[tuple[int, int, str, list[tuple[int, str]]]]:
        """(atom, the one before it, condition of their bond, closures (earlier atom, condition)) for each atom but the first."""
        done, left, out = [0], set(range(1, len(self.atoms))), []
        while left:
            ready = [(k, l, c) for a, b, c in self.bonds for k, l in ((a, b), (b, a)) if k in left and l in done]
            if not ready:
                raise ValueError(f"pattern atoms {sorted(left)} are not connected to atom 0")
            # Atoms that close a ring come first: they leave the fewest rows.
            closes = lambda k: sum(1 for a, b, _ in self.bonds if (a == k and b in done) or (b == k and a in done))
            atom, before, cond = max(ready, key=lambda r: (closes(r[0]), -r[0], -r[1]))
            closures = [(b if a == atom else a, c) for a, b, c in self.bonds if atom in (a, b) and (b if a == atom else a) in done]
            closures.remove((before, cond))
            out.append((atom, before, cond, closures))
            done.append(atom)
            left.remove(atom)
        return out


def _candidates(atoms: DataFrame, bonds: DataFrame, pattern: Pattern, steps: list, named: dict) -> dict[int, DataFrame]:
    """(graph, atom) of the atoms that each pattern atom can be, by its own condition and those of its tree below it."""
    found = {}
    for k, condition in enumerate(pattern.atoms):
        rows = atoms.where(condition).select("graph", "atom")
        for how, those in (("left_semi", pattern.inside), ("left_anti", pattern.outside)):
            for at, other in those:
                if at == k:
                    rows = rows.join(named[id(other)], ["graph", "atom"], how)
        found[k] = rows
    for atom, before, condition, _ in reversed(steps):
        near = bonds.where(condition).join(found[atom].withColumnRenamed("atom", "j"), ["graph", "j"], "left_semi").select("graph", F.col("i").alias("atom"))
        found[before] = found[before].join(near, ["graph", "atom"], "left_semi")
    return found


def _rooted(atoms: DataFrame, bonds: DataFrame, pattern: Pattern, firsts: dict) -> None:
    """firsts gets (graph, atom) of the first atoms of each pattern that others of pattern refer to, innermost first."""
    for _, other in (*pattern.inside, *pattern.outside):
        if id(other) not in firsts:
            _rooted(atoms, bonds, other, firsts)
            firsts[id(other)] = _grown(atoms, bonds, other, firsts).select("graph", F.col("a0").alias("atom")).distinct()


def _grown(atoms: DataFrame, bonds: DataFrame, pattern: Pattern, firsts: dict) -> DataFrame:
    steps = pattern.steps()
    can = _candidates(atoms, bonds, pattern, steps, firsts)
    rows = can[0].withColumnRenamed("atom", "a0")
    for atom, before, condition, closures in steps:
        name = f"a{atom}"
        step = bonds.where(condition).join(can[atom].withColumnRenamed("atom", "j"), ["graph", "j"], "left_semi")
        step = step.select("graph", F.col("i").alias(f"a{before}"), F.col("j").alias(name)).distinct()
        others = [c for c in rows.columns if c not in ("graph", f"a{before}")]
        rows = rows.join(step, ["graph", f"a{before}"])
        if others:
            rows = rows.where(reduce(lambda x, y: x & y, (F.col(c) != F.col(name) for c in others)))
        for other, closing in closures:
            ends = bonds.where(closing).select("graph", F.col("i").alias(f"a{other}"), F.col("j").alias(name))
            rows = rows.join(ends, ["graph", f"a{other}", name], "left_semi")
    return rows.select("graph", *(f"a{k}" for k in range(len(pattern.atoms))))


def _both_ways(bonds: DataFrame) -> DataFrame:
    """Bonds in both directions with all of their columns."""
    ends = ("graph", "i", "j")
    rest = [c for c in bonds.columns if c not in ends]
    apart = bonds.where("i <> j")
    return apart.select("graph", "i", "j", *rest).union(apart.select("graph", "j", "i", *rest))


def matches(atoms: DataFrame, bonds: DataFrame, pattern: Pattern, unique: bool = False) -> DataFrame:
    """(graph, a0, a1, ...): every way to lay the pattern's atoms on different atoms of a graph so that all conditions hold.

    atoms: (graph, atom, columns of conditions); bonds: (graph, i, j, type, ...), each pair once. unique: of the ways
    that cover the same atoms only the first in the atoms' order.
    """
    firsts: dict[int, DataFrame] = {}
    both = _both_ways(bonds)
    _rooted(atoms, both, pattern, firsts)
    rows = _grown(atoms, both, pattern, firsts)
    if not unique or len(pattern.atoms) == 1:
        return rows
    names = [c for c in rows.columns if c != "graph"]
    return rows.groupBy("graph", F.array_sort(F.array(*names)).alias("_set")).agg(F.min(F.struct(*names)).alias("_m")).select("graph", "_m.*")


def find_features(atoms: DataFrame, bonds: DataFrame, families: Mapping[str, Sequence[Pattern]]) -> DataFrame:
    """(graph, family, atoms): the atoms of each match of a family's patterns, in order of number; the same atoms once a family.

    Patterns of all families share the tables, which should be settled. Each pattern's features are settled, so that many
    patterns make no plan of all their joins.
    """
    out = None
    for family, patterns in families.items():
        for pattern in patterns:
            found = matches(atoms, bonds, pattern, unique=True)
            covered = F.array_sort(F.array(*(c for c in found.columns if c != "graph")))
            found = settled(found.select("graph", F.lit(family).alias("family"), covered.alias("atoms")))
            out = found if out is None else out.union(found)
    if out is None:
        raise ValueError("no pattern is given")
    return out.distinct()


def placed(features: DataFrame, points: DataFrame) -> DataFrame:
    """features with x, y, z: the mean place of their atoms; points: (graph, atom, x, y, z). A feature with an unplaced atom has nulls."""
    each = features.withColumn("atom", F.explode("atoms")).join(points, ["graph", "atom"], "left")
    whole = F.count("x") == F.count(F.lit(1))
    return each.groupBy("graph", "family", "atoms").agg(*(F.when(whole, F.avg(a)).alias(a) for a in "xyz"))


def directed(features: DataFrame, atoms: DataFrame, bonds: DataFrame, points: DataFrame, family: str = "Donor") -> DataFrame:
    """placed() features with dx, dy, dz: a row for each hydrogen bonded to a feature of the family, its unit vector from that atom.

    Others, and donors without a hydrogen, have a direction of zero. atoms: (graph, atom, z).
    """
    heavy = features.where(F.col("family") == family).select("graph", "family", "atoms", F.explode("atoms").alias("i"))
    hydrogens = atoms.where("z = 1").select("graph", F.col("atom").alias("j"))
    tied = heavy.join(symmetric(bonds).select("graph", "i", "j"), ["graph", "i"]).join(hydrogens, ["graph", "j"], "left_semi")
    at = lambda side, end: points.select("graph", F.col("atom").alias(end), *(F.col(a).alias(f"_{side}{a}") for a in "xyz"))
    tied = tied.join(at("p", "i"), ["graph", "i"]).join(at("h", "j"), ["graph", "j"])
    gap = {a: F.col(f"_h{a}") - F.col(f"_p{a}") for a in "xyz"}
    length = F.sqrt(sum((g * g for g in gap.values()), F.lit(0.0)))
    tied = tied.select("graph", "family", "atoms", *(F.when(length > 0, g / length).otherwise(0.0).alias(f"d{a}") for a, g in gap.items()))
    out = features.join(tied, ["graph", "family", "atoms"], "left")
    return out.fillna(0.0, [f"d{a}" for a in "xyz"])


#: Conditions on bonds: a plain single or double one, and what stands where a pattern names no bond.
SINGLE, DOUBLE, PLAIN, ANY = "type = 1 and not aromatic", "type = 2 and not aromatic", "type = 1 or aromatic", "true"


def _ring(size: int) -> Pattern:
    """An aromatic ring: `size` aromatic atoms of a ring of that size and of none that is smaller, aromatic bonds around."""
    atom = f"aromatic and array_contains(ring_sizes, {size}) and array_min(ring_sizes) = {size}"
    return Pattern([atom] * size, [(k, (k + 1) % size, "aromatic") for k in range(size)])


def _chain(*atoms: str, bond: str = PLAIN, **more) -> Pattern:
    """Atoms each bonded to the one before it."""
    return Pattern(list(atoms), [(k, k + 1, bond) for k in range(len(atoms) - 1)], **more)


def _star(centre: str, *arms: tuple[str, str], **more) -> Pattern:
    """A centre, which is atom 0, and (bond, atom) for each arm."""
    return Pattern([centre, *(a for _, a in arms)], [(0, k + 1, b) for k, (b, _) in enumerate(arms)], **more)


def _of(z: int, more: str = "true") -> str:
    """An atom of an element that isn't aromatic."""
    return f"z = {z} and not aromatic and {more}"


# The families of features and what belongs to them, as conditions on topology.described() atoms with a
# formal charge. A family's patterns are tried one by one; features that cover the same atoms count once in a family.
_C, _N, _O, _S = (_of(z) for z in (6, 7, 8, 16))
_TRIFLYL = Pattern(
    [_N, _of(16, "connections = 4"), _O, _O, _of(6, "connections = 4"), "z = 9", "z = 9", "z = 9"],
    [(0, 1, SINGLE), (1, 2, DOUBLE), (1, 3, DOUBLE), (1, 4, PLAIN), (4, 5, PLAIN), (4, 6, PLAIN), (4, 7, PLAIN)],
)
_ACID_OH = Pattern([_of(8, "hydrogens = 1"), "z in (6, 15, 16) and not aromatic", _O], [(0, 1, PLAIN), (1, 2, DOUBLE)])
_AMIDE_N = Pattern([_of(7, "connections = 3"), "true", "z <> 6"], [(0, 1, SINGLE), (1, 2, DOUBLE)])
_AMIDINE_N = Pattern([_N, _C, "z in (6, 7) and not aromatic", _N], [(0, 1, DOUBLE), (1, 2, PLAIN), (1, 3, PLAIN)])
_ESTER_O = Pattern([_of(8, "connections = 2"), _C, _C, _O], [(0, 1, PLAIN), (0, 2, PLAIN), (2, 3, DOUBLE)])
_POSITIVE_N = _star(
    _of(7, "connections = 3 and charge = 1"), (PLAIN, _of(6, "connections = 4")), *[(PLAIN, "z = 1 or (z = 6 and not aromatic and connections = 4)")] * 2, outside=[(0, _AMIDE_N)]
)
_HETERO = _chain("z = 6", "z in (7, 8, 9)", bond=ANY)
_N_PLUS = _of(7, "charge = 1")
#: Carbons at the end of a chain (CH3, =CH2, #CH) and inside one (CH2, =CH, #C), none of them aromatic.
_END = "z = 6 and not aromatic and ((hydrogens = 3 and connections = 4) or (hydrogens = 2 and connections = 3) or (hydrogens = 1 and connections = 2))"
_INNER = "z = 6 and not aromatic and ((hydrogens = 2 and connections = 4) or (hydrogens = 1 and connections = 3) or (hydrogens = 0 and connections = 2))"
_BESIDE_OTHERS = _chain(_INNER, f"z <> 1 and not ({_INNER})", bond=ANY)
_TWO_ENDS, _THREE_ENDS = (_star("true", *[(PLAIN, _END)] * k) for k in (2, 3))
FAMILIES: dict[str, list[Pattern]] = {
    "Aromatic": [_ring(size) for size in (4, 5, 6, 7, 8)],
    "Donor": [
        Pattern(["z = 7 and hydrogens > 0"], outside=[(0, _TRIFLYL)]),
        Pattern(["z = 8 and hydrogens > 0"], outside=[(0, _ACID_OH)]),
        Pattern(["z = 16 and hydrogens > 0"]),
        Pattern(["z in (8, 16) and not aromatic and hydrogens = 1 and charge = 0"]),
    ],
    "Acceptor": [
        Pattern([_of(8, "hydrogens = 1 and valence = 2")]),
        Pattern([_of(8, "hydrogens = 0 and valence = 2")], outside=[(0, Pattern([_O, _N, "true"], [(0, 1, DOUBLE), (1, 2, SINGLE)]))]),
        Pattern([_of(8, "charge = -1")], outside=[(0, Pattern([_O, _N, _O], [(0, 1, SINGLE), (1, 2, DOUBLE)]))]),
        Pattern(["z = 8 and aromatic and charge = 0"]),
        Pattern([_O], outside=[(0, _ESTER_O), (0, _star("true", (ANY, "aromatic"), (ANY, "aromatic")))]),
        Pattern(
            ["z = 7 and not (aromatic and connections = 3) and not (not aromatic and connections = 4)"],
            outside=[(0, _AMIDE_N), (0, Pattern([_of(7, "connections = 3"), "aromatic"], [(0, 1, SINGLE)])), (0, _AMIDINE_N)],
        ),
    ],
    "Cation": [
        Pattern(["true"], inside=[(0, _POSITIVE_N)]),
        _star(_of(6, "connections = 3"), (DOUBLE, _N_PLUS), (SINGLE, _N), (PLAIN, "not (z = 7 and not aromatic)")),
        _star(_of(6, "connections = 3"), (DOUBLE, _N), (SINGLE, _N_PLUS), (PLAIN, "not (z = 7 and not aromatic)")),
        _star(_of(6, "connections = 3"), (DOUBLE, _N_PLUS), (PLAIN, _N), (SINGLE, _N)),
        _star(_of(6, "connections = 3 and charge = 1"), (DOUBLE, _N), (PLAIN, _N), (SINGLE, _N)),
        _star(_of(6, "connections = 3"), (DOUBLE, _N), (PLAIN, _N_PLUS), (SINGLE, _N)),
        Pattern(["charge > 0"], outside=[(0, _chain("true", "charge < 0"))]),
    ],
    "Anion": [
        Pattern(["z = 6 and aromatic", *["z = 7 and aromatic"] * 2, "z = 7 and aromatic and hydrogens = 1", "z = 7 and aromatic"], [(k, (k + 1) % 5, PLAIN) for k in range(5)]),
        _star("z in (15, 16) and not aromatic and connections = 4", (DOUBLE, _O), (DOUBLE, _O), (PLAIN, _of(8, "charge = -1"))),
        _star("z in (6, 15, 16) and not aromatic and connections = 3", (DOUBLE, _O), (PLAIN, _of(8, "charge = -1"))),
        Pattern(["charge < 0"], outside=[(0, _chain("true", "charge > 0"))]),
    ],
    "Hydrophobe": [
        Pattern([_END], outside=[(0, _chain("true", "true", _END)), (0, _HETERO)]),
        _star("true", *[(PLAIN, _END)] * 2, inside=[(0, _TWO_ENDS)], outside=[(0, _THREE_ENDS)]),
        _THREE_ENDS,
        _chain(_INNER, _END, bond=ANY, outside=[(0, _HETERO), (1, _HETERO)]),
        _chain(_INNER, _INNER, _INNER, bond=ANY, inside=[(0, _BESIDE_OTHERS)]),
        _chain(_INNER, _INNER, _INNER, _INNER, bond=ANY, inside=[(0, _chain(_INNER, _INNER, _INNER, bond=ANY, inside=[(2, _BESIDE_OTHERS)]))]),
        Pattern([_S], inside=[(0, _chain(_S, "z = 6", bond=ANY))], outside=[(0, _chain(_S, "z <> 6", bond=ANY))]),
        Pattern(["z in (35, 53)"], inside=[(0, Pattern(["true", "z = 6"], [(0, 1, SINGLE)]))]),
    ],
}


def pharmacophores(atoms: DataFrame, bonds: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """Features of FAMILIES: (graph, family, atoms), with x, y, z where points are given.

    atoms: topology.described() of atoms with z, charge, n_h and aromatic; bonds: type (1, 2, 3, as in a Kekulé structure)
    and aromatic.
    """
    found = find_features(settled(atoms), settled(bonds), FAMILIES)
    return found if points is None else placed(found, points)
