"""Bonds of residues, chains, disulphides and ligands that are planted, and alternate locations."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corvane.sources import perception, text_formats


def residue(protein, start, res, chain, res_id, at, z_of=lambda name: {"N": 7, "O": 8, "S": 16}.get(name[0], 6)):
    names = dict.fromkeys(x for r, a, b, *_ in perception.template_rows() if r == res for x in (a, b) if x != "OXT")
    place = {"N": 0.0, "C": 3.7}
    return [(protein, start + k, z_of(n), n, res, chain, res_id, at + place.get(n, 1.5), (50.0 + 9.0 * k) * (n not in place), 0.0) for k, n in enumerate(names)]


def table(spark, rows):
    return spark.createDataFrame(rows, perception.ATOMS)


def test_templates_name_every_residue_once():
    rows = perception.template_rows()
    assert len({r[0] for r in rows}) == 20 and len({(r[0], *sorted(r[1:3])) for r in rows}) == len(rows) < 200
    doubles = {(r[0], a) for r in rows if r[3] == 2 for a in r[1:3]}
    assert len(doubles) == 2 * sum(r[3] == 2 for r in rows), "no atom has two double bonds"


def test_planted_chain(spark):
    rows, at = [], 0.0
    for k, name in enumerate(("MET", "CYS", "TRP", "GLY", "CYS")):
        rows += residue(1, len(rows), name, "A", 10 + k + (k > 2), at)
        at += 5.0
    # The two sulphurs are brought together, the chain is cut after GLY by distance, and chain B never joins A.
    rows = [(*r[:7], 200.0, 0.0, 2.05 * (r[6] > 12)) if r[3] == "SG" else r for r in rows]
    rows = [(*r[:7], r[7] + (9.0 if r[6] == 15 and r[3] != "SG" else 0.0), *r[8:]) for r in rows]
    rows += residue(1, len(rows), "ALA", "B", 11, 20.0)
    atoms = table(spark, rows)
    found = perception.perceived_bonds(atoms).collect()
    name = {r[1]: (r[6], r[3]) for r in rows}
    by_kind = {}
    for b in found:
        assert b.i < b.j
        by_kind.setdefault(b.kind, set()).add(frozenset((name[b.i], name[b.j])))
    assert by_kind["peptide"] == {frozenset(((10, "C"), (11, "N"))), frozenset(((11, "C"), (12, "N"))), frozenset(((12, "C"), (14, "N")))}
    assert by_kind["disulphide"] == {frozenset(((11, "SG"), (15, "SG")))} and "radius" not in by_kind
    want = sum(sum(r == x[0] and "OXT" not in x for x in perception.template_rows()) for r in ("MET", "CYS", "TRP", "GLY", "CYS", "ALA"))
    assert want == sum(b.kind == "template" for b in found)
    assert sum(b.aromatic for b in found) == 10


def test_ligands_bond_by_radius(spark):
    rows = [(1, 0, 6, "C1", "LIG", "A", 1, 0.0, 0.0, 0.0), (1, 1, 6, "C2", "LIG", "A", 1, 1.5, 0.0, 0.0), (1, 2, 8, "O1", "LIG", "A", 1, 3.4, 0.0, 0.0)]
    rows += [(1, 3, 30, "ZN", "ZN", "A", 2, 1.5, 1.0, 0.0), (2, 0, 6, "C1", "LIG", "A", 1, 0.7, 0.0, 0.0), (1, 4, 35, "BR", "LIG", "A", 1, 0.0, 1.95, 0.0), (1, 5, 6, "X", "LIG", "A", 1, 0.0, 0.0, 0.1)]
    atoms = table(spark, rows)
    got = {(r.protein, r.i, r.j) for r in perception.perceived_bonds(atoms).collect()}
    assert got == {(1, 0, 1), (1, 0, 4), (1, 1, 5), (1, 4, 5)}
    given = spark.createDataFrame([(1, 1, 0, 2, False)], "protein long, i int, j int, type int, aromatic boolean")
    one = [r for r in perception.perceived_bonds(atoms, given).collect() if (r.i, r.j) == (0, 1)]
    assert [(r.type, r.kind) for r in one] == [(2, "given")]
    assert perception.perceived_bonds(atoms.where("false")).count() == 0


def test_alternate_locations(spark):
    schema = perception.ATOMS + ", altloc string, occupancy double"
    at = lambda k, alt, occ, name="CA": (1, k, 6, name, "ALA", "A", 1, float(k), 0.0, 0.0, alt, occ)
    rows = spark.createDataFrame([at(0, "A", 0.4), at(1, "B", 0.6), at(2, "A", 0.5, "CB"), at(3, "B", 0.5, "CB"), at(4, None, None, "C")], schema)
    assert sorted(r.atom for r in perception.resolved(rows).collect()) == [1, 2, 4]
    line = lambda n, alt, occ, x: f"ATOM  {n:5d}  CA {alt}ALA A   1    {x:8.3f}{0:8.3f}{0:8.3f}{occ:6.2f}  0.00           C"
    text = "\n".join([line(1, "A", 0.4, 1.0), line(2, "B", 0.6, 2.0), line(3, "C", 0.6, 3.0), line(4, " ", 1.0, 4.0), line(5, " ", 1.0, 5.0)])
    assert [a["serial"] for a in text_formats.parse_pdb(text)["atoms"]] == [2, 4, 5]


def test_unknown_codes_are_errors(spark):
    codes = spark.createDataFrame([(k,) for k in perception.CODES], "code int").select("code", perception.bond_of_code(F.col("code")).alias("b"))
    assert {r.code: (r.b.type, r.b.aromatic) for r in codes.collect()} == perception.CODES
    for bad in (0, 4, 8, None):
        with pytest.raises(Exception, match="unsupported bond code"):
            spark.createDataFrame([(bad,)], "code int").select(perception.bond_of_code(F.col("code"))).collect()
