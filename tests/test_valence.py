"""Matchings, Kekulé structures and valences against brute force."""

from __future__ import annotations

import random
from itertools import combinations

import pytest

from corvane.operators import valence


def largest(n, edges):
    """Size of a largest matching, by trying every edge or leaving it."""
    if not edges:
        return 0
    (a, b), rest = edges[0], edges[1:]
    return max(largest(n, rest), 1 + largest(n, [e for e in rest if a not in e and b not in e]))


def test_matchings_are_largest():
    rng = random.Random(1)
    for _ in range(600):
        n = rng.randrange(1, 9)
        edges = [e for e in combinations(range(n), 2) if rng.random() < rng.choice((0.2, 0.4, 0.7))]
        near = [[a + b - v for a, b in edges if v in (a, b)] for v in range(n)]
        mate = valence.matching(near)
        pairs = {(min(k, m), max(k, m)) for k, m in enumerate(mate) if m >= 0}
        assert all(mate[mate[k]] == k for k in range(n) if mate[k] >= 0) and pairs <= set(edges)
        assert len(pairs) == largest(n, edges)


def test_matching_through_nested_blossoms():
    # Two fives and a three of odd rings in a chain: greedy choices must be undone through contracted rings.
    edges = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 0), (4, 5), (5, 6), (6, 7), (7, 8), (8, 9), (9, 5), (9, 10), (10, 11), (11, 12), (12, 10), (12, 13)]
    near = [[a + b - v for a, b in edges if v in (a, b)] for v in range(14)]
    assert sum(m >= 0 for m in valence.matching(near)) == 2 * largest(14, edges)


RING6 = [(k, (k + 1) % 6) for k in range(6)]
AZULENE = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 0), (4, 5), (5, 6), (6, 7), (7, 8), (8, 9), (9, 0)]
#: name: atoms (z, charge, n_h), aromatic bonds, other bonds (i, j, type), valid
MOLECULES = {
    "benzene": ([(6, 0, 1)] * 6, RING6, [], True),
    "pyridine": ([(7, 0, 0)] + [(6, 0, 1)] * 5, RING6, [], True),
    "pyridinium": ([(7, 1, 1)] + [(6, 0, 1)] * 5, RING6, [], True),
    "pyrrole": ([(7, 0, 1)] + [(6, 0, 1)] * 4, [(k, (k + 1) % 5) for k in range(5)], [], True),
    "pyrrole without its hydrogen": ([(7, 0, 0)] + [(6, 0, 1)] * 4, [(k, (k + 1) % 5) for k in range(5)], [], False),
    "furan": ([(8, 0, 0)] + [(6, 0, 1)] * 4, [(k, (k + 1) % 5) for k in range(5)], [], True),
    "azulene": ([(6, 0, 0)] + [(6, 0, 1)] * 3 + [(6, 0, 0)] + [(6, 0, 1)] * 5, AZULENE, [], True),
    "five carbons": ([(6, 0, 1)] * 5, [(k, (k + 1) % 5) for k in range(5)], [], False),
    "quinone": ([(6, 0, 0), (6, 0, 1), (6, 0, 1), (6, 0, 0), (6, 0, 1), (6, 0, 1), (8, 0, 0), (8, 0, 0)], RING6, [(0, 6, 2), (3, 7, 2)], True),
    "one oxo on a ring": ([(6, 0, 0)] + [(6, 0, 1)] * 5 + [(8, 0, 0)], RING6, [(0, 6, 2)], False),
    "nitromethane": ([(6, 0, 3), (7, 1, 0), (8, 0, 0), (8, -1, 0)], [], [(0, 1, 1), (1, 2, 2), (1, 3, 1)], True),
    "five bonds on carbon": ([(6, 0, 3), (6, 0, 3)], [], [(0, 1, 2)], False),
    "sulphuric": ([(16, 0, 0), (8, 0, 0), (8, 0, 0), (8, 0, 1), (8, 0, 1)], [], [(0, 1, 2), (0, 2, 2), (0, 3, 1), (0, 4, 1)], True),
    "two parts": ([(6, 0, 4), (8, 0, 2)], [], [], False),
    "zinc": ([(30, 2, 0)], [], [], True),
}


@pytest.fixture(scope="module")
def tables(spark):
    atoms = [(g, k, *a) for g, (those, *_) in enumerate(MOLECULES.values()) for k, a in enumerate(those)]
    bonds = [(g, i, j, 1, True) for g, (_, ring, *_) in enumerate(MOLECULES.values()) for i, j in ring]
    bonds += [(g, i, j, t, False) for g, (_, _, others, _) in enumerate(MOLECULES.values()) for i, j, t in others]
    return spark.createDataFrame(atoms, "graph int, atom int, z int, charge int, n_h int"), spark.createDataFrame(bonds, "graph int, i int, j int, type int, aromatic boolean")


def test_kekule_structures_fill_valences(tables):
    structure, broken = valence.kekulized(*tables)
    bad = {r.graph: r.atoms for r in broken.collect()}
    rows = structure.collect()
    assert len(rows) == tables[1].count() and structure.columns == tables[1].columns
    for g, (name, (atoms, ring, others, valid)) in enumerate(MOLECULES.items()):
        if not ring:
            continue
        assert (g in bad) != valid, name
        if valid:
            for k, (z, charge, n_h) in enumerate(atoms):
                total = n_h + sum(r.type for r in rows if r.graph == g and k in (r.i, r.j))
                assert total in valence.VALENCES[z - charge], (name, k)
        else:
            assert len(bad[g]) == 1


def test_molecules_are_checked(tables):
    got = {r.graph: (r.valid, r.fault) for r in valence.checked_molecules(*tables).collect()}
    assert {name: got[g][0] for g, name in enumerate(MOLECULES)} == {name: m[3] for name, m in MOLECULES.items()}
    names = list(MOLECULES)
    assert got[names.index("five bonds on carbon")][1] == "element 6 with charge 0 has valence 5, at most 4"
    assert got[names.index("two parts")][1] == "2 parts" and "system of atom 0" in got[names.index("five carbons")][1]
    assert valence.checked_molecules(*tables, connected=False).where("valid").count() == 1 + sum(m[3] for m in MOLECULES.values())
    empty = [t.where("false") for t in tables]
    assert valence.checked_molecules(*empty).count() == 0
