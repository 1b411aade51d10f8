"""Rings, distances, patterns, circular fingerprints and canonical keys against brute force on random labelled graphs."""

from __future__ import annotations

import random
from itertools import combinations, permutations

import pytest
from pyspark.sql import functions as F

from corvane.operators import canonical, circular, patterns, topology
from corvane.operators.patterns import Pattern


def graphs(seed: int, many: int, most: int, closures: int):
    """Random connected labelled graphs: {graph: (z by atom, {(i, j): type})}."""
    rng, out = random.Random(seed), {}
    for g in range(many):
        n = rng.randrange(2, most + 1)
        bonds = {(rng.randrange(k), k): rng.choice((1, 1, 2)) for k in range(1, n)}
        for _ in range(rng.randrange(closures + 1)):
            a, b = sorted(rng.sample(range(n), 2))
            bonds.setdefault((a, b), rng.choice((1, 2)))
        out[g] = ([rng.choice((6, 6, 7, 8)) for _ in range(n)], bonds)
    return out


def tables(spark, found):
    atoms = spark.createDataFrame([(g, k, z) for g, (zs, _) in found.items() for k, z in enumerate(zs)], "graph long, atom int, z int")
    bonds = [(g, i, j, t) for g, (_, those) in found.items() for (i, j), t in those.items()]
    return atoms, spark.createDataFrame(bonds, "graph long, i int, j int, type int")


def distances(n, bonds):
    far = [[0 if a == b else 99 for b in range(n)] for a in range(n)]
    for i, j in bonds:
        far[i][j] = far[j][i] = 1
    for k in range(n):
        for a in range(n):
            for b in range(n):
                far[a][b] = min(far[a][b], far[a][k] + far[k][b])
    return far


def least_basis(n, bonds):
    """Sizes of a least cycle basis: all simple cycles by size, eliminated."""
    near = {v: {a + b - v for a, b in bonds if v in (a, b)} for v in range(n)}
    cycles = set()

    def walk(path):
        for u in near[path[-1]]:
            if u == path[0] and len(path) > 2:
                cycles.add(frozenset(tuple(sorted(e)) for e in zip(path, path[1:] + path[:1], strict=True)))
            elif u > path[0] and u not in path:
                walk([*path, u])

    for v in range(n):
        walk([v])
    bit = {e: 1 << k for k, e in enumerate(sorted(bonds))}
    ordered = sorted(cycles, key=len)
    return [len(ordered[k]) for k in topology.independent([sum(bit[e] for e in c) for c in ordered])]


@pytest.fixture(scope="module")
def some():
    found = graphs(3, 25, 9, 5)
    # Bridged, fused and spiro rings, a cube and two rings joined by a chain.
    cube = {(a, b): 1 for a, b in combinations(range(8), 2) if (a ^ b).bit_count() == 1}
    found[100] = ([6] * 8, cube)
    found[101] = ([6] * 10, {(0, 1): 1, (1, 2): 1, (2, 3): 1, (3, 4): 1, (4, 5): 1, (0, 5): 1, (3, 6): 1, (6, 7): 1, (7, 8): 1, (8, 9): 1, (4, 9): 1})
    found[102] = ([6] * 7, {(0, 1): 1, (1, 2): 1, (2, 3): 1, (3, 4): 1, (4, 5): 1, (0, 5): 1, (0, 6): 1, (3, 6): 1})
    found[103] = ([6] * 9, {(0, 1): 1, (1, 2): 1, (0, 2): 1, (2, 3): 1, (3, 4): 1, (4, 5): 1, (5, 6): 1, (6, 7): 1, (4, 7): 1, (7, 8): 1})
    return found


def test_distances(spark, some):
    _, bonds = tables(spark, some)
    want = {(g, a, b): d for g, (zs, those) in some.items() for a, row in enumerate(distances(len(zs), those)) for b, d in enumerate(row) if 0 < d < 99}
    assert {(r.graph, r.a, r.b): r.steps for r in topology.bond_distances(bonds).collect()} == want
    near = topology.bond_distances(bonds, most=2, sources=spark.createDataFrame([(100, 3), (101, 0)], "graph long, a int"))
    assert {(r.graph, r.a, r.b): r.steps for r in near.collect()} == {k: d for k, d in want.items() if d <= 2 and k[:2] in ((100, 3), (101, 0))}


def test_rings(spark, some):
    atoms, bonds = tables(spark, some)
    found = topology.rings(bonds).collect()
    for g, (zs, those) in some.items():
        mine = [r for r in found if r.graph == g]
        assert sorted(r.size for r in mine) == sorted(least_basis(len(zs), those)), g
        for r in mine:
            edges = {tuple(sorted(e)) for e in zip(r.ring, r.ring[1:] + r.ring[:1], strict=True)}
            assert len(edges) == r.size == len(set(r.ring)) and edges <= set(those)
    counts = {r.graph: (r.n_rings, r.sizes) for r in topology.ring_counts(atoms, topology.rings(bonds)).collect()}
    assert set(counts) == set(some) and counts[100] == (5, [4] * 5) and counts[102][0] == 2


def embeddings(zs, bonds, pattern, atom_ok, bond_ok):
    n, out = len(pattern.atoms), set()
    for chosen in permutations(range(len(zs)), n):
        if all(atom_ok(pattern.atoms[k], zs[v]) for k, v in enumerate(chosen)):
            if all((t := bonds.get(tuple(sorted((chosen[k], chosen[m]))))) is not None and bond_ok(c, t) for k, m, c in pattern.bonds):
                out.add(chosen)
    return out


CASES = [
    Pattern(["z = 7"]),
    Pattern(["z = 6", "z <> 6"], [(0, 1, "type = 2")]),
    Pattern(["true", "true", "true"], [(0, 1, "true"), (1, 2, "type = 1"), (2, 0, "true")]),
    Pattern(["z = 6"] * 4, [(0, 1, "true"), (1, 2, "true"), (2, 3, "true"), (3, 0, "true")]),
    Pattern(["true", "z = 6", "z = 6", "true", "true"], [(1, 0, "true"), (1, 2, "true"), (3, 2, "true"), (3, 1, "true"), (3, 4, "true")]),
]


@pytest.mark.parametrize("pattern", CASES)
def test_matches_equal_backtracking(spark, some, pattern):
    atoms, bonds = tables(spark, some)
    ok = lambda cond, v: eval(cond.replace("<>", "!=").replace(" = ", " == ").replace("true", "True"), {"z": v, "type": v})  # noqa: E731, S307
    want = {(g, *m) for g, (zs, those) in some.items() for m in embeddings(zs, those, pattern, ok, ok)}
    assert {tuple(r) for r in patterns.matches(atoms, bonds, pattern).collect()} == want
    unique = {(r[0], frozenset(r[1:])) for r in patterns.matches(atoms, bonds, pattern, unique=True).collect()}
    assert unique == {(m[0], frozenset(m[1:])) for m in want} and patterns.matches(atoms, bonds, pattern, unique=True).count() == len(unique)


def test_patterns_inside_patterns(spark, some):
    atoms, bonds = tables(spark, some)
    hetero = Pattern(["true", "z in (7, 8)"], [(0, 1, "true")])
    ring = Pattern(["true"] * 3, [(0, 1, "true"), (1, 2, "true"), (2, 0, "true")])
    beside_ring = Pattern(["true", "true"], [(0, 1, "true")], inside=[(1, ring)])
    found = patterns.matches(atoms, bonds, Pattern(["z = 6"], inside=[(0, hetero)], outside=[(0, beside_ring)]))
    want = set()
    for g, (zs, those) in some.items():
        near = {v: {a + b - v for a, b in those if v in (a, b)} for v in range(len(zs))}
        in_three = {v for v in near for a, b in combinations(near[v], 2) if b in near[a]}
        want |= {(g, v) for v, z in enumerate(zs) if z == 6 and any(zs[u] in (7, 8) for u in near[v]) and not near[v] & in_three}
    assert {tuple(r) for r in found.collect()} == want
    with pytest.raises(ValueError, match="not connected"):
        patterns.matches(atoms, bonds, Pattern(["true", "true"]))


def renumbered(found, seed):
    rng, out = random.Random(seed), {}
    for g, (zs, those) in found.items():
        order = rng.sample(range(len(zs)), len(zs))
        out[g] = ([zs[order.index(k)] for k in range(len(zs))], {tuple(sorted((order[i], order[j]))): t for (i, j), t in those.items()})
    return out


def test_circular_features_do_not_depend_on_numbering(spark, some):
    def prints(found):
        atoms, bonds = tables(spark, found)
        features = circular.circular_features(atoms, bonds, [F.col("z")], radius=2)
        return {r.graph: tuple(r.bits) for r in circular.folded(features).collect()}, features.groupBy("graph").count().collect()

    first, counts = prints(some)
    again, more = prints(renumbered(some, 7))
    assert first == again and sorted(counts) == sorted(more) and len(set(first.values())) > 20
    changed = {g: ([8 if z == 7 else z for z in zs], those) for g, (zs, those) in some.items() if 7 in zs}
    other, _ = prints(changed)
    assert all(other[g] != first[g] for g in changed)


def test_equal_covers_count_once(spark):
    # A bond of two equal atoms: both ends cover the same bond at radius 1 and nothing more at 2.
    atoms, bonds = tables(spark, {0: ([6, 6], {(0, 1): 1})})
    found = circular.circular_features(atoms, bonds, [F.col("z")], radius=2).collect()
    assert sorted(r.radius for r in found) == [0, 0, 1]


def isomorphic(a, b):
    (za, ba), (zb, bb) = a, b
    if sorted(za) != sorted(zb) or len(ba) != len(bb):
        return False
    return any(all(za[k] == zb[p[k]] for k in range(len(za))) and all(bb.get(tuple(sorted((p[i], p[j])))) == t for (i, j), t in ba.items()) for p in permutations(range(len(za))))


def test_keys_are_equal_for_isomorphic_graphs_alone(spark):
    found = graphs(11, 60, 5, 3)
    found = {g: ([6 if z != 8 else 8 for z in zs], {e: 1 for e in those}) for g, (zs, those) in found.items()}
    found[200] = ([6] * 6, {(0, 1): 1, (1, 2): 1, (2, 3): 1, (3, 4): 1, (4, 5): 1, (0, 5): 1})
    found[201] = ([6] * 6, {(0, 1): 1, (1, 2): 1, (0, 2): 1, (3, 4): 1, (4, 5): 1, (3, 5): 1})  # refinement alone can't tell this from 200
    found[202] = ([6], {})
    atoms, bonds = tables(spark, found)
    keys = {r.graph: r.key for r in canonical.canonical_keys(atoms, bonds, [F.col("z")]).collect()}
    assert set(keys) == set(found)
    for a, b in combinations(found, 2):
        assert (keys[a] == keys[b]) == isomorphic(found[a], found[b]), (a, b)


def test_keys_survive_renumbering_of_symmetric_graphs(spark, some):
    found = dict(some)
    found[300] = ([6] * 13, {(0, k): 1 for k in range(1, 5)} | {(k, 4 + 2 * k - 1 + s): 1 for k in range(1, 5) for s in (0, 1)})
    found[301] = ([6] * 20, dodecahedron())
    atoms, bonds = tables(spark, found)
    keys = {r.graph: r.key for r in canonical.canonical_keys(atoms, bonds, [F.col("z")]).collect()}
    for seed in (1, 2):
        atoms, bonds = tables(spark, renumbered(found, seed))
        assert {r.graph: r.key for r in canonical.canonical_keys(atoms, bonds, [F.col("z")]).collect()} == keys


def dodecahedron():
    ring = [(k, (k + 1) % 5) for k in range(5)] + [(15 + k, 15 + (k + 1) % 5) for k in range(5)]
    spokes = [(k, 5 + k) for k in range(5)] + [(10 + k, 15 + k) for k in range(5)]
    belt = [(5 + k, 10 + k) for k in range(5)] + [(10 + k, 5 + (k + 1) % 5) for k in range(5)]
    return {tuple(sorted(e)): 1 for e in ring + spokes + belt}


def test_feature_families_of_known_molecules(spark):
    """Phenol, acetate, guanidinium and pyridine: (z, charge, n_h, aromatic) of atoms, (i, j, type, aromatic) of bonds."""
    ring = [(k, (k + 1) % 6, 1 + k % 2, True) for k in range(6)]
    known = {
        0: ([(6, 0, 0, True)] + [(6, 0, 1, True)] * 5 + [(8, 0, 1, False)], [*ring, (0, 6, 1, False)]),
        1: ([(6, 0, 3, False), (6, 0, 0, False), (8, 0, 0, False), (8, -1, 0, False)], [(0, 1, 1, False), (1, 2, 2, False), (1, 3, 1, False)]),
        2: ([(6, 0, 0, False), (7, 1, 2, False), (7, 0, 2, False), (7, 0, 2, False)], [(0, 1, 2, False), (0, 2, 1, False), (0, 3, 1, False)]),
        3: ([(7, 0, 0, True)] + [(6, 0, 1, True)] * 5, ring),
    }
    atoms = spark.createDataFrame([(g, k, *a) for g, (those, _) in known.items() for k, a in enumerate(those)], "graph int, atom int, z int, charge int, n_h int, aromatic boolean")
    bonds = spark.createDataFrame([(g, *b) for g, (_, those) in known.items() for b in those], "graph int, i int, j int, type int, aromatic boolean")
    points = atoms.select("graph", "atom", *(F.col("atom").cast("double").alias(a) for a in "xyz"))
    found = patterns.pharmacophores(topology.described(atoms, bonds, topology.rings(bonds)), bonds, points).collect()
    got = {}
    for r in found:
        got.setdefault((r.graph, r.family), set()).add(tuple(r.atoms))
        assert r.x == pytest.approx(sum(r.atoms) / len(r.atoms))
    six = {tuple(range(6))}
    assert got == {
        (0, "Aromatic"): six, (0, "Donor"): {(6,)}, (0, "Acceptor"): {(6,)}, (1, "Acceptor"): {(2,), (3,)}, (1, "Anion"): {(3,), (1, 2, 3)}, (1, "Hydrophobe"): {(0,)},
        (2, "Donor"): {(1,), (2,), (3,)}, (2, "Cation"): {(1,), (0, 1, 2, 3)}, (3, "Aromatic"): six, (3, "Acceptor"): {(0,)},
    }
