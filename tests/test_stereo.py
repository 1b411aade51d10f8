"""Ranks of substituents against a walk of the whole tree, and E and Z of planted shapes."""

from __future__ import annotations

import random

from corvane.operators import stereo, topology

POINT = "graph int, atom int, point struct<x:double,y:double,z:double>"


def compare(near, z, n_h, p, a, b, depth):
    """1 if the substituent a of p comes before b, -1 after, 0 equal: by refining, one sphere after another."""
    def node(atom, came):
        return (z[atom], atom, came)

    def kids(n):
        number, atom, came = n
        if atom is None:
            return []
        out = [(1, None, None)] * n_h[atom]
        for u, t in near[atom].items():
            out += [(z[u], None, None)] * (t - 1) + ([(z[u], u, atom)] if u != came else [])
        return out

    def cmp(x, y, d):
        if x[0] != y[0]:
            return 1 if x[0] > y[0] else -1
        if d == 0:
            return 0
        for e in range(d):
            kx, ky = ranked(kids(x), e), ranked(kids(y), e)
            for i in range(max(len(kx), len(ky))):
                if i >= len(kx) or i >= len(ky):
                    return 1 if len(kx) > len(ky) else -1
                if got := cmp(kx[i], ky[i], e):
                    return got
        return 0

    def ranked(those, e):
        from functools import cmp_to_key

        return sorted(those, key=cmp_to_key(lambda x, y: -cmp(x, y, e)))

    return cmp(node(a, p), node(b, p), depth)


def trees(seed, many):
    rng, out = random.Random(seed), []
    for _ in range(many):
        n = rng.randrange(4, 12)
        bonds = {(rng.randrange(max(0, k - 3), k), k): 2 if rng.random() < 0.2 else 1 for k in range(1, n)}
        out.append(([rng.choice((6, 6, 6, 8)) for _ in range(n)], [rng.choice((0, 0, 1)) for _ in range(n)], bonds))
    return out


def tables(spark, found):
    atoms = spark.createDataFrame([(g, k, z, h) for g, (zs, hs, _) in enumerate(found) for k, (z, h) in enumerate(zip(zs, hs, strict=True))], "graph int, atom int, z int, n_h int")
    bonds = spark.createDataFrame([(g, i, j, t, False) for g, (*_, those) in enumerate(found) for (i, j), t in those.items()], "graph int, i int, j int, type int, aromatic boolean")
    return atoms, bonds


def test_ranks_equal_a_walk_of_the_tree(spark):
    found = trees(4, 30)
    ranks = {(r.graph, r.p, r.v): r.rank for r in stereo.substituent_ranks(*tables(spark, found)).collect()}
    checked = 0
    for g, (z, h, bonds) in enumerate(found):
        near = {v: {a + b - v: t for (a, b), t in bonds.items() if v in (a, b)} for v in range(len(z))}
        for p in near:
            for a in near[p]:
                for b in near[p]:
                    if a < b:
                        got = (ranks[g, p, a] > ranks[g, p, b]) - (ranks[g, p, a] < ranks[g, p, b])
                        assert got == compare(near, z, h, p, a, b, 8), (g, p, a, b)
                        checked += 1
    assert checked > 100


def test_sides(spark):
    # Butene, chloro-bromo ethene with hydrogens counted, an end with two equal substituents, and one in line.
    butene = ([6, 6, 6, 6], [3, 1, 1, 3], {(0, 1): 1, (1, 2): 2, (2, 3): 1})
    mixed = ([6, 6, 17, 9, 35, 17], [0] * 6, {(0, 1): 2, (0, 2): 1, (0, 3): 1, (1, 4): 1, (1, 5): 1})
    equal = ([6, 6, 9, 9, 17], [0, 1, 0, 0, 0], {(0, 1): 2, (0, 2): 1, (0, 3): 1, (1, 4): 1})
    flat = {0: [(-0.5, 1.0), (0.0, 0.0), (1.3, 0.0), (1.8, 1.0)], 1: [(-0.5, 1.0), (0.0, 0.0), (1.3, 0.0), (1.8, -1.0)]}
    square = [(0.0, 0.0), (1.3, 0.0), (-0.5, 1.0), (-0.5, -1.0), (1.8, 1.0), (1.8, -1.0)]
    found = [butene, butene, mixed, mixed, equal, butene]
    swapped = [square[k] for k in (0, 1, 3, 2, 4, 5)]
    line = [(-1.0, 0.0), (0.0, 0.0), (1.3, 0.0), (2.3, 0.5)]
    places = [flat[0], flat[1], square, swapped, square[:5], line]
    points = spark.createDataFrame([(g, k, (x, y, 0.0)) for g, those in enumerate(places) for k, (x, y) in enumerate(those)], POINT)
    atoms, bonds = tables(spark, found)
    got = {r.graph: (r.i, r.j, r.stereo) for r in stereo.double_bond_stereo(atoms, bonds, points).collect()}
    assert got == {0: (1, 2, "Z"), 1: (1, 2, "E"), 2: (0, 1, "Z"), 3: (0, 1, "E")}
    tokens = stereo.stereo_bonds(bonds, stereo.double_bond_stereo(atoms, bonds, points))
    assert tokens.count() == bonds.count() and tokens.where("stereo is not null").count() == 4


def test_small_rings_have_no_stereo(spark):
    ring = ([6] * 6, [1, 1, 2, 2, 2, 2], {(k, (k + 1) % 6): 2 if k == 0 else 1 for k in range(6)})
    chain = ([6, 6, 6, 6], [3, 1, 1, 3], {(0, 1): 1, (1, 2): 2, (2, 3): 1})
    atoms, bonds = tables(spark, [ring, chain])
    points = spark.createDataFrame([(0, k, (float(k % 3), float(k // 3), 0.0)) for k in range(6)] + [(1, k, (float(k), float(k % 2), 0.0)) for k in range(4)], POINT)
    found = stereo.double_bond_stereo(atoms, bonds, points, rings=topology.rings(bonds))
    assert [r.graph for r in found.collect()] == [1]


def test_ranks_are_never_broadcast(spark):
    atoms = spark.range(8).selectExpr("id div 4 as graph", "int(id % 4) as atom", "6 as z", "0 as n_h")
    bonds = spark.range(6).selectExpr("id div 3 as graph", "int(id % 3) as i", "int(id % 3) + 1 as j", "if(id % 3 = 1, 2, 1) as type", "false as aromatic")
    points = spark.range(8).selectExpr("id div 4 as graph", "int(id % 4) as atom", "named_struct('x', double(id % 4), 'y', double(id % 2), 'z', 0d) as point")
    plan = stereo.double_bond_stereo(atoms, bonds, points)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_graphs_that_are_the_same_are_worked_out_once(spark):
    from corvane.operators.graph import alike

    atoms = spark.createDataFrame([(g, a, 6 if g < 3 else 7) for g in (1, 2, 3, 4) for a in (0, 1)], "graph long, atom int, z int")
    bonds = spark.createDataFrame([(g, 0, 1, 1 if g < 4 else 2) for g in (1, 2, 3, 4)], "graph long, i int, j int, type int")
    some, links, members = alike(atoms, bonds)
    assert {(r.graph, r.rep) for r in members.collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}
    assert {r.graph for r in some.collect()} == {r.graph for r in links.collect()} == {1, 3, 4}
