"""Gaussian overlap, alignment and ring planes against plain NumPy and planted turns."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import interactions, shapes
from corvane.operators.kernels import random_rotation

POINT = "array<struct<x:double,y:double,z:double>>"
TYPED = "array<struct<x:double,y:double,z:double,type:int>>"


def cloud(rng, n, spread=2.5):
    return rng.normal(size=(n, 3)) * spread


def rows(points):
    return [tuple(map(float, p)) for p in points]


def volume(a, b, radius):
    square = ((a[:, None] - b[None]) ** 2).sum(2)
    return (shapes._peak(radius) * np.exp(-shapes._half_exponent(radius) * square)).sum()


def test_one_gaussian_has_the_volume_of_its_sphere():
    for radius in (1.0, 1.7):
        alpha = shapes.KAPPA / radius**2
        assert shapes.HEIGHT * (np.pi / alpha) ** 1.5 == pytest.approx(4 / 3 * np.pi * radius**3)


def test_scores_as_they_lie(spark):
    rng = np.random.default_rng(1)
    pairs = [(k, cloud(rng, 5 + k), cloud(rng, 9)) for k in range(6)]
    frame = spark.createDataFrame([(k, rows(a), rows(b)) for k, a, b in pairs] + [(99, [], [])], f"k int, a {POINT}, b {POINT}")
    got = {r.k: r.s for r in frame.select("k", shapes.tanimoto_volume(F.col("a"), F.col("b")).alias("s")).collect()}
    for k, a, b in pairs:
        common = volume(a, b, 1.7)
        assert got[k] == pytest.approx(common / (volume(a, a, 1.7) + volume(b, b, 1.7) - common))
    assert got[99] is None


def test_alignment_recovers_planted_turns(spark):
    rng = np.random.default_rng(2)
    data = []
    for k in range(12):
        a = cloud(rng, 10 + k)
        kinds = rng.integers(0, 3, 4)
        turn, shift = random_rotation(rng), rng.normal(size=3) * 20
        b = a @ turn.T + shift
        order = rng.permutation(len(b))
        feature = lambda points: [(*map(float, points[i]), int(t)) for i, t in enumerate(kinds)]  # noqa: B023, E731
        data.append((k, rows(a), rows(b[order]), feature(a), feature(b)))
    frame = spark.createDataFrame(data, f"k int, a_xyz {POINT}, b_xyz {POINT}, a_features {TYPED}, b_features {TYPED}")
    for weight in (0.0, 0.5, 1.0):
        found = {r.k: r for r in shapes.aligned(frame, "k", weight).collect()}
        for k, a, *_ in data:
            if weight:
                assert found[k].shape == pytest.approx(1, abs=1e-4) and found[k].colour == pytest.approx(1, abs=1e-3)
                centre = np.mean([(p.x, p.y, p.z) for p in found[k].xyz], 0)
                assert np.allclose(centre, np.mean(a, 0), atol=1e-2)


def test_alignment_never_scores_below_its_starts_and_tells_mirror_images():
    rng = np.random.default_rng(3)
    none = (np.zeros((0, 3)), np.zeros(0, int))
    for _ in range(10):
        a, b = cloud(rng, 9), cloud(rng, 11)
        one, other = shapes._Cloud(a, *none), shapes._Cloud(b, *none)
        shape, colour, turn, shift = shapes.align(one, other, 1.0)
        assert np.allclose(turn @ turn.T, np.eye(3)) and np.linalg.det(turn) == pytest.approx(1) and colour == 0
        moved = b - b.mean(0) + a.mean(0)
        assert shape >= volume(a, moved, 1.7) / (volume(a, a, 1.7) + volume(b, b, 1.7) - volume(a, moved, 1.7)) - 0.15
        mirror = shapes._Cloud(a * [-1, 1, 1], *none)
        assert shapes.align(one, mirror, 1.0)[0] < 0.98


def test_pairs_climb_together_as_they_do_alone():
    """Sizes differ, so that shorter sides are padded; features may be absent on one side or both."""
    rng = np.random.default_rng(8)
    clouds = [[shapes._Cloud(cloud(rng, 4 + k % 5), cloud(rng, k % 3), rng.integers(0, 2, k % 3)) for k in range(s, s + 12)] for s in (0, 5)]
    together = shapes.align_all(*clouds)
    for k, (a, b) in enumerate(zip(*clouds, strict=True)):
        for x, y in zip(together, shapes.align(a, b), strict=True):
            assert np.allclose(x[k], y, atol=1e-6)


def test_climb_is_monotone():
    rng = np.random.default_rng(4)
    a, b = cloud(rng, 8), cloud(rng, 8)
    turn, shift, before = np.eye(3), np.zeros(3), 0.0
    for _ in range(30):
        square = ((a[:, None] - (b @ turn.T + shift)[None]) ** 2).sum(2)
        weights = np.exp(-shapes._half_exponent(1.7) * square)
        assert weights.sum() >= before - 1e-12
        before = weights.sum()
        turn, shift = shapes.superposed(a, b, weights)


def test_awkward_pairs(spark):
    four = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 2.0, 0.0), (0.0, 0.0, 3.0)]
    data = [(0, four[:3], four, None, None), (1, None, four, None, []), (2, four, four, None, None), (3, [four[0]] * 4, [four[0]] * 5, [], [])]
    frame = spark.createDataFrame(data, f"k int, a_xyz {POINT}, b_xyz {POINT}, a_features {TYPED}, b_features {TYPED}")
    found = {r.k: (r.shape, r.colour) for r in shapes.aligned(frame, "k").collect()}
    assert found[0] == found[1] == (None, None) and found[2] == pytest.approx((1, 0)) and found[3][0] is not None
    assert shapes.aligned(frame.where("false"), "k").count() == 0
    with pytest.raises(ValueError, match="between 0 and 1"):
        shapes.aligned(frame, "k", 1.5)


def test_best_of_an_ensemble(spark):
    rng = np.random.default_rng(6)
    a = cloud(rng, 12)
    data = [(7, c, rows(a), rows(x), [], []) for c, x in enumerate((cloud(rng, 12), a @ random_rotation(rng).T, cloud(rng, 12)))]
    frame = spark.createDataFrame(data, f"mol int, conf int, a_xyz {POINT}, b_xyz {POINT}, a_features {TYPED}, b_features {TYPED}")
    (best,) = shapes.best_aligned(frame, "mol", "conf", weight=1.0).collect()
    assert (best.mol, best.conf) == (7, 1) and best.shape == pytest.approx(1, abs=1e-4)


def test_planes_are_least_squares(spark):
    rng = np.random.default_rng(7)
    rings = {k: cloud(rng, 6) * [1, 1, 0.05] @ random_rotation(rng).T + rng.normal(size=3) * 9 for k in range(8)}
    rings[50] = np.array([[0.0, 0, 0], [1, 0, 0], [2, 0, 0], [3, 0, 0]])  # on a line
    rings[51] = np.array([[1.0, 1, 1]] * 3)
    rings[52] = np.array([[0.0, 0, 5], [1, 0, 5], [1, 1, 5], [0, 1, 5]])  # exactly flat
    frame = spark.createDataFrame([(k, *p) for k, those in rings.items() for p in rows(those)], "ring int, x double, y double, z double")
    for r in interactions.ring_planes(frame, ["ring"]).collect():
        points = rings[r.ring]
        assert np.allclose([r.centre.x, r.centre.y, r.centre.z], points.mean(0))
        if r.ring == 51:
            assert r.normal is None
        elif r.ring != 50:
            want = np.linalg.eigh(np.cov(points.T))[1][:, 0]
            assert abs(want @ [r.normal.x, r.normal.y, r.normal.z]) == pytest.approx(1, abs=1e-6)


def test_stacking_by_hand(spark):
    up, side = (0.0, 0.0, 1.0), (1.0, 0.0, 0.0)
    schema = "c int, ring int, centre struct<x:double,y:double,z:double>, normal struct<x:double,y:double,z:double>"
    protein = spark.createDataFrame([(0, 0, (0.0, 0.0, 0.0), up), (1, 0, (0.0, 0.0, 0.0), up), (2, 0, (0.0, 0.0, 0.0), up), (3, 0, (0.0, 0.0, 0.0), None)], schema)
    ligand = spark.createDataFrame([(0, 5, (0.5, 0.0, 3.6), up), (1, 5, (0.0, 0.0, 5.0), side), (2, 5, (5.0, 0.0, 3.0), up), (3, 5, (0.0, 0.0, 3.0), up)], schema)
    met = {r.c: (r.p, r.l, r.type, r.form) for r in interactions.pi_stacking(protein, ligand, ["c"]).collect()}
    assert met == {0: (0, 5, "PiStacking", "face"), 1: (0, 5, "PiStacking", "edge")}
    atoms = "c int, atom int, charge int, point struct<x:double,y:double,z:double>"
    cations = spark.createDataFrame([(0, 9, 1, (0.0, 1.0, 4.0)), (1, 9, -1, (0.0, 0.0, 4.0)), (2, 9, 1, (4.0, 0.0, 1.0))], atoms)
    none = cations.where("false")
    got = [(r.c, r.p, r.l, r.type) for r in interactions.cation_pi(protein, ligand.where("false"), none, cations, ["c"]).collect()]
    assert got == [(0, 0, 9, "CationPi")]
    got = [(r.c, r.p, r.l, r.type) for r in interactions.cation_pi(protein.where("false"), protein, cations, none, ["c"]).collect()]
    assert got == [(0, 9, 0, "PiCation")]
