"""Composed operators and kernels against brute force."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import flow
from corvane.operators import batching, ensemble, features, filters, interactions, kernels, split
from corvane.sources import results

CLOUD = "mol int, id int, xyz array<struct<x:double,y:double,z:double>>"


def clouds_frame(spark, clouds: dict):
    return spark.createDataFrame([(m, i, [tuple(map(float, p)) for p in c]) for (m, i), c in clouds.items()], CLOUD)


def best_turn(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """b turned onto a, both centred, by the quaternion of the largest eigenvalue: another way than the operator's."""
    s = b.T @ a
    k = np.array([
        [s[0, 0] + s[1, 1] + s[2, 2], s[1, 2] - s[2, 1], s[2, 0] - s[0, 2], s[0, 1] - s[1, 0]],
        [s[1, 2] - s[2, 1], s[0, 0] - s[1, 1] - s[2, 2], s[0, 1] + s[1, 0], s[2, 0] + s[0, 2]],
        [s[2, 0] - s[0, 2], s[0, 1] + s[1, 0], s[1, 1] - s[0, 0] - s[2, 2], s[1, 2] + s[2, 1]],
        [s[0, 1] - s[1, 0], s[2, 0] + s[0, 2], s[1, 2] + s[2, 1], s[2, 2] - s[0, 0] - s[1, 1]],
    ])
    w, x, y, z = np.linalg.eigh(k)[1][:, -1]
    turn = np.array([
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ])
    return b @ turn.T


def centred(c: np.ndarray) -> np.ndarray:
    return c - c.mean(0)


def random_clouds(seed: int, spread: float = 0.3) -> dict:
    rng = np.random.default_rng(seed)
    out = {}
    for m in range(3):
        base = rng.normal(size=(7, 3))
        for i in range(9):
            out[m, i] = (base + rng.normal(0, spread, base.shape)) @ kernels.random_rotation(rng).T + rng.normal(size=3)
    return out


def test_fluctuations_equal_brute_force(spark):
    clouds = random_clouds(1)
    got = {r.mol: r.rmsf for r in ensemble.rmsf(clouds_frame(spark, clouds), "mol", "id", n_refs=2).collect()}
    for m in range(3):
        own = [centred(clouds[m, i]) for i in range(9)]
        found = []
        for ref in own[:2]:
            turned = [best_turn(ref, c) for c in own]
            mean = sum(turned) / len(turned)
            found.append(np.mean([math.sqrt(sum(((t[a] - mean[a]) ** 2).sum() for t in turned) / len(turned)) for a in range(7)]))
        assert got[m] == pytest.approx(np.mean(found), abs=1e-6)


def brute_distinct(clouds: dict, least: float) -> set:
    kept: dict = {}
    for (m, i), c in sorted(clouds.items()):
        c = centred(c)
        if all(math.sqrt(((best_turn(k, c) - k) ** 2).sum() / len(c)) >= least for _, k in kept.get(m, [])):
            kept.setdefault(m, []).append((i, c))
    return {(m, i) for m, own in kept.items() for i, _ in own}


def test_distinct_conformers_equal_brute_force(spark):
    clouds = random_clouds(2)
    got = {(r.mol, r.id) for r in ensemble.distinct_conformers(clouds_frame(spark, clouds), "mol", "id", 0.45).collect()}
    assert got == brute_distinct(clouds, 0.45) and 3 < len(got) < 27


def test_ensemble_chain(spark):
    """Embedding and relaxing by registered kernels, then deduplication, strain and weights against plain loops."""
    clouds = random_clouds(3)
    energy = {k: round(0.37 * n % 5, 3) for n, k in enumerate(clouds)}

    def embed(frames):
        for frame in frames:
            yield frame.assign(xyz=[[dict(zip("xyz", map(float, p), strict=True)) for p in clouds[m, i]] for m, i in zip(frame["mol"], frame["id"], strict=True)])

    def relax(frames):
        for frame in frames:
            yield frame.assign(energy=[energy[m, i] if i else None for m, i in zip(frame["mol"], frame["id"], strict=True)])

    kernels.register_kernel("embed", embed, CLOUD)
    kernels.register_kernel("mmff", relax, CLOUD + ", energy double")
    try:
        rows = spark.createDataFrame(list(clouds), "mol int, id int")
        got = {(r.mol, r.id): (r.strain, r.weight) for r in ensemble.sample_ensemble(rows, "mol", "id", 0.45, 2.0).collect()}
    finally:
        del kernels._KERNELS["embed"], kernels._KERNELS["mmff"]
    there = [k for k in brute_distinct(clouds, 0.45) if k[1]]
    least = {m: min(energy[k] for k in there if k[0] == m) for m in {k[0] for k in there}}
    strain = {k: energy[k] - least[k[0]] for k in there if energy[k] - least[k[0]] <= 2.0}
    raw = {k: math.exp(-s / (ensemble.BOLTZMANN * 300)) for k, s in strain.items()}
    want = {k: (pytest.approx(strain[k]), pytest.approx(raw[k] / sum(v for q, v in raw.items() if q[0] == k[0]))) for k in strain}
    assert got == want


def test_surface_equals_counting_of_points():
    """Accessible area of random spheres against a plain loop over many points of each."""
    rng = np.random.default_rng(5)
    points, radii = rng.normal(0, 2.5, (12, 3)), rng.uniform(1.2, 1.9, 12)
    got = kernels.surface_areas(points, radii)
    draws = rng.normal(size=(20_000, 3))
    draws /= np.linalg.norm(draws, axis=1, keepdims=True)
    for i in range(12):
        shell = points[i] + (radii[i] + 1.4) * draws
        free = np.ones(len(draws), bool)
        for j in range(12):
            if j != i:
                free &= ((shell - points[j]) ** 2).sum(1) >= (radii[j] + 1.4) ** 2
        whole = 4 * math.pi * (radii[i] + 1.4) ** 2
        assert got[i] == pytest.approx(whole * free.mean(), abs=0.03 * whole)


def test_mask_strategy(spark):
    rows = spark.createDataFrame([(0, 0.2, 0.0), (0, 0.2, 0.99), (2, 0.2, 0.0), (2, 0.2, 0.99)], "cur int, u double, again double")
    p = F.array(*(F.lit(v) for v in (0.0, 0.5, 0.5)))
    step = flow.category_step("mask", p, F.col("cur"), F.lit(0.5), 0.1, 0.2, F.col("u"), F.col("again"))
    assert [r[0] for r in rows.select(step).collect()] == [1, 0, 0, 2]
    with pytest.raises(ValueError, match="unknown strategy"):
        flow.category_step("other", p, F.col("cur"), F.lit(0.5), 0.1, 0.2, F.col("u"))


def test_normal_draws(spark):
    z = [r[0] for r in spark.range(20_000).select(flow.hash_normal(F.col("id"), seed=1)).collect()]
    assert abs(np.mean(z)) < 0.03 and abs(np.std(z) - 1) < 0.03 and abs(np.mean(np.array(z) < -1) - 0.1587) < 0.01


def test_molecule_transform_is_rigid(spark):
    """Turning and shifting keep all distances between atoms and group points; draws don't depend on partitions."""
    rng = np.random.default_rng(6)
    as_points = lambda c: [tuple(map(float, p)) for p in c]
    data = [(i, [6, 1, 7, 6], [as_points(rng.normal(size=(4, 3))) for _ in range(3)], [[1], [0, 2]], 5.0 if i else None) for i in range(6)]
    schema = "id int, numbers array<int>, confs array<array<struct<x:double,y:double,z:double>>>, groups array<array<int>>, size double"
    rows = spark.createDataFrame(data, schema)
    plain = {r.id: r for r in features.molecule_transform(rows, "id", seed=3, features=["size"]).collect()}
    moved = {r.id: r for r in features.molecule_transform(rows.repartition(5), "id", seed=3, rotate=True, shift_std=2.0, features=["size"]).collect()}
    cloud = lambda r: np.array([(p.x, p.y, p.z) for p in [*r.xyz, *r.group_points]])
    distances = lambda c: np.linalg.norm(c[:, None] - c[None], axis=2)
    for i in range(6):
        a, b = cloud(plain[i]), cloud(moved[i])
        assert plain[i].numbers == [6, 7, 6] and distances(a) == pytest.approx(distances(b), abs=1e-9) and not np.allclose(a, b)
        assert a[:3].mean(0) == pytest.approx([0, 0, 0], abs=1e-12)
        assert (plain[i].size, plain[i]["size-mask"]) == ((5.0, 1) if i else (0.0, 0))


def test_filters_count_what_they_drop(spark):
    rows = spark.createDataFrame([(5, 3), (50, 3), (5, 1), (None, 3), (50, 1)], "heavy int, confs int")
    conditions = filters.training_conditions(F.col("heavy"), F.col("confs"), 48)
    assert {tuple(r) for r in filters.drop_counts(rows, conditions).collect()} == {(None, 1), ("too_large", 3), ("too_few_conformers", 1)}
    assert [tuple(r) for r in filters.kept(rows, conditions).collect()] == [(5, 3)]


def test_weighted_draws_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(g, i, int(rng.integers(0, 4))) for g in range(20) for i in range(6)]
    frame = spark.createDataFrame(rows, "g int, i int, w int")
    got = {(r.g, r.draw): r.i for r in ensemble.weighted_sample(frame.repartition(7), ["g"], "w", ["i"], 25, 3).collect()}
    draws = {(r.g, r.draw): r.u for r in spark.range(20).select(F.col("id").cast("int").alias("g"), F.explode(F.sequence(F.lit(1), F.lit(25))).alias("draw")).withColumn("u", flow.hash_uniform(F.col("g"), F.col("draw"), seed=3)).collect()}
    want = {}
    for (g, d), u in draws.items():
        own = [(i, w) for q, i, w in rows if q == g]
        at, upto = u * sum(w for _, w in own), 0
        for i, w in own:
            if upto <= at < upto + w:
                want[g, d] = i
            upto += w
    assert got == want and len(got) > 400


def test_pairs_are_drawn_once(spark):
    """Few conformers: every pair; many: so many distinct ones, and means of them by brute force."""
    clouds = {(0, i): c for i, c in enumerate(np.random.default_rng(8).normal(size=(5, 4, 3)))}
    out = ensemble.pairwise_rmsd(clouds_frame(spark, clouds), "mol", "id", "xyz", 200).first()
    each = [math.sqrt(((best_turn(centred(a), centred(b)) - centred(a)) ** 2).sum() / 4) for a, b in itertools.combinations(clouds.values(), 2)]
    assert out.n_pairs == 10 and out.mean_rmsd == pytest.approx(np.mean(each), abs=1e-6)
    many = clouds_frame(spark, {(0, i): np.zeros((2, 3)) + i for i in range(40)})
    assert ensemble.pairwise_rmsd(many, "mol", "id", "xyz", 50).first().n_pairs == 50


def test_contacts_equal_all_pairs(spark):
    rng = np.random.default_rng(9)
    atoms = [(c, i, int(rng.integers(-1, 2)), 6 if rng.random() < 0.7 else 8, tuple(map(float, rng.normal(0, 4, 3)))) for c in range(3) for i in range(40)]
    frame = spark.createDataFrame(atoms, "c int, atom int, charge int, z int, point struct<x:double,y:double,z:double>")
    protein, ligand = frame.where("atom < 25"), frame.where("atom >= 25")
    near = [(p, q) for p, q in itertools.product(atoms, atoms) if p[0] == q[0] and p[1] < 25 <= q[1] and math.dist(p[4], q[4]) <= 4.5]
    got = {(r.c, r.p, r.l, r.type) for r in interactions.ionic_contacts(protein, ligand, ["c"]).collect()}
    assert got == {(p[0], p[1], q[1], "Cationic" if q[2] > 0 else "Anionic") for p, q in near if p[2] * q[2] < 0} and got
    assert {(r.c, r.p, r.l) for r in interactions.contacts(protein, ligand, ["c"]).collect()} == {(p[0], p[1], q[1]) for p, q in near if p[3] == q[3] == 6}


def test_large_samples_are_numbered_in_ranges(spark, monkeypatch):
    rows = spark.range(300).withColumnRenamed("id", "k")
    few = {r.k for r in split.seeded_sample(rows, "k", 40, 5).collect()}
    monkeypatch.setattr(split, "BROADCAST_ROWS", 10)
    assert {r.k for r in split.seeded_sample(rows, "k", 40, 5).collect()} == few


def test_padded_batches(spark):
    rows = spark.createDataFrame([(0, [1, 2]), (0, [3]), (1, [4, 5, 6])], "b int, v array<int>").withColumn("n", F.size("v"))
    got = sorted((r.b, r.v, r.mask) for r in batching.collated(rows, ["b"], {"v": F.lit(0)}, "n").collect())
    assert got == [(0, [1, 2], [1, 1]), (0, [3, 0], [1, 0]), (1, [4, 5, 6], [1, 1, 1])]


def test_results_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5), (2, None)], "mol int, score double")
    totals = rows.agg(F.avg("score").alias("mean"))
    results.write_results(f"file://{tmp_path}/r", totals, rows, {"seed": 1}, {"random": 0.1})
    one, each = results.read_results(spark, f"file://{tmp_path}/r", "mean double", "mol int, score double")
    assert one.first().asDict(True) == {"config": {"seed": "1"}, "baselines": {"random": "0.1"}, "results": {"mean": 0.5}}
    assert sorted(map(tuple, each.collect())) == [(1, 0.5), (2, None)]
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        results.write_results(f"file://{tmp_path}/r", totals, rows, {})
