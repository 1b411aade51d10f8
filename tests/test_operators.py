from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import batching, ensemble, graph, interactions, joins, kernels, metrics, pairs, split
from corvane.sources import schemas, shards, text_formats
from corvane.streaming import metrics as windows


def test_conformer_cascade(spark):
    rows = [(1, 0, None, True, "C"), (1, 1, 0.0, True, "C"), (1, 2, 0.7, True, "C"), (1, 3, 0.5, True, "N"), (1, 4, 0.4, False, "C"), (1, 5, 0.2, True, "C"), (2, 0, None, True, "C")]
    frame = spark.createDataFrame(rows, "m int, o int, w double, v boolean, s string")
    out = ensemble.conformer_outcomes(frame, "m", "o", "w", "v", ["s"])
    assert [r.outcome for r in out.orderBy("m", "o").collect()] == ["missing", "low", "reference", "mismatch", "invalid", "match", "missing"]
    report = {r.outcome: (r.total, r.in_dropped) for r in ensemble.drop_report(out, "m").collect()}
    assert report["missing"] == (2, 1) and report["low"] == (1, 0)


def test_splits_are_seeded_and_disjoint(spark):
    rows = spark.range(12).withColumnRenamed("id", "k")
    first = split.assign_splits(rows, rows, "k", 3, 2, 7).orderBy("k").collect()
    again = split.assign_splits(rows.repartition(5), rows.repartition(3), "k", 3, 2, 7).orderBy("k").collect()
    assert first == again
    assert sorted(map(tuple, split.manifest(spark.createDataFrame(first), "k").select("split", "n").collect())) == [("test", 3), ("train", 7), ("val", 2)]


def test_impossible_splits_are_errors(spark):
    none = spark.range(0).withColumnRenamed("id", "k")
    with pytest.raises(ValueError, match="split sizes"):
        split.assign_splits(none, none, "k", 1, 0, 7)
    one = spark.range(1).withColumnRenamed("id", "k")
    with pytest.raises(ValueError, match="eligible"):
        split.assign_splits(one, none, "k", 1, 0, 7)
    with pytest.raises(ValueError, match="negative"):
        split.assign_splits(one, one, "k", -1, 0, 7)


def test_order_and_repeats_of_an_index_stay(spark):
    rows = spark.createDataFrame([(i, f"r{i}") for i in range(5)], "k int, v string")
    picked = spark.createDataFrame([(0, 3), (1, 1), (2, 3)], "ord int, k int")
    assert [r.v for r in split.indexed(rows, picked, "k", "ord").collect()] == ["r3", "r1", "r3"]
    assert sorted(r.k for r in split.complement(rows, picked, "k").collect()) == [0, 2, 4]


def test_band_join_equals_all_pairs(spark):
    a = [(i, int(v)) for i, v in enumerate(np.random.default_rng(0).integers(0, 30, 60))]
    frame = spark.createDataFrame(a, "id int, n int")
    got = {(r.l_id, r.r_id) for r in joins.band_join(frame, frame, "n", 2).collect()}
    assert got == {(i, j) for (i, x), (j, y) in itertools.product(a, a) if abs(x - y) <= 2}


def test_distance_join_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    a = [(i, *map(float, p)) for i, p in enumerate(rng.normal(0, 2, (80, 2)))]
    frame = spark.createDataFrame(a, "id int, x double, y double")
    got = {(r.l_id, r.r_id) for r in joins.distance_join(frame, frame, ["x", "y"], 0.7).collect()}
    assert got == {(p[0], q[0]) for p, q in itertools.product(a, a) if np.hypot(p[1] - q[1], p[2] - q[2]) <= 0.7}


def test_jaccard_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = [set(rng.integers(0, 40, 12).tolist()) for _ in range(8)]
    sets = {i: frozenset(base[i % 8] ^ set(rng.integers(0, 40, i % 3).tolist())) for i in range(60)}
    frame = spark.createDataFrame([(i, str(t)) for i, s in sets.items() for t in s], "id int, token string")
    reps, members = joins.token_sets(frame, "id")
    found = {(r.a, r.b): r.score for r in joins.jaccard_pairs(reps, 0.7).collect()}
    rep = {r.id: r.rep for r in members.collect()}
    want = {}
    for i, j in itertools.combinations(sorted(set(rep.values())), 2):
        score = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
        if score >= 0.7:
            want[i, j] = pytest.approx(score)
    assert found == want
    assert all(sets[i] == sets[rep[i]] for i in sets)


def test_containing_equals_substring(spark):
    docs = [(0, "a b c d e f"), (1, "x a b c d e f y"), (2, "a b c d e"), (3, "a  b c d e f"), (4, None)]
    passages = [(7, "a b c d e f"), (8, "b c d e f"), (9, "too short")]
    got = {tuple(r) for r in joins.containing(spark.createDataFrame(docs, "id int, text string"), spark.createDataFrame(passages, "pid int, p string"), "id", "text", "pid", "p").collect()}
    assert got == {(d, p) for d, t in docs for p, x in passages[:2] if t and x in t}


def test_containing_inside_words_and_short(spark):
    """Passages of under five words, and ones that begin or end inside a word."""
    docs = [(0, "xa b c d e fy"), (1, "one xa b c d e f g hy two"), (2, "a b c d e f g"), (3, "tiny"), (4, "b c"), (5, None), (6, "a b c d e f g h")]
    passages = [(7, "a b c d e f g h"), (8, "b c"), (9, "a b c d e f"), (10, "in"), (11, None)]
    got = sorted(tuple(r) for r in joins.containing(spark.createDataFrame(docs, "id int, text string"), spark.createDataFrame(passages, "pid int, p string"), "id", "text", "pid", "p").collect())
    assert got == sorted((d, p) for d, t in docs for p, x in passages if t and x and x in t)


def test_locate(spark):
    spans = spark.createDataFrame([("a", 0, 3), ("e", 3, 3), ("b", 3, 10), ("c", 10, 11)], "name string, start long, stop long")
    asked = spark.range(12).withColumnRenamed("id", "place")
    got = {r.place: (r.name, r.local) for r in joins.locate(asked, spans, "place", 4).collect()}
    assert got == {p: ("a", p) if p < 3 else ("b", p - 3) if p < 10 else ("c", 0) for p in range(11)}


def brute_partners(c, x, e, size, hi, chem, tol):
    out = {}
    n, w = c.shape
    for i in range(n):
        best = None
        for j in range(n):
            if j == i or abs(size[i] - size[j]) > tol:
                continue
            for k in range(w):
                if e[i, k] <= chem and e[j, k] <= chem:
                    s = min(c[i, k], x[j, k])
                    if s >= hi and (best is None or s > best[2]):
                        best = (j, k, s)
        if best:
            out[i] = best
    return out


def test_partner_mining_equals_loops(spark):
    rng = np.random.default_rng(11)
    c, x, e = (np.round(rng.random((7, 5)), 1) for _ in range(3))
    size = rng.integers(0, 4, 7)
    scores = spark.createDataFrame([(i, k, float(c[i, k]), float(x[i, k]), float(e[i, k])) for i in range(7) for k in range(5)], "i int, k int, compact double, extended double, ecfp double")
    sizes = spark.createDataFrame([(i, int(s)) for i, s in enumerate(size)], "i int, size int")
    got = {r.i: (r.j, r.k, r.score) for r in pairs.pos_pos(scores, sizes, 0.4, 0.6, 1).collect()}
    assert got == brute_partners(c, x, e, size, 0.4, 0.6, 1)
    reasons = {r.i: r.reason for r in pairs.pos_pos_diagnostics(scores, sizes, 0.4, 0.6, 1).collect()}
    assert {i for i, why in reasons.items() if why is None} == set(got)


def test_assignment_is_optimal():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 7):
        for _ in range(10):
            cost = rng.random((n, n))
            got = kernels.assignment(cost)
            best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            assert sorted(got) == list(range(n)) and cost[np.arange(n), got].sum() == pytest.approx(best)


def test_area_of_a_lone_sphere():
    assert kernels.surface_areas(np.zeros((1, 3)), np.array([1.7]))[0] == pytest.approx(4 * np.pi * 3.1**2)
    two = kernels.surface_areas(np.array([[0.0, 0, 0], [0, 0, 0.5]]), np.array([1.7, 1.7]))
    assert (two < 4 * np.pi * 3.1**2).all()


def test_rotations_are_rotations():
    m = kernels.random_rotation(np.random.default_rng(0))
    assert np.allclose(m @ m.T, np.eye(3)) and np.linalg.det(m) == pytest.approx(1)


def test_rmsf_ignores_rigid_motion(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(6, 3))
    turned = a @ kernels.random_rotation(rng).T + 3
    as_rows = lambda m: [tuple(map(float, p)) for p in m]
    frame = spark.createDataFrame([(0, 0, as_rows(a)), (0, 1, as_rows(turned)), (1, 0, as_rows(a))], "mol int, id int, xyz array<struct<x:double,y:double,z:double>>")
    assert all(r.rmsf == pytest.approx(0, abs=1e-9) for r in ensemble.rmsf(frame, "mol", "id").collect())
    assert {(r.mol, r.id) for r in ensemble.distinct_conformers(frame, "mol", "id", 0.5).collect()} == {(0, 0), (1, 0)}


def test_rmsd_from_singular_values():
    rng = np.random.default_rng(9)
    clouds = rng.normal(size=(5, 7, 3))
    clouds -= clouds.mean(1, keepdims=True)
    want = [np.sqrt(((a - ensemble.kabsch(a, clouds[0])) ** 2).sum(1).mean()) for a in clouds]
    assert ensemble.least_rmsd(clouds, clouds[0]) == pytest.approx(want, abs=1e-7)


def test_augmentation_modes(spark):
    points = [(0.0, 0.0, 0.0, 1), (1.0, 0.0, 0.0, 1), (0.0, 1.0, 0.0, 3)]
    frame = spark.createDataFrame([(i, points) for i in range(4)], "id int, points array<struct<x:double,y:double,z:double,type:int>>")
    same = kernels.augmented_profiles(frame, "id").collect()
    assert all([tuple(p) for p in r.points] == points and r.mode == 0 and not r.rotated for r in same)
    assert all(len(r.points) == 5 for r in kernels.augmented_profiles(frame, "id", resample=1.0).collect())
    both = kernels.augmented_profiles(frame, "id", drop_pharm=1.0, drop_shape=1.0).collect()
    assert all(r.mode == 0 and len(r.points) == 3 for r in both)
    assert all(r.mode == 1 and {p.type for p in r.points} == {1} for r in kernels.augmented_profiles(frame, "id", drop_pharm=1.0).collect())


def test_augmentation_carries_directions_and_atoms(spark):
    """Directions turn with positions, atom ids stay with their points, noise is drawn from its range and moves shape only."""
    kind = "id int, points array<struct<x:double,y:double,z:double,type:int,dx:double,dy:double,dz:double,atom_ids:array<int>>>"
    points = [(1.0, 0.0, 0.0, 1, 0.0, 0.0, 0.0, [1]), (0.0, 2.0, 0.0, 3, 0.0, 1.0, 0.0, [2, 3]), (0.0, 0.0, 3.0, 4, 0.0, 0.0, 1.0, None)]
    frame = spark.createDataFrame([(i, points) for i in range(30)] + [(30, []), (31, None)], kind)
    same = kernels.augmented_profiles(frame, "id").orderBy("id").collect()
    assert [[tuple(p) for p in r.points] for r in same] == [points] * 30 + [[], []]
    for r in kernels.augmented_profiles(frame.where("id < 30"), "id", rotate_prob=1.0).collect():
        assert r.rotated and [p.atom_ids for p in r.points] == [[1], [2, 3], None]
        for p, length in zip(r.points, (0, 2, 3), strict=True):
            assert [length * c for c in (p.dx, p.dy, p.dz)] == pytest.approx([p.x, p.y, p.z] if length else [0] * 3, abs=1e-9)
    shaken = kernels.augmented_profiles(frame.where("id < 30"), "id", pos_std=(0.1, 0.4)).collect()
    assert all(0.1 <= r.noise <= 0.4 and r.points[0].x != 1.0 and [tuple(p) for p in r.points[1:]] == points[1:] for r in shaken)
    assert len({r.noise for r in shaken}) == 30
    gone = kernels.augmented_profiles(frame.where("id < 30"), "id", drop_pharm_point=0.5, resample=1.0).collect()
    assert {tuple(p.atom_ids or ()) for r in gone for p in r.points if p.type == 1} == {(1,)}
    assert all(p.atom_ids == {3: [2, 3], 4: None}.get(p.type, [1]) for r in gone for p in r.points) and len({len(r.points) for r in gone}) > 1
    with pytest.raises(ValueError, match="probabilities"):
        kernels.augmented_profiles(frame, "id", resample=1.5)


def test_missing_kernels_say_so(spark):
    frame = spark.range(2)
    with pytest.raises(kernels.KernelNotInstalled, match="register_kernel"):
        kernels.run_kernel("dock", frame)
    given = frame.withColumn("affinity", F.lit(-7.0))
    assert kernels.run_kernel("dock", given, "affinity") is given


def test_buckets(spark):
    rows = spark.createDataFrame([(i, i) for i in range(1, 11)], "id int, n int")
    out = batching.batches(rows, "n", [4, 8, 16], 16.0, cost="linear")
    assert {r.id: (r.bucket, r.batch) for r in out.collect()} == {i: (0 if i <= 4 else 1 if i <= 8 else 2, [(i - 1) // 4, (i - 5) // 2, i - 9][0 if i <= 4 else 1 if i <= 8 else 2]) for i in range(1, 11)}
    with pytest.raises(Exception, match="longer than the last bucket"):
        batching.batches(rows, "n", [4], 16.0).collect()
    assert batching.batches(rows, "n", [4], 16.0, oversize="drop").count() == 4
    assert batching.batches(rows, "n", [16], 3 * 16.0, drop_last=True).count() == 9
    assert batching.batch_size(64, batching.bucket_cost("quadratic", 48)) == 6 and batching.batch_size(1, 100) == 1


def test_running_sums(spark):
    rows = spark.createDataFrame([(i, (i * 37) % 11) for i in range(200)], "k int, v int").repartition(7)
    got = {r.k: r.s for r in batching.running(rows, ["k"], F.col("v"), "s").collect()}
    upto = 0
    for i in range(200):
        assert got[i] == upto
        upto += (i * 37) % 11


def test_interactions_round_trip(spark):
    rows = spark.createDataFrame([(1, 0, "HBDonor", [2], [4]), (1, 1, "PiStacking", [0, 3], [0, 1])], "c int, ord int, type string, p_atoms array<int>, l_atoms array<int>")
    cells = interactions.dense(rows, "c")
    assert cells.count() == 5
    back = interactions.from_dense(cells, "c")
    assert sorted(map(tuple, interactions.dense(back, "c").collect())) == sorted(map(tuple, cells.collect()))
    kept = interactions.remapped(rows, F.array(F.lit(2), F.lit(0)), F.array(F.lit(4))).collect()
    assert [(r.type, r.p_atoms, r.l_atoms) for r in kept] == [("HBDonor", [0], [0])]
    with pytest.raises(ValueError, match="unknown interaction"):
        interactions.of_types(rows, ["Glue"])
    assert {r.type for r in interactions.grouped(rows, "hbond").collect()} == {"hydrogen-bond", "PiStacking"}


def test_graphs(spark):
    edges = spark.createDataFrame([(0, 2, 1, 1), (0, 1, 2, 1), (0, 3, 4, 2), (0, 5, 6, 0), (1, 1, 2, 3)], "graph int, i int, j int, type int")
    clean = graph.cleaned(edges)
    assert sorted(map(tuple, clean.collect())) == [(0, 1, 2, 1), (0, 3, 4, 2), (1, 1, 2, 3)]
    assert {(r.graph, r.node): r.component for r in graph.components(clean).collect()} == {(0, 1): 1, (0, 2): 1, (0, 3): 3, (0, 4): 3, (1, 1): 1, (1, 2): 1}
    twice = spark.createDataFrame([(0, 1, 2, 1), (0, 1, 2, 2)], "graph int, i int, j int, type int")
    with pytest.raises(Exception, match="more than one type"):
        graph.checked(twice).collect()
    walks = graph.random_walks(clean, 2)
    sums = walks.groupBy("graph", "step", "j").agg(F.sum("p").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in sums)
    dense = spark.createDataFrame([(0, [[0, 1, 0], [1, 0, 2], [0, 2, 0]])], "graph int, m array<array<int>>")
    assert sorted(map(tuple, graph.from_adjacency(dense, "m").collect())) == [(0, 0, 1, 1), (0, 1, 2, 2)]


def test_metrics_and_nulls(spark):
    rows = spark.createDataFrame([(True, "a", 1.0), (None, None, float("nan")), (False, "a", float("inf")), (True, "b", 3.0)], "ok boolean, smi string, v double")
    got = metrics.evaluate(rows, {"valid": metrics.validity(F.col("ok")), "unique": metrics.uniqueness(F.col("smi")), "mean": metrics.mean_of_valid(F.col("v"))}).first()
    assert tuple(got) == pytest.approx((0.5, 2 / 3, 2.0))
    with pytest.raises(ValueError, match="exists"):
        metrics.register_metric("validity", metrics.validity)
    bits = spark.createDataFrame([([5], [4])], "a array<bigint>, b array<bigint>")
    assert bits.select(metrics.bit_tanimoto(F.col("a"), F.col("b"))).first()[0] == pytest.approx(0.5)


def test_schema_faults(spark):
    frame = spark.createDataFrame([([(6, 0, None, None, None)] * 2, [(0, 2, 1)]), ([(6, 0, None, None, None)] * 2, [(0, 1, 1)])], f"atoms array<{schemas.ATOM}>, bonds array<{schemas.BOND}>")
    fault = schemas.molecule_faults(F.col("atoms"), F.col("bonds"))
    assert [r[0] for r in frame.select(fault).collect()] == ["bond end out of range", None]
    with pytest.raises(Exception, match="bond end out of range"):
        schemas.enforced(frame, fault).collect()


def test_shards(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"m{i}") for i in range(25)], "k int, v string")
    path = f"file://{tmp_path}/t"
    shards.save(rows, path, ["k"], 10)
    assert [r.k for r in shards.ordered(shards.load(spark, path)).collect()] == list(range(25))
    first = shards.load(spark, path, 2)
    assert first.count() == 20
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        shards.save(rows, path, ["k"], 10)


def test_sdf_round_trip(spark, tmp_path):
    xyz = [(0.0, 0.0, 0.5), (1.5, 0.0, 0.25)]
    rows = spark.createDataFrame([(0, "one", ["C", "O"], xyz, [(0, 1, 2)]), (1, "none", None, None, None)], "i int, name string, s array<string>, xyz array<struct<x:double,y:double,z:double>>, b array<struct<i:int,j:int,type:int>>")
    text_formats.write_sdf(rows, f"file://{tmp_path}/sdf", "i", F.col("name"), "s", "xyz", "b")
    back = text_formats.read_sdf(spark, f"file://{tmp_path}/sdf").collect()
    assert len(back) == 1 and back[0].error is None and back[0].symbols == ["C", "O"] and back[0].meta == {"sample_index": "0"}
    assert [tuple(p) for p in back[0].xyz] == xyz and [tuple(b) for b in back[0].bonds] == [(0, 1, 2)]
    assert text_formats.single_reference(text_formats.read_sdf(spark, f"file://{tmp_path}/sdf")).count() == 1
    assert text_formats.parse_sdf("x\n\n\nbad")["error"]


def test_pdb_round_trip(spark, tmp_path):
    atoms = [(1, "CA", "ALA", "B", 1, "C", 1.0, 2.0, 3.0), (2, "N", "GLY", "A", 2, "N", -1.5, 0.0, 0.125)]
    frame = spark.createDataFrame([(atoms,)], "atoms array<struct<serial:int,name:string,res_name:string,chain:string,res_id:int,element:string,x:double,y:double,z:double>>")
    frame.select(text_formats.pdb_text(F.col("atoms")).alias("value")).coalesce(1).write.text(f"file://{tmp_path}/pdb")
    back = text_formats.read_pdb(spark, f"file://{tmp_path}/pdb").collect()
    assert len(back) == 1 and back[0].chains == "A_B" and [tuple(a) for a in back[0].atoms] == atoms


def test_pdb_bonds():
    atom = lambda n: f"ATOM  {n:5d}  C   ALA A{n:4d}    {n:8.3f}{0:8.3f}{0:8.3f}  1.00  0.00           C"
    lines = [atom(3), atom(5), atom(9), "ENDMDL", atom(11), "CONECT    3    5    5    9", "CONECT    5    3    3", "CONECT    9   11", "CONECT    9", "END"]
    got = text_formats.parse_pdb("\n".join(lines))
    assert [a["serial"] for a in got["atoms"]] == [3, 5, 9]
    assert got["bonds"] == [{"i": 0, "j": 1, "type": 2}, {"i": 0, "j": 2, "type": 1}]
    assert text_formats.parse_pdb(atom(1))["bonds"] == []


def test_manifest(spark):
    rows = spark.createDataFrame([(2, "test"), (1, "train")], "k int, split string")
    import json

    got = json.loads(text_formats.split_manifest(rows, "k", {"seed": 1}).first()[0])
    assert got == {"config": {"seed": "1"}, "counts": {"test": 1, "train": 1}, "molecules": [{"index": 1, "split": "train"}, {"index": 2, "split": "test"}]}


def test_manifest_in_parts(spark, tmp_path):
    rows = spark.createDataFrame([(k, "test" if k < 2 else "train") for k in range(9)], "k long, split string").repartition(3)
    path = f"file://{tmp_path}/m"
    text_formats.write_manifest(rows, "k", {"seed": 7}, path)
    summary, back = text_formats.read_manifest(spark, path)
    assert summary.first().asDict() == {"config": {"seed": "7"}, "counts": {"test": 2, "train": 7}}
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        text_formats.write_manifest(rows, "k", {}, path)
    back.limit(1).write.mode("append").json(f"{path}/molecules")
    with pytest.raises(Exception, match="differ from its counts"):
        text_formats.read_manifest(spark, path)[0].collect()


def test_stream_equals_batch(spark, tmp_path):
    from compare import SF

    rows = spark.read.parquet(f"{SF}/events.parquet").select("ts", "event_type", "value")
    rows.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
    wanted = {"n": F.count(F.lit(1)), "mean": F.avg("value")}
    got = windows.run_once(windows.windowed(stream, "ts", "1 day", wanted, by=["event_type"]), "stream_metrics", f"{tmp_path}/state")
    want = windows.windowed(rows, "ts", "1 day", wanted, by=["event_type"])
    key = lambda r: (r.window_start, r.event_type)
    for a, b in zip(sorted(got.collect(), key=key), sorted(want.collect(), key=key), strict=True):
        assert (a.window_start, a.event_type, a.n) == (b.window_start, b.event_type, b.n) and a.mean == pytest.approx(b.mean)
