from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import flow, geom, ragged, vocab


def cloud(rng, n=7):
    return [tuple(map(float, p)) for p in rng.normal(size=(n, 3))]


POINTS = "array<struct<x:double,y:double,z:double>>"


def one(frame):
    return frame.first()[0]


@pytest.fixture(scope="module")
def clouds(spark):
    rng = np.random.default_rng(1)
    pairs = [(cloud(rng), cloud(rng)) for _ in range(6)]
    return pairs, spark.createDataFrame(pairs, f"a {POINTS}, b {POINTS}")


def test_radius_and_box(clouds):
    pairs, frame = clouds
    got = frame.select(geom.radius_of_gyration(F.col("a")), geom.box(F.col("a"), 5.0)).collect()
    for (a, _), (radius, box) in zip(pairs, got, strict=True):
        a = np.array(a)
        assert radius == pytest.approx(np.sqrt(((a - a.mean(0)) ** 2).sum(1).mean()))
        assert list(box["centre"]) == pytest.approx(a.mean(0).tolist())
        assert list(box["size"]) == pytest.approx((np.ptp(a, axis=0) + 10).tolist())


def test_aligned_rmsd_equals_svd(clouds):
    pairs, frame = clouds
    got = [r[0] for r in frame.select(geom.aligned_rmsd(F.col("a"), F.col("b"))).collect()]
    for (a, b), v in zip(pairs, got, strict=True):
        a, b = np.array(a) - np.mean(a, 0), np.array(b) - np.mean(b, 0)
        s = np.linalg.svd(b.T @ a, compute_uv=False) * [1, 1, np.sign(np.linalg.det(b.T @ a))]
        assert v == pytest.approx(np.sqrt(max(0, (a**2).sum() + (b**2).sum() - 2 * s.sum()) / len(a)), abs=1e-6)


def test_rotation_keeps_distances(clouds):
    _, frame = clouds
    turn = [[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]
    before = geom.distance_matrix(F.col("a"), F.col("a"))
    after = geom.distance_matrix(geom.rotate(F.col("a"), turn), geom.rotate(F.col("a"), turn))
    for x, y in frame.select(before, after).collect():
        assert np.allclose(x, y)


def test_unit_of_zero_is_zero(spark):
    zero = geom.point(F.lit(0), F.lit(0), F.lit(0))
    assert tuple(one(spark.range(1).select(geom.unit(zero)))) == (0.0, 0.0, 0.0)
    right = geom.angle_degrees(geom.point(F.lit(1), F.lit(0), F.lit(0)), zero, geom.point(F.lit(0), F.lit(2), F.lit(0)))
    assert one(spark.range(1).select(right)) == pytest.approx(90)


def test_padding(spark):
    values = F.array(F.lit(5), F.lit(6))
    got = spark.range(1).select(ragged.pad(values, 4, F.lit(0)), ragged.mask(values, 4), ragged.one_hot(F.lit(2), 3), ragged.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)))).first()
    assert tuple(got) == ([5, 6, 0, 0], [1, 1, 0, 0], [0, 0, 1], 1)
    with pytest.raises(Exception, match="longer than the padded size"):
        spark.range(1).select(ragged.pad(values, 1, F.lit(0))).collect()


def test_edges_follow_a_selection(spark):
    frame = spark.createDataFrame([([(0, 1, 1), (1, 2, 2), (2, 3, 1)], [3, 2, 0])], "e array<struct<i:int,j:int,type:int>>, keep array<int>")
    assert [tuple(e) for e in one(frame.select(ragged.kept_edges(F.col("e"), F.col("keep"))))] == [(1, 0, 1)]


def test_weights_need_all(spark):
    frame = spark.createDataFrame([([0.5, 0.5],), ([0.5, None],)], "w array<double>")
    assert [r[0] for r in frame.select(ragged.complete_weights(F.col("w"))).collect()] == [[0.5, 0.5], None]


def test_vocabularies(spark):
    assert len(vocab.ATOM_TOKENS) == 38 and len(vocab.RESIDUES) == 58 and len(vocab.INTERACTIONS) == 13
    frame = spark.createDataFrame([("C", 0), ("O", -1)], "s string, q int")
    token = vocab.charged_symbol(F.col("s"), F.col("q"))
    ids = [r[0] for r in frame.select(vocab.encode(token, vocab.ATOM_TOKENS)).collect()]
    assert [vocab.ATOM_TOKENS[i] for i in ids] == ["C_0", "O_-1"]
    with pytest.raises(Exception, match="unknown token"):
        frame.select(vocab.encode(F.lit("Xx_0"), vocab.ATOM_TOKENS)).collect()
    with pytest.raises(Exception, match="stereo"):
        frame.select(vocab.bond_token(F.lit(2), F.lit(False), F.lit("R"))).collect()


def test_step_grids(spark):
    n = 8
    got = np.array([list(r) for r in spark.range(n + 1).select(flow.time_grid("constant", F.col("id"), n), flow.time_grid("decay", F.col("id"), n)).collect()])
    assert np.allclose(got[:, 0], np.linspace(0, 0.999, n + 1))
    assert np.allclose(got[:, 1], (1 - np.geomspace(0.01, 0.999, n + 1))[::-1])


def test_transitions_sum_to_one(spark):
    frame = spark.createDataFrame([([0.2, 0.5, 0.3], 1)], "p array<double>, c int")
    q = one(frame.select(flow.uniform_transition(F.col("p"), F.col("c"), F.lit(0.5), 0.1, 0.2)))
    assert sum(q) == pytest.approx(1) and min(q) >= 0
    last = one(frame.select(flow.mask_transition(F.lit(False), F.lit(0.95), 0.1, 0.5)))
    assert last == 0


def test_pick_is_the_inverse_of_the_cumulative_sum(spark):
    frame = spark.createDataFrame([(u,) for u in (0.0, 0.19, 0.21, 0.69, 0.71, 0.999)], "u double")
    p = F.array(F.lit(0.4), F.lit(1.0), F.lit(0.6))
    assert [r[0] for r in frame.select(flow.pick(p, F.col("u"))).collect()] == [0, 0, 1, 1, 2, 2]


def test_guidance_with_itself_changes_nothing(spark):
    p = F.array(F.lit(0.25), F.lit(0.75))
    got = spark.range(1).select(flow.guided_mean(p, p, 1.7), flow.guided_product(p, p, 1.7), flow.dombi_not(p, p), flow.combined_guidance([p], [p], 2.0)).first()
    assert all(list(v) == pytest.approx([0.25, 0.75]) for v in got)
