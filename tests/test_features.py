from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corvane.operators import features

ATOMS = "mol int, atom int, z int, point struct<x:double,y:double,z:double>"
FEATURES = "mol int, feat int, copy int, family string, atom_ids array<int>"


def test_interactions_find_their_features(spark):
    atoms = spark.createDataFrame([(1, i, 1 if i == 4 else 6, (float(i), 0.0, 0.0)) for i in range(6)], ATOMS)
    found = spark.createDataFrame([(1, 0, 0, "Donor", [3]), (1, 0, 1, "Donor", [3]), (1, 1, 0, "Aromatic", [0, 1, 2]), (1, 2, 0, "Aromatic", [1, 2, 5]), (1, 3, 0, "Cation", [0])], FEATURES)
    asked = spark.createDataFrame(
        [(1, 0, "HBDonor", [3, 4]), (1, 1, "PiStacking", [1, 2]), (1, 2, "PiStacking", [2, 5]), (1, 3, "VdWContact", [0]), (1, 4, "HBDonor", [4]), (1, 5, "HBDonor", [3]), (1, 6, "CationPi", [5])],
        "mol int, ord int, type string, l_atoms array<int>",
    )
    got = sorted(tuple(r) for r in features.binding_profile(asked, found, atoms).collect())
    # The ring of feat 1 and 2 share two atoms with (1, 2): the first wins; (2, 5) is nearer to feat 2.
    assert got == [(1, 0, 0), (1, 1, 0), (1, 2, 0)]


def test_points_apart(spark):
    rows = [[(0.0, 0.0, 0.0), (1.0, 0.0, 0.0)], [(0.0, 0.0, 0.0), (0.05, 0.0, 0.0)], [(float("nan"), 0.0, 0.0), (1.0, 0.0, 0.0)], [(0.0, 0.0, 0.0)]]
    frame = spark.createDataFrame([(r,) for r in rows], "p array<struct<x:double,y:double,z:double>>")
    assert [r[0] for r in frame.select(features.apart(F.col("p"))).collect()] == [True, False, False, True]


def test_condition_flags(spark):
    rows = spark.range(2000).withColumnRenamed("id", "k")
    out = features.condition_flags(rows, "k", 0.8, ["profile", "props"]).agg(F.avg(F.col("keep_profile").cast("int")), F.avg((F.col("keep_profile") & F.col("keep_props")).cast("int"))).first()
    assert out[0] == pytest.approx(0.64, abs=0.04) and out[1] == pytest.approx(0.512, abs=0.04)


def test_targets(spark):
    frame = spark.createDataFrame([(2.0, 1.0), (0.05, -1.0), (None, 1.0)], "v double, d double")
    value, mask = features.target(F.col("v"), F.col("d"), 0.1, 1.0, 0.5)
    assert [tuple(r) for r in frame.select(value, mask).collect()] == [(pytest.approx(2.2), 1), (-2.0, 1), (0.0, 0)]


def test_binding_without_features(spark):
    none = spark.createDataFrame([], FEATURES)
    atoms = spark.createDataFrame([(1, 0, 6, (0.0, 0.0, 0.0))], ATOMS)
    asked = spark.createDataFrame([(1, 0, "HBDonor", [0])], "mol int, ord int, type string, l_atoms array<int>")
    assert features.binding_profile(asked, none, atoms).count() == 0


def test_named_features(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, None)], "k int, v double")
    got = features.with_features(rows, [("a", F.col("v"), -1.0), ("b", F.col("v") * 2, 0.0)], "k", 0.0).orderBy("k").collect()
    assert [(r.a, r.b, r["a-mask"], r["b-mask"]) for r in got] == [(2.0, 4.0, 1, 1), (-1.0, 0.0, 1, 1)]
    assert all(r["a-mask"] == 0 for r in features.with_features(rows, [("a", F.col("v"), -1.0)], "k", 1.0).collect())
    with pytest.raises(ValueError, match="twice"):
        features.with_features(rows, [("a", F.col("v"), 0.0), ("a", F.col("v"), 0.0)])
    for p in (-0.1, 1.1):
        with pytest.raises(ValueError, match="probability"):
            features.with_features(rows, [("a", F.col("v"), 0.0)], "k", p)
    with pytest.raises(Exception, match="has no value"):
        features.with_features(rows, [("a", F.col("v"), None)]).collect()


def test_persisted_features_are_worked_out_once(spark):
    rows = spark.createDataFrame([(m, c, float(c)) for m in range(3) for c in range(15)], "mol int, conf int, v double")
    kept = features.persisted(rows, [("twice", F.col("v") * 2, None)], conformers=10)
    assert kept.count() == 30 and kept.agg(F.max("twice")).first()[0] == 18.0
    assert "Project" not in kept._jdf.queryExecution().optimizedPlan().toString(), "read as a table, not worked out again"
    with pytest.raises(Exception, match="has no value"):
        features.persisted(rows, [("none", F.when(F.col("v") > 0, F.col("v")), None)])
