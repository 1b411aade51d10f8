"""Queries: pharmacophore features, profiles and symmetry reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import geom
from corvane.operators import features
from corvane.plans.registry import PTS, conformers, query, r
from corvane.session import table


def _molecule(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conformers as molecules: atoms 6 and 7 are hydrogens on atom 5; a ring of atoms 0..2, a donor 5, an acceptor of 8 and 9."""
    rows = conformers(spark, sf_dir).select(F.col("vec_id").alias("mol"), "xyz")
    z = F.when(F.col("atom").isin(6, 7), 1).otherwise(6)
    atoms = rows.select("mol", F.posexplode("xyz").alias("atom", "point")).withColumn("z", z)
    bonds = rows.select("mol", F.explode(F.array(*(F.struct(F.lit(5).alias("i"), F.lit(h).alias("j")) for h in (6, 7)))).alias("b")).select("mol", "b.*")
    found = [(0, "Aromatic", (0, 1, 2)), (1, "Donor", (5,)), (2, "Acceptor", (8, 9))]
    listed = F.array(*(F.struct(F.lit(k).alias("feat"), F.lit(f).alias("family"), F.array(*map(F.lit, a)).alias("atom_ids")) for k, f, a in found))
    return atoms, bonds, rows.select("mol", F.explode(listed).alias("f")).select("mol", "f.*")


@query(f"""
WITH {PTS}, w AS (SELECT vec_id AS mol, max(x) FILTER (atom=0) AS x0, max(y) FILTER (atom=0) AS y0, max(z) FILTER (atom=0) AS z0,
    max(x) FILTER (atom=1) AS x1, max(y) FILTER (atom=1) AS y1, max(z) FILTER (atom=1) AS z1, max(x) FILTER (atom=2) AS x2, max(y) FILTER (atom=2) AS y2, max(z) FILTER (atom=2) AS z2,
    max(x) FILTER (atom=5) AS x5, max(y) FILTER (atom=5) AS y5, max(z) FILTER (atom=5) AS z5, max(x) FILTER (atom=6) AS x6, max(y) FILTER (atom=6) AS y6, max(z) FILTER (atom=6) AS z6,
    max(x) FILTER (atom=7) AS x7, max(y) FILTER (atom=7) AS y7, max(z) FILTER (atom=7) AS z7 FROM pts GROUP BY 1
), d AS (
  SELECT mol, 0 AS feat, 0 AS copy, (y1-y0)*(z2-z0) - (z1-z0)*(y2-y0) AS x, (z1-z0)*(x2-x0) - (x1-x0)*(z2-z0) AS y, (x1-x0)*(y2-y0) - (y1-y0)*(x2-x0) AS z FROM w
  UNION ALL SELECT mol, 1, 0, x6-x5, y6-y5, z6-z5 FROM w UNION ALL SELECT mol, 1, 1, x7-x5, y7-y5, z7-z5 FROM w
)
SELECT mol, feat, copy, round(x / sqrt(x*x+y*y+z*z), 6) + 0.0 AS x, round(y / sqrt(x*x+y*y+z*z), 6) + 0.0 AS y, round(z / sqrt(x*x+y*y+z*z), 6) + 0.0 AS z FROM d
UNION ALL SELECT mol, 2, 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM w
""")
def q63_feature_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ring normals, a donor's direction to each of its hydrogens, and none for the acceptor."""
    atoms, bonds, found = _molecule(spark, sf_dir)
    out = features.directed(found, atoms, bonds)
    return out.select("mol", "feat", "copy", *(r(F.col(f"direction.{a}")).alias(a) for a in "xyz"))


@query(f"""
WITH {PTS}, s AS (SELECT vec_id AS mol, 1 AS type, x, y, z FROM pts WHERE atom NOT IN (6, 7)
  UNION ALL SELECT vec_id, 2, avg(x), avg(y), avg(z) FROM pts WHERE atom < 3 GROUP BY 1
  UNION ALL SELECT vec_id, 3, x, y, z FROM pts, range(2) WHERE atom = 5
  UNION ALL SELECT vec_id, 4, avg(x), avg(y), avg(z) FROM pts WHERE atom IN (8, 9) GROUP BY 1)
SELECT mol, type, count(*) AS n, round(sum(x), 6) + 0.0 AS sx, round(sum(y), 6) + 0.0 AS sy, round(sum(z), 6) + 0.0 AS sz FROM s GROUP BY 1, 2
""")
def q64_profile_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed point cloud of each conformer: heavy atoms and feature points."""
    atoms, bonds, found = _molecule(spark, sf_dir)
    directed = features.positions(features.directed(found, atoms, bonds).drop("direction"), atoms).withColumn("direction", F.lit(None).cast("struct<x:double,y:double,z:double>"))
    points = features.profile(atoms, directed.withColumn("direction", F.coalesce("direction", F.col("position"))))
    return points.groupBy("mol", "type").agg(F.count(F.lit(1)).alias("n"), *(r(F.sum(f"position.{a}")).alias(f"s{a}") for a in "xyz"))


@query("""
WITH s AS (SELECT o_custkey, o_orderkey, o_totalprice / 500000 AS shape, length(o_orderpriority) / 20.0::DOUBLE AS colour FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY 0.5 * shape + 0.5 * colour DESC, o_orderkey) AS n FROM s)
SELECT o_custkey, o_orderkey, round(0.5 * shape + 0.5 * colour, 6) AS score FROM k WHERE n = 1
""")
def q65_best_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order stands for a conformer of its customer, price and priority for its two scores."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 500000).alias("shape"), (F.length("o_orderpriority") / F.lit(20.0)).alias("colour"))
    return features.best_alignment(rows, ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", r(F.col("score")).alias("score"))


@query("""
WITH p AS (SELECT user_id AS system, event_id % 8 AS rotation, hour(ts) AS snapshot, avg(value) AS d, max(value) AS r, min(value) AS t FROM events GROUP BY 1, 2, 3),
s AS (SELECT system, snapshot, avg(d) AS d, avg(r) AS r, avg(t) AS t FROM p WHERE rotation <> 0 GROUP BY 1, 2),
m AS (SELECT snapshot, avg(d) AS d, avg(r) AS r, avg(t) AS t FROM s GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY snapshot) - 1 AS i, count(*) OVER () AS n FROM m)
SELECT snapshot::INT AS snapshot, round(d, 6) AS rmsd_direct, round(r, 6) AS rmsd_rotated, round(t, 6) AS atom_tv FROM k WHERE i = 0 OR i = n // 2 OR i = n - 1
""")
def q66_symmetry_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users stand for systems, hours for snapshots, event ids modulo 8 for rotations."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("system"), (F.col("event_id") % 8).alias("rotation"), F.hour("ts").alias("snapshot"))
    rows = rows.agg(F.avg("value").alias("rmsd_direct"), F.max("value").alias("rmsd_rotated"), F.min("value").alias("atom_tv"))
    out = features.symmetry_report(rows)
    return out.select("snapshot", *(r(F.col(c)).alias(c) for c in ("rmsd_direct", "rmsd_rotated", "atom_tv")))


@query(f"""
WITH {PTS}, g AS (SELECT vec_id, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS rog FROM pts GROUP BY 1),
f AS (SELECT vec_id // 40 AS mol, rog, CASE WHEN embedding[64] > 0 THEN embedding[64]::DOUBLE ELSE -1 END AS strain FROM g JOIN embeddings USING (vec_id))
SELECT mol, count(*) AS n, round(avg(rog), 6) AS rog, round(max(rog), 6) AS widest, round(avg(strain), 6) AS strain FROM f GROUP BY 1
""")
def q120_persisted_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of every conformer worked out once and kept, then read twice: means and maxima of each molecule."""
    rows = conformers(spark, sf_dir).select("vec_id", F.expr("vec_id div 40").alias("mol"), "xyz", "energy")
    kept = features.persisted(rows, [("rog", geom.radius_of_gyration(F.col("xyz")), None), ("strain", F.when(F.col("energy") > 0, F.col("energy")), -1.0)])
    means = kept.groupBy("mol").agg(F.count(F.lit(1)).alias("n"), r(F.avg("rog")).alias("rog"), r(F.avg("strain")).alias("strain"))
    return means.join(kept.groupBy("mol").agg(r(F.max("rog")).alias("widest")), "mol").select("mol", "n", "rog", "widest", "strain")
