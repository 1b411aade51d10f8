"""Queries: geometry of conformers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import geom, ragged
from corvane.operators import interactions, kernels
from corvane.plans.registry import PTS, conformers, query, r
from corvane.session import table

#: A rotation by 30 degrees about z, then 45 about x; and a shift.
TURN = [[0.8660254037844387, -0.5, 0.0], [0.3535533905932738, 0.6123724356957946, -0.7071067811865475], [0.35355339059327373, 0.6123724356957945, 0.7071067811865476]]
MOVE = (1.5, -2.0, 0.25)


@query(f"WITH {PTS} SELECT vec_id, round(sqrt(var_pop(x) + var_pop(y) + var_pop(z)), 6) AS rog FROM pts GROUP BY 1")
def q07_radius_of_gyration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conformers(spark, sf_dir).select("vec_id", r(geom.radius_of_gyration(F.col("xyz"))).alias("rog"))


@query(f"""
WITH {PTS} SELECT vec_id, round(avg(x), 6) + 0.0 AS cx, round(avg(y), 6) + 0.0 AS cy, round(avg(z), 6) + 0.0 AS cz,
  round(max(x) - min(x) + 10, 6) AS sx, round(max(y) - min(y) + 10, 6) AS sy, round(max(z) - min(z) + 10, 6) AS sz
FROM pts GROUP BY 1
""")
def q08_centroid_and_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conformers(spark, sf_dir).select("vec_id", geom.box(F.col("xyz"), 5.0).alias("b"))
    return rows.select("vec_id", *(r(F.col(f"b.centre.{a}")).alias(f"c{a}") for a in "xyz"), *(r(F.col(f"b.size.{a}")).alias(f"s{a}") for a in "xyz"))


@query(f"""
WITH {PTS}, c AS (SELECT *, x - avg(x) OVER g AS dx, y - avg(y) OVER g AS dy, z - avg(z) OVER g AS dz FROM pts WINDOW g AS (PARTITION BY vec_id))
SELECT vec_id, round(abs(sum(dx)) + abs(sum(dy)) + abs(sum(dz)), 6) AS off, round(sum(dx*dx + dy*dy + dz*dz), 6) AS spread FROM c GROUP BY 1
""")
def q09_zero_com_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conformers(spark, sf_dir).select("vec_id", geom.centred(F.col("xyz")).alias("c"))
    on = lambda a: lambda p: p[a]
    off = sum((F.abs(geom.total(F.transform("c", on(a)))) for a in "xyz"), F.lit(0.0))
    return rows.select("vec_id", r(off).alias("off"), r(geom.total(F.transform("c", lambda p: geom.dot(p, p)))).alias("spread"))


@query(f"""
WITH {PTS}, t AS (
  SELECT vec_id, atom, x, y, z,
    0.8660254037844387*x - 0.5*y + 0.0*z + 1.5 AS u,
    0.3535533905932738*x + 0.6123724356957946*y - 0.7071067811865475*z - 2.0 AS v,
    0.35355339059327373*x + 0.6123724356957945*y + 0.7071067811865476*z + 0.25 AS w FROM pts
)
SELECT a.vec_id, round(a.u, 6) + 0.0 AS x0, round(a.v, 6) + 0.0 AS y0, round(a.w, 6) + 0.0 AS z0,
  round(sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2), 6) AS before, round(sqrt((a.u-b.u)**2 + (a.v-b.v)**2 + (a.w-b.w)**2), 6) AS after
FROM t a JOIN t b ON a.vec_id = b.vec_id AND a.atom = 0 AND b.atom = 1
""")
def q10_rotate_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotation and shift; distances stay."""
    rows = conformers(spark, sf_dir).withColumn("t", geom.shift(geom.rotate(F.col("xyz"), TURN), geom.point(*map(F.lit, MOVE))))
    first = lambda c: geom.distance(F.get(F.col(c), F.lit(0)), F.get(F.col(c), F.lit(1)))
    return rows.select("vec_id", *(r(F.get("t", F.lit(0))[a]).alias(f"{a}0") for a in "xyz"), r(first("xyz")).alias("before"), r(first("t")).alias("after"))


@query(f"""
WITH {PTS}, s AS (SELECT vec_id, stddev_pop(v) AS std FROM (UNPIVOT pts ON x, y, z INTO NAME axis VALUE v) GROUP BY 1)
SELECT vec_id, round(any_value(std), 6) AS std, round(sum((x*x + y*y + z*z) / std / std), 4) AS norm2 FROM pts JOIN s USING (vec_id) GROUP BY 1
""")
def q58_standardised_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates over their standard deviation, not centred."""
    rows = conformers(spark, sf_dir).withColumn("s", geom.standardised(F.col("xyz")))
    scale = F.get("xyz", F.lit(0))["x"] / F.get("s", F.lit(0))["x"]
    return rows.select("vec_id", r(scale).alias("std"), F.round(geom.total(F.transform("s", lambda p: geom.dot(p, p))), 4).alias("norm2"))


@query(f"""
WITH {PTS}, s AS (SELECT vec_id, atom, 10*x AS x, 10*y AS y, 10*z AS z FROM pts), d AS (
  SELECT d.vec_id, d.atom AS donor, d.x AS dx, d.y AS dy, d.z AS dz, h.x AS hx, h.y AS hy, h.z AS hz
  FROM s d JOIN s h ON d.vec_id = h.vec_id AND h.atom = d.atom + 1 WHERE d.atom < 7
), m AS (
  SELECT d.vec_id, sqrt((dx-a.x)**2 + (dy-a.y)**2 + (dz-a.z)**2) AS dist,
    degrees(acos(greatest(-1, least(1, ((dx-hx)*(a.x-hx) + (dy-hy)*(a.y-hy) + (dz-hz)*(a.z-hz)) /
      (sqrt((dx-hx)**2 + (dy-hy)**2 + (dz-hz)**2) * sqrt((a.x-hx)**2 + (a.y-hy)**2 + (a.z-hz)**2) + 1e-10))))) AS angle
  FROM d JOIN s a ON a.vec_id = d.vec_id AND a.atom >= 14
)
SELECT vec_id, count(*) AS n, round(avg(dist), 5) AS mean_dist, round(avg(angle), 4) AS mean_angle FROM m WHERE dist <= 3.5 AND angle >= 90 GROUP BY 1
""")
def q52_hbond_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms 0..6 as donors, each next atom as its hydrogen, atoms from 14 on as acceptors; tenfold coordinates."""
    atoms = conformers(spark, sf_dir).select("vec_id", F.posexplode(geom.scale(F.col("xyz"), 10.0)).alias("atom", "p"))
    donors = atoms.where("atom < 7").select("vec_id", F.col("atom").alias("donor"), F.col("p").alias("d_point"))
    hydrogens = atoms.where("atom between 1 and 7").select("vec_id", (F.col("atom") - 1).alias("donor"), F.col("p").alias("h_point"))
    acceptors = atoms.where("atom >= 14").select("vec_id", F.col("atom").alias("acceptor"), F.col("p").alias("a_point"))
    met = interactions.hydrogen_bonds(donors.join(hydrogens, ["vec_id", "donor"]), acceptors, ["vec_id"], least_angle=90.0)
    return met.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("dist"), 5).alias("mean_dist"), F.round(F.avg("angle"), 4).alias("mean_angle"))


@query(f"""
WITH {PTS}, c AS (SELECT vec_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM pts WHERE atom < 7 GROUP BY 1)
SELECT vec_id, round(avg(x - cx), 6) + 0.0 AS px, round(avg(y - cy), 6) + 0.0 AS py, round(avg(z - cz), 6) + 0.0 AS pz,
  '7-8,8-9,9-10' AS edges FROM pts JOIN c USING (vec_id) WHERE atom >= 7 GROUP BY 1
""")
def q55_frame_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ligand (atoms 0..6) and pocket (the rest) move into the ligand's frame; pocket edges follow the ligand's atoms."""
    rows = conformers(spark, sf_dir).select("vec_id", F.slice("xyz", 1, 7).alias("ligand"), F.slice("xyz", 8, 14).alias("pocket"))
    moved = rows.withColumn("pocket", geom.shift(F.col("pocket"), geom.centroid(F.col("ligand")), -1)).withColumn("c", geom.centroid(F.col("pocket")))
    chain = F.array(*(F.struct(F.lit(k).alias("i"), F.lit(k + 1).alias("j"), F.lit(1).alias("type")) for k in range(3)))
    edges = F.transform(ragged.offset_edges(chain, F.size("ligand")), lambda e: F.concat_ws("-", e["i"].cast("string"), e["j"].cast("string")))
    return moved.select("vec_id", *(r(F.col(f"c.{a}")).alias(f"p{a}") for a in "xyz"), F.array_join(edges, ",").alias("edges"))


@query("""
WITH a AS (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
    l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS idx FROM lineitem
), h AS (SELECT l_partkey, l_linenumber, idx, row_number() OVER (PARTITION BY l_partkey ORDER BY idx) - 1 AS new FROM a WHERE l_linenumber <> 1)
SELECT l_partkey, count(*) AS n_heavy, max(idx) AS last_old, max(new) AS last_new, sum(new * l_linenumber)::BIGINT AS checksum FROM h GROUP BY 1
""")
def q56_hydrogens_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lineitem is an atom of its part, line number 1 a hydrogen: heavy atoms keep their order and are renumbered."""
    order = ["l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    mols = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("a"))
    mols = mols.withColumn("z", F.transform("a", lambda a: a["l_linenumber"]))
    places = ragged.heavy_places(F.col("z"))
    mols = mols.withColumn("old", places).where(F.size("old") > 0).withColumn("kept", ragged.take(F.col("z"), F.col("old")))
    checksum = F.aggregate(F.transform("kept", lambda z, i: (z * i).cast("long")), F.lit(0).cast("long"), lambda s, v: s + v)
    return mols.select("l_partkey", F.size("kept").cast("long").alias("n_heavy"), F.array_max("old").cast("long").alias("last_old"), (F.size("kept") - 1).cast("long").alias("last_new"), checksum.alias("checksum"))


@query()
def q50_hungarian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conformer's atoms matched to those of the next one of its molecule."""
    rows = conformers(spark, sf_dir).select("vec_id", "mol", "xyz")
    first = rows.select("vec_id", F.lead("vec_id").over(Window.partitionBy("mol").orderBy("vec_id")).alias("b_id")).where("b_id is not null")
    other = rows.select(F.col("vec_id").alias("b_id"), F.col("xyz").alias("b_xyz"))
    pairs = rows.join(first, "vec_id").join(other, "b_id").withColumnRenamed("xyz", "a_xyz")
    out = kernels.match_atoms(pairs, "vec_id")
    return out.select("vec_id", F.array_join(F.transform("order", lambda i: i.cast("string")), ",").alias("atom_order"), F.round("cost", 6).alias("cost"))


@query()
def q51_sasa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accessible area of each conformer at tenfold coordinates, radius 1.7; every third atom is polar."""
    flags = F.array(*(F.lit(k % 3 == 0) for k in range(21)))
    rows = conformers(spark, sf_dir).select("vec_id", geom.scale(F.col("xyz"), 10.0).alias("xyz"), F.array_repeat(F.lit(1.7), 21).alias("radii"), flags.alias("polar"))
    out = kernels.polar_surface(rows, "vec_id")
    return out.select("vec_id", F.round("area", 4).alias("area"), F.round("polar_area", 4).alias("polar_area"))
