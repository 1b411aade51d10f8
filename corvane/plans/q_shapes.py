"""Queries: contacts of rings and halogens, and shapes laid on one another, over the conformers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import geom
from corvane.operators import interactions, shapes
from corvane.plans.q_geometry import MOVE, TURN
from corvane.plans.registry import PTS, conformers, query, r
from corvane.session import settled

#: Coordinates are scaled so far that rings lie a few units apart.
SCALE = 30.0
#: DuckDB: atoms at that scale; rings 0 and 1 are the protein's, 2 and 3 the ligand's, with centre and unit normal.
RINGS = f"""s AS (SELECT vec_id, atom, {SCALE}*x AS x, {SCALE}*y AS y, {SCALE}*z AS z, CASE WHEN atom < 6 THEN 0 WHEN atom < 11 THEN 1 WHEN atom < 16 THEN 2 ELSE 3 END AS ring FROM pts),
m AS (
  SELECT vec_id, ring, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(z, z) AS zz, covar_pop(x, y) AS xy, covar_pop(y, z) AS yz, covar_pop(x, z) AS xz FROM s GROUP BY 1, 2
), m2 AS (SELECT *, (xx + yy + zz) / 3 AS mean, sqrt(((xx - mean)**2 + (yy - mean)**2 + (zz - mean)**2 + 2 * (xy**2 + yz**2 + xz**2)) / 6) AS p FROM m),
m3 AS (
  SELECT *, ((xx - mean) * ((yy - mean) * (zz - mean) - yz * yz) - xy * (xy * (zz - mean) - yz * xz) + xz * (xy * yz - (yy - mean) * xz)) / (2 * p**3) AS half FROM m2
), m4 AS (SELECT *, mean + 2 * p * cos(acos(greatest(-1, least(1, half))) / 3 + 2 * pi() / 3) AS low FROM m3),
m5 AS (SELECT *, xx - low AS a, yy - low AS b, zz - low AS c FROM m4),
m6 AS (
  SELECT *, [xy * yz - xz * b, xz * xy - a * yz, a * b - xy * xy] AS u, [xy * c - xz * yz, xz * xz - a * c, a * yz - xy * xz] AS v, [b * c - yz * yz, yz * xz - xy * c, xy * yz - b * xz] AS w FROM m5
), m7 AS (SELECT *, list_inner_product(u, u) AS nu, list_inner_product(v, v) AS nv, list_inner_product(w, w) AS nw FROM m6),
rings AS (
  SELECT vec_id, ring, [cx, cy, cz] AS centre, list_transform(CASE WHEN nu >= nv AND nu >= nw THEN u WHEN nv >= nw THEN v ELSE w END, lambda q: q / sqrt(greatest(nu, nv, nw))) AS normal FROM m7
)"""
TILT = "degrees(acos(least(1, abs(list_inner_product({0}, {1})) / sqrt(list_inner_product({0}, {0}) * list_inner_product({1}, {1})))))"


def _atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, atom, point, x, y, z, ring of the scaled conformers."""
    rows = conformers(spark, sf_dir).select("vec_id", F.posexplode(geom.scale(F.col("xyz"), SCALE)).alias("atom", "point"))
    ring = F.when(F.col("atom") < 6, 0).when(F.col("atom") < 11, 1).when(F.col("atom") < 16, 2).otherwise(3)
    return rows.select("vec_id", "atom", "point", "point.*", ring.alias("ring"))


def _planes(atoms: DataFrame) -> tuple[DataFrame, DataFrame]:
    planes = settled(interactions.ring_planes(atoms, ["vec_id", "ring"]))
    return planes.where("ring < 2"), planes.where("ring >= 2")


@query(f"""
WITH {PTS}, {RINGS}, q AS (
  SELECT p.vec_id, p.ring AS p, l.ring AS l, list_transform(range(1, 4), lambda i: l.centre[i] - p.centre[i]) AS g, p.normal AS pn, l.normal AS ln FROM rings p JOIN rings l ON p.vec_id = l.vec_id AND p.ring < 2 AND l.ring >= 2
), d AS (
  SELECT *, sqrt(list_inner_product(g, g)) AS dist, {TILT.format("pn", "ln")} AS plane_angle, {TILT.format("pn", "g")} AS pa, {TILT.format("ln", "g")} AS la FROM q
), f AS (
  SELECT *, CASE WHEN dist <= 5.5 AND plane_angle <= 35 AND least(pa, la) <= 33 THEN 'face'
    WHEN dist <= 6.5 AND plane_angle >= 50 AND (pa <= 30 AND abs(list_inner_product(ln, g)) / sin(radians(plane_angle)) <= 1.5 OR la <= 30 AND abs(list_inner_product(pn, g)) / sin(radians(plane_angle)) <= 1.5) THEN 'edge' END AS form FROM d
)
SELECT vec_id, p, l, form, round(dist, 5) AS dist, round(plane_angle, 4) AS plane_angle FROM f WHERE form IS NOT NULL
""")
def q109_pi_stacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of a conformer's first half stacked on those of its second."""
    met = interactions.pi_stacking(*_planes(_atoms(spark, sf_dir)), ["vec_id"])
    return met.select("vec_id", "p", "l", "form", F.round("dist", 5).alias("dist"), F.round("plane_angle", 4).alias("plane_angle"))


@query(f"""
WITH {PTS}, {RINGS}, q AS (
  SELECT r.vec_id, r.ring, s.atom, [s.x - centre[1], s.y - centre[2], s.z - centre[3]] AS g, normal FROM rings r JOIN s ON s.vec_id = r.vec_id AND s.atom % 4 = 0 AND (r.ring < 2) <> (s.ring < 2)
), d AS (SELECT *, sqrt(list_inner_product(g, g)) AS dist, {TILT.format("normal", "g")} AS tilt FROM q)
SELECT vec_id, CASE WHEN ring < 2 THEN ring ELSE atom END AS p, CASE WHEN ring < 2 THEN atom ELSE ring END AS l, CASE WHEN ring < 2 THEN 'CationPi' ELSE 'PiCation' END AS type, round(dist, 5) AS dist
FROM d WHERE dist <= 4.5 AND tilt <= 30
""")
def q110_cation_pi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth atom is a cation: those over a ring of the other half."""
    atoms = settled(_atoms(spark, sf_dir))
    charged = atoms.select("vec_id", "atom", "ring", F.when(F.col("atom") % 4 == 0, 1).otherwise(0).alias("charge"), "point")
    met = interactions.cation_pi(*_planes(atoms), charged.where("ring < 2"), charged.where("ring >= 2"), ["vec_id"])
    return met.withColumn("dist", F.round("dist", 5))


ANGLE = "degrees(acos(greatest(-1, least(1, (({0}.x-{1}.x)*({2}.x-{1}.x) + ({0}.y-{1}.y)*({2}.y-{1}.y) + ({0}.z-{1}.z)*({2}.z-{1}.z)) / (sqrt(({0}.x-{1}.x)**2 + ({0}.y-{1}.y)**2 + ({0}.z-{1}.z)**2) * sqrt(({2}.x-{1}.x)**2 + ({2}.y-{1}.y)**2 + ({2}.z-{1}.z)**2) + 1e-10)))))"


@query(f"""
WITH {PTS}, s AS (SELECT vec_id, atom, {SCALE}*x AS x, {SCALE}*y AS y, {SCALE}*z AS z FROM pts)
SELECT DISTINCT x.vec_id, x.atom AS halogen, a.atom AS acceptor, round(sqrt((x.x-a.x)**2 + (x.y-a.y)**2 + (x.z-a.z)**2), 5) AS dist
FROM s x JOIN s d ON d.vec_id = x.vec_id AND d.atom = x.atom - 1 AND x.atom >= 16 JOIN s a ON a.vec_id = x.vec_id AND a.atom BETWEEN 1 AND 10 JOIN s r ON r.vec_id = x.vec_id AND abs(r.atom - a.atom) = 1
WHERE sqrt((x.x-a.x)**2 + (x.y-a.y)**2 + (x.z-a.z)**2) <= 3.5 AND {ANGLE.format("a", "x", "d")} BETWEEN 130 AND 180 AND {ANGLE.format("x", "a", "r")} BETWEEN 80 AND 140
""")
def q111_halogen_bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms from 16 on are halogens bonded to the atom before, atoms 1 to 10 acceptors bonded to both neighbours."""
    atoms = settled(_atoms(spark, sf_dir).select("vec_id", "atom", "point"))
    donors = atoms.where("atom >= 16").select("vec_id", F.col("atom").alias("halogen"), F.col("point").alias("x_point"))
    donors = donors.join(atoms.select("vec_id", (F.col("atom") + 1).alias("halogen"), F.col("point").alias("d_point")), ["vec_id", "halogen"])
    acceptors = atoms.where("atom between 1 and 10").select("vec_id", F.col("atom").alias("acceptor"), F.col("point").alias("a_point"))
    beside = atoms.select("vec_id", F.explode(F.array(F.col("atom") - 1, F.col("atom") + 1)).alias("acceptor"), F.col("point").alias("r_point"))
    met = interactions.halogen_bonds(donors, acceptors.join(beside, ["vec_id", "acceptor"]), ["vec_id"])
    return met.withColumn("dist", F.round("dist", 5))


def _next_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, a_xyz, b_xyz: each conformer and the next one of its molecule, tenfold coordinates."""
    rows = conformers(spark, sf_dir).select("vec_id", "mol", geom.scale(F.col("xyz"), 10.0).alias("xyz"))
    after = F.lead("vec_id").over(Window.partitionBy("mol").orderBy("vec_id"))
    ids = rows.select("vec_id", after.alias("b_id")).where("b_id is not null")
    pairs = ids.join(rows.select("vec_id", F.col("xyz").alias("a_xyz")), "vec_id")
    return pairs.join(rows.select(F.col("vec_id").alias("b_id"), F.col("xyz").alias("b_xyz")), "b_id").select("vec_id", "a_xyz", "b_xyz")


def _typed(points: str):
    """Every third atom of a conformer is a feature, its type from 0 to 2 in turn."""
    return F.transform(F.filter(F.transform(points, lambda p, i: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"), i.alias("type"))), lambda p: p["type"] % 3 == 0), lambda p: p.withField("type", (p["type"] / 3).cast("int") % 3))


def _volume(radius: float, a: str, b: str) -> str:
    return f"{shapes._peak(radius)!r} * exp(-{shapes._half_exponent(radius)!r} * (({a}.x-{b}.x)**2 + ({a}.y-{b}.y)**2 + ({a}.z-{b}.z)**2))"


@query(f"""
WITH {PTS}, s AS (SELECT vec_id, mol, atom, 10*x AS x, 10*y AS y, 10*z AS z FROM pts), n AS (SELECT vec_id, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS b_id FROM embeddings QUALIFY b_id IS NOT NULL),
p AS (SELECT vec_id AS a, b_id AS b FROM n UNION SELECT vec_id, vec_id FROM n UNION SELECT b_id, b_id FROM n),
v AS (
  SELECT p.a, p.b, sum({_volume(shapes.ATOM_RADIUS, "x", "y")}) AS shape, sum(CASE WHEN x.atom % 3 = 0 AND y.atom % 3 = 0 AND x.atom // 3 % 3 = y.atom // 3 % 3 THEN {_volume(shapes.FEATURE_RADIUS, "x", "y")} ELSE 0 END) AS colour
  FROM p JOIN s x ON x.vec_id = p.a JOIN s y ON y.vec_id = p.b GROUP BY 1, 2
)
SELECT n.vec_id, round(v.shape / (x.shape + y.shape - v.shape), 6) AS shape, round(v.colour / (x.colour + y.colour - v.colour), 6) AS colour
FROM n JOIN v ON v.a = n.vec_id AND v.b = n.b_id JOIN v x ON x.a = n.vec_id AND x.b = n.vec_id JOIN v y ON y.a = n.b_id AND y.b = n.b_id
""")
def q112_shape_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape and colour of each conformer against the next of its molecule, as they lie."""
    pairs = settled(_next_pairs(spark, sf_dir).withColumns({"a_typed": _typed("a_xyz"), "b_typed": _typed("b_xyz")}))
    shape = shapes.tanimoto_volume(F.col("a_xyz"), F.col("b_xyz"))
    colour = shapes.tanimoto_volume(F.col("a_typed"), F.col("b_typed"), shapes.FEATURE_RADIUS, typed=True)
    return pairs.select("vec_id", r(shape).alias("shape"), r(colour).alias("colour"))


@query(f"""
WITH {PTS} SELECT vec_id, 1.0::DOUBLE AS shape, 1.0::DOUBLE AS colour, round(10 * avg(x), 3) + 0.0 AS cx, round(10 * avg(y), 3) + 0.0 AS cy, round(10 * avg(z), 3) + 0.0 AS cz FROM pts GROUP BY 1
""")
def q113_planted_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conformer against its own copy, turned and shifted: alignment lays it back, so both scores are 1."""
    rows = conformers(spark, sf_dir).select("vec_id", geom.scale(F.col("xyz"), 10.0).alias("a_xyz"))
    rows = rows.withColumn("b_xyz", geom.shift(geom.rotate(F.col("a_xyz"), TURN), geom.point(*map(F.lit, MOVE))))
    found = shapes.aligned(rows.withColumns({"a_features": _typed("a_xyz"), "b_features": _typed("b_xyz")}), "vec_id")
    centre = found.select("vec_id", F.round("shape", 3).alias("shape"), F.round("colour", 3).alias("colour"), geom.centroid(F.col("xyz")).alias("c"))
    return centre.select("vec_id", "shape", "colour", *(r(F.col(f"c.{a}"), 3).alias(f"c{a}") for a in "xyz"))


@query()
def q114_shape_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conformer laid on the one before it of its molecule: shape and colour after alignment."""
    pairs = _next_pairs(spark, sf_dir).withColumns({"a_features": _typed("a_xyz"), "b_features": _typed("b_xyz")})
    return shapes.aligned(pairs, "vec_id").select("vec_id", r(F.col("shape"), 4).alias("shape"), r(F.col("colour"), 4).alias("colour"))
