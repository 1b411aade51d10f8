"""Queries: conformer ensembles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import geom
from corvane.operators import ensemble
from corvane.plans.registry import PTS, conformers, query, r

ENERGY = "e AS (SELECT vec_id, label AS mol, 10 * embedding[64]::DOUBLE AS energy FROM embeddings)"
WEIGHTED = f"""{ENERGY}, x AS (
  SELECT *, exp(-(energy - min(energy) OVER (PARTITION BY mol)) / (0.001987 * 300)) AS raw FROM e
), w AS (SELECT *, raw / sum(raw) OVER (PARTITION BY mol) AS weight FROM x)"""


def _energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conformers(spark, sf_dir).select("vec_id", "mol", (10 * F.col("energy")).alias("energy"))


@query(f"""
WITH {PTS}, g AS (SELECT vec_id, any_value(mol) AS mol, round(sqrt(var_pop(x) + var_pop(y) + var_pop(z)), 9) AS rog FROM pts GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY mol ORDER BY rog, vec_id) - 1 AS rank, count(*) OVER (PARTITION BY mol) AS n FROM g),
b AS (SELECT *, round_even(0.2::DOUBLE * (n - 1), 0)::INT AS lo, round_even(0.8::DOUBLE * (n - 1), 0)::INT AS hi FROM k)
SELECT mol, CASE WHEN rank = lo THEN 'low' ELSE 'high' END AS label, vec_id, round(rog, 6) AS rog FROM b
WHERE n >= 2 AND lo <> hi AND rank IN (lo, hi)
""")
def q06_percentile_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conformers(spark, sf_dir).select("vec_id", "mol", F.round(geom.radius_of_gyration(F.col("xyz")), 9).alias("rog"))
    out = ensemble.percentile_rows(rows, ["mol"], [F.col("rog"), F.col("vec_id")], 0.2, 0.8)
    return out.select("mol", "label", "vec_id", F.round("rog", 6).alias("rog"))


@query(f"WITH {WEIGHTED} SELECT vec_id, mol, round(weight, 6) AS weight FROM w")
def q11_boltzmann_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ensemble.boltzmann_weights(_energies(spark, sf_dir), ["mol"], "energy")
    return out.select("vec_id", "mol", r(F.col("weight")).alias("weight"))


@query(f"WITH {WEIGHTED} SELECT mol, round(-sum(weight * ln(weight)) FILTER (weight >= 1e-10), 6) AS entropy FROM w GROUP BY 1")
def q12_conf_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ensemble.boltzmann_weights(_energies(spark, sf_dir), ["mol"], "energy")
    return out.groupBy("mol").agg(r(ensemble.entropy(F.col("weight"))).alias("entropy"))


class _Text(str):
    """Enough arithmetic on SQL text for geom.determinant()."""

    def __add__(self, o):
        return _Text(f"({str(self)} + {str(o)})")

    def __mul__(self, o):
        return _Text(f"({str(self)} * {str(o)})")

    def __rmul__(self, o):
        return _Text(f"({o} * {str(self)})")


_KEY = [[_Text(f"({x})") for x in row] for row in (
    ("xx+yy+zz", "yz-zy", "zx-xz", "xy-yx"), ("yz-zy", "xx-yy-zz", "xy+yx", "zx+xz"),
    ("zx-xz", "xy+yx", "yy-xx-zz", "yz+zy"), ("xy-yx", "zx+xz", "yz+zy", "zz-xx-yy"),
)]


@query(f"""
WITH {PTS}, c AS (SELECT vec_id, mol, atom, x - avg(x) OVER g AS x, y - avg(y) OVER g AS y, z - avg(z) OVER g AS z FROM pts WINDOW g AS (PARTITION BY vec_id)),
ids AS (SELECT vec_id, mol, row_number() OVER (PARTITION BY mol ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY mol) AS n FROM (SELECT DISTINCT vec_id, mol FROM pts)),
pairs AS (
  SELECT a.mol, a.vec_id AS ia, b.vec_id AS ib, b.i * (b.i - 1) // 2 + a.i AS m, a.n * (a.n - 1) // 2 AS total FROM ids a JOIN ids b ON a.mol = b.mol AND a.i < b.i
), runs AS (
  SELECT mol, total, t, t * total // least(total, 200) AS low, (t + 1) * total // least(total, 200) AS high FROM (SELECT DISTINCT mol, total FROM pairs), range(200) r(t) WHERE t < least(total, 200)
), picked AS (
  SELECT mol, low + floor(('0x' || substring(md5(mol || ':' || t || ':0'), 1, 8))::BIGINT / 4294967296.0::DOUBLE * (high - low))::BIGINT AS m FROM runs
), drawn AS (SELECT mol, ia, ib FROM pairs JOIN picked USING (mol, m)
), m AS (
  SELECT p.mol, ia, ib, sum(a.x*b.x) AS xx, sum(a.x*b.y) AS xy, sum(a.x*b.z) AS xz, sum(a.y*b.x) AS yx, sum(a.y*b.y) AS yy, sum(a.y*b.z) AS yz,
    sum(a.z*b.x) AS zx, sum(a.z*b.y) AS zy, sum(a.z*b.z) AS zz, count(*) AS n, sum(a.x*a.x+a.y*a.y+a.z*a.z+b.x*b.x+b.y*b.y+b.z*b.z) AS g
  FROM drawn p JOIN c a ON a.vec_id = ia JOIN c b ON b.vec_id = ib AND a.atom = b.atom GROUP BY ALL
), q AS (
  SELECT *, -2*(xx*xx+xy*xy+xz*xz+yx*yx+yy*yy+yz*yz+zx*zx+zy*zy+zz*zz) AS c2,
    8*(xx*yz*zy + yy*zx*xz + zz*xy*yx - xx*yy*zz - yz*zx*xy - zy*yx*xz) AS c1, {geom.determinant(_KEY)} AS c0 FROM m
), s AS (
  SELECT mol, sqrt(greatest(0, (g - 2 * list_reduce(list_prepend(g / 2, list_transform(range(50), lambda i: i::DOUBLE)),
    lambda v, i: v - (((v*v + c2)*v + c1)*v + c0) / (4*v*v*v + 2*c2*v + c1))) / n)) AS rmsd FROM q
)
SELECT mol, round(avg(rmsd), 5) AS mean_rmsd, count(*) AS n_pairs FROM s GROUP BY 1
""")
def q13_pairwise_rmsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean aligned RMSD over at most 200 pairs of each molecule."""
    out = ensemble.pairwise_rmsd(conformers(spark, sf_dir), "mol", "vec_id", "xyz")
    return out.select("mol", F.round("mean_rmsd", 5).alias("mean_rmsd"), "n_pairs")


@query()
def q14_rmsf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.rmsf(conformers(spark, sf_dir), "mol", "vec_id").select("mol", F.round("rmsf", 6).alias("rmsf"))


@query()
def q15_dedupe_conformers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.distinct_conformers(conformers(spark, sf_dir), "mol", "vec_id", least=0.15)


@query(f"""
WITH {ENERGY}, s AS (SELECT *, energy - min(energy) OVER (PARTITION BY mol) AS strain FROM e)
SELECT mol, count(*) FILTER (strain <= 3.0) AS kept, count(*) AS total, round(max(strain) FILTER (strain <= 3.0), 6) AS most FROM s GROUP BY 1
""")
def q16_strain_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _energies(spark, sf_dir)
    kept = ensemble.within_strain(rows, ["mol"], "energy", 3.0).groupBy("mol").agg(F.count(F.lit(1)).alias("kept"), r(F.max("strain")).alias("most"))
    return rows.groupBy("mol").agg(F.count(F.lit(1)).alias("total")).join(kept, "mol")
