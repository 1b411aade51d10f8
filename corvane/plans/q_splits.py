"""Queries: splits, samples, drop reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.flow import hash_uniform
from corvane.operators import ensemble, split
from corvane.plans.registry import query, scratch
from corvane.session import table
from corvane.sources import text_formats

SEED, N_TEST, N_VAL = 12345, 20, 50

CANDIDATES = """cand AS (
  SELECT p_partkey FROM part
  JOIN (SELECT p_name, p_brand, p_type FROM part GROUP BY ALL HAVING count(*) = 1) USING (p_name, p_brand, p_type)
  WHERE p_size BETWEEN 16 AND 35 AND p_retailprice < 950
    AND p_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) >= 30)
), test AS (
  SELECT p_partkey FROM cand ORDER BY md5(p_partkey || ':12345'), p_partkey LIMIT 20
), val AS (
  SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM test)
  ORDER BY md5(p_partkey || ':12346'), p_partkey LIMIT 50
), splits AS (
  SELECT p_partkey, CASE WHEN p_partkey IN (SELECT p_partkey FROM test) THEN 'test'
    WHEN p_partkey IN (SELECT p_partkey FROM val) THEN 'val' ELSE 'train' END AS split FROM part
)"""


def _splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    confs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n")).where("n >= 30")
    fit = part.where("p_size between 16 and 35 and p_retailprice < 950")
    alone = split.singletons(part, ["p_name", "p_brand", "p_type"]).select("p_partkey")
    candidates = fit.join(alone, "p_partkey", "left_semi").join(confs, "p_partkey", "left_semi")
    return split.assign_splits(part.select("p_partkey"), candidates, "p_partkey", N_TEST, N_VAL, SEED, check=False)


@query(f"WITH {CANDIDATES} SELECT p_partkey, split FROM splits")
def q01_split_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test from singleton-scaffold candidates, val from all the rest, by hash order."""
    return _splits(spark, sf_dir)


@query(f"WITH {CANDIDATES} SELECT split, count(*) AS n, min(p_partkey) AS first_key, max(p_partkey) AS last_key FROM splits GROUP BY 1")
def q02_split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.manifest(_splits(spark, sf_dir), "p_partkey")


@query(f"WITH {CANDIDATES} SELECT split, count(*) AS n, count(*) AS told, sum(p_partkey)::BIGINT AS total, '{SEED}' AS seed FROM splits GROUP BY 1")
def q122_manifest_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split's manifest written in parts and read again: its rows by split beside the counts and the seed that it states."""
    path = scratch(spark, "manifest")
    text_formats.write_manifest(_splits(spark, sf_dir), "p_partkey", {"seed": SEED}, path)
    summary, rows = text_formats.read_manifest(spark, path)
    told = summary.select(F.col("config.seed").alias("seed"), F.explode("counts").alias("split", "told"))
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("index").alias("total")).join(told, "split").select("split", "n", "told", "total", "seed")


@query("""
WITH c AS (
  SELECT *, CASE WHEN l_tax = 0.08 THEN NULL ELSE l_discount END AS w, l_quantity < 45 AS valid FROM lineitem
), u AS (
  SELECT *, w IS NOT NULL AND w > 0 AND valid AS usable FROM c
), f AS (
  SELECT l_partkey, arg_min(l_returnflag, row(l_orderkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)) AS ref
  FROM u WHERE usable GROUP BY 1
), t AS (
  SELECT u.*, ref, sum(usable::int) OVER g AS turn FROM u LEFT JOIN f USING (l_partkey) WINDOW g AS (PARTITION BY l_partkey ORDER BY l_orderkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
    l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate ROWS UNBOUNDED PRECEDING)
), o AS (
  SELECT l_partkey, CASE WHEN w IS NULL THEN 'missing' WHEN w <= 0 THEN 'low' WHEN NOT valid THEN 'invalid'
    WHEN turn = 1 THEN 'reference' WHEN l_returnflag = ref THEN 'match' ELSE 'mismatch' END AS outcome FROM t
), k AS (
  SELECT *, sum((outcome IN ('reference', 'match'))::int) OVER (PARTITION BY l_partkey) AS kept FROM o
)
SELECT outcome, count(*) AS total, count(*) FILTER (kept = 0) AS in_dropped FROM k GROUP BY 1
""")
def q03_drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade of raw conformers: a lineitem is a conformer of its part, its discount the weight."""
    order = ["l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    rows = table(spark, sf_dir, "lineitem").select(
        "l_partkey", F.struct(*order).alias("ord"), "l_returnflag",
        F.when(F.col("l_tax") == 0.08, F.lit(None)).otherwise(F.col("l_discount")).alias("w"), (F.col("l_quantity") < 45).alias("valid"),
    )
    return ensemble.drop_report(ensemble.conformer_outcomes(rows, "l_partkey", "ord", "w", "valid", ["l_returnflag"]), "l_partkey")


@query("""
SELECT p_partkey, p_size FROM part WHERE p_size >= 16 AND p_size < 36
QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY md5(p_partkey || ':42'), p_partkey) <= 3
""")
def q04_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size").where("p_size >= 16 and p_size < 36")
    return split.stratified_sample(part, "p_size", "p_partkey", 3, 42)


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.sum(F.round(F.col("l_discount") * 100).cast("long"))
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_quantity").agg(cents.alias("weight"))


WEIGHTS = "w AS (SELECT l_partkey, l_quantity, sum(round(l_discount * 100)::BIGINT)::BIGINT AS weight FROM lineitem GROUP BY 1, 2)"


@query(f"""
WITH {WEIGHTS}, k AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY weight DESC, l_quantity DESC)::INT AS rank FROM w)
SELECT l_partkey, l_quantity, weight, rank FROM k WHERE rank <= 3
""")
def q05_topk_conformers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.top_k(_weights(spark, sf_dir), ["l_partkey"], 3, [F.col("weight").desc(), F.col("l_quantity").desc()])


@query(f"""
WITH {WEIGHTS}, c AS (
  SELECT *, sum(weight) OVER (PARTITION BY l_partkey ORDER BY l_quantity ROWS UNBOUNDED PRECEDING) AS upto,
    sum(weight) OVER (PARTITION BY l_partkey) AS total FROM w
), d AS (
  SELECT DISTINCT l_partkey, draw::INT AS draw,
    ('0x' || substring(md5(l_partkey || ':' || draw || ':7'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM w, range(1, 4) t(draw)
)
SELECT l_partkey, draw, l_quantity, weight FROM c JOIN d USING (l_partkey)
WHERE u * total >= upto - weight AND u * total < upto
""")
def q17_weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three draws of each part's quantities, proportional to weight: inverse of the cumulative weight."""
    out = ensemble.weighted_sample(_weights(spark, sf_dir), ["l_partkey"], "weight", ["l_quantity"], 3, 7)
    return out.select("l_partkey", "draw", "l_quantity", "weight")


@query("""
SELECT s_suppkey, s_name, copy::INT AS copy FROM supplier, range(1, 4) t(copy)
""")
def q53_replicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.replicate(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), 3)


@query("""
SELECT event_type, count(*) AS n, count(*) FILTER (u > 0.3) AS kept, round(avg(u), 6) AS mean_u FROM (
  SELECT event_type, ('0x' || substring(md5(event_id || ':11'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM events
) GROUP BY 1
""")
def q57_mask_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep flags of a masked feature: a hash draw above the mask probability."""
    rows = table(spark, sf_dir, "events").select("event_type", hash_uniform(F.col("event_id"), seed=11).alias("u"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("u") > 0.3).alias("kept"), F.round(F.avg("u"), 6).alias("mean_u"))
