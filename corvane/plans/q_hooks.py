"""Queries: users' own functions, features and metrics, and the aggregates over checks and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import ragged
from corvane.operators import features, kernels, metrics
from corvane.plans.registry import conformers, query, r
from corvane.session import table


def _doubled(frames):
    for frame in frames:
        yield frame.assign(twice=frame["p_size"] * 2)[["p_partkey", "p_brand", "twice"]]


@query("SELECT p_brand, sum(2 * p_size)::BIGINT AS total, round(max(2 * p_size) - min(2 * p_size), 6)::DOUBLE AS spread FROM part GROUP BY 1")
def q91_user_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered function of frames, then a registered aggregate of its result."""
    kernels.register_kernel("doubled_size", _doubled, "p_partkey bigint, p_brand string, twice int")
    if "spread" not in metrics.REGISTRY:
        metrics.register_metric("spread", lambda v: F.max(v) - F.min(v))
    rows = kernels.run_kernel("doubled_size", table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"))
    return metrics.evaluate(rows, {"total": F.sum("twice"), "spread": r(metrics.REGISTRY["spread"](F.col("twice")).cast("double"))}, ["p_brand"])


@query("""
SELECT l_shipmode_like AS flag, round(avg((coalesce(a, true) AND coalesce(b, true) AND coalesce(c, true))::INT), 6) AS share, count(*) AS n FROM (
  SELECT l_returnflag AS l_shipmode_like, CASE WHEN l_linenumber <> 3 THEN l_quantity < 40 END AS a, CASE WHEN l_tax > 0.01 THEN l_discount > 0.02 END AS b, l_extendedprice > 1000 AS c FROM lineitem
) GROUP BY 1
""")
def q92_all_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that pass every check; a check that wasn't made counts as passed."""
    checks = [F.when(F.col("l_linenumber") != 3, F.col("l_quantity") < 40), F.when(F.col("l_tax") > 0.01, F.col("l_discount") > 0.02), F.col("l_extendedprice") > 1000]
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), metrics.all_checks(checks).alias("ok"))
    return metrics.evaluate(rows, {"share": r(F.avg(F.col("ok").cast("int"))), "n": F.count(F.lit(1))}, ["flag"])


@query("""
WITH e AS (SELECT label AS mol, CASE WHEN vec_id % 5 = 0 THEN 'nan'::DOUBLE WHEN vec_id % 7 = 0 THEN 'inf'::DOUBLE WHEN vec_id % 11 = 0 THEN NULL ELSE 10 * embedding[64]::DOUBLE END AS energy, 10 * embedding[63]::DOUBLE AS relaxed FROM embeddings),
f AS (SELECT *, CASE WHEN isfinite(energy) THEN energy END AS v FROM e), m AS (SELECT mol, avg(v) AS m FROM f GROUP BY 1)
SELECT (SELECT round(count(v)::DOUBLE / count(*), 6) FROM f) AS valid, (SELECT round(avg(m), 6) FROM m WHERE m IS NOT NULL) AS mean, (SELECT round(avg(v - relaxed), 6) FROM f) AS relax
""")
def q93_energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of finite energies, the mean over molecules of their conformers' mean, and the mean gain of relaxing."""
    bad = F.when(F.col("vec_id") % 5 == 0, float("nan")).when(F.col("vec_id") % 7 == 0, float("inf")).when(F.col("vec_id") % 11 == 0, F.lit(None)).otherwise(10 * F.col("energy"))
    relaxed = 10 * F.get(F.transform("embedding", lambda v: v.cast("double")), F.lit(62))
    rows = conformers(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", relaxed.alias("relaxed")), "vec_id").select("mol", bad.alias("e"), "relaxed")
    v = metrics.finite(F.col("e"))
    whole = metrics.evaluate(rows, {"valid": r(metrics.validity(v.isNotNull())), "relax": r(F.avg(v - F.col("relaxed")))})
    macro = metrics.macro_mean(rows, "mol", "e").select(r(F.col("macro")).alias("mean"))
    return whole.crossJoin(F.broadcast(macro)).select("valid", "mean", "relax")  # one row


@query("""
WITH s AS (SELECT o_custkey, CASE WHEN o_orderkey % 6 = 0 THEN 'nan'::DOUBLE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice / 500000 END AS v FROM orders)
SELECT round(avg(v) FILTER (NOT isnan(v)), 6) AS mean, count(v) FILTER (NOT isnan(v)) AS n FROM s
""")
def q94_mean_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of scores where they exist; 0 / 0 is none."""
    score = F.when(F.col("o_orderkey") % 6 == 0, float("nan")).when(F.col("o_orderkey") % 9 == 0, F.lit(None)).otherwise(F.col("o_totalprice") / 500000)
    rows = table(spark, sf_dir, "orders").select(score.alias("v"))
    return metrics.evaluate(rows, {"mean": r(metrics.mean_of_valid(F.col("v"))), "n": F.count(metrics.finite(F.col("v")))})


@query("""
SELECT p_brand, round(avg(p_size), 6) AS size, count(p_size) AS n, grouping(p_brand)::INT AS is_total FROM part GROUP BY GROUPING SETS ((p_brand), ())
""")
def q95_rows_and_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value for each brand and, in the same scan, one for all."""
    out = metrics.per_row_and_total(table(spark, sf_dir, "part"), "p_brand", F.col("p_size").cast("double"), "size")
    return out.select("p_brand", r(F.col("size")).alias("size"), "n", F.col("is_total").cast("int").alias("is_total"))


@query("""
SELECT p_partkey, round(coalesce(CASE WHEN p_size % 3 <> 0 THEN p_retailprice END, -1), 6) AS price, (1 - ('0x' || substring(md5(p_partkey || ':price:2'), 1, 8))::BIGINT / 4294967296.0::DOUBLE > 0.4)::INT AS price_mask FROM part
""")
def q96_named_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A named feature with its error value and a mask of probability 0.4."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    out = features.with_features(rows, [("price", F.when(F.col("p_size") % 3 != 0, F.col("p_retailprice")), -1.0)], key="p_partkey", mask_prob=0.4, seed=2)
    return out.select("p_partkey", r(F.col("price")).alias("price"), F.col("price-mask").alias("price_mask"))


@query("""
WITH s AS (SELECT conv_id, list(length(text) ORDER BY turn) AS sizes FROM conversations GROUP BY 1)
SELECT conv_id, array_to_string(list_reverse(sizes), ',') AS turned, sizes[len(sizes)] AS last FROM s
""")
def q97_reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as conformers: reordered by a list of places, and one of them picked."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))), lambda t: t["n"]).alias("sizes"))
    back = F.transform(F.sequence(F.lit(1), F.size("sizes")), lambda i: F.size("sizes") - i)
    turned = ragged.take(F.col("sizes"), back)
    return rows.select("conv_id", F.array_join(F.transform(turned, lambda v: v.cast("string")), ",").alias("turned"), F.element_at("sizes", -1).cast("long").alias("last"))
