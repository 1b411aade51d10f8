"""Queries: arithmetic of flow matching on the softmax of embeddings and on grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import flow
from corvane.functions.geom import total
from corvane.plans.registry import PROBS, distributions, query, r
from corvane.session import table

STEPS = 20


@query("""
WITH e AS (SELECT CASE WHEN event_type = 'click' THEN 'constant' ELSE 'decay' END AS kind, (event_id % 21)::INT AS i, count(*) AS n FROM events GROUP BY 1, 2),
g AS (SELECT *, CASE WHEN kind = 'constant' THEN i * (0.999::DOUBLE / 20) ELSE 1 - 0.01::DOUBLE * pow(99.9::DOUBLE, (20 - i) / 20.0::DOUBLE) END AS t FROM e)
SELECT kind, i, n, round(t, 9) AS t, round(CASE WHEN kind = 'constant' THEN 0.999::DOUBLE / 20 ELSE 1 - 0.01::DOUBLE * pow(99.9::DOUBLE, (19 - i) / 20.0::DOUBLE) - t END, 9) AS step,
  round(2 * t - t * t, 9) AS polydec, round(t * t, 9) AS polyinc, round(2 * (1 - t), 9) AS slope FROM g
""")
def q45_step_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is a step of a time grid of 20, clicks of the constant one: times, step sizes, schedules and a schedule's slope."""
    rows = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "click", "constant").otherwise("decay").alias("kind"), (F.col("event_id") % (STEPS + 1)).cast("int").alias("i"))
    at = lambda i: F.when(F.col("kind") == "constant", flow.time_grid("constant", i, STEPS)).otherwise(flow.time_grid("decay", i, STEPS))
    rows = rows.withColumns({"t": at(F.col("i")), "step": at(F.col("i") + 1) - at(F.col("i"))})
    t = F.col("t")
    rows = rows.select("kind", "i", r(t, 9).alias("t"), r(F.col("step"), 9).alias("step"), r(flow.schedule("polydec", t), 9).alias("polydec"), r(flow.schedule("polyinc", t), 9).alias("polyinc"), r(flow.schedule_slope("polydec", t), 9).alias("slope"))
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


def _next(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = distributions(spark, sf_dir)
    return rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q")), "vec_id")


@query(f"""
WITH {PROBS}, b AS (SELECT a.vec_id, a.i, a.p, b.p AS q FROM probs a JOIN probs b ON b.vec_id = a.vec_id + 1 AND a.i = b.i),
d AS (SELECT *, pow(1 / p + 1 / q, -1) AS d, q * q / p AS n FROM b)
SELECT vec_id, round(sum(1.5 * p - 0.5 * q), 6) AS mean_sum, round(max(1.5 * p - 0.5 * q), 6) AS mean_max, round(sum(pow(p, 1.5) * pow(q, -0.5)), 6) AS product_sum,
  round(max(d) / sum(d), 6) AS both_max, round(max(n) / sum(n), 6) AS not_max FROM d GROUP BY 1
""")
def q46_guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guidance of each distribution against the next one: mean, product (not normalised), conjunction, negation."""
    mean, product = flow.guided_mean(F.col("p"), F.col("q"), 1.5), flow.guided_product(F.col("p"), F.col("q"), 1.5)
    both, other = flow.dombi_and(F.col("p"), F.col("q")), flow.dombi_not(F.col("p"), F.col("q"))
    rows = _next(spark, sf_dir).select("vec_id", mean.alias("m"), product.alias("x"), both.alias("b"), other.alias("n"))
    return rows.select(
        "vec_id", r(total(F.col("m"))).alias("mean_sum"), r(F.array_max("m")).alias("mean_max"), r(total(F.col("x"))).alias("product_sum"), r(F.array_max("b")).alias("both_max"), r(F.array_max("n")).alias("not_max")
    )


@query("""
WITH a AS (SELECT vec_id, i, embedding[i+1]::DOUBLE AS v FROM embeddings, range(64) t(i)),
b AS (SELECT a.vec_id, a.i, a.v AS x, b.v AS y, ('0x' || substring(md5(a.vec_id || ':' || a.i || ':3'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM a JOIN a b ON b.vec_id = a.vec_id + 1 AND a.i = b.i)
SELECT vec_id, round(sum(0.7 * x + 0.3 * y), 6) + 0.0 AS line, count(*) FILTER (u > 0.3) AS kept, round(sum(CASE WHEN u > 0.3 THEN x ELSE y END), 6) + 0.0 AS picked FROM b GROUP BY 1
""")
def q47_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as prior of the next one at t = 0.3: the line between them, and entry by entry."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    rows = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    u = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: flow.hash_uniform(F.col("vec_id"), i, seed=3))
    rows = rows.withColumn("u", u)
    line, picked = flow.interpolated(F.col("x"), F.col("y"), 0.3), flow.discrete_interpolated(F.col("x"), F.col("y"), F.col("u"), 0.3)
    kept = F.size(F.filter("u", lambda v: v > 0.3)).cast("long")
    return rows.select("vec_id", r(total(line)).alias("line"), kept.alias("kept"), r(total(picked)).alias("picked"))


@query(f"""
WITH {PROBS}, c AS (SELECT *, vec_id % 64 AS cur, max(CASE WHEN i = vec_id % 64 THEN p END) OVER (PARTITION BY vec_id) AS here FROM probs),
o AS (SELECT *, CASE WHEN i = cur THEN 0 ELSE least(1, 0.05 * (1 + 0.1 + 0.1 * 63 * 0.5) / 0.5 * p + 0.05 * 0.1 * here) END AS off FROM c),
f AS (SELECT *, CASE WHEN i = cur THEN greatest(0, 1 - sum(off) OVER (PARTITION BY vec_id)) ELSE off END AS q,
  greatest(0, (i = cur)::int + 0.05 * ((1 + 0.1 * 0.25) * (p - (i = cur)::int) / 0.5 - 0.1 * 0.25 * ((i = cur)::int - 1.0 / 64) / 0.5)) AS v FROM o)
SELECT vec_id, round(sum(q), 6) AS row_sum, round(max(q) FILTER (i = cur), 6) AS stay, round(sum(v), 6) AS velocity_sum, round(max(v), 6) AS velocity_max FROM f GROUP BY 1
""")
def q48_transition_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transition probabilities from category vec_id mod 64 at t = 0.5, step 0.05, noise 0.1: uniform and velocity."""
    at = (F.col("vec_id") % 64).cast("int")
    t = F.lit(0.5)
    rows = distributions(spark, sf_dir).select("vec_id", at.alias("cur"), flow.uniform_transition(F.col("p"), at, t, 0.05, 0.1).alias("q"), flow.velocity_transition(F.col("p"), at, t, 0.05, 0.1).alias("v"))
    return rows.select("vec_id", r(total(F.col("q"))).alias("row_sum"), r(F.get("q", F.col("cur"))).alias("stay"), r(total(F.col("v"))).alias("velocity_sum"), r(F.array_max("v")).alias("velocity_max"))


@query("""
WITH g AS (SELECT event_type, (event_id % 9) / 10.0::DOUBLE AS t FROM events)
SELECT event_type, round(t, 1) AS t, count(*) AS n, round(least(1, 0.1 * (1 + 0.5 * t) / (1 - t)), 9) AS unmask, round(CASE WHEN t + 0.1 < 1 THEN 0.05::DOUBLE ELSE 0 END, 9) AS again, round(least(10, t / (1 - t)), 9) AS weight FROM g GROUP BY event_type, g.t
""")
def q62_mask_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked sampling: probabilities to unmask and to mask again, and the loss weight, at the times of events."""
    t = F.col("t")
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 9 / F.lit(10.0)).alias("t"))
    rows = rows.select(
        "event_type", F.round(t, 1).alias("t"), r(flow.mask_transition(F.lit(True), t, 0.1, 0.5), 9).alias("unmask"), r(flow.mask_transition(F.lit(False), t, 0.1, 0.5), 9).alias("again"), r(flow.time_weight(t), 9).alias("weight")
    )
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {PROBS} SELECT vec_id % 10 AS bin, count(*) AS n, round(avg(-ln(greatest(p, 1e-12))), 6) AS loss,
  round(avg(-ln(greatest(p, 1e-12)) * least(10, (vec_id % 10 / 10.0::DOUBLE) / (1 - vec_id % 10 / 10.0::DOUBLE))), 6) + 0.0 AS weighted FROM probs WHERE i = (vec_id * 7) % 64 GROUP BY 1
""")
def q117_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of each distribution at a target category, plain and weighted by a time, by tenths of time."""
    loss = flow.cross_entropy(F.col("p"), (F.col("vec_id") * 7 % 64).cast("int"))
    rows = distributions(spark, sf_dir).select((F.col("vec_id") % 10).alias("bin"), loss.alias("loss"))
    weight = flow.time_weight(F.col("bin") / F.lit(10.0))
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), r(F.avg("loss")).alias("loss"), r(F.avg(F.col("loss") * weight)).alias("weighted"))
