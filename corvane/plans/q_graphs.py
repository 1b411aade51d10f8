"""Queries: edge lists and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators import graph
from corvane.plans.registry import query, r
from corvane.session import table

EDGES = """e AS (
  SELECT l_linenumber AS graph, l_partkey AS i, l_suppkey AS j, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 0 END AS type FROM lineitem
), c AS (SELECT DISTINCT graph, least(i, j) AS i, greatest(i, j) AS j, type FROM e WHERE type <> 0)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(0)
    return table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("graph"), F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"), kind.alias("type"))


@query(f"WITH {EDGES} SELECT graph, i, j, count(*) AS n_types FROM c GROUP BY 1, 2, 3 HAVING count(*) > 1")
def q33_cleanup_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct undirected edges; the pairs that have more than one type."""
    return graph.conflicts(graph.cleaned(_edges(spark, sf_dir)))


@query(f"""
WITH {EDGES}, s AS (SELECT graph, i, j FROM c UNION ALL SELECT graph, j, i FROM c WHERE i <> j) SELECT graph, i AS node, count(*) AS degree FROM s GROUP BY 1, 2
""")
def q34_adjacency_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(graph.cleaned(_edges(spark, sf_dir)))


@query("""
WITH n AS (SELECT n_regionkey AS graph, n_nationkey AS i, lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS j FROM nation),
e AS (SELECT * FROM n WHERE j IS NOT NULL), s AS (SELECT graph, i, j FROM e UNION SELECT graph, j, i FROM e),
a AS (SELECT * FROM s UNION SELECT graph, i, i FROM s),
p1 AS (SELECT graph, i, j, 1.0::DOUBLE / count(*) OVER (PARTITION BY graph, j) AS p FROM a),
p2 AS (SELECT x.graph, x.i, y.j, sum(x.p * y.p) AS p FROM p1 x JOIN p1 y ON x.graph = y.graph AND x.j = y.i GROUP BY 1, 2, 3),
p3 AS (SELECT x.graph, x.i, y.j, sum(x.p * y.p) AS p FROM p2 x JOIN p1 y ON x.graph = y.graph AND x.j = y.i GROUP BY 1, 2, 3)
SELECT graph, 1 AS step, i, j, round(p, 6) AS p FROM p1 UNION ALL SELECT graph, 2, i, j, round(p, 6) FROM p2 UNION ALL SELECT graph, 3, i, j, round(p, 6) FROM p3
""")
def q35_rrwp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random-walk powers on each region's chain of nations."""
    chain = table(spark, sf_dir, "nation").select(
        F.col("n_regionkey").alias("graph"), F.col("n_nationkey").alias("i"), F.lead("n_nationkey").over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")).alias("j"), F.lit(1).alias("type")
    )
    return graph.random_walks(chain.where("j is not null"), 3).withColumn("p", r(F.col("p")))


@query("""
WITH RECURSIVE e AS (
  SELECT a.p_partkey AS i, b.p_partkey AS j FROM part a JOIN part b ON b.p_partkey = a.p_partkey + a.p_size AND a.p_brand = b.p_brand AND a.p_size > 0
), s AS (SELECT i, j FROM e UNION SELECT j, i FROM e), w AS (
  SELECT DISTINCT i AS node, i AS reach FROM s UNION SELECT s.j, w.reach FROM w JOIN s ON s.i = w.node
)
SELECT node, min(reach) AS component FROM w GROUP BY 1
""")
def q36_connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts linked to the part p_size keys on where brands agree."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    a = part.select(F.col("p_partkey").alias("i"), (F.col("p_partkey") + F.col("p_size")).alias("j"), "p_brand").where("p_size > 0")
    b = part.select(F.col("p_partkey").alias("j"), "p_brand")
    edges = a.join(b, ["j", "p_brand"]).select(F.lit(0).alias("graph"), "i", "j", F.lit(1).alias("type"))
    return graph.components(edges).select("node", "component")
