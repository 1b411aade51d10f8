"""E and Z of double bonds, from coordinates: substituents ranked by what they bear, sphere by sphere, then the side they lie on.

Ranks are of directed bonds, p to v: v and all that it bears away from p. At first they go by the atomic number of v; each
round orders equal ones by the ranks of what v bears, the highest first, so round k has compared everything up to k bonds
further on before anything beyond (the hierarchical digraph of the sequence rules). Multiple bonds bear duplicates:
v=c gives v another child with the number of c that bears nothing; hydrogens that are no atoms are children of number 1.
Rings are walked on through instead of ending in duplicates. Only atomic numbers are compared: no isotopes, no chirality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.geom import cross, dot, minus
from corvane.operators.graph import alike, symmetric
from corvane.session import settled


def _large(rows: DataFrame) -> DataFrame:
    """rows, never to be broadcast: ranks repeat from graph to graph, so their files are far smaller than they are in memory."""
    return rows.hint("merge")


def substituent_ranks(atoms: DataFrame, bonds: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(graph, p, v, rank): ranks of directed bonds, higher ones first in priority, equal where nothing tells them apart.

    atoms: (graph, atom, z, n_h); bonds: (graph, i, j, type), each pair once. Ranks are comparable within a graph alone.
    """
    z = atoms.select("graph", F.col("atom").alias("v"), "z", "n_h")
    ways = symmetric(bonds).where("i <> j").select("graph", F.col("i").alias("p"), F.col("j").alias("v"), "type")
    ways = settled(ways.join(_large(z), ["graph", "v"]))
    # Children that bear nothing, by number: hydrogens, and a duplicate for each bond order beyond the first. Both ends of a
    # multiple bond have the other's duplicate, the way it came included.
    copies = ways.select("graph", F.col("p").alias("v"), F.explode(F.expr("array_repeat(z, int(type) - 1)")).alias("leaf"))
    hydrogens = z.select("graph", "v", F.explode(F.array_repeat(F.lit(1), F.col("n_h").cast("int"))).alias("leaf"))
    leaves = copies.union(hydrogens).groupBy("graph", "v").agg(F.collect_list("leaf").alias("leaves"))
    ways = settled(ways.join(_large(leaves), ["graph", "v"], "left"))
    state = settled(ways.select("graph", "p", "v", (F.col("z") * 1.0).alias("rank")))
    leaf = F.coalesce("leaves", F.array().cast("array<int>"))
    order = Window.partitionBy("graph").orderBy("old", "bears")
    before = None
    for turn in range(most_rounds):
        child = state.select("graph", F.col("p").alias("v"), F.col("v").alias("c"), F.col("rank").alias("_r"))
        near = ways.select("graph", "p", "v").join(_large(child), ["graph", "v"]).where("c <> p").groupBy("graph", "p", "v").agg(F.collect_list("_r").alias("_down"))
        rows = ways.join(_large(near), ["graph", "p", "v"], "left").join(_large(state.withColumnRenamed("rank", "old")), ["graph", "p", "v"])
        # Ranks of a graph keep the order of numbers: z + a fraction under 1, and exactly z for what bears nothing, leaves among them.
        bears = F.sort_array(F.concat(F.coalesce("_down", F.array().cast("array<double>")), F.transform(leaf, lambda x: x * 1.0)), asc=False)
        rows = rows.select("graph", "p", "v", "z", "old", bears.alias("bears"))
        many = F.count(F.lit(1)).over(Window.partitionBy("graph"))
        turned = F.when(F.size("bears") == 0, 0.0).otherwise(F.dense_rank().over(order) / (many + 1.0))
        state = settled(rows.withColumn("rank", F.col("z") + turned).select("graph", "p", "v", "rank"))
        now = state.select("graph", "rank").distinct().count()
        if turn and now == before:
            return state
        before = now
    raise RuntimeError("ranks did not settle")


def _side(ends: DataFrame, ranks: DataFrame, end: str, other: str) -> DataFrame:
    """The substituent of highest rank at one end of each double bond, where none of the others equals it."""
    found = ends.join(_large(ranks.select("graph", F.col("p").alias(end), F.col("v").alias("_v"), "rank")), ["graph", end]).where(F.col("_v") != F.col(other))
    best = found.groupBy("graph", "i", "j").agg(F.max(F.struct("rank", "_v")).alias("_b"), F.max("rank").alias("_top"), F.collect_list("rank").alias("_all"))
    alone = F.size(F.filter("_all", lambda x: x == F.col("_top"))) == 1
    return best.where(alone).select("graph", "i", "j", F.col("_b._v").alias(f"s{end}"))


def double_bond_stereo(atoms: DataFrame, bonds: DataFrame, points: DataFrame, rings: DataFrame | None = None, least_ring: int = 8, slack: float = 1e-6) -> DataFrame:
    """(graph, i, j, stereo) of double bonds with a side each: E where the first substituents lie on opposite sides, Z on one.

    atoms: (graph, atom, z, n_h); bonds: (graph, i, j, type, aromatic); points: (graph, atom, point). rings: as
    topology.rings() gives them; bonds in rings of under least_ring atoms have no stereo. Left out are aromatic bonds,
    ends without a substituent or with two equal ones, two hydrogens among them, and ends that lie in line.
    """
    atoms, bonds, members = alike(atoms.select("graph", "atom", "z", "n_h"), bonds.select("graph", "i", "j", "type", "aromatic"))
    doubles = bonds.where((F.col("type") == 2) & ~F.col("aromatic")).select("graph", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    if rings is not None:
        from corvane.operators.topology import ring_edges

        doubles = doubles.join(ring_edges(rings).where(F.col("size") < least_ring).select("graph", "i", "j"), ["graph", "i", "j"], "left_anti")
    doubles = settled(doubles.distinct())
    ranks = substituent_ranks(atoms, bonds)
    rows = doubles.join(_large(_side(doubles, ranks, "i", "j")), ["graph", "i", "j"]).join(_large(_side(doubles, ranks, "j", "i")), ["graph", "i", "j"])
    # Constitution alone gives the substituents; only coordinates differ between graphs that are the same.
    rows = rows.withColumnRenamed("graph", "rep").join(_large(members), "rep").drop("rep")
    for c in ("i", "j", "si", "sj"):
        rows = rows.join(_large(points.select("graph", F.col("atom").alias(c), F.col("point").alias(f"_{c}"))), ["graph", c])
    axis = minus(F.col("_j"), F.col("_i"))
    # Normals of the planes of the axis with either substituent: they point one way where both lie on one side.
    one, two = cross(axis, minus(F.col("_si"), F.col("_i"))), cross(axis, minus(F.col("_sj"), F.col("_j")))
    rows = rows.withColumn("_cos", F.try_divide(dot(one, two), F.sqrt(dot(one, one) * dot(two, two))))
    return rows.where(F.abs("_cos") > slack).select("graph", "i", "j", F.when(F.col("_cos") > 0, "Z").otherwise("E").alias("stereo"))


def stereo_bonds(bonds: DataFrame, stereo: DataFrame) -> DataFrame:
    """bonds with stereo (E, Z or null), as vocab.bond_token() takes it."""
    named = stereo.select(F.col("graph").alias("_g"), F.col("i").alias("_i"), F.col("j").alias("_j"), "stereo")
    on: Column = (F.col("graph") == F.col("_g")) & (F.least("i", "j") == F.col("_i")) & (F.greatest("i", "j") == F.col("_j"))
    return bonds.join(_large(named), on, "left").drop("_g", "_i", "_j")
