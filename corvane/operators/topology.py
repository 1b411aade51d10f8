"""What follows from the bonds alone: distances along the graph, shortest paths, rings.

atoms: (graph, atom, ...); bonds: (graph, i, j, type), each pair once, in any direction. Many graphs are worked on at once,
level by level; a level is a join of the last one with the bonds, and only the two levels before it can hold what it
reaches again.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.graph import symmetric
from corvane.session import settled, shipped


def _adjacent(bonds: DataFrame) -> DataFrame:
    return settled(symmetric(bonds).where("i <> j").select("graph", F.col("i").alias("at"), F.col("j").alias("next")).distinct())


def _levels(bonds: DataFrame, most: int | None, sources: DataFrame | None, paths: bool) -> list[DataFrame]:
    """Rows (graph, a, b, steps[, path]) by level: b is `steps` bonds from a; path is the least of the shortest ones, as an array from a to b."""
    near = _adjacent(bonds)
    first = near.select("graph", F.col("at").alias("a"), F.col("next").alias("b"), F.lit(1).alias("steps"))
    if sources is not None:
        first = first.join(sources.select("graph", "a").distinct(), ["graph", "a"], "left_semi")
    if paths:
        first = first.withColumn("path", F.array("a", "b"))
    levels = [settled(first)]
    while most is None or len(levels) < most:
        last = levels[-1].join(near, (levels[-1]["graph"] == near["graph"]) & (F.col("b") == F.col("at"))).where("a <> next").drop(near["graph"])
        reached = last.withColumn("b", F.col("next"))
        if paths:
            reached = reached.groupBy("graph", "a", "b").agg(F.min(F.concat("path", F.array("next"))).alias("path"))
        else:
            reached = reached.select("graph", "a", "b").distinct()
        known = reduce(DataFrame.unionByName, (x.select("graph", "a", "b") for x in levels[-2:]))
        new = reached.join(known, ["graph", "a", "b"], "left_anti").withColumn("steps", F.lit(len(levels) + 1))
        new = settled(new.select(levels[-1].columns))
        if new.isEmpty():
            break
        levels.append(new)
    return levels


def bond_distances(bonds: DataFrame, most: int | None = None, sources: DataFrame | None = None) -> DataFrame:
    """(graph, a, b, steps): the bonds between atoms a <> b along the shortest way, for pairs at most `most` apart (None: all that are connected).

    sources: (graph, a), where only some atoms' distances are asked for. Double and looped bonds change nothing.
    """
    return reduce(DataFrame.unionByName, _levels(bonds, most, sources, paths=False))


def shortest_paths(bonds: DataFrame, most: int | None = None, sources: DataFrame | None = None) -> DataFrame:
    """bond_distances() with path: the atoms from a to b along the first of the shortest ways, in the atoms' order."""
    return reduce(DataFrame.unionByName, _levels(bonds, most, sources, paths=True))


def pruned(bonds: DataFrame) -> DataFrame:
    """The bonds left after end atoms are cut off until there are none: rings and what joins them."""
    found = settled(symmetric(bonds).where("i < j").select("graph", "i", "j").distinct())
    before = found.count()
    while True:
        for _ in range(3):  # cuts of one plan
            both = found.select("graph", F.explode(F.array("i", "j")).alias("atom"))
            ends = both.groupBy("graph", "atom").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select("graph", "atom")
            for side in ("i", "j"):
                found = found.join(ends.withColumnRenamed("atom", side), ["graph", side], "left_anti")
        found = settled(found.select("graph", "i", "j"))
        if (now := found.count()) == before:
            return found
        before = now


def _pair(a: Column, b: Column) -> Column:
    return F.struct(F.least(a, b).alias("i"), F.greatest(a, b).alias("j"))


def ring_candidates(bonds: DataFrame) -> DataFrame:
    """(graph, size, ring, edges): cycles of two shortest paths from an atom to the ends of a bond (Horton, 1987), each once.

    They hold a least cycle basis. ring is the atoms in order around it, edges the sorted pairs of neighbours.
    """
    bonds = pruned(bonds)
    paths = settled(shortest_paths(bonds.withColumn("type", F.lit(1))).select("graph", "a", "b", "path"))
    side = lambda end, name: paths.select("graph", "a", F.col("b").alias(end), F.col("path").alias(name))
    met = bonds.join(side("i", "_p"), ["graph", "i"]).join(side("j", "_q"), ["graph", "a", "j"])
    met = met.where(F.size(F.array_intersect("_p", "_q")) == 1)
    ring = F.concat("_p", F.reverse(F.slice("_q", F.lit(2), F.size("_q") - 1)))
    met = met.select("graph", ring.alias("ring"))
    after = F.concat(F.slice("ring", F.lit(2), F.size("ring") - 1), F.slice("ring", 1, 1))
    edges = F.array_sort(F.zip_with("ring", after, _pair))
    return met.withColumn("edges", edges).groupBy("graph", "edges").agg(F.min("ring").alias("ring")).select("graph", F.size("ring").alias("size"), "ring", "edges")


def independent(masks: list[int]) -> list[int]:
    """Places of the bit masks, in their order, that no sum over GF(2) of earlier ones gives."""
    pivots: dict[int, int] = {}
    kept = []
    for at, mask in enumerate(masks):
        while mask and (low := mask & -mask) in pivots:
            mask ^= pivots[low]
        if mask:
            pivots[mask & -mask] = mask
            kept.append(at)
    return kept


def rings(bonds: DataFrame) -> DataFrame:
    """(graph, ring_id, size, ring): a least cycle basis of each graph: its smallest independent rings, ring_id from 0 by size and atoms.

    Candidates are eliminated over GF(2), smallest first, a graph at a time. Of equally small rings the one with the
    least edges counts, so results depend on the numbering of atoms where a graph has several least bases; how many
    rings of a size there are doesn't. Graphs without rings have no row.
    """
    candidates = ring_candidates(bonds)

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["size", "edges", "ring"]).to_pylist(), key=lambda r: (r["size"], [(e["i"], e["j"]) for e in r["edges"]]))
        bit: dict[tuple, int] = {}
        masks = [sum(1 << bit.setdefault((e["i"], e["j"]), len(bit)) for e in r["edges"]) for r in rows]
        kept = [rows[at] for at in independent(masks)]
        graph = pa.repeat(table.column("graph")[0], len(kept))
        ring = pa.array([r["ring"] for r in kept], table.schema.field("ring").type)
        return pa.table([graph, pa.array(range(len(kept)), pa.int32()), pa.array([r["size"] for r in kept], pa.int32()), ring], names=["graph", "ring_id", "size", "ring"])

    shipped(bonds.sparkSession)
    types = dict(candidates.dtypes)
    return candidates.groupBy("graph").applyInArrow(run, f"graph {types['graph']}, ring_id int, size int, ring {types['ring']}")


def ring_edges(found: DataFrame) -> DataFrame:
    """(graph, ring_id, size, i, j) of rings(), i < j."""
    after = F.concat(F.slice("ring", F.lit(2), F.size("ring") - 1), F.slice("ring", 1, 1))
    return found.select("graph", "ring_id", "size", F.explode(F.zip_with("ring", after, _pair)).alias("e")).select("graph", "ring_id", "size", "e.i", "e.j")


def marked_rings(found: DataFrame, bonds: DataFrame, flag: Column) -> DataFrame:
    """rings() with `whole`: does flag hold for all of a ring's bonds (say, are all aromatic)?"""
    flagged = bonds.select("graph", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), flag.alias("_flag"))
    whole = ring_edges(found).join(flagged, ["graph", "i", "j"], "left").groupBy("graph", "ring_id").agg(F.bool_and(F.coalesce("_flag", F.lit(False))).alias("whole"))
    return found.join(whole, ["graph", "ring_id"])


def described(atoms: DataFrame, bonds: DataFrame, found: DataFrame) -> DataFrame:
    """atoms (graph, atom, z, n_h, ...) with what conditions of patterns ask for.

    hydrogens: all of an atom's, whether they are atoms (z = 1) or counted by n_h; connections: bonded atoms and n_h;
    valence: orders of its bonds and n_h; ring_sizes: the sorted sizes of its rings, as rings() finds them; in_ring.
    """
    ends = symmetric(bonds).where("i <> j")
    hydrogen = atoms.where("z = 1").select("graph", F.col("atom").alias("j"), F.lit(1).alias("_h"))
    sums = ends.join(hydrogen, ["graph", "j"], "left").groupBy("graph", F.col("i").alias("atom"))
    sums = sums.agg(F.count(F.lit(1)).alias("_n"), F.sum("type").alias("_orders"), F.count("_h").alias("_hs"))
    sizes = found.select("graph", "size", F.explode("ring").alias("atom")).groupBy("graph", "atom").agg(F.array_sort(F.collect_list("size")).alias("ring_sizes"))
    out = atoms.join(sums, ["graph", "atom"], "left").join(sizes, ["graph", "atom"], "left").fillna(0, ["_n", "_orders", "_hs"])
    out = out.withColumns({c: (F.col(v) + F.col("n_h")).cast("int") for c, v in (("hydrogens", "_hs"), ("connections", "_n"), ("valence", "_orders"))})
    out = out.withColumn("ring_sizes", F.coalesce("ring_sizes", F.array().cast("array<int>"))).drop("_n", "_orders", "_hs")
    return out.withColumn("in_ring", F.size("ring_sizes") > 0)


def ring_counts(atoms: DataFrame, found: DataFrame) -> DataFrame:
    """(graph, n_rings, sizes) of every graph of atoms; sizes is the sorted array of its rings' sizes."""
    counts = found.groupBy("graph").agg(F.count(F.lit(1)).alias("n_rings"), F.array_sort(F.collect_list("size")).alias("sizes"))
    out = atoms.select("graph").distinct().join(counts, "graph", "left").fillna(0, ["n_rings"])
    return out.withColumn("sizes", F.coalesce("sizes", F.array().cast("array<int>")))


def ring_systems(found: DataFrame) -> DataFrame:
    """(graph, system, atoms): rings that share an atom are one system, named by its least atom; atoms sorted."""
    from corvane.operators.graph import components

    pairs = ring_edges(found).select("graph", "i", "j", F.lit(1).alias("type"))
    named = components(pairs)
    return named.groupBy("graph", F.col("component").alias("system")).agg(F.array_sort(F.collect_list("node")).alias("atoms"))


def smallest_ring(found: DataFrame) -> DataFrame:
    """(graph, i, j, size): the size of the smallest ring through each ring bond."""
    order = Window.partitionBy("graph", "i", "j").orderBy("size", "ring_id")
    return ring_edges(found).withColumn("_n", F.row_number().over(order)).where("_n = 1").select("graph", "i", "j", "size")
