"""Valences and Kekulé structures of many molecules: which bonds of an aromatic system are double, and what can't be.

atoms: (graph, atom, z, charge, n_h); n_h counts hydrogens that are no atoms of their own. bonds: (graph, i, j, type,
aromatic), each pair once; type is 1, 2 or 3 and counts for bonds that aren't aromatic.

An aromatic atom takes part in one double bond of its system or in none: it does where its valence has one left over its
single bonds. A structure is a matching of those atoms along the aromatic bonds that leaves none out. Systems are found
as connected components over all molecules; each is matched by itself, blossoms included, since fused odd rings are no
bipartite graphs.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.graph import alike, components, symmetric
from corvane.session import settled, shipped

# The valences that an element takes, by its atomic number. A charged atom has those of the element with
# as many electrons: N+ those of C, O- those of F.
VALENCES = {
    1: (1,), 5: (3,), 6: (4,), 7: (3,), 8: (2,), 9: (1,), 13: (3,), 14: (4,), 15: (3, 5, 7), 16: (2, 4, 6), 17: (1,),
    32: (4,), 33: (3, 5, 7), 34: (2, 4, 6), 35: (1,), 51: (3, 5, 7), 52: (2, 4, 6), 53: (1, 3, 5), 83: (3, 5, 7),
}


def allowed(z: Column, charge: Column) -> Column:
    """The valences of an atom, as an array; null for elements that aren't held to any."""
    table = F.create_map(*(F.lit(x) if isinstance(x, int) else F.array(*map(F.lit, x)) for kv in VALENCES.items() for x in kv))
    return F.try_element_at(table, z - charge)


def _sums(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """atoms with sigma (bonds and hydrogens), extra (orders beyond 1 of bonds that aren't aromatic) and in_system."""
    both = symmetric(bonds.withColumn("type", F.when(F.col("aromatic"), F.lit(0)).otherwise(F.col("type")))).where("i <> j")
    counts = both.groupBy("graph", F.col("i").alias("atom")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.greatest(F.col("type") - 1, F.lit(0))).alias("extra"), (F.count_if(F.col("type") == 0) > 0).alias("in_system")
    )
    out = atoms.join(counts, ["graph", "atom"], "left").fillna(0, ["_n", "extra"])
    return out.withColumns({"sigma": F.col("_n") + F.col("n_h"), "in_system": F.coalesce("in_system", F.lit(False))}).drop("_n")


def matching(near: list[list[int]]) -> list[int]:
    """The partner of each node, or -1, in a largest matching of a graph (Edmonds, 1965). Nodes are tried in order."""
    n = len(near)
    mate = [-1] * n
    for root in range(n):
        if mate[root] >= 0:
            continue
        parent, base, even = [-1] * n, list(range(n)), [False] * n
        even[root], queue, end = True, [root], -1
        while queue and end < 0:
            v = queue.pop(0)
            for u in near[v]:
                if base[v] == base[u] or mate[v] == u:
                    continue
                if u == root or (mate[u] >= 0 and parent[mate[u]] >= 0):
                    # An odd cycle: all of it becomes one node, named by where both ways to the root meet.
                    stem = _meeting(mate, parent, base, v, u)
                    inside = [False] * n
                    _mark(mate, parent, base, inside, v, stem, u)
                    _mark(mate, parent, base, inside, u, stem, v)
                    for w in range(n):
                        if inside[base[w]]:
                            base[w] = stem
                            if not even[w]:
                                even[w] = True
                                queue.append(w)
                elif parent[u] < 0:
                    parent[u] = v
                    if mate[u] < 0:
                        end = u
                        break
                    even[mate[u]] = True
                    queue.append(mate[u])
        while end >= 0:
            before = parent[end]
            after = mate[before]
            mate[end], mate[before], end = before, end, after
    return mate


def _meeting(mate: list[int], parent: list[int], base: list[int], a: int, b: int) -> int:
    seen = set()
    while True:
        a = base[a]
        seen.add(a)
        if mate[a] < 0:
            break
        a = parent[mate[a]]
    while base[b] not in seen:
        b = parent[mate[base[b]]]
    return base[b]


def _mark(mate: list[int], parent: list[int], base: list[int], inside: list[bool], v: int, stem: int, child: int) -> None:
    while base[v] != stem:
        inside[base[v]] = inside[base[mate[v]]] = True
        parent[v] = child
        child = mate[v]
        v = parent[mate[v]]


def kekulized(atoms: DataFrame, bonds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """bonds with the types 1 and 2 of a Kekulé structure in place of aromatic ones, and the systems that have none.

    The second table is (graph, system, atoms): the least atom of the system and those that no double bond reaches,
    though their valence asks for one. Bonds of such a system keep the matching's part. Of several structures the one
    that matching in the order of atoms finds counts.
    """
    sums = settled(_sums(atoms, bonds))
    left = F.exists(allowed(F.col("z"), F.col("charge")), lambda v: v > F.col("sigma") + F.col("extra"))
    aromatic = settled(bonds.where("aromatic").select("graph", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.lit(1).alias("type")).distinct())
    system = components(aromatic).withColumnRenamed("component", "system")
    open_ = sums.where("in_system").join(system.withColumnRenamed("node", "atom"), ["graph", "atom"]).where(F.coalesce(left, F.lit(False)))
    open_ = settled(open_.select("graph", "system", "atom"))
    ends = [open_.select("graph", F.col("atom").alias(side)) for side in ("i", "j")]
    links = aromatic.join(ends[0], ["graph", "i"], "left_semi").join(ends[1], ["graph", "j"], "left_semi")
    links = links.join(open_.select("graph", "system", F.col("atom").alias("i")), ["graph", "i"])
    links = links.groupBy("graph", "system").agg(F.sort_array(F.collect_list(F.struct("i", "j"))).alias("links"))
    rows = open_.groupBy("graph", "system").agg(F.sort_array(F.collect_list("atom")).alias("atoms")).join(links, ["graph", "system"], "left")
    types = dict(rows.dtypes)

    def run(batches):
        for batch in batches:
            doubles, alone = [], []
            for those, pairs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                place = {a: k for k, a in enumerate(those)}
                near: list[list[int]] = [[] for _ in those]
                for p in pairs or []:
                    near[place[p["i"]]].append(place[p["j"]])
                    near[place[p["j"]]].append(place[p["i"]])
                mate = matching(near)
                doubles.append([{"i": those[k], "j": those[m]} for k, m in enumerate(mate) if m > k])
                alone.append([those[k] for k, m in enumerate(mate) if m < 0])
            kind = batch.schema.field(2).type
            pair = pa.list_(pa.struct([("i", kind.value_type), ("j", kind.value_type)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(doubles, pair), pa.array(alone, kind)], names=["graph", "system", "doubles", "alone"])

    shipped(atoms.sparkSession)
    pair = f"array<struct<i:{types['system']},j:{types['system']}>>"
    found = settled(rows.mapInArrow(run, f"graph {types['graph']}, system {types['system']}, doubles {pair}, alone {types['atoms']}"))
    doubles = found.select("graph", F.explode("doubles").alias("e")).select("graph", F.col("e.i").alias("_i"), F.col("e.j").alias("_j"), F.lit(2).alias("_two"))
    doubles = doubles.withColumnRenamed("graph", "_graph")
    out = bonds.join(doubles, (F.col("graph") == F.col("_graph")) & (F.least("i", "j") == F.col("_i")) & (F.greatest("i", "j") == F.col("_j")), "left")
    out = out.withColumn("type", F.when(F.col("aromatic"), F.coalesce("_two", F.lit(1))).otherwise(F.col("type"))).drop("_graph", "_i", "_j", "_two")
    return out, found.where(F.size("alone") > 0).select("graph", "system", F.col("alone").alias("atoms"))


def valence_faults(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(graph, atom, valence, fault) of atoms whose bond orders and hydrogens add up to more than any of their valences.

    bonds: as kekulized() gives them. Elements without a table row are held to nothing.
    """
    plain = bonds.withColumn("aromatic", F.lit(False))
    sums = _sums(atoms, plain).withColumns({"valence": F.col("sigma") + F.col("extra"), "_most": F.array_max(allowed(F.col("z"), F.col("charge")))})
    fault = F.format_string("element %d with charge %d has valence %d, at most %d", "z", "charge", "valence", "_most")
    return sums.where(F.col("valence") > F.col("_most")).select("graph", "atom", F.col("valence").cast("int").alias("valence"), fault.alias("fault"))


def checked_molecules(atoms: DataFrame, bonds: DataFrame, connected: bool = True) -> DataFrame:
    """(graph, valid, fault) of every graph of atoms: the first fault of valences, Kekulé structures and, if asked, connection.

    Graphs that are the same, numbers included, are worked out once.
    """
    atoms, bonds, members = alike(atoms, bonds)
    structure, broken = kekulized(atoms, bonds)
    structure = settled(structure)
    wrong = valence_faults(atoms, structure).groupBy("graph").agg(F.min_by("fault", "atom").alias("_valence"))
    lost = broken.groupBy("graph").agg(F.format_string("no Kekulé structure for the aromatic system of atom %d", F.min("system")).alias("_kekule"))
    out = atoms.groupBy("graph").agg(F.count(F.lit(1)).alias("_n")).join(wrong, "graph", "left").join(lost, "graph", "left")
    faults = [F.col("_valence"), F.col("_kekule")]
    if connected:
        parts = components(bonds.select("graph", "i", "j", F.lit(1).alias("type"))).groupBy("graph").agg(F.count(F.lit(1)).alias("_tied"), F.count_distinct("component").alias("_parts"))
        out = out.join(parts, "graph", "left").fillna(0, ["_tied", "_parts"])
        # Atoms without a bond are parts of their own.
        pieces = F.col("_parts") + F.col("_n") - F.col("_tied")
        faults.append(F.when(pieces > 1, F.format_string("%d parts", pieces)))
    fault = F.coalesce(*faults)
    found = out.select(F.col("graph").alias("rep"), fault.isNull().alias("valid"), fault.alias("fault"))
    return members.join(found, "rep").select("graph", "valid", "fault")
