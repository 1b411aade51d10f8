"""Canonical ranks and keys of labelled graphs: equal keys exactly where graphs are the same but for the numbering of atoms.

Colours are refined over all graphs at once: an atom's colour takes in the sorted colours of its neighbours and the types
of the bonds to them, until no graph gets more colours. Where each atom has its own colour, that is its rank. Graphs
with ties (symmetric ones) are searched one by one: an atom of the first tied colour is singled out, colours are refined
again, and so on; of all ends the least list of bonds counts. Ends with equal lists are symmetries of the graph; atoms
that they carry into one another need no branch of their own.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.graph import alike, symmetric
from corvane.session import settled, shipped


def refined_colours(atoms: DataFrame, bonds: DataFrame, invariants: list[Column], most_rounds: int = 1000) -> DataFrame:
    """(graph, atom, colour): a long that tells atoms apart as far as invariants and refinement do, whatever the numbering."""
    both = settled(symmetric(bonds).where("i <> j").select("graph", "i", "j", "type"))
    state = settled(atoms.select("graph", "atom", F.xxhash64(*invariants).alias("colour")))
    before = _colours(state)
    for _ in range(most_rounds):
        told = both.join(state.select("graph", F.col("atom").alias("j"), "colour"), ["graph", "j"])
        told = told.groupBy("graph", F.col("i").alias("atom")).agg(F.array_sort(F.collect_list(F.struct("type", "colour"))).alias("_near"))
        new = state.join(told, ["graph", "atom"], "left")
        new = settled(new.select("graph", "atom", F.xxhash64("colour", "_near").alias("colour")))
        now = _colours(new)
        if now == before:
            return state
        state, before = new, now
    raise RuntimeError("colours did not settle")


def _colours(state: DataFrame) -> int:
    """The number of colours of all graphs together; refinement never lowers a graph's."""
    return state.select("graph", "colour").distinct().count()


def _refine(colours: list[int], near: list[dict[int, int]]) -> list[int]:
    """Ranks (from 0, equal where tied) of atoms by colour and their neighbours' colours, refined until nothing changes."""
    count = len(set(colours))
    while True:
        signs = [(c, sorted((t, colours[u]) for u, t in near[v].items())) for v, c in enumerate(colours)]
        order = {}
        for sign in sorted(signs):
            order.setdefault(str(sign), len(order))
        colours = [order[str(s)] for s in signs]
        if len(order) == count:
            return colours
        count = len(order)


def search(colours: list[int], near: list[dict[int, int]]) -> list[int]:
    """The canonical rank of each atom, all different, of a graph with refined or plain colours and bond types by neighbour."""
    best: list = [None, None]
    symmetries: list[list[int]] = []

    def visit(colours: list[int], fixed: tuple[int, ...]) -> None:
        colours = _refine(colours, near)
        cells: dict[int, list[int]] = {}
        for v, c in enumerate(colours):
            cells.setdefault(c, []).append(v)
        tied = min((c for c, those in cells.items() if len(those) > 1), default=None)
        if tied is None:
            bonds = sorted((min(colours[v], colours[u]), max(colours[v], colours[u]), t) for v, those in enumerate(near) for u, t in those.items() if v < u)
            if best[0] is None or bonds < best[0]:
                best[:] = [bonds, colours]
            elif bonds == best[0]:
                at = {c: v for v, c in enumerate(best[1])}
                symmetries.append([at[c] for c in colours])
            return
        done: list[int] = []
        for v in cells[tied]:
            if not _reached(done, v, [s for s in symmetries if all(s[x] == x for x in fixed)]):
                visit([2 * c + (u != v) if c == tied else 2 * c for u, c in enumerate(colours)], (*fixed, v))
            done.append(v)

    visit(colours, ())
    return best[1]


def _reached(done: list[int], v: int, symmetries: list[list[int]]) -> bool:
    """Do the symmetries carry an atom of done to v?"""
    seen, stack = {v}, [v]
    while stack:
        at = stack.pop()
        for s in symmetries:
            for to in (s[at], s.index(at)):
                if to not in seen:
                    seen.add(to)
                    stack.append(to)
    return any(x in seen for x in done)


def canonical_ranks(atoms: DataFrame, bonds: DataFrame, invariants: list[Column]) -> DataFrame:
    """(graph, atom, rank): ranks from 0, all different in a graph; renumbering a graph's atoms carries them along, but for symmetries.

    atoms: (graph, atom, columns of invariants), bonds: (graph, i, j, type), each pair once. A graph that refinement
    leaves with ties is one task's row: its atoms are those of one molecule.
    """
    colours = refined_colours(atoms, bonds, invariants)
    ranked = settled(colours.withColumn("rank", (F.dense_rank().over(Window.partitionBy("graph").orderBy("colour")) - 1).cast("int")))
    tied = ranked.groupBy("graph").agg(F.count(F.lit(1)).alias("_n"), F.max("rank").alias("_m")).where("_m < _n - 1").select("graph")
    tied = settled(tied)
    some = ranked.join(tied, "graph", "left_semi").groupBy("graph").agg(F.sort_array(F.collect_list(F.struct("atom", "rank"))).alias("atoms"))
    pairs = bonds.where("i <> j").join(tied, "graph", "left_semi").groupBy("graph").agg(F.collect_list(F.struct("i", "j", "type")).alias("bonds"))
    atom = atoms.schema["atom"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            graphs, numbers, ranks = [], [], []
            for at, (those, links) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                place = {a["atom"]: k for k, a in enumerate(those)}
                near: list[dict[int, int]] = [{} for _ in those]
                for b in links or []:
                    near[place[b["i"]]][place[b["j"]]] = near[place[b["j"]]][place[b["i"]]] = b["type"]
                graphs += [at] * len(those)
                numbers += [a["atom"] for a in those]
                ranks += search([a["rank"] for a in those], near)
            kind = batch.schema.field(1).type.value_type.field("atom").type
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(graphs, pa.int64())), pa.array(numbers, kind), pa.array(ranks, pa.int32())], names=["graph", "atom", "rank"])

    shipped(atoms.sparkSession)
    graph = atoms.schema["graph"].dataType.simpleString()
    searched = some.join(pairs, "graph", "left").mapInArrow(run, f"graph {graph}, atom {atom}, rank int")
    return ranked.join(tied, "graph", "left_anti").select("graph", "atom", "rank").union(searched)


def canonical_keys(atoms: DataFrame, bonds: DataFrame, invariants: list[Column]) -> DataFrame:
    """(graph, key): SHA-256 of the graph written by canonical ranks; equal exactly for graphs that differ by numbering alone.

    Graphs that are the same, numbers included, are worked out once.
    """
    atoms, bonds, members = alike(atoms, bonds)
    ranks = settled(canonical_ranks(atoms, bonds, invariants))
    labels = atoms.select("graph", "atom", F.array(*(v.cast("string") for v in invariants)).alias("_v")).join(ranks, ["graph", "atom"])
    labels = labels.groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("rank", "_v"))).alias("_atoms"))
    side = lambda end, name: ranks.select("graph", F.col("atom").alias(end), F.col("rank").alias(name))
    links = bonds.where("i <> j").select("graph", "i", "j", "type").join(side("i", "_a"), ["graph", "i"]).join(side("j", "_b"), ["graph", "j"])
    links = links.select("graph", F.struct(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "type").alias("_l"))
    links = links.groupBy("graph").agg(F.array_sort(F.collect_set("_l")).alias("_bonds"))
    text = F.to_json(F.struct("_atoms", "_bonds"))
    keys = labels.join(links, "graph", "left").select(F.col("graph").alias("rep"), F.sha2(text, 256).alias("key"))
    return members.join(keys, "rep").select("graph", "key")
