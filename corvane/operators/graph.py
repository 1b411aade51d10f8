"""Bond-graph operators: clean edge lists, adjacency, degrees, random-walk powers, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import settled


def cleaned(edges: DataFrame) -> DataFrame:
    """Distinct (graph, i, j, type) with i <= j, without type 0; other columns go."""
    return edges.where(F.col("type") != 0).select("graph", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "type").distinct()


def conflicts(edges: DataFrame) -> DataFrame:
    """(graph, i, j, n_types) of pairs of a cleaned list that have more than one type."""
    return edges.groupBy("graph", "i", "j").agg(F.count(F.lit(1)).alias("n_types")).where("n_types > 1")


def checked(edges: DataFrame) -> DataFrame:
    """A cleaned list whose conflicts are an error when it is read."""
    one = edges.groupBy("graph", "i", "j").agg(F.count(F.lit(1)).alias("_n"), F.first("type").alias("type"))
    problem = F.raise_error(F.concat_ws(" ", F.lit("more than one type for bond"), F.col("i").cast("string"), F.col("j").cast("string")))
    return one.withColumn("type", F.when(F.col("_n") > 1, problem).otherwise(F.col("type"))).drop("_n")


def alike(atoms: DataFrame, bonds: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(atoms, bonds, members): of graphs that are the same, numbers and all columns included, only one is left; members is (graph, rep).

    What follows from a graph's rows alone can be worked out for rep and joined back to its members.
    """
    rows = lambda frame, name: frame.groupBy("graph").agg(F.sort_array(F.collect_list(F.struct(*(c for c in frame.columns if c != "graph")))).alias(name))
    digest = F.sha2(F.to_json(F.struct("_atoms", "_bonds")), 256)
    each = settled(rows(atoms, "_atoms").join(rows(bonds, "_bonds").hint("merge"), "graph", "full").select("graph", digest.alias("_same")))
    reps = settled(each.groupBy("_same").agg(F.min("graph").alias("rep")))
    some = reps.select(F.col("rep").alias("graph"))
    members = settled(each.join(reps, "_same").select("graph", "rep"))
    return settled(atoms.join(some, "graph", "left_semi")), settled(bonds.join(some, "graph", "left_semi")), members


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of each edge; a loop once."""
    back = edges.where("i <> j").select("graph", F.col("j").alias("i"), F.col("i").alias("j"), "type")
    return edges.select("graph", "i", "j", "type").unionByName(back)


def degrees(edges: DataFrame) -> DataFrame:
    return symmetric(edges).groupBy("graph", F.col("i").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def from_adjacency(rows: DataFrame, matrix: str) -> DataFrame:
    """(graph, i, j, type): the strict upper triangle of a dense array of arrays, zeros left out."""
    cells = rows.select("graph", F.posexplode(matrix).alias("i", "_row")).select("graph", "i", F.posexplode("_row").alias("j", "type"))
    return cells.where("i < j and type <> 0")


def connected_mask(rows: DataFrame, present: str, loops: bool = True) -> DataFrame:
    """(graph, i, j): all pairs of nodes whose flag in the array `present` is set."""
    cells = rows.select("graph", F.posexplode(present).alias("i", "_a"), present).where("_a = 1")
    cells = cells.select("graph", "i", F.posexplode(present).alias("j", "_b")).where("_b = 1")
    return (cells if loops else cells.where("i <> j")).select("graph", "i", "j")


def random_walks(edges: DataFrame, steps: int) -> DataFrame:
    """(graph, step, i, j, p): powers 1..steps of the column-normalised adjacency with self loops, zeros left out."""
    both = symmetric(edges).where("i <> j").select("graph", "i", "j").distinct()
    nodes = both.select("graph", "i").distinct()
    whole = both.unionByName(nodes.select("graph", "i", F.col("i").alias("j")))
    size = whole.groupBy("graph", "j").agg(F.count(F.lit(1)).alias("_d"))
    one = whole.join(size, ["graph", "j"]).select("graph", "i", "j", (1 / F.col("_d")).alias("p"))
    # Each power is settled: the next one and the result both read it.
    one = settled(one)
    power, out = one, one.withColumn("step", F.lit(1))
    right = one.select("graph", F.col("i").alias("m"), F.col("j"), F.col("p").alias("q"))
    for k in range(2, steps + 1):
        left = power.select("graph", "i", F.col("j").alias("m"), "p")
        power = settled(left.join(right, ["graph", "m"]).groupBy("graph", "i", "j").agg(F.sum(F.col("p") * F.col("q")).alias("p")))
        out = out.unionByName(power.withColumn("step", F.lit(k)))
    return out.select("graph", "step", "i", "j", "p")


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(graph, node, component): the least node of each node's component.

    Labels spread to neighbours and jump to their label's label, round by round; each round is settled.
    """
    both = symmetric(edges).where("i <> j").select("graph", F.col("i").alias("a"), F.col("j").alias("b")).distinct()
    labels = edges.select("graph", F.explode(F.array("i", "j")).alias("node")).distinct().withColumn("label", F.col("node"))
    both, labels = settled(both), settled(labels)
    before = None
    for _ in range(most_rounds):
        told = both.join(labels, (both["graph"] == labels["graph"]) & (both["a"] == labels["node"])).select(both["graph"], F.col("b").alias("node"), "label")
        spread = labels.unionByName(told).groupBy("graph", "node").agg(F.min("label").alias("label"))
        jump = spread.select("graph", F.col("node").alias("label"), F.col("label").alias("_next"))
        labels = settled(spread.join(jump, ["graph", "label"]).select("graph", "node", F.least("label", "_next").alias("label")))
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return labels.withColumnRenamed("label", "component")
        before = now
    raise RuntimeError("labels did not settle")
