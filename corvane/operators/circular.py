"""Circular fingerprints: identifiers of each atom's surroundings, grown bond by bond over the edge table (Rogers and Hahn, 2010).

An atom's first identifier comes from its own invariants. In each round it takes in those of its neighbours with the
types of the bonds to them, by a sum, so that the numbering of atoms plays no part. Surroundings that cover the same
bonds as earlier ones (or, in one round, as one with a lesser identifier) are left out. Identifiers are numbers under
2^31 - 1, folded to bits by their remainder. All is integer arithmetic, the same in SQL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.graph import symmetric
from corvane.session import settled

#: Identifiers are below this prime.
PRIME = 2147483647
#: The product of a square below PRIME and this, and the sum with the second, stay far below 2^63.
FACTOR, SHIFT = 48271, 12820163


def mixed(x: Column) -> Column:
    """A number below PRIME of a long of 0 or more: its square, spread."""
    y = x % PRIME
    return (((y * y) % PRIME) * FACTOR + SHIFT) % PRIME


def mixed_sql(x: str) -> str:
    """mixed() as SQL over a 64-bit expression."""
    return f"(((({x}) % {PRIME}) * (({x}) % {PRIME})) % {PRIME} * {FACTOR} + {SHIFT}) % {PRIME}"


def first_identifier(invariants: list[Column]) -> Column:
    return reduce(lambda h, v: mixed(h * 31 + v.cast("long") + 1000), invariants, F.lit(17).cast("long"))


def circular_features(atoms: DataFrame, bonds: DataFrame, invariants: list[Column], radius: int = 2) -> DataFrame:
    """(graph, atom, radius, identifier): what the surroundings of each atom up to `radius` bonds give, each cover of bonds once.

    invariants: whole numbers from -999 up that describe an atom whatever its number (element, charge, hydrogens, degree,
    rings). bonds: each pair once; type is a whole number of 0 or more. At radius 0 every atom counts.
    """
    both = symmetric(bonds).where("i <> j").select("graph", "i", "j", F.col("type").cast("long").alias("type"))
    both = settled(both)
    none = F.array().cast("array<struct<i:bigint,j:bigint>>")
    state = settled(atoms.select("graph", F.col("atom").cast("long").alias("atom"), first_identifier(invariants).alias("identifier"), none.alias("cover")))
    layers = [state.withColumn("radius", F.lit(0))]
    bond = F.struct(F.least("i", "j").cast("long").alias("i"), F.greatest("i", "j").cast("long").alias("j"))
    for k in range(1, radius + 1):
        told = both.join(state.select("graph", F.col("atom").alias("j"), "identifier", "cover"), ["graph", "j"])
        told = told.groupBy("graph", F.col("i").cast("long").alias("atom")).agg(
            F.sum(mixed(F.col("identifier") * 8 + F.col("type"))).alias("_sum"), F.flatten(F.collect_list("cover")).alias("_covers"), F.collect_list(bond).alias("_own")
        )
        grown = state.join(told, ["graph", "atom"])
        cover = F.array_sort(F.array_distinct(F.concat("cover", "_covers", "_own")))
        state = grown.select("graph", "atom", mixed(F.col("identifier") * 3 + mixed(F.col("_sum") + k)).alias("identifier"), cover.alias("cover"))
        state = settled(state)
        layers.append(state.withColumn("radius", F.lit(k)))
    first = F.min(F.struct("radius", "identifier", "atom")).alias("_f")
    wider = reduce(DataFrame.unionByName, layers[1:], layers[0].where("false")).groupBy("graph", "cover").agg(first)
    wider = wider.select("graph", "_f.atom", "_f.radius", "_f.identifier")
    return layers[0].select("graph", "atom", "radius", "identifier").union(wider)


def folded(features: DataFrame, bits: int = 2048) -> DataFrame:
    """(graph, bits): the sorted bits, from 0, that a graph's features set."""
    return features.groupBy("graph").agg(F.array_sort(F.collect_set(F.pmod("identifier", F.lit(bits)))).alias("bits"))
