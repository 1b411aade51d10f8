"""The dictionaries that queries register in, and what they share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.flow import normalised
from corvane.functions.geom import points_of
from corvane.session import shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Atoms of a conformer: the first 63 numbers of an embedding; the 64th is its energy.
ATOMS = 21


def query(oracle: str | None = None) -> Callable:
    """Registers a query under its function's name, with its DuckDB oracle where SQL can express it."""

    def keep(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return keep


def conformers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as conformers: vec_id, mol (label), xyz, energy."""
    flat = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("mol"), points_of(flat, ATOMS).alias("xyz"), F.get(flat, F.lit(63)).alias("energy"))


def distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as probabilities: vec_id, p = softmax of the 64 numbers."""
    raw = F.transform("embedding", lambda v: F.exp(v.cast("double")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", raw.alias("e"))
    return rows.select("vec_id", normalised(F.col("e")).alias("p"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for queries that write and read again."""
    return f"{shared_folder(spark)}/corvane-scratch/{name}-{uuid.uuid4().hex}"


def r(c: Column, digits: int = 6) -> Column:
    """Rounded, with no negative zero."""
    return F.round(c, digits) + F.lit(0.0)


#: DuckDB: the conformers' atoms, one row each.
PTS = """pts AS (
  SELECT vec_id, label AS mol, i AS atom, embedding[3*i+1]::DOUBLE AS x, embedding[3*i+2]::DOUBLE AS y,
         embedding[3*i+3]::DOUBLE AS z FROM embeddings, range(21) t(i)
)"""
#: DuckDB: softmax of each embedding, one row for each entry.
PROBS = """probs AS (
  SELECT vec_id, i, exp(embedding[i+1]::DOUBLE) / sum(exp(embedding[i+1]::DOUBLE)) OVER (PARTITION BY vec_id) AS p
  FROM embeddings, range(64) t(i)
)"""
