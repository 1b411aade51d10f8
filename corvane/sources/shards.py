"""Sharded Parquet tables: numbered shards in order, the first n shards, errors instead of overwriting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.batching import numbered

SHARD = 20_000


def save(rows: DataFrame, path: str, order: list[str], shard_size: int = SHARD) -> None:
    """Writes rows with pos (0, 1, ... by order) under shard=<k>, k = pos // shard_size; an existing path is an error."""
    placed = numbered(rows, order, "pos").withColumn("shard", F.floor(F.col("pos") / shard_size).cast("int"))
    placed.repartition("shard").sortWithinPartitions("pos").write.mode("errorifexists").partitionBy("shard").parquet(path)


def load(spark: SparkSession, path: str, n_shards: int | None = None) -> DataFrame:
    """The table, or its first n_shards shards: whole partitions are skipped. Order is in shard and pos."""
    rows = spark.read.parquet(path)
    return rows if n_shards is None else rows.where(F.col("shard") < n_shards)


def ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy("shard", "pos")


def complexes(proteins: DataFrame, ligands: DataFrame, interactions: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """One row per complex_id of proteins, ligands, interactions (nullable) and meta, joined by complex_id.

    Each side's columns but complex_id become a struct; sides with a missing complex are an inner join's loss but for
    interactions and meta, which stay null.
    """
    nested = lambda d, name: d.select("complex_id", F.struct(*(c for c in d.columns if c != "complex_id")).alias(name))
    out = nested(proteins, "protein").join(nested(ligands, "ligand"), "complex_id")
    found = interactions.groupBy("complex_id").agg(F.sort_array(F.collect_list(F.struct("ord", "p_atoms", "l_atoms", "type"))).alias("interactions"))
    out = out.join(found, "complex_id", "left")
    return out if meta is None else out.join(nested(meta, "meta"), "complex_id", "left")
