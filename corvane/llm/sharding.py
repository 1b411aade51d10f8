"""Sharding by jump consistent hashing, in DataFrame functions only.

A shard is a function of the stable key and the number of shards. When a shard is appended, a key either stays or
moves into the new shard. The loop is the published one (Lamping and Veach, 2014): a 64-bit linear congruential
generator jumps forward from bucket to bucket, at most n_shards times. Spark's long arithmetic raises on overflow, so
the generator runs in decimal(38, 0), which holds the 126-bit product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import written

# Fixed values of the published generator.
MULTIPLIER = 2862933555777941757
TWO_31, TWO_33, TWO_64 = 2**31, 2**33, 2**64


def jump_shard(key: Column, n_shards: int) -> Column:
    """The shard of a long key among n_shards; a null key counts as key 0."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    big = lambda v: F.lit(str(v)).cast("decimal(20,0)")
    key = F.coalesce(key, F.lit(0)).cast("decimal(20,0)")
    start = F.struct(
        F.when(key < 0, key + big(TWO_64)).otherwise(key).cast("decimal(20,0)").alias("key"),
        F.lit(0).cast("long").alias("at"),
        F.lit(0).cast("long").alias("next"),
    )

    def jump(s: Column, _: Column) -> Column:
        key = ((s["key"] * F.lit(str(MULTIPLIER)).cast("decimal(19,0)") + big(1)) % big(TWO_64)).cast("decimal(20,0)")
        high = F.floor(key / big(TWO_33)).cast("double")
        after = F.floor((s["next"] + 1).cast("double") * (F.lit(float(TWO_31)) / (high + 1.0))).cast("long")
        more = s["next"] < n_shards
        return F.when(more, F.struct(key.alias("key"), s["next"].alias("at"), after.alias("next"))).otherwise(s)

    # Each jump goes forward, so n_shards of them are enough.
    return F.aggregate(F.sequence(F.lit(1), F.lit(n_shards)), start, jump, lambda s: s["at"].cast("int"))


def shard_documents(docs: DataFrame, n_shards: int = 8, rows_per_slice: int = 20_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shards, sizes and gapless slots of all rows.

    Returns key, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot, grown_shard (with one more shard). The key is
    hashed first, so runs of ids spread evenly. A null key is a key like any other; a null text has size 1 and the
    checksum of an empty text; repeated rows stay, each with a slot of its own.

    Slots take no window over a whole shard: rows are cut by hash into slices of about rows_per_slice, slices are
    counted and summed up, and each row is numbered in its slice only.
    """
    text_bytes = F.coalesce(F.col(text), F.lit("")).cast("binary")
    stable = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows = docs.select(
        F.col(key),
        (F.octet_length(text_bytes).cast("long") + 1).alias("size"),
        F.crc32(text_bytes).alias("text_crc32"),
        stable.alias("_stable"),
    )
    rows = written(
        rows.select(
            key, "size", "text_crc32",
            jump_shard(F.col("_stable"), n_shards).alias("shard"),
            jump_shard(F.col("_stable"), n_shards + 1).alias("grown_shard"),
            F.xxhash64("_stable", "text_crc32", "size").alias("_mix"),
        ),
        "sharded",
    )
    slices = max(1, -(-rows.count() // (rows_per_slice * n_shards)))
    rows = rows.withColumn("_slice", F.pmod("_mix", F.lit(slices)).cast("int"))
    before = Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("shard", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_slice").orderBy("_mix", key, "text_crc32")
    return (
        rows.withColumn("_at", F.row_number().over(within))
        .join(starts, ["shard", "_slice"])
        .select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_start") + F.col("_at") - 1).cast("long").alias("slot"), "grown_shard")
    )
