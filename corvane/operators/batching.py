"""Size-bucketed batches: membership, batch size by cost, batch numbers, replicas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import ragged
from corvane.session import bounded, settled


def bucket_cost(kind: str, limit: float) -> float:
    """Cost of one row of a bucket: constant, linear in its limit, or quadratic."""
    if kind == "constant":
        return 1.0
    if kind == "linear":
        return float(limit)
    if kind == "quadratic":
        return limit * limit / 256 + 1
    raise ValueError(f"unknown cost {kind}")


def batch_size(budget: float, cost: float, multiple_of_8: bool = False) -> int:
    """Rows of a batch: as many as the budget pays for, one at least; or the nearest multiple of eight."""
    if multiple_of_8:
        return max(8, 8 * round(budget / cost / 8))
    return max(1, int(budget // cost))


def bucket_of(length: Column, limits: list[int]) -> Column:
    """Place of the first limit that is at least length (limits ascending); null beyond the last."""
    out = F.lit(None).cast("int")
    for i in range(len(limits) - 1, -1, -1):
        out = F.when(length <= limits[i], i).otherwise(out)
    return out


def batches(
    rows: DataFrame, length: str, limits: list[int], budget: float, cost: str = "linear", order: list[Column] | None = None,
    by: list[str] | None = None, drop_last: bool = False, oversize: str = "error", replicas: int = 1,
) -> DataFrame:
    """rows with bucket, batch (within the bucket) and replica.

    oversize: what happens to rows beyond the last limit, error or drop. drop_last: incomplete batches go. Rows of
    several data sets are kept apart by the columns of by.
    """
    limits = sorted(limits)
    keys = [*(by or []), "bucket"]
    rows = rows.withColumn("bucket", bucket_of(F.col(length), limits))
    if oversize == "drop":
        rows = rows.where(F.col("bucket").isNotNull())
    elif oversize == "error":
        rows = rows.withColumn("bucket", F.coalesce("bucket", F.raise_error(F.concat(F.lit("longer than the last bucket: "), F.col(length).cast("string")))))
    else:
        raise ValueError("oversize is error or drop")
    sizes = F.array(*(F.lit(batch_size(budget, bucket_cost(cost, x))) for x in limits))
    size = F.get(sizes, F.col("bucket"))
    # Rows are numbered over all buckets in ranges of the order, and then within a bucket by the bucket's first number:
    # a bucket with a third of all rows is no single task.
    turns = {f"_order{i}": c for i, c in enumerate(order or [F.col(length)])}
    rows = numbered(rows.withColumns(turns), [*keys, *turns], "_row").drop(*turns)
    ends = settled(rows.groupBy(*keys).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_all")))
    ends = ends.withColumnsRenamed({c: f"_key_{c}" for c in keys})
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in keys))
    rows = rows.join(bounded(ends, ends.count()), same).withColumn("batch", F.floor((F.col("_row") - F.col("_first")) / size).cast("long"))
    if drop_last:
        rows = rows.where((F.col("batch") + 1) * size <= F.col("_all"))
    rows = rows.drop("_row", "_first", "_all", *(f"_key_{c}" for c in keys))
    return rows.withColumn("replica", F.pmod("batch", F.lit(replicas)).cast("int"))


def collated(rows: DataFrame, batch: list[str], arrays: dict[str, Column], length: str) -> DataFrame:
    """The padded export of batches: each array filled up to its batch's longest `length`, with width and mask.

    arrays: the fill of each array column; all arrays of a row are as long as its column `length` says.
    """
    widths = rows.groupBy(*batch).agg(F.max(length).cast("int").alias("width")).withColumnsRenamed({c: f"_{c}" for c in batch})
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in batch))
    out = rows.join(widths, same).drop(*(f"_{c}" for c in batch))
    out = out.withColumn("mask", ragged.mask(F.col(next(iter(arrays))), F.col("width")))
    return out.withColumns({c: ragged.pad(F.col(c), F.col("width"), fill) for c, fill in arrays.items()})


def concatenated(parts: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """UNION ALL of named parts with a global id: rows of a part follow those of the parts before it, each by its key.

    Within a part rows are numbered in slices of the key's order, so no part is numbered in a single task.
    """
    out = None
    for turn, (name, part) in enumerate(parts):
        named = part.withColumns({"dataset": F.lit(name), "_turn": F.lit(turn)})
        out = named if out is None else out.unionByName(named)
    return numbered(out, ["_turn", key], "global_id").drop("_turn")


def running(rows: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the sum of value over all rows before each, by order.

    Rows are dealt by ranges of the order and settled; a range's sum is one row, the sums before each range are added
    up, and the running sum is then taken within ranges only.
    """
    ranged = settled(rows.withColumn("_value", value).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_part").agg(F.sum("_value").alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = F.coalesce(F.sum("_value").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = ranged.withColumn("_at", within).join(F.broadcast(starts), "_part")  # one row for each range
    return out.withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start", "_value")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with a gapless number from 0 by order."""
    return running(rows, order, F.lit(1).cast("long"), name)
