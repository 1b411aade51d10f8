"""Evaluation metrics as aggregate Columns, all of sums and counts but for distinct ones, and a registry of users' own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(v: Column) -> Column:
    """v where it is a finite number, else null; NaN counts as none."""
    v = v.cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v)


def validity(valid: Column) -> Column:
    """Share of valid rows; nulls count as invalid ones."""
    return F.count_if(F.coalesce(valid, F.lit(False))) / F.count(F.lit(1))


def uniqueness(key: Column) -> Column:
    """Distinct keys over keys; nulls count nowhere."""
    return F.count_distinct(key) / F.count(key)


def novelty(known: Column, key: Column) -> Column:
    """Share of non-null keys that aren't known."""
    return F.count_if(key.isNotNull() & ~F.coalesce(known, F.lit(False))) / F.count(key)


def reconstruction(generated: Column, reference: Column) -> Column:
    """Share of equal pairs among those where both exist."""
    return F.avg((generated == reference).cast("int"))


def mean_of_valid(v: Column, empty: float | None = None) -> Column:
    """Mean of the finite values; `empty` where there are none."""
    mean = F.avg(finite(v))
    return mean if empty is None else F.coalesce(mean, F.lit(empty))


def all_checks(checks: list[Column]) -> Column:
    """Row: do all checks hold? A check that wasn't made holds."""
    out = F.lit(True)
    for c in checks:
        out = out & F.coalesce(c, F.lit(True))
    return out


def share_at_most(v: Column, most: float) -> Column:
    return F.avg((finite(v) <= most).cast("int"))


def tanimoto(a: Column, b: Column) -> Column:
    """Row: common over united members of two arrays as sets; null where both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def bit_tanimoto(a: Column, b: Column) -> Column:
    """Row: the same of two bit sets held as arrays of longs."""
    bits = lambda f: F.aggregate(F.zip_with(a, b, f), F.lit(0), lambda s, v: s + F.bit_count(v))
    return F.try_divide(bits(lambda x, y: x.bitwiseAND(y)), bits(lambda x, y: x.bitwiseOR(y)))


#: Strain in hartree to kcal/mol.
HARTREE = 627.509


def mean_strain(v: Column, from_hartree: bool = False) -> Column:
    return F.avg(finite(v) * (HARTREE if from_hartree else 1.0))


def macro_mean(rows: DataFrame, by: str, v: str, least: int = 1) -> DataFrame:
    """(n, macro): mean over groups of each group's mean, groups of under `least` values left out."""
    groups = rows.groupBy(by).agg(F.avg(finite(F.col(v))).alias("m"), F.count(finite(F.col(v))).alias("n")).where(F.col("n") >= least)
    return groups.agg(F.count(F.lit(1)).alias("n"), F.avg("m").alias("macro"))


def size_report(size: Column, large: int = 48) -> list[Column]:
    """Aggregates mean, median, population deviation, least, most, share of `large` or more."""
    return [
        F.avg(size).alias("mean"), F.percentile(size.cast("double"), F.lit(0.5)).alias("median"), F.stddev_pop(size).alias("std"),
        F.min(size).alias("least"), F.max(size).alias("most"), F.avg((size >= large).cast("int")).alias("share_large"),
    ]


REGISTRY: dict[str, Callable[..., Column]] = {
    "validity": validity, "uniqueness": uniqueness, "novelty": novelty, "reconstruction": reconstruction,
    "mean": mean_of_valid, "share_at_most": share_at_most, "mean_strain": mean_strain,
}


def register_metric(name: str, aggregate: Callable[..., Column]) -> None:
    """Adds a user's aggregate; a name in use is an error."""
    if name in REGISTRY:
        raise ValueError(f"metric {name} exists")
    REGISTRY[name] = aggregate


def evaluate(rows: DataFrame, metrics: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """All metrics in one aggregation, whole or by group."""
    columns = [c.alias(k) for k, c in metrics.items()]
    return rows.groupBy(*by).agg(*columns) if by else rows.agg(*columns)


def per_row_and_total(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """(key, name, n): the value of each row and, with a null key, the mean of all. One scan by grouping sets."""
    named = rows.select(F.col(key), value.alias("_v"))
    grouped = named.groupingSets([[F.col(key)], []], F.col(key)).agg(F.avg("_v").alias(name), F.count("_v").alias("n"), F.grouping(key).alias("is_total"))
    return grouped
