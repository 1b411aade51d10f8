"""Data-set filters: named conditions that all must hold, and what each of them drops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_failed(conditions: dict[str, Column]) -> Column:
    """Row: the name of the first condition that doesn't hold, null where all do; a null condition doesn't hold."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(conditions.items()):
        out = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return out


def kept(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Rows for which all conditions hold: plain predicates, so those on stored columns reach the scan."""
    for holds in conditions.values():
        rows = rows.where(holds)
    return rows


def drop_counts(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(reason, n): rows by the first condition that drops them; reason null counts the rows that stay."""
    return rows.select(first_failed(conditions).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def training_conditions(n_heavy: Column, n_confs: Column, most: int, least_confs: int = 2) -> dict[str, Column]:
    """Molecules to train on: not too many heavy atoms, and several conformers."""
    return {"too_large": n_heavy <= most, "too_few_conformers": n_confs >= least_confs}


def pocket_conditions(n_heavy: Column, has_hydrogens: Column, profile: Column, qed: Column, most: int, least_qed: float = 0.3) -> dict[str, Column]:
    """Complexes to train on: explicit hydrogens, size, a profile that was worked out, drug-likeness."""
    return {"no_hydrogens": has_hydrogens, "too_large": n_heavy <= most, "no_profile": profile.isNotNull(), "low_qed": qed >= least_qed}
