"""Conformer-ensemble operators: weights, entropy, ranks, samples, strain, deduplication."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.flow import hash_uniform
from corvane.functions.geom import aligned_rmsd
from corvane.operators.kernels import run_kernel
from corvane.session import settled, shipped

#: Boltzmann's constant in kcal / (mol K).
BOLTZMANN = 0.001987


def boltzmann_weights(rows: DataFrame, by: list[str], energy: str, temperature: float = 300.0) -> DataFrame:
    """rows with weight exp(-(E - least E) / kT), summing to one in each group; null energies get none."""
    group = Window.partitionBy(*by)
    raw = F.exp(-(F.col(energy) - F.min(energy).over(group)) / (BOLTZMANN * temperature))
    rows = rows.withColumn("_raw", raw)
    return rows.withColumn("weight", F.col("_raw") / F.sum("_raw").over(group)).drop("_raw")


def entropy(weight: Column, eps: float = 1e-10) -> Column:
    """Aggregate: -sum w ln w over weights of eps or more, which aren't normalised again."""
    return F.coalesce(-F.sum(F.when(weight >= eps, weight * F.ln(weight))), F.lit(0.0))


def top_k(rows: DataFrame, by: list[str], k: int, order: list[Column]) -> DataFrame:
    """The first k rows of each group by order, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def percentile_rows(rows: DataFrame, by: list[str], order: list[Column], low: float, high: float) -> DataFrame:
    """The rows at the nearest ranks low and high of each group, as label low or high.

    The rank is p (n - 1), half to even. Groups of under two rows and those where both ranks are one go.
    """
    group = Window.partitionBy(*by)
    ranked = rows.withColumns({"rank": F.row_number().over(group.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(group)})
    at = lambda p: F.bround(F.lit(p) * (F.col("_n") - 1)).cast("int")
    ranked = ranked.withColumns({"_low": at(low), "_high": at(high)}).where((F.col("_n") >= 2) & (F.col("_low") != F.col("_high")))
    label = F.when(F.col("rank") == F.col("_low"), "low").when(F.col("rank") == F.col("_high"), "high")
    return ranked.withColumn("label", label).where(F.col("label").isNotNull()).drop("_n", "_low", "_high")


def within_strain(rows: DataFrame, by: list[str], energy: str, most: float = 6.0) -> DataFrame:
    """Rows whose energy is at most `most` above their group's least, with strain; null energies go."""
    rows = rows.where(F.col(energy).isNotNull())
    rows = rows.withColumn("strain", F.col(energy) - F.min(energy).over(Window.partitionBy(*by)))
    return rows.where(F.col("strain") <= most)


def weighted_sample(rows: DataFrame, by: list[str], weight: str, order: list[str], draws: int, seed: int) -> DataFrame:
    """draws rows of each group, with replacement, proportional to weight: the inverse of the cumulative weight.

    Draws are laid between the rows on the line of cumulative weights, and each takes the last row before it: one sorted
    pass over rows and draws instead of a row for each pair of them. Rows of weight 0 are never drawn.
    """
    group = Window.partitionBy(*by)
    there = rows.where(F.col(weight) > 0)
    start = F.sum(weight).over(group.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(weight)
    laid = there.select(*by, start.cast("double").alias("_at"), F.struct(*rows.columns).alias("_row"), F.lit(None).cast("int").alias("draw"))
    draw = there.groupBy(*by).agg(F.sum(weight).alias("_all")).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    at = hash_uniform(*(F.col(c) for c in by), F.col("draw"), seed=seed) * F.col("_all")
    draw = draw.select(*by, at.cast("double").alias("_at"), F.lit(None).cast(laid.schema["_row"].dataType).alias("_row"), "draw")
    before = group.orderBy("_at", F.col("draw").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = laid.unionByName(draw).withColumn("_row", F.last("_row", ignorenulls=True).over(before))
    return out.where("draw is not null").select("_row.*", "draw")


def uniform_sample(rows: DataFrame, by: list[str], order: list[str], draws: int, seed: int) -> DataFrame:
    """draws rows of each group, with replacement, all alike."""
    return weighted_sample(rows.withColumn("_one", F.lit(1.0)), by, "_one", order, draws, seed).drop("_one")


def pairwise_rmsd(rows: DataFrame, by: str, id: str, points: str, most_pairs: int = 200, seed: int = 0) -> DataFrame:
    """(by, mean_rmsd, n_pairs): the mean aligned RMSD over a group's pairs, at most most_pairs of them.

    The pairs i < j of a group's ranks are numbered j (j - 1) / 2 + i. Of more than most_pairs, the numbers are cut into
    so many even runs and one is drawn by hash from each, then decoded: only the drawn pairs are ever made.
    """
    ids = rows.select(by, id).withColumn("_i", F.row_number().over(Window.partitionBy(by).orderBy(id)) - 1)
    sized = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").withColumn("_all", F.expr("_n * (_n - 1) div 2"))
    sized = sized.withColumn("_draws", F.least(F.col("_all"), F.lit(most_pairs)))
    drawn = sized.withColumn("_t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_draws") - 1)))
    drawn = drawn.withColumns({"_low": F.expr("_t * _all div _draws"), "_high": F.expr("(_t + 1) * _all div _draws")})
    u = hash_uniform(F.col(by), F.col("_t"), seed=seed)
    drawn = drawn.withColumn("_m", F.col("_low") + F.floor(u * (F.col("_high") - F.col("_low"))))
    guess = F.floor((1 + F.sqrt(1 + 8 * F.col("_m").cast("double"))) / 2).cast("long")
    drawn = drawn.withColumn("_j", guess).withColumn("_j", F.expr("_j - if(_j * (_j - 1) div 2 > _m, 1, 0)"))
    drawn = drawn.select(by, "_j", F.expr("_m - _j * (_j - 1) div 2").alias("_i"))
    side = lambda a, at: rows.join(ids, [by, id]).select(F.col(by), F.col("_i").alias(at), F.col(points).alias(a))
    pairs = drawn.join(side("a_xyz", "_i"), [by, "_i"]).join(side("b_xyz", "_j"), [by, "_j"])
    return pairs.groupBy(by).agg(F.avg(aligned_rmsd(F.col("a_xyz"), F.col("b_xyz"))).alias("mean_rmsd"), F.count(F.lit(1)).alias("n_pairs"))


def _clouds(frame: pd.DataFrame) -> np.ndarray:
    return np.array([[(p["x"], p["y"], p["z"]) for p in row] for row in frame["xyz"]], float).reshape(len(frame), -1, 3)


def kabsch(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """b turned onto a; both are centred point clouds."""
    u, _, vt = np.linalg.svd(b.T @ a)
    sign = np.sign(np.linalg.det(u @ vt))
    return b @ (u @ np.diag([1, 1, sign]) @ vt)


def least_rmsd(clouds: np.ndarray, one: np.ndarray) -> np.ndarray:
    """RMSD of one centred cloud to each of many after the best rotation, from the singular values of their products."""
    products = np.einsum("kni,nj->kij", clouds, one)
    s = np.linalg.svd(products, compute_uv=False)
    s[:, 2] *= np.sign(np.linalg.det(products))
    squares = (clouds**2).sum((1, 2)) + (one**2).sum() - 2 * s.sum(1)
    return np.sqrt(np.maximum(squares, 0) / len(one))


def rmsf(rows: DataFrame, by: str, id: str, n_refs: int = 1) -> DataFrame:
    """(by, rmsf): mean over atoms of each atom's fluctuation round its mean, all conformers aligned to a reference.

    The first n_refs conformers by id serve as references in turn, and the mean over them is taken. Groups of one
    conformer get 0. Rows: by, id, xyz (array of points). One ensemble is one task's work.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(id)
        clouds = _clouds(frame)
        clouds -= clouds.mean(1, keepdims=True)
        found = []
        for r in range(min(n_refs, len(clouds))):
            turned = np.stack([c if i == r else kabsch(clouds[r], c) for i, c in enumerate(clouds)])
            off = turned - turned.mean(0)
            found.append(np.sqrt((off**2).sum(2).mean(0)).mean())
        return pd.DataFrame({by: [frame[by].iloc[0]], "rmsf": [float(np.mean(found)) if len(clouds) > 1 else 0.0]})

    shipped(rows.sparkSession)
    return rows.select(by, id, "xyz").groupBy(by).applyInPandas(run, f"{by} {dict(rows.dtypes)[by]}, rmsf double")


def distinct_conformers(rows: DataFrame, by: str, id: str, least: float = 0.5) -> DataFrame:
    """(by, id) of conformers kept in the order of id: those at least `least` RMSD from every one kept before."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(id)
        clouds = _clouds(frame)
        clouds -= clouds.mean(1, keepdims=True)
        kept: list[int] = []
        for i, c in enumerate(clouds):
            if not kept or least_rmsd(clouds[kept], c).min() >= least:
                kept.append(i)
        return frame[[by, id]].iloc[kept]

    shipped(rows.sparkSession)
    types = dict(rows.dtypes)
    return rows.select(by, id, "xyz").groupBy(by).applyInPandas(run, f"{by} {types[by]}, {id} {types[id]}")


def sample_ensemble(rows: DataFrame, by: str, id: str, dedup: float | None = 0.5, strain: float = 6.0, temperature: float = 300.0) -> DataFrame:
    """The whole chain from molecules to a weighted ensemble: by, id, xyz, energy, strain, weight.

    Conformers come from the registered kernel `embed` and are relaxed by `mmff`; rows that already hold xyz and energy
    pass these steps as they are. Then conformers within `dedup` of an earlier one go (None: all stay), those without an
    energy, and those too strained; Boltzmann weights are of what is left.
    """
    found = run_kernel("mmff", run_kernel("embed", rows, "xyz"), "energy")
    if dedup is not None:
        found = settled(found)
        found = found.join(distinct_conformers(found, by, id, dedup), [by, id], "left_semi")
    return boltzmann_weights(within_strain(found, [by], "energy", strain), [by], "energy", temperature)


#: Outcomes of raw conformers, in the order in which they are tried.
OUTCOMES = ("missing", "low", "invalid", "reference", "match", "mismatch")


def conformer_outcomes(rows: DataFrame, by: str, order: str, weight: str, valid: str, identity: list[str], cutoff: float = 0.0) -> DataFrame:
    """rows with outcome: exactly one of OUTCOMES. The first valid one is the reference, whose identity the rest must equal."""
    group = Window.partitionBy(by).orderBy(order)
    usable = F.col(weight).isNotNull() & (F.col(weight) > cutoff) & F.coalesce(F.col(valid), F.lit(False))
    same = F.struct(*identity)
    rows = rows.withColumns({"_turn": F.sum(usable.cast("int")).over(group.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    reference = F.first(F.when(usable, same), ignorenulls=True).over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("_reference", reference)
    outcome = (
        F.when(F.col(weight).isNull(), "missing")
        .when(F.col(weight) <= cutoff, "low")
        .when(~F.coalesce(F.col(valid), F.lit(False)), "invalid")
        .when(F.col("_turn") == 1, "reference")
        .when(same == F.col("_reference"), "match")
        .otherwise("mismatch")
    )
    return rows.withColumn("outcome", outcome).drop("_turn", "_reference")


def drop_report(rows: DataFrame, by: str) -> DataFrame:
    """Counts of each outcome: over all groups, and over the groups of which nothing is kept (as `in_dropped`)."""
    kept = F.sum(F.col("outcome").isin("reference", "match").cast("int")).over(Window.partitionBy(by))
    return (
        rows.withColumn("_kept", kept)
        .groupBy("outcome")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("_kept") == 0).alias("in_dropped"))
    )
