"""Mining of partner pairs through shared witnesses.

scores: sparse rows (i, k, compact, extended, ecfp) of test item i against witness k, absent where not computed.
sizes: (i, size). A pair (i, j) is considered where sizes differ by at most tol and i <> j. Filters on each side run
before the join on the witness, so that only scores that can matter meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.batching import numbered
from corvane.session import settled


def _side(scores: DataFrame, sizes: DataFrame, name: str, value: str, item: str) -> DataFrame:
    return scores.join(sizes, "i").select(F.col("i").alias(item), "k", F.col(value).alias(name), F.col("size").alias(f"{item}_size"))


def _met(a: DataFrame, b: DataFrame, tol: int) -> DataFrame:
    """Rows of a and b with a common witness and sizes in the band: joined on witness and size, so that a popular witness meets by size."""
    sized = a.withColumn("_at", F.explode(F.sequence(F.col("i_size") - tol, F.col("i_size") + tol)))
    return sized.join(b.withColumn("_at", F.col("j_size")), ["k", "_at"]).where("i <> j").drop("_at")


def pos_pos(scores: DataFrame, sizes: DataFrame, tau_high: float, tau_chem: float, tol: int) -> DataFrame:
    """(i, j, k, score): the best partner j of each i and the witness k.

    The witness scores min(compact of i, extended of j); both fingerprint scores must be at most tau_chem and the
    witness at least tau_high. Of equal scores the least j, then the least k.
    """
    guarded = scores.where(F.col("ecfp") <= tau_chem)
    a = _side(guarded.where(F.col("compact") >= tau_high), sizes, "a", "compact", "i")
    b = _side(guarded.where(F.col("extended") >= tau_high), sizes, "b", "extended", "j")
    met = _met(a, b, tol).withColumn("score", F.least("a", "b"))
    order = Window.partitionBy("i").orderBy(F.col("score").desc(), "j", "k")
    return met.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("i", "j", "k", "score")


def pos_neg(scores: DataFrame, sizes: DataFrame, tau_high: float, tau_low: float, tau_chem: float, tol: int) -> DataFrame:
    """(i, j, k1, k2, score): partners with a witness for each direction.

    k1 has compact of i >= tau_high and extended of j <= tau_low and the largest difference; k2 the reverse. The score
    is the lesser difference; of equal scores the least j. Of equal differences the least k.
    """
    guarded = scores.where(F.col("ecfp") <= tau_chem)

    def direction(first, second, name: str) -> DataFrame:
        a = _side(guarded.where(first("compact")), sizes, "a", "compact", "i")
        b = _side(guarded.where(second("extended")), sizes, "b", "extended", "j")
        met = _met(a, b, tol).withColumn("gap", F.abs(F.col("a") - F.col("b")))
        best = F.max_by("k", F.struct("gap", -F.col("k")))
        return met.groupBy("i", "j").agg(best.alias(name), F.max("gap").alias(f"{name}_gap"))

    high, low = (lambda c: F.col(c) >= tau_high), (lambda c: F.col(c) <= tau_low)
    both = direction(high, low, "k1").join(direction(low, high, "k2"), ["i", "j"]).withColumn("score", F.least("k1_gap", "k2_gap"))
    order = Window.partitionBy("i").orderBy(F.col("score").desc(), "j")
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("i", "j", "k1", "k2", "score")


def pos_pos_diagnostics(scores: DataFrame, sizes: DataFrame, tau_high: float, tau_chem: float, tol: int) -> DataFrame:
    """(i, size_matched, with_witness, past_guard, best, reason) for every i; reason is null where a partner was found."""
    a = _side(scores.select("i", "k", F.struct("compact", "ecfp").alias("v")), sizes, "a", "v", "i").where("a.compact is not null")
    b = _side(scores.select("i", "k", F.struct("extended", "ecfp").alias("v")), sizes, "b", "v", "j").where("b.extended is not null")
    met = _met(a, b, tol)
    good = (F.col("a.ecfp") <= tau_chem) & (F.col("b.ecfp") <= tau_chem)
    # One row a pair first: maxima combine before the shuffle, where distinct counts would not.
    each = met.groupBy("i", "j").agg(F.max(F.when(good, F.least("a.compact", "b.extended"))).alias("s"))
    seen = each.groupBy("i").agg(F.count(F.lit(1)).alias("with_witness"), F.count("s").alias("past_guard"), F.max("s").alias("best"))
    return diagnosed(sizes, seen, tau_high, tol)


def diagnosed(sizes: DataFrame, seen: DataFrame, tau_high: float, tol: int) -> DataFrame:
    """pos_pos_diagnostics() of seen: (i, with_witness, past_guard, best), absent where an item met no other."""
    # Items in a size's band are the sum of 2 tol + 1 counts by size: no pair is made for them.
    counts = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    near = counts.select(F.explode(F.sequence(F.col("size") - tol, F.col("size") + tol)).alias("size"), "n").groupBy("size").agg(F.sum("n").alias("n"))
    matched = sizes.join(near, "size").select("i", (F.col("n") - 1).alias("size_matched"))
    out = sizes.select("i").join(matched, "i", "left").join(seen, "i", "left").fillna(0, ["size_matched", "with_witness", "past_guard"])
    reason = (
        F.when(F.col("size_matched") == 0, "no_size_match")
        .when(F.col("with_witness") == 0, "no_valid_w")
        .when(F.col("past_guard") == 0, "no_chem_pass")
        .when(F.coalesce(F.col("best"), F.lit(-1.0)) < tau_high, "below_tau_high")
    )
    return out.withColumn("reason", reason)


def baselines(scores: DataFrame, value: str) -> DataFrame:
    """(i, n, mean, best, median, p25, p75): scores of each i over its witnesses, absent ones left out."""
    v = F.col(value).cast("double")
    at = F.percentile(v, F.array(F.lit(0.5), F.lit(0.25), F.lit(0.75)))
    out = scores.groupBy("i").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.max(v).alias("best"), at.alias("_p"))
    return out.select("i", "n", "mean", "best", *(F.get("_p", F.lit(k)).alias(c) for k, c in enumerate(("median", "p25", "p75"))))


def pair_records(pairs: DataFrame) -> DataFrame:
    """(row, record): each pair as JSON under a stable number by i; rows are numbered in ranges of i."""
    record = pairs.select("i", F.to_json(F.struct(*pairs.columns)).alias("record"))
    return numbered(record, ["i"], "row").select("row", "record")


def save_pair_set(pairs: DataFrame, items: DataFrame, baselines: DataFrame, path: str, id: str = "i") -> None:
    """Writes compact, extended and records under path, all three with the same number `row` of each pair (i, j, ...).

    items: a row for each id; compact holds those of i, extended those of j. A record is the pair as JSON with the
    baseline of its i (null where it has none). An existing path is an error.
    """
    base = baselines.select(F.col("i"), F.struct(*(c for c in baselines.columns if c != "i")).alias("baseline"))
    whole = pairs.join(base, "i", "left").select("i", "j", F.to_json(F.struct(*pairs.columns, "baseline")).alias("record"))
    rows = settled(numbered(whole, ["i"], "row"))
    for name, side in (("compact", "i"), ("extended", "j")):
        found = items.withColumnRenamed(id, "_id").join(rows.select("row", F.col(side).alias("_id")), "_id")
        found.withColumnRenamed("_id", id).write.mode("errorifexists").parquet(f"{path}/{name}")
    rows.select("row", "record").write.mode("errorifexists").parquet(f"{path}/records")
