"""Mixing sources to target weights, in DataFrame functions only.

Efraimidis-Spirakis sampling: a document of weight w draws the key -ln(u) / w, u a hash of the document, and its source
takes documents in the order of their keys until the running sum of their words meets the budget. Budgets above the
source's size take whole epochs first; the rest is the fractional selection.

No source is sorted as a whole. The logarithms of a source's keys, which keep their order at any weight, are placed
between its least and its greatest one on 2^30 places. The place in which the budget ends is found by sums over 1024
bins, three times, each time within the bin before; documents of lower places are taken, those of higher ones left, and
only the documents of the one place are sorted. Sums by bin combine before the shuffle, so a source with a third of all
rows costs no more than another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import aside, n_words, written

#: Bits of a place, and of the bins of each pass.
PLACE, PASS = 30, 10


def letter_share(text: Column) -> Column:
    """The default quality of a text: 0.5 plus half the share of its characters that are letters."""
    text = F.coalesce(text, F.lit(""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return 0.5 + 0.5 * letters / F.greatest(F.length(text), F.lit(1))


def keyed(docs: DataFrame, seed: int = 42, quality: Column | None = None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """docs with _size (words) and _at, the logarithm of the key. Reruns give the same.

    quality: a positive weight of each document; null, 0 and below count as the least positive weight.
    """
    quality = letter_share(F.col(text)) if quality is None else quality
    draw = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")), F.lit(seed)), 12)
    weight = F.greatest(F.coalesce(quality.cast("double"), F.lit(0.0)), F.lit(1e-300))
    # (draw + 0.5) / 2^52 is exact, so it is never 0 or 1.
    return docs.withColumns({"_size": n_words(F.col(text)), "_at": F.log(-F.log((draw + 0.5) / float(2**52))) - F.log(weight)})


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, any other columns) -> with target. Sources by code point, null last, take the weights in turn.

    Water level: by ascending cap / weight, the first source that the level of the rest doesn't fill, and all after
    it, get weight x level; those before it stop at their caps. That is where resharing the excess ends.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    upto = fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    turn = F.array(*(F.lit(float(w)) for w in weights))
    out = sizes.withColumn("_weight", F.get(turn, ((F.row_number().over(order) - 1) % len(weights)).cast("int")))
    out = out.withColumns({"_cap": cap * F.col("source_size"), "_all": share * F.sum("source_size").over(every)})
    out = out.withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_cap").over(upto), F.lit(0.0))) / F.sum("_weight").over(onward))
    out = out.withColumn("_free", F.col("_level") <= F.col("_cap") / F.col("_weight"))
    out = out.withColumn("_turn", F.row_number().over(fill))
    level = F.min(F.when(F.col("_free"), F.struct("_turn", "_level"))).over(every)["_level"]
    target = F.coalesce(F.least(F.col("_cap"), F.col("_weight") * F.col("_water")), F.col("_cap"))
    return out.withColumn("_water", level).select(*sizes.columns, target.alias("target"))


def place(at: Column, low: Column, high: Column) -> Column:
    """The place of a key between a source's least and greatest one; it keeps the order of keys."""
    share = F.when(high > low, (at - low) / (high - low)).otherwise(0.0)
    return F.least(F.floor(share * float(2**PLACE)), F.lit(2**PLACE - 1)).cast("long")


def budgets(rows: DataFrame, **how) -> DataFrame:
    """One row a source: source_size, target, epochs, rest, its least and greatest key, and the place in which the rest ends with the words before it.

    rows: source, _size, _at, best a written table, as it is read four times.
    """
    sizes = rows.groupBy("source").agg(F.sum("_size").alias("source_size"), F.min("_at").alias("_low"), F.max("_at").alias("_high"))
    targets = source_targets(sizes, **how).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    targets = targets.withColumn("rest", F.greatest(F.lit(0), F.round(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size")))
    zero = F.lit(0).cast("long")
    found = written(targets.withColumnRenamed("source", "_source").withColumns({"_end": zero, "_before": zero}), "targets")
    for shift in range(PLACE - PASS, -1, -PASS):
        known = found.select("_source", "_low", "_high", "rest", "_end", "_before")
        here = rows.join(known, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_place", place(F.col("_at"), F.col("_low"), F.col("_high")))
        within = here.where(F.shiftright("_place", shift + PASS) == F.col("_end"))
        sums = within.groupBy("source", F.shiftright("_place", shift).alias("_bin")).agg(
            F.sum("_size").alias("_words"), F.first("rest").alias("rest"), F.first("_before").alias("_start")
        )
        upto = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("_words_before", F.col("_start") + F.coalesce(F.sum("_words").over(upto), F.lit(0)))
        # The last bin that begins at or before the end of the budget.
        last = sums.where(F.col("_words_before") <= F.col("rest")).groupBy("source").agg(F.max(F.struct("_bin", "_words_before")).alias("_last"))
        found = found.drop("_end", "_before").join(last, F.col("source").eqNullSafe(F.col("_source")), "left")
        found = written(found.withColumns({"_end": F.col("_last._bin"), "_before": F.col("_last._words_before")}).drop("source", "_last"), "budgets")
    return found


def take(rows: DataFrame, budget: DataFrame, whole: bool = False, id: str = "doc_id") -> DataFrame:
    """rows (source, _size, _at, anything else) with source_size, target, epochs and _part: the words of the fractional selection.

    whole=False: the document in which the budget ends is taken in part, up to the budget's last word.
    whole=True: it is taken whole or left, whichever comes nearer to the budget.
    """
    rows = rows.join(budget, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_place", place(F.col("_at"), F.col("_low"), F.col("_high")))
    none = F.lit(0).cast("long")
    clear = rows.where(F.col("_place") != F.col("_end")).withColumn("_part", F.when(F.col("_place") < F.col("_end"), F.col("_size")).otherwise(none))
    order = Window.partitionBy("source").orderBy("_at", id, "_size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("_before") - F.coalesce(F.sum("_size").over(order), F.lit(0))
    part = F.when(2 * left >= F.col("_size"), F.col("_size")).otherwise(none) if whole else F.least(F.col("_size"), F.greatest(none, left))
    last = rows.where(F.col("_place") == F.col("_end")).withColumn("_part", part.cast("long"))
    return clear.unionByName(last).drop("_source", "_low", "_high", "_place", "_end", "_before", "rest")


def mix_table(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, epochs, part of every row.

    A null text has size 0 and takes 0; a null source is a source like any other, sorted last; repeated rows and equal
    keys are taken one by one; an empty table gives an empty result.
    """
    rows = written(keyed(docs.select("doc_id", "source", "text")).select("doc_id", "source", "_size", "_at"), "keyed")
    out = take(rows, budgets(rows, **how))
    return out.select(
        "doc_id", "source", F.col("_size").alias("size"), "source_size", "target",
        (F.col("epochs") * F.col("_size") + F.col("_part")).alias("taken"), "epochs", F.col("_part").alias("part"),
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs as the mix takes them: a document taken k times is k rows, one that isn't taken none.

    Whole documents only. Decisions meet the texts in the scan: only the documents of each source's last place are
    shuffled with their texts. Null and empty texts, and those of white space, have no words: they come once with each
    complete epoch of their source and not in its fraction. A null source is a source like any other; a null doc_id stays; repeated rows are taken one by one; columns beyond those of
    documents are carried along under any name; an empty table gives an empty result.
    """
    rows = written(keyed(docs.select("doc_id", "source", "text")).select("source", "_size", "_at"), "keyed")
    budget = budgets(rows, **how)

    def repeated(docs: DataFrame) -> DataFrame:
        out = take(keyed(docs), budget, whole=True)
        copies = F.col("epochs") + F.when((F.col("_part") > 0) & (F.col("_size") > 0), 1).otherwise(0)
        return out.withColumn("_copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>"))))

    return aside(docs, repeated)
