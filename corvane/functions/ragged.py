"""Ragged arrays as Column functions: select, pad, mask, one-hot, decode, remap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def take(values: Column, places: Column) -> Column:
    """Elements at zero-based places; a place out of range is an error."""
    return F.transform(places, lambda i: F.element_at(values, i.cast("int") + 1))


def pad(values: Column, n: Column | int, fill: Column) -> Column:
    """values filled up at the end to n; more than n values are an error."""
    n = F.lit(n) if isinstance(n, int) else n
    size = F.size(values)
    return F.when(size > n, F.raise_error(F.lit("array longer than the padded size"))).otherwise(F.concat(values, F.array_repeat(fill, F.greatest(n - size, F.lit(0)))))


def mask(values: Column, n: Column | int) -> Column:
    """1 for each value, then 0 up to n."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.transform(F.sequence(F.lit(1), n), lambda i: (i <= F.size(values)).cast("int"))


def one_hot(index: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: (k == index).cast("int"))


def argmax(values: Column) -> Column:
    """Zero-based place of the largest value, the first of equal ones."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def heavy_places(numbers: Column) -> Column:
    """Places of atoms that aren't hydrogen (atomic number 1)."""
    return F.filter(F.sequence(F.lit(0), F.size(numbers) - 1), lambda i: F.get(numbers, i) != 1)


def kept_edges(edges: Column, places: Column) -> Column:
    """Edges struct<i,j,type> with both ends among places, ends renumbered to their place in places."""
    inside = F.filter(edges, lambda e: F.array_contains(places, e["i"]) & F.array_contains(places, e["j"]))
    at = lambda v: (F.array_position(places, v) - 1).cast("int")
    return F.transform(inside, lambda e: F.struct(at(e["i"]).alias("i"), at(e["j"]).alias("j"), e["type"].alias("type")))


def offset_edges(edges: Column, by: Column) -> Column:
    return F.transform(edges, lambda e: F.struct((e["i"] + by).alias("i"), (e["j"] + by).alias("j"), e["type"].alias("type")))


def complete_weights(weights: Column) -> Column:
    """An array of weights, or null if any of them is."""
    return F.when(F.forall(weights, lambda w: w.isNotNull()), weights)
