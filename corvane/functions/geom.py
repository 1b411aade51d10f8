"""Geometry as Column functions over points struct<x,y,z> and arrays of them. All arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def points_of(flat: Column, n: int) -> Column:
    """n points from a flat array x0, y0, z0, x1, ..."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: point(F.get(flat, 3 * i), F.get(flat, 3 * i + 1), F.get(flat, 3 * i + 2)))


def total(values: Column) -> Column:
    """Sum of an array of doubles."""
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def centroid(points: Column) -> Column:
    """Unweighted mean point."""
    mean = lambda axis: total(F.transform(points, lambda p: p[axis])) / F.size(points)
    return F.struct(*(mean(a).alias(a) for a in AXES))


def let(value: Column, body) -> Column:
    """body(v) with v worked out once: expressions inside a lambda are worked out anew for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shift(points: Column, by: Column, sign: int = 1) -> Column:
    return let(by, lambda b: F.transform(points, lambda p: F.struct(*((p[a] + sign * b[a]).alias(a) for a in AXES))))


def scale(points: Column, by: Column | float) -> Column:
    by = F.lit(by) if isinstance(by, float | int) else by
    return let(by, lambda b: F.transform(points, lambda p: F.struct(*((p[a] * b).alias(a) for a in AXES))))


def centred(points: Column) -> Column:
    return shift(points, centroid(points), -1)


def rotate(points: Column, matrix: list[list[float]]) -> Column:
    """Rows of a 3 x 3 matrix times each point."""
    return F.transform(points, lambda p: F.struct(*((row[0] * p["x"] + row[1] * p["y"] + row[2] * p["z"]).alias(a) for a, row in zip(AXES, matrix, strict=True))))


def dot(p: Column, q: Column) -> Column:
    return p["x"] * q["x"] + p["y"] * q["y"] + p["z"] * q["z"]


def minus(p: Column, q: Column) -> Column:
    return F.struct(*((p[a] - q[a]).alias(a) for a in AXES))


def cross(p: Column, q: Column) -> Column:
    return F.struct(
        (p["y"] * q["z"] - p["z"] * q["y"]).alias("x"),
        (p["z"] * q["x"] - p["x"] * q["z"]).alias("y"),
        (p["x"] * q["y"] - p["y"] * q["x"]).alias("z"),
    )


def norm(p: Column) -> Column:
    return F.sqrt(dot(p, p))


def unit(p: Column, least: float = 1e-8) -> Column:
    """p at length one; the zero vector where its length is at most least."""
    return let(norm(p), lambda n: F.struct(*(F.when(n > least, p[a] / n).otherwise(0.0).alias(a) for a in AXES)))


def distance(p: Column, q: Column, eps: float = 0.0) -> Column:
    d = minus(p, q)
    return F.sqrt(dot(d, d) + eps)


def angle_degrees(a: Column, at: Column, b: Column) -> Column:
    """Angle a-at-b in degrees, its cosine clipped to [-1, 1]."""
    u, v = minus(a, at), minus(b, at)
    cosine = dot(u, v) / (norm(u) * norm(v) + 1e-10)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def radius_of_gyration(points: Column) -> Column:
    """Root mean squared distance from the centroid, all points alike."""
    off = centred(points)
    return F.sqrt(total(F.transform(off, lambda p: dot(p, p))) / F.size(points))


def box(points: Column, padding: float) -> Column:
    """Centre (centroid) and edge lengths (span plus twice the padding) of the box round the points."""
    span = lambda a: F.array_max(F.transform(points, lambda p: p[a])) - F.array_min(F.transform(points, lambda p: p[a])) + 2 * padding
    return F.struct(centroid(points).alias("centre"), F.struct(*(span(a).alias(a) for a in AXES)).alias("size"))


def rmsd(p: Column, q: Column) -> Column:
    """Root mean squared distance of points in their places, without alignment."""
    squares = F.zip_with(p, q, lambda a, b: dot(minus(a, b), minus(a, b)))
    return F.sqrt(total(squares) / F.size(p))


def distance_matrix(p: Column, q: Column, eps: float = 1e-6) -> Column:
    """Array of arrays of distances sqrt(d2 + eps)."""
    return F.transform(p, lambda a: F.transform(q, lambda b: distance(a, b, eps)))


def standardised(points: Column) -> Column:
    """Points divided by the population standard deviation of all their coordinates; they are not centred."""
    flat = F.flatten(F.transform(points, lambda p: F.array(*(p[a] for a in AXES))))
    spread = lambda m: F.sqrt(total(F.transform(flat, lambda v: (v - m) * (v - m))) / F.size(flat))
    return scale(points, 1 / let(total(flat) / F.size(flat), spread))


def aligned_rmsd(p: Column, q: Column, steps: int = 50) -> Column:
    """Least root mean squared distance of q to p over all rotations, both centred.

    The largest eigenvalue of the 4 x 4 key matrix by Newton's steps on its quartic (Theobald, 2005): plain arithmetic.
    """
    a, b = centred(p), centred(q)
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    squares = lambda c: total(F.transform(c, lambda v: dot(v, v)))
    return let(F.struct(pairs.alias("w"), squares(a).alias("ga"), squares(b).alias("gb")), lambda s: _from_pairs(s, steps))


def _from_pairs(s: Column, steps: int) -> Column:
    product = lambda i, j: lambda w: w["a"][i] * w["b"][j]
    sums = {f"{i}{j}": total(F.transform(s["w"], product(i, j))) for i in AXES for j in AXES}
    sums |= {"n": F.size(s["w"]), "g": s["ga"] + s["gb"]}
    # Bound once as a struct, so that each sum is worked out once.
    return let(F.struct(*(v.alias(k) for k, v in sums.items())), lambda m: rmsd_from_sums(m, steps))


def rmsd_from_sums(m: Column, steps: int = 50) -> Column:
    """The aligned RMSD from cross sums xx..zz, n points and g, the sum of both clouds' squared lengths."""
    xx, xy, xz, yx, yy, yz, zx, zy, zz = (m[f"{i}{j}"] for i in AXES for j in AXES)
    c2 = -2 * (xx * xx + xy * xy + xz * xz + yx * yx + yy * yy + yz * yz + zx * zx + zy * zy + zz * zz)
    c1 = 8 * (xx * yz * zy + yy * zx * xz + zz * xy * yx - xx * yy * zz - yz * zx * xy - zy * yx * xz)
    rows = [
        [xx + yy + zz, yz - zy, zx - xz, xy - yx],
        [yz - zy, xx - yy - zz, xy + yx, zx + xz],
        [zx - xz, xy + yx, yy - xx - zz, yz + zy],
        [xy - yx, zx + xz, yz + zy, zz - xx - yy],
    ]
    c0 = determinant(rows)
    start = m["g"] / 2

    def solve(c: Column) -> Column:
        def step(v: Column, _: Column) -> Column:
            slope = 4 * v * v * v + 2 * c["c2"] * v + c["c1"]
            value = ((v * v + c["c2"]) * v + c["c1"]) * v + c["c0"]
            return F.when(slope == 0, v).otherwise(v - value / slope)

        top = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start.cast("double"), step)
        return F.sqrt(F.greatest(F.lit(0.0), (m["g"] - 2 * top) / m["n"]))

    return let(F.struct(c2.alias("c2"), c1.alias("c1"), c0.alias("c0")), solve)


def determinant(rows: list[list]) -> Column:
    """Determinant of a square matrix of Columns by its first row."""
    if len(rows) == 1:
        return rows[0][0]
    terms = [(-1) ** k * rows[0][k] * determinant([r[:k] + r[k + 1 :] for r in rows[1:]]) for k in range(len(rows))]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out
