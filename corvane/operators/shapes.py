"""Shape and colour likeness of conformers: first-order Gaussian volumes (Grant and Pickup, 1995) and rigid alignment by them.

An atom is a Gaussian as high as 2 sqrt(2) whose volume is that of its sphere; two conformers overlap by the sum over all
pairs of atoms. Colour is the same over features, of which only those of one type overlap. Scores are Tanimoto:
V_ab / (V_aa + V_bb - V_ab).

Alignment starts from the four ways to lay principal axes on each other and climbs by minorisation: of a Gaussian in the
squared distance the tangent lies below it, so the rotation and shift that are best for the tangents (a weighted
superposition, solved as an eigenvector of a quaternion matrix) never lower the overlap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.geom import total
from corvane.session import shipped

#: Height of a Gaussian, and the product of its exponent with the squared radius that gives the sphere's volume.
HEIGHT = 2 * 2**0.5
KAPPA = np.pi * (3 * HEIGHT / (4 * np.pi)) ** (2 / 3)
#: Radii of all heavy atoms and of all features; exponents and the volume of a pair at distance 0 follow.
ATOM_RADIUS, FEATURE_RADIUS = 1.7, 1.08265
#: Rounds of an alignment at most, and the relative gain under which it stops.
ROUNDS, GAIN = 200, 1e-9
#: Pairs that climb together.
TOGETHER = 128


def _half_exponent(radius: float) -> float:
    """The exponent of the product of two equal Gaussians in their squared distance."""
    return float(KAPPA / radius**2 / 2)


def _peak(radius: float) -> float:
    return float(HEIGHT**2 * (np.pi * radius**2 / (2 * KAPPA)) ** 1.5)


def overlap(a: Column, b: Column, radius: float = ATOM_RADIUS, typed: bool = False) -> Column:
    """Overlap volume of two arrays of struct<x,y,z[,type]>; typed: only of points with one type. Columns alone."""

    def pair(p: Column, q: Column) -> Column:
        square = sum(((p[c] - q[c]) * (p[c] - q[c]) for c in "xyz"), F.lit(0.0))
        value = _peak(radius) * F.exp(-_half_exponent(radius) * square)
        return F.when(p["type"] == q["type"], value).otherwise(0.0) if typed else value

    return total(F.transform(a, lambda p: total(F.transform(b, lambda q: pair(p, q)))))


def tanimoto_volume(a: Column, b: Column, radius: float = ATOM_RADIUS, typed: bool = False) -> Column:
    """Score of two point arrays as they lie; null where both are empty."""
    common = overlap(a, b, radius, typed)
    whole = overlap(a, a, radius, typed) + overlap(b, b, radius, typed) - common
    return F.when(whole > 0, common / whole)


class _Cloud:
    """Points of one side: atoms and features in one array, with what tells which pairs overlap."""

    def __init__(self, atoms: np.ndarray, features: np.ndarray, kinds: np.ndarray):
        self.points = np.concatenate((atoms, features))
        self.n, self.kinds = len(atoms), kinds


class _Side:
    """The clouds of many pairs' one side, with the middles of their atoms at 0 and padded to equal numbers of points."""

    def __init__(self, clouds: list[_Cloud]):
        atoms, features = ([c.points[: c.n] for c in clouds], [c.points[c.n :] for c in clouds])
        self.middle = np.array([x.mean(0) for x in atoms])
        self.points = [_padded([x - m for x, m in zip(those, self.middle, strict=True)]) for those in (atoms, features)]
        # Points of one kind overlap; what pads is of no kind.
        self.kinds = [_padded([np.zeros(len(x)) for x in atoms], np.nan), _padded([np.asarray(c.kinds, float) for c in clouds], np.nan)]
        self.axes = np.array([_axes(x) for x in atoms])


def _padded(rows: list[np.ndarray], fill: float = 0.0) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows)), *rows[0].shape[1:]), fill)
    for place, x in zip(out, rows, strict=True):
        place[: len(x)] = x
    return out


def _like(a: _Side, b: _Side) -> list[np.ndarray | None]:
    """For atoms and for features which points of each pair overlap; None where all do."""
    found = [x[:, :, None] == y[:, None] for x, y in zip(a.kinds, b.kinds, strict=True)]
    return [None if x.all() else x for x in found]


def _volumes(a: np.ndarray, b: np.ndarray, like: np.ndarray | None, radius: float) -> np.ndarray:
    """Overlap volumes of the points of each pair."""
    square = np.zeros((len(a), a.shape[1], b.shape[1]))
    for c in range(3):
        gap = a[:, :, None, c] - b[:, None, :, c]
        square += np.multiply(gap, gap, out=gap)
    square *= -_half_exponent(radius)
    out = np.multiply(np.exp(square, out=square), _peak(radius), out=square)
    return out if like is None else out * like


def _moments(a: np.ndarray, b: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """4 x 4 matrices of weighted sums of b's coordinates and 1 (rows) times a's coordinates and 1."""
    one = lambda x: np.concatenate((x, np.ones((*x.shape[:-1], 1))), -1)
    return np.swapaxes(weights @ one(b), -1, -2) @ one(a)


def superposed(a: np.ndarray, b: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and shift of b that least squares of all pairs' distances to a ask for, weights[..., i, j] of a[..., i] with b[..., j] (Horn, 1987)."""
    return _laid(_moments(a, b, weights))


def _laid(moments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """superposed() of moments."""
    mass = moments[..., 3, 3]
    none, mass = mass <= 0, np.where(mass > 0, mass, 1.0)
    ca, cb = moments[..., 3, :3] / mass[..., None], moments[..., :3, 3] / mass[..., None]
    m = moments[..., :3, :3] - mass[..., None, None] * cb[..., :, None] * ca[..., None, :]
    (xx, xy, xz), (yx, yy, yz), (zx, zy, zz) = np.moveaxis(m, (-2, -1), (0, 1))
    form = np.array([
        [xx + yy + zz, yz - zy, zx - xz, xy - yx],
        [yz - zy, xx - yy - zz, xy + yx, zx + xz],
        [zx - xz, xy + yx, yy - xx - zz, yz + zy],
        [xy - yx, zx + xz, yz + zy, zz - xx - yy],
    ])
    w, x, y, z = np.moveaxis(np.linalg.eigh(np.moveaxis(form, (0, 1), (-2, -1)))[1][..., -1], -1, 0)
    turn = np.array([
        [w * w + x * x - y * y - z * z, 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), w * w - x * x + y * y - z * z, 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), w * w - x * x - y * y + z * z],
    ])
    turn = np.moveaxis(turn, (0, 1), (-2, -1))
    shift = ca - (turn @ cb[..., None])[..., 0]
    return np.where(none[..., None, None], np.eye(3), turn), np.where(none[..., None], 0.0, shift)


def _axes(points: np.ndarray) -> np.ndarray:
    """Principal axes as rows, right-handed."""
    axes = np.linalg.eigh((points - points.mean(0)).T @ (points - points.mean(0)))[1].T
    axes[2] *= np.sign(np.linalg.det(axes)) or 1
    return axes


def align(a: _Cloud, b: _Cloud, weight: float = 0.5) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(shape, colour, rotation, shift): b laid on a so that weight * shape + (1 - weight) * colour is best of four climbs."""
    shape, colour, turn, shift = (x[0] for x in align_all([a], [b], weight))
    return float(shape), float(colour), turn, shift


def align_all(firsts: list[_Cloud], seconds: list[_Cloud], weight: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """align() of many pairs: all climbs take a round together, and those that are at their top leave."""
    a, b = _Side(firsts), _Side(seconds)
    radii = (ATOM_RADIUS, FEATURE_RADIUS)
    like, exponents = _like(a, b), [_half_exponent(x) for x in radii]
    whole = lambda v: v.sum((1, 2))
    selves = [sum(whole(_volumes(x.points[k], x.points[k], _like(x, x)[k], radii[k])) for x in (a, b)) for k in (0, 1)]
    shares = [np.divide(w, s, out=np.zeros_like(s), where=s > 0) for w, s in zip((weight, 1 - weight), selves, strict=True)]

    def volumes(of: np.ndarray, turn: np.ndarray, shift: np.ndarray) -> list[np.ndarray]:
        moved = (x[of] @ np.swapaxes(turn, -1, -2) + shift[:, None] for x in b.points)
        return [_volumes(x[of], y, None if k is None else k[of], radius) for x, y, k, radius in zip(a.points, moved, like, radii, strict=True)]

    n, flips = len(firsts), np.array(((1, 1, 1), (1, -1, -1), (-1, 1, -1), (-1, -1, 1)))
    of = np.repeat(np.arange(n), len(flips))
    turn = np.swapaxes(a.axes, 1, 2)[of] @ (np.tile(flips, (n, 1))[:, :, None] * b.axes[of])
    shift, before, on = np.zeros((len(of), 3)), np.full(len(of), -1.0), np.arange(len(of))
    for _ in range(ROUNDS):
        both = volumes(of[on], turn[on], shift[on])
        now = sum(s[of[on]] * whole(v) for s, v in zip(shares, both, strict=True))
        up = now > before[on] * (1 + GAIN)
        on = on[up]
        if not len(on):
            break
        before[on] = now[up]
        parts = ((x[of[on]], y[of[on]], v[up] * (e * s[of[on]])[:, None, None]) for x, y, v, e, s in zip(a.points, b.points, both, exponents, shares, strict=True))
        turn[on], shift[on] = _laid(sum(_moments(*part) for part in parts))
    found = [whole(v).reshape(n, -1) for v in volumes(of, turn, shift)]
    shape, colour = (np.divide(v, s[:, None] - v, out=np.zeros_like(v), where=(s > 0)[:, None]) for v, s in zip(found, selves, strict=True))
    best = np.arange(n), (weight * shape + (1 - weight) * colour).argmax(1)
    turn, shift = turn.reshape(n, -1, 3, 3)[best], shift.reshape(n, -1, 3)[best]
    return shape[best], colour[best], turn, shift + a.middle - (turn @ b.middle[:, :, None])[:, :, 0]


def _clouds(batch, atoms: str, features: str) -> list[_Cloud | None]:
    """A cloud for each row; None where it has fewer than four atoms."""

    def points(name: str, fields: str) -> list[np.ndarray]:
        rows = batch.column(name)
        ends = np.cumsum(np.nan_to_num(rows.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(int))
        flat = rows.flatten()
        values = [flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in fields.split()]
        return np.split(np.stack(values, 1), ends[:-1])

    typed = points(features, "x y z type")
    return [_Cloud(x, f[:, :3], f[:, 3]) if len(x) >= 4 else None for x, f in zip(points(atoms, "x y z"), typed, strict=True)]


def aligned(pairs: DataFrame, id: str, weight: float = 0.5) -> DataFrame:
    """(id, shape, colour, xyz): scores of b laid on a, and b's atoms there.

    pairs: id, a_xyz, b_xyz (arrays of struct<x,y,z>), a_features, b_features (of struct<x,y,z,type>, null or empty where
    there are none). A side with fewer than four atoms gives nulls, as does a null one. Pairs of like sizes climb together.
    """
    if not 0 <= weight <= 1:
        raise ValueError("weight must be between 0 and 1")
    names = ("a_xyz", "b_xyz", "a_features", "b_features")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sides = list(zip(_clouds(batch, "a_xyz", "a_features"), _clouds(batch, "b_xyz", "b_features"), strict=True))
            some = sorted((x for x, (a, b) in enumerate(sides) if a and b), key=lambda x: [(len(c.points), c.n) for c in sides[x]])
            out: list[tuple] = [(None, None, None)] * len(sides)
            for at in range(0, len(some), TOGETHER):
                part = some[at : at + TOGETHER]
                for x, shape, colour, turn, shift in zip(part, *align_all(*map(list, zip(*(sides[x] for x in part), strict=True)), weight), strict=True):
                    b = sides[x][1]
                    out[x] = float(shape), float(colour), b.points[: b.n] @ turn.T + shift
            kinds = (pa.float64(), pa.float64())
            scores = [pa.array([x[c] for x in out], kind) for c, kind in enumerate(kinds)]
            flat = np.concatenate([x[2] for x in out if x[2] is not None] or [np.zeros((0, 3))])
            ends = np.cumsum([0] + [0 if x[2] is None else len(x[2]) for x in out])
            empty = pa.array([x[2] is None for x in out] + [False])
            places = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], names=["x", "y", "z"])
            xyz = pa.ListArray.from_arrays(pc.if_else(empty, None, pa.array(ends, pa.int32())), places)
            yield pa.RecordBatch.from_arrays([batch.column(0), *scores, xyz], names=[id, "shape", "colour", "xyz"])

    shipped(pairs.sparkSession)
    # Climbing takes far longer than reading: pairs are dealt out, however few bytes they are.
    dealt = pairs.select(id, *names).repartition(4 * pairs.sparkSession.sparkContext.defaultParallelism, id)
    return dealt.mapInArrow(run, f"{id} {dict(pairs.dtypes)[id]}, shape double, colour double, xyz array<struct<x:double,y:double,z:double>>")


def best_aligned(pairs: DataFrame, id: str, conformer: str, weight: float = 0.5) -> DataFrame:
    """(id, conformer, shape, colour, xyz): of the conformers b of each id the one that scores best on a; the least conformer of equals."""
    keyed = pairs.withColumn("_key", F.struct(id, conformer))
    found = aligned(keyed, "_key", weight).where("shape is not null").withColumn("_score", weight * F.col("shape") + (1 - weight) * F.col("colour"))
    key = F.struct(F.col("_score"), (-F.col(f"_key.{conformer}")).alias("_c"))
    best = found.groupBy(F.col(f"_key.{id}").alias(id)).agg(F.max_by(F.struct(F.col(f"_key.{conformer}").alias(conformer), "shape", "colour", "xyz"), key).alias("_b"))
    return best.select(id, "_b.*")
