"""NumPy kernels for what is inherently numeric or sequential, and the registry of external ones."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import shipped


def assignment(cost: np.ndarray) -> np.ndarray:
    """For each row of a square matrix, the column of a least-cost assignment.

    Shortest augmenting paths with potentials; each path's search works on whole rows.
    """
    n = len(cost)
    u, v = np.zeros(n), np.zeros(n + 1)
    row_of = np.full(n + 1, -1)
    for r in range(n):
        row_of[n] = r
        at, used = n, np.zeros(n + 1, bool)
        least, back = np.full(n, np.inf), np.full(n, n)
        while row_of[at] >= 0:
            used[at] = True
            i = row_of[at]
            slack = cost[i] - u[i] - v[:n]
            better = ~used[:n] & (slack < least)
            least[better], back[better] = slack[better], at
            free = np.flatnonzero(~used[:n])
            nxt = free[np.argmin(least[free])]
            delta = least[nxt]
            taken = np.flatnonzero(used)
            u[row_of[taken]] += delta
            v[taken] -= delta
            least[free] -= delta
            at = nxt
        while at != n:
            row_of[at] = row_of[back[at]]
            at = back[at]
    out = np.zeros(n, int)
    out[row_of[:n]] = np.arange(n)
    return out


def sphere(n: int) -> np.ndarray:
    """n points spread evenly over the unit sphere (golden spiral)."""
    i = np.arange(n) + 0.5
    polar, turn = np.arccos(1 - 2 * i / n), np.pi * (1 + 5**0.5) * i
    return np.stack([np.cos(turn) * np.sin(polar), np.sin(turn) * np.sin(polar), np.cos(polar)], 1)


#: Squared distances of probe points to atoms that are held at once.
SURFACE_CELLS = 1 << 22


def surface_areas(points: np.ndarray, radii: np.ndarray, probe: float = 1.4, n: int = 960) -> np.ndarray:
    """Solvent-accessible area of each atom: the share of its probe sphere outside all others (Shrake and Rupley, 1973).

    All probe points of a block of atoms meet all atoms in one product of matrices; an atom never buries its own.
    """
    reach, unit, many = radii + probe, sphere(n), len(points)
    points = points - points.mean(0) if many else points
    out = np.zeros(many)
    step = max(1, SURFACE_CELLS // max(1, n * many))
    for at in range(0, many, step):
        block = slice(at, min(at + step, many))
        shell = points[block, None] + reach[block, None, None] * unit
        square = (shell**2).sum(2)[:, :, None] + (points**2).sum(1) - 2 * shell @ points.T
        own = np.arange(at, block.stop)
        square[np.arange(len(own)), :, own] = np.inf
        buried = (square < reach**2).any(2)
        out[block] = 4 * np.pi * reach[block] ** 2 * (1 - buried.mean(1))
    return out


def random_rotation(rng: np.random.Generator) -> np.ndarray:
    """A uniformly random rotation: a normalised quaternion of four normal draws."""
    w, x, y, z = (q := rng.normal(size=4)) / np.linalg.norm(q)
    return np.array([
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ])


def _cloud(points) -> np.ndarray:
    return np.array([(p["x"], p["y"], p["z"]) for p in points], float).reshape(-1, 3)


def match_atoms(pairs: DataFrame, id: str) -> DataFrame:
    """(id, order, cost): the permutation of b's atoms that lies nearest to a's, both centred, and its sum of squares."""

    def run(frames):
        for frame in frames:
            orders, costs = [], []
            for a, b in zip(frame["a_xyz"], frame["b_xyz"], strict=True):
                a, b = _cloud(a), _cloud(b)
                a, b = a - a.mean(0), b - b.mean(0)
                cost = ((a[:, None] - b[None]) ** 2).sum(2)
                order = assignment(cost)
                orders.append(order.tolist())
                costs.append(float(cost[np.arange(len(a)), order].sum()))
            yield pd.DataFrame({id: frame[id], "order": orders, "cost": costs})

    shipped(pairs.sparkSession)
    return pairs.select(id, "a_xyz", "b_xyz").mapInPandas(run, f"{id} {dict(pairs.dtypes)[id]}, order array<int>, cost double")


def polar_surface(rows: DataFrame, id: str, probe: float = 1.4, n: int = 960) -> DataFrame:
    """(id, area, polar_area) of rows id, xyz, radii, polar (array of booleans)."""

    def run(frames):
        for frame in frames:
            found = [surface_areas(_cloud(x), np.asarray(r, float), probe, n) for x, r in zip(frame["xyz"], frame["radii"], strict=True)]
            polar = [float(a[np.asarray(p, bool)].sum()) for a, p in zip(found, frame["polar"], strict=True)]
            yield pd.DataFrame({id: frame[id], "area": [float(a.sum()) for a in found], "polar_area": polar})

    shipped(rows.sparkSession)
    return rows.select(id, "xyz", "radii", "polar").mapInPandas(run, f"{id} {dict(rows.dtypes)[id]}, area double, polar_area double")


def augmented_profiles(
    rows: DataFrame, id: str, seed: int = 0, pos_std: float | tuple[float, float] = 0.0, rotate_prob: float = 0.0, resample: float = 0.0,
    drop_pharm_point: float = 0.0, drop_pharm: float = 0.0, drop_shape: float = 0.0,
) -> DataFrame:
    """(id, points, rotated, mode, noise) of typed profiles: array<struct<x,y,z,type>>, type 1 shape, above it pharmacophore.

    Points may also hold a direction (dx, dy, dz) and atom_ids (array<int>), which go with them: both are copied, dropped
    and kept with their point, and directions turn with the positions. Other fields are left out.
    Shape points are doubled with probability resample; then either all pharmacophores (mode 1) or all shape points
    (mode 2) may go, never both; then single pharmacophores; shape points get normal noise, whose deviation a range
    (low, high) as pos_std has each row draw for itself (noise); the whole may be rotated.
    Draws are seeded by the row's id, so that results don't depend on partitions. A null array of points is an empty one.
    """
    if not all(0 <= p <= 1 for p in (rotate_prob, resample)):
        raise ValueError("rotate_prob and resample are probabilities, from 0 to 1")
    fields = {f.name for f in rows.schema["points"].dataType.elementType}
    directed, named = {"dx", "dy", "dz"} <= fields, "atom_ids" in fields

    def augmented(key, points: list) -> tuple:
        import zlib

        rng = np.random.default_rng([seed, zlib.crc32(str(key).encode())])
        of = lambda names: np.array([[p[c] for c in names] for p in points], float).reshape(-1, 3)
        places, ways = of("xyz"), of(("dx", "dy", "dz")) if directed else np.zeros((len(points), 3))
        kind = np.array([p["type"] for p in points], int)
        shape, pharm = np.flatnonzero(kind == 1), np.flatnonzero(kind > 1)
        shape = np.concatenate([shape, shape[rng.random(len(shape)) < resample]])
        no_pharm, no_shape = rng.random() < drop_pharm, rng.random() < drop_shape
        mode = 0 if no_pharm == no_shape else 1 if no_pharm else 2
        if mode == 1:
            pharm = pharm[:0]
        else:
            pharm = pharm[rng.random(len(pharm)) >= drop_pharm_point]
            shape = shape[:0] if mode == 2 else shape
        noise = float(rng.uniform(*pos_std) if isinstance(pos_std, tuple) else pos_std)
        at = np.concatenate([shape, pharm])
        places, ways = places[at], ways[at]
        if noise:
            places[: len(shape)] += rng.normal(0, noise, (len(shape), 3))
        turned = bool(rng.random() < rotate_prob)
        if turned:
            turn = random_rotation(rng).T
            places, ways = places @ turn, ways @ turn
        out = [dict(zip("xyz", map(float, p), strict=True), type=int(kind[i])) for i, p in zip(at, places, strict=True)]
        for i, point, way in zip(at, out, ways, strict=True):
            if directed:
                point.update(zip(("dx", "dy", "dz"), map(float, way), strict=True))
            if named:
                ids = points[i]["atom_ids"]
                point["atom_ids"] = None if ids is None else list(ids)
        return key, out, turned, mode, noise

    def run(frames):
        for frame in frames:
            out = [augmented(key, [] if points is None else list(points)) for key, points in zip(frame[id], frame["points"], strict=True)]
            yield pd.DataFrame(out, columns=[id, "points", "rotated", "mode", "noise"])

    shipped(rows.sparkSession)
    kind = dict(rows.dtypes)[id]
    point = "x:double,y:double,z:double,type:int" + (",dx:double,dy:double,dz:double" if directed else "") + (",atom_ids:array<int>" if named else "")
    return rows.select(id, "points").mapInPandas(run, f"{id} {kind}, points array<struct<{point}>>, rotated boolean, mode int, noise double")


EXTERNAL = ("qed", "logp", "tpsa", "aromatic_rings", "sanitise", "smiles", "electrostatics", "pharmacophores", "align", "mmff", "xtb", "embed", "dock", "interactions", "pose_checks")
_KERNELS: dict[str, tuple[Callable, str]] = {}


class KernelNotInstalled(RuntimeError):
    """The named operator needs a chemistry toolkit that no one registered."""


def register_kernel(name: str, fn: Callable, schema: str) -> None:
    """Registers a function of pandas frames (as in mapInPandas) with its result schema for an external operator."""
    _KERNELS[name] = (fn, schema)


def run_kernel(name: str, rows: DataFrame, result: str | None = None) -> DataFrame:
    """Runs a registered kernel; without one, rows that already hold the column `result` pass as they are."""
    if name in _KERNELS:
        fn, schema = _KERNELS[name]
        shipped(rows.sparkSession)
        return rows.mapInPandas(fn, schema)
    if result and result in rows.columns:
        return rows
    raise KernelNotInstalled(f"{name}: register_kernel({name!r}, fn, schema) first, or give a column {result or name}")


def or_sentinel(value, sentinel: float):
    """Column: a kernel's null result as the feature's error value."""
    return F.coalesce(value, F.lit(sentinel))
