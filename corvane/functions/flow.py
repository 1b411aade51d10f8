"""Arithmetic of flow matching as Column functions: schedules, steps, transitions, guidance, interpolation, losses."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.geom import let, total


def schedule(kind: str, t: Column, power: float = 2.0) -> Column:
    """identity: t; polyinc: t^power; polydec: 1 - (1 - t)^power."""
    if kind == "identity":
        return t
    if kind == "polyinc":
        return F.pow(t, F.lit(power))
    if kind == "polydec":
        return 1 - F.pow(1 - t, F.lit(power))
    raise ValueError(f"unknown schedule {kind}")


def schedule_slope(kind: str, t: Column, power: float = 2.0) -> Column:
    """The schedule's derivative."""
    if kind == "identity":
        return F.lit(1.0)
    if kind == "polyinc":
        return power * F.pow(t, F.lit(power - 1))
    if kind == "polydec":
        return power * F.pow(1 - t, F.lit(power - 1))
    raise ValueError(f"unknown schedule {kind}")


def euler_step(x: Column, velocity: Column, t: Column, dt: Column | float, kind: str = "identity", eps: float = 1e-6) -> Column:
    return x + dt * velocity * schedule_slope(kind, t) / (1 - schedule(kind, t) + eps)


def time_grid(kind: str, i: Column, n: int) -> Column:
    """Time of step i of 0..n: constant is even over 0..0.999; decay is 1 less a geometric run, from fine to coarse steps reversed."""
    if kind == "constant":
        return i * (0.999 / n)
    if kind == "decay":
        return 1 - 0.01 * F.pow(F.lit(99.9), (n - i) / F.lit(float(n)))
    raise ValueError(f"unknown grid {kind}")


def guided_mean(cond: Column, null: Column, gamma: float) -> Column:
    """gamma a + (1 - gamma) b, element by element."""
    return F.zip_with(cond, null, lambda a, b: gamma * a + (1 - gamma) * b)


def guided_product(cond: Column, null: Column, gamma: float, least: float = 1e-10) -> Column:
    """a^gamma b^(1 - gamma), not normalised; both are held above least."""
    up = lambda v: F.greatest(v, F.lit(least))
    return F.zip_with(cond, null, lambda a, b: F.pow(up(a), F.lit(gamma)) * F.pow(up(b), F.lit(1 - gamma)))


def normalised(p: Column) -> Column:
    return let(total(p), lambda s: F.transform(p, lambda v: v / s))


def uniform_transition(p: Column, current: Column, t: Column, dt: float, noise: float, eps: float = 1e-5) -> Column:
    """Probabilities of the next category under uniform noise; the current one takes what the others leave, 0 at least."""
    s = F.size(p)
    t = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), t))
    eta = F.when(t + dt < 1, F.lit(noise)).otherwise(F.lit(0.0))
    here = F.get(p, current)
    rate = dt * (1 + eta + eta * (s - 1) * t) / (1 - t)
    off = F.transform(p, lambda v, i: F.when(i == current, F.lit(0.0)).otherwise(F.least(F.lit(1.0), rate * v + dt * eta * here)))
    rest = lambda z: F.greatest(F.lit(0.0), 1 - z["sum"])
    filled = lambda z: F.transform(z["off"], lambda v, i: F.when(i == current, rest(z)).otherwise(v))
    return let(off, lambda o: let(F.struct(o.alias("off"), total(o).alias("sum")), filled))


def mask_transition(masked: Column, t: Column, dt: float, noise: float) -> Column:
    """Probability that a masked place is unmasked, or one that isn't is masked again (never in the last step)."""
    again = F.when(t + dt < 1, F.lit(dt * noise)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), F.when(masked, dt * (1 + noise * t) / (1 - t)).otherwise(again))


def velocity_transition(p: Column, current: Column, t: Column, dt: float, noise: float, a: float = 1.0, b: float = 1.0, kind: str = "identity") -> Column:
    """Forward and backward velocities combined, clamped at 0."""
    s, slope = schedule(kind, t), schedule_slope(kind, t)
    beta = noise * F.pow(t, F.lit(a)) * F.pow(1 - t, F.lit(b))
    size = F.size(p)

    def step(v: Column, i: Column) -> Column:
        at = (i == current).cast("double")
        return F.greatest(F.lit(0.0), at + dt * ((1 + beta) * (v - at) * slope / (1 - s) - beta * (at - 1.0 / size) * slope / s))

    return F.transform(p, step)


def pick(p: Column, u: Column) -> Column:
    """The category where the cumulative sum of p, normalised, first exceeds u in [0, 1)."""
    upto = F.aggregate(
        p,
        F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("all")),
        lambda s, v: F.struct((s["sum"] + v).alias("sum"), F.concat(s["all"], F.array(s["sum"] + v)).alias("all")),
        lambda s: s["all"],
    )
    place = lambda s: F.get(F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.get(s, i) > u * F.element_at(s, -1)), F.lit(0))
    return F.coalesce(let(upto, place), F.size(p) - 1)


def interpolated(prior: Column, data: Column, t: Column | float) -> Column:
    """(1 - t) prior + t data, element by element."""
    return F.zip_with(prior, data, lambda a, b: (1 - t) * a + t * b)


def discrete_interpolated(prior: Column, data: Column, u: Column, t: Column | float) -> Column:
    """Places whose uniform draw exceeds t keep the prior's value, the others take the data's."""
    return F.transform(F.arrays_zip(prior.alias("a"), data.alias("b"), u.alias("u")), lambda z: F.when(z["u"] > t, z["a"]).otherwise(z["b"]))


def hash_uniform(*key: Column, seed: int | str) -> Column:
    """A uniform number in [0, 1) from the first eight hex digits of an MD5; the same on any partitioning and engine."""
    text = F.concat_ws(":", *(k.cast("string") for k in key), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def hash_normal(*key: Column, seed: int | str) -> Column:
    """A standard normal number from two uniform ones (Box and Muller); the same on any partitioning and engine."""
    u, v = hash_uniform(*key, seed=f"{seed}:0"), hash_uniform(*key, seed=f"{seed}:1")
    # 1 - u is in (0, 1].
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def gaussian_feature(*key: Column, mean: float, std: float, most: float | None = None, seed: int | str) -> Column:
    """A normal draw of each row, most at most."""
    out = mean + std * hash_normal(*key, seed=seed)
    return out if most is None else F.least(out, F.lit(float(most)))


def uniform_feature(*key: Column, low: float = 0.0, high: float = 1.0, seed: int | str) -> Column:
    return low + (high - low) * hash_uniform(*key, seed=seed)


STRATEGIES = ("sample", "mask", "velocity")


def category_step(strategy: str, p: Column, current: Column, t: Column, dt: float, noise: float, u: Column, again: Column | None = None, masked: int = 0) -> Column:
    """The next category of a place under one integration step.

    sample and velocity draw from the transition's probabilities by u. mask: a masked place takes a category drawn from
    p by u, any other goes back to `masked`, where the draw `again` is below the transition's probability.
    """
    if strategy == "sample":
        return pick(uniform_transition(p, current, t, dt, noise), u).cast("int")
    if strategy == "velocity":
        return pick(velocity_transition(p, current, t, dt, noise), u).cast("int")
    if strategy == "mask":
        hidden = current == masked
        moved = F.when(hidden, pick(p, u).cast("int")).otherwise(F.lit(masked))
        return F.when(again < mask_transition(hidden, t, dt, noise), moved).otherwise(current.cast("int"))
    raise ValueError(f"unknown strategy {strategy}, not one of {', '.join(STRATEGIES)}")


def integrator_step(x: Column, velocity: Column, p: Column, current: Column, t: Column, dt: float, u: Column, strategy: str = "sample", noise: float = 0.0, kind: str = "identity", again: Column | None = None) -> Column:
    """One step of a state: struct of coords (Euler, number by number) and category (by strategy)."""
    coords = F.zip_with(x, velocity, lambda a, v: euler_step(a, v, t, dt, kind))
    return F.struct(coords.alias("coords"), category_step(strategy, p, current, t, dt, noise, u, again).alias("category"))


def total_variation(p: Column, q: Column) -> Column:
    return 0.5 * total(F.zip_with(p, q, lambda a, b: F.abs(a - b)))


def time_weight(t: Column, most: float = 10.0) -> Column:
    """Loss weight t / (1 - t), most at most."""
    return F.least(F.lit(most), F.try_divide(t, 1 - t))


def cross_entropy(p: Column, target: Column, least: float = 1e-12) -> Column:
    return -F.log(F.greatest(F.get(p, target), F.lit(least)))


def dombi_and(p: Column, q: Column, power: float = 1.0, least: float = 1e-10) -> Column:
    """Dombi conjunction of two distributions, element by element, normalised."""
    low = lambda v: F.pow(F.greatest(v, F.lit(least)), F.lit(-power))
    return normalised(F.zip_with(p, q, lambda a, b: F.pow(low(a) + low(b), F.lit(-1.0 / power))))


def dombi_not(p: Column, null: Column, least: float = 1e-10) -> Column:
    """Negation of a distribution against the unconditional one: its square over p, normalised."""
    up = lambda v: F.greatest(v, F.lit(least))
    return normalised(F.zip_with(p, null, lambda a, b: up(b) * up(b) / up(a)))


def combined_guidance(on: list[Column], off: list[Column], weight: float, mean: bool = True) -> Column:
    """p times the product of (on / off)^(weight / count) over conditions; the first of on is the base."""
    share = weight / (len(on) if mean else 1)
    out = on[0]
    for a, b in zip(on, off, strict=True):
        out = F.zip_with(out, F.zip_with(a, b, lambda x, y: F.pow(x / y, F.lit(share))), lambda x, y: x * y)
    return out
