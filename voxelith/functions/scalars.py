"""Scalar functions on columns: rounding, geometry, ramps, sphere overlap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half(c: Column) -> Column:
    """Adds one half and truncates toward zero."""
    return (c + F.lit(0.5)).cast("int")


def length(*cs: Column) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, (c * c for c in cs)))


def dot(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda p, q: p + q, (x * y for x, y in zip(a, b)))


def cosine(a: list[Column], b: list[Column]) -> Column:
    """Null where a vector has no length."""
    n = length(*a) * length(*b)
    return F.when(n > 0, dot(a, b) / n)


def det3(m: list[list[Column]]) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def normal3(p: list[Column], q: list[Column], r: list[Column]) -> list[Column]:
    """The cross product of two edges of a facet; zero if it is degenerate."""
    u, v = [b - a for a, b in zip(p, q)], [b - a for a, b in zip(p, r)]
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def sphere_cap(r: Column, h: Column) -> Column:
    return F.lit(3.141592653589793) * h * h * (3 * r - h) / 3


def overlap_ratio(r1: Column, r2: Column, d: Column) -> Column:
    """Volume of the lens of two spheres over the smaller sphere's; 1 where one holds the other, 0 where they are apart."""
    small, large = F.least(r1, r2), F.greatest(r1, r2)
    h1 = (r2 - r1 + d) * (r2 + r1 - d) / (2 * d)
    h2 = (r1 - r2 + d) * (r1 + r2 - d) / (2 * d)
    lens = sphere_cap(r1, h1) + sphere_cap(r2, h2)
    return F.when(d >= r1 + r2, 0.0).when(d <= large - small, 1.0).otherwise(lens / (F.lit(4 * 3.141592653589793 / 3) * small * small * small))


#: Knots (intensity, membership) of the piecewise-linear ramps.
RAMPS = {
    "step": [(150, 0.0), (350, 1.0)],
    "low": [(100, 0.0), (500, 1.0)],
    "band": [(100, 0.0), (400, 1.0), (800, 0.0)],
    "soft_band": [(100, 0.0), (300, 0.2), (700, 0.0)],
}


def ramp(v: Column, name: str) -> Column:
    """Membership in [0, 1]; an unknown name is 'step'."""
    knots = RAMPS.get(name, RAMPS["step"])
    out = F.when(v <= knots[0][0], F.lit(knots[0][1]))
    for (a, p), (b, q) in zip(knots, knots[1:]):
        out = out.when(v <= b, p + (q - p) * (v - a) / float(b - a))
    return out.otherwise(F.lit(knots[-1][1]))
