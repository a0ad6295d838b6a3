"""Reaction-diffusion and smoothing on volumes.

The default is synchronous (all voxels from the last round's values): one
aggregate by place and round, for volumes of any size. order='raster' updates in
place in index order, as a grouped map by volume, for results that depend on that order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut
from .stencil import AXES, KEY, gather, near, offsets


def reaction(c: Column, k=(1.0, 0.0, 0.0, 1.0)) -> Column:
    """c * (f1 - mean) of the replicator equation with pay-offs k."""
    f1, f2 = k[0] * c + k[1] * (1 - c), k[2] * c + k[3] * (1 - c)
    return c * (f1 - (c * f1 + (1 - c) * f2))


def react_diffuse(vox: DataFrame, value: str, rounds: int = 4, k=(1.0, 0.0, 0.0, 1.0), speed=(0.125, 0.125, 0.125, 0.125), rate: float = 0.25, ndim: int = 3, order: str = "jacobi", mix: float | None = None, fixed: str | None = None, split: bool = False) -> DataFrame:
    """KEY and value after `rounds` steps of c += rate * (reaction + sum of speed * (neighbour - c)), kept in [0, 1]. Absent neighbours count as the centre.

    With mix, the step is rate * (mix * reaction + (1 - mix) * diffusion by mean
    speed). With split, the whole diffusion is added first, and rate * reaction of
    the outcome then. Voxels whose column `fixed` isn't 0 keep their value.
    """
    if order == "raster":
        return _raster(vox, value, rounds, k, speed, rate, ndim)
    faces = offsets(ndim, "face")
    pull = sum(F.lit(float(s)) * F.abs(F.col(f"o.d{a}")) for a, s in zip(AXES, speed))
    total = 2.0 * sum(speed[:ndim])
    also = [fixed] if fixed else []
    for n in range(rounds):
        g = gather(vox.select(*KEY, value, *also), faces, {"pulled": F.coalesce(F.sum(near(pull * F.col(value))), F.lit(0.0)), "weight": F.coalesce(F.sum(near(pull)), F.lit(0.0))}, [value, *also])
        c = F.col(value)
        spread = F.col("pulled") - F.col("weight") * c
        base, spread = (c + spread, F.lit(0.0)) if split else (c, spread)
        new = base + rate * (reaction(base, k) + spread if mix is None else mix * reaction(base, k) + (1 - mix) / total * spread)
        new = F.least(F.greatest(new, F.lit(0.0)), F.lit(1.0))
        vox = g.select(*KEY, (F.when(F.col(fixed) != 0, c).otherwise(new) if fixed else new).alias(value), *also)
        if n % 4 == 3 and n + 1 < rounds:
            vox = cut(vox, "diffusion")
    return vox


def relax(vox: DataFrame, value: str, rounds: int = 5, alpha: float = 0.5, ndim: int = 3) -> DataFrame:
    """KEY and value after rounds of alpha * v + (1 - alpha) * mean of the face neighbours; absent ones count as the centre."""
    faces = offsets(ndim, "face")
    for n in range(rounds):
        g = gather(vox.select(*KEY, value), faces, {"s": F.coalesce(F.sum(near(F.col(value))), F.lit(0.0))}, [value])
        mean = (F.col("s") + (len(faces) - F.col("n_near")) * F.col(value)) / len(faces)
        vox = g.select(*KEY, (alpha * F.col(value) + (1 - alpha) * mean).alias(value))
        if n % 4 == 3 and n + 1 < rounds:
            vox = cut(vox, "smoothing")
    return vox


def _raster(vox, value, rounds, k, speed, rate, ndim):
    faces = offsets(ndim, "face")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(reversed(AXES))).reset_index(drop=True)
        at = {p: i for i, p in enumerate(zip(*(pdf[a] for a in AXES)))}
        c = pdf[value].to_numpy(float).copy()
        around = [[(at.get(tuple(p[j] + d[j] for j in range(4)), i), next(s for s, x in zip(speed, d) if x)) for d in faces] for p, i in at.items()]
        for _ in range(rounds):
            for i in range(len(c)):
                v = c[i]
                f1, f2 = k[0] * v + k[1] * (1 - v), k[2] * v + k[3] * (1 - v)
                v += rate * (v * (f1 - (v * f1 + (1 - v) * f2)) + sum(s * (c[j] - v) for j, s in around[i]))
                c[i] = min(max(v, 0.0), 1.0)
        return pdf.assign(**{value: c})

    rows = vox.select(*KEY, F.col(value).cast("double").alias(value))
    return rows.groupBy("vol_id").applyInPandas(run, rows.schema)


def smooth_patches(vox: DataFrame, value: str, rounds: int = 1, tau: float = 1.0, lam: float = 1.0, limit: float | None = None) -> DataFrame:
    """KEY and value of in-slice smoothing by quadratic patches over the four neighbours, interior voxels only.

    A step moves the value by the patch's curvature, weighted lam / (tau + 4 lam);
    a neighbour further than `limit` in value is replaced by the centre.
    """
    faces = offsets(2, "face")
    for _ in range(rounds):
        rows = vox.select(*KEY, value)
        spread = gather(rows, faces, {"ns": F.collect_list(near(F.col(value)))}, [value])  # four values
        c = F.col(value)
        used = F.transform("ns", lambda v: F.when(F.abs(v - c) > limit, c).otherwise(v)) if limit is not None else F.col("ns")
        total = F.aggregate(used, F.lit(0.0), lambda a, v: a + v)
        moved = (tau * c + lam * total) / (tau + 4 * lam)
        vox = spread.select(*KEY, F.when(F.col("n_near") == 4, moved).otherwise(c).alias(value))
    return vox
