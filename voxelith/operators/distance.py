"""Distance transforms by axis passes (Felzenszwalb and Huttenlocher's decomposition).

A slice (x, y) of one z and t is one group and does two passes, a slab (z, t) of
one y the others: two shuffles, whatever the volume's size. Groups hold a slice.
The kernels take time in the length of a line, but for the chessboard metric's, which takes its square; all are exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stencil import KEY

INF = np.inf


def _envelope(f: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Minimum over p of f[p] + (at[p] - at[q])^2 along the first axis: the lower envelope of parabolas.

    All lines of the other axes advance together; over all steps a line adds and
    removes each of its parabolas once, so the time is linear in a line's length.
    """
    n = len(at)
    flat = f.reshape(n, -1)
    lines = np.arange(flat.shape[1])
    stack = np.zeros((n, len(lines)), np.int64)  # parabolas of the envelope, and where each takes over
    start = np.full((n + 1, len(lines)), INF)
    top = np.full(len(lines), -1)
    for q in range(n):
        new = lines[np.isfinite(flat[q])]
        cross = np.full(len(lines), -INF)
        todo = new[top[new] >= 0]
        while len(todo):
            v = stack[top[todo], todo]
            cross[todo] = (flat[q, todo] + at[q] ** 2 - flat[v, todo] - at[v] ** 2) / (2 * (at[q] - at[v]))
            under = todo[cross[todo] <= start[top[todo], todo]]
            top[under] -= 1
            cross[under[top[under] < 0]] = -INF
            todo = under[top[under] >= 0]
        top[new] += 1
        stack[top[new], new] = q
        start[top[new], new] = cross[new]
        start[top[new] + 1, new] = INF
    out, now = np.full_like(flat, INF), np.zeros(len(lines), np.int64)
    some = lines[top >= 0]
    for q in range(n):
        on = some
        while len(on := on[start[now[on] + 1, on] < at[q]]):
            now[on] += 1
        v = stack[now[some], some]
        out[q, some] = flat[v, some] + (at[q] - at[v]) ** 2
    return out.reshape(f.shape)


def _pass(f: np.ndarray, positions: np.ndarray, spacing: float, metric: str) -> np.ndarray:
    """Minimum over the first axis: f[p] joined with the distance of p and q."""
    at = positions * spacing
    if metric == "euclid":
        return _envelope(f, at)
    if metric == "city":
        x = at.reshape(-1, *[1] * (f.ndim - 1))
        ahead = np.minimum.accumulate(f - x, axis=0) + x
        return np.minimum(ahead, (np.minimum.accumulate((f + x)[::-1], axis=0))[::-1] - x)
    gap = np.abs(at[:, None] - at[None, :])
    out = np.full_like(f, INF)
    for p in range(len(positions)):  # the largest axis counts: no envelope
        np.minimum(out, np.maximum(f[p][None], gap[p].reshape(-1, *[1] * (f.ndim - 1))), out=out)
    return out


def _grid(along: str, axes, speed: dict[str, float], metric: str):
    """Passes along some of the axes of a group, which has a value for each of its places."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = [np.unique(pdf[a].to_numpy(), return_inverse=True) for a in axes]
        grid = np.full([len(p) for p, _ in at], INF)
        place = tuple(i for _, i in at)
        grid[place] = pdf["f_"].to_numpy()
        for k, a in enumerate(axes):
            if a in along and len(at[k][0]) > 1:
                grid = np.moveaxis(_pass(np.ascontiguousarray(np.moveaxis(grid, k, 0)), at[k][0].astype(float), speed[a], metric), 0, k)
        return pdf.assign(f_=grid[place])

    return run


#: Small volumes whose passes are made together.
TOGETHER = 16


def dense(vox: DataFrame, dims) -> DataFrame:
    """KEY of every cell of each volume of vox."""
    cells = 1
    for n in dims:
        cells *= n
    out = vox.select("vol_id").distinct().crossJoin(vox.sparkSession.range(cells))  # every cell is wanted
    index = F.col("id")
    for a, n in zip("xyzt", dims):
        out, index = out.withColumn(a, (index % n).cast("int")), F.floor(index / n)
    return out.drop("id")


def few_volumes() -> Column:
    """Number of the group of small volumes that vol_id goes with."""
    return F.floor(F.col("vol_id") / TOGETHER)


def distance(vox: DataFrame, seed: str, spacing=(1.0, 1.0, 1.0, 1.0), metric: str = "euclid", dims=None, by_volume: bool = False, only: str | None = None) -> DataFrame:
    """KEY and d of every voxel: distance to the nearest voxel where `seed` is true; squared for 'euclid'.

    metric: euclid, city (sum) or chess (largest axis). d is null where the
    volume has no seed. Passes carry values through all cells, so give dims
    where cells may be absent; they are neither seeds nor obstacles. by_volume is for many small volumes: a few are one group, which does all their passes and needs no
    dims. A table that is dealt out by few_volumes() isn't shuffled for that. only: a condition on vox; other voxels get no row, without a join.
    """
    speed = dict(zip("xyzt", spacing))
    wanted = F.lit(True) if only is None else F.coalesce(F.expr(only), F.lit(False))
    rows = vox.select(*KEY, F.when(F.expr(seed), 0.0).otherwise(F.lit(INF)).alias("f_"), wanted.alias("only_"))
    if dims is not None:
        rows = dense(vox, dims).join(rows, KEY, "left").select(*KEY, F.coalesce("f_", F.lit(INF)).alias("f_"), F.coalesce("only_", F.lit(False)).alias("only_"))
    if by_volume:
        make = _grid("xyzt", ("vol_id", *"xyzt"), speed, metric)
        rows = rows.withColumn("few", few_volumes()).groupBy("few").applyInPandas(lambda pdf: make(pdf)[pdf["only_"]].drop(columns="few"), rows.schema)
    else:
        rows = rows.groupBy("vol_id", "z", "t").applyInPandas(_grid("xy", "xy", speed, metric), rows.schema)
        rows = rows.groupBy("vol_id", "y").applyInPandas(_grid("zt", "ztx", speed, metric), rows.schema)
    return rows.where("only_").select(*KEY, F.when(F.col("f_") < F.lit(INF), F.col("f_")).alias("d"))
