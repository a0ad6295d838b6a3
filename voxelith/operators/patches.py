"""Smoothing by polynomial patches.

Each voxel holds a small polynomial about its own place. A round replaces it by the
least-squares fit to the patches of its face neighbours: a fixed linear map of their
coefficients, so a round is one shuffle of a row to each neighbour, for volumes of any size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut
from .stencil import AXES, KEY, gather, offsets

# Exponents of the patches' terms over the axes, in the order of coefficient files; the constant comes first.
QUADRATIC = [(0, 0), (2, 0), (1, 0), (0, 2), (0, 1), (1, 1)]
CUBIC = [(0, 0), (3, 0), (2, 1), (1, 2), (0, 3), (2, 0), (1, 1), (0, 2), (1, 0), (0, 1)]
DENSITY = [(0, 0, 0), (2, 0, 0), (1, 0, 0), (0, 2, 0), (0, 1, 0), (0, 0, 2), (0, 0, 1)]


def _row(terms, at, axis: int | None = None) -> list[float]:
    """The terms at a place, or their derivative along an axis there."""
    out = []
    for powers in terms:
        value = 1.0
        for k, (p, c) in enumerate(zip(powers, at)):
            if k == axis:
                value *= p * c ** (p - 1) if p else 0.0
            else:
                value *= float(c) ** p
        out.append(value)
    return out


def contact_rows(terms, offset, tau: float, lam: float, cross: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the terms of a voxel's patch and of its neighbour's that should agree.

    The two patches meet at both places, tau apart: in value, and with weight lam
    in slope, along all axes (cross) or only the one between them.
    """
    ndim = len(terms[0])
    step = [tau * c for c in offset[:ndim]]
    axes = range(ndim) if cross else [next(k for k, c in enumerate(offset) if c)]
    own, other = [], []
    for here, there in ((step, [0.0] * ndim), ([0.0] * ndim, [-c for c in step])):
        for weight, axis in [(1.0, None), *((np.sqrt(lam), k) for k in axes)]:
            own.append([weight * v for v in _row(terms, here, axis)])
            other.append([weight * v for v in _row(terms, there, axis)])
    return np.array(own), np.array(other)


def patch_gammas(terms, tau: float = 1.0, lam: float = 1.0, cross: bool = True) -> dict[tuple, list[list[float]]]:
    """Offset -> gamma: the best new patch is minus the sum of gamma times the neighbour's coefficients."""
    rows = {d: contact_rows(terms, d, tau, lam, cross) for d in offsets(len(terms[0]), "face")}
    inverse = np.linalg.pinv(sum(own.T @ own for own, _ in rows.values()))
    return {d: (-inverse @ own.T @ other).tolist() for d, (own, other) in rows.items()}


def smooth_by_patches(vox: DataFrame, value: str, gammas: dict, rounds: int = 1, limit: float | None = None, same: str | None = None, flat: bool = False, edges: bool = False) -> DataFrame:
    """KEY and value: the constants of the patches after synchronous rounds, which start with flat patches of the values.

    gammas maps face offsets to square matrices, from patch_gammas() or a file
    (sources.arrays). A neighbour that is further than `limit` in value, or differs
    in column `same`, is replaced by the voxel's own patch, or with flat by its own
    value alone. Voxels that lack a neighbour stay as they are, or with edges take
    their own patch for it. Null values stay null and count as differing.
    """
    names = [f"c{k}_" for k in range(len(next(iter(gammas.values()))))]
    also = [same] if same else []
    now = vox.select(*KEY, F.col(value).cast("double").alias(names[0]), *(F.lit(0.0).alias(c) for c in names[1:]), *also)
    for n in range(rounds):
        at = lambda d: F.struct(*(F.col(f"o.d{a}") for a in AXES)) == F.struct(*(F.lit(c) for c in d))
        seen = gather(now, list(gammas), {f"p{i}_": F.max(F.when(at(d), F.struct(*names, *also))) for i, d in enumerate(gammas)}, [*names, *also])
        patches = {}
        for i in range(len(gammas)):
            p = F.col(f"p{i}_")
            away = p[names[0]].isNull()
            if limit is not None:
                away = away | (F.abs(p[names[0]] - F.col(names[0])) > limit)
            if same:
                away = away | ~p[same].eqNullSafe(F.col(same))
            for k, c in enumerate(names):
                patches[f"p{i}_{k}_"] = F.when(away, F.lit(0.0) if flat and k else F.col(c)).otherwise(p[c])
        seen = seen.select(*KEY, *names, *also, "n_near", *(c.alias(name) for name, c in patches.items()))
        moved = []
        for j in range(len(names)):
            total = F.lit(0.0)
            for i, gamma in enumerate(gammas.values()):
                for k, g in enumerate(gamma[j]):
                    if abs(g) > 1e-14:
                        total = total - F.lit(float(g)) * F.col(f"p{i}_{k}_")
            moved.append(total)
        free = F.col(names[0]).isNotNull() if edges else (F.col("n_near") == len(gammas)) & F.col(names[0]).isNotNull()
        now = seen.select(*KEY, *(F.when(free, m).otherwise(F.col(c)).alias(c) for c, m in zip(names, moved)), *also)
        if n % 2 == 1 and n + 1 < rounds:
            now = cut(now, "patches")
    return now.select(*KEY, F.col(names[0]).alias(value))
