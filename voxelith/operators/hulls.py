"""Convex hulls, carving by half-spaces and boundary refinement."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut, maybe_broadcast, rows_of
from .stencil import AXES, KEY, gather, near, offsets

#: Points whose hulls one task makes, about.
POINTS_A_TASK = 10_000

HULL_SCHEMA = "vol_id bigint, facet int, nx double, ny double, nz double, offset double, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double"


def hull3(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Facets (three point numbers), outward unit normals and offsets of the hull, or None for flat or few points.

    Points are added one by one; facets that see the new point are replaced by
    the cone from it over their horizon. All facets of a step are made at once, and points within the hull so far are passed over at once.
    """
    pts = np.unique(points.astype(float), axis=0)
    if len(pts) < 4:
        return None
    far = lambda d: int(np.argmax(d))
    a = 0
    b = far(((pts - pts[a]) ** 2).sum(1))
    c = far((np.cross(pts - pts[a], pts[b] - pts[a]) ** 2).sum(1))
    n = np.cross(pts[b] - pts[a], pts[c] - pts[a])
    d = far(np.abs((pts - pts[a]) @ n))
    if abs((pts[d] - pts[a]) @ n) < 1e-9:
        return None
    centre = pts[[a, b, c, d]].mean(0)

    def facets(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The facets with extent, turned outward, and their planes."""
        p, u, v = pts[f[:, 0]], pts[f[:, 1]] - pts[f[:, 0]], pts[f[:, 2]] - pts[f[:, 0]]
        m = u[:, [1, 2, 0]] * v[:, [2, 0, 1]] - u[:, [2, 0, 1]] * v[:, [1, 2, 0]]
        size = np.sqrt((m * m).sum(1))
        some = size > 1e-12
        f, p, m = f[some], p[some], m[some] / size[some, None]
        turn = (m * (centre - p)).sum(1) > 0
        m[turn] = -m[turn]
        f[turn] = f[turn][:, [0, 2, 1]]
        return f, np.column_stack([m, (m * p).sum(1)])

    faces, planes = facets(np.array(list(combinations((a, b, c, d), 3))))
    i = 0
    while len(out := np.flatnonzero((pts[i:] @ planes[:, :3].T - planes[:, 3] > 1e-9).any(axis=1))):
        i += int(out[0])
        seen = planes[:, :3] @ pts[i] - planes[:, 3] > 1e-9
        edges = dict.fromkeys(e for f in faces[seen].tolist() for e in ((f[0], f[1]), (f[1], f[2]), (f[2], f[0])))
        cone = facets(np.array([(*e, i) for e in edges if (e[1], e[0]) not in edges]))
        faces, planes = np.concatenate([faces[~seen], cone[0]]), np.concatenate([planes[~seen], cone[1]])
        i += 1
    return pts, faces, planes


def hull_facets(points: DataFrame) -> DataFrame:
    """HULL_SCHEMA rows of the hull of each volume's points (x, y, z). Give surface points: a volume's are one group.

    Hulls take long for their few bytes, so the volumes are dealt out by the count of points.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made = hull3(pdf[["x", "y", "z"]].to_numpy())
        names = [c.split()[0] for c in HULL_SCHEMA.split(", ")]
        if made is None:
            return pd.DataFrame(columns=names)
        pts, faces, planes = made
        corner = pts[faces].reshape(len(faces), 9)
        return pd.DataFrame(np.column_stack([np.full(len(faces), pdf["vol_id"].iloc[0]), np.arange(len(faces)), planes, corner]), columns=names).astype({"vol_id": int, "facet": int})

    points = cut(points.select("vol_id", "x", "y", "z").distinct(), "hull-points")
    return points.repartition(1 + rows_of(points) // POINTS_A_TASK, "vol_id").groupBy("vol_id").applyInPandas(run, HULL_SCHEMA)


def carve(vox: DataFrame, planes: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """vox rows inside all half-spaces (vol_id, nx, ny, nz, perhaps nt, offset): n . p - offset at most tolerance.

    Planes are packed into one row by volume, so each voxel is read once and no pairs are made.
    """
    axes = [a for a in AXES if f"n{a}" in planes.columns]
    packed = planes.groupBy("vol_id").agg(F.collect_list(F.struct(*(f"n{a}" for a in axes), "offset")).alias("ps"))
    inside = F.forall("ps", lambda p: sum(p[f"n{a}"] * F.col(a) for a in axes) - p["offset"] <= tolerance)
    return vox.join(maybe_broadcast(packed, planes.count()), "vol_id").where(inside).select(*vox.columns)


def facet_planes(points: DataFrame, facets: DataFrame) -> DataFrame:
    """vol_id, nx, ny, nz, nt, offset: unit normals of four-dimensional facets, away from the mean of the volume's points.

    points: vol_id, idx, x, y, z, t; facets: vol_id, p0, p1, p2, p3 (idx). Facets
    without extent, or whose plane holds the mean, have no row.
    """
    mean = points.groupBy("vol_id").agg(*(F.avg(a).alias(f"m{a}") for a in AXES))
    rows = facets.select("vol_id", "p0", "p1", "p2", "p3")
    for k in range(4):
        corner = points.select("vol_id", F.col("idx").alias(f"p{k}"), *(F.col(a).cast("double").alias(f"{a}{k}") for a in AXES))
        rows = rows.join(corner, ["vol_id", f"p{k}"])
    edge = [[F.col(f"{a}{k}") - F.col(f"{a}0") for a in AXES] for k in (1, 2, 3)]

    def minor(skip: int):
        u, v, w = ([e[j] for j in range(4) if j != skip] for e in edge)
        return u[0] * (v[1] * w[2] - v[2] * w[1]) - u[1] * (v[0] * w[2] - v[2] * w[0]) + u[2] * (v[0] * w[1] - v[1] * w[0])

    rows = rows.join(mean, "vol_id").select("vol_id", *(f"{a}0" for a in AXES), *(f"m{a}" for a in AXES), *((minor(j) if j % 2 == 0 else -minor(j)).alias(f"c{a}") for j, a in enumerate(AXES)))
    outward = sum(F.col(f"c{a}") * (F.col(f"{a}0") - F.col(f"m{a}")) for a in AXES)
    rows = rows.withColumn("way", F.signum(outward) / F.sqrt(sum(F.col(f"c{a}") * F.col(f"c{a}") for a in AXES))).where(outward != 0)
    rows = rows.select("vol_id", *(f"{a}0" for a in AXES), *((F.col("way") * F.col(f"c{a}")).alias(f"n{a}") for a in AXES))
    return rows.select("vol_id", *(f"n{a}" for a in AXES), sum(F.col(f"n{a}") * F.col(f"{a}0") for a in AXES).alias("offset"))


def carve_hull(vox: DataFrame, points: DataFrame, facets: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """vox rows inside the bounding box of the volume's points and on the inner side of all its facets, in four dimensions."""
    box = points.groupBy("vol_id").agg(*(f(a).alias(f"{n}{a}") for a in AXES for n, f in (("l", F.min), ("g", F.max))))
    held = vox.join(maybe_broadcast(box), "vol_id").where(" AND ".join(f"{a} BETWEEN l{a} AND g{a}" for a in AXES)).select(*vox.columns)
    planes = facet_planes(points, facets)
    flat = held.join(planes.select("vol_id").distinct(), "vol_id", "left_anti")  # no facet: the box alone
    return carve(held, planes, tolerance).unionByName(flat)


def refine_boundary(segment: DataFrame, label: DataFrame, ndim: int = 3) -> DataFrame:
    """KEY of label voxels outside the segment that lie between a segment voxel and a background place on opposite sides."""
    both = label.select(*KEY).join(segment.select(*KEY).withColumn("s", F.lit(1)), KEY, "left").withColumn("s", F.coalesce("s", F.lit(0)))
    faces = offsets(ndim, "face")
    aggs = {f"d{i}": F.max(near(F.when(F.struct(*(F.col(f"o.d{a}") for a in "xyzt")) == F.struct(*(F.lit(c) for c in d)), F.col("s")))) for i, d in enumerate(faces)}
    g = gather(both, faces, aggs, ["s"])
    squeezed = F.lit(False)
    for i, d in enumerate(faces):
        j = faces.index(tuple(-c for c in d))
        squeezed = squeezed | ((F.coalesce(F.col(f"d{i}"), F.lit(0)) == 1) & F.col(f"d{j}").isNull())
    return g.where((F.col("s") == 0) & squeezed).select(*KEY)
