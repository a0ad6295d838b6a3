"""Neighbourhoods and stencils on long volume tables.

gather() sends every voxel to its neighbours and itself and aggregates by place:
one shuffle with partial aggregates, where a join would need two.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["vol_id", "x", "y", "z", "t"]
AXES = "xyzt"


def offsets(ndim: int, kind: str = "full") -> list[tuple[int, int, int, int]]:
    """Offsets (dx, dy, dz, dt): 'face' differs on one axis, 'full' on any, 'edge' on one or two; by length, then lexicographic."""
    most = {"face": 1, "edge": 2, "full": ndim}[kind]
    found = [(*d, *[0] * (4 - ndim)) for d in product((-1, 0, 1), repeat=ndim) if 0 < sum(map(abs, d)) <= most]
    return sorted(found, key=lambda d: (sum(c * c for c in d), d))


def causal(offs, forward: bool = False):
    """The half of a neighbourhood that precedes (or follows) in raster order, the last axis slowest."""
    return [d for d in offs if (tuple(reversed(d)) > (0, 0, 0, 0)) == forward]


def _array(offs) -> Column:
    return F.array(*(F.struct(*(F.lit(c).alias(f"d{a}") for a, c in zip(AXES, d)), F.lit(sum(c * c for c in d)).alias("len2")) for d in offs))


def shifted(vox: DataFrame, offs, keep: list[str]) -> DataFrame:
    """One row per voxel and offset: the place it is sent to, keep columns, and the offset from receiver to sender."""
    rows = vox.select(*KEY, *keep, F.explode(_array(offs)).alias("o"))
    place = [(F.col(a) - F.col(f"o.d{a}")).cast("int").alias(a) for a in AXES]
    return rows.select("vol_id", *place, *keep, "o")


def gather(vox: DataFrame, offs, aggs: dict[str, Column], values: list[str]) -> DataFrame:
    """vox keys and values, with aggregates over the voxels present at offs.

    In aggs, columns named in values and o (dx, dy, dz, dt, len2) are those of
    a neighbour; wrap them in near(). Absent neighbours give no rows: use n_near
    to tell borders. A place is kept only where vox has a voxel.
    """
    rows = shifted(vox, [(0, 0, 0, 0), *offs], values)
    own = F.col("o.len2") == 0
    centre = [F.max(F.when(own, F.struct(*values))).alias("c_")] if values else []
    out = rows.groupBy(*KEY).agg(F.max(own.cast("int")).alias("own_"), *centre, F.sum((~own).cast("long")).alias("n_near"), *(a.alias(n) for n, a in aggs.items()))
    return out.where("own_ = 1").select(*KEY, *(F.col(f"c_.{v}").alias(v) for v in values), "n_near", *aggs)


def near(value: Column) -> Column:
    """value where the row of gather() is a neighbour's, else null."""
    return F.when(F.col("o.len2") > 0, value)


def linear_index(dims: tuple[int, int, int, int]) -> Column:
    """x + nx * (y + ny * (z + nz * t)), x fastest."""
    nx, ny, nz, _ = dims
    return F.col("x").cast("long") + nx * (F.col("y") + ny * (F.col("z") + nz * F.col("t").cast("long")))


def subscripts(index: Column, dims: tuple[int, int, int, int]) -> list[Column]:
    out = []
    for a, n in zip(AXES, dims):
        out.append((index % n).cast("int").alias(a))
        index = F.floor(index / n)
    return out


def surface(fg: DataFrame, ndim: int, kind: str = "face", border: int = 0, dims=None) -> DataFrame:
    """Foreground voxels with a zero neighbour. border says what lies outside: 0 makes the volume's edge surface, 1 doesn't.

    fg holds foreground rows only; dims is needed for border = 1.
    """
    offs = offsets(ndim, kind)
    counted = gather(fg, offs, {}, [])
    if border == 0:
        return counted.where(F.col("n_near") < len(offs)).select(*KEY)
    inside = F.lit(0)
    for d in offs:
        ok = F.lit(True)
        for a, c, n in zip(AXES, d, dims):
            if c:
                ok = ok & (F.col(a) + c).between(0, n - 1)
        inside = inside + ok.cast("int")
    return counted.where(F.col("n_near") < inside).select(*KEY)


def along(vox: DataFrame, axis: str):
    """Window over the rows of a dense volume along one axis."""
    return Window.partitionBy("vol_id", *(a for a in AXES if a != axis)).orderBy(axis)


def step(value: str, axis: str, k: int) -> Column:
    """The value k cells along the axis, or null where that cell is absent, by place and not by row."""
    w = Window.partitionBy("vol_id", *(a for a in AXES if a != axis)).orderBy(axis).rangeBetween(k, k)
    return F.max(value).over(w)


def convolve(vox: DataFrame, taps: list[float], axis: str, value: str = "val", out: str = "conv") -> DataFrame:
    """Centred correlation with taps along one axis, zero outside; one window, the axis' range as frame."""
    half = len(taps) // 2
    total = F.lit(0.0)
    for k, tap in enumerate(taps):
        total = total + F.lit(float(tap)) * F.coalesce(step(value, axis, k - half), F.lit(0.0))
    return vox.withColumn(out, total)


def gaussian_taps(sigma: float, length: int, normalise: bool = True) -> list[float]:
    import math

    taps = [math.exp(-((i - length // 2) ** 2) / (2 * sigma * sigma)) for i in range(length)]
    total = sum(taps) if normalise else 1.0
    return [t / total for t in taps]


def gradient(vox: DataFrame, axes: str = "xyz", value: str = "val") -> DataFrame:
    """g_x ..: central differences (next - previous), the centre's value at borders."""
    return vox.withColumns({f"g_{a}": F.coalesce(step(value, a, 1), F.col(value)) - F.coalesce(step(value, a, -1), F.col(value)) for a in axes})


def particle_values(vox: DataFrame, particles: DataFrame, ndim: int, value: str, default) -> DataFrame:
    """particles with the value at their place by the first ndim axes, the others being 0; the default where there is no voxel."""
    if ndim not in (1, 2, 3, 4):
        raise ValueError(f"{ndim} dimensions")
    used = AXES[:ndim]
    flat = vox.where(" AND ".join(f"{a} = 0" for a in AXES[ndim:]) or "true").select("vol_id", *used, F.col(value).alias("found_"))
    return particles.join(flat, ["vol_id", *used], "left").withColumn(value, F.coalesce("found_", F.lit(default))).drop("found_")


def set_particle_values(vox: DataFrame, particles: DataFrame, ndim: int, value: str) -> DataFrame:
    """KEY and value of vox, with the particles' value at their places (first ndim axes, the others 0); places outside vox are ignored.

    Of several particles at a place the greatest value counts.
    """
    if ndim not in (1, 2, 3, 4):
        raise ValueError(f"{ndim} dimensions")
    used = AXES[:ndim]
    new = particles.groupBy("vol_id", *used).agg(F.max(value).alias("new_"))
    hit = F.col("new_").isNotNull()
    for a in AXES[ndim:]:
        hit = hit & (F.col(a) == 0)
    return vox.join(new, ["vol_id", *used], "left").select(*KEY, F.when(hit, F.col("new_")).otherwise(F.col(value)).alias(value))
