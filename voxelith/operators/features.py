"""Composite descriptors of segments."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..plans.tables import cut
from .stencil import KEY


def box_offsets(wx: int, wy: int, wz: int):
    return [(x, y, z, 0) for x, y, z in product(range(-wx, wx + 1), range(-wy, wy + 1), range(-wz, wz + 1)) if (x, y, z) != (0, 0, 0)]


#: Cells along the side of a block, and volumes whose blocks of one place are compared in one group.
BLOCK, TOGETHER = 16, 16


def in_blocks(vox: DataFrame, width: int) -> DataFrame:
    """vox with bx, by, bz and own: each voxel in its block, and in those beside it that are at most width cells away.

    The first block of an axis begins width cells before 0, so a small volume lies in one.
    """
    out = vox
    for a in "xyz":
        out = out.withColumn(f"b{a}", F.explode(F.sequence(F.floor(F.col(a) / BLOCK), F.floor((F.col(a) + 2 * width) / BLOCK))))
    own = F.lit(True)
    for a in "xyz":
        own = own & (F.col(f"b{a}") == F.floor((F.col(a) + width) / BLOCK))
    return out.withColumn("own", own)


def sphericities(vox: DataFrame, value: str, windows: dict[str, tuple[int, int, int]]) -> DataFrame:
    """KEY, value and a column for each window: the share of the window's other cells with 0 < value < the centre's.

    Voxels meet by blocks, about once or twice each, not once for each cell of a window; a group is a block with its rim, of a few volumes.
    """
    width = max(n for w in windows.values() for n in w)
    kind = dict(vox.dtypes)[value]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = [pdf["vol_id"].to_numpy() % TOGETHER, *(pdf[a].to_numpy() - pdf[a].min() + width for a in "xyz")]
        values = pdf[value].to_numpy(dtype=float, na_value=np.nan)
        grid = np.zeros([p.max() + width + 1 for p in at])
        grid[tuple(at)] = np.nan_to_num(values, posinf=np.inf)
        own = pdf["own"].to_numpy()
        centre, v = [p[own] for p in at], values[own]
        out = pdf.loc[own, [*KEY, value]]
        for name, w in windows.items():
            offs, n = box_offsets(*w), np.zeros(len(v))
            for d in offs:
                near_ = grid[centre[0], *(p + c for p, c in zip(centre[1:], d))]
                n += (near_ > 0) & (near_ < v)
            out[name] = n / len(offs)
        return out

    rows = in_blocks(vox.select(*KEY, value), width).withColumn("few", F.floor(F.col("vol_id") / TOGETHER))
    fields = ", ".join(f"`{name}` double" for name in windows)
    return rows.groupBy("few", "t", "bx", "by", "bz").applyInPandas(run, f"vol_id bigint, x int, y int, z int, t int, `{value}` {kind}, {fields}")


def sphericity(vox: DataFrame, value: str, w=(1, 1, 1)) -> DataFrame:
    """KEY, value, sp: the share of the window's other cells with 0 < value < the centre's."""
    return sphericities(vox, value, {"sp": w})


@pandas_udf(T.ArrayType(T.DoubleType()))
def symmetric_eigenvalues(m: pd.Series) -> pd.Series:
    """Ascending eigenvalues of flattened symmetric 3 x 3 matrices."""
    if not len(m):
        return pd.Series([], dtype=object)
    return pd.Series(list(np.linalg.eigvalsh(np.stack(m.to_list()).reshape(-1, 3, 3))))


def eigenvalues3(xx, xy, xz, yy, yz, zz) -> list:
    """Ascending eigenvalues of a symmetric 3 x 3 matrix of columns, in closed form (the trigonometric roots)."""
    q = (xx + yy + zz) / 3
    p2 = (xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)
    p = F.sqrt(p2 / 6)
    a, b, c = (xx - q) / p, (yy - q) / p, (zz - q) / p
    d, e, f = xy / p, xz / p, yz / p
    half = (a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 2
    phi = F.acos(F.greatest(F.least(half, F.lit(1.0)), F.lit(-1.0))) / 3
    most, least = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2 * np.pi / 3)
    flat = p2 <= 0
    return [F.when(flat, q).otherwise(x) for x in (least, 3 * q - most - least, most)]


#: Fixed value: the scale of the squared small eigenvalues.
ISOTROPY_SCALE = 5000.0


def isotropy_shares(vox: DataFrame, value: str, width: int = 2) -> DataFrame:
    """KEY, wall, vessel, nodule: shares by the eigenvalues of the structure tensor about each voxel.

    The tensor adds up products of central differences (the centre's value at
    borders) over the voxels of a window of 2 * width + 1 cells: one stencil pass for
    the differences, one for the sums. With absolute eigenvalues e1 <= e2 <= e3, a wall
    has both small ones near 0, a nodule both near e3 / 2, a vessel one of each; null where e3 is 0.
    """
    from .stencil import gradient, offsets, shifted

    g = gradient(vox.select(*KEY, F.col(value).cast("double").alias(value)), "xyz", value)
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    g = g.select(*KEY, *((F.col(f"g_{a}") * F.col(f"g_{b}")).alias(f"t{a}{b}") for a, b in pairs))
    sent = shifted(g, [(0, 0, 0, 0), *box_offsets(width, width, width)], [f"t{a}{b}" for a, b in pairs])
    sums = sent.groupBy(*KEY).agg(*(F.sum(f"t{a}{b}").alias(f"t{a}{b}") for a, b in pairs)).join(vox.select(*KEY), KEY)
    e1, e2, e3 = (F.col(f"e{k}") for k in (1, 2, 3))
    ev = F.array_sort(F.array(*(F.abs(e) for e in eigenvalues3(*(F.col(f"t{a}{b}") for a, b in pairs)))))
    rows = sums.withColumn("ev", ev).select(*KEY, *(F.col("ev")[k].alias(f"e{k + 1}") for k in range(3)))
    small = lambda e: e * e / ISOTROPY_SCALE
    half = lambda e: (e - e3 / 2) * (e - e3 / 2) / (e3 * e3)
    shares = {"wall": F.exp(-(small(e1) + small(e2))), "vessel": F.exp(-(small(e1) + half(e2))), "nodule": F.exp(-(half(e1) + half(e2)))}
    total = shares["wall"] + shares["vessel"] + shares["nodule"]
    return rows.select(*KEY, *(F.when(e3 > 0, s / total).alias(k) for k, s in shares.items()))


def least_squares(df: DataFrame, names: list[str], target: str) -> np.ndarray:
    """Coefficients (intercept first) from the normal equations; sums are one distributed aggregate, the small system is solved here."""
    cols = [F.lit(1.0), *(F.col(n).cast("double") for n in names)]
    aggs = [F.sum(a * b) for a in cols for b in cols] + [F.sum(a * F.col(target)) for a in cols]
    sums = df.agg(*aggs).first()
    k = len(cols)
    return np.linalg.solve(np.array(sums[: k * k], float).reshape(k, k), np.array(sums[k * k :], float))


def size_features(fg: DataFrame, spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """vol_id, volume, length (longest axis of the covariance ellipse of the best slice), width, ratio, slice.

    The slice has the largest product of ellipse diameters; diameters are four
    times the roots of the covariance's eigenvalues in closed form.
    """
    vx, vy, vz = map(float, spacing)
    x, y = F.col("x") * vx, F.col("y") * vy
    by = fg.groupBy("vol_id", "z", "t").agg(F.count("*").alias("n"), F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), F.covar_pop(x, y).alias("xy"))
    mid, dif = (F.col("xx") + F.col("yy")) / 2, F.sqrt((F.col("xx") - F.col("yy")) * (F.col("xx") - F.col("yy")) / 4 + F.col("xy") * F.col("xy"))
    by = by.withColumn("a", 4 * F.sqrt(F.greatest(mid + dif, F.lit(0.0)))).withColumn("b", 4 * F.sqrt(F.greatest(mid - dif, F.lit(0.0))))
    best = by.groupBy("vol_id").agg(F.sum("n").alias("cells"), F.max(F.struct(F.round(F.col("a") * F.col("b"), 9).alias("p"), (-F.col("z")).alias("mz"), "a", "b")).alias("m"))
    ratio = F.when(F.col("m.a") > 0, F.col("m.b") / F.col("m.a")).otherwise(0.0)
    return best.select("vol_id", (F.col("cells") * vx * vy * vz).alias("volume"), F.col("m.a").alias("length"), F.col("m.b").alias("width"), ratio.alias("ratio"), (-F.col("m.mz")).alias("slice"))


#: Pairs of places that are compared at once.
PAIRS = 1 << 20


def _widths(vx: float, vy: float):
    """The major and minor of slices from their places in the order of y and x, many slices at once."""

    @pandas_udf("major double, minor double")
    def run(ys: pd.Series, xs: pd.Series) -> pd.DataFrame:
        size = ys.map(len).to_numpy(dtype=int)
        out, order, at = np.ones((len(size), 2)), np.argsort(size, kind="stable"), 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * size[order[end]] ** 2 <= PAIRS:
                end += 1
            now, at = order[at:end], end
            held = np.arange(size[now].max()) < size[now, None]
            x, y = np.zeros(held.shape), np.zeros(held.shape)
            x[held], y[held] = (v * np.concatenate([c.iloc[i] for i in now]) for v, c in ((vx, xs), (vy, ys)))
            dx, dy = x[:, :, None] - x[:, None], y[:, :, None] - y[:, None]
            d2 = np.where(held[:, :, None] & held[:, None], np.round(dx * dx + dy * dy, 9), -1.0).reshape(len(now), -1)
            best, k = d2.argmax(axis=1), np.arange(len(now))
            p, q = np.divmod(best, held.shape[1])
            long = np.sqrt(d2[k, best])
            unit = np.where(long > 0, long, 1.0)
            ux, uy = (x[k, p] - x[k, q]) / unit, (y[k, p] - y[k, q]) / unit
            off = np.where(held, (y - y[k, p, None]) * ux[:, None] - (x - x[k, p, None]) * uy[:, None], 0.0)
            out[now] = np.where((size[now] == 1)[:, None], 1.0, np.column_stack([long, np.maximum(off.max(axis=1), 0.0) - np.minimum(off.min(axis=1), 0.0)]) + 1)
        return pd.DataFrame(out, columns=["major", "minor"])

    return run


def slice_diameters(fg: DataFrame, spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """vol_id, z, major, minor, e_major, e_minor of each slice with voxels: diameters between voxels, and radii of the covariance's ellipse.

    major is the greatest distance of two voxels plus 1, minor the extent across
    it plus 1 (of equal distances, the pair that comes first by y and x counts). Both
    are reached at the first or last voxel of a row, so at most two places a row are compared. A single voxel has 1 throughout.
    """
    vx, vy = float(spacing[0]), float(spacing[1])
    row = fg.groupBy("vol_id", "z", "y").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    ends = F.flatten(F.collect_list(F.array_distinct(F.array(F.struct("y", F.col("x0").alias("x")), F.struct("y", F.col("x1").alias("x"))))))
    rows = row.groupBy("vol_id", "z").agg(F.sort_array(ends).alias("ps"))  # two a row
    direct = rows.select("vol_id", "z", _widths(vx, vy)(F.col("ps.y"), F.col("ps.x")).alias("m")).select("vol_id", "z", "m.major", "m.minor")
    x, y = F.col("x") * vx, F.col("y") * vy
    by = fg.groupBy("vol_id", "z").agg(F.count("*").alias("n"), F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), F.covar_pop(x, y).alias("xy"))
    ee = F.sqrt((F.col("xx") - F.col("yy")) * (F.col("xx") - F.col("yy")) + 4 * F.col("xy") * F.col("xy"))
    radius = lambda sign: F.when(F.col("n") == 1, 1.0).otherwise(F.sqrt(F.greatest(0.5 * (F.col("xx") + F.col("yy") + sign * ee), F.lit(0.0))))
    return direct.join(by.select("vol_id", "z", radius(1).alias("e_major"), radius(-1).alias("e_minor")), ["vol_id", "z"])


def _widest(major: str, minor: str):
    """By volume, the two diameters of the slice of their greatest product, the first such."""
    return F.max(F.struct(F.round(F.col(major) * F.col(minor), 9).alias("p"), (-F.col("z")).alias("mz"), major, minor))


def size_vector(fg: DataFrame, spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """vol_id and seven sizes: volume; mean (less 1) and ratio of the diameters of the widest slice; mean and ratio of the
    radii of the ellipse of its widest slice; the least eigenvalue of the covariance over the greatest and over the middle one (0 for flat ones)."""
    slices = slice_diameters(fg, spacing)
    wide = slices.groupBy("vol_id").agg(_widest("major", "minor").alias("m"), _widest("e_major", "e_minor").alias("e"))
    at = {a: F.col(a) * float(s) for a, s in zip("xyz", spacing)}
    cov = [F.covar_pop(at[a], at[b]).alias(f"c{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    whole = fg.groupBy("vol_id").agg((F.count("*") * float(spacing[0] * spacing[1] * spacing[2])).alias("volume"), *cov)
    whole = whole.select("vol_id", "volume", F.array(*eigenvalues3(*(F.col(f"c{p}") for p in ("xx", "xy", "xz", "yy", "yz", "zz")))).alias("ev"))
    low, mid, high = (F.col("ev")[k] for k in range(3))
    share = lambda a, b: F.when(F.round(b, 9) > 0, F.greatest(a, F.lit(0.0)) / b).otherwise(0.0)
    whole = whole.select("vol_id", "volume", share(low, high).alias("ellipsoid_ratio_1"), share(low, mid).alias("ellipsoid_ratio_2"))
    return whole.join(wide, "vol_id").select(
        "vol_id",
        "volume",
        ((F.col("m.major") + F.col("m.minor")) / 2 - 1).alias("diameter_mean"),
        (F.col("m.minor") / F.col("m.major")).alias("diameter_ratio"),
        ((F.col("e.e_major") + F.col("e.e_minor")) / 2).alias("ellipse_mean"),
        F.when(F.col("e.e_major") > 0, F.col("e.e_minor") / F.col("e.e_major")).otherwise(0.0).alias("ellipse_ratio"),
        "ellipsoid_ratio_1",
        "ellipsoid_ratio_2",
    )


def fitness_vector(depth: DataFrame, spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """vol_id and thirteen scores of each volume's foreground (KEY, d): voxels, volume; sphericity in windows of 5 where that
    in windows of 3 is greatest, and where the depth is; the greatest depth; mean and greatest diameter, and mean
    and greatest radius of the ellipse, of the widest slice and then of the slice of the greatest depth. Of equal places the first in raster order counts.
    """
    first = lambda v: F.min(F.struct((-F.round(v, 9)).alias("v"), "t", "z", "y", "x"))
    both = cut(sphericities(depth, "d", {"sp": (1, 1, 1), "wide": (2, 2, 2)}), "sphericities")
    tops = both.groupBy("vol_id").agg(F.count("*").alias("n"), F.max("d").alias("top"), first(F.col("sp")).alias("s"), first(F.col("d")).alias("m"))
    out = tops
    for column, name in (("s", "sphericity_1"), ("m", "sphericity_2")):
        places = both.select("vol_id", *(F.col(a).alias(f"{column}_{a}") for a in "tzyx"), F.col("wide").alias(name))
        out = out.withColumns({f"{column}_{a}": F.col(f"{column}.{a}") for a in "tzyx"}).join(places, ["vol_id", *(f"{column}_{a}" for a in "tzyx")])
    slices = slice_diameters(depth, spacing)
    best = slices.groupBy("vol_id").agg(_widest("major", "minor").alias("w"), _widest("e_major", "e_minor").alias("e"))
    here = slices.select("vol_id", F.col("z").alias("m_z"), *(F.col(c).alias(f"h_{c}") for c in ("major", "minor", "e_major", "e_minor")))
    out = out.join(best, "vol_id").join(here, ["vol_id", "m_z"])
    mean = lambda a, b: (F.col(a) + F.col(b)) / 2
    return out.select(
        "vol_id",
        F.col("n").alias("voxels"),
        (F.col("n") * float(spacing[0] * spacing[1] * spacing[2])).alias("volume"),
        "sphericity_1",
        "sphericity_2",
        F.col("top").alias("depth"),
        mean("w.major", "w.minor").alias("diameter_mean"),
        F.col("w.major").alias("diameter"),
        mean("e.e_major", "e.e_minor").alias("radius_mean"),
        F.col("e.e_major").alias("radius"),
        mean("h_major", "h_minor").alias("deep_diameter_mean"),
        F.col("h_major").alias("deep_diameter"),
        mean("h_e_major", "h_e_minor").alias("deep_radius_mean"),
        F.col("h_e_major").alias("deep_radius"),
    )


def shells(vox: DataFrame, d2: str, bins: int) -> DataFrame:
    """vox with shell 1..bins: d2 values in order of size, cut so that shells hold near-equal counts; equal values share one.

    Counts of distinct values are cumulated; a value falls in the shell of the middle of its own share.
    """
    from pyspark.sql import Window

    counts = vox.groupBy("vol_id", d2).agg(F.count("*").alias("k_"))
    upto = F.sum("k_").over(Window.partitionBy("vol_id").orderBy(d2))
    whole = F.sum("k_").over(Window.partitionBy("vol_id"))
    shell = F.least(F.floor((upto - F.col("k_") / 2.0) * bins / whole).cast("int") + 1, F.lit(bins))
    return vox.join(counts.withColumn("shell", shell).drop("k_"), ["vol_id", d2])


def shell_divergence(vox: DataFrame, shell: str, value: str, low: float, high: float, bins: int) -> DataFrame:
    """vol_id, pbs: divergence from uniform of all values less the mean over shells, values in equal-width bins."""
    b = F.floor((F.col(value) - low) / F.lit((high - low) / bins)).cast("int")
    rows = vox.withColumn("bin", b).where(F.col("bin").between(0, bins - 1))

    def divergence(keys):
        n = rows.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
        total = n.groupBy(*keys).agg(F.sum("n").alias("t"), F.collect_list("n").alias("ns"))  # at most `bins` counts
        u = 1.0 / bins
        term = lambda p: F.when(p > 0, p * F.log(p)).otherwise(0.0)
        used = F.aggregate("ns", F.lit(0.0), lambda a, c: a + term(c / F.col("t")) + term(F.lit(u)) - term(c / F.col("t") + u))
        empty = (bins - F.size("ns")) * (term(F.lit(u)) - term(F.lit(u)))
        return total.select(*keys, (F.log(F.lit(2.0)) + 0.5 * (used + empty)).alias("js"))

    whole = divergence(["vol_id"]).withColumnRenamed("js", "all_")
    each = divergence(["vol_id", shell]).groupBy("vol_id").agg(F.avg("js").alias("mean_"))
    return whole.join(each, "vol_id").select("vol_id", (F.col("all_") - F.col("mean_")).alias("pbs"))
