"""Image algebra on long tables: arithmetic, borders, crops, pads, scales and shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stencil import KEY


def combine(a: DataFrame, b: DataFrame, op: str, value: str = "val") -> DataFrame:
    """KEY and value: element-wise + - * / of two images; places that one lacks are left out; a division by 0 is null."""
    x, y = F.col("a_"), F.col("b_")
    out = {"+": x + y, "-": x - y, "*": x * y, "/": F.when(y != 0, x / y)}[op]
    return a.select(*KEY, F.col(value).alias("a_")).join(b.select(*KEY, F.col(value).alias("b_")), KEY).select(*KEY, out.alias(value))


def border(index: Column, n: int, policy: str) -> Column:
    """The index inside [0, n) that a policy reads for one outside: mirror (about the edge cell), wrap, clamp; zero gives null."""
    if policy == "clamp":
        return F.least(F.greatest(index, F.lit(0)), F.lit(n - 1))
    if policy == "wrap":
        return F.pmod(index, F.lit(n))
    if policy == "mirror":
        m = F.pmod(index, F.lit(2 * n - 2)) if n > 1 else F.lit(0)
        return F.when(m < n, m).otherwise(2 * n - 2 - m)
    return F.when(index.between(0, n - 1), index)


def extend(vox: DataFrame, axis: str, n: int, margin: int, policy: str, value: str = "val", default: float = 0.0) -> DataFrame:
    """KEY, value: lines of n cells along an axis, with margin < n more at both ends.

    mirror, wrap and clamp repeat the cell that border() names, each cell being
    sent to the places that read it, without a shuffle. extrapolate goes on
    linearly: twice the edge's value less that of the mirrored cell; places
    whose cells are missing are left out. constant gives default, on each line
    that has a cell.
    """
    if not 0 <= margin < n:
        raise ValueError("the margin is at least 0 and less than the line")
    rows = vox.select(*KEY, F.col(value).alias(value))
    outside = [*range(-margin, 0), *range(n, n + margin)]
    if not outside:
        return rows
    others = [k for k in KEY if k != axis]
    if policy == "constant":
        lines = rows.select(*others).distinct().withColumn(axis, F.explode(F.array(*map(F.lit, outside))))
        return rows.unionByName(lines.withColumn(value, F.lit(default).cast(rows.schema[value].dataType)))
    if policy in ("mirror", "wrap", "clamp"):
        place = F.sequence(F.lit(-margin), F.lit(n - 1 + margin))
        reads = F.filter(place, lambda j: border(j, n, policy) == F.col(axis))
        return rows.withColumn(axis, F.explode(reads))
    if policy != "extrapolate":
        raise ValueError(policy)
    places = F.array(*(F.struct(F.lit(j).alias("j"), F.lit(-j if j < 0 else 2 * n - 2 - j).alias("far"), F.lit(0 if j < 0 else n - 1).alias("edge")) for j in outside))
    sent = rows.withColumn("p_", F.explode(F.filter(places, lambda p: (p["far"] == F.col(axis)) | (p["edge"] == F.col(axis)))))
    weight = F.when(F.col("p_.edge") == F.col(axis), 2).otherwise(-1)
    made = sent.select(*others, F.col("p_.j").alias(axis), (weight * F.col(value)).alias("v_")).groupBy(*KEY).agg(F.sum("v_").alias(value), F.count("v_").alias("k_"))
    return rows.unionByName(made.where("k_ = 2").drop("k_"))


def crop(vox: DataFrame, **bounds: tuple[int, int]) -> DataFrame:
    """Rows with low <= axis <= high for each axis=(low, high), moved to start at 0. Bounds reach the scan as filters."""
    for a, (low, high) in bounds.items():
        vox = vox.where(F.col(a).between(low, high)).withColumn(a, F.col(a) - low)
    return vox


def paste(under: DataFrame, over: DataFrame, at: dict[str, int], value: str = "val") -> DataFrame:
    """under with over's values put at an origin; parts of over outside under are ignored."""
    moved = over.select("vol_id", *((F.col(a) + at.get(a, 0)).alias(a) for a in "xyzt"), F.col(value).alias("new_"))
    return under.join(moved, KEY, "left").withColumn(value, F.coalesce("new_", value)).drop("new_")


def upscale(vox: DataFrame, factor: int, axes: str = "xy") -> DataFrame:
    """Each cell repeated factor times along each of the axes."""
    for a in axes:
        vox = vox.withColumn("k_", F.explode(F.array(*map(F.lit, range(factor))))).withColumn(a, F.col(a) * factor + F.col("k_")).drop("k_")
    return vox


def roll(vox: DataFrame, axis: str, shift: int, n: int) -> DataFrame:
    """out[i] = in[(i + shift) mod n] along one axis."""
    return vox.withColumn(axis, F.pmod(F.col(axis) - shift, F.lit(n)).cast("int"))


def resample(vox: DataFrame, value: str, sides: dict[str, int], spacing: dict[str, float], centre: dict[str, float], new_centre: dict[str, float]) -> DataFrame:
    """vol_id, axes of sides, value: each volume on a new grid about a centre, by linear interpolation; 0 outside.

    Cell n of an axis reads at (n - new_centre) * spacing + centre: a spacing above 1 shrinks, below 1 stretches. The
    cells of the new grid are a range; each asks for its corners (two an axis, one where it falls on a voxel) and adds up what is
    there, weighted: a join on places and one aggregate.
    """
    cells = 1
    for n in sides.values():
        cells *= n
    grid = vox.select("vol_id").distinct().withColumn("i_", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    index, weight = F.col("i_"), F.lit(1.0)
    for a, n in sides.items():
        grid, index = grid.withColumn(f"n_{a}", (index % n).cast("int")), F.floor(index / n)
    for a in sides:
        at = (F.col(f"n_{a}") - float(new_centre[a])) * float(spacing[a]) + float(centre[a])
        low = F.floor(at).cast("int")
        grid = grid.withColumn(f"p_{a}", at).withColumn(a, F.explode(F.when(at == low, F.array(low)).otherwise(F.array(low, low + 1))))
        weight = weight * (1 - F.abs(F.col(f"p_{a}") - F.col(a)))
    found = grid.join(vox.select("vol_id", *sides, F.col(value).cast("double").alias("v_")), ["vol_id", *sides], "left")
    out = found.groupBy("vol_id", *(f"n_{a}" for a in sides)).agg(F.coalesce(F.sum(weight * F.col("v_")), F.lit(0.0)).alias(value))
    return out.select("vol_id", *(F.col(f"n_{a}").alias(a) for a in sides), value)
