"""Iterated joins on the grid: components, waves, growth, descent.

Loops hold a frontier and a visited table, both written each round in the
shared folder, so plans stay short and a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut, numbered
from .components import stars
from .stencil import AXES, KEY, causal, linear_index, offsets, shifted


def voxel_edges(fg: DataFrame, offs, dims, same: list[str] = ()) -> DataFrame:
    """a, b: linear indices of foreground voxels that are neighbours; columns in same must agree."""
    rows = fg.select(*KEY, linear_index(dims).alias("i"), *same)
    sent = shifted(rows, causal(offs, forward=True), ["i", *same]).select(*KEY, F.col("i").alias("a"), *(F.col(c).alias(f"s_{c}") for c in same))
    joined = rows.join(sent, KEY)
    for c in same:
        joined = joined.where(F.col(c).eqNullSafe(F.col(f"s_{c}")))
    return joined.select("vol_id", "a", F.col("i").alias("b"))


def components(fg: DataFrame, offs, dims, same: list[str] = ()) -> DataFrame:
    """fg with label 1.. by volume, dense in raster order of each component's first voxel.

    A node is volume and linear index in one number, so many volumes are done in one run.
    """
    cells = 1
    for n in dims:
        cells *= n
    node = lambda c: F.col("vol_id") * F.lit(cells) + F.col(c)
    rows = fg.withColumn("i_", linear_index(dims)).withColumn("node_", node("i_"))
    edges = voxel_edges(fg, offs, dims, same).select(node("a").alias("a"), node("b").alias("b"))
    tree = stars(edges).select(F.col("a").alias("node_"), F.col("b").alias("root_"))
    rooted = rows.join(tree, "node_", "left").withColumn("root_", F.coalesce("root_", "node_"))
    roots = numbered(rooted.where("node_ = root_").select("vol_id", "root_"), ["vol_id"], ["root_"], "label")
    return rooted.join(roots, ["vol_id", "root_"]).drop("i_", "node_", "root_")


def keep_sizes(labelled: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """Components of at least `least` and at most `most` voxels, labelled anew in the old order, with their size."""
    sizes = labelled.groupBy("vol_id", "label").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    if most is not None:
        sizes = sizes.where(F.col("size") <= most)
    sizes = numbered(sizes, ["vol_id"], ["label"], "new_")
    return labelled.join(sizes, ["vol_id", "label"]).drop("label").withColumnRenamed("new_", "label")


def fill_holes(vox: DataFrame, least: int, dims, mask: str = "mask") -> DataFrame:
    """vox with filled: the mask, and 1 on background of a slice (x, y) that is enclosed, 4-connected and smaller than least."""
    flat = vox.where(F.col(mask) == 0).select(*KEY)
    lab = components(flat, offsets(2, "face"), dims)
    edge = F.col("x").isin(0, dims[0] - 1) | F.col("y").isin(0, dims[1] - 1)
    holes = lab.groupBy("vol_id", "label").agg(F.max(edge).alias("open"), F.count("*").alias("size")).where(~F.col("open") & (F.col("size") < least))
    inner = lab.join(holes, ["vol_id", "label"], "left_semi").select(*KEY, F.lit(1).alias("hole_"))
    return vox.join(inner, KEY, "left").withColumn("filled", F.greatest(mask, F.coalesce("hole_", F.lit(0)))).drop("hole_")


def waves(fg: DataFrame, seeds: DataFrame, offs, rule: Callable[[Column, Column], Column] | None = None, value: str | None = None, first: int = 0, most: int | None = None) -> DataFrame:
    """KEY and wave of the foreground voxels that seeds reach, seeds at wave `first`.

    rule(from, to) on value decides whether a step is taken, e.g. strictly
    downhill. most bounds the number of rounds.
    """
    keep = [value] if value else []
    fg = cut(fg.select(*KEY, *keep), "wave-ground")
    front = fg.join(seeds.select(*KEY).distinct(), KEY).withColumn("wave", F.lit(first))
    front = seen = cut(front, "wave")
    step = 0
    while most is None or step < most:
        step += 1
        sent = shifted(front, offs, keep).select(*KEY, *(F.col(v).alias("from_") for v in keep))
        reached = fg.join(sent, KEY)
        if rule is not None:
            reached = reached.where(rule(F.col("from_"), F.col(value)))
        front = reached.select(*KEY, *keep).distinct().join(seen.select(*KEY), KEY, "left_anti")
        front = cut(front.withColumn("wave", F.lit(first + step)), "wave")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if step % 8 == 0:
            seen = cut(seen, "wave-seen")
    return seen.select(*KEY, "wave")


def compete(fg: DataFrame, seeds: DataFrame, offs, most: int | None = None) -> DataFrame:
    """KEY, label, wave: seeds (KEY, label) grow in step; a voxel that two labels claim at once becomes -1 and stops."""
    fg = cut(fg.select(*KEY), "compete-ground")
    claim = lambda df: df.groupBy(*KEY).agg(F.when(F.min("label") == F.max("label"), F.min("label")).otherwise(-1).alias("label"))
    front = seen = cut(claim(fg.join(seeds.select(*KEY, "label"), KEY)).withColumn("wave", F.lit(0)), "compete")
    step = 0
    while most is None or step < most:
        step += 1
        sent = shifted(front.where("label <> -1"), offs, ["label"]).select(*KEY, "label")
        front = claim(fg.join(sent, KEY).join(seen.select(*KEY), KEY, "left_anti"))
        front = cut(front.withColumn("wave", F.lit(step)), "compete")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if step % 8 == 0:
            seen = cut(seen, "compete-seen")
    return seen


def geodesic(fg: DataFrame, seeds: DataFrame, offs, bound: float, spacing=(1.0, 1.0, 1.0, 1.0)) -> DataFrame:
    """KEY, dist: shortest path lengths within the foreground from the nearest seed, up to bound; exact relaxation."""
    fg = cut(fg.select(*KEY), "geodesic-ground")
    best = cut(fg.join(seeds.select(*KEY).distinct(), KEY).withColumn("dist", F.lit(0.0)), "geodesic")
    length = F.sqrt(sum(F.col(f"o.d{a}") * F.col(f"o.d{a}") * F.lit(float(s) ** 2) for a, s in zip(AXES, spacing)))
    front = best
    while True:
        sent = shifted(front, offs, ["dist"]).select(*KEY, (F.col("dist") + length).alias("dist")).where(F.col("dist") <= bound)
        offered = fg.join(sent, KEY).groupBy(*KEY).agg(F.min("dist").alias("offer"))
        front = offered.join(best, KEY, "left").where(F.col("dist").isNull() | (F.col("offer") < F.col("dist") - 1e-9)).select(*KEY, F.col("offer").alias("dist"))
        front = cut(front, "geodesic-front")
        if front.isEmpty():
            return best
        best = cut(best.unionByName(front).groupBy(*KEY).agg(F.min("dist").alias("dist")), "geodesic")


def climb(vox: DataFrame, offs, value: str, dims) -> DataFrame:
    """KEY, peak (linear index) where the steepest ascent from each voxel ends: the highest neighbour that is higher.

    Ties go to the nearer, then the smaller index. Pointer jumping: the rounds are the logarithm of the longest path.
    """
    rows = vox.select(*KEY, value, linear_index(dims).alias("i"))
    sent = shifted(rows, offs, [value, "i"]).select(*KEY, F.struct((-F.col(value)).alias("v"), F.col("o.len2").alias("l"), F.col("i").alias("i")).alias("n"))
    best = sent.groupBy(*KEY).agg(F.min("n").alias("n"))
    up = rows.join(best, KEY, "left")
    goal = F.when(-F.col("n.v") > F.col(value), F.col("n.i")).otherwise(F.col("i"))
    now = cut(up.select("vol_id", "i", goal.alias("peak")), "climb")
    while True:
        ahead = now.select("vol_id", F.col("i").alias("peak"), F.col("peak").alias("next"))
        moved = cut(now.join(ahead, ["vol_id", "peak"]).select("vol_id", "i", F.col("next").alias("peak"), (F.col("next") != F.col("peak")).alias("moved")), "climb")
        still = moved.where("moved").limit(1).count()
        now = moved.drop("moved")
        if not still:
            break
    return rows.join(now, ["vol_id", "i"]).select(*KEY, "peak")
