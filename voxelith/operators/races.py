"""Labels that race over the grid, in order of arrival."""

from __future__ import annotations

from collections.abc import Callable
from math import floor

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.tables import cut, drop
from .extraction import level_or_down
from .stencil import AXES, KEY, gather, near, offsets, shifted


def race(ground: DataFrame, seeds: DataFrame, step: Column, delta: float, offs, value: str = "d", rule: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """KEY, label, arrival: the label (KEY, label) that reaches each voxel first, and when; the smaller label on ties.

    step is the time of a step, above 0, from the columns from_ (value where it
    begins), value (where it ends) and o.len2; rule(from, to) says which steps are
    taken. Times are rounded to 9 digits. Arrivals are settled in buckets of width
    delta: a round sends the voxels of the earliest bucket that aren't sent yet, so few are
    sent twice and a round is one written table, whatever the number of labels. Labels off the ground take no part.
    """
    ground = cut(ground.select(*KEY, value), "race-ground")
    best = ground.join(seeds.select(*KEY, "label"), KEY).groupBy(*KEY).agg(F.min("label").alias("label"), F.max(value).alias(value))
    best = best.select(*KEY, value, F.lit(0.0).alias("arrival"), "label", F.lit(False).alias("sent"))
    seen = Observation()
    best = cut(best.observe(seen, F.min("arrival").alias("next")), "race")
    while (first := seen.get["next"]) is not None:
        edge = (floor(first / delta) + 1) * delta
        now = ~F.col("sent") & (F.col("arrival") < edge)
        moved = shifted(best.where(now), offs, [value, "arrival", "label"]).withColumnRenamed(value, "from_")
        reached = ground.join(moved, KEY)
        if rule is not None:
            reached = reached.where(rule(F.col("from_"), F.col(value)))
        offers = reached.select(*KEY, value, F.round(F.col("arrival") + step, 9).alias("arrival"), "label", F.lit(False).alias("sent"))
        held = best.select(*KEY, value, "arrival", "label", (F.col("sent") | now).alias("sent"))
        # The earliest, then the smaller label; an offer that changes nothing leaves the voxel as sent.
        both = held.unionByName(offers).groupBy(*KEY).agg(F.max(value).alias(value), F.min(F.struct("arrival", "label", (~F.col("sent")).alias("open"))).alias("m"))
        seen = Observation()
        after = both.select(*KEY, value, F.col("m.arrival").alias("arrival"), F.col("m.label").alias("label"), (~F.col("m.open")).alias("sent"))
        after = cut(after.observe(seen, F.min(F.when(~F.col("sent"), F.col("arrival"))).alias("next")), "race")
        drop(best)
        best = after
    return best.select(*KEY, "label", "arrival")


def constrained_growth(depth: DataFrame, clicks: DataFrame, ndim: int = 3) -> DataFrame:
    """KEY, label, arrival: growth from the click of each volume and from peaks near it (label 1) against that from all other peaks (label 2).

    depth: KEY, d; clicks: KEY, one a volume. Peaks are voxels without a deeper
    neighbour; those nearer to the click than its depth are with it. Both grow over the faces in step, level or down; a
    voxel that both reach at once goes to label 1.
    """
    depth = cut(depth.select(*KEY, "d"), "growth-depth")
    home = depth.join(clicks.select(*KEY), KEY).select("vol_id", *(F.col(a).alias(f"c{a}") for a in AXES), F.col("d").alias("cd"))
    peak = gather(depth, offsets(ndim), {"top": F.max(near(F.col("d")))}, ["d"]).where("top IS NULL OR d >= top").select(*KEY)
    far = sum((F.col(a) - F.col(f"c{a}")) * (F.col(a) - F.col(f"c{a}")) for a in AXES)
    labelled = peak.join(home, "vol_id").select(*KEY, F.when(far < F.col("cd") * F.col("cd"), 1).otherwise(2).alias("label"))
    own = home.select("vol_id", *(F.col(f"c{a}").alias(a) for a in AXES), F.lit(1).alias("label"))
    return race(depth, labelled.unionByName(own), F.lit(1.0), 1.0, offsets(ndim, "face"), "d", level_or_down)
