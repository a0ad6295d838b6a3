"""Growth and traces on depth maps that follow a rule of direction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut
from .stencil import AXES, KEY, gather, near, offsets, shifted, surface

#: Fixed value: the bound of the direction test, as the original has it.
ANGLE = 3.141529 / 4.0


def angle_growth(depth: DataFrame, seeds: DataFrame, value: str = "d", strict: bool = False, dims=None) -> DataFrame:
    """label, KEY, wave of the voxels that each seed (KEY, label) grows to, on its own.

    A step goes to a voxel of no greater (strict: of smaller) depth where the
    depth falls away from the seed: p . g * |g| / |p| > ANGLE, p being the way
    from the seed and g the falling gradient by central differences. An absent
    voxel has depth 0; one outside the volume, if dims are given, the centre's.
    """
    v = F.col(value)
    ground = depth.where(v > 0).select(*KEY, value)
    sides = {f"n_{a}{s}": F.coalesce(F.sum(near(F.when(F.col(f"o.d{a}") == (1 if s == "p" else -1), v))), F.lit(0.0)) for a in "xyz" for s in "mp"}
    ground = gather(ground, offsets(3, "face"), sides, [value])
    out = lambda a, edge, n: F.when(F.col(a) == edge, v).otherwise(F.col(n)) if dims else F.col(n)
    fall = [(out(a, 0, f"n_{a}m") - out(a, dims[k] - 1 if dims else None, f"n_{a}p")).alias(f"g_{a}") for k, a in enumerate("xyz")]
    ground = cut(ground.select(*KEY, value, *fall), "angle-ground")
    start = [F.col(a).alias(f"s_{a}") for a in "xyz"]
    front = seen = cut(ground.select(*KEY, value).join(seeds.select(*KEY, "label"), KEY).select("label", *KEY, value, *start, F.lit(0).alias("wave")), "angle-front")
    kept = ["label", "s_x", "s_y", "s_z"]
    size = lambda cs: F.sqrt(sum(c * c for c in cs))
    step = 0
    while not front.isEmpty():
        step += 1
        sent = shifted(front.withColumnRenamed(value, "from_"), offsets(3), [*kept, "from_"]).select(*KEY, *kept, "from_")
        way, fall = [F.col(a) - F.col(f"s_{a}") for a in "xyz"], [F.col(f"g_{a}") for a in "xyz"]
        turn = sum(a * b for a, b in zip(way, fall)) / F.nullif(size(way), F.lit(0.0)) * size(fall)
        got = ground.join(sent, KEY).where((v < F.col("from_") if strict else v <= F.col("from_")) & (turn > ANGLE))
        new = got.select("label", *KEY, value, "s_x", "s_y", "s_z").distinct().join(seen.select("label", *KEY), ["label", *KEY], "left_anti")
        front = cut(new.withColumn("wave", F.lit(step)), "angle-front")
        seen = seen.unionByName(front)
        if step % 8 == 0:
            seen = cut(seen, "angle-seen")
    return seen.select("label", *KEY, "wave")


def steepest_links(depth: DataFrame, value: str = "d") -> DataFrame:
    """KEY and to: each voxel's neighbours (full) of the least depth, if that is no more than its own; none at the border.

    Absent neighbours and those of depth 0 are the least of all, and lead nowhere.
    """
    v = F.col(value)
    inner = depth.where(v > 0).select(*KEY, value)
    offs = offsets(3)
    least = gather(inner, offs, {"least": F.min(near(v))}, [value]).where((F.col("n_near") == len(offs)) & (F.col("least") <= v))
    sent = shifted(inner.withColumn("to", F.struct(*AXES)), offs, [value, "to"]).select(*KEY, v.alias("there"), "to")
    return least.select(*KEY, "least").join(sent, KEY).where("there = least").select(*KEY, "to")


def descent_trace(depth: DataFrame, starts: DataFrame, value: str = "d") -> DataFrame:
    """KEY of all voxels that steepest descent reaches from the starts, themselves included; all equal ways are taken."""
    links = cut(steepest_links(depth, value), "trace-links")
    front = seen = cut(starts.select(*KEY).distinct().join(depth.where(F.col(value) > 0).select(*KEY), KEY), "trace")
    step = 0
    while not front.isEmpty():
        step += 1
        new = front.join(links, KEY).select("vol_id", *(F.col(f"to.{a}").alias(a) for a in AXES)).distinct()
        front = cut(new.join(seen, KEY, "left_anti"), "trace")
        seen = seen.unionByName(front)
        if step % 8 == 0:
            seen = cut(seen, "trace-seen")
    return seen


def sampled_trace(depth: DataFrame, seeds: DataFrame, value: str = "d") -> DataFrame:
    """descent_trace() from all neighbours of the seeds with less depth than the seed."""
    own = depth.select(*KEY, F.col(value).alias("from_")).join(seeds.select(*KEY).distinct(), KEY)
    sent = shifted(own, offsets(3), ["from_"]).select(*KEY, "from_")
    return descent_trace(depth, depth.join(sent, KEY).where(F.col(value) < F.col("from_")).select(*KEY), value)


def level_fill(depth: DataFrame, seeds: DataFrame, squared: str = "d") -> DataFrame:
    """KEY, level: from the seeds' greatest whole squared depth down, one layer of neighbours of the region's surface for each level.

    A voxel joins at the level that equals its own squared depth, if it touches
    a surface voxel of the region then. Levels that no voxel has are skipped; seeds have level null.
    """
    level = F.floor(F.col(squared)).cast("int")
    ground = cut(depth.select(*KEY, level.alias("level")), "level-ground")
    region = cut(ground.join(seeds.select(*KEY).distinct(), KEY).select(*KEY, F.lit(None).cast("int").alias("level")), "level-region")
    top = ground.join(region.select(*KEY), KEY).agg(F.max("level")).first()[0]
    levels = [r[0] for r in ground.where(F.col("level").between(1, top or 0)).select("level").distinct().orderBy(F.desc("level")).collect()]  # distinct depths of one map
    for k in levels:
        rim = shifted(surface(region.select(*KEY), 3), offsets(3), []).select(*KEY).distinct()
        new = ground.where(F.col("level") == k).join(rim, KEY).join(region.select(*KEY), KEY, "left_anti")
        region = cut(region.unionByName(new.select(*KEY, "level")), "level-region")
    return region


def trace_to_peaks(depth: DataFrame, peaks: DataFrame, value: str = "d") -> DataFrame:
    """KEY, peak: the listed peak (KEY, peak) that steepest ascent leads to; -1 where it ends elsewhere.

    Of neighbours of equal, greatest depth the one whose peak is nearest to the
    voxel counts; ties go to the smaller peak number.
    """
    v = F.col(value)
    inner = cut(depth.where(v > 0).select(*KEY, value), "peak-ground")
    listed = cut(peaks.groupBy(*KEY).agg(F.min("peak").alias("peak")), "peak-list")
    place = listed.select("peak", F.struct(*AXES).alias("at"))
    rest = inner.join(listed, KEY, "left_anti")
    sent = shifted(inner.withColumn("to", F.struct(*AXES)), offsets(3), [value, "to"]).select(*KEY, v.alias("there"), "to")
    up = rest.join(sent, KEY).where(F.col("there") > v)
    top = up.groupBy(*KEY).agg(F.max("there").alias("top"))
    links = cut(up.join(top, KEY).where("there = top").select(*KEY, "to"), "peak-links")
    done = inner.join(listed, KEY).select(*KEY, "peak")
    done = cut(done.unionByName(rest.join(top, KEY, "left_anti").select(*KEY, F.lit(-1).cast(listed.schema["peak"].dataType).alias("peak"))), "peak-done")
    open_ = cut(top.select(*KEY), "peak-open")
    far = sum((F.col(f"at.{a}") - F.col(a)) * (F.col(f"at.{a}") - F.col(a)) for a in "xyz")
    while not open_.isEmpty():
        known = done.select("vol_id", F.struct(*AXES).alias("to"), F.col("peak"))
        asked = links.join(open_, KEY, "left_semi").join(known, ["vol_id", "to"], "left").join(place, "peak", "left")
        best = F.min(F.when(F.col("peak") >= 0, F.struct(far.alias("far"), "peak")))
        new = asked.groupBy(*KEY).agg(best.alias("m"), F.max(F.col("peak").isNull()).alias("wait")).where("not wait")
        new = cut(new.select(*KEY, F.coalesce("m.peak", F.lit(-1)).alias("peak")), "peak-new")
        done = cut(done.unionByName(new), "peak-done")
        open_ = cut(open_.join(new, KEY, "left_anti"), "peak-open")
    return done
