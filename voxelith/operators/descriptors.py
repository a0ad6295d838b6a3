"""Descriptors that compare a segment with its free trace and the foreground around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import sphericity
from .statistics import edge_histogram, kolmogorov_smirnov, with_pdf_cdf
from .stencil import KEY, gather, offsets, shifted, surface

#: Factors by nodule type of the foreground score.
BOOST = {"solid": 1.2, "nonsolid": 1.1}


def foreground_score(sphericities: Column, kind: Column | None = None) -> Column:
    """The first of an array of sphericities (0 if there is none), raised for solid and non-solid kinds."""
    score = F.coalesce(F.get(sphericities, F.lit(0)), F.lit(0.0))
    if kind is None:
        return score
    return score * F.when(kind == "solid", BOOST["solid"]).when(kind == "nonsolid", BOOST["nonsolid"]).otherwise(1.0)


def compare_scores(one: Column, other: Column) -> Column:
    """1 if the first score is greater, -1 if it is less; a tie is 1 above 0, else 0."""
    return F.when(one > other, 1).when(one < other, -1).when(one > 0, 1).otherwise(0)


def _peak_sphericity(depth: DataFrame, value: str, at: DataFrame, w) -> DataFrame:
    return sphericity(depth, value, w).join(at.select(*KEY), KEY).groupBy("vol_id").agg(F.max("sp").alias("sp"))


def geometry_features(segment: DataFrame, depth: DataFrame, free_depth: DataFrame, ground_depth: DataFrame, seed: DataFrame, value: str = "d") -> DataFrame:
    """vol_id and seven values: sphericity of the seed in three depth maps and their product, spread of radii, roughness, and these two's product.

    Radii are distances of the segment's face-border voxels from its centroid,
    roughness the mean less the variance of the cosine between radius and outward
    face normal (left out where either has no length). A seed outside a map has 0.
    """
    faces = offsets(3, "face")
    middle = segment.groupBy("vol_id").agg(*(F.avg(a).alias(f"c_{a}") for a in "xyz"))
    present = {f"s_{a}": F.coalesce(F.sum(F.when(F.col("o.len2") > 0, F.col(f"o.d{a}"))), F.lit(0)) for a in "xyz"}
    rim = gather(segment.select(*KEY), faces, present, []).where(F.col("n_near") < len(faces)).join(middle, "vol_id")
    ray = [F.col(a) - F.col(f"c_{a}") for a in "xyz"]
    out = [-F.col(f"s_{a}") for a in "xyz"]  # absent faces point the other way round from present ones
    size = lambda cs: F.sqrt(sum(c * c for c in cs).cast("double"))
    cosine = sum(a * b for a, b in zip(ray, out)) / F.nullif(size(ray) * size(out), F.lit(0.0))
    each = rim.select("vol_id", size(ray).alias("r"), cosine.alias("k")).groupBy("vol_id").agg(F.avg("r").alias("r1"), F.var_pop("r").alias("r2"), F.avg("k").alias("k1"), F.var_pop("k").alias("k2"))
    for name, d in (("sphericity_d", depth), ("sphericity_d0", free_depth), ("sphericity_dl", ground_depth)):
        each = each.join(_peak_sphericity(d, value, seed, (2, 2, 2)).withColumnRenamed("sp", name), "vol_id", "left")
    sp = [F.coalesce(n, F.lit(0.0)).alias(n) for n in ("sphericity_d", "sphericity_d0", "sphericity_dl")]
    spread = F.when(F.col("r1") != 0, 1 - F.sqrt("r2") / F.col("r1")).otherwise(0.0)
    rough = F.coalesce("k1", F.lit(0.0)) - F.coalesce("k2", F.lit(0.0))
    return each.select("vol_id", *sp, spread.alias("radii_spread"), rough.alias("roughness")).select(
        "*", (F.col("sphericity_d") * F.col("sphericity_d0") * F.col("sphericity_dl")).alias("sphericity_prod"), (F.col("radii_spread") * F.col("roughness")).alias("spread_roughness")
    )


def geometry_features_new(segment: DataFrame, free: DataFrame, depth: DataFrame, free_depth: DataFrame, ground_depth: DataFrame, seed: DataFrame, value: str = "d", dims=None) -> DataFrame:
    """vol_id and four values: greatest depth by greatest distance from its place, greatest sphericity of the segment, one less the
    ratio of the free trace's, and one less the Kolmogorov-Smirnov distance of depths in the segment and of the ground there.

    The deepest place is the first in raster order, the seed if no depth exceeds
    1. Depth maps are 0 where they have no row: with dims, that counts in the distributions.
    """
    order = F.struct(F.col(value), -F.col("t"), -F.col("z"), -F.col("y"), -F.col("x"))
    top = depth.where(F.col(value) > 1).groupBy("vol_id").agg(F.max(order).alias("m"), F.max(value).alias("most"))
    top = seed.select("vol_id", *(F.col(a).alias(f"s_{a}") for a in "xyz")).join(top, "vol_id", "left")
    names = {"x": "col5", "y": "col4", "z": "col3"}
    place = top.select("vol_id", F.coalesce("most", F.lit(1.0)).alias("most"), *(F.coalesce(-F.col(f"m.{names[a]}"), F.col(f"s_{a}")).alias(f"p_{a}") for a in "xyz"))
    far = F.sqrt(sum((F.col(a) - F.col(f"p_{a}")) * (F.col(a) - F.col(f"p_{a}")) for a in "xyz").cast("double"))
    apart = segment.join(place, "vol_id").groupBy("vol_id", "most").agg(F.greatest(F.max(far), F.lit(1.0)).alias("far"))
    balls = sphericity(free_depth, value, (1, 1, 1))
    own = balls.join(segment.select(*KEY), KEY).groupBy("vol_id").agg(F.max("sp").alias("sp"))
    other = balls.join(free.select(*KEY), KEY).join(segment.select(*KEY), KEY, "left_anti").groupBy("vol_id").agg(F.max("sp").alias("sp0"))
    there = ground_depth.join(segment.select(*KEY), KEY).select(*KEY, value)
    most = depth.select(value).unionByName(there.select(value)).agg(F.greatest(F.max(value), F.lit(1.0))).first()[0]
    edges = [float(k) for k in range(1, int(most) + 2)]
    total = 1
    for n in dims or (0,):
        total *= n

    def cdf(rows):
        return with_pdf_cdf(edge_histogram(rows.select(value), value, edges))

    ksd = kolmogorov_smirnov(cdf(there), cdf(depth))
    out = apart.join(own, "vol_id", "left").join(other, "vol_id", "left").crossJoin(F.broadcast(ksd))  # ksd is one row
    sp, sp0 = F.coalesce("sp", F.lit(0.0)), F.coalesce("sp0", F.lit(0.0))
    return out.select("vol_id", (F.col("most") / F.col("far")).alias("apart_ratio"), sp.alias("max_sphericity"), F.when(sp > 0, 1 - sp0 / sp).otherwise(0.0).alias("sphericity_ratio"), (1 - F.coalesce("ksd", F.lit(0.0))).alias("disparity"))


def joint_boundary_features(segment: DataFrame, free: DataFrame, free_depth: DataFrame, value: str = "d") -> DataFrame:
    """vol_id, fit_1 .. fit_4: how shallow the free trace is where it joins the segment, against the segment's own greatest depth.

    The joint is all voxels of the free trace alone with a face neighbour in the
    segment; fit_4 is one less the number of such contacts by the segment's surface voxels.
    """
    alone = free.select(*KEY).join(segment.select(*KEY), KEY, "left_anti")
    sent = shifted(segment.select(*KEY), offsets(3, "face"), []).select(*KEY)
    joint = alone.join(sent, KEY).groupBy(*KEY).agg(F.count("*").alias("contacts"))
    d = free_depth.select(*KEY, value)
    j = joint.join(d, KEY, "left").groupBy("vol_id").agg(F.sum("contacts").alias("nj"), F.greatest(F.max(value), F.lit(0.0)).alias("dj"))
    b = segment.select(*KEY).join(d, KEY, "left").groupBy("vol_id").agg(F.greatest(F.max(value), F.lit(0.0)).alias("db"))
    n = surface(segment.select(*KEY), 3).groupBy("vol_id").agg(F.count("*").alias("ns"))
    rows = b.join(j, "vol_id", "left").join(n, "vol_id", "left")
    dj, db, nj = F.coalesce("dj", F.lit(0.0)), F.col("db"), F.coalesce("nj", F.lit(0))
    some = lambda c: F.when(db > 0, c).otherwise(0.0)
    return rows.select("vol_id", some(F.exp(-dj / (db * db))).alias("fit_1"), some(1 / (1 + F.exp(dj - db))).alias("fit_2"), some(1 / (1 + F.exp(dj * dj - db * db))).alias("fit_3"), some(F.when(F.col("ns") > 0, 1 - nj / F.col("ns")).otherwise(0.0)).alias("fit_4"))


def correlation_feature_names(name: str) -> tuple[str, str]:
    """Names of the two correlation features of an image."""
    return f"VectorAngle{name}", f"Correlation{name}"


def texture_features(segment: DataFrame) -> DataFrame:
    """vol_id, name, value: six unnamed features that are always 0; the original computes none."""
    slots = F.explode(F.array(*(F.lit(k) for k in range(1, 7)))).alias("k")
    return segment.select("vol_id").distinct().select("vol_id", slots).select("vol_id", F.concat(F.lit("Texture"), F.col("k").cast("string")).alias("name"), F.lit(0.0).alias("value"))
