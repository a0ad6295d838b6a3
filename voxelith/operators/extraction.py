"""Bounded traces and the extraction of segments from many volumes at once.

Volumes and trials are keys throughout: competing plans run as trials of one
pass, and the best trial of each volume is chosen by its score.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import cut, maybe_broadcast
from .diffusion import react_diffuse
from .distance import distance
from .features import sphericity
from .fixpoint import components, fill_holes, waves
from .hulls import carve, hull_facets, refine_boundary
from .stencil import AXES, KEY, gather, near, offsets, shifted, surface

TRIAL = [*KEY, "trial"]
ORIGIN, SENDER = ([f"{p}{a}" for a in AXES] for p in "os")


def downhill(a: Column, b: Column) -> Column:
    return a > b


def level_or_down(a: Column, b: Column) -> Column:
    return a >= b


def bounded_trace(ground: DataFrame, seeds: DataFrame, scale: float, rule: Callable[[Column, Column], Column], offs=None, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(trace, front): voxels that seeds reach within their life, and the particles that went no further.

    ground: KEY, d; seeds: KEY, trial (repeated ones count once, those off the
    ground take no part). A seed whose d is below the lower quartile of its
    trial's seeds (the value at a quarter of their number, from 0) sleeps. The
    others have a life of scale * d, rounded, at least 1.01; a particle steps to a
    neighbour nearer to its origin than its life where rule(d here, d there)
    holds and the trial hasn't been: neither in this trace nor in `before`. Where
    several claim a voxel in one round, the greater life gets it, then the first
    origin and the first sender in raster order.

    trace: TRIAL, d, life, origin ox.., wave (0: seeds). front: TRIAL, d, life
    (scale * d, cut to a whole number) of sleepers and of particles that won no
    voxel; as seeds they go on from there. Rounds are as many as the longest path.
    """
    offs = offs or offsets(3, "face")
    ground = cut(ground.select(*KEY, "d"), "trace-ground")
    group = Window.partitionBy("vol_id", "trial")
    rank = F.row_number().over(group.orderBy("d", *AXES)) - 1
    rows = seeds.select(*TRIAL).distinct().join(ground, KEY).withColumn("rank_", rank).withColumn("n_", F.count("*").over(group))
    rows = rows.withColumn("least_", F.max(F.when(F.col("rank_") == F.floor(F.col("n_") / 4), F.col("d"))).over(group))
    rows = cut(rows.select(*TRIAL, "d", (F.col("d") >= F.col("least_")).alias("awake")), "trace-seeds")
    life = F.greatest(F.floor(F.lit(float(scale)) * F.col("d") + 0.5).cast("double"), F.lit(1.01))
    front = rows.where("awake").select(*TRIAL, "d", life.alias("life"), *(F.col(a).alias(o) for a, o in zip(AXES, ORIGIN)), F.lit(0).alias("wave"))
    ended = rows.where("NOT awake").select(*TRIAL, "d")
    trace = front = cut(front, "trace-front")
    been = trace.select(*TRIAL) if before is None else trace.select(*TRIAL).unionByName(before.select(*TRIAL)).distinct()
    wave = 0
    while True:
        wave += 1
        own = front.select(*TRIAL, F.col("d").alias("from_"), "life", *ORIGIN, *(F.col(a).alias(s) for a, s in zip(AXES, SENDER)))
        sent = shifted(own, offs, ["trial", "from_", "life", *ORIGIN, *SENDER]).drop("o")
        reached = ground.join(sent, KEY)
        far = sum((F.col(a) - F.col(o)) * (F.col(a) - F.col(o)) for a, o in zip(AXES, ORIGIN))
        reached = reached.where((far < F.col("life") * F.col("life")) & rule(F.col("from_"), F.col("d"))).join(been, TRIAL, "left_anti")
        best = F.min(F.struct((-F.col("life")).alias("l"), *reversed(ORIGIN), *reversed(SENDER)))
        won = reached.groupBy(*TRIAL).agg(best.alias("b"), F.max("d").alias("d"))
        won = cut(won.select(*TRIAL, "d", (-F.col("b.l")).alias("life"), *(F.col(f"b.{c}").alias(c) for c in (*ORIGIN, *SENDER)), F.lit(wave).alias("wave")), "trace-front")
        parents = won.select("vol_id", "trial", *(F.col(s).alias(a) for a, s in zip(AXES, SENDER))).distinct()
        ended = ended.unionByName(front.select(*TRIAL, "d").join(parents, TRIAL, "left_anti"))
        if won.isEmpty():
            return trace, ended.withColumn("life", F.floor(F.lit(float(scale)) * F.col("d")).cast("int"))
        front = won.drop(*SENDER)
        trace, been = trace.unionByName(front), been.unionByName(front.select(*TRIAL))
        if wave % 8 == 0:
            trace, been, ended = cut(trace, "trace"), cut(been, "trace-been"), cut(ended, "trace-ended")


def solitary(fg: DataFrame, dims, most: int, by: list[str] = ("vol_id",)) -> DataFrame:
    """by, solitary: at most `most` voxels, away from the volume's faces, and filling a quarter of their box."""
    ends = [f(a).alias(f"{a}{k}") for a in "xyz" for f, k in ((F.min, 0), (F.max, 1))]
    s = fg.groupBy(*by).agg(F.count("*").alias("size"), *ends)
    box, clear = F.lit(1).cast("long"), F.lit(True)
    for a, n in zip("xyz", dims):
        box = box * (F.col(f"{a}1") - F.col(f"{a}0") + 1)
        clear = clear & (F.col(f"{a}0") > 0) & (F.col(f"{a}1") < n - 1)
    return s.select(*by, ((F.col("size") <= most) & clear & (4 * F.col("size") >= box)).alias("solitary"))


def wall_attached(fg: DataFrame, dims) -> DataFrame:
    """vol_id, wall_attached: whether a component of the voxels on the volume's faces alone has more than half a slice's cells."""
    shell = F.lit(False)
    for a, n in zip("xyz", dims):
        shell = shell | F.col(a).isin(0, n - 1)
    edge = cut(fg.where(shell).select(*KEY), "shell")
    largest = components(edge, offsets(3, "face"), dims).groupBy("vol_id", "label").agg(F.count("*").alias("n")).groupBy("vol_id").agg(F.max("n").alias("n"))
    return fg.select("vol_id").distinct().join(largest, "vol_id", "left").select("vol_id", F.coalesce(F.col("n") > dims[0] * dims[1] // 2, F.lit(False)).alias("wall_attached"))


def _holding(part: DataFrame, points: DataFrame, dims) -> DataFrame:
    """KEY of the component of each volume's part that holds its point (KEY, one a volume)."""
    lab = cut(components(part.select(*KEY), offsets(3, "face"), dims), "parts")
    home = lab.join(points.select(*KEY), KEY).select("vol_id", "label")
    return lab.join(home, ["vol_id", "label"], "left_semi").select(*KEY)


def extract_segments(fg: DataFrame, depth: DataFrame, seeds: DataFrame, dims, hull: bool = True, refine: bool = True) -> DataFrame:
    """KEY, solitary: the segment of each volume with seeds.

    fg: KEY; depth: KEY, d (distances, not squared); seeds: KEY, trial, where
    the least trial is a volume's first seed. If the component of the first
    seed is solitary (an eighth of the volume at most), it is the segment. Else each
    seed traces on its own: level or downhill for 0.8 of its depth, then from where that ended
    strictly downhill for 1.01 of the depth there; the component of the first seed is taken of all voxels
    reached. With hull, the segment is the foreground within the convex hull of
    its surface (where there is a hull); with refine, foreground voxels between
    it and the background on opposite sides join it. All volumes and seeds run at once.
    """
    fg = cut(fg.select(*KEY).join(seeds.select("vol_id").distinct(), "vol_id", "left_semi"), "extract-ground")
    first = seeds.groupBy("vol_id").agg(F.min(F.struct("trial", *AXES)).alias("s"))
    first = cut(first.select("vol_id", *(F.col(f"s.{a}").alias(a) for a in AXES)), "first-seeds")
    cells = dims[0] * dims[1] * dims[2]
    home = cut(_holding(fg, first, dims), "first-parts")
    alone = cut(solitary(home, dims, cells // 8).where("solitary").select("vol_id"), "solitary")
    whole = home.join(alone, "vol_id", "left_semi").withColumn("solitary", F.lit(True))
    ground = fg.join(alone, "vol_id", "left_anti").join(depth.select(*KEY, "d"), KEY)
    started = seeds.select(*TRIAL).join(alone, "vol_id", "left_anti")
    trace, ended = bounded_trace(ground, started, 0.8, level_or_down)
    more, _ = bounded_trace(ground, ended.select(*TRIAL), 1.01, downhill, before=trace)
    both = cut(trace.select(*KEY).unionByName(more.select(*KEY)).distinct(), "traced")
    part = cut(_holding(both, first, dims), "segment")
    rest = fg.join(alone, "vol_id", "left_anti")
    if hull:
        facets = cut(hull_facets(surface(part, 3)), "segment-hulls")
        inside = carve(rest, facets.select("vol_id", "nx", "ny", "nz", "offset")).select(*KEY)
        flat = part.join(facets.select("vol_id").distinct(), "vol_id", "left_anti").select(*KEY)
        part = cut(inside.unionByName(flat), "segment")
    if refine:
        part = part.unionByName(refine_boundary(part, rest.join(part.select("vol_id").distinct(), "vol_id", "left_semi")))
    return whole.unionByName(part.withColumn("solitary", F.lit(False)))


# --- foregrounds by competing models ------------------------------------------

#: Models of foreground intensity. A value rises from low to mid; from there it stays 1, or falls to high;
#: weight: 0.5 + weight * (v - 0.5) draws it to the middle; boost: of the model's score.
MODELS = {
    "solid": {"low": 0.0, "mid": 1000.0, "high": None, "weight": 1.0, "boost": 1.2, "instead": "solid_low"},
    "nonsolid": {"low": 100.0, "mid": 400.0, "high": 800.0, "weight": 1.0, "boost": 1.1, "instead": "nonsolid_low"},
    "partsolid": {"low": 100.0, "mid": 500.0, "high": None, "weight": 1.0, "boost": 1.0, "instead": None},
    "solid_low": {"low": 0.0, "mid": 800.0, "high": None, "weight": 1.0, "boost": 1.2, "instead": None},
    "nonsolid_low": {"low": 100.0, "mid": 300.0, "high": 700.0, "weight": 0.2, "boost": 1.1, "instead": None},
}

#: Cells up to which a volume's distances are made in one group.
SMALL = 1 << 18

#: The least sphericity that counts, the share of the best value, and the threshold of seeds.
LEAST_SPHERICITY, NEAR_BEST, SEED_THRESHOLD = 0.1, 0.9, 0.5


def membership(value: Column, model: dict) -> Column:
    rise = (value - model["low"]) / (model["mid"] - model["low"])
    top = F.lit(1.0) if model["high"] is None else (model["high"] - value) / (model["high"] - model["mid"])
    q = F.greatest(F.when(value < model["mid"], rise).otherwise(top), F.lit(0.0))
    return F.lit(0.5) + model["weight"] * (q - 0.5) if model["weight"] != 1 else q


def seeds_near_clicks(fg: DataFrame, depth: DataFrame, clicks: DataFrame, width: int) -> DataFrame:
    """KEY, value: the best local maxima of sphericity about the click of each volume (KEY, one a volume).

    A seed lies in the foreground, at most `width` cells from the click on each
    axis and `width` steps through the foreground; its sphericity isn't exceeded
    by a neighbour's and is above 0, in windows of 3 and of 5 cells. value is the
    greater of the two shares; kept are those of at least 0.9 of the best or SEED_THRESHOLD, whichever is less, if the best is at least 0.1.
    """
    near_click = clicks.select("vol_id", *(F.col(a).alias(f"c{a}") for a in "xyz"))
    box = F.lit(True)
    for a in "xyz":
        box = box & (F.abs(F.col(a) - F.col(f"c{a}")) <= width)
    small = cut(sphericity(depth, "d"), "sphericity")
    peak = gather(small.select(*KEY, "sp"), offsets(3), {"top": F.max(near(F.col("sp")))}, ["sp"]).where("sp > 0 AND (top IS NULL OR sp >= top)")
    # The click itself need not be foreground: its window of 3 cells is where the first step ends.
    start = [(0, 0, 0, 0), *offsets(3)]
    first = shifted(clicks.select(*KEY), start, []).select(*KEY).distinct()
    region = waves(fg, first, offsets(3), most=width - 1).select(*KEY)
    found = peak.select(*KEY, "sp").join(near_click, "vol_id").where(box).drop("cx", "cy", "cz").join(region, KEY)
    window = depth.join(near_click, "vol_id").where(" AND ".join(f"abs({a} - c{a}) <= {width + 2}" for a in "xyz")).select(*depth.columns)
    wide = sphericity(window, "d", (2, 2, 2)).select(*KEY, F.col("sp").alias("wide"))
    found = cut(found.join(wide, KEY).where("wide > 0").select(*KEY, F.greatest("sp", "wide").alias("value")), "seed-candidates")
    best = found.groupBy("vol_id").agg(F.max("value").alias("best")).where(F.col("best") >= LEAST_SPHERICITY)
    return found.join(best, "vol_id").where((F.col("value") == F.col("best")) | (F.col("value") >= F.least(F.col("best") * NEAR_BEST, F.lit(SEED_THRESHOLD)))).select(*KEY, "value")


def extract_foreground(vox: DataFrame, clicks: DataFrame, dims, models=("solid", "nonsolid", "partsolid"), value: str = "val", rounds: int = 5, mix: float = 0.5, width: int = 3, persistent: bool = True) -> dict[str, DataFrame]:
    """The foreground of each volume under the model whose seeds score best.

    vox: KEY, value of dense volumes; clicks: KEY, one a volume. Every model, and with persistent also the one that stands in for
    it where it finds no seed, is a volume of its own in one run: memberships diffuse (synchronously), are cut at 0.5,
    holes of slices below 15 cells are filled, distances and seeds follow. A model's score is its best seed's value
    times its boost; ties go to the earlier model. Gives model (vol_id, model, score), mask (KEY), depth (KEY, d, not
    squared) and seeds (KEY, value, trial by descending value), without the volumes in which no model has a seed.
    """
    run = list(models) + [MODELS[m]["instead"] for m in models if persistent and MODELS[m]["instead"]]
    n = len(run)
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), membership(F.col(value), MODELS[m]).cast("double").alias("q")) for k, m in enumerate(run))))
    q = vox.select(*KEY, each.alias("m")).select((F.col("vol_id") * n + F.col("m.k")).alias("vol_id"), *AXES, F.col("m.q").alias("q"))
    q = react_diffuse(cut(q, "memberships"), "q", rounds, speed=(1.0, 1.0, 0.5, 0.0), rate=1.0, mix=mix)
    filled = fill_holes(cut(q.select(*KEY, (F.col("q") > 0.5).cast("int").alias("mask")), "foregrounds"), 15, dims)
    mask = cut(filled.select(*KEY, F.col("filled").alias("mask")), "foregrounds")
    depth = cut(mask.where("mask = 1").select(*KEY).join(distance(mask, "mask = 0", by_volume=dims[0] * dims[1] * dims[2] <= SMALL), KEY).select(*KEY, F.sqrt("d").alias("d")), "foreground-depth")
    at = clicks.select(*KEY, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")).select((F.col("vol_id") * n + F.col("k")).alias("vol_id"), *AXES)
    seeds = cut(seeds_near_clicks(depth.select(*KEY), depth, at, width), "foreground-seeds")
    scores = seeds.groupBy("vol_id").agg(F.max("value").alias("best"))
    scores = scores.select(F.floor(F.col("vol_id") / n).alias("v"), (F.col("vol_id") % n).cast("int").alias("k"), "best")
    number = {m: k for k, m in enumerate(run)}
    stands_for = {number[MODELS[m]["instead"]]: number[m] for m in models if persistent and MODELS[m]["instead"]}
    slot = F.create_map(*(F.lit(x) for k in range(n) for x in (k, stands_for.get(k, k))))[F.col("k")]
    boost = F.create_map(*(x for k, m in enumerate(run) for x in (F.lit(k), F.lit(MODELS[m]["boost"]))))[F.col("k")]
    own = scores.groupBy("v", slot.alias("slot")).agg(F.min(F.struct("k", (boost * F.col("best")).alias("score"))).alias("m"))  # the model itself before its stand-in
    chosen = own.groupBy("v").agg(F.min(F.struct((-F.col("m.score")).alias("s"), "slot", F.col("m.k").alias("k"))).alias("c"))
    chosen = cut(chosen.select("v", (F.col("v") * n + F.col("c.k")).alias("vol_id"), F.col("c.k").alias("k"), (-F.col("c.s")).alias("score")), "chosen-models")
    names = F.array(*(F.lit(m) for m in run))
    back = lambda df: df.join(maybe_broadcast(chosen.select("vol_id", "v")), "vol_id").drop("vol_id").withColumnRenamed("v", "vol_id")
    order = Window.partitionBy("vol_id").orderBy(F.desc("value"), "t", "z", "y", "x")
    return {
        "model": chosen.select(F.col("v").alias("vol_id"), F.get(names, F.col("k")).alias("model"), "score"),
        "mask": back(mask.where("mask = 1").select(*KEY)).select(*KEY),
        "depth": back(depth).select(*KEY, "d"),
        "seeds": back(seeds).withColumn("trial", F.row_number().over(order) - 1).select(*KEY, "value", "trial"),
    }
