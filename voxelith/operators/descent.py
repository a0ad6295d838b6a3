"""Links from generation to generation, labels that run along them, and checks of growth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import cut, maybe_broadcast, rows_of
from .stencil import AXES, KEY, linear_index, offsets, shifted


def descent_links(gen: DataFrame, dims, ndim: int = 3, fill: bool = True) -> DataFrame:
    """a, b (linear indices): each voxel's nearest neighbours of the next generation, all of equal distance.

    With fill, a voxel without one takes the nearest neighbour of its own
    generation that has one (the smaller index on ties), round by round.
    """
    rows = gen.select(*KEY, F.col("wave").alias("g"), linear_index(dims).alias("i"))
    sent = shifted(rows, offsets(ndim), ["g", "i"]).select(*KEY, F.col("g").alias("ng"), F.col("i").alias("n"), F.col("o.len2").alias("len2"))
    near = cut(rows.join(sent, KEY).where("ng = g OR ng = g + 1").select("i", "g", "n", "ng", "len2"), "descent-near")
    down = near.where("ng = g + 1")
    best = down.withColumn("r", F.rank().over(Window.partitionBy("i").orderBy("len2"))).where("r = 1").select(F.col("i").alias("a"), F.col("n").alias("b"))
    links = cut(best, "descent-links")
    side = near.where("ng = g").select("i", "n", "len2")
    while fill:
        have = links.select("a").distinct()
        free = side.join(have.withColumnRenamed("a", "i"), "i", "left_anti").join(have.withColumnRenamed("a", "n"), "n", "left_semi")
        more = cut(free.groupBy("i").agg(F.min(F.struct("len2", "n")).alias("m")).select(F.col("i").alias("a"), F.col("m.n").alias("b")), "descent-more")
        if more.isEmpty():
            break
        links = cut(links.unionByName(more), "descent-links")
    return links


def reach(links: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """start, node: all nodes that links a -> b lead to from each start, itself included."""
    front = seen = cut(starts.select(F.col("node").alias("start"), "node").distinct(), "reach")
    n = 0
    while most is None or n < most:
        n += 1
        front = front.join(links, front["node"] == links["a"]).select("start", F.col("b").alias("node")).distinct().join(seen, ["start", "node"], "left_anti")
        front = cut(front, "reach")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if n % 8 == 0:
            seen = cut(seen, "reach-seen")
    return seen


def core_labels(links: DataFrame, cores: DataFrame) -> DataFrame:
    """node, label: cores (node, label) spread against the links; in a round the smallest label wins, the first one stays."""
    front = seen = cut(cores.groupBy("node").agg(F.min("label").alias("label")), "core-labels")
    n = 0
    while True:
        n += 1
        back = front.join(links, front["node"] == links["b"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("label"))
        front = cut(back.join(seen.select("node"), "node", "left_anti"), "core-labels")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
        if n % 8 == 0:
            seen = cut(seen, "core-seen")


def pruned(links: DataFrame) -> DataFrame:
    """One link per node: the smallest target."""
    return links.groupBy("a").agg(F.min("b").alias("b"))


def local_generation_maxima(gen: DataFrame, ndim: int = 3) -> DataFrame:
    """KEY, wave of voxels without a neighbour of a greater generation."""
    from .stencil import gather, near

    g = gather(gen.select(*KEY, "wave"), offsets(ndim), {"most": F.max(near(F.col("wave")))}, ["wave"])
    return g.where("most IS NULL OR most <= wave").select(*KEY, "wave")


def validate_growth(surface: DataFrame, depth: DataFrame, waves: DataFrame, value: str = "d", ndim: int = 3) -> DataFrame:
    """KEY, wave of surface voxels whose steepest uphill neighbour (rate of the root of value) has the wave before; wave 1 always holds.

    Of equally steep neighbours any may have it.
    """
    rows = depth.select(*KEY, F.sqrt(value).alias("v")).join(waves, KEY, "left")
    sent = shifted(rows, offsets(ndim), ["v", "wave"]).select(*KEY, F.col("v").alias("nv"), F.col("wave").alias("nw"), F.sqrt("o.len2").alias("len"))
    own = surface.select(*KEY).join(rows.where("wave IS NOT NULL"), KEY)
    rate = F.round((F.col("nv") - F.col("v")) / F.col("len"), 6)
    steep = own.join(sent, KEY, "left").withColumn("rate", rate).withColumn("top", F.max(F.when(F.col("rate") > 0, F.col("rate"))).over(Window.partitionBy(*KEY)))
    good = steep.groupBy(*KEY, "wave").agg(F.max(F.coalesce((F.col("rate") == F.col("top")) & (F.col("nw") == F.col("wave") - 1), F.lit(False))).alias("ok"))
    return good.where("ok OR wave = 1").select(*KEY, "wave")


def relocate(depth: DataFrame, clicks: DataFrame, value: str = "d", box=(1, 1, 1, 0)) -> DataFrame:
    """click, KEY: each click climbs to the largest value in its box until none is larger; equal ones are all kept.

    A round takes all clicks; the last is the first in which none rises, and until then clicks at rest spread over equal cells.
    Clicks at one place climb as one, so the rounds join no more than the places. If the boxes about the places
    hold more than all cells, what lies ahead is told once for each cell. Cells without a value count as absent.
    """
    from itertools import product

    offs = [d for d in product(*(range(-b, b + 1) for b in box))]
    depth = depth.select(*KEY, F.col(value).alias("v")).where("v IS NOT NULL")
    own = clicks.groupBy("click").agg(F.sort_array(F.collect_set(F.struct(*KEY))).alias("from_"))  # a click has one place, as a rule
    start = own.select(F.col("from_").alias("click")).distinct().select("click", F.explode("click").alias("p")).select("click", "p.*")
    front = cut(maybe_broadcast(start).join(depth, KEY), "relocate")
    cells = depth.count()
    many = rows_of(front) * len(offs) > cells
    front = _risen(front, depth, offs)
    while not front.where("v > old").isEmpty():
        if many:
            front = _risen_by_cells(front, depth, cells, offs)
            break
        front = _risen(front, depth, offs)
    return own.join(front.select(F.col("click").alias("from_"), *KEY), "from_").select("click", *KEY)


def _risen(front: DataFrame, depth: DataFrame, offs) -> DataFrame:
    """click, KEY, v, old: the largest cells in the boxes about each click's front (click, KEY, v), and the value they are reached from."""
    around = shifted(front, offs, ["click", "v"]).select(*KEY, "click", F.col("v").alias("old"))
    seen = maybe_broadcast(around, rows_of(front) * len(offs)).join(depth, KEY)
    best = seen.withColumn("top", F.max("v").over(Window.partitionBy("click"))).where("v = top")
    return cut(best.groupBy("click", *KEY, "v").agg(F.max("old").alias("old")), "relocate")


def _risen_by_cells(front: DataFrame, depth: DataFrame, cells: int, offs) -> DataFrame:
    """click, KEY: where the rounds of _risen() end. The cells of a click's front must be equal.

    A front spreads over equal cells, a step a round, until a larger one is next to it. So it rises
    after as many rounds as its cells are steps away from a larger one (hop), at the least, and to the
    largest that are so near (to_). Both are told cell by cell, a hop a round, and meet the fronts as
    they last rose; only the last fronts are spread, by the rounds since then.
    """
    front = front.select("click", *KEY, "v", F.lit(0).alias("since"))
    sent = depth.select(*KEY, "v", F.struct(*KEY).alias("to_"), F.col("v").alias("to_v"))
    free, left, ahead, n = depth, cells, None, 0
    while True:
        n += 1
        near = shifted(sent, offs, ["v", "to_", "to_v"]).select(*KEY, F.col("v").alias("by"), "to_", "to_v")
        near = near.join(maybe_broadcast(free, left), KEY).where("to_v > v" if n == 1 else "by = v").select(*KEY, "v", "to_", "to_v").distinct()
        best = near.withColumn("top", F.max("to_v").over(Window.partitionBy(*KEY))).where("to_v = top").drop("top")
        sent = cut(best.withColumn("hop", F.lit(n)), "ahead")
        free = cut(free.join(sent.select(*KEY).distinct(), KEY, "left_anti"), "nothing-ahead")
        left = rows_of(free)
        ahead = sent if ahead is None else ahead.unionByName(sent)
        if n % 8 == 0:
            ahead = cut(ahead, "ahead")
        met = front.select("click", *KEY, "since").join(ahead.drop("v"), KEY).where(F.col("hop") == n - F.col("since")).select("click", "to_", "to_v").distinct()
        rise = met.withColumn("top", F.max("to_v").over(Window.partitionBy("click"))).where("to_v = top")
        rise = cut(rise.select("click", "to_.*", F.col("to_v").alias("v"), F.lit(n).alias("since")), "rise")
        if not rows_of(rise):
            break
        front = cut(front.join(rise.select("click").distinct(), "click", "left_anti").unionByName(rise), "front")
    rim = found = cut(front.select("click", *KEY, "v", (n - F.col("since")).alias("steps")), "spread")
    while rows_of(rim):
        near = shifted(rim.where("steps > 0"), offs, ["click", "v", "steps"]).select(*KEY, "click", F.col("v").alias("by"), (F.col("steps") - 1).alias("steps"))
        near = near.join(maybe_broadcast(depth, cells), KEY).where("by = v").select("click", *KEY, "v", "steps").distinct()
        rim = cut(near.join(found.select("click", *KEY), ["click", *KEY], "left_anti"), "spread")
        found = found.unionByName(rim)
    return cut(found.select("click", *KEY), "relocate")


def separation_wave(labels: DataFrame, waves_of: DataFrame, ndim: int = 3) -> DataFrame:
    """la < lb, wave: the first wave at which voxels of two labels touch, the later of the two voxels counting."""
    rows = labels.select(*KEY, "label").join(waves_of.select(*KEY, "wave"), KEY)
    sent = shifted(rows, offsets(ndim, "face"), ["label", "wave"]).select(*KEY, F.col("label").alias("nl"), F.col("wave").alias("nw"))
    pairs = rows.join(sent, KEY).where("label < nl")
    return pairs.groupBy(F.col("label").alias("la"), F.col("nl").alias("lb")).agg(F.min(F.greatest("wave", "nw")).alias("wave"))


def erode_until_apart(fg: DataFrame, protect: DataFrame, most: int | None = None, ndim: int = 3) -> DataFrame:
    """KEY, layer: the erosion at which each voxel goes (border voxels first), protected ones never (null).

    Erosion ends when nothing is left to take, or after `most` layers.
    """
    from .stencil import surface

    left, out, n = fg.select(*KEY), None, 0
    while most is None or n < most:
        n += 1
        rim = surface(left, ndim).join(protect.select(*KEY), KEY, "left_anti")
        rim = cut(rim.withColumn("layer", F.lit(n)), "erosion")
        if rim.isEmpty():
            break
        out = rim if out is None else out.unionByName(rim)
        if n % 8 == 0:
            out = cut(out, "erosion")
        left = cut(left.join(rim.select(*KEY), KEY, "left_anti"), "erosion-left")
    rest = left.withColumn("layer", F.lit(None).cast("int"))
    return rest if out is None else out.unionByName(rest)


def separation_rounds(layers: DataFrame, cores: DataFrame, dims, ndim: int = 3) -> DataFrame:
    """la < lb, round: the erosion that first parts two core labels that hang together before; pairs never parted have no row.

    layers is the outcome of erode_until_apart(), cores (KEY, label). One components run for each layer.
    """
    from .fixpoint import components

    layers = cut(layers.select(*KEY, "layer"), "separation-layers")
    last = layers.agg(F.max("layer")).first()[0] or 0
    pairs, out = None, None
    for n in range(last + 1):  # the depth of the volume
        left = layers.where(F.col("layer").isNull() | (F.col("layer") > n)).select(*KEY)
        parts = components(left, offsets(ndim, "face"), dims).select(*KEY, F.col("label").alias("part")).join(cores.select(*KEY, "label"), KEY)
        parts = parts.select("vol_id", "part", "label").distinct()
        both = parts.select("vol_id", "part", F.col("label").alias("la")).join(parts.select("vol_id", "part", F.col("label").alias("lb")), ["vol_id", "part"])
        now = cut(both.where("la < lb").select("la", "lb").distinct(), "separation-pairs")
        if n:
            gone = cut(pairs.join(now, ["la", "lb"], "left_anti").withColumn("round", F.lit(n)), "separation-gone")
            out = gone if out is None else out.unionByName(gone)
        pairs = now
    return out if out is not None else pairs.limit(0).withColumn("round", F.lit(0))


def particle_kinds(gen: DataFrame, links: DataFrame, dims, ndim: int = 3) -> DataFrame:
    """KEY, i, surface, medial, inflection of each particle (KEY), by its neighbours and its links a -> b.

    surface: a face neighbour is missing. medial: no descendant, or 2 (ndim - 1)
    ascendants. inflection: on the surface, with two descendants or more.
    """
    from .stencil import gather

    faces = offsets(ndim, "face")
    rows = gather(gen.select(*KEY), faces, {}, []).select(*KEY, linear_index(dims).alias("i"), (F.col("n_near") < len(faces)).alias("surface"))
    down = links.groupBy(F.col("a").alias("i")).agg(F.countDistinct("b").alias("down"))
    up = links.groupBy(F.col("b").alias("i")).agg(F.countDistinct("a").alias("up"))
    both = rows.join(down, "i", "left").join(up, "i", "left").na.fill(0, ["down", "up"])
    return both.select(*KEY, "i", "surface", ((F.col("up") >= 2 * (ndim - 1)) | (F.col("down") == 0)).alias("medial"), (F.col("surface") & (F.col("down") >= 2)).alias("inflection"))


def neighbour_labels(places: DataFrame, labels: DataFrame, ndim: int = 3) -> DataFrame:
    """KEY, label, n: how many of each place's neighbours have a label."""
    sent = shifted(labels, offsets(ndim), ["label"]).select(*KEY, "label")
    return places.select(*KEY).join(sent, KEY).groupBy(*KEY, "label").agg(F.count("*").alias("n"))


def dominant_labels(counts: DataFrame, by: list[str], proportion: float) -> DataFrame:
    """by, label: the label of the greatest count n if that is more than proportion times the second's, else -1; ties go to the smaller label."""
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "label")
    two = counts.withColumns({"r": F.row_number().over(order), "second": F.lead("n").over(order)}).where("r = 1")
    kind = counts.schema["label"].dataType
    return two.select(*by, F.when(F.col("n") > proportion * F.coalesce("second", F.lit(0)), F.col("label")).otherwise(F.lit(-1).cast(kind)).alias("label"))


def plane_sides(surface: DataFrame, origin: dict[str, float], normal: dict[str, float]) -> DataFrame:
    """surface with side: 1 where normal . (p - origin) > 0, else 0."""
    dot = sum(F.lit(float(normal.get(a, 0))) * (F.col(a) - F.lit(float(origin.get(a, 0)))) for a in AXES)
    return surface.withColumn("side", (dot > 0).cast("int"))


def distribute_mass(gen: DataFrame, links: DataFrame, dims) -> DataFrame:
    """KEY, wave, mass: voxels of the first wave have 1 and pass equal shares of what they get on along their links (a, b).

    Links lead from a wave to the next; what a voxel without links gets stays there. One job for each wave.
    """
    rows = cut(gen.select(*KEY, "wave", linear_index(dims).alias("i")), "mass")
    degree = links.groupBy("a").agg(F.count("*").alias("n"))
    shares = cut(links.join(degree, "a").select("a", "b", "n"), "mass-links")
    first, last = rows.agg(F.min("wave"), F.max("wave")).first()
    if first is None:
        return rows.select(*KEY, "wave", F.lit(1.0).alias("mass"))
    out = front = rows.where(F.col("wave") == first).select("i", F.lit(1.0).alias("mass"))
    for n in range(first + 1, last + 1):  # the depth of the volume
        got = front.join(shares, front["i"] == shares["a"]).groupBy(F.col("b").alias("i")).agg(F.sum(F.col("mass") / F.col("n")).alias("mass"))
        here = rows.where(F.col("wave") == n).select("i")
        front = cut(here.join(got, "i", "left").na.fill(0.0, ["mass"]), "mass")
        out = out.unionByName(front)
    return rows.join(out, "i").select(*KEY, "wave", "mass")


def cut_surface(surface: DataFrame, planes: DataFrame, dims) -> DataFrame:
    """surface (KEY) with side and chosen (0 or 1): what a plane cuts off a surface in three dimensions.

    planes: vol_id, o (place), u, v, w (places beside it), structs of x, y, z; one
    for each volume, copies of a volume for more. The plane holds o, u and v; its
    normal points away from w. Voxels are before, on or behind it (side 1, 0, -1), and
    parts are full-connected voxels of one side. The base is the part on the
    plane with the voxel nearest o; of the parts of side 1 with a face on the base that one
    is chosen which has the greatest share of voxels toward u plus that toward v
    (none if all are 0, unless it is alone). Voxels of the base are chosen too
    where their projections on u and v add up to more than 0. Ties go to the smaller part.
    """
    from .fixpoint import components

    part = {k: [(F.col(f"{k}.{a}") - F.col(f"o.{a}")).cast("double") for a in "xyz"] for k in "uvw"}
    cross = lambda p, q: [p[i] * q[j] - p[j] * q[i] for i, j in ((1, 2), (2, 0), (0, 1))]
    dot = lambda p, q: sum(a * b for a, b in zip(p, q))
    normal = cross(part["u"], part["v"])
    turn = F.when(dot(normal, part["w"]) > 0, -1.0).otherwise(1.0)
    near = planes.select("vol_id", *(F.col(f"o.{a}").cast("double").alias(f"o{a}") for a in "xyz"), *(c.alias(f"{k}{a}") for k in "uv" for c, a in zip(part[k], "xyz")), *((turn * c).alias(f"n{a}") for c, a in zip(normal, "xyz")))
    off = [F.col(a) - F.col(f"o{a}") for a in "xyz"]
    along = {k: dot(off, [F.col(f"{k}{a}") for a in "xyz"]) for k in "uvn"}
    rows = surface.select(*KEY).join(near, "vol_id")
    rows = rows.select(*KEY, F.signum(along["n"]).cast("int").alias("side"), along["u"].alias("u"), along["v"].alias("v"), dot(off, off).alias("far"))
    parts = cut(components(rows, offsets(3), dims, same=["side"]), "cut-parts")
    base = parts.where("side = 0").groupBy("vol_id").agg(F.min(F.struct("far", "label")).alias("m")).select("vol_id", F.col("m.label").alias("base"))
    ground = cut(parts.join(base, "vol_id").where("label = base"), "cut-base")
    next_to = shifted(ground, offsets(3, "face"), []).select(*KEY).distinct()
    touching = parts.where("side = 1").join(next_to, KEY, "left_semi").select("vol_id", "label").distinct()
    score = parts.join(touching, ["vol_id", "label"], "left_semi").groupBy("vol_id", "label").agg(((F.count_if(F.col("u") > 0) + F.count_if(F.col("v") > 0)) / F.count("*")).alias("score"))
    best = score.groupBy("vol_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "label")).alias("m"), F.count("*").alias("n")).where("n = 1 OR m.s < 0").select("vol_id", F.col("m.label").alias("label"), F.lit(1).alias("picked"))
    chosen = parts.join(best, ["vol_id", "label"], "left").join(base, "vol_id", "left")
    taken = F.col("picked").isNotNull() | F.coalesce((F.col("label") == F.col("base")) & (F.col("u") + F.col("v") > 0), F.lit(False))
    return chosen.select(*KEY, "side", taken.cast("int").alias("chosen"))


def link_scores(links: DataFrame, dims) -> DataFrame:
    """links (a, b) with score: 27 t + 9 z + 3 y + x of the digits 3 (equal), 2 (a is less) or 1 of each coordinate of a against b."""
    from .stencil import subscripts

    total = F.lit(0)
    for k, (p, q) in enumerate(zip(subscripts(F.col("a"), dims), subscripts(F.col("b"), dims))):
        total = total + 3**k * F.when(p == q, 3).when(p < q, 2).otherwise(1)
    return links.withColumn("score", total)


def prune_links(links: DataFrame) -> DataFrame:
    """links (a, b, score) after removal, until no rule applies.

    A link of a node with several is idle if its target also has a link from a
    node with no other (key 0), or one of a greater score (key: its own score).
    Of a node's idle links those of the least key, then target, go, but never its last link. A round takes
    the nodes with idle links that come before all such others with a link to one of their targets; nodes
    come in the order of a * 2654435761 modulo 2^32, so that rounds are few. No two of a round touch.
    """
    turn = (F.col("a") * F.lit(2654435761)) % F.lit(1 << 32)
    now = cut(links.select("a", "b", "score", turn.alias("turn")), "prune")
    while True:
        degree = F.count("*").over(Window.partitionBy("a"))
        of_target = Window.partitionBy("b")
        rows = now.withColumn("n", degree).withColumn("single", F.max((F.col("n") == 1).cast("int")).over(of_target)).withColumn("top", F.max("score").over(of_target))
        key = F.when(F.col("n") > 1, F.when(F.col("single") == 1, 0).when(F.col("score") < F.col("top"), F.col("score")))
        rows = rows.withColumn("key", key).withColumn("idle", F.max(F.col("key").isNotNull()).over(Window.partitionBy("a")))
        rows = rows.withColumn("first", F.min(F.when(F.col("idle"), F.struct("turn", "a"))).over(of_target))
        rows = rows.withColumn("free", F.min((F.col("first") == F.struct("turn", "a")).cast("int")).over(Window.partitionBy("a")) == 1)
        place = F.row_number().over(Window.partitionBy("a").orderBy(F.col("key").isNull(), "key", "b"))
        gone = F.col("idle") & F.col("free") & F.col("key").isNotNull() & (place < F.col("n"))
        after = cut(rows.withColumn("gone", gone).select("a", "b", "score", "turn", "gone"), "prune")
        if after.where("gone").isEmpty():
            return now.select("a", "b")
        now = after.where("NOT gone").drop("gone")


def straightest_in_generation(gen: DataFrame, links: DataFrame, dims, ndim: int = 3) -> DataFrame:
    """a, b (linear indices): for each voxel with an ascendant, the neighbours of its own generation that go straightest on.

    links (a, b) lead from ascendants a to b. Straightest: the least distance of
    neighbour and the point opposite to an ascendant; all equal ones of a greater index than the voxel's own.
    """
    from .stencil import subscripts

    rows = gen.select(*KEY, "wave", linear_index(dims).alias("i"))
    up = links.select(F.col("b").alias("i"), *(c.alias(f"r{a}") for a, c in zip(AXES, subscripts(F.col("a"), dims))))
    sent = shifted(rows, offsets(ndim), ["wave", "i"]).select(*KEY, F.col("wave").alias("nw"), F.col("i").alias("n"), *(F.col(f"o.d{a}").alias(f"d{a}") for a in AXES))
    side = rows.join(sent, KEY).where("nw = wave").drop("nw")
    off = sum((F.col(a) - F.col(f"r{a}") - F.col(f"d{a}")) * (F.col(a) - F.col(f"r{a}") - F.col(f"d{a}")) for a in AXES)
    near = side.join(up, "i").groupBy("i", "n").agg(F.min(off).alias("off"))
    best = near.withColumn("least", F.min("off").over(Window.partitionBy("i"))).where("off = least AND n > i")
    return best.select(F.col("i").alias("a"), F.col("n").alias("b"))


def straight_successors(links: DataFrame, dims, ends: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """a, b, c: where each link (a, b) goes on from b: the link (b, c) nearest its own direction, the smaller c on ties.

    Links whose best cosine is below `least`, or that lead to a node of `ends`, don't go on.
    """
    from .stencil import subscripts

    rows = links.select("a", "b", *((q - p).alias(f"d{x}") for p, q, x in zip(subscripts(F.col("a"), dims), subscripts(F.col("b"), dims), AXES)))
    after = rows.select(F.col("a").alias("b"), F.col("b").alias("c"), *(F.col(f"d{x}").alias(f"e{x}") for x in AXES))
    if ends is not None:
        after = after.join(ends.select(F.col("node").alias("b")), "b", "left_anti")
    dot = lambda p, q: sum(F.col(f"{p}{x}") * F.col(f"{q}{x}") for x in AXES)
    cosine = F.round(dot("d", "e") / F.sqrt(dot("d", "d") * dot("e", "e")), 9)
    best = rows.join(after, "b").where(cosine >= least).groupBy("a", "b").agg(F.min(F.struct((-cosine).alias("k"), "c")).alias("m"))
    return best.select("a", "b", F.col("m.c").alias("c"))


def straight_walks(links: DataFrame, dims, ends: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """a, b, last, steps: where the walk that starts with each link (a, b) ends by straight_successors(), and how many links it has.

    All walks at once by pointer doubling: the rounds are the logarithm of the
    longest. Links must lead to later generations, so that no walk runs in a circle.
    """
    on = straight_successors(links, dims, ends, least)
    goes = F.col("c").isNotNull()
    now = links.select("a", "b").join(on, ["a", "b"], "left")
    now = cut(now.select("a", "b", F.when(goes, F.col("b")).otherwise(F.col("a")).alias("ta"), F.coalesce("c", "b").alias("tb"), goes.cast("long").alias("hops"), goes.alias("open")), "walks")
    while True:
        jump = now.select(F.col("a").alias("ta"), F.col("b").alias("tb"), F.col("ta").alias("ua"), F.col("tb").alias("ub"), F.col("hops").alias("more"), F.col("open").alias("goes"))
        now = cut(now.join(jump, ["ta", "tb"]).select("a", "b", F.col("ua").alias("ta"), F.col("ub").alias("tb"), (F.col("hops") + F.when(F.col("open"), F.col("more")).otherwise(0)).alias("hops"), (F.col("open") & F.col("goes")).alias("open")), "walks")
        if now.where("open").isEmpty():
            return now.select("a", "b", F.col("tb").alias("last"), (F.col("hops") + 1).alias("steps"))


def axis_ascents(gen: DataFrame, starts: DataFrame, ndim: int = 3) -> DataFrame:
    """KEY of the places that starts climb to along the axes, one direction after the other.

    The directions come in the order of offsets(ndim, 'face'). In each a start goes
    on from where it stands while the next voxel is of a later wave; where it then stands
    counts if that is past wave 1. Starts that have no such place count themselves.
    """
    place = starts.select(*KEY).distinct().join(gen.select(*KEY, "wave"), KEY).withColumn("home", F.struct(*KEY))
    found = None
    for d in offsets(ndim, "face"):
        axis, way = next((a, c) for a, c in zip(AXES, d) if c)
        line = Window.partitionBy("vol_id", *(a for a in AXES if a != axis)).orderBy(F.col(axis) * way)
        rises = F.coalesce((F.lead(axis).over(line) == F.col(axis) + way) & (F.lead("wave").over(line) > F.col("wave")), F.lit(False))
        runs = gen.select(*KEY, "wave").withColumn("stop", F.when(~rises, F.struct(F.col(axis).alias("p"), F.col("wave").alias("w"))))
        ends = runs.withColumn("to_", F.first("stop", ignorenulls=True).over(line.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        moved = place.select(*KEY, "home").join(ends.select(*KEY, "to_"), KEY)
        place = cut(moved.select(*(F.col("to_.p").alias(a) if a == axis else F.col(a) for a in KEY), F.col("to_.w").alias("wave"), "home"), "ascents")
        here = place.where("wave > 1").select("home", *KEY)
        found = here if found is None else found.unionByName(here)
    alone = place.select("home").join(found.select("home"), "home", "left_anti").select(*(F.col(f"home.{k}").alias(k) for k in KEY))
    return found.select(*KEY).unionByName(alone).distinct()


def generation_links(gen: DataFrame, dims, kind: str = "full", steepest: str | None = None, ndim: int = 3) -> DataFrame:
    """a, b (linear indices): links from each voxel to its neighbours (offsets `kind`) of the next generation.

    With steepest, a column of gen, only to that of its greatest value, the smaller index on ties.
    """
    value = [steepest] if steepest else []
    rows = gen.select(*KEY, "wave", *value, linear_index(dims).alias("i"))
    sent = shifted(rows, offsets(ndim, kind), ["wave", "i", *value]).select(*KEY, F.col("wave").alias("nw"), F.col("i").alias("n"), *(F.col(v).alias("nv") for v in value))
    pairs = rows.join(sent, KEY).where("nw = wave + 1")
    if steepest:
        best = pairs.groupBy("i").agg(F.min(F.struct((-F.col("nv")).alias("v"), "n")).alias("m"))
        return best.select(F.col("i").alias("a"), F.col("m.n").alias("b"))
    return pairs.select(F.col("i").alias("a"), F.col("n").alias("b"))


def filter_cores(gen: DataFrame, cores: DataFrame, dims, least: float, ndim: int = 3) -> DataFrame:
    """KEY, label of the clusters of cores (KEY) of which more than `least` of the voxels next to them are of an earlier generation than theirs.

    A voxel next to a cluster counts once on each side: as later if it isn't earlier than one of the cluster's that it touches, as earlier if it is.
    """
    from .fixpoint import components

    lab = cut(components(cores.select(*KEY), offsets(ndim), dims), "core-clusters")
    rest = gen.select(*KEY, "wave").join(cores.select(*KEY), KEY, "left_anti")
    own = lab.join(gen.select(*KEY, "wave"), KEY)
    sent = shifted(own, offsets(ndim), ["label", "wave"]).select(*KEY, "label", F.col("wave").alias("cw"))
    sides = rest.join(sent, KEY).select(*KEY, "label", (F.col("wave") < F.col("cw")).alias("down")).distinct()
    share = sides.groupBy("vol_id", "label").agg((F.count_if("down") / F.count("*")).alias("share")).where(F.col("share") > least)
    return lab.join(share, ["vol_id", "label"], "left_semi").select(*KEY, "label")


def merge_cores(gen: DataFrame, links: DataFrame, cores: DataFrame, dims, ndim: int = 3) -> DataFrame:
    """KEY, label, core, hops of the voxels that links (a, b) lead to clusters of cores: the cluster before merging, and the one after.

    Labels run up the links in step, the smaller label where several meet at
    once; hops are the steps from the core. Two clusters whose voxels touch merge
    if the hops on both sides of their nearest contacts, added up, are less than the generations of both; so do chains of such. One volume a run, as links name linear indices.
    """
    from .components import component_of
    from .fixpoint import components

    lab = cut(components(cores.select(*KEY), offsets(ndim), dims), "core-clusters")
    front = seen = cut(lab.select(linear_index(dims).alias("node"), "label", F.lit(0).alias("hops")), "core-hops")
    rounds = 0
    while True:
        rounds += 1
        up = links.select(F.col("b").alias("node"), "a").join(front.select("node", "label"), "node").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("label"))
        front = cut(up.join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(rounds)), "core-hops")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if rounds % 8 == 0:
            seen = cut(seen, "core-hops")
    placed = cut(gen.select(*KEY, "wave", linear_index(dims).alias("node")).join(seen, "node"), "core-regions")
    sent = shifted(placed, offsets(ndim), ["label", "hops"]).select(*KEY, F.col("label").alias("nl"), F.col("hops").alias("nh"))
    touch = placed.join(sent, KEY).where("label < nl").groupBy("label", "nl").agg((F.min("hops") + F.min("nh")).alias("gap"))
    born = placed.where("hops = 0").groupBy("label").agg(F.max("wave").alias("born"))
    near = touch.join(born, "label").join(born.select(F.col("label").alias("nl"), F.col("born").alias("nb")), "nl").where("gap < born AND gap < nb")
    labels = born.select(F.col("label").cast("long").alias("node"))
    merged = component_of(labels, near.select(F.col("label").cast("long").alias("a"), F.col("nl").cast("long").alias("b")))
    return placed.join(merged.select(F.col("node").cast("int").alias("label"), F.col("root").cast("int").alias("core")), "label").select(*KEY, "label", "core", "hops")
