"""Whole programs on volumes, composed of the operators.

Each takes a long table of voxels and gives one table, or a dict of tables by
name where there are several results. vol_id stays a key throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cores as C
from ..operators import descent as Q
from ..operators import diffusion as D
from ..operators import fixpoint as P
from ..operators import graphs as R
from ..operators import hulls as H
from ..operators import segments as M
from ..operators import separation as B
from ..operators import stencil as S
from ..operators.components import component_of
from ..operators.distance import distance
from ..operators.proximity import in_balls
from ..operators.series import dtw
from .tables import cut, numbered

KEY = S.KEY


def smoothen_volume(vox: DataFrame, value: str = "val", rounds: int = 5) -> DataFrame:
    """Half of each value, half of the mean of its face neighbours, `rounds` times."""
    return D.relax(vox, value, rounds, alpha=0.5)


def dtw_volume(vox: DataFrame, reference: list[float], value: str = "val") -> DataFrame:
    """vol_id, x, y, cost: each fibre along z against a reference of the same length; other fibres get a null."""
    fibre = vox.groupBy("vol_id", "x", "y").agg(F.sort_array(F.collect_list(F.struct("z", F.col(value).cast("double").alias("v")))).alias("f"))  # one fibre
    fibre = fibre.select("vol_id", "x", "y", F.col("f.v").alias("a"), F.array(*(F.lit(float(r)) for r in reference)).alias("b"))
    return fibre.select("vol_id", "x", "y", F.when(F.size("a") == len(reference), dtw("a", "b")).alias("cost"))


def figure_ground(vox: DataFrame, value: str, dims, rounds: int = 4, k=(1.0, 0.0, 0.0, 1.0), rate: float = 0.25, min_size: int = 300) -> DataFrame:
    """KEY, q, mask: reaction-diffusion of memberships, a threshold at one half, and small holes of slices filled."""
    q = D.react_diffuse(vox.select(*KEY, value), value, rounds, k, rate=rate)
    q = cut(q.withColumn("mask", (F.col(value) > 0.5).cast("int")), "figure")
    return P.fill_holes(q, min_size, dims).select(*KEY, F.col(value).alias("q"), F.col("filled").alias("mask"))


def convexify(fg: DataFrame, surface_of: DataFrame | None = None) -> DataFrame:
    """KEY of foreground voxels inside the hull of given points, or of the foreground's own surface."""
    points = S.surface(fg, 3) if surface_of is None else surface_of
    return H.carve(fg, cut(H.hull_facets(points).select("vol_id", "nx", "ny", "nz", "offset"), "hulls"))


def depth_of(vox: DataFrame, dims, spacing=(1.0, 1.0, 1.0, 1.0), by_volume: bool = False) -> DataFrame:
    """KEY, d of the foreground (mask = 1): squared distance to the background. by_volume is for many small volumes, as in distance()."""
    return cut(distance(vox, "mask = 0", spacing, dims=None if by_volume else dims, by_volume=by_volume, only="mask = 1"), "depth")


def relocate_clicks(vox: DataFrame, clicks: DataFrame, dims, box=(1, 1, 1, 0), by_volume: bool = False) -> DataFrame:
    """click, KEY: where clicks climb to in the depth, box cells a step on each axis."""
    return Q.relocate(depth_of(vox, dims, by_volume=by_volume), clicks, box=box)


def free_growth_check(vox: DataFrame, seeds: DataFrame, dims, spacing=(1.0, 1.0, 1.0, 1.0), ndim: int = 3) -> dict[str, DataFrame]:
    """depth, growth (waves down from the seeds' balls), surface of the growth, and the part of it that validates."""
    depth = depth_of(vox, dims, spacing)
    reach = seeds.join(depth, KEY).select("vol_id", F.monotonically_increasing_id().alias("seed"), "x", "y", "z", "t", F.sqrt("d").alias("r"))
    ball = cut(in_balls(depth, reach, ndim).select(*KEY).distinct(), "ball")
    front = S.surface(ball, ndim)
    growth = cut(P.waves(depth, front, S.offsets(ndim), lambda a, b: b < a, "d", first=1), "growth")
    edge = S.surface(depth, ndim).join(growth, KEY, "left_semi")
    valid = Q.validate_growth(edge, depth, growth, ndim=ndim)
    return {"depth": depth, "growth": growth, "surface": edge, "valid": valid}


def straight_growth(vox: DataFrame, seeds: DataFrame, dims, proportion: float = 2.0, ndim: int = 3) -> dict[str, DataFrame]:
    """Growth from seeds, the peaks that voxels climb to, and the surface voxels that a seed's peak dominates.

    A peak dominates a surface voxel if more than `proportion` times as many of its neighbours climb to it as to the next one.
    """
    depth = depth_of(vox, dims)
    growth = cut(P.waves(depth, seeds, S.offsets(ndim), lambda a, b: b < a, "d", first=1), "growth")
    peaks = cut(P.climb(depth, S.offsets(ndim), "d", dims), "peaks")
    own = peaks.join(seeds.select(*KEY), KEY, "left_semi").select("vol_id", "peak").distinct()
    edge = S.surface(depth, ndim).join(peaks, KEY)
    ruled = Q.dominant_labels(Q.neighbour_labels(edge, peaks.withColumnRenamed("peak", "label"), ndim), KEY, proportion)
    selected = ruled.withColumnRenamed("label", "peak").join(own, ["vol_id", "peak"], "left_semi")
    return {"growth": growth, "peaks": peaks, "selected": selected, "surface": edge}


def core_partition(vox: DataFrame, dims, least: int = 1) -> dict[str, DataFrame]:
    """cores (peaks with enough voxels), and labels: each voxel the core it climbs to, numbered in index order."""
    peaks = cut(P.climb(depth_of(vox, dims), S.offsets(3), "d", dims), "peaks")
    cores = peaks.groupBy("vol_id", "peak").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    cores = numbered(cores, ["vol_id"], ["peak"], "label")
    return {"cores": cores, "labels": peaks.join(cores, ["vol_id", "peak"]).select(*KEY, "label")}


def particle_growth(vox: DataFrame, dims, clusters: int = 2) -> dict[str, DataFrame]:
    """generations from the surface, cores (generation maxima), and labels after merging catchments to a number of clusters."""
    fg = vox.where("mask = 1").select(*KEY)
    gen = cut(P.waves(fg, S.surface(fg, 3), S.offsets(3, "face"), first=1), "generations")
    part = cut(P.climb(gen, S.offsets(3), "wave", dims), "catchments")
    sizes = part.groupBy(F.col("peak").alias("node")).agg(F.count("*").alias("size"))
    contacts = M.catchment_links(part, S.offsets(3, "face")).select(F.col("pa").alias("a"), F.col("pb").alias("b"), F.lit(1.0).alias("w"), F.col("n").alias("cut"))
    merged = M.agglomerate(sizes, contacts, clusters)
    labels = part.join(merged.select(F.col("node").alias("peak"), F.col("root").alias("label")), "peak").select(*KEY, "label")
    return {"generations": gen, "cores": Q.local_generation_maxima(gen), "labels": labels}


def core_descent(vox: DataFrame, dims, parts: int = 2) -> dict[str, DataFrame]:
    """labels of catchments, the spanning tree of their contacts, and the parts that cutting it leaves."""
    part = cut(P.climb(depth_of(vox, dims), S.offsets(3), "d", dims), "catchments")
    links = M.catchment_links(part, S.offsets(3, "face")).select(F.col("pa").alias("a"), F.col("pb").alias("b"), (1.0 / F.col("n")).alias("w"))
    tree = cut(R.spanning_forest(links), "tree")
    nodes = part.select(F.col("peak").alias("node")).distinct()
    groups = R.cut_tree(nodes, tree, max(parts - 1, 1))
    return {"labels": part, "tree": tree, "parts": part.join(groups.select(F.col("node").alias("peak"), F.col("root").alias("part")), "peak").select(*KEY, "part")}


def strong_core_partition(vox: DataFrame, dims, parts: int = 2, ndim: int = 3) -> dict[str, DataFrame]:
    """generations from the surface and links to the depth, strong cores, the regions that descend to their clusters, and parts.

    Strong cores that are neighbours are one cluster (label); a region holds the voxels
    whose links lead to it first. Regions are joined by a spanning tree of their
    contacts (weight 1 / contacts), and its heaviest edges are cut until `parts` are left. One volume a run.
    """
    fg = cut(vox.where("mask = 1").select(*KEY), "foreground")
    outer = cut(S.surface(fg, ndim), "surface")
    gen = cut(P.waves(fg, outer, S.offsets(ndim, "face"), first=1), "generations")
    links = cut(Q.descent_links(gen, dims, ndim), "descent")
    rows = gen.select(*KEY, S.linear_index(dims).alias("node")).join(outer.withColumn("on_surface", F.lit(True)), KEY, "left")
    nodes = cut(rows.select(*KEY, "node", F.coalesce("on_surface", F.lit(False)).alias("on_surface")), "nodes")
    strong = C.strong_cores(nodes, links, P.voxel_edges(outer, S.offsets(ndim), dims), ndim)
    cores = cut(P.components(nodes.join(strong, "node").select(*KEY), S.offsets(ndim), dims), "strong-cores")
    found = Q.core_labels(links, cores.select(S.linear_index(dims).alias("node"), "label"))
    regions = cut(nodes.join(found, "node").select(*KEY, "label"), "core-regions")
    contacts = M.catchment_links(regions.withColumn("peak", F.col("label").cast("long")), S.offsets(ndim, "face"))
    tree = cut(R.spanning_forest(contacts.select(F.col("pa").alias("a"), F.col("pb").alias("b"), (1.0 / F.col("n")).alias("w"))), "core-tree")
    ids = cores.select(F.col("label").cast("long").alias("node")).distinct()
    groups = R.cut_tree(ids, tree, parts - 1) if parts > 1 else component_of(ids, tree)
    out = regions.join(groups.select(F.col("node").cast("int").alias("label"), F.col("root").cast("int").alias("part")), "label").select(*KEY, "label", "part")
    return {"generations": gen, "links": links, "cores": cores, "tree": tree, "parts": out}


def branch_structure(vox: DataFrame, source: dict[str, int], sink: dict[str, int], dims, rule=None) -> dict[str, DataFrame]:
    """Shortest paths through the voxels from the source, what is cut off as apart from the way to the sink, and labels of the rest.

    A step costs 1 over the lesser depth of its ends. tree: a (predecessor), b,
    w100 (hundredfold cost, cut to a whole number) and type: 2 on the way from source to sink, 0 where
    rule(tree, main) names b (the first voxel further than 3 from that way, if no other rule is given),
    else 1. labels: voxels that hang together by edges that are left, by least index; voxels out of the
    source's reach are parts of their own. One volume a run; places must be foreground.
    """
    at = lambda p: int(p["x"] + dims[0] * (p["y"] + dims[1] * (p["z"] + dims[2] * p.get("t", 0))))
    deep = depth_of(vox, dims)
    place = cut(deep.select(S.linear_index(dims).alias("node"), *KEY, F.sqrt("d").alias("depth")), "places")
    edges = P.voxel_edges(deep, S.offsets(3, "face"), dims)
    slow = lambda c: place.select(F.col("node").alias(c), F.col("depth").alias(f"d{c}"))
    edges = edges.join(slow("a"), "a").join(slow("b"), "b").select("a", "b", F.round(1.0 / F.least("da", "db"), 6).alias("w"))
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "voxel-graph")
    paths = cut(R.shortest_paths(both, at(source)), "voxel-paths")
    main = cut(R.path_to(paths, at(sink)).select("node"), "main-path")
    up = paths.select(F.col("node").alias("pred"), F.col("dist").alias("before"))
    tree = cut(paths.join(place, "node").join(up, "pred", "left").select("node", "pred", *S.AXES, "depth", F.coalesce(F.col("dist") - F.col("before"), F.lit(0.0)).alias("w")), "branch-tree")
    gone = (rule or (lambda t, m: B.cut_by_distance(t, m, 3.0)))(tree, main).select("node").distinct()
    typed = tree.where("pred IS NOT NULL").join(main.withColumn("on_way", F.lit(True)), "node", "left").join(gone.withColumn("gone", F.lit(True)), "node", "left")
    typed = typed.select(F.col("pred").alias("a"), F.col("node").alias("b"), F.floor(100 * F.col("w")).cast("int").alias("w100"), F.when(F.col("gone"), 0).when(F.col("on_way"), 2).otherwise(1).alias("type"))
    typed = cut(typed, "typed-tree")
    labels = component_of(place.select("node", *KEY), typed.where("type > 0").select("a", "b"))
    return {"tree": typed, "labels": labels.select(*KEY, F.col("root").alias("label"))}


def make_graph_structure(vox: DataFrame, source: dict[str, int], sink: dict[str, int], dims) -> dict[str, DataFrame]:
    """The graph of catchments, shortest paths from the source's catchment, and the path to the sink's."""
    part = cut(P.climb(depth_of(vox, dims), S.offsets(3), "d", dims), "catchments")
    at = lambda p: part.where(" AND ".join(f"{a} = {int(v)}" for a, v in p.items())).first()
    links = M.catchment_links(part, S.offsets(3, "face")).select(F.col("pa").alias("a"), F.col("pb").alias("b"), (1.0 / F.col("n")).alias("w"))
    both = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "catchment-graph")
    tree = cut(R.shortest_paths(both, at(source)["peak"]), "catchment-tree")
    return {"labels": part, "graph": both, "tree": tree, "path": R.path_to(tree, at(sink)["peak"])}


def surface_cutting(vox: DataFrame, planes: list[tuple[dict, dict]], dims) -> DataFrame:
    """Surface KEY and part_0, part_1 ..: for each (origin, normal) the component on the plane's outer side, 0 inside."""
    out = S.surface(vox.where("mask = 1").select(*KEY), 3)
    for n, (origin, normal) in enumerate(planes):
        sides = cut(Q.plane_sides(out, origin, normal), "sides")
        lab = P.components(sides.where("side = 1"), S.offsets(3), dims).select(*KEY, F.col("label").alias(f"part_{n}"))
        out = cut(sides.drop("side").join(lab, KEY, "left").withColumn(f"part_{n}", F.coalesce(f"part_{n}", F.lit(0))), "sides")
    return out
