"""Core particles: which are strong, how they get an exit, how soon erosion exposes them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut
from .components import stars
from .descent import erode_until_apart, reach
from .stencil import KEY, offsets, shifted


def strong_cores(nodes: DataFrame, links: DataFrame, surface_edges: DataFrame, ndim: int = 3) -> DataFrame:
    """node of each strong core, from nodes (node, on_surface), links a -> b (b descends from a) and surface_edges (a, b).

    Strong are nodes without a descendant, and those with 2 (ndim - 1) ascendants
    or more whose reachable surface, taken out of its surface component (that of
    its smallest node), leaves more than one component there. The rests of all candidates
    are labelled together, a node of a rest being candidate and surface node; that
    is candidates times surface rows, spread by the candidate.
    """
    nodes = cut(nodes.select("node", "on_surface"), "core-nodes")
    links = cut(links.select("a", "b").distinct(), "core-links")
    ends = nodes.join(links.select(F.col("a").alias("node")).distinct(), "node", "left_anti").select("node")
    many = links.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("n")).where(F.col("n") >= 2 * (ndim - 1)).select("node")
    candidates = cut(many.join(ends, "node", "left_anti"), "core-candidates")
    up = reach(links.select(F.col("b").alias("a"), F.col("a").alias("b")), candidates).where("start <> node")
    outer = nodes.where("on_surface").select("node")
    seen = cut(up.join(outer, "node").select("start", "node"), "core-seen")
    tree = stars(surface_edges.select("a", "b"))
    part = cut(outer.join(tree.select(F.col("a").alias("node"), F.col("b").alias("part")), "node", "left").select("node", F.coalesce("part", "node").alias("part")), "core-parts")
    own = seen.groupBy("start").agg(F.min("node").alias("node")).join(part, "node").select("start", "part")
    rest = cut(own.join(part, "part").select("start", "node").join(seen, ["start", "node"], "left_anti"), "core-rest")
    both = surface_edges.select("a", "b")
    inner = rest.select("start", F.col("node").alias("a")).join(both, "a").join(rest.select("start", F.col("node").alias("b")), ["start", "b"])
    wide = F.lit(1 << 31)  # above every node, which is a linear index of one volume
    number = lambda c: F.col("start") * wide + F.col(c)
    pieces = stars(inner.select(number("a").alias("a"), number("b").alias("b"))).select(F.col("a").alias("i"), F.col("b").alias("root"))
    rooted = rest.select("start", number("node").alias("i")).join(pieces, "i", "left").select("start", F.coalesce("root", "i").alias("root"))
    split = rooted.groupBy("start").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select(F.col("start").alias("node"))
    return ends.unionByName(split)


def assign_exits(cores: DataFrame, gen: DataFrame, links: DataFrame, ndim: int = 3) -> tuple[DataFrame, DataFrame]:
    """New links of core particles (KEY, i) to the nearest neighbour of their generation (KEY, wave, i) that has a descendant, and
    the particles that find none.

    A core linked in one round is an exit for the next; ties go to the smaller
    index. Rounds end when none is linked.
    """
    rows = gen.select(*KEY, "i", F.col("wave").alias("g"))
    sent = shifted(rows, offsets(ndim), ["i", "g"]).select(*KEY, F.col("i").alias("n"), F.col("g").alias("ng"), F.col("o.len2").alias("len2"))
    side = cut(cores.select(*KEY, "i").join(rows.drop("i"), KEY).join(sent, KEY).where("g = ng").select("i", "n", "len2"), "exit-neighbours")
    left = cut(cores.select("i").distinct(), "exit-left")
    have, made = links.select(F.col("a").alias("n")).distinct(), links.select("a", "b").limit(0)
    while True:
        best = side.join(left, "i", "left_semi").join(have, "n", "left_semi").groupBy("i").agg(F.min(F.struct("len2", "n")).alias("m"))
        new = cut(best.select(F.col("i").alias("a"), F.col("m.n").alias("b")), "exit-new")
        if new.isEmpty():
            return made, left
        made = cut(made.unionByName(new), "exit-made")
        have = cut(have.unionByName(new.select(F.col("a").alias("n"))), "exit-have")
        left = cut(left.join(new.select(F.col("a").alias("i")), "i", "left_anti"), "exit-left")


def exposure_width(cores: DataFrame, occupied: DataFrame, ndim: int = 3) -> DataFrame:
    """label, width: the erosion after which a core (KEY, label) first touches the outside by a face.

    Erosion takes the outermost layer of the occupied voxels, core voxels never.
    Cores that are never exposed have no row; without any layer to take there are none.
    """
    layers = cut(erode_until_apart(occupied, cores, None, ndim), "core-layers")
    if layers.where("layer IS NOT NULL").isEmpty():
        return cores.select("label", F.lit(0).alias("width")).limit(0)
    sides = shifted(cores.select(*KEY, "label"), [tuple(-c for c in d) for d in offsets(ndim, "face")], ["label"]).select(*KEY, "label")
    around = sides.join(layers.withColumn("there", F.lit(True)), KEY, "left")
    seen = F.when(F.col("there").isNull(), F.lit(1)).otherwise(F.col("layer"))
    return around.groupBy("label").agg(F.min(seen).alias("width")).where("width IS NOT NULL")


def asymmetric_links(down: DataFrame, up: DataFrame) -> DataFrame:
    """violations: links a -> b of down without b -> a in up, and the other way round."""
    turned = up.select(F.col("b").alias("a"), F.col("a").alias("b")).distinct()
    own = down.select("a", "b").distinct()
    lost = own.join(turned, ["a", "b"], "left_anti").unionByName(turned.join(own, ["a", "b"], "left_anti"))
    return lost.agg(F.count("*").alias("violations"))
