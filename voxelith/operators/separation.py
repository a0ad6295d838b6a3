"""How far the branches of a tree of particles part from its main path, and where to cut them.

A tree is a table of node, pred (null at the source), x, y, z, t, depth and w
(the weight of the edge from pred); main holds the nodes of the main path. A
branch starts at each node outside the main path whose pred is on it; its number
is that node. Main paths are short beside volumes: they are broadcast behind a
count, and all measures are aggregates over branch nodes joined with them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut, maybe_broadcast
from .descent import reach
from .stencil import AXES


def _apart(p: str, q: str) -> Column:
    return F.sqrt(sum((F.col(f"{p}{a}") - F.col(f"{q}{a}")) * (F.col(f"{p}{a}") - F.col(f"{q}{a}")) for a in AXES).cast("double"))


def branches(tree: DataFrame, main: DataFrame) -> DataFrame:
    """node, branch, leaf of every node outside the main path."""
    out = cut(tree.join(main.select("node"), "node", "left_anti").select("node", "pred"), "branch-nodes")
    start = out.join(main.select(F.col("node").alias("pred")), "pred", "left_semi").select("node")
    inner = out.join(start, "node", "left_anti").select(F.col("pred").alias("a"), F.col("node").alias("b"))
    own = reach(inner, start).select("node", F.col("start").alias("branch"))
    parents = tree.where("pred IS NOT NULL").select(F.col("pred").alias("node")).distinct().withColumn("leaf", F.lit(False))
    return own.join(parents, "node", "left").select("node", "branch", F.coalesce("leaf", F.lit(True)).alias("leaf"))


def _placed(rows: DataFrame, tree: DataFrame, prefix: str = "") -> DataFrame:
    return rows.join(tree.select("node", *(F.col(a).alias(f"{prefix}{a}") for a in (*AXES, "depth"))), "node")


def _with_main(rows: DataFrame, tree: DataFrame, main: DataFrame) -> DataFrame:
    """rows times the nodes of the main path but the source, which end no edge."""
    ends = main.join(tree.where("pred IS NOT NULL").select("node"), "node", "left_semi").select("node")
    path = _placed(ends, tree, "m_").drop("node")
    return rows.crossJoin(maybe_broadcast(cut(path, "main-path")))  # each branch node is compared with the path


def separation(tree: DataFrame, main: DataFrame, source: int, sink: int) -> DataFrame:
    """branch, leaf_far, sink_near, cosine, hausdorff: the first four measures of each branch.

    leaf_far: the greatest distance of a leaf and a main node. sink_near: the
    least distance of a node to the sink. cosine: the upper median over leaves of
    the cosine at the source between leaf and sink; null if no leaf is apart from
    the source. hausdorff: the greatest of the nodes' least distances to the main path.
    """
    nodes = cut(_placed(branches(tree, main), tree), "branch-places")
    end = lambda n, p: tree.where(F.col("node") == n).select(*(F.col(a).alias(f"{p}{a}") for a in AXES))
    rows = nodes.crossJoin(F.broadcast(end(sink, "t_").limit(1))).crossJoin(F.broadcast(end(source, "s_").limit(1)))  # one row each
    dot = sum((F.col(a) - F.col(f"s_{a}")) * (F.col(f"t_{a}") - F.col(f"s_{a}")) for a in AXES)
    angle = F.when(F.col("leaf"), dot / F.nullif(_apart("", "s_") * _apart("t_", "s_"), F.lit(0.0)))
    cosines = F.sort_array(F.collect_list(angle))  # the leaves of one branch
    plain = rows.groupBy("branch").agg(F.min(_apart("", "t_")).alias("sink_near"), cosines.alias("cs"))
    plain = plain.select("branch", "sink_near", F.get("cs", F.floor(F.size("cs") / 2).cast("int")).alias("cosine"))
    pairs = _with_main(nodes, tree, main).groupBy("branch", "node", "leaf").agg(F.min(_apart("", "m_")).alias("near"), F.max(_apart("", "m_")).alias("far"))
    far = pairs.groupBy("branch").agg(F.coalesce(F.max(F.when(F.col("leaf"), F.col("far"))), F.lit(0.0)).alias("leaf_far"), F.max("near").alias("hausdorff"))
    return far.join(plain, "branch").select("branch", "leaf_far", "sink_near", "cosine", "hausdorff")


def _first_cuts(tree: DataFrame, main: DataFrame, verdict: DataFrame) -> DataFrame:
    """node of the first nodes on the ways out from the main path whose verdict (node, cut, stop) is cut; stop ends a way without one."""
    verdict = cut(verdict.join(tree.select("node", "pred"), "node"), "cut-verdicts")
    front = verdict.join(main.select(F.col("node").alias("pred")), "pred", "left_semi")
    out = None
    while True:
        front = cut(front.select("node", "cut", "stop"), "cut-front")
        out = front.where("cut and not stop").select("node") if out is None else out.unionByName(front.where("cut and not stop").select("node"))
        go = front.where("not cut and not stop").select(F.col("node").alias("pred"))
        if go.isEmpty():
            return out
        front = verdict.join(go, "pred", "left_semi")


def cut_by_distance(tree: DataFrame, main: DataFrame, limit: float) -> DataFrame:
    """node: the edge from its pred is cut, being the first on its way whose end is further than limit from the main path."""
    rows = _placed(tree.join(main.select("node"), "node", "left_anti").select("node"), tree)
    near = _with_main(rows, tree, main).groupBy("node").agg(F.min(_apart("", "m_")).alias("near"))
    return _first_cuts(tree, main, near.select("node", (F.col("near") > limit).alias("cut"), F.lit(False).alias("stop")))


def _cap(a: Column, h: Column) -> Column:
    return math.pi / 6 * h * (3 * a * a + h * h)


def sphere_overlap(r: Column, big: Column, d: Column) -> Column:
    """Share of the sphere of radius r that the lens with one of radius big at distance d takes up, as two caps."""
    x = F.when(d > 1e-4, (d * d - r * r + big * big) / (2 * d)).otherwise(0.0)
    a = F.sqrt(big * big - x * x)
    lens = F.when(r + big <= d, 0.0).otherwise(_cap(a, big - x) + _cap(a, r - (d - x)))
    return lens / (4 * math.pi / 3 * r * r * r)


def cut_by_overlap(tree: DataFrame, main: DataFrame, limit: float, pardon: float) -> DataFrame:
    """node: the edge from its pred is cut, being the first on its way whose sphere (radius depth) overlaps none of the main path's by limit.

    Where weight and depth are both below pardon the way ends without a cut.
    Spheres within one another have no lens (the root of a negative number) and don't count.
    """
    rows = _placed(tree.join(main.select("node"), "node", "left_anti").select("node", "w"), tree)
    share = sphere_overlap(F.col("depth"), F.col("m_depth"), _apart("", "m_"))
    most = _with_main(rows, tree, main).groupBy("node", "w", "depth").agg(F.max(F.when(~F.isnan(share), share)).alias("most"))
    stop = (F.col("w") < pardon) & (F.col("depth") < pardon)
    return _first_cuts(tree, main, most.select("node", (F.coalesce("most", F.lit(0.0)) < limit).alias("cut"), stop.alias("stop")))


def free_ascent(links: DataFrame, starts: DataFrame, surface: DataFrame) -> DataFrame:
    """start, node: the surface nodes that each set of starts (start, node) reaches against the links a -> b; surface nodes end a way."""
    inner = links.join(surface.select(F.col("node").alias("b")), "b", "left_anti")
    front = seen = cut(starts.select("start", "node").distinct(), "ascent")
    step = 0
    while not front.isEmpty():
        step += 1
        new = front.join(inner, front["node"] == inner["b"]).select("start", F.col("a").alias("node")).distinct()
        front = cut(new.join(seen, ["start", "node"], "left_anti"), "ascent")
        seen = seen.unionByName(front)
        if step % 8 == 0:
            seen = cut(seen, "ascent-seen")
    return seen.join(surface.select("node"), "node", "left_semi").select("start", "node")


def _boxes(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*(f(a).alias(f"{a}{k}") for a in AXES for f, k in ((F.min, 0), (F.max, 1))))


def cut_by_boxes(tree: DataFrame, main: DataFrame, links: DataFrame, surface: DataFrame, limit: float) -> DataFrame:
    """node: the edge from its pred is cut, being the first of an unbranched run whose surface box overlaps the main path's by less than limit.

    A run goes from a branching (or the main path) to the next. Its box is that of
    the surface (node, x, y, z, t) that ascends from its nodes, its pred included;
    the overlap is taken as a share of that box, cells counted inclusively.
    """
    kids = tree.where("pred IS NOT NULL").groupBy(F.col("pred").alias("node")).agg(F.count("*").alias("kids"))
    off = tree.join(main.select("node"), "node", "left_anti").select("node", "pred")
    turns = main.select(F.col("node").alias("pred")).unionByName(kids.where("kids > 1").select(F.col("node").alias("pred"))).distinct()
    heads = cut(off.join(turns, "pred", "left_semi"), "run-heads")
    inner = off.join(heads.select("node"), "node", "left_anti").select(F.col("pred").alias("a"), F.col("node").alias("b"))
    runs = cut(reach(inner, heads.select("node")), "runs")
    starts = runs.unionByName(heads.select(F.col("node").alias("start"), F.col("pred").alias("node")))
    path = main.select(F.lit(-1).cast("long").alias("start"), "node")
    outer = free_ascent(links, starts.unionByName(path), surface).join(surface, "node")
    box = cut(_boxes(outer, ["start"]), "run-boxes")
    whole = box.where("start = -1").select(*(F.col(f"{a}{k}").alias(f"m_{a}{k}") for a in AXES for k in (0, 1)))
    both = box.where("start <> -1").crossJoin(F.broadcast(whole.limit(1)))  # one row
    volume, common = F.lit(1), F.lit(1)
    for a in AXES:
        volume = volume * (F.col(f"{a}1") - F.col(f"{a}0") + 1)
        common = common * F.greatest(F.least(f"{a}1", f"m_{a}1") - F.greatest(f"{a}0", f"m_{a}0") + 1, F.lit(0))
    verdict = both.select(F.col("start").alias("node"), (common / volume < limit).alias("cut"), F.lit(False).alias("stop"))
    # Runs as a tree: a run's pred is the head of the run that its head's pred lies in.
    up = heads.join(runs.select(F.col("start").alias("above"), F.col("node").alias("pred")), "pred", "left").select("node", F.coalesce("above", "pred").alias("pred"))
    return _first_cuts(up, main, verdict)
