"""Partitions, catchments, cluster graphs and shape measures of segments."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut, maybe_broadcast, numbered
from .components import component_of
from .fixpoint import components, voxel_edges, waves
from .proximity import nearest
from .stencil import AXES, KEY, gather, linear_index, near, offsets, shifted


def partition_by_weight(vox: DataFrame, seeds: DataFrame) -> DataFrame:
    """KEY, label: the seed (x, y, z, t, label, reach) with the least distance over reach; the smaller label on ties.

    Seeds are a stated query set: one packed row for each volume.
    """
    packed = seeds.groupBy("vol_id").agg(F.collect_list(F.struct("label", "reach", *AXES)).alias("ss"))
    weight = lambda s: F.round(F.sqrt(sum((F.col(a) - s[a]) * (F.col(a) - s[a]) for a in AXES)) / s["reach"], 9)
    best = F.array_min(F.transform("ss", lambda s: F.struct(weight(s).alias("w"), s["label"].alias("label"))))
    return vox.select(*KEY).join(maybe_broadcast(packed, seeds.count()), "vol_id").select(*KEY, best["label"].alias("label"))


def grow_within(fg: DataFrame, seeds: DataFrame, radius: float, offs) -> DataFrame:
    """KEY, origin: voxels that a seed (vol_id, origin, x..t) reaches through voxels nearer to it than radius."""
    home = seeds.select("vol_id", "origin", *(F.col(a).alias(f"o{a}") for a in AXES))
    ball = fg.select(*KEY).join(home, "vol_id").where(sum((F.col(a) - F.col(f"o{a}")) * (F.col(a) - F.col(f"o{a}")) for a in AXES) < radius * radius)
    ball = cut(ball.select(*KEY, "origin"), "ball")
    front = seen = cut(ball.join(seeds.select("origin", *KEY), ["origin", *KEY]), "trace")
    while True:
        sent = shifted(front, offs, ["origin"]).select(*KEY, "origin").distinct()
        front = cut(ball.join(sent, [*KEY, "origin"]).join(seen, [*KEY, "origin"], "left_anti"), "trace")
        if front.isEmpty():
            return seen.select(*KEY, "origin")
        seen = seen.unionByName(front)


def catchment_links(peaks: DataFrame, offs) -> DataFrame:
    """pa < pb, n: peaks whose catchments (KEY, peak) touch, with the count of touching pairs."""
    sent = shifted(peaks, offs, ["peak"]).select(*KEY, F.col("peak").alias("q"))
    return peaks.join(sent, KEY).where("peak < q").groupBy(F.col("peak").alias("pa"), F.col("q").alias("pb")).agg(F.count("*").alias("n"))


def cluster_graph(gen: DataFrame, offs, dims) -> tuple[DataFrame, DataFrame]:
    """Clusters of equal wave (KEY, wave, label) and links (la of wave g, lb of wave g + 1, contacts)."""
    lab = cut(components(gen, offs, dims, same=["wave"]), "wave-clusters")
    sent = shifted(lab, offs, ["label", "wave"]).select(*KEY, F.col("label").alias("la"), F.col("wave").alias("g"))
    links = lab.join(sent, KEY).where("wave = g + 1").groupBy("la", F.col("label").alias("lb")).agg(F.count("*").alias("contacts"))
    return lab, links


def split_clusters(clusters: DataFrame, links: DataFrame, dims) -> DataFrame:
    """KEY, wave, label, child, piece: clusters cut until each has one descendant at most.

    clusters and links as from cluster_graph(). From the last wave backwards, the voxels
    of a cluster with several descendants go to that with the nearest voxel (the
    smaller piece on ties), and all ascendants of the cluster are ascendants of each of its
    pieces. A piece is named by the least linear index of its voxels, child is its
    descendant's name or null. One search of nearest voxels for each wave; the waves are
    the depth of the volume. One volume a run, of up to three axes.
    """
    rows = cut(clusters.select(*KEY, "wave", "label", linear_index(dims).alias("id")), "split-clusters")
    links = cut(links.select("la", "lb").distinct(), "split-links")
    place = [F.col(a).cast("double").alias(f"p{a}") for a in "xyz"]
    out, below = None, None
    for g in sorted((r[0] for r in rows.select("wave").distinct().collect()), reverse=True):  # as many as the volume is deep
        now = rows.where(F.col("wave") == g)
        if below is None:
            now = now.withColumn("child", F.lit(None).cast("long"))
        else:
            of = links.join(below.select(F.col("label").alias("lb"), "piece").distinct(), "lb").select(F.col("la").alias("label"), "piece").distinct()
            several = cut(of.groupBy("label").agg(F.count("*").alias("n_"), F.min("piece").alias("only_")), "split-children")
            wide = several.where("n_ > 1").select("label")
            ends = of.join(wide, "label", "left_semi").join(below.select("piece", *place), "piece").select("label", F.col("piece").alias("id"), *(f"p{a}" for a in "xyz"))
            found = nearest(now.join(wide, "label", "left_semi").select("id", "label", *place), cut(ends, "split-ends"), by=("label",))
            now = now.join(several, "label", "left").join(found.select("id", "core"), "id", "left").withColumn("child", F.when(F.col("n_") > 1, F.col("core")).otherwise(F.col("only_")))
        names = now.groupBy("label", "child").agg(F.min("id").alias("piece"))
        named = now.join(names.withColumnRenamed("child", "child_").withColumnRenamed("label", "label_"), (F.col("label") == F.col("label_")) & F.col("child").eqNullSafe(F.col("child_")))
        below = cut(named.select(*KEY, "wave", "label", "child", "piece"), "split-wave")
        out = below if out is None else out.unionByName(below)
    return out if out is not None else rows.select(*KEY, "wave", "label", F.lit(None).cast("long").alias("child"), F.col("id").alias("piece"))


def cluster_coreness(clusters: DataFrame, links: DataFrame, offs, limit: float) -> DataFrame:
    """label, coreness, core: clusters by how little leads on from them.

    coreness is the count of their descendants' voxels next to them over that of their
    ascendants'; null without ascendants. A core has less than limit and no descendant with less.
    """
    own = clusters.select(*KEY, "wave", "label")
    sent = shifted(own, offs, ["label", "wave"]).select(*KEY, F.col("label").alias("of"), F.col("wave").alias("ow"))
    touching = own.join(sent, KEY).where("abs(wave - ow) = 1").select(*KEY, "of", (F.col("wave") > F.col("ow")).alias("down")).distinct()
    sides = touching.groupBy(F.col("of").alias("label")).agg(F.count_if("down").alias("n_down"), F.count_if(~F.col("down")).alias("n_up"))
    score = clusters.select("label").distinct().join(sides, "label", "left").na.fill(0, ["n_down", "n_up"])
    score = cut(score.select("label", F.when(F.col("n_up") > 0, F.col("n_down") / F.col("n_up")).alias("coreness")), "coreness")
    low = score.where(F.col("coreness") < limit).select(F.col("label").alias("lb"))
    over = links.select("la", "lb").distinct().join(low, "lb", "left_semi").select(F.col("la").alias("label"), F.lit(True).alias("over_")).distinct()
    return score.join(over, "label", "left").select("label", "coreness", (F.coalesce(F.col("coreness") < limit, F.lit(False)) & F.col("over_").isNull()).alias("core"))


def convexity(fg: DataFrame, dims, ndim: int = 3) -> DataFrame:
    """vol_id, measure: greatest difference of path length and city-block distance from the voxel nearest the centroid, over the longest path."""
    mean = fg.groupBy("vol_id").agg(*(F.avg(a).alias(f"m{a}") for a in AXES))
    d2 = F.round(sum((F.col(a) - F.col(f"m{a}")) * (F.col(a) - F.col(f"m{a}")) for a in AXES), 9)
    centre = fg.join(mean, "vol_id").groupBy("vol_id").agg(F.min(F.struct(d2.alias("d"), linear_index(dims).alias("i"), *AXES)).alias("c"))
    centre = cut(centre.select("vol_id", *(F.col(f"c.{a}").alias(a) for a in AXES)), "centre")
    depth = waves(fg, centre, offsets(ndim, "face"))
    home = centre.select("vol_id", *(F.col(a).alias(f"c{a}") for a in AXES))
    straight = sum(F.abs(F.col(a) - F.col(f"c{a}")) for a in AXES)
    return depth.join(home, "vol_id").groupBy("vol_id").agg((F.max(F.abs(F.col("wave") - straight)) / F.greatest(F.max("wave"), F.lit(1))).alias("measure"))


def pseudo_divergence(vox: DataFrame, value: str, weight: str, centre: dict[str, float], axes: str = "xyz") -> DataFrame:
    """vol_id, score: arc tangent of 1e-5 times the weighted inward flow of the gradient about a centre."""
    from .stencil import gradient

    g = gradient(vox, axes, value)
    flow = sum(F.col(f"g_{a}") * (F.col(a) - F.lit(float(centre[a]))) for a in axes)
    return g.groupBy("vol_id").agg(F.atan(F.lit(1e-5) * -F.sum(F.col(weight) * flow)).alias("score"))


def opposite_contacts(fg: DataFrame, ndim: int) -> DataFrame:
    """KEY, opposite: whether neighbours on two opposite faces are both present."""
    faces = offsets(ndim, "face")
    bit = sum(F.when(F.struct(*(F.col(f"o.d{a}") for a in AXES)) == F.struct(*(F.lit(c) for c in d)), 1 << i).otherwise(0) for i, d in enumerate(faces))
    g = gather(fg.select(*KEY), faces, {"bits": F.coalesce(F.sum(near(bit)), F.lit(0))}, [])
    both = F.lit(False)
    for i, d in enumerate(faces):
        j = faces.index(tuple(-c for c in d))
        if i < j:
            both = both | (F.col("bits").bitwiseAND((1 << i) | (1 << j)) == ((1 << i) | (1 << j)))
    return g.select(*KEY, both.alias("opposite"))


def _crossings(ndim: int) -> list[int]:
    """Bits of the directions that must all be there: opposite pairs in 2-D; in 3-D two opposite pairs in a plane, which two
    vectors span: themselves, or their sum and difference. The planes are those of two axes, and of x or y and a diagonal
    of the two other axes."""
    bit = lambda d: 1 << sum((c + 1) * 3**k for k, c in enumerate(d))
    pair = lambda d: bit(d) | bit(tuple(-c for c in d))
    if ndim == 2:
        return sorted({pair(d[:2]) for d in offsets(2)})
    x, y, z = (1, 0, 0), (0, 1, 0), (0, 0, 1)
    add = lambda u, v, k=1: tuple(a + k * b for a, b in zip(u, v))
    spans = [(x, y), (x, z), (y, z), *((a, add(b, z, k)) for a, b in ((x, y), (y, x)) for k in (1, -1))]
    return [pair(a) | pair(b) for u, v in spans for a, b in ((u, v), (add(u, v), add(u, v, -1)))]


def collisions(nodes: DataFrame, links: DataFrame, ndim: int) -> DataFrame:
    """KEY, collides: whether links (KEY, dx, dy, dz) of a node lead from opposite sides: an opposite pair in 2-D, one of 14
    planar quadruples in 3-D. Nodes without links don't collide; one partial aggregate of bits for each node."""
    place = sum((F.col(f"d{a}") + 1) * 3**k for k, a in enumerate(AXES[:ndim]))
    bits = links.groupBy(*KEY).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))).alias("bits"))
    found = F.lit(False)
    for m in _crossings(ndim):
        found = found | (F.col("bits").bitwiseAND(m) == m)
    return nodes.select(*KEY).join(bits, KEY, "left").select(*KEY, F.coalesce(found, F.lit(False)).alias("collides"))


def depth_first(edges: DataFrame, graph: str = "graph_id") -> DataFrame:
    """graph_id, node, found, done: discovery and finishing times, nodes and targets in ascending order; one group per graph."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        after: dict[int, list[int]] = {}
        for a, b in sorted(zip(pdf["a"], pdf["b"])):
            after.setdefault(a, []).append(b)
            after.setdefault(b, [])
        found, done, time = {}, {}, 0
        for root in sorted(after):
            if root in found:
                continue
            found[root], time = time, time + 1
            stack = [(root, iter(after[root]))]
            while stack:
                node, rest = stack[-1]
                nxt = next((b for b in rest if b not in found), None)
                if nxt is None:
                    done[node], time = time, time + 1
                    stack.pop()
                else:
                    found[nxt], time = time, time + 1
                    stack.append((nxt, iter(after[nxt])))
        return pd.DataFrame([(pdf[graph].iloc[0], k, found[k], done[k]) for k in found], columns=[graph, "node", "found", "done"])

    return edges.groupBy(graph).applyInPandas(run, f"{graph} bigint, node bigint, found int, done int")


def cover(tree: DataFrame, terminals: DataFrame) -> DataFrame:
    """Edges (a, b) of a forest that lie between terminals (node): leaves that aren't terminals are stripped until none is left."""
    now = cut(tree.select("a", "b").distinct(), "cover")
    while True:
        degree = now.select(F.col("a").alias("node")).unionByName(now.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("k"))
        leaves = cut(degree.where("k = 1").select("node").join(terminals.select("node"), "node", "left_anti"), "leaves")
        if leaves.isEmpty():
            return now
        now = cut(now.join(leaves.withColumnRenamed("node", "a"), "a", "left_anti").join(leaves.withColumnRenamed("node", "b"), "b", "left_anti"), "cover")


def _merges(pdf: pd.DataFrame) -> pd.DataFrame:
    """All merges of one connected part in order, with the greatest (cost, ra, rb) up to each."""
    near_: dict[int, dict[int, tuple[float, int]]] = {}
    size: dict[int, int] = {}
    for a, b, w, cut_, sa, sb in zip(*(pdf[c].tolist() for c in ("a", "b", "w", "cut", "sa", "sb"))):
        size[a], size[b] = sa, sb
        near_.setdefault(a, {})[b] = near_.setdefault(b, {})[a] = (w, cut_)
    cost = lambda a, b: (near_[a][b][0] / near_[a][b][1] * min(size[a], size[b]), min(a, b), max(a, b))
    heap = [cost(a, b) for a in near_ for b in near_[a] if a < b]
    heapify(heap)
    rows, most = [], None
    while heap:
        best = heappop(heap)
        _, a, b = best
        if b not in near_.get(a, ()) or cost(a, b) != best:
            continue  # one of them is merged, or grew
        most = best if most is None else max(most, best)
        rows.append((*most, len(rows), a, b))
        size[a] += size.pop(b)
        for c, (w, cut_) in near_.pop(b).items():
            del near_[c][b]
            if c != a:
                v, n = near_[a].get(c, (w, 0))
                near_[a][c] = near_[c][a] = (min(v, w), n + cut_)
        for c in near_[a]:
            heappush(heap, cost(a, c))
    return pd.DataFrame(rows, columns=["mc", "ma", "mb", "step", "a", "b"])


def agglomerate(sizes: DataFrame, contacts: DataFrame, clusters: int) -> DataFrame:
    """node, root after merging, one pair at a time, the pair of least w / cut * min(size), until `clusters` are left.

    sizes (node, size), contacts (a, b, w, cut): small tables of clusters, not of voxels. Ties go to the smaller pair. A merge
    changes costs of its own connected part alone, so each part is one group that merges to its end.
    Taking the least first over all parts is the order of the greatest merge of a part so far, then of its own steps.
    """
    pairs = contacts.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("w").cast("double").alias("w"), F.sum("cut").alias("cut"))
    pairs = cut(pairs, "agglomerate")
    part = component_of(sizes.select("node"), pairs.select("a", "b"))
    side = lambda n: sizes.join(part, "node").select(F.col("node").alias(n), F.col("size").alias(f"s{n}"), *([F.col("root").alias("part")] if n == "a" else []))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    merges = rows.groupBy("part").applyInPandas(_merges, "mc double, ma bigint, mb bigint, step int, a bigint, b bigint")
    taken = numbered(merges, [], ["mc", "ma", "mb", "step"], "place").where(F.col("place") <= sizes.count() - clusters)
    return component_of(sizes.select("node"), taken.select("a", "b"))


def particles(fg: DataFrame, dims) -> DataFrame:
    """fg with id: the rank of each voxel in raster order within its volume."""
    return numbered(fg.withColumn("index_", linear_index(dims)), ["vol_id"], ["index_"], "id", first=0).drop("index_")


def graph_of(fg: DataFrame, offs, dims) -> DataFrame:
    """a, b: neighbour links of particles by their ids, a < b."""
    ids = particles(fg, dims).select("vol_id", linear_index(dims).alias("i"), "id")
    e = voxel_edges(fg, offs, dims)
    return e.join(ids.select("vol_id", F.col("i").alias("a"), F.col("id").alias("ia")), ["vol_id", "a"]).join(ids.select("vol_id", F.col("i").alias("b"), F.col("id").alias("ib")), ["vol_id", "b"]).select("vol_id", F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))
