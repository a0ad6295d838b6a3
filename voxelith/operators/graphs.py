"""Graph algorithms on edge tables (a, b, w)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import cut
from .components import component_of, stars


def spanning_forest(edges: DataFrame) -> DataFrame:
    """a, b, w of the minimum spanning forest; ties go to the smaller (w, a, b). Boruvka: rounds are logarithmic."""
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").where("a < b").groupBy("a", "b").agg(F.min("w").alias("w")), "mst-edges")
    chosen = edges.limit(0)
    now = edges.select("a", "b", "w", F.col("a").alias("ra"), F.col("b").alias("rb"))
    while True:  # edges between roots: a round's components are those of the roots it joins
        ends = now.select(F.col("ra").alias("r"), "w", "a", "b", "ra", "rb").unionByName(now.select(F.col("rb").alias("r"), "w", "a", "b", "ra", "rb"))
        best = ends.groupBy("r").agg(F.min(F.struct("w", "a", "b", "ra", "rb")).alias("e")).select("e.*").distinct()
        best = cut(best, "mst-round")
        if best.isEmpty():
            return chosen.select("a", "b", "w")
        chosen = cut(chosen.unionByName(best.select("a", "b", "w")), "mst-chosen")
        tree = stars(best.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        ra, rb = tree.select(F.col("a").alias("ra"), F.col("b").alias("na")), tree.select(F.col("a").alias("rb"), F.col("b").alias("nb"))
        now = now.join(ra, "ra", "left").join(rb, "rb", "left").withColumns({"ra": F.coalesce("na", "ra"), "rb": F.coalesce("nb", "rb")}).where("ra <> rb")
        now = cut(now.select("a", "b", "w", "ra", "rb"), "mst-left")


def shortest_paths(edges: DataFrame, source) -> DataFrame:
    """node, dist, pred from source over directed edges with w >= 0; unreachable nodes have no row; the smaller pred on ties."""
    spark = edges.sparkSession
    edges = cut(edges.select("a", "b", "w"), "sssp-edges")
    best = front = cut(spark.range(1).select(F.lit(source).cast("long").alias("node"), F.lit(0.0).alias("dist")), "sssp")
    while True:
        offered = front.join(edges, front["node"] == edges["a"]).groupBy(F.col("b").alias("node")).agg(F.min(F.col("dist") + F.col("w")).alias("offer"))
        front = offered.join(best, "node", "left").where(F.col("dist").isNull() | (F.col("offer") < F.col("dist"))).select("node", F.col("offer").alias("dist"))
        front = cut(front, "sssp-front")
        if front.isEmpty():
            break
        best = cut(best.unionByName(front).groupBy("node").agg(F.min("dist").alias("dist")), "sssp")
    into = edges.join(best.select(F.col("node").alias("a"), F.col("dist").alias("da")), "a").join(best.select(F.col("node").alias("b"), "dist"), "b")
    pred = into.where(F.abs(F.col("da") + F.col("w") - F.col("dist")) <= 1e-9).where("w > 0").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("pred"))
    return best.join(pred, "node", "left")


def path_to(tree: DataFrame, target: int) -> DataFrame:
    """node, hops along pred from target back to the source of shortest_paths()."""
    step = cut(tree.where(F.col("node") == target).select("node", "pred", F.lit(0).alias("hops")), "path")
    out, hops = step, 0
    while not step.where("pred IS NOT NULL").isEmpty():
        hops += 1
        step = cut(step.select(F.col("pred").alias("node")).join(tree.select("node", "pred"), "node").withColumn("hops", F.lit(hops)), "path")
        out = out.unionByName(step)
    return out.select("node", "hops")


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, scc: the smallest node of each strongly connected component.

    Forward colours (the smallest node that reaches each) and backward reach
    within a colour from its root split off one component per colour and round;
    nodes without predecessors or successors left are components of their own.
    """
    left_e = cut(edges.select("a", "b").where("a <> b").distinct(), "scc-edges")
    left_n = cut(nodes.select("node").distinct(), "scc-nodes")
    done = None
    while True:
        inner = left_e.select(F.col("b").alias("node")).distinct().join(left_e.select(F.col("a").alias("node")).distinct(), "node", "left_semi")
        single = left_n.join(inner, "node", "left_anti").withColumn("scc", F.col("node"))
        found = cut(single, "scc-single")
        if found.isEmpty():
            colour = cut(left_n.withColumn("c", F.col("node")), "scc-colour")
            while True:
                sent = left_e.join(colour.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("c").alias("m"))
                new = cut(colour.join(sent, "node", "left").select("node", F.least("c", "m").alias("c"), (F.col("m") < F.col("c")).alias("moved")), "scc-colour")
                still = new.where("moved").limit(1).count()
                colour = new.select("node", "c")
                if not still:
                    break
            back = seen = cut(colour.where("node = c"), "scc-back")
            within = left_e.join(colour.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(colour.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b").where("ca = cb").select("a", "b", F.col("ca").alias("c"))
            within = cut(within, "scc-within")
            while True:
                back = within.join(back.select(F.col("node").alias("b")), "b").select(F.col("a").alias("node"), "c").distinct().join(seen, "node", "left_anti")
                back = cut(back, "scc-back")
                if back.isEmpty():
                    break
                seen = seen.unionByName(back)
            found = cut(seen.select("node", F.col("c").alias("scc")), "scc-found")
        done = found if done is None else done.unionByName(found)
        left_n = cut(left_n.join(found, "node", "left_anti"), "scc-nodes")
        if left_n.isEmpty():
            return done
        gone = found.select("node")
        left_e = cut(left_e.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti"), "scc-edges")


def cut_tree(nodes: DataFrame, tree: DataFrame, k: int) -> DataFrame:
    """node, root after removing from a spanning tree all edges of at least the k-th largest weight; none are kept if k reaches the count."""
    top = tree.orderBy(F.col("w").desc()).limit(k).agg(F.count("*").alias("n"), F.min("w").alias("t"))
    limit = top.select(F.when(F.col("n") < k, F.lit(0.0)).otherwise(F.col("t")).alias("t"))
    kept = tree.crossJoin(F.broadcast(limit)).where("w < t").select("a", "b")  # limit is one row
    return component_of(nodes, kept)


def outlier_cut(nodes: DataFrame, tree: DataFrame) -> DataFrame:
    """node, root after removing edges longer than Q3 + 1.5 (Q3 - Q1), quartiles being elements."""
    from .statistics import element_quantile

    q = element_quantile(tree.select(F.col("w").alias("v")), "v", {"q1": 0.25, "q3": 0.75})
    kept = tree.crossJoin(F.broadcast(q)).where("w <= q3 + 1.5 * (q3 - q1)").select("a", "b")  # q is one row
    return component_of(nodes, kept)
