"""Graph algorithms on derived graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs as R
from ..operators.components import component_of
from ..operators.proximity import epsilon_classes, expand_classes
from .grid_queries import D2, POINTS, points
from .registry import query
from .tables import cut, numbered

#: Suppliers as nodes, pairs nearer than 12 as edges; weights in whole hundredths, so sums are exact.
NET = f"{POINTS}, net AS (SELECT a.id AS a, b.id AS b, CAST(round(100 * sqrt({D2})) AS DOUBLE) AS w FROM pts a JOIN pts b ON a.id < b.id AND {D2} < 144)"
#: Prim's rule as one order: an edge is in the forest if no path of smaller edges joins its ends.
MST = f"{NET}, o AS (SELECT *, row_number() OVER (ORDER BY w, a, b) AS k FROM net), both_ AS (SELECT a, b, k FROM o UNION ALL SELECT b, a, k FROM o)"
DIRECTED = "arc AS (SELECT s_suppkey AS a, s_suppkey * 7 % 100 AS b, CAST(1 + s_suppkey % 5 AS DOUBLE) AS w FROM supplier UNION SELECT s_suppkey, (s_suppkey * 3 + 1) % 100, CAST(2 + s_suppkey % 3 AS DOUBLE) FROM supplier)"


def _weight():
    return F.round(100 * F.col("dist")).alias("w")


def net(spark, sf):
    """All edges: their number grows with the square of the suppliers at a place."""
    return expand_classes(*epsilon_classes(points(spark, sf), 12.0)).select("a", "b", _weight())


def lean_net(spark, sf):
    return lean_edges(points(spark, sf))


def lean_edges(at):
    """Edges of the points at, with the components and the minimum spanning forest of net(): those between the smallest ids of places, and a star at each place.

    At a place the edges (0, a, b) of the smallest a come first and join all its suppliers. Of the
    edges between two places the one of the smallest ids comes first; the others close a circle with it and the stars. A place with an edge of weight 0 to
    another, whose edges would mix with the star's, keeps all its edges.
    """
    pairs, members = epsilon_classes(at, 12.0)
    star = members.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("w"))
    mixed = pairs.where(_weight() == 0)
    mixed = cut(mixed.select(F.col("a").alias("rep")).unionByName(mixed.select(F.col("b").alias("rep"))).distinct(), "mixed-places")
    out = pairs.select("a", "b", _weight()).unionByName(star)
    if mixed.isEmpty():
        return out
    whole = members.join(mixed, "rep").unionByName(members.join(mixed, "rep", "left_anti").where("id = rep"))
    return out.unionByName(expand_classes(pairs, whole).select("a", "b", _weight())).distinct()


def arcs(spark, sf):
    s, k = spark.read.parquet(f"{sf}/supplier.parquet"), F.col("s_suppkey")
    one = s.select(k.alias("a"), (k * 7 % 100).alias("b"), (1 + k % 5).cast("double").alias("w"))
    return one.unionByName(s.select(k.alias("a"), ((k * 3 + 1) % 100).alias("b"), (2 + k % 3).cast("double").alias("w"))).distinct()


def _nodes(spark, sf):
    return points(spark, sf).select(F.col("id").alias("node"))


@query("gr02_listing", f"WITH {NET} SELECT b AS src, a AS dst, w, CAST(row_number() OVER (ORDER BY w, b, a) AS INT) AS place FROM net")
def gr02(spark, sf):
    """Edges turned around and numbered by weight."""
    turned = net(spark, sf).select(F.col("b").alias("src"), F.col("a").alias("dst"), "w")
    return numbered(turned, [], ["w", "src", "dst"], "place", rows=turned.count()).select("src", "dst", "w", "place")


@query("gr05_clusters", f"WITH RECURSIVE {NET}, nb AS (SELECT a, b FROM net UNION ALL SELECT b, a FROM net), cc(node, root) USING KEY (node) AS (SELECT id, id FROM pts UNION SELECT e.b, min(c.root) FROM cc c JOIN nb e ON e.a = c.node JOIN recurring.cc r ON r.node = e.b WHERE c.root < r.root GROUP BY e.b) SELECT node, root FROM cc")
def gr05(spark, sf):
    return component_of(_nodes(spark, sf), lean_net(spark, sf).select("a", "b")).select("node", "root")


#: k of the largest edge on the best path, by relaxation: minimax distances; an edge is chosen if it is its own minimax.
MINIMAX = f"{MST}, mm(a, b, k) USING KEY (a, b) AS (SELECT a, b, k FROM both_ UNION SELECT m.a, e.b, min(greatest(m.k, e.k)) FROM mm m JOIN both_ e ON e.a = m.b AND e.b <> m.a LEFT JOIN recurring.mm r ON r.a = m.a AND r.b = e.b WHERE r.k IS NULL OR greatest(m.k, e.k) < r.k GROUP BY m.a, e.b), mst AS (SELECT o.a, o.b, o.w FROM o JOIN mm ON mm.a = o.a AND mm.b = o.b WHERE mm.k = o.k)"


@query("gr06_spanning_forest", f"WITH RECURSIVE {MINIMAX} SELECT a, b, w FROM mst")
def gr06(spark, sf):
    return R.spanning_forest(lean_net(spark, sf)).select("a", "b", "w")


@query("gr07_shortest_paths", f"WITH RECURSIVE {DIRECTED}, d(node, dist) USING KEY (node) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS DOUBLE) UNION SELECT e.b, min(d.dist + e.w) FROM d JOIN arc e ON e.a = d.node LEFT JOIN recurring.d r ON r.node = e.b WHERE r.dist IS NULL OR d.dist + e.w < r.dist GROUP BY e.b), p AS (SELECT e.b AS node, min(e.a) AS pred FROM arc e JOIN d x ON x.node = e.a JOIN d y ON y.node = e.b WHERE x.dist + e.w = y.dist GROUP BY 1) SELECT node, dist, pred FROM d LEFT JOIN p USING (node)")
def gr07(spark, sf):
    return R.shortest_paths(arcs(spark, sf), 1).select("node", "dist", "pred")


@query("gr08_path", f"WITH RECURSIVE {DIRECTED}, d(node, dist) USING KEY (node) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS DOUBLE) UNION SELECT e.b, min(d.dist + e.w) FROM d JOIN arc e ON e.a = d.node LEFT JOIN recurring.d r ON r.node = e.b WHERE r.dist IS NULL OR d.dist + e.w < r.dist GROUP BY e.b), p AS (SELECT e.b AS node, min(e.a) AS pred FROM arc e JOIN d x ON x.node = e.a JOIN d y ON y.node = e.b WHERE x.dist + e.w = y.dist GROUP BY 1), far AS (SELECT node FROM d ORDER BY dist DESC, node LIMIT 1), path(node, hops) AS (SELECT node, 0 FROM far UNION ALL SELECT p.pred, hops + 1 FROM path JOIN p ON p.node = path.node) SELECT node, hops FROM path")
def gr08(spark, sf):
    """The shortest path to the farthest node, walked back."""
    tree = R.cut(R.shortest_paths(arcs(spark, sf), 1), "sssp-tree")
    far = tree.orderBy(F.col("dist").desc(), "node").first()["node"]
    return R.path_to(tree, far)


@query("gr09_strong_components", f"WITH RECURSIVE {DIRECTED}, reach(a, b) AS (SELECT a, b FROM arc UNION SELECT r.a, e.b FROM reach r JOIN arc e ON e.a = r.b), n AS (SELECT a AS node FROM arc UNION SELECT b FROM arc), m AS (SELECT x.a AS node, min(x.b) AS other FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a GROUP BY 1) SELECT node, least(node, coalesce(other, node)) AS scc FROM n LEFT JOIN m USING (node)")
def gr09(spark, sf):
    e = arcs(spark, sf)
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    return R.strong_components(nodes, e).select("node", "scc")


@query("gr10_outlier_cut", f"WITH RECURSIVE {MINIMAX}, q AS (SELECT list(w ORDER BY w) AS v FROM mst), t AS (SELECT v[CAST(floor(len(v) * 0.25) AS INT) + 1] AS q1, v[CAST(floor(len(v) * 0.75) AS INT) + 1] AS q3 FROM q), nb AS (SELECT a, b FROM mst, t WHERE w <= q3 + 1.5 * (q3 - q1)), n2 AS (SELECT a, b FROM nb UNION ALL SELECT b, a FROM nb), cc(node, root) USING KEY (node) AS (SELECT id, id FROM pts UNION SELECT e.b, min(c.root) FROM cc c JOIN n2 e ON e.a = c.node JOIN recurring.cc r ON r.node = e.b WHERE c.root < r.root GROUP BY e.b) SELECT node, root FROM cc")
def gr10(spark, sf):
    return R.outlier_cut(_nodes(spark, sf), R.spanning_forest(lean_net(spark, sf))).select("node", "root")


@query("gr11_tree_cut", f"WITH RECURSIVE {MINIMAX}, t AS (SELECT min(w) AS t FROM (SELECT w FROM mst ORDER BY w DESC LIMIT 3)), nb AS (SELECT a, b FROM mst, t WHERE w < t), n2 AS (SELECT a, b FROM nb UNION ALL SELECT b, a FROM nb), cc(node, root) USING KEY (node) AS (SELECT id, id FROM pts UNION SELECT e.b, min(c.root) FROM cc c JOIN n2 e ON e.a = c.node JOIN recurring.cc r ON r.node = e.b WHERE c.root < r.root GROUP BY e.b) SELECT node, root FROM cc")
def gr11(spark, sf):
    return R.cut_tree(_nodes(spark, sf), R.spanning_forest(lean_net(spark, sf)), 3).select("node", "root")
