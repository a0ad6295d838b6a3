"""The whole programs as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fixpoint as P
from ..operators import segments as M
from ..operators import stencil as S
from ..operators.distance import few_volumes
from ..operators.extraction import bounded_trace, downhill
from ..sources import grids as G
from . import applications as W
from .extraction_queries import SIDES, _clicks
from .field_queries import C0, RD, _c0, _level
from .fixpoint_queries import BDIMS, _seeds
from .grid_queries import DIMS
from .registry import query
from .segment_queries import ENDS


@query("app_smoothen_volume", f"WITH {G.GRID3}, c0 AS (SELECT x, y, z, val AS c FROM grid3), {', '.join(_level(f'c{k}', f'c{k + 1}', '0.5 * a.c + 0.5 * {near} / 6') for k in range(5))} SELECT z, round(sum(c), 2) AS total FROM c5 GROUP BY z")
def smoothen(spark, sf):
    return W.smoothen_volume(G.grid3(spark, sf)).groupBy("z").agg(F.round(F.sum("val"), 2).alias("total"))


@query("app_dtw_volume", f"WITH RECURSIVE {G.GRID3}, f AS (SELECT x, y, list(CAST(n AS DOUBLE) ORDER BY z) AS v FROM grid3 GROUP BY x, y), r AS (SELECT [12.0, 11.0, 10.0, 12.0, 13.0, 11.0, 12.0, 14.0, 12.0] AS w), d(x, y, i, col) AS (SELECT x, y, 0, list_prepend(0.0, list_transform(range(9), lambda k: CAST('inf' AS DOUBLE))) FROM f WHERE len(v) = 9 UNION ALL SELECT d.x, d.y, i + 1, list_reduce(list_transform(range(1, 10), lambda j: [abs(f.v[i + 1] - r.w[j]) + least(d.col[j], d.col[j + 1]), abs(f.v[i + 1] - r.w[j])]), lambda acc, e: list_append(acc, least(e[1], e[2] + acc[len(acc)])), [CAST('inf' AS DOUBLE)]) FROM d JOIN f ON f.x = d.x AND f.y = d.y CROSS JOIN r WHERE i < 9) SELECT f.x, f.y, round(col[10], 4) AS cost FROM f LEFT JOIN d ON d.x = f.x AND d.y = f.y AND d.i = 9")
def dtw_fibres(spark, sf):
    reference = [12.0, 11.0, 10.0, 12.0, 13.0, 11.0, 12.0, 14.0, 12.0]
    return W.dtw_volume(G.grid3(spark, sf), reference, "n").select("x", "y", F.round("cost", 4).alias("cost"))


IDX = "x + 51 * (y + 11 * z)"


@query("app_figure_ground", f"WITH RECURSIVE {G.GRID3}, {C0}, {', '.join(_level(f'c{k}', f'c{k + 1}', RD) for k in range(4))}, m AS (SELECT x, y, z, CASE WHEN c > 0.5 THEN 1 ELSE 0 END AS mask FROM c4), bg AS (SELECT x, y, z FROM m WHERE mask = 0), f4(dx, dy) AS (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)), nb AS (SELECT a.x + 51 * (a.y + 11 * a.z) AS a, b.x + 51 * (b.y + 11 * b.z) AS b FROM bg a CROSS JOIN f4 JOIN bg b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z), cc(node, root) USING KEY (node) AS (SELECT {IDX}, {IDX} FROM bg UNION SELECT e.b, min(c.root) FROM cc c JOIN nb e ON e.a = c.node JOIN recurring.cc r ON r.node = e.b WHERE c.root < r.root GROUP BY e.b), h AS (SELECT root FROM cc GROUP BY root HAVING count(*) < 300 AND NOT bool_or(node % 51 IN (0, 50) OR node // 51 % 11 IN (0, 10))) SELECT x, y, z, CASE WHEN mask = 1 OR root IN (SELECT root FROM h) THEN 1 ELSE 0 END AS mask FROM m LEFT JOIN cc ON node = {IDX}")
def figure(spark, sf):
    return W.figure_ground(_c0(spark, sf), "c", DIMS).select("x", "y", "z", "mask")


@query("app_convexify")
def convex(spark, sf):
    """Foreground of each supplier's volume within the hull of what its first spot traces strictly downhill."""
    scans = G.scans(spark, sf, deal=few_volumes()).withColumn("mask", (F.col("val") > 250).cast("int"))
    depth = W.depth_of(scans, SIDES, by_volume=True).withColumn("d", F.sqrt("d"))
    trace, _ = bounded_trace(depth, _clicks(spark, sf).withColumn("trial", F.lit(0)), 1.01, downhill)
    return W.convexify(depth.select(*W.KEY), S.surface(trace.select(*W.KEY), 3)).select("vol_id", "x", "y", "z")


@query("app_core_partition", f"WITH RECURSIVE {ENDS}, c AS (SELECT peak, count(*) AS size FROM pk GROUP BY peak HAVING count(*) >= 20), l AS (SELECT peak, CAST(row_number() OVER (ORDER BY peak) AS INT) AS label FROM c) SELECT x, y, z, label FROM pk JOIN l USING (peak)")
def partition(spark, sf):
    return W.core_partition(G.balls(spark, sf), BDIMS, 20)["labels"].select("x", "y", "z", "label")


@query("app_free_growth_check")
def growth(spark, sf):
    return W.free_growth_check(G.balls(spark, sf), _seeds(spark, sf), BDIMS)["valid"].select("x", "y", "z", "wave")


@query("app_straight_growth")
def straight(spark, sf):
    return W.straight_growth(G.balls(spark, sf), _seeds(spark, sf), BDIMS)["selected"].select("x", "y", "z", "peak")


@query("app_particle_growth")
def particles(spark, sf):
    return W.particle_growth(G.balls(spark, sf), BDIMS, 200)["labels"].select("x", "y", "z", "label")


@query("app_core_descent")
def descent(spark, sf):
    return W.core_descent(G.balls(spark, sf), BDIMS)["parts"].select("x", "y", "z", "part")


@query("app_make_graph_structure")
def structure(spark, sf):
    """Shortest paths over catchments between the ends of the first contact."""
    b = G.balls(spark, sf)
    part = P.cut(P.climb(W.depth_of(b, BDIMS), S.offsets(3), "d", BDIMS), "catchments")
    first = M.catchment_links(part, S.offsets(3, "face")).agg(F.min(F.struct("pa", "pb"))).first()[0]
    source, sink = (dict(zip("xyz", (i % 24, i // 24 % 24, i // 576))) for i in first)
    found = W.make_graph_structure(b, source, sink, BDIMS)
    return found["tree"].select("node", "dist").join(found["path"], "node", "left")


@query("app_surface_cutting")
def cutting(spark, sf):
    planes = [({"x": 12, "y": 11, "z": 10}, {"x": 1, "y": 2, "z": -1}), ({"x": 8}, {"x": -1})]
    return W.surface_cutting(G.balls(spark, sf), planes, BDIMS).select("x", "y", "z", "part_0", "part_1")


