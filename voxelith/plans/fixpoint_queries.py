"""Components, distances, waves, growth and descent on volumes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fixpoint as P
from ..operators import stencil as S
from ..operators.distance import distance
from ..sources import grids as G
from .grid_queries import DIMS, FACE, FG, FULL
from .registry import query

BDIMS = (G.SIDE, G.SIDE, G.SIDE, 1)
IDX = "x + 51 * (y + 11 * z)"
#: Recursive labels of the foreground by face neighbours.
CC = f"{FG}, {FACE}, nb AS (SELECT a.x + 51 * (a.y + 11 * a.z) AS a, b.x + 51 * (b.y + 11 * b.z) AS b FROM fg a CROSS JOIN face JOIN fg b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz), cc(node, root) USING KEY (node) AS (SELECT {IDX}, {IDX} FROM fg UNION SELECT e.b, min(c.root) FROM cc c JOIN nb e ON e.a = c.node JOIN recurring.cc r ON r.node = e.b WHERE c.root < r.root GROUP BY e.b), lab AS (SELECT fg.x, fg.y, fg.z, CAST(dense_rank() OVER (ORDER BY root) AS INT) AS label FROM cc JOIN fg ON node = {IDX})"


def _fg(spark, sf):
    return G.grid3(spark, sf).where("mask = 1").select(*S.KEY)


def _labels(spark, sf):
    return P.components(_fg(spark, sf), S.offsets(3, "face"), DIMS)


@query("fx05_components", f"WITH RECURSIVE {G.GRID3}, {CC} SELECT x, y, z, label FROM lab")
def fx05(spark, sf):
    return _labels(spark, sf).select("x", "y", "z", "label")


@query("fx06_component_sizes", f"WITH RECURSIVE {G.GRID3}, {CC} SELECT label, count(*) AS size FROM lab GROUP BY label")
def fx06(spark, sf):
    return _labels(spark, sf).groupBy("label").agg(F.count("*").alias("size"))


@query("fx07_size_limits", f"WITH RECURSIVE {G.GRID3}, {CC}, s AS (SELECT label, count(*) AS size FROM lab GROUP BY label HAVING count(*) BETWEEN 2 AND 500), n AS (SELECT label, size, CAST(row_number() OVER (ORDER BY label) AS INT) AS k FROM s) SELECT x, y, z, n.k AS label, size FROM lab JOIN n USING (label)")
def fx07(spark, sf):
    return P.keep_sizes(_labels(spark, sf), 2, 500).select("x", "y", "z", "label", "size")


@query("fx08_component_at", f"WITH RECURSIVE {G.GRID3}, {CC} SELECT x, y, z FROM lab WHERE label = (SELECT label FROM lab ORDER BY z, y, x LIMIT 1)")
def fx08(spark, sf):
    """The component of the first foreground voxel in raster order."""
    lab = _labels(spark, sf)
    first = lab.agg(F.min(F.struct("z", "y", "x", "label")).alias("f")).select(F.col("f.label").alias("label"))
    return lab.join(F.broadcast(first), "label", "left_semi").select("x", "y", "z")


@query("se05_hole_fill", f"WITH RECURSIVE {G.GRID3}, bg AS (SELECT x, y, z FROM grid3 WHERE mask = 0), f4(dx, dy) AS (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)), nb AS (SELECT a.x + 51 * (a.y + 11 * a.z) AS a, b.x + 51 * (b.y + 11 * b.z) AS b FROM bg a CROSS JOIN f4 JOIN bg b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z), cc(node, root) USING KEY (node) AS (SELECT {IDX}, {IDX} FROM bg UNION SELECT e.b, min(c.root) FROM cc c JOIN nb e ON e.a = c.node JOIN recurring.cc r ON r.node = e.b WHERE c.root < r.root GROUP BY e.b), h AS (SELECT root FROM cc GROUP BY root HAVING count(*) < 20 AND NOT bool_or(node % 51 IN (0, 50) OR node // 51 % 11 IN (0, 10))) SELECT x, y, z, CASE WHEN mask = 1 OR root IN (SELECT root FROM h) THEN 1 ELSE 0 END AS filled FROM grid3 LEFT JOIN cc ON node = {IDX}")
def se05(spark, sf):
    return P.fill_holes(G.grid3(spark, sf), 20, DIMS).select("x", "y", "z", "filled")


DIST = {"euclid": "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)", "city": "abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z)", "chess": "greatest(abs(a.x - b.x), abs(a.y - b.y), abs(a.z - b.z))"}


def _distance_query(name, metric):
    @query(name, f"WITH {G.GRID3}, seed AS (SELECT x, y, z FROM grid3 WHERE mask = 0) SELECT a.x, a.y, a.z, CAST(min({DIST[metric]}) AS DOUBLE) AS d FROM grid3 a, seed b GROUP BY 1, 2, 3")
    def run(spark, sf):
        return distance(G.grid3(spark, sf), "mask = 0", metric=metric, dims=DIMS).select("x", "y", "z", "d")

    return run


_distance_query("fx02_euclidean_distance", "euclid")
_distance_query("fx03_city_distance", "city")
_distance_query("fx03_chess_distance", "chess")


@query("fx02_spaced_distance", f"WITH {G.GRID3}, seed AS (SELECT x, y, z FROM grid3 WHERE mask = 0) SELECT a.x, a.y, a.z, round(CAST(min((a.x - b.x) * (a.x - b.x) * 0.25 + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) * 4.0) AS DOUBLE), 6) AS d FROM grid3 a, seed b GROUP BY 1, 2, 3")
def fx02s(spark, sf):
    return distance(G.grid3(spark, sf), "mask = 0", (0.5, 1.0, 2.0, 1.0), dims=DIMS).select("x", "y", "z", F.round("d", 6).alias("d"))


@query("fx02_distance_4d", f"WITH {G.GRID4}, seed AS (SELECT x, y, z, t FROM grid4 WHERE mask = 0), v AS (SELECT x, y, z, t FROM grid4) SELECT a.x, a.y, a.z, a.t, CAST(min({DIST['euclid']} + (a.t - b.t) * (a.t - b.t)) AS DOUBLE) AS d FROM v a JOIN seed b ON abs(a.x - b.x) <= 60 GROUP BY 1, 2, 3, 4")
def fx02d(spark, sf):
    return distance(G.grid4(spark, sf), "mask = 0", dims=(*DIMS[:3], 8)).select("x", "y", "z", "t", "d")


SEEDS = "seed AS (SELECT n_nationkey * 7 % 24 AS x, n_nationkey * 11 % 24 AS y, n_nationkey * 5 % 24 AS z FROM nation)"
BFG = "bfg AS (SELECT x, y, z FROM balls WHERE mask = 1)"


def _seeds(spark, sf, n=25):
    """A seed for each nation."""
    k = F.col("n_nationkey")
    return spark.read.parquet(f"{sf}/nation.parquet").where(k < n).select(F.lit(0).cast("long").alias("vol_id"), (k * 7 % 24).alias("x"), (k * 11 % 24).alias("y"), (k * 5 % 24).alias("z"), F.lit(0).alias("t"), (k + 1).cast("int").alias("label"))


def _balls(spark, sf):
    return G.balls(spark, sf).where("mask = 1").select(*S.KEY)


@query("fx11_generations", f"WITH RECURSIVE {G.BALLS}, {BFG}, {FACE}, s AS (SELECT a.x, a.y, a.z FROM bfg a CROSS JOIN face LEFT JOIN bfg b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY ALL HAVING count(b.x) < 6), w(x, y, z, wave) USING KEY (x, y, z) AS (SELECT x, y, z, 1 FROM s UNION SELECT DISTINCT b.x, b.y, b.z, w.wave + 1 FROM w CROSS JOIN face JOIN bfg b ON b.x = w.x + dx AND b.y = w.y + dy AND b.z = w.z + dz WHERE NOT EXISTS (SELECT 1 FROM recurring.w r WHERE r.x = b.x AND r.y = b.y AND r.z = b.z)) SELECT x, y, z, wave FROM w")
def fx11(spark, sf):
    """Depth from the surface, which is 1."""
    fg = _balls(spark, sf)
    return P.waves(fg, S.surface(fg, 3), S.offsets(3, "face"), first=1).select("x", "y", "z", "wave")


@query("fx10_grow", f"WITH RECURSIVE {G.BALLS}, {BFG}, {SEEDS}, {FULL}, w(x, y, z, wave) USING KEY (x, y, z) AS (SELECT DISTINCT bfg.x, bfg.y, bfg.z, 0 FROM bfg JOIN seed USING (x, y, z) UNION SELECT DISTINCT b.x, b.y, b.z, w.wave + 1 FROM w CROSS JOIN full26 JOIN bfg b ON b.x = w.x + dx AND b.y = w.y + dy AND b.z = w.z + dz WHERE w.wave < 3 AND NOT EXISTS (SELECT 1 FROM recurring.w r WHERE r.x = b.x AND r.y = b.y AND r.z = b.z)) SELECT x, y, z, wave FROM w")
def fx10(spark, sf):
    return P.waves(_balls(spark, sf), _seeds(spark, sf), S.offsets(3), most=3).select("x", "y", "z", "wave")


BD = "dist AS (SELECT a.x, a.y, a.z, CAST(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS DOUBLE) AS d FROM bfg a JOIN (SELECT x, y, z FROM balls WHERE mask = 0) b ON abs(a.x - b.x) <= 6 AND abs(a.y - b.y) <= 6 AND abs(a.z - b.z) <= 6 GROUP BY 1, 2, 3)"


def _deep(spark, sf):
    b = G.balls(spark, sf)
    return b.where("mask = 1").join(distance(b, "mask = 0"), S.KEY).select(*S.KEY, "d")


@query("fx16_strict_growth", f"WITH RECURSIVE {G.BALLS}, {BFG}, {SEEDS}, {FULL}, {BD}, w(x, y, z, d, wave) USING KEY (x, y, z) AS (SELECT DISTINCT dist.x, dist.y, dist.z, d, 1 FROM dist JOIN seed USING (x, y, z) UNION SELECT DISTINCT b.x, b.y, b.z, b.d, w.wave + 1 FROM w CROSS JOIN full26 JOIN dist b ON b.x = w.x + dx AND b.y = w.y + dy AND b.z = w.z + dz WHERE b.d < w.d AND NOT EXISTS (SELECT 1 FROM recurring.w r WHERE r.x = b.x AND r.y = b.y AND r.z = b.z)) SELECT x, y, z, wave FROM w")
def fx16(spark, sf):
    """Waves of a flood from the seeds that only steps to smaller distances."""
    return P.waves(_deep(spark, sf), _seeds(spark, sf), S.offsets(3), lambda a, b: b < a, "d", first=1).select("x", "y", "z", "wave")


@query("fx25_competition", f"WITH RECURSIVE {G.BALLS}, {BFG}, {FACE}, seed AS (SELECT n_nationkey * 7 % 24 AS x, n_nationkey * 11 % 24 AS y, n_nationkey * 5 % 24 AS z, CAST(n_nationkey + 1 AS INT) AS label FROM nation), w(x, y, z, label, wave) USING KEY (x, y, z) AS (SELECT x, y, z, CASE WHEN min(label) = max(label) THEN min(label) ELSE -1 END, 0 FROM bfg JOIN seed USING (x, y, z) GROUP BY x, y, z UNION SELECT b.x, b.y, b.z, CASE WHEN min(w.label) = max(w.label) THEN min(w.label) ELSE -1 END, max(w.wave) + 1 FROM w CROSS JOIN face JOIN bfg b ON b.x = w.x + dx AND b.y = w.y + dy AND b.z = w.z + dz WHERE w.label <> -1 AND NOT EXISTS (SELECT 1 FROM recurring.w r WHERE r.x = b.x AND r.y = b.y AND r.z = b.z) GROUP BY b.x, b.y, b.z) SELECT x, y, z, label, wave FROM w")
def fx25(spark, sf):
    return P.compete(_balls(spark, sf), _seeds(spark, sf), S.offsets(3, "face")).select("x", "y", "z", "label", "wave")


@query("fx09_geodesic", f"WITH RECURSIVE {G.BALLS}, {BFG}, {SEEDS}, {FULL}, w(x, y, z, dist) USING KEY (x, y, z) AS (SELECT DISTINCT bfg.x, bfg.y, bfg.z, CAST(0 AS DOUBLE) FROM bfg JOIN seed USING (x, y, z) UNION SELECT b.x, b.y, b.z, min(w.dist + sqrt(CAST(dx * dx + dy * dy + dz * dz AS DOUBLE))) AS nd FROM w CROSS JOIN full26 JOIN bfg b ON b.x = w.x + dx AND b.y = w.y + dy AND b.z = w.z + dz LEFT JOIN recurring.w r ON r.x = b.x AND r.y = b.y AND r.z = b.z WHERE w.dist + sqrt(CAST(dx * dx + dy * dy + dz * dz AS DOUBLE)) <= 6.0 AND (r.dist IS NULL OR w.dist + sqrt(CAST(dx * dx + dy * dy + dz * dz AS DOUBLE)) < r.dist - 1e-9) GROUP BY b.x, b.y, b.z) SELECT x, y, z, round(dist, 6) AS dist FROM w")
def fx09(spark, sf):
    return P.geodesic(_balls(spark, sf), _seeds(spark, sf), S.offsets(3), 6.0).select("x", "y", "z", F.round("dist", 6).alias("dist"))


UP = f"best AS (SELECT a.x, a.y, a.z, arg_min(b.x + 24 * (b.y + 24 * b.z), (-b.d, dx * dx + dy * dy + dz * dz, b.x + 24 * (b.y + 24 * b.z))) AS i, max(b.d) AS nd, any_value(a.d) AS d FROM dist a CROSS JOIN full26 JOIN dist b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY 1, 2, 3), up AS (SELECT a.x + 24 * (a.y + 24 * a.z) AS i, CASE WHEN nd > a.d THEN best.i ELSE a.x + 24 * (a.y + 24 * a.z) END AS p FROM dist a LEFT JOIN best USING (x, y, z))"


@query("fx21_steepest_ascent", f"WITH RECURSIVE {G.BALLS}, {BFG}, {FULL}, {BD}, {UP}, walk(i, p, k) AS (SELECT i, p, 0 FROM up UNION ALL SELECT walk.i, up.p, k + 1 FROM walk JOIN up ON up.i = walk.p WHERE up.p <> walk.p), ends AS (SELECT i, arg_max(p, k) AS peak FROM walk GROUP BY i) SELECT CAST(i % 24 AS INT) AS x, CAST(i // 24 % 24 AS INT) AS y, CAST(i // 576 AS INT) AS z, CAST(peak AS BIGINT) AS peak FROM ends")
def fx21(spark, sf):
    """Where the steepest ascent of the distance ends."""
    return P.climb(_deep(spark, sf), S.offsets(3), "d", BDIMS).select("x", "y", "z", "peak")


@query("s06_local_maxima", f"WITH {G.BALLS}, {BFG}, {FULL}, {BD}, m AS (SELECT a.x, a.y, a.z, any_value(a.d) AS d, max(b.d) AS nd FROM dist a CROSS JOIN full26 LEFT JOIN dist b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY 1, 2, 3) SELECT x, y, z, coalesce(d > nd, true) AS strict, coalesce(d >= nd, true) AS weak FROM m WHERE coalesce(d >= nd, true)")
def s06(spark, sf):
    m = S.gather(_deep(spark, sf), S.offsets(3), {"nd": F.max(S.near(F.col("d")))}, ["d"])
    return m.select("x", "y", "z", F.coalesce(F.col("d") > F.col("nd"), F.lit(True)).alias("strict"), F.coalesce(F.col("d") >= F.col("nd"), F.lit(True)).alias("weak")).where("weak")


@query("fx26_peak_shares", f"WITH RECURSIVE {G.BALLS}, {BFG}, {FULL}, {FACE}, {BD}, {UP}, walk(i, p, k) AS (SELECT i, p, 0 FROM up UNION ALL SELECT walk.i, up.p, k + 1 FROM walk JOIN up ON up.i = walk.p WHERE up.p <> walk.p), ends AS (SELECT i, arg_max(p, k) AS peak FROM walk GROUP BY i) SELECT CAST(peak AS BIGINT) AS peak, count(*) AS n FROM ends GROUP BY 1")
def fx26(spark, sf):
    """Voxels by the peak that they climb to."""
    return P.climb(_deep(spark, sf), S.offsets(3), "d", BDIMS).groupBy("peak").agg(F.count("*").alias("n"))
