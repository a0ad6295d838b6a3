"""Convolution, differences, interpolation and series comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stencil as S
from ..operators.series import dtw
from ..sources import grids as G
from .registry import query

TAPS = (0.25, 0.5, 0.25)
NEXT = "n1 AS (SELECT a.*, e.val AS xe, w.val AS xw, f.val AS ye, v.val AS yw, u.val AS ze, d.val AS zw FROM grid3 a LEFT JOIN grid3 e ON e.x = a.x + 1 AND e.y = a.y AND e.z = a.z LEFT JOIN grid3 w ON w.x = a.x - 1 AND w.y = a.y AND w.z = a.z LEFT JOIN grid3 f ON f.x = a.x AND f.y = a.y + 1 AND f.z = a.z LEFT JOIN grid3 v ON v.x = a.x AND v.y = a.y - 1 AND v.z = a.z LEFT JOIN grid3 u ON u.x = a.x AND u.y = a.y AND u.z = a.z + 1 LEFT JOIN grid3 d ON d.x = a.x AND d.y = a.y AND d.z = a.z - 1)"


@query("w01_convolution", f"WITH {G.GRID3}, {NEXT} SELECT x, y, z, round(0.25 * coalesce(xw, 0) + 0.5 * val + 0.25 * coalesce(xe, 0), 6) AS conv FROM n1")
def w01(spark, sf):
    return S.convolve(G.grid3(spark, sf), TAPS, "x").select("x", "y", "z", F.round("conv", 6).alias("conv"))


def _sep(src: str, dst: str, axis: str) -> str:
    on = lambda k: " AND ".join(f"{{0}}.{a} = a.{a}" + (f" {k} 1" if a == axis else "") for a in "xyz")
    return f"{dst} AS (SELECT a.x, a.y, a.z, 0.25 * coalesce(p.v, 0) + 0.5 * a.v + 0.25 * coalesce(q.v, 0) AS v FROM {src} a LEFT JOIN {src} p ON {on('-').format('p')} LEFT JOIN {src} q ON {on('+').format('q')})"


@query("w02_separable", f"WITH {G.GRID3}, c0 AS (SELECT x, y, z, val AS v FROM grid3), {_sep('c0', 'c1', 'x')}, {_sep('c1', 'c2', 'y')}, {_sep('c2', 'c3', 'z')} SELECT x, y, z, round(v, 5) AS v FROM c3")
def w02(spark, sf):
    """The same taps along each axis in turn."""
    g = G.grid3(spark, sf).withColumn("v", F.col("val"))
    for a in "xyz":
        g = S.convolve(g, TAPS, a, "v", "v")
    return g.select("x", "y", "z", F.round("v", 5).alias("v"))


@query("w03_gaussian_taps", "WITH i AS (SELECT CAST(range AS INT) AS i FROM range(7)), w AS (SELECT i, exp(-((i - 3) * (i - 3)) / (2 * 1.5 * 1.5)) AS w FROM i) SELECT i, round(w / sum(w) OVER (), 6) AS tap FROM w")
def w03(spark, sf):
    return spark.createDataFrame([(i, t) for i, t in enumerate(S.gaussian_taps(1.5, 7))], "i int, tap double").select("i", F.round("tap", 6).alias("tap"))


@query("w04_gradient", f"WITH {G.GRID3}, {NEXT} SELECT x, y, z, round(coalesce(xe, val) - coalesce(xw, val), 6) AS g_x, round(coalesce(ye, val) - coalesce(yw, val), 6) AS g_y, round(coalesce(ze, val) - coalesce(zw, val), 6) AS g_z FROM n1")
def w04(spark, sf):
    return S.gradient(G.grid3(spark, sf)).select("x", "y", "z", *(F.round(f"g_{a}", 6).alias(f"g_{a}") for a in "xyz"))


@query("w05_laplacian", f"WITH {G.GRID3}, {NEXT} SELECT x, y, z, round(val - (coalesce(xe, val) + coalesce(xw, val) + coalesce(ye, val) + coalesce(yw, val) + coalesce(ze, val) + coalesce(zw, val)) / 6, 6) AS lap FROM n1")
def w05(spark, sf):
    """The centre less the mean of its six neighbours; absent ones count as the centre."""
    near = S.gather(G.grid3(spark, sf), S.offsets(3, "face"), {"s": F.coalesce(F.sum(S.near(F.col("val"))), F.lit(0.0))}, ["val"])
    lap = F.col("val") - (F.col("s") + (6 - F.col("n_near")) * F.col("val")) / 6
    return near.select("x", "y", "z", F.round(lap, 6).alias("lap"))


@query("w05_divergence", f"WITH {G.GRID3}, r3 AS (SELECT CAST(range AS INT) - 1 AS i FROM range(3)), o AS (SELECT a.i AS dx, b.i AS dy, c.i AS dz FROM r3 a, r3 b, r3 c WHERE a.i <> 0 OR b.i <> 0 OR c.i <> 0) SELECT a.x, a.y, a.z, CAST(sum(a.n - b.n) AS BIGINT) AS div FROM grid3 a CROSS JOIN o JOIN grid3 b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY 1, 2, 3")
def w05d(spark, sf):
    near = S.gather(G.grid3(spark, sf), S.offsets(3), {"s": F.sum(S.near(F.col("n")))}, ["n"])
    return near.where("n_near > 0").select("x", "y", "z", (F.col("n") * F.col("n_near") - F.col("s")).alias("div"))


@query("w06_gradient_angle", f"WITH {G.GRID3}, {NEXT}, g AS (SELECT x, y, z, coalesce(xe, val) - coalesce(xw, val) AS a, coalesce(ye, val) - coalesce(yw, val) AS b, coalesce(ze, val) - coalesce(zw, val) AS c FROM n1) SELECT x, y, z, round(CASE WHEN (a * a + b * b + c * c) * ((x - 25) * (x - 25) + (y - 5) * (y - 5) + (z - 4) * (z - 4)) > 0 THEN (a * (x - 25) + b * (y - 5) + c * (z - 4)) / (sqrt(a * a + b * b + c * c) * sqrt(CAST((x - 25) * (x - 25) + (y - 5) * (y - 5) + (z - 4) * (z - 4) AS DOUBLE))) ELSE 0 END, 6) AS angle FROM g")
def w06(spark, sf):
    from ..functions.scalars import cosine

    g = S.gradient(G.grid3(spark, sf))
    c = cosine([F.col("g_x"), F.col("g_y"), F.col("g_z")], [(F.col("x") - 25).cast("double"), (F.col("y") - 5).cast("double"), (F.col("z") - 4).cast("double")])
    return g.select("x", "y", "z", F.round(F.coalesce(c, F.lit(0.0)), 6).alias("angle"))


@query("w07_trilinear", f"WITH {G.GRID3}, p AS (SELECT s_suppkey AS id, 1 + s_suppkey * 7 % 470 / 10.0 AS px, s_suppkey * 3 % 95 / 10.0 AS py, s_suppkey * 11 % 75 / 10.0 AS pz FROM supplier), b AS (SELECT CAST(range AS INT) AS i FROM range(2)), c AS (SELECT p.*, CAST(floor(px) AS INT) + b1.i AS x, CAST(floor(py) AS INT) + b2.i AS y, CAST(floor(pz) AS INT) + b3.i AS z FROM p, b b1, b b2, b b3) SELECT id, round(sum((1 - abs(px - c.x)) * (1 - abs(py - c.y)) * (1 - abs(pz - c.z)) * coalesce(n, 0)), 6) AS v FROM c LEFT JOIN grid3 g ON g.x = c.x AND g.y = c.y AND g.z = c.z GROUP BY id")
def w07(spark, sf):
    """Trilinear interpolation of the counts at a point for each supplier; 0 outside."""
    k = F.col("s_suppkey")
    p = spark.read.parquet(f"{sf}/supplier.parquet").select(k.alias("id"), (1 + k * 7 % 470 / 10.0).alias("px"), (k * 3 % 95 / 10.0).alias("py"), (k * 11 % 75 / 10.0).alias("pz"))
    w = F.lit(1.0)
    for a in "xyz":
        p = p.withColumn(a, F.explode(F.array(*(F.floor(f"p{a}").cast("int") + i for i in (0, 1)))))
        w = w * (1 - F.abs(F.col(f"p{a}") - F.col(a)))
    v = G.grid3(spark, sf).select("x", "y", "z", "n")
    return p.join(v, ["x", "y", "z"], "left").groupBy("id").agg(F.round(F.sum(w * F.coalesce("n", F.lit(0))), 6).alias("v"))


@query("w08_resample", f"WITH {G.GRID3}, o AS (SELECT CAST(range AS INT) AS i FROM range(26)), t AS (SELECT CAST(range AS INT) AS j FROM range(11)) SELECT o.i AS x, t.j AS y, coalesce(CAST(sum(n) AS BIGINT), 0) AS n FROM o CROSS JOIN t LEFT JOIN grid3 g ON g.x = 2 * o.i AND g.y = t.j GROUP BY 1, 2")
def w08(spark, sf):
    """Every second column of x; slices added up; cells without a voxel are 0."""
    grid = spark.range(26 * 11).select((F.col("id") % 26).cast("int").alias("x"), F.floor(F.col("id") / 26).cast("int").alias("y"))
    taken = G.grid3(spark, sf).where(F.col("x") % 2 == 0).groupBy((F.col("x") / 2).cast("int").alias("x"), "y").agg(F.sum("n").alias("n"))
    return grid.join(taken, ["x", "y"], "left").select("x", "y", F.coalesce("n", F.lit(0)).alias("n"))


@query("w09_dtw", f"WITH RECURSIVE {G.SERIES}, ref AS (SELECT list(m ORDER BY h) AS w FROM (SELECT h, round(avg(v), 2) AS m FROM dense GROUP BY h)), d(key, i, col) AS (SELECT key, 0, list_prepend(0.0, list_transform(range(24), lambda k: CAST('inf' AS DOUBLE))) FROM series UNION ALL SELECT d.key, i + 1, list_reduce(list_transform(range(1, 25), lambda j: [abs(s.v[i + 1] - r.w[j]) + least(d.col[j], d.col[j + 1]), abs(s.v[i + 1] - r.w[j])]), lambda acc, e: list_append(acc, least(e[1], e[2] + acc[len(acc)])), [CAST('inf' AS DOUBLE)]) FROM d JOIN series s ON s.key = d.key CROSS JOIN ref r WHERE i < 24) SELECT key, round(col[25], 4) AS cost FROM d WHERE i = 24")
def w09(spark, sf):
    """Warping cost of each user's hours against the mean of all users by hour."""
    s = G.series(spark, sf)
    mean = s.select(F.posexplode("v").alias("h", "m")).groupBy("h").agg(F.round(F.avg("m"), 2).alias("m"))
    ref = mean.agg(F.sort_array(F.collect_list(F.struct("h", "m"))).alias("r")).select(F.col("r.m").alias("w"))
    return s.crossJoin(F.broadcast(ref)).select("key", F.round(dtw("v", "w"), 4).alias("cost"))  # ref is one row of 24 values


@query("w11_wedges", f"WITH {G.GRID3} SELECT x, y, z, CAST(trunc((atan2(CAST(y - 5 AS DOUBLE), CAST(x - 25 AS DOUBLE)) + 3.141592653589793) / 8 + 0.5) AS INT) AS wedge, CAST(trunc((atan2(CAST(z - 4 AS DOUBLE), sqrt(CAST((x - 25) * (x - 25) + (y - 5) * (y - 5) AS DOUBLE))) + 3.141592653589793) / 8 + 0.5) AS INT) AS tilt FROM grid3")
def w11(spark, sf):
    """Wedge numbers; angles are divided by the count of wedges."""
    from ..functions.scalars import round_half

    dx, dy, dz = ((F.col(a) - c).cast("double") for a, c in (("x", 25), ("y", 5), ("z", 4)))
    pi = 3.141592653589793
    return G.grid3(spark, sf).select("x", "y", "z", round_half((F.atan2(dy, dx) + pi) / 8).alias("wedge"), round_half((F.atan2(dz, F.sqrt(dx * dx + dy * dy)) + pi) / 8).alias("tilt"))
