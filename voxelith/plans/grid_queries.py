"""Addressing, predicates and neighbourhood joins on volumes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stencil as S
from ..operators.proximity import bonding, epsilon_pairs, in_balls, label_contacts, nearest, relative_pairs
from ..sources import grids as G
from .registry import query

DIMS = (51, 11, 9, 1)
FG = "fg AS (SELECT vol_id, x, y, z, t FROM grid3 WHERE mask = 1)"
FACE = "face(dx, dy, dz) AS (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))"
FULL = "r3 AS (SELECT CAST(range AS INT) - 1 AS i FROM range(3)), full26 AS (SELECT a.i AS dx, b.i AS dy, c.i AS dz FROM r3 a, r3 b, r3 c WHERE a.i <> 0 OR b.i <> 0 OR c.i <> 0)"


def _fg(spark, sf):
    return G.grid3(spark, sf).where("mask = 1").select(*S.KEY)


@query("g01_linear_index", f"WITH {G.GRID3}, i AS (SELECT x, y, z, CAST(x AS BIGINT) + 51 * (y + 11 * (z + 9 * CAST(t AS BIGINT))) AS idx FROM grid3) SELECT x, y, z, idx, CAST(idx % 51 AS INT) AS bx, CAST(idx // 51 % 11 AS INT) AS by_, CAST(idx // 561 % 9 AS INT) AS bz FROM i")
def g01(spark, sf):
    idx = G.grid3(spark, sf).select("x", "y", "z", S.linear_index(DIMS).alias("idx"))
    bx, by, bz, _ = S.subscripts(F.col("idx"), DIMS)
    return idx.select("x", "y", "z", "idx", bx.alias("bx"), by.alias("by_"), bz.alias("bz"))


@query("g02_centred_offset", f"WITH {G.GRID3} SELECT x, y, z, x - 25 AS ox, y - 5 AS oy, z - 4 AS oz, CAST((x - 25 + 25) + 51 * ((y - 5 + 5) + 11 * (z - 4 + 4)) AS BIGINT) AS idx FROM grid3")
def g02(spark, sf):
    cx, cy, cz, _ = (n // 2 for n in DIMS)
    off = G.grid3(spark, sf).select("x", "y", "z", (F.col("x") - cx).alias("ox"), (F.col("y") - cy).alias("oy"), (F.col("z") - cz).alias("oz"))
    return off.withColumn("idx", (F.col("ox") + cx + DIMS[0] * (F.col("oy") + cy + DIMS[1] * (F.col("oz") + cz))).cast("long"))


@query("g03_neighbour_read", f"WITH {G.GRID3} SELECT a.x, a.y, a.z, coalesce(b.n, 0) AS zero_border, coalesce(b.n, a.n) AS centre_border FROM grid3 a LEFT JOIN grid3 b ON b.x = a.x + 1 AND b.y = a.y AND b.z = a.z")
def g03(spark, sf):
    nxt = S.step("n", "x", 1)
    return G.grid3(spark, sf).select("x", "y", "z", F.coalesce(nxt, F.lit(0)).alias("zero_border"), F.coalesce(nxt, F.col("n")).alias("centre_border"))


@query("g04_bounded_write", f"WITH {G.GRID3}, w AS (SELECT x + 1 AS x, y, z, n FROM grid3 WHERE x + 1 BETWEEN 0 AND 50) SELECT g.x, g.y, g.z, coalesce(w.n, g.n) AS n FROM grid3 g LEFT JOIN w USING (x, y, z)")
def g04(spark, sf):
    """Each voxel writes its count to the next cell; writes out of range are ignored."""
    g = G.grid3(spark, sf)
    w = g.select((F.col("x") + 1).alias("x"), "y", "z", F.col("n").alias("w")).where(F.col("x").between(0, DIMS[0] - 1))
    return g.join(w, ["x", "y", "z"], "left").select("x", "y", "z", F.coalesce("w", "n").alias("n"))


@query("g06_threshold", f"WITH {G.GRID3} SELECT x, y, z, CASE WHEN val > 50000 THEN 255 ELSE 0 END AS above, CASE WHEN val BETWEEN 30000 AND 60000 THEN 1 ELSE 0 END AS inside FROM grid3")
def g06(spark, sf):
    v = F.col("val")
    return G.grid3(spark, sf).select("x", "y", "z", F.when(v > 50000, 255).otherwise(0).alias("above"), F.when(v.between(30000, 60000), 1).otherwise(0).alias("inside"))


@query("g07_inversion", f"WITH {G.GRID3} SELECT x, y, z, 1 - mask AS inverted FROM grid3")
def g07(spark, sf):
    return G.grid3(spark, sf).select("x", "y", "z", (1 - F.col("mask")).alias("inverted"))


@query("g08_inside_count", f"WITH {G.GRID3}, {FULL} SELECT x, y, z, CAST(sum(CASE WHEN x + dx BETWEEN 0 AND 50 AND y + dy BETWEEN 0 AND 10 AND z + dz BETWEEN 0 AND 8 THEN 1 ELSE 0 END) AS INT) AS n_inside FROM grid3, full26 GROUP BY x, y, z")
def g08(spark, sf):
    span = [F.when(F.col(a).between(1, n - 2), 3).when(F.col(a).between(0, n - 1), 2).otherwise(1) for a, n in zip("xyz", DIMS)]
    return G.grid3(spark, sf).select("x", "y", "z", (span[0] * span[1] * span[2] - 1).alias("n_inside"))


@query("g09_surface", f"WITH {G.GRID3}, {FG}, {FACE}, c AS (SELECT a.x, a.y, a.z, count(b.x) AS k FROM fg a CROSS JOIN face LEFT JOIN fg b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY ALL) SELECT z, count(*) AS n_surface FROM c WHERE k < 6 GROUP BY z")
def g09(spark, sf):
    return S.surface(_fg(spark, sf), 3).groupBy("z").agg(F.count("*").alias("n_surface"))


@query("g10_surface_full", f"WITH {G.GRID3}, {FG}, {FULL}, c AS (SELECT a.x, a.y, a.z, sum(CASE WHEN a.x + dx BETWEEN 0 AND 50 AND a.y + dy BETWEEN 0 AND 10 AND a.z + dz BETWEEN 0 AND 8 AND b.x IS NULL THEN 1 ELSE 0 END) AS zeros FROM fg a CROSS JOIN full26 LEFT JOIN fg b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY ALL) SELECT x, y, z FROM c WHERE zeros > 0")
def g10(spark, sf):
    return S.surface(_fg(spark, sf), 3, "full", border=1, dims=DIMS).select("x", "y", "z")


@query("g11_background_boundary", f"WITH {G.GRID3}, {FG}, {FACE} SELECT DISTINCT g.x, g.y, g.z FROM grid3 g CROSS JOIN face JOIN fg b ON b.x = g.x + dx AND b.y = g.y + dy AND b.z = g.z + dz WHERE g.mask = 0")
def g11(spark, sf):
    near = S.gather(G.grid3(spark, sf), S.offsets(3, "face"), {"most": F.max(S.near(F.col("mask")))}, ["mask"])
    return near.where("mask = 0 AND most = 1").select("x", "y", "z")


@query("g12_degrees", f"WITH {G.GRID3}, {FG}, {FACE}, c AS (SELECT a.x, a.y, a.z, CAST(count(b.x) AS BIGINT) AS degree FROM fg a CROSS JOIN face LEFT JOIN fg b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY ALL) SELECT x, y, z, degree, degree < 6 AS is_surface, degree >= 4 AS is_medial FROM c")
def g12(spark, sf):
    d = S.gather(_fg(spark, sf), S.offsets(3, "face"), {}, [])
    return d.select("x", "y", "z", F.col("n_near").alias("degree"), (F.col("n_near") < 6).alias("is_surface"), (F.col("n_near") >= 4).alias("is_medial"))


@query("g13_solitary", f"WITH {G.GRID3}, {FG}, s AS (SELECT count(*) AS size, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM fg) SELECT size, CAST((x1 - x0 + 1) * (y1 - y0 + 1) * (z1 - z0 + 1) AS BIGINT) AS box, size <= 5000 AND x0 > 0 AND x1 < 50 AND y0 > 0 AND y1 < 10 AND z0 > 0 AND z1 < 8 AND 4 * size >= (x1 - x0 + 1) * (y1 - y0 + 1) * (z1 - z0 + 1) AS solitary, size IN (0, 5049) AS degenerate FROM s")
def g13(spark, sf):
    ends = [f(a).alias(f"{a}{k}") for a in "xyz" for f, k in ((F.min, 0), (F.max, 1))]
    s = _fg(spark, sf).agg(F.count("*").alias("size"), *ends)
    box = (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1) * (F.col("z1") - F.col("z0") + 1)
    clear = F.lit(True)
    for a, n in zip("xyz", DIMS):
        clear = clear & (F.col(f"{a}0") > 0) & (F.col(f"{a}1") < n - 1)
    cells = DIMS[0] * DIMS[1] * DIMS[2]
    return s.select("size", box.cast("long").alias("box"), ((F.col("size") <= 5000) & clear & (4 * F.col("size") >= box)).alias("solitary"), F.col("size").isin(0, cells).alias("degenerate"))


@query("g14_downhill", f"WITH {G.GRID3} SELECT a.x, a.y, a.z, a.val > b.val AS strictly_down, a.val >= b.val AS down FROM grid3 a JOIN grid3 b ON b.x = a.x + 1 AND b.y = a.y AND b.z = a.z")
def g14(spark, sf):
    g = G.grid3(spark, sf).withColumn("nxt", S.step("val", "x", 1)).where("nxt IS NOT NULL")
    return g.select("x", "y", "z", (F.col("val") > F.col("nxt")).alias("strictly_down"), (F.col("val") >= F.col("nxt")).alias("down"))


@query("g15_half_space", f"WITH {G.GRID3} SELECT (x - 25) * 2 + (y - 5) * -3 + (z - 4) * 1 > 0 AS outer_side, count(*) AS n FROM grid3 GROUP BY 1")
def g15(spark, sf):
    side = (F.col("x") - 25) * 2 + (F.col("y") - 5) * -3 + (F.col("z") - 4) > 0
    return G.grid3(spark, sf).groupBy(side.alias("outer_side")).agg(F.count("*").alias("n"))


@query("g16_adjacent", f"WITH {G.GRID3}, {FG}, {FULL} SELECT CAST(abs(dx) + abs(dy) + abs(dz) AS BIGINT) AS l1, count(*) AS n FROM fg a CROSS JOIN full26 JOIN fg b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY 1")
def g16(spark, sf):
    """Ordered pairs of foreground voxels at Chebyshev distance 1, by city-block distance."""
    l1 = sum(F.abs(F.col(f"o.d{a}")) for a in "xyz").cast("long")
    rows = S.gather(_fg(spark, sf), S.offsets(3), {f"l{k}": F.sum(S.near((l1 == k).cast("long"))) for k in (1, 2, 3)}, [])
    sums = rows.agg(*(F.sum(f"l{k}").alias(f"l{k}") for k in (1, 2, 3)))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("l1"), F.col(f"l{k}").alias("n")) for k in (1, 2, 3)))).alias("r")).select("r.l1", "r.n")


@query("j01_offsets", f"WITH {FULL} SELECT dx, dy, dz, dx * dx + dy * dy + dz * dz AS len2 FROM full26")
def j01(spark, sf):
    rows = [(d[0], d[1], d[2], sum(c * c for c in d)) for d in S.offsets(3)]
    return spark.createDataFrame(rows, "dx int, dy int, dz int, len2 int")


@query("j02_causal", f"WITH {FULL} SELECT dx, dy, dz, dz < 0 OR (dz = 0 AND (dy < 0 OR (dy = 0 AND dx < 0))) AS before FROM full26")
def j02(spark, sf):
    offs = S.offsets(3)
    rows = [(*d[:3], True) for d in S.causal(offs)] + [(*d[:3], False) for d in S.causal(offs, forward=True)]
    return spark.createDataFrame(rows, "dx int, dy int, dz int, before boolean")


@query("j03_neighbour_pairs", f"WITH {G.GRID3}, {FG}, {FULL} SELECT a.x, a.y, a.z, CAST(count(b.x) AS BIGINT) AS n26, CAST(coalesce(sum(CASE WHEN abs(dx) + abs(dy) + abs(dz) = 1 AND b.x IS NOT NULL THEN 1 ELSE 0 END), 0) AS BIGINT) AS n6 FROM fg a CROSS JOIN full26 LEFT JOIN fg b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY a.x, a.y, a.z")
def j03(spark, sf):
    n6 = F.coalesce(F.sum(S.near((F.col("o.len2") == 1).cast("long"))), F.lit(0))
    return S.gather(_fg(spark, sf), S.offsets(3), {"n6": n6}, []).select("x", "y", "z", F.col("n_near").alias("n26"), "n6")


POINTS = "pts AS (SELECT s_suppkey AS id, CAST(s_suppkey * 7919 % 1000 AS DOUBLE) / 10 AS px, CAST(s_suppkey * 104729 % 1000 AS DOUBLE) / 10 AS py, 0.0 AS pz, CAST(1 + s_suppkey % 7 AS DOUBLE) AS d FROM supplier), cores AS (SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_nationkey * 37 % 100 AS DOUBLE) AS px, CAST(n_nationkey * 53 % 100 AS DOUBLE) AS py, 0.0 AS pz FROM nation)"
D2 = "(a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py)"


def points(spark, sf):
    s, k = spark.read.parquet(f"{sf}/supplier.parquet"), F.col("s_suppkey")
    return s.select(k.alias("id"), ((k * 7919 % 1000).cast("double") / 10).alias("px"), ((k * 104729 % 1000).cast("double") / 10).alias("py"), F.lit(0.0).alias("pz"), (1 + k % 7).cast("double").alias("d"))


def cores(spark, sf):
    n, k = spark.read.parquet(f"{sf}/nation.parquet"), F.col("n_nationkey")
    return n.select(k.cast("long").alias("id"), (k * 37 % 100).cast("double").alias("px"), (k * 53 % 100).cast("double").alias("py"), F.lit(0.0).alias("pz"))


@query("j05_epsilon_join", f"WITH {POINTS} SELECT a.id AS a, b.id AS b, round(sqrt({D2}), 6) AS dist FROM pts a JOIN pts b ON a.id < b.id AND {D2} < 25")
def j05(spark, sf):
    return epsilon_pairs(points(spark, sf), 5.0).select("a", "b", F.round("dist", 6).alias("dist"))


@query("j06_relative_join", f"WITH {POINTS} SELECT a.id AS a, b.id AS b, round(sqrt({D2}), 6) AS dist FROM pts a JOIN pts b ON a.id < b.id AND sqrt({D2}) < 0.8 * sqrt(a.d * b.d)")
def j06(spark, sf):
    return relative_pairs(points(spark, sf), 0.8).select("a", "b", F.round("dist", 6).alias("dist"))


LABELS = "lab AS (SELECT *, CAST(floor(x / 10) AS INT) AS label FROM grid3 WHERE mask = 1)"


def _labelled(spark, sf):
    return G.grid3(spark, sf).where("mask = 1").withColumn("label", F.floor(F.col("x") / 10).cast("int"))


@query("j08_label_adjacency", f"WITH {G.GRID3}, {LABELS}, {FACE} SELECT a.label AS la, b.label AS lb, count(*) AS contacts, round(min(abs(a.val - b.val)), 6) AS w FROM lab a CROSS JOIN face JOIN lab b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz WHERE a.label < b.label GROUP BY 1, 2")
def j08(spark, sf):
    return label_contacts(_labelled(spark, sf), S.offsets(3, "face")).select("la", "lb", "contacts", F.round("w", 6).alias("w"))


@query("j09_nearest_core", f"WITH {POINTS}, r AS (SELECT a.id, b.id AS core, {D2} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {D2}, b.id) AS k FROM pts a, cores b) SELECT id, core, round(sqrt(d2), 6) AS dist FROM r WHERE k = 1")
def j09(spark, sf):
    return nearest(points(spark, sf), cores(spark, sf)).select("id", "core", F.round("dist", 6).alias("dist"))


@query("j10_ball_inclusion", f"WITH {G.BALLS} SELECT s.id AS seed, count(*) AS n FROM (SELECT n_nationkey AS id, n_nationkey * 7 % 24 AS cx, n_nationkey * 11 % 24 AS cy, n_nationkey * 5 % 24 AS cz, 3 AS r FROM nation) s JOIN balls v ON mask = 1 AND (x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz) < r * r GROUP BY 1")
def j10(spark, sf):
    k = F.col("n_nationkey")
    seeds = spark.read.parquet(f"{sf}/nation.parquet").select(F.lit(0).cast("long").alias("vol_id"), k.alias("seed"), (k * 7 % 24).alias("x"), (k * 11 % 24).alias("y"), (k * 5 % 24).alias("z"), F.lit(0).alias("t"), F.lit(3).alias("r"))
    return in_balls(G.balls(spark, sf).where("mask = 1"), seeds).groupBy("seed").agg(F.count("*").alias("n"))


@query("j12_bonding", f"WITH {G.GRID3}, {LABELS}, {FACE}, c AS (SELECT DISTINCT a.label AS la, b.label AS lb, a.x, a.y, a.z FROM lab a CROSS JOIN face JOIN lab b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz WHERE a.label <> b.label), s AS (SELECT label, count(*) AS size FROM lab GROUP BY 1) SELECT la, lb, round(count(*) / max(size), 6) AS strength FROM c JOIN s ON s.label = la GROUP BY 1, 2")
def j12(spark, sf):
    return bonding(_labelled(spark, sf), S.offsets(3, "face")).select("la", "lb", F.round("strength", 6).alias("strength"))
