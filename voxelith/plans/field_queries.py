"""Diffusion, hulls, image algebra and descriptors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import ramp
from ..operators import diffusion as D
from ..operators import features as E
from ..operators import fixpoint as P
from ..operators import hulls as H
from ..operators import images as I
from ..operators import stencil as S
from ..operators.distance import distance
from ..sources import grids as G
from .fixpoint_queries import BD, BFG, FULL, _balls, _deep
from .grid_queries import DIMS
from .registry import query


def _level(src: str, dst: str, expression: str) -> str:
    """A round of a stencil in SQL: e, w, f, v, u, d are the six neighbours, the centre where absent."""
    nb = {"e": "a.x + 1,a.y,a.z", "w": "a.x - 1,a.y,a.z", "f": "a.x,a.y + 1,a.z", "v": "a.x,a.y - 1,a.z", "u": "a.x,a.y,a.z + 1", "d": "a.x,a.y,a.z - 1"}
    joins = " ".join(f"LEFT JOIN {src} {k} ON {k}.x = {p.split(',')[0]} AND {k}.y = {p.split(',')[1]} AND {k}.z = {p.split(',')[2]}" for k, p in nb.items())
    near = " + ".join(f"coalesce({k}.c, a.c)" for k in nb)
    return f"{dst} AS (SELECT a.x, a.y, a.z, {expression.format(near=f'({near})')} AS c FROM {src} a {joins})"


RD = "least(greatest(a.c + 0.25 * (a.c * (a.c - (a.c * a.c + (1 - a.c) * (1 - a.c))) + 0.125 * ({near} - 6 * a.c)), 0.0), 1.0)"
C0 = "c0 AS (SELECT x, y, z, CASE WHEN val <= 30000 THEN 0.0 WHEN val <= 50000 THEN (val - 30000) / 20000 ELSE 1.0 END AS c FROM grid3)"


def _c0(spark, sf):
    v = F.col("val")
    return G.grid3(spark, sf).withColumn("c", F.when(v <= 30000, 0.0).when(v <= 50000, (v - 30000) / 20000).otherwise(1.0))


@query("p01_reaction_diffusion", f"WITH {G.GRID3}, {C0}, {_level('c0', 'c1', RD)}, {_level('c1', 'c2', RD)}, {_level('c2', 'c3', RD)}, {_level('c3', 'c4', RD)} SELECT x, y, z, round(c, 5) AS c FROM c4")
def p01(spark, sf):
    return D.react_diffuse(_c0(spark, sf), "c").select("x", "y", "z", F.round("c", 5).alias("c"))


@query("p01_raster_order")
def p01r(spark, sf):
    """In place in index order, for comparison with sequential programs."""
    return D.react_diffuse(_c0(spark, sf), "c", order="raster").select("x", "y", "z", "c")


@query("p03_figure_ground", f"WITH {G.GRID3}, {C0}, {_level('c0', 'c1', RD)}, {_level('c1', 'c2', RD)} SELECT z, count(*) FILTER (c > 0.5) AS n_figure FROM c2 GROUP BY z")
def p03(spark, sf):
    q = D.react_diffuse(_c0(spark, sf), "c", rounds=2)
    return q.groupBy("z").agg(F.count_if(F.col("c") > 0.5).alias("n_figure"))


@query("p04_relaxation", f"WITH {G.GRID3}, c0 AS (SELECT x, y, z, val AS c FROM grid3), {_level('c0', 'c1', '0.5 * a.c + 0.5 * {near} / 6')}, {_level('c1', 'c2', '0.5 * a.c + 0.5 * {near} / 6')}, {_level('c2', 'c3', '0.5 * a.c + 0.5 * {near} / 6')} SELECT x, y, z, round(c, 4) AS c FROM c3")
def p04(spark, sf):
    return D.relax(G.grid3(spark, sf).withColumn("c", F.col("val")), "c", 3).select("x", "y", "z", F.round("c", 4).alias("c"))


@query("p05_patch_smoothing", f"WITH {G.GRID3}, n AS (SELECT a.x, a.y, a.z, any_value(a.val) AS c, count(b.x) AS k, sum(CASE WHEN abs(b.val - a.val) > 20000 THEN a.val ELSE b.val END) AS s FROM grid3 a LEFT JOIN grid3 b ON a.z = b.z AND abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY 1, 2, 3) SELECT x, y, z, round(CASE WHEN k = 4 THEN (c + s) / 5 ELSE c END + 1e-7, 4) AS c FROM n")
def p05(spark, sf):
    g = G.grid3(spark, sf).withColumn("c", F.col("val"))
    return D.smooth_patches(g, "c", limit=20000.0).select("x", "y", "z", F.round(F.col("c") + 1e-7, 4).alias("c"))


@query("h01_hull")
def h01(spark, sf):
    """Facets of the hull of the largest component of the balls."""
    lab = P.cut(P.components(_balls(spark, sf), S.offsets(3, "face"), (24, 24, 24, 1)), "hull-parts")
    sizes = lab.groupBy("vol_id", "label").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("vol_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("m")).select("vol_id", F.col("m.label").alias("label"))
    return H.hull_facets(S.surface(lab.join(largest, ["vol_id", "label"], "left_semi").select(*S.KEY), 3))


PLANES = [(1.0, 1.0, 0.0, 28.0), (-1.0, 0.0, 1.0, -4.0), (0.0, 0.0, -1.0, -2.0), (0.5, -1.0, 0.0, 10.0)]


@query("h04_carve", f"WITH {G.BALLS}, {BFG}, f(nx, ny, nz, o) AS (VALUES {', '.join(str(tuple(float(c) for c in p)) for p in PLANES)}) SELECT x, y, z FROM bfg b WHERE NOT EXISTS (SELECT 1 FROM f WHERE nx * b.x + ny * b.y + nz * b.z - o > 0.01)")
def h04(spark, sf):
    planes = spark.createDataFrame([(0, *p) for p in PLANES], "vol_id long, nx double, ny double, nz double, offset double")
    return H.carve(_balls(spark, sf), planes).select("x", "y", "z")


OPPOSITE = "o(dx, dy, dz) AS (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))"


@query("h05_refine_boundary", f"WITH {G.BALLS}, {BFG}, {OPPOSITE}, seg AS (SELECT x, y, z FROM bfg WHERE (x + y + z) % 4 <> 0) SELECT DISTINCT l.x, l.y, l.z FROM bfg l CROSS JOIN o JOIN seg s ON s.x = l.x + dx AND s.y = l.y + dy AND s.z = l.z + dz WHERE NOT EXISTS (SELECT 1 FROM seg t WHERE t.x = l.x AND t.y = l.y AND t.z = l.z) AND NOT EXISTS (SELECT 1 FROM bfg b WHERE b.x = l.x - dx AND b.y = l.y - dy AND b.z = l.z - dz)")
def h05(spark, sf):
    fg = _balls(spark, sf)
    return H.refine_boundary(fg.where((F.col("x") + F.col("y") + F.col("z")) % 4 != 0), fg).select("x", "y", "z")


@query("sc06_sphericity", f"WITH {G.BALLS}, {BFG}, {FULL}, {BD} SELECT a.x, a.y, a.z, round(count(*) FILTER (b.d > 0 AND b.d < a.d) / 26.0, 6) AS sp FROM dist a CROSS JOIN full26 LEFT JOIN dist b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY 1, 2, 3")
def sc06(spark, sf):
    return E.sphericity(_deep(spark, sf), "d").select("x", "y", "z", F.round("sp", 6).alias("sp"))


@query("s04_top_seeds", f"WITH {G.BALLS}, {BFG}, {FULL}, {BD}, sp AS (SELECT a.x, a.y, a.z, count(*) FILTER (b.d > 0 AND b.d < a.d) / 26.0 AS sp FROM dist a CROSS JOIN full26 LEFT JOIN dist b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY 1, 2, 3) SELECT x, y, z, round(sp, 6) AS sp FROM sp WHERE sp >= 0.1 AND sp >= 0.95 * (SELECT max(sp) FROM sp)")
def s04(spark, sf):
    """The best sphericity and all within 95 percent of it."""
    sp = E.sphericity(_deep(spark, sf), "d")
    top = sp.agg(F.max("sp").alias("top"))
    return sp.crossJoin(F.broadcast(top)).where("sp >= 0.1 AND sp >= 0.95 * top").select("x", "y", "z", F.round("sp", 6).alias("sp"))  # top is one row


@query("s07_plateaus", f"WITH RECURSIVE {G.BALLS}, {BFG}, {FULL}, {BD}, nb AS (SELECT a.x + 24 * (a.y + 24 * a.z) AS a, b.x + 24 * (b.y + 24 * b.z) AS b FROM dist a CROSS JOIN full26 JOIN dist b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz AND a.d = b.d), cc(node, root) USING KEY (node) AS (SELECT x + 24 * (y + 24 * z), x + 24 * (y + 24 * z) FROM dist UNION SELECT e.b, min(c.root) FROM cc c JOIN nb e ON e.a = c.node JOIN recurring.cc r ON r.node = e.b WHERE c.root < r.root GROUP BY e.b), up AS (SELECT DISTINCT a.x + 24 * (a.y + 24 * a.z) AS i FROM dist a CROSS JOIN full26 JOIN dist b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz AND b.d > a.d) SELECT CAST(node % 24 AS INT) AS x, CAST(node // 24 % 24 AS INT) AS y, CAST(node // 576 AS INT) AS z FROM cc WHERE root NOT IN (SELECT root FROM cc JOIN up ON up.i = node)")
def s07(spark, sf):
    """Maxima whose plateau of equal values touches nothing higher."""
    deep = _deep(spark, sf)
    flat = P.components(deep, S.offsets(3), (24, 24, 24, 1), same=["d"])
    rising = S.gather(deep, S.offsets(3), {"nd": F.max(S.near(F.col("d")))}, ["d"]).where("nd > d").select(*S.KEY)
    bad = flat.join(rising, S.KEY, "left_semi").select("vol_id", "label").distinct()
    return flat.join(bad, ["vol_id", "label"], "left_anti").select("x", "y", "z")


@query("sc10_image_arithmetic", f"WITH {G.GRID3} SELECT x, y, z, val + n AS plus, val - n AS minus, val * n AS times, val / n AS over FROM grid3")
def sc10(spark, sf):
    g = G.grid3(spark, sf)
    b = g.withColumn("val", F.col("n").cast("double"))
    out = g.select(*S.KEY)
    for name, op in (("plus", "+"), ("minus", "-"), ("times", "*"), ("over", "/")):
        out = out.join(I.combine(g, b, op).withColumnRenamed("val", name), S.KEY)
    return out.select("x", "y", "z", "plus", "minus", "times", "over")


@query("sc11_borders", "WITH i AS (SELECT CAST(range AS INT) - 8 AS i FROM range(24)) SELECT i, greatest(0, least(i, 7)) AS clamp, ((i % 8) + 8) % 8 AS wrap, CASE WHEN ((i % 14) + 14) % 14 < 8 THEN ((i % 14) + 14) % 14 ELSE 14 - ((i % 14) + 14) % 14 END AS mirror, CASE WHEN i BETWEEN 0 AND 7 THEN i END AS zero FROM i")
def sc11(spark, sf):
    i = spark.range(24).select((F.col("id").cast("int") - 8).alias("i"))
    return i.select("i", *(I.border(F.col("i"), 8, p).alias(p) for p in ("clamp", "wrap", "mirror", "zero")))


def _line(spark, sf, policy):
    """The quantities 1 to 50, moved to 0 to 49, with two places more at both ends."""
    lines = I.crop(G.grid3(spark, sf), x=(1, 50))
    return I.extend(lines, "x", 50, 2, policy, default=-1.0).select("x", "y", "z", "val")


LINE = f"WITH {G.GRID3}, l AS (SELECT x - 1 AS x, y, z, val FROM grid3 WHERE x BETWEEN 1 AND 50)"


@query("sc11_extrapolate", f"{LINE}, o(j, edge, far) AS (VALUES (-2, 0, 2), (-1, 0, 1), (50, 49, 48), (51, 49, 47)) SELECT * FROM l UNION ALL SELECT o.j, a.y, a.z, 2 * a.val - b.val FROM o JOIN l a ON a.x = o.edge JOIN l b ON b.x = o.far AND b.y = a.y AND b.z = a.z")
def sc11_extrapolate(spark, sf):
    return _line(spark, sf, "extrapolate")


@query("sc11_constant", f"{LINE}, o(j) AS (VALUES (-2), (-1), (50), (51)) SELECT * FROM l UNION ALL SELECT o.j, k.y, k.z, -1.0 FROM o CROSS JOIN (SELECT DISTINCT y, z FROM l) k")
def sc11_constant(spark, sf):
    return _line(spark, sf, "constant")


@query("sc12_crop_scale_roll", f"WITH {G.GRID3}, c AS (SELECT x - 10 AS x, y - 2 AS y, n FROM grid3 WHERE x BETWEEN 10 AND 19 AND y BETWEEN 2 AND 6 AND z = 4), k AS (SELECT CAST(range AS INT) AS k FROM range(2)), u AS (SELECT x * 2 + a.k AS x, y * 2 + b.k AS y, n FROM c, k a, k b) SELECT (x - 3 + 20) % 20 AS x, y, n FROM u")
def sc12(spark, sf):
    c = I.crop(G.grid3(spark, sf).where("z = 4"), x=(10, 19), y=(2, 6))
    return I.roll(I.upscale(c, 2), "x", 3, 20).select("x", "y", "n")


@query("sc12_paste", f"WITH {G.GRID3} SELECT a.x, a.y, coalesce(b.n, a.n) AS n FROM grid3 a LEFT JOIN grid3 b ON a.x = b.x + 5 AND a.y = b.y + 1 AND b.z = 2 AND b.x < 10 WHERE a.z = 1")
def sc12p(spark, sf):
    g = G.grid3(spark, sf)
    return I.paste(g.where("z = 1"), g.where("z = 2 AND x < 10"), {"x": 5, "y": 1, "z": -1}, "n").select("x", "y", "n")


@query("sc13_same_shape", f"WITH {G.GRID3}, s AS (SELECT z, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM grid3 GROUP BY z) SELECT p.z AS z, p.b - p.a = q.b - q.a AND p.d - p.c = q.d - q.c AS same FROM s p JOIN s q ON q.z = p.z + 1")
def sc13(spark, sf):
    s = G.grid3(spark, sf).groupBy("z").agg((F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    nxt = s.select((F.col("z") - 1).alias("z"), F.col("w").alias("w2"), F.col("h").alias("h2"))
    return s.join(nxt, "z").select("z", ((F.col("w") == F.col("w2")) & (F.col("h") == F.col("h2"))).alias("same"))


@query("sc14_eigenvalues", f"WITH {G.GRID3}, c AS (SELECT z, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(y, y) AS yy FROM grid3 WHERE mask = 1 GROUP BY z), e AS (SELECT z, (xx + yy) / 2 AS m, sqrt((xx - yy) * (xx - yy) / 4 + xy * xy) AS d FROM c) SELECT z, round(list_sort([m - d, m + d, 1.0])[1], 4) AS e1, round(list_sort([m - d, m + d, 1.0])[2], 4) AS e2, round(list_sort([m - d, m + d, 1.0])[3], 4) AS e3 FROM e")
def sc14(spark, sf):
    """Eigenvalues of each slice's covariance, with 1 on the third axis."""
    c = G.grid3(spark, sf).where("mask = 1").groupBy("z").agg(F.var_pop("x").alias("xx"), F.covar_pop("x", "y").alias("xy"), F.var_pop("y").alias("yy"))
    m = F.array("xx", "xy", F.lit(0.0), "xy", "yy", F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    e = c.select("z", E.symmetric_eigenvalues(m).alias("e"))
    return e.select("z", *(F.round(F.col("e")[i], 4).alias(f"e{i + 1}") for i in range(3)))


@query("sc15_least_squares", f"WITH {G.GRID3} SELECT round(regr_intercept(val, n), 4) AS intercept, round(regr_slope(val, n), 4) AS slope FROM grid3")
def sc15(spark, sf):
    a, b = E.least_squares(G.grid3(spark, sf), ["n"], "val")
    return spark.createDataFrame([(round(float(a), 4), round(float(b), 4))], "intercept double, slope double")


@query("fe01_size", f"WITH {G.BALLS}, {BFG}, s AS (SELECT z, count(*) AS n, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy FROM bfg GROUP BY z), e AS (SELECT z, n, 4 * sqrt(greatest((xx + yy) / 2 + sqrt((xx - yy) * (xx - yy) / 4 + xy * xy), 0)) AS a, 4 * sqrt(greatest((xx + yy) / 2 - sqrt((xx - yy) * (xx - yy) / 4 + xy * xy), 0)) AS b FROM s) SELECT CAST((SELECT sum(n) FROM e) AS DOUBLE) AS volume, round(a, 5) AS length, round(b, 5) AS width, round(CASE WHEN a > 0 THEN b / a ELSE 0 END, 5) AS ratio, z AS slice FROM e ORDER BY round(a * b, 9) DESC, z LIMIT 1")
def fe01(spark, sf):
    f = E.size_features(_balls(spark, sf))
    return f.select("volume", *(F.round(c, 5).alias(c) for c in ("length", "width", "ratio")), "slice")


@query("w10_shells", f"WITH {G.BALLS}, {BFG}, {BD}, c AS (SELECT d, count(*) AS k FROM dist GROUP BY d), s AS (SELECT d, k, least(CAST(floor((sum(k) OVER (ORDER BY d) - k / 2.0) * 5 / sum(k) OVER ()) AS INT) + 1, 5) AS shell FROM c) SELECT shell, CAST(sum(k) AS BIGINT) AS n, min(d) AS low, max(d) AS high FROM s GROUP BY shell")
def w10(spark, sf):
    return E.shells(_deep(spark, sf), "d", 5).groupBy("shell").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high"))


@query("fe07_shell_divergence")
def fe07(spark, sf):
    """Count profiles of the foreground by shells of depth."""
    g = G.grid3(spark, sf)
    deep = g.where("mask = 1").join(distance(g, "mask = 0", dims=DIMS), S.KEY)
    return E.shell_divergence(E.shells(deep, "d", 4), "shell", "n", 0.0, 40.0, 20)
