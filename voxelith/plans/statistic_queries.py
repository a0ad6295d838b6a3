"""Aggregates, distributions, selection, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as C
from ..operators import statistics as A
from ..sources import grids as G
from .grid_queries import POINTS, points
from .registry import query


def _r(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query("ag01_range", f"WITH {G.GRID3} SELECT z, round(min(val), 6) AS low, round(max(val), 6) AS high, round(max(val) - min(val), 6) AS span FROM grid3 GROUP BY z")
def ag01(spark, sf):
    g = G.grid3(spark, sf).groupBy("z").agg(F.min("val").alias("low"), F.max("val").alias("high"))
    return g.withColumn("span", F.col("high") - F.col("low")).select("z", *_r("low", "high", "span"))


@query("ag02_counts", f"WITH {G.GRID3} SELECT z, count(*) FILTER (val > 50000) AS above, count(*) FILTER (val < 30000) AS below FROM grid3 GROUP BY z")
def ag02(spark, sf):
    return G.grid3(spark, sf).groupBy("z").agg(F.count_if(F.col("val") > 50000).alias("above"), F.count_if(F.col("val") < 30000).alias("below"))


@query("ag03_moments", f"WITH {G.GRID3}, v AS (SELECT z, CAST(n AS DOUBLE) AS v FROM grid3), m AS (SELECT z, avg(v) AS m1 FROM v GROUP BY z) SELECT z, round(m1, 6) AS m1, round(avg(pow(v - m1, 2)), 6) AS m2, round(avg(pow(v - m1, 3)), 6) AS m3, round(avg(pow(v - m1, 4)), 6) AS m4 FROM v JOIN m USING (z) GROUP BY z, m1")
def ag03(spark, sf):
    g = G.grid3(spark, sf).select("z", F.col("n").cast("double").alias("v"))
    return A.moments(g, "v", 4, by=["z"]).select("z", *_r("m1", "m2", "m3", "m4"))


@query("ag04_covariance", f"WITH {G.GRID3} SELECT " + ", ".join(f"round(covar_pop({a}, {b}), 6) AS c_{a}_{b}" for a in "xyz" for b in "xyz") + " FROM grid3 WHERE mask = 1")
def ag04(spark, sf):
    c = A.covariance(G.grid3(spark, sf).where("mask = 1"), list("xyz"))
    return c.select(*_r(*c.columns))


@query("ag05_centroid", f"WITH {G.GRID3} SELECT round(coalesce(avg(x), 0), 6) AS cx, round(coalesce(avg(y), 0), 6) AS cy, round(coalesce(avg(z), 0), 6) AS cz FROM grid3 WHERE mask = 1")
def ag05(spark, sf):
    return G.grid3(spark, sf).where("mask = 1").agg(*(F.round(F.coalesce(F.avg(a), F.lit(0.0)), 6).alias(f"c{a}") for a in "xyz"))


HIST = "hist AS (SELECT mask, CAST(floor((n - 0.0) / 2.0) AS INT) AS bin, count(*) AS n FROM grid3 WHERE floor(n / 2.0) BETWEEN 0 AND 19 GROUP BY 1, 2)"
DIST = HIST + ", dist AS (SELECT mask, bin, n, n / sum(n) OVER (PARTITION BY mask) AS pdf, sum(n) OVER (PARTITION BY mask ORDER BY bin) / sum(n) OVER (PARTITION BY mask) AS cdf FROM hist)"


def _hist(spark, sf):
    g = G.grid3(spark, sf).select("mask", F.col("n").cast("double").alias("v"))
    return A.histogram(g, "v", 0.0, 40.0, 20, by=["mask"])


@query("ag06_histogram", f"WITH {G.GRID3}, {HIST} SELECT mask, bin, n FROM hist")
def ag06(spark, sf):
    return _hist(spark, sf)


@query("ag07_edge_histogram", f"WITH {G.GRID3} SELECT CASE WHEN n >= 20 THEN 3 WHEN n >= 12 THEN 2 WHEN n >= 8 THEN 1 ELSE 0 END AS bin, count(*) AS n FROM grid3 WHERE n >= 3 AND n < 50 GROUP BY 1")
def ag07(spark, sf):
    g = G.grid3(spark, sf).select(F.col("n").cast("double").alias("v"))
    return A.edge_histogram(g, "v", [3.0, 8.0, 12.0, 20.0, 50.0])


@query("ag08_pdf_cdf", f"WITH {G.GRID3}, {DIST} SELECT mask, bin, n, round(pdf, 6) AS pdf, round(cdf, 6) AS cdf FROM dist")
def ag08(spark, sf):
    return A.with_pdf_cdf(_hist(spark, sf), ["mask"]).select("mask", "bin", "n", *_r("pdf", "cdf"))


def _sides(spark, sf):
    d = A.with_pdf_cdf(_hist(spark, sf), ["mask"])
    return d.where("mask = 0"), d.where("mask = 1")


@query("ag10_ks_distance", f"WITH {G.GRID3}, {DIST}, p AS (SELECT coalesce(a.bin, b.bin) AS bin, a.cdf AS ca, b.cdf AS cb FROM (SELECT * FROM dist WHERE mask = 0) a FULL JOIN (SELECT * FROM dist WHERE mask = 1) b USING (bin)), f AS (SELECT coalesce(last_value(ca IGNORE NULLS) OVER (ORDER BY bin), 0) AS ca, coalesce(last_value(cb IGNORE NULLS) OVER (ORDER BY bin), 0) AS cb FROM p) SELECT round(max(abs(ca - cb)), 6) AS ksd FROM f")
def ag10(spark, sf):
    return A.kolmogorov_smirnov(*_sides(spark, sf)).select(*_r("ksd"))


@query("ag11_js_divergence", f"WITH {G.GRID3}, {DIST}, p AS (SELECT coalesce(a.pdf, 0) AS pa, coalesce(b.pdf, 0) AS pb FROM (SELECT * FROM dist WHERE mask = 0) a FULL JOIN (SELECT * FROM dist WHERE mask = 1) b USING (bin)), s AS (SELECT -0.5 * sum(CASE WHEN pa > 0 THEN pa * ln(pa) ELSE 0 END + CASE WHEN pb > 0 THEN pb * ln(pb) ELSE 0 END - CASE WHEN pa + pb > 0 THEN (pa + pb) * ln(pa + pb) ELSE 0 END) AS similarity FROM p) SELECT round(ln(2) - similarity, 6) AS jsd, round(similarity, 6) AS similarity FROM s")
def ag11(spark, sf):
    return A.jensen_shannon(*_sides(spark, sf)).select(*_r("jsd", "similarity"))


@query("ag12_correlation", f"WITH {G.GRID3} SELECT z, round(coalesce(CASE WHEN isnan(corr(CAST(n AS DOUBLE), val)) THEN 0 ELSE corr(CAST(n AS DOUBLE), val) END, 0), 6) AS r FROM grid3 GROUP BY z")
def ag12(spark, sf):
    g = G.grid3(spark, sf).select("z", F.col("n").cast("double").alias("n"), "val")
    return A.correlation(g, "n", "val", ["z"]).select("z", *_r("r"))


@query("ag13_masked_correlation", f"WITH {G.GRID3}, v AS (SELECT CAST(n AS DOUBLE) AS a, val AS b FROM grid3 WHERE mask = 1) SELECT round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) AS cosine, round(corr(a, b), 6) AS r FROM v")
def ag13(spark, sf):
    a, b = F.col("n").cast("double"), F.col("val")
    return G.grid3(spark, sf).where("mask = 1").agg(F.round(F.sum(a * b) / F.sqrt(F.sum(a * a) * F.sum(b * b)), 6).alias("cosine"), F.round(F.corr(a, b), 6).alias("r"))


BOX = "box AS (SELECT z, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM grid3 WHERE mask = 1 GROUP BY z)"


@query("ag15_box_overlap", f"WITH {G.GRID3}, {BOX} SELECT a.z AS za, b.z AS zb, CAST((a.x1 - a.x0 + 1) * (a.y1 - a.y0 + 1) AS BIGINT) AS volume, CAST(greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0) + 1, 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0) + 1, 0) AS BIGINT) AS overlap FROM box a JOIN box b ON b.z = a.z + 1")
def ag15(spark, sf):
    box = G.grid3(spark, sf).where("mask = 1").groupBy("z").agg(*(f(a).alias(f"{a}{k}") for a in "xy" for f, k in ((F.min, 0), (F.max, 1))))
    nxt = box.select((F.col("z") - 1).alias("z"), F.col("z").alias("zb"), *(F.col(f"{a}{k}").alias(f"b{a}{k}") for a in "xy" for k in (0, 1)))
    side = lambda a: F.greatest(F.least(f"{a}1", f"b{a}1") - F.greatest(f"{a}0", f"b{a}0") + 1, F.lit(0))
    return box.join(nxt, "z").select(F.col("z").alias("za"), "zb", ((F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)).cast("long").alias("volume"), (side("x") * side("y")).cast("long").alias("overlap"))


@query("s01_indexed_sort", f"WITH {G.GRID3} SELECT z, x, y, CAST(row_number() OVER (PARTITION BY z ORDER BY val, x, y) AS INT) AS place FROM grid3")
def s01(spark, sf):
    return G.grid3(spark, sf).select("z", "x", "y", F.row_number().over(Window.partitionBy("z").orderBy("val", "x", "y")).alias("place"))


@query("s02_nearest_index", f"WITH {G.GRID3}, e AS (SELECT unnest(range(8)) AS i, unnest([10000.0, 20000.0, 30000.0, 40000.0, 50000.0, 60000.0, 70000.0, 80000.0]) AS edge) SELECT x, y, z, CAST(arg_min(i, abs(val - edge) * 10 + i * 0.000001) AS INT) AS nearest FROM grid3, e GROUP BY x, y, z")
def s02(spark, sf):
    edges = [10000.0 * k for k in range(1, 9)]
    best = F.array_min(F.array(*(F.struct(F.abs(F.col("val") - e).alias("d"), F.lit(i).alias("i")) for i, e in enumerate(edges))))
    return G.grid3(spark, sf).select("x", "y", "z", best["i"].alias("nearest"))


@query("s03_element_quantiles", f"WITH {G.GRID3}, l AS (SELECT z, list(n ORDER BY n) AS v FROM grid3 WHERE mask = 1 GROUP BY z) SELECT z, v[CAST(floor(len(v) * 0.25) AS INT) + 1] AS q1, v[CAST(floor(len(v) * 0.5) AS INT) + 1] AS q2, v[CAST(floor(len(v) * 0.75) AS INT) + 1] AS q3, v[CAST(floor(len(v) * 0.9) AS INT) + 1] AS p90 FROM l")
def s03(spark, sf):
    g = G.grid3(spark, sf).where("mask = 1")
    return A.element_quantile(g, "n", {"q1": 0.25, "q2": 0.5, "q3": 0.75, "p90": 0.9}, ["z"])


@query("s05_representative", f"WITH {G.GRID3}, g AS (SELECT * FROM grid3 WHERE mask = 1), c AS (SELECT z, avg(x) AS cx, avg(y) AS cy FROM g GROUP BY z), r AS (SELECT z, x, y, row_number() OVER (PARTITION BY z ORDER BY round((x - cx) * (x - cx) + (y - cy) * (y - cy), 9), x, y) AS k FROM g JOIN c USING (z)) SELECT z, x, y FROM r WHERE k = 1")
def s05(spark, sf):
    """The foreground voxel of each slice nearest to the slice's centroid, the smaller coordinates on ties."""
    g = G.grid3(spark, sf).where("mask = 1").select("z", "x", "y")
    c = g.groupBy("z").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    d2 = F.round((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")), 9)
    best = g.join(c, "z").groupBy("z").agg(F.min(F.struct(d2.alias("d"), "x", "y")).alias("b"))
    return best.select("z", "b.x", "b.y")


@query("s10_combinations", "SELECT a.n_nationkey AS i, b.n_nationkey AS j, c.n_nationkey AS k FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey JOIN nation c ON b.n_regionkey = c.n_regionkey AND b.n_nationkey < c.n_nationkey")
def s10(spark, sf):
    """All subsets of three nations of a region."""
    n = spark.read.parquet(f"{sf}/nation.parquet").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey")).alias("s"))  # small groups by definition of the subsets
    n = n.select("s", F.posexplode("s").alias("p", "i")).select("s", "i", F.posexplode(F.slice("s", F.col("p") + 2, F.size("s"))).alias("q", "j"), "p")
    return n.select("i", "j", F.explode(F.slice("s", F.col("p") + F.col("q") + 3, F.size("s"))).alias("k"))


@query("se01_label_union", f"WITH {G.GRID3} SELECT x, y, z, CASE WHEN mask = 1 OR n > 15 THEN 255 ELSE 0 END AS label FROM grid3")
def se01(spark, sf):
    g = G.grid3(spark, sf)
    a, b = g.select("x", "y", "z", (F.col("mask") * 255).alias("a")), g.select("x", "y", "z", F.when(F.col("n") > 15, 1).otherwise(0).alias("b"))
    return a.join(b, ["x", "y", "z"]).select("x", "y", "z", F.when(F.col("b") != 0, 255).otherwise(F.col("a")).alias("label"))


@query("se02_bitwise", f"WITH {G.GRID3} SELECT x, y, z, n & 12 AS both, n | 3 AS either FROM grid3")
def se02(spark, sf):
    return G.grid3(spark, sf).select("x", "y", "z", F.col("n").bitwiseAND(F.lit(12).cast("long")).alias("both"), F.col("n").bitwiseOR(F.lit(3).cast("long")).alias("either"))


@query("sc01_round_half", "SELECT s_suppkey, CAST(trunc(s_acctbal + 0.5) AS INT) AS rounded FROM supplier")
def sc01(spark, sf):
    return spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", C.round_half(F.col("s_acctbal")).alias("rounded"))


@query("sc02_vectors", f"WITH {POINTS} SELECT id, round(sqrt(px * px + py * py + d * d), 6) AS len, round(px * 1.0 + py * 2.0 + d * 3.0, 6) AS dot, round((px * 1.0 + py * 2.0 + d * 3.0) / (sqrt(px * px + py * py + d * d) * sqrt(14.0)), 6) AS cosine FROM pts")
def sc02(spark, sf):
    v, w = [F.col("px"), F.col("py"), F.col("d")], [F.lit(1.0), F.lit(2.0), F.lit(3.0)]
    return points(spark, sf).select("id", F.round(C.length(*v), 6).alias("len"), F.round(C.dot(v, w), 6).alias("dot"), F.round(C.cosine(v, w), 6).alias("cosine"))


@query("sc03_normals", f"WITH {POINTS} SELECT id, round(py * (d + 1) - d * (px - 2), 6) AS nx, round(d * 3 - px * (d + 1), 6) AS ny, round(px * (px - 2) - py * 3, 6) AS nz, round(px * (5 * 2 - 1 * d) - py * (1 * 2 - 1 * 3) + d * (1 * d - 5 * 3), 6) AS det FROM pts")
def sc03(spark, sf):
    """Facet normals of the triangle (0, p, q) with q = (3, px - 2, d + 1), and a determinant."""
    p, q, zero = [F.col("px"), F.col("py"), F.col("d")], [F.lit(3.0), F.col("px") - 2, F.col("d") + 1], [F.lit(0.0)] * 3
    n = C.normal3(zero, p, q)
    det = C.det3([p, [F.lit(1.0), F.lit(5.0), F.lit(1.0)], [F.lit(3.0), F.col("d"), F.lit(2.0)]])
    return points(spark, sf).select("id", *(F.round(c, 6).alias(a) for a, c in zip(("nx", "ny", "nz"), n)), F.round(det, 6).alias("det"))


@query("sc04_affine", f"WITH {G.GRID3}, m AS (SELECT min(val) AS lo, max(val) AS hi FROM grid3) SELECT x, y, z, (val - 100) * 0.5 AS scaled, 255 * (val - lo) / (hi - lo) AS stretched FROM grid3, m")
def sc04(spark, sf):
    g = G.grid3(spark, sf)
    m = g.agg(F.min("val").alias("lo"), F.max("val").alias("hi"))
    return g.crossJoin(F.broadcast(m)).select("x", "y", "z", ((F.col("val") - 100) * 0.5).alias("scaled"), (255 * (F.col("val") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("stretched"))  # m is one row


def _ramp_sql(name: str) -> str:
    knots = C.RAMPS[name]
    parts = [f"WHEN v <= {knots[0][0]} THEN {knots[0][1]}e0"]
    parts += [f"WHEN v <= {b} THEN {p}e0 + CAST({q - p} AS DOUBLE) * (v - {a}) / {b - a}e0" for (a, p), (b, q) in zip(knots, knots[1:])]
    return f"CASE {' '.join(parts)} ELSE {knots[-1][1]}e0 END AS {name}"


@query("sc05_ramps", f"WITH {G.GRID3}, v AS (SELECT x, y, z, val / 100 AS v FROM grid3) SELECT x, y, z, {', '.join(map(_ramp_sql, C.RAMPS))} FROM v")
def sc05(spark, sf):
    return G.grid3(spark, sf).select("x", "y", "z", *(C.ramp(F.col("val") / 100, n).alias(n) for n in C.RAMPS))


@query("sc08_sphere_overlap", f"WITH {POINTS}, q AS (SELECT id, d AS r1, 4.0 AS r2, px / 10 AS c FROM pts) SELECT id, round(CASE WHEN c >= r1 + r2 THEN 0.0 WHEN c <= abs(r1 - r2) THEN 1.0 ELSE (3.141592653589793 * pow((r2 - r1 + c) * (r2 + r1 - c) / (2 * c), 2) * (3 * r1 - (r2 - r1 + c) * (r2 + r1 - c) / (2 * c)) / 3 + 3.141592653589793 * pow((r1 - r2 + c) * (r1 + r2 - c) / (2 * c), 2) * (3 * r2 - (r1 - r2 + c) * (r1 + r2 - c) / (2 * c)) / 3) / (4 * 3.141592653589793 / 3 * pow(least(r1, r2), 3)) END, 6) AS ratio FROM q")
def sc08(spark, sf):
    return points(spark, sf).select("id", F.round(C.overlap_ratio(F.col("d"), F.lit(4.0), F.col("px") / 10), 6).alias("ratio"))


@query("sc09_complex", f"WITH {POINTS} SELECT id, round(px * d - py * 2, 6) AS re, round(px * 2 + py * d, 6) AS im, round(sqrt(px * px + py * py), 6) AS magnitude, round(px * px + py * py, 6) AS power, round(atan2(py, px), 6) AS phase FROM pts")
def sc09(spark, sf):
    """(px + i py) times (d + 2 i), and magnitude, power and phase of the first."""
    a, b = F.col("px"), F.col("py")
    return points(spark, sf).select("id", F.round(a * F.col("d") - b * 2, 6).alias("re"), F.round(a * 2 + b * F.col("d"), 6).alias("im"), F.round(C.length(a, b), 6).alias("magnitude"), F.round(a * a + b * b, 6).alias("power"), F.round(F.atan2(b, a), 6).alias("phase"))


@query("fe02_density", f"WITH {G.GRID3}, g AS (SELECT n FROM grid3 WHERE mask = 1), l AS (SELECT list(n ORDER BY n) AS v FROM g), s AS (SELECT avg(CASE WHEN n <= 6 THEN 1.0 ELSE 0.0 END) AS share, avg(n) / 1000 AS mean, stddev_pop(n) / 100 AS std FROM g) SELECT round(share, 6) AS share, round(mean, 6) AS mean, round(std, 6) AS std, round(v[CAST(floor(len(v) * 0.5) AS INT) + 1] / 1000, 6) AS median, round(v[CAST(floor(len(v) * 0.25) AS INT) + 1] / 1000, 6) AS q1, round(v[CAST(floor(len(v) * 0.75) AS INT) + 1] / 1000, 6) AS q3, round(v[CAST(floor(len(v) * 0.9) AS INT) + 1] / 1000, 6) AS p90 FROM s, l")
def fe02(spark, sf):
    g = G.grid3(spark, sf).where("mask = 1").select("n")
    q = A.element_quantile(g, "n", {"median": 0.5, "q1": 0.25, "q3": 0.75, "p90": 0.9})
    s = g.agg(F.avg((F.col("n") <= 6).cast("double")).alias("share"), (F.avg("n") / 1000).alias("mean"), (F.stddev_pop("n") / 100).alias("std"))
    q = q.select(*((F.col(c) / 1000).alias(c) for c in q.columns))
    return s.crossJoin(q).select(*_r("share", "mean", "std", "median", "q1", "q3", "p90"))  # one row each
