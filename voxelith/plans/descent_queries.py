"""Descent links, labels along them, growth checks, sources and event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import descent as Q
from ..operators import fixpoint as P
from ..operators import stencil as S
from ..sources import arrays as A
from ..sources import grids as G
from .fixpoint_queries import BD, BDIMS, BFG, SEEDS, _balls, _deep, _seeds
from .grid_queries import FACE, FULL
from .registry import query
from .tables import numbered

GEN = f"{G.BALLS}, {BFG}, {FACE}, {FULL}, s AS (SELECT a.x, a.y, a.z FROM bfg a CROSS JOIN face LEFT JOIN bfg b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY ALL HAVING count(b.x) < 6), w(x, y, z, wave) USING KEY (x, y, z) AS (SELECT x, y, z, 1 FROM s UNION SELECT DISTINCT b.x, b.y, b.z, w.wave + 1 FROM w CROSS JOIN face JOIN bfg b ON b.x = w.x + dx AND b.y = w.y + dy AND b.z = w.z + dz WHERE NOT EXISTS (SELECT 1 FROM recurring.w r WHERE r.x = b.x AND r.y = b.y AND r.z = b.z)), g AS (SELECT x + 24 * (y + 24 * z) AS i, * FROM w), nb AS (SELECT a.i AS i, a.wave AS g, b.i AS n, b.wave AS ng, dx * dx + dy * dy + dz * dz AS len2 FROM g a CROSS JOIN full26 JOIN g b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz), down AS (SELECT i AS a, n AS b FROM (SELECT *, rank() OVER (PARTITION BY i ORDER BY len2) AS r FROM nb WHERE ng = g + 1) WHERE r = 1)"


def _gen(spark, sf):
    fg = _balls(spark, sf)
    return P.cut(P.waves(fg, S.surface(fg, 3), S.offsets(3, "face"), first=1), "generations")


@query("s09_descent_links", f"WITH RECURSIVE {GEN} SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM down")
def s09(spark, sf):
    return Q.descent_links(_gen(spark, sf), BDIMS, fill=False).select("a", "b")


@query("fx12_filled_links")
def fx12(spark, sf):
    """Links with voxels without a descendant joined to one of their generation; rounds have no plain SQL form."""
    return Q.descent_links(_gen(spark, sf), BDIMS)


@query("fx13_pruned_links", f"WITH RECURSIVE {GEN} SELECT CAST(a AS BIGINT) AS a, CAST(min(b) AS BIGINT) AS b FROM down GROUP BY a")
def fx13(spark, sf):
    return Q.pruned(Q.descent_links(_gen(spark, sf), BDIMS, fill=False)).select("a", "b")


@query("fx14_reach", f"WITH RECURSIVE {GEN}, starts AS (SELECT DISTINCT a AS node FROM down WHERE a % 50 = 0), r(start, node) AS (SELECT node, node FROM starts UNION SELECT r.start, down.b FROM r JOIN down ON down.a = r.node) SELECT CAST(start AS BIGINT) AS start, count(*) AS n, CAST(max(node) AS BIGINT) AS last FROM r GROUP BY start")
def fx14(spark, sf):
    links = P.cut(Q.descent_links(_gen(spark, sf), BDIMS, fill=False), "links")
    starts = links.where("a % 50 = 0").select(F.col("a").alias("node"))
    return Q.reach(links, starts).groupBy("start").agg(F.count("*").alias("n"), F.max("node").alias("last"))


@query("fx15_core_labels", f"WITH RECURSIVE {GEN}, cores AS (SELECT DISTINCT b AS node FROM down WHERE b NOT IN (SELECT a FROM down)), c AS (SELECT node, row_number() OVER (ORDER BY node) AS label FROM cores), l(node, label) USING KEY (node) AS (SELECT node, label FROM c UNION SELECT down.a, min(l.label) FROM l JOIN down ON down.b = l.node WHERE NOT EXISTS (SELECT 1 FROM recurring.l r WHERE r.node = down.a) GROUP BY down.a) SELECT CAST(node AS BIGINT) AS node, CAST(label AS INT) AS label FROM l")
def fx15(spark, sf):
    links = P.cut(Q.descent_links(_gen(spark, sf), BDIMS, fill=False), "links")
    ends = links.select(F.col("b").alias("node")).distinct().join(links.select(F.col("a").alias("node")).distinct(), "node", "left_anti")
    return Q.core_labels(links, numbered(ends, [], ["node"], "label")).select("node", "label")


@query("s08_generation_maxima", f"WITH RECURSIVE {GEN} SELECT CAST(i % 24 AS INT) AS x, CAST(i // 24 % 24 AS INT) AS y, CAST(i // 576 AS INT) AS z, any_value(g) AS wave FROM nb GROUP BY i HAVING max(ng) <= any_value(g)")
def s08(spark, sf):
    """Voxels with neighbours none of which is of a greater generation."""
    return Q.local_generation_maxima(_gen(spark, sf)).select("x", "y", "z", "wave")


@query("fx29_separation", f"WITH RECURSIVE {GEN}, lab AS (SELECT x, y, z, wave, x // 6 AS label FROM w) SELECT CAST(a.label AS INT) AS la, CAST(b.label AS INT) AS lb, min(greatest(a.wave, b.wave)) AS wave FROM lab a CROSS JOIN face JOIN lab b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz WHERE a.label < b.label GROUP BY 1, 2")
def fx29(spark, sf):
    g = _gen(spark, sf)
    return Q.separation_wave(g.withColumn("label", F.floor(F.col("x") / 6).cast("int")), g).select("la", "lb", "wave")


@query("fx28_erosion", f"WITH RECURSIVE {GEN} SELECT x, y, z, wave AS layer FROM w")
def fx28(spark, sf):
    """Layers of repeated erosion; without protected voxels they are the generations."""
    fg = _balls(spark, sf)
    return Q.erode_until_apart(fg, fg.limit(0)).select("x", "y", "z", "layer")


VAL = "rate AS (SELECT a.x, a.y, a.z, a.wave, round((sqrt(nd.d) - sqrt(ad.d)) / sqrt(CAST(dx * dx + dy * dy + dz * dz AS DOUBLE)), 6) AS rate, v2.wave AS nw FROM v a JOIN dist ad USING (x, y, z) CROSS JOIN full26 JOIN dist nd ON nd.x = a.x + dx AND nd.y = a.y + dy AND nd.z = a.z + dz LEFT JOIN v v2 ON v2.x = nd.x AND v2.y = nd.y AND v2.z = nd.z), top AS (SELECT x, y, z, max(rate) FILTER (rate > 0) AS top FROM rate GROUP BY 1, 2, 3), ok AS (SELECT x, y, z, any_value(wave) AS wave, bool_or(coalesce(rate = top AND nw = wave - 1, false)) AS ok FROM rate JOIN top USING (x, y, z) GROUP BY 1, 2, 3)"


@query("fx23_growth_validation", f"WITH RECURSIVE {G.BALLS}, {BFG}, {SEEDS}, {FULL}, {BD}, v(x, y, z, d, wave) USING KEY (x, y, z) AS (SELECT DISTINCT dist.x, dist.y, dist.z, d, 1 FROM dist JOIN seed USING (x, y, z) UNION SELECT DISTINCT b.x, b.y, b.z, b.d, w.wave + 1 FROM v w CROSS JOIN full26 JOIN dist b ON b.x = w.x + dx AND b.y = w.y + dy AND b.z = w.z + dz WHERE b.d < w.d AND NOT EXISTS (SELECT 1 FROM recurring.v r WHERE r.x = b.x AND r.y = b.y AND r.z = b.z)), {VAL} SELECT x, y, z, wave FROM ok WHERE ok OR wave = 1")
def fx23(spark, sf):
    deep = P.cut(_deep(spark, sf), "depth")
    grown = P.waves(deep, _seeds(spark, sf), S.offsets(3), lambda a, b: b < a, "d", first=1)
    return Q.validate_growth(grown, deep, grown).select("x", "y", "z", "wave")


@query("j11_relocation", f"WITH RECURSIVE {G.BALLS}, {BFG}, {FULL}, {BD}, seed AS (SELECT n_nationkey AS click, dist.* FROM nation JOIN dist ON dist.x = n_nationkey * 7 % 24 + 1 AND dist.y = n_nationkey * 11 % 24 AND dist.z = n_nationkey * 5 % 24), m(click, x, y, z, d, k) AS (SELECT click, x, y, z, d, 0 FROM seed UNION SELECT click, x, y, z, d, k FROM (SELECT m.click, b.x, b.y, b.z, b.d, m.k + 1 AS k, max(b.d) OVER (PARTITION BY m.click) AS top, max(m.d) OVER (PARTITION BY m.click) AS old FROM m CROSS JOIN (SELECT dx, dy, dz FROM full26 UNION ALL SELECT 0, 0, 0) o JOIN dist b ON b.x = m.x + dx AND b.y = m.y + dy AND b.z = m.z + dz) WHERE d = top AND top > old), l AS (SELECT click, max(k) AS k FROM m GROUP BY click) SELECT click, min(m.x) AS x, max(m.d) AS d FROM m JOIN l USING (click, k) GROUP BY click")
def j11(spark, sf):
    """The deepest place that each click climbs to: its least x, and the depth."""
    deep = P.cut(_deep(spark, sf), "depth")
    k = F.col("n_nationkey")
    clicks = spark.read.parquet(f"{sf}/nation.parquet").select(k.alias("click"), F.lit(0).cast("long").alias("vol_id"), (k * 7 % 24 + 1).alias("x"), (k * 11 % 24).alias("y"), (k * 5 % 24).alias("z"), F.lit(0).alias("t"))
    got = Q.relocate(deep, clicks)
    plateau = got.join(deep, S.KEY).groupBy("click").agg(F.min("x").alias("x"), F.max("d").alias("d"))
    return plateau


@query("gr16_plane_sides", f"WITH {G.BALLS}, {BFG}, {FACE}, s AS (SELECT a.x, a.y, a.z FROM bfg a CROSS JOIN face LEFT JOIN bfg b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY ALL HAVING count(b.x) < 6) SELECT CASE WHEN (x - 12) * 1 + (y - 11) * 2 - (z - 10) * 1 > 0 THEN 1 ELSE 0 END AS side, count(*) AS n FROM s GROUP BY 1")
def gr16(spark, sf):
    s = S.surface(_balls(spark, sf), 3)
    return Q.plane_sides(s, {"x": 12, "y": 11, "z": 10}, {"x": 1, "y": 2, "z": -1}).groupBy("side").agg(F.count("*").alias("n"))


@query("io01_load_array", f"WITH {G.SERIES}, c AS (SELECT key, unnest(v) AS val, unnest(range(24)) AS i FROM series) SELECT CAST(key AS BIGINT) AS vol_id, CAST(i % 6 AS INT) AS x, CAST(i // 6 AS INT) AS y, val FROM c")
def io01(spark, sf):
    """Each user's 24 hours as a 6 x 4 image."""
    return A.load_array(G.series(spark, sf).withColumnRenamed("key", "vol_id"), "v", (6, 4)).select("vol_id", "x", "y", "val")


@query("io02_first_element", f"WITH {G.SERIES} SELECT key, v[1] AS first FROM series")
def io02(spark, sf):
    return G.series(spark, sf).select("key", A.load_scalar(None, "v", 0.0).alias("first"))


@query("io03_store_array", f"WITH {G.GRID3} SELECT z, count(*) AS size, CAST(sum(n) AS BIGINT) AS total, list(n ORDER BY y, x)[1] AS first FROM grid3 GROUP BY z")
def io03(spark, sf):
    """Each slice as one flat array, read back by size, sum and first element."""
    slices = G.grid3(spark, sf).select(F.col("z").cast("long").alias("vol_id"), "x", "y", F.lit(0).alias("z"), "t", "n")
    arrays = A.store_array(slices, (51, 11), "uint32", "n")
    return arrays.select(F.col("vol_id").cast("int").alias("z"), F.size("data").cast("long").alias("size"), F.aggregate("data", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"), F.element_at("data", 1).alias("first"))


@query("io05_ragged", "SELECT n_regionkey AS region, CAST(count(*) AS INT) AS size, CAST(min(n_nationkey) AS INT) AS first FROM nation GROUP BY 1")
def io05(spark, sf):
    r = A.store_ragged(spark.read.parquet(f"{sf}/nation.parquet").withColumn("k", F.col("n_nationkey")), "n_regionkey", "k", "n_nationkey")
    return r.select(F.col("n_regionkey").alias("region"), F.size("cells").alias("size"), F.element_at("cells", 1).alias("first"))


@query("io06_features", f"WITH {G.GRID3}, f AS (SELECT z, CAST(count(*) AS DOUBLE) AS cells, CAST(sum(n) AS DOUBLE) AS items FROM grid3 GROUP BY z) SELECT z, 'cells' AS name, cells AS value FROM f UNION ALL SELECT z, 'items', items FROM f")
def io06(spark, sf):
    wide = G.grid3(spark, sf).groupBy("z").agg(F.count("*").alias("cells"), F.sum("n").alias("items"))
    return A.named_features(wide, "z")


@query("io12_load_graph", "SELECT l_suppkey % 7 AS w, count(*) FILTER (l_orderkey % 2 = 0) AS n_ok, count(*) FILTER (l_orderkey % 2 = 1) AS n_bad FROM lineitem GROUP BY 1")
def io12(spark, sf):
    """Edges whose order is even have known ends; the others are reported."""
    items = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("a"), F.col("l_orderkey").alias("b"), (F.col("l_suppkey") % 7).alias("w"))
    vertices = items.where("a % 2 = 0").select(F.col("a").alias("node")).distinct()
    ok, bad = A.load_graph(vertices, items)
    return ok.groupBy("w").agg(F.count("*").alias("n_ok")).join(bad.groupBy("w").agg(F.count("*").alias("n_bad")), "w", "full").select("w", F.coalesce("n_ok", F.lit(0)).alias("n_ok"), F.coalesce("n_bad", F.lit(0)).alias("n_bad"))
