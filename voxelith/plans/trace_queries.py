"""Directed traces, core particles, separation of branches, and descriptors of segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cores as C
from ..operators import descent as Q
from ..operators import descriptors as D
from ..operators import diffusion as R
from ..operators import fixpoint as P
from ..operators import graphs as H
from ..operators import separation as B
from ..operators import stencil as S
from ..operators import traces as T
from ..sources import arrays as A
from ..sources import grids as G
from .descent_queries import GEN, _gen
from .field_queries import C0, _c0, _level
from .fixpoint_queries import BD, BDIMS, BFG, SEEDS, UP, _balls, _deep, _seeds
from .grid_queries import FACE, FULL
from .registry import query

IDX = "x + 24 * (y + 24 * z)"
NEAR6 = " ".join(f"LEFT JOIN dist {n} ON {n}.x = a.x {x} AND {n}.y = a.y {y} AND {n}.z = a.z {z}" for n, x, y, z in (("xm", "- 1", "", ""), ("xp", "+ 1", "", ""), ("ym", "", "- 1", ""), ("yp", "", "+ 1", ""), ("zm", "", "", "- 1"), ("zp", "", "", "+ 1")))
SLOPE = "slope AS (SELECT a.x, a.y, a.z, a.d, " + ", ".join(f"CASE WHEN a.{c} = 0 THEN a.d ELSE coalesce({c}m.d, 0) END - CASE WHEN a.{c} = 23 THEN a.d ELSE coalesce({c}p.d, 0) END AS g{c}" for c in "xyz") + f" FROM dist a {NEAR6})"
LSEED = "seed AS (SELECT n_nationkey * 7 % 24 AS x, n_nationkey * 11 % 24 AS y, n_nationkey * 5 % 24 AS z, CAST(n_nationkey + 1 AS INT) AS label FROM nation)"
WAY = "((b.x - w.sx) * b.gx + (b.y - w.sy) * b.gy + (b.z - w.sz) * b.gz) / nullif(sqrt(CAST((b.x - w.sx) * (b.x - w.sx) + (b.y - w.sy) * (b.y - w.sy) + (b.z - w.sz) * (b.z - w.sz) AS DOUBLE)), 0) * sqrt(b.gx * b.gx + b.gy * b.gy + b.gz * b.gz)"


@query("fx17_angle_growth", f"WITH RECURSIVE {G.BALLS}, {BFG}, {LSEED}, {FULL}, {BD}, {SLOPE}, w(label, x, y, z, d, sx, sy, sz, wave) USING KEY (label, x, y, z) AS (SELECT label, x, y, z, d, x, y, z, 0 FROM slope JOIN seed USING (x, y, z) UNION SELECT DISTINCT w.label, b.x, b.y, b.z, b.d, w.sx, w.sy, w.sz, w.wave + 1 FROM w CROSS JOIN full26 JOIN slope b ON b.x = w.x + dx AND b.y = w.y + dy AND b.z = w.z + dz WHERE b.d <= w.d AND {WAY} > {T.ANGLE!r} AND NOT EXISTS (SELECT 1 FROM recurring.w r WHERE r.label = w.label AND r.x = b.x AND r.y = b.y AND r.z = b.z)) SELECT label, x, y, z, wave FROM w")
def fx17(spark, sf):
    """Growth of every nation's seed away from it, downhill on the squared distance."""
    return T.angle_growth(P.cut(_deep(spark, sf), "depth"), _seeds(spark, sf, 25), dims=BDIMS).select("label", "x", "y", "z", "wave")


STEEP = "low AS (SELECT a.x, a.y, a.z, any_value(a.d) AS d, min(b.d) AS m FROM dist a CROSS JOIN full26 JOIN dist b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY 1, 2, 3 HAVING count(*) = 26 AND min(b.d) <= any_value(a.d)), steep AS (SELECT a.x AS ax, a.y AS ay, a.z AS az, b.x, b.y, b.z FROM low a CROSS JOIN full26 JOIN dist b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz WHERE b.d = a.m)"


@query("fx18_sampled_trace", f"WITH RECURSIVE {G.BALLS}, {BFG}, {SEEDS}, {FULL}, {BD}, {STEEP}, st AS (SELECT DISTINCT b.x, b.y, b.z FROM dist a JOIN seed USING (x, y, z) CROSS JOIN full26 JOIN dist b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz WHERE b.d < a.d), w(x, y, z) AS (SELECT x, y, z FROM st UNION SELECT s.x, s.y, s.z FROM w JOIN steep s ON s.ax = w.x AND s.ay = w.y AND s.az = w.z) SELECT x, y, z FROM w")
def fx18(spark, sf):
    """Steepest descents from the lower neighbours of four seeds."""
    return T.sampled_trace(P.cut(_deep(spark, sf), "depth"), _seeds(spark, sf)).select("x", "y", "z")


@query("fx18_level_fill")
def fx18l(spark, sf):
    """Layers by whole squared distance, from all seeds."""
    return T.level_fill(P.cut(_deep(spark, sf), "depth"), _seeds(spark, sf, 25)).select("x", "y", "z", "level")


@query("fx22_trace_to_peaks")
def fx22(spark, sf):
    """The nation whose seed steepest ascent of the distance reaches; -1 for other peaks."""
    peaks = _seeds(spark, sf, 25).withColumnRenamed("label", "peak")
    return T.trace_to_peaks(P.cut(_deep(spark, sf), "depth"), peaks).select("x", "y", "z", "peak")


@query("gr14_strong_cores")
def gr14(spark, sf):
    """Strong cores of the descent from the surface."""
    gen = _gen(spark, sf)
    rows = gen.select(*S.KEY, S.linear_index(BDIMS).alias("node"))
    outer = P.cut(S.surface(_balls(spark, sf), 3), "surface")
    links = Q.descent_links(gen, BDIMS)
    edges = P.voxel_edges(outer, S.offsets(3), BDIMS).select("a", "b")
    nodes = rows.join(outer.withColumn("on_surface", F.lit(True)), S.KEY, "left").select("node", F.coalesce("on_surface", F.lit(False)).alias("on_surface"))
    return C.strong_cores(nodes, links, edges).select("node")


@query("fx27_core_exits")
def fx27(spark, sf):
    """Links that voxels without a descendant get within their generation."""
    gen = _gen(spark, sf)
    links = P.cut(Q.descent_links(gen, BDIMS, fill=False), "links")
    rows = gen.select(*S.KEY, "wave", S.linear_index(BDIMS).alias("i"))
    free = rows.join(links.select(F.col("a").alias("i")).distinct(), "i", "left_anti")
    return C.assign_exits(free, rows, links)[0]


@query("hp07_exposure_width", f"WITH RECURSIVE {G.BALLS}, {BFG}, {FACE}, {BD}, core AS (SELECT x, y, z, CAST(x // 6 AS INT) AS label FROM dist WHERE d >= 4), w(x, y, z, layer) USING KEY (x, y, z) AS (SELECT a.x, a.y, a.z, 1 FROM (SELECT a.x, a.y, a.z FROM bfg a CROSS JOIN face LEFT JOIN bfg b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY ALL HAVING count(b.x) < 6) a ANTI JOIN core USING (x, y, z) UNION SELECT DISTINCT b.x, b.y, b.z, w.layer + 1 FROM w CROSS JOIN face JOIN bfg b ON b.x = w.x + dx AND b.y = w.y + dy AND b.z = w.z + dz WHERE NOT EXISTS (SELECT 1 FROM core c WHERE c.x = b.x AND c.y = b.y AND c.z = b.z) AND NOT EXISTS (SELECT 1 FROM recurring.w r WHERE r.x = b.x AND r.y = b.y AND r.z = b.z)) SELECT c.label, min(CASE WHEN b.x IS NULL THEN 1 ELSE w.layer END) AS width FROM core c CROSS JOIN face LEFT JOIN bfg b ON b.x = c.x + dx AND b.y = c.y + dy AND b.z = c.z + dz LEFT JOIN w ON w.x = b.x AND w.y = b.y AND w.z = b.z GROUP BY c.label HAVING min(CASE WHEN b.x IS NULL THEN 1 ELSE w.layer END) IS NOT NULL")
def hp07(spark, sf):
    """The erosion that exposes the deep voxels of each range of x."""
    deep = P.cut(_deep(spark, sf), "depth")
    cores = deep.where("d >= 4").withColumn("label", F.floor(F.col("x") / 6).cast("int"))
    return C.exposure_width(cores, deep)


@query("hp08_one_way_links", f"WITH RECURSIVE {GEN} SELECT count(*) - count(DISTINCT a) AS violations FROM (SELECT DISTINCT a, b FROM down)")
def hp08(spark, sf):
    """Descents left by pruning to one for each voxel, against all ascents."""
    links = P.cut(Q.descent_links(_gen(spark, sf), BDIMS, fill=False).select("a", "b"), "links")
    return C.asymmetric_links(Q.pruned(links), links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _branch_tree(spark, sf):
    """Shortest paths through the voxels from the second nation's seed, shallow ones being slow, and the path to the farthest."""
    deep = P.cut(_deep(spark, sf), "depth")
    place = P.cut(deep.select(S.linear_index(BDIMS).alias("node"), *S.AXES, F.sqrt("d").alias("depth")), "places")
    links = P.voxel_edges(deep, S.offsets(3, "face"), BDIMS).select("a", "b")
    slow = lambda c: place.select(F.col("node").alias(c), F.col("depth").alias(f"d{c}"))
    links = links.join(slow("a"), "a").join(slow("b"), "b").select("a", "b", F.round(1.0 / F.least("da", "db"), 6).alias("w"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    source = 7 + 24 * (11 + 24 * 5)
    tree = P.cut(H.shortest_paths(both, source), "voxel-tree")
    sink = tree.orderBy(F.desc("dist"), "node").first()["node"]
    main = P.cut(H.path_to(tree, sink).select("node"), "main-path")
    up = tree.select("node", "dist").withColumnsRenamed({"node": "pred", "dist": "before"})
    full = tree.join(place, "node").join(up, "pred", "left").select("node", "pred", *S.AXES, "depth", F.coalesce(F.col("dist") - F.col("before"), F.lit(0.0)).alias("w"))
    return P.cut(full, "branch-tree"), main, source, sink


@query("gr12_branch_separation")
def gr12(spark, sf):
    """Four measures of each branch off the longest shortest path."""
    return B.separation(*_branch_tree(spark, sf))


@query("gr12_branch_cuts")
def gr12c(spark, sf):
    """Edges that the three cutting rules take out, by rule."""
    tree, main, _, _ = _branch_tree(spark, sf)
    gen = _gen(spark, sf)
    outer = S.surface(_balls(spark, sf), 3).select(S.linear_index(BDIMS).alias("node"), *S.AXES)
    rules = {"distance": B.cut_by_distance(tree, main, 3.0), "overlap": B.cut_by_overlap(tree, main, 0.1, 1.5), "boxes": B.cut_by_boxes(tree, main, Q.descent_links(gen, BDIMS), outer, 0.2)}
    out = None
    for name, cuts in rules.items():
        rows = cuts.select(F.lit(name).alias("rule"), "node")
        out = rows if out is None else out.unionByName(rows)
    return out


KIND = "CASE key % 3 WHEN 0 THEN 1.2 WHEN 1 THEN 1.1 ELSE 1.0 END"


@query("sc07_foreground_score", f"WITH {G.SERIES}, s AS (SELECT key, v[12] / 100.0 * {KIND} AS score FROM series) SELECT a.key, round(a.score, 6) AS score, CASE WHEN a.score > b.score THEN 1 WHEN a.score < b.score THEN -1 WHEN a.score > 0 THEN 1 ELSE 0 END AS better FROM s a JOIN s b ON b.key = a.key + 1")
def sc07(spark, sf):
    """Noon values as scores of three kinds, each compared with the next user's."""
    kind = F.when(F.col("key") % 3 == 0, "solid").when(F.col("key") % 3 == 1, "nonsolid").otherwise("partsolid")
    s = G.series(spark, sf).select("key", D.foreground_score(F.transform(F.slice("v", 12, 1), lambda x: x / 100.0), kind).alias("score"))
    return s.join(s.select((F.col("key") - 1).alias("key"), F.col("score").alias("other")), "key").select("key", F.round("score", 6).alias("score"), D.compare_scores(F.col("score"), F.col("other")).alias("better"))


def _segments(spark, sf):
    """Segment, free trace and depth map: the balls to the left of two planes, and distances from the background."""
    deep = P.cut(_deep(spark, sf).withColumn("d", F.sqrt("d")), "depth")
    return deep.where("x <= 11").select(*S.KEY), deep.where("x <= 15").select(*S.KEY), deep


SEG = f"{G.BALLS}, {BFG}, {FACE}, {BD}, deep AS (SELECT x, y, z, sqrt(d) AS d FROM dist), seg AS (SELECT * FROM deep WHERE x <= 11), free AS (SELECT * FROM deep WHERE x <= 15)"
WIN = "k5 AS (SELECT CAST(range AS INT) - 2 AS i FROM range(5)), win AS (SELECT a.i AS dx, b.i AS dy, c.i AS dz FROM k5 a, k5 b, k5 c WHERE a.i <> 0 OR b.i <> 0 OR c.i <> 0)"


@query("fe03_geometry", f"WITH {SEG}, {WIN}, m AS (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM seg), rim AS (SELECT a.x - cx AS rx, a.y - cy AS ry, a.z - cz AS rz, sum(CASE WHEN b.x IS NULL THEN dx ELSE 0 END) AS sx, sum(CASE WHEN b.x IS NULL THEN dy ELSE 0 END) AS sy, sum(CASE WHEN b.x IS NULL THEN dz ELSE 0 END) AS sz FROM seg a CROSS JOIN m CROSS JOIN face LEFT JOIN seg b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY a.x, a.y, a.z, cx, cy, cz HAVING count(b.x) < 6), r AS (SELECT sqrt(rx * rx + ry * ry + rz * rz) AS r, (rx * sx + ry * sy + rz * sz) / nullif(sqrt(rx * rx + ry * ry + rz * rz) * sqrt(CAST(sx * sx + sy * sy + sz * sz AS DOUBLE)), 0) AS k FROM rim), e AS (SELECT 1 - sqrt(var_pop(r)) / avg(r) AS spread, avg(k) - var_pop(k) AS rough FROM r), sp AS (SELECT coalesce(count(b.x) / 124.0, 0) AS s FROM (SELECT * FROM deep WHERE x = 7 AND y = 11 AND z = 5) a CROSS JOIN win LEFT JOIN deep b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz AND b.d < a.d) SELECT round(s, 6) AS sphericity, round(s * s * s, 6) AS sphericity_prod, round(spread, 6) AS radii_spread, round(rough, 6) AS roughness, round(spread * rough, 6) AS spread_roughness FROM e, sp")
def fe03(spark, sf):
    """Geometry of the segment around the second nation's seed; one depth map serves for all three."""
    seg, _, deep = _segments(spark, sf)
    f = D.geometry_features(seg, deep, deep, deep, _seeds(spark, sf, 2).where("label = 2"))
    return f.select(F.col("sphericity_d").alias("sphericity"), *("sphericity_prod", "radii_spread", "roughness", "spread_roughness")).select(*(F.round(c, 6).alias(c) for c in ("sphericity", "sphericity_prod", "radii_spread", "roughness", "spread_roughness")))


@query("fe04_geometry_new")
def fe04(spark, sf):
    """Distances apart, sphericities and depth distributions of the segment."""
    seg, free, deep = _segments(spark, sf)
    f = D.geometry_features_new(seg, free, deep.where("x <= 11"), deep.where("x <= 15"), deep, _seeds(spark, sf, 2).where("label = 2"))
    return f.select(*(F.round(c, 6).alias(c) for c in ("apart_ratio", "max_sphericity", "sphericity_ratio", "disparity")))


@query("fe05_joint_boundary", f"WITH {SEG}, j AS (SELECT any_value(a.d) AS d, count(*) AS n FROM (SELECT * FROM free WHERE x > 11) a CROSS JOIN face JOIN seg b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY a.x, a.y, a.z), dj AS (SELECT coalesce(max(d), 0) AS dj, coalesce(sum(n), 0) AS nj FROM j), db AS (SELECT max(d) AS db FROM seg), ns AS (SELECT count(*) AS ns FROM (SELECT a.x FROM seg a CROSS JOIN face LEFT JOIN seg b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY a.x, a.y, a.z HAVING count(b.x) < 6)) SELECT round(exp(-dj / (db * db)), 6) AS fit_1, round(1 / (1 + exp(dj - db)), 6) AS fit_2, round(1 / (1 + exp(dj * dj - db * db)), 6) AS fit_3, round(1 - nj / ns, 6) AS fit_4 FROM dj, db, ns")
def fe05(spark, sf):
    seg, free, deep = _segments(spark, sf)
    f = D.joint_boundary_features(seg, free, deep)
    return f.select(*(F.round(c, 6).alias(c) for c in ("fit_1", "fit_2", "fit_3", "fit_4")))


@query("fe08_correlation_names", "SELECT * FROM (VALUES ('VectorAngleDepth', 'CorrelationDepth')) t(first, second)")
def fe08(spark, sf):
    return spark.range(1).select(*(F.lit(n).alias(k) for k, n in zip(("first", "second"), D.correlation_feature_names("Depth"))))


@query("fe09_texture", "SELECT 'Texture' || CAST(range AS VARCHAR) AS name, CAST(0 AS DOUBLE) AS value FROM range(1, 7)")
def fe09(spark, sf):
    return D.texture_features(_balls(spark, sf)).select("name", "value")


@query("io04_store_scalar", "SELECT CAST(count(*) AS INT) AS value FROM nation")
def io04(spark, sf):
    return A.store_scalar(spark, spark.read.parquet(f"{sf}/nation.parquet").count(), "int32")


PART = "p AS (SELECT n_nationkey AS k, n_nationkey * 2 AS x, n_nationkey % 13 AS y, n_nationkey % 10 AS z FROM nation)"


@query("g05_particle_values", f"WITH {G.GRID3}, {PART} SELECT k, coalesce(g.n, -1) AS n FROM p LEFT JOIN grid3 g USING (x, y, z)")
def g05(spark, sf):
    """Counts at 25 places, some outside the volume."""
    k = F.col("n_nationkey")
    p = spark.read.parquet(f"{sf}/nation.parquet").select(k.alias("k"), F.lit(0).cast("long").alias("vol_id"), (k * 2).alias("x"), (k % 13).alias("y"), (k % 10).alias("z"))
    return S.particle_values(G.grid3(spark, sf), p, 3, "n", -1).select("k", "n")


@query("g05_set_particle_values", f"WITH {G.GRID3}, {PART} SELECT g.x, g.y, g.z, coalesce(p.k, -g.n) AS n FROM grid3 g LEFT JOIN p USING (x, y, z)")
def g05s(spark, sf):
    k = F.col("n_nationkey")
    p = spark.read.parquet(f"{sf}/nation.parquet").select(F.lit(0).cast("long").alias("vol_id"), (k * 2).alias("x"), (k % 13).alias("y"), (k % 10).alias("z"), k.cast("long").alias("n"))
    return S.set_particle_values(G.grid3(spark, sf).withColumn("n", -F.col("n")), p, 3, "n").select("x", "y", "z", "n")


MIX = "least(greatest(a.c + 0.7 * (a.c * (a.c - (a.c * a.c + (1 - a.c) * (1 - a.c)))) + 0.3 * ({near} - 6 * a.c) / 6, 0.0), 1.0)"


@query("p02_mixed_diffusion", f"WITH {G.GRID3}, {C0}, {_level('c0', 'c1', MIX)}, {_level('c1', 'c2', MIX)} SELECT x, y, z, round(c, 5) AS c FROM c2")
def p02(spark, sf):
    """Reaction and diffusion in shares of 0.7 and 0.3, whole steps."""
    return R.react_diffuse(_c0(spark, sf), "c", rounds=2, rate=1.0, mix=0.7).select("x", "y", "z", F.round("c", 5).alias("c"))


FIX = "CASE WHEN a.z = 0 THEN a.c ELSE least(greatest(a.c + 0.25 * (a.c * (a.c - (a.c * a.c + (1 - a.c) * (1 - a.c))) + 0.125 * ({near} - 6 * a.c)), 0.0), 1.0) END"


@query("p02_fixed_voxels", f"WITH {G.GRID3}, {C0}, {_level('c0', 'c1', FIX)}, {_level('c1', 'c2', FIX)} SELECT x, y, z, round(c, 5) AS c FROM c2")
def p02f(spark, sf):
    """The first slice keeps its values."""
    return R.react_diffuse(_c0(spark, sf).withColumn("keep", (F.col("z") == 0).cast("int")), "c", rounds=2, fixed="keep").select("x", "y", "z", F.round("c", 5).alias("c"))


CORE28 = "core AS (SELECT x, y, z, CAST(x // 6 AS INT) AS label FROM dist WHERE d >= 4), w(x, y, z, layer) USING KEY (x, y, z) AS (SELECT a.x, a.y, a.z, 1 FROM (SELECT a.x, a.y, a.z FROM bfg a CROSS JOIN face LEFT JOIN bfg b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY ALL HAVING count(b.x) < 6) a ANTI JOIN core USING (x, y, z) UNION SELECT DISTINCT b.x, b.y, b.z, w.layer + 1 FROM w CROSS JOIN face JOIN bfg b ON b.x = w.x + dx AND b.y = w.y + dy AND b.z = w.z + dz WHERE NOT EXISTS (SELECT 1 FROM core c WHERE c.x = b.x AND c.y = b.y AND c.z = b.z) AND NOT EXISTS (SELECT 1 FROM recurring.w r WHERE r.x = b.x AND r.y = b.y AND r.z = b.z))"


@query("fx28_protected_erosion", f"WITH RECURSIVE {G.BALLS}, {BFG}, {FACE}, {BD}, {CORE28} SELECT bfg.x, bfg.y, bfg.z, layer FROM bfg LEFT JOIN w USING (x, y, z)")
def fx28(spark, sf):
    """Layers of erosion that leaves the deep voxels."""
    deep = P.cut(_deep(spark, sf), "depth")
    return Q.erode_until_apart(deep, deep.where("d >= 4")).select("x", "y", "z", "layer")


@query("fx28_separation_rounds")
def fx28r(spark, sf):
    """The erosion that parts the deep voxels of two ranges of x."""
    deep = P.cut(_deep(spark, sf), "depth")
    cores = deep.where("d >= 9").withColumn("label", F.floor(F.col("x") / 4).cast("int"))
    return Q.separation_rounds(Q.erode_until_apart(deep, cores), cores, BDIMS)


@query("g12_particle_kinds", f"WITH RECURSIVE {GEN}, dn AS (SELECT a AS i, count(DISTINCT b) AS k FROM down GROUP BY a), u AS (SELECT b AS i, count(DISTINCT a) AS k FROM down GROUP BY b) SELECT w.x, w.y, w.z, s.x IS NOT NULL AS surface, coalesce(u.k, 0) >= 4 OR dn.k IS NULL AS medial, s.x IS NOT NULL AND coalesce(dn.k, 0) >= 2 AS inflection FROM w LEFT JOIN s USING (x, y, z) LEFT JOIN dn ON dn.i = {IDX.replace('x', 'w.x').replace('y', 'w.y').replace('z', 'w.z')} LEFT JOIN u ON u.i = {IDX.replace('x', 'w.x').replace('y', 'w.y').replace('z', 'w.z')}")
def g12k(spark, sf):
    gen = _gen(spark, sf)
    return Q.particle_kinds(gen, Q.descent_links(gen, BDIMS, fill=False), BDIMS).select("x", "y", "z", "surface", "medial", "inflection")


@query("fx26_dominance", f"WITH RECURSIVE {G.BALLS}, {BFG}, {FULL}, {FACE}, {BD}, {UP}, walk(i, p, k) AS (SELECT i, p, 0 FROM up UNION ALL SELECT walk.i, up.p, k + 1 FROM walk JOIN up ON up.i = walk.p WHERE up.p <> walk.p), ends AS (SELECT i, arg_max(p, k) AS peak FROM walk GROUP BY i), s AS (SELECT a.x, a.y, a.z FROM bfg a CROSS JOIN face LEFT JOIN bfg b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY ALL HAVING count(b.x) < 6), c AS (SELECT s.x, s.y, s.z, peak, count(*) AS n FROM s CROSS JOIN full26 JOIN bfg b ON b.x = s.x + dx AND b.y = s.y + dy AND b.z = s.z + dz JOIN ends ON i = b.x + 24 * (b.y + 24 * b.z) GROUP BY ALL), r AS (SELECT *, row_number() OVER v AS k, lead(n) OVER v AS second FROM c WINDOW v AS (PARTITION BY x, y, z ORDER BY n DESC, peak)) SELECT x, y, z, CAST(CASE WHEN n > 2 * coalesce(second, 0) THEN peak ELSE -1 END AS BIGINT) AS label FROM r WHERE k = 1")
def fx26d(spark, sf):
    """The peak that twice as many neighbours of a surface voxel climb to as to the next; -1 where none does."""
    deep = P.cut(_deep(spark, sf), "depth")
    peaks = P.climb(deep, S.offsets(3), "d", BDIMS).withColumnRenamed("peak", "label")
    return Q.dominant_labels(Q.neighbour_labels(S.surface(deep, 3), peaks), S.KEY, 2.0).select("x", "y", "z", "label")
