"""Races, pruning of links, straightest continuations, isotropy, resampling and programs in four dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import descent as Q
from ..operators import features as E
from ..operators import fixpoint as P
from ..operators import images as I
from ..operators import races as R
from ..operators import stencil as S
from ..operators.distance import distance, few_volumes
from ..sources import grids as G
from . import applications as W
from .descent_queries import GEN, _gen
from .extraction_queries import BRIGHT, NEAREST, SIDES, _clicks
from .fixpoint_queries import BD, BDIMS, BFG, FACE, FULL, _deep, _seeds
from .grid_queries import DIMS
from .registry import query
from .tables import cut, maybe_broadcast

DEPTHS = f"{G.SCANS}, {BRIGHT}, bg AS (SELECT vol_id, x, y, z FROM scans WHERE val <= 250), dep AS (SELECT a.vol_id, a.x, a.y, a.z, sqrt({NEAREST}) AS d FROM fg a JOIN bg b USING (vol_id) GROUP BY ALL)"


def _depths(spark, sf):
    v = G.scans(spark, sf, deal=few_volumes())
    return distance(v, "val <= 250", by_volume=True, only="val > 250").select(*S.KEY, F.sqrt("d").alias("d"))


@query("fx19_race", f"WITH RECURSIVE {G.BALLS}, {BFG}, {FACE}, {BD}, seed AS (SELECT n_nationkey * 7 % 24 AS x, n_nationkey * 11 % 24 AS y, n_nationkey * 5 % 24 AS z, CAST(min(n_nationkey) + 1 AS INT) AS label FROM nation GROUP BY ALL), w(x, y, z, d, arrival, label) USING KEY (x, y, z) AS (SELECT x, y, z, d, CAST(0 AS DOUBLE), label FROM dist JOIN seed USING (x, y, z) UNION SELECT x, y, z, d, m.a, m.l FROM (SELECT b.x, b.y, b.z, any_value(b.d) AS d, min(struct_pack(a := round(w.arrival + 2 / (sqrt(w.d) + sqrt(b.d)), 9), l := w.label)) AS m FROM w CROSS JOIN face JOIN dist b ON b.x = w.x + dx AND b.y = w.y + dy AND b.z = w.z + dz GROUP BY 1, 2, 3) o WHERE NOT EXISTS (SELECT 1 FROM recurring.w r WHERE r.x = o.x AND r.y = o.y AND r.z = o.z AND (r.arrival < m.a OR (r.arrival = m.a AND r.label <= m.l)))) SELECT x, y, z, label, arrival FROM w")
def fx19_race(spark, sf):
    """Seeds race over the faces, fast where the depth at both ends is great."""
    deep = _deep(spark, sf)
    step = F.lit(2) / (F.sqrt("from_") + F.sqrt("d"))
    return R.race(deep, _seeds(spark, sf), step, 0.5, S.offsets(3, "face")).select("x", "y", "z", "label", "arrival")


@query("fx19_constrained_growth", f"WITH RECURSIVE {DEPTHS}, {FACE}, {FULL}, home AS (SELECT dep.* FROM dep JOIN spot ON spot.vol_id = dep.vol_id AND k = 0 AND x = cx AND y = cy AND z = cz), peak AS (SELECT a.vol_id, a.x, a.y, a.z, any_value(a.d) AS d FROM dep a CROSS JOIN full26 LEFT JOIN dep b ON b.vol_id = a.vol_id AND b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY 1, 2, 3, 4 HAVING coalesce(any_value(a.d) >= max(b.d), true)), st AS (SELECT p.vol_id, p.x, p.y, p.z, p.d, CASE WHEN (p.x - h.x) * (p.x - h.x) + (p.y - h.y) * (p.y - h.y) + (p.z - h.z) * (p.z - h.z) < h.d * h.d THEN 1 ELSE 2 END AS label FROM peak p JOIN home h USING (vol_id) UNION ALL SELECT vol_id, x, y, z, d, 1 FROM home), w(vol_id, x, y, z, d, label, arrival) USING KEY (vol_id, x, y, z) AS (SELECT vol_id, x, y, z, max(d), min(label), 0 FROM st GROUP BY 1, 2, 3, 4 UNION SELECT b.vol_id, b.x, b.y, b.z, max(b.d), min(w.label), max(w.arrival) + 1 FROM w CROSS JOIN face JOIN dep b ON b.vol_id = w.vol_id AND b.x = w.x + dx AND b.y = w.y + dy AND b.z = w.z + dz WHERE w.d >= b.d AND NOT EXISTS (SELECT 1 FROM recurring.w r WHERE r.vol_id = b.vol_id AND r.x = b.x AND r.y = b.y AND r.z = b.z) GROUP BY 1, 2, 3, 4) SELECT vol_id, x, y, z, CAST(label AS INT) AS label, CAST(arrival AS DOUBLE) AS arrival FROM w")
def fx19_constrained(spark, sf):
    """Growth from the first spot of each supplier's volume against that from its other peaks."""
    return R.constrained_growth(_depths(spark, sf), _clicks(spark, sf)).select("vol_id", "x", "y", "z", "label", "arrival")


@query("fx13_simplified_links")
def fx13_simplified(spark, sf):
    """Links of the generations after all rounds of pruning; the rounds have no plain SQL form."""
    links = Q.descent_links(_gen(spark, sf), BDIMS)
    return Q.prune_links(Q.link_scores(links, BDIMS))


@query("s09_straightest", f"WITH RECURSIVE {GEN}, o AS (SELECT p.i, nb.n, min((2 * p.x - r.x - q.x) * (2 * p.x - r.x - q.x) + (2 * p.y - r.y - q.y) * (2 * p.y - r.y - q.y) + (2 * p.z - r.z - q.z) * (2 * p.z - r.z - q.z)) AS off FROM g p JOIN down ON down.b = p.i JOIN g r ON r.i = down.a JOIN nb ON nb.i = p.i AND nb.ng = nb.g JOIN g q ON q.i = nb.n GROUP BY 1, 2) SELECT CAST(i AS BIGINT) AS a, CAST(n AS BIGINT) AS b FROM (SELECT *, min(off) OVER (PARTITION BY i) AS least FROM o) WHERE off = least AND n > i")
def s09_straight(spark, sf):
    """Neighbours of one generation that go straightest on from an ascendant."""
    gen = _gen(spark, sf)
    return Q.straightest_in_generation(gen, Q.descent_links(gen, BDIMS, fill=False), BDIMS)


def _trig(k: int) -> str:
    return f"q + 2 * p * cos(phi + {k} * 2 * pi() / 3)"


TENSOR = f"gr AS (SELECT a.x, a.y, a.z, {', '.join(f'coalesce((SELECT d FROM dist b WHERE b.x = a.x + {int(c == 0)} AND b.y = a.y + {int(c == 1)} AND b.z = a.z + {int(c == 2)}), a.d) - coalesce((SELECT d FROM dist b WHERE b.x = a.x - {int(c == 0)} AND b.y = a.y - {int(c == 1)} AND b.z = a.z - {int(c == 2)}), a.d) AS g{c}' for c in range(3))} FROM dist a), ts AS (SELECT a.x, a.y, a.z, sum(b.g0 * b.g0) AS xx, sum(b.g0 * b.g1) AS xy, sum(b.g0 * b.g2) AS xz, sum(b.g1 * b.g1) AS yy, sum(b.g1 * b.g2) AS yz, sum(b.g2 * b.g2) AS zz FROM gr a JOIN gr b ON abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 AND abs(a.z - b.z) <= 2 GROUP BY 1, 2, 3), t1 AS (SELECT *, (xx + yy + zz) / 3 AS q FROM ts), t2 AS (SELECT *, sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM t1), t3 AS (SELECT *, CASE WHEN p > 0 THEN acos(greatest(least((((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (p * p * p)) / 2, 1.0), -1.0)) / 3 ELSE 0 END AS phi FROM t2), ev AS (SELECT x, y, z, list_sort([abs({_trig(0)}), abs({_trig(1)}), abs({_trig(2)})]) AS e FROM t3), sh AS (SELECT x, y, z, e[3] AS e3, exp(-(e[1] * e[1] + e[2] * e[2]) / 5000) AS w, exp(-(e[1] * e[1] / 5000 + (e[2] - e[3] / 2) * (e[2] - e[3] / 2) / (e[3] * e[3]))) AS v, exp(-((e[1] - e[3] / 2) * (e[1] - e[3] / 2) + (e[2] - e[3] / 2) * (e[2] - e[3] / 2)) / (e[3] * e[3])) AS n FROM ev)"


@query("fe11_isotropy", f"WITH {G.BALLS}, {BFG}, {BD}, {TENSOR} SELECT x, y, z, CASE WHEN e3 > 0 THEN round(w / (w + v + n), 5) END AS wall, CASE WHEN e3 > 0 THEN round(v / (w + v + n), 5) END AS vessel, CASE WHEN e3 > 0 THEN round(n / (w + v + n), 5) END AS nodule FROM sh")
def fe11(spark, sf):
    shares = E.isotropy_shares(_deep(spark, sf), "d")
    return shares.select("x", "y", "z", *(F.round(c, 5).alias(c) for c in ("wall", "vessel", "nodule")))


def _resample_query(name: str, sides: dict, spacing: dict, centre: dict, new_centre: dict):
    cells = " CROSS JOIN ".join(f"(SELECT CAST(range AS INT) AS n{a} FROM range({n}))" for a, n in sides.items())
    at = ", ".join(f"(n{a} - {new_centre[a]}) * {spacing[a]} + {centre[a]} AS p{a}" for a in sides)
    near = " AND ".join(f"abs(v.{a} - p{a}) < 1" for a in sides)
    weight = " * ".join(f"(1 - abs(v.{a} - p{a}))" for a in sides)
    sql = f"WITH {G.GRID3}, c AS (SELECT n{', n'.join(sides)}, {at} FROM {cells}) SELECT nx AS x, ny AS y, nz AS z, round(CAST(coalesce(sum({weight} * v.n), 0) AS DOUBLE), 6) AS n FROM c LEFT JOIN grid3 v ON {near} GROUP BY 1, 2, 3"

    @query(name, sql)
    def run(spark, sf):
        return I.resample(G.grid3(spark, sf), "n", sides, spacing, centre, new_centre).select("x", "y", "z", F.round("n", 6).alias("n"))

    return run


_MIDDLE = {a: n // 2 for a, n in zip("xyz", DIMS)}
_resample_query("w08_resample_shrink", {"x": 21, "y": 7, "z": 5}, {"x": 2.5, "y": 1.75, "z": 2.0}, _MIDDLE, {"x": 10, "y": 3, "z": 2})
_resample_query("w08_resample_stretch", {"x": 60, "y": 24, "z": 20}, {"x": 0.75, "y": 0.5, "z": 0.4}, {"x": 24.5, "y": 5, "z": 4.25}, {"x": 29.5, "y": 12, "z": 10})

FOUR = (*DIMS[:3], 8)


def _four(spark, sf):
    return cut(G.grid4(spark, sf), "grid4")


def _four_seeds(spark, sf):
    """A place for each supplier."""
    k = F.col("s_suppkey").cast("long")
    places = {a: ((k * m % n) + o).cast("int") for a, m, n, o in (("x", 7, 50, 1), ("y", 3, 11, 0), ("z", 5, 9, 0), ("t", 2, 7, 1))}
    return spark.read.parquet(f"{sf}/supplier.parquet").select(F.lit(0).cast("long").alias("vol_id"), *(c.alias(a) for a, c in places.items()), k.alias("click"))


@query("app_free_growth_check_4d")
def growth4(spark, sf):
    """Growth in four dimensions from a place of each supplier, and the part of its surface that validates."""
    seeds = _four_seeds(spark, sf).select(*S.KEY).distinct()
    return W.free_growth_check(_four(spark, sf), seeds, FOUR, ndim=4)["valid"].select("x", "y", "z", "t", "wave")


@query("app_straight_growth_4d")
def straight4(spark, sf):
    """Surface voxels in four dimensions that the peak of a supplier's place dominates."""
    seeds = _four_seeds(spark, sf).select(*S.KEY).distinct()
    return W.straight_growth(_four(spark, sf), seeds, FOUR, ndim=4)["selected"].select("x", "y", "z", "t", "peak")


@query("app_relocate_clicks")
def clicks3(spark, sf):
    """Where the first spots of the suppliers' volumes climb to in the depth."""
    v = G.scans(spark, sf, deal=few_volumes()).withColumn("mask", (F.col("val") > 250).cast("int"))
    clicks = _clicks(spark, sf).withColumn("click", F.col("vol_id"))
    return W.relocate_clicks(v, clicks, SIDES, by_volume=True).select("click", "x", "y", "z")


@query("app_relocate_clicks_4d")
def clicks4(spark, sf):
    """Where a place of each supplier climbs to in four dimensions."""
    return W.relocate_clicks(_four(spark, sf), _four_seeds(spark, sf), FOUR, box=(1, 1, 1, 1)).select("click", "x", "y", "z", "t")


NEAR_SURFACE = "w2(x, y, z, d, wave) USING KEY (x, y, z) AS (SELECT x, y, z, d, 1 FROM dist WHERE d <= 1.21 UNION SELECT DISTINCT b.x, b.y, b.z, b.d, w2.wave + 1 FROM w2 CROSS JOIN full26 JOIN dist b ON b.x = w2.x + dx AND b.y = w2.y + dy AND b.z = w2.z + dz WHERE NOT EXISTS (SELECT 1 FROM recurring.w2 r WHERE r.x = b.x AND r.y = b.y AND r.z = b.z)), l AS (SELECT a.x + 24 * (a.y + 24 * a.z) AS a, b.x + 24 * (b.y + 24 * b.z) AS b, b.d FROM w2 a CROSS JOIN full26 JOIN w2 b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz WHERE b.wave = a.wave + 1)"


def _near_surface(spark, sf):
    deep = cut(_deep(spark, sf), "depth")
    waves = P.waves(deep, deep.where("d <= 1.21"), S.offsets(3), first=1)
    return cut(waves.join(deep, S.KEY), "generations")


@query("fx11_steepest_links", f"WITH RECURSIVE {G.BALLS}, {BFG}, {FULL}, {BD}, {NEAR_SURFACE} SELECT CAST(a AS BIGINT) AS a, CAST(arg_min(b, struct_pack(v := -d, i := b)) AS BIGINT) AS b FROM l GROUP BY a")
def fx11_steepest(spark, sf):
    """Generations from the depth of 1 inwards; each voxel's deepest neighbour of the next one."""
    return Q.generation_links(_near_surface(spark, sf), BDIMS, steepest="d")


@query("fx11_all_links", f"WITH RECURSIVE {G.BALLS}, {BFG}, {FULL}, {BD}, {NEAR_SURFACE} SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM l")
def fx11_all(spark, sf):
    """All links to the next of those generations."""
    return Q.generation_links(_near_surface(spark, sf), BDIMS)


MAXIMA = "mx AS (SELECT i FROM nb GROUP BY i HAVING max(ng) <= any_value(g)), me AS (SELECT nb.i AS a, nb.n AS b FROM nb WHERE i IN (SELECT i FROM mx) AND n IN (SELECT i FROM mx)), mc(node, root) USING KEY (node) AS (SELECT i, i FROM mx UNION SELECT e.b, min(c.root) FROM mc c JOIN me e ON e.a = c.node JOIN recurring.mc r ON r.node = e.b WHERE c.root < r.root GROUP BY e.b), cl AS (SELECT node AS i, CAST(dense_rank() OVER (ORDER BY root) AS INT) AS label FROM mc)"


@query("fx30_filtered_cores", f"WITH RECURSIVE {GEN}, {MAXIMA}, sd AS (SELECT DISTINCT cl.label, nb.n, nb.ng < nb.g AS down FROM cl JOIN nb ON nb.i = cl.i WHERE nb.n NOT IN (SELECT i FROM mx)), ok AS (SELECT label FROM sd GROUP BY label HAVING count(*) FILTER (down) > 0.6 * count(*)) SELECT g.x, g.y, g.z, cl.label FROM cl JOIN g ON g.i = cl.i WHERE label IN (SELECT label FROM ok)")
def fx30_filtered(spark, sf):
    """Clusters of generation maxima, without those that less than 0.6 of their neighbours lead to."""
    gen = _gen(spark, sf)
    return Q.filter_cores(gen, Q.local_generation_maxima(gen), BDIMS, 0.6).select("x", "y", "z", "label")


@query("fx30_merged_cores", f"WITH RECURSIVE {GEN}, {MAXIMA}, h(node, label, hops) USING KEY (node) AS (SELECT i, label, 0 FROM cl UNION SELECT down.a, min(h.label), max(h.hops) + 1 FROM h JOIN down ON down.b = h.node WHERE NOT EXISTS (SELECT 1 FROM recurring.h r WHERE r.node = down.a) GROUP BY down.a), tc AS (SELECT p.label AS la, q.label AS lb, min(p.hops) + min(q.hops) AS gap FROM h p JOIN nb ON nb.i = p.node JOIN h q ON q.node = nb.n WHERE p.label < q.label GROUP BY 1, 2), bn AS (SELECT label, max(g.wave) AS born FROM cl JOIN g ON g.i = cl.i GROUP BY 1), mg AS (SELECT la, lb FROM tc JOIN bn p ON p.label = la JOIN bn q ON q.label = lb WHERE gap < p.born AND gap < q.born), mb AS (SELECT la AS a, lb AS b FROM mg UNION ALL SELECT lb, la FROM mg), rt(label, root) USING KEY (label) AS (SELECT label, label FROM bn UNION SELECT mb.b, min(c.root) FROM rt c JOIN mb ON mb.a = c.label JOIN recurring.rt r ON r.label = mb.b WHERE c.root < r.root GROUP BY mb.b) SELECT g.x, g.y, g.z, h.label, rt.root AS core, h.hops FROM h JOIN g ON g.i = h.node JOIN rt ON rt.label = h.label")
def fx30_merged(spark, sf):
    """Regions of generation maxima, and what they merge to."""
    gen = _gen(spark, sf)
    links = Q.descent_links(gen, BDIMS, fill=False)
    return Q.merge_cores(gen, links, Q.local_generation_maxima(gen), BDIMS).select("x", "y", "z", "label", "core", "hops")


@query("fe01_size_vector")
def fe01_vector(spark, sf):
    """Seven sizes of the foreground of each supplier's volume."""
    fg = G.scans(spark, sf).where("val > 250").select(*S.KEY)
    f = E.size_vector(fg)
    return f.select("vol_id", *(F.round(c, 5).alias(c) for c in f.columns if c != "vol_id"))


@query("fe10_fitness")
def fe10(spark, sf):
    """Thirteen scores of the foreground of each supplier's volume."""
    f = E.fitness_vector(cut(_depths(spark, sf), "depth"))
    return f.select("vol_id", "voxels", *(F.round(c, 5).alias(c) for c in f.columns if c not in ("vol_id", "voxels")))


@query("s04_geodesic_seeds", f"WITH {DEPTHS}, {FULL}, sp AS (SELECT a.vol_id, a.x, a.y, a.z, count(*) FILTER (b.d > 0 AND b.d < a.d) / 26.0 AS sp FROM dep a CROSS JOIN full26 LEFT JOIN dep b ON b.vol_id = a.vol_id AND b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY 1, 2, 3, 4), r AS (SELECT sp.* FROM sp JOIN spot ON spot.vol_id = sp.vol_id AND k = 0 AND (x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz) <= 2) SELECT vol_id, x, y, z, round(sp, 6) AS sp FROM r WHERE sp > 0.95 * greatest((SELECT max(q.sp) FROM r q WHERE q.vol_id = r.vol_id), 0)")
def s04_geodesic(spark, sf):
    """Voxels within a path of 1.5 of the first spot whose sphericity is more than 0.95 of the best there."""
    clicks = _clicks(spark, sf)
    home = clicks.select("vol_id", *(F.col(a).alias(f"c{a}") for a in "xyz"))
    about = " AND ".join(f"abs({a} - c{a}) <= 2" for a in "xyz")  # a path of 1.5 is one step, and a window goes one further
    deep = cut(_depths(spark, sf).join(maybe_broadcast(home), "vol_id").where(about).select(*S.KEY, "d"), "depth")
    region = P.geodesic(deep, clicks, S.offsets(3), 1.5).select(*S.KEY)
    sp = cut(E.sphericity(deep, "d").join(region, S.KEY), "region-sphericity")
    best = sp.groupBy("vol_id").agg(F.max("sp").alias("best"))
    return sp.join(best, "vol_id").where("sp > 0.95 * best").select("vol_id", "x", "y", "z", F.round("sp", 6).alias("sp"))
