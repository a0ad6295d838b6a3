"""Small inputs with results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from voxelith.operators import fixpoint as P
from voxelith.operators import graphs as R
from voxelith.operators import images, segments
from voxelith.operators import statistics as A
from voxelith.operators import stencil as S
from voxelith.operators.distance import distance
from voxelith.operators.series import dtw


def volume(spark, rows):
    """A volume from rows of 0 and 1: y down, x right."""
    cells = [(0, x, y, 0, 0, int(v)) for y, row in enumerate(rows) for x, v in enumerate(row)]
    return spark.createDataFrame(cells, "vol_id long, x int, y int, z int, t int, mask int")


def fg(vox):
    return vox.where("mask = 1").select(*S.KEY)


def test_block(spark):
    vox = volume(spark, ["00000", "01110", "01110", "01110", "00000"])
    assert S.surface(fg(vox), 2).count() == 8
    d = {(r.x, r.y): r.d for r in distance(vox, "mask = 0").collect()}
    assert d[2, 2] == 4 and d[1, 1] == 1 and d[0, 0] == 0
    w = {(r.x, r.y): r.wave for r in P.waves(fg(vox), S.surface(fg(vox), 2), S.offsets(2, "face"), first=1).collect()}
    assert w[2, 2] == 2 and w[1, 2] == 1


def test_row_components(spark):
    lab = P.components(fg(volume(spark, ["10110"])), S.offsets(2, "face"), (5, 1, 1, 1))
    assert sorted((r.x, r.label) for r in lab.collect()) == [(0, 1), (2, 2), (3, 2)]
    kept = P.keep_sizes(lab, 2).collect()
    assert sorted((r.x, r.label, r.size) for r in kept) == [(2, 1, 2), (3, 1, 2)]


def test_diagonal(spark):
    vox = fg(volume(spark, ["10", "01"]))
    assert P.components(vox, S.offsets(2, "face"), (2, 2, 1, 1)).select("label").distinct().count() == 2
    assert P.components(vox, S.offsets(2, "full"), (2, 2, 1, 1)).select("label").distinct().count() == 1


def test_two_volumes_do_not_touch(spark):
    a = volume(spark, ["11"])
    both = a.unionByName(a.withColumn("vol_id", F.lit(1).cast("long")))
    lab = P.components(fg(both), S.offsets(2, "face"), (2, 1, 1, 1))
    assert {(r.vol_id, r.label) for r in lab.collect()} == {(0, 1), (1, 1)}


@pytest.mark.parametrize("least, filled", [(1, 0), (2, 1)])
def test_hole(spark, least, filled):
    vox = volume(spark, ["11111", "11111", "11011", "11111", "11111"])
    got = P.fill_holes(vox, least, (5, 5, 1, 1)).where("x = 2 AND y = 2").first()
    assert got.filled == filled


def test_gap_is_not_a_hole(spark):
    vox = volume(spark, ["11011", "11011", "11011", "11111", "11111"])
    assert P.fill_holes(vox, 99, (5, 5, 1, 1)).agg(F.sum("filled")).first()[0] == 22


def test_dtw(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 3.0]), ([1.0, 2.0], [1.0, 2.0]), ([], []), ([], [1.0])], "x array<double>, y array<double>")
    assert [r[0] for r in df.select(dtw("x", "y")).collect()] == [1.0, 0.0, 0.0, math.inf]


def test_distribution_distances(spark):
    def dist(*n):
        return A.with_pdf_cdf(spark.createDataFrame([(i, c) for i, c in enumerate(n) if c], "bin int, n long"))

    same = A.jensen_shannon(dist(1, 1), dist(1, 1)).first()
    apart = A.jensen_shannon(dist(1, 0), dist(0, 1)).first()
    assert abs(same.jsd) < 1e-12 and abs(same.similarity - math.log(2)) < 1e-12
    assert abs(apart.jsd - math.log(2)) < 1e-12
    assert A.kolmogorov_smirnov(dist(1, 1), dist(1, 1)).first().ksd == 0
    assert A.kolmogorov_smirnov(dist(1, 0), dist(0, 1)).first().ksd == 1


def test_histogram_drops_the_top(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "v double")
    assert A.histogram(df, "v", 0.0, 10.0, 10).agg(F.sum("n")).first()[0] == 10


def test_triangle(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (1, 3, 4.0)], "a long, b long, w double")
    assert R.spanning_forest(e).agg(F.sum("w")).first()[0] == 3
    d = {r.node: (r.dist, r.pred) for r in R.shortest_paths(e, 1).collect()}
    assert d[3] == (3.0, 2)
    assert [r.node for r in R.path_to(R.shortest_paths(e, 1), 3).orderBy("hops").collect()] == [3, 2, 1]


def test_border_conventions(spark):
    cells = [(0, x, y, z, 0) for x in range(3) for y in range(3) for z in range(3)]
    cube = spark.createDataFrame(cells, "vol_id long, x int, y int, z int, t int")
    assert S.surface(cube, 3).count() == 26
    assert S.surface(cube, 3, "full", border=1, dims=(3, 3, 3, 1)).count() == 0


def test_strict_growth(spark):
    row = spark.createDataFrame([(0, x, 0, 0, 0, float(d)) for x, d in enumerate([1, 2, 3, 2, 1])], "vol_id long, x int, y int, z int, t int, d double")
    got = P.waves(row, row.where("d = 3"), S.offsets(1, "face"), lambda a, b: b < a, "d", first=1)
    assert [r.wave for r in got.orderBy("x").collect()] == [3, 2, 1, 2, 3]


def test_empty_volume(spark):
    none = volume(spark, ["00"])
    assert P.components(fg(none), S.offsets(2, "face"), (2, 1, 1, 1)).count() == 0
    assert P.waves(fg(none), fg(none), S.offsets(2, "face")).count() == 0
    assert {r.d for r in distance(none, "mask = 1").collect()} == {None}


def test_strong_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (5, 5)], "a long, b long")
    n = spark.createDataFrame([(k,) for k in range(1, 7)], "node long")
    assert {r.node: r.scc for r in R.strong_components(n, e).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6}


def test_reaction_alone(spark):
    from voxelith.operators.diffusion import react_diffuse

    one = spark.createDataFrame([(0, 0, 0, 0, 0, 0.8)], "vol_id long, x int, y int, z int, t int, c double")
    for order in ("jacobi", "raster"):
        assert abs(react_diffuse(one, "c", 1, speed=(0, 0, 0, 0), order=order).first().c - 0.824) < 1e-12


def test_raster_order_uses_new_values(spark):
    from voxelith.operators.diffusion import react_diffuse

    row = spark.createDataFrame([(0, x, 0, 0, 0, float(x == 0)) for x in range(3)], "vol_id long, x int, y int, z int, t int, c double")
    kw = dict(rounds=1, k=(0, 0, 0, 0), speed=(0.5, 0, 0, 0), rate=1.0, ndim=1)
    synchronous = [r.c for r in react_diffuse(row, "c", **kw).orderBy("x").collect()]
    in_place = [r.c for r in react_diffuse(row, "c", order="raster", **kw).orderBy("x").collect()]
    assert synchronous == [0.5, 0.5, 0.0] and in_place == [0.5, 0.25, 0.125]


def test_hull_holds_its_points(spark):
    import numpy as np

    from voxelith.operators import hulls as H

    rng = np.random.default_rng(3)
    pts = rng.integers(0, 15, (60, 3))
    df = spark.createDataFrame([(0, *map(int, p), 0) for p in pts], "vol_id long, x int, y int, z int, t int")
    planes = H.hull_facets(df)
    for f in planes.collect():
        assert (pts @ np.array([f.nx, f.ny, f.nz]) <= f.offset + 1e-6).all()
    assert H.carve(df, planes).count() == len(pts)
    corners = spark.createDataFrame([(0, x, y, z, 0) for x in (0, 4) for y in (0, 4) for z in (0, 4)], df.schema)
    cube = spark.createDataFrame([(0, x, y, z, 0) for x in range(-1, 6) for y in range(-1, 6) for z in range(-1, 6)], df.schema)
    assert H.carve(cube, H.hull_facets(corners)).count() == 125
    flat = df.withColumn("z", F.lit(0))
    assert H.hull_facets(flat).count() == 0


def test_depth_first_times(spark):
    from voxelith.operators.segments import depth_first

    e = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 1, 3), (0, 4, 1)], "graph_id long, a long, b long")
    assert {r.node: (r.found, r.done) for r in depth_first(e).collect()} == {1: (0, 5), 2: (1, 4), 3: (2, 3), 4: (6, 7)}


def test_agglomeration_takes_the_cheapest_pair(spark):
    from voxelith.operators.segments import agglomerate

    sizes = spark.createDataFrame([(1, 5), (2, 1), (3, 4), (4, 4)], "node long, size long")
    touch = spark.createDataFrame([(1, 2, 1.0, 2), (3, 4, 1.0, 1), (2, 3, 1.0, 1)], "a long, b long, w double, cut long")
    assert {r.node: r.root for r in agglomerate(sizes, touch, 3).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_filled_links_join_dead_ends(spark):
    from voxelith.operators.descent import descent_links

    gen = spark.createDataFrame([(0, 0, 0, 0, 0, 1), (0, 1, 0, 0, 0, 1), (0, 2, 0, 0, 0, 1), (0, 3, 0, 0, 0, 2)], "vol_id long, x int, y int, z int, t int, wave int")
    plain = {(r.a, r.b) for r in descent_links(gen, (4, 1, 1, 1), 1, fill=False).collect()}
    filled = {(r.a, r.b) for r in descent_links(gen, (4, 1, 1, 1), 1).collect()}
    assert plain == {(2, 3)} and filled == {(2, 3), (1, 2), (0, 1)}


def test_relocation_keeps_ties(spark):
    from voxelith.operators.descent import relocate

    row = spark.createDataFrame([(0, x, 0, 0, 0, float(d)) for x, d in enumerate([3, 1, 2, 3])], "vol_id long, x int, y int, z int, t int, d double")
    clicks = spark.createDataFrame([(7, 0, 1, 0, 0, 0), (8, 0, 3, 0, 0, 0)], "click int, vol_id long, x int, y int, z int, t int")
    got = {(r.click, r.x) for r in relocate(row, clicks, box=(2, 0, 0, 0)).collect()}
    assert got == {(7, 0), (7, 3), (8, 3)}


def test_whole_inputs_are_registered(spark):
    """Every supplier's volume is carved, to a part of its foreground that holds the trace; suppliers merge to 90 clusters."""
    from voxelith.operators import extraction as X
    from voxelith.plans import applications, catalog, extraction_queries
    from voxelith.sources import grids

    queries = catalog.queries()
    sf = "/root/testdata/sf0.001"
    scans = grids.scans(spark, sf).selectExpr("*", "CAST(val > 250 AS INT) AS mask")
    fg = {tuple(r) for r in scans.where("mask = 1").select("vol_id", "x", "y", "z").collect()}
    got = [tuple(r) for r in queries["app_convexify"](spark, sf).collect()]
    depth = applications.depth_of(scans, extraction_queries.SIDES).selectExpr("vol_id", "x", "y", "z", "t", "sqrt(d) AS d")
    trace, _ = X.bounded_trace(depth, extraction_queries._clicks(spark, sf).selectExpr("*", "0 AS trial"), 1.01, X.downhill)
    traced = {}
    for r in trace.collect():
        traced.setdefault(r.vol_id, set()).add((r.vol_id, r.x, r.y, r.z))
    carved = {r[0] for r in got}
    assert len(got) == len(set(got)) and set(got) < fg and carved == {r[0] for r in fg}
    assert all(t <= set(got) for v, t in traced.items() if v in carved)
    assert queries["gr15_agglomeration"](spark, "/root/testdata/sf0.01").select("root").distinct().count() == 90


def test_line_borders(spark):
    vox = spark.createDataFrame([(0, x, 0, 0, 0, float(x * x)) for x in range(4)], "vol_id long, x int, y int, z int, t int, val double")
    line = lambda policy: [r[0] for r in images.extend(vox, "x", 4, 2, policy, default=9.0).orderBy("x").select("val").collect()]
    assert line("extrapolate") == [-4, -1, 0, 1, 4, 9, 14, 17]
    assert line("constant") == [9, 9, 0, 1, 4, 9, 9, 9]
    assert line("mirror") == [4, 1, 0, 1, 4, 9, 4, 1]
    assert line("wrap") == [4, 9, 0, 1, 4, 9, 0, 1]
    assert line("clamp") == [0, 0, 0, 1, 4, 9, 9, 9]
    with pytest.raises(ValueError):
        images.extend(vox, "x", 4, 4, "wrap")
    assert images.extend(vox.limit(0), "x", 4, 2, "constant").isEmpty()


def test_collisions(spark):
    assert len(set(segments._crossings(2))) == 4 and len(set(segments._crossings(3))) == 14
    node = spark.createDataFrame([(0, i, 0, 0, 0) for i in range(4)], "vol_id long, x int, y int, z int, t int")
    ways = {0: [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0)], 1: [(1, 0, 0), (-1, 0, 0), (0, 1, 0)], 2: [(0, 0, 1), (0, 0, -1), (1, 1, 0), (-1, -1, 0)]}
    links = spark.createDataFrame([(0, i, 0, 0, 0, *d) for i, ds in ways.items() for d in ds], "vol_id long, x int, y int, z int, t int, dx int, dy int, dz int")
    got = lambda ndim: [r[0] for r in segments.collisions(node, links, ndim).orderBy("x").select("collides").collect()]
    assert got(3) == [True, False, False, False]
    assert got(2) == [True, True, True, False]
