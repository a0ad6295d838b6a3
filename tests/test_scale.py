"""How much work large inputs make: who is broadcast, how rows are dealt out."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from voxelith.operators import descent as Q
from voxelith.operators import features as E
from voxelith.operators import graphs as R
from voxelith.operators import hulls as H
from voxelith.operators import proximity
from voxelith.operators.distance import distance, few_volumes
from voxelith.operators.proximity import epsilon_classes, epsilon_pairs, expand_classes
from voxelith.operators.stencil import KEY
from voxelith.plans import propagation_queries
from voxelith.plans.graph_queries import lean_edges
from voxelith.plans.segment_queries import cluster_points
from voxelith.plans.tables import BROADCAST_ROWS, cut
from voxelith.sources import grids as G


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_many_cells_of_few_bytes_arent_broadcast(spark):
    cells = spark.range(BROADCAST_ROWS + 1).select((F.col("id") % 12).cast("int").alias("x"), (F.col("id") / 144).cast("int").alias("z"), F.lit(0).alias("t"))
    one, other = cut(cells, "cells"), cut(cells, "cells")
    assert "BroadcastHashJoin" not in planned(one.join(other, ["x", "z", "t"]))
    few = cut(cells.limit(100), "few")
    assert "BroadcastHashJoin" in planned(one.join(F.broadcast(few), ["x", "z", "t"]))
    assert (one._rows, few._rows) == (BROADCAST_ROWS + 1, 100)


def test_scans_are_dealt_out_and_not_broadcast(spark, tmp_path):
    spark.range(1, 2001).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    scans = G.scans(spark, str(tmp_path))
    assert scans.rdd.getNumPartitions() >= 2000 // G.SCANS_A_TASK
    assert "BroadcastHashJoin" not in planned(scans.join(scans.where("val > 250").select("vol_id", "x", "y", "z"), ["vol_id", "x", "y", "z"]))


@pytest.mark.parametrize("w", [(1, 1, 1), (2, 2, 2), (2, 0, 1)])
def test_sphericity_over_block_borders(spark, w):
    rng = random.Random(4)
    cells = {(v, x, y, z): rng.choice([0.0, 1.0, 2.0, 2.5, 3.0]) for v in (3, 8, 40) for x in range(-3, 20) for y in (0, 1, 2) for z in (13, 14, 15, 16) if rng.random() < 0.8}
    vox = spark.createDataFrame([(*k[:1], *k[1:], 0, d) for k, d in cells.items()], "vol_id bigint, x int, y int, z int, t int, d double")
    offs = E.box_offsets(*w)
    want = {k: sum(0 < cells.get((k[0], k[1] + a, k[2] + b, k[3] + c), 0) < d for a, b, c, _ in offs) / len(offs) for k, d in cells.items()}
    got = {(r.vol_id, r.x, r.y, r.z): r.sp for r in E.sphericity(vox, "d", w).collect()}
    assert got == pytest.approx(want)
    sent = E.in_blocks(vox, max(w)).count()
    assert sent < 3 * len(cells)  # not once for each cell of the window


@pytest.mark.parametrize("close", [5.0, 0.001])  # the second makes edges of weight 0 between places
def test_forest_of_shared_places(spark, close):
    rng = random.Random(7)
    places = [(close * rng.randint(0, 3), close * rng.randint(0, 3) + 40 * rng.randint(0, 1)) for _ in range(9)]
    ids = rng.sample(range(100), 40)
    rows = [(i, *rng.choice(places), 0.0) for i in ids] + [(200, None, 1.0, 0.0), (201, float("nan"), 1.0, 0.0), (202, None, 1.0, 0.0)]
    at = cut(spark.createDataFrame(rows, "id bigint, px double, py double, pz double"), "points")
    full = epsilon_pairs(at, 12.0)
    both = {tuple(r) for r in expand_classes(*epsilon_classes(at, 12.0)).collect()}
    assert both == {tuple(r) for r in full.collect()}
    whole = full.select("a", "b", F.round(100 * F.col("dist")).alias("w"))
    lean = lean_edges(at)
    assert sorted(R.spanning_forest(lean).collect()) == sorted(R.spanning_forest(whole).collect())
    if close > 1:
        assert lean.count() <= len(ids) + len(places) ** 2 < whole.count()


@pytest.mark.parametrize("clusters", [4, 20])  # fewer and more than places
def test_clusters_of_shared_places_merge_as_one_pair_at_a_time(spark, clusters):
    rng = random.Random(3)
    places = [(5.0 * rng.randint(0, 5), 5.0 * rng.randint(0, 5) + 40 * rng.randint(0, 1)) for _ in range(14)]
    xy = {i: rng.choice(places) for i in range(1, 41)}
    touch = {(a, b): (round(100 * d), 1) for a in xy for b in xy if a < b and (d := sum((p - q) ** 2 for p, q in zip(xy[a], xy[b])) ** 0.5) < 12}
    root, size = {i: i for i in xy}, dict.fromkeys(xy, 1)
    while len(size) > clusters and touch:
        _, a, b = min((w / n * min(size[a], size[b]), a, b) for (a, b), (w, n) in touch.items())
        size[a] += size.pop(b)
        root = {k: a if r == b else r for k, r in root.items()}
        after = {}
        for (p, q), (w, n) in touch.items():
            p, q = sorted((a if p == b else p, a if q == b else q))
            if p != q:
                v, m = after.get((p, q), (w, 0))
                after[p, q] = (min(v, w), m + n)
        touch = after
    at = spark.createDataFrame([(i, *p, 0.0) for i, p in xy.items()], "id bigint, px double, py double, pz double")
    nodes = at.select(F.col("id").alias("node"), F.lit(1).cast("long").alias("size"))
    assert {r.node: r.root for r in cluster_points(at, nodes, clusters).collect()} == root


def test_depths_of_dealt_out_scans_need_no_shuffle_of_cells(spark, tmp_path):
    spark.range(1, 41).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    scans = G.scans(spark, str(tmp_path), deal=few_volumes()).withColumn("mask", (F.col("val") > 250).cast("int"))
    far = distance(scans, "mask = 0", by_volume=True, only="mask = 1")
    plan = far._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan  # that of the suppliers
    some = scans.where("vol_id IN (3, 17) AND (x + y) % 5 <> 0")  # cells may be absent
    want = distance(some, "mask = 0", dims=(G.SCAN, G.SCAN, G.SCAN, 1)).join(some.where("mask = 1").select(*KEY), KEY)
    got = distance(some, "mask = 0", by_volume=True, only="mask = 1")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_clicks_at_one_place_climb_as_one(spark):
    depth = spark.createDataFrame([(0, x, 0, 0, 0, float(d)) for x, d in enumerate([1, 2, 2, 1, 5, 6, 5])], "vol_id bigint, x int, y int, z int, t int, d double")
    at = [(k, 0, k % 7, 0, 0, 0) for k in range(70)] + [(7, 0, 0, 0, 0, 0), (100, 0, 0, 0, 0, 0), (100, 0, 6, 0, 0, 0), (101, 0, 9, 0, 0, 0)]
    clicks = spark.createDataFrame(at, "click bigint, vol_id bigint, x int, y int, z int, t int")
    found = Q.relocate(depth, clicks, box=(1, 0, 0, 0))
    ends = {0: [1, 2], 1: [1, 2], 2: [1, 2], 3: [5], 4: [5], 5: [5], 6: [5]}
    assert sorted((r.click, r.x) for r in found.collect()) == sorted([(k, x) for k in range(70) for x in ends[k % 7]] + [(100, 5)])
    written = next(p for p in found.inputFiles() if "relocate" in p).rsplit("/", 1)[0]
    assert spark.read.parquet(written).select("click").distinct().count() <= 8  # places, not clicks


def test_many_clicks_do_not_each_spread_over_the_cells(spark, monkeypatch):
    rng = random.Random(8)
    v = {(0, x, y): 1 + (x == y == 0) for x in range(9) for y in range(9)}  # flat but for a corner
    v |= {(1, x, y): rng.choice([1, 1, 1, 1, 2, 2, 3]) for x in range(8) for y in range(8) if rng.random() < 0.8}
    box = lambda c: [q for i in (-1, 0, 1) for j in (-1, 0, 1) if (q := (c[0], c[1] + i, c[2] + j)) in v]

    def ends(fronts):
        rose = True
        while rose:  # a round takes all clicks; the first in which none rises is the last
            after = {k: {q for c in f for q in box(c)} for k, f in fronts.items()}
            after = {k: {q for q in f if v[q] == max(map(v.get, f))} for k, f in after.items()}
            rose = any(v[q] > max(v[c] for c in box(q) if c in fronts[k]) for k, f in after.items() for q in f)
            fronts = after
        return sorted((k, *c) for k, f in fronts.items() for c in f)

    def found(at):
        clicks = spark.createDataFrame([(k, *c, 0, 0) for k, f in at.items() for c in f], "click bigint, vol_id bigint, x int, y int, z int, t int")
        return sorted((r.click, r.vol_id, r.x, r.y) for r in Q.relocate(depth, clicks, box=(1, 1, 0, 0)).collect())

    written, cut = [], Q.cut
    monkeypatch.setattr(Q, "cut", lambda *a: written.append(cut(*a)) or written[-1])
    depth = spark.createDataFrame([(*c, 0, 0, float(d)) for c, d in v.items()], "vol_id bigint, x int, y int, z int, t int, d double")
    every = {k: {c} for k, c in enumerate(sorted(v))} | {1000: {(0, 0, 0), (0, 8, 8)}, 1001: {(0, 3, 3), max(v)}}
    assert found(every) == ends(every)
    assert max(df._rows for df in written) <= 9 * len(v)  # a box about each place
    few = {k: every[k] for k in (3, 30, 90, 120, 1000)}
    monkeypatch.setattr(Q, "_risen_by_cells", None)  # their boxes hold fewer than all cells
    assert found(few) == ends(few)


def test_hulls_are_dealt_out_by_points(spark):
    cells = spark.range(H.POINTS_A_TASK * 3).select((F.col("id") % 1000).alias("vol_id"), *(F.pmod(F.xxhash64("id", F.lit(a)), F.lit(9)).cast("int").alias(a) for a in "xyz"))
    plan = H.hull_facets(cells)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan  # so that few bytes aren't one task


def test_diameters_of_many_slices_are_compared_in_batches(spark):
    rng = random.Random(5)
    cells = {(v, rng.randint(0, 9), rng.randint(0, 9), z) for v in range(4) for z in range(3) for _ in range((v + 1) * 4)} | {(9, 5, 5, 0)}
    fg = spark.createDataFrame([(*c, 0) for c in cells], "vol_id bigint, x int, y int, z int, t int")
    found = E.slice_diameters(fg, (1.0, 2.0, 1.0))
    assert "lambdafunction" not in found._jdf.queryExecution().optimizedPlan().toString().lower()  # pairs in interpreted lambdas took the time
    for r in found.collect():
        ps = sorted((y * 2.0, x * 1.0) for v, x, y, z in cells if (v, z) == (r.vol_id, r.z))
        if len(ps) == 1:
            assert (r.major, r.minor) == (1.0, 1.0)
            continue
        d, p, q = max(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2, [-c for c in a], [-c for c in b]) for a in ps for b in ps)
        p, q, long = [-c for c in p], [-c for c in q], d**0.5
        off = [((c[0] - p[0]) * (p[1] - q[1]) - (c[1] - p[1]) * (p[0] - q[0])) / long for c in ps]
        assert (r.major, r.minor) == pytest.approx((long + 1, max(off) - min(off) + 1))


def test_geodesic_seeds_take_the_cells_about_the_spots_alone(spark, tmp_path, monkeypatch):
    spark.range(1, 21).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    written = {}
    monkeypatch.setattr(propagation_queries, "cut", lambda df, tag: written.setdefault(tag, cut(df, tag)))
    found = propagation_queries.s04_geodesic(spark, str(tmp_path))
    assert found.select("vol_id").distinct().count() <= 20
    deep = written["depth"].groupBy("vol_id").agg(*(F.max(a) - F.min(a) for a in "xyz"), F.count("*").alias("n"))
    assert all(max(r[1:4]) <= 4 and r.n <= 125 for r in deep.collect())  # five cells a side, not the volume


def test_equal_volumes_are_made_once(spark, tmp_path):
    keys = [5, 6, 17, 89, 173]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    classes = G.alike(spark, str(tmp_path))
    rep = {5: 5, 6: 6, 17: 17, 89: 5, 173: 5}
    assert {r.vol_id: r.rep for r in classes.collect()} == rep
    few, every = G.scans(spark, str(tmp_path), classes=classes), G.scans(spark, str(tmp_path))
    assert few.count() == 3 * G.SCAN**3
    back = G.each_of(few, classes)
    assert back.count() == every.count() and back.exceptAll(every).isEmpty()
    assert {r.vol_id: r.rep for r in G.alike(spark, str(tmp_path), also=(F.col("vol_id") % 10,)).collect()} == rep | {89: 89, 173: 173}


def test_pairs_of_one_place_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(proximity, "BLOCK", 8)
    monkeypatch.setattr(proximity, "PAIRS_A_TASK", 256)
    at = spark.range(100).selectExpr("id", "1D AS px", "2D AS py", "0D AS pz").unionByName(spark.createDataFrame([(100, 4.0, 6.0, 0.0)], "id bigint, px double, py double, pz double"))
    pairs = expand_classes(*epsilon_classes(at, 12.0))
    got = pairs.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.a, r.b, r.dist) for r in got) == [(a, b, 5.0 if b == 100 else 0.0) for a in range(101) for b in range(a + 1, 101)]
    assert max(Counter(r.task for r in got).values()) < 1500  # of 5,050
