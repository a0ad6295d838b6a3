"""Patches against least squares and plain loops, splitting, masses and plane cuts against sequential versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelith.operators import descent, diffusion, hulls, patches, segments
from voxelith.operators.stencil import KEY, offsets
from voxelith.plans import applications

SIDE = 5
DIMS = (SIDE, SIDE, SIDE, 1)
index = lambda c: c[0] + SIDE * (c[1] + SIDE * c[2])
shift = lambda c, d: tuple(a + b for a, b in zip(c, d))


def cells(seed, share=0.8):
    rng = random.Random(seed)
    return {(x, y, z): (float(rng.randint(0, 50)), rng.randint(0, 1)) for x in range(SIDE) for y in range(SIDE) for z in range(SIDE) if rng.random() < share}


def table(spark, found, extra="c double, mask int"):
    return spark.createDataFrame([(0, *c, 0, *v) for c, v in found.items()], f"vol_id long, x int, y int, z int, t int, {extra}")


@pytest.mark.parametrize("terms, tau, lam, cross", [(patches.QUADRATIC, 1.0, 1.0, True), (patches.CUBIC, 0.5, 2.0, True), (patches.DENSITY, 1.5, 0.7, False)])
def test_gammas_give_the_least_squares_fit(terms, tau, lam, cross):
    rng = np.random.default_rng(5)
    gammas = patches.patch_gammas(terms, tau, lam, cross)
    near = {d: rng.normal(size=len(terms)) for d in gammas}
    new = -sum(np.array(g) @ near[d] for d, g in gammas.items())
    own, want = [], []
    for d in gammas:
        a, b = patches.contact_rows(terms, d, tau, lam, cross)
        own.append(a)
        want.append(b @ near[d])
    best = np.linalg.lstsq(np.vstack(own), np.concatenate(want), rcond=None)[0]
    assert np.allclose(new, best)


def test_a_polynomial_is_its_own_fit():
    """Patches of one polynomial, each about its own place, keep it."""
    rng = np.random.default_rng(6)
    for terms in (patches.QUADRATIC, patches.CUBIC):
        whole = rng.normal(size=len(terms))

        def about(p, q):
            rows = [(u, v) for u in (-1.0, -0.3, 0.4, 1.0) for v in (-1.0, -0.2, 0.6, 1.0)]
            left = np.array([[u ** i * v ** j for i, j in terms] for u, v in rows])
            right = np.array([[(u + p) ** i * (v + q) ** j for i, j in terms] for u, v in rows]) @ whole
            return np.linalg.lstsq(left, right, rcond=None)[0]

        new = -sum(np.array(g) @ about(*d[:2]) for d, g in patches.patch_gammas(terms, 1.0, 1.0).items())
        assert np.allclose(new, whole)


def test_density_gammas_in_closed_form():
    t, r = 1.5, 0.7
    gammas = patches.patch_gammas(patches.DENSITY, t, r, cross=False)
    value = -np.array(gammas[1, 0, 0, 0])[0, 0]
    a, b = (t * t + 4 * r) / (t * t + 8 * r) / 6, 1 / (t * t + 8 * r) / 6
    assert np.isclose(value, 2 * a - t * t * b)
    assert np.isclose(sum(-np.array(g)[0, 0] for g in gammas.values()), 1.0)


@pytest.mark.parametrize("terms, cross, how", [(patches.QUADRATIC, True, {"limit": 15.0}), (patches.CUBIC, True, {"same": "mask"}), (patches.QUADRATIC, True, {"same": "mask", "edges": True}), (patches.DENSITY, False, {"same": "mask", "flat": True}), (patches.DENSITY, False, {})])
def test_rounds_of_patches_equal_a_loop(spark, terms, cross, how):
    found = cells(11, 0.95)
    gammas = patches.patch_gammas(terms, 1.0, 1.0, cross)
    got = {(r.x, r.y, r.z): r.c for r in patches.smooth_by_patches(table(spark, found), "c", gammas, 3, **how).collect()}
    now = {c: np.array([v, *[0.0] * (len(terms) - 1)]) for c, (v, _) in found.items()}
    for _ in range(3):
        after = {}
        for c, own in now.items():
            new, lacks = np.zeros(len(terms)), False
            for d, g in gammas.items():
                q = shift(c, d)
                p = now.get(q)
                lacks = lacks or p is None
                if p is None or abs(p[0] - own[0]) > how.get("limit", np.inf) or ("same" in how and found[q][1] != found[c][1]):
                    p = np.array([own[0], *[0.0] * (len(terms) - 1)]) if how.get("flat") else own
                new = new - np.array(g) @ p
            after[c] = own if lacks and not how.get("edges") else new
        now = after
    assert got.keys() == now.keys()
    assert all(abs(got[c] - now[c][0]) < 1e-6 * max(1, abs(now[c][0])) for c in got)


def test_patches_of_nulls_and_nothing(spark):
    gammas = patches.patch_gammas(patches.QUADRATIC)
    rows = spark.createDataFrame([(0, x, y, 0, 0, None if (x, y) == (1, 1) else 4.0, None) for x in range(3) for y in range(4)], "vol_id long, x int, y int, z int, t int, c double, mask int")
    got = {(r.x, r.y): r.c for r in patches.smooth_by_patches(rows, "c", gammas, 2, same="mask").collect()}
    assert got.pop((1, 1)) is None and len(got) == 11 and all(abs(v - 4.0) < 1e-9 for v in got.values())
    assert patches.smooth_by_patches(rows.limit(0), "c", gammas, 2).count() == 0


def test_split_diffusion(spark):
    found = {c: (v / 50, m) for c, (v, m) in cells(12).items()}
    got = {(r.x, r.y, r.z): r.c for r in diffusion.react_diffuse(table(spark, found), "c", rounds=2, rate=0.5, split=True, fixed="mask").collect()}
    now = {c: v for c, (v, _) in found.items()}
    for _ in range(2):
        after = {}
        for c, v in now.items():
            b = v + sum(0.125 * (now.get(shift(c, d), v) - v) for d in offsets(3, "face"))
            b += 0.5 * b * (b - (b * b + (1 - b) * (1 - b)))
            after[c] = v if found[c][1] else min(max(b, 0.0), 1.0)
        now = after
    assert all(abs(got[c] - now[c]) < 1e-9 for c in now) and got.keys() == now.keys()


def split_by_hand(waves, label, links):
    """Piece of each voxel, from the last wave backwards."""
    piece, child = {}, {}
    for g in sorted(set(waves.values()), reverse=True):
        here = [c for c in waves if waves[c] == g]
        for c in here:
            under = [q for q in waves if waves[q] == g + 1 and (label[c], label[q]) in links]
            child[c] = min(((sum((a - b) ** 2 for a, b in zip(c, q)), piece[q]) for q in under), default=(0, None))[1]
        for c in here:
            piece[c] = min(index(q) for q in here if label[q] == label[c] and child[q] == child[c])
    return piece, child


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_split_clusters(spark, seed):
    rng = random.Random(seed)
    waves = {c: rng.choice([1, 1, 2, 2, 3]) for c in cells(seed, 0.85)}
    gen = table(spark, {c: (w,) for c, w in waves.items()}, "wave int")
    lab, links = segments.cluster_graph(gen, offsets(3, "face"), DIMS)
    label = {(r.x, r.y, r.z): r.label for r in lab.collect()}
    pairs = {(r.la, r.lb) for r in links.collect()}
    piece, child = split_by_hand(waves, label, pairs)
    rows = segments.split_clusters(lab, links, DIMS).collect()
    assert {(r.x, r.y, r.z): (r.piece, r.child) for r in rows} == {c: (piece[c], child[c]) for c in waves}
    assert all(len({r.child for r in rows if r.piece == p}) == 1 for p in {r.piece for r in rows})
    turned = segments.split_clusters(lab.repartition(3, "y").sortWithinPartitions(F.desc("x")), links.orderBy(F.desc("lb")), DIMS)
    assert sorted(turned.collect()) == sorted(rows)

    touch = {}
    for c in waves:
        for d in offsets(3, "face"):
            q = shift(c, d)
            if q in waves and abs(waves[q] - waves[c]) == 1:
                touch.setdefault(label[c], set()).add((q, waves[q] > waves[c]))
    score = {}
    for k in set(label.values()):
        down, up = (sum(1 for _, x in touch.get(k, ()) if x == side) for side in (True, False))
        score[k] = down / up if up else None
    low = {k for k, s in score.items() if s is not None and s < 0.8}
    got = {r.label: (r.coreness, r.core) for r in segments.cluster_coreness(lab, links, offsets(3, "face"), 0.8).collect()}
    assert got == {k: (s, k in low and not any(a == k and b in low for a, b in pairs)) for k, s in score.items()}


def test_clusters_of_nothing(spark):
    none = table(spark, {(0, 0, 0): (1,)}, "wave int").limit(0)
    lab, links = segments.cluster_graph(none, offsets(3, "face"), DIMS)
    assert segments.split_clusters(lab, links, DIMS).count() == 0
    assert segments.cluster_coreness(lab, links, offsets(3, "face"), 0.5).count() == 0


def test_masses(spark):
    waves = {(0, 0, 0): 1, (1, 0, 0): 1, (0, 1, 0): 2, (1, 1, 0): 2, (0, 2, 0): 3, (4, 4, 4): 1, (3, 3, 3): 2}
    links = [((0, 0, 0), (0, 1, 0)), ((0, 0, 0), (1, 1, 0)), ((1, 0, 0), (1, 1, 0)), ((0, 1, 0), (0, 2, 0)), ((1, 1, 0), (0, 2, 0))]
    arcs = spark.createDataFrame([(index(a), index(b)) for a, b in links], "a long, b long")
    gen = table(spark, {c: (w,) for c, w in waves.items()}, "wave int")
    got = {(r.x, r.y, r.z): r.mass for r in descent.distribute_mass(gen, arcs, DIMS).collect()}
    assert got == {(0, 0, 0): 1.0, (1, 0, 0): 1.0, (0, 1, 0): 0.5, (1, 1, 0): 1.5, (0, 2, 0): 2.0, (4, 4, 4): 1.0, (3, 3, 3): 0.0}
    assert descent.distribute_mass(gen.limit(0), arcs, DIMS).count() == 0


def cut_by_hand(found, o, u, v, w):
    minus, dot = lambda p, q: [a - b for a, b in zip(p, q)], lambda p, q: sum(a * b for a, b in zip(p, q))
    du, dv, dw = minus(u, o), minus(v, o), minus(w, o)
    normal = [float(k) for k in np.cross(du, dv)]
    if dot(normal, dw) > 0:
        normal = [-k for k in normal]
    side = {c: int(np.sign(dot(normal, minus(c, o)))) for c in found}
    part, left = {}, sorted(found, key=index)
    for c in left:
        if c not in part:
            stack, part[c] = [c], index(c)
            while stack:
                p = stack.pop()
                for d in offsets(3):
                    q = shift(p, d)
                    if q in side and side[q] == side[p] and q not in part:
                        part[q] = index(c)
                        stack.append(q)
    base = min(((dot(minus(c, o), minus(c, o)), part[c]) for c in found if side[c] == 0), default=(0, None))[1]
    touching = {part[c] for c in found if side[c] == 1 and any(part.get(shift(c, d)) == base and base is not None for d in offsets(3, "face"))}
    score = {k: sum((dot(minus(c, o), du) > 0) + (dot(minus(c, o), dv) > 0) for c in found if part[c] == k) / sum(1 for c in found if part[c] == k) for k in touching}
    best = min(((-s, k) for k, s in score.items()), default=(0, None))
    chosen = best[1] if len(score) == 1 or best[0] < 0 else None
    return {c: (side[c], int((part[c] == chosen) or (part[c] == base and dot(minus(c, o), du) + dot(minus(c, o), dv) > 0))) for c in found}


def test_plane_cuts(spark):
    rng, rows, planes, want = random.Random(9), [], [], {}
    for vol in range(40):
        found = set(cells(100 + vol, 0.5)) if vol else set()
        pick = lambda: tuple(rng.randrange(SIDE) for _ in range(3))
        o, u, v, w = pick(), pick(), pick(), pick()
        rows += [(vol, *c, 0) for c in found]
        planes.append((vol, o, u, v, w))
        want |= {(vol, *c): x for c, x in cut_by_hand(found, o, u, v, w).items()}
    place = "struct<x:int,y:int,z:int>"
    got = descent.cut_surface(spark.createDataFrame(rows, "vol_id long, x int, y int, z int, t int"), spark.createDataFrame(planes, f"vol_id long, o {place}, u {place}, v {place}, w {place}"), DIMS)
    assert {(r.vol_id, r.x, r.y, r.z): (r.side, r.chosen) for r in got.collect()} == want
    assert KEY == got.columns[:5]


@pytest.mark.parametrize("seed, least", [(1, 0.0), (2, 0.5), (3, -1.0)])
def test_straight_walks(spark, seed, least):
    rng = random.Random(seed)
    waves = {c: sum(c) // 2 + rng.randint(0, 1) for c in cells(seed)}
    links = [(c, shift(c, d)) for c in waves for d in offsets(3) if waves.get(shift(c, d)) == waves[c] + 1]
    ends = set(rng.sample(sorted(waves), 8))
    got = descent.straight_walks(spark.createDataFrame([(index(a), index(b)) for a, b in links], "a long, b long"), DIMS, spark.createDataFrame([(index(c),) for c in ends], "node long"), least)
    after = {}
    for a, b in links:
        after.setdefault(a, []).append(b)

    def walk(a, b):
        steps = 1
        while b not in ends and after.get(b):
            d = np.subtract(b, a)
            k, _, c = min((-round(float(d @ np.subtract(c, b) / np.sqrt((d @ d) * (np.subtract(c, b) @ np.subtract(c, b)))), 9), index(c), c) for c in after[b])
            if -k < least:
                break
            a, b, steps = b, c, steps + 1
        return index(b), steps

    assert {(r.a, r.b): (r["last"], r.steps) for r in got.collect()} == {(index(a), index(b)): walk(a, b) for a, b in links}
    assert descent.straight_walks(got.select("a", "b").limit(0), DIMS).count() == 0


def test_axis_ascents(spark):
    rng = random.Random(4)
    waves = {c: rng.randint(1, 4) for c in cells(4, 0.7)}
    starts = [c for c in waves if waves[c] == 1]
    want = set()
    for s in starts:
        p, seen = s, 0
        for d in offsets(3, "face"):
            while waves.get(shift(p, d), 0) > waves[p]:
                p = shift(p, d)
            if waves[p] > 1:
                want.add(p)
                seen += 1
        if not seen:
            want.add(s)
    gen = table(spark, {c: (w,) for c, w in waves.items()}, "wave int")
    got = descent.axis_ascents(gen, gen.where("wave = 1"))
    assert sorted((r.x, r.y, r.z) for r in got.collect()) == sorted(want)
    assert descent.axis_ascents(gen.limit(0), gen.limit(0)).count() == 0


def test_carve_in_four_dimensions(spark):
    """A simplex of five facets, one of them without extent besides; the second volume has such a one alone, so its box counts."""
    corners = [(0, 0, 0, 0), (4, 0, 0, 0), (0, 4, 0, 0), (0, 0, 4, 0), (0, 0, 0, 4)]
    points = [(v, i, *c) for v in (0, 1) for i, c in enumerate(corners)]
    facets = [(0, *(k for k in range(5) if k != skip)) for skip in range(5)] + [(0, 1, 1, 2, 3), (1, 0, 0, 1, 2)]
    rows = [(v, x, y, z, t) for v in (0, 1) for x in range(-1, 6) for y in range(6) for z in range(6) for t in range(6)]
    vox = spark.createDataFrame(rows, "vol_id long, x int, y int, z int, t int")
    got = hulls.carve_hull(vox, spark.createDataFrame(points, "vol_id long, idx int, x int, y int, z int, t int"), spark.createDataFrame(facets, "vol_id long, p0 int, p1 int, p2 int, p3 int"))
    want = {r for r in rows if all(0 <= c <= 4 for c in r[1:]) and (r[0] or sum(r[1:]) <= 4)}
    assert {tuple(r) for r in got.collect()} == want


def test_branches_apart_are_cut_off(spark):
    """A bar with a long spur and a short one: the long one's voxels from the fourth step on are cut off, one edge is type 0."""
    way = [(x, 1, 1) for x in range(1, 10)]
    spur = [(5, y, 1) for y in range(2, 9)]
    short = [(7, 2, 1), (7, 3, 1)]
    fg = set(way + spur + short)
    dims = (11, 11, 3, 1)
    vox = spark.createDataFrame([(0, x, y, z, 0, int((x, y, z) in fg)) for x in range(11) for y in range(11) for z in range(3)], "vol_id long, x int, y int, z int, t int, mask int")
    found = applications.branch_structure(vox, {"x": 1, "y": 1, "z": 1}, {"x": 9, "y": 1, "z": 1}, dims)
    at = lambda c: c[0] + 11 * (c[1] + 11 * c[2])
    rows = {(r.a, r.b): (r.w100, r.type) for r in found["tree"].collect()}
    want = {(at(p), at(q)): (100, 2) for p, q in zip(way, way[1:])}
    want |= {(at(p), at(q)): (100, 0 if q == (5, 5, 1) else 1) for p, q in zip([(5, 1, 1), *spur], spur)}
    want |= {(at(p), at(q)): (100, 1) for p, q in zip([(7, 1, 1), *short], short)}
    assert rows == want
    labels = {(r.x, r.y, r.z): r.label for r in found["labels"].collect()}
    cut_off = {c for c in spur if c[1] >= 5}
    assert labels == {c: at((5, 5, 1)) if c in cut_off else at((1, 1, 1)) for c in fg}


def test_strong_cores_part_a_dumbbell(spark):
    """Two cubes joined by a bar fall into two parts, one around each middle."""
    fg = {(x + k, y, z) for k in (1, 9) for x in range(5) for y in range(1, 6) for z in range(1, 6)} | {(x, 3, 3) for x in range(6, 9)}
    dims = (15, 7, 7, 1)
    vox = spark.createDataFrame([(0, x, y, z, 0, int((x, y, z) in fg)) for x in range(15) for y in range(7) for z in range(7)], "vol_id long, x int, y int, z int, t int, mask int")
    found = applications.strong_core_partition(vox, dims, 2)
    cores = {(r.x, r.y, r.z) for r in found["cores"].collect()}
    assert {(3, 3, 3), (11, 3, 3)} <= cores
    parts = {(r.x, r.y, r.z): r.part for r in found["parts"].collect()}
    assert parts.keys() == fg and len(set(parts.values())) >= 2
    assert parts[3, 3, 3] != parts[11, 3, 3]
    assert all(parts[c] == parts[3, 3, 3] for c in fg if c[0] <= 5) and all(parts[c] == parts[11, 3, 3] for c in fg if c[0] >= 9)
