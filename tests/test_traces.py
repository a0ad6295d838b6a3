"""Directed traces, core particles and separation of branches against plain Python."""

import math
import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from voxelith.operators import cores as C
from voxelith.operators import descriptors as D
from voxelith.operators import separation as B
from voxelith.operators import stencil as S
from voxelith.operators import traces as T
from voxelith.sources import arrays as A

N = 5
FULL = [d for d in product((-1, 0, 1), repeat=3) if any(d)]
FACES = [d for d in FULL if sum(map(abs, d)) == 1]


def around(p, offs=FULL):
    return [tuple(a + b for a, b in zip(p, d)) for d in offs]


@pytest.fixture(scope="module")
def field():
    rng = random.Random(12)
    return {p: rng.choice([0, 0, 1, 1, 2, 3, 4, 6, 9]) for p in product(range(N), repeat=3)}


def table(spark, values, name="d"):
    return spark.createDataFrame([(0, *p, 0, float(v)) for p, v in values.items()], f"vol_id long, x int, y int, z int, t int, {name} double")


def points(spark, ps, name="label"):
    return spark.createDataFrame([(0, *p, 0, k) for k, p in enumerate(ps)], f"vol_id long, x int, y int, z int, t int, {name} int")


def places(df, *more):
    return sorted((r.x, r.y, r.z, *(r[m] for m in more)) for r in df.collect())


def test_descent_trace(spark, field):
    starts = [(2, 2, 2), (0, 0, 0), (4, 1, 3), (1, 3, 2)]
    want, todo = set(), [p for p in starts if field[p] > 0]
    while todo:
        p = todo.pop()
        if p in want:
            continue
        want.add(p)
        near = [(field.get(q, 0), q) for q in around(p)]
        least = min(v for v, _ in near)
        if 0 < least <= field[p]:
            todo += [q for v, q in near if v == least]
    assert places(T.descent_trace(table(spark, field), points(spark, starts))) == sorted(want)


def test_level_fill(spark, field):
    seeds = [max(field, key=lambda p: (field[p], p)), (1, 1, 1)]
    region, level = set(seeds), {p: None for p in seeds}
    for k in range(int(max(field[p] for p in seeds)), 0, -1):
        rim = [p for p in region if any(q not in region for q in around(p, FACES))]
        new = {q for p in rim for q in around(p) if q in field and q not in region and field[q] == k}
        region |= new
        level |= {q: k for q in new}
    got = {(r.x, r.y, r.z): r.level for r in T.level_fill(table(spark, field), points(spark, seeds)).collect()}
    assert got == level


def test_trace_to_peaks(spark, field):
    peaks = sorted(p for p in field if field[p] >= 6)[::2]
    memo = {}

    def climb(p):
        if p in memo:
            return memo[p]
        if p in peaks:
            return peaks.index(p)
        top = max(field.get(q, 0) for q in around(p))
        out = -1
        if top > field[p]:
            ends = [climb(q) for q in around(p) if field.get(q, 0) == top]
            ends = [(sum((a - b) ** 2 for a, b in zip(peaks[e], p)), e) for e in ends if e >= 0]
            out = min(ends)[1] if ends else -1
        memo[p] = out
        return out

    want = sorted((*p, climb(p)) for p in field if field[p] > 0)
    assert places(T.trace_to_peaks(table(spark, field), points(spark, peaks, "peak")), "peak") == want


def test_strong_cores(spark):
    rng = random.Random(4)
    for seed in range(3):
        nodes = list(range(60))
        outer = {n for n in nodes if n < 30}
        edges = [(n, (n + 1) % 30) for n in range(30)] + [(rng.randrange(30), rng.randrange(30)) for _ in range(3)]
        links = sorted({(a, b) for b in range(30, 60) for a in rng.sample(range(b), rng.randint(1, 6))})
        down, up = {}, {}
        for a, b in links:
            down.setdefault(a, set()).add(b)
            up.setdefault(b, set()).add(a)

        def part(allowed, start):
            got, todo = set(), [start]
            while todo:
                n = todo.pop()
                if n in got:
                    continue
                got.add(n)
                todo += [y for x, y in [*edges, *((b, a) for a, b in edges)] if x == n and y in allowed]
            return got

        want = set()
        for n in nodes:
            if not down.get(n):
                want.add(n)
            elif len(up.get(n, ())) >= 4:
                seen, todo = set(), list(up[n])
                while todo:
                    q = todo.pop()
                    if q not in seen:
                        seen.add(q)
                        todo += up.get(q, ())
                reached = seen & outer
                rest = part(outer, min(reached)) - reached
                if rest and part(rest, min(rest)) != rest:
                    want.add(n)
        got = C.strong_cores(spark.createDataFrame([(n, n in outer) for n in nodes], "node long, on_surface boolean"), spark.createDataFrame(links, "a long, b long"), spark.createDataFrame([e for e in edges if e[0] != e[1]], "a long, b long"))
        assert sorted(r.node for r in got.collect()) == sorted(want)


def test_exits(spark):
    cells = [(0, x, 0, 0, 0, 1, x) for x in range(7)]
    gen = spark.createDataFrame(cells, "vol_id long, x int, y int, z int, t int, wave int, i long")
    links = spark.createDataFrame([(0, 100), (6, 101)], "a long, b long")
    made, left = C.assign_exits(gen.where("x between 1 and 5"), gen, links)
    assert sorted(tuple(r) for r in made.collect()) == [(1, 0), (2, 1), (3, 2), (4, 5), (5, 6)] and left.count() == 0
    made, left = C.assign_exits(gen.where("x = 3"), gen.where("x in (3, 5)"), links)
    assert made.count() == 0 and [r.i for r in left.collect()] == [3]


def test_exposure_width(spark):
    block = {p: 1 for p in product(range(7), range(7), range(7))}
    core = [(3, 3, 3), (1, 3, 3), (6, 6, 6)]
    got = C.exposure_width(points(spark, core), table(spark, block))
    assert sorted(tuple(r) for r in got.collect()) == [(0, 3), (1, 1), (2, 1)]


def test_one_way_links(spark):
    down = spark.createDataFrame([(1, 2), (2, 3), (2, 3)], "a long, b long")
    up = spark.createDataFrame([(2, 1), (5, 4)], "a long, b long")
    assert C.asymmetric_links(down, up).first().violations == 2


@pytest.fixture(scope="module")
def grown(spark):
    """A random tree: node 0 the source, positions near their parents; the main path goes to the deepest node."""
    rng = random.Random(9)
    at, pred, hops = {0: (0, 0, 0, 0)}, {0: None}, {0: 0}
    for n in range(1, 70):
        p = rng.choice(list(at)[-12:])
        at[n] = tuple(a + rng.randint(-1, 3) for a in at[p])
        pred[n], hops[n] = p, hops[p] + 1
    sink = max(hops, key=lambda n: (hops[n], -n))
    main, n = [], sink
    while n is not None:
        main.append(n)
        n = pred[n]
    depth, w = {n: rng.choice([0.5, 1.0, 2.0, 4.0]) for n in at}, {n: rng.choice([0.5, 2.0]) for n in at}
    tree = spark.createDataFrame([(n, pred[n], *at[n], depth[n], w[n]) for n in at], "node long, pred long, x int, y int, z int, t int, depth double, w double")
    return {"at": at, "pred": pred, "sink": sink, "main": main, "depth": depth, "w": w, "tree": tree, "path": spark.createDataFrame([(m,) for m in main], "node long")}


def kids(g, n):
    return [m for m, p in g["pred"].items() if p == n]


def below(g, n):
    return [n, *(m for k in kids(g, n) for m in below(g, k))]


def roots(g):
    return [n for n, p in g["pred"].items() if n not in g["main"] and p in g["main"]]


def test_separation(spark, grown):
    g = grown
    ends = [g["at"][m] for m in g["main"] if g["pred"][m] is not None]
    sink, source = g["at"][g["sink"]], g["at"][0]
    got = {r.branch: r for r in B.separation(g["tree"], g["path"], 0, g["sink"]).collect()}
    assert set(got) == set(roots(g)) and len(got) > 3
    for root in roots(g):
        nodes = below(g, root)
        leaves = [n for n in nodes if not kids(g, n)]
        cosines = sorted(sum((a - c) * (b - c) for a, b, c in zip(g["at"][n], sink, source)) / (math.dist(g["at"][n], source) * math.dist(sink, source)) for n in leaves if g["at"][n] != source)
        want = (max(math.dist(g["at"][n], e) for n in leaves for e in ends), min(math.dist(g["at"][n], sink) for n in nodes), cosines[len(cosines) // 2], max(min(math.dist(g["at"][n], e) for e in ends) for n in nodes))
        r = got[root]
        assert (r.leaf_far, r.sink_near, r.cosine, r.hausdorff) == pytest.approx(want)


def first_cuts(g, judge):
    out, todo = [], roots(g)
    while todo:
        n = todo.pop()
        verdict = judge(n)
        if verdict == "cut":
            out.append(n)
        elif verdict == "go":
            todo += kids(g, n)
    return sorted(out)


def test_cuts(spark, grown):
    g = grown
    ends = [m for m in g["main"] if g["pred"][m] is not None]

    def by_distance(n):
        return "cut" if min(math.dist(g["at"][n], g["at"][e]) for e in ends) > 4 else "go"

    def share(r, big, d):
        if r + big <= d:
            return 0.0
        x = (d * d - r * r + big * big) / (2 * d) if d > 1e-4 else 0.0
        if big * big < x * x:
            return 0.0
        a = math.sqrt(big * big - x * x)
        cap = lambda h: math.pi / 6 * h * (3 * a * a + h * h)
        return (cap(big - x) + cap(r - (d - x))) / (4 * math.pi / 3 * r**3)

    def by_overlap(n):
        if g["w"][n] < 1 and g["depth"][n] < 1:
            return "stop"
        return "cut" if max(share(g["depth"][n], g["depth"][e], math.dist(g["at"][n], g["at"][e])) for e in ends) < 0.3 else "go"

    assert sorted(r.node for r in B.cut_by_distance(g["tree"], g["path"], 4).collect()) == first_cuts(g, by_distance)
    assert sorted(r.node for r in B.cut_by_overlap(g["tree"], g["path"], 0.3, 1).collect()) == first_cuts(g, by_overlap)


def test_cut_by_boxes(spark, grown):
    g = grown
    # every node descends from two surface nodes of its own place and a place beside it
    links = [(1000 + n, n) for n in g["at"]] + [(2000 + n, 1000 + n) for n in g["at"]] + [(3000 + n, n) for n in g["at"]]
    place = {1000 + n: None for n in g["at"]} | {2000 + n: p for n, p in g["at"].items()} | {3000 + n: tuple(a + 1 for a in p) for n, p in g["at"].items()}
    surface = {n: p for n, p in place.items() if p}
    got = B.cut_by_boxes(g["tree"], g["path"], spark.createDataFrame(links, "a long, b long"), spark.createDataFrame([(n, *p) for n, p in surface.items()], "node long, x int, y int, z int, t int"), 0.4)

    def box(nodes):
        ps = [surface[k + n] for n in nodes for k in (2000, 3000)]
        return [(min(c), max(c)) for c in zip(*ps)]

    whole = box(g["main"])
    out, todo = [], roots(g)
    while todo:
        head = n = todo.pop()
        run = [g["pred"][n], n]
        while len(kids(g, n)) == 1:
            n = kids(g, n)[0]
            run.append(n)
        own = box(run)
        volume = math.prod(b - a + 1 for a, b in own)
        common = math.prod(max(min(b, d) - max(a, c) + 1, 0) for (a, b), (c, d) in zip(own, whole))
        if common / volume < 0.4:
            out.append(head)
        else:
            todo += kids(g, n)
    assert sorted(r.node for r in got.collect()) == sorted(out) and out


def test_new_geometry(spark, field):
    seg = {p for p, v in field.items() if v > 0 and p[0] <= 2}
    free = {p for p, v in field.items() if v > 0 and p[0] <= 3}
    d0 = {p: v for p, v in field.items() if p[0] <= 3}
    ground = {p: v + p[1] for p, v in field.items()}
    own = {p: field[p] for p in seg}
    t = lambda ps: table(spark, {p: 1 for p in ps})
    got = D.geometry_features_new(t(seg), t(free), table(spark, own), table(spark, d0), table(spark, ground), points(spark, [(0, 0, 0)])).first()
    top = max(own.values())
    first = min((p for p in own if own[p] == top), key=lambda p: (p[2], p[1], p[0]))
    far = max(1.0, max(math.dist(p, first) for p in seg))
    ball = lambda p: sum(0 < d0.get(q, 0) < d0[p] for q in around(p)) / 26
    sp, sp0 = max(map(ball, seg)), max(map(ball, free - seg))
    most = int(max([1, *own.values(), *(ground[p] for p in seg)]))

    def cdf(vs):
        bins = [sum(k <= v < k + 1 for v in vs) for k in range(1, most + 1)]
        return [sum(bins[: k + 1]) / sum(bins) for k in range(most)]

    ksd = max(abs(a - b) for a, b in zip(cdf([ground[p] for p in seg]), cdf(own.values())))
    assert (got.apart_ratio, got.max_sphericity, got.sphericity_ratio, got.disparity) == pytest.approx((top / far, sp, 1 - sp0 / sp, 1 - ksd))


def test_scores_and_files(spark, tmp_path):
    rows = spark.createDataFrame([([], "solid"), ([0.5], "solid"), ([0.5, 9.0], "nonsolid"), ([0.5], "other")], "v array<double>, k string")
    assert [round(r[0], 6) for r in rows.select(D.foreground_score(F.col("v"), F.col("k"))).collect()] == [0.0, 0.6, 0.55, 0.5]
    assert [spark.range(1).select(D.compare_scores(F.lit(a), F.lit(b))).first()[0] for a, b in ((1.0, 0.5), (0.5, 1.0), (1.0, 1.0), (0.0, 0.0))] == [1, -1, 1, 0]
    path = tmp_path / "gamma.txt"
    path.write_text("0.5 2\n" + " ".join(str(k) for k in range(16)) + "\n99")
    tau, lam, cells = A.read_gamma(spark, f"file://{path}", 2)
    assert (tau, lam) == (0.5, 2.0) and sorted(tuple(r) for r in cells.collect()) == [(m + 1, i, j, float(4 * m + 2 * i + j)) for m in range(4) for i in range(2) for j in range(2)]
    with pytest.raises(ValueError):
        A.read_gamma(spark, f"file://{path}", 3)
    with pytest.raises(ValueError):
        A.store_scalar(spark, 1, "complex")
    with pytest.raises(ValueError):
        S.particle_values(rows, rows, 5, "v", 0)


def test_spanning_forest(spark):
    from voxelith.operators.graphs import spanning_forest

    rng = random.Random(6)
    edges = {(a, b): rng.choice([1.0, 2.0, 3.0, 5.5]) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(110)) if a != b}
    best = {}
    for (a, b), w in edges.items():
        k = (min(a, b), max(a, b))
        best[k] = min(w, best.get(k, w))
    root = list(range(60))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    want = []
    for w, a, b in sorted((w, a, b) for (a, b), w in best.items()):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.append((a, b, w))
    got = spanning_forest(spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "a long, b long, w double"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_numbered(spark):
    from voxelith.plans.tables import numbered

    rows = [(g, k * 7 % 101) for g, n in ((1, 101), (2, 3), (5, 40)) for k in range(n)]
    got = numbered(spark.createDataFrame(rows, "g int, k int"), ["g"], ["k"], "place", first=0).collect()
    want = {(g, k): place for g in (1, 2, 5) for place, k in enumerate(sorted(k for h, k in rows if h == g))}
    assert {(r.g, r.k): r.place for r in got} == want and len(got) == len(rows)


def test_separation_rounds(spark):
    from voxelith.operators.descent import erode_until_apart, separation_rounds

    # two blocks with a bridge of 3 x 3, which the second erosion cuts; a third block stands apart
    cells = {(x, y, z) for x, y, z in product(range(17), range(5), range(5)) if x < 5 or x > 11} | {(x, y, z) for x, y, z in product(range(5, 12), range(1, 4), range(1, 4))}
    cells |= {(x + 20, y, z) for x, y, z in product(range(3), repeat=3)}
    cores = points(spark, [(2, 2, 2), (14, 2, 2), (21, 1, 1)])
    fg = table(spark, {p: 1 for p in cells})
    layers = erode_until_apart(fg, cores)
    got = separation_rounds(layers, cores, (30, 5, 5, 1))
    assert sorted(tuple(r) for r in got.collect()) == [(0, 1, 2)]
    assert layers.where("layer IS NULL").count() == 3


def test_scratch_tables_go(spark):
    import os

    from voxelith.plans.tables import clear, cut, shared_folder

    df = cut(spark.range(3), "scratch")
    folder = shared_folder(spark).removeprefix("file:").replace("//", "/")
    assert df.count() == 3 and any(f.startswith("scratch-") for f in os.listdir(folder))
    clear(spark)
    assert not os.path.exists(folder)
