"""Bounded traces and extraction against plain sequential versions on small random volumes."""

import math
import random
from itertools import combinations

import numpy as np
import pytest

from voxelith.operators import extraction as X

FACES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
N = 6


def trace_by_hand(d, seeds, scale, rule, before=()):
    """(particles, front): d maps places to depths."""
    seeds = sorted({s for s in seeds if s in d}, key=lambda s: (d[s], s))
    if not seeds:
        return {}, []
    least = d[seeds[len(seeds) // 4]]
    awake = [s for s in seeds if d[s] >= least]
    ended = [s for s in seeds if d[s] < least]
    front = {s: (max(1.01, math.floor(scale * d[s] + 0.5)), s) for s in awake}
    found = {s: (*v, 0) for s, v in front.items()}
    been, wave = set(front) | set(before), 0
    while front:
        wave += 1
        claims = {}
        for place, (life, origin) in front.items():
            for o in FACES:
                to = tuple(a + b for a, b in zip(place, o))
                if to in d and to not in been and sum((a - b) ** 2 for a, b in zip(to, origin)) < life * life and rule(d[place], d[to]):
                    claims.setdefault(to, []).append((-life, origin[::-1], place[::-1]))
        won = {to: min(c) for to, c in claims.items()}
        parents = {c[2][::-1] for c in won.values()}
        ended += [p for p in front if p not in parents]
        front = {to: (-c[0], c[1][::-1]) for to, c in won.items()}
        found |= {to: (*v, wave) for to, v in front.items()}
        been |= set(front)
    return found, ended


def volumes(seed, n):
    rng = random.Random(seed)
    out = {}
    for v in range(n):
        cells = [(x, y, z) for x in range(N) for y in range(N) for z in range(N) if rng.random() < 0.8]
        d = {c: rng.choice([1.0, math.sqrt(2), math.sqrt(3), 2.0, 3.0]) for c in cells}
        out[v] = d, {t: [rng.choice(cells) for _ in range(rng.randint(1, 6))] + [(0, 0, 99)] for t in range(2)}
    return out


def frames(spark, made):
    ground = spark.createDataFrame([(v, *c, 0, x) for v, (d, _) in made.items() for c, x in d.items()], "vol_id long, x int, y int, z int, t int, d double")
    seeds = spark.createDataFrame([(v, *s, 0, t) for v, (_, ss) in made.items() for t, places in ss.items() for s in places], "vol_id long, x int, y int, z int, t int, trial int")
    return ground, seeds


@pytest.mark.parametrize("scale, rule, plain", [(1.01, X.downhill, lambda a, b: a > b), (1.6, X.level_or_down, lambda a, b: a >= b)])
def test_traces_of_100_fields(spark, scale, rule, plain):
    made = volumes(7, 50)
    trace, ended = X.bounded_trace(*frames(spark, made), scale, rule)
    got, front = {}, {}
    for r in trace.collect():
        got.setdefault((r.vol_id, r.trial), {})[r.x, r.y, r.z] = (r.life, (r.ox, r.oy, r.oz), r.wave)
    for r in ended.collect():
        front.setdefault((r.vol_id, r.trial), []).append(((r.x, r.y, r.z), r.life))
    for v, (d, trials) in made.items():
        for t, places in trials.items():
            want, stopped = trace_by_hand(d, places, scale, plain)
            assert got.get((v, t), {}) == want
            assert sorted(front.get((v, t), [])) == sorted((p, math.floor(scale * d[p])) for p in stopped)


def test_second_trace_goes_on(spark):
    made = volumes(8, 20)
    ground, seeds = frames(spark, made)
    trace, ended = X.bounded_trace(ground, seeds, 0.8, X.level_or_down)
    more, _ = X.bounded_trace(ground, ended.select(*X.TRIAL), 1.01, X.downhill, before=trace)
    got = {}
    for r in more.collect():
        got.setdefault((r.vol_id, r.trial), {})[r.x, r.y, r.z] = (r.life, (r.ox, r.oy, r.oz), r.wave)
    for v, (d, trials) in made.items():
        for t, places in trials.items():
            first, stopped = trace_by_hand(d, places, 0.8, lambda a, b: a >= b)
            assert got.get((v, t), {}) == trace_by_hand(d, stopped, 1.01, lambda a, b: a > b, first)[0]


def part_of(cells, start):
    if start not in cells:
        return set()
    found, todo = {start}, [start]
    while todo:
        p = todo.pop()
        for o in FACES:
            q = tuple(a + b for a, b in zip(p, o))
            if q in cells and q not in found:
                found.add(q)
                todo.append(q)
    return found


def inside_hull(points, cells):
    """Cells inside all planes through three points that have all points on one side; None for flat sets."""
    pts = np.array(sorted(points), float)
    planes = []
    for a, b, c in combinations(range(len(pts)), 3):
        n = np.cross(pts[b] - pts[a], pts[c] - pts[a])
        if (length := np.linalg.norm(n)) < 1e-9:
            continue
        side = (pts - pts[a]) @ (n / length)
        if side.max() < 1e-9 or side.min() > -1e-9:
            planes.append((n / length * (1 if side.max() < 1e-9 else -1), pts[a]))
    if len(pts) < 4 or np.linalg.matrix_rank(pts[1:] - pts[0], tol=1e-9) < 3:
        return None
    return {c for c in cells if all((np.array(c) - p) @ n <= 0.01 for n, p in planes)}


def depth_by_hand(cells):
    box = [(x, y, z) for x in range(N) for y in range(N) for z in range(N) if (x, y, z) not in cells]
    return {c: math.sqrt(min(sum((a - b) ** 2 for a, b in zip(c, q)) for q in box)) for c in cells}


def segment_by_hand(cells, d, seeds):
    home = part_of(cells, seeds[0])
    lo, hi = [min(c[k] for c in home) for k in range(3)], [max(c[k] for c in home) for k in range(3)]
    if len(home) <= N**3 // 8 and min(lo) > 0 and max(hi) < N - 1 and 4 * len(home) >= math.prod(h - l + 1 for l, h in zip(lo, hi)):
        return home, True
    reached = set()
    for s in seeds:
        first, stopped = trace_by_hand(d, [s], 0.8, lambda a, b: a >= b)
        more, _ = trace_by_hand(d, stopped, 1.01, lambda a, b: a > b, first)
        reached |= set(first) | set(more)
    part = part_of(reached, seeds[0])
    edge = {c for c in part if any(tuple(a + b for a, b in zip(c, o)) not in part for o in FACES)}
    part = inside_hull(edge, cells) or part
    more = {c for c in cells - part for o in FACES if tuple(a + b for a, b in zip(c, o)) in part and tuple(a - b for a, b in zip(c, o)) not in cells}
    return part | more, False


def test_segments(spark):
    rng = random.Random(5)
    made, seeds = {}, {}
    for v in range(24):
        spots = [([rng.randint(1, 4) for _ in range(3)], rng.choice([1, 2, 3, 5])) for _ in range(1 if v % 3 == 0 else 3)]
        cells = {(x, y, z) for x in range(N) for y in range(N) for z in range(N) if any(sum((a - b) ** 2 for a, b in zip((x, y, z), c)) <= r for c, r in spots)}
        made[v] = depth_by_hand(cells)
        seeds[v] = [tuple(spots[0][0])] + [rng.choice(sorted(cells)) for _ in range(2)]
    depth = spark.createDataFrame([(v, *c, 0, x) for v, d in made.items() for c, x in d.items()], "vol_id long, x int, y int, z int, t int, d double")
    starts = spark.createDataFrame([(v, *s, 0, t) for v, ss in seeds.items() for t, s in enumerate(ss)], "vol_id long, x int, y int, z int, t int, trial int")
    got = {}
    for r in X.extract_segments(depth.select(*X.KEY), depth, starts, (N, N, N, 1)).collect():
        assert (r.x, r.y, r.z) not in got.setdefault(r.vol_id, ({}, r.solitary))[0]
        got[r.vol_id][0][r.x, r.y, r.z] = 1
    kinds = set()
    for v, d in made.items():
        want, alone = segment_by_hand(set(d), d, seeds[v])
        kinds.add(alone)
        assert (set(got[v][0]), got[v][1]) == (want, alone), v
    assert kinds == {True, False}


def test_no_volumes(spark):
    none = spark.createDataFrame([], "vol_id long, x int, y int, z int, t int, d double")
    assert X.extract_segments(none.select(*X.KEY), none, none.select(*X.KEY).selectExpr("*", "0 AS trial"), (N, N, N, 1)).count() == 0


def foreground_by_hand(val, click, models=("solid", "nonsolid", "partsolid"), rounds=5, width=3):
    """(model, score, seeds) of one dense volume of side N."""

    def fit(model):
        m = X.MODELS[model]

        def start(v):
            top = 1.0 if m["high"] is None else (m["high"] - v) / (m["high"] - m["mid"])
            q = max((v - m["low"]) / (m["mid"] - m["low"]) if v < m["mid"] else top, 0.0)
            return 0.5 + m["weight"] * (q - 0.5)

        q = {c: start(v) for c, v in val.items()}
        speed = (1.0, 1.0, 0.5)
        for _ in range(rounds):
            new = {}
            for c, x in q.items():
                pull = sum(speed[next(k for k in range(3) if o[k])] * (q.get(tuple(a + b for a, b in zip(c, o)), x) - x) for o in FACES)
                mean = x * x + (1 - x) * (1 - x)
                new[c] = min(1.0, max(0.0, x + 0.5 * x * (x - mean) + 0.5 * pull / (2 * sum(speed))))
            q = new
        fg = {c for c, x in q.items() if x > 0.5}
        for z in range(N):
            rest = {c for c in val if c[2] == z and c not in fg}
            while rest:
                hole = part_of(rest, next(iter(rest)))
                rest -= hole
                if len(hole) < 15 and not any(a in (0, N - 1) for c in hole for a in c[:2]):
                    fg |= hole
        if not fg or len(fg) == N**3:
            return []
        d = depth_by_hand(fg)
        around = lambda c, w: [(c[0] + i, c[1] + j, c[2] + k) for i in range(-w, w + 1) for j in range(-w, w + 1) for k in range(-w, w + 1) if (i, j, k) != (0, 0, 0)]
        share = lambda c, w: sum(d.get(p, 9e9) < d[c] for p in around(c, w)) / ((2 * w + 1) ** 3 - 1)
        region, front = set(), {click}
        for _ in range(width):
            front = {p for c in front for p in [c, *around(c, 1)] if p in fg and p not in region}
            region |= front
        sp = {c: share(c, 1) for c in fg}
        found = {c: max(sp[c], share(c, 2)) for c in region if max(abs(a - b) for a, b in zip(c, click)) <= width and sp[c] > 0 and all(sp.get(p, 0) <= sp[c] for p in around(c, 1)) and share(c, 2) > 0}
        if not found or max(found.values()) < 0.1:
            return []
        best = max(found.values())
        return sorted((-v, c[::-1]) for c, v in found.items() if v == best or v >= min(0.9 * best, 0.5))

    chosen = None
    for model in models:
        name, seeds = model, fit(model)
        if not seeds and X.MODELS[model]["instead"]:
            name = X.MODELS[model]["instead"]
            seeds = fit(name)
        score = -seeds[0][0] * X.MODELS[name]["boost"] if seeds else 0
        if score > (chosen[1] if chosen else 0):
            chosen = name, score, [(c[::-1], -v) for v, c in seeds]
    return chosen


def test_foregrounds(spark):
    rng = random.Random(11)
    vols, clicks = {}, {}
    for v in range(30):
        spots = [([rng.randint(1, 4) for _ in range(3)], rng.choice([1, 2, 4]), rng.choice([300, 450, 700, 1000, 1200])) for _ in range(rng.randint(0, 2))]
        cell = [(x, y, z) for x in range(N) for y in range(N) for z in range(N)]
        vols[v] = {c: float(max([0, *(p - 150 * max(0, sum((a - b) ** 2 for a, b in zip(c, m)) - r) for m, r, p in spots)])) for c in cell}
        clicks[v] = tuple(spots[0][0]) if spots else (2, 2, 2)
    vox = spark.createDataFrame([(v, *c, 0, x) for v, cells in vols.items() for c, x in cells.items()], "vol_id long, x int, y int, z int, t int, val double")
    at = spark.createDataFrame([(v, *c, 0) for v, c in clicks.items()], "vol_id long, x int, y int, z int, t int")
    found = X.extract_foreground(vox, at, (N, N, N, 1))
    models = {r.vol_id: (r.model, round(r.score, 9)) for r in found["model"].collect()}
    seeds = {}
    for r in sorted(found["seeds"].collect(), key=lambda r: r.trial):
        seeds.setdefault(r.vol_id, []).append(((r.x, r.y, r.z), round(r.value, 9)))
    seen = set()
    for v, val in vols.items():
        want = foreground_by_hand(val, clicks[v])
        assert models.get(v) == (want and (want[0], round(want[1], 9))), v
        if want:
            seen.add(want[0])
            assert seeds[v] == [(c, round(x, 9)) for c, x in want[2]], v
    assert len(seen) >= 2 and set(found["mask"].select("vol_id").distinct().toPandas()["vol_id"]) == set(models)
