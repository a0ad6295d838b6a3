"""Races against a heap, pruning against plain rounds, closed forms against numpy, four dimensions by hand."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelith.operators import descent, features, races
from voxelith.operators.stencil import KEY, offsets
from voxelith.plans import applications

N = 6


def fields(seed, n):
    rng = random.Random(seed)
    out = {}
    for v in range(n):
        cells = [(x, y, z) for x in range(N) for y in range(N) for z in range(N) if rng.random() < 0.7]
        d = {c: float(rng.choice([1, 2, 3, 4, 6])) for c in cells}
        out[v] = d, [(rng.choice(cells), rng.randint(1, 4)) for _ in range(5)] + [((0, 0, 77), 9)]
    return out


@pytest.mark.parametrize("delta, full, down", [(0.4, True, False), (50.0, False, True)])
def test_race_equals_a_heap(spark, delta, full, down):
    made = fields(3, 30)
    ground = spark.createDataFrame([(v, *c, 0, x) for v, (d, _) in made.items() for c, x in d.items()], "vol_id long, x int, y int, z int, t int, d double")
    seeds = spark.createDataFrame([(v, *c, 0, k) for v, (_, s) in made.items() for c, k in s], "vol_id long, x int, y int, z int, t int, label int")
    offs = offsets(3, "full" if full else "face")
    step = F.sqrt("o.len2") / F.col("d")
    rule = (lambda a, b: a >= b) if down else None
    got = {}
    for r in races.race(ground, seeds, step, delta, offs, rule=rule).collect():
        got.setdefault(r.vol_id, {})[r.x, r.y, r.z] = (r.arrival, r.label)
    for v, (d, starts) in made.items():
        best, heap = {}, [(0.0, k, c) for c, k in starts if c in d]
        heapq.heapify(heap)
        while heap:
            a, k, c = heapq.heappop(heap)
            if c in best:
                continue
            best[c] = a, k
            for o in offs:
                q = tuple(i + j for i, j in zip(c, o))
                if q in d and q not in best and (not down or d[c] >= d[q]):
                    heapq.heappush(heap, (round(a + math.sqrt(sum(i * i for i in o)) / d[q], 9), k, q))
        assert got.get(v, {}) == best


def test_race_of_nothing(spark):
    none = spark.createDataFrame([], "vol_id long, x int, y int, z int, t int, d double, label int")
    assert races.race(none, none, F.lit(1.0), 1.0, offsets(3, "face")).count() == 0


def prune_by_hand(links):
    links, score = {(a, b) for a, b, _ in links}, {(a, b): s for a, b, s in links}
    turn = lambda a: (a * 2654435761 % 2**32, a)

    def idle(now):
        out = {}
        for a, b in now:
            mine = [x for x in now if x[0] == a]
            others = [x for x in now if x[1] == b]
            if len(mine) > 1:
                if any(sum(y[0] == x[0] for y in now) == 1 for x in others):
                    out.setdefault(a, []).append((0, b))
                elif any(score[x] > score[a, b] for x in others):
                    out.setdefault(a, []).append((score[a, b], b))
        return out

    while found := idle(links):
        gone = set()
        for a, keys in found.items():
            targets = {b for x, b in links if x == a}
            if all(turn(a) <= turn(o) for o in found for x, b in links if x == o and b in targets):
                room = len(targets) - 1
                gone |= {(a, b) for _, b in sorted(keys)[:room]}
        assert gone
        links = links - gone
    return links


def test_pruning_equals_plain_rounds(spark):
    rng = random.Random(2)
    for size in (8, 40):
        links = {(rng.randrange(size), 100 + rng.randrange(size)): rng.randint(1, 5) for _ in range(size * 3)}
        rows = [(a, b, s) for (a, b), s in links.items()]
        got = {tuple(r) for r in descent.prune_links(spark.createDataFrame(rows, "a long, b long, score int")).collect()}
        assert got == prune_by_hand(rows)
        assert {a for a, _ in got} == {a for a, _ in links} and len(got) < len(links)


def test_scores(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1 + 3 * 1), (5, 1)], "a long, b long")
    digits = lambda *d: sum(x * 3**k for k, x in enumerate(d))
    assert [r.score for r in descent.link_scores(rows, (3, 3, 1, 1)).orderBy("a", "b").collect()] == [digits(3, 3, 3, 3), digits(2, 2, 3, 3), digits(1, 1, 3, 3)]


def test_eigenvalues_in_closed_form(spark):
    rng = np.random.default_rng(1)
    cases = [m + m.T for m in rng.standard_normal((60, 3, 3))] + [np.zeros((3, 3)), np.eye(3) * 2, np.diag([1.0, 1, 4]), np.ones((3, 3))]
    rows = spark.createDataFrame([(k, *map(float, m[np.triu_indices(3)])) for k, m in enumerate(cases)], "k int, xx double, xy double, xz double, yy double, yz double, zz double")
    ev = features.eigenvalues3(*(F.col(c) for c in ("xx", "xy", "xz", "yy", "yz", "zz")))
    for r in rows.select("k", F.array(*ev).alias("ev")).collect():
        assert np.allclose(r.ev, np.linalg.eigvalsh(cases[r.k]), atol=1e-6)


def test_growth_and_clicks_in_four_dimensions(spark):
    rng = random.Random(4)
    side = (6, 5, 4, 4)
    every = [(x, y, z, t) for x in range(side[0]) for y in range(side[1]) for z in range(side[2]) for t in range(side[3])]
    fg = {c for c in every if sum((a - b) ** 2 for a, b in zip(c, (2, 2, 2, 2))) <= 5 or rng.random() < 0.1}
    d2 = {c: min(sum((a - b) ** 2 for a, b in zip(c, q)) for q in every if q not in fg) for c in fg}
    around = [o for o in offsets(4)]
    add = lambda c, o: tuple(a + b for a, b in zip(c, o))
    vox = spark.createDataFrame([(0, *c, int(c in fg)) for c in every], "vol_id long, x int, y int, z int, t int, mask int")
    start = max(fg, key=lambda c: (d2[c], c))
    seeds = spark.createDataFrame([(0, *start)], "vol_id long, x int, y int, z int, t int")
    found = applications.free_growth_check(vox, seeds, side, ndim=4)
    ball = {c for c in fg if sum((a - b) ** 2 for a, b in zip(c, start)) < d2[start]}
    wave = {c: 1 for c in ball if any(add(c, o) not in ball for o in offsets(4, "face"))}
    front = set(wave)
    while front:
        front = {q for c in front for o in around if (q := add(c, o)) in fg and q not in wave and d2[q] < d2[c]}
        wave |= {q: max(wave.values()) + 1 for q in front}
    assert {(r.x, r.y, r.z, r.t): r.wave for r in found["growth"].collect()} == wave
    edge = {c for c in wave if any(add(c, o) not in fg for o in offsets(4, "face"))}
    assert {(r.x, r.y, r.z, r.t) for r in found["surface"].select(*KEY).collect()} == edge
    clicks = spark.createDataFrame([(k, 0, *c) for k, c in enumerate(sorted(fg)[::9])], "click int, vol_id long, x int, y int, z int, t int")
    ends = {}
    for r in applications.relocate_clicks(vox, clicks, side, box=(1, 1, 1, 1)).collect():
        ends.setdefault(r.click, set()).add((r.x, r.y, r.z, r.t))
    for k, c in enumerate(sorted(fg)[::9]):
        top = d2[c]
        while (best := max(d2[q] for e in [c] for q in [e, *(add(e, o) for o in around)] if q in fg)) > top:
            c, top = max((q for q in [c, *(add(c, o) for o in around)] if q in fg), key=lambda q: d2[q]), best
        assert all(d2[e] >= top for e in ends[k])
