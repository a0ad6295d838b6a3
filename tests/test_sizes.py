"""Size and fitness vectors against plain loops on small random volumes."""

import math
import random

import numpy as np

from voxelith.operators import features

N = 6


def direct(points, v):
    """points: (x, y) by y, then x."""
    if len(points) == 1:
        return 1.0, 1.0
    top, ends = 0.0, None
    for i, p in enumerate(points):
        for q in points[i + 1 :]:
            d = (v[0] * (p[0] - q[0])) ** 2 + (v[1] * (p[1] - q[1])) ** 2
            if d > top + 1e-9:
                top, ends = d, (p, q)
    (x, y), (a, b) = ends
    long = math.sqrt(top)
    ux, uy = v[0] * (x - a) / long, v[1] * (y - b) / long
    off = [-v[0] * (p[0] - x) * uy + v[1] * (p[1] - y) * ux for p in points]
    return long + 1, max(0, *off) - min(0, *off) + 1


def ellipse(points, v):
    if len(points) == 1:
        return 1.0, 1.0
    m = np.array(points, float) * v[:2]
    low, high = np.linalg.eigvalsh(np.cov(m.T, bias=True))
    return math.sqrt(max(high, 0)), math.sqrt(max(low, 0))


def by_hand(d, v):
    cells = sorted(d, key=lambda c: c[::-1])
    slices = {}
    for x, y, z in cells:
        slices.setdefault(z, []).append((x, y))
    made = {z: (direct(p, v), ellipse(p, v)) for z, p in slices.items()}
    widest = lambda k: max(made, key=lambda z: (round(math.prod(made[z][k]), 9), -z))
    share = lambda c, w: sum(d.get((c[0] + i, c[1] + j, c[2] + k), 9e9) < d[c] for i in range(-w, w + 1) for j in range(-w, w + 1) for k in range(-w, w + 1)) / ((2 * w + 1) ** 3 - 1)
    one, two = made[widest(0)][0], made[widest(1)][1]
    round_ = max(cells, key=lambda c: share(c, 1))
    deep = max(cells, key=lambda c: d[c])
    here = made[deep[2]]
    ev = np.linalg.eigvalsh(np.cov((np.array(cells, float) * v).T, bias=True)) if len(cells) > 1 else np.zeros(3)
    part = lambda a, b: max(a, 0) / b if round(b, 9) > 0 else 0.0
    volume = len(cells) * math.prod(v)
    sizes = [volume, sum(one) / 2 - 1, one[1] / one[0], sum(two) / 2, two[1] / two[0] if two[0] else 0.0, part(ev[0], ev[2]), part(ev[0], ev[1])]
    fits = [len(cells), volume, share(round_, 2), share(deep, 2), d[deep], sum(one) / 2, one[0], sum(two) / 2, two[0], sum(here[0]) / 2, here[0][0], sum(here[1]) / 2, here[1][0]]
    return sizes, fits


def test_vectors(spark):
    rng = random.Random(6)
    vols = {}
    for k in range(40):
        box = [(x, y, z) for x in range(N) for y in range(N) for z in range(N) if rng.random() < [0.02, 0.2, 0.6][k % 3]] or [(1, 1, 1)]
        vols[k] = {c: float(rng.choice([1, 2, 3])) for c in box}
    rows = spark.createDataFrame([(k, *c, 0, x) for k, d in vols.items() for c, x in d.items()], "vol_id long, x int, y int, z int, t int, d double")
    for v in ((1.0, 1.0, 1.0), (0.5, 0.75, 2.0)):
        sizes = {r[0]: r[1:] for r in features.size_vector(rows, v).collect()}
        fits = {r[0]: r[1:] for r in features.fitness_vector(rows, v).collect()}
        assert sizes.keys() == fits.keys() == vols.keys()
        for k, d in vols.items():
            want = by_hand(d, v)
            assert np.allclose(sizes[k], want[0], atol=1e-6), (k, v)
            assert np.allclose(fits[k], want[1], atol=1e-6), (k, v)
