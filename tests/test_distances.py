"""The lower envelope against a plain minimum, and nearest cores against all pairs."""

import numpy as np
import pytest

from voxelith.operators.distance import _pass
from voxelith.operators.proximity import nearest


@pytest.mark.parametrize("metric", ["euclid", "city", "chess"])
def test_passes_equal_a_plain_minimum(metric):
    rng = np.random.default_rng(3)
    for n, lines, spacing in ((1, 3, 1.0), (2, 5, 1.0), (17, 40, 1.0), (30, 12, 0.5), (25, 9, 2.5)):
        at = np.sort(rng.choice(n * 2, n, replace=False)).astype(float)
        f = np.where(rng.random((n, lines)) < 0.3, rng.integers(0, 30, (n, lines)).astype(float), np.inf)
        f[:, 0], f[:, 1] = np.inf, 0.0
        gap = np.abs(at[:, None] - at[None, :]) * spacing
        joined = {"euclid": lambda a, d: a + d * d, "city": lambda a, d: a + d, "chess": np.maximum}[metric]
        want = joined(f[:, None, :], gap[:, :, None]).min(axis=0)
        assert np.allclose(_pass(f, at, spacing, metric), want)
        assert np.allclose(_pass(f.reshape(n, lines, 1), at, spacing, metric)[..., 0], want)


def test_long_lines_take_linear_time():
    import time

    took = []
    for n in (1500, 6000):
        f = np.random.default_rng(1).integers(0, 10**6, (n, 4)).astype(float)
        began = time.process_time()
        _pass(f, np.arange(n, dtype=float), 1.0, "euclid")
        took.append(time.process_time() - began)
    assert took[1] < 9 * took[0]


def test_nearest_equals_all_pairs(spark):
    rng = np.random.default_rng(5)
    cores = np.round(np.concatenate([rng.normal(0, 1, (60, 3)), rng.normal(50, 0.2, (20, 3)), [[0, 0, 0]] * 3]), 3)
    points = np.round(np.concatenate([rng.normal(0, 2, (200, 3)), rng.uniform(-300, 300, (40, 3)), rng.normal(50, 1, (50, 3))]), 3)
    frame = lambda m: spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(m)], "id long, px double, py double, pz double")
    got = {r.id: (r.core, r.dist) for r in nearest(frame(points), frame(cores)).collect()}
    d2 = sum((points[:, None, k] - cores[None, :, k]) ** 2 for k in range(3))
    assert got.keys() == set(range(len(points)))
    for i, (core, dist) in got.items():
        assert core == int(np.argmin(d2[i])) and abs(dist - np.sqrt(d2[i].min())) < 1e-9
    one = frame(cores[:1])
    assert {r.core for r in nearest(frame(points[:5]), one).collect()} == {0}
    assert nearest(frame(points), frame(cores).limit(0)).count() == 0
    assert nearest(frame(points).limit(0), frame(cores)).count() == 0
