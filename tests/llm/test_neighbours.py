import numpy as np
import pytest

from voxelith.llm import neighbours as nb

SCHEMA = "vec_id long, embedding array<float>, label int, node string, sim double, query string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], 1, "x", 0.5, "y") for i, v in rows], SCHEMA)


def brute(rows, most, asked):
    kept = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            kept.setdefault(i, np.float32(v).astype(np.float64))
    out = {}
    for q in kept:
        if asked(q):
            scores = [(-float(np.dot(kept[q], v)) / (np.linalg.norm(kept[q]) * np.linalg.norm(v)), i) for i, v in kept.items() if i != q]
            out[q] = sorted(scores)[:most]
    return out


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r)
    hit = 0
    for q, best in want.items():
        rows = sorted(found.get(q, []), key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, len(best) + 1))
        assert [(r.score, -r.vec_id) for r in rows] == sorted([(r.score, -r.vec_id) for r in rows], reverse=True)
        hit += sum(r.score >= -best[-1][0] - 1e-9 for r in rows)
    assert set(found) == {q for q in want if want[q]}
    return hit / max(1, sum(map(len, want.values())))


def run(frame_, most=5):
    rows = nb.usable(frame_)
    return nb.NeighbourGraph().nearest(rows, rows.where("id % 50 = 0"), most).collect()


def test_recall_on_random_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(32)) for i in range(3000)]
    got, want = run(frame(spark, rows)), brute(rows, 5, lambda q: q % 50 == 0)
    assert recall(got, want) >= 0.95


def test_copies_ties_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal(8)
    rows = [(i, base) for i in range(0, 400)] + [(i, base + 1e-3 * rng.standard_normal(8)) for i in range(400, 700)] + [(i, rng.standard_normal(8)) for i in range(700, 900)]
    rows += [(None, base), (1000, None), (1050, [0.0] * 8), (1100, [float("nan")] * 8), (1150, [1.0, None] * 4), (1200, [float("inf")] * 8), (1250, []), (1300, [1.0] * 3), (50, base), (-50, -base)]
    got = run(frame(spark, rows))
    want = brute([r for r in rows if r[1] is not None and len(r[1]) == 8], 5, lambda q: q % 50 == 0)
    assert recall(got, want) >= 0.95
    for q in (0, 50, 350):  # equal vectors: the smallest ids
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [i for i in range(6) if i != q][:5]


@pytest.mark.parametrize("n", [0, 1, 2, 4, 40])
def test_small_tables(spark, n):
    rng = np.random.default_rng(3)
    rows = [(i * 10, rng.standard_normal(4)) for i in range(n)]
    got, want = run(frame(spark, rows)), brute(rows, 5, lambda q: q % 50 == 0)
    assert recall(got, want) == 1 or not any(want.values())
    assert {(r.query_id, r.vec_id) for r in got} == {(q, i) for q, best in want.items() for _, i in best}


def test_turns_and_foreign_queries(spark, monkeypatch):
    monkeypatch.setattr(nb, "QUERIES", 10)
    monkeypatch.setattr(nb, "TOGETHER", 5)
    rng = np.random.default_rng(4)
    rows = nb.usable(frame(spark, [(i, rng.standard_normal(12)) for i in range(600)]))
    asked = nb.usable(frame(spark, [(1000 + i, rng.standard_normal(12)) for i in range(35)]))
    got = {(r.query_id, r.vec_id) for r in nb.NeighbourGraph().nearest(rows, asked, 3).collect()}
    want = {(r.query_id, r.vec_id) for r in nb.exact_nearest(rows, asked, 3, block=20).collect()}
    assert len(want) == 105 and len(got & want) >= 100
