import random
import re

import pytest

from voxelith.llm import near_dup
from voxelith.llm.near_dup import JaccardJoin
from voxelith.plans.tables import cut

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, num, den):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(grams(t, n))
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            for a in sets[i]:
                for b in sets[j]:
                    if a and b and den * len(a & b) >= num * len(a | b):
                        x, y = find(i), find(j)
                        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def corpus(seed, sizes, copies):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, i = [], 0
    for size in sizes:
        base = [rng.choice(vocabulary) for _ in range(size)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, max(1, size // 25))):
                text[rng.randrange(size)] = rng.choice(vocabulary) + rng.choice(["", "X"])
            rows.append((i, " ".join(text)))
            i += 1
    return rows


@pytest.mark.parametrize("n, num", [(3, 90), (5, 80)])
def test_components(make, n, num):
    rows = corpus(n, [1, 2, 4, 7, 12, 20, 40, 90, 150, 300, 500], 14)
    rows += [(900, None), (901, ""), (902, " \t\n"), (None, "w1 w2 w3"), (903, "Same Text here"), (903, "Same Text here"), (904, "sAME text HERE"), (905, "one"), (906, "ONE"), (907, "one two"), (0, "another version of the id zero")]
    got = JaccardJoin(n, num).components(make(rows)).collect()
    assert len(got) == len(rows)
    want = brute(rows, n, num, 100)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    sizes = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles) for r in got)
    assert sizes == sorted((i if i is not None else -1, len(grams(t, n))) for i, t in rows)


def test_large_group_of_near_copies(make):
    rng = random.Random(5)
    base = [f"b{k}" for k in range(148)]
    rows = []
    for i in range(150):
        text = list(base)
        for k in rng.sample(range(148), rng.randint(1, 5)):
            text[k] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    got = {r.doc_id: r.component_id for r in JaccardJoin().components(make(rows)).collect()}
    assert got == brute(rows, 3, 90, 100)


def test_empty(make):
    assert JaccardJoin().components(make([(1, "a")]).limit(0)).count() == 0


@pytest.mark.parametrize("n, num", [(3, 90), (5, 80)])
def test_popular_passages(make, n, num):
    """Texts of unlike sizes share whole passages; small and large near copies of them link across."""
    rng = random.Random(n)
    passages = [[f"p{k}x{j}" for j in range(30)] for k in range(4)]
    rows, i = [], 0
    for _ in range(60):
        text = [f"u{rng.randrange(10**6)}" for _ in range(rng.choice([6, 15, 40, 90]))]
        for p in rng.sample(passages, rng.randint(1, 4)):
            at = rng.randint(0, len(text))
            text[at:at] = p
        for _ in range(rng.choice([1, 1, 3])):
            near = list(text)
            for _ in range(rng.randint(0, 3)):
                near[rng.randrange(len(near))] = f"v{rng.randrange(10**6)}"
            rows.append((i, " ".join(near)))
            i += 1
    got = {r.doc_id: r.component_id for r in JaccardJoin(n, num).components(make(rows)).collect()}
    assert got == brute(rows, n, num, 100)


def test_signatures_lose_no_pair():
    """Any two sets within the bound share a signature that one of them can't do without."""
    import numpy as np

    join, rng = JaccardJoin(5, 80), np.random.default_rng(3)
    for size in (4, 9, 20, 26, 33, 60, 120):
        for _ in range(60):
            base = rng.integers(1, 2**63, size, dtype=np.uint64)
            lost = rng.integers(0, size // 9 + 1)
            a, b = np.sort(base), np.sort(np.concatenate([base[lost:], rng.integers(1, 2**63, rng.integers(0, size // 9 + 1), dtype=np.uint64)]))
            if 100 * (size - lost) < 80 * (lost + len(b)):
                continue
            row, gram = np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b])
            r, s, plan, spare = join.signatures(row, gram, 2)
            own = [{(p, x): sp for q, x, p, sp in zip(r, s, plan, spare) if q == k} for k in (0, 1)]
            both = own[0].keys() & own[1].keys()
            if lost == 0 and len(b) == size:
                assert own[0] == own[1]
                continue
            # the shared signatures of some plan are more than what either set can spare there
            assert any(len([x for x in both if x[0] == p]) > max(own[0][x], own[1][x]) for p, x0 in both for x in [(p, x0)])


def test_signatures_are_counted_after_the_shuffle_alone(spark, monkeypatch):
    plans = {}

    def seen(df, tag, **options):
        plans[tag] = df._jdf.queryExecution().executedPlan().toString()
        return cut(df, tag, **options)

    monkeypatch.setattr(near_dup, "cut", seen)
    texts = [" ".join(f"w{i}" for i in range(n, n + 30)) for n in (0, 0, 1, 50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r.component_id for r in near_dup.JaccardJoin(words=5, num=80, den=100).components(docs).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 3}
    before = plans["jaccard-signatures"].split("Exchange hashpartitioning", 1)[1]
    assert "HashAggregate(keys=[sig" not in before  # a task's signatures, mostly different ones, would be held there
