import pytest
import random

from voxelith.llm.substring_dedup import FingerprintIndex, drop_repeats

ROWS = None


def brute(rows):
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    windows = {}
    for i, t in order:
        w = (t or "").encode().split()
        for k in range(len(w) - 19):
            windows.setdefault(tuple(w[k : k + 20]), []).append((i, k))
    first = {w: min(p) for w, p in windows.items()}
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        cover = [False] * len(w)
        if i is not None:
            for k in range(len(w) - 19):
                j, f = first[tuple(w[k : k + 20])]
                if j < i or f < k:
                    cover[k : k + 20] = [True] * 20
        out.append((-1 if i is None else i, len(w), sum(cover), b" ".join(x for x, c in zip(w, cover) if not c).decode()))
    return sorted(out)


def corpus():
    rng = random.Random(2)
    words = [f"v{k}" for k in range(300)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(0, 90))]
        if i % 3 == 0:
            k = rng.randint(0, len(text))
            text[k:k] = passage[rng.randint(0, 20) : rng.randint(38, 60)]
        rows.append((i, " ".join(text)))
    rows += [(70, rows[5][1]), (71, rows[6][1] + "\n\n" + rows[6][1]), (72, None), (73, ""), (None, rows[3][1]), (74, "é " * 45), (75, " ".join(passage))]
    return rows


def result(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect())


def test_windows(make):
    rows = corpus()
    for batches in (1, 3):
        assert result(drop_repeats(make(rows), batches)) == brute(rows)


def test_runs_are_compacted(spark, make):
    rows = corpus()
    index = FingerprintIndex(spark, most_runs=1)
    assert result(drop_repeats(make(rows), 4, index=index)) == brute(rows)
    assert len(index.runs) == 1


def test_calls_on_one_index(spark, make):
    """A later call removes what repeats texts of earlier calls: brute force over their union."""
    rows = corpus()
    calls = [rows[:25], rows[25:50], rows[50:]]
    calls[1] = [*calls[1], (3, rows[40][1]), (12, rows[41][1]), (12, rows[0][1]), (7, rows[7][1])]
    calls[2] = [*calls[2], (80, rows[6][1]), (81, "new words " + rows[27][1]), (82, rows[6][1]), (83, None)]
    for most_runs in (1, 4):
        index, so_far = FingerprintIndex(spark, most_runs=most_runs), []
        for call in calls:
            so_far = so_far + call
            every = brute(so_far)
            want = result(drop_repeats(make(call), 2, index=index))
            texts = {(-1 if i is None else i, len((t or "").split())): (i, t) for i, t in call}
            assert len(want) == len(call) and all(w in every for w in want)
            assert {w[:2] for w in want} == set(texts)
        assert len(index.runs) <= most_runs
    removed = {r[0]: r[2:] for r in want}
    assert removed[80] == removed[82] == (len(rows[6][1].split()), "")


def test_index_is_reopened(spark, make, tmp_path):
    """A session that knows the folder alone goes on where the last one ended; a place without a manifest is a new index."""
    rows = corpus()
    path = f"file://{tmp_path}/index"
    first = FingerprintIndex(spark, most_runs=2, path=path)
    result(drop_repeats(make(rows[:40]), 3, index=first))
    for run in first.runs:  # another session has no tables in its catalog
        spark.sql(f"DROP TABLE {run['keys']}")
    again = FingerprintIndex(spark, most_runs=2, path=path)
    assert again.runs == first.runs and again.sources == first.sources and again.version == 3
    got = result(drop_repeats(make(rows[40:]), 1, index=again))
    every = brute(rows)
    assert len(got) == len(rows[40:]) and all(g in every for g in got)
    again.remove()
    assert not list(tmp_path.iterdir())


def test_frequent_keys_in_a_shuffled_join(make, monkeypatch):
    from voxelith.llm import substring_dedup as S

    monkeypatch.setattr(S, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(S, "HOT", 5)
    rows = corpus()
    assert result(drop_repeats(make(rows), 2)) == brute(rows)


def test_repeated_ids(make):
    text = " ".join(f"a{k}" for k in range(30))
    got = result(drop_repeats(make([(1, text), (1, text), (2, text)])))
    assert [g[2] for g in got] == [0, 0, 30]


def test_empty(make):
    assert drop_repeats(make([(1, "a")]).limit(0)).count() == 0


@pytest.mark.parametrize("stage", ["_save", "_remove", "compact"])
def test_broken_calls_leave_the_last_whole_index(spark, make, tmp_path, monkeypatch, stage):
    """A call that breaks before or after the manifest is written; the index opens, and the batch can go in again."""
    from voxelith.llm import substring_dedup as D

    path = f"file://{tmp_path}/index"
    passage = " ".join(f"p{k}" for k in range(25))
    batch = [make([(k, f"{passage} own{k} " + " ".join(f"w{k}x{j}" for j in range(30)))]) for k in range(4)]
    for k in range(3):
        index = D.FingerprintIndex(spark, most_runs=2, buckets=2, path=path)
        if k == 2:
            whole = getattr(D.FingerprintIndex, stage)

            def broken(self, *args):
                if stage == "_remove" and not args[0]:
                    return None
                if stage == "compact":
                    whole(self, *args)
                raise OSError("broken off")

            monkeypatch.setattr(D.FingerprintIndex, stage, broken)
            with pytest.raises(OSError):
                D.drop_repeats(batch[k], batches=1, index=index)
            monkeypatch.setattr(D.FingerprintIndex, stage, whole)
        else:
            D.drop_repeats(batch[k], batches=1, index=index).count()
    again = D.FingerprintIndex(spark, most_runs=2, buckets=2, path=path)
    assert again.texts().select("doc_id").distinct().count() == (3 if stage == "_remove" else 2)
    row = D.drop_repeats(batch[3], batches=1, index=again).first()
    assert (row.n_words, row.n_removed) == (56, 25)
    kept = {f.name for f in (tmp_path / "index").iterdir()}
    named = {p.rsplit("/", 1)[-1] for p in [*again.sources, *(q for r in again.runs for q in (r["keys"], *r["places"]))]}
    assert {f for f in kept if not f.startswith(("manifest", "."))} == named
