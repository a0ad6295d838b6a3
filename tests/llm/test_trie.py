import hashlib
import random
import zlib

import pytest

from voxelith.llm import conversation_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth long, key string"


def rebuilt_by_hand(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", hashlib.sha256((x or "").encode()).hexdigest(), x or ""))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def trie_by_hand(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for prefix, who in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below)
        saved = sum((len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) for p in below)
        ends = ",".join(map(str, sorted(c for c in who if len(convs[c]) == len(prefix))))
        kids = sum(len(p) == len(prefix) + 1 for p in below)
        out.add((min(who), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(who), kids, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def corpus(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        i = c * rng.choice([1, 1, 2]) - 7 if c % 11 else c
        for t in range(rng.randint(1, longest)):
            rows.append((i, rng.choice([t, t, None]), rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "bé", "", None, "c" * 40])))
    return rows + rows[:3]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


@pytest.mark.parametrize("seed, n, longest", [(1, 60, 4), (2, 25, 12), (3, 1, 3)])
def test_trie(spark, seed, n, longest):
    rows = corpus(seed, n, longest) + [(None, 0, "user", "nobody")]
    got = [tuple(r) for r in trie.prefix_trie(*trie.rebuilt(trie.ordered_turns(frame(spark, rows)))).collect()]
    assert len(got) == len(set(got))
    assert set(got) == trie_by_hand(rebuilt_by_hand(rows))


def test_equal_long_conversations(spark):
    rows = [(c, t, "user", f"t{t}") for c in (10, 20, 30) for t in range(14)] + [(40, t, "user", f"t{t}") for t in range(9)]
    got = {tuple(r) for r in trie.prefix_trie(*trie.rebuilt(trie.ordered_turns(frame(spark, rows)))).collect()}
    assert got == trie_by_hand(rebuilt_by_hand(rows))


def test_turnless(spark):
    rows = [(c, t, "user", f"{c}") for c in range(1, 40) if c % 5 for t in range(2)]
    convs = rebuilt_by_hand(rows)
    assert any(not v for v in convs.values())
    got = {tuple(r) for r in trie.prefix_trie(*trie.rebuilt(trie.ordered_turns(frame(spark, rows)))).collect()}
    assert got == trie_by_hand(convs)


def test_empty(spark):
    out = trie.prefix_trie(*trie.rebuilt(trie.ordered_turns(frame(spark, []))))
    assert out.count() == 0 and len(out.columns) == 8


def test_digest_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 50)
    rows = spark.range(3000).selectExpr("IF(id % 3 = 0, 1L, id % 7) AS k", "id * 17 % 3001 - 5 AS id")
    want = {}
    for k, i in sorted(tuple(r) for r in rows.collect()):
        want.setdefault(k, []).append(str(i))
    got = {r.k: r.sha256 for r in trie.joined_digests(rows, ["k"]).collect()}
    assert got == {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in want.items()}


def test_sql(spark, tmp_path):
    import duckdb

    rows = corpus(5, 40, 7)
    frame(spark, rows).drop("node", "depth", "key").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert {tuple(r) for r in con.execute(trie.ORACLE_SQL).fetchall()} == {tuple(r) for r in trie.op13_conversation_trie(spark, str(tmp_path)).collect()}
