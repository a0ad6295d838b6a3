import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from voxelith.llm import alignment as al

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def letters():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def by_hand(rows, libraries):
    t, sp = libraries
    back = letters()
    docs, counts = [], Counter()
    for key, text in rows:
        groups, links, a, b = [], [], [], []
        if text:
            a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            ba = [bytes(back[c] for c in t.id_to_token(i)) for i in a]
            bb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(ba) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
                a, b, ba, bb = [], [], [], []
            ends_a, ends_b = ({int(e): k for k, e in enumerate(np.cumsum([len(x) for x in side]))} for side in (ba, bb))
            i = j = 0
            for e in sorted(set(ends_a) & set(ends_b)):
                groups.append((a[i : ends_a[e] + 1], b[j : ends_b[e] + 1]))
                links.append((a[ends_a[e]], b[ends_b[e]]))
                i, j = ends_a[e] + 1, ends_b[e] + 1
        counts.update(links)
        docs.append((key, len(a), len(b), groups, links))
    best = {}
    for (_, y), c in counts.items():
        best[y] = max(best.get(y, 0), c)
    out = []
    for key, n, m, groups, links in docs:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(said.encode()).hexdigest() if n else ""
        out.append((key, n, m, len(groups), len(links), digest, sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links)))
    return out


def texts():
    rng = random.Random(4)
    pool = ["the", "Cliff", "éanment", "naïve", "  ", "\n", "\t", "x" * 30, "日本", "🙂", "<|endoftext|>", "<s>", "</s>", "<0x41>", "’s", "'s", "12345", "\x00", "́", "a​b", "…"]
    rows = [(k, " ".join(rng.choice(pool) for _ in range(rng.randint(1, 30)))) for k in range(80)]
    rows += [(100, None), (101, ""), (102, " "), (103, "   "), (104, "a "), (105, "a  b   "), (106, "with ▁ in it"), (107, "\n\n"), (None, "no id"), (3, "again"), (3, "again"), (108, "word " * 4000)]
    return rows


@pytest.mark.parametrize("block", [1, 1 << 22])
def test_digests(make, libraries, monkeypatch, block):
    monkeypatch.setattr(al, "BLOCK", block)
    rows = texts()
    key = lambda r: (r[0] is None, *map(str, r))
    got = sorted((tuple(r) for r in al.aligned_digests(make(rows)).collect()), key=key)
    assert got == sorted(by_hand(rows, libraries), key=key)


def test_alignments(make, libraries):
    rows = [r for r in texts() if r[1] != "again"]
    want = {r[0]: r for r in by_hand(rows, libraries)}
    for r in al.alignments(make(rows)).collect():
        assert (len(r.a_ids), len(r.b_ids)) == want[r.doc_id][1:3]
        if not r.a_ids:
            assert not r.overlap_a and not r.a_group
            continue
        assert r.a_group[0] == r.b_group[0] == 0 and r.a_group[-1] == r.b_group[-1] == want[r.doc_id][3] - 1
        encoder = al.aligner(A, B)
        spans = []
        for ids, size in ((r.a_ids, encoder.size_a), (r.b_ids, encoder.size_b)):
            e = np.cumsum(size[ids])
            spans.append(list(zip((e - size[ids]).tolist(), e.tolist())))
        if len(r.a_ids) < 200:
            assert list(zip(r.overlap_a, r.overlap_b)) == [(i, j) for i, x in enumerate(spans[0]) for j, y in enumerate(spans[1]) if max(x[0], y[0]) < min(x[1], y[1])]


def test_units_equal_library(libraries):
    rng = random.Random(9)
    pool = list("  abcdeé\n\t▁<>0x1s") + ["the ", "tion", "日", "🙂"]
    enc = al.PieceEncoder(B)
    assert enc.by_unit
    for _ in range(500):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(1, 60)))
        assert np.frombuffer(enc.encode(" " + text), "<u4").tolist() == libraries[1].encode(text)


def test_empty(make):
    assert al.aligned_digests(make([(1, "a")]).limit(0)).count() == 0
    assert al.aligned_digests(make([(1, None)])).collect()[0].asDict() == {"doc_id": 1, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "n_best": 0, "count_sum": 0}
