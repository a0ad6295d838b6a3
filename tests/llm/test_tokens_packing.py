import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

os.environ["TOKENIZERS_PARALLELISM"] = "false"
from voxelith.llm import packing, tokens  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
ROWS = [(5, "Hello world, it's 3 o'clock"), (2, None), (3, ""), (9, "naïve  café\n\n\tend "), (9, "naïve  café\n\n\tend "), (None, "no id"), (1, "word " * 3000), (4, "日本語 text\x1c²³"), (6, "a <|endoftext|> b <|endoftext|>")]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library(library):
    rng = random.Random(3)
    pool = [chr(c) for c in (*range(0x250), *range(0x2010, 0x2060), 0x301, 0x4E00, 0x1F600)] + list(" \n'sre") * 40
    enc = tokens.TokenEncoder(PATH, kept=50)
    for text in ["".join(rng.choice(pool) for _ in range(rng.randint(0, 80))) for _ in range(500)] + ["<|endoftext|> x", "a<|endoftext|>", "a <|endoftext|><|endoftext| >"]:
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == library(text)


def test_files(spark, make, library, tmp_path):
    path = f"file://{tmp_path}/t"
    tokens.write_token_files(make(ROWS), path, max_list=100)
    got = tokens.ids_crc32(tokens.read_token_files(spark, path)).orderBy("start").collect()
    at = 0
    texts = {}
    for i, t in ROWS:
        texts.setdefault(i, t)
    assert [r.doc_id for r in got] == sorted((i for i, _ in ROWS), key=lambda i: (i is not None, i))
    for r in got:
        ids = np.array([*library(texts[r.doc_id]), 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_files_of_no_documents(spark, make, tmp_path):
    path = f"file://{tmp_path}/t"
    tokens.write_token_files(make(ROWS[:0]) if ROWS[:0] else make(ROWS).limit(0), path)
    assert tokens.read_token_files(spark, path).count() == 0


def check_pieces(pieces, lengths, capacity):
    by_doc, by_seq = {}, {}
    for doc, start, length, seq, offset in pieces:
        by_doc.setdefault(doc, []).append((start, length))
        by_seq.setdefault(seq, []).append((offset, length))
    for doc, n in lengths.items():
        at = 0
        for start, length in sorted(by_doc[doc]):
            assert start == at and length > 0
            at += length
        assert at == n
    padding = 0
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def pieces_of(windows):
    pieces = []
    for seq, w in enumerate(windows):
        at = 0
        for key, start, length in w:
            pieces.append((key, start, length, seq, at))
            at += length
    return pieces


@pytest.mark.parametrize("seed, capacity, windows, fill, n", [(1, 1024, 64, 0.94, 700), (2, 1024, 64, 1.0, 700), (3, 16, 4, 0.9, 300), (4, 1024, 64, 0.94, 3), (5, 7, 3, 0.5, 40), (6, 1024, 64, 0.94, 0)])
def test_packer_is_whole_and_without_padding(seed, capacity, windows, fill, n):
    rng = random.Random(seed)
    lengths = {k: rng.choice([1, 2, 30, 400, 1023, 1024, 1025, 5000]) + rng.randint(0, 40) for k in range(n)}
    p = packing.Packer(capacity, windows, fill)
    made = [w for k, m in lengths.items() for w in p.add(k, m)] + p.close()
    assert check_pieces(pieces_of(made), lengths, capacity) == 0
    short = [w for w in made if sum(x[2] for x in w) < capacity]
    assert sum(x[2] for w in short for x in w) < capacity


def test_window_count_rises():
    windows = packing.fit_windows([(k, 0, 600) for k in range(5)], 1024)
    assert len(windows) == 5  # no two of them fit in one
    rng = random.Random(7)
    for _ in range(40):
        pieces = [(k, 0, rng.randint(1, 100)) for k in range(rng.randint(1, 40))]
        windows = packing.fit_windows(pieces, 100)
        assert sorted(p for w in windows for p in w) == pieces and max(sum(p[2] for p in w) for w in windows) <= 100
        fewer = packing.difference([p[2] for p in pieces], len(windows) - 1) if len(windows) > 1 else []
        least = -(-sum(p[2] for p in pieces) // 100)
        assert len(windows) == least or max(sum(pieces[i][2] for i in g) for g in fewer) > 100


def test_difference_is_near_equal():
    sums = [sum(g) for g in ([[8, 7, 6, 5, 4][i] for i in part] for part in packing.difference([8, 7, 6, 5, 4], 2))]
    assert sorted(sums) == [14, 16]
    assert packing.difference([], 3) == [[], [], []]


def test_pack(make, library):
    rows = [(i, t) for i, t in dict(ROWS).items() if i is not None]
    got = packing.pack(make(rows)).collect()
    lengths = {i: len(library(t)) + 1 for i, t in rows}
    check_pieces([(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in got], lengths, 1024)
    for r in got:
        ids = np.array([*library(dict(rows)[r.doc_id]), 0], "<u4")
        assert bytes(r.ids) == ids[r.start : r.start + r.length].tobytes() and r.doc_tokens == len(ids)


def test_pack_odd_rows(make):
    assert packing.pack(make(ROWS)).where("doc_id IS NULL").count() == 1
    assert packing.pack(make(ROWS).limit(0)).count() == 0
