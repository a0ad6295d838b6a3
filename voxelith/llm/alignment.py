"""Alignment of two tokenizations of the same bytes by byte-owner arrays (operator 12).

Tokenizer A is a byte-level BPE of the tokenizers library, B a sentencepiece model.
Each token's index is repeated over its bytes; the two arrays of owners, side by
side, show everything: consecutive distinct pairs of owners are the overlaps, and
where both owners change at once a group of A tokens and a group of B tokens end together.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import settings
from .common import cut, drop
from .tokens import TokenEncoder, default_tokenizer

#: Bytes of text that one block holds, about; a longer text is a block of its own. A block's id pairs are counted together.
BLOCK = 4 << 20
#: Kept units of each Python worker, in two halves; units of more characters go to the library each time.
KEPT_UNITS, UNIT_CHARS = 600_000, 48

#: What precedes a word belongs to it: without pieces that hold a space after another character, nothing merges across.
UNITS = re.compile(" *[^ ]+| +")


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PlainEncoder(TokenEncoder):
    """TokenEncoder to which the strings of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path, KEPT_UNITS)
        self.tokenizer.encode_special_tokens = True
        self.added = []

    @cached_property
    def token_bytes(self) -> list[bytes]:
        back = {c: b for b, c in self.letters.items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        out = [b""] * (max(self.tokenizer.get_vocab().values()) + 1)
        for token, i in vocabulary.items():
            out[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        return out


class PieceEncoder(dict):
    """Unit -> bytes of its piece ids. encode(text): ids of a text that begins with the space that the model puts before it."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.half, self.older = KEPT_UNITS // 2, {}
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.token_bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.by_unit = self._identity() and not any("▁" in p.lstrip("▁") for p in pieces)
        self.space = np.array([self.model.piece_to_id("▁")], "<u4").tobytes()

    def _identity(self) -> bool:
        """Whether the model is a BPE that takes texts as they are, with a space before them."""
        try:
            from sentencepiece import sentencepiece_model_pb2 as proto
        except ImportError:
            return False
        model = proto.ModelProto.FromString(self.model.serialized_model_proto())
        how = model.normalizer_spec
        plain = not how.precompiled_charsmap and how.add_dummy_prefix and how.escape_whitespaces and not how.remove_extra_whitespaces
        return plain and model.trainer_spec.model_type == 2 and not any(p.type == 4 for p in model.pieces)  # BPE; no user-defined pieces

    def _ids(self, unit: str) -> bytes:
        return self.space if unit == " " else np.array(self.model.encode(unit[1:], num_threads=1), "<u4").tobytes()

    def __missing__(self, unit: str) -> bytes:
        if (ids := self.older.get(unit)) is None:
            ids = self._ids(unit)
        if len(unit) <= UNIT_CHARS:
            self[unit] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not self.by_unit or "▁" in text:  # it stands for a space, and merges with those of the next word
            return self._ids(text)
        if len(self) > self.half:
            self.older = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, UNITS.findall(text)))


@dataclass
class Alignment:
    """Two rows of tokens over the same bytes, given the tokens' byte lengths (all above 0)."""

    a: np.ndarray
    b: np.ndarray

    def __post_init__(self):
        self.owner_a = np.repeat(np.arange(len(self.a), dtype=np.int32), self.a)
        self.owner_b = np.repeat(np.arange(len(self.b), dtype=np.int32), self.b)
        self.change_a = np.append(self.owner_a[1:] != self.owner_a[:-1], True)[: len(self.owner_a)]
        self.change_b = np.append(self.owner_b[1:] != self.owner_b[:-1], True)[: len(self.owner_b)]

    @cached_property
    def overlaps(self) -> tuple[np.ndarray, np.ndarray]:
        """(A token, B token) pairs that share a byte, in order."""
        at = np.flatnonzero(self.change_a | self.change_b)
        return self.owner_a[at], self.owner_b[at]

    @cached_property
    def cuts(self) -> np.ndarray:
        """The last byte of each group; the tokens that own it end together."""
        return np.flatnonzero(self.change_a & self.change_b)

    @cached_property
    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(A token, B token) pairs that end together."""
        return self.owner_a[self.cuts], self.owner_b[self.cuts]

    @cached_property
    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """The group of each A token and of each B token."""
        last_a, last_b = self.links
        return tuple(np.repeat(np.arange(len(last)), np.diff(last, prepend=-1)) for last in (last_a, last_b))


class Aligner:
    """Both tokenizers of a Python worker."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = PlainEncoder(path_a), PieceEncoder(path_b)
        self.size_a, self.size_b = (np.array([len(t) for t in e.token_bytes], np.int64) for e in (self.a, self.b))

    def ids(self, text: str | None) -> tuple[bytes, bytes]:
        """Ids of A and of B of space + text as little-endian unsigned 32-bit numbers; none where their bytes aren't the text's."""
        if not text:
            return b"", b""
        text = " " + text
        a, b, raw = self.a.encode(text), self.b.encode(text), text.encode()
        for ids, encoder in ((a, self.a), (b, self.b)):
            if b"".join(map(encoder.token_bytes.__getitem__, memoryview(ids).cast("I").tolist())) != raw:
                return b"", b""
        return a, b

    @cached_property
    def words(self) -> list[bytes]:
        """The decimal form of every id, followed by ',', '|', ';' or nothing: at 4 * id + 0 to 3."""
        return [b"%d%s" % (i, c) for i in range(max(len(self.size_a), len(self.size_b))) for c in (b",", b"|", b";", b"")]

    def codes(self, al: Alignment, a: np.ndarray, b: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Places in words of all tokens, group by group; last: the last B tokens of documents."""
        ga, gb = al.groups
        ends_a, ends_b = al.links
        out = np.empty(len(a) + len(b), np.int64)
        # Before a token of group g stand all tokens of the groups before it, and A's of its own group if it is of B.
        before_b = np.concatenate([[0], ends_b[:-1] + 1])
        kind_a, kind_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        kind_a[ends_a], kind_b[ends_b] = 1, 2
        kind_b[last] = 3
        out[np.arange(len(a)) + before_b[ga]] = a * 4 + kind_a
        out[np.arange(len(b)) + (ends_a + 1)[gb]] = b * 4 + kind_b
        return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each pair of files and Python worker."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _chunks(batches, al: Aligner, most: int):
    """(keys, ids of A, token bounds of A, ids of B, token bounds of B) of about `most` bytes of text each, whole texts."""

    def made(rows):
        keys, a, b = zip(*rows)
        bounds = [np.concatenate([[0], np.cumsum([len(x) // 4 for x in side])]).astype(np.int64) for side in (a, b)]
        return list(keys), np.frombuffer(b"".join(a), "<u4").astype(np.int64), bounds[0], np.frombuffer(b"".join(b), "<u4").astype(np.int64), bounds[1]

    for batch in batches:
        rows, size = [], 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            rows.append((key, *al.ids(text)))
            size += len(text or "")
            if size >= most:
                yield made(rows)
                rows, size = [], 0
        if rows:
            yield made(rows)


def _lists(values: np.ndarray, bounds: np.ndarray, kind=pa.int64()) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def alignments(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a_ids, b_ids, a_group, b_group, overlap_a, overlap_b of every row.

    a_group and b_group give the group of each token; overlap_a and overlap_b
    the places of tokens that share a byte. Null and empty texts, and those that
    a tokenizer doesn't give back byte by byte, have empty lists.
    """
    path_a, path_b = path_a or default_tokenizer(), path_b or default_pieces()
    names = ["doc_id", "a_ids", "b_ids", "a_group", "b_group", "overlap_a", "overlap_b"]

    def run(batches):
        al = aligner(path_a, path_b)
        for keys, a, at_a, b, at_b in _chunks(batches, al, 1 << 20):
            found = Alignment(al.size_a[a], al.size_b[b])
            (ga, gb), (oa, ob) = found.groups, found.overlaps
            doc_a = np.repeat(np.arange(len(keys)), np.diff(at_a))
            doc_b = np.repeat(np.arange(len(keys)), np.diff(at_b))
            at_o = np.concatenate([[0], np.cumsum(np.bincount(doc_a[oa], minlength=len(keys)))])
            first = np.concatenate([ga, [0]])[np.minimum(at_a[:-1], max(len(ga) - 1, 0))]  # a document's first group
            cols = [_lists(a, at_a), _lists(b, at_b), _lists(ga - first[doc_a], at_a), _lists(gb - first[doc_b], at_b), _lists(oa - at_a[doc_a[oa]], at_o), _lists(ob - at_b[doc_b[ob]], at_o)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *cols], names)

    with settings(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="1000"):
        return cut(_texts(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, " + ", ".join(f"{n} array<bigint>" for n in names[1:])), "alignments")


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def aligned_digests(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of every row.

    Texts are encoded once. Each document's linked id pairs are written with
    their multiplicity; a block of documents, of about BLOCK bytes, then gets the
    corpus-wide counts of its own distinct pairs in one group, so neither a
    common pair nor the whole table of counts meets one task.
    """
    path_a, path_b = path_a or default_tokenizer(), path_b or default_pieces()
    names = ["block", "doc_id", *COUNTS, "groups_sha256", "pairs", "times"]
    vocabulary = len(aligner(path_a, path_b).size_b)

    def run(batches):
        from pyspark import TaskContext

        al, block, held = aligner(path_a, path_b), TaskContext.get().partitionId() << 32, 0
        words = al.words
        for keys, a, at_a, b, at_b in _chunks(batches, al, 1 << 20):
            n = len(keys)
            found = Alignment(al.size_a[a], al.size_b[b])
            link_a, link_b = found.links
            doc = np.repeat(np.arange(n), np.diff(at_a))[link_a]
            links = np.bincount(doc, minlength=n)
            digests = [""] * n
            if len(a):
                full = np.flatnonzero(np.diff(at_b))
                codes = al.codes(found, a, b, at_b[full + 1] - 1)
                for k in full.tolist():
                    part = codes[at_a[k] + at_b[k] : at_a[k + 1] + at_b[k + 1]]
                    digests[k] = hashlib.sha256(b"".join(map(words.__getitem__, part.tolist()))).hexdigest()
            pair = a[link_a] * vocabulary + b[link_b]
            order = np.lexsort((pair, doc))
            doc, pair = doc[order], pair[order]
            first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1]))[: len(pair)])
            times = np.diff(np.append(first, len(pair)))
            bounds = np.concatenate([[0], np.cumsum(np.bincount(doc[first], minlength=n))])
            numbers = [np.diff(at_a), np.diff(at_b), links, links]  # one A and one B token end at the end of a group
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(keys, pa.int64()), *(pa.array(x, pa.int64()) for x in numbers), pa.array(digests), _lists(pair[first], bounds), _lists(times, bounds)], names)
            held += int(al.size_a[a].sum())
            if held >= BLOCK:
                block, held = block + 1, 0

    kinds = ["bigint", "bigint", *["bigint"] * len(COUNTS), "string", "array<bigint>", "array<bigint>"]
    with settings(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="1000"):
        rows = cut(_texts(docs, id_col, text_col).mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds))), "aligned")
    return _counted(rows, vocabulary)


def _counted(rows: DataFrame, vocabulary: int) -> DataFrame:
    """Adds n_best and count_sum to rows of aligned documents, by block."""
    each = rows.select("block", F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy("block", F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("times"))
    each = cut(each, "aligned-pairs")
    counts = each.groupBy("pair").agg(F.sum("times").alias("count")).withColumn("b", F.col("pair") % vocabulary)
    counts = cut(counts, "aligned-counts")
    best = counts.groupBy("b").agg(F.max("count").alias("most"))  # a row for each id of B at most
    known = counts.join(best, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    own = each.select("block", "pair").join(known, "pair")
    out = ["doc_id", *COUNTS, "groups_sha256", "n_best", "count_sum"]

    def judged(_, left: pa.Table, right: pa.Table) -> pa.Table:
        pair, count, best = (right.column(c).to_numpy() for c in ("pair", "count", "best"))
        order = np.argsort(pair)
        pairs, times = (left.column(c).combine_chunks() for c in ("pairs", "times"))
        doc = np.repeat(np.arange(len(pairs)), np.diff(pairs.offsets.to_numpy()))
        at = order[np.searchsorted(pair, pairs.flatten().to_numpy(), sorter=order)] if len(doc) else np.empty(0, np.int64)
        times = times.flatten().to_numpy()
        sums = []
        for value in (best[at].astype(np.int64) * times, count[at] * times):
            ends = np.concatenate([[0], np.cumsum(value)])
            edge = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(pairs)))])
            sums.append(pa.array(ends[edge[1:]] - ends[edge[:-1]], pa.int64()))
        return pa.table([*(left.column(c) for c in out[:-2]), *sums], out)

    return rows.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(judged, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", groups_sha256 string, n_best bigint, count_sum bigint")


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    """Alignment digests of all documents: byte-level BPE against pieces with byte fallback.

    Null and empty texts have zeros and an empty digest, so have texts that a
    tokenizer changes; repeated ids stay rows of their own; an empty table gives no rows.
    """
    return aligned_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
