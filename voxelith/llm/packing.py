"""Packing of token sequences by multiway differencing (operator 3).

Documents are cut into whole windows and a rest. The rests of a batch are
partitioned by the largest differencing method (Karmarkar and Karp 1982): every
rest starts as a partial partition with one occupied slot; the two partial
partitions of the largest imbalance merge, the fullest slot of one meeting the
emptiest of the other. If the fullest window exceeds the capacity, the number of
windows rises by one and the batch is done again. The little room that near-equal
windows leave is filled with the ids of the documents that follow.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import KEPT_PIECES, default_tokenizer, encoder


def difference(sizes, k: int) -> list[list[int]]:
    """Partitions the items into k groups of near-equal sums; returns item numbers by group.

    Ties go to the partial partition made first, so the result depends on the sizes and their order alone.
    """
    if not len(sizes):
        return [[] for _ in range(k)]
    joins: list[tuple[int, int]] = []  # node n + i has these two nodes; -1 is an empty slot
    n = len(sizes)
    heap = []
    for i, s in enumerate(sizes):
        slots, nodes = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        slots[0], nodes[0] = s, i
        heap.append((-int(s) if k > 1 else 0, i, slots, nodes))
    heapq.heapify(heap)
    made = n
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        slots, y = a + b[::-1], y[::-1]
        nodes = np.where(x >= 0, x, y)
        for i in np.flatnonzero((x >= 0) & (y >= 0)):
            joins.append((int(x[i]), int(y[i])))
            nodes[i] = n + len(joins) - 1
        order = np.argsort(-slots, kind="stable")
        slots, nodes = slots[order], nodes[order]
        heapq.heappush(heap, (-int(slots[0] - slots[-1]), made, slots, nodes))
        made += 1
    groups = []
    for node in heap[0][3].tolist():
        group, todo = [], [node] if node >= 0 else []
        while todo:
            v = todo.pop()
            if v < n:
                group.append(v)
            else:
                todo += joins[v - n]
        groups.append(sorted(group))
    return groups


def fit_windows(pieces: list[tuple], capacity: int, least: int = 1) -> list[list[tuple]]:
    """Pieces (key, start, length) in near-equal windows, none over capacity: at least `least`, more while one is exceeded."""
    sizes = [p[2] for p in pieces]
    k = max(least, -(-sum(sizes) // capacity))
    while True:
        groups = difference(sizes, k)
        if max(sum(sizes[i] for i in g) for g in groups) <= capacity:
            return [[pieces[i] for i in g] for g in groups if g]
        k += 1


class Packer:
    """Takes documents one by one, gives finished windows (lists of (key, start, length)).

    A batch is done when its rests fill the share `fill` of so many windows;
    below 1 the windows mostly needn't rise in number.
    """

    def __init__(self, capacity: int = 1024, windows: int = 64, fill: float = 0.94):
        self.capacity, self.windows, self.limit = capacity, windows, int(fill * windows * capacity)
        self.rests: list[tuple] = []
        self.held = 0
        self.open: list[tuple[int, list[tuple]]] = []  # room, window

    def add(self, key, length: int) -> list[list[tuple]]:
        out, start = self._fill(key, 0, length)
        while length - start >= self.capacity:
            out.append([(key, start, self.capacity)])
            start += self.capacity
        if start < length:
            self.rests.append((key, start, length - start))
            self.held += length - start
        if self.held >= self.limit:
            out += self._batch(self.windows)
        return out

    def _fill(self, key, start: int, length: int) -> tuple[list[list[tuple]], int]:
        """Windows that the ids from start on make full, and where the ids that are left start."""
        out = []
        while self.open and start < length:
            room, window = self.open.pop()
            moved = min(length - start, room)
            window.append((key, start, moved))
            start += moved
            if moved == room:
                out.append(window)
            else:
                self.open.append((room - moved, window))
        return out, start

    def _batch(self, least: int = 1) -> list[list[tuple]]:
        """The full windows of the rests; the others are open."""
        out = []
        for w in fit_windows(self.rests, self.capacity, least):
            room = self.capacity - sum(p[2] for p in w)
            if room:
                self.open.append((room, w))
            else:
                out.append(w)
        self.rests, self.held = [], 0
        return out

    def close(self) -> list[list[tuple]]:
        """The last batch. The emptiest windows go to fill the others; what is left, less than a window, is cut to powers of two."""
        out = self._batch() if self.rests else []
        self.open.sort(key=lambda w: -w[0])
        pieces: list[tuple] = []
        while self.open:
            pieces += self.open.pop(0)[1]
            while pieces and self.open:
                key, start, length = pieces.pop()
                full, rest = self._fill(key, start, start + length)
                out += full
                if rest < start + length:
                    pieces.append((key, rest, start + length - rest))
        left = sum(p[2] for p in pieces)
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            window = []
            while size:
                key, start, length = pieces.pop()
                moved = min(length, size)
                if moved < length:
                    pieces.append((key, start + moved, length - moved))
                window.append((key, start, moved))
                size -= moved
            out.append(window)
        return out


PIECE_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)


def pack(docs: DataFrame, capacity: int = 1024, windows: int = 64, fill: float = 0.94, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Each id of each document, end_id included, lies in exactly one piece.
    Sequences have capacity ids; the last of a partition, with less than capacity
    ids together, have powers of two, so none is padded.
    Null and empty texts have end_id alone; a null id stays null; rows with the
    same id are documents of their own. An empty table gives no rows. Packing
    is local to a partition: no shuffle, and memory holds two batches of rests and the current document.
    """
    tokenizer = tokenizer or default_tokenizer()

    def run(batches):
        from pyspark import TaskContext

        enc, packer = encoder(tokenizer, KEPT_PIECES // 2), Packer(capacity, windows, fill)
        end = np.array([end_id], "<u4").tobytes()
        sequence, number = TaskContext.get().partitionId() << 40, 0
        held: dict[int, list] = {}  # row number -> doc_id, ids, ids not yet given out

        def rows(windows):
            nonlocal sequence
            out: list[list] = [[] for _ in PIECE_SCHEMA.names]
            for window in windows:
                at = 0
                for key, start, length in window:
                    doc = held[key]
                    for column, value in zip(out, (doc[0], start, length, doc[1][4 * start : 4 * (start + length)], len(doc[1]) // 4, sequence, at)):
                        column.append(value)
                    at += length
                    doc[2] -= length
                    if not doc[2]:
                        del held[key]
                sequence += 1
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], PIECE_SCHEMA.names)

        done, size = [], 0
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = enc.encode(text.as_py()) + end
                held[number] = [key, ids, len(ids) // 4]
                full = packer.add(number, len(ids) // 4)
                number += 1
                done += full
                size += len(full)
                if size >= 512:
                    yield rows(done)
                    done, size = [], 0
        done += packer.close()
        if done:
            yield rows(done)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECE_SCHEMA)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with the crc32 of their ids."""
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
