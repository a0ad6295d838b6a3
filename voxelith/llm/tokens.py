"""Token ids of whole texts, and Parquet files of token lists (operator 5).

TokenEncoder gives the ids of the tokenizers library for a byte-level BPE file,
as little-endian unsigned 32-bit integers. Most pieces repeat, so the ids of
each pre-token are kept and only unseen pre-tokens go to the library's model.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.tables import settings
from .common import maybe_broadcast, shared_path, write_parquet

#: Fixed value: the pre-token pattern of the byte-level vocabulary, written out for texts without the characters of
#: UNSAFE: letters below U+0250, ASCII digits, the white space that is left.
_LETTER, _SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", " \t\n\x0b\x0c\r\x85\xa0"
PIECES = re.compile(f" ?[{_LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^{_SPACE}{_LETTER}0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")

#: Characters whose class differs between regex engines or Unicode versions; such texts go to the library whole.
SEPARATORS = "\x1c\x1d\x1e\x1f"
UNSAFE = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe]|[^\x00-ɏ‐-‧‰-⁞₠-₿]")

#: Kept pre-tokens of each Python worker, in two halves of about 150 bytes each: when the newer half is full it
#: becomes the older one, and what is used from there moves up.
KEPT_PIECES = 800_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class TokenEncoder(dict):
    """Pre-token -> bytes of its ids. encode(text) -> bytes of all ids.

    Texts with the string of an added token go to the library whole. Null and empty texts have no ids.
    """

    def __init__(self, path: str, kept: int = KEPT_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.half, self.older, self.model = kept // 2, {}, self.tokenizer.model
        plain = isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) and self.tokenizer.normalizer is None
        self.by_piece = plain and not self.tokenizer.pre_tokenizer.add_prefix_space
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.older.get(piece)) is not None:
            self[piece] = ids
            return ids
        found = self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
        ids = array("I", [t.id for t in found])
        if sys.byteorder == "big":
            ids.byteswap()
        out = self[piece] = ids.tobytes()
        return out

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        unsafe = any(c in text for c in SEPARATORS) if text.isascii() else UNSAFE.search(text)
        if not self.by_piece or unsafe or any(a in text for a in self.added):
            (e,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
            return np.array(e.ids, "<u4").tobytes()
        if len(self) > self.half:
            self.older = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, PIECES.findall(text)))


_ENCODERS: dict[tuple[str, int], TokenEncoder] = {}


def encoder(path: str, kept: int = KEPT_PIECES) -> TokenEncoder:
    """One encoder for each file (and number of kept pre-tokens) and Python worker."""
    if (path, kept) not in _ENCODERS:
        _ENCODERS[path, kept] = TokenEncoder(path, kept)
    return _ENCODERS[path, kept]


FILE_SCHEMA = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("first", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
    ]
)

#: Writer settings: small row groups and pages with column and offset indexes, so a reader can fetch a range of
#: documents or only the counts; version 2 gives delta encoding to integers that don't fit a dictionary.
FILE_OPTIONS = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "compression": "zstd",
}


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", max_list: int = 1 << 20) -> None:
    """Writes one row per document, in ascending id order across files: part, doc_id, first, n_tokens, ids.

    part numbers the files in id order; first counts the ids before the document
    in its part. Each document ends with end_id; a null or empty text has only
    that. Null ids come first, repeated ids stay as rows of their own, ordered by
    text. A range shuffle orders the texts; no task sees more than its range.
    max_list bounds the ids that are handed to the JVM at once, unless one document has more.
    """
    tokenizer = tokenizer or default_tokenizer()

    def encode(batches):
        from pyspark import TaskContext

        part, first, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()

        def made(rows):
            values = np.frombuffer(b"".join(r[2] for r in rows), "<i4")
            sizes = np.array([len(r[2]) // 4 for r in rows], np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            cols = [pa.array([part] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(sizes)]
            return pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], FILE_SCHEMA.names)

        for batch in batches:
            rows, size = [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.encode(text.as_py()) + end
                rows.append((key, first, ids))
                first += len(ids) // 4
                size += len(ids) // 4
                if size >= max_list:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    with settings(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="1000"):
        write_parquet(ordered.mapInArrow(encode, FILE_SCHEMA), path, **FILE_OPTIONS)


def read_token_files(spark, path: str) -> DataFrame:
    """The written rows, with start: the ids of all documents before this one.

    Counts come from the narrow columns alone; ids are read only if selected.
    """
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("base"))
    return rows.join(maybe_broadcast(base), "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids")


def ids_crc32(rows: DataFrame) -> DataFrame:
    """Replaces the list column ids by ids_crc32, of its little-endian unsigned 32-bit form."""
    kept = [f for f in rows.schema.fields if f.name != "ids"]
    schema = T.StructType([*kept, T.StructField("ids_crc32", T.LongType())])
    names = [f.name for f in kept]

    def digest(batches):
        for batch in batches:
            ids = batch.column("ids")
            values, off = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(crc, pa.int64())], [*names, "ids_crc32"])

    return rows.select(*names, "ids").mapInArrow(digest, schema)


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from token files written in the shared folder."""
    path = shared_path(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return ids_crc32(read_token_files(spark, path))
