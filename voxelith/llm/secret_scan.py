"""Secrets in plain and encoded text, by a recursive decoding worklist (operator 9).

A text is the first layer. Every layer of text is searched for secrets and
unwrapped: percent-encoding and Unicode escapes give one new layer for the whole
layer, each base64 run (also one wrapped over lines) a layer of bytes. Bytes are
decompressed into new bytes, or read as text. New layers, of either kind, go on
the worklist until none is left; a layer seen before at the same place is a cycle
and is not taken again. Large compressed layers are read as a stream of
overlapping blocks. Spans found in a layer are mapped to the text.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds in their order, their patterns and least lengths (of group 2 for assign, else of the match).
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: An escaped escape character (%25, \\u005c) and what it escapes count as one: a chain of them is one step, not one layer each.
PERCENT = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+")
PERCENT_CHAIN = re.compile(r"%(?:25)+(?=[0-9A-Fa-f]{2})")
ESCAPES = re.compile(r"(?:\\(?:u005[Cc]|x5[Cc])*(?:u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|u\{[0-9A-Fa-f]{1,6}\}|x[0-9A-Fa-f]{2}))+")
ESCAPE = re.compile(r"\\(?:(?:u005[Cc]|x5[Cc])*(?=[uUx]))(?:u\{([0-9A-Fa-f]{1,6})\}|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")

#: Base64 lines that follow one another; the first may start within its line.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{4,}+(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]++)+={0,2}")
PIECE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")

#: Bytes of a block of a compressed layer, and characters that a block shares with the next one.
LAYER_BYTES, SHARED = 16 << 20, 4 << 20
#: Bytes read at once.
CHUNK = 1 << 20
#: Bytes that aren't UTF-8 are text with up to one in so many characters replaced. In others, stretches of characters are text:
#: no secret and no encoded run is shorter than 16 of them.
LOSSY = 8
STRETCH = re.compile(rb"[\t\n\r\x20-\x7e]{16,}|(?:[\t\n\r\x20-\x7e]\x00){16,}")
#: Where compressed content may begin within other bytes: heads of gzip, zlib, bzip2, xz and zstandard.
HEADS = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
#: Characters of a run over several lines from which on it is decoded at all four alignments.
LONG_RUN = 64
#: What ends an encoded run. If the characters that two blocks share have none, a run may be cut. What is plain in it is found all
#: the same, as runs are read at every alignment; a compressed layer in such a run isn't: counted in n_unopened.
BREAK = re.compile(r"[^A-Za-z0-9+/_%\\{}\s-]|\S[ \t]+[^\s]")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every match in the text itself: leftmost, not overlapping within a kind."""
    found = []
    lowered = text.encode("utf-8", "surrogatepass").lower()
    if any(k in lowered for k in KEYWORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def codec_of(head: bytes) -> str:
    """utf-16-le or -be for bytes with such a mark, or with NULs in every other place; else utf-8."""
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16-le" if head[:1] == b"\xff" else "utf-16-be"
    nulls = [head[k::2].count(0) for k in (0, 1)]
    if max(nulls) * 5 > len(head) and min(nulls) * 20 <= len(head) and len(head) >= 8:
        return "utf-16-le" if nulls[1] > nulls[0] else "utf-16-be"
    return "utf-8"


def as_text(data: bytes) -> str | None:
    """The text that bytes hold, a few bad characters replaced; None if they look like no text."""
    text = data.decode(codec_of(data[:1024]), "replace")
    bad = text.count("\ufffd")
    return text if len(text) >= 4 and bad * LOSSY <= len(text) else None


class Reader:
    """Chunks of bytes as a file with a look ahead."""

    def __init__(self, chunks):
        self.chunks, self.rest = iter(chunks), b""

    def peek(self, n: int) -> bytes:
        while len(self.rest) < n and (more := next(self.chunks, None)) is not None:
            self.rest += more
        return self.rest[:n]

    def read(self, n: int) -> bytes:
        self.peek(1)
        out, self.rest = self.rest[:n], self.rest[n:]
        return out


def _decompressor(head: bytes):
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if len(head) > 2 and head[0] & 15 == 8 and (head[0] * 256 + head[1]) % 31 == 0:
        return zlib.decompressobj()
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def content(chunks, bare: bool = False) -> Iterator[bytes]:
    """The content of compressed bytes in chunks, member after member; none if they aren't such. A damaged end is left out.

    bare: a deflate stream without a head.
    """
    source = Reader(chunks)
    try:
        while True:
            head = source.peek(6)
            if head[:4] == b"\x28\xb5\x2f\xfd" and not bare:
                with zstandard.ZstdDecompressor().stream_reader(source, read_size=CHUNK, read_across_frames=True) as reader:
                    while out := reader.read(CHUNK):
                        yield out
                return
            step = zlib.decompressobj(-15) if bare else _decompressor(head)
            if step is None:
                return
            data = source.read(CHUNK)
            while True:
                out = step.decompress(data, CHUNK)
                if out:
                    yield out
                if step.eof:
                    break
                tail = getattr(step, "unconsumed_tail", b"")
                data = tail or (source.read(CHUNK) if getattr(step, "needs_input", True) else b"")
                if not data and not out:
                    return
            if bare:
                return
            source.rest = (step.unused_data + source.rest).lstrip(b"\0")
    except (zlib.error, lzma.LZMAError, zstandard.ZstdError, OSError, EOFError, ValueError):  # bytes that only look compressed
        return


def _is_bare(data: bytes) -> bool:
    """Whether all of the bytes are one deflate stream without a head."""
    step = zlib.decompressobj(-15)
    try:
        rest, size = data, 0
        while rest and not step.eof:
            size += len(step.decompress(rest, CHUNK))
            rest = step.unconsumed_tail
        return step.eof and not step.unused_data and size >= 4
    except zlib.error:
        return False


def inflated(data: bytes, depth: int, bare: bool = False) -> Iterator[bytes]:
    """What is left of the data after `depth` decompressions, in chunks."""
    chunks: Iterator[bytes] = iter([data])
    for k in range(depth):
        chunks = content(chunks, bare and k == 0)
    return chunks


def _head(chunks: Iterator[bytes], size: int) -> bytes:
    """The first chunks, until they have more than size bytes."""
    out = bytearray()
    for chunk in chunks:
        out += chunk
        if len(out) > size:
            break
    return bytes(out)


def _digest(chunks: Iterator[bytes]) -> bytes:
    state = hashlib.blake2b(digest_size=16)
    for chunk in chunks:
        state.update(chunk)
    return state.digest()


def stretches(data: bytes, span: tuple[int, int]) -> Iterator[Raw | Layer]:
    """Text and compressed content within bytes that are neither as a whole."""
    for m in STRETCH.finditer(data):
        yield Layer(m[0].replace(b"\0", b"").decode("ascii"), span=span)
    for m in HEADS.finditer(data, 1):
        if next(content([data[m.start() :]]), b""):
            yield Raw(data[m.start() :], span)


def opened(raw: Raw, unopened: list[tuple[int, int]]) -> Iterator[Raw | Layer]:
    """The layers straight below bytes: their content if they are compressed, else their text, else what text and compressed content is in them."""
    data, span = raw.data, raw.span
    bare = False
    inner = b"" if raw.shifted else _head(inflated(data, 1), LAYER_BYTES)
    if not inner:
        if not raw.shifted and (text := as_text(data)) is not None:
            yield Layer(text, span=span)
            if "\ufffd" not in text:
                return
        bare = not raw.shifted and _is_bare(data)
        inner = _head(inflated(data, 1, True), LAYER_BYTES) if bare else b""
    if not inner:
        yield from stretches(data, span)
        return
    depth, passed = 1, set()
    while len(inner) > LAYER_BYTES:
        below = _head(inflated(data, depth + 1, bare), LAYER_BYTES)
        if not below:
            for block in _blocks(inflated(data, depth, bare), unopened, span) if as_text(inner) is not None else _byte_blocks(inflated(data, depth, bare)):
                yield Layer(block, span=span) if isinstance(block, str) else Raw(block, span, True)
            return
        if (mark := _digest(inflated(data, depth, bare))) in passed:  # content that holds itself
            return
        passed.add(mark)
        inner, depth = below, depth + 1
    if inner:
        yield Raw(inner, span)


def _byte_blocks(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Overlapping blocks of bytes that are no text."""
    held = b""
    for chunk in chunks:
        held += chunk
        if len(held) >= LAYER_BYTES:
            yield held
            held = held[-SHARED:]
    yield held


def _blocks(chunks: Iterator[bytes], unopened: list[tuple[int, int]], span: tuple[int, int]) -> Iterator[str]:
    first = next(chunks, b"")
    decoder, parts, size, cut = codecs.getincrementaldecoder(codec_of(first[:1024]))("replace"), [], 0, False
    for chunk in chain([first], chunks):
        parts.append(decoder.decode(chunk))
        size += len(parts[-1])
        if size >= LAYER_BYTES:
            text = "".join(parts)
            parts = [text[-SHARED:]]
            size = len(parts[0])
            cut = cut or not BREAK.search(parts[0])
            yield text
    yield "".join(parts)
    if cut:
        unopened.append(span)


def wrapped_runs(text: str) -> Iterator[tuple[str, int, int]]:
    """Base64 runs over several lines, joined, with their places.

    Lines of an encoding are equally long but for the last one, and the first
    one where it shares its line; next to it may stand lines that only look alike.
    """
    for m in WRAPPED.finditer(text):
        pieces = [p.span() for p in PIECE.finditer(text, *m.span())]
        sizes = [b - a for a, b in pieces]
        n, i, tried = len(pieces), 0, {(0, len(pieces))}
        while i < n:
            k = i
            while k + 1 < n and sizes[k + 1] == sizes[i]:
                k += 1
            after = k + 2 if k + 1 < n and sizes[k + 1] < sizes[i] + 3 else k + 1
            tried.update((first, last) for first in (max(i - 1, 0), i) for last in (k + 1, after) if last - first > 1)
            i = k + 1
        for first, last in sorted(tried):
            run = "".join(text[a:b] for a, b in pieces[first:last])
            if len(run) >= 16:
                yield run, pieces[first][0], pieces[last - 1][1]


class Raw:
    """Decoded bytes and the span that they come from; shifted: they may begin with bytes that aren't of the content."""

    def __init__(self, data: bytes, span: tuple[int, int], shifted: bool = False):
        self.data, self.span, self.shifted = data, span, shifted

    def mark(self) -> tuple:
        return hashlib.blake2b(self.data, digest_size=16).digest(), self.span, self.shifted


class Layer:
    """Decoded text; where its characters come from: starts and ends by character, or one span for all."""

    def __init__(self, text: str, starts=None, ends=None, span=None):
        self.text, self.starts, self.ends, self.span = text, starts, ends, span

    def mark(self) -> tuple:
        return hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), self.span

    def place(self, start: int, end: int) -> tuple[int, int]:
        if self.span:
            return self.span
        if self.starts is None:
            return start, end
        return int(self.starts[start]), int(self.ends[end - 1])

    def replaced(self, parts: list[tuple[int, int, str]]) -> Layer:
        """The layer with each (start, end, new text) put in place of the old."""
        if self.span:
            out, at = [], 0
            for a, b, new in parts:
                out += [self.text[at:a], new]
                at = b
            return Layer("".join([*out, self.text[at:]]), span=self.span)
        n = len(self.text)
        starts = np.arange(n) if self.starts is None else self.starts
        ends = np.arange(1, n + 1) if self.ends is None else self.ends
        text, first, last, at = [], [], [], 0
        for a, b, new in parts:
            text += [self.text[at:a], new]
            first += [starts[at:a], np.full(len(new), starts[a])]
            last += [ends[at:a], np.full(len(new), ends[b - 1])]
            at = b
        return Layer("".join([*text, self.text[at:]]), np.concatenate([*first, starts[at:]]), np.concatenate([*last, ends[at:]]))


def unwrapped(layer: Layer) -> Iterator[Layer | Raw]:
    """The layers one step below a text."""
    text = layer.text
    if "%" in text:
        parts = []
        for m in PERCENT.finditer(text):
            data = bytes.fromhex(PERCENT_CHAIN.sub("%", m[0]).replace("%", ""))
            parts.append((*m.span(), data.decode("utf-8", "replace")))
            if "\ufffd" in parts[-1][2]:
                yield Raw(data, layer.place(*m.span()))
        if parts:
            yield layer.replaced(parts)
    if "\\" in text:
        parts = []
        for m in ESCAPES.finditer(text):
            points = [int("".join(found), 16) for found in ESCAPE.findall(m[0])]
            if max(points) < 0x110000:
                new = b"".join(p.to_bytes(2, "big") if p < 0x10000 else chr(p).encode("utf-16-be") for p in points)
                parts.append((*m.span(), new.decode("utf-16-be", "replace")))
        if parts:
            yield layer.replaced(parts)
    # What stands straight before an encoding (a path, a label with - or _, letters) is of its alphabet: its groups of four
    # may begin at any character, so a run is read from each of its first four. From the right one on the bytes are right.
    runs = ((m[0], *m.span(), 4) for m in BASE64.finditer(text))
    lines = ((run, a, b, 4 if len(run) >= LONG_RUN else 1) for run, a, b in wrapped_runs(text)) if "\n" in text else ()
    for run, start, end, ways in chain(runs, lines):
        run = run.rstrip("=").replace("-", "+").replace("_", "/")
        for k in range(ways):
            part = run[k : len(run) - ((len(run) - k) % 4 == 1)]
            data = base64.b64decode(part + "=" * (-len(part) % 4))
            if k == 0 or STRETCH.search(data) or HEADS.search(data):
                yield Raw(data, layer.place(start, end), k > 0)
                if k and HEADS.match(data):
                    yield Raw(data, layer.place(start, end))


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], int]:
    """Spans in the text itself, all spans, and how many layers weren't read whole; each list by start, then kind, then end."""
    base, spans, unopened = searched(text)
    return base, spans, len(unopened)


def searched(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], list[tuple[int, int]]]:
    """As scan, with the spans of the layers that weren't read whole."""
    if not text:
        return [], [], []
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(base_spans(text), key=order)
    found, unopened, seen = set(base), [], set()
    work = [unwrapped(Layer(text))]  # depth first: of a large layer only one block is held
    seen.add((hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), None))
    while work:
        x = next(work[-1], None)
        if x is None:
            work.pop()
            continue
        if (mark := x.mark()) in seen:
            continue
        seen.add(mark)
        if isinstance(x, Raw):
            below = opened(x, unopened)
            x = None  # of nested bytes only the last are held
            work.append(below)
        elif x.text:
            found.update((k, *x.place(a, b)) for k, a, b in base_spans(x.text))
            work.append(unwrapped(x))
    return base, sorted(found, key=order), unopened


def redacted(text: str, spans: list[tuple[str, int, int]], mask: str = "[SECRET]") -> str:
    """The text with mask in place of every maximal run of overlapping spans."""
    out, at = [], 0
    runs: list[list[int]] = []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if runs and a < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    for a, b in runs:
        out += [text[at:a], mask]
        at = b
    return "".join([*out, text[at:]])


def masked(text: str) -> str:
    """The text without secrets, and without encoded runs that weren't read whole."""
    _, spans, unopened = searched(text)
    spans = spans + [("unopened", *s) for s in unopened]
    return redacted(text, spans) if spans else text


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
SCAN_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("base", T.ArrayType(SPAN)),
        T.StructField("spans", T.ArrayType(SPAN)),
        T.StructField("n_unopened", T.LongType()),
    ]
)
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end in code points; end exclusive), n_unopened of every row.

    base has the spans of the text itself, spans these and the ones of decoded
    layers. Null and empty texts have none; null ids stay null; repeated rows
    are rows of their own; an empty table gives none. No shuffle.
    """

    def run(batches):
        keys = ("kind", "start", "end")
        for b in batches:
            rows = [scan(t.as_py()) for t in b.column(1)]
            spans = [pa.array([[dict(zip(keys, s)) for s in r[i]] for r in rows], _SPANS) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *spans, pa.array([r[2] for r in rows], pa.int64())], SCAN_SCHEMA.names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, SCAN_SCHEMA)


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with every secret masked in the text, and length_col (if there) the new length. All rows and columns stay.

    An encoded run that can't be read whole (see scan) is masked too.
    """
    at = docs.columns.index(text_col)
    schema = docs.schema

    def run(batches):
        for b in batches:
            texts = [None if (t := x.as_py()) is None else masked(t) for x in b.column(at)]
            columns = list(b.columns)
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    out = docs.mapInArrow(run, schema)
    if length_col in docs.columns:
        kind = schema[length_col].dataType
        out = out.withColumn(length_col, F.length(text_col).cast(kind))
    return out


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Counts and digests of the spans of every document."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), "n_unopened")
