"""Shared helpers: hashing of the words of whole Arrow batches."""

from __future__ import annotations

import numpy as np

from ..plans.tables import BROADCAST_ROWS, cut, drop, maybe_broadcast, settings, shared_path, write_parquet  # noqa: F401

#: Whitespace that separates words: U+0020 and U+0009 to U+000D, nothing else.
WORD_SPACE = " \t\n\x0b\x0c\r"


# --- hashing of whole Arrow string batches with numpy -----------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


class WordHasher:
    """64-bit hashes of all words of a batch of UTF-8 texts, without a Python loop over words.

    A word's hash is a polynomial over random byte codes modulo 2**64, taken from
    prefix sums, mixed with the word's length. seed gives independent families.
    """

    def __init__(self, lower_ascii: bool = False, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.codes = rng.integers(1, 2**63, 256, dtype=np.uint64)
        if lower_ascii:
            self.codes[65:91] = self.codes[97:123]
        self.base = int(rng.integers(2**60, 2**63)) * 2 + 1
        self.inverse = pow(self.base, -1, 2**64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            for name, b in (("powers", self.base), ("inverses", self.inverse)):
                a = np.full(n, np.uint64(b % 2**64))
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))

    def words(self, data: np.ndarray, offsets: np.ndarray):
        """data: bytes of all texts; offsets: n + 1 text bounds in data.

        Returns word hashes, byte starts, byte ends, and n + 1 bounds of each
        text's words. Texts are never joined into one word across a bound.
        """
        n = len(data)
        space = np.ones(n + 1, bool)
        np.less_equal(np.abs(data.astype(np.int16) - 11), 2, out=space[:n])
        space[:n] |= data == 32
        inside = ~space[:n]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        begins = inside.copy()
        begins[1:] &= space[: n - 1] | first[1:n]
        starts = np.flatnonzero(begins)
        stops = inside & (space[1:] | first[1:])
        ends = np.flatnonzero(stops) + 1
        self._grow(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.codes[data] * self.powers[:n], out=sums[1:])
        raw = (sums[ends] - sums[starts]) * self.inverses[starts]
        hashes = mix64(raw + (ends - starts).astype(np.uint64))
        bounds = np.searchsorted(starts, offsets)
        return hashes, starts, ends, bounds


def ngram_hashes(words: np.ndarray, n: int, multiplier: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of each run of n consecutive words: len(words) - n + 1 values (may cross texts)."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    total, at, size, power = None, 0, 1, words
    m = multiplier % 2**64
    left = n
    while left:
        if left & 1:
            part = power[at:]
            total = part if total is None else total[: len(part)] + part * np.uint64(pow(m, at, 2**64))
            at += size
        left >>= 1
        if left:
            power = power[: len(power) - size] + power[size:] * np.uint64(pow(m, size, 2**64))
            size *= 2
    return mix64(total[: len(words) - n + 1])


def text_chunks(column, max_bytes: int = 1 << 21):
    """Cuts an Arrow string column into row ranges of about max_bytes (a longer text stands alone).

    Yields first row, last row + 1, bytes, and text bounds in them. Nulls count as empty.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    i = 0
    while i < len(column):
        j = int(np.searchsorted(off, off[i] + max_bytes, "right")) - 1
        j = min(max(j, i + 1), len(column))
        yield i, j, data[off[i] : off[j]], (off[i : j + 1] - off[i]).astype(np.int64)
        i = j
