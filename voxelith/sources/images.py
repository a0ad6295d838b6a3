"""Portable bitmap files and raw volumes, read and written as tables.

Files are read with Spark's binaryFile source, so any store that Spark reaches
will do; each file is decoded by one task into rows in bounded batches.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 1 << 16
IMAGE_SCHEMA = "path string, band int, y int, x int, val int"
VOLUME_SCHEMA = "path string, z int, y int, x int, val double"


def _table(path: str, cube: np.ndarray, names: list[str], kind):
    """Batches of path, the cube's subscripts and its values."""
    flat = cube.reshape(-1)
    for k in range(0, len(flat), ROWS):
        index = np.arange(k, min(k + ROWS, len(flat)))
        subs = np.unravel_index(index, cube.shape)
        yield pa.RecordBatch.from_arrays([pa.array([path] * len(index)), *(pa.array(s.astype(np.int32)) for s in subs), pa.array(flat[index], kind)], ["path", *names, "val"])


def decode_pnm(data: bytes) -> np.ndarray:
    """bands x rows x columns of a P1..P6 file; 1 is black in P1 and P4, as stored."""
    head = re.match(rb"P([1-6])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)", data)
    if not head:
        raise ValueError("not a portable bitmap")
    kind, w, h = int(head[1]), int(head[2]), int(head[3])
    at, top = head.end(), 1
    if kind not in (1, 4):
        more = re.compile(rb"(?:\s|#[^\n]*\n)+(\d+)").match(data, at)
        top, at = int(more[1]), more.end()
    bands = 3 if kind in (3, 6) else 1
    if kind == 1:
        v = np.array([c - 48 for c in re.sub(rb"#[^\n]*|\s", b"", data[at:])][: w * h])
    elif kind in (2, 3):
        v = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[: w * h * bands], int)
    elif kind == 4:
        rows = np.frombuffer(data, np.uint8, (w + 7) // 8 * h, at + 1).reshape(h, -1)
        v = np.unpackbits(rows, axis=1)[:, :w]
    else:
        v = np.frombuffer(data, ">u2" if top > 255 else np.uint8, w * h * bands, at + 1)
    return v.reshape(h, w, bands).transpose(2, 0, 1).astype(np.int32)


def encode_pnm(cube: np.ndarray, normalise: bool = False, binary: bool = True) -> bytes:
    """A grey (one band) or colour (three bands) file; normalise stretches values to 0..255."""
    cube = np.asarray(cube)
    if normalise:
        low, high = cube.min(), cube.max()
        cube = np.zeros_like(cube) if high == low else (cube - low) * 255 // (high - low)
    bands, h, w = cube.shape
    top = max(int(cube.max(initial=0)), 1)
    kind = {(1, True): 5, (1, False): 2, (3, True): 6, (3, False): 3}[bands, binary]
    v = cube.transpose(1, 2, 0).reshape(-1)
    body = v.astype(">u2" if top > 255 else np.uint8).tobytes() if binary else b" ".join(b"%d" % x for x in v.tolist())
    return b"P%d\n%d %d\n%d\n" % (kind, w, h, top) + body


def read_pnm(spark: SparkSession, path: str) -> DataFrame:
    """path, band, y, x, val of every pixel of every file."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                yield from _table(name, decode_pnm(data), ["band", "y", "x"], pa.int32())

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, IMAGE_SCHEMA)


def pnm_files(pixels: DataFrame, key: list[str], normalise: bool = False, binary: bool = True) -> DataFrame:
    """key, content: a file for each key from band, y, x, val (for one file per band, name band in key)."""
    import pandas as pd

    kinds = {f.name: f.dataType.simpleString() for f in pixels.schema.fields}
    schema = ", ".join(f"{k} {kinds[k]}" for k in key) + ", content binary"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        band = pdf["band"].to_numpy() - pdf["band"].min()
        cube = np.zeros((band.max() + 1, pdf["y"].max() + 1, pdf["x"].max() + 1), int)
        cube[band, pdf["y"], pdf["x"]] = pdf["val"]
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in key), encode_pnm(cube, normalise, binary)]], columns=[*key, "content"])

    return pixels.groupBy(*key).applyInPandas(run, schema)


def decode_raw(data: bytes, kind: str = "<f4") -> np.ndarray:
    """bands x rows x columns after a header of these three as 32-bit integers."""
    b, r, c = np.frombuffer(data, "<i4", 3)
    return np.frombuffer(data, kind, int(b) * int(r) * int(c), 12).reshape(b, r, c)


def encode_raw(cube: np.ndarray, kind: str = "<f4") -> bytes:
    return np.array(cube.shape, "<i4").tobytes() + np.ascontiguousarray(cube, kind).tobytes()


def read_raw(spark: SparkSession, path: str, kind: str = "<f4") -> DataFrame:
    """path, z, y, x, val of every cell of every raw volume."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                yield from _table(name, decode_raw(data, kind).astype(float), ["z", "y", "x"], pa.float64())

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, VOLUME_SCHEMA)


def read_text_image(spark: SparkSession, path: str) -> DataFrame:
    """path, y, x, val of images with a text line per row of numbers. Line numbers hold within a file, so a file is one split."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), "\n")).alias("y", "line"))
    return lines.select("path", "y", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("x", "v")).where("v <> ''").select("path", "y", "x", F.col("v").cast("double").alias("val"))
