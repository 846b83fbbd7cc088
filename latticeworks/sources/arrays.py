"""Raster files as rows: two-dimensional .npy arrays and PNG channels, read as binary files on the executors."""

from __future__ import annotations

import ast
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROWS = "path string, j long, values array<double>"


def parse_npy(data: bytes) -> np.ndarray:
    """A subset of the format: versions 1 to 3, little-endian numbers or bytes, C order, two dimensions."""
    if data[:6] != b"\x93NUMPY" or data[6] not in (1, 2, 3):
        raise ValueError("array.header: not an array file")
    wide = data[6] > 1
    size = struct.unpack_from("<I" if wide else "<H", data, 8)[0]
    begin = 12 if wide else 10
    head = ast.literal_eval(data[begin : begin + size].decode("latin1" if data[6] < 3 else "utf-8").strip())
    dtype = np.dtype(head["descr"])
    if head["fortran_order"] or len(head["shape"]) != 2 or dtype.hasobject or dtype.byteorder == ">":
        raise ValueError("array.shape: two dimensions in C order, little-endian")
    body = data[begin + size :]
    if len(body) != dtype.itemsize * head["shape"][0] * head["shape"][1]:
        raise ValueError("array.size: the body isn't as long as its header says")
    return np.frombuffer(body, dtype).reshape(head["shape"])


def write_npy(values: np.ndarray) -> bytes:
    """A ``<f4`` array file; -0 is written as 0, and what isn't finite is an error."""
    narrow = values.astype("<f4") + np.float32(0)
    if not np.isfinite(narrow).all():
        raise ValueError("number.not_finite: a field's values are finite")
    head = f"{{'descr': '<f4', 'fortran_order': False, 'shape': ({narrow.shape[0]}, {narrow.shape[1]}), }}"
    head += " " * (-(len(head) + 11) % 64) + "\n"
    return b"\x93NUMPY\x01\x00" + struct.pack("<H", len(head)) + head.encode() + narrow.tobytes()


def parse_png(data: bytes) -> np.ndarray:
    """Levels (height, width, channels) of a PNG of 8 or 16 bits, not interlaced, without a palette; chunk checksums are verified."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("png.header: not a PNG")
    at, head, body = 8, None, b""
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8 : at + 8 + size]
        if len(chunk) != size or zlib.crc32(kind + chunk) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError(f"png.chunk: {kind!r} is damaged")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body += chunk
        at += 12 + size
    if head is None:
        raise ValueError("png.header: no header")
    width, height, depth, colour, _, _, interlace = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth not in (8, 16) or not channels or interlace:
        raise ValueError("png.kind: 8 or 16 bits, grey or colour, not interlaced")
    step = channels * depth // 8
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), np.uint8)
    above = np.zeros(width * step, np.uint8)
    for y in range(height):
        above = out[y] = _unfilter(int(rows[y, 0]), rows[y, 1:], above, step)
    if depth == 16:
        return out.view(">u2").astype(np.uint16).reshape(height, width, channels)
    return out.reshape(height, width, channels)


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """One line, by the filters of the PNG specification."""
    if kind == 0:
        return row.copy()
    if kind == 2:
        return row + above
    if kind == 1:
        return np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    out = [0] * (len(row) + step)
    up = [0] * step + above.tolist()
    for k, v in enumerate(row.tolist()):
        a, b, c = out[k], up[k + step], up[k]
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[k + step] = (v + guess) & 255
    return np.array(out[step:], np.uint8)


def _lines(parse: Callable[[bytes], np.ndarray]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                for j, line in enumerate(parse(bytes(content))):
                    yield pd.DataFrame({"path": [path], "j": [j], "values": [line.astype(float)]})

    return run


def _read(spark: SparkSession, path: str, parse: Callable[[bytes], np.ndarray]) -> DataFrame:
    """path, i, j, value of each post; row 0 is the south. A file is one task, and its lines are rows before posts are."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    lines = files.mapInPandas(_lines(parse), _ROWS)
    return lines.select("path", F.posexplode("values").alias("i", "value"), "j").select("path", F.col("i").cast("long").alias("i"), "j", "value")


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, parse_npy)


def read_png(spark: SparkSession, path: str, channel: int = 0, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """One channel, its levels mapped to low..high; the picture's last line is the south."""

    def levels(data: bytes) -> np.ndarray:
        picture = parse_png(data)
        most = 65535.0 if picture.dtype == np.uint16 else 255.0
        return low + picture[::-1, :, channel].astype(float) / most * (high - low)

    return _read(spark, path, levels)


def resample(field: DataFrame, posts: DataFrame, spacing: float, how: str = "linear", outside: float | None = None) -> DataFrame:
    """A field (i, j, value) read at posts (i, j) that are ``spacing`` of its own apart: nearest, linear, or cubic (Keys, a = -0.5).
    Posts that its samples don't surround get ``outside``."""
    at = posts.select("i", "j", (F.col("i") * spacing).alias("u"), (F.col("j") * spacing).alias("v"))
    if how == "nearest":
        taps, weight = [0], lambda t, k: F.lit(1.0)
        base = lambda c: F.floor(F.col(c) + 0.5)
    elif how == "linear":
        taps, weight = [0, 1], lambda t, k: (1.0 - t) if k == 0 else t
        base = lambda c: F.floor(F.col(c))
    else:
        taps = [-1, 0, 1, 2]
        weight = lambda t, k: {-1: -0.5 * t + t * t - 0.5 * t * t * t, 0: 1.0 - 2.5 * t * t + 1.5 * t * t * t, 1: 0.5 * t + 2.0 * t * t - 1.5 * t * t * t, 2: -0.5 * t * t + 0.5 * t * t * t}[k]
        base = lambda c: F.floor(F.col(c))
    at = at.withColumns({"i0": base("u"), "j0": base("v")}).withColumns({"s": F.col("u") - F.col("i0"), "t": F.col("v") - F.col("j0")})
    corners = F.array(*(F.struct((F.col("i0") + a).alias("fi"), (F.col("j0") + b).alias("fj"), (weight(F.col("s"), a) * weight(F.col("t"), b)).alias("w")) for a in taps for b in taps))
    met = at.select("i", "j", F.explode(corners).alias("c")).where("c.w != 0").select("i", "j", "c.*")
    own = field.select(F.col("i").alias("fi"), F.col("j").alias("fj"), "value")
    got = met.join(own, ["fi", "fj"], "left").groupBy("i", "j").agg(F.sum(F.col("w") * F.col("value")).alias("value"), F.count_if(F.col("value").isNull()).alias("missing"))
    return got.select("i", "j", F.when(F.col("missing") == 0, F.col("value")).otherwise(F.lit(outside).cast("double")).alias("value"))
