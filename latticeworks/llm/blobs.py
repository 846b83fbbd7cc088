"""Columns of numbers as one compressed value, and rows of values dealt to numbered places."""

from __future__ import annotations

import struct

import numpy as np
import zstandard

_HEAD = struct.Struct("<cQI")


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one or two dimensions and any number of rows, their bytes apart by place for better compression."""
    parts = []
    for c in columns:
        c = np.ascontiguousarray(c)
        width = c.shape[1] if c.ndim == 2 else 0
        body = c.tobytes() if width else c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes()
        parts.append(_HEAD.pack(c.dtype.char.encode(), len(c), width) + body)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 0, []
    while at < len(data):
        char, n, width = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        dtype = np.dtype(char.decode())
        size = n * (width or 1) * dtype.itemsize
        raw = np.frombuffer(data, np.uint8, size, at)
        out.append(raw.view(dtype).reshape(n, width) if width else np.ascontiguousarray(raw.reshape(dtype.itemsize, n).T).view(dtype).ravel())
        at += size
    return out


def xxhash_long(x: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64 gives for a long."""
    p1, p2, p3, p4, p5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, r: (v << np.uint64(r)) | (v >> np.uint64(64 - r))
    h = (np.uint64(42 + 8) + p5) ^ (turn(x.view(np.uint64) * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)
