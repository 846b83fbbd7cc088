"""Pictures and meshes: rasters as PNG, triangles as binary glTF, and what a model measures."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: glTF's numbers for types of components and buffers (fixed values).
FLOAT, UNSIGNED, ARRAY, ELEMENTS = 5126, 5125, 34962, 34963


def png_bytes(levels: np.ndarray) -> bytes:
    """A picture of (height, width) levels 0..255, or (height, width, 3), as a PNG."""
    levels = np.ascontiguousarray(levels, np.uint8)
    height, width = levels.shape[:2]
    rows = levels.reshape(height, -1)
    body = np.concatenate([np.zeros((height, 1), np.uint8), rows], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if levels.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body, 6)) + chunk(b"IEND", b"")


def pictures(field: DataFrame, by: str, low: float, high: float) -> DataFrame:
    """A grey picture for each chunk of a field (by, i, j, value), its north up: by, width, height, png. Posts that are missing are black."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = rows["i"].to_numpy(), rows["j"].to_numpy()
        grey = np.zeros((j.max() - j.min() + 1, i.max() - i.min() + 1), np.uint8)
        grey[j.max() - j, i - i.min()] = np.clip(np.rint((rows["value"].to_numpy() - low) / (high - low) * 254 + 1), 1, 255)
        return pd.DataFrame({by: [rows[by].iloc[0]], "width": [grey.shape[1]], "height": [grey.shape[0]], "png": [png_bytes(grey)]})

    kind = field.schema[by].dataType.simpleString()
    return field.select(by, "i", "j", "value").groupBy(by).applyInPandas(one, f"{by} {kind}, width long, height long, png binary")


def glb_bytes(triangles: np.ndarray) -> bytes:
    """Triangles (n, 3 corners, x y z in metres) as binary glTF, corners that are equal once."""
    corners, index = np.unique(triangles.reshape(-1, 3).astype("<f4"), axis=0, return_inverse=True)
    data, faces = corners.tobytes(), index.astype("<u4").tobytes()
    views = [{"buffer": 0, "byteOffset": 0, "byteLength": len(data), "target": ARRAY}, {"buffer": 0, "byteOffset": len(data), "byteLength": len(faces), "target": ELEMENTS}]
    accessors = [
        {"bufferView": 0, "componentType": FLOAT, "count": len(corners), "type": "VEC3", "min": corners.min(axis=0).tolist(), "max": corners.max(axis=0).tolist()},
        {"bufferView": 1, "componentType": UNSIGNED, "count": index.size, "type": "SCALAR"},
    ]
    scene = {"asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0}], "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1}]}], "accessors": accessors, "bufferViews": views, "buffers": [{"byteLength": len(data) + len(faces)}]}
    head = json.dumps(scene, separators=(",", ":"), sort_keys=True).encode()
    head += b" " * (-len(head) % 4)
    body = data + faces
    total = 12 + 8 + len(head) + 8 + len(body)
    return struct.pack("<4sII", b"glTF", 2, total) + struct.pack("<I4s", len(head), b"JSON") + head + struct.pack("<I4s", len(body), b"BIN\0") + body


def meshes(triangles: DataFrame, by: str) -> DataFrame:
    """A model for each surface (by, and corners x0 y0 z0 .. x2 y2 z2 in metres): by, triangles, glb."""
    names = [f"{c}{k}" for k in range(3) for c in "xyz"]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[names].to_numpy(float).reshape(-1, 3, 3)
        own = own[np.lexsort(own.reshape(len(own), 9).T[::-1])]
        return pd.DataFrame({by: [rows[by].iloc[0]], "triangles": [len(own)], "glb": [glb_bytes(own)]})

    kind = triangles.schema[by].dataType.simpleString()
    return triangles.select(by, *names).groupBy(by).applyInPandas(one, f"{by} {kind}, triangles long, glb binary")


def measured(data: bytes) -> dict[str, object]:
    """Bounds and triangles of a binary glTF model, from its own accessors."""
    magic, version, total = struct.unpack_from("<4sII", data)
    size, kind = struct.unpack_from("<I4s", data, 12)
    if magic != b"glTF" or version != 2 or total != len(data) or kind != b"JSON":
        raise ValueError("asset.model: not a binary glTF 2 file")
    scene = json.loads(data[20 : 20 + size])
    low, high, count = [np.inf] * 3, [-np.inf] * 3, 0
    for mesh in scene.get("meshes", []):
        for p in mesh["primitives"]:
            spot = scene["accessors"][p["attributes"]["POSITION"]]
            low, high = [*map(min, low, spot["min"])], [*map(max, high, spot["max"])]
            count += scene["accessors"][p["indices"]]["count"] // 3 if "indices" in p else spot["count"] // 3
    return {"low": low, "high": high, "triangles": count}


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """path, triangles, and size along each axis of the models in a folder, read on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, content in zip(batch["path"], batch["content"]):
                m = measured(bytes(content))
                rows.append((p, m["triangles"], *(round(h - l, 6) for l, h in zip(m["low"], m["high"]))))
            yield pd.DataFrame(rows, columns=["path", "triangles", "dx", "dy", "dz"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, triangles long, dx double, dy double, dz double")


def lines(features: DataFrame, order: str) -> DataFrame:
    """Features as canonical JSON lines, in order of a column: members sorted by name, nulls left out."""
    return features.select(order, F.to_json(F.struct(*sorted(features.columns))).alias("line")).orderBy(order)
