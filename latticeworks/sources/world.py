"""World documents: TOML tables as typed DataFrames, one row an entity, with layers and closed keys."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Keys that each table may have (fixed values); a table without an entry here is an error.
KEYS = {
    "world": ["name", "extent", "resolution", "seed", "include", "pack", "chunk"],
    "field": ["role", "type", "unit", "tags", "base", "file", "channel", "range", "extent", "outside", "filter", "then", "let"],
    "feature": ["kind", "authority", "at", "path", "region", "where", "on", "starts_at", "ends_at", "smooth", "attrs"],
    "instance": ["asset", "at", "on", "face", "scale", "tint", "ground", "margin"],
    "scatter": ["assets", "spacing", "jitter", "density", "within", "scale", "tint", "clump", "seed"],
    "run": ["asset", "set", "on", "count", "spacing", "ends", "face"],
    "set": ["items"],
    "kind": ["authority", "defaults", "requires", "radius", "effect"],
    "step": ["when", "command", "worker", "params", "inputs", "for_each", "checks"],
    "change": ["set", "add", "remove", "unset"],
}

ENTITIES = T.StructType([T.StructField(n, t) for n, t in (("table", T.StringType()), ("id", T.StringType()), ("key", T.StringType()), ("value", T.StringType()), ("layer", T.StringType()), ("rank", T.LongType()))])


class DocumentError(ValueError):
    pass


@dataclass(frozen=True)
class Layer:
    name: str
    text: str


def nearest(name: str, known: list[str]) -> str | None:
    """The known name at the least edit distance, within a third of the name's length."""

    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rated = sorted((distance(name, k), k) for k in known)
    return rated[0][1] if rated and rated[0][0] <= max(1, len(name) // 3) else None


def _rows(layer: Layer, rank: int) -> list[tuple]:
    document, out = tomllib.loads(layer.text), []
    for table, entries in document.items():
        if table not in KEYS:
            hint = nearest(table, list(KEYS))
            raise DocumentError(f"doc.unknown_table: {table}" + (f", did you mean `{hint}`?" if hint else ""))
        for id_, body in ([("", entries)] if table == "world" else entries.items()):
            for key, value in body.items():
                if key not in KEYS[table]:
                    hint = nearest(key, KEYS[table])
                    raise DocumentError(f"doc.unknown_key: {table}.{id_}.{key}" + (f", did you mean `{hint}`?" if hint else ""))
                out.append((table, id_, key, json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")), layer.name, rank))
    return out


def read_world(spark: SparkSession, layers: list[Layer]) -> DataFrame:
    """One row for each key of each entity, values as canonical JSON: a union of layers, in their order.

    An id that two documents declare is an error, as are tables and keys that aren't known.
    """
    rows, owner = [], {}
    for rank, layer in enumerate(layers):
        for row in _rows(layer, rank):
            if owner.setdefault(row[:2], layer.name) != layer.name:
                raise DocumentError(f"doc.duplicate_id: {row[0]}.{row[1]} in {owner[row[:2]]} and {layer.name}")
            rows.append(row)
    return spark.createDataFrame(rows, ENTITIES)


def entities(world: DataFrame, table: str) -> DataFrame:
    """A table as one column a key; values stay JSON text."""
    return world.where(world["table"] == table).groupBy("id", "layer", "rank").pivot("key", KEYS[table]).agg({"value": "first"})
