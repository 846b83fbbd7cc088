"""Build directories: tables with a manifest of digests, replaced whole, and reused where their inputs didn't change.

A build is a folder of Parquet tables with ``manifest``, one row a table: name, key (a digest of what it was made from), rows,
digest (of its rows, whatever their order) and version (the folder that holds it). Versions are written beside one another. The build that
counts is that of the pointer with the highest number: a new pointer is written under another name and renamed, as the last step, and only
then are older pointers removed. A reader so sees one whole build or another, wherever a writer is stopped. A pointer's name can be
taken once, so of two writers the later one is told and changes nothing.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import functools
import types
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def row_digest(df: DataFrame) -> tuple[int, str]:
    """Rows, and a sum of their hashes, which no order or partitioning changes."""
    got = df.select(F.xxhash64(*df.columns).cast("decimal(38,0)").alias("h"), F.hash(*df.columns).cast("long").alias("g")).agg(F.count("*"), F.sum("h"), F.sum("g")).first()
    return got[0], hashlib.sha256(f"{sorted(df.dtypes)}|{got[0]}|{got[1]}|{got[2]}".encode()).hexdigest()


def key_of(*parts: object) -> str:
    """A digest of what a table is made from: versions, parameters, keys of inputs."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def code_of(f: object, seen: tuple[int, ...] = ()) -> object:
    """What a function does, for a key: its instructions with their constants, names and nested functions, its defaults, and the values it closes
    over; tables by what they mean."""
    if id(f) in seen:
        return "itself"
    seen += (id(f),)
    if isinstance(f, types.CodeType):
        return [f.co_code.hex(), list(f.co_names), [code_of(c, seen) if isinstance(c, types.CodeType) else repr(c) for c in f.co_consts]]
    if isinstance(f, functools.partial):
        return ["partial", code_of(f.func, seen), [code_of(a, seen) for a in f.args], {k: code_of(v, seen) for k, v in sorted(f.keywords.items())}]
    if isinstance(f, types.MethodType):
        return [code_of(f.__func__, seen), code_of(f.__self__, seen)]
    if isinstance(f, types.FunctionType):
        cells = [code_of(c.cell_contents, seen) for c in f.__closure__ or ()]
        read = [code_of(f.__globals__[n], seen) for n in f.__code__.co_names if isinstance(f.__globals__.get(n), (types.FunctionType, int, float, str, tuple))]
        return [code_of(f.__code__, seen), cells, read, [code_of(d, seen) for d in f.__defaults__ or ()], {k: code_of(v, seen) for k, v in (f.__kwdefaults__ or {}).items()}]
    if isinstance(f, DataFrame):
        return f.semanticHash()
    if isinstance(f, (str, bytes, int, float, bool, type(None), list, tuple, dict, set, frozenset)):
        return repr(f)
    return [type(f).__qualname__, {k: code_of(v, seen) for k, v in sorted(vars(f).items())} if hasattr(f, "__dict__") else repr(f)]


@dataclass
class Step:
    """A table's name, what makes it of its inputs' tables, and parameters that count in its key."""

    name: str
    make: Callable[..., DataFrame]
    inputs: list[str] = field(default_factory=list)
    params: dict[str, object] = field(default_factory=dict)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _pointer(path: str, number: int) -> str:
    return f"{path}/current-{number:012d}"


def _pointers(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the pointers there are."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return [int(n.removeprefix("current-")) for n in names if n.startswith("current-")]


def read_manifest(spark: SparkSession, path: str) -> dict[str, dict]:
    """The current manifest by table; empty where there is no build."""
    numbers = _pointers(spark, path)
    if not numbers:
        return {}
    version = spark.read.text(_pointer(path, max(numbers))).first()[0]
    return {r["name"]: r.asDict() for r in spark.read.parquet(f"{path}/manifest-{version}").collect()}


def read_build(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{m['version']}/{n}") for n, m in read_manifest(spark, path).items()}


def build(spark: SparkSession, path: str, sources: dict[str, DataFrame], steps: list[Step], verify: bool = False) -> dict[str, str]:
    """Run the steps whose keys changed; returns each table's status: made, reused, cut_off (made, with the same rows as
    before, so that its readers are reused), failed (with why), skipped (a table it reads failed), or, with ``verify``, unstable (made
    twice, with other rows).

    A build with a failure isn't swapped in: readers keep the one before.
    """
    number = max(_pointers(spark, path), default=0)
    old, version, status, manifest = read_manifest(spark, path), uuid.uuid4().hex, {}, {}
    values = {n: row_digest(df)[1] for n, df in sources.items()}
    tables = dict(sources)
    for s in steps:
        if any(i not in values for i in s.inputs):
            status[s.name] = "skipped"
            continue
        key = key_of(s.name, code_of(s.make), s.params, [values[i] for i in s.inputs])
        before = old.get(s.name)
        if before and before["key"] == key:
            status[s.name], manifest[s.name] = "reused", before
        else:
            try:
                s.make(*(tables[i] for i in s.inputs), **s.params).write.parquet(f"{path}/{version}/{s.name}")
            except Exception as e:  # other steps go on
                status[s.name] = f"failed: {str(e).splitlines()[0][:200]}"
                continue
            rows, digest = row_digest(spark.read.parquet(f"{path}/{version}/{s.name}"))
            status[s.name] = "cut_off" if before and before["digest"] == digest else "made"
            if verify and row_digest(s.make(*(tables[i] for i in s.inputs), **s.params)) != (rows, digest):
                status[s.name] = "unstable"
            manifest[s.name] = {"name": s.name, "key": key, "rows": rows, "digest": digest, "version": version}
        values[s.name] = manifest[s.name]["digest"]
        tables[s.name] = spark.read.parquet(f"{path}/{manifest[s.name]['version']}/{s.name}")
    if any(v.startswith(("failed", "skipped")) for v in status.values()):
        return status
    rows = [tuple(manifest[n][c] for c in ("name", "key", "rows", "digest", "version")) for n in sorted(manifest)]
    spark.createDataFrame(rows, "name string, key string, rows long, digest string, version string").coalesce(1).write.parquet(f"{path}/manifest-{version}")
    spark.createDataFrame([(version,)], "value string").coalesce(1).write.text(f"{path}/next-{version}")
    _swap(spark, path, f"{path}/next-{version}", number + 1)
    return status


def explain(name: str, steps: list[Step], status: dict[str, str]) -> list[tuple[str, str]]:
    """Why a table has its status: the chain of tables it reads, each the first that isn't reused, down to a source."""
    by_name, out = {s.name: s for s in steps}, []
    while name in by_name:
        out.append((name, status.get(name, "missing")))
        inputs = by_name[name].inputs
        name = next((i for i in inputs if not status.get(i, "source").startswith("reused")), inputs[0] if inputs else "")
    return [*out, (name, "source")] if name else out


def _swap(spark: SparkSession, path: str, new: str, number: int) -> None:
    """A rename is the only step in which the old build gives way; nothing is removed before."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    a, b = place(new), place(_pointer(path, number))
    fs = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(b) or not fs.rename(a, b):
        raise RuntimeError("build.taken: another build was swapped in meanwhile")
    for older in _pointers(spark, path):
        if older < number:
            fs.delete(place(_pointer(path, older)), True)


def check(spark: SparkSession, path: str) -> list[str]:
    """What is wrong with a build: tables that are missing, or whose rows aren't those of the manifest."""
    found = []
    for name, m in sorted(read_manifest(spark, path).items()):
        place = f"{path}/{m['version']}/{name}"
        if not _exists(spark, place):
            found.append(f"build.missing: {name}")
        elif row_digest(spark.read.parquet(place)) != (m["rows"], m["digest"]):
            found.append(f"build.digest: {name}")
    return found
