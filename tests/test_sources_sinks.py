import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeworks.sinks.build import Step, build, check, explain, read_build
from latticeworks.sources.arrays import parse_png, read_arrays, read_png, resample, write_npy
from latticeworks.sources.world import DocumentError, Layer, entities, read_world
from latticeworks.streaming.incremental import current, upkeep


def png(picture, filters):
    """A picture (height, width, channels) with a filter for each line."""
    deep = picture.dtype == np.uint16
    height, width, channels = picture.shape
    raw = picture.astype(">u2" if deep else np.uint8).tobytes()
    step, size = channels * (2 if deep else 1), width * channels * (2 if deep else 1)
    body, above = b"", bytes(size)
    for y in range(height):
        row = raw[y * size : (y + 1) * size]
        line = []
        for k, v in enumerate(row):
            a, b, c = (row[k - step] if k >= step else 0), above[k], (above[k - step] if k >= step else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((v - [0, a, b, (a + b) // 2, paeth][filters[y % len(filters)]]) % 256)
        body += bytes([filters[y % len(filters)], *line])
        above = row
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 16 if deep else 8, {1: 0, 3: 2, 2: 4, 4: 6}[channels], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 3, 4])
@pytest.mark.parametrize("dtype", [np.uint8, np.uint16])
def test_png_round_trip(channels, dtype):
    picture = np.random.default_rng(channels).integers(0, np.iinfo(dtype).max, (9, 7, channels)).astype(dtype)
    assert (parse_png(png(picture, [0, 1, 2, 3, 4])) == picture).all()
    broken = bytearray(png(picture, [4]))
    broken[45] ^= 1
    with pytest.raises(ValueError, match="png"):
        parse_png(bytes(broken))


def test_array_files(spark, tmp_path):
    values = np.arange(12, dtype=float).reshape(3, 4) - 0.0
    (tmp_path / "a.npy").write_bytes(write_npy(values))
    assert (np.load(tmp_path / "a.npy") == values).all()
    got = read_arrays(spark, str(tmp_path / "*.npy")).collect()
    assert {(r.j, r.i): r.value for r in got} == {(j, i): values[j, i] for j in range(3) for i in range(4)}
    (tmp_path / "b.png").write_bytes(png(np.array([[[0], [255]], [[51], [102]]], np.uint8), [0]))
    got = {(r.i, r.j): r.value for r in read_png(spark, str(tmp_path / "b.png"), high=10.0).collect()}
    assert got == pytest.approx({(0, 1): 0.0, (1, 1): 10.0, (0, 0): 2.0, (1, 0): 4.0})
    with pytest.raises(ValueError, match="number.not_finite"):
        write_npy(np.array([[np.inf]]))


def test_resample(spark):
    field = spark.createDataFrame([(i, j, float(i + 10 * j)) for i in range(6) for j in range(6)], "i long, j long, value double")
    posts = spark.createDataFrame([(2, 2), (3, 5), (20, 0)], "i long, j long")
    for how in ("linear", "cubic"):
        got = {(r.i, r.j): r.value for r in resample(field, posts, 0.5, how, outside=-1.0).collect()}
        assert got == pytest.approx({(2, 2): 11.0, (3, 5): 26.5, (20, 0): -1.0})
    got = {(r.i, r.j): r.value for r in resample(field, posts, 0.5, "nearest", outside=-1.0).collect()}
    assert got[2, 2] == 11.0 and got[20, 0] == -1.0


WORLD = """
[world]
name = "ford"
extent = [0, 0, 256000, 256000]
[feature.river]
kind = "river"
path = [[0, 0], [1000, 500]]
[field.height]
type = "scalar"
base = "= 3"
"""


def test_world(spark):
    world = read_world(spark, [Layer("base", WORLD), Layer("more", '[feature.bridge]\nkind = "bridge"\nat = [5, 6]')])
    rows = {r.id: r for r in entities(world, "feature").collect()}
    assert rows["river"].path == "[[0,0],[1000,500]]" and rows["bridge"].layer == "more" and rows["bridge"]["rank"] == 1
    for text, code in (("[feature.a]\nkin = 1", "did you mean `kind`"), ("[featur.a]\nkind = 1", "did you mean `feature`")):
        with pytest.raises(DocumentError, match=code):
            read_world(spark, [Layer("x", text)])
    with pytest.raises(DocumentError, match="duplicate_id"):
        read_world(spark, [Layer("base", WORLD), Layer("more", '[feature.river]\nkind = "x"')])


def test_build_reuses_what_did_not_change(spark, tmp_path):
    path = str(tmp_path / "build")
    steps = [Step("doubled", lambda d, times: d.select((F.col("id") * times).alias("id")), ["source"], {"times": 2}), Step("even", lambda d: d.where("id % 4 = 0"), ["doubled"]), Step("total", lambda d: d.agg(F.count("*").alias("n")), ["even"])]
    source = spark.range(10)
    assert set(build(spark, path, {"source": source}, steps).values()) == {"made"}
    assert set(build(spark, path, {"source": source.repartition(3)}, steps).values()) == {"reused"}
    got = build(spark, path, {"source": source.union(spark.range(11, 12))}, steps)
    assert got == {"doubled": "made", "even": "cut_off", "total": "reused"}
    assert read_build(spark, path)["total"].first()["n"] == 5 and check(spark, path) == []
    version = read_build(spark, path)["even"].inputFiles()[0].rsplit("/", 1)[0]
    spark.range(3).write.mode("overwrite").parquet(version)
    assert check(spark, path) == ["build.digest: even"]


def test_stream_upkeep_equals_a_whole_summary(spark, tmp_path):
    summarize = lambda d: d.groupBy("chunk").agg(F.count("*").alias("n"), F.sum("v").alias("v"))
    incoming, rows, out = (str(tmp_path / n) for n in ("in", "rows", "out"))
    everything = spark.range(0)
    for k in range(3):
        batch = spark.range(20 * k, 20 * k + 20).select((F.col("id") % (4 + k)).alias("chunk"), F.col("id").alias("v"))
        batch.coalesce(1).write.mode("append").parquet(incoming)
        everything = batch if not k else everything.union(batch)
        edits = spark.readStream.schema("chunk long, v long").option("maxFilesPerTrigger", 1).parquet(incoming)
        upkeep(spark, edits, rows, out, ["chunk"], summarize, str(tmp_path / "checkpoint")).awaitTermination()
        assert sorted(map(tuple, current(spark, out).select("chunk", "n", "v").collect())) == sorted(map(tuple, summarize(everything).collect()))


def test_build_with_failures(spark, tmp_path):
    path, calls = str(tmp_path / "build"), []

    def uneven(d):
        calls.append(1)
        return d.select((F.col("id") + len(calls)).alias("id"))

    steps = [Step("bad", lambda d: d.select(F.raise_error(F.lit("no"))), ["source"]), Step("after", lambda d: d, ["bad"]), Step("fine", uneven, ["source"])]
    got = build(spark, path, {"source": spark.range(3)}, steps, verify=True)
    assert got["bad"].startswith("failed") and got["after"] == "skipped" and got["fine"] == "unstable"
    assert read_build(spark, path) == {}
    assert explain("after", steps, got)[:2] == [("after", "skipped"), ("bad", got["bad"])] and explain("after", steps, got)[-1] == ("source", "source")


def test_an_edited_step_is_made_again(spark, tmp_path):
    """Literals, names, nested functions, defaults and what is closed over are in the key; the same text again is not an edit."""
    import functools

    path, source = str(tmp_path / "build"), {"source": spark.range(9)}

    def over(limit):
        return lambda d: d.where(F.col("id") > limit)

    makes = [lambda d: d.where("id > 1"), lambda d: d.where("id > 2"), over(3), over(4), lambda d, least=5: d.where(F.col("id") > least), lambda d, least=6: d.where(F.col("id") > least), functools.partial(lambda n, d: d.limit(n), 2), functools.partial(lambda n, d: d.limit(n), 1), lambda d: (lambda x: x.where("id > 7"))(d)]
    counts = []
    for make in makes:
        assert build(spark, path, source, [Step("t", make, ["source"])])["t"] in ("made", "cut_off")
        counts.append(read_build(spark, path)["t"].count())
        assert build(spark, path, source, [Step("t", make, ["source"])]) == {"t": "reused"}
    assert counts == [7, 6, 5, 4, 3, 2, 2, 1, 1]
    assert build(spark, path, source, [Step("t", over(3), ["source"])])["t"] == "made" and build(spark, path, source, [Step("t", over(3), ["source"])])["t"] == "reused"


def test_a_stopped_swap_leaves_a_whole_build(spark, tmp_path, monkeypatch):
    from latticeworks.sinks import build as module

    path, source = str(tmp_path / "build"), {"source": spark.range(5)}
    build(spark, path, source, [Step("t", lambda d: d.where("id > 1"), ["source"])])
    step = [Step("t", lambda d: d.where("id > 2"), ["source"])]
    jvm_path, swap = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, module._swap

    def stopped(*a):
        raise KeyboardInterrupt

    monkeypatch.setattr(module, "_swap", stopped)  # before the rename
    with pytest.raises(KeyboardInterrupt):
        build(spark, path, source, step)
    assert read_build(spark, path)["t"].count() == 3 and check(spark, path) == []
    pointers = module._pointers
    monkeypatch.setattr(module, "_swap", swap)
    monkeypatch.setattr(module, "_pointers", lambda *a, calls=[]: (calls.append(1), stopped() if len(calls) > 2 else pointers(*a))[1])  # after the rename, before older pointers go
    with pytest.raises(KeyboardInterrupt):
        build(spark, path, source, step)
    monkeypatch.setattr(module, "_pointers", pointers)
    assert sorted(pointers(spark, path)) == [1, 2] and read_build(spark, path)["t"].count() == 2
    fs = jvm_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert fs.exists(jvm_path(path))
    monkeypatch.setattr(module, "_pointers", lambda *a: [1])  # a writer that has not seen the second pointer
    with pytest.raises(RuntimeError, match="taken"):
        module.build(spark, path, source, [Step("t", lambda d: d.where("id > 3"), ["source"])])


def test_shared_folder_is_never_a_machines_own_on_a_cluster(monkeypatch):
    from latticeworks import storage

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint.dir"):
        storage.shared_dir(Session())
