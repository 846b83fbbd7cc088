import numpy as np
import pytest

from latticeworks.sinks.scenes import glb_bytes, lines, measured, meshes, pictures, png_bytes, read_models
from latticeworks.sources.arrays import parse_png


def test_pictures_read_back(spark):
    grey = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (parse_png(png_bytes(grey))[:, :, 0] == grey).all()
    colour = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    assert (parse_png(png_bytes(colour)) == colour).all()
    field = spark.createDataFrame([("a", i, j, float(i + j)) for i in range(3) for j in range(2)] + [("b", 7, 7, 3.0)], "chunk string, i long, j long, value double")
    got = {r.chunk: r for r in pictures(field, "chunk", 0.0, 3.0).collect()}
    assert (got["a"].width, got["a"].height, got["b"].width) == (3, 2, 1)
    assert parse_png(got["a"].png)[:, :, 0].tolist() == [[86, 170, 255], [1, 86, 170]]


def test_models_measure(spark, tmp_path):
    box = np.array([[[0, 0, 0], [2, 0, 0], [0, 3, 0]], [[2, 0, 0], [2, 3, 1], [0, 3, 0]]], float)
    data = glb_bytes(box)
    assert measured(data) == {"low": [0.0, 0.0, 0.0], "high": [2.0, 3.0, 1.0], "triangles": 2} and len(data) % 4 == 0
    rows = [("roof", *map(float, t.ravel())) for t in box]
    names = ", ".join(f"{c}{k} double" for k in range(3) for c in "xyz")
    got = meshes(spark.createDataFrame(rows, f"surface string, {names}"), "surface").first()
    assert got.triangles == 2 and bytes(got.glb) == data
    (tmp_path / "roof.glb").write_bytes(data)
    r = read_models(spark, str(tmp_path)).first()
    assert (r.triangles, r.dx, r.dy, r.dz) == (2, 2.0, 3.0, 1.0)
    with pytest.raises(ValueError, match="asset.model"):
        measured(b"no model in here, only text")


def test_lines(spark):
    df = spark.createDataFrame([("b", 2, None), ("a", 1, "x")], "name string, id long, kind string")
    assert [r.line for r in lines(df, "name").collect()] == ['{"id":1,"kind":"x","name":"a"}', '{"id":2,"name":"b"}']
