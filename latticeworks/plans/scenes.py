"""Queries on imports, footprints, surfaces and what is written out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formula import Scope, compile_formula
from ..operators import place, raster, spatial, terrain
from .places import _SEGMENTS
from .registry import query
from .views import boxes, field, points, sites, sql, vertices


@query(sql("SELECT 'hill.' || kind || id AS name, 1000 - y_mm AS x_mm, 500 + x_mm AS y_mm FROM points", "points"))
def import_bring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another world's places, turned, moved and renamed."""
    p = points(spark, sf_dir).select(F.concat("kind", F.col("id").cast("string")).alias("name"), "x_mm", "y_mm")
    return spatial.bring(p, "hill", 1000, 500, 270_000).select("name", "x_mm", "y_mm")


@query(sql("SELECT a.i, a.j, a.value + 3 + b.value / 10 AS value FROM field a JOIN field b ON b.i = a.i - 5 AND b.j = a.j - 2", "field"))
def derived_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import's field as an offset over the ground it stands on."""
    f = field(spark, sf_dir)
    own = f.select((F.col("i") + 5).alias("i"), (F.col("j") + 2).alias("j"), (F.col("value") / 10).alias("over"))
    return f.join(own, ["i", "j"]).select("i", "j", (F.col("value") + 3 + F.col("over")).alias("value"))


@query(sql("SELECT id, CAST(to_json({'id': id, 'kind': kind, 'at': [x_mm, y_mm]}) AS VARCHAR) AS line FROM points", "points"))
def feature_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features as canonical JSON, a line each."""
    return points(spark, sf_dir).select("id", F.to_json(F.struct("id", "kind", F.array("x_mm", "y_mm").alias("at"))).alias("line"))


@query(sql(f"WITH {_SEGMENTS}, g AS (SELECT i * 8000 AS x, j * 8000 AS y, j * 32 + i AS id FROM range(32) a(i), range(32) b(j)), d AS (SELECT id, c.path, c.k, least(greatest(CAST((bx - ax) * (x - ax) + (by_ - ay) * (y - ay) AS DOUBLE) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)), 0), 1) AS t, x, y, ax, ay, bx, by_ FROM g CROSS JOIN cum c) SELECT id, path, k, round(sqrt((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by_ - ay)) ** 2), 3) AS d FROM d WHERE sqrt((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by_ - ay)) ** 2) <= 5000", "vertices"))
def stroke_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts within a width of a path, met by tiles."""
    posts = raster.posts(spark, 32, 32).select((F.col("j") * 32 + F.col("i")).alias("id"), (F.col("i") * 8000).alias("x_mm"), (F.col("j") * 8000).alias("y_mm"))
    lines = spatial.segments(vertices(spark, sf_dir), "path", "seq")
    return spatial.along_segments(posts, lines, 5000).select("id", "path", "k", F.round("d", 3).alias("d"))


@query(sql("SELECT p.id, CASE WHEN b.name IS NOT NULL AND p.id % 2 = 0 THEN 'stored' ELSE kind END AS kind, b.name IS NOT NULL AS locked FROM points p LEFT JOIN (SELECT * FROM boxes WHERE name = 'NATION_3') b ON p.x_mm BETWEEN b.x0 AND b.x1 AND p.y_mm BETWEEN b.y0 AND b.y1", "points", "boxes"))
def locked_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inside a region, rows are those that were stored."""
    p = points(spark, sf_dir)
    inside = spatial.in_boxes(p, boxes(spark, sf_dir).where("name = 'NATION_3'"), 32_000).select("id", F.lit(True).alias("locked"))
    stored = p.where("id % 2 = 0").select("id", F.lit("stored").alias("old"))
    got = p.join(inside, "id", "left").join(stored, "id", "left")
    return got.select("id", F.when(F.col("locked"), F.coalesce("old", "kind")).otherwise(F.col("kind")).alias("kind"), F.coalesce("locked", F.lit(False)).alias("locked"))


@query(sql("SELECT id, least(a, b) + x_mm AS x0, greatest(a, b) + x_mm AS x1, least(c, d) + y_mm AS y0, greatest(c, d) + y_mm AS y1 FROM (SELECT id, x_mm, y_mm, CASE id % 4 WHEN 0 THEN -200 WHEN 1 THEN -100 WHEN 2 THEN 200 ELSE 100 END AS a, CASE id % 4 WHEN 0 THEN 300 WHEN 1 THEN 400 WHEN 2 THEN -300 ELSE -400 END AS b, CASE id % 4 WHEN 0 THEN -100 WHEN 1 THEN 200 WHEN 2 THEN 100 ELSE -200 END AS c, CASE id % 4 WHEN 0 THEN 400 WHEN 1 THEN -300 WHEN 2 THEN -400 ELSE 300 END AS d FROM points)", "points"))
def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An asset's box in the frames of its instances."""
    p, face = points(spark, sf_dir), F.col("id") % 4 * 90_000
    (ax, ay), (bx, by) = (spatial.turned(F.lit(x), F.lit(y), face) for x, y in ((-200, -100), (300, 400)))
    return p.select("id", *((e(a, b) + F.col(c)).alias(n) for n, e, a, b, c in (("x0", F.least, ax, bx, "x_mm"), ("x1", F.greatest, ax, bx, "x_mm"), ("y0", F.least, ay, by, "y_mm"), ("y1", F.greatest, ay, by, "y_mm"))))


@query(sql("SELECT p.id, b.name, round(2 + 0.001 * (p.x_mm - b.x0) / 1000.0, 6) AS z, 2 + 0.001 * (p.x_mm - b.x0) / 1000.0 > 2.02 AS through FROM points p JOIN boxes b ON p.x_mm BETWEEN b.x0 AND b.x1 AND p.y_mm BETWEEN b.y0 AND b.y1", "points", "boxes"))
def surface_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kind's height formula over its bound, and what reaches through it."""
    met = spatial.in_boxes(points(spark, sf_dir), boxes(spark, sf_dir), 32_000)
    z = compile_formula("= 2 + 0.001 * along", Scope({"along": (F.col("x_mm") - F.col("x0")) / 1000.0}))
    return met.select("id", "name", F.round(z, 6).alias("z"), (z > 2.02).alias("through"))


@query(sql("SELECT i, j FROM field f WHERE i < 39 AND j < 39 AND NOT EXISTS (SELECT 1 FROM boxes b WHERE b.name < 'NATION_13' AND f.i * 6000 BETWEEN b.x0 AND b.x1 AND f.j * 6000 BETWEEN b.y0 AND b.y1)", "field", "boxes"))
def kept_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terrain quads that no surface covers."""
    q = field(spark, sf_dir).where("i < 39 and j < 39").select(F.struct("i", "j").alias("id"), (F.col("i") * 6000).alias("x_mm"), (F.col("j") * 6000).alias("y_mm"))
    covered = spatial.in_boxes(q, boxes(spark, sf_dir).where("name < 'NATION_13'"), 32_000).select("id").distinct()
    return q.join(covered, "id", "left_anti").select("id.i", "id.j")


@query(sql("WITH m AS (SELECT id, kind FROM points WHERE id % 3 = 0 UNION ALL SELECT id + 100000, 'HOUSEHOLD' FROM sites) SELECT kind, count(*) AS made, min(id) AS first FROM m GROUP BY kind", "points", "sites"))
def made_of_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What networks and cells make of a kind, with its features."""
    made = sites(spark, sf_dir).select((F.col("id") + 100_000).alias("id"), F.lit("HOUSEHOLD").alias("kind"))
    return points(spark, sf_dir).where("id % 3 = 0").select("id", "kind").unionByName(made).groupBy("kind").agg(F.count("*").alias("made"), F.min("id").alias("first"))


@query()
def eroded_land(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step of uplift, stream-power incision along each basin's receivers, and diffusion."""
    land = terrain.erode(field(spark, sf_dir), uplift=0.5, power=0.02, spread=0.1)
    return land.select("i", "j", F.round("value", 6).alias("value"))


@query()
def stream_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strahler's order and the steps to the pit, for each post."""
    return terrain.strahler(field(spark, sf_dir))


@query()
def settled_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: slopes over a repose relaxed, mass kept."""
    return terrain.relax_slopes(field(spark, sf_dir), 300.0, 4).select("i", "j", F.round("value", 6).alias("value"))


@query()
def frontage_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells along the left of paths, as rings."""
    lines = spatial.segments(vertices(spark, sf_dir), "path", "seq")
    return place.cells(lines, "path", 12_000, 8000).select("path", "k", "frontage", F.get("ring", F.lit(2))["x"].alias("far_x"), F.get("ring", F.lit(2))["y"].alias("far_y"))


@query()
def followed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths written beside other paths."""
    return place.follow(spatial.segments(vertices(spark, sf_dir), "path", "seq"), "path", 10_000, -1500)


@query()
def shallow_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depressions shallower than a depth are filled, deeper ones stay."""
    f = raster.with_rim(field(spark, sf_dir))
    filled = raster.fill(f, F.col("rim"))
    return f.join(filled, ["i", "j"]).select("i", "j", F.when(F.col("filled") - F.col("value") < 60, F.col("filled")).otherwise(F.col("value")).alias("value"))


@query(sql("SELECT s.id AS effect, count(*) AS posts, round(max(1 - sqrt((p.x_mm - s.x_mm) ** 2 + (p.y_mm - s.y_mm) ** 2) / 12000.0), 6) AS most FROM sites s JOIN points p ON (p.x_mm - s.x_mm) ** 2 + (p.y_mm - s.y_mm) ** 2 BETWEEN 64000000 AND 100000000 WHERE 1 - sqrt((p.x_mm - s.x_mm) ** 2 + (p.y_mm - s.y_mm) ** 2) / 12000.0 > 0.02 GROUP BY 1", "points", "sites"))
def ring_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of an effect's mask is left in the ring inside its radius."""
    near = spatial.within_radius(points(spark, sf_dir), sites(spark, sf_dir), 10_000).where("d2 >= 64000000")
    mask = 1 - F.sqrt(F.col("d2").cast("double")) / 12_000.0
    return near.withColumn("mask", mask).where("mask > 0.02").groupBy(F.col("site").alias("effect")).agg(F.count("*").alias("posts"), F.round(F.max("mask"), 6).alias("most"))


@query(sql("SELECT id, upper(substr(kind, 1, 1)) || lower(substr(kind, 2)) || ' ' || id || CASE WHEN weight < 0 THEN ' (owing)' ELSE '' END AS label FROM points", "points"))
def map_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names out of attributes."""
    owing = F.when(F.col("weight") < 0, F.lit(" (owing)")).otherwise(F.lit(""))
    return points(spark, sf_dir).select("id", F.concat(F.initcap(F.lower("kind")), F.lit(" "), F.col("id").cast("string"), owing).alias("label"))
