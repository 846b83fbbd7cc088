"""Queries on places, shapes and networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph, place, relational, shapes, spatial
from .registry import query
from .views import EXTENT, boxes, points, sites, sql, table, vertices


@query(sql("SELECT p.id, s.id AS site, (p.x_mm - s.x_mm) * (p.x_mm - s.x_mm) + (p.y_mm - s.y_mm) * (p.y_mm - s.y_mm) AS d2 FROM points p CROSS JOIN sites s QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY d2, s.id) = 1", "points", "sites"))
def nearest_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest site of each point, by tiles of growing size."""
    return spatial.nearest(points(spark, sf_dir), sites(spark, sf_dir), EXTENT, 16_000)


@query(sql("SELECT p.id, s.id AS site, (p.x_mm - s.x_mm) * (p.x_mm - s.x_mm) + (p.y_mm - s.y_mm) * (p.y_mm - s.y_mm) AS d2 FROM points p JOIN sites s ON (p.x_mm - s.x_mm) * (p.x_mm - s.x_mm) + (p.y_mm - s.y_mm) * (p.y_mm - s.y_mm) <= 100000000", "points", "sites"))
def within_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs within a distance."""
    return spatial.within_radius(points(spark, sf_dir), sites(spark, sf_dir), 10_000)


@query(sql("SELECT p.id, CAST(least(sqrt(min((p.x_mm - s.x_mm) * (p.x_mm - s.x_mm) + (p.y_mm - s.y_mm) * (p.y_mm - s.y_mm))), 8000) AS BIGINT) AS dist FROM points p CROSS JOIN sites s GROUP BY p.id", "points", "sites"))
def capped_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least distance, at most a cap; only sites within the cap are met."""
    p = points(spark, sf_dir).select("id", "x_mm", "y_mm")
    near = spatial.within_radius(p, sites(spark, sf_dir), 8000).groupBy("id").agg(F.min("d2").alias("d2"))
    return p.join(near, "id", "left").select("id", F.rint(F.coalesce(F.sqrt(F.col("d2").cast("double")), F.lit(8000.0))).cast("long").alias("dist"))


@query(sql("SELECT p.id, p.kind, p.x_mm, p.y_mm FROM points p WHERE NOT EXISTS (SELECT 1 FROM sites s WHERE s.id % 4 = 0 AND (p.x_mm - s.x_mm) * (p.x_mm - s.x_mm) + (p.y_mm - s.y_mm) * (p.y_mm - s.y_mm) <= 144000000)", "points", "sites"))
def clear_discs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that no disc clears."""
    return spatial.clear(points(spark, sf_dir), sites(spark, sf_dir).where("id % 4 = 0"), 12_000).select("id", "kind", "x_mm", "y_mm")


@query(sql("SELECT id, kind, x_mm, y_mm, false AS pinned FROM points p WHERE NOT EXISTS (SELECT 1 FROM sites s WHERE s.id % 5 = 0 AND (p.x_mm - s.x_mm) * (p.x_mm - s.x_mm) + (p.y_mm - s.y_mm) * (p.y_mm - s.y_mm) <= 36000000) UNION ALL SELECT id, 'PIN', x_mm, y_mm, true FROM sites WHERE id % 5 = 0", "points", "sites"))
def pin_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pinned rows replace those they overlap."""
    pins = sites(spark, sf_dir).where("id % 5 = 0")
    held = spatial.clear(points(spark, sf_dir), pins, 6000).select("id", "kind", "x_mm", "y_mm", F.lit(False).alias("pinned"))
    return held.unionByName(pins.select("id", F.lit("PIN").alias("kind"), "x_mm", "y_mm", F.lit(True).alias("pinned")))


@query(sql("SELECT b.name, count(*) AS held, min(p.id) AS first FROM points p JOIN boxes b ON p.x_mm BETWEEN b.x0 AND b.x1 AND p.y_mm BETWEEN b.y0 AND b.y1 GROUP BY 1", "points", "boxes"))
def points_in_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in closed boxes, by tiles."""
    return spatial.in_boxes(points(spark, sf_dir), boxes(spark, sf_dir), 32_000).groupBy("name").agg(F.count("*").alias("held"), F.min("id").alias("first"))


@query(
    sql(
        """WITH r AS (SELECT name, x0, y0, x1, y1 FROM boxes)
    SELECT p.id, r.name FROM points p JOIN r ON p.x_mm BETWEEN x0 AND x1 AND p.y_mm BETWEEN y0 AND y1
    AND (x1 - x0) * (p.y_mm - y0) - (p.x_mm - x0) * 0 >= 0 AND (x0 - x1) * (p.y_mm - y0) - (p.x_mm - x1) * (y1 - y0) >= 0 AND (x0 - x0) * (p.y_mm - y1) - (p.x_mm - x0) * (y0 - y1) >= 0""",
        "points",
        "boxes",
    )
)
def points_in_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in triangles by exact winding numbers, outline included."""
    ring = F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x0", "y1"))))
    return spatial.in_regions(points(spark, sf_dir), boxes(spark, sf_dir).select("name", ring.alias("ring")), 32_000)


@query(sql("SELECT a.name AS a, b.name AS b FROM boxes a JOIN boxes b ON a.name < b.name AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1", "boxes"))
def overlapping_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose interiors meet, each found in one tile."""
    b = boxes(spark, sf_dir).withColumnRenamed("name", "id")
    return spatial.overlaps(b, b, 32_000).where("a < b")


@query(sql("SELECT a.name AS inner_box, b.name AS outer_box FROM boxes a JOIN boxes b ON a.name <> b.name AND a.x0 >= b.x0 AND a.x1 <= b.x1 + 20000 AND a.y0 >= b.y0 AND a.y1 <= b.y1 + 20000", "boxes"))
def nested_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment, by the tile of the inner box's corner."""
    outer = boxes(spark, sf_dir).select(F.col("name").alias("outer_box"), F.col("x0").alias("X0"), F.col("y0").alias("Y0"), (F.col("x1") + 20_000).alias("X1"), (F.col("y1") + 20_000).alias("Y1"))
    corner = boxes(spark, sf_dir).select(F.col("name").alias("id"), F.col("x0").alias("x_mm"), F.col("y0").alias("y_mm"), "x1", "y1")
    met = spatial.in_boxes(corner.withColumnsRenamed({"x1": "far_x", "y1": "far_y"}), outer.select(F.col("outer_box").alias("name"), F.col("X0").alias("x0"), F.col("Y0").alias("y0"), F.col("X1").alias("x1"), F.col("Y1").alias("y1")), 32_000)
    return met.where("id != name and far_x <= x1 and far_y <= y1").select(F.col("id").alias("inner_box"), F.col("name").alias("outer_box"))


_SEGMENTS = "seg AS (SELECT path, seq AS k, x_mm AS ax, y_mm AS ay, lead(x_mm) OVER w AS bx, lead(y_mm) OVER w AS by_ FROM vertices WINDOW w AS (PARTITION BY path ORDER BY seq)), lens AS (SELECT *, sqrt(CAST((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_) AS DOUBLE)) AS length FROM seg WHERE bx IS NOT NULL AND (ax <> bx OR ay <> by_)), cum AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY path ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lens)"


@query(sql(f"WITH {_SEGMENTS} SELECT path, k, round(length, 4) AS length, round(before, 4) AS before FROM cum", "vertices"))
def arc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running lengths along paths."""
    return spatial.segments(vertices(spark, sf_dir), "path", "seq").select("path", "k", F.round("length", 4).alias("length"), F.round("before", 4).alias("before"))


@query(sql(f"WITH {_SEGMENTS}, t AS (SELECT path, n * 60000.0 AS s FROM (SELECT DISTINCT path FROM vertices) CROSS JOIN range(1, 4) r(n)) SELECT t.path, CAST(s AS DOUBLE) AS s, CAST(round_even(ax + (s - before) / length * (bx - ax), 0) AS BIGINT) AS x_mm, CAST(round_even(ay + (s - before) / length * (by_ - ay), 0) AS BIGINT) AS y_mm FROM t JOIN cum c ON t.path = c.path AND before <= s AND s < before + length", "vertices"))
def interpolate_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points every 60 m along paths, as an as-of join on running lengths."""
    v = vertices(spark, sf_dir)
    stations = v.select("path").distinct().withColumn("s", F.explode(F.array(*(F.lit(60_000.0 * n) for n in (1, 2, 3))))).withColumn("offset", F.lit(0))
    return spatial.interpolate(stations, spatial.segments(v, "path", "seq"), "path").select("path", "s", "x_mm", "y_mm")


@query(sql(f"WITH {_SEGMENTS}, q AS (SELECT o_orderkey AS id, o_orderkey AS path, o_custkey * 7919 % 256000 AS px, o_custkey * 104729 % 256000 AS py FROM orders), r AS (SELECT id, k, before, length, least(greatest(CAST((bx - ax) * (px - ax) + (by_ - ay) * (py - ay) AS DOUBLE) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)), 0), 1) AS t, px, py, ax, ay, bx, by_ FROM q JOIN cum USING (path)), d AS (SELECT id, k, sqrt((px - (ax + t * (bx - ax))) ** 2 + (py - (ay + t * (by_ - ay))) ** 2) AS d, before + t * length AS along FROM r) SELECT id, round(d, 2) AS d, round(along, 2) AS along FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, k) = 1", "vertices"))
def project_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points on the nearest segment of their path."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("path"), (F.col("o_custkey") * 7919 % EXTENT).alias("x_mm"), (F.col("o_custkey") * 104729 % EXTENT).alias("y_mm"))
    return spatial.project(o, spatial.segments(vertices(spark, sf_dir), "path", "seq"), "path").select("id", F.round("d", 2).alias("d"), F.round("along", 2).alias("along"))


@query(sql("WITH n AS (SELECT path, x_mm, y_mm, coalesce(lead(x_mm) OVER w, first_value(x_mm) OVER w) AS nx, coalesce(lead(y_mm) OVER w, first_value(y_mm) OVER w) AS ny FROM vertices WINDOW w AS (PARTITION BY path ORDER BY seq)) SELECT path, CAST(sum(x_mm * ny - nx * y_mm) AS BIGINT) AS area2, min(x_mm) AS x0, min(y_mm) AS y0, max(x_mm) AS x1, max(y_mm) AS y1 FROM n GROUP BY path", "vertices"))
def ring_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact twice-areas and bounding boxes of rings."""
    return spatial.ring_measures(vertices(spark, sf_dir), "path", "seq").drop("outline")


@query(sql(f"WITH {_SEGMENTS}, b AS (SELECT CAST(floor((degrees(atan2(bx - ax, by_ - ay)) + 360) % 360 / 20) AS BIGINT) AS bin, sum(length) AS l FROM lens GROUP BY 1), p AS (SELECT l / sum(l) OVER () AS p FROM b) SELECT round(-sum(p * ln(p)) / ln(18), 6) AS entropy, count(*) AS bins FROM p", "vertices"))
def bearing_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised entropy of a length-weighted histogram of bearings."""
    s = spatial.segments(vertices(spark, sf_dir), "path", "seq")
    degrees = F.degrees(F.atan2((F.col("bx") - F.col("ax")).cast("double"), (F.col("by_") - F.col("ay")).cast("double")))
    bins = s.groupBy(F.floor((degrees + 360) % 360 / 20).alias("bin")).agg(F.sum("length").alias("l"))
    whole = bins.agg(F.sum("l").alias("all"))  # one row
    p = bins.join(F.broadcast(whole), F.lit(True)).withColumn("p", F.col("l") / F.col("all"))
    return p.agg(F.round(-F.sum(F.col("p") * F.log("p")) / F.log(F.lit(18.0)), 6).alias("entropy"), F.count("*").alias("bins"))


@query(sql("SELECT id, CAST(((round_even(atan2(x_mm - 128000, y_mm - 128000) * (180000.0 / pi()), 0) % 360000) + 360000) % 360000 AS BIGINT) AS face FROM points WHERE x_mm <> 128000 OR y_mm <> 128000", "points"))
def facings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bearings in millidegrees, half even."""
    p = points(spark, sf_dir).where("x_mm != 128000 or y_mm != 128000")
    return p.select("id", spatial.bearing(F.col("x_mm") - 128_000, F.col("y_mm") - 128_000).alias("face"))


@query(sql("SELECT id, CASE id % 4 WHEN 0 THEN x_mm WHEN 1 THEN y_mm WHEN 2 THEN -x_mm ELSE -y_mm END + 1000 AS wx, CASE id % 4 WHEN 0 THEN y_mm WHEN 1 THEN -x_mm WHEN 2 THEN -y_mm ELSE x_mm END - 500 AS wy FROM points", "points"))
def frame_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local points in frames of quarter turns, exact."""
    p = points(spark, sf_dir)
    x, y = spatial.turned(F.col("x_mm"), F.col("y_mm"), F.col("id") % 4 * 90_000)
    return p.select("id", (x + 1000).alias("wx"), (y - 500).alias("wy"))


_EDGES = "SELECT l_partkey AS a, min(l_suppkey) AS b FROM lineitem GROUP BY 1 UNION SELECT l_partkey, max(l_suppkey) FROM lineitem GROUP BY 1"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each part to the least and the greatest of its suppliers, whose numbers are those of parts."""
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("a")).agg(F.min("l_suppkey").alias("low"), F.max("l_suppkey").alias("high"))
    return own.select("a", F.explode(F.array_distinct(F.array("low", "high"))).alias("b"))


@query(f"WITH RECURSIVE e AS ({_EDGES}), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS root FROM s UNION SELECT b, a FROM s UNION SELECT s.b, r.root FROM r JOIN s ON s.a = r.node) SELECT node, min(root) AS root FROM r GROUP BY node HAVING min(root) <> node")
def connected_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: connected components, by stars."""
    return graph.components(_edges(spark, sf_dir))


@query(f"WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT CAST(1 AS BIGINT) AS node, CAST(0 AS BIGINT) AS level UNION SELECT e.b, r.level + 1 FROM r JOIN e ON e.a = r.node WHERE r.level < 64) SELECT node, min(level) AS level FROM r GROUP BY node")
def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a start reaches, and in how many steps."""
    return graph.levels(_edges(spark, sf_dir), spark.range(1, 2).withColumnRenamed("id", "node"))


@query()
def cause_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For all that a changed part reaches, which changed parts reach it, and a shortest chain from each."""
    changed = table(spark, sf_dir, "part").where("p_size = 7").select(F.col("p_partkey").alias("node"))
    return graph.causes(_edges(spark, sf_dir), changed).select("node", "cause", F.array_join("chain", " > ").alias("chain"), F.size("chain").cast("long").alias("length"))


@query(f"WITH e AS ({_EDGES}), d AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY node) SELECT round(avg(CASE WHEN degree >= 4 THEN 1.0 ELSE 0.0 END), 6) AS four_way, round(avg(CASE WHEN degree = 3 THEN 1.0 ELSE 0.0 END), 6) AS three_way, round(avg(CASE WHEN degree = 1 THEN 1.0 ELSE 0.0 END), 6) AS dead_ends FROM d")
def junction_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of junctions by degree."""
    e = _edges(spark, sf_dir)
    d = e.select(F.col("a").alias("node")).unionAll(e.select("b")).groupBy("node").agg(F.count("*").alias("degree"))
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return d.agg(share(F.col("degree") >= 4).alias("four_way"), share(F.col("degree") == 3).alias("three_way"), share(F.col("degree") == 1).alias("dead_ends"))


@query(sql("SELECT x_mm // 64000 AS cx, y_mm // 64000 AS cy, kind, min(id) AS first, count(*) AS n FROM points GROUP BY 1, 2, 3", "points"))
def chunk_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First row and count per chunk and asset."""
    return points(spark, sf_dir).groupBy(F.floor(F.col("x_mm") / 64_000).alias("cx"), F.floor(F.col("y_mm") / 64_000).alias("cy"), "kind").agg(F.min("id").alias("first"), F.count("*").alias("n"))


@query(sql("SELECT id, x_mm // 32000 AS sx, y_mm // 32000 AS sy, row_number() OVER (PARTITION BY x_mm // 32000, y_mm // 32000, kind ORDER BY x_mm, y_mm, id) - 1 AS ordinal FROM points", "points"))
def place_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinals among things of one square and kind."""
    p = points(spark, sf_dir).withColumns({"sx": F.floor(F.col("x_mm") / 32_000), "sy": F.floor(F.col("y_mm") / 32_000)})
    return relational.ordinals(p, ["sx", "sy", "kind"], ["x_mm", "y_mm", "id"]).select("id", "sx", "sy", "ordinal")


@query(sql("SELECT kind, arg_min(id, (x_mm - 128000) * (x_mm - 128000) + (y_mm - 128000) * (y_mm - 128000) * 1.0 + id * 1e-9) AS id FROM points GROUP BY kind", "points"))
def representative_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point of each kind nearest the middle."""
    d2 = spatial.squared(F.col("x_mm"), F.col("y_mm"), F.lit(128_000), F.lit(128_000))
    return points(spark, sf_dir).groupBy("kind").agg(F.min(F.struct(d2.alias("d2"), "id")).alias("b")).select("kind", "b.id")


@query(sql("WITH w AS (SELECT id, kind, x_mm, y_mm, row_number() OVER (PARTITION BY x_mm // 32000, y_mm // 32000 ORDER BY weight DESC, id) AS r FROM points) SELECT id, kind, x_mm, y_mm FROM w WHERE r <= 3", "points"))
def chunk_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three rows of each chunk by weight."""
    w = Window.partitionBy(F.floor(F.col("x_mm") / 32_000), F.floor(F.col("y_mm") / 32_000)).orderBy(F.desc("weight"), "id")
    return points(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r <= 3").select("id", "kind", "x_mm", "y_mm")


_SIDE = "(({a}.bx - {a}.ax) * ({b}.{y} - {a}.ay) - ({a}.by_ - {a}.ay) * ({b}.{x} - {a}.ax))"
_S1, _S2, _S3, _S4 = (_SIDE.format(a=a, b=b, x=x, y=y) for a, b in (("l", "r"), ("r", "l")) for x, y in (("ax", "ay"), ("bx", "by_")))


@query(sql(f"WITH {_SEGMENTS}, s AS (SELECT path * 10 + k AS id, path, o_custkey AS owner, ax, ay, bx, by_ FROM lens JOIN orders ON o_orderkey = path) SELECT l.id AS one, r.id AS two FROM s l JOIN s r ON l.owner = r.owner AND l.id < r.id AND l.path <> r.path AND sign({_S1}) * sign({_S2}) < 0 AND sign({_S3}) * sign({_S4}) < 0", "vertices"))
def path_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of different paths of one owner that cross, met by tiles."""
    owners = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("owner"))
    s = spatial.segments(vertices(spark, sf_dir), "path", "seq").withColumn("id", F.col("path") * 10 + F.col("k"))
    return shapes.crossings(s.join(owners, "path"), 32_000, by="owner").select("one", "two")


@query(sql(f"WITH {_SEGMENTS}, t AS (SELECT *, max(before + length) OVER (PARTITION BY path) AS total FROM cum), c AS (SELECT path, k, greatest(before, total * 0.25) AS a, least(before + length, total * 0.75) AS b FROM t) SELECT path, k, round(a, 3) AS from_mm, round(b, 3) AS to_mm FROM c WHERE a < b", "vertices"))
def path_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle half of each path."""
    s = spatial.segments(vertices(spark, sf_dir), "path", "seq")
    return shapes.substring(s, "path", 0.25, 0.75).select("path", "k", F.round("from_mm", 3).alias("from_mm"), F.round("to_mm", 3).alias("to_mm"))


@query(sql("SELECT name, CAST(2 * ((x1 - x0) * (y1 - y0) - (x1 - x0 - 10000) * (y1 - y0 - 10000)) AS BIGINT) AS area2 FROM boxes", "boxes"))
def triangle_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings cut into triangles, whose areas add up to the ring's."""
    corners = [("x0", "y0"), ("x1", "y0"), ("x1", "y0 + 10000"), ("x0 + 10000", "y0 + 10000"), ("x0 + 10000", "y1"), ("x0", "y1")]
    ring = F.array(*(F.struct(F.expr(x).alias("x"), F.expr(y).alias("y")) for x, y in corners))
    t = shapes.triangulate(boxes(spark, sf_dir).select("name", ring.alias("ring")))
    return t.groupBy("name").agg(F.sum(F.expr("(x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0)")).alias("area2"))


@query()
def simplified_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vertices that a tolerance keeps."""
    return shapes.simplify(vertices(spark, sf_dir), "path", "seq", 40_000)


@query(f"WITH RECURSIVE e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM ({_EDGES}) WHERE a <> b), r AS (SELECT a AS node, CAST(0 AS BIGINT) AS level FROM e WHERE a NOT IN (SELECT b FROM e) UNION SELECT e.b, r.level + 1 FROM r JOIN e ON e.a = r.node) SELECT node, max(level) AS level FROM r GROUP BY node")
def build_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How deep each node stands in an order in which edges go forward."""
    e = _edges(spark, sf_dir).where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return graph.depths(e)


@query(sql("WITH RECURSIVE r AS (SELECT id, x_mm, y_mm, weight, row_number() OVER (ORDER BY weight DESC, id) AS n FROM points), near AS (SELECT a.id, b.id AS by_id FROM r a JOIN r b ON b.n < a.n AND (a.x_mm - b.x_mm) ** 2 + (a.y_mm - b.y_mm) ** 2 <= 16000000), s AS (SELECT 0 AS n, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT s.n + 1, CASE WHEN EXISTS (SELECT 1 FROM near WHERE near.id = r.id AND list_contains(s.kept, near.by_id)) THEN s.kept ELSE list_append(s.kept, r.id) END FROM s JOIN r ON r.n = s.n + 1) SELECT unnest(kept) AS id FROM s WHERE n = (SELECT max(n) FROM r)", "points").replace("WITH points", "WITH RECURSIVE points").replace(", RECURSIVE r", ", r"))
def give_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In order of weight, a row gives way to a kept one nearby, tile by tile."""
    weight = F.col("weight")
    falling = points(spark, sf_dir).withColumns({"none": F.when(F.isnan(weight), -1).when(weight.isNull(), 1).otherwise(0), "falling": F.when(F.isnan(weight), 0.0).otherwise(F.coalesce(-weight, F.lit(0.0)))})
    return spatial.thinned(falling, 4000, ["none", "falling"])


@query()
def clump_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of members of one parent that are too near one another, the earlier stays; members of different parents don't see one another."""
    return spatial.thinned(points(spark, sf_dir), 12_000, [], "nation")


@query(sql("SELECT id, CAST(ceil((2 * x_mm - 4000) / 8000.0) AS BIGINT) AS i, CAST(ceil((2 * y_mm - 4000) / 8000.0) AS BIGINT) AS j FROM points", "points"))
def nearest_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The post nearest to each point on a lattice of 4 m, ties to the lower one."""
    return points(spark, sf_dir).select("id", *(F.ceil((2 * F.col(c) - 4000) / F.lit(8000.0)).alias(n) for n, c in (("i", "x_mm"), ("j", "y_mm"))))


@query(
    sql(
        """WITH g AS (SELECT i, j, i * 4000 AS x, j * 4000 AS y FROM range(64) a(i), range(64) b(j)),
    h AS (SELECT name, i, j, x, y, x0, y0, x1, y1 FROM g JOIN boxes ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND (x1 - x0) * (y1 - y) - (x - x0) * (y1 - y0) >= 0),
    d AS (SELECT name, i, j, least((x - x0) ** 2, (y - y0) ** 2, ((x1 - x0) * (y1 - y) - (x - x0) * (y1 - y0)) ** 2 / ((x1 - x0) ** 2 + (y1 - y0) ** 2)) AS d2 FROM h)
    SELECT name, i, j, round(sqrt(d2), 3) AS depth FROM d QUALIFY row_number() OVER (PARTITION BY name ORDER BY round(sqrt(d2), 3) DESC, j, i) = 1""",
        "boxes",
    )
)
def region_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The post of each region (a triangle) that lies farthest from its outline, ties to the lower and then the left one."""
    from ..operators import raster

    ring = F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x0", "y1"))))
    posts = raster.posts(spark, 64, 64).select(F.struct("i", "j").alias("id"), (F.col("i") * 4000).alias("x_mm"), (F.col("j") * 4000).alias("y_mm"))
    return shapes.centres(posts, boxes(spark, sf_dir).select("name", ring.alias("ring")), 32_000).select("name", "id.i", "id.j", F.round("depth", 3).alias("depth"))


@query(sql("SELECT p.id, 'crowd/' || lower(kind) || '/' || p.id AS name, p.x_mm, p.y_mm FROM points p WHERE kind IN ('BUILDING', 'MACHINERY') AND EXISTS (SELECT 1 FROM boxes b WHERE b.name < 'NATION_3' AND p.x_mm BETWEEN b.x0 AND b.x1 AND p.y_mm BETWEEN b.y0 AND b.y1)", "points", "boxes"))
def instances_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step's read of instances: by taxon, within regions, and some columns."""
    taxa = spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "kind string")
    own = points(spark, sf_dir).join(taxa, "kind", "left_semi").select("id", F.concat_ws("/", F.lit("crowd"), F.lower("kind"), "id").alias("name"), "x_mm", "y_mm")
    inside = spatial.in_boxes(own.select("id", "x_mm", "y_mm"), boxes(spark, sf_dir).where("name < 'NATION_3'"), 32_000)
    return own.join(inside.select("id").distinct(), "id", "left_semi")


def _wood() -> place.Scatter:
    return place.Scatter("trees", 4000, (("oak", 2_000_000), (("ash", "birch", "alder"), 1_000_000)), scale=(0.8, 1.2), members=(0, 3), radius=1500, shrink=0.25)


@query()
def scatter_clumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5, Q6, Q7, F8: a scatter with weighted assets and clumps, thinned by a formula."""
    density = F.lit(0.2) + F.lit(0.6) * F.col("y_mm") / 256_000
    keep_out = F.when((F.col("x_mm") - 128_000) * (F.col("x_mm") - 128_000) < 400_000_000, 1.0).otherwise(0.0)
    return place.scatter(spark, _wood(), (0, 0, 255_999, 255_999), density, keep_out).withColumn("scale", F.round("scale", 9))


@query()
def scatter_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8: growth beside what is there already: the chance falls with the distance to another producer's instances."""
    bushes = place.Scatter("bushes", 3000, (("broom", 1_000_000),))
    found = place.candidates(spark, bushes, (0, 0, 255_999, 255_999))
    near = spatial.within_radius(found.withColumn("id", F.struct("i", "j")).select("id", "x_mm", "y_mm"), sites(spark, sf_dir), 20_000).groupBy("id").agg(F.min("d2").alias("d2"))
    chance = F.greatest(F.lit(0.0), 1.0 - F.sqrt(F.col("d2").cast("double")) / 20_000.0)
    return found.withColumn("id", F.struct("i", "j")).join(near, "id").where(F.col("u") < chance).select("i", "j", "x_mm", "y_mm")


@query(sql(f"WITH {_SEGMENTS}, w AS (SELECT path, CAST(round_even(max(before + length), 0) AS BIGINT) AS free FROM cum GROUP BY path), n AS (SELECT path, free, greatest((2 * free + 20000) // 40000, 1) AS n FROM w WHERE free > 0) SELECT path, k, (2 * k + 1) * free // (2 * n) AS s FROM (SELECT path, free, n, unnest(range(n)) AS k FROM n)", "vertices"))
def run_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4: members at even steps along each path."""
    lines = spatial.segments(vertices(spark, sf_dir), "path", "seq")
    return place.stations(lines, "path", spacing=20_000).select("path", "k", "s")


@query()
def run_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members with points, offset to the left, and bearings."""
    lines = spatial.segments(vertices(spark, sf_dir), "path", "seq")
    return place.run_members(lines, "path", spacing=30_000, ends="both", offset=500)


@query(sql("SELECT p.id || '#' || i.name AS name, asset, x_mm + CASE id % 4 WHEN 0 THEN dx WHEN 1 THEN dy WHEN 2 THEN -dx ELSE -dy END AS x_mm, y_mm + CASE id % 4 WHEN 0 THEN dy WHEN 1 THEN -dx WHEN 2 THEN -dy ELSE dx END AS y_mm, (id % 4 * 90000 + turn) % 360000 AS face FROM points p CROSS JOIN (VALUES ('door', 'gate', 0, 100, 0), ('lamp', 'lamp', 250, -50, 90000)) i(name, asset, dx, dy, turn)", "points"))
def set_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set's items in the frames of its places."""
    places = points(spark, sf_dir).select(F.lit("yard").alias("set"), F.col("id").cast("string").alias("maker"), "x_mm", "y_mm", (F.col("id") % 4 * 90_000).alias("face"))
    items = spark.createDataFrame([("yard", "door", "gate", 0, 100, 0), ("yard", "lamp", "lamp", 250, -50, 90_000)], "set string, name string, asset string, dx long, dy long, turn long")
    return place.set_items(places, items)


@query()
def smooth_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: curves through the vertices of paths."""
    return place.smooth_paths(vertices(spark, sf_dir), "path", "seq", 5000)
