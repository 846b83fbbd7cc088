"""Queries on regions, networks and what features carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.formula import Scope, compile_formula
from ..operators import raster, regions, relational, spatial
from ..storage import spread
from .fields import _ENTRIES, _entries
from .registry import query
from .views import boxes, field, points, sites, sql, table, vertices


def _ring(x0: str = "x0", y0: str = "y0", x1: str = "x1", y1: str = "y1") -> Column:
    return F.array(*(F.struct(F.expr(x).cast("long").alias("x"), F.expr(y).cast("long").alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))))


@query(sql("WITH p AS (SELECT a.name AS one, b.name AS two, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS m, (a.x1 - a.x0) * (a.y1 - a.y0) AS p, (b.x1 - b.x0) * (b.y1 - b.y0) AS q FROM boxes a JOIN boxes b ON a.name < b.name AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1) SELECT one, two, 2 * m AS both2, 2 * (p + q - m) AS either2, 2 * (p - m) AS alone2 FROM p", "boxes"))
def region_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pairs of regions share, hold together, and hold alone, exact."""
    b = boxes(spark, sf_dir)
    met = spatial.overlaps(b.withColumnRenamed("name", "id"), b.withColumnRenamed("name", "id"), 32_000).where("a < b")
    rings = b.select("name", _ring().alias("ring"))
    pairs = met.join(rings.select(F.col("name").alias("a"), F.col("ring").alias("ring_one")), "a").join(rings.select(F.col("name").alias("b"), F.col("ring").alias("ring_two")), "b")
    return regions.overlay_pairs(pairs.select(F.col("a").alias("one"), F.col("b").alias("two"), "ring_one", "ring_two"))


@query()
def street_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9: what lies within a width of each path, as an area and a number of rings."""
    paths = vertices(spark, sf_dir).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "x_mm", "y_mm"))).alias("points")).where("size(points) > 1")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            own = batch.column("points")
            at, flat = own.offsets.to_numpy().astype(np.int64), own.flatten()
            points = np.column_stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("x_mm", "y_mm")]).astype(np.int64)
            rings, area2 = regions.stroke_measures(points, at - at[0], 2000)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(rings), pa.array(area2)], names=["path", "rings", "area2"])

    return spread(paths).mapInArrow(run, "path long, rings long, area2 long")


@query()
def network_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3, V5, Q12: paths cut where they meet, and the areas between them."""
    paths = vertices(spark, sf_dir).select((F.floor(F.col("path") / 20)).alias("town"), "path", "seq", "x_mm", "y_mm")
    towns = paths.groupBy("town").agg(F.array_sort(F.collect_list(F.struct("path", "seq", "x_mm", "y_mm"))).alias("points"))

    def run(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            rows = []
            for town, own in zip(batch["town"], batch["points"]):
                p = np.array([(v["path"], v["x_mm"], v["y_mm"]) for v in own], np.int64)
                junctions, edges, areas, area2 = regions.network(np.column_stack([p[:-1, 1:], p[1:, 1:]])[p[1:, 0] == p[:-1, 0]])
                rows.append((town, junctions, edges, areas, round(area2)))
            yield pd.DataFrame(rows, columns=["town", "junctions", "edges", "areas", "area2"])

    return spread(towns).mapInPandas(run, "town long, junctions long, edges long, areas long, area2 long")


@query(sql("SELECT path, (list_sort(list([x_mm, y_mm, seq])))[1][3] AS first_seq, (list_sort(list([x_mm, y_mm])))[1][1] AS least_x, count(*) AS n FROM vertices GROUP BY path", "vertices"))
def canonical_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings turned to begin at their least vertex."""
    rings = vertices(spark, sf_dir).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", F.struct("x_mm", "y_mm", "seq").alias("p")))).alias("ring"))
    own = rings.select("path", F.transform("ring", lambda r: r["p"]).alias("ring"))
    at = F.array_position("ring", F.array_min("ring")).cast("int")
    turned = own.select("path", F.concat(F.slice("ring", at, F.size("ring")), F.slice("ring", F.lit(1), at - 1)).alias("ring"))
    return turned.select("path", F.get("ring", F.lit(0))["seq"].alias("first_seq"), F.get("ring", F.lit(0))["x_mm"].alias("least_x"), F.size("ring").cast("long").alias("n"))


@query(sql("WITH d AS (SELECT p.id, least(sqrt(min((p.x_mm - s.x_mm) ** 2 + (p.y_mm - s.y_mm) ** 2)), 9000) / 9000.0 AS s FROM points p CROSS JOIN sites s GROUP BY p.id) SELECT id, round(1 - s * s * (3 - 2 * s), 6) AS near FROM d", "points", "sites"))
def near_falloff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 at a site, falling to 0 at a radius, beyond which nothing is looked at."""
    p = points(spark, sf_dir).select("id", "x_mm", "y_mm")
    d2 = spatial.within_radius(p, sites(spark, sf_dir), 9000).groupBy("id").agg(F.min("d2").alias("d2"))
    d = p.join(d2, "id", "left").withColumn("d", F.coalesce(F.sqrt(F.col("d2").cast("double")), F.lit(9000.0)))
    return d.select("id", F.round(compile_formula("= 1 - smoothstep(0, 9000, d)", Scope({"d": F.col("d")})), 6).alias("near"))


@query(f"WITH e AS ({_ENTRIES}), a AS (SELECT post, material, sum(m) AS w FROM e WHERE ord % 2 = 0 GROUP BY 1, 2), b AS (SELECT post, material, sum(m) AS w FROM e WHERE ord % 2 = 1 GROUP BY 1, 2) SELECT post, material, round(0.75 * coalesce(a.w, 0) + 0.25 * coalesce(b.w, 0), 6) AS weight FROM a FULL JOIN b USING (post, material)")
def weight_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two maps of weights mixed material by material."""
    e = _entries(spark, sf_dir)
    a, b = (e.where(F.col("ord") % 2 == k).groupBy("post", "material").agg(F.sum("m").alias(n)) for k, n in ((0, "a"), (1, "b")))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return a.join(b, ["post", "material"], "full_outer").select("post", "material", F.round(0.75 * zero("a") + 0.25 * zero("b"), 6).alias("weight"))


@query(f"WITH e AS ({_ENTRIES}) SELECT post, least(max(m * 12), 1) AS keep_out, max(m * 12) > 1 AS over, arg_min(ord, CASE WHEN m * 12 > 1 THEN ord END) AS first_over FROM e GROUP BY post")
def keep_out_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most of all keep-out fields at a post, clamped once, and the first entry over the range."""
    e = _entries(spark, sf_dir).withColumn("k", F.col("m") * 12)
    return e.groupBy("post").agg(F.least(F.max("k"), F.lit(1.0)).alias("keep_out"), (F.max("k") > 1).alias("over"), F.min(F.when(F.col("k") > 1, F.col("ord"))).alias("first_over"))


@query(sql("SELECT round_even(median(b.value - a.value), 2) AS lift, count(*) AS pairs FROM field a JOIN field b ON a.i = 19 AND b.i = 20 AND a.j = b.j", "field"))
def median_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median step across an edge, to the centimetre."""
    f = field(spark, sf_dir)
    b = f.where("i = 20").select("j", F.col("value").alias("right"))
    return f.where("i = 19").join(b, "j").agg(F.bround(F.median(F.col("right") - F.col("value")), 2).alias("lift"), F.count("*").alias("pairs"))


@query(sql("SELECT DISTINCT v.path, b.name FROM vertices v JOIN boxes b ON v.x_mm BETWEEN b.x0 AND b.x1 AND v.y_mm BETWEEN b.y0 AND b.y1", "vertices", "boxes"))
def features_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with a vertex in a region."""
    v = vertices(spark, sf_dir).withColumnRenamed("path", "id")
    return spatial.in_boxes(v, boxes(spark, sf_dir), 32_000).select(F.col("id").alias("path"), "name").distinct()


@query(f"WITH e AS ({_ENTRIES}) SELECT post, round(sum(v) FILTER (WHERE material <= 2), 4) AS build, round(sum(v) FILTER (WHERE material <= 5), 4) AS head, round(sum(v), 4) AS whole FROM e GROUP BY post")
def field_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field as readers of different ranks see it, in one pass."""
    v = lambda c: F.round(F.sum(F.when(c, F.col("v"))), 4)
    return _entries(spark, sf_dir).groupBy("post").agg(v(F.col("material") <= 2).alias("build"), v(F.col("material") <= 5).alias("head"), v(F.lit(True)).alias("whole"))


@query("SELECT p_type, p_brand, count(*) AS uses FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def shared_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two calls of one owner on one stream."""
    return table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("uses")).where("uses > 1")


@query("SELECT page_id, url_decode(replace(url, 'e', '%65')) AS plain FROM pages")
def percent_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names out of percent-encoded addresses."""
    return table(spark, sf_dir, "pages").select("page_id", F.url_decode(F.replace(F.replace("url", F.lit("+"), F.lit("%2B")), F.lit("e"), F.lit("%65"))).alias("plain"))


@query("SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment ELSE 'FIELD' END AS wanted FROM customer WHERE CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment ELSE 'FIELD' END = c_mktsegment")
def idle_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that leave everything as it was."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    edits = c.select("c_custkey", F.lit("set").alias("op"), F.when(F.col("c_custkey") % 5 == 0, F.col("c_mktsegment")).otherwise("FIELD").alias("value"), F.lit(1).alias("seq"))
    after = relational.apply_changes(c, edits, "c_custkey", "c_mktsegment").withColumnRenamed("c_mktsegment", "wanted")
    return c.join(after, "c_custkey").where(F.col("c_mktsegment").eqNullSafe(F.col("wanted"))).select("c_custkey", "c_mktsegment", "wanted")


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, o.p_type AS was, n.p_type AS now FROM lineitem JOIN part o ON l_partkey = o.p_partkey JOIN part n ON (l_partkey + 1) % 2000 = n.p_partkey WHERE o.p_type <> n.p_type")
def pack_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The asset table swapped whole, and what changes with it."""
    l, p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"), table(spark, sf_dir, "part")
    old = p.select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("was"))
    new = p.select(F.col("p_partkey").alias("other"), F.col("p_type").alias("now"))
    return l.join(old, "l_partkey").withColumn("other", (F.col("l_partkey") + 1) % 2000).join(new, "other").where("was != now").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "was", "now")


@query(sql("WITH g AS (SELECT id, x_mm % 156000 AS x, y_mm % 150000 AS y FROM points), p AS (SELECT id, x // 4000 AS i0, y // 4000 AS j0, x / 4000.0 - x // 4000 AS fx, y / 4000.0 - y // 4000 AS fy FROM g) SELECT id, round((1 - fx) * (1 - fy) * a.value + fx * (1 - fy) * b.value + (1 - fx) * fy * c.value + fx * fy * d.value - 0.25, 5) AS z, greatest(a.value, b.value, c.value, d.value) - least(a.value, b.value, c.value, d.value) AS relief, greatest(a.value, b.value, c.value, d.value) - least(a.value, b.value, c.value, d.value) > 800 AS steep FROM p JOIN field a ON a.i = i0 AND a.j = j0 JOIN field b ON b.i = i0 + 1 AND b.j = j0 JOIN field c ON c.i = i0 AND c.j = j0 + 1 JOIN field d ON d.i = i0 + 1 AND d.j = j0 + 1", "points", "field"))
def grounded_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of origins, sunk a little, and the relief under them against a limit."""
    p = points(spark, sf_dir).select("id", (F.col("x_mm") % 156_000).alias("x_mm"), (F.col("y_mm") % 150_000).alias("y_mm"))
    f = field(spark, sf_dir)
    z = raster.bilinear(p, f, 4000)
    corner = F.explode(F.array(*(F.struct((F.floor(F.col("x_mm") / 4000) + a).alias("i"), (F.floor(F.col("y_mm") / 4000) + b).alias("j")) for a in (0, 1) for b in (0, 1))))
    under = p.select("id", corner.alias("c")).select("id", "c.*").join(f, ["i", "j"]).groupBy("id").agg((F.max("value") - F.min("value")).alias("relief"))
    return z.join(under, "id").select("id", F.round(F.col("value") - 0.25, 5).alias("z"), "relief", (F.col("relief") > 800).alias("steep"))


@query(sql("WITH g AS (SELECT kind, id, x_mm, lead(x_mm) OVER (PARTITION BY kind ORDER BY x_mm, id) AS next FROM points) SELECT kind, max(next - x_mm) AS widest, count(*) FILTER (WHERE next - x_mm > 2000) AS gaps, CAST(sum(next - x_mm) AS BIGINT) AS spread FROM g GROUP BY kind", "points"))
def review_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between neighbours along a line, a row a subject."""
    gap = F.lead("x_mm").over(Window.partitionBy("kind").orderBy("x_mm", "id")) - F.col("x_mm")
    return points(spark, sf_dir).withColumn("gap", gap).groupBy("kind").agg(F.max("gap").alias("widest"), F.count_if(F.col("gap") > 2000).alias("gaps"), F.sum("gap").alias("spread"))


@query("SELECT c_custkey, CASE WHEN c_acctbal = 0 THEN '0' ELSE format('{:.2f}', c_acctbal) END AS written FROM customer")
def written_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact lengths written out again."""
    c = table(spark, sf_dir, "customer")
    mm = text.millimetres(F.format_string("%.2f", "c_acctbal"))
    return c.select("c_custkey", F.when(mm == 0, "0").otherwise((mm / F.lit(1000).cast("decimal(4,0)")).cast("decimal(20,2)").cast("string")).alias("written"))
