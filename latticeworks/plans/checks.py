"""Queries on rules and checks: what holds, what gives way, what is hidden, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.formula import Scope, compile_formula
from ..operators import graph, spatial
from .fields import _ENTRIES, _entries
from .registry import query
from .views import boxes, field, points, sites, sql, table


@query(sql("SELECT kind, nation % 3 AS cause, count(*) AS n, min(x_mm) AS x0, min(y_mm) AS y0, max(x_mm) AS x1, max(y_mm) AS y1 FROM points GROUP BY 1, 2", "points"))
def dropped_by_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows gave way to each cause, and where."""
    return points(spark, sf_dir).groupBy("kind", (F.col("nation") % 3).alias("cause")).agg(F.count("*").alias("n"), F.min("x_mm").alias("x0"), F.min("y_mm").alias("y0"), F.max("x_mm").alias("x1"), F.max("y_mm").alias("y1"))


@query("WITH k AS (SELECT p_partkey AS kind, p_brand AS selector FROM part), f AS (SELECT DISTINCT p_type AS name, p_brand AS tag FROM part) SELECT s_suppkey AS feature, kind, name AS target FROM supplier JOIN k ON s_suppkey = kind JOIN f ON tag = selector")
def effect_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each effect of a kind meets its features and the fields its selector names."""
    p = table(spark, sf_dir, "part")
    kinds = p.select(F.col("p_partkey").alias("kind"), F.col("p_brand").alias("selector"))
    targets = p.select(F.col("p_type").alias("target"), F.col("p_brand").alias("selector")).distinct()
    features = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("feature"), F.col("s_suppkey").alias("kind"))
    return features.join(kinds, "kind").join(targets, "selector").select("feature", "kind", "target")


@query(sql("SELECT p.id, b.name, (b.x0 + b.y0) % 977 AS z, row_number() OVER (PARTITION BY p.id ORDER BY (b.x0 + b.y0) % 977, b.name) - 1 AS nth FROM points p JOIN boxes b ON p.x_mm BETWEEN b.x0 AND b.x1 AND p.y_mm BETWEEN b.y0 AND b.y1", "points", "boxes"))
def surfaces_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every surface whose bound holds a point, from the lowest."""
    met = spatial.in_boxes(points(spark, sf_dir), boxes(spark, sf_dir), 32_000).withColumn("z", (F.col("x0") + F.col("y0")) % 977)
    nth = F.row_number().over(Window.partitionBy("id").orderBy("z", "name")) - 1
    return met.select("id", "name", "z", nth.cast("long").alias("nth"))


@query(sql("SELECT a.id AS one, b.id AS two, abs(a.x_mm - b.x_mm) + abs(a.y_mm - b.y_mm) AS gap FROM sites a JOIN sites b ON a.id % 50 = b.id % 50 AND a.id < b.id", "sites"))
def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of mounts of one owner, with their gap."""
    a = sites(spark, sf_dir).withColumn("owner", F.col("id") % 50)
    b = a.select("owner", F.col("id").alias("two"), F.col("x_mm").alias("bx"), F.col("y_mm").alias("by_"))
    return a.join(b, "owner").where("id < two").select(F.col("id").alias("one"), "two", (F.abs(F.col("x_mm") - F.col("bx")) + F.abs(F.col("y_mm") - F.col("by_"))).alias("gap"))


@query(f"WITH e AS (SELECT post, ord, CASE WHEN ord % 3 = 0 THEN 1.0 ELSE m END AS m, material FROM ({_ENTRIES})), l AS (SELECT *, max(m) OVER (PARTITION BY post ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM e) SELECT material, post AS feature FROM l GROUP BY 1, 2 HAVING min(coalesce(later, 0)) = 1")
def hidden_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose every post a later entry overwrites."""
    e = _entries(spark, sf_dir).withColumn("m", F.when(F.col("ord") % 3 == 0, 1.0).otherwise(F.col("m")))
    later = F.max("m").over(Window.partitionBy("post").orderBy("ord").rowsBetween(1, Window.unboundedFollowing))
    return e.withColumn("later", later).groupBy("material", F.col("post").alias("feature")).agg(F.min(F.coalesce("later", F.lit(0.0))).alias("least")).where("least = 1").select("material", "feature")


@query(f"WITH e AS ({_ENTRIES}), v AS (SELECT *, lag(v) OVER (PARTITION BY post ORDER BY ord) AS before FROM e) SELECT material, round(max(abs((v - before) * m)), 6) AS most, max(abs((v - before) * m)) > 3.5 AS over FROM v WHERE before IS NOT NULL GROUP BY 1")
def most_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest change an entry makes, against a limit."""
    before = F.lag("v").over(Window.partitionBy("post").orderBy("ord"))
    e = _entries(spark, sf_dir).withColumn("before", before).where("before is not null")
    most = F.max(F.abs((F.col("v") - F.col("before")) * F.col("m")))
    return e.groupBy("material").agg(F.round(most, 6).alias("most"), (most > 3.5).alias("over"))


@query(f"WITH e AS ({_ENTRIES}) SELECT DISTINCT a.post, least(a.material, b.material) AS one, greatest(a.material, b.material) AS two FROM e a JOIN e b ON a.post = b.post AND a.material < b.material WHERE a.m > 0.09 AND b.m > 0.09 AND a.v <> b.v")
def anchored_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchored writes that differ where both hold."""
    e = _entries(spark, sf_dir).where("m > 0.09").select("post", F.col("material").alias("one"), "v")
    met = e.join(e.select("post", F.col("one").alias("two"), F.col("v").alias("w")), "post").where("one < two and v != w")
    return met.select("post", "one", "two").distinct()


@query("SELECT o_orderkey, coalesce(c_name, 'default') AS bound, c_custkey IS NOT NULL AS given FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 = 0")
def given_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named things handed down, or their defaults."""
    c = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left").select("o_orderkey", F.coalesce("c_name", F.lit("default")).alias("bound"), F.col("c_name").isNotNull().alias("given"))


@query("WITH a AS (SELECT p_partkey, p_type, p_size FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_partkey - 1 AS p_partkey, p_type, p_size FROM part WHERE p_partkey % 2 = 1) SELECT p_partkey, CASE WHEN b.p_type IS NULL THEN 'missing' WHEN a.p_type <> b.p_type THEN 'type' WHEN a.p_size <> b.p_size THEN 'size' ELSE 'same' END AS finding FROM a LEFT JOIN b USING (p_partkey)")
def import_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of one name must agree."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    b = p.where("p_partkey % 2 = 1").select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_type").alias("type"), F.col("p_size").alias("size"))
    finding = F.when(F.col("type").isNull(), "missing").when(F.col("p_type") != F.col("type"), "type").when(F.col("p_size") != F.col("size"), "size").otherwise("same")
    return p.where("p_partkey % 2 = 0").join(b, "p_partkey", "left").select("p_partkey", finding.alias("finding"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_linenumber <= 3 AND l_partkey % 4 <= l_linenumber")
def visible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader sees rows at or below its own rank."""
    return table(spark, sf_dir, "lineitem").where((F.col("l_linenumber") <= 3) & (F.col("l_partkey") % 4 <= F.col("l_linenumber"))).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


_CITES = "SELECT p_partkey AS a, p_partkey // 3 AS b FROM part"


@query(f"WITH RECURSIVE e AS ({_CITES}), r AS (SELECT a AS node, a % 9 AS layer FROM e UNION SELECT e.a, r.layer FROM e JOIN r ON e.b = r.node AND e.a <> e.b) SELECT node, max(layer) AS layer FROM r GROUP BY node")
def added_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest layer among what an entity refers to, itself included, as a fixpoint."""
    e = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), F.expr("p_partkey div 3").alias("b"))
    own = e.select(F.col("a").alias("node"), (-(F.col("a") % 9)).cast("double").alias("value"))
    back = e.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0.0).alias("cost"))
    return graph.relax(own, back, lambda v, c: v + c).select("node", (-F.col("value")).cast("long").alias("layer"))


@query("SELECT event_id, replace(replace(props, ' ', ''), '\"k\":', '\"key\":') AS canonical, length(props) <> length(replace(props, ' ', '')) AS spaced FROM events")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON written with sorted members and no spaces."""
    e = table(spark, sf_dir, "events")
    parsed = F.from_json("props", "k long")
    out = F.to_json(F.struct(parsed["k"].alias("key")))
    return e.select("event_id", out.alias("canonical"), (F.length("props") != F.length(F.replace("props", F.lit(" ")))).alias("spaced"))


@query("SELECT p_partkey, sha256(p_name || '|' || p_brand) AS digest FROM part")
def row_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of rows."""
    return table(spark, sf_dir, "part").select("p_partkey", F.sha2(F.concat_ws("|", "p_name", "p_brand"), 256).alias("digest"))


@query(sql("WITH o AS (SELECT p.id, s.id AS site, (p.x_mm - s.x_mm) ** 2 + (p.y_mm - s.y_mm) ** 2 AS d2, s.id % 6 = 0 AS gone FROM points p CROSS JOIN sites s), a AS (SELECT id, arg_min(site, d2 * 1000 + site) AS was FROM o GROUP BY id), b AS (SELECT id, arg_min(site, d2 * 1000 + site) AS now FROM o WHERE NOT gone GROUP BY id) SELECT id, was, now FROM a JOIN b USING (id) WHERE was <> now", "points", "sites"))
def reselection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections that resolve to another name than before."""
    p, s = points(spark, sf_dir), sites(spark, sf_dir)
    was = spatial.nearest(p, s, 256_000, 16_000, scale=1000).select("id", F.col("site").alias("was"))
    now = spatial.nearest(p, s.where("id % 6 != 0"), 256_000, 16_000, scale=1000).select("id", F.col("site").alias("now"))
    return was.join(now, "id").where("was != now")


@query(sql("SELECT id, kind, round(c.a * 0.5 + c.b / 4, 6) AS area FROM (SELECT id, kind, {'a': x_mm / 1000.0, 'b': y_mm / 1000.0} AS c FROM points)", "points"))
def derived_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes by formulas that read one another, in dependency order."""
    scope = Scope({"x": F.col("x_mm") / 1000.0, "y": F.col("y_mm") / 1000.0}, {"half": "x * 0.5", "area": "half + y / 4"})
    return points(spark, sf_dir).select("id", "kind", F.round(compile_formula("= area", scope), 6).alias("area"))


@query(sql("SELECT i, j, value, CASE WHEN value < 100 THEN 'low' WHEN value < 700 THEN 'mid' ELSE 'high' END AS band, value >= 100 AND value < 700 AS cover FROM field", "field"))
def field_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts by class, and the cover of a bound."""
    band = F.when(F.col("value") < 100, "low").when(F.col("value") < 700, "mid").otherwise("high")
    return field(spark, sf_dir).select("i", "j", "value", band.alias("band"), ((F.col("value") >= 100) & (F.col("value") < 700)).alias("cover"))


@query("SELECT c_custkey, round(log2(c_acctbal + 2000), 8) AS l2, round(log10(c_acctbal + 2000), 8) AS l10, round(cbrt(c_acctbal), 8) + 0.0 AS root, round(atan2(c_acctbal, 100), 8) + 0.0 AS angle, round(sinh(c_acctbal / 10000), 8) + 0.0 AS sh, round(tanh(c_acctbal / 10000), 8) + 0.0 AS th FROM customer")
def engine_maths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that formulas don't have."""
    b = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(F.log2(b + 2000), 8).alias("l2"), F.round(F.log10(b + 2000), 8).alias("l10"), (F.round(F.cbrt(b), 8) + 0.0).alias("root"), (F.round(F.atan2(b, F.lit(100.0)), 8) + 0.0).alias("angle"), (F.round(F.sinh(b / 10000), 8) + 0.0).alias("sh"), (F.round(F.tanh(b / 10000), 8) + 0.0).alias("th"))


@query("SELECT o_orderkey, string_split('lib//town/./' || o_orderkey || '/../kinds.toml', '/')[1] || '/town/kinds.toml' AS path FROM orders")
def normalized_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: paths without empty parts, dots and what they undo."""
    return table(spark, sf_dir, "orders").select("o_orderkey", text.normalized(F.concat(F.lit("lib//town/./"), F.col("o_orderkey"), F.lit("/../kinds.toml"))).alias("path"))


@query(sql("SELECT path, list([x_mm, y_mm] ORDER BY seq DESC)[1][1] AS first_x, count(*) AS n, min(x_mm) AS least FROM vertices GROUP BY path", "vertices"))
def reversed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested points, reversed and read."""
    from .views import vertices

    nested = vertices(spark, sf_dir).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "x_mm", "y_mm"))).alias("points"))
    turned = nested.withColumn("points", F.reverse("points"))
    return turned.select("path", F.get("points", F.lit(0))["x_mm"].alias("first_x"), F.size("points").cast("long").alias("n"), F.array_min(F.col("points.x_mm")).alias("least"))
