"""Queries on formulas, fields and rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draws
from ..functions.formula import Scope, compile_formula
from ..operators import raster, relational
from .registry import query
from .views import field, points, sql, table


def _metres() -> Scope:
    return Scope({"x": F.col("x_mm") / F.lit(1000.0), "y": F.col("y_mm") / F.lit(1000.0)})


_SMOOTH = "(CASE WHEN s < 0 THEN 0 WHEN s > 1 THEN 1 ELSE s END)"


@query(
    """
    SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, round((1 - l_discount) * l_extendedprice + l_discount * (l_extendedprice * (1 + l_tax)), 7) AS blend,
    round(least(greatest(l_quantity / 10, CAST(1 AS DOUBLE)), CAST(4 AS DOUBLE)), 6) AS level, round(sqrt(l_extendedprice) + floor(l_quantity / 7) - abs(-l_tax), 6) AS mass FROM lineitem
    """
)
def formula_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three formulas over every line, with a shared name."""
    scope = Scope({"price": F.col("l_extendedprice"), "off": F.col("l_discount"), "tax": F.col("l_tax"), "n": F.col("l_quantity")}, {"taxed": "= price * (1 + tax)"})
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.round(compile_formula("= mix(price, taxed, off)", scope), 7).alias("blend"), F.round(compile_formula("= clamp(n / 10, lo = 1, hi = 4)", scope), 6).alias("level"), F.round(compile_formula("= sqrt(price) + floor(n / 7) - abs(-tax)", scope), 6).alias("mass"))


@query(
    """
    SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, round(CASE WHEN (l_quantity > 25 AND NOT (l_discount >= 0.05)) OR l_tax == 0 THEN greatest(l_quantity, l_tax * 1000, CAST(3 AS DOUBLE)) ELSE pow(l_quantity, 2) / exp(l_discount) END, 6) AS chosen FROM lineitem
    """
)
def formula_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions and the branch that is taken."""
    scope = Scope({"n": F.col("l_quantity"), "off": F.col("l_discount"), "tax": F.col("l_tax")})
    chosen = compile_formula("= if(n > 25 and not off >= 0.05 or tax == 0, max(n, tax * 1000, 3), pow(n, 2) / exp(off))", scope)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.round(chosen, 6).alias("chosen"))


@query(sql("SELECT id, round(sin(radians(x_mm / 1000.0 % 360)), 6) + 0.0 AS sine, round(cos(radians(x_mm / 1000.0 % 360)), 6) + 0.0 AS cosine FROM points", "points"))
def formula_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigonometry in degrees, exact at the axes."""
    return points(spark, sf_dir).select("id", (F.round(compile_formula("= sin(x)", _metres()), 6) + 0.0).alias("sine"), (F.round(compile_formula("= cos(x)", _metres()), 6) + 0.0).alias("cosine"))


@query(sql(f"WITH s AS (SELECT id, x_mm, y_mm, (x_mm / 1000.0) / 100.0 AS s, 20 + 0.06 * (y_mm / 1000.0) AS b FROM points) SELECT id, x_mm, y_mm, round(b + 5 * ({_SMOOTH} * {_SMOOTH} * (3 - 2 * {_SMOOTH})) - 30, 6) AS value FROM s WHERE b + 5 * ({_SMOOTH} * {_SMOOTH} * (3 - 2 * {_SMOOTH})) - 30 > 0", "points"))
def where_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points where a formula is above 0."""
    value = compile_formula("= 20 + 0.06 * y + 5 * smoothstep(0, 100, x) - 30", _metres())
    return points(spark, sf_dir).withColumn("value", value).where("value > 0").select("id", "x_mm", "y_mm", F.round("value", 6).alias("value"))


@query(sql(f"WITH s AS (SELECT p.*, (x_mm / 1000.0) / 100.0 AS s FROM points p), v AS (SELECT s.*, 20 + 0.06 * (y_mm / 1000.0) + 5 * ({_SMOOTH} * {_SMOOTH} * (3 - 2 * {_SMOOTH})) AS value FROM s) SELECT x_mm // 64000 AS cx, y_mm // 64000 AS cy, count(*) AS posts, round(min(value), 6) AS least, round(max(value), 6) AS greatest, count(DISTINCT n_regionkey) AS regions FROM v JOIN nation ON nation = n_nationkey WHERE value > 25 GROUP BY 1, 2", "points"))
def chunk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a formula at points, a condition, a lookup and a summary per chunk."""
    value = compile_formula("= 20 + 0.06 * y + 5 * smoothstep(0, 100, x)", _metres())
    kept = points(spark, sf_dir).withColumn("value", value).where("value > 25")
    placed = relational.lookup(kept, "nation", table(spark, sf_dir, "nation"), "n_nationkey")
    return placed.groupBy(F.floor(F.col("x_mm") / 64000).alias("cx"), F.floor(F.col("y_mm") / 64000).alias("cy")).agg(F.count("*").alias("posts"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("greatest"), F.countDistinct("n_regionkey").alias("regions"))


@query("WITH g AS (SELECT i, j FROM range(64) a(i), range(48) b(j)) SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(i * 4000 AS BIGINT) AS x_mm, CAST(j * 4000 AS BIGINT) AS y_mm FROM g")
def grid_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All posts of an extent."""
    return raster.posts(spark, 64, 48).select("i", "j", (F.col("i") * 4000).alias("x_mm"), (F.col("j") * 4000).alias("y_mm"))


@query(sql("SELECT cx, cy, count(*) AS posts, CAST(sum(value) AS DOUBLE) AS total FROM (SELECT *, unnest(list_distinct([i // 8, greatest(i - 1, 0) // 8])) AS cx, j FROM field) a, LATERAL (SELECT unnest(list_distinct([(a.j + 8) // 8 - 1, greatest(a.j - 1, 0) // 8])) AS cy) b GROUP BY cx, cy", "field"))
def chunk_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square chunks that share their edge posts."""
    return raster.chunks(field(spark, sf_dir), 8).groupBy("cx", "cy").agg(F.count("*").alias("posts"), F.sum("value").alias("total"))


_GRADIENT = "CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN ({b} - {a}) / 8.0 WHEN {b} IS NOT NULL THEN ({b} - value) / 4.0 WHEN {a} IS NOT NULL THEN (value - {a}) / 4.0 END"


@query(sql(f"WITH n AS (SELECT *, lag(value) OVER (PARTITION BY j ORDER BY i) AS w, lead(value) OVER (PARTITION BY j ORDER BY i) AS e, lag(value) OVER (PARTITION BY i ORDER BY j) AS s, lead(value) OVER (PARTITION BY i ORDER BY j) AS n FROM field), g AS (SELECT i, j, {_GRADIENT.format(a='w', b='e')} AS gx, {_GRADIENT.format(a='s', b='n')} AS gy FROM n) SELECT i, j, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) AS slope FROM g", "field"))
def grid_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope by central differences, one-sided at edges."""
    return raster.slope(field(spark, sf_dir), 4.0).select("i", "j", F.round("slope", 6).alias("slope"))


@query(sql("WITH f AS (SELECT id, x_mm % 156000 AS x, y_mm % 150000 AS y FROM points), p AS (SELECT id, x // 4000 AS i0, y // 4000 AS j0, x / 4000.0 - x // 4000 AS fx, y / 4000.0 - y // 4000 AS fy FROM f) SELECT id, round((1 - fx) * (1 - fy) * a.value + fx * (1 - fy) * b.value + (1 - fx) * fy * c.value + fx * fy * d.value, 6) AS value FROM p JOIN field a ON a.i = i0 AND a.j = j0 JOIN field b ON b.i = i0 + 1 AND b.j = j0 JOIN field c ON c.i = i0 AND c.j = j0 + 1 JOIN field d ON d.i = i0 + 1 AND d.j = j0 + 1", "points", "field"))
def bilinear_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points joined to their four posts."""
    p = points(spark, sf_dir).select("id", (F.col("x_mm") % 156_000).alias("x_mm"), (F.col("y_mm") % 150_000).alias("y_mm"))
    return raster.bilinear(p, field(spark, sf_dir), 4000).select("id", F.round("value", 6).alias("value"))


@query(sql("WITH h AS (SELECT i, j, avg(value) OVER (PARTITION BY j ORDER BY i RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m, min(value) OVER (PARTITION BY j ORDER BY i RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS l FROM field) SELECT i, j, round(avg(m) OVER (PARTITION BY i ORDER BY j RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS blurred, min(l) OVER (PARTITION BY i ORDER BY j RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS least FROM h", "field"))
def box_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box blur and least value over squares of posts."""
    f = field(spark, sf_dir)
    return raster.frame(f, 2).select("i", "j", F.round("framed", 6).alias("blurred")).join(raster.frame(f, 2, "min").select("i", "j", F.col("framed").alias("least")), ["i", "j"])


@query(sql("SELECT nation.n_name AS name, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS greatest, count(*) AS posts FROM field JOIN nation ON (i + 3 * j) % 25 = n_nationkey GROUP BY 1", "field"))
def zonal_under(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field's mean, least and greatest value under each zone."""
    f = field(spark, sf_dir)
    zones = f.select("i", "j", ((F.col("i") + 3 * F.col("j")) % 25).alias("zone")).join(table(spark, sf_dir, "nation"), F.col("zone") == F.col("n_nationkey")).select(F.col("n_name").alias("name"), "i", "j")
    return raster.zonal(f, zones).select("name", F.round("mean", 6).alias("mean"), "least", "greatest", "posts")


@query(sql("WITH n AS (SELECT i, j, value, CASE WHEN (i + j) % 7 = 0 THEN value + 3 ELSE value END AS v FROM field) SELECT i // 8 AS cx, (j + 8) // 8 - 1 AS cy, min(i) AS i0, min(j) AS j0, max(i) AS i1, max(j) AS j1, count(*) AS posts, max(abs(v - value)) AS most FROM n WHERE v <> value GROUP BY 1, 2", "field"))
def field_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where two fields differ, per chunk."""
    old = field(spark, sf_dir)
    new = old.withColumn("value", F.when((F.col("i") + F.col("j")) % 7 == 0, F.col("value") + 3).otherwise(F.col("value")))
    return raster.changed_region(old, new, 8)


_ENTRIES = "SELECT l_partkey AS post, l_orderkey * 10000 + l_suppkey * 10 + l_linenumber AS ord, min(l_quantity) AS v, min(l_discount) AS m, CAST(min(l_linenumber) AS BIGINT) AS material FROM lineitem GROUP BY 1, 2"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    order = F.col("l_orderkey") * 10000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")
    return l.groupBy(F.col("l_partkey").alias("post"), order.alias("ord")).agg(F.min("l_quantity").alias("v"), F.min("l_discount").alias("m"), F.min("l_linenumber").cast("long").alias("material"))



@query(f"WITH e AS ({_ENTRIES}) SELECT post, round(list_reduce(list_prepend({{'v': CAST(0 AS DOUBLE), 'm': CAST(0 AS DOUBLE)}}, list({{'v': v, 'm': m}} ORDER BY ord)), lambda a, b: {{'v': (1 - b.m) * a.v + b.m * b.v, 'm': CAST(0 AS DOUBLE)}}).v, 6) AS value FROM e GROUP BY post")
def mix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field's entries mixed in their order."""
    e = _entries(spark, sf_dir)
    return relational.mix_rows(e, ["post"], "ord", "v", "m").select("post", F.round("value", 6).alias("value"))


@query(f"WITH e AS ({_ENTRIES}), s AS (SELECT post, material, m * coalesce(product(1 - m) OVER (PARTITION BY post ORDER BY ord DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS share FROM e) SELECT post, material, round(sum(share), 6) AS weight FROM s GROUP BY 1, 2")
def paint_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of materials after each row scales the others."""
    return relational.paint_rows(_entries(spark, sf_dir), ["post"], "ord", "material", "m").select("post", "material", F.round("weight", 6).alias("weight"))


@query(f"WITH e AS ({_ENTRIES}) SELECT post, arg_max(v, ord) AS v, max(ord) AS ord FROM e WHERE m > 0 GROUP BY post")
def last_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last entry with a mask above 0."""
    return relational.last_writer(_entries(spark, sf_dir), ["post"], "ord", "m", "v")


@query()
def flood_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each post raised to its spill over the rim, which are the posts without all 8 neighbours."""
    f = raster.with_rim(field(spark, sf_dir))
    return raster.fill(f, F.col("rim")).select("i", "j", "filled")


@query()
def least_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost of the cheapest way over 8 neighbours from a corner."""
    return raster.least_cost(field(spark, sf_dir), (F.col("i") == 0) & (F.col("j") == 0)).select("i", "j", F.round("cost", 6).alias("cost"))


@query()
def flow_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts upstream along steepest receivers."""
    return raster.accumulate(field(spark, sf_dir))


@query(sql("WITH n AS (SELECT a.i, a.j, b.i AS bi, b.j AS bj, (a.value - b.value) / CASE WHEN a.i <> b.i AND a.j <> b.j THEN sqrt(2.0) ELSE 1 END AS fall FROM field a JOIN field b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND b.value < a.value) SELECT i, j, bi, bj FROM n QUALIFY row_number() OVER (PARTITION BY i, j ORDER BY fall DESC, bj, bi) = 1", "field"))
def flow_receivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steepest lower neighbour of each post."""
    return raster.receivers(field(spark, sf_dir)).select("a.i", "a.j", F.col("b.i").alias("bi"), F.col("b.j").alias("bj"))


@query()
def scatter_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A jittered lattice thinned by a density, drawn by place."""
    streams = {p: draws.stream(0, ["rule", "trees", p]) for p in ("jitter_x", "jitter_y", "keep")}
    cells = raster.posts(spark, 64, 64)
    placed = cells.select("i", "j", *((F.col(c) * 4000 + F.rint((draws.unit(streams[f"jitter_{a}"], F.col("i"), F.col("j")) - 0.5) * 2000).cast("long")).alias(f"{a}_mm") for a, c in (("x", "i"), ("y", "j"))), draws.unit(streams["keep"], F.col("i"), F.col("j")).alias("u"))
    density = compile_formula("= 0.2 + 0.6 * smoothstep(0, 256, y)", _metres())
    return placed.withColumn("density", density).where("u < density").select(F.concat_ws("_", F.lit("s4000"), "i", "j").alias("key"), "x_mm", "y_mm", F.round("u", 9).alias("u"))


@query()
def noise_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Octaves of gradient noise at points."""
    s = draws.stream(0, ["noise", "seed", "hills"])
    x, y = F.col("x_mm") / 1000.0, F.col("y_mm") / 1000.0
    return points(spark, sf_dir).select("id", F.round(draws.fbm(x, y, s, 40.0), 9).alias("fbm"), F.round(draws.ridged(x, y, s, 40.0, octaves=3), 9).alias("ridged"))


@query("WITH p AS (SELECT l_orderkey AS path, CAST(l_partkey * 10 + l_linenumber AS BIGINT) * 1000 + l_suppkey AS seq, l_quantity AS v FROM lineitem), a AS (SELECT path, seq, avg(v) OVER (PARTITION BY path ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS once FROM p) SELECT path, seq, round(avg(once) OVER (PARTITION BY path ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM a")
def moving_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A centred mean along each path, in two passes."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), ((F.col("l_partkey") * 10 + F.col("l_linenumber")) * 1000 + F.col("l_suppkey")).alias("seq"), F.col("l_quantity").alias("v"))
    return relational.moving_mean(l, "path", "seq", "v", 2).select("path", "seq", F.round("smooth", 6).alias("smooth"))


@query(sql("SELECT a.i, a.j, b.i AS bi, b.j AS bj, abs(a.value - b.value) AS step FROM field a JOIN field b ON (b.i = a.i + 1 AND b.j = a.j) OR (b.i = a.i AND b.j = a.j + 1) WHERE abs(a.value - b.value) > 500 AND (a.i // 8 <> b.i // 8 OR (a.j + 8) // 8 <> (b.j + 8) // 8)", "field"))
def seam_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring posts across a chunk edge whose step is over a limit."""
    n = raster.neighbours(field(spark, sf_dir), 4).where("(b.i > a.i or b.j > a.j) and abs(va - vb) > 500")
    crossed = (F.floor(F.col("a.i") / 8) != F.floor(F.col("b.i") / 8)) | (F.floor(F.col("a.j") / 8) != F.floor(F.col("b.j") / 8))
    return n.where(crossed).select("a.i", "a.j", F.col("b.i").alias("bi"), F.col("b.j").alias("bj"), F.abs(F.col("va") - F.col("vb")).alias("step"))


@query(sql("WITH RECURSIVE n AS (SELECT a.i, a.j, b.i AS bi, b.j AS bj, (a.value - b.value) / CASE WHEN a.i <> b.i AND a.j <> b.j THEN sqrt(2.0) ELSE 1 END AS fall FROM field a JOIN field b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND b.value < a.value), d AS (SELECT i, j, bi, bj FROM n QUALIFY row_number() OVER (PARTITION BY i, j ORDER BY fall DESC, bj, bi) = 1), r AS (SELECT i, j, i AS pi, j AS pj FROM field UNION SELECT r.i, r.j, d.bi, d.bj FROM r JOIN d ON d.i = r.pi AND d.j = r.pj) SELECT r.i, r.j, pi, pj FROM r WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.i = pi AND d.j = pj)", "field").replace("WITH field", "WITH RECURSIVE field").replace(", RECURSIVE n", ", n"))
def basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pit that each post drains to, by jumps of doubling length."""
    return raster.basins(field(spark, sf_dir))


@query()
def flood_epsilon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fill in which each post drains by a quarter at least."""
    return raster.fill(raster.with_rim(field(spark, sf_dir)), F.col("rim"), epsilon=0.25).select("i", "j", "filled")


@query()
def discharge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: what falls on all posts upstream, along steepest receivers."""
    return raster.accumulate(field(spark, sf_dir), F.col("i") + F.col("value"))


@query()
def route_course(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts on the cheapest ways from a corner to the east edge's posts of every tenth row."""
    f = field(spark, sf_dir)
    return raster.course(f, (F.col("i") == 0) & (F.col("j") == 0), (F.col("i") == 39) & (F.pmod("j", F.lit(10)) == 9)).select("i", "j", F.round("cost", 6).alias("cost"))


_TURNS = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]
_FACETS = ", ".join(f"({n}, {k[0]}, {k[1]}, {m[0]}, {m[1]})" for n in range(8) for k, m in [[_TURNS[n], _TURNS[(n + 1) % 8]][:: 1 if n % 2 == 0 else -1]])


@query(sql(f"WITH t AS (SELECT a.i, a.j, n, ki, kj, mi, mj, a.value - k.value AS s1, k.value - m.value AS s2, a.value - m.value AS s3 FROM field a CROSS JOIN (VALUES {_FACETS}) f(n, ki, kj, mi, mj) JOIN field k ON k.i = a.i + ki AND k.j = a.j + kj JOIN field m ON m.i = a.i + mi AND m.j = a.j + mj), s AS (SELECT *, CASE WHEN s2 <= 0 THEN 0 WHEN s2 >= s1 THEN 1 ELSE atan2(s2, s1) / (pi() / 4) END AS turn, CASE WHEN s2 <= 0 THEN s1 WHEN s2 >= s1 THEN s3 / sqrt(2.0) ELSE sqrt(s1 * s1 + s2 * s2) END AS slope FROM t), b AS (SELECT * FROM s WHERE slope > 0 QUALIFY row_number() OVER (PARTITION BY i, j ORDER BY slope DESC, n) = 1) SELECT i, j, round(slope, 6) AS slope, CASE WHEN turn < 1 THEN i + ki END AS i1, CASE WHEN turn < 1 THEN j + kj END AS j1, CASE WHEN turn < 1 THEN round(1 - turn, 6) END AS share1, CASE WHEN turn > 0 THEN i + mi END AS i2, CASE WHEN turn > 0 THEN j + mj END AS j2, CASE WHEN turn > 0 THEN round(turn, 6) END AS share2 FROM b", "field"))
def flow_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to two receivers of each post, with their shares of its flow, by the steepest triangle."""
    return raster.flow_shares(field(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("slope", "share1", "share2")})


@query()
def mask_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of where a field is above a level, for each zone of rows."""
    f = field(spark, sf_dir).select(F.floor(F.col("j") / 8).alias("zone"), "i", "j", (F.col("value") - 600).alias("value"))
    return raster.outlines(f, "zone")


@query("WITH h AS (SELECT l_orderkey, count(*) AS n, min(l_shipdate) AS first FROM lineitem GROUP BY 1) SELECT CAST(n AS BIGINT) AS n, count(*) AS orders, round(avg(CAST(l_orderkey AS DOUBLE)), 4) AS middle FROM h GROUP BY 1")
def partial_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of counts, in parts and then whole."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return n.groupBy("n").agg(F.count("*").alias("orders"), F.round(F.avg(F.col("l_orderkey").cast("double")), 4).alias("middle"))
