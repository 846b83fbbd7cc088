"""Queries on flows of several receivers, sediment, climate and crossings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import climate, flow, raster, ways
from ..storage import materialize
from .registry import query
from .views import field, points, sites, sql, table


def _drained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster without hollows: i, j, value, was."""
    f = raster.with_rim(field(spark, sf_dir))
    filled = raster.fill(f, F.col("rim"), epsilon=0.25)
    return materialize(f.join(filled, ["i", "j"]).select("i", "j", F.col("filled").alias("value"), F.col("value").alias("was")), "drained")


@query()
def upstream_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area that drains through each post, by the steepest triangles of the surface without hollows."""
    land = _drained(spark, sf_dir)
    return flow.discharge(land, flow.converge(land), F.lit(1.0)).select("i", "j", F.round("discharge", 6).alias("area"))


@query()
def spread_discharge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discharge over all lower neighbours, and again with channels that converge."""
    land = _drained(spark, sf_dir)
    first = flow.discharge(land, flow.spread(land), F.lit(1.0))
    return flow.discharge(land, flow.hybrid(land, first, 40.0), F.lit(1.0)).select("i", "j", F.round("discharge", 6).alias("discharge"))


@query()
def routed_sediment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is loosened is carried down, and kept in hollows and channels."""
    land = _drained(spark, sf_dir)
    ties = materialize(flow.spread(land), "ties")
    run = flow.discharge(land, ties, F.lit(1.0))
    wet = F.when(F.col("value") - F.col("was") >= 60, F.col("value"))
    loose = land.join(run, ["i", "j"]).select("i", "j", F.col("was").alias("value"), F.lit(0.5).alias("detached"), "discharge", wet.alias("water"))
    return flow.route_sediment(loose, ties, 1.0, 8.0).select("i", "j", *(F.round(c, 6).alias(c) for c in ("value", "deposited", "passed")))


_FOLLOW = 1.0 - math.exp(-1.0 / 4.0)
_LIFT = f"(air + {_FOLLOW!r} * (greatest(f.value, 200.0) - air))"
_LAND = f"least((0.02 + 0.1 * (greatest({_LIFT} - air, 0.0) / 100.0)) * humid, humid)"
_TAKEN = "(humid + 0.2 * (1.0 - humid))"


def _swept(before: str) -> str:
    """A step of the sweep over posts f, after the columns air and humid of what came before."""
    return f"SELECT f.i, f.j, f.value, {_LIFT} AS air, CASE WHEN f.value < 200 THEN {_TAKEN} ELSE humid - {_LAND} END AS humid, CASE WHEN f.value < 200 THEN 0.02 * {_TAKEN} ELSE {_LAND} END AS rain FROM {before}"


_RAIN = (
    "WITH o AS (SELECT x, y FROM (VALUES (-1), (0), (1)) a(x), (VALUES (-1), (0), (1)) b(y)), r AS ("
    + _swept("(SELECT *, CAST(200 AS DOUBLE) AS air, CAST(1 AS DOUBLE) AS humid FROM field QUALIFY row_number() OVER (PARTITION BY j ORDER BY i) = 1) f")
    + " UNION ALL "
    + _swept("r JOIN field f ON f.j = r.j AND f.i = r.i + 1")
    + "), b1 AS (SELECT a.i, a.j, avg(b.rain) AS rain FROM r a CROSS JOIN o JOIN r b ON b.i = a.i + o.x AND b.j = a.j + o.y GROUP BY 1, 2), b2 AS (SELECT a.i, a.j, avg(b.rain) AS rain FROM b1 a CROSS JOIN o JOIN b1 b ON b.i = a.i + o.x AND b.j = a.j + o.y GROUP BY 1, 2)"
    " SELECT i, j, round(rain * 0.8 / (SELECT avg(b2.rain) FROM b2 JOIN field USING (i, j) WHERE value >= 200), 6) AS rain FROM b2"
)


@query(sql(_RAIN, "field").replace("WITH field", "WITH RECURSIVE field", 1))
def rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rain under a wind from the west."""
    return climate.precipitation(field(spark, sf_dir), (1, 0), 200.0, 0.8).select("i", "j", F.round("rain", 6).alias("rain"))


@query(sql("SELECT i, j, round(12.0 - 6.5 * greatest(value - 200.0, 0.0) / 1000.0 + 3.0 * ((j + 0.5) / 500 - 0.5), 6) AS warmth FROM field", "field"))
def warmth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean warmth, by height and row."""
    return climate.temperature(field(spark, sf_dir), 500, 200.0).select("i", "j", F.round("warmth", 6).alias("warmth"))


_CROSSINGS = "SELECT 'c' || o_orderkey AS name, (o_orderkey % 23) / 10.0 AS width, o_custkey % 300 AS length, CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderkey % 40 AS DOUBLE) END AS ground, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 40 + (o_custkey % 13) / 4.0 END AS water, o_orderkey % 40 + 3.0 AS deck, CAST(1.5 AS DOUBLE) AS freeboard FROM orders"
_MEETINGS = "SELECT 'c' || l_orderkey || CASE WHEN l_linenumber % 2 = 0 THEN '.start' ELSE '.end' END AS a, CASE WHEN l_partkey % 11 = 0 THEN 'c' || l_orderkey || '.start' ELSE 'w' || l_partkey || CASE WHEN l_partkey % 7 = 0 THEN '' ELSE '.end' END END AS b, l_suppkey % 4 AS gap FROM lineitem"


def _crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    foot = key % 40
    return o.select(F.concat(F.lit("c"), key.cast("string")).alias("name"), (key % 23 / 10.0).alias("width"), (F.col("o_custkey") % 300).alias("length"), F.when(key % 17 != 0, foot.cast("double")).alias("ground"), F.when(key % 5 != 0, foot + F.col("o_custkey") % 13 / 4.0).alias("water"), (foot + 3.0).alias("deck"), F.lit(1.5).alias("freeboard"))


def _meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, owner, way = table(spark, sf_dir, "lineitem"), F.concat(F.lit("c"), F.col("l_orderkey").cast("string")), F.concat(F.lit("w"), F.col("l_partkey").cast("string"))
    end = F.when(F.col("l_linenumber") % 2 == 0, ".start").otherwise(".end")
    other = F.when(F.col("l_partkey") % 11 == 0, F.concat(owner, F.lit(".start"))).otherwise(F.concat(way, F.when(F.col("l_partkey") % 7 == 0, "").otherwise(".end")))
    return l.select(F.concat(owner, end).alias("a"), other.alias("b"), (F.col("l_suppkey") % 4).alias("gap"))


@query(f"WITH c AS ({_CROSSINGS}), r AS (SELECT name, round(width / 2 - 0.3, 3) AS o, CASE WHEN length > 0 THEN round(50.0 / length, 6) ELSE 0 END AS s FROM c), k AS (SELECT *, CASE WHEN o <= 0 THEN 'narrow' WHEN s >= 0.5 THEN 'short' END AS refused FROM r) SELECT name, name || '_parapet_' || side AS key, 'wall' AS asset, CAST(1.2 AS DOUBLE) AS spacing, CAST(s AS DOUBLE) AS first, CAST(round(1 - s, 6) AS DOUBLE) AS last, o * sign AS offset, refused FROM k, (VALUES ('l', 1), ('r', -1)) v(side, sign) WHERE refused IS NULL UNION ALL SELECT name, NULL, NULL, NULL, NULL, NULL, NULL, refused FROM k WHERE refused IS NOT NULL")
def parapet_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of pieces along each crossing, or why there are none."""
    return ways.parapets(_crossings(spark, sf_dir), "wall", 600, 100, 1.2)


@query(f"WITH c AS ({_CROSSINGS}), m AS ({_MEETINGS}), e AS (SELECT name, name || '.' || part AS place FROM c, (VALUES ('start'), ('end')) v(part)), t AS (SELECT a AS place, b AS other, gap FROM m UNION ALL SELECT b, a, gap FROM m WHERE a <> b), w AS (SELECT * FROM t WHERE regexp_extract(other, '^(.*)\\.(start|end)$', 1) NOT IN ('', regexp_extract(place, '^(.*)\\.(start|end)$', 1))), j AS (SELECT e.place, other, gap FROM e LEFT JOIN w USING (place)) SELECT 'dry' AS code, name AS subject, round(water - ground, 3) AS measure FROM c WHERE ground IS NOT NULL AND (water IS NULL OR water - ground <= 0.3) UNION ALL SELECT 'low_deck', name, round(deck - water, 3) FROM c WHERE ground IS NOT NULL AND water - ground > 0.3 AND deck - water < freeboard UNION ALL SELECT 'deck_unmet', place, NULL FROM j WHERE other IS NULL UNION ALL SELECT 'deck_gap', place, CAST(gap AS DOUBLE) FROM j WHERE gap <> 0")
def crossing_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Water beneath, freeboard, and whether ways arrive at both ends, level."""
    return ways.judge(_crossings(spark, sf_dir), _meetings(spark, sf_dir), 0.3)


_ENDS = "SELECT 'p' || id || '.end' AS place, kind, x_mm, y_mm, id % 9 / 2.0 AS z FROM points UNION ALL SELECT CASE WHEN id % 6 = 0 THEN 'hill.' ELSE '' END || 's' || id || '.start', 'crossing', x_mm, y_mm, id % 7 / 2.0 FROM sites"
_JOINED = "SELECT 'p' || id || '.end' AS a, 'p' || (id + 1) || '.end' AS b FROM points WHERE id % 2 = 0"


@query(sql(f"WITH e AS ({_ENDS}), m AS ({_JOINED}), t AS (SELECT a, b FROM m UNION SELECT b, a FROM m), q AS (SELECT a.place AS a, b.place AS b, (a.x_mm - b.x_mm) ** 2 + (a.y_mm - b.y_mm) ** 2 AS d2, round(abs(a.z - b.z), 3) AS gap, a.kind AS ak, b.kind AS bk FROM e a JOIN e b ON a.place < b.place AND a.kind <> b.kind AND abs(a.x_mm - b.x_mm) <= 1000 AND abs(a.y_mm - b.y_mm) <= 1000) SELECT a, b, CAST(d2 AS BIGINT) AS d2, gap FROM q WHERE d2 <= 1000000 AND (NOT contains(regexp_replace(a, '\\.(start|end)$', ''), '.') OR NOT contains(regexp_replace(b, '\\.(start|end)$', ''), '.')) AND NOT EXISTS (SELECT 1 FROM t WHERE t.a = q.a AND t.b = q.b) AND (ak = 'crossing' OR bk = 'crossing' OR NOT EXISTS (SELECT 1 FROM t x JOIN t y ON x.b = y.b WHERE x.a = q.a AND y.a = q.b))", "points", "sites"))
def unjoined_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of ways of different kinds that are near one another and don't meet."""
    place = lambda key, lead, part: F.concat(lead, key.cast("string"), F.lit(part))
    p, s, key = points(spark, sf_dir), sites(spark, sf_dir), F.col("id")
    ends = p.select(place(key, F.lit("p"), ".end").alias("place"), "kind", "x_mm", "y_mm", (key % 9 / 2.0).alias("z"))
    lead = F.when(key % 6 == 0, "hill.s").otherwise("s")
    ends = ends.unionByName(s.select(place(key, lead, ".start").alias("place"), F.lit("crossing").alias("kind"), "x_mm", "y_mm", (key % 7 / 2.0).alias("z")))
    joined = p.where("id % 2 = 0").select(place(key, F.lit("p"), ".end").alias("a"), place(key + 1, F.lit("p"), ".end").alias("b"))
    return ways.unjoined(ends, joined, 1000)
