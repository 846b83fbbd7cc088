"""Queries on documents, changes, checks and shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import relational
from .registry import query
from .views import points, sites, sql, table


@query("SELECT o_orderkey, o_custkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References resolved by id."""
    c = relational.lookup(table(spark, sf_dir, "customer"), "c_nationkey", table(spark, sf_dir, "nation"), "n_nationkey")
    return relational.lookup(table(spark, sf_dir, "orders"), "o_custkey", c, "c_custkey").select("o_orderkey", "o_custkey", "c_name", "n_name")


@query("SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unknown_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that nothing answers."""
    return relational.unknown(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT d.doc_id, coalesce(l.quality, d.doc_id % 2) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def kind_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own values win over defaults."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(None).cast("long").alias("quality"), F.lit(None).cast("long").alias("toxic"))
    own = relational.overlay(docs, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic")), "doc_id", ["quality", "toxic"])
    return own.select("doc_id", F.coalesce("quality", F.col("doc_id") % 2).alias("quality"), F.coalesce("toxic", F.lit(0).cast("long")).alias("toxic"))


@query(sql("SELECT x_mm // 64000 AS cx, y_mm // 64000 AS cy, count(*) AS instances, count(DISTINCT kind) AS groups, arg_max(kind, n) AS dominant, count(*) > 90 AS over FROM (SELECT *, count(*) OVER (PARTITION BY x_mm // 64000, y_mm // 64000, kind) * 1000 - length(kind) AS n FROM points) GROUP BY 1, 2", "points"))
def chunk_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, groups and the dominating asset per chunk, against a budget."""
    by = [F.floor(F.col("x_mm") / 64_000).alias("cx"), F.floor(F.col("y_mm") / 64_000).alias("cy")]
    own = points(spark, sf_dir).groupBy(*by, "kind").agg(F.count("*").alias("n"))
    return own.groupBy("cx", "cy").agg(F.sum("n").alias("instances"), F.count("*").alias("groups"), F.max_by("kind", F.col("n") * 1000 - F.length("kind")).alias("dominant"), (F.sum("n") > 90).alias("over"))


@query("SELECT event_type, user_id, event_id, count(*) OVER (PARTITION BY event_type, user_id) AS n FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY value DESC, event_id) <= 5")
def diagnostic_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by code and subject, with a count and the five worst."""
    return relational.fold(table(spark, sf_dir, "events"), ["event_type", "user_id"], [F.desc("value"), F.col("event_id")]).select("event_type", "user_id", "event_id", "n")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') > 0 AS fails FROM events GROUP BY 1")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by severity and the status they give."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), (F.count_if(F.col("event_type") == "error") > 0).alias("fails"))


@query(sql("WITH r AS (SELECT kind, id, id % 17 + 1 AS w, sum(id % 17 + 1) OVER (PARTITION BY kind ORDER BY id) AS running, sum(id % 17 + 1) OVER (PARTITION BY kind) AS total FROM points) SELECT kind, id, CAST(running AS BIGINT) AS running FROM r WHERE running > total * 37 // 100 QUALIFY row_number() OVER (PARTITION BY kind ORDER BY id) = 1", "points"))
def weighted_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first entry whose running weight exceeds a target."""
    p = points(spark, sf_dir).select("kind", "id", (F.col("id") % 17 + 1).alias("w"))
    return relational.weighted_choice(p, "kind", "id", "w", F.expr("total * 37 div 100")).select("kind", "id", "running")


@query(sql("WITH w AS (SELECT kind, nation, sum(id % 97 + 1) AS w FROM points GROUP BY 1, 2), t AS (SELECT *, sum(w) OVER (PARTITION BY kind) AS total FROM w), f AS (SELECT kind, nation, w * 255 // total AS fl, w * 255 % total AS rest FROM t) SELECT kind, nation, CAST(fl + CASE WHEN row_number() OVER (PARTITION BY kind ORDER BY rest DESC, nation) <= 255 - sum(fl) OVER (PARTITION BY kind) THEN 1 ELSE 0 END AS BIGINT) AS share FROM f", "points"))
def largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights as bytes that add up to 255."""
    w = points(spark, sf_dir).groupBy("kind", "nation").agg(F.sum(F.col("id") % 97 + 1).alias("w"))
    return relational.largest_remainder(w, "kind", "nation", "w", 255)


@query("WITH o AS (SELECT o_orderkey, o_orderstatus, o_custkey FROM orders WHERE o_orderkey % 10 <> 0), n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_custkey + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS o_custkey FROM orders WHERE o_orderkey % 9 <> 0) SELECT o_orderkey, o.o_orderstatus AS old_o_orderstatus, o.o_custkey AS old_o_custkey, n.o_orderstatus AS new_o_orderstatus, n.o_custkey AS new_o_custkey, CASE WHEN o.o_custkey IS NULL THEN 'added' WHEN n.o_custkey IS NULL THEN 'removed' WHEN o.o_orderstatus = n.o_orderstatus AND o.o_custkey = n.o_custkey THEN 'untouched' ELSE 'changed' END AS status FROM o FULL JOIN n USING (o_orderkey)")
def change_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was added, removed and changed, before and after."""
    return relational.changes(*_sides(spark, sf_dir), "o_orderkey", ["o_orderstatus", "o_custkey"])


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    new = o.where("o_orderkey % 9 != 0").withColumns({"o_orderstatus": F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")), "o_custkey": F.col("o_custkey") + F.when(F.col("o_orderkey") % 11 == 0, 1).otherwise(0)})
    return o.where("o_orderkey % 10 != 0"), new


@query("WITH s AS (SELECT CASE WHEN o_orderkey % 10 = 0 AND o_orderkey % 9 <> 0 THEN 'added' WHEN o_orderkey % 9 = 0 AND o_orderkey % 10 <> 0 THEN 'removed' WHEN o_orderkey % 7 = 0 AND o_orderstatus <> 'X' OR o_orderkey % 11 = 0 THEN 'changed' ELSE 'untouched' END AS status, o_orderkey FROM orders WHERE o_orderkey % 10 <> 0 OR o_orderkey % 9 <> 0) SELECT status, count(*) AS n, min(o_orderkey) AS least, max(o_orderkey) AS greatest FROM s GROUP BY 1")
def change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much changed, and where."""
    return change_report(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("least"), F.max("o_orderkey").alias("greatest"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'FIELD' WHEN c_custkey % 6 = 1 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 6 <> 2 UNION ALL SELECT 1000000 + s_suppkey, 'NEW' FROM supplier")
def change_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M2: rows after set, unset, remove and add."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    op = F.when(F.col("c_custkey") % 6 == 0, "set").when(F.col("c_custkey") % 6 == 1, "unset").otherwise("remove")
    edits = c.where("c_custkey % 6 < 3").select("c_custkey", op.alias("op"), F.lit("FIELD").alias("value"), F.lit(1).alias("seq"))
    added = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1_000_000).alias("c_custkey"), F.lit("add").alias("op"), F.lit("NEW").alias("value"), F.lit(1).alias("seq"))
    return relational.apply_changes(c, edits.unionByName(added), "c_custkey", "c_mktsegment")


_WRITES = "SELECT 'change' || (p_partkey % 12) AS change, CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE p_type || '/' || p_brand END AS path FROM part"


@query(f"WITH w AS ({_WRITES}) SELECT DISTINCT least(a.change, b.change) AS one, greatest(a.change, b.change) AS two, a.path AS shared FROM w a JOIN w b ON a.change <> b.change AND (b.path = a.path OR starts_with(b.path, a.path || '/'))")
def change_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that write one path, or a path and its prefix."""
    p = table(spark, sf_dir, "part")
    path = F.when(F.col("p_partkey") % 5 == 0, F.col("p_type")).otherwise(F.concat("p_type", F.lit("/"), "p_brand"))
    return relational.conflicts(p.select(F.concat(F.lit("change"), F.col("p_partkey") % 12).alias("change"), path.alias("path")), "change", "path")


@query("SELECT DISTINCT event_type, user_id FROM events")
def once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identical findings once."""
    return table(spark, sf_dir, "events").select("event_type", "user_id").distinct()


@query("SELECT l_returnflag, l_linestatus, l_partkey FROM lineitem EXCEPT ALL SELECT l_returnflag, l_linestatus, l_partkey + l_linenumber % 2 FROM lineitem")
def bag_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes one copy of each record."""
    l = table(spark, sf_dir, "lineitem")
    moved = (F.col("l_partkey") + F.col("l_linenumber") % 2).alias("l_partkey")
    return relational.bag_difference(l.select("l_returnflag", "l_linestatus", "l_partkey"), l.select("l_returnflag", "l_linestatus", moved))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def key_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two things of one maker with one key."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("WITH u AS (SELECT DISTINCT replace(p_name, 'r', 'n') AS name FROM part), k AS (SELECT DISTINCT p_name AS candidate FROM part) SELECT name, candidate, CAST(levenshtein(name, candidate) AS BIGINT) AS distance FROM u JOIN k ON levenshtein(name, candidate) <= 3 QUALIFY row_number() OVER (PARTITION BY name ORDER BY distance, candidate) <= 5")
def nearest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest known names of unknown ones, met by shared pieces."""
    p = table(spark, sf_dir, "part")
    found = relational.nearest_names(p.select(F.replace("p_name", F.lit("r"), F.lit("n")).alias("name")), "name", p.select(F.col("p_name").alias("candidate")).distinct(), "candidate", 3, 5)
    return found.select("name", "candidate", F.col("distance").cast("long").alias("distance"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An attribute out of JSON text."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT event_type, round(regr_slope(value, user_id), 8) AS slope, round(regr_intercept(value, user_id), 6) AS intercept, round(regr_r2(value, user_id), 8) AS r2, median(value) AS middle, quantile_cont(value, 0.9) BETWEEN 0 AND 1000 AS passes FROM events GROUP BY 1")
def fitted_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, linear fit and gates."""
    e = table(spark, sf_dir, "events")
    y, x = F.col("value"), F.col("user_id").cast("double")
    return e.groupBy("event_type").agg(F.round(F.regr_slope(y, x), 8).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"), F.round(F.regr_r2(y, x), 8).alias("r2"), F.median("value").alias("middle"), F.percentile("value", 0.9).between(0, 1000).alias("passes"))


@query("SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total, round(sum(l_extendedprice) / count(*), 4) AS mean, min(l_tax) AS least, max(l_tax) AS greatest FROM lineitem GROUP BY 1")
def plain_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums in parts, means, and extremes."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"), F.round(F.sum("l_extendedprice") / F.count("*"), 4).alias("mean"), F.min("l_tax").alias("least"), F.max("l_tax").alias("greatest"))


@query("SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def fixed_order_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: a sum whose bits don't depend on partitions."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return relational.fixed_sum(o, ["o_orderpriority"], "o_orderkey", "o_totalprice").select("o_orderpriority", F.round("total", 2).alias("total"))


@query("SELECT o_custkey, round(product(1 + o_orderkey % 7 / 100.0), 8) AS grown FROM orders GROUP BY 1")
def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: products by group."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.product(1 + F.col("o_orderkey") % 7 / F.lit(100.0)), 8).alias("grown"))


@query("SELECT p_partkey, regexp_full_match(p_name, '[a-z][a-z0-9_]*') AS valid, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9_]+', '_', 'g'), '^[^a-z]+', '') AS repaired FROM part")
def id_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids checked, and a repair to suggest."""
    return table(spark, sf_dir, "part").select("p_partkey", text.is_id(F.col("p_name")).alias("valid"), text.repaired(F.col("p_name")).alias("repaired"))


@query("SELECT c_custkey, CAST(round(c_acctbal * 100) * 10 AS BIGINT) AS mm FROM customer")
def exact_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimal text to whole millimetres, without a double between."""
    return table(spark, sf_dir, "customer").select("c_custkey", text.millimetres(F.format_string("%.2f", "c_acctbal")).alias("mm"))


@query(sql("SELECT id, kind || '#' || id AS name, lower(kind) AS maker, CAST(id AS VARCHAR) AS key FROM points", "points"))
def produced_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Produced names, split at the last mark."""
    p = points(spark, sf_dir).withColumn("name", F.concat_ws("#", "kind", "id"))
    maker, key = text.split_name(F.col("name"))
    return p.select("id", "name", F.lower(maker).alias("maker"), key.alias("key"))


@query("SELECT p_type, p_brand, count(*) AS n FROM part WHERE p_type LIKE 'ECONOMY%' AND p_size BETWEEN 5 AND 40 AND list_contains(['Brand#1', 'Brand#2', 'Brand#3'], p_brand) GROUP BY 1, 2")
def pack_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets by taxon prefix, tags and facts."""
    return table(spark, sf_dir, "part").where(F.col("p_type").startswith("ECONOMY") & F.col("p_size").between(5, 40) & F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3")).groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))


@query(sql("SELECT p.id, s.id AS site FROM points p LEFT JOIN sites s ON p.id = s.id * 3", "points", "sites"))
def presence_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join that keeps every row."""
    s = sites(spark, sf_dir).select((F.col("id") * 3).alias("id"), F.col("id").alias("site"))
    return points(spark, sf_dir).select("id").join(s, "id", "left")
