"""Rules about ways: parapets along crossings, and what is wrong with a crossing's water, deck and ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import within_radius


def parapets(crossings: DataFrame, asset: str, piece_width: int, piece_depth: int, spacing: float) -> DataFrame:
    """name, key, asset, spacing, first, last, offset, refused: a run of pieces on each side of a crossing (name, width in metres, length in mm), over the
    share first to last of its line. One row with ``refused`` instead (narrow: no deck between the runs; short: no length between their ends)
    where they don't fit."""
    beside = F.round(F.col("width") / 2 - piece_width / 2000, 3)
    inset = F.when(F.col("length") > 0, F.round(F.lit(piece_depth / 2) / F.col("length"), 6)).otherwise(F.lit(0.0))
    refused = F.when(beside <= 0, "narrow").when(inset >= 0.5, "short")
    side = lambda name, sign: F.struct(F.lit(name).alias("side"), F.lit(sign).alias("sign"))
    none = F.array(F.struct(F.lit(None).cast("string").alias("side"), F.lit(None).cast("int").alias("sign")))
    rows = crossings.select("name", beside.alias("beside"), inset.alias("first"), refused.alias("refused"), F.explode(F.when(refused.isNull(), F.array(side("l", 1), side("r", -1))).otherwise(none)).alias("s"))
    laid = lambda c: F.when(F.col("refused").isNull(), c)
    key = F.concat(F.regexp_replace("name", r"[^\p{L}\p{N}_-]", "_"), F.lit("_parapet_"), F.col("s.side"))
    return rows.select("name", laid(key).alias("key"), laid(F.lit(asset)).alias("asset"), laid(F.lit(spacing)).alias("spacing"), laid(F.col("first")).alias("first"), laid(F.round(1 - F.col("first"), 6)).alias("last"), laid(F.col("beside") * F.col("s.sign")).alias("offset"), "refused")


def judge(crossings: DataFrame, meetings: DataFrame, wet: float) -> DataFrame:
    """code, subject, measure: ``dry`` (no water of a depth over ``wet`` under the middle), ``low_deck`` (the deck's height over the water is less than
    its freeboard), ``deck_unmet`` (no other way's end meets an end of the crossing), ``deck_gap`` (one does at another height).

    crossings: name, ground, water (null: none), deck, freeboard, with a null ground where the middle isn't known; meetings: a, b (places as
    <feature>.start or <feature>.end), gap.
    """
    known = crossings.where("ground is not null")
    dry = F.col("water").isNull() | (F.col("water") - F.col("ground") <= wet)
    beneath = known.select(F.when(dry, "dry").when(F.col("deck") - F.col("water") < F.col("freeboard"), "low_deck").alias("code"), F.col("name").alias("subject"), F.when(dry, F.round(F.col("water") - F.col("ground"), 3)).otherwise(F.round(F.col("deck") - F.col("water"), 3)).alias("measure")).where("code is not null")
    ends = crossings.select("name", F.explode(F.array(F.lit("start"), F.lit("end"))).alias("end")).select("name", F.concat_ws(".", "name", "end").alias("place"))
    both = meetings.select(F.col("a").alias("place"), F.col("b").alias("other"), "gap").unionByName(meetings.select(F.col("b").alias("place"), F.col("a").alias("other"), "gap").where("place != other"))
    owner = F.regexp_extract("other", r"^(.*)\.(start|end)$", 1)
    ways = both.where((owner != "") & (owner != F.regexp_extract("place", r"^(.*)\.(start|end)$", 1)))
    met = ends.join(ways, "place", "left")
    unmet = met.where("other is null").select(F.lit("deck_unmet").alias("code"), F.col("place").alias("subject"), F.lit(None).cast("double").alias("measure"))
    gaps = met.where("gap != 0").select(F.lit("deck_gap").alias("code"), F.col("place").alias("subject"), F.col("gap").cast("double").alias("measure"))
    return beneath.unionByName(unmet).unionByName(gaps)


def _own(place: Column) -> Column:
    """Whether a place is the world's own: its feature has no import's name before it."""
    return ~F.regexp_replace(place, r"\.(start|end)$", "").contains(".")


def unjoined(ends: DataFrame, meetings: DataFrame, reach: int) -> DataFrame:
    """a, b, d2, gap: ends of ways of different kinds (place, kind, x_mm, y_mm, z), at most ``reach`` apart in plan, that no meeting (a, b) joins, a before
    b. At least one is the world's own; and, if neither is a crossing's, no place meets both."""
    at = ends.select(F.col("place").alias("id"), "x_mm", "y_mm")
    close = within_radius(at, at, reach).where("id < site")
    kinds = lambda name, end: ends.select(F.col("place").alias(name), F.col("kind").alias(f"{end}_kind"), F.col("z").alias(f"{end}_z"))
    pairs = close.join(kinds("id", "a"), "id").join(kinds("site", "b"), "site").where("a_kind != b_kind").where(_own(F.col("id")) | _own(F.col("site")))
    joined = meetings.select(F.least("a", "b").alias("id"), F.greatest("a", "b").alias("site")).distinct()
    apart = pairs.join(joined, ["id", "site"], "left_anti")
    both = meetings.select("a", "b").unionByName(meetings.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    shared = apart.select("id", "site").join(both.select(F.col("a").alias("id"), F.col("b").alias("third")), "id").join(both.select(F.col("a").alias("site"), F.col("b").alias("third")), ["site", "third"]).select("id", "site").distinct()
    found = apart.join(shared.withColumn("third", F.lit(True)), ["id", "site"], "left").where("third is null or a_kind = 'crossing' or b_kind = 'crossing'")
    return found.select(F.col("id").alias("a"), F.col("site").alias("b"), "d2", F.round(F.abs(F.col("a_z") - F.col("b_z")), 3).alias("gap"))
