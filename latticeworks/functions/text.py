"""Ids, produced names and exact numbers in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_id(name: Column) -> Column:
    return name.rlike("^[a-z][a-z0-9_]*$")


def repaired(name: Column) -> Column:
    """An id to suggest: lower case, other characters as one underscore, from the first letter on."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9_]+", "_"), "^[^a-z]+", "")


def split_name(name: Column) -> tuple[Column, Column]:
    """Maker and key of a produced name, at its last ``#``."""
    return F.regexp_extract(name, "^(.*)#[^#]*$", 1), F.substring_index(name, "#", -1)


def millimetres(metres: Column) -> Column:
    """Exact: text with more than three decimals, or that is no number, is an error."""
    good = metres.rlike(r"^-?[0-9]+(\.[0-9]{1,3})?$")
    return F.when(good, (metres.cast("decimal(20,3)") * 1000).cast("long")).otherwise(F.raise_error(F.concat(F.lit("number.precision: "), metres)).cast("long"))


def normalized(path: Column) -> Column:
    """A relative path without empty parts and dots, each ``..`` undoing the part before it; one that would leave is an error."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    start = F.array().cast("array<string>")
    walked = F.aggregate(parts, start, lambda done, p: F.when(p != "..", F.concat(done, F.array(p))).when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(F.raise_error(F.lit("path.leaves")).cast("string")))))
    return F.array_join(walked, "/")
