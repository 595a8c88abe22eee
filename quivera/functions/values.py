"""Value functions: coercion to the type of a property key, and relation ids as strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.schema import PropertyKey

#: Digits of a relation id's parts, least first (fixed values).
DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"
BASE = 36


def coerce(column: Column, key: PropertyKey) -> Column:
    """A value as its key's type; what has no such value becomes null."""
    return column.try_cast(key.spark_type())


def relation_id(relation: Column, out_vertex: Column, label: Column, in_vertex: Column | None = None) -> Column:
    """relation-outVertex-type[-inVertex], each number in base 36 in lower case."""
    parts = [relation, out_vertex, label] + ([] if in_vertex is None else [in_vertex])
    return F.concat_ws("-", *[F.lower(F.conv(p.cast("string"), 10, BASE)) for p in parts])


def parse_relation_id(column: Column) -> Column:
    """A struct of the four numbers; in_vertex is null for properties."""
    parts = F.split(column, "-")
    number = lambda k: F.conv(F.upper(F.get(parts, F.lit(k))), BASE, 10).cast("long")
    return F.struct(number(0).alias("relation"), number(1).alias("out_vertex"), number(2).alias("label"), number(3).alias("in_vertex"))
