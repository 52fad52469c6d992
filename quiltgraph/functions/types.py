"""Static types of expressions.

Scalars: "int" "float" "str" "bool" "date" "ldt" (local date-time) "dt" (with offset and
zone) "ltime" (nanoseconds of the day) "time" (with offset) "dur" "null" "any".
Compound: ("list", t), ("map", ((key, t), ...)), ("node", ((key, t), ...)), ("rel", same).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Typed(NamedTuple):
    col: Column
    t: object


NUMBERS = ("int", "float")
DURATION = T.StructType([T.StructField(x, T.LongType()) for x in ("months", "days", "seconds", "nanos")])
DATETIME = T.StructType([T.StructField("local", T.TimestampNTZType()), T.StructField("offset", T.IntegerType()), T.StructField("zone", T.StringType())])
TIME = T.StructType([T.StructField("nanos", T.LongType()), T.StructField("offset", T.IntegerType())])


def from_spark(d: T.DataType):
    if isinstance(d, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(d, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(d, T.StringType):
        return "str"
    if isinstance(d, T.BooleanType):
        return "bool"
    if isinstance(d, T.DateType):
        return "date"
    if isinstance(d, (T.TimestampType, T.TimestampNTZType)):
        return "ldt"
    if isinstance(d, T.ArrayType):
        return ("list", from_spark(d.elementType))
    if isinstance(d, T.StructType):
        names = d.fieldNames()
        if names == DURATION.fieldNames():
            return "dur"
        if names == DATETIME.fieldNames():
            return "dt"
        if names == TIME.fieldNames():
            return "time"
        kind = "node" if names[:2] == ["_id", "_labels"] else "rel" if names[:4] == ["_id", "_src", "_dst", "_type"] else "map"
        skip = {"node": 2, "rel": 4, "map": 0}[kind]
        return (kind, tuple((f.name, from_spark(f.dataType)) for f in d.fields[skip:]))
    if isinstance(d, T.NullType):
        return "null"
    return "any"


def widened(column: Column, d: T.DataType) -> Column:
    """Integers as 64 bits, floats as doubles, instants as local date-times."""
    if isinstance(d, (T.ByteType, T.ShortType, T.IntegerType)):
        return column.cast("bigint")
    if isinstance(d, (T.FloatType, T.DecimalType)):
        return column.cast("double")
    if isinstance(d, T.TimestampType):
        return column.cast("timestamp_ntz")
    return column


def joined(a, b):
    """The one type of two alternatives."""
    if a == b or b == "null":
        return a
    if a == "null":
        return b
    if a in NUMBERS and b in NUMBERS:
        return "float"
    if isinstance(a, tuple) and isinstance(b, tuple) and a[0] == b[0] == "list":
        return ("list", joined(a[1], b[1]))
    return "any"


def is_list(t) -> bool:
    return isinstance(t, tuple) and t[0] == "list"


def null() -> Typed:
    return Typed(F.lit(None), "null")


def all_of(*columns: Column) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out & c
    return out
