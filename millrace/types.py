"""The three types of the dialect and their Spark types."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T

from .errors import TypeMismatch


class Kind(Enum):
    INT = "Int"
    DOUBLE = "Double"
    STRING = "String"


def kind_of(data_type: T.DataType) -> Kind:
    """The dialect's type of a Spark column. Dates and timestamps are strings, yyyy-MM-dd."""
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return Kind.INT
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return Kind.DOUBLE
    if isinstance(data_type, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return Kind.STRING
    raise TypeMismatch(f"columns of type {data_type.simpleString()} have no place in the dialect")


def spark_type(kind: Kind) -> T.DataType:
    """What tables store. Int is 64 bits wide, as keys of large tables need."""
    return {Kind.INT: T.LongType(), Kind.DOUBLE: T.DoubleType(), Kind.STRING: T.StringType()}[kind]


def comparable(left: Kind, right: Kind, strict: bool) -> None:
    """Raise unless the two may be compared: equal types, or Int with Double unless ``strict``."""
    if left != right and (strict or Kind.STRING in (left, right)):
        raise TypeMismatch(f"{left.value} cannot be compared with {right.value}")
