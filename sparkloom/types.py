"""Type names and the widening of unsigned types."""

from __future__ import annotations

from pyspark.sql import types as T

#: Columnar type names and their Spark types; unsigned ones widen as Spark's Parquet reader does. Fixed values.
NAMES: dict[str, T.DataType] = {
    "null": T.NullType(),
    "bool": T.BooleanType(),
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "uint8": T.ShortType(),
    "uint16": T.IntegerType(),
    "uint32": T.LongType(),
    "uint64": T.DecimalType(20, 0),
    "float16": T.FloatType(),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "string": T.StringType(),
    "utf8": T.StringType(),
    "large_string": T.StringType(),
    "large_utf8": T.StringType(),
    "binary": T.BinaryType(),
    "large_binary": T.BinaryType(),
}


def from_name(name: str) -> T.DataType:
    """The Spark type of a columnar type name or of DDL; ValueError if it is neither."""
    if name in NAMES:
        return NAMES[name]
    try:
        return T.DataType.fromDDL(name)
    except Exception as e:
        raise ValueError(f"unknown type {name!r}") from e


def without(schema: T.StructType, *names: str) -> T.StructType:
    """schema without the named fields."""
    return T.StructType([f for f in schema if f.name not in names])
