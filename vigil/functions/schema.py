"""Schemas from text, without a session (workers import modules too)."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}
_TYPES |= {f"array<{kind}>": T.ArrayType(_TYPES[kind]) for kind in ("string", "double")}


def struct(text: str) -> T.StructType:
    """``name type, name type`` as a struct of plain columns."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (x.split() for x in text.split(","))])
