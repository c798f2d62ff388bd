"""Record types, and schemas inferred from dataclasses."""

from __future__ import annotations

import dataclasses
import datetime
import typing

from pyspark.sql import DataFrame
from pyspark.sql import types as T

POSITION = T.StructType().add("lat", "double").add("lon", "double").add("ts", "long")
METRIC = T.StructType().add("length", "double").add("duration", "long")
JOIN_RESULT = T.StructType().add("is_retract", "boolean").add("join_key", "string").add("left_pk", "string").add("right_pk", "string").add("left_value", "string").add("right_value", "string").add("ts", "timestamp")

_KINDS = {str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), bytes: T.BinaryType(), datetime.datetime: T.TimestampType()}


def _kind(hint) -> T.DataType:
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if origin in (list, set, tuple):
        return T.ArrayType(_kind(args[0]))
    if origin is dict:
        return T.MapType(_kind(args[0]), _kind(args[1]))
    if dataclasses.is_dataclass(hint):
        return schema_of(hint)
    some = [a for a in args if a is not type(None)]
    return _kind(some[0]) if len(some) == 1 and origin is not None else _KINDS[hint]


def schema_of(cls: type) -> T.StructType:
    """A dataclass's schema. Field metadata: {"name": column} renames, {"ignore": True} leaves out."""
    hints = typing.get_type_hints(cls)
    out = T.StructType()
    for f in dataclasses.fields(cls):
        if not f.metadata.get("ignore"):
            optional = type(None) in typing.get_args(hints[f.name])
            out.add(f.metadata.get("name", f.name), _kind(hints[f.name]), optional)
    return out


def rows_of(objects: list) -> list[dict]:
    """Rows of dataclass objects under schema_of."""
    fields = [f for f in dataclasses.fields(objects[0]) if not f.metadata.get("ignore")] if objects else []
    return [{f.metadata.get("name", f.name): getattr(o, f.name) for f in fields} for o in objects]


def with_string_schema(df: DataFrame, field: str) -> DataFrame:
    """A one-column frame under a name of its own."""
    return df.toDF(field)
