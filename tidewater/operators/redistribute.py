"""Dealing rows out evenly, and alike again when a task is run again.

A round-robin exchange depends on the order in which rows come, so a task that is repeated after a lost executor may send rows elsewhere
than before, where some are then missing and others double. Dealing by a hash of the content is the same every
time, but sends all copies of a row to one task. Here copies are numbered in their task, and a row goes where the hash of its content
and its number say: copies spread, and a repeated task, in whatever order it reads, sends the same rows to the same places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .ordered import OWN

CONTENT, TURN = f"{OWN}content", f"{OWN}turn"
#: An odd number, so that the turns of a content take every place.
STEP = 0x9E3779B1


def numbered(df: DataFrame) -> DataFrame:
    """Adds CONTENT, a hash of the row, and TURN, 0, 1, ... among the rows of a task with that hash."""
    hashed = df.withColumn(CONTENT, F.xxhash64(*[_hashable(df, c) for c in df.columns]) if df.columns else F.lit(0).cast("long"))
    kind = StructType([*hashed.schema.fields, StructField(TURN, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far: dict[int, int] = {}
        for b in batches:
            content = b.column(b.num_columns - 1).to_numpy()
            found, of, count = np.unique(content, return_inverse=True, return_counts=True)
            order = np.argsort(of, kind="stable")
            turn = np.empty(len(content), np.int64)
            turn[order] = np.arange(len(content)) - np.repeat(np.cumsum(count) - count, count)
            before = np.array([so_far.get(x, 0) for x in found.tolist()], np.int64)
            so_far.update(zip(found.tolist(), (before + count).tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(turn + before[of])], [*b.schema.names, TURN])

    return hashed.mapInArrow(run, kind)


def _hashable(df: DataFrame, column: str):
    """Maps have no hash: their entries do."""
    kind = df.schema[column].dataType
    return F.array_sort(F.map_entries(F.col(column))) if kind.typeName() == "map" else F.col(column)


def redistribute(df: DataFrame, parts: int) -> DataFrame:
    """df in ``parts`` partitions of like size."""
    place = F.pmod(F.pmod(F.col(CONTENT), F.lit(parts)) + F.pmod(F.col(TURN), F.lit(parts)) * F.lit(STEP % parts), F.lit(parts)).cast("int")
    return numbered(df).repartitionById(parts, place).drop(CONTENT, TURN)
