"""SQL over tagged frames, with time windows and user functions."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def windows_sql(text: str) -> str:
    """TUMBLE(ts, INTERVAL ...) and HOP(ts, slide, size) as Spark's window(ts, size, slide): note the order."""
    interval = r"INTERVAL\s+'(\d+)'\s+(\w+)"
    text = re.sub(rf"(?i)\bTUMBLE\(\s*([\w.`]+)\s*,\s*{interval}\s*\)", r"window(\1, '\2 \3')", text)
    return re.sub(rf"(?i)\bHOP\(\s*([\w.`]+)\s*,\s*{interval}\s*,\s*{interval}\s*\)", r"window(\1, '\4 \5', '\2 \3')", text)


def run_sql(spark: SparkSession, text: str, udfs: dict[str, Callable] | None = None, **tables: DataFrame) -> DataFrame:
    """Runs a query in which ``{tag}`` stands for a frame or a function (other braces are doubled).

    Only these places are replaced. Views and functions get names of their own, which are gone once the
    query is resolved, so queries don't meet in the catalogue and overwrite nothing.
    """
    own = {tag: f"{tag}_{uuid.uuid4().hex[:12]}" for tag in [*tables, *(udfs or {})]}
    for name, f in (udfs or {}).items():
        spark.udf.register(own[name], f)
    for tag, df in tables.items():
        df.createOrReplaceTempView(own[tag])
    try:
        return spark.sql(windows_sql(text.format(**own)))
    finally:
        for tag in tables:
            spark.catalog.dropTempView(own[tag])
        for name in udfs or {}:
            spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {own[name]}")


#: Bytes of text, about, whose words are Python objects at a time: a batch has so many rows, whatever their length.
SLICE_BYTES = 1 << 20


def tokenize_udf(slice_bytes: int = SLICE_BYTES):
    """A vectorised scalar function: text -> array of words."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("array<string>")
    def tokenize(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lines in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(lines), 0).to_numpy(zero_copy_only=False).astype("int64"))
            cuts = [0, *(np.flatnonzero(np.diff(ends // slice_bytes)) + 1).tolist(), len(lines)]
            for i, j in pairwise(cuts):
                texts = lines.slice(i, j - i).to_pylist()
                yield pa.array([[w for w in re.split(r"[^A-Za-z0-9_]+", x or "") if w] for x in texts], pa.list_(pa.string()))

    return tokenize


def longest_word_udaf():
    """A grouped aggregate function: the longest word."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def longest(words: pd.Series) -> str:
        return max((w for w in words if w is not None), key=lambda w: (len(w), w), default=None)

    return longest
