"""A scripted stream: rows in given micro-batches, so tests can say what arrives when.

Watermarks are moved as any stream's are, by event times: a row under the key WATERMARK in a batch of its
own. Such rows are to be dropped where results are read: the planner moves a filter below the watermark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

WATERMARK = "__watermark__"


class ScriptedReader(SimpleDataSourceStreamReader):
    def __init__(self, batches: list[list[list]]) -> None:
        self.batches = batches

    def initialOffset(self) -> dict:
        return {"batch": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        at = start["batch"]
        return iter([tuple(r) for r in self.batches[at]] if at < len(self.batches) else []), {"batch": min(at + 1, len(self.batches))}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([tuple(r) for b in self.batches[start["batch"] : end["batch"]] for r in b])

    def commit(self, end: dict) -> None:
        pass


class ScriptedSource(DataSource):
    """Options: schema (DDL), batches (JSON list of lists of rows)."""

    @classmethod
    def name(cls) -> str:
        return "scripted"

    def schema(self) -> str:
        return self.options["ddl"]

    def simpleStreamReader(self, schema) -> ScriptedReader:
        return ScriptedReader(json.loads(self.options["batches"]))


def scripted(spark: SparkSession, ddl: str, batches: list[list[tuple]]) -> DataFrame:
    """Times are given in milliseconds as ``ts_ms``; ``ts`` is added."""
    spark.dataSource.register(ScriptedSource)
    df = spark.readStream.format("scripted").option("ddl", ddl).option("batches", json.dumps(batches)).load()
    return df.withColumn("ts", F.timestamp_millis("ts_ms")) if "ts_ms" in df.columns else df
