"""Bounded and unbounded sources, and decoding of records."""

from __future__ import annotations

import time as clock
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.geo import try_parse_position


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line. Large files are split by bytes; a line belongs to the split in which it starts."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def watch_lines(spark: SparkSession, path: str, files_per_batch: int | None = None, time: Column | None = None, delay: str | None = None) -> DataFrame:
    """Stream of line, file, ts: each new file of a directory once.

    time: the time of a file, from the columns file and ts (its modification time, the default); the watermark is
    the greatest of these less ``delay``. A query over it ends when what is there has been read if it is started
    by ``trigger(availableNow=True)``, else when it is stopped (see ``stop_after``).
    """
    reader = spark.readStream.schema("value string")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    found = reader.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("ts"))
    return _timed(found if time is None else found.withColumn("ts", time), delay)


def stop_after(query: StreamingQuery, end: datetime, poll_s: float = 0.5, most_s: float = 3600.0) -> bool:
    """Stops a query once its watermark has reached ``end``; False if that took more than ``most_s`` seconds."""
    until = clock.monotonic() + most_s
    while clock.monotonic() < until and query.isActive:
        mark = ((query.lastProgress or {}).get("eventTime") or {}).get("watermark")
        if mark and datetime.fromisoformat(mark.replace("Z", "+00:00")) >= end:
            query.stop()
            return True
        clock.sleep(poll_s)
    query.stop()
    return False


def kafka(spark: SparkSession, bootstrap: str, topic: str, stream: bool = True, **options: str) -> DataFrame:
    """key, value (strings), ts (record time). Needs Spark's Kafka connector on the class path."""
    reader = (spark.readStream if stream else spark.read).format("kafka").options(**kafka_options(bootstrap, topic, **options))
    return decode_strings(reader.load())


def kafka_options(bootstrap: str, topic: str, **options: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": bootstrap, "subscribe": topic} | options


def decode_strings(records: DataFrame) -> DataFrame:
    return records.select(F.col("key").cast("string"), F.col("value").cast("string"), F.col("timestamp").alias("ts"))


def positions_from_values(records: DataFrame, delay: str | None = "100 milliseconds") -> DataFrame:
    """key, lat, lon, ts from values "key TAB lat TAB lon TAB ms"; others are dropped before they could move the watermark."""
    parts = F.split("value", "\t", 2)
    rows = records.where(F.size(parts) == 2).select(parts[0].alias("key"), try_parse_position(parts[1]).alias("p")).where("p IS NOT NULL")
    return _timed(rows.select("key", "p.lat", "p.lon", F.timestamp_millis("p.ts").alias("ts")), delay)


def positions_from_keys(records: DataFrame, delay: str | None = "100 milliseconds") -> DataFrame:
    """key, lat, lon, ts from keyed values "lat lon" and the record's time."""
    parts = F.split("value", " ")
    lat, lon = F.try_element_at(parts, F.lit(1)).try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double")
    rows = records.select("key", lat.alias("lat"), lon.alias("lon"), "ts").where("key IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    return _timed(rows, delay)


def timed_lines(records: DataFrame, delay: str | None = "1 second") -> DataFrame:
    """value, ts, where the key is an ISO-8601 instant; rows without one are dropped."""
    return _timed(records.select("value", F.try_to_timestamp("key").alias("ts")).where("ts IS NOT NULL"), delay)


def _timed(df: DataFrame, delay: str | None) -> DataFrame:
    return df.withWatermark("ts", delay) if delay else df


def track_points(spark: SparkSession, users: int, minutes: int, start_ms: int = 0, seed: int = 7) -> DataFrame:
    """Seeded random tracks: key, lat, lon, ts (ms), a point each minute."""
    from pyspark.sql import Window

    steps = spark.range(users * minutes).select((F.col("id") / minutes).cast("long").alias("u"), (F.col("id") % minutes).alias("m"), (F.rand(seed) - 0.5).alias("dx"), (F.rand(seed + 1) - 0.5).alias("dy"))
    so_far = Window.partitionBy("u").orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    at = lambda c: F.sum(c).over(so_far) * 0.001
    return steps.select(F.concat(F.lit("user"), F.col("u")).alias("key"), at("dx").alias("lat"), at("dy").alias("lon"), (F.col("m") * 60_000 + start_ms).alias("ts"))


def tsv_position(key: Column, lat: Column, lon: Column, ms: Column) -> Column:
    return F.concat_ws("\t", key.cast("string"), lat.cast("string"), lon.cast("string"), ms.cast("string"))
