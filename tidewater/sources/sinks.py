"""Sinks: Kafka records, the console, and a tee for debugging."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.geo import try_parse_position
from ..session import STATE_STORE

#: What keeps a stream's disk to the size of its last batches.
SPARING = {"spark.sql.streaming.minBatchesToRetain": "2", "spark.sql.streaming.stateStore.maintenanceInterval": "10s", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Stores in memory keep one version there, and as they are read anew for every arrival, they are written whole after a few batches' changes.
SPARING_MEMORY = {"spark.sql.streaming.maxBatchesToRetainInMemory": "1", "spark.sql.streaming.stateStore.minDeltasForSnapshot": "2"}
#: Whether a batch follows that has no rows but a new watermark.
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
#: Rows of a step of a table that is streamed, and steps at most.
STEP_ROWS, MOST_STEPS = 2_000_000, 100


def records(df: DataFrame, value: Column, key: Column | None = None) -> DataFrame:
    """key, value as strings; the key is empty unless given."""
    return df.select((F.lit("") if key is None else key.cast("string")).alias("key"), value.cast("string").alias("value"))


def big_endian(x: Column) -> Column:
    """A long as the eight bytes that long serialisers write."""
    return F.unhex(F.lpad(F.hex(x.cast("long")), 16, "0"))


def position_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lines: line, "key TAB lat TAB lon TAB ms". Records (key, value "lat lon", timestamp: the position's time) and the lines without a tab.

    Lines with a tab whose rest is no position are in neither.
    """
    parts = F.split("line", "\t", 2)
    good = lines.where(F.size(parts) == 2).select(parts[0].alias("key"), try_parse_position(parts[1]).alias("p")).where("p IS NOT NULL")
    records_ = good.select("key", F.concat(F.col("p.lat").cast("string"), F.lit(" "), F.col("p.lon").cast("string")).alias("value"), F.timestamp_millis("p.ts").alias("timestamp"))
    return records_, lines.where((F.size(parts) < 2) & F.col("line").isNotNull())


def write_positions(lines: DataFrame, bootstrap: str, topic: str) -> DataFrame:
    """Writes the records of a table of lines to Kafka and returns the lines without a tab."""
    good, bad = position_records(lines)
    write_kafka(good, bootstrap, topic)
    return bad


def texts_to_records(spark: SparkSession, *values: str) -> DataFrame:
    """Records of given values, for tests of a topic."""
    return records(spark.createDataFrame([(v,) for v in values], "value string"), F.col("value"))


def kafka_options(bootstrap: str, topic: str, checkpoint: str | None = None) -> dict[str, str]:
    return {"kafka.bootstrap.servers": bootstrap, "topic": topic} | ({"checkpointLocation": checkpoint} if checkpoint else {})


def write_kafka(df: DataFrame, bootstrap: str, topic: str, checkpoint: str | None = None) -> DataStreamWriter | None:
    """Streams give a writer to start; tables are written at once. Needs Spark's Kafka connector."""
    options = kafka_options(bootstrap, topic, checkpoint if df.isStreaming else None)
    if df.isStreaming:
        return df.writeStream.format("kafka").options(**options)
    df.write.format("kafka").options(**options).save()
    return None


def write_console(df: DataFrame) -> DataStreamWriter:
    return df.writeStream.format("console").option("truncate", False)


def tee(df: DataFrame, name: str, **measures: Column) -> DataFrame:
    """Passes rows on and reports measures (by default their number) to query listeners and Observation."""
    given = [c.alias(k) for k, c in measures.items()] or [F.count("*").alias("rows")]
    return df.observe(name, *given)


def finished(df: DataFrame, name: str, arrivals: Iterable[Callable[[], None]] = (), store: str = STATE_STORE) -> DataFrame:
    """Runs a stream over what is there now, in append mode, and gives its rows as a table in the shared folder.

    It runs with the state store that stateful operators need, and with two partitions for each core that there is (or fewer, if the session
    has fewer): each costs stores and a worker for every operator and batch. The session's own settings are as before afterwards.
    arrivals: calls that each bring more of the input, whereupon the query goes on from its checkpoint (see ``in_steps``); what the watermark of one
    lets go is given with the next one's rows, or after the last one's. What batches before the last one left on disk, shuffles and versions of the
    state, is cleared on the way. store: the state store, where the plan has Spark's own stateful operators only.
    """
    spark = df.sparkSession
    cores, count = spark.sparkContext.defaultParallelism, "spark.sql.shuffle.partitions"
    own = {"spark.sql.streaming.stateStore.providerClass": store, count: str(min(2 * cores, int(spark.conf.get(count)))), **SPARING, **SPARING_MEMORY}
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").trigger(availableNow=True)
    before, calls = {k: spark.conf.get(k) for k in (*own, NO_DATA)}, list(arrivals) or [lambda: None]
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        for arrive in calls:
            arrive()
            spark.conf.set(NO_DATA, before[NO_DATA] if arrive is calls[-1] else "false")
            writer.start(path).awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    delete(spark, f"{path}-state")
    return spark.read.schema(df.schema).parquet(path)


def in_steps(df: DataFrame, time: str, name: str, step_rows: int = STEP_ROWS) -> tuple[DataFrame, list[Callable[[], None]], str]:
    """A stream of the rows of a table that arrive in order of ``time``, the calls that each bring its next step, and the folder to delete at the end.

    A step has about ``step_rows`` rows, or the MOST_STEPS-th part of all, and none that is before the step before; so state and batches
    have the size of a step, not of the table. Rows of a task of ``df`` stay together in each step.
    """
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/all")
    whole = spark.read.schema(df.schema).parquet(f"{path}/all")
    steps, at, step = min(max(whole.count() // step_rows, 1), MOST_STEPS), F.unix_micros(time), "_step"
    cuts = [i / steps for i in range(1, steps)]
    bounds = sorted(set(whole.select(at.cast("double").alias("at")).approxQuantile("at", cuts, 0.1 / steps))) if cuts else []

    def place(low: int, high: int) -> Column:
        """The number of bounds that are not after a row, of which low to high are possible."""
        middle = (low + high) // 2
        return F.lit(low) if low == high else F.when(at < int(bounds[middle]), place(low, middle)).otherwise(place(middle + 1, high))

    tasks = 2 * spark.sparkContext.defaultParallelism
    whole.withColumn(step, place(0, len(bounds))).coalesce(tasks).write.partitionBy(step).parquet(f"{path}/steps")
    delete(spark, f"{path}/all")
    files = _files(spark, path)
    files.mkdirs(_path(spark, f"{path}/arrived/none"))  # a stream needs a folder to watch

    def bring(i: int) -> None:
        came = _path(spark, f"{path}/steps/{step}={i}")
        if files.exists(came) and not files.rename(came, _path(spark, f"{path}/arrived/{i}")):
            raise OSError(f"step {i} of {path} can't be moved")

    return spark.readStream.schema(df.schema).parquet(f"{path}/arrived/*"), [lambda i=i: bring(i) for i in range(len(bounds) + 1)], path


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where spark.checkpoint.dir is unset, a temporary one if they are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or "file://" + tempfile.mkdtemp(prefix="tidewater-")).rstrip("/")


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    _files(spark, path).delete(_path(spark, path), True)
