"""What the operators share: the shared folder, durable intermediate tables and constants."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

#: A word is a run of anything but ASCII white space (fixed value of the contract).
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one if driver and executors are one process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidewater-")
        spark.conf.set("spark.checkpoint.dir", found)
        _drop_at_exit(spark, found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/tidewater/{name}-{uuid.uuid4().hex}"
    _drop_at_exit(spark, path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: lineage ends here and no executor's loss hurts."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one computation, deleted together once its result is stored."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            delete(self.spark, path)
        self.paths = []


#: A key of more rows is dealt into parts of about so many; the table of such keys has at most MOST_HOT rows, so it may be
#: broadcast, and any other key has at most HOT_ROWS rows or the MOST_HOT-th part of all.
HOT_ROWS, MOST_HOT = 512, 10_000


def hot_keys(df: DataFrame, on: list[str], counts: DataFrame | None = None) -> DataFrame | None:
    """on, _parts of the MOST_HOT keys of most rows above HOT_ROWS, as a small local table; None without any. counts: on, rows of the keys, if known."""
    if counts is None:
        counts = df.groupBy(*on).agg(F.count("*").alias("rows"))
    hot = counts.where(F.col("rows") > HOT_ROWS).orderBy(F.col("rows").desc()).limit(MOST_HOT).select(*on, F.ceil(F.col("rows") / HOT_ROWS).cast("int").alias("_parts"))
    found = hot.toArrow()  # MOST_HOT keys at most; of rows Spark would make a table in workers of their own, which stay
    return df.sparkSession.createDataFrame(found, hot.schema) if found.num_rows else None


def join_salted(left: DataFrame, right: DataFrame, on: list[str], hot: DataFrame | None) -> DataFrame:
    """The inner join of ``left``, in which few keys may hold most rows, with ``right``, where a key has few rows.

    Rows of a hot key (see ``hot_keys``) of ``left`` are dealt into parts by their hash, and its rows of ``right`` repeated for each part. Keys aren't null.
    """
    if hot is None:
        return left.join(right, on)
    hot = F.broadcast(hot)  # MOST_HOT rows
    part = F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("_parts")).cast("int"), F.lit(0))
    dealt = left.join(hot, on, "left").withColumn("_part", part).drop("_parts")
    repeated = right.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_parts")
    return dealt.join(repeated, [*on, "_part"]).drop("_part")


def row_mark(doc_id: Column, kind: DataType, digest: Column) -> Column:
    """What tells documents apart: id (null last) and the digest of the text, in this order. Ids are numbers, strings or times (``kind``)."""
    return F.struct(doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0).cast(kind)).alias("id"), digest.alias("digest"))


def leave_one(docs: DataFrame, mark: Column, gone: DataFrame, marks: DataFrame) -> DataFrame:
    """docs without the rows whose mark is in ``gone`` and with one row, of least hash, of those that share a mark.

    marks: the mark of every row, at least of those that share it. The marks of most rows are broadcast, so none fills a task.
    """
    rows = docs.select(mark.alias("mark"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    gone = gone.select("mark").distinct().hint("merge")  # grows with docs: one plan at every size
    several = stored(marks.groupBy("mark").agg(F.count("*").alias("rows")).where("rows > 1"), "repeats")
    if several.isEmpty():
        return rows.join(gone, "mark", "left_anti").select("row.*")
    hot = F.broadcast(stored(several.where(F.col("rows") > HOT_ROWS).orderBy(F.col("rows").desc()).limit(MOST_HOT).select("mark"), "hot"))
    rest, several = rows.join(hot, "mark", "left_anti"), several.select("mark")
    again = rows.join(hot, "mark", "left_semi").unionByName(rest.join(several, "mark", "left_semi"))
    once = again.groupBy("mark").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return rest.join(several, "mark", "left_anti").unionByName(once).join(gone, "mark", "left_anti").select("row.*")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def strongest(i: np.ndarray, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` sparse features (numbers i, rising, values x) of greatest value, ties to the smaller number; all, if there are no more."""
    if len(i) <= most:
        return i, x
    at = np.sort(np.lexsort((i, -x))[:most])
    return i[at], x[at]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts, so that only so many rows are Python objects at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    def drop() -> None:
        if spark.sparkContext._jsc is not None:
            delete(spark, path)

    atexit.register(_quietly, drop)


def _quietly(f) -> None:
    try:
        f()
    except Exception:  # the JVM may be gone at exit
        pass
