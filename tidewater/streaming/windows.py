"""Streaming queries of Spark's own windows and aggregates. Frames are unbounded and have ``ts``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import longest, pace
from ..operators.combine import Pace
from ..operators.windowing import WindowSpec
from .packed import packed_inner_join, packed_panes, packed_pieces_stream, packed_window_join
from .processors import top_k_stream

#: Parts that a window's words are dealt into before its most frequent are taken; no state row holds more than a part.
SALTS = 1024


def word_counts(words: DataFrame, window: str | None, delay: str = "0 seconds") -> DataFrame:
    """word, cnt: by window (append mode), or in total (complete or update mode)."""
    if window is None:
        return words.groupBy("word").agg(F.count("*").alias("cnt"))
    return words.withWatermark("ts", delay).groupBy(F.window("ts", window), "word").agg(F.count("*").alias("cnt"))


def top_k_by_window(words: DataFrame, k: int, window: str, delay: str = "0 seconds") -> DataFrame:
    """window, word, cnt of the k most frequent words: counts, then the k of each of SALTS parts of the words, then the k of those, in states of k rows."""
    return top_k_stream(word_counts(words, window, delay), k, SALTS)


def sliding_mean_length(words: DataFrame, size: str, slide: str, delay: str = "0 seconds") -> DataFrame:
    return words.withWatermark("ts", delay).groupBy(F.window("ts", size, slide)).agg(F.avg(F.length("word")).alias("mean_length"))


def longest_so_far(words: DataFrame) -> DataFrame:
    """Complete or update mode: a result for each micro-batch."""
    return words.agg(longest(F.col("word")).alias("longest"))


def mean_length_so_far(words: DataFrame) -> DataFrame:
    return words.agg(F.avg(F.length("word")).alias("mean_length"))


def alerts(metrics: DataFrame, short: str = "1 minute", long: str = "5 minutes", delay: str = "0 seconds") -> DataFrame:
    """key, window_end, is_up: short and long paces joined on the end of their windows."""
    timed = metrics.withWatermark("ts", delay)
    fast = timed.groupBy("key", F.window("ts", short).alias("w")).agg(pace().alias("short_pace"))
    slow = timed.groupBy("key", F.window("ts", long, short).alias("w")).agg(pace().alias("long_pace"))
    fast = fast.select("key", F.window_time("w").alias("at"), "short_pace")
    slow = slow.select(F.col("key").alias("key2"), F.window_time("w").alias("at2"), "long_pace")
    both = fast.join(slow, (F.col("key") == F.col("key2")) & (F.col("at") == F.col("at2"))).where("short_pace > 0 AND long_pace > 0")
    ratio = F.col("short_pace") / F.col("long_pace")
    return both.withColumn("ratio", ratio).where("ratio < 0.9 OR ratio > 1.1").select("key", "at", (F.col("ratio") > 1).alias("is_up"))


def processing_time_counts(df: DataFrame, sink: list, every: str = "1 second"):
    """A writer that appends the count of what came in each trigger to ``sink``."""
    return df.writeStream.trigger(processingTime=every).foreachBatch(lambda batch, _: sink.append(batch.count()))


def motivation(positions: Callable[[], DataFrame], short: str = "1 minute", long: str = "5 minutes", unit_ms: int = 60_000, stamp: str = "end", strategy: str = "inner_join") -> DataFrame:
    """Alerts of tracks in one plan: pieces by state, paces of short and of sliding long windows, and the join of the two streams on key and window's end.

    positions: makes a stream of key, lat, lon, ts_ms, ts with a watermark (anew for each side, as Spark tells watermarks in a plan
    apart by where they were set). Returns key, window_end, ratio, is_up, once the watermark has passed a window's end.
    Rows go packed from one operator to the next, by buckets of keys (see ``packed``).
    strategy: inner_join, Spark's join of streams; cogroup, full outer with 0 for a missing pace; side_input, left with a look-up
    in the long paces, where a key that stands twice at an end is an error, and a short pace of 0 is an alert.
    """

    def paces(spec: WindowSpec) -> DataFrame:
        return packed_panes(packed_pieces_stream(positions(), unit_ms, stamp), spec, Pace(), ["length", "duration"])

    fast, slow = paces(WindowSpec(short)), paces(WindowSpec(long, short))
    if strategy == "inner_join":
        both = packed_inner_join(fast, slow)
    elif strategy in ("cogroup", "side_input"):
        side = strategy == "side_input"
        both = packed_window_join(fast, slow, full=not side, once=side, left_default=0.0, right_default=0.0)
    else:
        raise ValueError("strategy is inner_join, cogroup or side_input")
    both = both.where("right_value > 0" if strategy == "side_input" else "left_value > 0 AND right_value > 0")
    ratio = F.col("left_value") / F.col("right_value")
    return both.select("key", "window_end", ratio.alias("ratio"), (ratio > 1).alias("is_up")).where("ratio < 0.9 OR ratio > 1.1")
