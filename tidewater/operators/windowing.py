"""Event-time windows as columns, and the choices that go with them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class WindowSpec:
    """Global without a size, sliding with a slide, else fixed. Durations are Spark interval strings.

    lateness, accumulate, stamp and on_empty decide the panes of streams (``streaming.panes``); stamp also what ``stamped`` gives.
    """

    size: str | None = None
    slide: str | None = None
    lateness: str | None = None
    accumulate: bool = False
    stamp: str = "end"  # end of the window, or latest element
    on_empty: bool = True  # a last pane at the window's end though nothing new came, or none

    def column(self, ts: Column) -> Column:
        if self.size is None:
            return F.lit(None).cast("struct<start:timestamp,end:timestamp>")
        return F.window(ts, self.size, self.slide) if self.slide else F.window(ts, self.size)

    def assign(self, df: DataFrame, ts: str = "ts") -> DataFrame:
        """Adds ``window``; rows in several windows are repeated."""
        return df.withColumn("window", self.column(F.col(ts)))

    def stamped(self, latest: Column) -> Column:
        """The time of a window's result: its last millisecond, or its latest element's time."""
        return F.coalesce(F.col("window.end") - F.expr("INTERVAL 1 MILLISECOND"), latest) if self.stamp == "end" else latest

    def again(self, **changes) -> WindowSpec:
        """The same windows with other choices."""
        return replace(self, **changes)


UNITS = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def millis(interval: str | None) -> int:
    """"5 minutes" in milliseconds; None is 0."""
    if interval is None:
        return 0
    n, unit = interval.split()
    return int(n) * UNITS[unit.lower().rstrip("s")]


def windows_of(ts_ms: Column, size_ms: int, slide_ms: int | None = None) -> Column:
    """array<struct<start_ms, end_ms>> of the windows that hold a time, last first."""
    slide = slide_ms or size_ms
    last = ts_ms - F.pmod(ts_ms, F.lit(slide))
    n = -(-size_ms // slide)
    return F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((last - i * slide).alias("start_ms"), (last - i * slide + size_ms).alias("end_ms"))),
        lambda w: w["end_ms"] > ts_ms,
    )
