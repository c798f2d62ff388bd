"""Telling rows that come in time from rows that come too late.

A row is too late (droppable) when its window's last millisecond plus the allowed lateness lies
before the watermark at its arrival. In batch the watermark is replayed from the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import HOT_ROWS, OWN, running

SEEN = f"{OWN}seen"


def is_droppable(ts_ms: Column, watermark_ms: Column, size_ms: int, lateness_ms: int) -> Column:
    last = ts_ms - F.pmod(ts_ms, F.lit(size_ms)) + size_ms - 1
    return F.coalesce(last + lateness_ms < watermark_ms, F.lit(False))


def replay_split(rows: DataFrame, arrival: Column, size_ms: int, lateness_ms: int, delay_ms: int = 0, per: tuple[str, ...] = (), ts: str = "ts_ms", hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Adds ``droppable``; the watermark is the greatest time that arrived before, less the delay, for each ``per`` (a source partition; there are few, so they are dealt into blocks of ``arrival``, a number or a time)."""
    seen = running(rows, per, [arrival], inclusive=False, hot_rows=hot_rows, **{SEEN: ("max", F.col(ts))})
    return seen.withColumn("droppable", is_droppable(F.col(ts), F.col(SEEN) - delay_ms, size_ms, lateness_ms)).drop(SEEN)


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(main, droppable)."""
    return rows.where(~F.col("droppable")).drop("droppable"), rows.where("droppable").drop("droppable")
