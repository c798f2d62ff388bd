"""Joins of times with the intervals that hold them, by aligned (dyadic) intervals.

Time is cut into cells, and cells into aligned intervals of 1, 2, 4, ... of them. An interval is the union of at most
two aligned ones of each size, all apart (``cover``); a time lies in one of each size. So a time and an
interval that holds it (to the cell) share exactly one aligned interval: an equality, met once. An interval gives O(log) rows
however long it is, and a time O(log); intervals without an end are cut at the last time.

A pair of a join key and an aligned interval with many times or many intervals has all of their pairs as its result. It is
dealt into a grid of parts of at most about ``grid`` rows of each side, so that many tasks make it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import MOST_HOT, OWN

LEVEL, NODE, ROW, COLUMN, ROWS, COLUMNS, FIRST, LAST, LEVELS = (f"{OWN}{x}" for x in ("level", "node", "row", "column", "rows", "columns", "first", "last", "levels"))
GRID = 4096


def cell(at: Column, cell_us: int) -> Column:
    return F.floor(F.unix_micros(at.cast("timestamp")) / F.lit(cell_us)).cast("long")


def cover(first: Column, last: Column, levels: Column) -> Column:
    """array<struct<level, node>>: the cells first to last (0 or more) as aligned intervals; none if first is after last."""

    def at(k: Column) -> Column:
        size = F.expr("1L")
        width = F.call_function("shiftleft", size, k.cast("int"))
        low, high = F.floor((first + width - 1) / width).cast("long"), F.floor((last + 1) / width).cast("long")
        node = lambda where, x: F.when((low < high) & where, F.struct(k.cast("int").alias("level"), x.alias("node")))
        return F.array(node(low % 2 == 1, low), node(high % 2 == 1, high - 1))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), levels), at)))


def ancestors(at: Column, levels: Column) -> Column:
    """array<struct<level, node>>: the aligned intervals that hold a cell."""
    return F.transform(F.sequence(F.lit(0), levels), lambda k: F.struct(k.cast("int").alias("level"), F.call_function("shiftright", at, k.cast("int")).alias("node")))


def stab(times: DataFrame, intervals: DataFrame, on: list[str], at: str, start: str, end: str, cell_s: float = 3600, grid: int = GRID) -> DataFrame:
    """Pairs of a row of ``times`` and one of ``intervals`` with equal ``on`` and start <= at < end (null: no end). Columns but ``on`` have different names on both sides."""
    us = int(cell_s * 1_000_000)
    here = cell(F.col(at), us)
    bounds = times.agg(F.struct(F.min(here).alias("low"), F.max(here).alias("high")).alias("b")).scalar()  # run once, before the join
    levels = F.length(F.bin(bounds["high"] - bounds["low"]))
    points = times.withColumns({FIRST: here - bounds["low"], LEVELS: levels})
    points = points.withColumn(NODE, F.explode(ancestors(F.col(FIRST), F.col(LEVELS)))).drop(FIRST, LEVELS)
    first = F.greatest(cell(F.col(start), us), bounds["low"]) - bounds["low"]
    last = F.least(F.coalesce(cell(F.col(end), us), bounds["high"]), bounds["high"]) - bounds["low"]
    spans = intervals.where(F.col(end).isNull() | (F.col(start) < F.col(end))).withColumns({FIRST: first, LAST: last, LEVELS: levels})
    spans = spans.withColumn(NODE, F.explode(cover(F.col(FIRST), F.col(LAST), F.col(LEVELS)))).drop(FIRST, LAST, LEVELS)
    group = [*on, LEVEL, NODE]
    flat = lambda df: df.withColumn(LEVEL, F.col(f"{NODE}.level")).withColumn(NODE, F.col(f"{NODE}.node"))
    points, spans = flat(points), flat(spans)
    ones = lambda df, x, y: df.select(*group, F.lit(x).alias(ROWS), F.lit(y).alias(COLUMNS))
    counts = ones(points, 1, 0).unionByName(ones(spans, 0, 1)).groupBy(*group).agg(F.sum(ROWS).alias(ROWS), F.sum(COLUMNS).alias(COLUMNS))
    # groups with one side only have no result
    hot = counts.where((F.least(ROWS, COLUMNS) > 0) & (F.greatest(ROWS, COLUMNS) > grid)).orderBy((F.col(ROWS) * F.col(COLUMNS)).desc()).limit(MOST_HOT)
    hot = hot.select(*group, *[F.ceil(F.col(c) / grid).cast("int").alias(c) for c in (ROWS, COLUMNS)])

    def dealt(df: DataFrame, own: str, mine: str, other: str, others: str) -> DataFrame:
        """Each row in one of its own side's parts and all of the other's."""
        parts = lambda c: F.coalesce(F.col(c), F.lit(1))
        part = F.pmod(F.xxhash64(*df.columns), parts(mine)).cast("int")
        found = df.join(F.broadcast(hot), group, "left").withColumn(own, part)  # MOST_HOT rows
        return found.withColumn(other, F.explode(F.sequence(F.lit(0), parts(others) - 1))).drop(mine, others)

    met = dealt(points, ROW, ROWS, COLUMN, COLUMNS).join(dealt(spans, COLUMN, COLUMNS, ROW, ROWS), [*group, ROW, COLUMN])
    return met.where((F.col(start) <= F.col(at)) & (F.col(end).isNull() | (F.col(at) < F.col(end)))).drop(LEVEL, NODE, ROW, COLUMN)
