"""Counts, longest, mean and top-k, in total, by window, and as running results.

Ties are decided everywhere alike: the greater measure, then the greater word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import HOT_ROWS, OWN, running

CHARS, WORDS = f"{OWN}chars", f"{OWN}words"


def count_per_element(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("cnt"))


def count_globally(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("cnt"))


def count_if_any(df: DataFrame) -> DataFrame:
    """The count, or no row for no rows: a global combine without its default."""
    return df.agg(F.count("*").alias("cnt")).where("cnt > 0")


def sum_globally(df: DataFrame, column: str) -> DataFrame:
    """0 for no rows."""
    return df.agg(F.coalesce(F.sum(column), F.lit(0)).alias("total"))


def longest(word: Column) -> Column:
    """Aggregate: the longest word."""
    return F.max(F.struct(F.length(word).alias("n"), word.alias("word")))["word"]


def mean_length(word: Column, default: bool = False) -> Column:
    """Aggregate: mean length; with ``default``, NaN for no rows instead of null."""
    mean = F.avg(F.length(word))
    return F.coalesce(mean, F.lit(float("nan"))) if default else mean


def top_k(counts: DataFrame, k: int, by: str = "cnt", item: str = "word", per: tuple[str, ...] = ()) -> DataFrame:
    """The k rows of greatest ``by`` (of each group ``per``). Without groups, a bounded heap per task; with, a limit before the exchange."""
    order = [F.col(by).desc(), F.col(item).desc()]
    if not per:
        return counts.orderBy(*order).limit(k)
    place = f"{OWN}place"
    return counts.withColumn(place, F.row_number().over(Window.partitionBy(*per).orderBy(*order))).where(F.col(place) <= k).drop(place)


def running_longest(df: DataFrame, word: str, order: list[Column], per: tuple[str, ...] = (), hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """A result for each element: the longest word so far, the greatest of them on ties."""
    w = F.col(word)
    rows = running(df, per, order, hot_rows=hot_rows, longest=("max", F.struct(F.length(w).alias("n"), w.alias("word"))))
    return rows.withColumn("longest", F.col("longest.word"))


def running_mean_length(df: DataFrame, word: str, order: list[Column], per: tuple[str, ...] = (), hot_rows: int | None = HOT_ROWS) -> DataFrame:
    n = F.length(word)
    rows = running(df, per, order, hot_rows=hot_rows, **{CHARS: ("sum", n.cast("long")), WORDS: ("sum", n.isNotNull().cast("long"))})
    return rows.withColumn("mean_length", F.try_divide(CHARS, WORDS)).drop(CHARS, WORDS)


def pace(length: str = "length", duration: str = "duration") -> Column:
    """Aggregate: metres a second from metres and milliseconds; null without duration."""
    return F.try_divide(F.sum(length) * 1000, F.sum(duration))


def mean_pace_seconds(distance: str, seconds: str) -> Column:
    """Aggregate: NaN without time."""
    return F.when(F.sum(seconds) == 0, F.lit(float("nan"))).otherwise(F.try_divide(F.sum(distance), F.sum(seconds)))
