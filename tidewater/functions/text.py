"""Splitting lines into words, and records into lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(line: Column) -> Column:
    """Non-empty runs of letters, digits and underscore (ASCII)."""
    return F.filter(F.split(line, r"\W+"), lambda w: w != "")


def words_with_apostrophes(line: Column) -> Column:
    """Runs of ASCII letters and apostrophes."""
    return F.regexp_extract_all(line, F.lit("([A-Za-z']+)"), F.lit(1))


def explode_words(df: DataFrame, column: str = "text", split=words) -> DataFrame:
    """A row for each word, with the other columns."""
    return df.withColumn("word", F.explode(split(F.col(column)))).drop(column)


def key_value_line(key: Column, value: Column) -> Column:
    """"key value"; nulls are empty."""
    return F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(" "), F.coalesce(value.cast("string"), F.lit("")))


def value_line(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def is_blank(text: Column) -> Column:
    """Null, or nothing but white space."""
    return F.coalesce(F.length(F.regexp_replace(text, r"\s+", "")) == 0, F.lit(True))
