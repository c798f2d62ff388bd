"""Mixing sources to target weights, in DataFrame expressions only.

Sizes (words) are summed per source. Targets share the whole by weight, no source
above ``most`` times its own size; the excess goes to the others by weight. That is
a water level: in order of cap/weight, sources are capped as long as their cap is
below what the rest would share. The level comes from running sums over the table
of sources (one row each). A document is then taken floor(rate) times, and once more
if a number in [0, 1) hashed from its id and the seed is below the fraction, where
rate = target / size of the source.

Cases: a null text has size 0; a null source is a source of its own, last in order;
a source without words has target and rate 0; rows that repeat an id draw alike; a null id
draws as the word "null"; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, free_name, stored

#: Weights of the sources in code point order, repeating (fixed values of the contract).
WEIGHTS = (5, 2, 1)
MOST = 3


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """52 bits of an md5 as a number in [0, 1): the same in every run and engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes: source, size. Returns source, source_size, target."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(cycle, (place % len(weights) + 1).cast("int"))).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = (
        per.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("share", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("here", F.col("rest").cast("double") / F.col("share"))
        # the level is that of the first source which isn't capped; a capped one has cap <= weight * level
        .withColumn("open", F.when(F.col("cap") > F.col("weight") * F.col("here"), F.struct(F.row_number().over(order).alias("n"), F.col("here").alias("level"))))
        .withColumn("level", F.min("open").over(everything)["level"])
    )
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.col("cap").cast("double")))
    return per.select("source", "source_size", target.alias("target"))


def copies(doc_id: Column, rate: Column, seed: int) -> Column:
    return (F.floor(rate) + F.when(draw(doc_id, seed) < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def _rate() -> Column:
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))


def mix_report(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    sizes = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    targets = source_targets(sizes, weights, most).withColumnRenamed("source", "_source")
    both = sizes.join(targets, F.col("source").eqNullSafe(F.col("_source")))
    return both.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("doc_id"), _rate(), seed)).alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = 17) -> DataFrame:
    """The mixed documents: every row as often as it is taken, with the columns of ``docs``."""
    sizes = docs.select("source", n_words(F.col("text")).alias("size"))
    rates = source_targets(sizes, weights, most).select(F.col("source").alias("_source"), _rate().alias("_rate"))
    rates = stored(rates, "rates")  # one row per source
    n = copies(docs["doc_id"], F.col("_rate"), seed)
    copy = free_name(docs, "_copy")
    both = docs.join(rates, docs["source"].eqNullSafe(rates["_source"]))
    return both.select(*[docs[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(0), n.cast("int"))).alias(copy)).drop(copy)
