"""Inner join of two changelogs, with retractions.

A changelog is rows (pk, join_key, value, ts, is_delete): each replaces the row of its pk. A version
holds from its ts to the next of its pk. Versions of both sides that share the join key and
overlap in time give + at the later start, and - at the earlier end if there is one. That covers
changes of the join key, of a value, and deletes alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .interval_join import stab
from .ordered import HOT_ROWS, OWN, deal, neighbour

END, OLD = f"{OWN}end", f"{OWN}old"


def _order(changes: DataFrame) -> list[str]:
    """Changes of one time count in the order of their other columns, so the last of these holds."""
    return [c for c in ("ts", "is_delete", "join_key", "value") if c in changes.columns]


def versions(changes: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """pk, join_key, value, start, end (null: still holds). Deletes end a version without starting one. Of changes at one time, deletes count last, then the greatest join key and value."""
    dealt = deal(changes, ("pk",), F.unix_micros(F.col("ts").cast("timestamp")), hot_rows)
    changes, end = neighbour(dealt, ("pk",), _order(changes), F.col("ts"), END, ahead=True), F.col(END)
    gone = F.coalesce(F.col("is_delete"), F.lit(False)) if "is_delete" in changes.columns else F.lit(False)
    held = changes.where(~gone & (end.isNull() | (F.col("ts") < end)))
    return held.select("pk", "join_key", "value", F.col("ts").alias("start"), end.alias("end"))


def changelog_join(left: DataFrame, right: DataFrame, bucket_s: float | None = None, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """sign, join_key, left_pk, right_pk, left_value, right_value, ts.

    bucket_s: the width of the finest cells of time. With it, versions meet by join key and aligned interval (see
    ``interval_join``): two versions overlap if one starts while the other holds, so the starts of each side are looked
    up in the other side's versions. A version has O(log) rows however long it holds, and few join keys don't make few large groups.
    """
    lv, rv = versions(left, hot_rows), versions(right, hot_rows)
    names = lambda df, side: df.select("join_key", *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c != "join_key"])
    lv, rv = names(lv, "left"), names(rv, "right")
    if bucket_s:
        within = stab(lv, rv, ["join_key"], "left_start", "right_start", "right_end", bucket_s)
        after = stab(rv, lv, ["join_key"], "right_start", "left_start", "left_end", bucket_s).where("left_start < right_start")
        both = within.unionByName(after)
    else:
        both = lv.join(rv, "join_key")
    start, end = F.greatest("left_start", "right_start"), F.least("left_end", "right_end")
    both = both.withColumn("start", start).withColumn("end", end).where("end IS NULL OR start < end")
    events = F.array(F.struct(F.lit("+").alias("sign"), F.col("start").alias("ts")), F.struct(F.lit("-").alias("sign"), F.col("end").alias("ts")))
    out = both.withColumn("e", F.explode(events)).where("e.ts IS NOT NULL")
    return out.select("e.sign", "join_key", "left_pk", "right_pk", "left_value", "right_value", "e.ts")


def rekeyed(changes: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """A changelog with explicit deletes: when a pk's join key changes, its row under the old one is deleted first."""
    dealt = deal(changes, ("pk",), F.unix_micros(F.col("ts").cast("timestamp")), hot_rows)
    rows = neighbour(dealt, ("pk",), _order(changes), F.col("join_key"), OLD)
    moved = rows.where(F.col(OLD) != F.col("join_key")).select("pk", F.col(OLD).alias("join_key"), F.lit(None).cast(dict(changes.dtypes)["value"]).alias("value"), "ts", F.lit(True).alias("is_delete"))
    return rows.select("pk", "join_key", "value", "ts", F.lit(False).alias("is_delete")).unionByName(moved)
