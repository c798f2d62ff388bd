"""Exact deduplication by a 128-bit content hash, with a byte comparison inside groups.

Plan: one pass over the texts gives (doc_id, hash128, sha256); these narrow rows are
stored. Groups of the hash with more than one row are compared byte by byte: their
texts are fetched by the (unique) document id, so no group meets in one task, and
reduced to the least and greatest text of each hash with map-side combination. If
the two differ the hash collided, and just that hash is grouped by text instead.

Groups of most rows are dealt into parts where rows are joined by the hash.

Cases: a null text counts as empty, so null and empty texts are one group. A null
doc_id loses against any other; a group of null ids only keeps them (keep_id null,
kept true). Rows repeated whole share their id, so the report keeps or drops them together, and each
counts in group_size; ``drop_exact_duplicates`` leaves one row of each text, also of rows that
repeat an id and of null ids. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, join_salted, leave_one, row_mark, stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII takes the JVM's fast path, which is the same there."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def fingerprint(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def exact_duplicates(docs: DataFrame, keep: str = "max") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    keep: "max" or "min", which document id of equal texts stays.
    """
    pick = {"max": F.max, "min": F.min}[keep]
    rows = docs.select(F.col("doc_id"), normalised(F.col("text")).alias("norm"))
    marks = stored(rows.select("doc_id", fingerprint(F.col("norm")).alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha")), "marks")

    groups = marks.groupBy("h").agg(F.count("*").alias("group_size"), pick("doc_id").alias("keep_id"))
    several = stored(groups.where("group_size > 1"), "groups")
    hot = hot_keys(several, ["h"], several.select("h", F.col("group_size").alias("rows")))
    members = join_salted(marks.select("doc_id", "h"), several.select("h"), ["h"], hot).distinct()

    # Byte comparison. A null id can't be joined on, so such rows bring their hash along.
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("raw"))
    fetched = (
        texts.join(members.where("doc_id IS NOT NULL"), F.col("id") == F.col("doc_id"))
        .select("h", normalised(F.col("raw")).alias("norm"))
        .where(fingerprint(F.col("norm")) == F.col("h"))
        .unionByName(texts.where("id IS NULL").select(normalised(F.col("raw")).alias("norm")).select(fingerprint(F.col("norm")).alias("h"), "norm"))
    )
    collided = stored(
        fetched.groupBy("h").agg(F.min("norm").alias("least"), F.max("norm").alias("greatest")).where("least <> greatest").select("h"),
        "collided",
    )
    if not collided.isEmpty():
        groups, marks = _split(rows, marks, collided, pick)
        return _report(join_salted(marks, groups, ["h", "part"], hot_keys(groups, ["h", "part"], groups.withColumnRenamed("group_size", "rows"))))
    return _report(join_salted(marks, groups, ["h"], hot))


def _split(rows: DataFrame, marks: DataFrame, collided: DataFrame, pick) -> tuple[DataFrame, DataFrame]:
    """Groups of colliding hashes are told apart by their whole text; all others have part ''."""
    hashed = rows.withColumn("h", fingerprint(F.col("norm")))
    apart = hashed.join(collided, "h", "left_semi").select("doc_id", "h", F.unhex(F.sha2("norm", 256)).alias("sha"), F.col("norm").alias("part"))
    marks = marks.join(collided, "h", "left_anti").withColumn("part", F.lit("")).unionByName(apart)
    return marks.groupBy("h", "part").agg(F.count("*").alias("group_size"), pick("doc_id").alias("keep_id")), marks


def _report(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, keep: str = "max") -> DataFrame:
    """One row of each text, with all columns: of the id that stays, and of rows that repeat it the one of least hash."""
    kind = docs.schema["doc_id"].dataType
    mark = row_mark(docs["doc_id"], kind, F.unhex(F.sha2(normalised(docs["text"]), 256)))
    several = exact_duplicates(docs, keep).where("group_size > 1").select("kept", row_mark(F.col("doc_id"), kind, F.unhex("text_sha256")).alias("mark"))
    several = stored(several, "several")
    return leave_one(docs, mark, several.where(~F.col("kept")).select("mark"), several.select("mark"))
