"""Target-distribution importance resampling over hashed n-grams, by CRC combination.

Features are all runs of 1 to ``orders`` words, joined by a space; a feature's bucket is the CRC of its bytes modulo
``buckets``. Each word's CRC is computed once, and those of longer runs are composed from it (``crc``), so no run is ever
written out. Bucket counts over all documents and over the target's texts give each bucket's gain, the logarithm of
the ratio of the two smoothed shares in thousandths; a document's weight is its features' mean gain. Seeded Gumbel noise
is added, so that taking the highest scores draws documents without replacement with probability by weight.

The counts are a number for each bucket and task, summed by an aggregate; gains have a fixed size and are broadcast. Scores
are stored, and ranked by one range exchange: rows are sorted, each partition's rows counted, and a row's rank is its place
plus the rows of the partitions before it. No task sees all rows.

Cases: a null text has no words; without features the weight is 0; documents of fewer than ``least_words`` words are never
drawn; a null doc_id draws noise as the string "null" and comes last on ties; rows that repeat an id are
documents of their own and share its noise; an empty target has even shares; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh_path, slices
from .crc import run_crcs, word_crcs
from .token_counts import by_bytes, sizes

#: ASCII bytes that words consist of after lower-casing; all bytes of other characters belong to words too (fixed values).
BLACK = np.ones(256, bool)
BLACK[:128] = False
BLACK[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = True
#: Bytes of texts that are worked on at a time.
BLOCK = 2 << 20


def features(texts: list[str], orders: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The number of words of each text, and for each order the features' CRCs and the texts they are in."""
    encoded = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b"\0".join(encoded) + b"\0", np.uint8)
    ends = np.cumsum([len(x) + 1 for x in encoded])
    edge = np.flatnonzero(np.diff(BLACK[data], prepend=False, append=False))
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    owner = np.searchsorted(ends, starts, side="right")
    out = []
    for k, crcs in enumerate(run_crcs(word_crcs(data, starts, lengths), lengths, orders), 1):
        inside = owner[: len(crcs)] == owner[k - 1 :]
        out.append((crcs[inside], owner[: len(crcs)][inside]))
    return np.bincount(owner, minlength=len(texts)), out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch, list[str]]]:
    for b in slices(batches):
        texts = [t or "" for t in b.column("text").to_pylist()]
        for i, j in by_bytes(sizes(texts), BLOCK):
            yield i, j, b, texts[i:j]


def bucket_counts(docs: DataFrame, orders: int, buckets: int) -> DataFrame:
    """bucket, n of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for *_, texts in _blocks(batches):
            for crcs, _ in features(texts, orders)[1]:
                total += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, orders: int, buckets: int) -> np.ndarray:
    """The gain of each bucket."""
    s, t = np.zeros(buckets, object), np.zeros(buckets, object)
    for counts, df in ((s, source), (t, target)):
        for r in bucket_counts(df, orders, buckets).collect():  # a row for each bucket
            counts[r["bucket"]] = r["n"]
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log(float(b + 1) * all_s / (float(a + 1) * all_t))) for a, b in zip(s, t, strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, orders: int) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for i, j, b, texts in _blocks(batches):
            words, found = features(texts, orders)
            n, total = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for crcs, owner in found:
                so_far = np.concatenate(([0], np.cumsum(gain[crcs % np.uint32(len(gain))])))
                edges = np.searchsorted(owner, np.arange(len(texts) + 1))
                n += np.diff(edges)
                total += np.diff(so_far[edges])
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), *map(pa.array, (words.astype(np.int64), n, weight))], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from a hash of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def placed(df: DataFrame, order: list[Column], scratch: Scratch, name: str) -> tuple[DataFrame, int]:
    """df with its place (from 1) in an order, and its number of rows. df is to be a stored table, as sorting reads it twice."""
    part, at = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = scratch.stored(df.orderBy(*order).select("*", part.alias("_part"), at.alias("_at")), name)
    counts = sorted(map(tuple, rows.groupBy("_part").agg(F.count("*").alias("n")).collect()))  # a row for each partition
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    spark = df.sparkSession
    offsets = spark.createDataFrame(before, "_part int, _before long")
    return rows.join(F.broadcast(offsets), "_part").withColumn("place", F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before"), total


def resample(docs: DataFrame, target: DataFrame, orders: int = 2, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank (1, 2, ... by score for the drawn ``percent`` of the documents long enough, else null) of every row."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    found = weights(docs, gains(docs, target, orders, buckets), orders)
    scored = scratch.stored(found.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", "weight", F.monotonically_increasing_id()]  # the last one deals out repeated rows
    long, n = placed(scored.where(F.col("n_words") >= least_words), order, scratch, "ranked")
    drawn = F.when(F.col("place") <= percent * n // 100, F.col("place")).alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    out = long.select(*columns, drawn).unionByName(scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))
    path = fresh_path(spark, "resampled")
    out.write.parquet(path)
    scratch.clear()
    return spark.read.schema(out.schema).parquet(path)
