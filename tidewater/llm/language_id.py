"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Texts are lower-cased, everything but letters becomes a space (runs of them one), and
n-grams of 1 to 3 code points are hashed into 2^17 features. Term frequency is relative
to the text's length; document frequencies are counted over all learnable documents. The
weights come from follow-the-regularised-leader (FTRL-proximal, per-coordinate rates,
L1 and L2 penalties) on a bounded sample, ``per_language`` documents of each language
with the least hash of their id; a fifth of the sample is kept apart to fit the temperature
that calibrates the scores. Every language is learned; the sample's rows and bytes and the model's
weights are bounded by parameters (see ``train``). Prediction reads whole texts.

Cases: a text that is null or has no letter is ``und`` with score 0, and so is every text if
nothing can be learned from; ties go to the first language in code point order; repeated
rows are predicted alike, and an id is learned from once; null ids are never learned from (their remainder is null) and
are not held out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MOST_HOT, free_name, hot_keys, join_salted, stored, strongest
from .shingles import U64, numbers, scramble

BITS, ORDERS, BLOCKS = 17, (1, 2, 3), 64
UNKNOWN = "und"
OF_PLACE = numbers(11, 8) | U64(1)
CHARS = 1 << 20
SCALE = 32.0


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def features(text: str | None) -> Iterator[np.ndarray]:
    """Hashed n-grams of the whole text in blocks; nothing if it has no letter."""
    a = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    black = letters()[a]
    if not black.any():
        return
    a = np.where(black, a, 32)
    keep = np.ones(len(a), bool)
    keep[1:] = black[1:] | black[:-1]
    a = np.concatenate(([32], a[keep], [32])).astype(U64)
    for start in range(0, len(a), CHARS):
        for n in ORDERS:
            part = a[start : start + CHARS + n - 1]
            if len(part) >= n:
                h = np.full(len(part) - n + 1, n, U64)
                for j in range(n):
                    h += part[j : len(part) - n + 1 + j] * OF_PLACE[j]
                yield ((h * U64(0x9E3779B97F4A7C15)) >> U64(64 - BITS)).astype(np.int64)


class Model:
    """table: idf times weight for each feature and language."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, merged: int = 0) -> None:
        self.languages, self.table, self.bias, self.temperature, self.merged = languages, table.astype(np.float32), bias, temperature, merged

    def predict(self, text: str | None) -> tuple[str, float]:
        total, n = 0.0, 0
        if self.languages:
            for h in features(text):
                total, n = total + np.take(self.table, h >> self.merged, axis=0).sum(0, dtype=np.float64), n + len(h)
        if not n:
            return UNKNOWN, 0.0
        p = softmax((total * (SCALE / n) + self.bias) / self.temperature)
        k = int(np.argmax(p))
        return self.languages[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, size: int, alpha=0.5, beta=1.0, l1=0.002, l2=0.01, epochs: int = 6, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """rows: (features, values, class). The last feature of the tables is the bias. Returns weights and bias."""
    z, n = np.zeros((size + 1, n_classes)), np.zeros((size + 1, n_classes))

    def weights(i):
        return np.where(np.abs(z[i]) > l1, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2), 0.0)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            i, x, y = rows[k]
            i, x = np.append(i, size), np.append(x, 1.0)
            w = weights(i)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    w = weights(np.arange(size + 1))
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log likelihood, on a logarithmic grid that is refined twice."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return -float(np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean())

    low, high = -3.0, 3.0
    for _ in range(3):
        grid = np.linspace(low, high, 31)
        best = grid[int(np.argmin([loss(np.exp(g)) for g in grid]))]
        low, high = best - (high - low) / 15, best + (high - low) / 15
    return float(np.exp(best))


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def sample(may: DataFrame, per_language: int, most_rows: int) -> tuple[list, int]:
    """Ids of ``per_language`` documents of each language, those of the least hash of their id, and how many languages there are.

    Many languages get equal shares of ``most_rows``, one document at least. Counts a language give the hash below which about 1.5
    times as many lie (and all of them where there are few), so no language is sorted or gathered; what lies below is cut to the number here.
    """
    counts = stored(may.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    languages = counts.count()
    share = max(min(per_language, most_rows // max(languages, 1)), 1)
    wanted = 1.5 * share + 50
    place = F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5
    if languages <= MOST_HOT:
        known = may.join(F.broadcast(counts), "lang")  # a row for each language
    else:
        known = join_salted(may, counts, ["lang"], hot_keys(may, ["lang"], counts.withColumnRenamed("n", "rows")))
    below = known.where(place * F.col("n") <= wanted).groupBy("doc_id").agg(F.min("lang").alias("lang"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), F.col("doc_id").cast("string")))  # few rows of each
    rows = below.select("doc_id", rank.alias("rank")).where(F.col("rank") <= share).select("doc_id").collect()  # share of each language
    return [r["doc_id"] for r in rows], languages


def train(docs: DataFrame, per_language: int = 400, most_rows: int = 25_600, most_bytes: int = 256 << 20, most_weights: int = 1 << 23) -> Model:
    """Learns from the documents whose remainder isn't 1, and of these from text and lang alone.

    Every language is learned. The sample has ``per_language`` documents of each, in all about most_rows; of a text the most frequent features
    are learned from, at most so many that all of the sample's have ``most_bytes``. With more than most_weights / 2^17 languages
    features are merged, by the first bits of their number, so that the model has ``most_weights`` weights.
    """
    may = docs.select("doc_id", "text", "lang").where((remainder(F.col("doc_id")) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids, n_languages = sample(may.select("doc_id", "lang"), per_language, most_rows)
    wanted = set(ids)
    if not wanted:
        return Model([], np.zeros((1, 0)), np.zeros(0), 1.0)
    most = max(most_bytes // (8 * len(wanted)), 1)
    size = 1 << BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n_docs, seen, given = np.zeros(size, np.int32), 0, np.zeros(size, bool), set()
        for b in batches:
            out = []
            for doc_id, text, lang in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = list(features(text))
                for h in own:
                    seen[h] = True
                at = np.flatnonzero(seen)
                seen[at] = False
                df[at] += 1
                n_docs += 1
                if own and doc_id in wanted and doc_id not in given:
                    given.add(doc_id)
                    i, c = np.unique(np.concatenate(own), return_counts=True)
                    i, x = strongest(i, c / c.sum(), most)
                    out.append((doc_id, lang, i.astype("<i4").tobytes(), x.astype("<f4").tobytes()))
            if out:
                yield _rows([(None, None, 0, *x) for x in out], b.schema.field("doc_id").type)
        yield _rows([(k, zlib.compress(x.astype("<i4").tobytes(), 1), n_docs, None, None, None, None) for k, x in enumerate(df.reshape(BLOCKS, -1))], b.schema.field("doc_id").type if n_docs else pa.null())

    kind = may.schema["doc_id"].dataType.simpleString()
    found = stored(may.mapInArrow(_guarded(run), f"block int, df binary, n_docs long, id {kind}, lang string, i binary, x binary"), "features")

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size // BLOCKS, np.int64), 0
        for b in batches:
            for x, m in zip(b.column("df").to_pylist(), b.column("n_docs").to_pylist(), strict=True):
                total += np.frombuffer(zlib.decompress(x), "<i4")
                n += m
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.astype("<i8").tobytes()], pa.binary()), pa.array([n], pa.int64())], ["block", "df", "n_docs"])

    df, n_docs = np.zeros(size), 1
    for r in found.where("block IS NOT NULL").select("block", "df", "n_docs").groupBy("block").applyInArrow(add, "block int, df binary, n_docs long").collect():
        at = size // BLOCKS
        df[r["block"] * at : (r["block"] + 1) * at], n_docs = np.frombuffer(r["df"], "<i8"), r["n_docs"]
    learned = found.where("block IS NULL").groupBy("id").agg(F.min(F.struct("lang", "i", "x")).alias("f")).select("id", "f.*").collect()  # the sample, most_bytes
    learned.sort(key=lambda r: (str(r["id"])))
    languages = sorted({r["lang"] for r in learned})
    merged = max(len(languages) * size // most_weights, 1).bit_length() - 1 if len(languages) * size > most_weights else 0
    merged += (len(languages) * (size >> merged)) > most_weights
    small = size >> merged
    idf = np.log((1 + n_docs) / (1 + np.minimum(df.reshape(small, -1).sum(1), n_docs))) + 1
    rows = []
    for r in learned:
        i, at = np.unique(np.frombuffer(r["i"], "<i4").astype(np.int64) >> merged, return_inverse=True)
        rows.append((i, np.bincount(at, np.frombuffer(r["x"], "<f4")) * idf[i] * SCALE, languages.index(r["lang"])))
    apart, fit = rows[::5], [x for k, x in enumerate(rows) if k % 5]
    w, bias = ftrl(fit or rows, len(languages), small)
    logits = np.array([x @ w[i] + bias for i, x, _ in apart])
    return Model(languages, w * idf[:, None], bias, fit_temperature(logits, np.array([y for *_, y in apart])), merged)


def _guarded(run):
    """A task without rows gives none."""

    def guarded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            from itertools import chain

            yield from run(chain([first], batches))

    return guarded


def _rows(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.binary(), pa.int64(), id_type, pa.string(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["block", "df", "n_docs", "id", "lang", "i", "x"])


def predictor(spark, model: Model):
    """A column function: text -> struct<lang_pred, score>. The model has a bounded size: features times languages."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict


def has_letter(text: Column) -> Column:
    @F.pandas_udf("boolean")
    def has(texts: pd.Series) -> pd.Series:
        return pd.Series([next(features(t), None) is not None for t in texts], dtype=bool)

    return has(text)


def identify(docs: DataFrame, **sizes: int) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row. sizes: those of ``train``."""
    predict = predictor(docs.sparkSession, train(docs, **sizes))
    p = docs.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), predict("text").alias("p"))
    return p.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, **sizes: int) -> DataFrame:
    """The rows of ``docs`` whose text has a language; those without a letter or a text go.

    The model's choice and score reject nothing. Where nothing can be learned, the letters alone decide.
    """
    if docs.isEmpty():
        return docs
    model = train(docs, **sizes)
    if not model.languages:
        return docs.where(has_letter(docs["text"]))
    predict = predictor(docs.sparkSession, model)
    mark = free_name(docs, "_language")
    return docs.withColumn(mark, predict(docs["text"])).where(F.col(f"{mark}.lang_pred") != UNKNOWN).drop(mark)
