"""Quality classifier: cumulative-link (proportional odds) regression on graded ratings.

P(grade > j) = sigmoid(w.x - t_j) with one weight vector over hashed words and ordered
thresholds t_0 < t_1 < ...; the gaps between them are exponentials, so they stay in order.
Values are 1 + log(count) scaled to length 1 over the words and word pairs of the whole
text. Fitted by AdaGrad on a bounded sample of rated documents (``sample`` rows with the
least hash of their id). From it come the expected grade, the sum of the tail probabilities,
and each tail probability for selection.

Grades of ``labels``: 0 toxic, 1 of low quality, 2 of good quality.

Cases: a null or empty text has no features, so the thresholds alone speak; documents
without ratings are scored like others; null ratings are dropped, repeated ones count as
often as they stand; of rows that repeat a rated id one text is learned from, the least in its features; without any rating every document has the even prior; null ids are
scored; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import strongest
from .shingles import OF_WORD, U64, scramble, text_words

BITS, GRADES = 18, 3


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    w = text_words(text)
    if not len(w):
        return np.empty(0, np.int64), np.empty(0)
    h = np.concatenate((w, scramble(w[1:] * OF_WORD[0] + w[:-1] * OF_WORD[1])))
    i, c = np.unique((h >> U64(64 - BITS)).astype(np.int64), return_counts=True)
    x = 1 + np.log(c)
    return i, x / np.sqrt((x * x).sum())


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class OrdinalModel:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.weights, self.thresholds = weights.astype(np.float32), thresholds

    def tails(self, text: str | None) -> np.ndarray:
        """P(grade > j) for each j, falling."""
        i, x = features(text)
        return sigmoid(float(x @ self.weights[i]) - self.thresholds)


def thresholds_of(free: np.ndarray) -> np.ndarray:
    return np.concatenate((free[:1], free[0] + np.cumsum(np.exp(free[1:]))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], grades: int = GRADES, epochs: int = 8, rate: float = 0.5, l2: float = 1e-5, seed: int = 9) -> OrdinalModel:
    """Stochastic likelihood steps with per-coordinate rates."""
    w, gw = np.zeros(1 << BITS), np.full(1 << BITS, 1e-4)
    counts = np.bincount([y for *_, y in rows], minlength=grades) + 1.0
    upper = 1 - np.cumsum(counts)[:-1] / counts.sum()
    start = -np.log(upper / (1 - upper))
    free = np.concatenate((start[:1], np.log(np.maximum(np.diff(start), 1e-3))))
    gf = np.full(len(free), 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            i, x, y = rows[k]
            t = thresholds_of(free)
            p = np.concatenate(([1.0], sigmoid(x @ w[i] - t), [0.0]))
            slope = p * (1 - p)
            mass = max(p[y] - p[y + 1], 1e-9)
            # the likelihood is p[y] - p[y+1]; each p falls with its threshold
            ds = (slope[y] - slope[y + 1]) / mass
            dt = np.zeros(len(t))
            if y > 0:
                dt[y - 1] -= slope[y] / mass
            if y < len(t):
                dt[y] += slope[y + 1] / mass
            g = ds * x - l2 * w[i]
            gw[i] += g * g
            w[i] += rate * g / np.sqrt(gw[i])
            df = np.concatenate(([dt.sum()], np.exp(free[1:]) * np.cumsum(dt[::-1])[::-1][1:]))
            gf += df * df
            free = free + 0.1 * df / np.sqrt(gf)
    return OrdinalModel(w, thresholds_of(free))


def grade(labels: DataFrame) -> DataFrame:
    """doc_id, grade. Rows with a null rating that decides are dropped."""
    g = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).when(F.col("quality") == 0, 1)
    return labels.select("doc_id", g.alias("grade")).where("doc_id IS NOT NULL AND grade IS NOT NULL")


def train(docs: DataFrame, rated: DataFrame, sample: int = 4000, most_bytes: int = 256 << 20) -> OrdinalModel:
    """rated: doc_id, grade (0 to GRADES - 1). Of a rated text the features of greatest value are learned from, at most so many that all of the sample's have ``most_bytes``."""
    most = max(most_bytes // (8 * sample), 1)
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [strongest(*features(t), most) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([i.astype("<i4").tobytes() for i, _ in found], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in found], pa.binary())], ["doc_id", "i", "x"])

    chosen = chosen.groupBy("doc_id", "grade").agg(F.count("*").alias("times"))  # ``sample`` rows at most
    ids = chosen.select("doc_id").distinct()
    joined = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    kind = joined.schema["doc_id"].dataType.simpleString()
    found = joined.mapInArrow(run, f"doc_id {kind}, i binary, x binary").groupBy("doc_id").agg(F.min(F.struct("i", "x")).alias("f"))  # one text an id
    got = found.join(chosen, "doc_id").select("doc_id", "grade", "times", "f.i", "f.x").collect()
    got.sort(key=lambda r: (r["doc_id"], r["grade"]))
    rows = [(np.frombuffer(r["i"], "<i4").astype(np.int64), np.frombuffer(r["x"], "<f4").astype(float), r["grade"]) for r in got for _ in range(r["times"])]
    return fit(rows)


def score(docs: DataFrame, model: OrdinalModel, good: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, p_above_0, p_above_1, kept (P(grade > 0) of at least ``good``: not toxic)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def tails(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.tails(t).tolist() for t in texts], dtype=object)

    p = docs.select("doc_id", tails("text").alias("p"))
    return p.select("doc_id", (F.col("p")[0] + F.col("p")[1]).alias("expected_grade"), F.col("p")[0].alias("p_above_0"), F.col("p")[1].alias("p_above_1"), (F.col("p")[0] >= good).alias("kept"))
