"""What is gathered on the driver or in a cell has a bound, whatever the rows are like."""

import random
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from test_operators import DOCS

from tidewater.llm import common, jaccard_join, language_id, packing, quality, topk


def test_strongest_features():
    i, x = np.array([1, 4, 7, 9]), np.array([0.5, 2.0, 0.5, 2.0])
    assert [a.tolist() for a in common.strongest(i, x, 3)] == [[1, 4, 9], [0.5, 2.0, 2.0]]
    assert common.strongest(i, x, 4)[0] is i


def test_a_hundred_languages_and_long_texts(spark, monkeypatch):
    """Texts of 20,000 words give a bounded part of their features, with the inverse document frequencies of all documents; every language is learned, also with fewer weights."""
    r = random.Random(5)
    letters = [chr(0x4E00 + 7 * k) for k in range(100)]
    rows = [(i, " ".join(letters[i % 100] * r.randint(1, 4) for _ in range(20_000 if i < 4 else 20)), f"l{i % 100:02}", "s", 0) for i in range(600)]
    docs, seen = spark.createDataFrame(rows, DOCS).repartition(4), []
    plain = language_id.ftrl
    monkeypatch.setattr(language_id, "ftrl", lambda rows, *x, **y: seen.extend(rows) or plain(rows, *x, **y))
    model = language_id.train(docs, per_language=2, most_bytes=200 * 8 * 10, most_weights=100 << 15)
    assert len(model.languages) == 100 and model.table.shape == (1 << 15, 100)
    assert max(len(i) for i, *_ in seen) <= 10
    held = [(d, t, lang) for d, t, lang, *_ in rows if d % 7 == 0]
    assert sum(model.predict(t)[0] == lang for _, t, lang in held) >= 0.9 * len(held)


def test_inverse_document_frequencies_equal_plain(spark, monkeypatch):
    r = random.Random(2)
    rows = [(i, " ".join("".join(r.choice("abcxyz") for _ in range(3)) for _ in range(9)), "ab"[i % 2], "s", 0) for i in range(60)]
    docs, seen = spark.createDataFrame(rows, DOCS).repartition(3), []
    plain = language_id.ftrl
    monkeypatch.setattr(language_id, "ftrl", lambda rows, *x, **y: seen.extend(rows) or plain(rows, *x, **y))
    language_id.train(docs)
    import zlib

    learn = [(d, t) for d, t, *_ in rows if zlib.crc32(str(d).encode()) % 3 != 1]
    of = {d: Counter(np.concatenate(list(language_id.features(t))).tolist()) for d, t in learn}
    df = Counter(f for c in of.values() for f in c)
    idf = {f: np.log((1 + len(learn)) / (1 + n)) + 1 for f, n in df.items()}
    want = sorted(tuple(sorted((f, round(n / c.total() * idf[f] * language_id.SCALE, 3)) for f, n in c.items())) for c in of.values())
    got = sorted(tuple(zip(i.tolist(), np.round(x, 3).tolist(), strict=True)) for i, x, _ in seen)
    apart = [x for x in want if x not in got]
    assert len(got) + len(apart) == len(want) and len(apart) == -(-len(want) // 5)


def test_long_rated_texts_are_bounded(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, " ".join(("good" if i % 2 else "bad") + str(r.randrange(10**6 if i < 3 else 5)) for _ in range(20_000 if i < 3 else 30)), "en", "s", 0) for i in range(60)]
    rated, seen = spark.createDataFrame([(i, i % 2 + 1) for i in range(60)], "doc_id long, grade int"), []
    plain = quality.fit
    monkeypatch.setattr(quality, "fit", lambda rows: seen.extend(rows) or plain(rows))
    quality.train(spark.createDataFrame(rows, DOCS), rated, sample=60, most_bytes=60 * 8 * 25)
    assert len(seen) == 60 and max(len(i) for i, *_ in seen) == 25


def test_vectors_of_one_norm_and_repeated_ones_fill_no_cell(spark):
    r = np.random.default_rng(4)
    signs = r.choice([-1.0, 1.0], (12_000, 8)).astype(float)
    same = np.tile(signs[0], (8_000, 1))
    data = np.concatenate((signs, same))
    df = spark.createDataFrame([(0 if i >= 12_000 else i, v) for i, v in enumerate(data.tolist())], "vec_id long, embedding array<double>").repartition(6)
    index = topk.Index(df, F.col("vec_id") % 4000 == 0)
    sizes = [x.n for x in index.postings.where("segment = -1").select(F.size("ids").alias("n")).collect()]
    assert sum(sizes) == 20_000 and max(sizes) <= topk.CELL_ROWS and sum(c for c, _ in index.bands.values()) == len(sizes)
    got = {}
    for x in topk.top_k(df, F.col("vec_id") % 4000 == 0).collect():
        got.setdefault(x.query_id, []).append((-x.score, x.vec_id, x["rank"]))
    ids = np.array([0 if i >= 12_000 else i for i in range(20_000)])
    for q in (0, 4000, 8000):
        mine = min(data[ids == q].tolist(), key=str)
        scores = (np.floor(256 * data) @ np.floor(256 * np.array(mine))).astype(int)
        want = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True) if i != q)[:5]
        assert sorted(got[q], key=lambda x: x[2]) == [(*w, n + 1) for n, w in enumerate(want)]


def test_many_texts_under_one_id(spark):
    """Each row is shingled once, not once for each class of its id."""
    r = random.Random(9)
    texts = [" ".join(str(r.randrange(10**6)) for _ in range(20)) for _ in range(1500)]
    texts += [t + " more" for t in texts[:300]]
    got = {}
    for name, ids in (("one", [7] * len(texts)), ("many", range(len(texts)))):
        df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids, texts, strict=True)], DOCS).repartition(4)
        began = time.monotonic()
        got[name] = jaccard_join.near_duplicate_components(df).groupBy("component_id").count().collect(), time.monotonic() - began
    assert got["one"][0] == [(7, len(texts))] and sorted(x["count"] for x in got["many"][0]) == [1] * 1200 + [2] * 300
    assert got["one"][1] < 3 * got["many"][1] + 5


def test_hot_keys_and_memos_take_no_workers_memory(spark):
    """A table of hot keys is made without Python workers, and the memo of the pipeline's last stage is bounded by its own number, for speed alone."""
    import public_tokenizers

    rows = spark.range(3000).selectExpr("IF(id < 2000, unhex('0a'), unhex(hex(id))) AS h", "id")
    hot = common.hot_keys(rows, ["h"])
    assert "LocalTableScan" in hot._jdf.queryExecution().executedPlan().toString()
    assert [(bytes(r.h), r._parts) for r in hot.collect()] == [(b"\n", 4)] and common.hot_keys(rows.where("id > 2000"), ["h"]) is None
    file = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.range(40).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 300), x -> concat('w', x * id))) AS text")
    one, other = (packing.pack(docs, file, **kw).drop("sequence_id").orderBy("doc_id", "piece").collect() for kw in ({}, {"remember": 20}))
    assert one == other
