"""The corpus pipeline, stage by stage, against plain versions of its stages' decisions."""

from collections import Counter

import corpus_pipeline
from test_operators import DOCS, messy, plain_survivors, words  # noqa: F401

from tidewater.llm import packing


def test_each_stage_decides_on_what_came_before(spark, messy):  # noqa: F811
    docs, seen = messy, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, None) if name == "packed" else spark.createDataFrame(stage(spark, docs, None).collect(), docs.schema)
        after = docs.collect()
        seen.append(name)
        if name != "packed":
            assert docs.columns == messy.columns
        if name == "language":
            assert sorted(map(repr, after)) == sorted(repr(r) for r in before if any(c.isalpha() for c in r.text or ""))
        elif name == "exact":
            lower = lambda r: (r.text or "").encode().lower()
            keep = {}
            for r in before:
                keep[lower(r)] = max((x for x in (keep.get(lower(r)), r.doc_id) if x is not None), default=None)
            assert {repr(r) for r in after} <= {repr(r) for r in before}
            assert Counter((r.doc_id, lower(r)) for r in after) == Counter((d, t) for t, d in keep.items())
        elif name == "near":
            assert sorted(map(repr, after)) == plain_survivors(before)
        elif name == "mixed":
            assert {repr(r) for r in after} <= {repr(r) for r in before}
            assert sum(len(words(r.text)) for r in after) <= 3 * sum(len(words(r.text)) for r in before)
            mixed = len(after)
    assert seen == ["language", "exact", "near", "mixed", "packed"]
    assert sum(r.piece == 0 for r in after) == mixed


def test_run_gives_pieces(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [*packing.PIECE, "sequence_id", "offset"] and 0 < out.count()


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_repeated_rows_leave_one(spark):
    rows = [(1, "Once more", "en", "a", 9)] * 3 + [(None, "no id", "en", "a", 5), (None, "No ID", "en", "a", 5), (None, "other", "en", "a", 5), (2, None, "en", "a", 0), (2, "x", "en", "b", 1)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for stage in (corpus_pipeline.exact, corpus_pipeline.near):
        left = sorted((repr(r.doc_id), (r.text or "").lower()) for r in stage(spark, df, None).collect())
        assert left == [("1", "once more"), ("2", ""), ("2", "x"), ("None", "no id"), ("None", "other")]
        assert stage(spark, df.limit(0), None).count() == 0
