"""Token counts: Arrow functions that encode in batches balanced by bytes and return lengths only.

A long text is split at safe boundaries, spaces after something else than a space: no
piece of the vocabulary holds a word mark after another character (checked when the
model is loaded; else texts are encoded whole), so no merge crosses such a place and
counts add up. Batches hold about ``batch_bytes``, whatever the number of texts.

Cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows count alike; null ids
are passed on; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

MARK = "▁"  # the library's sign for a space
#: A space (or its mark) after something else, with something else after it.
SAFE = re.compile(r"[^ ▁][ ](?=[^ ▁])")


class PieceCounter:
    def __init__(self, model_file: str, long: int = 1 << 16) -> None:
        import sentencepiece

        self.model, self.long = sentencepiece.SentencePieceProcessor(model_file=model_file), long
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.splits = not any(MARK in p.lstrip(MARK) for p in pieces)

    def chunks(self, text: str) -> list[str]:
        """Of about ``long`` characters. The model sees a mark before its input, so each chunk stands for the space it was cut at and itself."""
        if len(text) < 2 * self.long or not self.splits:
            return [text]
        out, start, at = [], 0, self.long
        while m := SAFE.search(text, at):
            out.append(text[start : m.end() - 1])
            start = m.end()
            at = start + self.long
        out.append(text[start:])
        if not out[-1]:  # a space at the end stays with what comes before
            out[-2:] = [out[-2] + " "]
        return out

    def count(self, texts: list[str]) -> list[int]:
        rows = [self.chunks(t) for t in texts]
        n = iter(map(len, self.model.encode([c for row in rows for c in row], num_threads=1)))
        return [sum(next(n) for _ in row) for row in rows]


@lru_cache(maxsize=2)
def counter(model_file: str) -> PieceCounter:
    return PieceCounter(model_file)


def sizes(texts: list[str]) -> list[int]:
    """UTF-8 bytes of each text."""
    return [len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts]


def by_bytes(n_bytes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Slices of about ``most`` bytes each."""
    start = size = 0
    for i, n in enumerate(n_bytes):
        size += n
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(n_bytes):
        yield start, len(n_bytes)


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, batch_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row. model_file must be at that path on each executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_file).count
        for b in slices(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            n_bytes = sizes(texts)
            n = [x for i, j in by_bytes(n_bytes, batch_bytes) for x in count(texts[i:j])]
            n_tokens = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_bytes, pa.int64()), n_tokens, pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
