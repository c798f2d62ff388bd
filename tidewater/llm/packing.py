"""Best-fit packing of token sequences by large-item matching.

Tokenising gives pieces of at most ``capacity`` ids; a longer document is cut so that
only its first piece is short. As lengths are integers up to the capacity, the plan
needs their histogram only (``capacity`` numbers, whatever the corpus): pieces above
one third of the capacity, of which no three fit, are matched greedily, each with the
largest that still fits beside it; then smaller ones, longest first, go where they leave
the smallest gap, and open new bins if there is none. Equal bins are handled as one class
with a count, which gives just what piece by piece best fit would. Bins are then dealt out
by a piece's rank among those of its length; ranks come from counts per (length, bucket),
so no task sees a whole length.

Cases: a null or empty text is the end token alone; rows that repeat an id are packed
each; ties in length go by doc_id, then piece, nulls first; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored

#: Letters of a word that is remembered, and such words at most.
SHORT, REMEMBER = 40, 600_000
#: A space that ends or breaks a run of white space is no safe boundary unless something visible follows.
SAFE = re.compile(r"(?<!\s) (?!$)|(?<=\s) (?=\S)")
SPACES = [chr(i) for i in range(0x3001) if chr(i).isspace()]
BEFORE_SPACE = [" " + c for c in SPACES if c.isascii()], [" " + c for c in SPACES if not c.isascii()]
ENDS = re.compile(r"(.*[A-Za-z])([.,;:!?]+)")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as it is, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


LETTERS = byte_letters()


class Words(dict):
    """Ids of words after ``lead`` (a space or nothing), as little-endian unsigned 32-bit bytes; short words are remembered.

    The pre-tokeniser cuts before and after a word, and in it between letters and the marks after
    them, and around a single line feed; so parts are coded apart. A word of plain letters is
    one pre-token and goes right to the library's model.
    """

    def __init__(self, tokenizer, lead: str, remember: int, heads: Words | None = None) -> None:
        super().__init__()
        self.tokenizer, self.model, self.lead, self.remember, self.heads = tokenizer, tokenizer.model, lead, remember, heads if heads is not None else self

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def code(self, word: str) -> bytes:
        if word.isalpha() and max(word) < "\u0250":  # letters in every version of Unicode
            coded = (self.lead + word).encode().decode("latin-1").translate(LETTERS)
            return array("I", [t.id for t in self.model.tokenize(coded)]).tobytes()
        if "\n" in word:
            parts = word.split("\n")
            if all(p and not any(map(str.isspace, p)) for p in parts):
                feed = self.heads["\n"]
                return feed.join([self[parts[0]], *[self.heads[p] for p in parts[1:]]])
        elif m := ENDS.fullmatch(word):
            return self[m[1]] + self.heads[m[2]]
        return self.whole(self.lead + word)

    def __missing__(self, word: str) -> bytes:
        ids = self.code(word) if word != "\n" else self.whole(self.lead + word)
        if len(word) <= SHORT:
            if len(self) >= self.remember:
                self.clear()
            self[word] = ids
        return ids


#: What a tokenizer's file must say for texts to be coded word by word; any other encodes whole texts by the library.
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
PLAIN_MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": "", "end_of_word_suffix": "", "byte_fallback": False}


def splits_words(tokenizer) -> bool:
    """Whether words may be coded apart: byte-level pre-tokens by the usual pattern, no normaliser, and added tokens that stand for their strings alone."""
    said = json.loads(tokenizer.to_str())
    pre, model = said["pre_tokenizer"] or {}, said["model"]
    added = all(not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in said["added_tokens"])
    return said["normalizer"] is None and added and all(pre.get(k) == v for k, v in PRE_TOKENIZER.items()) and all((model.get(k) or v) == v for k, v in PLAIN_MODEL.items())


class ByteEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, word by word where that is the same as at once."""

    def __init__(self, tokenizer_file: str, remember: int = REMEMBER) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.splits = splits_words(self.tokenizer)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.heads = Words(self.tokenizer, "", remember // 4)
        self.words = Words(self.tokenizer, " ", remember, self.heads)

    def encode(self, texts: list[str]) -> list[bytes]:
        """By the library at once."""
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def one(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.words.whole(text)
        plain = text[:1] != " " and text[-1:] != " " and not any(x in text for x in BEFORE_SPACE[0]) and (text.isascii() or not any(x in text for x in BEFORE_SPACE[1]))
        first, *rest = text.split(" ") if plain else SAFE.split(text)
        return self.heads[first] + b"".join(map(self.words.__getitem__, rest))

    def batch(self, texts: list[str]) -> list[bytes]:
        return list(map(self.one, texts)) if self.splits else self.encode(texts)


@lru_cache(maxsize=2)
def encoder(tokenizer_file: str, remember: int = REMEMBER) -> ByteEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
    return ByteEncoder(tokenizer_file, remember)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be short."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((i, capacity) for i in range(first, n, capacity))] if n else []


def pieces(docs: DataFrame, tokenizer_file: str, end_id: int, capacity: int, batch_bytes: int = 4 << 20, remember: int = REMEMBER) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row. remember: words whose ids a worker keeps at most, for speed alone."""
    end = np.array([end_id], "<u4").tobytes()
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .token_counts import by_bytes, sizes

        encode = encoder(tokenizer_file, remember).batch
        for b in slices(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            row, piece, start, length, crc = [], [], [], [], []
            at = 0
            for i, j in by_bytes(sizes(texts), batch_bytes):
                for ids in encode(texts[i:j]):
                    ids += end
                    for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                        row.append(at)
                        piece.append(k)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(ids[4 * s : 4 * (s + n)]))
                    at += 1
            ids_of = b.column("doc_id").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids_of, *map(pa.array, (np.array(piece, "i4"), np.array(start, "i8"), np.array(length, "i8"), np.array(crc, "i8")))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Bins for a histogram of lengths. classes: (lengths in the bin, number of such bins)."""

    def __init__(self, histogram: dict[int, int], capacity: int) -> None:
        self.capacity, self.classes = capacity, []
        self._gaps: list[int] = []  # sorted gaps that have open classes
        self._open: dict[int, list[tuple[tuple[int, ...], int]]] = {}
        left = {n: c for n, c in histogram.items() if c > 0}
        self._match({n: c for n, c in left.items() if 3 * n > capacity})
        for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
            self._place(n, left[n])
        for found in self._open.values():
            self.classes += found
        self.classes.sort(reverse=True)

    def _add(self, items: tuple[int, ...], count: int) -> None:
        gap = self.capacity - sum(items)
        if count <= 0:
            return
        if gap == 0:
            self.classes.append((items, count))
            return
        if gap not in self._open:
            bisect.insort(self._gaps, gap)
            self._open[gap] = []
        self._open[gap].append((items, count))

    def _match(self, large: dict[int, int]) -> None:
        lengths = sorted(large)
        while lengths:
            n = lengths[-1]
            k = bisect.bisect_right(lengths, self.capacity - n)
            if not k:
                self._add((n,), large[n])
                lengths.pop()
                continue
            m = lengths[k - 1]
            pairs = large[n] // 2 if m == n else min(large[n], large[m])
            self._add((n, m), pairs)
            for x in (n, m):
                large[x] -= pairs
            if m == n and large[n]:  # one is left over: it takes the next smaller one
                large[n] = 0
                if k >= 2:
                    self._add((n, lengths[k - 2]), 1)
                    large[lengths[k - 2]] -= 1
                else:
                    self._add((n,), 1)
            lengths = [x for x in lengths if large[x]]

    def _place(self, n: int, count: int) -> None:
        while count:
            k = bisect.bisect_left(self._gaps, n)
            if k == len(self._gaps):
                each = self.capacity // n
                self._add((n,) * each, count // each)
                self._add((n,) * (count % each), 1 if count % each else 0)
                return
            gap = self._gaps[k]
            items, bins = self._open[gap].pop()
            if not self._open[gap]:
                del self._open[gap], self._gaps[k]
            each = gap // n
            full = min(bins, count // each)
            self._add(items + (n,) * each, full)
            count -= full * each
            if full < bins and count:
                self._add(items + (n,) * count, 1)
                full, count = full + 1, 0
            self._add(items, bins - full)

    def slots(self) -> dict[int, list[tuple[int, int, int, int]]]:
        """length -> (first rank, pieces a bin, first bin, offset of the first in a bin), by rank. Its size depends on the capacity alone."""
        out: dict[int, list[tuple[int, int, int, int]]] = {}
        ranks: dict[int, int] = {}
        first_bin = 0
        for items, bins in self.classes:
            offset = 0
            for n in sorted(set(items), reverse=True):
                each = items.count(n)
                out.setdefault(n, []).append((ranks.get(n, 0), each, first_bin, offset))
                ranks[n] = ranks.get(n, 0) + each * bins
                offset += each * n
            first_bin += bins
        return out


def ranked(pieces: DataFrame, buckets: int) -> DataFrame:
    """Adds rank, a piece's number among those of its length, from counts per (length, bucket)."""
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(buckets)))
    base = pieces.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = base.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    return pieces.join(base, ["length", "bucket"]).withColumn("rank", F.col("base") + F.row_number().over(own) - 1)


def pack(docs: DataFrame, tokenizer_file: str, end_id: int = 2, capacity: int = 1024, remember: int = REMEMBER) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    found = stored(pieces(docs, tokenizer_file, end_id, capacity, remember=remember), "pieces")
    histogram = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # capacity rows at most
    slots = Plan(histogram, capacity).slots()
    table = {n: tuple(np.array(x, "i8") for x in zip(*v, strict=True)) for n, v in slots.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            seq, offset = np.empty(len(length), "i8"), np.empty(len(length), "i8")
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                first, each, bins, off = table[int(n)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                over = rank[at] - first[k]
                seq[at] = bins[k] + over // each[k]
                offset[at] = off[k] + over % each[k] * n
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in PIECE), pa.array(seq), pa.array(offset)], [*PIECE, "sequence_id", "offset"])

    rows = ranked(found, 64 + sum(histogram.values()) // 50_000).select(*PIECE, "rank")
    kind = found.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]
