"""BPE encoding and decoding by dynamic programming over prefixes.

The last token of a prefix's encoding is unique. So it is enough to find it for every prefix, from left to right: an
automaton with suffix links gives the tokens that end at each place (the matches), and of these exactly
one is compatible with the last token of what is before it. The back-pointer is that token's length;
following it from the end gives the ids. Nothing is merged, and the time is linear in the text's matches.

Two tokens are compatible if encoding their joined text gives just them. Each token's text is
built by merges, so at the border stand, from the last merge back to single symbols, the right ends of one and the left
ends of the other. They stay apart unless a merge of two ends that exist at one time has a rank before
the merges that use them up (of equal ranks the left one goes first). Results are kept by pair.

Supported: vocabularies in which a merge's rank is above those that make its parts, with an end-of-word sign or without;
this is checked when the file is read. Normalising and cutting texts into words is done as the file says, by the public
library's parts for that, once for each distinct chunk between white space (``NORMALISED`` tells what this relies on).

Cases: a null text counts as empty and has no ids; strings of special tokens inside texts become these tokens, as by the
library's default; texts of any length are encoded whole, a chunk in linear time; repeated rows are encoded alike; null ids
of documents are passed on; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices
from .token_counts import by_bytes, sizes

#: Between these, texts are encoded chunk by chunk: they are starters that compose with nothing, and no word holds one.
CHUNK = re.compile(r"[^ \t\n\r\f\v]+")
#: ASCII that Python splits at and patterns for white space don't.
SEPARATOR = re.compile("[\x1c-\x1f]").search
#: Printable ASCII without the space, and Latin letters with marks (and the signs of multiplication and division).
PLAIN = re.compile("[!-~À-ÿ]*").fullmatch
#: The symbols of bytes (as Latin-1 characters) in byte-level vocabularies: printable ones stand for themselves, the others follow from U+0100 on.
SYMBOLS = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
#: Steps that treat chunks as they treat the whole text.
NORMALISED, CUT = {"NFC", "Lowercase", "Replace"}, {"Split", "ByteLevel"}
#: Stands for the end-of-word sign in the automaton; byte-level symbols never are this.
END = "\0"
#: Chunks (in each generation) and pairs of tokens whose results a worker keeps, and the longest chunk that it keeps.
MOST_CHUNKS, MOST_PAIRS, LONGEST = 100_000, 250_000, 32


class Merges:
    """Ranks of merges, and of each token the parts and the rank of the merge that makes it."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str) -> None:
        self.rank: dict[tuple[int, int], int] = {}
        size = max(vocab.values()) + 1
        self.left, self.right, self.born = [-1] * size, [-1] * size, [-1] * size
        for r, pair in enumerate(merges):
            a, b = pair if not isinstance(pair, str) else pair.split(" ")
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            if self.born[made] >= 0 or max(self.born[x], self.born[y]) >= r or (suffix and a.endswith(suffix)):
                raise ValueError(f"merge {r} makes a token again, or before its parts")
            self.rank[x, y], self.left[made], self.right[made], self.born[made] = r, x, y, r

    def apart(self, x: int, y: int, limit: int = 1 << 60) -> bool:
        """Whether no merge before ``limit`` joins an end of x with a start of y."""
        gone_x = gone_y = limit
        while True:
            r = self.rank.get((x, y))
            if r is not None and r < gone_x and (r < gone_y or r == gone_y < limit):
                return False
            bx, by = self.born[x], self.born[y]
            if bx > by:
                gone_x, x = bx, self.right[x]
            elif by >= 0:
                gone_y, y = by, self.left[y]
            else:
                return True


class Memo(dict):
    """Results of short strings in two generations: when the newer one is full it becomes the older one, of which only what is asked for again stays."""

    def __init__(self) -> None:
        super().__init__()
        self.old: dict[str, bytes] = {}

    def earlier(self, key: str) -> bytes | None:
        found = self.old.get(key)
        if found is not None:
            self.keep(key, found)
        return found

    def keep(self, key: str, value: bytes) -> None:
        if len(key) <= LONGEST:
            if len(self) >= MOST_CHUNKS:
                self.old = dict(self)
                self.clear()
            self[key] = value


class Codec:
    """Encodes and decodes by a tokenizer's file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        steps = lambda x, parts: [] if x is None else [s["type"] for s in x.get(parts, [x])]
        kinds = set(steps(file["normalizer"], "normalizers")) <= NORMALISED, set(steps(file["pre_tokenizer"], "pretokenizers")) <= CUT
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or not plain or not all(kinds) or file["decoder"] or any(t["normalized"] for t in file["added_tokens"]):
            raise ValueError(f"{path} isn't a byte-level BPE of the supported kind")
        library = Tokenizer.from_file(path)
        self.normalise = library.normalizer.normalize_str if library.normalizer else str
        self.cut = library.pre_tokenizer.pre_tokenize_str
        self.suffix, self.special = model["end_of_word_suffix"] or "", {t["content"]: t["id"] for t in file["added_tokens"]}
        self.plain = _plain_cut(file)
        self.any_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        vocab: dict[str, int] = model["vocab"]
        self.merges = Merges(vocab, model["merges"], self.suffix)
        self.base = max([*vocab.values(), *self.special.values()]) + 1
        self.length, self.automaton = [0] * self.base, ahocorasick.Automaton()
        for name, i in vocab.items():
            if self._whole(i):
                form = name[: -len(self.suffix)] + END if self.suffix and name.endswith(self.suffix) else name
                self.length[i] = len(form)
                self.automaton.add_word(form, i)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.chunks, self.words = Memo(), Memo()

    def _whole(self, token: int) -> bool:
        """Whether the token's own text is encoded as this token."""
        m, todo = self.merges, [token]
        while todo:
            t = todo.pop()
            if m.born[t] >= 0:
                if not m.apart(m.left[t], m.right[t], m.born[t]):
                    return False
                todo += m.left[t], m.right[t]
        return True

    def word(self, word: str) -> list[int]:
        """The ids of a word of byte-level symbols."""
        text = word + END if self.suffix else word
        last, length, pairs, base, most = [-1] * (len(text) + 1), self.length, self.pairs, self.base, MOST_PAIRS
        for end, token in self.automaton.iter(text):
            if last[end + 1] < 0:
                before = end + 1 - length[token]
                if before:
                    if (x := last[before]) < 0:
                        continue
                    fits = pairs.get(key := x * base + token)
                    if fits is None:
                        if len(pairs) >= most:
                            pairs.clear()
                        fits = pairs[key] = self.merges.apart(x, token)
                    if not fits:
                        continue
                last[end + 1] = token
        out, i = [], len(text)
        while i:
            out.append(last[i])
            i -= length[last[i]]
        return out[::-1]

    def _words(self, part: str) -> list[str]:
        """The words of a text without special tokens or white space, in byte-level symbols."""
        if self.plain and PLAIN(part):
            words = self.plain.findall(part.lower())
            return words if part.isascii() else [w.encode().decode("latin-1").translate(SYMBOLS) for w in words]
        return [w for w, _ in self.cut(self.normalise(part))]

    def chunk(self, chunk: str) -> bytes:
        """The ids of what stands between white space, as 32-bit integers."""
        known = self.chunks.earlier(chunk)
        if known is not None:
            return known
        out: list[bytes] = []
        for i, part in enumerate(self.any_special.split(chunk) if self.any_special and self.any_special.search(chunk) else [chunk]):
            if i % 2:
                out.append(array("i", [self.special[part]]).tobytes())
            elif part:
                for word in self._words(part):
                    ids = self.words.get(word) or self.words.earlier(word)
                    if ids is None:
                        ids = array("i", self.word(word)).tobytes()
                        self.words.keep(word, ids)
                    out.append(ids)
        ids = out[0] if len(out) == 1 else b"".join(out)
        self.chunks.keep(chunk, ids)
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text, as 32-bit integers."""
        known, chunk = self.chunks.get, self.chunk
        return b"".join([known(c) or chunk(c) for c in (text.split() if text.isascii() and not SEPARATOR(text) else CHUNK.findall(text))])


def _plain_cut(file: dict) -> re.Pattern | None:
    """The file's pattern for words as it is for PLAIN texts, whose characters are composed and lower-cased one by one; None if the file's steps are other ones."""
    cuts, normal = file["pre_tokenizer"], file["normalizer"]
    if not cuts or not normal or [s["type"] for s in cuts.get("pretokenizers", [])] != ["Split", "ByteLevel"] or [s["type"] for s in normal.get("normalizers", [])] != ["NFC", "Replace", "Lowercase"]:
        return None
    split, level = cuts["pretokenizers"]
    replaced = normal["normalizers"][1]
    if not split["invert"] or split["behavior"] != "Removed" or level["add_prefix_space"] or level["use_regex"] or replaced["pattern"].get("Regex") != r"\s+":
        return None
    # without the pattern's own classes it is an ordinary one
    return re.compile(split["pattern"]["Regex"].replace(r"\p{L}", "A-Za-zÀ-ÖØ-öø-ÿ").replace(r"\p{N}", "0-9"))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


@lru_cache(maxsize=2)
def names(path: str) -> list[str | None]:
    """The token of each id."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    if file["decoder"]:
        raise ValueError(f"{path} has a decoder of its own")
    every = {**file["model"]["vocab"], **{t["content"]: t["id"] for t in file["added_tokens"]}}
    out: list[str | None] = [None] * (max(every.values()) + 1)
    for name, i in every.items():
        out[i] = name
    return out


def decoded(ids: list[int], path: str) -> str:
    """As a library without a decoder does: tokens with spaces between."""
    known = names(path)
    return " ".join([known[i] for i in ids])


def encode(docs: DataFrame, path: str, batch_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, ids of every row. path: a tokenizer's file, at that place on each executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in slices(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            for i, j in by_bytes(sizes(texts), batch_bytes):
                ids = [c.encode(t) for t in texts[i:j]]
                ends = np.cumsum([0, *map(len, ids)]) // 4
                flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["doc_id", "ids"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(ids: Column, path: str) -> Column:
    """The text of token ids (array<int>); null for null."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        at, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        good = column.is_valid().to_numpy(zero_copy_only=False)
        return pa.array([decoded(values[at[i] : at[i + 1]].tolist(), path) if good[i] else None for i in range(len(column))], pa.string())

    return run(ids)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded text of every row."""
    both = encode(docs, path).withColumn("decoded", decode(F.col("ids"), path))
    joined = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
