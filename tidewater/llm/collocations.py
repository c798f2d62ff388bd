"""Phrase collocation mining over vertical positional inverted lists.

Documents are taken in blocks of bounded size, each language in a block of its own. A block is stored as inverted lists:
for each of its words the sorted positions where it stands (a place between pieces is skipped, so neighbours in
a piece differ by one). Phrases don't cross documents, so every list is joined within its block, and
a phrase's frequency is the summed length of its lists in all blocks.

Levels. Words that stand at least ``least`` times over all keep their lists. The list of a pair is the merge join of a frequent word's
positions with the postings of the word after it, and the list of a longer phrase that of the phrase without its last word with the
list of the frequent pair at its end; so blocks are visited twice, whatever the phrases' lengths. A visit gives the
lengths of the lists; a window over each phrase sums them and hands the frequent pairs back to the blocks that have
them. A phrase has one row a block there at most, so none is more than a fair share of the exchange: a block holds ``block_words`` words.

Words are told apart by where they are first met (block and place in its vocabulary), which is unique, not by a hash.

A candidate's cuts look up the frequencies of both parts, which are frequent themselves; the lowest score counts. Candidates inside
longer ones of at least ``inside_percent`` of their frequency go. The best ``most`` of each language are ranked.

Cases: null and empty texts have no words; a null language is ``und``; repeated rows count as often as they stand; ids may be null or
repeated (they aren't read); a piece of any length is one; an empty table, or one without frequent phrases, gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh_path, hot_keys, join_salted, slices

#: Lower-casing, and what ends a piece or a word (fixed values of the contract). The mark stands in no UTF-8 text.
MARK = b"\xff"
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0a\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz" + MARK * 10)
#: A word's number is a task's, a block's in it and the place in its vocabulary, in so many bits.
BLOCK_BITS, PLACE_BITS = 14, 29
LISTS = "block long, lang string, n long, words array<string>, counts array<int>, positions binary"


class Vocabulary(dict):
    """Numbers words in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Builder:
    """The words of one language on their way into a block; 0 is the place between pieces."""

    def __init__(self) -> None:
        self.vocabulary, self.parts, self.n = Vocabulary({MARK: 0}), [np.zeros(1, np.int32)], 0

    def add(self, text: str) -> None:
        tokens = text.encode("utf-8", "surrogatepass").translate(TABLE).replace(MARK, b" \xff ").split()
        part = np.fromiter(map(self.vocabulary.__getitem__, tokens), np.int32, len(tokens))
        self.n += int(np.count_nonzero(part))
        self.parts += part, np.zeros(1, np.int32)

    def lists(self, block: int, lang: str) -> pa.RecordBatch:
        of = np.concatenate(self.parts)
        positions = np.argsort(of, kind="stable").astype(np.int32)
        counts = np.bincount(of, minlength=len(self.vocabulary)).astype(np.int32)
        words = list(self.vocabulary)[1:]
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        columns = [pa.array([block]), pa.array([lang]), pa.array([self.n]), one(pa.array(words, pa.binary()).cast(pa.string())), one(pa.array(counts[1:])), pa.array([packed(positions[counts[0] :], counts[1:])], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["block", "lang", "n", "words", "counts", "positions"])


def packed(positions: np.ndarray, counts: np.ndarray) -> bytes:
    """Lists one after the other, each as its first position and steps."""
    steps = np.diff(positions, prepend=np.int32(0))
    starts = np.cumsum(counts) - counts
    steps[starts] = positions[starts]
    return zlib.compress(steps.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)  # the high bytes, mostly 0, stand together


def unpacked(data: bytes, counts: np.ndarray) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    steps = np.ascontiguousarray(planes.T).view("<i4").ravel().astype(np.int64)
    total, starts = np.cumsum(steps), np.cumsum(counts) - counts
    return total - np.repeat(total[starts] - steps[starts], counts)


def postings(docs: DataFrame, block_words: int) -> DataFrame:
    """The inverted lists of each block, with the columns LISTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, done = TaskContext.get().partitionId() << BLOCK_BITS, 0
        builders: dict[str, Builder] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal done
            for lang, b in builders.items():
                if b.n:
                    yield b.lists(first + done, lang)
                    done += 1
            builders.clear()
            if done >> BLOCK_BITS:
                raise ValueError("a task has more blocks than can be numbered: block_words is too small")

        for batch in slices(batches, 256):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if text:
                    builders.setdefault("und" if lang is None else lang, Builder()).add(text)
                    if sum(b.n for b in builders.values()) >= block_words:
                        yield from flush()
        yield from flush()

    return docs.select("text", "lang").mapInArrow(run, LISTS)


def _kept(lists: DataFrame, kept: DataFrame) -> DataFrame:
    """block, ids (ascending), counts, positions of the words of each block that ``kept`` (block, place, id) names."""

    def cut(x: pa.Table, k: pa.Table) -> pa.Table:
        if not x.num_rows or not k.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "ids": pa.array([], pa.binary()), "counts": pa.array([], pa.binary()), "positions": pa.array([], pa.binary())})
        counts = x.column("counts").combine_chunks().flatten().to_numpy().astype(np.int64)
        positions, starts = unpacked(x.column("positions")[0].as_py(), counts), np.cumsum(counts) - counts
        ids, place = k.column("id").to_numpy(), k.column("place").to_numpy()
        order = np.argsort(ids)
        ids, place = ids[order], place[order]
        n = counts[place]
        at = np.repeat(starts[place] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return pa.table({"block": x.column("block"), "ids": pa.array([ids.astype("<i8").tobytes()]), "counts": pa.array([n.astype("<i4").tobytes()]), "positions": pa.array([packed(positions[at].astype(np.int32), n)])})

    return lists.select("block", "counts", "positions").groupBy("block").cogroup(kept.groupBy("block")).applyInArrow(cut, "block long, ids binary, counts binary, positions binary")


class Block:
    """The lists of a block, sorted by position for merging: where words stand, and which ones (as places in ``ids``)."""

    def __init__(self, ids: bytes, counts: bytes, positions: bytes) -> None:
        self.ids, n = np.frombuffer(ids, "<i8"), np.frombuffer(counts, "<i4").astype(np.int64)
        at = unpacked(positions, n)
        order = np.argsort(at)
        self.at, self.word = at[order], np.repeat(np.arange(len(n)), n)[order]

    def extend(self, at: np.ndarray, phrase: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merge join of phrases of k words (sorted positions) with the word after them: positions, phrases and words."""
        near = np.searchsorted(self.at, at + k)
        near[near == len(self.at)] = 0
        hit = self.at[near] == at + k
        return at[hit], phrase[hit], self.word[near[hit]]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted positions where a word has a neighbour, and a number for each pair."""
        at, first, second = self.extend(self.at, self.word, 1)
        return at, first * len(self.ids) + second

    def chains(self, known: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 3 to ``longest`` words, the phrases all of whose pairs are ``known`` (a row of two word ids each), as places in ``ids``, and their lists' lengths."""
        rows, size = np.searchsorted(self.ids, known), len(self.ids)
        order = np.argsort(rows[:, 0] * size + rows[:, 1])
        rows = rows[order]
        wanted = rows[:, 0] * size + rows[:, 1]
        at, key = self.pairs()
        number = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
        good = wanted[number] == key
        at, number = at[good], number[good]
        where, phrase, words = at, number, rows
        for k in range(3, longest + 1):  # merge join with the lists of the pairs k - 2 places on
            near = np.searchsorted(at, where + k - 2)
            near[near == len(at)] = 0
            hit = at[near] == where + k - 2
            where, last = where[hit], rows[number[near[hit]], 1]
            key, phrase, count = np.unique(phrase[hit] * size + last, return_inverse=True, return_counts=True)
            if not len(key):
                return
            words = np.column_stack((words[key // size], key % size))
            yield words, count


def _counted(block: int, words: np.ndarray, count: np.ndarray, longest: int) -> pa.RecordBatch:
    """words: a row of word ids for each phrase."""
    n, k = words.shape
    columns = [pa.array(words[:, i]) if i < k else pa.nulls(n, pa.int64()) for i in range(longest)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, block, np.int64)), *columns, pa.array(count.astype(np.int32))], ["block", *_words(longest), "n"])


def _words(longest: int) -> list[str]:
    return [f"w{i}" for i in range(1, longest + 1)]


def _kind(longest: int) -> str:
    return ", ".join(["block long", *(f"{w} long" for w in _words(longest)), "n int"])


def _pairs(lists: DataFrame) -> DataFrame:
    """block, w1, w2, n: lengths of the lists of all pairs of neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in range(batch.num_rows):
                block, *parts = (batch.column(c)[x].as_py() for c in ("block", "ids", "counts", "positions"))
                b = Block(*parts)
                key, count = np.unique(b.pairs()[1], return_counts=True)
                if len(key):
                    yield _counted(block, np.column_stack((b.ids[key // len(b.ids)], b.ids[key % len(b.ids)])), count, 2)

    return lists.mapInArrow(run, _kind(2))


def _longer(lists: DataFrame, pairs: DataFrame, longest: int) -> DataFrame:
    """block, w1 to w(longest) (null beyond a phrase's end), n: lengths of the lists of phrases of 3 words and more, all of whose pairs are among a block's frequent ones (block, w1, w2)."""

    def run(x: pa.Table, f: pa.Table) -> pa.Table:
        out = []
        if x.num_rows and f.num_rows:
            b = Block(*(x.column(c)[0].as_py() for c in ("ids", "counts", "positions")))
            known = np.column_stack((f.column("w1").to_numpy(), f.column("w2").to_numpy()))
            out = [_counted(x.column("block")[0].as_py(), b.ids[words], count, longest) for words, count in b.chains(known, longest)]
        kinds = pa.schema([("block", pa.int64()), *((w, pa.int64()) for w in _words(longest)), ("n", pa.int32())])
        return pa.Table.from_batches(out, kinds)

    return lists.groupBy("block").cogroup(pairs.groupBy("block")).applyInArrow(run, _kind(longest))


def _frequent(counted: DataFrame, ws: list[str], least: int) -> DataFrame:
    """The rows of phrases whose lists have ``least`` places over all blocks, with their frequency f and the first block that has them."""
    same = Window.partitionBy(*ws)
    return counted.select("block", *ws, F.sum(F.col("n").cast("long")).over(same).alias("f"), F.min("block").over(same).alias("first")).where(F.col("f") >= least)


def phrases(docs: DataFrame, scratch: Scratch, longest: int, least: int, block_words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent words (id, lang, word), frequent phrases of 1 to ``longest`` words (ws: their ids, f), and the words of each language (lang, n)."""
    spark = docs.sparkSession
    first, second = Scratch(spark), Scratch(spark)  # what a visit of the blocks reads is deleted after it
    lists = first.stored(postings(docs, block_words), "lists")
    sizes = scratch.stored(lists.groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    each = lists.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "x")).select("block", "lang", "place", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    number = F.shiftleft("block", PLACE_BITS) + F.col("place")
    same = Window.partitionBy("lang", "word")
    each = each.select("block", "lang", "place", "word", number.alias("number"), F.sum(F.col("n").cast("long")).over(same).alias("f"), F.min(number).over(same).alias("id"))
    each = first.stored(each.where(F.col("f") >= least), "words")
    vocabulary = scratch.stored(each.where("number = id").select("id", "lang", "word", "f"), "vocabulary")
    short = second.stored(_kept(lists, each.select("block", "place", "id")), "short")
    first.clear()
    pairs = second.stored(_frequent(_pairs(short), _words(2), least), "pairs")
    every = vocabulary.select(F.array("id").alias("ws"), "f").unionByName(pairs.where("block = first").select(F.array("w1", "w2").alias("ws"), "f"))
    if longest > 2:
        ws = _words(longest)
        longer = _frequent(_longer(short, pairs.select("block", "w1", "w2"), longest), ws, least)
        every = every.unionByName(longer.where("block = first").select(F.array_compact(F.array(*ws)).alias("ws"), "f"))
    every = scratch.stored(every, "every")
    second.clear()
    return vocabulary, every, sizes


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, most: int = 2000, inside_percent: int = 80, scale: int = 2_000_000, block_words: int = 1 << 21) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    vocabulary, every, sizes = phrases(docs, scratch, longest, least, block_words)
    candidates = every.where(F.size("ws") > 1)

    def sub(i, n):
        return F.slice("ws", i, n)

    # what lies inside longer phrases
    shares = []
    for m in range(3, longest + 1):
        inner = F.array(*[sub(i, n) for n in range(2, m) for i in range(1, m - n + 2)])
        shares.append(candidates.where(F.size("ws") == m).select(F.explode(inner).alias("ws"), "f"))
    left = candidates.withColumnRenamed("f", "a")
    if shares:
        longer = shares[0]
        for x in shares[1:]:
            longer = longer.unionByName(x)
        longer = longer.groupBy("ws").agg(F.max("f").alias("f"))
        left = left.join(longer, "ws", "left").where(F.coalesce(100 * F.col("f") < inside_percent * F.col("a"), F.lit(True))).drop("f")
    left = scratch.stored(left, "left")

    # the frequencies of the parts of each cut
    cuts = left.select("ws", "a", F.explode(F.sequence(F.lit(1), F.size("ws") - 1)).alias("k"))
    sides = cuts.select("ws", "a", "k", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.expr("slice(ws, 1, k)").alias("part")), F.struct(F.lit(1).alias("side"), F.expr("slice(ws, k + 1, size(ws) - k)").alias("part")))).alias("x")).select("ws", "a", "k", "x.side", "x.part")
    sides = scratch.stored(sides, "sides")
    known = join_salted(sides, every.withColumnRenamed("ws", "part"), ["part"], hot_keys(sides, ["part"]))
    cut = known.groupBy("ws", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")  # noqa: E731  # products may pass 64 bits
    cut = cut.select("ws", "a", "k", "l", "r", (F.lit(scale).cast("decimal(10,0)") * wide("a")).alias("x"), (wide("l") + wide("r")).alias("y")).withColumn("score", F.expr("x div y"))
    best = cut.groupBy("ws", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select("ws", "a", "best.score", "best.l", "best.r")

    # the words themselves
    spelt = scratch.stored(best.select("ws", F.posexplode("ws").alias("place", "id")), "spelt")
    named = join_salted(spelt, vocabulary.select("id", "lang", "word"), ["id"], hot_keys(spelt, ["id"])).groupBy("ws").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("place", "word"))).alias("at"))
    named = named.select("ws", "lang", F.array_join("at.word", " ").alias("phrase"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    ranked = best.join(named, "ws").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    out = ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    path = fresh_path(spark, "collocations")
    out.write.parquet(path)
    scratch.clear()
    return spark.read.schema(out.schema).parquet(path)
