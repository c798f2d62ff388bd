"""N-gram Jaccard join: exact links of word-shingle sets, by a size-aware heavy-light join.

Two sets link when |A and B| >= 0.8 |A or B|, that is 9 |A and B| >= 4 (|A| + |B|).

Order. Shingles are ordered by a sketch of their frequencies over all documents (a fixed
number of counters, rare ones first), then by hash. Any order gives the same links; this
one keeps passages that many documents share out of the signatures. If A and B share o
elements, the (|A| - o + k)-prefixes of both share k.

Light sets (at most ``boundary`` shingles) enumerate all subsets of k = 2 elements of
their prefix; heavy sets scan inverted lists of single elements (k = 1), on which light
sets within the size ratio are entered too. The boundary is where the summed estimated
cost of both is least, taken over the real sets of all documents; ``most_light`` is the
largest one that is tried.

Links. Documents with one set are a class. Each class is first compared with the least
class in each of its lists only (very frequent elements are dealt into salted parts that
are linked through their own least classes), and the links found are contracted to
components. Pairs inside a component can't change it, so of the lists with one least class (their hub)
only pairs of classes in different components are left: those outside the hub's largest
component with each other and with it. They are dealt into blocks of bounded number and bytes, and each
pair of blocks is a cell, where bitmaps bound the symmetric difference from below and the
inverted lists of what is left are scanned, adding up exact overlaps. So a group of near copies
costs about its size, and no link between components is missed.

Lists, hubs, centres and labels that hold many rows are dealt into parts in every join.

A class is told by 128 bits. Signatures carry 64 of them; two classes that share these are both
taken wherever they are looked up, so that a link could be missed only if two of different sets were on one list.

Cases: null, empty and white-space-only texts have the empty set, link with nothing and
are a component each. A row with a null doc_id gets its n_shingles, a null component_id and no links.
Repeated rows are one class; rows that repeat an id with other texts each take part with
theirs, so links are between classes (a node is the representative's id with its class).
``drop_near_duplicates`` compares rows with null ids like all others and leaves one row of each
component, of rows that repeat an id and text, and of equal texts without an id. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, hot_keys, join_salted, leave_one, row_mark, slices, stored
from .components import components
from .shingles import U64, numbers, scramble, shingle_set

WORDS = 5
#: Counters of the frequency sketch, in blocks; its size is fixed whatever the corpus.
SKETCH_BITS, BLOCKS = 20, 256
#: The least size of a bitmap.
BITMAP_LONGS = 16
#: Members of a block of a hub's and the bytes of their sets; two blocks are compared at a time.
CELL, CELL_BYTES = 256, 4 << 20
#: Lists of a cell above this length are counted as a matrix product, of so many lists at a time.
LONG_LIST, COLUMNS = 32, 4096
#: Rows of one list that one task may have to sort before it is salted.
PART = 4096
LEVEL = 1.25


def least_overlap(n):
    """The least overlap with any set that may link: 0.8 n, rounded up."""
    return -(-4 * n // 5)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> U64(64 - SKETCH_BITS)).astype(np.int64)


def _packed(h: np.ndarray) -> bytes:
    """The buckets of a set in three bytes each."""
    return _bucket(h).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    """Hashes with these buckets."""
    parts = np.zeros((len(x) // 3, 4), np.uint8)
    parts[:, :3] = np.frombuffer(x, np.uint8).reshape(-1, 3)
    return parts.view("<i4").ravel().astype(U64) << U64(64 - SKETCH_BITS)


def _class_of(h: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, in any order of its elements."""
    n = np.array([len(h)], U64)
    a = scramble(np.add.reduce(h, keepdims=True) + n)
    b = scramble(np.add.reduce(scramble(h ^ U64(0x5851F42D4C957F2D)), keepdims=True) ^ n)
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def _bitmap(h: np.ndarray) -> np.ndarray:
    """Whether an odd number of elements falls on each bit, so an element that only one of two sets has flips one bit of the difference.

    There is a bit for each element, rounded up to a power of two: sets of any size tell apart what differs by a third. The exclusive or of
    its halves is the bitmap of half the bits; sets within the size ratio have as many bits or twice as many.
    """
    bits = max(BITMAP_LONGS * 64, 1 << (len(h) - 1).bit_length() if len(h) else 1)
    places = (scramble(h) & U64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=bits) & 1 == 1, bitorder="little").view("<i8")


def _sets(docs: DataFrame, most_light: int) -> DataFrame:
    """docs: doc_id, text. A row for each document (doc_id, n, the most bytes of its text, c, cb, bits; the buckets of sets of 2 to most_light) and, for each task, its part of the sketch (block, counts)."""
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in slices(batches):
            n, size, c, cb, bits, buckets = [], [], [], [], [], []
            for text in b.column("text").to_pylist():
                h = shingle_set(text, WORDS)
                n.append(len(h))
                size.append(4 * len(text or ""))
                x, y = _class_of(h)
                c.append(x)
                cb.append(y)
                bits.append(_bitmap(h))
                np.add.at(sketch, _bucket(h), 1)
                buckets.append(_packed(h) if 2 <= len(h) <= most_light else None)
            rows = len(n)
            ints = lambda x: pa.array(x, pa.int64())
            bitmaps = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, bits)]), pa.int32()), ints(np.concatenate(bits) if bits else []))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ints(n), ints(size), ints(c), ints(cb), bitmaps, pa.array(buckets, pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], SET_COLUMNS)
        parts = [zlib.compress(x.tobytes(), 1) for x in sketch.reshape(BLOCKS, -1)]
        nulls = lambda kind: pa.nulls(BLOCKS, kind)
        yield pa.RecordBatch.from_arrays([nulls(_arrow(id_type)), nulls(pa.int64()), nulls(pa.int64()), nulls(pa.int64()), nulls(pa.int64()), nulls(pa.list_(pa.int64())), nulls(pa.binary()), pa.array(range(BLOCKS), pa.int32()), pa.array(parts, pa.binary())], SET_COLUMNS)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type.simpleString()}, n long, size long, c long, cb long, bits array<long>, buckets binary, block int, counts binary")


SET_COLUMNS = ["doc_id", "n", "size", "c", "cb", "bits", "buckets", "block", "counts"]


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _levels(sets: DataFrame) -> tuple[np.ndarray, int]:
    """The summed sketch as levels on a logarithmic scale, a byte each, and its total."""

    def add(key, batches):
        total = np.zeros((1 << SKETCH_BITS) // BLOCKS, np.int64)
        for b in batches:
            for x in b.column("counts").to_pylist():
                total += np.frombuffer(zlib.decompress(x), np.int64)
        level = np.ceil(np.log(np.maximum(total, 1)) / np.log(LEVEL))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.minimum(level, 255).astype(np.uint8).tobytes()], pa.binary()), pa.array([int(total.sum())], pa.int64())], ["block", "levels", "total"])

    got = sets.where("block IS NOT NULL").select("block", "counts").groupBy("block").applyInArrow(_streamed(add), "block int, levels binary, total long").collect()
    levels = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in got:
        at = (1 << SKETCH_BITS) // BLOCKS
        levels[r["block"] * at : (r["block"] + 1) * at] = np.frombuffer(r["levels"], np.uint8)
    return levels, sum(r["total"] for r in got)


def _streamed(f):
    """applyInArrow hands a function with (key, iterator) hints the group's batches one by one."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(key, batches)

    return run


class Signer:
    """Prefixes and signatures under one order."""

    def __init__(self, levels: np.ndarray, total: int) -> None:
        self.levels, self.noise = levels, total / len(levels)

    def prefix(self, h: np.ndarray, more: int) -> tuple[np.ndarray, np.ndarray]:
        """The first |A| - 0.8 |A| + more elements and their estimated frequencies."""
        level = self.levels[_bucket(h)]
        order = np.argsort((level.astype(U64) << U64(56)) | (h >> U64(8)), kind="stable")[: len(h) - least_overlap(len(h)) + more]
        return h[order], np.maximum(LEVEL ** level[order].astype(float) - 2 * self.noise, 1.0)

    def singles(self, h: np.ndarray):
        """(key, bound on the overlap from here on, estimated rows of the list)"""
        if len(h) < 2:  # a set of one links with its equals only
            return np.empty(0, U64), np.empty(0, np.int64), np.empty(0)
        e, f = self.prefix(h, 1)
        return e, len(h) - np.arange(len(e)), f

    def pairs(self, h: np.ndarray):
        if len(h) < 2:
            return np.empty(0, U64), np.empty(0, np.int64), np.empty(0)
        e, f = self.prefix(h, 2)
        i, j = np.triu_indices(len(e), 1)
        return scramble(e[i] * PAIR[0] + e[j] * PAIR[1]), len(h) - j + 1, np.minimum(f[i], f[j])


PAIR = numbers(5, 2) | U64(1)


def _costs(sets: DataFrame, signer, most_light: int) -> dict[int, tuple[float, float]]:
    """For each size up to most_light, the summed cost of singles and of pairs over all sets of it: a row each, and the list that is scanned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign, cost = signer.value, np.zeros((most_light + 1, 2))
        for b in slices(batches):
            for x in b.column("buckets").to_pylist():
                f = sign.singles(_unpacked(x))[2]  # the estimates depend on the buckets alone
                m = len(f) + 1
                cost[len(x) // 3] += len(f) + f.sum(), m * (m - 1) / 2 * 2
        at = np.flatnonzero(cost.sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(cost[at, 0]), pa.array(cost[at, 1])], ["n", "single", "pair"])

    each = sets.where("buckets IS NOT NULL").select("buckets").mapInArrow(run, "n long, single double, pair double")
    got = each.groupBy("n").agg(F.sum("single").alias("single"), F.sum("pair").alias("pair")).collect()  # most_light rows
    return {r["n"]: (r["single"], r["pair"]) for r in got}


def choose_boundary(costs: dict[int, tuple[float, float]], most_light: int = 200) -> int:
    """The boundary of least summed cost. Light sets above 0.8 of it are in the lists of single elements too."""

    def total(b: int) -> float:
        return sum((pair if n <= b else 0) + (single if 5 * n >= 4 * (b + 1) else 0) for n, (single, pair) in costs.items())

    return min(range(most_light + 1), key=total)


def _signatures(docs: DataFrame, signer, boundary: int) -> DataFrame:
    """key, salt, c, n, bound. A class that a task has signed before is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign, seen = signer.value, set()
        for b in slices(batches):
            out = []
            for text in b.column("text").to_pylist():
                h = shingle_set(text, WORDS)
                if len(h) < 2 or (whole := _class_of(h)) in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(whole)
                c = whole[0]
                n = len(h)
                kinds = [sign.pairs(h)] if n <= boundary else []
                if 5 * n >= 4 * (boundary + 1):
                    kinds.append(sign.singles(h))
                for key, bound, rows in kinds:
                    parts = np.ceil(rows / PART).astype(np.int64)
                    out.append((key.view(np.int64), np.where(parts > 1, (c % parts) + 1, 0), np.full(len(key), c), np.full(len(key), n), bound))
            if out:
                for i in range(0, len(out), 2000):
                    cols = [np.concatenate(x) for x in zip(*out[i : i + 2000], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in zip(cols, ("i8", "i4", "i8", "i4", "i4"), strict=True)], ["key", "salt", "c", "n", "bound"])

    return docs.select("text").mapInArrow(run, "key long, salt int, c long, n int, bound int")


def _possible(na, nb, ba, bb) -> Column:
    """By sizes, and by what may still follow the common element."""
    return (5 * F.least(na, nb) >= 4 * F.greatest(na, nb)) & (9 * F.least(ba, bb) >= 4 * (na + nb))


def _linked(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs: a, b (classes within the size ratio; few b may be in most pairs). The pairs of their representatives (u, v) that link, by bitmaps and then by the texts, stored."""
    scratch = Scratch(pairs.sparkSession)
    side = lambda x: classes.select(F.col("c").alias(x), F.col("cb").alias(f"cb_{x}"), F.col("n").alias(f"n_{x}"), F.col("rep").alias(f"rep_{x}"), F.col("bits").alias(f"bits_{x}"))
    half = lambda x, y: F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, F.lit(1), F.size(y)), F.slice(x, F.size(y) + 1, F.size(y)), lambda s, t: s.bitwiseXOR(t))).otherwise(F.col(x))
    apart = F.aggregate(F.zip_with(half("bits_a", "bits_b"), half("bits_b", "bits_a"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    pairs = scratch.stored(pairs, "pairs")
    left = join_salted(pairs, side("b"), ["b"], hot_keys(pairs, ["b"])).join(side("a"), "a").where(9 * (F.col("n_a") + F.col("n_b") - apart) >= 8 * (F.col("n_a") + F.col("n_b")))
    left = scratch.stored(left.select("a", "cb_a", "rep_a", "b", "cb_b", "rep_b"), "left")
    text = lambda x: texts.select(F.col("c").alias(x), F.col("cb").alias(f"cb_{x}"), F.col("text").alias(f"text_{x}"))
    both = join_salted(left, text("b"), ["b", "cb_b"], hot_keys(left, ["b", "cb_b"])).join(text("a"), ["a", "cb_a"])
    id_type = classes.schema["rep"].dataType.simpleString()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches, 256):
            good, last, h = [], None, None
            for i, (s, t) in enumerate(zip(x.column("text_a").to_pylist(), x.column("text_b").to_pylist(), strict=True)):
                g = shingle_set(s, WORDS)
                if t != last:
                    last, h = t, shingle_set(t, WORDS)
                if 9 * len(np.intersect1d(g, h, assume_unique=True)) >= 4 * (len(g) + len(h)):
                    good.append(i)
            at = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([x.column("rep_a").take(at), x.column("rep_b").take(at)], ["u", "v"])

    links = stored(both.select("rep_a", "rep_b", "text_a", "text_b").mapInArrow(check, f"u {id_type}, v {id_type}"), "links")
    scratch.clear()
    return links


def near_duplicate_components(docs: DataFrame, most_light: int = 200) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; a component is what links reach, named by its least doc_id."""
    return _named(docs.select("doc_id", "text"), most_light)


def _named(docs: DataFrame, most_light: int) -> DataFrame:
    """docs: doc_id, text."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark)
    sets = stored(_sets(docs, most_light), "sets")
    members = sets.where("block IS NULL").select("doc_id", "n", "c", "cb")
    signer = spark.sparkContext.broadcast(Signer(*_levels(sets)))  # a byte for each counter
    boundary = choose_boundary(_costs(sets, signer, most_light), most_light)

    group = Window.partitionBy("key", "salt")
    first = F.min(F.struct("c", "n", "bound")).over(group)
    shared = (
        _signatures(docs, signer, boundary)
        .select("*", first.alias("first"), F.max("c").over(group).alias("last"))
        .where("first.c <> last OR salt > 0")
        .select("key", "salt", "c", "n", "bound", F.col("first.c").alias("fc"), F.col("first.n").alias("fn"), F.col("first.bound").alias("fb"))
    )
    lists = Scratch(spark)
    shared = lists.stored(shared, "shared")
    signed = scratch.stored(shared.select("c").distinct(), "signed")
    classes = (
        sets.where("block IS NULL AND doc_id IS NOT NULL AND n > 1")
        .join(signed, "c", "left_semi")
        .groupBy("c", "cb")
        .agg(F.min("doc_id").alias("id"), F.first("n").cast("int").alias("n"), F.max("size").alias("size"), F.first("bits").alias("bits"))
        .select("c", "cb", F.struct("id", "c", "cb").alias("rep"), "n", "size", "bits")
    )
    classes = scratch.stored(classes, "classes")
    texts = scratch.stored(_texts(docs, classes), "texts")

    least = Window.partitionBy("key")
    over_parts = shared.where("salt > 0").select("key", F.col("fc").alias("c"), F.col("fn").alias("n"), F.col("fb").alias("bound")).distinct()
    over_parts = over_parts.withColumn("f", F.min(F.struct("c", "n", "bound")).over(least)).select("c", "n", "bound", F.col("f.c").alias("fc"), F.col("f.n").alias("fn"), F.col("f.bound").alias("fb"))
    stars = shared.select("c", "n", "bound", "fc", "fn", "fb").unionByName(over_parts)
    stars = stars.where((F.col("c") != F.col("fc")) & _possible(F.col("n"), F.col("fn"), F.col("bound"), F.col("fb"))).select(F.col("c").alias("a"), F.col("fc").alias("b")).distinct()
    links = _linked(stars, classes, texts)
    labels = components(links)

    held = _members(shared, classes, labels, scratch)
    lists.clear()
    more = scratch.stored(_across(held, classes, texts, scratch), "more")
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    named = classes.join(labels, classes["rep"] == labels["node"], "left").select("c", "cb", F.coalesce("label", "rep")["id"].alias("component_id"))
    # classes that share no list: all their documents have one set
    alone = members.join(signed, "c", "left_anti").where("n > 0 AND doc_id IS NOT NULL").groupBy("c", "cb").agg(F.min("doc_id").alias("component_id"))
    named = stored(named.unionByName(alone), "named")
    scratch.clear()
    some = members.where("n > 0 AND doc_id IS NOT NULL")
    found = join_salted(some, named, ["c", "cb"], hot_keys(some, ["c", "cb"])).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return found.unionByName(members.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).alias("component_id")))


def _texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """c, cb, text of each class, fetched by its representative's id; where ids are repeated, by id and class, which each row gives once."""
    wanted = classes.select(F.col("rep.id").alias("_rep"), "c", "cb").hint("merge")  # grows with docs: one plan at every size
    if not _repeats(docs):
        return docs.join(wanted, docs["doc_id"] == wanted["_rep"]).select("text", "c", "cb")

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            c = [_class_of(shingle_set(t, WORDS)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in c], pa.int64()), pa.array([y for _, y in c], pa.int64())], ["_rep", "text", "c", "cb"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(classed, f"_rep {kind}, text string, c long, cb long")
    once = rows.groupBy("_rep", "c", "cb").agg(F.first("text").alias("text"))
    return once.join(wanted, ["_rep", "c", "cb"]).select("text", "c", "cb")


def _repeats(docs: DataFrame) -> bool:
    """Whether any document id stands in more than one row."""
    return not docs.select("doc_id").where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()


def _members(shared: DataFrame, classes: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """hub and class (c, cb, label lc and lcb, n, size, bits) of what lists of several labels hold.

    A list's hub is its least class. Classes that share a list share its hub, so it is enough to
    compare the members of each hub, once for all its lists; lists of a hub and one more class
    were compared before.
    """
    dealt = shared.where("salt > 0").select("key", "c", "fc")
    parts = dealt.groupBy("key").agg(F.min("fc").alias("hub"))
    hot = hot_keys(dealt, ["key"])  # lists that aren't in parts are of bounded length
    rows = shared.where("salt = 0").select("key", "c", F.col("fc").alias("hub")).unionByName(join_salted(dealt, parts, ["key"], hot).select("key", "c", "hub"))
    of = classes.join(labels, classes["rep"] == labels["node"], "left").select("c", "cb", "rep", F.coalesce("label", "rep").alias("label"), "n", "size", "bits")
    of = scratch.stored(of.select("c", "cb", F.col("label.c").alias("lc"), F.col("label.cb").alias("lcb"), "n", "size", "bits"), "of")
    edges = [F.min("lc").alias("x"), F.max("lc").alias("y"), F.min("lcb").alias("xb"), F.max("lcb").alias("yb")]
    lists = rows.join(of.select("c", "lc", "lcb"), "c").groupBy("key").agg(*edges, F.min(F.when(F.col("c") != F.col("hub"), F.col("c"))).alias("p"), F.max("c").alias("q"))
    mixed = scratch.stored(lists.where("(x <> y OR xb <> yb) AND p <> q").select("key"), "mixed")
    members = join_salted(rows, mixed, ["key"], hot).select("hub", "c").distinct()
    return scratch.stored(members.join(of, "c"), "members")


def _across(members: DataFrame, classes: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (u, v) between components, enough to connect all that are linked.

    Members outside the hub's largest component (blocks 0 to others - 1) meet each other and those inside
    (the blocks from others on), which don't meet among themselves. A cell first drops members
    that can link with no other one by label, size and bitmap.
    """
    by_label = members.groupBy("hub", "lc", "lcb").agg(F.count("*").alias("k"), F.sum(F.greatest("size", 8 * F.col("n"))).alias("n"))
    most = F.max(F.struct("k", "n", "lc", "lcb")).alias("most")
    hubs = by_label.groupBy("hub").agg(F.sum("k").alias("rows"), F.sum("n").alias("n"), most).where("rows > most.k")
    blocks = lambda k, n: F.ceil(F.greatest(k / F.lit(CELL), n / F.lit(CELL_BYTES))).cast("int")
    hubs = hubs.select("hub", "rows", "most.lc", "most.lcb", blocks(F.col("rows") - F.col("most.k"), F.col("n") - F.col("most.n")).alias("others"), blocks(F.col("most.k"), F.col("most.n")).alias("inside"))
    hubs = scratch.stored(hubs.withColumnsRenamed({"lc": "mc", "lcb": "mcb"}), "hubs")
    met = join_salted(members, hubs.drop("rows"), ["hub"], hot_keys(members, ["hub"], hubs))
    hash_, within = F.xxhash64("c", "cb"), (F.col("lc") == F.col("mc")) & (F.col("lcb") == F.col("mcb"))
    met = met.withColumn("block", F.when(within, F.col("others") + F.pmod(hash_, "inside")).otherwise(F.pmod(hash_, "others")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(within, F.col("others")).otherwise(F.col("others") + F.col("inside")) - 1)))
    met = met.select("hub", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "c", "cb", "n", "lc", "lcb", "bits")
    # few bytes, much work: as many tasks as the cluster is set to, where adaptive execution would merge them by size
    met = met.repartition(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), "hub", "i", "j")
    may = scratch.stored(met.groupBy("hub", "i", "j").applyInArrow(_possible_members, "hub long, i int, j int, c long, cb long"), "possible")
    of = members.select("c", "cb", "lc", "lcb").dropDuplicates(["c", "cb"]).join(classes.select("c", "cb", "rep"), ["c", "cb"])
    cells = may.join(of, ["c", "cb"]).join(texts, ["c", "cb"]).select("hub", "i", "j", "rep", "lc", "lcb", "text")
    kind = classes.schema["rep"].dataType.simpleString()
    return cells.groupBy("hub", "i", "j").applyInArrow(_cell_links, f"u {kind}, v {kind}").distinct()


def _labels(cell: pa.Table) -> np.ndarray:
    """A number for each label."""
    both = np.stack([cell.column(x).to_numpy() for x in ("lc", "lcb")], 1)
    return np.unique(both, axis=0, return_inverse=True)[1].ravel()


def _possible_members(cell: pa.Table) -> pa.Table:
    """The members of a cell that may link with one of another label, by size ratio and the bitmaps' bound."""
    i, j = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
    n, block = cell.column("n").to_numpy(), cell.column("block").to_numpy()
    label = _labels(cell)
    bits = cell.column("bits").combine_chunks()
    width = bits.value_lengths().to_numpy(zero_copy_only=False)
    start, longs = np.cumsum(width) - width, bits.flatten().to_numpy(zero_copy_only=False).view(U64)
    good = np.zeros(len(n), bool)
    for w in np.unique(width):  # with those of twice the width, which are folded
        own, wide = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        at = np.concatenate((own, wide))
        maps = np.concatenate((longs[start[own, None] + np.arange(w)], np.bitwise_xor.reduce(longs[start[wide, None] + np.arange(2 * w)].reshape(-1, 2, w), axis=1)))
        left, right = np.flatnonzero(block[at] == i), np.flatnonzero(block[at] == j)
        for k in range(0, len(left), 16):
            x, y = at[left[k : k + 16]], at[right]
            both = n[x, None].astype(np.int64) + n[None, y]
            apart = np.bitwise_count(maps[left[k : k + 16], None, :] ^ maps[None, right, :]).sum(2, dtype=np.int64)
            may = (9 * (both - apart) >= 8 * both) & (label[x, None] != label[None, y])
            may &= (5 * np.minimum(n[x, None], n[None, y]) >= 4 * np.maximum(n[x, None], n[None, y])) & ((width[x, None] == w) | (width[None, y] == w))
            good[x] |= may.any(1)
            good[y] |= may.any(0)
    return cell.select(["hub", "i", "j", "c", "cb"]).filter(pa.array(good))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The overlap of each two sets, by a scan of their inverted lists: short lists add one to each of their pairs, long ones are multiplied as matrices."""
    k, sizes = len(sets), np.array([len(h) for h in sets])
    _, element, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(k), sizes)[np.argsort(element, kind="stable")]
    start = np.cumsum(count) - count
    total = np.zeros((k, k), np.float32)
    for length in np.unique(count[(count > 1) & (count <= LONG_LIST)]):
        lists = owner[start[count == length][:, None] + np.arange(length)]  # owners rise along a list
        for x, y in zip(*np.triu_indices(length, 1), strict=True):
            np.add.at(total, (lists[:, x], lists[:, y]), 1)
    long = np.flatnonzero(count > LONG_LIST)
    for i in range(0, len(long), COLUMNS):
        at = long[i : i + COLUMNS]
        has = np.zeros((k, len(at)), np.float32)
        column = np.repeat(np.arange(len(at)), count[at])
        place = np.repeat(start[at], count[at]) + np.arange(len(column)) - np.repeat(np.cumsum(count[at]) - count[at], count[at])
        has[owner[place], column] = 1
        total += np.triu(has @ has.T, 1)
    return total


def _cell_links(cell: pa.Table) -> pa.Table:
    """Of the links of a cell, as many as connect what they connect."""
    sets = [shingle_set(t, WORDS) for t in cell.column("text").to_pylist()]
    label = _labels(cell)
    sizes = np.array([len(h) for h in sets])
    x, y = np.nonzero((9 * overlaps(sets) >= 4 * (sizes[:, None] + sizes[None, :])) & (label[:, None] != label[None, :]))
    root = list(range(int(label.max()) + 1))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    links = []
    for k in range(len(x)):
        s, t = find(label[x[k]]), find(label[y[k]])
        if s != t:
            root[t] = s
            links.append(k)
    rep = cell.column("rep")
    return pa.table({"u": rep.take(pa.array(x[links], pa.int64())), "v": rep.take(pa.array(y[links], pa.int64()))})


def drop_near_duplicates(docs: DataFrame, most_light: int = 200) -> DataFrame:
    """One row of each component with all columns, that of the least id (a null one last) and then the least hash of the text.

    Rows with the same id and text, or without an id and with the same text, are one document: of these the row of least hash stays.
    """
    mark = row_mark(docs["doc_id"], docs.schema["doc_id"].dataType, F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")))))
    found = stored(_named(docs.select(mark.alias("doc_id"), "text"), most_light).select(F.col("doc_id").alias("mark"), "component_id"), "found")
    return leave_one(docs, mark, found.where("component_id <> mark").select("mark"), found)
