"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Index. Vectors are turned into integers, floor(scale * x), and dealt into bands by their norm (from
approximate quantiles), greatest first, and a band into cells by its own number of rows, so that vectors of one norm, or repeated ones, fill no cell beyond it. A cell's postings (one for
each vector and component that isn't 0) are stored once, by segments of descending quantised impact
(|value| within a power of 2 of the greatest), each as lists by component; so are the norms of
what a vector still has after each segment. All blocks of queries read that table.

Search. Every query first meets one cell of the greatest norms; its k-th best score there is its
floor. It then goes to the cells of those bands alone whose greatest norm times its own reaches the
floor. In a cell, segments are processed in descending impact: the products of their postings
with the queries are added to exact accumulators. After each segment, what a vector can
still gain or lose is at most the product of the query's norm with the norm of its unprocessed postings,
and at most the query's absolute sum times the impact still to come. A query stops only once this proves
that few vectors can reach both its floor and its k best here; just these are rescored exactly from their whole vectors.
Where that is never proven, all segments are processed and the accumulators are the scores.
The k best of each cell are merged by window. ``proof_report`` tells how often processing stopped on proof.

Cases: vectors that are null, or hold a null or a non-finite component, take no part; vectors of
different lengths are compared on the components both have; a null vec_id takes no part; rows
that repeat an id are separate candidates, but a query is its id's least vector (as text) and
skips all rows of its own id; ties go to the smaller vec_id; fewer candidates than k give
fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LEVELS = 8
BANDS = 32
CELL_ROWS, CELL_QUERIES = 8192, 1024
POSSIBLE = 8  # times k: so few possible members are worth rescoring
#: Segments with postings for at least this share of a cell's places are multiplied as matrices, others list by list.
DENSE = 1 / 32


def usable(v: Column) -> Column:
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))), F.lit(False))


def to_integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    v = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")).cast("long"))
    return vectors.select("vec_id", "embedding").where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", v.alias("v"))


def _matrix(vs: list, width: int) -> np.ndarray:
    out = np.zeros((len(vs), width), np.int64)
    for i, v in enumerate(vs):
        out[i, : len(v)] = v
    return out


class Segment:
    """Postings of one range of impacts: lists of (row, value) by component, the greatest impact still to come and the norms of what is left."""

    def __init__(self, shape: tuple[int, int], starts: np.ndarray, rows: np.ndarray, values: np.ndarray, impact: int, rest: np.ndarray, dtype) -> None:
        self.starts, self.rows, self.values, self.impact, self.rest = starts, rows, values.astype(dtype), impact, rest
        self.matrix = None
        if len(rows) > DENSE * shape[0] * shape[1]:
            self.matrix = np.zeros(shape[::-1], dtype)
            self.matrix[np.repeat(np.arange(shape[1]), np.diff(starts)), rows] = self.values

    def add(self, q: np.ndarray, scores: np.ndarray) -> None:
        """Adds the products of its postings with queries."""
        if self.matrix is not None:
            scores += q @ self.matrix
            return
        for j in np.flatnonzero(np.diff(self.starts)):
            i = slice(self.starts[j], self.starts[j + 1])
            scores[:, self.rows[i]] += q[:, j : j + 1] * self.values[i]


def segments(m: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]]:
    """starts, rows, values, impact and rest of the segments of a block of vectors."""
    size, left, top = np.abs(m), m.astype(np.float64), int(np.abs(m).max(initial=0)) + 1
    for level in range(LEVELS):
        low = 1 if level == LEVELS - 1 else max(top >> 1, 1)
        inside = (size >= low) & (size < top)
        left = np.where(inside, 0, left)
        component, row = np.nonzero(inside.T)
        yield np.searchsorted(component, np.arange(m.shape[1] + 1)), row, m[row, component], low - 1, np.sqrt((left * left).sum(1))
        top = low
        if low == 1:
            return


class Cell:
    """A block of vectors as segments of descending impact."""

    def __init__(self, exact: np.ndarray, ids: np.ndarray, parts: list, dtype) -> None:
        self.exact, self.ids, self.dtype = exact.astype(dtype), ids, dtype
        self.segments = [Segment(exact.shape, *x, dtype) for x in parts]


def best(q: np.ndarray, q_ids: np.ndarray, floors: np.ndarray, cell: Cell, k: int) -> tuple[list[tuple[int, int, int]], int]:
    """(query, row, score) of the k best of each query in a cell, but those that can't reach its floor, and how many queries stopped on proof."""
    norm, total = np.sqrt((q.astype(np.float64) ** 2).sum(1)), np.abs(q.astype(np.float64)).sum(1)
    qd, ids, out, proven = q.astype(cell.dtype), cell.ids, [], 0
    active = np.arange(len(q))
    acc = np.zeros((len(q), len(ids)), cell.dtype)
    own = q_ids[:, None] == ids[None, :]
    k_in = min(k, len(ids))
    for n, s in enumerate(cell.segments):
        s.add(qd[active], acc)
        last = n == len(cell.segments) - 1
        slack = np.zeros((1, 1)) if last else np.minimum(norm[active, None] * s.rest[None, :], (total[active] * s.impact)[:, None]) * (1 + 1e-9)
        low = np.where(own, -np.inf, acc - slack)
        floor = np.maximum(np.partition(low, len(ids) - k_in, axis=1)[:, len(ids) - k_in], floors[active])
        possible = (acc + slack >= floor[:, None]) & ~own
        done = np.full(len(active), True) if last else possible.sum(1) <= POSSIBLE * k
        if not done.any():
            continue
        at, row = np.nonzero(possible & done[:, None])
        scores = acc[at, row] if last else np.einsum("ij,ij->i", qd[active[at]], cell.exact[row])
        scores = np.array([int(x) for x in scores], object) if cell.dtype is object else scores.astype(np.int64)
        order = np.lexsort((ids[row], -scores, at))
        at, row, scores = at[order], row[order], scores[order]
        first = np.arange(len(at)) - np.searchsorted(at, at) < k
        out += zip(active[at[first]].tolist(), row[first].tolist(), map(int, scores[first]), strict=True)
        proven += 0 if last else int(done.sum())
        active, acc, own = active[~done], acc[~done], own[~done]
        if not len(active):
            break
    return out, proven


def index_cell(rows: pa.Table) -> pa.Table:
    """The stored form of a cell: a row with its ids and vectors, and one for each segment."""
    key = {c: rows.column(c)[0].as_py() for c in ("band", "cell")}
    vs = rows.column("v").to_pylist()
    m = _matrix(vs, max(map(len, vs), default=0))
    raw = lambda x, kind: np.ascontiguousarray(x, kind).tobytes()
    out = [(-1, m.shape[1], raw(m, "<i8"), None, None, None)]
    out += [(n, impact, raw(starts, "<i8"), raw(row, "<i4"), raw(value, "<i8"), raw(rest, "<f8")) for n, (starts, row, value, impact, rest) in enumerate(segments(m))]
    cols = list(zip(*out, strict=True))
    ids = pa.array([rows.column("vec_id").to_pylist()] + [None] * (len(out) - 1), pa.list_(rows.schema.field("vec_id").type))
    kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
    return pa.Table.from_arrays([*(pa.array([key[c]] * len(out), pa.int32()) for c in ("band", "cell")), ids, *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], INDEX)


INDEX = ["band", "cell", "ids", "segment", "impact", "starts", "rows", "vals", "rest"]


def search_cell(queries: pa.Table, stored_cell: pa.Table, k: int) -> tuple[list, list, list, int]:
    """query ids, candidate ids and scores of the k best of each query, and how many stopped on proof."""
    parts = sorted(stored_cell.to_pylist(), key=lambda r: r["segment"])
    head, ids = parts[0], np.array(parts[0]["ids"])
    width = head["impact"]
    exact = np.frombuffer(head["starts"], "<i8").reshape(len(ids), width)
    of = lambda r: (np.frombuffer(r["starts"], "<i8"), np.frombuffer(r["rows"], "<i4"), np.frombuffer(r["vals"], "<i8"), r["impact"], np.frombuffer(r["rest"], "<f8"))
    qs, q_ids = [v[:width] for v in queries.column("v").to_pylist()], np.array(queries.column("vec_id").to_pylist())
    q = _matrix(qs, width)
    floors = np.array([-np.inf if x is None else float(x) for x in queries.column("floor").to_pylist()])
    reach = int(np.abs(q).max(initial=0)) * int(np.abs(exact).max(initial=0)) * max(width, 1)
    dtype = np.float32 if reach < 2**24 else np.float64 if reach < 2**53 else object
    found, proven = best(q, q_ids, floors, Cell(exact, ids, list(map(of, parts[1:])), dtype), k)
    return [q_ids[i] for i, _, _ in found], [ids[j] for _, j, _ in found], [s for *_, s in found], proven


class Index:
    """The stored postings of vectors (vec_id, embedding)."""

    def __init__(self, vectors: DataFrame, is_query: Column, scale: int = 256) -> None:
        squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        self.rows = stored(to_integers(vectors, scale).withColumn("norm", F.sqrt(squares)), "vectors")
        at = F.array(*[F.lit(i / BANDS) for i in range(1, BANDS)])
        found = self.rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("queries"), F.max("norm").alias("top"), F.percentile_approx("norm", at, 1000).alias("edges")).first()
        n, self.blocks = found["n"], -(-found["queries"] // CELL_QUERIES) or 1
        edges = sorted(set(found["edges"] or []), reverse=True) if n > CELL_ROWS else []
        band = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e > F.col("norm"))) if edges else F.lit(0)
        banded = self.rows.select("vec_id", "v", "norm", band.cast("int").alias("band"))
        sizes = banded.groupBy("band").agg(F.count("*").alias("n"), F.max("norm").alias("top")).collect() if edges else [found]  # BANDS rows at most
        self.bands = {(r["band"] if edges else 0): (-(-10 * r["n"] // (9 * CELL_ROWS)) or 1, float(r["top"] or 0)) for r in sizes}  # cells (a hash fills them to 9 tenths, so that none passes CELL_ROWS), and the greatest norm
        cells = F.element_at(F.create_map(*[F.lit(x) for b, (c, _) in self.bands.items() for x in (b, c)]), F.col("band"))
        # a row's place in the stored table, so that repeated vectors are dealt out too
        dealt = banded.withColumn("cell", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), cells).cast("int"))
        kind = self.rows.schema["vec_id"].dataType.simpleString()
        self.kind = kind
        schema = f"band int, cell int, ids array<{kind}>, segment int, impact long, starts binary, rows binary, vals binary, rest binary"
        self.postings = stored(dealt.groupBy("band", "cell").applyInArrow(index_cell, schema), "postings")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, vec_id, score of each cell, and rows without a vec_id that tell in score how many queries stopped on proof. queries: vec_id, v, floor, band, cell, block."""
        kind = self.kind

        def cell(q: pa.Table, r: pa.Table) -> pa.Table:
            a, b, c, proven = search_cell(q, r, k) if q.num_rows and r.num_rows else ([], [], [], 0)
            t = q.schema.field("vec_id").type
            return pa.table({"query_id": pa.array([*a, None], t), "vec_id": pa.array([*b, None], t), "score": pa.array([*c, proven], pa.int64())})

        blocks = queries.select(F.col("band").alias("in_band"), F.col("cell").alias("in_cell"), F.col("block").alias("for_block")).distinct()
        postings = self.postings.join(blocks, (F.col("band") == F.col("in_band")) & (F.col("cell") == F.col("in_cell")))  # a cell for each block of queries that reads it
        return queries.groupBy("band", "cell", "block").cogroup(postings.groupBy("in_band", "in_cell", "for_block")).applyInArrow(cell, f"query_id {kind}, vec_id {kind}, score long")


def _searched(vectors: DataFrame, is_query: Column, k: int, scale: int, counted: bool = False) -> tuple[DataFrame, int]:
    """What the cells found, and the number of (query, cell) searches that the bands alone didn't rule out (if ``counted``)."""
    index = Index(vectors, is_query, scale)
    queries = index.rows.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "norm")).alias("q")).select("vec_id", "q.v", "q.norm")
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(index.blocks)).cast("int"))
    start = min(index.bands)
    first = index.search(queries.select("vec_id", "v", F.lit(None).cast("long").alias("floor"), F.lit(start).alias("band"), F.lit(0).alias("cell"), "block"), k)
    first = stored(first, "first")
    if list(index.bands.values())[0][0] == len(index.bands) == 1:
        return first, queries.count() if counted else 0
    # the k-th best of the first cell; fewer there give no floor
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    floors = first.where("vec_id IS NOT NULL").withColumn("place", place).where(F.col("place") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    every = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(c).alias("cells"), F.lit(t).alias("top")) for b, (c, t) in sorted(index.bands.items())])
    may = F.filter(every, lambda t: F.col("floor").isNull() | (F.col("norm") * t["top"] * (1 + 1e-9) >= F.col("floor")))
    rest = queries.join(floors, "vec_id", "left").withColumn("in", F.explode(may))
    rest = rest.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("in.cells") - 1))).withColumn("band", F.col("in.band")).where((F.col("band") > start) | (F.col("cell") > 0))
    rest = stored(rest.select("vec_id", "v", "floor", "band", "cell", "block"), "searches")
    return first.unionByName(index.search(rest, k)), queries.count() + rest.count() if counted else 0


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: a condition on vec_id."""
    found = _searched(vectors, is_query, k, scale)[0].where("vec_id IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def proof_report(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> dict[str, int]:
    """How many searches of a query in a cell there could be, were made, and stopped on proof before the last segment."""
    found, made = _searched(vectors, is_query, k, scale, counted=True)
    index = Index(vectors, is_query, scale)
    m = index.rows.where(is_query).select("vec_id").distinct().count()
    stopped = found.where("vec_id IS NULL").agg(F.sum("score")).first()[0] or 0
    return {"possible": m * sum(c for c, _ in index.bands.values()), "made": made, "stopped": stopped}
