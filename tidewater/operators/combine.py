"""Aggregates of one's own: create, add, merge and extract, with partial states made before any exchange.

A task folds its rows into one state for each key that it meets, an Arrow batch at a time, so a key with most of
all rows leaves a task as one state (or a few: a task that meets very many keys gives its states out in between). States
travel, not rows. They are merged in rounds: each deals a key's states into fewer parts than the one before, and the
last one into one, so no task merges more than the states of a part. In a task, states come sorted by key
and are merged as they pass: one is held at a time, whatever the number of keys.

The same functions serve streams: ``streaming.panes`` keeps their states for each window.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .ordered import OWN

#: Parts of each round of merging but the last (a key has about one state a task, so of 10,000 tasks 625 states meet in a part); keys whose states a task holds at most before it gives them out.
ROUNDS, MOST_KEYS = (16,), 100_000
ORIGIN, STATE = f"{OWN}origin", f"{OWN}state"


class CombineFn(ABC):
    """What to do with rows of a key. States are tuples with the fields of ``state`` (DDL); merging is associative and commutative."""

    state: str
    result: str

    @abstractmethod
    def create(self) -> tuple: ...

    @abstractmethod
    def add(self, state: tuple, *columns: np.ndarray) -> tuple:
        """columns: the inputs of rows of one key, one row at least; missing numbers are NaN, other missing values None."""

    @abstractmethod
    def merge(self, one: tuple, other: tuple) -> tuple: ...

    @abstractmethod
    def extract(self, state: tuple) -> Any: ...

    # The same for many keys at once. Sorted rows or states stand in runs, which begin at ``starts``; states are columns, one for each field.

    #: Whether states are arrays of numbers without missing ones, for functions that have the three below in numpy; else arrays of objects.
    numeric = False

    def fold(self, columns: list[np.ndarray], starts: np.ndarray) -> list[np.ndarray]:
        ends = [*starts[1:].tolist(), len(columns[0])]
        return _columns([self.add(self.create(), *[c[a:b] for c in columns]) for a, b in zip(starts.tolist(), ends, strict=True)], len(self.create()))

    def gather(self, states: list[np.ndarray], starts: np.ndarray) -> list[np.ndarray]:
        rows = list(zip(*states, strict=True))
        ends = [*starts[1:].tolist(), len(rows)]
        return _columns([reduce(self.merge, rows[a:b]) for a, b in zip(starts.tolist(), ends, strict=True)], len(states))

    def results(self, states: list[np.ndarray]) -> list | pa.Array:
        return [self.extract(s) for s in zip(*states, strict=True)]


def _columns(rows: list[tuple], fields: int) -> list[np.ndarray]:
    out = [np.empty(len(rows), object) for _ in range(fields)]
    for i in range(fields):
        out[i][:] = [r[i] for r in rows]
    return out


def present(column: np.ndarray) -> np.ndarray:
    """The values that aren't missing."""
    return column[~np.isnan(column)] if column.dtype.kind == "f" else column[[x is not None for x in column]] if column.dtype == object else column


class Count(CombineFn):
    """Rows whose input isn't missing."""

    state, result = "n long", "long"

    def create(self) -> tuple:
        return (0,)

    def add(self, state: tuple, *columns: np.ndarray) -> tuple:
        return (state[0] + len(present(columns[0])),)

    def merge(self, one: tuple, other: tuple) -> tuple:
        return (one[0] + other[0],)

    def extract(self, state: tuple) -> int:
        return state[0]


class MeanLength(CombineFn):
    """Mean length of words: NaN for none, as a mean of nothing."""

    state, result = "chars long, words long", "double"

    def create(self) -> tuple:
        return 0, 0

    def add(self, state: tuple, *columns: np.ndarray) -> tuple:
        words = present(columns[0])
        return state[0] + sum(map(len, words)), state[1] + len(words)

    def merge(self, one: tuple, other: tuple) -> tuple:
        return one[0] + other[0], one[1] + other[1]

    def extract(self, state: tuple) -> float:
        return state[0] / state[1] if state[1] else float("nan")


class Longest(CombineFn):
    """The longest word, the greatest of these by code points."""

    state, result = "word string", "string"

    def create(self) -> tuple:
        return (None,)

    def add(self, state: tuple, *columns: np.ndarray) -> tuple:
        return (max((w for w in (state[0], *columns[0]) if w is not None), key=lambda w: (len(w), w), default=None),)

    def merge(self, one: tuple, other: tuple) -> tuple:
        return self.add(one, np.array(other, object))

    def extract(self, state: tuple) -> str | None:
        return state[0]


class Pace(CombineFn):
    """Metres a second of pieces (metres, milliseconds): null without time."""

    state, result = "length double, duration double", "double"

    def create(self) -> tuple:
        return 0.0, 0.0

    def add(self, state: tuple, *columns: np.ndarray) -> tuple:
        return state[0] + float(np.nansum(columns[0])), state[1] + float(np.nansum(columns[1]))

    def merge(self, one: tuple, other: tuple) -> tuple:
        return one[0] + other[0], one[1] + other[1]

    def extract(self, state: tuple) -> float | None:
        return state[0] * 1000 / state[1] if state[1] else None

    numeric = True

    def fold(self, columns: list[np.ndarray], starts: np.ndarray) -> list[np.ndarray]:
        return self.gather([np.nan_to_num(c.astype(float), nan=0.0, posinf=np.inf, neginf=-np.inf) for c in columns], starts)

    def gather(self, states: list[np.ndarray], starts: np.ndarray) -> list[np.ndarray]:
        return [np.add.reduceat(c, starts) if len(starts) else c[:0] for c in states]

    def results(self, states: list[np.ndarray]) -> pa.Array:
        none = states[1] == 0
        return pa.array(states[0] * 1000 / np.where(none, 1.0, states[1]), mask=none)


def numbered(keys: list[pa.Array], rows: int) -> np.ndarray:
    """A number for each row, equal where the keys are; missing keys are equal."""
    out = np.zeros(rows, np.int64)
    for k in keys:
        try:
            codes = k.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        except pa.ArrowNotImplementedError:
            seen: dict = {}
            codes = np.fromiter((seen.setdefault(repr(x), len(seen)) for x in k.to_pylist()), np.int64, rows)
        out = np.unique(out * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)[1]
    return out


class _States:
    """States of keys: a record batch of the keys and of the state's fields."""

    def __init__(self, kind: StructType, keys: int, fn: CombineFn) -> None:
        schema = to_arrow_schema(kind)
        self.keys, self.fn = keys, fn
        self.fields = list(schema.field(STATE).type)
        self.schema = pa.schema([*list(schema)[:keys], *self.fields])

    def batch(self, keys: list[pa.Array], states: list) -> pa.RecordBatch:
        own = [pa.array(s, f.type) for s, f in zip(states, self.fields, strict=True)]
        return pa.RecordBatch.from_arrays([*(k.cast(f.type) for k, f in zip(keys, self.schema, strict=False)), *own], schema=self.schema)

    def columns(self, b: pa.RecordBatch) -> list[np.ndarray]:
        own = b.columns[self.keys :]
        return [c.to_numpy(zero_copy_only=False) for c in own] if self.fn.numeric else _columns(list(zip(*(c.to_pylist() for c in own), strict=True)), len(own))

    def gathered(self, b: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        """States that stand one after the other as one."""
        if len(starts) == b.num_rows:
            return b
        at = pa.array(starts)
        return self.batch([k.take(at) for k in b.columns[: self.keys]], self.fn.gather(self.columns(b), starts))

    def struct(self, b: pa.RecordBatch) -> pa.Array:
        return pa.StructArray.from_arrays(b.columns[self.keys :], fields=self.fields)


def _runs(of: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def partials(df: DataFrame, keys: list[str], fn: CombineFn, inputs: list[str], most_keys: int = MOST_KEYS) -> DataFrame:
    """keys, ORIGIN (the task), STATE: a state for each key and task, without an exchange."""
    kind = StructType([*(df.schema[k] for k in keys), *StructType.fromDDL(f"{ORIGIN} long, {STATE} struct<{fn.state}>")])
    schema, n = to_arrow_schema(kind), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        origin, states = TaskContext.get().partitionId(), _States(kind, n, fn)
        held: pa.RecordBatch | None = None

        def sort(b: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
            of = numbered(b.columns[:n], b.num_rows)
            order = np.argsort(of, kind="stable")
            return b.take(pa.array(order)), _runs(of[order])

        def folded(b: pa.RecordBatch) -> pa.RecordBatch:
            """With what is held."""
            b, starts = sort(b)
            at = pa.array(starts)
            new = states.batch([k.take(at) for k in b.columns[:n]], fn.fold([c.to_numpy(zero_copy_only=False) for c in b.columns[n:]], starts))
            return new if held is None else states.gathered(*sort(_joined([held, new])))

        def given(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*b.columns[:n], pa.array([origin] * b.num_rows, pa.int64()), states.struct(b)], schema=schema)

        for b in together(batches):
            held = folded(b)
            if held.num_rows >= most_keys:
                yield given(held)
                held = None
        if held is not None:
            yield given(held)

    return df.select(*keys, *inputs).mapInArrow(run, kind)


def together(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows, about; none that is empty."""
    waiting: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            waiting.append(b)
        if sum(w.num_rows for w in waiting) >= rows:
            yield _joined(waiting)
            waiting = []
    if waiting:
        yield _joined(waiting)


def _merged(dealt: DataFrame, keys: list[str], fn: CombineFn, result: str | None) -> DataFrame:
    """States of a key that stand one after the other as one, or with ``result`` (a column's name) what is extracted."""
    own = [dealt.schema[k] for k in keys]
    kind = StructType([*own, *(StructType.fromDDL(f"`{result}` {fn.result}") if result else [dealt.schema[ORIGIN], dealt.schema[STATE]])])
    schema, by = to_arrow_schema(kind), keys if result else [*keys, ORIGIN]
    inner = StructType([*(dealt.schema[k] for k in by), dealt.schema[STATE]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = _States(inner, len(by), fn)
        held: pa.RecordBatch | None = None  # the last key's, which may go on

        def given(b: pa.RecordBatch) -> pa.RecordBatch:
            last = pa.array(fn.results(states.columns(b)), schema.field(result).type) if result else states.struct(b)
            return pa.RecordBatch.from_arrays([*b.columns[: len(by)], last], schema=schema)

        for b in together(batches):
            flat = pa.RecordBatch.from_arrays([*(b.column(k) for k in by), *b.column(STATE).flatten()], schema=states.schema)
            both = _joined([flat] if held is None else [held, flat])
            one = states.gathered(both, _runs(numbered(both.columns[: len(by)], both.num_rows)))
            held = one.slice(one.num_rows - 1)
            if one.num_rows > 1:
                yield given(one.slice(0, one.num_rows - 1))
        if held is not None:
            yield given(held)

    return dealt.mapInArrow(run, kind)


def combine(df: DataFrame, keys: list[str], fn: CombineFn, inputs: list[str], name: str, rounds: tuple[int, ...] = ROUNDS, default: bool = False) -> DataFrame:
    """keys and ``name``, what ``fn`` makes of the columns ``inputs`` of each key's rows. Null keys are a key.

    Without keys the result is one row; for no rows none, or with ``default`` that of the created state.
    """
    states = partials(df, keys, fn, inputs)
    for parts in rounds:
        states = states.withColumn(ORIGIN, F.pmod(ORIGIN, F.lit(parts)))
        states = _merged(states.repartition(*keys, ORIGIN).sortWithinPartitions(*keys, ORIGIN), keys, fn, None)
    if keys:
        return _merged(states.repartition(*keys).sortWithinPartitions(*keys), keys, fn, name)
    out = _merged(states.coalesce(1), keys, fn, name)  # as many states as the last round has parts
    if not default:
        return out
    none = df.sparkSession.createDataFrame([(fn.extract(fn.create()),)], out.schema)
    place = f"{OWN}place"
    both = out.withColumn(place, F.lit(0)).unionByName(none.withColumn(place, F.lit(1)))
    return both.orderBy(place).limit(1).drop(place)
