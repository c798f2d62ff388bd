"""Panes of event-time windows: early, on time, late and last ones, accumulating or not, of any aggregate.

Spark's windows give one result, once nothing more may come. Here a window, fixed or sliding, gives a pane when the watermark passes its
end, one for each micro-batch of late rows within the allowed lateness, and is then closed. Rows
of a closed window are dropped. A pane holds what came since the one before, or with ``accumulate`` all of
the window. With ``early``, each micro-batch gives a pane before the end too. ``on_empty`` gives the
pane at the end though nothing came since the last one. What a pane holds is a ``CombineFn``'s: its state is kept for each window.

Spark drops rows by their time, whatever their window, so the watermark of a source is kept behind by the window's
size and the lateness; ``current`` is the watermark that decides here. After an operator in the same plan (``chained``) rows have a clock
as event time (see ``ordered``) and come in the batch whose watermark has passed them. There a row is late if its window
had ended when the key was looked at before.

The global window (no size) has no end in a stream. Its last pane is made when a bounded stream has ended, from the stored
state (``finished_panes``).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.combine import CombineFn
from ..operators.windowing import WindowSpec, millis
from .ordered import times

#: Fields of a window's state before those of the function's: when its latest row was, rows since the last pane, and whether the end has passed.
OWN_STATE = "pane_latest long, pane_fresh long, pane_ended boolean"
NEVER = -(1 << 62)
#: Windows that are stored together: a key's state is read and written by so many.
TOGETHER = 1024


def _fields(fn: CombineFn) -> str:
    """The fields of a window's state, with colons as inside a struct."""
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in StructType.fromDDL(f"{OWN_STATE}, {fn.state}"))


class Panes(StatefulProcessor):
    """Rows of a key: ts_ms and the function's inputs."""

    def __init__(self, spec: WindowSpec, fn: CombineFn, inputs: list[str], early: bool = False, chained: bool = False) -> None:
        self.spec, self.fn, self.inputs, self.early, self.chained = spec, fn, inputs, early, chained
        self.size, self.lateness, self.fields = millis(spec.size), millis(spec.lateness), _fields(fn)
        self.slide = millis(spec.slide or spec.size)
        self.behind = 0 if chained else self.size + self.lateness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getMapState("windows", "slot long", f"windows array<struct<start:long,{self.fields}>>")
        self.seen = handle.getValueState("seen", "mark long, armed long")  # armed: the timer that is set, 0 for none

    def slot(self, start: int) -> int:
        return start // (self.slide * TOGETHER) if self.size else 0

    def stored(self, slot: int) -> dict[int, list]:
        """The states of a slot's windows by their start."""
        return {w[0]: list(w[1:]) for w in self.windows.getValue((slot,))[0]} if self.windows.containsKey((slot,)) else {}

    def store(self, slot: int, held: dict[int, list]) -> None:
        if held:
            self.windows.updateValue((slot,), ([(start, *w) for start, w in sorted(held.items())],))
        elif self.windows.containsKey((slot,)):
            self.windows.removeKey((slot,))

    def due(self, start: int, w: list) -> int:
        """When a window's end passes, or its last late row; timers are on Spark's watermark."""
        return start + self.size + (self.lateness if w[2] else 0) - self.behind

    def arm(self, mark: int, at: int | None, armed: int) -> None:
        """Sets the timer of the first window that is due, and keeps the watermark at which the key was looked at."""
        if at is not None and (not armed or at < armed):
            self.handle.registerTimer(at)
            armed = at
        self.seen.update((mark, armed))

    def current(self, timers) -> int:
        """The watermark; far back as long as there is none."""
        mark = timers.getCurrentWatermarkInMs()
        return mark + self.behind if mark > 0 else NEVER

    def by_window(self, pdf: pd.DataFrame) -> Iterator[tuple[int, int, int, tuple]]:
        """start, latest time, number of rows and state of the rows of each window. Rows are folded by the cells that windows consist of, and cells' states merged."""
        ts = pdf.ts_ms.to_numpy("int64")
        columns = [pdf[c].to_numpy() for c in self.inputs]
        width = math.gcd(self.size, self.slide)
        cell = ts // width * width if self.size else np.zeros_like(ts)
        order = np.argsort(cell, kind="stable")
        at, firsts, counts = np.unique(cell[order], return_index=True, return_counts=True)
        latest = np.maximum.reduceat(ts[order], firsts).tolist()
        states = zip(*(s.tolist() for s in self.fn.fold([c[order] for c in columns], firsts)), strict=True)
        found: dict[int, tuple[int, int, tuple]] = {}
        for c, last, n, state in zip(at.tolist(), latest, counts.tolist(), states, strict=True):
            start = c - c % self.slide if self.size else 0
            while start + self.size > c or not self.size:
                w = found.get(start)
                found[start] = (last, n, state) if w is None else (max(w[0], last), w[1] + n, self.fn.merge(w[2], state))
                if not self.size:
                    break
                start -= self.slide
        return ((start, *w) for start, w in found.items())

    def pane(self, key: tuple, start: int, held: list, kind: str, mark: int) -> tuple:
        end = start + self.size if self.size else None
        latest = held[0]
        stamp = latest if end is None or (self.spec.stamp != "end" and latest is not None) else end - 1
        return key[0], start if self.size else None, end, stamp, kind, self.fn.extract(tuple(held[3:])), max(mark, 0) + 1

    def give(self, key: tuple, start: int, held: list, kind: str, mark: int) -> tuple:
        """The pane of a window, whose state is then as after it."""
        row = self.pane(key, start, held, kind, mark)
        if not self.spec.accumulate:
            held[0], held[3:] = None, self.fn.create()
        held[1], held[2] = 0, held[2] or kind == "on_time"
        return row

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = self.current(timerValues)
        seen, armed = self.seen.get() if self.seen.exists() else (NEVER, 0)
        now = seen if self.chained else mark
        slots: dict[int, dict[int, list]] = {}
        touched: dict[int, list] = {}
        for pdf in rows:
            for start, latest, n, state in self.by_window(pdf) if len(pdf) else ():
                if self.size and start + self.size - 1 + self.lateness < now:
                    continue  # droppable
                if start not in touched:
                    slot = self.slot(start)
                    if slot not in slots:
                        slots[slot] = self.stored(slot)
                    touched[start] = slots[slot].setdefault(start, [None, 0, False, *self.fn.create()])
                w = touched[start]
                w[0] = latest if w[0] is None else max(w[0], latest)
                w[1] += n
                w[3:] = self.fn.merge(tuple(w[3:]), state)
        out = []
        for start, w in touched.items():
            late = bool(self.size) and (w[2] or start + self.size <= now)
            if late and not w[2]:  # the window's end passed before its first row came
                w[2] = True
            if late or self.early:
                out.append(self.give(key, start, w, "late" if late else "early", mark))
        for slot, held in slots.items():
            self.store(slot, held)
        self.arm(mark, min((self.due(s, w) for s, w in touched.items()), default=None) if self.size else None, armed)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out, first = self.current(timerValues), [], None
        for slot, held in sorted((k[0], {w[0]: list(w[1:]) for w in v[0]}) for k, v in self.windows.iterator()):
            before = repr(held)
            for start, w in sorted(held.items()):
                if start + self.size <= now and not w[2]:
                    if w[1] or self.spec.on_empty:
                        out.append(self.give(key, start, w, "on_time", now))
                    w[2] = True
                if start + self.size + self.lateness <= now:
                    del held[start]
                else:
                    first = min(x for x in (first, self.due(start, w)) if x is not None)
            if repr(held) != before:
                self.store(slot, held)
        self.arm(now, first, 0)
        yield self._frame(out)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        if not rows:
            return pd.DataFrame()
        columns = dict(zip(["key", "start", "end", "stamp", "pane", "value", "clock"], zip(*rows, strict=True), strict=True))
        return pd.DataFrame({c: times(v) if c in ("start", "end", "stamp", "clock") else list(v) for c, v in columns.items()})

    def close(self) -> None:
        pass


def panes(rows: DataFrame, spec: WindowSpec, fn: CombineFn, inputs: list[str], delay: str = "0 seconds", early: bool = False, chained: bool = False) -> DataFrame:
    """rows: key, the inputs and ts; or chained, from an operator in this plan, ts_ms and clock. Returns key, start, end, stamp, pane (its kind), value and clock (the event time)."""
    if chained:
        timed = rows.select("key", *inputs, "ts_ms", "clock")
    else:
        behind = millis(delay) + millis(spec.size) + millis(spec.lateness)
        timed = rows.withColumn("ts_ms", F.unix_millis("ts")).select("key", *inputs, "ts_ms", "ts").withWatermark("ts", f"{behind} milliseconds")
    return timed.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Panes(spec, fn, inputs, early, chained),
        outputStructType=f"key string, start timestamp, end timestamp, stamp timestamp, pane string, value {fn.result}, clock timestamp",
        outputMode="Append",
        timeMode="EventTime",
        eventTimeColumnName="clock",
    )


def finished_panes(df: DataFrame, spec: WindowSpec, fn: CombineFn, name: str = "panes") -> DataFrame:
    """Runs ``panes`` of a global window over what is there until it ends, and gives its panes with the last one of each key, made from the state that the query has left.

    The last pane is on time; a key without news since its pane before has one with ``on_empty`` alone.
    """
    from ..sources.sinks import delete, shared_dir

    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(f"{path}-early").awaitTermination()
    state = spark.read.format("statestore").option("stateVarName", "windows").load(f"{path}-state")
    state = state.select(F.col("key.key").alias("key"), F.explode("user_map_value.windows").alias("w")).select("key", "w.*")
    fields = StructType.fromDDL(fn.state).names

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = [fn.extract(tuple(r)) for r in pdf[fields].astype(object).where(pdf[fields].notna(), None).itertuples(index=False)]
            yield pd.DataFrame({"key": pdf.key, "stamp": pdf.stamp, "value": values})

    left = state.where("pane_fresh > 0" if not spec.on_empty else "TRUE").select("key", F.timestamp_millis("pane_latest").alias("stamp"), *fields)
    final = left.mapInPandas(last, f"key string, stamp timestamp, value {fn.result}")
    before = spark.read.schema(df.schema).parquet(f"{path}-early").select("key", "stamp", "pane", "value")
    out = before.unionByName(final.select("key", "stamp", F.lit("on_time").alias("pane"), "value"))
    out.write.parquet(path)
    for used in ("state", "early"):
        delete(spark, f"{path}-{used}")
    return spark.read.schema(out.schema).parquet(path)


class WordStats(CombineFn):
    """Count, mean length and longest of words."""

    state, result = "n long, chars long, longest string", "struct<cnt:long,mean_length:double,longest:string>"

    def create(self) -> tuple:
        return 0, 0, None

    def add(self, state: tuple, *columns: np.ndarray) -> tuple:
        words = columns[0].tolist()
        return self.merge(state, (len(words), sum(map(len, words)), max(words, key=lambda w: (len(w), w))))

    def merge(self, one: tuple, other: tuple) -> tuple:
        longest = max((w for w in (one[2], other[2]) if w is not None), key=lambda w: (len(w), w), default=None)
        return one[0] + other[0], one[1] + other[1], longest

    def extract(self, state: tuple) -> dict:
        return {"cnt": state[0], "mean_length": state[1] / state[0] if state[0] else None, "longest": state[2]}


def word_panes(words: DataFrame, spec: WindowSpec, delay: str = "0 seconds", early: bool = False) -> DataFrame:
    """words: key, word, ts. Returns key, start, end, stamp, cnt, mean_length, longest and the kind of pane."""
    if spec.size is None:
        raise ValueError("panes of words need windows with a size")
    return panes(words, spec, WordStats(), ["word"], delay, early).select("key", "start", "end", "stamp", "value.cnt", "value.mean_length", "value.longest", "pane")
