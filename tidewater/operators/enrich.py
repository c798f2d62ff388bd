"""Enrichment through an external service.

A client is a factory of callables, opened once a task: list of inputs -> list of outputs. Batched
calls send each distinct input once and give its answer to all rows that hold it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Client = Callable[[], Callable[[list[str]], list[int]]]


def lengths_service() -> Callable[[list[str]], list[int]]:
    """A stand-in service: the length of a text."""
    return lambda texts: [len(t) for t in texts]


def enrich(df: DataFrame, column: str, client: Client = lengths_service, batch: int | None = 100, output: str = "output") -> DataFrame:
    """Adds ``output``. batch: the most distinct inputs of a call; None: a call for each row. Null inputs stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = client()
        try:
            for b in batches:
                values = b.column(column).to_pylist()
                if batch is None:
                    answers = [None if v is None else call([v])[0] for v in values]
                else:
                    distinct = list(dict.fromkeys(v for v in values if v is not None))
                    known = {}
                    for i in range(0, len(distinct), batch):
                        known.update(zip(distinct[i : i + batch], call(distinct[i : i + batch]), strict=True))
                    answers = [known.get(v) for v in values]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(answers, pa.int32())], [*b.schema.names, output])
        finally:
            if hasattr(call, "close"):
                call.close()

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return df.mapInArrow(run, ", ".join([*fields, f"`{output}` int"]))


def bucket(word: Column, n: int = 10) -> Column:
    """Bounds parallel calls: rows go to n buckets by hash."""
    return F.pmod(F.hash(word), F.lit(n))


def first_character_bucket(word: Column, n: int = 10) -> Column:
    """The code point of the first character, modulo n; 0 for empty words."""
    return F.pmod(F.coalesce(F.ascii(word), F.lit(0)), F.lit(n))


def enrich_in_buckets(df: DataFrame, column: str, client: Client = lengths_service, batch: int = 100, buckets: int = 10, of: Callable[[Column, int], Column] = bucket) -> DataFrame:
    """At most ``buckets`` tasks call the service at a time."""
    return enrich(df.repartition(buckets, of(F.col(column), buckets)), column, client, batch)


def enrich_distinct(df: DataFrame, column: str, client: Client = lengths_service, batch: int = 100) -> DataFrame:
    """Each distinct value is sent once in the whole job; answers are joined back."""
    answers = enrich(df.select(column).where(F.col(column).isNotNull()).distinct(), column, client, batch)
    return df.join(answers, column, "left")
