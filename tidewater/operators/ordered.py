"""Running results and neighbours along an order, for keys of any size.

A window over a key's rows puts them all in one task. Here a key with more than ``hot_rows`` rows is
dealt into blocks of consecutive rows; windows run within blocks, and what a block needs from
those before it comes from a table with one row for each block of a hot key.

Hot keys are the ``MOST_HOT`` of most rows above ``hot_rows``. So their table, which is broadcast, has a
fixed bound, and a key that isn't in it has at most total / MOST_HOT rows or ``hot_rows``: a fair task.
Only the layout depends on this; results are the same for any ``hot_rows``, and for None, which leaves it out.
So does a table whose size, as the planner estimates it, is below ``ROW_BYTES`` for each of hot_rows rows.
"""

from __future__ import annotations

from pyspark.errors import PySparkAttributeError
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS, MOST_HOT, ROW_BYTES = 1 << 20, 10_000, 8
#: Of ``parts``: estimated bytes of a partition, and the estimate from which on the planner doesn't know.
PART_BYTES, UNKNOWN = 1 << 17, 1 << 42
#: Prefix of the names of helper columns; no column of a user's may begin with it.
OWN = "__tidewater_"
HOT, BLOCK = f"{OWN}hot", f"{OWN}block"
KEY, ROWS, LOW, HIGH, AT, OF, EDGE, ORDER = (f"{OWN}{x}" for x in ("key", "rows", "low", "high", "at", "of", "edge", "order"))


def _on(per: tuple[str, ...]) -> Column:
    on = F.lit(True)
    for i, k in enumerate(per):
        on = on & F.col(k).eqNullSafe(F.col(f"{KEY}{i}"))
    return on


def _keys(per: tuple[str, ...]) -> list[Column]:
    return [F.col(k).alias(f"{KEY}{i}") for i, k in enumerate(per)]


def _estimated_bytes(df: DataFrame) -> int | None:
    """The planner's estimate; None where it isn't to be had, as in remote sessions."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    except (AttributeError, PySparkAttributeError):
        return None


def deal(df: DataFrame, per: tuple[str, ...], order: Column, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Adds HOT and BLOCK, which grows with ``order`` (a number; null comes first) and is 0 for keys that aren't hot; or nothing, see above."""
    if hot_rows is None or ((size := _estimated_bytes(df)) is not None and size < ROW_BYTES * hot_rows):
        return df
    counts = df.select(*_keys(per), order.alias(AT)).groupBy(*[f"{KEY}{i}" for i in range(len(per))]).agg(F.count("*").alias(ROWS), F.min(AT).alias(LOW), F.max(AT).alias(HIGH))
    hot = counts.where(F.col(ROWS) > hot_rows).orderBy(F.col(ROWS).desc()).limit(MOST_HOT)
    blocks = F.ceil(F.col(ROWS) / hot_rows)
    share = (order - F.col(LOW)) / (F.col(HIGH) - F.col(LOW) + 1)
    block = F.when(share.isNull(), F.lit(0)).otherwise(F.least(F.floor(share * blocks), blocks - 1))  # least would skip the null
    out = df.join(F.broadcast(hot), _on(per), "left").withColumn(HOT, F.col(ROWS).isNotNull()).withColumn(BLOCK, F.coalesce(block, F.lit(0)).cast("int"))
    return out.select(*df.columns, HOT, BLOCK)


def parts(df: DataFrame, hot_rows: int | None = HOT_ROWS) -> int | None:
    """Partitions for rows of which each becomes many in its task: in proportion to the planner's estimate, as the rows' own bytes say too little; None for a table that ``deal`` leaves as it is."""
    size = _estimated_bytes(df)
    if hot_rows is None or size is None or size < ROW_BYTES * hot_rows:
        return None
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if size >= UNKNOWN else max(least, -(-size // PART_BYTES))


def by(df: DataFrame, per: tuple[str, ...]) -> tuple[str, ...]:
    """What rows that ``deal`` gave are to be partitioned by."""
    return (*per, BLOCK) if BLOCK in df.columns else per


def _with_carried(dealt: DataFrame, per: tuple[str, ...], sums: dict[str, Column], over, first: Column) -> DataFrame:
    """Adds, for blocks of hot keys, ``over`` of each sum over the blocks before (in the order ``first``)."""
    keys = [f"{KEY}{i}" for i in range(len(per))]
    w = Window.partitionBy(*keys).orderBy(first).rowsBetween(Window.unboundedPreceding, -1)
    table = dealt.where(HOT).select("*", *_keys(per), F.col(BLOCK).alias(OF)).groupBy(*keys, OF).agg(*[c.alias(k) for k, c in sums.items()])
    table = table.select(*keys, OF, *[over(k).over(w).alias(k) for k in sums])
    return dealt.join(table, _on(per) & (F.col(BLOCK) == F.col(OF)), "left").select(*dealt.columns, *sums)


def running(df: DataFrame, per: tuple[str, ...], order: list[Column], inclusive: bool = True, hot_rows: int | None = HOT_ROWS, **measures: tuple[str, Column]) -> DataFrame:
    """Adds each measure, ("max" or "sum", column), over the rows of the key so far; without the row itself unless ``inclusive``.

    order: the first is a number or a timestamp, and decides the block.
    """
    at, mine = order[0], lambda k: f"{OWN}of_{k}"
    dealt = deal(df.select("*", *[c.alias(mine(k)) for k, (_, c) in measures.items()], _number(df, at).alias(ORDER)), per, F.col(ORDER), hot_rows)
    so_far = Window.partitionBy(*by(dealt, per)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out, earlier = dealt, lambda k: f"{OWN}before_{k}"
    for kind, op in (("max", F.max), ("sum", F.sum)):
        names = [k for k, (x, _) in measures.items() if x == kind]
        if names and BLOCK in dealt.columns:
            out = _with_carried(out, per, {earlier(k): op(mine(k)) for k in names}, op, F.col(OF).asc())
    results = []
    for k, (kind, _) in measures.items():
        here = (F.max if kind == "max" else F.sum)(mine(k)).over(so_far)
        if BLOCK in dealt.columns:
            before = F.col(earlier(k))
            here = F.greatest(here, before) if kind == "max" else F.coalesce(here + before, here, before)
        results.append(here.alias(k))
    return out.select(*df.columns, *results)


def _number(df: DataFrame, at: Column) -> Column:
    kind = df.select(at.alias("x")).schema["x"].dataType.typeName()
    return F.unix_micros(at.cast("timestamp")) if kind.startswith("timestamp") else at


def neighbour(dealt: DataFrame, per: tuple[str, ...], order: list[str], value: Column, name: str, ahead: bool = False) -> DataFrame:
    """Adds ``name``, the value at the row before (or ahead) in its key; null where there is none. ``dealt`` comes from ``deal`` by the first of ``order``."""
    w = Window.partitionBy(*by(dealt, per)).orderBy(*order)
    near = F.lead if ahead else F.lag
    if BLOCK not in dealt.columns:
        return dealt.withColumn(name, near(value).over(w))
    edge = (F.min_by if ahead else F.max_by)(EDGE, F.struct(*order))
    blocks = F.col(OF).desc() if ahead else F.col(OF).asc()
    carried = f"{EDGE}_carried"
    rows = _with_carried(dealt.withColumn(EDGE, F.struct(value.alias("v"))), per, {carried: edge}, lambda k: F.last(k, ignorenulls=True), blocks)
    return rows.select(*dealt.columns, F.coalesce(near(EDGE).over(w), F.col(carried))["v"].alias(name))
