"""Tracks: distance and duration of workouts, pieces cut at clock boundaries, and pace alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import distance
from .aggregates import pace
from .ordered import BLOCK, HOT, HOT_ROWS, by, deal, neighbour, parts
from .windowing import WindowSpec, millis

MINUTE = 60_000


def _legs(positions: DataFrame, key: str, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """positions: key, lat, lon, ts (ms). A row for each pair of neighbours in time; of equal times the least (lat, lon) counts.

    One exchange, by key and block, serves the grouping and the neighbours. Of a large table it has a fixed number of partitions
    (``parts``), as a leg may be cut into many pieces, which are then summed in its task.
    """
    plain = positions.select(key, "lat", "lon", "ts")
    dealt, n = deal(plain, (key,), F.col("ts"), hot_rows), parts(plain, hot_rows)
    extra = [c for c in (HOT, BLOCK) if c in dealt.columns]
    once = dealt.repartition(*([n] if n else []), *by(dealt, (key,))).groupBy(key, "ts", *extra).agg(F.min(F.struct("lat", "lon")).alias("p")).select(key, "ts", "p.lat", "p.lon", *extra)
    legs = neighbour(once, (key,), ["ts"], F.struct("lat", "lon", "ts"), "at0").select(key, "ts", "lat", "lon", *[F.col(f"at0.{c}").alias(f"{c}0") for c in ("lat", "lon", "ts")])
    return legs.withColumn("length", distance(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")))


def tracker_metrics(positions: DataFrame, key: str = "key", hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """key, distance (m) and duration (ms) of each workout. A workout of more than hot_rows positions is dealt out to many tasks."""
    return _legs(positions, key, hot_rows).groupBy(key).agg(F.coalesce(F.sum("length"), F.lit(0.0)).alias("distance"), (F.max("ts") - F.min("ts")).alias("duration"))


def tracker_metrics_udaf(positions: DataFrame, key: str = "key", hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """The same through a grouped function that sees a workout's rows, or of a workout of more than hot_rows positions a block of them, for rules that expressions can't state."""
    import numpy as np
    import pandas as pd

    from ..functions.geo import EARTH_RADIUS

    def metrics(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "lat", "lon"], na_position="first").drop_duplicates("ts")
        half = [np.radians(np.diff(pdf[c].to_numpy())) / 2 for c in ("lat", "lon")]
        length = np.nansum(EARTH_RADIUS * np.sqrt(sum((2 * np.sin(h)) ** 2 for h in half)))
        ends = {f"{c}{i}": [pdf[c].iloc[i]] for i in (0, -1) for c in ("lat", "lon")}
        times = [None if pd.isna(t) else int(t) for t in (pdf.ts.min(), pdf.ts.max())]
        return pd.DataFrame({key: pdf[key].iloc[:1].to_list(), BLOCK: pdf[BLOCK].iloc[:1].to_list(), "length": [float(length)], **ends, "low": pd.array(times[:1], "Int64"), "high": pd.array(times[1:], "Int64")})

    kind = positions.schema[key].dataType.simpleString()
    dealt = deal(positions.select(key, "lat", "lon", "ts"), (key,), F.col("ts"), hot_rows)
    if BLOCK not in dealt.columns:
        dealt = dealt.withColumn(BLOCK, F.lit(0))
    schema = f"{key} {kind}, {BLOCK} int, length double, lat0 double, lon0 double, `lat-1` double, `lon-1` double, low long, high long"
    blocks = dealt.select(key, BLOCK, F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), "ts").groupBy(key, BLOCK).applyInPandas(metrics, schema)
    before = Window.partitionBy(key).orderBy(BLOCK)  # one row for each block of a hot key
    carried = distance(F.lag("lat-1").over(before), F.lag("lon-1").over(before), F.col("lat0"), F.col("lon0"))
    joined = blocks.withColumn("carried", F.coalesce(carried, F.lit(0.0)))
    return joined.groupBy(key).agg(F.sum(F.col("length") + F.col("carried")).alias("distance"), (F.max("high") - F.min("low")).alias("duration"))


def pace_line(key: Column, length: Column, millis: Column) -> Column:
    """key, length and pace, tabs between; the pace is time * 1000 / (60 * length), 0 without time."""
    rate = F.when(millis > 0, F.try_divide(millis * 1000, 60.0 * length)).otherwise(F.lit(0.0))
    return F.format_string("%s\t%.3f\t%.3f", key.cast("string"), length, rate)


def to_metric(positions: DataFrame, key: str = "key", unit_ms: int = MINUTE, stamp: str = "end", hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """key, length, duration (ms), ts (ms) of each leg's pieces between unit boundaries, stamped at their end or start."""
    legs = _legs(positions, key, hot_rows).where("ts0 IS NOT NULL AND ts > ts0")
    first, last = F.floor(F.col("ts0") / unit_ms), F.floor((F.col("ts") - 1) / unit_ms)
    pieces = legs.withColumn("unit", F.explode(F.sequence(first, last)))
    start, end = F.greatest("ts0", F.col("unit") * unit_ms), F.least("ts", (F.col("unit") + 1) * unit_ms)
    part = pieces.select(key, "length", (F.col("ts") - F.col("ts0")).alias("whole"), start.alias("start"), end.alias("end"))
    share = F.col("length") * (F.col("end") - F.col("start")) / F.col("whole")
    return part.select(key, share.alias("length"), (F.col("end") - F.col("start")).alias("duration"), F.col(stamp).alias("ts"))


def windowed_pace(metrics: DataFrame, spec: WindowSpec, key: str = "key") -> DataFrame:
    """key, window_end, pace. metrics: key, length, duration, ts (ms)."""
    df = spec.assign(metrics.withColumn("ts", F.timestamp_millis("ts")))
    return df.groupBy(key, "window").agg(pace().alias("pace")).select(key, F.col("window.end").alias("window_end"), "pace")


def paces(metrics: DataFrame, short: str, long: str, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(key, window_end, short_pace) and (key, window_end, long_pace).

    Where the long window is a multiple of the short one, a piece is repeated for each long window that holds it before any exchange: a task
    that has a workout's pieces sums them at once, so about one row a window is exchanged, not one for each short window in it.
    """
    size, n = millis(short), millis(long) // millis(short)
    if millis(long) % size:
        fast, slow = windowed_pace(metrics, WindowSpec(short), key), windowed_pace(metrics, WindowSpec(long, short), key)
        return fast.withColumnRenamed("pace", "short_pace"), slow.withColumnRenamed("pace", "long_pace")
    end = (F.floor(F.col("ts") / size) + 1) * size
    at = F.timestamp_millis("end").alias("window_end")
    ended = metrics.select(key, "length", "duration", end.alias("end"))
    spread = ended.withColumn("end", F.explode(F.sequence(F.col("end"), F.col("end") + (n - 1) * size, F.lit(size))))
    return ended.groupBy(key, at).agg(pace().alias("short_pace")), spread.groupBy(key, at).agg(pace().alias("long_pace"))


def lookup(df: DataFrame, side: DataFrame, on: list[str]) -> DataFrame:
    """df with the columns of the row of ``side`` at its key, or nulls; more than one row at a key is an error."""
    value = [c for c in side.columns if c not in on]
    once = side.groupBy(*on).agg(F.count("*").alias("_rows"), *[F.first(c).alias(c) for c in value])
    twice = F.raise_error(F.concat(F.lit("more than one value for the key "), F.concat_ws(", ", *[F.col(c).cast("string") for c in on])))
    return df.join(once.select(*on, *[F.when(F.col("_rows") > 1, twice).otherwise(F.col(c)).alias(c) for c in value]), on, "left")


def paces_sql(short: str, long: str, key: str = "key") -> str:
    """key, window_end, short_pace, long_pace of {metrics} (key, length, duration, ts), a table or a stream with a watermark: windows, sums and join in one statement.

    The sides meet on the window's end and on its event time, so that a stream's state is bounded.
    """
    span = lambda x: "INTERVAL '{}' {}".format(*x.split())
    sums = "SELECT `{key}`, w, try_divide(SUM(length) * 1000, SUM(duration)) AS {name} FROM (SELECT `{key}`, length, duration, {window} AS w FROM {{metrics}}) GROUP BY `{key}`, w"
    paces = f"SELECT `{{key}}`, w.end AS window_end, window_time(w) AS window_at, {{name}} FROM ({sums})"
    fast = paces.format(key=key, name="short_pace", window=f"TUMBLE(ts, {span(short)})")
    slow = paces.format(key=key, name="long_pace", window=f"HOP(ts, {span(short)}, {span(long)})")
    return f"WITH fast AS ({fast}), slow AS ({slow}) SELECT `{key}`, window_end, short_pace, long_pace FROM fast NATURAL JOIN slow"


def _paces_by_sql(metrics: DataFrame, short: str, long: str, key: str) -> DataFrame:
    from ..plans.sql import run_sql

    return run_sql(metrics.sparkSession, paces_sql(short, long, key), metrics=metrics.withColumn("ts", F.timestamp_millis("ts")))


STRATEGIES = ("side_input", "cogroup", "inner_join", "own_join", "sql")


def alerts(metrics: DataFrame, short: str = "1 minute", long: str = "5 minutes", strategy: str = "inner_join", inclusive: bool = False, key: str = "key") -> DataFrame:
    """key, window_end, ratio, is_up where the short pace leaves (0.9, 1.1) times the long one.

    The long window slides by the short one's size, and its result lies in the short window
    that ends with it, so both meet on the window's end. Strategies give the same
    alerts, but for their guards: side_input asks for a long pace only (a short pace of 0 is
    an alert; a key that stands twice in a window of the side is an error), cogroup, inner_join and
    own_join for both, sql for none but a divisor. sql is one statement, from the windows to the join.
    inclusive: a ratio of exactly 0.9 or 1.1 is an alert too.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {STRATEGIES}")
    ends = [key, "window_end"]
    fast, slow = (df.hint("merge") for df in paces(metrics, short, long, key))  # the planner's estimates don't know how many pieces a leg has
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    if strategy == "side_input":
        both = lookup(fast, slow, ends).withColumn("long_pace", zero("long_pace")).where("long_pace > 0")
    elif strategy == "cogroup":
        both = fast.join(slow, ends, "full").select(*ends, zero("short_pace").alias("short_pace"), zero("long_pace").alias("long_pace")).where("short_pace > 0 AND long_pace > 0")
    elif strategy == "inner_join":
        both = fast.join(slow, ends).where("short_pace > 0 AND long_pace > 0")
    elif strategy == "own_join":  # both sides in one exchange: tagged rows, grouped
        tagged = fast.select(*ends, "short_pace", F.lit(None).cast("double").alias("long_pace")).unionByName(slow.select(*ends, F.lit(None).cast("double").alias("short_pace"), "long_pace"))
        both = tagged.groupBy(*ends).agg(F.max("short_pace").alias("short_pace"), F.max("long_pace").alias("long_pace")).where("short_pace > 0 AND long_pace > 0")
    else:
        both = _paces_by_sql(metrics, short, long, key)
    return out_of_band(both, ends, inclusive)


def out_of_band(both: DataFrame, ends: list[str], inclusive: bool = False) -> DataFrame:
    """The alerts of rows with short_pace and long_pace."""
    ratio = F.try_divide(F.col("short_pace"), F.col("long_pace"))
    inside = (ratio > 0.9) & (ratio < 1.1) if inclusive else (ratio >= 0.9) & (ratio <= 1.1)
    return both.withColumn("ratio", ratio).where(ratio.isNotNull() & ~inside).select(*ends, "ratio", (ratio > 1).alias("is_up"))


#: Messages that consumers of the alerts expect (fixed values).
UP_MESSAGE = "Great job user %s! You are gaining speed!"
DOWN_MESSAGE = "Looks like you are slowing down user %s. Go! Go! Go!"


#: Those of the pipelines written in Python (fixed values).
PY_UP_MESSAGE = "Good job %s, you are gaining speed!"
PY_DOWN_MESSAGE = "Looks like you are slowing down user %s. Go, go, go!"


def notification(key: Column, is_up: Column) -> Column:
    """The message of an alert; the user is the key up to its first colon."""
    user = F.split(key.cast("string"), ":", 2)[0]
    return F.when(is_up, F.format_string(UP_MESSAGE, user)).otherwise(F.format_string(DOWN_MESSAGE, user))


def notification_py(key: Column, is_up: Column) -> Column:
    """The other message, with the key as it is."""
    user = key.cast("string")
    return F.when(is_up, F.format_string(PY_UP_MESSAGE, user)).otherwise(F.format_string(PY_DOWN_MESSAGE, user))
