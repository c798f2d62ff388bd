"""The queries of the library over the driver's tables, with their SQL for DuckDB.

Lines are texts of documents or conversations; timed words are event types; a workout is an
event's user, its position made from the event's value and id. Events span a month, so paces
use windows of one and five hours.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import aggregates as A
from .operators import changelog_join as C
from .operators import combine as X
from .operators import enrich as E
from .operators import late_split as L
from .operators import ordered as O
from .operators import pi, tracks
from .operators.windowing import WindowSpec
from .plans.sql import longest_word_udaf, run_sql, tokenize_udf
from .session import IN_MEMORY_STORE
from .sources import readers, sinks
from .streaming import processors as P
from .streaming import windows as W
from .streaming.panes import panes, word_panes

FLAGSHIP = "motivation_inner_join"
HOUR = 3_600_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select(F.col("user_id").alias("key"), (F.col("value") * 0.001).alias("lat"), (F.col("event_id") % 1000 * 0.0001).alias("lon"), F.unix_millis("ts").alias("ts"))


def metrics(spark: SparkSession, sf_dir: str, stamp: str = "end") -> DataFrame:
    return tracks.to_metric(positions(spark, sf_dir), unit_ms=HOUR, stamp=stamp)


def ntz(column: str):
    return F.col(column).cast("timestamp_ntz").alias(column)


# ---- words

WORDS = r"FROM (SELECT unnest(string_split_regex(text, '[^A-Za-z0-9_]+')) AS word FROM documents) WHERE word <> ''"


@query(f"SELECT word, count(*) AS cnt {WORDS} GROUP BY word")
def word_count(spark, sf_dir):
    return A.count_per_element(T.explode_words(table(spark, sf_dir, "documents").select("text")), "word")


@query("SELECT word, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z'']+')) AS word FROM documents) GROUP BY word")
def word_count_py(spark, sf_dir):
    return A.count_per_element(T.explode_words(table(spark, sf_dir, "documents").select("text"), split=T.words_with_apostrophes), "word")


@query(f"SELECT word, count(*) AS cnt {WORDS} GROUP BY word ORDER BY cnt DESC, word DESC LIMIT 5")
def top_words_global(spark, sf_dir):
    return A.top_k(word_count(spark, sf_dir), 5)


@query("SELECT coalesce(role, '') || ' ' || coalesce(text, '') AS line FROM conversations")
def map_to_lines(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(T.key_value_line(F.col("role"), F.col("text")).alias("line"))


@query("SELECT coalesce(text, '') AS line FROM conversations")
def map_to_lines_values_only(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(T.value_line(F.col("text")).alias("line"))


@query(f"SELECT arg_max(word, (length(word), word)) AS word {WORDS}")
def longest_word(spark, sf_dir):
    return T.explode_words(table(spark, sf_dir, "documents").select("text")).agg(A.longest(F.col("word")).alias("word"))


@query(f"SELECT avg(length(word)) AS mean_length {WORDS}")
def average_word_length(spark, sf_dir):
    return T.explode_words(table(spark, sf_dir, "documents").select("text")).agg(A.mean_length(F.col("word"), default=True).alias("mean_length"))


# ---- event-time windows


@query("""
WITH c AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type AS word, count(*) AS cnt FROM events GROUP BY ALL)
SELECT day, word, cnt FROM c QUALIFY row_number() OVER (PARTITION BY day ORDER BY cnt DESC, word DESC) <= 3
""")
def top_k_per_fixed_window(spark, sf_dir):
    w = WindowSpec("1 day").assign(events(spark, sf_dir).select("ts", F.col("event_type").alias("word")))
    counts = w.groupBy("window", "word").agg(F.count("*").alias("cnt")).select(F.col("window.start").alias("day"), "word", "cnt")
    return A.top_k(counts, 3, per=("day",)).select(ntz("day"), "word", "cnt")


_TUMBLE = "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS cnt FROM events GROUP BY ALL"


@query(_TUMBLE)
def tumbling_count(spark, sf_dir):
    w = WindowSpec("1 day").assign(events(spark, sf_dir).select("ts", "event_type"))
    return w.groupBy("window", "event_type").agg(F.count("*").alias("cnt")).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "cnt")


@query(_TUMBLE)
def tumbling_count_sql(spark, sf_dir):
    text = "SELECT CAST(w.start AS TIMESTAMP_NTZ) AS day, event_type, cnt FROM (SELECT TUMBLE(ts, INTERVAL '1' DAY) AS w, event_type, COUNT(*) AS cnt FROM {stream} GROUP BY TUMBLE(ts, INTERVAL '1' DAY), event_type)"
    return run_sql(spark, text, stream=events(spark, sf_dir))


_HOPS = "(SELECT *, time_bucket(INTERVAL 2 HOUR, ts) - i * INTERVAL 2 HOUR AS started FROM events, range(5) t(i))"


@query(f"SELECT started, round(avg(length(event_type)), 6) AS mean_length FROM {_HOPS} GROUP BY started")
def sliding_avg_len(spark, sf_dir):
    w = WindowSpec("10 hours", "2 hours").assign(events(spark, sf_dir).select("ts", F.col("event_type").alias("word")))
    return w.groupBy("window").agg(A.mean_length(F.col("word")).alias("m")).select(F.col("window.start").cast("timestamp_ntz").alias("started"), F.round("m", 6).alias("mean_length"))


@query(f"SELECT started, count(*) AS cnt FROM {_HOPS} GROUP BY started")
def hopping_count_sql(spark, sf_dir):
    text = "SELECT CAST(w.start AS TIMESTAMP_NTZ) AS started, cnt FROM (SELECT HOP(ts, INTERVAL '2' HOUR, INTERVAL '10' HOUR) AS w, COUNT(*) AS cnt FROM {stream} GROUP BY HOP(ts, INTERVAL '2' HOUR, INTERVAL '10' HOUR))"
    return run_sql(spark, text, stream=events(spark, sf_dir))


_FRAME = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"


@query(f"SELECT event_id, struct_extract(max(struct_pack(n := length(event_type), word := event_type)) {_FRAME}, 'word') AS longest FROM events")
def running_max_len(spark, sf_dir):
    return A.running_longest(events(spark, sf_dir), "event_type", [F.col("ts"), F.col("event_id")], ("user_id",)).select("event_id", "longest")


@query(f"SELECT event_id, struct_extract(max(struct_pack(n := length(event_type), word := event_type)) {_FRAME}, 'word') AS longest, max(ts) {_FRAME} AS latest FROM events")
def running_max_len_timestamped(spark, sf_dir):
    word = F.col("event_type")
    df = O.running(events(spark, sf_dir), ("user_id",), [F.col("ts"), F.col("event_id")], longest=("max", F.struct(F.length(word), word)), latest=("max", F.col("ts")))
    return df.select("event_id", F.col("longest.event_type").alias("longest"), ntz("latest"))


@query(f"SELECT event_id, round(avg(length(event_type)) {_FRAME}, 6) AS mean_length FROM events")
def running_avg_len(spark, sf_dir):
    df = A.running_mean_length(events(spark, sf_dir), "event_type", [F.col("ts"), F.col("event_id")], ("user_id",))
    return df.select("event_id", F.round("mean_length", 6).alias("mean_length"))


@query("SELECT count(*) AS cnt FROM lineitem")
def count_global(spark, sf_dir):
    return A.count_globally(table(spark, sf_dir, "lineitem"))


@query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem")
def sum_global(spark, sf_dir):
    return A.sum_globally(table(spark, sf_dir, "lineitem"), "l_linenumber")


# ---- tracks

_D = "2 * abs(sin(radians({a} - {b}) / 2))"
_DLAT, _DLON = _D.format(a="lat", b="lat0"), _D.format(a="lon", b="lon0")
_LEGS = f"""
WITH p AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS ts, value * 0.001::DOUBLE AS lat, event_id % 1000 * 0.0001::DOUBLE AS lon FROM events),
o AS (SELECT key, ts, min(struct_pack(lat := lat, lon := lon)) AS s FROM p GROUP BY key, ts),
b AS (SELECT key, ts, s.lat AS lat, s.lon AS lon, lag(s.lat) OVER w AS lat0, lag(s.lon) OVER w AS lon0, lag(ts) OVER w AS ts0 FROM o WINDOW w AS (PARTITION BY key ORDER BY ts)),
g AS (SELECT *, 6371000.0 * sqrt(({_DLAT}) * ({_DLAT}) + ({_DLON}) * ({_DLON})) AS len FROM b)
"""
_TRACKER = f"{_LEGS} SELECT key, round(coalesce(sum(len), 0.0), 3) AS distance, max(ts) - min(ts) AS duration FROM g GROUP BY key"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("key", F.round("distance", 3).alias("distance"), "duration")


@query(_TRACKER)
def tracker_metrics(spark, sf_dir):
    return _rounded(tracks.tracker_metrics(positions(spark, sf_dir)))


@query(_TRACKER)
def tracker_metrics_udaf(spark, sf_dir):
    return _rounded(tracks.tracker_metrics_udaf(positions(spark, sf_dir)))


@query(f"{_LEGS}, t AS (SELECT key, coalesce(sum(len), 0.0) AS d, max(ts) - min(ts) AS t FROM g GROUP BY key) SELECT format('{{}}\t{{:.3f}}\t{{:.3f}}', key, d, CASE WHEN t > 0 THEN t * 1000 / (60.0::DOUBLE * d) ELSE 0 END) AS line FROM t WHERE d > 0")
def tracker_pace_format(spark, sf_dir):
    m = tracks.tracker_metrics(positions(spark, sf_dir)).where("distance > 0")
    return m.select(tracks.pace_line(F.col("key"), F.col("distance"), F.col("duration")).alias("line"))


_PIECES = f"""{_LEGS},
u AS (SELECT *, unnest(range(ts0 // {HOUR}, (ts - 1) // {HOUR} + 1)) AS unit FROM g WHERE ts0 IS NOT NULL AND ts > ts0),
m AS (SELECT key, len * (least(ts, (unit + 1) * {HOUR}) - greatest(ts0, unit * {HOUR})) / (ts - ts0) AS length, least(ts, (unit + 1) * {HOUR}) - greatest(ts0, unit * {HOUR}) AS duration, greatest(ts0, unit * {HOUR}) AS started, least(ts, (unit + 1) * {HOUR}) AS ended FROM u)
"""


def _metric_rows(df: DataFrame) -> DataFrame:
    return df.select("key", F.round("length", 3).alias("length"), "duration", "ts")


@query(f"{_PIECES} SELECT key, round(length, 3) AS length, duration, ended AS ts FROM m")
def to_metric_end(spark, sf_dir):
    return _metric_rows(metrics(spark, sf_dir))


@query(f"{_PIECES} SELECT key, round(length, 3) AS length, duration, started AS ts FROM m")
def to_metric_start(spark, sf_dir):
    return _metric_rows(metrics(spark, sf_dir, "start"))


def _paces(stamp: str) -> str:
    return f"""{_PIECES},
f AS (SELECT key, ({stamp} // {HOUR} + 1) * {HOUR} AS w, sum(length) * 1000 / sum(duration) AS pace FROM m GROUP BY ALL),
s AS (SELECT key, ({stamp} // {HOUR} + 1 + i) * {HOUR} AS w, sum(length) * 1000 / sum(duration) AS pace FROM m, range(5) t(i) GROUP BY ALL)
"""


def _pace_rows(df: DataFrame) -> DataFrame:
    return df.select("key", ntz("window_end"), F.round("pace", 6).alias("pace"))


@query(f"{_paces('ended')} SELECT key, make_timestamp(w * 1000) AS window_end, round(pace, 6) AS pace FROM f")
def pace_fixed(spark, sf_dir):
    return _pace_rows(tracks.windowed_pace(metrics(spark, sf_dir), WindowSpec("1 hour")))


@query(f"{_paces('ended')} SELECT key, make_timestamp(w * 1000) AS window_end, round(pace, 6) AS pace FROM s")
def pace_sliding(spark, sf_dir):
    return _pace_rows(tracks.windowed_pace(metrics(spark, sf_dir), WindowSpec("5 hours", "1 hour")))


def _alerts(stamp: str = "ended", guard: str = "f.pace > 0 AND s.pace > 0", outside: str = "(f.pace / s.pace < 0.9 OR f.pace / s.pace > 1.1)") -> str:
    return f"{_paces(stamp)} SELECT key, make_timestamp(w * 1000) AS window_end, round(f.pace / s.pace, 6) AS ratio, f.pace / s.pace > 1 AS is_up FROM f JOIN s USING (key, w) WHERE {guard} AND {outside}"


def _motivation(strategy: str, guard: str):
    def run(spark, sf_dir):
        out = tracks.alerts(metrics(spark, sf_dir), "1 hour", "5 hours", strategy)
        return out.select("key", ntz("window_end"), F.round("ratio", 6).alias("ratio"), "is_up")

    run.__name__ = f"motivation_{strategy}"
    return query(_alerts(guard=guard))(run)


for _s, _g in (("side_input", "s.pace > 0"), ("cogroup", "f.pace > 0 AND s.pace > 0"), ("inner_join", "f.pace > 0 AND s.pace > 0"), ("own_join", "f.pace > 0 AND s.pace > 0"), ("sql", "s.pace <> 0")):
    _motivation(_s, _g)


@query(_alerts("started", outside="NOT (f.pace / s.pace > 0.9 AND f.pace / s.pace < 1.1)"))
def motivation_py(spark, sf_dir):
    out = tracks.alerts(metrics(spark, sf_dir, "start"), "1 hour", "5 hours", inclusive=True)
    return out.select("key", ntz("window_end"), F.round("ratio", 6).alias("ratio"), "is_up")


@query(f"WITH a AS ({_alerts()}) SELECT '' AS key, CASE WHEN is_up THEN 'Great job user ' || key || '! You are gaining speed!' ELSE 'Looks like you are slowing down user ' || key || '. Go! Go! Go!' END AS value FROM a")
def notifications(spark, sf_dir):
    out = tracks.alerts(metrics(spark, sf_dir), "1 hour", "5 hours")
    return sinks.records(out, tracks.notification(F.col("key"), F.col("is_up")))


@query(f"WITH a AS ({_alerts('started', outside='NOT (f.pace / s.pace > 0.9 AND f.pace / s.pace < 1.1)')}) SELECT '' AS key, CASE WHEN is_up THEN 'Good job ' || key || ', you are gaining speed!' ELSE 'Looks like you are slowing down user ' || key || '. Go, go, go!' END AS value FROM a")
def notifications_py(spark, sf_dir):
    out = tracks.alerts(metrics(spark, sf_dir, "start"), "1 hour", "5 hours", inclusive=True)
    return sinks.records(out, tracks.notification_py(F.col("key"), F.col("is_up")))


# ---- aggregates of one's own


@query(f"{_paces('ended')} SELECT key, make_timestamp(w * 1000) AS window_end, round(pace, 6) AS pace FROM f")
def pace_by_combiner(spark, sf_dir):
    m = WindowSpec("1 hour").assign(metrics(spark, sf_dir).withColumn("ts", F.timestamp_millis("ts"))).select("key", F.col("window.end").alias("window_end"), "length", "duration")
    return _pace_rows(X.combine(m, ["key", "window_end"], X.Pace(), ["length", "duration"], "pace"))


@query(f"SELECT source, arg_max(word, (length(word), word)) AS word FROM (SELECT source, unnest(string_split_regex(text, '[^A-Za-z0-9_]+')) AS word FROM documents) WHERE word <> '' GROUP BY source")
def longest_word_by_combiner(spark, sf_dir):
    words = T.explode_words(table(spark, sf_dir, "documents").select("source", "text"))
    return X.combine(words, ["source"], X.Longest(), ["word"], "word_").withColumnRenamed("word_", "word")


@query(f"SELECT round(avg(length(word)), 9) AS mean_length {WORDS}")
def average_word_length_by_combiner(spark, sf_dir):
    words = T.explode_words(table(spark, sf_dir, "documents").select("text"))
    return X.combine(words, [], X.MeanLength(), ["word"], "mean_length", default=True).select(F.round("mean_length", 9).alias("mean_length"))


# ---- changelogs, late data, enrichment

_CHANGES = """
WITH l AS (SELECT user_id AS pk, event_type AS k, event_id AS v, ts AS s, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS e FROM events),
d AS (SELECT event_type AS pk, time_bucket(INTERVAL 1 DAY, ts) AS ts, count(*) AS v FROM events GROUP BY ALL),
r AS (SELECT pk, pk AS k, v, ts AS s, lead(ts) OVER (PARTITION BY pk ORDER BY ts) AS e FROM d),
j AS (SELECT l.k AS join_key, l.pk AS left_pk, r.pk AS right_pk, l.v AS left_value, r.v AS right_value, greatest(l.s, r.s) AS s, least(l.e, r.e) AS e FROM l JOIN r ON l.k = r.k AND (l.e IS NULL OR r.s < l.e) AND (r.e IS NULL OR l.s < r.e))
"""


@query(f"{_CHANGES} SELECT '+' AS sign, join_key, left_pk, right_pk, left_value, right_value, s AS ts FROM j UNION ALL SELECT '-', join_key, left_pk, right_pk, left_value, right_value, e FROM j WHERE e IS NOT NULL")
def changelog_join(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    left = e.select(F.col("user_id").alias("pk"), F.col("event_type").alias("join_key"), F.col("event_id").alias("value"), "ts")
    daily = e.groupBy(F.col("event_type").alias("pk"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")).agg(F.count("*").alias("value"))
    return C.changelog_join(left, daily.select("pk", F.col("pk").alias("join_key"), "value", "ts"), bucket_s=86_400)


_ARRIVAL = """
WITH a AS (SELECT event_id, event_type, epoch_us(ts) // 1000 AS ts_ms, max(epoch_us(ts) // 1000) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1000 AS wm FROM events)
SELECT event_id, coalesce(ts_ms - ts_ms % 600000 + 599999 + 30000 < wm, FALSE) AS droppable FROM a
"""


@query(_ARRIVAL)
def droppable_split(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "event_type", F.unix_millis("ts").alias("ts_ms"))
    rows = L.replay_split(e, F.col("event_id"), 600_000, 30_000, 1000, ("event_type",))
    main, late = L.split(rows)
    return main.select("event_id", F.lit(False).alias("droppable")).unionByName(late.select("event_id", F.lit(True).alias("droppable")))


_LENGTHS = "SELECT conv_id, turn, CAST(length(text) AS INTEGER) AS output FROM conversations"


@query(_LENGTHS)
def enrich_element(spark, sf_dir):
    return E.enrich(table(spark, sf_dir, "conversations"), "text", batch=None).select("conv_id", "turn", "output")


@query(_LENGTHS)
def enrich_batch(spark, sf_dir):
    return E.enrich(table(spark, sf_dir, "conversations"), "text").select("conv_id", "turn", "output")


@query(_LENGTHS)
def enrich_buckets(spark, sf_dir):
    return E.enrich_in_buckets(table(spark, sf_dir, "conversations"), "text").select("conv_id", "turn", "output")


@query(_LENGTHS)
def enrich_buckets_py(spark, sf_dir):
    return E.enrich_in_buckets(table(spark, sf_dir, "conversations"), "text", of=E.first_character_bucket).select("conv_id", "turn", "output")


@query("SELECT user_id AS key, value * 0.001::DOUBLE AS lat, event_id % 1000 * 0.0001::DOUBLE AS lon, date_trunc('milliseconds', ts) AS ts FROM events")
def positions_to_records(spark, sf_dir):
    p = positions(spark, sf_dir)
    good, _ = sinks.position_records(p.select(readers.tsv_position(F.col("key"), F.col("lat"), F.col("lon"), F.col("ts")).alias("line")))
    out = readers.positions_from_keys(good.withColumnRenamed("timestamp", "ts"), delay=None)
    return out.select(F.col("key").cast("long").alias("key"), "lat", "lon", ntz("ts"))


@query("SELECT 'some' AS part, count(*) AS cnt FROM lineitem WHERE l_quantity > 0 HAVING count(*) > 0 UNION ALL SELECT 'none', count(*) FROM lineitem WHERE l_quantity < 0 HAVING count(*) > 0")
def count_without_default(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    of = lambda part, where: A.count_if_any(rows.where(where)).select(F.lit(part).alias("part"), "cnt")
    return of("some", "l_quantity > 0").unionByName(of("none", "l_quantity < 0"))


@query(_LENGTHS)
def enrich_distinct(spark, sf_dir):
    return E.enrich_distinct(table(spark, sf_dir, "conversations"), "text").select("conv_id", "turn", "output")


# ---- schemas, SQL, sources


@query("SELECT count(*) AS cnt FROM orders WHERE o_totalprice > 0")
def schema_filter_select_count(spark, sf_dir):
    df = table(spark, sf_dir, "orders").where(F.col("o_totalprice") > 0).select("o_orderkey", "o_totalprice")
    return run_sql(spark, "SELECT COUNT(*) AS cnt FROM {rows_in}", rows_in=df)


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS quantity, CAST(l_extendedprice AS FLOAT) AS price FROM lineitem")
def cast_narrowing(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("quantity"), F.col("l_extendedprice").cast("float").alias("price"))


@query("SELECT c_name AS name, c_acctbal AS balance FROM customer UNION ALL SELECT s_name, s_acctbal FROM supplier")
def union_flatten(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return a.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")))


@query(f"SELECT word AS s, count(*) AS cnt {WORDS} GROUP BY word")
def sql_word_count(spark, sf_dir):
    words = T.explode_words(table(spark, sf_dir, "documents").select("text")).toDF("s")
    return run_sql(spark, "SELECT s, COUNT(*) AS cnt FROM {tokens} GROUP BY s", tokens=words)


@query(f"SELECT arg_max(word, (length(word), word)) AS word {WORDS}")
def sql_cte_unnest(spark, sf_dir):
    text = r"WITH w AS (SELECT EXPLODE(SPLIT(text, '\\W+')) AS word FROM {docs}) SELECT max_by(word, struct(length(word), word)) AS word FROM w WHERE word <> ''"
    return run_sql(spark, text, docs=table(spark, sf_dir, "documents").select("text"))


@query("SELECT source, arg_max(word, (length(word), word)) AS word FROM (SELECT source, unnest(string_split_regex(text, '[^A-Za-z0-9_]+')) AS word FROM documents) WHERE word <> '' GROUP BY source")
def sql_cte_unnest_udaf(spark, sf_dir):
    """The longest word of each source: of each part of its words first, so that no task holds a vocabulary, then of the parts' words."""
    text = """
    WITH w AS (SELECT source, EXPLODE({TOKENIZE}(text)) AS word FROM {docs}),
    d AS (SELECT DISTINCT source, word FROM w),
    p AS (SELECT source, {LONGEST_WORD}(word) AS word FROM d GROUP BY source, pmod(xxhash64(word), 256))
    SELECT source, {LONGEST_WORD}(word) AS word FROM p GROUP BY source
    """
    return run_sql(spark, text, {"TOKENIZE": tokenize_udf(), "LONGEST_WORD": longest_word_udaf()}, docs=table(spark, sf_dir, "documents").select("source", "text"))


@query("SELECT c_custkey AS k, c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
def natural_join_sql(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return run_sql(spark, "SELECT k, c_name, o_orderkey FROM {buyers} NATURAL JOIN {purchases}", buyers=c, purchases=o)


@query("SELECT user_id AS key, value * 0.001::DOUBLE AS lat, event_id % 1000 * 0.0001::DOUBLE AS lon, date_trunc('milliseconds', ts) AS ts FROM events")
def kafka_positions(spark, sf_dir):
    p = positions(spark, sf_dir)
    records = p.select(F.lit("").alias("key"), readers.tsv_position(F.col("key"), F.col("lat"), F.col("lon"), F.col("ts")).alias("value"))
    out = readers.positions_from_values(records, delay=None)
    return out.select(F.col("key").cast("long").alias("key"), "lat", "lon", ntz("ts"))


_DRAW = "CAST(CAST('0x' || substr(md5('0:{axis}:' || CAST(i AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS {axis}"


@query(f"SELECT 4.0::DOUBLE * sum(CASE WHEN x * x + y * y <= 1 THEN 1 ELSE 0 END) / count(*) AS pi FROM (SELECT {_DRAW.format(axis='x')}, {_DRAW.format(axis='y')} FROM range(100000) r(i))")
def pi_estimate(spark, sf_dir):
    return pi.pi_estimate(spark)


@query("SELECT substr(line, 1, 1) AS first, count(*) AS cnt FROM (SELECT unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS line FROM documents WHERE text IS NOT NULL AND text <> '') GROUP BY ALL")
def file_read_lines(spark, sf_dir):
    path = f"{sinks.shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    table(spark, sf_dir, "documents").where("text IS NOT NULL AND text <> ''").select(F.regexp_replace("text", "\r\n|\r|\n", "\n")).write.text(path)
    counts = readers.lines(spark, path).select(F.substring("line", 1, 1).alias("first")).groupBy("first").agg(F.count("*").alias("cnt"))
    kept = f"{path}-counts"  # one row for each character
    counts.write.parquet(kept)
    sinks.delete(spark, path)
    return spark.read.parquet(kept)


# ---- streams over what is there: results up to the watermark, the greatest time


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))  # a pattern, as the table may be one file


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS cnt FROM events WHERE time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(date_trunc('milliseconds', ts)) FROM events) GROUP BY ALL")
def stream_tumbling_count(spark, sf_dir):
    words = event_stream(spark, sf_dir).select("ts", F.col("event_type").alias("word"))
    out = sinks.finished(W.word_counts(words, "1 day").select(F.col("window.start").alias("day"), F.col("word").alias("event_type"), "cnt"), "counts")
    return out.select(ntz("day"), "event_type", "cnt")


@query(f"""{_LEGS},
u AS (SELECT *, unnest(range(ts0 // {HOUR}, (ts - 1) // {HOUR} + 1)) AS unit FROM g WHERE ts > ts0 AND ts < (SELECT max(epoch_us(ts) // 1000) FROM events)),
m AS (SELECT *, greatest(ts0, unit * {HOUR}) AS started, least(ts, (unit + 1) * {HOUR}) AS ended FROM u)
SELECT CAST(key AS VARCHAR) AS key, round(len * (ended - started) / (ts - ts0), 3) AS length, ended - started AS duration, make_timestamp(ended * 1000) AS ts FROM m""")
def stream_to_metric(spark, sf_dir):
    e = event_stream(spark, sf_dir)
    p = e.select(F.col("user_id").cast("string").alias("key"), (F.col("value") * 0.001).alias("lat"), (F.col("event_id") % 1000 * 0.0001).alias("lon"), F.unix_millis("ts").alias("ts_ms"), "ts").withWatermark("ts", "0 seconds")
    out = sinks.finished(P.to_metric_stream(p, unit_ms=HOUR), "pieces")
    return out.select("key", F.round("length", 3).alias("length"), "duration", ntz("ts"))


@query("""
SELECT event_type AS key, time_bucket(INTERVAL 1 DAY, ts) AS started, max(date_trunc('milliseconds', ts)) AS stamp, count(*) AS cnt, max(struct_pack(n := length(word), word := word)).word AS longest
FROM (SELECT event_type, ts, CAST(user_id AS VARCHAR) AS word FROM events)
WHERE time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(date_trunc('milliseconds', ts)) FROM events) - INTERVAL 0 SECOND GROUP BY ALL
""")
def stream_panes(spark, sf_dir):
    words = event_stream(spark, sf_dir).select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("word"), "ts")
    out = sinks.finished(word_panes(words, WindowSpec("1 day", lateness="1 hour", stamp="latest")), "panes")
    return out.where("pane = 'on_time'").select("key", ntz("start").alias("started"), ntz("stamp"), "cnt", "longest")


_UNTIL = "(SELECT max(epoch_us(ts) // 1000) FROM events)"


def _seen(sql: str) -> str:
    """Over the positions that the watermark has passed."""
    return sql.replace("FROM events),\no AS", f"FROM events WHERE epoch_us(ts) // 1000 < {_UNTIL}),\no AS")


def position_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_stream(spark, sf_dir)
    return e.select(F.col("user_id").cast("string").alias("key"), (F.col("value") * 0.001).alias("lat"), (F.col("event_id") % 1000 * 0.0001).alias("lon"), F.unix_millis("ts").alias("ts_ms"), "ts").withWatermark("ts", "0 seconds")


@query(_seen(f"{_paces('ended')} SELECT CAST(key AS VARCHAR) AS key, make_timestamp(w * 1000) AS window_end, round(pace, 6) AS pace FROM s WHERE w <= {_UNTIL}"))
def stream_pace_panes(spark, sf_dir):
    """Pieces by state, and panes of their sliding paces, in one plan."""
    out = panes(P.pieces_stream(position_stream(spark, sf_dir), HOUR), WindowSpec("5 hours", "1 hour"), X.Pace(), ["length", "duration"], chained=True)
    return sinks.finished(out, "paces").where("pane = 'on_time'").select("key", ntz("end").alias("window_end"), F.round("value", 6).alias("pace"))


def _stream_alerts(guard: str = "f.pace > 0 AND s.pace > 0") -> str:
    return _seen(f"SELECT CAST(key AS VARCHAR) AS key, window_end, ratio, is_up FROM ({_alerts(guard=f'{guard} AND w <= {_UNTIL}')})")


def _alert_rows(out: DataFrame) -> DataFrame:
    return out.select("key", ntz("window_end"), F.round("ratio", 6).alias("ratio"), "is_up")


@query(_stream_alerts())
def stream_motivation(spark, sf_dir):
    """Positions to alerts in one streaming query: pieces, fixed and sliding paces, and their join."""
    return _alert_rows(sinks.finished(W.motivation(lambda: position_stream(spark, sf_dir), "1 hour", "5 hours", HOUR), "alerts"))


@query(_stream_alerts())
def stream_motivation_cogroup(spark, sf_dir):
    return _alert_rows(sinks.finished(W.motivation(lambda: position_stream(spark, sf_dir), "1 hour", "5 hours", HOUR, strategy="cogroup"), "alerts"))


@query(_stream_alerts("s.pace > 0"))
def stream_motivation_side_input(spark, sf_dir):
    return _alert_rows(sinks.finished(W.motivation(lambda: position_stream(spark, sf_dir), "1 hour", "5 hours", HOUR, strategy="side_input"), "alerts"))


@query(f"SELECT CAST(key AS VARCHAR) AS key, window_end, ratio, is_up FROM ({_alerts(guard=f's.pace <> 0 AND w * 1000 <= (SELECT max(ended) * 1000 FROM m)')})")
def stream_motivation_sql(spark, sf_dir):
    """The statement of ``motivation_sql`` over a stream of pieces that come in steps, up to the watermark."""
    pieces = metrics(spark, sf_dir).withColumn("ts", F.timestamp_millis("ts")).withColumn("key", F.col("key").cast("string"))
    stream, arrivals, path = sinks.in_steps(pieces, "ts", "pieces")
    both = run_sql(spark, tracks.paces_sql("1 hour", "5 hours"), metrics=stream.withWatermark("ts", "0 seconds"))
    out = sinks.finished(_alert_rows(tracks.out_of_band(both, ["key", "window_end"])), "alerts", arrivals, IN_MEMORY_STORE)
    sinks.delete(spark, path)
    return out


_STREAM_CHANGES = f"""
WITH c AS (SELECT user_id, event_type, CAST(event_id AS VARCHAR) AS v, event_id, epoch_us(ts) // 1000 AS ms FROM events WHERE epoch_us(ts) // 1000 < {_UNTIL}),
a AS (SELECT user_id AS pk, ms, max(struct_pack(k := event_type, v := v)) AS x FROM c WHERE event_id % 20 <> 0 GROUP BY ALL),
b AS (SELECT event_type AS pk, ms, max(v) AS v FROM c WHERE event_id % 20 = 0 GROUP BY ALL),
l AS (SELECT CAST(pk AS VARCHAR) AS pk, x.k AS k, x.v AS v, ms AS s, lead(ms) OVER (PARTITION BY pk ORDER BY ms) AS e FROM a),
r AS (SELECT pk, v, ms AS s, lead(ms) OVER (PARTITION BY pk ORDER BY ms) AS e FROM b),
j AS (SELECT l.k AS join_key, l.pk AS left_pk, r.pk AS right_pk, l.v AS left_value, r.v AS right_value, greatest(l.s, r.s) AS s, least(l.e, r.e) AS e FROM l JOIN r ON l.k = r.pk AND (l.e IS NULL OR r.s < l.e) AND (r.e IS NULL OR l.s < r.e))
"""


@query(f"{_STREAM_CHANGES} SELECT '+' AS sign, join_key, left_pk, right_pk, left_value, right_value, s AS ts_ms FROM j UNION ALL SELECT '-', join_key, left_pk, right_pk, left_value, right_value, e FROM j WHERE e IS NOT NULL")
def stream_changelog_join(spark, sf_dir):
    """Users under the kind of their last event, which changes, joined with a row for each kind: re-keyed and joined in one streaming query."""
    e = event_stream(spark, sf_dir)
    right = F.col("event_id") % 20 == 0
    side, pk = F.when(right, "right").otherwise("left"), F.when(right, F.col("event_type")).otherwise(F.col("user_id").cast("string"))
    changes = e.select(side.alias("side"), pk.alias("pk"), F.col("event_type").alias("join_key"), F.col("event_id").cast("string").alias("value"), F.unix_millis("ts").alias("ts_ms"), F.lit(False).alias("is_delete"), "ts")
    return sinks.finished(P.rekeyed_join_stream(changes.withWatermark("ts", "0 seconds")), "joined")
