"""Expected results of the operators on small fixed inputs."""

import dataclasses
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidewater.functions import geo, schemas
from tidewater.functions import text as T
from tidewater.operators import aggregates as A
from tidewater.operators import changelog_join as C
from tidewater.operators import enrich as E
from tidewater.operators import late_split as L
from tidewater.operators import pi, tracks
from tidewater.operators.windowing import WindowSpec, millis, windows_of
from tidewater.plans.sql import run_sql, windows_sql
from tidewater.sources import readers, sinks

R = geo.EARTH_RADIUS
T0 = 1_234_567_890_000


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def walk(key, *parts, start=T0, lat=10.0, lon=20.0):
    """Positions of a walk: parts are (m/s, seconds) in the direction (1, 1)."""
    out = [(key, lat, lon, start)]
    for speed, seconds in parts:
        step = speed * seconds * 180 / (R * math.pi) / math.sqrt(2)
        lat, lon, start = lat + step, lon + step, start + seconds * 1000
        out.append((key, lat, lon, start))
    return out


def plain_distance(a, b):
    return R * math.hypot(*(2 * math.sin(math.radians(y - x) / 2) for x, y in zip(a, b, strict=True)))


def plain_pieces(points, unit=60_000):
    """(key, length, duration, start, end) of the pieces between unit boundaries of each leg."""
    out = []
    for key in {p[0] for p in points}:
        track = sorted(p for p in points if p[0] == key)
        track.sort(key=lambda p: p[3])
        for (_, *a, t), (_, *b, u) in zip(track, track[1:], strict=False):
            at = t
            while at < u:
                end = min(u, (at // unit + 1) * unit)
                out.append((key, plain_distance(a, b) * (end - at) / (u - t), end - at, at, end))
                at = end
    return out


def plain_alerts(points, stamp=4, inside=lambda r: 0.9 <= r <= 1.1):
    """(key, ratio to four places, is_up) where the pace of a minute leaves that of the five minutes that end with it."""
    sums = defaultdict(lambda: [0.0, 0])
    for p in plain_pieces(points):
        s = sums[p[0], p[stamp] // 60_000]
        s[0], s[1] = s[0] + p[1], s[1] + p[2]
    out = []
    for (key, minute), (length, time) in list(sums.items()):
        five = [sums[key, m] for m in range(minute - 4, minute + 1) if (key, m) in sums]
        ratio = length / time / (sum(x for x, _ in five) / sum(t for _, t in five))
        if not inside(ratio):
            out.append((key, round(ratio, 4), ratio > 1))
    return sorted(out)


#: Two walks whose paces change.
WALKS = [("p", (4.0, 150), (3.0, 200), (5.0, 90)), ("q", (1.5, 260), (2.25, 130))]


def walks(start=T0):
    return [x for key, *parts in WALKS for x in walk(key, *parts, start=start)]


POSITION = "key string, lat double, lon double, ts long"


def test_words_of_a_text_file(spark, tmp_path):
    r = random.Random(4)
    text = "\n".join(", ".join("".join(r.choice("abcde") for _ in range(r.randint(1, 4))) for _ in range(90)) + "." for _ in range(7))
    (tmp_path / "text").write_text(text)
    want = Counter(w for w in re.split(r"\W+", text) if w)
    words = T.explode_words(readers.lines(spark, f"file://{tmp_path}/text"), "line")
    counts = A.count_per_element(words, "word")
    assert dict(map(tuple, counts.collect())) == want
    assert [tuple(x) for x in A.top_k(counts, 5).collect()] == sorted(want.items(), key=lambda x: (x[1], x[0]), reverse=True)[:5]
    found = words.agg(A.longest(F.col("word")).alias("longest"), A.mean_length(F.col("word")).alias("mean")).first()
    assert found.longest == max(want, key=lambda w: (len(w), w)) and found.mean == pytest.approx(sum(len(w) * n for w, n in want.items()) / sum(want.values()))


def test_splitting(spark):
    df = spark.createDataFrame([("It's 2_b, or\tnot",), ("",), (None,)], "text string")
    assert rows(T.explode_words(df)) == [("2_b",), ("It",), ("not",), ("or",), ("s",)]
    assert rows(T.explode_words(df, split=T.words_with_apostrophes)) == [("It's",), ("b",), ("not",), ("or",)]
    kv = spark.createDataFrame([("k", "v"), (None, "v"), (None, None)], "key string, value string")
    assert rows(kv.select(T.key_value_line(F.col("key"), F.col("value")))) == [(" ",), (" v",), ("k v",)]


def test_empty_input(spark):
    none = spark.createDataFrame([], "word string, n long")
    assert A.count_globally(none).first().cnt == 0 and A.sum_globally(none, "n").first().total == 0
    assert math.isnan(none.agg(A.mean_length(F.col("word"), default=True)).first()[0])
    assert none.groupBy("n").agg(A.mean_length(F.col("word"))).count() == 0
    assert A.count_if_any(none).count() == 0 and A.count_if_any(spark.range(3)).first().cnt == 3
    w = WindowSpec("1 day").assign(none.withColumn("ts", F.timestamp_millis("n")))
    assert w.groupBy("window").agg(F.count("*")).count() == 0
    blank = spark.createDataFrame([(" \t",), (None,), ("",), (" x",)], "s string")
    assert [x[0] for x in blank.select(T.is_blank(F.col("s"))).collect()] == [True, True, True, False]


def test_running_results(spark):
    df = spark.createDataFrame([("a", 0), ("bb", 10), ("ccc", 20), ("d", 30)], "word string, t long")
    assert [r.longest for r in A.running_longest(df, "word", [F.col("t")]).orderBy("t").collect()] == ["a", "bb", "ccc", "ccc"]
    assert [r.mean_length for r in A.running_mean_length(df.limit(3), "word", [F.col("t")]).orderBy("t").collect()] == [1.0, 1.5, 2.0]


def at(spark, values, ddl="word string, ms long"):
    return spark.createDataFrame(values, ddl).withColumn("ts", F.timestamp_millis("ms"))


def test_sliding_means(spark):
    df = at(spark, [("a", 0), ("bb", 1999), ("ccc", 5000), ("dddd", 10000)])
    means = WindowSpec("10 seconds", "2 seconds").assign(df).groupBy("window").agg(A.mean_length(F.col("word")).alias("m")).collect()
    assert Counter(r.m for r in means) == {1.5: 2, 2.0: 3, 3.5: 2, 4.0: 3}


def test_top_k_by_window(spark):
    lines = [("the first line", 0), ("the first line again in line", 1000), ("first the line", 2000), ("line of the second window line in", 10_000), ("in window line", 11_000)]
    w = WindowSpec("10 seconds").assign(T.explode_words(at(spark, lines, "text string, ms long")))
    counts = A.count_per_element(w, "window", "word")
    top = A.top_k(counts, 1, per=("window",)).orderBy("window.start").collect()
    assert [(r.word, r.cnt) for r in top] == [("line", 4), ("line", 3)]


def test_windows_of_a_time(spark):
    df = spark.createDataFrame([(12_345,)], "ms long").select(windows_of(F.col("ms"), 10_000, 2_000).alias("w"), windows_of(F.col("ms"), 10_000).alias("f")).first()
    assert [tuple(x) for x in df.w] == [(12_000 - i * 2000, 22_000 - i * 2000) for i in range(5)] and [tuple(x) for x in df.f] == [(10_000, 20_000)]
    spec = WindowSpec("10 seconds", lateness="1 hour")
    assert spec.again(accumulate=True).lateness == "1 hour"
    assert (millis("1 hour"), millis("250 milliseconds"), millis(None)) == (3_600_000, 250, 0)
    rows = spark.createDataFrame([(3,), (7,)], "ms long").withColumn("ts", F.timestamp_millis("ms"))
    for stamp, want in (("end", 9_999), ("latest", 7)):
        one = spec.again(stamp=stamp)
        out = one.assign(rows).groupBy("window").agg(F.max("ts").alias("latest")).select(F.unix_millis(one.stamped(F.col("latest"))).alias("at"))
        assert out.first().at == want


def test_distances(spark):
    pairs = [(90.0, 0.0, -90.0, 0.0, 2 * R, 1.0), (0.0, 90.0, 0.0, -90.0, 2 * R, 1.0), (90.0, 0.0, 0.0, 0.0, math.sqrt(2) * R, 1.0), (0.0, 0.0, 0.0, 0.1, 11119.0, 1.0), (0.0, 0.0, 0.001, 0.001, math.sqrt(2) * 111, 1.0)]
    df = spark.createDataFrame(pairs, "a double, b double, c double, d double, want double, tol double")
    for r in df.withColumn("got", geo.distance(*map(F.col, "abcd"))).collect():
        assert abs(r.got - r.want) <= r.tol
    lat, lon = geo.move(F.lit(5.0), F.lit(6.0), F.lit(1.0), F.lit(2.0), F.lit(10.0), F.lit(10_000))
    assert spark.range(1).select(geo.distance(F.lit(5.0), F.lit(6.0), lat, lon)).first()[0] == pytest.approx(100, abs=1e-4)
    with pytest.raises(Exception, match="direction"):
        spark.range(1).select(geo.move(F.lit(5.0), F.lit(6.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1))[0]).collect()


def test_parsing_positions(spark):
    df = spark.createDataFrame([("u\tx\t1.5\t2.5\t99",), ("1\t2",), ("a\t1\tb\t3",)], "v string")
    assert [r[0] and tuple(r[0]) for r in df.select(geo.try_parse_position(F.col("v"))).collect()] == [(1.5, 2.5, 99), None, None]


@pytest.mark.parametrize("f", [tracks.tracker_metrics, tracks.tracker_metrics_udaf])
def test_tracker(spark, f):
    r = random.Random(9)
    points = [(k, r.uniform(0, 0.01), r.uniform(0, 0.01), T0 + 1000 * i) for k in ("s", "t") for i in range(r.randint(40, 150))]
    want = {}
    for key in ("s", "t"):
        track = [p for p in points if p[0] == key]
        want[key] = round(sum(plain_distance(a[1:3], b[1:3]) for a, b in zip(track, track[1:], strict=False)), 3), track[-1][3] - track[0][3]
    lines = spark.createDataFrame([("\t".join(map(str, p)),) for p in r.sample(points, len(points))], "line string")
    read = lines.select(F.split("line", "\t")[0].alias("key"), geo.parse_position(F.col("line")).alias("p")).select("key", "p.*")
    assert {x.key: (round(x.distance, 3), x.duration) for x in f(read).collect()} == want


def test_pieces_between_minutes(spark):
    points = walks()
    df = spark.createDataFrame(points, POSITION)
    for stamp, column in (("start", 3), ("end", 4)):
        got = sorted((r.key, round(r.length, 3), r.duration, r.ts) for r in tracks.to_metric(df, stamp=stamp).collect())
        assert got == sorted((p[0], round(p[1], 3), p[2], p[column]) for p in plain_pieces(points))
    assert tracks.to_metric(df.limit(1)).count() == 0 and tracks.to_metric(df.union(df)).count() == len(plain_pieces(points))


def test_average_pace(spark):
    m = spark.createDataFrame([("foo", 90.0, 30_000, 0), ("foo", 70.0, 10_000, 10_000), ("bar", 30.0, 30_000, 0), ("bar", 180.0, 60_000, 89_999)], "key string, length double, duration long, ts long")
    assert sorted((r.key, r.pace) for r in tracks.windowed_pace(m, WindowSpec("1 minute")).collect()) == [("bar", 1.0), ("bar", 3.0), ("foo", 4.0)]
    assert math.isnan(spark.createDataFrame([(1.0, 0.0)], "d double, s double").agg(A.mean_pace_seconds("d", "s")).first()[0])


@pytest.mark.parametrize("strategy", tracks.STRATEGIES)
def test_alerts(spark, strategy):
    out = tracks.alerts(tracks.to_metric(spark.createDataFrame(walks(), POSITION)), strategy=strategy).collect()
    want = plain_alerts(walks())
    assert sorted((r.key, round(r.ratio, 4), r.is_up) for r in out) == want and {x[2] for x in want} == {True, False}
    with pytest.raises(ValueError):
        tracks.alerts(out, strategy="no")


def test_alerts_stamped_at_start(spark):
    points = walks(T0 - T0 % 60_000)
    out = tracks.alerts(tracks.to_metric(spark.createDataFrame(points, POSITION), stamp="start"), inclusive=True).collect()
    assert sorted((r.key, round(r.ratio, 4), r.is_up) for r in out) == plain_alerts(points, 3, lambda r: 0.9 < r < 1.1)


def test_a_key_that_stands_twice_in_a_side_input_is_an_error(spark):
    df, side = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string"), spark.createDataFrame([(1, 5.0), (3, 7.0)], "k int, y double")
    assert rows(tracks.lookup(df, side, ["k"])) == [(1, "a", 5.0), (2, "b", None)]
    with pytest.raises(Exception, match="more than one value for the key 1"):
        tracks.lookup(df, side.union(side), ["k"]).collect()


def test_messages(spark):
    df = spark.createDataFrame([("ann:x", True), ("bob", False)], "k string, up boolean")
    got = sinks.records(df, tracks.notification(F.col("k"), F.col("up"))).collect()
    assert [(r.key, r.value) for r in got] == [("", "Great job user ann! You are gaining speed!"), ("", "Looks like you are slowing down user bob. Go! Go! Go!")]
    got = df.select(tracks.notification_py(F.col("k"), F.col("up")).alias("m")).collect()
    assert [r.m for r in got] == ["Good job ann:x, you are gaining speed!", "Looks like you are slowing down user bob. Go, go, go!"]
    assert spark.range(1).select(sinks.big_endian(F.lit(258))).first()[0] == bytes([0] * 6 + [1, 2])


DAY = 86_400_000


def random_changes(seed):
    """(side, pk, join_key, value, day, is_delete), with changes of one pk at one time."""
    r = random.Random(seed)
    out = []
    for side, pks, keys in (("left", "uvwx", "ABC"), ("right", "kmn", "ABC")):
        for _ in range(14):
            out.append((side, r.choice(pks), r.choice(keys), f"{side[0]}{r.randrange(5)}", r.randrange(12), r.random() < 0.2))
    return out


def replayed(changes):
    """What joining the two tables again after each time adds and takes away."""
    tables, out, before = {"left": {}, "right": {}}, Counter(), Counter()
    for day in sorted({c[4] for c in changes}):
        for side, pk, key, value, _, gone in sorted((c for c in changes if c[4] == day), key=lambda c: (c[5], c[2], c[3])):
            tables[side].pop(pk, None)
            if not gone:
                tables[side][pk] = (key, value)
        now = Counter((k, a, b, v, w) for a, (k, v) in tables["left"].items() for b, (x, w) in tables["right"].items() if k == x)
        touched = {(c[0], c[1]) for c in changes if c[4] == day}
        again = Counter({p: 1 for p in now if p in before and (("left", p[1]) in touched or ("right", p[2]) in touched)})
        for sign, pairs in (("+", now - before + again), ("-", before - now + again)):
            for pair in pairs.elements():
                out[sign, *pair, day] += 1
        before = now
    return out


@pytest.mark.parametrize("bucket", [None, 86_400])
@pytest.mark.parametrize("seed", range(4))
def test_changelog_join(spark, seed, bucket):
    changes = random_changes(seed)
    make = lambda side: at(spark, [(p, k, v, g, d * DAY) for s, p, k, v, d, g in changes if s == side], "pk string, join_key string, value string, is_delete boolean, ms long").drop("ms")
    out = C.changelog_join(make("left"), make("right"), bucket).withColumn("d", F.unix_millis("ts") / DAY).collect()
    assert Counter((r.sign, r.join_key, r.left_pk, r.right_pk, r.left_value, r.right_value, int(r.d)) for r in out) == replayed(changes)


def test_deletes_and_rekeying(spark):
    df = at(spark, [("p", "A", "1", 0, False), ("p", "B", "2", 5, False), ("p", "B", None, 9, True)], "pk string, join_key string, value string, ms long, is_delete boolean").drop("ms")
    assert [(r.join_key, r.value, r.end is None) for r in C.versions(df).orderBy("start").collect()] == [("A", "1", False), ("B", "2", False)]
    assert rows(C.rekeyed(df).where("is_delete").select("pk", "join_key")) == [("p", "A")]


def test_late_rows(spark):
    df = spark.createDataFrame([(0, "a", 1), (1, "wm", 1999), (2, "b", 999), (3, "wm", 2000), (4, "c", 0), (5, "d", 2000)], "n long, v string, ts_ms long")
    main, late = L.split(L.replay_split(df, F.col("n"), 1000, 1000))
    assert {r.v for r in late.collect()} == {"c"} and {r.v for r in main.collect()} == {"a", "b", "d", "wm"}


def test_enrichment(spark):
    words = spark.createDataFrame([(w,) for w in ["a", "bb", "ccc", "aa", "c", "bbb", "aa", None]], "word string")
    want = [("a", 1), ("aa", 2), ("aa", 2), ("bb", 2), ("bbb", 3), ("c", 1), ("ccc", 3), (None, None)]
    for out in (E.enrich(words, "word", batch=None), E.enrich(words, "word", batch=4), E.enrich_in_buckets(words, "word"), E.enrich_in_buckets(words, "word", of=E.first_character_bucket), E.enrich_distinct(words, "word")):
        assert rows(out) == sorted(want, key=repr)


def test_calls_are_batched_without_repeats(spark):
    def service():
        def call(texts):
            assert len(texts) <= 2 and len(set(texts)) == len(texts)
            return [len(x) for x in texts]

        return call

    df = spark.createDataFrame([(w,) for w in "a b a c b a d".split()], "word string").coalesce(1)
    assert E.enrich(df, "word", service, batch=2).count() == 7


def test_pi(spark):
    found = {pi.pi_estimate(spark, 100_000 // n, n).first().pi for n in (1, 10)}
    assert len(found) == 1 and found.pop() == pytest.approx(math.pi, abs=0.02)


@dataclasses.dataclass
class Place:
    latitude: float
    longitude: float = dataclasses.field(metadata={"name": "lon"})
    hidden: str = dataclasses.field(default="", metadata={"ignore": True})
    tags: list[str] | None = None


def test_schemas(spark):
    schema = schemas.schema_of(Place)
    assert schema.simpleString() == "struct<latitude:double,lon:double,tags:array<string>>"
    df = spark.createDataFrame(schemas.rows_of([Place(1.0, 2.0), Place(-1.0, 0.0)]), schema)
    assert run_sql(spark, "SELECT COUNT(*) AS cnt FROM {places}", places=df.where("latitude > 0").select("latitude")).first().cnt == 1
    assert schemas.with_string_schema(spark.createDataFrame([("foo",), ("bar",)], "x string"), "s").columns == ["s"]


def test_only_marked_places_of_a_query_are_replaced(spark):
    one = spark.createDataFrame([(1,)], "tokens int")
    assert run_sql(spark, "SELECT 'tokens' AS a, tokens, F.tokens AS b, {UP}(tokens) AS c FROM {tokens} AS F", {"UP": lambda x: f"<{x}>"}, tokens=one).first().asDict() == {"a": "tokens", "tokens": 1, "b": 1, "c": "<1>"}
    assert not [x for x in spark.catalog.listTables() if x.name.startswith("tokens_")] and not spark.catalog.functionExists("UP")


def test_columns_of_any_name(spark):
    names = ["_order", "_key0", "_n", "_low", "_high", "_at", "_of", "_edge", "_hot", "_block", "_seen", "_rows", "_place", "_chars", "_words"]
    df = spark.createDataFrame([(i % 2, i, f"w{i}") for i in range(40)], "k int, ts_ms long, word string")
    for n in names:
        df = df.withColumn(n, F.lit(n))
    for hot in (3, None):
        assert A.running_longest(df, "word", [F.col("ts_ms")], ("k",), hot).columns == [*df.columns, "longest"]
        assert A.running_mean_length(df, "word", [F.col("ts_ms")], ("k",), hot).where("mean_length > 0").count() == 40
        assert L.replay_split(df, F.col("ts_ms"), 10, 0, per=("k",), hot_rows=hot).columns == [*df.columns, "droppable"]
    assert A.top_k(df.withColumn("cnt", F.col("ts_ms")), 2, per=("k",)).columns == [*df.columns, "cnt"]


def test_sql_windows():
    assert windows_sql("HOP(ts, INTERVAL '1' MINUTE, INTERVAL '5' MINUTE)") == "window(ts, '5 MINUTE', '1 MINUTE')"
    assert windows_sql("TUMBLE(a.ts, INTERVAL '1' DAY)") == "window(a.ts, '1 DAY')"


def test_kafka_records(spark):
    raw = spark.createDataFrame([(b"k", b"u1\t1.0\t2.0\t60000"), (b"k", b"bad"), (None, b"u2\tx\t2.0\t3")], "key binary, value binary").withColumn("timestamp", F.timestamp_millis(F.lit(5)))
    got = readers.positions_from_values(readers.decode_strings(raw), None).withColumn("ts", F.unix_millis("ts"))
    assert rows(got) == [("u1", 1.0, 2.0, 60000)]
    keyed = spark.createDataFrame([("u", "1.5 2.5"), ("u", "no"), (None, "1 2")], "key string, value string").withColumn("ts", F.timestamp_millis(F.lit(7)))
    assert rows(readers.positions_from_keys(keyed, None).drop("ts")) == [("u", 1.5, 2.5)]
    lines = spark.createDataFrame([("u1\t1.5\t2.5\t60000",), ("no tab",), ("u2\tbad",), (None,)], "line string")
    good, bad = sinks.position_records(lines)
    assert [(r.key, r.value, r.ms) for r in good.withColumn("ms", F.unix_millis("timestamp")).collect()] == [("u1", "1.5 2.5", 60000)]
    assert [r.line for r in bad.collect()] == ["no tab"]
    assert rows(sinks.texts_to_records(spark, "a", "b")) == [("", "a"), ("", "b")]
    assert sinks.kafka_options("h:1", "t", "/c") == {"kafka.bootstrap.servers": "h:1", "topic": "t", "checkpointLocation": "/c"}
    assert readers.kafka_options("h:1", "t", startingOffsets="earliest") == {"kafka.bootstrap.servers": "h:1", "subscribe": "t", "startingOffsets": "earliest"}
    timed = spark.createDataFrame([("2020-01-01T00:00:00Z", "v"), ("x", "w")], "key string, value string")
    assert [r.value for r in readers.timed_lines(timed, None).collect()] == ["v"]


def test_lines_of_split_files(spark, tmp_path):
    for n, size in enumerate((100, 900, 10_000, 100_000)):
        text, i = "", 0
        while len(text) < size:
            text += ("\n" if text else "") + str(i % 10) * min(99, size - len(text) - bool(text))
            i += 1
        (tmp_path / f"f{n}").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        df = readers.lines(spark, f"file://{tmp_path}")
        assert df.rdd.getNumPartitions() > 4
        got = {r[0]: r[1] for r in df.groupBy(F.substring("line", 1, 1)).count().collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {"0": 112, "9": 110} | {str(d): 111 for d in range(1, 9)}


def test_generated_tracks(spark):
    df = readers.track_points(spark, 3, 10)
    assert df.count() == 30 and rows(df) == rows(readers.track_points(spark, 3, 10))
