"""Streaming queries on scripted input."""

import signal
from collections import Counter
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F
from test_batch import DAY, POSITION, T0, plain_alerts, plain_distance, random_changes, replayed, walks

from tidewater.operators import enrich as E
from tidewater.operators import tracks
from tidewater.operators.windowing import WindowSpec
from tidewater.sources import readers, sinks
from tidewater.sources.scripted import WATERMARK, scripted
from tidewater.streaming import processors as P
from tidewater.streaming import windows as W
from tidewater.streaming.panes import word_panes

FAR = T0 + 10**9


@pytest.fixture(autouse=True)
def _limit():
    """A query that never ends fails its test."""

    def stop(*_):
        raise TimeoutError

    signal.signal(signal.SIGALRM, stop)
    signal.alarm(60)
    yield
    signal.alarm(0)


def run(df, mode="append", **trigger):
    """All rows that a query gives until its input ends."""
    out = []
    q = df.writeStream.outputMode(mode).foreachBatch(lambda b, _: out.extend(b.collect())).trigger(**trigger).start() if trigger else df.writeStream.outputMode(mode).foreachBatch(lambda b, _: out.extend(b.collect())).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return out


def words(spark, *batches):
    return scripted(spark, "word string, ts_ms long", list(batches))


def test_total_counts(spark):
    df = words(spark, [("a", 0), ("b", 0)], [("a", 1)])
    last = run(W.word_counts(df, None), "update")
    assert {(r.word, r.cnt) for r in last} == {("a", 1), ("b", 1), ("a", 2)}


def test_unbounded_aggregation_needs_a_window(spark):
    with pytest.raises(Exception, match="UNSUPPORTED_OPERATION|watermark"):
        run(W.word_counts(words(spark, [("a", 0)]), None), "append")


def test_top_k(spark):
    df = words(spark, [("line", 0), ("line", 1), ("in", 2)], [("x", 10_000)], [("end", 10**7)], [("end", 2 * 10**7)])
    got = {(r.word, r.cnt) for r in run(W.top_k_by_window(df, 1, "10 seconds")) if r.word != "end"}
    assert got == {("line", 2), ("x", 1)}


def test_top_k_of_parts(spark, monkeypatch):
    """More words than k in few parts, ties among them, and no aggregate of all of a window's words."""
    rows = [(f"w{i}", i) for i in range(30) for _ in range(i % 5 + 1)]
    monkeypatch.setattr(W, "SALTS", 3)
    df = words(spark, rows, [("end", 10**7)], [("end", 2 * 10**7)])
    out = W.top_k_by_window(df, 4, "10 seconds")
    assert "salt" in out._jdf.queryExecution().analyzed().toString()
    got = {(r.word, r.cnt) for r in run(out) if r.word != "end"}
    assert got == {(f"w{i}", 5) for i in (9, 4, 29, 24)}


def test_sliding_means(spark):
    df = words(spark, [("a", 0), ("bb", 1999)], [("ccc", 5000), ("dddd", 10_000)], [("", 10**7)], [("", 2 * 10**7)])
    assert Counter(r.mean_length for r in run(W.sliding_mean_length(df, "10 seconds", "2 seconds", "1 minute")) if r.mean_length) == {1.5: 2, 2.0: 3, 3.5: 2, 4.0: 3}


def test_results_so_far(spark):
    batches = [[("a", 0)], [("bb", 1)], [("ccc", 2)], [("d", 3)]]
    assert [r.longest for r in run(W.longest_so_far(words(spark, *batches)), "complete")] == ["a", "bb", "ccc", "ccc"]
    assert [r.mean_length for r in run(W.mean_length_so_far(words(spark, *batches[:3])), "complete")] == [1.0, 1.5, 2.0]


def test_processing_time_counts(spark):
    counts = []
    q = W.processing_time_counts(words(spark, [("a", 0), ("b", 0)], [("c", 1)]), counts, "0 seconds").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sum(counts) == 3


def positions(spark, *batches):
    df = scripted(spark, "key string, lat double, lon double, ts_ms long", [[(k, a, b, t) for k, a, b, t in x] for x in batches])
    return df.withWatermark("ts", "0 seconds")


@pytest.mark.parametrize("stamp", ["end", "start"])
def test_pieces_equal_batch(spark, stamp):
    points = walks()
    want = sorted((r.key, round(r.length, 4), r.duration, r.ts) for r in tracks.to_metric(spark.createDataFrame(points, POSITION), stamp=stamp).collect())
    mixed = [points[4], points[0], points[3]], [points[1], points[2], *points[5:]]
    got = run(P.to_metric_stream(positions(spark, *mixed, [(WATERMARK, 0.0, 0.0, FAR)], [(WATERMARK, 0.0, 0.0, FAR + 1)]), stamp=stamp).where(F.col("key") != WATERMARK).withColumn("ts", F.unix_millis("ts")))
    # all points of the first batches arrive under one watermark only if it hasn't passed them
    assert len({r.key for r in got}) == 2
    early = run(P.to_metric_stream(positions(spark, points, [(WATERMARK, 0.0, 0.0, FAR)], [(WATERMARK, 0.0, 0.0, FAR + 1)]), stamp=stamp).where(F.col("key") != WATERMARK).withColumn("ts", F.unix_millis("ts")))
    assert sorted((r.key, round(r.length, 4), r.duration, r.ts) for r in early) == want


def test_alerts_equal_batch(spark, tmp_path):
    """Pieces as a stream, joined by window ends."""
    points = walks()
    m = [(r.key, r.length, r.duration, r.ts) for r in tracks.to_metric(spark.createDataFrame(points, POSITION)).collect()]
    df = scripted(spark, "key string, length double, duration long, ts_ms long", [m, [(WATERMARK, 1.0, 1, FAR)], [(WATERMARK, 1.0, 1, FAR + 10**7)], *[[(WATERMARK, 1.0, 1, FAR + i * 10**7)] for i in range(2, 6)]])
    got = [r for r in run(W.alerts(df)) if r.key != WATERMARK]
    assert sorted((r.key, r.is_up) for r in got) == sorted((k, up) for k, _, up in plain_alerts(points))


def test_late_split(spark):
    """Lateness is judged by the watermark, also of a window's first row."""
    batches = [[("a", 1)], [(WATERMARK, 1999)], [("b", 999)], [(WATERMARK, 2000)], [("c", 0)]]
    df = scripted(spark, "value string, ts_ms long", batches).withColumn("key", F.lit("k"))
    out = run(P.late_split_stream(df.drop("ts"), 1000, 1000))
    assert {r.value: r.droppable for r in out if r.value != WATERMARK} == {"a": False, "b": False, "c": True}


@pytest.mark.parametrize("seed", [0, 3])
def test_changelog_join(spark, seed):
    """Each pk under one join key, changes in any order of arrival, several at one time."""
    changes = [(s, p, "ABC"[ord(p) % 3], v, d + 1, g) for s, p, _, v, d, g in random_changes(seed)]
    marks = [[("left", WATERMARK, WATERMARK, "", 99 * DAY, False)], [("left", WATERMARK, WATERMARK, "", 100 * DAY, False)]]
    df = scripted(spark, "side string, pk string, join_key string, value string, ts_ms long, is_delete boolean", [[(s, p, k, v, d * DAY, g) for s, p, k, v, d, g in changes], *marks])
    out = run(P.changelog_join_stream(df.withWatermark("ts", "0 seconds")))
    got = Counter((r.sign, r.join_key, r.left_pk, r.right_pk, r.left_value, r.right_value, r.ts_ms // DAY) for r in out if r.join_key != WATERMARK)
    both = lambda c: Counter({k: n for k, n in c.items() if ("-" if k[0] == "+" else "+", *k[1:]) not in c})
    assert both(got) == both(replayed(changes))


def plain_track(points):
    once = sorted({p[2]: p for p in sorted(points, key=lambda p: (p[2], *p[:2]), reverse=True)}.values(), key=lambda p: p[2])
    return round(sum(plain_distance(a[:2], b[:2]) for a, b in zip(once, once[1:], strict=False)), 6), once[-1][2] - once[0][2]


def test_tracker_gives_all_so_far_after_a_time(spark):
    """Positions late and in place, of equal times, in other hours; a result accumulates."""
    at = [(0.001 * (i * 7 % 11), 0.001 * (i * 5 % 13), T0 + i * 600_000) for i in range(24)]
    batches = [at[3:9:2], at[:3], [at[5], (0.0, 0.0, at[5][2])], at[9:24:3], at[4:20]]
    df = scripted(spark, "key string, lat double, lon double, ts_ms long", [[("k", *x) for x in b] for b in batches]).drop("ts")
    out = []
    q = P.tracker_stream(df, every_ms=1).writeStream.trigger(processingTime="0 seconds").foreachBatch(lambda b, _: out.extend(b.collect())).start()
    want = plain_track([x for b in batches for x in b])
    try:
        while not out or (round(out[-1].distance, 6), out[-1].duration) != want:
            q.awaitTermination(0.5)
    finally:
        q.stop()
    so_far = [plain_track([x for b in batches[:n] for x in b]) for n in range(1, 6)]
    assert [r for r in ((round(x.distance, 6), x.duration) for x in out) if r not in so_far] == []


M = 60_000
BASE = T0 - T0 % (10 * M)


def panes(spark, spec, *batches, early=False):
    df = scripted(spark, "key string, word string, ts_ms long", [[("k", w, BASE + t) if w != WATERMARK else (WATERMARK, w, BASE + t) for w, t in b] for b in batches])
    out = run(word_panes(df, spec, early=early).withColumn("ms", F.unix_millis("stamp")).withColumn("from", F.unix_millis("start")))
    return [((r["from"] - BASE) // M, r.pane, r.cnt, r.longest, r.ms - BASE) for r in out if r.key != WATERMARK]


@pytest.mark.parametrize("accumulate", [False, True])
@pytest.mark.parametrize("stamp", ["end", "latest"])
def test_panes_on_time_late_and_dropped(spark, accumulate, stamp):
    spec = WindowSpec("10 minutes", lateness="5 minutes", accumulate=accumulate, stamp=stamp)
    mark = lambda m: [(WATERMARK, m * M)]
    got = panes(spark, spec, [("a", M), ("bbb", 2 * M)], mark(11), mark(11), [("cc", 3 * M)], mark(12), [("d", 4 * M)], mark(16), mark(16), [("gone", 5 * M)], mark(40), mark(41))
    at = lambda latest: 10 * M - 1 if stamp == "end" else latest * M
    if accumulate:
        assert got == [(0, "on_time", 2, "bbb", at(2)), (0, "late", 3, "bbb", at(3)), (0, "late", 4, "bbb", at(4))]
    else:
        assert got == [(0, "on_time", 2, "bbb", at(2)), (0, "late", 1, "cc", at(3)), (0, "late", 1, "d", at(4))]


@pytest.mark.parametrize("on_empty", [False, True])
def test_an_empty_pane_at_the_end(spark, on_empty):
    spec = WindowSpec("10 minutes", accumulate=True, on_empty=on_empty)
    got = panes(spark, spec, [("a", M)], [("bb", 2 * M)], [(WATERMARK, 11 * M)], [(WATERMARK, 12 * M)], early=True)
    assert [x[1:4] for x in got] == [("early", 1, "a"), ("early", 2, "bb")] + [("on_time", 2, "bb")] * on_empty


def test_buffered_late_split(spark):
    """A row that came in time but is judged after the watermark has passed it is late; blanks are markers."""
    df = scripted(spark, "value string, ts_ms long", [[("a", 1), ("b", 2500)], [(" ", 9000)], [("c", 100), ("d", 9001)]]).withColumn("key", F.lit("k")).drop("ts")
    out = []
    q = P.buffered_late_split_stream(df, 1000, 1000, wait_ms=1).writeStream.trigger(processingTime="0 seconds").foreachBatch(lambda b, _: out.extend(b.collect())).start()
    try:
        while len(out) < 4:
            q.awaitTermination(0.5)
    finally:
        q.stop()
    late = {r.value: r.droppable for r in out}
    assert late["a"] and late["c"] and not late["d"]


def test_filters_keep_the_watermark(spark):
    """All rows of a stream are dropped, and its watermark moves on."""
    df = words(spark, [("a", T0)], [("b", T0 + 1000)], [("c", T0 + 2000)]).withWatermark("ts", "0 seconds")
    marks = []
    q = df.where("word > 'zzz'").dropDuplicatesWithinWatermark(["word"]).writeStream.foreachBatch(lambda b, _: marks.append(b.count())).start()
    try:
        q.processAllAvailable()
        assert sum(marks) == 0 and q.isActive
    finally:
        q.stop()


def test_decoders_move_the_watermark(spark):
    """The greatest time of a good position less the delay; bad ones don't move it."""
    batches = [[("", f"u\t1.0\t2.0\t{T0}")], [("", "u\tbad"), ("", f"v\t1.0\t2.0\t{T0 + 5000}")], [("", f"u\t1.0\tx\t{T0 + 10**9}")], [("", f"u\t1.0\t2.0\t{T0 + 1000}")]]
    df = readers.positions_from_values(scripted(spark, "key string, value string", batches))
    got = []
    q = df.dropDuplicatesWithinWatermark(["key", "ts"]).writeStream.foreachBatch(lambda b, _: got.extend(b.collect())).start()
    try:
        q.processAllAvailable()
        marks = [p["eventTime"].get("watermark") for p in q.recentProgress if p["eventTime"]]
    finally:
        q.stop()
    assert datetime.fromisoformat(marks[-1].replace("Z", "+00:00")) == datetime.fromtimestamp((T0 + 4900) / 1000, UTC)
    assert [r.key for r in got] == ["u", "v"]


def test_tee_and_console(spark):
    df = words(spark, [("a", 0), ("b", 1)])
    teed = sinks.tee(df, "seen", words=F.count("*"), longest=F.max("word"))
    q = teed.writeStream.foreachBatch(lambda b, _: b.collect()).start()
    try:
        q.processAllAvailable()
        seen = [p["observedMetrics"]["seen"] for p in q.recentProgress if p["observedMetrics"]]
    finally:
        q.stop()
    assert sum(r["words"] for r in seen) == 2
    q = sinks.write_console(words(spark, [("a", 0)])).start()
    q.processAllAvailable()
    q.stop()


def test_rekeying(spark):
    df = scripted(spark, "side string, pk string, join_key string, value string, ts_ms long", [[("left", "a", "CA", "1", 1000)], [("left", "a", "NY", "2", 5000)]])
    out = run(P.rekey_stream(df.withColumn("is_delete", F.lit(False)).withWatermark("ts", "1 day")))
    assert [(r.join_key, r.is_delete) for r in out] == [("CA", False), ("CA", True), ("NY", False)]


def test_batched_calls(spark):
    df = scripted(spark, "value string, ts_ms long", [[(w, i) for i, w in enumerate(["a", "bb", "ccc", "aa"])], [(w, 9) for w in ["c", "bbb", "aa"]], [("z", 10)], [("zz", 11)]])
    out = []
    q = P.enrich_stream(df, E.lengths_service, buckets=2, batch=2, wait_ms=1).writeStream.trigger(processingTime="0 seconds").foreachBatch(lambda b, _: out.extend(b.collect())).start()
    try:  # timers fire on triggers without data too, so such a query is never idle
        while len(out) < 9:
            q.awaitTermination(0.5)
    finally:
        q.stop()
    assert Counter((r.value, r.output) for r in out) == Counter((w, len(w)) for w in ["a", "bb", "ccc", "aa", "c", "bbb", "aa", "z", "zz"])


def test_watching_a_directory(spark, tmp_path):
    (tmp_path / "a-7").write_text("one\ntwo")
    seen = []
    hour = F.timestamp_seconds(F.regexp_extract("file", r"-(\d+)$", 1).cast("long") * 3600)
    df = readers.watch_lines(spark, f"file://{tmp_path}", time=hour, delay="0 seconds")
    q = df.writeStream.foreachBatch(lambda b, _: seen.extend(b.select("line", "file", F.unix_seconds("ts").alias("s")).collect())).start()
    try:
        q.processAllAvailable()
        (tmp_path / "b-9").write_text("three")
        q.processAllAvailable()
        assert readers.stop_after(q, datetime.fromtimestamp(9 * 3600, UTC), 0.2, 20) and not q.isActive
    finally:
        q.stop()
    assert sorted((r.line, r.s // 3600) for r in seen) == [("one", 7), ("three", 9), ("two", 7)] and len({r.file for r in seen}) == 2
    again = []
    q = readers.watch_lines(spark, f"file://{tmp_path}").writeStream.trigger(availableNow=True).foreachBatch(lambda b, _: again.extend(b.collect())).start()
    assert q.awaitTermination(30) and len(again) == 3  # a bounded run ends by itself
