"""Streaming results over several micro-batches against the batch operators on the same rows."""

import json

from pyspark.sql import functions as F

from echoloom.operators.chunks import chunk_of
from echoloom.operators.detector import Policy, detect
from echoloom.operators.evaluation import listening_states, wake_sessions
from echoloom.streaming import detector as S

SCORES = "stream long, step long, seq long, ts timestamp, p double, gated boolean"


def score_files(spark, path, n=240, batches=3):
    base = spark.range(n * 4).select(
        (F.col("id") % 4).alias("stream"), F.floor(F.col("id") / 4).alias("step"), F.col("id").alias("seq"),
        (86400 + F.col("id") / 10.0).cast("timestamp").alias("ts"),
        (F.abs(F.hash("id")) % 1000 / 1000.0).alias("p"), (F.abs(F.hash("id", F.lit(1))) % 9 == 0).alias("gated"))
    base = base.persist()
    for b in range(batches):
        lo, hi = n * b // batches, n * (b + 1) // batches
        base.filter((F.col("step") >= lo) & (F.col("step") < hi)).coalesce(1).write.mode("append").parquet(f"{path}/b")
    return base


def test_streaming_detector_equals_batch(spark, tmp_path):
    rows = score_files(spark, str(tmp_path))
    for policy in (Policy(0.9), Policy(0.6, agg="ema", need=2, span=3), Policy(0.9, variant="engine", span=3)):
        src = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/b")
        got = {(r.stream, r.step) for r in S.run_to_table(S.triggers(src, policy), "t").collect()}
        want = {(r.stream, r.step) for r in detect(rows.select("stream", "step", "p", "gated"), [policy], size=64).collect()}
        assert got == want and want


def test_micro_batches_with_carried_state_equal_batch(spark, tmp_path):
    rows = score_files(spark, str(tmp_path), n=300, batches=4)
    for i, policy in enumerate((Policy(0.9), Policy(0.6, agg="ema", need=2, span=3, refractory=4),
                                Policy(0.95, variant="engine", span=3, refractory=40))):
        src = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/b")
        out = S.run_micro_batches(src.select("stream", "ts", "seq", "p", "gated"), policy, f"{tmp_path}/o{i}")
        got = sorted((r.stream, r.step) for r in out.collect())
        want = sorted((r.stream, r.step) for r in detect(rows.select("stream", "step", "p", "gated"), [policy]).collect())
        assert got == want and want
        assert out.select("batch").distinct().count() > 1


def messages(spark, n=300):
    k = F.abs(F.hash("id")) % 10
    return spark.range(n).select(
        (F.col("id") % 3).alias("stream"), F.floor(F.col("id") / 3).alias("step"), F.col("id").alias("seq"),
        (86400 + F.col("id")).cast("timestamp").alias("ts"), (F.col("id") * 1000).alias("ts_ms"),
        F.when(k == 0, "wake").when(k == 1, "end").otherwise("audio").alias("kind"), (k * 100).cast("long").alias("bytes"),
        F.lit(False).alias("quiet"))


def test_streaming_sessions_equal_batch(spark, tmp_path):
    rows = messages(spark)
    for b in range(3):
        rows.filter((F.col("step") >= b * 34) & (F.col("step") < b * 34 + 34)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/m")
    src = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/m")
    cols = ["stream", "frames", "bytes", "duration_s"]
    got = sorted(tuple(r) for r in S.run_to_table(S.sessions(src), "s").select(*cols).collect())
    want = sorted(tuple(r) for r in wake_sessions(rows, chunk_of("step", 16)).select(*cols).collect())
    assert got == want and want


def test_silence_closes_a_session(spark):
    kinds = ["audio", "wake", "audio", "audio", "audio", "audio", "audio", "end"]
    quiet = [False, False, False, True, True, True, False, False]
    rows = [(1, i, k, 10, i * 100, q) for i, (k, q) in enumerate(zip(kinds, quiet))]
    df = spark.createDataFrame(rows, "stream int, step int, kind string, bytes long, ts_ms long, quiet boolean")
    r = wake_sessions(df, chunk_of("step", 4), silence_steps=3).collect()
    assert [(x.wake_step, x.end_step, x.frames, x.bytes) for x in r] == [(1, 5, 4, 40)]


def test_a_new_wake_drops_the_open_session(spark):
    kinds = ["wake", "audio", "wake", "audio", "audio", "end", "audio"]
    df = spark.createDataFrame([(1, i, k, 7, i, False) for i, k in enumerate(kinds)],
                               "stream int, step int, kind string, bytes long, ts_ms long, quiet boolean")
    r = wake_sessions(df, chunk_of("step", 2)).collect()
    assert [(x.wake_step, x.frames, x.bytes) for x in r] == [(2, 2, 14)]


def test_control_messages(spark):
    rows = [(json.dumps({"event": "wake_detected", "timestamp_ms": 5}), None), ("not json", None), (None, bytearray(b"abcd")),
            (json.dumps({"event": "end_of_speech"}), None)]
    df = spark.createDataFrame(rows, "body string, frame binary")
    got = sorted((r.kind, r.bytes, r.edge_ms) for r in S.parse_control(df).collect() if r.kind != "x")
    assert [g[0] for g in got] == ["audio", "end", "wake"] and got[0][1] == 4 and got[2][2] == 5


def test_listening_states_capture_the_preroll(spark):
    s = spark.range(10).select(F.lit(1).alias("stream"), F.col("id").alias("step"))
    d = spark.createDataFrame([(1, 5), (1, 8)], "stream int, step long")
    got = {r.step: (r.state, r.captured) for r in listening_states(s, d).collect()}
    assert [k for k, v in got.items() if v[1]] == [3, 4, 5, 6, 7, 8, 9]
    assert [k for k, v in got.items() if v[0] == "STREAMING"] == [6, 7, 8, 9]


def test_late_rows_are_dropped_and_state_expires(spark, tmp_path):
    def batch(stream, seconds, p):
        rows = spark.range(5).select(F.lit(stream).cast("long").alias("stream"), (86400 + seconds + F.col("id") / 10.0).cast("timestamp").alias("ts"),
                                     F.col("id").alias("seq"), F.lit(p).alias("p"), F.lit(False).alias("gated"))
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/b")
        return rows.schema
    batch(1, 100_000, 0.0)
    batch(1, 200_000, 0.0)
    batch(1, 100_000, 0.99)              # far behind the watermark
    batch(2, 500_000, 0.0)
    batch(2, 510_000, 0.0)               # by now stream 1 has been silent for too long
    schema = batch(1, 600_000, 0.99)
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/b")
    got = S.run_to_table(S.triggers(src, Policy(0.9), idle_ms=3_600_000), "late").collect()
    assert [(r["ts"].timestamp(), r["step"]) for r in got] == [(86400 + 600_000 + 0.1, 1)]


def test_a_pause_closes_a_session(spark, tmp_path):
    rows = [(1, 10, "wake"), (1, 11, "audio"), (1, 12, "audio"), (1, 60, "audio"), (1, 61, "end"), (1, 70, "wake"), (1, 71, "audio"), (1, 72, "end")]
    df = spark.createDataFrame(rows, "stream long, s long, kind string").select(
        "stream", (86400 + F.col("s")).cast("timestamp").alias("ts"), F.col("s").alias("seq"), "kind", F.lit(100).cast("long").alias("bytes"), (F.col("s") * 1000).alias("ts_ms"))
    df.coalesce(1).write.parquet(f"{tmp_path}/m")
    src = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/m")
    closed = sorted((r["wake_ms"], r["frames"]) for r in S.run_to_table(S.sessions(src(), silence_ms=5000), "s").collect())
    assert closed == [(10_000, 2), (70_000, 1)]
    assert sorted((r["wake_ms"], r["frames"]) for r in S.run_to_table(S.sessions(src()), "s").collect()) == [(10_000, 3), (70_000, 1)]


class _Store:
    """Value and timers of one key; counts the calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, *_):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def test_timers_stay_until_due_and_values_end_on_time():
    from types import SimpleNamespace as N
    store, d = _Store(), S.Detector(Policy(0.5), 1000)
    d.init(store)
    at = lambda ms: N(getCurrentWatermarkInMs=lambda: ms)                       # noqa: E731
    rows = lambda ms: iter([N(us=ms * 1000, seq=0, p=0.1, gated=False)])        # noqa: E731
    list(d.handleInputRows((1,), rows(100), at(0)))
    store.calls = 0
    list(d.handleInputRows((1,), rows(600), at(100)))
    assert store.calls == 2 and store.timers == {1100} and store.value[0] == 2   # one reading, one writing
    store.timers.remove(1100)                                                    # it fires: the value has 500 ms to go
    assert list(d.handleExpiredTimer((1,), at(1200), None)) == [] and store.timers == {1600} and store.value is not None
    assert list(d.handleExpiredTimer((1,), at(1600), None)) == [] and store.value is None
    store, s = _Store(), S.Sessions(50, 1000)
    s.init(store)
    message = lambda ms, kind: iter([N(us=ms * 1000, seq=0, ts_ms=ms, kind=kind, bytes=4)])      # noqa: E731
    list(s.handleInputRows((1,), message(100, "audio"), at(0)))
    list(s.handleInputRows((1,), message(200, "wake"), at(100)))
    assert store.timers == {250}                                                 # a pause ends sooner than the idle time: moved
    list(s.handleInputRows((1,), message(240, "audio"), at(200)))
    assert store.timers == {250}
    store.timers.remove(250)
    assert list(s.handleExpiredTimer((1,), at(260), None)) == [] and store.timers == {290}
    assert [r.frames for r in s.handleExpiredTimer((1,), at(290), None)] == [1] and store.value is None
