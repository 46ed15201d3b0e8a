"""D10 and D13 as Structured Streaming queries over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from echoloom.catalog.adapters import EV, detector_sql, r6, table
from echoloom.catalog.q_streams import MSG_SQL
from echoloom.catalog.registry import query
from echoloom.operators.detector import Policy, engine_policy
from echoloom.session import scratch_path
from echoloom.streaming import detector as S

SLICES, FILES = 4, 4
SCAN = Policy(0.68)
ENGINE = engine_policy(0.68, 2, 3)
SILENCE_MS = 6 * 3600 * 1000


def arrivals(spark, events, closing=False):
    """A folder in which ``events`` arrive slice of time after slice of time, about equal numbers of rows each. The rows of a stream
    in a slice lie in one of several files. Rows without a time come first. ``closing`` adds a last message a day later to every stream."""
    path = scratch_path(spark, "arrivals")
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = events.select(ts.alias("us")).approxQuantile("us", [(i + 1) / SLICES for i in range(SLICES - 1)], 0.01)
    part = sum((F.coalesce(ts >= F.lit(int(c)), F.lit(False)).cast("int") for c in cuts), F.lit(0))
    for i in range(SLICES):
        events.filter(part == i).repartition(FILES, "user_id").write.option("maxRecordsPerFile", 1_000_000).mode("append").parquet(path)
    if closing:
        last = events.agg(F.max("ts")).scalar() + F.expr("interval 1 day")
        kinds = {"user_id": F.col("user_id"), "ts": last, "event_id": F.lit(-1), "event_type": F.lit("view"), "value": F.lit(0.0)}
        streams = events.select("user_id").distinct()
        streams.select(*(kinds.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema.fields)).repartition(FILES, "user_id").write.mode("append").parquet(path)
    return path


def event_stream(spark, sf, untimed=None, closing=False):
    """The events as a stream of several micro-batches of several files; the event id orders equal times. Events for which
    ``untimed`` holds lose their time."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    if untimed is not None:
        events = events.withColumn("ts", F.when(~untimed, F.col("ts")))
    path = arrivals(spark, events, closing)
    ev = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", FILES).parquet(path)
    return ev.select(F.col("user_id").alias("stream"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
                     F.least(F.lit(1.0), F.col("value") / 150.0).alias("p"), (F.col("value") < 5.0).alias("gated"),
                     F.col("event_type").alias("class"), "value",
                     F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")) / 1000).alias("ts_ms"))


@query("d10_streaming_detector", f"WITH RECURSIVE {EV}, {detector_sql([SCAN])} SELECT stream, step FROM det")
def d10(spark, sf):
    t = S.triggers(event_stream(spark, sf).select("stream", "ts", "seq", "p", "gated"), SCAN)
    return S.run_to_table(t, "triggers").select("stream", "step")


@query("d10_streaming_engine_detector", f"""WITH RECURSIVE {EV}, eu AS (SELECT * REPLACE (false AS gated) FROM ev), {detector_sql([ENGINE], 'eu')}
SELECT stream, step FROM det""")
def d10b(spark, sf):
    s = event_stream(spark, sf).select("stream", "ts", "seq", "p", F.lit(False).alias("gated"))
    return S.run_to_table(S.triggers(s, ENGINE), "triggers").select("stream", "step")


TIMED = EV.replace("FROM events)", "FROM events WHERE event_id % 50 <> 7)")


@query("d10_streaming_untimed_rows", f"""WITH RECURSIVE {TIMED}, {detector_sql([SCAN])}
SELECT (SELECT count(*) FROM events) AS n, (SELECT count(*) FROM events WHERE event_id % 50 = 7) AS untimed, count(*) AS triggers FROM det""")
def d10d(spark, sf):
    """Rows without a time take no part and are counted."""
    ev = event_stream(spark, sf, untimed=F.col("event_id") % 50 == 7)
    found = S.run_to_table(S.triggers(ev.select("stream", "ts", "seq", "p", "gated"), SCAN), "triggers")
    read = table(spark, sf, "events").select(F.when(F.col("event_id") % 50 != 7, F.col("ts")).alias("ts"))
    return S.untimed(read).withColumn("triggers", found.agg(F.count(F.lit(1))).scalar())


@query("d10_streaming_micro_batches", f"WITH RECURSIVE {EV}, {detector_sql([SCAN])} SELECT stream, step FROM det")
def d10c(spark, sf):
    scores = event_stream(spark, sf).select("stream", "ts", "seq", "p", "gated")
    return S.run_micro_batches(scores, SCAN, scratch_path(spark, "micro-batches")).select("stream", "step")


@query("d13_streaming_wake_sessions", f"""WITH {EV}, {MSG_SQL},
m AS (SELECT *, max(CASE WHEN kind = 'wake' THEN step END) OVER (PARTITION BY stream ORDER BY step) AS wk,
  max(CASE WHEN kind = 'end' THEN step END) OVER (PARTITION BY stream ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS en FROM msg),
s AS (SELECT stream, wk, min(ts_ms) FILTER (kind = 'wake') AS wake_ms, count(*) FILTER (kind = 'audio') AS frames, coalesce(sum(bytes) FILTER (kind = 'audio'), 0)::BIGINT AS bytes,
  min(ts_ms) FILTER (kind = 'audio') AS a, bool_or(kind = 'end') AS done FROM m WHERE wk IS NOT NULL AND coalesce(en, -1) < wk GROUP BY ALL)
SELECT stream, wake_ms, frames, bytes, round(bytes / 32000, 8) AS duration_s, a - wake_ms AS first_packet_delta_ms FROM s WHERE done""")
def d13(spark, sf):
    return _sessions(event_stream(spark, sf))


def _sessions(ev, silence_ms=None):
    kind = F.when(F.col("class") == "signup", "wake").when(F.col("class") == "purchase", "end").otherwise("audio")
    msgs = ev.select("stream", "ts", "seq", kind.alias("kind"), (F.floor(F.col("value") * 100) * 2).alias("bytes"), "ts_ms")
    t = S.run_to_table(S.sessions(msgs, silence_ms=silence_ms), "sessions")
    return t.withColumn("duration_s", r6("duration_s", 8))


@query("d13_streaming_silence", f"""WITH {EV}, {MSG_SQL},
g AS (SELECT *, coalesce(ts_ms - lag(ts_ms) OVER (PARTITION BY stream ORDER BY step) > {SILENCE_MS}, false)::INT AS brk FROM msg),
b AS (SELECT *, sum(brk) OVER (PARTITION BY stream ORDER BY step) AS run FROM g),
m AS (SELECT *, max(CASE WHEN kind = 'wake' THEN step END) OVER (PARTITION BY stream, run ORDER BY step) AS wk,
  max(CASE WHEN kind = 'wake' THEN step END) OVER (PARTITION BY stream, run) AS lastwk,
  max(CASE WHEN kind = 'end' THEN step END) OVER (PARTITION BY stream, run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS en FROM b),
s AS (SELECT stream, run, wk, min(ts_ms) FILTER (kind = 'wake') AS wake_ms, count(*) FILTER (kind = 'audio') AS frames, coalesce(sum(bytes) FILTER (kind = 'audio'), 0)::BIGINT AS bytes,
  min(ts_ms) FILTER (kind = 'audio') AS a, bool_or(kind = 'end') OR wk = any_value(lastwk) AS done FROM m WHERE wk IS NOT NULL AND coalesce(en, -1) < wk GROUP BY stream, run, wk)
SELECT stream, wake_ms, frames, bytes, round(bytes / 32000, 8) AS duration_s, a - wake_ms AS first_packet_delta_ms FROM s WHERE done""")
def d13_silence(spark, sf):
    """Sessions end by message or by a pause of six hours; a last message a day later closes what is still open."""
    return _sessions(event_stream(spark, sf, closing=True), SILENCE_MS)
