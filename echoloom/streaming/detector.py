"""Detector and wake sessions as stateful streaming queries."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from echoloom.operators.detector import Policy, detect
from echoloom.operators.running import ordinal_by_bucket, time_bucket
from echoloom.session import materialize, scratch_path

STATE = "step long, hold double, mean double, hits long, lock long, until long, timer long"
OUT = "stream {}, step long, score double, us long"
#: state of a stream is kept so long after its last row (event time)
IDLE_MS = 30 * 24 * 3600 * 1000
#: keyed state with timers lives in this store
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _keyed_store(spark: SparkSession):
    """The store is a setting of the session, read when a streaming query starts."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _in_order(rows: Iterable[Row], watermark_ms: int) -> list[Row]:
    """The rows of one key in one micro-batch that are not behind the watermark, by time.

    The trigger's file or offset limit bounds them. Spark itself lets through what came late only by the last batch's watermark.
    """
    return sorted((r for r in rows if r.us >= watermark_ms * 1000), key=lambda r: (r.us, r.seq))


class Expiring(StatefulProcessor):
    """One value per key that goes ``idle_ms`` after the key's last row; a timer of the event time ends it.

    Every call to the store is a round trip. So a timer that is due before the value goes stays where it is, and
    moves when it fires; only one that would be late is replaced.
    """

    state_schema = ""

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("value", self.state_schema)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        raise NotImplementedError

    def current(self, fresh: tuple) -> tuple:
        """The value, its last field (the timer) included; ``fresh`` if there is none."""
        value = self.state.get()
        return (*fresh, 0) if value is None else (*tuple(value)[:-2], value[-1])

    def keep(self, value: tuple, timer_ms: int, until_ms: int) -> None:
        """Store the value with its end, and see that a timer is due by then."""
        if not timer_ms or timer_ms > until_ms:
            if timer_ms:
                self.handle.deleteTimer(timer_ms)
            self.handle.registerTimer(until_ms)
            timer_ms = until_ms
        self.state.update((*value, until_ms, timer_ms))

    def ended(self, watermark_ms: int) -> tuple | None:
        """When the timer fires: the value if its end has come, and it is gone; else the timer moves to its end."""
        value = self.state.get()
        if value is None:
            return None
        *value, until, _ = tuple(value)
        if until > watermark_ms:
            self.handle.registerTimer(until)
            self.state.update((*value, until, until))
            return None
        self.state.clear()
        return tuple(value)

    def close(self) -> None:
        pass


def advance(state, p: float, gated: bool, policy: Policy):
    """One step of the detector: (new state, score if it triggered else None)."""
    step, hold, mean, hits, lock = state
    lock = max(lock - 1, 0)
    x = 0.0 if gated else p
    hold = max(x, hold * policy.decay)
    mean = policy.alpha * x + (1.0 - policy.alpha) * mean
    score = hold if policy.agg == "maxhold" else mean
    hit = (not gated) and score >= policy.threshold
    hits = ((hits << 1) | int(hit)) & ((1 << policy.span) - 1)
    fires = (not gated and lock == 0 and hits.bit_count() >= policy.need
             and (policy.variant == "scan" or hit))
    if fires:
        lock, hits = policy.refractory, 0
        if not policy.keep_score:
            hold = mean = 0.0
    return (step + 1, hold, mean, hits, lock), (score if fires else None)


class Detector(Expiring):
    """Steps of a stream taken one by one; five numbers are carried from one micro-batch to the next."""

    state_schema = STATE

    def __init__(self, policy: Policy, idle_ms: int):
        self.policy, self.idle_ms = policy, idle_ms

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        mine = _in_order(rows, watermark)
        if not mine:
            return
        *cur, timer = self.current((0, 0.0, 0.0, 0, 0))
        cur = tuple(cur)
        for r in mine:
            at = cur[0]
            cur, score = advance(cur, r.p, r.gated, self.policy)
            if score is not None:
                yield Row(stream=key[0], step=at, score=score, us=r.us)
        self.keep(cur, timer, max(mine[-1].us // 1000, watermark) + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.ended(timerValues.getCurrentWatermarkInMs())
        return iter(())


def triggers(scores: DataFrame, policy: Policy, watermark: str = "10 minutes", idle_ms: int = IDLE_MS) -> DataFrame:
    """Trigger stream from a score stream (stream, ts, seq, p, gated).

    State per stream is five numbers and is dropped ``idle_ms`` after the stream's last row. Rows
    behind the watermark, and rows without a time, are dropped (:func:`untimed` counts the latter). The others are
    ordered by time within a micro-batch and taken in arrival order between micro-batches; the result equals the
    batch detector for in-order input. One task handles a stream's rows of one micro-batch, so limit the trigger (files,
    bytes or offsets), or use :func:`run_micro_batches` when a single stream is too hot for that.
    """
    kind = scores.schema["stream"].dataType.simpleString()
    timed = scores.withWatermark("ts", watermark).filter("ts IS NOT NULL").withColumn("us", F.unix_micros("ts"))
    found = timed.groupBy("stream").transformWithState(
        statefulProcessor=Detector(policy, idle_ms), outputStructType=OUT.format(kind), outputMode="Append", timeMode="EventTime")
    return found.select("stream", "step", "score", F.timestamp_micros("us").alias("ts"))


def untimed(rows: DataFrame) -> DataFrame:
    """How many rows a stream source gave, and how many of them have no time and so no place in any stream."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ts").isNull()).alias("untimed"))


CARRY = ("stream long, next_step long, last long, "
         "tail array<struct<step: bigint, p: double, gated: boolean>>")


def run_micro_batches(scores: DataFrame, policy: Policy, out: str, **trigger) -> DataFrame:
    """The detector for streams too hot for one task per micro-batch.

    Every micro-batch goes through the chunked batch detector. Between batches a small table per
    stream carries the next step, the last trigger and the look-back rows. Triggers and carried
    state are written under the batch number, so a repeated batch overwrites itself.
    """
    keep = policy.lookback + policy.span

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = (spark.read.schema(CARRY).parquet(f"{out}/state/{number - 1}") if number
                 else spark.createDataFrame([], CARRY))
        placed = ordinal_by_bucket(batch.withColumn("_us", F.unix_micros("ts")), ["stream"], ["_us", "seq"],
                                   time_bucket("_us"), "_i")
        fresh = materialize(placed.select("stream", F.col("_i").alias("step"), "p", "gated"), "micro-batch")
        offset = state.select("stream", "next_step")
        # steps count from the start of this micro-batch; carried rows lie below 0
        tail = state.select("stream", "next_step", F.explode("tail").alias("t")).select(
            "stream", (F.col("t.step") - F.col("next_step")).alias("step"), "t.p", "t.gated")
        enter = state.select("stream", (F.col("last") - F.col("next_step")).alias("last"))
        target = f"{out}/triggers/batch={number}"
        found = detect(fresh.unionByName(tail), [policy], enter=enter)
        shift = F.coalesce("next_step", F.lit(0))
        found.join(offset, "stream", "left").select("stream", (F.col("step") + shift).alias("step")).write.mode(
            "overwrite").parquet(target)
        fired = spark.read.schema("stream long, step long").parquet(target)

        rows = (fresh.unionByName(tail).join(offset, "stream", "left")
                .select("stream", (F.col("step") + shift).alias("step"), "p", "gated"))
        ends = (fresh.groupBy("stream").agg((F.max("step") + 1).alias("n")).join(offset, "stream", "left")
                .select("stream", (F.col("n") + shift).alias("next_step")))
        recent = (rows.join(ends, "stream").filter(F.col("step") >= F.col("next_step") - keep)
                  .groupBy("stream").agg(F.collect_list(F.struct("step", "p", "gated")).alias("tail")))
        last = fired.groupBy("stream").agg(F.max("step").alias("last"))
        moved = (ends.join(recent, "stream").join(last, "stream", "left")
                 .join(state.select("stream", F.col("last").alias("_old")), "stream", "left")
                 .select("stream", "next_step", F.coalesce("last", "_old").alias("last"), "tail"))
        moved.unionByName(state.join(ends, "stream", "left_anti")).write.mode("overwrite").parquet(f"{out}/state/{number}")

    q = (scores.writeStream.foreachBatch(each).option("checkpointLocation", f"{out}/progress")
         .trigger(**(trigger or {"availableNow": True})).start())
    q.awaitTermination()
    return scores.sparkSession.read.schema("stream long, step long, batch int").parquet(f"{out}/triggers")


SESSION_STATE = "wake_ms long, first_ms long, bytes long, frames long, live boolean, last_ms long, until long, timer long"
SESSION_OUT = "stream {}, wake_ms long, frames long, bytes long, duration_s double, first_packet_delta_ms long"


class Sessions(Expiring):
    """Messages of a stream taken one by one; the open session is carried to the next micro-batch."""

    state_schema = SESSION_STATE

    def __init__(self, silence_ms: int | None, idle_ms: int):
        self.silence_ms, self.idle_ms = silence_ms, idle_ms

    @staticmethod
    def closed(key, value: tuple) -> Row:
        wake, first, size, n, _, _ = value
        return Row(stream=key[0], wake_ms=wake, frames=n, bytes=size, duration_s=size / 32000.0, first_packet_delta_ms=first - wake if n else None)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        mine = _in_order(rows, watermark)
        if not mine:
            return
        wake, first, size, n, live, last, timer = self.current((0, -1, 0, 0, False, 0))
        silence = self.silence_ms
        for r in mine:
            if live and silence is not None and r.ts_ms - last > silence:
                yield self.closed(key, (wake, first, size, n, live, last))
                live = False
            last = r.ts_ms
            if r.kind == "wake":
                wake, first, size, n, live = r.ts_ms, -1, 0, 0, True
            elif live and r.kind == "end":
                yield self.closed(key, (wake, first, size, n, live, last))
                live = False
            elif live:
                first = r.ts_ms if n == 0 else first
                size, n = size + r.bytes, n + 1
        wait = silence if live and silence is not None else self.idle_ms
        self.keep((wake, first, size, n, live, last), timer, max(mine[-1].us // 1000, watermark) + wait)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        value = self.ended(timerValues.getCurrentWatermarkInMs())
        if value is not None and value[4] and self.silence_ms is not None:
            yield self.closed(key, value)


def sessions(messages: DataFrame, watermark: str = "10 minutes", silence_ms: int | None = None, idle_ms: int = IDLE_MS) -> DataFrame:
    """Finished wake sessions from control messages and audio frames (stream, ts, seq, kind, bytes).

    A session ends with its end message or, where ``silence_ms`` is given, with a longer pause between
    two messages; a timer ends it where no message follows. Late rows and rows without a time are dropped.
    """
    kind = messages.schema["stream"].dataType.simpleString()
    timed = messages.withWatermark("ts", watermark).filter("ts IS NOT NULL").withColumn("us", F.unix_micros("ts"))
    return timed.groupBy("stream").transformWithState(
        statefulProcessor=Sessions(silence_ms, idle_ms), outputStructType=SESSION_OUT.format(kind), outputMode="Append", timeMode="EventTime")


def parse_control(raw: DataFrame, body: str = "body") -> DataFrame:
    """Control JSON ``{event, timestamp_ms}`` and binary frames as one message table; text that is
    not JSON is dropped."""
    j = F.from_json(F.col(body), "event string, timestamp_ms long")
    kind = (F.when(j["event"] == "wake_detected", "wake").when(j["event"] == "end_of_speech", "end")
            .when(F.col("frame").isNotNull(), "audio"))
    return raw.withColumn("kind", kind).withColumn("edge_ms", j["timestamp_ms"]).withColumn(
        "bytes", F.coalesce(F.length("frame"), F.lit(0))).filter(F.col("kind").isNotNull())


def run_to_table(stream: DataFrame, label: str) -> DataFrame:
    """Process everything that is available, append to a table in the shared folder, read it back."""
    spark: SparkSession = stream.sparkSession
    path = scratch_path(spark, label)
    with _keyed_store(spark):
        q = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}-state")
             .trigger(availableNow=True).start(path))
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
