"""Scanning recordings with a model and keeping the windows it fires on.

A recording is one row: an array of samples, or raw bytes of 8-bit samples. It is cut into segments of a bounded
number of windows before any Python runs, so an hour-long recording is many rows; consecutive segments overlap
by the samples that their windows share. In a task, windows are views into the Arrow buffer: they are copied
only in batches for the model, after the energy gate, and never stored. With a cap, a task holds its best windows in a
bounded heap, and the heaps meet in one top-n. One pass gives both the windows found and the account of what was
scanned (samples, windows, scored windows).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoloom.operators.ranking import top_n
from echoloom.session import materialize

#: windows of a segment
SEGMENT = 512
#: windows given to the model at once
BATCH = 1024

Predict = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Scan:
    """What to scan for. ``every`` takes each so-many-th stride; ``whole`` takes one window per recording, zero-filled or cut."""

    window: int
    stride: int
    threshold: float
    gate: float | None = None
    every: int = 1
    keep: int | None = None
    whole: bool = False


@dataclass(frozen=True)
class Mined:
    """``found``: key, carried columns, ``step``, ``start``, ``p`` (and ``samples``); ``account``: one row per carried group."""

    found: DataFrame
    account: DataFrame


def _cut(x: Column, binary: bool, start: Column, length: Column) -> Column:
    if binary:
        return F.substring(x, (start + 1).cast("int"), length.cast("int"))
    return F.slice(x, (start + 1).cast("int"), length.cast("int"))


def segments(clips: DataFrame, key: str, x: str, scan: Scan, carry: list[str], per: int | None = None) -> DataFrame:
    """(key, carry, part, first, windows, own): rows of at most ``per`` windows.

    ``first`` is the step of the first window, ``own`` the samples that no earlier segment of the recording has.
    A recording of n samples has (n - window) // stride windows, of which each ``every``-th is taken.
    """
    per = per or SEGMENT
    binary = dict(clips.dtypes)[x] == "binary"
    n = F.coalesce(F.length(x) if binary else F.size(x), F.lit(0)).cast("long")
    if scan.whole:
        one = _cut(F.col(x), binary, F.lit(0), F.lit(scan.window))
        kept = clips.select(key, *carry, F.when(F.col(x).isNotNull(), one).alias("part"), n.alias("own"))
        return kept.withColumn("first", F.lit(0).cast("long")).withColumn("windows", (F.col("own") > 0).cast("int"))
    hop = scan.stride * scan.every
    steps = F.greatest(F.floor((n - scan.window) / scan.stride), F.lit(0))
    windows = F.ceil(steps / scan.every).cast("long")
    last = F.greatest(F.ceil(windows / per), F.lit(1)) - 1

    def piece(s: Column, count: Column, pieces: Column, size: Column) -> Column:
        here = F.least(F.lit(per).cast("long"), count - s * per)
        return F.struct(_cut(F.col(x), binary, s * (per * hop), F.when(here > 0, (here - 1) * hop + scan.window).otherwise(F.lit(0))).alias("part"),
                        (s * per * scan.every).alias("first"), F.greatest(here, F.lit(0)).cast("int").alias("windows"),
                        F.when(s < pieces, F.lit(per * hop).cast("long")).otherwise(size - s * (per * hop)).alias("own"))

    sized = clips.select(key, *carry, x, n.alias("n"), windows.alias("count"), last.alias("last"))
    pieces = F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda s: piece(s, F.col("count"), F.col("last"), F.col("n")))
    return sized.select(key, *carry, F.explode(pieces).alias("piece")).select(key, *carry, "piece.*")


class Heap:
    """The best rows of a task: score first, then key and start. Holds at most twice ``keep`` rows."""

    def __init__(self, keep: int):
        self.keep, self.rows = keep, []

    def add(self, rows: list[tuple]) -> None:
        self.rows += rows
        if len(self.rows) > 2 * self.keep:
            self.cut()

    def cut(self) -> list[tuple]:
        self.rows.sort(key=lambda r: (-r[-1][1], r[0] is not None, r[0], r[-1][0]))
        del self.rows[self.keep:]
        return self.rows


def _samples(column) -> Callable[[int], np.ndarray]:
    """Access to the samples of a row of an Arrow column of arrays or of 8-bit bytes, without a copy where possible."""
    import pyarrow as pa

    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return lambda i: (np.frombuffer(column[i].as_buffer(), np.uint8).astype(float) - 128.0) / 128.0
    flat = column.values.to_numpy(zero_copy_only=False)
    ends = column.offsets.to_numpy()
    return lambda i: np.asarray(flat[ends[i]:ends[i + 1]], float)


def scan_clips(clips: DataFrame, key: str, x: str, scan: Scan, predict: Predict, carry: list[str] | None = None, samples: bool = False,
               rebalance: bool = False) -> Mined:
    """Windows of ``clips`` that pass the gate and score ``threshold`` or more.

    ``predict`` maps a (windows, samples) matrix to probabilities; it is shipped once per task. ``samples`` keeps the samples
    of each window found, as training input. ``rebalance`` spreads the segments of long recordings over the tasks, at
    the price of moving the samples once. A NULL recording has no samples and no windows; a NULL sample counts as zero.
    """
    import pyarrow as pa

    carry = list(carry or [])
    cut = segments(clips, key, x, scan, carry)
    if rebalance:
        cut = cut.hint("rebalance")
    kept = [f for f in cut.schema.fields if f.name in (key, *carry)]
    extra = [T.StructField(n, t) for n, t in (
        ("found", T.BooleanType()), ("step", T.LongType()), ("start", T.LongType()), ("p", T.DoubleType()), ("samples", T.ArrayType(T.FloatType())),
        ("scanned_samples", T.LongType()), ("scanned_windows", T.LongType()), ("scored_windows", T.LongType()))]
    shape = T.StructType(kept + extra)
    names = [f.name for f in kept]
    kinds = {"found": pa.bool_(), "p": pa.float64(), "samples": pa.list_(pa.float32())}
    hop, batch = scan.stride * scan.every, BATCH

    def windows_of(x: np.ndarray, n: int) -> np.ndarray:
        x = np.nan_to_num(x, nan=0.0)
        if scan.whole:
            x = x[:scan.window]
            return np.pad(x, (0, scan.window - len(x)))[None, :]
        return np.lib.stride_tricks.sliding_window_view(x, scan.window)[::hop][:n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap = Heap(scan.keep) if scan.keep else None
        schema = None

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            """rows: (key, carried ..., (start, p, samples))"""
            start = [r[-1][0] for r in rows]
            cols = [pa.array([r[i] for r in rows], schema.field(c).type) for i, c in enumerate(names)]
            given = {"found": [True] * len(rows), "step": [s // scan.stride for s in start], "start": start, "p": [r[-1][1] for r in rows],
                     "samples": [r[-1][2] for r in rows]}
            return pa.RecordBatch.from_arrays(cols + [pa.array(given.get(f.name, [None] * len(rows)), kinds.get(f.name, pa.int64())) for f in extra],
                                              [f.name for f in shape.fields])

        def fire(matrix: list[np.ndarray], marks: list[tuple]) -> list[tuple]:
            w = np.vstack(matrix)
            p = np.asarray(predict(w), float)
            return [(*marks[i][:-1], (marks[i][-1], float(p[i]), w[i].astype(np.float32) if samples else None)) for i in np.flatnonzero(p >= scan.threshold)]

        for b in batches:
            schema = b.schema
            part, first, count, own = (b.column(b.schema.get_field_index(c)) for c in ("part", "first", "windows", "own"))
            at, columns = _samples(part), [b.column(b.schema.get_field_index(c)).to_pylist() for c in names]
            first, count, scored, waiting, marks, held = first.to_pylist(), count.to_pylist(), [0] * b.num_rows, [], [], 0
            for i in range(b.num_rows):
                if not count[i]:
                    continue
                w = windows_of(at(i), count[i])
                live = np.arange(len(w)) if scan.gate is None else np.flatnonzero(np.sqrt(np.mean(w * w, axis=1)) >= scan.gate)
                scored[i] = len(live)
                row = tuple(c[i] for c in columns)
                for lo in range(0, len(live), batch):
                    some = live[lo:lo + batch]
                    waiting.append(w[some])
                    marks += [(*row, int(first[i] * scan.stride + j * hop)) for j in some.tolist()]
                    held += len(some)
                    if held >= batch:
                        found, waiting, marks, held = fire(waiting, marks), [], [], 0
                        if heap:
                            heap.add(found)
                        elif found:
                            yield emit(found)
            if held:
                found = fire(waiting, marks)
                if heap:
                    heap.add(found)
                elif found:
                    yield emit(found)
            empty = {"found": pa.array([False] * b.num_rows), "step": pa.array(first, pa.int64()), "scanned_samples": own, "scanned_windows": pa.array(count, pa.int64()),
                     "scored_windows": pa.array(scored, pa.int64())}
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in names] + [
                empty.get(f.name, pa.nulls(b.num_rows, kinds.get(f.name, pa.int64()))) for f in extra], [f.name for f in shape.fields])
        if heap and heap.rows:
            yield emit(heap.cut())

    # one pass: found windows and the account are two readings of the same written rows
    out = materialize(cut.mapInArrow(run, shape), "scan")
    found = out.filter("found").select(*names, "step", "start", "p", *(["samples"] if samples else []))
    if scan.keep:
        found = top_n(found, "p", [key, "start"], scan.keep)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("scanned_samples", "scanned_windows", "scored_windows")]
    account = out.filter("NOT found").groupBy(*carry).agg(F.count_if(F.col("step") == 0).alias("recordings"), *sums)
    return Mined(found, account)


def hours(samples: Column, rate: int = 16_000) -> Column:
    return samples / F.lit(rate) / F.lit(3600.0)


def hard_negatives(parts: dict[str, Mined]) -> tuple[DataFrame, DataFrame]:
    """Windows and accounts of several scans, tagged by ``source``; every window is a negative."""
    found = account = None
    for source, mined in parts.items():
        f, a = mined.found.withColumn("source", F.lit(source)), mined.account.withColumn("source", F.lit(source))
        found = f if found is None else found.unionByName(f, allowMissingColumns=True)
        account = a if account is None else account.unionByName(a, allowMissingColumns=True)
    return found.withColumn("y", F.lit(0)), account


def summary(found: DataFrame, account: DataFrame) -> DataFrame:
    """Per source: recordings, hours, windows scanned and scored, windows found with mean and highest score."""
    hits = found.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.max("p").alias("max_p"))
    seen = account.groupBy("source").agg(*[F.sum(c).alias(c) for c in ("recordings", "scanned_samples", "scanned_windows", "scored_windows")])
    return seen.join(hits, "source", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("hours", hours(F.col("scanned_samples")))


def on_features(predict: Predict) -> Predict:
    """A model of log-mel features as a model of one-second windows."""
    from echoloom.functions.features import to_features

    return lambda x: predict(to_features(x))


def linear_model(weights: list[float], bias: float) -> Predict:
    """A stand-in model on raw samples."""
    w = np.array(weights)
    return lambda x: 1.0 / (1.0 + np.exp(-(x @ w + bias)))

