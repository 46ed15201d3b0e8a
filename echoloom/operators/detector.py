"""Confirmation detector over score streams.

Per step a score is smoothed (decaying peak hold or exponential mean), compared with a
threshold, confirmed by N hits within a span, and followed by a refractory lockout; a trigger
resets the smoothing and the hit history.

Read step by step this is sequential, and one stream may be a third of the data. Two facts make
it parallel and still exact:

* Whether a step *could* trigger depends only on a bounded look-back and on how long ago the last
  trigger was. For every step there is a smallest distance ``g`` to the last trigger from which
  the step triggers (more history never lowers a score, since scores are not negative). ``g`` is
  computed in chunks with a halo.
* What remains is: trigger at the first candidate with ``s - last >= g``. A chunk maps the
  distance to the last trigger at its start to the last trigger at its end. The distances that
  matter are bounded, so a chunk is a short array, and arrays of consecutive chunks compose.

The chunk arrays are composed within blocks of chunks, then over the blocks of a stream, and the
entry state is handed back down.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoloom.operators.chunks import CHUNK, with_halo
from echoloom.session import inline_table, materialize

BLOCK = 4096      # chunks per block
#: look-backs up to this are counted lag by lag
LAGS = 64
#: stands for a hit that is not there
NEVER = 1 << 60


@dataclass(frozen=True)
class Policy:
    """One detector setting. ``variant``: 'scan' confirms on any scored step whose recent hits
    suffice, 'engine' only on a step that is itself a hit. ``keep_score`` leaves the smoothed
    score alone on a trigger."""

    threshold: float
    agg: str = "maxhold"
    need: int = 2
    span: int = 2
    refractory: int = 15
    variant: str = "scan"
    alpha: float = 0.6
    decay: float = 0.85
    keep_score: bool = False

    def __post_init__(self):
        if self.agg == "maxhold" and not 0.0 < self.decay < 1.0:
            raise ValueError("a peak hold needs a decay between 0 and 1: without decay a score is never forgotten")
        if self.agg != "maxhold" and not 0.0 < self.alpha <= 1.0:
            raise ValueError("a mean needs an alpha above 0 and up to 1")

    @property
    def lookback(self) -> int:
        """Steps after which an old score can no longer matter."""
        if self.agg != "maxhold" and self.alpha == 1.0:
            return 4
        if self.agg == "maxhold":
            return max(1, math.ceil(math.log(self.threshold) / math.log(self.decay)) + 1)
        return math.ceil(54 * math.log(2.0) / -math.log(1.0 - self.alpha)) + 4

    @property
    def gap(self) -> int:
        return max(1, self.refractory)


def engine_policy(threshold: float, consecutive: int = 2, confirm_window: int = 0, **kw) -> Policy:
    """Push-style engine: N of the last ``confirm_window`` steps, or N in a row when it is <= 1."""
    span = confirm_window if confirm_window > 1 else consecutive
    return Policy(threshold, need=consecutive, span=span, variant="engine", **kw)


def grid(thresholds, policies=("2/2",), aggs=("maxhold",), **kw) -> list[Policy]:
    """Every aggregation x policy x threshold, in the order in which ties are settled."""
    out = []
    for agg in aggs:
        for pol in policies:
            need, span = (int(v) for v in pol.split("/"))
            out += [Policy(t, agg=agg, need=need, span=span, **kw) for t in thresholds]
    return out


def _single(values: set, what: str):
    if len(values) > 1:
        raise ValueError(f"one {what} per call, got {sorted(values)}")
    return next(iter(values), None)


def _earlier(v: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per step the value a step earlier, zero at the first step of a chunk."""
    out = np.empty_like(v)
    out[1:] = v[:-1]
    out[starts] = 0.0
    return out


def _by_chunk(f, x: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """What ``f`` gives for each chunk, put together again."""
    parts = [f(own) for own in np.split(x, starts[1:])]
    return [np.concatenate(p) for p in zip(*parts, strict=True)]


def _scores_needed_held(x: np.ndarray, thresholds: list[float], decay: float, look: int, starts: np.ndarray | None = None) -> list[np.ndarray]:
    """Per threshold and step: how many of the last scores have to be seen for the peak hold to reach it; 0: never.

    A score stays above a threshold for a number of steps that follows from its size (its life), so a step needs
    the latest score that is still alive. Short lives are counted by multiplying as the hold does; for long ones a stack holds
    the scores seen, and what has died is popped from its top, so a chunk is passed once however slow the decay is. ``x`` may hold many
    chunks, which begin at ``starts``.
    """
    starts = np.zeros(1, np.int64) if starts is None else starts
    if look <= LAGS:
        out, v = [np.zeros(len(x), np.int64) for _ in thresholds], x.copy()
        for j in range(min(look, _longest(starts, len(x)))):
            if j:
                v = _earlier(v, starts) * decay
            for need, thr in zip(out, thresholds, strict=True):
                need[(need == 0) & (v >= thr)] = j + 1
        return out
    return _by_chunk(lambda own: [_latest_alive(own, _lives(own, thr, decay)) for thr in thresholds], x, starts)


def _longest(starts: np.ndarray, n: int) -> int:
    """Steps of the longest chunk."""
    return int(np.diff(np.append(starts, n)).max())


def _lives(x: np.ndarray, thr: float, decay: float) -> np.ndarray:
    """For how many steps each score is at or above ``thr`` when it is multiplied by ``decay`` step after step."""
    life = np.zeros(len(x), np.int64)
    live = np.flatnonzero(x >= thr)
    steps = np.log(x[live] / thr) / -np.log(decay)
    life[live] = np.floor(steps).astype(np.int64) + 1
    for i in live[np.abs(steps - np.rint(steps)) < 1e-6]:           # too close for a logarithm: multiply
        v, k = float(x[i]), 0
        while v >= thr:
            v, k = v * decay, k + 1
        life[i] = k
    return life


def _latest_alive(x: np.ndarray, life: np.ndarray) -> np.ndarray:
    need, stack = [0] * len(x), []
    for t, k in enumerate(life.tolist()):
        if k:
            stack.append((t, t + k))
        while stack and stack[-1][1] <= t:
            stack.pop()
        if stack:
            need[t] = t - stack[-1][0] + 1
    return np.array(need, np.int64)


def _scores_needed_mean(x: np.ndarray, thresholds: list[float], shorts: list[int], alpha: float, look: int, starts: np.ndarray | None = None) -> list[np.ndarray]:
    """Per threshold and step: how many of the last scores bring the mean to it, at least ``short``; 0: ``look`` do not.

    The mean over the last k scores is one step of the mean over the last k - 1, a step earlier, so short look-backs are
    lags of one array. For long ones the mean m over all scores gives it by one subtraction, m[t] - (1 - alpha)^k m[t - k]; it never
    falls with k, so halving finds the k, and a case too close for that is folded as the detector does. ``x`` may hold many chunks, which
    begin at ``starts``.
    """
    n, keep = len(x), 1.0 - alpha
    starts = np.zeros(1, np.int64) if starts is None else starts
    if look <= LAGS:
        out, tail, now = [np.zeros(n, np.int64) for _ in thresholds], np.zeros(n), alpha * x
        for k in range(1, look + 1):
            tail = now + keep * _earlier(tail, starts)
            for need, thr, short in zip(out, thresholds, shorts, strict=True):
                if k >= min(short, look):
                    need[(need == 0) & (tail >= thr)] = k
        return out
    if len(starts) > 1:
        return _by_chunk(lambda own: _scores_needed_mean(own, thresholds, shorts, alpha, look), x, starts)
    mean = np.array(list(accumulate(x.tolist(), lambda m, v: alpha * v + keep * m, initial=0.0)))        # mean[t + 1] is after step t
    t = np.arange(n)
    powers = keep ** np.arange(look + 1)

    def tail(k: np.ndarray) -> np.ndarray:
        k = np.minimum(k, t + 1)
        return mean[1:] - powers[k] * mean[t + 1 - k]

    def folded(at: int, k: int) -> float:
        e = 0.0
        for v in x[max(0, at - k + 1):at + 1].tolist():
            e = alpha * v + keep * e
        return e

    out = []
    for thr, short in zip(thresholds, shorts, strict=True):
        short = min(short, look)
        low, high = np.full(n, short), np.full(n, look)
        while np.any(low < high):
            middle = (low + high) // 2
            enough = tail(middle) >= thr
            low, high = np.where(enough, low, np.minimum(middle + 1, high)), np.where(enough, middle, high)
        need = np.where(tail(low) >= thr, low, 0)
        close = (np.abs(tail(low) - thr) < 1e-9) | (np.abs(tail(np.maximum(low - 1, 1)) - thr) < 1e-9)
        for at in np.flatnonzero(close):
            k = bisect_left(range(short, look + 1), True, key=lambda k: folded(at, k) >= thr)
            need[at] = short + k if k <= look - short else 0
        out.append(need)
    return out


def _candidates_of(x: np.ndarray, gated: np.ndarray, policies: list[Policy], starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per policy: (index, g) of the steps that trigger if the last trigger is ``g`` or more steps ago. Chunks begin at ``starts``.

    All chunks are passed at once, and policies that ask for the same scores share them, so short streams cost no more than long ones.
    """
    n = len(x)
    place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))              # within the chunk
    asked = {i: (p.threshold, None if p.agg == "maxhold" else max(1, p.gap - p.span + 1)) for i, p in enumerate(policies)}
    holds, means = (sorted({a for i, a in asked.items() if (policies[i].agg == "maxhold") == held}) for held in (True, False))
    need: dict[tuple, np.ndarray] = {}
    if holds:
        some = [p for p in policies if p.agg == "maxhold"]
        need |= zip(holds, _scores_needed_held(x, [t for t, _ in holds], some[0].decay, max(p.lookback for p in some), starts), strict=True)
    if means:
        some = [p for p in policies if p.agg != "maxhold"]
        need |= zip(means, _scores_needed_mean(x, [t for t, _ in means], [s for _, s in means], some[0].alpha, max(p.lookback for p in some), starts), strict=True)
    out = []
    for i, p in enumerate(policies):
        hit = (need[asked[i]] > 0) & ~gated
        m = np.where(hit, 1 if p.keep_score else need[asked[i]], NEVER)
        seen = np.full((p.span, n), NEVER)
        for k in range(min(p.span, n)):
            seen[k, k:] = np.where(place[k:] >= k, m[:n - k] + k, NEVER)
        if p.need == 1:
            reach = seen.min(axis=0)
        elif p.need == p.span:
            reach = seen.max(axis=0)
        else:
            reach = np.sort(seen, axis=0)[p.need - 1]
        at = np.flatnonzero((reach < NEVER) & ~gated & (hit | (p.variant == "scan")))
        out.append((at, np.maximum(reach[at], p.gap)))
    return out


def _passage(step: np.ndarray, g: np.ndarray, start: int, reach: int) -> list[int | None]:
    """For each distance 1 .. reach + 1 of the last trigger before ``start``: the last trigger after the chunk, None if it has none.

    Distances that have met in one trigger stay together; when all have, one number is carried on.
    """
    before = start - np.arange(1, reach + 2)
    last, steps, needs = before.copy(), step.tolist(), g.tolist()
    for i, (s, need) in enumerate(zip(steps, needs, strict=True)):
        fires = s - last >= need
        if fires.any():
            last[fires] = s
            if last[0] == last[-1] and (last == s).all():
                for s2, need2 in zip(steps[i + 1:], needs[i + 1:], strict=True):
                    if s2 - s >= need2:
                        s = s2
                return [s] * (reach + 1)
    return [None if a == b else a for a, b in zip(last.tolist(), before.tolist(), strict=True)]


def candidates(scores: DataFrame, policies: list[Policy], size: int = CHUNK, first: int | None = None) -> DataFrame:
    """(stream, chunk, pid, cands, vec): sorted array of (s, g) per chunk, and the chunk as a map of the last trigger; NULL for
    the last chunk of a stream, which it does not fill.

    Steps before ``first`` cannot trigger. A task takes the chunks of its partition one after another.
    """
    import pyarrow as pa

    _single({p.decay for p in policies if p.agg == "maxhold"}, "decay")
    _single({p.alpha for p in policies if p.agg != "maxhold"}, "alpha")
    halo, reach = _halo(policies), _reach(policies)
    rows = with_halo(scores.select("stream", "step", "p", "gated"), halo, size=size)
    kind = scores.schema["stream"].dataType
    pair = T.StructType([T.StructField("s", T.LongType()), T.StructField("g", T.LongType())])
    shape = T.StructType([T.StructField("stream", kind), T.StructField("chunk", T.LongType()), T.StructField("pid", T.IntegerType()),
                          T.StructField("cands", T.ArrayType(pair)), T.StructField("vec", T.ArrayType(T.LongType()))])

    def whole(t: pa.Table, starts: np.ndarray, schema: pa.Schema) -> pa.RecordBatch | None:
        """Candidates of the chunks of ``t``, which begin at ``starts``; only a chunk that another may follow is mapped to its last trigger."""
        chunk, step, own = (t.column(c).to_numpy() for c in ("chunk", "step", "own"))
        gated = np.asarray(t.column("gated").to_numpy(), bool)
        x = np.where(gated, 0.0, np.nan_to_num(np.asarray(t.column("p").to_numpy(), float)))
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        allowed = np.asarray(own, bool) if first is None else np.asarray(own, bool) & (step >= first)
        found = [(at[allowed[at]], g[allowed[at]]) for at, g in _candidates_of(x, gated, policies, starts)]
        at, g = (np.concatenate(c) for c in zip(*found, strict=True))
        if not len(at):
            return None
        pid, mine, s = np.repeat(np.arange(len(policies)), [len(a) for a, _ in found]), of[at], step[at]
        cuts = np.flatnonzero(np.append(True, (np.diff(pid) != 0) | (np.diff(mine) != 0)))
        ends = np.append(cuts, len(s))
        mine, pid = mine[cuts], pid[cuts]
        last = np.append(starts[1:], len(x))[mine] - 1
        follows = step[last] == (chunk[last] + 1) * size - 1
        vec = [_passage(s[lo:hi], g[lo:hi], c * size, reach) if more else None
               for lo, hi, c, more in zip(ends[:-1].tolist(), ends[1:].tolist(), chunk[last].tolist(), follows.tolist(), strict=True)]
        pairs = pa.StructArray.from_arrays([pa.array(s, pa.int64()), pa.array(g, pa.int64())], ["s", "g"])
        return pa.RecordBatch.from_arrays([
            t.column("stream").combine_chunks().take(pa.array(starts[mine])), pa.array(chunk[last], pa.int64()), pa.array(pid, pa.int32()),
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs), pa.array(vec, pa.list_(pa.int64()))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, schema = None, None
        for b in batches:
            t = pa.Table.from_batches([b])
            schema = schema or pa.schema([("stream", b.schema.field("stream").type), ("chunk", pa.int64()), ("pid", pa.int32()),
                                          ("cands", pa.list_(pa.struct([("s", pa.int64()), ("g", pa.int64())]))), ("vec", pa.list_(pa.int64()))])
            t = t if held is None else pa.concat_tables([held, t])
            keys = list(zip(t.column("stream").to_pylist(), t.column("chunk").to_pylist(), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1])]
            out = whole(t.slice(0, cuts[-1]), np.array(cuts[:-1]), schema) if cuts[-1] else None
            held = t.slice(cuts[-1]) if len(keys) else None
            if out is not None:
                yield out
        if held is not None and held.num_rows and (out := whole(held, np.zeros(1, np.int64), schema)) is not None:
            yield out

    return rows.repartition("stream", "chunk").sortWithinPartitions("stream", "chunk", "step").mapInArrow(run, shape)


def _halo(policies: list[Policy]) -> int:
    return max(p.lookback for p in policies) + max(p.span for p in policies)


def _reach(policies: list[Policy]) -> int:
    return max(max(p.gap, p.lookback + p.span) for p in policies)


def _none() -> Column:
    return F.lit(None).cast("bigint")


def _compose(last: Column, item: Column, reach: int, first_step: Column) -> Column:
    """Last trigger after ``item`` (which starts at ``first_step``), given the last one before."""
    d = F.least(F.lit(reach + 1), F.coalesce(first_step - last, F.lit(reach + 1))).cast("int")
    return F.coalesce(F.element_at(item["vec"], d), last)


def detect(scores: DataFrame, policies: list[Policy], size: int = CHUNK, block: int = BLOCK,
           enter: DataFrame | None = None) -> DataFrame:
    """(stream, pid, step) of every trigger.

    ``scores``: stream, step (dense from 0), p in [0, 1], gated. ``pid`` indexes ``policies``.
    ``enter`` (stream, last) continues streams: steps below 0 are look-back rows that cannot
    trigger, and ``last`` (negative, or NULL) is the step of the last trigger before step 0.
    """
    reach = _reach(policies)
    while size < 2 * _halo(policies):                                      # a chunk is longer than what it looks back to
        size *= 2
    # written once: both the chunk summaries and the final pass read it, and it is a small share
    # of the scores
    cands = materialize(candidates(scores, policies, size, None if enter is None else 0), "candidates").filter("stream IS NOT NULL")
    far = F.lit(-(reach + 1))

    def picks(enter: Column) -> Column:
        def pick(acc, c):
            ok = c["s"] - F.coalesce(acc["last"], far) >= c["g"]
            return F.when(ok, F.struct(c["s"].alias("last"),
                                       F.concat(acc["steps"], F.array(c["s"])).alias("steps"))).otherwise(acc)
        zero = F.struct(enter.alias("last"), F.array().cast("array<bigint>").alias("steps"))
        return F.aggregate("cands", zero, pick, lambda acc: acc["steps"])

    # the first chunk of a stream is entered as the stream is; only streams with candidates beyond it have anything to compose
    heads, rest = cands.filter("chunk = 0"), cands.filter("chunk > 0")
    entered = heads.withColumn("enter", _none()) if enter is None else heads.join(enter.select("stream", F.col("last").alias("enter")), "stream", "left")
    at_first = entered.select("stream", "pid", F.explode(picks(F.col("enter"))).alias("step"))

    dist = F.sequence(F.lit(1), F.lit(reach + 1))

    chunk_vec = cands.join(rest.select("stream", "pid").distinct(), ["stream", "pid"], "left_semi").select("stream", "pid", "chunk", F.floor(F.col("chunk") / F.lit(block)).cast("long").alias("block"), "vec")
    blocks = (chunk_vec.groupBy("stream", "pid", "block")
              .agg(F.sort_array(F.collect_list(F.struct("chunk", "vec"))).alias("chunks")))

    block_start = F.col("block") * F.lit(size * block)
    def through(d):
        def fold(last, it):
            seen = F.coalesce(last, block_start - d)
            return F.coalesce(F.element_at(it["vec"], F.least(
                F.lit(reach + 1), it["chunk"] * F.lit(size) - seen).cast("int")), last)
        return F.aggregate("chunks", _none(), fold)
    block_vec = blocks.select("stream", "pid", "block", F.transform(dist, through).alias("vec"))
    streams = (block_vec.groupBy("stream", "pid")
               .agg(F.sort_array(F.collect_list(F.struct("block", "vec"))).alias("items")))

    before = _none()
    if enter is not None:
        streams = streams.join(enter.select("stream", F.col("last").alias("_from")), "stream", "left")
        before = F.col("_from")
    block_entry = streams.select("stream", "pid", F.explode(
        _entries(F.col("items"), "block", reach, size * block, before)).alias("e"))
    block_entry = block_entry.select("stream", "pid", F.col("e.id").alias("block"), F.col("e.last").alias("enter"))
    chunk_entry = (blocks.join(block_entry, ["stream", "pid", "block"])
                   .select("stream", "pid", F.explode(
                       _entries(F.col("chunks"), "chunk", reach, size, F.col("enter"))).alias("e"))
                   .select("stream", "pid", F.col("e.id").alias("chunk"), F.col("e.last").alias("enter")))

    return (rest.join(chunk_entry, ["stream", "pid", "chunk"])
            .select("stream", "pid", F.explode(picks(F.col("enter"))).alias("step")).unionByName(at_first))


def _entries(items: Column, key: str, reach: int, width: int, enter: Column) -> Column:
    """array<struct<id, last>>: the last trigger before each item."""
    def fold(acc, it):
        after = _compose(acc["last"], it, reach, it[key] * F.lit(width))
        return F.struct(after.alias("last"), F.concat(acc["out"], F.array(
            F.struct(it[key].alias("id"), acc["last"].alias("last")))).alias("out"))
    zero = F.struct(enter.alias("last"), F.array().cast("array<struct<id:bigint,last:bigint>>").alias("out"))
    return F.aggregate(items, zero, fold, lambda acc: acc["out"])


def policy_table(spark, policies: list[Policy]) -> DataFrame:
    """The settings as a constant table keyed by ``pid``."""
    names = list(asdict(policies[0]))
    rows = [(i, *[float(v) if k in ("threshold", "alpha", "decay") else v for k, v in asdict(p).items()])
            for i, p in enumerate(policies)]
    return inline_table(spark, ", ".join(["pid", *names]), rows)


def raw_triggers(scores: DataFrame, threshold: float, by: list[str]) -> DataFrame:
    """Scored steps at or above the threshold."""
    return scores.groupBy(*by).agg(
        F.count_if(~F.col("gated") & (F.col("p") >= threshold)).alias("raw_hits"))


def first_trigger(detections: DataFrame) -> DataFrame:
    return detections.groupBy("stream", "pid").agg(F.min("step").alias("first_step"),
                                                    F.count(F.lit(1)).alias("n_detections"))
