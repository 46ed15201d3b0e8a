"""The chunked detector against a step-by-step reading of its rules."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoloom.operators.detector import Policy, detect, engine_policy, grid


def stepwise(ps, gated, p):
    mean = hold = 0.0
    hist, lock, out = [], 0, []
    for s, (x, g) in enumerate(zip(ps, gated)):
        lock = max(0, lock - 1)
        if g:
            hold, mean, hit = hold * p.decay, (1 - p.alpha) * mean, 0
        else:
            hold = max(x, hold * p.decay)
            mean = p.alpha * x + (1 - p.alpha) * mean
            hit = int((hold if p.agg == "maxhold" else mean) >= p.threshold)
        hist = (hist + [hit])[-p.span:]
        if not g and sum(hist) >= p.need and lock == 0 and (p.variant == "scan" or hit):
            out.append(s)
            lock, hist = p.refractory, []
            if not p.keep_score:
                hold = mean = 0.0
    return out


def make(seed, lengths):
    rnd = random.Random(seed)
    data = {}
    for k, n in enumerate(lengths):
        kind = k % 5
        draw = [lambda: rnd.random(), lambda: 1.0, lambda: rnd.choice([0.0, 0.0, 0.0, 0.95]),
                lambda: rnd.random() ** 4, lambda: min(1.0, 0.5 + 0.6 * rnd.random())][kind]
        data[k] = ([draw() for _ in range(n)], [kind != 1 and rnd.random() < 0.1 for _ in range(n)])
    return data


def run(spark, data, policies, **kw):
    rows = [(k, i, float(x), bool(g)) for k, (ps, gs) in data.items() for i, (x, g) in enumerate(zip(ps, gs))]
    df = spark.createDataFrame(rows, "stream bigint, step bigint, p double, gated boolean")
    got = {}
    for r in detect(df, policies, **kw).collect():
        got.setdefault((r.stream, r.pid), []).append(r.step)
    return {k: sorted(v) for k, v in got.items()}


POLICIES = (grid([0.3, 0.68, 0.9], ["1/2", "2/2", "2/3", "3/4"], ["maxhold", "ema"])
            + [Policy(0.68, refractory=r, need=2, span=3, agg=a, variant=v, keep_score=k)
               for r in (0, 3) for a in ("maxhold", "ema") for v in ("scan", "engine") for k in (False, True)])


@pytest.mark.parametrize("size,block", [(64, 2), (4096, 4096)])
def test_equals_stepwise(spark, size, block):
    data = make(3, [1, 60, 300, 5, 300, 200, 130, 300, 61, 300])
    got = run(spark, data, POLICIES, size=size, block=block)
    for k, (ps, gs) in data.items():
        for i, p in enumerate(POLICIES):
            assert got.get((k, i), []) == stepwise(ps, gs, p), (k, p)


def test_one_hot_stream_spans_many_chunks(spark):
    data = {0: ([1.0] * 3000, [False] * 3000), 1: ([0.0] * 50, [False] * 50)}
    p = Policy(0.68)
    got = run(spark, data, [p], size=64, block=4)
    assert got == {(0, 0): stepwise(*data[0], p)}
    assert min(b - a for a, b in zip(got[(0, 0)], got[(0, 0)][1:])) >= p.refractory


def test_single_hot_frame(spark):
    ps = [0.0] * 5 + [0.9] + [0.0] * 10
    data = {0: (ps, [False] * len(ps))}
    got = run(spark, data, [Policy(0.68, agg="maxhold"), Policy(0.68, agg="ema")])
    assert got == {(0, 0): [6]}          # peak hold keeps .765 one step later, the mean never reaches .68


def test_gated_step_cannot_hit(spark):
    ps, gs = [0.9, 0.9, 0.9], [False, True, False]
    got = run(spark, {0: (ps, gs)}, [Policy(0.68, need=2, span=2)])
    assert got == {}


def test_scan_and_engine_differ_in_span_mode(spark):
    ps = [0.9] * 2 + [0.0] * 3 + [0.9] * 14 + [0.0] * 4
    data = {0: (ps, [False] * len(ps))}
    scan, engine = Policy(0.8, need=2, span=3), engine_policy(0.8, 2, 3)
    got = run(spark, data, [scan, engine])
    assert got[(0, 0)] == stepwise(*data[0], scan)
    assert got[(0, 1)] == stepwise(*data[0], engine)


def test_no_trigger_gives_no_rows(spark):
    df = spark.range(20).select(F.lit(1).alias("stream"), F.col("id").alias("step"), F.lit(0.1).alias("p"), F.lit(False).alias("gated"))
    assert detect(df, [Policy(0.68)]).count() == 0


@pytest.mark.parametrize(("agg", "alpha", "decay"), [("maxhold", 0.6, 0.999), ("maxhold", 0.6, 0.85), ("ema", 0.01, 0.85), ("ema", 0.6, 0.85), ("ema", 1.0, 0.85)])
def test_smoothing_is_exact_over_long_streams(spark, agg, alpha, decay):
    from echoloom.operators.evaluation import smoothed

    rng = np.random.default_rng(3)
    p = np.where(rng.random(10_000) < 0.002, rng.random(10_000), 0.0)
    p[0] = 1.0
    rows = [("s", i, float(v), i % 17 == 3) for i, v in enumerate(p)] + [("t", 0, 0.5, False)]
    df = spark.createDataFrame(rows, "stream string, step long, p double, gated boolean")
    got = {r["step"]: r["score"] for r in smoothed(df, agg, alpha, decay, size=16, group=8).filter("stream = 's'").collect()}
    e = 0.0
    for i, v in enumerate(p):
        x = 0.0 if i % 17 == 3 else v
        e = max(x, decay * e) if agg == "maxhold" else alpha * x + (1 - alpha) * e
        assert abs(got[i] - e) < 1e-12
    assert len(got) == len(p)


def test_settings_without_forgetting_are_refused():
    from echoloom.operators.detector import Policy

    with pytest.raises(ValueError, match="decay"):
        Policy(0.5, decay=1.0)
    assert Policy(0.5, agg="ema", alpha=1.0).lookback >= 1


SLOW = [Policy(0.68, decay=0.999), Policy(0.3, decay=0.999, need=2, span=3), Policy(0.9, decay=0.999, variant="engine", refractory=0), Policy(0.68, decay=0.999, keep_score=True, need=3, span=4)]
LONG_MEANS = [Policy(0.3, agg="ema", alpha=0.01), Policy(0.1, agg="ema", alpha=0.01, need=2, span=3, refractory=40), Policy(0.5, agg="ema", alpha=0.01, variant="engine", keep_score=True)]


@pytest.mark.parametrize("policies", [SLOW, LONG_MEANS, SLOW[:2] + LONG_MEANS[:2]])
def test_slow_forgetting_equals_stepwise(spark, policies):
    rng = np.random.default_rng(7)
    sparse = np.where(rng.random(10_000) < 0.004, rng.random(10_000), 0.0)
    walk = np.clip(np.cumsum(rng.normal(0, 0.02, 3000)) % 1.0, 0, 1)
    data = {0: (sparse.tolist(), (rng.random(10_000) < 0.1).tolist()), 1: (walk.tolist(), [False] * 3000), 2: ([0.3] * 900, [False] * 900), 3: ([1.0] * 1500, [i % 9 == 4 for i in range(1500)])}
    got = run(spark, data, policies)
    for k, (ps, gs) in data.items():
        for i, p in enumerate(policies):
            assert got.get((k, i), []) == stepwise(ps, gs, p), (k, p)


def test_lives_and_lags_agree():
    from echoloom.operators import detector as D

    rng = np.random.default_rng(1)
    x = np.concatenate([rng.random(400), [1.0, 0.85, 0.85 ** 2, 0.6, 0.6, 0.0], 0.5 * 0.9 ** -np.arange(6)])
    for decay, thr in ((0.9, 0.5), (0.85, 0.85 ** 2), (0.97, 0.3)):
        look = Policy(thr, decay=decay).lookback
        a = D._scores_needed_held(x, [thr], decay, look)[0]
        assert look <= D.LAGS and np.array_equal(a, D._latest_alive(x, D._lives(x, thr, decay)))
    for thr, short in ((0.4, 1), (0.5, 9), (0.6, 30)):
        a = D._scores_needed_mean(x, [thr], [short], 0.6, 60)[0]
        D.LAGS, kept = 0, D.LAGS
        try:
            assert np.array_equal(a, D._scores_needed_mean(x, [thr], [short], 0.6, 60)[0])
        finally:
            D.LAGS = kept


def test_a_batch_of_chunks_gives_the_candidates_of_each():
    from echoloom.operators import detector as D

    rng = np.random.default_rng(5)
    for policies in (POLICIES, SLOW + LONG_MEANS[:2]):
        x = np.where(rng.random(700) < 0.4, rng.random(700), 0.0)
        gated, starts = rng.random(700) < 0.1, np.array([0, 1, 3, 64, 65, 400])
        x[gated] = 0.0
        together = D._candidates_of(x, gated, policies, starts)
        for lo, hi in zip(starts, [*starts[1:], 700], strict=True):
            alone = D._candidates_of(x[lo:hi], gated[lo:hi], policies, np.zeros(1, np.int64))
            for (at, g), (own, own_g) in zip(together, alone, strict=True):
                inside = (at >= lo) & (at < hi)
                assert np.array_equal(at[inside] - lo, own) and np.array_equal(g[inside], own_g)


def test_streams_of_one_chunk_are_not_mapped(spark):
    from echoloom.operators.detector import candidates

    rows = [(k, i, 0.9, False) for k, n in ((1, 50), (2, 64), (3, 150)) for i in range(n)]
    df = spark.createDataFrame(rows, "stream bigint, step bigint, p double, gated boolean")
    got = {(r.stream, r.chunk): r.vec is not None for r in candidates(df, [Policy(0.68, refractory=5)], 64).collect()}
    assert got == {(1, 0): False, (2, 0): True, (3, 0): True, (3, 1): True, (3, 2): False}


def test_a_passage_equals_each_distance_alone():
    from echoloom.operators.detector import _passage

    rng = np.random.default_rng(2)
    for _ in range(50):
        step = np.unique(rng.integers(100, 200, 40))
        g = rng.integers(1, 30, len(step))
        want = []
        for d in range(1, 41):
            last = 100 - d
            for s, need in zip(step.tolist(), g.tolist(), strict=True):
                last = s if s - last >= need else last
            want.append(None if last == 100 - d else last)
        assert _passage(step, g, 100, 39) == want
