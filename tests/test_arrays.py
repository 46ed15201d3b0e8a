import numpy as np
import pytest
from pyspark.sql import functions as F

from echoloom.functions import arrays as A
from echoloom.operators import clipwindows as W


def one(spark, expr, **arrays):
    df = spark.createDataFrame([tuple([float(v) for v in a] for a in arrays.values())],
                               ", ".join(f"{k} array<double>" for k in arrays))
    return df.select(expr.alias("r")).first().r


@pytest.fixture(scope="module")
def sig():
    rng = np.random.default_rng(4)
    return rng.normal(0, 0.1, 200), rng.normal(0, 0.3, 200), rng.normal(0, 0.05, 200)


X, Y = (lambda: F.col("x")), (lambda: F.col("y"))


@pytest.mark.parametrize("snr", [-6.0, 0.0, 12.0, 26.0])
def test_mix_has_the_requested_ratio(spark, sig, snr):
    a, b, _ = sig
    out = np.array(one(spark, A.mix_at_snr(X(), Y(), snr), x=a, y=b))
    measured = 10 * np.log10(np.mean(a ** 2) / np.mean((out - a) ** 2))
    assert measured == pytest.approx(snr, abs=1e-5)


def test_layer_ladder_is_sequential(spark, sig):
    a, b, c = sig
    stack = F.array(F.struct(Y().alias("samples"), F.lit(8.0).alias("snr")), F.struct(F.col("z").alias("samples"), F.lit(0.0).alias("snr")))
    got = np.array(one(spark, A.mix_layers(X(), stack), x=a, y=b, z=c))
    want = a
    for n, s in ((b, 8.0), (c, 0.0)):
        want = want + n * np.sqrt((np.mean(want ** 2) + 1e-9) / (10 ** (s / 10) * (np.mean(n ** 2) + 1e-9)))
    want = want / max(1.0, np.max(np.abs(want)) / 0.95)
    assert np.allclose(got, want)


def test_silent_layer_is_skipped(spark, sig):
    a, _, _ = sig
    stack = F.array(F.struct(Y().alias("samples"), F.lit(8.0).alias("snr")))
    assert np.allclose(one(spark, A.mix_layers(X(), stack), x=a * 0.5, y=np.full(200, 0.2)), a * 0.5)


@pytest.mark.parametrize("n", [50, 200, 333])
@pytest.mark.parametrize("u", [None, 0.0, 0.73, 0.9999])
def test_fit_to_window(spark, sig, n, u):
    a = sig[0]
    got = np.array(one(spark, A.fit_to_window(X(), n, None if u is None else F.lit(u)), x=a))
    room = abs(n - 200)
    at = room // 2 if u is None else int(u * (room + 1))
    want = a[at:at + n] if n <= 200 else np.pad(a, (at, n - 200 - at))
    assert len(got) == n and np.allclose(got, want)


@pytest.mark.parametrize("m", [1, 37, 200, 411])
def test_resample_matches_interp(spark, sig, m):
    a = sig[0]
    want = np.interp(np.linspace(0, 1, m, endpoint=False), np.linspace(0, 1, 200, endpoint=False), a)
    assert np.allclose(one(spark, A.resample(X(), m), x=a), want)


@pytest.mark.parametrize("f", [0.8, 0.99, 1.0, 1.22])
def test_speed_keeps_length(spark, sig, f):
    got = one(spark, A.speed_perturb(X(), f), x=sig[0])
    assert len(got) == 200
    if abs(f - 1) < 0.02:
        assert np.allclose(got, sig[0])


def test_level_range_is_a_whole_number():
    assert [A.gain_span(v) for v in (0.0, 6.0, 12.0, 24.0)] == [0.0, 1.0, 2.0, 3.0]


@pytest.mark.parametrize("beta", [-0.9, -0.25, 0.0, 0.2, 0.9])
def test_cadence_warp(spark, sig, beta):
    t = np.linspace(0, 1, 200)
    want = np.interp(t, np.clip(t + beta * t * (1 - t), 0, 1), sig[0])       # samples sit at the warped times
    assert np.allclose(one(spark, A.cadence_warp(X(), beta), x=sig[0]), want)


@pytest.mark.parametrize("k", [-250, -7, 0, 7, 250])
def test_shift_and_roll(spark, sig, k):
    a = sig[0]
    want = np.zeros(200)
    if abs(k) < 200:
        want[max(k, 0):200 + min(k, 0)] = a[max(-k, 0):200 - max(k, 0)]
    assert np.allclose(one(spark, A.shift(X(), F.lit(k)), x=a), want)
    assert np.allclose(one(spark, A.roll(X(), k), x=a), np.roll(a, k))


def test_trim_silence(spark):
    loud = np.concatenate([np.zeros(1600), np.full(800, 0.5), np.zeros(2400)])
    got = one(spark, A.trim_silence(X()), x=loud)
    assert len(got) == 800 + 2 * 400
    assert len(one(spark, A.trim_silence(X()), x=np.zeros(500))) == 500


@pytest.mark.parametrize("bits", [6, 8, 16])
def test_quantise(spark, sig, bits):
    q = 2 ** bits / 2 - 0.5
    want = np.round((np.clip(sig[1], -1, 1) + 1) * q) / q - 1
    assert np.allclose(one(spark, A.quantise(X(), bits), x=sig[1]), want)


def test_level_policy_hits_the_target(spark, sig):
    r = one(spark, A.level_policy(X(), F.lit(False), 1.0, 1.0, -30.0), x=sig[0])
    assert r.level == pytest.approx(-30.0, abs=1e-3)
    r = one(spark, A.level_policy(X(), F.lit(False), 1.0, 1.0, -30.0), x=np.zeros(64))
    assert r.level == -60.0


def test_floor_lift_cannot_rescue_digital_silence(spark):
    assert one(spark, A.level_floor_lift(X(), -40.0), x=np.zeros(64)).level == pytest.approx(-180.0)


def test_spec_mask_takes_the_minimum_twice(spark):
    m = np.arange(12.0).reshape(3, 4) + 1
    df = spark.createDataFrame([(m.tolist(),)], "m array<array<double>>")
    got = np.array(df.select(A.spec_mask(F.col("m"), 1, 2, 2, 1, "min").alias("r")).first().r)
    want = m.copy()
    want[:, 1:3] = want.min()
    want[2:3] = want.min()
    assert np.allclose(got, want)


def test_downmix_modes(spark, sig):
    df = spark.createDataFrame([([sig[0].tolist(), sig[1].tolist()],)], "c array<array<double>>")
    r = df.select(A.downmix(F.col("c")).alias("m"), A.downmix(F.col("c"), "first").alias("f")).first()
    assert np.allclose(r.m, (sig[0] + sig[1]) / 2) and np.allclose(r.f, sig[0])


def test_standardise(spark):
    x = np.sin(np.arange(4000) / 9.0)
    df = spark.createDataFrame([([x.tolist()],)], "c array<array<double>>")
    out = np.array(df.select(A.standardise(F.col("c"), F.lit(8000)).alias("r")).first().r)
    assert len(out) == 8000 and np.max(np.abs(out)) == pytest.approx(0.89)


def test_pcen(spark):
    e = np.abs(np.random.default_rng(1).normal(size=50))
    m = [e[0]]
    for v in e[1:]:
        m.append(0.975 * m[-1] + 0.025 * v)
    want = (e / (1e-6 + np.array(m)) ** 0.98 + 2) ** 0.5 - 2 ** 0.5
    assert np.allclose(one(spark, A.pcen(X()), x=e), want)


@pytest.mark.parametrize("n,incl,excl", [(15, 0, 0), (16, 1, 0), (19, 1, 0), (20, 2, 1), (64, 13, 12)])
def test_window_counts(spark, n, incl, excl):
    df = spark.createDataFrame([(1, [0.1] * n)], "id int, x array<double>")
    assert W.hop_windows(df, "x", 16, 4).count() == incl
    assert W.hop_windows(df, "x", 16, 4, inclusive=False).count() == excl


def test_padded_tail_and_cap(spark):
    df = spark.createDataFrame([(1, [1.0] * 40), (2, [1.0] * 5)], "id int, x array<double>")
    got = {(r.id, r.step): sum(r.w) for r in W.hop_windows(df, "x", 16, 16, pad_tail=True).collect()}
    assert got == {(1, 0): 16, (1, 1): 16, (1, 2): 8, (2, 0): 5}
    assert W.hop_windows(df, "x", 16, 16, cap=1).count() == 1


def test_babble_is_normalised(spark):
    pool = spark.createDataFrame([(i, np.random.default_rng(i).normal(size=32).tolist()) for i in range(9)], "c int, x array<double>")
    seeds = spark.createDataFrame([(i, 2 + i % 4) for i in range(20)], "s int, k int")
    out = W.babble(seeds, "s", "k", pool, "c", "x", 1).collect()
    assert len(out) == 20 and all(max(abs(v) for v in r.mix) == pytest.approx(1.0) for r in out)
