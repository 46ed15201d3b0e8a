import numpy as np
import pytest

from echoloom.functions import features as L
from echoloom.operators.clipwindows import mel_energy, mel_table
from pyspark.sql import functions as F


def explicit(x):
    """Log-mel by explicit sums: no FFT and no shared code with the job but the filter table."""
    x = np.pad(np.asarray(x, float)[:16000], (0, max(0, 16000 - len(x))))
    win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(480) / 479)
    basis = np.exp(-2j * np.pi * np.outer(np.arange(257), np.arange(480)) / 512)
    out = []
    for t in range((16000 - 480) // 320 + 1):
        out.append(np.abs(basis @ (x[t * 320:t * 320 + 480] * win)) ** 2 @ L.mel_matrix())
    return np.log(np.array(out) + 1e-5)


def clips():
    t = np.arange(16001) / 16000.0
    tone = 0.4 * np.sin(2 * np.pi * 440 * t) + 0.2 * np.sin(2 * np.pi * 3000 * t)
    impulse = np.zeros(16000)
    impulse[5000] = 1.0
    return {"short": tone[:15999], "exact": tone[:16000], "long": tone, "silence": np.zeros(16000), "impulse": impulse}


def test_log_mel_against_explicit_sums(spark):
    data = clips()
    df = spark.createDataFrame([(k, v.tolist()) for k, v in data.items()], "id string, samples array<double>")
    for r in L.log_mel(df).collect():
        got = np.array(r.features).reshape(49, 40)
        assert np.allclose(got, explicit(data[r.id]), atol=2e-3), r.id


def test_silence_sits_at_the_floor():
    assert np.allclose(L.to_features(np.zeros((1, 16000))), np.log(1e-5))


def test_filterbank_has_forty_bands_below_the_top():
    m = L.mel_matrix()
    assert m.shape == (257, 40) and m.min() >= 0 and m.max() <= 1
    assert not m[int(513 * 7500 / 16000) + 1:].any()


def test_mel_energy_join_equals_matrix_product(spark):
    rng = np.random.default_rng(0)
    power = rng.random((3, 257))
    rows = [(i, k, float(power[i, k])) for i in range(3) for k in range(257)]
    df = spark.createDataFrame(rows, "clip int, bin int, e double")
    got = {(r.clip, r.band): r.energy for r in mel_energy(df, ["clip"], mel_table(spark)).collect()}
    want = power @ L.mel_matrix()
    for (c, b), v in got.items():
        assert v == pytest.approx(want[c, b])


def test_pcen_variant_runs(spark):
    df = spark.createDataFrame([(1, clips()["exact"].tolist())], "id int, samples array<double>")
    r = L.log_mel(df, use_pcen=True).select(F.size("features").alias("n")).first()
    assert r.n == 1960


def test_long_signals_row_by_row_equal_the_matrix_form(monkeypatch):
    from echoloom.functions import batch as B
    rng = np.random.default_rng(4)
    size = rng.integers(0, 6000, 30)
    bank = B.Bank(rng.normal(0, 0.2, int(size.sum())), np.cumsum(size) - size, size)
    which, factor, u, x = rng.integers(0, 30, 40), rng.choice([1.0, 0.8, 1.22], 40), rng.random(40), rng.normal(0, 0.3, (40, 3000))
    beta = np.append(rng.uniform(-0.25, 0.25, 39), 0.0)
    made = lambda: [bank.fitted(which, factor, u, 3000), bank.fitted(which, factor, u, 3000, True), bank.sliced(which, u, 3000), bank.tiled(which, 3000), B.cadence(x, beta)]
    rows = made()
    monkeypatch.setattr(B, "LONG", 1 << 30)
    assert all(np.allclose(a, b, atol=1e-12, rtol=0) for a, b in zip(rows, made(), strict=True))
