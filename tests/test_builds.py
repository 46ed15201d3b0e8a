"""Incremental builds, compaction, Newton training and confusable negatives against plain versions."""

import numpy as np
import pytest
from plain_render import _guard
from pyspark.sql import functions as F

from echoloom.functions.features import Shape, to_features
from echoloom.operators import scoring as T
from echoloom.plans import confusable as C
from echoloom.sources import builds
from echoloom.sources import tables as SRC


def test_a_build_redoes_changed_parts_only(spark, tmp_path):
    path, seen = f"{tmp_path}/bundle", []

    def make(df):
        seen.append(df.count())
        return df.withColumn("twice", F.col("v") * 2)

    def step(rows, config=None):
        df = spark.createDataFrame(rows, "k string, v long")
        r = builds.build(df, "k", ["k", "v"], make, path, config or {"a": 1}, parts=8)
        have = sorted((x.k, x.v, x.twice) for x in builds.read(spark, path, "k string, v long, twice long").collect())
        assert have == sorted((k, v, v * 2) for k, v in rows)
        return r

    rows = [(f"k{i}", i) for i in range(200)]
    first = step(rows)
    assert first["rebuilt"] == first["parts"] == 8 and not first["reused"] and first["rows"] == 200
    again = step(list(reversed(rows)))                                         # the order does not matter
    assert again["reused"] and again["build_key"] == first["build_key"] and len(seen) == 1
    one = step([("k0", 99), *rows[1:]])
    assert one["rebuilt"] == 1 and one["rows"] == seen[-1] < 60 and one["build_key"] != first["build_key"]
    few = step(rows[:3])
    assert few["removed"] >= 5 and few["rebuilt"] >= 1
    assert step(rows[:3], {"a": 2})["rebuilt"] == few["parts"]                # another configuration redoes everything
    assert step(rows)["rebuilt"] == 8


def test_compaction_reports_rows_and_bytes(spark, tmp_path):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, rng.random(50).tolist()) for i in range(300)], "k int, x_f array<double>")
    df.write.parquet(f"{tmp_path}/a")
    r = SRC.compact_folder(spark, f"{tmp_path}/a", f"{tmp_path}/b")
    assert r["rows_before"] == r["rows_after"] == 300 and r["bytes_after"] < 0.7 * r["bytes_before"]
    assert spark.read.parquet(f"{tmp_path}/b").schema["x_f"].dataType.simpleString() == "array<float>"


def test_newton_equals_plain_iterations(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([np.ones(500), rng.normal(size=(500, 3))])
    y = (rng.random(500) < 1 / (1 + np.exp(-(x @ [0.3, 1.0, -2.0, 0.0])))).astype(int)
    w = rng.uniform(0.5, 2.0, 500)
    rows = [(r.tolist(), int(a), float(b)) for r, a, b in zip(x, y, w)] + [(None, 1, 1.0), ([1.0, None, 0.0, 0.0], 0, 1.0), ([1.0, 0.0, 0.0, 0.0], None, 1.0)]
    got = T.newton(spark.createDataFrame(rows, "x array<double>, y int, w double").repartition(5), steps=7)
    beta = np.zeros(4)
    for _ in range(7):
        p = 1 / (1 + np.exp(-(x @ beta)))
        beta = beta + np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(4), x.T @ (w * (y - p)) - 1e-3 * beta)
    assert np.allclose(got, beta, atol=1e-9) and abs(got[2] + 2) < 0.6
    assert T.newton(spark.createDataFrame([], "x array<double>, y int, w double")).size == 0


def test_confusable_negatives_equal_the_plain_chain(spark):
    rng = np.random.default_rng(4)
    clips = [(i, rng.normal(0, 0.3, int(rng.integers(20, 90))).tolist()) for i in range(30)]
    df = spark.createDataFrame(clips, "clip int, x array<double>")
    bases, noises = df.filter("clip < 12"), df.filter("clip >= 12")
    words = spark.createDataFrame([(w,) for w in ("lamp", "lump", "limp", "ramp", "camp")], "word string")
    made = {(r.word, r.voice, r.variant): r for r in C.negatives(words, 3, bases, noises, "clip", "x", 64, 7).collect()}
    from echoloom.operators.running import hash_ordinal
    number = lambda pool, salt: {r.i: dict(clips)[r.clip] for r in hash_ordinal(pool.select("clip"), [], ["clip"], 7, salt, "i").collect()}
    spoken, noise = number(bases, "spoken"), number(noises, "noises")
    plans = C.plan(words, 3, F.lit(12), F.lit(18), 7).collect()
    assert len(made) == len(plans) == 45
    for r in plans:
        a = np.array(spoken[r.base])
        at = int(np.floor(r.offset * (max(64 - len(a), 0) + 1)))
        x = a[:64] if len(a) >= 64 else np.pad(a, (at, 64 - len(a) - at))
        if r.beta is not None:
            t = np.arange(64) / 63
            x = np.interp(t, np.clip(t + r.beta * t * (1 - t), 0, 1), x)
        if r.first is not None:
            assert r.first != r.second
            fit = lambda n: np.pad(np.array(n)[:64], (0, max(0, 64 - len(n))))
            n1, n2 = fit(noise[r.first]), fit(noise[r.second])
            clean = np.mean(x * x) + 1e-8
            gain = lambda n, s: np.sqrt(clean / 10 ** (s / 10) / (np.mean(n * n) + 1e-8))
            x = _guard(x + n1 * gain(n1, r.snr1) + n2 * gain(n2, r.snr2))
        if r.bits is not None:
            q = 2.0 ** r.bits / 2 - 0.5
            x = np.rint((np.clip(x, -1, 1) + 1) * q) / q - 1
        m = made[r.word, r.voice, r.variant]
        assert np.allclose(m.x, x, atol=1e-9) and m.y == 0 and m.bucket == C.TAG


def test_small_shapes_give_other_matrices():
    x = np.random.default_rng(1).standard_normal((3, 64))
    f = to_features(x, shape=Shape(64, 48, 8, 64, 10, 3))
    assert f.shape == (3, 3, 10) and not np.allclose(f[:, 0], f[:, 1])
    assert to_features(np.zeros((1, 16000))).shape == (1, 49, 40)


@pytest.mark.parametrize("n", [0, 1])
def test_without_two_noises_no_pair_is_mixed(spark, n):
    words = spark.createDataFrame([("a",), ("b",)], "word string")
    assert C.plan(words, 2, F.lit(3), F.lit(n), 1).filter("snr1 IS NOT NULL OR first IS NOT NULL").count() == 0
