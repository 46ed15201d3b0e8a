"""Whitening: the solver against numpy's SVD, the operator against a plain eigen-decomposition of the covariance."""

import numpy as np
import pytest

from echoloom.llm import bidiagonal, whitening

SCHEMA = "vec_id long, embedding array<float>"


def rotated(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return np.linalg.qr(np.diag(values) @ q, mode="r")


@pytest.mark.parametrize("r", [
    np.triu(np.random.default_rng(1).standard_normal((64, 64))), np.eye(9), np.zeros((5, 5)), np.diag([3.0, 3, 3, 3, 1, 1, 2, 2]), np.array([[2.0]]),
    rotated([5.0] * 6 + [1.0] * 20), rotated([5, 5 - 1e-12, 5 - 2e-12, 3, 3, 3] + [1e-8] * 20), rotated([5.0, 5, 1, 1] + [0.0] * 20),
    rotated([10.0 ** -i for i in range(40)]), rotated([7.0, 2.0, 0.0, 0.0])])
def test_solver_equals_numpy(r):
    values, v = bidiagonal.leading(r, 4)
    want = np.linalg.svd(r, compute_uv=False)
    assert np.allclose(values, want, rtol=0, atol=1e-13 * max(want[0], 1e-300))
    k = v.shape[1]
    assert k == min(4, int(np.sum(want > len(r) * 2.3e-16 * want[0]))) if want[0] > 0 else k == 0
    assert np.allclose(v.T @ v, np.eye(k), atol=1e-12)
    assert np.allclose(r.T @ (r @ v), v * values[:k] ** 2, atol=1e-12 * max(want[0] ** 2, 1e-300))


def test_small_singular_values_keep_their_digits():
    a, b = 10.0 ** -np.arange(20), 0.3 * 10.0 ** -np.arange(19)
    values = bidiagonal.singular_values(a, b)
    # the product of all values is that of the diagonal, however small they are
    assert abs(np.sum(np.log(values)) - np.sum(np.log(a))) < 1e-11


def check(spark, rows, dims, components=4):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in whitening.whiten(df).collect():
        got.setdefault((r["vec_id"], r["component"]), []).append(r)
    good = [(k, [int(np.floor(256 * float(np.float32(c)))) for c in v] + [0] * (dims - len(v))) for k, v in rows
            if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array(sorted({tuple(v) for _, v in good}), dtype=float)
    n, s = len(x), [int(c) for c in x.sum(0)]
    centred = x - x.mean(0)
    e, vec = np.linalg.eigh(centred.T @ centred / n)
    e, vec = e[::-1], vec[:, ::-1]
    assert {k for k in got} == {(k, c + 1) for k, _ in good for c in range(min(components, dims))}
    for c in range(min(components, dims)):
        sign = None
        for k, v in good:
            row = got[k, c + 1][0]
            dev = [n * a - b for a, b in zip(v, s, strict=True)]
            assert row["n"] == n and row["deviation"] == sum(a * a for a in dev) and row["identity_error"] < 1e-9
            if e[c] < 1e-9:
                assert row["whitened"] is None and row["explained"] == 0.0
                continue
            assert row["explained"] == pytest.approx(e[c] / e.sum(), rel=1e-9)
            want = float(np.dot(np.array(dev) / n, vec[:, c]) / np.sqrt(e[c]))
            if sign is None and abs(want) > 0.1:
                sign = np.sign(want * row["whitened"])
            assert row["whitened"] == pytest.approx(want * (sign or 1), abs=1e-7) or abs(want) <= 0.1
    assert len(got) == len({k for k, _ in good}) * min(components, dims)


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((400, 12)) * np.linspace(2, 0.2, 12)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[0].tolist()) for i in range(300)]
    rows += [(2000, None), (2001, [float("nan")] * 12), (2002, [None] + [0.0] * 11), (2003, [float("inf")] + [0.0] * 11), (2004, [1.0, -1.0]), (2005, [])]
    check(spark, rows, 12)


def test_fewer_directions_than_components(spark):
    check(spark, [(1, [1.0, 0.0, 0.0, 0.0, 0.0]), (2, [0.0, 2.0, 0.0, 0.0, 0.0]), (3, [0.0, 0.0, 0.5, 0.0, 0.0]), (4, [1.0, 0.0, 0.0, 0.0, 0.0])], 5)
    check(spark, [(1, [1.0, 0.5]), (2, [-1.0, 0.25]), (3, [0.0, 3.0])], 2)


def test_blocks_and_factors_do_not_change_the_result(spark, monkeypatch):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 6)))], SCHEMA)
    one = {(r["vec_id"], r["component"]): r["whitened"] for r in whitening.whiten(df.coalesce(1)).collect()}
    monkeypatch.setattr(whitening, "BLOCK", 7)
    monkeypatch.setattr(whitening, "FAN", 2)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        many = {(r["vec_id"], r["component"]): r["whitened"] for r in whitening.whiten(df.repartition(13)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one.keys() == many.keys() and all(abs(abs(one[k]) - abs(many[k])) < 1e-9 for k in one)


def test_odd_tables(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [float("nan")])], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [])], SCHEMA)).collect() == []
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], SCHEMA)).collect()
    assert len(same) == 4 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None for r in same)
    clash = spark.createDataFrame([(1, [1.0, 2.0], "a", 3), (2, [0.0, 1.0], "b", 4)], SCHEMA + ", k string, component int")
    assert whitening.whiten(clash).count() == 4
    huge = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 2.0])], SCHEMA)
    out = whitening.whiten(huge).collect()
    assert len(out) == 6 and {r["deviation"] for r in out if r["vec_id"] != 3} == {None} and all(r["spread"] >= 0 for r in out)


def test_deviations_are_exact_up_to_the_end_of_a_long():
    c = whitening.Centring(1, [0, 0])
    rows = [[3037000499, 0], [3037000500, 0], [2 ** 31, 2 ** 31], [2147483647, 2147483648], [-5, 7], [2 ** 40, 1]]
    want = [a * a + b * b for a, b in rows]
    assert c.deviations(np.array(rows, np.int64)) == [w if w < 2 ** 63 else None for w in want]
    assert c.deviations(np.array(rows, object)) == [w if w < 2 ** 63 else None for w in want]
