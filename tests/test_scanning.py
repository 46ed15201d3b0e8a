"""Scans of recordings against a plain loop over windows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoloom.operators import scanning as S

W = [((i * 7) % 11 - 5) / 8.0 for i in range(12)]
MODEL = S.linear_model(W, -0.25)


def plain(rows, scan):
    """[(id, start, p)], {windows, scored, samples} from the definitions."""
    found, windows, scored, samples = [], 0, 0, 0
    for k, x in rows:
        x = np.nan_to_num(np.array(x if x is not None else [], float))
        samples += len(x)
        if scan.whole:
            starts = [0] if len(x) else []
            x = np.pad(x[:scan.window], (0, max(0, scan.window - len(x))))
        else:
            starts = [s * scan.stride for s in range(0, max(0, (len(x) - scan.window) // scan.stride), scan.every)]
        for s in starts:
            windows += 1
            w = x[s:s + scan.window]
            if scan.gate is not None and np.sqrt(np.mean(w * w)) < scan.gate:
                continue
            scored += 1
            p = 1 / (1 + np.exp(-(w @ np.array(W) - 0.25)))
            if p >= scan.threshold:
                found.append((k, s, p))
    if scan.keep:
        found = sorted(found, key=lambda r: (-r[2], r[0], r[1]))[:scan.keep]
    return found, (samples, windows, scored)


def recordings(n=40, seed=3):
    rnd = np.random.default_rng(seed)
    rows = [(i, (rnd.integers(-64, 64, rnd.integers(0, 200)) / 64.0).tolist()) for i in range(n)]
    return rows + [(100, None), (101, []), (102, [0.5] * 12), (103, [0.0] * 500), (104, (rnd.integers(-64, 64, 5000) / 64.0).tolist())]


@pytest.mark.parametrize("scan", [S.Scan(12, 3, 0.4), S.Scan(12, 5, 0.6, gate=0.55, every=2), S.Scan(12, 4, 0.3, keep=25), S.Scan(12, 1, 0.2, gate=0.5, keep=7), S.Scan(12, 3, 0.4, whole=True)])
@pytest.mark.parametrize("segment, batch", [(512, 1024), (7, 5)])
def test_scan_equals_plain_loop(spark, monkeypatch, scan, segment, batch):
    monkeypatch.setattr(S, "SEGMENT", segment)
    monkeypatch.setattr(S, "BATCH", batch)
    rows = recordings()
    df = spark.createDataFrame(rows, "clip long, x array<double>").repartition(6)
    m = S.scan_clips(df, "clip", "x", scan, MODEL, rebalance=segment == 7)
    want, account = plain(rows, scan)
    got = sorted((r["clip"], r["start"], round(r["p"], 9)) for r in m.found.collect())
    assert got == sorted((k, s, round(p, 9)) for k, s, p in want)
    a = m.account.collect()[0]
    assert (a["scanned_samples"], a["scanned_windows"], a["scored_windows"]) == account and a["recordings"] == len(rows)


def test_bytes_are_samples_and_carried_columns_stay(spark):
    raw = bytes(range(40, 240))
    df = spark.createDataFrame([(1, "a", bytearray(raw)), (2, "b", None)], "clip long, kind string, x binary")
    scan = S.Scan(12, 3, 0.0)
    m = S.scan_clips(df, "clip", "x", scan, MODEL, carry=["kind"], samples=True)
    x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    got = {r["start"]: r for r in m.found.collect()}
    assert len(got) == (200 - 12) // 3 and {r["kind"] for r in got.values()} == {"a"}
    assert all(np.allclose(r["samples"], x[s:s + 12]) and r["step"] * 3 == s for s, r in got.items())
    assert {(r["kind"], r["scanned_samples"]) for r in m.account.collect()} == {("a", 200), ("b", 0)}


def test_sources_meet_in_one_summary(spark):
    df = spark.createDataFrame(recordings(), "clip long, x array<double>")
    parts = {"scene": S.scan_clips(df, "clip", "x", S.Scan(12, 3, 0.4), MODEL), "word": S.scan_clips(df, "clip", "x", S.Scan(12, 3, 2.0, whole=True), MODEL)}
    found, account = S.hard_negatives(parts)
    out = {r["source"]: r for r in S.summary(found, account).collect()}
    assert out["scene"]["n"] == found.count() > 0 and out["word"]["n"] == 0 and out["word"]["max_p"] is None
    assert out["scene"]["hours"] == pytest.approx(out["scene"]["scanned_samples"] / 16000 / 3600)
    assert found.filter("y <> 0").count() == 0


def test_segments_cover_every_window_once(spark):
    df = spark.range(30).select(F.col("id").alias("clip"), F.transform(F.sequence(F.lit(1), (1 + F.col("id") * 37).cast("int")), lambda v: v.cast("double")).alias("x"))
    scan = S.Scan(12, 3, 0.0, every=2)
    cut = S.segments(df, "clip", "x", scan, [], per=4).collect()
    for k in range(30):
        own = sorted((r for r in cut if r["clip"] == k), key=lambda r: r["first"])
        n = 1 + 37 * k
        assert sum(r["own"] for r in own) == n
        starts = [int(r["part"][0]) - 1 + 6 * j for r in own for j in range(r["windows"])]
        assert starts == [3 * s for s in range(0, max(0, (n - 12) // 3), 2)]
        assert all(len(r["part"]) <= 3 * 6 + 12 for r in own)


def test_features_model_reads_log_mel(spark):
    x = np.random.default_rng(0).standard_normal((2, 16000))
    p = S.on_features(lambda f: f.reshape(len(f), -1).mean(1))(x)
    assert p.shape == (2,) and np.isfinite(p).all()


def test_parts_are_scanned_in_one_pass_and_may_overlap(spark):
    from echoloom.operators import mining as H

    w = spark.createDataFrame([(1, "a", 9.0, 0.9), (2, "a", 1.0, 0.9), (3, "b", 1.0, 0.2), (4, "b", 9.0, 0.1), (5, None, 9.0, 0.9)], "id int, c string, loud double, p double")
    loud = F.col("loud") >= 5.0
    out = H.hard_negatives(w, {"gated": (F.col("c") == "a", loud, 0.5), "all": (F.lit(True), F.lit(True), 0.15), "none": (F.col("c") == "z", loud, 0.0)})
    assert sorted((r.source, r.id) for r in out.collect()) == [("all", 1), ("all", 2), ("all", 3), ("all", 5), ("gated", 1)]


def test_the_three_sources_read_the_stream_once(spark, sf):
    from echoloom import catalog

    plan = catalog.queries()["h1_hard_negatives_three_sources"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2        # the rows, and the buckets of their numbering
