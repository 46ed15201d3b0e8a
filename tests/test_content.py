"""The build by content: pools, draws and rendered signals against plain versions."""

from collections import Counter

import numpy as np
import pytest
from plain_render import _add_layer, _dbfs, _fit, _guard, _set_level, _stretch
from pyspark.sql import functions as F

from echoloom.plans import content as C
from echoloom.plans import dims

KINDS = ["word", "filler", "confus", "speech", "command", "noise", "noise"]


@pytest.fixture(scope="module")
def inputs(spark):
    rng = np.random.default_rng(5)
    clips = [(i, i % 7, rng.normal(0, 0.2, int(rng.integers(20, 150))).tolist()) for i in range(70)]
    samples = spark.range(600).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    return samples, spark.createDataFrame(clips, "clip int, c int, x array<double>")


def kind():
    return F.element_at(F.array(*map(F.lit, KINDS)), F.col("c") + 1)


def plain(row, refs, clips, window):
    """One sample, step by step."""
    x = np.zeros(window)
    sliced = lambda r: (lambda s: s[int(np.floor(r.place * (len(s) - window + 1))):][:window] if len(s) > window else np.resize(s, window))(np.array(clips[r["item"]]))
    talk = []
    for r in sorted(refs, key=lambda r: (r.role, r.idx)):
        if r.role == C.BASE:
            x = sliced(r) if row.speed is None else _fit(_stretch(np.array(clips[r["item"]]), row.speed), window, row.offset)
        elif r.role == C.TALKER:
            talk.append(sliced(r) * 10 ** (r.amount / 20))
        else:
            if talk:
                x, talk = _guard(sum(talk) / np.max(np.abs(sum(talk)))), []
            x = _add_layer(x, sliced(r), r.amount)
    if talk:
        x = _guard(sum(talk) / np.max(np.abs(sum(talk))))
    x = _guard(x)
    if row.beta is not None:
        t = np.arange(window) / (window - 1)
        x = np.interp(t, np.clip(t + row.beta * t * (1 - t), 0, 1), x)
    for b in row.bursts:
        x[b.start:b.start + b.width] = 0.0
    if row.bits is not None:
        q = 2.0 ** row.bits / 2 - 0.5
        x = np.rint((np.clip(x, -1, 1) + 1) * q) / q - 1
    x = _guard(x)
    if row.clip_neg is not None:
        x = np.clip(x, -row.clip_neg, row.clip_pos)
    x = _set_level(x, row.level)
    if _dbfs(x) < -70:
        x = np.clip(x * 10 ** ((row.level - _dbfs(x)) / 20), -1, 1)
    return x


def test_signals_equal_the_plain_chain(inputs):
    samples, clips = inputs
    table = C.pool_table(clips, "clip", "c", kind(), 3)
    plan = C.planned(samples, "k", 64, 3)
    refs = {}
    for r in C.draw(plan, "k", table, 3).collect():
        refs.setdefault(r.k, []).append(r)
    rows, known = {r.k: r for r in plan.collect()}, {r.clip: r.x for r in clips.collect()}
    made = {r.k: r for r in C.build(samples, "k", clips, "clip", "c", "x", kind(), 64, 3).collect()}
    assert set(rows) == set(made) and len(made) == 600
    for k, r in rows.items():
        x = plain(r, refs[k], known, 64)
        assert np.allclose(x, made[k].x, atol=1e-9), (k, r.mix_content)
        assert made[k].lvl == pytest.approx(_dbfs(np.array(made[k].x)))
        layers = [v for v in refs[k] if v.role == C.LAYER]
        assert made[k].snr == pytest.approx(np.mean([v.amount for v in layers]) if layers else 40.0)
        classes = "|".join(str(v.klass) for v in sorted(layers, key=lambda v: v.idx)) or "direct"
        assert made[k].group == ("pos|" if r.y else "neg|") + classes


def test_draws_keep_to_their_pools(inputs):
    samples, clips = inputs
    plan = C.planned(samples, "k", 64, 3)
    draws = C.draw(plan, "k", C.pool_table(clips, "clip", "c", kind(), 3), 3).collect()
    allowed = {"word": {0}, "filler": {1}, "confus": {2}, "real": {3, 4}, "talker": {3, 4}, "noise": {5, 6}}
    assert all(r.klass in allowed[r.pool] for r in draws) and {r.pool for r in draws} == set(allowed)
    content = {b: c for b, c, _, _, _ in dims.BUCKETS}
    talkers = Counter(r.k for r in draws if r.role == C.TALKER)
    spans = {r: snr for r, _, snr, _ in dims.RECIPES}
    for r in plan.collect():
        assert (2 <= talkers[r.k] <= 8) == (content[r.mix] == "babble")
        assert r.speed is None or content[r.mix] in C.SPEED and (r.speed == 1.0 or C.SPEED[content[r.mix]][1] <= r.speed <= C.SPEED[content[r.mix]][2])
        assert len(r.bursts) <= 1 + int(2 * r.aggr) and (len(r.bursts) > 0) == r.dropout and r.bits in (None, 6, 8)
        own = sorted((d.idx, d.amount) for d in draws if d.k == r.k and d.role == C.LAYER)
        assert len(own) == len(spans[r.mix_recipe]) and all(lo <= a <= hi for (_, a), (lo, hi) in zip(own, spans[r.mix_recipe], strict=True))


def test_missing_pools_fall_back(spark, inputs):
    _, clips = inputs
    some = clips.filter("c IN (0, 2, 3, 5)")                                   # no filler, no commands
    pools = {(r.pool, r.klass) for r in C.pools(some, "clip", "c", kind()).collect()}
    assert pools == {("word", 0), ("filler", 2), ("confus", 2), ("real", 3), ("talker", 3), ("noise", 5)}
    noise = C.pools(clips.filter("c <> 6 OR clip < 20"), "clip", "c", kind()).filter("pool = 'noise'").groupBy("klass").agg(F.sum("weight").alias("w")).collect()
    assert all(abs(r.w - C.CLASS_UNITS) < 100 for r in noise)                   # classes weigh the same, whatever their size


def test_reruns_agree_and_features_are_complete(inputs):
    samples, clips = inputs
    one = {r.k: (r.split, round(sum(r.x), 9)) for r in C.build(samples, "k", clips, "clip", "c", "x", kind(), 64, 3).collect()}
    two = {r.k: (r.split, round(sum(r.x), 9)) for r in C.build(samples.repartition(3), "k", clips.repartition(5), "clip", "c", "x", kind(), 64, 3).collect()}
    assert one == two
    f = C.build(samples.filter("k < 20"), "k", clips, "clip", "c", "x", kind(), 16000, 3, features=True, repeat=True).collect()
    assert len(f) == 20 and all(len(r.features) == 1960 and np.isfinite(r.features).all() for r in f)


def test_looked_up_clips_equal_joined_ones_and_do_not_move(inputs, monkeypatch):
    samples, clips = inputs
    make = lambda: C.build(samples, "k", clips.filter("clip <> 11"), "clip", "c", "x", kind(), 64, 3)      # noqa: E731
    few = make()
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "samples" not in plan and "Aggregate" not in plan.split("Join LeftOuter")[0]
    monkeypatch.setattr("echoloom.session.LOOKUP_BYTES", 0)
    many = {r.k: r for r in make().collect()}
    one = {r.k: r for r in few.collect()}
    assert set(one) == set(many) and len(one) == 600
    for k, r in one.items():
        w = many[k]
        assert (r.y, r.bucket, r.split, r.group) == (w.y, w.bucket, w.split, w.group) and r.snr == pytest.approx(w.snr)
        assert np.allclose(r.x, w.x, atol=1e-12) and r.lvl == pytest.approx(w.lvl)


def test_many_clips_are_looked_up_in_files_and_do_not_move(inputs, monkeypatch):
    samples, clips = inputs
    make = lambda: C.build(samples, "k", clips, "clip", "c", "x", kind(), 64, 3)      # noqa: E731
    few = {r.k: r for r in make().collect()}
    monkeypatch.setattr("echoloom.session.LOOKUP_BYTES", 20_000)                      # the clips take five times as much
    many = make()
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert "samples" not in plan and "Aggregate" not in plan.split("Join LeftOuter")[0]
    many = {r.k: r for r in many.collect()}
    assert many == few and len(few) == 600
