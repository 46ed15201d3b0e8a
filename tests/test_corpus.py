import numpy as np
import pytest
from plain_render import render
from pyspark.sql import functions as F

from echoloom.plans import corpus as P
from echoloom.plans import dims


@pytest.fixture(scope="module")
def inputs(spark):
    rng = np.random.default_rng(5)
    clips = [(i, f"c{i % 4}", rng.normal(0, 0.2, int(rng.integers(30, 90))).tolist()) for i in range(40)]
    return (spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("y")),
            spark.createDataFrame(clips, "clip int, c string, x array<double>"))


def test_batch_form_equals_plain_chain(inputs):
    samples, clips = inputs
    args = (samples, "k", clips, "c", "clip", "x", 64, 3)
    rows = {r.k: r for r in P.gather(*args).collect()}
    made = {r.k: r for r in P.build(*args).collect()}
    assert set(rows) == set(made) and len(made) == 400
    for k, r in rows.items():
        x, level = render(r.base, [v.samples for v in r.stack], [v.snr for v in r.stack], r, 64)
        assert np.allclose(x, made[k].x, atol=1e-9), k
        assert level == pytest.approx(made[k].lvl)


def test_batch_sizes_do_not_matter(inputs, monkeypatch):
    samples, clips = inputs
    args = (samples, "k", clips, "c", "clip", "x", 64, 3)
    one = {r.k: r.x for r in P.build(*args).collect()}
    monkeypatch.setattr(P, "BATCH_SAMPLES", 64)
    assert all(np.allclose(one[r.k], r.x, atol=1e-12) for r in P.build(*args).collect())


def test_plan_respects_recipes_and_labels(inputs):
    samples, clips = inputs
    rows = P.build(samples, "k", clips, "c", "clip", "x", 64, 3).collect()
    recipe = {b: r for b, _, r, _, _ in dims.BUCKETS}
    spans = {r: snr for r, _, snr, _ in dims.RECIPES}
    for r in rows:
        assert r.bucket.startswith("P" if r.y else "N")
        assert r.group.startswith("pos|" if r.y else "neg|")
        ranges = spans[recipe[r.bucket]]
        if not ranges:
            assert r.snr is None and r.group.endswith("direct")
        else:
            lo, hi = (sum(v[i] for v in ranges) / len(ranges) for i in (0, 1))
            assert lo <= r.snr <= hi
        assert len(r.x) == 64 and max(abs(v) for v in r.x) <= 1.0


def test_rerun_gives_identical_rows(inputs):
    samples, clips = inputs
    def digest():
        out = P.build(samples.repartition(3), "k", clips.repartition(5), "c", "clip", "x", 64, 3)
        return sorted((r.k, r.split, r.bucket, round(sum(r.x), 9)) for r in out.collect())
    assert digest() == digest()


def test_looked_up_clips_equal_joined_ones_and_do_not_move(inputs, monkeypatch):
    samples, clips = inputs
    clips = clips.withColumn("c", F.when(F.col("c") != "c2", F.col("c")))           # a class without a name
    make = lambda: P.build(samples, "k", clips, "c", "clip", "x", 64, 3)             # noqa: E731
    few = make()
    assert "base" not in few._jdf.queryExecution().optimizedPlan().toString()        # no array of a clip is in the plan
    monkeypatch.setattr("echoloom.session.LOOKUP_BYTES", 0)
    many = {r.k: r for r in make().collect()}
    one = {r.k: r for r in few.collect()}
    assert set(one) == set(many) and len(one) == 400
    for k, r in one.items():
        w = many[k]
        assert (r.y, r.bucket, r.split, r.group) == (w.y, w.bucket, w.split, w.group) and (r.snr is None) == (w.snr is None)
        assert np.allclose(r.x, w.x, atol=1e-12) and r.lvl == pytest.approx(w.lvl)


def test_many_clips_are_looked_up_in_files_and_do_not_move(inputs, monkeypatch):
    samples, clips = inputs
    clips = clips.withColumn("c", F.when(F.col("c") != "c2", F.col("c"))).withColumn("x", F.when(F.col("clip") != 9, F.col("x")))      # a class without a name, a clip without a signal
    make = lambda: P.build(samples, "k", clips, "c", "clip", "x", 64, 3)             # noqa: E731
    few = {r.k: r for r in make().collect()}
    monkeypatch.setattr("echoloom.session.LOOKUP_BYTES", 10_000)                     # the clips take four times as much
    many = make()
    assert "base" not in many._jdf.queryExecution().optimizedPlan().toString()       # no array of a clip is in the plan
    many = {r.k: r for r in many.collect()}
    assert many == few and len(few) == 400
