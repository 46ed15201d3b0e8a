import pytest
from pyspark.sql import functions as F

from echoloom.functions import draws as D
from echoloom.operators import joins as J
from echoloom.operators import sampling as S


def strata(spark, sizes):
    rows = [(s, i) for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "s string, id int")


def test_small_strata_keep_a_validation_row(spark):
    out = S.stratified_split(strata(spark, {"a": 1, "b": 2, "c": 3, "d": 100}), ["s"], ["id"])
    got = {r.s: r.n for r in out.filter("split = 'val'").groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 1, "b": 1, "c": 1, "d": 20}


@pytest.mark.parametrize("size,val", [(5, 2), (7, 4)])
def test_half_even_rounding(spark, size, val):
    out = S.stratified_split(strata(spark, {"a": size}), ["s"], ["id"], val_frac=0.5)
    assert out.filter("split = 'val'").count() == val


def test_splits_are_disjoint_exhaustive_and_repeatable(spark):
    df = strata(spark, {"a": 500, "b": 30})
    for split in (lambda d: S.stratified_split(d, ["s"], ["id"]), lambda d: S.shuffled_split(d, ["s", "id"]),
                  lambda d: S.head_val(d, ["s", "id"], minimum=60)):
        a = {(r.s, r.id): r.split for r in split(df).collect()}
        b = {(r.s, r.id): r.split for r in split(df.repartition(7)).collect()}
        assert a == b and len(a) == 530


def test_quota_mix_truncates(spark):
    df = spark.range(107).withColumnRenamed("id", "k")
    got = {r.part: r.n for r in S.quota_mix(df, ["k"], {"a": 0.55, "b": 0.10, "c": 0.20}, "d", 1, "q").groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 58, "b": 10, "c": 21, "d": 18}


def test_weighted_draw_boundaries(spark):
    w = {"a": 1.0, "b": 1.0, "c": 2.0}
    df = spark.createDataFrame([(0.0,), (0.2499,), (0.25,), (0.5,), (0.9999,)], "u double")
    assert [r[0] for r in df.select(D.weighted(F.col("u"), w)).collect()] == ["a", "a", "b", "c", "c"]


def test_distinct_pair_never_repeats(spark):
    out = S.distinct_pair(spark.range(2000), ["id"], F.lit(3), 1)
    assert out.filter("first = second OR second > 2 OR first > 2").count() == 0
    assert out.select("first", "second").distinct().count() == 6


def test_excluding_every_class_excludes_none(spark):
    clips = spark.createDataFrame([(1, "a"), (2, "a")], "clip int, c string")
    out = S.draw_clips(spark.range(5), ["id"], clips, "c", "clip", 1, "t", exclude=["a"])
    assert out.count() == 5


def test_draws_are_uniform_over_classes_not_clips(spark):
    clips = spark.createDataFrame([(i, "big" if i else "small") for i in range(200)], "clip int, c string")
    got = {r.c: r.n for r in S.draw_clips(spark.range(4000), ["id"], clips, "c", "clip", 1, "t").groupBy("c").agg(F.count("*").alias("n")).collect()}
    assert abs(got["small"] - 2000) < 200


def test_even_stride_and_every_nth(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    assert sorted(r.k for r in S.even_stride(df, ["k"], 10).collect()) == [int(i * 103 / 10) for i in range(10)]
    assert sorted(r.k for r in S.every_nth(df, ["k"], 10).collect()) == list(range(0, 100, 10))
    assert S.even_stride(df, ["k"], 500).count() == 103


def test_union_keeps_own_bucket_and_tags_the_rest(spark):
    a = spark.createDataFrame([(1, "x")], "id int, bucket string")
    b = spark.createDataFrame([(2,)], "id int")
    got = {r.id: r.bucket for r in S.union_with_provenance([(a, "T"), (b, "T")]).collect()}
    assert got == {1: "x", 2: "T"}


def test_unknown_bucket_weighs_one(spark):
    s = spark.createDataFrame([("a",), ("z",)], "bucket string")
    w = spark.createDataFrame([("a", 1.3)], "bucket string, weight double")
    assert {r.bucket: r.weight for r in J.with_loss_weight(s, w, "bucket").collect()} == {"a": 1.3, "z": 1.0}


def test_held_out_isolation_with_many_copies(spark):
    pool = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"t{i}") for i in range(90)], "id int, t string")
    ev = spark.createDataFrame([("same",), ("same",), ("t1",)], "t string")
    clean, leaked = J.held_out(pool, ev, "t")
    assert leaked.count() == 31 and clean.count() == 59


def test_layers_of_a_small_bank_are_drawn_in_the_row(spark):
    clips = spark.createDataFrame([("a", "x1"), ("a", "x2"), (None, "y1"), ("b", "z1"), ("b", "z2"), ("b", "z3")], "c string, clip string")
    snr = F.expr("array(named_struct('lo', 1.0D, 'hi', 2.0D), named_struct('lo', -3.0D, 'hi', 4.0D))")
    samples = spark.range(300).select("id", (F.col("id") % 4 - 1).cast("int").alias("n"), snr.alias("snr"), F.lit("k").alias("kept")).withColumn("n", F.when(F.col("id") != 7, F.col("n")))
    draw = lambda df, bank, **kw: J.draw_layers(df, "id", F.col("n"), F.col("snr"), bank, "c", "clip", 5, ["kept"], **kw)      # noqa: E731
    here, joined = draw(samples, clips, most=2), draw(samples, clips, most=2, max_bytes=0)
    assert not any(s in here._jdf.queryExecution().toString() for s in ("Join", "hashpartitioning(id")) and here.count() == 300
    assert sorted(map(repr, here.collect())) == sorted(map(repr, joined.collect()))
    assert {len(r.layers or []) for r in here.collect()} == {0, 1, 2}
    assert draw(samples, clips.limit(0), most=2).filter("layers IS NOT NULL").count() == 0
    with pytest.raises(Exception, match="more than 1 layers"):
        draw(samples, clips, most=1).collect()


def test_a_fixed_chance_is_the_drawn_one_without_a_number(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 7).alias("b"))
    first = int(rows.limit(1).select(D.uniform(3, "s", "id", "b") * D.TWO32).first()[0])
    ps = [0.0, -0.5, 1e-12, 0.25, 0.6, 0.7, 1.0 - 2.0 ** -33, 1.0, 1.5, first / D.TWO32, (first + 0.5) / D.TWO32, (first + 1) / D.TWO32]
    same = [F.count_if(D.chance(3, "s", p, "id", "b") != D.bernoulli(D.uniform(3, "s", "id", "b"), p)).alias(f"p{i}") for i, p in enumerate(ps)]
    assert set(rows.agg(*same).first()) == {0}
    assert "conv(" not in rows.select(D.chance(3, "s", 0.6, "id", "b"))._jdf.queryExecution().toString()
    one = rows.select("id", "b", D.joined("id", "b").alias("k"))
    assert one.filter(D.digest(3, "s", "id", "b", F.lit(1)) != D.digest(3, "s", "k", F.lit(1))).count() == 0
