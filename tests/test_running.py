import numpy as np
import pytest
from pyspark.sql import functions as F

from echoloom.operators import running as R


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(0)
    rows = [(0 if i % 3 == 0 else int(rng.integers(1, 9)), i, float(np.round(rng.random(), 2))) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "k int, i bigint, v double")


def test_running_sum_and_max(skewed):
    rows, df = skewed
    out = R.running(df, ["k"], ["i"], F.floor(F.col("i") / 50), {
        "s": ("sum", F.col("v"), True), "m": ("max", F.when(F.col("v") > 0.9, F.col("i")), False)})
    got = {r.i: (r.s, r.m) for r in out.collect()}
    total, last = {}, {}
    for k, i, v in rows:
        total[k] = total.get(k, 0.0) + v
        assert got[i][0] == pytest.approx(total[k]) and got[i][1] == last.get(k)
        if v > 0.9:
            last[k] = i


def test_hash_ordinal_is_a_permutation_and_ignores_partitions(spark, skewed):
    _, df = skewed
    def positions():
        return {r.i: r.o for r in R.hash_ordinal(df, ["k"], ["i"], 5, "x", "o").collect()}
    a = positions()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert positions() == a
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    groups = {}
    for r in df.collect():
        groups.setdefault(r.k, []).append(a[r.i])
    assert all(sorted(v) == list(range(len(v))) for v in groups.values())


def test_listing_ordinal(skewed):
    rows, df = skewed
    got = [(r.v, r.i) for r in R.listing_ordinal(df, ["v", "i"], "o").orderBy("o").collect()]
    assert got == sorted((v, i) for _, i, v in rows)


@pytest.mark.parametrize("take", [0, 1, 7, 10_000])
def test_flag_lowest_takes_exactly(skewed, take):
    rows, df = skewed
    flagged = R.flag_lowest(df, ["k"], ["i"], {"t": lambda n: F.lit(take)}, 1, "s")
    got = {r.k: r.c for r in flagged.groupBy("k").agg(F.count_if("t").alias("c")).collect()}
    sizes = {k: sum(1 for r in rows if r[0] == k) for k in got}
    assert got == {k: min(take, n) for k, n in sizes.items()}
    assert flagged.count() == len(rows)


def test_take_random_is_stable_and_without_repeats(skewed):
    _, df = skewed
    a = sorted(r.i for r in R.take_random(df, 100, ["i"], 9, "p").collect())
    b = sorted(r.i for r in R.take_random(df.repartition(5), 100, ["i"], 9, "p").collect())
    assert a == b and len(set(a)) == 100


def test_exact_quantiles_match_numpy(skewed):
    rows, df = skewed
    qs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.999, "e": 1.0}
    got = {r.k: r for r in R.exact_quantiles(df, ["k"], "v", qs).collect()}
    for k in got:
        vals = [v for kk, _, v in rows if kk == k]
        for n, q in qs.items():
            assert got[k][n] == pytest.approx(np.percentile(vals, 100 * q))


def test_ladder_collapses_ties(skewed):
    rows, df = skewed
    steps = R.ladder(df, [], "v", {"n": F.lit(1)}).collect()
    assert len(steps) == len({v for _, _, v in rows})
    for s in steps:
        assert s.n_cum == sum(1 for _, _, v in rows if v >= s.v) and s.n_total == len(rows)


def test_quantiles_outside_the_unit_interval(spark):
    vals = [-5000.0, -3.5, 0.0, 2.25, 1e9, 7.0, 7.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    r = R.exact_quantiles(df, [], "v", {"m": 0.5, "p": 0.9}).first()
    assert r.m == pytest.approx(np.percentile(vals, 50)) and r.p == pytest.approx(np.percentile(vals, 90))


def test_null_keys_keep_their_rows(spark):
    rows = [(None if i % 3 == 0 else "a", None if i % 10 == 0 else i, i, i / 10.0) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, o int, i int, v double")
    assert R.hash_ordinal(df, ["k"], ["i"], 1, "s").count() == 60
    out = R.running(df, ["k"], ["o", "i"], F.floor(F.col("o") / 7), {"n": ("sum", F.lit(1), True)})
    assert {r.k: r.m for r in out.groupBy("k").agg(F.max("n").alias("m")).collect()} == {None: 20, "a": 40}
    flagged = R.flag_lowest(df, ["k"], ["i"], {"t": lambda n: F.floor(n / 2)}, 1, "s")
    assert {r.k: r.c for r in flagged.groupBy("k").agg(F.count_if("t").alias("c")).collect()} == {None: 10, "a": 20}
    q = {r.k: r.m for r in R.exact_quantiles(df, ["k"], "v", {"m": 0.5}).collect()}
    assert q[None] == pytest.approx(np.median([v for k, _, _, v in rows if k is None]))


@pytest.mark.parametrize("ranked, digits", [(1 << 16, 3), (4, 1), (1, 2)])
def test_selection_by_digits_equals_ranking(spark, monkeypatch, ranked, digits):
    import hashlib

    from echoloom.operators import running as R

    monkeypatch.setattr(R, "RANKED", ranked)
    monkeypatch.setattr(R, "LEVEL_DIGITS", digits)
    rows = [(g, f"k{i}") for g in ("a", "b", None) for i in range(200)] + [("a", "hot")] * 300 + [("c", "one")]
    df = spark.createDataFrame(rows, "g string, k string")
    takes = {"few": lambda n: F.lit(7), "half": lambda n: F.floor(n / 2), "none": lambda n: F.lit(0), "all": lambda n: n}
    got = {r[R.KEY]["g"]: r for r in R.hash_cutoffs(df, ["g"], ["k"], takes, 5, "s").collect()}
    for g in ("a", "b", "c", None):
        own = sorted((hashlib.md5(f"5|s|{k}".encode()).hexdigest(), k) for x, k in rows if x == g)
        for name, take in (("few", 7), ("half", len(own) // 2), ("none", 0), ("all", len(own))):
            take = min(take, len(own))
            want = own[take - 1] if take else None
            assert (tuple(got[g][f"_cut_{name}"]) if got[g][f"_cut_{name}"] else None) == want, (g, name)


def test_value_buckets_follow_the_order_and_spread(spark):
    from echoloom.operators.running import value_bucket

    rng = np.random.default_rng(2)
    v = np.concatenate([rng.random(2000), -rng.random(500), rng.random(2000) * 1e6, 10.0 ** rng.uniform(-300, 300, 500), -(10.0 ** rng.uniform(-300, 300, 200)),
                        [0.0, -0.0, 1.0, 2.0, 4.0, np.nextafter(1, 0), np.nextafter(2, 0), np.nextafter(1024, 0), 5e-324, 1.7e308, np.inf, -np.inf]])
    df = spark.createDataFrame([(float(x),) for x in v], "v double").select("v", value_bucket(F.col("v")).alias("b"))
    rows = sorted((r.v, r.b) for r in df.collect())
    assert all(a[1] <= b[1] for a, b in zip(rows, rows[1:]))
    large = spark.range(100_000).select(value_bucket(F.col("id") * 10.0 + 256).alias("b"))
    assert large.distinct().count() > 10_000
    assert spark.sql("SELECT double('NaN') AS v").select(value_bucket(F.col("v")).alias("b")).first()["b"] > max(b for _, b in rows)


def test_rows_are_sorted_once(spark):
    from echoloom.operators.running import ordinal_by_bucket

    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(200).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 200).alias("o"))
        out = ordinal_by_bucket(df, ["k"], ["o"], F.floor(F.col("o") / 10))
        plan = out._jdf.queryExecution().executedPlan().toString()
        rows = out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert plan.count("Sort [") == 3                  # the rows; the buckets by key and for the join
    for k in range(3):
        assert [r.ordinal for r in sorted((r for r in rows if r.k == k), key=lambda r: r.o)] == list(range(sum(r.k == k for r in rows)))
