import math

import numpy as np
import pytest

from echoloom.operators import metrics as M
from echoloom.operators import ranking as K


def frame(spark, pos, neg):
    rows = [(1, float(p)) for p in pos] + [(0, float(p)) for p in neg]
    return spark.createDataFrame(rows, "y int, p double")


def test_threshold_of_unique_scores_stays_within_budget(spark):
    rng = np.random.default_rng(1)
    neg = rng.random(1000)
    for r in M.at_budgets(frame(spark, rng.random(50), neg), [0.001, 0.01, 0.05]).collect():
        assert r.threshold == np.sort(neg)[::-1][r.allowed - 1]
        assert r.fpr <= r.budget


def test_no_negatives(spark):
    r = M.at_budgets(frame(spark, [0.4, 0.6], []), [0.01]).first()
    assert (r.threshold, r.tpr, r.fpr) == (0.5, 0.5, 0.0)


def test_no_positives(spark):
    r = M.at_budgets(frame(spark, [], [0.1, 0.2]), [0.5]).first()
    assert (r.threshold, r.tpr, r.fpr) == (0.2, 0.0, 0.5)
    assert M.auc(frame(spark, [], [0.1])).first().auc is None


@pytest.mark.parametrize("top", [0.9, 0.5, 0.3333, 1e-9])
def test_budget_below_one_negative(spark, top):
    df = frame(spark, [0.95, top], [top, 0.1 * top])
    r = M.at_budgets(df, [0.0005]).first()
    assert r.threshold == math.nextafter(top, 1.0) and r.fp == 0 and r.tp == 1
    assert M.at_budgets(df, [0.0005], zero_allowed="one").first().threshold == 1.0


def test_all_scores_equal(spark):
    df = frame(spark, [0.7] * 5, [0.7] * 10)
    assert M.auc(df).first().auc == 0.5
    r = M.at_budgets(df, [0.2]).first()
    assert (r.threshold, r.fpr) == (0.7, 1.0)


def test_auc_matches_pairwise_count(spark):
    rng = np.random.default_rng(2)
    pos, neg = np.round(rng.random(80), 1), np.round(rng.random(120), 1)
    wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
    assert M.auc(frame(spark, pos, neg)).first().auc == pytest.approx(wins / (80 * 120))


def test_buckets_with_a_common_prefix_are_not_pooled(spark):
    df = spark.createDataFrame([("N1", "M1", 0, 0.9), ("N10", "M2", 0, 0.1)], "content string, recipe string, y int, p double")
    got = {(r.content, r.recipe): r.fp for r in M.pooled(df, 0.5).collect()}
    assert got[("N1", None)] == 1 and got[("N10", None)] == 0 and got[(None, None)] == 1


def test_f1_is_a_proportion(spark):
    t = M.with_f1(M.threshold_table(frame(spark, [0.9, 0.2], [0.8, 0.1]), [0.5]))
    r = t.first()
    assert (r.precision, r.f1) == (0.5, 0.5)


def test_non_dominated(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(1, 30)), int(rng.integers(1, 30))) for i in range(200)]
    df = spark.createDataFrame(rows, "cfg int, params int, mac int")
    got = {r.cfg for r in K.non_dominated(df, "params", "mac").collect()}
    want = {c for c, p, m in rows if not any(p2 >= p and m2 <= m and (p2 > p or m2 < m) for _, p2, m2 in rows)}
    assert got == want


def test_hardest_negatives_keep_k(spark):
    rows = [(0, 0, i, float(i)) for i in range(10)] + [(0, 1, 100, 0.0)]
    df = spark.createDataFrame(rows, "batch int, y int, id int, loss double")
    kept = {r.id for r in K.hardest_negatives(df, "batch", "loss", ["id"], 3).collect()}
    assert kept == {7, 8, 9, 100}


def test_saved_epochs_with_margin(spark):
    h = spark.createDataFrame([(0, .9), (3, .5), (4, .5000005), (5, .6), (6, .55)], "epoch int, tpr double")
    assert [r.epoch for r in K.saved_epochs(h, "epoch", "tpr", 1e-6, 3).orderBy("epoch").collect()] == [3, 5]
