"""Hard negatives: Hilbert order, zone-map bounds, and the search against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoloom.llm import hard_negatives
from echoloom.llm.hilbert import positions

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("dims, bits", [(1, 3), (2, 1), (2, 4), (3, 3), (4, 2), (5, 2)])
def test_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    at = positions(cells, bits)
    order = sorted(range(len(cells)), key=lambda i: at[i])
    assert len(set(at)) == len(cells) and set(np.abs(np.diff(cells[order], axis=0)).sum(1)) == {1}


def expected(rows, anchor, positives=5, negatives=10, low=30, high=90):
    good = [(k, [int(np.floor(256 * float(np.float32(c)))) for c in v], g) for k, v, g in rows
            if g is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    d = max((len(v) for _, v, _ in good), default=0)
    good = [(k, v + [0] * (d - len(v)), g) for k, v, g in good]
    last = lambda k: (k is None, k or 0)
    out = []
    for i, (k, v, g) in enumerate(good):
        if k is None or not anchor(k):
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), last(j), j, h) for n, (j, w, h) in enumerate(good) if n != i), key=lambda r: r[:2])
        for s, _, p, _ in [r for r in scored if r[3] == g][:positives]:
            inside = [r for r in scored if r[3] != g and low * -s <= 100 * -r[0] <= high * -s][:negatives]
            out += [(k, p, rank, r[2], -s, -r[0]) for rank, r in enumerate(inside, 1)]
    return sorted(out, key=str)


def mined(df, every=10, **how):
    out = hard_negatives.mine(df, F.col("vec_id") % every == 0, **how)
    return sorted((tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


def sample(n=400, dims=6, seed=1):
    rnd = np.random.default_rng(seed)
    centres = rnd.standard_normal((5, dims))
    rows = [(i, (centres[i % 5] + 0.6 * rnd.standard_normal(dims)).tolist(), int(i % 3)) for i in range(n)]
    copy = rows[0][1]
    rows += [(1000 + i, copy, i % 2) for i in range(120)]                       # a very common vector under two labels
    rows += [(10, rows[10][1], 1), (10, rows[10][1], 1), (20, rows[7][1], 2), (None, copy, 0), (None, rows[3][1], 1)]
    rows += [(3000, None, 1), (3010, [float("nan")] * dims, 1), (3020, copy, None), (3030, [None] * dims, 0), (3040, [1.0], 0), (3050, [], 9), (3060, copy, 7)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 16, "RANGE_BLOCKS": 4, "SHARD": 2, "CHUNK": 8, "ZONES": 3, "SLICE": 5}])
def test_search_equals_brute_force(spark, monkeypatch, sizes):
    for name, size in sizes.items():
        monkeypatch.setattr(hard_negatives, name, size)
    rows = sample()
    random.Random(2).shuffle(rows)
    assert mined(spark.createDataFrame(rows, SCHEMA)) == expected(rows, lambda k: k % 10 == 0)


def test_other_sizes_and_windows(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 32)
    rows = sample(150, 3, seed=5)
    got = mined(spark.createDataFrame(rows, SCHEMA), every=50, positives=2, negatives=3, low=50, high=100)
    assert got == expected(rows, lambda k: k % 50 == 0, 2, 3, 50, 100)


def test_zone_maps_spare_blocks_where_vectors_cluster(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 32)
    rnd = np.random.default_rng(3)
    centres = 4 * np.eye(16)
    rows = [(i, (centres[i % 16] + 0.1 * rnd.standard_normal(16)).tolist(), (i % 16) // 2) for i in range(3200)]
    df = spark.createDataFrame(rows, SCHEMA)
    blocks, dims = hard_negatives.build_blocks(hard_negatives.vectors(df, "vec_id", "label", "embedding", F.col("vec_id") % 320 == 0))
    anchors = hard_negatives.anchors_of(blocks, dims, 5).withColumn("chunk", F.lit(0).cast("long"))
    zones = blocks.select("part", "seq", "label_lo", "label_hi", "low", "high")
    wanted = hard_negatives.needed(anchors, zones, 1, 5, True, dims).agg(F.sum("wanted")).first()[0]
    total = blocks.count() * blocks.agg(F.sum("anchors")).first()[0]
    assert 0 < wanted < 0.2 * total                    # most pairs of anchor and block are ruled out by the zone maps


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2 ** 20 + 97 * i), float(-(2 ** 19) + i), float(3 ** i % 1000)], i % 2) for i in range(40)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == expected(rows, lambda k: k % 10 == 0)
    a, b = np.array([[2 ** 40, -5]]), np.array([[2 ** 40, 7], [-(2 ** 40), 1], [3, 2 ** 50]])
    assert hard_negatives.inner_products(a, b).tolist() == [[2 ** 63 - 1, -(2 ** 63 - 1), 3 * 2 ** 40 - 5 * 2 ** 50]]
    a, b = np.array([[2 ** 28, 1]]), np.array([[2 ** 28, 1], [2 ** 28, 0]])
    assert hard_negatives.inner_products(a, b).tolist() == [[2 ** 56 + 1, 2 ** 56]]


def test_odd_tables(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(1, [1.0], 0), (2, [1.0], 1)], SCHEMA)) == []                 # no anchor
    assert mined(spark.createDataFrame([(0, None, 0), (10, [1.0], None)], SCHEMA)) == []
    assert mined(spark.createDataFrame([(0, [], 0), (10, [], 0), (1, [], 1)], SCHEMA)) == [(0, 10, 1, 1, 0, 0), (10, 0, 1, 1, 0, 0)]
    clash = spark.createDataFrame([(0, [1.0], 0, 5, "x"), (1, [1.0], 0, 5, "x"), (2, [0.5], 1, 5, "x")], SCHEMA + ", part int, id string")
    assert mined(clash) == [(0, 1, 1, 2, 65536, 32768)]
