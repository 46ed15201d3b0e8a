"""Alias tables give every item exactly its weight; draws follow them."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from echoloom.operators import alias

SCHEMA = "pool string, item long, weight long"


def pools(seed):
    rnd = random.Random(seed)
    rows = [("one", 1, 7)] + [("even", i, 5) for i in range(9)] + [("giant", 0, 10_000)] + [("giant", i, 1) for i in range(1, 40)]
    rows += [("mixed", i, rnd.choice([1, 2, 3, 50, 400])) for i in range(120)] + [("spread", i, rnd.randint(1, 10 ** 9)) for i in range(60)]
    return rows + [("zero", 1, 0), ("zero", 2, None), ("pair", 1, 1), ("pair", 2, 3)]


@pytest.mark.parametrize("bucket", [4096, 7])
def test_slots_add_up_to_the_weights(spark, monkeypatch, bucket):
    monkeypatch.setattr(alias, "BUCKET", bucket)
    rows = pools(3)
    table = alias.alias_table(spark.createDataFrame(rows, SCHEMA), "pool", "item", "weight").collect()
    units, slots, size = defaultdict(Counter), defaultdict(set), Counter(p for p, _, w in rows if w)
    for r in table:
        assert 0 <= r["share"] <= r["total"] and r["n"] == size[r["pool"]]
        slots[r["pool"]].add(r["slot"])
        units[r["pool"]][r["own"]["item"]] += int(r["share"])
        units[r["pool"]][r["other"]["item"]] += int(r["total"] - r["share"])
    for p, n in size.items():
        assert slots[p] == set(range(n))
        assert {i: u for i, u in units[p].items() if u} == {i: n * w for q, i, w in rows if q == p and w}
    assert set(slots) == set(size)


def test_draws_follow_the_weights_and_repeat(spark):
    table = alias.alias_table(spark.createDataFrame(pools(5), SCHEMA), "pool", "item", "weight")
    samples = spark.range(8000).withColumn("pool", F.when(F.col("id") % 4 == 0, "pair").when(F.col("id") % 4 == 1, "giant").when(F.col("id") % 4 == 2, "none").otherwise("even"))
    out = alias.alias_draw(samples, "pool", ["id"], table, 3, "t", "drawn")
    got = {r["id"]: (r["pool"], r["drawn"]["item"]) for r in out.collect()}
    assert len(got) == 6000 and got == {r["id"]: (r["pool"], r["drawn"]["item"]) for r in alias.alias_draw(samples.repartition(7), "pool", ["id"], table, 3, "t", "drawn").collect()}
    n = Counter(got.values())
    assert abs(n["pair", 2] - 1500) < 100 and n["giant", 0] > 1980 and all(abs(n["even", i] - 2000 / 9) < 60 for i in range(9))


def test_empty_pool_table(spark):
    assert alias.alias_table(spark.createDataFrame([], SCHEMA), "pool", "item", "weight").collect() == []
