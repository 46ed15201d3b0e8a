"""Weighted draws from large pools by alias tables: one hash, one lookup, whatever the weights.

A pool of n items with whole-number weights of sum W becomes n slots of W units each. An item above the average (n * w > W)
gives its excess to slots of items below it. Light and heavy items are each put in slot order; a light item's slot is
filled up by the heavy item whose running excess first passes the running deficit before it, and a heavy item that has
given too much is filled up by the next heavy one. Both are found by prefix sums and by counting, in the merged order
of the two running sums, how many entries of the other kind lie below: no sequential pass over a pool.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoloom.functions.draws import uniform
from echoloom.operators.running import hash_ordinal, ordinal_by_bucket, running
from echoloom.session import checked_broadcast, materialize

#: entries in one step of a running sum
BUCKET = 4096


def _exact(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _merged_count(asking: DataFrame, counted: DataFrame, equal: bool) -> DataFrame:
    """``asking`` (pool, slot, v) with ``k``: entries of ``counted`` (pool, v) below v, or up to v if ``equal``."""
    points = asking.select("pool", "slot", "v", F.lit(1 if equal else 0).alias("kind"), F.lit(0).cast("long").alias("one")).unionByName(
        counted.select("pool", F.lit(None).cast("long").alias("slot"), "v", F.lit(0 if equal else 1).alias("kind"), F.lit(1).cast("long").alias("one")))
    points = materialize(points, "points")
    size = points.groupBy("pool").agg(F.max("v").alias("top"), F.ceil(F.count(F.lit(1)) / BUCKET).alias("parts"))     # one row per pool
    points = points.join(F.broadcast(size) if size.count() < 1000 else size, "pool")
    bucket = F.floor(F.col("v").cast("double") / F.greatest(F.col("top").cast("double"), F.lit(1.0)) * F.col("parts")).cast("long")
    return running(points, ["pool"], ["v", "kind"], bucket, {"k": ("sum", F.col("one"), True)}).filter("slot IS NOT NULL").select("pool", "slot", "k")


def alias_table(items: DataFrame, pool: str, item: str, weight: str, carry: list[str] | None = None, seed: int = 0) -> DataFrame:
    """(pool, slot, n, total, own, share, other): slot ``slot`` of a pool gives item ``own`` for its first ``share`` of ``total``
    units and item ``other`` beyond. ``own`` and ``other`` are structs of the item and the carried columns.

    Weights are positive whole numbers; items of weight NULL or below one are left out. Repeated items are items of their own.
    """
    carry = list(carry or [])
    rows = items.select(F.col(pool).alias("pool"), F.struct(F.col(item).alias("item"), *carry).alias("own"), _exact(F.col(weight)).alias("w")).filter("w >= 1")
    rows = materialize(rows, "pool-items")
    totals = rows.groupBy("pool").agg(F.count(F.lit(1)).alias("n"), F.sum("w").cast("decimal(38,0)").alias("total"))
    placed = hash_ordinal(rows.withColumn("item_key", F.col("own.item")), ["pool"], ["item_key"], seed, "alias", "slot").drop("item_key")
    placed = materialize(placed.join(checked_broadcast(totals), "pool").withColumn("e", _exact(_exact(F.col("n")) * F.col("w") - F.col("total"))), "placed")

    def summed(side: DataFrame, amount: Column) -> DataFrame:
        side = ordinal_by_bucket(side, ["pool"], ["slot"], F.floor(F.col("slot") / BUCKET), "at")
        return running(side.withColumn("a", amount), ["pool"], ["slot"], F.floor(F.col("slot") / BUCKET), {"upto": ("sum", F.col("a"), True)})

    light = materialize(summed(placed.filter("e < 0"), -F.col("e")), "light").select("pool", "slot", "at", "own", "n", "total", "e", _exact(F.col("upto")).alias("upto"))
    heavy = materialize(summed(placed.filter("e > 0"), F.col("e")), "heavy").select("pool", "slot", "at", "own", "n", "total", "e", _exact(F.col("upto")).alias("upto"))
    # a light slot: the first heavy item whose running excess passes the deficit before it
    giver = _merged_count(light.select("pool", "slot", _exact(F.col("upto") + F.col("e")).alias("v")), heavy.select("pool", F.col("upto").alias("v")), equal=True)
    named = heavy.select("pool", F.col("at").alias("k"), F.col("own").alias("other"))
    from_light = light.join(giver, ["pool", "slot"]).join(named, ["pool", "k"]).select(
        "pool", "slot", "n", "total", "own", _exact(F.col("total") + F.col("e")).alias("share"), "other")
    # a heavy slot: what it owes once the light item that it passes is full is given by the next heavy item
    passed = _merged_count(heavy.select("pool", "slot", F.col("upto").alias("v")), light.select("pool", F.col("upto").alias("v")), equal=False)
    filled = light.select("pool", F.col("at").alias("k"), F.col("upto").alias("full"))
    following = heavy.select("pool", (F.col("at") - 1).alias("at"), F.col("own").alias("other"))
    from_heavy = heavy.join(passed, ["pool", "slot"]).join(filled, ["pool", "k"], "left").join(following, ["pool", "at"], "left").select(
        "pool", "slot", "n", "total", "own", _exact(F.col("total") + F.col("upto") - F.coalesce("full", "upto")).alias("share"), F.coalesce("other", "own").alias("other"))
    even = placed.filter("e = 0").select("pool", "slot", "n", "total", "own", F.col("total").alias("share"), F.col("own").alias("other"))
    return materialize(from_light.unionByName(from_heavy).unionByName(even), "alias")


def alias_draw(samples: DataFrame, pool: str, key: list, table: DataFrame, seed: int, salt: str, out: str) -> DataFrame:
    """``samples`` with the struct ``out`` drawn from each row's pool: one uniform number for the slot, one for the side of it.

    The lookup is an equi-join on (pool, slot), which is unique in the table. Rows whose pool has no items are left out.
    """
    sizes = checked_broadcast(table.groupBy("pool").agg(F.first("n").alias("n")))
    spot = F.floor(uniform(seed, f"{salt}-slot", *key) * F.col("_n")).cast("long")
    asked = samples.join(sizes.select(F.col("pool").alias("_pool"), F.col("n").alias("_n")), F.col(pool) == F.col("_pool")).withColumn("_slot", spot)
    slots = checked_broadcast(table.select(F.col("pool").alias("_pool"), F.col("slot").alias("_slot"), "total", "share", "own", "other"))
    joined = asked.join(slots, ["_pool", "_slot"])
    side = uniform(seed, f"{salt}-side", *key) * F.col("total").cast("double") < F.col("share").cast("double")
    return joined.withColumn(out, F.when(side, F.col("own")).otherwise(F.col("other"))).drop("_pool", "_n", "_slot", "total", "share", "own", "other")
