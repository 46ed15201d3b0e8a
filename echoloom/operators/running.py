"""Running values, row numbers and quantiles that never put one whole key into one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task, and a global window
sends the whole table there. Each function here splits a key into buckets that follow the sort
order, aggregates per bucket first, accumulates over the buckets (a table that is smaller by the
bucket size) and finishes inside the buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echoloom.functions import draws
from echoloom.session import BROADCAST_BYTES, checked_broadcast, materialize, row_bytes

KEY = "_key"
LOWEST = -(1 << 62)


def _keyed(df: DataFrame, by: list[str]) -> DataFrame:
    """The key as one struct. A struct is never NULL and compares NULL fields as equal, so rows
    with a NULL key stay in the joins below; without a key it is a constant."""
    return df.withColumn(KEY, F.struct(*by) if by else F.struct(F.lit(0).alias("all")))


def join_null_safe(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that matches NULL keys, for small grouped tables."""
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in by})
    cond = F.lit(True)
    for k in by:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in by])


def running(df: DataFrame, by: list[str], order: list, bucket: Column,
            measures: dict[str, tuple]) -> DataFrame:
    """Running sum or max per key over an ordering.

    ``measures``: name -> (kind, expression, inclusive) with kind 'sum' or 'max'. ``bucket`` must
    not decrease along ``order``; it bounds the rows one task sorts.
    """
    src = _keyed(df, by).withColumn("_b", F.coalesce(bucket, F.lit(LOWEST)))
    agg = {"sum": F.sum, "max": F.max}
    part = src.groupBy("_b", KEY).agg(*[agg[k](e).alias(f"_p_{n}") for n, (k, e, _) in measures.items()])
    before = Window.partitionBy(KEY).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = part.select("_b", KEY, *[
        agg[k](f"_p_{n}").over(before).alias(f"_c_{n}") for n, (k, _, _) in measures.items()])
    # rows are dealt and sorted once: the join asks for no more than the order that the window left, and the number of the bucket
    # comes first in it, as it is compared faster than the key
    inside = Window.partitionBy("_b", KEY).orderBy(*order)
    here = {f"_h_{n}": agg[k](e).over(inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
            for n, (k, e, inclusive) in measures.items()}
    joined = src.withColumns(here).join(carried, ["_b", KEY])
    out = {}
    for name, (kind, _, _) in measures.items():
        own, carry = F.col(f"_h_{name}"), F.col(f"_c_{name}")
        if kind == "sum":
            out[name] = F.coalesce(carry, F.lit(0)) + F.coalesce(own, F.lit(0))
        else:
            out[name] = F.greatest(carry, own)         # greatest skips nulls
    return joined.withColumns(out).drop("_b", KEY, *here, *[f"_c_{n}" for n in measures])


def ordinal_by_bucket(df: DataFrame, by: list[str], order: list, bucket: Column,
                      name: str = "ordinal") -> DataFrame:
    """0-based position of each row within its key, for a bucket that follows the order."""
    return running(df, by, order, bucket, {name: ("sum", F.lit(1).cast("long"), False)})


def time_bucket(micros: str, seconds: int = 60) -> Column:
    """Bucket of a time column that counts microseconds."""
    return F.floor(F.col(micros) / F.lit(seconds * 1_000_000))


def hash_bucket(h: Column, digits: int = 4) -> Column:
    """16**digits equal slices of the digest range, in digest order."""
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("int")


def hash_ordinal(df: DataFrame, by: list[str], key: list[str], seed: int, salt: str,
                 name: str = "ordinal") -> DataFrame:
    """0-based position of each row in a keyed random permutation of its group."""
    h = df.withColumn("_h", draws.digest(seed, salt, *key))
    return ordinal_by_bucket(h, by, ["_h", *key], hash_bucket(F.col("_h")), name).drop("_h")


def listing_ordinal(df: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """0-based global position under an arbitrary sort order.

    The sorted rows are written once, because the positions within the sorted partitions must be
    the same ones that the partition sizes are counted from.
    """
    placed = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    stored = materialize(placed, "listing").withColumn("_part", F.shiftright("_id", 33))
    sizes = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(      # one row per sort partition
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return (stored.join(F.broadcast(base), "_part")
            .withColumn(name, F.col("_base") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("_part", "_id", "_base"))


#: digest digits that one level of a selection looks at, and distinct rows that are ranked at the end
LEVEL_DIGITS = 3
RANKED = 1 << 16


def hash_cutoffs(df: DataFrame, by: list[str], key: list[str], takes: dict, seed: int, salt: str) -> DataFrame:
    """Per group and name: digest and key of the last row among the ``take(n)`` lowest digests.

    ``takes`` maps a name to a function from the group size to a count. A take of 0 gives NULL. This is a selection
    by digits: rows are counted by the first digits of their digest, which finds the slice that holds each cut; only the rows of those
    slices are looked at again, by the next digits, until a slice is small enough to be ranked: the depth follows
    the rows of the largest slice. Without groups the first level has 65 536 slices and is the only one, so that nothing runs
    ahead of the plan; at 10^12 rows that leaves one sort of 15 million. Rows with the same key are one row with a count, so copies
    cannot fill a slice.
    """
    first = LEVEL_DIGITS if by else LEVEL_DIGITS + 1
    rows = _keyed(df.select(*by, *key), by)
    rows = rows.withColumn("_h", draws.digest(seed, salt, *key)).withColumn("_b", hash_bucket(F.col("_h"), first))
    counts = rows.groupBy(KEY, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(KEY)
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), F.least(F.col("_all_n"), f(F.col("_all_n"))).cast("long").alias("k"))
                       for n, f in takes.items()])
    upto = F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    cut = (counts.withColumn("_cum", upto).withColumn("_all_n", F.sum("_n").over(w)).withColumn("_w", F.explode(wanted))
           .select(KEY, "_b", "_n", "_cum", F.col("_w.name").alias("_name"), F.col("_w.k").alias("_k")))
    side, largest = _slices(cut, eager=bool(by))
    copies = rows.join(side, [KEY, "_b"]).groupBy(KEY, "_name", "_rest", "_h", *key).agg(F.count(F.lit(1)).alias("_n"))
    digits = LEVEL_DIGITS
    while by and largest > RANKED and digits < 32:
        copies = materialize(copies, "slices").withColumn("_b", hash_bucket(F.substring("_h", digits + 1, LEVEL_DIGITS), LEVEL_DIGITS))
        counts = copies.groupBy(KEY, "_name", "_rest", "_b").agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_distinct"))
        upto = F.sum("_n").over(Window.partitionBy(KEY, "_name").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
        side, largest = _slices(counts.withColumn("_cum", upto).withColumn("_k", F.col("_rest")).drop("_rest"), "_distinct")
        copies = copies.drop("_rest").join(side, [KEY, "_name", "_b"]).select(KEY, "_name", "_rest", "_h", *key, "_n")
        digits += LEVEL_DIGITS
    within = Window.partitionBy(KEY, "_name").orderBy("_h", *key)
    reached = F.sum("_n").over(within.rowsBetween(Window.unboundedPreceding, 0))
    hit = copies.withColumn("_cum", reached).filter((F.col("_cum") - F.col("_n") < F.col("_rest")) & (F.col("_cum") >= F.col("_rest")))
    last = F.struct("_h", *key)
    return hit.groupBy(KEY).agg(*[F.max(F.when(F.col("_name") == n, last)).alias(f"_cut_{n}") for n in takes])


def _slices(counted: DataFrame, size: str = "_n", eager: bool = True) -> tuple[DataFrame, int]:
    """(slices that hold a cut with ``_rest`` rows left to take inside, rows of the largest): a broadcast if it was measured to be small.

    ``eager`` False: there is one group, so one slice per name.
    """
    inside = (F.col("_cum") - F.col("_n") < F.col("_k")) & (F.col("_cum") >= F.col("_k"))
    cut = counted.filter(inside).withColumn("_rest", F.col("_k") - (F.col("_cum") - F.col("_n"))).withColumn("_size", F.col(size)).drop("_n", "_cum", "_k", "_distinct")
    if not eager:
        return F.broadcast(cut.drop("_size")), 0
    stored = materialize(cut, "cuts")
    seen = stored.agg(F.coalesce(F.sum(row_bytes(stored)), F.lit(0)).alias("bytes"), F.coalesce(F.max("_size"), F.lit(0)).alias("most")).first()
    slices = stored.drop("_size")
    return (F.broadcast(slices) if seen["bytes"] <= BROADCAST_BYTES else slices), seen["most"]


def flag_lowest(df: DataFrame, by: list[str], key: list[str], takes: dict, seed: int, salt: str) -> DataFrame:
    """One boolean column per name: the row is among the first ``take(n)`` of its group in a keyed
    permutation. The wide rows are not shuffled when the table of cuts is small."""
    cut = hash_cutoffs(df, by, key, takes, seed, salt)
    side = F.broadcast(cut) if not by else checked_broadcast(cut)     # one row without a key
    out = _keyed(df, by).join(side, KEY, "left")
    mine = F.struct(draws.digest(seed, salt, *key).alias("_h"), *[F.col(k) for k in key])
    for n in takes:
        out = out.withColumn(n, F.coalesce(mine <= F.col(f"_cut_{n}"), F.lit(False))).drop(f"_cut_{n}")
    return out.drop(KEY)


def take_random(df: DataFrame, n: int, key: list[str], seed: int, salt: str) -> DataFrame:
    """min(n, size) rows without replacement: the ``n`` lowest digests."""
    flagged = flag_lowest(df, [], key, {"_t": lambda _: F.lit(n)}, seed, salt)
    return flagged.filter("_t").drop("_t")


# ---- distinct-value ladders -------------------------------------------------------------------

def value_bucket(v: Column, parts: int = 4096) -> Column:
    """A bucket that never decreases with the value: the exponent of a number and its place between two powers of two.

    So numbers of any size spread, ``parts`` buckets for each doubling; infinite values and NaN have buckets of their own at the ends.
    """
    size = F.abs(v.cast("double"))
    power = F.floor(F.log2(size))
    place = (power + 1100) * parts + F.floor((size / F.pow(F.lit(2.0), power) - 1.0) * parts)
    ends = F.lit(1 << 40)
    code = F.when(size == 0.0, F.lit(0)).when(size == float("inf"), ends).otherwise(place)
    return F.when(F.isnan(v.cast("double")), ends + 1).when(v < 0, -code).otherwise(code).cast("long")


def ladder(df: DataFrame, by: list[str], value: str, counts: dict[str, Column],
           descending: bool = True) -> DataFrame:
    """One row per (key, distinct value) with counts, inclusive running counts and totals.

    Columns: for each count ``c``: ``c`` at the value, ``c_cum`` from the start of the order up to
    and including the value, ``c_total``. Equal values collapse before anything is sorted, so a
    value shared by a third of the rows is one row here.
    """
    pts = (_keyed(df, by).groupBy(KEY, value).agg(*[F.sum(e).cast("long").alias(c) for c, e in counts.items()])
           .withColumn("_b", F.coalesce(value_bucket(F.col(value)), F.lit(LOWEST))))
    part = pts.groupBy(KEY, "_b").agg(*[F.sum(c).alias(f"_p_{c}") for c in counts])
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    whole = Window.partitionBy(KEY)
    before = whole.orderBy(direction("_b")).rowsBetween(Window.unboundedPreceding, -1)
    carried = part.select(KEY, "_b", *[
        x for c in counts for x in (
            F.coalesce(F.sum(f"_p_{c}").over(before), F.lit(0)).alias(f"_c_{c}"),
            F.sum(f"_p_{c}").over(whole).alias(f"{c}_total"))])
    inside = (Window.partitionBy(KEY, "_b").orderBy(direction(value))
              .rowsBetween(Window.unboundedPreceding, 0))
    out = pts.join(carried, [KEY, "_b"])
    return out.select(
        *[F.col(KEY)[k].alias(k) for k in by], value, *counts,
        *[(F.col(f"_c_{c}") + F.sum(c).over(inside)).alias(f"{c}_cum") for c in counts],
        *[f"{c}_total" for c in counts])


def exact_quantiles(df: DataFrame, by: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per key, one column per name.

    Works on distinct values and their counts, so no task holds all values of a key.
    """
    steps = ladder(df.filter(F.col(value).isNotNull()), by, value, {"n": F.lit(1)},
                   descending=False)
    first = F.col("n_cum") - F.col("n")
    aggs = []
    for name, q in qs.items():
        pos = F.lit(q) * (F.col("n_total") - 1)
        for side, k in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            aggs.append(F.max(F.when((first <= k) & (k < F.col("n_cum")), F.col(value))).alias(f"_{name}_{side}"))
    grouped = (steps.groupBy(*by) if by else steps.groupBy()).agg(F.max("n_total").alias("_n"), *aggs)
    cols = []
    for name, q in qs.items():
        pos = F.lit(q) * (F.col("_n") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return grouped.select(*by, *cols)
