"""Sliding windows, babble sums, filterbanks and feature statistics over array-valued clips."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoloom.functions import arrays as A
from echoloom.functions.draws import in_range, uniform
from echoloom.operators.running import hash_ordinal
from echoloom.session import checked_broadcast, inline_table


def hop_windows(clips: DataFrame, x: str, win: int, hop: int, inclusive: bool = True, every: int = 1,
                cap: int | None = None, pad_tail: bool = False) -> DataFrame:
    """One row per window: step, start, w.

    ``inclusive`` counts (n - win) // hop + 1 windows, else one less. ``cap`` keeps the first
    windows of each clip and ``pad_tail`` zero-fills a last partial one (both as the scans do).
    """
    n = F.size(x)
    count = F.floor((n - win) / hop) + (1 if inclusive else 0)
    if pad_tail:
        count = F.ceil((n - win) / hop) + 1
    if cap is not None:
        count = F.least(count, F.lit(cap))
    count = F.when(n >= win, count).otherwise(F.lit(1 if pad_tail else 0))
    steps = F.when(count > 0, F.sequence(F.lit(0).cast("bigint"), (count - 1).cast("bigint"), F.lit(every).cast("bigint")))
    out = clips.withColumn("step", F.explode(steps)).withColumn("start", F.col("step") * hop)
    cut = A.window(F.col(x), F.col("start"), win)
    if pad_tail:
        cut = F.concat(cut, A.zeros(F.lit(win) - F.size(cut)))
    return out.withColumn("w", cut).drop(x)


def babble(seeds: DataFrame, key: str, talkers: str, pool: DataFrame, clip: str, x: str, seed: int) -> DataFrame:
    """Sum of drawn talkers with gains from U(-13, 3) dB, divided by the peak.

    A mixture has at most 14 talkers, so their scaled signals are collected per mixture and folded;
    that moves whole arrays instead of one row per sample, and fixes the order of the sum. A talker
    shorter than the longest one is repeated up to its length.
    """
    n = pool.agg(F.count(F.lit(1))).scalar()
    bank = hash_ordinal(pool.select(clip), [], [clip], seed, "talkers", "_i").join(pool.select(clip, x), clip)
    parts = seeds.select(key, F.explode(F.sequence(F.lit(0), F.col(talkers).cast("int") - 1)).alias("talker"))
    parts = parts.withColumn("_i", F.floor(uniform(seed, "talker", key, "talker") * n).cast("bigint")).withColumn(
        "_g", F.pow(F.lit(10.0), in_range(uniform(seed, "talker-gain", key, "talker"), -13.0, 3.0) / 20.0))
    scaled = parts.join(bank, "_i").select(key, F.struct("talker", A.gain(F.col(x), F.col("_g")).alias("s")).alias("_t"))
    mixed = scaled.groupBy(key).agg(F.sort_array(F.collect_list("_t")).alias("_ts"))
    longest = F.array_max(F.transform("_ts", lambda t: F.size(t["s"])))
    mixed = mixed.withColumn("_ts", A.let(longest, lambda m: F.transform("_ts", lambda t: F.when(F.size(t["s"]) == m, t["s"]).otherwise(
        F.slice(F.flatten(F.array_repeat(t["s"], F.ceil(m / F.greatest(F.size(t["s"]), F.lit(1))).cast("int"))), F.lit(1), m)))))
    y = F.aggregate(F.slice("_ts", F.lit(2), F.size("_ts")), F.get("_ts", F.lit(0)), lambda acc, t: F.zip_with(
        acc, t, lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))))
    return mixed.select(key, A.let(y, lambda s: A.let(A.peak(s), lambda m: F.when(
        m > 0, F.transform(s, lambda v: v / m)).otherwise(s))).alias("mix"))


# Talkers per mixture and name of the recorded-crowd configurations.
BABBLE_CONFIGS = [(2, "two_talker"), (3, "small_group"), (4, "small_group"), (5, "crowd"), (6, "crowd"),
                  (8, "crowd"), (10, "dense_crowd"), (12, "dense_crowd"), (14, "dense_crowd")]


def mel_triangles(rate: int = 16000, n_fft: int = 512, bands: int = 40, lo: float = 100.0, hi: float = 7500.0):
    """(bin, band, weight) of triangular mel filters with floored bin edges."""
    mel = lambda hz: 2595.0 * math.log10(1.0 + hz / 700.0)           # noqa: E731
    hz = lambda m: 700.0 * (10.0 ** (m / 2595.0) - 1.0)              # noqa: E731
    a, b = mel(lo), mel(hi)
    edge = [math.floor((n_fft + 1) * hz(a + (b - a) * i / (bands + 1)) / rate) for i in range(bands + 2)]
    rows = []
    for band in range(bands):
        left, mid, right = edge[band], edge[band + 1], edge[band + 2]
        rising = [(k, (k - left) / (mid - left)) for k in range(left, mid)]
        falling = [(k, 1.0 - (k - mid) / (right - mid)) for k in range(mid, right)]
        rows += [(k, band, w) for k, w in rising + falling if w != 0.0]
    return rows


def mel_table(spark: SparkSession, **kw) -> DataFrame:
    return inline_table(spark, "bin, band, weight", mel_triangles(**kw))


def mel_energy(power: DataFrame, key: list[str], table: DataFrame) -> DataFrame:
    """Band energies as a join with the filter table (a few hundred fixed rows) and a sum."""
    return power.join(F.broadcast(table), "bin").groupBy(*key, "band").agg(
        F.sum(F.col("e") * F.col("weight")).alias("energy"))


def feature_statistics(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """Rows, mean rms, and min, max and standard deviation over all elements.

    Nothing is exploded: each row gives its count, mean and squared deviation from its own mean. The
    deviation of all is the sum of those inside rows and of the row means around the mean of all,
    so no two large numbers are subtracted.
    """
    c = F.col(x)
    rows = df.select(*by, A.rms(c).alias("_rms"), F.array_min(c).alias("_lo"), F.array_max(c).alias("_hi"), F.size(c).alias("_k"),
                     A.let(A.total(c) / F.size(c), lambda m: F.struct(m.alias("m"), A.total(c, lambda v: (v - m) * (v - m)).alias("d"))).alias("_s"))
    centre = rows.groupBy(*by).agg((F.sum(F.col("_k") * F.col("_s.m")) / F.sum("_k")).alias("_c"), F.count(F.lit(1)).alias("n"), F.avg("_rms").alias("mean_rms"),
                                   F.min("_lo").alias("lo"), F.max("_hi").alias("hi"))
    off = F.col("_s.m") - F.col("_c")
    spread = rows.join(checked_broadcast(centre.select(*by, "_c")), by).groupBy(*by).agg(
        F.sqrt((F.sum("_s.d") + F.sum(F.col("_k") * off * off)) / F.sum("_k")).alias("std"))
    return centre.drop("_c").join(spread, by)
