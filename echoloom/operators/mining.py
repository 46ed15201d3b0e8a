"""Hard-example mining jobs, composed from windows, gates, scores and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoloom.operators.ranking import top_n
from echoloom.operators.running import exact_quantiles, hash_ordinal, join_null_safe, take_random
from echoloom.operators.sampling import head_val, union_with_provenance
from echoloom.session import materialize


def hard_negatives(windows: DataFrame, parts: dict[str, tuple[Column, Column, float]]) -> DataFrame:
    """Windows of each part (its rows, its energy gate, its threshold) that pass the gate and score at or above the threshold, tagged by
    ``source``. One pass over the windows, however many parts there are; a window of two parts is a row of each."""
    tags = [F.when(rows & loud & (F.col("p") >= F.lit(threshold)), F.lit(tag)) for tag, (rows, loud, threshold) in parts.items()]
    return windows.withColumn("source", F.explode(F.array_compact(F.array(*tags))))


def false_alarm_rows(windows: DataFrame, loud: Column, threshold: float, key: list[str], keep: int | None) -> DataFrame:
    """False alarms of a scan; the ``keep`` highest scores, or all of them."""
    found = windows.filter(loud).filter(F.col("p") >= F.lit(threshold))
    return found if keep is None else top_n(found, "p", key, keep)


def missed_positives(df: DataFrame, threshold: float, key: list[str], keep: int) -> DataFrame:
    return top_n(df.filter((F.col("y") == 1) & (F.col("p") < F.lit(threshold))), "p", key, keep, worst=True)


def bucket_histogram(df: DataFrame) -> DataFrame:
    return df.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def miss_profile(df: DataFrame, threshold: float, by: list[str]) -> DataFrame:
    """Share below the threshold and median score per group."""
    miss = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("p") < F.lit(threshold)).cast("int")).alias("miss"))
    return join_null_safe(miss, exact_quantiles(df, by, "p", {"median": 0.5}), by)


def fine_tune_set(corpus: DataFrame, mined_neg: DataFrame, mined_pos: DataFrame, key: list[str], n_pos: int,
                  n_neg: int, n_hard: int, n_hard_pos: int, seed: int) -> DataFrame:
    """Anchors of both classes plus mined rows, capped, tagged, permuted and split.

    Every anchor keeps its own bucket: row and tag come from one draw.
    """
    parts = [
        (take_random(corpus.filter("y = 1"), n_pos, key, seed, "anchor-pos"), None),
        (take_random(corpus.filter("y = 0"), n_neg, key, seed, "anchor-neg"), None),
        (take_random(mined_neg.drop("bucket"), n_hard, key, seed, "hard-neg").withColumn("y", F.lit(0)), "MINE_negative"),
        (take_random(mined_pos, n_hard_pos, key, seed, "hard-pos").withColumn("y", F.lit(1)), "MINE_deployed_miss"),
    ]
    tagged = []
    for i, (df, tag) in enumerate(parts):
        tagged.append((df.withColumn("part", F.lit(i)), tag))
    # written once: the split reads the set several times
    out = materialize(union_with_provenance(tagged), "fine-tune")
    return head_val(out, ["part", *key], 600, 20, seed)


def permuted(df: DataFrame, key: list[str], seed: int) -> DataFrame:
    return hash_ordinal(df, [], key, seed, "permute", "pos")
