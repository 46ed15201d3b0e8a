"""Top-k, best-under-a-budget, run comparison and batch selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echoloom.operators.running import hash_ordinal, ladder, running, value_bucket


#: list lengths up to which every task may simply send its own best rows to one merge
SHORT_LIST = 1000


def top_n(df: DataFrame, score: str, key: list[str], n: int, worst: bool = False) -> DataFrame:
    """Highest (or lowest) ``n`` scores; equal scores in key order. The limit is the operator.

    A sort with a limit sends up to ``n`` rows per input partition to one merge. For longer lists
    the score of the n-th row is found first, from counts per distinct score, and only rows that
    reach it are sorted.
    """
    if n > SHORT_LIST:
        steps = ladder(df, [], score, {"_n": F.lit(1)}, descending=not worst).filter(F.col("_n_cum") >= n)
        cut = steps.agg((F.min(score) if worst else F.max(score))).scalar()     # NULL: fewer than n rows
        reaches = F.col(score) <= cut if worst else F.col(score) >= cut
        df = df.filter(F.coalesce(reaches, F.lit(True)))
    first = F.col(score).asc() if worst else F.col(score).desc()
    return df.orderBy(first, *key).limit(n)


def best_within(df: DataFrame, score: str, allowed: Column, order: list) -> DataFrame:
    """The row with the best score among those allowed, first in ``order`` on ties; or no row."""
    return df.filter(allowed).orderBy(F.col(score).desc(), *order).limit(1)


def inventory(df: DataFrame, bucket: str, level: str) -> DataFrame:
    g = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"), F.min(level).alias("min_level"), F.max(level).alias("max_level"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return g.withColumn("share_pct", F.lit(100.0) * F.col("n") / total)


def kind_counts(df: DataFrame, tag: str, prefix: str = "neg|") -> DataFrame:
    """Rows per kind for tags of the form ``neg|kind|...``."""
    return (df.filter(F.col(tag).startswith(prefix))
            .groupBy(F.element_at(F.split(tag, r"\|"), 2).alias("kind")).agg(F.count(F.lit(1)).alias("n")))


def consistency(recorded: DataFrame, recomputed: DataFrame, on: list[str], a: str, b: str, tol: float) -> DataFrame:
    return recorded.join(recomputed, on).withColumn("consistent", F.abs(F.col(a) - F.col(b)) < F.lit(tol))


def compare_runs(runs: DataFrame, run: str, metrics: list[str], best_by: str) -> DataFrame:
    """Deltas to the previous run and to the best one. One row per run, so one task is enough."""
    prev = Window.partitionBy(F.lit(0)).orderBy(run)
    whole = Window.partitionBy(F.lit(0))
    out = runs
    for m in metrics:
        out = out.withColumn(f"{m}_delta", F.col(m) - F.lag(m).over(prev))
    return (out.withColumn(f"{best_by}_vs_best", F.col(best_by) - F.max(best_by).over(whole))
            .withColumn("best_run", F.max_by(run, best_by).over(whole)))


def _fold_epochs(history: DataFrame, fields: list[str], zero: Column, step) -> DataFrame:
    """Fold over the epochs of one run (one row per epoch, so the array is short)."""
    arr = history.agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("h"))
    return arr.select(F.explode(F.aggregate("h", zero, step, lambda a: a["out"])).alias("s")).select("s.*")


def saved_epochs(history: DataFrame, epoch: str, score: str, margin: float, warmup: int) -> DataFrame:
    """Epochs at which the running best improves by more than ``margin``, after ``warmup``."""
    zero = F.struct(F.lit(-1.0).alias("best"), F.array().cast("array<struct<epoch:bigint,best:double>>").alias("out"))
    def step(a, e):
        ok = (e[score] > a["best"] + F.lit(margin)) & (e[epoch] >= warmup)
        return F.when(ok, F.struct(e[score].alias("best"), F.concat(a["out"], F.array(F.struct(
            e[epoch].cast("bigint").alias("epoch"), e[score].alias("best")))).alias("out"))).otherwise(a)
    return _fold_epochs(history, [epoch, score], zero, step)


def saved_epochs_rule(history: DataFrame, epoch: str, score: str, fpr: str, tpr: str, slack: float,
                      start: int, floor_after: int, floor: float) -> DataFrame:
    """Better score, or nearly as good with a lower FPR; from ``start`` on, with a TPR floor later."""
    zero = F.struct(F.lit(0.0).alias("score"), F.lit(1.0).alias("fpr"),
                    F.array().cast("array<struct<epoch:bigint,score:double,fpr:double>>").alias("out"))
    def step(a, e):
        better = (e[score] > a["score"]) | ((e[score] >= a["score"] - F.lit(slack)) & (e[fpr] < a["fpr"]))
        ok = ((e[epoch] < floor_after) | (e[tpr] >= floor)) & better & (e[epoch] >= start)
        row = F.struct(e[epoch].cast("bigint").alias("epoch"), e[score].alias("score"), e[fpr].alias("fpr"))
        return F.when(ok, F.struct(e[score].alias("score"), e[fpr].alias("fpr"),
                                   F.concat(a["out"], F.array(row)).alias("out"))).otherwise(a)
    return _fold_epochs(history, [epoch, score, fpr, tpr], zero, step)


def config_rankings(cfgs: DataFrame, capacity: int = 18, proxy: int = 16, widest: int = 8) -> DataFrame:
    """Three short lists of configurations: by capacity, by quality proxy, by width."""
    score = F.round(F.sqrt("params") / F.pow("mac", F.lit(0.25)), 9)
    lists = [("capacity", capacity, [F.col("params").desc(), F.col("mac"), F.col("cfg")]),
             ("proxy", proxy, [score.desc(), F.col("cfg")]),
             ("widest", widest, [F.col("params").desc(), F.col("cfg")])]
    out = None
    for name, n, order in lists:
        top = cfgs.orderBy(*order).limit(n)                        # n rows before the window
        ranked = top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
        part = ranked.select(F.lit(name).alias("list"), "cfg", "params", "mac", "rank")
        out = part if out is None else out.unionByName(part)
    return out


def non_dominated(df: DataFrame, better_high: str, better_low: str) -> DataFrame:
    """Rows that no other row beats on one measure without losing on the other.

    One pass over the costs in order: a row stays if its capacity exceeds everything cheaper and
    is the best at its own cost. No pair of rows is formed.
    """
    per_cost = df.groupBy(better_low).agg(F.max(better_high).alias("_top"))
    before = running(per_cost, [], [better_low], value_bucket(F.col(better_low)),
                     {"_best_below": ("max", F.col("_top"), False)})
    keep = before.filter(F.col("_best_below").isNull() | (F.col("_top") > F.col("_best_below")))
    return df.join(keep.select(better_low, "_top"), better_low).filter(F.col(better_high) == F.col("_top"))


def batches(df: DataFrame, key: list[str], size: int, seed: int, salt: str, drop_last: bool) -> DataFrame:
    """Batch number of each row in a keyed permutation of the table."""
    placed = hash_ordinal(df, [], key, seed, salt, "_pos")
    out = placed.withColumn("batch", F.floor(F.col("_pos") / F.lit(size)))
    if drop_last:
        full = df.agg(F.floor(F.count(F.lit(1)) / F.lit(size)) * size).scalar()
        out = out.filter(F.col("_pos") < full)
    return out.drop("_pos")


def hardest_negatives(df: DataFrame, batch: str, loss: str, key: list[str], k: int) -> DataFrame:
    """All positives, and the ``k`` negatives with the highest loss of every batch."""
    w = Window.partitionBy(batch, "y").orderBy(F.col(loss).desc(), *key)
    return df.withColumn("_rn", F.row_number().over(w)).filter((F.col("y") == 1) | (F.col("_rn") <= k)).drop("_rn")
