"""Threshold, ROC, percentile and per-bucket tables over scored corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoloom.operators.running import exact_quantiles, join_null_safe, ladder



def _is(y: int) -> Column:
    return F.when(F.col("y") == y, 1).otherwise(0)


def ratio(a, b) -> Column:
    """a / b, and 0 for an empty denominator."""
    a, b = (F.col(v) if isinstance(v, str) else v for v in (a, b))
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(df: DataFrame, threshold: float, by: list[str] = ()) -> DataFrame:
    hit = F.col("p") >= F.lit(threshold)
    pos = F.col("y") == 1
    g = df.groupBy(*by).agg(
        F.count_if(pos & hit).alias("tp"), F.count_if(pos & ~hit).alias("fn"),
        F.count_if(~pos & hit).alias("fp"), F.count_if(~pos & ~hit).alias("tn"))
    n = F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn")
    return (g.withColumn("tpr", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
            .withColumn("fpr", ratio(F.col("fp"), F.col("fp") + F.col("tn")))
            .withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), n)))


def threshold_table(df: DataFrame, thresholds: list[float]) -> DataFrame:
    """Confusion counts for every threshold in one pass.

    Each row is counted in the interval between two thresholds; the few interval counts are then
    added up for every threshold at or below them.
    """
    ts = sorted(thresholds)
    grid = F.array(*[F.lit(float(t)) for t in ts])
    level = sum((F.col("p") >= F.lit(float(t))).cast("int") for t in ts)      # compiled, unlike a lambda
    bins = df.groupBy(level.alias("level")).agg(F.sum(_is(1)).alias("pos"), F.sum(_is(0)).alias("neg"))
    spread = bins.select("pos", "neg", F.posexplode(grid).alias("i", "threshold"), "level")
    reached = F.col("level") > F.col("i")
    return (spread.groupBy("threshold").agg(
        F.sum(F.when(reached, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(reached, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
        .withColumn("tpr", ratio("tp", "n_pos")).withColumn("fpr", ratio("fp", "n_neg"))
        .withColumn("accuracy", ratio(F.col("tp") + F.col("n_neg") - F.col("fp"), F.col("n_pos") + F.col("n_neg"))))


def with_f1(table: DataFrame) -> DataFrame:
    """F1 from true and false positive counts."""
    precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = ratio("tp", "n_pos")
    return table.withColumn("precision", precision).withColumn(
        "f1", F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0)))


def score_ladder(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Per distinct score, descending: pos, neg and their counts at or above the score."""
    return ladder(df, list(by), "p", {"pos": _is(1), "neg": _is(0)})


def next_up(v: Column) -> Column:
    """The next double above a positive value."""
    half = 2.0 ** -53 * (1.0 + 2.0 ** -52)
    return F.when(v > 0, v + v * F.lit(half)).otherwise(F.lit(4.9e-324))


def at_budgets(df: DataFrame, budgets: list[float], by: list[str] = (), zero_allowed: str = "above_max") -> DataFrame:
    """Threshold, TPR and achieved FPR per false-positive budget.

    ``allowed = floor(budget * n_neg)`` negatives may pass; the threshold is the allowed-th
    largest negative. With ``allowed = 0`` it is just above the largest negative ('above_max') or
    1.0 ('one'). Without negatives it is 0.5. Ties may lift the achieved FPR above the budget.
    """
    by = list(by)
    steps = score_ladder(df, by).withColumn("budget", F.explode(F.array(*[F.lit(float(b)) for b in budgets])))
    allowed = F.floor(F.col("budget") * F.col("neg_total")).cast("long")
    none_left = (allowed > 0) & (F.col("neg") > 0) & (F.col("neg_cum") >= allowed)
    here = F.struct("p", "pos_cum", "neg_cum")
    g = steps.groupBy(*by, "budget").agg(
        F.max("pos_total").alias("n_pos"), F.max("neg_total").alias("n_neg"),
        F.max(allowed).alias("allowed"),
        F.max(F.when(none_left, here)).alias("cut"),
        F.max(F.when(F.col("neg") > 0, F.col("p"))).alias("max_neg"),
        F.max(F.when(F.col("neg_cum") == 0, F.col("pos_cum"))).alias("pos_over"),
        F.max(F.when(F.col("p") >= 1.0, F.col("pos_cum"))).alias("pos_one"),
        F.max(F.when(F.col("p") >= 1.0, F.col("neg_cum"))).alias("neg_one"),
        F.max(F.when(F.col("p") >= 0.5, F.col("pos_cum"))).alias("pos_half"))
    empty, zero = F.col("n_neg") == 0, F.col("allowed") == 0
    if zero_allowed == "one":
        t0, tp0, fp0 = F.lit(1.0), F.coalesce("pos_one", F.lit(0)), F.coalesce("neg_one", F.lit(0))
    else:
        t0, tp0, fp0 = next_up(F.col("max_neg")), F.coalesce("pos_over", F.lit(0)), F.lit(0)
    tp = F.when(empty, F.coalesce("pos_half", F.lit(0))).when(zero, tp0).otherwise(F.col("cut.pos_cum"))
    fp = F.when(empty, F.lit(0)).when(zero, fp0).otherwise(F.col("cut.neg_cum"))
    return g.select(
        *by, "budget", "allowed", "n_pos", "n_neg",
        F.when(empty, F.lit(0.5)).when(zero, t0).otherwise(F.col("cut.p")).alias("threshold"),
        tp.alias("tp"), fp.alias("fp"),
        ratio(tp, F.col("n_pos")).alias("tpr"), ratio(fp, F.col("n_neg")).alias("fpr"))


def auc(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """Mann-Whitney area with tied scores counted half; NULL when a class is missing."""
    below = F.col("neg_total") - F.col("neg_cum") + F.col("neg") / 2.0
    g = score_ladder(df, by).groupBy(*by).agg(
        F.sum(F.col("pos") * below).alias("wins"), F.max("pos_total").alias("n_pos"), F.max("neg_total").alias("n_neg"))
    return g.withColumn("auc", F.when(
        (F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("wins") / (F.col("n_pos") * F.col("n_neg")))).drop("wins")


def bucket_table(df: DataFrame, threshold: float, y: int, by: list[str]) -> DataFrame:
    """Per bucket of one class: n, share at or above the threshold, count, mean and tail score."""
    sel = df.filter(F.col("y") == y)
    rate, count, tail, q = (("recall", "hits", "p05", 0.05) if y == 1 else ("fa_rate", "fa_count", "p95", 0.95))
    hit = F.col("p") >= F.lit(threshold)
    means = sel.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_conf"),
                                 F.count_if(hit).alias(count))
    out = join_null_safe(means, exact_quantiles(sel, by, "p", {tail: q}), by)
    out = out.withColumn(rate, F.col(count) / F.col("n"))
    return out.withColumn("missed", F.lit(1.0) - F.col("recall")) if y == 1 else out


def pooled(df: DataFrame, threshold: float, content: str = "content", recipe: str = "recipe") -> DataFrame:
    """Rates per (content, recipe), per content, per recipe and overall; NULL marks 'all'."""
    hit = (F.col("p") >= F.lit(threshold)).cast("int")
    return df.cube(content, recipe).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_pos"),
        F.sum(hit * F.col("y")).alias("tp"), F.sum(hit * (1 - F.col("y"))).alias("fp"))


def class_weights(df: DataFrame, pos_bias: float = 1.15) -> DataFrame:
    """Square-root law with clipping, and the two older linear laws."""
    g = df.groupBy().agg(F.greatest(F.lit(1), F.sum(_is(1))).alias("n_pos"),
                         F.greatest(F.lit(1), F.sum(_is(0))).alias("n_neg"))
    r = F.col("n_neg") / F.col("n_pos")
    neg = F.least(F.greatest(F.sqrt(r), F.lit(0.5)), F.lit(2.0))
    return g.select("n_pos", "n_neg", r.alias("ratio"), neg.alias("neg_w"),
                    (neg * F.lit(pos_bias)).alias("pos_w"),
                    F.least(F.lit(2.5), r * 0.6).alias("pos_w_capped"), (r * 0.5).alias("pos_w_half"))
