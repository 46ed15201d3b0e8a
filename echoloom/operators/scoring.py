"""Training and scoring of detectors, and the stress tests that need a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoloom.functions import arrays as A
from echoloom.operators.metrics import class_weights


def row_weights(df: DataFrame, bucket_weight: Column, pos_bias: float = 1.15) -> DataFrame:
    """``w`` = class weight x bucket weight; negatives get the negative class weight."""
    cw = class_weights(df, pos_bias)
    neg, pos = (cw.select(c).scalar() for c in ("neg_w", "pos_w"))
    return df.withColumn("w", F.when(F.col("y") == 1, pos).otherwise(neg) * bucket_weight)


def train(df: DataFrame, x: str = "x", label: str = "y", weight: str = "w", iterations: int = 20):
    """Weighted binary detector. The optimiser aggregates gradients over all partitions."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = df.withColumn("_f", array_to_vector(F.col(x)))
    return LogisticRegression(featuresCol="_f", labelCol=label, weightCol=weight, maxIter=iterations,
                              regParam=1e-3, standardization=False).fit(data)


def newton(df: DataFrame, x: str = "x", label: str = "y", weight: str = "w", steps: int = 6, ridge: float = 1e-3) -> np.ndarray:
    """Coefficients of a weighted logistic model after ``steps`` Newton steps from zero; ``x`` holds a one for the intercept.

    A step needs two sums over the rows: the gradient and the weighted outer products. Each task sums its own, the tasks' sums
    are added by Spark, and what reaches the driver is one matrix of the features' size. No step size is searched and
    nothing is drawn, so a run can be repeated and checked. Rows with a NULL label, weight or feature take no part.
    """
    import pyarrow as pa

    rows = df.filter(F.col(label).isNotNull() & F.col(weight).isNotNull() & F.col(x).isNotNull() & F.forall(x, lambda v: v.isNotNull()))
    rows = rows.select(F.col(x).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"), F.col(weight).cast("double").alias("w"))
    size = rows.agg(F.max(F.size("x"))).first()[0] or 0
    beta = np.zeros(size)

    def sums(beta: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((size + 1, size))
            for b in batches:
                if b.num_rows:
                    m = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, size)
                    y, w = b.column(1).to_numpy(), b.column(2).to_numpy()
                    p = 1.0 / (1.0 + np.exp(-(m @ beta)))
                    total += np.vstack([(w * (y - p)) @ m, (m * (w * p * (1.0 - p))[:, None]).T @ m])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "v"])
        return run

    for _ in range(steps if size else 0):
        got = rows.mapInArrow(sums(beta), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()     # (size + 1) * size numbers
        flat = np.zeros((size + 1) * size)
        for r in got:
            flat[r["i"]] = r["v"]
        flat = flat.reshape(size + 1, size)
        beta = beta + np.linalg.solve(flat[1:] + ridge * np.eye(size), flat[0] - ridge * beta)
    return beta


def apply_model(model, df: DataFrame, x: str = "x") -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array

    out = model.transform(df.withColumn("_f", array_to_vector(F.col(x))))
    return out.withColumn("p", vector_to_array("probability")[1]).drop("_f", "rawPrediction", "probability", "prediction")


def score_batches(df: DataFrame, predict: Callable[[pd.Series], pd.Series], x: str = "x") -> DataFrame:
    """Adds ``p`` from a user model that maps a batch of arrays to probabilities.

    Rows arrive in Arrow batches (``spark.sql.execution.arrow.maxRecordsPerBatch`` sets the size);
    the callable is shipped once per task. Filter cheaply (energy gate) before calling this.
    """
    schema = T.StructType(df.schema.fields + [T.StructField("p", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(p=predict(b[x]))
    return df.mapInPandas(run, schema)


def linear_weights(n: int = 64) -> list[float]:
    """Fixed coefficients of the stand-in model, from a rule."""
    return [((i * 37) % 64 - 32) / 16.0 for i in range(n)]


def linear_score(x: Column, n: int = 64, bias: float = -0.5) -> Column:
    return A.logistic(x, F.array(*[F.lit(w) for w in linear_weights(n)]), bias)


def offset_stress(df: DataFrame, x: str, offsets: list[int], score: Callable[[Column], Column], threshold) -> DataFrame:
    """Recall of positives per circular shift; the scorer stays in the JVM."""
    shifted = df.filter("y = 1").withColumn("offset", F.explode(F.array(*[F.lit(o) for o in offsets])))
    p = shifted.withColumn("p", A.let(A.roll(F.col(x), F.col("offset")), score))
    return p.groupBy("offset").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("p") >= threshold).cast("int")).alias("tpr"), F.avg("p").alias("mean_conf"))


def offset_summary(stress: DataFrame) -> DataFrame:
    """Spread over the offsets, and the selection score: mean of base and rolled recall."""
    base = F.max(F.when(F.col("offset") == 0, F.col("tpr")))
    rolled = F.avg(F.when(F.col("offset") != 0, F.col("tpr")))
    return stress.agg(F.min("tpr").alias("lowest"), F.max("tpr").alias("highest"),
                      (F.max("tpr") - F.min("tpr")).alias("spread"), (0.5 * (base + rolled)).alias("selection"))


def level_stress(df: DataFrame, x: str, gains_db: list[float], score: Callable[[Column], Column], threshold: float) -> DataFrame:
    """Recall and false-alarm rate per input gain."""
    g = df.withColumn("gain_db", F.explode(F.array(*[F.lit(float(v)) for v in gains_db])))
    p = g.withColumn("p", A.let(A.feature_gain(F.col(x), A.gain_offset(F.col("gain_db")), -11.5129, 5.0), score))
    hit = (F.col("p") >= threshold).cast("int")
    return p.groupBy("gain_db").agg(
        F.avg(F.when(F.col("y") == 1, hit)).alias("recall"), F.avg(F.when(F.col("y") == 1, F.col("p"))).alias("pos_mean"),
        F.avg(F.when(F.col("y") == 0, hit)).alias("fa_rate"))
