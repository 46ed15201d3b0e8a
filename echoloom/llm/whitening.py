"""Embedding whitening: blockwise QR of centred rows, then a bidiagonal qd solver for the directions.

1. Vectors become whole numbers, floor(scale * c). Each distinct vector is one row of the fit list.
2. Length n and sums S of the list are exact. A row is centred as (n * x - S) / n from whole numbers, so nothing is
   lost before the first rounding.
3. Every task reduces blocks of centred rows to one triangular factor by QR; factors are stacked and reduced again, a
   few at a time, until one is left. Its R^T R / n is the covariance, which is never formed.
4. ``bidiagonal`` gives the singular values and right vectors of R: eigenvalues e and components.
5. Every row is centred again and projected; dividing by sqrt(e) whitens it. The covariance of the whitened list is
   summed in one more pass and compared with the identity.

What reaches the driver is S (d numbers), one d by d factor and a few sums, whatever the number of rows. The list is
written once to the shared folder and read by each pass; copies of a vector are dropped before they move.

Defined results for odd input: rows whose vector is NULL, or holds a NULL or non-finite entry, are left out. A shorter
vector is filled up with zeros (an empty one is all zeros). Repeated rows count once in the fit and come back each. A
NULL id stays NULL. Vectors without any entry have no component and give no rows. A component whose eigenvalue is zero
(fewer different directions than components) has ``explained`` 0 and ``whitened`` NULL, and a list without any variance
has ``explained`` NULL too. ``deviation`` is exact, and NULL if it does not fit a long; ``spread`` gives the same as a
double, over n squared. Entries beyond 2^53 lose their last bits in double arithmetic, and scaled ones beyond a long are
held at its ends. Columns beyond the named ones are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoloom.llm import bidiagonal
from echoloom.llm.common import stored

SCALE = 256
COMPONENTS = 4
#: factors stacked in one step of the reduction
FAN = 16
#: rows stacked on a factor at once
BLOCK = 4096


def whole_vectors(df: DataFrame, id_col: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(k, x) of the rows that take part; x holds whole numbers and has the same length in every row."""
    v = df[f"`{vector}`"]
    good = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    x: Column = F.transform("v", lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))
    rows = df.select(df[f"`{id_col}`"].alias("k"), v.alias("v")).filter(good)
    ends = rows.agg(F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi")).first()
    if ends["lo"] != ends["hi"]:
        x = F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(ends["hi"]) - F.size("v")))
    return rows.select("k", x.alias("x"))


def matrix(column) -> np.ndarray:
    """The array column of an Arrow batch as an int64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def moments(fit: DataFrame) -> tuple[int, list[int]]:
    """Rows of the list and exact sums by dimension.

    Values are summed as high and low halves, which cannot overflow below 2^31 rows a task, and meet as decimals.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, None, None
        for b in batches:
            x = matrix(b.column(0))
            n += len(x)
            h, m = (x >> 31).sum(0), (x & ((1 << 31) - 1)).sum(0)
            high, low = (h, m) if high is None else (high + h, low + m)
        if n:
            d = len(high)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, d)), pa.array(np.concatenate([[0], high])), pa.array(np.concatenate([[n], low]))],
                                             ["dim", "high", "low"])

    parts = fit.mapInArrow(run, "dim long, high long, low long")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    sums = {r["dim"]: (int(r["high"]) << 31) + int(r["low"]) for r in parts.groupBy("dim").agg(wide("high").alias("high"), wide("low").alias("low")).collect()}
    return sums.get(-1, 0), [sums[i] for i in range(len(sums) - 1)]          # one row per dimension


class Centring:
    """Exact n * x - S of whole-number rows, in 64 bits where that is proven to be enough."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.most = max((abs(s) for s in sums), default=0)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        biggest = max(int(x.max(initial=0)), -int(x.min(initial=0)))
        if self.n * biggest + self.most < 1 << 62:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x).astype(float) / self.n

    def deviations(self, scaled: np.ndarray) -> list[int | None]:
        """Sums of squares, exact; None beyond a long."""
        near = (scaled.astype(float) ** 2).sum(1)
        unsure = np.ones(len(scaled), bool) if scaled.dtype == object else np.abs(near - 2.0 ** 63) < 2.0 ** 33
        # sums wrap around modulo 2^64, so they are right wherever the true sum fits
        sums = [0] * len(scaled) if scaled.dtype == object else (scaled * scaled).sum(1).tolist()
        exact = [sum(int(v) ** 2 for v in row) if u else s if f < 2.0 ** 63 else 1 << 63
                 for row, u, s, f in zip(scaled, unsure.tolist(), sums, near.tolist(), strict=True)]
        return [v if v < 1 << 63 else None for v in exact]


def triangular(fit: DataFrame, centring: Centring) -> np.ndarray:
    """R of the QR of all centred rows over sqrt(n)."""
    import pyarrow as pa

    d, n = len(centring.sums), centring.n
    block, fan = BLOCK, FAN

    def reduced(parts: list[np.ndarray]) -> np.ndarray:
        r = np.linalg.qr(np.vstack(parts), mode="r")
        return np.vstack([r, np.zeros((d - len(r), d))]) if len(r) < d else r

    def out(r: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for b in batches:
            x = matrix(b.column(0))
            for i in range(0, len(x), block):
                rows = centring.rows(x[i:i + block])
                r = reduced([rows] if r is None else [r, rows])
        yield from out(r)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for b in batches:
            for v in b.column(0):
                other = np.frombuffer(v.as_py()).reshape(d, d)
                r = other if r is None else reduced([r, other])
        yield from out(r)

    factors = stored(fit.mapInArrow(first, "r binary"), "factors")
    left = factors.count()
    while left > 1:
        factors = stored(factors.repartition(-(-left // fan)).mapInArrow(merge, "r binary"), "factors")
        left = factors.count()
    return np.frombuffer(factors.first()["r"]).reshape(d, d) / np.sqrt(n)


class Whitening:
    """Centre and scaled components; ``project`` whitens centred rows."""

    def __init__(self, centring: Centring, values: np.ndarray, directions: np.ndarray, components: int):
        e = values ** 2
        self.centring, trace = centring, float(e.sum())
        self.components, self.known = min(components, len(values)), directions.shape[1]
        self.scaled = directions / values[:self.known]
        self.explained = [float(v) / trace if i < self.known else 0.0 for i, v in enumerate(e[:self.components])] if trace > 0 else [None] * self.components

    def project(self, scaled: np.ndarray) -> np.ndarray:
        return (scaled.astype(float) / self.centring.n) @ self.scaled


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of distinct rows (x); None without rows."""
    n, sums = moments(rows)
    if not n:
        return None
    centring = Centring(n, sums)
    values, directions = bidiagonal.leading(triangular(rows, centring), components) if sums else (np.zeros(0), np.zeros((0, 0)))
    return Whitening(centring, values, directions, components)


def identity_error(rows: DataFrame, model: Whitening) -> float | None:
    """Largest entry of the whitened list's covariance minus the identity."""
    import pyarrow as pa

    m = model.known
    if not m:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m + 1, m))
        for b in batches:
            x = matrix(b.column(0))
            if len(x):
                w = model.project(model.centring.scaled(x))
                total += np.vstack([w.T @ w, w.sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "v"])

    sums = rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()      # m + 1 rows of m numbers
    t = np.zeros(m * (m + 1))
    for r in sums:
        t[r["i"]] = r["v"]
    t = t.reshape(m + 1, m) / model.centring.n
    return float(np.max(np.abs(t[:m] - np.outer(t[m], t[m]) - np.eye(m))))


def whiten(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """One row per vector and component: id, ``component`` from 1, ``n``, ``deviation``, ``spread``, ``whitened``, ``explained``, ``identity_error``."""
    import pyarrow as pa

    rows = whole_vectors(df, id_col, vector, scale)
    known = stored(rows.select("x").distinct(), "fit-list")
    model = fit(known, components)
    fields = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("spread", T.DoubleType()), ("whitened", T.DoubleType()),
              ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]
    schema = T.StructType([T.StructField("k", rows.schema["k"].dataType), *(T.StructField(a, t) for a, t in fields)])
    final = [F.col("k").alias(id_col), *(a for a, _ in fields)]
    if model is None:
        return df.sparkSession.createDataFrame([], schema).select(*final)
    error, n = identity_error(known, model), model.centring.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, m = model.components, model.known
        for b in batches:
            if not b.num_rows or not c:
                continue
            scaled = model.centring.scaled(matrix(b.column(1)))
            w, deviation = model.project(scaled), model.centring.deviations(scaled)
            spread = ((scaled.astype(float) / n) ** 2).sum(1)
            size = b.num_rows
            again = pa.array(np.repeat(np.arange(size), c))
            padded = pa.array(np.hstack([w, np.zeros((size, c - m))]).ravel(), mask=np.tile(np.arange(c) >= m, size))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(again), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), size)), pa.array(np.full(size * c, n, np.int64)),
                 pa.array(deviation, pa.int64()).take(again), pa.array(np.repeat(spread, c)), padded,
                 pa.array(model.explained * size, pa.float64()), pa.array([error] * (size * c), pa.float64())], schema.names)

    return rows.mapInArrow(run, schema).select(*final)
