"""Keyed pseudo-random draws.

A draw depends only on (seed, salt, key), so it does not change with partitioning, retries or
the order in which rows arrive. Spark's ``rand(seed)`` has none of these properties.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


#: stands for NULL in a key, so that ('a', NULL, 'b') and ('a', 'b', NULL) draw differently
NULL_KEY = "\x00"


def _cols(keys) -> list[Column]:
    return [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit(NULL_KEY)) for k in keys]


def digest(seed: int, salt: str, *keys) -> Column:
    """32 hex digits that order rows pseudo-randomly."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), *_cols(keys)))


def uniform(seed: int, salt: str, *keys) -> Column:
    """U[0, 1) from the first 32 bits of the digest."""
    return F.conv(F.substring(digest(seed, salt, *keys), 1, 8), 16, 10).cast("double") / F.lit(TWO32)


def in_range(u: Column, lo, hi) -> Column:
    return F.lit(lo) + (F.lit(hi) - F.lit(lo)) * u


def integer_in(u: Column, lo, hi) -> Column:
    """Integer in [lo, hi)."""
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi))
    return (lo + F.floor(u * (hi - lo))).cast("long")


def choose(u: Column, options: list) -> Column:
    """One of a list; repeating an option raises its weight."""
    arr = F.array(*[F.lit(o) for o in options])
    return F.element_at(arr, (F.lit(1) + F.floor(u * F.lit(len(options)))).cast("int"))


def cumulative(weights: dict) -> list[tuple[str, float, float]]:
    """(name, lo, hi) intervals of the normalised weights, in the given order."""
    total = float(sum(weights.values()))
    out, lo = [], 0.0
    for name, w in weights.items():
        hi = lo + w / total
        out.append((name, lo, hi))
        lo = hi
    return out


def weighted(u: Column, weights: dict) -> Column:
    """Inverse-CDF draw: the first name whose cumulative share exceeds ``u``."""
    steps = cumulative(weights)

    def pick(v: Column) -> Column:
        expr = F
        for name, _, hi in steps[:-1]:
            expr = expr.when(v < F.lit(hi), F.lit(name))
        return F.lit(steps[-1][0]) if expr is F else expr.otherwise(F.lit(steps[-1][0]))
    return F.element_at(F.transform(F.array(u), lambda v: pick(v)), 1)       # the draw is computed once


def bernoulli(u: Column, p) -> Column:
    return u < (p if isinstance(p, Column) else F.lit(p))


def chance(seed: int, salt: str, p: float, *keys) -> Column:
    """``bernoulli(uniform(seed, salt, *keys), p)`` for a fixed ``p``: hex digits of one length are in the order of their numbers, so the
    digest is compared as text and no number is made of it."""
    bound = math.ceil(p * TWO32)                                 # the first 32 bits that are not below p
    if bound >= TWO32:
        return F.lit(True)
    return digest(seed, salt, *keys) < F.lit(f"{max(bound, 0):08x}")


def joined(*keys) -> Column:
    """Several keys as one that draws the same, for rows that share them in many draws."""
    return F.concat_ws("|", *_cols(keys))


def uniform_sql(seed: int, salt: str, *keys: str) -> str:
    """The same draw as DuckDB SQL."""
    parts = ", ".join([f"'{seed}'", f"'{salt}'", *(f"coalesce(({k})::VARCHAR, chr(0))" for k in keys)])
    return f"(('0x' || substr(md5(concat_ws('|', {parts})), 1, 8))::BIGINT / {TWO32}::DOUBLE)"


def digest_sql(seed: int, salt: str, *keys: str) -> str:
    parts = ", ".join([f"'{seed}'", f"'{salt}'", *keys])
    return f"md5(concat_ws('|', {parts}))"
