"""Fixed-length chunks of long streams.

A stream is a key with dense step numbers. It is cut into chunks of ``size`` steps, so that a
stream holding a third of all rows spreads over many tasks. Operators that look back a bounded
number of steps get copies of the last ``halo`` rows of the previous chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096


def chunk_of(step: str = "step", size: int = CHUNK) -> Column:
    return F.floor(F.col(step) / F.lit(size)).cast("long")


def with_halo(df: DataFrame, halo: int, step: str = "step", size: int = CHUNK) -> DataFrame:
    """Adds ``chunk`` and ``own``; a row near the end of a chunk also appears in the next one."""
    if halo >= size:
        raise ValueError("the halo must be shorter than a chunk")
    home = chunk_of(step, size)
    late = F.pmod(F.col(step), F.lit(size)) >= F.lit(size - halo)
    spots = F.when(late, F.array(home, home + 1)).otherwise(F.array(home))
    return (df.withColumn("chunk", F.explode(spots))
            .withColumn("own", F.col("chunk") == home))


def chunk_window(stream: str = "stream", step: str = "step") -> Window:
    return Window.partitionBy(stream, "chunk").orderBy(step)


def ring_buffer(df: DataFrame, value: str, length: int, stream: str = "stream", step: str = "step",
                out: str = "buffer", size: int = CHUNK) -> DataFrame:
    """The last ``length`` values up to each step, zero-filled before the stream starts."""
    w = chunk_window(stream, step).rowsBetween(-(length - 1), 0)
    got = with_halo(df, length - 1, step, size).withColumn("_got", F.collect_list(value).over(w))
    pad = F.array_repeat(F.lit(0.0), F.lit(length) - F.size("_got"))
    return got.filter("own").withColumn(out, F.concat(pad, "_got")).drop("_got", "own", "chunk")
