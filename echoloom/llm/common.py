"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echoloom.session import scratch_path

#: a word is a run of characters other than the six ASCII white-space characters
WORD = r"[^\x20\x09-\x0D]+"
#: largest lookup table that is broadcast, in bytes of its keys plus a fixed share per row
BROADCAST_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: later passes see fixed rows."""
    path = scratch_path(df.sparkSession, f"llm-{label}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of a stored table only if its measured bytes are within ``limit``.

    Otherwise the table is returned as it is and the join shuffles, where adaptive execution
    splits hot keys. The join result is the same either way.
    """
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) if t == "string" else F.lit(8) for c, t in df.dtypes), F.lit(16))
    size = df.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("b")).first()["b"]
    return F.broadcast(df) if size <= limit else df


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` has, whatever extra columns the caller brought."""
    taken = {c.lower() for c in df.columns}
    return stem if stem.lower() not in taken else f"{stem}_{uuid.uuid4().hex[:8]}"


def words(text: Column) -> Column:
    """All words of a text; none for NULL."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def lower_ascii(s: Column) -> Column:
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
