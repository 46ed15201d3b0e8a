"""Builds that redo only what changed: a tree of digests over the parts of the inputs.

The input rows fall into parts by a hash of their key. A part's digest is order-insensitive; the parts' digests, in part order, and the
configuration give the build key. A build keeps its digests beside its output. The next build compares digests first: an
equal key means that the bundle is reused as it is, and else only the parts whose digest is new are computed
and written again, while parts that are gone are emptied.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echoloom.session import materialize

PART = "build_part"
LEAVES = f"{PART} long, rows long, digest string"


def part_of(key: str, parts: int) -> Column:
    """Which of the parts a row belongs to, from 32 bits of the digest of its key."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long"), F.lit(parts))


def leaves(df: DataFrame, key: str, cols: list[str], parts: int) -> DataFrame:
    """(part, rows, digest) of every part that has rows; equal tables have equal leaves, whatever their order."""
    def one(c: str) -> Column:
        v = F.col(c).cast("string")
        return F.coalesce(F.concat(F.length(v), F.lit(":"), v), F.lit("-"))
    h = F.conv(F.substring(F.sha2(F.concat(*map(one, cols)), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.groupBy(part_of(key, parts).alias(PART)).agg(F.count(F.lit(1)).alias("rows"), F.sum(h).cast("string").alias("digest"))


def root_key(config: dict, tree: DataFrame) -> str:
    """First 16 hex digits over the configuration and all leaves; there are as many leaves as parts, a parameter of the build."""
    listed = [[r[PART], r["rows"], r["digest"]] for r in tree.orderBy(PART).collect()]
    return hashlib.sha256(json.dumps({"config": config, "leaves": listed}, sort_keys=True).encode()).hexdigest()[:16]


def _last(spark: SparkSession, path: str) -> tuple[str | None, DataFrame]:
    """Key and leaves of the last build below ``path``, none if there was none."""
    none = spark.createDataFrame([], LEAVES)
    try:
        kept = spark.read.schema("build_key string, leaves string").json(f"{path}/build").first()
    except Exception as err:
        if "PATH_NOT_FOUND" in str(err):
            return None, none
        raise
    return (kept["build_key"], spark.read.schema(LEAVES).parquet(kept["leaves"])) if kept else (None, none)


def build(df: DataFrame, key: str, cols: list[str], make: Callable[[DataFrame], DataFrame], path: str, config: dict, parts: int = 64) -> dict:
    """Brings the bundle at ``path`` up to date with ``df`` and reports what was done.

    ``make`` turns input rows into output rows part by part: an output row may depend on rows of its own part only. Output is a
    folder per part, written by dynamic overwrite, so other parts stay as they are. The record of the build is written last;
    a build that breaks off is done again.
    """
    spark = df.sparkSession
    tree = materialize(leaves(df, key, cols, parts), "leaves")
    now, (was, old) = root_key({**config, "parts": parts}, tree), _last(spark, path)
    report = {"build_key": now, "reused": now == was, "parts": tree.count(), "rebuilt": 0, "removed": 0, "rows": 0}
    if now == was:
        return report
    same_config = was is not None and was == root_key({**config, "parts": parts}, old)
    known = old if same_config else spark.createDataFrame([], LEAVES)
    changed = materialize(tree.join(known, [PART, "rows", "digest"], "left_anti"), "changed")
    gone = old.join(tree, PART, "left_anti").select(PART)
    sums = changed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    report |= {"rebuilt": sums["n"], "removed": gone.count(), "rows": sums["rows"]}
    redo = df.withColumn(PART, part_of(key, parts)).join(F.broadcast(changed.select(PART)), PART)           # at most ``parts`` rows
    made = make(redo)
    made.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(f"{path}/data")
    tree_path = f"{path}/leaves-{now}"
    tree.write.mode("overwrite").parquet(tree_path)
    spark.createDataFrame([(now, tree_path)], "build_key string, leaves string").coalesce(1).write.mode("overwrite").json(f"{path}/build")
    return report


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The bundle's rows of the parts that the last build has; a part that is gone is not read."""
    _, tree = _last(spark, path)
    rows = spark.read.schema(f"{schema}, {PART} long").parquet(f"{path}/data")
    return rows.join(F.broadcast(tree.select(PART)), PART, "left_semi").drop(PART)
