"""Session helper and the shared scratch location used by jobs that must write."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "echoloom", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on and UTC time; partition counts stay with the cluster."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # signal stages are heavy per byte: do not merge them down to a few tasks
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.parquet.compression.codec": "zstd",
    }
    settings.update(conf)
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a fresh temporary folder; a cluster without the
    setting is an error, because executors could not see a folder of the driver machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="echoloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def inline_table(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A constant table as a local relation: its exact size is known to the optimiser."""
    def one(v) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        if isinstance(v, (list, tuple)) and not v:
            return "CAST(array() AS ARRAY<STRUCT<lo: DOUBLE, hi: DOUBLE>>)"
        if isinstance(v, (list, tuple)):
            return "array(" + ", ".join(f"named_struct('lo', {one(lo)}, 'hi', {one(hi)})" for lo, hi in v) + ")"
        return f"'{v}'" if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({columns})")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The files survive executor loss, so later passes see exactly the same rows and row
    numbers instead of recomputing them.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A table read in fewer splits than there are cores is dealt out over all of them, ahead of work that is heavy per
    row (digests, draws). A file of one row group is one split however many cores wait; larger tables stay as they are.

    ``scan`` must be a plain reading of files: its splits are known without running anything.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


#: bytes above which a lookup table is no longer broadcast
BROADCAST_BYTES = 16 << 20


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: texts and arrays by their length, all else 8 bytes a column."""
    def one(name: str, kind: str) -> Column:
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(F.col(name)), F.lit(0))
        if kind.startswith("array"):
            return F.greatest(F.coalesce(F.size(F.col(name)), F.lit(0)), F.lit(0)) * 16
        return F.lit(8)
    return sum((one(f"`{c}`", k) for c, k in df.dtypes), F.lit(16)).cast("long")


def checked_broadcast(dim: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if ``dim`` was measured and found small; else leave the join to AQE.

    The table is written once to the shared folder, so the check does not compute it twice.
    """
    stored = materialize(dim, "dim")
    size = stored.agg(F.coalesce(F.sum(row_bytes(stored)), F.lit(0))).first()[0]
    return F.broadcast(stored) if size <= max_bytes else stored


#: bytes above which a table is no longer looked up in the memory of every task
LOOKUP_BYTES = 64 << 20

#: how many times larger than that a table may be that is looked up in files on every machine; beyond it is joined
FILE_TIMES = 64


def lookup_parts(dim: DataFrame, size: int, key: str) -> Iterator:
    """``dim`` (of ``size`` bytes as measured) as Arrow tables of about ``LOOKUP_BYTES``, dealt by ``key``: the driver holds one at a time."""
    parts = -(-size // LOOKUP_BYTES)
    if parts <= 1:
        yield dim.toArrow()
        return
    path = scratch_path(dim.sparkSession, "lookup")
    dim.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).write.partitionBy("_part").parquet(path)
    stored = dim.sparkSession.read.schema(dim.withColumn("_part", F.lit(0)).schema).parquet(path)
    for i in range(parts):
        yield stored.filter(F.col("_part") == i).drop("_part").toArrow()


def lookup_array(n: int, dtype, filed: bool) -> np.ndarray:
    """Zeros to be filled on the driver and then shared: in memory or, if ``filed``, in a file that is gone when the driver ends."""
    if not filed:
        return np.zeros(n, dtype)
    folder = tempfile.mkdtemp(prefix="echoloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return np.lib.format.open_memmap(f"{folder}/{uuid.uuid4().hex}.npy", "w+", dtype, (n,))


class FiledArrays:
    """``value`` is (arrays, beside), as of a broadcast. The arrays lie in a file each, which every machine fetches once and its tasks
    map: they share it, and none holds it in its own memory."""

    def __init__(self, files: dict[str, str], beside):
        self.files, self.beside = files, beside

    @property
    def value(self) -> tuple[dict[str, np.ndarray], object]:
        return {name: np.asarray(np.load(SparkFiles.get(f), mmap_mode="r")) for name, f in self.files.items()}, self.beside


def share(spark: SparkSession, arrays: dict[str, np.ndarray], beside):
    """Something whose ``value`` in every task is (``arrays``, ``beside``). All arrays are in memory or all are ``filed``; ``beside`` is small."""
    if not any(isinstance(a, np.memmap) for a in arrays.values()):
        return spark.sparkContext.broadcast((arrays, beside))
    for a in arrays.values():
        a.flush()
        spark.sparkContext.addFile(str(a.filename))
    return FiledArrays({name: os.path.basename(a.filename) for name, a in arrays.items()}, beside)
