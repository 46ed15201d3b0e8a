"""Clip inventories, indexes, shards, transcripts, manifests and corpora."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoloom.functions.text import class_from_filename

INDEX_SCHEMA = "path string, `class` string, duration_s double, sr int"
INDEX_VARIANT = "file string, `class` string, duration_s double"
AUDIO_COLUMNS = {"class": ["category", "label", "class", "target"], "path": ["filename", "file", "path"],
                 "speaker": ["speaker_id", "speaker", "spk_id"]}


# ---- clips ------------------------------------------------------------------------------------

def scan_clips(spark: SparkSession, root: str, pattern: str = "*.{wav,flac}", content: bool = False) -> DataFrame:
    """Clip files under ``root``. Without ``content`` only the listing is read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", pattern).load(root))
    return files if content else files.select("path", "length", "modificationTime")


def label_by_directory(files: DataFrame) -> DataFrame:
    """positive/... is 1, negative/... is 0."""
    side = F.regexp_extract("path", r"/(positive|negative)/[^/]*$", 1)
    return files.filter(side != "").withColumn("y", (side == "positive").cast("int"))


# ---- index ------------------------------------------------------------------------------------

def read_index(spark: SparkSession, path: str, fallback: DataFrame | None = None) -> DataFrame:
    """(path, class, duration_s, sr) from either index layout; the fallback listing if it is empty.

    Columns are bound by the names in the header, in any order; further ones are ignored.
    """
    rows = spark.read.option("header", "true").csv(path)
    layout = T.StructType.fromDDL(INDEX_SCHEMA if "path" in rows.columns else INDEX_VARIANT)
    typed = {f.name: (F.col(f.name) if f.name in rows.columns else F.lit(None)).try_cast(f.dataType) for f in layout.fields}
    name = layout.fieldNames()[0]
    index = rows.select(F.regexp_replace(typed[name], r"\\", "/").alias("path"), typed["class"].alias("class"),
                        typed["duration_s"].alias("duration_s"), typed.get("sr", F.lit(None).cast("int")).alias("sr"))
    if fallback is None:
        return index
    empty = index.agg(F.count(F.lit(1)) == 0).scalar()
    legacy = fallback.select("path", class_from_filename(F.col("path")).alias("class"),
                             F.lit(None).cast("double").alias("duration_s"), F.lit(None).cast("int").alias("sr"))
    return index.unionByName(legacy.filter(empty))


def index_rows(clips: DataFrame, seconds: Column, sr: Column) -> DataFrame:
    return clips.select(F.regexp_replace("path", r"\\", "/").alias("path"),
                        class_from_filename(F.col("path")).alias("class"),
                        F.round(seconds, 3).alias("duration_s"), sr.cast("int").alias("sr"))


def write_index(index: DataFrame, path: str) -> None:
    """Full rebuild: running it again replaces the same rows."""
    index.write.mode("overwrite").option("header", "true").csv(path)


# ---- shards -----------------------------------------------------------------------------------

def first_present(df: DataFrame, names: list[str], default: str | None = None) -> Column:
    """The first of ``names`` that is a column of ``df``, else the default."""
    for n in names:
        if n in df.columns:
            return F.col(n)
    return F.lit(default)


def shard_clips(shard: DataFrame, default_class: str = "unknown") -> DataFrame:
    """(path, class, speaker, bytes) from a shard whose audio is a struct or an array of structs.

    Rows without bytes are dropped.
    """
    kind = shard.schema["audio"].dataType
    audio = F.get("audio", F.lit(0)) if isinstance(kind, T.ArrayType) else F.col("audio")
    return shard.select(
        F.coalesce(first_present(shard, AUDIO_COLUMNS["path"]).cast("string"), audio["path"]).alias("path"),
        F.coalesce(first_present(shard, AUDIO_COLUMNS["class"]).cast("string"), F.lit(default_class)).alias("class"),
        first_present(shard, AUDIO_COLUMNS["speaker"]).cast("string").alias("speaker"),
        audio["bytes"].alias("bytes")).filter(F.length("bytes") > 0)


# ---- transcripts ------------------------------------------------------------------------------

def parse_transcripts(lines: DataFrame, line: str = "value") -> DataFrame:
    """First token is the utterance id, the rest are its words; lines with less are skipped."""
    tokens = F.filter(F.split(F.trim(F.col(line)), r"\s+"), lambda w: w != "")
    return (lines.select(tokens.alias("_t")).filter(F.size("_t") >= 2)
            .select(F.element_at("_t", 1).alias("utt_id"), F.slice("_t", F.lit(2), F.size("_t") - 1).alias("words")))


def scan_transcripts(spark: SparkSession, root: str) -> DataFrame:
    return parse_transcripts(spark.read.option("recursiveFileLookup", "true")
                             .option("pathGlobFilter", "*.trans.txt").text(root))


# ---- manifests --------------------------------------------------------------------------------

def manifest(files: DataFrame, name: str, content: str) -> DataFrame:
    return files.select(F.col(name).alias("name"), F.length(content).cast("bigint").alias("bytes"),
                        F.sha2(F.col(content), 256).alias("sha256"))


def manifest_totals(m: DataFrame, build_key: str) -> DataFrame:
    return m.agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("total_bytes")).select(
        "files", "total_bytes", F.lit(build_key).alias("build_key"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_utc"))


def verify(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """(name, reason) for every difference; an empty manifest is itself a finding."""
    r = recorded.select("name", F.col("bytes").alias("rb"), F.col("sha256").alias("rh"))
    a = actual.select("name", F.col("bytes").alias("ab"), F.col("sha256").alias("ah"))
    reason = (F.when(F.col("ab").isNull(), "missing").when(F.col("rb").isNull(), "unlisted")
              .when(F.col("rb") != F.col("ab"), "size").when(F.col("rh") != F.col("ah"), "hash"))
    diffs = r.join(a, "name", "full").select("name", reason.alias("reason")).filter(F.col("reason").isNotNull())
    none = recorded.agg((F.count(F.lit(1)) == 0).alias("empty")).filter("empty").select(
        F.lit("").alias("name"), F.lit("empty manifest").alias("reason"))
    return diffs.unionByName(none)


def table_digest(df: DataFrame, cols: list[str]) -> DataFrame:
    """Digest that does not depend on row order: the sum of 60-bit row hashes, as text.

    Each value goes in with its length in front and NULL as a sign of its own, so neither NULLs nor
    separators inside values make two different rows look alike.
    """
    def part(c: str) -> Column:
        v = F.col(c).cast("string")
        return F.coalesce(F.concat(F.length(v), F.lit(":"), v), F.lit("-"))
    h = F.conv(F.substring(F.sha2(F.concat(*(part(c) for c in cols)), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("digest"))


def build_key(config: dict, digest: str) -> str:
    """First 16 hex digits of the hash of the canonical JSON of a configuration and a digest."""
    payload = json.dumps({"config": config, "inputs": digest}, sort_keys=True)
    return hashlib.sha256(payload.encode()).hexdigest()[:16]


def up_to_date(spark: SparkSession, path: str, key: str) -> bool:
    """Whether the bundle at ``path`` was built under ``key``."""
    try:
        row = spark.read.json(f"{path}/build").select("build_key").limit(1).collect()
    except Exception as err:  # an absent or unreadable record means: build again
        if "PATH_NOT_FOUND" in str(err) or "UNABLE_TO_INFER_SCHEMA" in str(err):
            return False
        raise
    return bool(row) and row[0][0] == key


# ---- corpora ----------------------------------------------------------------------------------

SENTINEL_SNR = 40.0


def write_corpus(df: DataFrame, path: str) -> None:
    """One table, a folder per split; an absent SNR becomes the fixed sentinel."""
    out = df.withColumn("snr", F.coalesce("snr", F.lit(SENTINEL_SNR))) if "snr" in df.columns else df
    out.write.mode("overwrite").partitionBy("split").option("compression", "zstd").parquet(path)


def compact(df: DataFrame) -> DataFrame:
    """Feature columns (``x...``) from double to float; other columns are untouched."""
    cols = [F.col(f.name).cast("array<float>").alias(f.name)
            if f.name.lower().startswith("x") and f.dataType == T.ArrayType(T.DoubleType()) else F.col(f.name)
            for f in df.schema.fields]
    return df.select(*cols)


def write_history(history: DataFrame, args: dict, path: str, best_by: str = "tpr") -> None:
    """One JSON document: arguments, the best epoch and the list of epochs (one row per epoch)."""
    fields = F.struct(*[F.col(c) for c in history.columns])
    doc = history.agg(F.sort_array(F.collect_list(fields)).alias("history"), F.max_by(fields, best_by).alias("best"))
    doc.withColumn("args", F.lit(json.dumps(args, sort_keys=True))).write.mode("overwrite").json(path)


def read_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    doc = spark.read.schema(f"args string, best struct<{schema}>, history array<struct<{schema}>>").json(path)
    return doc.select(F.explode("history").alias("h")).select("h.*")


def folder_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(files, bytes) of the data files below a folder, from their listing: no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def compact_folder(spark: SparkSession, source: str, target: str) -> dict:
    """Rewrites a corpus with float features and reports rows and bytes before and after.

    Rows come from the footers and bytes from the listings, so nothing is read twice.
    """
    compact(spark.read.parquet(source)).write.mode("overwrite").option("compression", "zstd").parquet(target)
    report = {}
    for when, path in (("before", source), ("after", target)):
        listed = folder_bytes(spark, path).first()
        report |= {f"rows_{when}": spark.read.parquet(path).count(), f"bytes_{when}": listed["bytes"], f"files_{when}": listed["files"]}
    return report
