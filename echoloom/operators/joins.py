"""Joins between samples, dimensions, clips, transcripts, detections and trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoloom.operators.running import hash_ordinal
from echoloom.operators.sampling import clip_lists, draw_clips
from echoloom.functions.draws import uniform
from echoloom.plans import dims
from echoloom.session import checked_broadcast


def keep_existing(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``left`` whose key exists in ``right``."""
    return left.join(right.select(*on), on, "left_semi")


def with_mixture(samples: DataFrame, bucket: str = "mix") -> DataFrame:
    """Bucket and recipe attributes; both dimensions are fixed tables of at most 24 rows."""
    spark = samples.sparkSession
    b = dims.bucket_dim(spark).withColumnRenamed("bucket", bucket).withColumnRenamed("content", "mix_content").withColumnRenamed("recipe", "mix_recipe")
    r = dims.recipe_dim(spark).withColumnRenamed("recipe", "mix_recipe")
    return samples.join(F.broadcast(b), bucket).join(F.broadcast(r), "mix_recipe")


def with_loss_weight(samples: DataFrame, weights: DataFrame, bucket: str, default: float = 1.0) -> DataFrame:
    """Left join of a weight table (bucket, weight); unknown buckets weigh ``default``."""
    return samples.join(weights, bucket, "left").withColumn("weight", F.coalesce("weight", F.lit(default)))


def with_class(clips: DataFrame, meta: DataFrame, on: list[str], name: str, default: str) -> DataFrame:
    return clips.join(meta, on, "left").withColumn(name, F.coalesce(name, F.lit(default)))


def layer_rows(samples: DataFrame, key: str, n_layers: Column, snr: Column, clips: DataFrame, klass: str,
               clip: str, seed: int) -> DataFrame:
    """One row per (sample, layer) with a drawn clip and SNR. ``snr``: array<struct<lo,hi>>."""
    layers = (samples.filter(n_layers > 0)
              .select(key, F.explode(F.sequence(F.lit(0), (n_layers - 1).cast("int"))).alias("layer"), snr.alias("_snr")))
    drawn = draw_clips(layers, [key, "layer"], clips, klass, clip, seed, "layer")
    rng = F.get("_snr", F.col("layer"))
    drawn = drawn.withColumn("snr", rng["lo"] + (rng["hi"] - rng["lo"]) * uniform(seed, "layer-snr", key, "layer"))
    return drawn.select(key, "layer", F.col(klass).alias("layer_class"), F.col(clip).alias("layer_clip"), "snr")


def draw_layers(samples: DataFrame, key: str, n_layers: Column, snr: Column, clips: DataFrame, klass: str,
                clip: str, seed: int, cols: list[str], most: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """One array of drawn layers per sample. A sample has as many layers as its recipe (at most
    two), so the arrays are short; samples without layers get NULL.

    Where ``most``, the layers of any sample, is given and the bank was measured to be small, every sample draws in its own row and
    none moves; a sample of more layers is an error. Else layers are joined to their clips and gathered again.
    """
    bank = None if most is None else clip_lists(clips, klass, clip, seed, max_bytes)
    if bank is None:
        packed = layer_rows(samples, key, n_layers, snr, clips, klass, clip, seed).groupBy(key).agg(F.sort_array(
            F.collect_list(F.struct("layer", "layer_class", "layer_clip", "snr"))).alias("layers"))
        return samples.select(key, *cols).join(packed, key, "left")
    rows = samples.select(key, *cols, n_layers.cast("int").alias("_n"), snr.alias("_snr"))
    rows = rows.withColumns({f"_class{i}": F.when(F.col("_n") > i, F.floor(uniform(seed, "layer-class", key, F.lit(i)) * F.size(bank)).cast("int")) for i in range(most)})

    def drawn(i: int) -> Column:
        spot, rng = F.get(bank, F.col(f"_class{i}")), F.get("_snr", F.lit(i))
        number = F.floor(uniform(seed, "layer-clip", key, F.lit(i)) * F.size(spot["clips"])).cast("int")
        level = rng["lo"] + (rng["hi"] - rng["lo"]) * uniform(seed, "layer-snr", key, F.lit(i))
        return F.when(F.col("_n") > i, F.struct(F.lit(i).alias("layer"), spot["c"].alias("layer_class"), F.get(spot["clips"], number).alias("layer_clip"), level.alias("snr")))
    more = F.raise_error(F.concat(F.lit(f"a sample has more than {most} layers: "), F.col("_n").cast("string")))
    layers = F.when(F.col("_n") > most, more).when((F.col("_n") > 0) & (F.size(bank) > 0), F.slice(F.array(*[drawn(i) for i in range(most)]), F.lit(1), F.col("_n")))
    return rows.select(key, *cols, layers.alias("layers"))


def cyclic(samples: DataFrame, index: str, bases: DataFrame, base_key: str, start: int = 0) -> DataFrame:
    """Sample i gets base (start + i) mod n: an equi-join on a number that is unique per base.

    Few bases mean few join keys, so the base table is broadcast when it is small.
    """
    n = bases.agg(F.count(F.lit(1))).scalar()
    numbered = checked_broadcast(hash_ordinal(bases, [], [base_key], 0, "cycle", "_i"))
    return samples.withColumn("_i", F.pmod(F.lit(start) + F.col(index), n)).join(numbered, "_i").drop("_i")


def held_out(pool: DataFrame, evaluation: DataFrame, content: str) -> tuple[DataFrame, DataFrame]:
    """(clean pool, leaked rows): pool rows whose content hash is (not) in the evaluation set.

    The evaluation side is reduced to distinct hashes first, so copies cannot multiply rows.
    """
    p = pool.withColumn("content_hash", F.sha2(F.col(content), 256))
    e = evaluation.select(F.sha2(F.col(content), 256).alias("content_hash")).distinct()
    return p.join(e, "content_hash", "left_anti"), p.join(e, "content_hash", "left_semi")


def held_out_passages(pool: DataFrame, evaluation: DataFrame, key: str, text: str, n: int) -> tuple[DataFrame, DataFrame]:
    """(clean pool, leaked rows): pool rows that hold no, or some, ``n`` words in a row of an evaluation text.

    Both sides are reduced to distinct hashes of word runs; only the hashes move.
    """
    def runs(df: DataFrame, *keep: str) -> DataFrame:
        words = df.select(*keep, F.regexp_extract_all(F.lower(text), F.lit(r"([^\s]+)"), F.lit(1)).alias("_w"))
        hashed = F.transform("_w", lambda w, i: F.xxhash64(w, *(F.get("_w", i + k) for k in range(1, n))))
        return words.select(*keep, F.explode(F.array_distinct(F.slice(hashed, F.lit(1), F.greatest(F.size("_w") - F.lit(n - 1), F.lit(0))))).alias("_h"))
    hit = runs(pool, key).join(checked_broadcast(runs(evaluation).distinct()), "_h", "left_semi").select(key).distinct()
    return pool.join(hit, key, "left_anti"), pool.join(hit, key, "left_semi")


def first_in_interval(trials: DataFrame, detections: DataFrame, hop: int = 1600, slack: int = 3200) -> DataFrame:
    """Per trial the first trigger, and whether it fell at or before keyword end + ``slack``.

    Triggers are reduced to the first one per stream before the join, so both sides have one row
    per stream.
    """
    first = detections.groupBy("stream").agg((F.min("step") * hop).alias("first"))
    hit = F.col("first").isNotNull() & (F.col("first") <= F.col("kw_end") + slack)
    return trials.join(first, "stream", "left").withColumn("hit", hit)


def preroll(detections: DataFrame, steps: DataFrame, lead: int, cols: list[str]) -> DataFrame:
    """The ``lead`` steps that end at each trigger (the trigger step is the last of them).

    The interval is unrolled on the trigger side, which turns a range join into an equi-join on
    (stream, step); that key is unique among the steps.
    """
    wanted = detections.select(
        "stream", F.col("step").alias("trigger"),
        F.explode(F.sequence(F.greatest(F.lit(0), F.col("step") - (lead - 1)), F.col("step"))).alias("step"))
    return wanted.join(steps.select("stream", "step", *cols), ["stream", "step"])
