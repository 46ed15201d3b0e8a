"""Sampling plans, quotas, splits and set operations with keyed draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echoloom.functions.draws import bernoulli, choose, in_range, uniform, weighted
from echoloom.operators.running import flag_lowest, hash_ordinal, listing_ordinal, take_random
from echoloom.plans import dims
from echoloom.session import LOOKUP_BYTES, checked_broadcast, materialize, row_bytes

__all__ = ["take_random"]


def draw_bucket(u: Column, positive: Column, pos: dict[str, float], neg: dict[str, float]) -> Column:
    return F.when(positive, weighted(u, pos)).otherwise(weighted(u, neg))


def clip_bank(clips: DataFrame, klass: str, clip: str, seed: int, exclude: list | None = None) -> tuple[DataFrame, DataFrame]:
    """(bank, classes): clips numbered within their class, and classes numbered with their size.

    Excluded classes are left out unless that would leave nothing.
    """
    pool = clips.select(klass, clip)
    if exclude:
        kept = ~F.col(klass).isin(exclude)
        any_left = pool.agg(F.max(kept)).scalar()
        pool = pool.filter(kept | ~any_left)
    sizes = pool.groupBy(klass).agg(F.count(F.lit(1)).alias("n_clips"))
    # one row per class
    classes = sizes.withColumn("class_idx", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(klass)) - 1)
    bank = hash_ordinal(pool, [klass], [clip], seed, "bank", "clip_idx")
    return bank, checked_broadcast(classes)


def draw_clips(samples: DataFrame, key: list, clips: DataFrame, klass: str, clip: str, seed: int,
               salt: str, exclude: list | None = None) -> DataFrame:
    """Adds a class drawn uniformly over the classes and a clip drawn uniformly within it.

    Two equi-joins: the class by its number, then the clip by (class, number). Both numbers are
    uniform draws and each (class, number) is one row, so no key is hot beyond the class itself.
    """
    bank, classes = clip_bank(clips, klass, clip, seed, exclude)
    n_classes = classes.agg(F.count(F.lit(1))).scalar()
    drawn = samples.withColumn("class_idx", F.floor(uniform(seed, f"{salt}-class", *key) * n_classes).cast("int"))
    with_class = drawn.join(classes, "class_idx").withColumn(
        "clip_idx", F.floor(uniform(seed, f"{salt}-clip", *key) * F.col("n_clips")).cast("bigint"))
    spot = F.struct(F.col(klass).alias("c"), F.col("clip_idx").alias("i"))          # also matches a NULL class
    numbered = bank.select(spot.alias("_spot"), clip)
    return with_class.withColumn("_spot", spot).join(numbered, "_spot").drop("_spot", "class_idx", "clip_idx", "n_clips")


def clip_lists(clips: DataFrame, klass: str, clip: str, seed: int, max_bytes: int | None = None) -> Column | None:
    """The bank as one value, array<struct<c, clips>> in the order of the classes' and clips' numbers, if it was measured and found small.

    A draw from it is two array accesses in the row itself, so nothing moves. Too large: None.
    """
    bank, _ = clip_bank(clips, klass, clip, seed)
    stored = materialize(bank, "bank")
    size = stored.agg(F.coalesce(F.sum(row_bytes(stored.select(clip))), F.lit(0))).first()[0]
    if size > (LOOKUP_BYTES if max_bytes is None else max_bytes):
        return None
    numbered = F.sort_array(F.collect_list(F.struct(F.col("clip_idx").alias("i"), F.col(clip).alias("clip"))))
    lists = stored.groupBy(F.col(klass).alias("c")).agg(numbered.getField("clip").alias("clips"))
    return lists.agg(F.sort_array(F.collect_list(F.struct("c", "clips")))).scalar()


def distinct_pair(df: DataFrame, key: list, n: Column, seed: int) -> DataFrame:
    """Two different indexes below ``n``: the second draw skips the first one."""
    a = F.floor(uniform(seed, "pair-a", *key) * n).cast("bigint")
    b = F.floor(uniform(seed, "pair-b", *key) * (n - 1)).cast("bigint")
    return df.withColumn("first", a).withColumn("second", F.when(b >= F.col("first"), b + 1).otherwise(b))


def biased_pool(u: Column, bias: float, n_b: Column) -> Column:
    return F.when((u < bias) & (n_b > 0), F.lit("B")).otherwise(F.lit("A"))


EFFECTS = ["cadence", "reverb", "distance", "telephonic", "dropout", "mems", "bitcrush"]


def effect_plan(df: DataFrame, key: list, aggressive: Column, profile: dict, seed: int) -> DataFrame:
    """One boolean per effect; probabilities are base + slope x aggressiveness."""
    p = {"cadence": 0.35 + F.lit(0.35) * aggressive, "reverb": F.lit(0.70), "distance": F.lit(0.62),
         "telephonic": F.lit(profile["telephonic"]) * aggressive,
         "dropout": F.lit(profile["dropout"][0]) + F.lit(profile["dropout"][1]) * aggressive,
         "mems": F.lit(profile["mems"]),
         "bitcrush": F.lit(profile["bitcrush"][0]) + F.lit(profile["bitcrush"][1]) * aggressive}
    return df.select("*", *[bernoulli(uniform(seed, e, *key), p[e]).alias(e) for e in EFFECTS])


def talker_conditions(df: DataFrame, key: list, seed: int) -> DataFrame:
    """Talker distance, sound pressure, SNR and level of the recording."""
    spl_of = F.create_map(*[F.lit(v) for kv in dims.DISTANCE_SPL.items() for v in kv])
    return (df.withColumn("distance", choose(uniform(seed, "distance", *key), list(dims.DISTANCE_SPL)))
            .withColumn("spl", F.element_at(spl_of, F.col("distance")) + in_range(uniform(seed, "effort", *key), *dims.EFFORT_DB))
            .withColumn("talker_snr", F.lit(dims.MIC_SNR) + F.col("spl") - F.lit(dims.REFERENCE_SPL))
            .withColumn("level", in_range(uniform(seed, "level", *key), *dims.LEVEL_DBFS)))


def quota_mix(df: DataFrame, key: list[str], parts: dict[str, float], rest: str, seed: int, salt: str) -> DataFrame:
    """``floor(share * n)`` rows per part in a keyed permutation, the remainder to ``rest``."""
    names = list(parts)
    def upto(i):
        def take(n):
            total = F.lit(0).cast("long")
            for name in names[: i + 1]:
                total = total + F.floor(n * F.lit(parts[name]))
            return total
        return take
    flagged = flag_lowest(df, [], key, {f"_q{i}": upto(i) for i in range(len(names))}, seed, salt)
    part = F.lit(rest)
    for i in reversed(range(len(names))):
        part = F.when(F.col(f"_q{i}"), F.lit(names[i])).otherwise(part)
    return flagged.withColumn("part", part).drop(*[f"_q{i}" for i in range(len(names))])


def partition_plan(df: DataFrame, chunks: int, seed: int) -> DataFrame:
    """Chunk sizes and their positive share for a corpus with the class counts of ``df``."""
    spark = df.sparkSession
    counts = df.agg(F.struct(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("total"))).scalar()
    plan = spark.range(chunks).withColumnRenamed("id", "chunk").withColumn("_c", counts)
    plan = plan.select("chunk", F.col("_c.pos").alias("pos"), F.col("_c.total").alias("total"))
    per = F.ceil(F.col("total") / F.lit(chunks))
    plan = plan.withColumn("start", F.col("chunk") * per).withColumn("take", F.least(per, F.col("total") - F.col("start")))
    share = F.bround(F.col("take") * F.col("pos") / F.col("total")).cast("long")
    return plan.filter("take > 0").select(
        "chunk", "start", share.alias("n_pos"), (F.col("take") - share).alias("n_neg"),
        (F.lit(seed) + F.col("chunk") * 7919).alias("seed"))


def even_stride(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Rows at positions floor(i * size / n) of the listing, i < n."""
    size = df.agg(F.count(F.lit(1))).scalar()
    placed = listing_ordinal(df, order, "_pos").withColumn("_size", size)
    i = F.ceil(F.col("_pos") * F.lit(n) / F.col("_size"))
    keep = (F.col("_size") <= n) | ((i < n) & (F.floor(i * F.col("_size") / F.lit(n)) == F.col("_pos")))
    return placed.filter(keep).drop("_pos", "_size")


def every_nth(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Every max(1, size // n)-th row of the listing, at most ``n`` of them."""
    size = df.agg(F.count(F.lit(1))).scalar()
    placed = listing_ordinal(df, order, "_pos").withColumn("_step", F.greatest(F.lit(1), F.floor(size / F.lit(n))))
    return placed.filter((F.col("_pos") % F.col("_step") == 0) & (F.col("_pos") / F.col("_step") < n)).drop("_pos", "_step")


def cap_per_group(df: DataFrame, group: str, order: list, cap: int) -> DataFrame:
    """First ``cap`` rows of each group. The filter on the rank lets Spark cut every partition to
    ``cap`` rows per group before the shuffle, so a hot group is small by then."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= cap).drop("_rn")


def stratified_split(df: DataFrame, strata: list[str], key: list[str], val_frac: float = 0.2, seed: int = 7) -> DataFrame:
    """``split`` = val for max(1, half-even round(n * val_frac)) rows of every stratum."""
    takes = {"_v": lambda n: F.greatest(F.lit(1), F.bround(n * F.lit(val_frac)))}
    flagged = flag_lowest(df, strata, key, takes, seed, "stratified")
    return flagged.withColumn("split", F.when(F.col("_v"), "val").otherwise("train")).drop("_v")


def shuffled_split(df: DataFrame, key: list[str], train_frac: float = 0.8, seed: int = 7) -> DataFrame:
    takes = {"_v": lambda n: F.floor(n * F.lit(train_frac))}
    flagged = flag_lowest(df, [], key, takes, seed, "split")
    return flagged.withColumn("split", F.when(F.col("_v"), "train").otherwise("val")).drop("_v")


def head_val(df: DataFrame, key: list[str], minimum: int = 600, divisor: int = 20, seed: int = 7) -> DataFrame:
    """The first max(minimum, n // divisor) rows of the permutation validate."""
    takes = {"_v": lambda n: F.greatest(F.lit(minimum), F.floor(n / F.lit(divisor)))}
    flagged = flag_lowest(df, [], key, takes, seed, "head")
    return flagged.withColumn("split", F.when(F.col("_v"), "val").otherwise("train")).drop("_v")


def first_occurrence(df: DataFrame, content: Column, order: str) -> DataFrame:
    """(content hash, first key, copies): partial aggregation collapses copies before the shuffle."""
    return df.groupBy(F.sha2(content, 256).alias("content_hash")).agg(
        F.min(order).alias("first_key"), F.count(F.lit(1)).alias("copies"))


def union_with_provenance(parts: list[tuple[DataFrame, str | None]]) -> DataFrame:
    """Union by name; a part with a tag gets it as its bucket wherever the bucket is missing."""
    out = None
    for df, tag in parts:
        if tag is not None:
            base = F.col("bucket") if "bucket" in df.columns else F.lit(None).cast("string")
            df = df.withColumn("bucket", F.coalesce(base, F.lit(tag)))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
