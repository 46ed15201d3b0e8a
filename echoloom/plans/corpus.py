"""The corpus build: plan, draws, mixing, features, split, sink."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoloom import session
from echoloom.functions import batch as B
from echoloom.functions import draws as D
from echoloom.functions.features import to_features
from echoloom.operators import sampling as S
from echoloom.operators.joins import layer_rows, with_mixture
from echoloom.plans import dims
from echoloom.session import materialize, row_bytes


def plan(samples: DataFrame, key: str, seed: int) -> DataFrame:
    """Bucket, recipe, aggressiveness, effects and talker conditions per sample.

    ``samples``: key and y. Nothing is read from the clips yet, so a plan can be inspected and
    repeated; all draws hang on the key.
    """
    mix = S.draw_bucket(D.uniform(seed, "mix", key), F.col("y") == 1, dims.shares(True), dims.shares(False))
    p = with_mixture(samples.select(key, "y").withColumn("mix", mix))
    p = p.withColumn("aggr", F.col("aggr_lo") + (F.col("aggr_hi") - F.col("aggr_lo")) * D.uniform(seed, "aggr", key))
    p = S.effect_plan(p, [key], F.col("aggr"), dims.PROFILES["v4"], seed)
    return S.talker_conditions(p, [key], seed)


CONTROLS = ["speed", "offset", "beta", "burst", "bits", "clip_neg", "clip_pos", "level"]


def controls(p: DataFrame, key: str, window: int, seed: int) -> DataFrame:
    """Every random choice of the signal chain as a column; NULL switches a step off."""
    u = lambda salt: D.uniform(seed, salt, key)                        # noqa: E731
    clipped = u("clip") < 0.30
    run = _burst_width(window)
    return p.select(
        "*", F.when((F.col("mix_content") == "word") & (u("speed-on") < 0.85), D.in_range(u("speed"), 0.80, 1.22))
        .otherwise(F.lit(1.0)).alias("speed"),
        u("offset").alias("offset"), F.when(F.col("cadence"), D.in_range(u("beta"), -0.25, 0.25)).alias("beta"),
        F.when(F.col("dropout"), D.integer_in(u("burst"), 0, max(1, window - run))).alias("burst"),
        F.when(F.col("bitcrush"), F.lit(8)).alias("bits"),
        F.when(clipped, D.in_range(u("clip-neg"), 0.35, 1.0)).alias("clip_neg"),
        F.when(clipped, D.in_range(u("clip-pos"), 0.35, 1.0)).alias("clip_pos"))


def _burst_width(window: int) -> int:
    return max(1, int(0.03 * window))


def gather(samples: DataFrame, key: str, clips: DataFrame, klass: str, clip: str, x: str, window: int, seed: int) -> DataFrame:
    """Plan, split, controls, content clip (``base``) and noise layers (``stack``) per sample.

    The plan is written once (narrow rows), because three branches read it. Content and noise
    clips are drawn by number and fetched with equi-joins on the clip id.
    """
    drawn = materialize(plan(samples, key, seed), "drawn")                     # the cuts of the split read it too
    p = materialize(controls(split(drawn, key), key, window, seed), "plan")
    sound = clips.select(clip, x)
    noise = (layer_rows(p, key, F.col("layers"), F.col("snr"), clips, klass, clip, seed)
             .join(sound.select(F.col(clip).alias("layer_clip"), F.col(x).alias("samples")), "layer_clip"))
    stack = noise.groupBy(key).agg(F.sort_array(F.collect_list(
        F.struct("layer", "samples", "snr", F.col("layer_class").cast("string").alias("layer_class")))).alias("stack"))
    drawn = S.draw_clips(p.drop("layers", "snr"), [key], clips, klass, clip, seed, "content").drop(klass)
    j = drawn.join(sound.withColumnRenamed(x, "base"), clip).join(stack, key, "left")
    j = j.withColumn("stack", F.coalesce("stack", F.array().cast(stack.schema["stack"].dataType)))
    return j.select(key, "y", F.col("mix").alias("bucket"), "split", _group(F.col("y"), F.col("stack")).alias("group"),
                    _snr(F.col("stack")).alias("snr"), *CONTROLS, "base", "stack")


KEPT = ["y", "bucket", "split", "group", "snr"]


def build(samples: DataFrame, key: str, clips: DataFrame, klass: str, clip: str, x: str, window: int, seed: int) -> DataFrame:
    """One finished signal ``x`` per planned sample."""
    return build_features(samples, key, clips, klass, clip, x, window, seed, features=False)


def build_features(samples: DataFrame, key: str, clips: DataFrame, klass: str, clip: str, x: str, window: int, seed: int,
                   features: bool = True, repeat: bool = False) -> DataFrame:
    """The planned samples rendered in Arrow batches, as log-mel features (or signals).

    ``repeat`` repeats clips shorter than the window when they are rendered, so that joins and batches carry
    the stored form. Rendering and features share one pass through Python. Clips are looked up in the batches, in memory or if they
    are many in files, so that samples do not move; only beyond that, or if ids repeat, their arrays are fetched with joins.
    """
    shared = clip_lookup(clips, klass, clip, x, seed)
    if shared is not None:
        j = drawn_rows(samples, key, window, seed)
        kept = [f for f in j.schema.fields if f.name in (key, "y", "bucket", "split")]
        kept += [T.StructField("group", T.StringType()), T.StructField("snr", T.DoubleType())]
        return rendered(j, kept, _rows_of(window, repeat, _looked_up(shared)), window, features)
    j = gather(samples, key, clips, klass, clip, x, window, seed)
    j = j.select(key, *KEPT, *CONTROLS, "base", F.transform("stack", lambda v: v["samples"]).alias("noises"), F.transform("stack", lambda v: v["snr"]).alias("snrs"))
    kept = [f for f in j.schema.fields if f.name in (key, *KEPT)]
    return rendered(j, kept, _rows_of(window, repeat), window, features)


def clip_lookup(clips: DataFrame, klass: str, clip: str, x: str, seed: int):
    """The clips, in the order of ``clip_bank``, to be read in tasks: (flat, start, size of the signals), (class names, first place and size
    of each class). None if they are too large for it."""
    sound = clips.select(F.col(klass).alias("klass"), F.col(clip).alias("item"), F.col(x).alias("samples"))
    size = lookup_size(sound)
    if size is None:
        return None
    bank, classes = S.clip_bank(sound.select("klass", "item"), "klass", "item", seed)
    placed = bank.join(classes.select(F.col("klass").alias("k2"), "class_idx"), F.col("klass").eqNullSafe(F.col("k2"))).drop("k2")
    listed = classes.orderBy("class_idx").select(F.col("klass").cast("string").alias("klass"), "n_clips").toArrow()
    n = listed.column("n_clips").to_numpy()
    first = np.cumsum(n) - n
    rows = placed.join(sound.select("item", "samples"), "item").select("item", "class_idx", "clip_idx", "samples")
    signals = signal_arrays(rows, size, size["bytes"] > session.LOOKUP_BYTES, lambda t: first[t.column("class_idx").to_numpy()] + t.column("clip_idx").to_numpy())
    return session.share(clips.sparkSession, signals, (np.array(listed.column("klass").to_pylist(), object), first, n))


def lookup_size(sound: DataFrame):
    """Bytes, number and samples of the clips ``sound`` (item, samples, ...) if they may be looked up in tasks and each has an id of its own, else None."""
    samples = F.greatest(F.coalesce(F.size("samples"), F.lit(0)), F.lit(0)).cast("long")
    size = sound.agg(F.sum(row_bytes(sound)).alias("bytes"), F.count(F.lit(1)).alias("n"), F.count_distinct("item").alias("items"), F.sum(samples).alias("samples")).first()
    return size if size["n"] and size["n"] == size["items"] and size["bytes"] <= session.FILE_TIMES * session.LOOKUP_BYTES else None


def signal_arrays(sound: DataFrame, size, filed: bool, place: Callable) -> dict[str, np.ndarray]:
    """``flat``, ``start`` and ``size`` of the bank of all clips of ``sound``; ``place`` gives the numbers of the clips of an Arrow table, row by row."""
    flat, start, long = session.lookup_array(max(1, size["samples"]), float, filed), *(session.lookup_array(size["n"], np.int64, filed) for _ in range(2))
    upto = 0
    for t in session.lookup_parts(sound, size["bytes"], "item"):
        if not t.num_rows:
            continue
        some, at = B.Bank.of_lists(one_array(t.column("samples"))), place(t)
        lo, n = some.start[0], int(some.size.sum())
        flat[upto:upto + n], start[at], long[at] = some.flat[lo:lo + n], some.start - lo + upto, some.size
        upto += n
    return {"flat": flat, "start": start, "size": long}


def one_array(column):
    """A column of an Arrow table as one array."""
    import pyarrow as pa

    return pa.concat_arrays(column.chunks)


#: samples of long signals that one task renders
TASK_SAMPLES = 1 << 24


def dealt(samples: DataFrame, key: str, window: int) -> DataFrame:
    """Samples of long signals dealt out by key, a bounded number to a task: rendering follows the rows, and rows that are narrow are read in few splits."""
    if window < B.LONG:
        return samples
    cores = samples.sparkSession.sparkContext.defaultParallelism
    return samples.repartition(max(2 * cores, samples.count() * window // TASK_SAMPLES), key)


def drawn_rows(samples: DataFrame, key: str, window: int, seed: int) -> DataFrame:
    """Plan, split, controls and the numbers of the clip draws of every sample, computed from its row alone.

    The draws are those of ``gather``. Only the cuts of the split need a pass of their own.
    """
    p = controls(split(plan(dealt(samples, key, window), key, seed), key), key, window, seed)
    u = lambda salt, *more: D.uniform(seed, salt, key, *more)                        # noqa: E731
    rng = lambda i: F.get("snr", i)                                                  # noqa: E731
    layer = lambda i: F.struct(u("layer-class", i).alias("of_class"), u("layer-clip", i).alias("of_clip"),
                               (rng(i)["lo"] + (rng(i)["hi"] - rng(i)["lo"]) * u("layer-snr", i)).alias("snr"))
    stack = F.when(F.col("layers") > 0, F.transform(F.sequence(F.lit(0), (F.col("layers") - 1).cast("int")), layer))
    return p.select(key, "y", F.col("mix").alias("bucket"), "split", *CONTROLS, u("content-class").alias("of_class"), u("content-clip").alias("of_clip"), stack.alias("stack"))


def rendered(j: DataFrame, kept: list[T.StructField], make: Callable, window: int, features: bool) -> DataFrame:
    """``kept`` columns, ``lvl`` and the features (or signals) that ``make`` renders from Arrow batches of bounded size.

    A kept column that ``j`` does not have comes from ``make``.
    """
    import pyarrow as pa

    column = "features" if features else "x"
    schema = T.StructType(kept + [T.StructField("lvl", T.DoubleType()), T.StructField(column, T.ArrayType(T.FloatType() if features else T.DoubleType()))])
    names, size = [f.name for f in kept], max(16, BATCH_SAMPLES // window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, size):
                part = b if b.num_rows <= size else b.take(pa.array(np.arange(lo, min(lo + size, b.num_rows))))      # with its own clips only
                x, level, more = make(part)
                flat = to_features(x).astype(np.float32).reshape(len(x), -1) if features else x
                ends = pa.array(np.arange(len(x) + 1) * flat.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([*(more[c] if c in more else part.column(part.schema.get_field_index(c)) for c in names), pa.array(level),
                                                  pa.ListArray.from_arrays(ends, pa.array(flat.ravel()))], [f.name for f in schema.fields])
    return j.mapInArrow(run, schema)


def column_of(part, name: str) -> np.ndarray:
    """A numeric Arrow column as doubles, NaN where it is NULL."""
    return np.asarray(part.column(part.schema.get_field_index(name)).to_numpy(zero_copy_only=False), float)


def _fetched(part) -> tuple:
    """Signals of a batch that carries them: (base bank, base clips, layer bank, layer clips, SNR, ends of the layers of each row, more columns)."""
    base, stacks = (part.column(part.schema.get_field_index(n)) for n in ("base", "noises"))
    layers, snr = B.Bank.of_lists(stacks.values), np.asarray(part.column(part.schema.get_field_index("snrs")).values.to_numpy(zero_copy_only=False), float)
    return B.Bank.of_lists(base), np.arange(part.num_rows), layers, np.arange(len(layers.size)), snr, stacks.offsets.to_numpy().astype(np.int64), {}


def _looked_up(shared) -> Callable:
    """The same from the shared clips, with the group and mean SNR of each row."""
    def read(part) -> tuple:
        import pyarrow as pa

        signals, (names, first, size) = shared.value
        bank = B.Bank(**signals)

        def clips(of_class: np.ndarray, of_clip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            k = np.floor(of_class * len(size)).astype(np.int64)
            return k, first[k] + np.floor(of_clip * size[k]).astype(np.int64)

        stacks = part.column(part.schema.get_field_index("stack"))
        ends, inner = stacks.offsets.to_numpy().astype(np.int64), stacks.values
        number = lambda name: np.asarray(inner.field(name).to_numpy(zero_copy_only=False), float)       # noqa: E731
        (klass, layer), snr = clips(number("of_class"), number("of_clip")), number("snr")
        y = column_of(part, "y")
        group, mean = [], []
        for i in range(part.num_rows):
            a, b = ends[i], ends[i + 1]
            group.append("|".join(["pos" if y[i] == 1 else "neg", *(c for c in names[klass[a:min(b, a + 3)]] if c is not None)] if b > a else ["pos" if y[i] == 1 else "neg", "direct"]))
            mean.append(float(sum(snr[a:b]) / (b - a)) if b > a else None)
        more = {"group": pa.array(group, pa.string()), "snr": pa.array(mean, pa.float64())}
        return bank, clips(column_of(part, "of_class"), column_of(part, "of_clip"))[1], bank, layer, snr, ends, more
    return read


def _rows_of(window: int, repeat: bool, read: Callable = _fetched) -> Callable:
    width = _burst_width(window)

    def make(part) -> tuple[np.ndarray, np.ndarray, dict]:
        c = {name: column_of(part, name) for name in CONTROLS}
        every = np.arange(part.num_rows)
        bases, base, layers, layer, snr, ends, more = read(part)
        x = bases.fitted(base, c["speed"], c["offset"], window, repeat)
        for i in range(int(np.max(np.diff(ends), initial=0))):           # layers are added one after another
            rows = every[ends[:-1] + i < ends[1:]]
            B.add_layer(x, rows, layers.tiled(layer[ends[rows] + i], window), snr[ends[rows] + i])
        some = np.flatnonzero(~np.isnan(c["burst"]))
        return *B.finish(x, c, (some, c["burst"][some].astype(np.int64), np.full(len(some), width))), more
    return make


#: samples rendered at once
BATCH_SAMPLES = 1 << 21


def _group(y: Column, stack: Column) -> Column:
    classes = F.transform(stack, lambda v: v["layer_class"])
    named = F.when(F.size(classes) == 0, F.array(F.lit("direct"))).otherwise(classes)
    return F.concat_ws("|", F.when(y == 1, "pos").otherwise("neg"), F.slice(named, 1, 3))


def _snr(stack: Column) -> Column:
    return F.when(F.size(stack) > 0, F.aggregate(stack, F.lit(0.0), lambda a, v: a + v["snr"]) / F.size(stack))


def split(planned: DataFrame, key: str, seed: int = 7) -> DataFrame:
    """Train or val per planned sample, stratified by label and bucket."""
    return S.stratified_split(planned, ["y", "mix"], [key], 0.2, seed)
