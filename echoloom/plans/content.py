"""The corpus build by content: every content kind draws from its own weighted pool.

A sample's bucket names its content and its recipe. Words, filler and confusable words are clips of their pools with a speed
range each; real speech mixes long recordings and commands at a fixed rate; babble is the sum of two to eight talkers;
soundscapes are drawn by class first, so that large classes do not crowd out small ones. All of these are weights of
one alias table, and every clip that a sample needs (content, talkers, noise layers) is one row of a narrow table of draws.
Only ids move through the draws and the split; arrays are fetched once at the end and rendered in batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoloom import session
from echoloom.functions import batch as B
from echoloom.functions import draws as D
from echoloom.operators.alias import alias_draw, alias_table
from echoloom.plans import corpus as P
from echoloom.session import checked_broadcast, materialize, row_bytes

# Chance and range of the speed change by content; percent of commands in real speech and among talkers; talkers of
# a babble (from, below) and their gain range in dB; width range of a dropout burst as a part of the window; bit depths.
SPEED = {"word": (0.85, 0.80, 1.22), "filler": (0.80, 0.85, 1.20), "confus": (0.80, 0.85, 1.18)}
COMMAND_PERCENT = {"real": 30, "talker": 15}
TALKERS = (2, 9)
TALKER_GAIN = (-13.0, 3.0)
BURST = (0.02, 0.045)
BITS = [6, 8]
#: SNR recorded for a sample without noise layers
NO_LAYERS = 40.0
#: units shared by the clips of a soundscape class
CLASS_UNITS = 1 << 40

BASE, TALKER, LAYER = 0, 1, 2


def pools(clips: DataFrame, clip: str, klass: str, kind: Column) -> DataFrame:
    """(pool, item, klass, weight) of all pools. ``kind``: word, filler, confus, speech, command or noise (NULL: in no pool).

    An empty filler pool takes the confusable words, and the other way round. If there are only long recordings or only
    commands, these are all of the real speech.
    """
    own = clips.select(F.col(clip).alias("item"), F.col(klass).alias("klass"), kind.alias("kind"))
    n = {r["kind"]: r["n"] for r in own.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}      # at most seven rows
    even = F.lit(1).cast("long")
    kinds = {"word": {"word": even}, "filler": {"filler" if n.get("filler") else "confus": even}, "confus": {"confus" if n.get("confus") else "filler": even}}
    speech, command = n.get("speech", 0), n.get("command", 0)
    for pool, percent in COMMAND_PERCENT.items():
        kinds[pool] = {"speech": F.lit((100 - percent) * command if command else 1).cast("long"), "command": F.lit(percent * speech if speech else 1).cast("long")}
    out = None
    for pool, parts in kinds.items():
        for name, weight in parts.items():
            some = own.filter(F.col("kind") == name).select(F.lit(pool).alias("pool"), "item", "klass", weight.alias("weight"))
            out = some if out is None else out.unionByName(some)
    noise = own.filter("kind = 'noise'")
    sizes = checked_broadcast(noise.groupBy("klass").agg(F.count(F.lit(1)).alias("n")))
    noise = noise.join(sizes, "klass").select(F.lit("noise").alias("pool"), "item", "klass", F.expr(f"{CLASS_UNITS}L div n").alias("weight"))
    return out.unionByName(noise)


def pool_table(clips: DataFrame, clip: str, klass: str, kind: Column, seed: int) -> DataFrame:
    return alias_table(pools(clips, clip, klass, kind), "pool", "item", "weight", ["klass"], seed)


CONTROLS = ["speed", "offset", "beta", "bits", "clip_neg", "clip_pos", "level"]


def controls(p: DataFrame, key: str, window: int, seed: int) -> DataFrame:
    """Every choice of the signal chain as a column; NULL switches a step off. ``bursts``: array of (start, width)."""
    u = lambda salt, *more: D.uniform(seed, salt, key, *more)                        # noqa: E731
    speed = F
    for content, (chance, lo, hi) in SPEED.items():
        speed = speed.when(F.col("mix_content") == content, F.when(u("speed-on") < chance, D.in_range(u("speed"), lo, hi)).otherwise(F.lit(1.0)))
    clipped = u("clip") < 0.30
    count = F.when(F.col("dropout"), D.integer_in(u("bursts"), 1, F.lit(2) + F.floor(F.lit(2) * F.col("aggr")))).otherwise(F.lit(0)).cast("int")

    def burst(j: Column) -> Column:
        width = F.greatest(F.floor(D.in_range(u("burst-width", j), *BURST) * window), F.lit(1)).cast("int")
        return F.struct((F.floor(u("burst-start", j) * (F.lit(window) - width))).cast("int").alias("start"), width.alias("width"))

    bursts = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), burst)).otherwise(F.array().cast("array<struct<start:int,width:int>>"))
    return p.select("*", speed.alias("speed"), u("offset").alias("offset"), F.when(F.col("cadence"), D.in_range(u("beta"), -0.25, 0.25)).alias("beta"),
                    F.when(F.col("bitcrush"), D.choose(u("bits"), BITS)).alias("bits"), F.when(clipped, D.in_range(u("clip-neg"), 0.35, 1.0)).alias("clip_neg"),
                    F.when(clipped, D.in_range(u("clip-pos"), 0.35, 1.0)).alias("clip_pos"), bursts.alias("bursts"))


def _wanted(key: str, seed: int) -> Column:
    """The clips that a planned sample needs: array of (role, idx, pool, lo, hi), content before layers."""
    def ref(role: int, idx: Column, pool, lo: Column, hi: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), idx.cast("int").alias("idx"), F.lit(pool).alias("pool") if isinstance(pool, str) else pool.alias("pool"),
                        lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))

    none, zero = F.lit(None), F.lit(0)
    talkers = D.integer_in(D.uniform(seed, "talkers", key), *TALKERS).cast("int")
    babble = F.col("mix_content") == "babble"
    content = F.when(babble, F.transform(F.sequence(zero, talkers - 1), lambda i: ref(TALKER, i, "talker", F.lit(TALKER_GAIN[0]), F.lit(TALKER_GAIN[1])))).otherwise(
        F.array(ref(BASE, zero, F.col("mix_content"), none, none)))
    layers = F.transform("snr", lambda s, i: ref(LAYER, i, "noise", s["lo"], s["hi"]))
    return F.concat(content, layers)


def draw(planned: DataFrame, key: str, table: DataFrame, seed: int) -> DataFrame:
    """(key, role, idx, amount, place, item, klass): one row per clip that a sample needs.

    ``amount`` is a talker's gain or a layer's SNR in dB, ``place`` where a window is cut from a longer clip.
    """
    refs = planned.select(key, F.explode(_wanted(key, seed)).alias("r")).select(key, "r.*")
    refs = refs.withColumn("amount", F.col("lo") + (F.col("hi") - F.col("lo")) * D.uniform(seed, "amount", key, "role", "idx"))
    refs = refs.withColumn("place", D.uniform(seed, "place", key, "role", "idx")).drop("lo", "hi")
    return alias_draw(refs, "pool", [key, "role", "idx"], table, seed, "ref", "got").select(key, "role", "idx", "pool", "amount", "place", "got.item", "got.klass")


def planned(samples: DataFrame, key: str, window: int, seed: int) -> DataFrame:
    """Plan, split and controls of every sample: narrow rows, written once."""
    drawn = materialize(P.plan(samples, key, seed), "drawn")
    return materialize(controls(P.split(drawn, key), key, window, seed), "plan")


def labels(draws: DataFrame, key: str) -> DataFrame:
    """Per sample: classes of its layers in order (up to three of them) and its mean SNR."""
    layers = draws.filter(F.col("role") == LAYER).groupBy(key).agg(
        F.avg("amount").alias("snr"), F.sort_array(F.collect_list(F.struct("idx", F.col("klass").cast("string").alias("c")))).alias("cs"))     # at most two
    return layers.select(key, "snr", F.array_join(F.transform(F.slice("cs", 1, 3), lambda c: c["c"]), "|").alias("classes"))


KEPT = ["y", "bucket", "split", "group", "snr"]


def build(samples: DataFrame, key: str, clips: DataFrame, clip: str, klass: str, x: str, kind: Column, window: int, seed: int,
          features: bool = False, repeat: bool = False) -> DataFrame:
    """``samples`` (key, y) as finished signals ``x`` (or log-mel ``features``) with bucket, split, group, snr and level.

    ``repeat`` repeats word clips shorter than the window, as longer content is cut to it. Pools and clips are looked up in the batches,
    in memory or if they are many in files, so that samples do not move; only beyond that, or if ids repeat, draws and arrays are fetched with joins.
    """
    table = pool_table(clips, clip, klass, kind, seed)
    sound = clips.select(F.col(clip).alias("item"), F.col(x).alias("samples"))
    shared = draw_lookup(table, clips.select(F.col(klass).cast("string").alias("klass"), F.col(clip).alias("item"), F.col(x).alias("samples")))
    if shared is not None:
        j = drawn_rows(samples, key, window, seed)
        kept = [f for f in j.schema.fields if f.name in (key, "y", "bucket", "split")] + [T.StructField("group", T.StringType()), T.StructField("snr", T.DoubleType())]
        return P.rendered(j, kept, _render(window, repeat, _looked_up(shared)), window, features)
    plan = planned(samples, key, window, seed)
    draws = materialize(draw(plan, key, table, seed), "draws")
    refs = draws.join(sound, "item").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("role", "idx", "amount", "place", "samples"))).alias("refs"))
    named = plan.drop("snr", "layers").join(labels(draws, key), key, "left")
    group = F.concat_ws("|", F.when(F.col("y") == 1, "pos").otherwise("neg"), F.coalesce("classes", F.lit("direct")))
    j = named.withColumn("group", group).withColumn("snr", F.coalesce("snr", F.lit(NO_LAYERS))).withColumnRenamed("mix", "bucket")
    j = j.select(key, *KEPT, *CONTROLS, "bursts").join(refs, key, "left")
    kept = [f for f in j.schema.fields if f.name in (key, *KEPT)]
    return P.rendered(j, kept, _render(window, repeat), window, features)


def drawn_rows(samples: DataFrame, key: str, window: int, seed: int) -> DataFrame:
    """Plan, split, controls and ``refs`` (the clips it needs, with the numbers of their draws) of every sample, computed from its row alone."""
    p = controls(P.split(P.plan(P.dealt(samples, key, window), key, seed), key), key, window, seed)
    u = lambda salt, r: D.uniform(seed, salt, key, r["role"], r["idx"])              # noqa: E731
    ref = lambda r: F.struct(r["role"].alias("role"), r["idx"].alias("idx"), r["pool"].alias("pool"), (r["lo"] + (r["hi"] - r["lo"]) * u("amount", r)).alias("amount"),
                             u("place", r).alias("place"), u("ref-slot", r).alias("at"), u("ref-side", r).alias("side"))
    return p.select(key, "y", F.col("mix").alias("bucket"), "split", *CONTROLS, "bursts", F.transform(_wanted(key, seed), ref).alias("refs"))


def draw_lookup(table: DataFrame, sound: DataFrame):
    """Clips and slots to draw from in tasks, or None if there are none or too many for it.

    Arrays: flat, start and size of the signals, the class of each clip, and by slot ``share``, ``own`` and ``other`` clip. Beside
    them: (first slot, number of slots, total) of each pool, and the names of the classes.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    size = P.lookup_size(sound)
    pools = table.groupBy("pool").agg(F.first("n").alias("n"), F.first(F.col("total").cast("double")).alias("total")).collect()        # six pools
    if size is None or not pools:
        return None
    slots = table.select("pool", "slot", F.col("share").cast("double").alias("share"), F.col("own.item").alias("own"), F.col("other.item").alias("other"))
    slot_bytes = slots.agg(F.sum(row_bytes(slots))).first()[0]
    if slot_bytes > session.FILE_TIMES * session.LOOKUP_BYTES:
        return None
    filed, n = max(size["bytes"], slot_bytes) > session.LOOKUP_BYTES, sum(r["n"] for r in pools)
    of_class, names, items = session.lookup_array(size["n"], np.int32, filed), {}, []

    def numbered(t) -> np.ndarray:
        """Clips are numbered as they come."""
        at = np.arange(t.num_rows) + sum(map(len, items))
        klass = P.one_array(t.column("klass")).dictionary_encode(null_encoding="encode")
        of_class[at] = np.array([names.setdefault(k, len(names)) for k in klass.dictionary.to_pylist()])[klass.indices.to_numpy()]
        items.append(P.one_array(t.column("item")))
        return at

    signals = P.signal_arrays(sound, size, filed, numbered)
    share, own, other = (session.lookup_array(n, kind, filed) for kind in (float, np.int64, np.int64))
    first = dict(zip([r["pool"] for r in pools], np.cumsum([0, *(r["n"] for r in pools)]).tolist(), strict=False))
    known = pa.concat_arrays(items)
    for t in session.lookup_parts(slots, slot_bytes, "slot"):
        at = np.array([first[p] for p in t.column("pool").to_pylist()], np.int64) + t.column("slot").to_numpy()
        share[at] = t.column("share").to_numpy()
        for side, name in ((own, "own"), (other, "other")):
            side[at] = pc.fill_null(pc.index_in(t.column(name), value_set=known), -1).to_numpy()
    beside = {r["pool"]: (first[r["pool"]], r["n"], r["total"]) for r in pools}, np.array(list(names), object)
    return session.share(table.sparkSession, {**signals, "of_class": of_class, "share": share, "own": own, "other": other}, beside)


def _fetched(part) -> tuple:
    """Clips of a batch that carries them: (ends of the clips of each row, role, idx, amount, place, signals, which signal, more columns)."""
    refs = part.column(part.schema.get_field_index("refs"))
    inner = refs.values
    number = lambda name: np.asarray(inner.field(name).to_numpy(zero_copy_only=False), float)       # noqa: E731
    return refs.offsets.to_numpy().astype(np.int64), *map(number, ("role", "idx", "amount", "place")), B.Bank.of_lists(inner.field("samples")), np.arange(len(inner)), {}


def _looked_up(shared) -> Callable:
    """The same from the shared pools and signals, with the group and mean SNR of each row."""
    def read(part) -> tuple:
        import pyarrow as pa

        has, (pools, names) = shared.value
        bank = B.Bank(has["flat"], has["start"], has["size"])
        refs = part.column(part.schema.get_field_index("refs"))
        ends, inner = refs.offsets.to_numpy().astype(np.int64), refs.values
        number = lambda name: np.asarray(inner.field(name).to_numpy(zero_copy_only=False), float)       # noqa: E731
        role, idx, amount, place, at, side = map(number, ("role", "idx", "amount", "place", "at", "side"))
        pool = inner.field("pool").dictionary_encode()
        code = pool.indices.to_numpy(zero_copy_only=False)
        clip, klass, known = np.full(len(inner), -1, np.int64), np.full(len(inner), None, object), np.zeros(len(inner), bool)
        for i, name in enumerate(pool.dictionary.to_pylist()):
            some = np.flatnonzero(code == i)
            if name not in pools:
                continue
            first, n, total = pools[name]
            slot = first + np.floor(at[some] * n).astype(np.int64)
            clip[some] = np.where(side[some] * total < has["share"][slot], has["own"][slot], has["other"][slot])
            klass[some], known[some] = names[has["of_class"][clip[some]]], True
        layer = known & (role == LAYER)
        y, group, snr = P.column_of(part, "y"), [], []
        for i in range(part.num_rows):
            mine = [r for r in range(ends[i], ends[i + 1]) if layer[r]]
            classes = "|".join(klass[r] for r in mine[:3] if klass[r] is not None) if mine else "direct"
            group.append(("pos|" if y[i] == 1 else "neg|") + classes)
            snr.append(float(sum(amount[r] for r in mine) / len(mine)) if mine else NO_LAYERS)
        role[clip < 0] = -1                                                       # no signal to add
        return ends, role, idx, amount, place, bank, clip, {"group": pa.array(group, pa.string()), "snr": pa.array(snr, pa.float64())}
    return read


def _render(window: int, repeat: bool, read: Callable = _fetched) -> Callable:
    def make(part) -> tuple[np.ndarray, np.ndarray, dict]:
        col = lambda name: part.column(part.schema.get_field_index(name))       # noqa: E731
        c = {name: P.column_of(part, name) for name in CONTROLS}
        n = part.num_rows
        ends, role, idx, amount, place, bank, clip, more = read(part)
        which, row = np.arange(ends[0], ends[-1]), np.repeat(np.arange(n), np.diff(ends))
        x = np.zeros((n, window))
        base = role[which] == BASE
        timed = base & ~np.isnan(c["speed"][row])
        for some, cut in ((timed, False), (base & ~timed, True)):
            w, r = which[some], row[some]
            if len(w):
                x[r] = bank.sliced(clip[w], place[w], window) if cut else bank.fitted(clip[w], c["speed"][r], c["offset"][r], window, repeat)
        talk = which[role[which] == TALKER]
        if len(talk):
            r = row[role[which] == TALKER]
            mixed = B.guard(B.babble(bank.sliced(clip[talk], place[talk], window), amount[talk], r, n))
            x[np.unique(r)] = mixed[np.unique(r)]
        layer = role[which] == LAYER
        for i in range(int(np.max(idx[which][layer], initial=-1)) + 1):           # layers are added one after another
            some = layer & (idx[which] == i)
            w = which[some]
            B.add_layer(x, row[some], bank.sliced(clip[w], place[w], window), amount[w])
        bursts = col("bursts")
        at, b = bursts.offsets.to_numpy().astype(np.int64), bursts.values
        whole = lambda name: b.field(name).to_numpy(zero_copy_only=False).astype(np.int64)[at[0]:at[-1]]      # noqa: E731
        return *B.finish(x, c, (np.repeat(np.arange(n), np.diff(at)), whole("start"), whole("width"))), more
    return make
