"""Negatives from words that sound like the keyword: word x voice x variant, each with its own effects.

A spoken word is a clip drawn by word and voice. Every variant is placed in the window, perhaps warped, perhaps mixed with two
different noises that are both scaled against the clean word, and perhaps crushed to a few bits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoloom.functions import batch as B
from echoloom.functions import draws as D
from echoloom.operators.running import hash_ordinal
from echoloom.operators.sampling import distinct_pair
from echoloom.plans import corpus as P
from echoloom.session import checked_broadcast, materialize

# Variants of a spoken word; chances of warp, noise pair and bit crush; SNR ranges of the two noises; bit depths.
VARIANTS = 3
WARP, PAIR, CRUSH = 0.60, 0.85, 0.35
SNR = ((6.0, 20.0), (-3.0, 14.0))
BITS = [6, 8]
TAG = "MINE_confusable"
KEYS = ["word", "voice", "variant"]
NUMBERS = ["offset", "beta", "bits", "snr1", "snr2"]


def plan(words: DataFrame, voices: int, n_bases, n_noises, seed: int) -> DataFrame:
    """One row per word, voice and variant with every draw as a column; NULL switches an effect off.

    ``first`` and ``second`` are different numbers of noises, ``base`` is the number of the spoken word. With fewer than two noises no
    pair is mixed.
    """
    u = lambda salt, *keys: D.uniform(seed, salt, *(keys or KEYS))                     # noqa: E731
    rows = words.select("word", F.explode(F.sequence(F.lit(0), F.lit(voices - 1))).alias("voice")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))).alias("variant"))
    rows = rows.withColumn("n_noises", n_noises).withColumn("base", F.floor(u("base", "word", "voice") * n_bases).cast("long"))
    rows = distinct_pair(rows, KEYS, F.col("n_noises"), seed)
    paired = (u("pair") < PAIR) & (F.col("n_noises") >= 2)
    rows = rows.withColumns({c: F.when(paired, F.col(c)) for c in ("first", "second")})
    return rows.withColumns({
        "offset": u("offset"), "beta": F.when(u("warp") < WARP, D.in_range(u("beta"), -0.25, 0.25)),
        "bits": F.when(u("crush") < CRUSH, D.choose(u("bits"), BITS)),
        "snr1": F.when(paired, D.in_range(u("snr1"), *SNR[0])), "snr2": F.when(paired, D.in_range(u("snr2"), *SNR[1]))}).drop("n_noises")


def negatives(words: DataFrame, voices: int, bases: DataFrame, noises: DataFrame, clip: str, x: str, window: int, seed: int) -> DataFrame:
    """Signals of all variants with label 0: key columns, ``y``, ``bucket``, ``lvl`` and ``x``. Only numbers are drawn and joined
    before the arrays are fetched, each by one equi-join on a number that is unique per clip."""
    spoken = hash_ordinal(bases.select(clip), [], [clip], seed, "spoken", "i").join(bases.select(clip, F.col(x).alias("s")), clip).select("i", "s")
    noise = hash_ordinal(noises.select(clip), [], [clip], seed, "noises", "i").join(noises.select(clip, F.col(x).alias("s")), clip).select("i", "s")
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()                                 # noqa: E731
    rows = materialize(plan(words, voices, count(bases), count(noises), seed), "confusable")
    noise, spoken = checked_broadcast(noise), checked_broadcast(spoken)
    named = lambda bank, number, out: bank.select(F.col("i").alias(number), F.col("s").alias(out))       # noqa: E731
    j = rows.join(named(spoken, "base", "x0"), "base").join(named(noise, "first", "x1"), "first", "left").join(named(noise, "second", "x2"), "second", "left")
    j = j.select(*KEYS, F.lit(0).alias("y"), F.lit(TAG).alias("bucket"), *NUMBERS, "x0", *(F.coalesce(c, F.array().cast("array<double>")).alias(c) for c in ("x1", "x2")))
    kept = [f for f in j.schema.fields if f.name in (*KEYS, "y", "bucket")]

    def make(part) -> tuple[np.ndarray, np.ndarray, dict]:
        c = {name: P.column_of(part, name) for name in NUMBERS}
        bank = lambda name: B.Bank.of_lists(part.column(part.schema.get_field_index(name)))           # noqa: E731
        every, spoken = np.arange(part.num_rows), bank("x0")
        room = np.maximum(window - spoken.size, 0)
        t = np.arange(window)[None, :] - np.floor(c["offset"] * (room + 1)).astype(np.int64)[:, None]
        out = np.where((t >= 0) & (t < spoken.size[:, None]), spoken.read(every, t), 0.0)            # a longer word is cut at its end
        some = np.flatnonzero(~np.isnan(c["beta"]))
        out[some] = B.cadence(out[some], c["beta"][some])
        some = np.flatnonzero(~np.isnan(c["snr1"]))
        if len(some):
            first, second = (b.read(some, np.arange(window)[None, :]) * (np.arange(window)[None, :] < b.size[some][:, None]) for b in (bank("x1"), bank("x2")))
            out[some] = B.mix_dual(out[some], first, second, c["snr1"][some], c["snr2"][some])
        some = np.flatnonzero(~np.isnan(c["bits"]))
        out[some] = B.quantise(out[some], c["bits"][some])
        return out, B.dbfs(out), {}
    return P.rendered(j, kept, make, window, features=False)
