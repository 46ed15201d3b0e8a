"""Signal operators on ``array<double>`` columns, built from native higher-order functions.

Lambdas are evaluated once per element, so anything that does not depend on the element (a
gain, a peak) is bound with :func:`let` first; otherwise it would be recomputed per sample.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LN10 = 2.302585092994046


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def total(x: Column, f: Callable[[Column], Column] = lambda v: v) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + f(v))


def zeros(n) -> Column:
    return F.array_repeat(F.lit(0.0), lit(n).cast("int"))


def at(x: Column, i: Column) -> Column:
    """0-based element access."""
    return F.get(x, i.cast("int"))


def window(x: Column, start, length) -> Column:
    """0-based slice."""
    return F.slice(x, (lit(start) + 1).cast("int"), lit(length).cast("int"))


def clip(v: Column, lo, hi) -> Column:
    return F.least(F.greatest(v, lit(lo)), lit(hi))


# ---- measures ---------------------------------------------------------------------------------

def power(x: Column) -> Column:
    return total(x, lambda v: v * v) / F.size(x)


def rms(x: Column) -> Column:
    return F.sqrt(power(x))


def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, F.abs))


def level_dbfs(x: Column) -> Column:
    return F.lit(20.0) * F.log10(rms(x) + F.lit(1e-9))


def spread(x: Column) -> Column:
    """Population standard deviation of the samples."""
    return let(total(x) / F.size(x),
               lambda m: F.sqrt(total(x, lambda v: (v - m) * (v - m)) / F.size(x)))


# ---- gain -------------------------------------------------------------------------------------

def gain(x: Column, g) -> Column:
    return let(lit(g), lambda k: F.transform(x, lambda v: v * k))


def peak_guard(x: Column, ceiling: float = 0.95) -> Column:
    return let(peak(x), lambda m: F.when(
        m > ceiling, F.transform(x, lambda v: v / m * F.lit(ceiling))).otherwise(x))


def peak_normalise(x: Column, target=0.89) -> Column:
    return let(peak(x), lambda m: F.when(
        m > 0, F.transform(x, lambda v: v / m * lit(target))).otherwise(x))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def weighted_sum(a: Column, b: Column, wa: float = 0.6, wb: float = 0.4) -> Column:
    return F.zip_with(a, b, lambda x, y: F.lit(wa) * x + F.lit(wb) * y)


# ---- mixing -----------------------------------------------------------------------------------

def noise_gain(signal: Column, noise: Column, snr_db, eps: float = 1e-9) -> Column:
    """Factor for ``noise`` so that the power ratio equals ``snr_db``."""
    return F.sqrt((power(signal) + F.lit(eps))
                  / (F.pow(F.lit(10.0), lit(snr_db) / 10.0) * (power(noise) + F.lit(eps))))


def mix_at_snr(signal: Column, noise: Column, snr_db) -> Column:
    return let(noise_gain(signal, noise, snr_db),
               lambda g: F.zip_with(signal, noise, lambda s, n: s + n * g))


def mix_layers(signal: Column, layers: Column) -> Column:
    """Fold layers ``array<struct<samples, snr>>`` one after another.

    Each SNR refers to the mixture so far, not to the clean signal. A silent layer is skipped.
    The result goes through the peak guard.
    """
    folded = F.aggregate(
        layers, signal,
        lambda acc, layer: F.when(
            (F.size(layer["samples"]) == 0) | (spread(layer["samples"]) < 1e-7), acc,
        ).otherwise(mix_at_snr(acc, layer["samples"], layer["snr"])))
    return let(folded, peak_guard)


def mix_dual(speech: Column, n1: Column, n2: Column, snr1, snr2) -> Column:
    """Both layers are scaled against the clean speech."""
    g1 = F.sqrt((power(speech) + 1e-8) / F.pow(F.lit(10.0), lit(snr1) / 10.0) / (power(n1) + 1e-8))
    g2 = F.sqrt((power(speech) + 1e-8) / F.pow(F.lit(10.0), lit(snr2) / 10.0) / (power(n2) + 1e-8))
    mixed = let(F.array(g1, g2), lambda g: F.zip_with(
        F.zip_with(speech, n1, lambda s, n: s + n * g[0]), n2, lambda s, n: s + n * g[1]))
    return let(mixed, peak_guard)


def place(segment: Column, start, n) -> Column:
    """``segment`` inside a zero array of length ``n`` beginning at ``start``."""
    seg = F.slice(segment, 1, lit(n).cast("int"))
    return F.concat(zeros(start), seg, zeros(F.greatest(F.lit(0), lit(n) - lit(start) - F.size(seg))))


def splice_over_bed(base: Column, bed: Column, start, snr_db, n: int, target: float = 0.35) -> Column:
    """Scale the *signal* above an untouched bed, then normalise the peak."""
    def build(seg):
        g = (rms(seg) + 1e-9) / (rms(bed) + 1e-12) * F.pow(F.lit(10.0), lit(snr_db) / 20.0)
        return let(g, lambda k: F.zip_with(bed, seg, lambda b, s: b + s * k))
    return let(let(place(base, start, n), build), lambda x: peak_normalise(x, target))


def splice_scaled_bed(base: Column, bed: Column, start, snr_db) -> Column:
    """Scale the *bed* below the signal, add the signal at ``start``, guard the peak."""
    mixed = let(noise_gain(base, bed, snr_db), lambda g: F.transform(
        bed, lambda b, i: b * g + F.coalesce(
            F.when(i >= lit(start), at(base, i - lit(start))), F.lit(0.0))))
    return let(mixed, peak_guard)


# ---- length and position ----------------------------------------------------------------------

def fit_to_window(x: Column, n: int, u: Column | None = None) -> Column:
    """Crop or zero-pad to ``n``; at the centre, or at the position drawn by ``u``."""
    m = F.size(x)
    def pos(room):
        return F.floor(room / 2) if u is None else F.floor(u * (room + 1))
    longer = let(pos(m - n).cast("int"), lambda st: window(x, st, n))
    left = pos(F.lit(n) - m).cast("int")
    shorter = let(left, lambda k: F.concat(zeros(k), x, zeros(F.lit(n) - m - k)))
    return F.when(m >= n, longer).otherwise(shorter)


def tile_to(x: Column, n) -> Column:
    reps = F.ceil(lit(n) / F.greatest(F.lit(1), F.size(x))).cast("int")
    return F.slice(F.flatten(F.array_repeat(x, reps)), 1, lit(n).cast("int"))


def random_slice(x: Column, n: int, u: Column) -> Column:
    return let(F.floor(u * (F.size(x) - n + 1)).cast("int"), lambda st: window(x, st, n))


def frames(x: Column, win: int, hop: int) -> Column:
    count = F.floor((F.size(x) - win) / hop) + 1
    return F.when(F.size(x) < win, F.array().cast("array<array<double>>")).otherwise(
        F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda t: window(x, t * hop, win)))


def trim_silence(x: Column, frame: int = 80, pad: int = 400, floor_db: float = -45.0) -> Column:
    """Cut leading and trailing frames at or below ``floor_db``; all-silent input is unchanged."""
    n_frames = F.greatest(F.lit(1), F.floor(F.size(x) / frame)).cast("int")
    voiced = F.filter(F.sequence(F.lit(0), n_frames - 1),
                      lambda t: level_dbfs(window(x, t * frame, frame)) > floor_db)
    def cut(v):
        st = F.greatest(F.lit(0), F.element_at(v, 1) * frame - pad)
        en = F.least(F.size(x), (F.element_at(v, -1) + 1) * frame + pad)
        return F.when(F.size(v) == 0, x).otherwise(window(x, st, en - st))
    return F.when(F.size(x) == 0, x).otherwise(let(voiced, cut))


def shift(x: Column, k: Column) -> Column:
    """Move right by ``k`` (left if negative) and fill with zeros."""
    n = F.size(x)
    return let(lit(k).cast("int"), lambda s: F.when(
        s >= 0, F.concat(zeros(F.least(s, n)), F.slice(x, F.lit(1), F.greatest(F.lit(0), n - s))),
    ).otherwise(F.concat(window(x, -s, F.greatest(F.lit(0), n + s)), zeros(F.least(-s, n)))))


def roll(x: Column, k) -> Column:
    n = F.size(x)
    return let(F.pmod(lit(k), n).cast("int"), lambda s: F.concat(window(x, n - s, s), window(x, 0, n - s)))


# ---- interpolation ----------------------------------------------------------------------------

def _read_at(x: Column, positions: Column) -> Column:
    """Linear interpolation of ``x`` at an array of 0-based positions; flat beyond the last sample.

    Positions are built as their own array, so that a position is computed once and then only read.
    """
    def body(last):
        def one(p):
            i = F.floor(p).cast("int")
            lo = F.get(x, i)
            return F.when(p >= last, F.element_at(x, -1)).otherwise(lo + (F.get(x, i + 1) - lo) * (p - i))
        return F.transform(positions, one)
    return let(F.size(x) - 1, body)


def resample(x: Column, n_out: Column) -> Column:
    """Linear interpolation on a grid that excludes the end point."""
    def grid(m):
        return let(F.size(x), lambda n: F.transform(
            F.sequence(F.lit(0), m - 1), lambda j: j.cast("double") * n / m))
    return let(lit(n_out).cast("int"), lambda m: _read_at(x, grid(m)))


def speed_perturb(x: Column, factor) -> Column:
    """Resample to n/factor, then pad or trim at the centre back to n."""
    n = F.size(x)
    def refit(y):
        m = F.size(y)
        left = F.floor((n - m) / 2).cast("int")
        cut = F.floor((m - n) / 2).cast("int")
        return F.when(m < n, F.concat(zeros(left), y, zeros(n - m - left))).otherwise(window(y, cut, n))
    return let(lit(factor), lambda f: F.when(F.abs(f - 1.0) < 0.02, x).otherwise(
        let(resample(x, F.rint(n / f)), refit)))


def cadence_warp(x: Column, beta) -> Column:
    """Samples sit at the warped times ``w(k) = t + beta t (1 - t)``, t = k / last, and are read at even times.

    The times rise for abs(beta) < 1, so the pair of samples around an even time is found by inverting
    the quadratic; rounding is put right by looking one step to either side.
    """
    def warped(b, last):
        def w(k):
            t = k.cast("double") / last
            return clip(t + b * t * (1.0 - t), 0.0, 1.0)

        def one(i):
            t = i.cast("double") / last
            root = F.when(F.abs(b) < 1e-9, t).otherwise((1.0 + b - F.sqrt((1.0 + b) * (1.0 + b) - 4.0 * b * t)) / (2.0 * b))
            near = F.least(F.greatest(F.floor(root * last).cast("int"), F.lit(0)), last - 1)
            k = F.greatest(F.least(near + F.when(w(near) > t, -1).when(w(near + 1) <= t, 1).otherwise(0), last - 1), F.lit(0))
            return let(k, lambda q: F.get(x, q) + (F.get(x, q + 1) - F.get(x, q)) / (w(q + 1) - w(q)) * (t - w(q)))
        return F.when(last < 1, x).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: F.when(i >= last, F.element_at(x, -1)).otherwise(one(i))))
    return let(lit(beta), lambda b: let(F.size(x) - 1, lambda last: warped(b, last)))


def downmix(channels: Column, mode: str = "mean") -> Column:
    """``array<array<double>>`` (one array per channel) to one channel."""
    if mode == "first":
        return F.element_at(channels, 1)
    folded = F.aggregate(channels, zeros(F.size(F.element_at(channels, 1))), add)
    return let(folded, lambda s: F.transform(s, lambda v: v / F.size(channels)))


def standardise(channels: Column, sr, target_sr: int = 16000) -> Column:
    """Downmix, resample, pad to half a second, normalise the peak to 0.89."""
    def pad(x):
        short = target_sr // 2
        return F.concat(x, zeros(F.greatest(F.lit(0), F.lit(short) - F.size(x))))
    mono = downmix(channels)
    fitted = let(mono, lambda m: F.when(
        (lit(sr) != target_sr) & (F.size(m) > 1),
        resample(m, F.rint(F.size(m) * F.lit(float(target_sr)) / lit(sr)))).otherwise(m))
    return let(let(fitted, pad), lambda x: peak_normalise(x, 0.89))


# ---- level and distortion ---------------------------------------------------------------------

def level_policy(x: Column, do_clip: Column, c_neg, c_pos, target_db) -> Column:
    """struct(samples, level): optional asymmetric clip, then scale to the target loudness."""
    clipped = F.when(do_clip, F.transform(x, lambda v: clip(v, -lit(c_neg), lit(c_pos)))).otherwise(x)
    def scale(a):
        quiet = F.struct(peak_guard(a).alias("samples"), F.lit(-60.0).alias("level"))
        loud = let(F.pow(F.lit(10.0), lit(target_db) / 20.0) / rms(a),
                   lambda g: F.transform(a, lambda v: v * g))
        guarded = let(loud, lambda b: let(peak(b), lambda m: F.when(
            m > 1.0, F.transform(b, lambda v: clip(v * (F.lit(0.99) / m), -1.0, 1.0))).otherwise(b)))
        return F.when(rms(a) < 1e-8, quiet).otherwise(
            let(guarded, lambda b: F.struct(b.alias("samples"), level_dbfs(b).alias("level"))))
    return let(clipped, scale)


def level_floor_lift(x: Column, target_db, floor_db: float = -70.0) -> Column:
    """struct(samples, level): lift a signal that fell below the floor back to the target."""
    def lift(lvl):
        g = F.pow(F.lit(10.0), (lit(target_db) - lvl) / 20.0)
        lifted = let(g, lambda k: F.transform(x, lambda v: clip(v * k, -1.0, 1.0)))
        return F.when(lvl < floor_db, let(lifted, lambda b: F.struct(
            b.alias("samples"), level_dbfs(b).alias("level")))).otherwise(
                F.struct(x.alias("samples"), lvl.alias("level")))
    return let(level_dbfs(x), lift)


def quantise(x: Column, bits: int) -> Column:
    q = 2.0 ** bits / 2.0 - 0.5
    return F.transform(x, lambda v: F.rint((clip(v, -1.0, 1.0) + 1.0) * F.lit(q)) / F.lit(q) - 1.0)


def burst_dropout(x: Column, starts: Column, width) -> Column:
    """Zero ``width`` samples from each start in ``starts`` (array of ints)."""
    return F.transform(x, lambda v, i: F.when(
        F.exists(starts, lambda s: (i >= s) & (i < s + lit(width))), F.lit(0.0)).otherwise(v))


# ---- feature matrices (array of rows) ---------------------------------------------------------

def matrix_min(m: Column) -> Column:
    return F.array_min(F.transform(m, F.array_min))


def spec_mask(m: Column, f0, fw, t0, tw, fill: str = "zero") -> Column:
    """Blank ``fw`` columns from ``f0`` and ``tw`` rows from ``t0``.

    ``fill='min'`` takes the minimum of the matrix, taken again between the two masks.
    """
    f0, fw, t0, tw = (lit(v) for v in (f0, fw, t0, tw))
    def pick(x):
        return matrix_min(x) if fill == "min" else F.lit(0.0)
    cols = let(pick(m), lambda z: F.transform(m, lambda row: F.transform(
        row, lambda v, j: F.when((j >= f0) & (j < f0 + fw), z).otherwise(v))))
    return let(cols, lambda x: let(pick(x), lambda z: F.transform(x, lambda row, t: F.when(
        (t >= t0) & (t < t0 + tw), F.transform(row, lambda v: z)).otherwise(row))))


def feature_gain(x: Column, offset, lo: float | None = None, hi: float | None = None) -> Column:
    def body(o):
        return F.transform(x, lambda v: clip(v + o, lo, hi) if lo is not None else v + o)
    return let(lit(offset), body)


def gain_offset(db) -> Column:
    """The feature offset that stands for a gain in dB (amplitude convention)."""
    return lit(db) / 20.0 * F.lit(LN10)


def gain_span(db: float) -> float:
    """Half the range of the level augmentation: the feature offset of ``db``, rounded up to a whole number."""
    return float(math.ceil(db / 20.0 * LN10))


def ema(x: Column, s: float) -> Column:
    """Running exponential mean, started at the first element."""
    return F.aggregate(
        F.slice(x, F.lit(2), F.greatest(F.lit(0), F.size(x) - 1)), F.slice(x, 1, 1),
        lambda acc, v: F.concat(acc, F.array(F.lit(1.0 - s) * F.element_at(acc, -1) + F.lit(s) * v)))


def pcen(x: Column, s: float = 0.025, alpha: float = 0.98, delta: float = 2.0, r: float = 0.5) -> Column:
    """Per-channel energy normalisation of one band's energy over time."""
    return F.zip_with(x, ema(x, s), lambda e, m: F.pow(
        e / F.pow(F.lit(1e-6) + m, F.lit(alpha)) + F.lit(delta), F.lit(r)) - F.lit(delta ** r))


def logistic(x: Column, weights: Column, bias: float = 0.0) -> Column:
    """Probability of a linear model with fixed coefficients."""
    dot = total(F.zip_with(x, weights, lambda a, b: a * b))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(dot + F.lit(bias))))
