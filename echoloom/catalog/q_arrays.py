"""A and W families over array-valued signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from echoloom.catalog.adapters import EM, r6, signals
from echoloom.catalog.registry import query
from echoloom.functions import arrays as A
from echoloom.functions import draws as D
from echoloom.operators import clipwindows as W

SEED = 23


def u(salt):
    return D.uniform(SEED, salt, "clip_id")


def us(salt):
    return D.uniform_sql(SEED, salt, "clip_id")


def pairs(spark, sf):
    """Every clip with its two successors as noise layers (equi-joins on the clip number)."""
    em = signals(spark, sf)
    n = em.agg(F.count(F.lit(1))).scalar()
    nxt = em.select(F.col("clip_id").alias("k"), F.col("x").alias("z"))
    return (em.withColumn("k", F.pmod(F.col("clip_id") + 1, n)).join(nxt, "k").drop("k")
            .withColumn("k", F.pmod(F.col("clip_id") + 2, n)).join(nxt.withColumnRenamed("z", "z2"), "k").drop("k"))


PR = """pr AS (SELECT a.clip_id, a.class, a.x, b.x AS z, c.x AS z2 FROM em a
  JOIN em b ON b.clip_id = (a.clip_id + 1) % (SELECT count(*) FROM em) JOIN em c ON c.clip_id = (a.clip_id + 2) % (SELECT count(*) FROM em))"""

# SQL fragments for list expressions
def tr(x, e, v="v"):
    return f"list_transform({x}, lambda {v}: {e})"


def pw(x):
    return f"(list_sum({tr(x, 'v * v')}) / len({x}))"


def pk(x):
    return f"list_max({tr(x, 'abs(v)')})"


def scale(x, e):
    """x times a scalar that is not re-evaluated per element."""
    return tr(x, f"v * {e}")


def zip2(a, b, e):
    return f"list_transform(list_zip({a}, {b}), lambda q: {e})"


def zer(n):
    return f"list_transform(range(({n})::BIGINT), lambda i: 0.0::DOUBLE)"


DIG = "len(y) AS n, round(list_sum(y), 6) AS total, round(list_sum(list_transform(y, lambda v, i: v * i)), 6) AS shape"


def digest(df, *extra):
    """Length, sum and position-weighted sum of the resulting signal ``y``."""
    weighted = F.aggregate(F.transform("y", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return df.select("clip_id", *extra, F.size("y").cast("bigint").alias("n"), r6(A.total(F.col("y"))).alias("total"), r6(weighted).alias("shape"))


def signal_query(name, y, steps, source="pairs", extra_sql="", extra=()):
    """Register ``y`` (a Column, or a function of the frame) against a chain of SQL selects.

    ``steps``: select lists that build ``y`` one after another over ``pr``.
    """
    sql = "SELECT * FROM pr"
    for s in steps:
        sql = f"SELECT *, {s} FROM ({sql})"

    @query(name, f"WITH {EM}, {PR} SELECT clip_id, {extra_sql}{DIG} FROM ({sql})")
    def run(spark, sf):
        df = pairs(spark, sf) if source == "pairs" else signals(spark, sf)
        return digest(df.withColumn("y", y()), *extra)
    return run


@query("a1_rms_power_peak", f"WITH {EM} SELECT clip_id, round(sqrt({pw('x')}), 6) AS rms, round({pw('x')}, 8) AS power, round({pk('x')}, 6) AS peak FROM em")
def a1(spark, sf):
    return signals(spark, sf).select("clip_id", r6(A.rms(F.col("x"))).alias("rms"), r6(A.power(F.col("x")), 8).alias("power"), r6(A.peak(F.col("x"))).alias("peak"))


@query("a2_level_dbfs", f"WITH {EM} SELECT clip_id, round(20 * log10(sqrt({pw('x')}) + 1e-9), 6) AS level FROM em")
def a2(spark, sf):
    return signals(spark, sf).select("clip_id", r6(A.level_dbfs(F.col("x"))).alias("level"))


em_q = dict(source="em")
signal_query("a3_peak_guard", lambda: A.peak_guard(A.gain(F.col("x"), 3.5)),
             [f"{scale('x', '3.5::DOUBLE')} AS b", f"{pk('b')} AS m", "CASE WHEN m > 0.95 THEN list_transform(b, lambda v: v / m * 0.95::DOUBLE) ELSE b END AS y"], **em_q)
signal_query("a4_peak_normalise", lambda: A.peak_normalise(F.col("x"), A.lit(0.3) + A.lit(0.55) * u("norm")),
             [f"{pk('x')} AS m, 0.3 + 0.55::DOUBLE * {us('norm')} AS t", "list_transform(x, lambda v: v / m * t) AS y"], **em_q)
MIX_G = "sqrt(({p} + 1e-9) / (pow(10.0, {snr} / 10.0) * ({q} + 1e-9)))"
signal_query("a5_mix_at_snr", lambda: A.mix_at_snr(F.col("x"), F.col("z"), D.in_range(u("snr"), 0.0, 20.0)),
             [f"0.0 + 20.0::DOUBLE * {us('snr')} AS snr", MIX_G.format(p=pw("x"), q=pw("z"), snr="snr") + " AS g", zip2("x", "z", "q[1] + q[2] * g") + " AS y"])
signal_query("a6_mix_layer_ladder",
             lambda: A.mix_layers(F.col("x"), F.array(F.struct(F.col("z").alias("samples"), F.lit(8.0).alias("snr")), F.struct(A.gain(F.col("z2"), 0.0).alias("samples"), F.lit(5.0).alias("snr")),
                                             F.struct(F.col("z2").alias("samples"), F.lit(-3.0).alias("snr")))),
             [MIX_G.format(p=pw("x"), q=pw("z"), snr="8.0") + " AS g1", zip2("x", "z", "q[1] + q[2] * g1") + " AS b",
              MIX_G.format(p=pw("b"), q=pw("z2"), snr="-3.0") + " AS g2", zip2("b", "z2", "q[1] + q[2] * g2") + " AS c", f"{pk('c')} AS m",
              "CASE WHEN m > 0.95 THEN list_transform(c, lambda v: v / m * 0.95::DOUBLE) ELSE c END AS y"])
signal_query("p5_silent_layer_skip", lambda: A.mix_layers(F.col("x"), F.array(F.struct(
                 F.when(F.col("class") % 2 == 0, F.transform(F.col("z"), lambda v: F.lit(0.25))).otherwise(F.col("z")).alias("samples"), F.lit(6.0).alias("snr")))),
             [MIX_G.format(p=pw("x"), q=pw("z"), snr="6.0") + " AS g", f"CASE WHEN class % 2 = 0 THEN x ELSE {zip2('x', 'z', 'q[1] + q[2] * g')} END AS c", f"{pk('c')} AS m",
              "CASE WHEN m > 0.95 THEN list_transform(c, lambda v: v / m * 0.95::DOUBLE) ELSE c END AS y"])
signal_query("a7_dual_independent_mix", lambda: A.mix_dual(F.col("x"), F.col("z"), F.col("z2"), 4.0, -2.0),
             [f"sqrt(({pw('x')} + 1e-8) / pow(10.0, 4.0 / 10.0) / ({pw('z')} + 1e-8)) AS g1, sqrt(({pw('x')} + 1e-8) / pow(10.0, -2.0 / 10.0) / ({pw('z2')} + 1e-8)) AS g2",
              "list_transform(list_zip(x, z, z2), lambda q: q[1] + q[2] * g1 + q[3] * g2) AS c", f"{pk('c')} AS m",
              "CASE WHEN m > 0.95 THEN list_transform(c, lambda v: v / m * 0.95::DOUBLE) ELSE c END AS y"])
signal_query("a8_signal_over_bed_splice", lambda: A.splice_over_bed(F.slice(F.col("z"), 1, 24), F.col("x"), D.integer_in(u("pos"), 0, 41).cast("int"), 6.0, 64),
             [f"CAST(floor({us('pos')} * 41) AS BIGINT) AS st", f"list_concat({zer('st')}, z[1:24], {zer('64 - 24 - st')}) AS seg",
              f"(sqrt({pw('seg')}) + 1e-9) / (sqrt({pw('x')}) + 1e-12) * pow(10.0, 6.0 / 20.0) AS g", zip2("x", "seg", "q[1] + q[2] * g") + " AS c", f"{pk('c')} AS m",
              "list_transform(c, lambda v: v / m * 0.35::DOUBLE) AS y"])
signal_query("a9_bed_scaled_splice", lambda: A.splice_scaled_bed(F.slice(F.col("z"), 1, 20), F.col("x"), D.integer_in(u("pos9"), 0, 45).cast("int"), 3.0),
             [f"CAST(floor({us('pos9')} * 45) AS BIGINT) AS st, z[1:20] AS kw", MIX_G.format(p=pw("kw"), q=pw("x"), snr="3.0") + " AS g",
              "list_transform(x, lambda v, i: v * g + CASE WHEN i - 1 >= st AND i - st <= 20 THEN kw[i - st] ELSE 0.0 END) AS c", f"{pk('c')} AS m",
              "CASE WHEN m > 0.95 THEN list_transform(c, lambda v: v / m * 0.95::DOUBLE) ELSE c END AS y"])
signal_query("a10_weighted_sum", lambda: A.weighted_sum(F.col("x"), F.col("z")), [zip2("x", "z", "0.6::DOUBLE * q[1] + 0.4::DOUBLE * q[2]") + " AS y"])
signal_query("a12_fit_crop_random", lambda: A.fit_to_window(F.col("x"), 40, u("crop")), [f"CAST(floor({us('crop')} * 25) AS BIGINT) AS st", "x[st + 1:st + 40] AS y"], **em_q)
signal_query("a12_fit_pad_random", lambda: A.fit_to_window(F.col("x"), 100, u("padr")), [f"CAST(floor({us('padr')} * 37) AS BIGINT) AS st", f"list_concat({zer('st')}, x, {zer('36 - st')}) AS y"], **em_q)
signal_query("a12_fit_centre", lambda: A.fit_to_window(F.when(F.col("class") < 5, F.col("x")).otherwise(F.slice(F.col("x"), 1, 31)), 48),
             [f"CASE WHEN class < 5 THEN x[9:56] ELSE list_concat({zer('8')}, x[1:31], {zer('9')}) END AS y"], **em_q)
signal_query("a13_loop_to_length", lambda: A.tile_to(F.col("x"), 150), ["list_concat(x, x, x)[1:150] AS y"], **em_q)
signal_query("a14_random_slice", lambda: A.random_slice(F.col("x"), 16, u("slice")), [f"CAST(floor({us('slice')} * 49) AS BIGINT) AS st", "x[st + 1:st + 16] AS y"], **em_q)
signal_query("a15_trim_silence", lambda: A.trim_silence(F.col("x"), 4, 2, -17.0),
             [f"list_filter(range(16), lambda t: 20 * log10(sqrt({pw('x[t * 4 + 1:t * 4 + 4]')}) + 1e-9) > -17.0) AS vo",
              "greatest(0, vo[1] * 4 - 2) AS st, least(64, (vo[-1] + 1) * 4 + 2) AS en", "CASE WHEN len(vo) = 0 THEN x ELSE x[st + 1:en] END AS y"], **em_q)
signal_query("a16_time_shift", lambda: A.shift(F.col("x"), D.integer_in(u("shift"), -9, 9)),
             [f"CAST(-9 + floor({us('shift')} * 18) AS BIGINT) AS k", f"CASE WHEN k >= 0 THEN list_concat({zer('greatest(k, 0)')}, x[1:64 - k]) ELSE list_concat(x[1 - k:64], {zer('greatest(-k, 0)')}) END AS y"], **em_q)
signal_query("a17_circular_roll", lambda: A.roll(F.col("x"), D.integer_in(u("roll"), -12, 13)),
             [f"(CAST(-12 + floor({us('roll')} * 25) AS BIGINT) + 64) % 64 AS k", "list_concat(x[64 - k + 1:64], x[1:64 - k]) AS y"], **em_q)
signal_query("a18_gain", lambda: A.gain(F.col("x"), D.in_range(u("gain"), 0.45, 1.6)), [f"0.45 + (1.6::DOUBLE - 0.45::DOUBLE) * {us('gain')} AS g", scale("x", "g") + " AS y"], **em_q)


@query("a19_clip_and_level_policy", f"""WITH {EM}, a AS (SELECT clip_id, x, {us('clip')} < 0.30 AS c, 0.05::DOUBLE + 0.20::DOUBLE * {us('c1')} AS c1, 0.05::DOUBLE + 0.20::DOUBLE * {us('c2')} AS c2,
  -30.0 + 36.0 * {us('lvl')} AS t FROM em),
b AS (SELECT *, CASE WHEN c THEN list_transform(x, lambda v: least(greatest(v, -c1), c2)) ELSE x END AS a FROM a),
d AS (SELECT *, pow(10.0, t / 20.0) / sqrt({pw('a')}) AS g FROM b), e AS (SELECT *, list_transform(a, lambda v: v * g) AS h FROM d), f AS (SELECT *, {pk('h')} AS m FROM e),
k AS (SELECT *, CASE WHEN m > 1 THEN list_transform(h, lambda v: least(greatest(v * (0.99::DOUBLE / m), -1.0), 1.0)) ELSE h END AS y FROM f)
SELECT clip_id, round(20 * log10(sqrt({pw('y')}) + 1e-9), 6) AS level, {DIG} FROM k""")
def a19(spark, sf):
    r = A.level_policy(F.col("x"), u("clip") < 0.30, A.lit(0.05) + A.lit(0.20) * u("c1"), A.lit(0.05) + A.lit(0.20) * u("c2"), D.in_range(u("lvl"), -30.0, 6.0))
    df = signals(spark, sf).withColumn("r", r)
    return digest(df.withColumn("y", F.col("r.samples")), r6("r.level").alias("level"))


@query("a20_level_floor_lift", f"""WITH {EM}, a AS (SELECT clip_id, list_transform(x, lambda v: v * CASE WHEN clip_id % 2 = 0 THEN 0.0005::DOUBLE ELSE 0.5::DOUBLE END) AS x FROM em),
b AS (SELECT *, 20 * log10(sqrt({pw('x')}) + 1e-9) AS l FROM a), c AS (SELECT *, pow(10.0, (-40.0 - l) / 20.0) AS g FROM b),
d AS (SELECT *, CASE WHEN l < -70 THEN list_transform(x, lambda v: least(greatest(v * g, -1.0), 1.0)) ELSE x END AS y FROM c)
SELECT clip_id, round(20 * log10(sqrt({pw('y')}) + 1e-9), 6) AS level, {DIG} FROM d""")
def a20(spark, sf):
    quiet = A.gain(F.col("x"), F.when(F.col("clip_id") % 2 == 0, 0.0005).otherwise(0.5))
    df = signals(spark, sf).withColumn("r", A.let(quiet, lambda q: A.level_floor_lift(q, -40.0)))
    return digest(df.withColumn("y", F.col("r.samples")), r6("r.level").alias("level"))


for _bits in (6, 8, 16, 24):
    _q = 2.0 ** _bits / 2.0 - 0.5
    signal_query(f"a21_quantise_{_bits}_bits", lambda b=_bits: A.quantise(F.col("x"), b),
                 [f"list_transform(x, lambda v: round_even((least(greatest(v, -1.0), 1.0) + 1.0) * {_q}::DOUBLE, 0) / {_q}::DOUBLE - 1.0) AS y"], **em_q)
signal_query("a22_burst_dropout", lambda: A.burst_dropout(F.col("x"), F.array(D.integer_in(u("b1"), 0, 58), D.integer_in(u("b2"), 0, 58)), 6),
             [f"CAST(floor({us('b1')} * 58) AS BIGINT) AS s1, CAST(floor({us('b2')} * 58) AS BIGINT) AS s2",
              "list_transform(x, lambda v, i: CASE WHEN (i - 1 >= s1 AND i - 1 < s1 + 6) OR (i - 1 >= s2 AND i - 1 < s2 + 6) THEN 0.0 ELSE v END) AS y"], **em_q)


def lerp(x, pos):
    return (f"(CASE WHEN {pos} >= len({x}) - 1 THEN {x}[-1] ELSE {x}[CAST(floor({pos}) AS BIGINT) + 1] + ({x}[CAST(floor({pos}) AS BIGINT) + 2] - {x}[CAST(floor({pos}) AS BIGINT) + 1])"
            f" * ({pos} - floor({pos})) END)")


def rs(x, m):
    p = f"(j * len({x}) / ({m}))"
    return f"list_transform(range(({m})::BIGINT), lambda j: {lerp(x, p)})"


signal_query("a23_linear_resample", lambda: A.resample(F.col("x"), F.when(F.col("class") < 5, 48).otherwise(100)), ["CASE WHEN class < 5 THEN 48 ELSE 100 END AS m", rs("x", "m") + " AS y"], **em_q)
signal_query("a24_speed_perturb", lambda: A.speed_perturb(F.col("x"), D.in_range(u("speed"), 0.80, 1.22)),
             [f"0.80::DOUBLE + (1.22::DOUBLE - 0.80::DOUBLE) * {us('speed')} AS f", "CAST(round_even(64 / f, 0) AS BIGINT) AS m", rs("x", "m") + " AS r",
              f"CASE WHEN abs(f - 1.0) < 0.02 THEN x WHEN m < 64 THEN list_concat({zer('greatest(0, (64 - m) // 2)')}, r, {zer('greatest(0, 64 - m - (64 - m) // 2)')}) ELSE r[(m - 64) // 2 + 1:(m - 64) // 2 + 64] END AS y"], **em_q)
_TW = "least(greatest(j / 63 + be * (j / 63) * (1.0 - j / 63), 0.0), 1.0)"
signal_query("a25_cadence_warp", lambda: A.cadence_warp(F.col("x"), D.in_range(u("beta"), -0.25, 0.25)),
             [f"-0.25 + 0.5::DOUBLE * {us('beta')} AS be", f"list_transform(range(64), lambda j: {_TW}) AS tw",
              "list_transform(range(64), lambda j: len(list_filter(tw, lambda w: w <= j / 63))) AS below",
              "list_transform(below, lambda k, i: CASE WHEN k >= 64 THEN x[64] ELSE x[k] + (x[k + 1] - x[k]) * ((i - 1) / 63 - tw[k]) / (tw[k + 1] - tw[k]) END) AS y"], **em_q)
signal_query("a26_downmix_mean", lambda: A.downmix(F.array(F.col("x"), F.col("z"), F.col("z2"))), ["list_transform(list_zip(x, z, z2), lambda q: (q[1] + q[2] + q[3]) / 3) AS y"])
signal_query("a26_downmix_first", lambda: A.downmix(F.array(F.col("x"), F.col("z")), "first"), ["x AS y"])
signal_query("a27_standardise_clip", lambda: A.standardise(F.array(F.col("x"), F.col("z")), F.when(F.col("class") < 5, 80).otherwise(320), 160),
             [zip2("x", "z", "(q[1] + q[2]) / 2") + " AS mo", f"CASE WHEN class < 5 THEN {rs('mo', '128')} ELSE {rs('mo', '32')} END AS r",
              f"list_concat(r, {zer('greatest(0, 80 - len(r))')}) AS b", f"{pk('b')} AS m", "list_transform(b, lambda v: v / m * 0.89::DOUBLE) AS y"])


def grid8(x):
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: A.window(x, t * 8, 8))


def _mask_sql(fill):
    z1 = "0.0" if fill == "zero" else "list_min(x)"
    z2 = "0.0" if fill == "zero" else "list_min(a)"
    return [f"CAST(floor({us('f0')} * 5) AS BIGINT) AS f0, CAST(floor({us('t0')} * 6) AS BIGINT) AS t0, {z1} AS z1",
            "list_transform(x, lambda v, i: CASE WHEN (i - 1) % 8 >= f0 AND (i - 1) % 8 < f0 + 3 THEN z1 ELSE v END) AS a", f"{z2} AS z3",
            "list_transform(a, lambda v, i: CASE WHEN (i - 1) // 8 >= t0 AND (i - 1) // 8 < t0 + 2 THEN z3 ELSE v END) AS y"]


for _fill in ("zero", "min"):
    signal_query(f"a28_spec_mask_{_fill}", lambda f=_fill: F.flatten(A.spec_mask(
        grid8(F.col("x")), D.integer_in(u("f0"), 0, 5), 3, D.integer_in(u("t0"), 0, 6), 2, f)), _mask_sql(_fill), **em_q)
signal_query("a29_feature_gain_offset", lambda: A.feature_gain(F.col("x"), D.in_range(u("fg"), -A.gain_span(12.0), A.gain_span(12.0))),
             [f"-2.0 + 4.0 * {us('fg')} AS o", "list_transform(x, lambda v: v + o) AS y"], **em_q)
signal_query("a29_level_stress_clip", lambda: A.feature_gain(A.gain(F.col("x"), 20.0), A.gain_offset(-24.0), -11.5129, 5.0),
             ["(-24.0::DOUBLE / 20.0 * 2.302585092994046::DOUBLE) AS o", "list_transform(x, lambda v: least(greatest(v * 20.0 + o, -11.5129::DOUBLE), 5.0)) AS y"], **em_q)


@query("a30_framing", f"WITH {EM}, f AS (SELECT clip_id, unnest(range(13)) AS frame, x FROM em) SELECT clip_id, frame, round(list_sum(x[frame * 4 + 1:frame * 4 + 16]), 6) AS total FROM f")
def a30(spark, sf):
    f = signals(spark, sf).select("clip_id", F.posexplode(A.frames(F.col("x"), 16, 4)).alias("frame", "w"))
    return f.select("clip_id", F.col("frame").cast("bigint").alias("frame"), r6(A.total(F.col("w"))).alias("total"))


@query("a32_pcen_one_band", f"""WITH {EM}, e AS (SELECT clip_id, list_transform(x, lambda v: v * v) AS e FROM em),
m AS (SELECT clip_id, e, list_transform(range(64), lambda t: pow(0.975::DOUBLE, t) * e[1] + CASE WHEN t = 0 THEN 0.0 ELSE
  list_sum(list_transform(range(1, t + 1), lambda i: 0.025::DOUBLE * pow(0.975::DOUBLE, t - i) * e[i + 1])) END) AS m FROM e),
p AS (SELECT clip_id, list_transform(list_zip(e, m), lambda q: pow(q[1] / pow(1e-6 + q[2], 0.98::DOUBLE) + 2.0, 0.5) - {2.0 ** 0.5!r}::DOUBLE) AS y FROM m)
SELECT clip_id, {DIG} FROM p""")
def a32(spark, sf):
    energy = F.transform(F.col("x"), lambda v: v * v)
    return digest(signals(spark, sf).withColumn("y", A.let(energy, A.pcen)))


MEL = dict(rate=16000, n_fft=126, bands=8, lo=100.0, hi=7500.0)
MEL_SQL = "fb(bin, band, weight) AS (VALUES " + ", ".join(f"({b}, {k}, {w!r}::DOUBLE)" for b, k, w in W.mel_triangles(**MEL)) + ")"


@query("a33_mel_filterbank_energy", f"""WITH {EM}, {MEL_SQL}, s AS (SELECT clip_id, unnest(range(64)) AS bin, unnest(list_transform(x, lambda v: v * v)) AS e FROM em)
SELECT clip_id, band, round(sum(e * weight), 6) AS energy FROM s JOIN fb USING (bin) GROUP BY ALL""")
def a33(spark, sf):
    power = signals(spark, sf).select("clip_id", F.posexplode(F.transform(F.col("x"), lambda v: v * v)).alias("bin", "e"))
    return W.mel_energy(power, ["clip_id"], W.mel_table(spark, **MEL)).select("clip_id", "band", r6("energy").alias("energy"))


BABBLE_SQL = f"""tk AS (SELECT b, talker, CAST(floor({D.uniform_sql(SEED, 'talker', 'b', 'talker')} * (SELECT count(*) FROM em)) AS BIGINT) AS i,
  pow(10.0, (-13.0 + 16.0 * {D.uniform_sql(SEED, 'talker-gain', 'b', 'talker')}) / 20.0) AS g FROM (SELECT b, unnest(range(k)) AS talker FROM sd)),
bk AS (SELECT clip_id, x, row_number() OVER (ORDER BY {D.digest_sql(SEED, 'talkers', 'clip_id')}, clip_id) - 1 AS i FROM em),
sm AS (SELECT b, pos, sum(v * g) AS v FROM (SELECT b, g, unnest(range(64)) AS pos, unnest(x) AS v FROM tk JOIN bk USING (i)) GROUP BY ALL),
ar AS (SELECT b, list(v ORDER BY pos) AS a FROM sm GROUP BY b), mx AS (SELECT b AS clip_id, list_transform(a, lambda v: v / list_max(list_transform(a, lambda w: abs(w)))) AS y FROM ar)"""


@query("a11_babble_live", f"WITH {EM}, sd AS (SELECT clip_id AS b, CAST(2 + floor({us('talkers')} * 7) AS BIGINT) AS k FROM em), {BABBLE_SQL} SELECT clip_id, {DIG} FROM mx")
def a11(spark, sf):
    em = signals(spark, sf)
    seeds = em.select(F.col("clip_id").alias("b"), D.integer_in(u("talkers"), 2, 9).alias("k"))
    return digest(W.babble(seeds, "b", "k", em, "clip_id", "x", SEED).select(F.col("b").alias("clip_id"), F.col("mix").alias("y")))


_CFG = ", ".join(f"({k}, '{n}')" for k, n in W.BABBLE_CONFIGS)


@query("a11_babble_bank", f"""WITH {EM}, cfg(k, name) AS (VALUES {_CFG}), sd AS (SELECT name || '_' || k || '_' || class AS b, k FROM cfg, (SELECT DISTINCT class FROM em)), {BABBLE_SQL}
SELECT clip_id, {DIG} FROM mx""")
def a11b(spark, sf):
    em = signals(spark, sf)
    cfg = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("name")) for k, n in W.BABBLE_CONFIGS]))
    seeds = em.select("class").distinct().select("class", cfg.alias("c")).select(F.concat_ws("_", "c.name", "c.k", "class").alias("b"), F.col("c.k").alias("k"))
    return digest(W.babble(seeds, "b", "k", em, "clip_id", "x", SEED).select(F.col("b").alias("clip_id"), F.col("mix").alias("y")))


# ---- windows ----------------------------------------------------------------------------------

def _win_sql(steps, hop, win, w="x[st + 1:st + {win}]", where=""):
    w = w.format(win=win)
    return f"""WITH {EM}, s AS (SELECT clip_id, x, unnest({steps}) AS step FROM em), w AS (SELECT clip_id, step, step * {hop} AS start, step * {hop} AS st, x FROM s),
v AS (SELECT clip_id, step, start, {w} AS y FROM w) SELECT clip_id, step, start, round(sqrt({pw('y')}), 6) AS rms FROM v {where}"""


def _win(spark, sf, **kw):
    w = W.hop_windows(signals(spark, sf).select("clip_id", "x"), "x", **kw)
    return w.withColumn("rms", A.rms(F.col("w")))


def _out(df):
    return df.select("clip_id", "step", "start", r6("rms").alias("rms"))


@query("w1_hop_windows_inclusive", _win_sql("range(13)", 4, 16))
def w1(spark, sf):
    return _out(_win(spark, sf, win=16, hop=4))


@query("w2_hop_windows_exclusive", _win_sql("range(12)", 4, 16))
def w2(spark, sf):
    return _out(_win(spark, sf, win=16, hop=4, inclusive=False))


@query("w2_exclusive_every_second", _win_sql("range(0, 12, 2)", 4, 16))
def w2b(spark, sf):
    return _out(_win(spark, sf, win=16, hop=4, inclusive=False, every=2))


@query("w3_non_overlapping_chunks", _win_sql("range(3)", 16, 16))
def w3(spark, sf):
    return _out(_win(spark, sf, win=16, hop=16, cap=3))


@query("w3_chunks_with_padded_tail", _win_sql("range(3)", 24, 24, w=f"list_concat(x[st + 1:least(st + 24, 64)], {zer('greatest(0, st + 24 - 64)')})"))
def w3b(spark, sf):
    return _out(_win(spark, sf, win=24, hop=24, pad_tail=True))


@query("p4_energy_gate", _win_sql("range(13)", 4, 16, where=f"WHERE sqrt({pw('y')}) >= 0.120"))
def p4(spark, sf):
    return _out(_win(spark, sf, win=16, hop=4).filter(F.col("rms") >= 0.120))


@query("m16_feature_statistics", f"""WITH {EM} SELECT class, count(*) AS n, round(avg(sqrt({pw('x')})), 6) AS mean_rms, round(min(list_min(x)), 6) AS lo, round(max(list_max(x)), 6) AS hi,
  round(sqrt(sum(list_sum({tr('x', 'v * v')})) / sum(len(x)) - pow(sum(list_sum(x)) / sum(len(x)), 2)), 6) AS std FROM em GROUP BY class""")
def m16(spark, sf):
    t = W.feature_statistics(signals(spark, sf), "x", ["class"])
    return t.select("class", "n", *[r6(c).alias(c) for c in ("mean_rms", "lo", "hi", "std")])
