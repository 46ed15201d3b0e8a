"""D family and the stream-based parts of J, M, K, W, H and T."""

from __future__ import annotations

from pyspark.sql import functions as F

from echoloom.catalog.adapters import EV, TRIALS, _epoch, detector_sql, r6, streams, table, trials, users
from echoloom.catalog.registry import query
from echoloom.operators import chunks as C
from echoloom.operators import detector as D
from echoloom.operators import evaluation as E
from echoloom.operators import joins as J
from echoloom.operators import mining as H
from echoloom.operators.ranking import top_n
from echoloom.operators.running import exact_quantiles, ordinal_by_bucket, running, time_bucket
from echoloom.plans import dims
from echoloom.session import materialize

THR = 0.68
MAIN = [D.Policy(THR)]


def _det_sql(policies, tail, source="ev", extra=""):
    return f"WITH RECURSIVE {EV}, {TRIALS}, {extra}{detector_sql(policies, source)} {tail}"


def _ungated(df):
    return df.withColumn("gated", F.lit(False))


UNGATED = "eu AS (SELECT * REPLACE (false AS gated) FROM ev), "


def _detector_query(name, policies, ungated=False):
    src = "eu" if ungated else "ev"

    @query(name, _det_sql(policies, "SELECT stream, pid, step FROM det", src, UNGATED))
    def run(spark, sf):
        s = streams(spark, sf)
        return D.detect(_ungated(s) if ungated else s, policies)
    return run


_detector_query("d3_rms_gate_in_stream", [D.Policy(THR, need=1, span=2), D.Policy(THR, agg="ema", need=1, span=2)])
_detector_query("d4_need_of_span_policies", D.grid([THR], dims.POLICIES, ["maxhold", "ema"]))
_detector_query("d5_consecutive_confirm", [D.engine_policy(0.4, n, agg=a) for n in (1, 2, 3) for a in ("maxhold", "ema")], ungated=True)
_detector_query("d6_refractory_lockout", [D.Policy(0.5, refractory=r) for r in (0, 1, 5, 15, 40)])
_detector_query("d7_reset_on_trigger", [D.Policy(0.5, agg="ema", refractory=2, keep_score=k) for k in (False, True)])
_detector_query("d8_full_detector", MAIN, ungated=True)
_detector_query("d9_engine_detector", [D.engine_policy(THR, 2, 0), D.engine_policy(THR, 2, 3), D.engine_policy(THR, 3, 4, agg="ema")], ungated=True)


# streams that go over many chunks and blocks: two of all events together
LONG = """lg AS (SELECT user_id % 2 AS stream, row_number() OVER (PARTITION BY user_id % 2 ORDER BY ts, event_id) - 1 AS step, least(1.0, value / 150.0)::DOUBLE AS p, value < 5.0 AS gated FROM events), """


def _long_streams(spark, sf):
    ev = table(spark, sf, "events").select((F.col("user_id") % 2).alias("stream"), F.timestamp_diff("MICROSECOND", _epoch(), F.col("ts")).alias("ts_us"), "event_id", "value")
    placed = ordinal_by_bucket(ev, ["stream"], ["ts_us", "event_id"], time_bucket("ts_us"), "step")
    return placed.select("stream", "step", F.least(F.lit(1.0), F.col("value") / 150.0).alias("p"), (F.col("value") < 5.0).alias("gated"))


def _long_query(name, policies):
    @query(name, _det_sql(policies, "SELECT stream, pid, step FROM det", "lg", LONG))
    def run(spark, sf):
        return D.detect(_long_streams(spark, sf), policies, size=64, block=2)
    return run


_long_query("d8_full_detector_long_streams", [D.Policy(0.5), D.Policy(0.5, agg="ema", need=2, span=3)])
_long_query("d9_engine_detector_long_streams", [D.engine_policy(0.5, 2, 3)])


@query("d2_decaying_peak_hold_long_streams", f"""WITH RECURSIVE {EV}, {LONG}sm(stream, step, score) AS (SELECT stream, -1::BIGINT, 0.0::DOUBLE FROM (SELECT DISTINCT stream FROM lg)
UNION ALL SELECT e.stream, e.step, greatest(CASE WHEN gated THEN 0.0 ELSE p END, score * 0.999) FROM sm JOIN lg e ON e.stream = sm.stream AND e.step = sm.step + 1)
SELECT stream, step, round(score, 6) AS score FROM sm WHERE step >= 0""")
def d2_long(spark, sf):
    return E.smoothed(_long_streams(spark, sf), "maxhold", decay=0.999).select("stream", "step", r6("score").alias("score"))


@query("d8_detector_report", _det_sql(MAIN, f""", raw AS (SELECT stream, count(*) FILTER (NOT gated AND p >= {THR}) AS raw_hits FROM ev GROUP BY stream)
SELECT raw.stream, raw_hits, count(step) AS n_detections, min(step) * 1600 AS first_sample FROM raw LEFT JOIN det USING (stream) GROUP BY ALL"""))
def d8(spark, sf):
    s = streams(spark, sf)
    raw = D.raw_triggers(s, THR, ["stream"])
    first = D.first_trigger(D.detect(s, MAIN)).select("stream", "n_detections", (F.col("first_step") * 1600).alias("first_sample"))
    return raw.join(first, "stream", "left").select("stream", "raw_hits", F.coalesce("n_detections", F.lit(0)).alias("n_detections"), "first_sample")


def _smooth_sql(agg):
    return f"""WITH RECURSIVE {EV}, sm(stream, step, score) AS (SELECT stream, -1::BIGINT, 0.0::DOUBLE FROM (SELECT DISTINCT stream FROM ev)
UNION ALL SELECT e.stream, e.step, {'greatest(CASE WHEN gated THEN 0.0 ELSE p END, score * 0.85)' if agg == 'maxhold' else '0.6 * (CASE WHEN gated THEN 0.0 ELSE p END) + 0.4 * score'}
FROM sm JOIN ev e ON e.stream = sm.stream AND e.step = sm.step + 1)
SELECT stream, step, round(score, 9) AS score FROM sm WHERE step >= 0"""


@query("d1_exponential_mean_score", _smooth_sql("ema"))
def d1(spark, sf):
    return E.smoothed(streams(spark, sf), "ema").select("stream", "step", r6("score", 9).alias("score"))


@query("d2_decaying_peak_hold", _smooth_sql("maxhold"))
def d2(spark, sf):
    return E.smoothed(streams(spark, sf), "maxhold").select("stream", "step", r6("score", 9).alias("score"))


@query("d11_raw_trigger_count", f"WITH {EV} SELECT stream, count(*) FILTER (NOT gated AND p >= {THR}) AS raw_hits FROM ev GROUP BY stream")
def d11(spark, sf):
    return D.raw_triggers(streams(spark, sf), THR, ["stream"])


GRID = D.grid(dims.SWEEP_THRESHOLDS, dims.POLICIES, ["ema", "maxhold"])
BUDGET = 1500.0

# three inputs: soundscapes, speech and trials are different streams
ROLE_SQL = "(CASE stream % 3 WHEN 0 THEN 'soundscape' WHEN 1 THEN 'speech' ELSE 'trial' END)"


def _scores(spark, sf):
    """Scores of all three inputs, stored once for the several passes of a sweep."""
    role = F.element_at(F.array(F.lit("soundscape"), F.lit("speech"), F.lit("trial")), (1 + F.col("stream") % 3).cast("int"))
    return materialize(streams(spark, sf).select("stream", "step", "p", "gated", "class", role.alias("role")), "scores")


def _trials(spark, sf):
    return trials(users(spark, sf).filter("stream % 3 = 2"))


SWEEP_TAIL = f""", tot AS (SELECT count(*) FILTER ({ROLE_SQL} = 'soundscape') AS sn, count(*) FILTER ({ROLE_SQL} = 'speech') AS sp FROM ev),
nt AS (SELECT count(*) AS n FROM trials WHERE {ROLE_SQL} = 'trial'),
fr AS (SELECT thr, count(e.p) AS frames FROM (SELECT DISTINCT thr FROM pol) LEFT JOIN (SELECT * FROM ev WHERE NOT gated AND step % 10 = 0 AND {ROLE_SQL} = 'soundscape') e ON e.p >= thr GROUP BY thr),
ps AS (SELECT stream, pid, min(step) AS fs, count(*) AS n FROM det GROUP BY ALL),
ag AS (SELECT pid, sum(ps.n) FILTER ({ROLE_SQL} = 'speech')::BIGINT AS triggers, count(*) FILTER ({ROLE_SQL} = 'trial' AND fs * 1600 <= kw_end + 3200) AS hits FROM ps JOIN trials USING (stream) GROUP BY pid),
sw AS (SELECT pol.pid, thr AS threshold, agg, need, span, refr, coalesce(triggers, 0) AS triggers, coalesce(hits, 0) AS hits,
  frames / greatest(tot.sn * 0.1 / 3600.0, 1e-9) AS noise_fa, coalesce(triggers, 0) / greatest(tot.sp * 0.1 / 3600.0, 1e-9) AS speech_fa,
  coalesce(hits, 0) / greatest(1, nt.n) AS recall FROM pol JOIN fr USING (thr) LEFT JOIN ag USING (pid), tot, nt),
best AS (SELECT * FROM sw WHERE noise_fa + speech_fa <= {BUDGET} ORDER BY recall DESC, pid LIMIT 1)"""


@query("d12_policy_threshold_sweep", _det_sql(GRID, SWEEP_TAIL + """
SELECT agg, need, span, threshold, triggers, hits, round(noise_fa, 6) AS noise_fa, round(speech_fa, 6) AS speech_fa,
  round(noise_fa + speech_fa, 6) AS total_fa, round(recall, 6) AS recall FROM sw"""))
def d12(spark, sf):
    t = E.sweep(_scores(spark, sf), _trials(spark, sf), GRID)
    return t.select("agg", "need", "span", "threshold", "triggers", "hits", *[r6(c).alias(c) for c in ("noise_fa", "speech_fa", "total_fa", "recall")])


@query("k4_best_recall_under_budget", _det_sql(GRID, SWEEP_TAIL + """
SELECT agg, need, span, threshold, round(noise_fa + speech_fa, 6) AS total_fa, round(recall, 6) AS recall FROM best"""))
def k4(spark, sf):
    return E.choose(E.sweep(_scores(spark, sf), _trials(spark, sf), GRID), BUDGET).select(
        "agg", "need", "span", "threshold", r6("total_fa").alias("total_fa"), r6("recall").alias("recall"))


@query("t5_operating_point_freeze", _det_sql(D.grid(dims.SWEEP_THRESHOLDS, ["2/3"], ["ema", "maxhold"]), SWEEP_TAIL + """
SELECT threshold, agg, need, span, CASE WHEN span > need THEN span ELSE 0 END AS confirm_window, refr AS refractory_steps,
  round(recall, 6) AS recall, round(noise_fa + speech_fa, 6) AS fa_per_hour FROM best"""))
def t5(spark, sf):
    f = E.freeze(E.choose(E.sweep(_scores(spark, sf), _trials(spark, sf), D.grid(dims.SWEEP_THRESHOLDS, ["2/3"], ["ema", "maxhold"])), BUDGET))
    return f.withColumn("recall", r6("recall")).withColumn("fa_per_hour", r6("fa_per_hour"))


FLAG_GRID = D.grid(dims.SWEEP_THRESHOLDS)


@query("flagship_false_alarms_per_class", _det_sql(FLAG_GRID, SWEEP_TAIL + f""", d AS (SELECT class, count(*) AS triggers FROM det JOIN best USING (pid) JOIN ev USING (stream, step) WHERE {ROLE_SQL} = 'soundscape' GROUP BY class),
h AS (SELECT class, count(*) * 0.1 / 3600.0 AS hours FROM ev WHERE {ROLE_SQL} = 'soundscape' GROUP BY class)
SELECT class, threshold, coalesce(d.triggers, 0) AS triggers, round(hours, 6) AS hours, round(coalesce(d.triggers, 0) / hours, 6) AS fa_per_hour
FROM h LEFT JOIN d USING (class), best"""))
def flagship(spark, sf):
    """False alarms per hour per soundscape class, at the threshold with the best recall within the budget."""
    scores = _scores(spark, sf)
    found = D.detect(scores, FLAG_GRID)
    best = E.choose(E.sweep(scores, _trials(spark, sf), FLAG_GRID, detections=found), BUDGET).select("pid", "threshold")
    best = F.broadcast(materialize(best, "operating_point"))               # one row, used twice
    s = scores.filter("role = 'soundscape'")
    hits = found.join(best, "pid").join(s.select("stream", "step", "class"), ["stream", "step"]).groupBy("class").agg(F.count(F.lit(1)).alias("triggers"))
    h = s.groupBy("class").agg(E.hours(F.count(F.lit(1))).alias("hours"))
    n = F.coalesce("triggers", F.lit(0))
    return h.join(hits, "class", "left").withColumn("threshold", best.select("threshold").scalar()).select(
        "class", "threshold", n.alias("triggers"), r6("hours").alias("hours"), r6(n / F.col("hours")).alias("fa_per_hour")).filter(
            F.col("threshold").isNotNull())


# ---- joins and metrics on streams -------------------------------------------------------------

RES = """, res AS (SELECT t.*, f.first, coalesce(f.first <= t.kw_end + 3200, false) AS hit FROM trials t LEFT JOIN
  (SELECT stream, min(step) * 1600 AS first FROM det GROUP BY stream) f USING (stream))"""


@query("j10_first_trigger_in_interval", _det_sql(MAIN, RES + " SELECT stream, snr, first, hit FROM res"))
def j10(spark, sf):
    s = streams(spark, sf)
    return E.trial_results(s, trials(users(spark, sf)), MAIN[0]).select("stream", "snr", "first", "hit")


@query("m20_streaming_recall_by_snr", _det_sql(MAIN, RES + """ SELECT snr, count(*) AS trials, count(*) FILTER (hit) AS hits,
  round(count(*) FILTER (hit) / count(*), 6) AS recall FROM res GROUP BY ROLLUP (snr)"""))
def m20(spark, sf):
    s = streams(spark, sf)
    t = E.recall_by_snr(E.trial_results(s, trials(users(spark, sf)), MAIN[0]))
    return t.select("snr", "trials", "hits", r6("recall").alias("recall"))


def _lat_sql(origin):
    return _det_sql(MAIN, RES + f""" SELECT snr, count(*) AS hits, round(quantile_cont((first - {origin}) / 16000, 0.5), 6) AS median,
  round(quantile_cont((first - {origin}) / 16000, 0.9), 6) AS p90, round(avg(abs(first - kw_end) / 16000), 6) AS mean_gap FROM res WHERE hit GROUP BY snr""")


def _lat(spark, sf, origin):
    s = streams(spark, sf)
    t = E.latency(E.trial_results(s, trials(users(spark, sf)), MAIN[0]), origin)
    return t.select("snr", "hits", *[r6(c).alias(c) for c in ("median", "p90", "mean_gap")])


@query("m21_latency_from_keyword_end", _lat_sql("kw_end"))
def m21a(spark, sf):
    return _lat(spark, sf, "end")


@query("m21_latency_from_keyword_start", _lat_sql("kw_start"))
def m21b(spark, sf):
    return _lat(spark, sf, "start")


@query("j11_preroll_capture", _det_sql(MAIN, """ SELECT d.stream, d.step AS trigger, e.step, e.event_id FROM det d JOIN ev e ON e.stream = d.stream
  AND e.step BETWEEN d.step - 2 AND d.step"""))
def j11(spark, sf):
    s = streams(spark, sf)
    return J.preroll(D.detect(s, MAIN), s, 3, ["event_id"]).select("stream", "trigger", "step", "event_id")


ENGINE = [D.engine_policy(THR, 2, 0)]


@query("m22_frame_vs_confirmed_recall", _det_sql(ENGINE, f""", sm(stream, step, score) AS (SELECT stream, -1::BIGINT, 0.0::DOUBLE FROM (SELECT DISTINCT stream FROM eu)
  UNION ALL SELECT e.stream, e.step, greatest(e.p, score * 0.85) FROM sm JOIN eu e ON e.stream = sm.stream AND e.step = sm.step + 1),
ft AS (SELECT stream, min(step) AS last FROM det GROUP BY stream),
fed AS (SELECT stream, score AS p FROM sm LEFT JOIN ft USING (stream) WHERE step >= 0 AND step <= coalesce(last, step)),
fs AS (SELECT stream, max((p >= {THR})::INT) AS f FROM fed GROUP BY stream),
dd AS (SELECT DISTINCT stream, 1 AS c FROM det), t AS (SELECT snr, f, coalesce(c, 0) AS c FROM trials JOIN fs USING (stream) LEFT JOIN dd USING (stream)),
q AS (SELECT snr, quantile_cont(p, 0.5) AS md, quantile_cont(p, 0.1) AS lo FROM fed JOIN trials USING (stream) GROUP BY snr)
SELECT snr, count(*) AS trials, sum(f)::BIGINT AS frame_hits, sum(c)::BIGINT AS confirmed, round(any_value(md), 6) AS median, round(any_value(lo), 6) AS p10,
  round((sum(f) - sum(c)) / count(*), 6) AS gap FROM t JOIN q USING (snr) GROUP BY snr""", "eu", UNGATED))
def m22(spark, sf):
    s = _ungated(streams(spark, sf))
    t = E.frame_vs_confirmed(s, trials(users(spark, sf)), ENGINE[0])
    return t.select("snr", "trials", "frame_hits", "confirmed", *[r6(c).alias(c) for c in ("median", "p10", "gap")])


ARMS = "arm AS (SELECT stream * 2 AS stream, step, p, gated FROM ev UNION ALL SELECT stream * 2 + 1, step, p * 0.9::DOUBLE, gated FROM ev), "
CONTROL_TAIL = """, n AS (SELECT stream // 2 AS bed, count(*) FILTER (stream % 2 = 0) AS kw, count(*) FILTER (stream % 2 = 1) AS ctl FROM det GROUP BY 1),
st AS (SELECT stream AS bed, count(*) AS steps FROM ev GROUP BY 1),
pb AS (SELECT t.stream AS bed, t.snr, coalesce(n.kw, 0) > 0 AS hit, coalesce(n.ctl, 0) AS ctl, st.steps FROM trials t JOIN st ON st.bed = t.stream LEFT JOIN n ON n.bed = t.stream)"""


@query("m23_control_arm_false_alarms", _det_sql(MAIN, CONTROL_TAIL + """ SELECT snr, count(*) AS trials, count(*) FILTER (hit) AS detected, sum(ctl)::BIGINT AS control_hits,
  round(count(*) FILTER (hit) / count(*), 6) AS detection, round(sum(ctl) / greatest(sum(steps) * 0.1 / 3600.0, 1e-9), 6) AS control_fa_per_hour FROM pb GROUP BY snr""", "arm", ARMS))
def m23(spark, sf):
    s = streams(spark, sf)
    t = E.control_arm(s, s.withColumn("p", F.col("p") * F.lit(0.9)), trials(users(spark, sf)), MAIN[0])
    return t.select("snr", "trials", "detected", "control_hits", r6("detection").alias("detection"), r6("control_fa_per_hour").alias("control_fa_per_hour"))


@query("s17_experiment_result_sink", _det_sql(MAIN, CONTROL_TAIL + """ SELECT snr, round(count(*) FILTER (hit) / count(*), 6) AS detection,
  round(sum(ctl) / greatest(sum(steps) * 0.1 / 3600.0, 1e-9), 6) AS control_fa_per_hour FROM pb GROUP BY snr""", "arm", ARMS))
def s17(spark, sf):
    return materialize(m23(spark, sf).select("snr", "detection", "control_fa_per_hour"), "experiment")


@query("j14_trial_with_matched_control", _det_sql(MAIN, CONTROL_TAIL + " SELECT bed, snr, hit, ctl AS control_hits FROM pb", "arm", ARMS))
def j14(spark, sf):
    s = streams(spark, sf)
    t = E.matched_arms(s, s.withColumn("p", F.col("p") * F.lit(0.9)), trials(users(spark, sf)), MAIN[0])
    return t.select(F.col("stream").alias("bed"), "snr", "hit", "control_hits")


STRESS = """SELECT {k}, round(max(p) FILTER (s), 6) AS max_conf, count(*) FILTER (s AND p >= 0.68) AS frames_hit, count(*) FILTER (s) AS frames,
  round(count(*) * 0.1 / 3600.0, 6) AS hours FROM (SELECT *, NOT gated AND step % 10 = 0 AS s FROM ev) GROUP BY {k} HAVING count(*) FILTER (s) > 0"""


@query("m17_soundscape_stress_per_class", f"WITH {EV} " + STRESS.format(k="class"))
def m17(spark, sf):
    t = E.soundscape_stress(streams(spark, sf), THR, ["class"])
    return t.select("class", r6("max_conf").alias("max_conf"), "frames_hit", "frames", r6("hours").alias("hours"))


@query("k3_worst_offenders", f"WITH {EV}, t AS ({STRESS.format(k='stream')}) SELECT stream, max_conf, frames_hit FROM t ORDER BY max_conf DESC, stream LIMIT 14")
def k3(spark, sf):
    t = E.soundscape_stress(streams(spark, sf), THR, ["stream"]).withColumn("max_conf", r6("max_conf"))
    return top_n(t, "max_conf", ["stream"], 14).select("stream", "max_conf", "frames_hit")


@query("w4_stride_thinning", f"WITH {EV} SELECT stream, count(*) AS n, round(sum(p), 6) AS p FROM ev WHERE step % 10 = 0 GROUP BY stream")
def w4(spark, sf):
    return streams(spark, sf).filter("step % 10 = 0").groupBy("stream").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("p")).alias("p"))


def _rejection_sql(where):
    return f"""WITH {EV}, c AS (SELECT stream, step // 10 AS c, max(p) AS p, count(*) AS k FROM ev WHERE {where} GROUP BY ALL HAVING count(*) = 10),
f AS (SELECT stream, count(*) AS chunks, count(*) FILTER (p >= 0.85) AS al, max(p) >= 0.85 AS fa FROM c GROUP BY stream)
SELECT count(*) AS files, sum(chunks)::BIGINT AS chunks, sum(al)::BIGINT AS chunk_alarms, count(*) FILTER (fa) AS file_alarms,
  round(1 - count(*) FILTER (fa) / count(*), 6) AS file_rejection, round(1 - sum(al) / sum(chunks), 6) AS chunk_rejection FROM f"""


@query("m18_rejection_rates", _rejection_sql("true"))
def m18(spark, sf):
    return _rejection(E.rejection(streams(spark, sf), 0.85))


@query("m18_rejection_rates_quick_test", _rejection_sql("step < 50"))
def m18_quick(spark, sf):
    return _rejection(E.rejection(streams(spark, sf), 0.85, chunks=5))


def _rejection(f):
    return f.agg(F.count(F.lit(1)).alias("files"), F.sum("chunks").alias("chunks"), F.sum("chunk_alarms").alias("chunk_alarms"),
                 F.count_if("false_alarm").alias("file_alarms"),
                 r6(1 - F.count_if("false_alarm") / F.count(F.lit(1))).alias("file_rejection"),
                 r6(1 - F.sum("chunk_alarms") / F.sum("chunks")).alias("chunk_rejection"))


@query("m19_false_alarms_per_hour", _det_sql(MAIN, f""", h AS (SELECT count(*) * 0.1 / 3600.0 AS hours, count(*) FILTER (NOT gated AND p >= {THR}) AS raw FROM ev)
SELECT raw, (SELECT count(*) FROM det) AS triggers, round(hours, 6) AS hours, round(raw / hours, 6) AS raw_per_hour, round((SELECT count(*) FROM det) / hours, 6) AS triggers_per_hour FROM h"""))
def m19(spark, sf):
    s = streams(spark, sf)
    n = D.detect(s, MAIN).agg(F.count(F.lit(1))).scalar()
    t = s.agg(F.count(F.lit(1)).alias("steps"), F.count_if(~F.col("gated") & (F.col("p") >= THR)).alias("raw")).withColumn("triggers", n)
    return t.select("raw", "triggers", r6(E.hours(F.col("steps"))).alias("hours"), r6(E.per_hour(F.col("raw"), F.col("steps"))).alias("raw_per_hour"),
                    r6(E.per_hour(F.col("triggers"), F.col("steps"))).alias("triggers_per_hour"))


@query("m26_miss_profile", f"""WITH {EV}, {TRIALS} SELECT snr, count(*) AS n, round(avg((p < {THR})::INT), 6) AS miss, round(quantile_cont(p, 0.5), 6) AS median
FROM ev JOIN trials USING (stream) GROUP BY snr""")
def m26(spark, sf):
    s = streams(spark, sf)
    t = H.miss_profile(s.join(trials(users(spark, sf)), "stream"), THR, ["snr"])
    return t.select("snr", "n", r6("miss").alias("miss"), r6("median").alias("median"))


@query("m33_latency_statistics", """SELECT event_type AS class, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.95), 6) AS p95
FROM events GROUP BY 1""")
def m33(spark, sf):
    ev = table(spark, sf, "events").select(F.col("event_type").alias("class"), "value")
    q = exact_quantiles(ev, ["class"], "value", {"p95": 0.95})
    g = ev.groupBy("class").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return g.join(q, "class").select("class", *[r6(c).alias(c) for c in ("mean", "std", "p95")])


# ---- windows over streams ---------------------------------------------------------------------

@query("w5_fixed_chunks_drop_remainder", f"WITH {EV} SELECT stream, step // 10 AS chunk, round(sum(p), 6) AS p, min(event_id) AS first FROM ev GROUP BY ALL HAVING count(*) = 10")
def w5(spark, sf):
    g = streams(spark, sf).groupBy("stream", F.floor(F.col("step") / 10).alias("chunk")).agg(
        F.sum("p").alias("p"), F.min("event_id").alias("first"), F.count(F.lit(1)).alias("n"))
    return g.filter("n = 10").select("stream", "chunk", r6("p").alias("p"), "first")


@query("w6_ring_buffer_window", f"""WITH {EV}, b AS (SELECT stream, step, list_concat(list_transform(range(greatest(0, 7 - step)), lambda i: 0.0::DOUBLE),
  list(p) OVER (PARTITION BY stream ORDER BY step ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)) AS buf FROM ev)
SELECT stream, step, len(buf) AS n, round(buf[1], 6) AS oldest, round(buf[8], 6) AS newest, round(list_sum(buf), 6) AS total FROM b""")
def w6(spark, sf):
    b = C.ring_buffer(streams(spark, sf).select("stream", "step", "p"), "p", 8)
    return b.select("stream", "step", F.size("buffer").cast("bigint").alias("n"), r6(F.element_at("buffer", 1)).alias("oldest"),
                    r6(F.element_at("buffer", 8)).alias("newest"), r6(F.aggregate("buffer", F.lit(0.0), lambda a, v: a + v)).alias("total"))


@query("k10_prefix_time_layout", """SELECT conv_id, turn, coalesce(sum(length(text) + 8000) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 8000 AS start,
  sum(length(text) + 8000) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS stop FROM conversations""")
def k10(spark, sf):
    seg = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("dur"))
    t = running(seg, ["conv_id"], ["turn"], F.floor(F.col("turn") / 1024), {"before": ("sum", F.col("dur") + 8000, False)})
    return t.select("conv_id", "turn", (F.col("before") + 8000).alias("start"), (F.col("before") + 8000 + F.col("dur")).alias("stop"))


# ---- sessions ---------------------------------------------------------------------------------

MSG_SQL = """msg AS (SELECT stream, step, CASE class WHEN 'signup' THEN 'wake' WHEN 'purchase' THEN 'end' ELSE 'audio' END AS kind,
  CAST(floor(value * 100) AS BIGINT) * 2 AS bytes, epoch_us(ts) // 1000 AS ts_ms, value < 20.0 AS quiet FROM ev)"""


def messages(s):
    kind = F.when(F.col("class") == "signup", "wake").when(F.col("class") == "purchase", "end").otherwise("audio")
    return s.select("stream", "step", kind.alias("kind"), (F.floor(F.col("value") * 100) * 2).alias("bytes"),
                    F.floor(F.col("ts_us") / 1000).alias("ts_ms"), (F.col("value") < 20.0).alias("quiet"))


def _session_sql(close: str) -> str:
    return f"""WITH {EV}, {MSG_SQL}, l AS (SELECT *, max(CASE WHEN NOT quiet OR kind <> 'audio' THEN step END) OVER w AS loud FROM msg WINDOW w AS (PARTITION BY stream ORDER BY step)),
e AS (SELECT *, ({close}) AS is_end FROM l),
m AS (SELECT *, max(CASE WHEN kind = 'wake' THEN step END) OVER (PARTITION BY stream ORDER BY step) AS wk,
  max(CASE WHEN is_end THEN step END) OVER (PARTITION BY stream ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS en FROM e),
s AS (SELECT stream, wk AS wake_step, max(step) FILTER (is_end) AS end_step, count(*) FILTER (kind = 'audio') AS frames,
  coalesce(sum(bytes) FILTER (kind = 'audio'), 0)::BIGINT AS bytes, min(ts_ms) FILTER (kind = 'wake') AS w, min(ts_ms) FILTER (kind = 'audio') AS a
  FROM m WHERE wk IS NOT NULL AND coalesce(en, -1) < wk GROUP BY ALL)
SELECT stream, wake_step, end_step, frames, bytes, round(bytes / 32000, 8) AS duration_s, a - w AS first_packet_delta_ms FROM s WHERE end_step IS NOT NULL"""


def _sessions(spark, sf, silence):
    t = E.wake_sessions(messages(streams(spark, sf)), C.chunk_of("step"), silence)
    return t.select("stream", "wake_step", "end_step", "frames", "bytes", r6("duration_s", 8).alias("duration_s"), "first_packet_delta_ms")


@query("d13_wake_sessions", _session_sql("kind = 'end'"))
def d13(spark, sf):
    return _sessions(spark, sf, None)


@query("d13_wake_sessions_with_silence", _session_sql("kind = 'end' OR step - coalesce(loud, -1) = 3"))
def d13b(spark, sf):
    return _sessions(spark, sf, 3)


@query("d14_listening_state_machine", _det_sql(MAIN, """, f AS (SELECT stream, min(step) AS trig FROM det GROUP BY stream)
SELECT ev.stream, step, CASE WHEN step > trig THEN 'STREAMING' ELSE 'IDLE' END AS state, coalesce(step > trig - 3, false) AS captured FROM ev LEFT JOIN f USING (stream)"""))
def d14(spark, sf):
    s = streams(spark, sf)
    return E.listening_states(s, D.detect(s, MAIN)).select("stream", "step", "state", "captured")


# ---- mining over streams ----------------------------------------------------------------------

@query("h1_hard_negatives_three_sources", f"""WITH {EV}, m AS (
  SELECT 'soundscape' AS source, p FROM ev WHERE class = 'view' AND step % 2 = 0 AND value >= 5 AND p >= 0.15
  UNION ALL SELECT 'command', p FROM ev WHERE class = 'click' AND p >= 0.15
  UNION ALL SELECT 'reading', p FROM ev WHERE class NOT IN ('view', 'click') AND step % 2 = 0 AND value >= 15 AND p >= 0.15)
SELECT source, count(*) AS n, round(avg(p), 6) AS mean_p, round(max(p), 6) AS max_p FROM m GROUP BY source""")
def h1(spark, sf):
    s = streams(spark, sf)
    even, kind = F.col("step") % 2 == 0, F.col("class")
    found = H.hard_negatives(s, {"soundscape": ((kind == "view") & even, F.col("value") >= 5.0, 0.15), "command": (kind == "click", F.lit(True), 0.15),
                                 "reading": (~kind.isin("view", "click") & even, F.col("value") >= 15.0, 0.15)})
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("p")).alias("mean_p"), r6(F.max("p")).alias("max_p"))


@query("h2_continuous_speech_false_alarms", f"""WITH {EV}, t AS (SELECT count(*) * 0.1 / 3600.0 AS hours FROM ev),
k AS (SELECT stream, step, p FROM ev WHERE value >= 10.0 AND p >= 0.40 ORDER BY p DESC, stream, step LIMIT 6000)
SELECT stream, step, round(p, 6) AS p, round(hours, 6) AS hours FROM k, t""")
def h2(spark, sf):
    s = streams(spark, sf)
    k = H.false_alarm_rows(s, F.col("value") >= 10.0, 0.40, ["stream", "step"], 6000)
    scanned = s.agg(E.hours(F.count(F.lit(1)))).scalar()
    return k.select("stream", "step", r6("p").alias("p"), F.round(scanned, 6).alias("hours"))


@query("h3_soundscape_false_alarms", f"WITH {EV} SELECT stream, step, class, round(p, 6) AS p FROM ev WHERE value >= 5.0 AND p >= 0.50")
def h3(spark, sf):
    return H.false_alarm_rows(streams(spark, sf), F.col("value") >= 5.0, 0.50, ["stream", "step"], None).select("stream", "step", "class", r6("p").alias("p"))
