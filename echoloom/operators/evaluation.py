"""False alarms per hour, streaming recall, latency, control arms and operating points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echoloom.operators.detector import Policy, detect, first_trigger, policy_table
from echoloom.operators.joins import first_in_interval
from echoloom.operators.metrics import ratio
from echoloom.operators.running import exact_quantiles, running

STEP_SECONDS = 0.1
RATE = 16000
HOP = 1600
#: steps in a smoothing chunk, chunks in a group, and levels of groups before a stream is one group
SMOOTH_CHUNK = 64
SMOOTH_GROUP = 256
SMOOTH_LEVELS = 2


def hours(steps: Column) -> Column:
    return steps * F.lit(STEP_SECONDS) / F.lit(3600.0)


def per_hour(events: Column, steps: Column) -> Column:
    return events / F.greatest(hours(steps), F.lit(1e-9))


def smoothed(scores: DataFrame, agg: str, alpha: float = 0.6, decay: float = 0.85, size: int = SMOOTH_CHUNK,
             group: int = SMOOTH_GROUP) -> DataFrame:
    """The smoothed score per step without any trigger, exact for every ``alpha`` and ``decay``.

    A run of steps maps the score before it to the score after it: ``max(v, f * e)`` for the peak
    hold and ``v + f * e`` for the mean, with two numbers (f, v) per run. Streams are cut into chunks
    of ``size`` steps; the chunks' numbers are composed in groups, the groups in groups again, and
    the entry scores are handed back down. So a long stream needs no long window and no look-back.
    """
    keep = decay if agg == "maxhold" else 1.0 - alpha
    x = F.when(F.col("gated"), F.lit(0.0)).otherwise(F.col("p"))

    def after(e: Column, f: Column, v: Column) -> Column:
        return F.greatest(v, f * e) if agg == "maxhold" else v + f * e

    def one(v: Column) -> Column:
        return v if agg == "maxhold" else F.lit(alpha) * v

    def through(items: Column) -> Column:
        """(f, v) of a run of items in order."""
        return F.aggregate(items, F.struct(F.lit(1.0).alias("f"), F.lit(0.0).alias("v")),
                           lambda a, i: F.struct((a["f"] * i["f"]).alias("f"), after(a["v"], i["f"], i["v"]).alias("v")))

    def entries(items: DataFrame, levels: int) -> DataFrame:
        """(stream, i, e): the score before each item (stream, i, f, v)."""
        up = F.floor(F.col("i") / F.lit(group)) if levels else F.lit(0).cast("bigint")
        grouped = items.withColumn("g", up)
        before = Window.partitionBy("stream", "g").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
        placed = grouped.withColumn("past", F.collect_list(F.struct("f", "v")).over(before))
        entry = F.lit(0.0)
        if levels:
            run = grouped.groupBy("stream", "g").agg(F.sort_array(F.collect_list(F.struct("i", "f", "v"))).alias("all"))
            run = run.select("stream", F.col("g").alias("i"), through(F.col("all")).alias("m")).select("stream", "i", "m.f", "m.v")
            outer = entries(run, levels - 1).select("stream", F.col("i").alias("g"), F.col("e").alias("outer"))
            placed = placed.join(outer, ["stream", "g"])
            entry = F.col("outer")
        return placed.select("stream", "i", F.aggregate("past", entry, lambda e, i: after(e, i["f"], i["v"])).alias("e"))

    rows = scores.withColumn("i", F.floor(F.col("step") / F.lit(size))).withColumn("x", x)
    own = rows.groupBy("stream", "i").agg(F.sort_array(F.collect_list(F.struct("step", "x"))).alias("all"))
    own = own.select("stream", "i", through(F.transform("all", lambda r: F.struct(F.lit(keep).alias("f"), one(r["x"]).alias("v")))).alias("m"))
    start = entries(own.select("stream", "i", "m.f", "m.v"), SMOOTH_LEVELS)
    so_far = Window.partitionBy("stream", "i").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("past", F.collect_list("x").over(so_far)).join(start, ["stream", "i"])
    return placed.withColumn("score", F.aggregate("past", F.col("e"), lambda e, v: after(e, F.lit(keep), one(v)))).drop("past", "e", "i", "x")


def soundscape_stress(scores: DataFrame, threshold: float, by: list[str], stride: int = 10) -> DataFrame:
    """Per class: highest score, frames at or above the threshold, scored frames and hours."""
    scored = ~F.col("gated") & (F.col("step") % stride == 0)
    g = scores.groupBy(*by).agg(
        F.max(F.when(scored, F.col("p"))).alias("max_conf"),
        F.count_if(scored & (F.col("p") >= threshold)).alias("frames_hit"),
        F.count_if(scored).alias("frames"), F.count(F.lit(1)).alias("steps"))
    return g.filter("frames > 0").withColumn("hours", hours(F.col("steps")))


def rejection(scores: DataFrame, threshold: float, chunk_steps: int = 10, chunks: int | None = None) -> DataFrame:
    """Per stream: chunks at or above the threshold, and the file verdict. ``chunks`` limits a stream to
    its first ones, as a quick test does; without it all are read."""
    read = scores if chunks is None else scores.filter(F.col("step") < chunk_steps * chunks)
    per_chunk = (read.groupBy("stream", F.floor(F.col("step") / chunk_steps).alias("c"))
                 .agg(F.max("p").alias("p"), F.count(F.lit(1)).alias("k")).filter(F.col("k") == chunk_steps))
    return per_chunk.groupBy("stream").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("p") >= threshold).alias("chunk_alarms"),
        F.max("p").alias("max_conf")).withColumn("false_alarm", F.col("max_conf") >= threshold)


def trial_results(scores: DataFrame, trials: DataFrame, policy: Policy) -> DataFrame:
    return first_in_interval(trials, detect(scores, [policy]))


def recall_by_snr(results: DataFrame) -> DataFrame:
    """Trials, hits and recall per SNR and overall (NULL)."""
    return results.rollup("snr").agg(
        F.count(F.lit(1)).alias("trials"), F.count_if("hit").alias("hits")).withColumn("recall", ratio("hits", "trials"))


def latency(results: DataFrame, origin: str) -> DataFrame:
    """Median and 90th percentile from the keyword's end or start, per SNR (hits only)."""
    sec = (F.col("first") - F.col("kw_end" if origin == "end" else "kw_start")) / F.lit(float(RATE))
    hit = results.filter("hit").withColumn("lat", sec).withColumn("gap", F.abs(F.col("first") - F.col("kw_end")) / F.lit(float(RATE)))
    q = exact_quantiles(hit, ["snr"], "lat", {"median": 0.5, "p90": 0.9})
    return q.join(hit.groupBy("snr").agg(F.avg("gap").alias("mean_gap"), F.count(F.lit(1)).alias("hits")), "snr")


def frame_vs_confirmed(scores: DataFrame, trials: DataFrame, policy: Policy) -> DataFrame:
    """Per SNR: trials with any smoothed score over the bar against trials the detector confirmed.

    A trial is fed until the detector confirms, so the scores that count are the smoothed ones up to
    and including its first trigger.
    """
    first = first_trigger(detect(scores, [policy])).select("stream", "first_step")
    fed = smoothed(scores, policy.agg, policy.alpha, policy.decay).join(first, "stream", "left").filter("first_step IS NULL OR step <= first_step")
    fed = fed.select("stream", F.col("score").alias("p"))
    per_stream = fed.groupBy("stream").agg(F.max(F.col("p") >= policy.threshold).alias("frame_hit"))
    fired = first.select("stream", F.lit(True).alias("fired"))
    t = trials.join(per_stream, "stream").join(fired, "stream", "left")
    g = t.groupBy("snr").agg(F.count(F.lit(1)).alias("trials"), F.count_if("frame_hit").alias("frame_hits"),
                             F.count_if(F.coalesce("fired", F.lit(False))).alias("confirmed"))
    with_snr = fed.join(trials.select("stream", "snr"), "stream")
    q = exact_quantiles(with_snr, ["snr"], "p", {"median": 0.5, "p10": 0.1})
    return g.join(q, "snr").withColumn("gap", ratio(F.col("frame_hits") - F.col("confirmed"), F.col("trials")))


def matched_arms(keyword: DataFrame, control: DataFrame, trials: DataFrame, policy: Policy) -> DataFrame:
    """Trials with ``hit`` on the keyword arm and ``control_hits`` on the same bed without the keyword.

    Both arms run through one detection; the arm is part of the stream key and dropped again
    before the beds are matched.
    """
    both = keyword.select(F.struct(F.lit("kw").alias("arm"), F.col("stream").alias("bed")).alias("stream"), "step", "p", "gated").unionByName(
        control.select(F.struct(F.lit("control").alias("arm"), F.col("stream").alias("bed")).alias("stream"), "step", "p", "gated"))
    n = detect(both, [policy]).groupBy("stream").agg(F.count(F.lit(1)).alias("n"))
    n = n.select(F.col("stream.arm").alias("arm"), F.col("stream.bed").alias("stream"), "n")
    kw = n.filter("arm = 'kw'").select("stream", F.lit(True).alias("hit"))
    ctl = n.filter("arm = 'control'").select("stream", F.col("n").alias("ctl_hits"))
    per_bed = trials.join(kw, "stream", "left").join(ctl, "stream", "left")
    return per_bed.withColumn("hit", F.coalesce("hit", F.lit(False))).withColumn("control_hits", F.coalesce("ctl_hits", F.lit(0))).drop("ctl_hits")


def control_arm(keyword: DataFrame, control: DataFrame, trials: DataFrame, policy: Policy) -> DataFrame:
    """Detection on the keyword arm and false alarms per hour on the same beds without it."""
    steps = control.groupBy("stream").agg(F.count(F.lit(1)).alias("steps"))
    per_bed = matched_arms(keyword, control, trials, policy).join(steps, "stream")
    g = per_bed.groupBy("snr").agg(
        F.count(F.lit(1)).alias("trials"), F.count_if("hit").alias("detected"),
        F.sum("control_hits").alias("control_hits"), F.sum("steps").alias("steps"))
    return g.withColumn("detection", ratio("detected", "trials")).withColumn(
        "control_fa_per_hour", per_hour(F.col("control_hits"), F.col("steps"))).drop("steps")


def sweep(scores: DataFrame, trials: DataFrame, policies: list[Policy], stride: int = 10,
          detections: DataFrame | None = None) -> DataFrame:
    """One row per policy: false alarms per hour on soundscapes and on speech, and recall over the trials.

    ``scores`` holds three inputs told apart by ``role``: frames of 'soundscape' streams at or above the
    threshold and confirmed triggers in 'speech' streams are false alarms, each over the hours of its
    own input; triggers in 'trial' streams count as recall if they are in time, and never as false
    alarms. All policies run in one detection.
    """
    spark = scores.sparkSession
    det = detect(scores.filter("role <> 'soundscape'"), policies) if detections is None else detections
    steps = scores.agg(*(F.count_if(F.col("role") == r).alias(r) for r in ("soundscape", "speech")))
    n_trials = trials.agg(F.count(F.lit(1)).alias("n_trials"))
    thresholds = sorted({p.threshold for p in policies})
    scored = scores.filter((F.col("role") == "soundscape") & ~F.col("gated") & (F.col("step") % stride == 0))
    frames = (scored.select(F.explode(F.filter(
        F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: t <= F.col("p"))).alias("threshold"))
        .groupBy("threshold").agg(F.count(F.lit(1)).alias("frames")))
    roles = scores.groupBy("stream").agg(F.first("role").alias("role"))
    per_stream = det.groupBy("stream", "pid").agg(F.min("step").alias("first_step"), F.count(F.lit(1)).alias("n")).join(roles, "stream")
    hit = (F.col("role") == "trial") & (F.col("first_step") * HOP <= F.col("kw_end") + 3200)
    agg = (per_stream.join(trials, "stream", "left").groupBy("pid")
           .agg(F.sum(F.when(F.col("role") == "speech", F.col("n"))).alias("triggers"), F.count_if(hit).alias("hits")))
    t = policy_table(spark, policies).join(agg, "pid", "left").join(frames, "threshold", "left")
    # two tables of one row each
    t = t.join(F.broadcast(steps)).join(F.broadcast(n_trials))
    t = t.withColumn("triggers", F.coalesce("triggers", F.lit(0))).withColumn("hits", F.coalesce("hits", F.lit(0)))
    t = t.withColumn("noise_fa", per_hour(F.coalesce("frames", F.lit(0)), F.col("soundscape"))).withColumn(
        "speech_fa", per_hour(F.col("triggers"), F.col("speech")))
    return (t.withColumn("total_fa", F.col("noise_fa") + F.col("speech_fa"))
            .withColumn("recall", F.col("hits") / F.greatest(F.lit(1), F.col("n_trials"))).drop("frames", "soundscape", "speech", "n_trials"))


def choose(table: DataFrame, fa_budget: float) -> DataFrame:
    """The policy with the best recall whose false alarms meet the budget; the first one on ties.
    No row if none does."""
    ok = table.filter(F.col("total_fa") <= F.lit(fa_budget))
    return ok.orderBy(F.col("recall").desc(), "pid").limit(1)


def freeze(chosen: DataFrame) -> DataFrame:
    """The one-row operating point table."""
    return chosen.select(
        "threshold", "agg", "need", "span",
        F.when(F.col("span") > F.col("need"), F.col("span")).otherwise(F.lit(0)).alias("confirm_window"),
        F.col("refractory").alias("refractory_steps"), "recall", F.col("total_fa").alias("fa_per_hour"))


# ---- sessions ---------------------------------------------------------------------------------

def wake_sessions(messages: DataFrame, bucket: Column, silence_steps: int | None = None) -> DataFrame:
    """Audio between a wake message and the end of speech (or a stretch of silence).

    ``messages``: stream, step, kind in {wake, end, audio}, bytes, ts_ms, quiet. A new wake drops
    what was collected. Frames outside a session are dropped; a session that never ends is not
    reported. State is carried as running maxima of step numbers, so no stream is read by one task.
    """
    rows = messages
    is_end = F.col("kind") == "end"
    if silence_steps is not None:
        loud = F.when(~F.col("quiet") | (F.col("kind") != "audio"), F.col("step"))
        rows = running(rows, ["stream"], ["step"], bucket, {"_loud": ("max", loud, True)})
        is_end = is_end | (F.col("step") - F.coalesce("_loud", F.lit(-1)) == silence_steps)
    rows = rows.withColumn("_is_end", is_end)
    rows = running(rows, ["stream"], ["step"], bucket, {
        "_wake": ("max", F.when(F.col("kind") == "wake", F.col("step")), True),
        "_end": ("max", F.when(F.col("_is_end"), F.col("step")), False)})
    live = F.col("_wake").isNotNull() & (F.coalesce("_end", F.lit(-1)) < F.col("_wake"))
    inside = rows.filter(live)
    audio = F.col("kind") == "audio"
    s = inside.groupBy("stream", F.col("_wake").alias("wake_step")).agg(
        F.max(F.when(F.col("_is_end"), F.col("step"))).alias("end_step"),
        F.count_if(audio).alias("frames"), F.coalesce(F.sum(F.when(audio, F.col("bytes"))), F.lit(0)).alias("bytes"),
        F.min(F.when(F.col("kind") == "wake", F.col("ts_ms"))).alias("wake_ms"),
        F.min(F.when(audio, F.col("ts_ms"))).alias("first_packet_ms"))
    return (s.filter(F.col("end_step").isNotNull())
            .withColumn("duration_s", F.col("bytes") / F.lit(32000.0))
            .withColumn("first_packet_delta_ms", F.col("first_packet_ms") - F.col("wake_ms")))


def listening_states(scores: DataFrame, detections: DataFrame, lead: int = 3) -> DataFrame:
    """State and capture flag per step: idle until the first trigger, streaming after it.

    The capture starts ``lead`` steps before the end of the trigger step (pre-roll).
    """
    first = detections.groupBy("stream").agg(F.min("step").alias("trigger"))
    j = scores.join(first, "stream", "left")
    return (j.withColumn("state", F.when(F.col("step") > F.col("trigger"), "STREAMING").otherwise("IDLE"))
            .withColumn("captured", F.coalesce(F.col("step") > F.col("trigger") - lead, F.lit(False))))
