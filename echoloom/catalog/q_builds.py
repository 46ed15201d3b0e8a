"""Training, features, confusable negatives, compaction and incremental builds, each with a SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from echoloom.catalog.adapters import EM, TR, r6, signals, table, transcripts
from echoloom.catalog.registry import query
from echoloom.functions import draws as D
from echoloom.functions.features import EPS, RATE, Shape, log_mel
from echoloom.operators import scoring as T
from echoloom.operators.clipwindows import mel_triangles
from echoloom.plans import confusable as C
from echoloom.session import scratch_path
from echoloom.sources import builds
from echoloom.sources import tables as SRC

SEED = 41

# ---- T1: weighted training, checked step by step ------------------------------------------------

STEPS, RIDGE = 5, 1e-3


def _newton_sql() -> str:
    names = ("a", "b", "c")
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    steps = ["b0 AS (SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2)"]
    for s in range(STEPS):
        sums = ", ".join([f"sum(w * (y - p) * {n}) - {RIDGE} * any_value(b{i}) AS g{i}" for i, n in enumerate(names)]
                         + [f"sum(w * p * (1 - p) * {names[i]} * {names[j]}){f' + {RIDGE}' if i == j else ''} AS h{i}{j}" for i, j in pairs])
        steps.append(f"s{s} AS (SELECT any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, {sums} FROM (SELECT *, 1.0 / (1.0 + exp(-(a * b0 + b * b1 + c * b2))) AS p FROM f, b{s}))")
        steps.append(f"d{s} AS (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM s{s})")
        steps.append(f"""b{s + 1} AS (SELECT b0 + (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det AS b0,
  b1 + (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det AS b1,
  b2 + (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det AS b2 FROM d{s})""")
    return ", ".join(steps)


@query("t1_newton_training", f"""WITH {EM}, l AS (SELECT *, CASE WHEN class < 5 THEN 1 ELSE 0 END AS y FROM em),
r AS (SELECT least(greatest(sqrt(count(*) FILTER (y = 0) / count(*) FILTER (y = 1)), 0.5), 2.0) AS neg FROM l),
f AS (SELECT y, CASE WHEN y = 1 THEN 1.15 * neg ELSE neg END * CASE WHEN class % 3 = 0 THEN 1.25 ELSE 1.0 END AS w, 1.0::DOUBLE AS a,
  list_sum(x[1:32]) AS b, list_sum(x[33:64]) AS c FROM l, r), {_newton_sql()}
SELECT i, round(CASE i WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END, 6) AS coefficient FROM b{STEPS}, (SELECT unnest(range(3)) AS i)""")
def t1_newton(spark, sf):
    """Class weight times bucket weight; features are a one and the sums of both halves of the signal."""
    df = signals(spark, sf).withColumn("y", (F.col("class") < 5).cast("int"))
    half = lambda start: F.aggregate(F.slice("x", start, 32), F.lit(0.0), lambda a, v: a + v)      # noqa: E731
    df = T.row_weights(df.withColumn("x", F.array(F.lit(1.0), half(1), half(33))), F.when(F.col("class") % 3 == 0, 1.25).otherwise(1.0))
    beta = T.newton(df, steps=STEPS, ridge=RIDGE).tolist()
    fitted = F.array(*[F.lit(b) for b in beta])
    # the coefficients leave as rows of a plan that has read the table
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.posexplode(fitted).alias("i", "b")).select(F.col("i").cast("long").alias("i"), r6("b").alias("coefficient"))


# ---- A31: log-mel features against a transform written out -----------------------------------------

SMALL = Shape(length=64, frame=48, hop=8, n_fft=64, bands=10, frames=3)
_MEL = ", ".join(str(r) for r in mel_triangles(RATE, SMALL.n_fft, SMALL.bands))


@query("a31_log_mel_by_frame", f"""WITH {EM}, mel(bin, band, weight) AS (VALUES {_MEL}),
smp AS (SELECT clip_id, t, n, x[t * {SMALL.hop} + n + 1] * (0.5 - 0.5 * cos(2 * pi() * n / {SMALL.frame - 1})) AS v
  FROM em, (SELECT unnest(range({SMALL.frames})) AS t), (SELECT unnest(range({SMALL.frame})) AS n)),
sp AS (SELECT clip_id, t, bin, sum(v * cos(2 * pi() * bin * n / {SMALL.n_fft})) AS re, sum(v * sin(2 * pi() * bin * n / {SMALL.n_fft})) AS im
  FROM smp, (SELECT unnest(range({SMALL.n_fft // 2 + 1})) AS bin) GROUP BY ALL),
en AS (SELECT clip_id, t, band, sum((re * re + im * im) * weight) AS e FROM sp JOIN mel USING (bin) GROUP BY ALL),
fu AS (SELECT clip_id, t, band, ln(coalesce(e, 0.0) + {EPS}) AS f FROM (SELECT clip_id, t, band FROM em, (SELECT unnest(range({SMALL.frames})) AS t), (SELECT unnest(range({SMALL.bands})) AS band))
  LEFT JOIN en USING (clip_id, t, band))
SELECT clip_id, t AS frame, round(sum(f), 3) AS total, round(sum(f * (band + 1)), 3) AS shape FROM fu GROUP BY ALL""")
def a31_frames(spark, sf):
    """Three overlapping frames of every clip; no two frames of a clip are alike."""
    f = log_mel(signals(spark, sf).select("clip_id", F.col("x").alias("samples")), shape=SMALL, exact=True)
    rows = F.transform(F.sequence(F.lit(0), F.lit(SMALL.frames - 1)), lambda t: F.slice(F.col("features"), t * SMALL.bands + 1, F.lit(SMALL.bands)))
    one = f.select("clip_id", F.posexplode(rows).alias("frame", "b"))
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)                                   # noqa: E731
    return one.select("clip_id", F.col("frame").cast("long").alias("frame"), r6(add(F.col("b")), 3).alias("total"), r6(add(F.transform("b", lambda v, i: v * (i + 1))), 3).alias("shape"))


# ---- H7: confusable negatives --------------------------------------------------------------------

VOICES = 3


def _u(salt, *keys):
    return D.uniform_sql(SEED, salt, *(keys or C.KEYS))


@query("h7_confusable_negatives", f"""WITH {EM}, {TR}, cf AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[ \\n\\t\\r]+')) AS word FROM benchmark),
wd AS (SELECT DISTINCT word FROM (SELECT unnest(words) AS word FROM tr) SEMI JOIN cf USING (word)), nn AS (SELECT count(*) AS n FROM em WHERE class >= 5),
v AS (SELECT word, voice, variant, n FROM wd, nn, (SELECT unnest(range({VOICES})) AS voice), (SELECT unnest(range({C.VARIANTS})) AS variant)),
d AS (SELECT *, {_u('warp')} < {C.WARP} AS warp, {_u('pair')} < {C.PAIR} AS pair, {_u('crush')} < {C.CRUSH} AS crush,
  CAST(floor({_u('pair-a')} * n) AS BIGINT) AS i, CAST(floor({_u('pair-b')} * (n - 1)) AS BIGINT) AS j0, {C.SNR[0][0]}::DOUBLE + {C.SNR[0][1] - C.SNR[0][0]}::DOUBLE * {_u('snr1')} AS snr1,
  list_extract([6, 8], CAST(1 + floor({_u('bits')} * 2) AS BIGINT)) AS bits FROM v)
SELECT voice, variant, count(*) AS n, count(DISTINCT word) AS words, count(*) FILTER (warp) AS warped, count(*) FILTER (pair) AS paired, count(*) FILTER (crush AND bits = 6) AS six_bits,
  round(avg(snr1) FILTER (pair), 6) AS snr1, sum(CASE WHEN pair THEN i + CASE WHEN j0 >= i THEN j0 + 1 ELSE j0 END END)::BIGINT AS noises, count(*) AS whole FROM d GROUP BY voice, variant""")
def h7_negatives(spark, sf):
    """Words of the benchmark that occur in the transcripts; clips of the lower classes are voices, the others noise."""
    listed = table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), r"[ \n\t\r]+")).alias("word")).distinct()
    words = transcripts(spark, sf).select(F.explode("words").alias("word")).distinct().join(listed, "word", "left_semi")
    clips = signals(spark, sf)
    bases, noises = clips.filter("class < 5"), clips.filter("class >= 5")
    made = C.negatives(words, VOICES, bases, noises, "clip_id", "x", 64, SEED)
    drawn = C.plan(words, VOICES, bases.agg(F.count(F.lit(1))).scalar(), noises.agg(F.count(F.lit(1))).scalar(), SEED)
    whole = made.filter((F.col("y") == 0) & (F.size("x") == 64) & F.forall("x", lambda s: ~F.isnan(s))).groupBy("voice", "variant").agg(F.count(F.lit(1)).alias("whole"))
    sums = drawn.groupBy("voice", "variant").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("word").alias("words"), F.count_if(F.col("beta").isNotNull()).alias("warped"), F.count_if(F.col("snr1").isNotNull()).alias("paired"),
        F.count_if(F.col("bits") == 6).alias("six_bits"), r6(F.avg("snr1")).alias("snr1"), F.sum(F.col("first") + F.col("second")).alias("noises"))
    return sums.join(whole, ["voice", "variant"], "left").select(
        F.col("voice").cast("long").alias("voice"), F.col("variant").cast("long").alias("variant"), "n", "words", "warped", "paired", "six_bits", "snr1", "noises", F.coalesce("whole", F.lit(0)).alias("whole"))


# ---- S11 and S15 -----------------------------------------------------------------------------------

@query("s11_compaction_bytes", "SELECT count(*) AS rows, true AS smaller, true AS listed FROM embeddings")
def s11_bytes(spark, sf):
    """Double features become floats: rows of both folders from their footers, bytes from their listings."""
    wide, narrow = scratch_path(spark, "wide"), scratch_path(spark, "narrow")
    signals(spark, sf).write.option("compression", "zstd").parquet(wide)
    r = SRC.compact_folder(spark, wide, narrow)
    back = spark.read.parquet(narrow)
    return back.agg(F.count(F.lit(1)).alias("rows")).select(F.when((F.col("rows") == r["rows_before"]) & (F.col("rows") == r["rows_after"]), F.col("rows")).alias("rows"),
                                                             F.lit(0 < r["bytes_after"] < r["bytes_before"]).alias("smaller"), F.lit(r["files_after"] > 0).alias("listed"))


PARTS = 16
_PART = f"('0x' || substr(md5(page_id::VARCHAR), 1, 8))::BIGINT % {PARTS}"


@query("s15_incremental_build", f"""WITH p AS (SELECT {_PART} AS part, page_id % 40 = 7 AS changed FROM pages), t AS (SELECT part, bool_or(changed) AS changed, count(*) AS n FROM p GROUP BY part)
SELECT 1 AS run, count(*) AS parts, count(*) AS rebuilt, sum(n)::BIGINT AS rows, false AS reused, true AS equal FROM t UNION ALL SELECT 2, count(*), 0, 0, true, true FROM t
UNION ALL SELECT 3, count(*), count(*) FILTER (changed), coalesce(sum(n) FILTER (changed), 0)::BIGINT, bool_and(NOT changed), true FROM t""")
def s15_build(spark, sf):
    """Built, built again unchanged, and built after some pages changed; ``equal``: the bundle holds what a fresh build would."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    later = pages.withColumn("url", F.when(F.col("page_id") % 40 == 7, F.concat("url", F.lit("#new"))).otherwise(F.col("url")))
    make = lambda df: df.withColumn("host", F.regexp_extract("url", "://([^/?#]*)", 1)).withColumn("size", F.length("url"))       # noqa: E731
    path, out = scratch_path(spark, "bundle"), None
    for run, df in enumerate((pages, pages, later), 1):
        r = builds.build(df, "page_id", ["page_id", "url"], make, path, {"rule": 1}, PARTS)
        have = builds.read(spark, path, "page_id long, url string, host string, size int")
        off = make(df).exceptAll(have).unionByName(have.exceptAll(make(df)))
        row = off.agg((F.count(F.lit(1)) == 0).alias("equal")).select(
            F.lit(run).alias("run"), F.lit(r["parts"]).cast("long").alias("parts"), F.lit(r["rebuilt"]).cast("long").alias("rebuilt"), F.lit(r["rows"]).cast("long").alias("rows"),
            F.lit(r["reused"]).alias("reused"), "equal").collect()                                                             # one row
        row = spark.createDataFrame(row, "run int, parts long, rebuilt long, rows long, reused boolean, equal boolean")
        out = row if out is None else out.unionByName(row)
    return out
