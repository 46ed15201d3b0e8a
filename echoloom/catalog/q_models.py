"""T, H (corpus side) and the codec and feature jobs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from echoloom.catalog.adapters import EM, LI, TR, corpus, r6, signals, table, transcripts
from echoloom.catalog.q_arrays import DIG, PR, digest, pairs, pk, pw, zer, zip2
from echoloom.catalog.registry import query
from echoloom.functions import arrays as A
from echoloom.functions import draws as D
from echoloom.functions import wav
from echoloom.functions.features import log_mel
from echoloom.functions.text import any_contains
from echoloom.operators import joins as J
from echoloom.operators import mining as H
from echoloom.operators import scoring as T
from echoloom.operators.ranking import top_n
from echoloom.operators.metrics import at_budgets
from echoloom.plans import corpus as P
from echoloom.plans import dims
from echoloom.session import materialize, scratch_path
from echoloom.sources import tables as SRC

SEED = 31
WSQL = "[" + ", ".join(f"{w!r}::DOUBLE" for w in T.linear_weights()) + "]"


def lin(x):
    return f"(1.0 / (1.0 + exp(-(list_sum({zip2(x, WSQL, 'q[1] * q[2]')}) + -0.5))))"


def labelled(spark, sf):
    return signals(spark, sf).withColumn("y", (F.col("class") < 5).cast("int"))


EMY = EM.replace("AS x FROM", "AS x, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y FROM")


@query("t3_linear_scorer", f"WITH {EM} SELECT clip_id, round({lin('x')}, 6) AS p FROM em")
def t3(spark, sf):
    return signals(spark, sf).select("clip_id", r6(T.linear_score(F.col("x"))).alias("p"))


def _user_model(batch: pd.Series) -> pd.Series:
    x = np.stack(batch.to_numpy())
    z = x @ np.array([((i * 37) % 64 - 32) / 16.0 for i in range(x.shape[1])])
    return pd.Series(1.0 / (1.0 + np.exp(-(z - 0.5))), index=batch.index)


@query("t2_batch_scoring_user_model", f"WITH {EM} SELECT clip_id, round({lin('x')}, 6) AS p FROM em")
def t2(spark, sf):
    return T.score_batches(signals(spark, sf).select("clip_id", "x"), _user_model).select("clip_id", r6("p").alias("p"))


@query("t1_weighted_training")
def t1(spark, sf):
    df = T.row_weights(labelled(spark, sf), F.when(F.col("class") % 3 == 0, 1.25).otherwise(1.0))
    scored = T.apply_model(T.train(df), df)
    return scored.groupBy("y").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("p"), 2).alias("mean_p"), r6(F.sum("w"), 4).alias("weight"))


OFFS = "[" + ", ".join(str(o) for o in dims.OFFSETS) + "]"
OFF_SQL = f"""WITH {EMY}, neg AS (SELECT {lin('x')} AS p FROM em WHERE y = 0),
thr AS (SELECT p AS t FROM (SELECT p, row_number() OVER (ORDER BY p DESC) AS rn, count(*) OVER () AS n FROM neg) WHERE rn = CAST(floor(n * 0.05::DOUBLE) AS BIGINT)),
o AS (SELECT clip_id, x, unnest({OFFS}) AS k FROM em WHERE y = 1), r AS (SELECT k, list_concat(x[64 - k + 1:64], x[1:64 - k]) AS x FROM o),
s AS (SELECT k AS "offset", {lin('x')} AS p FROM r), st AS (SELECT "offset", count(*) AS n, avg((p >= t)::INT) AS tpr, avg(p) AS mean_conf FROM s, thr GROUP BY "offset")"""


def _offsets(spark, sf):
    em = labelled(spark, sf)
    scored = em.withColumn("p", T.linear_score(F.col("x")))
    thr = at_budgets(scored, [0.05]).select("threshold").scalar()
    return T.offset_stress(em, "x", dims.OFFSETS, T.linear_score, thr)


@query("m24_offset_stress", OFF_SQL + ' SELECT "offset", n, round(tpr, 6) AS tpr, round(mean_conf, 6) AS mean_conf FROM st')
def m24(spark, sf):
    return _offsets(spark, sf).select("offset", "n", r6("tpr").alias("tpr"), r6("mean_conf").alias("mean_conf"))


@query("m24_offset_summary", OFF_SQL + """ SELECT round(min(tpr), 6) AS lowest, round(max(tpr), 6) AS highest, round(max(tpr) - min(tpr), 6) AS spread,
  round(0.5 * (max(tpr) FILTER ("offset" = 0) + avg(tpr) FILTER ("offset" <> 0)), 6) AS selection FROM st""")
def m24b(spark, sf):
    s = T.offset_summary(_offsets(spark, sf))
    return s.select(*[r6(c).alias(c) for c in ("lowest", "highest", "spread", "selection")])


@query("m25_level_stress", f"""WITH {EMY}, g AS (SELECT y, x, unnest({[float(v) for v in dims.GAINS_DB]}::DOUBLE[]) AS gain_db FROM em),
s AS (SELECT y, gain_db, list_transform(x, lambda v: least(greatest(v + gain_db / 20.0 * 2.302585092994046::DOUBLE, -11.5129::DOUBLE), 5.0)) AS x FROM g), p AS (SELECT y, gain_db, {lin('x')} AS p FROM s)
SELECT gain_db, round(avg((p >= 0.5)::INT) FILTER (y = 1), 6) AS recall, round(avg(p) FILTER (y = 1), 6) AS pos_mean, round(avg((p >= 0.5)::INT) FILTER (y = 0), 6) AS fa_rate FROM p GROUP BY gain_db""")
def m25(spark, sf):
    t = T.level_stress(labelled(spark, sf), "x", dims.GAINS_DB, T.linear_score, 0.5)
    return t.select("gain_db", *[r6(c).alias(c) for c in ("recall", "pos_mean", "fa_rate")])


# ---- codec and features -----------------------------------------------------------------------

@query("s9_wav_encode_decode", f"""WITH {EM}, q AS (SELECT clip_id, list_transform(x, lambda v: trunc(least(greatest(v, -1.0), 1.0) * 32767.0::DOUBLE) / 32768.0::DOUBLE) AS q FROM em),
p AS (SELECT clip_id, list_concat({zer('18')}, q, {zer('18')}) AS y FROM q) SELECT clip_id, 16000 AS sr, {DIG} FROM p""")
def s9(spark, sf):
    enc = signals(spark, sf).select("clip_id", wav.encode_column(F.col("x"), length=100).alias("content"))
    dec = wav.decode_clips(enc, length=100)
    return digest(dec.withColumn("y", F.col("samples").cast("array<double>")), "sr")


@query("p11_corrupt_clip_tolerance", "SELECT label AS class, count(*) AS clips, count(*) FILTER (vec_id % 7 = 3) AS errors FROM embeddings GROUP BY label")
def p11(spark, sf):
    enc = signals(spark, sf).select("clip_id", "class", wav.encode_column(F.col("x"), length=64).alias("content"))
    broken = enc.withColumn("content", F.when(F.col("clip_id") % 7 == 3, F.substring("content", 1, 9)).otherwise(F.col("content")))
    dec = wav.decode_clips(broken, length=64)
    return dec.groupBy("class").agg(F.count(F.lit(1)).alias("clips"), F.count_if(F.col("error").isNotNull()).alias("errors"))


@query("s1_recursive_file_scan", "SELECT page_id % 5 AS bucket, sum(strlen(url) + 1)::BIGINT AS bytes, sum(strlen(url) + 1)::BIGINT AS listed FROM pages GROUP BY 1")
def s1(spark, sf):
    """Page addresses are written to files in nested folders; the scan finds and reads them."""
    path = scratch_path(spark, "files")
    pages = table(spark, sf, "pages").select(F.col("url").alias("value"), (F.col("page_id") % 5).alias("bucket"))
    pages.write.partitionBy("bucket").text(path)
    files = SRC.scan_clips(spark, path, "*.txt", content=True)
    bucket = F.regexp_extract("path", r"bucket=(\d+)/", 1).cast("bigint")
    return files.groupBy(bucket.alias("bucket")).agg(F.sum(F.octet_length("content")).cast("bigint").alias("bytes"), F.sum("length").alias("listed"))


@query("s7_label_by_directory", """SELECT (label < 5)::INT AS y, count(*) AS n, sum(44 + 2 * 64)::BIGINT AS bytes FROM embeddings GROUP BY 1""")
def s7(spark, sf):
    """Every clip as wav bytes under a labelled path."""
    clips = signals(spark, sf).select("clip_id", (F.col("class") < 5).alias("pos"), wav.encode_column(F.col("x"), length=64).alias("content"))
    files = clips.select(F.concat(F.when(F.col("pos"), "clips/positive/").otherwise("clips/negative/"), "clip_id", F.lit(".wav")).alias("path"), "content")
    stored = files.withColumn("length", F.length("content"))
    return SRC.label_by_directory(stored).groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))


@query("a31_log_mel_features")
def a31(spark, sf):
    clips = signals(spark, sf).select("clip_id", "class", A.tile_to(F.col("x"), 16000).alias("samples"))
    f = log_mel(clips)
    return f.select("clip_id", "class", F.size("features").alias("n"), r6(A.total(F.col("features").cast("array<double>")), 3).alias("total"))


# ---- mining jobs over the corpus --------------------------------------------------------------

@query("h4_missed_positives", f"WITH {LI} SELECT row_key, bucket, round(p, 6) AS p FROM li WHERE y = 1 AND p < 0.68 ORDER BY q, row_key LIMIT 8000")
def h4(spark, sf):
    return H.missed_positives(corpus(spark, sf), 0.68, ["row_key"], 8000).select("row_key", "bucket", r6("p").alias("p"))


H5_SQL = f"""WITH {EM}, {PR}, v AS (SELECT clip_id, x, z, unnest(range(6)) AS variant FROM pr),
d AS (SELECT *, list_extract([99.0, 20.0, 12.0, 6.0, 0.0]::DOUBLE[], CAST(1 + floor({D.uniform_sql(SEED, 'snr', 'clip_id', 'variant')} * 5) AS BIGINT)) AS snr,
  CAST(floor({D.uniform_sql(SEED, 'pos', 'clip_id', 'variant')} * 41) AS BIGINT) AS st FROM v),
e AS (SELECT *, list_concat({zer('st')}, z[1:24], {zer('64 - 24 - st')}) AS seg, CASE WHEN snr > 90 THEN {zer('64')} ELSE x END AS bed FROM d),
g AS (SELECT *, (sqrt({pw('seg')}) + 1e-9) / (sqrt({pw('bed')}) + 1e-12) * pow(10.0, snr / 20.0) AS g FROM e),
c AS (SELECT clip_id, variant, snr, {zip2('bed', 'seg', 'q[1] + q[2] * g')} AS c FROM g), m AS (SELECT *, {pk('c')} AS m FROM c),
p AS (SELECT clip_id, variant, snr, {lin('list_transform(c, lambda v: v / m * 0.35::DOUBLE)')} AS p FROM m)"""


def _deployed(spark, sf):
    v = pairs(spark, sf).select("clip_id", "x", "z", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("variant"))
    v = v.withColumn("snr", D.choose(D.uniform(SEED, "snr", "clip_id", "variant"), [99.0, 20.0, 12.0, 6.0, 0.0]))
    pos = D.integer_in(D.uniform(SEED, "pos", "clip_id", "variant"), 0, 41).cast("int")
    bed = F.when(F.col("snr") > 90, A.zeros(64)).otherwise(F.col("x"))
    spliced = A.splice_over_bed(F.slice("z", 1, 24), bed, pos, F.col("snr"), 64)
    # scored once; thresholds and the list of misses read the stored scores
    return materialize(v.withColumn("p", A.let(spliced, T.linear_score)).drop("x", "z"), "scores")


@query("h5_deployed_misses", H5_SQL + " SELECT clip_id, variant, snr, round(p, 6) AS p FROM p WHERE p < 0.4 ORDER BY round(p, 9), clip_id, variant LIMIT 6000")
def h5(spark, sf):
    miss = _deployed(spark, sf).filter("p < 0.4").withColumn("pr", F.round("p", 9))
    return top_n(miss, "pr", ["clip_id", "variant"], 6000, worst=True).select("clip_id", F.col("variant").cast("bigint").alias("variant"), "snr", r6("p").alias("p"))


@query("h5_deployed_miss_profile", H5_SQL + " SELECT snr, count(*) AS n, round(avg((p < 0.4)::INT), 6) AS miss, round(quantile_cont(p, 0.5), 6) AS median FROM p GROUP BY snr")
def h5b(spark, sf):
    t = H.miss_profile(_deployed(spark, sf), 0.4, ["snr"])
    return t.select("snr", "n", r6("miss").alias("miss"), r6("median").alias("median"))


def _pick(source, salt, n, part, y, bucket):
    return f"""SELECT {part} AS part, row_key, {y} AS y, {bucket} AS bucket, p FROM (SELECT *, row_number() OVER (ORDER BY {D.digest_sql(SEED, salt, 'row_key')}, row_key) AS rn FROM {source}) WHERE rn <= {n}"""


FT_SQL = f"""WITH {LI}, pos AS (SELECT * FROM li WHERE y = 1), ng AS (SELECT * FROM li WHERE y = 0), hn AS (SELECT * FROM li WHERE y = 0 AND p >= 0.5),
hp AS (SELECT * FROM (SELECT * FROM li WHERE y = 1 AND p < 0.68 ORDER BY q, row_key LIMIT 8000)),
un AS ({_pick('pos', 'anchor-pos', 3000, 0, 'y', 'bucket')} UNION ALL {_pick('ng', 'anchor-neg', 6000, 1, 'y', 'bucket')}
  UNION ALL {_pick('hn', 'hard-neg', 2000, 2, '0', "'MINE_negative'")} UNION ALL {_pick('hp', 'hard-pos', 1500, 3, '1', 'bucket')})"""


def _fine_tune(spark, sf):
    li = corpus(spark, sf, dealt=True).select("row_key", "y", "bucket", "p")
    neg = li.filter("y = 0 AND p >= 0.5")
    pos = H.missed_positives(li, 0.68, ["row_key"], 8000)
    return H.fine_tune_set(li, neg, pos, ["row_key"], 3000, 6000, 2000, 1500, SEED)


@query("h6_fine_tune_set", FT_SQL + f""", o AS (SELECT *, row_number() OVER (ORDER BY {D.digest_sql(SEED, 'head', 'part', 'row_key')}, part, row_key) AS rn, count(*) OVER () AS n FROM un)
SELECT part, row_key, y, bucket, CASE WHEN rn <= greatest(600, n // 20) THEN 'val' ELSE 'train' END AS split FROM o""")
def h6(spark, sf):
    return _fine_tune(spark, sf).select("part", "row_key", "y", "bucket", "split")


@query("g19_union_with_provenance", FT_SQL + " SELECT part, bucket, count(*) AS n, round(sum(p), 4) AS p FROM un GROUP BY ALL")
def g19(spark, sf):
    return _fine_tune(spark, sf).groupBy("part", "bucket").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("p"), 4).alias("p"))


V4 = dims.PROFILES["v4"]
H7_KEYS = ["utt_id", "word", "voice", "variant"]


@query("h7_confusable_variants", f"""WITH {TR}, cf AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[ \\n\\t\\r]+')) AS word FROM benchmark),
w AS (SELECT utt_id, word FROM (SELECT utt_id, unnest(list_distinct(words)) AS word FROM tr) SEMI JOIN cf USING (word)),
v AS (SELECT utt_id, word, voice, variant FROM w, (SELECT unnest(range(3)) AS voice), (SELECT unnest(range(3)) AS variant)),
d AS (SELECT word, voice, {D.uniform_sql(SEED, 'warp', *H7_KEYS)} < 0.60 AS warp, {D.uniform_sql(SEED, 'reverb', *H7_KEYS)} < 0.70 AS reverb FROM v)
SELECT word, voice, count(*) AS n, count(*) FILTER (warp) AS warped, count(*) FILTER (reverb) AS reverbed FROM d GROUP BY ALL""")
def h7(spark, sf):
    # the list of confusable words is a table of the job; here the words of the benchmark
    listed = table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), r"[ \n\t\r]+")).alias("word")).distinct()
    three = F.sequence(F.lit(0), F.lit(2))
    w = transcripts(spark, sf).select("utt_id", F.explode(F.array_distinct("words")).alias("word"))
    w = w.join(listed, "word", "left_semi").select("word", D.joined(*H7_KEYS[:2]).alias("spoken"))
    v = w.select("*", F.explode(three).alias("voice")).select("*", F.explode(three).alias("variant"))
    keys = ["spoken", *H7_KEYS[2:]]
    v = v.withColumn("warp", D.chance(SEED, "warp", 0.60, *keys)).withColumn("reverb", D.chance(SEED, "reverb", 0.70, *keys))
    return v.groupBy("word", "voice").agg(F.count(F.lit(1)).alias("n"), F.count_if("warp").alias("warped"), F.count_if("reverb").alias("reverbed"))


@query("h8_human_keyword_slices", f"""WITH {TR}, {EM}, h AS (SELECT utt_id FROM tr SEMI JOIN (SELECT doc_id AS utt_id FROM labels) USING (utt_id)
  WHERE len(list_filter(words, lambda w: contains(w, 'ther'))) > 0),
c AS (SELECT utt_id, x, CAST(floor({D.uniform_sql(SEED, 'cut', 'utt_id')} * 33) AS BIGINT) AS st FROM h JOIN em ON em.clip_id = utt_id % (SELECT count(*) FROM em)),
p AS (SELECT utt_id AS clip_id, x[st + 1:st + 32] AS y FROM c) SELECT clip_id, {DIG} FROM p""")
def h8(spark, sf):
    hits = transcripts(spark, sf).filter(any_contains(F.col("words"), "ther")).select("utt_id")
    hits = J.keep_existing(hits, table(spark, sf, "labels").withColumnRenamed("doc_id", "utt_id"), ["utt_id"])
    em = signals(spark, sf)
    n = em.agg(F.count(F.lit(1))).scalar()
    j = hits.withColumn("k", F.pmod(F.col("utt_id"), n)).join(em.select(F.col("clip_id").alias("k"), "x"), "k")
    y = A.random_slice(F.col("x"), 32, D.uniform(SEED, "cut", "utt_id"))
    return digest(j.select(F.col("utt_id").alias("clip_id"), y.alias("y")))


@query("h9_corpus_plan", f"""WITH {LI}, b(mix, mix_content, mix_recipe, share, w) AS (VALUES {", ".join(str((n, c, r, s, w)) for n, c, r, s, w in dims.BUCKETS)}),
r(mix_recipe, lo, hi) AS (VALUES {", ".join(str((n, a[0], a[1])) for n, _, _, a in dims.RECIPES)}),
s AS (SELECT row_key, y, CASE WHEN y = 1 THEN {{pos}} ELSE {{neg}} END AS mix FROM li),
a AS (SELECT *, lo::DOUBLE + (hi::DOUBLE - lo::DOUBLE) * {D.uniform_sql(SEED, 'aggr', 'row_key')} AS aggr FROM s JOIN b USING (mix) JOIN r USING (mix_recipe))
SELECT mix_content, mix_recipe, count(*) AS n, round(avg(aggr), 6) AS aggr, count(*) FILTER ({D.uniform_sql(SEED, 'cadence', 'row_key')} < 0.35 + 0.35::DOUBLE * aggr) AS cadence,
  count(*) FILTER ({D.uniform_sql(SEED, 'dropout', 'row_key')} < {V4['dropout'][0]}::DOUBLE + {V4['dropout'][1]}::DOUBLE * aggr) AS dropout,
  round(avg(-50.0 + 36.0 * {D.uniform_sql(SEED, 'level', 'row_key')}), 6) AS level FROM a GROUP BY ALL""".replace(
    "{pos}", "@POS").replace("{neg}", "@NEG"))
def h9(spark, sf):
    p = P.plan(corpus(spark, sf, dealt=True), "row_key", SEED)
    return p.groupBy("mix_content", "mix_recipe").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("aggr")).alias("aggr"), F.count_if("cadence").alias("cadence"),
        F.count_if("dropout").alias("dropout"), r6(F.avg("level")).alias("level"))


def _fill_plan_sql():
    from echoloom.catalog.q_sampling import NEG, POS, case_sql
    from echoloom.catalog.registry import ORACLES
    u = D.uniform_sql(SEED, "mix", "row_key")
    ORACLES["h9_corpus_plan"] = ORACLES["h9_corpus_plan"].replace("@POS", case_sql(u, POS)).replace("@NEG", case_sql(u, NEG))


_fill_plan_sql()


@query("h9_corpus_build")
def h9b(spark, sf):
    samples = corpus(spark, sf, dealt=True).select("row_key", "y")
    out = P.build(samples, "row_key", signals(spark, sf), "class", "clip_id", "x", 64, SEED)
    return out.groupBy("split", "bucket").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("snr"), 4).alias("snr"), r6(F.min("lvl"), 4).alias("min_lvl"), r6(F.max("lvl"), 4).alias("max_lvl"))


@query("h9_corpus_features")
def h9c(spark, sf):
    """One-second signals and their log-mel features for one planned sample per document."""
    docs = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    samples = docs.select("doc_id", F.coalesce("quality", F.lit(0)).alias("y"))
    f = P.build_features(samples, "doc_id", signals(spark, sf), "class", "clip_id", "x", 16000, SEED, repeat=True)
    return f.groupBy("split", "bucket").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(A.total(F.col("features").cast("array<double>")) / 1960), 3).alias("mean_feature"))
