"""G family: draws, quotas, splits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from echoloom.catalog.adapters import EM, LI, TR, corpus, r6, signals, transcripts
from echoloom.catalog.registry import query
from echoloom.functions import draws as D
from echoloom.operators import sampling as S
from echoloom.operators.running import hash_ordinal
from echoloom.plans import dims

SEED = 11
U = D.uniform_sql


def case_sql(u: str, weights: dict) -> str:
    steps = D.cumulative(weights)
    body = " ".join(f"WHEN {u} < {hi!r}::DOUBLE THEN '{n}'" for n, _, hi in steps[:-1])
    return f"CASE {body} ELSE '{steps[-1][0]}' END"


POS, NEG = dims.shares(True), dims.shares(False)
BUCKET_SQL = f"""CASE WHEN y = 1 THEN {case_sql(U(SEED, 'bucket', 'row_key'), POS)}
  ELSE {case_sql(U(SEED, 'bucket', 'row_key'), NEG)} END"""


def drawn(spark, sf):
    li = corpus(spark, sf, dealt=True)
    return li.withColumn("mix", S.draw_bucket(D.uniform(SEED, "bucket", "row_key"), F.col("y") == 1, POS, NEG))


@query("g1_weighted_bucket_draw", f"WITH {LI} SELECT {BUCKET_SQL} AS mix, count(*) AS n, sum(q)::BIGINT AS q FROM li GROUP BY mix")
def g1(spark, sf):
    return drawn(spark, sf).groupBy("mix").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("q"))


@query("g2_weighted_kind_draw", f"""WITH {LI} SELECT {case_sql(U(SEED, 'kind', 'row_key'), dims.NEGATIVE_KINDS)} AS kind, count(*) AS n
FROM li WHERE y = 0 GROUP BY kind""")
def g2(spark, sf):
    return (corpus(spark, sf).filter("y = 0").select(D.weighted(D.uniform(SEED, "kind", "row_key"), dims.NEGATIVE_KINDS).alias("kind"))
            .groupBy("kind").agg(F.count(F.lit(1)).alias("n")))


DRAW_SQL = f"""pool AS (SELECT class, clip_id FROM em WHERE class <> 3),
bank AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY {D.digest_sql(SEED, 'bank', 'clip_id')}, clip_id) - 1 AS clip_idx FROM pool),
cls AS (SELECT class, count(*) AS n_clips, row_number() OVER (ORDER BY class) - 1 AS class_idx FROM pool GROUP BY class)"""


def draw_join_sql(source: str, salt: str, keys: list[str], cols: str) -> str:
    return f"""SELECT {cols}, bank.class AS class, bank.clip_id AS clip_id FROM {source} s
JOIN cls ON cls.class_idx = CAST(floor({U(SEED, salt + '-class', *keys)} * (SELECT count(*) FROM cls)) AS BIGINT)
JOIN bank ON bank.class = cls.class AND bank.clip_idx = CAST(floor({U(SEED, salt + '-clip', *keys)} * cls.n_clips) AS BIGINT)"""


@query("g3_class_uniform_clip_draw", f"""WITH {LI}, {EM}, {DRAW_SQL}, d AS ({draw_join_sql('li', 'g3', ['row_key'], 's.row_key')})
SELECT class, clip_id, count(*) AS n FROM d GROUP BY ALL""")
def g3(spark, sf):
    d = S.draw_clips(corpus(spark, sf, dealt=True).select("row_key"), ["row_key"], signals(spark, sf), "class", "clip_id", SEED, "g3", exclude=[3])
    return d.groupBy("class", "clip_id").agg(F.count(F.lit(1)).alias("n"))


@query("j5_draw_joined_to_nth_clip", f"""WITH {LI}, {EM}, {DRAW_SQL}, d AS ({draw_join_sql('li', 'j5', ['row_key'], 's.row_key')})
SELECT row_key, class, clip_id FROM d""")
def j5(spark, sf):
    return S.draw_clips(corpus(spark, sf).select("row_key"), ["row_key"], signals(spark, sf), "class", "clip_id", SEED, "j5",
                        exclude=[3]).select("row_key", "class", "clip_id")


@query("g4_biased_two_pool_draw", f"""WITH {LI}, c AS (SELECT count(*) FILTER (content = 'A') AS nb FROM li)
SELECT CASE WHEN {U(SEED, 'pool', 'row_key')} < 0.35 AND nb > 0 THEN 'B' ELSE 'A' END AS pool, count(*) AS n FROM li, c GROUP BY pool""")
def g4(spark, sf):
    li = corpus(spark, sf)
    nb = li.agg(F.count_if(F.col("content") == "A")).scalar()
    return li.select(S.biased_pool(D.uniform(SEED, "pool", "row_key"), 0.35, nb).alias("pool")).groupBy("pool").agg(F.count(F.lit(1)).alias("n"))


@query("g5_uniform_range_draw", f"""WITH {LI}
SELECT bucket, round(avg(8.0 + 16.0 * {U(SEED, 'snr', 'row_key')}), 6) AS mean_snr, round(min(8.0 + 16.0 * {U(SEED, 'snr', 'row_key')}), 6) AS min_snr,
  sum(CAST(1200 + floor({U(SEED, 'start', 'row_key')} * 2000) AS BIGINT))::BIGINT AS start_sum,
  max(CAST(1200 + floor({U(SEED, 'start', 'row_key')} * 2000) AS BIGINT)) AS start_max FROM li GROUP BY bucket""")
def g5(spark, sf):
    d = corpus(spark, sf).select("bucket", D.in_range(D.uniform(SEED, "snr", "row_key"), 8.0, 24.0).alias("snr"),
                                 D.integer_in(D.uniform(SEED, "start", "row_key"), 1200, 3200).alias("start"))
    return d.groupBy("bucket").agg(r6(F.avg("snr")).alias("mean_snr"), r6(F.min("snr")).alias("min_snr"),
                                   F.sum("start").alias("start_sum"), F.max("start").alias("start_max"))


@query("g6_layer_count_choice", f"""WITH {LI} SELECT list_extract([1, 2, 2, 3, 3], CAST(1 + floor({U(SEED, 'layers', 'row_key')} * 5) AS BIGINT)) AS layers,
  count(*) AS n FROM li GROUP BY layers""")
def g6(spark, sf):
    return corpus(spark, sf).select(D.choose(D.uniform(SEED, "layers", "row_key"), [1, 2, 2, 3, 3]).alias("layers")).groupBy(
        "layers").agg(F.count(F.lit(1)).alias("n"))


def _effect_sql():
    v = dims.PROFILES["v4"]
    p = {"cadence": "0.35 + 0.35 * aggr", "reverb": "0.70", "distance": "0.62", "telephonic": f"{v['telephonic']} * aggr",
         "dropout": f"{v['dropout'][0]} + {v['dropout'][1]} * aggr", "mems": f"{v['mems']}",
         "bitcrush": f"{v['bitcrush'][0]} + {v['bitcrush'][1]} * aggr"}
    flags = ", ".join(f"count(*) FILTER ({U(SEED, e, 'row_key')} < ({x})::DOUBLE) AS {e}" for e, x in p.items())
    return f"""WITH {LI}, a AS (SELECT row_key, bucket, {U(SEED, 'aggr', 'row_key')} AS aggr FROM li)
SELECT bucket, round(avg(aggr), 6) AS mean_aggr, {flags} FROM a GROUP BY bucket"""


@query("g7_effect_plan", _effect_sql())
def g7(spark, sf):
    a = corpus(spark, sf).withColumn("aggr", D.uniform(SEED, "aggr", "row_key"))
    plan = S.effect_plan(a, ["row_key"], F.col("aggr"), dims.PROFILES["v4"], SEED)
    return plan.groupBy("bucket").agg(r6(F.avg("aggr")).alias("mean_aggr"), *[F.count_if(F.col(e)).alias(e) for e in S.EFFECTS])


@query("g8_talker_conditions", f"""WITH {LI}, d AS (SELECT list_extract([0.3, 0.5, 1.0, 2.0, 3.0]::DOUBLE[], CAST(1 + floor({U(SEED, 'distance', 'row_key')} * 5) AS BIGINT)) AS distance,
  -15.0 + 27.0 * {U(SEED, 'effort', 'row_key')} AS effort, -50.0 + 36.0 * {U(SEED, 'level', 'row_key')} AS level FROM li),
e AS (SELECT *, CASE distance WHEN 0.3 THEN 70.0 WHEN 0.5 THEN 66.0 WHEN 1.0 THEN 60.0 WHEN 2.0 THEN 54.0 ELSE 50.5 END + effort AS spl FROM d)
SELECT distance, count(*) AS n, round(avg(spl), 6) AS spl, round(min(61.0 + spl - 60.0), 6) AS min_snr, round(max(61.0 + spl - 60.0), 6) AS max_snr,
  round(avg(level), 6) AS level FROM e GROUP BY distance""")
def g8(spark, sf):
    t = S.talker_conditions(corpus(spark, sf), ["row_key"], SEED)
    return t.groupBy("distance").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("spl")).alias("spl"), r6(F.min("talker_snr")).alias("min_snr"),
                                     r6(F.max("talker_snr")).alias("max_snr"), r6(F.avg("level")).alias("level"))


def order_sql(salt, key="row_key"):
    return f"row_number() OVER (ORDER BY {D.digest_sql(SEED, salt, key)}, {key})"


def _quota_sql(parts: dict, rest: str, salt: str) -> str:
    edges, out = "0", []
    for n, f in parts.items():
        edges += f" + CAST(floor(n * {f}::DOUBLE) AS BIGINT)"
        out.append(f"WHEN rn <= {edges} THEN '{n}'")
    return f"""WITH {LI}, o AS (SELECT *, {order_sql(salt)} AS rn, count(*) OVER () AS n FROM li WHERE y = 0)
SELECT part, count(*) AS n, sum(q)::BIGINT AS q FROM (SELECT q, CASE {' '.join(out)} ELSE '{rest}' END AS part FROM o) GROUP BY part"""


QUOTA_A = {"speech": 0.55, "rhyme": 0.10, "noise": 0.20}
QUOTA_B = {"speech": 0.55, "rhyme": 0.15, "marked": 0.05}


@query("g9_quota_mix_four_way", _quota_sql(QUOTA_A, "confusable", "quota-a"))
def g9a(spark, sf):
    return S.quota_mix(corpus(spark, sf).filter("y = 0"), ["row_key"], QUOTA_A, "confusable", SEED, "quota-a").groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("q").alias("q"))


@query("g9_quota_mix_remainder_noise", _quota_sql(QUOTA_B, "noise", "quota-b"))
def g9b(spark, sf):
    return S.quota_mix(corpus(spark, sf).filter("y = 0"), ["row_key"], QUOTA_B, "noise", SEED, "quota-b").groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("q").alias("q"))


@query("g9_index_routing", f"""WITH {LI}, o AS (SELECT *, {order_sql('route')} - 1 AS i FROM li)
SELECT CASE WHEN i % 3 = 0 THEN 'noise' WHEN i % 2 = 0 THEN 'confusable' ELSE 'phrase' END AS route, i % 5 AS lane, count(*) AS n, sum(q)::BIGINT AS q
FROM o GROUP BY ALL""")
def g9c(spark, sf):
    o = hash_ordinal(corpus(spark, sf), [], ["row_key"], SEED, "route", "i")
    route = F.when(F.col("i") % 3 == 0, "noise").when(F.col("i") % 2 == 0, "confusable").otherwise("phrase")
    return o.groupBy(route.alias("route"), (F.col("i") % 5).alias("lane")).agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("q"))


@query("g10_partition_plan", f"""WITH {LI}, t AS (SELECT sum(y)::BIGINT AS pos, count(*) AS total FROM li),
p AS (SELECT chunk, pos, total, CAST(ceil(total / 12) AS BIGINT) AS per FROM t, range(12) r(chunk)),
k AS (SELECT *, chunk * per AS start, least(per, total - chunk * per) AS take FROM p)
SELECT chunk, start, CAST(round_even(take * pos / total, 0) AS BIGINT) AS n_pos, take - CAST(round_even(take * pos / total, 0) AS BIGINT) AS n_neg,
  5 + chunk * 7919 AS seed FROM k WHERE take > 0""")
def g10(spark, sf):
    return S.partition_plan(corpus(spark, sf), 12, 5)


@query("g11_random_without_replacement", f"WITH {LI} SELECT row_key, q FROM (SELECT *, {order_sql('pick')} AS rn FROM li) WHERE rn <= 4000")
def g11(spark, sf):
    return S.take_random(corpus(spark, sf), 4000, ["row_key"], SEED, "pick").select("row_key", "q")


@query("t4_validation_cap", f"WITH {LI} SELECT bucket, count(*) AS n, sum(q)::BIGINT AS q FROM (SELECT *, {order_sql('val-cap')} AS rn FROM li) WHERE rn <= 12000 GROUP BY bucket")
def t4(spark, sf):
    return S.take_random(corpus(spark, sf), 12000, ["row_key"], SEED, "val-cap").groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum("q").alias("q"))


@query("g12_even_stride_subsample", f"""WITH {LI}, o AS (SELECT row_key, q, row_number() OVER (ORDER BY row_key) - 1 AS pos, count(*) OVER () AS n FROM li)
SELECT row_key, q FROM o JOIN range(2000) r(i) ON o.pos = (r.i * n) // 2000""")
def g12a(spark, sf):
    return S.even_stride(corpus(spark, sf).select("row_key", "q"), ["row_key"], 2000)


@query("g12_every_nth_subsample", f"""WITH {LI}, o AS (SELECT row_key, q, row_number() OVER (ORDER BY row_key) - 1 AS pos, count(*) OVER () AS n FROM li)
SELECT row_key, q FROM o WHERE pos % greatest(1, n // 700) = 0 AND pos // greatest(1, n // 700) < 700""")
def g12b(spark, sf):
    return S.every_nth(corpus(spark, sf).select("row_key", "q"), ["row_key"], 700)


@query("g13_cap_per_class_arrival_order", f"""WITH {TR} SELECT class, utt_id FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY utt_id) AS rn FROM tr) WHERE rn <= 220""")
def g13(spark, sf):
    return S.cap_per_group(transcripts(spark, sf).select("class", "utt_id"), "class", ["utt_id"], 220)


@query("k9_first_n_per_speaker", f"""WITH {TR} SELECT speaker, rn AS rank, utt_id FROM (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY len(text) DESC, utt_id) AS rn FROM tr) WHERE rn <= 10""")
def k9(spark, sf):
    from pyspark.sql import Window
    w = Window.partitionBy("speaker").orderBy(F.length("text").desc(), "utt_id")
    return transcripts(spark, sf).withColumn("rank", F.row_number().over(w)).filter("rank <= 10").select("speaker", "rank", "utt_id")


@query("g14_stratified_split", f"""WITH {LI}, o AS (SELECT *, row_number() OVER (PARTITION BY y, bucket ORDER BY {D.digest_sql(7, 'stratified', 'row_key')}, row_key) AS rn,
  count(*) OVER (PARTITION BY y, bucket) AS n FROM li)
SELECT row_key, CASE WHEN rn <= greatest(1, CAST(round_even(n * 0.2::DOUBLE, 0) AS BIGINT)) THEN 'val' ELSE 'train' END AS split FROM o""")
def g14(spark, sf):
    return S.stratified_split(corpus(spark, sf, dealt=True), ["y", "bucket"], ["row_key"]).select("row_key", "split")


@query("g15_shuffled_split", f"""WITH {LI}, o AS (SELECT *, row_number() OVER (ORDER BY {D.digest_sql(7, 'split', 'row_key')}, row_key) AS rn, count(*) OVER () AS n FROM li)
SELECT row_key, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM o""")
def g15(spark, sf):
    return S.shuffled_split(corpus(spark, sf, dealt=True), ["row_key"]).select("row_key", "split")


@query("g16_head_of_permutation_val", f"""WITH {LI}, o AS (SELECT *, row_number() OVER (ORDER BY {D.digest_sql(7, 'head', 'row_key')}, row_key) AS rn, count(*) OVER () AS n FROM li)
SELECT row_key, CASE WHEN rn <= greatest(600, n // 20) THEN 'val' ELSE 'train' END AS split FROM o""")
def g16(spark, sf):
    return S.head_val(corpus(spark, sf, dealt=True), ["row_key"]).select("row_key", "split")


@query("g17_full_shuffle", f"WITH {LI} SELECT row_key, {order_sql('shuffle')} - 1 AS pos FROM li")
def g17(spark, sf):
    return hash_ordinal(corpus(spark, sf).select("row_key"), [], ["row_key"], SEED, "shuffle", "pos")


@query("g18_first_occurrence_texts", f"WITH {TR} SELECT sha256(text) AS content_hash, min(utt_id) AS first_key, count(*) AS copies FROM tr GROUP BY 1")
def g18a(spark, sf):
    return S.first_occurrence(transcripts(spark, sf), F.col("text"), "utt_id")


@query("g18_first_occurrence_words", f"""WITH {TR} SELECT utt_id, len(words) AS n_words, len(list_distinct(words)) AS n_distinct FROM tr""")
def g18b(spark, sf):
    return transcripts(spark, sf).select("utt_id", F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("n_distinct"))


@query("g20_difference_of_splits", f"""WITH {LI}, o AS (SELECT *, row_number() OVER (ORDER BY {D.digest_sql(7, 'head', 'row_key')}, row_key) AS rn, count(*) OVER () AS n FROM li),
val AS (SELECT row_key FROM o WHERE rn <= greatest(600, n // 20))
SELECT bucket, count(*) AS n, sum(q)::BIGINT AS q FROM li ANTI JOIN val USING (row_key) GROUP BY bucket""")
def g20(spark, sf):
    li = corpus(spark, sf)
    val = S.head_val(li.select("row_key"), ["row_key"]).filter("split = 'val'").select("row_key")
    return li.join(val, "row_key", "left_anti").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("q"))


WORDS = ["de", "the", "of", "que", "und", "sch"]
WL = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"


@query("g21_class_set_intersection", f"""WITH {TR} SELECT utt_id, len(list_intersect(list_distinct(words), {WL})) AS common FROM tr WHERE len(list_intersect(words, {WL})) > 0""")
def g21(spark, sf):
    arr = F.array(*[F.lit(w) for w in WORDS])
    t = transcripts(spark, sf).select("utt_id", F.size(F.array_intersect("words", arr)).alias("common"))
    return t.filter("common > 0")
