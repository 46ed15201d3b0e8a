"""J, P and S families over documents, labels, pages and the scored corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from echoloom.catalog.adapters import EM, LI, PG, TR, clip_files, corpus, r6, signals, table, transcripts, values_sql
from echoloom.catalog.q_sampling import BUCKET_SQL, DRAW_SQL, SEED, U, draw_join_sql, drawn, order_sql
from echoloom.catalog.registry import query
from echoloom.functions import draws as D
from echoloom.functions import text as X
from echoloom.operators import joins as J
from echoloom.operators import sampling as S
from echoloom.operators.running import hash_ordinal
from echoloom.plans import dims
from echoloom.session import inline_table, scratch_path
from echoloom.sources import tables as T

# ---- joins ------------------------------------------------------------------------------------


@query("j1_transcripts_with_clip", "SELECT doc_id AS utt_id, source AS speaker FROM documents SEMI JOIN labels USING (doc_id)")
def j1(spark, sf):
    tr = transcripts(spark, sf).select("utt_id", "speaker")
    return J.keep_existing(tr, table(spark, sf, "labels").withColumnRenamed("doc_id", "utt_id"), ["utt_id"])


DIM_B = values_sql("bdim", "mix, mix_content, mix_recipe, share, loss_weight", dims.BUCKETS)
DIM_R = values_sql("rdim", "mix_recipe, layers, aggr_lo, aggr_hi", [(r, n, a[0], a[1]) for r, n, _, a in dims.RECIPES])


@query("j2_sample_bucket_recipe", f"""WITH {LI}, {DIM_B}, {DIM_R}, s AS (SELECT *, {BUCKET_SQL} AS mix FROM li)
SELECT mix_content, mix_recipe, count(*) AS n, sum(layers)::BIGINT AS layers, round(avg(loss_weight), 6) AS weight,
  round(avg(aggr_hi - aggr_lo), 6) AS aggr FROM s JOIN bdim USING (mix) JOIN rdim USING (mix_recipe) GROUP BY ALL""")
def j2(spark, sf):
    m = J.with_mixture(drawn(spark, sf))
    return m.groupBy("mix_content", "mix_recipe").agg(
        F.count(F.lit(1)).alias("n"), F.sum("layers").alias("layers"), r6(F.avg("loss_weight")).alias("weight"),
        r6(F.avg(F.col("aggr_hi") - F.col("aggr_lo"))).alias("aggr"))


@query("j3_loss_weight_with_default", f"""WITH {LI}, w(bucket, weight) AS (VALUES ('RF', 1.15::DOUBLE), ('NO', 0.9::DOUBLE))
SELECT bucket, count(*) AS n, round(sum(coalesce(weight, 1.0)), 6) AS weight FROM li LEFT JOIN w USING (bucket) GROUP BY bucket""")
def j3(spark, sf):
    w = inline_table(spark, "bucket, weight", [("RF", 1.15), ("NO", 0.9)])
    return J.with_loss_weight(corpus(spark, sf), F.broadcast(w), "bucket").groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("weight")).alias("weight"))


@query("j4_clip_class_with_default", """SELECT doc_id AS utt_id, coalesce('quality_' || quality, 'unknown') AS quality_class
FROM documents LEFT JOIN labels USING (doc_id)""")
def j4(spark, sf):
    meta = table(spark, sf, "labels").select(F.col("doc_id").alias("utt_id"), F.concat(F.lit("quality_"), "quality").alias("quality_class"))
    return J.with_class(transcripts(spark, sf).select("utt_id"), meta, ["utt_id"], "quality_class", "unknown")


def _layers_sql():
    lo = " ".join(f"WHEN '{r}' THEN [{', '.join(str(a) for a, _ in snr)}]::DOUBLE[]" for r, n, snr, _ in dims.RECIPES if n)
    hi = " ".join(f"WHEN '{r}' THEN [{', '.join(str(b) for _, b in snr)}]::DOUBLE[]" for r, n, snr, _ in dims.RECIPES if n)
    layer_draw = draw_join_sql("ly", "layer", ["row_key", "layer"], "s.row_key, s.layer, s.lo, s.hi").replace(
        "FROM ly s", "FROM ly s")
    return f"""WITH {LI}, {EM}, {DRAW_SQL.replace(" WHERE class <> 3", "")}, {DIM_B}, {DIM_R},
s0 AS (SELECT row_key, mix, mix_recipe, layers FROM (SELECT row_key, {BUCKET_SQL} AS mix FROM li) JOIN bdim USING (mix) JOIN rdim USING (mix_recipe)),
ly AS (SELECT row_key, unnest(range(layers)) AS layer, CASE mix_recipe {lo} END AS lo, CASE mix_recipe {hi} END AS hi FROM s0 WHERE layers > 0),
d AS ({layer_draw}),
e AS (SELECT row_key, layer, clip_id, class, lo[layer + 1] + (hi[layer + 1] - lo[layer + 1]) * {U(SEED, 'layer-snr', 'row_key', 'layer')} AS snr FROM d)
SELECT s0.row_key, s0.mix, count(e.layer) AS n_layers, coalesce(string_agg(e.class || ':' || e.clip_id, '|' ORDER BY e.layer), '') AS clips,
  round(avg(e.snr), 6) AS snr FROM s0 LEFT JOIN e USING (row_key) GROUP BY ALL"""


@query("j6_samples_with_noise_layers", _layers_sql())
def j6(spark, sf):
    s = J.with_mixture(drawn(spark, sf)).select("row_key", "mix", "layers", "snr")
    out = J.draw_layers(s, "row_key", F.col("layers"), F.col("snr"), signals(spark, sf), "class", "clip_id", SEED, ["mix"], most=max(n for _, n, _, _ in dims.RECIPES))
    names = F.transform("layers", lambda v: F.concat_ws(":", v["layer_class"], v["layer_clip"]))
    mean = F.aggregate("layers", F.lit(0.0), lambda a, v: a + v["snr"]) / F.size("layers")
    return out.select("row_key", "mix", F.coalesce(F.size("layers"), F.lit(0)).cast("bigint").alias("n_layers"),
                      F.coalesce(F.array_join(names, "|"), F.lit("")).alias("clips"), r6(mean).alias("snr"))


@query("j7_bases_times_variants", f"""WITH {EM}, v AS (SELECT clip_id, class, unnest(range(6)) AS variant FROM em)
SELECT class, variant, count(*) AS n, round(sum(list_extract([99.0, 20.0, 12.0, 6.0, 0.0]::DOUBLE[], CAST(1 + floor({U(SEED, 'variant', 'clip_id', 'variant')} * 5) AS BIGINT))), 6) AS snr
FROM v GROUP BY ALL""")
def j7(spark, sf):
    v = signals(spark, sf).select("clip_id", "class", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("variant"))
    snr = D.choose(D.uniform(SEED, "variant", "clip_id", "variant"), [99.0, 20.0, 12.0, 6.0, 0.0])
    return v.groupBy("class", "variant").agg(F.count(F.lit(1)).alias("n"), r6(F.sum(snr)).alias("snr"))


@query("j8_cyclic_assignment", f"""WITH {LI}, {EM}, i AS (SELECT row_key, {order_sql('cyc')} - 1 AS i FROM li),
b AS (SELECT clip_id, row_number() OVER (ORDER BY {D.digest_sql(0, 'cycle', 'clip_id')}, clip_id) - 1 AS bi, count(*) OVER () AS n FROM em)
SELECT row_key, clip_id FROM i JOIN b ON (3 + i.i) % b.n = b.bi""")
def j8(spark, sf):
    s = hash_ordinal(corpus(spark, sf).select("row_key"), [], ["row_key"], SEED, "cyc", "i")
    return J.cyclic(s, "i", signals(spark, sf).select("clip_id"), "clip_id", start=3).select("row_key", "clip_id")


@query("j9_distinct_noise_pair", f"""WITH {LI}, n AS (SELECT count(*) AS n FROM embeddings),
a AS (SELECT row_key, CAST(floor({U(SEED, 'pair-a', 'row_key')} * n) AS BIGINT) AS a, CAST(floor({U(SEED, 'pair-b', 'row_key')} * (n - 1)) AS BIGINT) AS b FROM li, n)
SELECT row_key, a AS first, CASE WHEN b >= a THEN b + 1 ELSE b END AS second FROM a""")
def j9(spark, sf):
    n = signals(spark, sf).agg(F.count(F.lit(1))).scalar()
    s = corpus(spark, sf).select("row_key").withColumn("_n", n)
    return S.distinct_pair(s, ["row_key"], F.col("_n"), SEED).select("row_key", "first", "second")


@query("j12_held_out_isolation", """WITH e AS (SELECT DISTINCT sha256(text) AS h FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
p AS (SELECT doc_id, sha256(text) AS h FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality, 0) <> 1)
SELECT doc_id, CASE WHEN h IN (SELECT h FROM e) THEN 'leaked' ELSE 'clean' END AS status FROM p""")
def j12(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").join(table(spark, sf, "labels"), "doc_id", "left")
    ev = docs.filter("quality = 1")
    clean, leaked = J.held_out(docs.filter("coalesce(quality, 0) <> 1"), ev, "text")
    return (clean.select("doc_id", F.lit("clean").alias("status"))
            .unionByName(leaked.select("doc_id", F.lit("leaked").alias("status"))))


@query("j12_benchmark_isolation", r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\s]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[^\s]+') AS ws FROM benchmark),
g AS (SELECT DISTINCT array_to_string(ws[i : i + 7], ' ') AS gram FROM (SELECT ws, unnest(range(1, len(ws) - 6)) AS i FROM b)),
h AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, array_to_string(ws[i : i + 7], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)) SEMI JOIN g USING (gram))
SELECT doc_id, CASE WHEN h.doc_id IS NULL THEN 'clean' ELSE 'leaked' END AS status FROM documents LEFT JOIN h USING (doc_id)""")
def j12_benchmark(spark, sf):
    """Documents that hold eight words in a row of an evaluation item, wherever they stand in the text."""
    clean, leaked = J.held_out_passages(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"), "doc_id", "text", 8)
    return clean.select("doc_id", F.lit("clean").alias("status")).unionByName(leaked.select("doc_id", F.lit("leaked").alias("status")))


# ---- projections and predicates ---------------------------------------------------------------

NAMES_SQL = """nm AS (SELECT page_id, url, 'bank/' || CASE page_id % 6
  WHEN 0 THEN split_part(url, '/', 3) || '__' || page_id || '.wav' WHEN 1 THEN 'esc50_' || split_part(url, '/', 4) || '_street_' || page_id || '.wav'
  WHEN 2 THEN 'us8k_' || page_id || '_street_music.wav' WHEN 3 THEN 'proc_fan_hum_' || page_id || '.wav'
  WHEN 4 THEN 'babble_small_group_4t_' || page_id || '.wav' ELSE 'clip' || page_id || '.wav' END AS path FROM pages)"""


def _named(spark, sf):
    """Clip names in every layout the label rule knows, built from the page table."""
    u, i = F.split("url", "/"), F.col("page_id")
    name = (F.when(i % 6 == 0, F.concat(F.get(u, F.lit(2)), F.lit("__"), i, F.lit(".wav")))
            .when(i % 6 == 1, F.concat(F.lit("esc50_"), F.get(u, F.lit(3)), F.lit("_street_"), i, F.lit(".wav")))
            .when(i % 6 == 2, F.concat(F.lit("us8k_"), i, F.lit("_street_music.wav")))
            .when(i % 6 == 3, F.concat(F.lit("proc_fan_hum_"), i, F.lit(".wav")))
            .when(i % 6 == 4, F.concat(F.lit("babble_small_group_4t_"), i, F.lit(".wav")))
            .otherwise(F.concat(F.lit("clip"), i, F.lit(".wav"))))
    return table(spark, sf, "pages").select("page_id", "html", F.concat(F.lit("bank/"), name).alias("path"))


CLASS_SQL = """CASE WHEN contains(b, '__') THEN split_part(b, '__', 1) WHEN h = 'esc50' THEN array_to_string(p[2:-2], '_')
  WHEN h = 'us8k' THEN 'us8k_' || p[-1] WHEN h = 'proc' THEN 'proc_' || array_to_string(p[2:-2], '_')
  WHEN h = 'babble' THEN array_to_string(p[1:-3], '_') ELSE st END"""
STEMS = "st AS (SELECT page_id, path, b, st, string_split(st, '_') AS p, string_split(st, '_')[1] AS h FROM (SELECT *, split_part(path, '/', -1) AS b, regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', '') AS st FROM nm))"


@query("p1_class_from_filename", f"""WITH {NAMES_SQL}, {STEMS} SELECT page_id, {CLASS_SQL} AS class,
  CASE WHEN h = 'us8k' THEN array_to_string(p[3:], '_') ELSE {CLASS_SQL} END AS full_label FROM st""")
def p1(spark, sf):
    return _named(spark, sf).select("page_id", X.class_from_filename(F.col("path")).alias("class"),
                                    X.class_full_label(F.col("path")).alias("full_label"))


@query("p2_tag_build_and_parse", f"""WITH {LI}, t AS (SELECT concat_ws('|', 'v' || supp, line, part % 3, bucket) AS tag,
  CASE WHEN y = 1 THEN 'pos|' ELSE 'neg|' END || content || '|' || recipe || '|' || line AS grp FROM li)
SELECT split_part(tag, '|', 1) AS voice, CASE WHEN starts_with(grp, 'pos|') THEN 'pos' ELSE split_part(grp, '|', 1) || '|' || split_part(grp, '|', 2) END AS kind,
  count(*) AS n, min(tag) AS first_tag FROM t GROUP BY ALL""")
def p2(spark, sf):
    li = corpus(spark, sf)
    t = li.select(X.tag(F.concat(F.lit("v"), "supp"), F.col("line"), F.col("part") % 3, F.col("bucket")).alias("tag"),
                  X.group_tag("pos", F.array("content", "recipe", F.col("line").cast("string"))).alias("pg"),
                  X.group_tag("neg", F.array("content", "recipe", F.col("line").cast("string"))).alias("ng"), "y")
    t = t.withColumn("grp", F.when(F.col("y") == 1, F.col("pg")).otherwise(F.col("ng")))
    return t.groupBy(X.tag_part(F.col("tag"), 1).alias("voice"), X.kind_of_tag(F.col("grp")).alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.min("tag").alias("first_tag"))


@query("p3_length_filters", f"""WITH {TR} SELECT class, count(*) FILTER (len(text) > 600) AS kw, count(*) FILTER (len(text) > 400) AS filler,
  count(*) FILTER (len(text) BETWEEN 1500 AND 13000) AS eval, count(*) FILTER (len(text) > 1600 AND len(text) < 16000) AS trial FROM tr GROUP BY class""")
def p3(spark, sf):
    n = F.length("text")
    return transcripts(spark, sf).groupBy("class").agg(
        F.count_if(n > 600).alias("kw"), F.count_if(n > 400).alias("filler"),
        F.count_if(n.between(1500, 13000)).alias("eval"), F.count_if((n > 1600) & (n < 16000)).alias("trial"))


@query("p6_keyword_substring", f"WITH {TR} SELECT utt_id, speaker FROM tr WHERE len(list_filter(words, lambda w: contains(w, 'ther'))) > 0")
def p6(spark, sf):
    return transcripts(spark, sf).filter(X.any_contains(F.col("words"), "ther")).select("utt_id", "speaker")


@query("p7_whole_word_set", f"WITH {TR} SELECT utt_id, speaker FROM tr WHERE list_has_any(words, ['the', 'der', 'que'])")
def p7(spark, sf):
    return transcripts(spark, sf).filter(X.any_of(F.col("words"), ["the", "der", "que"])).select("utt_id", "speaker")


@query("p8_source_by_name", """SELECT page_id, CASE WHEN contains(url, '#top') THEN 'Calibrated'
  WHEN contains(url, 'blog') OR contains(url, '//m.') THEN 'Field' ELSE 'Studio' END AS source FROM pages""")
def p8(spark, sf):
    rules = [("Field", ["blog", "//m."]), ("Calibrated", ["#top"])]
    return table(spark, sf, "pages").select("page_id", X.source_of_name(F.col("url"), rules, "Studio").alias("source"))


@query("p10_transcript_hit_with_existing_clip", f"""WITH {TR} SELECT utt_id FROM tr SEMI JOIN (SELECT doc_id AS utt_id FROM labels) USING (utt_id)
WHERE len(list_filter(words, lambda w: contains(w, 'ther'))) > 0""")
def p10(spark, sf):
    hits = transcripts(spark, sf).filter(X.any_contains(F.col("words"), "ther")).select("utt_id")
    return J.keep_existing(hits, table(spark, sf, "labels").withColumnRenamed("doc_id", "utt_id"), ["utt_id"])


# ---- sources and sinks ------------------------------------------------------------------------

INDEX_SQL = f"""WITH {NAMES_SQL}, {STEMS}, l AS (SELECT page_id, len(html) AS n FROM pages)
SELECT path, {CLASS_SQL} AS class, round(n / 16000, 3) AS duration_s, 16000 AS sr FROM st JOIN l USING (page_id)"""


@query("s3_index_write_and_read", INDEX_SQL)
def s3(spark, sf):
    path = scratch_path(spark, "index")
    rows = T.index_rows(_named(spark, sf), F.length("html") / 16000.0, F.lit(16000))
    T.write_index(rows, path)
    T.write_index(rows, path)                     # a second run replaces the first
    return T.read_index(spark, path)


@query("s2_index_variant_with_fallback", f"""WITH {NAMES_SQL}, {STEMS} SELECT path, {CLASS_SQL} AS class FROM st""")
def s2(spark, sf):
    path = scratch_path(spark, "index")
    named = _named(spark, sf)
    named.select(F.col("path").alias("file"), F.lit("x").alias("class"), F.lit(1.0).alias("duration_s")).filter(
        F.length("path") < 0).write.option("header", "true").csv(path)
    return T.read_index(spark, path, fallback=named).select("path", "class")


@query("s2_index_by_header_names", f"""WITH {NAMES_SQL}, {STEMS} SELECT path, {CLASS_SQL} AS class, (page_id % 50) / 4.0 AS duration_s FROM st""")
def s2_names(spark, sf):
    path = scratch_path(spark, "index")
    rows = T.index_rows(_named(spark, sf), (F.col("page_id") % 50) / 4.0, F.lit(16000))
    rows.select("class", F.lit("x").alias("note"), "duration_s", F.col("path").alias("file")).write.option("header", "true").csv(path)
    return T.read_index(spark, path).select("path", "class", "duration_s")


@query("s5_column_alias_resolution", "SELECT lang AS class, 'unknown' AS target, count(*) AS n FROM documents GROUP BY lang")
def s5(spark, sf):
    d = table(spark, sf, "documents").withColumnRenamed("lang", "label")
    return d.groupBy(T.first_present(d, ["category", "label", "class", "target"]).alias("class"),
                     T.first_present(d, ["target", "category"], "unknown").alias("target")).agg(F.count(F.lit(1)).alias("n"))


@query("s4_nested_audio_shard", """SELECT lang AS class, source AS speaker, count(*) AS n, sum(strlen(text))::BIGINT AS bytes
FROM documents GROUP BY ALL""")
def s4(spark, sf):
    path = scratch_path(spark, "shard")
    d = table(spark, sf, "documents")
    cell = F.struct(F.encode("text", "utf-8").alias("bytes"), F.concat(F.lit("a/"), "doc_id").alias("path"))
    d.select(F.array(cell).alias("audio"), F.col("lang").alias("category"), F.col("source").alias("speaker_id")).write.parquet(path)
    clips = T.shard_clips(spark.read.parquet(path))
    return clips.groupBy("class", "speaker").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("bytes")).alias("bytes"))


@query("s6_transcript_lines", r"""WITH l AS (SELECT doc_id || ' ' || regexp_replace(text, '\s+', ' ', 'g') AS line FROM documents),
t AS (SELECT list_filter(string_split(trim(line), ' '), lambda w: w <> '') AS t FROM l)
SELECT t[1] AS utt_id, len(t) - 1 AS n_words, t[2] AS first_word FROM t WHERE len(t) >= 2""")
def s6(spark, sf):
    path = scratch_path(spark, "transcripts")
    d = table(spark, sf, "documents")
    d.select(F.concat_ws(" ", F.col("doc_id").cast("string"), F.regexp_replace("text", r"\s+", " "))).write.text(path)
    tr = T.parse_transcripts(spark.read.text(path))
    return tr.select("utt_id", F.size("words").alias("n_words"), F.element_at("words", 1).alias("first_word"))


@query("s13_manifest", f"WITH {PG} SELECT clip_id, octet_length(content) AS bytes, sha256(content) AS sha256 FROM pg")
def s13(spark, sf):
    return T.manifest(clip_files(spark, sf), "clip_id", "content").withColumnRenamed("name", "clip_id")


@query("s14_verify_bundle", f"""WITH {PG}, a AS (SELECT clip_id, CASE WHEN clip_id % 7 = 2 THEN content || encode('x') WHEN clip_id % 7 = 3
  THEN encode(replace(decode(content), 'a', 'b')) ELSE content END AS c FROM pg WHERE clip_id % 7 <> 1),
m AS (SELECT clip_id, octet_length(content) AS rb, sha256(content) AS rh FROM pg WHERE clip_id % 7 <> 5),
x AS (SELECT clip_id, octet_length(c) AS ab, sha256(c) AS ah FROM a)
SELECT * FROM (SELECT clip_id::VARCHAR AS name, CASE WHEN ab IS NULL THEN 'missing' WHEN rb IS NULL THEN 'unlisted'
  WHEN rb <> ab THEN 'size' WHEN rh <> ah THEN 'hash' END AS reason FROM m FULL JOIN x USING (clip_id)) WHERE reason IS NOT NULL""")
def s14(spark, sf):
    pg = clip_files(spark, sf).withColumn("name", F.col("clip_id").cast("string"))
    i = F.col("clip_id") % 7
    text = F.decode("content", "utf-8")
    damaged = (F.when(i == 2, F.encode(F.concat(text, F.lit("x")), "utf-8"))
               .when(i == 3, F.encode(F.replace(text, F.lit("a"), F.lit("b")), "utf-8")).otherwise(F.col("content")))
    recorded = T.manifest(pg.filter(i != 5), "name", "content")
    actual = T.manifest(pg.filter(i != 1).withColumn("content", damaged), "name", "content")
    return T.verify(recorded, actual)


@query("s15_table_digest", f"""WITH {PG} SELECT count(*) AS rows, sum(('0x' || substr(sha256(
  coalesce(length(clip_id::VARCHAR) || ':' || clip_id, '-') || coalesce(length(path) || ':' || path, '-') || coalesce(length(p2) || ':' || p2, '-')), 1, 15))::HUGEINT)::VARCHAR AS digest
FROM (SELECT *, CASE WHEN clip_id % 3 > 0 THEN path END AS p2 FROM pg)""")
def s15(spark, sf):
    gaps = clip_files(spark, sf).withColumn("p2", F.when(F.col("clip_id") % 3 > 0, F.col("path")))
    return T.table_digest(gaps, ["clip_id", "path", "p2"])


@query("s10_corpus_sink_and_partial_read", f"""WITH {LI}, o AS (SELECT *, row_number() OVER (ORDER BY {D.digest_sql(7, 'head', 'row_key')}, row_key) AS rn, count(*) OVER () AS n FROM li)
SELECT y, count(*) AS n, sum(q)::BIGINT AS q, 40.0::DOUBLE AS snr FROM o WHERE rn <= greatest(600, n // 20) GROUP BY y""")
def s10(spark, sf):
    path = scratch_path(spark, "corpus")
    li = S.head_val(corpus(spark, sf), ["row_key"]).withColumn("snr", F.lit(None).cast("double"))
    T.write_corpus(li.select("row_key", "y", "q", "bucket", "snr", "split"), path)
    val = spark.read.parquet(path).filter("split = 'val'")       # one folder, three columns
    return val.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("q"), F.max("snr").alias("snr"))


@query("s11_corpus_compaction", """SELECT label AS class, count(*) AS n, round(sum(list_sum(embedding::DOUBLE[])), 5) AS total, 'array<float>' AS kind FROM embeddings GROUP BY label""")
def s11(spark, sf):
    path = scratch_path(spark, "compact")
    T.compact(signals(spark, sf)).write.option("compression", "zstd").parquet(path)
    back = spark.read.parquet(path)
    kind = back.schema["x"].dataType.simpleString()
    return back.groupBy("class").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum(F.aggregate(F.col("x").cast("array<double>"), F.lit(0.0), lambda a, v: a + v)), 5).alias("total"),
        F.lit(kind).alias("kind"))


@query("s16_history_sink", f"""WITH {LI} SELECT part % 40 AS epoch, round(avg((p >= 0.68)::INT) FILTER (y = 1), 6) AS tpr,
  round(avg((p >= 0.68)::INT) FILTER (y = 0), 6) AS fpr FROM li GROUP BY 1""")
def s16(spark, sf):
    from echoloom.catalog.q_metrics import _history
    path = scratch_path(spark, "history")
    h = _history(spark, sf).select("epoch", r6("tpr").alias("tpr"), r6("fpr").alias("fpr"))
    T.write_history(h, {"seed": SEED}, path)
    return T.read_history(spark, path, "epoch bigint, tpr double, fpr double")


@query("m14_class_inventory", """SELECT CASE WHEN grouping(source) = 1 THEN 'TOTAL' ELSE source END AS source, count(*) AS clips,
  count(DISTINCT lang) AS classes, round(sum(len(text)) / 16000 / 3600, 6) AS hours FROM documents GROUP BY ROLLUP (source)""")
def m14(spark, sf):
    d = table(spark, sf, "documents").withColumn("n", F.length("text"))
    g = d.rollup("source").agg(F.count(F.lit(1)).alias("clips"), F.countDistinct("lang").alias("classes"),
                               r6(F.sum("n") / 16000 / 3600).alias("hours"), F.grouping("source").alias("g"))
    return g.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("source")).alias("source"), "clips", "classes", "hours")


@query("m15_corpus_quality_checks", """WITH d AS (SELECT *, CASE WHEN len(text) % 3 = 0 THEN 8000 ELSE 16000 END AS sr, len(text) / 16000 AS dur,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)
SELECT source, array_to_string(list_sort(list(DISTINCT sr)), ',') AS rates, round(sum(dur), 8) AS total, round(avg(dur), 8) AS mean, round(min(dur), 8) AS shortest,
  round(max(dur), 8) AS longest, count(*) FILTER (rn <= 60 AND sr <> 16000) AS problems FROM d GROUP BY source""")
def m15(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", F.length("text").alias("n"))
    d = d.withColumn("sr", F.when(F.col("n") % 3 == 0, 8000).otherwise(16000)).withColumn("dur", F.col("n") / 16000)
    stats = d.groupBy("source").agg(
        F.array_join(F.sort_array(F.collect_set("sr")), ",").alias("rates"), r6(F.sum("dur"), 8).alias("total"), r6(F.avg("dur"), 8).alias("mean"),
        r6(F.min("dur"), 8).alias("shortest"), r6(F.max("dur"), 8).alias("longest"))
    checked = S.cap_per_group(d, "source", ["doc_id"], 60).groupBy("source").agg(F.count_if(F.col("sr") != 16000).alias("problems"))
    return stats.join(checked, "source")


@query("m32_mined_bucket_histogram", f"""WITH {LI} SELECT bucket, count(*) AS n FROM (SELECT * FROM li WHERE y = 1 AND p < 0.68 ORDER BY q, row_key LIMIT 8000) GROUP BY bucket""")
def m32(spark, sf):
    from echoloom.operators.mining import bucket_histogram, missed_positives
    return bucket_histogram(missed_positives(corpus(spark, sf), 0.68, ["row_key"], 8000))
